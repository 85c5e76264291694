"""Queries over document lines."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartledger.config.vocabulary import (
    ANALYTES,
)
from chartledger.functions.dates import with_dates
from chartledger.functions.text import fold
from chartledger.operators import extraction as X
from chartledger.operators.predicates import confidence_band
from chartledger.plans.bindings import Registry

REG = Registry()
query = REG.add

SEX = "CASE WHEN doc_id % 2 = 0 THEN 'female' ELSE 'male' END"


def _q(text):
    return "'" + text.replace("'", "''") + "'"


# Written for the lines of the `line` view alone, not taken from the operators.
_MED_RE = _q(
    r"((?:tab|cap|syp)\.?)?\s*([a-z][a-z0-9\-/'\s]{2,40}?)\s*"
    r"([0-9]+(?:\.[0-9]+)?\s*(?:mg|ml))?\s*"
    r"([0-9]\s*-\s*[0-9]\s*-\s*[0-9]|\b(?:od|bd|tds|hs|stat)\b)"
    r"(?:\s*(?:x|for)\s*([0-9]+\s*(?:days|day|weeks|week)\b))?")
_INV_RE = _q(
    r"^([a-z][a-z0-9\s\.\(\)/\-]{1,45}?)[\s:–-]+([0-9]+(?:\.[0-9]+)?)\s*(%|g/dl|mg/dl)?\s*(.*)$")
_DX_RE = _q(r"(?:diagnosis|impression|known case of)\s*[:\-–]?\s*(.+)")
_PX_RE = _q(r"(?:procedure|surgery|underwent|done)\s*[:\-–]?\s*(.+)")

_ALIAS = "alias(key, alias, ord) AS (VALUES " + ", ".join(
    f"('{a[0]}', {_q(al)}, {i * 10 + j})" for i, a in enumerate(ANALYTES)
    for j, al in enumerate(a[3])) + ")"
_ANALYTE = "analyte(key, display, unit, lo_m, hi_m, lo_f, hi_f) AS (VALUES " + ", ".join(
    f"('{a[0]}', {_q(a[1])}, {_q(a[2])}, "
    + ", ".join(str(x) for x in (*a[4][0][1:], *a[4][-1][1:])) + ")" for a in ANALYTES) + ")"

_DATED = r"""
 g AS (SELECT *,
   regexp_extract_all(text, '\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})\b')[1] AS dmy,
   regexp_extract_all(text, '\b(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})\b')[1] AS ymd,
   regexp_extract(text, '\b(\d{1,2})\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+(\d{4})\b', 0, 'i') AS dmony,
   regexp_extract(text, '\b((?:19|20)\d{2})\b', 1) AS yr FROM line),
 dated AS (SELECT *,
   CASE WHEN dmy IS NOT NULL AND try_strptime(dmy, '%d/%m/%Y') IS NOT NULL
          THEN CAST(try_strptime(dmy, '%d/%m/%Y') AS DATE)
        WHEN ymd IS NOT NULL AND try_strptime(ymd, '%Y-%m-%d') IS NOT NULL
          THEN CAST(try_strptime(ymd, '%Y-%m-%d') AS DATE)
        WHEN dmony <> '' THEN CAST(try_strptime(dmony, '%d %b %Y') AS DATE)
        WHEN yr <> '' THEN make_date(CAST(yr AS INT), 1, 1) END AS day,
   CASE WHEN dmy IS NOT NULL OR ymd IS NOT NULL OR dmony <> '' THEN 'exact'
        WHEN yr <> '' THEN 'year' ELSE 'unknown' END AS precision FROM g)
"""

_ENTITY = "WITH " + _ALIAS + ", " + _ANALYTE + "," + _DATED + rf"""
, m AS (SELECT *, {SEX} AS sex, trim(regexp_extract(text, {_DX_RE}, 1, 'i'), ' .;,') AS dx,
   trim(regexp_extract(text, {_PX_RE}, 1, 'i'), ' .;,') AS px,
   regexp_extract(text, {_INV_RE}, 1, 'i') AS lab,
   try_cast(regexp_extract(text, {_INV_RE}, 2, 'i') AS DOUBLE) AS labv,
   regexp_extract(text, {_INV_RE}, 3, 'i') AS labu,
   regexp_extract(text, {_INV_RE}, 4, 'i') AS rest,
   upper(trim(regexp_extract(text, {_MED_RE}, 1, 'i'), '. ')) AS form,
   trim(regexp_extract(text, {_MED_RE}, 2, 'i'), ' .:-') AS name,
   regexp_extract(text, {_MED_RE}, 3, 'i') AS dose,
   regexp_extract(text, {_MED_RE}, 4, 'i') AS freq,
   regexp_extract(text, {_MED_RE}, 5, 'i') AS dur FROM dated),
folded AS (SELECT DISTINCT lab, ' ' || trim(regexp_replace(lower(lab), '[^a-z0-9]+', ' ', 'g'))
   || ' ' AS f FROM m),
keyed AS (SELECT lab, arg_max(key, (length(alias), -ord)) AS akey FROM folded
   JOIN alias ON contains(f, ' ' || alias || ' ') GROUP BY lab),
e AS (SELECT m.*, akey, display, analyte.unit AS aunit,
   regexp_extract(rest, '(\d+(?:\.\d+)?)\s*(?:-|–|to)\s*(\d+(?:\.\d+)?)', 1) AS r1,
   regexp_extract(rest, '(\d+(?:\.\d+)?)\s*(?:-|–|to)\s*(\d+(?:\.\d+)?)', 2) AS r2,
   regexp_extract(rest, '(?:<|less than|up ?to|upto)\s*(\d+(?:\.\d+)?)', 1) AS rx,
   CASE WHEN sex = 'male' THEN lo_m ELSE lo_f END AS tlo,
   CASE WHEN sex = 'male' THEN hi_m ELSE hi_f END AS thi,
   CASE WHEN dx <> '' THEN 'diagnosis' WHEN px <> '' THEN 'procedure'
        WHEN akey IS NOT NULL THEN 'investigation'
        WHEN length(name) >= 3 AND NOT regexp_matches(lower(name),
          '^(date|name|age|sex|patient|ref|dr|reg|opd|uhid)') THEN 'medication' END AS kind
   FROM m LEFT JOIN keyed USING (lab) LEFT JOIN analyte ON analyte.key = akey),
ent AS (SELECT *, CASE kind WHEN 'diagnosis' THEN dx WHEN 'procedure' THEN px
     WHEN 'investigation' THEN trim(lab, ' .:-') ELSE name END AS label,
   CASE WHEN r1 <> '' THEN CAST(r1 AS DOUBLE) WHEN rx <> '' THEN NULL ELSE tlo END AS lo,
   CASE WHEN r1 <> '' THEN CAST(r2 AS DOUBLE) WHEN rx <> '' THEN CAST(rx AS DOUBLE) ELSE thi END
     AS hi,
   CASE WHEN r1 <> '' OR rx <> '' THEN 'report' ELSE 'reference_table' END AS src
   FROM e WHERE kind IS NOT NULL)
"""


def entities(v):
    return X.extract_entities(v.line.withColumn("sex", F.expr(SEX)), "sex")


@query("s4_document_lines", "", r"""
WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(replace(replace(text,
   chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)),
   lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '') AS ls FROM documents),
u AS (SELECT doc_id, len(ls) AS n, unnest(range(len(ls))) AS i, ls FROM t)
SELECT doc_id, CAST(i AS INT) AS line_no, ls[i + 1] AS text, round(i / n, 4) AS y,
   round(1 / n, 4) AS height FROM u""")
def _(v):
    return X.document_lines(v.documents.select("doc_id", "text")).drop("page")


@query("x1_extract_entities", "line", _ENTITY + """
SELECT doc_id, line_no, kind, label, CASE WHEN kind = 'investigation' THEN labv END AS value,
  CASE WHEN kind = 'investigation' THEN CASE WHEN labu <> '' THEN labu ELSE aunit END END AS unit,
  day AS observed_on, precision AS date_precision FROM ent""")
def _(v):
    return entities(v).select("doc_id", "line_no", "kind", "label", "value", "unit",
                              "observed_on", "date_precision")


@query("x2_medication_fields", "line", _ENTITY + """
SELECT doc_id, line_no, label, CASE WHEN form <> '' THEN form END AS form,
  CASE WHEN dose <> '' THEN dose END AS dose, freq AS frequency_raw,
  CASE upper(freq) WHEN '1-0-1' THEN '2× daily (morning, night)' WHEN 'BD' THEN 'twice daily'
       WHEN 'TDS' THEN 'three times daily' ELSE freq END AS frequency,
  CASE WHEN dur <> '' THEN dur END AS duration,
  CASE WHEN contains(text, 'oral') THEN 'oral' ELSE CASE
     WHEN contains(lower(text), 'po') THEN 'oral' WHEN contains(lower(text), 'iv')
       THEN 'intravenous' WHEN contains(lower(text), 'im') THEN 'intramuscular'
     WHEN contains(lower(text), 'sc') THEN 'subcutaneous' END END AS route,
  CASE WHEN contains(text, 'after food') THEN 'after food' END AS timing
FROM ent WHERE kind = 'medication'""")
def _(v):
    return entities(v).filter("kind = 'medication'").select(
        "doc_id", "line_no", "label", "form", "dose", "frequency_raw", "frequency", "duration",
        "route", "timing")


@query("x3_parse_dates", "line", "WITH " + _DATED.lstrip() + """
SELECT event_id, day, precision FROM dated""")
def _(v):
    return with_dates(v.line, "text", "day", "precision").select("event_id", "day", "precision")


_DOCDATE = _DATED + r"""
, docd AS (SELECT doc_id, arg_min(day, (cue, page, line_no)) AS document_date,
   arg_min(precision, (cue, page, line_no)) AS document_precision,
   arg_min(text, (cue, page, line_no)) AS document_date_line FROM (
     SELECT *, CASE WHEN regexp_matches(text, '\b(?:date|dated|dt|on|report(?:ed)? on|collected(?: on)?|sample date|visit date)\b', 'i') THEN 0 ELSE 1 END AS cue
     FROM dated WHERE day IS NOT NULL) GROUP BY 1)
"""


@query("x4_document_dates", "line", "WITH " + _DOCDATE + "SELECT * FROM docd")
def _(v):
    return X.document_dates(v.line)


_INHERITED = _ENTITY + _DOCDATE[_DOCDATE.index(", docd"):] + """
, inh AS (SELECT ent.*, document_date, coalesce(day, document_date) AS observed_on,
   CASE WHEN day IS NULL AND document_date IS NOT NULL THEN document_precision ELSE precision END
     AS date_precision,
   CASE WHEN day IS NOT NULL THEN 'own_line' WHEN document_date IS NOT NULL
        THEN 'document_header' END AS date_source,
   handwritten OR confidence IS NULL OR confidence <= 0.72 AS chk
   FROM ent LEFT JOIN docd USING (doc_id))
"""


def dated_entities(v):
    return X.inherit_dates(entities(v), X.document_dates(v.line))


@query("x5_inherit_dates", "line", _INHERITED + """
SELECT doc_id, line_no, kind, observed_on, date_precision, date_source FROM inh""")
def _(v):
    return dated_entities(v).select("doc_id", "line_no", "kind", "observed_on", "date_precision",
                                    "date_source")


@query("x6_confidence_lanes", "line", _INHERITED + """
SELECT kind, CASE WHEN chk THEN 'needs_check' ELSE 'confident' END AS lane,
  CAST(count(*) AS BIGINT) AS n FROM inh GROUP BY 1, 2""")
def _(v):
    sure, check = X.confidence_lanes(entities(v))
    lanes = sure.select("kind", F.lit("confident").alias("lane")).unionByName(
        check.select("kind", F.lit("needs_check").alias("lane")))
    return lanes.groupBy("kind", "lane").agg(F.count("*").alias("n"))


@query("x7_fold", "", """
SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS folded
FROM documents""")
def _(v):
    return v.documents.select("doc_id", F.md5(fold(F.col("text"))).alias("folded"))


@query("x8_match_analytes", "line", "WITH " + _ALIAS + """
, l AS (SELECT event_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' '
   AS f FROM line)
SELECT event_id, arg_max(key, (length(alias), -ord)) AS analyte_key FROM l
LEFT JOIN alias ON contains(f, ' ' || alias || ' ') GROUP BY 1""")
def _(v):
    return X.match_analytes(v.line, "text").select("event_id", "analyte_key")


@query("x9_assess_range", "line", _ENTITY + """
SELECT doc_id, line_no, akey AS analyte_key, lo AS reference_low, hi AS reference_high,
  CASE WHEN labv < lo THEN 'low' WHEN labv > hi THEN 'high' ELSE 'in_range' END AS range_flag,
  src AS range_source FROM ent WHERE kind = 'investigation'""")
def _(v):
    return entities(v).filter("kind = 'investigation'").select(
        "doc_id", "line_no", "analyte_key", "reference_low", "reference_high", "range_flag",
        "range_source")


def _classified(extra):
    return _ENTITY + f"""
SELECT doc_id, CASE WHEN bool_or(kind = 'medication') THEN 'prescription'
   WHEN bool_or(kind = 'investigation') THEN 'lab_report'
   WHEN bool_or(kind = 'diagnosis'{extra}) THEN 'discharge_summary' ELSE 'other' END
   AS document_kind FROM ent GROUP BY 1"""


@query("x10_classify_capture", "line", _classified(""))
def _(v):
    return X.classify_documents(entities(v))


@query("x10_classify_promotion", "line", _classified(" OR kind = 'procedure'"))
def _(v):
    return X.classify_documents(entities(v), rule="promotion")


_REVIEW = _INHERITED + """
, item AS (SELECT doc_id, CASE WHEN chk THEN 'pending:' ELSE 'recorded:' END
     || CAST(line_no AS VARCHAR) AS item_id, chk AS pending, label, line_no FROM inh),
rev AS (SELECT *, CASE (doc_id + line_no) % 5 WHEN 0 THEN 'confirm' WHEN 1 THEN 'correct'
     WHEN 2 THEN 'dispute' WHEN 3 THEN 'shrug' END AS action,
   CASE WHEN line_no = 4 THEN ' ' ELSE 'read ' || label END AS fix FROM item),
done AS (SELECT *, CASE WHEN action IN ('confirm', 'dispute')
     OR (action = 'correct' AND trim(fix) <> '') THEN action END AS act FROM rev)
"""


def reviewed(v):
    rows = entities(v).select(
        "doc_id", "line_no", "label", X.needs_check().alias("pending")).withColumn(
        "item_id", F.concat(F.when(F.col("pending"), "pending:").otherwise("recorded:"),
                            F.col("line_no").cast("string")))
    reviews = rows.select(
        "doc_id", "item_id",
        F.expr("CASE (doc_id + line_no) % 5 WHEN 0 THEN 'confirm' WHEN 1 THEN 'correct' "
               "WHEN 2 THEN 'dispute' WHEN 3 THEN 'shrug' END").alias("action"),
        F.expr("CASE WHEN line_no = 4 THEN ' ' ELSE 'read ' || label END")
        .alias("corrected_text"), F.lit("reader").alias("reviewer"))
    return X.apply_reviews(rows, reviews)


@query("x11_apply_reviews", "line", _REVIEW + """
SELECT doc_id, item_id, coalesce(pending AND act IN ('confirm', 'correct'), false) AS admitted,
  coalesce(NOT pending AND act = 'dispute', false) AS disputed,
  CASE WHEN pending AND act = 'correct' THEN 'reader' END AS read_by,
  CASE WHEN pending AND act = 'correct' THEN fix ELSE label END AS shown FROM done""")
def _(v):
    return reviewed(v).select("doc_id", "item_id", "admitted", "disputed", "read_by", "shown")


@query("x11_documents_open", "line", _REVIEW + """
SELECT doc_id, bool_or(pending AND act IS NULL) AS needs_verification FROM done GROUP BY 1""")
def _(v):
    return X.documents_open(reviewed(v))


@query("x12_document_quality", "line", """
SELECT doc_id, page, CAST(count(*) AS BIGINT) AS blocks, round(avg(confidence), 4)
   AS mean_confidence, CAST(count(*) FILTER (handwritten) AS BIGINT) AS handwritten_blocks,
   CAST(count(*) AS BIGINT) AS recognised, CAST(count(*) FILTER (handwritten OR confidence IS NULL
   OR confidence <= 0.72) AS BIGINT) AS needs_review, CAST(0 AS BIGINT) AS unreadable
FROM line GROUP BY 1, 2""")
def _(v):
    return X.document_quality(v.line)


@query("x12_bands", "line", """
SELECT CASE WHEN confidence IS NULL OR handwritten OR confidence <= 0.72 THEN 'verify'
   WHEN confidence >= 0.9 THEN 'high' ELSE 'medium' END AS band, CAST(count(*) AS BIGINT) AS n
FROM line GROUP BY 1""")
def _(v):
    shown = confidence_band(F.col("confidence"), F.col("handwritten"), F.col("text"),
                            F.lit(None).cast("string"))
    return v.line.groupBy(shown.alias("band")).agg(F.count("*").alias("n"))


# Every line but each fourth is a region of its own; items are numbered within their lane.
_REGIONS = _INHERITED + """
, numbered AS (SELECT doc_id, chk, row_number() OVER (PARTITION BY doc_id, chk ORDER BY line_no)
     - 1 AS nr, CASE WHEN line_no % 4 <> 3 THEN line_no // 2 END AS region_id FROM inh),
reg AS (SELECT doc_id, region_id, chk, nr, CASE WHEN chk THEN 'pending:' ELSE 'recorded:' END
     || CAST(nr AS VARCHAR) AS item_id FROM numbered WHERE region_id IS NOT NULL)
"""


def _region():
    return F.expr("CASE WHEN line_no % 4 <> 3 THEN line_no div 2 END")


def _region_items(v):
    at = F.row_number().over(W.partitionBy("doc_id", "_chk").orderBy("line_no")) - 1
    rows = entities(v).withColumn("_chk", X.needs_check()).withColumns(
        {"position": at, "region_id": _region()})
    return X.region_items(rows.filter("NOT _chk"), rows.filter("_chk").withColumnRenamed(
        "position", "entity_index"))


@query("x12_region_items", "line", _REGIONS + """
SELECT doc_id, region_id, item_id, CAST(row_number() OVER (PARTITION BY doc_id, region_id
   ORDER BY chk, nr) AS INT) AS item_no FROM reg""")
def _(v):
    return _region_items(v)


@query("x12_document_regions", "line", _REGIONS + """
, blk AS (SELECT doc_id, line_no // 2 AS region_id, text, line_no, CASE WHEN handwritten
     OR confidence IS NULL OR confidence <= 0.72 THEN 'verify' WHEN confidence >= 0.9 THEN 'high'
     ELSE 'medium' END AS measured FROM line WHERE line_no % 4 <> 3)
SELECT doc_id, region_id, line_no, md5(text) AS shown, CASE WHEN line_no = 8 THEN 'unreadable'
   ELSE measured END AS band, CAST((SELECT count(*) FROM reg WHERE reg.doc_id = blk.doc_id
     AND reg.region_id = blk.region_id) AS BIGINT) AS items FROM blk""")
def _(v):
    blocks = v.line.withColumns({
        "region_id": _region(), "failure": F.expr("CASE WHEN line_no = 8 THEN 'blurred' END")})
    return X.document_regions(blocks, _region_items(v)).select(
        "doc_id", "region_id", "line_no", F.md5("text").alias("shown"), "band", "items")
