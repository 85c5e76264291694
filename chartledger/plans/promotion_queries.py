"""Queries over repeating groups, promotion and evaluation."""

from pyspark.sql import functions as F

from chartledger.config.rules import CONDITION_TERMS
from chartledger.functions.values import make_value
from chartledger.operators import evaluate as E
from chartledger.operators import extraction as X
from chartledger.operators import ledger as L
from chartledger.operators import promotion as M
from chartledger.plans.bindings import Registry
from chartledger.plans.extraction_queries import _ENTITY, _INHERITED, dated_entities, entities
from chartledger.plans.ledger_queries import facts
from chartledger.streaming.jobs import work_folder

REG = Registry()
query = REG.add


def doc_facts(v):
    """Facts of the extracted entities. Numbering reads its rows twice, so they are written out and
    the patterns of the extraction run once a line."""
    path = work_folder(v.spark, "entities")
    rows = entities(v).select(
        "doc_id", F.col("line_no").alias("seq"), "kind", "label", "dose", "frequency_raw", "route",
        "value", "observed_on", "source_text")
    rows.write.parquet(path)
    rows = v.spark.read.schema(rows.schema).parquet(path)
    return M.entity_facts(rows).withColumn("document_id", F.col("doc_id").cast("string"))


_NUM = _ENTITY + """
, num AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY line_no) - 1 AS i,
   CASE WHEN contains(text, 'oral') THEN 'oral' WHEN contains(lower(text), 'po') THEN 'oral'
     WHEN contains(lower(text), 'iv') THEN 'intravenous' WHEN contains(lower(text), 'im')
     THEN 'intramuscular' WHEN contains(lower(text), 'sc') THEN 'subcutaneous' END AS route
   FROM ent)
"""


@query("x1_entity_facts", "line", _NUM + """
, fld AS (SELECT doc_id, line_no, kind, i, unnest(CASE kind
   WHEN 'medication' THEN [('name', label), ('dose', dose), ('frequency', freq), ('route', route)]
   WHEN 'procedure' THEN [('name', label)]
   WHEN 'diagnosis' THEN [('reported_term', label), ('reported_year',
        CAST(extract(year FROM day) AS VARCHAR))]
   ELSE [('analyte', label), ('value', CAST(labv AS VARCHAR))] END) AS f FROM num)
SELECT doc_id, CASE kind WHEN 'medication' THEN 'medications' WHEN 'procedure' THEN 'procedures'
  WHEN 'diagnosis' THEN 'problems' ELSE 'investigations' END || '[' || CAST(i AS VARCHAR) || '].'
  || f[1] AS path, f[2] AS shown FROM fld WHERE f[2] IS NOT NULL AND f[2] <> ''""")
def _(v):
    return doc_facts(v).select("doc_id", "path", F.col("value.s").alias("shown"))


@query("l8_repeating_groups", "line", _NUM + """
SELECT doc_id, CAST(i AS INT) AS entry, label AS name, CASE WHEN dose <> '' THEN dose END AS dose,
  freq AS frequency, route FROM num WHERE kind = 'medication'""")
def _(v):
    return M.repeating_groups(doc_facts(v), "medications", ["doc_id"], ["seq"]).select(
        "doc_id", F.col("entry").cast("int").alias("entry"), "name", "dose", "frequency", "route")


_TERM_SQL = "CASE c " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in CONDITION_TERMS.items()) + " END"


@query("l9_problems_from_choices", "afact", f"""
WITH c AS (SELECT session_id, seq, fact_id, unnest(string_split(vs, '|')) AS c,
   generate_subscripts(string_split(vs, '|'), 1) AS o FROM afact
   WHERE active AND path = 'past_medical.conditions'),
p AS (SELECT session_id, count(*) AS n FROM afact WHERE active
   AND path = 'problems[1].reported_term' GROUP BY 1)
SELECT c.session_id, fact_id, c AS choice, {_TERM_SQL} AS term, CAST(row_number() OVER
  (PARTITION BY c.session_id ORDER BY seq, o) - 1 + coalesce(p.n, 0) AS BIGINT) AS entry
FROM c LEFT JOIN p USING (session_id) WHERE {_TERM_SQL} IS NOT NULL""")
def _(v):
    f = facts(v)
    existing = L.active_facts(f).filter("path = 'problems[1].reported_term'").groupBy(
        "session_id").agg(F.count("*").alias("problem_count"))
    return M.problems_from_choices(f, existing).select(
        "session_id", "fact_id", "choice", "term", "entry")


_PEOPLE = """
WITH inc AS (SELECT encounter_id AS incoming_id, CASE WHEN encounter_id % 4 = 0 THEN NULL
    ELSE 'abha' || CAST(100000 + patient_id * 2 AS VARCHAR) END AS abha_ref,
    CASE WHEN encounter_id % 3 = 0 THEN NULL ELSE 'n' || CAST(encounter_id AS VARCHAR) END
      AS display_name, CASE WHEN encounter_id % 5 = 0 THEN 'other' END AS gender,
    CASE WHEN encounter_id % 6 <> 0 THEN CAST(2024 - encounter_id % 90 AS INT) END AS born,
    CASE WHEN encounter_id % 7 = 0 THEN 'hi' ELSE 'en' END AS lang FROM encounter),
pat AS (SELECT patient_id, abha_ref, CASE WHEN patient_id % 2 = 0 THEN display_name END
    AS display_name, CASE WHEN patient_id % 3 = 0 THEN gender END AS gender,
    year_of_birth AS born, 'ta' AS lang FROM patient)
"""


@query("l12_resolve_patients", "encounter patient", _PEOPLE + """
, w AS (SELECT abha_ref, arg_min(display_name, incoming_id) FILTER (display_name IS NOT NULL) AS dn,
    arg_min(gender, incoming_id) FILTER (gender IS NOT NULL) AS g, min(incoming_id) AS start
    FROM inc WHERE abha_ref IS NOT NULL GROUP BY 1)
SELECT coalesce(CAST(p.patient_id AS VARCHAR), substr(sha256('ref|' || w.abha_ref), 1, 16))
   AS patient_key, coalesce(p.abha_ref, w.abha_ref) AS abha_ref,
   coalesce(p.display_name, w.dn) AS display_name, coalesce(p.gender, w.g) AS gender,
   CASE WHEN p.patient_id IS NULL THEN i.born ELSE p.born END AS year_of_birth,
   CASE WHEN p.patient_id IS NULL THEN i.lang ELSE p.lang END AS preferred_language,
   p.patient_id IS NULL AS created
FROM (SELECT * FROM pat WHERE abha_ref IS NOT NULL) p FULL JOIN w ON w.abha_ref = p.abha_ref
LEFT JOIN inc i ON i.incoming_id = w.start
UNION ALL SELECT CAST(patient_id AS VARCHAR), NULL, display_name, gender, born, lang, false
FROM pat WHERE abha_ref IS NULL
UNION ALL SELECT substr(sha256('visit|' || CAST(incoming_id AS VARCHAR)), 1, 16), NULL,
   display_name, gender, born, lang, true FROM inc WHERE abha_ref IS NULL""")
def _(v):
    inc = v.encounter.selectExpr(
        "encounter_id AS incoming_id", "CASE WHEN encounter_id % 4 = 0 THEN NULL ELSE 'abha' || "
        "CAST(100000 + patient_id * 2 AS STRING) END AS abha_ref",
        "CASE WHEN encounter_id % 3 = 0 THEN NULL ELSE 'n' || CAST(encounter_id AS STRING) END "
        "AS display_name", "CASE WHEN encounter_id % 5 = 0 THEN 'other' END AS gender",
        "CASE WHEN encounter_id % 6 <> 0 THEN encounter_id % 90 + 1 END AS age_years",
        "CASE WHEN encounter_id % 7 = 0 THEN 'hi' END AS preferred_language")
    pat = v.patient.selectExpr(
        "patient_id", "abha_ref", "CASE WHEN patient_id % 2 = 0 THEN display_name END "
        "AS display_name", "CASE WHEN patient_id % 3 = 0 THEN gender END AS gender",
        "year_of_birth", "'ta' AS preferred_language")
    return M.resolve_patients(pat, inc, "2025-03-01")


def gate(v):
    traced = v.scope.selectExpr("session_id", "length(session_id) % 2 = 0 AS ok")
    confirmed = v.scope.selectExpr(
        "session_id", "CASE WHEN session_id LIKE '%1' THEN '' ELSE 'dr' END AS confirmed_by")
    return M.confirmed_sessions(traced, confirmed)


def promotable(v):
    """Facts with a source span of which every field is told by some rows."""
    document = F.col("document_id").isNotNull()
    n = F.col("seq")
    span = L.make_span(
        kind=F.when(document, "document").otherwise("utterance"), verbatim=F.col("verbatim"),
        language=F.when(n % 3 == 0, "hi").otherwise("en"), modality=F.col("modality"),
        question_id=F.when(~document, F.concat(F.lit("q"), (n % 16).cast("string"))),
        turn_id=F.when(~document, F.concat(F.lit("t"), n.cast("string"))),
        asr_confidence=F.when(n % 2 == 0, F.lit(0.8)), document_id=F.col("document_id"),
        page=F.when(document, n % 4 + 1),
        bbox=F.when(document, F.struct(F.lit(0.1).alias("x"), F.lit(0.2).alias("y"),
                                       F.lit(0.5).alias("width"), F.lit(0.25).alias("height"))),
        ocr_confidence=F.when(document, F.lit(0.5)), handwritten=F.when(document, n % 5 == 0),
        human_reading=F.when(n % 10 == 0, F.col("vs")), read_by=F.when(n % 10 == 0, "reader"))
    return facts(v).withColumns({"span": span, "confidence": (n % 8) / F.lit(8.0)})


_GATE = "length(session_id) % 2 = 0 AND NOT session_id LIKE '%1'"


@query("l13_promote_facts", "afact scope", f"""
SELECT fact_id, path, vkind AS kind, replace(vs, '|', ', ') AS display_value, tier AS state,
  CAST(seq % 8 AS DOUBLE) / 8 AS confidence,
  CASE WHEN modality = 'speech' AND seq % 2 = 1 THEN 'unavailable' ELSE 'measured' END
    AS confidence_status FROM afact WHERE {_GATE}""")
def _(v):
    durable, _evidence = M.promote_facts(promotable(v), gate(v))
    return durable.select("fact_id", "path", F.col("value.kind").alias("kind"), "display_value",
                          "state", "confidence", "confidence_status")


@query("l13_promote_evidence", "afact scope", f"""
SELECT fact_id, CASE WHEN document_id IS NOT NULL THEN 'document' ELSE 'utterance' END
  AS source_type, verbatim, CASE WHEN seq % 3 = 0 THEN 'hi' ELSE 'en' END AS language, modality,
  CASE WHEN document_id IS NULL THEN 'q' || CAST(seq % 16 AS VARCHAR) END AS question_id,
  CASE WHEN document_id IS NULL THEN 't' || CAST(seq AS VARCHAR) END AS turn_id,
  CASE WHEN seq % 2 = 0 THEN 0.8 END AS asr_confidence, document_id AS document_ref,
  CASE WHEN document_id IS NOT NULL THEN seq % 4 + 1 END AS page,
  CASE WHEN document_id IS NOT NULL THEN '0.1,0.2,0.5,0.25' ELSE '' END AS bbox,
  CASE WHEN document_id IS NOT NULL THEN 0.5 END AS ocr_confidence,
  CASE WHEN seq % 10 = 0 THEN vs END AS human_reading,
  CASE WHEN seq % 10 = 0 THEN 'reader' END AS read_by,
  document_id IS NOT NULL AND seq % 5 = 0 AS handwritten
FROM afact WHERE {_GATE}""")
def _(v):
    _durable, evidence = M.promote_facts(promotable(v), gate(v))
    return evidence.withColumn("bbox", F.concat_ws(",", *[
        F.col(f"bbox.{c}").cast("string") for c in ("x", "y", "width", "height")]))


_DOCROW = "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'reader' END"


def documents(v):
    return v.line.groupBy("doc_id").agg(F.count("*").alias("n")).selectExpr(
        "doc_id", "'scan' || CAST(doc_id AS STRING) AS filename", f"{_DOCROW} AS verified_by",
        "DATE '2024-02-01' AS uploaded_on", "'other' AS document_kind")


def items(v):
    return dated_entities(v).withColumns({
        "pending": X.needs_check(),
        "item_id": F.col("line_no").cast("string")})


@query("l14_promote_entities", "line", _INHERITED + f"""
SELECT doc_id, CAST(line_no AS VARCHAR) AS item_id, label,
  CASE WHEN chk THEN 'corrected' ELSE 'accepted' END AS verification FROM inh
WHERE NOT (chk AND {_DOCROW} IS NULL)""")
def _(v):
    kept, _warned, _uploads = M.promote_entities(documents(v), items(v))
    return kept.select("doc_id", "item_id", "label", "verification")


@query("l14_promotion_timeline", "line encounter", _INHERITED + f"""
SELECT CAST(encounter_id AS VARCHAR) AS source, occurred_on, 'exact' AS date_precision,
  'encounter' AS kind, CASE WHEN encounter_id % 3 = 0 THEN 'Clinical encounter' ELSE priority END
  AS label, 'Confirmed by dr' AS detail, false AS low_confidence FROM encounter
UNION ALL SELECT DISTINCT CAST(doc_id AS VARCHAR), DATE '2024-02-01', 'exact', 'document',
  'Uploaded: scan' || CAST(doc_id AS VARCHAR), 'other', false FROM line
UNION ALL SELECT CAST(doc_id AS VARCHAR), observed_on, coalesce(date_precision, 'unknown'), kind,
  label, NULL, chk FROM inh WHERE NOT (chk AND {_DOCROW} IS NULL)""")
def _(v):
    kept, _warned, _uploads = M.promote_entities(documents(v), items(v))
    visits = v.encounter.selectExpr(
        "encounter_id", "occurred_on",
        "CASE encounter_id % 3 WHEN 0 THEN '' ELSE priority END AS headline",
        "'dr' AS confirmed_by")
    return M.promotion_timeline(visits, documents(v), kept)


@query("l14_promotion_warnings", "line", _INHERITED + f"""
SELECT doc_id, CAST(line_no AS VARCHAR) AS item_id,
  label || ' was left unverified and was not promoted.' AS warning FROM inh
WHERE chk AND {_DOCROW} IS NULL""")
def _(v):
    _kept, warned, _uploads = M.promote_entities(documents(v), items(v))
    return warned


def doc_dates(v):
    return X.document_dates(v.line).select(
        F.col("doc_id").cast("string").alias("document_id"), "document_date")


@query("l15_promote_medications", "line", _INHERITED + """
SELECT doc_id, label AS name, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g'))
  AS normalized_name, 'documented' AS status, document_date AS observed_on
FROM inh WHERE kind = 'medication'""")
def _(v):
    groups = M.repeating_groups(doc_facts(v), "medications", ["doc_id"], ["seq"])
    return M.promote_medications(groups, doc_dates(v)).select(
        "doc_id", "name", "normalized_name", "status", "observed_on")


@query("l16_promote_observations", "line", _INHERITED + """
SELECT doc_id, label AS analyte, akey AS analyte_key, labv AS value,
  CASE WHEN doc_id % 5 = 0 THEN 'own/L' ELSE aunit END AS unit,
  CASE WHEN doc_id % 7 = 0 THEN 0.5 ELSE tlo END AS reference_low,
  CASE WHEN doc_id % 7 = 0 THEN 1.5 ELSE thi END AS reference_high,
  CASE WHEN doc_id % 11 = 0 THEN 'critical' WHEN labv < tlo THEN 'low' WHEN labv > thi THEN 'high'
       ELSE 'in_range' END AS range_flag,
  CASE WHEN doc_id % 7 = 0 THEN 'report' ELSE 'reference_table' END AS range_source,
  CASE WHEN doc_id % 3 = 0 THEN DATE '2021-05-06' ELSE document_date END AS observed_on FROM inh
WHERE kind = 'investigation'""")
def _(v):
    groups = M.repeating_groups(doc_facts(v), "investigations", ["doc_id"], ["seq"])
    # What some reports print beside the value wins over the table.
    groups = groups.withColumns({c: F.expr(e) for c, e in {
        "sex": "CASE WHEN doc_id % 2 = 0 THEN 'female' ELSE 'male' END",
        "unit": "CASE WHEN doc_id % 5 = 0 THEN 'own/L' ELSE '' END",
        "reference_low": "CASE WHEN doc_id % 7 = 0 THEN 0.5D END",
        "reference_high": "CASE WHEN doc_id % 7 = 0 THEN 1.5D END",
        "range_flag": "CASE WHEN doc_id % 11 = 0 THEN 'critical' ELSE 'unknown' END",
        "observed_on": "CASE WHEN doc_id % 3 = 0 THEN '2021-05-06' END"}.items()})
    return M.promote_observations(groups, doc_dates(v), "sex").select(
        "doc_id", "analyte", "analyte_key", "value", "unit", "reference_low", "reference_high",
        "range_flag", "range_source", "observed_on")


@query("l17_promotion_counts", "efact med encounter", """
SELECT encounter_id, CAST(sum(f) AS BIGINT) AS facts, CAST(sum(m) AS BIGINT) AS medications,
  CAST(sum(t) AS BIGINT) AS timeline FROM (
  SELECT encounter_id, count(*) AS f, 0 AS m, 0 AS t FROM efact GROUP BY 1 UNION ALL
  SELECT encounter_id, 0, count(*), 0 FROM med GROUP BY 1 UNION ALL
  SELECT encounter_id, 0, 0, count(*) FROM encounter GROUP BY 1) GROUP BY 1""")
def _(v):
    return M.promotion_counts(["encounter_id"], {
        "facts": v.efact.select("encounter_id"), "medications": v.med.select("encounter_id"),
        "timeline": v.encounter.select("encounter_id")})


# ---- evaluation

_LASTV = """
WITH act AS (SELECT session_id AS script_id, path, max_by(vs, seq) AS vs, max_by(vkind, seq) AS k
   FROM afact WHERE active GROUP BY 1, 2),
gold AS (SELECT session_id AS script_id, path, CASE WHEN min(seq) % 4 = 0 THEN 'other'
   WHEN max(vkind) = 'list' THEN string_split(max_by(vs, seq), '|')[1] ELSE max_by(vs, seq) END
   AS vs, max(vkind) AS k FROM sfact GROUP BY 1, 2)
"""


def actual(v):
    rows = L.slot_view(facts(v))
    return rows.select(F.col("session_id").alias("script_id"), "path", "value")


def gold(v):
    g = v.sfact.groupBy("session_id", "path").agg(
        F.min("seq").alias("m"), F.max("vkind").alias("k"), F.max_by("vs", "seq").alias("vs"))
    text = F.expr("CASE WHEN m % 4 = 0 THEN 'other' WHEN k = 'list' THEN "
                  "split(vs, '[|]')[0] ELSE vs END")
    kind = F.expr("CASE WHEN m % 4 = 0 AND k <> 'list' THEN 'text' ELSE k END")
    return g.select(F.col("session_id").alias("script_id"), "path",
                    make_value(kind, text).alias("value"))


_SCORED = _LASTV + """
, sc AS (SELECT g.script_id, g.path, coalesce(CASE WHEN g.k = 'list' THEN a.k = 'list' AND
   list_contains(string_split(a.vs, '|'), g.vs) ELSE a.vs = g.vs END, false) AS matched
  FROM gold g LEFT JOIN act a ON a.script_id = g.script_id AND a.path = g.path)
"""


@query("e1_score_slots", "afact sfact", _SCORED + "SELECT * FROM sc")
def _(v):
    return E.score_slots(gold(v), actual(v))


@query("e2_score_flags", "result", """
SELECT script_id, array_to_string(list_sort(list_filter(string_split(expected_flags, '|'),
    lambda x: x <> '' AND NOT list_contains(string_split(fired_flags, '|'), x))), ',') AS missed,
  array_to_string(list_filter([forbidden_flags], lambda x: list_contains(string_split(fired_flags,
    '|'), x)), ',') AS forbidden_fired FROM result""")
def _(v):
    split = lambda c: F.filter(F.split(c, r"\|"), lambda x: x != "")
    g = v.result.select("script_id", split("expected_flags").alias("expected"),
                        split("forbidden_flags").alias("forbidden"))
    fired = v.result.select("script_id", split("fired_flags").alias("fired"))
    return E.score_flags(g, fired).select(
        "script_id", F.array_join("missed", ",").alias("missed"),
        F.array_join("forbidden_fired", ",").alias("forbidden_fired"))


@query("e3_score_declines", "absence afact", """
WITH g AS (SELECT DISTINCT session_id, path FROM absence WHERE seq % 2 = 0)
SELECT g.session_id AS script_id, bool_and(EXISTS (SELECT 1 FROM absence a WHERE
   a.session_id = g.session_id AND a.path = g.path AND a.reason = 'declined') AND NOT EXISTS
   (SELECT 1 FROM afact f WHERE f.active AND f.session_id = g.session_id AND f.path = g.path))
   AS declined_ok FROM g GROUP BY 1""")
def _(v):
    a = v.absence.withColumnRenamed("session_id", "script_id")
    g = a.filter("seq % 2 = 0").select("script_id", "path").distinct()
    return E.score_declines(g, a, actual(v))


def results(v):
    split = lambda c: F.filter(F.split(c, r"\|"), lambda x: x != "")
    rows = v.result.withColumns({c: split(c) for c in (
        "expected_flags", "fired_flags", "forbidden_flags")})
    return rows.withColumn("forbidden_fired", F.array_intersect("forbidden_flags", "fired_flags"))


_RES = """
WITH r AS (SELECT *, list_filter(string_split(expected_flags, '|'), lambda x: x <> '') AS ef,
   string_split(fired_flags, '|') AS ff, CASE expected_priority WHEN 'immediate' THEN 2
   WHEN 'urgent' THEN 1 ELSE 0 END AS ep, CASE actual_priority WHEN 'immediate' THEN 2
   WHEN 'urgent' THEN 1 ELSE 0 END AS ap FROM result),
q AS (SELECT *, len(list_filter(ef, lambda x: list_contains(ff, x))) AS caught FROM r)
"""
_MET = """
  CAST(count(*) AS BIGINT) AS scripts,
  round(sum(facts_without_source) / sum(facts_recorded), 4) AS hallucination_rate,
  CAST(sum(unsourced_claims) AS BIGINT) AS unsourced_claims,
  round(sum(caught) / sum(len(ef)), 4) AS sensitivity,
  round(count(*) FILTER (len(ef) > 0 AND caught = len(ef)) / count(*) FILTER (len(ef) > 0), 4)
    AS emergency_recall,
  round(count(*) FILTER (ep = ap) / count(*), 4) AS priority_accuracy,
  CAST(count(*) FILTER (ap < ep) AS BIGINT) AS under_calls,
  CAST(count(*) FILTER (list_contains(ff, forbidden_flags)) AS BIGINT) AS forbidden_scripts,
  round(sum(matched_slots) / sum(expected_slots), 4) AS extraction_accuracy,
  round(avg(completeness) FILTER (ok), 4) AS mean_completeness,
  CAST(count(*) FILTER (NOT ok) AS BIGINT) AS failures
"""


@query("e4_metrics", "result", _RES + f"SELECT {_MET} FROM q")
def _(v):
    return E.metrics(results(v))


@query("e5_per_field", "afact sfact", _SCORED + """
SELECT path, CAST(count(*) AS BIGINT) AS expected, CAST(count(*) FILTER (matched) AS BIGINT)
  AS matched, round(count(*) FILTER (matched) / count(*), 4) AS accuracy FROM sc GROUP BY 1""")
def _(v):
    return E.per_field(E.score_slots(gold(v), actual(v)))


@query("e6_by_difficulty", "result", _RES + """
SELECT difficulty, CAST(count(*) AS BIGINT) AS scripts, round(sum(matched_slots)
  / sum(expected_slots), 4) AS extraction, round(avg(completeness), 4) AS completeness,
  CAST(sum(len(ef)) AS BIGINT) AS flags_expected, CAST(sum(caught) AS BIGINT) AS flags_caught
FROM q GROUP BY 1""")
def _(v):
    return E.by_difficulty(results(v))


@query("e7_timing", "result", """
WITH s AS (SELECT list_sort(list(duration_ms)) AS l, count(*) AS n FROM result)
SELECT round(list_sum(l) / n, 1) AS mean_ms, CAST(l[n // 2 + 1] AS DOUBLE) AS median_ms,
  CAST(l[least(CAST(floor(n * 0.95) AS BIGINT), n - 1) + 1] AS DOUBLE) AS p95_ms,
  CAST(l[n] AS DOUBLE) AS max_ms FROM s""")
def _(v):
    return E.timing(v.result)


@query("e8_gap", "result", _RES + f"""
, m AS (SELECT set_name, {_MET} FROM q GROUP BY 1),
t AS (UNPIVOT (SELECT set_name, hallucination_rate, sensitivity, extraction_accuracy,
   mean_completeness, priority_accuracy FROM m) ON COLUMNS (* EXCLUDE (set_name))
   INTO NAME metric VALUE value)
SELECT metric, max(value) FILTER (set_name = 'dev') AS dev, max(value) FILTER (set_name = 'held')
  AS held, round(max(value) FILTER (set_name = 'held') - max(value) FILTER (set_name = 'dev'), 4)
  AS gap FROM t GROUP BY 1""")
def _(v):
    return E.gap(results(v), "set_name")


@query("e8_strict_gate", "result", _RES + f"""
, m AS (SELECT set_name, {_MET} FROM q GROUP BY 1)
SELECT set_name, hallucination_rate = 0 AND unsourced_claims = 0 AND sensitivity >= 0.98
  AND under_calls = 0 AND failures = 0 AS passed FROM m""")
def _(v):
    return E.strict_gate(E.metrics(results(v), ["set_name"])).select("set_name", "passed")


_C = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


@query("e9_score_extraction", "line truth", _INHERITED + f"""
, rd AS (SELECT doc_id, line_no, kind, {_C.format('label')} AS c, dose,
   CASE WHEN kind = 'investigation' THEN CASE WHEN labv < lo THEN 'low' WHEN labv > hi THEN 'high'
     ELSE 'in_range' END END AS rf FROM inh WHERE kind <> 'procedure'),
tr AS (SELECT *, substr({_C.format('name')}, 1, CASE kind WHEN 'medication' THEN 6
   WHEN 'investigation' THEN 5 ELSE 12 END) AS key FROM truth),
mt AS (SELECT t.truth_id, arg_min(r.dose, r.line_no) AS gd, arg_min(r.rf, r.line_no) AS gf,
   count(*) AS n FROM tr t JOIN rd r ON r.doc_id = t.doc_id AND r.kind = t.kind
   AND contains(r.c, t.key) GROUP BY 1),
a AS (SELECT t.*, m.n IS NOT NULL AS f, coalesce({_C.format('t.dose')}, '')
    = coalesce({_C.format('m.gd')}, '') AS dk, t.flag IS NOT DISTINCT FROM m.gf AS fk
   FROM tr t LEFT JOIN mt m USING (truth_id)),
gg AS (SELECT doc_id, count(*) FILTER (kind = 'medication') AS m,
   count(*) FILTER (kind = 'medication' AND f) AS mf,
   count(*) FILTER (kind = 'medication' AND f AND dk) AS md,
   count(*) FILTER (kind = 'investigation') AS i, count(*) FILTER (kind = 'investigation' AND f)
   AS if, count(*) FILTER (kind = 'investigation' AND f AND fk) AS ig,
   count(*) FILTER (kind = 'diagnosis') AS d, count(*) FILTER (kind = 'diagnosis' AND f) AS df
   FROM a GROUP BY 1),
v AS (SELECT doc_id, round(count(*) FILTER (chk) / count(*), 4) AS vr FROM inh GROUP BY 1)
SELECT doc_id, CASE WHEN m > 0 THEN round(mf / m, 4) ELSE 1.0 END AS med_recall,
  CASE WHEN mf > 0 THEN round(md / mf, 4) WHEN m = 0 THEN 1.0 ELSE 0.0 END AS dose_accuracy,
  CASE WHEN i > 0 THEN round(if / i, 4) ELSE 1.0 END AS inv_recall,
  CASE WHEN if > 0 THEN round(ig / if, 4) WHEN i = 0 THEN 1.0 ELSE 0.0 END AS flag_accuracy,
  CASE WHEN d > 0 THEN round(df / d, 4) ELSE 1.0 END AS dx_recall, coalesce(vr, 0.0)
  AS verification_rate FROM gg LEFT JOIN v USING (doc_id)""")
def _(v):
    read = items(v).withColumn("position", F.col("line_no"))
    return E.score_extraction(v.truth, read)
