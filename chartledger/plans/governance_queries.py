"""Queries over audit, retention and terminology."""

from pyspark.sql import functions as F

from chartledger.functions.text import fold_term, normalise_term
from chartledger.operators import governance as A
from chartledger.operators import terms as T
from chartledger.operators.predicates import assessment_fields
from chartledger.plans.bindings import Registry
from chartledger.streaming.jobs import work_folder

REG = Registry()
query = REG.add

SEGMENT = 64
GENESIS = "0" * 64


def audit_rows(v):
    return v.audit.withColumn("payload", F.concat_ws("|", "actor", "action", "detail"))


def tampered(v):
    """Sealed rows, some with their action edited and some removed afterwards."""
    sealed = A.seal_rows(audit_rows(v), [], SEGMENT)
    edited = F.when(F.expr("id % 997 = 500"), F.concat_ws("|", "actor", F.lit("edited"), "detail"))
    return sealed.filter("id % 1499 <> 700").withColumn(
        "payload", F.coalesce(edited, F.col("payload")))


_SEALED = f"""
WITH RECURSIVE pay AS (SELECT id, CAST(floor(id / {SEGMENT}) AS BIGINT) AS segment,
   actor || '|' || action || '|' || detail AS payload, actor || '|edited|' || detail AS edited
   FROM audit),
num AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY id) AS n FROM pay),
sealed AS (
  SELECT segment, n, id, '{GENESIS}' AS prev_hash, sha256('{GENESIS}' || payload) AS hash
  FROM num WHERE n = 1
  UNION ALL SELECT m.segment, m.n, m.id, s.hash, sha256(s.hash || m.payload)
  FROM sealed s JOIN num m ON m.segment = s.segment AND m.n = s.n + 1),
kept AS (SELECT s.*, CASE WHEN s.id % 997 = 500 THEN p.edited ELSE p.payload END AS payload
  FROM sealed s JOIN pay p USING (id) WHERE s.id % 1499 <> 700),
chk AS (SELECT *, lag(hash) OVER w AS before, row_number() OVER w - 1 AS pos FROM kept
  WINDOW w AS (PARTITION BY segment ORDER BY id)),
bad AS (SELECT *, CASE WHEN prev_hash <> coalesce(before, '{GENESIS}') THEN 'link'
     WHEN sha256(coalesce(before, '{GENESIS}') || payload) <> hash THEN 'content' END AS kind
  FROM chk)
"""


@query("a1_verify_chain", "audit", _SEALED + """
SELECT segment, count(kind) = 0 AS intact,
  CAST(coalesce(min(CASE WHEN kind IS NOT NULL THEN pos END), count(*)) AS BIGINT) AS checked,
  CAST(min(CASE WHEN kind IS NOT NULL THEN pos END) AS BIGINT) AS first_broken_index,
  min(CASE WHEN kind IS NOT NULL THEN id END) AS first_broken_id,
  arg_min(kind, CASE WHEN kind IS NOT NULL THEN id END) AS broken_kind FROM bad GROUP BY 1""")
def _(v):
    return A.verify_chain(tampered(v), ["segment"])


@query("a1_global_links", "audit", f"""
WITH r AS (SELECT id, CASE WHEN id % 2500 = 1250 THEN 'x' ELSE coalesce('h' || CAST(lag(id) OVER
   (ORDER BY id) AS VARCHAR), '{GENESIS}') END AS p, coalesce('h' || CAST(lag(id) OVER
   (ORDER BY id) AS VARCHAR), '{GENESIS}') AS b FROM audit)
SELECT false AS intact, CAST(0 AS BIGINT) AS checked, CAST(0 AS BIGINT) AS first_broken_index,
  min(id) AS first_broken_id, 'content' AS broken_kind FROM r""")
def _(v):
    # One chain over the whole table; its content was never sealed, so row 0 breaks it.
    named = F.concat(F.lit("h"), F.col("id").cast("string"))
    before = F.when(F.col("id") > 0, F.concat(F.lit("h"), (F.col("id") - 1).cast("string")))
    rows = audit_rows(v).withColumns(
        {"hash": named, "prev_hash": F.coalesce(before, F.lit(GENESIS))})
    return A.verify_chain(rows, id_chunk=1000)


@query("a2_seal_rows", "audit", _SEALED + """
SELECT segment, id, prev_hash, hash FROM sealed""")
def _(v):
    return A.seal_rows(audit_rows(v), [], SEGMENT).select("segment", "id", "prev_hash", "hash")


# The same ids in two chains, a third of the rows without a key.
@query("a2_seal_repeated_ids", "audit", f"""
WITH RECURSIVE pay AS (
  SELECT x.chain, id, CAST(floor(id / {SEGMENT}) AS BIGINT) AS segment,
     coalesce(x.chain, '') || actor || '|' || action AS payload
  FROM audit, (VALUES ('one'), ('two'), (NULL)) x(chain)),
num AS (SELECT *, row_number() OVER (PARTITION BY chain, segment ORDER BY id) AS n FROM pay),
sealed AS (
  SELECT chain, segment, n, id, '{GENESIS}' AS prev_hash, sha256('{GENESIS}' || payload) AS hash
  FROM num WHERE n = 1
  UNION ALL SELECT m.chain, m.segment, m.n, m.id, s.hash, sha256(s.hash || m.payload)
  FROM sealed s JOIN num m ON m.chain IS NOT DISTINCT FROM s.chain AND m.segment = s.segment
     AND m.n = s.n + 1)
SELECT chain, segment, id, prev_hash, hash FROM sealed""")
def _(v):
    rows = v.audit.select("id", "actor", "action", F.explode(F.expr(
        "array('one', 'two', CAST(NULL AS STRING))")).alias("chain"))
    rows = rows.select("chain", "id", F.concat(
        F.coalesce("chain", F.lit("")), "actor", F.lit("|"), "action").alias("payload"))
    return A.seal_rows(rows, ["chain"], SEGMENT).select(
        "chain", "segment", "id", "prev_hash", "hash")


# Three rows of an id in a chain, chains without a key, each gone on from half-way.
@query("a2_extend_chain", "audit", f"""
WITH RECURSIVE pay AS (
  SELECT x.chain, CAST(floor(id / {SEGMENT}) AS BIGINT) AS run, id,
    CASE WHEN x.copy = 2 THEN NULL ELSE actor || x.copy END AS payload
  FROM audit, (VALUES ('one', 0), ('one', 1), ('one', 2), (NULL, 0)) x(chain, copy)),
num AS (SELECT *, row_number() OVER (PARTITION BY chain, run ORDER BY id,
   payload NULLS FIRST) AS n FROM pay),
sealed AS (
  SELECT chain, run, n, id, '{GENESIS}' AS prev_hash,
    sha256('{GENESIS}' || coalesce(payload, '')) AS hash FROM num WHERE n = 1
  UNION ALL SELECT m.chain, m.run, m.n, m.id, s.hash, sha256(s.hash || coalesce(m.payload, ''))
  FROM sealed s JOIN num m ON m.chain IS NOT DISTINCT FROM s.chain AND m.run = s.run
    AND m.n = s.n + 1)
SELECT chain, run, id, prev_hash, hash FROM sealed""")
def _(v):
    copies = F.explode(F.expr(
        "array(struct('one' AS chain, 0 AS copy), struct('one' AS chain, 1 AS copy), "
        "struct('one' AS chain, 2 AS copy), struct(CAST(NULL AS STRING) AS chain, 0 AS copy))"))
    rows = v.audit.select("id", "actor", copies.alias("c")).select(
        "c.chain", F.expr(f"id div {SEGMENT}").alias("run"), "id",
        F.when(F.col("c.copy") < 2, F.concat("actor", F.col("c.copy").cast("string"))).alias(
            "payload"))
    half = F.expr(f"id % {SEGMENT} < {SEGMENT // 2}")
    keys = ["chain", "run"]
    early = A.seal_rows(rows.filter(half), keys, None)
    late = A.seal_rows(rows.filter(~half), keys, None, A.chain_tails(early, keys))
    return early.unionByName(late).select("chain", "run", "id", "prev_hash", "hash")


# Ids far apart, as hashes or times are: chunks come from the data. One row is changed.
@query("a1_sparse_ids", "audit", """
WITH n AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(max(id) // 2 AS BIGINT) AS middle FROM audit)
SELECT 'whole' AS chain, true AS intact, n AS checked FROM n
UNION ALL SELECT 'changed', false, middle FROM n""")
def _(v):
    step = 1_000_000_007_000
    rows = audit_rows(v).select((F.col("id") * step).alias("id"), "payload")
    path = work_folder(v.spark, "a1")
    A.seal_rows(rows, [], None).write.parquet(path)
    # One task links the chain; what reads it reads its file in parts, side by side.
    sealed = v.spark.read.parquet(path)
    middle = v.audit.agg(F.expr("max(id) div 2")).first()[0] * step
    changed = sealed.withColumn("payload", F.when(
        F.col("id") == middle, "changed").otherwise(F.col("payload")))
    return A.verify_chain(sealed).select(F.lit("whole").alias("chain"), "intact", "checked").union(
        A.verify_chain(changed).select(F.lit("changed"), "intact", "checked"))


_DIGESTS = """
WITH d AS (SELECT consent_ref, CAST(floor(id / 1000) AS BIGINT) AS segment, id,
   sha256(actor || '|' || action || '|' || detail) AS h,
   CASE WHEN id % 97 = 5 THEN sha256('x') ELSE sha256(actor || '|' || action || '|' || detail) END
     AS h2 FROM audit WHERE consent_ref IS NOT NULL)
"""


@query("a2_segment_digests", "audit", _DIGESTS + """
SELECT consent_ref, segment, CAST(count(*) AS BIGINT) AS "rows",
  sha256(string_agg(h, '' ORDER BY id)) AS digest FROM d GROUP BY 1, 2""")
def _(v):
    rows = audit_rows(v).filter("consent_ref IS NOT NULL")
    return A.segment_digests(rows, ["consent_ref"])


@query("a2_verify_segments", "audit", _DIGESTS + """
SELECT consent_ref, segment, CASE WHEN count(*) FILTER (id % 89 <> 7) = 0 THEN 'missing'
   WHEN sha256(string_agg(h, '' ORDER BY id)) <> sha256(string_agg(h2, '' ORDER BY id)
        FILTER (id % 89 <> 7)) THEN 'changed' ELSE 'ok' END AS status FROM d GROUP BY 1, 2""")
def _(v):
    rows = audit_rows(v).filter("consent_ref IS NOT NULL")
    later = rows.filter("id % 89 <> 7").withColumn(
        "payload", F.expr("CASE WHEN id % 97 = 5 THEN 'x' ELSE payload END"))
    return A.verify_segments(A.segment_digests(rows, ["consent_ref"]), later, ["consent_ref"])


@query("a3_scrub_audit", "audit", """
SELECT id, '{"actor":"' || actor || '","value":"<redacted>","inner":{"text":"<redacted>","k":"'
  || detail || '"},"tags":"<2 item(s)>"}' AS payload FROM audit""")
def _(v):
    rows = v.audit.select("id", F.struct(
        "actor", F.col("detail").alias("value"),
        F.struct(F.col("action").alias("text"), F.col("detail").alias("k")).alias("inner"),
        F.array("action", "actor").alias("tags")).alias("payload"))
    return A.scrub_audit(rows, ["payload"]).select("id", F.to_json("payload").alias("payload"))


# Stored payloads are JSON texts: keys and lists at every depth.
@query("a3_scrub_json", "audit", """
SELECT id, CASE id % 5
  WHEN 0 THEN '{"actor":"' || actor || '","inner":{"deep":{"k":"' || detail
    || '","text":"<redacted>"},"list":"<2 item(s)>"},"name":"<redacted>","tags":"<3 item(s)>"}'
  WHEN 1 THEN '{"n":1.5,"none":null,"ok":true,"summary":"<redacted>"}'
  WHEN 2 THEN '"<redacted>"' WHEN 3 THEN '"<1 item(s)>"' END AS payload FROM audit""")
def _(v):
    rows = v.audit.select("id", F.expr("""CASE id % 5
        WHEN 0 THEN '{"tags": [1, {"name": 2}, []], "name": {"a": 1}, "actor": "' || actor
          || '", "inner": {"list": ["x", "y"], "deep": {"text": "t", "k": "' || detail || '"}}}'
        WHEN 1 THEN '{"summary": [1], "ok": true, "n": 1.5, "none": null}'
        WHEN 2 THEN 'no json: ' || detail WHEN 3 THEN '[{"text": 1}]' END""").alias("payload"))
    return A.scrub_audit(rows, ["payload"])


@query("a4_audit_trail", "encounter audit", """
SELECT encounter_id, id, actor, action FROM encounter e JOIN audit a
ON a.consent_ref = e.consent_ref WHERE e.consent_ref IS NOT NULL""")
def _(v):
    return A.audit_trail(v.encounter, v.audit).select("encounter_id", "id", "actor", "action")


_PROV = """
WITH f AS (SELECT f.*, EXISTS (SELECT 1 FROM evidence e WHERE e.fact_id = f.fact_id) AS e
   FROM efact f),
p AS (SELECT encounter_id, count(*) AS n, count(*) FILTER (e) AS w,
   count(*) FILTER (NOT e AND state NOT IN ('declined', 'unknown', 'not_asked')) AS o
   FROM f GROUP BY 1)
"""


@query("a5_provenance_completeness", "efact evidence", _PROV + """
SELECT encounter_id, CAST(n AS BIGINT) AS total_facts, CAST(w AS BIGINT) AS with_evidence,
  CAST(o AS BIGINT) AS offenders, CAST(n - w - o AS BIGINT) AS with_absence, o = 0 AS complete
FROM p""")
def _(v):
    return A.provenance_completeness(v.efact, v.evidence)


@query("a5_unsourced_facts", "efact evidence", _PROV + """
SELECT encounter_id, fact_id, path, state FROM f
WHERE NOT e AND state NOT IN ('declined', 'unknown', 'not_asked')""")
def _(v):
    return A.unsourced_facts(v.efact, v.evidence)


@query("a6_encounter_review", "encounter audit efact evidence", _PROV + """
, t AS (SELECT encounter_id, count(*) AS n FROM encounter e JOIN audit a
   ON a.consent_ref = e.consent_ref GROUP BY 1)
SELECT e.encounter_id, e.confirmed_by, e.consent_ref, CAST(coalesce(t.n, 0) AS BIGINT)
   AS trail_events, CAST(coalesce(p.n, 0) AS BIGINT) AS total_facts,
   CAST(coalesce(w, 0) AS BIGINT) AS with_evidence, CAST(coalesce(o, 0) AS BIGINT) AS offenders,
   CAST(coalesce(p.n - w - o, 0) AS BIGINT) AS with_absence, coalesce(o, 0) = 0 AS complete,
   CAST(CASE WHEN e.encounter_id % 17 = 0 THEN 1 ELSE 0 END AS BIGINT) AS assessment_hits,
   e.encounter_id % 17 <> 0 AS clean
FROM encounter e LEFT JOIN t USING (encounter_id) LEFT JOIN p USING (encounter_id)""")
def _(v):
    notes = v.encounter.select("encounter_id", F.expr(
        "CASE WHEN encounter_id % 17 = 0 THEN '{\"a\":{\"Plan\":1}}' ELSE '{\"a\":\"plan\"}' END"
    ).alias("j"))
    hits = assessment_fields(notes, "j", ["encounter_id"])
    return A.encounter_review(v.encounter, v.audit, v.efact, v.evidence, hits)


@query("a7_expired_sessions", "session encounter efact med", """
SELECT session_ref, CAST((SELECT count(*) FROM efact f WHERE 's' || CAST(f.encounter_id AS VARCHAR)
   = session_ref) AS BIGINT) AS facts, CAST((SELECT count(*) FROM med m WHERE 's' ||
   CAST(m.encounter_id AS VARCHAR) = session_ref) AS BIGINT) AS documents
FROM session WHERE purged_on IS NULL AND expires_on IS NOT NULL
  AND expires_on < DATE '1999-01-01'""")
def _(v):
    ref = F.expr("'s' || CAST(encounter_id AS STRING)").alias("session_ref")
    s = v.session.withColumnsRenamed({"purged_on": "purged_at", "expires_on": "expires_at"})
    return A.expired_sessions(s, F.expr("DATE '1999-01-01'"), {
        "facts": v.efact.select(ref), "documents": v.med.select(ref)})


@query("a8_guest_sweep", "patient encounter efact session", """
SELECT p.patient_id, p.patient_ref, CAST(count(e.encounter_id) AS BIGINT) AS encounter,
  CAST(coalesce(sum((SELECT count(*) FROM efact f WHERE f.encounter_id = e.encounter_id)), 0)
    AS BIGINT) AS fact, CAST(count(e.session_ref) AS BIGINT) AS consent_record
FROM patient p LEFT JOIN encounter e ON e.patient_id = p.patient_id
WHERE is_synthetic AND patient_ref LIKE 'pat\\_guest\\_%' ESCAPE '\\'
  AND created_on < DATE '2021-01-01' GROUP BY 1, 2""")
def _(v):
    people = v.patient.withColumnRenamed("created_on", "created_at")
    plan, _swept = A.guest_sweep(
        people, v.encounter, F.expr("DATE '2021-01-01'"),
        {"consent_record": v.session}, {"fact": v.efact})
    return plan


@query("a8_session_residue", "patient encounter session", """
SELECT name AS "table", CAST(count(r) AS BIGINT) AS "rows" FROM (
  SELECT 'consent_record' AS name, NULL AS r UNION ALL SELECT 'intake_session', s.session_ref
  FROM session s JOIN encounter e ON e.session_ref = s.session_ref
  JOIN patient p ON p.patient_id = e.patient_id WHERE is_synthetic
    AND starts_with(patient_ref, 'pat_guest_') AND p.created_on < DATE '2021-01-01'
    AND e.encounter_id % 4 = 0) GROUP BY 1""")
def _(v):
    people = v.patient.withColumnRenamed("created_on", "created_at")
    _plan, swept = A.guest_sweep(
        people, v.encounter, F.expr("DATE '2021-01-01'"), {"consent_record": v.session}, {})
    # One table was cleared properly, the other kept a quarter of its rows.
    clean = v.session.join(swept, "session_ref", "left_anti")
    messy = clean.unionByName(v.session.join(swept, "session_ref", "left_semi")
                              .filter("CAST(substr(session_ref, 2) AS BIGINT) % 4 = 0"))
    return A.session_residue({"consent_record": clean, "intake_session": messy}, swept)


@query("a9_orphan_report", "session encounter", """
SELECT 'consent_record' AS "table", CAST(count(*) AS BIGINT) AS orphans FROM session s
WHERE NOT EXISTS (SELECT 1 FROM session l WHERE l.session_ref = s.session_ref
     AND l.purged_on IS NULL)
  AND NOT EXISTS (SELECT 1 FROM encounter e WHERE e.session_ref = s.session_ref
     AND e.kind = 'intake' AND e.confirmed_by <> '')""")
def _(v):
    return A.orphan_report({"consent_record": v.session}, v.session.filter("purged_on IS NULL"),
                           v.encounter.filter("kind = 'intake' AND confirmed_by <> ''"))


@query("a10_record_shape", "patient encounter efact evidence med obs", """
WITH e AS (SELECT patient_id, count(*) AS n FROM encounter GROUP BY 1),
f AS (SELECT patient_id, count(*) AS n FROM efact JOIN encounter USING (encounter_id) GROUP BY 1),
v AS (SELECT patient_id, count(*) AS n FROM evidence JOIN efact USING (fact_id)
   JOIN encounter USING (encounter_id) GROUP BY 1),
m AS (SELECT patient_id, count(*) AS n FROM med GROUP BY 1),
o AS (SELECT patient_id, count(*) AS n FROM obs GROUP BY 1)
SELECT patient_id, CAST(coalesce(e.n, 0) AS BIGINT) AS encounters,
  CAST(coalesce(f.n, 0) AS BIGINT) AS facts, CAST(coalesce(v.n, 0) AS BIGINT) AS evidence,
  CAST(coalesce(m.n, 0) AS BIGINT) AS medications, CAST(coalesce(o.n, 0) AS BIGINT) AS observations
FROM patient LEFT JOIN e USING (patient_id) LEFT JOIN f USING (patient_id)
LEFT JOIN v USING (patient_id) LEFT JOIN m USING (patient_id) LEFT JOIN o USING (patient_id)""")
def _(v):
    return A.record_shape(v.patient, v.encounter, v.efact, v.evidence, v.med, v.obs)


@query("a10_shape_difference", "encounter", """
WITH b AS (SELECT patient_id, count(*) AS n FROM encounter GROUP BY 1),
a AS (SELECT patient_id, count(*) AS n FROM encounter WHERE encounter_id % 50 <> 7 GROUP BY 1)
SELECT b.patient_id, CAST(b.n AS BIGINT) AS n, 'before' AS side FROM b LEFT JOIN a USING (patient_id)
WHERE a.n IS NULL OR a.n <> b.n
UNION ALL SELECT a.patient_id, CAST(a.n AS BIGINT), 'after' FROM a JOIN b USING (patient_id)
WHERE a.n <> b.n""")
def _(v):
    shape = lambda rows: rows.groupBy("patient_id").agg(F.count("*").alias("n"))
    return A.shape_difference(shape(v.encounter), shape(v.encounter.filter(
        "encounter_id % 50 <> 7"))).select("patient_id", "n", "side")


@query("a7_purge", "session", """
SELECT session_ref FROM session WHERE patient_id % 5 <> 0""")
def _(v):
    return A.purge(v.session, v.session.filter("patient_id % 5 = 0")).select("session_ref")


# ---- terminology: one system in two versions, concepts from the part table

_CONCEPT = """
WITH concept AS (SELECT p_partkey AS concept_id, 'C' || CAST(p_partkey AS VARCHAR) AS code,
   CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || ' ' || p_type
     WHEN 2 THEN split_part(p_name, ' ', 1) ELSE p_name || ' (' || p_brand || ')' END AS display,
   CASE WHEN p_partkey % 9 = 0 THEN 'block' ELSE 'category' END AS class_kind,
   p_partkey % 10 <> 1 AS is_selectable,
   CASE WHEN p_partkey % 3 = 0 THEN '2019' ELSE '2024' END AS version FROM part),
cur AS (SELECT *, trim(regexp_replace(regexp_replace(lower(display), '[^a-z0-9_ ]+', ' ', 'g'),
   ' +', ' ', 'g')) AS n FROM concept WHERE version = '2024'),
term AS (SELECT p_partkey AS term_id, CASE p_partkey % 5 WHEN 0 THEN p_name || ' of ' || p_type
   WHEN 1 THEN initcap_w WHEN 2 THEN substr(p_name, 2, 5) WHEN 3 THEN 'ab' ELSE p_brand END AS term
   FROM (SELECT *, upper(p_name) AS initcap_w FROM part)),
key AS (SELECT *, trim(regexp_replace(regexp_replace(lower(term), '[^a-z0-9_ ]+', ' ', 'g'),
   ' +', ' ', 'g')) AS k FROM term),
hit AS (SELECT k, concept_id, code, CASE WHEN n = k THEN 0 WHEN contains(n, k) THEN 1 ELSE 2 END
   AS rank FROM (SELECT DISTINCT k FROM key WHERE length(k) >= 3)
   JOIN cur ON contains(n, k) OR contains(k, n)),
best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank, concept_id) AS pos FROM hit)
"""


def concepts(v):
    return v.part.selectExpr(
        "p_partkey AS concept_id", "'C' || CAST(p_partkey AS STRING) AS code",
        "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || ' ' || p_type "
        "WHEN 2 THEN split_part(p_name, ' ', 1) ELSE p_name || ' (' || p_brand || ')' END "
        "AS display",
        "CASE WHEN p_partkey % 9 = 0 THEN 'block' ELSE 'category' END AS class_kind",
        "p_partkey % 10 <> 1 AS is_selectable",
        "CASE WHEN p_retailprice < 0 THEN 'none' ELSE 'sys' END AS url",
        "CASE WHEN p_partkey % 3 = 0 THEN '2019' ELSE '2024' END AS version")


def systems(v):
    return concepts(v).select("url", "version").distinct().withColumns({
        "is_active": F.lit(True),
        "created_on": F.expr("make_date(CAST(version AS INT), 1, 1)")})


def term_rows(v):
    return v.part.selectExpr(
        "p_partkey AS term_id", "CASE p_partkey % 5 WHEN 0 THEN p_name || ' of ' || p_type "
        "WHEN 1 THEN upper(p_name) WHEN 2 THEN substr(p_name, 2, 5) WHEN 3 THEN 'ab' "
        "ELSE p_brand END AS term")


@query("t1_normalise_term", "documents", r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(strip_accents(
   lower(text))), '\p{M}+', '', 'g'), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g')))
   AS normal FROM documents""")
def _(v):
    return v.documents.select("doc_id", F.md5(normalise_term(F.col("text"))).alias("normal"))


@query("t1_folded_forms", "part", r"""
SELECT p_partkey, trim(regexp_replace(lower('strasse ffi hfi ' || p_name || ' ' || p_type),
   '[^a-z0-9]+', ' ', 'g')) AS normal FROM part""")
def _(v):
    full = "".join(chr(0xFF41 + i) for i in range(26))
    plain = "".join(chr(97 + i) for i in range(26))
    accented = F.regexp_replace(F.translate(F.upper("p_type"), "AEIOU", "ẤÊĬÕỰ"), "S", "S\u0301")
    shown = F.concat(F.lit("Straße ﬃ hﬁ--"), F.translate("p_name", plain, full), F.lit(" • "),
                     accented)
    return v.part.select("p_partkey", fold_term(shown).alias("normal"))


@query("t2_lookup_terms", "part", _CONCEPT + """
SELECT k AS term_key, concept_id, code, rank, CAST(pos AS INT) AS position FROM best
WHERE pos <= 5""")
def _(v):
    known = T.active_concepts(systems(v), concepts(v), "sys")
    return T.lookup_terms(term_rows(v), known).select(
        "term_key", "concept_id", "code", "rank", "position")


@query("t3_code_terms", "part", _CONCEPT + """
, c AS (SELECT k, count(*) AS n, arg_min(concept_id, pos) AS concept_id, min(rank) AS rank
   FROM best GROUP BY 1)
SELECT term_id, CASE WHEN c.n IS NULL THEN 'unmapped' WHEN c.rank > 0 THEN 'near_matches'
   WHEN class_kind <> 'category' OR NOT is_selectable THEN 'not_emittable' ELSE 'coded' END
   AS outcome, CASE WHEN c.rank = 0 AND class_kind = 'category' AND is_selectable THEN code END
   AS code, CAST(coalesce(c.n, 0) AS BIGINT) AS candidates
FROM key LEFT JOIN c USING (k) LEFT JOIN cur ON cur.concept_id = c.concept_id""")
def _(v):
    known = T.active_concepts(systems(v), concepts(v), "sys")
    return T.code_terms(term_rows(v), known).select("term_id", "outcome", "code", "candidates")


@query("t4_verify_codes", "part", _CONCEPT + """
, ask AS (SELECT p_partkey AS ask_id, CASE WHEN p_partkey % 8 = 7 THEN 'other' ELSE 'sys' END AS url,
   CASE p_partkey % 5 WHEN 0 THEN '2019' WHEN 1 THEN '2030' END AS version,
   CASE WHEN p_partkey % 6 = 5 THEN 'X' ELSE 'C' END || CAST(p_partkey AS VARCHAR) AS code
   FROM part)
SELECT ask_id, CASE WHEN url = 'other' THEN 'unknown_system'
  WHEN a.version = '2030' THEN 'version_not_loaded' WHEN c.code IS NULL THEN 'unknown_code'
  WHEN class_kind <> 'category' OR NOT is_selectable THEN 'not_selectable' ELSE 'ok' END AS status
FROM ask a LEFT JOIN concept c ON c.code = a.code AND c.version = coalesce(a.version, '2024')""")
def _(v):
    ask = v.part.selectExpr(
        "p_partkey AS ask_id", "CASE WHEN p_partkey % 8 = 7 THEN 'other' ELSE 'sys' END AS url",
        "CASE p_partkey % 5 WHEN 0 THEN '2019' WHEN 1 THEN '2030' END AS version",
        "CASE WHEN p_partkey % 6 = 5 THEN 'X' ELSE 'C' END || CAST(p_partkey AS STRING) AS code")
    return T.verify_codes(ask, systems(v), concepts(v)).select("ask_id", "status")
