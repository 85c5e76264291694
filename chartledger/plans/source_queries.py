"""Queries over sources, snapshots, exchange documents and briefs."""

from pyspark.sql import functions as F

from chartledger.config.rules import ESCALATION_RULES
from chartledger.config.vocabulary import ALLERGY_FIELDS, SNAPSHOT_FIELDS
from chartledger.functions.values import value_text
from chartledger.operators import briefs as B
from chartledger.operators import ledger as L
from chartledger.operators import longitudinal as G
from chartledger.plans.bindings import Registry
from chartledger.plans.governance_queries import concepts
from chartledger.plans.longitudinal_queries import _STANDING, confirmed, efacts
from chartledger.sources import bundles as U
from chartledger.sources import documents as D
from chartledger.sources import records as S
from chartledger.streaming.jobs import work_folder

REG = Registry()
query = REG.add


@query("s1_read_table", "", """
SELECT o_orderkey, o_custkey, o_orderpriority FROM orders""")
def _(v):
    return S.read_table(v.spark, f"{v.sf_dir}/orders.parquet",
                        "o_orderkey bigint, o_custkey bigint, o_orderpriority string")


_RULES = ", ".join(
    f"('{r[0]}', '{r[1]}', '{c[0]}')" for r in ESCALATION_RULES for cl in r[3] for c in cl)


@query("s2_rules_in_use", "sfact", f"""
WITH r(rule_id, level, path) AS (VALUES {_RULES}),
p AS (SELECT path, count(*) AS n FROM sfact GROUP BY 1)
SELECT rule_id, level, r.path, CAST(n AS BIGINT) AS facts
FROM (SELECT DISTINCT * FROM r) r JOIN p USING (path)""")
def _(v):
    rules = S.rule_tables(v.spark)["escalation"].select("rule_id", "level", "path").distinct()
    counts = v.sfact.groupBy("path").agg(F.count("*").alias("facts"))
    return counts.join(F.broadcast(rules), "path")


_GOLD = """'{"id":"s' || CAST(event_id AS STRING) || '","title":"t","turns":[{"question_id":"q1",'
  || '"utterance":"it hurts","tap":' || CASE k % 3 WHEN 0 THEN 'null' WHEN 1 THEN '["a","b"]'
     ELSE 'true' END || '}],"expected":{"hpi.site":"chest","hpi.severity":' || CAST(k AS STRING)
  || ',"hpi.associated":["fever","x' || event_type || '"],"past_surgical.any":'
  || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || '},"expected_red_flags":["RF-1"]}'"""


def gold_text(v):
    return v.ev.select(F.expr(_GOLD).alias("value"))


@query("s3_gold_slots", "ev", """
SELECT 's' || CAST(event_id AS VARCHAR) AS script_id, u[1] AS path, u[2] AS kind, u[3] AS shown
FROM (SELECT event_id, unnest([('hpi.site', 'text', 'chest'),
  ('hpi.severity', 'number', CAST(k AS VARCHAR)),
  ('hpi.associated', 'list', 'fever, x' || event_type),
  ('past_surgical.any', 'bool', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END)]) AS u FROM ev)
""")
def _(v):
    slots = S.parse_gold(gold_text(v))["slot"]
    return slots.select("script_id", "path", F.col("value.kind").alias("kind"),
                        value_text(F.col("value")).alias("shown"))


@query("s3_gold_turns", "ev", """
SELECT 's' || CAST(event_id AS VARCHAR) AS script_id, 0 AS turn, 'q1' AS question_id,
  CASE k % 3 WHEN 1 THEN 'a, b' WHEN 2 THEN 'true' END AS tap, 0.92 AS asr_confidence FROM ev""")
def _(v):
    turns = S.parse_gold(gold_text(v))["turn"]
    return turns.select("script_id", "turn", "question_id",
                        value_text(F.col("tap")).alias("tap"), "asr_confidence")


@query("s5_load_code_systems", "part", r"""
SELECT 'C' || CAST(p_partkey AS VARCHAR) AS code, CASE WHEN p_partkey % 3 = 0 THEN '2019'
  ELSE '2024' END AS version, trim(regexp_replace(regexp_replace(lower(CASE p_partkey % 4
  WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || ' ' || p_type WHEN 2 THEN
  split_part(p_name, ' ', 1) ELSE p_name || ' (' || p_brand || ')' END), '[^a-z0-9_ ]+', ' ', 'g'),
  ' +', ' ', 'g')) AS display_normalized, sha256('body-2024') AS checksum
FROM part WHERE p_partkey % 3 <> 0""")
def _(v):
    rows = concepts(v)
    incoming = rows.select("url", "version").distinct().withColumns(
        {"name": F.lit("n"), "payload": F.concat(F.lit("body-"), "version")})
    existing = incoming.filter("version = '2019'").select("url", "version")
    systems, new = S.load_code_systems(existing, incoming, rows)
    return new.join(systems.select("url", "version", "checksum"), ["url", "version"]).select(
        "code", "version", "display_normalized", "checksum")


@query("s6_latest_snapshots", "ev", """
SELECT user_id AS encounter_id, arg_max('p' || CAST(event_id AS VARCHAR), ts) AS payload,
  true AS matches_current FROM ev GROUP BY 1""")
def _(v):
    rows = v.ev.select(F.col("user_id").alias("encounter_id"),
                       F.col("ts").alias("generated_at"),
                       F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("payload"))
    frozen = S.make_snapshots(rows, "clinician").unionByName(S.make_snapshots(rows, "patient"))
    return S.latest_snapshots(frozen, "clinician").select(
        "encounter_id", "payload", "matches_current")


def bundle_inputs(v):
    enc = v.encounter.join(v.patient.select("patient_id", "abha_ref"), "patient_id")
    key = lambda *c: F.concat_ws("-", *[F.col(x).cast("string") for x in c]).alias("key")
    meds = v.med.select("encounter_id", key("line_no", "name", "dose", "status", "observed_on"),
                        "name", "dose",
                        F.lit(None).cast("string").alias("frequency"),
                        F.lit(None).cast("string").alias("route"),
                        F.expr("CASE WHEN line_no = 1 THEN 'yes' END").alias("ongoing"))
    labs = v.obs.select(
        F.col("seq").alias("encounter_id"), key("seq"), "display", "value",
        F.lit("pending").alias("value_text"),
        F.expr("CASE WHEN unit = 'unit' THEN ' ' ELSE unit END").alias("unit"),
        F.lit(None).cast("double").alias("reference_low"), F.lit(50.0).alias("reference_high"))
    f = efacts(v)
    problems = f.filter("path = 'hpi.site'").select(
        "encounter_id", key("fact_id"), F.col("vs").alias("term"))
    flags = v.encounter.filter("priority <> 'routine'").select(
        "encounter_id", key("encounter_id"), F.col("priority").alias("level"),
        F.lit("raised").alias("label"))
    docs = v.encounter.filter("kind = 'document'").select(
        "encounter_id", key("encounter_id"),
        F.concat(F.lit("scan"), F.col("encounter_id").cast("string")).alias("filename"))
    backing = f.filter("path = 'hpi.site'").select(
        "encounter_id", F.lit("Condition").alias("target_type"), key("fact_id"),
        F.col("state").alias("tier"), F.col("vs").alias("verbatim"), F.lit("turn 1").alias("location"))
    return enc, problems, meds, labs, flags, docs, backing


def bundle_entries(v):
    return U.encounter_bundles(*bundle_inputs(v))


def _ref(*parts):
    return "'urn:sha:' || substr(sha256(" + " || '|' || ".join(parts) + "), 1, 32)"


_PREF = _ref("'patient'", "CAST(patient_id AS VARCHAR)")


_MEDICATIONS = f"""
SELECT encounter_id, '{{"resourceType":"MedicationStatement","status":"' || CASE WHEN line_no = 1
  THEN 'active' ELSE 'unknown' END || '","subject":{{"reference":"' || {_PREF} ||
  '"}},"medication":{{"text":"' || name || '"}},"dosage":{{"text":"' || dose || '"}}}}' AS resource
FROM med"""


@query("s7_medication_entries", "med", _MEDICATIONS)
def _(v):
    return bundle_entries(v).filter("resource_type = 'MedicationStatement'").select(
        "encounter_id", "resource")


_OBSERVATIONS = f"""
SELECT e.encounter_id, '{{"resourceType":"Observation","status":"final","subject":{{"reference":"'
  || {_PREF.replace('patient_id', 'e.patient_id')} || '"}},"code":{{"text":"' || display || '"}},'
  || CASE WHEN value IS NULL THEN '"valueString":"pending"' ELSE '"valueQuantity":{{"value":' ||
     CAST(value AS VARCHAR) || CASE WHEN unit = 'unit' THEN '' ELSE ',"unit":"' || unit || '"' END
     || '}}' END || ',"referenceRange":{{"high":{{"value":50.0' || CASE WHEN unit = 'unit' THEN ''
     ELSE ',"unit":"' || unit || '"' END || '}}}}}}' AS resource
FROM obs JOIN encounter e ON e.encounter_id = obs.seq"""


@query("s7_observation_entries", "obs encounter", _OBSERVATIONS)
def _(v):
    return bundle_entries(v).filter("resource_type = 'Observation'").select(
        "encounter_id", "resource")


_OWN = _PREF.replace("patient_id", "e.patient_id")


def _json(text):
    return f"to_json(CAST({text} AS VARCHAR))"


_SUBJECT = f"""'"subject":{{"reference":"' || {_OWN} || '"}}'"""
_CONDITION = _ref("'Condition'", "CAST(f.encounter_id AS VARCHAR)", "CAST(fact_id AS VARCHAR)")
_KIND_SQL = f"""
SELECT encounter_id, '{{"resourceType":"Composition","status":"preliminary",' || {_SUBJECT} ||
  ',"title":"Intake history","author":{{' || CASE WHEN confirmed_by IS NULL THEN '' ELSE
  '"display":' || {_json("confirmed_by")} END || '}}}}' AS resource FROM encounter e
UNION ALL SELECT encounter_id, '{{"resourceType":"Patient","active":true,"identifier":{{"value":"'
  || coalesce(abha_ref, 'unlinked') || '"}}}}' FROM encounter e JOIN patient USING (patient_id)
UNION ALL SELECT encounter_id, '{{"resourceType":"Consent","status":"active",' ||
  '"patient":{{"reference":"' || {_OWN} || '"}},"policyRule":{{"text":"' || consent_ref || '"}}}}' FROM encounter e
  WHERE consent_ref IS NOT NULL
UNION ALL SELECT e.encounter_id, '{{"resourceType":"Condition","verificationStatus":"unconfirmed",'
  || {_SUBJECT} || ',"code":{{"text":' || {_json("vs")} || '}}}}' FROM encounter e
  JOIN efact f ON f.encounter_id = e.encounter_id WHERE path = 'hpi.site'
UNION ALL SELECT encounter_id, '{{"resourceType":"Flag","status":"active",' || {_SUBJECT} ||
  ',"code":{{"text":"[' || upper(priority) || '] raised"}}}}' FROM encounter e
  WHERE priority <> 'routine'
UNION ALL SELECT encounter_id, '{{"resourceType":"DocumentReference","status":"current",' ||
  {_SUBJECT} || ',"description":"scan' || CAST(encounter_id AS VARCHAR) || '"}}' FROM encounter e
  WHERE kind = 'document'
UNION ALL SELECT f.encounter_id, '{{"resourceType":"Provenance","target":{{"reference":"' ||
  {_CONDITION} || '"}},"activity":{{"text":"' || state || '"}},"entity":{{"display":' ||
  {_json("vs || ' [turn 1]'")} || '}}}}' FROM efact f WHERE path = 'hpi.site'
UNION ALL """ + _MEDICATIONS + " UNION ALL " + _OBSERVATIONS


@query("s7_encounter_documents", "encounter patient efact med obs", f"""
WITH r AS ({_KIND_SQL})
SELECT encounter_id, resource, CAST(count(*) OVER (PARTITION BY encounter_id) AS BIGINT) AS entries
FROM r""")
def _(v):
    path = work_folder(v.spark, "s7")
    U.write_encounter_documents(U.entry_values(*bundle_inputs(v)), path)
    told = F.from_json("value", "identifier STRUCT<value: STRING>, "
                                "entry ARRAY<STRUCT<fullUrl: STRING, resource: STRING>>",
                       {"mode": "FAILFAST"})
    docs = D.read_documents(v.spark, path).select(told.alias("d"))
    return docs.select(
        F.col("d.identifier.value").cast("long").alias("encounter_id"),
        F.explode("d.entry").alias("e"),
        F.size("d.entry").cast("long").alias("entries")).select(
            "encounter_id", "e.resource", "entries")


@query("s7_resource_counts", "encounter efact med obs", """
SELECT encounter_id, t AS resource_type, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT encounter_id, unnest(['Composition', 'Patient']) AS t FROM encounter
  UNION ALL SELECT encounter_id, 'Consent' FROM encounter WHERE consent_ref IS NOT NULL
  UNION ALL SELECT encounter_id, unnest(['Condition', 'Provenance']) FROM efact
    WHERE path = 'hpi.site'
  UNION ALL SELECT encounter_id, 'MedicationStatement' FROM med
  UNION ALL SELECT e.encounter_id, 'Observation' FROM obs JOIN encounter e
    ON e.encounter_id = obs.seq
  UNION ALL SELECT encounter_id, 'Flag' FROM encounter WHERE priority <> 'routine'
  UNION ALL SELECT encounter_id, 'DocumentReference' FROM encounter WHERE kind = 'document')
GROUP BY 1, 2""")
def _(v):
    return U.resource_counts(bundle_entries(v))


@query("s8_export_gate", "encounter", """
SELECT encounter_id, CASE WHEN encounter_id % 2 = 1 OR confirmed_by IS NULL OR confirmed_by = ''
   THEN 'refused' WHEN consent_ref IS NULL OR encounter_id % 3 = 0 OR encounter_id % 5 = 0
   THEN 'not_shared' ELSE 'ready' END AS status FROM encounter""")
def _(v):
    consents = v.encounter.filter("consent_ref IS NOT NULL").select(
        "consent_ref",
        F.split(F.expr("CASE WHEN encounter_id % 3 = 0 THEN 'history' ELSE "
                       "'history|abdm_share' END"), r"\|").alias("granted"),
        F.expr("CASE WHEN encounter_id % 5 = 0 THEN occurred_on END").alias("revoked_on"),
        F.lit(None).cast("date").alias("expires_on"))
    state = L.consent_state(consents, F.expr("DATE '2010-01-01'"))
    decisions = v.encounter.filter("encounter_id % 2 = 0").select(
        "encounter_id", F.lit("confirmed_summary").alias("decision"))
    return U.export_gate(v.encounter, state, decisions)


def brief_inputs(v):
    fired = v.encounter.filter("priority <> 'routine'").select(
        "encounter_id", F.lit("RF-X").alias("rule_id"), F.col("priority").alias("level"))
    conflicts = v.encounter.filter("encounter_id % 4 = 0").select(
        "encounter_id", F.concat(F.lit("cx"), F.col("encounter_id").cast("string"))
        .alias("contradiction_ref"), F.lit("CX-MED-01").alias("rule_id"))
    decisions = v.encounter.filter("confirmed_by <> ''").select(
        "encounter_id", F.lit("confirmed_summary").alias("decision"),
        F.col("confirmed_by").alias("actor"))
    return fired, conflicts, decisions


def brief(v, facts=None):
    fired, conflicts, decisions = brief_inputs(v)
    facts = efacts(v) if facts is None else facts
    return B.encounter_briefs(G.latest_intakes(confirmed(v)), v.encounter, facts, v.evidence,
                              v.med, v.obs, fired, conflicts, decisions)


def written_facts(v):
    """The facts of the briefs, written out: four sections read them, and most facts belong to
    visits that no brief is about."""
    path = work_folder(v.spark, "g19-facts")
    facts = B.brief_facts(
        G.latest_intakes(confirmed(v)), v.encounter, efacts(v.dealt(lineitem="l_orderkey")))
    facts.write.parquet(path)
    return v.spark.read.schema(facts.schema).parquet(path)


_CUR = """
WITH cur AS (SELECT patient_id, arg_max(encounter_id, (occurred_on, encounter_id)) AS encounter_id
   FROM encounter WHERE kind = 'intake' AND confirmed_by <> '' GROUP BY 1)
"""


@query("g19_brief_sections", "encounter efact med obs", _CUR + """
SELECT patient_id, section, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT patient_id, 'unresolved' AS section FROM cur JOIN efact f USING (encounter_id)
    WHERE superseded_by IS NULL AND invalidated_reason IS NULL AND state = 'declined'
  UNION ALL SELECT patient_id, 'unresolved' FROM cur JOIN efact USING (encounter_id)
    WHERE superseded_by IS NOT NULL
  UNION ALL SELECT patient_id, 'unresolved' FROM cur JOIN efact USING (encounter_id)
    WHERE invalidated_reason IS NOT NULL
  UNION ALL SELECT patient_id, 'completeness' FROM cur CROSS JOIN range(14)
  UNION ALL SELECT patient_id, 'medications' FROM cur JOIN med USING (patient_id)
  UNION ALL SELECT DISTINCT patient_id, 'observations' || analyte_key FROM cur
    JOIN obs USING (patient_id) WHERE analyte_key IS NOT NULL AND value IS NOT NULL
  UNION ALL SELECT patient_id, 'timeline' FROM cur JOIN encounter e USING (patient_id)
  UNION ALL SELECT e.patient_id, 'red_flags' FROM cur JOIN encounter e USING (encounter_id)
    WHERE priority <> 'routine'
  UNION ALL SELECT patient_id, 'contradictions' FROM cur WHERE encounter_id % 4 = 0
  UNION ALL SELECT patient_id, 'confirmation' FROM cur) GROUP BY 1, 2""")
def _(v):
    rows = brief(v).filter("section NOT IN ('snapshot', 'what_changed')")
    name = F.when(F.col("section") == "observations", F.concat("section", "sort_key")).otherwise(
        F.col("section"))
    return rows.groupBy("patient_id", name.alias("section")).agg(F.count("*").alias("n"))


@query("g19_brief_lines", "encounter", _CUR + """
SELECT e.patient_id, 'red_flags' AS section, '{"rule_id":"RF-X","level":"' || priority || '"}'
  AS item FROM cur JOIN encounter e USING (encounter_id) WHERE priority <> 'routine'
UNION ALL SELECT e.patient_id, 'confirmation', '{"decision":"confirmed_summary","actor":"'
  || e.confirmed_by || '"}' FROM cur JOIN encounter e USING (encounter_id)""")
def _(v):
    return brief(v).filter("section IN ('red_flags', 'confirmation')").select(
        "patient_id", "section", "item")


@query("g19_brief_documents", "encounter", _CUR + """
SELECT e.encounter_id, 'red_flags' AS section, '{"rule_id":"RF-X","level":"' || priority || '"}'
  AS item FROM cur JOIN encounter e USING (encounter_id) WHERE priority <> 'routine'
UNION ALL SELECT encounter_id, 'confirmation', '{"decision":"confirmed_summary","actor":"'
  || e.confirmed_by || '"}' FROM cur JOIN encounter e USING (encounter_id)
UNION ALL SELECT encounter_id, 'contradictions', '{"contradiction_ref":"cx' ||
  CAST(encounter_id AS VARCHAR) || '","rule_id":"CX-MED-01"}' FROM cur WHERE encounter_id % 4 = 0
UNION ALL SELECT cur.encounter_id, 'timeline', '{"visit_id":' || CAST(e.encounter_id AS VARCHAR)
  || ',"occurred_on":"' || CAST(e.occurred_on AS VARCHAR) || '",' || CASE WHEN headline IS NULL
  THEN '' ELSE '"headline":"' || headline || '",' END || '"priority":"' || priority ||
  '","is_current":' || CAST(e.encounter_id = cur.encounter_id AS VARCHAR) || '}'
  FROM cur JOIN encounter e USING (patient_id)""")
def _(v):
    path = work_folder(v.spark, "g19")
    D.write_documents(B.brief_fragments(brief(v, written_facts(v))), path)
    lists = ", ".join(f"{s} ARRAY<STRING>" for s in B.SECTIONS)
    told = F.from_json("value", f"encounter_id BIGINT, {lists}", {"mode": "FAILFAST"}).alias("d")
    sections = F.explode(F.create_map(*[
        x for s in ("red_flags", "confirmation", "contradictions", "timeline")
        for x in (F.lit(s), F.col(f"d.{s}"))])).alias("section", "items")
    docs = D.read_documents(v.spark, path).select(told)
    return docs.select("d.encounter_id", sections).select(
        "encounter_id", "section", F.explode("items").alias("item"))


_PLAIN = ", ".join(f"('{f[0]}', '{f[2]}')" for f in SNAPSHOT_FIELDS + ALLERGY_FIELDS)


@query("g20_patient_view", "encounter efact evidence med obs", _STANDING + f"""
, pl(path, plain) AS (VALUES {_PLAIN}),
cur AS (SELECT patient_id, arg_max(encounter_id, (occurred_on, encounter_id)) AS encounter_id
   FROM encounter WHERE kind = 'intake' GROUP BY 1),
l AS (SELECT cur.patient_id, plain AS label, CASE WHEN st.fact_id % 3 = 0 THEN 'shown ' || f.vs
     ELSE replace(f.vs, '|', ', ') END AS value, f.confirmed_by_physician AS ok,
   EXISTS (SELECT 1 FROM evidence e WHERE e.fact_id = st.fact_id AND source_type = 'document') AS doc
  FROM cur JOIN st ON st.encounter_id = cur.encounter_id JOIN pl USING (path)
  JOIN efact f ON f.fact_id = st.fact_id WHERE st.state <> 'not_asked'
   AND EXISTS (SELECT 1 FROM evidence e WHERE e.fact_id = st.fact_id)),
t AS (SELECT patient_id, analyte_key, count(*) AS n, count(DISTINCT unit) AS u,
   arg_min(value, (coalesce(observed_on, DATE '0001-01-01'), seq)) AS f,
   arg_max(value, (coalesce(observed_on, DATE '0001-01-01'), seq)) AS la FROM obs
   WHERE analyte_key IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2)
SELECT patient_id, CASE WHEN doc THEN 'from_documents' ELSE 'told_us' END AS "group", label, value
FROM l
UNION ALL SELECT patient_id, 'awaiting', label, value FROM l WHERE NOT ok
UNION ALL SELECT DISTINCT m.patient_id, 'previous', 'Medicine from an earlier visit',
  name || ' ' || dose FROM med m LEFT JOIN cur ON cur.patient_id = m.patient_id
  WHERE cur.encounter_id IS NULL OR m.encounter_id <> cur.encounter_id
UNION ALL SELECT patient_id, 'previous', analyte_key || ' over time',
  CAST(f AS VARCHAR) || ', then ' || CAST(la AS VARCHAR) FROM t WHERE n >= 2 AND u <= 1""")
def _(v):
    current = G.latest_intakes(v.encounter)
    held = efacts(v).join(current.select("encounter_id"), "encounter_id", "left_semi")
    snap = G.current_snapshot(held, v.evidence).join(current, "encounter_id")
    return B.patient_view(snap, G.medication_list(v.med, current), G.observation_trend(v.obs))
