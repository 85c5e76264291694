"""Queries over one patient's history."""

from pyspark.sql import functions as F

from chartledger.config.vocabulary import ALLERGY_FIELDS, SNAPSHOT_FIELDS
from chartledger.functions.values import make_value
from chartledger.operators import longitudinal as G
from chartledger.operators.ledger import active_facts
from chartledger.plans.bindings import Registry
from chartledger.plans.ledger_queries import facts as session_facts
from chartledger.plans.rule_queries import _WIDE, proposals

REG = Registry()
query = REG.add


def efacts(v):
    return v.efact.withColumn("value", make_value(F.col("vkind"), F.col("vs"))).withColumn(
        "display_value", F.expr("CASE WHEN fact_id % 3 = 0 THEN 'shown ' || vs END"))


def confirmed(v):
    return v.encounter.filter("kind = 'intake' AND confirmed_by <> ''")


DOCS = """documents_of AS (SELECT encounter_id, CASE encounter_id % 4 WHEN 0 THEN 'prescription'
   WHEN 1 THEN 'lab_report' WHEN 2 THEN 'other' ELSE 'discharge_summary' END AS document_kind
   FROM encounter WHERE kind = 'document')"""


def documents_of(v):
    return v.encounter.filter("kind = 'document'").selectExpr(
        "encounter_id", "CASE encounter_id % 4 WHEN 0 THEN 'prescription' WHEN 1 THEN "
        "'lab_report' WHEN 2 THEN 'other' ELSE 'discharge_summary' END AS document_kind")


@query("g1_patient_overview", "patient encounter med obs", "WITH " + DOCS + """,
e AS (SELECT patient_id, count(*) AS n FROM encounter GROUP BY 1),
d AS (SELECT patient_id, count(*) FILTER (document_kind = 'prescription') AS p,
   count(*) FILTER (document_kind = 'lab_report') AS l,
   count(*) FILTER (document_kind NOT IN ('prescription', 'lab_report')) AS o
   FROM documents_of JOIN encounter USING (encounter_id) GROUP BY 1),
m AS (SELECT patient_id, count(DISTINCT normalized_name) AS n FROM med GROUP BY 1),
b AS (SELECT patient_id, count(*) AS n FROM obs GROUP BY 1)
SELECT patient_id, CAST(coalesce(e.n, 0) AS BIGINT) AS encounters,
  CAST(coalesce(p, 0) AS BIGINT) AS prescriptions, CAST(coalesce(l, 0) AS BIGINT) AS lab_reports,
  CAST(coalesce(o, 0) AS BIGINT) AS other_documents,
  CAST(coalesce(m.n, 0) AS BIGINT) AS medications, CAST(coalesce(b.n, 0) AS BIGINT) AS observations
FROM patient LEFT JOIN e USING (patient_id) LEFT JOIN d USING (patient_id)
LEFT JOIN m USING (patient_id) LEFT JOIN b USING (patient_id)""")
def _(v):
    return G.patient_overview(v.patient, v.encounter, documents_of(v), v.med, v.obs)


@query("g1_recent_encounters", "encounter", """
SELECT * FROM (SELECT patient_id, encounter_id, occurred_on,
  coalesce(headline, 'Clinical encounter') AS headline, CAST(row_number() OVER (PARTITION BY
  patient_id ORDER BY occurred_on DESC, encounter_id DESC) AS INT) AS position FROM encounter)
WHERE position <= 6""")
def _(v):
    return G.recent_encounters(v.encounter).select(
        "patient_id", "encounter_id", "occurred_on", "headline", "position")


_TIMELINE = """
WITH tl AS (
  SELECT patient_id, encounter_id AS seq, occurred_on, 'encounter' AS kind,
    coalesce(headline, 'Clinical encounter') AS label, 'Confirmed by ' || confirmed_by AS detail
  FROM encounter
  UNION ALL SELECT patient_id, seq, observed_on, 'investigation',
    display || coalesce(' ' || CAST(value AS VARCHAR), '') || ' ' || unit,
    CASE WHEN range_flag IN ('low', 'high') THEN 'Outside the reference interval: ' || range_flag
         ELSE 'Within the reference interval' END FROM obs
  UNION ALL SELECT patient_id, encounter_id * 10 + line_no, observed_on, 'medication',
    name || ' ' || dose, 'Prescribed' FROM med)
"""


def timeline(v, kinds=None):
    null = F.lit(None).cast("string")
    no_number = F.lit(None).cast("double")
    labs = v.obs.select(
        "patient_id", "seq", F.col("observed_on").alias("occurred_on"),
        F.lit("exact").alias("date_precision"), F.lit("investigation").alias("kind"),
        G.entity_label(F.lit("investigation"), F.col("display"), null, null, null,
                       F.col("value"), F.col("unit")).alias("label"),
        G.entity_detail(F.lit("investigation"), null, F.col("range_flag"), no_number, no_number)
        .alias("detail"))
    drugs = v.med.select(
        "patient_id", F.expr("encounter_id * 10 + line_no").alias("seq"),
        F.col("observed_on").alias("occurred_on"), F.lit("exact").alias("date_precision"),
        F.lit("medication").alias("kind"),
        G.entity_label(F.lit("medication"), F.col("name"), F.col("dose"), null, null, no_number,
                       null).alias("label"),
        G.entity_detail(F.lit("medication"), null, null, no_number, no_number).alias("detail"))
    return G.patient_timeline(labs.unionByName(drugs), v.encounter, kinds)


@query("g2_patient_timeline", "encounter obs med", _TIMELINE + """
SELECT patient_id, seq, occurred_on, kind, label, detail FROM tl""")
def _(v):
    return timeline(v).select("patient_id", "seq", "occurred_on", "kind", "label", "detail")


@query("g2_timeline_kinds", "encounter obs med", _TIMELINE + """
SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(count(occurred_on) AS BIGINT) AS dated FROM tl
WHERE kind IN ('investigation', 'medication') GROUP BY 1""")
def _(v):
    return timeline(v, ["investigation", "medication"]).groupBy("kind").agg(
        F.count("*").alias("n"), F.count("occurred_on").alias("dated"))


@query("g3_timeline_periods", "encounter obs med", _TIMELINE + """
SELECT patient_id, coalesce(CAST(extract(year FROM occurred_on) AS VARCHAR), 'unknown') AS period,
  CAST(count(*) AS BIGINT) AS entries, occurred_on IS NULL AS undated FROM tl GROUP BY 1, 2, 4""")
def _(v):
    return G.timeline_periods(timeline(v))


_THREADS = """
WITH latest AS (SELECT patient_id, arg_max(encounter_id, (occurred_on, encounter_id)) AS e
   FROM encounter GROUP BY 1),
denied AS (SELECT patient_id FROM latest WHERE EXISTS (SELECT 1 FROM efact f
   WHERE f.encounter_id = latest.e AND path = 'drug_allergy.taking_medicines' AND vs = 'false')),
threads AS (SELECT m.patient_id, normalized_name, min(name) AS name, count(*) AS mentions,
   count(*) FILTER (status = 'documented') AS documented,
   count(*) FILTER (status = 'stopped-reported') AS stopped, max(observed_on) AS last_observed_on,
   bool_or(d.patient_id IS NOT NULL) AS den
   FROM med m LEFT JOIN denied d ON d.patient_id = m.patient_id GROUP BY 1, 2)
"""


def threads(v):
    return G.medication_threads(v.med, G.latest_denials(v.encounter, efacts(v)))


@query("g4_medication_threads", "encounter efact med", _THREADS + """
SELECT patient_id, normalized_name, name, CAST(mentions AS BIGINT) AS mentions,
  CAST(documented AS BIGINT) AS documented, CAST(stopped AS BIGINT) AS stopped, last_observed_on,
  CASE WHEN den AND documented > 0 THEN 'documented_but_denied'
       WHEN documented > 0 AND stopped > 0 THEN 'documented_and_stopped' END AS reason,
  (den AND documented > 0) OR (documented > 0 AND stopped > 0) AS needs_reconciliation
FROM threads""")
def _(v):
    return threads(v)


@query("g5_reconcile_sessions", "encounter efact med patient", _THREADS + """
, s AS (SELECT 'v' || CAST(patient_id AS VARCHAR) AS session_id, patient_id, patient_id % 3 = 0
     AS denies FROM patient),
named AS (SELECT DISTINCT 'v' || CAST(patient_id AS VARCHAR) AS session_id, normalized_name
   FROM med WHERE line_no = 3)
SELECT session_id, 'medication_reconciliation' AS kind, CAST(NULL AS VARCHAR) AS normalized_name,
   CAST(count(*) AS BIGINT) AS medicines
FROM s JOIN threads t ON t.patient_id = s.patient_id AND documented > 0 WHERE denies GROUP BY 1
UNION ALL
SELECT s.session_id, 'medication_not_mentioned', t.normalized_name, 1
FROM s JOIN threads t ON t.patient_id = s.patient_id AND documented > 0
WHERE NOT denies AND NOT EXISTS (SELECT 1 FROM named n WHERE n.session_id = s.session_id
   AND n.normalized_name = t.normalized_name)""")
def _(v):
    s = v.patient.selectExpr("'v' || CAST(patient_id AS STRING) AS session_id", "patient_id",
                             "patient_id % 3 = 0 AS denies")
    named = v.med.filter("line_no = 3").selectExpr(
        "'v' || CAST(patient_id AS STRING) AS session_id", "name")
    return G.reconcile_sessions(s, named, threads(v))


_FEATURES = """
WITH feat AS (SELECT DISTINCT encounter_id, path, item FROM (
   SELECT encounter_id, path, unnest(string_split(vs, '|')) AS item FROM efact
   WHERE path IN ('chief_complaint.text', 'hpi.site', 'hpi.character', 'hpi.radiation',
                  'hpi.timing')) WHERE item NOT IN ('', 'none'))
"""


@query("g6_feature_set", "efact", _FEATURES + "SELECT * FROM feat")
def _(v):
    return G.feature_set(efacts(v))


_TARGETS = _FEATURES + """
, target AS (SELECT patient_id, arg_max(encounter_id, (occurred_on, encounter_id)) AS target_id
   FROM encounter WHERE kind = 'intake' GROUP BY 1)
"""


@query("g7_similar_encounters", "efact encounter", _TARGETS + """
, hit AS (SELECT t.patient_id, t.target_id, e.encounter_id, e.occurred_on, count(*) AS n,
   string_agg(a.path || '=' || a.item, ',' ORDER BY a.path || '=' || a.item) AS shared
  FROM target t JOIN feat a ON a.encounter_id = t.target_id
  JOIN encounter e ON e.patient_id = t.patient_id AND e.encounter_id <> t.target_id
  JOIN feat b ON b.encounter_id = e.encounter_id AND b.path = a.path AND b.item = a.item
  GROUP BY 1, 2, 3, 4)
SELECT patient_id, target_id, encounter_id, CAST(n AS BIGINT) AS shared_count, shared,
  CASE WHEN n >= 4 THEN 'many shared features' WHEN n >= 2 THEN 'some shared features'
       ELSE 'one shared feature' END AS band, CAST(position AS INT) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY n DESC, occurred_on,
        encounter_id) AS position FROM hit) WHERE position <= 3""")
def _(v):
    return G.similar_encounters(
        G.feature_set(efacts(v)), v.encounter, G.latest_intakes(v.encounter)
    ).select("patient_id", "target_id", "encounter_id", "shared_count",
             F.array_join("shared", ",").alias("shared"), "band", "position")


@query("g8_cross_patient_similar", "efact encounter patient", _FEATURES + """
, pair AS (SELECT a.encounter_id AS target_id, b.encounter_id FROM encounter a
   JOIN encounter b ON b.encounter_id = a.encounter_id + 1
   JOIN patient p ON p.patient_id = a.patient_id JOIN patient q ON q.patient_id = b.patient_id
   WHERE p.is_synthetic = q.is_synthetic AND p.patient_id <> q.patient_id)
SELECT target_id, pair.encounter_id, CAST(count(*) AS BIGINT) AS shared_count,
   CASE WHEN count(*) >= 4 THEN 'many shared features' WHEN count(*) >= 2
        THEN 'some shared features' ELSE 'one shared feature' END AS band
FROM pair JOIN feat x ON x.encounter_id = target_id
JOIN feat y ON y.encounter_id = pair.encounter_id AND y.path = x.path AND y.item = x.item
GROUP BY 1, 2""")
def _(v):
    pairs = v.encounter.selectExpr("encounter_id AS target_id", "encounter_id + 1 AS encounter_id")
    return G.cross_patient_similar(pairs, G.feature_set(efacts(v)), v.encounter, v.patient)


@query("g8_nearest_across_patients", "efact encounter patient", _FEATURES + """
, own AS (SELECT e.encounter_id, e.patient_id, coalesce(p.is_synthetic, false) AS flag
   FROM encounter e JOIN patient p USING (patient_id)),
has AS (SELECT feat.*, patient_id, flag FROM feat JOIN own USING (encounter_id)),
hit AS (SELECT x.encounter_id AS target_id, y.encounter_id, CAST(count(*) AS BIGINT) AS shared_count
   FROM has x JOIN has y ON y.flag = x.flag AND y.path = x.path AND y.item = x.item
     AND y.patient_id <> x.patient_id WHERE x.encounter_id % 100 = 0 GROUP BY 1, 2),
pos AS (SELECT *, row_number() OVER (PARTITION BY target_id
   ORDER BY shared_count DESC, encounter_id) AS position FROM hit)
SELECT target_id, encounter_id, shared_count, CAST(position AS INT) AS position,
   CASE WHEN shared_count >= 4 THEN 'many shared features' WHEN shared_count >= 2
        THEN 'some shared features' ELSE 'one shared feature' END AS band
FROM pos WHERE position <= 3""")
def _(v):
    targets = v.encounter.filter("encounter_id % 100 = 0").selectExpr("encounter_id AS target_id")
    return G.nearest_across_patients(
        targets, G.feature_set(efacts(v)), v.encounter, v.patient)


@query("g9_latest_observations", "obs", """
SELECT patient_id, analyte, seq, value, unit, range_flag, observed_on FROM (
  SELECT *, coalesce(analyte_key, lower(display)) AS analyte, row_number() OVER (
    PARTITION BY patient_id, coalesce(analyte_key, lower(display))
    ORDER BY observed_on DESC NULLS LAST, seq DESC) AS rn FROM obs) WHERE rn = 1""")
def _(v):
    return G.latest_observations(v.obs)


SERIES_SQL = """
WITH p AS (SELECT *, coalesce(analyte_key, lower(display)) AS analyte FROM obs
   WHERE value IS NOT NULL AND observed_on IS NOT NULL),
r AS (SELECT *, row_number() OVER (w ORDER BY observed_on DESC, seq DESC) AS rn,
   lag(value) OVER (w ORDER BY observed_on, seq) AS pv,
   lag(observed_on) OVER (w ORDER BY observed_on, seq) AS po,
   count(*) OVER w AS n,
   count(*) FILTER (range_flag IN ('high', 'low')) OVER w AS oor
   FROM p WINDOW w AS (PARTITION BY patient_id, analyte))
"""


@query("g10_observation_series", "obs", SERIES_SQL + """
SELECT patient_id, analyte, display, unit, CAST(n AS BIGINT) AS points, value AS latest_value,
  observed_on AS latest_on, range_flag AS latest_flag, pv AS previous_value, po AS previous_on,
  round(value - pv, 4) AS delta,
  CASE WHEN abs(round(value - pv, 4)) < 1e-9 THEN 'unchanged' WHEN value > pv THEN 'higher'
       ELSE 'lower' END AS direction, CAST(oor AS BIGINT) AS out_of_range,
  CASE analyte WHEN 'hba1c' THEN 0 WHEN 'fasting_glucose' THEN 1 WHEN 'creatinine' THEN 3
       WHEN 'tsh' THEN 5 ELSE 7 END AS lead_rank
FROM r WHERE rn = 1 AND n >= 2""")
def _(v):
    return G.observation_series(v.obs)


@query("g10_series_points", "obs", SERIES_SQL + """
SELECT patient_id, analyte, seq, value, pv AS previous_value, po AS previous_on,
  round(value - pv, 4) AS change FROM r""")
def _(v):
    return G.series_points(v.obs).select(
        "patient_id", "analyte", "seq", "value", "previous_value", "previous_on", "change")


@query("g11_observation_trend", "obs", """
WITH p AS (SELECT * FROM obs WHERE analyte_key IS NOT NULL AND value IS NOT NULL),
g AS (SELECT patient_id, analyte_key, count(*) AS n, count(DISTINCT unit) AS u,
   arg_min(value, (coalesce(observed_on, DATE '0001-01-01'), seq)) AS f,
   arg_max(value, (coalesce(observed_on, DATE '0001-01-01'), seq)) AS l FROM p GROUP BY 1, 2)
SELECT patient_id, analyte_key, CAST(n AS BIGINT) AS points, f AS first_value, l AS last_value,
  n >= 2 AND u <= 1 AS chartable, CASE WHEN n >= 2 AND u <= 1 THEN round(l - f, 4) END AS delta,
  CASE WHEN n < 2 THEN 'single_value' WHEN u > 1 THEN 'mixed_units' END AS not_chartable_because
FROM g""")
def _(v):
    return G.observation_trend(v.obs)


@query("g12_recurrence", "encounter", """
WITH g AS (SELECT patient_id, lower(trim(coalesce(headline, 'Unspecified'))) AS headline_key,
  count(*) AS n, min(occurred_on) AS f, max(occurred_on) AS l FROM encounter
  WHERE kind = 'intake' GROUP BY 1, 2)
SELECT patient_id, headline_key, CAST(n AS BIGINT) AS visits, f AS first_on, l AS last_on,
  CAST(sum(n) OVER w AS BIGINT) AS patient_visits, min(f) OVER w AS first_seen_on
FROM g WINDOW w AS (PARTITION BY patient_id)""")
def _(v):
    return G.recurrence(v.encounter)


_CHANGE = """
SELECT coalesce(n.encounter_id, t.e) AS encounter_id, coalesce(n.path, t.path) AS path,
  coalesce(n.item, t.item) AS item, CASE WHEN t.e IS NULL THEN 'new'
    WHEN n.encounter_id IS NULL THEN 'resolved' ELSE 'persisting' END AS change
FROM (SELECT f.* FROM feat f JOIN link USING (encounter_id) WHERE prev IS NOT NULL) n
FULL OUTER JOIN (SELECT l.encounter_id AS e, f.path, f.item FROM link l
   JOIN feat f ON f.encounter_id = l.prev) t
ON t.e = n.encounter_id AND t.path = n.path AND t.item = n.item"""


@query("g13_feature_changes", "efact encounter", _FEATURES + """
, link AS (SELECT a.encounter_id, (SELECT arg_max(b.encounter_id, (b.occurred_on, b.encounter_id))
    FROM encounter b WHERE b.patient_id = a.patient_id AND b.kind = 'intake'
      AND b.occurred_on < a.occurred_on) AS prev FROM encounter a WHERE a.kind = 'intake')
""" + _CHANGE)
def _(v):
    return G.feature_changes(G.feature_set(efacts(v)), v.encounter)


@query("g14_fact_changes", "efact encounter", """
WITH live AS (SELECT *, CASE WHEN fact_id % 3 = 0 THEN 'shown ' || vs ELSE replace(vs, '|', ', ')
     END AS item FROM efact WHERE superseded_by IS NULL AND invalidated_reason IS NULL),
feat AS (SELECT DISTINCT encounter_id, path, item FROM live WHERE state <> 'not_asked'),
link AS (SELECT encounter_id, lag(encounter_id) OVER (PARTITION BY patient_id
     ORDER BY occurred_on, encounter_id) AS prev FROM encounter
     WHERE kind = 'intake' AND confirmed_by <> ''),
ch AS (""" + _CHANGE + """)
SELECT ch.*, CASE WHEN change <> 'resolved' THEN (SELECT max(fact_id) FROM live l
   WHERE l.encounter_id = ch.encounter_id AND l.path = ch.path AND l.item = ch.item) END AS fact_id
FROM ch""")
def _(v):
    return G.fact_changes(efacts(v), confirmed(v))


@query("g15_visit_gaps", "efact", """
SELECT encounter_id, fact_id, path, 'declined_or_unknown' AS gap FROM efact
WHERE superseded_by IS NULL AND invalidated_reason IS NULL AND state = 'declined'
UNION ALL SELECT encounter_id, fact_id, path, 'superseded' FROM efact
WHERE superseded_by IS NOT NULL
UNION ALL SELECT encounter_id, fact_id, path, 'invalidated' FROM efact
WHERE invalidated_reason IS NOT NULL""")
def _(v):
    return G.visit_gaps(efacts(v))


_FIELD_VALUES = ", ".join(f"('{f[0]}', '{f[1]}', {i})"
                          for i, f in enumerate(SNAPSHOT_FIELDS + ALLERGY_FIELDS))
_STANDING = f"""
WITH fld(path, label, pos) AS (VALUES {_FIELD_VALUES}),
st AS (SELECT encounter_id, path, arg_max(fact_id, fact_id) AS fact_id,
   arg_max(state, fact_id) AS state FROM efact
   WHERE superseded_by IS NULL AND invalidated_reason IS NULL GROUP BY 1, 2)
"""


@query("g16_field_coverage", "efact encounter", _STANDING + """
SELECT e.encounter_id, f.path, CASE WHEN st.state IS NULL OR st.state = 'not_asked' THEN 'missing'
   WHEN st.state = 'declined' THEN 'declined' ELSE 'collected' END AS status
FROM encounter e CROSS JOIN fld f LEFT JOIN st ON st.encounter_id = e.encounter_id
  AND st.path = f.path""")
def _(v):
    return G.field_coverage(v.encounter, efacts(v))


@query("g17_current_snapshot", "efact evidence", _STANDING + """
SELECT st.encounter_id, st.path, f.label, f.pos AS position, st.fact_id,
  CASE WHEN f.pos < 10 THEN 'snapshot' ELSE 'allergy' END AS block,
  CAST(count(*) AS BIGINT) AS evidence_rows,
  string_agg(DISTINCT source_type, ',' ORDER BY source_type) AS kinds,
  coalesce(string_agg(DISTINCT modality, ',' ORDER BY modality), '') AS modalities
FROM st JOIN fld f ON f.path = st.path JOIN evidence e ON e.fact_id = st.fact_id
WHERE st.state <> 'not_asked' GROUP BY 1, 2, 3, 4, 5, 6""")
def _(v):
    return G.current_snapshot(efacts(v), v.evidence).select(
        "encounter_id", "path", "label", "position", "fact_id", "block", "evidence_rows",
        F.array_join("evidence_kinds", ",").alias("kinds"),
        F.array_join("evidence_modalities", ",").alias("modalities"))


@query("g18_medication_list", "med encounter", """
WITH cur AS (SELECT patient_id, arg_max(encounter_id, (occurred_on, encounter_id)) AS now
   FROM encounter WHERE kind = 'intake' GROUP BY 1)
SELECT m.patient_id, m.encounter_id, m.name, m.status, CASE WHEN m.encounter_id = now
   THEN 'this-visit' ELSE 'previous-visit' END AS origin
FROM med m LEFT JOIN cur USING (patient_id)""")
def _(v):
    return G.medication_list(v.med, G.latest_intakes(v.encounter)).select(
        "patient_id", "encounter_id", "name", "status", "origin")


@query("g18_encounter_list", "encounter", """
WITH cur AS (SELECT patient_id, arg_max(encounter_id, (occurred_on, encounter_id)) AS now
   FROM encounter WHERE kind = 'intake' GROUP BY 1)
SELECT encounter_id, e.patient_id, coalesce(now = encounter_id, false) AS is_current
FROM encounter e LEFT JOIN cur USING (patient_id)""")
def _(v):
    return G.encounter_list(v.encounter, G.latest_intakes(v.encounter)).select(
        "encounter_id", "patient_id", "is_current")


@query("g21_fired_summary", "afact", _WIDE + """
SELECT session_id, CAST(count(*) AS BIGINT) AS evaluated,
  CAST(count(*) FILTER (fired) AS BIGINT) AS fired_count,
  coalesce(string_agg(CASE WHEN fired THEN rule_id END, ',' ORDER BY rule_id), '') AS fired
FROM prop GROUP BY 1""")
def _(v):
    return G.fired_summary(proposals(v)).withColumn("fired", F.array_join("fired", ","))


@query("g22_triage_queue", "session", """
SELECT session_ref, priority, CASE priority WHEN 'immediate' THEN 0 WHEN 'urgent' THEN 1 ELSE 2 END
   AS rank, CAST(date_diff('day', created_on, DATE '2002-01-01') * 1440 AS BIGINT)
   AS waiting_minutes
FROM session WHERE purged_on IS NULL""")
def _(v):
    s = v.session.withColumns({"created_at": F.col("created_on").cast("timestamp"),
                               "purged_at": F.col("purged_on").cast("timestamp")})
    return G.triage_queue(s, F.expr("TIMESTAMP '2002-01-01 00:00:00'")).select(
        "session_ref", "priority", "rank", "waiting_minutes")


@query("g23_ledger_inspection", "afact absence", _WIDE + """
, f AS (SELECT session_id, count(*) FILTER (active) AS a, count(*) FILTER (NOT active) AS s,
   count(*) FILTER (active AND tier = 'stated') AS st,
   count(*) FILTER (active AND tier = 'confirmed') AS co,
   count(*) FILTER (active AND tier = 'document') AS doc,
   count(*) FILTER (trim(verbatim) = '') AS blank FROM afact GROUP BY 1),
p AS (SELECT session_id, count(*) AS n, count(*) FILTER (fired) AS k FROM prop GROUP BY 1),
b AS (SELECT session_id, count(*) AS n FROM absence GROUP BY 1)
SELECT f.session_id, a AS active, s AS superseded, st AS stated, co AS confirmed, doc AS document,
  blank AS without_source, coalesce(p.n, 0) AS rules_evaluated, coalesce(p.k, 0) AS rules_fired,
  coalesce(b.n, 0) AS absences
FROM f LEFT JOIN p USING (session_id) LEFT JOIN b USING (session_id)""")
def _(v):
    return G.ledger_inspection(session_facts(v), proposals(v), v.absence)


@query("g24_open_contradictions", "ev", """
SELECT event_id, user_id FROM ev WHERE k % 2 = 0""")
def _(v):
    rows = v.ev.withColumn("status", F.expr("CASE WHEN k % 2 = 0 THEN 'open' ELSE 'resolved' END"))
    return G.open_contradictions(rows).select("event_id", "user_id")


@query("j1_facts_with_evidence", "efact evidence", """
SELECT f.fact_id, f.path, evidence_id, source_type FROM efact f
LEFT JOIN evidence e ON e.fact_id = f.fact_id""")
def _(v):
    return G.facts_with_evidence(v.efact, v.evidence).select(
        "fact_id", "path", "evidence_id", "source_type")
