"""Queries over predicates and the fact ledger."""

from pyspark.sql import functions as F

from chartledger.config.rules import QUESTIONS
from chartledger.functions.text import mask_identifier
from chartledger.functions.conditions import condition
from chartledger.functions.values import make_value, value_text
from chartledger.operators import ledger as L
from chartledger.operators import predicates as P
from chartledger.plans.bindings import Registry

REG = Registry()
query = REG.add

SLOT_PATHS = "('" + "','".join(q[2] for q in QUESTIONS) + "')"


def span_of(df):
    """Add the span STRUCT of candidate rows."""
    selected = F.when(F.col("selected").isNotNull(), F.split("selected", r"\|"))
    span = L.make_span(
        kind=F.col("span_kind"), verbatim=F.col("verbatim"), question_id=F.col("question_id"),
        turn_id=F.col("turn_id"), modality=F.col("modality"), selected_values=selected,
        document_id=F.col("document_id"), page=F.lit(1),
        bbox=F.struct(F.lit(0.1).alias("x"), F.lit(0.2).alias("y"), F.lit(0.5).alias("width"),
                      F.lit(0.1).alias("height")),
    )
    return df.withColumn("span", span)


def candidates(v):
    rows = v.cand.withColumn("value", make_value(F.col("vkind"), F.col("vs")))
    return span_of(rows).withColumn("coded", F.expr("seq % 10 = 3"))


def scopes(v):
    return v.scope.withColumn("granted", F.split("granted", r"\|"))


def facts(v):
    """Session facts with a value, superseded."""
    rows = v.sfact.withColumn("value", make_value(F.col("vkind"), F.col("vs")))
    return L.supersede(rows)


def live_paths(v):
    return L.active_facts(facts(v))


_TESTS = (
    ("eq", "back"), ("ne", "back"), ("in", ["back", "sudden", "fever"]), ("not_in", ["none"]),
    ("contains", "weight"), ("gte", 7), ("lt", 8), ("recorded", True), ("not_recorded", True),
)


@query("p1_condition", "sfact", """
WITH v AS (SELECT fact_id, vkind, vs, string_split(vs, '|') AS items, try_cast(vs AS DOUBLE) AS n
  FROM sfact)
SELECT fact_id,
  vkind = 'text' AND vs = 'back' AS eq,
  NOT (vkind = 'text' AND vs = 'back') AS ne,
  len(list_intersect(items, ['back', 'sudden', 'fever'])) > 0 AS "in",
  NOT list_contains(items, 'none') AS not_in,
  len(list_filter(items, lambda x: contains(lower(x), 'weight'))) > 0 AS "contains",
  vkind IN ('text', 'number') AND coalesce(n >= 7, false) AS gte,
  vkind IN ('text', 'number') AND coalesce(n < 8, false) AS lt,
  true AS recorded, false AS not_recorded FROM v""")
def _(v):
    rows = v.sfact.withColumn("value", make_value(F.col("vkind"), F.col("vs")))
    return rows.select("fact_id", *[
        condition(("p", op, arg), lambda _p: "value").alias(op) for op, arg in _TESTS])


@query("p2_live_facts", "efact", """
SELECT state, path, CAST(count(*) AS BIGINT) AS n FROM efact
WHERE superseded_by IS NULL AND invalidated_reason IS NULL GROUP BY state, path""")
def _(v):
    return P.live_facts(v.efact).groupBy("state", "path").agg(F.count("*").alias("n"))


@query("p3_renderable", "efact evidence", """
SELECT fact_id, path, state FROM efact f
WHERE superseded_by IS NULL AND invalidated_reason IS NULL AND state <> 'not_asked'
  AND EXISTS (SELECT 1 FROM evidence e WHERE e.fact_id = f.fact_id)""")
def _(v):
    return P.renderable(v.efact, v.evidence).select("fact_id", "path", "state")


@query("p4_confirmed_encounters", "encounter", """
SELECT encounter_id, patient_id, confirmed_by FROM encounter
WHERE kind = 'intake' AND confirmed_by IS NOT NULL AND confirmed_by <> ''""")
def _(v):
    return P.confirmed_encounters(v.encounter).select(
        "encounter_id", "patient_id", "confirmed_by")


@query("p5_same_cohort", "patient encounter", """
SELECT e.encounter_id, e.patient_id AS left_id, b.patient_id AS right_id,
       CASE WHEN a.is_synthetic THEN 'synthetic' ELSE 'clinical' END AS cohort
FROM encounter e JOIN patient a ON a.patient_id = e.patient_id
JOIN patient b ON b.patient_id = e.encounter_id % (SELECT count(*) FROM patient)
WHERE a.is_synthetic = b.is_synthetic""")
def _(v):
    # The partner's id ranges over all patients, however many there are.
    other = F.col("encounter_id") % F.lit(v.patient.count())
    pairs = v.encounter.select("encounter_id", F.col("patient_id").alias("left_id"),
                               other.alias("right_id"))
    return P.same_cohort(pairs, v.patient, "left_id", "right_id").select(
        "encounter_id", "left_id", "right_id", "cohort")


@query("p6_apply_purpose", "patient encounter", """
SELECT priority, kind, CAST(count(*) AS BIGINT) AS n FROM encounter
GROUP BY priority, kind HAVING count(*) >= 5""")
def _(v):
    return P.apply_purpose(v.encounter, "auditor", "STATISTICS", "audit.read",
                           ["patient_id"], ["priority", "kind"])


@query("p6_strip_identifiers", "encounter", """
SELECT encounter_id, sha256(CAST(patient_id AS VARCHAR)) AS patient_id, priority
FROM encounter""")
def _(v):
    rows = v.encounter.select("encounter_id", "patient_id", "priority")
    return P.apply_purpose(rows, "clinician", "RESEARCH", "fact.read", ["patient_id"], [])


@query("p7_staff", "session", """
SELECT 'v' || session_ref AS viewer FROM session
WHERE patient_id % 4 IN (0, 1)""")
def _(v):
    role = F.expr("CASE patient_id % 4 WHEN 0 THEN 'clinician' WHEN 1 THEN 'auditor' "
                  "WHEN 2 THEN 'patient' ELSE 'anonymous' END")
    viewers = v.session.select(F.concat(F.lit("v"), "session_ref").alias("viewer"),
                               role.alias("role"))
    return P.sees_everything(viewers).select("viewer")


@query("p7_owned_rows", "patient session", """
SELECT 'p' || a.patient_ref AS viewer, s.session_ref FROM session s
JOIN patient a ON a.patient_id = s.patient_id
WHERE a.abha_ref IS NOT NULL AND a.patient_id % 2 = 0""")
def _(v):
    people = v.patient
    rows = v.session.join(people.select("patient_id", "abha_ref"), "patient_id")
    viewers = people.select(
        F.concat(F.lit("p"), "patient_ref").alias("viewer"), "abha_ref",
        F.expr("CASE WHEN patient_id % 2 = 0 THEN 'patient' ELSE 'anonymous' END").alias("role"))
    return P.owned_rows(rows, viewers).select("viewer", "session_ref")


@query("p8_confidence_band", "line", """
SELECT doc_id, line_no,
       CASE WHEN line_no = 9 OR trim(text) = '' THEN 'unreadable'
            WHEN confidence IS NULL OR handwritten OR confidence <= 0.72 THEN 'verify'
            WHEN confidence >= 0.9 THEN 'high' ELSE 'medium' END AS band
FROM line""")
def _(v):
    failure = F.when(F.col("line_no") == 9, "engine")
    return v.line.select("doc_id", "line_no", P.confidence_band(
        F.col("confidence"), F.col("handwritten"), F.col("text"), failure).alias("band"))


@query("p9_mask_identifier", "patient", """
SELECT patient_id, '**** **** ' || right(abha_ref, 4) AS masked FROM patient""")
def _(v):
    return v.patient.select("patient_id", mask_identifier(F.col("abha_ref")).alias("masked"))


@query("p10_how_known", "med", """
SELECT CASE status WHEN 'documented' THEN 'found in an uploaded document'
            WHEN 'patient-reported-current' THEN 'the patient said they take this'
            WHEN 'stopped-reported' THEN 'the patient said they stopped' ELSE status END AS how,
       CAST(count(*) AS BIGINT) AS n FROM med GROUP BY 1""")
def _(v):
    return v.med.groupBy(P.how_known(F.col("status")).alias("how")).agg(F.count("*").alias("n"))


@query("p11_assessment_fields", "ev", """
WITH doc AS (
  SELECT event_id, '{"Plan":{"note":"the \\"plan\\": none","k":' || CAST(k AS VARCHAR) || '},"'
     || CASE k % 4 WHEN 0 THEN 'diagnosis' WHEN 1 THEN 'site' WHEN 2 THEN 'Therapy'
        ELSE 'advice' END || '":["advice"]}' AS j, k FROM ev)
SELECT event_id, 'Plan' AS field FROM doc
UNION ALL SELECT event_id, CASE k % 4 WHEN 0 THEN 'diagnosis' WHEN 2 THEN 'Therapy'
     ELSE 'advice' END FROM doc WHERE k % 4 <> 1""")
def _(v):
    name = F.expr("CASE k % 4 WHEN 0 THEN 'diagnosis' WHEN 1 THEN 'site' WHEN 2 THEN 'Therapy' "
                  "ELSE 'advice' END")
    doc = F.concat(F.lit('{"Plan":{"note":"the \\"plan\\": none","k":'),
                   F.col("k").cast("string"), F.lit('},"'), name, F.lit('":["advice"]}'))
    return P.assessment_fields(v.ev.withColumn("j", doc), "j", ["event_id"])


_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"

_JUDGED = f"""
WITH base AS (
  SELECT c.*, s.granted, seq % 10 = 3 AS coded, string_split(vs, '|') AS items,
         {_NORM.format('verbatim')} AS hay,
         regexp_extract_all(verbatim, '-?[0-9]+(?:\\.[0-9]+)?') AS nums
  FROM cand c LEFT JOIN scope s USING (session_id)),
opt(path, vals) AS (VALUES {', '.join(
    "('" + q[2] + "', [" + ', '.join("'" + x + "'" for x, _ in q[4]) + "])"
    for q in QUESTIONS if q[4])}),
item AS (
  SELECT fact_id, unnest(items) AS raw, hay, nums FROM base WHERE vkind IN ('text', 'list')),
echo AS (
  SELECT fact_id, bool_and(
     {_NORM.format('raw')} <> '' AND (
       contains(hay, {_NORM.format('raw')}) OR contains({_NORM.format('raw')}, hay)
       OR CASE WHEN try_cast(trim(raw) AS DOUBLE) IS NOT NULL
               THEN len(list_filter(nums, lambda x: abs(CAST(x AS DOUBLE) - CAST(raw AS DOUBLE)) < 1e-9)) > 0
               ELSE len(list_filter(string_split({_NORM.format('raw')}, ' '), lambda w: length(w) > 2)) > 0
                AND len(list_filter(string_split({_NORM.format('raw')}, ' '),
                        lambda w: length(w) > 2 AND NOT contains(hay, w))) = 0 END)) AS ok
  FROM item GROUP BY fact_id),
judged AS (
  SELECT b.*, CASE
    WHEN span_kind IS NULL THEN 'no_source'
    WHEN span_kind NOT IN ('utterance', 'document') THEN 'bad_source_kind'
    WHEN trim(verbatim) = '' THEN 'blank_verbatim'
    WHEN vs IS NULL THEN 'null_value'
    WHEN tier = 'document' AND span_kind <> 'document' THEN 'document_span_needed'
    WHEN tier IN ('stated', 'confirmed') AND span_kind <> 'utterance' THEN 'utterance_needed'
    WHEN tier = 'confirmed' AND question_id IS NULL THEN 'question_needed'
    WHEN b.path NOT IN {SLOT_PATHS} AND NOT regexp_matches(b.path, '^[a-z]+\\[[0-9]+\\]')
      THEN 'unknown_path'
    WHEN required_scope IS NOT NULL
      AND NOT coalesce(list_contains(string_split(granted, '|'), required_scope), false)
      THEN 'scope_not_granted'
    WHEN coded AND NOT coalesce(vals IS NOT NULL
      AND len(list_filter(items, lambda x: NOT list_contains(vals, x))) = 0, false)
      THEN 'not_in_vocabulary'
    WHEN NOT coded AND NOT coalesce(
      CASE WHEN selected IS NOT NULL
           THEN len(list_filter(items, lambda x: NOT list_contains(string_split(selected, '|'), x))) = 0
           WHEN vkind IN ('bool', 'number') THEN true ELSE ok END, false)
      THEN 'value_not_evidenced' END AS reason
  FROM base b LEFT JOIN opt ON opt.path = b.path LEFT JOIN echo USING (fact_id))
"""


@query("l1_admit_facts", "cand scope", _JUDGED + """
SELECT fact_id, session_id, path, coalesce(reason, 'accepted') AS outcome FROM judged""")
def _(v):
    return L.judge_facts(candidates(v), scopes(v)).select(
        "fact_id", "session_id", "path", F.coalesce("reason", F.lit("accepted")).alias("outcome"))


@query("l2_value_evidence", "cand scope", _JUDGED + """
SELECT tier, coalesce(reason, 'accepted') AS outcome, CAST(count(*) AS BIGINT) AS n
FROM judged GROUP BY 1, 2""")
def _(v):
    judged = L.judge_facts(candidates(v), scopes(v))
    return judged.groupBy("tier", F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(
        F.count("*").alias("n"))


_DIGEST = """
dig AS (
  SELECT j.*, substr(sha256(CASE WHEN span_kind = 'document'
     THEN 'doc|' || coalesce(document_id, '') || '|1|0.1,0.2|' || verbatim
     ELSE 'utt|' || turn_id || '|:|' || verbatim END), 1, 16) AS digest
  FROM judged j WHERE reason IS NULL),
ded AS (
  SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY session_id, path, digest
                                                ORDER BY seq) AS rn FROM dig d) WHERE rn = 1)
"""


@query("l3_dedupe_spans", "cand scope", _JUDGED + "," + _DIGEST + """
SELECT fact_id, session_id, path, digest FROM ded""")
def _(v):
    kept, _lost = L.admit_facts(candidates(v), scopes(v))
    return L.dedupe_spans(kept).select("fact_id", "session_id", "path", "digest")


@query("l4_supersede", "cand scope", _JUDGED + "," + _DIGEST + """
SELECT a.fact_id, a.session_id, a.path,
   (SELECT min_by(b.fact_id, b.seq) FROM ded b WHERE b.session_id = a.session_id
      AND b.path = a.path AND b.seq > a.seq AND b.supersede) AS superseded_by
FROM ded a""")
def _(v):
    kept, _lost = L.admit_facts(candidates(v), scopes(v))
    return L.supersede(L.dedupe_spans(kept)).select(
        "fact_id", "session_id", "path", "superseded_by")


_STATUS = f"""
WITH q(question_id, section, path) AS (VALUES {', '.join(
    f"('{q[0]}', '{q[1]}', '{q[2]}')" for q in QUESTIONS)}),
s AS (SELECT DISTINCT session_id FROM ev),
lastabs AS (SELECT session_id, path, max_by(reason, seq) AS reason FROM absence GROUP BY 1, 2),
status AS (
  SELECT s.session_id, q.question_id, q.section, q.path,
     CASE WHEN EXISTS (SELECT 1 FROM afact f WHERE f.active AND f.session_id = s.session_id
                       AND f.path = q.path) THEN 'recorded'
          WHEN a.reason = 'declined' THEN 'declined' ELSE 'not_asked' END AS status
  FROM s CROSS JOIN q LEFT JOIN lastabs a ON a.session_id = s.session_id AND a.path = q.path)
"""


def statuses(v):
    sessions = v.ev.select("session_id").distinct()
    return L.field_status(sessions, facts(v), v.absence)


@query("l5_field_status", "ev afact absence", _STATUS + """
SELECT session_id, question_id, status FROM status""")
def _(v):
    return statuses(v).select("session_id", "question_id", "status")


@query("l6_section_completeness", "ev afact absence", _STATUS + """
SELECT session_id, section, CAST(recorded AS BIGINT) AS recorded, CAST(askable AS BIGINT) AS askable,
       CASE WHEN askable > 0 THEN round(recorded / askable, 4) ELSE 0.0 END AS completeness
FROM (SELECT session_id, section, sum(CASE WHEN status = 'recorded' THEN 1 ELSE 0 END) AS recorded,
        CASE WHEN sum(CASE WHEN status <> 'not_asked' THEN 1 ELSE 0 END) > 0
             THEN sum(CASE WHEN status <> 'not_asked' THEN 1 ELSE 0 END) ELSE count(*) END AS askable
      FROM status GROUP BY 1, 2)""")
def _(v):
    return L.section_completeness(statuses(v))


@query("l6_overall_completeness", "ev afact absence", _STATUS + """
SELECT session_id, CAST(sum(CASE WHEN status = 'recorded' THEN 1 ELSE 0 END) AS BIGINT) AS recorded,
       CAST(sum(CASE WHEN status <> 'not_asked' THEN 1 ELSE 0 END) AS BIGINT) AS askable,
       CASE WHEN sum(CASE WHEN status <> 'not_asked' THEN 1 ELSE 0 END) > 0
         THEN round(sum(CASE WHEN status = 'recorded' THEN 1 ELSE 0 END)
              / sum(CASE WHEN status <> 'not_asked' THEN 1 ELSE 0 END), 4) ELSE 0.0 END
         AS completeness
FROM status GROUP BY 1""")
def _(v):
    return L.overall_completeness(statuses(v))


@query("l7_slot_view", "afact", """
SELECT session_id, path, max_by(CASE WHEN active THEN fact_id END, CASE WHEN active THEN seq END)
         AS fact_id,
       max_by(replace(vs, '|', ', '), CASE WHEN active THEN seq END) AS shown,
       CAST(sum(CASE WHEN active THEN 1 ELSE 0 END) AS BIGINT) AS active_count,
       CAST(sum(CASE WHEN active THEN 0 ELSE 1 END) AS BIGINT) AS superseded_count
FROM afact GROUP BY 1, 2 HAVING sum(CASE WHEN active THEN 1 ELSE 0 END) > 0""")
def _(v):
    return L.slot_view(facts(v)).select(
        "session_id", "path", "fact_id", value_text(F.col("value")).alias("shown"),
        "active_count", "superseded_count")


@query("l7_slot_history", "afact", """
SELECT session_id, path, fact_id, replace(vs, '|', ', ') AS shown FROM afact WHERE NOT active""")
def _(v):
    return L.slot_history(facts(v)).select(
        "session_id", "path", "fact_id", value_text(F.col("value")).alias("shown"))


@query("l10_consent_state", "patient session", """
WITH c AS (
  SELECT patient_id, string_split(CASE patient_id % 4 WHEN 0 THEN 'history|voice'
       WHEN 1 THEN 'voice|photos' WHEN 2 THEN 'history|documents|abdm_share' ELSE 'history' END,
       '|') AS granted,
     CASE WHEN patient_id % 10 = 0 THEN DATE '2020-06-01' END AS revoked_on,
     CASE WHEN patient_id % 3 = 0 THEN created_on END AS expires_on FROM patient)
SELECT patient_id,
  array_to_string(list_filter(['history','voice','documents','abdm_share','ayush'],
      lambda x: NOT list_contains(granted, x)), '|') AS refused,
  CASE WHEN list_contains(granted, 'photos') THEN 'photos' ELSE '' END AS unknown_scopes,
  CASE WHEN list_contains(granted, 'history') THEN '' ELSE 'history' END AS missing_scopes,
  revoked_on IS NULL AND (expires_on IS NULL OR DATE '2021-06-01' < expires_on) AS active,
  revoked_on IS NULL AND (expires_on IS NULL OR DATE '2021-06-01' < expires_on)
     AND list_contains(granted, 'abdm_share') AS may_share
FROM c""")
def _(v):
    texts = F.expr("CASE patient_id % 4 WHEN 0 THEN 'history|voice' WHEN 1 THEN 'voice|photos' "
                   "WHEN 2 THEN 'history|documents|abdm_share' ELSE 'history' END")
    consents = v.patient.select(
        "patient_id", F.split(texts, r"\|").alias("granted"),
        F.expr("CASE WHEN patient_id % 10 = 0 THEN DATE '2020-06-01' END").alias("revoked_on"),
        F.expr("CASE WHEN patient_id % 3 = 0 THEN created_on END").alias("expires_on"))
    state = L.consent_state(consents, F.expr("DATE '2021-06-01'"))
    join = lambda c: F.array_join(c, "|").alias(c)
    return state.select("patient_id", join("refused"), join("unknown_scopes"),
                        join("missing_scopes"), "active",
                        L.allows("abdm_share").alias("may_share"))


_REVOKED = """
WITH rev AS (SELECT session_id, CASE WHEN length(session_id) % 2 = 0 THEN 'documents'
      ELSE 'voice' END AS revoked FROM scope),
held AS (SELECT f.*, (r.revoked = 'documents' AND f.tier = 'document')
      OR (r.revoked = 'voice' AND f.modality = 'speech') AS hit
      FROM sfact f JOIN rev r USING (session_id))
"""


@query("l11_revoke_scopes", "sfact scope", _REVOKED + """
SELECT a.fact_id, (SELECT min_by(b.fact_id, b.seq) FROM held b WHERE NOT b.hit
    AND b.session_id = a.session_id AND b.path = a.path AND b.seq > a.seq AND b.supersede)
    AS superseded_by
FROM held a WHERE NOT hit""")
def _(v):
    gone = F.expr("CASE WHEN length(session_id) % 2 = 0 THEN 'documents' ELSE 'voice' END")
    rev = scopes(v).withColumn("revoked", F.array(gone))
    survivors, _purged, _ended = L.revoke_scopes(v.sfact, rev)
    return survivors.select("fact_id", "superseded_by")


# Candidates as they were told, copies of a span included: the first survivor of a span stays.
@query("l11_revoke_copies", "cand scope", _JUDGED + """, rev AS (
  SELECT session_id, CASE WHEN length(session_id) % 2 = 0 THEN 'documents' ELSE 'voice' END
    AS revoked FROM scope),""" + _DIGEST.replace(
    "FROM judged j WHERE reason IS NULL", """FROM judged j LEFT JOIN rev r USING (session_id)
  WHERE reason IS NULL AND NOT coalesce(r.revoked = 'documents' AND j.tier = 'document'
    OR r.revoked = 'voice' AND j.modality = 'speech', false)""") + """
SELECT a.fact_id, (SELECT min_by(b.fact_id, b.seq) FROM ded b WHERE b.session_id = a.session_id
      AND b.path = a.path AND b.seq > a.seq AND b.supersede) AS superseded_by
FROM ded a""")
def _(v):
    gone = F.expr("CASE WHEN length(session_id) % 2 = 0 THEN 'documents' ELSE 'voice' END")
    kept, _lost = L.admit_facts(candidates(v), scopes(v))
    told = kept.withColumn("modality", F.col("span.modality"))
    survivors, _purged, _ended = L.revoke_scopes(told, scopes(v).withColumn(
        "revoked", F.array(gone)))
    return survivors.select("fact_id", "superseded_by")


@query("l11_ended_sessions", "scope", """
SELECT session_id FROM scope WHERE length(session_id) % 3 = 0""")
def _(v):
    gone = F.expr("CASE WHEN length(session_id) % 3 = 0 THEN 'history' ELSE 'voice' END")
    rev = scopes(v).withColumn("revoked", F.array(gone))
    return L.revoke_scopes(v.sfact, rev)[2].select("session_id")


@query("l11_purged_counts", "sfact scope", _REVOKED + """
SELECT session_id, CAST(count(*) AS BIGINT) AS purged FROM held WHERE hit GROUP BY 1""")
def _(v):
    gone = F.expr("CASE WHEN length(session_id) % 2 = 0 THEN 'documents' ELSE 'voice' END")
    rev = scopes(v).withColumn("revoked", F.array(gone))
    _survivors, purged, _ended = L.revoke_scopes(v.sfact, rev)
    return purged.groupBy("session_id").agg(F.count("*").alias("purged"))


_EDITS = """
WITH top AS (SELECT max(seq) + 1 AS over FROM sfact),
edit AS (
  SELECT session_id, event_id + over AS seq,
     CASE event_id % 5 WHEN 0 THEN 'hpi.site' WHEN 1 THEN 'hpi.onset' WHEN 2 THEN 'hpi.site'
          WHEN 3 THEN 'medications[60].name' ELSE 'no.such.path' END AS path,
     CASE event_id % 5 WHEN 0 THEN 'back' WHEN 1 THEN 'sudden' WHEN 2 THEN 'nowhere'
          ELSE 'aspirin' END AS shown, user_id, event_type, ts FROM ev, top),
made AS (
  SELECT session_id, seq, path, ts, 'e' || substr(sha256(session_id || '|' ||
     CAST(seq AS VARCHAR) || '|' || path), 1, 16) AS fact_id, shown || ' — corrected by u' ||
     CAST(user_id AS VARCHAR) || ': ' || event_type AS verbatim,
     CASE WHEN path = 'no.such.path' THEN 'unknown_path'
          WHEN shown = 'nowhere' THEN 'not_in_vocabulary' END AS reason FROM edit)
"""


def edited(v):
    top = v.sfact.agg(F.max("seq")).first()[0] + 1
    path = F.expr("CASE event_id % 5 WHEN 0 THEN 'hpi.site' WHEN 1 THEN 'hpi.onset' "
                  "WHEN 2 THEN 'hpi.site' WHEN 3 THEN 'medications[60].name' "
                  "ELSE 'no.such.path' END")
    shown = F.expr("CASE event_id % 5 WHEN 0 THEN 'back' WHEN 1 THEN 'sudden' "
                   "WHEN 2 THEN 'nowhere' ELSE 'aspirin' END")
    made = v.ev.select(
        "session_id", (F.col("event_id") + top).alias("seq"), "ts", path.alias("path"),
        make_value(F.lit("text"), shown).alias("value"), shown.alias("value_as_text"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"),
        F.col("event_type").alias("reason"))
    rows = v.sfact.withColumn("value", make_value(F.col("vkind"), F.col("vs")))
    return L.apply_edits(rows, made, scopes(v))


@query("l18_apply_edits", "sfact ev", _EDITS + """,
allf AS (
  SELECT session_id, seq, fact_id, path, verbatim, supersede FROM sfact
  UNION ALL SELECT session_id, seq, fact_id, path, verbatim, true FROM made
  WHERE reason IS NULL),
nxt AS (SELECT *, lead(CASE WHEN supersede THEN fact_id END IGNORE NULLS) OVER
     (PARTITION BY session_id, path ORDER BY seq) AS nx FROM allf)
SELECT a.fact_id, a.path, a.verbatim, a.nx AS superseded_by FROM nxt a""")
def _(v):
    return edited(v)[0].select("fact_id", "path", "verbatim", "superseded_by")


@query("l18_rejected_edits", "sfact ev", _EDITS + """
SELECT fact_id, path, reason FROM made WHERE reason IS NOT NULL""")
def _(v):
    return edited(v)[1].select("fact_id", "path", "reason")


_TAPS = """
WITH a AS (
  SELECT event_id, CASE k % 5 WHEN 0 THEN 'hpi.severity' WHEN 1 THEN 'hpi.associated'
     WHEN 2 THEN 'hpi.site' WHEN 3 THEN 'ros.gi' ELSE 'med.taking' END AS question_id,
     CASE k % 5 WHEN 0 THEN CAST(event_id % 13 AS VARCHAR)
       WHEN 1 THEN CASE event_id % 3 WHEN 0 THEN 'fever|none' WHEN 1 THEN 'sweating|bleeding'
            ELSE 'unicorn' END
       WHEN 2 THEN CASE event_id % 2 WHEN 0 THEN 'whole_body' ELSE 'chest' END
       WHEN 3 THEN CASE event_id % 3 WHEN 0 THEN 'jaundice' WHEN 1 THEN '' ELSE 'nausea' END
       ELSE CASE event_id % 2 WHEN 0 THEN 'yes' ELSE 'no' END END AS picked
  FROM ev)
"""


@query("r11_validate_taps", "ev", _TAPS + """
SELECT event_id, question_id,
  CASE WHEN picked = '' THEN 'empty' WHEN picked = 'unicorn' THEN 'unknown_option'
       WHEN question_id = 'hpi.severity' AND CAST(picked AS INT) > 10 THEN 'outside_scale' END
    AS reason,
  CASE WHEN picked IN ('', 'unicorn') THEN NULL
       WHEN question_id = 'hpi.severity' AND CAST(picked AS INT) > 10 THEN NULL
       WHEN picked = 'fever|none' THEN 'none' ELSE picked END AS recorded,
  CASE WHEN picked IN ('', 'unicorn') THEN NULL
       WHEN question_id = 'hpi.severity' THEN CASE WHEN CAST(picked AS INT) > 10 THEN NULL ELSE
         ['No trouble at all', 'Mild', 'Uncomfortable', 'Bad', 'Very bad', 'Worst I can imagine'
         ][least(CAST(picked AS INT) * 6 // 11, 5) + 1] || ' (' || picked || ' of 10)' END
       WHEN picked = 'fever|none' THEN 'None' WHEN picked = 'sweating|bleeding'
         THEN 'Sweating, Bleeding' WHEN picked = 'whole_body' THEN 'Whole body'
       ELSE upper(picked[1]) || picked[2:] END AS verbatim
FROM a""")
def _(v):
    rows = v.ev.selectExpr(
        "event_id",
        "CASE k % 5 WHEN 0 THEN 'hpi.severity' WHEN 1 THEN 'hpi.associated' WHEN 2 THEN "
        "'hpi.site' WHEN 3 THEN 'ros.gi' ELSE 'med.taking' END AS question_id",
        "CASE k % 5 WHEN 0 THEN CAST(event_id % 13 AS STRING) WHEN 1 THEN CASE event_id % 3 "
        "WHEN 0 THEN 'fever|none' WHEN 1 THEN 'sweating|bleeding' ELSE 'unicorn' END WHEN 2 THEN "
        "CASE event_id % 2 WHEN 0 THEN 'whole_body' ELSE 'chest' END WHEN 3 THEN CASE "
        "event_id % 3 WHEN 0 THEN 'jaundice' WHEN 1 THEN '' ELSE 'nausea' END ELSE CASE "
        "event_id % 2 WHEN 0 THEN 'yes' ELSE 'no' END END AS picked")
    split = F.filter(F.split("picked", r"\|"), lambda x: x != "")
    return L.validate_taps(rows.withColumn("picked", split)).select(
        "event_id", "question_id", "reason", F.array_join("recorded", "|").alias("recorded"),
        "verbatim")
