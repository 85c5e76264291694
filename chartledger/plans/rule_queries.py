"""Queries over escalation, contradiction, branching and routing rules."""

from pyspark.sql import functions as F

from chartledger.config.rules import ESCALATION_RULES, QUESTIONS
from chartledger.functions.values import make_value
from chartledger.operators import ledger as L
from chartledger.operators import rules as R
from chartledger.plans.bindings import Registry
from chartledger.plans.ledger_queries import facts, live_paths

REG = Registry()
query = REG.add


def _sql_condition(cond) -> str:
    """One condition over the columns of `wide` (a text per path, | between list elements)."""
    path, op, arg = cond
    col = '"' + path + '"'
    if op == "gte":
        return f"coalesce(try_cast({col} AS DOUBLE) >= {arg}, false)"
    wanted = arg if isinstance(arg, list) else [arg]
    return "(" + " OR ".join(
        f"coalesce('|' || {col} || '|' LIKE '%|{w}|%', false)" for w in wanted) + ")"


_PATHS = sorted({c[0] for r in ESCALATION_RULES for cl in r[3] for c in cl})
_WIDE = "WITH wide AS (SELECT session_id, " + ", ".join(
    f"max_by(CASE WHEN path = '{p}' THEN vs END, CASE WHEN path = '{p}' THEN seq END) AS \"{p}\""
    for p in _PATHS) + " FROM afact WHERE active GROUP BY session_id),\nprop AS (\n" + \
    "\nUNION ALL\n".join(
        f"SELECT session_id, '{r[0]}' AS rule_id, "
        + "(" + " OR ".join("(" + " AND ".join(_sql_condition(c) for c in cl) + ")"
                            for cl in r[3]) + ")"
        + f" AS fired, '{r[1]}' AS lv, array_to_string(list_sort(list_distinct(list_filter(["
        + ", ".join(f"CASE WHEN {_sql_condition(c)} THEN '{c[0]}' END"
                    for cl in r[3] for c in cl)
        + "], lambda x: x IS NOT NULL))), ',') AS ps FROM wide" for r in ESCALATION_RULES) + ")\n"


def proposals(v):
    return R.evaluate_rules(live_paths(v))


@query("r1_evaluate_rules", "afact", _WIDE + """
SELECT session_id, rule_id, fired, CASE WHEN fired THEN lv END AS level,
       CASE WHEN fired THEN ps ELSE '' END AS paths FROM prop""")
def _(v):
    return proposals(v).select("session_id", "rule_id", "fired", "level",
                               F.array_join("paths", ",").alias("paths"))


@query("r2_escalate", "afact", _WIDE + """
, top AS (SELECT session_id, max(CASE WHEN fired THEN CASE lv WHEN 'immediate' THEN 2 ELSE 1 END
       ELSE 0 END) AS n, count(*) FILTER (fired AND lv = 'immediate') AS im,
       count(*) FILTER (fired AND lv = 'urgent') AS ur FROM prop GROUP BY 1)
SELECT session_id, CASE greatest(n, CASE WHEN length(session_id) = 4 THEN 1 ELSE 0 END)
     WHEN 2 THEN 'immediate' WHEN 1 THEN 'urgent' ELSE 'routine' END AS priority,
     CAST(im AS BIGINT) AS immediate_count, CAST(ur AS BIGINT) AS urgent_count FROM top""")
def _(v):
    now = v.scope.selectExpr(
        "session_id", "CASE WHEN length(session_id) = 4 THEN 'urgent' ELSE 'routine' END "
        "AS priority")
    return R.escalate(proposals(v), now)


@query("r3_rule_triggers", "afact", _WIDE + """
SELECT p.session_id, p.rule_id, f.path, f.fact_id FROM prop p
JOIN afact f ON f.session_id = p.session_id AND f.active
  AND list_contains(string_split(p.ps, ','), f.path)
WHERE p.fired""")
def _(v):
    return R.rule_triggers(proposals(v), live_paths(v)).select(
        "session_id", "rule_id", "path", "fact_id")


@query("r4_adjudicate_candidates", "afact ev", _WIDE + """
, c AS (SELECT event_id, session_id, CASE k % 4 WHEN 0 THEN 'RF-OBS-01' WHEN 1 THEN 'RF-CARD-01'
     WHEN 2 THEN 'RF-FAKE-9' ELSE 'RF-PAIN-01' END AS rule_id FROM ev)
SELECT c.event_id, c.session_id, c.rule_id, coalesce(p.fired, false) AS fired,
   CASE WHEN p.fired THEN p.lv END AS level,
   CASE WHEN c.rule_id = 'RF-FAKE-9' THEN 'unknown_rule'
        WHEN coalesce(p.fired, false) THEN 'already_fired' ELSE 'not_holding' END AS outcome
FROM c LEFT JOIN prop p ON p.session_id = c.session_id AND p.rule_id = c.rule_id""")
def _(v):
    c = v.ev.selectExpr(
        "event_id", "session_id", "CASE k % 4 WHEN 0 THEN 'RF-OBS-01' WHEN 1 THEN 'RF-CARD-01' "
        "WHEN 2 THEN 'RF-FAKE-9' ELSE 'RF-PAIN-01' END AS rule_id")
    return R.adjudicate_candidates(c, proposals(v))


@query("r5_running_priority", "ev", """
WITH e AS (SELECT session_id, event_id AS seq, CASE WHEN k % 50 = 0 THEN 2 WHEN k % 10 = 1 THEN 1
     ELSE 0 END AS n FROM ev),
r AS (SELECT *, max(n) OVER (PARTITION BY session_id ORDER BY seq) AS run FROM e)
SELECT session_id, seq, CASE run WHEN 2 THEN 'immediate' WHEN 1 THEN 'urgent' ELSE 'routine' END
   AS priority, n < run AS deescalation_attempt FROM r""")
def _(v):
    e = v.ev.selectExpr(
        "session_id", "event_id AS seq", "CASE WHEN k % 50 = 0 THEN 'immediate' "
        "WHEN k % 10 = 1 THEN 'urgent' ELSE 'routine' END AS proposed")
    return R.running_priority(e).select("session_id", "seq", "priority", "deescalation_attempt")


def people(v):
    """One row per session with the demographics the branch conditions read."""
    return v.ev.groupBy("session_id").agg(F.min("user_id").alias("u")).selectExpr(
        "session_id", "CASE WHEN u % 2 = 0 THEN 'female' ELSE 'male' END AS gender",
        "CAST(u % 70 AS INT) AS age_years")


def declined(v):
    return v.ev.filter("k % 3 = 0").selectExpr(
        "session_id", "CASE k % 2 WHEN 0 THEN 'hpi.timing' ELSE 'ph.diet' END AS question_id")


_NOT_PAIN = "coalesce(cc NOT IN ('fever','cough','weakness','skin','checkup'), true)"
_OPEN = f"""
WITH d AS (SELECT session_id, min(user_id) AS u FROM ev GROUP BY 1),
w AS (SELECT d.session_id, u,
   max_by(CASE WHEN path='hpi.site' THEN vs END, CASE WHEN path='hpi.site' THEN seq END) AS site,
   max_by(CASE WHEN path='drug_allergy.taking_medicines' THEN vs END,
          CASE WHEN path='drug_allergy.taking_medicines' THEN seq END) AS taking,
   CAST(NULL AS VARCHAR) AS cc,
   list(DISTINCT path) FILTER (path IS NOT NULL) AS done
   FROM d LEFT JOIN afact f ON f.session_id = d.session_id AND f.active GROUP BY 1, 2),
ref AS (SELECT session_id, list(DISTINCT CASE k % 2 WHEN 0 THEN 'hpi.timing' ELSE 'ph.diet' END)
   AS refused FROM ev WHERE k % 3 = 0 GROUP BY 1),
q(question_id, section, path, gate) AS (VALUES {', '.join(
    f"('{q[0]}', '{q[1]}', '{q[2]}', '" + (
        'always' if not q[6] else 'character' if q[0] == 'hpi.character'
        else 'radiation' if q[0] == 'hpi.radiation' else 'taking' if q[0] == 'med.list'
        else 'pregnancy' if q[0] == 'ph.pregnancy' else 'never') + "')" for q in QUESTIONS)}),
opened AS (
 SELECT w.session_id, q.question_id, q.section,
   CASE gate WHEN 'always' THEN true WHEN 'never' THEN false
     WHEN 'character' THEN site IS NOT NULL AND {_NOT_PAIN}
     WHEN 'radiation' THEN coalesce(site IN ('chest','abdomen','back','head'), false)
                           AND {_NOT_PAIN}
     WHEN 'taking' THEN coalesce(taking = 'true', false)
     ELSE u % 2 = 0 AND u % 70 >= 12 AND u % 70 <= 55 END AS open,
   coalesce(list_contains(done, q.path), false)
     OR coalesce(list_contains(refused, q.question_id), false) AS answered
 FROM w CROSS JOIN q LEFT JOIN ref ON ref.session_id = w.session_id)
"""


@query("r6_open_questions", "ev afact", _OPEN + """
SELECT session_id, question_id, open, answered FROM opened""")
def _(v):
    return R.open_questions(live_paths(v), declined(v), people(v)).select(
        "session_id", "question_id", "open", "answered")


@query("r6_progress", "ev afact", _OPEN + """
SELECT session_id, CAST(count(*) FILTER (open AND answered) AS BIGINT) AS answered,
   CAST(count(*) FILTER (open) AS BIGINT) AS askable,
   CAST(round_even(100.0 * count(*) FILTER (open AND answered) / count(*) FILTER (open), 0) AS INT)
     AS percent
FROM opened GROUP BY 1""")
def _(v):
    return R.progress(R.open_questions(live_paths(v), declined(v), people(v)))


@query("r6_section_progress", "ev afact", _OPEN + """
SELECT session_id, section, CAST(count(*) FILTER (open AND answered) AS BIGINT) AS answered,
   CAST(count(*) FILTER (open) AS BIGINT) AS askable,
   count(*) FILTER (open) > 0 AND count(*) FILTER (open AND answered) = count(*) FILTER (open)
     AS complete
FROM opened GROUP BY 1, 2""")
def _(v):
    return R.progress(R.open_questions(live_paths(v), declined(v), people(v)), by_section=True)


@query("r7_derive_values", "ev", """
WITH a AS (SELECT session_id, max_by(CASE WHEN k % 9 = 0 THEN 'unknown' ELSE CAST(k AS VARCHAR) END,
     event_id) AS t FROM ev GROUP BY 1)
SELECT session_id, 'ayush.vaya' AS path, CASE WHEN CAST(t AS DOUBLE) < 16 THEN 'balya'
   WHEN CAST(t AS DOUBLE) < 60 THEN 'madhya' ELSE 'vriddha' END AS value_text
FROM a WHERE try_cast(t AS DOUBLE) IS NOT NULL""")
def _(v):
    rows = v.ev.select(
        "session_id", F.col("event_id").alias("seq"),
        F.lit("demographics.age_years").alias("path"),
        make_value(F.lit("text"), F.expr(
            "CASE WHEN k % 9 = 0 THEN 'unknown' ELSE CAST(k AS STRING) END")).alias("value"))
    # The latest row decides even when it is not a number, so nulls must count as latest.
    return R.derive_values(rows)


@query("r8_denial_contradictions", "afact", """
WITH last AS (SELECT session_id, path, max_by(fact_id, seq) AS fact_id, max_by(vs, seq) AS vs,
     max_by(verbatim, seq) AS verbatim FROM afact WHERE active GROUP BY 1, 2),
deny AS (
  SELECT session_id, 'CX-MED-01' AS rule_id, fact_id, verbatim FROM last
    WHERE path = 'drug_allergy.taking_medicines' AND vs = 'false'
  UNION ALL SELECT session_id, 'CX-PMH-01', fact_id, verbatim FROM last
    WHERE path = 'past_medical.conditions' AND vs = 'none'),
j AS (SELECT d.session_id, d.rule_id, d.fact_id AS denial_fact, f.fact_id AS other_fact
  FROM deny d JOIN afact f ON f.session_id = d.session_id AND f.active
   AND ((d.rule_id = 'CX-MED-01' AND f.path = 'medications[0].name')
     OR (d.rule_id = 'CX-PMH-01' AND f.path = 'problems[1].reported_term'))
  WHERE f.verbatim <> d.verbatim)
SELECT *, 'cx_' || substr(sha256(rule_id || '|' || denial_fact || '|' || other_fact), 1, 10)
   AS contradiction_id FROM j""")
def _(v):
    return R.denial_contradictions(live_paths(v)).select(
        "session_id", "rule_id", "denial_fact", "other_fact", "contradiction_id")


@query("r9_cross_tier_contradictions", "sfact", """
WITH f AS (SELECT session_id, path, tier, min_by(fact_id, seq) AS fact_id, min_by(vs, seq) AS vs
  FROM sfact WHERE path = 'hpi.severity' GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, path ORDER BY tier) AS rn FROM f)
SELECT a.session_id, a.path, a.tier AS first_tier, b.tier AS second_tier,
   a.fact_id AS first_fact, b.fact_id AS second_fact,
   'cx_' || substr(sha256('CX-VALUE|' || a.fact_id || '|' || b.fact_id), 1, 10) AS contradiction_id
FROM n a JOIN n b ON a.session_id = b.session_id AND a.path = b.path AND a.rn = 1 AND b.rn = 2
WHERE a.vs <> b.vs""")
def _(v):
    return R.cross_tier_contradictions(facts(v))


_CRITICAL = "('" + "','".join(q[0] for q in QUESTIONS if q[5]) + "')"
_ROUTED = f"""
WITH r AS (SELECT conv_id, turn, question_id, CASE
   WHEN trim(CASE WHEN turn = 3 THEN ' ' ELSE text END) = '' THEN 'silence'
   WHEN asr_confidence IS NULL AND question_id IN {_CRITICAL} THEN 'unmeasured'
   WHEN asr_confidence < 0.62 THEN 'unclear'
   WHEN (conv_id + turn) % 7 = 0 THEN 'unclear' END AS reason FROM talk WHERE role <> 'system')
"""


def routed(v):
    turns = v.talk.filter("role <> 'system'").withColumns({
        "text": F.expr("CASE WHEN turn = 3 THEN ' ' ELSE text END"),
        "slots_found": F.expr("CASE WHEN (conv_id + turn) % 7 = 0 THEN 0 ELSE 1 END"),
    })
    return R.route_spoken(turns)


@query("r10_route_spoken", "talk", _ROUTED + """
SELECT conv_id, turn, coalesce(reason, 'accepted') AS outcome FROM r""")
def _(v):
    return routed(v).select("conv_id", "turn",
                            F.coalesce("reason", F.lit("accepted")).alias("outcome"))


@query("r10_route_rates", "talk", _ROUTED + """
SELECT question_id, CAST(count(*) AS BIGINT) AS turns,
  CAST(count(*) FILTER (reason IS NULL) AS BIGINT) AS accepted,
  CAST(count(*) FILTER (reason = 'silence') AS BIGINT) AS silence,
  CAST(count(*) FILTER (reason = 'unmeasured') AS BIGINT) AS unmeasured,
  CAST(count(*) FILTER (reason = 'unclear') AS BIGINT) AS unclear,
  round(count(reason) / count(*), 4) AS degraded_rate
FROM r GROUP BY 1""")
def _(v):
    return R.route_rates(routed(v), ["question_id"])
