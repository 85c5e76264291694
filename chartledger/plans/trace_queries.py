"""Queries over summary lines and their traceability."""

from pyspark.sql import functions as F

from chartledger.config.rules import ESCALATION_RULES, QUESTIONS
from chartledger.config.vocabulary import STOPWORDS, TEMPLATE_WORDS
from chartledger.functions.text import TOKEN
from chartledger.functions.values import make_value
from chartledger.operators import ledger as L
from chartledger.operators import promotion as M
from chartledger.operators import rules as R
from chartledger.operators import trace as V
from chartledger.plans.bindings import Registry
from chartledger.plans.ledger_queries import _STATUS, facts, live_paths, statuses
from chartledger.plans.rule_queries import _WIDE, proposals

REG = Registry()
query = REG.add

_FIXED = sorted(set(STOPWORDS) | set(TEMPLATE_WORDS) | V.authored_words())
_FIXED_SQL = "(" + ", ".join(f"'{w}'" for w in _FIXED) + ")"
_TOK = "'" + TOKEN.replace("ऀ-෿", "\\x{0900}-\\x{0DFF}") + "'"


def summary(v):
    live = live_paths(v)
    props = proposals(v)
    entries = lambda group: M.repeating_groups(live, group, ["session_id"], ["seq"]).withColumns({
        "code": F.expr("CASE WHEN entry = 0 THEN 'C1' END"), "display": F.lit("coded")})
    people = v.ev.groupBy("session_id").agg(F.min("user_id").alias("u")).selectExpr(
        "session_id", "CASE WHEN u % 5 <> 0 THEN u END AS age_years",
        "CASE u % 3 WHEN 0 THEN 'female' WHEN 1 THEN '' END AS gender")
    papers = v.sfact.filter("document_id IS NOT NULL").groupBy("session_id", "document_id").agg(
        F.count("*").alias("pages"), F.count_if(F.expr("seq % 3 = 0")).alias("low_pages")
    ).selectExpr("session_id", "document_id || '.pdf' AS filename", "pages",
                 "'reader' AS read_by", "0.8125D AS mean_confidence", "low_pages")
    told = v.sfact.filter("tier = 'document'").selectExpr(
        "session_id", "CASE WHEN seq % 4 <> 0 THEN CAST(ts AS DATE) END AS occurred_on",
        "path AS label", "CASE WHEN seq % 5 <> 0 THEN fact_id END AS fact_id",
        "seq % 7 = 0 AS low_confidence")
    return V.summary_lines(
        L.slot_view(facts(v)), statuses(v), props, R.denial_contradictions(live), people,
        entries("medications"), entries("problems"), papers, told)


_RULE_WORDS = "CASE rule_id " + " ".join(
    "WHEN '{}' THEN '{}'".format(r[0], r[2].replace("'", "''")) for r in ESCALATION_RULES) + " END"
_SUMMARY = "WITH " + _STATUS.strip()[len("WITH "):] + """,
label(path, section, label, pos) AS (VALUES """ + ", ".join(
    f"('{q[2]}', '{q[1]}', '{V.field_label(q[2])}', {i})" for i, q in enumerate(QUESTIONS)) + """),
""" + _WIDE.strip()[len("WITH "):] + f""",
std AS (SELECT session_id, path, max_by(fact_id, seq) AS fact_id, max_by(vs, seq) AS vs
  FROM afact WHERE active GROUP BY 1, 2),
done AS (SELECT session_id,
    sum(CASE WHEN status = 'recorded' THEN 1 ELSE 0 END)
      / nullif(sum(CASE WHEN status <> 'not_asked' THEN 1 ELSE 0 END), 0) AS share
  FROM status GROUP BY 1),
lastd AS (SELECT session_id, path, max_by(fact_id, seq) AS fact_id, max_by(vs, seq) AS vs,
     max_by(verbatim, seq) AS verbatim FROM afact WHERE active GROUP BY 1, 2),
deny AS (
  SELECT session_id, 'CX-MED-01' AS rule_id, fact_id, verbatim FROM lastd
    WHERE path = 'drug_allergy.taking_medicines' AND vs = 'false'
  UNION ALL SELECT session_id, 'CX-PMH-01', fact_id, verbatim FROM lastd
    WHERE path = 'past_medical.conditions' AND vs = 'none'),
flagged AS (SELECT session_id, rule_id, lv, unnest(string_split(ps, ',')) AS path
  FROM prop WHERE fired),
people AS (SELECT session_id, min(user_id) AS u FROM ev GROUP BY 1),
lines AS (
  SELECT s.session_id, section, label || ': ' || replace(vs, '|', ', ') AS text, fact_id AS ids,
    'fact' AS kind, NULL AS emphasis, pos AS rank FROM std s JOIN label USING (path)
  UNION ALL SELECT p.session_id, 'red_flags', '[' || upper(p.lv) || '] ' || {_RULE_WORDS},
    coalesce((SELECT string_agg(DISTINCT s.fact_id, ',' ORDER BY s.fact_id) FROM flagged f
     JOIN std s ON s.session_id = f.session_id AND s.path = f.path
     WHERE f.session_id = p.session_id AND f.rule_id = p.rule_id), ''),
    'fact', p.lv, CASE WHEN p.lv = 'immediate' THEN 0 ELSE 1 END FROM prop p WHERE p.fired
  UNION ALL SELECT session_id, 'red_flags',
    'No rule fired. This is no statement that the patient is low priority.', '', 'structural',
    NULL, 0 FROM prop GROUP BY session_id HAVING count(*) FILTER (fired) = 0
  UNION ALL SELECT d.session_id, 'contradictions', d.rule_id || ': patient “' || d.verbatim ||
    '” vs ' || CASE WHEN f.tier = 'document' THEN 'document' ELSE 'patient' END || ' “' ||
    f.verbatim || '”', d.fact_id || ',' || f.fact_id, 'fact', 'unverified', 0
  FROM deny d JOIN afact f ON f.session_id = d.session_id AND f.active
   AND ((d.rule_id = 'CX-MED-01' AND f.path = 'medications[0].name')
     OR (d.rule_id = 'CX-PMH-01' AND f.path = 'problems[1].reported_term'))
  WHERE f.verbatim <> d.verbatim
  UNION ALL SELECT session_id, 'gaps', CASE WHEN status = 'declined'
      THEN 'Patient declined to answer: ' ELSE 'Not asked (' || CAST(count(*) AS VARCHAR) || '): '
      END || string_agg(path, ', ' ORDER BY path), '', 'structural',
    CASE WHEN status = 'declined' THEN 'unverified' END,
    CASE WHEN status = 'declined' THEN 0 ELSE 1 END
  FROM status WHERE status <> 'recorded' GROUP BY session_id, status
  UNION ALL SELECT session_id, 'warnings', 'Only ' ||
    CAST(CAST(round(round(coalesce(share, 0), 4) * 100) AS INT) AS VARCHAR) ||
    '% of the applicable history was captured. Treat the gaps as unknown, not as negative '
    || 'findings.', '', 'structural', 'unverified', 0 FROM done WHERE coalesce(share, 0) < 0.6
  UNION ALL SELECT session_id, 'patient', concat_ws(', ',
    CASE WHEN u % 5 <> 0 AND u > 0 THEN CAST(u AS VARCHAR) || ' years' END,
    CASE WHEN u % 3 = 0 THEN 'female' END), '', 'structural', NULL, 0 FROM people
  WHERE (u % 5 <> 0 AND u > 0) OR u % 3 = 0
  UNION ALL SELECT session_id, 'drug_allergy', 'Medication: ' || vs || ' [C1 coded]', fact_id,
    'fact', NULL, {len(QUESTIONS)} FROM std WHERE path = 'medications[0].name'
  UNION ALL SELECT session_id, 'past_medical', 'Reported: ' || vs || ' [unmapped]', fact_id,
    'fact', NULL, {len(QUESTIONS)} + 1 FROM std WHERE path = 'problems[1].reported_term'
  UNION ALL SELECT session_id, 'documents', document_id || '.pdf: ' || CAST(count(*) AS VARCHAR)
    || ' page(s), read by reader at 81% mean confidence' || CASE WHEN
    count(*) FILTER (seq % 3 = 0) > 0 THEN ' — ' || CAST(count(*) FILTER (seq % 3 = 0) AS VARCHAR)
    || ' page(s) need verification' ELSE '' END, '', 'structural',
    CASE WHEN count(*) FILTER (seq % 3 = 0) > 0 THEN 'unverified' END, 0
  FROM sfact WHERE document_id IS NOT NULL GROUP BY session_id, document_id
  UNION ALL SELECT session_id, 'documents', CASE WHEN seq % 4 <> 0
    THEN CAST(CAST(ts AS DATE) AS VARCHAR) ELSE 'undated' END || ' — ' || path,
    CASE WHEN seq % 5 <> 0 THEN fact_id ELSE '' END,
    CASE WHEN seq % 5 <> 0 THEN 'fact' ELSE 'structural' END,
    CASE WHEN seq % 7 = 0 THEN 'unverified' END, 1 FROM sfact WHERE tier = 'document')
"""


@query("v1_summary_lines", "sfact afact ev absence", _SUMMARY + """
SELECT session_id, section, text, ids, kind, emphasis, rank FROM lines""")
def _(v):
    return summary(v).select("session_id", "section", "text", F.array_join("fact_ids", ",")
                             .alias("ids"), "kind", "emphasis", "rank")


@query("v1_summary_sections", "sfact afact ev absence", _SUMMARY + """
SELECT section, kind, CAST(count(*) AS BIGINT) AS n FROM lines GROUP BY 1, 2""")
def _(v):
    return summary(v).groupBy("section", "kind").agg(F.count("*").alias("n"))


# Lines written from other rows of the table, so that some claims do not trace.
_LINES = r"""
WITH line1 AS (SELECT session_id, seq, CASE WHEN seq % 9 = 0 THEN 'structural' ELSE 'fact' END
     AS kind, CASE WHEN seq % 23 = 0 THEN CAST([] AS VARCHAR[]) WHEN seq % 29 = 0
     THEN [fact_id, 'f-none'] ELSE [fact_id] END AS ids,
   'Patient reports ' || path || ' ' || vs || CASE WHEN seq % 7 = 0 THEN ' unlikely zebra'
     ELSE '' END AS text FROM sfact)
"""


def lines(v):
    text = F.expr("'Patient reports ' || path || ' ' || vs || "
                  "CASE WHEN seq % 7 = 0 THEN ' unlikely zebra' ELSE '' END")
    ids = F.expr("CASE WHEN seq % 23 = 0 THEN CAST(array() AS ARRAY<STRING>) WHEN seq % 29 = 0 "
                 "THEN array(fact_id, 'f-none') ELSE array(fact_id) END")
    kind = F.expr("CASE WHEN seq % 9 = 0 THEN 'structural' ELSE 'fact' END")
    return v.sfact.select("session_id", F.col("seq").alias("line_id"), kind.alias("kind"),
                          ids.alias("fact_ids"), text.alias("text"))


def spoken(v):
    rows = v.sfact.withColumn("value", make_value(F.col("vkind"), F.col("vs")))
    return rows.filter("seq % 3 <> 0")


@query("v2_check_lines", "sfact", _LINES + """
SELECT session_id, seq AS line_id, 'untraced' AS problem, CAST(NULL AS VARCHAR) AS fact_id
FROM line1 WHERE kind = 'fact' AND len(ids) = 0
UNION ALL
SELECT l.session_id, l.seq, 'dangling', x FROM (SELECT *, unnest(ids) AS x FROM line1) l
WHERE kind = 'fact' AND NOT EXISTS (SELECT 1 FROM sfact f WHERE f.fact_id = x
   AND f.session_id = l.session_id AND f.seq % 3 <> 0)""")
def _(v):
    return V.check_lines(lines(v), spoken(v))


_TOKENS = _LINES + f"""
, said AS (SELECT DISTINCT session_id, seq, unnest(regexp_extract_all(lower(text), {_TOK}))
   AS token FROM line1 WHERE kind = 'fact' AND len(ids) > 0),
lic AS (SELECT DISTINCT session_id, unnest(regexp_extract_all(lower(replace(vs, '|', ' ') || ' '
   || verbatim || ' ' || replace(replace(path, '.', ' '), '_', ' ') || ' '
   || coalesce(document_id, '')), {_TOK})) AS token FROM sfact WHERE seq % 3 <> 0),
bad AS (SELECT * FROM said WHERE token NOT IN {_FIXED_SQL} AND NOT EXISTS
  (SELECT 1 FROM lic WHERE lic.session_id = said.session_id AND lic.token = said.token))
"""


@query("v3_check_tokens", "sfact", _TOKENS + """
SELECT session_id, seq AS line_id, token FROM bad""")
def _(v):
    return V.check_tokens(lines(v), spoken(v)).select("session_id", "line_id", "token")


@query("v4_traceability", "sfact", _TOKENS + """
, b AS (SELECT session_id, count(*) AS n, count(*) FILTER (kind = 'fact') AS f,
    count(*) FILTER (kind = 'fact' AND len(ids) = 0) AS u FROM line1 GROUP BY 1),
d AS (SELECT session_id, count(*) AS n FROM (SELECT *, unnest(ids) AS x FROM line1) l
  WHERE kind = 'fact' AND NOT EXISTS (SELECT 1 FROM sfact s WHERE s.fact_id = x
    AND s.session_id = l.session_id AND s.seq % 3 <> 0) GROUP BY 1),
t AS (SELECT session_id, count(*) AS n FROM bad GROUP BY 1)
SELECT session_id, CAST(b.n AS BIGINT) AS lines_checked, CAST(b.f AS BIGINT) AS fact_lines,
  CAST(b.u AS BIGINT) AS untraced, CAST(coalesce(d.n, 0) AS BIGINT) AS dangling,
  CAST(coalesce(t.n, 0) AS BIGINT) AS unsupported,
  b.u + coalesce(d.n, 0) + coalesce(t.n, 0) = 0 AS ok
FROM b LEFT JOIN d USING (session_id) LEFT JOIN t USING (session_id)""")
def _(v):
    return V.traceability(lines(v), spoken(v))


@query("v5_resolve_sources", "sfact", _LINES + """
SELECT l.session_id, l.seq AS line_id, CAST(o - 1 AS INT) AS ordinal, f.fact_id, f.tier, f.verbatim
FROM (SELECT session_id, seq, unnest(ids) AS x, generate_subscripts(ids, 1) AS o FROM line1) l
JOIN sfact f ON f.fact_id = x AND f.session_id = l.session_id AND f.seq % 3 <> 0""")
def _(v):
    return V.resolve_sources(lines(v), spoken(v)).select(
        "session_id", "line_id", "ordinal", "fact_id", "tier", "verbatim")


@query("v3_accept_prose", "sfact", _TOKENS.replace("WITH line1", "WITH line1") + f"""
, sec AS (SELECT session_id, 's' || CAST(seq % 2 AS VARCHAR) AS section,
     count(*) FILTER (kind = 'fact') AS n FROM line1 GROUP BY 1, 2),
word AS (SELECT DISTINCT session_id, section, unnest(regexp_extract_all(lower('the patient said '
   || CASE WHEN length(session_id) % 2 = 0 THEN 'chest sudden' ELSE 'nothing' END), {_TOK}))
   AS token FROM sec),
w AS (SELECT session_id, section, count(*) AS n FROM word WHERE token NOT IN {_FIXED_SQL}
  AND NOT EXISTS (SELECT 1 FROM lic WHERE lic.session_id = word.session_id
     AND lic.token = word.token) GROUP BY 1, 2)
SELECT session_id, section, CASE WHEN section = 's1' THEN 'section_not_allowed'
  WHEN sec.n < 3 THEN 'too_few_lines' WHEN w.n > 0 THEN 'unsupported_words' END AS reason
FROM sec LEFT JOIN w USING (session_id, section)""")
def _(v):
    rows = lines(v).withColumn("section", F.concat(F.lit("s"), F.expr("line_id % 2")))
    text = F.expr("'the patient said ' || CASE WHEN length(session_id) % 2 = 0 "
                  "THEN 'chest sudden' ELSE 'nothing' END")
    prose = rows.select("session_id", "section").distinct().withColumn("text", text)
    return V.accept_prose(prose, rows, spoken(v), ["s0"])
