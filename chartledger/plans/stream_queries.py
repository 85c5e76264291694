"""Streaming jobs run over a given table to its end, compared with their batch forms."""

from pyspark.sql import functions as F

from chartledger.functions.values import make_value
from chartledger.operators.rules import route_spoken
from chartledger.plans.bindings import VIEWS, Registry, Views
from chartledger.plans.ledger_queries import _DIGEST, _JUDGED, scopes, span_of
from chartledger.plans.rule_queries import _WIDE
from chartledger.streaming import jobs as K

REG = Registry()
query = REG.add

_EVENTS = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
           "props string")


def event_stream(v: Views):
    """The events table as a file stream, in the shape of the `ev` view."""
    raw = v.spark.readStream.schema(_EVENTS).option("pathGlobFilter", "events*.parquet").parquet(
        v.sf_dir)
    return raw.withColumns({
        "day": F.expr("CAST(ts AS DATE)"),
        "k": F.expr("CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"),
        "session_id": F.expr("CAST(user_id AS STRING) || '-' || "
                             "CAST(extract(week FROM ts) AS STRING)"),
    })


def _from_view(stream, name):
    """Apply the projection of a view that reads only `ev` to a stream."""
    body = VIEWS[name][1].strip()
    columns = body[len("SELECT"):body.rindex("FROM ev")]
    return stream.selectExpr(*_split(columns))


def _split(columns: str) -> list[str]:
    out, depth, quoted, start = [], 0, False, 0
    for i, ch in enumerate(columns):
        if ch == "'":
            quoted = not quoted
        elif not quoted:
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                out.append(columns[start:i])
                start = i + 1
    return [c.strip() for c in [*out, columns[start:]]]


def candidate_stream(v):
    rows = _from_view(event_stream(v), "cand").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withColumn("value", make_value(F.col("vkind"), F.col("vs")))
    return span_of(rows).withColumn("coded", F.expr("seq % 10 = 3"))


@query("k1_stream_admit", "cand scope", _JUDGED + """
SELECT fact_id, path, coalesce(reason, 'accepted') AS outcome FROM judged""")
def _(v):
    folder = K.work_folder(v.spark, "k1")
    K.start_admission(K.stream_admit(candidate_stream(v), scopes(v)).select(
        "fact_id", "path", "outcome"), folder).awaitTermination()
    return v.spark.read.schema("fact_id string, path string, outcome string").parquet(
        f"{folder}/judged/*/*")


@query("k2_stream_dedupe", "cand scope", _JUDGED + "," + _DIGEST + """
SELECT DISTINCT session_id, path, digest FROM dig""")
def _(v):
    judged = K.stream_admit(candidate_stream(v), scopes(v)).filter("outcome = 'accepted'")
    rows = K.stream_dedupe(judged, "40 days").select("session_id", "path", "digest")
    return K.run_to_table(rows, K.work_folder(v.spark, "k2"))


# The priorities of the batch form, without any earlier priority.
_TOP = _WIDE + """
, top AS (SELECT session_id, max(CASE WHEN fired THEN CASE lv WHEN 'immediate' THEN 2 ELSE 1 END
       ELSE 0 END) AS n FROM prop GROUP BY 1)
"""


def run_priority(v):
    folder = K.work_folder(v.spark, "k3")
    facts = candidate_stream(v).filter("vs IS NOT NULL")
    K.start_priority(*K.stream_values(facts), folder).awaitTermination()
    return folder


@query("k3_stream_priority", "afact", _TOP + """
SELECT session_id, CASE n WHEN 2 THEN 'immediate' WHEN 1 THEN 'urgent' ELSE 'routine' END
  AS priority FROM top""")
def _(v):
    return K.read_priorities(v.spark, run_priority(v))


@query("k5_stream_queue", "afact", _TOP + """
SELECT CASE n WHEN 2 THEN 'immediate' WHEN 1 THEN 'urgent' ELSE 'routine' END AS priority,
  CAST(count(*) AS BIGINT) AS sessions FROM top GROUP BY 1""")
def _(v):
    folder = run_priority(v)
    moves = v.spark.readStream.schema(
        "session_id string, from_priority int, to_priority int").parquet(f"{folder}/priority")
    return K.run_to_table(K.stream_queue(moves), f"{folder}/queue", "complete")


def _ended(v, **form):
    rows = event_stream(v).withColumn("ts", F.col("ts").cast("timestamp"))
    out = K.run_to_table(K.stream_expiry(rows, **form), K.work_folder(v.spark, "k4"))
    return out.select("session_id", F.expr(
        "rtrim('.', rtrim('0', date_format(started_at, 'yyyy-MM-dd HH:mm:ss.SSSSSS')))")
        .alias("started_at"), "rows")


@query("k4_stream_expiry", "ev", """
WITH o AS (SELECT session_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3600 SECOND THEN 0
     ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts) AS grp FROM o),
s AS (SELECT session_id, grp, min(ts) AS a, max(ts) + INTERVAL 3600 SECOND AS b, count(*) AS n
   FROM g GROUP BY 1, 2)
SELECT session_id, CAST(a AS VARCHAR) AS started_at, CAST(n AS BIGINT) AS "rows" FROM s
WHERE b <= (SELECT max(ts) FROM ev) - INTERVAL 10 MINUTE""")
def _(v):
    return _ended(v)


# A session's first row opens a day; the first row behind that day opens the next one.
@query("k4_fixed_expiry", "ev", """
WITH RECURSIVE s(session_id, a) AS (
  SELECT session_id, min(ts) FROM ev GROUP BY 1
  UNION ALL
  SELECT s.session_id, (SELECT min(ts) FROM ev WHERE ev.session_id = s.session_id
    AND ev.ts >= s.a + INTERVAL 86400 SECOND) FROM s WHERE s.a IS NOT NULL)
SELECT s.session_id, CAST(a AS VARCHAR) AS started_at, CAST(count(*) AS BIGINT) AS "rows"
FROM s JOIN ev ON ev.session_id = s.session_id AND ev.ts >= s.a
  AND ev.ts < s.a + INTERVAL 86400 SECOND
WHERE a + INTERVAL 86400 SECOND <= (SELECT max(ts) FROM ev) - INTERVAL 10 MINUTE
GROUP BY 1, 2""")
def _(v):
    return _ended(v, ttl_seconds=86400, fixed=True)


@query("k6_stream_rates", "ev", """
WITH r AS (SELECT date_trunc('hour', ts) AS h, CASE k % 2 WHEN 0 THEN 'hpi.onset'
     ELSE 'hpi.timing' END AS question_id, CASE WHEN k % 10 = 0 THEN 'silence'
     WHEN k % 7 = 0 AND k % 2 = 0 THEN 'unmeasured' WHEN k % 7 <> 0 AND k < 62 THEN 'unclear'
     END AS reason FROM ev)
SELECT CAST(h AS VARCHAR) AS window_start, question_id, CAST(count(*) AS BIGINT) AS turns,
  CAST(count(reason) AS BIGINT) AS degraded, round(count(reason) / count(*), 4) AS degraded_rate
FROM r WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ev) - INTERVAL 10 MINUTE GROUP BY 1, 2""")
def _(v):
    turns = event_stream(v).selectExpr(
        "CAST(ts AS TIMESTAMP) AS ts",
        "CASE k % 2 WHEN 0 THEN 'hpi.onset' ELSE 'hpi.timing' END AS question_id",
        "CASE WHEN k % 10 = 0 THEN ' ' ELSE event_type END AS text",
        "CASE WHEN k % 7 <> 0 THEN k / 100D END AS asr_confidence", "1 AS slots_found")
    out = K.run_to_table(K.stream_rates(route_spoken(turns)), K.work_folder(v.spark, "k6"))
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
