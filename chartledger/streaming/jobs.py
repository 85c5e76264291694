"""Structured Streaming forms of admission, deduplication, escalation, expiry and rates.

Each `stream_*` function takes streaming frames and returns a streaming frame; `start_*` attaches
a sink. All state lives in Spark's state store or in tables under a shared work folder, so a job
that loses an executor goes on from its checkpoint.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chartledger.config.rules import ESCALATION_RULES
from chartledger.config.vocabulary import PRIORITIES, SESSION_TTL_SECONDS
from chartledger.functions.evidence import span_digest
from chartledger.operators.ledger import judge_facts
from chartledger.streaming.sessions import (
    ExpiryProcessor,
    PriorityProcessor,
    RuleTable,
    marked_facts,
    use_rocks,
)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run, in the shared folder the cluster names.

    Only a local session without ``spark.checkpoint.dir`` may use a folder of its own machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="run-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stream_admit(candidates: DataFrame, scopes: DataFrame) -> DataFrame:
    """Judge candidate facts as they arrive: `outcome` is accepted or the reason for refusal.

    ``scopes`` is a static frame, read again with every batch.
    """
    judged = judge_facts(candidates, scopes)
    return judged.withColumn("outcome", F.coalesce("reason", F.lit("accepted"))).drop("reason")


def start_admission(judged: DataFrame, folder: str) -> StreamingQuery:
    """Write accepted facts and rejected candidates to two tables, each batch exactly once.

    A batch writes its own folder and overwrites it when it is retried.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        side = F.when(F.col("outcome") == "accepted", "accepted").otherwise("rejected")
        batch.withColumn("side", side).write.mode("overwrite").partitionBy("side").parquet(
            f"{folder}/judged/batch={batch_id}")

    return (
        judged.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/_state")
        .trigger(availableNow=True).start()
    )


def stream_dedupe(facts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row per (session, path, span digest) among rows no further apart than the delay."""
    keyed = facts.withColumn("digest", span_digest(F.col("span")))
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(
        ["session_id", "path", "digest"])


def stream_values(facts: DataFrame, rules=ESCALATION_RULES) -> tuple[DataFrame, RuleTable]:
    """Facts with the numbers of the rule conditions their values meet, and the rules over those
    numbers.

    Every session with a fact goes on, also one that no rule reads anything of. The order of facts
    is (ts, seq), so a late fact never replaces a newer one. Rows without a session are left out.
    """
    table = RuleTable(rules)
    return marked_facts(facts, table), table


def stream_priority(marked: DataFrame, table: RuleTable) -> DataFrame:
    """Each session's priority, never lowered: one row per increase, the first one from null.

    State is one row a session, as wide as the fixed list of rule paths.
    """
    use_rocks(marked)
    return marked.groupBy("session_id").transformWithState(
        PriorityProcessor(table), PriorityProcessor.OUT, "Append", "None")


def start_priority(marked: DataFrame, table: RuleTable, folder: str) -> StreamingQuery:
    """Append each session's increases to a table; ``marked`` and ``table`` are from
    `stream_values`. Started again on the same folder, it goes on from its state."""
    return (
        stream_priority(marked, table).writeStream.format("parquet")
        .option("path", f"{folder}/priority").option("checkpointLocation", f"{folder}/_state")
        .trigger(availableNow=True).start()
    )


def read_priorities(spark: SparkSession, folder: str) -> DataFrame:
    """The current priority of each session, from the table of increases."""
    rows = spark.read.schema(PriorityProcessor.OUT).parquet(f"{folder}/priority")
    top = rows.groupBy("session_id").agg(F.max("to_priority").alias("_n"))
    names = F.array(*[F.lit(p) for p in PRIORITIES])
    return top.select("session_id", F.get(names, F.col("_n")).alias("priority"))


def stream_queue(increases: DataFrame) -> DataFrame:
    """Sessions per priority, from a stream of increases: each leaves one level for another.

    Use complete output mode.
    """
    moves = F.array_compact(F.array(
        F.struct(F.col("to_priority").alias("level"), F.lit(1).alias("step")),
        F.when(F.col("from_priority").isNotNull(),
               F.struct(F.col("from_priority").alias("level"), F.lit(-1).alias("step"))),
    ))
    names = F.array(*[F.lit(p) for p in PRIORITIES])
    return (
        increases.select(F.explode(moves).alias("m"))
        .groupBy(F.get(names, F.col("m.level")).alias("priority"))
        .agg(F.sum("m.step").alias("sessions"))
    )


def stream_expiry(
    events: DataFrame, ttl_seconds: int = SESSION_TTL_SECONDS, delay: str = "10 minutes",
    fixed: bool = False,
) -> DataFrame:
    """Sessions that ended, once nothing on time can extend them; append mode.

    A session ends ``ttl_seconds`` after its last row or, with ``fixed``, after its first one; a
    later row begins a new one. Rows later than the delay are dropped. A timer per session removes
    its state at its end. Rows without a session or a time are left out.
    """
    use_rocks(events)
    rows = events.filter("session_id IS NOT NULL AND ts IS NOT NULL").select("session_id", "ts")
    ended = rows.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts")).groupBy(
        "session_id").transformWithState(
            ExpiryProcessor(ttl_seconds, fixed), ExpiryProcessor.OUT, "Append", "EventTime")
    return ended.select("session_id", F.timestamp_micros("started_at").alias("started_at"),
                        F.timestamp_micros("expired_at").alias("expired_at"), "rows")


def stream_rates(routed: DataFrame, window: str = "1 hour", delay: str = "10 minutes"
                 ) -> DataFrame:
    """Accepted and degraded turns per question and window; append mode.

    ``routed`` is `route_spoken` with the event time `ts`.
    """
    grouped = routed.withWatermark("ts", delay).groupBy(F.window("ts", window), "question_id")
    return grouped.agg(
        F.count(F.lit(1)).alias("turns"), F.count("reason").alias("degraded"),
    ).select(F.col("window.start").alias("window_start"), "question_id", "turns", "degraded",
             F.round(F.col("degraded") / F.col("turns"), 4).alias("degraded_rate"))


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return its output table.

    Append output goes to a file sink. Complete output replaces the table with every batch.
    """
    spark = stream.sparkSession
    out = f"{folder}/out"
    writer = stream.writeStream.outputMode(mode).option(
        "checkpointLocation", f"{folder}/_state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(
            lambda df, _i: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
