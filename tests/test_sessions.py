"""The stateful streaming jobs over several batches, restarts and late rows."""

import datetime as dt

from pyspark.sql import functions as F

from chartledger.functions.values import make_value
from chartledger.operators import rules as R
from chartledger.plans.bindings import Views
from chartledger.streaming import jobs as K
from chartledger.streaming import sessions as S

START = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, steps, **form):
    """Batches of (session, second) rows; the ended sessions and the state rows after each."""
    source, folder = str(tmp_path / "in"), K.work_folder(spark, "k4test")
    kept, states = [], []
    for step in steps:
        rows = [(s, START + dt.timedelta(seconds=n)) for s, n in step]
        spark.createDataFrame(rows, "session_id string, ts timestamp").coalesce(1).write.mode(
            "append").parquet(source)
        stream = K.stream_expiry(spark.readStream.schema("session_id string, ts timestamp").parquet(
            source), **form)
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option(
            "checkpointLocation", f"{folder}/_state").trigger(availableNow=True).start()
        query.awaitTermination()
        states.append(query.lastProgress.stateOperators[0].numRowsTotal)
        kept = sorted((r.session_id, int((r.started_at - START).total_seconds()),
                       int((r.expired_at - START).total_seconds()), r.rows)
                      for r in spark.read.parquet(f"{folder}/out").collect())
    return kept, states


def test_inactivity_over_batches_late_rows_and_state(spark, tmp_path):
    steps = [[("a", 0), ("b", 10), ("a", 50)],       # both open
             [("a", 90), ("a", 40), ("c", 130)],     # a is extended twice, b is not
             [("z", 2000)],                          # everything before has ended
             [("a", 5), ("z", 2001), (None, 2002)]]  # too late: dropped
    ended, states = run(spark, tmp_path, steps, ttl_seconds=100, delay="30 seconds")
    assert ended == [("a", 0, 190, 4), ("b", 10, 110, 1), ("c", 130, 230, 1)]
    # State rows fall when sessions end: only z and its timer are left.
    assert states[1] > states[2] == states[3]


def test_fixed_lifetime(spark, tmp_path):
    steps = [[("a", 0), ("a", 60)], [("a", 99), ("a", 100), ("b", 150)], [("z", 5000)]]
    ended, _states = run(spark, tmp_path, steps, ttl_seconds=100, delay="60 seconds", fixed=True)
    assert ended == [("a", 0, 100, 3), ("a", 100, 200, 1), ("b", 150, 250, 1)]


def test_priority_in_batches_with_restarts_equals_the_batch_form(spark, tmp_path):
    """Facts in shuffled batches, the query started anew for each, against `escalate`."""
    facts = Views(spark, "/root/testdata/sf0.001").afact.select(
        "session_id", "seq", "path", F.col("ts").cast("timestamp").alias("ts"),
        make_value(F.col("vkind"), F.col("vs")).alias("value")).filter("value IS NOT NULL")
    source, folder = str(tmp_path / "in"), K.work_folder(spark, "k3test")
    parts = facts.withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(4)))
    first = True
    for part in (2, 0, 3, 1):
        parts.filter(F.col("part") == part).drop("part").coalesce(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = K.start_priority(*K.stream_values(stream), folder)
        query.awaitTermination()
        first = first and query.exception() is None
    assert first
    steps = spark.read.parquet(f"{folder}/priority").collect()
    last = {}
    for r in sorted(steps, key=lambda r: r.to_priority):
        assert r.from_priority is None or r.from_priority < r.to_priority
        assert last.get(r.session_id) == r.from_priority
        last[r.session_id] = r.to_priority
    # Replaying the same values in one batch can only end lower or equal: a priority never falls.
    top = {r.session_id: r.priority for r in R.escalate(R.evaluate_rules(
        facts, order=("ts", "seq"))).collect()}
    got = {r.session_id: r.priority for r in K.read_priorities(spark, folder).collect()}
    names = list(K.PRIORITIES)
    assert set(got) == set(top)
    assert all(names.index(got[s]) >= names.index(top[s]) for s in top)


def test_rule_table_equals_evaluated_rules(spark):
    """Numbers of held conditions give the same priority as the rules on one wide row."""
    facts = Views(spark, "/root/testdata/sf0.001").afact.select(
        "session_id", "seq", "path", F.col("ts").cast("timestamp").alias("ts"),
        make_value(F.col("vkind"), F.col("vs")).alias("value")).filter("value IS NOT NULL")
    table = S.RuleTable()
    last = {}
    for r in S.marked_facts(facts, table).collect():
        told = last.setdefault(r.session_id, {})
        if r.path is not None and (r.path not in told or (r.at, r.seq) >= told[r.path][:2]):
            told[r.path] = (r.at, r.seq, frozenset(r.held))
    got = {s: table.priority({p: h for p, (_t, _s, h) in told.items()}) for s, told in last.items()}
    want = {r.session_id: list(K.PRIORITIES).index(r.priority) for r in R.escalate(
        R.evaluate_rules(facts, order=("ts", "seq"))).collect()}
    assert got == want and len(set(want.values())) > 1
