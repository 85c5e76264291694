"""Documents, chains, terms, summaries, sinks and streams on small tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from chartledger.functions.values import make_value
from chartledger.operators import extraction as X
from chartledger.operators import governance as A
from chartledger.operators import rules as R
from chartledger.operators import terms as T
from chartledger.operators import utterances as U
from chartledger.sources import bundles as B
from chartledger.sources import records as S
from chartledger.streaming import jobs as K

LINES = [
    ("TAB. METFORMIN 500mg 1-0-1 x 30 days", "medication", "METFORMIN"),
    ("Amlodipine 5 mg OD", "medication", "Amlodipine"),
    ("Syrup Paracetamol 5 ml SOS", "medication", "Paracetamol"),
    ("HbA1c: 8.2 % (4.0 - 5.6)", "investigation", "HbA1c"),
    ("Total Cholesterol 240 mg/dL < 200", "investigation", "Total Cholesterol"),
    ("Date 12 OD", None, None), ("Diagnosis: Type 2 diabetes.", "diagnosis", "Type 2 diabetes"),
    ("s/p appendicectomy 2015", "procedure", "appendicectomy 2015"), ("Hello there", None, None),
]


def lines(spark):
    rows = [("d", 1, i, t, 0.95, False) for i, (t, _k, _l) in enumerate(LINES)]
    return spark.createDataFrame(rows, "doc_id string, page int, line_no int, text string, "
                                       "confidence double, handwritten boolean")


def test_entities(spark):
    got = {r.line_no: r for r in X.extract_entities(lines(spark), "'female'").collect()}
    assert {i: (r.kind, r.label) for i, r in got.items()} == {
        i: (k, label) for i, (_t, k, label) in enumerate(LINES) if k}
    first = got[0]
    assert (first.form, first.dose, first.frequency, first.duration) == (
        "TAB", "500mg", "2× daily (morning, night)", "30 days")
    assert (got[3].range_flag, got[3].reference_high, got[3].range_source) == ("high", 5.6, "report")
    assert (got[4].range_flag, got[4].reference_low, got[4].analyte_key) == (
        "high", None, "total_cholesterol")


def test_negation_and_order(spark):
    lexicon = {"hpi.character": {"sharp": ["sharp"], "pressure": ["pressure", "heavy"]}}
    rows = spark.createDataFrame([
        (1, "hpi.character", "a heavy feeling, like pressure, not sharp"),
        (2, "hpi.character", "no fever but sharp pain"), (3, "ph.tobacco", "no, I never smoke"),
        (4, "med.taking", "No, never"), (5, "hpi.severity", "about 10 of 10"),
        (6, "med.taking", "nothing noted"),
    ], "id int, question_id string, text string").withColumn("asr_confidence", F.lit(0.9))
    got = {r.id: r.value_text for r in U.extract_slots(rows, lexicon).collect()}
    assert got == {1: "pressure", 2: "sharp", 3: "never", 4: "false", 5: "10"}


def chain(n):
    last, rows = "0" * 64, []
    for i in range(n):
        h = hashlib.sha256((last + f"p{i}").encode()).hexdigest()
        rows.append([i * 3, last, h, f"p{i}"])
        last = h
    return rows


@pytest.mark.parametrize("change, expected", [
    ("none", (True, 40, None, None)), ("edit", (False, 20, 60, "content")),
    ("delete", (False, 20, 63, "link")), ("both", (False, 10, 30, "content")),
    ("swap", (False, 20, 60, "link")), ("hash", (False, 20, 60, "content")),
])
@pytest.mark.parametrize("id_chunk", [7, 1000])
def test_chain(spark, change, expected, id_chunk):
    rows = chain(40)
    if change in ("edit",):
        rows[20][3] = "x"
    if change == "both":
        rows[10][3] = "x"
    if change in ("delete", "both"):
        del rows[20]
    if change == "swap":
        rows[20][0], rows[21][0] = rows[21][0], rows[20][0]
    if change == "hash":
        rows[20][2] = "0" * 64
    df = spark.createDataFrame([tuple(r) for r in rows],
                               "id long, prev_hash string, hash string, payload string")
    got = A.verify_chain(df.repartition(6), id_chunk=id_chunk).first()
    assert (got.intact, got.checked, got.first_broken_id, got.broken_kind) == expected


def test_empty_chain_is_intact(spark):
    df = spark.createDataFrame([], "id long, prev_hash string, hash string, payload string")
    got = A.verify_chain(df).first()
    assert (got.intact, got.checked) == (True, 0)


def test_scrub(spark):
    df = spark.sql("SELECT map('name', 'x', 'step', 'y') AS m, "
                   "named_struct('text', 'a', 'k', array(1, 2, 3)) AS s")
    got = A.scrub_audit(df, ["m", "s"]).first()
    assert got.m == {"name": "<redacted>", "step": "y"}
    assert (got.s.text, got.s.k) == ("<redacted>", "<3 item(s)>")


def test_terms_equal_brute_force(spark):
    words = ["asthma", "acute asthma", "gout", "go", "type 2 diabetes", "diabetes", "ab", "a"]
    asked = ["Asthma", "severe acute asthma", "diab", "gout attack", "ab", "xyz"]
    known = spark.createDataFrame([(i, f"c{i}", w) for i, w in enumerate(words)],
                                  "concept_id int, code string, display string")
    terms = spark.createDataFrame([(t,) for t in asked], "term string")
    got = {(r.term_key, r.concept_id, r["rank"]) for r in T.term_matches(terms, known).collect()}
    want = set()
    for t in {a.lower() for a in asked}:
        for i, w in enumerate(words):
            if len(t) >= 3 and (t in w or w in t):
                want.add((t, i, 0 if t == w else 1 if t in w else 2))
    assert got == want


def test_records_round_trip(spark, tmp_path):
    row = spark.sql("SELECT 's' AS session_id, 1L AS seq, 'f' AS fact_id, 'hpi.site' AS path, "
                    "'stated' AS tier, 'v' AS verbatim, true AS supersede").withColumn(
        "value", make_value(F.lit("list"), F.lit("a|b")))
    S.write_records(row, str(tmp_path), "session_fact")
    back = S.read_records(spark, str(tmp_path), ["session_fact"])["session_fact"].first()
    assert (back.value.a, back.modality) == (["a", "b"], None)


def test_gold_files(spark, tmp_path):
    (tmp_path / "s1.json").write_text(
        '{"id": "s1", "turns": [{"question_id": "q", "tap": 4}], '
        '"expected": {"a": "true", "b": true, "c": 2.5, "d": ["x"]}}')
    got = S.read_gold(spark, str(tmp_path))
    kinds = {r.path: r.value.kind for r in got["slot"].collect()}
    assert kinds == {"a": "text", "b": "bool", "c": "number", "d": "list"}
    assert got["turn"].first().tap.n == 4.0


def test_snapshot_and_bundle_sinks(spark, tmp_path):
    rows = spark.sql("SELECT 1L AS encounter_id, TIMESTAMP '2024-01-01 00:00:00' AS generated_at, "
                     "'p' AS payload")
    S.append_snapshots(S.make_snapshots(rows, "clinician"), str(tmp_path))
    S.append_snapshots(S.make_snapshots(rows, "clinician", "2.0").withColumn(
        "generated_at", F.expr("generated_at + INTERVAL 1 DAY")), str(tmp_path))
    back = spark.read.parquet(f"{tmp_path}/report_snapshot")
    assert S.latest_snapshots(back, "clinician").first().matches_current is False
    entries = spark.sql("SELECT 1L AS encounter_id, 'e' AS entry_id, 'Flag' AS resource_type, "
                        "'{}' AS resource")
    B.write_bundles(entries, f"{tmp_path}/bundles")
    assert '"fullUrl":"e"' in spark.read.text(f"{tmp_path}/bundles").first()[0]


def test_streamed_priority_over_many_batches(spark, tmp_path):
    """Batches in order end at the batch result, and a priority is never lowered."""
    steps = [[("a", 1, "9"), ("b", 2, "1")], [("a", 3, "2"), ("b", 4, "9")], [("c", 5, "3")]]
    schema = "session_id string, seq long, text string, ts timestamp"
    source = str(tmp_path / "in")
    folder = K.work_folder(spark, "k3test")
    for step in steps:
        spark.createDataFrame(step, "session_id string, seq long, text string").withColumn(
            "ts", F.timestamp_seconds("seq")).coalesce(1).write.mode("append").parquet(source)
        raw = spark.readStream.schema(schema).parquet(source)
        facts = raw.select("session_id", "seq", "ts", F.lit("hpi.severity").alias("path"),
                           make_value(F.lit("number"), F.col("text")).alias("value"))
        wide, names = K.stream_values(facts)
        K.start_priority(wide, names, folder).awaitTermination()
    got = {r.session_id: r.priority for r in K.read_priorities(spark, folder).collect()}
    # a reached urgent and stays there although its last value is low.
    assert got == {"a": "urgent", "b": "urgent", "c": "routine"}


def test_running_priority_marks_attempts_to_lower(spark):
    df = spark.createDataFrame(
        [("s", 1, "urgent"), ("s", 2, "routine"), ("s", 3, "immediate"), ("s", 4, "urgent")],
        "session_id string, seq long, proposed string")
    got = {r.seq: (r.priority, r.deescalation_attempt)
           for r in R.running_priority(df, seq_chunk=2).collect()}
    assert got == {1: ("urgent", False), 2: ("urgent", True), 3: ("immediate", False),
                   4: ("immediate", True)}
