"""Any choice of output columns has as many rows as all of them, collected, ordered or written."""

import itertools

import pytest
from pyspark.sql import functions as F

from chartledger.functions.values import make_value
from chartledger.operators import extraction, ledger
from chartledger.plans.catalog import all_queries

SF_DIR = "/root/testdata/sf0.001"


def planned_columns(df):
    output = df._jdf.queryExecution().optimizedPlan().output()
    return [output.apply(i).name() for i in range(output.size())]


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_optimized_plans_keep_the_chosen_columns(spark, name):
    """A rule that loses a plan's output columns loses its rows on collect and fails on write."""
    df = all_queries()[name](spark, SF_DIR)
    chosen = [(c,) for c in df.columns] + list(zip(df.columns, df.columns[1:], strict=False))
    for columns in chosen:
        assert planned_columns(df.select(*columns)) == list(columns)


def check_rows(df, tmp_path):
    want, at = df.count(), 0
    assert want > 0
    pairs = list(itertools.combinations(df.columns, 2))[::9]
    for columns in [(c,) for c in df.columns] + pairs:
        part = df.select(*columns)
        assert len(part.collect()) == want, columns
        if at % 9 == 0:
            assert len(part.orderBy(part.columns[0]).collect()) == want, columns
            path = str(tmp_path / f"{at}-{'-'.join(columns)}")
            part.write.parquet(path)
            assert part.sparkSession.read.parquet(path).count() == want, columns
        at += 1


def candidates(spark, tmp_path, from_parquet):
    rows = spark.createDataFrame(
        [("s", 1, "f1", "hpi.site", "chest"), ("t", 1, "f2", "hpi.site", "head")],
        "session_id string, seq long, fact_id string, path string, shown string")
    if from_parquet:
        rows.write.parquet(str(tmp_path / "rows"))
        rows = spark.read.parquet(str(tmp_path / "rows"))
    given = {"kind": F.lit("utterance"), "verbatim": F.concat(F.lit("my "), F.col("shown")),
             "modality": F.lit("voice"), "selected_values": F.array("shown")}
    plain = {"char_start": "int", "char_end": "int", "asr_confidence": "double", "page": "int",
             "ocr_confidence": "double", "handwritten": "boolean"}
    names = ("kind", "verbatim", "verbatim_translated", "language", "turn_id", "question_id",
             "char_start", "char_end", "modality", "selected_values", "asr_confidence",
             "document_id", "page", "ocr_confidence", "handwritten", "human_reading", "read_by")
    span = F.struct(*[given.get(n, F.lit(None).cast(plain.get(n, "string"))).alias(n)
                      for n in names])
    return rows.select(
        "session_id", "seq", "fact_id", "path",
        make_value(F.lit("text"), F.col("shown")).alias("value"), F.lit("stated").alias("tier"),
        span.alias("span"), F.lit(None).cast("string").alias("required_scope"),
        F.lit(True).alias("supersede"))


@pytest.mark.parametrize("from_parquet", [False, True])
def test_judged_and_edited_facts(spark, tmp_path, from_parquet):
    facts = candidates(spark, tmp_path, from_parquet)
    scopes = spark.createDataFrame([("s", ["history"])], "session_id string, granted array<string>")
    check_rows(ledger.judge_facts(facts, scopes), tmp_path / "judged")
    edits = facts.select(
        "session_id", (F.col("seq") + 1).alias("seq"), F.current_timestamp().alias("ts"), "path",
        make_value(F.lit("text"), F.lit("not an option")).alias("value"),
        F.lit("not an option").alias("value_as_text"), F.lit("dr").alias("actor"),
        F.lit(None).cast("string").alias("reason"))
    _kept, refused = ledger.apply_edits(
        facts.select("session_id", "seq", "fact_id", "path", "value", "supersede"), edits, scopes)
    check_rows(refused, tmp_path / "refused")


@pytest.mark.parametrize("from_parquet", [False, True])
def test_extracted_entities(spark, tmp_path, from_parquet):
    lines = spark.createDataFrame(
        [("d", 1, 1, "Tab. Metformin 500 mg 1-0-1 x 30 days", 0.9),
         ("d", 1, 2, "HbA1c 9.1 % (4.0 - 5.6) 03/02/2020", 0.9), ("d", 1, 3, "Diagnosis: asthma", 0.9)],
        "doc_id string, page int, line_no int, text string, confidence double")
    if from_parquet:
        lines.write.parquet(str(tmp_path / "lines"))
        lines = spark.read.parquet(str(tmp_path / "lines"))
    found = extraction.extract_entities(lines)
    assert found.count() == 3
    check_rows(found, tmp_path / "found")


def test_verified_slots(spark, tmp_path):
    from chartledger.plans.catalog import all_queries

    check_rows(all_queries()["x15_verify_slots"](spark, SF_DIR), tmp_path)
