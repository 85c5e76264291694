"""Gold answers against what was recorded: scores, metrics and gates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartledger.functions.text import compact
from chartledger.functions.values import value_items, value_text
from chartledger.operators.rules import priority_number


def score_slots(gold: DataFrame, actual: DataFrame) -> DataFrame:
    """Each expected slot with `matched`: a list must be contained, anything else equal as text.

    Both hold script_id, path, value.
    """
    got = actual.select("script_id", "path", F.col("value").alias("_got"))
    rows = gold.join(got, ["script_id", "path"], "left")
    want = F.col("value")
    listed = (F.col("_got.kind") == "list") & (
        F.size(F.array_except(value_items(want), value_items(F.col("_got")))) == 0)
    same = value_text(want) == value_text(F.col("_got"))
    matched = F.when(want["kind"] == "list", listed).otherwise(same)
    return rows.select("script_id", "path", F.coalesce(matched, F.lit(False)).alias("matched"))


def score_flags(gold: DataFrame, fired: DataFrame) -> DataFrame:
    """Missed and forbidden flags per script. ``gold`` holds expected, forbidden; ``fired`` fired."""
    rows = gold.join(fired, "script_id", "left").withColumn(
        "fired", F.coalesce("fired", F.array().cast("array<string>")))
    return rows.withColumns({
        "missed": F.array_sort(F.array_except("expected", "fired")),
        "forbidden_fired": F.array_sort(F.array_intersect("forbidden", "fired")),
        "caught": F.size(F.array_intersect("expected", "fired")),
    })


def score_declines(gold: DataFrame, absences: DataFrame, actual: DataFrame) -> DataFrame:
    """Per script: every path meant to be declined is declined and holds no value.

    ``gold`` holds script_id, path.
    """
    said = absences.filter("reason = 'declined'").select(
        "script_id", "path", F.lit(True).alias("_absent")).distinct()
    held = actual.select("script_id", "path", F.lit(True).alias("_held")).distinct()
    rows = gold.join(said, ["script_id", "path"], "left").join(
        held, ["script_id", "path"], "left")
    good = F.col("_absent").isNotNull() & F.col("_held").isNull()
    return rows.groupBy("script_id").agg(F.bool_and(good).alias("declined_ok"))


def _share(part: Column, whole: Column, default: float) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(F.lit(default))


def metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Overall quality of a set of script results, in one aggregation."""
    emergency = F.size("expected_flags") > 0
    caught = F.size(F.array_intersect("expected_flags", "fired_flags"))
    clean = F.size(F.array_except("expected_flags", "fired_flags")) == 0
    want, got = priority_number(F.col("expected_priority")), priority_number(
        F.col("actual_priority"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = results.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("scripts"), total("facts_recorded").alias("_facts"),
        total("facts_without_source").alias("_bare"),
        total("unsourced_claims").alias("unsourced_claims"),
        total(F.when(emergency, F.size("expected_flags"))).alias("_flags"),
        total(F.when(emergency, caught)).alias("_caught"),
        F.count_if(emergency).alias("_emergency"),
        F.count_if(emergency & clean).alias("_clean"),
        F.count_if(want == got).alias("_right"), F.count_if(got < want).alias("under_calls"),
        F.count_if(F.size("forbidden_fired") > 0).alias("forbidden_scripts"),
        total("expected_slots").alias("_slots"), total("matched_slots").alias("_matched"),
        F.coalesce(F.round(F.avg(F.when(F.col("ok"), F.col("completeness"))), 4), F.lit(0.0))
        .alias("mean_completeness"),
        F.count_if(~F.col("ok")).alias("failures"),
    )
    c = F.col
    return sums.select(
        *(by or []), "scripts", _share(c("_bare"), c("_facts"), 0.0).alias("hallucination_rate"),
        "unsourced_claims", _share(c("_caught"), c("_flags"), 1.0).alias("sensitivity"),
        _share(c("_clean"), c("_emergency"), 1.0).alias("emergency_recall"),
        _share(c("_right"), c("scripts"), 0.0).alias("priority_accuracy"), "under_calls",
        "forbidden_scripts", _share(c("_matched"), c("_slots"), 0.0).alias("extraction_accuracy"),
        "mean_completeness", "failures")


def per_field(scores: DataFrame) -> DataFrame:
    """Expected and matched slots per path; sort by accuracy, then by expected descending."""
    counts = scores.groupBy("path").agg(
        F.count(F.lit(1)).alias("expected"), F.count_if("matched").alias("matched"))
    return counts.withColumn("accuracy", F.round(F.col("matched") / F.col("expected"), 4))


def by_difficulty(results: DataFrame) -> DataFrame:
    """Extraction, completeness and flags per class of script."""
    sums = results.groupBy("difficulty").agg(
        F.count(F.lit(1)).alias("scripts"), F.sum("expected_slots").alias("_s"),
        F.sum("matched_slots").alias("_m"),
        F.round(F.avg("completeness"), 4).alias("completeness"),
        F.sum(F.size("expected_flags")).alias("flags_expected"),
        F.sum(F.size(F.array_intersect("expected_flags", "fired_flags"))).alias("flags_caught"))
    return sums.select("difficulty", "scripts", _share(F.col("_m"), F.col("_s"), 1.0)
                       .alias("extraction"), "completeness", "flags_expected", "flags_caught")


def timing(results: DataFrame, bucket_ms: int = 1000) -> DataFrame:
    """Mean, upper median, 95th percentile by position, and maximum of duration_ms; exact.

    Durations are whole milliseconds, so they are counted first. Positions are then found in two
    steps: among the counts of buckets of ``bucket_ms``, and among the values of the two buckets
    that hold them. Only buckets are ordered in one place.
    """
    counts = results.groupBy("duration_ms").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "_bucket", F.floor(F.col("duration_ms") / bucket_ms))
    buckets = counts.groupBy("_bucket").agg(F.sum("n").alias("_n"))
    upto = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    placed = buckets.withColumns({
        "_end": F.sum("_n").over(upto), "_all": F.sum("_n").over(W.partitionBy())})
    # Position p (from zero) falls in the first value whose running count exceeds p.
    half = F.floor(F.col("_all") / 2)
    p95 = F.least(F.floor(F.col("_all") * 0.95), F.col("_all") - 1)
    inside = lambda p: (F.col("_end") > p) & (F.col("_end") - F.col("_n") <= p)
    wanted = placed.filter(inside(half) | inside(p95))
    run = W.partitionBy("_bucket").orderBy("duration_ms").rowsBetween(W.unboundedPreceding, 0)
    rows = counts.join(wanted, "_bucket", "left").withColumn(
        "_upto", F.sum("n").over(run) + F.col("_end") - F.col("_n"))
    at = lambda p: F.min(F.when(inside(p) & (F.col("_upto") > p), F.col("duration_ms")))
    return rows.groupBy().agg(
        F.round(F.sum(F.col("n") * F.col("duration_ms")) / F.sum("n"), 1).alias("mean_ms"),
        at(half).cast("double").alias("median_ms"), at(p95).cast("double").alias("p95_ms"),
        F.max("duration_ms").cast("double").alias("max_ms"))


_GAP_METRICS = (
    "hallucination_rate", "sensitivity", "extraction_accuracy", "mean_completeness",
    "priority_accuracy",
)


def gap(results: DataFrame, set_col: str = "set") -> DataFrame:
    """Each metric on the dev and held sets and the difference, one row per metric."""
    pairs = ", ".join(f"'{m}', {m}" for m in _GAP_METRICS)
    tall = metrics(results, [set_col]).selectExpr(
        set_col, f"stack({len(_GAP_METRICS)}, {pairs}) AS (metric, value)")
    side = lambda name: F.max(F.when(F.col(set_col) == name, F.col("value")))
    return tall.groupBy("metric").agg(side("dev").alias("dev"), side("held").alias("held")).withColumn(
        "gap", F.round(F.col("held") - F.col("dev"), 4))


def strict_gate(overall: DataFrame, min_sensitivity: float = 0.98) -> DataFrame:
    """Adds `passed`: nothing unsourced, enough sensitivity, no under-call, no failure."""
    return overall.withColumn("passed", F.expr(
        f"hallucination_rate = 0 AND unsourced_claims = 0 AND sensitivity >= {min_sensitivity} "
        "AND under_calls = 0 AND failures = 0"))


# Letters of a true name that have to appear in what was read, per kind.
PREFIXES = {"medication": 6, "investigation": 5, "diagnosis": 12}


def _pieces(text: Column, length: str) -> Column:
    """Every different run of as many letters as the column ``length`` says, in one pass."""
    run = F.concat(F.lit("(?s)(?=(.{"), F.col(length).cast("string"), F.lit("}))"))
    return F.array_distinct(F.regexp_extract_all(text, run, F.lit(1)))


def match_truth(truth: DataFrame, entities: DataFrame) -> DataFrame:
    """The first entity that carries the beginning of each true name, or none.

    ``truth`` holds doc_id, truth_id, kind, name; ``entities`` doc_id, position, kind, label.
    A name is found by an equi-join on its beginning against the pieces of each label, so rows of
    a document are not paired with each other. Pieces are made only of the lengths that the
    beginnings looked for in the same document and kind have: one for most.
    """
    wanted = truth.withColumn("_key", F.coalesce(*[
        F.when(F.col("kind") == k, F.substring(compact(F.col("name")), 1, n))
        for k, n in PREFIXES.items()
    ])).filter("_key <> ''")
    read = entities.filter(F.col("kind").isin(*PREFIXES)).withColumn("_text", compact(F.col("label")))
    sizes = wanted.select("doc_id", "kind", F.length("_key").alias("_length")).distinct()
    offered = read.join(sizes, ["doc_id", "kind"]).select("doc_id", "kind", F.col("position").alias("_at"),
                          F.struct("label", "dose", "range_flag").alias("_got"),
                          F.explode(_pieces(F.col("_text"), "_length")).alias("_key"))
    hit = wanted.join(offered, ["doc_id", "kind", "_key"]).groupBy("truth_id").agg(
        F.min_by("_got", "_at").alias("_got"))
    return truth.join(hit, "truth_id", "left").withColumn("found", F.col("_got").isNotNull())


def score_extraction(truth: DataFrame, entities: DataFrame) -> DataFrame:
    """Per document: recall of medicines, tests and diagnoses, dose and flag accuracy of what was
    found, and the share of entities sent to a person."""
    m = match_truth(truth, entities)
    kind, found = F.col("kind"), F.col("found")
    dose = compact(F.coalesce("dose", F.lit(""))) == compact(F.coalesce("_got.dose", F.lit("")))
    flag = F.col("flag").eqNullSafe(F.col("_got.range_flag"))
    n = lambda test: F.count_if(test)
    counts = m.groupBy("doc_id").agg(
        n(kind == "medication").alias("_m"), n((kind == "medication") & found).alias("_mf"),
        n((kind == "medication") & found & dose).alias("_md"),
        n(kind == "investigation").alias("_i"), n((kind == "investigation") & found).alias("_if"),
        n((kind == "investigation") & found & flag).alias("_ig"),
        n(kind == "diagnosis").alias("_d"), n((kind == "diagnosis") & found).alias("_df"))
    lanes = entities.groupBy("doc_id").agg(
        F.round(F.count_if("pending") / F.count(F.lit(1)), 4).alias("verification_rate"))
    c = F.col
    accuracy = lambda hits, of, want: F.when(c(of) > 0, F.round(c(hits) / c(of), 4)).otherwise(
        F.when(c(want) == 0, 1.0).otherwise(0.0))
    return counts.join(lanes, "doc_id", "left").select(
        "doc_id", _share(c("_mf"), c("_m"), 1.0).alias("med_recall"),
        accuracy("_md", "_mf", "_m").alias("dose_accuracy"),
        _share(c("_if"), c("_i"), 1.0).alias("inv_recall"),
        accuracy("_ig", "_if", "_i").alias("flag_accuracy"),
        _share(c("_df"), c("_d"), 1.0).alias("dx_recall"),
        F.coalesce("verification_rate", F.lit(0.0)).alias("verification_rate"))
