"""One patient over time: counts, series, changes between visits, medicines, timeline.

Outputs are long: one row per item, with the keys to sort or collect by. No operator gathers all
items of a patient into one row, since one patient may hold a large part of the table.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartledger.config.vocabulary import (
    ABSENCE_STATES,
    ALLERGY_FIELDS,
    KIND_ORDER,
    PRECISION_ORDER,
    PRIORITY_ANALYTES,
    SIMILARITY_LABELS,
    SIMILARITY_PATHS,
    SNAPSHOT_FIELDS,
)
from chartledger.functions.ordered import keyed_join, salted_join, wide_join, with_previous
from chartledger.functions.text import fold
from chartledger.functions.values import rank_of, value_items, value_text
from chartledger.operators.predicates import is_live, renderable

EARLIEST = "DATE '0001-01-01'"

# Ids of one chunk of a group, for rows of one day.
ID_CHUNK = 100_000


def _count_if(test: Column, name: str) -> Column:
    return F.count_if(test).alias(name)


def patient_overview(
    patients: DataFrame, encounters: DataFrame, documents: DataFrame, meds: DataFrame,
    observations: DataFrame,
) -> DataFrame:
    """Counts per patient. Every table is reduced to one row per patient before it is joined."""
    visits = encounters.groupBy("patient_id").agg(F.count(F.lit(1)).alias("encounters"))
    kind = F.col("document_kind")
    papers = (
        documents.join(encounters.select("encounter_id", "patient_id"), "encounter_id")
        .groupBy("patient_id").agg(
            _count_if(kind == "prescription", "prescriptions"),
            _count_if(kind == "lab_report", "lab_reports"),
            _count_if(~kind.isin("prescription", "lab_report"), "other_documents"),
        )
    )
    # Distinct names first, then a count: both steps reduce before they shuffle.
    drugs = (
        meds.select("patient_id", fold(F.col("name")).alias("normalized_name")).distinct()
        .groupBy("patient_id").agg(F.count(F.lit(1)).alias("medications"))
    )
    results = observations.groupBy("patient_id").agg(F.count(F.lit(1)).alias("observations"))
    out = patients.select("patient_id")
    for part in (visits, papers, drugs, results):
        out = out.join(part, "patient_id", "left")
    return out.na.fill(0)


def recent_encounters(encounters: DataFrame, k: int = 6) -> DataFrame:
    """The k newest encounters of each patient, numbered from the newest."""
    newest = W.partitionBy("patient_id").orderBy(F.desc("occurred_on"), F.desc("encounter_id"))
    ranked = encounters.withColumn("position", F.row_number().over(newest))
    return ranked.filter(F.col("position") <= k).withColumn(
        "headline", F.coalesce(_told("headline"), F.lit("Clinical encounter")))


def entity_label(kind, text, dose, frequency, display, value, unit) -> Column:
    """The line shown for an extracted entity on the timeline."""
    drug = F.concat_ws(" ", text, dose, frequency)
    lab = F.trim(F.concat_ws(" ", F.coalesce(display, text), value.cast("string"),
                             F.coalesce(unit, F.lit(""))))
    return F.when(kind == "medication", drug).when(kind == "investigation", lab).otherwise(text)


def entity_detail(kind, duration, range_flag, low, high) -> Column:
    """The second line of a timeline entry."""
    span = F.when(low.isNotNull() & high.isNotNull(), F.concat(
        F.lit(" (reference "), low.cast("string"), F.lit("–"), high.cast("string"), F.lit(")"),
    )).otherwise("")
    lab = (
        F.when(range_flag.isin("low", "high"),
               F.concat(F.lit("Outside the reference interval: "), range_flag, span))
        .when(range_flag == "in_range", "Within the reference interval")
        .otherwise("No reference interval available")
    )
    drug = F.concat(F.lit("Prescribed"),
                    F.coalesce(F.concat(F.lit(" for "), duration), F.lit("")))
    return F.when(kind == "medication", drug).when(kind == "investigation", lab)


def timeline_order() -> list[Column]:
    """Sort columns: newest first, undated last, then precision, then kind, then `seq`."""
    dated = F.col("occurred_on").isNotNull()
    precision = F.when(dated, rank_of(PRECISION_ORDER, 9)(F.col("date_precision"))).otherwise(0)
    return [F.desc_nulls_last("occurred_on"), precision,
            rank_of(KIND_ORDER, 9)(F.col("kind")), F.col("seq")]


def patient_timeline(
    events: DataFrame, encounters: DataFrame, kinds: list[str] | None = None
) -> DataFrame:
    """Encounters and other dated events of every patient in one table.

    ``events`` holds patient_id, seq, occurred_on, date_precision, kind, label, detail.
    """
    visits = encounters.select(
        "patient_id", F.col("encounter_id").alias("seq"), "occurred_on",
        F.lit("exact").alias("date_precision"), F.lit("encounter").alias("kind"),
        F.coalesce(_told("headline"), F.lit("Clinical encounter")).alias("label"),
        F.concat(F.lit("Confirmed by "), "confirmed_by").alias("detail"),
    )
    rows = visits.unionByName(events.select(visits.columns))
    return rows.filter(F.col("kind").isin(*kinds)) if kinds else rows


def timeline_periods(timeline: DataFrame) -> DataFrame:
    """Entries per patient and year; undated entries fall in `unknown`, which sorts last."""
    period = F.coalesce(F.year("occurred_on").cast("string"), F.lit("unknown"))
    counts = timeline.groupBy("patient_id", period.alias("period")).agg(
        F.count(F.lit(1)).alias("entries"))
    return counts.withColumn("undated", F.col("period") == "unknown")


def latest_denials(encounters: DataFrame, facts: DataFrame) -> DataFrame:
    """Patients whose latest encounter of any kind says they take no medicines."""
    latest = encounters.groupBy("patient_id").agg(
        F.max_by("encounter_id", F.struct("occurred_on", "encounter_id")).alias("encounter_id"))
    said = facts.filter(
        (F.col("path") == "drug_allergy.taking_medicines") & (F.col("value")["b"] == F.lit(False))
    ).select("encounter_id").distinct()
    return latest.join(said, "encounter_id", "left_semi").select("patient_id")


def medication_threads(meds: DataFrame, denials: DataFrame) -> DataFrame:
    """One row per (patient, medicine): mentions by status and whether the sources disagree.

    ``denials`` holds the patients who deny taking medicines; see `latest_denials`, or pass those
    of a visit in progress.
    """
    status = F.col("status")
    order = F.struct(F.coalesce("observed_on", F.expr(EARLIEST)), "encounter_id", "line_no", "name")
    threads = meds.groupBy("patient_id", fold(F.col("name")).alias("normalized_name")).agg(
        F.min_by("name", order).alias("name"),
        F.count(F.lit(1)).alias("mentions"),
        _count_if(status == "documented", "documented"),
        _count_if(status == "stopped-reported", "stopped"),
        F.max("observed_on").alias("last_observed_on"),
    )
    rows = threads.join(denials.select("patient_id", F.lit(True).alias("_denied")), "patient_id",
                        "left")
    denied = F.coalesce("_denied", F.lit(False))
    reason = F.when(denied & (F.col("documented") > 0), "documented_but_denied").when(
        (F.col("documented") > 0) & (F.col("stopped") > 0), "documented_and_stopped")
    return rows.withColumn("reason", reason).withColumn(
        "needs_reconciliation", reason.isNotNull()).drop("_denied")


def reconcile_sessions(sessions: DataFrame, named: DataFrame, threads: DataFrame) -> DataFrame:
    """What a visit in progress leaves open about documented medicines.

    ``sessions`` holds session_id, patient_id, denies (boolean); ``named`` holds session_id, name.
    A patient has one visit in progress: of several sessions the one with the largest id counts,
    so the findings grow with the medicines and not with sessions times medicines. A session that
    denies gives one finding that counts all documented medicines; any other gives one finding per
    documented medicine it did not name.
    """
    sessions = sessions.groupBy("patient_id").agg(
        F.max(F.struct("session_id", "denies")).alias("_s")).select("patient_id", "_s.*")
    documented = threads.filter("documented > 0").select("patient_id", "normalized_name")
    per_patient = documented.groupBy("patient_id").agg(F.count(F.lit(1)).alias("medicines"))
    denial = (
        sessions.filter("denies").join(per_patient, "patient_id")
        .select("session_id", F.lit("medication_reconciliation").alias("kind"),
                F.lit(None).cast("string").alias("normalized_name"), "medicines")
    )
    today = named.select("session_id", fold(F.col("name")).alias("normalized_name")).distinct()
    silent = (
        sessions.filter(~F.coalesce("denies", F.lit(False))).select("session_id", "patient_id")
        .join(documented, "patient_id")
        .join(today, ["session_id", "normalized_name"], "left_anti")
        .select("session_id", F.lit("medication_not_mentioned").alias("kind"), "normalized_name",
                F.lit(1).cast("long").alias("medicines"))
    )
    return denial.unionByName(silent)


def feature_set(
    facts: DataFrame, live_only: bool = False, paths: tuple[str, ...] = SIMILARITY_PATHS
) -> DataFrame:
    """Distinct (encounter, path, item) of the compared paths; empty items and "none" dropped."""
    rows = facts.filter(F.col("path").isin(*paths) & F.col("value").isNotNull())
    if live_only:
        rows = rows.filter(is_live())
    items = rows.select("encounter_id", "path", F.explode(value_items(F.col("value"))).alias("item"))
    return items.filter(~F.col("item").isin("", "none")).distinct()


def band(count: Column) -> Column:
    return F.when(count >= 4, "many shared features").when(
        count >= 2, "some shared features").otherwise("one shared feature")


def latest_intakes(encounters: DataFrame) -> DataFrame:
    """(patient, encounter) of each patient's newest intake."""
    return encounters.filter("kind = 'intake'").groupBy("patient_id").agg(
        F.max_by("encounter_id", F.struct("occurred_on", "encounter_id")).alias("encounter_id"))


def similar_encounters(
    features: DataFrame, encounters: DataFrame, targets: DataFrame, k: int = 3
) -> DataFrame:
    """For each target visit, the k visits of the same patient that share most features with it.

    ``targets`` names one visit per patient (the one on screen), so every feature row meets at
    most one target row: the work grows with the features, not with pairs of visits. Ties go to
    the older visit, then the lower id.
    """
    dated = encounters.select("encounter_id", "patient_id", "occurred_on")
    mine = features.join(dated, "encounter_id")
    wanted = features.join(targets.select("encounter_id", "patient_id"), "encounter_id").select(
        "patient_id", "path", "item", F.col("encounter_id").alias("target_id"))
    hits = wide_join(mine, wanted, ["patient_id", "path", "item"]).filter(
        F.col("encounter_id") != F.col("target_id"))
    # A visit shares at most the target's own features, so the list stays short.
    scored = hits.groupBy("patient_id", "target_id", "encounter_id", "occurred_on").agg(
        F.count(F.lit(1)).alias("shared_count"),
        F.array_sort(F.collect_list(F.concat_ws("=", "path", "item"))).alias("shared"),
    )
    best = W.partitionBy("target_id").orderBy(
        F.desc("shared_count"), "occurred_on", "encounter_id")
    return (
        scored.withColumn("position", F.row_number().over(best))
        .filter(F.col("position") <= k).withColumn("band", band(F.col("shared_count")))
    )


def shared_labels(shared: Column) -> Column:
    """The words for each shared path."""
    look = rank_of(SIMILARITY_LABELS)
    return F.transform(shared, lambda s: F.coalesce(
        look(F.substring_index(s, "=", 1)), F.substring_index(s, "=", 1)))


def cross_patient_similar(
    candidates: DataFrame, features: DataFrame, encounters: DataFrame, patients: DataFrame
) -> DataFrame:
    """Score given pairs of visits of different patients, confined to one cohort.

    ``candidates`` holds target_id, encounter_id, found by some cross-patient search. The cohort
    flag is part of the join key, so synthetic and clinical records never meet. The work grows
    with the candidates; no pairs are made here.
    """
    owner = _owners(encounters, patients)
    target = owner.select(F.col("encounter_id").alias("target_id"),
                          F.col("patient_id").alias("_target_patient"), "_flag")
    inside = (
        candidates.distinct().join(target, "target_id").join(owner, ["encounter_id", "_flag"])
        .filter(F.col("patient_id") != F.col("_target_patient"))
        .select("target_id", "encounter_id")
    )
    other = inside.join(features, "encounter_id")
    mine = features.withColumnRenamed("encounter_id", "target_id")
    return (
        other.join(mine, ["target_id", "path", "item"])
        .groupBy("target_id", "encounter_id").agg(F.count(F.lit(1)).alias("shared_count"))
        .withColumn("band", band(F.col("shared_count")))
    )


def nearest_across_patients(
    targets: DataFrame, features: DataFrame, encounters: DataFrame, patients: DataFrame,
    k: int = 3, max_frequency: int | None = None,
) -> DataFrame:
    """For each target visit, the k visits of other patients that share most features with it.

    ``targets`` holds target_id, the stated visits to search for; all visits are searched, inside
    the target's cohort. Ties go to the lower id. ``features`` holds distinct rows. The result is
    exact; nothing is left out.

    Visits of one cohort with equal features are one class. Equal visits score alike, so k visits of
    each of k + 1 people of a class are enough for any target, and classes are searched instead of
    visits. Features are ordered by rarity. First, people who share a run of features give each
    sought class a count that its k-th best visit reaches at least. Two classes that share that many
    features share one among the rarest of either, so only classes that meet in this beginning, and
    whose remaining features can still make up the count, are scored.

    ``max_frequency`` leaves out features held by more visits than that; off unless it is given.
    """
    named = features.filter("path IS NOT NULL AND item IS NOT NULL").select(
        "encounter_id", F.concat(F.length("path").cast("string"), F.lit(":"), "path", "item")
        .alias("_f"))
    held = named.join(_owners(encounters, patients), "encounter_id")
    if max_frequency is not None:
        few = held.groupBy("_flag", "_f").agg(F.count(F.lit(1)).alias("_n")).filter(
            F.col("_n") <= max_frequency).drop("_n")
        held = salted_join(held, few, ["_flag", "_f"], "encounter_id")
    # A visit that is listed several times counts as often (`_times`).
    visits = held.groupBy("encounter_id", "_flag").agg(
        F.array_sort(F.collect_set("_f")).alias("_set"),
        F.array_sort(F.collect_set("patient_id")).alias("_owner"),
        F.count(F.lit(1)).alias("_rows"),
    ).withColumn("_times", F.expr("_rows div size(_set)")).drop("_rows")

    equal = ["_flag", "_set", "_times"]
    kept = _enough_for_others(visits, equal, ["encounter_id"], k).withColumn(
        "_class", F.min("encounter_id").over(W.partitionBy(*equal)))
    members = kept.select("_flag", "_class", "_owner", "encounter_id")
    classes = kept.filter("encounter_id = _class").select(*equal, "_class")
    key = ["_flag", "_class"]
    each = classes.select(*key, "_times", F.explode("_set").alias("_f"))
    counts = each.groupBy("_flag", "_f").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_times").alias("_most"))
    ordered = salted_join(each, counts, ["_flag", "_f"], "_class").groupBy(*key, "_times").agg(
        F.array_sort(F.collect_list(F.struct("_n", "_f", "_most"))).alias("_set"))
    sets = ordered.withColumn("_set", F.col("_set._f"))

    who = targets.select(F.col("target_id").alias("encounter_id")).distinct()
    wanted = visits.join(who, "encounter_id", "left_semi").join(classes, equal).select(
        *key, F.col("encounter_id").alias("target_id"), F.col("_owner").alias("_self"))
    sought = ordered.join(wanted.select(*key).distinct(), key, "left_semi").select(
        "_flag", F.col("_class").alias("_sought"), F.col("_times").alias("_by"),
        F.col("_set").alias("_ranked"), F.col("_set._f").alias("_wanted"))
    both = F.array_intersect("_wanted", "_set")
    score = F.size(both) * F.col("_by") * F.col("_times")

    # Of k + 1 people at least k are not the target's own.
    lead = members.groupBy(*key, "_owner").agg(F.min("encounter_id").alias("encounter_id"))
    first = W.partitionBy("_flag", "_run").orderBy("encounter_id")
    some = sets.withColumn("_run", F.explode(_runs("_set"))).join(lead, key).withColumn(
        "_at", F.row_number().over(first)).filter(F.col("_at") <= k + 1)
    least = (
        sought.withColumn("_run", F.explode(_runs("_wanted"))).join(
            some.select("_flag", "_run", "_owner", "_set", "_times"), ["_flag", "_run"])
        .groupBy("_flag", "_sought", "_owner").agg(F.max(score).alias("_least"))
        .withColumn("_at", F.row_number().over(
            W.partitionBy("_flag", "_sought").orderBy(F.desc("_least"))))
        .filter(F.col("_at") == k + 1).select("_flag", "_sought", "_least")
    )

    # `_left` and `_after` count the features from this one to the most frequent one.
    reach = lambda left, times: F.col(left) * F.col("_by") * F.col(times) >= F.col("_least")
    bound = sought.join(least, ["_flag", "_sought"], "left").withColumn(
        "_least", F.coalesce("_least", F.lit(1))).select(
        "*", F.posexplode("_ranked").alias("_p", "_r")).select(
        "_flag", "_sought", "_by", "_wanted", "_least", F.col("_r._f").alias("_f"),
        F.col("_r._most").alias("_most"), (F.size("_wanted") - F.col("_p")).alias("_left"),
    ).filter(reach("_left", "_most")).drop("_most")
    open_ = sets.select("*", F.posexplode("_set").alias("_p", "_f")).withColumn(
        "_after", F.size("_set") - F.col("_p")).drop("_p")
    # A pair is taken at the rarest feature it shares, so it is taken once.
    found = salted_join(open_, bound, ["_flag", "_f"], "_class").filter(
        reach("_left", "_times") & reach("_after", "_times") & (F.get(both, F.lit(0)) == F.col("_f"))
    ).select("_flag", "_sought", "_class", (-score).alias("_minus"), "_least").filter(
        -F.col("_minus") >= F.col("_least"))
    hits = _enough_for_others(found.drop("_least").join(members, key), ["_flag", "_sought"],
                              ["_minus", "encounter_id"], k)

    other = (F.size("_owner") > 1) | (F.col("_owner") != F.col("_self"))
    best = W.partitionBy("target_id").orderBy(F.desc("shared_count"), "encounter_id")
    return (
        wanted.withColumnRenamed("_class", "_sought").join(hits, ["_flag", "_sought"])
        .filter(other).groupBy("target_id", "encounter_id")
        .agg((-F.sum("_minus")).alias("shared_count"))
        .withColumn("position", F.row_number().over(best))
        .filter(F.col("position") <= k).withColumn("band", band(F.col("shared_count")))
    )


# Fixed value: the longest run of features by which a first count is looked for.
LONGEST_RUN = 8


def _runs(ordered: str) -> Column:
    """The rarest 1, 2, ... features of a set, the most frequent 1, 2, ..., and each feature."""
    lengths = F.sequence(F.lit(1), F.least(F.size(ordered), F.lit(LONGEST_RUN)))
    return F.array_distinct(F.concat(
        F.transform(lengths, lambda n: F.slice(ordered, F.lit(1), n)),
        F.transform(lengths, lambda n: F.slice(ordered, -n, n)),
        F.transform(F.col(ordered), lambda f: F.array(f))))


def _enough_for_others(
    rows: DataFrame, group: list[str], order: list[str], k: int
) -> DataFrame:
    """The first k rows of each of a group's first k + 1 owners (`_owner`): the first k rows that
    are not one's own are among them, whoever asks."""
    own = W.partitionBy(*group, "_owner")
    rows = rows.withColumn("_at", F.row_number().over(own.orderBy(*order))).filter(
        F.col("_at") <= k).withColumn("_lead", F.min(F.struct(*order)).over(own))
    place = F.dense_rank().over(W.partitionBy(*group).orderBy("_lead"))
    return rows.withColumn("_at", place).filter(F.col("_at") <= k + 1).drop("_at", "_lead")


def _owners(encounters: DataFrame, patients: DataFrame) -> DataFrame:
    """encounter_id, patient_id and the cohort flag; an unknown flag counts as clinical."""
    flags = patients.select(
        "patient_id", F.coalesce("is_synthetic", F.lit(False)).alias("_flag"))
    return encounters.select("encounter_id", "patient_id").join(flags, "patient_id")


def _told(column: str) -> Column:
    """The text, null where it is empty."""
    return F.when(F.col(column) != "", F.col(column))


def _series_key() -> Column:
    return F.coalesce(_told("analyte_key"), F.lower(_told("display")))


def latest_observations(observations: DataFrame) -> DataFrame:
    """The latest result per (patient, analyte); no date counts as earliest, later rows win."""
    order = F.struct(F.coalesce("observed_on", F.expr(EARLIEST)), "seq")
    best = F.max_by(F.struct("seq", "value", "unit", "range_flag", "observed_on"), order)
    return (
        observations.groupBy("patient_id", _series_key().alias("analyte"))
        .agg(best.alias("_o")).select("patient_id", "analyte", "_o.*")
    )


def direction(delta: Column) -> Column:
    return F.when(F.abs(delta) < 1e-9, "unchanged").when(delta > 0, "higher").otherwise("lower")


def observation_series(observations: DataFrame) -> DataFrame:
    """Series of two or more dated numbers: latest, previous, change and count out of range.

    Only the two newest points of a series are ever sorted (the window is trimmed before the
    shuffle); the counts are reduced map-side. `series_points` lists all points.
    """
    points = observations.filter("value IS NOT NULL AND observed_on IS NOT NULL").withColumn(
        "analyte", _series_key())
    keys = ["patient_id", "analyte"]
    newest = W.partitionBy(*keys).orderBy(F.desc("observed_on"), F.desc("seq"))
    rank = F.col("_rank")
    payload = F.struct("value", "observed_on", "display", "unit", "range_flag")
    two = (
        points.withColumn("_rank", F.row_number().over(newest)).filter(rank <= 2)
        .groupBy(*keys).agg(F.max_by(F.when(rank == 1, payload), F.when(rank == 1, 1)).alias("l"),
                            F.max_by(F.when(rank == 2, payload), F.when(rank == 2, 1)).alias("p"))
        .filter("p IS NOT NULL")
    )
    counts = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if(F.col("range_flag").isin("high", "low")).alias("out_of_range"))
    delta = F.round(F.col("l.value") - F.col("p.value"), 4)
    return two.join(counts, keys).select(
        *keys, F.col("l.display").alias("display"), F.col("l.unit").alias("unit"), "points",
        F.col("l.value").alias("latest_value"), F.col("l.observed_on").alias("latest_on"),
        F.col("l.range_flag").alias("latest_flag"), F.col("p.value").alias("previous_value"),
        F.col("p.observed_on").alias("previous_on"), delta.alias("delta"),
        direction(delta).alias("direction"), "out_of_range",
        rank_of({a: i for i, a in enumerate(PRIORITY_ANALYTES)}, len(PRIORITY_ANALYTES))(
            F.col("analyte")).alias("lead_rank"),
    )


def series_points(observations: DataFrame) -> DataFrame:
    """Every dated number with the one before it in its series. A number without a patient or a
    name belongs to no series."""
    points = observations.filter("value IS NOT NULL AND observed_on IS NOT NULL").withColumn(
        "analyte", _series_key()).filter("patient_id IS NOT NULL AND analyte IS NOT NULL")
    with_prev = with_previous(points, ["patient_id", "analyte"], ["observed_on", "seq"],
                              F.struct("observed_on", F.expr(f"seq div {ID_CHUNK}")),
                              ["value", "observed_on"], "_p")
    return with_prev.withColumns({
        "previous_value": F.col("_p.value"), "previous_on": F.col("_p.observed_on"),
        "change": F.round(F.col("value") - F.col("_p.value"), 4),
    }).drop("_p")


def observation_trend(observations: DataFrame) -> DataFrame:
    """Keyed numeric points: whether they can be drawn, why not, and last minus first."""
    rows = observations.filter("analyte_key IS NOT NULL AND value IS NOT NULL")
    order = F.struct(F.coalesce("observed_on", F.expr(EARLIEST)), "seq")
    units = F.struct(F.min(F.when(F.col("unit") != "", F.col("unit"))).alias("lo"),
                     F.max(F.when(F.col("unit") != "", F.col("unit"))).alias("hi"))
    g = rows.groupBy("patient_id", "analyte_key").agg(
        F.count(F.lit(1)).alias("points"), F.min_by("value", order).alias("first_value"),
        F.max_by("value", order).alias("last_value"), units.alias("_u"),
    )
    one_unit = F.col("_u.lo").eqNullSafe(F.col("_u.hi"))
    chartable = (F.col("points") >= 2) & one_unit
    return g.select(
        "patient_id", "analyte_key", "points", "first_value", "last_value",
        chartable.alias("chartable"),
        F.when(chartable, F.round(F.col("last_value") - F.col("first_value"), 4)).alias("delta"),
        F.when(F.col("points") < 2, "single_value").when(~one_unit, "mixed_units")
        .alias("not_chartable_because"),
    )


def recurrence(encounters: DataFrame) -> DataFrame:
    """Intake visits per (patient, headline), with the patient's totals."""
    intakes = encounters.filter("kind = 'intake'")
    headline = F.lower(F.trim(F.coalesce(_told("headline"), F.lit("Unspecified"))))
    groups = intakes.groupBy("patient_id", headline.alias("headline_key")).agg(
        F.count(F.lit(1)).alias("visits"), F.min("occurred_on").alias("first_on"),
        F.max("occurred_on").alias("last_on"))
    # Totals come from the groups; headlines are free text, so a patient may have many of them.
    totals = groups.groupBy("patient_id").agg(
        F.sum("visits").alias("patient_visits"), F.min("first_on").alias("first_seen_on"))
    return wide_join(groups, totals, ["patient_id"])


def previous_intakes(encounters: DataFrame) -> DataFrame:
    """(encounter, previous) for intakes: the latest one on a strictly earlier date.

    Visits are first reduced to one per patient and date (the highest id), dates are linked to
    the date before, and each visit takes the link of its date.
    """
    intakes = encounters.filter("kind = 'intake'").select("encounter_id", "patient_id",
                                                          "occurred_on")
    days = intakes.groupBy("patient_id", "occurred_on").agg(
        F.max("encounter_id").alias("_top"))
    linked = with_previous(days, ["patient_id"], ["occurred_on"], F.year("occurred_on"),
                           ["_top"], "_p")
    return intakes.join(
        linked.select("patient_id", "occurred_on", F.col("_p._top").alias("previous_id")),
        ["patient_id", "occurred_on"],
    ).select("encounter_id", "previous_id")


def previous_in_order(encounters: DataFrame) -> DataFrame:
    """(encounter, previous) by position in (date, id) order over the given encounters."""
    rows = with_previous(
        encounters.select("encounter_id", "patient_id", "occurred_on"), ["patient_id"],
        ["occurred_on", "encounter_id"],
        F.struct("occurred_on", F.expr(f"encounter_id div {ID_CHUNK}")), ["encounter_id"], "_p")
    return rows.select("encounter_id", F.col("_p.encounter_id").alias("previous_id"))


def changes(features: DataFrame, links: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """new, resolved or persisting for each (path, item) of a visit and the one before it.

    Each visit's features are read once and told to the visits that they are the present or the
    past of, then reduced by key; a visit is never paired with another. ``carried`` columns keep
    their largest value at the present visit. A visit without an earlier one gives no rows.
    """
    role = lambda column, now: F.struct(F.col(column).alias("_source"), F.lit(now).alias("_now"))
    roles = links.filter("previous_id IS NOT NULL").select(
        "encounter_id", F.inline(F.array(role("encounter_id", True), role("previous_id", False))))
    now = F.col("_now")
    sides = features.withColumnRenamed("encounter_id", "_source").join(roles, "_source").groupBy(
        "encounter_id", "path", "item").agg(
            F.bool_or(now).alias("_here"), F.bool_or(~now).alias("_before"),
            *[F.max(F.when(now, F.col(c))).alias(c) for c in carried])
    label = F.when(F.col("_here") & F.col("_before"), "persisting").when(
        F.col("_here"), "new").otherwise("resolved")
    return sides.select("encounter_id", "path", "item", label.alias("change"), *carried)


def feature_changes(features: DataFrame, encounters: DataFrame) -> DataFrame:
    """Changes of the compared features against the previous intake on an earlier date."""
    return changes(features, previous_intakes(encounters))


def fact_pairs(facts: DataFrame) -> DataFrame:
    """(encounter, path, item) of live, asked facts with a fact that shows it; the item is the
    displayed value."""
    shown = F.coalesce(_told("display_value"), value_text(F.col("value")))
    return facts.filter(is_live()).groupBy("encounter_id", "path", shown.alias("item")).agg(
        F.max("fact_id").alias("fact_id"), F.bool_or(F.col("state") != "not_asked").alias("_asked")
    ).filter("_asked AND item IS NOT NULL").drop("_asked")


def fact_changes(
    facts: DataFrame, encounters: DataFrame, visits: DataFrame | None = None
) -> DataFrame:
    """Changes of all live facts against the previous confirmed intake; adds a current fact.

    With ``visits`` (encounter_id), the changes of these alone.
    """
    links = previous_in_order(encounters)
    if visits is not None:
        links = keyed_join(links, visits.select("encounter_id"), ["encounter_id"], "left_semi")
    return changes(fact_pairs(facts), links, ("fact_id",))


def visit_gaps(facts: DataFrame) -> DataFrame:
    """Declined or unknown, superseded and invalidated facts; a fact may be in several classes."""
    classes = F.array_compact(F.array(
        F.when(is_live() & F.col("state").isin(*ABSENCE_STATES), F.lit("declined_or_unknown")),
        F.when(F.col("superseded_by").isNotNull(), F.lit("superseded")),
        F.when(F.col("invalidated_reason").isNotNull(), F.lit("invalidated")),
    ))
    return facts.select("encounter_id", "fact_id", "path", F.explode(classes).alias("gap"))


def standing_facts(facts: DataFrame) -> DataFrame:
    """The last live fact of each (encounter, path)."""
    cols = [c for c in facts.columns if c not in ("encounter_id", "path")]
    return (
        facts.filter(is_live()).groupBy("encounter_id", "path")
        .agg(F.max_by(F.struct(*cols), "fact_id").alias("_f"))
        .select("encounter_id", "path", "_f.*")
    )


FIELDS = SNAPSHOT_FIELDS + ALLERGY_FIELDS


def field_coverage(encounters: DataFrame, facts: DataFrame, fields=FIELDS) -> DataFrame:
    """collected, declined or missing for each (encounter, field)."""
    paths = [f[0] for f in fields]
    standing = standing_facts(facts.filter(F.col("path").isin(*paths)))
    states = standing.groupBy("encounter_id").agg(
        F.map_from_entries(F.collect_list(F.struct("path", "state"))).alias("_states"))
    names = F.expr("array(" + ", ".join(f"'{p}'" for p in paths) + ")")
    rows = encounters.select("encounter_id").join(states, "encounter_id", "left").select(
        "encounter_id", "_states", F.explode(names).alias("path"))
    state = F.try_element_at("_states", F.col("path"))
    status = (
        F.when(state.isNull() | (state == "not_asked"), "missing")
        .when(state.isin(*ABSENCE_STATES), "declined").otherwise("collected")
    )
    return rows.select("encounter_id", "path", status.alias("status"))


def current_snapshot(facts: DataFrame, evidence: DataFrame, fields=FIELDS) -> DataFrame:
    """The reading-order lines of each encounter that have evidence, with what each can open."""
    paths = [f[0] for f in fields]
    standing = standing_facts(facts.filter(F.col("path").isin(*paths)))
    asked = standing.filter("state <> 'not_asked'")
    sources = evidence.groupBy("fact_id").agg(
        F.count(F.lit(1)).alias("evidence_rows"),
        F.array_sort(F.collect_set("source_type")).alias("evidence_kinds"),
        F.array_sort(F.collect_set("modality")).alias("evidence_modalities"),
    )
    position = rank_of({p: i for i, p in enumerate(paths)})
    labels = rank_of({f[0]: f[1] for f in fields})
    return asked.join(sources, "fact_id").withColumns({
        "position": position(F.col("path")), "label": labels(F.col("path")),
        "block": F.when(position(F.col("path")) < len(SNAPSHOT_FIELDS), "snapshot")
        .otherwise("allergy"),
    })


def medication_list(meds: DataFrame, current: DataFrame) -> DataFrame:
    """Medicines with where each came from. ``current`` holds patient_id, encounter_id."""
    now = current.select("patient_id", F.col("encounter_id").alias("_now"))
    here = F.col("encounter_id") == F.col("_now")
    return keyed_join(meds, now, ["patient_id"], "left").withColumn(
        "origin", F.when(here, "this-visit").otherwise("previous-visit")).drop("_now")


def encounter_list(encounters: DataFrame, current: DataFrame) -> DataFrame:
    """Encounters with a mark on the current one of each patient."""
    now = current.select("encounter_id", F.lit(True).alias("is_current"))
    return keyed_join(encounters, now, ["encounter_id"], "left").withColumn(
        "is_current", F.coalesce("is_current", F.lit(False)))


def fired_summary(proposals: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Rules evaluated and the ids that fired; the list is no longer than the rule set."""
    return proposals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if("fired").alias("fired_count"),
        F.array_sort(F.collect_list(F.when(F.col("fired"), F.col("rule_id")))).alias("fired"),
    )


def triage_queue(sessions: DataFrame, as_of: Column) -> DataFrame:
    """Unpurged sessions with waiting minutes; sort by `rank` then created_at for the queue."""
    waited = (F.unix_timestamp(as_of) - F.unix_timestamp(F.col("created_at"))) / 60
    rank = F.when(F.col("priority") == "immediate", 0).when(F.col("priority") == "urgent", 1).when(
        F.col("priority") == "routine", 2).otherwise(3)
    return sessions.filter("purged_at IS NULL").withColumns(
        {"waiting_minutes": F.floor(waited).cast("long"), "rank": rank})


def ledger_inspection(facts: DataFrame, proposals: DataFrame, absences: DataFrame) -> DataFrame:
    """Counts per session: active, superseded, by tier, without source, absences, rules."""
    active = F.col("superseded_by").isNull()
    tier = F.col("tier")
    f = facts.groupBy("session_id").agg(
        _count_if(active, "active"), _count_if(~active, "superseded"),
        *[_count_if(active & (tier == t), t) for t in ("stated", "confirmed", "document")],
        _count_if(F.trim(F.coalesce("verbatim", F.lit(""))) == "", "without_source"),
    )
    p = proposals.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("rules_evaluated"), _count_if(F.col("fired"), "rules_fired"))
    a = absences.groupBy("session_id").agg(F.count(F.lit(1)).alias("absences"))
    return f.join(p, "session_id", "left").join(a, "session_id", "left").na.fill(0)


def open_contradictions(contradictions: DataFrame) -> DataFrame:
    return contradictions.filter("status = 'open'")


def facts_with_evidence(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per fact and evidence row; a fact without evidence keeps one row with a null id."""
    return facts.join(evidence, "fact_id", "left")
