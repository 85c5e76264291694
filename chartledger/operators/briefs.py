"""The clinician's brief and the patient's view of it, one row per line.

A brief is for a patient's current visit. Its lines come from the longitudinal operators; each
carries its section and the columns to sort by. Lines of one patient are never gathered into one
value.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartledger.operators import longitudinal as G
from chartledger.functions.ordered import keyed_join
from chartledger.functions.values import rank_of, value_text
from chartledger.sources.documents import fragments

_COLUMNS = ("patient_id", "encounter_id", "section", "sort_key", "item")
# The order of a brief's sections.
SECTIONS = ("snapshot", "red_flags", "contradictions", "unresolved", "what_changed", "medications",
            "observations", "timeline", "completeness", "confirmation")

# Fixed value: by how much a distinct over nearly all rows is cut finer than other shuffles.
SPREAD = 8


def _lines(df: DataFrame, section: str, sort_key: Column, *fields) -> DataFrame:
    return df.select(
        "patient_id", "encounter_id", F.lit(section).alias("section"),
        sort_key.cast("string").alias("sort_key"), F.to_json(F.struct(*fields)).alias("item"))


def brief_facts(current: DataFrame, encounters: DataFrame, facts: DataFrame) -> DataFrame:
    """The facts that the briefs of ``current`` are made of: those of each visit named there and of
    the confirmed intake before it. `encounter_briefs` gives the same lines with these alone."""
    confirmed = encounters.filter("kind = 'intake' AND confirmed_by <> ''")
    before = keyed_join(G.previous_in_order(confirmed), current.select("encounter_id"),
                        ["encounter_id"], "left_semi").filter("previous_id IS NOT NULL")
    visits = current.select("encounter_id").union(before.select("previous_id"))
    return keyed_join(facts, visits, ["encounter_id"], "left_semi")


def encounter_briefs(
    current: DataFrame, encounters: DataFrame, facts: DataFrame, evidence: DataFrame,
    meds: DataFrame, observations: DataFrame, fired: DataFrame, contradictions: DataFrame,
    decisions: DataFrame,
) -> DataFrame:
    """All lines of all briefs. ``current`` names one visit per patient.

    ``fired`` and ``contradictions`` hold encounter_id; ``decisions`` encounter_id, decision,
    actor. Sections of the visit are cut to the current visits before any work is done on them.
    """
    now = current.select("patient_id", "encounter_id")
    visit = lambda df: keyed_join(df, now, ["encounter_id"])
    person = lambda df: keyed_join(df.drop("encounter_id"), now, ["patient_id"])
    held = keyed_join(facts, now.select("encounter_id"), ["encounter_id"], "left_semi")
    snapshot = visit(G.current_snapshot(held, evidence))
    confirmed = encounters.filter("kind = 'intake' AND confirmed_by <> ''")
    parts = [
        _lines(snapshot, "snapshot", F.lpad(F.col("position").cast("string"), 3, "0"), "block",
               "label", "path", F.coalesce("display_value", value_text(F.col("value")))
               .alias("value"), "fact_id", "evidence_kinds", "evidence_modalities"),
        _lines(visit(G.visit_gaps(held)), "unresolved", F.col("fact_id"), "gap", "path", "fact_id"),
        _lines(visit(G.field_coverage(now, held)), "completeness", F.col("path"), "path",
               "status"),
        _lines(visit(G.fact_changes(facts, confirmed, now)), "what_changed",
               F.concat_ws("|", "path", "item"), "change", "path", F.col("item").alias("value"),
               "fact_id"),
        _lines(person(G.medication_list(meds, current)), "medications",
               F.col("name"), "name", "dose", "status", "observed_on", "origin"),
        _lines(person(G.observation_trend(observations)), "observations", F.col("analyte_key"),
               "analyte_key", "points", "first_value", "last_value", "chartable", "delta",
               "not_chartable_because"),
        _lines(person(G.encounter_list(encounters, current).withColumn(
            "visit_id", F.col("encounter_id"))), "timeline", F.col("occurred_on"), "visit_id",
            "occurred_on", "headline", "priority", "is_current"),
        _lines(visit(fired), "red_flags", F.col("rule_id"), "rule_id", "level"),
        _lines(visit(contradictions), "contradictions", F.col("contradiction_ref"),
               "contradiction_ref", "rule_id"),
        _lines(visit(decisions), "confirmation", F.col("decision"), "decision", "actor"),
    ]
    return reduce(DataFrame.unionByName, parts)


def brief_fragments(lines: DataFrame) -> DataFrame:
    """The text of every brief as one document, in fragments: encounter_id, value.

    A document has patient_id, encounter_id and one list for each section that has lines.
    """
    return fragments(lines, "encounter_id", SECTIONS, F.struct("patient_id", "encounter_id"),
                     ["sort_key"], F.col("item"))


def patient_view(
    snapshot: DataFrame, previous_meds: DataFrame, trends: DataFrame, fields=G.FIELDS
) -> DataFrame:
    """The same record in the patient's words, in four groups.

    ``snapshot`` is `current_snapshot` with patient_id and confirmed_by_physician;
    ``previous_meds`` is `medication_list`; ``trends`` is `observation_trend`. Ids, tiers, scores
    and all other internal columns are left out.
    """
    plain = rank_of({f[0]: f[2] for f in fields})
    shown = F.coalesce("display_value", value_text(F.col("value")))
    lines = snapshot.select(
        "patient_id", plain(F.col("path")).alias("label"), shown.alias("value"),
        F.array_contains("evidence_kinds", "document").alias("_paper"),
        F.coalesce("confirmed_by_physician", F.lit(False)).alias("_checked"),
    ).filter("value <> ''")
    groups = F.array_compact(F.array(
        F.when(F.col("_paper"), "from_documents").otherwise("told_us"),
        F.when(~F.col("_checked"), F.lit("awaiting")),
    ))
    own = lines.select("patient_id", F.explode(groups).alias("group"), "label", "value")
    # Nearly every medicine is a group of its own: what is compared is narrow and spread widely, and
    # the words that all share are added behind.
    named = previous_meds.filter("origin = 'previous-visit'").select(
        "patient_id", F.concat_ws(" ", "name", "dose").alias("value"))
    parts = SPREAD * int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drugs = named.repartition(parts, "patient_id", "value").distinct().select(
        "patient_id", F.lit("previous").alias("group"),
        F.lit("Medicine from an earlier visit").alias("label"), "value")
    labs = trends.filter("chartable").select(
        "patient_id", F.lit("previous").alias("group"),
        F.concat("analyte_key", F.lit(" over time")).alias("label"),
        F.concat(F.col("first_value").cast("string"), F.lit(", then "),
                 F.col("last_value").cast("string")).alias("value"))
    return own.unionByName(drugs).unionByName(labs)
