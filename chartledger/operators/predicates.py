"""Row filters, labels and access rules over record tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartledger.config.vocabulary import (
    ASSESSMENT_FIELDS,
    HOW_KNOWN,
    OCR_HIGH_CONFIDENCE,
    OCR_LOW_CONFIDENCE,
    POLICY,
    STAFF_ROLES,
)
from chartledger.functions.values import rank_of


def is_live() -> Column:
    return F.col("superseded_by").isNull() & F.col("invalidated_reason").isNull()


def live_facts(facts: DataFrame) -> DataFrame:
    """Facts that are neither superseded nor invalidated."""
    return facts.filter(is_live())


def renderable(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Live facts that were asked and have at least one evidence row."""
    wanted = live_facts(facts).filter(F.col("state") != "not_asked")
    return wanted.join(evidence.select("fact_id"), "fact_id", "left_semi")


def confirmed_encounters(encounters: DataFrame) -> DataFrame:
    """Intake encounters that somebody confirmed."""
    return encounters.filter((F.col("kind") == "intake") & (F.col("confirmed_by") != ""))


def same_cohort(pairs: DataFrame, patients: DataFrame, left: str, right: str) -> DataFrame:
    """Keep pairs whose two patients are both synthetic or both clinical; adds `cohort`.

    The flag is part of the second join's key, so a pair across cohorts never leaves the join.
    """
    flags = patients.select("patient_id", F.coalesce("is_synthetic", F.lit(False)).alias("_flag"))
    first = pairs.join(flags.withColumnRenamed("patient_id", left), left)
    both = first.join(flags.withColumnRenamed("patient_id", right), [right, "_flag"])
    return both.withColumn(
        "cohort", F.when(F.col("_flag"), "synthetic").otherwise("clinical")
    ).drop("_flag")


def decide(role: str, purpose: str, action: str, policy=POLICY) -> dict:
    """Resolve the access policy once, on the driver."""
    denied = {"allowed": False, "strip_identifiers": True, "aggregate_only": False}
    if purpose not in policy["purposes"]:
        raise ValueError(f"purpose {purpose!r} is not in the policy")
    rules = policy["roles"].get(role)
    if rules is None:
        return {**denied, "reason": "role_undefined"}
    if purpose not in rules["purposes"]:
        return {**denied, "reason": "purpose_not_allowed"}
    if action not in rules["actions"]:
        return {**denied, "reason": "action_not_allowed"}
    return {"allowed": True, "reason": None, **policy["purposes"][purpose]}


def apply_purpose(
    df: DataFrame,
    role: str,
    purpose: str,
    action: str,
    identifiers: list[str],
    cells: list[str],
    minimum_cell: int = 5,
    policy=POLICY,
) -> DataFrame:
    """Enforce the policy: no rows when denied, hashed identifiers, or counts per cell.

    ``cells`` are the columns an aggregate-only purpose may group by; cells with fewer rows than
    ``minimum_cell`` are left out.
    """
    decision = decide(role, purpose, action, policy)
    if not decision["allowed"]:
        return df.filter(F.lit(False))
    if decision["aggregate_only"]:
        counts = df.groupBy(*cells).agg(F.count(F.lit(1)).alias("n"))
        return counts.filter(F.col("n") >= minimum_cell)
    if decision["strip_identifiers"]:
        hashed = {c: F.sha2(F.col(c).cast("string"), 256) for c in identifiers}
        return df.withColumns(hashed)
    return df


def owned_rows(rows: DataFrame, identities: DataFrame) -> DataFrame:
    """(viewer, row) pairs a viewer may open.

    ``identities`` holds viewer, role, abha_ref. A patient sees rows under the same non-null
    reference. Staff are not matched row by row: their role decides, see `sees_everything`.
    """
    patients = identities.filter((F.col("role") == "patient") & (F.col("abha_ref") != ""))
    return rows.join(patients.select("viewer", "abha_ref"), "abha_ref")


def sees_everything(identities: DataFrame) -> DataFrame:
    """Viewers whose role opens every row."""
    return identities.filter(F.col("role").isin(*STAFF_ROLES))


def confidence_band(
    confidence: Column, handwritten: Column, text: Column, failure: Column
) -> Column:
    """unreadable, verify, medium or high. An unmeasured (null) confidence asks for a check."""
    unreadable = failure.isNotNull() | (F.trim(F.coalesce(text, F.lit(""))) == "")
    return (
        F.when(unreadable, "unreadable")
        .when(confidence.isNull() | handwritten | (confidence <= OCR_LOW_CONFIDENCE), "verify")
        .when(confidence >= OCR_HIGH_CONFIDENCE, "high")
        .otherwise("medium")
    )


def how_known(status: Column) -> Column:
    """The wording for a medication status; an unknown status passes through."""
    return F.coalesce(rank_of(HOW_KNOWN)(status), status)


def assessment_fields(df: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    """One row per forbidden JSON key, at any depth, in each document.

    The pattern consumes whole JSON strings and keeps those followed by a colon, so a value that
    happens to read like a key is not taken for one.
    """
    strings = F.regexp_extract_all(
        F.col(json_col), F.lit(r'"((?:[^"\\]|\\.)*)"(\s*:)?'), F.lit(0)
    )
    keys = F.filter(strings, lambda s: s.rlike(r':$'))
    named = F.transform(keys, lambda s: F.regexp_extract(s, r'^"((?:[^"\\]|\\.)*)"', 1))
    return df.select(*keep, F.explode(named).alias("field")).filter(
        F.lower("field").isin(*ASSESSMENT_FIELDS)
    )
