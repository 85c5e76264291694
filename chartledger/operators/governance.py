"""Audit chains, provenance completeness, retention plans and record counts."""

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartledger.config.vocabulary import (
    ABSENCE_OK,
    AUDIT_REDACTED_KEYS,
    GENESIS_HASH,
    GUEST_PREFIX,
)
from chartledger.functions.ordered import range_chunk, with_previous


def row_hash(previous: Column, payload: Column) -> Column:
    """The hash of a row behind another one; a null payload counts as empty."""
    return F.sha2(F.concat(previous, F.coalesce(payload, F.lit(""))), 256)


def verify_chain(
    events: DataFrame, keys: list[str] | None = None, id_chunk: int | None = None
) -> DataFrame:
    """One row per chain: is it intact, and where does it break first?

    ``events`` holds id, prev_hash, hash and payload (the canonical text the hash covers). Without
    ``keys`` the whole table is one chain. A row breaks the chain when it does not name the stored
    hash before it (link) or its content no longer gives its hash (content). Each check needs only
    the stored hash of the row before, so rows are checked in parallel: ids are cut into ranges
    of about equally many rows, whatever their values (or, with ``id_chunk``, into steps of that
    many ids), and only one row per range travels between them.
    """
    keys = keys or []
    chunk = F.expr(f"id div {id_chunk}") if id_chunk else range_chunk(events, "id")
    rows = with_previous(events, keys, ["id"], chunk, ["hash"], "_p", position="_at")
    before = F.coalesce(F.col("_p.hash"), F.lit(GENESIS_HASH))
    kind = F.when(~F.col("prev_hash").eqNullSafe(before), "link").when(
        ~row_hash(before, F.col("payload")).eqNullSafe(F.col("hash")), "content")
    found = rows.select(*keys, F.when(kind.isNotNull(), F.struct("_at", "id", kind.alias("kind")))
                        .alias("_b"))
    first = found.groupBy(*keys).agg(F.min("_b").alias("_b"), F.count(F.lit(1)).alias("_n"))
    return first.select(
        *keys, F.col("_b").isNull().alias("intact"),
        F.coalesce(F.col("_b._at").cast("long"), F.col("_n")).alias("checked"),
        F.col("_b._at").cast("long").alias("first_broken_index"),
        F.col("_b.id").alias("first_broken_id"), F.col("_b.kind").alias("broken_kind"),
    )


def _links(chain: list[str]):
    """Adds prev_hash and hash to rows sorted by chain; only the last hash is carried along."""
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = last = None
        for batch in batches:
            before, made = [], []
            for *own, start, payload in zip(*[batch[c].to_pylist() for c in (
                    *chain, "_start", "payload")], strict=True):
                if own != here:
                    here, last = own, start or GENESIS_HASH
                before.append(last)
                last = hashlib.sha256((last + (payload or "")).encode()).hexdigest()
                made.append(last)
            names = [n for n in batch.schema.names if n != "_start"]
            yield pa.RecordBatch.from_arrays(
                [*[batch[n] for n in names], pa.array(before, pa.string()),
                 pa.array(made, pa.string())], names=[*names, "prev_hash", "hash"])

    return link


def seal_rows(events: DataFrame, keys: list[str], rows_per_segment: int | None = 1000,
              tails: DataFrame | None = None) -> DataFrame:
    """Link rows into one hash chain per (keys, segment); adds segment, prev_hash and hash.

    A segment is a run of ``rows_per_segment`` consecutive ids; with None a chain has one segment,
    of any length. Chains are worked out side by side, each in one pass over its sorted rows with
    the last hash in hand, so a long chain takes time but no memory. Rows of equal ids are links of
    their own, in the order of their payloads. ``tails`` (keys, segment, hash) are the ends of
    chains sealed before, which these rows go on from. As many rows come back as were given.
    """
    segment = F.expr(f"id div {rows_per_segment}") if rows_per_segment else F.lit(0).cast("long")
    rows = events.drop("prev_hash", "hash", "segment").withColumn("segment", segment)
    chain = [*keys, "segment"]
    start = F.lit(None).cast("string")  # the start of a chain without a tail
    if tails is not None:
        ends = tails.select(*[F.col(c).alias(f"_{c}") for c in [*chain, "hash"]])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in chain]
        rows = rows.join(ends, same, "left").drop(*[f"_{c}" for c in chain])
        start = F.col("_hash")
    rows = rows.withColumn("_start", start).drop("_hash")
    plain = [c for c in rows.columns if c != "_start"]
    schema = T.StructType([*rows.select(*plain).schema.fields, T.StructField(
        "prev_hash", T.StringType()), T.StructField("hash", T.StringType())])
    dealt = rows.repartition(*chain).sortWithinPartitions(*chain, "id", "payload")
    return dealt.mapInArrow(_links(chain), schema)


def chain_tails(sealed: DataFrame, keys: list[str]) -> DataFrame:
    """The end of each sealed chain: keys, segment, hash. It is the one hash that no row of the
    chain names as the hash before it."""
    chain = [*keys, "segment"]
    made = sealed.select(*chain, "hash", F.lit(1).alias("_n"))
    named = sealed.select(*chain, F.col("prev_hash").alias("hash"), F.lit(-1).alias("_n"))
    return made.unionByName(named).groupBy(*chain, "hash").agg(F.sum("_n").alias("_n")).filter(
        "_n = 1").drop("_n")


def segment_digests(events: DataFrame, keys: list[str], rows_per_segment: int = 1000) -> DataFrame:
    """One digest per (keys, segment) over its rows' digests in id order."""
    one = F.struct("id", F.sha2("payload", 256).alias("d"))
    return (
        events.withColumn("segment", F.expr(f"id div {rows_per_segment}"))
        .groupBy(*keys, "segment").agg(F.array_sort(F.collect_list(one)).alias("_r"),
                                       F.count(F.lit(1)).alias("rows"))
        .select(*keys, "segment", "rows",
                F.sha2(F.array_join(F.transform("_r", lambda r: r["d"]), ""), 256).alias("digest"))
    )


def verify_segments(
    stored: DataFrame, events: DataFrame, keys: list[str], rows_per_segment: int = 1000
) -> DataFrame:
    """ok, changed, missing (sealed but gone) or unsealed, per (keys, segment)."""
    now = segment_digests(events, keys, rows_per_segment).select(
        *keys, "segment", F.col("digest").alias("_now"))
    both = stored.select(*keys, "segment", "digest").join(now, [*keys, "segment"], "full")
    status = (
        F.when(F.col("_now").isNull(), "missing").when(F.col("digest").isNull(), "unsealed")
        .when(F.col("digest") != F.col("_now"), "changed").otherwise("ok")
    )
    return both.select(*keys, "segment", status.alias("status"))


REDACTED = "<redacted>"


def scrub_json(text: str | None, forbidden=frozenset(AUDIT_REDACTED_KEYS)) -> str | None:
    """`scrub_column` for a JSON text, at any depth: canonical JSON with sorted keys.

    A bare string, and a text that is no JSON, cannot be vouched for and is redacted whole.
    """
    if text is None:
        return None

    def clean(value):
        if isinstance(value, dict):
            return {k: REDACTED if k in forbidden else clean(v) for k, v in value.items()}
        return f"<{len(value)} item(s)>" if isinstance(value, list) else value

    try:
        value = json.loads(text)
        told = REDACTED if isinstance(value, str) else clean(value)
    except (ValueError, RecursionError):
        told = REDACTED
    return json.dumps(told, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _scrubbed_texts(forbidden):
    @F.pandas_udf("string")
    def scrubbed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: scrub_json(t, forbidden))

    return scrubbed


def scrub_column(col: Column, dtype: T.DataType, forbidden=AUDIT_REDACTED_KEYS) -> Column:
    """Rewrite a struct or map column: forbidden keys redacted, lists replaced by their size."""
    redacted = F.lit(REDACTED)
    if isinstance(dtype, T.StructType):
        fields = []
        for field in dtype.fields:
            if field.name in forbidden:
                value = redacted
            else:
                value = scrub_column(col[field.name], field.dataType, forbidden)
            fields.append(value.alias(field.name))
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.when(col.isNotNull(), F.concat(F.lit("<"), F.size(col).cast("string"),
                                                F.lit(" item(s)>")))
    if isinstance(dtype, T.MapType) and isinstance(dtype.valueType, T.StringType):
        return F.transform_values(
            col, lambda k, v: F.when(k.isin(*forbidden), redacted).otherwise(v))
    if isinstance(dtype, T.MapType):
        return F.transform_values(
            col, lambda k, v: F.when(k.isin(*forbidden), redacted).otherwise(
                F.to_json(scrub_column(v, dtype.valueType, forbidden))
                if isinstance(dtype.valueType, (T.StructType, T.MapType))
                else scrub_column(v, dtype.valueType, forbidden).cast("string")))
    return col


def scrub_audit(events: DataFrame, columns: list[str]) -> DataFrame:
    """Scrub payload columns before anything is hashed or stored.

    Structs and maps are rewritten by their types. A text column holds JSON, as stored payloads do,
    and is rewritten at any depth by `scrub_json`. A list column becomes its size. Columns of
    other types cannot hold keys to redact and are refused.
    """
    rewritten = {}
    for c in columns:
        dtype = events.schema[c].dataType
        if isinstance(dtype, T.StringType):
            rewritten[c] = _scrubbed_texts(frozenset(AUDIT_REDACTED_KEYS))(F.col(c))
        elif isinstance(dtype, (T.StructType, T.MapType, T.ArrayType)):
            rewritten[c] = scrub_column(F.col(c), dtype)
        else:
            raise TypeError(f"column {c} of type {dtype.simpleString()} cannot be scrubbed")
    return events.withColumns(rewritten)


def audit_trail(encounters: DataFrame, events: DataFrame) -> DataFrame:
    """Events recorded under an encounter's consent reference; sort by ts and id to read them."""
    asked = encounters.filter("consent_ref <> ''").select("encounter_id", "consent_ref")
    return events.filter("consent_ref IS NOT NULL").join(asked, "consent_ref")


def _has_evidence(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    backed = evidence.select("fact_id").distinct().withColumn("_e", F.lit(True))
    return facts.join(backed, "fact_id", "left").withColumn(
        "_e", F.coalesce("_e", F.lit(False)))


def unsourced_facts(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts with neither evidence nor a state that explains its absence."""
    rows = _has_evidence(facts, evidence)
    return rows.filter(~F.col("_e") & ~F.col("state").isin(*ABSENCE_OK)).select(
        "encounter_id", "fact_id", "path", "state")


def provenance_completeness(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per encounter: facts, with evidence, with a stated absence, offenders, complete."""
    rows = _has_evidence(facts, evidence)
    offender = ~F.col("_e") & ~F.col("state").isin(*ABSENCE_OK)
    counts = rows.groupBy("encounter_id").agg(
        F.count(F.lit(1)).alias("total_facts"), F.count_if("_e").alias("with_evidence"),
        F.count_if(offender).alias("offenders"))
    return counts.withColumn(
        "with_absence", F.col("total_facts") - F.col("with_evidence") - F.col("offenders")
    ).withColumn("complete", F.col("offenders") == 0)


def encounter_review(
    encounters: DataFrame, events: DataFrame, facts: DataFrame, evidence: DataFrame,
    assessment_hits: DataFrame,
) -> DataFrame:
    """One row per encounter: trail length, provenance counts and assessment-shaped fields.

    ``assessment_hits`` holds encounter_id, one row per forbidden field found. The state of the
    audit chain is one row for the whole table; take it from `verify_chain`.
    """
    trail = audit_trail(encounters, events).groupBy("encounter_id").agg(
        F.count(F.lit(1)).alias("trail_events"))
    hits = assessment_hits.groupBy("encounter_id").agg(F.count(F.lit(1)).alias("assessment_hits"))
    out = encounters.select("encounter_id", "confirmed_by", "consent_ref")
    for part in (trail, provenance_completeness(facts, evidence), hits):
        out = out.join(part, "encounter_id", "left")
    return out.na.fill(0, ["trail_events", "total_facts", "with_evidence", "offenders",
                           "with_absence", "assessment_hits"]).withColumns({
        "complete": F.coalesce("complete", F.lit(True)),
        "clean": F.col("assessment_hits") == 0,
    })


def _count_by(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def expired_sessions(
    sessions: DataFrame, as_of: Column, session_tables: dict[str, DataFrame]
) -> DataFrame:
    """The purge plan: sessions past their time, with the rows each table would lose.

    Consent and audit rows survive and are not part of the plan. Each table is cut to the expired
    sessions first and then counted.
    """
    due = sessions.filter(
        F.col("purged_at").isNull() & F.col("expires_at").isNotNull()
        & (F.col("expires_at") < as_of)
    ).select("session_ref")
    plan = due
    for name, table in session_tables.items():
        counts = _count_by(table.join(due, "session_ref", "left_semi"), "session_ref", name)
        plan = plan.join(counts, "session_ref", "left")
    return plan.na.fill(0, list(session_tables))


def purge(table: DataFrame, plan: DataFrame) -> DataFrame:
    """What is left of a session table after the plan is carried out."""
    return table.join(plan.select("session_ref"), "session_ref", "left_anti")


def expired_guests(patients: DataFrame, cutoff: Column) -> DataFrame:
    """Guests to sweep: synthetic, named as a guest, and older than the cutoff. All three."""
    return patients.filter(
        F.col("is_synthetic") & F.col("patient_ref").startswith(GUEST_PREFIX)
        & (F.col("created_at") < cutoff)
    )


def guest_sweep(
    patients: DataFrame, encounters: DataFrame, cutoff: Column,
    by_session: dict[str, DataFrame], by_encounter: dict[str, DataFrame],
) -> tuple[DataFrame, DataFrame]:
    """(plan, swept sessions). The plan counts the rows to remove per victim and table.

    Audit rows are never part of it: removing them would break the chain. Carry the plan out with
    anti-joins, then check `session_residue`.
    """
    victims = expired_guests(patients, cutoff).select("patient_id", "patient_ref")
    visits = encounters.select("patient_id", "encounter_id", "session_ref").join(
        victims.select("patient_id"), "patient_id", "left_semi")
    plan = victims.join(_count_by(visits, "patient_id", "encounter"), "patient_id", "left")
    for name, table in by_encounter.items():
        owned = table.select("encounter_id").join(
            visits.select("encounter_id", "patient_id"), "encounter_id")
        plan = plan.join(_count_by(owned, "patient_id", name), "patient_id", "left")
    gone = visits.filter("session_ref IS NOT NULL").select("session_ref", "patient_id").distinct()
    for name, table in by_session.items():
        owned = table.select("session_ref").join(gone, "session_ref")
        plan = plan.join(_count_by(owned, "patient_id", name), "patient_id", "left")
    return plan.na.fill(0), gone.select("session_ref").distinct()


def session_residue(tables: dict[str, DataFrame], swept: DataFrame) -> DataFrame:
    """Rows per table that still point at a swept session; every count must be 0."""
    parts = [
        table.join(swept, "session_ref", "left_semi").groupBy()
        .agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, table in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def orphan_report(
    tables: dict[str, DataFrame], sessions: DataFrame, encounters: DataFrame
) -> DataFrame:
    """Rows per table whose session is neither a live intake nor behind an encounter."""
    live = sessions.select("session_ref").filter("session_ref IS NOT NULL")
    kept = encounters.select("session_ref").filter("session_ref IS NOT NULL")
    parts = []
    for name, table in tables.items():
        stray = table.join(live, "session_ref", "left_anti").join(kept, "session_ref", "left_anti")
        parts.append(stray.groupBy().agg(F.count(F.lit(1)).alias("orphans"))
                     .select(F.lit(name).alias("table"), "orphans"))
    return reduce(DataFrame.unionByName, parts)


def record_shape(
    patients: DataFrame, encounters: DataFrame, facts: DataFrame, evidence: DataFrame,
    meds: DataFrame, observations: DataFrame,
) -> DataFrame:
    """Row counts per patient, to prove that a rebuild gives the same record."""
    owner = encounters.select("encounter_id", "patient_id")
    owned_facts = facts.select("fact_id", "encounter_id").join(owner, "encounter_id")
    backing = evidence.select("fact_id").join(owned_facts.select("fact_id", "patient_id"),
                                              "fact_id")
    out = patients.select("patient_id")
    for name, rows in (("encounters", owner), ("facts", owned_facts), ("evidence", backing),
                       ("medications", meds), ("observations", observations)):
        out = out.join(_count_by(rows, "patient_id", name), "patient_id", "left")
    return out.na.fill(0)


def shape_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Patients whose counts differ between two shapes; empty when a rebuild was exact."""
    gone = before.exceptAll(after).withColumn("side", F.lit("before"))
    new = after.exceptAll(before).withColumn("side", F.lit("after"))
    return gone.unionByName(new)
