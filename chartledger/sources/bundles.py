"""Exchange documents: one JSON resource per row, keyed by the encounter it belongs to.

A document is written as its entries, one line each (`write_bundles`), or whole, one document an
encounter (`write_encounter_documents`). All entries of one encounter are never gathered into one
value, so an encounter of any size can be exported.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartledger.config.vocabulary import SHARE_SCOPE
from chartledger.sources.documents import fragments, write_documents

# The order of the kinds of entries in a document.
KINDS = ("Composition", "Patient", "Consent", "Condition", "MedicationStatement", "Observation",
         "Flag", "DocumentReference", "Provenance")


def entry_id(*parts: Column) -> Column:
    """A stable reference made from natural keys; reruns give the same one."""
    return F.concat(F.lit("urn:sha:"), F.substring(F.sha2(F.concat_ws("|", *[
        p.cast("string") for p in parts]), 256), 1, 32))


def _quantity(value: Column, unit: Column) -> Column:
    """A number with its unit; a blank unit is left out."""
    clean = F.trim(unit)
    return F.when(value.isNotNull(), F.struct(
        value.alias("value"), F.when(clean != "", clean).alias("unit")))


def _concept(text: Column) -> Column:
    return F.struct(text.alias("text"))


def patient_ref() -> Column:
    return F.struct(entry_id(F.lit("patient"), F.col("patient_id")).alias("reference"))


def entry_values(
    encounters: DataFrame, problems: DataFrame, medications: DataFrame, observations: DataFrame,
    flags: DataFrame, documents: DataFrame, backing: DataFrame,
) -> DataFrame:
    """What the entries of every encounter's document are made of, one narrow row an entry.

    Every input holds encounter_id and a natural key `key`. ``backing`` links an entry's key and
    type to the fact behind it (target_type, key, tier, verbatim, location). ``kind`` is the place
    in KINDS; `entry_reference` and `entry_resource` make an entry of a row, where it is needed.
    """
    owner = encounters.select("encounter_id", "patient_id")

    def rows(df: DataFrame, kind: str, *columns) -> DataFrame:
        return df.select("encounter_id", F.lit(KINDS.index(kind) + 1).alias("kind"), *columns)

    def own(df: DataFrame, kind: str, *columns) -> DataFrame:
        return rows(df.join(owner, "encounter_id"), kind, "patient_id", "key", *columns)

    called = lambda name, column: F.col(column).alias(name)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        rows(encounters, "Composition", "patient_id", called("text", "confirmed_by")),
        rows(encounters, "Patient", "patient_id", called("text", "abha_ref")),
        rows(encounters.filter("consent_ref IS NOT NULL"), "Consent", "patient_id",
             called("text", "consent_ref")),
        own(problems, "Condition", called("text", "term")),
        own(medications, "MedicationStatement", called("text", "name"),
            F.concat_ws(" ", "dose", "frequency", "route").alias("more"),
            F.col("ongoing").isNotNull().alias("marked")),
        own(observations, "Observation", called("text", "display"), called("more", "unit"),
            called("last", "value_text"), "value", "reference_low", "reference_high"),
        own(flags, "Flag", called("text", "label"), called("more", "level")),
        own(documents, "DocumentReference", called("text", "filename")),
        rows(backing, "Provenance", "key", "target_type", called("text", "verbatim"),
             called("more", "tier"), called("last", "location")),
    ])


def entry_reference() -> Column:
    """The reference of an entry: from its encounter and its natural key; a patient's is the same
    everywhere."""
    lead = {"Composition": "doc", "Patient": "patient", "Consent": "consent"}
    names = F.array(*[F.lit(lead.get(k, k)) for k in KINDS])
    owner = F.when(F.col("kind") == KINDS.index("Patient") + 1, F.col("patient_id").cast("string"))
    return entry_id(F.element_at(names, F.col("kind")), owner.otherwise(
        F.col("encounter_id").cast("string")), F.col("target_type"), F.col("key"))


def entry_resource() -> Column:
    """The resource of an entry, as JSON."""
    text, more, last = F.col("text"), F.col("more"), F.col("last")
    number, low, high = F.col("value"), F.col("reference_low"), F.col("reference_high")
    bounds = F.struct(_quantity(low, more).alias("low"), _quantity(high, more).alias("high"))
    target = entry_id(F.col("target_type"), F.col("encounter_id"), F.col("key"))
    bodies = {
        "Composition": [
            F.lit("preliminary").alias("status"), patient_ref().alias("subject"),
            F.lit("Intake history").alias("title"), F.struct(text.alias("display")).alias("author")],
        "Patient": [
            F.lit(True).alias("active"),
            F.struct(F.coalesce(text, F.lit("unlinked")).alias("value")).alias("identifier")],
        "Consent": [
            F.lit("active").alias("status"), patient_ref().alias("patient"),
            _concept(text).alias("policyRule")],
        "Condition": [
            F.lit("unconfirmed").alias("verificationStatus"), patient_ref().alias("subject"),
            _concept(text).alias("code")],
        "MedicationStatement": [
            F.when(F.col("marked"), "active").otherwise("unknown").alias("status"),
            patient_ref().alias("subject"), _concept(text).alias("medication"),
            F.when(more != "", F.struct(more.alias("text"))).alias("dosage")],
        "Observation": [
            F.lit("final").alias("status"), patient_ref().alias("subject"),
            _concept(text).alias("code"), _quantity(number, more).alias("valueQuantity"),
            F.when(number.isNull(), last).alias("valueString"),
            F.when(F.coalesce(low, high).isNotNull(), bounds).alias("referenceRange")],
        "Flag": [
            F.lit("active").alias("status"), patient_ref().alias("subject"),
            _concept(F.concat(F.lit("["), F.upper(more), F.lit("] "), text)).alias("code")],
        "DocumentReference": [
            F.lit("current").alias("status"), patient_ref().alias("subject"),
            text.alias("description")],
        "Provenance": [
            F.struct(target.alias("reference")).alias("target"),
            _concept(more).alias("activity"),
            F.struct(F.concat(text, F.lit(" ["), last, F.lit("]")).alias("display"))
            .alias("entity")],
    }
    return F.coalesce(*[F.when(F.col("kind") == i, F.to_json(F.struct(
        F.lit(k).alias("resourceType"), *bodies[k]))) for i, k in enumerate(KINDS, 1)])


def encounter_bundles(
    encounters: DataFrame, problems: DataFrame, medications: DataFrame, observations: DataFrame,
    flags: DataFrame, documents: DataFrame, backing: DataFrame,
) -> DataFrame:
    """Entries of every encounter's document; the inputs are those of `entry_values`."""
    values = entry_values(
        encounters, problems, medications, observations, flags, documents, backing)
    return values.select(
        "encounter_id", entry_reference().alias("entry_id"),
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).alias("resource_type"),
        entry_resource().alias("resource"))


def resource_counts(entries: DataFrame) -> DataFrame:
    """Entries per encounter and kind. An encounter is one row of counters while it is counted, not
    one per kind; kinds outside KINDS are counted by name."""
    kind = F.col("resource_type")
    listed = F.coalesce(kind.isin(*KINDS), F.lit(False))
    wide = entries.filter(listed).groupBy("encounter_id").agg(
        *[F.count_if(kind == k).alias(k) for k in KINDS])
    told = wide.select("encounter_id", F.inline(F.array(*[
        F.struct(F.lit(k).alias("resource_type"), F.col(k).alias("n")) for k in KINDS])))
    other = entries.filter(~listed).groupBy("encounter_id", "resource_type").agg(
        F.count(F.lit(1)).alias("n"))
    return told.filter("n > 0").unionByName(other)


def write_bundles(entries: DataFrame, path: str) -> None:
    """One JSON resource per line; large encounters spread over files by the entry id."""
    entries.select("encounter_id", "entry_id", "resource").repartitionByRange(
        "encounter_id", "entry_id").sortWithinPartitions("encounter_id", "entry_id").select(
        F.to_json(F.struct("encounter_id", F.col("entry_id").alias("fullUrl"), "resource"))
    ).write.mode("error").text(path)


def _head() -> Column:
    return F.struct(
        F.lit("Bundle").alias("resourceType"), F.lit("document").alias("type"),
        F.struct(F.col("encounter_id").cast("string").alias("value")).alias("identifier"))


def _entry(resource: Column) -> Column:
    quoted = F.to_json(F.array("entry_id"))
    return F.concat(F.lit('{"fullUrl":'), quoted.substr(F.lit(2), F.length(quoted) - 2),
                    F.lit(',"resource":'), resource, F.lit("}"))


def document_fragments(entries: DataFrame) -> DataFrame:
    """The text of every encounter's document, in fragments: encounter_id, value."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    rows = entries.select(
        "encounter_id", F.lit("entry").alias("section"),
        F.array_position(kinds, F.col("resource_type")).alias("kind"), "entry_id",
        _entry(F.col("resource")).alias("item"))
    return fragments(rows, "encounter_id", ("entry",), _head(), ["kind", "entry_id"])


def value_fragments(values: DataFrame) -> DataFrame:
    """The same from `entry_values`: the values are shuffled, and the hashes and texts, which hardly
    shrink when compressed, are made where the documents lie."""
    rows = values.withColumn("section", F.lit("entry"))
    return fragments(rows, "encounter_id", ("entry",), _head(), ["kind", "entry_id"],
                     _entry(entry_resource()), {"entry_id": entry_reference()})


def write_encounter_documents(entries: DataFrame, path: str) -> None:
    """One JSON document per encounter and line, its entries in the order of KINDS. ``entries`` are
    `encounter_bundles` or, which takes far less disk, `entry_values`."""
    narrow = "resource" not in entries.columns
    write_documents(value_fragments(entries) if narrow else document_fragments(entries), path)


def export_gate(encounters: DataFrame, consents: DataFrame, decisions: DataFrame) -> DataFrame:
    """refused (nobody confirmed), not_shared (no share scope) or ready, per encounter.

    ``consents`` is `consent_state` with consent_ref; ``decisions`` holds encounter_id, decision.
    """
    confirmed = decisions.filter("decision = 'confirmed_summary'").select(
        "encounter_id", F.lit(True).alias("_confirmed")).distinct()
    share = consents.select(
        "consent_ref", (F.col("active") & F.array_contains("granted", SHARE_SCOPE)).alias("_share"))
    rows = encounters.join(confirmed, "encounter_id", "left")
    # Encounters without a consent share nothing and stay out of the join, so they are no hot key.
    given = rows.filter("consent_ref IS NOT NULL").join(share, "consent_ref", "left")
    rows = given.unionByName(rows.filter("consent_ref IS NULL").withColumn(
        "_share", F.lit(False)))
    named = F.coalesce(F.col("confirmed_by") != "", F.lit(False))
    status = (
        F.when(F.col("_confirmed").isNull() | ~named, "refused")
        .when(~F.coalesce("_share", F.lit(False)), "not_shared").otherwise("ready")
    )
    return rows.select("encounter_id", status.alias("status"))
