"""Repeating groups, and the step from a confirmed capture session to the durable record."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartledger.config.rules import CONDITION_TERMS
from chartledger.config.vocabulary import ENTRY_GROUPS
from chartledger.functions.ordered import with_previous
from chartledger.functions.text import fold
from chartledger.functions.values import make_value, value_items, value_text
from chartledger.operators.extraction import assess_range, match_analytes
from chartledger.operators.ledger import SEQ_CHUNK, active_facts

# Group and first field of each kind of entity.
ENTITY_GROUPS = {
    "medication": ("medications", "name"),
    "diagnosis": ("problems", "reported_term"),
    "investigation": ("investigations", "analyte"),
    "procedure": ("procedures", "name"),
}


def entity_facts(entities: DataFrame, seq_chunk: int = SEQ_CHUNK) -> DataFrame:
    """Extracted entities as document-tier candidate facts at ``group[i].field``.

    Entries are numbered per document and group in reading order (`seq`). Reads doc_id, seq, kind,
    label, dose, frequency_raw, route, value, observed_on and source_text. Entities of other kinds
    have no group and give no fact.
    """
    group = F.create_map(*[F.lit(x) for k, (g, _f) in ENTITY_GROUPS.items() for x in (k, g)])
    rows = entities.withColumn("_group", F.try_element_at(group, F.col("kind"))).filter(
        "doc_id IS NOT NULL AND _group IS NOT NULL")
    rows = with_previous(rows, ["doc_id", "_group"], ["seq"], F.expr(f"seq div {seq_chunk}"),
                         ["seq"], "_p", position="_i").drop("_p")
    kind = F.col("kind")
    year = F.year("observed_on").cast("string")
    fields = {
        "name": F.when(kind.isin("medication", "procedure"), F.col("label")),
        "dose": F.col("dose"), "frequency": F.col("frequency_raw"), "route": F.col("route"),
        "reported_term": F.when(kind == "diagnosis", F.col("label")),
        "reported_year": F.when(kind == "diagnosis", year),
        "analyte": F.when(kind == "investigation", F.col("label")),
        "value": F.when(kind == "investigation", F.col("value").cast("string")),
    }
    parts = F.array_compact(F.array(*[
        F.when(v.isNotNull(), F.struct(F.lit(f).alias("field"), v.alias("text")))
        for f, v in fields.items()
    ]))
    return rows.select("*", F.explode(parts).alias("_f")).select(
        "doc_id", "seq",
        F.concat(F.col("_group"), F.lit("["), F.col("_i").cast("string"), F.lit("]."),
                 F.col("_f.field")).alias("path"),
        F.concat_ws("-", F.lit("d"), F.col("doc_id").cast("string"), F.col("seq").cast("string"),
                    F.col("_f.field")).alias("fact_id"),
        make_value(F.lit("text"), F.col("_f.text")).alias("value"),
        F.lit("document").alias("tier"), F.col("source_text").alias("verbatim"),
        F.lit(False).alias("supersede"),
    )


def repeating_groups(
    facts: DataFrame, group: str, keys: list[str], order: list[str]
) -> DataFrame:
    """One row per entry of ``group[i].field`` with the latest active value of each field.

    Also the fact behind the entry's first field and the document it came from, if any. One
    aggregation over a fixed list of fields; entries without a number are left out. `entry` is a
    whole number of up to 38 digits, or of any length as `entry_text`, without leading zeros.
    """
    fields = ENTRY_GROUPS[group]
    parts = rf"^{group}\[(\d+)\]\.([a-z_]+)$"
    rows = facts.filter(F.col("path").startswith(f"{group}[")).withColumns({
        "entry_text": F.regexp_replace(F.regexp_extract("path", parts, 1), r"^0+(?=\d)", ""),
        "_field": F.regexp_extract("path", parts, 2),
    }).filter("entry_text <> ''")
    rank = F.struct(*order)
    pick = lambda f, col: F.max_by(F.when(F.col("_field") == f, col),
                                   F.when(F.col("_field") == f, rank))
    document = F.col("document_id") if "document_id" in facts.columns else F.lit(None).cast("string")
    return rows.groupBy(*keys, "entry_text").agg(
        F.first(F.col("entry_text").try_cast("decimal(38,0)")).alias("entry"),
        *[pick(f, value_text(F.col("value"))).alias(f) for f in fields],
        pick(fields[0], F.col("fact_id")).alias("source_fact"),
        pick(fields[0], document).alias("source_document"),
    )


def problems_from_choices(
    facts: DataFrame, existing: DataFrame, terms: dict[str, str] = CONDITION_TERMS,
    path: str = "past_medical.conditions", seq_chunk: int = SEQ_CHUNK,
) -> DataFrame:
    """Chosen conditions that carry a term, numbered after a session's recorded problems.

    ``existing`` holds session_id and problem_count.
    """
    table = F.create_map(*[F.lit(x) for kv in terms.items() for x in kv])
    chosen = active_facts(facts).filter(F.col("path") == path).select(
        "session_id", "seq", "fact_id", "tier",
        F.posexplode(value_items(F.col("value"))).alias("_k", "choice"),
    ).withColumn("term", F.try_element_at(table, F.col("choice"))).filter("term IS NOT NULL")
    placed = with_previous(chosen, ["session_id"], ["seq", "_k"], F.expr(f"seq div {seq_chunk}"),
                           ["seq"], "_p", position="_i")
    rows = placed.join(existing.select("session_id", "problem_count"), "session_id", "left")
    return rows.select(
        "session_id", "fact_id", "tier", "choice", "term",
        (F.col("_i") + F.coalesce("problem_count", F.lit(0))).alias("entry"))


def resolve_patients(patients: DataFrame, incoming: DataFrame, as_of: str) -> DataFrame:
    """Match visits to people by reference: fill what is missing, never overwrite.

    ``incoming`` holds incoming_id, abha_ref, display_name, gender, age_years and
    preferred_language. A visit without a reference always makes a new person. A new person has
    the year of birth (from the age at ``as_of``, a date as text) and the language of the first
    visit; known people keep theirs. New ids come from a hash, so a rerun gives the same ids.
    """
    age = F.when(F.col("age_years") > 0, F.year(F.lit(as_of).cast("date")) - F.col("age_years"))
    visits = incoming.withColumns({
        "year_of_birth": age.cast("int"),
        "preferred_language": F.coalesce("preferred_language", F.lit("en"))})
    linked = visits.filter("abha_ref <> ''")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("incoming_id"))).alias(f"_{c}")
    start = F.min_by(F.struct("year_of_birth", "preferred_language"), "incoming_id").alias("_new")
    wanted = linked.groupBy("abha_ref").agg(first("display_name"), first("gender"), start)
    person = ["abha_ref", "display_name", "gender", "year_of_birth", "preferred_language"]
    known = patients.filter("abha_ref <> ''").select(
        F.col("patient_id").cast("string").alias("_id"), *person)
    new = F.col("_id").isNull()
    merged = known.join(wanted, "abha_ref", "full").select(
        F.coalesce("_id", F.substring(F.sha2(F.concat(F.lit("ref|"), "abha_ref"), 256), 1, 16))
        .alias("patient_key"), "abha_ref",
        F.coalesce("display_name", "_display_name").alias("display_name"),
        F.coalesce("gender", "_gender").alias("gender"),
        *[F.when(new, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in person[3:]],
        new.alias("created"))
    unlinked_old = patients.filter("abha_ref IS NULL OR abha_ref = ''").select(
        F.col("patient_id").cast("string").alias("patient_key"), *person,
        F.lit(False).alias("created"))
    unlinked_new = visits.filter("abha_ref IS NULL OR abha_ref = ''").select(
        F.substring(F.sha2(F.concat(F.lit("visit|"), F.col("incoming_id").cast("string")), 256),
                    1, 16).alias("patient_key"), *person, F.lit(True).alias("created"))
    return merged.unionByName(unlinked_old).unionByName(unlinked_new)


def confirmed_sessions(traced: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Sessions that may be promoted: traceable and confirmed by somebody."""
    return traced.filter("ok").select("session_id").join(
        confirmations.filter("confirmed_by <> ''").select("session_id", "confirmed_by"),
        "session_id")


# What is kept of a source span beside its kind, and under which names.
EVIDENCE_FIELDS = {
    "verbatim": "verbatim", "language": "language", "modality": "modality",
    "question_id": "question_id", "turn_id": "turn_id", "asr_confidence": "asr_confidence",
    "document_id": "document_ref", "page": "page", "bbox": "bbox",
    "ocr_confidence": "ocr_confidence", "human_reading": "human_reading", "read_by": "read_by",
}


def promote_facts(facts: DataFrame, gate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(durable facts, evidence) of the sessions that pass the gate. ``facts`` holds the source
    span as `span`, and `confidence`."""
    rows = facts.join(gate.select("session_id"), "session_id", "left_semi")
    span = F.col("span")
    unmeasured = (span["modality"] == "speech") & span["asr_confidence"].isNull()
    durable = rows.select(
        "session_id", "fact_id", "path", "value",
        value_text(F.col("value")).alias("display_value"), "tier",
        F.col("tier").alias("state"), "confidence",
        F.when(unmeasured, "unavailable").otherwise("measured").alias("confidence_status"),
        F.col("ts").alias("recorded_at"), F.col("ts").alias("valid_from"), "superseded_by")
    evidence = rows.select(
        "fact_id", span["kind"].alias("source_type"),
        *[span[f].alias(name) for f, name in EVIDENCE_FIELDS.items()],
        F.coalesce(span["handwritten"], F.lit(False)).alias("handwritten"))
    return durable, evidence


def promote_entities(
    documents: DataFrame, entities: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(promoted entities, warnings, timeline rows of the uploads).

    Items still waiting for a reader are left out of the record and named in a warning.
    ``documents`` holds doc_id, filename, verified_by, uploaded_on, document_kind.
    """
    rows = entities.join(documents.select("doc_id", "verified_by"), "doc_id")
    waiting = F.col("pending") & F.col("verified_by").isNull()
    kept = rows.filter(~waiting).withColumn(
        "verification", F.when(F.col("pending"), "corrected").otherwise("accepted"))
    warned = rows.filter(waiting).select(
        "doc_id", "item_id",
        F.concat("label", F.lit(" was left unverified and was not promoted.")).alias("warning"))
    uploads = documents.select(
        "doc_id", F.col("uploaded_on").alias("occurred_on"), F.lit("exact").alias("date_precision"),
        F.lit("document").alias("kind"),
        F.concat(F.lit("Uploaded: "), "filename").alias("label"),
        F.col("document_kind").alias("detail"))
    return kept, warned, uploads


def promotion_timeline(encounters: DataFrame, documents: DataFrame, entities: DataFrame
                       ) -> DataFrame:
    """Timeline rows of a promotion: the visits, the uploads, and what the documents tell.

    ``encounters`` holds encounter_id, occurred_on, headline and confirmed_by; ``documents`` as in
    `promote_entities`; ``entities`` are its promoted entities with observed_on and date_precision.
    """
    none = F.lit(None).cast("string")
    headline = F.when(F.col("headline") != "", F.col("headline"))
    visits = encounters.select(
        F.col("encounter_id").cast("string").alias("source"), "occurred_on",
        F.lit("exact").alias("date_precision"), F.lit("encounter").alias("kind"),
        F.coalesce(headline, F.lit("Clinical encounter")).alias("label"),
        F.concat(F.lit("Confirmed by "), "confirmed_by").alias("detail"),
        F.lit(False).alias("low_confidence"))
    uploads = documents.select(
        F.col("doc_id").cast("string").alias("source"), F.col("uploaded_on").alias("occurred_on"),
        F.lit("exact").alias("date_precision"), F.lit("document").alias("kind"),
        F.concat(F.lit("Uploaded: "), "filename").alias("label"),
        F.col("document_kind").alias("detail"), F.lit(False).alias("low_confidence"))
    told = entities.select(
        F.col("doc_id").cast("string").alias("source"), F.col("observed_on").alias("occurred_on"),
        F.coalesce("date_precision", F.lit("unknown")).alias("date_precision"), "kind", "label",
        none.alias("detail"), F.col("pending").alias("low_confidence"))
    return visits.unionByName(uploads).unionByName(told)


def _with_document_date(rows: DataFrame, doc_dates: DataFrame) -> DataFrame:
    """Add `document_date` by the source document. Rows without a source are spread over keys of
    their own, so that all that patients report does not meet in one task."""
    own = F.concat(F.lit("none|"), F.xxhash64(*rows.columns).cast("string"))
    dates = doc_dates.select(F.col("document_id").alias("_source"), "document_date")
    return rows.withColumn("_key", F.coalesce("source_document", own)).join(
        dates, F.col("_key") == F.col("_source"), "left").drop("_key", "_source")


def promote_medications(groups: DataFrame, doc_dates: DataFrame) -> DataFrame:
    """Medicine entries as events: documented on paper, or reported by the patient.

    The date is the document's own or none; a visit's date is never put in its place.
    """
    rows = _with_document_date(groups.filter("name IS NOT NULL"), doc_dates).withColumnRenamed(
        "document_date", "observed_on")
    documented = F.col("source_document").isNotNull()
    return rows.withColumns({
        "normalized_name": fold(F.col("name")),
        "status": F.when(documented, "documented").otherwise("patient-reported-current"),
    })


def promote_observations(groups: DataFrame, doc_dates: DataFrame, sex: str = "''") -> DataFrame:
    """Laboratory entries as events: key, unit, range, flag and date.

    What the entry itself carries wins: ``groups`` may hold unit, reference_low, reference_high,
    range_flag ("unknown" is none) and observed_on (a date or its text). Otherwise unit, range
    and flag come from the reference table and the date from the document.
    """
    own = {"unit": "string", "reference_low": "double", "reference_high": "double",
           "range_flag": "string", "observed_on": "string"}
    rows = groups.filter("analyte IS NOT NULL")
    rows = rows.withColumns({
        f"_own_{c}": (F.col(c) if c in groups.columns else F.lit(None)).try_cast(kind)
        for c, kind in own.items()}).drop(*own)
    rows = _with_document_date(rows, doc_dates)
    rows = rows.withColumnsRenamed({"value": "value_text"}).withColumns({
        "value": F.col("value_text").try_cast("double"), "_printed": F.lit("")})
    rows = assess_range(match_analytes(rows, "analyte"), "value", "_printed", sex)
    told = F.when(F.col("_own_range_flag") != "unknown", F.col("_own_range_flag"))
    return rows.withColumns({
        "unit": F.coalesce(F.when(F.col("_own_unit") != "", F.col("_own_unit")), "analyte_unit"),
        "reference_low": F.coalesce("_own_reference_low", "reference_low"),
        "reference_high": F.coalesce("_own_reference_high", "reference_high"),
        "range_flag": F.coalesce(told, "range_flag"),
        "range_source": F.when(F.col("_own_reference_low").isNotNull(), "report").otherwise(
            F.col("range_source")),
        "observed_on": F.coalesce(F.to_date(F.col("_own_observed_on").try_cast("date")),
                                  "document_date"),
    }).drop(*[f"_own_{c}" for c in own], "_printed", "document_date")


def promotion_counts(keys: list[str], tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each promoted kind per key, from one pass per table."""
    kinds = list(tables)
    tall = reduce(DataFrame.unionByName, [
        t.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_kind", F.lit(k))
        for k, t in tables.items()
    ])
    return tall.groupBy(*keys).agg(*[
        F.coalesce(F.sum(F.when(F.col("_kind") == k, F.col("_n"))), F.lit(0)).alias(k)
        for k in kinds
    ])
