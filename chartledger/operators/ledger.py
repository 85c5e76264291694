"""The fact ledger: admit, tell duplicates, supersede, and read the standing state."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartledger.config.rules import QUESTIONS, exclusive_values, option_values, question_paths
from chartledger.config.vocabulary import (
    ENTRY_GROUPS,
    REQUIRED_SCOPES,
    CONSENT_SCOPES,
)
from chartledger.functions.evidence import (
    span_digest,
    span_haystack,
    span_text,
    value_evidence,
)
from chartledger.functions.once import computed_once
from chartledger.functions.ordered import with_next_marked
from chartledger.functions.values import value_items

#: Fields of a source span and their types; one wide STRUCT covers both kinds of span.
SPAN_FIELDS = {
    "kind": "string", "verbatim": "string", "verbatim_translated": "string",
    "language": "string", "turn_id": "string", "question_id": "string", "char_start": "int",
    "char_end": "int", "modality": "string", "selected_values": "array<string>",
    "asr_confidence": "double", "document_id": "string", "page": "int",
    "bbox": "struct<x:double,y:double,width:double,height:double>", "ocr_confidence": "double",
    "handwritten": "boolean", "human_reading": "string", "read_by": "string",
}
SEQ_CHUNK = 1_000_000


def make_span(**columns: Column) -> Column:
    """A span STRUCT from the given fields; the rest are null."""
    unknown = set(columns) - set(SPAN_FIELDS)
    if unknown:
        raise ValueError(f"not span fields: {sorted(unknown)}")
    return F.struct(
        *[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in SPAN_FIELDS.items()]
    )


def span_problem(span: Column) -> Column:
    """The first broken rule of a span itself, or null."""
    box = span["bbox"]
    edges = [box["x"], box["y"], box["width"], box["height"]]
    outside = reduce(lambda a, b: a | b, [(e < 0) | (e > 1) for e in edges])
    picked = span["selected_values"]
    return (
        F.when(picked.isNotNull() & (F.coalesce(span["modality"], F.lit("")) != "touch"),
               "selection_without_touch")
        .when(picked.isNotNull() & (F.size(picked) == 0), "empty_selection")
        .when(span["char_end"] < span["char_start"], "offsets_out_of_order")
        .when(outside, "box_outside_page")
        .when(span["human_reading"].isNotNull() & span["read_by"].isNull(), "reading_unsigned")
    )


def known_path(path: Column, paths: list[str] | None = None) -> Column:
    """True for a question's path, or for an entry ``group[i].field`` with any index."""
    entry_path = r"^([a-z_]+)\[\d+\]\.([a-z_]+)$"
    group, field = F.regexp_extract(path, entry_path, 1), F.regexp_extract(path, entry_path, 2)
    pairs = [f"{g}.{f}" for g, fields in ENTRY_GROUPS.items() for f in fields]
    entry = F.concat(group, F.lit("."), field).isin(*pairs)
    return path.isin(*(paths or question_paths())) | F.coalesce(entry, F.lit(False))


def _texts(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def options_by_path(questions=QUESTIONS) -> Column:
    """MAP from question path to its option values."""
    entries = [f"'{q[2]}', {_texts(option_values(q))}" for q in questions if q[4]]
    return F.expr(f"map({', '.join(entries)})")


def rejection_reason(candidate_granted: Column, questions=QUESTIONS, paths=None) -> Column:
    """Why a candidate may not be recorded: the first gate it fails, null if it passes all.

    Reads the columns span, value, tier, path, required_scope, coded, _hay, _said. ``coded`` marks values
    that must belong to the option set of their path instead of appearing in the text.
    """
    span, value, tier, path = F.col("span"), F.col("value"), F.col("tier"), F.col("path")
    kind = span["kind"]
    allowed = F.try_element_at(options_by_path(questions), path)
    in_vocabulary = F.size(F.array_except(value_items(value), allowed)) == 0
    scope = F.col("required_scope")
    false = F.lit(False)
    return (
        F.when(span.isNull() | kind.isNull(), "no_source")
        .when(~kind.isin("utterance", "document"), "bad_source_kind")
        .when(F.trim(F.coalesce(span["verbatim"], F.lit(""))) == "", "blank_verbatim")
        .when(value.isNull(), "null_value")
        .when((tier == "document") & (kind != "document"), "document_span_needed")
        .when(tier.isin("stated", "confirmed") & (kind != "utterance"), "utterance_needed")
        .when((tier == "confirmed") & (F.coalesce(span["question_id"], F.lit("")) == ""),
              "question_needed")
        .when(~known_path(path, paths), "unknown_path")
        .when(scope.isNotNull()
              & ~F.coalesce(F.array_contains(candidate_granted, scope), false),
              "scope_not_granted")
        .when(F.col("coded") & ~F.coalesce(in_vocabulary, false), "not_in_vocabulary")
        .when(~F.col("coded") & ~value_evidence(
            value, span, F.col("_hay"), F.col("_said")), "value_not_evidenced")
    )


def judge_facts(candidates: DataFrame, scopes: DataFrame, questions=QUESTIONS) -> DataFrame:
    """Every candidate with its `reason`, null when it may be recorded.

    ``scopes`` holds session_id and the array `granted`.
    """
    held = candidates.join(scopes.select("session_id", "granted"), "session_id", "left")
    if "coded" not in candidates.columns:
        held = held.withColumn("coded", F.lit(False))
    span = F.col("span")
    held = computed_once(held, _hay=span_haystack(span), _said=span_text(span))
    judged = computed_once(held, reason=rejection_reason(F.col("granted"), questions))
    return judged.drop("granted", "_hay", "_said")


def admit_facts(
    candidates: DataFrame, scopes: DataFrame, questions=QUESTIONS
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). Each is a filter over the same plan; read one, or write the judged
    table once and filter that."""
    judged = judge_facts(candidates, scopes, questions)
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def dedupe_spans(facts: DataFrame) -> DataFrame:
    """One fact per (session, path, span digest), the earliest; adds `digest`.

    The first-row window is trimmed before the shuffle, so many copies of one span stay small.
    """
    keyed = facts.withColumn("digest", span_digest(F.col("span")))
    first = W.partitionBy("session_id", "path", "digest").orderBy("seq")
    return keyed.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def supersede(facts: DataFrame, seq_chunk: int = SEQ_CHUNK) -> DataFrame:
    """Add `superseded_by`: the first later superseding fact at the same session and path.

    Run after `dedupe_spans`: a repeated span is dropped before it can supersede anything.
    """
    return with_next_marked(
        facts, ["session_id", "path"], ["seq"], F.expr(f"seq div {seq_chunk}"),
        F.col("supersede"), "fact_id", "superseded_by",
    )


def active_facts(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("superseded_by").isNull())


def field_status(
    sessions: DataFrame, facts: DataFrame, absences: DataFrame, questions=QUESTIONS
) -> DataFrame:
    """recorded, declined or not_asked for every (session, question).

    Both inputs are first reduced to at most one entry per question and session, so a session
    row carries a bounded set; questions are then unfolded from a constant.
    """
    paths = [q[2] for q in questions]
    recorded = (
        active_facts(facts).filter(F.col("path").isin(*paths))
        .groupBy("session_id").agg(F.collect_set("path").alias("_recorded"))
    )
    last = (
        absences.filter(F.col("path").isin(*paths))
        .groupBy("session_id", "path").agg(F.max_by("reason", "seq").alias("reason"))
        .filter("reason = 'declined'")
        .groupBy("session_id").agg(F.collect_set("path").alias("_declined"))
    )
    asked = F.expr("array(" + ", ".join(
        f"named_struct('question_id', '{q[0]}', 'section', '{q[1]}', 'path', '{q[2]}')"
        for q in questions) + ")")
    rows = (
        sessions.select("session_id").join(recorded, "session_id", "left")
        .join(last, "session_id", "left")
        .select("session_id", "_recorded", "_declined", F.explode(asked).alias("_q"))
    )
    path = F.col("_q.path")
    status = (
        F.when(F.array_contains("_recorded", path), "recorded")
        .when(F.array_contains("_declined", path), "declined")
        .otherwise("not_asked")
    )
    return rows.select("session_id", "_q.question_id", "_q.section", "_q.path",
                       status.alias("status"))


def _ratio(recorded: Column, askable: Column) -> Column:
    return F.when(askable > 0, F.round(recorded / askable, 4)).otherwise(F.lit(0.0))


def section_completeness(status: DataFrame) -> DataFrame:
    """Per session and section: recorded over what was open; a wholly closed section counts all
    of its questions."""
    counts = status.groupBy("session_id", "section").agg(
        F.count_if(F.col("status") == "recorded").alias("recorded"),
        F.count_if(F.col("status") != "not_asked").alias("open"),
        F.count(F.lit(1)).alias("size"),
    )
    askable = F.when(F.col("open") > 0, F.col("open")).otherwise(F.col("size"))
    return counts.select("session_id", "section", "recorded", askable.alias("askable"),
                         _ratio(F.col("recorded"), askable).alias("completeness"))


def overall_completeness(status: DataFrame) -> DataFrame:
    counts = status.groupBy("session_id").agg(
        F.count_if(F.col("status") == "recorded").alias("recorded"),
        F.count_if(F.col("status") != "not_asked").alias("askable"),
    )
    return counts.withColumn("completeness", _ratio(F.col("recorded"), F.col("askable")))


def slot_view(facts: DataFrame) -> DataFrame:
    """The standing answer of each (session, path): latest active fact by time, and how many
    active and superseded facts there are. `slot_history` lists those row by row."""
    active = F.col("superseded_by").isNull()
    when = F.struct("ts", "seq")
    top = F.max_by(
        F.when(active, F.struct("fact_id", "value", "tier", "verbatim")), F.when(active, when)
    )
    return (
        facts.groupBy("session_id", "path")
        .agg(top.alias("_top"), F.count_if(active).alias("active_count"),
             F.count_if(~active).alias("superseded_count"))
        .filter("active_count > 0")
        .select("session_id", "path", "_top.*", "active_count", "superseded_count")
    )


def slot_history(facts: DataFrame) -> DataFrame:
    """Superseded answers, one row each; sort by ts and seq to read them in order."""
    return facts.filter(F.col("superseded_by").isNotNull()).select(
        "session_id", "path", "fact_id", "value", "verbatim", "ts", "seq"
    )


def latest_values(
    facts: DataFrame, keys: list[str], paths: list[str], order: list[str], prefix: str = "v"
) -> tuple[DataFrame, dict[str, str]]:
    """One row per key with the last active value of each path, and the column of each path.

    One shuffle with map-side reduction; the row is as wide as the fixed list of paths.
    """
    names = {p: f"{prefix}{i}" for i, p in enumerate(paths)}
    rank = F.struct(*order)
    cols = [
        F.max_by(F.when(F.col("path") == p, F.col("value")), F.when(F.col("path") == p, rank))
        .alias(n)
        for p, n in names.items()
    ]
    return facts.groupBy(*keys).agg(*cols), names


def consent_state(consents: DataFrame, as_of: Column) -> DataFrame:
    """Granted, refused, unknown and missing scopes, and whether the consent is active.

    Reads granted (array), revoked_on, expires_on.
    """
    known = F.array(*[F.lit(s) for s in CONSENT_SCOPES])
    needed = F.array(*[F.lit(s) for s in REQUIRED_SCOPES])
    active = F.col("revoked_on").isNull() & (
        F.col("expires_on").isNull() | (as_of < F.col("expires_on"))
    )
    return (
        consents.withColumn("unknown_scopes", F.array_except("granted", known))
        .withColumn("missing_scopes", F.array_except(needed, "granted"))
        .withColumn("refused", F.array_except(known, "granted"))
        .withColumn("granted", F.array_intersect("granted", known))
        .withColumn("active", active)
    )


def allows(scope: str) -> Column:
    """Over `consent_state`: is this scope usable now?"""
    return F.col("active") & F.array_contains("granted", scope)


def revoke_scopes(
    facts: DataFrame, revocations: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(survivors, purged, ended sessions) after scopes were withdrawn.

    ``revocations`` holds session_id, revoked (array) and granted (array). Survivors are
    deduplicated by their spans, where ``facts`` has them, and get their supersession computed
    afresh: a fact that came first with a span, or superseded another, may be gone.
    """
    asked = revocations.select("session_id", "revoked", "granted")
    held = facts.join(asked, "session_id", "left")

    def taken(scope):
        return F.coalesce(F.array_contains("revoked", scope), F.lit(False))

    hit = (
        (taken("documents") & (F.col("tier") == "document"))
        | (taken("voice") & (F.coalesce(F.col("modality"), F.lit("")) == "speech"))
        | (taken("ayush") & F.col("path").startswith("ayush."))
    )
    drop = [c for c in ("revoked", "granted", "superseded_by") if c in held.columns]
    kept = held.filter(~hit).drop(*drop)
    if "span" in kept.columns:
        kept = dedupe_spans(kept).drop("digest")
    survivors = supersede(kept)
    left = F.array_except("granted", "revoked")
    needed = F.array(*[F.lit(s) for s in REQUIRED_SCOPES])
    ended = asked.filter(~F.arrays_overlap(left, needed)).select("session_id")
    return survivors, held.filter(hit).drop("revoked", "granted"), ended


def apply_edits(
    facts: DataFrame, edits: DataFrame, scopes: DataFrame, questions=QUESTIONS
) -> tuple[DataFrame, DataFrame]:
    """Physician corrections become new confirmed facts that supersede the earlier answers.

    ``edits`` holds session_id, seq, ts, path, value, value_as_text, actor, reason. An edit is a
    candidate like any other: it passes the gates of `judge_facts`, where a path with options
    takes only these, then `dedupe_spans`, then `supersede` together with the earlier facts.
    Returns (facts with the accepted edits, rejected edits with their reason).
    """
    words = F.concat(
        F.col("value_as_text"), F.lit(" — corrected by "), F.col("actor"), F.lit(": "),
        F.coalesce("reason", F.lit("physician correction")),
    )
    with_options = [q[2] for q in questions if q[4]]
    key = F.concat_ws("|", "session_id", F.col("seq").cast("string"), "path")
    made = edits.filter(F.col("value").isNotNull() & (F.col("path") != "")).select(
        "session_id", "seq", "ts", "path", "value",
        F.concat(F.lit("e"), F.substring(F.sha2(key, 256), 1, 16)).alias("fact_id"),
        F.lit("confirmed").alias("tier"), F.lit(True).alias("supersede"),
        F.lit(None).cast("string").alias("required_scope"),
        F.col("path").isin(*with_options).alias("coded"),
        make_span(
            kind=F.lit("utterance"), verbatim=words, modality=F.lit("typed"),
            question_id=F.col("path"),
            turn_id=F.concat(F.lit("edit_"), F.col("seq").cast("string"))).alias("span"),
    )
    judged = judge_facts(made, scopes, questions)
    rejected = judged.filter("reason IS NOT NULL").select(
        "session_id", "seq", "path", "fact_id", "reason")
    accepted = dedupe_spans(judged.filter("reason IS NULL").drop("reason", "coded")).select(
        "*", F.col("span.verbatim").alias("verbatim"), F.col("span.modality").alias("modality"),
    ).drop("span", "digest", "required_scope")
    base = facts.drop("superseded_by")
    return supersede(base.unionByName(accepted, allowMissingColumns=True)), rejected


def validate_taps(answers: DataFrame, questions=QUESTIONS) -> DataFrame:
    """Check answers pressed on screen; adds `reason` (null when valid) and `recorded`.

    Reads question_id and the array `picked`. An exclusive option wins alone; a scale takes one
    whole number inside its bounds; a choice takes only its own options and never none at all.
    """
    from chartledger.config.rules import SCALE_MAX, SCALE_MIN

    def of_question(fn):
        entries = ", ".join(f"'{q[0]}', {fn(q)}" for q in questions)
        return F.expr(f"try_element_at(map({entries}), question_id)")

    kind = of_question(lambda q: f"'{q[3]}'")
    options = of_question(lambda q: f"CAST({_texts(option_values(q))} AS ARRAY<STRING>)")
    alone = of_question(lambda q: f"CAST({_texts(exclusive_values(q))} AS ARRAY<STRING>)")
    choice = F.size(options) > 0
    number = F.try_element_at("picked", F.lit(1)).try_cast("int")
    reason = (
        F.when(kind.isNull(), "unknown_question")
        .when(F.size("picked") == 0, "empty")
        .when(choice & (F.size(F.array_except("picked", options)) > 0), "unknown_option")
        .when((kind == "scale") & ~F.coalesce(number.between(SCALE_MIN, SCALE_MAX), F.lit(False)),
              "outside_scale")
    )
    exclusive = F.slice(F.filter("picked", lambda v: F.array_contains(alone, v)), 1, 1)
    taken = (
        F.when(choice & (F.size(exclusive) > 0), exclusive)
        .when(kind == "multi_choice", F.col("picked"))
        .otherwise(F.slice("picked", 1, 1))
    )
    return answers.withColumn("reason", reason).withColumn(
        "recorded", F.when(reason.isNull(), taken)
    ).withColumn("verbatim", F.when(reason.isNull(), tap_wording(kind, taken)))


def tap_wording(kind: Column, taken: Column) -> Column:
    """What the screen showed for the pressed answer."""
    from chartledger.config.rules import SCALE_ANCHORS, SCALE_MAX

    first = F.try_element_at(taken, F.lit(1))
    labels = F.transform(
        taken,
        lambda v: F.concat(F.upper(F.substring(v, 1, 1)),
                           F.regexp_replace(F.substr(v, F.lit(2)), "_", " ")),
    )
    n, anchors = first.try_cast("int"), len(SCALE_ANCHORS)
    at = F.least(F.floor(n * anchors / (SCALE_MAX + 1)), F.lit(anchors - 1)).cast("int")
    scale = F.concat(
        F.try_element_at(F.array(*[F.lit(a) for a in SCALE_ANCHORS]), at + 1),
        F.lit(" ("), n.cast("string"), F.lit(f" of {SCALE_MAX})"),
    )
    return (
        F.when(kind == "scale", scale)
        .when(kind == "boolean", F.when(F.lower(first).isin("true", "yes"), "Yes").otherwise("No"))
        .otherwise(F.array_join(labels, ", "))
    )
