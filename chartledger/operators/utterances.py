"""Spoken or typed answers to slot values: phrase matching, slot extraction, verification."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartledger.config.rules import QUESTIONS, label_of, option_values
from chartledger.config.vocabulary import (
    ABSENCE_OPTIONS,
    CLAUSE_BOUNDARIES,
    MAX_OPTION_SCORE,
    NEGATION_WINDOW,
    NEGATORS,
    NO_CUES,
    YES_CUES,
)
from chartledger.functions.once import computed_once
from chartledger.functions.text import find, slice_ignoring_case
from chartledger.functions.values import make_value
from chartledger.operators.ledger import known_path, options_by_path


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _phrases(option: str, extra: list[str]) -> list[str]:
    """Phrases of an option in trial order: its own list, its label, the label's long words."""
    label = label_of(option)
    words = [w for w in label.lower().split() if len(w) > 4]
    return [p.lower() for p in [*extra, label, *words]]


def phrase_rows(question, lexicon: dict) -> list[tuple]:
    """(option, position, negatable, phrase, score, bucket, rank) for one question.

    The score grows with the number of words; the rank puts an option's strongest phrase first,
    earlier phrases first among equals.
    """
    rows = []
    for position, option in enumerate(option_values(question)):
        scored = []
        for phrase in _phrases(option, lexicon.get(question[0], {}).get(option, [])):
            score = min(0.55 + 0.03 * len(phrase.split()), MAX_OPTION_SCORE)
            scored.append((phrase, score, round(score / 0.1)))
        ranked = sorted(scored, key=lambda s: -s[1])
        for rank, (phrase, score, bucket) in enumerate(ranked):
            rows.append((option, position, option not in ABSENCE_OPTIONS, phrase, score, bucket,
                         rank))
    return rows


def _options_expr(questions, lexicon) -> str:
    """The phrase table as a constant per question."""
    arms = []
    for q in questions:
        options = {}
        for option, position, negatable, phrase, score, bucket, _rank in phrase_rows(q, lexicon):
            options.setdefault((option, position, negatable), []).append(
                f"named_struct('p', {_literal(phrase)}, 'score', {score!r}D, 'bucket', {bucket})")
        if options:
            entries = ", ".join(
                f"named_struct('value', '{o}', 'position', {i}, 'negatable', "
                f"{str(n).lower()}, 'phrases', array({', '.join(ps)}))"
                for (o, i, n), ps in options.items())
            arms.append(f"WHEN '{q[0]}' THEN array({entries})")
    return f"CASE question_id {' '.join(arms)} END"


def is_negated(lowered: Column, at: Column) -> Column:
    """A negator among the last four words before a position, within its clause."""
    window = F.substring(lowered, F.greatest(at - NEGATION_WINDOW, F.lit(0)) + 1,
                         F.least(at, F.lit(NEGATION_WINDOW)))
    for boundary in CLAUSE_BOUNDARIES:
        window = F.regexp_replace(window, f"(?s)^.*{boundary}", "")
    words = F.regexp_extract_all(window, F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))
    last = F.slice(F.reverse(words), 1, 4)
    return F.arrays_overlap(last, F.array(*[F.lit(n) for n in NEGATORS]))


def match_options(utterances: DataFrame, lexicon: dict, questions=QUESTIONS) -> DataFrame:
    """Add `hits`: the options an utterance supports, best first.

    Reads question_id and text. Each hit has value, quote (a true slice of the text), score and
    start. Work stays in the row; utterances are not joined to phrases.
    """
    rows = computed_once(
        utterances, _low=F.lower(F.coalesce("text", F.lit(""))),
        _options=F.expr(_options_expr(questions, lexicon)))
    low = F.col("_low")

    def supported(phrase, negatable):
        at = F.position(phrase["p"], low) - 1
        return (at >= 0) & (~negatable | ~is_negated(low, at))

    def best(option):
        good = F.filter(option["phrases"], lambda ph: supported(ph, option["negatable"]))
        return F.struct(option["value"].alias("value"), option["position"].alias("position"),
                        F.get(good, F.lit(0)).alias("best"))

    found = F.filter(F.transform("_options", best), lambda h: h["best"].isNotNull())

    def shaped(h):
        start = F.position(h["best"]["p"], low) - 1
        return F.struct(
            (-h["best"]["bucket"]).alias("order"), start.alias("start"),
            h["position"].alias("position"), h["value"].alias("value"),
            F.substring(F.col("text"), start + 1, F.length(h["best"]["p"])).alias("quote"),
            h["best"]["score"].alias("score"),
        )

    rows = computed_once(rows, _found=found)
    hits = F.array_sort(F.transform("_found", shaped))
    empty = "array<struct<order:int,start:int,position:int,value:string,quote:string,score:double>>"
    return computed_once(
        rows, hits=F.coalesce(hits, F.array().cast(empty))
    ).drop("_low", "_options", "_found")


_EDGE = r"[\p{L}\p{N}_]"


def _cue(text: Column, cues) -> Column:
    """The longest cue that stands as a whole word; null if none does."""
    ranked = sorted(cues, key=len, reverse=True)
    return F.coalesce(*[
        F.when(text.rlike(rf"(?i)(?<!{_EDGE}){cue}(?!{_EDGE})"), F.lit(cue)) for cue in ranked
    ])


def extract_slots(utterances: DataFrame, lexicon: dict, questions=QUESTIONS) -> DataFrame:
    """One proposed slot per utterance that yields one: path, value, quote and confidence."""
    of = lambda field: F.expr(
        "CASE question_id " + " ".join(f"WHEN '{q[0]}' THEN '{q[field]}'" for q in questions)
        + " END")
    rows = match_options(utterances, lexicon, questions).withColumns(
        {"path": of(2), "kind": of(3)})
    text, kind = F.col("text"), F.col("kind")
    rows = computed_once(
        rows,
        _real=F.filter("hits", lambda h: h["value"] != "none"),
        _no=F.when(kind == "boolean", _cue(text, NO_CUES)),
        _yes=F.when(kind == "boolean", _cue(text, YES_CUES)),
        _digit=F.when(kind == "scale", F.regexp_extract(text, r"\b(10|[0-9])\b", 1)),
        _whole=F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""),
    )
    top, real = F.get("hits", F.lit(0)), F.col("_real")
    choice = kind.isin("single_choice", "duration") | (
        (kind == "open_text") & (F.size("hits") > 0))
    starts = F.transform(real, lambda h: find(text, h["quote"]))
    ends = F.transform(real, lambda h: find(text, h["quote"]) + F.length(h["quote"]))
    first = F.array_min(starts)
    covering = F.substring(text, first + 1, F.array_max(ends) - first)
    cue = F.coalesce("_no", "_yes")
    digit = F.when(F.col("_digit") != "", F.col("_digit"))
    whole = F.when(F.col("_whole") != "", F.col("_whole"))
    many = (kind == "multi_choice") & (F.size(real) > 0)
    value = (
        F.when(choice, top["value"])
        .when(many, F.array_join(F.transform(real, lambda h: h["value"]), "|"))
        .when(kind == "boolean", F.when(F.col("_no").isNotNull(), "false")
              .when(F.col("_yes").isNotNull(), "true"))
        .when(kind == "scale", digit).when(kind == "open_text", whole)
    )
    quote = (
        F.when(choice, top["quote"]).when(many, covering)
        .when(kind == "boolean", slice_ignoring_case(text, cue))
        .when(kind == "scale", digit).when(kind == "open_text", whole)
    )
    confidence = (
        F.when(choice, top["score"])
        .when(many, F.array_min(F.transform(real, lambda h: h["score"])))
        .when(kind == "boolean", 0.8).when(kind == "scale", 0.75).when(kind == "open_text", 0.9)
    )
    shape = F.when(kind == "multi_choice", "list").when(kind == "boolean", "bool").otherwise("text")
    return computed_once(rows, value_text=value, quote=quote).filter(
        F.col("value_text").isNotNull()
    ).select(
        *utterances.columns, "path", "kind", "value_text",
        make_value(shape, F.col("value_text")).alias("value"), "quote",
        confidence.alias("confidence"),
    )


def verify_slots(slots: DataFrame, questions=QUESTIONS) -> DataFrame:
    """Check proposed slots against the utterance, the paths and the options.

    Adds `outcome` (unquoted, unknown_path, bad_value, proposed), `coded` (the value is wholly
    made of the path's options), the exact quote, and the confidence capped by the recogniser's.
    A proposed slot still has to pass `admit_facts`.
    """
    allowed = F.try_element_at(options_by_path(questions), F.col("path"))
    items = F.when(F.col("value")["kind"] == "list", F.col("value")["a"]).otherwise(
        F.array(F.col("value_text")))
    coded = F.coalesce(F.size(F.array_except(items, allowed)) == 0, F.lit(False))
    closed = allowed.isNotNull() & ~F.col("path").isin(
        *[q[2] for q in questions if q[3] == "open_text"])
    rows = computed_once(slots, coded=coded)
    outcome = (
        F.when(find(F.col("text"), F.col("quote")) < 0, "unquoted")
        .when(~known_path(F.col("path"), None), "unknown_path")
        .when(closed & ~F.col("coded"), "bad_value").otherwise("proposed")
    )
    heard = F.when(F.col("asr_confidence") > 0, F.col("asr_confidence"))
    return rows.withColumns({
        "outcome": outcome,
        "quote": slice_ignoring_case(F.col("text"), F.col("quote")),
        "confidence": F.least(F.col("confidence"), F.coalesce(heard, F.lit(1.0))),
    })


def slot_counts(verified: DataFrame, keys: list[str]) -> DataFrame:
    """Proposed slots by outcome."""
    return verified.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("proposed"),
        F.count_if(F.col("outcome") == "proposed").alias("verified"),
        F.count_if(F.col("outcome") == "unquoted").alias("unquoted"),
        F.count_if(F.col("outcome") == "unknown_path").alias("unknown_path"),
        F.count_if(F.col("outcome") == "bad_value").alias("bad_value"),
    )
