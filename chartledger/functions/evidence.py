"""Does a source span support the value recorded from it, and is it the same span as before?"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartledger.functions.text import evidence_norm
from chartledger.functions.values import scalar_text

_NUMBER = r"-?\d+(?:\.\d+)?"


def _blank(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def span_haystack(span: Column) -> Column:
    parts = [span["verbatim"], span["verbatim_translated"], span["human_reading"]]
    return F.concat_ws(" ", *[F.when(F.length(p) > 0, evidence_norm(p)) for p in parts])


def span_text(span: Column) -> Column:
    parts = [span["verbatim"], span["verbatim_translated"], span["human_reading"]]
    return F.concat_ws(" ", *[F.when(F.length(p) > 0, p) for p in parts])


def _text_is_echoed(raw: Column, haystack: Column, text: Column) -> Column:
    wanted = evidence_norm(raw)
    either_way = haystack.contains(wanted) | wanted.contains(haystack)
    number = F.trim(raw).try_cast("double")
    same_number = F.exists(
        F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)),
        lambda found: F.abs(found.try_cast("double") - number) < 1e-9,
    )
    words = F.filter(F.split(wanted, " "), lambda w: F.length(w) > 2)
    all_words = (F.size(words) > 0) & F.forall(words, lambda w: haystack.contains(w))
    return F.when(wanted == "", F.lit(False)).otherwise(
        either_way | F.when(number.isNotNull(), same_number).otherwise(all_words)
    )


def value_evidence(
    value: Column, span: Column, hay: Column | None = None, text: Column | None = None
) -> Column:
    """True when the span is evidence for the value.

    A span made by selecting options proves exactly the options selected. Otherwise booleans and
    numbers need no echo, and a text needs to appear in the span: as a piece of it (or it of the
    text), as the same number, or word by word. A list needs all of its elements. ``hay`` and ``text`` take `span_haystack` and
    `span_text` where the caller has computed them already.
    """
    selected = span["selected_values"]
    hay = span_haystack(span) if hay is None else hay
    text = span_text(span) if text is None else text
    is_list = value["kind"] == "list"
    by_selection = F.when(
        is_list,
        (F.size(value["a"]) > 0) & (F.size(F.array_except(value["a"], selected)) == 0),
    ).otherwise(F.array_contains(selected, scalar_text(value)))
    by_text = (
        F.when(value["kind"].isin("bool", "number"), F.lit(True))
        .when(
            is_list,
            (F.size(value["a"]) > 0)
            & F.forall(value["a"], lambda item: _text_is_echoed(item, hay, text)),
        )
        .otherwise(_text_is_echoed(value["s"], hay, text))
    )
    return F.coalesce(F.when(selected.isNotNull(), by_selection).otherwise(by_text), F.lit(False))


def span_digest(span: Column) -> Column:
    """Sixteen hex digits that identify a span; two recordings of one utterance agree."""
    # The layout of the digest key.
    document = F.concat(
        F.lit("doc|"), _blank(span["document_id"]), F.lit("|"),
        _blank(span["page"].cast("string")), F.lit("|"),
        _blank(span["bbox"]["x"].cast("string")), F.lit(","),
        _blank(span["bbox"]["y"].cast("string")), F.lit("|"), _blank(span["verbatim"]),
    )
    utterance = F.concat(
        F.lit("utt|"), _blank(span["turn_id"]), F.lit("|"),
        _blank(span["char_start"].cast("string")), F.lit(":"),
        _blank(span["char_end"].cast("string")), F.lit("|"), _blank(span["verbatim"]),
    )
    key = F.when(span["kind"] == "document", document).otherwise(utterance)
    return F.substring(F.sha2(key, 256), 1, 16)
