"""Summary lines and the check that every word in them comes from a recorded fact."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartledger.config.rules import DENIAL_RULES, ESCALATION_RULES, QUESTIONS, label_of, option_values
from chartledger.config.vocabulary import (
    COMPLETENESS_WARNING,
    STOPWORDS,
    TEMPLATE_WORDS,
)
from chartledger.functions.text import TOKEN, tokens
from chartledger.functions.values import rank_of, value_text
from chartledger.operators.ledger import overall_completeness

# Sections in reading order.
SECTIONS = (
    "warnings", "patient", "chief_complaint", "hpi", "red_flags", "past_medical",
    "past_surgical", "drug_allergy", "contradictions", "documents", "family_history", "personal_history", "review_of_systems",
    "ayush", "gaps",
)
SMOOTHABLE_MIN_LINES = 3


def authored_words(rules=ESCALATION_RULES, questions=QUESTIONS, denials=DENIAL_RULES) -> set[str]:
    """Words that reviewed rule and question tables bring along."""
    import re

    texts = [t for r in rules for t in (r[0], r[2])] + [d[0] for d in denials]
    for q in questions:
        texts += [field_label(q[2]), *[label_of(v) for v in option_values(q)]]
    return {w.lower() for t in texts for w in re.findall(TOKEN, t)}


def field_label(path: str) -> str:
    return label_of(path.rsplit(".", 1)[-1])


def _line(section: str, text: Column, ids: Column, kind: str, emphasis: Column | None = None,
          rank: Column | None = None) -> list[Column]:
    none = F.lit(None).cast("string")
    return [
        F.lit(section).alias("section"), text.alias("text"), ids.alias("fact_ids"),
        F.lit(kind).alias("kind"), (none if emphasis is None else emphasis).alias("emphasis"),
        (F.lit(0) if rank is None else rank).alias("rank"),
    ]


def summary_lines(
    slots: DataFrame, status: DataFrame, proposals: DataFrame, contradictions: DataFrame,
    demographics: DataFrame | None = None, medicines: DataFrame | None = None,
    problems: DataFrame | None = None, documents: DataFrame | None = None,
    timeline: DataFrame | None = None, questions=QUESTIONS, rules=ESCALATION_RULES,
) -> DataFrame:
    """The lines of each session's summary; sort by `position`, `rank`, text to read it.

    ``slots`` is `slot_view`; ``status`` is `field_status`; ``contradictions`` is
    `denial_contradictions`. Optional: ``demographics`` (session_id, age_years, gender),
    ``medicines`` and ``problems`` (`repeating_groups` by session, with code and display),
    ``documents`` (session_id, filename, pages, read_by, mean_confidence, low_pages) and
    ``timeline`` (session_id, occurred_on, label, fact_id, low_confidence).

    Fact lines name the facts they come from, structural lines make no claim. The lists in a line
    are bounded by the rule and question tables: a fired rule names the standing fact of each of
    its paths. Entries, documents and events are a line each, however many there are.
    """
    labels = rank_of({q[2]: field_label(q[2]) for q in questions})
    place = rank_of({q[2]: i for i, q in enumerate(questions)})
    section_of = rank_of({q[2]: q[1] for q in questions})
    none = F.array().cast("array<string>")
    path = F.col("path")
    facts = slots.filter(path.isin(*[q[2] for q in questions])).select(
        "session_id", section_of(path).alias("section"),
        F.concat(labels(path), F.lit(": "), value_text(F.col("value"))).alias("text"),
        F.array("fact_id").alias("fact_ids"), F.lit("fact").alias("kind"),
        F.lit(None).cast("string").alias("emphasis"), place(path).alias("rank"))
    words = rank_of({r[0]: r[2] for r in rules})
    fired = proposals.filter("fired")
    standing = slots.select("session_id", "path", "fact_id")
    behind = fired.select("session_id", "rule_id", F.explode("paths").alias("path")).join(
        standing, ["session_id", "path"]).groupBy("session_id", "rule_id").agg(
            F.array_sort(F.collect_set("fact_id")).alias("_ids"))
    flags = fired.join(behind, ["session_id", "rule_id"], "left").select(
        "session_id", *_line(
            "red_flags", F.concat(F.lit("["), F.upper("level"), F.lit("] "),
                                  words(F.col("rule_id"))),
            F.coalesce("_ids", none), "fact", F.col("level"),
            F.when(F.col("level") == "immediate", 0).otherwise(1)))
    quiet = proposals.groupBy("session_id").agg(F.count_if("fired").alias("_n")).filter(
        "_n = 0").select("session_id", *_line(
            "red_flags",
            F.lit("No rule fired. This is no statement that the patient is low priority."),
            none, "structural"))
    origin = F.when(F.col("other_tier") == "document", "document").otherwise("patient")
    disputes = contradictions.select("session_id", *_line(
        "contradictions", F.concat(
            F.col("rule_id"), F.lit(": patient “"), "denial_verbatim", F.lit("” vs "), origin,
            F.lit(" “"), "other_verbatim", F.lit("”")),
        F.array("denial_fact", "other_fact"), "fact", F.lit("unverified")))
    gaps = status.filter("status <> 'recorded'").groupBy("session_id", "status").agg(
        F.array_sort(F.collect_list("path")).alias("_p"))
    gap_lines = gaps.select("session_id", *_line(
        "gaps", F.when(F.col("status") == "declined", F.concat(
            F.lit("Patient declined to answer: "), F.array_join("_p", ", "))).otherwise(F.concat(
                F.lit("Not asked ("), F.size("_p").cast("string"), F.lit("): "),
                F.array_join("_p", ", "))),
        none, "structural", F.when(F.col("status") == "declined", "unverified"),
        F.when(F.col("status") == "declined", 0).otherwise(1)))
    low = overall_completeness(status).filter(F.col("completeness") < COMPLETENESS_WARNING)
    warnings = low.select("session_id", *_line(
        "warnings", F.concat(
            F.lit("Only "), F.round(F.col("completeness") * 100).cast("int").cast("string"),
            F.lit("% of the applicable history was captured. Treat the gaps as unknown, not as "
                  "negative findings.")),
        none, "structural", F.lit("unverified")))
    parts = [flags, quiet, disputes, gap_lines, warnings]
    code = lambda missing: F.when(F.col("code").isNotNull(), F.concat(
        F.lit(" ["), "code", F.lit(" "), "display", F.lit("]"))).otherwise(F.lit(missing))
    if demographics is not None:
        bits = F.array_compact(F.array(
            F.when(F.col("age_years") > 0, F.concat(F.col("age_years").cast("string"),
                                                    F.lit(" years"))),
            F.when(F.col("gender") != "", F.col("gender"))))
        parts.append(demographics.filter(F.size(bits) > 0).select("session_id", *_line(
            "patient", F.array_join(bits, ", "), none, "structural")))
    if medicines is not None:
        parts.append(medicines.filter("name IS NOT NULL").select("session_id", *_line(
            "drug_allergy", F.concat(
                F.lit("Medication: "), F.concat_ws(" ", "name", "dose", "frequency", "route"),
                code("")),
            F.array("source_fact"), "fact", rank=F.lit(len(questions)) + F.col("entry"))))
    if problems is not None:
        year = F.when(F.col("reported_year").isNotNull(), F.concat(
            F.lit(" ("), "reported_year", F.lit(")"))).otherwise("")
        parts.append(problems.filter("reported_term IS NOT NULL").select("session_id", *_line(
            "past_medical", F.concat(F.lit("Reported: "), "reported_term", year,
                                     code(" [unmapped]")),
            F.array("source_fact"), "fact", rank=F.lit(len(questions)) + F.col("entry"))))
    if documents is not None:
        bad = F.col("low_pages") > 0
        parts.append(documents.select("session_id", *_line(
            "documents", F.concat(
                "filename", F.lit(": "), F.col("pages").cast("string"),
                F.lit(" page(s), read by "), "read_by", F.lit(" at "),
                F.round(F.col("mean_confidence") * 100).cast("int").cast("string"),
                F.lit("% mean confidence"),
                F.when(bad, F.concat(F.lit(" — "), F.col("low_pages").cast("string"),
                                     F.lit(" page(s) need verification"))).otherwise("")),
            none, "structural", F.when(bad, "unverified"))))
    if timeline is not None:
        known = F.col("fact_id").isNotNull()
        parts.append(timeline.select("session_id", *_line(
            "documents", F.concat(
                F.coalesce(F.col("occurred_on").cast("string"), F.lit("undated")), F.lit(" — "),
                "label"),
            F.when(known, F.array("fact_id")).otherwise(none), "fact",
            F.when(F.col("low_confidence"), "unverified"), F.lit(1))).withColumn(
                "kind", F.when(F.size("fact_ids") > 0, "fact").otherwise("structural")))
    rows = facts
    for part in parts:
        rows = rows.unionByName(part)
    position = rank_of({s: i for i, s in enumerate(SECTIONS)}, len(SECTIONS))
    return rows.withColumn("position", position(F.col("section"))).withColumn(
        "line_id", F.sha2(F.concat_ws("|", "session_id", "section", "text"), 256))


def check_lines(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """Fact lines without facts (untraced) and facts that do not exist (dangling)."""
    claims = lines.filter("kind = 'fact'")
    untraced = claims.filter(F.size("fact_ids") == 0).select(
        "session_id", "line_id", F.lit("untraced").alias("problem"),
        F.lit(None).cast("string").alias("fact_id"))
    named = claims.select("session_id", "line_id", F.explode("fact_ids").alias("fact_id"))
    dangling = named.join(facts.select("session_id", "fact_id"), ["session_id", "fact_id"],
                          "left_anti")
    return untraced.unionByName(dangling.select(
        "session_id", "line_id", F.lit("dangling").alias("problem"), "fact_id"))


def supported_tokens(facts: DataFrame) -> DataFrame:
    """Distinct (session, token) that a session's facts license: value, words, path, document."""
    text = F.concat_ws(
        " ", value_text(F.col("value"), " "), "verbatim",
        F.translate("path", "._", "  "), "document_id")
    return facts.select("session_id", F.explode(tokens(text)).alias("token")).distinct()


def check_tokens(
    lines: DataFrame, facts: DataFrame, vocabulary: set[str] | None = None
) -> DataFrame:
    """Words of fact lines that neither the session's facts nor the fixed vocabulary support.

    Words of the fixed vocabulary are dropped before anything shuffles; the rest meet the
    session's licensed words once per distinct (session, word).
    """
    fixed = sorted(set(STOPWORDS) | set(TEMPLATE_WORDS) | (
        authored_words() if vocabulary is None else vocabulary))
    said = lines.filter("kind = 'fact'").filter(F.size("fact_ids") > 0).select(
        "session_id", "line_id", F.explode(tokens(F.col("text"))).alias("token")).filter(
        "token NOT IN (" + ", ".join(f"'{w}'" for w in fixed) + ")")
    missing = said.select("session_id", "token").distinct().join(
        supported_tokens(facts), ["session_id", "token"], "left_anti")
    return said.join(missing, ["session_id", "token"], "left_semi")


def traceability(lines: DataFrame, facts: DataFrame, vocabulary: set[str] | None = None
                 ) -> DataFrame:
    """Per session: lines, fact lines, each kind of problem, and whether the summary may stand."""
    base = lines.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("lines_checked"),
        F.count_if(F.col("kind") == "fact").alias("fact_lines"))
    problems = check_lines(lines, facts).groupBy("session_id").agg(
        F.count_if(F.col("problem") == "untraced").alias("untraced"),
        F.count_if(F.col("problem") == "dangling").alias("dangling"))
    words = check_tokens(lines, facts, vocabulary).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("unsupported"))
    out = base.join(problems, "session_id", "left").join(words, "session_id", "left").na.fill(0)
    return out.withColumn("ok", F.expr("untraced + dangling + unsupported = 0"))


def resolve_sources(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per line and fact behind it, in line order; facts that do not exist are left out."""
    named = lines.select("session_id", "line_id", F.posexplode("fact_ids").alias("ordinal", "fact_id"))
    return named.join(
        facts.select("session_id", "fact_id", "tier", "verbatim", "modality", "document_id"),
        ["session_id", "fact_id"])


def accept_prose(
    prose: DataFrame, lines: DataFrame, facts: DataFrame, sections: list[str]
) -> DataFrame:
    """May a written paragraph replace the fact lines of its section?

    ``prose`` holds session_id, section, text. The section has to be allowed and hold at least
    three fact lines, and every word has to be supported.
    """
    counts = lines.filter("kind = 'fact'").groupBy("session_id", "section").agg(
        F.count(F.lit(1)).alias("_n"))
    as_lines = prose.select(
        "session_id", "section", "text", F.lit("fact").alias("kind"),
        F.array(F.lit("*")).alias("fact_ids"),
        F.concat_ws("|", "session_id", "section").alias("line_id"))
    bad = check_tokens(as_lines, facts).groupBy("line_id").agg(F.count(F.lit(1)).alias("_bad"))
    rows = as_lines.join(counts, ["session_id", "section"], "left").join(bad, "line_id", "left")
    reason = (
        F.when(~F.col("section").isin(*sections), "section_not_allowed")
        .when(F.coalesce("_n", F.lit(0)) < SMOOTHABLE_MIN_LINES, "too_few_lines")
        .when(F.col("_bad") > 0, "unsupported_words")
    )
    return rows.select("session_id", "section", reason.alias("reason"))
