"""Escalation, contradiction, branching and routing rules over session facts."""

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartledger.config.rules import (
    CROSS_TIER_PATHS,
    DENIAL_RULES,
    DERIVATIONS,
    ESCALATION_RULES,
    QUESTIONS,
)
from chartledger.config.vocabulary import ASR_THRESHOLD, PRIORITIES
from chartledger.functions.conditions import all_of, column_lookup, condition, paths_in
from chartledger.functions.ordered import wide_join, with_running_max
from chartledger.functions.values import make_value, value_number, value_text
from chartledger.operators.ledger import SEQ_CHUNK, latest_values

_LEVEL = {name: i for i, name in enumerate(PRIORITIES)}


def priority_number(label: Column) -> Column:
    """routine 0, urgent 1, immediate 2; anything else 0."""
    return F.when(label == "immediate", 2).when(label == "urgent", 1).otherwise(0)


def priority_label(number: Column) -> Column:
    return F.when(number == 2, "immediate").when(number == 1, "urgent").otherwise("routine")


def _condition_key(cond) -> tuple:
    path, op, arg = cond
    return (path, op, tuple(arg) if isinstance(arg, list) else arg)


def evaluate_rules(
    active: DataFrame,
    rules=ESCALATION_RULES,
    keys: tuple[str, ...] = ("session_id",),
    order: tuple[str, ...] = ("seq",),
    extra_values: DataFrame | None = None,
) -> DataFrame:
    """One row per (session, rule), fired or not, with the paths of the conditions that held.

    The facts of a session are reduced to one wide row, each distinct condition is evaluated once
    on that row, and the rules combine the conditions. Rules are never joined to sessions. Sessions
    without facts appear when ``extra_values`` (same columns as the facts) names them.
    """
    if extra_values is not None:
        # Recorded facts win over extra values: the latter rank below every fact.
        first = F.lit(None).cast("long")
        low = [c for c in order]
        extra = extra_values.withColumns({c: first for c in low if c not in extra_values.columns})
        active = active.unionByName(extra, allowMissingColumns=True)
    conditions = [c for r in rules for clause in r[3] for c in clause]
    # All facts go in, so a session whose facts touch no rule path still gets its (unfired) rows.
    wide, names = latest_values(active, list(keys), paths_in(conditions), list(order))
    return evaluate_wide(wide, names, rules, keys)


def evaluate_wide(
    wide: DataFrame, names: dict[str, str], rules=ESCALATION_RULES,
    keys: tuple[str, ...] = ("session_id",),
) -> DataFrame:
    """`evaluate_rules` on rows that already hold one value column per path (see `names`)."""
    conditions = {
        _condition_key(c): c for _id, _lv, _lb, clauses in rules for cl in clauses for c in cl
    }
    get = column_lookup(names)
    held = {key: f"c{i}" for i, key in enumerate(conditions)}
    tested = wide.select(
        *keys, *[condition(c, get).alias(held[k]) for k, c in conditions.items()],
    )
    rows = []
    for rule_id, level, _label, clauses in rules:
        named = [[(c[0], held[_condition_key(c)]) for c in clause] for clause in clauses]
        fired = " OR ".join("(" + " AND ".join(n for _p, n in cl) + ")" for cl in named)
        hits = sorted({(p, n) for cl in named for p, n in cl})
        arr = ", ".join(f"CASE WHEN {n} THEN '{p}' END" for p, n in hits)
        rows.append(
            f"named_struct('rule_id', '{rule_id}', 'fired', {fired}, "
            f"'level', CASE WHEN {fired} THEN '{level}' END, "
            f"'paths', CASE WHEN {fired} THEN array_sort(array_distinct(array_compact("
            f"array({arr})))) ELSE CAST(array() AS ARRAY<STRING>) END)"
        )
    return tested.select(*keys, F.inline(F.expr("array(" + ", ".join(rows) + ")")))


def escalate(
    proposals: DataFrame, current: DataFrame | None = None, keys: tuple[str, ...] = ("session_id",)
) -> DataFrame:
    """The priority after evaluation: never below the current one. Counts fired flags by level."""
    top = F.max(F.when(F.col("fired"), priority_number(F.col("level"))).otherwise(0))
    fired = proposals.groupBy(*keys).agg(
        top.alias("_top"),
        F.count_if(F.col("fired") & (F.col("level") == "immediate")).alias("immediate_count"),
        F.count_if(F.col("fired") & (F.col("level") == "urgent")).alias("urgent_count"),
    )
    number = F.col("_top")
    if current is not None:
        fired = fired.join(current.select(*keys, F.col("priority").alias("_now")), list(keys),
                           "left")
        number = F.greatest(number, priority_number(F.col("_now")))
    return fired.select(*keys, priority_label(number).alias("priority"), "immediate_count",
                        "urgent_count")


def rule_triggers(
    proposals: DataFrame, active: DataFrame, keys: tuple[str, ...] = ("session_id",)
) -> DataFrame:
    """(session, rule, path, fact) for every fact behind a fired rule."""
    asked = proposals.filter("fired").select(*keys, "rule_id", F.explode("paths").alias("path"))
    facts = active.select(*keys, "path", "fact_id")
    return wide_join(facts, asked, [*keys, "path"])


def adjudicate_candidates(
    candidates: DataFrame, proposals: DataFrame, rules=ESCALATION_RULES
) -> DataFrame:
    """Rules proposed by somebody else: unknown, already fired, or not holding.

    The outcome is a record only; a proposal never changes a priority.
    """
    known = F.col("rule_id").isin(*[r[0] for r in rules])
    levels = F.expr(
        "map(" + ", ".join(f"'{r[0]}', '{r[1]}'" for r in rules) + ")"
    )
    fired = proposals.filter("fired").select("session_id", "rule_id", F.lit(True).alias("_fired"))
    rows = candidates.join(fired, ["session_id", "rule_id"], "left")
    hit = known & F.coalesce("_fired", F.lit(False))
    return rows.select(
        *candidates.columns,
        hit.alias("fired"),
        F.when(hit, F.try_element_at(levels, F.col("rule_id"))).alias("level"),
        F.when(~known, "unknown_rule").when(hit, "already_fired").otherwise("not_holding")
        .alias("outcome"),
    )


def running_priority(
    evaluations: DataFrame, seq_chunk: int = SEQ_CHUNK, keys: tuple[str, ...] = ("session_id",)
) -> DataFrame:
    """Running maximum per session, and where a lower level was proposed."""
    number = priority_number(F.col("proposed"))
    rows = with_running_max(evaluations, list(keys), ["seq"], F.expr(f"seq div {seq_chunk}"),
                            number, "_run")
    return rows.withColumn("priority", priority_label(F.col("_run"))).withColumn(
        "deescalation_attempt", number < F.col("_run")
    ).drop("_run")


def open_questions(
    active: DataFrame,
    declined: DataFrame,
    demographics: DataFrame,
    questions=QUESTIONS,
) -> DataFrame:
    """(session, question, section, open, answered) from the branch conditions.

    ``declined`` holds session_id, question_id. ``demographics`` has one row per session with
    session_id, gender, age_years and decides which sessions are listed.
    """
    asked_about = paths_in([c for q in questions for c in q[6]])
    fact_paths = [p for p in asked_about if not p.startswith("demographics.")]
    wide, names = latest_values(active.filter(F.col("path").isin(*fact_paths)), ["session_id"],
                                fact_paths, ["seq"])
    all_paths = [q[2] for q in questions]
    done = active.filter(F.col("path").isin(*all_paths)).groupBy("session_id").agg(
        F.collect_set("path").alias("_done"))
    known = [q[0] for q in questions]
    refused = declined.filter(F.col("question_id").isin(*known)).groupBy("session_id").agg(F.collect_set("question_id").alias("_refused"))
    rows = (
        demographics.join(wide, "session_id", "left").join(done, "session_id", "left")
        .join(refused, "session_id", "left")
    )
    person = {
        "demographics.gender": ("_gender", make_value(F.lit("text"), F.col("gender"))),
        "demographics.age_years": (
            "_age", make_value(F.lit("number"), F.col("age_years").cast("string"))),
    }
    rows = rows.withColumns(dict(person.values()))
    get = column_lookup({**names, **{p: col for p, (col, _v) in person.items()}})

    groups = {}
    for q in questions:
        groups.setdefault(repr(q[6]), q[6])
    gate = {text: f"g{i}" for i, text in enumerate(groups)}
    gated = rows.select(
        "session_id", "_done", "_refused",
        *[all_of(conds, get).alias(gate[text]) for text, conds in groups.items()],
    )
    entries = ", ".join(
        f"named_struct('question_id', '{q[0]}', 'section', '{q[1]}', 'open', {gate[repr(q[6])]}, "
        f"'answered', coalesce(array_contains(_done, '{q[2]}'), false) OR "
        f"coalesce(array_contains(_refused, '{q[0]}'), false))"
        for q in questions if q[3] != "derived"
    )
    return gated.select("session_id", F.inline(F.expr(f"array({entries})")))


def progress(questions: DataFrame, by_section: bool = False) -> DataFrame:
    """Answered over askable, per session or per section; percent is rounded half to even."""
    keys = ["session_id", "section"] if by_section else ["session_id"]
    counts = questions.groupBy(*keys).agg(
        F.count_if(F.col("open") & F.col("answered")).alias("answered"),
        F.count_if("open").alias("askable"),
    )
    if by_section:
        done = (F.col("askable") > 0) & (F.col("answered") == F.col("askable"))
        return counts.withColumn("complete", done)
    percent = F.when(F.col("askable") > 0, F.bround(F.expr("100 * answered / askable"), 0))
    return counts.withColumn("percent", F.coalesce(percent, F.lit(100.0)).cast("int"))


_BOUND = {
    "lt": lambda n, x: n < x,
    "lte": lambda n, x: n <= x,
    "gt": lambda n, x: n > x,
    "gte": lambda n, x: n >= x,
}


def derive_value(number: Column, bands) -> Column:
    """The value of the first band whose bounds all hold; null for a null number."""
    out = F.lit(None).cast("string")
    for bounds, value in reversed(bands):
        hold = reduce(and_, [_BOUND[k](number, F.lit(x)) for k, x in bounds.items()])
        out = F.when(hold, value).otherwise(out)
    return F.when(number.isNotNull(), out)


def derive_values(facts: DataFrame, derivations=DERIVATIONS) -> DataFrame:
    """(session, path, value_text) for each derived question whose input fact is a number."""
    inputs = {source: (path, bands) for path, (source, bands) in derivations.items()}
    rows = facts.filter(F.col("path").isin(*inputs))
    latest = rows.groupBy("session_id", "path").agg(
        F.max_by(value_number(F.col("value")), "seq").alias("_n"))
    target, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for source, (path, bands) in inputs.items():
        here = F.col("path") == source
        target = F.when(here, path).otherwise(target)
        value = F.when(here, derive_value(F.col("_n"), bands)).otherwise(value)
    return latest.select("session_id", target.alias("path"), value.alias("value_text")).filter(
        "value_text IS NOT NULL")


def _contradiction_id(rule: Column, a: Column, b: Column) -> Column:
    key = F.concat_ws("|", rule, a, b)
    return F.concat(F.lit("cx_"), F.substring(F.sha2(key, 256), 1, 10))


def denial_contradictions(active: DataFrame, rules=DENIAL_RULES) -> DataFrame:
    """Denied in words, yet present: one row per denying fact and conflicting fact.

    A denial is the last active fact of its path. Both sides are kept and neither wins.
    """
    def last(rule):
        _id, path, test, arg, _group, _field, _other = rule
        op = "eq" if test in ("equals", "contains_value") else None
        holds = condition((path, op, arg), lambda _p: "value")
        return f"'{_id}'", (F.col("path") == path) & holds

    paths = sorted({r[1] for r in rules})
    standing = (
        active.filter(F.col("path").isin(*paths)).groupBy("session_id", "path")
        .agg(F.max_by(F.struct("fact_id", "value", "verbatim"), "seq").alias("_f"))
        .select("session_id", "path", "_f.*")
    )
    fired = F.array_compact(F.array(*[
        F.when(test, F.expr(name)) for name, test in map(last, rules)
    ]))
    denials = standing.select(
        "session_id", F.explode(fired).alias("rule_id"),
        F.col("fact_id").alias("denial_fact"), F.col("verbatim").alias("denial_verbatim"),
    )

    def conflicts(rule):
        _id, _path, _test, _arg, group, field, other = rule
        if group is not None:
            return F.col("path").startswith(f"{group}[") & F.col("path").endswith(f".{field}")
        return F.col("path") == other

    hit = F.array_compact(F.array(*[F.when(conflicts(r), F.lit(r[0])) for r in rules]))
    touching = active.filter(reduce(or_, [conflicts(r) for r in rules])).select(
        "session_id", F.explode(hit).alias("rule_id"), F.col("fact_id").alias("other_fact"),
        F.col("verbatim").alias("other_verbatim"),
        (F.col("tier") if "tier" in active.columns else F.lit(None).cast("string"))
        .alias("other_tier"),
    )
    both = wide_join(touching, denials, ["session_id", "rule_id"])
    return both.filter(~F.col("denial_verbatim").eqNullSafe(F.col("other_verbatim"))).select(
        "session_id", "rule_id", "denial_fact", "other_fact", "denial_verbatim",
        "other_verbatim", "other_tier",
        _contradiction_id(F.col("rule_id"), F.col("denial_fact"), F.col("other_fact"))
        .alias("contradiction_id"),
    )


def cross_tier_contradictions(facts: DataFrame, paths=CROSS_TIER_PATHS) -> DataFrame:
    """One path answered differently by two kinds of source; superseded facts count too."""
    first = (
        facts.filter(F.col("path").isin(*paths)).groupBy("session_id", "path", "tier")
        .agg(F.min_by(F.struct("fact_id", value_text(F.col("value")).alias("shown")), "seq")
             .alias("_f"))
    )
    # At most one row per tier is left, so the array is as short as the list of tiers.
    sides = first.groupBy("session_id", "path").agg(
        F.array_sort(F.collect_list(F.struct("tier", "_f"))).alias("_s")
    ).filter(F.size("_s") >= 2)
    a, b = F.col("_s")[0], F.col("_s")[1]
    return sides.filter(a["_f"]["shown"] != b["_f"]["shown"]).select(
        "session_id", "path", a["tier"].alias("first_tier"), b["tier"].alias("second_tier"),
        a["_f"]["fact_id"].alias("first_fact"), b["_f"]["fact_id"].alias("second_fact"),
        _contradiction_id(F.lit("CX-VALUE"), a["_f"]["fact_id"], b["_f"]["fact_id"])
        .alias("contradiction_id"),
    )


def route_spoken(turns: DataFrame, questions=QUESTIONS, threshold: float = ASR_THRESHOLD
                 ) -> DataFrame:
    """Accept a spoken answer or fall back to touch; adds `reason` (null means accepted).

    Reads text, asr_confidence (null when unmeasured), question_id and slots_found.
    """
    critical = F.col("question_id").isin(*[q[0] for q in questions if q[5]])
    reason = (
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "silence")
        .when(F.col("asr_confidence").isNull() & critical, "unmeasured")
        .when(F.col("asr_confidence") < threshold, "unclear")
        .when(F.col("slots_found") == 0, "unclear")
    )
    return turns.withColumn("reason", reason)


def route_rates(routed: DataFrame, keys: list[str]) -> DataFrame:
    """Accepted and degraded turns per key, and the share degraded."""
    return routed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("turns"),
        F.count_if(F.col("reason").isNull()).alias("accepted"),
        F.count_if(F.col("reason") == "silence").alias("silence"),
        F.count_if(F.col("reason") == "unmeasured").alias("unmeasured"),
        F.count_if(F.col("reason") == "unclear").alias("unclear"),
        F.round(F.count("reason") / F.count(F.lit(1)), 4).alias("degraded_rate"),
    )
