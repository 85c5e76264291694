"""Admission, evidence, supersession, rules and contradictions on small tables."""

import pytest
from pyspark.sql import functions as F

from chartledger.functions.evidence import value_evidence
from chartledger.functions.values import make_value
from chartledger.operators import ledger as L
from chartledger.operators import rules as R

COLS = ("session_id string, seq long, fact_id string, path string, kind string, text string, "
        "tier string, span_kind string, verbatim string, question_id string, selected string, "
        "reading string, scope string, coded boolean, supersede boolean")


def candidates(spark, *rows):
    base = {
        "session_id": "s", "path": "hpi.site", "kind": "text", "text": "chest", "tier": "stated",
        "span_kind": "utterance", "verbatim": "pain in my chest", "question_id": "q",
        "selected": None, "reading": None, "scope": None, "coded": False, "supersede": True,
    }
    data = [{**base, "seq": i, "fact_id": f"f{i}", **r} for i, r in enumerate(rows)]
    names = [c.split()[0] for c in COLS.split(", ")]
    df = spark.createDataFrame([tuple(d.get(n) for n in names) for d in data], COLS)
    span = L.make_span(
        kind=F.col("span_kind"), verbatim=F.col("verbatim"), question_id=F.col("question_id"),
        selected_values=F.when(F.col("selected").isNotNull(), F.split("selected", r"\|")),
        human_reading=F.col("reading"), turn_id=F.col("fact_id"))
    return df.withColumn("value", make_value(F.col("kind"), F.col("text"))).withColumn(
        "span", span).withColumnRenamed("scope", "required_scope")


REASONS = [
    ({}, None), ({"span_kind": None}, "no_source"), ({"span_kind": "fax"}, "bad_source_kind"),
    ({"verbatim": "  "}, "blank_verbatim"), ({"text": None}, "null_value"),
    ({"tier": "document"}, "document_span_needed"), ({"span_kind": "document"}, "utterance_needed"),
    ({"tier": "confirmed", "question_id": None}, "question_needed"),
    ({"path": "hpi.sight"}, "unknown_path"), ({"path": "medications[47].name"}, None),
    ({"path": "medications[4800].name"}, None), ({"path": "medications[one].name"}, "unknown_path"),
    ({"scope": "voice"}, "scope_not_granted"), ({"scope": "history"}, None),
    ({"coded": True, "verbatim": "chhaati"}, None),
    ({"coded": True, "text": "elbow"}, "not_in_vocabulary"),
    ({"text": "head"}, "value_not_evidenced"),
]


def test_gates_in_order(spark):
    df = candidates(spark, *[r for r, _ in REASONS])
    scopes = spark.createDataFrame([("s", ["history"])], "session_id string, granted array<string>")
    got = {r.seq: r.reason for r in L.judge_facts(df, scopes).collect()}
    assert got == {i: reason for i, (_r, reason) in enumerate(REASONS)}


EVIDENCE = [
    ("text", "burning pain", "burning", None, None, True),
    ("text", "burning", "a burning pain", None, None, True),
    ("text", "34.0", "ESR 34 mm/hr", None, None, True),
    ("text", "34.0", "ESR 340 mm/hr", None, None, False),
    ("text", "34.0", "ESR 3.4 mm/hr", None, None, False),
    ("text", "left arm pain", "pain, arm on the left", None, None, True),
    ("text", "metformin", "TAB. METFARMIN", None, "Metformin", True),
    ("text", "metformin", "TAB. METFARMIN", None, None, False),
    ("text", "!!", "anything", None, None, False),
    ("list", "fever|cough", "fever and cough", None, None, True),
    ("list", "fever|rash", "fever and cough", None, None, False),
    ("bool", "true", "whatever", None, None, True),
    ("number", "9", "very bad", None, None, True),
    ("text", "chest", "Chest", "chest", None, True),
    ("text", "head", "head", "chest", None, False),
]


def test_value_evidence(spark):
    df = candidates(spark, *[
        {"kind": k, "text": t, "verbatim": v, "selected": s, "reading": r}
        for k, t, v, s, r, _ in EVIDENCE])
    got = df.select("seq", value_evidence(F.col("value"), F.col("span")).alias("ok")).collect()
    assert {r.seq: r.ok for r in got} == {i: e[-1] for i, e in enumerate(EVIDENCE)}


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_supersession_is_by_the_first_later_superseding_fact(spark, chunk):
    df = candidates(spark, {}, {"supersede": False}, {}, {"path": "hpi.onset"}, {"supersede": False})
    got = {r.fact_id: r.superseded_by for r in L.supersede(df.repartition(4), chunk).collect()}
    assert got == {"f0": "f2", "f1": "f2", "f2": None, "f3": None, "f4": None}


def test_duplicate_span_is_dropped_before_it_supersedes(spark):
    df = candidates(spark, {"fact_id": "a"}, {"fact_id": "b"}).withColumn(
        "span", F.col("span").withField("turn_id", F.lit("same")))
    rows = L.supersede(L.dedupe_spans(df)).collect()
    assert [(r.fact_id, r.superseded_by) for r in rows] == [("a", None)]


def facts_of(spark, values, session="s"):
    rows = [(session, i, f"{session}{i}", p, k, t, "stated", f"v{i}", None)
            for i, (p, k, t) in enumerate(values)]
    df = spark.createDataFrame(rows, "session_id string, seq long, fact_id string, path string, "
                                     "kind string, text string, tier string, verbatim string, "
                                     "superseded_by string")
    return df.withColumn("value", make_value(F.col("kind"), F.col("text")))


FIRES = {
    "RF-OBS-01": [("personal_history.pregnancy", "text", "yes"), ("hpi.site", "text", "abdomen")],
    "RF-CARD-01": [("hpi.site", "text", "chest"), ("hpi.onset", "text", "sudden"),
                   ("hpi.severity", "number", "7")],
    "RF-CARD-03": [("review_of_systems.cardiovascular", "list", "orthopnoea|ankle_swelling")],
    "RF-RESP-02": [("review_of_systems.respiratory", "list", "cough_3wk|night_sweats")],
    "RF-PAIN-01": [("hpi.severity", "text", "9")],
}


@pytest.mark.parametrize("rule", sorted(FIRES))
def test_rule_fires(spark, rule):
    rows = R.evaluate_rules(facts_of(spark, FIRES[rule])).collect()
    assert len(rows) == 22
    assert rule in {r.rule_id for r in rows if r.fired}


def test_nothing_fires_and_last_value_counts(spark):
    rows = R.evaluate_rules(facts_of(spark, [
        ("hpi.severity", "number", "10"), ("hpi.severity", "number", "2")])).collect()
    assert not [r for r in rows if r.fired]


def test_priority_never_falls(spark):
    p = R.evaluate_rules(facts_of(spark, [("hpi.severity", "number", "9")]))
    now = spark.createDataFrame([("s", "immediate")], "session_id string, priority string")
    assert R.escalate(p, now).first().priority == "immediate"
    assert R.escalate(p).first().priority == "urgent"


def test_denial_keeps_both_sides(spark):
    f = facts_of(spark, [("drug_allergy.taking_medicines", "bool", "false"),
                         ("medications[0].name", "text", "metformin"),
                         ("medications[1].dose", "text", "5mg"),
                         ("drug_allergy.medicines", "text", "aspirin")])
    got = {(r.rule_id, r.denial_fact, r.other_fact) for r in R.denial_contradictions(f).collect()}
    assert got == {("CX-MED-01", "s0", "s1"), ("CX-MED-02", "s0", "s3")}
