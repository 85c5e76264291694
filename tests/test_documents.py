"""Whole documents written row by row."""

import json

from pyspark.sql import functions as F

from chartledger.functions.values import make_value
from chartledger.operators.briefs import brief_facts, brief_fragments, encounter_briefs
from chartledger.operators.longitudinal import latest_intakes
from chartledger.plans.bindings import Views
from chartledger.plans.source_queries import brief, written_facts
from chartledger.sources import bundles as B
from chartledger.sources import documents as D

SCHEMA = "doc long, section string, n int, item string"


def written(spark, tmp_path, rows, sections=("b", "a")):
    frame = spark.createDataFrame(rows, SCHEMA)
    parts = D.fragments(frame, "doc", sections, F.struct("doc"), ["n"])
    D.write_documents(parts, f"{tmp_path}/out")
    return [json.loads(r.value) for r in D.read_documents(spark, f"{tmp_path}/out").collect()]


def test_sections_and_items_come_in_order(spark, tmp_path):
    got = written(spark, tmp_path, [
        (1, "a", 2, '"second"'), (1, "a", 1, '"first"'), (1, "b", 9, '{"x":"line\\nbreak"}'),
        (1, 'od"d', 1, "1"), (2, "a", 1, "1"), (2, "a", 1, "1"), (2, "a", 0, None),
        (None, None, None, '"nobody"')])
    by = {d.get("doc"): d for d in got}
    assert len(got) == 3
    assert list(by[1]) == ["doc", "b", "a", 'od"d']
    assert by[1] == {"doc": 1, "b": [{"x": "line\nbreak"}], "a": ["first", "second"], 'od"d': [1]}
    assert by[2] == {"doc": 2, "a": [None, 1, 1]}
    assert by[None] == {"": ["nobody"]}


def test_no_rows_no_documents(spark, tmp_path):
    assert written(spark, tmp_path, []) == []


def test_a_document_with_most_rows_and_a_very_long_item(spark, tmp_path):
    long = json.dumps("x" * 1_000_000)
    rows = [(7, "a", i, str(i)) for i in range(20_000)] + [(7, "b", 0, long)]
    rows += [(i, "a", 0, str(i)) for i in range(100, 400)]
    got = {d["doc"]: d for d in written(spark, tmp_path, rows)}
    assert len(got) == 301
    assert got[7]["a"] == list(range(20_000)) and len(got[7]["b"][0]) == 1_000_000


def test_bundles_need_no_composition(spark, tmp_path):
    entries = spark.createDataFrame(
        [(1, "p", "Patient", '{"a":1}'), (1, "c", "Composition", '{"b":2}'),
         (1, 'q"', "Odd", '{"c":3}'), (2, "f", "Flag", '{"d":4}')],
        "encounter_id long, entry_id string, resource_type string, resource string")
    B.write_encounter_documents(entries, f"{tmp_path}/out")
    got = [json.loads(r.value) for r in D.read_documents(spark, f"{tmp_path}/out").collect()]
    by = {d["identifier"]["value"]: d for d in got}
    assert set(by) == {"1", "2"} and by["1"]["resourceType"] == "Bundle"
    told = {e["fullUrl"]: e["resource"] for e in by["1"]["entry"]}
    assert told == {"p": {"a": 1}, "c": {"b": 2}, 'q"': {"c": 3}}
    assert [e["fullUrl"] for e in by["1"]["entry"]][1:] == ["c", "p"]
    assert by["2"]["entry"] == [{"fullUrl": "f", "resource": {"d": 4}}]


def test_every_line_of_every_brief_is_in_its_document(spark, tmp_path):
    lines = brief(Views(spark, "/root/testdata/sf0.001"))
    D.write_documents(brief_fragments(lines), f"{tmp_path}/out")
    got = []
    for row in D.read_documents(spark, f"{tmp_path}/out").collect():
        doc = json.loads(row.value)
        key = doc.pop("encounter_id")
        doc.pop("patient_id")
        got += [(key, s, json.dumps(i, sort_keys=True)) for s, items in doc.items() for i in items]
    want = [(r.encounter_id, r.section, json.dumps(json.loads(r.item), sort_keys=True))
            for r in lines.select("encounter_id", "section", "item").collect()]
    assert sorted(got) == sorted(want) and len({s for _, s, _ in got}) == 10


def test_files_are_far_smaller_than_their_documents(spark, tmp_path):
    rows = [(i // 50, "a", i, json.dumps({"resource": {"status": "final", "n": i}}))
            for i in range(5000)]
    got = written(spark, tmp_path, rows)
    assert len(got) == 100 and sum(len(d["a"]) for d in got) == 5000
    files = [f for f in (tmp_path / "out").iterdir() if f.name.startswith("part-")]
    assert sum(f.stat().st_size for f in files) * 3 < sum(len(json.dumps(d)) for d in got)


def test_a_head_is_carried_as_values(spark):
    frame = spark.createDataFrame([(1, "a", 1, "1")], SCHEMA)
    head = F.struct(F.lit("x" * 3000).alias("t"), F.col("doc"))
    parts = D.fragments(frame, "doc", ("a",), head, ["n"])
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Window", 1)[1]
    assert "StructsToJson" in plan and "StructsToJson" not in below


def test_values_are_shuffled_and_texts_are_made_where_the_documents_lie(spark):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    own = "encounter_id long, key string, "
    inputs = (
        rows([(1, 10, "dr 1", "c1", "a1"), (2, 11, None, None, None), (2, 12, "", "c2", 'q"'),
              (None, 13, "dr 2", "c3", "a3"), (3, None, "dr\n3", "c4", "a4")],
             "encounter_id long, patient_id long, confirmed_by string, consent_ref string, "
             "abha_ref string"),
        rows([(1, "p", "term"), (1, "p", "another term"), (2, None, None), (9, "p", "nobody's")],
             own + "term string"),
        rows([(1, "m", "drug", "5mg", None, "oral", "yes"), (1, "m", "drug", "5mg", None, "oral", "yes"),
              (2, "n", None, None, None, None, None)],
             own + "name string, dose string, frequency string, route string, ongoing string"),
        rows([(1, "o", "HbA1c", 7.5, "pending", " ", None, 50.0),
              (3, "o", "TSH", None, "pending", "mIU/L", None, None)],
             own + "display string, value double, value_text string, unit string, "
             "reference_low double, reference_high double"),
        rows([(1, "f", "urgent", "raised")], own + "level string, label string"),
        rows([(3, "d", "scan3")], own + "filename string"),
        rows([(1, "Condition", "p", "stated", "said", "turn 1"), (8, "Flag", "f", None, None, "x")],
             "encounter_id long, target_type string, key string, tier string, verbatim string, "
             "location string"))

    def told(parts):
        texts = {}
        for r in parts.collect():
            texts[r.encounter_id] = texts.get(r.encounter_id, "") + r.value
        return texts

    values = B.value_fragments(B.entry_values(*inputs))
    got = told(values)
    assert got == told(B.document_fragments(B.encounter_bundles(*inputs)))
    first = json.loads(got[1])["entry"]
    assert [e["resource"]["resourceType"] for e in first] == [
        "Composition", "Patient", "Consent", "Condition", "Condition", "MedicationStatement",
        "MedicationStatement", "Observation", "Flag", "Provenance"]
    # Of equal references the texts decide.
    assert [e["resource"]["code"]["text"] for e in first[3:5]] == ["another term", "term"]
    plan = values._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1
    above, below = plan.split("Repartition")
    for made in ("sha2", "StructsToJson"):
        assert made in above and made not in below
    # One sort: the window takes the order it is given.
    ran = values._jdf.queryExecution().executedPlan().toString().split("Union")[0]
    assert ran.count("Sort [") == 1 and ran.count("Exchange") == 1


def test_briefs_are_made_of_the_facts_of_two_visits_a_patient(spark):
    visit = ("encounter_id long, patient_id long, occurred_on string, kind string, confirmed_by string, "
             "headline string, priority string")
    visits = spark.createDataFrame(
        [(e, p, f"2020-01-0{d}", kind, by, "h", "urgent") for e, p, d, kind, by in (
            (1, 10, 1, "intake", "dr 1"), (2, 10, 2, "intake", "dr 1"), (3, 10, 3, "intake", "dr 2"),
            (4, 10, 4, "intake", ""), (5, 10, 5, "document", "dr 1"), (6, 11, 1, "intake", "dr 1"),
            (6, 11, 1, "intake", "dr 1"), (None, 12, 1, "intake", "dr 1"), (8, None, 1, "intake", "dr 1"),
            (9, None, 2, "intake", "dr 1"))], visit).withColumn(
                "occurred_on", F.col("occurred_on").cast("date"))
    told = [("hpi.site", "chest"), ("hpi.radiation", "back"), ("hpi.severity", "5")]
    facts = spark.createDataFrame(
        [(e * 10 + i, e, path, f"{value}{e % 2 * i}", "declined" if i + e == 3 else "stated",
          77 if e == i else None, "withdrawn" if e * i == 6 else None)
         for e in range(1, 11) for i, (path, value) in enumerate(told)]
        + [(500, None, "hpi.site", "nobody's", "stated", None, None)],
        "fact_id long, encounter_id long, path string, display_value string, state string, "
        "superseded_by long, invalidated_reason string",
    ).withColumn("value", make_value(F.lit("text"), F.col("display_value")))
    evidence = facts.select("fact_id", F.lit("utterance").alias("source_type"),
                            F.lit("touch").alias("modality"))
    none = lambda schema: spark.createDataFrame([], schema)
    current = latest_intakes(visits.filter("confirmed_by <> ''"))

    def lines(known):
        made = encounter_briefs(
            current, visits, known, evidence,
            none("patient_id long, encounter_id long, name string, dose string, status string, "
                 "observed_on date"),
            none("patient_id long, seq long, analyte_key string, value double, unit string, "
                 "observed_on date"), none("encounter_id long, rule_id string, level string"),
            none("encounter_id long, contradiction_ref string, rule_id string"),
            none("encounter_id long, decision string, actor string"))
        return sorted(map(str, made.collect()))

    few = brief_facts(current, visits, facts)
    assert {r.encounter_id for r in few.collect()} == {2, 3, 6, 9}
    got = lines(few)
    assert got == lines(facts)
    for section in ("snapshot", "unresolved", "completeness", "what_changed"):
        assert any(f"section='{section}'" in x for x in got)
    assert any('"change":"resolved"' in x for x in got)


def test_facts_of_documents_are_written_out_after_one_shuffle_of_their_lines(spark):
    views = Views(spark, "/root/testdata/sf0.001")
    lean = views.dealt(lineitem="l_orderkey").efact
    assert sorted(map(str, lean.collect())) == sorted(map(str, views.efact.collect()))
    key = lean.select("encounter_id").distinct()
    plan = lean.join(key.hint("shuffle_hash"), "encounter_id", "left_semi")
    ran = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey#" in ran and "l_linenumber#" not in "".join(
        x for x in ran.splitlines() if "hashpartitioning" in x)
    facts = written_facts(views)
    assert not [f for f in facts.inputFiles() if "lineitem" in f]
    assert 0 < facts.count() < views.efact.count()
    # What the texts of briefs are sorted with: no copy of the head or of the sort columns.
    sorts = brief_fragments(brief(views, facts))._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in sorts and "_head" not in sorts and "_by0" not in sorts
