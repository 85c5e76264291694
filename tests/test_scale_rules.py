"""Nothing is left out as tables grow: entry numbers, partners, counts, chains of equal ids."""

import re
from types import SimpleNamespace

from pyspark.sql import functions as F

from chartledger.functions.values import make_value
from chartledger.operators import governance, ledger, promotion, terms
from chartledger.operators.briefs import encounter_briefs, patient_view
from chartledger.operators.longitudinal import latest_intakes
from chartledger.plans.bindings import Views
from chartledger.plans.promotion_queries import doc_facts


def test_sixty_medicines_of_one_document_are_all_known_paths(spark):
    rows = spark.range(60).select(
        F.lit(1).alias("doc_id"), F.col("id").alias("seq"), F.lit("medication").alias("kind"),
        F.concat(F.lit("drug"), F.col("id").cast("string")).alias("label"),
        *[F.lit(None).cast("string").alias(c) for c in ("dose", "frequency_raw", "route")],
        F.lit(None).cast("double").alias("value"), F.lit(None).cast("date").alias("observed_on"),
        F.lit("x").alias("source_text"))
    found = promotion.entity_facts(rows).select(
        "path", ledger.known_path(F.col("path")).alias("known")).collect()
    assert len(found) == 60 and all(r["known"] for r in found)
    odd = spark.createDataFrame(
        [("medications[123456].name", True), ("medications[-1].name", False),
         ("medications[].name", False), ("medications[1].colour", False)], "path string, ok boolean")
    assert all(r["ok"] == r["known"] for r in odd.select(
        "ok", ledger.known_path(F.col("path")).alias("known")).collect())


def test_lines_and_partners_reach_all_parts_and_patients(spark):
    for sf in ("0.001", "0.01"):
        v = Views(spark, f"/root/testdata/sf{sf}")
        parts = spark.read.parquet(f"/root/testdata/sf{sf}/part.parquet").select(
            "p_name", "p_partkey")
        events = v.ev.count()
        reached = v.ev.select((F.col("event_id") % parts.count()).alias("p")).distinct().count()
        assert reached == min(events, parts.count())
        assert v.line.count() == events


def test_all_near_matches_are_counted(spark):
    concepts = spark.createDataFrame(
        [(i, f"C{i}", f"asthma kind {i}", "category", True) for i in range(40)],
        "concept_id long, code string, display string, class_kind string, is_selectable boolean")
    asked = spark.createDataFrame([("asthma",)], "term string")
    row = terms.code_terms(asked, concepts).first()
    assert row["candidates"] == 40 and row["outcome"] == "near_matches"


def test_chains_with_equal_ids_keep_their_rows(spark):
    rows = spark.createDataFrame(
        [("a", 1, "p"), ("a", 2, "q"), ("b", 1, "r"), ("b", 2, "s"), (None, 1, "t")],
        "k string, id long, payload string")
    sealed = governance.seal_rows(rows, ["k"])
    assert sealed.count() == 5
    assert governance.verify_chain(sealed, ["k"]).filter("intact").count() == 3


def test_an_edit_outside_the_options_is_refused_and_supersedes_nothing(spark):
    text = make_value(F.lit("text"), F.col("shown"))
    facts = spark.createDataFrame(
        [("s", 1, "f1", "hpi.site", "chest"), ("t", 1, "f2", "hpi.site", "head")],
        "session_id string, seq long, fact_id string, path string, shown string").select(
            "session_id", "seq", "fact_id", "path", text.alias("value"),
            F.lit(True).alias("supersede"))
    edits = spark.createDataFrame(
        [("s", 2, "hpi.site", "not an option"), ("t", 2, "hpi.site", "back"),
         ("s", 3, "hpi.site", None)],
        "session_id string, seq long, path string, shown string").select(
            "session_id", "seq", F.current_timestamp().alias("ts"), "path",
            F.when(F.col("shown").isNotNull(), text).alias("value"),
            F.col("shown").alias("value_as_text"), F.lit("dr").alias("actor"),
            F.lit(None).cast("string").alias("reason"))
    granted = spark.createDataFrame([("s", ["history"])], "session_id string, granted array<string>")
    kept, refused = ledger.apply_edits(facts, edits, granted)
    told = {r["fact_id"]: r["superseded_by"] for r in kept.collect()}
    assert told["f1"] is None and told["f2"] in told and len(told) == 3
    why = refused.select("session_id", "reason").collect()
    assert [(r["session_id"], r["reason"]) for r in why] == [("s", "not_in_vocabulary")]


def test_an_observation_keeps_what_its_report_prints(spark):
    groups = spark.createDataFrame(
        [("HbA1c", "9.1", "d1", "2020-02-03", "mmol", 1.0, 2.0, "unknown"),
         ("HbA1c", "9.1", "d1", None, None, None, None, None),
         ("HbA1c", "9.1", None, None, None, None, None, "high")],
        "analyte string, value string, source_document string, observed_on string, unit string, "
        "reference_low double, reference_high double, range_flag string")
    dates = spark.createDataFrame([("d1",)], "document_id string").withColumn(
        "document_date", F.to_date(F.lit("2019-01-01")))
    rows = {(r["source_document"], r["unit"] == "mmol"): r
            for r in promotion.promote_observations(groups, dates).collect()}
    own, derived, bare = rows[("d1", True)], rows[("d1", False)], rows[(None, False)]
    assert str(own["observed_on"]) == "2020-02-03" and own["range_source"] == "report"
    assert (own["reference_low"], own["reference_high"]) == (1.0, 2.0)
    assert str(derived["observed_on"]) == "2019-01-01"
    assert derived["range_source"] == "reference_table"
    assert bare["observed_on"] is None and bare["range_flag"] == "high"


def test_chunks_follow_the_data(spark):
    """Ids as far apart as hashes: no more chunks than shuffle partitions, in the order of ids."""
    from chartledger.functions.ordered import range_chunk

    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(2 ** 60)).alias("id"))
    placed = rows.withColumn("chunk", range_chunk(rows, "id")).groupBy("chunk").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).orderBy(
            "chunk").collect()
    assert len(placed) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(a["high"] < b["low"] for a, b in zip(placed, placed[1:], strict=False))
    assert max(r["n"] for r in placed) < 2 * 5000 / len(placed)
    one = spark.createDataFrame([(7,)] * 9, "id long")
    assert one.select(range_chunk(one, "id").alias("c")).distinct().count() == 1
    none = one.limit(0)
    assert none.select(range_chunk(none, "id")).count() == 0


def test_a_chain_of_any_length_keeps_its_rows_and_columns(spark):
    rows = spark.range(4000).select(
        F.lit(None).cast("string").alias("k"), (F.col("id") % 1300).alias("id"),
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("payload"),
        F.current_timestamp().alias("ts"), F.array("id").alias("more"))
    sealed = governance.seal_rows(rows, ["k"], None)
    assert sealed.count() == 4000 and set(sealed.columns) == {
        "k", "id", "payload", "ts", "more", "segment", "prev_hash", "hash"}
    ends = governance.chain_tails(sealed, ["k"])
    assert ends.count() == 1
    more = governance.seal_rows(rows.filter("id < 5"), ["k"], None, ends)
    first = more.filter(F.col("prev_hash") == ends.first()["hash"])
    assert first.count() == 1 and more.count() == rows.filter("id < 5").count()


def test_texts_without_structure_are_redacted_and_other_types_refused(spark):
    import pytest

    assert governance.scrub_json("[" * 100_000) == '"<redacted>"'
    assert governance.scrub_json('{"a": {"name": 1, "b": [[]]}}') == (
        '{"a":{"b":"<1 item(s)>","name":"<redacted>"}}')
    assert governance.scrub_json(None) is None and governance.scrub_json("7") == "7"
    with pytest.raises(TypeError):
        governance.scrub_audit(spark.range(1), ["id"])


def test_an_entry_number_of_any_length_keeps_its_group(spark):
    rows = spark.createDataFrame(
        [("d", 1, "medications[3000000000].name", "a"), ("d", 2, "medications[3000000000].dose", "1"),
         ("d", 3, "medications[007].name", "b"), ("d", 4, "medications[7].dose", "2"),
         ("d", 5, f"medications[{'9' * 50}].name", "c")],
        "doc_id string, seq long, path string, shown string").select(
            "doc_id", "seq", "path", F.concat(F.lit("f"), F.col("seq").cast("string")).alias("fact_id"),
            make_value(F.lit("text"), F.col("shown")).alias("value"))
    got = {r["entry_text"]: (r["entry"], r["name"], r["dose"]) for r in promotion.repeating_groups(
        rows, "medications", ["doc_id"], ["seq"]).collect()}
    assert got == {"3000000000": (3_000_000_000, "a", "1"), "7": (7, "b", "2"),
                   "9" * 50: (None, "c", None)}


def test_triggers_and_denials_send_nothing_through_the_driver(spark):
    from chartledger.operators import rules

    text = lambda c: make_value(F.lit("text"), F.col(c))
    active = spark.range(200).select(
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("session_id"),
        F.col("id").alias("seq"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("fact_id"),
        F.lit("hpi.site").alias("path"), F.lit("chest").alias("vs")).withColumn("value", text("vs"))
    fired = spark.createDataFrame(
        [("s0", "A", True, ["hpi.site"]), ("s0", "B", True, ["hpi.site", "hpi.onset"]),
         ("s1", "A", False, []), (None, "A", True, ["hpi.site"])],
        "session_id string, rule_id string, fired boolean, paths array<string>")
    found = rules.rule_triggers(fired, active)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["session_id"], r["rule_id"], r["fact_id"]) for r in found.collect())
    assert got == sorted(("s0", rule, f"f{i}") for rule in "AB" for i in range(0, 200, 3))


def test_sealing_carries_only_the_rows_and_a_chain_is_sealed_once(spark):
    from chartledger.plans.catalog import all_queries

    rows = spark.range(20).selectExpr("CAST(NULL AS STRING) AS k", "id", "'p' AS payload")
    plan = governance.seal_rows(rows, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "StructsToJson" not in plan and "0" * 64 not in plan
    checked = all_queries()["a1_sparse_ids"](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in checked._jdf.queryExecution().optimizedPlan().toString()


def test_only_characters_with_several_parts_are_replaced(spark):
    import unicodedata

    from chartledger.functions.text import fold_term

    texts = ["ﬃ한글ﬃ plain ㎑ ½", "한국어 각 가", "𝔸𐌰ﬁ", "x" * 50 + "ŉ", "", None]
    folded = fold_term(F.col("t"))
    assert "transform(" not in folded._jc.toString()
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(folded).collect()

    def plain(text):
        parts = unicodedata.normalize("NFKD", "".join(
            unicodedata.normalize("NFKD", c.casefold()) for c in text))
        kept = "".join(c for c in parts if not unicodedata.combining(c))
        return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in kept).split())

    for text, row in zip(texts, got, strict=True):
        assert row[0] == (None if text is None else plain(text)), text


def test_kinds_are_counted_in_one_row_an_encounter(spark):
    from chartledger.sources.bundles import resource_counts

    rows = [(1, "Patient"), (1, "Flag"), (1, "Flag"), (None, "Flag"), (2, "Odd"), (2, None), (2, None)]
    entries = spark.createDataFrame(rows, "encounter_id long, resource_type string")
    got = {tuple(r) for r in resource_counts(entries).collect()}
    assert got == {(1, "Patient", 1), (1, "Flag", 2), (None, "Flag", 1), (2, "Odd", 1), (2, None, 2)}
    listed = resource_counts(entries.withColumn("resource_type", F.lit("Flag")))
    plan = listed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [encounter_id") == 1 and "resource_type#" not in plan.split(
        "Aggregate [encounter_id")[1].split("]")[0]


def test_lines_are_extracted_once(spark, tmp_path):
    texts = ["TAB. METFORMIN 500mg 1-0-1 x 5 days", "HbA1c: 7.2 % (4.0 - 5.6)", "Cap Amoxil 250 mg BD"]
    spark.createDataFrame(
        [(d, 1, n, t, 0.9, False) for d in (1, 2) for n, t in enumerate(texts)],
        "doc_id long, page int, line_no int, text string, confidence double, handwritten boolean",
    ).write.parquet(f"{tmp_path}/lines")
    facts = doc_facts(SimpleNamespace(spark=spark, line=spark.read.parquet(f"{tmp_path}/lines")))
    assert not [f for f in facts.inputFiles() if "/lines/" in f]
    names = facts.filter("path LIKE '%.name' OR path LIKE '%.analyte'").select(
        "doc_id", "path", "value.s")
    assert {tuple(r) for r in names.collect()} == {
        (d, path, s) for d in (1, 2) for path, s in (
            ("medications[0].name", "METFORMIN"), ("medications[1].name", "Amoxil"),
            ("investigations[0].analyte", "HbA1c"))}


def test_earlier_medicines_are_compared_narrow_and_spread(spark):
    meds = spark.createDataFrame(
        [(p, f"drug{i % 3}", "5mg" if i % 2 else None) for p in (1, 2) for i in range(40)],
        "patient_id long, name string, dose string").withColumn("origin", F.lit("previous-visit"))
    snapshot = spark.createDataFrame([], "patient_id long, path string, display_value string, "
                                     "value struct<kind: string, s: string, n: double, b: boolean, "
                                     "a: array<string>>, evidence_kinds array<string>, "
                                     "confirmed_by_physician boolean")
    trends = spark.createDataFrame([], "patient_id long, analyte_key string, chartable boolean, "
                                   "first_value double, last_value double")
    seen = patient_view(snapshot, meds, trends)
    label = "Medicine from an earlier visit"
    assert sorted(tuple(r) for r in seen.collect()) == sorted(
        (p, "previous", label, f"drug{i}{dose}") for p in (1, 2) for i in range(3)
        for dose in ("", " 5mg"))
    parts = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"hashpartitioning\(patient_id#\d+L?, value#\d+, {parts}\)", plan)
    assert label not in "".join(x for x in plan.splitlines() if "HashAggregate" in x)


def test_brief_lines_are_neither_sorted_nor_broadcast_to_find_their_visit(spark):
    day = "DATE '2020-01-0%d'"
    visits = spark.sql(" UNION ALL ".join(
        f"SELECT {e} AS encounter_id, {p} AS patient_id, {day % d} AS occurred_on, 'intake' AS kind, "
        f"'dr 1' AS confirmed_by, 'h' AS headline, 'urgent' AS priority"
        for e, p, d in ((1, 10, 1), (2, 10, 2), (3, 11, 1), (3, 11, 1), ("NULL", 12, 1), (4, "NULL", 1))
    )).withColumns({c: F.col(c).cast("long") for c in ("encounter_id", "patient_id")})
    facts = spark.createDataFrame(
        [(1, 1, "declined", None, None), (2, 2, "declined", None, None), (3, 2, "stated", 9, "withdrawn"),
         (4, 3, "stated", None, None), (5, None, "declined", None, None)],
        "fact_id long, encounter_id long, state string, superseded_by long, invalidated_reason string",
    ).withColumns({"path": F.lit("hpi.site"), "display_value": F.lit("chest"),
                   "value": make_value(F.lit("text"), F.lit("chest"))})
    evidence = spark.createDataFrame(
        [], "fact_id long, source_type string, modality string")
    meds = spark.createDataFrame(
        [(10, 1, f"drug{i}") for i in range(500)] + [(11, 3, "x"), (None, 4, "y"), (99, 5, "z")],
        "patient_id long, encounter_id long, name string").withColumns(
            {"dose": F.lit("5mg"), "status": F.lit("documented"), "observed_on": F.lit(None)})
    labs = spark.createDataFrame(
        [(10, 1, "tsh", 1.0), (10, 2, "tsh", 2.0), (11, 3, None, 1.0), (99, 4, "tsh", 1.0)],
        "patient_id long, seq long, analyte_key string, value double").withColumns(
            {"unit": F.lit("u"), "observed_on": F.expr(day % 1)})
    told = lambda *fixed: visits.select("encounter_id", *[F.lit("a").alias(c) for c in fixed])
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for most in (kept, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            found = encounter_briefs(
                latest_intakes(visits), visits, facts, evidence, meds, labs, told("rule_id", "level"),
                told("contradiction_ref", "rule_id"), told("decision", "actor")).filter(
                    "section NOT IN ('snapshot', 'what_changed')").groupBy(
                        "patient_id", "section").count()
            plan = found._jdf.queryExecution().executedPlan().toString()
            got = {tuple(r) for r in found.collect()}
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        assert "ShuffledHashJoin" in plan
        assert "SortMergeJoin" not in plan and "Broadcast" not in plan
        once = ("red_flags", "contradictions", "confirmation")
        assert got == {
            *((p, s, n) for p, n in ((10, 1), (11, 2), (None, 1)) for s in once),
            *((p, "completeness", 14) for p in (10, 11, None)), (10, "unresolved", 3),
            (10, "medications", 500), (11, "medications", 1), (10, "observations", 1),
            (10, "timeline", 2), (11, "timeline", 2), (12, "timeline", 1)}
