"""Full folding, retrieval across patients, regions of a page, and beginnings of true names."""

import random
import re
import time
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from chartledger.functions.text import fold_term
from chartledger.operators.evaluate import match_truth
from chartledger.operators.extraction import document_regions, extract_entities, region_items
from chartledger.operators.longitudinal import nearest_across_patients


def folded(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.casefold())
                    if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]+", " ", plain)).strip()


def test_every_code_point_folds_as_unicode_says(spark):
    texts = ["a" + chr(n) + "b" for n in range(1, 0x110000) if not 0xD800 <= n < 0xE000]
    df = spark.createDataFrame(pd.DataFrame({"t": texts}))
    # Code points newer than the Unicode tables of the JVM count as punctuation there.
    rows = df.filter(~F.col("t").rlike(r"\p{Cn}")).select("t", fold_term(F.col("t")).alias("f"))
    wrong = [(t, f) for t, f in rows.collect() if f != folded(t)]
    assert wrong == []


def test_folding_of_whole_terms(spark):
    texts = ["ﬁèvre  Ⅳ", "Σίσυφος ΑΣ", "Sốt xuất huyết", "क़िला", "ｆｅｖｅｒ", "한국어 각", "㎏/㎡", "Straße",
             "", "  --  ", None, "ǅ ŉ İ", "x" * 100_000 + "ﬃ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(df.select("i", fold_term(F.col("t"))).collect())
    assert got == {i: None if t is None else folded(t) for i, t in enumerate(texts)}


def brute_nearest(features, owner, flags, targets, k):
    held = {}
    for visit, path, item in features:
        held.setdefault(visit, set()).add((path, item))
    out = set()
    for t in targets:
        hits = sorted(
            (-len(held[t] & held[v]), v) for v in held
            if owner[v] != owner[t] and flags[owner[v]] == flags[owner[t]] and held[t] & held[v])
        out |= {(t, v, -n, at) for at, (n, v) in enumerate(hits[:k], 1)}
    return out


def test_nearest_across_patients_is_exact(spark):
    rng = random.Random(5)
    owner = {v: v % 17 if v % 3 else 0 for v in range(400)}  # patient 0 holds a third of all visits
    flags = {p: bool(p % 4 == 1) for p in range(17)}
    features = set()
    for v in range(390):
        features.add((v, "sex", "m"))  # one feature of all visits
        for p in range(5):
            if rng.random() < 0.7:
                features.add((v, f"p{p}", f"i{int(rng.expovariate(0.5))}"))
    features.add((391, "p0", "alone"))
    targets = [v for v in range(400) if v % 10 == 1]
    enc = spark.createDataFrame(list(owner.items()), "encounter_id long, patient_id long")
    pat = spark.createDataFrame([(p, f or None) for p, f in flags.items()],
                                "patient_id long, is_synthetic boolean")
    feats = spark.createDataFrame(sorted(features), "encounter_id long, path string, item string")
    tgt = spark.createDataFrame([(t,) for t in targets] + [(targets[0],)], "target_id long")
    for k in (1, 3, 500):
        got = nearest_across_patients(tgt, feats, enc, pat, k=k).select(
            "target_id", "encounter_id", "shared_count", "position")
        want = brute_nearest(features, owner, flags, [t for t in targets if t < 390 or t == 391], k)
        assert {tuple(r) for r in got.collect()} == want
    few = nearest_across_patients(tgt, feats, enc, pat, k=3, max_frequency=100)
    assert few.filter("shared_count > 5").count() == 0
    assert nearest_across_patients(tgt.limit(0), feats, enc, pat).count() == 0
    assert nearest_across_patients(tgt, feats.limit(0), enc, pat).count() == 0


def most_rows(df):
    """The largest number of rows that any step of a finished query gave."""
    plans, most = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            plans.append(plan.executedPlan())
            continue
        if plan.nodeName().endswith("QueryStage"):
            plans.append(plan.plan())
        rows = plan.metrics().get("numOutputRows")
        most = max(most, rows.get().value()) if rows.isDefined() else most
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return most


def test_equal_visits_are_searched_once(spark):
    items = {v: (v % 2, v % 3) for v in range(3000)}
    features = [(v, f"p{p}", f"i{i}") for v, held in items.items() for p, i in enumerate(held)]
    enc = spark.range(3000).selectExpr("id AS encounter_id", "id % 500 AS patient_id")
    enc = enc.union(enc.filter("encounter_id IN (7, 12)"))  # listed twice, counted twice
    pat = spark.range(500).selectExpr("id AS patient_id", "CAST(NULL AS BOOLEAN) AS is_synthetic")
    feats = spark.createDataFrame(features, "encounter_id long, path string, item string")
    df = nearest_across_patients(
        spark.range(0, 3000, 10).withColumnRenamed("id", "target_id"), feats, enc, pat)
    got = {}
    for r in df.collect():
        got.setdefault(r.target_id, {})[r.position] = (r.encounter_id, r.shared_count)
    for t in range(0, 3000, 10):
        share = lambda v: sum(a == b for a, b in zip(items[t], items[v], strict=True)) * (
            2 if v in (7, 12) else 1)
        best = sorted((-share(v), v) for v in items if v % 500 != t % 500 and share(v))[:3]
        assert got[t] == {at: (v, -n) for at, (n, v) in enumerate(best, 1)}
    assert most_rows(df) < 50_000


def test_regions_name_their_items_in_order(spark):
    recorded = spark.createDataFrame(
        [(1, 5, 10), (1, 5, 9), (1, 6, 0), (1, None, 1)], "doc_id int, region_id int, position int")
    pending = spark.createDataFrame(
        [(1, 5, 2), (2, 5, 0)], "doc_id int, region_id int, entity_index int")
    items = region_items(recorded, pending)
    assert {tuple(r) for r in items.collect()} == {
        (1, 5, 1, "recorded:9"), (1, 5, 2, "recorded:10"), (1, 5, 3, "pending:2"),
        (1, 6, 1, "recorded:0"), (2, 5, 1, "pending:0")}
    blocks = spark.createDataFrame(
        [(1, 5, 1, "a", 0.95, False, None), (1, 7, 1, "", None, False, None),
         (1, None, 1, "b", 0.9, False, None), (1, 6, 1, "c", None, False, None)],
        "doc_id int, region_id int, page int, text string, confidence double, "
        "handwritten boolean, failure string")
    drawn = document_regions(blocks, items).select("region_id", "band", "items").collect()
    assert {tuple(r) for r in drawn} == {(5, "high", 3), (7, "unreadable", 0), (6, "verify", 1)}


def test_a_long_label_is_cut_once_per_length(spark):
    truth = spark.createDataFrame(
        [(1, 1, "diagnosis", "Asthma, severe type", None, None),
         (1, 2, "diagnosis", "gone missing here", None, None), (1, 3, "diagnosis", "As", None, None),
         (2, 4, "diagnosis", "", None, None)],
        "doc_id int, truth_id int, kind string, name string, dose string, flag string")
    label = "é𝒳 word " * 125_000 + "asthma severe types"
    read = spark.createDataFrame(
        [(1, 0, "diagnosis", label, None, None), (1, 1, "medication", None, None, None)],
        "doc_id int, position int, kind string, label string, dose string, range_flag string")
    start = time.time()
    got = match_truth(truth, read).select("truth_id", "found").collect()
    assert {tuple(r) for r in got} == {(1, True), (2, False), (3, True), (4, False)}
    assert time.time() - start < 60


def test_line_notations(spark):
    lines = ["TAB. METFORMIN 500mg 1-0-1-1 x 5d", "Cap Amoxil 250 mg Q6H for 2 weeks",
             "Syrup Cough Relief 5 ml SOS", "HbA1c: 7.2 % (4.0 - 5.6)", "Amlodipine 5 mg STAT",
             "Serum creatinine 0.9 mg/dL above 0.4", "", None]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, text string")
    got = {r.line_no: r for r in extract_entities(df).collect()}
    fields = {n: (r.kind, r.label, r.form, r.dose, r.frequency_raw, r.duration)
              for n, r in got.items() if r.kind == "medication"}
    assert fields == {
        0: ("medication", "METFORMIN", "TAB", "500mg", "1-0-1-1", "5d"),
        1: ("medication", "Amoxil", "CAP", "250 mg", "Q6H", "2 weeks"),
        2: ("medication", "Cough Relief", "SYRUP", "5 ml", "SOS", None),
        4: ("medication", "Amlodipine", None, "5 mg", "STAT", None)}
    assert (got[3].value, got[3].range_flag, got[3].range_source) == (7.2, "high", "report")
    assert (got[5].value, got[5].reference_low, got[5].range_flag) == (0.9, 0.4, "in_range")
    assert set(got) == {0, 1, 2, 3, 4, 5}
