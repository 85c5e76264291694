import zlib

import numpy as np
import pandas as pd
from helpers import documents
from pyspark.sql import types as T

from chartledger.llm import language
from chartledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def tongues(spark, rows):
    """Documents with a lang of their own and columns whose names clash."""
    return spark.createDataFrame(rows, T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("key", T.StringType()),
        T.StructField("score", T.StringType()), T.StructField("rank", T.LongType())]))


def test_held_out_accuracy_and_bounds(spark):
    told = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_nearest_centroid"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(told)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in told[r["doc_id"]]["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
    held = [r for r in got if r["held_out"] and told[r["doc_id"]]["lang"]]
    right = sum(r["lang_pred"] == told[r["doc_id"]]["lang"] for r in held)
    assert len(held) > 100 and right >= 0.98 * len(held)


def test_held_out_rows_and_other_columns_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    turned = docs.withColumn("lang", language.F.when(
        language.held_out(language.F.col("doc_id")), language.F.lit("xx")).otherwise(
            language.F.col("lang"))).withColumn("source", language.F.lit("other"))
    a = language.languages(spark, docs).collect()
    b = language.languages(spark, turned).collect()
    assert sorted(a) == sorted(b)


def counted_by_hand(text):
    """n-grams of one text, one character at a time."""
    import unicodedata

    out = {}
    kept = []
    for c in text.lower() + "\0":
        if unicodedata.category(c)[0] in "LM":
            kept.append(c)
        elif kept and kept[-1] is not None:
            kept.append(None)
    codes = [0 if c is None else ord(c) for c in kept]
    for i, c in enumerate(codes):
        before = codes[i - 1] if i else 0
        second = codes[i - 2] if before and i > 1 else 0
        grams = [(before << 21) | c | (1 << 62)]
        if c:
            grams.append(c)
        if before:
            grams.append((second << 42) | (before << 21) | c)
        for g in grams:
            out[g] = out.get(g, 0) + 1
    row = np.zeros(language.WIDTH, dtype=np.float32)
    for g, n in out.items():
        mixed = language._mix(np.array([g], dtype=np.uint64))[0]
        row[int(mixed) >> 52] += n
    return row


def test_counts_equal_a_plain_loop_and_do_not_depend_on_the_batch():
    texts = ["Ärger über 12 Öfen!", "", "x", "...", "hé hé, là-bas", "ab\ncd  ef", "नमस्ते दुनिया"]
    counts, letters = language.gram_counts(texts)
    for i, text in enumerate(texts):
        alone, n = language.gram_counts([text])
        assert (alone[0] == counts[i]).all() and n[0] == letters[i]
        assert (alone[0] == counted_by_hand(text)).all()
        assert letters[i] == sum(c.isalpha() for c in text.lower())


def test_predictions_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(9)) for _ in range(40)]
    idf = rng.random(language.WIDTH).astype(np.float32) + 1
    centres = rng.random((5, language.WIDTH)).astype(np.float32)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    model = language.Model(idf, centres, np.array([0, 0, 1, 1, 2]), np.full(5, 0.2),
                           ["a", "b", "c"])
    got = language.nearest(model, texts)
    for i, text in enumerate(texts):
        c = counted_by_hand(text).astype(np.float64)
        v = np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0) * idf
        cosine = [float(v @ k / np.linalg.norm(v)) for k in centres.astype(np.float64)]
        best = int(np.argmax(cosine))
        assert got["lang_pred"][i] == "aabbc"[best]
        assert abs(got["similarity"][i] - cosine[best]) < 1e-5
        by_name = [max(cosine[:2]), max(cosine[2:4]), cosine[4]]
        odds = sum(np.exp(10 * (x - max(by_name))) for x in by_name)
        assert abs(got["score"][i] - 1 / odds) < 1e-4
        assert got["rejected"][i] == (cosine[best] < 0.2)


def test_clusters_cover_two_scripts_of_one_language():
    rng = np.random.default_rng(4)
    x = np.abs(rng.standard_normal((60, 30))).astype(np.float32) * 0.05
    x[:30, 0] += 1
    x[30:, 1] += 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres, near = language.cluster(x, 2)
    assert len(centres) == 2 and near[:, 1].min() > 0.8
    assert len(set(near[:30, 0])) == len(set(near[30:, 0])) == 1
    assert len(language.cluster(np.repeat(x[:1], 5, axis=0), 4)[0]) == 1


def test_far_texts_are_rejected_but_named(spark):
    rows = [(i, f"the cat and the dog {i * 7919} went over the hill", "en", "k", "s", 1)
            for i in range(40)]
    rows += [(100 + i, f"le chat et le chien {i} sont dans la maison", "fr", "k", "s", 1)
             for i in range(40)]
    rows += [(900, "жщш ъыь эюя", None, "k", "s", 1)]
    got = {r["doc_id"]: r for r in language.languages(spark, tongues(spark, rows)).collect()}
    assert got[900]["rejected"] and got[900]["lang_pred"] in ("en", "fr")
    assert not got[3]["rejected"] and got[3]["lang_pred"] == "en"
    assert got[103]["lang_pred"] == "fr"


def test_members_that_are_all_alike_are_not_rejected_by_rounding():
    x = np.abs(np.random.default_rng(5).standard_normal(language.WIDTH)).astype(np.float32)
    x /= np.linalg.norm(x)
    group = pd.DataFrame({"lang": "en", "key": range(30), "vector": [x.tobytes()] * 30})
    limit = language._cluster_language(6)(group)
    centre = np.frombuffer(limit["centroid"][0], np.float32)
    assert len(limit) == 1 and limit["low"][0] < float(x @ centre) - 2e-6


def test_nulls_repeats_long_texts_and_empty_tables(spark):
    rows = [(None, None, None, "k", "s", 1), (1, "", "en", "k", "s", 1), (2, "12 34 !", "en", "k", "s", 1),
            (3, "the house and the garden", "en", "k", "s", 1),
            (3, "the house and the garden", "en", "k", "s", 1),
            (4, "das haus und der garten", "de", "k", "s", 1), (None, "das haus", "de", "k", "s", 1),
            (6, "das haus und der garten " * 60_000, None, "k", "s", 1),
            (7, "x" * 2_500_000, None, "k", "s", 1)]
    got = language.languages(spark, tongues(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by_id[1]["lang_pred"] == by_id[2]["lang_pred"] == "und" and by_id[2]["score"] == 0
    assert by_id[6]["lang_pred"] == "de" and by_id[3]["lang_pred"] == "en"
    assert all(not r["held_out"] for r in got if r["doc_id"] is None)
    assert len({tuple(r) for r in got if r["doc_id"] == 3}) == 1
    none = documents(spark, [(1, "words without a language")]).withColumn(
        "lang", language.F.lit(None).cast("string"))
    assert [r["lang_pred"] for r in language.languages(spark, none).collect()] == ["und"]
    assert language.languages(spark, none.limit(0)).count() == 0


def test_a_long_text_counts_as_its_pieces(monkeypatch):
    text = "one two three " * 50
    whole = language.gram_counts([text])[0]
    monkeypatch.setattr(language, "PIECE", 64)
    assert (language.gram_counts([text, "a b"])[0][0] == whole[0]).all()
