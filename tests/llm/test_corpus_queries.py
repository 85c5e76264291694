"""The queries that SQL can express, against their SQL; the pipeline against brute force."""

import pytest
from helpers import SF_DIR, contamination_by_hand, near_groups_by_hand, table, tokenizer_path
from oracle_check import compare, connect

import corpus_pipeline
from chartledger.llm.queries import MIX_WEIGHTS, ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    same, note, rows = compare(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name])
    assert same, note
    assert rows > 0


def test_names_cover_all_thirteen():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept; the classifier's scores are taken as given."""
    from chartledger.llm import quality

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"{k}-{name}")
        out = stage(spark, docs, SF_DIR)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        placed = docs.orderBy("_metadata.file_name", "_metadata.row_index")
        kept.append([r.asDict() for r in placed.collect()])
    rows = table("documents")
    text = {r["doc_id"]: r["text"] or "" for r in rows}

    scores = {r["doc_id"]: r["predicted"] for r in quality.quality_scores(
        spark, spark.read.parquet(f"{SF_DIR}/documents.parquet"), labels).collect()}
    ids = sorted(r["doc_id"] for r in kept[0])
    assert ids == sorted(i for i, p in scores.items() if p == 1)

    groups = near_groups_by_hand([(i, text[i]) for i in ids])
    ids = sorted(i for i in ids if groups[i][1] == i)
    assert sorted(r["doc_id"] for r in kept[1]) == ids

    hits = contamination_by_hand([(i, text[i]) for i in ids],
                                 [(r["item_id"], r["text"]) for r in table("benchmark")])
    ids = sorted(i for i in ids if not hits[i][1])
    assert sorted(r["doc_id"] for r in kept[2]) == ids

    mixed = _mixed_by_hand([r for r in rows if r["doc_id"] in set(ids)])
    assert sorted(r["doc_id"] for r in kept[3]) == sorted(mixed)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    sizes = {i: len(library.encode(text[i], add_special_tokens=False).ids) + 1 for i in set(mixed)}
    ordered = sorted(kept[4], key=lambda r: r["start"])
    at = 0
    for r in ordered:
        assert r["start"] == at and r["n_tokens"] == sizes[r["doc_id"]]
        at += r["n_tokens"]
    assert sorted(r["doc_id"] for r in ordered) == sorted(mixed)
    assert [r["doc_id"] for r in ordered] == [r["doc_id"] for r in kept[3]]


def _mixed_by_hand(rows):
    import hashlib
    import math
    from collections import Counter

    size = Counter()
    for r in rows:
        size[r["source"]] += len(r["text"] or "") + 1
    weight = {s: MIX_WEIGHTS.get(s, 1.0) for s in size}
    out = []
    for r in rows:
        rate = weight[r["source"]] / sum(weight.values()) * sum(size.values()) / size[r["source"]]
        pieces = max(1, math.ceil(rate / 8))
        for p in range(1, pieces + 1):
            digest = hashlib.md5(f"mix|{r['doc_id']}|{p}".encode()).hexdigest()
            u, mean, k = int(digest[:13], 16) / 16 ** 13, rate / pieces, 0
            q = math.exp(-mean)
            total = q
            while total <= u:
                out.append(r["doc_id"])
                k += 1
                q *= mean / k
                total += q
    return out
