"""Small tables and brute-force versions for the tests of this folder."""

import os

from pyspark.sql import types as T

SF_DIR = "/root/testdata/sf0.001"

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # Columns of these names clash with names that operators may use inside.
    T.StructField("key", T.StringType()), T.StructField("row", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("words", T.StringType()),
])


def documents(spark, pairs, source="s"):
    """A documents table with extra columns from (doc_id, text) or (doc_id, text, source)."""
    rows = [(p[0], p[1], "en", p[2] if len(p) > 2 else source, len(p[1] or ""), "k", "r", 1, "w")
            for p in pairs]
    return spark.createDataFrame(rows, DOCS)


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()),
                  key=lambda t: tuple((x is not None, x) for x in t))


def tokenizer_path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def table(name, sf_dir=SF_DIR):
    import pyarrow.parquet as pq

    return pq.read_table(os.path.join(sf_dir, f"{name}.parquet")).to_pylist()


def near_groups_by_hand(docs):
    """doc_id -> (n_shingles, component_id), by comparing all pairs."""
    import re

    sets = {}
    for doc_id, text in docs:
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", folded)
        sets[doc_id] = ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if 3 * len(sets[a]) > 4 * len(sets[b]) or 3 * len(sets[b]) > 4 * len(sets[a]):
                continue
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def contamination_by_hand(docs, items):
    """doc_id -> (n_words, n_hit, sorted items)."""
    import re

    def words(text):
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)

    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[s:s + 10]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s:s + n])]
        out[doc_id] = (len(w), len(hit), sorted(found))
    return out
