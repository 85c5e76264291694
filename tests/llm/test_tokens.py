import random
import zlib

import numpy as np
import pytest
from helpers import SF_DIR, documents, table, tokenizer_path

from chartledger.llm import tokens
from chartledger.llm.queries import QUERIES

WORDS = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(WORDS))


def expected(library, texts):
    ids = [np.array([*e.ids, 1], dtype="<u4") for e in
           library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    start = np.cumsum([0, *map(len, ids)])
    return [(int(s), len(i), zlib.crc32(i.tobytes())) for s, i in zip(start, ids, strict=False)]


def test_encoder_equals_the_library(library):
    texts = ["", " ", "a.b c,d e!f", "it's DON'T we'll", "x\x1cy z\x85w", "İstanbul ΣΑΣ ﬁ",
             "é é ́x", "क़ क़ word", "<|endoftext|>a <|startoftext|>", "12.5 3,4!!",
             "日本語 テスト。 ok.", "a\tb\r\nc d", "...", "end.", "A. B! C,", "🙂.", "?." * 9]
    got = tokens.WordEncoder(tokenizer_path(WORDS), words=5).encode(texts)
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in
            library.encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_letters_and_signs_need_no_library(library):
    texts = ["wort### Maß&&& treauxier.### a_b", "x%%% Ab,,, é-"]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in
            library.encode_batch(texts, add_special_tokens=False)]
    encoder, asked = tokens.WordEncoder(tokenizer_path(WORDS)), []

    class Counting:
        def encode(self, piece, **options):
            asked.append(piece)
            return library.encode(piece, **options)

    encoder.known.library = Counting()
    assert encoder.encode(texts) == want
    assert sorted(asked) == sorted(["###", "&&&", ".###", "a_b", "%%%", ",,,", "-"])


def test_odd_pieces_equal_the_library(library):
    rng = random.Random(1)
    letters = "abZé Åß'.,!#%&*()_-<>|0123²ªſ\t\x1fñİı€ж漢"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(20_000)]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in
            library.encode_batch(texts, add_special_tokens=False)]
    got = tokens.WordEncoder(tokenizer_path(WORDS)).encode(texts)
    assert [t for t, g, w in zip(texts, got, want, strict=True) if g != w] == []


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    import zstandard

    pack, unpack = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress
    for n in (1, 7, 8, 65_536):
        ids = np.random.default_rng(n).integers(0, 2 ** 32, n, dtype=np.uint64).astype("<u4")
        planes = tokens.pack_planes(ids, kind, pack)
        assert (tokens.unpack_planes(planes, n, unpack) == ids).all()


def test_crc_join():
    a, b = b"some bytes", b"and many more" * 99
    assert tokens.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert tokens.crc32_join(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


def test_query_equals_the_library_over_the_whole_table(spark, library):
    rows = sorted(table("documents"), key=lambda r: r["doc_id"])
    want = expected(library, [r["text"] for r in rows])
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"])
           for r in QUERIES["op3_token_planes"](spark, SF_DIR).collect()}
    assert [got[r["doc_id"]] for r in rows] == want


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_documents_across_blocks_nulls_and_repeats(spark, library, tmp_path, kind):
    texts = [(None, "no id"), (1, None), (2, ""), (3, "long text " * 900), (4, "same"),
             (4, "same"), (5, "x")]
    path = str(tmp_path / kind)
    tokens.write_tokens(documents(spark, texts), tokenizer_path(WORDS), path, kind, block_ids=64)
    got = sorted((r["start"], r["n_tokens"], r["ids_crc32"], r["doc_id"])
                 for r in tokens.read_documents(spark, path).collect())
    want = expected(library, [t for _, t in texts])
    assert [g[:3] for g in got] == want
    assert [g[3] for g in got] == [i for i, _ in texts]


def test_pieces_hold_the_ids(spark, library, tmp_path):
    path = str(tmp_path / "ids")
    tokens.write_tokens(documents(spark, [(1, "some words here")]), tokenizer_path(WORDS), path)
    (row,) = tokens.read_pieces(spark, path, with_ids=True).collect()
    ids = np.frombuffer(row["ids"], dtype="<u4").tolist()
    assert ids == [*library.encode("some words here", add_special_tokens=False).ids, 1]


def test_empty_table(spark):
    docs = documents(spark, [(1, "x")]).limit(0)
    assert tokens.token_files(docs, tokenizer_path(WORDS)).count() == 0
