import random

import pytest
from helpers import SF_DIR, documents, table, tokenizer_path

from chartledger.llm import token_counts as C
from chartledger.llm.queries import QUERIES

BYTES = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(BYTES))


@pytest.fixture(scope="module")
def counter():
    return C.TokenCounter(tokenizer_path(BYTES))


def check(counter, library, texts):
    n_bytes, n_tokens = counter.count(texts)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert n_tokens.tolist() == want
    assert n_bytes.tolist() == [len(t.encode()) for t in texts]


def test_hard_texts(counter, library):
    check(counter, library, [
        "", " ", "  ", "\n", "a\n\n b", "don't we're 'tis I'll!'s '' 's 'r", "   x", "x   ",
        "x<|endoftext|>  y<|endoftext|>", "   <|endoftext|>   ", "日本語 テスト 🙂🙂👩‍👩‍👧    x",
        "12345 6 7²½", "\t\t\tx = 5;\r\n\r\n", "a" * 300, " " * 130 + "x", "=" * 90 + "\n",
        "\x1c\x1d \x85 ​ ﻿  y", "\0\0 a\0", "ab" * 5000])


def test_random_texts(counter, library):
    r = random.Random(3)
    parts = ["a", "b", "th", "e", " ", "  ", "\n", "'s", "'re", "'ll", "1", "22", ".", "!!", "é",
             "日", "🙂", "-", "=", "\t", " the", "ing", "<|endoftext|>", " ", "'"]
    check(counter, library, [
        "".join(r.choice(parts) for _ in range(r.randint(1, 90))) for _ in range(1500)])
    check(counter, library, ["".join(chr(r.choice([
        r.randint(0, 127), r.randint(0, 0x2FF), r.randint(0, 0xD7FF), r.randint(0xE000, 0x1FFFF)
    ])) for _ in range(40)) for _ in range(700)])


def test_every_character_is_classed_as_the_library_does(counter, library):
    step = 97
    texts = [f"a{chr(c)}{chr(c)} {chr(c)}1" for c in range(1, 0x30000, step)
             if not 0xD800 <= c < 0xE000]
    check(counter, library, texts)


def test_every_code_point_has_the_class_of_the_library():
    from tokenizers.pre_tokenizers import ByteLevel

    cut, table = ByteLevel(add_prefix_space=False).pre_tokenize_str, C.character_classes()
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            # One by one, with other neighbours than the table was made with.
            x = chr(c)
            value = next((v for v, n in ((1, "b"), (2, "7"), (0, "?"))
                          if len(cut(n + x + n)) == 1), 3)
            assert table[c] == value, hex(c)


def test_a_small_state_table_gives_the_same_counts(library):
    small = C.TokenCounter(tokenizer_path(BYTES))
    small.merges.max_states = 50
    for row in table("documents")[:30]:
        check(small, library, [row["text"] or ""])


def test_chunk_maps_compose():
    for m in range(len(C.EXTEND)):
        for x in range(C.SYMBOLS):
            assert C.EXTEND[m, x] == C.COMPOSE[m, C.EXTEND[0, x]]


def test_query_equals_the_library_over_the_whole_table(spark, library):
    rows = table("documents")
    got = {r["doc_id"]: r for r in QUERIES["op7_transducer_counts"](spark, SF_DIR).collect()}
    for row, e in zip(rows, library.encode_batch(
            [r["text"] or "" for r in rows], add_special_tokens=False), strict=True):
        told = got[row["doc_id"]]
        assert told["n_tokens"] == len(e.ids) and told["over_limit"] == (len(e.ids) > 512)
        assert told["n_bytes"] == len((row["text"] or "").encode())


def test_nulls_repeats_and_empty_table(spark):
    docs = documents(spark, [(None, None), (1, ""), (2, "hi there"), (2, "hi there")])
    rows = sorted((str(r["doc_id"]), r["n_tokens"]) for r in C.token_counts(
        docs, tokenizer_path(BYTES)).collect())
    assert rows == [("1", 0), ("2", 2), ("2", 2), ("None", 0)]
    assert C.token_counts(docs.limit(0), tokenizer_path(BYTES)).count() == 0
