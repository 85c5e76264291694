"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic transducers run over a text.

*Cutting.* The vocabulary's rule that cuts text into pieces (contractions, letters, numbers, other
marks, white space, each with its blank) is a transducer of 8 states over 9 symbols, a symbol
being a character's class and what its right neighbours make of it. Its transitions are annotated
with "a piece starts here". The maps from state to state that texts can cause form a small finite
set, so a chunk of any length is one number. The maps of all chunks are composed by a parallel
prefix scan; that gives every chunk its entry state, and the chunks are then run from there.

*Merging.* Within a piece, the merges are a transducer over bytes whose transitions are annotated
with the number of tokens that are certain by then. A state is the shortest end of the piece that
can still change. After a byte, let ``a`` be the first place from which a token could reach beyond
it. Every later tokenisation then goes through one of the places from ``a`` on, and where the
tokenisations of the prefixes up to those places share a boundary, all before it is final: it is
emitted and dropped from the state. States are compiled from the vocabulary when they are first
met, and kept in a table of bounded size. Pieces are independent, so chunks of whole pieces are
run side by side, one table step for all of them at a time.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartledger.llm.common import text_or_empty

# States and symbols of the cutting transducer.
START, LETTER, NUMBER, OTHER, WHITE, BLANK, LAST1, LAST2 = range(8)
(S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_WHITE, S_BLANK_LAST, S_WHITE_LAST,
 S_BREAK) = range(9)
SYMBOLS = 9
CHUNK = 64
LANE_BYTES = 256
MAX_STATES = 200_000


def _cut_step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at this character."""
    if symbol == S_BREAK:
        return START, False
    if symbol == S_LETTER:
        if state == LAST1:
            return START, False
        if state == LAST2:
            return LAST1, False
        return LETTER, state not in (LETTER, BLANK)
    if symbol == S_NUMBER:
        return NUMBER, state not in (NUMBER, BLANK)
    if symbol in (S_OTHER, S_SHORT, S_LONG):
        if state in (OTHER, BLANK):
            return OTHER, False
        return {S_OTHER: OTHER, S_SHORT: LAST1, S_LONG: LAST2}[symbol], True
    if symbol == S_WHITE:
        return WHITE, state != WHITE
    return (BLANK if symbol == S_BLANK_LAST else START), True


NEXT = np.array([[_cut_step(s, x)[0] for x in range(SYMBOLS)] for s in range(8)], dtype=np.uint8)
STARTS = np.array([[_cut_step(s, x)[1] for x in range(SYMBOLS)] for s in range(8)], dtype=bool)


def _maps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All state maps that texts can cause: extension by a symbol, composition, image of START."""
    gens = [tuple(int(NEXT[s, x]) for s in range(8)) for x in range(SYMBOLS)]
    found = {tuple(range(8)): 0}
    order = [tuple(range(8))]
    for m in order:
        for g in gens:
            after = tuple(g[s] for s in m)
            if after not in found:
                found[after] = len(order)
                order.append(after)
    n = len(order)
    extend = np.array([[found[tuple(g[s] for s in m)] for g in gens] for m in order], np.uint16)
    compose = np.array(
        [[found[tuple(b[s] for s in a)] for b in order] for a in order], np.uint16).reshape(n, n)
    return extend, compose, np.array([m[START] for m in order], np.uint8)


EXTEND, COMPOSE, FROM_START = _maps()


def character_classes() -> np.ndarray:
    """Class of every code point: 0 other, 1 letter, 2 number, 3 white space.

    The library is asked: a character that stays in one piece with a letter before it is a letter,
    and so for numbers and others. Its Unicode tables may be of another version than any other's.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    table = np.full(0x110000, 3, dtype=np.uint8)
    for low in range(0, 0x110000, 1 << 9):
        codes = np.array([c for c in range(low, low + (1 << 9)) if not 0xD800 <= c < 0xE000])
        for value, side in ((0, "!"), (1, "a"), (2, "1")):
            if len(codes):
                starts = np.zeros(2 * len(codes), dtype=bool)
                pieces = cut("".join(side + chr(c) for c in codes.tolist()))
                starts[[span[0] for _, span in pieces]] = True
                same = ~starts[1::2]
                table[codes[same]] = value
                codes = codes[~same]
    table[0xD800:0xE000] = 0
    return table


def symbols_of(codes: np.ndarray, breaks: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The symbol of each character; ``breaks`` marks the places between texts."""
    kind = classes[codes]
    kind[breaks] = 9
    after = np.append(kind[1:], np.uint8(9))
    out = np.array([S_OTHER, S_LETTER, S_NUMBER, S_WHITE, 0, 0, 0, 0, 0, S_BREAK],
                   dtype=np.uint8)[kind]
    # The last white space before something else: a blank joins it, others stand alone.
    last = (kind == 3) & (after != 3) & (after != 9)
    out[last] = np.where(codes[last] == 0x20, S_BLANK_LAST, S_WHITE_LAST)
    mark = np.flatnonzero(codes == 0x27)
    if len(mark):
        wide = np.concatenate([codes, np.zeros(2, dtype=codes.dtype)])
        one, two = wide[mark + 1], wide[mark + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) \
            | (one == ord("l")) & (two == ord("l"))
        out[mark[short]] = S_SHORT
        out[mark[long]] = S_LONG
    return out


def piece_starts(symbols: np.ndarray) -> np.ndarray:
    """Where pieces start: chunk maps, their prefix scan, and a run from the entry states."""
    n = len(symbols)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, S_BREAK, dtype=np.uint8)
    padded[:n] = symbols
    lanes = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    maps = np.zeros(chunks, dtype=np.uint16)
    for row in lanes:
        maps = EXTEND[maps, row]
    step = 1
    while step < chunks:  # after each round, maps[i] is the composition of up to 2 * step chunks
        maps = np.concatenate([maps[:step], COMPOSE[maps[:-step], maps[step:]]])
        step *= 2
    state = np.zeros(chunks, dtype=np.uint8)
    state[1:] = FROM_START[maps[:-1]]
    flags = np.empty(lanes.shape, dtype=bool)
    for i, row in enumerate(lanes):
        flags[i] = STARTS[state, row]
        state = NEXT[state, row]
    return np.ascontiguousarray(flags.T).reshape(-1)[:n]


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary: printable bytes stand for
    themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeTransducer:
    """The merging transducer, compiled state by state."""

    def __init__(self, path: str, max_states: int = MAX_STATES):
        from tokenizers import Tokenizer

        library, to_byte = Tokenizer.from_file(path), byte_symbols()
        self.library, self.shown = library.model, {b: c for c, b in to_byte.items()}
        tokens = [bytes(to_byte[c] for c in t) for t in library.get_vocab(with_added_tokens=False)
                  if all(c in to_byte for c in t)]
        self.prefixes = {t[:i] for t in tokens for i in range(1, len(t))}
        self.special = [t.content for t in library.get_added_tokens_decoder().values()]
        self.max_states = max_states
        self.reset()

    def reset(self) -> None:
        self.ids: dict[bytes, int] = {b"": 0}
        # Of each state: its text, first open place, and boundaries of the prefixes from there on.
        self.info: list[tuple[bytes, int, list[int]]] = [(b"", 0, [1])]
        # Bytes get a column when they first occur: texts use about half of them.
        self.column = np.full(256, -1, dtype=np.int64)
        self.bytes: list[int] = []
        size = 4096
        self.next = np.full((size, 64), -1, dtype=np.int32)
        self.emit = np.zeros((size, 64), dtype=np.int16)
        self.final = np.zeros(size, dtype=np.int32)

    def add_columns(self, data: np.ndarray) -> None:
        for byte in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
            if self.column[byte] < 0:
                self.column[byte] = len(self.bytes)
                self.bytes.append(byte)
        rows, width = self.next.shape
        if len(self.bytes) > width:
            more = -(-len(self.bytes) // 64) * 64 - width
            self.next = np.hstack([self.next, np.full((rows, more), -1, np.int32)])
            self.emit = np.hstack([self.emit, np.zeros((rows, more), np.int16)])

    def merged(self, text: bytes) -> int:
        """The boundaries of the text's tokenisation, as bits."""
        bits, at = 1, 0
        for token in self.library.tokenize(text.decode("latin-1").translate(self.shown)):
            at += len(token.value)
            bits |= 1 << at
        return bits

    def compile(self, state: int, column: int) -> None:
        """Fill in one transition."""
        text, a, open_bits = self.info[state]
        word = text + bytes([self.bytes[column]])
        bits = [*open_bits, self.merged(word)]
        first = a
        while first < len(word) and word[first:] not in self.prefixes:
            first += 1
        bits = bits[first - a:]
        shared = bits[0]
        for b in bits[1:]:
            shared &= b
        shared &= (1 << (first + 1)) - 1
        final = shared.bit_length() - 1
        sure = (bits[-1] & ((1 << (final + 1)) - 1)).bit_count() - 1
        rest = word[final:]
        target = self.ids.get(rest)
        if target is None:
            target = self.ids[rest] = len(self.info)
            kept = [b >> final for b in bits]
            self.info.append((rest, first - final, kept))
            if target >= len(self.final):
                grown, width = max(4096, len(self.final) // 2), self.next.shape[1]
                self.next = np.concatenate([self.next, np.full((grown, width), -1, np.int32)])
                self.emit = np.concatenate([self.emit, np.zeros((grown, width), np.int16)])
                self.final = np.concatenate([self.final, np.zeros(grown, np.int32)])
            self.final[target] = kept[-1].bit_count() - 1
        self.next[state, column] = target
        self.emit[state, column] = sure

    def run(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens emitted at each byte; ``starts`` marks the first bytes of pieces."""
        out = np.zeros(len(data), dtype=np.int32)
        if not len(data):
            return out
        if len(self.info) > self.max_states:
            self.reset()
        self.add_columns(data)
        data, width = self.column[data], self.next.shape[1]
        places = np.flatnonzero(starts)
        wanted = np.arange(0, len(data), LANE_BYTES)
        begin = np.unique(places[np.minimum(np.searchsorted(places, wanted), len(places) - 1)])
        size = np.diff(np.append(begin, len(data)))
        longest = np.argsort(-size, kind="stable")
        begin, size = begin[longest], size[longest]
        state = np.zeros(len(begin), dtype=np.int64)
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
        for t in range(size[0]):
            n = live[t]
            at = begin[:n] + t
            fresh = np.flatnonzero(starts[at])
            if t and len(fresh):
                out[at[fresh] - 1] += self.final[state[fresh]]
                state[fresh] = 0
            key = state[:n] * width + data[at]
            to = self.next.ravel()[key]
            new = np.flatnonzero(to < 0)
            if len(new):
                for k in np.unique(key[new]).tolist():
                    self.compile(*divmod(k, width))
                to = self.next.ravel()[key]
            out[at] += self.emit.ravel()[key]
            state[:n] = to
        ends = begin + size - 1
        np.add.at(out, ends, self.final[state])
        return out


class TokenCounter:
    """Counts tokens of texts with both transducers."""

    def __init__(self, path: str):
        self.merges, self.classes = MergeTransducer(path), character_classes()

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and tokens of each text."""
        parts, owner, extra = [], [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            split = [text]
            for special in self.merges.special:
                # A special string is one token and cuts the text; longer ones would go first.
                if special in text:
                    split = [p for s in split for p in s.split(special)]
            extra[i] = len(split) - 1
            parts += split
            owner += [i] * len(split)
        codes = np.frombuffer("\0".join([*parts, ""]).encode("utf-32-le"), dtype=np.uint32)
        sizes = np.array([len(p) for p in parts])
        breaks = np.zeros(len(codes), dtype=bool)
        breaks[np.cumsum(sizes + 1) - 1] = True
        starts = piece_starts(symbols_of(codes, breaks, self.classes))
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        width[breaks] = 0
        data = np.frombuffer("".join(parts).encode("utf-8"), dtype=np.uint8)
        first = np.cumsum(width) - width
        byte_starts = np.zeros(len(data), dtype=bool)
        byte_starts[first[starts]] = True
        emitted = np.concatenate([[0], np.cumsum(self.merges.run(data, byte_starts))])
        stop = np.cumsum(np.add.reduceat(width, np.cumsum(sizes + 1) - sizes - 1))
        tokens, n_bytes = extra, np.zeros(len(texts), dtype=np.int64)
        begin = np.concatenate([[0], stop[:-1]])
        np.add.at(tokens, owner, emitted[stop] - emitted[begin])
        np.add.at(n_bytes, owner, stop - begin)
        for special in self.merges.special:
            n_bytes += np.array([t.count(special) for t in texts]) * len(special.encode())
        return n_bytes, tokens


@lru_cache(maxsize=1)
def token_counter(path: str) -> TokenCounter:
    """The counter of a Python worker: states compiled by one task serve the next."""
    return TokenCounter(path)


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _batches(path: str, limit: int, chars: int = 2_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(path)
        for batch in batches:
            keys, texts = batch["doc_id"], batch["text"].to_pylist()
            n_bytes, n_tokens, at = [], [], 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size + len(texts[upto]) <= chars):
                    size += len(texts[upto])
                    upto += 1
                b, t = counter.count(texts[at:upto])
                n_bytes.append(b)
                n_tokens.append(t)
                at = upto
            b = np.concatenate(n_bytes) if n_bytes else np.zeros(0, np.int64)
            t = np.concatenate(n_tokens) if n_tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(b), pa.array(t), pa.array(t > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    ``tokenizer`` is a byte-level BPE vocabulary file; the counts are those of its library for the
    whole text without added tokens, special strings inside a text being one token each. Null and
    empty texts have no bytes and no tokens. Null ids, repeated rows and very long texts are rows
    like others; other columns are not read. Nothing is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_batches(tokenizer, limit), SCHEMA)
