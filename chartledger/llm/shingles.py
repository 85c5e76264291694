"""Word shingles of texts and their SuperMinHash signatures, in arrays."""

from hashlib import blake2b

import numpy as np

SHINGLE = 5
RANKS = 128
BANDS = 32
CACHED_WORDS = 200_000

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31, _S32 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the finaliser of splitmix64)."""
    x = (x ^ (x >> _S30)) * _MIX1
    x = (x ^ (x >> _S27)) * _MIX2
    return x ^ (x >> _S31)


_STEPS = np.arange(1, RANKS + 1, dtype=np.uint64) * _STEP
_LENGTHS = np.arange(SHINGLE + 1, dtype=np.uint64) * _STEP
_PLACES = mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, each computed once while the bounded cache holds it."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        value = self[word] = xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(text: str, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text.

    A-Z are folded and words lie between ASCII white space. Fewer words than ``size`` make one
    shingle; a text without words has none.
    """
    words = hashes.of(text.encode("utf-8", "surrogatepass").lower().split())
    n = len(words)
    if not n:
        return words
    count = max(1, n - size + 1)
    total = np.full(count, _LENGTHS[min(n, size)])
    for i in range(min(n, size)):
        total += words[i:i + count] * _PLACES[i]
    return np.unique(mixed(total))


def super_minhash(sets: list[np.ndarray], ranks: int = RANKS) -> np.ndarray:
    """SuperMinHash signatures, one row of fixed-point values per non-empty set.

    Every element draws a random permutation of the ranks and a fraction for each step of it; at
    step j it offers j + fraction to the rank that its permutation has there, and a rank keeps
    the least offer. Offers of a step are above all offers of earlier steps, so the steps are
    taken for all elements together, and a set is done (early stopping) after the first step by
    which each rank has an offer: one step for large sets, up to ``ranks`` for a single element.
    Values are 32.32 fixed-point numbers.
    """
    n = len(sets)
    out = np.full((n, ranks), np.iinfo(np.uint64).max, dtype=np.uint64)
    if not n:
        return out
    flat = out.ravel()
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    elements = np.concatenate(sets)
    order = None
    for j in range(ranks):
        draw = mixed(elements + _STEPS[j])
        pick = (np.uint64(j) + (((draw & _LOW) * np.uint64(ranks - j)) >> _S32)).astype(np.int64)
        offer = (np.uint64(j) << _S32) | (draw >> _S32)
        if j == 0:
            rank = pick
        else:
            rows = np.arange(len(elements))
            rank = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, j]
        np.minimum.at(flat, owner * ranks + rank, offer)
        open_sets = (out >> _S32 == np.uint64(0xFFFFFFFF)).any(axis=1)
        if not open_sets.any():
            break
        live = open_sets[owner]
        elements, owner = elements[live], owner[live]
        if order is None:
            # From the second step on each element carries its permutation; the first step has
            # swapped place 0 with the one it picked.
            order = np.broadcast_to(np.arange(ranks, dtype=np.uint8), (len(elements), ranks)).copy()
            order[np.arange(len(elements)), pick[live]] = 0
        else:
            order = order[live]
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band of equal width, different bands never sharing a seed."""
    n, ranks = signatures.shape
    width = ranks // bands
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (n, bands))
    parts = signatures.reshape(n, bands, width)
    for i in range(width):
        keys = mixed(keys * _PLACES[0] + parts[:, :, i])
    return keys.view(np.int64)


def fingerprint(values: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return blake2b(values.tobytes(), digest_size=16).digest()
