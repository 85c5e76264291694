"""Text columns: folding, normalising, masking and tokens. All JVM-side expressions."""

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of the Latin-1 and Latin Extended-A blocks that carry an accent, with their base letter.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
_BASE = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"

# The Hangul syllables and the first signs of their leads, vowels and tails: syllables are numbered
# by these, so they are taken apart by arithmetic.
_SYLLABLES = ("\uac00", "\ud7a3")
_LEAD, _VOWEL, _TAIL = 0x1100, 0x1161, 0x11A7
_VOWELS, _TAILS = 21, 28
# The planes of Unicode that hold letters end here.
_LETTERS_END = 0x40000

#: Three or more letters, Latin or the Indic blocks.
TOKEN = r"[a-zA-Zऀ-෿]{3,}"


def fold(text: Column) -> Column:
    """Lower-case, anything but a-z and 0-9 becomes one space, trimmed.

    ``lower`` stands in for full case folding; the two differ only for a few letters such as ß.
    """
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def evidence_norm(text: Column) -> Column:
    """`fold` that also keeps the Indic letters."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9ऀ-෿]+", " "))


def compact(text: Column) -> Column:
    """Lower-case letters and digits only, no separators."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def normalise_term(text: Column) -> Column:
    """Fold Latin text: lower case, Latin accents, punctuation, spaces.

    Other accents and letters such as ß stay as they are; terms are matched by `fold_term`.
    """
    plain = F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _BASE), r"\p{M}+", "")
    spaced = F.regexp_replace(plain, r"[^\p{L}\p{N}_\s]+", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


@cache
def _folding() -> tuple[str, str, str, tuple[str, ...]]:
    """How each character folds, made from the Unicode data of this Python.

    Folding is full case folding, compatibility decomposition, and removal of combining marks; all
    three act on single characters, so a table of characters is enough. Returns the characters that
    become one other or vanish, what they become (as long as it lasts, the others vanish), the
    characters that become several, and what these become. Hangul syllables are left out.
    """
    single, gone, several = [], [], []
    for number in range(1, _LETTERS_END):
        char = chr(number)
        if (char.casefold() == char and not unicodedata.decomposition(char)
                and not unicodedata.combining(char)) or _SYLLABLES[0] <= char <= _SYLLABLES[1]:
            continue
        folded = "".join(c for c in unicodedata.normalize("NFKD", char.casefold())
                         if not unicodedata.combining(c))
        if not folded:
            gone.append(char)
        elif len(folded) > 1:
            several.append((char, folded))
        elif folded != char:
            single.append((char, folded))
    return ("".join(c for c, _ in single) + "".join(gone), "".join(f for _, f in single),
            "".join(c for c, _ in several), tuple(f for _, f in several))


def _jamo(char: Column) -> Column:
    """A Hangul syllable as its lead, vowel and tail."""
    number = F.ascii(char) - ord(_SYLLABLES[0])

    def sign(first: int, count: int, index: Column) -> Column:
        return F.substring(F.lit("".join(chr(first + i) for i in range(count))), index + 1, F.lit(1))

    tail = F.pmod(number, F.lit(_TAILS)).cast("int")
    rest = F.floor(number / _TAILS)
    return F.concat(
        sign(_LEAD, 19, F.floor(rest / _VOWELS).cast("int")),
        sign(_VOWEL, _VOWELS, F.pmod(rest, F.lit(_VOWELS)).cast("int")),
        F.when(tail > 0, sign(_TAIL, _TAILS, tail)).otherwise(F.lit("")))


def fold_term(text: Column) -> Column:
    """Fold a text for matching: case, accents and compatibility forms of every script,
    punctuation, spaces. Null stays null.

    Characters with one counterpart go through a translation table. Of the others (ligatures,
    squared words, Hangul syllables), those that a text holds are found, and each is replaced by
    its parts wherever it stands; no part holds such a character.
    """
    chars, to, wide, parts = _folding()
    plain = F.translate(text, chars, to)
    is_syllable = lambda c: c.between(*_SYLLABLES)
    several = F.split(F.lit("\n".join(parts)), "\n")

    def foreign(char):
        # Most characters come before the first of these and are not looked up.
        return (char >= min(wide)) & (is_syllable(char) | (F.translate(char, wide, "") == ""))

    def apart(char):
        return F.when(is_syllable(char), _jamo(char)).otherwise(
            F.get(several, F.instr(F.lit(wide), char) - 1))

    holds = plain.rlike(f"[{_SYLLABLES[0]}-{_SYLLABLES[1]}]") | (
        F.length(F.translate(plain, wide, "")) < F.length(plain))
    found = F.filter(F.array_distinct(F.split(plain, "")), foreign)
    whole = F.when(holds, F.aggregate(
        found, plain, lambda t, c: F.replace(t, c, apart(c)))).otherwise(plain)
    return F.trim(F.regexp_replace(whole, r"[^\p{L}\p{N}_]+", " "))


def mask_identifier(text: Column) -> Column:
    """Last four characters behind a fixed mask; null for a null or empty identifier."""
    return F.when(F.length(text) > 0, F.concat(F.lit("**** **** "), F.right(text, F.lit(4))))


def tokens(text: Column) -> Column:
    """Distinct lower-cased tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))


def contains_words(haystack: Column, needle: str) -> Column:
    """True when the folded haystack holds the needle between word edges."""
    return F.concat(F.lit(" "), haystack, F.lit(" ")).contains(f" {needle} ")


def strip_chars(text: Column, chars: str) -> Column:
    """Remove any of `chars` from both ends."""
    return F.trim(text, F.lit(chars))


def find(text: Column, needle: Column) -> Column:
    """Zero-based position of the needle, ignoring case; -1 when absent."""
    return F.position(F.lower(needle), F.lower(text)) - 1


def slice_ignoring_case(text: Column, needle: Column) -> Column:
    """The part of `text` that equals the needle when case is ignored, in its own casing."""
    at = find(text, needle)
    return F.when(at >= 0, F.substring(text, at + 1, F.length(needle))).otherwise(needle)
