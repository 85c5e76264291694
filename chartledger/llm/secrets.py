"""Secret scans through nested encodings.

A worklist starts with the text. Each layer is scanned for secrets and searched for encoded
content; every decoding that differs from what was seen becomes a layer of its own, until nothing
new appears. Every layer carries, for each of its characters, the span of the original text that
it came from, so a secret found in any depth is reported where it stands in the original.
"""

import base64
import bz2
import html
import lzma
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartledger.llm.common import text_or_empty

KINDS = ("assign", "access", "hex")

# The patterns of the three kinds. Matches with less than the stated number of
# characters are dropped.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ASSIGN_LENGTH = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LENGTH = 20
HEX = re.compile(r"[0-9a-f]{24,}")

URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
# One escape: four, eight or two hex digits, a character reference (its semicolon may lack behind a
# number), digits in braces, three octal digits.
UNICODE_ONE = re.compile(
    r"(?:\\u|%u)([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
    r"|(&#[0-9]{1,7};?|&#[xX][0-9A-Fa-f]{1,6};?|&[A-Za-z][A-Za-z0-9]{1,31};)"
    r"|\\u\{([0-9A-Fa-f]{1,6})\}|\\([0-3][0-7]{2})")
UNICODE_RUN = re.compile("(?:" + re.sub(r"\((?!\?)", "(?:", UNICODE_ONE.pattern) + ")+")
# Escape signs that were escaped again and again, each in front of an escape; undone at once.
URL_CHAIN = re.compile(r"%(?:25)+(?=[0-9A-Fa-f]{2})")
UNICODE_CHAIN = re.compile(
    r"(\\)(?:u005[cC])+(?=u[0-9A-Fa-f]{4})|(&)(?:amp;)+(?=#?[A-Za-z0-9]{2,31};)"
    r"|(&)(?:#38;)+(?=#[0-9xX])")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# Line ends, also those written as two or four characters.
LINE_END = re.compile(r"(?:\r\n?|\n|\\r\\n|\\n)[\x20\t]*")
WRITTEN_END = re.compile(r"\\[rn]")
# Lines that are base64 letters only, with what stands before the first and after the last of them.
BASE64_LINES = re.compile(
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:(?:\r\n?|\n|\\r\\n|\\n)[\x20\t]*+"
    r"[A-Za-z0-9+/_-]++)+={0,2}")
BASE64_PART = re.compile(r"[A-Za-z0-9]{16,}={0,2}")

# The shortest secret, token=abcdef, has twelve ASCII characters in a row, and what is encoded is
# longer. Bytes without such a stretch, plain or with NULs between the letters, hold none.
PLAIN = re.compile(rb"[\t\r\n\x20-\x7e]{12}")
WIDE = re.compile(rb"(?:[\t\r\n\x20-\x7e]\x00{1,3}){11}")
LETTERS_ONLY = re.compile(r"[^A-Za-z0-9+/_-]")
SIGN = re.compile(r"[+/_-]")
LETTER = np.array([chr(i) in "+/_-" or chr(i).isalnum() for i in range(128)])
# How compressed streams begin; they are searched in all decoded bytes.
PACKED = re.compile(
    rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x5d\x00\x00|\x28\xb5\x2f\xfd")
HEAD_BYTES = 6
# The same, and the bytes that follow, written as percent sequences or as escapes, each with the
# plain letters between those.
HEADS = (b"\x1f\x8b\x08", b"x\x01", b"x\x5e", b"x\x9c", b"x\xda", b"BZh", b"\xfd7zXZ\0", b"\x5d\0\0",
         b"\x28\xb5\x2f\xfd")
URL_SEQUENCE = re.compile(rb"%([0-9A-Fa-f]{2})")
FORM_SEQUENCE = re.compile(rb"%([0-9A-Fa-f]{2})|\+")
UNICODE_SEQUENCE = re.compile(UNICODE_ONE.pattern.encode())
URL_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|[!-~]")
ESCAPE_LETTERS = dict(zip("abfnrtv0", b"\a\b\f\n\r\t\v\0", strict=True))
ESCAPE_BYTE = re.compile(
    r"(?:\\x|[\\%]u00|\\U000000)([0-9A-Fa-f]{2})|&#0*([0-9]{1,3});|&#[xX]0*([0-9A-Fa-f]{1,2});"
    r"|\\([0-3][0-7]{2})|\\([abfnrtv0\\'\"/])|([\x00-\xff])")
ESCAPE_SEQUENCE = re.compile(ESCAPE_BYTE.pattern.rpartition("|")[0].encode())
NO_LETTERS = bytes(i for i in range(256) if not (chr(i) in "+/_-" or chr(i).isalnum() and i < 128))
TO_SIGNS = bytes.maketrans(b"-_", b"+/")


def _url_head(code: int) -> str:
    digits = "".join(f"[{d}{d.upper()}]" for d in f"{code:02x}")
    return f"(?:%{digits}|{re.escape(chr(code))})" if 0x21 <= code < 0x7F else f"%{digits}"


def _escape_head(code: int) -> str:
    digits = "".join(f"[{d}{d.upper()}]" for d in f"{code:02x}")
    letter = "".join(rf"|\\{c}" for c, x in ESCAPE_LETTERS.items() if x == code)
    return (rf"(?:{re.escape(chr(code))}|(?:\\x|[\\%]u00|\\U000000){digits}|&#0*{code};"
            rf"|&#[xX]0*{digits.replace('[00]', '0?', 1)};|\\{code:03o}{letter})")


URL_PACKED, ESCAPE_PACKED = (
    re.compile("|".join("".join(map(one, head)) for head in HEADS))
    for one in (_url_head, _escape_head))
# What all of those begin with, which is found faster.
URL_FIRST = re.compile(r"%(?:1[fF]|78|42|[fF][dD]|5[dD]|28)|x[%^]|B[Z%]|\]%|\(%")
ESCAPE_FIRST = re.compile(
    r"\\[xuU0-3]|%u|&#|x[\\%&^\x01\x9c\xda]|B[Z\\%&]|\x1f[\x8b\\%&]|\xfd[7\\%&]|\][\x00\\%&]"
    r"|\([\xb5\\%&]")
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")

# Contents up to this size are held in memory. Longer ones are read in pieces, as often as it takes.
HELD_BYTES = 4_000_000
# A text with a content beyond this size is marked.
UNFOLD_BYTES = 64_000_000
# So far a compressed stream inside a long content is followed before it is read on its own.
LOOK_BYTES = 1 << 16
# Matches end within so many characters once repeated spaces are one; so do open escapes.
TAIL = 64
SPACES = re.compile(r"\x20{2,}")
# Behind these no base64 letters, nor lines of them, go on.
BORDER = r"(?:[^A-Za-z0-9+/_=\s-]|[A-Za-z0-9+/_=-][\x20\t](?=\S))"
FIRST_BORDER, LAST_BORDER = re.compile(BORDER), re.compile(f".*{BORDER}", re.DOTALL)
# Compressed bytes are given to their tool in steps of this size.
STEP_BYTES = 4096
# Dictionaries of xz and lzma streams beyond this size are not unfolded; zstandard's own bound for
# its windows is the same.
LZMA_BYTES = 1 << 27
SHORTEST = 12
READABLE = b"\t\r\n" + bytes(range(0x20, 0x7F)) + bytes(range(0xA0, 0xF5))
UNFOLD_ERRORS = (zlib.error, lzma.LZMAError, zstandard.ZstdError, OSError, EOFError, MemoryError)
ZLIB = type(zlib.decompressobj())


def own_spans(text: str) -> list[tuple[int, int, int]]:
    """The secrets of one layer: start, kind number, end."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
                  if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)
                  if len(m[0]) >= ACCESS_LENGTH]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A decoded text and where its characters come from (None: from themselves)."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text, self.start, self.end = text, start, end

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The original span of the characters a to b."""
        if self.start is None:
            return a, b
        return int(self.start[a]), int(self.end[b - 1])

    def replaced(self, runs: list[tuple[int, int, str, list[int], list[int]]]) -> "Layer":
        """This layer with runs put in place of others: (from, to, text, starts, ends)."""
        at, parts, starts, ends = 0, [], [], []
        own_start = np.arange(len(self.text)) if self.start is None else self.start
        own_end = np.arange(1, len(self.text) + 1) if self.end is None else self.end
        for a, b, text, s, e in runs:
            parts += [self.text[at:a], text]
            starts += [own_start[at:a], own_start[np.array(s, dtype=int)]]
            ends += [own_end[at:a], own_end[np.array(e, dtype=int) - 1]]
            at = b
        parts.append(self.text[at:])
        starts.append(own_start[at:])
        ends.append(own_end[at:])
        return Layer("".join(parts), np.concatenate(starts), np.concatenate(ends))


def _sizes(text: str) -> np.ndarray:
    """The number of bytes of each character of a text that was decoded with surrogateescape."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    size = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    return np.where((codes >= 0xDC80) & (codes <= 0xDCFF), 1, size)


def _unchained(layer: Layer, chain: re.Pattern, sign: Callable[[re.Match], str]) -> Layer:
    """The layer with every chain of escaped escape signs as one sign, in a single pass."""
    runs = [(m.start(), m.end(), sign(m), [m.start()], [m.end()])
            for m in chain.finditer(layer.text)]
    return layer.replaced(runs) if runs else layer


def _url(layer: Layer) -> list[Layer]:
    """The layer with all its percent sequences decoded; bytes that are no UTF-8 stay."""
    if "%" not in layer.text:
        return []
    layer = _unchained(layer, URL_CHAIN, lambda m: "%")
    runs = []
    for m in URL_RUN.finditer(layer.text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        text, starts, ends, at = [], [], [], m.start()
        for c in raw.decode("utf-8", "surrogateescape"):
            if "\udc80" <= c <= "\udcff":
                text.append(layer.text[at:at + 3])
                starts += range(at, at + 3)
                ends += range(at + 1, at + 4)
                at += 3
            else:
                text.append(c)
                starts.append(at)
                at += 3 * len(c.encode("utf-8"))
                ends.append(at)
        runs.append((m.start(), m.end(), "".join(text), starts, ends))
    return [layer.replaced(runs)] if runs else []


def _unicode(layer: Layer) -> list[Layer]:
    """The layer with all its Unicode escapes and character references decoded."""
    if "\\" not in layer.text and "&" not in layer.text and "%u" not in layer.text:
        return []
    layer = _unchained(layer, UNICODE_CHAIN, lambda m: m[1] or "&")
    runs = []
    for m in UNICODE_RUN.finditer(layer.text):
        text, starts, ends = [], [], []
        for one in UNICODE_ONE.finditer(layer.text, m.start(), m.end()):
            if one[4]:
                c = html.unescape(one[4])
                if c == one[4]:  # no name of a character
                    text += c
                    starts += range(one.start(), one.end())
                    ends += range(one.start() + 1, one.end() + 1)
                    continue
            else:
                code = int(one[6], 8) if one[6] else int(one[1] or one[2] or one[3] or one[5], 16)
                if code > 0x10FFFF:
                    c = one[0]
                elif 0xDC00 <= code < 0xE000 and text and 0xD800 <= ord(text[-1]) < 0xDC00:
                    text[-1] = chr(
                        0x10000 + ((ord(text[-1]) - 0xD800) << 10) + code - 0xDC00)
                    ends[-1] = one.end()
                    continue
                else:
                    c = chr(code)
            for x in c:
                text.append(x)
                starts.append(one.start())
                ends.append(one.end())
        runs.append((m.start(), m.end(), "".join(text), starts, ends))
    return [layer.replaced(runs)] if runs else []


def _tool(head: bytes):
    """What unfolds the compressed stream that begins so, if one does."""
    if head[:3] == b"\x1f\x8b\x08":
        return zlib.decompressobj(31)
    if head[:1] == b"x" and len(head) > 1 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj(15)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=LZMA_BYTES)
    if head[:3] == b"\x5d\0\0":
        return lzma.LZMADecompressor(lzma.FORMAT_ALONE, memlimit=LZMA_BYTES)
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj()
    return None


def _fed(tool, step: bytes) -> Iterator[bytes]:
    """What comes out for the next bytes, also where they are damaged: up to the damage."""
    if hasattr(tool, "needs_input"):
        for i in range(len(step)):
            if tool.eof:
                return
            out = tool.decompress(step[i:i + 1], STEP_BYTES)
            yield out
            while not tool.eof and not tool.needs_input:
                yield tool.decompress(b"", STEP_BYTES)
    elif isinstance(tool, ZLIB):
        spare = tool.copy()
        try:
            out = tool.decompress(step)
        except zlib.error:
            for i in range(len(step)):
                yield spare.decompress(step[i:i + 1])
        else:
            yield out
    else:
        for i in range(len(step)):
            if tool.eof:
                return
            yield tool.decompress(step[i:i + 1])


class Members:
    """The content of compressed members that follow each other, in pieces of bounded size, up to
    the first bytes that begin none or are damaged. ``bare``: the first is deflate without header.
    """

    def __init__(self, chunks: Iterable[bytes], bare: bool = False):
        self.chunks, self.bare = iter(chunks), bare
        self.used, self.whole, self.damaged, self.starved = 0, False, False, False

    def __iter__(self) -> Iterator[bytes]:
        data, bare = b"", self.bare
        while True:
            while len(data) < HEAD_BYTES and (more := next(self.chunks, None)) is not None:
                data += more
            tool = zlib.decompressobj(-15) if bare else _tool(data)
            if tool is None:
                self.starved = len(data) < HEAD_BYTES
                return
            bare, begun = False, self.used
            while not tool.eof:
                if not data:
                    data = next(self.chunks, b"")
                    if not data:
                        self.starved = True
                        return
                # Of the tools that take single bytes, no more is given than is used.
                size = STEP_BYTES if isinstance(tool, ZLIB) else 1
                step, data = data[:size], data[size:]
                try:
                    yield from _fed(tool, step)
                except UNFOLD_ERRORS:
                    self.damaged = True
                    return
                self.used += len(step)
            self.used -= len(tool.unused_data)
            data = tool.unused_data + data
            self.whole = True
            if self.used == begun:
                return


def _chunks(raw: bytes, at: int) -> Iterator[bytes]:
    for i in range(at, len(raw), STEP_BYTES):
        yield raw[i:i + STEP_BYTES]


def _held(pieces: Iterable[bytes]) -> bytes | None:
    """The pieces as one; None if they are too long for memory."""
    out, size = [], 0
    for piece in pieces:
        out.append(piece)
        size += len(piece)
        if size > HELD_BYTES:
            return None
    return b"".join(out)


def _credible(content: bytes, members: Members, head: bytes, first: bool, size: int) -> bool:
    """Whether the content comes from a compressed stream and not from bytes that begin as one by
    chance: two bytes of a zlib header, or deflate without any, are no proof. A stream that ends
    with its checksum is one, and so is what begins the bytes, or uses them up, or gives a text."""
    if len(content) < SHORTEST:
        return False
    if head and (len(head) > 2 and head != b"\x5d\0\0" or members.whole or first):
        return True
    if not head and members.whole and not members.damaged and members.used == size:
        return True
    return len(set(content)) >= 10 and 20 * len(content.translate(None, READABLE)) < len(content)


class Content:
    """Bytes that all stand at one place of the original: those of a compressed stream."""

    def __init__(self, raw: bytes, start: int, end: int):
        self.raw, self.start, self.end = raw, start, end

    def layers(self) -> list:
        n = len(self.raw)
        out = list(_texts(self.raw, np.broadcast_to(np.int64(self.start), n),
                          np.broadcast_to(np.int64(self.end), n)))
        return out + _packed(self.raw, lambda a, b: (self.start, self.end))


def _grouped(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The same bytes in pieces of about 1 MB."""
    out, size = [], 0
    for piece in pieces:
        out.append(piece)
        size += len(piece)
        if size >= 1 << 20:
            yield b"".join(out)
            out, size = [], 0
    yield b"".join(out)


def _behind(pieces: Iterable[bytes], first: int, last: int | None = None) -> Iterator[bytes]:
    """The bytes from the first to before the last."""
    at = 0
    for piece in pieces:
        if last is not None and at >= last:
            return
        if at + len(piece) > first:
            yield piece[max(0, first - at):None if last is None else last - at]
        at += len(piece)


def _letters_decoded(pieces: Iterable[bytes], k: int) -> Iterator[bytes]:
    """The bytes of the base64 letters from the k-th on."""
    rest, skip = b"", k
    for piece in pieces:
        letters = piece.translate(TO_SIGNS, NO_LETTERS)
        skipped = min(skip, len(letters))
        skip -= skipped
        rest += letters[skipped:]
        n = len(rest) - len(rest) % 4
        yield base64.b64decode(rest[:n])
        rest = rest[n:]
    if len(rest) > 1:
        yield base64.b64decode(rest + b"=" * (-len(rest) % 4))


def _substituted(pieces: Iterable[bytes], one: re.Pattern,
                 code: Callable[[re.Match], bytes]) -> Iterator[bytes]:
    """The bytes with sequences decoded; one that is open at the end of a piece waits."""
    rest = b""
    for piece in pieces:
        rest += piece
        at = max(rest.rfind(mark, -36) for mark in (b"%", b"&", b"\\"))
        at = len(rest) if at < 0 else at
        # A backslash that may be escaped waits with the one before it.
        at -= (at - len(rest[:at].rstrip(b"\\"))) % 2 if rest[at:at + 1] == b"\\" else 0
        yield one.sub(code, rest[:at])
        rest = rest[at:]
    yield one.sub(code, rest)


def _url_byte(one: re.Match) -> bytes:
    return b" " if one[0] == b"+" else bytes([int(one[1], 16)])


def _unicode_byte(one: re.Match) -> bytes:
    if one[4]:
        told = html.unescape(one[4].decode("ascii"))
        if told.encode("utf-8", "replace") == one[4]:
            return one[4]
        code = ord(told) if len(told) == 1 else 256
    else:
        code = int(one[6], 8) if one[6] else int(one[1] or one[2] or one[3] or one[5], 16)
    return bytes([code]) if code < 256 else b"?"


def _escape_byte(one: re.Match) -> bytes:
    return bytes([_escape_code(ESCAPE_BYTE.match(one[0].decode("latin-1")))])


class Stream:
    """A content too long for memory, all at one place of the original. ``again`` makes its pieces
    anew for each pass. ``form``: only its compressed parts are looked for.

    Since every secret in it has the same span, only the kinds are told. Its letters stand for
    themselves, bytes beyond ASCII for characters that no secret has.
    """

    def __init__(self, again: Callable[[], Iterable[bytes]], start: int, end: int,
                 form: bool = False):
        self.again, self.start, self.end, self.form = again, start, end, form

    def made(self, how: Callable[[Iterable[bytes]], Iterable[bytes]], form: bool = False):
        again = self.again
        return Stream(lambda: how(again()), self.start, self.end, form)

    def read(self, inside: Callable[[list], None]) -> tuple[set[int], list["Stream"], int, bytes]:
        """The kinds of its own secrets, the streams in it, its length and digest. What fits in
        memory is given to ``inside`` at once."""
        kinds, streams, size, mark = set(), [], 0, blake2b(digest_size=16)
        tail, near, url, form, escape, wide = "", b"", False, False, False, False
        window, window_at, hold, hold_at, long_from = b"", 0, "", 0, None

        def packed(last: bool) -> int:
            """Follows the compressed streams in the window; gives the first place not searched."""
            at, stop = 0, len(window) - (0 if last else LOOK_BYTES)
            while (m := PACKED.search(window, at)) and m.start() < stop:
                first = m.start()
                members = Members(_chunks(window, first))
                content = _held(members)
                at = first + (members.used if members.whole else 1)
                if content is None or members.starved and not last:
                    streams.append(self.made(
                        lambda pieces, n=window_at + first: Members(_behind(pieces, n))))
                elif _credible(content, members, m[0], window_at + first == 0, 0):
                    inside([Content(content, self.start, self.end)])
            return max(at, stop, 0)

        def runs(text: str) -> None:
            n = len(text)
            inside(_base64(Layer(text, np.broadcast_to(np.int64(self.start), n),
                                 np.broadcast_to(np.int64(self.end), n))))

        def long_run(last: int) -> None:
            for k in range(4):
                streams.append(self.made(lambda pieces, a=long_from, k=k: _letters_decoded(
                    _behind(pieces, a, last), k)))

        for piece in _grouped(self.again()):
            size += len(piece)
            mark.update(piece)
            window += piece
            if len(window) > 2 * LOOK_BYTES:
                done = packed(last=False)
                window, window_at = window[done:], window_at + done
            if self.form:
                continue
            text = piece.decode("latin-1")
            told = SPACES.sub(" ", tail + text)
            kinds.update(kind for _, kind, _ in own_spans(told))
            tail, edge = told[-TAIL:], near + piece
            url = url or b"%" in edge and bool(URL_SEQUENCE.search(edge))
            form = form or b"+" in piece
            escape = escape or any(mark in edge for mark in (b"\\", b"%u", b"&")) and bool(
                UNICODE_SEQUENCE.search(edge))
            wide = wide or b"\0" in edge and bool(WIDE.search(edge))
            near = edge[-TAIL:]
            hold += text
            if long_from is not None:
                if border := FIRST_BORDER.search(hold):
                    long_run(hold_at + border.end())
                    hold, hold_at, long_from = hold[border.end():], hold_at + border.end(), None
                else:
                    hold, hold_at = hold[-2:], hold_at + len(hold[:-2])
            if long_from is None and len(hold) > HELD_BYTES:
                if border := LAST_BORDER.match(hold):
                    runs(hold[:border.end()])
                    hold, hold_at = hold[border.end():], hold_at + border.end()
                if len(hold) > HELD_BYTES:
                    long_from = hold_at
                    hold, hold_at = hold[-2:], hold_at + len(hold[:-2])
        packed(last=True)
        if long_from is not None:
            long_run(size)
        else:
            runs(hold)
        if url:
            streams.append(self.made(lambda p: _substituted(p, URL_SEQUENCE, _url_byte)))
            if form:
                streams.append(self.made(lambda p: _substituted(p, FORM_SEQUENCE, _url_byte), True))
        if escape:
            streams.append(self.made(lambda p: _substituted(p, UNICODE_SEQUENCE, _unicode_byte)))
            streams.append(
                self.made(lambda p: _substituted(p, ESCAPE_SEQUENCE, _escape_byte), True))
        if wide:
            streams.append(self.made(lambda p: (x.replace(b"\0", b"") for x in p)))
        return kinds, streams, size, mark.digest()


def _packed(raw: bytes, place: Callable[[int, int], tuple[int, int]],
            bare: Iterable[int] = ()) -> list[Content | Stream]:
    """The contents of the compressed streams in the bytes, wherever they begin, and of deflate
    without a header at the given places. ``place`` gives the original span of the bytes a to b."""
    out, at = [], 0

    def add(first: int, head: bytes) -> Members:
        def again() -> Members:
            return Members(_chunks(raw, first), not head)
        members = again()
        content = _held(members)
        if content is None:
            out.append(Stream(again, *place(first, len(raw))))
        elif _credible(content, members, head, first == 0, len(raw) - first):
            last = first + members.used if members.whole and not members.damaged else len(raw)
            out.append(Content(content, *place(first, last)))
        return members

    while m := PACKED.search(raw, at):
        members = add(m.start(), m[0])
        at = m.start() + (members.used if members.whole else 1)
    if not out:
        for first in bare:
            add(first, b"")
    return out


def _url_code(one: re.Match) -> int:
    return int(one[1], 16) if one[1] else ord(one[0])


def _form_code(one: re.Match) -> int:
    return 0x20 if one[0] == "+" else _url_code(one)


def _escape_code(one: re.Match) -> int:
    if one[1] or one[3]:
        return int(one[1] or one[3], 16)
    if one[2]:
        return int(one[2]) & 255
    if one[4]:
        return int(one[4], 8)
    return ESCAPE_LETTERS.get(one[5], ord(one[5])) if one[5] else ord(one[6])


def _written(text: str, at: int, byte: re.Pattern, code: Callable[[re.Match], int],
             ends: list[int]) -> Iterator[bytes]:
    """The bytes that the text writes from a place on, and where each of them ends."""
    raw, size = bytearray(), 64
    for one in byte.finditer(text, at):
        if one.start() != at:
            break
        at = one.end()
        raw.append(code(one))
        ends.append(at)
        if len(raw) == size:
            yield bytes(raw)
            raw, size = bytearray(), STEP_BYTES
    yield bytes(raw)


def _written_bytes(layer: Layer) -> list[Content | Stream]:
    """The contents of compressed bytes that the layer writes as percent sequences or escapes."""
    out, text = [], layer.text
    for mark, begin, head, byte, code in (
            ("%", URL_FIRST, URL_PACKED, URL_BYTE, _url_code),
            ("+", URL_FIRST, URL_PACKED, URL_BYTE, _form_code),
            ("", ESCAPE_FIRST, ESCAPE_PACKED, ESCAPE_BYTE, _escape_code)):
        if mark not in text or mark and "%" not in text:
            continue
        done = 0
        for m in begin.finditer(text):
            if m.start() < done or not head.match(text, m.start()):
                continue
            ends, first = [], m.start()
            begun = PACKED.match(next(_written(text, first, byte, code, [])))
            if not begun:
                continue
            members = Members(_written(text, first, byte, code, ends))
            content = _held(members)
            if content is None:
                def again(first=first, byte=byte, code=code) -> Members:
                    return Members(_written(text, first, byte, code, []))
                for _ in _written(text, first, byte, code, ends := []):
                    pass
                out.append(Stream(again, *layer.source(first, ends[-1])))
            elif _credible(content, members, begun[0], False, 0):
                known = members.whole and not members.damaged
                last = ends[members.used - 1 if known else -1]
                out.append(Content(content, *layer.source(first, last)))
                done = last if known else done
    return out


def _texts(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> Iterator[Layer]:
    """The texts that bytes may stand for; bytes that are no UTF-8 become a character each."""
    if PLAIN.search(raw):
        text = raw.decode("utf-8", "surrogateescape")
        size = _sizes(text)
        last = np.cumsum(size)
        yield Layer(text, starts[last - size], ends[last - 1])
    ways = set()
    for m in WIDE.finditer(raw):
        width = 4 if raw[m.start() + 2] == 0 else 2
        # A NUL before the first letter: the high bytes come first.
        big = m.start() >= width - 1 and not any(raw[m.start() - width + 1:m.start()])
        ways.add((">" if big else "<", width, (m.start() - (width - 1 if big else 0)) % width))
    for order, width, skip in sorted(ways):
        units = np.frombuffer(raw, f"{order}u{width}", (len(raw) - skip) // width, skip)
        # Units that are no character become one each, so that all have their width.
        text = np.where(units > 0x10FFFF, 0xFFFD, units).astype("<u4").tobytes().decode(
            "utf-32-le", "surrogatepass")
        first = skip + width * np.arange(len(text))
        yield Layer(text, starts[first], ends[first + width - 1])


def _is_text(raw: bytes) -> bool:
    """Whether all of the bytes are a text without control characters."""
    try:
        return bool(raw) and not CONTROL.search(raw.decode("utf-8"))
    except UnicodeDecodeError:
        return False


class Run:
    """Base64 letters of a layer, with other characters between them taken out."""

    def __init__(self, layer: Layer, start: int, run: str):
        run = WRITTEN_END.sub("  ", run)  # its letters are none of the run's
        codes = np.frombuffer(run.encode("ascii"), np.uint8)
        self.layer = layer
        self.places = start + np.flatnonzero(LETTER[codes])
        self.end = start + len(run)
        self.letters = LETTERS_ONLY.sub("", run)
        self.behind = [m.end() for m in SIGN.finditer(self.letters)]
        self.letters = self.letters.replace("-", "+").replace("_", "/")

    def decoded(self, k: int) -> bytes:
        """The bytes of the letters from the k-th on."""
        n = len(self.letters) - k
        n -= n % 4 == 1
        return base64.b64decode(self.letters[k:k + n] + "=" * (-n % 4)) if n > 0 else b""

    def spans(self, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the n bytes of the letters from the k-th on come from."""
        at = np.arange(n)
        first, last = self.places[k + at * 8 // 6], self.places[k + (at * 8 + 7) // 6]
        if self.layer.start is None:
            return first, last + 1
        return self.layer.start[first], self.layer.end[last]


def _base64_layers(run: Run, k: int, raw: bytes) -> list:
    """The layers in the bytes of a run from its k-th letter on."""
    def place(a: int, b: int) -> tuple[int, int]:
        last = run.end if b == len(raw) else int(run.places[k + (b * 8 - 1) // 6]) + 1
        return run.layer.source(int(run.places[k + a * 8 // 6]), last)

    # Deflate without a header may begin at the first letter, or behind a sign.
    bare = [(i - k) * 3 // 4 for i in [0, *run.behind] if i >= k and (i - k) % 4 == 0]
    out = _packed(raw, place, [i for i in bare if i < len(raw)])
    if PLAIN.search(raw) or WIDE.search(raw):
        out += _texts(raw, *run.spans(k, len(raw)))
    return out


def _lines(text: str) -> Iterator[tuple[int, str, str | None]]:
    """Base64 letters over lines of any width: start, letters with the line ends, and the part of
    them that has one width, if it is not all."""
    if "\n" not in text and "\r" not in text and "\\n" not in text:
        return
    for m in BASE64_LINES.finditer(text):
        ends = list(LINE_END.finditer(m[0]))
        begin = [0, *[e.end() for e in ends]]
        end = [*[e.start() for e in ends], len(m[0])]
        width = [b - a for a, b in zip(begin, end, strict=True)]
        if len(width) == 2 and width[0] < 16 or sum(width) < 16:
            continue
        first = 0 if width[0] == width[1] else 1
        last = first + 1
        while last < len(width) and width[last] == width[first]:
            last += 1
        last += last < len(width) and width[last] < width[first]
        whole = first == 0 and last == len(width)
        yield m.start(), m[0], None if whole else m[0][begin[first]:end[last - 1]]


def _base64(layer: Layer) -> list:
    """A layer for each base64 run that decodes to text.

    A run that does not as a whole is read from each of its first four letters on, since a path, a
    name or any other letters may stand before the encoded part: one of the four has the letters
    of that part in their places, wherever it begins. Its parts between signs are tried as well,
    for spans that do not reach beyond them. Lines of letters are joined, whatever their width.
    """
    out, done = [], 0

    def read(start: int, text: str, ways: int) -> bool:
        """Adds the layers; tells whether the run is a text as a whole."""
        run = Run(layer, start, text)
        raw = run.decoded(0)
        whole = _is_text(raw)
        if ways or whole:
            for k in range(1 if whole else ways):
                out.extend(_base64_layers(run, k, run.decoded(k)))
        return whole

    joined_lines = []
    for start, text, same in _lines(layer.text):
        if read(start, text, 0):
            joined_lines.append((start, start + len(text)))
            continue
        if same is not None:
            at = start + text.index(same)
            if read(at, same, 0):
                joined_lines.append((at, at + len(same)))
        read(start, text, 4)
    joined_lines.append((len(layer.text) + 1, 0))
    for m in BASE64_RUN.finditer(layer.text):
        while joined_lines[done][1] and joined_lines[done][1] <= m.start():
            done += 1
        if joined_lines[done][0] <= m.start() or read(m.start(), m[0], 4):
            continue
        for part in BASE64_PART.finditer(m[0]):
            if part[0] != m[0]:
                read(m.start() + part.start(), part[0], 0)
    return out


def scan(text: str) -> tuple[list, list, int, bool]:
    """Own spans of the text, spans of all layers, number of layers, whether one was so long that
    it was cut in pieces, which are all read.

    Spans are (start, kind number, end) in the original, sorted.
    """
    base = own_spans(text)
    spans, streams_seen, layers, cut = set(base), set(), 0, False

    def drain(work: list) -> None:
        nonlocal layers, cut
        seen = set()
        while work:
            layer = work.pop()
            if isinstance(layer, Stream):
                layers += 1
                kinds, children, size, mark = layer.read(drain)
                cut = cut or size > UNFOLD_BYTES
                spans.update((layer.start, kind, layer.end) for kind in kinds)
                mark = (mark, layer.start, layer.end, layer.form)
                if mark not in streams_seen:
                    streams_seen.add(mark)
                    work += children
                continue
            if isinstance(layer, Content):
                children = layer.layers()
            else:
                layers += 1
                if layer.start is not None:
                    for a, kind, b in own_spans(layer.text):
                        start, end = layer.source(a, b)
                        spans.add((start, kind, end))
                children = [*_url(layer), *_unicode(layer), *_base64(layer),
                            *_written_bytes(layer)]
            for child in children:
                if isinstance(child, Layer):
                    if not child.text or child.text == getattr(layer, "text", None):
                        continue
                    content = child.text.encode("utf-8", "surrogatepass")
                    place = child.source(0, len(child.text))
                elif isinstance(child, Content):
                    content, place = child.raw, (child.start, child.end)
                else:
                    work.append(child)
                    continue
                # A content that was already seen at the same place is a cycle or a second way there.
                mark = blake2b(content, digest_size=16)
                mark.update(repr((type(child).__name__, place)).encode())
                if mark.digest() not in seen:
                    seen.add(mark.digest())
                    work.append(child)

    drain([Layer(text)])
    return sorted(base), sorted(spans), layers, cut


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
          "spans string, n_layers long, cut boolean")


def _scan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            base, spans, layers, cut = scan(text)
            counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
            rows.append((*counts, sha256(joined(base).encode()).hexdigest(), joined(spans),
                         layers, cut))
        out = pd.DataFrame(rows, columns=[
            "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "cut"])
        out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
        yield out


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of the three kinds and a digest of the spans in
    the text itself, all spans with those of decoded layers, number of layers, cut.

    Null and empty texts have no spans. Null ids and repeated rows are passed through, each row on
    its own. Spans of all depths are one set: of the same kind and place, one is listed. Other
    columns are not read. ``cut`` tells that a compressed layer unfolded beyond 64 MB, so that it
    was cut in pieces; all of them are scanned.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInPandas(_scan_batches, SCHEMA)
