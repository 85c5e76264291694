import base64
import gzip
import hashlib
import re
import zlib

from helpers import SF_DIR, documents, table

from chartledger.llm import secrets
from chartledger.llm.queries import QUERIES

SECRET = "password=hunter2secret"


def spans(text):
    return secrets.joined(secrets.scan(text)[1])


def by_hand(text):
    """The base spans, found letter by letter."""
    out = []
    names = ("password", "passwd", "secret", "token", "apikey", "api_key")
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    low, at = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text), 0
    while at < len(text):
        name = next((n for n in names if low.startswith(n, at)), None)
        end = None
        if name:
            p = at + len(name)
            p += text[p:p + 1] in ("'", '"') and p < len(text)
            while text[p:p + 1] == " ":
                p += 1
            if text[p:p + 1] in (":", "=") and p < len(text):
                p += 1
                while text[p:p + 1] == " ":
                    p += 1
                p += text[p:p + 1] in ("'", '"') and p < len(text)
                q = p
                while q < len(text) and text[q] in value:
                    q += 1
                end = q if q > p else None
        if end:
            if q - p >= 6:
                out.append((at, 0, end))
            at = end
        else:
            at += 1
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text)
                if m.end() - m.start() >= least]
    return sorted(out)


def test_query_against_brute_force_over_the_whole_table(spark):
    got = {r["doc_id"]: r for r in QUERIES["op2_secret_layers"](spark, SF_DIR).collect()}
    for row in table("documents"):
        base = by_hand(row["text"] or "")
        told = got[row["doc_id"]]
        assert told["base_sha256"] == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
        assert (told["n_assign"], told["n_access"], told["n_hex"]) == tuple(
            sum(k == kind for _, k, _ in base) for kind in range(3))
        assert set(secrets.joined(base).split(",")) <= set(told["spans"].split(","))


def test_base_patterns():
    for text in ("Token: 'abc' x token=abcdef", "API_KEY=\"zzzzzz\"", "apikey : 123456",
                 "paſſword=abcdef secret==abcdefg", "AKIA" + "A" * 15, "AKIA" + "A" * 16,
                 "f" * 23, "f" * 24 + "g" + "0" * 30, "secret=abc.def token", "passwd='=='"):
        assert secrets.own_spans(text) and sorted(secrets.own_spans(text)) == by_hand(text) \
            or by_hand(text) == []


def test_nested_layers_map_to_the_original():
    inner = base64.b64encode(SECRET.encode()).decode()
    assert spans(f"x {inner} y") == f"assign:2:{2 + len(inner.rstrip('='))}"
    url = SECRET.replace("=", "%3D")
    assert spans(f"a {url} b") == f"assign:2:{2 + len(url)}"
    twice = url.replace("%", "%25")
    assert spans(twice) == f"assign:0:{len(twice)}"
    escaped = "".join(f"\\u{ord(c):04x}" for c in SECRET)
    assert spans(escaped) == f"assign:0:{len(escaped)}"
    assert spans("password&#61;hunter2secret") == "assign:0:26"
    for packed in (gzip.compress(SECRET.encode() * 3), zlib.compress(SECRET.encode() * 3)):
        run = base64.b64encode(packed).decode().rstrip("=")
        assert spans(f"z: {run}") == f"assign:3:{3 + len(run)}"
    assert spans(f"https://a.example/some/path/{inner}") == (
        f"assign:28:{28 + len(inner.rstrip('='))}")
    deep = base64.b64encode(base64.b64encode(gzip.compress(url.encode() * 2))).decode()
    assert spans(f"({deep})") == f"assign:1:{1 + len(deep.rstrip('='))}"


def test_part_of_a_base64_run_maps_to_its_letters():
    run = base64.b64encode(f"some words, {SECRET} and more".encode()).decode()
    (start, kind, end), = secrets.scan(run)[1]
    covered = base64.b64decode(run[start // 4 * 4:-(-end // 4) * 4])
    assert kind == 0 and SECRET.encode() in covered and end - start < len(run)


def test_a_cycle_ends_and_a_bomb_is_bounded():
    text = "%2525252525" * 50 + SECRET
    base, found, layers, cut = secrets.scan(text)
    assert layers < 20 and set(base) <= set(found) and not cut
    bomb = base64.b64encode(zlib.compress(b"a" * (secrets.UNFOLD_BYTES + 10))).decode()
    assert secrets.scan(bomb)[3]


def test_nulls_empty_repeated_and_long_rows(spark):
    long = "word " * 60_000 + SECRET
    docs = documents(spark, [(None, None), (1, ""), (2, SECRET), (2, SECRET), (3, long)])
    rows = secrets.secret_spans(docs).collect()
    assert len(rows) == 5
    told = {r["doc_id"]: r["spans"] for r in rows}
    assert told[None] == "" and told[1] == "" and told[2] == f"assign:0:{len(SECRET)}"
    assert told[3] == f"assign:300000:{300000 + len(SECRET)}"
    assert secrets.secret_spans(docs.limit(0)).count() == 0


def coded(raw):
    return base64.b64encode(raw).decode().rstrip("=")


def test_a_character_that_is_not_printable_loses_no_layer():
    for other in (" ", "　", "﻿", "​", "­", "\0", "\x1b"):
        run = coded(f"note{other}{SECRET}".encode())
        (start, kind, end), = secrets.scan(f"x {run}")[1]
        assert kind == 0 and 2 < start < end == 2 + len(run)
    for raw in (b"note\xff" + SECRET.encode(), SECRET.encode() + b"\xe9 more", b"\xc3" + SECRET.encode()):
        assert "assign" in spans(coded(raw))
    for code in ("utf-16", "utf-16-le", "utf-16-be", "utf-32-le"):
        run = coded(("note é " + SECRET).encode(code))
        assert len(secrets.scan(run)[1]) == 1 and "assign" in spans(run)


def test_a_percent_byte_that_is_no_utf8_stays_alone():
    full = "".join(f"%{b:02X}" for b in SECRET.encode())
    assert spans(f"%E9{full}%FF") == f"assign:3:{3 + len(full)}"
    assert spans(f"%C3%A9%E9{full}") == f"assign:9:{9 + len(full)}"


def test_encoded_parts_are_found_behind_any_letters_and_over_lines_of_any_width():
    text = "note über résumé – " * 3 + SECRET
    for prefix in ("a/", "cfg/", "x+y/", "name-", "ab_cd_e"):
        for packed in (text.encode(), gzip.compress(text.encode()), zlib.compress(text.encode())):
            assert "assign" in spans(prefix + coded(packed)), (prefix, packed)
    plain = "some words that stand before it, and more of them: " * 2 + SECRET + " and after it"
    for packed in (plain.encode(), text.encode(), gzip.compress(plain.encode())):
        run = coded(packed)
        for width in (12, 20, 40, 64, 76, 80, 120):
            for indent in ("", "  ", "\t"):
                for end in ("\n", "\r\n"):
                    folded = (end + indent).join(
                        run[i:i + width] for i in range(0, len(run), width))
                    assert "assign" in spans(f"key: {folded}"), (width, indent, end)
                    assert "assign" in spans(f"data{end}{indent}{folded}{end}the end")


def test_all_members_formats_and_damaged_streams_are_unfolded():
    import bz2
    import lzma
    from urllib.parse import quote, quote_plus

    import zstandard

    noise = " ".join(hashlib.sha256(bytes([i])).hexdigest()[:20] for i in range(90))
    one, two = noise.encode(), SECRET.encode()
    bare = zlib.compressobj(9, zlib.DEFLATED, -15)
    packs = [gzip.compress(one) + gzip.compress(two), zlib.compress(one) + zlib.compress(two),
             gzip.compress(one) + bz2.compress(two), bz2.compress(two), lzma.compress(two),
             lzma.compress(two, lzma.FORMAT_ALONE), zstandard.compress(two),
             zstandard.compress(one) + zstandard.compress(two),
             bare.compress(two * 3) + bare.flush(), gzip.compress(gzip.compress(two)),
             bz2.compress(lzma.compress(two))]
    for pack in packs:
        assert "assign" in spans(coded(pack)), pack
    whole = gzip.compress(two + b" " + one)
    for damaged in (whole[:-8] + bytes(8), whole[:len(whole) // 2],
                    whole[:600] + b"\xff" * 40 + whole[640:]):
        assert "assign" in spans(coded(damaged))
    for pack in packs[:8]:
        for text in ("".join(f"%{b:02x}" for b in pack), quote(pack), quote_plus(pack),
                     "".join(f"\\x{b:02x}" for b in pack), repr(pack),
                     "".join(f"\\u{b:04x}" for b in pack), "".join(f"&#{b};" for b in pack)):
            assert "assign" in spans(f"data: {text} end"), text


def test_long_contents_are_read_to_their_end_in_pieces(monkeypatch):
    import random

    monkeypatch.setattr(secrets, "HELD_BYTES", 300_000)
    draw = random.Random(1)
    words = " ".join(draw.choice(["some", "words", "of, a", "text\n"]) for _ in range(260_000))
    far = words + " "
    assert len(far) > secrets.HELD_BYTES
    letters = coded(zlib.compress(draw.randbytes(700_000) + SECRET.encode()))
    for body in (SECRET, SECRET.replace("=", "%3D"), SECRET.replace("=", "\\u003d"), coded(SECRET.encode()),
                 "password" + " " * 2_000_000 + "=hunter2secret",
                 "".join(f"%{b:02x}" for b in gzip.compress(SECRET.encode())), letters):
        run = coded(gzip.compress((far + body + "\n").encode()))
        _, found, _, cut = secrets.scan(f"z: {run}")
        assert (3, 0, 3 + len(run)) in found and not cut, body[:40]
    inner = gzip.compress(SECRET.encode())
    assert "assign" in spans(coded(zlib.compress(far.encode() + inner)))
    monkeypatch.setattr(secrets, "UNFOLD_BYTES", 3_000_000)
    bomb = coded(zlib.compress(b" " * (secrets.UNFOLD_BYTES + 10) + SECRET.encode()))
    base, found, layers, cut = secrets.scan(bomb)
    assert found == [(0, 0, len(bomb))] and cut


def test_forms_of_escapes_and_lines():
    """Each form hides the same secret; its span is that of the whole encoded stretch."""
    import base64

    secret = "password=hunter2secret"
    coded = base64.b64encode(("some words before " + secret + " and behind").encode()).decode()
    cut = [coded[i:i + 20] for i in range(0, len(coded), 20)]
    forms = {
        "braces": "".join(f"\\u{{{ord(c):x}}}" for c in secret),
        "octal": "".join(f"\\{ord(c):03o}" for c in secret),
        "no semicolon": "".join(f"&#{ord(c)}" for c in secret),
        "name": secret.replace("=", "&equals;"),
        "lone CR": "\r".join(cut), "written line ends": "\\n".join(cut),
        "written CR LF": "\\r\\n".join(cut),
        "chain of references": secret.replace("=", "&amp;amp;amp;equals;"),
        "chain of escapes": secret.replace("=", "\\u005cu005cu005cu003d"),
    }
    for name, form in forms.items():
        base, spans, _layers, _cut = secrets.scan("see: " + form + " .")
        more = set(spans) - set(base)
        assert any(kind == 0 and 5 <= a and b <= 5 + len(form) for a, kind, b in more), name
    # What is no reference stays, also beside one.
    _base, spans, _n, _cut = secrets.scan("&nosuchname; token&equals;abcdef1")
    assert (13, 0, 33) in spans


def test_long_chains_take_linear_time():
    import time

    for chain in ("%" + "25" * 500_000 + "3d", "\\" + "u005c" * 200_000 + "u003d",
                  "&" + "amp;" * 250_000 + "equals;"):
        started = time.time()
        _base, spans, _layers, _cut = secrets.scan("token" + chain + "abcdef1")
        assert time.time() - started < 20
        assert any(kind == 0 and (a, b) == (0, 5 + len(chain) + 7) for a, kind, b in spans)
