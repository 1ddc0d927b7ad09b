"""Problem 4: text that was decoded with the wrong character encoding.

Round trips: a garbled line is encoded again under an encoding it may have been read with and strictly decoded as the
intended one, layer by layer; a layer is accepted when the garbling cost of the line drops.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import texts_of

# (read as, intended).  Fixed values.
_UTF8 = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1254", "iso8859_2", "iso8859_15", "koi8_r", "cp866", "cp852", "cp1253", "cp1257"]
_PAIRS = [
    ("cp1252", "cp1250"), ("latin-1", "iso8859_2"), ("cp1252", "iso8859_2"), ("cp1252", "cp1254"), ("latin-1", "iso8859_9"), ("cp1252", "cp1251"), ("latin-1", "cp1251"),
    ("cp1252", "koi8_r"), ("latin-1", "koi8_r"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("koi8_r", "cp866"), ("cp866", "koi8_r"),
    ("cp1252", "cp866"), ("latin-1", "iso8859_5"), ("cp1251", "iso8859_5"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp437"),
    ("cp1252", "cp850"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("cp1250", "iso8859_2"), ("iso8859_2", "cp1250"), ("cp1251", "cp1250"), ("cp437", "cp1250"), ("cp1252", "cp852"),
    ("cp437", "cp852"), ("cp1251", "cp1254"), ("cp1250", "cp1254"), ("mac_roman", "cp1250"), ("mac_roman", "cp1254"), ("mac_roman", "cp1251"), ("cp437", "cp866"), ("cp437", "cp1251"),
    ("cp1252", "cp932"), ("latin-1", "cp932"), ("cp1252", "gb2312"), ("latin-1", "gb2312"), ("cp1252", "euc_jp"), ("latin-1", "euc_jp"), ("cp1252", "big5"), ("latin-1", "big5"),
    ("cp437", "cp932"), ("mac_roman", "cp932"), ("cp1251", "cp932"), ("cp437", "gb2312"), ("mac_roman", "gb2312"), ("cp1251", "gb2312"), ("cp1252", "cp1253"), ("latin-1", "iso8859_7"),
]
_ASIAN = {"cp932", "gb2312", "euc_jp", "big5"}
_MARKS = tuple(dict.fromkeys("﻿".encode("utf-8").decode(e, "replace") for e in _UTF8 if "�" not in "﻿".encode("utf-8").decode(e, "replace"))) + ("ÿþ", "þÿ")

#: Letters of living Latin-script languages that are frequent in them; all others cost more.
_USUAL = set("áàâäãåæçéèêëíìîïñóòôöõøœúùûüßąćęłńśźżğışİčďěňřšťůžőűăâîșțÁÀÂÄÃÅÆÇÉÈÊËÍÎÏÑÓÔÖÕØŒÚÙÛÜĄĆĘŁŃŚŹŻĞŞČĎĚŇŘŠŤŮŽÖ")
_CYRILLIC = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
_CYRILLIC_COST = {c: 0.02 + 0.02 * i for i, c in enumerate(_CYRILLIC)}


@lru_cache(maxsize=65536)
def _kind(c: str) -> tuple[str, float]:
    """Script or class of a character, and its own cost."""
    o = ord(c)
    if o < 128:
        return ("a" if c.isalpha() else "d" if c.isdigit() else " " if c.isspace() else "."), 0.0
    if c == "�":
        return "!", 6.0
    if o < 160:
        return "!", 4.0
    if c in "   ﻿​":
        return " ", 0.0
    if c == "­":
        return "s", 1.5
    if 0x400 <= o < 0x530:
        low = c.lower()
        return ("C" if c != low else "c"), _CYRILLIC_COST.get(low, 1.5) + (0.15 if c != low else 0.0)
    if 0x370 <= o < 0x400:
        return "g", 0.3
    if 0x3040 <= o < 0x3100:
        return "j", 0.05
    if 0x3000 <= o < 0x3040 or 0xFF00 <= o < 0xFF61:
        return "p", 0.1
    if 0xFF61 <= o < 0xFFA0:
        return "j", 1.5
    if 0x4E00 <= o < 0xA000:
        try:
            level = c.encode("gb2312")[0]
            return "h", 0.1 if level < 0xD8 else 0.9
        except UnicodeEncodeError:
            pass
        try:
            return "h", 0.2 if c.encode("shift_jis")[0] < 0x98 else 1.2
        except UnicodeEncodeError:
            return "h", 2.0
    if 0xAC00 <= o < 0xD7A4:
        return "h", 0.4
    if 0xE000 <= o < 0xF900:
        return "!", 5.0
    cat = unicodedata.category(c)
    if cat[0] == "L" and c not in "ªº":
        upper = c != c.lower()
        cost = 0.1 if c in _USUAL else 1.2
        return ("L" if upper else "l"), cost
    if c in "‘’“”–—…•«»":
        return "q", 0.15
    if 0x2500 <= o < 0x25A0:
        return "b", 0.2
    return "s", 0.3


#: What stands in no correct word: a capital with an accent after two small letters, a symbol or a Greek letter between the letters of a Latin word of four or more.
_IMPOSSIBLE = re.compile("[a-z]{2}[\u00c0-\u00d6\u00d8-\u00de](?![A-Z])|(?=[^\x00-\x7f]?(?:[A-Za-z][^\x00-\x7f]?){4})[A-Za-z][A-Za-z]*[\u207f\u00b9\u00bc-\u00bf\u00a1-\u00a3\u00a5\u00a6\u00ac\u00af\u00b6\u00b8\u00a8\u00f7\u221a\u2248\u2261\u2264\u2265\u221e\u2229\u2320\u2321\u2500-\u259f\u20a7\u0192\u03b1\u03c0\u03c4\u03b4\u03c6\u03b5\u03c3\u0398\u03a3\u03a6\u03a9][a-z]")
_CLITIC = re.compile("[A-Za-z][íÆÕ´](?:t|d|s|ll|re|ve|m)\\b")
_WORD = re.compile(r"\S+")


@lru_cache(maxsize=65536)
def _word_cost(w: str) -> float:
    kinds = [_kind(c) for c in w]
    total = sum(k[1] for k in kinds) + (1.0 if _IMPOSSIBLE.search(w) else 0.0)
    seq = "".join(k[0] for k in kinds)
    # signs of comparison stand between short names
    named = seq.count("a") < 4 and not set(seq) - set("ad.s")
    n = len(seq)
    letters = "aLlCcgjh"
    for i, k in enumerate(seq):
        left, right = seq[i - 1] if i else " ", seq[i + 1] if i + 1 < n else " "
        if k in "sb!":
            if named and w[i] in "≤≥≠≈±×÷²³→←⇒∈":
                continue
            # a symbol that touches letters does not stand in a word
            total += (1.5 if left in letters else 0.0) + (1.5 if right in letters and k != "s" or right in letters and left in letters else 0.0)
            if k == "b" and (left in "sql" or right in "sql"):
                total += 1.0
        elif k == "q":
            if left in "sbL" or right in "sb" or left == "q" and right in letters:
                total += 1.0
            if left in "l" and right not in " ." and w[i] != "’":
                total += 0.7
        elif k in "Ll":
            if left in "al" and k == "L":
                total += 1.5
            if left in "sqb" or right in "sqb" and w[i + 1] not in "’”…–—»":
                total += 0.8
            if left in "Ccg" or right in "Ccg":
                total += 2.0
        elif k == "C":
            if left == "c":
                total += 1.5
        elif k in "cg":
            if left == "a" or right == "a":
                total += 1.0 if k == "c" else 0.3
        elif k == "h":
            if left == "a" or right == "a":
                total += 0.8
    letters_only = [c for c in w if c.isalpha()]
    if len(letters_only) == 1 and seq.count("l") == 1 and letters_only[0] not in "àâáãéèêóôíúòöåæøıžßµ":
        total += 1.3
    core = w.strip("().,;:!?\"'*_-0123456789")
    if len(core) > 2 and core[1:].isascii() and core[0] in "ìîïôûùòñëæÆ" and core[1].isalpha():
        total += 0.8
    if len(core) > 2 and core[:-1].isascii() and core[-1] in "ìîôöñûëæ" and core[-2].isalpha():
        total += 0.8
    if _CLITIC.search(w):
        total += 1.5
    # long runs of accented letters
    for m in re.finditer(r"[Ll]{3,}", seq):
        total += 1.2 * (m.end() - m.start() - 2)
    for m in re.finditer(r"C{2,}", seq):
        total += 0.25 * (m.end() - m.start() - 1)
    return total


def cost(line: str, limit: float = 1e300) -> float:
    """Garbling cost of a line: 0 for ASCII, low for correct text in any script, high for garbled text.  Over ``limit`` it may stop."""
    total = 0.0
    for w in _WORD.findall(line):
        if not w.isascii():
            # only short words are kept for the next time
            total += _word_cost(w) if len(w) < 200 else _word_cost.__wrapped__(w)
            if total > limit:
                break
    return total


@lru_cache(maxsize=65536)
def _byte(c: str, encoding: str) -> bytes | None:
    try:
        return c.encode(encoding)
    except UnicodeEncodeError:
        return bytes([ord(c)]) if 128 <= ord(c) < 160 and encoding in ("cp1252", "cp1250", "cp1254", "cp1253", "cp1257") else None


def _encode(line: str, encoding: str) -> bytes | None:
    """The bytes of a line under an encoding; bytes that Windows encodings leave open stand for themselves."""
    try:
        return line.encode(encoding)
    except UnicodeEncodeError:
        if encoding not in ("cp1252", "cp1250", "cp1254", "cp1253", "cp1257"):
            return None
    if any(_byte(c, encoding) is None for c in set(line)):
        return None
    return b"".join(_byte(c, encoding) for c in line)  # type: ignore[misc]


def _dense(line: str, now: float) -> bool:
    """Correct text costs under 0.3 for each character that is not ASCII, in any script."""
    return now >= 0.3 * (len(line) - len(line.encode("ascii", "ignore")))


_SPACED = ("cp1252", "latin-1", "cp1251", "cp1254", "cp1250")
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_BLANK = re.compile(rb"[\xc2\xc3\xc5\xd0] |[\xe2-\xef][\x80-\xbf] ")


def _utf8(line: str, encoding: str) -> str | None:
    raw = _encode(line, encoding)
    if raw is None:
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    if b" " in raw and encoding in _SPACED:
        # a no-break space, byte A0 of a letter, may have become a plain one; others of the line must bear it out
        sure = len(_SEQUENCE.findall(raw))
        new, n = _BLANK.subn(lambda m: m.group()[:-1] + b"\xa0", raw)
        if 0 < n <= sure:
            try:
                return new.decode("utf-8")
            except UnicodeDecodeError:
                pass
    return None


def _pair(line: str, read: str, meant: str) -> str | None:
    raw = _encode(line, read)
    if raw is None:
        return None
    try:
        return raw.decode(meant)
    except UnicodeDecodeError:
        return None


class _Bytes(dict):
    """Characters to the bytes of an encoding, as characters of the same number; what it lacks is FF."""

    def __init__(self, encoding: str):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, o: int) -> int:
        raw = _encode(chr(o), self.encoding) if o < 0xD800 or o > 0xDFFF else None
        self[o] = raw[0] if raw else 0xFF
        return self[o]


_TABLES = {e: _Bytes(e) for e in ("cp1252", "latin-1", "cp437", "mac_roman", "cp1251", "cp850", "cp1250")}
_CONTROL = re.compile("[\x80-\x9f]")


def _broken(line: str) -> bool:
    """Most of the non-ASCII characters are pieces of UTF-8 sequences, though the line as a whole cannot be decoded."""
    high = sum(c > "\x7f" for c in line)
    for e in _TABLES:
        raw = line.translate(_TABLES[e]).encode("latin-1")
        good = sum(len(m.group()) for m in _SEQUENCE.finditer(raw))
        if good >= 4 and good >= 0.6 * high or good == high and good >= 2:
            return True
    return False


_KANA = re.compile("[\u3041-\u30ff]")
#: A character of UTF-8 that was read byte by byte is two characters beyond ASCII at least.
_ADJACENT = re.compile("[^\x00-\x7f]{2}")


def repair_line(line: str) -> tuple[str, tuple[str, ...]]:
    """The restored line and the layers undone, outermost first; an untouched line has no layers."""
    layers: list[str] = []
    now = cost(line)
    # each layer lowers the cost, so this ends
    while not line.isascii() and now > 0:
        best, way, least = None, "", now
        for e in _UTF8 if _ADJACENT.search(line) else ():
            new = _utf8(line, e)
            if new is not None and new != line:
                c = cost(new, least)
                if c < least - 0.05:
                    best, way, least = new, f"{e}>utf-8", c
        if best is None and now >= 2.4 and _dense(line, now):
            limit = now - max(1.6, 0.5 * now)
            for read, meant in _PAIRS:
                new = _pair(line, read, meant)
                if new is None or new == line:
                    continue
                c = cost(new, limit) + (0.3 if meant in _ASIAN else 0.0) + (2.0 if meant == "gb2312" and _KANA.search(new) else 0.0)
                if c < least and c <= limit:
                    best, way, least = new, f"{read}>{meant}", c
        if best is None and now >= 1.2:
            for read in ("mac_roman", "cp437", "cp850"):
                new = _pair(line, read, "cp1252")
                # nothing but typographic marks where accented letters stood
                if new is not None and new != line and all(c.isascii() or c in "‘’“”–—…" for c in new) and cost(new) < least - 0.8:
                    best, way, least = new, f"{read}>cp1252", cost(new)
        if best is None:
            break
        line, now = best, least
        layers.append(way)
    return line, tuple(layers)


_CYRILLIC_WORD = re.compile("[\u0400-\u04ff]{3,}")
_MIXED = re.compile("[A-Za-z][\u0400-\u04ff]|[\u0400-\u04ff][A-Za-z]")
_WESTERN_PAIRS = [(read, meant) for read, meant in _PAIRS if meant not in _ASIAN]


def _high(w: str) -> int:
    return len(w) - len(w.encode("ascii", "ignore"))


def _over_lines(lines: list[str]) -> tuple[str, str] | None:
    """The legacy pair that the costly words of all lines bear out together, though each line has too few of them; or none.

    Each different word counts once; at least two must become correct words.  One is enough where Cyrillic and Latin letters mix in a
    word and no word of the text is Cyrillic, or where a word holds what stands in no correct word.
    """
    words = {w for line in lines if not line.isascii() for w in _WORD.findall(line) if not w.isascii()}
    before = {w: c for w in words if (c := _word_cost(w)) >= max(0.8, 0.3 * _high(w))}
    if not before:
        return None
    cyrillic = any(_CYRILLIC_WORD.search(w) for w in words)
    best, most = None, 0.0
    for read, meant in _WESTERN_PAIRS:
        gain, good, mixed, sure = 0.0, 0, False, False
        for w, c in before.items():
            new = _pair(w, read, meant)
            if new is None or new == w:
                continue
            after = _word_cost(new)
            if after <= 0.15 * _high(new) and any(x.isalpha() and x > "\x7f" for x in new):
                gain, good, mixed = gain + c - after, good + 1, mixed or bool(_MIXED.search(w)) and not _MIXED.search(new)
                sure = sure or bool(_IMPOSSIBLE.search(w)) and not _IMPOSSIBLE.search(new)
            else:
                gain -= max(0.0, after - c)
        if (good > 1 and gain >= 2.4 or (mixed and not cyrillic or sure) and gain >= 0.8) and gain > most:
            best, most = (read, meant), gain
    return best


def repair(text: str) -> tuple[str, bool, bool, str]:
    """(restored text, garbled, recovered, layers) of a whole text."""
    layers: dict[str, int] = {}
    garbled, lost = False, False
    lines = text.split("\n")
    rest: list[int] = []
    for i, line in enumerate(lines):
        if line.isascii():
            continue
        if i == 0:
            for mark in _MARKS:
                if line.startswith(mark):
                    garbled, line = True, line[len(mark):]
                    layers["mark"] = 1
                    break
            lines[0] = line
        new, ways = repair_line(line)
        if ways:
            garbled = True
            lines[i] = new
            for w in ways:
                layers[w] = layers.get(w, 0) + 1
        elif not line.isascii():
            rest.append(i)
        # what is still garbled after the last layer is not recovered
        if "�" in new or _CONTROL.search(new) or not new.isascii() and _suspect(new) and _broken(new):
            garbled = lost = True
    pairs = [p for p in _WESTERN_PAIRS if f"{p[0]}>{p[1]}" in layers]
    if pair := _over_lines([lines[i] for i in rest]):
        garbled = True
        pairs.append(pair)
    # what some lines bear out holds for the others
    for pair in pairs:
        way = f"{pair[0]}>{pair[1]}"
        for i in rest:
            new = _pair(lines[i], *pair)
            if new is not None and cost(new) < cost(lines[i]) - 0.5:
                lines[i] = new
                layers[way] = layers.get(way, 0) + 1
    return "\n".join(lines), garbled, garbled and not lost, " ".join(sorted(layers))


def _suspect(line: str) -> bool:
    now = cost(line)
    return now > 1.0 and _dense(line, now)


def is_garbled(text: str) -> bool:
    """Whether ``repair`` would call the text garbled; stops at the first garbled line."""
    if "\ufffd" in text or text.startswith(_MARKS):
        return True
    for line in text.split("\n"):
        if line.isascii():
            continue
        if _CONTROL.search(line) or repair_line(line)[1] or _suspect(line) and _broken(line):
            return True
    return _over_lines(text.split("\n")) is not None


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            new, garbled, whole, layers = repair(t)
            if garbled:
                rows.append((i, whole, layers, new))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string())],
            ["doc_id", "recovered", "layers", "restored"],
        )


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [i for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if is_garbled(t)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["doc_id"])


def _suspects(docs: DataFrame, doc: str, text: str) -> DataFrame:
    # texts of ASCII only cannot be garbled; they never leave the JVM
    rows = texts_of(docs, doc, text).filter("doc_id is not null and text is not null")
    return rows.filter(F.octet_length("text") > F.char_length("text"))


def find_garbled(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id) of the documents with at least one garbled line or a garbled mark at the start, each id once.

    Null ids, null, empty and ASCII texts give no rows; very long texts are judged line by line, whole; other columns are ignored.
    """
    return _suspects(docs, doc, text).mapInArrow(_ids, "doc_id long").distinct()


def repair_garbled(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, recovered, layers, restored): one row per affected document; ``recovered`` is false where characters are lost."""
    return _suspects(docs, doc, text).mapInArrow(_repaired, "doc_id long, recovered boolean, layers string, restored string")
