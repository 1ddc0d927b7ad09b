"""Problem 9: text statistics of every document, and its distance from natural prose.

The distance is a Mahalanobis distance to the mean and covariance of prose in the document's language, fitted
robustly (concentration steps from the median) on a bounded sample of labelled documents; each statistic's contribution is reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import texts_of
from statloom.llm.mojibake import repair

#: Labelled documents that are used for the fit, at most (those with the least hash of their id).
SAMPLE = 6_000

# Frequent function words by language.  Fixed values.
COMMON = {
    "en": "the of and to a in is that it was for on are as with his they be at one have this from or had by but some what there we can out other were all your when up use how said an each she which do their time if will way about many then them would like so these her make him into has two more no than first been who its now my over did down only may after also not any where most well before must through until while because our could should such very those both between under without within",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei alle jede wenn dann ihre ihr",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son aux d'un cette d'une ont ses mais comme on tout nous sa fait été aussi leur bien peut ces y deux elle ou leurs si entre dû l d n qu",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está según después",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos",
    "pl": "w i z na się do nie że jest to o jak a po co tak ale za od są przez dla by być tym już tego może ma oraz jego który która które pod także lub ich czy nad bez aby jeszcze wciąż później",
    "tr": "ve bir bu da de için ile çok o gibi daha en ama olarak ne kadar sonra var ki olan her şu ya mi değil ise göre henüz sürekli yalnızca veya hiç önce",
    "ru": "и в не на я что он с как это а по но к у за из от так же для бы о все было то мы его до или если уже при пока за эта этот эти только иногда заново быстро все",
    "it": "di che è e la il un a per non in una si da le con i sono del della alla anche come più ma lo ha dei nel se al ed questo",
    "nl": "de van een het en in is dat op te zijn met voor niet aan er om ook als dan maar bij of uit nog naar heeft wordt",
}
_LANGUAGES = [*COMMON, "cjk"]
_OF: dict[str, list[int]] = {}
for _n, _words in enumerate(COMMON.values()):
    for _w in set(_words.split()):
        _OF.setdefault(_w, []).append(_n)
_CJK_COMMON = set("的了不是在个这有和就都上也到说要去会着没看好自己那能之与及并已开始每次の は を が に で と も た し て い る な から まで だけ".replace(" ", ""))

_CODE = frozenset("{}()[]<>=;|\\/$#@*&^~`+_%")
_END = ".!?:;,…。！？，；：)\"”’»"
_START = re.compile(r"[.!?…][\"')»”’]*\s+[\"'“«(]*([^\W\d_])")
_ITEM = re.compile(r"(?:[-*+•o]|\[[ xX]?\]|\(?\d{1,3}[.)]|[a-z][.)])\s")
_COMMENT = re.compile(r"(?:#(?!#*\s\S+\s*$)|//|--|\*|%|;|/\*|<!--|\"\"\"|')\s*\S")
# Mean word length and share of common words of ordinary prose, and common words at most so rare in a running line, by language.
_LENGTH = [4.4, 5.8, 5.1, 5.1, 4.9, 6.0, 6.3, 5.7, 5.2, 5.1, 1.0]
_SHARE = [0.48, 0.33, 0.33, 0.38, 0.36, 0.22, 0.15, 0.28, 0.38, 0.4, 0.3]
_RUNNING = [6, 8, 8, 8, 8, 12, 14, 10, 8, 8, 8]

STATISTICS = ["log_words", "mean_word_length", "symbol_ratio", "line_end_punctuation", "common_words", "digit_ratio", "code_ratio", "odd_pieces", "log_words_per_line", "repeated_lines", "prose_lines", "log_words_per_stop", "small_starts"]


# Marks of characters, as bits.
_LETTER, _SIGN, _WORDY, _DIGIT, _BLANK, _ASCII_DIGIT, _CODED, _STRANGE, _TRAILING, _LEADING, _ENDING, _STOPPING, _EAST_STOP, _CLOSING, _LOWER, _UPPER = (1 << k for k in range(16))
#: Characters beyond are letters of rare scripts.
_PLANES = 0x20000
#: Characters and texts that are measured together; a longer text is counted in parts.
GROUP, GROUP_TEXTS = 1_000_000, 4_000
#: Longest common word.
_LONGEST = 24


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """(marks, lower-case form) of every character."""
    marks, lower = np.zeros(_PLANES, np.int32), np.arange(_PLANES, dtype=np.uint64)
    for o in range(_PLANES):
        c = chr(o)
        if c.isalnum():
            marks[o] |= _WORDY | (_DIGIT if c.isdecimal() else _LETTER)
            if len(low := c.lower()) == 1:
                lower[o] = ord(low)
        elif c.isspace():
            marks[o] |= _BLANK
    for chars, mark in (
        ("_", _WORDY), ("0123456789", _ASCII_DIGIT), (_CODE, _CODED), ("_{}[]<>=|\\/$@*&^~`+%#", _STRANGE), (".,;:!?)\"'", _TRAILING), ("(\"'", _LEADING), (_END, _ENDING),
        (".!?…", _STOPPING), ("。！？", _EAST_STOP), ("\"')»”’", _CLOSING), ("abcdefghijklmnopqrstuvwxyz", _LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER),
    ):
        marks[[ord(c) for c in chars]] |= mark
    marks[0x3040:0x3100] |= _SIGN
    marks[0x4E00:0xA000] |= _SIGN
    marks[-1] = _LETTER | _WORDY
    return marks, lower


_POWERS = np.random.default_rng(9).integers(1, 2**63, _LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def _common_words() -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, by hash one column per language) of the common words; those of Chinese and Japanese have no column."""
    words = [*_OF, *(w for w in sorted(_CJK_COMMON) if w not in _OF)]
    h = np.array([sum(ord(c) * int(p) for c, p in zip(w, _POWERS)) % 2**64 for w in words], np.uint64)
    order = np.argsort(h)
    languages = np.zeros((len(words), len(_LANGUAGES)), np.int64)
    for n, w in enumerate(words):
        languages[n, _OF.get(w, [])] = 1
    return h[order], languages[order]


def _shifted(x: np.ndarray) -> np.ndarray:
    """What the character before has."""
    return np.concatenate(([False], x[:-1]))


def _following(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x[1:], [False]))


class _Counts:
    """What is counted in the characters of texts: per line and per text."""

    PER_LINE, PER_TEXT = ("counts", "commons", "owns", "codes", "sizes", "spaces"), ("hits", "cjk", "pieces", "odd", "dense", "digits", "ended", "stops")

    def __init__(self, **counts: np.ndarray):
        self.__dict__.update(counts)

    @staticmethod
    def of_one(parts: list[_Counts]) -> _Counts:
        """The counts of a text from those of its parts."""
        return _Counts(**{k: np.concatenate([getattr(p, k) for p in parts]) for k in _Counts.PER_LINE}, **{k: sum(getattr(p, k) for p in parts) for k in _Counts.PER_TEXT})


def _count(docs: list[list[str]]) -> _Counts:
    """Counts of texts, each given by its lines without blanks around; one line at least."""
    marks_of, lower_of = _characters()
    lines = [x for d in docs for x in d]
    cp = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = marks_of[np.minimum(cp, _PLANES - 1)]
    has = lambda m: (marks & m) != 0
    new_line = cp == 10
    line_end = np.flatnonzero(new_line)
    line_first = np.concatenate(([0], line_end[:-1] + 1))
    line_of = np.cumsum(new_line, dtype=np.int32) - new_line
    n_lines = np.array([len(d) for d in docs])
    doc_first = np.cumsum(n_lines) - n_lines
    doc_of = np.repeat(np.arange(len(docs)), n_lines)
    per_line = lambda x: np.add.reduceat(x, line_first, dtype=np.int64)
    per_doc = lambda x: np.add.reduceat(x, doc_first, dtype=np.int64)

    # words: runs of letters, also over an apostrophe; Chinese and Japanese signs are words of their own unless a word of letters runs into them
    letter = has(_LETTER)
    inside = letter | ((cp == 39) | (cp == 0x2019)) & _shifted(letter) & _following(letter)
    plain = np.cumsum(letter & ~has(_SIGN), dtype=np.int32)
    run = inside & (plain > np.maximum.accumulate(np.where(inside, 0, plain)))
    single = letter & ~run
    begins = run & ~_shifted(run) | single
    counts, owns = per_line(begins), per_line(run | single)
    at = np.flatnonzero(run | single)
    first = np.flatnonzero(begins[at])
    length = np.diff(np.append(first, len(at)))
    offset = np.arange(len(at)) - np.repeat(first, length)
    lang_hits, n_cjk = np.zeros((len(docs), len(_LANGUAGES)), np.int64), np.zeros(len(docs), np.int64)
    commons = np.zeros(len(lines), np.int64)
    if len(first):
        own = cp[at]
        low = np.where(own < _PLANES, lower_of[np.minimum(own, _PLANES - 1)], own)
        h = np.add.reduceat(np.where(offset < _LONGEST, low * _POWERS[np.minimum(offset, _LONGEST - 1)], np.uint64(0)), first)
        known, languages = _common_words()
        k = np.minimum(np.searchsorted(known, h), len(known) - 1)
        common = (known[k] == h) & (length <= _LONGEST)
        word_line = line_of[at[first]]
        commons = np.bincount(word_line[common], minlength=len(lines))
        by_word = np.bincount(doc_of[word_line[common]] * len(known) + k[common], minlength=len(docs) * len(known)).reshape(len(docs), -1)
        lang_hits = by_word @ languages
        n_cjk = np.bincount(doc_of[word_line[(length == 1) & (own[first] >= 0x3040)]], minlength=len(docs))

    # pieces between blanks, without marks around them
    solid = ~has(_BLANK)
    piece_begins = solid & ~_shifted(solid)
    begin, end = np.flatnonzero(piece_begins), np.flatnonzero(solid & ~_following(solid))
    piece_of = np.cumsum(piece_begins, dtype=np.int32) - 1
    wordy = has(_WORDY)
    odd = np.zeros(len(begin), bool)
    odd[piece_of[has(_STRANGE | _DIGIT) | ((cp == 46) | (cp == 58)) & _shifted(wordy) & _following(wordy) | has(_UPPER) & _shifted(has(_LOWER))]] = True
    here = np.arange(len(cp), dtype=np.int32)
    weak = np.flatnonzero((cp == 41) | (cp == 59))
    odd[piece_of[weak[weak < np.maximum.reduceat(np.where(solid & ~has(_TRAILING), here, -1), begin)[piece_of[weak]]]]] = True
    weak = np.flatnonzero(cp == 40)
    odd[piece_of[weak[weak > np.minimum.reduceat(np.where(solid & ~has(_LEADING), here, len(cp)), begin)[piece_of[weak]]]]] = True
    odd &= (cp[begin] < 0x2E80) & (cp[end] < 0x2E80)
    piece_doc = doc_of[line_of[begin]]
    pieces, n_odd = np.bincount(piece_doc, minlength=len(docs)), np.bincount(piece_doc[odd], minlength=len(docs))

    return _Counts(
        counts=counts, commons=commons, owns=owns, codes=per_line(has(_CODED)), sizes=line_end - line_first, spaces=per_line(cp == 32), hits=lang_hits, cjk=n_cjk, pieces=pieces, odd=n_odd,
        dense=per_doc(per_line(solid)), digits=per_doc(per_line(has(_ASCII_DIGIT))), ended=per_doc((marks[line_end - 1] & _ENDING) != 0),
        stops=per_doc(per_line(has(_STOPPING) & _following(has(_BLANK | _CLOSING)) | has(_EAST_STOP))),
    )


def _measure(docs: list[list[str]], c: _Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistics, word count, language number) of texts from their counts."""
    lines = [x for d in docs for x in d]
    n_lines = np.array([len(d) for d in docs])
    doc_of = np.repeat(np.arange(len(docs)), n_lines)
    per_doc = lambda x: np.add.reduceat(x, np.cumsum(n_lines) - n_lines, dtype=np.int64)
    n, common, letters, code = per_doc(c.counts), per_doc(c.commons), per_doc(c.owns), per_doc(c.codes)
    lang = np.where(n > 0, np.argmax(c.hits, axis=1), 0)
    lang = np.where(c.cjk * 2 > n, len(_LANGUAGES) - 1, lang)
    # an item that ends with its line, a comment, or a line of a few words is no running text
    running = (c.sizes >= 12) & (c.counts >= 4) & (c.commons * np.array(_RUNNING)[lang[doc_of]] >= c.counts) & (c.codes * 16 <= c.sizes) & (c.owns * 10 >= 6 * (c.sizes - c.spaces))
    for k in np.flatnonzero(running).tolist():
        line = lines[k]
        last = k + 1 == len(lines) or doc_of[k + 1] != doc_of[k]
        running[k] = not (len(line) < 90 and _ITEM.match(line) and (last or _ITEM.match(lines[k + 1]))) and not _COMMENT.match(line)
    prose = per_doc(np.where(running, c.sizes, 0))
    small, repeated = np.empty(len(docs)), np.empty(len(docs))
    for k, d in enumerate(docs):
        starts = [d[0].lstrip("#*-> \"'“«(")[:1], *_START.findall("\n".join(d))]
        small[k] = sum(map(str.islower, starts)) / (len(starts) + 0.5)
        repeated[k] = 1 - len(set(d)) / len(d)
    some = np.maximum(n, 1)
    return np.column_stack([
        np.log1p(n), letters / some, np.maximum(0, c.dense - letters - c.digits) / c.dense, c.ended / n_lines, common / some, c.digits / c.dense, code / c.dense, c.odd / c.pieces,
        np.log1p(n / n_lines), repeated, prose / per_doc(c.sizes), np.log1p(n / (c.stops + 0.5)), small,
    ]), n, lang


def describe(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistics, word count, language number) of texts; all zero for a null, empty or blank one."""
    out, n, lang = np.zeros((len(texts), len(STATISTICS))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    rows: list[int] = []
    docs: list[list[str]] = []
    size = 0
    for k, t in enumerate(texts):
        lines = [x for x in map(str.strip, t.split("\n")) if x] if t else []
        if lines and len(t) > GROUP:  # type: ignore[arg-type]
            # a very long text: its lines in parts
            ends = np.cumsum([len(x) for x in lines]) // GROUP
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(lines)]
            whole = _Counts.of_one([_count([lines[a:b]]) for a, b in zip(cuts, cuts[1:])])
            out[k:k + 1], n[k:k + 1], lang[k:k + 1] = _measure([lines], whole)
        elif lines:
            rows.append(k)
            docs.append(lines)
            size += len(t)  # type: ignore[arg-type]
        if docs and (size >= GROUP or len(docs) >= GROUP_TEXTS or k + 1 == len(texts)):
            out[rows], n[rows], lang[rows] = _measure(docs, _count(docs))
            rows, docs, size = [], [], 0
    return out, n, lang


def _comparable(x: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """The statistics as the distance takes them: lengths and common words against the language's, and capped where more is no less prose-like."""
    t = x.copy()
    t[:, 0] = np.minimum(t[:, 0], 5.5)
    t[:, 1] /= np.array(_LENGTH)[lang]
    t[:, 4] = np.minimum(t[:, 4] / np.array(_SHARE)[lang], 0.8)
    t[:, 8] = np.minimum(t[:, 8], 3.0)
    t[:, 10] = np.minimum(t[:, 10], 0.9)
    return t


class Prose:
    """Location and scatter of prose, for all languages together and for each with enough labelled texts."""

    #: Labelled prose texts that count as much as the pooled fit does.
    WEIGHT = 15.0

    def __init__(self, x: np.ndarray, lang: np.ndarray, prose: np.ndarray):
        x = _comparable(x, lang)
        self.floor = np.array([0.7, 0.12, 0.02, 0.25, 0.12, 0.015, 0.02, 0.055, 0.5, 0.04, 0.11, 0.28, 0.07]) ** 2
        self.center, self.inverse = {}, {}
        good = x[prose] if prose.sum() >= 5 else np.array([[5.2, 1.0, 0.03, 0.3, 0.8, 0.005, 0.004, 0.02, 2.7, 0.0, 0.9, 2.7, 0.0]])
        mu, cov = self._robust(good)
        self.center[-1], self.inverse[-1] = mu, np.linalg.inv(cov)
        for k in range(len(_LANGUAGES)):
            own = x[prose & (lang == k)]
            w = len(own) / (len(own) + self.WEIGHT)
            if len(own) >= 3:
                m, c = self._robust(own)
                m, c = w * m + (1 - w) * mu, w * c + (1 - w) * cov
            else:
                m, c = mu, cov
            self.center[k], self.inverse[k] = m, np.linalg.inv(c + np.diag(self.floor) * 0.05)
        self.limit = 6.0
        dist = self._squares(x, lang)[0]
        if prose.sum() >= 5 and (~prose).sum() >= 5:
            # the limit with the fewest wrong labels, a wrong prose label weighing as much as all prose over all others;
            # it lies halfway between the last prose before it and the first other text after it
            cuts = np.sort(dist)
            own, other = np.sort(dist[prose]), np.sort(dist[~prose])
            wrong = 1 - np.searchsorted(own, cuts, side="right") / len(own) + np.searchsorted(other, cuts, side="right") / len(other)
            cut = cuts[int(np.argmin(wrong))]
            before, after = own[own <= cut], other[other > cut]
            if len(before) and len(after):
                self.limit = float(before[-1] + after[0]) / 2

    def _robust(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Concentration steps: mean and covariance of the nearer part, from the median on."""
        floor = np.diag(self.floor)
        keep = x
        mu = np.median(x, axis=0)
        scale = np.diag(np.maximum((1.4826 * np.median(np.abs(x - mu), axis=0)) ** 2, self.floor))
        for _ in range(12):
            z = x - mu
            dist = np.einsum("ij,jk,ik->i", z, np.linalg.inv(scale), z)
            h = max(1, int(np.ceil(0.8 * len(x))))
            keep = x[np.argsort(dist, kind="stable")[:h]]
            mu = keep.mean(axis=0)
            spread = np.cov(keep.T) if len(keep) > 1 else np.zeros_like(floor)
            # few rows cannot carry a full covariance
            a = len(keep) / (len(keep) + 2.0 * x.shape[1])
            scale = a * spread * 1.25 + (1 - a) * np.diag(np.diag(spread)) + floor
        return mu, scale

    def distance(self, x: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance, contribution of each statistic to its square)."""
        return self._squares(_comparable(x, lang), lang)

    def _squares(self, x: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = np.empty_like(x)
        for k in np.unique(lang):
            rows = lang == k
            z = x[rows] - self.center.get(int(k), self.center[-1])
            part[rows] = z * (z @ self.inverse.get(int(k), self.inverse[-1]))
        return np.sqrt(np.maximum(part.sum(axis=1), 0.0)), part


def _matrix(texts: list, readable: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The statistics of texts; with ``readable``, of what garbled texts were before they were decoded wrongly."""
    return describe([repair(t)[0].replace("\ufffd", "e") if t and not t.isascii() else t for t in texts] if readable else texts)


def _measured(batches: Iterator[pa.RecordBatch], readable: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, n, lang = _matrix(batch.column(1).to_pylist(), readable)
        cols = [batch.column(0), pa.array(n), pa.array([_LANGUAGES[k] for k in lang], pa.string()), *(pa.array(x[:, k]) for k in range(x.shape[1]))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "word_count", "language", *STATISTICS])


def _readable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _measured(batches, True)


_SCHEMA = "doc_id long, word_count long, language string, " + ", ".join(f"{s} double" for s in STATISTICS)


def text_statistics(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of the table: (doc_id, word_count, language, statistics).

    Null, empty and blank texts have zero statistics; very long texts are measured whole; null ids and repeated rows stay; other columns are ignored.
    """
    return texts_of(docs, doc, text).mapInArrow(_measured, _SCHEMA)


def fit_prose(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "text_class", sample: int = SAMPLE) -> Prose:
    """The prose model from at most ``sample`` labelled documents; a document with differing labels is left out."""
    one = labels.filter(F.col(doc).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc).cast("long").alias("doc_id"))
    one = one.agg(F.min(label).alias("label"), F.max(label).alias("other")).filter("label = other")
    picked = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = texts_of(docs, doc, text).filter("text is not null")
    rows = rows.join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")
    measured = rows.mapInArrow(_readable, _SCHEMA)
    data: pd.DataFrame = measured.join(picked, "doc_id").select("language", "label", *STATISTICS).toPandas()
    lang = np.array([_LANGUAGES.index(x) for x in data["language"]], np.int64)
    return Prose(data[STATISTICS].to_numpy(float).reshape(len(data), len(STATISTICS)), lang, (data["label"] == "prose").to_numpy(bool))


def text_quality(docs: DataFrame, model: Prose, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``text_statistics`` with the distance from prose, each statistic's contribution to its square, and whether the text is prose.

    The statistics are those of the text as it is; the distance is that of the text as it reads once wrong decoding is repaired.
    A text without words is never prose; its distance is that of its zero statistics.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            x, n, lang = _matrix(texts)
            read, tongue = x.copy(), lang.copy()
            other = [k for k, t in enumerate(texts) if t and not t.isascii()]
            if other:
                read[other], _, tongue[other] = _matrix([texts[k] for k in other], True)
            dist, part = model.distance(read, tongue)
            cols = [batch.column(0), pa.array(n), pa.array([_LANGUAGES[k] for k in lang], pa.string()), *(pa.array(x[:, k]) for k in range(x.shape[1]))]
            cols += [pa.array(dist), *(pa.array(part[:, k]) for k in range(x.shape[1])), pa.array((dist <= model.limit) & (n > 0))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "word_count", "language", *STATISTICS, "distance", *(f"{s}_part" for s in STATISTICS), "prose"])

    schema = _SCHEMA + ", distance double, " + ", ".join(f"{s}_part double" for s in STATISTICS) + ", prose boolean"
    return texts_of(docs, doc, text).mapInArrow(scored, schema)


def find_prose(docs: DataFrame, model: Prose, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id) of the documents that are mainly natural prose, each id once."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n, lang = _matrix(batch.column(1).to_pylist(), True)
            keep = (model.distance(x, lang)[0] <= model.limit) & (n > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep))], ["doc_id"])

    rows = texts_of(docs, doc, text).filter("doc_id is not null and text is not null")
    return rows.mapInArrow(found, "doc_id long").distinct()
