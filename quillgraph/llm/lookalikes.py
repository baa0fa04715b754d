"""Texts that look the same, in one form: table lookups over code-point arrays of whole Arrow batches.

Each code point is replaced by its look in canonical decomposition (a gather from an expansion table), what
can't be seen is dropped, marks are put in order, letters that look like Latin ones become those, each word
then takes the script that its other letters show, and marks are composed again. Nothing is done row by row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import codepoints
from quillgraph.operators.skew import heavy_values, lookup, watched_loads
from quillgraph.session import cut

#: Other code points that look like another one (micro sign, hyphens).
SAME = {0x00B5: "μ", 0x2010: "-", 0x2011: "-", 0x2212: "-"}
#: Kinds of compatibility decomposition that keep the look: widths, non-breaking and mathematical forms.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>")
#: Latin ligatures and Roman numerals have a <compat> decomposition into what they show.
SHOWN = (*range(0xFB00, 0xFB07), *range(0x2160, 0x2180))
#: Latin letters below this belong to spelling (dotless i, long s and the like) and stay what they are.
_PHONETIC = 0x250
#: Letters of a script this far from its first one are in use today; those beyond are historic or of few languages.
_MODERN = 0x60
#: Code points from here on have no decomposition.
_END = 0x30000
#: Code points that the tables are told of one by one. The rest are surrogates, and ideographs and Hangul syllables, which
#: are letters without case, marks or decomposition of their own.
_TOLD = (range(0x3400), range(0xA000, 0xAC00), range(0xD7A4, 0xD800), range(0xE000, 0x20000), range(0x2F800, _END))
_LINE = (0x09, 0x0A, 0x0D)
_OTHER, _LATIN = 0, 1


def _look(cp: int) -> str:
    """What `cp` shows, in canonical decomposition; empty where it shows nothing."""
    c = chr(cp)
    kind = unicodedata.category(c)
    if cp in SAME:
        return SAME[cp]
    if kind == "Zs":
        return " "
    if cp in _LINE:
        return c
    if kind in ("Cc", "Cf") and cp != 0x200D or 0xFE00 <= cp <= 0xFE0F or cp in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0):
        return ""
    form = unicodedata.decomposition(c)
    if not form:
        return c
    parts = form.split()
    if parts[0][0] == "<":
        if parts[0] not in SAME_LOOK and cp not in SHOWN:
            return c
        parts = parts[1:]
    return "".join(_look(int(x, 16)) for x in parts)


Pairs = tuple[tuple[int, int], ...]


@lru_cache(maxsize=1)
def confusables(spark: SparkSession) -> Pairs:
    """(letter, the ASCII letter that it looks like) of all cased scripts, from the Unicode confusables data of ICU.

    Spark ships ICU. Letters are of one look when ICU gives them the same skeleton and they have the same case; I and l,
    which have the same skeleton, are told apart by it. Where two letters of one script look like the same ASCII letter
    (Greek omicron and sigma), the one whose other case looks like that letter's other case is taken, else the first; the
    others stay, as they are told apart within their own script. Out are scripts without case, digits, and all signs
    but those in SAME.
    """
    icu = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeletons = lambda points: icu.getSkeleton("\n".join(map(chr, points))).split("\n")
    plain: dict[str, list[str]] = {}
    for c, form in zip(ascii_letters, skeletons(map(ord, ascii_letters)), strict=True):
        plain.setdefault(form, []).append(c)
    cased = [i for i in range(0x80, _END) if unicodedata.category(chr(i)) in ("Lu", "Ll") and not unicodedata.decomposition(chr(i))]
    found = {}
    for i, form in zip(cased, skeletons(cased), strict=True):
        script = _script(i)
        same = [c for c in plain.get(form, ()) if c.isupper() == chr(i).isupper()]
        if same and not (script == "LATIN" and i < _PHONETIC):
            found[i] = same[0]
    best: dict[tuple, int] = {}
    for i, c in sorted(found.items(), key=lambda x: (not _both_cases(x[0], x[1], found), x[0])):
        best.setdefault((i,) if _script(i) == "LATIN" else (_script(i), c), i)
    return tuple(sorted((i, ord(found[i])) for i in best.values()))


def _script(cp: int) -> str:
    """The first word of the code point's name, which is its script for letters."""
    return unicodedata.name(chr(cp), "").split(" ")[0]


def _both_cases(cp: int, looks: str, found: dict[int, str]) -> bool:
    other = chr(cp).swapcase()
    return len(other) == 1 and found.get(ord(other)) == looks.swapcase()


@lru_cache(maxsize=2)
def _tables(pairs: Pairs) -> dict:
    """Lookup tables by code point, built by rule from the Unicode data of the running Python and the confusables."""
    own = [i for r in _TOLD for i in r]
    looks = {i: x for i in own if (x := _look(i)) != chr(i)}
    size = np.ones(_END, np.int64)
    size[list(looks)] = [len(x) for x in looks.values()]
    start = np.r_[0, np.cumsum(size)[:-1]]
    flat = np.zeros(int(size.sum()), np.uint32)
    flat[start[size == 1]] = np.flatnonzero(size == 1)
    for i, x in looks.items():
        flat[start[i] : start[i] + len(x)] = [ord(c) for c in x]
    ccc, word, lower = np.zeros(_END, np.uint8), np.ones(_END, bool), np.zeros(_END, bool)
    category = {i: unicodedata.category(chr(i)) for i in own}
    ccc[own] = [unicodedata.combining(chr(i)) for i in own]
    word[own] = [x[0] in "LNM" for x in category.values()]
    lower[own] = [x == "Ll" for x in category.values()]
    latin, script = np.arange(_END, dtype=np.uint32), np.zeros(_END, np.uint8)
    number = {"LATIN": _LATIN}
    for i, _ in pairs:
        number.setdefault(_script(i), len(number) + 1)
    for i in own:
        if category[i][0] == "L":
            script[i] = number.get(_script(i), _OTHER)
    back, shared, modern, firm = {}, {}, {}, {}
    looks_of = {i: chr(c) for i, c in pairs}
    for i, looks_like in pairs:  # in the order of code points
        latin[i] = looks_like
        if (which := number[_script(i)]) != _LATIN:
            if which not in back:
                back[which], (shared[which], modern[which], firm[which]) = np.arange(_END, dtype=np.uint32), np.zeros((3, _END), bool)
                first = np.flatnonzero(script == which)[0]
            back[which][looks_like] = i
            shared[which][looks_like] = True
            modern[which][looks_like] = i < first + _MODERN
            firm[which][looks_like] = i < first + _MODERN and _both_cases(i, chr(looks_like), looks_of)
    composed = {}
    for i in own:
        form = unicodedata.decomposition(chr(i)).split()
        if len(form) == 2 and form[0][0] != "<":
            a, b = (int(x, 16) for x in form)
            if unicodedata.normalize("NFC", chr(a) + chr(b)) == chr(i):
                composed[a << 21 | b] = i
    keys = np.array(sorted(composed), np.int64)
    return {
        "size": size, "start": start, "flat": flat, "ccc": ccc, "word": word, "lower": lower, "latin": latin, "script": script, "back": back, "shared": shared, "modern": modern, "firm": firm,
        "pairs": keys, "composed": np.array([composed[k] for k in keys], np.uint32),
    }


def _at(table: np.ndarray, points: np.ndarray, other: int = 0) -> np.ndarray:
    """table[points]; `other` beyond the table."""
    low = points < _END
    return table[points] if low.all() else np.where(low, table[np.where(low, points, 0)], other)


def _expand(points: np.ndarray, offsets: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    size = _at(t["size"], points, 1)
    begin = np.r_[0, np.cumsum(size)]
    where = np.repeat(_at(t["start"], points) - begin[:-1], size) + np.arange(begin[-1])
    high = np.repeat(points >= _END, size)
    out = t["flat"][np.where(high, 0, where)]
    if high.any():
        out[high] = np.repeat(points, size)[high]
    return out, begin[offsets]


def _keep(keep: np.ndarray, offsets: np.ndarray, *arrays: np.ndarray) -> tuple:
    return (*(a[keep] for a in arrays), np.r_[0, np.cumsum(keep)][offsets])


def _order_marks(points: np.ndarray, ccc: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort runs of combining marks by their class, stably."""
    if len(points) < 2 or not ((ccc[1:] > 0) & (ccc[:-1] > ccc[1:])).any():
        return points, ccc
    run = np.cumsum(ccc == 0) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    by = np.lexsort((np.arange(len(points)), ccc, run))
    return points[by], ccc[by]


def _scripts(points: np.ndarray, offsets: np.ndarray, t: dict) -> np.ndarray:
    """Look-alikes as Latin letters, or as letters of the script that the word's other letters show.

    Of words that have look-alikes only, single letters and those in lower case go with the word before them in the
    text, else with the one after, if all their letters are modern ones that, but for a single one, look alike in both cases; codes in
    capitals or with digits are Latin. All that is decided by what looks the same in either script, so texts that look
    the same are decided the same.
    """
    points = _at(t["latin"], points).astype(np.uint32) if (points < _END).all() else np.where(points < _END, _at(t["latin"], points), points).astype(np.uint32)
    script = _at(t["script"], points)
    others = [int(x) for x in np.unique(script) if x > _LATIN]
    if not others:
        return points
    inside = _at(t["word"], points).astype(bool)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    begins = inside & np.r_[True, ~inside[:-1] | (rows[1:] != rows[:-1])]
    word = np.cumsum(begins) - 1
    n = int(begins.sum())
    out = points.copy()
    of, letter = word[inside], script[inside] > 0
    lower = np.bincount(of[_at(t["lower"], points[inside]).astype(bool)], minlength=n) > 0
    size = np.bincount(of, minlength=n)
    follows = (lower | (size == 1)) & (np.bincount(of[~letter], minlength=n) == 0)
    for which in others:
        own = np.bincount(word[inside & (script == which)], minlength=n) > 0
        common = _at(t["shared"][which], points).astype(bool)
        alone = (size == 1) & (np.bincount(word[inside & _at(t["modern"][which], points).astype(bool)], minlength=n) == 1)
        firm = np.bincount(word[inside & _at(t["firm"][which], points).astype(bool)], minlength=n)
        foreign = np.bincount(word[inside & (script > 0) & (script != which) & ~common], minlength=n) > 0
        said = np.where(foreign, -1, np.where(own, 1, 0))
        row = rows[begins]
        last = np.maximum.accumulate(np.where(said != 0, np.arange(n), -1))
        before = np.where((last >= 0) & (row[np.maximum(last, 0)] == row), said[np.maximum(last, 0)], 0)
        after = np.minimum.accumulate(np.where(said != 0, np.arange(n), n)[::-1])[::-1]
        following = np.where((after < n) & (row[np.minimum(after, n - 1)] == row), said[np.minimum(after, n - 1)], 0)
        decided = np.where(said != 0, said, np.where(follows & (alone | (firm == size)), np.where(before != 0, before, following), 0))
        change = inside & common & (decided[np.maximum(word, 0)] == 1)
        out[change] = t["back"][which][points[change]]
    return out


def _compose(points: np.ndarray, ccc: np.ndarray, offsets: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Put marks back on their letters, all texts at once; a round for each mark that a letter can take."""
    marks = np.flatnonzero(ccc > 0)
    if not len(marks):
        return points, offsets
    points, gone, number = points.copy(), np.zeros(len(points), bool), np.arange(len(points))
    starter = np.maximum.accumulate(np.where(ccc == 0, number, -1))
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    open_ = marks[(starter[marks] >= 0)]
    open_ = open_[rows[starter[open_]] == rows[open_]]
    blocked = np.zeros(len(points), np.uint8)  # class of the last mark that stayed on a starter
    while len(open_):
        first = np.r_[True, starter[open_[1:]] != starter[open_[:-1]]]
        now = open_[first]
        base = starter[now]
        key = points[base].astype(np.int64) << 21 | points[now]
        at = np.minimum(np.searchsorted(t["pairs"], key), len(t["pairs"]) - 1)
        fits = (t["pairs"][at] == key) & (blocked[base] < ccc[now])
        points[base[fits]] = t["composed"][at[fits]]
        gone[now[fits]] = True
        blocked[base[~fits]] = ccc[now[~fits]]
        open_ = open_[~first]
    points, offsets = _keep(~gone, offsets, points)
    return points, offsets


def _hangul(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compose conjoining Hangul letters by the rule of the Unicode standard."""
    for low, count, step in ((0x1161, 21, 28), (0x11A8, 27, 1)):
        if len(points) < 2:
            break
        a, b = points[:-1].astype(np.int64), points[1:].astype(np.int64)
        vowel = low == 0x1161
        lead = (a >= 0x1100) & (a < 0x1113) if vowel else (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0)
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        hit = np.flatnonzero(lead & (b >= low) & (b < low + count) & (rows[1:] == rows[:-1]))
        if not len(hit):
            continue
        points = points.copy()
        points[hit] = 0xAC00 + ((a[hit] - 0x1100) * 21 + (b[hit] - low)) * step if vowel else a[hit] + b[hit] - low + 1
        keep = np.ones(len(points), bool)
        keep[hit + 1] = False
        points, offsets = _keep(keep, offsets, points)
    return points, offsets


def same_form(texts: pa.Array, pairs: Pairs) -> pa.Array:
    """Each text in its one form. Null stays null, empty stays empty; texts may have any length.

    pairs: of `confusables`. Texts of plain ASCII are in that form already and pass as they are.
    """
    data, offsets = codepoints.utf8_bytes(texts)
    odd = (data >= 0x7F) | (data < 0x20) & (data != 0x09) & (data != 0x0A) & (data != 0x0D)
    some = np.diff(np.r_[0, np.cumsum(odd)][offsets]) > 0
    if not some.any():
        return texts
    if not some.all():
        mask = pa.array(some)
        return pc.replace_with_mask(texts, mask, _same_form(texts.filter(mask), pairs).cast(texts.type))
    return _same_form(texts, pairs)


def _same_form(texts: pa.Array, pairs: Pairs) -> pa.Array:
    t = _tables(pairs)
    valid = texts.is_valid().to_numpy(zero_copy_only=False).astype(bool)
    points, offsets = codepoints.decode(*codepoints.utf8_bytes(texts))
    points, offsets = _expand(points, offsets, t)
    joiner = points == 0x200D
    if joiner.any():  # it joins pictures; between other characters it isn't seen
        picture = (points >= 0x1F000) | (points >= 0x2600) & (points < 0x27C0)
        keep = ~joiner | np.r_[False, picture[:-1]] & np.r_[picture[1:], False]
        points, offsets = _keep(keep, offsets, points)
    points, ccc = _order_marks(points, _at(t["ccc"], points), offsets)
    points = _scripts(points, offsets, t)
    points, offsets = _compose(points, ccc, offsets, t)
    points, offsets = _hangul(points, offsets)
    return codepoints.encode(points, offsets, valid)


def normalise(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text) with each text in its one form; Null stays null. Other columns are left out."""

    pairs = confusables(df.sparkSession)  # as many as Unicode has look-alikes of ASCII letters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), same_form(batch.column(1), pairs)], names=["key", "text"])

    got = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return got.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, text string").select(F.col("key").alias(key), F.col("text").alias(text))


def look_the_same(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(kept, copy): of documents that look the same the smallest id, then each of the others.

    Texts in their one form are compared by SHA-256 and length. Null texts and those with nothing visible are no
    case. Repeated ids count once. The rows of a hot text, held by a third of all documents, say, are spread over
    shards instead of being gathered in a task. Empty tables give no rows.
    """
    seen = normalise(df, text, key).filter(F.col(text).rlike(r"(?U)\S"))
    seen = cut(seen.select(F.col(key).alias("copy"), F.concat_ws("-", F.sha2(text, 256), F.length(text)).alias("look")))
    groups = seen.groupBy("look").agg(F.min("copy").alias("kept"), F.count(F.lit(1)).alias("n"))
    twice = cut(groups.filter(F.col("n") > 1), **watched_loads("n"))
    heavy = heavy_values(twice, "look", "n")
    return lookup(seen, "look", twice.select("look", "kept"), heavy, F.col("copy"), "inner").filter(F.col("copy") != F.col("kept")).select("kept", "copy").distinct()
