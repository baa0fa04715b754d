"""Freely typed values and the list entries they stand for: a trie searched with a Levenshtein automaton.

The automaton is the deterministic one for a distance, the same for all words: a state is a set of positions
relative to an offset in the word, and its transitions depend only on which of the next characters equal the one
read. Its tables are built once per distance. A batch of words walks the trie together, level by level: the
frontier is a set of arrays (word, node, offset, state), and each step is a gather. Alias paths lead to the
same entries. Every entry within the distance that the word's length allows is returned. Values of several words
are searched in every order of the words: paths that have nearly the same letters are compared by edit distance over
the sets of words used so far.

List and values are cut into cells by two numbers that an edit changes by one at most and the order of words not at
all: how many letters a text has, and how many of them are among COUNTED. A value is searched in the few cells that it can
reach, each with a trie of its own. Cells are packed to tasks by their number of values; of a hot one the values are
spread, and its paths replicated to those tasks only. In a task the paths of a cell come first and become its trie;
the values are streamed through it. Nothing is sent to the driver but the hot cells, and nothing grows with the list
but the tries, which a cell's blocks bound.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.skew import BIN, heavy_values, lookup, place, watched_loads
from quillgraph.session import cut, partitions, seen

#: (least length, distance): of the last row that a word is long enough for.
DISTANCES = ((0, 0), (5, 1), (7, 2), (20, 3))
#: Numbers have no redundancy: one wrong, missing or additional digit at most.
DIGITS = ((0, 0), (6, 1))
#: Letters and digits that are counted for the cell of a text: about half of those in names.
COUNTED = "aeiouy13579"
#: Width of the bands of both numbers, and bands that are told apart; longer texts share the last.
BAND, BANDS = 4, 100
#: Paths of a trie; a cell with more is searched in blocks.
BLOCK = 100_000
#: Words that walk the trie together.
BATCH = 512
NONE = -1


@lru_cache(maxsize=8)
def automaton(d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next state, shift of the offset, distance at a word's end) by state and by mask or letters left; -1 is dead."""
    width = 2 * d + 1

    def step(i: int, e: int, mask: int) -> set[tuple[int, int]]:
        if mask >> i & 1:
            return {(i + 1, e)}
        if e == d:
            return set()
        out = {(i, e + 1), (i + 1, e + 1)}
        for j in range(1, d - e + 1):
            if mask >> (i + j) & 1:
                out.add((i + j + 1, e + j))
                break
        return out

    def reduced(positions: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        return frozenset(p for p in positions if not any(p[1] > q[1] and abs(p[0] - q[0]) <= p[1] - q[1] for q in positions))

    first = frozenset({(0, 0)})
    number, queue, to, shift = {first: 0}, [first], [], []
    for state in queue:
        row, moved = [], []
        for mask in range(1 << width):
            got = reduced({p for i, e in state for p in step(i, e, mask)})
            if not got:
                row.append(-1)
                moved.append(0)
                continue
            by = min(i for i, _ in got)
            got = frozenset((i - by, e) for i, e in got)
            if got not in number:
                number[got] = len(number)
                queue.append(got)
            row.append(number[got])
            moved.append(by)
        to.append(row)
        shift.append(moved)
    far = d + 1
    ends = np.full((len(queue), 3 * d + 2), far, np.int8)
    for s, state in enumerate(queue):
        for left in range(3 * d + 2):
            ends[s, left] = min([far, *(e + left - i for i, e in state if left >= i)])
    return np.array(to, np.int16), np.array(shift, np.int8), ends


class Trie:
    """Paths of a list, as arrays: the children of a node are a slice; a node's entries are a slice."""

    def __init__(self, paths: Iterable[tuple[str, int]]) -> None:
        pairs = sorted(set(paths))
        self.exact: dict[str, list[int]] = {}
        for path, entry in pairs:
            self.exact.setdefault(path, []).append(entry)
        words = list(self.exact)
        letters = sorted({c for w in words for c in w})
        self.code = {c: i + 1 for i, c in enumerate(letters)}
        below: list[dict[int, int]] = [{}]
        at: list[list[int]] = [[]]
        for w in words:
            node = 0
            for c in w:
                k = self.code[c]
                if k not in below[node]:
                    below[node][k] = len(below)
                    below.append({})
                    at.append([])
                node = below[node][k]
            at[node] = self.exact[w]
        self.count = np.array([len(b) for b in below])
        self.first = np.r_[0, np.cumsum(self.count)[:-1]]
        self.letter = np.array([k for b in below for k in b], np.int32)
        self.child = np.array([n for b in below for n in b.values()], np.int64)
        self.entries = np.array([len(a) for a in at])
        self.entry_at = np.r_[0, np.cumsum(self.entries)[:-1]]
        self.entry = np.array([e for a in at for e in a], np.int64)
        self.by_size = sorted(words, key=len)
        self.sizes = np.array([len(w) for w in self.by_size], np.int64)
        which = np.repeat(np.arange(len(words)), self.sizes)
        drawn = np.array([self.code[c] for w in self.by_size for c in w], np.int64)
        self.letters = np.zeros((len(words), len(letters) + 1), np.int16)
        np.add.at(self.letters, (which, drawn), 1)

    def search(self, words: list[str], d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the word, entry, distance) of all entries within distance d, the least distance of each pair."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        to, shift, ends = automaton(d)
        width = 2 * d + 1
        bits = 1 << np.arange(width)
        for begin in range(0, len(words), BATCH):
            part = words[begin : begin + BATCH]
            size = np.array([len(w) for w in part])
            grid = np.zeros((len(part), size.max(initial=0) + width + d + 1), np.int32)
            for i, w in enumerate(part):
                grid[i, : len(w)] = [self.code.get(c, 0) for c in w]
            grid[grid == 0] = -1
            q, node = np.arange(len(part)), np.zeros(len(part), np.int64)
            offset, state = np.zeros(len(part), np.int64), np.zeros(len(part), np.int16)
            while len(q):
                left = size[q] - offset
                away = np.where((left >= 0) & (left < ends.shape[1]), ends[state, np.clip(left, 0, ends.shape[1] - 1)], d + 1)
                hit = np.flatnonzero((self.entries[node] > 0) & (away <= d))
                if len(hit):
                    n = self.entries[node[hit]]
                    which = np.repeat(self.entry_at[node[hit]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    found.append((begin + np.repeat(q[hit], n), self.entry[which], np.repeat(away[hit], n)))
                n = self.count[node]
                edge = np.repeat(self.first[node] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                q, offset, state = np.repeat(q, n), np.repeat(offset, n), np.repeat(state, n)
                same = grid[q[:, None], np.minimum(offset[:, None] + np.arange(width), grid.shape[1] - 1)] == self.letter[edge][:, None]
                mask = same @ bits
                new = to[state, mask]
                alive = new >= 0
                q, node, offset, state = q[alive], self.child[edge[alive]], (offset + shift[state, mask])[alive], new[alive]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return _least(*(np.concatenate(x) for x in zip(*found)))

    def search_orders(self, bags: list[tuple[str, ...]], d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `search`, for values of several words joined in whichever order is nearest.

        The order changes no letter count, so only paths whose counts differ by d at most are compared.
        """
        found: list[tuple[int, int, int]] = []
        for i, bag in enumerate(bags):
            drawn = [self.code.get(c, 0) for w in bag for c in w]
            begin, end = np.searchsorted(self.sizes, [len(drawn) - d, len(drawn) + d + 1])
            own = np.bincount(drawn, minlength=self.letters.shape[1])
            own[0] = 0
            common = np.minimum(self.letters[begin:end], own).sum(1)
            for k in begin + np.flatnonzero(np.maximum(self.sizes[begin:end], len(drawn)) - common <= d):
                path = self.by_size[k]
                if (away := any_order(bag, path, d)) <= d:
                    found += [(i, e, away) for e in self.exact[path]]
        return _least(*np.array(found, np.int64).reshape(-1, 3).T)


def _least(w: np.ndarray, e: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, entry, distance), the least distance of each pair."""
    by = np.lexsort((a, e, w))
    w, e, a = w[by], e[by], a[by].astype(np.int64)
    keep = np.ones(len(w), bool)
    keep[1:] = (w[1:] != w[:-1]) | (e[1:] != e[:-1])
    return w[keep], e[keep], a[keep]


def any_order(bag: tuple[str, ...], path: str, d: int) -> int:
    """The least edit distance of `path` to the words joined in any order; d + 1 where that is beyond d.

    For each multiset of words used, the row of least distances to all beginnings of the path; rows beyond d are dropped.
    """
    rows = {tuple(sorted(bag)): [min(j, d + 1) for j in range(len(path) + 1)]}
    for _ in bag:
        after: dict[tuple[str, ...], list[int]] = {}
        for left, start in rows.items():
            for k, word in enumerate(left):
                if k and left[k - 1] == word:
                    continue
                row = start
                for c in word:
                    new = [row[0] + 1]
                    for j, x in enumerate(path):
                        new.append(min(row[j] + (x != c), row[j + 1] + 1, new[j] + 1))
                    row = new
                    if min(row) > d:
                        break
                else:
                    rest = left[:k] + left[k + 1 :]
                    after[rest] = list(map(min, after[rest], row)) if rest in after else row
        rows = after
    return min([d + 1, *(row[-1] for row in rows.values())])


def allowed(word: str, distances: tuple[tuple[int, int], ...] = DISTANCES) -> int:
    return [d for least, d in distances if len(word) >= least][-1]


def search(trie: Trie, bags: list[tuple[str, ...]], d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, entry, distance) of all entries within distance d of the words in the order written, or in another one."""
    several = [i for i, bag in enumerate(bags) if len(bag) > 1]
    w, e, a = trie.search(["".join(bag) for bag in bags], d)
    w2, e2, a2 = trie.search_orders([bags[i] for i in several], d)
    return _least(np.r_[w, np.array(several, np.int64)[w2]], np.r_[e, e2], np.r_[a, a2])


def within(trie: Trie, bags: list[tuple[str, ...]], distances: tuple[tuple[int, int], ...] = DISTANCES) -> list[list[tuple[int, int]]]:
    """(distance, entry) of all entries within the distance that each value's words allow, nearest first."""
    out: list[list[tuple[int, int]]] = [[] for _ in bags]
    open_: dict[int, list[int]] = {}
    for i, bag in enumerate(bags):
        if w := "".join(bag):
            open_.setdefault(allowed(w, distances), []).append(i)
    for d, at in open_.items():
        for k, entry, away in zip(*(x.tolist() for x in search(trie, [bags[i] for i in at], d))):
            out[at[k]].append((away, entry))
    return [sorted(x) for x in out]


# --- What is dropped before values are compared ------------------------------------------------------------------

#: Salts, forms and units beside a drug's name, which say nothing about which drug it is.
DRUG_NOISE = frozenset("hcl hydrochloride mesylate tosylate sodium potassium maleate oral generic inj tab cap iv mg ml mcg g".split())
_CODE = re.compile(r"(?<![a-z])[a-z]{3}[^a-z0-9]?[0-9]{5}(?![0-9])")
_DOSE = re.compile(r"\b[0-9]+(?:[.,][0-9]+)?\s*(?:mg|ml|mcg|g)?(?:\s*/\s*(?:ml|l|kg|d))?\b")
_DISEASE_NOISE = re.compile(r"\[\s*doid:?\s*[0-9]*\s*\]|\bstage\s+[ivx0-9]+[abc]?\b|\bnos\b|^\s*(?:pt|pts|patient|patients)\s*(?:w/|with)|['’]s\b")

#: Words that say how a disease is, and which one only where a listed name has them too.
_REMARKS = re.compile(r"\b(?:advanced|metastatic|unspecified)\b")


def folded(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()


def drug_words(text: str) -> tuple[str, ...]:
    """The words of a drug's name, in letters and digits: without product code, dose, form and salt."""
    words = re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z])['’.\-](?=[a-z])", "", _DOSE.sub(" ", _CODE.sub(" ", folded(text).replace("_", " ")))))
    return tuple(w for w in words if w not in DRUG_NOISE)


def drug_word(text: str) -> str:
    """A drug's name as one word."""
    return "".join(drug_words(text))


def disease_word(text: str, remarks: bool = False) -> str:
    """A disease's name in letters: without identifier and stage, and without remarks unless they are asked for."""
    plain = _DISEASE_NOISE.sub(" ", folded(text).replace("_", " "))
    return "".join(re.findall(r"[a-z0-9]+", plain if remarks else _REMARKS.sub(" ", plain)))


def id_word(text: str) -> str:
    """The digits of an identifier that may be prefixed, padded, written as a decimal or with letters for 0 and 1."""
    plain = re.sub(r"[^a-z0-9]", "", re.sub(r"\.0+$", "", folded(text).strip()))
    digits = re.sub(r"^chembl(?:id)?", "", plain).replace("o", "0").replace("l", "1").replace("i", "1")
    return digits.lstrip("0") if digits.isdigit() else ""


def disease_paths(name: str) -> list[str]:
    """Ways to write a disease's name: the type last, first, or set off by commas, with the first word as a qualifier or not."""
    words = folded(name).split()
    if len(words) < 2:
        return [name]
    kind, forms = words[-1], []
    for n in range(2 if len(words) > 2 else 1):
        lead, place = words[:n], words[n:-1]
        forms += [[*lead, *place, kind], [*lead, kind, "of", "the", *place], [*lead, *place, "malignant", kind], [kind, *lead, *place], [*place, kind, *lead]]
    return list(dict.fromkeys(" ".join(f) for f in forms))


def as_written(path: str) -> list[str]:
    return [path]


@dataclass(frozen=True)
class Kind:
    """How texts of a kind are read.

    words: the words of a value, which may come in any order. fallback: the words of a value that has no candidate as
    it is written. forms: the ways to write a listed name. reach: (least length, distance). learns: whether words that
    many values have and no listed name are dropped from values that have no candidate with them.
    """

    words: Callable[[str], tuple[str, ...]]
    fallback: Callable[[str], tuple[str, ...]] | None = None
    forms: Callable[[str], list[str]] = as_written
    reach: tuple[tuple[int, int], ...] = DISTANCES
    learns: bool = False


#: A disease's orders are paths of their own; a remark that a listed name has tells entries apart. A word that many
#: typed diseases have may be a kind of disease that isn't listed, so none is learned there.
KINDS = {
    "drug": Kind(drug_words, learns=True),
    "disease": Kind(lambda text: (disease_word(text, remarks=True),), lambda text: (disease_word(text),), disease_paths),
    "id": Kind(lambda text: (id_word(text),), reach=DIGITS),
}
#: A word is learned to say nothing when this share of the distinct values have it, and so many of them at least.
LEARNED_SHARE, LEARNED_LEAST = 0.005, 20

def _key() -> Column:
    return F.concat_ws("\x01", "kind", "value").alias("key")



def _drawn(values: DataFrame) -> DataFrame:
    """(key, kind, step, words): the words of each value, and those of its fallback where they differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                name, _, value = key.partition("\x01")
                kind = KINDS[name]
                words = " ".join(kind.words(value)).strip()
                out.append((key, name, 0, words))
                if kind.fallback and (less := " ".join(kind.fallback(value)).strip()) != words:
                    out.append((key, name, 1, less))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))], names=["key", "kind", "step", "words"])

    return values.select("key").mapInArrow(run, "key string, kind string, step int, words string").filter("words <> ''")


def _written(paths: DataFrame) -> DataFrame:
    """(kind, path, entry): every form of every path, in letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(kind, "".join(KINDS[kind].words(form)), entry) for kind, path, entry in zip(*(c.to_pylist() for c in batch.columns)) for form in KINDS[kind].forms(path)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["kind", "path", "entry"])

    return paths.select("kind", "path", F.col("entry").cast("bigint").alias("entry")).mapInArrow(run, "kind string, path string, entry bigint").filter("path <> ''").distinct()


def _learned(drawn: DataFrame, written: DataFrame, typed: int) -> list[str]:
    """Words that say nothing: many values have them, and no listed name starts or ends with them.

    There are at most the mean number of words of a value, divided by LEARNED_SHARE.
    """
    kinds = [k for k, kind in KINDS.items() if kind.learns]
    words = drawn.filter(F.col("kind").isin(kinds) & (F.col("step") == 0)).select(F.explode(F.array_distinct(F.split("words", " "))).alias("w"))
    often = words.groupBy("w").count().filter(F.col("count") >= max(LEARNED_LEAST, LEARNED_SHARE * typed)).select("w")
    size = F.sequence(F.lit(1), F.length("path"))
    ends = F.concat(F.transform(size, lambda n: F.substring("path", F.lit(1), n)), F.transform(size, lambda n: F.substring(F.col("path"), F.length("path") - n + 1, n)))
    listed = written.filter(F.col("kind").isin(kinds)).select(F.explode(ends).alias("w")).distinct()
    return sorted(r["w"] for r in often.join(listed, "w", "left_anti").collect())


def _numbers(letters: Column) -> tuple[Column, Column]:
    return F.length(letters), F.length(F.regexp_replace(letters, f"[^{COUNTED}]", ""))


def _band(n: Column) -> Column:
    return F.least(F.floor(n / BAND).cast("int"), F.lit(BANDS))


def _reachable(kind: Column, letters: Column) -> Column:
    """The cells that hold all texts within the distance of the letters."""
    size, counted = _numbers(letters)
    d = F.lit(0)
    for name, k in KINDS.items():
        for least, distance in k.reach:
            d = F.when((kind == name) & (size >= least), distance).otherwise(d)
    bands = lambda n: F.sequence(_band(F.greatest(n - d, F.lit(0))), _band(n + d))
    return F.flatten(F.transform(bands(size), lambda a: F.transform(bands(counted), lambda b: a * (BANDS + 1) + b)))


def _searcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, the paths of a cell first."""
    last, listed, trie = None, [], None
    for batch in batches:
        cell = np.asarray(batch.column("cell").to_pylist(), object)
        edges = np.flatnonzero(cell[1:] != cell[:-1]) + 1
        for a, b in zip(np.r_[0, edges], np.r_[edges, len(cell)]) if len(cell) else ():
            if cell[a] != last:
                last, listed, trie = cell[a], [], None
            part = batch.slice(a, b - a)
            texts, entries = part.column("text").to_pylist(), part.column("entry").to_pylist()
            listed += [(t, e) for t, e in zip(texts, entries) if e is not None]
            asked = [i for i, e in enumerate(entries) if e is None]
            if not asked:
                continue
            trie = trie or Trie(listed)
            near = within(trie, [tuple(texts[i].split(" ")) for i in asked], KINDS[last.split("|")[0]].reach)
            rows = np.repeat(asked, [len(n) for n in near])
            found = [c for n in near for c in n]
            keys, steps = (part.column(c).take(pa.array(rows, pa.int64())) for c in ("key", "step"))
            yield pa.RecordBatch.from_arrays([keys, steps, pa.array([d for d, _ in found], pa.int32()), pa.array([e for _, e in found], pa.int64())], names=["key", "step", "distance", "entry"])


_FOUND = "array<struct<step: int, distance: int, entry: bigint>>"


def match(values: DataFrame, paths: DataFrame) -> DataFrame:
    """(key, candidates) of the values that have any: (distance, entry) of every entry within the distance, nearest first.

    values: key (kind and value, as in `keyed`), one row each. paths: kind, path, entry; alias paths lead to the same
    entry. A value's candidates are those of its words as written; only if there are none, those of its fallback, and
    then those without learned words. An entry comes with each distance that its paths have.
    """
    tasks = partitions(values.sparkSession)
    drawn = cut(_drawn(values.repartition(tasks, "key")), values=F.count(F.when(F.col("step") == 0, 1)))
    written = cut(_written(paths))
    if learned := _learned(drawn, written, seen(drawn, "values")):
        less = F.array_join(F.filter(F.split("words", " "), lambda w: ~w.isin(learned)), " ")
        again = drawn.filter(F.col("kind").isin([k for k, kind in KINDS.items() if kind.learns]) & (F.col("step") == 0)).select("key", "kind", F.lit(2).alias("step"), less.alias("less"), "words")
        drawn = drawn.unionByName(again.filter((F.col("less") != F.col("words")) & (F.col("less") != "")).select("key", "kind", "step", F.col("less").alias("words")))
    size, counted = _numbers(F.col("path"))
    listed = written.withColumn("at", _band(size) * (BANDS + 1) + _band(counted))
    blocks = listed.groupBy("kind", "at").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))  # a row for each cell: (BANDS + 1)^2 a kind at most
    asked = drawn.withColumn("at", F.explode(_reachable(F.col("kind"), F.replace("words", F.lit(" "), F.lit("")))))
    asked = asked.join(F.broadcast(blocks), ["kind", "at"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    listed = listed.join(F.broadcast(blocks), ["kind", "at"]).withColumn("block", F.pmod(F.xxhash64("path"), F.col("blocks")).cast("int"))
    cell = F.concat_ws("|", "kind", "at", "block").alias("cell")
    asked = cut(asked.select(cell, "key", "step", F.col("words").alias("text"), F.lit(None).cast("bigint").alias("entry")))
    listed = listed.select(cell, F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("step"), F.col("path").alias("text"), "entry")
    at = place(asked.groupBy("cell").count(), ["cell"], "count")
    both = at.send(at.shard(asked, ["key"]).unionByName(at.copies(listed))).sortWithinPartitions("cell", F.asc_nulls_last("entry"))
    near = both.drop(BIN).mapInArrow(_searcher, "key string, step int, distance int, entry bigint")
    found = near.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("step", "distance", "entry"))).alias("found"))
    first = F.element_at("found", 1)["step"]
    return found.select("key", F.transform(F.filter("found", lambda c: c["step"] == first), lambda c: F.struct(c["distance"].alias("distance"), c["entry"].alias("entry"))).alias("candidates"))


def nearest(candidates: Column) -> tuple[Column, Column]:
    """(entry, tied): the nearest of the candidates; NONE where there is none, or several are as near.

    tied: number of entries at the least distance; 0 where a value resembles nothing, over 1 where entries tie.
    """
    least = F.try_element_at(candidates, F.lit(1))
    tied = F.coalesce(F.size(F.array_distinct(F.filter(candidates, lambda c: c["distance"] == least["distance"]))), F.lit(0))
    return F.when(tied == 1, least["entry"]).otherwise(NONE), tied


def _typed(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, count) of the distinct non-blank values that don't stand letter for letter in `listed`."""
    loads = rows.filter(~F.col("value").rlike(r"(?U)^\s*$")).groupBy(_key()).count()
    return cut(loads.join(listed.filter(F.col("value").isNotNull()).select(_key()).distinct(), "key", "left_anti"), **watched_loads("count"))


def candidates(rows: DataFrame, listed: DataFrame, paths: DataFrame) -> DataFrame:
    """(kind, value, entry, distance): every entry that a value may stand for, for the values that `map_values` maps."""
    got = match(_typed(rows, listed), paths).select("key", F.explode("candidates").alias("c"))
    key = F.split("key", "\x01", 2)
    return got.groupBy(key[0].alias("kind"), key[1].alias("value"), "c.entry").agg(F.min("c.distance").alias("distance"))


def map_values(rows: DataFrame, listed: DataFrame, paths: DataFrame) -> DataFrame:
    """(kind, row_id, value, entry, tied) of every non-blank value that doesn't stand letter for letter in `listed`.

    rows: kind, row_id, value. listed: kind, value. paths: kind, path, entry. All kinds go through one search. Values are
    made distinct before, so a hot value is searched once; its result then meets its rows without gathering them.
    Null and blank values give no row; empty lists give NONE for all.
    """
    rows = rows.select("kind", "row_id", "value").filter(~F.col("value").rlike(r"(?U)^\s*$"))
    typed = _typed(rows, listed)
    entry, tied = nearest(F.col("candidates"))
    got = typed.select("key").join(match(typed, paths), "key", "left").select("key", entry.alias("entry"), tied.alias("tied"))
    return lookup(rows.withColumn("key", _key()), "key", got, heavy_values(typed, "key", "count"), F.col("row_id"), "inner").drop("key")
