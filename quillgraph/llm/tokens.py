"""Byte-level BPE over whole Arrow batches, without regular expressions.

The text of a batch is one array of code points with a separator between rows. Each code point has a class, and
each class is a transition function on the nine states of the pre-tokeniser. Composition of transition
functions is associative, so the states at all positions come from a blocked scan: blocks are composed side by
side, block ends are chained, and the blocks are run again from their known start states. Token starts then
follow from states and classes alone. The slices of bytes between them are merged by rank; the pieces that a
worker has merged are kept.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import codepoints

#: The public vocabulary's rank file on the driver; a parameter of every operator here.
VOCABULARY = os.environ.get("QUILLGRAPH_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: Classes of code points. Lower-case letters that end a contraction have classes of their own.
_LETTER, _S, _R, _L, _E, _NUMBER, _QUOTE, _OTHER, _SPACE, _WHITE, _ROW = range(11)
#: States: what the last code point belongs to. Fresh: a row's start or after white space that isn't a space.
_FRESH, _IN_LETTERS, _IN_NUMBER, _IN_OTHER, _AFTER_SPACE, _QUOTED, _QUOTED_RV, _QUOTED_L, _CONTRACTED = range(9)
_SEPARATOR = 0x110000
#: White space of the Unicode standard (fixed values).
_WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _transitions() -> np.ndarray:
    """The next state by class and state."""
    t = np.zeros((11, 9), np.uint8)
    for c in (_LETTER, _S, _R, _L, _E):
        t[c] = _IN_LETTERS
    t[_S, _QUOTED] = _CONTRACTED
    t[_R, _QUOTED] = _QUOTED_RV
    t[_L, _QUOTED] = _QUOTED_L
    t[_E, _QUOTED_RV] = _CONTRACTED
    t[_L, _QUOTED_L] = _CONTRACTED
    t[_NUMBER] = _IN_NUMBER
    t[_OTHER] = _IN_OTHER
    t[_QUOTE] = _QUOTED
    t[_QUOTE, [_IN_OTHER, _AFTER_SPACE, _QUOTED]] = _IN_OTHER
    t[_SPACE] = _AFTER_SPACE
    return t


_NEXT = _transitions()


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that classes compose to: (number of each class's function, product of two, value at a state)."""
    found = {tuple(range(9)): 0}
    queue = [tuple(range(9))]
    for f in queue:
        for c in range(len(_NEXT)):
            g = tuple(int(_NEXT[c, x]) for x in f)
            if g not in found:
                found[g] = len(found)
                queue.append(g)
    of_class = np.array([found[tuple(int(x) for x in row)] for row in _NEXT], np.uint8)
    product = np.array([[found[tuple(int(g[x]) for x in f)] for f in queue] for g in queue], np.uint8)
    return of_class, product, np.array(queue, np.uint8)


#: Function 0 is the identity; _PRODUCT[g, f] is first f, then g.
_FUNCTION, _PRODUCT, _VALUE = _monoid()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.full(_SEPARATOR + 1, _OTHER, np.uint8)
    for i in range(0x32400):
        table[i] = kinds.get(unicodedata.category(chr(i))[0], _OTHER)
    table[list(_WHITE_SPACE)] = _WHITE
    table[0x20] = _SPACE
    table[0x27] = _QUOTE
    for letters, c in (("stmd", _S), ("rv", _R), ("l", _L), ("e", _E)):
        table[[ord(x) for x in letters]] = c
    table[_SEPARATOR] = _ROW
    return table


def scan(classes: np.ndarray, block: int = 256) -> np.ndarray:
    """The state after each position, from composed transition functions."""
    n = len(classes)
    rows = -(-n // block)
    padded = np.full(rows * block, _ROW, np.uint8)
    padded[:n] = classes
    grid = np.ascontiguousarray(_FUNCTION[padded].reshape(rows, block).T)
    width, table = len(_PRODUCT), _PRODUCT.reshape(-1)
    ahead = np.empty((block, rows), np.uint8)  # the functions from each block's start on
    so_far = np.zeros(rows, np.intp)
    for j, column in enumerate(grid):
        so_far = table.take(column.astype(np.intp) * width + so_far).astype(np.intp)
        ahead[j] = so_far
    start = np.zeros(rows, np.uint8)
    last, state = ahead[-1], 0
    for i in range(1, rows):
        state = start[i] = _VALUE[last[i - 1], state]
    return _VALUE[ahead, start[None, :]].T.reshape(-1)[:n]


def _ends(*goes_on: int) -> np.ndarray:
    """By state: whether a token ends there, other than before a code point that goes on with it."""
    out = np.ones(len(_NEXT[0]), bool)
    out[list(goes_on)] = False
    return out


def token_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True where a pre-token starts, for the code points of all rows."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    lengths = np.diff(offsets)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(n) + rows + 1  # a separator before each row
    classes = np.full(n + len(lengths) + 1, _ROW, np.uint8)
    classes[at] = _classes()[points]
    state = scan(classes)
    before = np.r_[np.uint8(_FRESH), state[:-1]]
    letter, number = classes <= _E, classes == _NUMBER
    other = (classes == _QUOTE) | (classes == _OTHER)
    white = (classes == _SPACE) | (classes == _WHITE)
    starts = letter & _ends(_IN_LETTERS, _AFTER_SPACE, _QUOTED_RV, _QUOTED_L)[before]
    starts |= number & _ends(_IN_NUMBER, _AFTER_SPACE)[before]
    starts |= other & _ends(_IN_OTHER, _AFTER_SPACE, _QUOTED)[before]
    # White space: a run is a token, but its last one goes to what follows, or stands alone.
    shown = np.r_[~white[1:] & (classes[1:] != _ROW), False]
    starts |= white & (np.r_[True, ~white[:-1]] | shown)
    # A contraction is known at its last letter; its letters started no token.
    ends = np.flatnonzero(state == _CONTRACTED)
    starts[ends] = False
    two = ends[np.isin(before[ends], (_QUOTED_RV, _QUOTED_L))]
    starts[two - 1] = False
    return starts[at]


class Vocabulary(dict):
    """Ranks of a byte-level BPE; as a dict, the ids of the pieces merged so far, at most `keep` of them."""

    def __init__(self, path: str = VOCABULARY, keep: int = 200_000) -> None:
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.keep = keep

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of a piece: the neighbours of least rank are merged first, the left ones of equal rank before others."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that starts here
        back = list(range(-1, n - 1))
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        alive = [True] * n
        while queue:
            _, i, stop = heapq.heappop(queue)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                back[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(queue, (r, i, end[stop]))
            if (h := back[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(queue, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        got = self.merge(piece)
        if len(piece) <= 64:
            if len(self) >= self.keep:
                self.clear()
            self[piece] = got
        return got

    @cached_property
    def lengths(self) -> np.ndarray:
        """Bytes of each id."""
        out = np.zeros(max(self.ranks.values()) + 1, np.int64)
        out[list(self.ranks.values())] = [len(b) for b in self.ranks]
        return out

    def words(self) -> dict[int, bytes]:
        """The bytes of each id."""
        return {i: b for b, i in self.ranks.items()}


@lru_cache(maxsize=4)
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """The vocabulary of a worker, read once."""
    return Vocabulary(path)


def _pieces(texts: pa.Array, words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all pre-tokens, number of ids of each, number of pre-tokens before each row).

    Slices are dictionary-encoded first, so that each distinct one of a batch is looked up once.
    """
    data, offsets = codepoints.utf8_bytes(texts)
    points, rows = codepoints.decode(data, offsets)
    starts = token_starts(points, rows)
    at = np.r_[0, np.cumsum(codepoints.byte_lengths(points))][:-1][starts] if len(points) else np.zeros(0, np.int64)
    bounds = np.r_[at, len(data)].astype(np.int64)
    slices = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode()
    ids = [words[b] for b in slices.dictionary.to_pylist()]
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
    which = slices.indices.to_numpy()
    begin, each = np.r_[0, np.cumsum(size)][which], size[which]
    place = np.repeat(begin - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum())
    return flat[place], each, np.r_[0, np.cumsum(starts)][rows]


def encode(texts: pa.Array, words: Vocabulary) -> pa.ListArray:
    """The token ids of each text; an empty list for an empty and for a null one."""
    ids, size, before = _pieces(texts, words)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)][before].astype(np.int32)), pa.array(ids, pa.int32()))


def encode_with_offsets(texts: pa.Array, words: Vocabulary) -> tuple[pa.ListArray, pa.ListArray]:
    """(ids, byte offset of each token within its text)."""
    ids, size, before = _pieces(texts, words)
    bounds = np.r_[0, np.cumsum(size)][before]
    at = np.r_[0, np.cumsum(words.lengths[ids])]
    own = at[:-1] - np.repeat(at[bounds[:-1]], np.diff(bounds))
    edge = pa.array(bounds.astype(np.int32))
    return pa.ListArray.from_arrays(edge, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(edge, pa.array(own.astype(np.int32)))


def _shipped(spark: SparkSession, path: str) -> str:
    """Send the vocabulary's file along with the job; the name under which workers have it."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def _here(name: str) -> Vocabulary:
    return vocabulary(SparkFiles.get(name))


def token_ids(df: DataFrame, text: str = "text", key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row. Null and empty texts have an empty list. No special tokens; their strings in a text are text."""
    name = _shipped(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _here(name)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), encode(batch.column(1), words)], names=["key", "ids"])

    got = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return got.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def token_offsets(df: DataFrame, text: str = "text", key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """(key, ids, offsets): also the byte at which each token starts in the UTF-8 text."""
    name = _shipped(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _here(name)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *encode_with_offsets(batch.column(1), words)], names=["key", "ids", "offsets"])

    got = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return got.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, ids array<int>, offsets array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, text: str = "text", key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row; 0 for null and empty texts."""
    name = _shipped(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _here(name)
        for batch in batches:
            n = np.diff(encode(batch.column(1), words).offsets.to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], names=["key", "n_tokens"])

    got = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return got.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, n_tokens bigint").withColumnRenamed("key", key)


def decode(df: DataFrame, ids: str = "ids", key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """(key, text) from token ids; an empty or null list gives an empty text."""
    name = _shipped(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _here(name).words()
        for batch in batches:
            texts = [b"".join(words[i] for i in row or ()).decode("utf-8", "replace") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    got = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return got.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, text string").withColumnRenamed("key", key)
