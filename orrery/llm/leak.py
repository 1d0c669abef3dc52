"""Test passages inside training text, by suffix arrays of the training text.

The corpus is taken in shards of bounded size, each on the task that reads it.
Words no test item has can't be part of a match, so a shard keeps only its runs
of at least ``min_words`` known words; over these it builds a suffix array by
prefix doubling and binary-searches every suffix of every test item, word by
word, narrowing the range of suffixes that still agree. What is left at
``min_words`` words is every occurrence; each is then extended to the longest
verbatim match. A document longer than a shard is cut into pieces that overlap
by the longest item, so no match is lost at a cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Occurrences that are laid out at once.
_BLOCK = 1_000_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, lower-cased."""
    if "İ" in text:  # its lower case is a letter and a mark, which would end the word
        return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(text.lower())


def suffix_array(a: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``a`` with a value above 0, ordered by the first ``depth`` values from there on."""
    at = np.flatnonzero(a > 0)
    rank = a.astype(np.int64)
    h = 1
    while True:
        after = np.zeros_like(rank)
        after[:-h] = rank[h:] if h < len(rank) else 0
        key = rank[at] * (rank.max() + 1) + after[at]
        order = np.argsort(key, kind="stable")
        if (h := 2 * h) >= depth:
            return at[order]
        new = np.empty(len(at), np.int64)
        new[order] = np.cumsum(np.concatenate(([1], np.diff(key[order]) > 0)))
        if new[order[-1]] == len(at):
            return at[order]
        rank = np.zeros_like(rank)
        rank[at] = new


def _bisect(a: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: int, q: np.ndarray, after: bool) -> np.ndarray:
    """First place in sa[lo:hi] whose value at depth d is >= q (> q if ``after``), for many queries at once."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        v = a[sa[mid] + d]
        less = v <= q[open_] if after else v < q[open_]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
    return lo


def search(a: np.ndarray, items: np.ndarray, min_words: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in ``a``, position in ``items``, words) of every verbatim match that can't be extended to either side.

    Values are above 0; 0 separates texts in both and ends both.
    """
    sa = suffix_array(a, depth)
    run = np.concatenate((a, np.zeros(min_words, a.dtype)))  # reading past the end ends a match
    start = np.flatnonzero(items > 0)
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(sa), np.int64)
    for d in range(min_words):
        q = items[np.minimum(start + d, len(items) - 1)]
        keep = q > 0
        start, lo, hi, q = start[keep], lo[keep], hi[keep], q[keep]
        lo, hi = _bisect(run, sa, lo, hi, d, q, False), _bisect(run, sa, lo, hi, d, q, True)
        keep = lo < hi
        start, lo, hi = start[keep], lo[keep], hi[keep]
    out = [np.zeros((3, 0), np.int64)]
    blocks = np.cumsum(hi - lo) // _BLOCK
    for k in np.unique(blocks):  # occurrences are laid out a block at a time
        own = blocks == k
        n, first = (hi - lo)[own], lo[own]
        item = np.repeat(start[own], n)
        pos = sa[np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        left = (pos > 0) & (item > 0)
        same = np.zeros(len(pos), bool)
        same[left] = (a[pos[left] - 1] == items[item[left] - 1]) & (a[pos[left] - 1] > 0)
        pos, item = pos[~same], item[~same]
        length = np.full(len(pos), min_words, np.int64)
        grow = np.arange(len(pos))
        while grow.size:
            x, y = pos[grow] + length[grow], item[grow] + length[grow]
            word = items[np.minimum(y, len(items) - 1)]
            grow = grow[(run[np.minimum(x, len(run) - 1)] == word) & (word > 0)]
            length[grow] += 1
        out.append(np.stack((pos, item, length)))
    return tuple(np.concatenate(out, axis=1))


class _Items:
    """Test items as one array of word numbers, and where each begins."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in rows for w in ws}), 1)}
        flat: list[int] = [0]
        owner, begin = [-1], [0]
        for k, (_, ws) in enumerate(rows):
            begin += [len(flat)] * (len(ws) + 1)
            owner += [k] * (len(ws) + 1)
            flat += [self.vocabulary[w] for w in ws]
            flat.append(0)
        self.flat, self.owner, self.begin = np.array(flat, np.int64), np.array(owner), np.array(begin)
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.longest = max((len(ws) for _, ws in rows), default=0)


def _shard_hits(pieces: list[tuple[int, int, np.ndarray]], items: _Items, min_words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Hits (doc, item, words, word of the document, word of the item) in pieces (doc, first word, word numbers)."""
    parts, docs, offs = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for doc, first, ids in pieces:
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ids > 0, [0]))))
        for s, e in edge.reshape(-1, 2):
            if e - s >= min_words:
                parts += [ids[s:e], np.zeros(1, np.int64)]
                docs.append(np.full(e - s + 1, doc, np.int64))
                offs.append(np.arange(first + s, first + e + 1))
    if len(parts) > 1:
        a = np.concatenate(parts)
        pos, at, n = search(a, items.flat, min_words, items.longest)
        if len(pos):
            yield np.concatenate(docs)[pos], items.ids[items.owner[at]], n, np.concatenate(offs)[pos], at - items.begin[at]


def leaked(
    docs: DataFrame, items: DataFrame, *, doc_id: Column, doc_text: Column, item_id: Column, item_text: Column, min_words: int = 12, shard_words: int = 500_000, part_words: int = 2_000_000
) -> DataFrame:
    """(doc_id, item_id, n_words, doc_word, item_word): each document that has ``min_words`` consecutive words of an item, once per item.

    ``n_words`` is the longest verbatim match, ``doc_word`` and ``item_word``
    where it begins (of equally long ones the first). Every task holds the test
    items; a set of more than ``part_words`` words is taken in parts, a pass each.

    Defined cases: null and empty texts and items shorter than ``min_words``
    match nothing; null ids are left out; repeated documents and items give one
    row; other columns are ignored whatever their names. Ids are integers.
    """
    if min_words < 1:
        raise ValueError("min_words must be positive")
    spark = docs.sparkSession
    rows = items.select(item_id.cast("long").alias("i"), item_text.cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    total = rows.agg(F.sum(F.size(F.split("t", r"[^\p{L}\p{N}]+")))).first()[0] or 0
    parts = max(1, -(-total // part_words))
    texts = docs.select(doc_id.cast("long").alias("i"), doc_text.cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    out = None
    for p in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == p)
        shared = spark.sparkContext.broadcast(_Items([(r.i, w) for r in part.distinct().collect() if len(w := words(r.t)) >= min_words]))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            it = shared.value
            if not len(it.ids):
                return
            step = max(shard_words, 2 * it.longest)

            def flush(pieces: list) -> Iterator[pa.RecordBatch]:
                for cols in _shard_hits(pieces, it, min_words):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_words", "doc_word", "item_word"])

            number, pieces, held = it.vocabulary.get, [], 0
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ids = np.array([number(w, 0) for w in words(text)], np.int64)
                    for s in range(0, max(1, len(ids)), step):
                        piece = ids[s : s + step + it.longest]
                        pieces.append((doc, s, piece))
                        held += len(piece)
                        if held >= step:
                            yield from flush(pieces)
                            pieces, held = [], 0
            yield from flush(pieces)

        found = texts.mapInArrow(find, "doc_id long, item_id long, n_words long, doc_word long, item_word long")
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("n_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.n_words", (-F.col("m.d")).alias("doc_word"), (-F.col("m.i")).alias("item_word"))


def without_leaks(docs: DataFrame, hits: DataFrame, doc_id: str) -> DataFrame:
    """``docs`` without the documents that ``hits`` names; rows with a null id stay."""
    return docs.join(hits.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")
