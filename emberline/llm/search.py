"""Ranked lexical search: dual-sorted wavelet trees over shards of documents, searched best node first for the exact top k.

A term is a maximal run of digits, letters A-Z (in lower case) and characters beyond ASCII. A shard is a part of an Arrow batch. Its postings, term by term
and by falling impact within a term, are one row of document numbers in a wavelet matrix. Going down a bit of the document number keeps the order of what
goes there, so at each node each term has a range, sorted by impact, of the documents below that node: its first entry has the greatest impact
there. The sum of these over an item's terms bounds the score of each document below; at a leaf it is the score. Nodes are opened best bound first, many items
at a time, and dropped once k documents are better. A task goes on to its next shard with the best it has found, so later shards open few nodes.

Only terms that the items have are indexed: the items are a stated query set, and go to the tasks in blocks of about block_bytes of text, each a broadcast of
its own. A document counts with all its terms wherever lengths and totals are concerned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, slices
from .decontam import flat

BLOCK_BYTES = 16 << 20
ITEMS_AT_ONCE = 64
"""Items whose open nodes a task holds at a time."""
FIRST_OPENED = 16
"""Nodes of an item that the first round opens at most; each round opens twice as many as the one before."""
_DOCUMENTS, _TERMS = -1, -2
_LAST = np.iinfo(np.int64).max
"""Stands for a null id: it comes last."""


@dataclass
class Items:
    """A block of items: ids, and a row of (item, term, times) for each different term of each item, by item."""

    ids: list[str | None]
    vocabulary: dict[bytes, int]
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray


def items_of(rows: list[tuple[str | None, str | None]]) -> Items:
    vocabulary: dict[bytes, int] = {}
    item, term, times = [], [], []
    for i, (_, text) in enumerate(rows):
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in flat(text).split()]
        found, n = np.unique(np.array(ids, np.int64), return_counts=True)
        item.append(np.full(len(found), i)), term.append(found), times.append(n)
    joined = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (item, term, times)]
    return Items([r[0] for r in rows], vocabulary, *joined)


def postings(vocabulary: dict[bytes, int], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms in each flat text, and the document, term and frequency of each posting of a term of the vocabulary."""
    get, counts, found = vocabulary.get, [], [np.zeros(0, np.int64)]
    for t in texts:
        words = t.split()
        counts.append(len(words))
        found.append(np.fromiter(map(get, words, repeat(-1)), np.int64, len(words)))
    lengths, terms = np.array(counts, np.int64), np.concatenate(found)
    known = np.flatnonzero(terms >= 0)
    size = max(len(vocabulary), 1)
    keys, tf = np.unique(np.repeat(np.arange(len(texts)), lengths)[known] * size + terms[known], return_counts=True)
    return lengths, keys // size, keys % size, tf


class DualSorted:
    """Postings of one shard: lists by falling impact, and the wavelet matrix of their document numbers with the impacts carried along."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, documents: int, terms: int) -> None:
        order = np.lexsort((doc, -impact, term))
        row, carried = doc[order], impact[order]
        self.begin = np.searchsorted(term[order], np.arange(terms + 1))
        self.depth = max(1, (documents - 1).bit_length())
        n = len(row)
        self.ones = np.zeros((self.depth, n + 1), np.int32)
        self.zeros = np.zeros(self.depth, np.int64)
        self.impact = np.zeros((self.depth + 1, n), np.int32)
        self.impact[0] = carried
        for level in range(self.depth):
            bit = (row >> (self.depth - 1 - level)) & 1
            np.cumsum(bit, out=self.ones[level, 1:])
            self.zeros[level] = n - int(self.ones[level, n])
            stable = np.concatenate((np.flatnonzero(bit == 0), np.flatnonzero(bit)))
            row, carried = row[stable], carried[stable]
            self.impact[level + 1] = carried


@dataclass
class Nodes:
    """Tree nodes of items: the first document number below (its bits so far), the bound, and for each term with postings there its range and weight."""

    item: np.ndarray
    level: np.ndarray
    prefix: np.ndarray
    bound: np.ndarray
    first: np.ndarray
    """Where each node's ranges begin, one entry more than nodes."""
    low: np.ndarray
    high: np.ndarray
    weight: np.ndarray

    def take(self, which: np.ndarray) -> Nodes:
        n = self.first[which + 1] - self.first[which]
        first = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(self.first[which] - first[:-1], n) + np.arange(first[-1])
        return Nodes(self.item[which], self.level[which], self.prefix[which], self.bound[which], first, self.low[at], self.high[at], self.weight[at])


def together(parts: list[Nodes]) -> Nodes:
    firsts, at = [np.zeros(1, np.int64)], 0
    for p in parts:
        firsts.append(p.first[1:] + at)
        at += p.first[-1]
    names = ("item", "level", "prefix", "bound")
    joined = [np.concatenate([getattr(p, x) for p in parts]) for x in names]
    return Nodes(*joined, np.concatenate(firsts), *(np.concatenate([getattr(p, x) for p in parts]) for x in ("low", "high", "weight")))


def _nodes(tree: DualSorted, owner: np.ndarray, item: np.ndarray, level: np.ndarray, prefix: np.ndarray, low: np.ndarray, high: np.ndarray, weight: np.ndarray) -> Nodes:
    """Nodes out of rows of ranges, owner telling the node (ascending) of each; nodes without postings are left out."""
    some = np.flatnonzero(low < high)
    owner, low, high, weight = owner[some], low[some], high[some], weight[some]
    begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    which = owner[begins]
    gain = weight * tree.impact[level[owner], low].astype(np.int64)
    bound = np.add.reduceat(gain, begins) if len(begins) else np.zeros(0, np.int64)
    return Nodes(item[which], level[which], prefix[which], bound, np.concatenate((begins, [len(owner)])), low, high, weight)


def roots(tree: DualSorted, item: np.ndarray, term: np.ndarray, weight: np.ndarray) -> Nodes:
    n = int(item.max(initial=-1)) + 1
    zero = np.zeros(n, np.int64)
    return _nodes(tree, item, np.arange(n), zero, zero, tree.begin[term], tree.begin[term + 1], weight)


def children(tree: DualSorted, nodes: Nodes) -> Nodes:
    """Both children of each node, as far as they have postings."""
    sizes = np.diff(nodes.first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    level = nodes.level[owner]
    low1, high1 = tree.ones[level, nodes.low].astype(np.int64), tree.ones[level, nodes.high].astype(np.int64)
    zeros = tree.zeros[level]
    down = nodes.level + 1
    left = _nodes(tree, owner, nodes.item, down, nodes.prefix, nodes.low - low1, nodes.high - high1, nodes.weight)
    bit = np.left_shift(np.int64(1), tree.depth - down)
    right = _nodes(tree, owner, nodes.item, down, nodes.prefix + bit, zeros + low1, zeros + high1, nodes.weight)
    return together([left, right])


class Best:
    """The k best (score, document) of each item so far; ties go to the smaller document id."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.item, self.score, self.key = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.ones(items, np.int64)
        """A score below this is not among the k best of the item: 1 as long as there are fewer."""

    def add(self, item: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        item, score, key = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.key, key)))
        order = np.lexsort((key, -score, item))
        item, score, key = item[order], score[order], key[order]
        begin = np.searchsorted(item, item)
        rank = np.arange(len(item)) - begin
        last = np.flatnonzero(rank == self.k - 1)
        self.least[item[last]] = np.maximum(self.least[item[last]], score[last])
        kept = rank < self.k
        self.item, self.score, self.key = item[kept], score[kept], key[kept]


def search(tree: DualSorted, keys: np.ndarray, item: np.ndarray, term: np.ndarray, weight: np.ndarray, best: Best, at: int = 0) -> int:
    """Adds the shard's documents to best, whose item numbers begin with at for the ones given here. Returns the number of nodes opened."""
    start = roots(tree, item, term, weight)
    open_ = [start.take(np.flatnonzero(start.bound >= best.least[start.item + at]))]
    width, opened = FIRST_OPENED, 0
    while any(len(p.item) for p in open_):
        of = np.concatenate([p.item for p in open_])
        bound = np.concatenate([p.bound for p in open_])
        part = np.repeat(np.arange(len(open_)), [len(p.item) for p in open_])
        order = np.lexsort((-bound, of))
        rank = np.empty(len(of), np.int64)
        rank[order] = np.arange(len(of)) - np.searchsorted(of[order], of[order])
        chosen, going, kept = rank < width, [], []
        for i, p in enumerate(open_):
            mine = chosen[part == i]
            going.append(p.take(np.flatnonzero(mine)))
            kept.append((p, ~mine))
        down = together(going)
        opened += len(down.item)
        down = children(tree, down)
        leaf = down.level == tree.depth
        found = np.flatnonzero(leaf & (down.bound > 0))
        best.add(down.item[found] + at, down.bound[found], keys[down.prefix[found]])
        kept.append((down, ~leaf))
        open_ = []
        for p, stays in kept:
            stays = stays & (p.bound >= best.least[p.item + at])
            if stays.any():
                open_.append(p if stays.all() else p.take(np.flatnonzero(stays)))
        width *= 2
    return opened


def impacts(tf: np.ndarray, lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """A posting's impact out of its frequency and its document's length, in whole numbers below 10^6."""
    m = 100 - 75 + (75 * lengths * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight_of(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def blocks(items: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """(id, text) of the items in blocks of about limit characters. Rows that share an id are one item with the terms of its different texts."""
    whole = items.groupBy(F.col(item).cast("string").alias("id")).agg(F.array_join(F.sort_array(F.collect_set(text)), " ").alias("text"))
    block: list[tuple[str | None, str | None]] = []
    size = 0
    for name, body in whole.toLocalIterator():
        if block and size + len(body or "") > limit:
            yield block
            block, size = [], 0
        block.append((name, body))
        size += len(body or "")
    if block:
        yield block


def _statistics(docs: DataFrame, shared, text: str) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and the documents that hold each term of the block: one row a term from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary
        df = np.zeros(len(vocabulary), np.int64)
        n = total = 0
        for batch in slices(batches):
            lengths, _, term, _ = postings(vocabulary, [flat(t) for t in column(batch, text)])
            df += np.bincount(term, minlength=len(df))
            n, total = n + int((lengths > 0).sum()), total + int(lengths.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([_DOCUMENTS, _TERMS], some))), pa.array(np.concatenate(([n, total], df[some])))], names=["term", "n"])

    df = np.zeros(len(shared.value.vocabulary), np.int64)
    sums = dict(docs.select(text).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    n, total = int(sums.pop(_DOCUMENTS, 0)), int(sums.pop(_TERMS, 0))
    for term, value in sums.items():
        df[term] = value
    return n, total, df


def top(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item, rank (from 1), key and score of each item's k best documents with a score above 0; equal scores by ascending key.

    Keys are whole numbers; a null one comes last and stays null. Null texts have no terms, repeated rows of docs are documents of their own, and items
    that share an id are one. Other columns are left out; without documents or items there are no rows. What a task holds is one shard's
    tree and the k best of each item of a block; it returns at most k rows an item.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    kind = items.schema[item].dataType
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("key", T.LongType()), T.StructField("score", T.LongType())])
    found = []
    for block in blocks(items, item, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(items_of(block))
        n, total, df = _statistics(rows, shared, "_text")
        weights = spark.sparkContext.broadcast(np.array([weight_of(n, int(d)) if d else 0 for d in df], np.int64))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, weights=weights, n=n, total=total) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            weight = asked.times * weights.value[asked.term]
            best = Best(len(asked.ids), k)
            for batch in slices(batches):
                ids = batch.column(0)
                keys = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
                order = np.argsort(keys, kind="stable")
                texts = column(batch, "_text")
                lengths, doc, term, tf = postings(asked.vocabulary, [flat(texts[i]) for i in order])
                if len(doc):
                    tree = DualSorted(doc, term, impacts(tf, lengths[doc], n, total), len(keys), len(asked.vocabulary))
                    for a in range(0, len(asked.ids), ITEMS_AT_ONCE):
                        low, high = np.searchsorted(asked.item, [a, a + ITEMS_AT_ONCE])
                        search(tree, keys[order], asked.item[low:high] - a, asked.term[low:high], weight[low:high], best, a)
            names = pa.array([asked.ids[i] for i in best.item.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(best.key, mask=best.key == _LAST), pa.array(best.score)], schema=pa.schema([("item", pa.string()), ("key", pa.int64()), ("score", pa.int64())]))

        found.append(rows.mapInArrow(run, schema))
    best = found[0] if found else spark.createDataFrame([], schema)
    for more in found[1:]:
        best = best.unionAll(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").cast(kind).alias(item), "rank", F.col("key").alias(key), "score")
