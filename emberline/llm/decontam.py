"""Benchmark decontamination: an FM-index of each shard of training documents, searched for windows of benchmark items.

A word is `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case. A window is `window` consecutive words of an
item; an item of fewer words, but not none, is one window. A shard is a part of an Arrow batch. A word that no item
has cannot be in a window, so of the shard only runs of item words go into the index, and only runs as long as the shortest window:
the index is small and the result the same. Nothing is shuffled. The items are a stated query set: they go to the tasks in
blocks of about block_bytes text, each a broadcast of its own. With more than one block the documents are gone through once a block, and
take what was found so far along from one written table to the next.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, column, written
from .fmindex import FMIndex

WINDOW = 10
BLOCK_BYTES = 16 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_WORDS_ONLY = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass
class Phrases:
    vocabulary: dict[bytes, int]
    windows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]
    """Ids of the items that have each window."""
    shortest: int


def flat(text: str | None) -> bytes:
    """The text's bytes with A-Z in lower case and a space for all that is not in a word."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS_ONLY)


def phrases(items: list[tuple[str, str | None]], window: int = WINDOW) -> Phrases:
    """Windows of (id, text) items; rows that share an id are one item."""
    vocabulary: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
    for name, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in flat(text).split()]
        for i in range(max(1, len(ids) - window + 1) if ids else 0):
            owners[tuple(ids[i : i + window])].add(name)
    found = list(owners)
    table = np.zeros((len(found), window), np.int64)
    for i, w in enumerate(found):
        table[i, : len(w)] = w
    lengths = np.array([len(w) for w in found], np.int64)
    return Phrases(vocabulary, table, lengths, [sorted(owners[w]) for w in found], int(lengths.min(initial=window)))


def find(p: Phrases, texts: list[bytes]) -> tuple[list[int], dict[int, np.ndarray], dict[int, set[str]]]:
    """Of flat texts: number of words each, and for those with hits the mask of hit words and the items found."""
    get, counts, owner, starts, runs = p.vocabulary.get, [], [], [], []
    for k, t in enumerate(texts):
        words = t.split()
        counts.append(len(words))
        if len(words) < p.shortest or not len(p.lengths):
            continue
        ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        known = np.concatenate(([False], ids > 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a >= p.shortest:
                owner.append(k), starts.append(a), runs.append(ids[a:b])
    masks: dict[int, np.ndarray] = {}
    items: dict[int, set[str]] = defaultdict(set)
    if runs:
        index = FMIndex(runs)
        low, high = index.search(p.windows, p.lengths)
        times = high - low
        which = np.repeat(np.arange(len(times)), times)
        rows = np.repeat(low - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
        begin = np.concatenate(([0], np.cumsum([len(r) + 1 for r in runs])))
        places = index.locate(rows)
        run = np.searchsorted(begin, places, side="right") - 1
        for w, r, at in zip(which.tolist(), run.tolist(), (places - begin[run]).tolist(), strict=True):
            k = owner[r]
            if k not in masks:
                masks[k] = np.zeros(counts[k], bool)
            masks[k][starts[r] + at : starts[r] + at + p.lengths[w]] = True
            items[k].update(p.items[w])
    return counts, masks, items


def spans(text: str, mask: np.ndarray) -> list[tuple[int, int]]:
    """Code points [start, end) that the hit words cover; neighbouring hit words make one span."""
    data = flat(text)
    point = np.concatenate(([0], np.cumsum((np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80)))
    edges = np.array([m.span() for m in _WORD.finditer(data)]).reshape(-1, 2)
    change = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [(int(point[edges[a, 0]]), int(point[edges[b - 1, 1]])) for a, b in zip(change[::2], change[1::2], strict=True)]


def cut(p: Phrases, texts: list[str | None], found: dict[int, np.ndarray]) -> dict[int, str]:
    """The texts with hits, without the hit spans. What a cut brings together is searched again until nothing is found."""
    out = {k: texts[k] or "" for k in found}
    while found:
        for k, mask in found.items():
            text, kept, last = out[k], [], 0
            for a, b in spans(text, mask):
                kept.append(text[last:a])
                last = b
            out[k] = "\n".join(x for x in (y.strip() for y in [*kept, text[last:]]) if x)
        again = list(found)
        _, masks, _ = find(p, [flat(out[k]) for k in again])
        found = {again[i]: m for i, m in masks.items()}
    return out


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of about limit characters of text, read one after the other; a null id is taken as 'null'. At least one block."""
    block: list[tuple[str, str | None]] = []
    size = 0
    for name, body in benchmark.selectExpr(f"coalesce(cast(`{item}` as string), 'null')", f"`{text}`").toLocalIterator():
        if block and size + len(body or "") > limit:
            yield block
            block, size = [], 0
        block.append((name, body))
        size += len(body or "")
    yield block


_MASK, _ITEMS = "_hit_words", "_hit_items"
_FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
]


def _passes(docs: DataFrame, benchmark: DataFrame, item: str, item_text: str, window: int, block_bytes: int, one: Callable[[DataFrame, Broadcast, bool], DataFrame]) -> DataFrame:
    """docs after one(docs, phrases, is_last) for each block; a written table between two, so that one block is held at a time."""
    ahead = blocks(benchmark, item, item_text, block_bytes)
    block = next(ahead)
    while block is not None:
        following = next(ahead, None)
        shared = docs.sparkSession.sparkContext.broadcast(phrases(block, window))
        docs = one(docs, shared, following is None)
        if following is not None:
            docs = written(docs, "block")
            shared.destroy()
        block = following
    return docs


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit (words in an occurrence of a window), items (ids of the items with occurring windows, sorted as
    strings), hit_spans (code points [start, end) of runs of hit words), items_sha256 (of the ids joined with commas) and
    contaminated (n_hit > 0).

    A null text has no words. An empty benchmark hits nothing. A very long text is searched whole; only its runs of item words are indexed. Input columns with these
    names are replaced; all others stay, as do repeated rows, and an empty table gives no rows.
    """

    def one(df: DataFrame, shared: Broadcast, last: bool) -> DataFrame:
        going_on = _MASK in df.columns

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = column(batch, text)
            counts, masks, items = find(shared.value, [flat(t) for t in texts])
            if going_on:
                for k, (bits, ids) in enumerate(zip(column(batch, _MASK), column(batch, _ITEMS), strict=True)):
                    if ids:
                        before = np.unpackbits(np.frombuffer(bits, np.uint8), count=counts[k]).astype(bool)
                        masks[k] = masks[k] | before if k in masks else before
                        items[k] = set(items.get(k, ())) | set(ids)
            ids = [sorted(items.get(k, ())) for k in range(len(texts))]
            if not last:
                return [pa.array([np.packbits(masks[k]).tobytes() if k in masks else None for k in range(len(texts))], pa.binary()), pa.array(ids, pa.list_(pa.string()))]
            hit = [int(masks[k].sum()) if k in masks else 0 for k in range(len(texts))]
            where = [spans(texts[k], masks[k]) if k in masks else [] for k in range(len(texts))]
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]
            return [pa.array(counts, pa.int64()), pa.array(where, pa.list_(pa.list_(pa.int32()))), pa.array(hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(sha, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())]

        fields = _FIELDS if last else [T.StructField(_MASK, T.BinaryType()), T.StructField(_ITEMS, T.ArrayType(T.StringType()))]
        return append_columns(df, run, fields)

    return _passes(docs, benchmark, item, item_text, window, block_bytes, one).drop(_MASK, _ITEMS)


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the hit spans cut out of the text, so that no window occurs in it any more; other rows are unchanged.

    Null texts stay null, repeated rows are cut alike, and an empty table gives no rows.
    With more than one block, what one block's cuts bring together may be another's window: rounds go on until one cuts nothing.
    """
    changed = "_cut"
    several = False

    def one(df: DataFrame, shared: Broadcast, last: bool) -> DataFrame:
        nonlocal several
        several |= not last

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = column(batch, text)
            _, masks, _ = find(shared.value, [flat(t) for t in texts])
            done = cut(shared.value, texts, masks)
            before = column(batch, changed) if changed in batch.schema.names else [False] * len(texts)
            return [pa.array([done.get(k, t) for k, t in enumerate(texts)], pa.string()), pa.array([x or k in done for k, x in enumerate(before)], pa.bool_())]

        return append_columns(df, run, [T.StructField(text, T.StringType()), T.StructField(changed, T.BooleanType())])

    out = _passes(docs, benchmark, item, item_text, window, block_bytes, one)
    while several:
        out = written(out, "round")
        if not out.where(changed).limit(1).count():
            break
        out = _passes(out.drop(changed), benchmark, item, item_text, window, block_bytes, one)
    return out.select(docs.columns)
