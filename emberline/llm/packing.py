"""Packing tokenised documents into sequences of a fixed length by patterns of a few documents.

1. Documents are tokenised once (tasks over Arrow batches), cut into pieces and written with their token ids' checksum.
2. The pieces' length histogram - one number for each length, whatever the corpus size - goes to the driver.
3. Lengths are grouped into bins; all patterns of a few bins that fill a sequence are enumerated, and non-negative least squares fits how
   often each is used. Counts are rounded and exact lengths dealt to the patterns, such that a sequence is full or nearly so. What is left
   is fitted again, with a little more slack when nothing more is gained.
4. The residual pieces - short ones, kept for this, and what no pattern placed - go, longest first, into the tightest room left, over
   counts of lengths rather than single pieces.
5. The plan is a list of runs (length, first rank, count, first sequence, offset). Each piece gets its gapless rank among those of
   its length and looks its run up in the broadcast plan, whose size depends on the sequence length alone.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, column, gapless_rank, hash60, slices, written

SEQUENCE = 2048
MOST = 10
"""Pieces of a pattern."""
MAX_RUNS = 2_000_000
"""Bound of the broadcast plan; 40 bytes each."""
_LONG_SPACE = re.compile(r"(?<!\s)\s{100000}")
"""White space that tiktoken's pattern may run out of stack on; tried at the start of a run only."""


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids of a byte-level BPE file of the tokenizers library.

    The file's own library encodes any text; texts of Latin script take its merges through tiktoken, which gives the same ids
    several times faster. Letters of other scripts may be classed differently by the two libraries' Unicode tables, and tiktoken
    fails on very long white space.
    """
    import tiktoken
    from tokenizers import Tokenizer

    spec = json.load(open(path, encoding="utf-8"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(shown[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    whole = Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        if (text.isascii() or max(text) < "ɐ") and not _LONG_SPACE.search(text):
            ids = fast.encode(text, allowed_special="all", disallowed_special=()) if "<|" in text else fast.encode_ordinary(text)
        else:
            ids = whole.encode(text, add_special_tokens=False).ids
        return np.array([*ids, 0], "<u4")

    return encode


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, if with_ids the token ids, and _row, a number of its own.

    A document is its text's ids and a closing id 0, so a null or empty text is one piece of length 1. Documents longer than a
    sequence are cut from the end into whole sequences; the first piece is what remains. Repeated rows are documents of their own.
    """
    fields = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("_text"))
    schema = T.StructType([rows.schema[0], *fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in slices(batches):
            row, number, start, length, crc, ids = [], [], [], [], [], []
            for i, t in enumerate(column(batch, "_text")):
                all_ids = encode(t or "")
                edges = [0, *range((len(all_ids) - 1) % sequence + 1, len(all_ids) + 1, sequence)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    row.append(i), number.append(k), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(all_ids[a:b].tobytes()))
                    if with_ids:
                        ids.append(all_ids[a:b].astype(np.int32))
            out = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=schema.fieldNames())

    return rows.mapInArrow(cut, schema).withColumn("_row", F.monotonically_increasing_id())


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by Lawson and Hanson's active set method; at most as many entries as rows are not zero."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, np.abs(b).max(initial=0)) * a.shape[0]
    for _ in range(rounds or 6 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= tolerance:
            break
        passive[best] = True
        while True:
            at = np.flatnonzero(passive)
            some = a[:, at]
            square = some.T @ some
            # Columns that depend on each other share their weight.
            square[np.diag_indices(len(at))] += 1e-9
            z = np.linalg.solve(square, some.T @ b)
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            down = z <= 0
            step = np.min(x[at][down] / np.maximum(x[at][down] - z[down], 1e-300))
            x[at] += step * (z - x[at])
            gone = at[down & (x[at] <= tolerance * 1e-3)]
            gone = gone if len(gone) else at[down][[int(np.argmin(x[at][down]))]]
            x[gone], passive[gone] = 0, False
            if not passive.any():
                break
    return x


def patterns(bins: int, used: np.ndarray, most: int = MOST) -> list[tuple[int, ...]]:
    """Bins (1 to bins, of those in use) of up to `most` pieces that together fill a sequence of that many bins, largest first.

    Up to two bins and copies of a smaller third one. Lengths are half a bin below their bin's end on average, so two pieces have one
    bin more than a sequence, and so on.
    """
    have = [int(b) for b in np.flatnonzero(used) if b]
    known = set(have)
    out: list[tuple[int, ...]] = []
    for copies in range(1, most + 1):
        for c in have:
            rest = bins + (15 * copies + 16) // 32 - copies * c
            if rest == 0:
                out.append((c,) * copies)
            if copies < most and (a := rest + _more(copies, 1)) > c and a in known:
                out.append((a, *(c,) * copies))
            both = rest + _more(copies, 2)
            if copies < most - 1:
                out += [(both - b, b, *(c,) * copies) for b in have if c < b <= both - b and both - b in known]
    return out


def _more(copies: int, others: int) -> int:
    """Bins that `others` pieces more add to what a full sequence of so many copies may have."""
    return (15 * (copies + others) + 16) // 32 - (15 * copies + 16) // 32


def _exact(pattern: tuple[int, ...], left: np.ndarray, bin_width: int, slack: int) -> list[int] | None:
    """Lengths that are left, one in each bin of the pattern, whose sum is a full sequence or up to slack less; None if there are none."""
    sequence = len(left) - 1
    used: Counter[int] = Counter()

    def ends(b: int) -> tuple[int, int]:
        return (b - 1) * bin_width + 1, min(b * bin_width, sequence)

    def spare(low: int, high: int) -> np.ndarray:
        out = left[low : high + 1].copy()
        for x, n in used.items():
            if low <= x <= high:
                out[x - low] //= n + 1
        return out

    # All but two take their bins' most frequent lengths; the two are searched for the sum.
    for b in pattern[2:]:
        low, high = ends(b)
        n = spare(low, high)
        if not n.any():
            return None
        used[low + int(n.argmax())] += 1
    need = sequence - sum(used.elements())
    low, high = ends(pattern[0])
    if len(pattern) == 1:
        return next(([x] for x in range(min(high, need), max(low, need - slack) - 1, -1) if left[x]), None)
    first, (low2, high2) = spare(low, high), ends(pattern[1])
    second = spare(low2, high2)
    one = np.arange(low, high + 1)
    for gap in range(slack + 1):
        other = need - gap - one
        fits = (other >= low2) & (other <= high2)
        n = np.where(fits, np.minimum(first, second[np.clip(other - low2, 0, len(second) - 1)]), 0)
        n = np.where(fits & (one == other), first // 2, n)
        if n.any():
            i = int(n.argmax())
            return [int(one[i]), int(other[i]), *used.elements()]
    return None


def plan(histogram: dict[int, int], sequence: int = SEQUENCE, bin_width: int = 16) -> tuple[list[tuple[int, int, int, int, int]], int, int]:
    """Runs (length, first rank, count, first sequence, offset), the number of sequences and how many pieces patterns placed.

    Piece number `first rank + i` of that length goes to sequence `first sequence + i` at the offset. Every piece of the
    histogram is in one run. Patterns leave at most bin_width tokens of a sequence empty, and only once none is found that leaves
    less; pieces of up to a 64th of a sequence are no part of them.
    """
    left = np.zeros(sequence + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    runs: list[tuple[int, int, int, int, int]] = []
    rank = np.zeros(sequence + 1, np.int64)
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    sizes: list[int] = []
    sequences = dealt = 0

    def place(length: int, count: int, first: int, offset: int) -> None:
        runs.append((length, int(rank[length]), count, first, offset))
        rank[length] += count
        left[length] -= count

    def free(space: int, first: int, count: int) -> None:
        if space:
            if not room[space]:
                bisect.insort(sizes, space)
            room[space].append((first, count))

    # Whole sequences need no partner.
    if left[sequence]:
        n = int(left[sequence])
        place(sequence, n, sequences, 0)
        sequences += n
    bins = -(-sequence // bin_width)
    of = -(-np.arange(sequence + 1) // bin_width)
    slack = 0
    while True:
        target = np.bincount(of, weights=left, minlength=bins + 1)
        target[: sequence // 64 // bin_width + 1] = 0
        gained = 0
        if choices := patterns(bins, target > 0):
            matrix = np.zeros((bins + 1, len(choices)))
            for j, p in enumerate(choices):
                for b in p:
                    matrix[b, j] += 1
            # Short pieces fill gaps anyway, so missing them costs little.
            weight = np.where(np.arange(bins + 1) * 8 < bins, 0.1, 1.0)
            fitted = nonnegative_least_squares(matrix * weight[:, None], target * weight)
            times = np.where(fitted >= 1, np.floor(fitted + 1e-6), fitted > 0.25).astype(np.int64)
            for j in sorted(np.flatnonzero(times), key=lambda j: (-times[j], choices[j])):
                todo = int(times[j])
                while todo and (lengths := _exact(choices[j], left, bin_width, slack)):
                    count = min(todo, *(int(left[x]) // n for x, n in Counter(lengths).items()))
                    offset = 0
                    for x in lengths:
                        place(x, count, sequences, offset)
                        offset += x
                    free(sequence - offset, sequences, count)
                    sequences += count
                    todo -= count
                    gained += count * len(lengths)
        dealt += gained
        # Fits go on until they gain less than a fiftieth of what is left.
        if 50 * gained <= int(left.sum()):
            if slack >= bin_width:
                break
            slack = max(1, 2 * slack)
    for length in range(sequence, 0, -1):
        while left[length]:
            k = bisect.bisect_left(sizes, length)
            if k == len(sizes):
                per, n = sequence // length, int(left[length])
                whole, rest = divmod(n, per)
                for count, copies in ((whole, per), (1 if rest else 0, rest)):
                    if count:
                        for c in range(copies):
                            place(length, count, sequences, c * length)
                        free(sequence - copies * length, sequences, count)
                        sequences += count
                continue
            space = sizes[k]
            first, count = room[space].pop()
            if not room[space]:
                sizes.pop(k)
            used = min(count, int(left[length]))
            place(length, used, first, sequence - space)
            free(space - length, first, used)
            if count > used:
                free(space, first + used, count - used)
    return runs, sequences, dealt


def pack(parts: DataFrame, key: str = "doc_id", sequence: int = SEQUENCE) -> DataFrame:
    """parts (see `pieces`; a written table, so that _row stays what it is) with sequence_id and offset: place in the sequence, gapless from 0."""
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}
    runs = plan(counts, sequence)[0]
    if len(runs) > MAX_RUNS:
        raise ValueError(f"the plan has {len(runs)} runs")
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    shared = parts.sparkSession.sparkContext.broadcast(table)
    rows = parts.withColumn("_one", F.lit(1).cast("long")).withColumn("_spread", hash60(F.col("_row")))
    rows = gapless_rank(rows, ["length"], "_spread", ["_row"], "_one").drop("_one", "_spread", "_row")

    def look_up(batch: pa.RecordBatch) -> list[pa.Array]:
        t = shared.value
        length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
        rank = batch.column(batch.schema.get_field_index("first")).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(length):
            return [pa.array([], pa.int64())] * 2
        at = np.searchsorted(t[:, 0] * (1 << 48) + t[:, 1], length * (1 << 48) + rank, side="right") - 1
        return [pa.array(t[at, 3] + rank - t[at, 1]), pa.array(t[at, 4])]

    return append_columns(rows, look_up, [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]).drop("first")


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Tokenises, cuts and packs docs; see `pieces` and `pack`. An empty table gives no rows; a null key is kept, and other columns are left out.

    A very long text is one row of its task until it is cut; its pieces, and those of repeated rows or keys, are placed by different tasks.
    """
    return pack(written(pieces(docs, tokenizer, key, text, sequence, with_ids), "pieces"), key, sequence)
