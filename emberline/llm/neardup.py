"""Near-duplicates by an inverted join over the coordinates of MinHash signatures.

1. Each document's word shingles give its set's size, a 128-bit fingerprint of the set and a signature of COORDINATES minima. Documents of
   one fingerprint are one class and stay one row from here on, however many copies there are.
2. Classes are posted under the (coordinate, value) pairs of their first POSTED coordinates. Two classes that agree on at least
   `matches` of those agree on one of any POSTED - matches + 1, so each class is posted under its rarest ones only (prefix). Values
   that one class has alone count as posted and make no row.
3. In each posting list one class - that with the most company in its lists - is compared with the others, so a list gives as many
   pairs as it has rows. Confirmed pairs are merged into components.
4. Lists that still hold several components are compared across components, long lists in blocks dealt over tasks. A block is a part of
   a band of set sizes and meets its own and the next band only, as sets of other bands are too unlike in size: collisions over
   whole signatures are counted in numpy, in descending order, and a pair that links found by then connect is skipped. Sets of up to
   CARRIED shingles come along and settle their pairs there, so a block gives at most as many links as it has classes. Other pairs are
   given once, by the first list that both share. Nothing is capped: each pair with enough collisions is compared or already connected.
5. Those pairs are confirmed on the full shingle sets, which are made again for the classes that need it.

A pair at a threshold of 0.85 agrees on fewer than 14 of 32 posted coordinates with probability 1e-8, on fewer than 86 of 128 with 1.3e-7
(binomial tails); more similar pairs are missed less.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, chunks, column, mixed, slices, written
from .components import components
from .words import Words, utf8, windows

COORDINATES = 128
POSTED = 32
MATCHES = (14, 86)
"""Collisions that a pair needs: among the posted coordinates, and among all."""
BLOCK = 2000
CARRIED = 512
"""Sets of up to so many shingles, 4 KB, are compared where lists meet; the pairs of larger ones are joined with their sets."""
BROADCAST_ROWS = 1_000_000
"""Up to so many 8-byte keys are broadcast to find the texts to confirm; more are joined by a shuffle."""
_SEEDS = mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles; of a shorter text, one of the whole sequence."""
    data = [utf8(t, lower=True) for t in texts]
    out: list[np.ndarray] = []
    for a, b in chunks(data):
        words = Words(data[a:b])
        every = windows(words.hash, n)
        for i in range(b - a):
            first, last = words.first[i], words.first[i + 1]
            if last - first >= n:
                h = np.sort(every[first : last - n + 1])
                out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
            elif last > first:
                out.append(windows(words.hash[first:last], int(last - first)) ^ np.uint64(last - first))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def profiles(docs: DataFrame, text: str, n: int) -> DataFrame:
    """docs with n_shingles, set_id (null for an empty set) and signature; the text goes."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        sets = shingle_sets(column(batch, text), n)
        sizes, ids, rows = [len(s) for s in sets], [], []
        for a, b in chunks(sets):
            full = [i for i in range(a, b) if sizes[i]]
            joined = np.concatenate([sets[i] for i in full] or [np.zeros(0, np.uint64)])
            at = np.concatenate(([0], np.cumsum([sizes[i] for i in full])))[:-1].astype(np.int64)
            if full:
                prints = np.stack([np.add.reduceat(mixed(joined), at), np.add.reduceat(mixed(joined ^ _SEEDS[-1]), at)], axis=1)
                minima = np.stack([np.minimum.reduceat(joined * _SEEDS[k] + _SEEDS[COORDINATES + k - 1], at) for k in range(COORDINATES)], axis=1)
                # Half of a hash of the minimum tells minima apart well enough.
                minima = (mixed(minima) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            k = 0
            for i in range(a, b):
                ids.append(prints[k].tobytes() if sizes[i] else None)
                rows.append(minima[k] if sizes[i] else None)
                k += sizes[i] > 0
        return [pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(rows, pa.list_(pa.int32()))]

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType()), T.StructField("signature", T.ArrayType(T.IntegerType()))]
    return append_columns(docs, run, fields).drop(text)


def _postings(classes: DataFrame, matches: int) -> DataFrame:
    """(value, cls) rows: each class under its rarest coordinates, as many as the prefix needs. value is the coordinate and its value."""
    posted = classes.select("cls", F.posexplode(F.slice("signature", 1, POSTED)).alias("k", "v"))
    posted = posted.select("cls", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("v").cast("long") + (1 << 31)).alias("value"))
    shared = written(posted.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"), "values")
    # Only lists of at least two classes are rows here; the others stand for the prefix's first places.
    rows = posted.join(shared, "value").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("of"))
    need = F.size("of") - (matches - 1)
    company = F.aggregate("of.n", F.lit(0).cast("long"), lambda a, n: a + n)
    return written(rows.where(need > 0).select("cls", F.slice("of.value", F.lit(1), need).alias("prefix"), company.alias("company")), "prefixes")


def _collide(pairs: DataFrame, classes: DataFrame, matches: int, share: float) -> DataFrame:
    """The (a, b) pairs whose signatures agree on enough coordinates and whose sizes allow the similarity."""
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("cls").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("signature").alias(f"s{side}")), side)
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return pairs.where((F.least("na", "nb") >= share * F.greatest("na", "nb")) & (agree >= matches)).select("a", "b")


def _cross_links(lists: DataFrame, matches: int, share: float, percent: int) -> DataFrame:
    """(a, b, sure) for classes of different components that meet in a block of a list and agree on enough coordinates. sure: confirmed.

    Rows of a block come one after the other; a block is at most two parts of about BLOCK classes, so what a worker holds is bounded.
    """

    def within(k: int, diagonal: bool, cls: np.ndarray, root: np.ndarray, part: np.ndarray, size: np.ndarray, sig: np.ndarray, mask: np.ndarray, sets: Callable[[int], np.ndarray]) -> list[tuple[int, int, bool]]:
        names, number, times = np.unique(root, return_inverse=True, return_counts=True)
        parent = list(range(len(names)))
        carried: dict[int, np.ndarray] = {}
        out: list[tuple[int, int, bool]] = []

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def carry(i: int) -> np.ndarray:
            if i not in carried:
                carried[i] = sets(i)
            return carried[i]

        # Rows outside the most common component take part in all pairs that count.
        common = number == times.argmax()
        outer = np.flatnonzero(~common)
        step = max(1, (1 << 20) // len(cls))
        for i0 in range(0, len(outer), step):
            i = outer[i0 : i0 + step]
            fit = (number[i][:, None] != number[None, :]) & (np.minimum(size[i][:, None], size[None, :]) >= share * np.maximum(size[i][:, None], size[None, :]))
            if not diagonal:
                fit &= part[i][:, None] != part[None, :]
            # Of two outer rows the pair is taken once.
            fit &= common[None, :] | (cls[i][:, None] < cls[None, :])
            a, b = np.nonzero(fit)
            a = i[a]
            found = []
            for j0 in range(0, len(a), 1 << 15):
                p, q = a[j0 : j0 + (1 << 15)], b[j0 : j0 + (1 << 15)]
                same = sig[p] == sig[q]
                n = same.sum(1)
                good = n >= matches
                first = (same[good][:, :POSTED] & mask[p[good]] & mask[q[good]]).argmax(1) == k
                found.append((n[good][first], p[good][first], q[good][first]))
            n, p, q = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
            by = np.argsort(-n, kind="stable")
            for x, y in zip(p[by].tolist(), q[by].tolist(), strict=True):
                u, v = find(number[x]), find(number[y])
                if u == v:
                    continue
                pair = (int(min(cls[x], cls[y])), int(max(cls[x], cls[y])))
                if size[x] > CARRIED or size[y] > CARRIED:
                    out.append((*pair, False))
                    continue
                both = len(np.intersect1d(carry(x), carry(y), assume_unique=True))
                if 100 * both >= percent * (int(size[x]) + int(size[y]) - both):
                    parent[u] = v
                    out.append((*pair, True))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
            value, x, y, cls, root, part, size = (table.column(c).to_numpy() for c in ("value", "x", "y", "cls", "root", "block", "n_shingles"))
            ends = np.append(np.flatnonzero((value[1:] != value[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1, len(value))
            ends = ends if last else ends[:-1]
            done = int(ends[-1]) if len(ends) else 0
            out: list[tuple[int, int, bool]] = []
            if done:
                whole = table.slice(0, done).combine_chunks()
                sig = whole.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
                prefix, sets = whole.column("prefix").combine_chunks(), whole.column("shingles").combine_chunks()
                mask = np.zeros((done, POSTED), bool)
                mask[np.repeat(np.arange(done), prefix.value_lengths().to_numpy()), prefix.flatten().to_numpy() >> 32] = True
                begin = 0
                for end in ends:
                    s = slice(begin, end)
                    if end - begin > 1:
                        out += within(int(value[begin]) >> 32, x[begin] == y[begin], cls[s], root[s], part[s], size[s], sig[s], mask[s], lambda i, at=begin: sets[at + i].values.to_numpy())
                    begin = end
            a, b, sure = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure, pa.bool_())], names=["a", "b", "sure"]), table.slice(done)

        waiting = None
        for batch in slices(batches):
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                out, waiting = blocks(pa.concat_tables([waiting, table]) if waiting is not None else table, False)
                yield out
        if waiting is not None and waiting.num_rows:
            yield blocks(waiting, True)[0]

    return lists.repartition("value", "x", "y").sortWithinPartitions("value", "x", "y").mapInArrow(run, "a long, b long, sure boolean")


def _blocks(at: DataFrame, share: float) -> DataFrame:
    """Rows of lists with the block of each, once for each pair of blocks (x, y) in which it meets others. Needs value, cls, root and n_shingles.

    Lists of one component are left out. A longer one than BLOCK is cut into bands of set sizes, a factor of 1 / share wide, and those into
    blocks: a set reaches the share with its own band's and the neighbours' only.
    """
    several = at.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low <> high")
    at = at.join(written(several, "lists").select("value", "size"), "value")
    # A little wider than the factor, so that rounding sets no two sizes at the threshold more than a band apart.
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / (max(-math.log(share), 0.01) * (1 + 1e-9))).cast("int")
    at = at.withColumn("band", F.when(F.col("size") > BLOCK, band).otherwise(0)).drop("size")
    bands = written(at.groupBy("value", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "bands")
    # Up to three bands, each with its number of blocks.
    met = bands.select("value", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("seen_by"), F.struct("band", "blocks").alias("met"))
    met = met.groupBy("value", "seen_by").agg(F.collect_list("met").alias("met")).withColumnRenamed("seen_by", "band")
    name = lambda band, k: F.shiftleft(band.cast("long"), 32) + k
    at = at.join(met, ["value", "band"])
    mine = F.aggregate("met", F.lit(0), lambda n, m: n + F.when(m["band"] == F.col("band"), m["blocks"]).otherwise(0))
    at = at.withColumn("block", name(F.col("band"), F.pmod(F.xxhash64("cls"), mine)))
    other = F.flatten(F.transform("met", lambda m: F.transform(F.sequence(F.lit(0), m["blocks"] - 1), lambda k: name(m["band"], k))))
    at = at.withColumn("other", F.explode(other))
    return at.select("value", "cls", "root", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))


def _sets(rows: DataFrame, docs: DataFrame, text: str, n: int) -> DataFrame:
    """row and shingles for the documents whose keys are in the written table rows."""
    if rows.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    needed = docs.select(F.col(text).alias("text"), F.xxhash64(*docs.columns).alias("row")).join(rows, "row", "left_semi").dropDuplicates(["row"])

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([s.view(np.int64) for s in shingle_sets(column(batch, "text"), n)], pa.list_(pa.int64()))]

    return written(append_columns(needed, run, [T.StructField("shingles", T.ArrayType(T.LongType()))]).drop("text"), "sets", "none")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, n: int, percent: int) -> DataFrame:
    """Those of the written pairs whose full sets have percent % of their union in common."""
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("cls").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("row").alias(f"row_{side}")), side)
    rows = written(pairs.select(F.col("row_a").alias("row")).union(pairs.select(F.col("row_b").alias("row"))).distinct(), "rows")
    sets = _sets(rows, docs, text, n)
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("row").alias(f"row_{side}"), F.col("shingles").alias(f"set_{side}")), f"row_{side}")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _grouped(docs: DataFrame, n: int, percent: int, matches: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Of docs (key, text): a written row per row (row, key, n_shingles, set_id), and per class of equal sets (set_id, first, root).

    row is a hash of key and text; first is the class's smallest key, nulls last, with the row hash that goes with it.
    """
    share = percent / 100
    rows = written(profiles(docs.withColumn("row", F.xxhash64("key", "text")), "text", n), "profiles", "none")
    classes = rows.where("set_id is not null").groupBy("set_id").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = classes.withColumn("row", F.col("first.row"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes", "none")
    prefixes = _postings(classes, matches[0])
    postings = prefixes.select("cls", F.explode("prefix").alias("value"), "company")

    heads = written(postings.groupBy("value").agg(F.max(F.struct("company", "cls"))["cls"].alias("head")), "heads")
    stars = postings.join(heads, "value").where("head <> cls").select(F.least("head", "cls").alias("a"), F.greatest("head", "cls").alias("b")).distinct()
    stars = written(_collide(stars, classes, matches[1], share), "stars")
    links = written(_confirmed(stars, classes, docs, "text", n, percent), "links")
    found = written(components(links), "found")

    at = postings.drop("company").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    at = at.join(classes.select("cls", "n_shingles"), "cls")
    at = written(_blocks(at, share), "blocks")
    meeting = written(at.select("cls").distinct().join(prefixes.select("cls", "prefix"), "cls").join(classes.select("cls", "n_shingles", "signature", "row"), "cls"), "meeting", "none")
    sets = _sets(written(meeting.where(F.col("n_shingles") <= CARRIED).select("row"), "rows"), docs, "text", n)
    meeting = meeting.join(sets, "row", "left").drop("row").withColumn("shingles", F.coalesce("shingles", F.array().cast("array<bigint>")))
    at = at.join(written(meeting, "meeting", "none"), "cls")
    rest = written(_cross_links(at, matches[1], share, percent), "rest").distinct()
    open_ = written(rest.where("not sure").select("a", "b").join(stars, ["a", "b"], "left_anti"), "open")
    more = rest.where("sure").select("a", "b")
    if open_.count():
        more = more.union(_confirmed(open_, classes, docs, "text", n, percent))
    links = written(links.union(more), "links")
    found = written(components(links), "found")

    roots = classes.join(found.withColumnRenamed("node", "cls"), "cls", "left").select("set_id", "first", F.coalesce("root", "cls").alias("root"))
    return rows.select("row", "key", "n_shingles", "set_id"), written(roots, "roots")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 85, matches: tuple[int, int] = MATCHES) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id (smallest key reachable over links), kept (key = component_id).

    Two texts are linked if their sets of n-word shingles share at least percent % of their union. Texts that are null or
    without words are linked with nothing. Repeated rows of a key are in one component and equally kept; a null key is
    no component's id unless all its keys are null. Other columns of docs are left out, whatever their names; an empty table gives no row.
    """
    rows, roots = _grouped(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), n, percent, matches)
    least = written(roots.groupBy("root").agg(F.min("first")["key"].alias("component_id")), "least")
    named = written(roots.select("set_id", "root").join(least, "root").select("set_id", "component_id"), "named")
    out = rows.join(named, "set_id", "left")
    out = out.withColumn("component_id", F.when(F.col("set_id").isNull(), F.col("key")).otherwise(F.col("component_id")))
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 85, matches: tuple[int, int] = MATCHES) -> DataFrame:
    """docs with exactly one row of each group of linked texts, that of the smallest key; of its texts, the one with the smallest row hash.

    Unlike `kept`, it tells rows of one key apart: of repeated rows one stays (any, where they differ in other columns only), and a key's
    texts stay or go by their own groups. A null key stays only where its group has no other. Rows whose text is null or without words are in
    no group and all stay. Columns stay as they are; an empty table gives no row.
    """
    rows, roots = _grouped(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), n, percent, matches)
    firsts = roots.groupBy("root").agg(F.min("first").alias("first")).select("first.key", "first.row")
    same = rows["key"].eqNullSafe(firsts["key"]) & (rows["row"] == firsts["row"])
    times = rows.where("set_id is not null").join(firsts, same, "left_semi").groupBy("key", "row").agg(F.count("*").alias("times"))
    keep = written(times.union(rows.where("set_id is null").groupBy("key", "row").agg(F.lit(1).cast("long"))), "keep")
    named = docs.withColumn("_row", F.xxhash64(key, text))
    here = lambda of: named[key].eqNullSafe(of["key"]) & (named["_row"] == of["row"])
    once, several = keep.where("times = 1"), keep.where("times > 1")
    out = named.join(once, here(once), "left_semi")
    if several.count():
        # Repeated rows alone are shuffled to be told apart, each partly on its own side first.
        out = out.union(named.join(several, here(several), "left_semi").dropDuplicates([key, "_row"]))
    return out.drop("_row")
