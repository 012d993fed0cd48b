"""Document fingerprints: bottom-k sketches of shingle hashes. DataFrame functions only.

A shingle is a window of n words of the text in lower case; the first words' windows are filled up in front, so a text of w words has w windows and
one of fewer than n words has a sketch too. A hash is the first 16 hexadecimal digits of the shingle's MD5, which order as the number does. A sketch is
the k least hashes, in order. The sketch of a union is the k least of both sketches together, so sketches of parts can be merged in any order, and two
sketches tell the share of shingles that their texts have in common.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

K = 128
SHINGLE = 5
RANGES = 50_000
"""Ranges that a table's rows are dealt to for their order, at most: a bound of the small table of them."""
DIGITS = 16


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of the text in lower case. What is before the first or behind the last space may be empty and is none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def sketch_of(filled: Column, k: int = K, n: int = SHINGLE) -> Column:
    """The k least of the hashes of the shingles, ascending: an array of strings. filled is a column (it is read once a shingle) of n - 1 empty strings and the words."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(filled) - (n - 1)), lambda i: F.substring(F.md5(F.array_join(F.slice(filled, i, n), " ")), 1, DIGITS))
    return F.when(F.size(filled) >= n, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).otherwise(F.array().cast("array<string>"))


def with_sketch(docs: DataFrame, text: str = "text", name: str = "sketch", k: int = K, n: int = SHINGLE) -> DataFrame:
    """docs with the sketch of each text in the column name, which is replaced if it exists. Rows are taken one by one; a null text is empty and has an empty sketch."""
    filled = F.concat(F.array_repeat(F.lit(""), n - 1), words(F.col(text)))
    return docs.withColumn("_words", filled).withColumn(name, sketch_of(F.col("_words"), k, n)).drop("_words")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sketches' texts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_by(rows: DataFrame, keys: list[str], sketches: str = "sketch", k: int = K) -> DataFrame:
    """keys and the sketch of the union of each group's sketches. Null and empty sketches add nothing; a group of only such has no row.

    Hashes are counted once per group and ranked; Spark keeps the k least of each group within a task before it shuffles them, so a group of any size
    brings k rows a task to the one that merges it.
    """
    hashes = rows.select(*keys, F.explode(sketches).alias("_hash")).distinct()
    least = hashes.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))).where(F.col("_rank") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(sketches))


def _share(value: Column) -> Column:
    """A hash as a number in (0, 1], from its first 13 digits."""
    return (F.conv(F.substring(value, 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)


def n_shingles(s: Column, k: int = K) -> Column:
    """The number of different shingles: exact below k, then estimated from the greatest hash kept."""
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / _share(F.element_at(s, -1)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The share of the union's shingles that both texts have: of the union's k least hashes, those in both sketches. 1 of two empty ones."""
    both = F.size(F.array_intersect(merged(a, b, k), F.array_intersect(a, b)))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / F.size(merged(a, b, k)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of a's shingles that b has too, 1 if a has none: resemblance times the union's size over a's, at most 1."""
    inside = resemblance(a, b, k) * n_shingles(merged(a, b, k), k) / n_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(inside, F.lit(1.0)))


def encoded(s: Column) -> Column:
    """A sketch as one string."""
    return F.array_join(s, "")


def _numbers(values: Sequence[float], kind: str) -> Column:
    """A constant array; one literal however many there are."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _place(value: Column, cuts: Sequence[int]) -> Column:
    """How many of the ascending cuts are at most value: in blocks, then in blocks of a block, then one by one."""
    step = max(1, math.ceil(len(cuts) ** (1 / 3)))
    place = F.lit(0)
    for width in (step * step, step, 1):
        heads = cuts[width - 1 :: width]
        if heads:
            near = F.slice(_numbers(heads, "bigint"), place + 1, F.lit(step))
            place = (place + F.size(F.filter(near, lambda c: c <= value))) * (step if width > 1 else 1)
        elif width > 1:
            place = place * step
    return place.cast("int")


def in_ranges(rows: DataFrame, order: str, per_task: int = 1000) -> DataFrame:
    """rows with `_range`, ascending with the whole number `order`: about per_task rows each, and RANGES of them at most, by the numbers' quantiles.

    Rows that share a number share a range. Nulls are a range of their own, before all others.
    """
    wanted = min(RANGES, -(-rows.count() // per_task))
    cuts: list[int] = []
    if wanted > 1:
        shares = _numbers([i / wanted for i in range(1, wanted)], "double")
        cuts = sorted(set(rows.agg(F.percentile_approx(order, shares, 10 * wanted)).first()[0] or []))
    return rows.withColumn("_range", F.when(F.col(order).isNull(), -1).otherwise(_place(F.col(order), cuts)))


def _beside(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, WindowSpec]:
    """Rows with `_key`, `_text` and `_next`, and the window that orders them; rows with `_copy` = 1 are copies that only stand behind a range's last row."""
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    dealt = in_ranges(rows, "_key")
    ranges = dealt.groupBy("_range").agg(F.min("_key").alias("_least"))
    turn = Window.orderBy("_range")
    last = F.max("_range").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ring = ranges.select(F.col("_range").alias("_r"), "_least", F.coalesce(F.lag("_range").over(turn), last).alias("_to"))
    firsts = dealt.join(F.broadcast(ring), (F.col("_range") == F.col("_r")) & F.col("_key").eqNullSafe(F.col("_least")))
    copies = firsts.groupBy("_to", "_key").agg(F.min("_text").alias("_text")).select(F.col("_to").alias("_range"), "_key", "_text", F.lit(1).alias("_copy"))
    together = dealt.select("_range", "_key", "_text", F.lit(0).alias("_copy")).unionAll(copies)
    order = Window.partitionBy("_range").orderBy("_copy", "_key", "_text")
    return together.withColumn("_next", F.lead("_text").over(order)), order


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text and next_text, that of the next row in the order of key (nulls first) and text; after the last comes the first. Null texts are empty.

    Rows are sorted within ranges of key. The first row of each range is copied to the range before it, to stand behind its last row. What crosses ranges
    is a table of bounded size. Repeated rows follow each other; other columns are left out, and an empty table gives no rows.
    """
    rows, _ = _beside(docs, key, text)
    return rows.where("_copy = 0").select(F.col("_key").alias(key), F.col("_text").alias(text), F.col("_next").alias("next_text"))


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, n: int = SHINGLE) -> DataFrame:
    """One row per row of docs: key, text, edited (its last half, floor(length / 2) code points, replaced by as many of the next row's first), their
    sketches, and near_edited and near_next, the resemblance to the edited text and to the next row's.

    Order, nulls, repeated rows and other columns are as in with_next; of a single row, the next is the row itself.
    """
    rows, order = _beside(docs, key, text)
    half = F.floor(F.length("_text") / 2).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substring(F.col("_text"), F.lit(1), F.length("_text") - half), F.substring(F.col("_next"), F.lit(1), half)))
    rows = with_sketch(rows, "_text", "_sketch", k, n)
    rows = rows.withColumn("_next_sketch", F.lead("_sketch").over(order)).where("_copy = 0")
    rows = with_sketch(rows, "_edited", "_edited_sketch", k, n)
    return rows.select(
        F.col("_key").alias(key), F.col("_text").alias(text), F.col("_edited").alias("edited"), F.col("_sketch").alias("sketch"), F.col("_edited_sketch").alias("edited_sketch"),
        resemblance(F.col("_sketch"), F.col("_edited_sketch"), k).alias("near_edited"), resemblance(F.col("_sketch"), F.col("_next_sketch"), k).alias("near_next"),
    )
