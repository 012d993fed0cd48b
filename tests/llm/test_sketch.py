import hashlib
import random
import re
from bisect import bisect_right
from collections import Counter

import pytest
from pyspark.sql import functions as F

from emberline.llm import queries, sketch

NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def shingles(text, n=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    filled = [""] * (n - 1) + words
    return {hashlib.md5(" ".join(filled[i : i + n]).encode()).hexdigest()[:16] for i in range(len(words))}


def plain_sketch(text, k=128):
    return sorted(shingles(text))[:k]


def plain_resemblance(a, b, k=128):
    both = sorted(set(a) | set(b))[:k]
    return sum(x in a and x in b for x in both) / len(both) if both else 1.0


def brute(rows):
    """The contract, with each text's next in the order of (doc_id, text)."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = plain_sketch(text), plain_sketch(edited), plain_sketch(after)
        yield i, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), plain_resemblance(a, b), plain_resemblance(a, c)


def same(df, rows):
    got = sorted(map(tuple, df.collect()), key=repr)
    want = sorted(brute(rows), key=repr)
    assert df.columns == NAMES and len(got) == len(want)
    for x, y in zip(got, want, strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:])


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = queries.op13_fingerprints(spark, sf)
    same(df, rows)
    assert "Python" not in df._jdf.queryExecution().toString() and "Pandas" not in df._jdf.queryExecution().toString()


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    docs = odd_docs.unionAll(odd_docs.where("doc_id = 5")).select("*", *(F.lit(1).alias(c) for c in ("sketch", "edited", "_key")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    same(queries.op13_fingerprints(spark, str(tmp_path)), [(r.doc_id, r.text) for r in docs.collect()])
    assert sketch.neighbours(no_docs).count() == 0
    one = docs.where("doc_id = 6")
    same(sketch.neighbours(one).select("doc_id", F.length("text").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), sketch.encoded(F.col("sketch")).alias("fingerprint"), sketch.encoded(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next"), [(r.doc_id, r.text) for r in one.collect()])


def test_order_over_many_ranges(spark):
    """Ids in clusters, negative, far apart, repeated and null; ranges of a few rows each."""
    rng = random.Random(8)
    ids = [*range(3000), *(10**12 + rng.randrange(500) for _ in range(700)), *(-(10**15) - i for i in range(50)), 2**62, -(2**62), None, None]
    docs = spark.createDataFrame([(i, f"{i} {k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(6)
    got = {r.text: r.next_text for r in sketch.with_next(docs).collect()}
    order = [t for _, _, t in sorted((i is not None, i or 0, f"{i} {k}") for k, i in enumerate(ids))]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))
    sizes = Counter(r["_range"] for r in sketch.in_ranges(docs, "doc_id", 100).collect())
    assert len(sizes) > 25 and max(sizes.values()) < 300
    for n in (1, 2, 7, 8, 9, 27, 28, 1000):
        cuts = sorted(rng.sample(range(10_000), n))
        got = spark.range(0, 10_000, 37).select("id", sketch._place(F.col("id"), cuts).alias("p")).collect()
        assert all(r.p == bisect_right(cuts, r.id) for r in got)


def test_sketches_of_parts_merge_to_the_sketch_of_the_whole(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 300))) for _ in range(60)]
    docs = sketch.with_sketch(spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)], "part long, text string"))
    got = {r.part: r.sketch for r in sketch.merge_by(docs, ["part"]).collect()}
    for p in range(3):
        assert got[p] == sorted(set().union(*(shingles(t) for i, t in enumerate(texts) if i % 3 == p)))[:128]
    two = docs.where("part = 0").limit(2).agg(F.collect_list("sketch").alias("s")).select(sketch.merged(F.col("s")[0], F.col("s")[1]).alias("m"))
    assert len(two.first().m) <= 128


def test_estimates(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(100_000)]
    base = rng.sample(words, 3000)
    cases = [(" ".join(base), " ".join(base[:1500])), (" ".join(base), " ".join(base[:1500] + rng.sample(words, 1500))), ("a b c", "a b c"), ("", ""), ("", "a"), (" ".join(base[:20]), " ".join(base[:10]))]
    df = sketch.with_sketch(sketch.with_sketch(spark.createDataFrame(cases, "a string, b string"), "a", "x"), "b", "y")
    x, y = F.col("x"), F.col("y")
    got = df.select(sketch.resemblance(x, y), sketch.containment(y, x), sketch.n_shingles(x)).collect()
    for (a, b), (near, inside, n) in zip(cases, got, strict=True):
        p, q = shingles(a), shingles(b)
        assert near == pytest.approx(len(p & q) / len(p | q) if p | q else 1.0, abs=0.12)
        assert inside == pytest.approx(len(p & q) / len(q) if q else 1.0, abs=0.25)
        assert n == pytest.approx(len(p), rel=0.3) and (len(p) >= 128 or n == len(p))
