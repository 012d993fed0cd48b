import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import queries, sharding
from emberline.llm.common import gapless_rank


def scalar_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_against_a_scalar_loop():
    keys = np.random.default_rng(0).integers(0, 2**63, 2000).astype(np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump(keys, n).tolist() == [scalar_jump(int(k), n) for k in keys]
    before, after = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert set(after[before != after]) == {16}
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


def check(rows, texts):
    slots, of = defaultdict(list), {}
    for r in rows:
        slots[r.shard].append(r.slot)
        assert of.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.law == "key" and r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in rows) == want


def test_query(spark, sf):
    check(queries.op7_jump_shards(spark, sf).collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


@pytest.mark.parametrize("per_task", [200_000, 2])
def test_odd_rows(spark, odd_docs, no_docs, per_task):
    docs = odd_docs.unionAll(odd_docs.where("doc_id = 5")).unionAll(odd_docs.where("doc_id = 5"))
    check(sharding.assign(docs, per_task=per_task).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert sharding.assign(no_docs).count() == 0


def test_many_equal_rows_are_dealt_over_tasks(spark):
    """One key and text on all rows, and one key with many texts: no range of slots holds much more than per_task rows."""
    same = spark.range(50_000).selectExpr("7 AS doc_id", "'t' AS text")
    texts = spark.range(20_000).selectExpr("8 AS doc_id", "cast(id AS string) AS text")
    rows = sharding.assign(same.union(texts), per_task=1000)
    by = {}
    for key, shard, slot in rows.select("doc_id", "shard", "slot").collect():
        by.setdefault(shard, []).append(slot)
    assert sum(map(len, by.values())) == 70_000
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    ranked = gapless_rank(texts.selectExpr("1 AS g", "text", "conv(substring(md5(text), 1, 15), 16, 10) + 0L AS spread", "1L AS one").withColumn("spread", F.col("spread").cast("long")), ["g"], "spread", ["text"], "one", 1000)
    plan = ranked._jdf.queryExecution().toString()
    assert "_range" in plan
    assert sorted(r.first for r in ranked.collect()) == list(range(20_000))
