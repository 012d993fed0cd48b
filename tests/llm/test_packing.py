import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from emberline.llm import packing, queries


def check(rows, texts, sequence=2048):
    whole = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for key, text in texts:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % sequence + 1
        edges = [0, *range(first, len(ids) + 1, sequence)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[key, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= sequence
    return len(by), sum(r.length for r in rows)


def test_query(spark, sf):
    rows = queries.op9_best_fit_packing(spark, sf).collect()
    n, total = check(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert n <= -(-total // 2048) + 1


@pytest.mark.parametrize("sequence", [2048, 64])
def test_odd_rows(spark, odd_docs, no_docs, sequence):
    rows = packing.pack_documents(odd_docs, queries.tokenizer_path(), sequence=sequence).collect()
    check(rows, [(r.doc_id, r.text) for r in odd_docs.collect()], sequence)
    assert packing.pack_documents(no_docs, queries.tokenizer_path()).count() == 0


def test_ids_are_kept_on_demand(spark, odd_docs):
    for r in packing.pieces(odd_docs, queries.tokenizer_path()).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_each_piece_once(seed):
    rng = random.Random(seed)
    top = rng.choice((5, 60, 700, 2048))
    histogram = Counter(min(2048, 1 + int(rng.expovariate(1 / top))) for _ in range(rng.choice((1, 50, 5000))))
    runs, n, _ = packing.plan(histogram)
    fill = np.zeros(n, int)
    ranks = defaultdict(list)
    for length, rank, count, first, offset in sorted(runs, key=lambda r: r[4]):
        ranks[length] += range(rank, rank + count)
        assert (fill[first : first + count] == offset).all()
        fill[first : first + count] += length
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in histogram.items()}
    assert fill.max() <= 2048
    total = sum(k * v for k, v in histogram.items())
    assert n <= max(1.01 * total / 2048, total / 2048 + 2)


def test_least_squares_against_known_solutions():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a = rng.random((8, 5))
        x = np.maximum(rng.normal(size=5), 0)
        assert np.allclose(packing.nonnegative_least_squares(a, a @ x), x, atol=1e-6)
        got = packing.nonnegative_least_squares(a, rng.normal(size=8))
        assert (got >= 0).all()


@pytest.mark.parametrize("space", [" " * 2_000_000, "\n" * 1_500_000, " \t\u00a0\u0085" * 400_000])
def test_very_long_white_space(space):
    whole = Tokenizer.from_file(queries.tokenizer_path())
    text = f"before{space}after"
    assert packing.encoder(queries.tokenizer_path())(text).tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0]


@pytest.fixture(scope="module")
def lengths():
    """Lengths of the pieces of all documents at sf0.1."""
    encode = packing.encoder(queries.tokenizer_path())
    out = Counter()
    for text in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist():
        n = len(encode(text or ""))
        out[(n - 1) % 2048 + 1] += 1
        out[2048] += (n - 1) // 2048
    return out


@pytest.mark.parametrize("times", [1, 1000])
def test_patterns_place_nine_of_ten_pieces_that_need_a_partner(lengths, times):
    histogram = {k: v * times for k, v in lengths.items()}
    runs, n, dealt = packing.plan(histogram)
    assert dealt >= 0.9 * sum(v for k, v in histogram.items() if k < 2048)
    total = sum(k * v for k, v in histogram.items())
    assert n <= 1.001 * total / 2048 and len(runs) < 10_000
    if times == 1:
        assert n <= 4938


def test_patterns_fill_a_sequence():
    found = packing.patterns(16, np.ones(17, bool), most=4)
    assert len(set(found)) == len(found)
    for p in found:
        assert len(p) <= 4 and list(p) == sorted(p, reverse=True)
        assert sum(p) == 16 + (15 * len(p) + 16) // 32
    every = {p for k in range(1, 5) for p in itertools.combinations_with_replacement(range(16, 0, -1), k) if sum(p) == 16 + (15 * k + 16) // 32}
    assert {p for p in every if len(set(p[2:])) <= 1 and (len(p) < 3 or p[0] >= p[1])} >= set(found)
    assert {p for p in every if len(p) <= 3} <= set(found)


@pytest.mark.parametrize("key", ["7", "cast(NULL AS long)"])
def test_one_id_on_all_rows(spark, key):
    docs = spark.range(3000).selectExpr(f"{key} AS doc_id", "if(id < 2000, 'same text', concat('text ', id)) AS text")
    rows = packing.pack_documents(docs, queries.tokenizer_path()).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
