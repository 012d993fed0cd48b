import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from emberline.llm import decontam
from emberline.llm.fmindex import FMIndex, suffix_array


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(items, text, window=10):
    owners = defaultdict(set)
    for name, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            owners[tuple(w[i : i + window])].add("null" if name is None else str(name))
    w, hit, found = words(text), set(), set()
    for n in {len(x) for x in owners}:
        for i in range(len(w) - n + 1):
            if names := owners.get(tuple(w[i : i + n])):
                hit.update(range(i, i + n))
                found |= names
    return len(w), len(hit), sorted(found)


def test_fm_index_against_search():
    rng = np.random.default_rng(0)
    for _ in range(60):
        text = rng.integers(0, 4, rng.integers(1, 60))
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        segments = [rng.integers(1, 4, rng.integers(1, 20)) for _ in range(rng.integers(1, 5))]
        flat = np.concatenate([x for s in segments for x in (s, [0])]).tolist()
        index = FMIndex(segments, 4)
        patterns, lengths = rng.integers(1, 5, (10, 3)), rng.integers(1, 4, 10)
        for p, n, a, b in zip(patterns.tolist(), lengths.tolist(), *index.search(patterns, lengths), strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(flat) - n + 1) if flat[i : i + n] == p[:n]]


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "C", "dé", "e1", "F"]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(1, say(12)), (2, say(25)), (3, say(4)), (None, say(11)), (5, None), (6, "..."), (2, say(10)), (7, say(1) + "q")]
    docs = [(i, ", ".join(say(rng.randint(0, 40)) + " zz " + (rng.choice(items)[1] or "") for _ in range(rng.randint(0, 4)))) for i in range(80)]
    docs += [(100, None), (101, ""), (None, items[0][1]), (0, docs[0][1]), (0, docs[0][1]), (102, "zz " * 60_000 + items[1][1])]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, items string, n_words int")
    return items, frame, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_scan_against_brute_force(case, block):
    items, docs, benchmark = case
    for r in decontam.scan(docs, benchmark, block_bytes=block).collect():
        n, hit, found = brute(items, r.text)
        assert (r.n_words, r.n_hit, list(r["items"]), r.contaminated) == (n, hit, found, hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert sum(len(words(r.text[a:b])) for a, b in r.hit_spans) == hit


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_removal_leaves_no_window_and_keeps_the_rest(case, block):
    items, docs, benchmark = case
    by = lambda rows: sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id))
    after = decontam.remove(docs, benchmark, block_bytes=block)
    assert after.columns == docs.columns
    for a, b in zip(by(docs.collect()), by(after.collect()), strict=True):
        assert brute(items, b.text)[1] == 0
        if brute(items, a.text)[1] == 0:
            assert a == b
        assert words(b.text).count("zz") == words(a.text).count("zz")


def test_empty_tables(case, no_docs):
    items, docs, benchmark = case
    assert decontam.scan(no_docs, benchmark).count() == 0
    assert {r.n_hit for r in decontam.scan(docs, benchmark.where("false")).collect()} == {0}
