import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from emberline.llm import queries, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """(item, rank, doc_id, score) by scoring every document for every item."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    texts = defaultdict(set)
    for i, t in items:
        texts[i] |= {t} - {None}
    out = []
    for item, ts in texts.items():
        asked = Counter(t for text in ts for t in terms(text))
        scores = []
        for (doc, c), size in zip(counts, sizes, strict=True):
            m = 100 - 75 + (75 * size * n) // total if total else 0
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in asked.items() if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = rows(queries.op12_ranked_search(spark, sf))
    assert got == brute(docs, items) and len(got) == 10 * len(items)


def test_blocks_and_few_results(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    items = spark.read.parquet(f"{sf}/benchmark.parquet").limit(7)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()], 3)
    assert rows(search.top(docs, items, k=3, block_bytes=300)) == want


def test_odd_rows(spark, odd_docs, no_docs):
    pool = odd_docs.unionAll(odd_docs.where("doc_id = 5"))
    items = [(1, "ONE two a"), (1, "one words"), (1, "one words"), (2, None), (3, ""), (4, "c b a a a"), (None, "id no at"), (5, "absent"), (6, "zürich 漢字"), (7, "same text here " * 50), (8, "w" * 30_000)]
    asked = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, doc_id string, score int")
    assert rows(search.top(pool, asked)) == brute([(r.doc_id, r.text) for r in pool.collect()], items)
    assert search.top(no_docs, asked).count() == 0
    assert search.top(odd_docs, asked.where("false")).columns == ["item_id", "rank", "doc_id", "score"]
    assert search.top(odd_docs, asked.where("false")).count() == 0


def _shard(rng, documents, vocabulary):
    pairs = sorted({(rng.randrange(documents), min(int(rng.expovariate(0.08)), vocabulary - 1)) for _ in range(documents * 12)})
    doc, term = np.array(pairs).T
    return doc, term, np.array([rng.randrange(1, 10**6) for _ in pairs])


def test_tree_ranges_are_the_postings_below_each_node():
    rng = random.Random(2)
    doc, term, impact = _shard(rng, 37, 9)
    tree = search.DualSorted(doc, term, impact, 37, 9)
    nodes = search.roots(tree, np.arange(9), np.arange(9), np.ones(9, np.int64))
    while len(nodes.item):
        for i, item in enumerate(nodes.item):
            width = tree.depth - nodes.level[i]
            below = impact[(term == item) & (doc >> width == nodes.prefix[i] >> width)]
            a, b = nodes.low[nodes.first[i]], nodes.high[nodes.first[i]]
            assert tree.impact[nodes.level[i], a:b].tolist() == sorted(below.tolist(), reverse=True) and nodes.bound[i] == below.max()
        if nodes.level[0] == tree.depth:
            break
        nodes = search.children(tree, nodes)


def test_best_first_is_exact_and_opens_few_nodes():
    rng = random.Random(4)
    documents, vocabulary, k = 1500, 60, 10
    doc, term, impact = _shard(rng, documents, vocabulary)
    # One document that has all of an item's rare terms.
    tree = search.DualSorted(doc, term, impact, documents, vocabulary)
    keys = np.arange(documents) * 3
    asked = [sorted(rng.sample(range(vocabulary), 8)) for _ in range(30)]
    item, terms_ = np.repeat(np.arange(30), 8), np.array(asked).ravel()
    weight = np.array([rng.randrange(0, 9000) for _ in item])
    best = search.Best(30, k)
    opened = search.search(tree, keys, item, terms_, weight, best)
    table = np.zeros((vocabulary, documents), np.int64)
    table[term, doc] = impact
    for i in range(30):
        scores = (weight[item == i, None] * table[asked[i]]).sum(0)
        order = np.lexsort((keys, -scores))[:k]
        assert list(zip(best.key[best.item == i], best.score[best.item == i], strict=True)) == [(keys[d], scores[d]) for d in order if scores[d] > 0]
    assert opened < 30 * documents
    # A second shard of weaker documents is hardly opened.
    weak = search.DualSorted(doc, term, impact // 50, documents, vocabulary)
    assert search.search(weak, keys + 1, item, terms_, weight, best) < opened / 20


def test_ties_go_to_the_smaller_id():
    doc, term = np.arange(40), np.zeros(40, np.int64)
    tree = search.DualSorted(doc, term, np.full(40, 7), 40, 1)
    best = search.Best(1, 5)
    keys = np.array([(17 * i) % 40 for i in range(40)])
    search.search(tree, keys, np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([2]), best)
    assert best.key.tolist() == [0, 1, 2, 3, 4] and set(best.score.tolist()) == {14}
