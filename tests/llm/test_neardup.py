import random
import re
from collections import Counter, defaultdict

import pytest

from emberline.llm import neardup
from emberline.llm.components import components


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n=3, percent=85):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    posted = defaultdict(list)
    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in posted[g]).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
        for g in s:
            posted[g].append(i)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = {}
    for g in groups.values():
        least = min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
        for i in g:
            out[i] = (rows[i][0], len(sets[i]), least if sets[i] else rows[i][0])
    return sorted(out.values(), key=repr)


def variants(seed=1):
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(5000)}"
    shared = [word() for _ in range(60)]
    rows = []
    for base in range(12):
        text = [word() for _ in range(rng.choice((2, 30, 80, 200, 400)))]
        for _ in range(rng.randint(1, 12)):
            mine = list(text)
            for _ in range(rng.randint(0, 1 + len(text) // 25)):
                mine[rng.randrange(len(mine))] = word()
            rows.append((len(rows), " ".join(shared * (base % 3) + mine)))
        rows.append((len(rows), rows[-1][1].upper().replace("V", "v")))
    # A chain: neighbours are linked, its ends are not.
    chain = [word() for _ in range(200)]
    for k in range(12):
        chain = [word(), word(), *chain[2:]] if k % 2 else [*chain[:-4], *(word() for _ in range(4))]
        rows.append((len(rows), " ".join(chain)))
    return rows


@pytest.mark.parametrize(("n", "percent", "matches"), [(3, 85, neardup.MATCHES), (5, 80, (11, 76))])
@pytest.mark.parametrize("block", [1000, 3])
def test_against_brute_force(spark, monkeypatch, n, percent, matches, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = variants()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs, n=n, percent=percent, matches=matches).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, n, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = neardup.near_duplicates(odd_docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    again = neardup.near_duplicates(odd_docs).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert neardup.near_duplicates(no_docs).count() == 0


def test_long_lists_of_many_sizes(spark, monkeypatch):
    """One passage in texts of many lengths: long lists in bands of sizes, with links within a band and across its borders."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(120)]
    rows = [(i, " ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(rng.choice((0, 5, 18, 22, 40, 90, 150)))])) for i in range(120)]
    rows += [(200 + i, " ".join([*passage, *(f"s{j}" for j in range(k))])) for i, k in enumerate(range(0, 300, 12))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)


def test_one_row_of_each_group(spark, odd_docs, no_docs):
    rng = random.Random(5)
    text = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4)]
    rows = [(3, text[0], "a"), (3, text[0], "a"), (3, text[0], "b"), (1, text[0] + " more", "c"), (1, text[1], "d"), (7, text[1], "e"), (7, text[2], "f")]
    rows += [(None, text[2], "g"), (None, text[3], "h"), (None, text[3], "h"), (9, None, "i"), (9, None, "i"), (9, " ", "j")]
    got = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, row string")).collect()
    # 1 comes before 3 and 7, each of 1's texts in its own group; null comes last; what has no words stays.
    want = [(1, text[0] + " more", "c"), (1, text[1], "d"), (7, text[2], "f"), (None, text[3], "h"), (9, None, "i"), (9, None, "i"), (9, " ", "j")]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    out = neardup.one_of_each(odd_docs)
    assert out.columns == odd_docs.columns and neardup.one_of_each(no_docs).count() == 0
    with_words = [tuple(r) for r in out.collect() if shingles(r.text, 3)]
    assert len(with_words) == len({r[1] for r in with_words})


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)] + [(200, 200 + i) for i in range(50)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
