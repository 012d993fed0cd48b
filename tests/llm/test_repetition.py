import re
from collections import defaultdict

import numpy as np
import pytest

from emberline.llm import queries, repetition
from emberline.llm.fmindex import suffix_array


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(text):
    text = text or ""
    w, places, repeat = words(text), defaultdict(list), set()
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    for at in places.values():
        if len(at) > 1:
            repeat.update(k for i in at for k in range(i, i + 8))
    seen, lines = set(), 0
    for line in text.split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(repeat) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(repeat), failed


def test_suffix_structures_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(80):
        t = rng.integers(0, 3, rng.integers(1, 40))
        order = suffix_array(t)
        height = repetition.lcp(t, order)
        for i in range(1, len(t)):
            a, b, k = order[i - 1], order[i], 0
            while a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
                k += 1
            assert height[i] == k
        found = defaultdict(list)
        for n in range(2, len(t)):
            for i in range(len(t) - n + 1):
                found[tuple(t[i : i + n])].append(i)
        repeats = {s: p for s, p in found.items() if len(p) > 1}
        maximal = {}
        for s, p in repeats.items():
            before = {t[i - 1] if i else None for i in p}
            after = {t[i + len(s)] if i + len(s) < len(t) else None for i in p}
            if (len(before) > 1 or None in before) and (len(after) > 1 or None in after):
                maximal[s] = p
        assert {tuple(t[order[a] : order[a] + n]): sorted(order[a:b].tolist()) for n, a, b in repetition.maximal_repeats(t, order, height, 2)} == maximal
        covered = {k for s, p in repeats.items() for i in p for k in range(i, i + len(s))}
        want = [len(covered), max(map(len, repeats), default=0), len(maximal)]
        # Two texts at once: the second has other symbols, and the same repeats.
        both = np.concatenate((t, t + 3))
        assert repetition.measure(both, np.repeat([0, 1], len(t)), 3, 2).tolist() == [want, want, [0, 0, 0]]


@pytest.mark.parametrize("words", [["same"], ["a", "phrase", "of", "five", "words"]])
def test_a_million_repeated_words(words):
    t = np.tile(np.arange(len(words)), 1_000_000 // len(words))
    (covered, longest, _), = repetition.measure(t, np.zeros(len(t), int), 1)
    assert (covered, longest) == (1_000_000, 1_000_000 - len(words))


def repeats(text):
    """Words that repeats of four words or more cover, and the longest repeat, from all windows of growing length."""
    w, n, covered = words(text), 4, 0
    longest = 0
    while True:
        places = defaultdict(list)
        for i in range(len(w) - n + 1):
            places[tuple(w[i : i + n])].append(i)
        twice = [i for at in places.values() if len(at) > 1 for i in at]
        if not twice:
            return covered, longest
        covered = covered or len({k for i in twice for k in range(i, i + n)})
        longest, n = n, n + 1


def check(rows):
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text)
        if r.n_words < 3000:
            covered, longest = repeats(r.text)
            assert (r.covered_words, r.longest_repeat) == (covered, longest)
            assert r.kept == (not r.base_failed and covered <= 0.3 * r.n_words and longest <= 100)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(repetition.quality(docs).collect())
    assert queries.op10_repetition(spark, sf).count() == docs.count()


def test_odd_rows(odd_docs, no_docs):
    out = repetition.quality(odd_docs)
    check(out.collect())
    assert out.count() == odd_docs.count() and repetition.quality(no_docs).count() == 0


def test_a_long_repeat_is_rejected(spark):
    long = " ".join(f"w{i}" for i in range(120))
    rest = " ".join(f"r{i}" for i in range(900))
    docs = spark.createDataFrame([(1, f"{long} {rest} {long}"), (2, f"{long} {rest}")], "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.longest_repeat, r.kept) for r in repetition.quality(docs).collect()}
    assert got == {1: (False, 120, False), 2: (False, 0, True)}


def test_only_the_covered_fraction_rejects_stuttering(spark):
    """Each word four times in a row or more: no window of eight words comes twice, but repeats of four words cover the text."""
    stutter = " ".join(f"w{i} " * 5 for i in range(40))
    docs = spark.createDataFrame([(1, stutter), (2, " ".join(f"w{i}" for i in range(200)))], "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.covered_words, r.longest_repeat, r.kept) for r in repetition.quality(docs).collect()}
    assert got == {1: (False, 200, 4, False), 2: (False, 0, 0, True)}


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "same " * 1_000_000), (2, "a phrase of five words " * 200_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_repeat_words, r.covered_words, r.longest_repeat) for r in repetition.quality(docs).collect()}
    assert got == {1: (1_000_000, 1_000_000, 1_000_000, 999_999), 2: (1_000_000, 1_000_000, 1_000_000, 999_995)}
