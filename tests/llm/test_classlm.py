import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from emberline.llm import classlm, queries


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})), None]


def check_base(rows, texts, key):
    held = {k: k is not None and zlib.crc32(str(k).encode()) % 10 == 0 for k in key}
    count = Counter(w for k, t in zip(key, texts, strict=True) if not held[k] for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((-1 if k is None else k, held[k], len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 4)) for k, t in zip(key, texts, strict=True))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g[5], w[5], rel_tol=1e-6, abs_tol=1e-3) for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("head", [classlm.HEAD, 5, 0])
def test_base_scores_do_not_depend_on_the_head(spark, sf, head):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    rows = docs.collect()
    check_base(classlm.score(docs, head_size=head, clustered=50, classes=5).collect(), [r.text for r in rows], [r.doc_id for r in rows])


def test_model_beats_the_base_on_held_out_text(spark, sf):
    rows = [r for r in queries.op8_class_lm(spark, sf).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert all(math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9) for r in rows)


def fitted(docs, **sizes):
    """The model, the class and count of each training word by hash, and class bigrams and T, of documents that are all training."""
    docs = docs.select(docs.doc_id.alias("key"), "text")
    training = docs.select("text")
    model, words = classlm.train(training, classlm.word_counts(training, "text"), "text", **sizes)
    of = {r.word: (r["class"], r.n) for r in words.collect()}
    of |= {int(h): (int(c), int(n)) for h, c, n in zip(model.head.hashes.view(np.int64), model.class_of, model.count, strict=True)}
    rows = classlm.walked(docs.selectExpr("key", "false AS held_out", "text"), model, words)
    table = classlm.class_bigrams(rows, model.classes + 2)
    return model, of, table, classlm.transitions(table, model.types)


def hashed(word):
    return int(classlm.Words([word.encode()]).hash.view(np.int64)[0])


@pytest.mark.parametrize("head", [classlm.HEAD, 40, 0])
def test_score_against_a_plain_model(spark, sf, head):
    """All of T, E and the sums in plain Python, from the classes that training found."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    rows = docs.collect()
    sizes = dict(head_size=head, clustered=30, classes=5)
    training = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 10]
    model, of, table, _ = fitted(docs.where("pmod(crc32(cast(doc_id AS string)), 10) <> 0"), **sizes)
    k = model.classes
    count = Counter(w for r in training for w in tokens(r.text))
    assert {hashed(w): n for w, n in count.items() if w is not None} == {h: n for h, (_, n) in of.items()}
    classes = lambda text: [k + 1 if w is None else of.get(hashed(w), (k, 0))[0] for w in tokens(text)]
    pairs = Counter(p for r in training for c in [classes(r.text)] for p in zip([k + 1, *c], c, strict=False))
    assert pairs == {(i, j): table[i, j] for i, j in zip(*np.nonzero(table), strict=True)}
    follows, total = Counter(), sum(pairs.values())
    for (_, j), n in pairs.items():
        follows[j] += n
    leaves = Counter()
    for (i, _), n in pairs.items():
        leaves[i] += n
    share = {j: (follows[j] + 0.1) / (total + 0.1 * (k + 2)) for j in range(k + 2) if j != k}
    unseen = 0.1 / (total + 0.1 * (len(count) + 2))

    def chance(before, after):
        return unseen if after == k else (1 - unseen) * (pairs[before, after] + 20 * share[after] / sum(share.values())) / (leaves[before] + 20)

    for r in classlm.score(docs, **sizes).collect():
        text = next(x.text for x in rows if x.doc_id == r.doc_id)
        want, before = 0.0, k + 1
        for w, c in zip(tokens(text), classes(text), strict=True):
            want += math.log10(chance(before, c)) + (math.log10(count[w] / follows[c]) if c < k else 0)
            before = c
        assert math.isclose(r.score, want, rel_tol=1e-9)


def test_words_outside_the_exchange_get_their_best_class(spark, sf):
    """Likelihoods of the class bigram table in plain Python, with the word's neighbours put into each class in turn."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    _, of, _, _ = fitted(docs, clustered=30, classes=4)
    texts = [tokens(r.text) for r in docs.collect()]
    count = Counter(w for t in texts for w in t if w is not None)
    chosen = {w for w, _ in sorted(count.items(), key=lambda x: (-x[1], hashed(x[0]) % 2**64))[:30]}
    code = lambda w: 5 if w is None else of[hashed(w)][0] if w in chosen else 4
    base = np.zeros((6, 6))
    for t in texts:
        np.add.at(base, ([5, *map(code, t[:-1])], [*map(code, t)]), 1)
    beside = defaultdict(list)
    for t in texts:
        for before, w, after in zip([None, *t], t[:-1], t[1:], strict=False):
            beside[w].append((code(before), code(after)))
    f = classlm._entropy_terms
    for w in [w for w in count if w not in chosen][::7]:
        out, into = np.zeros(6), np.zeros(6)
        for before, after in beside[w]:
            into[before] += 1
            out[after] += 1

        def gain(c, out=out, into=into):
            steps = (f(base[c] + out) - f(base[c])).sum() + (f(base[:, c] + into) - f(base[:, c])).sum()
            sums = base[c].sum(), base[:, c].sum()
            return steps - sum(f(n + len(beside[w])) - f(n) for n in sums)

        assert gain(of[hashed(w)][0]) >= max(map(gain, range(4))) - 1e-9


def test_probabilities_of_all_tokens_sum_to_one(spark):
    """After any token, over all words of the training text, one unseen word and the end."""
    texts = ["the cat sat", "the dog sat", "a cat ran far away", "the dog ran", "sat the cat"] * 3
    docs = spark.createDataFrame([(i * 100 + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model, of, table, chance = fitted(docs, clustered=4, classes=2)
    emitted = np.zeros(model.classes)
    for c, n in of.values():
        emitted[c] += n / table[:, c].sum()
    assert np.allclose(emitted, 1) and np.allclose(chance.sum(1), 1)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    of = rng.integers(0, 3, 30)
    pairs = rng.poisson(np.where((of[:, None] + 1) % 3 == of[None, :], 6.0, 0.3)).astype(float)
    pairs = np.pad(pairs, (0, 2), constant_values=1.0)

    def likelihood(c):
        t = np.zeros((c.max() + 1,) * 2)
        np.add.at(t, (c[:, None], c[None, :]), pairs)
        f = classlm._entropy_terms
        return f(t).sum() - f(t.sum(0)).sum() - f(t.sum(1)).sum()

    start = np.concatenate((np.arange(30) % 3, [3, 4]))
    got = classlm.exchange(pairs, 3, 2)
    assert likelihood(got) > likelihood(start)
    assert likelihood(got) >= likelihood(np.concatenate((of, [3, 4]))) - 1e-6
    for w in range(30):
        for c in range(3):
            moved = got.copy()
            moved[w] = c
            assert likelihood(moved) <= likelihood(got) + 1e-6


def test_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    check_base(classlm.score(odd_docs).collect(), [r.text for r in rows], [r.doc_id for r in rows])
    assert classlm.score(no_docs).count() == 0
    held = spark.createDataFrame([(i, random.Random(i).choice(["a b", None])) for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    assert {r.train_tokens for r in classlm.score(held).collect()} == {0}


def test_every_training_word_has_a_class_in_the_head_or_not(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    whole, part = ({r.doc_id: r.score for r in classlm.score(docs, head_size=h, clustered=50, classes=5).collect()} for h in (classlm.HEAD, 300))
    assert all(math.isclose(whole[k], part[k], rel_tol=1e-9) for k in whole)
    model, of, table, _ = fitted(docs, clustered=50, classes=5)
    assert table[:, model.classes].sum() == 0 and table[:, : model.classes].sum() == sum(n for _, n in of.values())


def test_words_go_to_the_class_of_the_words_they_stand_beside(spark):
    """Rare words that follow a's or b's only get the class of the frequent words that do."""
    rng = random.Random(1)
    groups = {"a": ["a1", "a2"], "b": ["b1", "b2"]}
    texts = [" ".join(f"{g} {rng.choice(groups[g])}" for g in rng.choices("ab", k=20)) for _ in range(50)] + ["a rare1 b rare2 a b"] * 2
    docs = spark.createDataFrame([(i * 100 + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    _, found, _, _ = fitted(docs, clustered=6, classes=4)
    of = {w: found[hashed(w)][0] for w in "a b a1 a2 b1 b2 rare1 rare2".split()}
    assert of["rare1"] == of["a1"] and of["rare2"] == of["b1"]


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(1)
    pairs = rng.poisson(0.7, (82, 82)).astype(float)
    got = classlm.exchange(pairs, 8, 2)

    def likelihood(c):
        t = np.zeros((10, 10))
        np.add.at(t, (c[:, None], c[None, :]), pairs)
        f = classlm._entropy_terms
        return f(t).sum() - f(t.sum(0)).sum() - f(t.sum(1)).sum()

    for w in range(80):
        for c in range(8):
            moved = got.copy()
            moved[w] = c
            assert likelihood(moved) <= likelihood(got) + 1e-6


def test_best_classes_against_whole_likelihoods():
    rng = np.random.default_rng(3)
    table = rng.poisson(20.0, (6, 6)).astype(float)
    f = classlm._entropy_terms
    counts = rng.poisson(0.8, (40, 12))
    counts[5] = 0
    word, code = np.nonzero(counts)
    got = classlm.best_classes(table, word, code, counts[word, code], len(counts))
    for w in range(len(counts)):
        def likelihood(c, w=w):
            t = table.copy()
            rows, columns = t.sum(1), t.sum(0)
            out = f(t[c] + counts[w, :6]).sum() - f(t[c]).sum() + f(t[:, c] + counts[w, 6:]).sum() - f(t[:, c]).sum()
            return out - f(rows[c] + counts[w, :6].sum()) + f(rows[c]) - f(columns[c] + counts[w, 6:].sum()) + f(columns[c])
        gains = [likelihood(c) for c in range(4)]
        assert gains[got[w]] >= max(gains) - 1e-9
