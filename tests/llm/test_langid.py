import math
import random
import zlib
from collections import Counter

import numpy as np

from emberline.llm import langid, queries

LANGS = {"aa": ["tak", "oru", "nel", "ipo"], "bb": ["zwe", "chü", "lär", "ogg"], "cc": ["ñal", "que", "sia", "dor"]}


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choices(LANGS[lang], k=2)) for _ in range(rng.randint(3, 60))), lang) for i in range(n) for lang in [rng.choice(list(LANGS))]]


def brute(model, text):
    """One n-gram after the other, with the model's own hash on a text of its own."""
    counts = Counter()
    for grams, bounds in langid._grams([text.lower()], len(model.log_prob)):
        counts.update(grams[bounds[0] : bounds[1]].tolist())
    total = [model.prior[j] + sum(n * float(model.log_prob[g, j]) for g, n in counts.items()) for j in range(len(model.languages))]
    return counts, total


def test_scores_match_a_loop_whatever_the_chunk(spark):
    model = langid.fit(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    texts = [t for _, t, _ in corpus(seed=2)]
    names, scores = langid.score_texts(model, texts)
    for t, n, s in zip(texts, names, scores, strict=True):
        counts, total = brute(model, t)
        assert sum(counts.values()) == sum(len(t) + 1 for _ in langid.ORDERS)
        assert n == model.languages[int(np.argmax(total))]
        assert math.isclose(s, 1 / sum(math.exp(x - max(total)) for x in total), rel_tol=1e-5)
    alone = [langid.score_texts(model, [t]) for t in texts]
    assert [a[0][0] for a in alone] == names


def test_counts_match_a_loop(spark):
    rows = corpus(20)
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), buckets=1 << 8, alpha=1.0)
    want = np.ones((256, 3))
    for _, t, lang in rows:
        for grams, bounds in langid._grams([t.lower()], 256):
            np.add.at(want[:, model.languages.index(lang)], grams[bounds[0] : bounds[1]], 1)
    assert np.allclose(model.log_prob, np.log(want / want.sum(0)), atol=1e-5)


def test_held_out_accuracy(spark, sf):
    rows = queries.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs)
    out = langid.predict(odd_docs, model)
    assert out.count() == odd_docs.count() and "source" in out.columns and out.columns.count("score") == 1
    for r in out.collect():
        if not langid.has_letter(r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert langid.predict(no_docs, model).count() == 0
    empty = langid.fit(no_docs)
    assert {r.lang_pred for r in langid.predict(odd_docs, empty).collect()} == {"und"}
