import hashlib
import random
import re
from collections import Counter

from emberline.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and (sum(d[::2]) + sum(x * 2 // 10 + x * 2 % 10 for x in d[1::2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(a, b, pii.BASE[k]) for a, k, b in sorted(out)]


def test_base_spans_against_the_patterns():
    rng = random.Random(1)
    for _ in range(6000):
        text = "".join(rng.choice("1234567890.@ab -+() \n%é") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute(text), text


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op5_personal_data(spark, sf).collect():
        base = brute(texts[r.doc_id] or "")
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[2] == k for s in base) for k in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for a, b, k in base} <= set(r.spans.split(",")) | {""}


LETTER = r"[^\W\d_]"
PLAIN = {
    "secret": re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}={0,2}(?![A-Za-z0-9_/+=-])"),
    "local_phone": re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-]|\.[0-9])"),
    "national_id": re.compile(r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]|\.[0-9])"),
    "account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "person": re.compile(rf"\b(?:Mr\. |Mrs\. |Ms\. |Dr\. |[Mm]y name is |[Nn]ame: |[Cc]ontact: )(?=({LETTER}+(?:['’-]{LETTER}+)*(?: {LETTER}+(?:['’-]{LETTER}+)*){{0,2}}))"),
}


def plain_spans(text):
    """All candidates by the patterns as they are written down, one at a time and without short cuts."""
    base = brute(text)
    found = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            start, end = m.span(1 if kind == "person" else 0)
            if kind == "person":
                words = []
                for w in text[start:end].split(" "):
                    if w[0].islower() or (not words and len(w) < 2):
                        break
                    words.append(w)
                end = start + len(" ".join(words))
            if end > start and (kind != "secret" or any(c in "0123456789" for c in text[start:end])):
                found.append((start, -end, kind))
    out = list(base)
    for start, end, kind in sorted(found):
        if all(-end <= a or start >= b for a, b, _ in out):
            out.append((start, -end, kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


PARTS = [
    "Mr. Zoë Smith ", "my name is Jean-Luc d'Or ", "Contact: 王 ", "name: X ", "Dr. Émile Óskar Þór Fjord ", "(212) 555-1234", "212.555.1234", "123-45-6789", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "a1B2" * 5, "x" * 25, "k9" * 90 + "==",
    "some/long/path/with/parts/v2", "1.2.3.4", "me@x.org", " ", "-", "+1 ", "4111 1111 1111 1111", "and so on ", ".", "(", "9", "\n", "_",
]


def test_candidates_against_plain_patterns(spark, sf):
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choices(PARTS, k=rng.randint(1, 8)))
        assert [c[:3] for c in pii.candidates(text)] == plain_spans(text), text
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert [c[:3] for c in pii.candidates(r.text)] == plain_spans(r.text or "")


def test_added_spans_are_those_the_model_accepts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    counts = Counter(pii.code(t, *s) for t in texts.values() for s in plain_spans(t))
    model = pii.fit(counts)
    for r in pii.detect(docs).collect():
        t = texts[r.doc_id]
        want = [(a, b, k) for a, b, k in plain_spans(t) if k in pii.BASE or model.probability(pii.code(t, a, b, k)) >= 0.5]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert r.n_added == sum(k not in pii.BASE for _, _, k in want)


def test_em_trusts_the_labelers_that_agree():
    counts = {"secret|+0+0+|32": 50, "secret|-000-|10": 50, "email|++00+|20": 100, "person|+00-0|10": 20}
    model = pii.fit(counts)
    assert model.probability("secret|+0+0+|32") > 0.8 > 0.3 > model.probability("secret|-000-|10")
    assert (model.reliability >= 0.5).all()
    assert pii.fit({}).probability("secret|+0+0+|32") == 0


def test_codes_that_training_has_not_seen_are_scored_by_their_features():
    model = pii.fit({"secret|+0+0+|32": 50, "secret|-000-|10": 50, "person|-00-0|10": 20})
    assert model.probability("secret|++++0|33") > 0.5 > model.probability("secret|-0--0|11")


def test_each_shape_has_votes_for_and_against():
    cases = {
        "email": ("a@b.org", "a@b.1"), "ip": ("10.0.0.12", "1.2.3.4"), "card": ("4111 1111 1111 1111", "411 1 1111 11111111"), "phone": ("+1 (743) 555-3824", "+1 (743  555"), "secret": ("a1b2c3d4e5f6a7b8c9d0", "words/in/a/path/of/some2"),
        "local_phone": ("212-555-1234", "212-555 1234"), "national_id": ("123-45-6789", "123-00-6789"), "account": ("DE89370400440532013000", "DE89 3704 0044"),
    }
    for kind, (good, bad) in cases.items():
        assert (pii._shape(good, kind), pii._shape(bad, kind)) == (1, -1), kind


def test_added_spans_never_touch_base_ones():
    for _, text in enumerate(["call +1 (743) 555-3824 or (212) 555-1234", "token = 1dc0ffee1dc0ffee1dc0ffee1dc0ffee me@x.org", "4111 1111 1111 1111 ssn 123-45-6789"]):
        spans = pii.candidates(text)
        for i, a in enumerate(spans):
            for b in spans[i + 1 :]:
                assert a[1] <= b[0] or {a[2], b[2]} <= set(pii.BASE)


def test_redaction(spark, odd_docs, no_docs):
    rows = [(1, "mail bob@example.org now, token = 1dc0ffee1dc0ffee1dc0ffee1dc0ffee"), (2, "clean words only"), (3, None)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got == {1: "mail <EMAIL> now, token = <SECRET>", 2: "clean words only", 3: None}
    token = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=164))
    rows = [(1, f"the access token = {token} is old"), (2, "my name is Zoë Smith and I write"), (3, "no names here")] * 20
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "the access token = <SECRET> is old", 2: "my name is <PERSON> and I write", 3: "no names here"}
    out = pii.redact(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert pii.detect(odd_docs).count() == odd_docs.count()
    assert pii.detect(no_docs).count() == 0


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "+1" + "(" * 100_000, "A1" * 100_000, "12 " * 100_000, "AB12 " * 40_000, "a1" * 500_000 + "===", "name: " * 100_000, "(123" * 100_000, "Name: " + "É" * 300_000):
        pii.candidates(text)
