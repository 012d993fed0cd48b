"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs the labelers, and a span classifier decides.

1. Tasks find candidate spans in each text and let the labelers vote on each: +1 (personal), -1 (not), 0 (abstains). A
   candidate is then a short code: its kind, votes and a few shape features.
2. The corpus is counted by code. The number of codes is bounded by the number of kinds, votes and features.
3. On those counts, expectation-maximisation (Dawid and Skene's model with two classes) estimates each labeler's
   reliability and each candidate's probability; a logistic regression on kind, votes and shape learns it.
4. Spans that the classifier accepts are added. Base spans - e-mail, IP address, card and phone by their fixed patterns - always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, column, written

# The kinds in the order that spans are joined in, and the base kinds' patterns.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "local_phone", "national_id", "account", "person")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A pattern that fails at the start of a run of digits fails at each later one, so only starts are tried. Each pattern begins with what it
# can begin with and looks back from there, which the regular expression engine skips to.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

SHORTEST_SECRET = 20
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+={0,2}(?![A-Za-z0-9_/+=-])")
_NUMBERS = {
    "local_phone": re.compile(r"(?:\((?<![0-9+(.-]\()[0-9]{3}|[0-9](?<![0-9+(.-][0-9])[0-9]{2})\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-]|\.[0-9])"),
    "national_id": re.compile(r"[0-9](?<![0-9.-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-]|\.[0-9])"),
    "account": re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
}
# A name is up to three words of letters of any script, of which none begins with a small letter, after one of these.
_BEFORE_NAME = ("Mr. ", "Mrs. ", "Ms. ", "Dr. ", "My name is ", "my name is ", "Name: ", "name: ", "Contact: ", "contact: ")
_NAME = re.compile(r"[^\W\d_]++(?:['’-][^\W\d_]++)*+")
# Words before a span that speak for each kind, words that speak against any, and gazetteers of domain ends and first names.
_CUES = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "credit", "pay", "account"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "bearer", "credential"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "cell"),
    "national_id": ("ssn", "social", "security", "id"),
    "account": ("iban", "account", "bank", "konto"),
    "person": ("mr", "mrs", "ms", "dr", "name", "contact"),
}
_AGAINST = ("version", "isbn", "issn", "doi", "sha", "md5", "commit", "checksum", "http", "https", "src", "href", "page", "figure")
_ENDS = frozenset(
    """
    com org net edu gov mil int info biz name pro mobi aero coop museum io ai app dev xyz online site tech store blog cloud shop
    ad ae al am ar at au az ba be bg bo br by ca ch ci cl cm cn co cr cu cy cz de dk do dz ec ee eg es eu fi fr ge gh gr gt hk hn hr hu id ie il in
    iq ir is it jo jp ke kh kr kw kz lb li lk lt lu lv ly ma mc md me mg mk mn mt mx my ng ni nl no np nz om pa pe ph pk pl pr ps pt py qa ro rs ru
    sa se sg si sk sn sv sy th tn tr tt tv tw tz ua ug uk us uy uz ve vn za zw
    """.split()
)
_FIRST_NAMES = frozenset(
    """
    james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark paul steven andrew kenneth george
    mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa margaret sandra ashley emily donna michelle laura anna
    jean pierre michel philippe alain patrick nicolas christophe laurent julien luc louis henri marie nathalie isabelle sylvie catherine françoise
    anne sophie claire camille julie chloé emma léa hans peter klaus wolfgang jürgen dieter manfred uwe karl stefan thorsten andreas matthias
    ursula karin helga sabine ingrid renate monika petra susanne birgit heike katja josé antonio manuel francisco juan javier carlos jesús
    alejandro miguel pedro luis fernando diego pablo carmen josefa isabel dolores pilar teresa ana cristina lucía elena maria rosa marta julia
    giovanni giuseppe marco luca francesca giulia lars erik anders sven olga ivan dmitri sergei natalia irina wei li ming hiroshi yuki kenji
    ahmed mohammed ali omar fatima aisha priya raj amit zoë chloe noah liam oliver sofia mia lena jonas lukas felix max
    """.split()
)
_WORDS = re.compile(r"[^\W\d_]+")
# What widely used kinds of access keys begin with.
_KEY_STARTS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "xoxb-", "xoxp-", "sk-", "sk_live_", "eyJ")
LABELERS = ("shape", "gazetteer", "cue", "counter_cue", "check")


@dataclass
class SpanModel:
    weights: np.ndarray | None
    """The classifier's weights of `features`; without any it accepts nothing."""
    reliability: np.ndarray
    """labelers x (not personal, personal): the share of right votes among those it gave, by EM."""

    def probability(self, code: str) -> float:
        """That a candidate of this code is personal; codes that training has not seen have features too."""
        return 0.0 if self.weights is None else float(1 / (1 + np.exp(-np.clip(features([code]) @ self.weights, -30, 30)))[0])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping within each kind, by start and then kind."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        taken = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > taken and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                taken = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text) if "." in text else ():
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return [(a, b, BASE[k]) for a, k, b in sorted(out)]


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    """Long runs with a digit. They hold no white space, so only long words are looked at."""
    at = 0
    for word in text.split():
        if len(word) >= SHORTEST_SECRET:
            at = text.index(word, at)
            for m in _SECRET.finditer(word):
                if _DIGIT.search(m[0]):
                    yield at + m.start(), at + m.end()
            at += len(word)


def _names(text: str) -> Iterator[tuple[int, int]]:
    """Names after a title or a phrase that announces one."""
    for cue in _BEFORE_NAME:
        at = text.find(cue)
        while at >= 0:
            begin = end = at + len(cue)
            # Titles and phrases are words of their own.
            words = 0 if at and (text[at - 1].isalnum() or text[at - 1] == "_") else 3
            here = begin
            while words and (m := _NAME.match(text, here)) and not m[0][0].islower() and (len(m[0]) > 1 or end > begin):
                end, words = m.end(), words - 1
                if text[end : end + 1] != " ":
                    break
                here = end + 1
            if end > begin:
                yield begin, end
            at = text.find(cue, begin)


def _extra_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates of the other kinds, none over a base span or another: leftmost first, then longest."""
    found = [(a, -b, "person") for a, b in _names(text)]
    if _DIGIT.search(text):
        found += [(a, -b, "secret") for a, b in _secrets(text)]
        found += [(m.start(), -m.end(), k) for k, p in _NUMBERS.items() for m in p.finditer(text)]
    out, taken, i = [], 0, 0
    blocked = sorted(base)
    for a, b, k in sorted(found):
        b = -b
        while i < len(blocked) and blocked[i][1] <= a:
            i += 1
        if a >= taken and not any(x < b and y > a for x, y, _ in blocked[i : i + 4]):
            out.append((a, b, k))
            taken = b
    return out


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def _mod97(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def _shape(span: str, kind: str) -> int:
    """Whether the span is built as those of its kind usually are."""
    if kind == "email":
        domain = span.rpartition("@")[2].split(".")
        return 1 if domain[-1].isalpha() and len(domain[-1]) > 1 and not any(x[0] == "-" or x[-1] == "-" for x in domain) else -1
    if kind == "ip":
        # Four single digits are rather a version or a section.
        return 1 if any(len(x) > 1 for x in span.split(".")) else -1
    if kind == "card":
        sizes = [len(x) for x in re.split("[ -]", span)]
        return 1 if len(sizes) == 1 or (len(set(sizes[:-1])) == 1 and sizes[0] >= 4) or sizes == [4, 6, 5] else -1
    if kind == "phone":
        return 1 if span.count("(") == span.count(")") and not re.search("[ .-]{2}", span) else -1
    if kind == "secret":
        # What is words for more than a half is a path or a compound, however long.
        words = sum(map(len, re.findall("[A-Za-z][a-z]{3,}|[A-Z]{4,}|[0-9]{9,}", span)))
        return -1 if words * 2 > len(span) or not any(map(str.isalpha, span)) else 1
    if kind == "local_phone":
        return 1 if span.count("(") == span.count(")") and ("(" in span or len(set(span[-9:]) & set(" .-")) == 1) else -1
    if kind == "national_id":
        return 1 if span[4:6] != "00" and span[7:] != "0000" else -1
    if kind == "account":
        return 1 if 15 <= len(span.replace(" ", "")) <= 34 else -1
    return 1 if " " in span else 0


def code(text: str, start: int, end: int, kind: str) -> str:
    """The candidate's kind, the labelers' votes and its shape, as a short text."""
    span = text[start:end]
    before = [w.lower() for w in _WORDS.findall(text[max(0, start - 32) : start])][-3:]
    after = [w.lower() for w in _WORDS.findall(text[end : end + 12])][:1]
    digits = sum(c.isdigit() for c in span)
    names = {w.lower() for w in _WORDS.findall(span)}
    gazetteer = {"email": 1 if span.rpartition(".")[2].lower() in _ENDS else 0, "person": 1 if names & _FIRST_NAMES else 0, "secret": 1 if span.startswith(_KEY_STARTS) else -1 if "/" in span and len(names) > 3 else 0}.get(kind, 0)
    cue = 1 if any(w in _CUES[kind] for w in before) else 0
    counter = -1 if any(w in _AGAINST for w in [*before, *after]) else 0
    check = {
        "email": lambda: 1 if span[0] not in ".%+-" else -1,
        "ip": lambda: 1 if not any(len(x) > 1 and x[0] == "0" for x in span.split(".")) else -1,
        "card": lambda: 1 if len(set(span) - set(" -")) > 2 else -1,
        "phone": lambda: 1 if digits >= 10 else 0,
        "secret": lambda: 1 if _entropy(span) >= 3.0 else -1,
        "local_phone": lambda: 1 if span.lstrip("(")[0] > "1" else -1,
        "national_id": lambda: 1 if span[:3] not in ("000", "666") and span[0] != "9" else -1,
        "account": lambda: 1 if _mod97(span.replace(" ", "")) == 1 else -1,
        "person": lambda: 0,
    }[kind]()
    votes = "".join("-0+"[v + 1] for v in (_shape(span, kind), gazetteer, cue, counter, check))
    share = digits * 4 // max(1, len(span))
    return f"{kind}|{votes}|{min(3, (end - start) // 12)}{min(3, share)}"


def candidates(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, code) of all candidates by start and then kind."""
    text = text or ""
    base = base_spans(text)
    order = {k: i for i, k in enumerate(KINDS)}
    spans = sorted(base + _extra_spans(text, base), key=lambda s: (s[0], order[s[2]]))
    return [(a, b, k, code(text, a, b, k)) for a, b, k in spans]


def features(codes: Sequence[str]) -> np.ndarray:
    """What the classifier sees of codes: their kind, each labeler's vote, and classes of length and of the share of digits."""
    kind = np.array([KINDS.index(c.split("|")[0]) for c in codes])
    votes = np.array([["-0+".index(v) for v in c.split("|")[1]] for c in codes])
    rows = [np.ones(len(codes)), *(kind == k for k in range(len(KINDS))), *(votes[:, j] == v for j in range(len(LABELERS)) for v in (0, 2)), *(np.array([c[-i] == str(s) for c in codes]) for i in (1, 2) for s in range(4))]
    return np.stack(rows, 1).astype(float)


def fit(counts: dict[str, int], rounds: int = 50) -> SpanModel:
    """Reliabilities by EM over the codes' counts, then a logistic regression on kind, votes and shape that learns the posteriors.

    An abstention says nothing. Priors, as counts: three of four votes are right, and half of a kind's candidates are personal. They
    decide where there are few candidates; without any the model accepts none.
    """
    codes = sorted(counts)
    if not codes:
        return SpanModel(None, np.full((len(LABELERS), 2), 0.5))
    weight = np.array([counts[c] for c in codes], float)
    kind = np.array([KINDS.index(c.split("|")[0]) for c in codes])
    votes = np.array([["-0+".index(v) for v in c.split("|")[1]] for c in codes])
    voted = votes != 1
    posterior = np.clip((2 + 2 * (votes == 2).sum(1)) / (4 + 2 * voted.sum(1)), 0.05, 0.95)
    right = np.zeros((len(LABELERS), 2))
    for _ in range(rounds):
        for j in range(len(LABELERS)):
            for y, belief in ((0, 1 - posterior), (1, posterior)):
                w = belief * weight * voted[:, j]
                right[j, y] = (30 + (w * (votes[:, j] == 2 * y)).sum()) / (40 + w.sum())
        # A labeler that would vote the same way more often for the other class tells nothing.
        right = np.where(right.sum(1, keepdims=True) < 1, 0.5, np.clip(right, 0.02, 0.98))
        prior = np.stack([10 + np.bincount(kind, belief * weight, len(KINDS)) for belief in (1 - posterior, posterior)], 1)
        prior /= prior.sum(1, keepdims=True)
        log = np.log(prior[kind])
        for j in range(len(LABELERS)):
            up = votes[:, j] == 2
            log[:, 0] += np.where(voted[:, j], np.log(np.where(up, 1 - right[j, 0], right[j, 0])), 0)
            log[:, 1] += np.where(voted[:, j], np.log(np.where(up, right[j, 1], 1 - right[j, 1])), 0)
        posterior = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -40, 40)))
    x = features(codes)
    beta = np.zeros(x.shape[1])
    scale = weight / weight.max() + 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (scale * (p - posterior)) + 1e-3 * beta
        curve = (x * (scale * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta -= step * min(1.0, 3 / (np.abs(step).max() + 1e-12))
    return SpanModel(beta, right)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("code", T.StringType())]))


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `candidates`, the spans of each text; a null text is an empty one."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = [[{"start": a, "end": b, "kind": k, "code": c} for a, b, k, c in candidates(t)] if t else [] for t in column(batch, text)]
        return [pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("code", pa.string())])))]

    return append_columns(docs, run, [T.StructField("candidates", _SPANS)])


def learn(spans: DataFrame) -> SpanModel:
    """The model from a table with `candidates`."""
    counts = spans.select(F.explode("candidates.code").alias("code")).groupBy("code").count()
    return fit({r[0]: r[1] for r in counts.collect()})


def _chooser(model: SpanModel, threshold: float) -> Callable[[list], list[tuple[int, int, str]]]:
    """Of a row's candidates (start, end, kind, code) the base spans and those that the classifier accepts."""
    accepts = lru_cache(maxsize=1 << 16)(lambda code: model.probability(code) >= threshold)
    return lambda spans: [(s["start"], s["end"], s["kind"]) for s in spans if s["kind"] in BASE or accepts(s["code"])]


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row of docs: key, n_email, n_ip, n_card, n_phone (base spans), base_sha256 of the base spans and spans, all of them, as
    kind:start:end by start and kind, joined with commas (code points, end exclusive), and n_added.

    A null text has no spans, a very long one is taken whole, an empty table gives no rows. Repeated rows count and are returned as often as
    they come; other columns are left out. Spans that begin at one place are in the order of KINDS.
    """
    found = written(with_candidates(docs.select(F.col(key).alias(key), F.col(text).alias("_text")), "_text").drop("_text"), "spans")
    shared = docs.sparkSession.sparkContext.broadcast(learn(found))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        counts: list[list[int]] = []
        sha, joined = [], []
        choose = _chooser(shared.value, threshold)
        for spans in column(batch, "candidates"):
            all_spans = choose(spans)
            kinds = [k for _, _, k in all_spans]
            counts.append([*(kinds.count(k) for k in BASE), sum(k not in BASE for k in kinds)])
            sha.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in all_spans if k in BASE).encode()).hexdigest())
            joined.append(",".join(f"{k}:{a}:{b}" for a, b, k in all_spans))
        n = np.array(counts, np.int64).reshape(-1, 5)
        return [*(pa.array(n[:, j]) for j in range(4)), pa.array(sha, pa.string()), pa.array(joined, pa.string()), pa.array(n[:, 4])]

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())]
    return append_columns(found, run, fields).drop("candidates")


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with <KIND> for each span; spans that overlap become one, named by the first."""
    out, last = [], 0
    for a, b, k in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= last:
            out += [text[last:a], f"<{k.upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with each found span replaced by its kind; other rows and columns, and a null text, are unchanged.

    Candidates are searched once and written with the rows. Repeated rows stay, and an empty table gives no rows.
    """
    named = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    own = f"c{docs.columns.index(text)}"
    found = written(with_candidates(named, own), "candidates")
    shared = docs.sparkSession.sparkContext.broadcast(learn(found))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        choose = _chooser(shared.value, threshold)
        texts = batch.column(batch.schema.get_field_index(own))
        some = np.flatnonzero(batch.column(batch.schema.get_field_index("candidates")).value_lengths().to_numpy())
        if not len(some):
            return [texts]
        out = texts.to_pylist()
        rows = batch.column(batch.schema.get_field_index("candidates")).take(pa.array(some)).to_pylist()
        for i, spans in zip(some.tolist(), rows, strict=True):
            out[i] = mask(out[i], choose(spans))
        return [pa.array(out, pa.string())]

    rows = append_columns(found, run, [T.StructField(own, T.StringType())])
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
