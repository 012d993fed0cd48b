"""Class-based bigram language model: words belong to classes, classes follow each other, and classes emit words.

1. Words are counted over all training texts: tasks aggregate by 64-bit word hash, the shuffle adds up.
2. Head words - the most frequent, at most HEAD of them, by a count threshold - go to the tasks in one broadcast of bounded size.
3. Bigrams of the CLUSTERED most frequent words, with all other words as one `rest` symbol and the end symbol, are counted over all
   training texts. Exchange clustering on that bounded table moves words between classes until no move raises the likelihood.
4. Every other training word, however many there are, goes to the class that its neighbours favour most: one aggregate by word and class
   beside it, over all training texts, and one assignment by word. The class `rest` is left with unseen words.
5. Each text is walked once more, to a byte for each token: its class. Classes and counts of words outside the head come by a join of the
   distinct (row, word) pairs with the table of words; each side of it is a plain shuffle, and such words are rare, so none is hot.
6. Class bigrams over all training texts and the scores of all texts are then read off those rows of classes.

P(token | before) = T(class | class before) x E(token | class): T is interpolated with the classes' shares, E is a word's share of its class.
Unseen words get a constant share of each T, about that of an unseen word in the base model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, column, document_id, slices, written
from .words import Words, utf8

HEAD = 1 << 18
CLUSTERED = 1500
MOST_CLASSES = 128
"""Exchange looks at each pair of classes for each word and runs in one task, so this bounds its time."""
GATHERED = 4_000_000
"""Words or neighbours that a task gathers before it adds them up."""
GAINS = 1 << 20
"""Gains of neighbours and classes that a task holds at a time, 8 MB."""
SMOOTHING = 0.1
BACK_OFF = 20.0
OUTSIDE = 255
"""The byte of a word outside the head in a row of classes, until its class is joined."""


class Head:
    """Head words by hash: `places` finds hashes in their sorted row by a table over the first bits."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        bits = len(hashes).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        first = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.start = np.append(np.searchsorted(hashes, first), len(hashes)).astype(np.int32)

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash in the row, -1 if it is not there."""
        slot = (h >> self.shift).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        out = np.full(len(h), -1, np.int32)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            here = at[open_]
            hit = self.hashes[here] == h[open_]
            out[open_[hit]] = here[hit]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out


@dataclass
class ClassModel:
    tokens: int
    """Training tokens, ends included."""
    types: int
    """Distinct training tokens, the end included."""
    ends: int
    head: Head
    count: np.ndarray
    """Training count of each head word."""
    class_of: np.ndarray
    """Class of each head word."""
    classes: int
    """Number of word classes; the next two numbers are the classes of unseen words and of the end."""


def _hashed(texts: list[str | None]) -> Iterator[tuple[int, int, Words]]:
    data = [utf8(t, lower=True) for t in texts]
    for a, b in chunks(data):
        yield a, b, Words(data[a:b])


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n): how often each word, by hash, is in docs."""

    def added(held: list[np.ndarray]) -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64)]
        for batch in slices(batches):
            held += [w.hash for _, _, w in _hashed(column(batch, text))]
            if sum(map(len, held)) > GATHERED:
                yield added(held)
                held = [np.zeros(0, np.uint64)]
        yield added(held)

    return docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _entropy_terms(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1e-300))


def exchange(pairs: np.ndarray, classes: int, fixed: int) -> np.ndarray:
    """Classes of the symbols of a bigram table; the last `fixed` symbols keep classes of their own.

    Starts from equal shares by frequency, then moves one word at a time to the class that raises the class bigram likelihood most,
    until a round moves none.
    """
    n = len(pairs) - fixed
    k = max(1, min(classes, n))
    of = np.concatenate((np.arange(n) % k, k + np.arange(fixed)))
    size = k + fixed
    table = np.zeros((size, size))
    np.add.at(table, (of[:, None], of[None, :]), pairs)
    f = _entropy_terms
    # Gains are differences of numbers of this size, so smaller ones are rounding and could move a word for ever.
    least = 1e-9 + 1e-13 * f(pairs.sum())
    moved = True
    while moved:
        moved = 0
        for w in range(n):
            out, into, self_ = np.bincount(of, pairs[w], size), np.bincount(of, pairs[:, w], size), pairs[w, w]
            if not out.sum() + into.sum():
                continue
            a = of[w]
            # Without w: its class loses the row, the column and, where they meet, its pair with itself, counted by both.
            table[a] -= out
            table[:, a] -= into
            table[a, a] += self_
            out[a] -= self_
            into[a] -= self_
            # Words before and after w meet it in any class, so their own totals stay.
            right, left = table.sum(1) + into, table.sum(0) + out
            gain = (f(table[:k] + out) - f(table[:k])).sum(1) + (f(table[:, :k] + into[:, None]) - f(table[:, :k])).sum(0)
            d = np.arange(k)
            here = table[d, d]
            gain += f(here + out[:k] + into[:k] + self_) - f(here + out[:k]) - f(here + into[:k]) + f(here)
            total_out, total_in = out.sum() + self_, into.sum() + self_
            gain -= f(right[:k] + total_out) - f(right[:k]) + f(left[:k] + total_in) - f(left[:k])
            b = int(gain.argmax())
            if gain[b] <= gain[a] + least:
                b = a
            moved += b != a
            of[w] = b
            table[b] += out
            table[:, b] += into
            table[b, b] += self_
    return of


def best_classes(table: np.ndarray, word: np.ndarray, code: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """For each word outside the classes the one that makes the class bigram likelihood largest, all others staying where they are.

    table: class bigrams, rest and end last. Entry i says that word[i] (ascending, below words) has n[i] neighbours of a code: the class
    after it, or the class before it plus the number of classes.
    """
    size, f = len(table), _entropy_terms
    k = size - 2
    beside = np.concatenate((table[:k].T, table[:, :k]))
    whole = (table.sum(1)[:k], table.sum(0)[:k])
    # Most neighbours are met once, so their gain is looked up.
    once, as_is = f(beside + 1) - f(beside), f(beside)
    gains = once[code]
    more = np.flatnonzero(n > 1)
    gains[more] = f(beside[code[more]] + n[more, None]) - as_is[code[more]]
    gain = np.zeros((words, k))
    if len(word):
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        gain[word[first]] = np.add.reduceat(gains, first)
    for side in range(2):
        mine = (code >= size) == (side == 1)
        total = np.bincount(word[mine], n[mine], words)
        several, which = np.unique(total, return_inverse=True)
        gain -= (f(whole[side] + several[:, None]) - f(whole[side]))[which]
    return gain.argmax(1)


def _tokens(words: Words, head: Head) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens with each text's end put in: hash, place in head (-1: none), whether it is an end."""
    texts = len(words.first) - 1
    is_end = np.zeros(len(words.hash) + texts, bool)
    is_end[words.first[1:] + np.arange(texts)] = True
    h, place = np.zeros(len(is_end), np.uint64), np.full(len(is_end), -1, np.int32)
    h[~is_end] = words.hash
    place[~is_end] = head.places(words.hash)
    return h, place, is_end


def _codes(place: np.ndarray, is_end: np.ndarray, of: np.ndarray, outside: int, end: int) -> np.ndarray:
    """What `of` says of head words, outside of other words, end of ends."""
    out = np.full(len(place), outside, np.int64)
    inside = place >= 0
    out[inside] = of[place[inside]]
    out[is_end] = end
    return out


def _vocabulary(counts: DataFrame, most: int) -> tuple[Head, np.ndarray]:
    """The words above the smallest count threshold that at most so many words reach, and their counts."""
    # Thresholds are whole numbers up to 16 and then a sixteenth of an octave apart, so this table is small at any corpus size.
    step = F.floor(F.log2("n") * 16).cast("int").alias("step")
    steps = counts.groupBy(step).agg(F.min("n").alias("least"), F.count("*").alias("words")).orderBy(F.col("step").desc()).collect()
    threshold, room = None, most
    for r in steps:
        room -= r["words"]
        if room < 0:
            break
        threshold = r["least"]
    # Arrow tables: rows as Python objects would take a multiple of the driver's memory.
    top = counts.where(F.lit(False) if threshold is None else F.col("n") >= threshold).toArrow()
    word, n = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()
    by = np.argsort(word)
    return Head(word[by]), n[by]


def _bigrams(training: DataFrame, text: str, head: Head, symbol: np.ndarray, size: int) -> np.ndarray:
    """How often symbols follow each other; the last two of the size symbols are that of all words without an own one, and the end."""
    shared = training.sparkSession.sparkContext.broadcast((head, symbol))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_, of = shared.value
        table = np.zeros(size * size, np.int64)
        for batch in slices(batches):
            for _, _, words in _hashed(column(batch, text)):
                _, place, is_end = _tokens(words, words_)
                s = _codes(place, is_end, of, size - 2, size - 1)
                # A text begins after an end.
                table += np.bincount(np.concatenate(([size - 1], s[:-1])) * size + s, minlength=size * size)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], names=["pair", "n"])

    return _square(training.select(text).mapInArrow(run, "pair long, n long"), size)


def _square(pairs: DataFrame, size: int) -> np.ndarray:
    """The sums of (pair, n) rows as a table of size rows and columns."""
    sums = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[sums["pair"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(size, size)


def _neighbours(training: DataFrame, text: str, head: Head, class_: np.ndarray, clustered: np.ndarray, size: int) -> DataFrame:
    """(word, codes, times) of the words not clustered, maybe several rows a word: how often which class is beside it, as in `best_classes`."""
    shared = training.sparkSession.sparkContext.broadcast((head, class_, clustered))

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        word, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        cell, n = np.unique(np.concatenate([at * (2 * size) + np.concatenate([c[side] for _, c in held]) for side in (0, 1)]), return_counts=True)
        owner, code = np.divmod(cell, 2 * size)
        edges = np.searchsorted(owner, np.arange(len(word) + 1))
        for i in range(0, len(word), 1 << 16):
            e = edges[i : i + (1 << 16) + 1]
            lists = [pa.ListArray.from_arrays(pa.array((e - e[0]).astype(np.int32)), pa.array(x[e[0] : e[-1]].astype(t))) for x, t in ((code, np.int32), (n, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(word[i : i + (1 << 16)].view(np.int64)), *lists], names=["word", "codes", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_, classes, own = shared.value
        held, many = [], 0
        for batch in slices(batches):
            for _, _, words in _hashed(column(batch, text)):
                h, place, is_end = _tokens(words, words_)
                code = _codes(place, is_end, classes, size - 2, size - 1)
                open_ = ~is_end & (place < 0)
                if len(own):
                    open_ |= (place >= 0) & ~own[place]
                # A text's last token is its end, and a text begins after an end.
                i = np.flatnonzero(open_)
                held.append((h[i], (code[i + 1].astype(np.int16), (size + np.concatenate(([size - 1], code[:-1]))[i]).astype(np.int16))))
                many += len(i)
            if many > GATHERED:
                yield from added(held)
                held, many = [], 0
        if held:
            yield from added(held)

    return training.select(text).mapInArrow(run, "word long, codes array<int>, times array<long>")


def _parts(row: np.ndarray, words: int, room: int) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of words and of their entries in row (ascending), of about `room` words and entries at most."""
    first = np.searchsorted(row, np.arange(words + 1))
    i = 0
    while i < words:
        j = int(np.searchsorted(first, first[i] + room, side="right")) - 1
        j = min(max(j, i + 1), words, i + room)
        yield i, j, int(first[i]), int(first[j])
        i = j


def _assigned(neighbours: DataFrame, table: np.ndarray) -> DataFrame:
    """(word, n, class) of all words in neighbours, as a written table; n is how often the word is in the texts.

    A word's rows come one after the other and are added up as they come, so a task holds one word's counts besides its batch.
    """
    size = len(table)
    cells = 2 * size

    def classified(word: np.ndarray, row: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        cell, which = np.unique(row * cells + code, return_inverse=True)
        n = np.bincount(which, n, len(cell)).astype(np.int64)
        row, code = np.divmod(cell, cells)
        # Each occurrence has one neighbour after it.
        often = np.bincount(row[code < size], n[code < size], len(word)).astype(np.int64)
        best = [best_classes(table, row[a:b] - i, code[a:b], n[a:b], j - i) for i, j, a, b in _parts(row, len(word), max(1, GAINS // size))]
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(often), pa.array(np.concatenate(best).astype(np.int32))], names=["word", "n", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, np.ndarray] | None = None
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            every, codes, times = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            new = np.concatenate(([True], every[1:] != every[:-1]))
            word = every[new]
            row = np.repeat(np.cumsum(new) - 1, codes.value_lengths().to_numpy())
            code, n = codes.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy()
            if held is not None:
                seen = np.flatnonzero(held[1])
                shift = int(held[0] != word[0])
                word = np.concatenate(([held[0]], word)) if shift else word
                row, code, n = np.concatenate((np.zeros(len(seen), np.int64), row + shift)), np.concatenate((seen, code)), np.concatenate((held[1][seen], n))
            last = row == len(word) - 1
            held = int(word[-1]), np.bincount(code[last], n[last], cells).astype(np.int64)
            if len(word) > 1:
                yield classified(word[:-1], row[~last], code[~last], n[~last])
        if held is not None:
            seen = np.flatnonzero(held[1])
            yield classified(np.array([held[0]]), np.zeros(len(seen), np.int64), seen, held[1][seen])

    return written(neighbours.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word long, n long, class int"), "word_classes")


def _of_head(words: DataFrame, head: Head, class_: np.ndarray) -> np.ndarray:
    """class_, of the head words, with what words says of them."""
    shared = words.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = shared.value.places(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(at[at >= 0]), batch.column(1).filter(pa.array(at >= 0))], names=["at", "class"])

    rows = words.select("word", "class").mapInArrow(run, "at int, class int").toArrow()
    out = class_.copy()
    out[rows["at"].to_numpy()] = rows["class"].to_numpy()
    return out


def classes_for(tokens: int) -> int:
    """How many classes so many training tokens can tell apart: class bigrams grow with the square of it, so it grows with less than the square root of them."""
    return max(8, min(MOST_CLASSES, round(0.6 * tokens ** (1 / 3))))


def train(training: DataFrame, counts: DataFrame, text: str, head_size: int = HEAD, clustered: int = CLUSTERED, classes: int | None = None) -> tuple[ClassModel, DataFrame]:
    """The model of training texts, counts being their written word_counts, and (word, n, class) of all training words that exchange did not place.

    classes: how many, by default as many as classes_for says of the training words.
    """
    if classes is not None and not 0 < classes < OUTSIDE - 2:
        raise ValueError(f"there may be 1 to {OUTSIDE - 3} classes")
    ends = training.count()
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    classes = classes or classes_for(int(total))
    head, count = _vocabulary(counts, head_size)
    chosen = np.lexsort((head.hashes, -count))[:clustered]
    n = len(chosen)
    symbol = np.full(len(count), n, np.int32)
    symbol[chosen] = np.arange(n)
    matrix = _bigrams(training, text, head, symbol, n + 2)
    symbols = exchange(matrix, classes, 2)
    k = int(symbols[n])
    between = np.zeros((k + 2, k + 2))
    np.add.at(between, (symbols[:, None], symbols[None, :]), matrix)
    class_ = symbols[symbol].astype(np.int32)
    words = _assigned(_neighbours(training, text, head, class_, symbol < n, k + 2), between)
    return ClassModel(int(total) + ends, int(types) + (ends > 0), ends, head, count, _of_head(words, head, class_), k), words


def walked(docs: DataFrame, model: ClassModel, words: DataFrame) -> DataFrame:
    """docs (key, held_out, text) with n_tokens, n_known, base (the base score), emitted (the sum of log10 counts) and classes, a byte for each
    token, in place of the text; as a written table."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    c = SMOOTHING
    rest = model.classes

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total = m.tokens + c * (m.types + 1)
        base_head = np.log10((m.count + c) / total)
        log_count = np.log10(m.count)
        for batch in slices(batches):
            n, known, base, emitted, classes, tail, which = [], [], [], [], [], [], []
            for _, _, words_ in _hashed(column(batch, "text")):
                h, place, is_end = _tokens(words_, m.head)
                lengths = np.diff(words_.first) + 1
                edges = np.concatenate(([0], np.cumsum(lengths)))
                inside = place >= 0
                unigram = np.where(is_end, np.log10((m.ends + c) / total), -np.log10(total))
                unigram[inside] = base_head[place[inside]]
                sure = np.zeros(len(place))
                sure[inside] = log_count[place[inside]]
                row = _codes(place, is_end, m.class_of, OUTSIDE, m.classes + 1).astype(np.uint8)
                n += lengths.tolist()
                known += np.add.reduceat((inside | (is_end & (m.ends > 0))).astype(np.int64), edges[:-1]).tolist()
                base += np.add.reduceat(unigram, edges[:-1]).tolist()
                emitted += np.add.reduceat(sure, edges[:-1]).tolist()
                at = np.flatnonzero(row == OUTSIDE)
                cuts = np.searchsorted(at, edges).tolist()
                outside = h[at].view(np.int64)
                for i, j, a, b in zip(cuts, cuts[1:], edges.tolist(), edges[1:].tolist(), strict=False):
                    classes.append(row[a:b].tobytes())
                    word, number = np.unique(outside[i:j], return_inverse=True)
                    tail.append(word), which.append(number.astype(np.int32))
            arrays = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(emitted, pa.float64()), pa.array(classes, pa.binary()), pa.array(tail, pa.list_(pa.int64())), pa.array(which, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["key", "held_out", *fields, "tail", "which"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = batch.num_rows
            get = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            ends = np.cumsum(get["n_tokens"].to_numpy())
            every = np.frombuffer(bytearray(b"".join(get["classes"].to_pylist())), np.uint8)
            row = np.repeat(np.arange(rows), get["which"].value_lengths().to_numpy())
            found = get["found"].flatten()
            begins = np.concatenate(([0], np.cumsum(get["found"].value_lengths().to_numpy())))[:-1]
            at = begins[row] + get["which"].flatten().to_numpy()
            often = found.field("n").to_numpy()[at]
            every[every == OUTSIDE] = found.field("class").to_numpy()[at].astype(np.uint8)
            known, base, emitted = (np.bincount(row, x, rows) for x in (often > 0, np.log10(often + c), np.log10(np.maximum(often, 1))))
            classes = [every[a:b].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
            arrays = [get["n_tokens"], pa.array(get["n_known"].to_numpy() + known.astype(np.int64)), pa.array(get["base"].to_numpy() + base), pa.array(get["emitted"].to_numpy() + emitted), pa.array(classes, pa.binary())]
            yield pa.RecordBatch.from_arrays([get["key"], get["held_out"], *arrays], names=["key", "held_out", *fields])

    fields = {"n_tokens": "long", "n_known": "long", "base": "double", "emitted": "double", "classes": "binary"}
    schema = f"key {docs.schema['key'].dataType.simpleString()}, held_out boolean, " + ", ".join(f"{name} {kind}" for name, kind in fields.items())
    rows = docs.select("key", "held_out", "text").mapInArrow(walk, schema + ", tail array<long>, which array<int>")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "walked")
    tails = rows.select("row", F.posexplode("tail").alias("pos", "word")).join(words, "word", "left")
    entry = F.struct("pos", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("class", F.lit(rest)).cast("int").alias("class"))
    tails = tails.groupBy("row").agg(F.sort_array(F.collect_list(entry)).alias("found"))
    rows = rows.drop("tail").join(tails, "row", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<pos:int,n:bigint,class:int>>")))
    return written(rows.mapInArrow(fill, schema), "classes")


def class_bigrams(rows: DataFrame, size: int) -> np.ndarray:
    """How often classes follow each other in the `walked` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size, np.int64)
        for batch in slices(batches):
            every = np.frombuffer(bytes([size - 1]) + b"".join(batch.column(0).to_pylist()), np.uint8).astype(np.int64)
            table += np.bincount(every[:-1] * size + every[1:], minlength=size * size)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], names=["pair", "n"])

    return _square(rows.select("classes").mapInArrow(run, "pair long, n long"), size)


def transitions(table: np.ndarray, types: int) -> np.ndarray:
    """T, from class to class, of class bigrams (see `ClassModel.classes`): each row sums to 1."""
    size = len(table)
    share = (table.sum(0) + SMOOTHING) / (table.sum() + SMOOTHING * size)
    share[size - 2] = 0
    share /= share.sum()
    unseen = SMOOTHING / (table.sum() + SMOOTHING * (types + 2))
    out = (1 - unseen) * (table + BACK_OFF * share) / (table.sum(1, keepdims=True) + BACK_OFF)
    out[:, size - 2] = unseen
    return out


def _held_out(key: str) -> Column:
    return F.pmod(document_id(key), F.lit(10)) == 0


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", head_size: int = HEAD, clustered: int = CLUSTERED, classes: int | None = None) -> DataFrame:
    """Per row of docs: key, held_out, n_tokens (words and the end), n_known (those in training), train_tokens, base_score (smoothed
    unigram log10 probability), score (the model's log10 probability) and perplexity.

    Training rows are those whose crc32(key as text) mod 10 is not 0. A null or empty text has its end only; a null key is held out never.
    Repeated rows count and are returned as often as they come, other columns are ignored, and an empty table gives no rows; without any
    training row all scores are the smoothing's.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(_held_out(key), F.lit(False)).alias("held_out"))
    training = docs.where("not held_out").select("text")
    model, words = train(training, written(word_counts(training, "text"), "counts"), "text", head_size, clustered, classes)
    rows = walked(docs, model, words)
    size = model.classes + 2
    table = class_bigrams(rows.where("not held_out"), size)
    # A class emits a word by its share; an unseen word and the end are all of their classes.
    totals = table.sum(0)
    totals[-2:] = 1
    steps = np.log10(transitions(table, model.types)) - np.log10(np.maximum(totals, 1))
    shared = docs.sparkSession.sparkContext.broadcast(steps)
    tokens = model.tokens

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            get = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            n = get["n_tokens"].to_numpy()
            every = np.frombuffer(bytes([size - 1]) + b"".join(get["classes"].to_pylist()), np.uint8).astype(np.int64)
            full = get["emitted"].to_numpy() + np.add.reduceat(shared.value.reshape(-1)[every[:-1] * size + every[1:]], np.concatenate(([0], np.cumsum(n)))[:-1])
            arrays = [get["n_tokens"], get["n_known"], pa.array(np.full(len(n), tokens)), get["base"], pa.array(full), pa.array(10.0 ** -(full / n))]
            yield pa.RecordBatch.from_arrays([get["key"], get["held_out"], *arrays], names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kind = docs.schema["key"].dataType.simpleString()
    return rows.mapInArrow(finish, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
