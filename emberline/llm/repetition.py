"""Repetition within a document: maximal repeated substrings from LCP intervals of a suffix array over its words.

Only texts in which a window of `shortest` words comes twice have a repeat that counts; a hash of all windows finds them. They get one
suffix array for many texts at a time - a word is another symbol in another text, so no repeat runs over two - and the LCP of neighbours.
Its intervals are the repeats that cannot be extended to either side. Their spans' union gives the covered fraction; the longest of
them the longest repeat. Nested repeats, as of one word over and over, take no more room than the text: intervals are ranges of the array.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, chunks, column
from .fmindex import suffix_array
from .words import Words, utf8, windows

WINDOW = 8
"""Words of the base rule's windows, a fixed value."""
SHORTEST = 4
"""Words of the shortest repeat that counts. At sf0.1 four words and 30 % reject fifteen documents that the base rule keeps, texts whose words come
several times each; none of them is labelled as good."""
MAX_COVERED = 0.30
MAX_LONGEST = 100
_WORD = re.compile(r"[^\x20\x09-\x0D]")


def lcp(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix in order with the one before, by doubling: a block of 2^k symbols counts if all of it agrees."""
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    names, ranks = [], np.unique(text, return_inverse=True)[1].astype(np.int64)
    size = 1
    while size <= n:
        names.append(ranks)
        after = np.full(n, -1, np.int64)
        after[: n - size] = ranks[size:]
        ranks = np.unique(ranks * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        if ranks.max() == n - 1 or size * 2 > n:
            break
        size *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(names) - 1, -1, -1):
        step = 1 << k
        # Blocks that run over the end have names of their own only if both end there, so both must fit.
        fits = (a + step <= n) & (b + step <= n)
        same = fits & (names[k][np.minimum(a, n - 1)] == names[k][np.minimum(b, n - 1)])
        a, b = a + step * same, b + step * same
        out[1:] += step * same
    return out


def maximal_repeats(text: np.ndarray, order: np.ndarray, height: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """(length, left, right) of each substring of at least shortest symbols that comes twice or more and in each extension less often.

    order is the suffix array, height its LCP row. The substring's places are order[left:right]; there are fewer rows than symbols.
    """
    before = np.where(order > 0, text[order - 1], -1)
    # Occurrences with one symbol before all of them would extend to the left: their rows have no change of it.
    changes = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
    out: list[tuple[int, int, int]] = []
    high = np.flatnonzero(height >= shortest)
    breaks = np.flatnonzero(np.diff(high) > 1) + 1
    for part in np.split(high, breaks) if len(high) else ():
        # The rows of a part share shortest symbols with the row before; it begins after a row that does not.
        stack: list[tuple[int, int]] = []
        first = int(part[0])
        for i, h in enumerate([*height[part].tolist(), 0], first):
            left = i - 1
            while stack and stack[-1][0] > h:
                length, left = stack.pop()
                out.append((length, left, i))
            if h and (not stack or stack[-1][0] < h):
                stack.append((h, left))
    rows = np.array(out, np.int64).reshape(-1, 3)
    return rows[changes[rows[:, 2] - 1] > changes[rows[:, 1]]]


def measure(text: np.ndarray, owner: np.ndarray, texts: int, shortest: int = SHORTEST) -> np.ndarray:
    """Per text: symbols that repeats cover, the longest repeat's length and the number of maximal repeats.

    text holds the symbols of all texts one after the other, owner the text of each (below texts); texts have no symbol in common.
    """
    out = np.zeros((texts, 3), np.int64)
    if not len(text):
        return out
    order = suffix_array(text)
    height = lcp(text, order)
    rows = maximal_repeats(text, order, height, shortest)
    of = owner[order[rows[:, 1]]]
    np.maximum.at(out[:, 1], of, rows[:, 0])
    out[:, 2] = np.bincount(of, minlength=texts)
    # The longest repeat that begins at a place is the longer of its two LCPs, and lies in a maximal one; shorter ones lie in it.
    reach = np.maximum(height, np.append(height[1:], 0))
    long_ = reach >= shortest
    edge = np.zeros(len(text) + 1, np.int64)
    edge[order[long_]] += 1
    np.add.at(edge, order[long_] + reach[long_], -1)
    out[:, 0] = np.bincount(owner[np.cumsum(edge)[:-1] > 0], minlength=texts)
    return out


def repeated(words: Words, n: int) -> np.ndarray:
    """Places at which a window of n words begins that its text has twice or more."""
    owner, every = words.text_of(), windows(words.hash, n)
    inside = np.flatnonzero(owner[: len(every)] == owner[n - 1 :]) if len(every) else np.zeros(0, np.int64)
    key = every[inside] ^ (owner[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    by = np.argsort(key, kind="stable")
    equal = key[by][1:] == key[by][:-1]
    twice = np.zeros(len(by), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    return inside[by[twice]]


def _lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif _WORD.search(line):
            seen.add(line)
    return n


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "n_maximal_repeats")


def quality(docs: DataFrame, text: str = "text", shortest: int = SHORTEST, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """docs with counts of words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the suffix array's covered_words, longest_repeat (words) and
    n_maximal_repeats, base_failed (under 20 words, or over 30 % of the words in 8-word windows found twice) and kept.

    kept is false if base_failed, or if repeats of shortest words or more cover more than max_covered of the words or one is longer than
    max_longest words. A null or empty text has no words and fails; an empty table gives no rows. A text of any length takes memory in
    proportion to it. Input columns with these names are replaced; all others and repeated rows stay.
    """

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = [t or "" for t in column(batch, text)]
        data = [utf8(t) for t in texts]
        n = np.zeros((len(texts), len(_COLUMNS)), np.int64)
        for a, b in chunks(data):
            words = Words(data[a:b])
            owner = words.text_of()
            edge = np.zeros(len(owner) + 1, np.int64)
            at = repeated(words, WINDOW)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            n[a:b, 0] = np.diff(words.first)
            n[a:b, 4] = np.bincount(owner[np.cumsum(edge)[:-1] > 0], minlength=b - a)
            some = np.zeros(b - a, bool)
            some[owner[repeated(words, shortest)]] = True
            taken = some[owner]
            symbol = np.unique(words.hash[taken] + owner[taken].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), return_inverse=True)[1]
            n[a:b, 5:] = measure(symbol, owner[taken], b - a, shortest)
            for i, t in enumerate(texts[a:b], a):
                # Code points but for the six that part words, counted in C for each.
                n[i, 1:4] = len(t) - sum(map(t.count, " \t\n\x0b\x0c\r")), sum(map(t.count, "#*$%&|<>")), _lines(t)
        failed = (n[:, 0] < 20) | (100 * n[:, 4] > 30 * n[:, 0])
        kept = ~failed & (n[:, 5] <= max_covered * n[:, 0]) & (n[:, 6] <= max_longest)
        return [*(pa.array(n[:, j]) for j in range(len(_COLUMNS))), pa.array(failed), pa.array(kept)]

    fields = [T.StructField(c, T.LongType()) for c in _COLUMNS] + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
    return append_columns(docs, run, fields)
