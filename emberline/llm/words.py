"""Words of many texts at once: boundaries and 64-bit hashes with numpy, over the UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from .common import mixed

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
"""Lower-cases A-Z and nothing else."""
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for i, base in enumerate((_ODD, inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of texts (UTF-8 bytes), all in one row.

    hash: of each word; first: the number of words before each text, one entry more than texts; start, end: byte places
    in data, where each text is followed by one space.
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.data = b" ".join(texts) + b" "
        raw = np.frombuffer(self.data, np.uint8)
        space = _SPACE[raw]
        inside = np.concatenate(([False], ~space))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text_start = np.concatenate(([0], ends))[:-1]
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends)))
        power, inverse = _power_tables(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * power[: len(raw)], out=sums[1:])
        self.hash = mixed((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def text_of(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words; entry i starts at word i. The last n-1 words start none."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * _ODD + h[i : len(h) - n + 1 + i]
    return mixed(out)


def utf8(text: str | None, lower: bool = False) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.translate(LOWER) if lower else data
