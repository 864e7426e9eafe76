"""NumPy forms of the measures, for scoring one short generated trace inside a task.

The DataFrame forms in operators.similarity are for traces of any size; both must agree (tests/test_similarity.py).
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

from ..operators.similarity import METHODS, Settings, bin_counts


class Events(Sequence):
    """Rows (time, direction, length) as columns: 17 bytes a row, where tuples in a list take more than a hundred."""

    def __init__(self) -> None:
        self.ts, self.direction, self.length = array("d"), array("b"), array("q")

    def append(self, row: tuple[float, int, int]) -> None:
        self.ts.append(row[0])
        self.direction.append(row[1])
        self.length.append(row[2])

    def __len__(self) -> int:
        return len(self.ts)

    def __getitem__(self, i):
        if isinstance(i, slice):
            return list(zip(self.ts[i], self.direction[i], self.length[i], strict=True))
        return self.ts[i], self.direction[i], self.length[i]

    def __iter__(self) -> Iterator[tuple[float, int, int]]:
        return zip(self.ts, self.direction, self.length, strict=True)

    def __eq__(self, other) -> bool:
        if isinstance(other, Events):
            return (self.ts, self.direction, self.length) == (other.ts, other.direction, other.length)
        return isinstance(other, list) and len(self) == len(other) and all(a == b for a, b in zip(self, other, strict=True))


@dataclass(frozen=True)
class Arrays:
    """A trace as columns."""

    ts: np.ndarray
    direction: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, events) -> Arrays:
        if isinstance(events, Events):
            return cls(np.array(events.ts, np.float64), np.array(events.direction, np.int64), np.array(events.length, np.int64))
        t, d, n = zip(*events, strict=True) if events else ((), (), ())
        return cls(np.array(t, np.float64), np.array(d, np.int64), np.array(n, np.int64))

    def __len__(self) -> int:
        return len(self.ts)

    @property
    def iats(self) -> np.ndarray:
        return np.diff(self.ts)


def ks_distance(a: np.ndarray, b: np.ndarray) -> float:
    """The largest gap, looked at where either sample has values."""
    a, b = np.sort(a), np.sort(b)
    gap = lambda x: float(np.max(np.abs(np.searchsorted(a, x, "right") / len(a) - np.searchsorted(b, x, "right") / len(b))))
    return max(gap(a), gap(b))


def autocorrelations(x: np.ndarray, lags) -> list[float]:
    """Around the whole mean, over the whole variance; scaled by a power of two so that squares don't overflow."""
    x = np.asarray(x, np.float64)
    if any(not 0 < k < len(x) for k in lags):
        raise ValueError("every lag must be positive and shorter than the sample")
    if np.all(x == x[0]):
        return [0.0] * len(lags)
    x = np.ldexp(x, -math.frexp(max(float(x.max()), -float(x.min())))[1])
    # exact for short traces; extended precision, a few units in 1e19, for long ones
    total = math.fsum(x.tolist()) if len(x) <= 50_000 else float(np.sum(x, dtype=np.longdouble))
    c = x - total / len(x)
    bottom = float(np.dot(c, c))
    return [0.0 if bottom == 0 else min(1.0, max(-1.0, float(np.dot(c[:-k], c[k:])) / bottom)) for k in lags]


def acf_score(a: Arrays, b: Arrays, s: Settings) -> float:
    d = []
    for x, y in ((a.iats, b.iats), (a.length, b.length)):
        pairs = zip(s.lag_weights, autocorrelations(x, s.lags), autocorrelations(y, s.lags), strict=True)
        d.append(math.fsum(w * abs(p - q) / 2 for w, p, q in pairs))
    return 1 - min(1.0, math.fsum((s.iat_weight * d[0], s.size_weight * d[1])))


def cells(t: Arrays, width: float, bins: int) -> tuple[np.ndarray, np.ndarray]:
    q = t.ts / width
    at = np.floor(q)
    # a quotient within four ULPs below an integer counts as that integer; few come near enough to be looked at
    close = np.flatnonzero(at + 1 - q <= 4 * np.spacing(q.max()))
    at[close] += at[close] + 1 - q[close] <= 4 * np.spacing(q[close])
    at = (np.minimum(at, bins - 1, out=at) + t.direction * bins).astype(np.int64)
    packets = np.bincount(at, minlength=2 * bins)
    if len(t) * int(t.length.max()) < 1 << 53:  # sums of doubles are exact up to there
        return packets, np.bincount(at, t.length, 2 * bins).astype(np.int64)
    size = np.zeros(2 * bins, np.int64)
    np.add.at(size, at, t.length)
    return packets, size


def l1(a: np.ndarray, b: np.ndarray) -> float:
    total = int(a.sum()) + int(b.sum())
    return int(np.abs(a - b).sum()) / total if total else 0.0


def multiscale_score(a: Arrays, b: Arrays, window: float, s: Settings) -> float:
    packet, byte = [], []
    for width, bins in zip(s.widths, bin_counts(window, s.widths, s.max_cells), strict=True):
        (pa, ba), (pb, bb) = cells(a, width, bins), cells(b, width, bins)
        packet.append(l1(pa, pb))
        byte.append(l1(ba, bb))
    p, q = (min(1.0, math.fsum(w * x for w, x in zip(s.scale_weights, d, strict=True))) for d in (packet, byte))
    return 1 - min(1.0, math.fsum((s.packet_weight * p, s.byte_weight * q)))


def require(events: int, s: Settings) -> None:
    if events - 1 <= max(s.lags) or events < 2:
        raise ValueError("similarity_precondition")


def compare(a: Arrays, b: Arrays, window: float, s: Settings) -> dict[str, float]:
    """The four scores and the aggregate of one aligned pair."""
    require(len(b), s)
    found = {
        "autocorrelation": acf_score(a, b, s),
        "frame_size_ks": 1 - ks_distance(a.length, b.length),
        "iat_ks": 1 - ks_distance(a.iats, b.iats),
        "multiscale_rate": multiscale_score(a, b, window, s),
    }
    return found | {"aggregate_score": min(1.0, math.fsum(s.method_weights[m] * found[m] for m in METHODS))}
