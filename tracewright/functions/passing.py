"""The measures of kernels for a trace that comes in parts: what is held doesn't grow with the trace.

Equal to kernels.compare on the whole trace, autocorrelations up to the last digits. The distance of inter-arrival times needs
more than one look; here values are counted at given limits (see operators.scoring).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from ..operators.similarity import Settings, bin_counts
from .kernels import Arrays, cells, l1


@dataclass
class Sums:
    """Sums of a series around a fixed point, for its autocorrelations; those of adjoining pieces add up."""

    point: float
    n: int
    total: float
    squares: float
    products: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    low: float
    high: float

    @classmethod
    def of(cls, x: np.ndarray, lags: tuple[int, ...], point: float) -> Sums:
        # in units of the point's size, so that squares stay in range
        c, most = np.ldexp(np.asarray(x, np.float64), -math.frexp(point)[1]) - math.frexp(point)[0], max(lags)
        products = np.array([float(np.dot(c[:-k], c[k:])) for k in lags], np.longdouble)
        return cls(point, len(c), np.sum(c, dtype=np.longdouble), np.longdouble(np.dot(c, c)), products, c[:most].copy(), c[-most:].copy(), float(c.min()), float(c.max()))

    def plus(self, x: Sums, lags: tuple[int, ...]) -> Sums:
        most, a, b = max(lags), len(self.tail), np.concatenate((self.tail, x.head))
        # pairs over the border; a tail and a head hold as many values as the longest lag, or all there are
        across = [float(np.dot(b[max(0, a - k) : max(0, min(a, len(b) - k))], b[max(0, a - k) + k : max(0, min(a, len(b) - k)) + k])) for k in lags]
        head = self.head if len(self.head) == most else np.concatenate((self.head, x.head))[:most]
        tail = x.tail if len(x.tail) == most else np.concatenate((self.tail, x.tail))[-most:]
        return Sums(self.point, self.n + x.n, self.total + x.total, self.squares + x.squares, self.products + x.products + across, head, tail, min(self.low, x.low), max(self.high, x.high))

    def autocorrelations(self, lags: tuple[int, ...]) -> list[float]:
        if any(not 0 < k < self.n for k in lags):
            raise ValueError("every lag must be positive and shorter than the sample")
        if self.low == self.high:
            return [0.0] * len(lags)
        mean = self.total / self.n
        bottom = self.squares - self.total * mean
        out = []
        for k, xy in zip(lags, self.products, strict=True):
            ends = 2 * self.total - np.sum(self.tail[-k:], dtype=np.longdouble) - np.sum(self.head[:k], dtype=np.longdouble)
            out.append(0.0 if bottom <= 0 else min(1.0, max(-1.0, float((xy - mean * ends + (self.n - k) * mean * mean) / bottom))))
        return out


def counted(x: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Values below each limit, and up to each: two rows. x is sorted."""
    return np.stack((np.searchsorted(x, limits, "left"), np.searchsorted(x, limits, "right")))


def frame_size_distance(lengths: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray]) -> float:
    """kernels.ks_distance of lengths that are counted by value, ascending."""
    at = np.union1d(lengths[0], others[0])
    a, b = (np.append(0, np.cumsum(n))[np.searchsorted(x, at, "right")] / n.sum() for x, n in (lengths, others))
    return float(np.max(np.abs(a - b)))


class Passing:
    """Figures of a trace, a part at a time."""

    def __init__(self, window: float, s: Settings, points: tuple[float | None, float], limits: np.ndarray):
        """points: where sums of inter-arrival times and of lengths are taken around; None for the mean of the first part."""
        self.window, self.s, self.points, self.limits = window, s, list(points), limits
        self.events, self.last, self.sums = 0, None, [None, None]
        self.lengths = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.bins = bin_counts(window, s.widths, s.max_cells)
        self.cells = [(np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)) for n in self.bins]
        self.counts = np.zeros((2, len(limits)), np.int64)

    def add(self, t: Arrays) -> np.ndarray:
        """The part's inter-arrival times, the one to the part before included, ascending."""
        gaps = np.diff(t.ts if self.last is None else np.append(self.last, t.ts))
        self.events, self.last = self.events + len(t), float(t.ts[-1])
        for i, x in enumerate((gaps, t.length)):
            if len(x):
                if self.points[i] is None:
                    self.points[i] = float(np.mean(x))
                more = Sums.of(x, self.s.lags, self.points[i])
                self.sums[i] = more if self.sums[i] is None else self.sums[i].plus(more, self.s.lags)
        values, n = np.unique(t.length, return_counts=True)
        both, at = np.unique(np.concatenate((self.lengths[0], values)), return_inverse=True)
        self.lengths = both, np.bincount(at, np.concatenate((self.lengths[1], n)), len(both)).astype(np.int64)
        for (packets, size), width, bins in zip(self.cells, self.s.widths, self.bins, strict=True):
            p, b = cells(t, width, bins)
            packets += p
            size += b
        gaps.sort()
        self.counts += counted(gaps, self.limits)
        return gaps


def acf_score(ours: list[list[float]], theirs: list[list[float]], s: Settings) -> float:
    """kernels.acf_score from the autocorrelations of inter-arrival times and of lengths."""
    d = [math.fsum(w * abs(p - q) / 2 for w, p, q in zip(s.lag_weights, x, y, strict=True)) for x, y in zip(ours, theirs, strict=True)]
    return 1 - min(1.0, math.fsum((s.iat_weight * d[0], s.size_weight * d[1])))


def multiscale_score(ours: list[tuple], theirs: list[tuple], s: Settings) -> float:
    """kernels.multiscale_score from the cells of each width."""
    d = [[l1(x[i], y[i]) for x, y in zip(ours, theirs, strict=True)] for i in (0, 1)]
    p, q = (min(1.0, math.fsum(w * x for w, x in zip(s.scale_weights, each, strict=True))) for each in d)
    return 1 - min(1.0, math.fsum((s.packet_weight * p, s.byte_weight * q)))
