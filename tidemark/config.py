"""Parameters of the detectors, with the sizing rules of their sketches. Every value is checked when it is set."""

from __future__ import annotations

import math
from dataclasses import dataclass


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class CountMin:
    """A Count-Min Sketch of depth rows and width columns. Estimates never fall short; they exceed by at most epsilon x total with probability 1 - delta."""

    width: int = 544
    depth: int = 7
    seed: int = 0

    def __post_init__(self):
        _need(self.width > 0 and self.depth > 0, "width and depth must be positive")

    @classmethod
    def from_error_delta(cls, epsilon: float, delta: float, seed: int = 0) -> CountMin:
        _need(0 < epsilon < 1 and 0 < delta < 1, "epsilon and delta must lie between 0 and 1")
        return cls(math.ceil(math.e / epsilon), math.ceil(math.log(1 / delta)), seed)

    @property
    def memory_bytes(self) -> int:
        return self.width * self.depth * 8


@dataclass(frozen=True)
class Bloom:
    """A Bloom filter for `capacity` keys with a false-positive rate of `error_rate` at capacity."""

    capacity: int = 100_000
    error_rate: float = 0.01
    seed: int = 0

    def __post_init__(self):
        _need(self.capacity > 0, "capacity must be positive")
        _need(0 < self.error_rate < 1, "error_rate must lie between 0 and 1")

    @property
    def bits(self) -> int:
        return math.ceil(-self.capacity * math.log(self.error_rate) / math.log(2) ** 2)

    @property
    def hashes(self) -> int:
        return max(1, round(self.bits / self.capacity * math.log(2)))


@dataclass(frozen=True)
class Burst:
    """A term bursts if it occurs at least min_count times in the later half of the window, and threshold times as often as in the half before."""

    window: int = 50
    threshold: float = 2.0
    min_count: int = 1
    epsilon: float = 1e-6

    def __post_init__(self):
        _need(self.window >= 2, "the window must hold two messages")
        _need(self.threshold > 0 and self.min_count >= 0 and self.epsilon > 0, "threshold and epsilon must be positive, min_count not negative")

    @property
    def half(self) -> int:
        return self.window // 2


@dataclass(frozen=True)
class Duplicates:
    """A message is a duplicate if at least `threshold` of its word k-grams occurred in earlier messages."""

    shingle: int = 3
    threshold: float = 0.7
    bloom: Bloom = Bloom()

    def __post_init__(self):
        _need(self.shingle >= 1, "shingle must be positive")
        _need(0 < self.threshold <= 1, "threshold must lie in (0, 1]")


@dataclass(frozen=True)
class Run:
    """A run over a message stream: a snapshot every `interval` processed messages, `top` terms in a report.

    All terms are candidates for a report; `tracked` only bounds how many it may ask for."""

    interval: int = 100
    top: int = 10
    tracked: int = 10_000
    max_messages: int | None = 200
    exclude_duplicates: bool = False
    count_min: CountMin = CountMin()
    burst: Burst = Burst()
    duplicates: Duplicates = Duplicates()

    def __post_init__(self):
        _need(self.interval > 0, "interval must be positive")
        _need(0 < self.top <= self.tracked, "top must be positive, and at most tracked")
        _need(self.max_messages is None or self.max_messages >= 0, "max_messages must not be negative")
