"""Retries with backoff and jitter, and a circuit breaker, for calls that leave the cluster (drivers, catalogues, sinks)."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field


class CircuitOpen(RuntimeError):
    """Too many calls failed lately; none is tried until the pause is over."""


@dataclass
class Resilience:
    """``call(f)``: up to ``attempts`` tries, each pause twice the last, give or take ``jitter``; ``failures`` failed calls in a row open the circuit for ``pause`` seconds."""

    attempts: int = 3
    base: float = 0.2
    most: float = 30.0
    jitter: float = 0.25
    failures: int = 5
    pause: float = 30.0
    retry_on: tuple[type[BaseException], ...] = (Exception,)
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    _failed: int = field(default=0, init=False)
    _opened: float | None = field(default=None, init=False)

    def call(self, f: Callable, *args, **kwargs):
        if self._opened is not None:
            if self.clock() - self._opened < self.pause:
                raise CircuitOpen(f"open for {self.pause} s after {self._failed} failures")
            self._opened = None  # half open: this call decides
        for attempt in range(self.attempts):
            try:
                result = f(*args, **kwargs)
            except self.retry_on:
                if attempt + 1 < self.attempts:
                    wait = min(self.most, self.base * 2**attempt)
                    self.sleep(wait * (1 + random.uniform(-self.jitter, self.jitter)))
                    continue
                self._failed += 1
                if self._failed >= self.failures:
                    self._opened = self.clock()
                raise
            self._failed = 0
            return result
        raise ValueError("attempts must be at least 1")
