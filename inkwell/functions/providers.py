"""Hooks for external models: retries with backoff, a circuit breaker, and an embedding column.

Spark retries lost tasks; these guard the calls that a task makes to a provider.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, TypeVar

import pandas as pd
from pyspark.sql import functions as F, types as T

R = TypeVar("R")


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class Retry:
    attempts: int = 3
    first_delay: float = 0.1
    factor: float = 2.0
    longest: float = 5.0

    def delays(self) -> list[float]:
        return [min(self.longest, self.first_delay * self.factor**i) for i in range(self.attempts - 1)]


@dataclass
class Breaker:
    """Refuses calls for ``cool_down`` seconds after ``limit`` failures in a row."""

    limit: int = 5
    cool_down: float = 30.0
    clock: Callable[[], float] = time.monotonic
    failures: int = field(default=0, init=False)
    opened: float = field(default=0.0, init=False)

    def call(self, run: Callable[[], R]) -> R:
        if self.failures >= self.limit and self.clock() - self.opened < self.cool_down:
            raise RuntimeError("provider is paused after repeated failures")
        try:
            out = run()
        except Exception:
            self.failures += 1
            self.opened = self.clock()
            raise
        self.failures = 0
        return out


def with_retries(run: Callable[[], R], policy: Retry = Retry(), breaker: Breaker | None = None, sleep: Callable[[float], None] = time.sleep) -> R:
    """The first success; the last failure if there is none."""
    guarded = run if breaker is None else lambda: breaker.call(run)
    for delay in policy.delays():
        try:
            return guarded()
        except Exception:
            sleep(delay)
    return guarded()


def embedding(make: Callable[[], Embedder], batch: int = 128, policy: Retry = Retry()):
    """A column function text -> array<double> that calls a provider in batches, one client per worker."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        client, out = make(), []
        for at in range(0, len(texts), batch):
            part = [t or "" for t in texts.iloc[at : at + batch]]
            out += with_retries(lambda: client.embed(part), policy)
        if any(len(v) != client.dimension for v in out):
            raise ValueError("vector dimension differs from the provider's")
        return pd.Series(out)

    return run
