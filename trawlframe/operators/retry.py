"""Retry: a schedule of delays as a Column, and a loop for calls that Python has to make."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

T = TypeVar("T")


class Cancelled(Exception):
    """The crawl was stopped while a call was waiting for its turn."""


@dataclass(frozen=True)
class RetryConfig:
    """Delays are in seconds. retryable says of an error whether another try makes sense."""

    max_attempts: int = 3
    delay: float = 1.0
    max_delay: float = 3.0
    backoff_factor: float = 1.0
    jitter_factor: float = 0.1
    retryable: Callable[[Exception], bool] = lambda error: True

    def __post_init__(self):
        if self.max_attempts < 1 or self.delay < 0 or self.max_delay < 0 or self.backoff_factor < 0 or not 0 <= self.jitter_factor <= 1:
            raise ValueError(f"not a retry configuration: {self}")

    def wait(self, attempt: int, draw: float = 0.0) -> float:
        """Seconds after the attempt (from 0): backoff, then jitter, then the cap."""
        return min(self.delay * self.backoff_factor**attempt * (1 + draw * self.jitter_factor), self.max_delay)


def retry(call: Callable[[], T], config: RetryConfig | None = None, cancelled: Callable[[], bool] = lambda: False, sleep: Callable[[float], None] = time.sleep) -> T:
    """The result of the first call that succeeds, else the last error; an error that is not retryable is final.

    A wait follows every failure, the last one included.
    """
    config, error = config or RetryConfig(), None
    for attempt in range(config.max_attempts):
        if cancelled():
            raise Cancelled
        try:
            return call()
        except Exception as e:
            if not config.retryable(e):
                raise
            error = e
        sleep(config.wait(attempt, random.random()))
        if cancelled():
            raise Cancelled
    raise error


def delay_column(delay: Column, factor: Column, attempt: Column, cap: Column, jitter: Column | None = None) -> Column:
    """The same schedule as an expression, in the unit of delay and cap; without jitter it is deterministic."""
    d = delay * F.pow(factor, attempt)
    return F.least(d if jitter is None else d * (1 + F.rand() * jitter), cap)


def schedule(configs: DataFrame) -> DataFrame:
    """cfg, attempt, delay_ms for configs (cfg, attempts, delay_ms, max_delay_ms, factor)."""
    each = configs.select("*", F.explode(F.sequence(F.lit(0), F.col("attempts") - 1)).alias("attempt"))
    wait = delay_column(F.col("delay_ms").cast("double"), F.col("factor"), F.col("attempt").cast("double"), F.col("max_delay_ms").cast("double"))
    return each.select("cfg", F.col("attempt").cast("long").alias("attempt"), wait.alias("delay_ms"))


def outcomes(tries: DataFrame, max_attempts: int) -> DataFrame:
    """id, attempts made and ok, from logged tries (id, seq, ok, retryable): the first success or final error ends an item's tries."""
    order = Window.partitionBy("id").orderBy("seq")
    numbered = tries.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max_attempts)
    ends = F.min(F.when(F.col("ok") | ~F.col("retryable"), F.col("n")))
    found = numbered.groupBy("id").agg(F.coalesce(ends, F.max("n")).cast("long").alias("attempts"), F.min(F.when(F.col("ok"), F.col("n"))).alias("won"))
    return found.select("id", "attempts", F.coalesce(F.col("won") == F.col("attempts"), F.lit(False)).alias("ok"))
