"""Token budgets over a trailing minute."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values, in seconds: the window, the age at which an admission has surely left it, and the shortest wait.
WINDOW_S, GONE_S, LEAST_S = 60.0, 60.05, 0.1


class Admissions:
    """What was admitted lately. A request may go as soon as the tokens admitted in the trailing window leave room for its own; one that is
    larger than the limit, or empty, goes at once and isn't counted."""

    def __init__(self, limit: int) -> None:
        self.limit, self.times, self.sums = limit, [], [0]

    def earliest(self, now: float, tokens: int) -> float:
        """The time at which a request of ``now`` may go. If it doesn't fit, the admissions that must leave first are the shortest run,
        from the window's start, that frees what is lacking: sums are running totals, so its end is found by bisection."""
        if not 0 < tokens <= self.limit:
            return now
        start = bisect_right(self.times, now - WINDOW_S)
        lacking = self.sums[-1] - self.sums[start] + tokens - self.limit
        if lacking <= 0:
            return now
        return max(now + LEAST_S, self.times[bisect_left(self.sums, self.sums[start] + lacking) - 1] + GONE_S)

    def add(self, at: float, tokens: int) -> None:
        if 0 < tokens <= self.limit:
            self.times.append(at)
            self.sums.append(self.sums[-1] + tokens)
            if len(self.times) > 4096 and (old := bisect_right(self.times, at - WINDOW_S)) > 2048:
                self.times, self.sums = self.times[old:], self.sums[old:]


def demand(requests: DataFrame, key: str, at: str, tokens: str) -> DataFrame:
    """requests with in_window: tokens asked for under the same key in the 60 seconds up to each (``at`` in whole microseconds). A row is
    dealt to its own minute and, as a neighbour, to the next one, so a key's rows meet a minute at a time and not in one task."""
    dealt = requests.select(F.struct(*[requests[c] for c in requests.columns]).alias("r"), F.explode(F.when(F.col(at).isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("later"))
    at_, key_, tokens_ = (F.col("r").getField(c) for c in (at, key, tokens))
    dealt = dealt.select("r", "later", (F.floor(at_ / F.lit(60_000_000)) + F.col("later")).alias("minute"), at_.alias("at"), key_.alias("key"), tokens_.alias("tokens"))
    w = Window.partitionBy("key", "minute").orderBy("at").rangeBetween(-60_000_000 + 1, 0)
    return dealt.withColumn("in_window", F.sum("tokens").over(w)).where("later = 0").select(*[F.col("r").getField(c).alias(c) for c in requests.columns], "in_window")


def admitted(requests: DataFrame, key: str, at: str, tokens: str, ordinal: str, limit: int) -> DataFrame:
    """requests with admitted_at (seconds): each waits until the last minute's admitted tokens leave room. A wait moves those behind it, so
    a key's requests are gone through in order, as a stream of batches with a minute's admissions as state. One larger than the limit goes
    at once and isn't counted."""
    ordered = requests.select(key, ordinal, F.col(at).cast("double").alias(at), tokens).repartition(key).sortWithinPartitions(key, ordinal)

    def run(batches):
        now_key, clock, seen = None, 0.0, Admissions(limit)
        for pdf in batches:
            out = []
            for k, t, n in zip(pdf[key], pdf[at], pdf[tokens]):
                if k != now_key:
                    now_key, clock, seen = k, float("-inf"), Admissions(limit)
                clock = seen.earliest(max(clock, float(t)), n)
                seen.add(clock, n)
                out.append(clock)
            yield pdf.assign(admitted_at=pd.Series(out, index=pdf.index, dtype=float))

    return ordered.mapInPandas(run, T.StructType([*ordered.schema.fields, T.StructField("admitted_at", T.DoubleType())]))
