"""Level evaluation: an evaluator answers prompts; the ladder asks level by level and stops walks that have settled."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import extract_label, is_rate_limit
from ..operators import ladder as L
from ..operators.throttle import Admissions
from ..schemas import USAGE
from ..store import stored


class Evaluator(Protocol):
    """Answers one prompt: (text, reasoning, usage of input, output and total tokens). Built once for each partition."""

    def __call__(self, context: str, prompt: str, warning_id: str, walk: int, level: int) -> tuple[str, str | None, tuple[int, int, int] | None]: ...


class Offline:
    """Answers without a network: a table of words decides, so tests can script labels."""

    def __init__(self, rules: tuple[tuple[str, str], ...] = (("strcpy", "TP"), ("memcpy", "TP"), ("snprintf", "FP")), otherwise: str = "UNKNOWN") -> None:
        self.rules, self.otherwise = rules, otherwise

    def __call__(self, context, prompt, warning_id, walk, level):
        label = next((label for word, label in self.rules if word in prompt), self.otherwise)
        text = f'{{"label": "{label}", "reason": "offline", "evidence": []}}'
        n, m = (len(context) + len(prompt)) // 4, len(text) // 4
        return text, None, (n, m, n + m)


class Scripted:
    """Answers by (warning_id, walk, level)."""

    def __init__(self, labels: dict[tuple[str, int, int], str | None]) -> None:
        self.labels = labels

    def __call__(self, context, prompt, warning_id, walk, level):
        label = self.labels.get((warning_id, walk, level))
        return (f'{{"label": "{label}"}}' if label else "no answer"), None, None


def limited(message: str) -> bool:
    """A failure that waiting may mend. The same test as functions.text.is_rate_limit, for one message."""
    low = message.lower()
    return any(x in low for x in ("ratelimiterror", "rate_limit_error", " 429"))


def asked(evaluator: Evaluator, retries: int, backoff: float, wait: Callable[[float], None], *prompt):
    """The evaluator's answer; after a rate limit again, twice as late each time and up to a second more."""
    for attempt in range(retries + 1):
        try:
            return evaluator(*prompt)
        except Exception as e:  # noqa: BLE001  others are raised again
            if attempt == retries or not limited(f"{type(e).__name__}: {e}"):
                raise
            wait(backoff * 2**attempt + random.uniform(0, 1))


class Budget:
    """Tokens that a partition may ask for in a minute: its part of the whole budget, so the sum over partitions keeps to it."""

    def __init__(self, per_minute: int, clock=time.time, wait=time.sleep) -> None:
        self.clock, self.wait, self.admissions = clock, wait, Admissions(per_minute)

    def __call__(self, tokens: int) -> None:
        while (at := self.admissions.earliest(now := self.clock(), tokens)) > now:
            self.wait(at - now)
        self.admissions.add(now, tokens)


ANSWER = T.StructType([T.StructField("response", T.StringType()), T.StructField("reasoning", T.StringType()), T.StructField("usage", USAGE), T.StructField("error", T.StringType())])


def evaluated(prompts: DataFrame, make: Callable[[], Evaluator], retries: int = 5, backoff: float = 2.0, tokens_per_minute: int = 0, concurrency: int | None = None) -> DataFrame:
    """prompts with level records. A prompt that couldn't be built, or a call that fails, is a row with an error and no label.

    concurrency: partitions that call at the same time; the token budget is divided among them."""
    keep = prompts.select("warning_id", "walk", "level", "context", "input", "prompt_error", "estimated_input_tokens")
    if concurrency:
        keep = keep.repartition(concurrency)
    share = tokens_per_minute // (concurrency or max(1, int(prompts.sparkSession.conf.get("spark.sql.shuffle.partitions")))) if tokens_per_minute else 0
    schema = T.StructType([*[f for f in keep.schema.fields if f.name not in ("context", "input", "prompt_error")], *ANSWER.fields])

    def run(batches):
        import pandas as pd

        evaluator, budget = make(), Budget(share)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                answer = (None, None, None, None)
                if isinstance(r.prompt_error, str):
                    answer = (None, None, None, f"prompt_build_error: {r.prompt_error}")
                else:
                    try:
                        budget(int(r.estimated_input_tokens))
                        text, why, usage = asked(evaluator, retries, backoff, time.sleep, r.context, r.input, r.warning_id, int(r.walk), int(r.level))
                        answer = (text, why, dict(zip(USAGE.names, usage)) if usage else None, None)
                    except Exception as e:  # noqa: BLE001  the row tells it
                        answer = (None, None, None, f"{type(e).__name__}: {e}")
                rows.append((r.warning_id, int(r.walk), int(r.level), int(r.estimated_input_tokens), *answer))
            yield pd.DataFrame(rows, columns=schema.names)

    return keep.mapInPandas(run, schema).withColumn("label", extract_label(F.col("response")))


def climb(planned: DataFrame, build: Callable[[DataFrame], DataFrame], make: Callable[[], Evaluator], **options) -> DataFrame:
    """Level records of all walks, asked level by level: a walk that is confirmed leaves the frontier, so no call is made for it.

    planned: warning_id, walk, level. build: rows of planned to prompts. Each level's records are stored before labels are derived, since
    evaluation isn't repeatable. The loop runs as often as the deepest plan has levels."""
    deepest = planned.agg(F.max("level")).first()[0] or 0
    done = None
    for level in range(1, deepest + 1):
        now = planned.where(F.col("level") == level)
        if done is not None:
            confirmed = L.streaks(done).where(F.col("streak") >= L.STREAK).select("warning_id", "walk").distinct()
            now = now.join(confirmed, ["warning_id", "walk"], "left_anti")
        records = stored(evaluated(build(now), make, **options), f"level-{level}")
        if records.isEmpty():
            break
        done = records if done is None else done.unionByName(records)
    return done if done is not None else planned.withColumns({"label": F.lit(None).cast("string")}).limit(0)


def with_plan(records: DataFrame, planned: DataFrame) -> DataFrame:
    """Records and, without labels, the planned levels that were not asked: walks then know that they stopped early."""
    extra = planned.select("warning_id", "walk", "level").join(records.select("warning_id", "walk", "level"), ["warning_id", "walk", "level"], "left_anti")
    return records.unionByName(extra, allowMissingColumns=True)


__all__ = ["Budget", "Evaluator", "Offline", "Scripted", "asked", "climb", "evaluated", "is_rate_limit", "with_plan"]
