"""Walks as a stream: level records arrive, a walk's verdict leaves when three levels agree, later levels are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ladder import STREAK
from ..schemas import DECISIVE

OUT = "warning_id string, walk int, stable_label string, base_level int, confirmed_at_level int"
STATE = "done boolean, next_level int, base_label string, base_level int, streak int, waiting string"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Levels count in their order: one that comes early waits in the state for those before it."""
    done, nxt, label, base, streak, waiting = state.get if state.exists else (False, 1, "", 0, 0, "")
    held = {int(k): v for k, v in (x.split("=") for x in waiting.split(";") if x)}
    for pdf in batches:
        for level, told in zip(pdf["level"], pdf["label"]):
            if int(level) >= nxt:
                held[int(level)] = told if isinstance(told, str) else ""
    out = []
    while not done and nxt in held:
        told = held.pop(nxt)
        if told not in DECISIVE:
            label, base, streak = "", 0, 0
        elif told == label:
            streak += 1
        else:
            label, base, streak = told, nxt, 1
        if streak >= STREAK:
            done = True
            out.append((key[0], int(key[1]), label, base, nxt))
        nxt += 1
    state.update((done, nxt, label, base, streak, "" if done else ";".join(f"{k}={v}" for k, v in sorted(held.items()))))
    if out:
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def confirmed(levels: DataFrame) -> DataFrame:
    """Confirmed walks of a stream of (warning_id, walk, level, label). State for a walk: one window, and the levels that came early."""
    return levels.groupBy("warning_id", "walk").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
