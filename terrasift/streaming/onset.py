"""The causal onset machine over a stream: one small state a site.

The same transitions as ``operators.onset.run_causal``; a site's observations must
arrive in order (late ones are left out), which is what causality means here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from terrasift.operators.onset import CONFIRMED, INSUFFICIENT, NO_CHANGE, PROVISIONAL

OUTPUT = "uid long, ord int, state string, changed_now boolean, n_clear int, run int, provisional int, confirmed int"
STATE = "last int, n int, run int, miss int, p int, c int"


def advance(state: tuple, ordinal: int, clear: bool, changed: bool, confirm_n: int = 2, min_clear_history: int = 3, allow_gap: int = 1) -> tuple[tuple, tuple]:
    """The next (last, n, run, miss, p, c) and the call."""
    _, n, run, miss, p, c = state
    if not clear:
        return (ordinal, n, run, miss, p, c), (ordinal, INSUFFICIENT, False, n, run, p, c)
    n, miss = n + 1, 0 if changed else miss + 1
    if changed:
        run += 1
    elif miss > allow_gap:
        run, p = 0, p if c is not None else None
    label = INSUFFICIENT
    if n >= min_clear_history:
        label = NO_CHANGE if run == 0 else CONFIRMED if run >= confirm_n else PROVISIONAL
        if run:
            p = ordinal if p is None else p
        if run >= confirm_n and c is None:
            c = p
    return (ordinal, n, run, miss, p, c), (ordinal, label, changed, n, run, p, c)


def causal_stream(observations: DataFrame) -> DataFrame:
    """Calls for a stream of (uid long, ord int, clear boolean, changed boolean)."""

    def step(key, frames: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        whole = lambda v: None if v is None or v != v else int(v)
        state = tuple(map(whole, group.get)) if group.exists else (-(2**31), 0, 0, 0, None, None)
        rows = pd.concat(frames).sort_values("ord")
        out = []
        for ordinal, clear, changed in zip(rows["ord"], rows["clear"], rows["changed"], strict=True):
            if int(ordinal) > state[0]:
                state, call = advance(state, int(ordinal), bool(clear), bool(changed))
                out.append((key[0], *call))
        group.update(state)
        frame = pd.DataFrame(out, columns=["uid", "ord", "state", "changed_now", "n_clear", "run", "provisional", "confirmed"])
        yield frame.astype({"provisional": "Int64", "confirmed": "Int64"})

    return observations.groupBy("uid").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout")
