"""The reservoir with skips itself, for streams that want its state machine rather than a sample by priority.

Once k rows are held, the number of rows to pass over is drawn instead of a coin for each row:
W becomes W * U^(1/k), the skip is floor(log U / log(1 - W)), and the row after it replaces a
random slot.  With a predicate, only rows that are stopped at are judged: a row that fails costs
a new skip under the same W.  The state is (rows, W, skip), small enough for a state store.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


class Reservoir:
    def __init__(self, k: int, seed: int = 42, predicate: Callable[[object], bool] | None = None):
        if k < 0:
            raise ValueError("k >= 0")
        self.k, self.random, self.predicate = k, random.Random(seed), predicate
        self.rows: list = []
        self.w, self.skip, self.judged = 1.0, 0, 0

    def _shrink(self) -> None:
        self.w *= math.exp(math.log(1 - self.random.random()) / self.k)

    def _draw(self) -> None:
        below = math.log1p(-self.w) if self.w < 1 else -math.inf
        # W too small to tell from 0: no row is reached any more
        self.skip = (1 << 62) if below == 0 else int(min(math.log(1 - self.random.random()) / below, float(1 << 62)))

    def _passes(self, row) -> bool:
        self.judged += 1
        return self.predicate is None or bool(self.predicate(row))

    def add_all(self, rows: Iterable) -> None:
        for row in rows:
            if self.k == 0:
                return
            if len(self.rows) < self.k:
                if self._passes(row):
                    self.rows.append(row)
                    if len(self.rows) == self.k:
                        self._shrink()
                        self._draw()
            elif self.skip:
                self.skip -= 1
            else:
                if self._passes(row):
                    self.rows[self.random.randrange(self.k)] = row
                    self._shrink()
                self._draw()

    def state(self) -> tuple:
        return self.rows, self.w, self.skip, self.random.getstate()

    def restore(self, state: tuple) -> None:
        self.rows, self.w, self.skip = list(state[0]), state[1], state[2]
        self.random.setstate(state[3])


def reservoir_by_key(stream: DataFrame, key: str, value: str, k: int, seed: int = 42) -> DataFrame:
    """A streaming DataFrame (key, sample): a reservoir for each key, given out in full with each batch that has rows of it.

    key: a string column; value: a bigint column.  Keys bound the state: k values each.
    """
    import pickle

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        r = Reservoir(k, seed)
        if state.exists:
            r.restore(pickle.loads(state.get[0]))
        for frame in frames:
            r.add_all(int(x) for x in frame[value])
        state.update((pickle.dumps(r.state()),))
        yield pd.DataFrame({"key": [group[0]], "sample": [list(r.rows)]})

    return stream.groupBy(key).applyInPandasWithState(step, "key string, sample array<bigint>", "state binary", "update", GroupStateTimeout.NoTimeout)
