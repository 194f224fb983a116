"""History as versions arrive: two states of a pool are held, never more."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "pool string, txg long, kind string, name string, guid long"
STATE = "txg long, guids array<long>, names array<string>"


def events(states: DataFrame) -> DataFrame:
    """Events between consecutive versions of each pool, from a stream of (pool, txg, guids, names).

    A row is a whole version: the GUIDs of its datasets and their names. The
    versions of a pool arrive in order; one that is not newer is left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = sorted((r for b in batches for r in zip(b["txg"], b["guids"], b["names"], strict=True)), key=lambda r: r[0])
        before, txg = None, -1
        if state.exists:
            txg, guids, names = state.get
            before = dict(zip(guids, names, strict=True))
        out = []
        for at, guids, names in rows:
            if at <= txg:
                continue
            now = dict(zip(map(int, guids), names, strict=True))
            if before is not None:
                out += [(key[0], at, "created", n, g) for g, n in now.items() if g not in before]
                out += [(key[0], at, "renamed", n, g) for g, n in now.items() if g in before and before[g] != n]
                out += [(key[0], at, "destroyed", n, g) for g, n in before.items() if g not in now]
            before, txg = now, int(at)
        if before is not None:
            state.update((txg, list(before), list(before.values())))
        yield pd.DataFrame(out, columns=["pool", "txg", "kind", "name", "guid"])

    return states.groupBy("pool").applyInPandasWithState(step, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)
