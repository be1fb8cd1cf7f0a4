"""Rules that are sequential within a key: a group comes in order, in batches, and never as a whole.

The rows are partitioned by the key and sorted by key and order once; Spark then hands a group's batches to an iterator without another
sort. A key's rows pass through one task, as such rules demand, in bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def folded(rows: DataFrame, key: str, order: str, start: Callable[[], Any], step: Callable[[Any, Any], tuple[Any, tuple | None]], columns: list[str], fields: str) -> DataFrame:
    """(key, *fields): for each key a state from ``start`` runs through its rows (order, *columns) in order; ``step`` gives the next state and the
    row to emit, if any. Null keys and orders are left out."""
    kind = rows.schema[key].dataType.simpleString()
    names = [key, *(f.split()[0] for f in fields.split(", "))]
    taken = list(dict.fromkeys([order, *columns]))

    def run(k: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = start()
        for b in batches:
            out = []
            for row in zip(*(b[c].tolist() for c in taken)):
                state, made = step(state, row)
                if made is not None:
                    out.append((k[0], *made))
            yield pd.DataFrame(out, columns=names)

    base = rows.select(key, *taken).filter(f"`{key}` is not null and `{order}` is not null")
    return base.repartition(key).sortWithinPartitions(key, order).groupBy(key).applyInPandas(run, f"`{key}` {kind}, {fields}")
