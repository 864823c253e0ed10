"""Plateau detection over a stream of step records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship

SCHEMA = "run_id string, step long, value double, prev double, cur double, flats long, plateaued boolean"


def stream_plateau(stream: DataFrame, *, window: int = 3, rel_tol: float = 0.05, patience: int = 2) -> DataFrame:
    """A row for each record ``run_id, step, value`` with the plateau state of its run so far. The
    state of a run is its last ``2 * window`` values and a counter; records come in order of step
    within a trigger, and ones behind the state's step are taken as they arrive."""
    ship(stream.sparkSession)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        values, flats = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(batches)).sort_values("step")
        out = []
        for step, value in zip(rows["step"], rows["value"], strict=True):
            values = (values + [float(value)])[-2 * window :]
            prev = cur = None
            if len(values) == 2 * window:
                prev, cur = sum(values[:window]) / window, sum(values[window:]) / window
                flats = flats + 1 if (prev - cur) / (abs(prev) + 1e-12) < rel_tol else 0
            out.append((key[0], int(step), float(value), prev, cur, flats, flats >= patience))
        state.update((values, flats))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return stream.groupBy("run_id").applyInPandasWithState(update, SCHEMA, "values array<double>, flats long", "append", "NoTimeout")
