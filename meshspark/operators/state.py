"""Series and per-vertex states: plateaus, fit state, step records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .topology import CORNERS


def plateau(series: DataFrame, *, by: list[str], order: list[str], value: str = "value", window: int = 3, rel_tol: float = 0.05, abs_tol: float | None = None, patience: int = 2, min_updates: int = 0) -> DataFrame:
    """Adds ``prev, cur`` (means of the older and newer ``window`` values), ``flat``, ``flats`` (flat
    updates in a row) and ``plateaued`` to each row of a series."""
    w = Window.partitionBy(*by).orderBy(*order)
    span = lambda a, b: w.rowsBetween(a, b)
    out = series.withColumns({"nth": F.row_number().over(w), "prev": F.avg(value).over(span(-(2 * window - 1), -window)), "cur": F.avg(value).over(span(-(window - 1), 0))})
    ready = (F.col("nth") >= 2 * window) & (F.col("nth") >= min_updates)
    drop = F.col("prev") - F.col("cur")
    flat = drop / (F.abs("prev") + 1e-12) < rel_tol
    if abs_tol is not None:
        flat = flat | (drop < abs_tol)
    out = out.withColumn("flat", ready & F.coalesce(flat, F.lit(False)))
    run = F.sum((~F.col("flat")).cast("long")).over(span(Window.unboundedPreceding, 0))
    out = out.withColumn("_run", run)
    inner = Window.partitionBy(*by, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("flats", F.sum(F.col("flat").cast("long")).over(inner)).withColumn("plateaued", F.col("flats") >= patience).drop("_run", "nth")


def ema(series: DataFrame, *, by: list[str], order: list[str], value: str, beta: float) -> DataFrame:
    """Adds ``ema`` of the drops of a series: 0 until there is a previous value."""
    w = Window.partitionBy(*by).orderBy(*order)
    held = series.withColumn("_drop", F.lag(value).over(w) - F.col(value))
    upto = held.withColumn("_all", F.collect_list("_drop").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return upto.withColumn("ema", F.aggregate("_all", F.lit(0.0), lambda s, d: beta * s + (1 - beta) * d)).drop("_drop", "_all")


def initial_state(vertices: DataFrame, level: int = -1) -> DataFrame:
    return vertices.select("vid", F.lit(True).alias("optimizable"), F.lit(0).alias("blocked_count"), F.lit(float("inf")).alias("resid_prev"), F.lit(0.0).alias("resid_drop_ema"), F.lit(level).alias("last_refine"))


def next_state(state: DataFrame, moves: DataFrame, tau: float, *, error_tau: float = 1.0, intended_tau: float = 0.02, actual_tau: float = 0.02, actual_part: float = 0.1, patience: int = 3, beta: float = 0.8) -> DataFrame:
    """The state after a step; ``moves`` has ``vid, resid, intended, actual``.

    A vertex is stalled if it wants to move and is still off but barely moved, absolutely or beside
    what it intended; after ``patience`` stalls in a row it is no longer optimizable, for good.
    """
    both = state.join(moves, "vid", "left")
    stalled = (F.col("intended") > intended_tau * tau) & (F.col("resid") > error_tau * tau) & ((F.col("actual") < actual_tau * tau) | (F.col("actual") < actual_part * F.col("intended")))
    stalled = F.coalesce(stalled, F.lit(False))
    count = F.when(stalled, F.col("blocked_count") + 1).otherwise(F.lit(0))
    finite = F.col("resid_prev") < float("inf")
    drop = F.when(finite, beta * F.col("resid_drop_ema") + (1 - beta) * (F.col("resid_prev") - F.col("resid"))).otherwise(F.col("resid_drop_ema"))
    return both.select("vid", (F.col("optimizable") & (count < patience)).alias("optimizable"), count.cast("int").alias("blocked_count"), F.coalesce("resid", "resid_prev").alias("resid_prev"), F.coalesce(drop, F.col("resid_drop_ema")).alias("resid_drop_ema"), "last_refine")


#: What stands for a residual without history in attributes that are averaged, and from where on an average has none.
NO_HISTORY, NONE_FROM = 1e30, 1e29


def state_attributes(state: DataFrame) -> DataFrame:
    """The state as numbers that midpoints can average: ``vid`` and five doubles."""
    prev = F.when(F.col("resid_prev") < float("inf"), F.col("resid_prev")).otherwise(NO_HISTORY)
    return state.select("vid", *[F.col(c).cast("double").alias(c) for c in ("optimizable", "blocked_count")], prev.alias("resid_prev"), "resid_drop_ema", F.col("last_refine").cast("double").alias("last_refine"))


def restored_state(attributes: DataFrame, originals: DataFrame) -> DataFrame:
    """The state of averaged attributes. An original vertex (``vid``) is as it was; a new one is optimizable if any parent was.
    Counts are rounded (halves to even) and 0 where optimizable; the last refinement is rounded up."""
    old = originals.select("vid", F.lit(True).alias("_old"))
    rows = attributes.join(old, "vid", "left")
    open_ = F.col("optimizable") > F.when(F.col("_old"), 0.5).otherwise(1e-6)
    prev = F.when(F.col("resid_prev") >= NONE_FROM, float("inf")).otherwise(F.col("resid_prev"))
    return rows.select("vid", open_.alias("optimizable"), F.when(open_, F.lit(0)).otherwise(F.bround("blocked_count")).cast("int").alias("blocked_count"), prev.alias("resid_prev"), "resid_drop_ema", F.ceil(F.col("last_refine") - 1e-6).cast("int").alias("last_refine"))


def midpoint_state(state: DataFrame, ends: DataFrame) -> DataFrame:
    """States of midpoints ``vid`` between ``e0`` and ``e1``: :func:`restored_state` of the ends' averages."""
    held = state_attributes(state)
    side = lambda e, p: held.select(F.col("vid").alias(e), *[F.col(c).alias(f"{p}{c}") for c in held.columns if c != "vid"])
    both = ends.join(side("e0", "u_"), "e0").join(side("e1", "v_"), "e1")
    blended = both.select("vid", *[((F.col(f"u_{c}") + F.col(f"v_{c}")) / 2.0).alias(c) for c in held.columns if c != "vid"])
    return restored_state(blended, blended.select("vid").limit(0))


def face_state(state: DataFrame, faces: DataFrame, tau: float, drop_tau: float = 0.02, blocked: float = 0.5) -> DataFrame:
    """``fid, plateau, blocked, last_refine`` from the three corners' states."""
    each = faces.select("fid", F.explode(F.array(*CORNERS)).alias("vid")).join(state, "vid")
    return each.groupBy("fid").agg((F.avg("resid_drop_ema") < drop_tau * tau).alias("plateau"), (F.avg((~F.col("optimizable")).cast("double")) > blocked).alias("blocked"), F.max("last_refine").alias("last_refine"))


def step_fit_error(rows: DataFrame) -> DataFrame:
    """One row: mean and largest ``error`` where ``weight`` is positive, or everywhere if it is nowhere."""
    kept = F.when(F.col("weight") > 0, F.col("error"))
    return rows.agg(F.coalesce(F.avg(kept), F.avg("error")).alias("mean_error"), F.coalesce(F.max(kept), F.max("error")).alias("max_error"))


def clip_percent(history: DataFrame, intended: str = "intended", actual: str = "actual") -> DataFrame:
    share = F.when(F.col(intended) > 1e-9, 100.0 * (1.0 - F.col(actual) / F.nullif(F.col(intended), F.lit(0.0)))).otherwise(0.0)
    return history.withColumn("clip_pct", share)


def decay(history: DataFrame, *, run: str = "run_id", step: str = "step", value: str = "value", target: float = 1.0) -> DataFrame:
    """``run, n, rate, steps``: mean decay a step from first to last value, and steps to the target; null outside the valid range."""
    ends = history.groupBy(run).agg(F.count("*").alias("n"), F.min_by(value, step).alias("r0"), F.max_by(value, step).alias("r1"))
    ok = (F.col("n") > 1) & (F.col("r0") > 0) & (F.col("r1") > 0)
    rate = F.when(ok, 1.0 - F.pow(F.col("r1") / F.nullif(F.col("r0"), F.lit(0.0)), 1.0 / F.nullif(F.col("n") - 1, F.lit(0))))
    out = ends.withColumn("rate", rate)
    valid = (F.col("rate") > 0) & (F.col("rate") < 1)
    return out.withColumn("steps", F.when(valid, F.log(F.lit(target) / F.col("r0")) / F.log(1.0 - F.col("rate")) + 1.0)).select(run, "n", "rate", "steps")


def last_steps(history: DataFrame, *, run: str = "run_id", step: str = "step", values: list[str]) -> DataFrame:
    """The last row of each run."""
    return history.groupBy(run).agg(F.max(F.struct(step, *values)).alias("m")).select(run, f"m.{step}", *[f"m.{v}" for v in values])


def best_run(history: DataFrame, *, run: str = "run_id", step: str = "step", values: list[str]) -> DataFrame:
    """The run whose last step has the largest mean of ``values``."""
    mean = sum((F.col(v) for v in values), F.lit(0.0)) / float(len(values))
    return last_steps(history, run=run, step=step, values=values).withColumn("mean", mean).orderBy(F.desc("mean"), run).limit(1)


class SeriesLog:
    """Append-only rows ``run_id, name, step, value`` with a counter for each name."""

    def __init__(self, spark, path: str | None = None, run_id: str = "run", mute: bool = False) -> None:
        self.spark, self.path, self.run_id, self.mute = spark, path, run_id, mute
        self.steps: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.tables: list[DataFrame] = []

    def is_valid(self) -> bool:
        return self.path is not None

    def open(self, path: str) -> None:
        self.path = path

    def reset(self) -> None:
        self.path, self.steps, self.rows, self.tables = None, {}, [], []

    def step(self, name: str) -> int:
        return self.steps.setdefault(name, 0)

    def set_step(self, name: str, step: int) -> None:
        self.steps[name] = step

    def add_step(self, name: str) -> None:
        self.steps[name] = self.step(name) + 1

    def add(self, name: str, value: float, step: int | None = None) -> None:
        if step is None:
            step = self.step(name)
            self.add_step(name)
        if not self.mute:
            self.rows.append((self.run_id, name, int(step), float(value)))

    def extend(self, rows: DataFrame, order: list[str]) -> None:
        """Adds a table of ``name, value``, each name's rows in the given order from its step on. Steps are counted over
        ranges of the order, so that no series is sorted in one task; the driver learns each name's count."""
        from .topology import saved

        ranged = saved(rows.repartitionByRange("name", *order).withColumn("_part", F.spark_partition_id()))
        parts = ranged.groupBy("name", "_part").agg(F.count("*").alias("n"))
        before = parts.select("name", "_part", F.coalesce(F.sum("n").over(Window.partitionBy("name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        counts = {name: n for name, n in parts.groupBy("name").agg(F.sum("n")).collect()}
        first = self.spark.createDataFrame([(name, self.step(name)) for name in counts], "name string, first long")
        for name, n in counts.items():
            self.steps[name] += n
        if not self.mute:
            nth = F.row_number().over(Window.partitionBy("name", "_part").orderBy(*order)) - 1
            out = ranged.withColumn("nth", nth).join(F.broadcast(before), ["name", "_part"]).join(F.broadcast(first), "name")
            self.tables.append(out.select(F.lit(self.run_id).alias("run_id"), "name", (F.col("first") + F.col("before") + F.col("nth")).cast("long").alias("step"), F.col("value").cast("double").alias("value")))

    def table(self) -> DataFrame:
        out = self.spark.createDataFrame(self.rows, "run_id string, name string, step long, value double")
        for more in self.tables:
            out = more.unionByName(out)
        return out

    def flush(self) -> None:
        if self.path and (self.rows or self.tables):
            self.table().write.mode("append").partitionBy("run_id").parquet(self.path)
            self.rows, self.tables = [], []
