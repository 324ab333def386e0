"""Queries over annealing trajectories: clocks, windows, selection and resampling.

trajectory(run_slot, i, t, energy, state): i from -1 (the start) to n - 1; state is any value, or one row for each center.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.random import exponential


def clock(rows: DataFrame, seed: int, lambda0: float = 1.0, by: str = "run_slot", i: str = "i") -> DataFrame:
    """rows with t, the time after observation i: arrivals of a Poisson process of intensity lambda0 (1 + t)."""
    w = Window.partitionBy(by).orderBy(i).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("t", F.sqrt(2 * F.sum(exponential(seed, by, i) / lambda0).over(w) + 1) - 1)


def window_start(n: Column, share: float) -> Column:
    """First observation of the collection window: floor((n - 1) (1 - share))."""
    if not 0 <= share <= 1:
        raise ValueError("the share must be in [0, 1]")
    return F.floor((n - 1) * (1 - F.lit(share)) + 1e-9)


def collected(trajectory: DataFrame, share: float) -> DataFrame:
    """The rows of the collection window of each run."""
    n = trajectory.where("i >= 0").groupBy("run_slot").agg((F.max("i") + 1).alias("_n"))
    return trajectory.join(F.broadcast(n), "run_slot").where(F.col("i") >= window_start(F.col("_n"), share)).drop("_n")


def best_of_window(trajectory: DataFrame, share: float) -> DataFrame:
    """(run_slot, i, t, energy, state) of least energy in the window, where the start competes too; the earliest of equal ones."""
    rows = collected(trajectory, share).unionByName(trajectory.where("i < 0")).distinct()
    best = rows.groupBy("run_slot").agg(F.min(F.struct("energy", "i", "t", "state")).alias("b"))
    return best.select("run_slot", "b.i", "b.t", "b.energy", "b.state")


def final_state(trajectory: DataFrame) -> DataFrame:
    """(run_slot, n, state): observations seen and where the run ended, which need not be its best state; a run of no observation ends at its start."""
    last = trajectory.groupBy("run_slot").agg((F.max("i") + 1).alias("n"), F.max_by("state", "i").alias("state"))
    return last.select("run_slot", F.col("n").cast("long").alias("n"), "state")


def most_frequent_state(trajectory: DataFrame, share: float, by: tuple[str, ...] = ("run_slot",)) -> DataFrame:
    """The most frequent state of the window (per center slot, if by has it); the first collected of equal ones."""
    n = collected(trajectory, share).groupBy(*by, "state").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    best = n.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "state")).alias("b"))
    return best.select(*by, F.col("b.state").alias("state"), (-F.col("b.m")).alias("n"))


def with_memory(trajectory: DataFrame, width: int | None = None) -> DataFrame:
    """trajectory with least: the smallest energy so far, or of the last width rows."""
    w = Window.partitionBy("run_slot").orderBy("i").rowsBetween(Window.unboundedPreceding if width is None else 1 - width, 0)
    return trajectory.withColumn("least", F.min("energy").over(w))


def resampled(trajectory: DataFrame, grid: DataFrame) -> DataFrame:
    """(run_slot, t, energy) at the grid's times, piecewise linear; the end values beyond the ends.

    Two ordered passes over samples and grid together, up and down, carry the last sample to each grid time and the next
    one back; both frames only grow, so that a run costs its rows and no more.
    """
    samples = trajectory.select("run_slot", "t", "energy", F.lit(0).alias("is_grid"))
    runs = trajectory.select("run_slot").distinct()
    asked = runs.crossJoin(F.broadcast(grid.select("t"))).select("run_slot", "t", F.lit(None).cast("double").alias("energy"), F.lit(1).alias("is_grid"))
    ahead = Window.partitionBy("run_slot").orderBy("t", "is_grid").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("run_slot").orderBy(F.desc("t"), F.desc("is_grid")).rowsBetween(Window.unboundedPreceding, 0)
    point = F.when(F.col("is_grid") == 0, F.struct("t", "energy"))
    x = samples.unionAll(asked).withColumns({"a": F.last(point, True).over(ahead), "b": F.last(point, True).over(behind)}).where("is_grid = 1")
    a, b = F.coalesce("a", "b"), F.coalesce("b", "a")
    value = F.when(b["t"] == a["t"], a["energy"]).otherwise(a["energy"] + (b["energy"] - a["energy"]) * (F.col("t") - a["t"]) / (b["t"] - a["t"]))
    return x.select("run_slot", "t", value.alias("energy"))


def quantile_bands(rows: DataFrame, by: str = "t", value: str = "energy", shares=(0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Exact percentiles, linear between ranks."""
    p = F.percentile(value, F.array(*map(F.lit, shares)))
    return rows.groupBy(by).agg(p.alias("p")).select(by, *(F.get("p", F.lit(i)).alias(f"p{round(100 * s):02d}") for i, s in enumerate(shares)))


def exceedance(rows: DataFrame, eta: float, by: str = "t", value: str = "energy") -> DataFrame:
    """(by, p): the share of values above eta."""
    return rows.groupBy(by).agg(F.avg((F.col(value) > eta).cast("double")).alias("p"))


def tail_slope(shares: DataFrame, t: str = "t", decade: float = 10.0, least: int = 6) -> DataFrame:
    """Slope of ln p against ln t over the last decade of t, null with fewer than least positive points."""
    top = shares.agg(F.max(t).alias("top"))
    last = shares.crossJoin(F.broadcast(top)).where((F.col(t) >= F.col("top") / decade) & (F.col(t) > 0) & (F.col("p") > 0))
    return last.agg(F.when(F.count("*") >= least, F.regr_slope(F.log("p"), F.log(t))).alias("slope"))
