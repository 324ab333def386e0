"""Readers and writers: graph artefacts, CSV, LaTeX values, resumable campaigns."""

from __future__ import annotations

import hashlib
import json
import subprocess
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import __version__
from ..operators.graph import MetricGraph


def save_graph(graph: MetricGraph, path: str) -> None:
    """Nodes, edges and distances as Parquet, so that a reload finds no paths again."""
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    graph.node_dist.write.mode("overwrite").parquet(f"{path}/node_dist")


def load_graph(spark: SparkSession, path: str) -> MetricGraph:
    graph = MetricGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))
    graph._cache["dist"] = spark.read.parquet(f"{path}/node_dist")
    return graph


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header (for reports: small tables)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def latex_values(df: DataFrame, name: str, value: str, digits: int = 3) -> DataFrame:
    """A \\newcommand line for each row; names keep their letters only."""
    safe = F.regexp_replace(name, "[^A-Za-z]", "")
    return df.select(F.concat(F.lit("\\newcommand{\\"), safe, F.lit("}{"), F.format_string(f"%.{digits}f", F.col(value).cast("double")), F.lit("}")).alias("value"))


def write_latex(df: DataFrame, path: str, name: str, value: str, digits: int = 3) -> None:
    latex_values(df, name, value, digits).coalesce(1).write.mode("overwrite").text(path)


def drawing(graph: MetricGraph, labels: DataFrame | None = None) -> DataFrame:
    """Nodes with what a plot needs: size 100 + 50 obs_weight, and a color column from labels (node_id, color) or block."""
    nodes = graph.nodes
    size = F.lit(100.0) + 50 * (F.col("obs_weight") if "obs_weight" in nodes.columns else F.lit(0.0))
    out = nodes.withColumn("size", size)
    if labels is not None:
        return out.join(labels.select("node_id", "color"), "node_id", "left")
    return out.withColumn("color", F.col("block").cast("string") if "block" in nodes.columns else F.lit("0"))


def code_stamp() -> str:
    """Version and, in a checkout, the commit."""
    root = Path(__file__).resolve().parents[2]
    try:
        head = subprocess.run(["git", "-C", str(root), "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip()
    except (OSError, subprocess.TimeoutExpired):
        head = ""
    return f"{__version__}+{head or 'none'}"


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def missing_seeds(requested: DataFrame, completed: DataFrame, config: str, code: str) -> DataFrame:
    """Requested seeds without a result of this configuration and code."""
    done = completed.where((F.col("config_hash") == config) & (F.col("code_hash") == code)).select("seed")
    return requested.join(done, "seed", "left_anti")


def run_seeds(spark: SparkSession, seeds: list[int], run: Callable[[DataFrame], DataFrame], path: str, config: dict) -> DataFrame:
    """Results of all seeds: stored ones of the same configuration and code, and new ones, which are stored too.

    run takes a DataFrame of seeds and gives rows with a seed column.
    """
    from pyspark.errors import AnalysisException

    want = spark.createDataFrame([(int(s),) for s in dict.fromkeys(seeds)], "seed long")
    own, code = config_hash(config), code_stamp()
    try:
        rest = missing_seeds(want, spark.read.parquet(path), own, code)
    except AnalysisException:  # nothing stored yet
        rest = want
    if not rest.isEmpty():
        run(rest).withColumns({"config_hash": F.lit(own), "code_hash": F.lit(code)}).write.mode("append").parquet(path)
    return spark.read.parquet(path).where((F.col("config_hash") == own) & (F.col("code_hash") == code)).join(want, "seed", "left_semi")


def same_campaign(stores: DataFrame) -> DataFrame:
    """stores(experiment, seed, code): one row that tells whether all have the same seeds and one code stamp."""
    per = stores.groupBy("experiment").agg(F.array_sort(F.collect_set("seed")).alias("seeds"))
    return per.agg((F.countDistinct("seeds") == 1).alias("same_seeds")).crossJoin(stores.agg((F.countDistinct("code") == 1).alias("same_code")))
