"""Clustering metrics from labels and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .spaces import Space


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand_index(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pair counting, adjusted for chance; 1 if there is nothing to adjust."""
    c = contingency(rows, a, b)
    cells = c.agg(F.sum(_pairs(F.col("n"))).alias("ij"), F.sum("n").alias("n"))
    sa = c.groupBy("a").agg(F.sum("n").alias("m")).agg(F.sum(_pairs(F.col("m"))).alias("sa"))
    sb = c.groupBy("b").agg(F.sum("n").alias("m")).agg(F.sum(_pairs(F.col("m"))).alias("sb"))
    x = cells.crossJoin(sa).crossJoin(sb)  # three rows
    chance = F.col("sa") * F.col("sb") / _pairs(F.col("n"))
    top = (F.col("sa") + F.col("sb")) / 2
    return x.select(F.when((F.col("n") < 2) | (top - chance == 0), 1.0).otherwise((F.col("ij") - chance) / (top - chance)).alias("ari"))


def normalized_mutual_info(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information over the mean entropy; 1 if both sides are one cluster, 0 if they share nothing."""
    c = contingency(rows, a, b)
    na, nb = c.groupBy("a").agg(F.sum("n").alias("na")), c.groupBy("b").agg(F.sum("n").alias("nb"))
    n = c.agg(F.sum("n").alias("t"))
    mi = c.join(na, "a").join(nb, "b").crossJoin(F.broadcast(n)).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    entropy = lambda m, x, name: m.crossJoin(F.broadcast(n)).agg((-F.sum(F.col(x) / F.col("t") * F.log(F.col(x) / F.col("t")))).alias(name), F.count("*").alias(f"k{name}"))
    x = mi.crossJoin(entropy(na, "na", "ha")).crossJoin(entropy(nb, "nb", "hb"))
    return x.select(F.when((F.col("kha") <= 1) & (F.col("khb") <= 1), 1.0).when(F.abs("mi") < 1e-15, 0.0).otherwise(F.col("mi") / ((F.col("ha") + F.col("hb")) / 2)).alias("nmi"))


def silhouette(space: Space, labelled: DataFrame, label: str = "label") -> DataFrame:
    """Mean silhouette over exact distances; 0 for the only point of a cluster. labelled: the space's points with a label.

    Distances are summed by (point, other label) as they are made; the pairs themselves are not kept. The number of
    distances is quadratic in the points, by definition.
    """
    sums = space.label_sums(labelled, label)
    own = labelled.select(F.col("point_id").alias("i"), F.col(label).alias("li"))
    per = own.join(sums, "i", "left").groupBy("i").agg(
        F.max(F.when(F.col("lj") == F.col("li"), F.col("s") / F.col("m"))).alias("a"),
        F.min(F.when(F.col("lj") != F.col("li"), F.col("s") / F.col("m"))).alias("b"),
    )
    s = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.agg(F.avg(s).alias("silhouette"))


def checked_silhouette(space: Space, labelled: DataFrame, label: str = "label") -> DataFrame:
    n, k = labelled.agg(F.count("*"), F.countDistinct(label)).first()
    if not 2 <= k <= n - 1:
        raise ValueError(f"silhouette needs between 2 and {n - 1} labels, got {k}")
    return silhouette(space, labelled, label)


def evaluate(space: Space, points: DataFrame, centers: DataFrame, truth: str | None = None) -> DataFrame:
    """One row: silhouette of the nearest-center labels and, with a truth column, ari and nmi."""
    labelled = space.assign(points, centers)
    out = silhouette(space, labelled)
    if truth:
        out = out.crossJoin(adjusted_rand_index(labelled, "label", truth)).crossJoin(normalized_mutual_info(labelled, "label", truth))
    return out
