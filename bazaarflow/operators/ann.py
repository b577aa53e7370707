"""Approximate vector top-k: rows go to the nearest of a number of centroids, queries probe a few.

``approximate_topk`` does this in one job. The other functions keep an index on disk: centroids, vectors in one folder a list,
and the recall measured for each number of probes, from which a search takes the number it needs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarflow.functions.rules import once
from bazaarflow.operators.topk import rows_of_tile, tiled_topk
from bazaarflow.session import materialise

# Centroids are held by every task: 4,096 of 1,024 components are 32 MB.
MAX_LISTS = 4096
# Rows a list is trained on, queries by which recall is measured; neither changes which rows are indexed.
TRAIN_ROWS = 256
RECALL_QUERIES = 512


def unit_vector(vec):
    """The vector scaled to length one (zero vectors stay)."""
    length = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # the length once a vector, not once a component
    return once(length, lambda size: F.transform(vec, lambda x: F.when(size > 0, x / size).otherwise(F.lit(0.0))))


def train_centroids(df: DataFrame, vec: str, lists: int, *, fraction: float = 1.0, seed: int = 7,
                    iterations: int = 10) -> np.ndarray:
    """Centroids for the lists. Training may look at a sample; all rows are indexed afterwards.

    The result has ``lists`` rows, whatever the table size.
    """
    rows = df.where(F.col(vec).isNotNull()).select(array_to_vector(unit_vector(F.col(vec))).alias("features"))
    if fraction < 1.0:
        rows = rows.sample(fraction=fraction, seed=seed)
    model = KMeans(k=lists, seed=seed, maxIter=iterations).fit(rows)
    return np.asarray(model.clusterCenters())


def probed_lists(vec, centroids: np.ndarray, probes: int):
    """The numbers of the ``probes`` nearest centroids by cosine, as an array."""
    def unit(m):
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(size > 0, size, 1)

    centers = unit(centroids)

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        sims = unit(np.asarray(np.stack(v.to_numpy()), dtype="float64")) @ centers.T
        return pd.Series(list(np.argsort(-sims, axis=1, kind="stable")[:, :probes].astype("int32")))

    return nearest(vec)


def assign_lists(df: DataFrame, vec: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """One row per (row, probed list): the ``probes`` nearest centroids by cosine, numbered in ``probe`` from 0."""
    rows = df.where(F.col(vec).isNotNull())
    return rows.select("*", F.posexplode(probed_lists(F.col(vec), centroids, probes)).alias("probe", "list_id"))


def approximate_topk(left: DataFrame, right: DataFrame, k: int, *, lists: int = 100, probes: int = 8,
                     fraction: float = 1.0, left_vec: str = "left_vec", right_vec: str = "right_vec",
                     tile_rows: int | None = None) -> DataFrame:
    """Top-k by cosine among the probed lists, re-ranked exactly. ``probes=lists`` makes it exact."""
    centroids = train_centroids(right, right_vec, lists, fraction=fraction)
    lhs = left.withColumnRenamed(left_vec, "left_vec").where("left_vec is not null").withColumn(
        "list_ids", probed_lists(F.col("left_vec"), centroids, min(probes, len(centroids))))
    rhs = materialise(assign_lists(right, right_vec, centroids, 1).drop("probe").withColumnRenamed(right_vec, "right_vec"), "listed")
    return listed_topk(lhs, rhs, k, tile_rows=tile_rows)


def listed_topk(left: DataFrame, right: DataFrame, k: int, *, tile_rows: int | None = None, **how) -> DataFrame:
    """Top-k among the rows of the same list. ``left``: left_id, left_vec, list_ids (the probed lists); ``right``: right_id, right_vec, list_id.

    Short lists share a block, to which a left row goes once, with the lists it asks for there.
    """
    rows, width = right.agg(F.count("*"), F.max(F.size("right_vec"))).first()
    blocks = max(1, math.ceil(rows / (tile_rows or rows_of_tile(rows, width or 1))))
    dealt = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.struct(
        b.alias("_block"), F.filter("list_ids", lambda x: x % blocks == b).alias("_lists")))
    lhs = left.select("left_id", "left_vec", F.inline(F.filter(dealt, lambda x: F.size(x["_lists"]) > 0)))
    return tiled_topk(lhs, right.withColumn("_block", F.col("list_id") % blocks), ["_block"], k, tile_rows=tile_rows,
                      left_extra=("_lists",), right_extra=("list_id",), lists=("_lists", "list_id"), **how)


def lists_for(rows: int) -> int:
    """A list for every thousand rows up to a million, then the square root of the rows; at least 16, at most MAX_LISTS.

    Beyond that lists grow instead; a long list is split into tiles like any block.
    """
    return min(MAX_LISTS, max(16, rows // 1000 if rows <= 1_000_000 else math.isqrt(rows)), max(rows, 1))


def _write_lists(df: DataFrame, path: str) -> None:
    df.repartition("list_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list_id").parquet(f"{path}/rows")


def read_centroids(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.schema("list_id int, center array<double>").parquet(f"{path}/centroids").orderBy("list_id").collect()  # at most MAX_LISTS
    return np.asarray([r["center"] for r in rows])


def read_rows(spark: SparkSession, path: str, lists: Sequence[int] | None = None) -> DataFrame:
    """The indexed rows: right_id, right_vec, list_id; only the folders of ``lists`` if these are given."""
    rows = spark.read.schema("right_id long, right_vec array<float>, list_id int").parquet(f"{path}/rows").where(F.col("right_vec").isNotNull())
    return rows if lists is None else rows.where(F.col("list_id").isin(list(lists)))


def build_index(right: DataFrame, path: str, *, lists: int | None = None, centroids: np.ndarray | None = None) -> None:
    """Writes the index of all rows of ``right`` (right_id, unique, and right_vec; rows without a vector are left out).

    The centroids are trained on a sample of about TRAIN_ROWS rows a list, unless they are given. Without a row there is no index.
    """
    spark = right.sparkSession
    right = right.select(F.col("right_id").cast("long"), F.col("right_vec").cast("array<float>")).where("right_vec is not null")
    if centroids is None:
        n = right.count()
        if n == 0:
            raise ValueError("an index needs a row with a vector, or centroids")
        lists = lists or lists_for(n)
        centroids = train_centroids(right, "right_vec", min(lists, n), fraction=min(1.0, 1.1 * TRAIN_ROWS * lists / n))
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "list_id int, center array<double>") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    _write_lists(assign_lists(right, "right_vec", centroids, 1).drop("probe"), path)


def add_to_index(path: str, delta: DataFrame) -> list[int]:
    """Adds rows, or gives known ids their new vectors (null: takes them out); only lists that change are rewritten.

    ``delta``: right_id (unique), right_vec. An id that leaves a list stays there without a vector until the index is built anew, so
    that no list that loses all its rows keeps its old file. Running the same delta again changes nothing. Returns the lists.
    """
    spark = delta.sparkSession
    delta = delta.select(F.col("right_id").cast("long"), F.col("right_vec").cast("array<float>"))
    placed = materialise(assign_lists(delta, "right_vec", read_centroids(spark, path), 1).drop("probe"), "placed")
    ids = materialise(delta.select("right_id"), "ids")
    stored = read_rows(spark, path)
    left = stored.join(ids, "right_id", "left_semi").join(placed.select("right_id", "list_id"), ["right_id", "list_id"], "left_anti").select(
        "right_id", F.lit(None).cast("array<float>").alias("right_vec"), "list_id")
    changed = materialise(placed.select("right_id", "right_vec", "list_id").unionByName(left), "changed")
    touched = sorted(r["list_id"] for r in changed.select("list_id").distinct().collect())  # at most MAX_LISTS
    if touched:
        kept = read_rows(spark, path, touched).join(ids, "right_id", "left_anti")
        _write_lists(materialise(kept.unionByName(changed), "lists"), path)
    return touched


def measure_recall(path: str, left: DataFrame, k: int, *, queries: int = RECALL_QUERIES) -> DataFrame:
    """Recall@k of every number of probes, kept with the index: probes, recall.

    Measured on ``queries`` rows of ``left`` (left_id, left_vec), by the hash of their id, against all indexed rows.
    """
    spark = left.sparkSession
    centroids = read_centroids(spark, path)
    some = materialise(left.select("left_id", "left_vec").where("left_vec is not null").orderBy(F.xxhash64("left_id")).limit(queries), "queries")
    rows = read_rows(spark, path)
    true = tiled_topk(some.withColumn("_all", F.lit(1)), rows.withColumn("_all", F.lit(1)), ["_all"], k).select("left_id", "right_id")
    probes = assign_lists(some, "left_vec", centroids, len(centroids)).select("left_id", "list_id", "probe")
    found = true.join(rows.select("right_id", "list_id"), "right_id").join(probes, ["left_id", "list_id"])
    hits = {r["probe"]: r["count"] for r in found.groupBy("probe").count().collect()}  # at most MAX_LISTS
    total, seen, table = sum(hits.values()), 0, []
    for p in range(len(centroids)):
        seen += hits.get(p, 0)
        table.append((p + 1, seen / total if total else 1.0))
    spark.createDataFrame(table, "probes int, recall double").coalesce(1).write.mode("overwrite").parquet(f"{path}/recall")
    return spark.read.schema("probes int, recall double").parquet(f"{path}/recall")


def probes_for(spark: SparkSession, path: str, recall: float) -> int:
    """The least number of probes that reached ``recall`` when it was measured."""
    table = spark.read.schema("probes int, recall double").parquet(f"{path}/recall")
    return table.where(F.col("recall") >= recall).agg(F.min("probes")).first()[0]


def search_index(path: str, left: DataFrame, k: int, *, probes: int | None = None, recall: float = 0.95, tile_rows: int | None = None,
                 digits: int | None = None) -> DataFrame:
    """Top-k of ``left`` (left_id, left_vec) by cosine among the probed lists, re-ranked exactly; only those lists are read.

    Without ``probes``, as many lists as gave ``recall`` by ``measure_recall``. With ``digits`` scores are rounded before they are
    ranked, so that rows alike to that many digits are ranked by id.
    """
    spark = left.sparkSession
    centroids = read_centroids(spark, path)
    probes = min(probes or probes_for(spark, path, recall), len(centroids))
    lhs = materialise(left.select("left_id", "left_vec").where("left_vec is not null").withColumn(
        "list_ids", probed_lists(F.col("left_vec"), centroids, probes)), "probed")
    wanted = [r["list_id"] for r in lhs.select(F.explode("list_ids").alias("list_id")).distinct().collect()]  # at most MAX_LISTS
    rounded = {} if digits is None else {"score": lambda cosine, *_: np.round(cosine, digits)}
    return listed_topk(lhs, read_rows(spark, path, wanted), k, tile_rows=tile_rows, **rounded)
