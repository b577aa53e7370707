"""Sharding by vector bin packing: bytes, tokens and rows are balanced together, bytes first.

The unit is a group of rows with an equal key, so copies share a shard. A group larger than an eighth of a shard is split by
a hash of the row id into pieces of about that size. Units are dealt into cells by hash; each cell packs its units, largest
first, into small bins, each into the bin where the dot product of its vector with the bin's residual capacity is highest.
The bins of many cells are then the units of the next level, until one cell is left; large units wait for that last level.
Every task sees a bounded number of units, and the number of levels is the logarithm of the number of cells.

Defined results: a null key is a group of its own, as is an empty one; null sizes count as nothing; rows with equal
ids and keys are placed row by row; an empty table gives no row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarflow.llm.common import materialise

SIZES = ("bytes", "tokens", "rows")
#: Bins of a cell for each shard: they let the last level even out what cells leave uneven.
FINER = 32
#: Units of each cell, spread over its sizes, that are not packed there but wait for the last level, for the same reason.
APART = 512


def spread(vectors: np.ndarray, bins: int, weights: tuple[float, ...]) -> np.ndarray:
    """The bin of each vector. Capacities are equal shares of the total; ties go to the lowest bin."""
    total = vectors.sum(0)
    share = vectors / np.where(total > 0, total / bins, 1)
    weigh = np.array(weights)
    out = np.empty(len(share), np.int64)
    residual = np.ones((bins, len(weights)))
    for i in np.argsort(-(share @ weigh), kind="stable"):
        out[i] = best = int((residual @ (share[i] * weigh)).argmax())
        residual[best] -= share[i]
    return out


def _packed(units: DataFrame, cell: Column, bins: int, weights: tuple[float, ...], apart: int = 0,
            level: int = 0) -> DataFrame:
    """Adds ``bin`` to units (unit, bytes, tokens, rows), cell by cell; ``next`` is the unit of the next level."""
    def one(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by("unit")
        vectors = np.column_stack([group.column(c).to_numpy().astype(float) for c in SIZES])
        waits = np.zeros(len(vectors), bool)
        if apart:
            waits[np.argsort(vectors[:, 0], kind="stable")[:: max(1, -(-len(vectors) // apart))]] = True
        found = np.full(len(vectors), -1)
        found[~waits] = spread(vectors[~waits], bins, weights)
        return group.select(["unit", "cell", *SIZES]).append_column("bin", pa.array(found))

    placed = units.select("unit", cell.cast("long").alias("cell"), *SIZES).groupBy("cell").applyInArrow(
        one, "unit string, cell long, bytes long, tokens long, rows long, bin long")
    return placed.withColumn("next", F.when(F.col("bin") < 0, F.col("unit")).otherwise(F.concat_ws("/", F.lit(f"bin{level}"), "cell", "bin")))


def assign(rows: DataFrame, shards: int, weights: tuple[float, float, float] = (1.0, 0.03, 0.03),
           cell_units: int = 16384, fan: int = 64) -> DataFrame:
    """Adds ``shard`` to rows (id, key, bytes, tokens, rows)."""
    rows = materialise(rows, "shard-rows")
    totals = rows.agg(*[F.sum(c).alias(c) for c in SIZES]).first()
    if totals["rows"] is None:
        return rows.withColumn("shard", F.lit(0))
    whole = {c: float(totals[c] or 0) or 1.0 for c in SIZES}

    def part(of: float) -> Column:
        """How many parts of 1/of of the total the largest size makes."""
        return F.greatest(*[F.col(c) * (of / whole[c]) for c in SIZES])

    sums = [F.sum(c).alias(c) for c in SIZES]
    # at most 3 * 8 * shards groups are that large
    hot = (rows.groupBy("key").agg(*sums).withColumn("_pieces", F.ceil(part(8.0 * shards)).cast("int"))
           .where("_pieces > 1").select("key", "_pieces"))
    rows = rows.join(F.broadcast(hot), "key", "left").withColumn("unit", F.concat_ws(
        "/", "key", F.pmod(F.xxhash64("id"), F.coalesce("_pieces", F.lit(1))))).drop("_pieces")
    units = materialise(rows.groupBy("unit").agg(*sums), "units")
    n = units.count()
    cells = max(1, -(-n // cell_units))
    if cells == 1:
        placed = _packed(units, F.lit(0), shards, weights).select("unit", F.col("bin").alias("shard"))
    else:
        # at most 3 * 64 * shards units are that large
        large = part(64.0 * shards) > 1
        def packed(df: DataFrame, cell: Column, number: int) -> DataFrame:
            return materialise(_packed(df, cell, FINER * shards, weights, APART, number), "cells")

        def bins(df: DataFrame) -> DataFrame:
            return df.groupBy(F.col("next").alias("unit"), "cell").agg(*sums)

        level = packed(units.where(~large), F.pmod(F.xxhash64("unit"), F.lit(cells)), 0)
        links = level.select("unit", "next")
        for number in range(1, math.ceil(math.log(cells, fan))):
            level = packed(bins(level), F.floor(F.col("cell") / fan), number)
            links = links.join(level.select(F.col("unit").alias("next"), F.col("next").alias("_up")), "next") \
                .select("unit", F.col("_up").alias("next"))
        last = _packed(bins(level).drop("cell").unionByName(units.where(large)), F.lit(0), shards, weights)
        last = materialise(last.select(F.col("unit").alias("next"), F.col("bin").alias("shard")), "shards")
        placed = links.join(last, "next").select("unit", "shard").unionByName(
            units.where(large).select(F.col("unit").alias("next")).join(last, "next").select(F.col("next").alias("unit"), "shard"))
    # no unit holds more than about an eighth of a shard's rows
    return rows.join(placed, "unit").select(*[c for c in rows.columns if c != "unit"], F.col("shard").cast("int").alias("shard"))


def slots(rows: DataFrame, order: list[str], n: int, shards: int, rows_each: int = 2000) -> DataFrame:
    """Adds ``slot``: a number from 0, without gaps, inside each shard. Runs of about ``rows_each`` rows, chosen by hash, are
    numbered apart and set one after another, so no task sorts a whole shard."""
    runs = max(1, n // (shards * rows_each))
    rows = materialise(rows.withColumn("_run", F.pmod(F.xxhash64(*order), F.lit(runs))), "sharded")
    counts = rows.groupBy("shard", "_run").agg(F.count("*").alias("_n"))
    before = counts.select("shard", "_run", F.coalesce(F.sum("_n").over(
        Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("shard", "_run").orderBy(*order)) - 1
    return rows.withColumn("_place", place).join(before, ["shard", "_run"]) \
        .withColumn("slot", (F.col("_before") + F.col("_place")).cast("long")).drop("_run", "_before", "_place")
