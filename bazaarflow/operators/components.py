"""Connected components of rows that share keys.

Links run from every row to the first row of each of its keys, so a key held by many rows gives a star and no pairs. Then stars are
alternated: every row links its later neighbours to its first one, then itself and its earlier neighbours to the first. The number of
rounds is the logarithm of the longest path; each is written to the shared folder, and one row of totals tells when nothing moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarflow.session import materialise


def key_links(rows: DataFrame, node: str, keys: Sequence[str]) -> DataFrame:
    """Rows (u, v), v < u: each row and the first row with the same value of a key; a null key links nothing."""
    out = None
    for key in keys:
        held = rows.where(F.col(key).isNotNull()).select(key, F.col(node).alias("u"))
        first = held.groupBy(key).agg(F.min("u").alias("v"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        links = held.join(first, key).where("u <> v").select("u", "v")
        out = links if out is None else out.unionByName(links)
    return out.distinct()


def _totals(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) of all nodes of links (u, v); a component is named by its least node. Nodes without links have no row."""
    links, before = materialise(links, "links"), None
    while (now := _totals(links)) != before:
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        links = materialise(small, "stars")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
