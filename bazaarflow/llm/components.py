"""Connected components of a table of links, by alternating stars.

In a round every node first links its larger neighbours to its smallest one, then itself and its smaller neighbours to the
smallest. A few rounds, their number the logarithm of the longest path, leave each component as a star around its
smallest node. Rounds are written to the shared folder; nothing is collected but one row of totals. A node with very many
neighbours is aggregated before the shuffle, and its join is one that Spark splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarflow.llm.common import materialise

#: Rows of two numbers that may be broadcast.
BROADCAST_ROWS = 1_000_000


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) of all nodes of ``links`` (u, v); the component is its smallest node. Loops and repeated
    links are allowed, null ends are left out; no links give no rows."""
    links = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while (now := _state(links)) != before:
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        links = materialise(small, "small-star")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def linked(entries: DataFrame, verified: Callable[[DataFrame], DataFrame],
           across: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (node, component) of the nodes that have a link, from candidates (bucket, node), each once.

    ``verified`` keeps the pairs (u, v), u < v, that are links. In a bucket every node is compared with the one whose buckets
    hold most nodes, not with all. Where a bucket then still holds several components, the nodes outside its largest one
    (``odd``) are compared with all those of other components. So no link between components is missed, and a group of
    copies does not become all its pairs. ``across`` finds the links of such buckets from rows (bucket, node, part, odd).
    """
    sizes = materialise(entries.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1"), "sizes")
    # mostly few buckets are shared; their number is checked before they are broadcast
    few = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    shared = materialise(entries.join(few, "bucket"), "buckets")
    degree = shared.groupBy("node").agg(F.sum("_n").alias("_degree"))
    pivots = shared.join(degree, "node").groupBy("bucket").agg(F.max_by("node", F.struct("_degree", "node")).alias("_pivot"))
    first = shared.join(pivots, "bucket").where("node <> _pivot") \
        .select(F.least("node", "_pivot").alias("u"), F.greatest("node", "_pivot").alias("v")).distinct()
    first = materialise(first, "pairs")
    links = materialise(verified(first).select("u", "v"), "verified")
    parts = components(links).withColumnRenamed("node", "_member")
    placed = materialise(shared.join(parts, F.col("node") == F.col("_member"), "left")
                         .select("bucket", "node", F.coalesce("component", "node").alias("part")), "placed")
    counts = placed.groupBy("bucket", "part").agg(F.count("*").alias("_n"))
    main = counts.groupBy("bucket").agg(F.max_by("part", F.struct("_n", "part")).alias("_main"), F.count("*").alias("_parts"))
    mixed = placed.join(main.where("_parts > 1"), "bucket").select("bucket", "node", "part", (F.col("part") != F.col("_main")).alias("odd"))
    mixed = materialise(mixed, "mixed")
    return components(links.unionByName(across(mixed).select("u", "v")))
