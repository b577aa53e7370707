"""Near duplicates by order MinHash over shingles of five words.

The k-mers of a text are its word shingles, each labelled with how often it has occurred before. A sketch takes the
``PICKED`` k-mers whose hashes are smallest and keeps them in the order of the text; texts that share one of the ``SKETCHES``
sketches are candidates. Texts of fewer than five words have one shingle, of all their words.

Verification aligns the k-mers of two texts: the similarity is the length of their longest common subsequence over the
k-mers of both together, as in a Jaccard index that respects order. For it to reach the threshold, partners cannot
be further apart in place than the k-mers that may go without one, so only that band is looked at.

Texts with equal words are one class from the start. In a bucket of candidates each class is compared with the one that
shares most sketches with others, not with all. When links have made components, the classes of a bucket that are not in
its largest one are compared with those of other components, tile by tile: a task multiplies two tiles' k-mer matrices
and returns only links that join components. So no link between components is missed, and pairs are never rows.

Defined results: null texts and texts without words are alone; letters A-Z are compared without case; the id of a
class is the smallest doc_id in it, null where all are null, and its document with the smallest id (null last) is the
one kept, the first in the table among equal ids; columns that begin with an underscore go.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarflow.llm import wordhash
from bazaarflow.llm.common import materialise, numbered
from bazaarflow.llm.components import linked

SHINGLE = 5
PICKED, SKETCHES = 3, 16
THRESHOLD = 0.8
_PLACE_BITS = 24
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def labelled(words: wordhash.Words) -> tuple[np.ndarray, np.ndarray]:
    """The occurrence-labelled shingles of all texts, and how many each text has."""
    short = (words.counts > 0) & (words.counts < SHINGLE)
    sizes = np.where(short, SHINGLE, words.counts)
    padded = np.zeros(sizes.sum(), np.uint64)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(words.hashes)) + np.repeat(begin - (np.cumsum(words.counts) - words.counts), words.counts)
    padded[place] = words.hashes
    count = np.where(sizes > 0, sizes - SHINGLE + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    start = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
    shingle = wordhash.chain(*[padded[start + j] for j in range(SHINGLE)])
    # the occurrence of a shingle is its rank among equal ones of its text
    own = shingle + text.astype(np.uint64) * _GOLD
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.empty(0, bool)
    if new.all():
        return shingle, count
    run = np.flatnonzero(new)
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = (np.arange(len(order)) - np.repeat(run, np.diff(np.concatenate([run, [len(order)]])))).astype(np.uint64)
    return np.where(occurrence > 0, wordhash.mix(shingle + occurrence * _GOLD), shingle), count


def sketches(kmers: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One row of SKETCHES hashes for each text that has k-mers."""
    count = count[count > 0]
    begin = np.cumsum(count) - count
    if not len(count):
        return np.empty((0, SKETCHES), np.uint64)
    bits = max(_PLACE_BITS, int(count.max()).bit_length())
    mask = np.uint64((1 << bits) - 1)
    inside = (np.arange(len(kmers)) - np.repeat(begin, count)).astype(np.uint64)
    out = np.empty((len(count), SKETCHES), np.uint64)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    for s in range(SKETCHES):
        factor = wordhash.mix(np.array([2 * s + 1], np.uint64))[0] | np.uint64(1)
        value = (kmers * factor & ~mask) | inside
        places = np.empty((len(count), PICKED), np.int64)
        for j in range(PICKED):
            least = np.minimum.reduceat(value, begin)
            place = np.where(least == most, -1, (least & mask).astype(np.int64))
            places[:, j] = place
            taken = place >= 0
            value[begin[taken] + place[taken]] = most
        places.sort(1)
        picked = np.where(places >= 0, kmers[begin[:, None] + np.maximum(places, 0)], np.uint64(0))
        out[:, s] = wordhash.chain(np.full(len(count), s + 1, np.uint64), *picked.T)
    return out


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Of two sequences of distinct k-mers; 0 where it is below the threshold."""
    together = len(a) + len(b)
    common, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(common) < threshold * (together - len(common)):
        return 0.0
    band = int((1 - threshold) / (1 + threshold) * together) + 1
    near = np.abs(at_a - at_b) <= band
    order = np.argsort(at_a[near])
    ahead = at_b[near][order]
    if (np.diff(ahead) > 0).all():
        length = len(ahead)
    else:
        # longest increasing run of partners: the longest common subsequence of sequences without repeats
        ends: list[int] = []
        for x in ahead.tolist():
            i = bisect_left(ends, x)
            ends[i : i + 1] = [x]
        length = len(ends)
    found = length / (together - length)
    return found if found >= threshold else 0.0


def signatures(rows: DataFrame) -> DataFrame:
    """Rows (_rid, digest, sketches) of the texts that have words, from rows (_rid, text)."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in wordhash.words(batch.column(1)):
                kmers, count = labelled(words)
                found = sketches(kmers, count)
                some = words.counts > 0
                if not some.any():
                    continue
                begin = (np.cumsum(words.counts) - words.counts)[some]
                place = (np.arange(len(words.hashes)) - np.repeat(begin, words.counts[some])).astype(np.uint64)
                # two sums over words and their places tell sequences apart
                digest = [np.add.reduceat(wordhash.mix(words.hashes + place * f), begin) + words.counts[some].astype(np.uint64)
                          for f in (_GOLD, np.uint64(0xC2B2AE3D27D4EB4F))]
                ids = batch.column(0).slice(words.first, len(some)).filter(pa.array(some))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel().view(np.int64)), SKETCHES)
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array(d.view(np.int64)) for d in digest], lists.cast(pa.list_(pa.int64()))],
                    names=["_rid", "_d1", "_d2", "_sketches"])

    return rows.select("_rid", "text").mapInArrow(sign, "_rid long, _d1 long, _d2 long, _sketches array<long>")


def verified(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (u, v): those whose texts reach the threshold."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("_rid")).distinct()
    texts = materialise(rows.select("_rid", "text").join(wanted, "_rid", "left_semi"), "texts")
    joined = pairs.join(texts.select(F.col("_rid").alias("u"), F.col("text").alias("_a")), "u") \
        .join(texts.select(F.col("_rid").alias("v"), F.col("text").alias("_b")), "v").select("u", "v", "_a", "_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                sides = []
                for c in (2, 3):
                    found = []
                    for words in wordhash.words(some.column(c)):
                        kmers, count = labelled(words)
                        found += np.split(kmers, np.cumsum(count)[:-1])
                    sides.append(found)
                near = np.array([similarity(a, b, threshold) for a, b in zip(*sides, strict=True)])
                keep = pa.array(near > 0)
                yield pa.RecordBatch.from_arrays([some.column(0).filter(keep), some.column(1).filter(keep), pa.array(near[near > 0])],
                                                 names=["u", "v", "similarity"])

    return joined.mapInArrow(compare, "u long, v long, similarity double")


def joining(kmers: list[np.ndarray], parts: list[int], left: list[int], right: list[int], threshold: float) -> list[tuple[int, int]]:
    """Pairs (i of left, j of right) that are links and join parts that no pair before them has joined."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    # k-mers that only one text has are left out of the matrices
    every = np.concatenate(kmers)
    of_text = np.repeat(np.arange(len(kmers)), [len(k) for k in kmers])
    distinct, column, times = np.unique(every, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    keep = times[column] > 1
    of_text, column = of_text[keep], number[column[keep]]
    sizes = np.array([len(k) for k in kmers])
    common = np.zeros((len(left), len(right)), np.float32)
    row_of = {"l": np.full(len(kmers), -1), "r": np.full(len(kmers), -1)}
    row_of["l"][left], row_of["r"][right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(column, kind="stable")
    of_text, column = of_text[order], column[order]
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        some = slice(*np.searchsorted(column, [at, at + width]))
        sides = []
        for key, n in (("l", len(left)), ("r", len(right))):
            m = np.zeros((n, width), np.float32)
            row = row_of[key][of_text[some]]
            m[row[row >= 0], column[some][row >= 0] - at] = 1
            sides.append(m)
        common += sides[0] @ sides[1].T
    both = sizes[left][:, None] + sizes[right][None, :]
    part = np.array(parts)
    found = []
    for i, j in zip(*np.nonzero((common >= threshold * (both - common)) & (part[left][:, None] != part[right][None, :])), strict=True):
        a, b = find(parts[left[i]]), find(parts[right[j]])
        if a != b and similarity(kmers[left[i]], kmers[right[j]], threshold):
            root[a] = b
            found.append((left[i], right[j]))
    return found


def across(mixed: DataFrame, rows: DataFrame, threshold: float, tile: int = 512) -> DataFrame:
    """Links (u, v) between components of a bucket, from rows (bucket, node, part, odd)."""
    tiles = mixed.groupBy("bucket").agg(F.ceil(F.count("*") / tile).cast("int").alias("_tiles"))
    texts = rows.select(F.col("_rid").alias("node"), "text").join(mixed.select("node").distinct(), "node", "left_semi")
    placed = mixed.join(tiles, "bucket").join(texts, "node").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_tiles")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    left = placed.where("odd").withColumn("_other", others).select(
        "bucket", F.col("_own").alias("_i"), F.col("_other").alias("_j"), F.lit(0).alias("_side"), "node", "part", "text")
    right = placed.withColumn("_other", others).select(
        "bucket", F.col("_other").alias("_i"), F.col("_own").alias("_j"), F.lit(1).alias("_side"), "node", "part", "text")
    dealt = left.unionByName(right).repartition("bucket", "_i", "_j").sortWithinPartitions("bucket", "_i", "_j", "_side", "node")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def links() -> list[tuple[int, int]]:
            nodes: dict[int, int] = {}
            left = [nodes.setdefault(g[1], len(nodes)) for g in group if g[0] == 0]
            right = [nodes.setdefault(g[1], len(nodes)) for g in group if g[0] == 1]
            by = {g[1]: g for g in group}
            names = list(nodes)
            found = joining([by[n][3] for n in names], [by[n][2] for n in names], left, right, threshold) if left and right else []
            return [(min(names[i], names[j]), max(names[i], names[j])) for i, j in found]

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())],
                                              names=["u", "v"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                found = []
                for words in wordhash.words(some.column(6)):
                    kmers, count = labelled(words)
                    found += np.split(kmers, np.cumsum(count)[:-1])
                out = []
                keys = zip(*[some.column(c).to_pylist() for c in (0, 1, 2)], strict=True)
                for k, side, node, part, own in zip(keys, *[some.column(c).to_pylist() for c in (3, 4, 5)], found, strict=True):
                    if k != key:
                        out += links()
                        key, group = k, []
                    group.append((side, node, part, own))
                if out:
                    yield batch_of(out)
        yield batch_of(links())

    return dealt.mapInArrow(join, "u long, v long")


def groups(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (_rid, _class) of numbered documents (_rid, doc_id, text); texts alone have their own number as class."""
    signed = materialise(signatures(rows), "signatures")
    digest = ["_d1", "_d2"]
    exact = materialise(signed.groupBy(*digest).agg(F.min("_rid").alias("_rep"), F.first("_sketches").alias("_sketches")), "exact")
    # equal sketches of one text lead to one bucket, too
    entries = exact.select(F.explode(F.array_distinct("_sketches")).alias("bucket"), F.col("_rep").alias("node"))
    parts = linked(entries, lambda pairs: verified(pairs, rows, threshold), lambda mixed: across(mixed, rows, threshold))
    classes = exact.select(*digest, "_rep").join(parts, F.col("_rep") == F.col("node"), "left") \
        .select(*digest, F.coalesce("component", "_rep").alias("_class"))
    found = signed.select("_rid", *digest).join(classes, digest).select("_rid", "_class")
    return materialise(rows.select("_rid").join(found, "_rid", "left").select("_rid", F.coalesce("_class", "_rid").alias("_class")), "groups")


def classes(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (_rid, doc_id, class_id, class_size, kept) of numbered documents."""
    found = rows.select("_rid", "doc_id").join(groups(rows, threshold), "_rid")
    order = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_rid")
    best = found.groupBy("_class").agg(F.min(order).alias("_best"), F.count("*").alias("class_size"))
    return found.join(best, "_class").select("_rid", "doc_id", F.col("_best.doc_id").alias("class_id"), "class_size",
                                             (F.col("_rid") == F.col("_best._rid")).alias("kept"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without near copies: one of each class, all columns."""
    rows = numbered(docs, "_rid")
    kept = classes(rows, threshold).where("kept").select("_rid")
    return rows.join(kept, "_rid", "left_semi").drop("_rid")
