"""Hard negatives of labelled vectors, exact, by an inverted multi-index.

Each half of the vectors has a codebook, and a pair of codewords is a cell. A half's score is at most the anchor's inner product
with the codeword plus the anchor's length times the codeword's radius, the largest distance of a member. So the sum of two
such half-score bounds holds for all rows of a cell. For each anchor a heap yields the cells by falling bounds, without
sorting all of them (the multi-sequence order), and a search ends where no cell that is left can change its result.

Two searches are made. The first finds the positives of each anchor: cells up to ``PROBE_ROWS`` rows give a k-th best score,
then all further cells whose bound reaches it are read. The second finds the negatives in the windows of the positives in the same way,
cells whose scores all lie above the widest window left out. A window is certified once no unread cell reaches the last
place that counts in it, so the results are those of comparing all rows, whatever the codebooks; these only decide how many
cells are read.

How it is spread: a cell is stored as packed tiles of about ``TILE_ROWS`` rows, anchors that read the same cell meet as packed
blocks, and a joined row is one tile and one block, so a cell with a third of all rows is many rows of an ordinary join. Only
the best of each pair of tile and block leave it. The codebooks are fitted on at most ``SAMPLE_ROWS`` rows, those with the
least hashes, and have the fourth root of the number of rows as codewords, 256 at most; they, the radii and the sizes of the
cells are the only things that go to the driver and to all tasks.

Defined results: rows with a null label or vector, or with a null or non-finite component (also after scaling) take no
part; components that a shorter vector lacks are 0; scores are exact integers, those beyond 64 bits become the largest or
smallest such number before they are compared; equal scores are ordered by id, null ids last, then by row; rows of equal ids are
rows of their own, each of them an anchor, and positives of each other; null ids are no anchors; an anchor without positives, and a
window without rows, gives none; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarflow.llm.common import materialise

SCALE = 256
TILE_ROWS, BLOCK_ANCHORS, PROBE_ROWS, SAMPLE_ROWS, MOST_WORDS = 1024, 256, 2048, 16_384, 256
K_POSITIVES, K_NEGATIVES = 5, 5
#: A negative's score is at least this part of the positive's, in hundredths.
LOWEST = 80
LONG = (-(1 << 63), (1 << 63) - 1)


def usable(rows: DataFrame, label: Column) -> DataFrame:
    """Rows (row, id, label, v) that take part: components scaled and rounded down, as doubles without a fraction."""
    v = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    exact = F.transform(F.col("embedding"), lambda x: x.cast("double") * SCALE)
    whole = F.forall(exact, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    # floor() gives a long; what is beyond it has no fraction anyway
    v = F.zip_with(exact, v, lambda x, n: F.when(F.abs(x) < 2.0**53, n).otherwise(x))
    return rows.where(F.col("embedding").isNotNull() & label.isNotNull() & F.coalesce(whole, F.lit(False))) \
        .select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))


class Index:
    """Codebooks of the two halves, the radii of their words, and how many rows each cell has."""

    def __init__(self, dims: int, words: tuple[np.ndarray, np.ndarray], exact: bool):
        self.dims, self.words, self.exact = dims, words, exact
        self.radii = tuple(np.zeros(len(w)) for w in words)
        self.sizes: dict[tuple[int, int], int] = {}
        self.anchors = 0

    def halves(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return m[:, : self.dims // 2], m[:, self.dims // 2 :]

    def nearest(self, m: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both halves: each row's word and the distance to it."""
        out = []
        with np.errstate(over="ignore", invalid="ignore"):
            for part, words in zip(self.halves(m), self.words, strict=True):
                scores = part @ words.T - (words * words).sum(1) / 2
                at = scores.argmax(1)
                out.append((at, np.sqrt(((part - words[at]) ** 2).sum(1))))
        return out

    def order(self, q: np.ndarray) -> Iterator[tuple[float, float, tuple[int, int]]]:
        """(highest, lowest possible score, cell) of an anchor for the cells that have rows, by falling highest score."""
        high, low, ranks = [], [], []
        for part, words, radii in zip(self.halves(q[None]), self.words, self.radii, strict=True):
            with np.errstate(over="ignore", invalid="ignore"):
                length = np.sqrt((part * part).sum())
                mid, far = words @ part[0], length * radii
                slack = 1e-9 * (length * np.sqrt((words * words).sum(1)) + far) + 1e-6
                known = np.isfinite(mid) & np.isfinite(far) & np.isfinite(slack)
                high.append(np.where(known, mid + far + slack, np.inf))
                low.append(np.where(known, mid - far - slack, -np.inf))
            ranks.append(np.argsort(-high[-1], kind="stable"))
        (a, b), (i0, j0) = ranks, (ranks[0][0], ranks[1][0])
        heap = [(-(high[0][i0] + high[1][j0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            cell = (int(a[i]), int(b[j]))
            if cell in self.sizes:
                yield max(-bound, LONG[0]), low[0][cell[0]] + low[1][cell[1]], cell
            if j + 1 < len(b):
                heapq.heappush(heap, (-(high[0][a[i]] + high[1][b[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(high[0][a[i + 1]] + high[1][b[0]]), i + 1, 0))


def _codebook(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Words by Lloyd's rounds from rows spread over the sample."""
    words = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = (sample @ words.T - (words * words).sum(1) / 2).argmax(1)
        sums = np.zeros_like(words)
        np.add.at(sums, at, sample)
        n = np.bincount(at, minlength=k)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out, at = np.zeros((len(lengths), dims)), 0
    for i, n in enumerate(lengths):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def fit(rows: DataFrame) -> Index:
    """Codebooks from the sample; one pass over all rows for length and magnitude, one for the number."""
    n, dims, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    dims = dims or 0
    k = int(np.clip(round((n or 0) ** 0.25), 1, MOST_WORDS))
    sample = rows.orderBy(F.xxhash64("v", "row"), "row").limit(SAMPLE_ROWS).select("v").toArrow() if n else None
    m = _matrix(sample.column("v").combine_chunks(), dims) if n else np.zeros((1, dims))
    with np.errstate(over="ignore", invalid="ignore"):
        m = np.clip(m, -1e150, 1e150)
        words = tuple(_codebook(part, min(k, len(m))) for part in (m[:, : dims // 2], m[:, dims // 2 :]))
    return Index(dims, words, max(dims, 1) * min(most or 0.0, 1e30) ** 2 < 2.0**53)


def products(index: Index, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of two matrices, as int64."""
    if index.exact:  # all partial sums are integers that doubles hold
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in a], object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], object).reshape(b.shape).T
    return np.array([[min(max(int(x), LONG[0]), LONG[1]) for x in r] for r in whole], np.int64).reshape(len(a), len(b))


TILES = "i int, j int, tile_rows binary, tile_ids binary, tile_labels binary, tile_v binary"
#: A null id is the largest number here, so that it comes last; no id that is given is.
NO_ID = LONG[1]


def _packed(table: pa.Table, dims: int) -> list[bytes]:
    ids = table.column("id").fill_null(NO_ID).to_numpy()
    return [table.column("row").to_numpy().astype("<i8").tobytes(), ids.astype("<i8").tobytes(),
            table.column("label").to_numpy().astype("<i8").tobytes(), _matrix(table.column("v").combine_chunks(), dims).astype("<f8").tobytes()]


def build(rows: DataFrame, index: Index) -> DataFrame:
    """Writes all rows as packed tiles of their cells, and completes ``index`` by radii and sizes."""
    dims = index.dims

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (i, di), (j, dj) = index.nearest(_matrix(batch.column("v"), dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in (i.astype(np.int32), j.astype(np.int32), di, dj))],
                                             [*batch.schema.names, "i", "j", "di", "dj"])

    placed = materialise(rows.mapInArrow(assign, "row long, id long, label long, v array<double>, i int, j int, di double, dj double"), "cells")
    found = placed.groupBy("i", "j").agg(F.count("*").alias("n"), F.max("di").alias("di"), F.max("dj").alias("dj"))
    for r in found.toLocalIterator():  # at most MOST_WORDS squared
        index.sizes[r["i"], r["j"]] = r["n"]
        index.radii[0][r["i"]] = max(index.radii[0][r["i"]], r["di"])
        index.radii[1][r["j"]] = max(index.radii[1][r["j"]], r["dj"])
    dealt = placed.join(F.broadcast(found.select("i", "j", "n")), ["i", "j"]) \
        .withColumn("tile", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / TILE_ROWS)))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "j": pa.array([key[1].as_py()], pa.int32()),
                         **{name: pa.array([x], pa.binary()) for name, x in zip(("tile_rows", "tile_ids", "tile_labels", "tile_v"), _packed(table, dims), strict=True)}})

    return materialise(dealt.select("row", "id", "label", "v", "i", "j", "tile").groupBy("i", "j", "tile").applyInArrow(pack, TILES), "tiles")


ANCHORS = "row long, id long, label long, v array<double>"
VISITS = "i int, j int, row long, id long, label long, v array<double>, bounds array<long>"


def visits(anchors: DataFrame, index: Index, probe: bool) -> DataFrame:
    """The cells that each anchor reads, by the heap: with ``probe`` those that first hold PROBE_ROWS rows, else all others whose
    highest score is at least the anchor's ``need``. Cells whose scores all lie above ``top`` (if there is one) are passed over."""
    dims = index.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("v"), dims)
            needs, tops = batch.column("need").to_pylist(), batch.column("top").to_pylist()
            of, cells = [], []
            for at in range(len(m)):
                rows = 0
                for high, low, cell in index.order(m[at]):
                    need, top = needs[at], tops[at]
                    first = rows < PROBE_ROWS
                    if (probe and not first) or (need is not None and high < need):
                        break
                    if top is not None and low > top and top < LONG[1]:
                        continue
                    rows += index.sizes[cell]
                    if first == probe:
                        of.append(at)
                        cells.append(cell)
                    if len(of) >= 4096:
                        yield made(batch, of, cells)
                        of, cells = [], []
            if of:
                yield made(batch, of, cells)

    def made(batch: pa.RecordBatch, of: list[int], cells: list[tuple[int, int]]) -> pa.RecordBatch:
        chosen = batch.select(["row", "id", "label", "v", "bounds"]).take(pa.array(of))
        i, j = (pa.array([c[h] for c in cells], pa.int32()) for h in (0, 1))
        return pa.RecordBatch.from_arrays([i, j, *chosen.columns], ["i", "j", *chosen.schema.names])

    schema = "i int, j int, row long, id long, label long, v array<double>, bounds array<long>"
    return anchors.select("row", "id", "label", "v", "need", "top", "bounds").mapInArrow(run, schema)


def _blocks(index: Index):
    """Packs the anchors of a cell that are dealt to one block."""
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        names = ("block_rows", "block_ids", "block_labels", "block_v")
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "j": pa.array([key[1].as_py()], pa.int32()),
                         **{n: pa.array([x], pa.binary()) for n, x in zip(names, _packed(table, index.dims), strict=True)},
                         "bounds": pa.array([table.column("bounds").to_pylist()], pa.list_(pa.list_(pa.int64())))})

    return pack


BLOCKS = "i int, j int, block_rows binary, block_ids binary, block_labels binary, block_v binary, bounds array<array<long>>"
FOUND = "row long, place int, score long, id long, other long"


def _top(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k best of the columns ``at`` of one row of scores: score falling, id, row."""
    if len(at) > 4 * k:
        least = np.partition(~scores[at], k - 1)[k - 1]  # -x would not hold for the smallest number
        at = at[~scores[at] <= least]
    return at[np.lexsort((rows[at], ids[at], ~scores[at]))[:k]]


def compared(tiles: DataFrame, wanted: DataFrame, index: Index, negatives: bool, k: int) -> DataFrame:
    """Rows (row, place, score, id, other) of the best of each pair of tile and block. Positives have place 0; a negative's place
    is that of its window, of which ``bounds`` holds the lowest and highest scores."""
    dims = index.dims
    dealt = wanted.withColumn("_block", F.pmod(F.xxhash64("row"), F.lit(max(1, index.anchors // BLOCK_ANCHORS))))
    blocks = dealt.groupBy("i", "j", "_block").applyInArrow(_blocks(index), BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = []
            for r in range(batch.num_rows):
                one = {n: batch.column(n)[r] for n in batch.schema.names}
                arrays = {n: np.frombuffer(x.as_py(), "<f8" if n.endswith("_v") else "<i8") for n, x in one.items() if n not in ("i", "j", "bounds")}
                rows, ids, labels = arrays["tile_rows"], arrays["tile_ids"], arrays["tile_labels"]
                scores = products(index, arrays["block_v"].reshape(len(arrays["block_rows"]), dims), arrays["tile_v"].reshape(len(rows), dims))
                bounds = one["bounds"].as_py()
                for a, (row, label) in enumerate(zip(arrays["block_rows"], arrays["block_labels"], strict=True)):
                    line = scores[a]
                    if negatives:
                        given = bounds[a]
                        windows = [(p, given[2 * p], given[2 * p + 1]) for p in range(len(given) // 2)]
                        free = np.flatnonzero((labels != label) & (line >= min(w[1] for w in windows)) & (line <= max(w[2] for w in windows)))
                        picked = [(p, _top(line, ids, rows, free[(line[free] >= low) & (line[free] <= high)], k)) for p, low, high in windows]
                    else:
                        least = bounds[a][0] if bounds[a] else LONG[0]
                        picked = [(0, _top(line, ids, rows, np.flatnonzero((labels == label) & (rows != row) & (line >= least)), k))]
                    out += [[np.full(len(at), row), np.full(len(at), p), line[at], ids[at], rows[at]] for p, at in picked if len(at)]
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32 if n == 1 else np.int64)) for n, c in enumerate(columns)],
                                                 ["row", "place", "score", "id", "other"])

    return tiles.join(blocks, ["i", "j"]).drop("i", "j").mapInArrow(run, FOUND)


def kept(found: DataFrame, k: int) -> DataFrame:
    """The k best rows (score, id, other) of each (row, place), in order, as the array ``best``."""
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("score"), "id", "other"))
    entry = F.struct(F.col("_rank").alias("rank"), "score", "id", "other")
    return found.withColumn("_rank", rank).where(F.col("_rank") <= k) \
        .groupBy("row", "place").agg(F.array_sort(F.collect_list(entry)).alias("best"))


def search(anchors: DataFrame, tiles: DataFrame, index: Index, negatives: bool, k: int) -> DataFrame:
    """Rows (row, place, best) of anchors (row, id, label, v, bounds, need, top): a probe, then all that may still count."""
    probed = kept(compared(tiles, visits(anchors, index, probe=True), index, negatives, k), k)
    probed = materialise(probed, "probed")
    full = F.when(F.size("best") >= k, F.element_at("best", k)["score"])
    if negatives:
        # a window that is not full reaches down to its lowest score
        reached = F.when(F.col("_full").isNotNull(), F.col("_full")).otherwise(F.col("_low"))
        windows = anchors.select("row", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("bounds") / 2).cast("int") - 1), lambda p: F.get("bounds", 2 * p))).alias("place", "_low"))
        needs = windows.join(probed.select("row", "place", full.alias("_full")), ["row", "place"], "left").groupBy("row").agg(F.min(reached).alias("_need"))
    else:
        needs = probed.select("row", full.alias("_need"))
    further = anchors.join(needs, "row", "left").withColumn("need", F.col("_need")).drop("_need")
    if not negatives:  # scores below the k-th best of the probe no longer count
        further = further.withColumn("bounds", F.when(F.col("need").isNotNull(), F.array("need")).otherwise(F.col("bounds")))
    rest = compared(tiles, visits(further, index, probe=False), index, negatives, k)
    first = probed.select("row", "place", F.explode("best").alias("_b")).select("row", "place", "_b.score", "_b.id", "_b.other")
    return materialise(kept(first.unionByName(rest), k), "found")


def mined(rows: DataFrame, *, label: Column | None = None, anchor: Column | None = None, positives: int = K_POSITIVES,
          negatives: int = K_NEGATIVES, lowest: int = LOWEST) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (vec_id, embedding, label).

    ``anchor`` says which ids are anchors. A negative has another label, and a score from ``lowest`` hundredths of the positive's up to it.
    """
    taking = materialise(usable(rows, F.col("label") if label is None else label), "vectors")
    index = fit(taking)
    tiles = build(taking, index)
    chosen = taking.where((F.col("id") % 100 == 0) if anchor is None else anchor)
    index.anchors = chosen.count()
    nothing = F.lit(None).cast("long")
    anchors = chosen.select("row", "id", "label", "v", F.array().cast("array<long>").alias("bounds"), nothing.alias("need"), nothing.alias("top"))
    near = search(anchors, tiles, index, False, positives)
    whole = F.transform("best", lambda b: b["score"].cast("decimal(24,0)"))
    low = F.transform(whole, lambda s: F.ceil(s * lowest / 100).cast("decimal(24,0)"))
    bounds = F.flatten(F.zip_with(low, whole, lambda a, b: F.array(a.cast("long"), b.cast("long"))))
    windows = anchors.select("row", "id", "label", "v").join(near.select("row", "best", bounds.alias("bounds")), "row")
    lows = F.transform(F.sequence(F.lit(0), F.size("best") - 1), lambda p: F.get("bounds", 2 * p))
    asked = windows.select("row", "id", "label", "v", "bounds", F.array_min(lows).alias("need"), F.array_max(F.transform("best", lambda b: b["score"])).alias("top"))
    found = search(asked, tiles, index, True, negatives)
    named = found.join(windows.select("row", F.col("id").alias("anchor_id"), F.col("best").alias("_near")), "row")
    return named.select("anchor_id", F.get("_near", F.col("place")).alias("_p"), F.posexplode("best").alias("_at", "_n")).select(
        "anchor_id", F.nullif(F.col("_p.id"), F.lit(NO_ID)).alias("positive_id"), (F.col("_at") + 1).alias("rank"),
        F.nullif(F.col("_n.id"), F.lit(NO_ID)).alias("negative_id"), F.col("_p.score").alias("positive_score"), F.col("_n.score").alias("negative_score"))
