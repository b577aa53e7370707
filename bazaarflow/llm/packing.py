"""Best-fit packing of token sequences under several capacities at once.

A document longer than a sequence is cut into full pieces, its first piece taking the rest. Pieces are dealt into cells
by hash. Inside a cell the longest goes first, to the sequence whose residual vector (tokens, pieces, attention cost)
is shortest after it among those that can take it under every capacity. Pieces of sequences that stay open are packed
once more, in new cells, so that a cell's unfinished sequences don't add up.

Defined results: a null text is an empty one, of the end id alone; equal rows are packed as rows of their own; ties go
to the sequence opened first; other columns of the pieces are passed through, and columns that pack() adds replace
columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarflow.llm import tokens
from bazaarflow.llm.common import materialise, own_columns

PIECE = "doc_id long, piece int, start long, length long, ids binary"


def cut(docs: DataFrame, tokenizer: str, end: int = 2, capacity: int = 1024, spaced: bool = True) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids) of all texts; ids are little-endian unsigned 32-bit integers."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer, spaced)
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            for part in tokens.slices(texts):
                flat, bounds = encoder.encode(texts[part], end)
                size = np.diff(bounds)
                count = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), count)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                first = (size - 1) % capacity + 1  # the first piece takes what full ones leave
                start = np.where(number == 0, 0, first[doc] + (number - 1) * capacity)
                length = np.where(number == 0, first[doc], capacity)
                places = np.concatenate([bounds[doc] + start, bounds[-1:]])
                yield pa.RecordBatch.from_arrays([
                    ids.slice(part.start, len(size)).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start),
                    pa.array(length), tokens.binary(flat, places)], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECE)


def place(lengths: np.ndarray, capacity: int, max_pieces: int, max_cost: float,
          weights: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each length: its sequence, its offset there; of each sequence: the tokens left."""
    full = np.array([capacity, max_pieces, max_cost], float)
    weigh = np.array(weights) / full**2
    bins, offsets = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    alone = order[lengths[order] >= capacity]
    bins[alone] = np.arange(len(alone))
    order, used = order[len(alone):], len(alone)
    left_over = np.zeros(len(lengths), np.int64)
    left, number = np.empty((1024, 3)), np.empty(1024, np.int64)
    n = 0
    least = lengths[order[-1]] if len(order) else 0
    for turn, item in enumerate(order):
        size = lengths[item]
        need = np.array([size, 1, float(size) * size])
        after = left[:n] - need
        score = np.where((after >= 0).all(1), (after * after) @ weigh, np.inf)
        best = int(score.argmin()) if n else -1
        if best < 0 or score[best] == np.inf:
            if n == len(left):
                left, number = np.concatenate([left, np.empty_like(left)]), np.concatenate([number, np.empty_like(number)])
            left[n], number[n] = full, used
            best, n, used = n, n + 1, used + 1
        bins[item], offsets[item] = number[best], capacity - left[best, 0]
        left[best] -= need
        left_over[number[best]] = left[best, 0]
        if turn % 128 == 127:  # sequences that can take nothing more are set aside
            open_ = (left[:n, 0] >= least) & (left[:n, 1] >= 1)
            n = int(open_.sum())
            left[:n], number[:n] = left[: len(open_)][open_], number[: len(open_)][open_]
    return bins, offsets, left_over[:used]


def pack(pieces: DataFrame, rows: int, capacity: int = 1024, max_pieces: int = 1024, max_cost: float | None = None,
         weights: tuple[float, float, float] = (1.0, 0.1, 0.1), cell_rows: int = 4096, slack: int = 4) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of at most ``capacity``.

    ``rows``: about how many pieces are shorter than a sequence; it only sets the number of cells.
    """
    cost = float(capacity) ** 2 if max_cost is None else max_cost
    columns = own_columns(pieces, ("sequence_id", "offset"))
    schema = T.StructType([*[pieces.schema[c] for c in columns], T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType()), T.StructField("_open", T.BooleanType())])

    def packed(df: DataFrame, cells: int, base: int, keep_open: bool) -> DataFrame:
        def one(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            # rows come in any order from a shuffle: a fixed order makes a repeated task give the same result
            names = [c for c in ("doc_id", "piece") if c in columns]
            group = group.sort_by([(c, "ascending") for c in ["length", *names]])
            lengths = group.column("length").to_numpy()
            bins, offsets, left = place(lengths, capacity, max_pieces, cost, weights)
            again = (left > slack)[bins] if keep_open else np.zeros(len(bins), bool)
            return group.select(columns).append_column("sequence_id", pa.array(bins + (base + key[0].as_py() << 32))) \
                .append_column("offset", pa.array(offsets)).append_column("_open", pa.array(again))

        cell = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns if c in ("doc_id", "piece")], "length"), F.lit(cells))
        return df.select(*[F.col(f"`{c}`") for c in columns], cell.alias("_cell")) \
            .repartition(max(1, min(cells, 100_000)), "_cell").groupBy("_cell").applyInArrow(one, schema)

    cells = max(1, -(-rows // cell_rows))
    first = materialise(packed(pieces, cells, 0, True), "packed")
    open_ = first.where("_open")
    again = packed(open_, max(1, -(-open_.count() // cell_rows)), cells, False)
    return first.where("not _open").drop("_open").unionByName(again.drop("_open"))
