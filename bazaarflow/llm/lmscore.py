"""Language-model scores from a Bloom filter of logarithmic counts.

Counting: tasks turn texts into sorted arrays of token and bigram hashes with counts, and send each run of hashes to the
segment that its leading bits name; a segment adds up what it gets. The number of segments follows the size of the texts.

The filter: a token or bigram seen c times is entered with the levels 1 to 1 + floor(log2 c); its count is read back by
probing one level after another until one is missing, so it is never too low. Each segment has bits of its own,
``BITS`` for each entry at every size, so the whole grows with the corpus and errs as seldom. It is a list of small filters. Up to
``broadcast_mb`` it is broadcast; a larger one stays a table, in parts of many segments: four for each core, more only where one would
be larger than ``held_mb``. Texts go in runs of about a megabyte, each run sends its hashes to the parts, where a task holds one part at
a time, and gets one byte back for each, its level. So what is sent grows with the texts, and not with the segments too. Both ways give
the same scores.

Scores: P(w | u) = (c(u w) + MU * P(w)) / (c(u) + MU), P(w) = (c(w) + 1) / (N + V + 1), all counts from the filter. A text's
first token follows an end token.

The base score needs exact counts of all tokens. Those of the ``head_rows`` most frequent ones at most are broadcast; what a
text has of the others is joined to their counts by shuffle. Tokens are told apart by 64-bit hashes.

Defined results: a null text is an empty one, a single end token; rows with equal ids are scored row by row; without
training rows all counts, N and V are 0; columns that score() adds replace those of the same name, and columns that begin
with an underscore go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarflow.llm import wordhash
from bazaarflow.llm.common import materialise, own_columns

#: The end of a text, as a token. Not the hash of any word but by chance.
END = np.uint64(0x5F1D7A3C9B24E681)
BITS, PROBES = 10, 3
MU = 4.0
TOKEN, BIGRAM = 0, 1


def sequences(words: wordhash.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with the end of each text, the token before each, and where each text begins."""
    bounds = np.concatenate([[0], np.cumsum(words.counts + 1)])
    tokens = np.full(bounds[-1], END, np.uint64)
    inner = np.ones(bounds[-1], bool)
    inner[bounds[1:] - 1] = False
    tokens[inner] = words.hashes
    before = np.concatenate([[END], tokens[:-1]]).astype(np.uint64)
    return tokens, before, bounds[:-1]


def bigrams(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return wordhash.chain(before, tokens)


def summed(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and what they count together."""
    key = np.concatenate(keys)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    if counts is None:
        return key[first], np.diff(np.concatenate([first, [len(key)]])).astype(np.int64)
    return key[first], np.add.reduceat(np.concatenate(counts)[order], first) if len(key) else np.empty(0, np.int64)


def count_segments(texts: DataFrame, bits: int) -> DataFrame:
    """Rows (kind, segment, keys, counts): sorted hashes as bytes, added up within a task as far as memory allows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {TOKEN: [], BIGRAM: []}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, keys in held.items():
                if not keys:
                    continue
                key, n = summed(keys)
                keys.clear()
                segment = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
                begin = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
                end = np.concatenate([begin[1:], [len(key)]])
                n = n.astype(np.uint32)
                for at in range(0, len(begin), 64):
                    some = range(at, min(at + 64, len(begin)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([kind] * len(some), pa.int32()), pa.array(segment[begin[at : at + 64]]),
                        pa.array([key[begin[i] : end[i]].tobytes() for i in some], pa.binary()),
                        pa.array([n[begin[i] : end[i]].tobytes() for i in some], pa.binary())],
                        names=["kind", "segment", "keys", "counts"])

        for batch in batches:
            for words in wordhash.words(batch.column(0)):
                tokens, before, _ = sequences(words)
                held[TOKEN].append(tokens)
                held[BIGRAM].append(bigrams(before, tokens))
                size += len(tokens)
                if size > 4_000_000:
                    yield from flush()
                    size = 0
        yield from flush()

    return texts.mapInArrow(count, "kind int, segment long, keys binary, counts binary")


def place(keys: np.ndarray, level: int, probe: int, bits: np.ndarray | np.uint64) -> np.ndarray:
    """The bit that an entry has by this probe."""
    base = wordhash.mix(keys + np.uint64(0x9E3779B97F4A7C15 * level & 0xFFFFFFFFFFFFFFFF))
    return ((base + np.uint64(probe) * ((base >> np.uint64(17)) | np.uint64(1))) >> np.uint64(11)) % bits


def filter_bits(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter of one segment."""
    levels = np.floor(np.log2(counts)).astype(np.int64) + 1
    entries = int(levels.sum())
    n = np.uint64(8 * max(8, -(-entries * BITS // 8)))
    out = np.zeros(int(n), bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for probe in range(PROBES):
            out[place(keys[levels >= level], level, probe, n)] = True
    return np.packbits(out, bitorder="little").tobytes()


def merged(counted: DataFrame) -> DataFrame:
    """One row for each kind and segment: its filter, and the sorted keys and counts of tokens."""
    def merge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        keys, n = summed([np.frombuffer(x, np.uint64) for x in group.column("keys").to_pylist()],
                         [np.frombuffer(x, np.uint32).astype(np.int64) for x in group.column("counts").to_pylist()])
        exact = key[0].as_py() == TOKEN
        return pa.table({
            "kind": pa.array([key[0].as_py()], pa.int32()), "segment": pa.array([key[1].as_py()]),
            "distinct": pa.array([len(keys)]), "total": pa.array([int(n.sum())]),
            "keys": pa.array([keys.tobytes() if exact else None], pa.binary()),
            "counts": pa.array([n.tobytes() if exact else None], pa.binary()),
            "filter": pa.array([filter_bits(keys, n)], pa.binary())})

    return counted.groupBy("kind", "segment").applyInArrow(
        merge, "kind int, segment long, distinct long, total long, keys binary, counts binary, filter binary")


@dataclass
class CountFilter:
    """The filters of all segments of one kind, one after another."""

    data: np.ndarray
    starts: np.ndarray  # bytes before each segment
    segment_bits: int
    skip: int = 0  # leading bits before those that name a segment

    @classmethod
    def of(cls, rows: list[tuple[int, bytes]], segment_bits: int, skip: int = 0) -> CountFilter:
        by = dict(rows)
        parts = [by.get(i, b"") for i in range(1 << segment_bits)]
        return cls(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]), segment_bits, skip)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level found; 0 if none is."""
        segment = np.zeros(len(keys), np.int64)
        if self.segment_bits:
            own = keys << np.uint64(self.skip) if self.skip else keys
            segment = (own >> np.uint64(64 - self.segment_bits)).astype(np.int64)
        begin = self.starts[segment]
        bits = (8 * (self.starts[segment + 1] - begin)).astype(np.uint64)
        level = np.zeros(len(keys), np.int64)
        active = np.flatnonzero(bits > 0)
        turn = 0
        while len(active):
            turn += 1
            for probe in range(PROBES):
                bit = place(keys[active], turn, probe, bits[active])
                byte = self.data[begin[active] + (bit >> np.uint64(3)).astype(np.int64)]
                active = active[(byte >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            level[active] = turn
        return level

    def count(self, keys: np.ndarray) -> np.ndarray:
        return middle(self.levels(keys))


def middle(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that have this level as their highest; 0 if there is none."""
    low = np.exp2(np.maximum(level.astype(np.int64, copy=False) - 1, 0))
    return np.where(level > 0, (3 * low - 1) / 2, 0.0)


@dataclass
class Answers:
    """Counts that the filters gave to one run of texts: sorted keys and their counts."""

    keys: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Answers:
        """From some sorted keys and their counts."""
        if len(rows) == 1:
            return cls(*rows[0])
        keys = np.concatenate([np.empty(0, np.uint64), *[k for k, _ in rows]])
        counts = np.concatenate([np.empty(0), *[n for _, n in rows]])
        order = np.argsort(keys)
        return cls(keys[order], counts[order])

    def count(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0.0)


@dataclass
class Model:
    tokens: CountFilter | Answers | None  # None: the filters were not broadcast
    bigrams: CountFilter | Answers | None
    total: int
    distinct: int
    head_keys: np.ndarray
    head_counts: np.ndarray
    filter_bytes: int

    def logs(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """log10 P of each token after the one before it."""
        distinct, at = np.unique(tokens, return_inverse=True)
        own = self.tokens.count(distinct)
        context_of = np.searchsorted(distinct, before)
        found = (context_of < len(distinct)) & (distinct[np.minimum(context_of, len(distinct) - 1)] == before)
        context = np.where(found, own[np.minimum(context_of, len(distinct) - 1)], 0)
        if not found.all():
            context[~found] = self.tokens.count(before[~found])
        pair = np.minimum(self.bigrams.count(bigrams(before, tokens)), context)
        alone = (own[at] + 1) / (self.total + self.distinct + 1)
        return np.log10((pair + MU * alone) / (context + MU))


def _head(table: DataFrame, head_rows: int) -> int:
    """The lowest power of two such that at most ``head_rows`` tokens have that count."""
    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                level, n = np.unique(np.floor(np.log2(np.frombuffer(counts, np.int64))).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(n)], names=["level", "n"])

    rows = table.select("counts").mapInArrow(histogram, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    above = 0
    for r in sorted(rows, key=lambda r: -r["level"]):
        above += r["n"]
        if above > head_rows:
            return 1 << (r["level"] + 1)
    return 1


def _counts(table: DataFrame, low: int, high: int | None) -> DataFrame:
    """Rows (key, c) of the tokens with a count of at least ``low``, below ``high``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key, n = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
                wanted = (n >= low) & (n < high) if high is not None else n >= low
                yield pa.RecordBatch.from_arrays([pa.array(key[wanted]), pa.array(n[wanted])], names=["key", "c"])

    return table.select("keys", "counts").mapInArrow(rows, "key long, c long")


def fit(texts: DataFrame, head_rows: int = 1_000_000, broadcast_mb: int = 256,
        segment_mb: int = 4) -> tuple[Model, DataFrame, int, int]:
    """The model of all texts (one column), the table of counts and filters, the count below which tokens are not in the head,
    and the number of bits that name a segment."""
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    bits = max(0, (size // (segment_mb << 20)).bit_length())
    counted = materialise(merged(count_segments(texts, bits)), "counts")
    tokens = counted.where(F.col("kind") == TOKEN)
    totals = tokens.agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).first()
    low = _head(tokens, head_rows)
    # at most head_rows tokens, and at most broadcast_mb of filters
    head = _counts(tokens, low, None).toArrow()
    key, n = head.column("key").to_numpy().view(np.uint64), head.column("c").to_numpy()
    order = np.argsort(key)
    filters = {TOKEN: None, BIGRAM: None}
    filter_bytes = counted.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    if filter_bytes <= broadcast_mb << 20:
        filters = {kind: CountFilter.of([(r["segment"], bytes(r["filter"])) for r in counted.where(F.col("kind") == kind)
                                         .select("segment", "filter").toLocalIterator()], bits) for kind in filters}
    model = Model(filters[TOKEN], filters[BIGRAM], totals["n"] or 0, totals["v"] or 0, key[order], n[order], filter_bytes)
    return model, counted, low, bits


def _columns(model: Model, seq: np.ndarray, before: np.ndarray, begin: np.ndarray) -> list[pa.Array]:
    """n_tokens, _known, _base, score and _tail of a run of texts."""
    value = model.logs(before, seq)
    if len(model.head_keys):
        at = np.minimum(np.searchsorted(model.head_keys, seq), len(model.head_keys) - 1)
        known = model.head_keys[at] == seq
        base = np.where(known, np.log10(model.head_counts[at] + 1.0), 0.0)
    else:
        known, base = np.zeros(len(seq), bool), np.zeros(len(seq))
    ends = np.concatenate([begin[1:], [len(seq)]])
    tail = np.flatnonzero(~known)
    bounds = np.searchsorted(tail, np.concatenate([begin, ends[-1:]]))
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(seq[tail].view(np.int64)))
    return [pa.array(ends - begin), pa.array(np.add.reduceat(known.astype(np.int64), begin)),
            pa.array(np.add.reduceat(base, begin)), pa.array(np.add.reduceat(value, begin)), lists]


_NAMES = ["n_tokens", "_known", "_base", "score", "_tail"]
_TYPES = "n_tokens long, _known long, _base double, score double, _tail array<long>"


def _by_broadcast(docs: DataFrame, fields: str, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in wordhash.words(batch.column(batch.num_columns - 1)):
                own = batch.slice(words.first, len(words.counts))
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], *_columns(shared.value, *sequences(words))],
                                                 names=[*own.schema.names[:-1], *_NAMES])

    return docs.mapInArrow(scored, f"{fields}, {_TYPES}")


def _asked(seq: np.ndarray, before: np.ndarray) -> dict[int, np.ndarray]:
    """What some texts ask of the filters, in order."""
    return {TOKEN: np.unique(np.append(seq, END)), BIGRAM: np.unique(bigrams(before, seq))}


def _part_bits(bits: int, filter_bytes: int, cores: int, held_mb: int) -> int:
    """How many of the ``bits`` that name a segment name its part: four parts a core, or as many as keep a part at ``held_mb``."""
    parts = max(4 * cores, -(-filter_bytes // (held_mb << 20)))
    return min(bits, (parts - 1).bit_length())


def _by_shuffle(docs: DataFrame, fields: str, model: Model, counted: DataFrame, bits: int, held_mb: int) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    part_bits = _part_bits(bits, model.filter_bytes, spark.sparkContext.defaultParallelism, held_mb)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId() << 33
        for batch in batches:
            for words in wordhash.words(batch.column(batch.num_columns - 1)):
                seq, _, begin = sequences(words)
                own = batch.slice(words.first, len(words.counts))
                ends = np.concatenate([begin[1:], [len(seq)]])
                yield pa.RecordBatch.from_arrays([
                    *own.columns[:-1], pa.array(np.full(len(begin), run)), pa.array(np.arange(len(begin))),
                    pa.array([seq[b:e].tobytes() for b, e in zip(begin, ends, strict=True)], pa.binary())],
                    names=[*own.schema.names[:-1], "_run", "_text", "_seq"])
                run += 1

    def runs(seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = [np.frombuffer(x, np.uint64) for x in seqs]
        begin = np.concatenate([[0], np.cumsum([len(x) for x in texts])[:-1]]).astype(np.int64)
        seq = np.concatenate(texts)
        # a text ends with END, which the first token of the next one follows
        return seq, np.concatenate([[END], seq[:-1]]).astype(np.uint64), begin

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            run, text = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # a run that lies in several batches asks for the texts of each
            begins = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.empty(0, np.int64)
            for first, last in zip(begins, [*begins[1:], len(run)], strict=False):
                seq, before, _ = runs(batch.column(2)[first:last].to_pylist())
                for kind, keys in _asked(seq, before).items():
                    part = (keys >> np.uint64(64 - part_bits)).astype(np.int64) if part_bits else np.zeros(len(keys), np.int64)
                    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                    n = len(begin)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([kind] * n, pa.int32()), pa.array(part[begin]), pa.array([run[first]] * n, pa.int64()),
                        pa.array([text[first]] * n, pa.int64()), pa.array([last - first] * n, pa.int64()),
                        pa.array([keys[b:e].tobytes() for b, e in zip(begin, [*begin[1:], len(keys)], strict=True)], pa.binary())],
                        names=["kind", "part", "_run", "_text", "_texts", "keys"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, filters, held = None, [], None
        for batch in batches:
            kinds, of, run, keys, segments, data = (batch.column(c).to_pylist() for c in ("kind", "part", "_run", "keys", "segment", "filter"))

            def answered(rows: list[int]) -> pa.RecordBatch:
                bounds = np.cumsum([0, *[len(keys[i]) // 8 for i in rows]])
                level = held.levels(np.frombuffer(b"".join(keys[i] for i in rows), np.uint64)).astype(np.uint8)
                columns = [batch.column(c).take(pa.array(rows)) for c in ("_run", "_text", "_texts", "kind", "part")]
                return pa.RecordBatch.from_arrays([*columns, pa.array([level[b:e].tobytes() for b, e in zip(bounds, bounds[1:], strict=False)], pa.binary())],
                                                  names=["_run", "_text", "_texts", "kind", "part", "levels"])

            waiting, size = [], 0
            for i in range(batch.num_rows):
                if at != (kinds[i], of[i]) or size > 8 << 20:
                    if waiting:
                        yield answered(waiting)
                    waiting, size = [], 0
                if at != (kinds[i], of[i]):
                    at, filters, held = (kinds[i], of[i]), [], None
                if run[i] is None:
                    filters.append((segments[i] & ((1 << bits - part_bits) - 1), data[i]))
                    continue
                if held is None:
                    held, filters = CountFilter.of(filters, bits - part_bits, part_bits), []
                waiting.append(i)
                size += len(keys[i])
            if waiting:
                yield answered(waiting)

    def scored(own: pa.Table, answers: pa.Table) -> pa.Table:
        own = own.sort_by("_text")
        seqs = own.column("_seq").to_pylist()
        seq, before, begin = runs(seqs)
        levels: dict[tuple[int, int], dict[int, list[tuple[int, bytes]]]] = {}
        for text, n, kind, part, level in zip(*(answers.column(c).to_pylist() for c in ("_text", "_texts", "kind", "part", "levels")), strict=True):
            levels.setdefault((text, n), {TOKEN: [], BIGRAM: []})[kind].append((part, level))
        found = {TOKEN: [], BIGRAM: []}
        for (text, n), given in levels.items():
            for kind, keys in _asked(*runs(seqs[text : text + n])[:2]).items():
                # parts come in the order of their keys
                found[kind].append((keys, middle(np.frombuffer(b"".join(x for _, x in sorted(given[kind])), np.uint8))))
        m = replace(shared.value, tokens=Answers.of(found[TOKEN]), bigrams=Answers.of(found[BIGRAM]))
        own = own.drop_columns(["_run", "_text", "_seq"])
        return pa.table([*own.columns, *_columns(m, seq, before, begin)], names=[*own.column_names, *_NAMES])

    # written once: a run keeps its rows, whichever task makes it again
    rows = materialise(docs.mapInArrow(split, f"{fields}, _run long, _text long, _seq binary"), "runs")
    asked = rows.select("_run", "_text", "_seq").mapInArrow(ask, "kind int, part long, _run long, _text long, _texts long, keys binary")
    filters = counted.select("kind", F.shiftright("segment", bits - part_bits).alias("part"), "segment", "filter")
    # a filter comes before what is asked of it
    found = asked.unionByName(filters, allowMissingColumns=True).repartition("kind", "part").sortWithinPartitions(
        "kind", "part", F.col("_run").asc_nulls_first()).mapInArrow(answer, "_run long, _text long, _texts long, kind int, part long, levels binary")
    return rows.groupBy("_run").cogroup(found.groupBy("_run")).applyInArrow(scored, f"{fields}, {_TYPES}")


def score(docs: DataFrame, training: Column, held_mb: int = 64, **options) -> DataFrame:
    """Learns from the rows of (doc_id, text) where ``training`` holds, and scores all.

    Adds n_tokens, n_known, train_tokens, base_score and score; ``text`` goes.
    """
    kept = own_columns(docs, ("text", "n_tokens", "n_known", "train_tokens", "base_score", "score"))
    model, counted, low, bits = fit(docs.where(training).select("text"), **options)
    tokens = counted.where(F.col("kind") == TOKEN)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    texts = docs.select(*kept, F.col("text").cast("string"))
    rows = _by_broadcast(texts, fields, model) if model.tokens is not None else _by_shuffle(
        texts, fields, model, counted, bits, held_mb)
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "scored")
    # no token outside the head is frequent, so none gathers many rows
    asked = rows.select("_row", F.explode("_tail").alias("key")).groupBy("_row", "key").agg(F.count("*").alias("_n"))
    found = asked.join(_counts(tokens, 1, low), "key").groupBy("_row").agg(
        F.sum("_n").alias("_more"), F.sum(F.col("_n") * F.log10(F.col("c") + 1)).alias("_logs"))
    norm = float(np.log10(model.total + model.distinct + 1))
    return rows.join(found, "_row", "left").select(
        *kept, "n_tokens", (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_logs", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"), "score")
