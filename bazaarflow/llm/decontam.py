"""Benchmark decontamination by latent semantic retrieval.

A passage is a run of words of a document, in windows of several lengths that overlap by half. Terms are the words of the
benchmark; the more passages a word is in, the less it weighs, but never nothing. The matrix of TF-IDF weighted passages,
of all documents and of the benchmark (whose rows together weigh as much), is decomposed by a randomised SVD: tasks multiply
their rows with a random matrix and back, a sum over tasks gives the sketch, and a second pass refines it.
A window whose vector in the latent space has a cosine of at least ``COSINE`` with an item's is a candidate.

Whatever the cosine, an inverted index adds all windows that can be leaks, of the first length that is at least twice the
item's: a leak has ``PARAPHRASE`` of the item's words, so of as many of its rarest words as may be missing and ``HITS``
more it has at least ``HITS``. No leak within such a window is lost, however many items there are; the latent space adds
looser ones from longer windows.

A candidate is a leak if the longest common subsequence of its words and the item's has ``LCS`` of the item's words, or
``PARAPHRASE`` of them and the whole answer in it too. The answer is the item's last sentence, its last quarter if it has one.

The benchmark is the query set: its words and items are broadcast, in blocks of ``BLOCK`` items. Words beyond ``TERMS``
distinct ones share columns, which bounds the matrices; the index keeps them apart.

Letters are compared without case. Defined results: a null or wordless text leaks nothing; a null or wordless item is left out; equal items are items of their
own; several windows give one row for each document and item, with the best values; equal rows leak alike; clean()
drops columns that begin with an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarflow.llm import wordhash
from bazaarflow.llm.common import materialise, own_columns

WINDOWS = (32, 64, 128)
RANK, OVERSAMPLE = 80, 16
COSINE = 0.6
LCS, PARAPHRASE = 0.8, 0.6
TERMS, BLOCK = 1 << 16, 4096
HITS = 4
#: Words whose vectors are added at once.
AT_ONCE = 2048


@dataclass
class Vocabulary:
    """Hashes of the benchmark's words, in order, with their columns and weights."""

    hashes: np.ndarray
    columns: np.ndarray
    weights: np.ndarray  # by column

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    @property
    def size(self) -> int:
        return len(self.weights)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the words that are in it, and their columns."""
        place = np.flatnonzero(self.maybe[(words >> np.uint64(44)).astype(np.int64)])
        if not len(self.hashes):
            return place[:0], place[:0]
        some = words[place]
        at = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
        known = self.hashes[at] == some
        return place[known], self.columns[at[known]]


def _passages(words: wordhash.Words, size: int) -> np.ndarray:
    """The number of each word's passage, when texts are cut without overlap."""
    per_text = -(-words.counts // size)
    first = np.cumsum(per_text) - per_text
    inside = np.arange(len(words.hashes)) - np.repeat(np.cumsum(words.counts) - words.counts, words.counts)
    return np.repeat(first, words.counts) + inside // size


def passage_terms(texts: DataFrame, shared, size: int = WINDOWS[1]) -> DataFrame:
    """Rows (passages, passage, column) for runs of texts: how many passages they have, and for each word of the vocabulary the
    number of its passage in the run and its column, both as 32-bit integers. Written, as several passes read them."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in wordhash.words(batch.column(0)):
                place, column = shared.value.find(words.hashes)
                passage = _passages(words, size)[place]
                yield pa.RecordBatch.from_arrays([
                    pa.array([int((-(-words.counts // size)).sum())]), pa.array([passage.astype(np.int32).tobytes()], pa.binary()),
                    pa.array([column.astype(np.int32).tobytes()], pa.binary())], names=["passages", "passage", "column"])

    return materialise(texts.mapInArrow(rows, "passages long, passage binary, column binary"), "passage-terms")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for n, passage, column in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            yield n, np.frombuffer(passage, np.int32), np.frombuffer(column, np.int32)


def passage_counts(terms: DataFrame, size: int) -> DataFrame:
    """Rows (column, n): in how many passages a column's terms are; column -1 counts passages. ``size``: columns."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for n, passage, column in _runs(batches):
            total[:-1] += np.bincount(np.unique(passage * np.int64(size) + column) % max(1, size), minlength=size)
            total[-1] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at == size, -1, at)), pa.array(total[at])], names=["column", "n"])

    return terms.mapInArrow(count, "column long, n long").groupBy("column").agg(F.sum("n").alias("n"))


def added(rows: np.ndarray, at: np.ndarray, begin: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """The sums of rows[at], each times its weight, over the runs of ``at`` that begin there; some runs at a time, which stay in the cache."""
    ends = np.append(begin[1:], len(at))
    out = np.empty((len(begin), rows.shape[1]), np.float32)
    first = 0
    while first < len(begin):
        last = max(first + 1, int(np.searchsorted(ends, begin[first] + AT_ONCE, "right")))
        part = slice(begin[first], ends[last - 1])
        value = np.take(rows, at[part], axis=0)
        if weight is not None:
            value *= weight[part, None]
        out[first:last] = np.add.reduceat(value, begin[first:last] - begin[first])
        first = last
    return out


def gram(weights: np.ndarray, x: np.ndarray, runs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, int]:
    """A' A x over passages, rows of length one, and how many rows count. A run: the passage and the column of each word."""
    out = np.zeros((len(weights), x.shape[1]), np.float32)
    rows = 0
    for passage, column in runs:
        weight = weights[column]
        passage, column, weight = passage[weight > 0], column[weight > 0], weight[weight > 0]
        if not len(passage):
            continue
        begin = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        number = np.repeat(np.arange(len(begin)), np.diff(np.concatenate([begin, [len(passage)]])))
        weight = (weight / np.sqrt(np.add.reduceat(weight.astype(np.float64) ** 2, begin))[number]).astype(np.float32)
        y = added(x, column, begin, weight)
        order = np.argsort(column, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(column[order]) != 0]))
        out[column[order][first]] += added(y, number[order], first, weight[order])
        rows += len(begin)
    return out, rows


def distributed_gram(terms: DataFrame, weights: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, int]:
    """The sum of gram() over all tasks, by row of the result."""
    shared = terms.sparkSession.sparkContext.broadcast((weights, x))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = gram(*shared.value, ((passage, column) for _, passage, column in _runs(batches)))
        used = np.flatnonzero(np.abs(out).sum(1) > 0)
        # blocks of columns go to one place each, to be added there
        for block in np.unique(used // 256):
            begin = int(block) * 256
            yield pa.RecordBatch.from_arrays([pa.array([begin]), pa.array([out[begin : begin + 256].tobytes()], pa.binary()), pa.array([0])],
                                             names=["begin", "data", "rows"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([b""], pa.binary()), pa.array([rows])], names=["begin", "data", "rows"])

    def add(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = None, 0
        for batch in parts:
            for data, n in zip(batch.column("data").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                value = np.frombuffer(data, np.float32)
                total, rows = value.astype(np.float64) if total is None else total + value, rows + n
        yield pa.RecordBatch.from_arrays([
            pa.array([key[0].as_py()]), pa.array([total.astype(np.float32).tobytes()], pa.binary()), pa.array([rows])], names=["begin", "data", "rows"])

    schema = "begin long, data binary, rows long"
    summed = terms.mapInArrow(part, schema).groupBy("begin").applyInArrow(add, schema)
    out, rows = np.zeros_like(x, dtype=np.float32), 0
    # at most TERMS rows of the sketch
    for r in summed.toLocalIterator():
        if r["begin"] < 0:
            rows = r["rows"]
        else:
            value = np.frombuffer(bytes(r["data"]), np.float32).reshape(-1, x.shape[1])
            out[r["begin"] : r["begin"] + len(value)] = value
    return out, rows


@dataclass
class Index:
    """Items by their rarest words."""

    hashes: np.ndarray  # in order, one for each word and item
    items: np.ndarray
    hits: np.ndarray  # how many a window needs, by item

    @classmethod
    def of(cls, vocabulary: Vocabulary, words: list[np.ndarray], paraphrase: float) -> Index:
        rare, hits = [], np.zeros(len(words), np.int64)
        for i, w in enumerate(words):
            needed = max(1, int(np.ceil(paraphrase * len(w) - 1e-9)))
            hits[i] = min(HITS, needed)
            order = np.argsort(-vocabulary.weights[vocabulary.find(w)[1]], kind="stable")
            rare.append(np.unique(w[order[: len(w) - needed + hits[i]]]))
        hashes = np.concatenate(rare) if rare else np.empty(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        return cls(hashes[order], np.repeat(np.arange(len(words)), [len(r) for r in rare])[order], hits)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the words that are in it, and an item of each; once for each item of a word."""
        low, high = np.searchsorted(self.hashes, words), np.searchsorted(self.hashes, words, "right")
        n = high - low
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(words)), n), self.items[np.repeat(low, n) + inside]


@dataclass
class Items:
    """The benchmark: one block of items."""

    ids: np.ndarray
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vectors: np.ndarray  # in the latent space, of length one
    index: Index


@dataclass
class Space:
    vocabulary: Vocabulary
    terms: np.ndarray  # latent vectors of weighted terms, by column


def answer(text: str) -> str:
    """The last sentence, or the last quarter of the words where there is but one."""
    words = text.split()
    ends = [i for i, w in enumerate(words[:-1]) if w[-1] in ".!?"]
    return " ".join(words[ends[-1] + 1 :] if ends else words[-(-3 * len(words) // 4) :])


def vocabulary_of(words: np.ndarray) -> Vocabulary:
    hashes = np.unique(words)
    columns = np.arange(len(hashes)) % TERMS
    return Vocabulary(hashes, columns, np.ones(min(len(hashes), TERMS), np.float32))


def fit(docs: DataFrame, items: list[str], seed: int = 0) -> Space:
    """The latent space of all passages."""
    spark = docs.sparkSession
    texts = docs.select(F.lower(F.col("text").cast("string")).alias("text"))
    runs = list(wordhash.words(pa.array(items, pa.string())))
    vocabulary = vocabulary_of(np.concatenate([w.hashes for w in runs]) if runs else np.empty(0, np.uint64))
    terms = passage_terms(texts, spark.sparkContext.broadcast(vocabulary))
    counts = {r["column"]: r["n"] for r in passage_counts(terms, vocabulary.size).collect()}
    n = max(1, counts.get(-1, 0)) + len(items)
    found = np.array([counts.get(i, 0) for i in range(vocabulary.size)], float) + 1
    vocabulary.weights = np.log1p(n / found).astype(np.float32)
    own_runs = [(w.text[place], column) for w in runs for place, column in [vocabulary.find(w.hashes)]]
    width = min(RANK + OVERSAMPLE, max(1, vocabulary.size))
    x = np.random.default_rng(seed).standard_normal((vocabulary.size, width)).astype(np.float32)
    for last in (False, True):
        own, rows_own = gram(vocabulary.weights, x, own_runs)
        whole, rows = distributed_gram(terms, vocabulary.weights, x)
        y = whole + own * np.float32(max(1, rows) / max(1, rows_own))
        if not last:
            x = np.linalg.qr(y.astype(np.float64))[0].astype(np.float32)
    values, vectors = np.linalg.eigh((x.T @ y + (x.T @ y).T) / 2)
    basis = x @ vectors[:, ::-1][:, :RANK]
    return Space(vocabulary, (basis * vocabulary.weights[:, None]).astype(np.float32))


def items_of(space: Space, ids: list[int], texts: list[str], paraphrase: float = PARAPHRASE) -> Items:
    split = lambda x: [p for w in wordhash.words(pa.array(x, pa.string())) for p in np.split(w.hashes, np.cumsum(w.counts)[:-1])]
    words = split(texts)
    vectors = np.zeros((len(words), space.terms.shape[1]), np.float32)
    for i, w in enumerate(words):
        vectors[i] = space.terms[space.vocabulary.find(w)[1]].sum(0)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Items(np.array(ids, np.int64), words, split([answer(t) for t in texts]), vectors / np.maximum(length, 1e-12),
                 Index.of(space.vocabulary, words, paraphrase))


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by rows of bits."""
    full = (1 << len(b)) - 1
    masks: dict[int, int] = {}
    for j, y in enumerate(b.tolist()):
        masks[y] = masks.get(y, 0) | 1 << j
    row = full
    for x in a.tolist():
        m = row & masks.get(x, 0)
        row = (row + m | row - m) & full
    return len(b) - row.bit_count()


def _windows(words: wordhash.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and end of windows that overlap by half and cover all words."""
    half = size // 2
    count = np.where(words.counts > 0, np.maximum(1, -(-words.counts // half) - 1), 0)
    text = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    base = np.cumsum(words.counts) - words.counts
    begin = base[text] + number * half
    return text, begin, np.minimum(begin + size, base[text] + words.counts[text])


def _looked_up(items: Items, words: wordhash.Words, place: np.ndarray, item: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows, by number, and the items of which they have enough rare words."""
    half = size // 2
    count = np.where(words.counts > 0, np.maximum(1, -(-words.counts // half) - 1), 0)
    first = np.cumsum(count) - count
    bounds = words.bounds
    text = np.searchsorted(bounds, place, "right") - 1
    number = (place - bounds[text]) // half
    # a word is in the window that begins with its half and in the one before
    key = np.concatenate([(first[text] + number - back)[fits] * len(items.words) + item[fits]
                          for back in (0, 1) for fits in [(number >= back) & (number - back < count[text])]])
    key, n = np.unique(key, return_counts=True)
    window, item = key // len(items.words), key % len(items.words)
    enough = n >= items.index.hits[item]
    return window[enough], item[enough]


def candidates(space: Space, items: Items, words: wordhash.Words, cosine: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, first word, end, item, cosine) of the windows near an item or with enough of its rare words."""
    place, column = space.vocabulary.find(words.hashes)
    if not len(place):
        return
    # windows begin and end with blocks of half the least size: sums of blocks are enough
    step = WINDOWS[0] // 2
    blocks = -(-words.counts // step)
    base, first = words.bounds[:-1], np.cumsum(blocks) - blocks
    text = np.searchsorted(words.bounds, place, "right") - 1
    block = first[text] + (place - base[text]) // step
    begin = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    total = np.zeros((blocks.sum() + 1, space.terms.shape[1]))
    total[block[begin] + 1] = added(space.terms, column, begin)
    np.cumsum(total, axis=0, out=total)
    known = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=blocks.sum()))])
    longest = max(map(len, items.words), default=0)
    sizes = list(WINDOWS)
    while sizes[-1] < 2 * longest:
        sizes.append(2 * sizes[-1])
    rare, of = items.index.find(words.hashes[place])
    rare = place[rare]
    fitting = np.array(sizes)[np.searchsorted(sizes, [2 * len(w) for w in items.words])]
    for size in sizes:
        text, begin, end = _windows(words, size)
        own = fitting[of] == size
        window, item = _looked_up(items, words, rare[own], of[own], size)
        low, high = first[text] + (begin - base[text]) // step, first[text] - (base[text] - end) // step
        some = known[high] > known[low]
        window = (np.cumsum(some) - 1)[window]
        text, begin, end, low, high = text[some], begin[some], end[some], low[some], high[some]
        for at in range(0, len(text), 4096):
            part = slice(at, at + 4096)
            vectors = (total[high[part]] - total[low[part]]).astype(np.float32)
            near = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)) @ items.vectors.T
            wanted = near >= cosine
            inside = slice(*np.searchsorted(window, [at, at + len(vectors)]))
            wanted[window[inside] - at, item[inside]] = True
            for i, j in zip(*np.nonzero(wanted), strict=True):
                yield text[at + i], begin[at + i], end[at + i], j, float(near[i, j])


def _blocks(docs: DataFrame, benchmark: DataFrame, paraphrase: float) -> list:
    """Broadcasts (space, items) of the benchmark's items; none without items."""
    # the benchmark is the query set; it is read here in whole and broadcast in blocks
    rows = benchmark.select(F.col("item_id").cast("long"), F.lower(F.col("text").cast("string")).alias("text")).where(
        F.col("text").rlike("[^\\x20\\x09-\\x0D]")).orderBy("item_id", "text").collect()
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]
    space = fit(docs, texts) if rows else None
    return [docs.sparkSession.sparkContext.broadcast((space, items_of(space, ids[at : at + BLOCK], texts[at : at + BLOCK], paraphrase)))
            for at in range(0, len(rows), BLOCK)]


def _found(texts: pa.Array, space: Space, items: Items, cosine: float, share: float,
           paraphrase: float) -> Iterator[tuple[int, dict[tuple[int, int], tuple[float, float, bool]]]]:
    """For runs of texts: the number of the first, and (cosine, lcs_share, answer_found) by text of the run and item."""
    sizes = np.array([len(w) for w in items.words])
    sets = [np.sort(w) for w in items.words]
    for words in wordhash.words(texts):
        best: dict[tuple[int, int], tuple[float, float, bool]] = {}
        for text, begin, end, j, near in candidates(space, items, words, cosine):
            window = words.hashes[begin:end]
            own = sets[j]
            # words in common are no fewer than those of a common subsequence
            at = np.minimum(np.searchsorted(own, window), len(own) - 1)
            if (own[at] == window).sum() < paraphrase * sizes[j]:
                continue
            part = lcs(items.words[j], window) / sizes[j]
            if part < paraphrase:
                continue
            answered = lcs(items.answers[j], window) == len(items.answers[j])
            if part >= share or answered:
                old = best.get((text, j), (0.0, 0.0, False))
                best[text, j] = (max(near, old[0]), max(part, old[1]), answered or old[2])
        if best:
            yield words.first, best


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, share: float = LCS,
          paraphrase: float = PARAPHRASE) -> DataFrame:
    """Rows (doc_id, _rid where docs has it, item_id, cosine, lcs_share, answer_found) of the leaks found."""
    keys = [c for c in ("doc_id", "_rid") if c in docs.columns]
    fields = ", ".join(f"{k} long" for k in keys) + ", item_id long, cosine double, lcs_share double, answer_found boolean"
    source = docs.select(*[F.col(k).cast("long") for k in keys], F.lower(F.col("text").cast("string")))
    found = None
    for shared in _blocks(docs, benchmark, paraphrase):

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            space, items = shared.value
            for batch in batches:
                for first, best in _found(batch.column(batch.num_columns - 1), space, items, cosine, share, paraphrase):
                    of = pa.array([first + t for t, _ in best])
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(c).take(of) for c in range(len(keys))], pa.array(items.ids[[j for _, j in best]]),
                         *[pa.array([v[k] for v in best.values()]) for k in range(3)]],
                        names=[*keys, "item_id", "cosine", "lcs_share", "answer_found"])

        part = source.mapInArrow(search, fields)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], fields) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without leaks, all columns. Rows go through the search and on, so no copy of the texts is written."""
    rows = docs.select(*[F.col(f"`{c}`") for c in own_columns(docs)])
    for shared in _blocks(docs, benchmark, PARAPHRASE):

        def free(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            space, items = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, best in _found(batch.column(batch.num_columns - 1), space, items, COSINE, LCS, PARAPHRASE):
                    keep[[first + text for text, _ in best]] = False
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep))

        rows = rows.withColumn("_searched", F.lower(F.col("text").cast("string"))).mapInArrow(free, rows.schema)
    return rows
