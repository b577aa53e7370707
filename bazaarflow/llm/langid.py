"""Language identification by interpolated Kneser-Ney character models.

A text's words are its runs of letters, lower-cased; a model gives the probability of each letter, and of the word's end,
after the ``ORDER - 1`` before it in the word. Texts are compared by cross-entropy per predicted character. Each distinct
word is scored once per worker.

Learning: at most ``rows_per_lang`` labelled texts of a language, those of the lowest id hash, whole; every fifth of them is
set aside for calibration. That number bounds the models, which are broadcast as sorted arrays of n-gram hashes. Counts are
made by Spark, and so are the discounted probabilities.

Calibration: the temperature that makes the softmax of negative cross-entropies most probable for the labels of the texts
set aside, and for each language the cross-entropy beyond which a text is rejected.

Defined results: a null text, or one without a letter, is ``und`` with score 0, rejected; ties go to the language whose
name is first; a row without label, or with a null text, is not learned from; without any labelled text all is ``und``;
equal rows get equal results; columns that predict() adds replace those of the same name.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarflow.llm.common import crc32_of_id, materialise, own_columns

ORDER = 5
LETTERS = re.compile(r"[^\W\d_]+")
START, END = "^", "$"
#: Words whose scores a worker remembers; it starts anew beyond them.
REMEMBERED = 400_000
#: Deviations above the mean cross-entropy of a language's own texts beyond which a text is rejected.
REJECT = 4.0


def hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all windows of ``size`` code points."""
    out = np.full(max(0, len(symbols) - size + 1), size, np.uint64)
    for j in range(size):
        out = (out ^ symbols[j : j + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _symbols(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class SortedTable:
    """Values by n-gram, held as sorted hashes."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[bytes, bytes]]) -> SortedTable:
        keys = np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(k, np.uint64) for k, _ in parts]])
        values = np.concatenate([np.empty(0, np.float32), *[np.frombuffer(v, np.float32) for _, v in parts]])
        order = np.argsort(keys, kind="stable")
        return cls(keys[order], values[order])

    def get(self, keys: np.ndarray, missing: float) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), missing, np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], np.float32(missing))


@dataclass
class Models:
    """Of every language, by order: what an n-gram gets itself, and the weight that its context leaves to lower orders."""

    langs: list[str]
    grams: list[list[SortedTable]]
    contexts: list[list[SortedTable]]
    floor: float = 1e-5
    temperature: float = 1.0
    limits: list[float] = field(default_factory=list)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word (end included), by language."""
        pad = START * (ORDER - 1)
        padded = [pad + w + END for w in words]
        symbols = _symbols("".join(padded))
        lengths = np.fromiter(map(len, padded), np.int64, len(padded))
        begins = np.cumsum(lengths) - lengths
        # every predicted symbol's place
        count = lengths - (ORDER - 1)
        ahead = np.cumsum(count) - count
        place = np.repeat(begins + ORDER - 1 - ahead, count) + np.arange(count.sum())
        by_size = [hashes(symbols, k) for k in range(1, ORDER + 1)]
        out = np.empty((len(words), len(self.langs)), np.float32)
        for i in range(len(self.langs)):
            p = np.full(len(place), self.floor, np.float32)
            for k in range(1, ORDER + 1):
                own = self.grams[i][k - 1].get(by_size[k - 1][place - k + 1], 0)
                if k == 1:
                    p = own + p
                else:
                    p = own + self.contexts[i][k - 1].get(by_size[k - 2][place - k + 1], 1) * p
            out[:, i] = np.add.reduceat(np.log(p), ahead)
        return out


class Scorer:
    def __init__(self, models: Models):
        self.models = models
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = defaultdict(itertools.count().__next__)
        self.known = 0
        self.scores = np.empty((0, len(self.models.langs)), np.float32)
        self.lengths = np.empty(0, np.int32)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy by text and language, and the symbols of each text."""
        if len(self.index) > REMEMBERED:
            self.forget()
        ids, counts = [], []
        for text in texts:
            found = list(map(self.index.__getitem__, LETTERS.findall((text or "").lower())))
            ids.append(np.array(found, np.int64))
            counts.append(len(found))
        new = list(itertools.islice(self.index, self.known, None))
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            self.scores = np.concatenate([self.scores, self.models.word_scores(some)])
            self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, some), np.int32, len(some)) + 1])
        self.known = len(self.index)
        total = np.zeros((len(texts), len(self.models.langs)))
        n = np.zeros(len(texts), np.int64)
        for row, found in enumerate(ids):
            if len(found):
                total[row] = self.scores[found].sum(0, dtype=np.float64)
                n[row] = self.lengths[found].sum()
        return -total / np.maximum(n, 1)[:, None], n


def sampled(docs: DataFrame, usable: Column, rows_per_lang: int) -> DataFrame:
    """Rows (doc_id, lang, text, held): at most ``rows_per_lang`` of each language."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), "doc_id"))
    # languages with many rows are thinned by the hash first, to about twice what is wanted
    counts = F.broadcast(rows.groupBy(F.col("lang").alias("_of")).agg(F.count("*").alias("_n")))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    thin = rows.select("doc_id", "lang").join(counts, F.col("lang") == F.col("_of")) \
        .where(part * F.col("_n") <= (2 * rows_per_lang + 1000) * (1 << 20)).select("doc_id", "lang")
    ids = thin.withColumn("_place", place).where(F.col("_place") <= rows_per_lang)
    ids = ids.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), (F.col("_place") % 5 == 0).alias("held")).distinct()
    # the sample has a bounded number of rows
    return rows.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang"))) \
        .select("doc_id", "lang", "text", "held")


def _ngrams(sample: DataFrame) -> DataFrame:
    """Counted n-grams (lang, gram, n) of the highest order."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words[lang].update(LETTERS.findall(text.lower()))
            for lang, found in words.items():
                grams: Counter = Counter()
                for word, n in found.items():
                    padded = START * (ORDER - 1) + word + END
                    for i in range(len(word) + 1):
                        grams[padded[i : i + ORDER]] += n
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(list(grams)), pa.array(
                    list(grams.values()), pa.int64())], names=["lang", "gram", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes the n-grams of a table where they lie, so that the driver gets twelve bytes for each and no strings."""
    for batch in batches:
        for (lang, k, own), part in batch.to_pandas().groupby(["lang", "k", "own"]):
            size = k if own else k - 1
            symbols = _symbols("".join(part["gram"])).reshape(-1, size)
            keys = hashes(symbols.ravel(), size)[::size]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([k], pa.int32()), pa.array([bool(own)]), pa.array([keys.tobytes()], pa.binary()),
                 pa.array([part["value"].to_numpy(np.float32).tobytes()], pa.binary())],
                names=["lang", "k", "own", "keys", "values"])


def train(sample: DataFrame) -> Models:
    """Models of the sampled texts that are not set aside."""
    level = materialise(_ngrams(sample.where("not held")), "ngrams")
    levels = {ORDER: level}
    for k in range(ORDER - 1, 0, -1):
        # lower orders count in how many ways an n-gram is continued to the left
        levels[k] = levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
    rows = []
    for k, df in levels.items():
        discount = df.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("_one"), F.count_if(F.col("n") == 2).alias("_two")) \
            .select("lang", F.coalesce(F.try_divide(F.col("_one"), F.col("_one") + 2 * F.col("_two")), F.lit(0.75)).alias("_d"))
        context = F.substring("gram", 1, k - 1).alias("context")
        after = df.groupBy("lang", context).agg(F.sum("n").alias("_all"), F.count("*").alias("_kinds")).join(discount, "lang")
        own = df.withColumn("context", context).join(after, ["lang", "context"]).select(
            "lang", F.lit(k).alias("k"), F.lit(True).alias("own"), "gram",
            (F.greatest(F.col("n") - F.col("_d"), F.lit(0)) / F.col("_all")).alias("value"))
        rest = after.select("lang", F.lit(k).alias("k"), F.lit(False).alias("own"), F.col("context").alias("gram"),
                            (F.col("_d") * F.col("_kinds") / F.col("_all")).alias("value"))
        rows += [own, rest] if k > 1 else [own]
    table = rows[0]
    for more in rows[1:]:
        table = table.unionByName(more)
    found: dict = defaultdict(list)
    # bounded by the sample
    packed = table.mapInArrow(_packed, "lang string, k int, own boolean, keys binary, values binary")
    for row in packed.collect():
        found[row["lang"], row["k"], row["own"]].append((row["keys"], row["values"]))
    langs = sorted({lang for lang, _, _ in found})
    made = [[[SortedTable.of(found[lang, k, own]) for k in range(1, ORDER + 1)] for lang in langs] for own in (True, False)]
    return Models(langs, *made)


def _entropies(shared):
    langs = shared.value.langs

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                entropy, n = scorer.entropies(some.column(some.num_columns - 1).to_pylist())
                lists = pa.FixedSizeListArray.from_arrays(pa.array(entropy.ravel()), len(langs)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], lists, pa.array(n)],
                                                 names=[*some.schema.names[:-1], "_entropies", "_n"])

    return score


def calibrate(models: Models, sample: DataFrame) -> Models:
    """Sets the temperature and the limits by the texts set aside."""
    shared = sample.sparkSession.sparkContext.broadcast(models)
    held = sample.where("held").select("lang", "text").mapInArrow(
        _entropies(shared), "lang string, _entropies array<double>, _n long").where("_n > 0")
    # at most a fifth of the sample's rows, a few numbers each
    rows = [(models.langs.index(r["lang"]), r["_entropies"]) for r in held.collect() if r["lang"] in models.langs]
    models.limits = [float("inf")] * len(models.langs)
    if not rows:
        return models
    own, entropy = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])

    def loss(t: float) -> float:
        z = -t * entropy
        top = z.max(1)
        return float((np.log(np.exp(z - top[:, None]).sum(1)) + top - z[np.arange(len(own)), own]).mean())

    models.temperature = min((2.0**i for i in range(-2, 9)), key=loss)
    for i in range(len(models.langs)):
        mine = entropy[own == i, i]
        if len(mine):
            models.limits[i] = float(mine.mean() + REJECT * max(mine.std(), 0.02))
    return models


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """Adds lang_pred, score, cross_entropy and rejected to rows (doc_id, text)."""
    kept = own_columns(docs, ("text", "lang_pred", "score", "cross_entropy", "rejected"))
    if not models.langs:
        return docs.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(models)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    scored = docs.select(*kept, "text").mapInArrow(_entropies(shared), f"{fields}, _entropies array<double>, _n long")
    low = F.array_min("_entropies")
    best = F.array_position("_entropies", low).cast("int")
    langs, limits = F.array(*map(F.lit, models.langs)), F.array(*[F.lit(float(x)) for x in models.limits])
    none = F.col("_n") == 0
    weight = F.aggregate("_entropies", F.lit(0.0), lambda total, x: total + F.exp(models.temperature * (low - x)))
    return scored.select(*kept, F.when(none, "und").otherwise(F.element_at(langs, best)).alias("lang_pred"),
                         F.when(none, 0.0).otherwise(1 / weight).alias("score"), F.when(~none, low).alias("cross_entropy"),
                         (none | (low > F.element_at(limits, best))).alias("rejected"))


def identify(docs: DataFrame, held_out: Column | None = None, rows_per_lang: int = 2000) -> DataFrame:
    """Learns from the rows with a ``lang`` that are not held out, and predicts all. Adds ``held_out``."""
    held_out = crc32_of_id(F.col("doc_id")) % 5 == 0 if held_out is None else held_out
    sample = materialise(sampled(docs.select("doc_id", "lang", "text"), ~held_out, rows_per_lang), "sample")
    models = calibrate(train(sample), sample)
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), models)
