"""Token counts of whole texts, without the ids.

Texts come to a task in Arrow batches. Each is cut at safe boundaries, first into spans of about ``SPAN`` characters, so that
a very long text is never a list of words at once, then into its pieces between blanks. A safe boundary is one across
which the tokenizer never joins anything: a blank, where blanks are dropped before the model, and the place between two
digits, each of which is a token's beginning and end of its own. What is not known yet is encoded by the library in batches
of about ``BATCH_BYTES``, long pieces and short ones alike, and only the number of ids is kept. A worker remembers the
counts of short pieces, in two generations, so that its memory is bounded however many different ones there are.

For vocabularies that keep blanks (``blanks_dropped=False``) and for SentencePiece models whole texts are encoded, in batches
of the same bytes.

Defined results: a null text counts as an empty one, with 0 bytes and 0 tokens; strings of special tokens inside a text
are what the library makes of them by default; no token is added, nothing is cut off; repeated rows stay, each with its count;
an empty table gives none; columns n_bytes, n_tokens and over_limit are replaced, ``text`` and columns that begin with an
underscore go, all others stay.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarflow.llm.common import own_columns

#: Characters of a text that are taken at a time, UTF-8 bytes that are encoded at a time, and remembered pieces of a generation.
SPAN, BATCH_BYTES, REMEMBERED = 1 << 20, 1 << 18, 400_000
#: Longer pieces are not remembered.
LONG_PIECE = 64
LIMIT = 2048
_DIGITS = re.compile("(?<=[0-9])(?=[0-9])")
_COUNTERS: dict[tuple[str, bool], Counter] = {}


def spans(text: str, size: int = SPAN) -> Iterator[str]:
    """The text in runs that end before a blank, about ``size`` characters each; a run without a blank stays whole."""
    begin = 0
    while len(text) - begin > size:
        ends = [at for at in (text.find(" ", begin + size), text.find("\n", begin + size)) if at >= 0]
        if not ends:
            break
        yield text[begin : min(ends)]
        begin = min(ends)
    yield text[begin:]


def batches(texts: Iterable[str], size: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Lists of texts of about ``size`` bytes together; a longer text is alone."""
    some, total = [], 0
    for text in texts:
        n = len(text) if text.isascii() else len(text.encode())
        if some and total + n > size:
            yield some
            some, total = [], 0
        some.append(text)
        total += n
    if some:
        yield some


class Counter:
    def __init__(self, path: str, blanks_dropped: bool):
        self.cut = blanks_dropped and not path.endswith(".model")
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: map(len, model.encode(texts, num_threads=1))
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_padding()
            model.no_truncation()
            self._encode = lambda texts: map(len, model.encode_batch_fast(texts, add_special_tokens=False))
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def lengths(self, texts: Iterable[str]) -> list[int]:
        """The numbers of ids of texts as they are."""
        return [n for some in batches(texts) for n in self._encode(some)]

    def _learn(self, pieces: list[str]) -> None:
        """Counts pieces that the young generation lacks. A letter before a mark never joins with it."""
        new = {p: p[:-1] if p[-1:] in tuple(".,;:!?") and p[-2:-1].isalpha() else p for p in pieces if p not in self.old}
        self.young.update((p, self.old[p]) for p in pieces if p in self.old)
        stems = list(dict.fromkeys(new.values()))
        found = dict(zip(stems, self.lengths(stems), strict=True))
        self.young.update((p, found[s] + (s is not p and len(s) < len(p))) for p, s in new.items())

    def count(self, texts: list[str]) -> list[int]:
        """The numbers of ids of whole texts."""
        if not self.cut:
            return self.lengths(texts)
        totals = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            for span in spans(text):
                held.append((i, span.replace("\n", " ").split(" ")))
                size += len(span)
                if size >= SPAN:
                    self._add(held, totals)
                    held, size = [], 0
        self._add(held, totals)
        return totals

    def _add(self, held: list[tuple[int, list[str]]], totals: list[int]) -> None:
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        wanted = set().union(*(pieces for _, pieces in held)) - self.young.keys()
        long = {p for p in wanted if len(p) > LONG_PIECE}
        self._learn(list(wanted - long))
        parts = [(p, part) for p in long for part in _DIGITS.split(p)]
        counts = dict.fromkeys(long, 0)
        for (p, _), n in zip(parts, self.lengths(part for _, part in parts), strict=True):
            counts[p] += n
        young = self.young
        for i, pieces in held:
            totals[i] += sum([young[p] if len(p) <= LONG_PIECE else counts[p] for p in pieces] if long else map(young.__getitem__, pieces))


def counter(path: str, blanks_dropped: bool) -> Counter:
    """The worker's counter of this vocabulary."""
    if (path, blanks_dropped) not in _COUNTERS:
        _COUNTERS[path, blanks_dropped] = Counter(path, blanks_dropped)
    return _COUNTERS[path, blanks_dropped]


def counted(docs: DataFrame, tokenizer: str, *, blanks_dropped: bool = True, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs`` without ``text``, with n_bytes, n_tokens and over_limit (more than ``limit`` tokens)."""
    columns = own_columns(docs, ("text", "n_bytes", "n_tokens", "over_limit"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    kept = rows.drop("_text")
    schema = T.StructType([*kept.schema.fields, T.StructField("n_tokens", T.LongType(), False)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer, blanks_dropped)
        for batch in parts:
            n = pa.array(c.count(batch.column(batch.num_columns - 1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*batch.schema.names[:-1], "n_tokens"])

    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
