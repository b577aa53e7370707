from functools import cache

import public_tokenizers
import pytest
from bazaarflow.llm import tokencount
from bazaarflow.llm.tokencount_query import op13_batch_token_counts
from tokenizers import Tokenizer

from .conftest import prose
from .test_tokens import HARD, WORD

LONG = ["7" * 300 + "ab" * 40 + "12. 3", "z" * 5000 + "." * 90 + "1 " * 50, "<|endoftext|>" * 20, "it's9't " * 30, "\x1c  a b\x85c"]


@cache
def word_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(WORD))


def tokens_of(text):
    return len(word_tokenizer().encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("span,remembered", [(1 << 20, 400_000), (7, 3)])
def test_counts_are_those_of_whole_texts(monkeypatch, span, remembered):
    monkeypatch.setattr(tokencount, "REMEMBERED", remembered)
    monkeypatch.setattr(tokencount.spans, "__defaults__", (span,))
    counter = tokencount.Counter(public_tokenizers.path(WORD), True)
    texts = [*HARD, *LONG]
    for _ in range(3):
        assert counter.count(texts) == [tokens_of(t) for t in texts]
        assert counter.count(texts[::-1]) == [tokens_of(t) for t in texts[::-1]]


def test_sentencepiece_and_kept_blanks():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert tokencount.Counter(path, True).count(HARD) == [len(model.encode(t)) for t in HARD]
    byte = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(byte)
    assert tokencount.Counter(byte, False).count(HARD) == [len(whole.encode(t, add_special_tokens=False).ids) for t in HARD]


def test_batches_are_balanced_by_bytes():
    texts = ["a" * n for n in (5, 9, 1, 40, 2, 2)] + ["é" * 6]
    assert [[len(t) for t in b] for b in tokencount.batches(texts, 12)] == [[5], [9, 1], [40], [2, 2], [6]]
    assert "".join(tokencount.spans("ab cd\nef gh", 3)) == "ab cd\nef gh"
    assert list(tokencount.spans("abcdefgh", 3)) == ["abcdefgh"]


def test_every_row_once_with_defined_results(frame, odd_rows, spark, folder):
    docs = frame(odd_rows)
    found = op13_batch_token_counts(spark, folder(documents=docs)).collect()
    expected = [(i, len((t or "").encode()), tokens_of(t), tokens_of(t) > 2048) for i, t in odd_rows]
    assert sorted(map(repr, ((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found))) == sorted(map(repr, expected))
    kept = tokencount.counted(docs.withColumn("n_tokens", docs.lang), public_tokenizers.path(WORD))
    assert kept.columns == ["doc_id", "lang", "source", "n_chars", "n_words", "score", "n_bytes", "n_tokens", "over_limit"]
    assert tokencount.counted(docs.limit(0), public_tokenizers.path(WORD)).count() == 0
