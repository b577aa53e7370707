import zlib

import numpy as np
import public_tokenizers
import pytest
from bazaarflow.llm import packing, records, tokens
from bazaarflow.llm.packing_query import op7_vector_best_fit
from bazaarflow.llm.records_query import op3_length_delimited_records
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .conftest import prose

HARD = ["", "  a", " a b\n c", "a\n b", "x  y", "Foo. Bar, BAZ!! é É ﬁ İ <|endoftext|> a<|endoftext|>.", "foo.. a,. 1. 2, b;  c \t d ",
        "don't we'll. it's, THE'S", " .", ". ", "A", "a.", "a\nb", "a.\nB c\n\nd e\n f", "\na b\n", "a \nb", " \nc", "x \ny",
        "x\n y", "ab\0 c", "q.\nr.\ns", " É.", "<|STARTOFTEXT|> <|startoftext|>", "ſ K Å. ΑΣ ΑΣ.", "é ́x", "日本語 テスト。", prose(5, 500)]
BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def ids_of(name, text):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("name,spaced", [(BYTE, True), (WORD, False)])
def test_pieces_have_the_ids_of_the_whole_text(name, spaced, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 40)  # forgetting happens, too
    encoder = tokens.Encoder(public_tokenizers.path(name), spaced)
    for _ in range(3):
        for at in range(0, len(HARD), 5):
            some = HARD[at : at + 5]
            flat, bounds = encoder.encode([*some, None], 2)
            assert [list(flat[i:j]) for i, j in zip(bounds, bounds[1:])] == [ids_of(name, t) for t in [*some, None]]


def test_records_round_trip(frame, odd_rows, spark, folder):
    docs = frame(odd_rows)
    found = sorted(op3_length_delimited_records(spark, folder(documents=docs)).collect(), key=lambda r: r["start"])
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, expected = 0, []
    for doc_id, text in order:
        ids = np.array(ids_of(WORD, text), "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found] == expected


def test_shuffled_reads_find_every_record(frame, spark):
    manifest = records.write(frame([(i, prose(i, 20)) for i in range(50)]), public_tokenizers.path(WORD))
    whole = {r["doc_id"]: bytes(r["ids"]) for r in records.read(manifest).collect()}
    mixed = [(r["doc_id"], bytes(r["ids"])) for r in records.shuffled(manifest, 3).collect()]
    assert dict(mixed) == whole and len(mixed) == 50
    assert [m[0] for m in mixed] != sorted(whole)


def test_broken_frames_are_noticed():
    import io

    good = records.frame(records.payload(7, b"\1\0\2\0", True))
    assert records.parsed(records.unframe(io.BytesIO(good).read)) == (7, b"\1\0\0\0\2\0\0\0")
    for at in (0, 9, 14, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(records.BrokenRecord):
            records.unframe(io.BytesIO(bytes(bad)).read)


def test_empty_table_of_records(frame, spark, folder):
    assert op3_length_delimited_records(spark, folder(documents=frame([]))).count() == 0


def test_packing_covers_every_id_once(frame, odd_rows, spark, folder):
    rows = [*odd_rows, *[(100 + i, prose(i, 3 + 7 * i % 300)) for i in range(150)]]
    found = op7_vector_best_fit(spark, folder(documents=frame(rows))).collect()
    pieces, places = {}, {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for of in places.values():
        at = 0
        for offset, length in sorted(of):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in found)
    assert len(places) <= 1.02 * -(-total // 1024) + 1
    by = {}
    for doc_id, text in rows:
        by.setdefault(doc_id, []).append(ids_of(BYTE, text))
    for doc_id, texts in by.items():
        got = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[doc_id])
        expected = []
        for ids in texts:
            first = (len(ids) - 1) % 1024 + 1
            cuts = [0, *range(first, len(ids) + 1, 1024)]
            expected += [(i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert got == sorted(expected)


def test_every_capacity_holds():
    lengths = np.array([5, 5, 5, 5, 9, 1, 1, 1, 10])
    bins, offsets, left = packing.place(lengths, 10, 2, 60.0, (1, 1, 1))
    for b in set(bins.tolist()):
        mine = lengths[bins == b]
        assert mine.sum() <= 10 and (len(mine) <= 2 and (mine**2).sum() <= 60 or len(mine) == 1)
        assert left[b] == 10 - mine.sum() or mine.sum() == 10


def test_packing_small_cells_and_no_rows(frame, spark, folder):
    pieces = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") % 40 + 1).alias("length"),
                                     F.lit("x").alias("offset"), F.lit("y").alias("note"))
    found = packing.pack(pieces, 300, capacity=64, cell_rows=50).collect()
    assert len(found) == 300 and {r["note"] for r in found} == {"y"}
    sums = {}
    for r in found:
        sums[r["sequence_id"]] = sums.get(r["sequence_id"], 0) + r["length"]
    assert max(sums.values()) <= 64 and len(sums) <= 1.1 * sum(sums.values()) / 64
    assert op7_vector_best_fit(spark, folder(documents=frame([]))).count() == 0
