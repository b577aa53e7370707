import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from bazaarflow.llm import lmscore
from bazaarflow.llm.lmscore_query import op9_log_frequency_bloom
from pyspark.sql import functions as F

from .conftest import prose


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*[w for w in re.split("[\x20\x09-\x0d]+", lower) if w], None]


def learned(rows):
    one, two = Counter(), Counter()
    for doc_id, text in rows:
        if zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 != 2:
            own = tokens(text)
            one.update(own)
            two.update(zip([None, *own], own))
    return one, two


@pytest.mark.parametrize("head_rows", [1_000_000, 3])
def test_scores_equal_brute_force(frame, odd_rows, head_rows):
    rows = [*odd_rows, *[(20 + i, prose(i % 9, 30 + i)) for i in range(60)]]
    one, two = learned(rows)
    total, distinct = sum(one.values()), len(one)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    found = lmscore.score(frame(rows).select("doc_id", "text", "score"), ~held, head_rows=head_rows).collect()
    assert len(found) == len(rows)

    def middle(n):
        return (3 * 2 ** int(math.log2(n)) - 1) / 2 if n else 0

    expected, near = [], 0.0
    for doc_id, text in rows:
        own = tokens(text)
        base = sum(math.log10((one[t] + 1) / (total + distinct + 1)) for t in own)
        expected.append((doc_id or 0, len(own), sum(one[t] > 0 for t in own), total, round(base, 4)))
        near += sum(math.log10((min(middle(two[u, t]), middle(one[u])) + 4 * (middle(one[t]) + 1) / (total + distinct + 1))
                               / (middle(one[u]) + 4)) for u, t in zip([None, *own], own))
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found) == sorted(expected)
    # the filter errs seldom
    whole = sum(r["score"] for r in found)
    assert abs(whole - near) < 0.02 * abs(near)


def test_filter_never_undercounts():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    counts = np.random.default_rng(2).integers(1, 100, 5000)
    f = lmscore.CountFilter.of([(0, lmscore.filter_bits(keys, counts))], 0)
    found = f.count(keys)
    low = 2.0 ** np.floor(np.log2(counts))
    assert (found >= (3 * low - 1) / 2 - 1e-9).all() and (found == (3 * low - 1) / 2).mean() > 0.95
    assert (f.count(keys + np.uint64(1)) > 0).mean() < 0.05


def test_filters_too_large_to_broadcast_give_the_same_scores(frame, odd_rows):
    rows = [*odd_rows, *[(20 + i, prose(i % 9, 30 + i)) for i in range(60)]]
    rows += [(200 + i, " ".join(f"w{(i * 977 + j * j) % 9000}" for j in range(40_000))) for i in range(6)]
    docs = frame(rows).select("doc_id", "text").repartition(3)
    columns = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def result(**options):
        found = lmscore.score(docs, F.coalesce(F.col("doc_id"), F.lit(0)) % 7 != 2, segment_mb=1, **options)
        return sorted((tuple(r[c] if c != "base_score" else round(r[c], 4) for c in columns) for r in found.collect()), key=repr)

    near = result()
    far = result(broadcast_mb=0)
    assert len(near) == len(rows) and [r[:5] for r in far] == [r[:5] for r in near]
    assert [r[5] for r in far] == pytest.approx([r[5] for r in near], rel=1e-9)
    for i in (0, 3):  # a filter has its ten bits for each entry however many there are
        keys = np.random.default_rng(i).integers(0, 2**63, 20_000 * (i + 1)).astype(np.uint64)
        assert len(lmscore.filter_bits(keys, np.ones(len(keys)))) * 8 == lmscore.BITS * len(keys)


def test_parts_of_many_segments_give_the_same_scores(frame, spark, odd_rows, monkeypatch):
    # what texts ask grows with the parts: they follow the cores and the memory, not the number of segments
    assert lmscore._part_bits(12, 900 << 20, 12, 64) == lmscore._part_bits(17, 900 << 20, 12, 64) == 6
    assert lmscore._part_bits(15, 20 << 30, 12, 64) == 9 and lmscore._part_bits(0, 0, 12, 64) == 0
    keys = np.random.default_rng(3).integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2)
    segment = (keys >> np.uint64(61)).astype(int)
    filters = [(i, lmscore.filter_bits(keys[segment == i], np.arange(1, 1 + (segment == i).sum()))) for i in range(8)]
    whole = lmscore.CountFilter.of(filters, 3)
    for part in range(4):
        own = lmscore.CountFilter.of([(i & 1, f) for i, f in filters if i >> 1 == part], 1, 2)
        inside = keys[segment >> 1 == part]
        assert (own.levels(inside) == whole.levels(inside)).all() and (own.levels(inside) > 0).all()

    rows = [*odd_rows, *[(20 + i, prose(i % 9, 30 + i)) for i in range(60)]]
    rows += [(200 + i, " ".join(f"w{(i * 977 + j * j) % 9000}" for j in range(40_000))) for i in range(30)]
    docs = frame(rows).select("doc_id", "text").repartition(3)
    monkeypatch.setattr(lmscore, "_part_bits", lambda *given: 1)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    found = []
    for mb, n in ((256, "10000"), (0, "10000"), (0, "7")):  # in small batches a run asks more than once
        spark.conf.set(batch, n)
        scored = lmscore.score(docs, F.coalesce(F.col("doc_id"), F.lit(0)) % 7 != 2, segment_mb=1, broadcast_mb=mb).collect()
        found.append(sorted(((r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["score"], 6)) for r in scored)))
    spark.conf.unset(batch)
    assert len(found[0]) == len(rows) and found[0] == found[1] == found[2]


def test_no_training_rows_and_no_rows(frame, spark, folder):
    found = lmscore.score(frame([(1, "a b"), (2, None)]).select("doc_id", "text"), F.lit(False)).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)}
    far = lmscore.score(frame([(1, "a b"), (2, None)]).select("doc_id", "text"), F.lit(False), broadcast_mb=-1).collect()
    assert sorted((r["doc_id"], r["score"]) for r in far) == sorted((r["doc_id"], r["score"]) for r in found)
    assert op9_log_frequency_bloom(spark, folder(documents=frame([]))).count() == 0
