import math
import random

import numpy as np
from bazaarflow.llm import negatives
from bazaarflow.llm.negatives_query import op11_inverted_multi_index
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int, row string, score string, id string"


def brute(rows, k=5):
    taken = []
    for at, (vec_id, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x * 256) for x in v):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        taken.append((vec_id, [math.floor(x * 256) for x in v], label, at))
    out = []
    last = 1 << 63
    for vec_id, v, label, at in taken:
        if vec_id is None or vec_id % 100:
            continue
        score = lambda w: min(max(sum(a * b for a, b in zip(v, w)), -last), last - 1)  # noqa: B023, E731
        others = sorted((-score(w), last if i is None else i, n, y) for i, w, y, n in taken if n != at)
        for less, positive, *_ in [o for o in others if o[3] == label][:k]:
            fitting = [o for o in others if o[3] != label and 80 * -less <= 100 * -o[0] <= 100 * -less][:k]
            out += [(vec_id, positive, r, n, -less, -s) for r, (s, n, *_) in enumerate(fitting, 1)]
    return [(a, None if p == last else p, r, None if n == last else n, ps, ns) for a, p, r, n, ps, ns in out]


def mine(spark, folder, rows):
    df = spark.createDataFrame([(*r, "c", "c", "c") for r in rows], SCHEMA)
    return [tuple(r) for r in op11_inverted_multi_index(spark, folder(embeddings=df)).collect()]


def vectors(seed, n, dims=8, clusters=12):
    g = np.random.default_rng(seed)
    middle = g.normal(size=(clusters, dims))
    m = middle[g.integers(0, clusters, n)] + 0.4 * g.normal(size=(n, dims))
    return [[float(x) for x in v / np.linalg.norm(v)] for v in m]


def test_equals_brute_force(spark, folder, monkeypatch):
    monkeypatch.setattr(negatives, "PROBE_ROWS", 40)
    r = random.Random(3)
    rows = [(i, v, r.randint(0, 3)) for i, v in enumerate(vectors(1, 900))]
    rows += [(1000 + i, rows[5][1], i % 4) for i in range(120)]  # copies: ties by id, a full cell
    assert sorted(mine(spark, folder, rows)) == sorted(brute(rows))


def test_odd_rows(spark, folder):
    v = vectors(2, 40)
    rows = [(100 * (i % 7), v[i], i % 3) for i in range(30)]  # anchors with equal ids
    rows += [(None, v[30], 1), (None, v[0], None), (3, None, 1), (4, [], 1), (5, [None] * 8, 2), (6, [float("nan")] * 8, 2), (8, [float("inf")] * 8, 1),
             (9, [1e307] * 8, 1), (10, v[31][:3], 1), (11, v[31] + [2.0], 0), (700, [0.0] * 8, 5), (12, [0.0] * 8, 5), (800, [-x for x in v[3]], 1)]
    assert sorted(mine(spark, folder, rows), key=repr) == sorted(brute(rows), key=repr)
    assert mine(spark, folder, [(100, v[0], None)]) == []
    assert mine(spark, folder, [(100, v[0], 1)]) == []


def test_large_numbers_stay_exact(spark, folder):
    r = random.Random(9)
    rows = [(i, [r.uniform(-1, 1) * 10.0 ** r.choice([0, 6, 7, 8]) for _ in range(4)], i % 3) for i in range(120)]
    rows += [(900, [1e200] * 4, 1), (901, [-1e200] * 4, 1), (902, [1e20] * 4, 2)]
    assert sorted(mine(spark, folder, rows)) == sorted(brute(rows))


def test_heap_order_and_pruning(spark):
    rows = spark.createDataFrame([(i, v, i % 4) for i, v in enumerate(vectors(5, 3000, 4, 30))], "vec_id long, embedding array<double>, label int")
    taking = negatives.usable(rows, F.col("label"))
    index = negatives.fit(taking)
    negatives.build(taking, index)
    assert sum(index.sizes.values()) == 3000
    q = np.array(taking.first()["v"])
    order = list(index.order(q))
    assert sorted(c for *_, c in order) == sorted(index.sizes)
    assert all(a[0] >= b[0] for a, b in zip(order, order[1:]))
    scores = sorted((float(np.dot(q, r["v"])) for r in taking.select("v").collect()), reverse=True)
    needed = sum(high >= scores[5] for high, *_ in order)
    assert needed < len(order) / 2  # clustered rows: most cells are never read
