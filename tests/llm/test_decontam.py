import pytest
from bazaarflow.llm import decontam
from bazaarflow.llm.decontam_query import op5_latent_semantic_leaks

from .conftest import prose

ITEMS = [prose(900 + i, 15 + 8 * i) for i in range(6)]


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([*[(i, t, "clash") for i, t in enumerate(ITEMS)], (50, None, ""), (51, "  ", "")],
                                 "item_id long, text string, doc_id string")


def planted():
    rows, truth = [], set()
    for i in range(120):
        text = prose(2000 + i, 150)
        if i % 10 == 0:
            item = i // 10 % 6
            words = text.split()
            middle = ITEMS[item] if i % 20 else ITEMS[item].upper()
            text = " ".join(words[:i]) + " " + middle + " " + " ".join(words[i:])
            truth.add((i + 100, item))
        rows.append((i + 100, text))
    return rows, truth


def test_planted_items_are_found_and_nothing_else(frame, odd_rows, benchmark, spark, folder):
    rows, truth = planted()
    found = op5_latent_semantic_leaks(spark, folder(documents=frame([*odd_rows, *rows]), benchmark=benchmark)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == truth
    assert all(r["lcs_share"] >= 0.8 for r in found)


def test_paraphrases_need_their_answer(frame, benchmark):
    words = ITEMS[5].split()
    noise = prose(3000, 60)
    start = len(words) * 3 // 4
    with_answer = " ".join(w if k % 4 or k >= start - 6 else "other" for k, w in enumerate(words))
    no_answer = " ".join(w if k % 3 else "other" for k, w in enumerate(words))
    rows = [(1, f"{noise} {with_answer} {noise}"), (2, f"{noise} {no_answer} {noise}"), *planted()[0]]
    found = {r["doc_id"]: r for r in decontam.leaks(frame(rows), benchmark).where("doc_id < 100").collect()}
    assert set(found) == {1} and found[1]["answer_found"] and found[1]["lcs_share"] < 1


def test_clean_keeps_all_else(frame, odd_rows, benchmark, spark):
    rows, truth = planted()
    docs = frame([*odd_rows, *rows])
    kept = decontam.clean(docs, benchmark)
    assert kept.count() == len(odd_rows) + len(rows) - len(truth)
    assert kept.columns == [c for c in docs.columns if c != "_row"]
    assert decontam.clean(frame([]), benchmark).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.clean(docs, none).count() == len(odd_rows) + len(rows)


def test_subsequence_and_sketch():
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(30):
        a, b = (r.integers(0, 6, r.integers(0, 30)).astype(np.uint64) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontam.lcs(a, b) == table[-1, -1]


def test_latent_space_equals_a_dense_decomposition(frame, spark):
    import numpy as np
    import pyarrow as pa
    from bazaarflow.llm import wordhash

    texts = [prose(i % 40, 60) for i in range(200)]
    items = ITEMS[:3]
    space = decontam.fit(frame(list(enumerate(texts))), items)
    v = space.vocabulary
    x = np.eye(v.size, dtype=np.float32)
    def runs(texts, passage):
        return [(passage(w)[place], column) for w in wordhash.words(pa.array(texts)) for place, column in [v.find(w.hashes)]]

    dense, rows = decontam.gram(v.weights, x, runs(texts, lambda w: decontam._passages(w, decontam.WINDOWS[1])))
    own, n = decontam.gram(v.weights, x, runs(items, lambda w: w.text))
    dense = dense + own * rows / n
    basis = np.where(v.weights[:, None] > 0, space.terms / np.maximum(v.weights[:, None], 1e-9), 0)
    values = np.linalg.eigvalsh(dense.astype(float))[::-1]
    k = min(decontam.RANK, basis.shape[1])
    assert np.trace(basis.T @ dense @ basis) > 0.97 * values[:k].sum()


def test_a_leak_in_a_third_of_the_rows_is_found_in_all(frame, benchmark):
    rows = [(i + 100, f"{prose(4000 + i, 40)} {ITEMS[4]} {prose(5000 + i, 40)}" if i % 3 == 0 else prose(4000 + i, 120)) for i in range(120)]
    rows.append((500, f"{prose(6000, 60)} {ITEMS[2]} {prose(6001, 30)}"))
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(frame(rows), benchmark).collect()}
    assert found == {(i + 100, 4) for i in range(0, 120, 3)} | {(500, 2)}


def test_leaks_equal_brute_force_where_the_latent_space_finds_none(frame, spark):
    """No window has a cosine of 2; the look-up alone finds the leaks of all windows of fitting length."""
    import numpy as np
    import pyarrow as pa
    from bazaarflow.llm import wordhash

    items = [prose(10_000 + i, 16 + i % 44) for i in range(0, 176, 3)]
    rows = []
    for i in range(len(items)):
        words = items[i].split()
        middle = [w if i % 2 or k % 4 or k >= len(words) * 3 // 4 - 6 else "other" for k, w in enumerate(words)]
        rows.append((i, " ".join([prose(20_000 + i, i % 150), *middle, prose(30_000 + i, 80)])))
    own = [next(iter(wordhash.words(pa.array([t.lower()])))).hashes for t in items]
    answers = [next(iter(wordhash.words(pa.array([decontam.answer(t.lower())])))).hashes for t in items]
    expected = set()
    for doc_id, text in rows:
        words = next(iter(wordhash.words(pa.array([text.lower()]))))
        for j, item in enumerate(own):
            size = next(s for s in decontam.WINDOWS if s >= 2 * len(item))
            for _, begin, end in zip(*decontam._windows(words, size)):
                window = words.hashes[begin:end]
                if np.isin(item, window).sum() < 0.6 * len(item):
                    continue
                part = decontam.lcs(item, window) / len(item)
                if part >= 0.8 or part >= 0.6 and decontam.lcs(answers[j], window) == len(answers[j]):
                    expected.add((doc_id, j))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(frame(rows), benchmark, cosine=2.0).collect()}
    assert {(i, i) for i in range(1, len(items), 2)} <= expected and len(expected) > len(items) // 2
    assert found == expected


def test_windows_are_summed_from_blocks_in_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from bazaarflow.llm import wordhash

    r = np.random.default_rng(4)
    names = [f"w{i}" for i in range(500)]
    texts = [" ".join(r.choice(names, n)) for n in (0, 1, 15, 16, 17, 31, 33, 47, 48, 100, 130, 60_000)]
    vocabulary = decontam.vocabulary_of(next(wordhash.words(pa.array([" ".join(names[::2])]))).hashes)
    space = decontam.Space(vocabulary, r.standard_normal((vocabulary.size, 80)).astype(np.float32))
    items = decontam.items_of(space, list(range(5)), [" ".join(r.choice(names[::2], 20)) for _ in range(5)])
    (words,) = wordhash.words(pa.array(texts))
    tracemalloc.start()
    found = list(decontam.candidates(space, items, words, 0.3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) > 50 and peak < 12 << 20  # the vectors of all known words would take 19 MB
    for text, begin, end, item, near in found:
        assert words.bounds[text] <= begin < end <= words.bounds[text + 1]
        vector = space.terms[vocabulary.find(words.hashes[begin:end])[1]].sum(0, dtype=np.float64)
        assert abs(vector @ items.vectors[item] / np.linalg.norm(vector) - near) < 1e-5


def test_clean_writes_no_copy_of_the_texts(frame, benchmark):
    docs = frame([(1, prose(1, 90)), (2, prose(2, 90))])
    plan = decontam.clean(docs, benchmark)._jdf.queryExecution().executedPlan().toString()
    assert "numbered" not in plan and "bazaarflow_" not in plan and "Exchange" not in plan


def test_clean_is_leaks_in_several_blocks(frame, benchmark, monkeypatch):
    texts = [r["text"] for r in benchmark.collect()]
    docs = frame([(i, f"{prose(500 + i, 40)} {t} {prose(600 + i, 40)}" if t and i % 2 else prose(700 + i, 90)) for i, t in enumerate(texts)])
    monkeypatch.setattr(decontam, "BLOCK", 2)
    leaked = {r["doc_id"] for r in decontam.leaks(docs, benchmark).collect()}
    kept = [r["doc_id"] for r in decontam.clean(docs, benchmark).collect()]
    assert leaked and sorted(kept) == sorted(set(range(len(texts))) - leaked)
