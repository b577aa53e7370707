import re
from collections import Counter

from bazaarflow.llm import quality
from bazaarflow.llm.quality_query import op10_decision_list

from .conftest import prose


def counted(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_brute_force(frame, odd_rows):
    rows = [*odd_rows, (10, "a b c a b c a b c"), (11, "a a a a"), (12, "x\nx\n \nx y\nx"), (13, "a b c d a b c")]
    found = quality.features(frame(rows)).collect()
    assert len(found) == len(rows)
    by = sorted(((r["text"] or "", tuple(r[c] for c in quality.COUNTS)) for r in found))
    assert by == sorted((t or "", counted(t)) for _, t in rows)


def labelled(frame, spark):
    rows = [(i, prose(i, 90) if i % 5 else prose(i, 90).replace(" ", "### ")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(400)] + [(None, 0, 0), (3, None, 1)],
                                   "doc_id long, quality int, toxic int")
    return frame(rows), labels


def test_learned_rules_reject_the_labelled_kind_only(frame, spark, folder):
    docs, labels = labelled(frame, spark)
    found = {r["doc_id"]: r for r in op10_decision_list(spark, folder(documents=docs, labels=labels)).collect()}
    assert len(found) == 400
    assert all(found[i]["kept"] == (i % 5 != 0) for i in found)
    assert all(not r["base_failed"] for r in found.values())


def test_expression_tries_rules_in_order(frame):
    one = quality.Condition("n_words", True, 2.0)
    two = quality.Condition("symbol_share", True, 0.0)
    rules = quality.DecisionList(((one,), (two,)))
    found = quality.features(frame([(1, "a b c #"), (2, "a #"), (3, "a b")])).select("doc_id", rules.rule().alias("rule"))
    assert {r["doc_id"]: r["rule"] for r in found.collect()} == {1: 1, 2: 2, 3: 0}
    assert str(rules) == "n_words > 2; symbol_share > 0"


def test_no_labels_and_no_rows(frame, spark, folder):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame([(1, prose(1, 60)), (2, "few words"), (3, None)])
    found = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in op10_decision_list(spark, folder(documents=docs, labels=none)).collect()}
    assert found == {1: (False, True), 2: (True, False), 3: (True, False)}
    assert op10_decision_list(spark, folder(documents=frame([]), labels=none)).count() == 0


def test_plan_has_no_python(frame):
    plan = quality.features(frame([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
