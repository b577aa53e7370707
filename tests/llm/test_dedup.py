import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from bazaarflow.llm import components, linedup, neardup
from bazaarflow.llm.common import numbered
from bazaarflow.llm.linedup_query import op6_fuzzy_lines
from bazaarflow.llm.neardup_query import op8_order_minhash

from .conftest import prose


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return [find(i) for i in range(n)]


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(2000, 2001), (2001, 2002), (2002, 2000), (5, 5), (2001, 2000)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1400)}, **{i: 2000 for i in range(2000, 2003)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def kmers(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]
    times, out = Counter(), []
    for s in (tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)) if words):
        out.append((s, times[s]))
        times[s] += 1
    return out


def ordered(a, b):
    place = {x: i for i, x in enumerate(b)}
    ends = []
    for x in (place[k] for k in a if k in place):
        i = bisect_left(ends, x)
        ends[i : i + 1] = [x]
    return len(ends) / (len(a) + len(b) - len(ends)) if a and b else 0.0


def edited(text, share, seed):
    r = random.Random(seed)
    words = text.split(" ")
    for i in range(len(words)):
        if r.random() < share:
            words[i] = "new" + str(r.random())[2:8]
    return " ".join(words)


def near_rows():
    base, other = prose(50, 200), prose(51, 150)
    rows = [(100 + i, edited(base, 0.03 * (i % 4), i)) for i in range(120)]  # near, nearer and not near enough
    rows += [(300 + i, edited(other, 0.01, i)) for i in range(20)]
    return rows + [(400 + i, prose(400 + i, 60)) for i in range(60)]


def test_classes_equal_brute_force(frame, odd_rows, spark, folder):
    rows = [*odd_rows, *near_rows()]
    sets = [kmers(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] != [] or ordered(sets[i], sets[j]) >= 0.8]
    group = defaultdict(list)
    for i, r in enumerate(roots(len(rows), links)):
        group[r].append(rows[i][0])
    expected = sorted(((doc, min((x for x in ids if x is not None), default=None), len(ids)) for ids in group.values() for doc in ids), key=str)
    found = op8_order_minhash(spark, folder(documents=frame(rows))).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in found), key=str) == expected
    assert sum(r["kept"] for r in found) == len(group)


def test_tiles_find_links_across_components():
    base = prose(60, 100)
    texts = [edited(base, 0.02, i) for i in range(40)]
    import numpy as np
    import pyarrow as pa
    from bazaarflow.llm import wordhash

    own = [p for w in wordhash.words(pa.array(texts)) for k, n in [neardup.labelled(w)] for p in np.split(k, np.cumsum(n)[:-1])]
    found = neardup.joining(own, list(range(40)), list(range(20)), list(range(40)), 0.8)
    wanted = [(i, j) for i in range(20) for j in range(40) if i != j and ordered(kmers(texts[i]), kmers(texts[j])) >= 0.8]
    assert roots(40, found) == roots(40, wanted) and len(found) < 40


def test_similarity_respects_order():
    import numpy as np

    a = np.arange(100, dtype=np.uint64)
    assert neardup.similarity(a, a) == 1.0
    assert neardup.similarity(a, np.concatenate([a[50:], a[:50]])) == 0.0
    assert abs(neardup.similarity(a, a[10:]) - 0.9) < 1e-9


def test_deduplicated_keeps_columns(frame, spark):
    docs = frame(near_rows())
    found = neardup.deduplicated(docs)
    assert found.columns == [c for c in docs.columns if c != "_row"]
    assert neardup.deduplicated(frame([])).count() == 0
    assert neardup.deduplicated(frame([(1, None), (2, None), (3, ""), (4, "")])).count() == 4


def line_result(rows, threshold=0.8):
    """What stays of each text, by row; rows in the order of the operator."""
    lines = [(r, k, x) for r, (_, t) in enumerate(rows) if t is not None for k, x in enumerate(t.split("\n")) if re.search("[^\x20\x09-\x0d]", x)]
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, r))
    lines.sort(key=lambda x: (order.index(x[0]), x[1]))
    first = {}
    for r, k, x in lines:
        first.setdefault(x, (r, k))
    texts = list(first)

    def shingles(x):
        x = x.lower()
        return {x[at : at + 12] for at in range(max(1, len(x) - 11))}

    sets = [shingles(x) for x in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
    keep = {first[texts[i]] for i, r in enumerate(roots(len(texts), links)) if r == i}
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (r, k) in keep) for r, (_, t) in enumerate(rows)]


def test_lines_equal_brute_force(frame, odd_rows, spark, folder):
    base = prose(70, 90, ".\n")
    rows = [*odd_rows, (20, base), (21, edited(base, 0.05, 1)), (22, base.upper()), (23, "one\n\none\nOne\nof\n" + base), (24, "x" * 5000),
            (25, "𝔘𝔫𝔦 ßtraße und mehr\n𝔘𝔫𝔦 ßtraße und mehr!")]
    docs = frame(rows).coalesce(1)
    found = op6_fuzzy_lines(spark, folder(documents=docs)).collect()
    expected = line_result(rows)
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=str) == sorted(((i, t) for (i, _), t in zip(rows, expected)), key=str)


def test_lines_keep_columns_and_count(frame):
    docs = frame([(1, "a b c d e f g h\nsame line of text"), (2, "same line of text\nsame line of texT\nother"), (3, None)]).withColumnRenamed("score", "n_removed")
    found = {r["doc_id"]: r for r in linedup.deduplicated(docs).collect()}
    assert [(found[i]["text"], found[i]["n_lines"], found[i]["n_removed"]) for i in (1, 2, 3)] == [
        ("a b c d e f g h\nsame line of text", 2, 0), ("other", 3, 2), (None, 0, 0)]
    assert found[1]["n_words"] == "clash"
    assert linedup.deduplicated(frame([])).count() == 0


def test_line_plans_have_no_python(frame):
    rows = numbered(frame([(1, "a\nb")]), "_row")
    first = linedup.firsts(rows)
    plan = linedup.signatures(linedup.read_lines(rows, first))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_lines_that_differ_inside_a_long_word_stay(frame):
    ways = ["https://www." + "abcdefghijklm"[i:] + "/" + "qrstuvwxyz" * (i + 1) for i in range(3)]
    han = ["\u4e00" * 12 + "".join(chr(0x4E01 + 40 * i + k) for k in range(30)) for i in range(3)]
    keys = ["some words and then a key=0123456789" + c * 9 + "0a1b2c3d4e5f" for c in "fgh"]
    same = "/a/long/path/" + "".join(chr(97 + i * 7 % 26) for i in range(80))
    wide = "\U0001d518\U0001d52b" * 3 + "".join(chr(0x1D538 + k) for k in range(20, 50))
    rows = [(i, "\n".join(x)) for i, x in enumerate(zip(ways, han, keys))] + [(10, same), (11, same + "x"), (12, wide), (13, "0" + wide)]
    found = {r["doc_id"]: r["text"] for r in linedup.deduplicated(frame(rows)).collect()}
    assert found == {**dict(rows), 11: "", 13: ""}


def test_lines_that_share_a_long_link_stay(frame):
    url = " https://example.org/" + "".join(chr(97 + i * i * 7 % 26) for i in range(130))
    rows = [(1, "The cat sat quietly on the warm mat all day see" + url), (2, "Rivers flood in spring when snow melts fast see" + url)]
    found = {r["doc_id"]: r["text"] for r in linedup.deduplicated(frame(rows)).collect()}
    assert found == dict(rows)


def test_pieces_of_a_line_give_the_values_of_all_its_shingles(spark):
    chars = "abc é一\U0001d518İZ-" + "".join(chr(0x100 + i * i % 3000) for i in range(300))
    sizes = sorted({n + d for n in (1, 12, 24, 35, 36, 48, 59, 72, 300) for d in (-1, 0, 1)} - {0})
    lines = spark.createDataFrame([(n, n, (chars * 2)[n : 2 * n]) for n in sizes], "_row long, _line long, line string")
    exploded = lines.select("_line", F.explode(linedup.shingles(F.col("line"))).alias("x"))
    values = {r[0]: r[1:] for r in exploded.groupBy("_line").agg(
        *[F.min(F.col("x").bitwiseXOR(F.lit(c))) for c in linedup._constants(linedup.VALUES)]).collect()}
    found = {r["node"]: r["marks0"] | r["marks1"] << 63 for r in linedup.signatures(lines).collect()}
    assert found == {n: sum((v & 127) << 7 * i for i, v in enumerate(row)) for n, row in values.items()}


def test_lines_of_a_bucket_meet_by_their_marks_alone(spark):
    r = random.Random(5)
    base = [r.randrange(128) for _ in range(linedup.VALUES)]
    marks = [[m if r.random() < 0.6 else r.randrange(128) for m in base] for _ in range(60)]
    packed = [[sum(m << 7 * i for i, m in enumerate(row[at : at + 9])) for at in (0, 9)] for row in marks]
    signed = spark.createDataFrame([(n, *p) for n, p in enumerate(packed)], "node long, marks0 long, marks1 long")
    # the last bucket has two lines only, which were compared before
    rows = [(b, n, n // 3, n >= 12) for b in (1, 2) for n in range(60) if n % b == 0] + [(3, 0, 0, False), (3, 59, 19, True)]
    mixed = spark.createDataFrame(rows, "bucket long, node long, part long, odd boolean")
    found = linedup.across(mixed, signed)
    agreeing = {(u, v) for u in range(60) for v in range(u + 1, 60) if v >= 12 and u // 3 != v // 3
                and sum(a == b for a, b in zip(marks[u], marks[v])) >= linedup.AGREEING}
    assert sorted(map(tuple, found.collect())) == sorted(agreeing) and 50 < len(agreeing) < 1500


def test_bits_deny_no_link_and_no_pair_far_below(spark):
    base = prose(90, 60)
    lines = [edited(base, 0.015 * (i % 8), 900 + i) for i in range(60)]
    sets = [{x.lower()[i : i + linedup.SHINGLE] for i in range(len(x) - linedup.SHINGLE + 1)} for x in lines]
    docs = spark.createDataFrame(list(enumerate(lines)), "_line long, line string")
    sketches = linedup.sketched(docs)
    assert {r["node"]: r["size"] for r in sketches.select("node", "size").collect()} == {i: len(s) for i, s in enumerate(sets)}
    # all lines are one bucket, and agree in all marks
    mixed = spark.createDataFrame([(1, i, i, i > 0) for i in range(60)], "bucket long, node long, part long, odd boolean")
    signed = spark.createDataFrame([(i, 0, 0) for i in range(60)], "node long, marks0 long, marks1 long")
    found = {(r["u"], r["v"]) for r in linedup.across(mixed, signed, lambda nodes: sketches.join(nodes, "node")).collect()}
    shares = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in range(60) for i in range(j)}
    links = {p for p, s in shares.items() if s >= 0.8}
    assert links and links <= found and min(shares[p] for p in found) > 0.7 and sum(s < 0.7 for s in shares.values()) > 300


def test_pairs_across_components_are_taken_once_by_a_short_condition(spark):
    # node n is in the buckets 10, 11 and 12, but for a few that miss the first; all marks and bits agree
    buckets = {n: [b for b in (10, 11, 12) if not (b == 10 and n % 5 == 0)] for n in range(20)}
    signed = spark.createDataFrame([(n, b, 0, 0) for n, b in buckets.items()], "node long, buckets array<long>, marks0 long, marks1 long")
    mixed = spark.createDataFrame([(b, n, n // 2, n >= 2) for n in buckets for b in buckets[n]], "bucket long, node long, part long, odd boolean")
    lines = spark.createDataFrame([(n, "A line of more than twelve characters, é") for n in buckets], "_line long, line string")
    found = linedup.across(mixed, signed, lambda nodes: linedup.sketched(lines).join(nodes, "node"))
    pairs = {(u, v) for v in buckets for u in range(v) if u // 2 != v // 2}
    assert sorted(map(tuple, found.collect())) == sorted(pairs)

    # 32 words named several times over make more code than is compiled, and the bucket hands on a pair once only
    plan = found._jdf.queryExecution().optimizedPlan()
    join = next(x for x in plan.toString().split("\n") if "Join" in x)
    assert join.count("bit_count") <= 3 and "array_intersect" in join
    inner = plan.children().head()
    while "Join" not in inner.nodeName():
        inner = inner.children().head()
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, inner).count()
    assert rows == len(pairs)


def test_bits_of_a_line_are_those_of_its_shingles(spark):
    lines = [prose(91, 40), "short", "É" * 30 + prose(92, 9), "x" * 400, "𝔘𝔫𝔦 " * 9]
    docs = spark.createDataFrame(list(enumerate(lines)), "_line long, line string")
    sets = {r[0]: r[1] for r in docs.select("_line", linedup.shingles(F.col("line"))).collect()}
    for table in (docs, docs.withColumn("_row", F.col("_line") * 7)):
        for r in linedup.sketched(table).collect():
            bits = [0] * linedup.WORDS
            for x in sets[r["node"]]:
                bits[(x >> 6) % linedup.WORDS] |= 1 << (x & 63)
            assert (r["size"], r["ones"]) == (len(sets[r["node"]]), sum(b.bit_count() for b in bits))
            assert [b & (1 << 64) - 1 for b in r["bits"]] == bits


def test_shingles_of_ascii_are_those_of_its_characters(spark):
    lines = ["", "a", "Exactly twelv", "Twelve chars", "ABC def\t" * 40, prose(93, 60), prose(93, 60) + " é", "\x7f\x00" * 8, "İ" + "ASCII but for one" * 3]
    docs = spark.createDataFrame(list(enumerate(lines)), "_line long, line string").withColumn("low", F.lower("line"))
    found = {r[0]: set(r[1]) for r in docs.select("_line", linedup.shingles(F.col("line"))).collect()}
    low = {r["_line"]: r["low"] for r in docs.collect()}
    runs = [(n, x[i : i + 12]) for n, x in low.items() for i in range(max(1, len(x) - 11))]
    wanted = {}
    for r in spark.createDataFrame(runs, "n long, x string").select("n", F.xxhash64("x")).collect():
        wanted.setdefault(r[0], set()).add(r[1])
    assert found == wanted
