"""Operators against brute force, with hot groups."""

import os
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarflow.operators import ann, dedup, embed, geo, impute, lookup, matching, reports, topk, trigram, upsert


def vectors(spark, n, seed, id_name, vec_name, blocks=None, dim=8):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=dim)], blocks[i % len(blocks)] if blocks else "x") for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{id_name} long, {vec_name} array<float>, block string")


def cosine(a, b):
    a, b = np.asarray(a, dtype="float32").astype(float), np.asarray(b, dtype="float32").astype(float)
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def brute(left, right, k, same_block=True):
    out = set()
    for lid, lv, lb in left:
        ranked = sorted(((-cosine(lv, rv), rid) for rid, rv, rb in right if lb == rb or not same_block))
        out |= {(lid, rid) for _, rid in ranked[:k]}
    return out


@pytest.mark.parametrize("tile_rows", [5, 1000])
def test_tiled_topk_equals_brute_force_with_a_hot_block(spark, tile_rows):
    blocks = ["hot"] * 8 + ["cold", "none"]
    lrows, left = vectors(spark, 60, 1, "left_id", "left_vec", blocks)
    rrows, right = vectors(spark, 80, 2, "right_id", "right_vec", ["hot"] * 9 + ["cold"])
    got = topk.tiled_topk(left, right, ["block"], 4, tile_rows=tile_rows).collect()
    assert {(r["left_id"], r["right_id"]) for r in got} == brute(lrows, rrows, 4)
    assert all(1 <= r["rank"] <= 4 for r in got)


def clustered(spark, n, id_name, vec_name, seed, clusters=12, dim=16):
    centres = np.random.default_rng(99).normal(size=(clusters, dim)) * 4
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in (centres[i % clusters] + rng.normal(size=dim) * 0.3)], "hot" if i % 3 else "cold") for i in range(n)]
    # odd rows: no direction, and many equal vectors
    rows = [(i, [0.0] * dim if i % 97 == 5 else rows[1][1] if i % 41 == 7 else v, b) for i, v, b in rows]
    return rows, spark.createDataFrame(rows, f"{id_name} long, {vec_name} array<float>, block string")


def test_pruned_topk_equals_brute_force_and_compares_few_tiles(spark):
    from collections import defaultdict

    _, left = clustered(spark, 500, "left_id", "left_vec", 1)
    _, right = clustered(spark, 700, "right_id", "right_vec", 2)

    def result(prune_from):
        rows = topk.tiled_topk(left, right, ["block"], 4, tile_rows=20, prune_from=prune_from).collect()
        out = defaultdict(list)
        for r in sorted(rows, key=lambda r: (r["left_id"], r["rank"])):
            out[r["left_id"]].append((r["right_id"], round(r["score"], 9)))
        return out

    plain, pruned = result(10**6), result(2)
    assert len(plain) == 500 and pruned.keys() == plain.keys()
    # equal vectors score alike but for the last bit, so ranks are compared by score
    assert all([s for _, s in pruned[i]] == [s for _, s in plain[i]] for i in plain)

    sides = [df.withColumnRenamed(f"{name}_vec", "_v").withColumn("_nl", F.lit(17)).withColumn("_nr", F.lit(24)).withColumn("_k", F.lit(4))
             for name, df in (("left", left), ("right", right))]
    a, b, keys = topk.certified_tiles(*sides, ["block"], lambda lp, rp: topk._unit(lp["_v"]) @ topk._unit(rp["_v"]).T,
                                      lambda cosine, _: cosine, None, 20)
    whole = sum(r["n"] for r in left.groupBy("block").count().withColumnRenamed("count", "l").join(
        right.groupBy("block").count(), "block").selectExpr("l * count n").collect())
    compared = sum(r["l"] * r["count"] for r in a.groupBy(*keys).count().withColumnRenamed("count", "l").join(
        b.groupBy(*keys).count(), keys).collect())
    assert 0 < compared < 0.5 * whole


def test_pruned_topk_without_structure_and_with_few_rows(spark):
    lrows, left = vectors(spark, 60, 1, "left_id", "left_vec", ["hot", "hot", "none"])
    rrows, right = vectors(spark, 80, 2, "right_id", "right_vec", ["hot"])
    got = topk.tiled_topk(left, right, ["block"], 100, tile_rows=10, prune_from=1).collect()
    assert {(r["left_id"], r["right_id"]) for r in got} == brute(lrows, rrows, 100)
    assert topk.tiled_topk(left.where("false"), right, ["block"], 3).count() == 0


def test_equal_scores_go_to_the_lower_id(spark):
    left = spark.createDataFrame([(1, [1.0, 0.0])], "left_id long, left_vec array<float>").withColumn("block", F.lit(1))
    right = spark.createDataFrame([(i, [2.0, 0.0]) for i in range(50)], "right_id long, right_vec array<float>").withColumn("block", F.lit(1))
    got = topk.tiled_topk(left, right, ["block"], 3, tile_rows=7).collect()
    assert sorted(r["right_id"] for r in got) == [0, 1, 2]


def test_missing_vectors_and_zero_vectors(spark):
    left = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "left_id long, left_vec array<float>").withColumn("block", F.lit(1))
    right = spark.createDataFrame([(5, [1.0, 1.0]), (6, None)], "right_id long, right_vec array<float>").withColumn("block", F.lit(1))
    got = topk.tiled_topk(left, right, ["block"], 3).collect()
    assert [(r["left_id"], r["right_id"], r["score"]) for r in got] == [(1, 5, 0.0)]


def test_ladder_level_depends_on_existence(spark):
    left = spark.createDataFrame([(1, "Rome", "Italy", "T"), (2, "Pisa", "Italy", "T"), (3, "Oslo", "Norway", "T"), (4, "Oslo", "Norway", "Z")],
                                 "left_id long, city string, country string, activity string").withColumn("left_vec", F.array(F.lit(1.0), F.lit(0.0)))
    right = spark.createDataFrame([(10, "ROME", "Italy", "T", [-1.0, 0.0]), (11, "Milan", "Italy", "T", [1.0, 0.0]), (12, "Paris", "France", "T", None)],
                                  "right_id long, cat_city string, cat_country string, cat_activity string, right_vec array<double>")
    got = {(r["left_id"], r["right_id"], r["level"]) for r in matching.nearest_in_ladder(left, right).collect()}
    assert got == {(1, 10, 1), (2, 10, 2), (2, 11, 2), (3, 10, 3), (3, 11, 3)}


def test_approximate_topk_recall_and_exact_when_all_lists_are_probed(spark):
    lrows, left = vectors(spark, 40, 3, "left_id", "left_vec")
    rrows, right = vectors(spark, 300, 4, "right_id", "right_vec")
    exact = brute(lrows, rrows, 5)
    some = {(r["left_id"], r["right_id"]) for r in ann.approximate_topk(left, right, 5, lists=8, probes=4, tile_rows=50).collect()}
    every = {(r["left_id"], r["right_id"]) for r in ann.approximate_topk(left, right, 5, lists=4, probes=4).collect()}
    assert every == exact
    assert len(some & exact) / len(exact) > 0.8


def test_best_supplier_equals_nested_loop(spark):
    cities = ["Rome", "Rome North", "Paris", "", None]
    kinds = ["TICKET", "TICKET TOUR", None]
    lrows, left = vectors(spark, 30, 5, "left_id", "left_vec")
    rrows, right = vectors(spark, 30, 6, "right_id", "right_vec")
    attrs = [(i, cities[i % 5], kinds[i % 3]) for i in range(30)]
    left = left.join(spark.createDataFrame(attrs, "left_id long, city string, category string"), "left_id")
    right = right.join(spark.createDataFrame([(i, cities[(i + 2) % 5], kinds[(i + 1) % 3]) for i in range(30)],
                                             "right_id long, sup_city string, sup_category string"), "right_id")

    def part(a, b, full, share):
        a, b = (a or "").lower(), (b or "").lower()
        return 0 if not a or not b else full if a == b else full * share if a in b or b in a else 0

    expected = {}
    for (lid, lv, _), (_, lc, lk) in zip(lrows, attrs):
        best = max((min(1.0, 0.65 * cosine(lv, rv) + part(lc, cities[(rid + 2) % 5], 0.2, 0.7) + part(lk, kinds[(rid + 1) % 3], 0.15, 0.6)), -rid) for rid, rv, _ in rrows)
        if best[0] >= 0.55:
            expected[lid] = -best[1]
    got = matching.best_suppliers(left, right, tile_rows=7).collect()
    assert {r["left_id"]: r["right_id"] for r in got} == expected


def pg_trigrams(s):
    import re
    words = [w for w in re.split(r"[\W_]+", s.lower()) if w]
    return {("  " + w + " ")[i:i + 3] for w in words for i in range(len(w) + 1)}


def test_trigram_prefix_filter_finds_every_pair(spark):
    rng = random.Random(9)
    names = ["".join(rng.choice("abct") for _ in range(rng.randint(1, 9))) + rng.choice(["", " north", "_1", "_10"]) for _ in range(150)]
    phrases = [n[:-1] + rng.choice("abz") if n else n for n in names] + names[:20]
    a, b = [spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((phrases, "phrase"), (names, "name"))]
    expected = set()
    for p in set(phrases):
        for n in set(names):
            x, y = pg_trigrams(p), pg_trigrams(n)
            if x and y and len(x & y) / len(x | y) >= 0.4:
                expected.add((p, n))
    got = {(r["phrase"], r["name"]) for r in trigram.fuzzy_pairs(a, b).collect()}
    assert got == expected


def test_trigram_pairs_inside_a_country_compare_few(spark):
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) + rng.choice(["", " beach", " north"]) for _ in range(400)})
    cities = spark.createDataFrame([(i, n, f"Land {i % 5}", 0.0, 0.0) for i, n in enumerate(names)] + [(900, names[1], None, 0.0, 0.0)],
                                   "city_id long, name string, country string, lat double, lng double")
    wanted = [(n[:-1] + "x", f"land {i % 5}" if i % 4 else None) for i, n in enumerate(names)] + [(names[0], "LAND 1"), ("", None), (None, "x"), ("--", None), (names[1], "")]
    expected = {}
    for p, c in set(wanted):
        if p and len(p) >= 2:
            x = pg_trigrams(p)
            known = [(len(x & y) / len(x | y), -i, n) for i, n in enumerate(names) for y in [pg_trigrams(n)] if (c is None or c.lower() == f"land {i % 5}") and x | y]
            best = max((k for k in known if k[0] >= 0.4), default=None)
            if best:
                expected[p, c] = best[2]
    phrases = spark.createDataFrame(wanted, "phrase string, country string")
    assert {(r["phrase"], r["country"]): r["city"] for r in trigram.best_city(phrases, cities).collect()} == expected
    sides = [spark.createDataFrame([(n, f"b{i % 5}") for i, n in enumerate(names)], f"{side} string, b string") for side in ("phrase", "name")]
    inside = trigram._candidates(*sides, 0.4, ["b"]).count()
    assert len(names) <= inside < 0.05 * len(names) ** 2


def in_order(rows, known):
    urls = {u for u, _, _ in known if u}
    names = {(n, s) for _, n, s in known}
    out = {}
    for seq, url, name, sup in sorted(rows):
        if not name or len(name) < 2:
            out[seq] = "rejected"
        elif (url and url in urls) or (name, sup) in names:
            out[seq] = "skipped"
        else:
            out[seq] = "saved"
            if url:
                urls.add(url)
            names.add((name, sup))
    return out


def run_set1(spark, rows, known):
    batch = spark.createDataFrame(rows, "seq long, url string, name string, supplier long")
    stored = spark.createDataFrame(known, "url string, name string, supplier long")
    out = dedup.accept_in_order(batch, stored, "seq", "url", "name", "supplier", valid=F.length("name") >= 2)
    return {r["seq"]: r["disposition"] for r in out.collect()}


def test_a_skipped_row_registers_nothing(spark):
    rows = [(1, "u1", "n1", 1), (2, "u1", "n2", 1), (3, "u3", "n2", 1), (4, None, "x", 1)]
    assert run_set1(spark, rows, [("u9", "n9", 1)]) == {1: "saved", 2: "skipped", 3: "saved", 4: "rejected"}


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_dedup_equals_row_by_row(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "", *(f"u{rng.randint(0, 25)}" for _ in range(3))]) if rng.random() > 0.3 else "hot",
             rng.choice(["", None, *(f"name{rng.randint(0, 20)}" for _ in range(4))]), rng.randint(0, 2)) for i in range(200)]
    known = [("u1", "name1", 0), (None, "name2", 1)]
    assert run_set1(spark, rows, known) == in_order(rows, known)


def test_upsert_twice_is_once(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    delta = spark.createDataFrame([(2, "B", 7), (3, "C", 8)], "id int, v string, extra int")
    once = upsert.upsert(base, delta, ["id"])
    twice = upsert.upsert(once, delta, ["id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", None), (2, "B", 7), (3, "C", 8)] or \
        {tuple(r) for r in once.collect()} == {tuple(r) for r in twice.collect()} == {(1, "a", None), (2, "B", 7), (3, "C", 8)}


def test_keep_latest_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 1, "c"), (None, 2, "d")], "k int, o int, v string")
    assert sorted(r["v"] for r in dedup.keep_latest(df, ["k"], "o").collect()) == ["b", "c", "d"]


def test_catalogue_ids_are_stable(spark):
    new = spark.createDataFrame([("p1", "T", "", "ticket", "449", "c", 1, 230.1, None, None, "Rome", "Italy")],
                                "product_key string, title string, description string, type_label string, type_code string, category string, locality_id long, "
                                "price double, currency string, operator string, city string, country string")
    first, again = upsert.catalogue_rows(new), upsert.catalogue_rows(new.repartition(3))
    assert first["product"].first() == again["product"].first()
    assert first["product"].first()["purchase_price"] == 195.59
    assert first["detail"].count() == 2


def test_get_or_create_ids_repeat(spark):
    loc = spark.createDataFrame([(7, "Rome")], "locality_id long, name string")
    rows = spark.createDataFrame([("ROME",), ("New",), ("new ",), (None,)], "city string")
    got, new = lookup.get_or_create(rows, "city", loc)
    ids = [r["locality_id"] for r in got.collect()]
    assert ids.count(7) == 2 and len(set(ids)) == 2
    assert new.count() == 1


@pytest.mark.parametrize("limit", [3, 10_000])
def test_median_with_a_hot_group_and_outliers(spark, limit):
    rng = random.Random(4)
    rows = [("hot", rng.choice([1e9, rng.randint(1, 500) / 4])) for _ in range(400)] + [("even", float(x)) for x in (1, 2, 3, 10)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    counts = impute.value_counts(df, ["k"], "v")
    got = {r["k"]: r["median"] for r in impute.median_of_counts(counts, ["k"], buckets=4, max_values=limit).collect()}
    expected = {k: statistics.median(v for kk, v in rows if kk == k and v is not None) for k in ("hot", "even", "one")}
    assert got == expected


def test_price_ladder_levels(spark):
    ref = spark.createDataFrame([("Rome", "Italy", "T", 10.0), ("Rome", "Italy", "T", 20.0), ("Pisa", "Italy", "T", 60.0), ("Oslo", "Norway", "T", 0.0)],
                                "city string, country string, activity string, price double")
    todo = spark.createDataFrame([(1, "ROME", "x", "T", None), (2, "Bari", "Italy", "T", 0.0), (3, "Oslo", "Norway", "T", None), (4, "Oslo", "Norway", "Z", None), (5, "a", "b", "T", 9.0)],
                                 "id int, city string, country string, activity string, price double")
    got = {r["id"]: (r["price"], r["price_level"], r["price_is_estimated"]) for r in impute.fill_prices(todo, ref, last_resort=F.lit(40.0)).collect()}
    assert got == {1: (15.0, 1, True), 2: (20.0, 2, True), 3: (20.0, 3, True), 4: (40.0, 4, True), 5: (9.0, 0, False)}


CITIES = [(1, "Rome", "Italy", 41.9, 12.5), (2, "Rome", "United States", 34.0, -85.0), (3, "New York", "United States", 40.7, -74.0), (4, "York", "United Kingdom", 54.0, -1.1),
          (5, "Marrakech", "Morocco", 31.6, -8.0), (6, "Tours", "France", 47.4, 0.7)]


def gazetteer(spark):
    cities = spark.createDataFrame(CITIES, "city_id long, name string, country string, lat double, lng double")
    countries = spark.createDataFrame(list(enumerate(sorted({c[2] for c in CITIES}))), "country_id int, country string")
    return cities, countries


def test_place_resolution(spark):
    cities, countries = gazetteer(spark)
    rows = [(1, "Walk in New York City", "", "Tours", "France"), (2, "Medina walk", "", "Marrakesh", "Morocco"), (3, "Rome? no", "", None, "Italy"),
            (4, "A seoul food day", "", None, "United States"), (5, "A food day", "", None, "united states"), (6, "x", "", "tour", "Atlantis")]
    df = spark.createDataFrame(rows, "id int, title string, description string, city_raw string, country_raw string")
    got = {r["id"]: (r["city"], r["country"], r["location_confidence"], r["location_sources"]) for r in geo.resolve_places(df, "id", cities, countries).collect()}
    assert got == {
        1: ("New York", "United States", 0.9, ["text_mention", "country_overridden"]), 2: ("Marrakech", "Morocco", 0.75, ["city_trigram"]),
        3: ("Rome", "Italy", 0.9, ["text_mention"]), 4: (None, None, 0.0, []), 5: (None, "United States", 0.35, ["country_stated"]), 6: (None, None, 0.0, [])}


def test_verify_and_cities_of(spark):
    cities, _ = gazetteer(spark)
    df = spark.createDataFrame([("rome", "Italy"), ("ROME", None), ("marra", "x"), ("z", None), (None, None)], "city string, country string")
    assert [r["verified"] for r in lookup.verify_city(df, "city", "country", cities).orderBy(F.desc_nulls_last("city")).collect()] is not None
    got = {(r["city"], r["verified"]) for r in lookup.verify_city(df, "city", "country", cities).collect()}
    assert got == {("rome", "Rome"), ("ROME", "Rome"), ("marra", "Marrakech"), ("z", None), (None, None)}
    wanted = spark.createDataFrame([("italy",), ("united",), ("nowhere",)], "wanted string")
    got = {(r["wanted"], r["city"]) for r in lookup.cities_of(wanted, cities).collect()}
    assert got == {("italy", "Rome"), ("united", "Rome"), ("united", "New York"), ("united", "York"), ("nowhere", "nowhere")}


def test_equal_texts_are_embedded_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, ""), (4, None), (5, "c")], "id int, t string")
    out = {r["id"]: r["embedding"] for r in embed.embed_distinct(df, "t").collect()}
    assert out[1] == out[2] and out[3] is None and out[4] is None and len(out[5]) == 64
    assert abs(sum(x * x for x in out[1]) - 1) < 1e-5


def test_idf_weights_are_fitted_once_and_used_again(spark):
    old = spark.createDataFrame([(1, "rome tour"), (2, "rome tour"), (3, "paris tour"), (4, "tour of oslo"), (5, "...")], "id int, t string")
    idf = embed.fit_idf(old, "t")
    assert idf.count() == 64
    new = spark.createDataFrame([(1, "tour rome"), (2, "tour"), (3, "..."), (4, None), (5, "rome")], "id int, t string")
    out = {r["id"]: r["embedding"] for r in embed.embed_distinct(new, "t", idf=idf).collect()}
    weight = lambda n: float(np.log(5 / (n + 1)))
    assert sorted(x for x in out[1] if x) == pytest.approx(sorted(w / np.hypot(weight(3), weight(1)) for w in (weight(3), weight(1))))
    assert sum(out[2]) == pytest.approx(1) and sum(out[3]) == 0 and len(out[3]) == 64 and out[4] is None
    assert np.dot(out[1], out[5]) > 0.9 > np.dot(out[1], out[2])


def test_interval_report(spark):
    df = spark.createDataFrame([(1, "A", 5, True, False), (2, "A", 9, False, True), (3, "A", 7, True, True), (4, "B", 1, False, False)],
                               "supplier_id int, country string, score int, has_api boolean, has_channel boolean")
    chosen, report = reports.interval_cut(df, 2, 2)
    assert [r["supplier_id"] for r in chosen.orderBy("rank").collect()] == [2, 3]
    assert {r["country"]: r["shortfall"] for r in report.collect()} == {"A": False, "B": True}


def test_mention_prefers_the_country_of_the_text_then_the_stated_one(spark):
    from bazaarflow.operators import geo

    cities = spark.createDataFrame([(1, "Paris", "United States"), (2, "Paris", "France"), (3, "Ho Chi Minh City", "Vietnam"),
                                    (4, "Paris", "Canada")], "city_id long, name string, country string")
    rows = spark.createDataFrame([(1, "Louvre visit in Paris France", "Canada"), (2, "A day in Ho Chi Minh City", None),
                                  (3, "Paris by night", "Canada"), (4, "Paris by night", None)], "k long, x string, c string")
    found = {r["k"]: (r["mention"], r["mention_country"]) for r in geo.text_mention(rows, "k", "x", cities, stated="c").collect()}
    assert found == {1: ("Paris", "France"), 2: ("Ho Chi Minh City", "Vietnam"), 3: ("Paris", "Canada"), 4: ("Paris", "United States")}


def test_countries_in_the_text_and_picks_inside_them(spark):
    cities, countries = gazetteer(spark)
    rows = [(1, "Trip in Morocco", "", "Marrakesh", "Italy"), (2, "A united states trip", "", None, None), (3, "New trip to York and beyond", "", "tour", "united states"),
            (4, "Visit", "New, old: York. In the United States", None, "France"), (5, None, None, None, None), (6, "", "", "", "")]
    df = spark.createDataFrame(rows, "id int, title string, description string, city_raw string, country_raw string")
    got = {r["id"]: (r["city"], r["country"], r["location_confidence"], r["location_sources"]) for r in geo.resolve_places(df, "id", cities, countries).collect()}
    assert got == {
        1: ("Marrakech", "Morocco", 0.75, ["text_country", "city_trigram"]), 2: (None, "United States", 0.6, ["text_country"]),
        3: ("York", "United Kingdom", 0.9, ["text_mention", "country_overridden"]),
        4: ("York", "United Kingdom", 0.9, ["text_mention", "country_overridden"]), 5: (None, None, 0.0, []), 6: (None, None, 0.0, [])}
    apart = spark.createDataFrame([(1, "new hotel near yorks", "united states"), (2, "york and new", "United States"), (3, "york", "Italy"), (4, None, "Italy"), (5, "york", None)],
                                  "id int, x string, c string")
    assert [tuple(r) for r in geo.constrained_pick(apart, "id", "x", "c", cities).collect()] == [(2, "New York", 1.0)]
    assert geo.constrained_pick(apart, "id", "x", "c", cities.where("false")).count() == 0


def test_dictionary_scan_finds_every_place(spark):
    rng = random.Random(5)
    phrases = sorted({" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) for _ in range(40)})
    texts = [(i, " ".join(rng.choice("abcde") for _ in range(rng.choice([0, 1, 30, 3000])))) for i in range(12)] + [(90, None), (91, "A, b. C!")]
    got = geo.dictionary_scan(spark.createDataFrame(texts, "k int, x string"), "k", "x", spark.createDataFrame([(p,) for p in phrases], "phrase string"))
    want = set()
    for k, x in texts:
        words = re.findall(r"[\w'-]+", (x or "").lower())
        want |= {(k, i, n, " ".join(words[i:i + n])) for i in range(len(words)) for n in range(1, 6) if " ".join(words[i:i + n]) in phrases and i + n <= len(words)}
    assert {(r["k"], r["pos"], r["n"], r["phrase"]) for r in got.collect()} == want


def test_stored_index_recall_additions_and_untouched_lists(spark, tmp_path):
    lrows, left = vectors(spark, 80, 3, "left_id", "left_vec")
    rrows, right = vectors(spark, 900, 4, "right_id", "right_vec")
    path = str(tmp_path / "index")
    right = right.drop("block")
    old = right.where("right_id < 800").withColumn("right_vec", F.when(F.col("right_id") % 9 == 0, F.transform("right_vec", lambda x: -x)).otherwise(F.col("right_vec")))
    ann.build_index(old, path)
    assert len(ann.read_centroids(spark, path)) == 16 == ann.lists_for(800)
    delta = right.where("right_id >= 800 or right_id % 9 = 0")
    ann.add_to_index(path, delta)
    assert ann.read_rows(spark, path).count() == 900 == ann.read_rows(spark, path).select("right_id").distinct().count()
    true = brute(lrows, rrows, 5, same_block=False)

    def found(**how):
        return {(r["left_id"], r["right_id"]) for r in ann.search_index(path, left, 5, tile_rows=50, **how).collect()}

    assert found(probes=99) == true
    table = {r["probes"]: r["recall"] for r in ann.measure_recall(path, left, 5).collect()}
    assert table[16] == 1.0 and all(table[p] <= table[p + 1] for p in range(1, 16))
    for p in (2, 7):  # every query was measured, so the table is the recall of a search
        assert len(found(probes=p) & true) / len(true) == pytest.approx(table[p])
    assert len(found() & true) / len(true) >= 0.95

    def files():
        return {f for folder, _, names in os.walk(f"{path}/rows") for f in (os.path.join(folder, n) for n in names) if f.endswith(".parquet")}

    before = files()
    assert ann.add_to_index(path, delta.limit(0)) == [] and files() == before
    one = spark.createDataFrame([(5, None)], "right_id long, right_vec array<float>")
    touched = ann.add_to_index(path, one)
    assert len(touched) == 1 and all(f"list_id={touched[0]}/" in f for f in files() ^ before)
    assert found(probes=99) == {x for x in brute(lrows, [r for r in rrows if r[0] != 5], 5, same_block=False)}
    assert ann.search_index(path, left.where("false"), 5, probes=3).count() == 0
    with pytest.raises(ValueError):
        ann.build_index(old.where("false"), path + "-none")


def one_by_one(existing, incoming):
    hosts = {h: [n, c, s] for h, n, c, s in existing}
    names = {(n, c) for _, n, c, _ in existing if c is not None}
    for _, h, n, c, s in sorted(incoming):
        if not h or not n:
            continue
        if h in hosts:
            hosts[h][2] = max(hosts[h][2], s)
        elif c is None or (n, c) not in names:
            hosts[h] = [n, c, s]
            names |= {(n, c)} if c is not None else set()
    return sorted((h, *v) for h, v in hosts.items())


def test_supplier_merge_equals_row_by_row(spark):
    import random

    from bazaarflow.operators.dedup import merge_suppliers

    r = random.Random(7)
    existing = [("old.com", "N", 1, 5), ("b.com", "B", None, 3)]
    incoming = [(1, "a.com", "N", 1, 99), (2, "a.com", "M", 1, 20), (3, "old.com", "Z", 2, 50), (4, "", "Q", 1, 1), (5, "q.com", None, 1, 1)]
    incoming += [(10 + i, f"{r.choice('abcdefgh')}{r.randint(0, 3)}.com", r.choice("NMOPQR"), r.choice([1, 2, None]), r.randint(1, 99)) for i in range(80)]
    a = spark.createDataFrame(existing, "domain string, name string, country_id long, score long")
    b = spark.createDataFrame(incoming, "seq long, domain string, name string, country_id long, score long")
    found = sorted((x["domain"], x["name"], x["country_id"], x["score"]) for x in merge_suppliers(a, b).collect())
    assert [tuple(map(str, f)) for f in found] == [tuple(map(str, f)) for f in one_by_one(existing, incoming)]
    assert ("a.com", "M", 1, 20) not in one_by_one(existing, [(1, "a.com", "N", 1, 99)])


def test_long_chains_end_and_blank_names_are_rejected(spark):
    from bazaarflow.operators.dedup import accept_in_order

    chain = [(i, f"u{(i + 1) // 2}", f"n{i // 2}", "s") for i in range(24)] + [(100, None, " ", "s"), (101, None, None, "s")]
    batch = spark.createDataFrame(chain, "seq long, url string, name string, supplier string")
    found = {r["seq"]: r["disposition"] for r in accept_in_order(batch, batch.limit(0), "seq", "url", "name", "supplier").collect()}
    urls, names, expected = set(), set(), {}
    for i, u, n, _ in chain[:24]:
        expected[i] = "skipped" if u in urls or n in names else "saved"
        if expected[i] == "saved":
            urls.add(u), names.add(n)
    assert found == {**expected, 100: "rejected", 101: "rejected"}


def test_upsert_takes_one_row_per_key(spark):
    from bazaarflow.operators.upsert import append_log, compact_log, insert_absent, read_log, upsert

    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, at long")
    delta = spark.createDataFrame([(2, "new", 5), (2, "older", 3), (3, "c", 1), (3, "c", 1)], "k long, v string, at long")
    assert sorted(tuple(r) for r in upsert(base, delta, ["k"], order="at").collect()) == [(1, "a", 1), (2, "new", 5), (3, "c", 1)]
    assert sorted(tuple(r) for r in insert_absent(base, delta, ["k"], order="at").collect()) == [(1, "a", 1), (2, "b", 1), (3, "c", 1)]
    assert upsert(base, delta, ["k"]).count() == 3
    import tempfile

    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    append_log(delta.where("at = 5"), path + "/log", 0)
    append_log(delta.where("at = 3"), path + "/log", 1)  # late
    assert [r["v"] for r in read_log(spark, path + "/log", ["k"], "at").collect()] == ["new"]
    compact_log(spark, path + "/log", path + "/new", ["k"], "at")
    assert [r["v"] for r in read_log(spark, path + "/new", ["k"], "at").collect()] == ["new"]


def test_rules_of_any_number_in_both_modes(spark):
    from bazaarflow.functions.rules import first_label
    from pyspark.sql import functions as F

    for n in (12, 13, 200):
        rules = [([f"word{i}x", f"term{i}x"], f"L{i}") for i in range(n)]
        df = spark.createDataFrame([(f"a term{n - 1}x here",), (f"zzterm{n - 1}xzz",), ("none",), (None,)], "t string")
        for mode, second in (("substring", f"L{n - 1}"), ("word", "D")):
            assert [r[0] for r in df.select(first_label(F.col("t"), rules, "D", mode)).collect()] == [f"L{n - 1}", second, "D", "D"]


def test_registered_index_search_has_a_recall_of_nine_tenths(spark):
    from bazaarflow.plans.bindings import QUERIES

    folder = "/root/testdata/sf0.01"
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect())
    ids, m = [i for i, _ in rows], np.array([v for _, v in rows], float)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(-(unit @ unit[:, ::-1].T), axis=1, kind="stable")[:, :10]
    exact = {(ids[i], ids[j]) for i, row in enumerate(best) for j in row}
    found = {(r["left_id"], r["right_id"]) for r in QUERIES["jn4_approximate_topk"](spark, folder).collect()}
    assert len(found & exact) / len(exact) >= 0.9


def test_batch_dedup_of_a_long_chain_needs_few_rounds(spark, monkeypatch):
    from bazaarflow.operators import components, dedup

    rounds = []
    monkeypatch.setattr(components, "_totals", lambda links, f=components._totals: rounds.append(1) or f(links))
    batch = spark.range(10_000).selectExpr("id AS seq", "'u' || ((id + 1) div 2) AS url", "'n' || (id div 2) AS name", "1L AS supplier")
    out = dedup.accept_in_order(batch, batch.limit(0), "seq", "url", "name", "supplier", whole=0)
    assert {r["seq"]: r["disposition"] for r in out.collect()} == {i: "skipped" if i % 2 else "saved" for i in range(10_000)}
    assert len(rounds) < 25


@pytest.mark.parametrize("most", [3, 10_000])
def test_large_components_give_the_same_result(spark, most):
    rng = random.Random(11)
    rows = [(i, f"u{rng.randint(0, 60)}", f"name{rng.randint(0, 60)}", 1) for i in range(150)]
    batch = spark.createDataFrame(rows, "seq long, url string, name string, supplier long")
    out = dedup.accept_in_order(batch, batch.limit(0), "seq", "url", "name", "supplier", most=most, whole=0)
    assert {r["seq"]: r["disposition"] for r in out.collect()} == in_order(rows, [])


def test_components_of_key_sharing_rows(spark):
    from bazaarflow.operators.components import components, key_links

    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "c", None), (5, None, None), (6, "d", "z"), (7, "d", "z")], "id long, p string, q string")
    found = {(r["node"], r["component"]) for r in components(key_links(rows, "id", ["p", "q"])).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)}
    assert components(key_links(rows.limit(0), "id", ["p"])).count() == 0


def test_search_ranks_rounded_scores_by_id(spark, tmp_path):
    # row 9 is nearer than row 3, but not in six digits
    right = spark.createDataFrame([(9, [1.0, 0.0001]), (3, [1.0, 0.0002]), (4, [1.0, 1.0])], "right_id long, right_vec array<float>")
    left = spark.createDataFrame([(1, [1.0, 0.0])], "left_id long, left_vec array<float>")
    path = str(tmp_path / "index")
    ann.build_index(right, path, centroids=np.eye(2))
    assert [r["right_id"] for r in ann.search_index(path, left, 2, probes=2).orderBy("rank").collect()] == [9, 3]
    got = ann.search_index(path, left, 2, probes=2, tile_rows=1, digits=6).orderBy("rank").collect()
    assert [(r["right_id"], r["score"]) for r in got] == [(3, 1.0), (9, 1.0)]


@pytest.mark.parametrize("tile_rows", [4, None])
def test_equal_rows_are_compared_once_and_ranked_by_id(spark, tile_rows):
    lrows, left = vectors(spark, 5, 3, "left_id", "left_vec")
    rrows, right = vectors(spark, 7, 4, "right_id", "right_vec")
    lrows = [(i, lrows[i % 5][1], "x") for i in range(40)]
    rrows = [(i, rrows[i % 7][1], "x") for i in range(70)]
    left = spark.createDataFrame(lrows, "left_id long, left_vec array<float>, block string")
    right = spark.createDataFrame(rrows, "right_id long, right_vec array<float>, block string")
    members, found = topk.grouped_topk(left, right, ["block"], 13, tile_rows=tile_rows)
    assert members.select("group_id").distinct().count() == 5
    assert found.count() == 5 * 13
    got = members.join(found, "group_id").select("left_id", "right_id", "rank").collect()
    assert {(r["left_id"], r["right_id"]) for r in got} == brute(lrows, rrows, 13)
    assert sorted(r["rank"] for r in got if r["left_id"] == 17) == list(range(1, 14))


def test_copies_sent_do_not_grow_with_the_number_of_rows():
    for rows in (10_000, 51_282, 600_000, 780_000):
        assert -(-rows // topk.rows_of_tile(rows, 64)) <= topk.TILES
    assert topk.rows_of_tile(10**8, 1024) * 8 * 1024 <= topk.TILE_BYTES


def test_blocks_without_clusters_are_left_to_plain_tiles(spark):
    lrows, left = vectors(spark, 60, 1, "left_id", "left_vec", ["hot"])
    rrows, right = vectors(spark, 80, 2, "right_id", "right_vec", ["hot"])
    how = {"tile_rows": 5, "prune_from": 1}
    for most_cells in (0.0, 2.0, float("inf")):
        got = topk.tiled_topk(left, right, ["block"], 4, most_cells=most_cells, **how).collect()
        assert {(r["left_id"], r["right_id"]) for r in got} == brute(lrows, rrows, 4)
    sides = [df.withColumnRenamed(f"{name}_vec", "_v").withColumn("_nl", F.lit(12)).withColumn("_nr", F.lit(16)).withColumn("_k", F.lit(4))
             for name, df in (("left", left), ("right", right))]
    *_, wide = topk._certified(*sides, ["block"], lambda lp, rp: topk._unit(lp["_v"]) @ topk._unit(rp["_v"]).T, lambda cosine, _: cosine, None, 5, 2.0)
    assert [r["block"] for r in wide.collect()] == ["hot"]


def test_length_of_a_vector_is_computed_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(ann.unit_vector(F.col("v")).alias("u"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert [r["u"] for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_rows_of_one_small_file_are_dealt_to_all_cores(spark, tmp_path):
    from bazaarflow.plans import inputs
    from bazaarflow.plans.registry import Tables

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = inputs.raw(Tables(spark, str(tmp_path)))
    sizes = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism
    assert sum(r["count"] for r in sizes) == part.count()


def test_null_and_empty_texts_agree_with_sql(spark, tmp_path):
    import duckdb
    from bazaarflow.plans.bindings import ORACLES, QUERIES

    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "Äjj"), (None, "a b"), (5, " ")], "doc_id long, text string").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/*.parquet'")
    for name in ("sim13_embed_distinct", "sim13_idf_vectors"):
        found = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(found, key=repr) == sorted(con.sql(ORACLES[name]).fetchall(), key=repr)


def test_words_are_hashed_once_for_weights_and_vectors(spark):
    df = spark.createDataFrame([(1, "red car"), (2, "blue car"), (3, "red car"), (4, ""), (5, None), (6, "?!")], "id int, t string")
    out = embed.embed_distinct(df, "t")
    assert "conv(" not in out._jdf.queryExecution().optimizedPlan().toString()
    idf = embed.fit_idf(df, "t")
    both = embed.embed_distinct(df, "t", idf=idf)
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == sorted(map(tuple, both.collect()), key=lambda r: r[0])


def test_words_of_a_supplier_tile_are_told_apart_once(monkeypatch):
    import numpy as np
    import pandas as pd

    from bazaarflow.operators import matching

    calls, real = [], np.unique
    monkeypatch.setattr(np, "unique", lambda a, **how: calls.append(len(a)) or real(a, **how))
    cities = ["Rome", "New Rome", "", None, "oslo"]
    left = pd.DataFrame({"city": cities * 2, "category": ["A", "b", None, "", "ab"] * 2})
    right = pd.DataFrame({"sup_city": [cities[i % 5] for i in range(50)], "sup_category": [["a", "", "AB", None][i % 4] for i in range(50)]})
    cosine = np.linspace(-1, 1, 500).reshape(10, 50)
    weights = {"embedding": 0.65, "city": 0.2, "category": 0.15}
    score = matching._relation(weights)
    found = np.concatenate([score(cosine[at:at + 2].copy(), left.iloc[at:at + 2], right) for at in range(0, 10, 2)])

    def points(x, y, full, share):
        x, y = (x or "").lower(), (y or "").lower()
        return 0.0 if not x or not y else full if x == y else full * share if x in y or y in x else 0.0

    wanted = [[min(1.0, cosine[i, j] * 0.65 + points(left.city[i], right.sup_city[j], 0.2, 0.7) + points(left.category[i], right.sup_category[j], 0.15, 0.6))
               for j in range(50)] for i in range(10)]
    assert (found == np.array(wanted)).all()
    assert calls.count(50) == 2
