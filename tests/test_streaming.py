"""Streams over several files end where a batch run ends."""

from pyspark.sql import functions as F

from bazaarflow.operators.upsert import append_log, read_log
from bazaarflow.session import scratch_path
from bazaarflow.streaming import incremental

SCHEMA = "id int, url string, v int, created_at timestamp"


def rows(spark, data):
    return spark.createDataFrame(data, "id int, url string, v int, ts string").select("id", "url", "v", F.to_timestamp("ts").alias("created_at"))


def test_incremental_run_picks_up_new_files_only(spark):
    landing, table, checkpoint = (scratch_path(spark, n) for n in ("landing", "table", "checkpoint"))
    seen = []

    def transform(df):
        seen.append(df.count())
        return df.select("id", (F.col("v") * 10).alias("v"))

    rows(spark, [(1, "a", 1, "2024-01-01"), (1, "a", 2, "2024-01-02"), (2, "b", 3, "2024-01-01")]).write.mode("append").parquet(landing)
    stream = lambda: incremental.landing_stream(spark, landing, SCHEMA)
    incremental.incremental_run(stream(), transform, ["id"], "created_at", table, checkpoint).awaitTermination()
    rows(spark, [(2, "b", 5, "2024-01-03"), (3, "c", 6, "2024-01-03")]).write.mode("append").parquet(landing)
    incremental.incremental_run(stream(), transform, ["id"], "created_at", table, checkpoint).awaitTermination()
    assert {(r["id"], r["v"]) for r in read_log(spark, table, ["id"]).collect()} == {(1, 20), (2, 50), (3, 60)}
    assert seen == [2, 2]


def test_a_repeated_batch_replaces_itself(spark):
    table = scratch_path(spark, "log")
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    append_log(df, table, 0)
    append_log(df, table, 0)
    assert spark.read.parquet(table).count() == 1


def test_stream_dedup_within_the_watermark(spark):
    landing, table, checkpoint = (scratch_path(spark, n) for n in ("landing", "table", "checkpoint"))
    run = lambda: incremental.append_stream(incremental.dedup_stream(
        incremental.landing_stream(spark, landing, SCHEMA), ["url"], "created_at", watermark="2 days"), table, checkpoint).awaitTermination()
    rows(spark, [(1, "a", 1, "2024-01-01"), (2, "a", 2, "2024-01-01"), (3, "b", 3, "2024-01-02")]).write.mode("append").parquet(landing)
    run()
    rows(spark, [(4, "b", 1, "2024-01-02"), (5, "c", 1, "2024-01-03")]).write.mode("append").parquet(landing)
    run()
    assert sorted(r["url"] for r in spark.read.parquet(table).collect()) == ["a", "b", "c"]


def catalogue_of(spark, folder, names):
    spark.createDataFrame([(i, n) for i, n in enumerate(names)], "cat_id int, name string").write.mode("overwrite").parquet(folder)


def test_match_run_over_files_late_rows_and_a_new_snapshot(spark):
    from bazaarflow.sources.partitioned import create_table, read_table

    landing, table, checkpoint, snapshot = (scratch_path(spark, n) for n in ("landing", "table", "checkpoint", "snapshot"))
    out = "id int, v int, cat_id int, created_at timestamp"
    create_table(spark.createDataFrame([], out), table, ["id"], parts=8)
    normalise = lambda df: df.withColumn("name", F.lower("url")).select("id", "name", "v")
    match = lambda df, cat: df.join(cat, "name", "left").select("id", "v", "cat_id")

    def run(place=checkpoint):
        stream = incremental.landing_stream(spark, landing, SCHEMA, files_per_batch=1)
        incremental.match_run(stream, snapshot, table, place, normalise=normalise, match=match, key=["id"], order="created_at").awaitTermination()
        return {(r["id"], r["v"], r["cat_id"]) for r in read_table(spark, table).collect()}

    catalogue_of(spark, snapshot, ["a", "b"])
    rows(spark, [(1, "A", 1, "2024-01-02"), (1, "B", 9, "2024-01-01"), (2, "B", 3, "2024-01-05")]).coalesce(1).write.mode("append").parquet(landing)
    rows(spark, [(3, "C", 4, "2024-01-02"), (2, "A", 8, "2024-01-04")]).coalesce(1).write.mode("append").parquet(landing)  # a late row of 2
    first = {(1, 1, 0), (2, 3, 1), (3, 4, None)}
    assert run() == first
    assert run(scratch_path(spark, "again")) == first  # every batch once more, from the first file on
    catalogue_of(spark, snapshot, ["x", "y", "c"])
    rows(spark, [(3, "C", 5, "2024-01-03")]).coalesce(1).write.mode("append").parquet(landing)
    assert run() == {(1, 1, 0), (2, 3, 1), (3, 5, 2)}  # only what arrived meets the new catalogue


def test_upsert_rewrites_only_touched_partitions(spark):
    import os

    from bazaarflow.sources.partitioned import create_table, part_of, read_table, upsert_table

    path = scratch_path(spark, "table")
    create_table(spark.range(500).selectExpr("id", "CAST(id AS STRING) AS v", "CAST(NULL AS TIMESTAMP) AS at"), path, ["id"], parts=16)

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{path}/rows") for f in fs if f.endswith(".parquet")}

    before = files()
    delta = spark.createDataFrame([(7, "new", 1), (7, "newer", 2), (900, "added", 1)], "id long, v string, seq int")
    touched = upsert_table(path, delta, ["id"], stamp="at", order="seq")
    assert touched == sorted({r["p"] for r in delta.select(part_of(["id"], 16).alias("p")).collect()})
    after = files()
    assert {f for f in before if after.get(f) == before[f]} == {f for f in before if int(f.split("part=")[1].split("/")[0]) not in touched}
    table = {r["id"]: r for r in read_table(spark, path).collect()}
    assert len(table) == 501 and table[7]["v"] == "newer" and table[900]["v"] == "added" and table[8]["v"] == "8"
    assert {i for i, r in table.items() if r["at"]} == {7, 900}
    assert upsert_table(path, delta, ["id"], order="seq") == touched  # once more: the same rows
    assert {r["id"]: r["v"] for r in read_table(spark, path).collect()} == {i: r["v"] for i, r in table.items()}
    assert upsert_table(path, delta.limit(0), ["id"]) == []


def test_stream_dedup_drops_what_the_watermark_has_passed(spark):
    landing, table, checkpoint = (scratch_path(spark, n) for n in ("landing", "table", "checkpoint"))
    run = lambda: incremental.append_stream(incremental.dedup_stream(
        incremental.landing_stream(spark, landing, SCHEMA), ["url"], "created_at", watermark="1 day"), table, checkpoint).awaitTermination()
    for batch in ([(1, "a", 1, "2024-01-01")], [(2, "z", 1, "2024-01-20")], [(3, "a", 1, "2024-01-21"), (4, "old", 1, "2024-01-02")]):
        rows(spark, batch).coalesce(1).write.mode("append").parquet(landing)
        run()
    # the key came back after its state had gone, and a row older than the watermark was dropped
    assert sorted(r["id"] for r in spark.read.parquet(table).collect()) == [1, 2, 3]
