"""Duplicate handling: batch dedup over two keys, supplier merge, keep-latest, set differences."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarflow import vocab
from bazaarflow.functions.rules import has_any
from bazaarflow.functions.text import host
from bazaarflow.operators.components import components, key_links
from bazaarflow.session import materialise


#: Rows of a component that one task replays.
REPLAYED_ROWS = 1_000_000


def _replayed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows that are saved, from rows sorted by component and order."""
    component, urls, names = None, set(), set()
    for frame in frames:
        kept = []
        for part, seq, url, name in zip(*(frame[c].tolist() for c in ("component", "_seq", "_url", "_ns")), strict=True):
            if part != component:
                component, urls, names = part, set(), set()
            if url in urls or name in names:
                continue
            kept.append(seq)
            if url is not None:
                urls.add(url)
            if name is not None:
                names.add(name)
        yield pd.DataFrame({"_seq": kept}, dtype=frame["_seq"].dtype)


def _replay(rows: DataFrame) -> DataFrame:
    rows = rows.select("component", "_seq", "_url", "_ns")
    return rows.repartition("component").sortWithinPartitions("component", "_seq").mapInPandas(_replayed, rows.select("_seq").schema)


def _in_rounds(open_rows: DataFrame) -> DataFrame:
    """The saved rows among (_url, _ns, _seq): a row that comes first for both keys is saved, rows sharing a key with it are skipped,
    and so on. Each round decides at least the first open row, so the rounds end; in a component this large they are few unless it
    is one long chain."""
    saved = []
    while not open_rows.isEmpty():
        # A row without URL is first for "its URL" by definition; the same holds for the name.
        by_url = open_rows.where("_url is not null").groupBy("_url").agg(F.min("_seq").alias("_u1"))
        by_name = open_rows.where("_ns is not null").groupBy("_ns").agg(F.min("_seq").alias("_n1"))
        ranked = materialise(open_rows.join(by_url, "_url", "left").join(by_name, "_ns", "left").withColumn(
            "_win", (F.coalesce("_u1", "_seq") == F.col("_seq")) & (F.coalesce("_n1", "_seq") == F.col("_seq"))), "round")
        won = ranked.where("_win")
        saved.append(won.select("_seq"))
        open_rows = materialise(ranked.where("not _win").select("_url", "_ns", "_seq")
                                .join(won.select("_url").where("_url is not null"), "_url", "left_anti")
                                .join(won.select("_ns").where("_ns is not null"), "_ns", "left_anti"), "open")
    return functools.reduce(DataFrame.unionByName, saved)


def accept_in_order(batch: DataFrame, existing: DataFrame, seq: str, url: str, name: str, supplier: str,
                    valid: Column | None = None, most: int = REPLAYED_ROWS,
                    whole: int = REPLAYED_ROWS) -> DataFrame:
    """Adds ``disposition``: saved, skipped or rejected, as if rows were taken one by one by ``seq``.

    Rows without a name are rejected. A row is skipped when its URL, or its (name, supplier), is already stored or was saved earlier in the
    batch; a skipped row registers neither key. Rows with an invalid gate are rejected and register nothing.

    Rows equal in both keys collapse to their first one, so a key held by many copies costs one row. Of the others only those
    count together that hang together by keys: each connected component is replayed in order by one task, which streams its rows and
    holds the keys that were saved. A component of more than ``most`` rows is taken in rounds instead, and if there are only ``whole``
    rows in all, one task replays them without looking for components, both with the same result.
    """
    ok = F.coalesce(valid if valid is not None else F.lit(True), F.lit(False)) & F.coalesce(F.trim(F.col(name)) != "", F.lit(False))
    base = batch.withColumn("_ok", ok).withColumn("_url", F.nullif(F.col(url), F.lit(""))).withColumn(
        "_ns", F.when(F.trim(F.col(name)) != "", F.to_json(F.struct(
            F.trim(F.col(name)).alias("n"), F.coalesce(F.col(supplier).cast("string"), F.lit("")).alias("s")))))
    known_urls = existing.select(F.nullif(F.col(url), F.lit("")).alias("_url")).where("_url is not null").distinct()
    known_names = existing.select(F.to_json(F.struct(
        F.col(name).alias("n"), F.coalesce(F.col(supplier).cast("string"), F.lit("")).alias("s"))).alias("_ns")) \
        .where("_ns is not null").distinct()
    heads = (base.where("_ok").groupBy("_url", "_ns").agg(F.min(seq).alias("_seq"))
             .join(known_urls, "_url", "left_anti").join(known_names, "_ns", "left_anti"))
    heads = materialise(heads, "heads")
    if heads.count() <= whole:
        saved = _replay(heads.withColumn("component", F.lit(0)))
    else:
        parts = components(key_links(heads, "_seq", ["_url", "_ns"]))
        sizes = parts.groupBy("component").agg(F.count("*").alias("_n"))
        linked = materialise(heads.join(parts, F.col("_seq") == F.col("node")).join(sizes, "component")
                             .select("component", "_seq", "_url", "_ns", "_n"), "linked")
        alone = heads.join(parts, F.col("_seq") == F.col("node"), "left_anti").select("_seq")
        saved = alone.unionByName(_replay(linked.where(F.col("_n") <= most)))
        large = linked.where(F.col("_n") > most)
        if not large.isEmpty():
            saved = saved.unionByName(_in_rounds(large.select("_url", "_ns", "_seq")))
    out = base.join(saved.withColumn("_saved", F.lit(True)), F.col(seq) == F.col("_seq"), "left")
    return (out.withColumn("disposition", F.when(~F.col("_ok"), "rejected").when(F.col("_saved"), "saved").otherwise("skipped"))
            .drop("_ok", "_url", "_ns", "_seq", "_saved"))


def keep_latest(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row per key, the one with the highest ``order``; rows with a null key all stay."""
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    keyed, nulls = df.where(whole), df.where(~whole)
    best = keyed.groupBy(*key).agg(F.max_by(F.struct(*[F.col(c).alias(c) for c in df.columns]), order).alias("_r"))
    return best.select("_r.*").unionByName(nulls)


def merge_suppliers(existing: DataFrame, incoming: DataFrame, *, host_col: str = "domain", name: str = "name",
                    country: str = "country_id", score: str = "score", seq: str = "seq") -> DataFrame:
    """Existing suppliers plus new ones, as if rows were taken one by one by ``seq``.

    A known host keeps the higher score. A new host with a known (name, country) is dropped and stays unknown. Any other row
    is added and makes both known; without a country names may repeat. Rows without host or name are dropped.
    """
    usable = incoming.where(F.col(host_col).isNotNull() & (F.col(host_col) != "") & F.col(name).isNotNull() & (F.col(name) != ""))
    # a name counts together with its country only, so a row without country gets a name of its own
    def keyed(df: DataFrame, own: Column, *more: Column) -> DataFrame:
        return df.select(*more, F.col(host_col).alias("_h"), F.when(F.col(country).isNull(), own).otherwise(
            F.to_json(F.struct(F.col(name).alias("n"), F.col(country).alias("c")))).alias("_k"), F.lit("").alias("_s"))

    rows = keyed(usable, F.concat(F.lit("row "), F.col(seq).cast("string")), F.col(seq).alias("_at"))
    known = keyed(existing, F.lit(None).cast("string"))
    saved = accept_in_order(rows, known, "_at", "_h", "_k", "_s").where("disposition = 'saved'").select("_at", "_h")
    saved = materialise(saved, "saved")
    # scores count from the row on that made the host known
    since = usable.join(saved.select(F.col("_h").alias(host_col), "_at"), host_col).where(F.col(seq) >= F.col("_at")) \
        .groupBy(host_col).agg(F.max(score).alias("_best"))
    fresh = usable.join(saved.select(F.col("_at").alias(seq)), seq).join(since, host_col) \
        .select(host_col, name, country, F.col("_best").alias(score))
    best = usable.groupBy(host_col).agg(F.max(score).alias("_best"))
    raised = existing.join(best, host_col, "left").withColumn(score, F.greatest(F.col(score), F.col("_best"))).drop("_best")
    return raised.select(host_col, name, country, score).unionByName(fresh.select(host_col, name, country, score))


def supplier_candidates(df: DataFrame, existing: DataFrame, *, name: str = "name", url: str = "website", seq: str = "seq",
                        skip=vocab.SKIP_DOMAINS, not_words=vocab.NOT_SUPPLIER_WORDS) -> DataFrame:
    """Leads with a usable name and an unknown host, the first one per host."""
    rows = df.withColumn("domain", host(F.col(url))).where(
        (F.length(F.trim(F.col(name))) >= 3) & (F.length("domain") >= 5) & ~has_any(F.col("domain"), skip)
        & ~has_any(F.lower(F.col(name)), not_words)).join(existing.select("domain"), "domain", "left_anti")
    best = rows.groupBy("domain").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "domain"]), seq).alias("_r"))
    return best.select("domain", "_r.*")


def split_exported(products: DataFrame, exported: DataFrame, *, name: str = "name", run: str = "run_id",
                   exported_id: str = "exported_id") -> DataFrame:
    """Adds the id of an already exported product with the same name and run (automatic ones only), and ``action``.

    A product without run matches any run.
    """
    auto = exported.where(F.coalesce(F.col("automatic"), F.lit(False)))
    by_run = auto.groupBy(F.col(name).alias("_n"), F.col(run).alias("_r")).agg(F.min(exported_id).alias("_id_run"))
    by_name = auto.groupBy(F.col(name).alias("_m")).agg(F.min(exported_id).alias("_id_any"))
    out = (products.join(by_run, (F.col(name) == F.col("_n")) & (F.col(run) == F.col("_r")), "left")
           .join(by_name, F.col(name) == F.col("_m"), "left"))
    found = F.when(F.coalesce(F.col(run), F.lit("")) == "", F.col("_id_any")).otherwise(F.col("_id_run"))
    return (out.withColumn("external_id", found).withColumn("action", F.when(found.isNull(), "insert").otherwise("skip"))
            .drop("_n", "_r", "_m", "_id_run", "_id_any"))


def new_suppliers(suppliers: DataFrame, exported: DataFrame) -> DataFrame:
    """Suppliers not exported yet: same name, and a website that contains the host (any, if there is no host)."""
    seen = exported.where(F.col("run_id").isNotNull()).select(F.col("name").alias("_n"), F.lower("website").alias("_w")).distinct()
    cond = (F.col("name") == F.col("_n")) & (
        (F.coalesce(F.col("domain"), F.lit("")) == "") | F.contains(F.col("_w"), F.lower("domain")))
    return suppliers.join(seen, cond, "left_anti")
