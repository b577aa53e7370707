"""Quality rules: text statistics, and a decision list learned from labelled documents. Column expressions only.

The list is learned by sequential covering. Every step is one aggregation of the labelled table into counts by
(feature, bin, fold, label), so what reaches the driver is a table of fixed size, however many rows are labelled.
Rules are conjunctions of thresholds; they are grown on two thirds of the labelled rows, pruned on the rest, and
tried in the order in which they were found.

Defined results: a null text has no words and fails the base rules; a null or unlabelled id takes no part in
learning; of several labels of one id the lowest counts; without labels the list is empty and only base rules reject;
equal rows are judged alike; columns that features() adds replace those of the same name, and columns that begin with an
underscore go.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarflow.llm.common import crc32_of_id, materialise, own_columns, words_of

#: Characters that count as symbols. Fixed value.
SYMBOLS = "[#*$%&|<>]"
#: Columns that features() adds, in order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "word_length", "symbol_share", "upper_share", "digit_share", "mark_share", "dup_line_share",
            "repeat_share", "line_words")


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def features(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds COUNTS and the shares in FEATURES, computed over whole texts.

    Windows of three words are compared by their 64-bit hash inside one document. Each step is a column of its own:
    an array that a lambda reads again is then computed once.
    """
    names = tuple(prefix + c for c in (*COUNTS, *FEATURES))
    kept = [F.col(f"`{c}`") for c in own_columns(docs, names)]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words, hashes, placed, where = (F.col(f"_q_{x}") for x in ("words", "hashes", "placed", "where"))
    done = ["_q_lines", "_q_chars", "_q_symbols", "_q_uppers", "_q_digits", "_q_marks"]
    staged = (
        docs.select(*kept, words_of(F.col(f"`{text}`")).alias("_q_words"),
                    F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_q_lines"),
                    F.char_length(whole).cast("long").alias("_q_chars"), _matches(whole, SYMBOLS).alias("_q_symbols"),
                    _matches(whole, "[A-Z]").alias("_q_uppers"), _matches(whole, "[0-9]").alias("_q_digits"),
                    _matches(whole, "[.,;:!?()-]").alias("_q_marks"))
        .select(*kept, *done, F.size(words).cast("long").alias("_q_n"),
                F.char_length(F.array_join(words, "")).cast("long").alias("_q_word_chars"),
                F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
                        1, F.greatest(F.size(words) - 2, F.lit(0))).alias("_q_hashes"))
    )
    done += ["_q_n", "_q_word_chars"]
    staged = (
        # windows in the order of their hashes; texts without a repeated window need none
        staged.select(*kept, *done, F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes),
            F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_q_placed"))
        # a window repeats when a neighbour in that order has its hash
        .select(*kept, *done, F.sort_array(F.filter(F.transform(placed, lambda a, i: F.when(
            (F.get(placed, i - 1).h == a.h) | (F.get(placed, i + 1).h == a.h), a.i)), lambda i: i.isNotNull())).alias("_q_where"))
        # each repeated window adds the words that the one before it does not cover
        .select(*kept, *done, F.size("_q_lines").cast("long").alias("_q_n_lines"),
                F.size(F.array_distinct("_q_lines")).cast("long").alias("_q_own_lines"),
                F.coalesce(F.aggregate(F.transform(where, lambda a, i: F.least(
                    F.lit(3), a - F.coalesce(F.get(where, i - 1), F.lit(-3)))), F.lit(0), lambda total, x: total + x),
                    F.lit(0)).cast("long").alias("_q_repeat"))
    )
    n, lines = F.greatest(F.col("_q_n"), F.lit(1)), F.greatest(F.col("_q_n_lines"), F.lit(1))
    dups = F.col("_q_n_lines") - F.col("_q_own_lines")
    share = lambda count: F.col(count) / F.greatest(F.col("_q_word_chars"), F.lit(1))
    added = {
        "n_words": F.col("_q_n"), "word_chars": F.col("_q_word_chars"), "n_symbols": F.col("_q_symbols"),
        "n_dup_lines": dups, "n_repeat_words": F.col("_q_repeat"),
        "word_length": F.col("_q_word_chars") / n, "symbol_share": share("_q_symbols"),
        "upper_share": share("_q_uppers"), "digit_share": share("_q_digits"), "mark_share": share("_q_marks"),
        "dup_line_share": dups / lines, "repeat_share": F.col("_q_repeat") / n, "line_words": F.col("_q_n") / lines,
    }
    return staged.select(*kept, *[c.alias(prefix + name) for name, c in added.items()])


def base_failed(prefix: str = "") -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    n = F.col(f"{prefix}n_words")
    return (n < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * n)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, prefix: str = "") -> Column:
        c = F.col(f"{prefix}{self.feature}")
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules that reject; what none matches is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def rule(self, prefix: str = "") -> Column:
        """The number, from 1, of the first rule that matches; 0 where none does."""
        out = F.lit(0)
        for i in range(len(self.rules), 0, -1):
            every = F.lit(True)
            for c in self.rules[i - 1]:
                every = every & c.column(prefix)
            out = F.when(every, F.lit(i)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "; ".join(" and ".join(map(str, r)) for r in self.rules) or "keep everything"


def learn(featured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", bins: int = 24,
          max_rules: int = 8, max_conditions: int = 4, min_precision: float = 0.95, min_share: float = 0.002,
          prefix: str = "") -> DecisionList:
    """Learns the rules for the documents that are labelled 0.

    A rule must be right for ``min_precision`` of the rows that it takes, in both folds together (counted with one
    wrong row more), and take ``min_share`` of the labelled rows.
    """
    names = [f"{prefix}{f}" for f in FEATURES]
    marked = (labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").alias("_y")).dropna()
              .groupBy("_id").agg(F.min("_y").alias("_y")))
    rows = (featured.select(F.col(f"`{doc_id}`").alias("_id"), *names).join(marked, "_id")
            .select("_y", (crc32_of_id(F.col("_id")) % 3 == 0).cast("int").alias("_fold"), *names))
    rows = materialise(rows, "labelled")
    cuts = rows.agg(*[F.percentile_approx(n, [i / bins for i in range(1, bins)], 2000).alias(n) for n in names]).first()
    if cuts[0] is None:
        return DecisionList(())
    cuts = [sorted(set(cuts[n])) for n in names]
    binned = F.array(*[sum(((F.col(n) > t).cast("int") for t in cut), F.lit(0)) for n, cut in zip(names, cuts, strict=True)])
    rows = materialise(rows.select("_y", "_fold", binned.alias("_bins")), "binned")

    def holds(condition: tuple[int, bool, int]) -> Column:
        f, above, at = condition
        value = F.col("_bins")[f]
        return value > at if above else value <= at

    def all_hold(conditions) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out & holds(c)
        return out

    def counts(where: Column) -> dict[tuple[int, int, int], tuple[int, int]]:
        found = (rows.where(where).select("_fold", "_y", F.posexplode("_bins").alias("f", "b"))
                 .groupBy("_fold", "f", "b").agg(F.count_if(F.col("_y") == 0).alias("p"),
                                                 F.count_if(F.col("_y") != 0).alias("n")).collect())
        return {(r["_fold"], r["f"], r["b"]): (r["p"], r["n"]) for r in found}

    def total(found, fold: int, f: int, bs) -> tuple[int, int]:
        hit = [found.get((fold, f, b), (0, 0)) for b in bs]
        return sum(x[0] for x in hit), sum(x[1] for x in hit)

    rules: list[tuple[tuple[int, bool, int], ...]] = []
    left = F.lit(True)
    every = sum(sum(total(counts(left), fold, 0, range(bins))) for fold in (0, 1))
    while len(rules) < max_rules:
        rule: list[tuple[int, bool, int]] = []
        stages: list[dict[int, tuple[int, int]]] = []  # by fold, after each condition
        while len(rule) < max_conditions:
            found = counts(left & all_hold(rule))
            p0, n0 = total(found, 0, 0, range(bins))
            if not p0 or (rule and not n0):
                break
            best, best_gain = None, 1e-9
            for f, cut in enumerate(cuts):
                for at in range(len(cut)):
                    for above in (False, True):
                        p, n = total(found, 0, f, range(at + 1, bins) if above else range(at + 1))
                        if p and (gain := p * (math.log2((p + 0.5) / (p + n + 1)) - math.log2((p0 + 0.5) / (p0 + n0 + 1)))) > best_gain:
                            best, best_gain = (f, above, at), gain
            if best is None:
                break
            rule.append(best)
            f, above, at = best
            stages.append({fold: total(found, fold, f, range(at + 1, bins) if above else range(at + 1)) for fold in (0, 1)})
        if not rule:
            break
        # pruning: the shortest beginning that does best on the other fold
        worth = [(s[1][0] - s[1][1]) / (s[1][0] + s[1][1] + 1) for s in stages]
        length = worth.index(max(worth)) + 1
        p, n = (sum(stages[length - 1][fold][i] for fold in (0, 1)) for i in (0, 1))
        if p / (p + n + 1) < min_precision or p + n < min_share * every:
            break
        rules.append(tuple(rule[:length]))
        left = left & ~all_hold(rule[:length])
    return DecisionList(tuple(tuple(Condition(FEATURES[f], above, float(cuts[f][at])) for f, above, at in r) for r in rules))
