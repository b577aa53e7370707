"""Pieces of oracle SQL written from the same vocabularies."""

from __future__ import annotations


def quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return f"CAST({value} AS DOUBLE)" if isinstance(value, float) else str(value)
    return "'" + str(value).replace("'", "''") + "'"


def any_of(text: str, keywords) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(k)})" for k in keywords) + ")"


def any_match(text: str, patterns, options: str = "") -> str:
    flags = f", {quoted(options)}" if options else ""
    return "(" + " OR ".join(f"regexp_matches({text}, {quoted(p)}{flags})" for p in patterns) + ")"


def case_words(text: str, rules, default) -> str:
    arms = " ".join(f"WHEN {any_of(text, kws)} THEN {quoted(label)}" for kws, label in rules)
    return f"CASE {arms} ELSE {default if default == 'NULL' or default.startswith('(') else quoted(default)} END"


def case_patterns(text: str, rules, default) -> str:
    arms = " ".join(f"WHEN regexp_matches({text}, {quoted(p)}) THEN {quoted(label)}" for p, label in rules)
    return f"CASE {arms} ELSE {quoted(default)} END"


def case_equal(value: str, pairs, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {value} = {quoted(k)} THEN {quoted(v)}" for k, v in pairs)
    return f"CASE {arms} ELSE {default} END"


def in_list(value: str, items) -> str:
    return f"{value} IN ({', '.join(quoted(i) for i in items)})"


def hits(text: str, keywords) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {quoted(k)}) AS INTEGER)" for k in keywords) + ")"


def values(name: str, columns: str, rows) -> str:
    """A CTE of literal rows."""
    body = ", ".join("(" + ", ".join(quoted(x) for x in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def words(text: str, least: int) -> str:
    """Distinct words of a-z only, split at anything that is no letter, digit or underscore."""
    return (rf"list_distinct(list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{M}}\p{{N}}_]+'), "
            rf"lambda w: regexp_full_match(w, '[a-z]{{{least},}}')))")


def jaccard(a: str, b: str) -> str:
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / "
            f"(len({a}) + len({b}) - len(list_intersect({a}, {b}))) END")
