"""Word matching and name normalisation as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(words: Sequence[str]) -> str:
    """SQL text of a string array; one parsed expression is much cheaper to build than many literals."""
    if not words:
        return "cast(array() AS array<string>)"
    return "array(" + ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words) + ")"


def literals(words: Sequence[str]) -> Column:
    return F.expr(quoted(words))


def one_of(value: Column, words: Sequence[str]) -> Column:
    return F.array_contains(literals(words), value)


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a constant map, null when absent."""
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in table.items())
    return F.element_at(F.expr(f"map({pairs})"), key)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True when any word occurs anywhere in the text."""
    return text.rlike("|".join(re.escape(w) for w in words)) if words else F.lit(False)


def word_match(text: Column, tokens: Column, words: Sequence[str]) -> Column:
    """Words with an underscore match inside the text, the others must be whole tokens."""
    inside = contains_any(text, [w for w in words if "_" in w])
    return inside | F.arrays_overlap(tokens, literals([w for w in words if "_" not in w]))


def first_match(rules, text: Column, tokens: Column, default: Column) -> Column:
    """Value of the first rule whose words match.

    The rules are one constant array searched by a lambda, which keeps the generated code short.
    """
    rows = ", ".join(
        f"named_struct('value', '{value}', 'whole', {quoted([w for w in words if '_' not in w])},"
        f" 'inside', {quoted([w for w in words if '_' in w])})"
        for value, words in rules
    )
    hits = F.filter(
        F.expr(f"array({rows})"),
        lambda r: F.arrays_overlap(tokens, r["whole"]) | F.exists(r["inside"], lambda w: F.contains(text, w)),
    )
    return F.coalesce(F.get(hits, F.lit(0))["value"], default)


def first_contained(rules, text: Column, default: str) -> Column:
    chain = None
    for value, words in rules:
        hit = contains_any(text, words)
        chain = F.when(hit, F.lit(value)) if chain is None else chain.when(hit, F.lit(value))
    return chain.otherwise(F.lit(default))


def matching_values(rules, test) -> Column:
    """Array of all rule values whose words pass ``test(words)``, in rule order."""
    return F.array_compact(F.array(*[F.when(test(words), F.lit(value)) for value, words in rules]))


def normalize_name(name: Column) -> Column:
    """Drop bracketed units, split camel case, lower-case and join alphanumeric runs by underscores."""
    text = F.regexp_replace(name, r"\[[^\]]*\]", "")
    text = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1_$2")
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), F.lit("_"))


def slug(name: Column) -> Column:
    """Lower-case alphanumeric runs joined by underscores."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot, empty when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")
