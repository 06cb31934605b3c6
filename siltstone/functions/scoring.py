"""Lexical scores of names, paths and contents against a query, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.files import name_of, stem
from siltstone.functions.text import Query, normalized, without_stop_words, word_tokens


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _hit(groups: list[list[str]], tokens: Column) -> Column:
    return sum((F.arrays_overlap(_words(g), tokens).cast("int") for g in groups), F.lit(0))


def name_score(path: Column, query: Query, ascii_only: bool = False) -> Column:
    """1 for the very name or stem, .91 for all words in the name, .45 to .7 for some, .72 for all in the path."""
    name = name_of(path)
    low = F.lower if ascii_only else normalized
    exact = (low(name) == query.normalized) | (low(stem(name)) == query.normalized)
    if not query.words:
        return F.when(exact, 1.0).otherwise(0.0)
    n = len(query.words)
    here = F.size(F.array_intersect(_words(query.words), word_tokens(name, ascii_only)))
    there = F.size(F.array_intersect(_words(query.words), word_tokens(path, ascii_only)))
    return F.when(exact, 1.0).when(here == n, 0.91).when(here > 0, F.lit(0.45) + F.lit(0.25) * here / n).when(there == n, 0.72).otherwise(0.0)


def alias_score(path: Column, query: Query, ascii_only: bool = False) -> Column:
    """The name score, raised to .82 or .72 where every alias group is met in the name or in the path."""
    base = name_score(path, query, ascii_only)
    if not query.groups or all(len(g) == 1 for g in query.groups):
        return base
    n = len(query.groups)
    by_name, by_path = (_hit(query.groups, word_tokens(x, ascii_only)) == n for x in (name_of(path), path))
    return F.when(base >= 0.72, base).when(by_name, F.greatest(base, F.lit(0.82))).when(by_path, F.greatest(base, F.lit(0.72))).otherwise(base)


def content_score(text: Column, query: Query, ascii_only: bool = False) -> Column:
    """.48 to .86 by the share of alias groups in the text, 0 without any."""
    if not query.groups:
        return F.lit(0.0)
    met = _hit(query.groups, word_tokens(F.coalesce(text, F.lit("")), ascii_only))
    return F.when(met > 0, F.lit(0.48) + F.lit(0.38) * met / len(query.groups)).otherwise(0.0)


def phrase_in(text: Column, query: Query, ascii_only: bool = False) -> Column:
    """Whether the query's words follow one another in the text, stop words aside."""
    if not query.phrase:
        return F.lit(False)
    kept = F.array_join(without_stop_words(word_tokens(F.coalesce(text, F.lit("")), ascii_only)), " ")
    return F.contains(F.concat(F.lit(" "), kept, F.lit(" ")), F.lit(f" {query.phrase} "))


def visibility(path: Column, text: Column, query: Query, ascii_only: bool = False) -> Column:
    """Struct of score and match source: what is shown before anything is judged."""
    name = name_of(path)
    low = F.lower if ascii_only else normalized
    exact = (low(name) == query.normalized) | (low(stem(name)) == query.normalized)
    every = F.size(F.array_intersect(_words(query.words), word_tokens(name, ascii_only))) == len(query.words) if query.words else F.lit(False)
    shown = lambda score, source: F.struct(F.lit(score).alias("score"), F.lit(source).alias("source"))
    return F.when(exact, shown(1.0, "name")).when(every, shown(0.91, "name")).when(phrase_in(text, query, ascii_only), shown(0.86, "content")).otherwise(shown(0.0, "semantic"))
