"""BM25 at query time: corpus statistics and scores in one plan, nothing stored between queries.

Each text is cut into tokens once: a generator makes its length and counts, which the optimizer can't repeat for filters,
and statistics and scores read the same exchange of these few numbers a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import ranked_tokens
from siltstone.functions.vocabulary import B, IDF_FLOOR, K1, RESULTS


def _numbers(tokens: Column, words: list[str]) -> Column:
    tf = [F.size(F.filter(tokens, (lambda w: lambda t: t == w)(w))).cast("long") for w in words]
    return F.struct(F.size(tokens).cast("long").alias("len"), (F.array(*tf) if tf else F.array().cast("array<long>")).alias("tf"))


def term_counts(df: DataFrame, words: list[str], text: str = "text", tokens: Column | None = None) -> DataFrame:
    """The input's other columns, len and tf (an array, one count a word) of every document."""
    tokens = ranked_tokens(F.coalesce(F.col(text), F.lit(""))) if tokens is None else tokens
    made = F.explode(F.transform(F.array(tokens), lambda t: _numbers(t, words)))
    others = [F.col(f"`{c}`") for c in df.columns if c != text]
    return df.select(*others, made.alias("_n")).select(*others, "_n.len", "_n.tf")


def phrase_counts(df: DataFrame, phrase: list[str], text: str = "text", name: str = "n") -> DataFrame:
    """The input's other columns and how often a phrase of several words occurs."""
    end = len(phrase)

    def places(t: Column) -> Column:
        return F.size(F.filter(F.transform(t, lambda _, i: F.slice(t, i + 1, end) == F.array(*map(F.lit, phrase))), lambda x: x)).cast("long")

    made = F.explode(F.transform(F.array(ranked_tokens(F.coalesce(F.col(text), F.lit("")))), places))
    others = [F.col(f"`{c}`") for c in df.columns if c != text]
    return df.select(*others, made.alias(name))


def shared(counts: DataFrame, key: str) -> DataFrame:
    """The same rows behind an exchange: all that reads them in one plan reads its output."""
    return counts.repartition(F.col(f"`{key}`"))


def statistics(counts: DataFrame, n: int) -> DataFrame:
    """One row: docs, avg_len and df (an array)."""
    df = [F.count_if(F.get("tf", F.lit(k)) > 0) for k in range(n)]
    return counts.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"), (F.array(*df) if df else F.array().cast("array<long>")).alias("df"))


def idf(docs: Column, df: Column) -> Column:
    raw = F.ln((docs - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, IDF_FLOOR).otherwise(raw)


def score(n: int) -> Column:
    """The sum over words, from columns tf, len, docs, avg_len and df."""
    norm = F.when(F.col("avg_len") == 0, F.lit(K1)).otherwise(K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    parts = [idf(F.col("docs"), F.get("df", F.lit(k))) * F.get("tf", F.lit(k)) * (K1 + 1) / (F.get("tf", F.lit(k)) + norm) for k in range(n)]
    return sum(parts[1:], parts[0]) if parts else F.lit(0.0)


def scored(counts: DataFrame, n: int) -> DataFrame:
    """Documents with a word, with score (six digits); the statistics are one row, so their join is a broadcast.

    A score is positive just where a word is met.  The condition needs the statistics, and so stays behind the exchange."""
    both = counts.crossJoin(F.broadcast(statistics(counts, n))).withColumn("score", score(n))
    return both.where("score > 0").withColumn("score", F.round("score", 6))


def top(df: DataFrame, words: list[str], id_col: str = "doc_id", text: str = "text", limit: int = RESULTS) -> DataFrame:
    """id and score of the best documents, ties by id."""
    if not 0 <= limit <= RESULTS:
        raise ValueError(f"the limit must be 0 to {RESULTS}")
    counts = shared(term_counts(df.select(id_col, text), words, text), id_col)
    return scored(counts, len(words)).select(id_col, "score").orderBy(F.desc("score"), id_col).limit(limit)
