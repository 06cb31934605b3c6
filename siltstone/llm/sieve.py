"""A filter of fixed size over keys: it lets every listed key pass, and only few others while it is sparse.

It is one row of ``BITS`` bits, built by an aggregation, and so may be broadcast whatever the input.  It saves shuffling
rows that a following join would not match; the join itself decides, so a full sieve costs time and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23
WORDS = BITS // 64


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(BITS).cast("long"))


def sieve(keys: DataFrame, column: str) -> DataFrame:
    """One row with an array of words of bits."""
    at = _place(F.col(column))
    # ``shiftleft`` of a long takes its count modulo 64.
    words = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    every = keys.sparkSession.range(WORDS).select(F.col("id").cast("int").alias("word"))
    full = every.join(words, "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"))
    return full.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bits"]).alias("sieve_words"))


def marked(df: DataFrame, key: Column, built: DataFrame, name: str = "may_match") -> DataFrame:
    """Adds a boolean: false proves that the key is not among those the sieve was built of.

    The sieve enters as a scalar subquery, so that no row carries its words."""
    at = _place(key)
    word = F.get(built.scalar(), F.floor(at / 64).cast("int"))
    return df.withColumn(name, F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
