"""Sharding by a keyed permutation of global row numbers, in DataFrame functions only.

Rows are numbered 0 to n-1 by what identifies them.  A Feistel network permutes the numbers of a grid a x b that barely
holds n (a is the root of n, rounded up), and a number that leaves the range walks on until it is back.  Place p goes to
shard p mod s, slot p div s, so that counts are at most one apart and either is computable from the number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.batches import cut

SHARDS = 16
SEED = 20_250_101
ROUNDS = 6
#: Distinct rows that one task numbers, on average.
BUCKET_ROWS = 50_000
LEAST_BUCKETS = 256
#: Equal rows that one step expands.
BLOCK = 65_536
#: Bits of the mixing arithmetic: products stay within 62 bits.
BITS = 1 << 31


def mix(x: Column, key: int) -> Column:
    """A keyed hash to 31 bits in plain integer arithmetic, the same in any SQL engine."""
    y = (F.pmod(x, F.lit(BITS)) * F.lit(1_103_515_245) + F.lit(key % BITS)) % F.lit(BITS)
    y = y.bitwiseXOR(F.shiftright(y, 15))
    y = (y * F.lit(69_069) + F.lit((key // 7) % BITS)) % F.lit(BITS)
    return y.bitwiseXOR(F.shiftright(y, 13))


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [(seed * 2_654_435_761 + r * 40_503_977 + 12_345) % BITS for r in range(rounds)]


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def feistel(x: Column, n: int, seed: int = SEED) -> Column:
    """One pass over the grid: each round shifts one half by a hash of the other, so it is a bijection."""
    a, b = grid(n)
    step = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), (x % F.lit(b)).alias("r"))
    keys = F.array(*[F.struct(F.lit(r % 2).alias("side"), F.lit(k).cast("long").alias("k")) for r, k in enumerate(round_keys(seed))])

    def turn(s: Column, k: Column) -> Column:
        y = F.when(k["side"] == 0, s["r"]).otherwise(s["l"])
        y = (F.pmod(y, F.lit(BITS)) * F.lit(1_103_515_245) + k["k"]) % F.lit(BITS)
        y = y.bitwiseXOR(F.shiftright(y, 15))
        y = (y * F.lit(69_069) + F.floor(k["k"] / F.lit(7)).cast("long")) % F.lit(BITS)
        y = y.bitwiseXOR(F.shiftright(y, 13))
        return F.struct(
            F.when(k["side"] == 0, (s["l"] + y) % F.lit(a)).otherwise(s["l"]).alias("l"), F.when(k["side"] == 0, s["r"]).otherwise((s["r"] + y) % F.lit(b)).alias("r")
        )

    return F.aggregate(keys, step, turn, lambda s: s["l"] * F.lit(b) + s["r"])


def permuted(number: Column, n: int, seed: int = SEED) -> Column:
    """The place of a row number.  The grid has fewer than a numbers too many, so that a walk ends after as many steps at
    most.  All rows walk up to 64 steps, of which most take none; what is still outside then, in practice nothing, walks
    on over the whole bound."""
    a, b = grid(n)
    most = a * b - n

    def walked(place: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), place, lambda p, _: F.when(p < n, p).otherwise(feistel(p, n, seed)))

    place = feistel(number, n, seed)
    if most:
        place = walked(place, min(most, 64))
    if most > 64:
        place = F.when(place < n, place).otherwise(walked(place, most - 64))
    return place


def numbered(keys: DataFrame, by: list[str], copies: str) -> tuple[DataFrame, int]:
    """Distinct ``keys`` with ``first``, the global number of the first of their copies, and the number of rows.

    The order is: bucket of a hash of the keys, then the keys; a hot first key is dealt by the others.  Only counts of
    buckets meet in one task.
    """
    distinct, rows = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(copies), F.lit(0))).first()
    buckets = bucket_count(distinct)
    keys = keys.withColumn("bucket", bucket_of([F.col(c) for c in by], buckets))
    per = keys.groupBy("bucket").agg(F.sum(copies).alias("rows"))
    per = per.select("bucket", (F.sum("rows").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("before"))
    own = Window.partitionBy("bucket").orderBy(*[F.col(c).asc_nulls_first() for c in by])
    keys = keys.withColumn("own", F.sum(copies).over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col(copies))
    return keys.join(per, "bucket").withColumn("first", F.col("before") + F.col("own")).drop("bucket", "before", "own"), rows


def bucket_count(distinct: int) -> int:
    return max(LEAST_BUCKETS, -(-distinct // BUCKET_ROWS))


def bucket_of(keys: list[Column], buckets: int) -> Column:
    total = sum((F.coalesce(k, F.lit(0)).cast("long") % F.lit(BITS) for k in keys), F.lit(0).cast("long"))
    return F.pmod(mix(total, SEED), F.lit(buckets))


def shard_documents(df: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row, under the law ``rows``.

    The size is the text's UTF-8 bytes plus 1; a null text has size 1 and the checksum of no bytes.  Rows that agree in
    doc_id, size and checksum are interchangeable: they get different places, none of them favoured.  A null doc_id
    sorts first.  An empty table gives no rows.  Other columns are not read.  Places depend on the rows present and the
    seed alone, not on partitions or files, so a lost task recomputes the same ones.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keys = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    keys = cut(keys.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")))
    keys, n = numbered(keys, ["doc_id", "size", "text_crc32"], "copies")
    blocks = keys.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(BLOCK).cast("long"))))
    number = F.explode(F.sequence(F.col("first") + F.col("from"), F.col("first") + F.least(F.col("from") + BLOCK, F.col("copies")) - 1))
    placed = blocks.select("doc_id", "size", "text_crc32", number.alias("number")).withColumn("place", permuted(F.col("number"), n, seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
