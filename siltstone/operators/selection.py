"""Which candidates are judged: quotas by route, diversity by folder, round robin over folders, batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.vocabulary import BATCH, JUDGED, QUOTAS

CAP, EXEMPT, VISIBLE, CONTEXT = 4, 0.96, 0.45, 0.72
#: Parts of a folder that are cut to what can count before the folder is looked at as a whole.
SALTS = 64


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str, most: int | None = None) -> DataFrame:
    """Adds a row's number within its group, and with ``most`` drops rows beyond it.

    Then a large group is first cut in parts, so that no task sorts more than ``most`` rows of each part."""
    own = Window.partitionBy(*by)
    if most is None:
        return df.withColumn(name, F.row_number().over(own.orderBy(*order)))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64("path" if "path" in df.columns else F.struct(*df.columns)), F.lit(SALTS)))
    part = F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))
    first = salted.withColumn("_part", part).where(F.col("_part") <= most).drop("_salt", "_part")
    return first.withColumn(name, F.row_number().over(own.orderBy(*order))).where(F.col(name) <= most)


def round_robin(df: DataFrame, folder: str = "parent", order: str = "seq", per_folder: int | None = None, total: int | None = None) -> DataFrame:
    """Rows in turns over folders, each folder by ``order``, folders by their first; adds turn."""
    limits = [n for n in (per_folder, total) if n is not None]
    df = numbered(df, [folder], [F.col(order)], "turn", min(limits) if limits else None)
    first = F.min(order).over(Window.partitionBy(folder))
    df = df.withColumn("_first", first).orderBy("turn", "_first", order)
    return (df if total is None else df.limit(total)).drop("_first")


def late(nth: Column, name_score: Column) -> Column:
    """Whether a row comes after all others of its route: past its folder's CAP and without a full name match."""
    return (nth > CAP) & (name_score < EXEMPT)


def diverse(df: DataFrame, order: list[Column], by: tuple[str, ...] = ("parent",), most: int | None = None) -> DataFrame:
    """Adds nth (a row's place in its folder) and late; a row with a full name match counts in its folder all the same."""
    return numbered(df, list(by), order, "nth", most).withColumn("late", late(F.col("nth"), F.col("name_score")))


def routed(df: DataFrame) -> DataFrame:
    """A row for each route that a candidate is in, with ``key``, by which and by path the route is ordered."""
    name, content = F.col("name_score"), F.col("content_score")
    text = F.coalesce("text", F.lit("")) != ""
    member = {"name": (name >= VISIBLE) & (name != CONTEXT), "content": content >= VISIBLE, "context": name == CONTEXT, "preview": text & (content < VISIBLE), "explore": F.lit(True)}
    keys = {"explore": F.crc32(F.col("path").cast("binary")).cast("double"), "content": -content}
    ways = [F.when(member[r], F.struct(F.lit(r).alias("route"), keys.get(r, -name).alias("key"))) for r in QUOTAS]
    out = df.select("path", "parent", "name_score", F.explode(F.filter(F.array(*ways), lambda w: w.isNotNull())).alias("w"))
    return out.select("path", "parent", "name_score", "w.route", "w.key")


def select_candidates(df: DataFrame, total: int = JUDGED, excluded: Iterable[str] = (), used: Mapping[str, int] | None = None, of: int = JUDGED) -> DataFrame:
    """path, route and place (from 0) of at most ``total`` rows: each route takes its share of what is left, less what it
    has ``used``, and explore fills up, counting folders anew.

    ``df`` has path, parent, name_score, content_score and text.  One job ranks all routes and keeps, of each, as many
    rows as the choice can see: of the first rows of folders and of the late ones the first ``total`` and its share.
    A second one gets what may move up in the folders of these.  The choice itself goes over these rows only."""
    barred, used = set(excluded), used or {}
    most = total + len(barred)
    order = [F.col("key"), F.col("path")]
    ranked = diverse(routed(df), order, ("route", "parent"), CAP + most + total)
    window = Window.partitionBy("route", "late")
    # Again in two steps, for a route has all rows and one task would sort them.
    salted = ranked.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)))
    place = F.row_number().over(Window.partitionBy("route", "late", "salt").orderBy(*order))
    salted = salted.withColumn("nth_of_salt", place).where(F.col("nth_of_salt") <= most + total).drop("salt", "nth_of_salt")
    first = salted.withColumn("at", F.row_number().over(window.orderBy(*order))).where(F.col("at") <= most + total)
    rows = {(r["route"], r["path"]): r for r in first.collect()}  # at most 10 (2 total + barred)
    folders = df.sparkSession.createDataFrame([(p,) for p in {r["parent"] for r in rows.values()}], "parent string")
    moving = ranked.where("late").join(F.broadcast(folders), "parent", "left_semi")
    rows |= {(r["route"], r["path"]): r for r in moving.collect()}  # at most so many of each of these folders
    routes = {route: sorted((r for (of_route, _), r in rows.items() if of_route == route), key=lambda r: (r["key"], r["path"])) for route in QUOTAS}
    chosen: list[tuple[str, str, int]] = []

    def take(route: str, share: int) -> None:
        seen: Counter = Counter()
        left = [r for r in routes[route] if r["path"] not in barred]
        soon, after = [], []
        for r in left:
            put_off = seen[r["parent"]] >= CAP and r["name_score"] < EXEMPT
            (after if put_off else soon).append(r)
            seen[r["parent"]] += not put_off
        for r in (soon + after)[: max(0, min(share, total - len(chosen)))]:
            barred.add(r["path"])
            chosen.append((r["path"], route, len(chosen)))

    for route, quota in QUOTAS.items():
        take(route, round(quota * of / JUDGED) - used.get(route, 0))
    take("explore", total - len(chosen))
    return df.sparkSession.createDataFrame(chosen, "path string, route string, place int")


def batches(df: DataFrame, order: list[Column], size: int = BATCH) -> DataFrame:
    """Adds batch and idx (both from 0) to the few rows that are judged."""
    at = F.row_number().over(Window.orderBy(*order)) - 1
    return df.withColumn("_at", at).withColumns({"batch": F.floor(F.col("_at") / size), "idx": F.col("_at") % size}).drop("_at")


def answered(batched: DataFrame, answers: DataFrame) -> DataFrame:
    """Candidates with the answers to their keys: ``answers`` has batch, key (f and the place in the batch) and probability."""
    return batched.withColumn("key", F.concat(F.lit("f"), F.col("idx").cast("string"))).join(answers, ["batch", "key"])


def reverse_rank(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds rank: the number of rows for the first, 1 for the last, over the few rows that are shown."""
    every = Window.partitionBy(F.lit(1))
    return df.withColumn("rank", (F.count(F.lit(1)).over(every) - F.row_number().over(every.orderBy(*order)) + 1).cast("int"))
