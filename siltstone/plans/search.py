"""Searching a folder: the three modes over a fresh inventory, each file read once."""

from __future__ import annotations

import os
import threading
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import files, scoring
from siltstone.functions.text import Query
from siltstone.functions.vocabulary import BATCH, JUDGED, RESULTS, SAMPLED_EXTENSIONS, SNIPPET, THRESHOLD
from siltstone.operators import bm25, results, selection
from siltstone.operators.judge import Judge
from siltstone.sources import extract
from siltstone.sources.inventory import scanned
from siltstone.sources.scratch import Scratch

SHOWN = ("path", "relative", "name", "kind", "modified", "score", "source", "coverage", "text")
#: What of an entry is read in a fast search: so many texts and so many documents, in turns over folders.
PROBED_TEXTS, PROBED_DOCUMENTS, PROBED_TEXT = 384, 16, 1_000
# Bytes that all excerpts of a search may have, less what reading takes.
EXCERPTS, RESERVED = 500_000, 160_000


@dataclass(frozen=True)
class Options:
    include_generated: bool = False
    read_contents: bool = True
    batch_size: int = BATCH
    threshold: float = THRESHOLD
    mode: str = "streaming"
    candidate_limit: int = JUDGED


class Stopped(Exception):
    """The search was cancelled."""


def with_evidence(records: DataFrame, question: str, options: Options, budget: extract.Budget = extract.THOROUGH) -> DataFrame:
    """Adds text and coverage, read on the executors."""
    generated = options.include_generated

    @F.udf("text string, coverage string", useArrow=True)
    def read(path):
        return extract.evidence(path, question, True, budget, generated)

    closed = F.struct(F.lit("").alias("text"), F.lit("name_only").alias("coverage"))
    open_ = ~(F.col("symlink") | F.col("placeholder"))
    seen = F.when(open_, read("path")).otherwise(closed) if options.read_contents else closed
    return records.withColumn("e", seen).select("*", "e.text", "e.coverage").drop("e")


def with_counts(records: DataFrame, question: str, options: Options) -> DataFrame:
    """Adds len and tf (stemmed tokens of the relative path and the contents, and how many of them are the query's) and
    coverage.  Texts are counted whole, PDF and Office files by their excerpt."""
    phrases, generated = Query(question).terms, options.include_generated

    @F.udf("len long, tf array<long>, coverage string, bytes long", useArrow=True)
    def count(path, relative, name, readable):
        length, found = extract.text_counts(relative, phrases)
        coverage, own, size = "name_only", None, 0
        if readable and extract.is_text(name):
            own = extract.phrase_counts(path, phrases)
            coverage = "unavailable" if own is None else "text"
            size = os.lstat(path).st_size if own else 0
        elif readable and os.path.splitext(name)[1].lower() in SAMPLED_EXTENSIONS:
            text, _ = extract.evidence(path, question, True, extract.QUICK, generated)
            own = extract.text_counts(text, phrases) if text else None
            coverage = "sampled" if text else "unavailable"
        if own:
            length, found = length + own[0], [a + b for a, b in zip(found, own[1])]
        return length, found, coverage, size

    readable = F.lit(options.read_contents) & ~F.col("symlink") & ~F.col("placeholder") & (F.col("kind") != "folder")
    return records.withColumn("c", count("path", "relative", "name", readable)).select("*", "c.*").drop("c")


def ranked(counts: DataFrame, query: Query) -> DataFrame:
    """The best RESULTS of ``with_counts``: full name matches first, then by score, then by path; with score and source."""
    n = len(query.terms)
    name = scoring.alias_score(F.col("relative"), query)
    both = counts.crossJoin(F.broadcast(bm25.statistics(counts, n))).withColumn("name_score", name)
    kept = both.where(F.exists("tf", lambda x: x > 0) | (F.col("name_score") >= 0.91))
    priority = F.when(F.col("name_score") == 1, 0).when(F.col("name_score") >= 0.91, 1).otherwise(2)
    source = F.when(F.col("name_score") >= 0.45, "name").otherwise("content")
    out = kept.withColumns({"score": F.round(bm25.score(n), 6), "priority": priority, "source": source})
    return out.orderBy("priority", F.desc("score"), "relative").limit(RESULTS)


def _passages(rows: list[dict], question: str, options: Options, spark: SparkSession) -> None:
    """Fills in the text of ranked rows, made on the executors from the files as they are now."""
    if not rows or not options.read_contents:
        return
    generated = options.include_generated

    @F.udf("text string, coverage string", useArrow=True)
    def passage(path, coverage):
        try:
            if coverage == "text":
                return extract.passage(path, question), coverage
            text, seen = extract.evidence(path, question, True, extract.QUICK, generated)
            return text[:SNIPPET], coverage if text else seen
        except (OSError, UnicodeError, extract.Unreadable):
            return "", "unavailable"

    given = spark.createDataFrame([(r["path"], r["coverage"]) for r in rows], "path string, coverage string").repartition(min(len(rows), 32))
    made = {r["path"]: r["p"] for r in given.select("path", passage("path", "coverage").alias("p")).collect()}  # at most JUDGED rows
    if sum(len(p["text"].encode()) for p in made.values()) + RESERVED > EXCERPTS:
        raise ValueError("the excerpts exceed their budget")
    for row in rows:
        row["text"], row["coverage"] = made[row["path"]]["text"], made[row["path"]]["coverage"]


def _streaming(spark: SparkSession, root: str, question: str, options: Options, keep: Scratch, stats: dict) -> list[dict]:
    """Ranked rows.  Secret files are dropped before anything is counted."""
    query = Query(question)
    seen = scanned(spark, root, options.include_generated)
    secret = files.sensitive(F.col("name"))
    listed = F.col("status") == "listed"
    counted = with_counts(seen.where(listed & ~secret), question, options)
    rest = seen.where(~listed | secret).withColumn("coverage", F.when(listed, "protected").otherwise(F.col("status")))
    every = keep(counted.unionByName(rest, allowMissingColumns=True))
    stats |= scan_counts(every)
    rows = [r.asDict() for r in ranked(every.where("len is not null"), query).withColumn("text", F.lit("")).select(*SHOWN).collect()]  # at most RESULTS
    _passages(rows[: options.candidate_limit], question, options, spark)
    return rows


def scan_counts(every: DataFrame) -> dict:
    """How many entries were listed, read, sampled and so on, and how many folders were excluded or entries unreadable."""
    is_ = lambda name: F.count_if(F.col("coverage") == name).alias(name)
    listed = F.count_if(F.col("status") == "listed").alias("scanned")
    row = every.agg(listed, *[is_(c) for c in (*results.COVERAGES, "excluded", "unreadable")], F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytesRead")).first()
    return row.asDict()


def evaluated(spark: SparkSession, root: str, question: str, options: Options, keep: Scratch, stats: dict) -> DataFrame:
    """Every record with text, coverage, and the score and source by which it is shown without a judge (0 if it isn't).

    ``deep`` reads all, ``fast`` so many texts and documents, in turns over folders."""
    query = Query(question)
    seen = scanned(spark, root, options.include_generated)
    secret = files.sensitive(F.col("name"))
    listed = seen.where("status = 'listed'").withColumn("protected", secret)
    open_ = listed.where("not protected").drop("protected")
    if options.mode == "fast":
        extension = files.suffix(F.col("name"))
        rel = F.col("relative")
        plain = open_.where(~F.col("symlink") & ~F.col("placeholder") & (F.col("kind") != "folder"))
        plain = plain.select("path", files.parent(rel).alias("parent"), rel.alias("seq"), extension.isin(SAMPLED_EXTENSIONS).alias("document"), files.is_text(F.col("name")).alias("is_text"))
        texts = selection.round_robin(plain.where("is_text and not document"), total=PROBED_TEXTS)
        documents = selection.round_robin(plain.where("document"), total=PROBED_DOCUMENTS)
        probed = keep(texts.unionByName(documents).select("path"))  # at most 400 rows
        read = with_evidence(open_.join(F.broadcast(probed), "path", "left_semi"), query.expanded, options, extract.QUICK)
        read = read.withColumn("text", F.substring("text", 1, PROBED_TEXT))
        rest = open_.join(F.broadcast(probed), "path", "left_anti").withColumns({"text": F.lit(""), "coverage": F.lit("name_only")})
        open_ = read.unionByName(rest)
    else:
        open_ = with_evidence(open_, question, options)
    hidden = listed.where("protected").drop("protected").withColumns({"text": F.lit(""), "coverage": F.lit("protected")})
    out = open_.unionByName(hidden).withColumn("v", scoring.visibility(F.col("relative"), F.col("text"), query)).select("*", "v.score", "v.source").drop("v")
    other = seen.where("status != 'listed'").withColumn("coverage", F.col("status"))
    every = keep(out.unionByName(other, allowMissingColumns=True).withColumn("bytes", F.octet_length("text").cast("long")))
    stats |= scan_counts(every)
    return every.where("status = 'listed'")


def candidates(every: DataFrame, question: str, options: Options, stats: dict) -> Iterator[dict]:
    """What is judged, in order.  ``deep``: all but secret files, best names first, then shallower and newer ones, a
    partition at a time.  ``fast``: at most ``candidate_limit`` by the quotas of the routes, some without any match."""
    query, open_, rel = Query(question), every.where("coverage != 'protected'"), F.col("relative")
    if options.mode == "deep":
        order = [F.desc(scoring.name_score(rel, query)), files.depth(rel), F.desc(F.coalesce("modified", F.lit(0.0))), rel]
        yield from (r.asDict() for r in open_.orderBy(*order).select(*SHOWN).toLocalIterator())
        return
    scored = open_.select("*", files.parent(rel).alias("parent"), scoring.alias_score(rel, query).alias("name_score"), scoring.content_score(F.col("text"), query).alias("content_score"))
    chosen = selection.select_candidates(scored.drop("path").withColumnRenamed("relative", "path"), options.candidate_limit)
    rows = chosen.select("place", "route", F.col("path").alias("relative")).join(open_.select(*SHOWN), "relative").orderBy("place").collect()  # at most candidate_limit
    stats["routes"] = {}
    for row in rows:
        stats["routes"][row["route"]] = stats["routes"].get(row["route"], 0) + 1
        yield {c: row[c] for c in SHOWN}


_HITS = T.StructType([T.StructField(c, T.DoubleType() if c in ("modified", "score", "probability") else T.StringType()) for c in (*SHOWN, "probability")])


def _frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(c) for c in (*SHOWN, "probability")) for r in rows], _HITS)


def local_hits(spark: SparkSession, root: str, question: str, options: Options = Options()) -> DataFrame:
    """What is found without a judge, best first, at most RESULTS."""
    return search(spark, root, question, options)[0].drop("probability")


def search(spark: SparkSession, root: str, question: str, options: Options = Options(), judge: Judge | None = None, stats: dict | None = None, stop: threading.Event | None = None) -> tuple[DataFrame, str]:
    """Hits in result order, at most RESULTS, and the phase (complete, partial or stopped).  ``stats`` takes the counts.

    ``streaming`` ranks by BM25 over paths and whole contents, full name matches first; a judge sees the first
    ``candidate_limit`` and only reorders.  ``fast`` and ``deep`` show name matches and contents that have the very
    phrase; with a judge (on the driver, so that the budget is one) ``deep`` has every record judged that isn't secret and
    ``fast`` a choice by routes, whether or not they are hits.  Without a judge they go by names alone."""
    if not question.strip():
        raise ValueError("the query is empty")
    stats = {} if stats is None else stats
    if judge is not None and stop is not None:
        judge.stop = stop

    def go_on():
        if stop is not None and stop.is_set():
            raise Stopped

    with Scratch(spark) as keep:
        go_on()
        if options.mode == "streaming":
            rows = _streaming(spark, root, question, options, keep, stats)
            go_on()
            first = [r for r in rows[: options.candidate_limit] if r["coverage"] != "protected"]
            found, phase = judge(first, question, options.batch_size) if judge else ({}, "complete")
            place = {r["path"]: k for k, r in enumerate(rows)}
            out = [r | {"probability": found.get(r["path"])} for r in rows]
            # Verified ones by probability, then the others in the order of their rank.
            out.sort(key=lambda r: (r["probability"] is None, -(r["probability"] or 0.0), place[r["path"]]))
            return _frame(spark, out), phase
        local = options if judge is not None else Options(**(vars(options) | {"read_contents": False}))
        every = evaluated(spark, root, question, local, keep, stats)
        go_on()
        found, phase = judge(candidates(every, question, options, stats), question, options.batch_size) if judge else ({}, "complete")
        verdicts = spark.createDataFrame(list(found.items()), "path string, probability double")
        shown = (F.col("probability") >= options.threshold) | (F.col("probability").isNull() & (F.col("score") > 0))
        merged = every.select(*SHOWN).join(verdicts, "path", "left").where(shown)
        merged = merged.withColumns({"rank": F.coalesce("probability", "score"), "depth": files.depth(F.col("relative"))})
        rows = results.ordered(merged).select(*SHOWN, "probability").collect()  # at most RESULTS
        return _frame(spark, [r.asDict() for r in rows]), phase
