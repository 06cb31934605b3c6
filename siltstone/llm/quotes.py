"""Chat formatting by quotation linking.

Messages are parsed into their own text and nested quoted passages.  Normalised passages are hashed and joined with the
hashes of what earlier messages of the conversation say themselves; the link gives the message that is replied to.
A quote that no message says as a passage is looked for by its parts: the word n-grams of all its lines and sentences
must be in one earlier message.
Conversations come out in reply order, without quotes.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import cut, map_slices

QUOTED = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.DOTALL)
#: The line that mail programs put above a quote.
ATTRIBUTION = re.compile(r".{0,300}\b(?:wrote|writes|schrieb|escribió|a écrit)\s*:\s*")
#: Where parts of a quote may end: lines, sentences, omissions.
PART = re.compile(r"\n|\[?(?:\.{3,}|…)\]?|(?<=[.!?])\s+|[。！？]")
#: A word; in scripts without blanks, a character.
_UNSPACED = "\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uac00-\ud7af"
WORD = re.compile(f"[{_UNSPACED}]|(?:(?![{_UNSPACED}])\\w)+")
GRAM = 5


class Parsed(NamedTuple):
    own: str
    said: list[str]
    quoted: list[tuple[int, str]]
    #: The n-grams of each quoted passage's parts.
    grams: list[list[int]]


def _gram(words: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode(), digest_size=8).digest(), "big", signed=True)


def quoted_grams(passage: str) -> list[int]:
    """Of each part all n-grams of GRAM words, of a shorter part the one of all its words."""
    parts = [WORD.findall(p.casefold()) for p in PART.split(passage)]
    return sorted({_gram(w[i : i + GRAM]) for w in parts if w for i in range(max(len(w) - GRAM + 1, 1))})


def said_grams(text: str) -> list[int]:
    """All n-grams of one to GRAM words."""
    w = WORD.findall(text.casefold())
    return sorted({_gram(w[i : i + k]) for k in range(1, GRAM + 1) for i in range(len(w) - k + 1)})


def normalised(passage: str) -> str:
    """Case, white space and the emptiness at either end do not count."""
    return " ".join(passage.casefold().split())


def parse(text: str | None) -> Parsed:
    """A message's own text; its own passages; its quoted passages with their levels (1 is the outermost).

    A passage is a run of lines of one level, and each of its paragraphs (parts between empty lines)."""
    runs: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        m = QUOTED.fullmatch(line)
        level, body = (m[1].count(">"), m[2]) if m else (0, line)
        if runs and runs[-1][0] == level:
            runs[-1][1].append(body)
        else:
            if level and runs and not runs[-1][0]:
                before = runs[-1][1]
                at = max((i for i, x in enumerate(before) if x.strip()), default=None)
                if at is not None and ATTRIBUTION.fullmatch(before[at]):
                    del before[at:]
            runs.append((level, [body]))
    own, said, quoted, grams = [], [], [], {}
    for level, body in runs:
        whole = "\n".join(body)
        parts = [p for p in re.split(r"\n[ \t]*\n", whole) if p.strip()]
        if not level:
            own.append(whole)
        target = quoted if level else said
        for p in dict.fromkeys([whole, *parts]):
            if n := normalised(p):
                target.append((level, n) if level else n)
                if level:
                    grams.setdefault((level, n), quoted_grams(p))
    if not quoted:
        return Parsed(text or "", list(dict.fromkeys(said)), [], [])
    mine = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n")
    if n := normalised(mine):
        said.append(n)
    return Parsed(mine, list(dict.fromkeys(said)), list(grams), list(grams.values()))


def _hash(passage: str) -> bytes:
    return hashlib.md5(passage.encode()).digest()


def parsed(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, own text, said (hashes) and quoted (levels with hashes and n-grams) of every message."""
    source = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "conv_id long, turn long, role string, text string, said array<binary>, quoted array<struct<level:int,hash:binary,grams:array<long>>>"
    kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.binary()), ("grams", pa.list_(pa.int64()))]))

    def work():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            found = [parse(x) for x in part.column("text").to_pylist()]
            return pa.RecordBatch.from_pydict({
                "conv_id": part.column("conv_id"), "turn": part.column("turn"), "role": part.column("role"), "text": pa.array([p.own for p in found], pa.string()),
                "said": pa.array([[_hash(x) for x in p.said] for p in found], pa.list_(pa.binary())),
                "quoted": pa.array([[{"level": k, "hash": _hash(x), "grams": g} for (k, x), g in zip(p.quoted, p.grams)] for p in found], kind),
            })

        return step

    return map_slices(source, "text", schema, work)


def part_sources(messages: DataFrame, pending: DataFrame) -> DataFrame:
    """conv_id, turn, level, hash and source: the first earlier message that has all n-grams of a quote.

    A quote is compared only with messages that have the n-gram of it which the fewest have."""
    key = ["conv_id", "turn", "level", "hash"]

    def work():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            grams = pa.array([said_grams(x) for x in part.column("text").to_pylist()], pa.list_(pa.int64()))
            return pa.RecordBatch.from_pydict({"conv_id": part.column("conv_id"), "source": part.column("turn"), "had": grams})

        return step

    own = messages.select("conv_id", "turn", "text").join(pending.select("conv_id").distinct(), "conv_id", "left_semi")
    said = cut(map_slices(own, "text", "conv_id long, source long, had array<long>", work))
    wanted = pending.select(*key, F.explode("grams").alias("gram"))
    met = cut(said.select("conv_id", "source", F.explode("had").alias("gram")).join(wanted.select("conv_id", "gram").distinct(), ["conv_id", "gram"], "left_semi").distinct())
    counts = met.groupBy("conv_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(counts, ["conv_id", "gram"]).groupBy(*key).agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count(F.lit(1)).alias("n_met"))
    likely = rarest.join(met, ["conv_id", "gram"]).where("source < turn").join(pending, key).where("n_met = size(grams)")
    whole = likely.join(said, ["conv_id", "source"]).where(F.size(F.array_except("grams", "had")) == 0)
    return whole.groupBy(*key).agg(F.min("source").alias("source"))


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, n_linked and parent_turn of messages with a quote that an earlier message of theirs says first, as
    a passage of its own or else in parts.

    The parent is the latest source among the outermost quotes that have one."""
    key = ("conv_id", "turn", "level", "hash")
    asked = messages.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.level", "q.hash", "q.grams").distinct()
    first = messages.select("conv_id", "turn", F.explode("said").alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    asked = cut(asked.join(first, ["conv_id", "hash"], "left").where("conv_id is not null and turn is not null"))
    found = asked.where("source < turn").select(*key, "source")
    pending = asked.where("(source is null or source >= turn) and size(grams) > 0").drop("source")
    if pending.limit(1).count():
        found = found.unionByName(part_sources(messages, pending))
    per = found.groupBy("conv_id", "turn", "level").agg(F.count(F.lit(1)).alias("n"), F.max("source").alias("source"))
    return per.groupBy("conv_id", "turn").agg(F.sum("n").alias("n_linked"), F.min_by("source", "level").alias("parent_turn"))


def roots(found: DataFrame) -> DataFrame:
    """Adds root_turn and depth by doubling: each round a message takes over what its present root points to."""
    state = cut(found.withColumns({"root_turn": F.col("parent_turn"), "depth": F.lit(1).cast("long")}))
    while True:
        up = state.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        joined = state.join(up, (F.col("conv_id") == F.col("c")) & (F.col("root_turn") == F.col("t")), "left")
        moved = joined.select("conv_id", "turn", "n_linked", "parent_turn", F.coalesce("next", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"))
        moved = cut(moved)
        done = moved.where("moved").limit(1).count() == 0
        state = moved.drop("moved")
        if done:
            return state


def reply_ordered(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n_quotes, n_linked, parent_turn, root_turn and depth of every message, in reply order.

    ``text`` has no quotes (nor the line that announces one); without quotes it is the message as it was.  The order is
    by conversation, then by the turn of the message at which the chain of replies begins, then by turn, so that
    a reply follows what it answers; the result is sorted by range, and a long conversation lies in several partitions.
    A message without a linked quote begins a chain: it has no parent, its own turn as root and depth 0.  Null texts
    count as empty; messages with a null conversation or turn are never linked; rows with equal conversation and turn
    share their links; other columns are not read; an empty table gives no rows.
    """
    messages = parsed(df)
    found = roots(links(messages))
    out = messages.select("conv_id", "turn", "role", "text", F.size("quoted").cast("long").alias("n_quotes")).join(found, ["conv_id", "turn"], "left")
    out = out.withColumns({"n_linked": F.coalesce("n_linked", F.lit(0).cast("long")), "root_turn": F.coalesce("root_turn", "turn"), "depth": F.coalesce("depth", F.lit(0).cast("long"))})
    return out.select("conv_id", "turn", "role", "text", "n_quotes", "n_linked", "parent_turn", "root_turn", "depth").orderBy("conv_id", "root_turn", "turn", "role", "text")
