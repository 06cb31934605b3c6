"""Benchmark decontamination by one Aho-Corasick automaton over the windows of all test items.

Texts are lower-cased in A-Z and cut into words, each of which becomes three characters: the digits of its number among the
items' words, or NULs for any other.  The automaton goes over these, so that it has three nodes a word and not one a letter,
and none with more than a few dozen followers, which it looks through one by one; each text is scanned once.  Hits are word positions, which map back to code points of the original text.  The items are sent to the
workers only while their bytes stay under a bound; beyond it they go through in blocks of that bound, and the blocks' hits
are put together, which gives the same rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import cut, documents, map_slices, slices

WINDOW = 10
#: Bytes of item texts in one automaton.  A window has thirty nodes of some 40 bytes, and an item's byte is a sixth
#: of a window, so that this is some 200 MB a worker at most.
AUTOMATON_BYTES = 1 << 20

#: Of UTF-8 bytes: A-Z to lower case, other word bytes as they are, the rest to blanks.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def windows(text: str | None, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """An item's windows; a shorter item is one window."""
    item = tuple(words(text))
    return [item[i : i + size] for i in range(max(1, len(item) - size + 1))] if item else []


DIGITS = 3
OTHER = "\0" * DIGITS


def code(k: int) -> str:
    """The number k as digits of 64, the highest first; each place has characters of its own, so that no match begins
    within a word."""
    return chr(0x100 + (k >> 12)) + chr(0x30 + (k >> 6 & 63)) + chr(0x80 + (k & 63))


class Scanner:
    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        import ahocorasick

        self.of: dict[bytes, str] = {}
        found: dict[str, set[str]] = {}
        for item, text in items:
            for window in windows(text, size):
                found.setdefault("".join([self.of.setdefault(w, code(len(self.of))) for w in window]), set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for window, names in found.items():
            self.automaton.add_word(window, (len(window) // DIGITS, tuple(sorted(names))))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def __call__(self, text: str) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Words of a text, disjoint intervals of hit word positions, and the items with a window in it."""
        own = words(text)
        if not self.any or not own:
            return len(own), [], []
        of = self.of.get
        spans, names = [], set()
        for end, (width, items) in self.automaton.iter("".join([of(w, OTHER) for w in own])):
            last = end // DIGITS
            names.update(items)
            spans.append((last - width + 1, last + 1))
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return len(own), merged, sorted(names)


def placed(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    """Intervals of words, each with its start and end in code points of the original text."""
    if not spans:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [[a, b, at[a][0], at[b - 1][1]] for a, b in spans]


def _united(spans: Column) -> Column:
    """Sorted intervals as ``placed`` has them, those that meet or overlap made one."""
    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        one = F.array(last[0], F.greatest(last[1], s[1]), last[2], F.greatest(last[3], s[3]))
        return F.when((F.size(done) > 0) & (s[0] <= F.get(F.get(done, F.size(done) - 1), F.lit(1))), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(one))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<array<long>>"), add)


def _scan(docs: DataFrame, items: list[tuple[str, str]], size: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def work():
        scan = Scanner(sent.value, size)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = part.column("text").to_pylist()
            found = [scan(x) for x in texts]
            return pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id").cast(pa.int64()),
                "text_key": pa.array([hashlib.md5(x.encode()).hexdigest() if s else "" for x, (_, s, _) in zip(texts, found)]),
                "n_words": pa.array([n for n, _, _ in found], pa.int64()),
                "items": pa.array([i for _, _, i in found], pa.list_(pa.string())),
                "word_spans": pa.array([placed(x, s) for x, (_, s, _) in zip(texts, found)], pa.list_(pa.list_(pa.int64()))),
            })

        return step

    return map_slices(docs, "text", "doc_id long, text_key string, n_words long, items array<string>, word_spans array<array<long>>", work)


def contamination(df: DataFrame, benchmark: DataFrame, size: int = WINDOW, bound: int = AUTOMATON_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items and spans (original code points) of every document.

    Null or empty texts have no words; items without words have no windows; a null item_id counts as "".  Equal rows
    each give a row; items that share an id count once; an empty benchmark hits nothing.  ``bound`` changes no row.
    """
    docs = documents(df, id_col, text_col)
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(f"`{item_text_col}`"), F.lit("")).alias("item_text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("item_text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-total // bound))
    if blocks == 1:
        out = _scan(docs, [tuple(r) for r in items.collect()], size)  # at most ``bound`` bytes, as just summed
    else:
        out = _in_blocks(docs, items, blocks, size)
    hits = F.aggregate("word_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    spans = F.array_join(F.transform("word_spans", lambda s: F.concat_ws(":", s[2].cast("string"), s[3].cast("string"))), ",")
    out = out.withColumns({"n_hit": hits, "spans": spans})
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "items", "spans",
    )


def keep_clean(df: DataFrame, benchmark: DataFrame, size: int = WINDOW, bound: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows of ``df`` (all its columns) without a hit, scanned in place, so that no text is shuffled.  Beyond
    ``bound`` the blocks of items follow one another, each over what the one before kept."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("item_text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("item_text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-total // bound))
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "item_text"), F.lit(blocks)) == b)
        sent = df.sparkSession.sparkContext.broadcast([tuple(r) for r in own.toLocalIterator()])

        def run(batches, sent=sent):
            scan = None
            for part in slices(batches, "text"):
                scan = scan or Scanner(sent.value, size)
                yield part.filter(pa.array([not scan(x or "")[1] for x in part.column("text").to_pylist()], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df


def _in_blocks(docs: DataFrame, items: DataFrame, blocks: int, size: int) -> DataFrame:
    """One scan a block of items; only documents with hits are shuffled, by id and text."""
    docs = docs.withColumn("key", F.md5("text"))
    block = F.pmod(F.xxhash64("item", "item_text"), F.lit(blocks))
    hits = None
    for b in range(blocks):
        own = [tuple(r) for r in items.where(block == b).toLocalIterator()]
        part = cut(_scan(docs.select("doc_id", "text"), own, size).where(F.size("word_spans") > 0))
        hits = part if hits is None else hits.unionByName(part)
    # Copies of a row have equal hits of each block.
    hits = hits.drop("n_words").distinct().groupBy("doc_id", "text_key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), _united(F.array_sort(F.flatten(F.collect_list("word_spans")))).alias("word_spans")
    )
    counted = docs.select("doc_id", "key", F.size(F.filter(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")).cast("long").alias("n_words"))
    return counted.alias("d").join(hits.alias("h"), (F.col("d.doc_id").eqNullSafe(F.col("h.doc_id"))) & (F.col("d.key") == F.col("h.text_key")), "left").select(
        "d.doc_id", "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("word_spans", F.array().cast("array<array<long>>")).alias("word_spans")
    )
