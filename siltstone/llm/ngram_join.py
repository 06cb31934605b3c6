"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets verify them.

Equal texts are one node.  Nodes that share a band hash are put into candidate clusters; every pair of a cluster is
verified on the full sets of five-word shingles, in blocks of a bounded number of texts, so that a large cluster is
spread over many tasks and gives counts of links and a spanning forest instead of all its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import SLICE_BYTES, cut, documents, map_slices
from siltstone.llm.components import components
from siltstone.llm.sieve import marked, sieve

SHINGLE = 5
#: Similarity as a fraction, so that comparisons are exact.
NUMERATOR, DENOMINATOR = 4, 5
RECALL = 0.999
MOST_HASHES = 128
#: Texts in a block of a cluster; two blocks meet in one task.
BLOCK = 192
SEED = 97


def bands_for(similarity: float, recall: float = RECALL, hashes: int = MOST_HASHES) -> tuple[int, int]:
    """Numbers of bands and of rows in each: the most rows with which pairs at the threshold are found with the wanted
    recall within so many hashes.  More rows a band mean fewer false candidates."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)) if similarity < 1 else 1
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' word n-grams (lower case), with repeats, and where each text's begin (n + 1 offsets).
    A text of fewer words, but not none, has one n-gram of them all."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts)))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    empty = pc.equal(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False) | (counts == 0)
    coded = flat.dictionary_encode()
    own = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False) if len(flat) else np.zeros(0, np.uint64)
    words = own[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else own
    ends = np.cumsum(counts)
    starts = ends - counts
    blank = np.zeros(len(counts), bool)
    one = np.flatnonzero(counts == 1)
    if len(one):
        blank[one] = pc.equal(pc.utf8_length(flat.take(pa.array(starts[one]))), 0).to_numpy(zero_copy_only=False)
    empty |= blank
    grams = np.where(empty, 0, np.maximum(counts - size + 1, 1))
    offsets = np.concatenate(([0], np.cumsum(grams)))
    begin = np.repeat(starts - offsets[:-1], grams) + np.arange(offsets[-1])
    width = np.repeat(np.minimum(counts, size), grams)
    out = np.full(offsets[-1], SEED, np.uint64)
    for k in range(size):
        at = np.minimum(begin + k, max(len(words) - 1, 0))
        out = np.where(k < width, _mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[at]), out) if len(out) else out
    return out, offsets


def band_hashes(hashes: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Of texts that have n-grams: their band hashes, one row a text."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    keys = np.random.default_rng(SEED).integers(1, 1 << 63, (bands * rows, 2), dtype=np.int64).astype(np.uint64)
    out = np.empty((len(starts), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(starts), b + 1, np.uint64)
        for mul, add in keys[b * rows : (b + 1) * rows]:
            x = hashes * (mul | np.uint64(1)) + add
            acc = _mixed(acc * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts))
        out[:, b] = acc
    return out


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, node (the text's MD5) and bands of every document; a text without words has no bands."""

    def work():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = part.column("text")
            hashes, offsets = shingles(texts)
            filled = np.diff(offsets) > 0
            own = band_hashes(hashes, offsets, bands, rows) if filled.any() else np.zeros((0, bands), np.uint64)
            ends = np.concatenate(([0], np.cumsum(np.where(filled, bands, 0)))).astype(np.int32)
            return pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id").cast(pa.int64()),
                "node": pa.array([hashlib.md5(x.encode()).digest() for x in texts.to_pylist()], pa.binary()),
                "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(own.ravel().view(np.int64))),
            })

        return step

    return map_slices(docs, "text", "doc_id long, node binary, bands array<long>", work)


def similar_pairs(sets: list[np.ndarray], left: int | None) -> Iterator[tuple[int, int]]:
    """Pairs of sets (sorted unique arrays) with Jaccard similarity at or over the threshold.  With ``left``, only pairs
    between the first so many and the rest.  Intersections are counted by products of 0/1 matrices, so many columns at
    once that memory stays bounded."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = counts > 1
    code = np.cumsum(shared) - 1
    keep = shared[inverse]
    column, owner = code[inverse[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((n, n), np.float32)
    width, total = 4096, int(shared.sum())
    for at in range(0, total, width):
        a, b = np.searchsorted(column, (at, at + width))
        part = np.zeros((n, min(width, total - at)), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        common += part @ part.T
    both = sizes[:, None] + sizes[None, :]
    hit = (common.astype(np.int64) * (NUMERATOR + DENOMINATOR) >= NUMERATOR * both) & (common > 0)
    rows, cols = np.nonzero(np.triu(hit, 1))
    for i, j in zip(rows.tolist(), cols.tolist()):
        if left is None or i < left <= j:
            yield i, j


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cluster, lo, hi, block), a whole group in one partition; gives links of nodes and forest edges."""
    key, held = None, []

    def judged() -> pa.RecordBatch:
        rows = held
        hashes, offsets = shingles(pa.array([t for _, _, t in rows], pa.string()))
        sets = [np.unique(hashes[a:b]) for a, b in zip(offsets, offsets[1:])]
        left = None if key[1] == key[2] else sum(block == key[1] for block, _, _ in rows)
        links, parent, edges = [0] * len(rows), list(range(len(rows))), []

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for i, j in similar_pairs(sets, left) if len(rows) > 1 else ():
            links[i] += 1
            links[j] += 1
            if (a := root(i)) != (b := root(j)):
                parent[b] = a
                edges.append((rows[i][1], rows[j][1]))
        a = [rows[i][1] for i, k in enumerate(links) if k] + [x for x, _ in edges]
        b = [None] * sum(k > 0 for k in links) + [y for _, y in edges]
        n = [k for k in links if k] + [0] * len(edges)
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "links": pa.array(n, pa.int64())})

    for batch in batches:
        for cluster, lo, hi, block, node, text in zip(*(batch.column(c).to_pylist() for c in ("cluster", "lo", "hi", "block", "node", "text"))):
            if key != (cluster, lo, hi):
                if held:
                    yield judged()
                key, held = (cluster, lo, hi), []
            held.append((block, node, text))
    if held:
        yield judged()


def similarity_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, node (the text's MD5) and root (the least node of its class) of every document.

    class_id is the least doc_id of the documents connected by links or equal texts (null if they have none), n_links
    the number of other texts that share at least four fifths of all five-word shingles with the document's, n_copies
    the number of rows with its very text.  Case and the kind of white space are ignored.  Null texts count as empty;
    texts without words are alike only if they are equal.  Equal rows each give a row; a null doc_id is never a class
    id while another is there; other columns are not read; an empty table gives no rows.
    """
    docs = documents(df, id_col, text_col)
    bands, rows = bands_for(NUMERATOR / DENOMINATOR)
    signed = signatures(docs, bands, rows)
    hashed = signed.select("node", F.explode("bands").alias("band")).distinct()
    least = hashed.groupBy("band").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "least")
    edges = cut(hashed.join(least, "band").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    found = verify(docs, edges, block)
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    classes = components(found.where("b is not null").select("a", "b"))
    nodes = docs.select("doc_id", F.unhex(F.md5("text")).alias("node")).groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("rows"))
    nodes = cut(nodes)
    per = nodes.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.sum("rows").alias("n_copies"))
    per = per.join(classes, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = per.groupBy("root").agg(F.min("first_id").alias("class_id"))
    per = cut(per.join(ids, "root").select("node", "root", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_copies"))
    out = nodes.join(per, "node")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select("doc_id", "class_id", "n_links", "n_copies", "node", "root")


def verify(docs: DataFrame, edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b, links: of each block pair, the links of nodes (b is null) and the edges of a forest over linked nodes."""
    clusters = components(edges)
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n")).select("root", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    clusters = cut(clusters.join(sizes, "root"))
    texts = docs.withColumn("node", F.unhex(F.md5("text")))
    texts = marked(texts, F.col("node"), sieve(clusters.select("node"), "node")).where("may_match").select("node", "text")
    texts = texts.groupBy("node").agg(F.first("text").alias("text")).join(clusters, "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    texts = texts.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    texts = texts.select(F.col("root").alias("cluster"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "text")
    return cut(texts.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "block").mapInArrow(_verified, "a binary, b binary, links long"))
