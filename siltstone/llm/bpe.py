"""Byte-level BPE encoding and decoding by recursive SQL queries, one in-memory DuckDB database a worker.

Encoding: each new word's token-position rows join the merge table, and its leftmost pair of minimum rank is
contracted, again and again until no word has a pair left.  Decoding: the ids' rows join the vocabulary and an ordered
aggregation puts the bytes together.  Words that were seen before come from tables of bounded size; a full table is
emptied.

A round a merge would be quadratic in a word's length.  So words of LONG bytes contract in a round, besides that pair, all
pairs that nothing can come before: of rank r, with no merge of lower rank that takes the left token, or the pair's, as its
second and a token that ends in the one before as its first, nor one that takes the right token, or the pair's, as its
first and a token that begins with the one after as its second.  The tokens beside a pair only grow away from it, so until
the pair's turn both of its tokens stay, and contracting them early changes no choice before that.  Most pairs of a word go
in the first rounds; what remains takes rounds in proportion to the length, so that words of HEAP bytes, for which that
would be minutes, are merged with a heap, by the same rule.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.batches import documents, map_slices, tokenizer_file
from siltstone.llm.pieces import find_pieces, merged_by_heap

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of words that a table remembers, words in a query, and ids in a query.
KEPT_BYTES, WORDS_A_QUERY, IDS_A_QUERY = 12 << 20, 40_000, 1 << 20
#: Bytes of a word from which all certain pairs are contracted in a round, and from which a heap takes over; bytes of long
#: words in a query.
LONG, HEAP, LONG_A_QUERY = 64, 8_192, 1 << 18

#: Words as lists of ids.  Every round unnests the positions of the words that changed, joins them with the merges and
#: contracts the pair of least rank, the leftmost of equals (both in one number).  Only a word's last list is kept, which
#: is its fixpoint in the end.
ENCODE = """
WITH RECURSIVE state(word, ids) USING KEY (word) AS (
  SELECT word, ids FROM start
  UNION ALL
  (WITH positions AS (
     SELECT word, unnest(ids[:-2]) AS lft, unnest(ids[2:]) AS rgt, unnest(range(1, len(ids))) AS pos FROM state WHERE len(ids) > 1),
   chosen AS (SELECT word, min(merged::BIGINT * 4294967296 + pos) AS pair FROM positions JOIN merges USING (lft, rgt) GROUP BY word),
   placed AS (SELECT word, ids, pair & 4294967295 AS pos, (pair >> 32)::INTEGER AS merged FROM state JOIN chosen USING (word))
   SELECT word, list_concat(list_append(ids[1:pos - 1], merged), ids[pos + 2:]) FROM placed)
)
SELECT word, ids FROM state ORDER BY word
"""

#: The same for long words, with all certain pairs of a round.  ``before`` and ``after`` have the least rank of a merge
#: of a token with one that ends in (begins with) another.
ENCODE_LONG = """
WITH RECURSIVE state(word, ids) USING KEY (word) AS (
  SELECT word, ids FROM start
  UNION ALL
  (WITH positions AS (
     SELECT word, unnest(ids) AS lft, unnest(list_append(ids[2:], -1)) AS rgt, unnest(list_prepend(-1, ids[:-2])) AS previous,
       unnest(list_concat(ids[3:], [-1, -1])) AS following, unnest(range(len(ids))) AS pos FROM state WHERE len(ids) > 1),
   ranked AS (
     SELECT word, pos, lft, merged,
       merged IS NOT NULL AND merged < least(coalesce(b.rank, 2147483647), coalesce(c.rank, 2147483647), coalesce(d.rank, 2147483647)) AND merged <= coalesce(a.rank, 2147483647) AS certain,
       min(merged::BIGINT * 4294967296 + pos) OVER (PARTITION BY word) AS pair
     FROM positions LEFT JOIN merges USING (lft, rgt)
       LEFT JOIN before b ON b.beside = previous AND b.token = lft LEFT JOIN after a ON a.beside = following AND a.token = rgt
       LEFT JOIN before c ON c.beside = previous AND c.token = merged LEFT JOIN after d ON d.beside = following AND d.token = merged),
   placed AS (
     SELECT word, pos, CASE WHEN starts THEN merged ELSE lft END AS id, lag(starts, 1, false) OVER (PARTITION BY word ORDER BY pos) AS gone
     FROM (SELECT word, pos, lft, merged, certain OR (merged IS NOT NULL AND merged::BIGINT * 4294967296 + pos = pair) AS starts FROM ranked WHERE pair IS NOT NULL))
   SELECT word, list(id ORDER BY pos) FROM placed WHERE NOT gone GROUP BY word)
)
SELECT word, ids FROM state ORDER BY word
"""

#: Tokens are kept as strings of one character a byte, since those can be put together in order.
DECODE = "SELECT run, string_agg(chars, '' ORDER BY pos) AS chars FROM runs JOIN vocabulary USING (id) GROUP BY run ORDER BY run"


def ranks_of(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens whose bytes together are a token; that token's id is the pair's rank."""
    left, right, merged = [], [], []
    for token, rank in ranks.items():
        for at in range(1, len(token)):
            if (a := ranks.get(token[:at])) is not None and (b := ranks.get(token[at:])) is not None:
                left.append(a), right.append(b), merged.append(rank)
    return pa.table({"lft": pa.array(left, pa.int32()), "rgt": pa.array(right, pa.int32()), "merged": pa.array(merged, pa.int32())})


def bounds(merges: pa.Table, ranks: dict[bytes, int]) -> dict[str, pa.Table]:
    """The tables ``before`` and ``after``."""
    tokens = {i: token for token, i in ranks.items()}
    ending = {i: [r for k in range(len(t)) if (r := ranks.get(t[k:])) is not None] for i, t in tokens.items()}
    beginning = {i: [r for k in range(1, len(t) + 1) if (r := ranks.get(t[:k])) is not None] for i, t in tokens.items()}
    before: dict[tuple[int, int], int] = {}
    after: dict[tuple[int, int], int] = {}
    for m, a, b in sorted(zip(*(merges.column(c).to_pylist() for c in ("merged", "lft", "rgt"))), reverse=True):
        before.update({(u, b): m for u in ending[a]})
        after.update({(v, a): m for v in beginning[b]})
    column = lambda values: pa.array(list(values), pa.int32())
    table = lambda d: pa.table({"beside": column(k[0] for k in d), "token": column(k[1] for k in d), "rank": column(d.values())})
    return {"before": table(before), "after": table(after)}


class Coder:
    """Encodes and decodes with one database; not for several threads."""

    def __init__(self, ranks: dict[bytes, int], kept: int = KEPT_BYTES):
        import duckdb

        self.ranks, self.kept, self.held = ranks, kept, 0
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        # Nothing is written to a worker's own disk: a query that exceeds the limit fails.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        merges = merge_table(ranks)
        self.pairs = {(a, b): (m, m) for a, b, m in zip(*(merges.column(c).to_pylist() for c in ("lft", "rgt", "merged")))}
        vocabulary = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "chars": pa.array([t.decode("latin-1") for t in ranks])})
        for name, table in ({"merges": merges, "vocabulary": vocabulary} | bounds(merges, ranks)).items():
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def _query(self, view: str, table: pa.Table, sql: str) -> pa.Table:
        self.db.register(view, table)
        out = self.db.sql(sql).to_arrow_table()
        self.db.unregister(view)
        return out

    def _merged(self, words: list[tuple[str, bytes]], sql: str) -> None:
        sizes = np.fromiter((len(raw) for _, raw in words), np.int64, len(words))
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.byte[np.frombuffer(b"".join([raw for _, raw in words]), np.uint8)]))
        lists = self._query("start", pa.table({"word": pa.array(np.arange(len(words), dtype=np.int32)), "ids": ids}), sql).column("ids").combine_chunks()
        flat, ends = lists.flatten().to_numpy().astype("<u4").tobytes(), (np.diff(lists.offsets.to_numpy()).cumsum() * 4).tolist()
        self.pieces.update({word: flat[a:b] for (word, _), a, b in zip(words, [0, *ends], ends, strict=False)})

    def learn(self, words: Iterable[str]) -> None:
        """Encodes words that are not yet in ``pieces``."""
        rest, long, size = [], [], 0
        for word in words:
            raw = word.encode()
            self.held += len(raw)
            if (rank := self.ranks.get(raw)) is not None:
                self.pieces[word] = rank.to_bytes(4, "little")
            elif len(raw) < LONG:
                rest.append((word, raw))
            elif len(raw) >= HEAP:
                self.pieces[word] = np.array(merged_by_heap(self.byte[np.frombuffer(raw, np.uint8)].tolist(), self.pairs), "<u4").tobytes()
            else:
                long.append((word, raw))
                size += len(raw)
                if size >= LONG_A_QUERY:
                    self._merged(long, ENCODE_LONG)
                    long, size = [], 0
        for at in range(0, len(rest), WORDS_A_QUERY):
            self._merged(rest[at : at + WORDS_A_QUERY], ENCODE)
        if long:
            self._merged(long, ENCODE_LONG)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text, its ids as little-endian unsigned 32-bit integers."""
        if self.held > self.kept:
            self.pieces, self.chunks, self.held = {}, {}, 0
        split = [text.split(" ") for text in texts]
        met: set[str] = set()
        for parts in split:
            met.update(parts)
        # A chunk may stand alone if it has something else than white space at both ends.
        fresh = met.difference(self.chunks)
        bad = {c for c in fresh if not c or c[0].isspace() or c[-1].isspace()}
        new = {c: [" " + c] if c.isascii() and c.isalpha() else find_pieces(" " + c) for c in fresh - bad}
        cut = []
        for text, parts in zip(texts, split):
            head = parts[0]
            if head and not head[0].isspace() and not head[-1].isspace() and (not bad or bad.isdisjoint(parts)):
                cut.append((find_pieces(head), parts[1:]))
            else:
                cut.append((find_pieces(text), []))
        words = {w for ps in new.values() for w in ps}
        for ps, _ in cut:
            words.update(ps)
        known = self.pieces
        self.learn(words.difference(known))
        of = self.chunks
        for chunk, ps in new.items():
            of[chunk] = known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])
            self.held += len(chunk)
        return [b"".join([*map(known.__getitem__, ps), *map(of.__getitem__, chunks)]) for ps, chunks in cut]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes behind ids, so many ids at a time; those of a longer text are put together in the end."""
        out: list[list[str]] = [[] for _ in encoded]
        parts: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            run = np.repeat(np.arange(len(parts), dtype=np.int32), [len(ids) for _, ids in parts])
            ids = np.concatenate([ids for _, ids in parts]).astype(np.int32)
            found = self._query("runs", pa.table({"run": run, "pos": np.arange(len(ids), dtype=np.int32), "id": ids}), DECODE)
            for (at, _), chars in zip(parts, found.column("chars").to_pylist(), strict=True):
                out[at].append(chars)
            parts.clear()

        size = 0
        for at, raw in enumerate(encoded):
            ids = np.frombuffer(raw, "<u4")
            for start in range(0, len(ids), IDS_A_QUERY):
                part = ids[start : start + IDS_A_QUERY]
                if parts and size + len(part) > IDS_A_QUERY:
                    flush()
                    size = 0
                parts.append((at, part))
                size += len(part)
        if parts:
            flush()
        return ["".join(chars).encode("latin-1") for chars in out]


_coders: dict[str, Coder] = {}


def _coder(path: str, sent) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(ranks_of(sent.value))
    return _coders[path]


def _sent(df: DataFrame, path: str):
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text; a null or empty text has no ids."""
    path = path or tokenizer_file(VOCABULARY)
    sent = _sent(df, path)

    def work():
        coder = _coder(path, sent)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.frombuffer(x, "<i4") for x in coder.encode(part.column("text").to_pylist())]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            return pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").cast(pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))})

        return step

    return map_slices(documents(df, id_col, text_col), "text", "doc_id long, ids array<int>", work)


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and raw (the bytes behind ``ids``) of every row; null or no ids give no bytes."""
    path = path or tokenizer_file(VOCABULARY)
    sent = _sent(df, path)

    def run(batches: Iterable[pa.RecordBatch]):
        coder = None
        for batch in batches:
            coder = coder or _coder(path, sent)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [np.asarray(x or [], "<u4").tobytes() for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "raw": pa.array(coder.decode(ids), pa.binary())})

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def round_trip(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, encoded and decoded in one pass.

    A null or empty text has no ids, and both digests are those of no bytes.  Equal rows each give a row; a null doc_id
    stays null; other columns are not read; an empty table gives no rows.  With ``keep_ids`` the ids follow.
    """
    path = path or tokenizer_file(VOCABULARY)
    sent = _sent(df, path)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def work():
        coder = _coder(path, sent)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            ids = coder.encode(part.column("text").to_pylist())
            raw = coder.decode(ids)
            out = {
                "doc_id": part.column("doc_id").cast(pa.int64()),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
            }
            if keep_ids:
                out["ids"] = pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))
            return pa.RecordBatch.from_pydict(out)

        return step

    return map_slices(documents(df, id_col, text_col), "text", schema, work)
