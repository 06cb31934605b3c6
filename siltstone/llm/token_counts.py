"""Token counts with a whole-token shortcut.

Before the job starts, every string of the vocabulary is merged once; those that come out as one token are proven
whole.  A pre-token among them counts 1 without merging, and only the others are merged.  What a chunk of text counts
is remembered in a table of bounded size; a full table is emptied, which costs time and changes nothing.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.batches import documents, map_slices, tokenizer_file
from siltstone.llm.pieces import LONG, byte_chars, chunk_pieces, find_pieces, merged_by_heap, splits

VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
CHUNKS_KEPT = 400_000


class Merges:
    """Byte-pair merging by ranked pairs of token ids."""

    def __init__(self, spec: dict):
        model, of = spec["model"], byte_chars()
        vocab = model["vocab"]
        self.byte = [0] * 256
        for char, value in of.items():
            self.byte[value] = vocab[char]
        self.text = {token: bytes(of[c] for c in token) for token in vocab}
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])

    def count(self, piece: bytes) -> int:
        """Tokens of one pre-token: its lowest-ranked pair, the leftmost of equals, is joined until none is left."""
        ids, get = [self.byte[b] for b in piece], self.pairs.get
        if len(ids) > LONG:
            return len(merged_by_heap(ids, self.pairs))
        found = [get(p) for p in zip(ids, ids[1:])]
        while ranked := [x for x in found if x]:
            best = min(ranked)
            at = found.index(best)
            ids[at : at + 2] = [best[1]]
            del found[at]
            if at < len(found):
                found[at] = get((ids[at], ids[at + 1]))
            if at:
                found[at - 1] = get((ids[at - 1], ids[at]))
        return len(ids)

    def whole(self) -> frozenset[str]:
        """The vocabulary's strings that are proven to encode alone as one token (those that are valid text)."""
        out = set()
        for raw in self.text.values():
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                continue
            if self.count(raw) == 1:
                out.add(text)
        return frozenset(out)


class Counter:
    """Counts as the tokenizers library gives them without a post-processor: added special strings count 1 each."""

    def __init__(self, merges: Merges, whole: frozenset[str], special: list[str], kept: int = CHUNKS_KEPT):
        self.merges, self.whole, self.special, self.kept = merges, whole, special, kept
        self.chunks: dict[str, int] = {}
        self.rest: dict[str, int] = {}

    def pieces(self, pieces: list[str]) -> int:
        n = 0
        for piece in pieces:
            if piece in self.whole:
                n += 1
            elif (k := self.rest.get(piece)) is not None:
                n += k
            else:
                if len(self.rest) >= self.kept // 2:
                    self.rest.clear()
                k = self.merges.count(piece.encode())
                if len(piece) <= 64:
                    self.rest[piece] = k
                n += k
        return n

    def plain(self, text: str) -> int:
        if not text:
            return 0
        head, *chunks = text.split(" ")
        if not splits(head):
            return self.pieces(find_pieces(text))
        counts = list(map(self.chunks.get, chunks))
        if None in counts:
            if len(self.chunks) >= self.kept:
                self.chunks.clear()
            for at, chunk in enumerate(chunks):
                if counts[at] is None:
                    if not splits(chunk):
                        return self.pieces(find_pieces(text))
                    counts[at] = n = self.pieces(chunk_pieces(chunk))
                    if len(chunk) <= 64:
                        self.chunks[chunk] = n
        return self.pieces(find_pieces(head)) + sum(counts)

    def __call__(self, text: str) -> int:
        parts, n = [text], 0
        for special in self.special:
            if special in text:
                parts = [y for x in parts for y in x.split(special)]
        n = len(parts) - 1
        return n + sum(map(self.plain, parts))


_counters: dict[str, Counter] = {}


def token_counts(df: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text.

    A null or empty text has 0 bytes and 0 tokens.  Equal rows each give a row; a null doc_id stays null; other columns
    are not read.  An empty table gives no rows.  The vocabulary is read on the driver and sent out: its size is fixed.
    """
    path = path or tokenizer_file(VOCABULARY)
    with open(path, encoding="utf-8") as file:
        raw = file.read()
    spec = json.loads(raw)
    if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
        raise ValueError("a byte-level BPE vocabulary without normaliser is expected")
    special = [x["content"] for x in spec["added_tokens"]]
    sent = df.sparkSession.sparkContext.broadcast((raw, Merges(spec).whole()))

    def work():
        if path not in _counters:
            text, whole = sent.value
            _counters[path] = Counter(Merges(json.loads(text)), whole, special)
        count = _counters[path]

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = part.column("text").to_pylist()
            tokens = [count(x) for x in texts]
            return pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id").cast(pa.int64()),
                "n_bytes": pa.array([len(x.encode()) for x in texts], pa.int64()),
                "n_tokens": pa.array(tokens, pa.int64()),
                "over_limit": pa.array([n > limit for n in tokens], pa.bool_()),
            })

        return step

    return map_slices(documents(df, id_col, text_col), "text", "doc_id long, n_bytes long, n_tokens long, over_limit boolean", work)
