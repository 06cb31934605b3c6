"""Texts cut into pre-tokens, with chunks between single blanks as the unit that is remembered.

The pattern of the byte-level vocabularies starts a new match at every blank that has other characters than white
space on both sides, and no match looks across such a blank.  So a text may be split there, and what a chunk gives
depends on nothing but the chunk.  A chunk that is empty or has white space at an end breaks the condition; then the
whole text is matched at once.
"""

from __future__ import annotations

import heapq

import regex

#: The pattern that splits text before merging (fixed by the vocabularies).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
find_pieces = regex.compile(PATTERN).findall


def splits(chunk: str) -> bool:
    """Whether a chunk may stand alone."""
    return bool(chunk) and not chunk[0].isspace() and not chunk[-1].isspace()


def chunk_pieces(chunk: str) -> list[str]:
    """Pre-tokens of a blank and the chunk after it."""
    if chunk.isascii() and chunk.isalpha():
        return [" " + chunk]
    return find_pieces(" " + chunk)


def byte_chars() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabularies kept as JSON."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Bytes of a pre-token from which merging goes by a heap: one round a merge would be quadratic.
LONG = 160


def merged_by_heap(ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Contracts the leftmost pair of minimum rank until none is left, in n log n; ``pairs`` has rank and merged id."""
    n = len(ids)
    ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(*found, at, ids[at], ids[at + 1]) for at in range(n - 1) if (found := pairs.get((ids[at], ids[at + 1])))]
    heapq.heapify(heap)
    while heap:
        _, merged, at, left, right = heapq.heappop(heap)
        to = after[at]
        if ids[at] != left or to >= n or ids[to] != right:
            continue
        ids[at], ids[to], after[at] = merged, -1, after[to]
        if after[to] < n:
            before[after[to]] = at
        for a, b in ((before[at], at), (at, after[at])):
            if a >= 0 and b < n and (found := pairs.get((ids[a], ids[b]))):
                heapq.heappush(heap, (*found, a, ids[a], ids[b]))
    return [i for i in ids if i >= 0]
