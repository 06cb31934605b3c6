"""Secret scans: patterns, and structural confirmation of encoded keys and signed tokens.

Runs of base64 or hex are decoded and reported only where their structure proves what they are: DER private keys whose
nested lengths fit exactly, OpenSSH key containers, encrypted PEM blocks and tokens whose header names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import itertools
import json
import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.batches import documents, map_slices

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "jwt", "der", "openssh", "pem")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{12,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
#: Where a run may begin: after anything outside the alphabet, and after the letter of an escaped line break.
START = r"(?:(?<=\\[nr])|(?<=\\)(?![nr])|(?<![A-Za-z0-9+/_\\-]))"
RUN = re.compile(START + r"[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_RUN = re.compile(r"(?:(?<=\\[nr])|(?<![0-9A-Za-z]))(?:0[xX])?((?:[0-9A-Fa-f]{2}){32,})(?![0-9A-Za-z])")
#: A line break, escaped ones too, with the blanks around it.
BREAK = re.compile(r"[ \t]*(?:(?:\\+r)?(?:\\+n)?(?:\r\n|\n|\r)|\\+r\\+n|\\+n|\\+r)[ \t]*")
CHAIN = re.compile(START + r"[A-Za-z0-9+/_-]{16,}(?:" + BREAK.pattern + r"[A-Za-z0-9+/_-]+)+={0,2}")
ESCAPED = re.compile(r"\\+[rnt]|\r")
#: Where one string literal ends and the next, which continues it, begins.
LITERALS = re.compile(r"""["'][ \t]*[+,\\]?\s*["']""")
BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
SEQUENCE, INTEGER, OCTETS, OID = 0x30, 0x02, 0x04, 0x06


def base_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """Matches of the three patterns, leftmost and non-overlapping of each kind, the short ones dropped."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 12:
            yield m.start(), m.end(), "assign"
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                yield m.start(), m.end(), "access"
    for m in HEX.finditer(text):
        yield m.start(), m.end(), "hex"


def unbase64(run: str) -> bytes | None:
    """Bytes of a base64 run in either alphabet, with or without padding; None if it isn't one."""
    body = "".join(run.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if not body or len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (ValueError, binascii.Error):
        return None


def der_items(raw: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents that fill ``raw`` exactly, in definite lengths; None if they don't."""
    out, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw):
            return None
        tag, size = raw[at], raw[at + 1]
        at += 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(raw):
                return None
            size = int.from_bytes(raw[at : at + width], "big")
            if size < 128 or width > 1 and not raw[at]:
                return None
            at += width
        if at + size > len(raw):
            return None
        out.append((tag, raw[at : at + size]))
        at += size
    return out


def der_key(raw: bytes) -> bool:
    """Whether the bytes are one DER private key: RSA, DSA, EC, PKCS #8, or PKCS #8 encrypted."""
    top = der_items(raw) if raw[:1] == b"\x30" else None
    if not top or len(top) != 1 or not (items := der_items(top[0][1])):
        return False
    tags = [tag for tag, _ in items]
    if tags[0] == INTEGER and items[0][1] in (b"\0", b"\1"):
        if tags[1:] and set(tags) == {INTEGER} and len(tags) in (6, 9):
            return all(body for _, body in items)
        if tags[1:3] == [SEQUENCE, OCTETS]:
            inner = der_items(items[1][1])
            return bool(inner) and inner[0][0] == OID and len(items[2][1]) >= 16
        if tags[1:2] == [OCTETS] and items[0][1] == b"\1" and set(tags[2:]) <= {0xA0, 0xA1}:
            return 16 <= len(items[1][1]) <= 80 and all(der_items(body) for _, body in items[2:])
    if tags == [SEQUENCE, OCTETS]:
        inner = der_items(items[0][1])
        return bool(inner) and len(inner) == 2 and inner[0][0] == OID and inner[1][0] == SEQUENCE and len(items[1][1]) >= 16
    return False


def openssh_key(raw: bytes) -> bool:
    """Whether the bytes are one OpenSSH key container with all nested lengths right."""
    magic = b"openssh-key-v1\0"
    if not raw.startswith(magic):
        return False
    at, parts = len(magic), []

    def take() -> bool:
        nonlocal at
        if at + 4 > len(raw):
            return False
        size = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 + size > len(raw):
            return False
        parts.append(raw[at + 4 : at + 4 + size])
        at += 4 + size
        return True

    if not (take() and take() and take()) or at + 4 > len(raw):
        return False
    keys = int.from_bytes(raw[at : at + 4], "big")
    at += 4
    return keys >= 1 and all(take() for _ in range(keys + 1)) and at == len(raw) and bool(parts[0]) and len(parts[-1]) >= 8


def signed_token(header: str, payload: str) -> bool:
    """Whether the first part decodes to a JSON object that names an algorithm, and the second to a JSON object or, with
    an encrypted content, to anything."""
    first, second = unbase64(header), unbase64(payload)
    if first is None or second is None:
        return False
    try:
        head = json.loads(first)
        return isinstance(head, dict) and isinstance(head.get("alg"), str) and ("enc" in head or isinstance(json.loads(second), dict))
    except (ValueError, RecursionError):
        return False


def key_kind(raw: bytes | None) -> str | None:
    return None if raw is None else "der" if der_key(raw) else "openssh" if openssh_key(raw) else None


def wrapped(raw: bytes | None, depth: int) -> str | None:
    """The kind of what decoded bytes hold: a key, or a text that again holds one."""
    if raw is None or (kind := key_kind(raw)):
        return kind if raw is not None else None
    if depth and len(raw) >= 40:
        return next((k for _, _, k in confirmed(raw.decode("latin-1"), depth - 1)), None)
    return None


def blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and body of each armoured private key of any length; every end line is looked for once."""
    ends: dict[str, int] = {}
    for m in BEGIN.finditer(text):
        close = f"-----END {m[1]}-----"
        if 0 <= ends.get(m[1], 0) < m.end():
            ends[m[1]] = text.find(close, m.end())
        end = ends[m[1]]
        if end >= 0:
            again = BEGIN.search(text, m.end(), end)
            if not again:
                yield m.start(), end + len(close), text[m.end() : end]


def armoured(body: str) -> str | None:
    """The kind of an armoured block's body, which may stand in string literals with escaped line breaks."""
    body = LITERALS.sub("", ESCAPED.sub("\n", body.replace("\r\n", "\n").replace("\\r\\n", "\n")))
    kind = key_kind(unbase64(body))
    if not kind and "DEK-Info:" in body and (raw := unbase64(body.rpartition("\n\n")[2] or "")) and len(raw) % 8 == 0:
        kind = "pem"
    return kind


def der_size(head: bytes) -> int:
    """Bytes of the DER sequence that begins so; 0 if none does."""
    if len(head) < 6 or head[0] != SEQUENCE:
        return 0
    width = head[1] & 0x7F if head[1] & 0x80 else 0
    return 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1]) if width <= 4 else 0


def decoded(run: str) -> Iterator[bytes]:
    digits = run[2:] if run[:2] in ("0x", "0X") else run
    if len(digits) % 2 == 0 and re.fullmatch("[0-9A-Fa-f]+", digits):
        yield bytes.fromhex(digits)
    if (raw := unbase64(run)) is not None:
        yield raw


def joins(units: list[str]) -> Iterator[tuple[int, int]]:
    """First and last of neighbouring lines that may be one encoding: as many as the size of a DER sequence asks for, and
    lines of one length with a shorter last one, or first one.  A few a line, so that long chains cost in proportion."""
    sizes = [len(u.rstrip("=")) for u in units]
    ends = [0, *itertools.accumulate(sizes)]
    at = {end: k for k, end in enumerate(ends)}
    for i, u in enumerate(units):
        for head, chars in ((u[:8], lambda n: -(-n * 4 // 3)), (u[:12], lambda n: 2 * n), (u[2:14] if u[:2] in ("0x", "0X") else "", lambda n: 2 * n + 2)):
            for raw in decoded(head):
                if (size := der_size(raw)) and (j := at.get(ends[i] + chars(size), 0) - 1) > i:
                    yield i, j
    k = 0
    while k < len(units):
        e = k
        while e + 1 < len(units) and sizes[e + 1] == sizes[k]:
            e += 1
        lasts = [e + 1, e] if e + 1 < len(units) and sizes[e + 1] < sizes[k] else [e]
        yield from ((first, last) for first in (k, k - 1) for last in lasts if 0 <= first < last)
        k = e + 1


class Taken:
    """Disjoint spans, in order."""

    def __init__(self):
        self.spans: list[tuple[int, int]] = []

    def free(self, a: int, b: int) -> bool:
        at = bisect_right(self.spans, (a, b))
        return (not at or self.spans[at - 1][1] <= a) and (at == len(self.spans) or self.spans[at][0] >= b)

    def add(self, a: int, b: int) -> None:
        insort(self.spans, (a, b))


def chained(text: str, depth: int, taken: Taken) -> Iterator[tuple[int, int, str]]:
    """Spans of encodings wrapped over lines, outside of those taken, which grow."""
    for m in CHAIN.finditer(text):
        breaks = [b.span() for b in BREAK.finditer(text, m.start(), m.end())]
        spans = list(zip([m.start(), *(b for _, b in breaks)], [*(a for a, _ in breaks), m.end()]))
        units = [text[a:b] for a, b in spans]
        for i, j in joins(units):
            a, b = spans[i][0], spans[j][1]
            if b - a < 40 or not taken.free(a, b):
                continue
            if kind := next((k for raw in decoded("".join(units[i : j + 1])) if (k := wrapped(raw, depth))), None):
                taken.add(a, b)
                yield a, b, kind


def confirmed(text: str, depth: int = 1) -> Iterator[tuple[int, int, str]]:
    """Spans that only decoding confirms.  A block's inner lines are not reported again.

    What is decoded may be a text that again holds an encoding, ``depth`` times."""
    taken = Taken()
    if "PRIVATE KEY-----" in text:
        for start, end, body in blocks(text):
            kind = armoured(body)
            if kind:
                taken.add(start, end)
                yield start, end, kind
    # The least lengths that the patterns below ask for.
    long = [x for x in text.split() if len(x) >= 16]
    if any("." in x for x in long):
        for m in TOKEN.finditer(text):
            if taken.free(*m.span()) and signed_token(m[1], m[2]):
                taken.add(*m.span())
                yield m.start(), m.end(), "jwt"
    if not any(len(x) >= 40 for x in long) and len(long) < 2:
        return
    for m in HEX_RUN.finditer(text):
        if taken.free(*m.span(1)) and (kind := wrapped(bytes.fromhex(m[1]), depth)):
            taken.add(*m.span(1))
            yield *m.span(1), kind
    for m in RUN.finditer(text):
        if taken.free(*m.span()) and (kind := wrapped(unbase64(m[0]), depth)):
            taken.add(*m.span())
            yield *m.span(), kind
    yield from chained(text, depth, taken)


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_confirmed of every whole text.

    Spans are kind:start:end in code points, ends exclusive.  A null or empty text has none; its base_sha256 is that of
    an empty string.  Encodings within decoded texts are found one layer deep.  Equal rows each give a row; a null doc_id stays null; other columns are not read.
    """

    def work():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            counts, digests, spans = {k: [] for k in BASE}, [], []
            for text in part.column("text").to_pylist():
                base = list(base_spans(text))
                kinds = [k for _, _, k in base]
                for k in BASE:
                    counts[k].append(kinds.count(k))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(base + list(confirmed(text))))
            return pa.RecordBatch.from_pydict(
                {"doc_id": part.column("doc_id").cast(pa.int64())}
                | {f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()}
                | {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string())}
                | {"n_confirmed": pa.array([s.count(":") // 2 - sum(counts[k][i] for k in BASE) for i, s in enumerate(spans)], pa.int64())}
            )

        return step

    return map_slices(documents(df, id_col, text_col), "text", "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long", work)
