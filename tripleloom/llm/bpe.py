"""Byte-level BPE: token counts by a heap and a linked list (6); encoding by a segment tree, and decoding (10).

Both give what the tokenizers library gives for a byte-level file without normaliser: special
strings in a text are their one id, the rest is cut by the pattern and merged piece by piece.
A piece's result is kept in a bounded table of the Python worker, as most pieces come again.

Defined cases: a null or empty text has 0 tokens (the hashes are those of no bytes); a text of one
endless word costs n log n; pairs of one rank are merged from the left; bytes that aren't UTF-8 become
replacement characters; repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tripleloom.llm.common import batch, chunks, id_and_text

# Fixed values of the vocabulary file's kind: white space, the pattern of pieces, bytes that stand for themselves.
WS = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: A space before what may be white space: such a text isn't cut at its spaces first.
SPACE_RUN = re.compile(rb" (?:[ \t-\r]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80|\xe2\x81\x9f|\xe3\x80\x80)")
NONE = 1 << 62


class Vocabulary:
    """Ranks of pairs, ids of merges, bytes of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        rest = (b for b in range(256) if b not in set(PRINTABLE))
        char = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(rest)}
        byte = {c: b for b, c in char.items()}
        self.base = [ids[char[b]] for b in range(256)]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for pair in spec["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[ids[left] << 32 | ids[right]] = len(self.merged)
            self.merged.append(ids[left + right])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k.encode(): v for k, v in added.items()}
        self.specials = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.bytes = [b""] * (1 + max([*ids.values(), *added.values()]))
        for token, i in [*ids.items(), *added.items()]:
            self.bytes[i] = bytes(map(byte.__getitem__, token)) if all(c in byte for c in token) else token.encode()


def count_by_heap(v: Vocabulary, piece: bytes) -> int:
    """Tokens of a piece: initial symbols minus merges; the lowest-rank pair, leftmost first, is popped each time."""
    rank, merged = v.rank, v.merged
    symbol = [v.base[b] for b in piece]
    n = left = len(symbol)
    heap = [r << 32 | i for i in range(n - 1) if (r := rank.get(symbol[i] << 32 | symbol[i + 1])) is not None]
    if not heap:
        return n
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        top = heappop(heap)
        i, r = top & 0xFFFFFFFF, top >> 32
        j = after[i]
        if symbol[i] < 0 or j >= n or rank.get(symbol[i] << 32 | symbol[j]) != r:
            continue  # one of the two has been merged since
        symbol[i], symbol[j] = merged[r], -1
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank.get(symbol[i] << 32 | symbol[k])) is not None:
                heappush(heap, r << 32 | i)
        if (h := before[i]) >= 0 and (r := rank.get(symbol[h] << 32 | symbol[i])) is not None:
            heappush(heap, r << 32 | h)
    return left


def encode_by_segment_tree(v: Vocabulary, piece: bytes) -> list[int]:
    """Ids of a piece. Leaf i holds the rank of the pair that starts at i; the root is the next merge."""
    rank, merged = v.rank, v.merged
    symbol = [v.base[b] for b in piece]
    n = len(symbol)
    if n < 2:
        return symbol
    size = 1 << (n - 2).bit_length()
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        if (r := rank.get(symbol[i] << 32 | symbol[i + 1])) is not None:
            tree[size + i] = r << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            if b < a:
                a = b
            if tree[k] == a:
                return
            tree[k] = a
            k >>= 1

    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (top := tree[1]) < NONE:
        i = top & 0xFFFFFFFF
        j = after[i]
        symbol[i], symbol[j] = merged[top >> 32], -1
        after[i] = k = after[j]
        if j < n - 1:
            put(j, NONE)
        if k < n:
            before[k] = i
            put(i, NONE if (r := rank.get(symbol[i] << 32 | symbol[k])) is None else r << 32 | i)
        else:
            put(i, NONE)
        if (h := before[i]) >= 0:
            put(h, NONE if (r := rank.get(symbol[h] << 32 | symbol[i])) is None else r << 32 | h)
    return [s for s in symbol if s >= 0]


class Kept(dict):
    """Results by key, computed when first asked for; emptied when it holds too many. Long keys are not kept."""

    def __init__(self, compute, most: int, longest: int = 48):
        super().__init__()
        self.compute, self.most, self.longest = compute, most, longest

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Cutter:
    """Sums up, over the pieces of a text, what a function gives for one piece.

    Between special strings a text is cut at single spaces first. Each part, with its space, holds
    whole pieces of the pattern, unless a space stands before other white space.
    """

    def __init__(self, v: Vocabulary, of_piece, of_special, add, most: int):
        self.v, self.of_special, self.add = v, of_special, add
        pattern, piece = regex.compile(PATTERN), Kept(lambda p: of_piece(v, p), most)
        self.whole = lambda raw: add(piece[x.encode()] for x in pattern.findall(raw.decode()))
        self.first, self.spaced = Kept(self.whole, most // 8), Kept(lambda part: self.whole(b" " + part), most)

    def plain(self, raw: bytes) -> list:
        if SPACE_RUN.search(raw):
            return [self.whole(raw)]
        head, *rest = raw.split(b" ")
        return [self.first[head], *map(self.spaced.__getitem__, rest)]

    def text(self, raw: bytes):
        if not self.v.specials or not self.v.specials.search(raw):
            return self.add(self.plain(raw)) if raw else self.add([])
        parts = []
        for part in self.v.specials.split(raw):
            parts += [self.of_special(self.v.special[part])] if part in self.v.special else self.plain(part) if part else []
        return self.add(parts)


_made: dict = {}


def _once(key, make):
    """One of each in a Python worker, which runs many tasks."""
    if key not in _made:
        _made[key] = make()
    return _made[key]


def counter(path: str, most: int = 700_000) -> Cutter:
    return _once(("count", path, most), lambda: Cutter(Vocabulary(path), count_by_heap, lambda _: 1, sum, most))


def encoder(path: str, most: int = 600_000) -> Cutter:
    """Gives ids as little-endian unsigned 32-bit integers."""
    packed = lambda v, p: np.array(encode_by_segment_tree(v, p), "<u4").tobytes()
    return _once(("encode", path, most), lambda: Cutter(Vocabulary(path), packed, lambda i: i.to_bytes(4, "little"), b"".join, most))


def decode(v: Vocabulary, ids: bytes) -> bytes:
    """UTF-8 of the decoded text; bytes that aren't UTF-8 become replacement characters."""
    raw = b"".join(map(v.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    try:
        raw.decode()
    except UnicodeDecodeError:
        return raw.decode(errors="replace").encode()
    return raw


COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""

    def run(batches):
        count = counter(path).text
        for b in chunks(batches, "text"):
            texts = b.column("text").to_pylist()
            n = [count(t) for t in texts]
            yield batch(COUNTS, b.column("doc_id"), [len(t) for t in texts], n, [x > limit for x in n])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


CODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _coded(batches, path: str):
    e = encoder(path)
    for b in chunks(batches, "text"):
        ids = [e.text(t) for t in b.column("text").to_pylist()]
        yield b.column("doc_id"), ids, [decode(e.v, i) for i in ids]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded (UTF-8)."""

    def run(batches):
        for row in _coded(batches, path):
            yield batch(CODED, *row)

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def encode_decode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of what encode_decode gives, made where that is made."""

    def run(batches):
        for doc, ids, text in _coded(batches, path):
            yield batch(
                DIGEST, doc, [len(i) // 4 for i in ids], [hashlib.sha256(i).hexdigest() for i in ids],
                [hashlib.sha256(t).hexdigest() for t in text]
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
