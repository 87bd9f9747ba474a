"""Hierarchical multi-length packing (7).

A document's ids are cut into full windows of the longest size and a rest. Rests are routed to the
smallest context size that holds them. From the longest size down, each rest opens a window; gaps
are filled with whole rests of shorter sizes, the longest that fits first, and at last by cutting
one so that the window is exactly full. What is left when all rests are used is cut at powers of
two. So every sequence is a power of two long and there is no padding at all. Sequences of a size
are dealt to step groups of one token total.

A window takes its documents from one block of rows of a task, so nothing is shuffled, and a block
bounds the memory whatever key the rows share. A repeated task gives the same rows again.

Defined cases: a null or empty text is the end id alone; a very long text is many full windows;
repeated rows are packed as often as they come; rests of one length are taken by their place in the
block; bytes that aren't UTF-8 become replacement characters; an empty table gives no rows.
"""

from __future__ import annotations

import re
import string
import unicodedata
import zlib
from array import array
from bisect import bisect_right, insort

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.bpe import PRINTABLE, Kept, _once
from tripleloom.llm.common import batch, chunks, id_and_text

TIERS = (4096, 2048, 1024, 512, 256, 128, 64)
STEP_TOKENS = 1 << 18
#: Tokens and rows of a block.
BLOCK = (8 << 20, 8192)
#: Marks that are no letters, digits or white space.
MARKS = string.punctuation.encode()
#: The character that stands for each byte in the model's alphabet.
ALPHABET = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


def _unsure() -> re.Pattern:
    """Characters that are not in the first plane of Unicode 3.2: later ones have other forms in each version."""
    known = "".join(c for c in map(chr, range(1 << 16)) if unicodedata.ucd_3_2_0.category(c) not in ("Cn", "Cs"))
    return re.compile(f"[^{re.escape(known)}]")


class Recent(Kept):
    """Keeps the latest results, and up to as many that came before, so that frequent keys stay."""

    def __init__(self, compute, most: int):
        super().__init__(compute, most)
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = {}  # its memory goes before the copy takes some
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class WordTokenizer:
    """Ids by the tokenizers library, which sees each distinct word once while it is kept.

    The file's normaliser and pattern (lower case, pieces without white space) never look beyond
    white space, so parts between ASCII white space can be encoded on their own. A part is cut here
    and its pieces go to the model; the library takes those with special strings or with characters
    on which its Unicode tables and Python's may not agree.
    """

    #: The pattern of pieces in the vocabulary file.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, most: int = 400_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model.tokenize
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in self.library.get_added_tokens_decoder().values()))
        self.find = regex.compile(self.PIECES).findall
        self.unsure = _unsure()
        # an ASCII piece is a part that is cut into itself, and is kept among them
        self.piece, self.part = Recent(self.of_piece, most // 4), Recent(self.of_part, most)

    def of_piece(self, piece: str) -> bytes:
        piece = piece.encode().decode("latin-1")
        if not piece.isprintable():  # bytes that do not stand for themselves in the model's alphabet
            piece = piece.translate(ALPHABET)
        return array("I", [t.id for t in self.model(piece)]).tobytes()

    def of_text(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def of_part(self, part: bytes) -> bytes:
        """Letters are one piece, marks after them another; the pattern cuts other parts."""
        if self.special.search(part):
            return self.of_text(part.decode())
        if part.isascii():
            low = part.lower()
            word = low.rstrip(MARKS)
            if word.isalpha():
                if word == part:
                    return self.of_piece(part.decode())
                return self.part[word] + (self.part[low[len(word) :]] if len(word) < len(low) else b"")
            pieces = self.find(low.decode())
            if len(pieces) == 1 and low == part:
                return self.of_piece(pieces[0])
            return b"".join([self.part[p.encode()] for p in pieces])
        text = part.decode()
        if self.unsure.search(text):
            return self.of_text(text)
        text = unicodedata.normalize("NFC", text)
        # lower() looks at a capital sigma's neighbours, the library doesn't
        text = "".join(c.lower() for c in text) if "\u03a3" in text else text.lower()
        word = text.rstrip(string.punctuation)
        pieces = [word, text[len(word) :]] if word.isalpha() else self.find(text)
        return b"".join([self.part[p.encode()] if p.isascii() else self.piece[p] for p in pieces if p])

    def encode(self, text: bytes, end: int) -> bytes:
        return b"".join(map(self.part.__getitem__, text.split())) + end.to_bytes(4, "little")


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (size, pieces (document, start, length)); every token is in one piece, every size a power of two."""
    top, done = tiers[0], []
    rests: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # (length, document, start), ascending
    size_of = lambda n: min(t for t in tiers if t >= n)
    for doc, n in enumerate(lengths):
        done += [(top, [(doc, s, top)]) for s in range(0, n - top + 1, top)]
        if n % top:
            rests[size_of(n % top)].append((n % top, doc, n - n % top))
    for r in rests.values():
        r.sort()
    left: list[tuple[int, int, int]] = []
    for at, tier in enumerate(tiers):
        while rests[tier]:
            n, doc, start = rests[tier].pop()
            window, gap = [(doc, start, n)], tier - n
            while gap:
                for t in tiers[at:]:
                    if rests[t] and rests[t][0][0] <= gap:  # the longest rest that fits
                        n, doc, start = rests[t].pop(bisect_right(rests[t], (gap, 1 << 62, 0)) - 1)
                        window.append((doc, start, n))
                        gap -= n
                        break
                else:
                    t = next((t for t in reversed(tiers[at:]) if rests[t]), None)
                    if t is None:
                        break
                    n, doc, start = rests[t].pop(0)  # longer than the gap: cut it
                    window.append((doc, start, gap))
                    insort(rests[size_of(n - gap)], (n - gap, doc, start + gap))
                    gap = 0
            if gap:
                left += window
            else:
                done.append((tier, window))
    total = sum(n for _, _, n in left)
    while total:  # cut what is left at powers of two
        size, window = 1 << (total.bit_length() - 1), []
        total, need = total - size, size
        while need:
            doc, start, n = left.pop(0)
            if n > need:
                left.insert(0, (doc, start + need, n - need))
                n = need
            window.append((doc, start, n))
            need -= n
        done.append((size, window))
    return done


SCHEMA = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()),
        ("step_group", pa.int64())
    ]
)


def pack_documents(docs: DataFrame, path: str, end: int = 2, keep_ids: bool = True) -> DataFrame:
    """A row for each piece, with its ids (little-endian unsigned 32-bit integers; null unless keep_ids).

    sequence_id and step_group are unique and hold the task's number in the upper bits. All whole
    sequences of a step group are of one tier and together hold STEP_TOKENS tokens, but for the
    last group of a tier in a task.
    """

    def run(batches):
        tokens = _once(("words", path), lambda: WordTokenizer(path))
        base = TaskContext.get().partitionId() << 36
        sequence, filled = base, {}
        docs_, ids_, size = [], [], 0

        def block():
            nonlocal sequence
            rows: list[list] = [[] for _ in ARROW]
            for tier, window in pack([len(i) // 4 for i in ids_]):
                filled[tier] = filled.get(tier, -1) + 1
                group = base + (filled[tier] // max(1, STEP_TOKENS // tier) << 13) + tier
                offset = 0
                for doc, start, n in window:
                    piece = ids_[doc][4 * start : 4 * (start + n)]
                    for column, value in zip(
                        rows,
                        (docs_[doc], start, n, piece if keep_ids else None, zlib.crc32(piece), len(ids_[doc]) // 4, sequence, offset, tier, group),
                        strict=True
                    ):
                        column.append(value)
                    offset += n
                sequence += 1
            return batch(ARROW, *rows)

        for b in chunks(batches, "text"):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = tokens.encode(text, end)
                docs_.append(doc)
                ids_.append(ids)
                size += len(ids) // 4
                if size >= BLOCK[0] or len(docs_) >= BLOCK[1]:
                    yield block()
                    docs_, ids_, size = [], [], 0
        if docs_:
            yield block()

    return id_and_text(docs).mapInArrow(run, SCHEMA)


def packed_digests(docs: DataFrame, path: str) -> DataFrame:
    return pack_documents(docs, path, keep_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("tier").alias("sequence_tokens"),
        "step_group"
    )
