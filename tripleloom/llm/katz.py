"""Katz backoff language model: training over tables split by n-gram, scoring token by token (2).

Texts become blocks: every token as a number among the block's distinct words. A block asks the
unigram table, split by word, for its words' codes, which hold the training counts; then the bigram
table, split by context, for the counts of its distinct pairs. What travels are packed arrays of
distinct words and pairs of a block, summed before they leave it, never single tokens. Splits follow
the tokens alone, whatever the session's number of partitions. Above FAN splits messages go by two
hops, in bundles: from blocks to groups of splits, and from groups of blocks to splits, so that
their number grows as the input to the power 1.5 and not 2.

A word's code is its training count, up to a cap, and a number among the words of that count. Words
at the cap (a share of the tokens that a split holds on average, so there are at most about as many
of them as splits) have their exact counts in a small broadcast table. As contexts they are split by
pair, and their sums are added up afterwards, so a hot word never fills a task.

Order 2: counts are discounted by Good-Turing up to 5 (Katz's formula, so that the unigrams that
occur once pay for the unknown word), with log-linear counts of counts where the raw ones give no
discounts; where that is undefined too, and in a context all of whose counts are larger, by an
absolute discount N1 / (N1 + 2 N2). The backoff weight of a context is what its discounts left over
what its unseen words have among unigrams, so that probabilities over vocabulary and unknown word
add up to one exactly. A token's probability is the discounted bigram if that was seen, else weight
times the discounted unigram, else weight times the unknown word's: `backoff` goes down the orders.
The first word's context is the start of the text.

Defined cases: a null or empty text is its end token alone; without any training text the only word
is the unknown one, with probability 1; repeated rows count as often as they come; a text longer
than a block is a block by itself; bytes that aren't UTF-8 become replacement characters; an empty
table gives no rows. Ties cannot arise: words of one count are numbered by their bytes.
"""

from __future__ import annotations

import gc
import math
import struct
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.common import chunks, dealt, id_and_text, lean, table, words

K, ADD, BLOCK_BYTES, SPLIT_BYTES = 5, 0.1, 12 << 20, 12 << 20
#: Splits that a block writes to without a hop between.
FAN = 1024
#: A code: a count of up to 21 bits, then a number of 41 bits. No trained word has count 0.
SHIFT, MOST_CAP = 41, (1 << 21) - 1
UNKNOWN, START = 0, 1

#: One layout for blocks, requests and answers, so that they can be gathered by block or by split.
LAYOUT = pa.schema([("block", pa.int64()), ("split", pa.int64()), ("kind", pa.string()), ("body", pa.binary())])
DDL = "block long, split long, kind string, body binary"
#: Its tables hold packed bytes, in few large rows: small row groups bound a writer's memory.
AS_IT_IS = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": str(8 << 20)}

_squeeze, _expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, 0 or more, as compressed planes of bytes: small ones take little space."""
    x = np.ascontiguousarray(x, "<u8")
    planes = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return bytes([planes]) + _squeeze.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_expand.decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<i8").ravel()


def squeezed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def expanded(raw: bytes) -> bytes:
    return _expand.decompress(raw)


def pile(*parts: bytes) -> bytes:
    return struct.pack(f"<B{len(parts)}Q", len(parts), *map(len, parts)) + b"".join(parts)


def unpile(raw: bytes) -> list[bytes]:
    sizes = struct.unpack_from(f"<{raw[0]}Q", raw, 1)
    at, out = 1 + 8 * raw[0], []
    for n in sizes:
        out.append(raw[at : at + n])
        at += n
    return out


def rises(x: np.ndarray) -> bytes:
    """Ascending numbers, packed as differences."""
    return packed(np.diff(x, prepend=0))


def risen(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw))


def code_pile(code: np.ndarray, ascending: bool = False) -> bytes:
    """Codes as counts and numbers apart; ascending ones as differences, of numbers within a count."""
    count, number = code >> SHIFT, code & ((1 << SHIFT) - 1)
    if ascending and len(code):
        same = np.concatenate([[False], count[1:] == count[:-1]])
        number = number - np.where(same, np.concatenate([[0], number[:-1]]), 0)
        count = np.diff(count, prepend=0)
    return pile(packed(count), packed(number))


def code_unpile(raw: bytes, ascending: bool = False) -> np.ndarray:
    count, number = map(unpacked, unpile(raw))
    if ascending and len(count):
        begin = np.flatnonzero(np.concatenate([[True], count[1:] != 0]))
        total = np.cumsum(number)
        number = total - np.repeat(total[begin] - number[begin], np.diff(np.append(begin, len(number))))
        count = np.cumsum(count)
    return (count << SHIFT) | number


class Rows:
    """Rows of the layout, handed on as one Arrow table."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, block: int, split: int, kind: str, *parts: bytes) -> None:
        self.rows.append((block, split, kind, pile(*parts)))

    def table(self) -> pa.Table:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * len(LAYOUT)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, LAYOUT, strict=True)], schema=LAYOUT)


def bodies(t: pa.Table | pa.RecordBatch, kind: str | None = None):
    """block, split, parts of each row, in the order of block and split; one row's bytes at a time."""
    rows = sorted(zip(t["block"].to_pylist(), t["split"].to_pylist(), t["kind"].to_pylist(), range(t.num_rows), strict=True))
    for block, split, what, at in rows:
        if kind is None or what == kind:
            yield block, split, unpile(t["body"][at].as_py())


def bundled(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as to:
        to.write_table(rows)
    return out.getvalue().to_pybytes()


def opened_bundles(t: pa.Table) -> pa.Table:
    """The rows in the bundles of a table's rows, and its other rows."""
    inside = [t.filter(pc.not_equal(t["kind"], "bundle"))]
    for row in t.filter(pc.equal(t["kind"], "bundle"))["body"]:
        inside.append(pa.ipc.open_stream(unpile(row.as_py())[0]).read_all())
    return pa.concat_tables(inside)


def hopped(messages: DataFrame, to: str, splits: int) -> DataFrame:
    """Messages for one side (`to`: split or block), bundled on the way if there are many splits."""
    if splits <= FAN:
        return messages
    groups, origin = math.ceil(math.sqrt(splits / 8)), "block" if to == "split" else "split"  # 8 MB or so each pair of groups
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups))

    def wrap(batches):
        for b in batches:
            for g in set(b["to_group"].to_pylist()):
                rows = pa.Table.from_batches([b]).filter(pc.equal(b["to_group"], g))
                for f in set(rows["from_group"].to_pylist()):
                    part = rows.filter(pc.equal(rows["from_group"], f)).select(LAYOUT.names)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g]), pa.array([f]), pa.array([bundled(part)], pa.binary())],
                        ["to_group", "from_group", "body"]
                    )

    def again(t: pa.Table) -> pa.Table:
        out, rows = Rows(), pa.concat_tables(pa.ipc.open_stream(x.as_py()).read_all() for x in t["body"])
        for at in sorted(set(rows[to].to_pylist())):
            part = bundled(rows.filter(pc.equal(rows[to], at)))
            out.add(*((-1, at) if to == "split" else (at, -1)), "bundle", part)
        return out.table()

    wide = messages.withColumns({"to_group": group(to), "from_group": group(origin)}).mapInArrow(wrap, "to_group long, from_group long, body binary")
    return dealt(wide, splits, "to_group", "from_group").groupBy("to_group", "from_group").applyInArrow(lean(again), DDL)


def number_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the frequent ones first; every token's number; the number of tokens of each text."""
    number: dict[bytes, int] = {b"": 0}  # the end; no word is empty
    stream, sizes = array("i"), []
    for t in texts:
        w = words(t)
        stream.extend([number.setdefault(x, len(number)) for x in w])
        stream.append(0)
        sizes.append(len(w) + 1)
    seen = np.frombuffer(stream, np.int32)
    order = np.argsort(-np.bincount(seen, minlength=len(number)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    found = list(number)
    return [found[k] for k in order], rank[seen], np.array(sizes)


def block_rows(block: int, splits: int, docs: list[int | None], train: list[bool], texts: list[bytes]) -> pa.Table:
    """The block, and what it asks the unigram table: its words by split, with their training counts."""
    found, stream, sizes = number_words(texts)
    out, missing, taught = Rows(), np.array([d is None for d in docs]), np.array(train)
    out.add(
        block, 0, "block", packed(np.array([d or 0 for d in docs], np.int64).view(np.uint64)), packed(taught + 2 * missing),
        packed(sizes), packed(stream)
    )
    trained = np.bincount(stream, np.repeat(taught, sizes), len(found)).astype(np.int64)
    split = np.fromiter((zlib.crc32(w) % splits for w in found), np.int64, len(found))
    order = np.argsort(split, kind="stable")
    for s, i, j in runs(split[order]):
        at = order[i:j]
        out.add(block, s, "ask", rises(at), packed(trained[at]), squeezed(b"\n".join([found[x] for x in at])))
    return out.table()


class Block:
    """A block's documents and tokens, the codes of its words, and its distinct pairs."""

    def __init__(self, t: pa.Table, splits: int, cap: int, exact: dict[int, int]):
        for _, _, (docs, flags, sizes, stream) in bodies(t, "block"):
            self.docs, flags = unpacked(docs), unpacked(flags)
            self.train, self.missing = flags % 2 > 0, flags > 1
            self.sizes, self.stream = unpacked(sizes), unpacked(stream)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.code = np.full(int(self.stream.max()) + 1, UNKNOWN, np.int64)
        for _, _, (at, code) in bodies(t, "words"):
            self.code[risen(at)] = code_unpile(code)
        self.count = counts_of(self.code, cap, exact)
        self._pairs(splits, cap)

    def _pairs(self, splits: int, cap: int) -> None:
        """Distinct pairs of context and word; the asked ones (of a known context) by split, context, word."""
        n = len(self.code)
        before = np.empty(len(self.stream), np.int64)
        before[1:] = self.stream[:-1]
        before[self.begins] = n  # the start
        key, self.pair_of = np.unique((before << 32) | self.stream, return_inverse=True)
        self.pair_of = self.pair_of.astype(np.int32)
        self.context, self.word = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32)
        self.trained = np.bincount(self.pair_of, np.repeat(self.train, self.sizes), len(key)).astype(np.int64)
        codes = np.append(self.code, START)
        self.u, self.w = codes[self.context], self.code[self.word]
        home = mixed(codes)
        asked = np.flatnonzero(self.u != UNKNOWN)
        h = home[self.context[asked]]
        often = is_frequent(self.u[asked], cap)
        h[often] = mixed((h[often] ^ mixed(self.w[asked[often]] + 2)).view(np.int64))
        split = ((h >> np.uint64(32)) % np.uint64(splits)).astype(np.int32)
        order = np.lexsort((self.w[asked], self.u[asked], split))
        self.asked, self.split = asked[order], split[order]


def counts_of(code: np.ndarray, cap: int, exact: dict[int, int]) -> np.ndarray:
    """Training counts of words by their codes; exact: of the codes at the cap."""
    count = code >> SHIFT
    for at in np.flatnonzero(count == cap).tolist():
        count[at] = exact[int(code[at])]
    return count


def is_frequent(u: np.ndarray, cap: int) -> np.ndarray:
    return (u == START) | (u >> SHIFT == cap)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def begins(x: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


def runs(x: np.ndarray):
    """Value, begin, end of each run."""
    at = begins(x)
    yield from zip(x[at].tolist(), at.tolist(), [*at[1:].tolist(), len(x)], strict=True)


def turing(n: list[float]) -> list[float] | None:
    """Katz's factors for counts 1 to K, if all are in (0, 1] and the first is a discount."""
    if not all(n[1:]) or (rest := (K + 1) * n[K + 1] / n[1]) == 1:
        return None
    d = [((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest) for r in range(1, K + 1)]
    return d if all(0 < x <= 1 for x in d) and d[0] < 1 else None


def smoothed(n: list[float]) -> list[float] | None:
    """Counts of counts on the line through their logarithms."""
    at = np.array([r for r in range(1, K + 2) if n[r]])
    if len(at) < 2:
        return None
    slope, level = np.polyfit(np.log(at), np.log([n[r] for r in at]), 1)
    return [0.0, *np.exp(level + slope * np.log(np.arange(1, K + 2))).tolist()]


class Discount:
    """From the number of n-grams by count (1 to K + 1): Good-Turing factors, from smoothed numbers if the raw ones give none; else an absolute discount."""

    def __init__(self, of: np.ndarray):
        n = [0.0, *map(float, of)]
        self.absolute = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] else 0.1
        self.factor = np.ones(K + 1)
        d = turing(n) or (turing(line) if (line := smoothed(n)) else None)
        self.good = d is not None
        if d:
            self.factor[1:] = d

    def discounted(self, count: np.ndarray, absolute: np.ndarray | bool) -> np.ndarray:
        c = count.astype(np.float64)
        turing = c * np.where(count <= K, self.factor[np.minimum(count, K)], 1.0)
        return np.where(absolute, c - self.absolute, turing)

    def mass(self, of: np.ndarray, types: np.ndarray, absolute: np.ndarray | bool) -> np.ndarray:
        """What the discounts leave. of: n-grams by count 1 to K, a column each."""
        return np.where(absolute, self.absolute * types, of @ ((1 - self.factor[1:]) * np.arange(1, K + 1)))


class Unigrams:
    def __init__(self, tokens: int, types: int, of: np.ndarray):
        self.tokens, self.types, self.discount = tokens, types, Discount(of)
        absolute = not self.discount.good
        self.absolute = absolute
        self.unknown = float(self.discount.mass(of[None, :K].astype(float), np.array([types]), absolute)[0]) / tokens if tokens else 1.0

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.discount.discounted(count, self.absolute) / max(1, self.tokens), self.unknown)


def by_count(count: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(count, K + 2), minlength=K + 3)[1 : K + 2]


def weights(stats: np.ndarray, rest: np.ndarray, discount: Discount) -> tuple[np.ndarray, np.ndarray]:
    """Backoff weights and whether the absolute discount holds. stats: count, types, types by count 1 to K; rest: unigram mass of seen words."""
    absolute = ~((stats[:, 2:].sum(1) > 0) & discount.good)
    left = discount.mass(stats[:, 2:].astype(float), stats[:, 1], absolute) / np.maximum(stats[:, 0], 1)
    return np.where(stats[:, 0] > 0, left / (1 - rest), 1.0), absolute  # a context never seen in training hands all on




def blocks_of(docs: DataFrame, splits: int, modulus: int, id_col: str, text_col: str) -> DataFrame:
    """The blocks and what they ask the unigram table, written once."""
    rows = id_and_text(docs, id_col, text_col)

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        ids, train, texts, size = [], [], [], 0
        for b in chunks(batches, "text", BLOCK_BYTES):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(i)
                train.append(i is not None and zlib.crc32(str(i).encode()) % modulus != 0)
                texts.append(t)
                size += len(t)
                if size >= BLOCK_BYTES:
                    yield from block_rows(block, splits, ids, train, texts).to_batches()
                    block, ids, train, texts, size = block + 1, [], [], [], 0
        if ids:
            yield from block_rows(block, splits, ids, train, texts).to_batches()

    return table(rows.mapInArrow(run, DDL), "blocks", AS_IT_IS)


def by_split(messages: DataFrame, splits: int):
    return dealt(hopped(messages, "split", splits), splits, "split").groupBy("split")


def by_block(blocks: DataFrame, splits: int, *answers: DataFrame):
    frame = blocks
    for a in answers:
        frame = frame.unionByName(hopped(a, "block", splits))
    return dealt(frame, splits, "block").groupBy("block")


def answer_unigrams(asks: DataFrame, splits: int, cap: int) -> DataFrame:
    """Codes for blocks (kind `words`); each split of the unigram table (`unigrams`), its sums, and its words at the cap (`often`)."""

    def run(t: pa.Table) -> pa.Table:
        out, total, got, split = Rows(), defaultdict(int), [], 0
        for block, split, (at, trained, names) in bodies(opened_bundles(t)):
            names = expanded(names).split(b"\n")
            got.append((block, at, names))
            for x, n in zip(names, unpacked(trained).tolist(), strict=True):
                total[x] += n
        known = sorted((x for x, n in total.items() if n), key=lambda x: (-total[x], x))
        count = np.array([total[x] for x in known], np.int64)
        capped = np.minimum(count, cap)
        first = begins(capped)
        number = np.arange(len(known)) - np.repeat(first, np.diff(np.append(first, len(known))))
        codes = (capped << SHIFT) | (number * splits + split)
        code = dict(zip(known, codes.tolist(), strict=True))
        for block, at, names in got:
            out.add(block, split, "words", at, code_pile(np.array([code.get(x, UNKNOWN) for x in names], np.int64)))
        out.add(-1, split, "unigrams", squeezed(b"\n".join(known)), packed(count))
        out.add(-1, split, "sums", packed(np.concatenate([[count.sum(), len(count)], by_count(count)])))
        often = capped == cap
        out.add(-1, split, "often", packed(codes[often]), packed(count[often]))
        return out.table()

    return table(by_split(asks, splits).applyInArrow(lean(run), DDL), "unigrams", AS_IT_IS)


def ask_bigrams(opened: Callable[[pa.Table], Block]) -> Callable[[pa.Table], pa.Table]:
    """What a block asks the bigram table: its distinct pairs by split, with their training counts."""

    def run(t: pa.Table) -> pa.Table:
        k, out = opened(t), Rows()
        block = max(t["block"].to_pylist())
        for s, i, j in runs(k.split):
            at = k.asked[i:j]
            u = k.u[at]
            first = begins(u)
            lengths = np.diff(np.append(first, len(u)))
            out.add(block, s, "ask", code_pile(u[first], ascending=True), packed(lengths), code_pile(k.w[at]), packed(k.trained[at]))
        return out.table()

    return run


def answer_bigrams(asks: DataFrame, splits: int, unigrams: Unigrams, cap: int, often) -> DataFrame:
    """Counts for blocks (kind `counts`); each split of the bigram table (`bigrams`), its sums, and the sums of frequent contexts (`frequent`)."""

    def run(t: pa.Table) -> pa.Table:
        out, split, rows = Rows(), 0, []
        for block, split, (u, lengths, w, trained) in bodies(opened_bundles(t)):
            rows.append((block, code_unpile(u, ascending=True), unpacked(lengths), code_unpile(w), unpacked(trained)))
        us, at = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
        ws, iw = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True)
        iu = np.repeat(at, np.concatenate([r[2] for r in rows]))
        key, pair = np.unique((iu << 32) | iw, return_inverse=True)
        del iw
        total = np.bincount(pair, np.concatenate([r[4] for r in rows]), len(key)).astype(np.int64)
        seen = total > 0
        context, word, count = key[seen] >> 32, key[seen] & 0xFFFFFFFF, total[seen]
        stats = np.stack(
            [np.bincount(context, weight, len(us)) for weight in (count, np.ones(len(count)), *(count == r for r in range(1, K + 1)))],
            1
        ).astype(np.int64)
        rest = np.bincount(context, unigrams.p(counts_of(ws, cap, often.value))[word], len(us))
        large = stats[:, 2:].sum(1) == 0  # all counts are over K
        frequent = is_frequent(us, cap)
        p = c = 0
        for block, u, lengths, _, trained in rows:
            mine, of = slice(p, p + int(lengths.sum())), at[c : c + len(u)]
            p, c = mine.stop, c + len(u)
            n = total[pair[mine]]
            unseen = np.bincount(np.repeat(np.arange(len(u)), lengths), n == 0, len(u)) > 0
            need = np.flatnonzero(unseen & ~frequent[of])
            out.add(
                block, split, "counts", packed(n - trained), squeezed(np.packbits(large[of]).tobytes()), rises(need),
                packed(stats[of[need]].ravel()), rest[of[need]].astype("<f8").tobytes()
            )
        first = begins(context)  # keys are in the order of context, then word
        out.add(
            -1, split, "bigrams", code_pile(us[context[first]], ascending=True),
            packed(np.diff(np.append(first, len(context)))), code_pile(ws[word]), packed(count)
        )
        out.add(-1, split, "sums", packed(np.concatenate([[len(count)], by_count(count)])))
        if frequent.any():
            out.add(-1, split, "frequent", packed(us[frequent]), packed(stats[frequent].ravel()), rest[frequent].astype("<f8").tobytes())
        return out.table()

    return table(by_split(asks, splits).applyInArrow(lean(run), DDL), "bigrams", AS_IT_IS)


def summed(frame: DataFrame, width: int) -> np.ndarray:
    """Sums over the splits."""
    names = [f"s{k}" for k in range(width)]

    def run(batches):
        for b in batches:
            rows = np.array([unpacked(parts[0]) for _, _, parts in bodies(b)]).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows.T], names)

    row = frame.where("kind = 'sums'").mapInArrow(
        run, ", ".join(f"{c} long" for c in names)
    ).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in names)).first()
    return np.array(list(row), np.int64)


def frequent_contexts(frame: DataFrame, discount: Discount) -> dict[int, tuple[float, bool, int]]:
    """Backoff weight, whether the absolute discount holds, and count of the contexts that are split by pair: about as many as splits at most."""
    names = [f"s{k}" for k in range(K + 2)]

    def run(batches):
        for b in batches:
            for _, _, (u, stats, rest) in bodies(b):
                columns = unpacked(stats).reshape(-1, K + 2).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unpacked(u)), *(pa.array(np.ascontiguousarray(x)) for x in columns), pa.array(np.frombuffer(rest, "<f8"))],
                    ["u", *names, "rest"]
                )

    columns = [*names, "rest"]
    sums = frame.where("kind = 'frequent'").mapInArrow(run, "u long, " + ", ".join(f"{c} long" for c in names) + ", rest double")
    sums = sums.groupBy("u").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    stats = np.stack([sums[c].to_numpy() for c in names], 1)
    weight, absolute = weights(stats, sums["rest"].to_numpy(), discount)
    return dict(zip(sums["u"].to_pylist(), zip(weight.tolist(), absolute.tolist(), stats[:, 0].tolist(), strict=True), strict=True))


def backoff(levels: list[tuple], lowest: np.ndarray) -> np.ndarray:
    """Probabilities by the highest order. levels: (whether seen, discounted probability, weight of the context), lowest order first."""
    if not levels:
        return lowest
    seen, discounted, weight = levels[-1]
    return np.where(seen, discounted, weight * backoff(levels[:-1], lowest))


def release(spark) -> None:
    """Let Spark drop the shuffle files of steps whose tables are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("gain_per_token", pa.float64())
    ]
)
RESULT_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, gain_per_token double"


def score(docs: DataFrame, modulus: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document, and how much higher than base_score score is a token."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("binary")))).first()[0] or 0
    splits = max(1, math.ceil(n_bytes / SPLIT_BYTES))
    written = blocks_of(docs, splits, modulus, id_col, text_col)
    blocks, cap = written.where("kind = 'block'"), min(MOST_CAP, max(1, n_bytes // (8 * splits)))  # about 8 bytes a token, with its space
    first = answer_unigrams(written.where("kind = 'ask'"), splits, cap)
    release(spark)
    sums = summed(first, K + 3)
    unigrams = Unigrams(int(sums[0]), int(sums[1]), sums[2:])
    exact = {}
    for r in first.where("kind = 'often'").select("body").toArrow()["body"].to_pylist():
        exact.update(zip(*(unpacked(x).tolist() for x in unpile(r)), strict=True))
    often = spark.sparkContext.broadcast(exact)
    of_words = first.where("kind = 'words'")
    opened = lambda t: Block(opened_bundles(t), splits, cap, often.value)
    second = answer_bigrams(by_block(blocks, splits, of_words).applyInArrow(lean(ask_bigrams(opened)), DDL), splits, unigrams, cap, often)
    release(spark)
    discount = Discount(summed(second, K + 2)[1:])
    frequent = spark.sparkContext.broadcast(frequent_contexts(second, discount))

    def evaluate(t: pa.Table) -> pa.Table:
        t = opened_bundles(t)
        k = opened(t)
        answers = {split: parts for _, split, parts in bodies(t, "counts")}
        n = len(k.u)
        count, absolute, weight = np.zeros(n, np.int64), np.full(n, not discount.good), np.ones(n)
        for s, i, j in runs(k.split):
            at, (found, large, need, stats, rest) = k.asked[i:j], answers.pop(s)
            first = begins(k.u[at])
            which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
            count[at] = k.trained[at] + unpacked(found)  # what other blocks have
            absolute[at] |= np.unpackbits(np.frombuffer(expanded(large), np.uint8), count=len(first)).astype(bool)[which]
            alpha = np.ones(len(first))
            alpha[risen(need)], _ = weights(unpacked(stats).reshape(-1, K + 2), np.frombuffer(rest, "<f8"), discount)
            weight[at] = alpha[which]
        of_context = np.append(k.count, 0)[k.context]
        for u in np.unique(k.u[is_frequent(k.u, cap)]).tolist():
            weight[k.u == u], absolute[k.u == u], of_context[k.u == u] = frequent.value.get(u, (1.0, False, 0))
        of_word = k.count[k.word]
        seen = count > 0
        p = backoff([(seen, discount.discounted(count, absolute) / np.maximum(of_context, 1), weight)], unigrams.p(of_word))
        base = np.log10((k.count + ADD) / (unigrams.tokens + ADD * (unigrams.types + 1)))
        total = lambda x: np.add.reduceat(x, k.begins)
        known, base, best = total((k.count > 0)[k.stream].astype(np.int64)), total(base[k.stream]), total(np.log10(p)[k.pair_of])
        doc = pa.array(k.docs, mask=k.missing)
        return pa.Table.from_arrays(
            [
                doc, pa.array(~k.train), pa.array(k.sizes), pa.array(known), pa.array(np.full(len(k.docs), unigrams.tokens)),
                pa.array(base), pa.array(best), pa.array((best - base) / k.sizes)
            ],
            schema=RESULT
        )

    return by_block(blocks, splits, of_words, second.where("kind = 'counts'")).applyInArrow(lean(evaluate), RESULT_DDL)
