"""SimHash near-dedup by a self-join of binary tries (3).

Fingerprints come from XXH64 (seed 42) of 4-word shingles. Distinct fingerprints alone are joined,
so exact copies, however many, are one node. Two fingerprints that differ in at most 4 bits agree in
one of 5 blocks of bits, in two of 6, in three of 7: for each such choice of blocks there is a trie
over the fingerprints permuted so that the blocks come first. The more fingerprints there are, the
more blocks are chosen, so that a trie keeps its size (5 tables up to 10 million distinct ones, 15 up
to 2.6 billion, then 35). Tries are split over the cluster at those blocks, where a pair's error
budget is whole, and each is joined with itself: pairs of nodes are walked down together, differing
bits add up, and a pair is pruned when they exceed the budget. A trie of more than MOST_IN_TRIE
fingerprints, as a crowd of near copies makes, is first split into pairs of its subtrees SPLIT_BITS
further down, walked by tasks of their own. A
task keeps the links it finds as a forest, so that a group of n near copies gives at most n - 1
links for a task and not all pairs; no fingerprint is cut off from one it is linked with. Components
come from min-label propagation with pointer jumping over written tables.

Defined cases: null, empty and wordless texts have fingerprint zero and are linked like any other;
fewer than 4 words are one shingle; bytes that aren't UTF-8 become replacement characters; repeated rows share fingerprint and component; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.common import batch, chunks, dealt, id_and_text, raw_text, table, words

SEED, SHINGLE, MOST_BITS, SALTS = 42, 4, 4, 16
MOST_IN_TRIE, SPLIT_BITS, FRONTIER = 20_000, 8, 1 << 20
#: Rows of a task on average: what a task gathers stays this size however many fingerprints there are.
ROWS_IN_TASK = 1 << 20


def fingerprint(raw: bytes) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes."""
    w = words(raw)
    if not w:
        return 0
    text, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w])
    k = min(SHINGLE, len(w))
    starts, stops = [0, *ends[: len(w) - k].tolist()], (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(text[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long of the same bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in chunks(batches, "text"):
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
            yield batch(schema, b.column("doc_id"), fp.view(np.int64))

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


class Table:
    """One way to put `ahead` of the blocks of bits first: pieces (from, to) of a fingerprint, highest bit 0, in the order of the trie."""

    def __init__(self, ahead: tuple[int, ...], blocks: int):
        edges = [round(64 * k / blocks) for k in range(blocks + 1)]
        piece = list(zip(edges[:-1], edges[1:], strict=True))
        self.first = [piece[k] for k in ahead]
        self.pieces = self.first + [p for k, p in enumerate(piece) if k not in ahead]
        self.bits = sum(b - a for a, b in self.first)

    def permuted(self, fp: np.ndarray) -> np.ndarray:
        out = np.zeros_like(fp)
        for a, b in self.pieces:
            out = (out << np.uint64(b - a)) | ((fp >> np.uint64(64 - b)) & np.uint64((1 << (b - a)) - 1))
        return out

    def restored(self, value: np.ndarray) -> np.ndarray:
        out, left = np.zeros_like(value), 64
        for a, b in self.pieces:
            left -= b - a
            out |= ((value >> np.uint64(left)) & np.uint64((1 << (b - a)) - 1)) << np.uint64(64 - b)
        return out

    def bits_of(self, begin: int, end: int):
        """The trie's bits from begin to end, as a column over fp."""
        at, out = 0, F.lit(0).cast("long")
        for a, b in self.pieces:
            lo, hi = max(begin, at), min(end, at + b - a)
            if lo < hi:
                x, y = a + lo - at, a + hi - at
                part = F.shiftrightunsigned("fp", 64 - y).bitwiseAND(F.lit((1 << (y - x)) - 1).cast("long"))
                out = F.shiftleft(out, y - x).bitwiseOR(part)
            at += b - a
        return out


def tables_for(n: int, most: int = MOST_BITS, most_in_trie: int = MOST_IN_TRIE) -> list[Table]:
    """The fewest tables whose tries hold a 16th of most_in_trie fingerprints on average.

    Of most + k blocks, two fingerprints that differ in `most` bits agree in k: each choice of k is a table.
    """
    for k in range(1, 5):
        found = [Table(c, most + k) for c in combinations(range(most + k), k)]
        if n <= most_in_trie / 16 * 2.0 ** min(t.bits for t in found):
            break
    return found


class Forest:
    """Least element of each set of linked elements, for arrays of links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            if not (open_ := x != y).any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (nearer := self.label[self.label]).tolist() != self.label.tolist() if len(self.label) < 64 else not np.array_equal(
                nearer := self.label[self.label], self.label
            ):
                self.label = nearer


def walk(value: np.ndarray, pairs: np.ndarray, depth: int, most: int, forest: Forest) -> None:
    """Walk pairs of trie nodes down together. value: ascending within each node; a node is a range of it.

    pairs: columns lo, hi, lo, hi of both nodes, and the bits in which their paths differ so far, at
    this depth. Links go to the forest. Pairs are walked in pieces of FRONTIER, the deepest first.
    """
    todo = [(depth, pairs)]
    while todo:
        depth, p = todo.pop()
        if len(p) > FRONTIER:
            todo += [(depth, p[k : k + FRONTIER]) for k in range(0, len(p), FRONTIER)]
            continue
        a0, a1, b0, b1, err = p.T
        small = (a1 - a0) * (b1 - b0) <= 16  # leaf buckets: compare what is left of both
        if small.any() or depth == 64:
            q = p[small] if depth < 64 else p
            na, nb = q[:, 1] - q[:, 0], q[:, 3] - q[:, 2]
            # at depth 64 a node is one value
            n = na * nb if depth < 64 else np.ones(len(q), np.int64)
            which = np.repeat(np.arange(len(q)), n)
            k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            i, j = q[which, 0] + k // nb[which], q[which, 2] + k % nb[which]
            keep = i != j
            i, j = i[keep], j[keep]
            near = np.bitwise_count(value[i] ^ value[j]) <= most
            forest.link(i[near], j[near])
            if depth == 64:
                continue
            p = p[~small]
            a0, a1, b0, b1, err = p.T
        if not len(p):
            continue
        bit = np.uint64(63 - depth)
        ones = np.concatenate([[0], np.cumsum((value >> bit) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # where the 1-child begins
        same = (a0 == b0) & (a1 == b1)
        child = [
            np.stack([a0, am, b0, bm, err], 1), np.stack([am, a1, bm, b1, err], 1), np.stack([a0, am, bm, b1, err + 1], 1),
            np.stack([am, a1, b0, bm, err + 1], 1)[~same]
        ]
        q = np.concatenate(child)
        q = q[(q[:, 1] > q[:, 0]) & (q[:, 3] > q[:, 2]) & (q[:, 4] <= most)]
        if len(q):
            todo.append((depth + 1, q))


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
LINKS_DDL = "a long, b long"


def _gathered(batches, names):
    got = [pa.Table.from_batches([b]) for b in batches]
    return pa.concat_tables(got).select(names) if got else None


def _links(fp: np.ndarray, forest: Forest):
    far = np.flatnonzero(forest.label != np.arange(len(fp)))
    return batch(LINKS, fp[far].view(np.int64), fp[forest.label[far]].view(np.int64))


def _join_tries(tables: list[Table], most: int):
    """For a task's rows (block, fp): the self-joins of all tries that the task holds. A block is a table's number."""

    def run(batches):
        if (got := _gathered(batches, ["block", "fp"])) is None:
            return
        block, fp = got["block"].to_numpy(), got["fp"].to_numpy().view(np.uint64)
        for k in np.unique(block):
            value, bits = np.unique(tables[k].permuted(fp[block == k])), tables[k].bits
            head = value >> np.uint64(64 - bits)
            at = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
            to = np.append(at[1:], len(value))
            roots = np.stack([at, to, at, to, np.zeros(len(at), np.int64)], 1)[to - at > 1]
            forest = Forest(len(value))
            walk(value, roots, bits, most, forest)
            yield _links(tables[k].restored(value), forest)

    return run


def _join_subtrees(tables: list[Table], most: int):
    """For a task's rows (block, x, y, child, fp): the joins of subtrees x and y of one trie each."""

    def run(batches):
        if (got := _gathered(batches, ["block", "x", "y", "child", "fp"])) is None:
            return
        rows = got.sort_by([("block", "ascending"), ("x", "ascending"), ("y", "ascending")])
        block, x, y, child = (rows[c].to_numpy() for c in ("block", "x", "y", "child"))
        fp = rows["fp"].to_numpy().view(np.uint64)
        for k in np.unique(block):
            mine = block == k
            value, part, a, b, bits = tables[k].permuted(fp[mine]), child[mine], x[mine], y[mine], tables[k].bits
            head = value >> np.uint64(64 - bits)
            order = np.lexsort((value, b, a, head))
            value, part, a, b, head = value[order], part[order], a[order], b[order], head[order]
            new = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            pairs = []
            for s, e in zip(new, np.append(new[1:], len(value)), strict=True):
                m = s + int((part[s:e] == a[s]).sum())  # the smaller child's values come first
                err = int(a[s] ^ b[s]).bit_count()
                if a[s] == b[s]:
                    pairs.append((s, e, s, e, 0))
                elif s < m < e:
                    pairs.append((s, m, m, e, err))
            forest = Forest(len(value))
            if pairs:
                walk(value, np.array(pairs), bits + SPLIT_BITS, most, forest)
            yield _links(tables[k].restored(value), forest)

    return run


def links(fps: DataFrame, most: int = MOST_BITS, most_in_trie: int = MOST_IN_TRIE) -> DataFrame:
    """a, b: links that connect what is connected by pairs of at most `most` differing bits. fps: distinct fp."""
    n = fps.count()
    tables = tables_for(n, most, most_in_trie)
    of_table = [
        F.struct(F.lit(k).alias("block"), t.bits_of(0, t.bits).alias("head"), t.bits_of(t.bits, t.bits + SPLIT_BITS).alias("child")) for k,
        t in enumerate(tables)
    ]
    rows = fps.select("fp", F.explode(F.array(*of_table)).alias("t")).select("t.*", "fp")
    large = table(rows.groupBy("block", "head").count().where(F.col("count") > most_in_trie), "tries")
    tasks = math.ceil(len(tables) * n / ROWS_IN_TASK)
    join_tries = _join_tries(tables, most)
    in_large = large.agg(F.sum("count")).first()[0]
    if not in_large:
        return dealt(rows, tasks, "block", "head").select("block", "fp").mapInArrow(join_tries, LINKS_DDL)
    few = dealt(rows.join(large, ["block", "head"], "left_anti"), tasks, "block", "head").select("block", "fp").mapInArrow(join_tries, LINKS_DDL)
    near = F.expr(f"filter(sequence(0L, {(1 << SPLIT_BITS) - 1}L), c -> bit_count(c ^ child) <= {most})")
    many = rows.join(large, ["block", "head"], "left_semi").withColumn("other", F.explode(near))
    many = many.select("block", "head", F.least("child", "other").alias("x"), F.greatest("child", "other").alias("y"), "child", "fp")
    others = sum(math.comb(SPLIT_BITS, d) for d in range(min(most, SPLIT_BITS) + 1))  # subtree pairs of a fingerprint
    return few.unionByName(
        dealt(
            many, math.ceil(in_large * others / ROWS_IN_TASK), "block", "head", "x", "y"
        ).select("block", "x", "y", "child", "fp").mapInArrow(_join_subtrees(tables, most), LINKS_DDL)
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label: the least node of each component of the links a, b.

    Links are contracted: in each round every label takes the least of its neighbours' and its own,
    then jumps to that one's label; links whose ends agree go. Rounds are logarithmic for the short
    paths that forests leave; running out of them is an error, not a wrong result.
    """
    label = table(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    open_ = table(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        if open_.isEmpty():
            return label
        both = open_.unionByName(open_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b")).where("b < a")
        hop = near.alias("x").join(
            near.select(F.col("a").alias("c"), F.col("b").alias("d")), F.col("b") == F.col("c"), "left"
        ).select("a", F.coalesce("d", "b").alias("to"))
        hop = table(hop, "hops")
        label = table(label.join(hop, F.col("label") == F.col("a"), "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        for end in ("a", "b"):
            moved = hop.select(F.col("a").alias("from"), "to")
            open_ = open_.join(moved, F.col(end) == F.col("from"), "left").withColumn(end, F.coalesce("to", end)).select("a", "b")
        open_ = table(open_.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    raise RuntimeError("components: links are left after the last round")


def _least_of(found: DataFrame, firsts: DataFrame) -> DataFrame:
    """fp, least: the least `first` of each fingerprint's component. found: node, label of linked fingerprints; firsts: fp, first.

    A component can hold a large share of all fingerprints, so the labels are salted in the join.
    """
    linked = table(found.join(firsts, F.col("node") == F.col("fp")).select("fp", "label", "first"), "linked")
    least = linked.groupBy("label").agg(F.min("first").alias("least")).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    mine = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(least, ["label", "salt"]).select("fp", "least")
    alone = firsts.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("least"))
    return mine.unionByName(alone)


def classes(docs: DataFrame, most: int = MOST_BITS, most_in_trie: int = MOST_IN_TRIE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id linked with the document."""
    prints = table(fingerprints(docs), "fingerprints")
    firsts = table(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(table(links(firsts.select("fp"), most, most_in_trie), "links"))
    of_print = table(_least_of(found, firsts), "components")
    return prints.join(of_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id")
    )


def firsts(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """The rows, with all their columns, that are the first of their class: one row of each.

    A row is known by its doc_id and a hash of its text, so rows of one doc_id with different texts are
    judged each by itself. First is the smallest doc_id (null after all others), then the smallest
    hash; of rows that agree in both, the one whose other columns come first as JSON stays.
    """
    id_, key_, row_ = (f"_{uuid.uuid4().hex}" for _ in range(3))  # names that no input has
    text = raw_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in chunks(batches, "text"):
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
            yield batch(schema, b.column("doc_id"), b.column("key"), fp.view(np.int64))

    prints = table(rows.mapInArrow(run, "doc_id long, key long, fp long"), "fingerprints")
    of_print = table(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")), "distinct")
    found = components(table(links(of_print.select("fp"), most), "links"))
    keep = table(_least_of(found, of_print).select(F.col("least.doc_id").alias(id_), F.col("least.key").alias(key_)).distinct(), "firsts")
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(row_) == F.col(key_))
    kept = docs.select("*", F.xxhash64(text).alias(row_)).join(keep, on, "left_semi")
    again = prints.groupBy("doc_id", "key").count().where("count > 1").select(F.col("doc_id").alias(id_), F.col("key").alias(key_))
    again = table(again.join(keep, (again[id_].eqNullSafe(keep[id_])) & (again[key_] == keep[key_]), "left_semi"), "again")
    if again.isEmpty():
        return kept.drop(row_)
    once = kept.join(again, on, "left_anti").drop(row_)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = kept.join(again, on, "left_semi").groupBy(
        F.col("doc_id").alias(id_), F.col(row_).alias(key_)
    ).agg(F.min_by(whole, F.to_json(whole)).alias(row_))
    return once.unionByName(first.select(f"{row_}.*"))
