"""Embedding of triples and entries in four views, and alignment of triples to entries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.checkpoint import checkpoint
from tripleloom.functions.expressions import dot, ratio, relation_text, triple_text, type_text

VIEWS = ("triple", "relation", "subject", "object")
SIGNATURE = ("subj_type", "relation", "obj_type")
#: Entries up to so many are broadcast to the triples; above, both sides are dealt out in blocks.
BROADCAST_ENTRIES, BLOCKS = 20_000, 64


@dataclass(frozen=True)
class AlignmentConfig:
    threshold: float = 0.90


def view_texts(rows: DataFrame, subj: str = "subj_type", relation: str = "relation", obj: str = "obj_type") -> DataFrame:
    """rows with the four texts <view>_text; null for a missing type."""
    return rows.withColumns(
        {
            "triple_text": triple_text(subj, relation, obj), "relation_text": relation_text(relation),
            "subject_text": type_text(subj), "object_text": type_text(obj)
        }
    )


class Embedder(Protocol):
    """Unit vectors of texts; made anew in each Python worker."""

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Signed hashed words, unit length: deterministic and offline."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1 if h >> 31 else -1
            if not out[i].any():  # no words, or words that cancel out
                out[i, zlib.crc32(t.encode()) % self.dim] = 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed_with(make):
    """A lookup that embeds distinct texts in Python workers. make() returns an Embedder."""

    def lookup(texts: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = make()
            for b in batches:
                yield pd.DataFrame({"text": b["text"], "embedding": list(model.embed(b["text"].tolist()))})

        return texts.mapInPandas(run, "text string, embedding array<float>")

    return lookup


def embed_from_table(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding"):
    """A lookup that takes a text's vector from a table, by a hash of the text modulo the number of rows."""

    def lookup(texts: DataFrame) -> DataFrame:
        n = vectors.agg(F.count(F.lit(1)).alias("_n"))
        place = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 6), 16, 10).cast("long")
        keyed = texts.crossJoin(F.broadcast(n)).withColumn("_id", place % F.col("_n"))  # `n` is one row
        return keyed.join(vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("embedding")), "_id").select("text", "embedding")

    return lookup


def embed_views(rows: DataFrame, lookup) -> DataFrame:
    """rows (with <view>_text) and <view>_emb. Each distinct text is embedded once."""
    texts = rows.select(F.explode(F.array(*(f"{v}_text" for v in VIEWS))).alias("text")).where("text is not null").distinct()
    return with_embeddings(rows, checkpoint(lookup(texts)))  # distinct texts, read once for each view


def with_embeddings(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (with <view>_text) and <view>_emb of the texts found."""
    for v in VIEWS:
        rows = rows.join(found.select(F.col("text").alias(f"{v}_text"), F.col("embedding").alias(f"{v}_emb")), f"{v}_text", "left")
    return rows


def similarities(left: DataFrame, right: DataFrame, left_id: str, right_id: str, n_right: int) -> DataFrame:
    """left_id, right_id and sim_<view> of every pair; a missing view counts 0.

    right is an ontology. Small ones are broadcast; a large one is cut into blocks by its id, and
    left goes to every block, so that a task holds one block.
    """
    a = left.select(left_id, *(F.col(f"{v}_emb").alias(f"_a_{v}") for v in VIEWS))
    b = right.select(right_id, *(F.col(f"{v}_emb").alias(f"_b_{v}") for v in VIEWS))
    if n_right <= BROADCAST_ENTRIES:
        pairs = a.crossJoin(F.broadcast(b))
    else:
        b = b.withColumn("_block", F.pmod(F.xxhash64(right_id), F.lit(BLOCKS)))
        pairs = a.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long")))).join(b, "_block").drop("_block")
    return pairs.select(left_id, right_id, *(F.coalesce(dot(f"_a_{v}", f"_b_{v}"), F.lit(0.0)).alias(f"sim_{v}") for v in VIEWS))


def best_match(sims: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """The entry of the highest mean similarity for each left row, the smaller id on ties (of 9 decimals)."""
    score = sum((F.col(f"sim_{v}") for v in VIEWS), F.lit(0.0)) / 4
    scored = sims.withColumn("best_score", F.round(score, 9))
    best = F.max_by(F.struct(right_id, "best_score", *(f"sim_{v}" for v in VIEWS)), F.struct("best_score", -F.col(right_id)))
    return scored.groupBy(left_id).agg(best.alias("_best")).select(left_id, "_best.*")


def violates(matched: DataFrame, classes: DataFrame) -> DataFrame:
    """matched (subj_type, obj_type, domain_type, range_type) with constraint_violation: both types are known and one differs."""
    s = classes.select(F.col("class").alias("subj_type"), F.lit(True).alias("_s"))
    o = classes.select(F.col("class").alias("obj_type"), F.lit(True).alias("_o"))
    rows = matched.join(s, "subj_type", "left").join(o, "obj_type", "left")
    differs = (F.col("subj_type") != F.col("domain_type")) | (F.col("obj_type") != F.col("range_type"))
    return rows.withColumn("constraint_violation", F.coalesce(F.col("_s") & F.col("_o") & differs, F.lit(False))).drop("_s", "_o")


def signatures(triples: DataFrame) -> DataFrame:
    """Distinct signatures with a sig_id: alignment depends on nothing else."""
    rows = triples.select(*SIGNATURE).distinct()
    return rows.withColumn("sig_id", F.md5(F.concat_ws("|", *(F.coalesce(c, F.lit("\u0000")) for c in SIGNATURE)).cast("binary")))


def align_signatures(
    triples: DataFrame, entries: DataFrame, lookup, config: AlignmentConfig = AlignmentConfig(),
    class_set: DataFrame | None = None
) -> DataFrame:
    """Alignment of each distinct signature."""
    from tripleloom.operators.ontology import classes

    sig, entries = checkpoint(signatures(triples)), checkpoint(entries)
    left, right = view_texts(sig), view_texts(entries, "domain_type", "relation", "range_type")
    texts = [d.select(F.explode(F.array(*(f"{v}_text" for v in VIEWS))).alias("text")) for d in (left, right)]
    found = checkpoint(lookup(texts[0].unionByName(texts[1]).where("text is not null").distinct()))  # each distinct text of both once
    left, right = with_embeddings(left, found), with_embeddings(right, found)
    best = best_match(similarities(left, right, "sig_id", "ont_idx", entries.count()), "sig_id", "ont_idx")
    best = checkpoint(best)
    rows = sig.join(best, "sig_id", "left").join(entries.select("ont_idx", "domain_type", "range_type"), "ont_idx", "left")
    rows = violates(rows, classes(entries) if class_set is None else class_set)
    near = F.coalesce(F.col("best_score") >= config.threshold, F.lit(False))
    kind = F.when(near & ~F.col("constraint_violation"), "known_triple").when(near, "constraint_violation").otherwise("new_triple_candidate")
    rows = rows.withColumn("match_type", kind).withColumn("constraint_violation", near & F.col("constraint_violation"))
    mode = F.when(F.col("match_type") == "constraint_violation", "constraint").when(F.col("match_type") == "new_triple_candidate", "relation")
    has = lambda c, v: F.when(F.col(c).isNotNull(), F.round(f"sim_{v}", 6))
    return rows.select(
        *SIGNATURE, F.when(near, F.col("ont_idx")).alias("matched_ontology_idx"), "match_type", "constraint_violation",
        (F.col("match_type") != "known_triple").alias("to_cluster"), mode.alias("cluster_mode"),
        F.round("best_score", 6).alias("best_score"), F.round("sim_triple", 6).alias("triple_similarity"),
        F.round("sim_relation", 6).alias("relation_similarity"), has("subj_type", "subject").alias("subject_similarity"),
        has("obj_type", "object").alias("object_similarity")
    )


def align(triples: DataFrame, entries: DataFrame, lookup, config: AlignmentConfig = AlignmentConfig()) -> DataFrame:
    """classified_idx, sentence_id and the alignment of its signature, for each triple."""
    found = align_signatures(triples, entries, lookup, config)
    on = [F.col(f"t.{c}").eqNullSafe(F.col(f"f.{c}")) for c in SIGNATURE]
    rest = [F.col(f"f.{c}") for c in found.columns if c not in SIGNATURE]
    return triples.alias("t").join(found.alias("f"), on).select(F.col("t.idx").alias("classified_idx"), F.col("t.id").alias("sentence_id"), *rest)


def statistics(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("match_type") == "known_triple").alias("aligned"),
        F.count_if("to_cluster").alias("to_cluster"), F.count_if("constraint_violation").alias("violations")
    )


def confusion(results: DataFrame, samples: DataFrame, known: DataFrame) -> DataFrame:
    """Aligned or not against known or not, joined by position: counts, precision, recall, F1, specificity."""
    sig = known.select(
        F.col("relation"), F.col("domain_type").alias("subj_type"), F.col("range_type").alias("obj_type")
    ).distinct().withColumn("_known", F.lit(True))
    truth = samples.join(sig, list(SIGNATURE), "left").select(F.col("idx").alias("classified_idx"), F.coalesce("_known", F.lit(False)).alias("known"))
    rows = results.join(truth, "classified_idx").withColumn("aligned", F.col("match_type") == "known_triple")
    n = rows.agg(
        F.count_if(F.expr("aligned and known")).alias("tp"), F.count_if(F.expr("aligned and not known")).alias("fp"),
        F.count_if(F.expr("not aligned and known")).alias("fn"), F.count_if(F.expr("not aligned and not known")).alias("tn")
    )
    n = n.withColumns(
        {
            "precision": ratio("tp", F.col("tp") + F.col("fp")), "recall": ratio("tp", F.col("tp") + F.col("fn")),
            "specificity": ratio("tn", F.col("tn") + F.col("fp"))
        }
    )
    n = n.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return n.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "specificity")))


def inter_similarities(rows: DataFrame, id_col: str, block: list[str], emb: str) -> DataFrame:
    """i, j (i < j), sim of the pairs within a block, by vectors."""
    a = rows.select(*block, F.col(id_col).alias("i"), F.col(emb).alias("_a"))
    b = rows.select(*block, F.col(id_col).alias("j"), F.col(emb).alias("_b"))
    return a.join(b, block).where("i < j").select(*block, "i", "j", dot("_a", "_b").alias("sim"))


def inter_view_similarities(rows: DataFrame, id_col: str, block: list[str]) -> DataFrame:
    """block, i, j (i < j), sim_<view> of the pairs within a block, for all four views; a missing vector counts 0."""
    embs = [f"{v}_emb" for v in VIEWS]
    a = rows.select(*block, F.col(id_col).alias("i"), *(F.col(e).alias(f"_a_{e}") for e in embs))
    b = rows.select(*block, F.col(id_col).alias("j"), *(F.col(e).alias(f"_b_{e}") for e in embs))
    sims = (F.coalesce(dot(f"_a_{v}_emb", f"_b_{v}_emb"), F.lit(0.0)).alias(f"sim_{v}") for v in VIEWS)
    return a.join(b, block).where("i < j").select(*block, "i", "j", *sims)


def top_k(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
