"""From clusters to accepted or rejected relation candidates."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.expressions import euclidean
from tripleloom.functions.salvage import salvage
from tripleloom.operators.evaluation import centroids

LOG = logging.getLogger(__name__)
LEVELS = ("Low", "Medium", "High")


def representatives(members: DataFrame, emb: str = "triple_emb", k: int = 5, cluster: str = "cluster_id") -> DataFrame:
    """The k members nearest to their cluster's centroid, with rank and distance."""
    mean = centroids(members, cluster, emb).select(cluster, "centroid")
    rows = members.join(mean, cluster).withColumn("distance", F.round(euclidean(emb, "centroid"), 6)).drop("centroid")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(cluster).orderBy("distance", "idx"))).where(F.col("rank") <= k)


def large_clusters(members: DataFrame, least: int = 5) -> DataFrame:
    return members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size")).where(F.col("cluster_size") >= least)


def prompts(top: DataFrame, candidates: DataFrame) -> DataFrame:
    """cluster_id, prompt: the numbered representatives, the relations known for the types, the types."""
    lines = F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "subject", "relation", "object"))),
        lambda t: F.concat(t["rank"], F.lit(". "), t["subject"], F.lit(" | "), t["relation"], F.lit(" | "), t["object"])
    )
    shown = top.groupBy("cluster_id").agg(F.array_join(lines, "\n").alias("lines"))
    known = F.when(F.col("same_type_relations") == "", "None").otherwise(F.col("same_type_relations"))
    upper = lambda c: F.coalesce(F.upper(c), F.lit("UNKNOWN"))
    text = F.concat(
        F.lit("Cluster "), "cluster_id", F.lit(" of "), "cluster_size", F.lit(" triples, "), upper("subj_type"), F.lit(" to "),
        upper("obj_type"), F.lit(":\n"), "lines", F.lit("\nKnown relations: "), known,
        F.lit("\nAnswer with one JSON object: name, description, domain, range, existing_match, existing_relation_name, confidence, reasoning.")
    )
    return shown.join(candidates, "cluster_id").select("cluster_id", text.alias("prompt"))


def salvage_json(rows: DataFrame, column: str, out: str = "json") -> DataFrame:
    udf = F.pandas_udf(lambda s: s.map(salvage), "string")
    return rows.withColumn(out, udf(F.col(column)))


class Validator(Protocol):
    """Answers prompts; made anew in each Python worker."""

    def answer(self, prompts: list[str]) -> list[str]: ...


REPLY = "name string, description string, domain string, range string, existing_match boolean, existing_relation_name string, confidence string, reasoning string"


def validate(asked: DataFrame, make) -> DataFrame:
    """cluster_id and the parsed reply; all null where there was none. Write it before using it twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            try:
                answers = model.answer(b["prompt"].tolist())
            except Exception:  # a failed call is a rejected candidate, not a failed job
                LOG.exception("no answers for a batch of %d", len(b))
                answers = [None] * len(b)
            yield pd.DataFrame({"cluster_id": b["cluster_id"], "reply": [salvage(a) for a in answers]})

    return asked.select("cluster_id", "prompt").mapInPandas(run, "cluster_id long, reply string").select(
        "cluster_id", F.from_json("reply", REPLY).alias("r")
    ).select("cluster_id", "r.*")


def judge(candidates: DataFrame, classes: DataFrame, least: str = "Medium") -> DataFrame:
    """candidates with accepted and reason, checked in order: no reply, existing match, domain, range, confidence."""
    known = classes.select(F.upper("class").alias("_c")).distinct()
    rows = candidates.join(known.withColumn("_d", F.lit(True)), F.col("domain") == F.col("_c"), "left").drop("_c")
    rows = rows.join(known.withColumn("_r", F.lit(True)), F.col("range") == F.col("_c"), "left").drop("_c")
    level = F.array_position(F.array(*(F.lit(x) for x in LEVELS)), F.col("confidence"))
    reason = F.when(F.col("confidence").isNull(), "no_reply").when(F.col("existing_match"), "existing_match").when(F.col("_d").isNull(), "invalid_domain").when(F.col("_r").isNull(), "invalid_range").when(
        level < LEVELS.index(least) + 1, "low_confidence"
    ).otherwise("accepted")
    return rows.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "accepted").drop("_d", "_r")


def bucket(reason: Column) -> Column:
    """The rejection bucket of a reason."""
    return F.when(reason == "existing_match", "existing_match").when(
        reason.isin("invalid_domain", "invalid_range"), "type_incompatible"
    ).otherwise("low_confidence")


def rejected(judged: DataFrame) -> DataFrame:
    """bucket, n, clusters (sorted ids, joined) of what was not accepted."""
    rows = judged.where("not accepted").withColumn("bucket", bucket(F.col("reason")))
    return rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list("cluster_id")), lambda x: x.cast("string")), ",").alias("clusters")
    )


def rejected_report(judged: DataFrame) -> DataFrame:
    """One row: for each bucket its candidates with the fields that tell why, by cluster. A run's report, a row a candidate."""
    rows = judged.where("not accepted").withColumn("bucket", bucket(F.col("reason")))
    fields = {
        "existing_match": F.struct("cluster_id", "name", F.col("existing_relation_name").alias("matched_to")),
        "type_incompatible": F.struct("cluster_id", "name", "domain", "range"),
        "low_confidence": F.struct("cluster_id"),
    }
    return rows.agg(*(F.sort_array(F.collect_list(F.when(F.col("bucket") == b, of))).alias(b) for b, of in fields.items()))


def export(judged: DataFrame, evidence: DataFrame, most: int = 5) -> DataFrame:
    """Accepted relations with all they were judged by, the number of evidence triples and the first few of them."""
    w = Window.partitionBy("cluster_id").orderBy("idx")
    counted = evidence.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("evidence_count"))
    first = evidence.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    part = lambda c: F.coalesce(c, F.lit("N/A")).alias(c)
    listed = F.sort_array(F.collect_list(F.struct("_n", part("subject"), part("relation"), part("object"))))
    shown = first.groupBy("cluster_id").agg(F.transform(listed, lambda t: t.dropFields("_n")).alias("sample_triples"))
    told = [c for c in ("description", "reasoning") if c in judged.columns]
    rows = judged.where("accepted").join(counted, "cluster_id").join(shown, "cluster_id")
    return rows.select("cluster_id", "name", "domain", "range", "confidence", *told, "evidence_count", "sample_triples")


def export_document(accepted: DataFrame, now: str) -> DataFrame:
    """value: one JSON document, metadata and the accepted relations by cluster. A run's report, an entry a relation."""
    entries = F.sort_array(F.collect_list(F.struct("cluster_id", F.struct(*accepted.columns).alias("r"))))
    whole = accepted.agg(F.transform(entries, lambda x: x["r"]).alias("r"))
    metadata = F.struct(F.size("r").alias("n_novel_relations"), F.lit(now).alias("timestamp"))
    return whole.select(
        F.to_json(F.struct(metadata.alias("metadata"), F.col("r").alias("novel_relations")), {"ignoreNullFields": "false"}).alias("value")
    )
