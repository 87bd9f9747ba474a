"""The stages of a run: schema extraction, classification, alignment, clustering, validation.

A run is a folder that driver and executors share. Each stage reads what the one before wrote, so a
stage can be repeated or resumed by itself; answers of models are written once and never recomputed.
Tables that later stages read are Parquet, reports are JSON.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleloom.functions.checkpoint import checkpoint
from tripleloom.operators import alignment, classification, clustering, evaluation, ontology, validation
from tripleloom.sources import readers
from tripleloom.streaming.resume import resume

MODES = ("relation", "constraint")
SIGNATURE = list(alignment.SIGNATURE)


def present(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_text(one: DataFrame, path: str) -> None:
    """A frame of one row, `value`, as a text file in a folder."""
    one.coalesce(1).write.mode("overwrite").text(path)


def write_manifest(spark: SparkSession, settings: dict, path: str) -> None:
    """Settings and counts of a run as YAML."""
    import yaml

    write_text(spark.createDataFrame([(yaml.safe_dump(settings, sort_keys=False),)], "value string"), path)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(report),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def extract_schema(spark: SparkSession, data: str, out: str) -> DataFrame:
    """Write the schema tree of a data file; returns its summary."""
    raw = checkpoint(spark.read.schema(readers.MENTION).option("multiLine", True).json(data).select("subj_type", "obj_type", "relation"))
    readers.write_json(ontology.schema_tree(ontology.extract_schema(raw)).coalesce(1), out)
    return ontology.schema_summary(raw)


def prepare(spark: SparkSession, folder: str, data: str, schema: str, hidden: list[str] | None = None, share: float = 0.2, seed: int = 42) -> None:
    """Split the ontology and number the samples; both stay as they are when a run is resumed."""
    entries = checkpoint(readers.schema_tree(spark, schema))
    known, withheld = ontology.split(entries, checkpoint(ontology.hidden_relations(entries, share, seed, hidden)))
    known = known.withColumn("ont_idx", F.row_number().over(Window.orderBy("ont_idx")).cast("long") - 1)  # an ontology's size
    for name, part in (("full", entries), ("known", known), ("hidden", withheld)):
        part.write.mode("overwrite").parquet(f"{folder}/01_ontology/{name}")
    readers.write_json(ontology.split_metadata(known, withheld, "given" if hidden else "hash"), f"{folder}/01_ontology/split_metadata")
    samples = readers.with_idx(ontology.sample_mentions(readers.mentions(spark, data), known, withheld, seed), ["shuffle_key", "id"])
    samples.drop("shuffle_key").write.mode("overwrite").parquet(f"{folder}/02_classification/samples")


def triples_of(spark: SparkSession, folder: str) -> DataFrame:
    """Classified triples with the idx of their sample; of several records of an id, the least."""
    records = readers.records(
        spark, f"{folder}/02_classification/records"
    ).groupBy("id").agg(F.min(F.struct("sentence", "triple")).alias("r")).select("id", "r.*")
    place = spark.read.parquet(f"{folder}/02_classification/samples").groupBy("id").agg(F.max("idx").alias("idx"))
    return classification.flatten_triples(records).withColumnRenamed("sentence_id", "id").join(place, "id")


def classify(spark: SparkSession, folder: str, data: str, schema: str, make, **split) -> DataFrame:
    """Classify the samples that have no record yet; returns the metrics. make() returns a Classifier."""
    if not present(spark, f"{folder}/02_classification/samples/_SUCCESS"):
        prepare(spark, folder, data, schema, **split)
    samples = spark.read.parquet(f"{folder}/02_classification/samples")
    known = spark.read.parquet(f"{folder}/01_ontology/known")
    records = f"{folder}/02_classification/records"
    resume(spark, classification.with_prompts(samples, known), records, make, first=not present(spark, records))
    details = checkpoint(classification.evaluate(samples, triples_of(spark, folder), known))
    readers.write_json(details, f"{folder}/02_classification/details")
    found = classification.metrics(details)
    readers.write_json(found, f"{folder}/02_classification/metrics")
    return found


def align(spark: SparkSession, folder: str, lookup, threshold: float = 0.90) -> DataFrame:
    """Align the classified triples with the known entries; returns the confusion counts."""
    triples, known = checkpoint(triples_of(spark, folder)), spark.read.parquet(f"{folder}/01_ontology/known")
    alignment.align(triples, known, lookup, alignment.AlignmentConfig(threshold)).write.mode("overwrite").parquet(f"{folder}/03_alignment/results")
    results = spark.read.parquet(f"{folder}/03_alignment/results")
    readers.write_json(alignment.statistics(results), f"{folder}/03_alignment/statistics")
    found = alignment.confusion(results, spark.read.parquet(f"{folder}/02_classification/samples"), known)
    readers.write_json(found, f"{folder}/03_alignment/metrics")
    return found


def embedded(triples: DataFrame, lookup) -> DataFrame:
    """triples with relation_emb and triple_emb, embedded once for each distinct signature."""
    signatures = alignment.embed_views(alignment.view_texts(triples.select(*SIGNATURE).distinct()), lookup)
    vectors = checkpoint(signatures.select(*SIGNATURE, "relation_emb", "triple_emb"))
    on = [F.col(f"t.{c}").eqNullSafe(F.col(f"v.{c}")) for c in SIGNATURE]
    return triples.alias("t").join(vectors.alias("v"), on).select("t.*", "v.relation_emb", "v.triple_emb")


def join_singletons(members: DataFrame, threshold: float) -> DataFrame:
    """members after singletons joined large clusters of their mode, numbered anew over both modes."""
    moved = None
    for mode in MODES:
        part = clustering.merge_singletons_in_turn(members.where(F.col("cluster_mode") == mode), threshold=threshold).withColumn("_mode", F.lit(mode))
        moved = part if moved is None else moved.unionByName(part)
    moved = checkpoint(moved)
    clusters = moved.select("_mode", "cluster_id").distinct()
    number = clusters.withColumn("_new", F.row_number().over(Window.orderBy(F.desc("_mode"), "cluster_id")).cast("long") - 1)  # one row a cluster
    return members.drop("cluster_id").join(moved.join(number, ["_mode", "cluster_id"]).select("idx", F.col("_new").alias("cluster_id")), "idx")


def cluster(
    spark: SparkSession, folder: str, lookup, similarity: float = clustering.SIMILARITY, runs: int = 3,
    preserve_singletons: bool = True, merge: float = clustering.MERGE, zero_diagonal: bool = False
) -> dict[str, dict]:
    """Cluster what did not align; returns the metrics of the three subsets.

    Triples that break a constraint are one cluster before the graph split, the others one for each
    type pair and consensus part. With preserve_singletons off, singletons may join large clusters.
    """
    results, triples = spark.read.parquet(f"{folder}/03_alignment/results"), triples_of(spark, folder)
    unaligned = triples.join(results.where("to_cluster").select(F.col("classified_idx").alias("idx"), "cluster_mode"), "idx")
    rows = checkpoint(clustering.stratify(embedded(unaligned, lookup)))
    parts = clustering.consensus_labels(
        rows.where("cluster_mode = 'relation'"), lookup, zero_diagonal=zero_diagonal, runs=runs
    ).select("type_sig", "relation", "part")
    rows = rows.join(checkpoint(parts), ["type_sig", "relation"], "left")
    by_type = F.col("cluster_mode") == "relation"
    rows = rows.withColumns(
        {"stratum": F.when(by_type, F.col("type_sig")).otherwise(""), "part": F.when(by_type, F.col("part")).otherwise(0).cast("long")}
    )
    members = clustering.graph_split(rows, ["cluster_mode", "stratum", "part"], floor=similarity)
    if not preserve_singletons:
        members = join_singletons(members, merge)
    members.write.mode("overwrite").parquet(f"{folder}/04_clustering/members")
    members = spark.read.parquet(f"{folder}/04_clustering/members")
    readers.write_json(clustering.quality(members), f"{folder}/04_clustering/quality")
    readers.write_json(clustering.summary(members), f"{folder}/04_clustering/summary")
    truth = evaluation.ground_truth(results, spark.read.parquet(f"{folder}/02_classification/samples"))
    aligned = results.select(F.col("classified_idx").alias("idx"), (F.col("match_type") == "known_triple").alias("aligned"))
    scored = evaluation.flat_labels(triples, members).join(truth, "idx").join(aligned, "idx")
    found = evaluation.stratified(checkpoint(evaluation.masks(scored, ontology.labels(spark.read.parquet(f"{folder}/01_ontology/hidden")))))
    write_report(spark, found, f"{folder}/04_clustering/stratified_metrics")
    return found


def validate(spark: SparkSession, folder: str, make, top_k: int = 5, min_cluster_size: int = 5, min_confidence: str = "Medium") -> DataFrame:
    """Ask about each large cluster; returns the accepted relations. make() returns a Validator."""
    members = spark.read.parquet(f"{folder}/04_clustering/members")
    sizes = checkpoint(validation.large_clusters(members, min_cluster_size))
    top = checkpoint(
        validation.representatives(members.join(sizes.select("cluster_id"), "cluster_id", "left_semi"), k=top_k).drop("relation_emb", "triple_emb")
    )
    types = top.where("rank = 1").select("cluster_id", "subj_type", "obj_type")
    candidates = ontology.same_type_relations(sizes.join(types, "cluster_id"), spark.read.parquet(f"{folder}/01_ontology/known"))
    replies = checkpoint(validation.validate(validation.prompts(top, candidates), make))
    classes = ontology.classes(spark.read.parquet(f"{folder}/01_ontology/full"), upper=True)
    judged = checkpoint(validation.judge(sizes.join(replies, "cluster_id", "left"), classes, min_confidence))
    readers.write_json(judged, f"{folder}/05_validation/candidates")
    write_text(
        validation.rejected_report(judged).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")),
        f"{folder}/05_validation/rejected_candidates"
    )
    now = datetime.now(timezone.utc).isoformat()
    accepted = checkpoint(validation.export(judged, members))
    readers.write_json(accepted, f"{folder}/05_validation/novel_relations")
    write_text(validation.export_document(accepted, now), f"{folder}/05_validation/novel_relations_document")
    n = judged.agg(F.count(F.lit(1)).alias("seen"), F.count_if("accepted").alias("accepted")).first()
    counts = {
        "n_clusters_seen": members.select("cluster_id").distinct().count(), "n_novel_accepted": n["accepted"],
        "n_rejected": n["seen"] - n["accepted"]
    }
    settings = {"top_k_representatives": top_k, "min_cluster_size": min_cluster_size, "min_confidence": min_confidence}
    write_manifest(spark, {"validation": settings, "timestamp": now, **counts}, f"{folder}/05_validation/00_config")
    return accepted
