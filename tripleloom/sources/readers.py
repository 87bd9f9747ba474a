"""Readers and writers of the engine's records. Every schema is declared; a bad line is a row, not a failed job."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleloom.operators.classification import RECORD, flatten_mentions
from tripleloom.operators.ontology import TREE, explode_tree

MENTION = "id string, token array<string>, subj_start int, subj_end int, obj_start int, obj_end int, subj_type string, obj_type string, relation string"
SAMPLE = "id string, sentence string, subject string, object string, relation string, subj_type string, obj_type string"
ENTRY = "relation string, domain_type string, range_type string"


def mentions(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a JSON array of tokenised mentions."""
    return flatten_mentions(spark.read.schema(MENTION).option("multiLine", True).json(path))


def schema_tree(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a schema file, with or without the `relations` wrapper."""
    raw = spark.read.text(path, wholetext=True)
    tree = F.coalesce(F.get_json_object("value", "$.relations"), F.col("value"))
    return explode_tree(raw.select(F.from_json(tree, TREE).alias("tree")))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Classification records of JSON lines; blank and broken lines are left out."""
    return spark.read.schema(f"{RECORD}, _corrupt_record string").option(
        "mode", "PERMISSIVE"
    ).json(path).where("id is not null").drop("_corrupt_record")


def samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE).option("multiLine", True).json(path)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """Ontology entries of a JSON array, numbered in file order."""
    raw = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.from_json("value", f"array<struct<{ENTRY.replace(' string', ':string')}>>")).alias("ont_idx", "e")
    )
    return raw.select(F.col("ont_idx").cast("long").alias("ont_idx"), "e.*")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, nulls kept; mode append adds to what is there."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def with_idx(df: DataFrame, order: list[str]) -> DataFrame:
    """A dense idx from 0 in the given order, without moving all rows to one task.

    Rows are sorted over partitions; each partition's offset comes from the partitions' sizes.
    """
    rows = df.orderBy(*order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    offsets = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")  # one row a partition
    return rows.join(F.broadcast(offsets), "_p").withColumn(
        "idx", F.col("_before") + F.col("_m") - F.col("_first")
    ).drop("_p", "_m", "_before", "_first")


@dataclass(frozen=True)
class Config:
    """A run's settings, read from YAML."""

    run_name: str = "run"
    data: dict = field(default_factory=dict)
    output: dict = field(default_factory=dict)
    classification: dict = field(default_factory=dict)
    alignment: dict = field(default_factory=lambda: {"threshold": 0.90})
    clustering: dict = field(default_factory=lambda: {"similarity_threshold": 0.60, "n_consensus_runs": 3, "preserve_singletons": True})
    validation: dict = field(default_factory=lambda: {"top_k_representatives": 5, "min_cluster_size": 5, "min_confidence": "Medium"})

    @classmethod
    def load(cls, text: str) -> Config:
        import yaml

        given = yaml.safe_load(text) or {}
        return cls(**{f.name: given[f.name] for f in fields(cls) if f.name in given})

    def settings(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def dump(self) -> str:
        import yaml

        return yaml.safe_dump(self.settings(), sort_keys=False)
