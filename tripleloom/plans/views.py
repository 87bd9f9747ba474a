"""The driver's tables in the roles of the engine's inputs: mentions, classifications, an ontology, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleloom.functions.checkpoint import checkpoint
from tripleloom.operators import alignment, ontology


class Views:
    """Views over one folder of tables. What alignment reads again and again is written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.written = spark, sf_dir, {}

    def once(self, name: str, make) -> DataFrame:
        if name not in self.written:
            self.written[name] = checkpoint(make())
        return self.written[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def mention(self, with_none: bool = True) -> DataFrame:
        rows = self.written.get("mention")
        if rows is None:
            rows = self._mention()
        return rows if with_none else rows.where("relation != 'no_relation'")

    def _mention(self) -> DataFrame:
        e, c, p = self.table("events"), self.table("customer"), self.table("part")
        rows = e.join(c, e["user_id"] == c["c_custkey"]).join(p, F.get_json_object("props", "$.k").cast("int") == p["p_partkey"])
        user = F.concat(F.lit("user "), "user_id")
        relation = F.when(F.col("event_type") == "error", "no_relation").otherwise(F.concat(F.lit("usr:"), "event_type"))
        return rows.select(
            F.col("event_id").alias("idx"), F.concat(F.lit("s"), "event_id").alias("id"),
            F.concat(user, F.lit(" "), "event_type", F.lit(" "), "p_name").alias("sentence"),
            user.alias("subject"), F.col("p_name").alias("object"), relation.alias("relation"),
            F.lower("c_mktsegment").alias("subj_type"), F.lower("p_type").alias("obj_type"), "event_type",
        )

    def pred(self) -> DataFrame:
        """A deterministic stand-in for a classifier's output over mentions with a relation."""
        m, d = self.mention(False), F.col("idx") % 10
        relation = F.when(
            d == 7, F.concat(F.lit("related_to_"), "event_type")
        ).when(d == 8, "new_relation").when(d == 9, "classification_failed").otherwise(F.col("relation"))
        return m.select(
            "idx", F.when(F.col("idx") % 19 != 0, F.col("id")).alias("id"), F.when(F.col("idx") % 19 != 0, F.col("sentence")).alias("sentence"), F.when(
                F.col("idx") % 13 == 0, F.upper("subject")
            ).otherwise(F.col("subject")).alias("subject"),
            F.when(F.col("idx") % 23 == 0, "someone else").otherwise(F.col("object")).alias("object"), relation.alias("relation"), "subj_type", F.when(
                F.col("idx") % 17 != 0, F.col("obj_type")
            ).alias("obj_type"),
        )

    def onto(self) -> DataFrame:
        return ontology.entries_of(self.mention())

    def hidden(self) -> DataFrame:
        return ontology.hidden_relations(self.onto())

    def parts(self) -> tuple[DataFrame, DataFrame]:
        return ontology.split(self.onto(), self.hidden())

    def lookup(self):
        return alignment.embed_from_table(self.table("embeddings"))

    def aligned(self, threshold: float = 0.90) -> DataFrame:
        self.once("mention", self._mention)
        known = self.once("known", lambda: self.parts()[0])
        return alignment.align(self.pred(), known, self.lookup(), alignment.AlignmentConfig(threshold))

    def unaligned(self) -> DataFrame:
        """Classified triples that did not align, with type_sig, cluster_mode and relation_emb."""
        from tripleloom.operators.clustering import stratify

        found = self.aligned().where("to_cluster").select(F.col("classified_idx").alias("idx"), "cluster_mode")
        rows = stratify(self.pred()).join(found, "idx")
        texts = alignment.view_texts(rows)
        names = texts.select("relation_text").distinct().select(F.col("relation_text").alias("text"))
        vectors = self.lookup()(names).select(F.col("text").alias("relation_text"), F.col("embedding").alias("relation_emb"))
        return texts.join(vectors, "relation_text").select(
            "idx", "id", "subject", "object", "relation", "subj_type", "obj_type", "type_sig", "cluster_mode", "relation_emb"
        )

    def scored(self) -> DataFrame:
        """Vectors with a predicted cluster (label) and a true class."""
        return self.table("embeddings").select(
            F.col("vec_id").alias("idx"), F.col("label").cast("long").alias("pred"),
            F.concat(F.lit("c"), F.col("vec_id") % 7).alias("true"), (F.col("vec_id") % 11 == 0).alias("aligned")
        )

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))

    def candidates(self) -> DataFrame:
        """A candidate for each type pair of unaligned triples."""
        rows = self.pred().where("obj_type is not null and relation not like 'usr:%'").groupBy("subj_type", "obj_type").agg(
            F.count(F.lit(1)).alias("cluster_size"), F.min("idx").alias("first")
        )
        rows = rows.withColumn("cluster_id", F.row_number().over(Window.orderBy("subj_type", "obj_type")).cast("long") - 1)  # one row a type pair
        n = F.col("cluster_size")
        return rows.select(
            "cluster_id", "subj_type", "obj_type", "cluster_size", F.concat(F.lit("rel_"), "cluster_id").alias("name"), F.when(
                F.col("cluster_id") % 5 == 4, "NOWHERE"
            ).otherwise(F.upper("subj_type")).alias("domain"), F.upper("obj_type").alias("range"),
            (n % 7 == 0).alias("existing_match"), F.when(n % 3 == 0, "Low").when(n % 3 == 1, "Medium").otherwise("High").alias("confidence"),
        )

    def evidence(self) -> DataFrame:
        rows = self.pred().where("obj_type is not null and relation not like 'usr:%'")
        return rows.join(self.candidates().select("cluster_id", "subj_type", "obj_type"), ["subj_type", "obj_type"])
