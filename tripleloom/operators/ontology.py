"""Ontologies: schema trees, entries (ont_idx, relation, domain_type, range_type), known and hidden parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.expressions import NO_RELATION, type_lower, type_upper

TREE = "map<string,map<string,array<string>>>"


def extract_schema(mentions: DataFrame) -> DataFrame:
    """domain, range, relations (sorted, distinct) from subj_type, obj_type, relation; incomplete rows and no_relation go."""
    rows = mentions.select(
        type_upper(F.coalesce("subj_type", F.lit(""))).alias("domain"),
        type_upper(F.coalesce("obj_type", F.lit(""))).alias("range"), F.coalesce("relation", F.lit("")).alias("relation")
    )
    rows = rows.where((F.col("relation") != NO_RELATION) & (F.col("domain") != "") & (F.col("range") != "") & (F.col("relation") != ""))
    return rows.groupBy("domain", "range").agg(F.sort_array(F.collect_set("relation")).alias("relations"))


def schema_summary(mentions: DataFrame) -> DataFrame:
    """n_domains, n_pairs, n_labels, n_skipped (rows with a part missing)."""
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    skipped = mentions.where(F.coalesce(F.col("relation") != NO_RELATION, F.lit(True))).agg(
        F.count_if(missing("subj_type") | missing("obj_type") | missing("relation")).alias("n_skipped")
    )
    schema = extract_schema(mentions).agg(
        F.count_distinct("domain").alias("n_domains"), F.count(F.lit(1)).alias("n_pairs"),
        F.coalesce(F.sum(F.size("relations")), F.lit(0)).cast("long").alias("n_labels")
    )
    return schema.crossJoin(F.broadcast(skipped))  # one row each


def schema_tree(schema: DataFrame) -> DataFrame:
    """One row: the tree as a map of maps, domains in order."""
    inner = schema.groupBy("domain").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("range", "relations")))).alias("ranges"))
    rows = F.sort_array(F.collect_list(F.struct("domain", F.map_entries("ranges").alias("e"))))
    return inner.agg(F.map_from_entries(F.transform(rows, lambda d: F.struct(d["domain"], F.map_from_entries(d["e"])))).alias("relations"))


def explode_tree(tree: DataFrame, column: str = "tree") -> DataFrame:
    """Entries of a schema tree in file order, duplicates kept, types lower-cased, no_relation left out."""
    ranges = tree.select(F.posexplode(column).alias("p1", "domain", "ranges"))
    labels = ranges.select("p1", "domain", F.posexplode("ranges").alias("p2", "range", "labels"))
    rows = labels.select("p1", "domain", "p2", "range", F.posexplode("labels").alias("p3", "relation")).where(F.col("relation") != NO_RELATION)
    order = Window.orderBy("p1", "p2", "p3")  # a schema file, not a data table
    return rows.select(
        (F.row_number().over(order) - 1).cast("long").alias("ont_idx"), "relation", F.lower("domain").alias("domain_type"),
        F.lower("range").alias("range_type")
    )


def entries_of(mentions: DataFrame) -> DataFrame:
    """Distinct signatures of mentions as entries, numbered in order of relation, domain, range."""
    rows = mentions.where(F.col("relation") != NO_RELATION).select(
        "relation", type_lower("subj_type").alias("domain_type"), type_lower("obj_type").alias("range_type")
    ).distinct()
    order = Window.orderBy("relation", "domain_type", "range_type")  # signatures: an ontology's size
    return rows.select((F.row_number().over(order) - 1).cast("long").alias("ont_idx"), "relation", "domain_type", "range_type")


def relation_variants(entries: DataFrame) -> DataFrame:
    """relation, n_variants of the relations with several signatures."""
    return entries.groupBy("relation").agg(F.count(F.lit(1)).alias("n_variants")).where("n_variants > 1")


def hidden_relations(entries: DataFrame, share: float = 0.2, seed: int = 42, given: list[str] | None = None) -> DataFrame:
    """The relations withheld: those given, or the first by a seeded hash, one at least; all variants of a relation move together."""
    names = entries.select("relation").distinct()
    if given and not (named := names.where(F.col("relation").isin(given))).isEmpty():
        return named
    ranked = names.withColumn("place", F.row_number().over(Window.orderBy(F.md5(F.concat("relation", F.lit(str(seed))).cast("binary")), "relation")))
    wanted = names.agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * share)).cast("int").alias("wanted"))
    return ranked.join(F.broadcast(wanted), F.col("place") <= F.col("wanted")).select("relation")  # `wanted` is one row


def split(entries: DataFrame, hidden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known and hidden entries."""
    return entries.join(
        hidden, "relation", "left_anti"
    ).select(entries.columns), entries.join(hidden, "relation", "left_semi").select(entries.columns)


def split_metadata(known: DataFrame, hidden: DataFrame, mode: str = "hash") -> DataFrame:
    """One row of counts, the sorted hidden relations and the share that was hidden."""
    one = lambda d, n: d.agg(
        F.count_distinct("relation").alias(f"n_{n}_relations"), F.count(F.lit(1)).alias(f"n_{n}_entries"),
        F.array_join(F.sort_array(F.collect_set("relation")), ",").alias(f"{n}_relations")
    )
    both = one(known, "known").crossJoin(F.broadcast(one(hidden, "hidden")))  # one row each
    share = F.try_divide(F.col("n_hidden_relations").cast("double"), (F.col("n_known_relations") + F.col("n_hidden_relations")).cast("double"))
    return both.select(
        "n_known_relations", "n_hidden_relations", "n_known_entries", "n_hidden_entries", F.lit(mode).alias("split_mode"),
        "hidden_relations", F.round(share, 6).alias("hidden_split_ratio")
    )


def validate_split(known: DataFrame, hidden: DataFrame, original: DataFrame) -> DataFrame:
    """entries_conserved, entries_disjoint, labels_separate."""
    key = ["relation", "domain_type", "range_type"]
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias(n))
    rows = count(known, "k").crossJoin(count(hidden, "h")).crossJoin(count(original, "o")).crossJoin(count(known.select(key).intersect(hidden.select(key)), "both")).crossJoin(
        count(known.select("relation").intersect(hidden.select("relation")), "labels")
    )
    return rows.select(
        (F.col("k") + F.col("h") == F.col("o")).alias("entries_conserved"), (F.col("both") == 0).alias("entries_disjoint"),
        (F.col("labels") == 0).alias("labels_separate")
    )


def classes(entries: DataFrame, upper: bool = False) -> DataFrame:
    """class: the distinct domain and range types."""
    name = F.explode(F.array("domain_type", "range_type")).alias("class")
    found = entries.select(name).where("class is not null").distinct()
    return found.select(F.upper("class").alias("class")).distinct() if upper else found


def labels(entries: DataFrame) -> DataFrame:
    return entries.select("relation").distinct()


def sample_mentions(mentions: DataFrame, known: DataFrame, hidden: DataFrame, seed: int = 42) -> DataFrame:
    """Mentions whose signature is known or hidden, with is_hidden, in a seeded order (shuffle_key)."""
    sig = ["relation", "domain_type", "range_type"]
    rows = mentions.withColumn("domain_type", F.lower("subj_type")).withColumn("range_type", F.lower("obj_type"))
    part = lambda e, flag: rows.join(e.select(sig).distinct(), sig, "left_semi").withColumn("is_hidden", F.lit(flag))
    both = part(known, False).unionByName(part(hidden, True)).drop("domain_type", "range_type")
    return both.withColumn("shuffle_key", F.md5(F.concat("id", F.lit(str(seed))).cast("binary")))


def same_type_relations(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """Candidates with the relations known for their pair of types (upper-cased lookup), sorted and joined; empty without any."""
    index = entries.groupBy(
        F.upper("domain_type").alias("_d"), F.upper("range_type").alias("_r")
    ).agg(F.sort_array(F.collect_set("relation")).alias("_relations"))
    on = (F.upper("subj_type") == F.col("_d")) & (F.upper("obj_type") == F.col("_r"))
    return candidates.join(index, on, "left").withColumn(
        "same_type_relations", F.coalesce(F.array_join("_relations", ","), F.lit(""))
    ).drop("_d", "_r", "_relations")
