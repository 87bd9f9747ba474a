"""One query per operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.functions import expressions as X
from tripleloom.functions.checkpoint import checkpoint
from tripleloom.operators import alignment as A
from tripleloom.operators import classification as C
from tripleloom.operators import clustering as K
from tripleloom.operators import evaluation as E
from tripleloom.operators import ontology as O
from tripleloom.operators import validation as L
from tripleloom.plans.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
    return f


def r6(c):
    return F.round(c, 6)


# ---- mentions and text ----


@query
def load_filter_no_relation(v):
    return v.mention(False).select("idx", "id", "subject", "relation", "object")


def _tokens(v):
    d = v.table("documents").select(F.col("doc_id"), F.split("text", " ").alias("token"))
    return d.select(
        F.col("doc_id").cast("string").alias("id"), "token", (F.col("doc_id") % 5).cast("int").alias("subj_start"),
        (F.col("doc_id") % 5 + 1).cast("int").alias("subj_end"), (F.col("doc_id") % 7 + 3).cast("int").alias("obj_start"),
        (F.col("doc_id") % 7 + 2 + F.col("doc_id") % 4).cast("int").alias("obj_end"), F.lit("  Person\t").alias("subj_type"),
        F.lit("CITY ").alias("obj_type"),
        F.when(F.col("doc_id") % 9 == 0, "no_relation").otherwise("per:city").alias("relation")
    )


@query
def span_slice_join(v):
    return C.flatten_mentions(_tokens(v)).select("id", "subject", "object", F.md5("sentence").alias("sentence_md5"))


@query
def normalise_types(v):
    p = v.table("part").select("p_partkey", F.concat(F.lit(" \t"), "p_type", F.lit("\n")).alias("t"))
    return p.select(
        "p_partkey", X.type_lower("t").alias("lower_type"), X.type_upper("t").alias("upper_type"),
        F.coalesce(F.nullif("t", F.lit("x")), F.lit("")).alias("with_default")
    )


@query
def flatten_triple(v):
    records = v.pred().select("id", "sentence", F.struct("subject", "subj_type", "relation", "object", "obj_type").alias("triple"))
    return C.flatten_triples(records)


@query
def fuzzy_entity_match(v):
    m, p = v.mention(False).select("idx", F.col("subject").alias("ms"), F.col("object").alias("mo")), v.pred().select("idx", "subject", "object")
    return m.join(p, "idx").select("idx", X.fuzzy_match("subject", "ms").alias("subject_ok"), X.fuzzy_match("object", "mo").alias("object_ok"))


@query
def meaningful_relation(v):
    return v.pred().groupBy("relation").agg(F.count(F.lit(1)).alias("n")).withColumn("meaningful", X.meaningful("relation"))


@query
def extract_json(v):
    d = v.table("documents").select("doc_id", F.concat(F.lit('So: {"a": 1} and ```json {"b": '), "n_chars", F.lit("} ```")).alias("t"))
    return L.salvage_json(d, "t").select("doc_id", "json")


# ---- ontology ----


@query
def schema_extract(v):
    return O.extract_schema(v.mention()).select("domain", "range", F.array_join("relations", ",").alias("relations"))


@query
def schema_summary(v):
    return O.schema_summary(v.mention().withColumn("obj_type", F.when(F.col("idx") % 17 != 0, F.col("obj_type"))))


@query
def schema_explode(v):
    tree = O.schema_tree(O.extract_schema(v.mention())).withColumnRenamed("relations", "tree")
    return O.explode_tree(tree)


@query
def relation_variants(v):
    return O.relation_variants(v.onto())


@query
def ontology_split(v):
    known, hidden = v.parts()
    return known.withColumn("part", F.lit("known")).unionByName(hidden.withColumn("part", F.lit("hidden")))


@query
def split_metadata(v):
    return O.split_metadata(*v.parts())


@query
def split_validate(v):
    return O.validate_split(*v.parts(), v.onto())


@query
def class_set_known(v):
    return O.classes(v.parts()[0])


@query
def class_set_full(v):
    return O.classes(v.onto(), upper=True)


@query
def hidden_labels(v):
    return O.labels(v.parts()[1])


@query
def sample_known_hidden(v):
    return O.sample_mentions(v.mention(False), *v.parts()).select("id", "relation", "is_hidden", "shuffle_key")


@query
def same_type_relations(v):
    return O.same_type_relations(v.candidates(), v.parts()[0]).select("cluster_id", "same_type_relations")


# ---- classification ----


@query
def prompt_classification(v):
    return C.prompts(v.mention(False), v.parts()[0]).select("id", F.md5("prompt").alias("prompt_md5"))


@query
def classification_join(v):
    return C.join_by_id(v.mention(False), v.pred()).select("key", "s_relation", "o_relation", "o_subject")


@query
def classification_metrics(v):
    return C.metrics(C.evaluate(v.mention(False), v.pred(), v.parts()[0]))


@query
def resume_anti_join(v):
    return C.remaining(v.mention(False), v.pred().where("idx % 3 = 0 and id is not null")).select("id")


# ---- embedding and alignment ----


@query
def embedding_texts(v):
    return A.view_texts(A.signatures(v.pred())).select(*(f"{x}_text" for x in A.VIEWS))


@query
def embed_distinct(v):
    texts = A.view_texts(v.onto(), "domain_type", "relation", "range_type").select(
        F.explode(F.array(*(f"{x}_text" for x in A.VIEWS))).alias("text")
    ).distinct()
    return v.lookup()(texts).select("text", r6(F.element_at("embedding", 1).cast("double")).alias("first"), F.size("embedding").alias("dim"))


@query
def l2_normalise(v):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 4))
    return v.vectors().select(
        "vec_id", r6(X.norm(X.l2_normalise(scaled))).alias("length"), r6(F.element_at(X.l2_normalise(scaled), 3)).alias("third")
    )


@query
def mean_pool(v):
    rows = v.vectors().groupBy("label").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("s"))
    rows = rows.select(
        "label", F.transform("s", lambda x: x["embedding"]).alias("e"),
        F.transform("s", lambda x: F.when(x["vec_id"] % 3 == 0, 0.0).otherwise(1.0)).alias("m")
    )
    return rows.select(
        "label", r6(F.element_at(X.masked_mean("e", "m", 64), 1)).alias("first"),
        r6(F.element_at(X.last_unmasked("e", "m"), 1).cast("double")).alias("last_first")
    )


def _sims(v):
    left = A.embed_views(A.view_texts(A.signatures(v.pred())), v.lookup())
    known = v.parts()[0]
    right = A.embed_views(A.view_texts(known, "domain_type", "relation", "range_type"), v.lookup())
    return A.similarities(left, right, "sig_id", "ont_idx", known.count())


@query
def sim_triple_ontology(v):
    return _sims(v).select("sig_id", "ont_idx", *(r6(f"sim_{x}").alias(f"sim_{x}") for x in A.VIEWS))


@query
def align_argmax(v):
    return A.best_match(_sims(v), "sig_id", "ont_idx").select("sig_id", "ont_idx", r6("best_score").alias("best_score"))


@query
def align_results(v):
    return v.aligned()


@query
def align_stats(v):
    return A.statistics(v.aligned())


@query
def align_metrics(v):
    return A.confusion(v.aligned(), v.mention(False), v.parts()[0])


@query
def sim_inter_triple(v):
    return A.inter_similarities(v.vectors(), "vec_id", ["label"], "embedding").select("label", "i", "j", r6("sim").alias("sim"))


@query
def sim_inter_views(v):
    rows = K.stratify(A.embed_views(A.view_texts(A.signatures(v.pred())), v.lookup()))
    return A.inter_view_similarities(rows, "sig_id", ["type_sig"]).select("type_sig", "i", "j", *(r6(f"sim_{x}").alias(f"sim_{x}") for x in A.VIEWS))


@query
def cosine_normalise(v):
    own = v.vectors().select("label", F.col("vec_id").alias("i"), (X.dot("embedding", "embedding") * 2).alias("own"))
    sims = A.inter_similarities(v.vectors(), "vec_id", ["label"], "embedding")
    rows = sims.join(own.select("i", F.col("own").alias("oi")), "i").join(own.select(F.col("i").alias("j"), F.col("own").alias("oj")), "j")
    return rows.select("i", "j", r6(X.cosine_unit_interval(F.col("sim") * 2, "oi", "oj")).alias("value"))


@query
def cosine_distance(v):
    return E.cosine_distances(v.vectors(), "vec_id", "label", "embedding", 6)


# ---- clustering ----


@query
def type_stratify(v):
    return K.strata(v.pred())


@query
def graph_split_edges(v):
    return K.split_edges(v.unaligned(), ["type_sig", "cluster_mode"], "relation", "relation_emb", 0.05).select(
        "type_sig", "cluster_mode", "a", "b", "pairs", r6("sim").alias("sim"), r6("threshold").alias("threshold")
    )


def _split(v):
    return K.graph_split(v.unaligned(), ["type_sig", "cluster_mode"], floor=0.05)


@query
def graph_split_components(v):
    return _split(v).select("idx", "type_sig", "relation", "cluster_id")


@query
def cluster_quality(v):
    return K.quality(_split(v))


@query
def cluster_similarity(v):
    return K.cluster_similarity(_split(v)).select("cluster_id", "n", *(r6(c).alias(c) for c in ("mean_sim", "min_sim", "max_sim")))


@query
def cluster_report_top5(v):
    return K.top_labels(v.unaligned().withColumn("cluster_id", F.col("type_sig"))).select("cluster_id", "relation", "n", "rank")


@query
def cluster_report(v):
    found = K.report(v.unaligned().withColumn("cluster_id", F.col("type_sig")))
    return found.select("cluster_id", "n", "n_relations", *(r6(c).alias(c) for c in ("mean_sim", "min_sim", "max_sim")), "components")


@query
def graph_split_default(v):
    return K.graph_split(v.unaligned(), ["type_sig", "cluster_mode"]).select("idx", "type_sig", "relation", "cluster_id")


@query
def cluster_summary(v):
    return K.summary(v.unaligned().withColumn("cluster_id", F.concat("type_sig", "relation")))


def _with_singletons(v):
    rows = checkpoint(v.unaligned()).withColumn("_r", F.row_number().over(K.Window.partitionBy("type_sig", "relation").orderBy("idx")))
    code = F.conv(F.substring(F.md5(F.concat("type_sig", F.lit("/"), "relation").cast("binary")), 1, 8), 16, 10).cast("long")
    return rows.withColumn("cluster_id", F.when(F.col("_r") == 1, code * 2 + 1).otherwise(code * 2)).drop("_r")


@query
def singleton_merge_onepass(v):
    return K.merge_singletons_once(_with_singletons(v))


@query
def singleton_merge_exact(v):
    return K.merge_singletons_in_turn(_with_singletons(v))


@query
def consensus_labels(v):
    return K.consensus_labels(v.unaligned(), v.lookup(), zero_diagonal=True)


@query
def eigengap_k(v):
    return K.consensus_labels(v.unaligned(), v.lookup()).select("type_sig", "eigengap_k").distinct()


# ---- evaluation ----


@query
def ground_truth_lookup(v):
    return E.ground_truth(v.pred().select(F.col("idx").alias("classified_idx"), F.col("id").alias("sentence_id")), v.mention(False))


@query
def flat_labels(v):
    return E.flat_labels(v.pred(), v.pred().where("idx % 4 != 0").select("idx", (F.col("idx") % 6).alias("cluster_id")))


def _hidden_classes(v):
    return v.scored().select(F.col("true").alias("relation")).distinct().where("relation in ('c1', 'c4')")


@query
def eval_masks(v):
    return E.masks(v.scored(), _hidden_classes(v))


def _table(v):
    return E.contingency(v.scored())


@query
def contingency(v):
    return _table(v)


@query
def bcubed(v):
    return E.bcubed(_table(v))


@query
def vmeasure(v):
    return E.v_measure(_table(v))


@query
def ari(v):
    return E.adjusted_rand(_table(v))


@query
def hungarian_map(v):
    mapping, accuracy = E.map_clusters(E.collected(_table(v)))
    return v.spark.createDataFrame([(int(k), c, round(accuracy, 6)) for k, c in sorted(mapping.items())], "pred long, true string, accuracy double")


@query
def ami(v):
    _, _, n = E._counts(E.collected(_table(v)))
    return v.spark.createDataFrame([(round(float(E.adjusted_mutual_information(n)), 6),)], "ami double")


@query
def stratified_eval(v):
    found = E.flatten_metrics(E.stratified(E.masks(v.scored(), _hidden_classes(v))))
    return v.spark.createDataFrame([(k, float(x)) for k, x in sorted(found.items())], "metric string, value double")


@query
def metric_flatten(v):
    rows = E.bcubed(_table(v)).withColumn("subset", F.lit("overall"))
    return rows.unpivot(
        ["subset"], ["bcubed_precision", "bcubed_recall", "bcubed_f1"], "metric", "value"
    ).select(F.concat_ws("_", "subset", "metric").alias("name"), "value")


@query
def silhouette(v):
    return E.silhouette(v.vectors(), "label", "embedding")


@query
def davies_bouldin(v):
    return E.davies_bouldin(v.vectors(), "label", "embedding")


@query
def calinski_harabasz(v):
    return E.calinski_harabasz(v.vectors(), "label", "embedding")


@query
def density_sep(v):
    return E.density_separation(v.vectors(), "label", "embedding")


@query
def dunn(v):
    return E.dunn(v.vectors(), "label", "embedding")


@query
def quality_bundle(v):
    return E.quality_bundle(v.vectors(), "label", "embedding")


def _type_pairs(v):
    pair = F.when(F.col("vec_id") % 5 != 4, F.concat(F.lit("p"), F.col("vec_id") % 5))
    return E.type_pair_quality(v.vectors().withColumn("pair", pair).withColumn("label", F.col("label") % 3), "pair", "label", "embedding")


@query
def typepair_quality(v):
    return _type_pairs(v)


@query
def typepair_summary(v):
    return E.type_pair_summary(_type_pairs(v))


# ---- validation ----


@query
def representatives_topk(v):
    rows = v.vectors().select(F.col("vec_id").alias("idx"), F.col("label").alias("cluster_id"), "embedding")
    return L.representatives(rows, "embedding").select("cluster_id", "idx", "rank", "distance")


@query
def large_clusters(v):
    return L.large_clusters(v.evidence(), 25)


@query
def prompt_validation(v):
    top = A.top_k(v.evidence(), "cluster_id", ["idx"], 5)
    known = O.same_type_relations(v.candidates(), v.parts()[0])
    return L.prompts(top, known).select("cluster_id", F.md5("prompt").alias("prompt_md5"))


def _judged(v):
    return L.judge(v.candidates(), O.classes(v.onto()))


@query
def accept_candidates(v):
    return _judged(v).select("cluster_id", "name", "reason", "accepted")


@query
def rejected_buckets(v):
    return L.rejected(_judged(v))


@query
def novel_export(v):
    shown = F.transform("sample_triples", lambda t: F.concat_ws("|", t["subject"], t["relation"], t["object"]))
    return L.export(_judged(v), v.evidence()).select(
        "cluster_id", "name", "domain", "range", "confidence", "evidence_count",
        F.array_join(shown, ";").alias("sample_triples")
    )


@query
def rejected_report(v):
    found = L.rejected_report(_judged(v).withColumn("existing_relation_name", F.lower("name")))
    part = lambda b, *names: F.array_join(
        F.transform(b, lambda x: F.concat_ws("|", *(x[n].cast("string") for n in names))), ";"
    ).alias(b)
    return found.select(
        part("existing_match", "name", "matched_to", "cluster_id"),
        part("type_incompatible", "name", "domain", "range", "cluster_id"), part("low_confidence", "cluster_id")
    )
