"""All stages of a run on a small data file, with models that answer by rule."""

import json

import pytest
from pyspark.sql import functions as F

from tripleloom.__main__ import parser
from tripleloom.operators.alignment import HashEmbedder, embed_with
from tripleloom.operators.classification import PromptClassifier
from tripleloom.plans import stages

TYPES = {
    "per:employee_of": ("PERSON", "ORG"), "per:born_in": ("PERSON", "CITY"), "org:founded_by": ("ORG", "PERSON"),
    "org:based_in": ("ORG", "CITY"), "per:title": ("PERSON", "TITLE")
}
HIDDEN = ["per:title"]


class Clerk:
    """Answers with a rule of its own: the relation is written in the sentence."""

    def answer(self, prompts):
        out = []
        for p in prompts:
            words = p.split("\n")[0].split()
            relation = next(w for w in words if ":" in w and w != "Sentence:")
            out.append(
                None if "broken" in words else f'Sure: {{"subject": "{words[1]}", "relation": "{relation.replace("title", "job_title")}", "object": "{words[-1]}"}}'
            )
        return out


class Judge:
    def answer(self, prompts):
        return [
            json.dumps(
                {"name": f"r{i}", "domain": "PERSON", "range": "TITLE", "existing_match": False, "confidence": "High"}
            ) if "PERSON to TITLE" in p else None for i,
            p in enumerate(prompts)
        ]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    rows = [
        {
            "id": f"x{i}", "token": [f"s{i}", r, "of", "broken" if i == 7 else "fine", f"o{i}"], "subj_start": 0, "subj_end": 0,
            "obj_start": 4, "obj_end": 4, "subj_type": d, "obj_type": g, "relation": r
        } for i,
        (r, (d, g)) in enumerate(list(TYPES.items()) * 12)
    ]
    rows.append({**rows[0], "id": "none", "relation": "no_relation"})
    (folder / "data.json").write_text(json.dumps(rows))
    return folder


def test_run(spark, files):
    data, schema, out = f"{files}/data.json", f"file://{files}/schema", f"file://{files}/run"
    summary = stages.extract_schema(spark, data, schema).first()
    assert (summary.n_pairs, summary.n_labels, summary.n_skipped) == (5, 5, 0)

    make = lambda: PromptClassifier(Clerk())
    metrics = {r.part: r for r in stages.classify(spark, out, data, schema, make, hidden=HIDDEN).collect()}
    assert metrics["overall"].n == 60 and metrics["known"].n == 48 and metrics["known"].relation_exact_match == pytest.approx(47 / 48, abs=1e-6)
    assert metrics["hidden"].relation_exact_match == 0 and metrics["hidden"].relation_classification_rate == 1

    # resumed: every sample has its record already
    before = spark.read.text(f"{out}/02_classification/records").count()
    stages.classify(spark, out, data, schema, make, hidden=HIDDEN)
    assert spark.read.text(f"{out}/02_classification/records").count() == before == 60

    lookup = embed_with(HashEmbedder)
    c = stages.align(spark, out, lookup).first()
    assert (c.tp, c.fp, c.fn, c.tn) == (47, 0, 1, 12)

    found = stages.cluster(spark, out, lookup)
    assert found["novel_discovery"]["n_samples"] == 12 and found["novel_discovery"]["n_clusters"] == 1
    assert found["overall_pipeline"]["n_samples"] == 13
    members = spark.read.parquet(f"{out}/04_clustering/members")
    assert members.count() == 13 and members.select("idx").distinct().count() == 13
    assert stages.cluster(spark, out, lookup, preserve_singletons=False)["overall_pipeline"]["n_samples"] == 13

    got = stages.validate(spark, out, Judge).collect()
    assert [(r.domain, r.range, r.evidence_count) for r in got] == [("PERSON", "TITLE", 12)]
    assert spark.read.json(f"{out}/05_validation/novel_relations").count() == 1


def test_singletons_of_both_modes_are_numbered_together(spark):
    rows = [(0, "a:b", "r", "constraint"), (1, "c:d", "r", "constraint"), (2, "a:b", "r", "relation")]
    made = spark.createDataFrame(rows, "idx long, type_sig string, relation string, cluster_mode string")
    members = made.withColumn("relation_emb", F.array(F.lit(1.0))).withColumn("cluster_id", F.col("idx"))
    joined = {r.idx: r.cluster_id for r in stages.join_singletons(members, 0.8).collect()}
    assert joined == {2: 0, 0: 1, 1: 2}  # singletons alone: no large cluster to join


def test_flags():
    o = parser().parse_args(["cluster", "--folder", "f", "--no-preserve-singletons"])
    assert o.similarity_threshold == 0.60 and not o.preserve_singletons
