"""python -m tripleloom STAGE: one stage of a run, or all of them from a YAML file."""

from __future__ import annotations

import argparse
import logging
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from tripleloom.operators.alignment import HashEmbedder, embed_with
from tripleloom.operators.classification import PromptClassifier
from tripleloom.plans import stages
from tripleloom.sources.models import HttpModel, TransformerEmbedder
from tripleloom.sources.readers import Config

LOG = logging.getLogger("tripleloom")


def lookup_of(name: str):
    """A lookup for a model's name; `hash` is the offline one."""
    return embed_with(HashEmbedder if name == "hash" else lambda: TransformerEmbedder(name))


def classifier_of(url: str, model: str, temperature: float = 0.0, max_tokens: int = 500):
    return lambda: PromptClassifier(HttpModel(url, model, temperature, max_tokens))


def run_all(spark: SparkSession, config: Config, now: str | None = None) -> str:
    """All stages into a folder of their own; returns it."""
    now = now or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    folder = f"{config.output.get('base_dir', 'results')}/{config.run_name}_{now}"
    c, a, k, v = config.classification, config.alignment, config.clustering, config.validation
    lookup = lookup_of(a.get("embedder_model", "hash"))
    stages.classify(spark, folder, config.data["test_path"], config.data["schema_path"], classifier_of(c["base_url"], c["model"]))
    stages.align(spark, folder, lookup, a.get("threshold", 0.90))
    stages.cluster(spark, folder, lookup, k.get("similarity_threshold", 0.60), k.get("n_consensus_runs", 3), k.get("preserve_singletons", True))
    stages.validate(
        spark, folder, lambda: HttpModel(v["base_url"], v["model"]), v.get("top_k_representatives", 5),
        v.get("min_cluster_size", 5), v.get("min_confidence", "Medium")
    )
    stages.write_manifest(spark, {**config.settings(), "finished": datetime.now(timezone.utc).isoformat()}, f"{folder}/00_config")
    return folder


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tripleloom", description=__doc__)
    top.add_argument("--log", help="append the log to this file as well")
    sub = top.add_subparsers(dest="stage", required=True)

    def stage(name: str, **flags):
        p = sub.add_parser(name)
        for flag, options in flags.items():
            p.add_argument(f"--{flag.replace('_', '-')}", **options)

    need, endpoint = {"required": True}, {
        "base_url": {"required": True}, "model": {"required": True}, "temperature": {"type": float, "default": 0.0},
        "max_tokens": {"type": int, "default": 500}
    }
    stage("extract-schema", data=need, output=need)
    stage("classify", folder=need, data=need, schema=need, **endpoint)
    stage("align", folder=need, embedder={"default": "hash"}, threshold={"type": float, "default": 0.90})
    stage(
        "cluster", folder=need, embedder={"default": "hash"}, similarity_threshold={"type": float, "default": 0.60},
        consensus_runs={"type": int, "default": 3},
        preserve_singletons={"action": argparse.BooleanOptionalAction, "default": True}
    )
    stage(
        "validate", folder=need, **endpoint, top_k={"type": int, "default": 5}, min_cluster_size={"type": int, "default": 5},
        min_confidence={"choices": ["Low", "Medium", "High"], "default": "Medium"}
    )
    stage("run", config=need)
    return top


def main(argv: list[str] | None = None) -> None:
    o = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    LOG.setLevel(logging.INFO)
    if o.log:
        copy = logging.FileHandler(o.log)
        copy.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
        LOG.addHandler(copy)
    spark = SparkSession.builder.appName(f"tripleloom {o.stage}").getOrCreate()
    LOG.info("%s begins", o.stage)
    if o.stage == "extract-schema":
        stages.extract_schema(spark, o.data, o.output).show()
    elif o.stage == "classify":
        stages.classify(spark, o.folder, o.data, o.schema, classifier_of(o.base_url, o.model, o.temperature, o.max_tokens)).show()
    elif o.stage == "align":
        stages.align(spark, o.folder, lookup_of(o.embedder), o.threshold).show()
    elif o.stage == "cluster":
        LOG.info("%s", stages.cluster(spark, o.folder, lookup_of(o.embedder), o.similarity_threshold, o.consensus_runs, o.preserve_singletons))
    elif o.stage == "validate":
        stages.validate(
            spark, o.folder, lambda: HttpModel(o.base_url, o.model, o.temperature, o.max_tokens), o.top_k, o.min_cluster_size,
            o.min_confidence
        ).show()
    else:
        with open(o.config) as f:
            LOG.info("%s", run_all(spark, Config.load(f.read())))
    LOG.info("%s is done", o.stage)


if __name__ == "__main__":
    main()
