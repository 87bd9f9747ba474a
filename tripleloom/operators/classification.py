"""Mentions, classified triples, and how well the classifications fit."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.expressions import NO_RELATION, fuzzy_match, meaningful, ratio, span_text, type_lower
from tripleloom.functions.salvage import salvage


def flatten_mentions(raw: DataFrame) -> DataFrame:
    """Samples from tokenised mentions; no_relation goes."""
    return raw.where(F.col("relation") != NO_RELATION).select(
        "id", F.array_join("token", " ").alias("sentence"), span_text("token", "subj_start", "subj_end").alias("subject"),
        span_text("token", "obj_start", "obj_end").alias("object"), "relation", type_lower("subj_type").alias("subj_type"),
        type_lower("obj_type").alias("obj_type")
    )


def flatten_triples(records: DataFrame) -> DataFrame:
    """sentence_id and the fields of the nested triple."""
    return records.select(
        F.col("id").alias("sentence_id"), "sentence", "triple.subject", "triple.subj_type", "triple.relation", "triple.object",
        "triple.obj_type"
    )


def remaining(samples: DataFrame, done: DataFrame) -> DataFrame:
    """Samples without an output yet: what a resumed run has to do."""
    return samples.join(done.select("id").distinct(), "id", "left_anti")


def last_by(rows: DataFrame, key, order: str = "idx") -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy("_key").orderBy(F.col(order).desc())
    return rows.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def record_key(*columns: str):
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in columns))


def join_by_id(samples: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row for each key that both have, the last row of each side: key, s_* and o_*."""
    s = last_by(samples, record_key("id", "sentence")).where("_key is not null")
    o = last_by(outputs, record_key("id", "sentence")).where("_key is not null")
    fields = ("idx", "subject", "object", "relation", "subj_type", "obj_type")
    return s.select(F.col("_key").alias("key"), *(F.col(c).alias(f"s_{c}") for c in fields)).join(
        o.select(F.col("_key").alias("key"), *(F.col(c).alias(f"o_{c}") for c in fields)), "key"
    )


def evaluate(samples: DataFrame, outputs: DataFrame, known: DataFrame) -> DataFrame:
    """Joined rows with is_known, entity_ok, exact, meaningful."""
    sig = known.select(
        F.col("relation").alias("_r"), F.col("domain_type").alias("_d"), F.col("range_type").alias("_g")
    ).distinct().withColumn("_known", F.lit(True))
    rows = join_by_id(samples, outputs).join(
        sig,
        (F.col("s_relation") == F.col("_r")) & (F.col("s_subj_type") == F.col("_d")) & (F.col("s_obj_type") == F.col("_g")),
        "left"
    )
    return rows.select(
        "key", F.coalesce("_known", F.lit(False)).alias("is_known"),
        (fuzzy_match("o_subject", "s_subject") & fuzzy_match("o_object", "s_object")).alias("entity_ok"),
        F.coalesce(F.col("o_relation") == F.col("s_relation"), F.lit(False)).alias("exact"),
        meaningful("o_relation").alias("meaningful")
    )


def metrics(evaluated: DataFrame) -> DataFrame:
    """By part (known, hidden, overall): n, entity accuracy, exact match, classification rate, success rate."""
    rows = evaluated.groupingSets([["is_known"], []], "is_known").agg(
        F.grouping("is_known").alias("_all"), F.count(F.lit(1)).alias("n"), F.count_if("entity_ok").alias("_e"),
        F.count_if("exact").alias("_x"), F.count_if("meaningful").alias("_m"),
        F.count_if(F.when(F.col("is_known"), F.col("exact")).otherwise(F.col("meaningful"))).alias("_s")
    )
    part = F.when(F.col("_all") == 1, "overall").when(F.col("is_known"), "known").otherwise("hidden")
    return rows.select(
        part.alias("part"), "n",
        *(
            F.round(ratio(c, "n"), 6).alias(name) for c,
            name in (("_e", "entity_accuracy"), ("_x", "relation_exact_match"), ("_m", "relation_classification_rate"), ("_s", "success_rate"))
        )
    )


class Classifier(Protocol):
    """Names the relation of samples; made anew in each Python worker."""

    def classify(self, samples: pd.DataFrame) -> pd.DataFrame:
        """A frame of subject, subj_type, relation, object, obj_type, a row for each sample."""


FAILED = "classification_failed"
RECORD = "id string, sentence string, triple struct<subject:string,subj_type:string,relation:string,object:string,obj_type:string>"


def classify(samples: DataFrame, make) -> DataFrame:
    """Classification records; a batch that fails gives rows with the relation classification_failed.

    make() returns a Classifier. Write the result before using it twice: it may differ on each run.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classifier = make()
        for b in batches:
            try:
                found = classifier.classify(b)
                found = found.assign(
                    subject=found["subject"].fillna(b["subject"]), object=found["object"].fillna(b["object"]),
                    relation=found["relation"].fillna("unknown")
                )
            except Exception:  # a failed call is a row, not a failed job
                logging.getLogger(__name__).exception("a batch of %d could not be classified", len(b))
                found = b[["subject", "subj_type", "object", "obj_type"]].assign(relation=FAILED)
            yield pd.DataFrame(
                {
                    "id": b["id"], "sentence": b["sentence"],
                    "triple": found[["subject", "subj_type", "relation", "object", "obj_type"]].to_dict("records")
                }
            )

    asked = ["prompt"] if "prompt" in samples.columns else []
    return samples.select("id", "sentence", "subject", "object", "subj_type", "obj_type", *asked).mapInPandas(run, RECORD)


class PromptClassifier:
    """A Classifier that sends each sample's prompt (see with_prompts) to a model and reads the JSON it answers.

    model.answer(prompts) gives a text for each prompt, or None; without a usable one a row has the
    relation classification_failed.
    """

    def __init__(self, model):
        self.model = model

    def classify(self, samples: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for text, subject, subj_type, object_, obj_type in zip(
            self.model.answer(samples["prompt"].tolist()), samples["subject"], samples["subj_type"], samples["object"],
            samples["obj_type"], strict=True
        ):
            reply = json.loads(salvage(text) or "null")
            if isinstance(reply, dict):
                rows.append((reply.get("subject", subject), subj_type, reply.get("relation", "unknown"), reply.get("object", object_), obj_type))
            else:
                rows.append((subject, subj_type, FAILED, object_, obj_type))
        return pd.DataFrame(rows, columns=["subject", "subj_type", "relation", "object", "obj_type"], index=samples.index)


def ontology_block(entries: DataFrame) -> DataFrame:
    """One row, `ontology`: a bullet for each entry, in order."""
    bullets = F.sort_array(F.collect_list(F.struct("ont_idx", "relation", "domain_type", "range_type")))
    return entries.agg(
        F.array_join(
            F.transform(
                bullets,
                lambda e: F.concat(F.lit("- "), e["relation"], F.lit(": from "), F.coalesce(e["domain_type"], F.lit("any")), F.lit(" to "), F.coalesce(e["range_type"], F.lit("any")))
            ),
            "\n"
        ).alias("ontology")
    )


def with_prompts(samples: DataFrame, entries: DataFrame) -> DataFrame:
    """samples with prompt. The ontology's text is made once and joined to every row."""
    block = F.broadcast(ontology_block(entries))  # one row
    text = F.concat(
        F.lit("Sentence: "), "sentence", F.lit("\nSubject: "), "subject", F.lit(" ("), "subj_type", F.lit(")\nObject: "),
        "object", F.lit(" ("), "obj_type", F.lit(")\nRelations:\n"), "ontology",
        F.lit('\nAnswer with one JSON object: {"subject": ..., "relation": ..., "object": ...}')
    )
    return samples.crossJoin(block).withColumn("prompt", text).drop("ontology")


def prompts(samples: DataFrame, entries: DataFrame) -> DataFrame:
    """id, prompt."""
    return with_prompts(samples, entries).select("id", "prompt")
