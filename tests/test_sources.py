"""Readers and writers on files, the chat endpoint on a server of this machine, and a run's documents."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
import yaml
from pyspark.sql import functions as F

from tripleloom.__main__ import main, parser
from tripleloom.operators import classification as C
from tripleloom.operators import validation as L
from tripleloom.plans import stages
from tripleloom.sources import readers
from tripleloom.sources.models import HttpModel
from tripleloom.streaming import resume

MENTION = {
    "id": "x1", "token": ["Ann", "Lee", "works", "at", "Acme"], "subj_start": 0, "subj_end": 1, "obj_start": 4, "obj_end": 4,
    "subj_type": " PERSON ", "obj_type": "Org", "relation": "per:employee_of"
}


def written(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))
    return f"file://{path}"


def test_mentions_of_a_json_array(spark, tmp_path):
    rows = [MENTION, {**MENTION, "id": "x2", "relation": "no_relation"}, {**MENTION, "id": "x3", "extra": {"a": 1}, "obj_end": 40}]
    got = {r.id: r for r in readers.mentions(spark, written(tmp_path / "data.json", rows)).collect()}
    assert set(got) == {
        "x1", "x3"
    } and got["x1"].subject == "Ann Lee" and got["x1"].object == "Acme" and got["x1"].sentence == "Ann Lee works at Acme"
    assert readers.mentions(spark, written(tmp_path / "none.json", [])).count() == 0


@pytest.mark.parametrize("wrapped", [False, True])
def test_schema_tree_with_and_without_its_wrapper(spark, tmp_path, wrapped):
    tree = {"PERSON": {"ORG": ["per:employee_of", "per:founded"], "CITY": ["per:born_in"]}}
    path = written(tmp_path / "schema.json", {"relations": tree} if wrapped else tree)
    got = {(r.relation, r.domain_type, r.range_type) for r in readers.schema_tree(spark, path).collect()}
    assert {(r, d.lower(), g.lower()) for r, d, g in got} == {
        ("per:employee_of", "person", "org"), ("per:founded", "person", "org"), ("per:born_in", "person", "city")
    }


def test_records_leave_out_broken_lines(spark, tmp_path):
    line = json.dumps({"id": "a", "sentence": "s", "triple": {"subject": "x", "relation": "r", "object": "y"}})
    path = written(tmp_path / "records.jsonl", f"{line}\n\n{{broken\n{line.replace('"a"', '"b"')}\n")
    got = sorted((r.id, r.triple.relation, r.triple.subj_type) for r in readers.records(spark, path).collect())
    assert got == [("a", "r", None), ("b", "r", None)]


def test_samples_and_entries_in_file_order(spark, tmp_path):
    samples = [{"id": "1", "sentence": "s", "subject": "a", "object": "b", "relation": "r", "subj_type": "A", "obj_type": None}]
    assert [tuple(r) for r in readers.samples(spark, written(tmp_path / "samples.json", samples)).select("id", "obj_type").collect()] == [("1", None)]
    entries = [{"relation": f"r{k}", "domain_type": "A", "range_type": "B"} for k in (3, 1, 2)]
    got = readers.entries(spark, written(tmp_path / "onto.json", entries)).orderBy("ont_idx").collect()
    assert [(r.ont_idx, r.relation) for r in got] == [(0, "r3"), (1, "r1"), (2, "r2")]


def test_json_keeps_nulls_and_appends(spark, tmp_path):
    rows, path = spark.createDataFrame([(1, None), (2, "ü")], "a long, b string"), f"file://{tmp_path}/out"
    readers.write_json(rows, path)
    readers.write_json(rows, path, "append")
    lines = sorted(r.value for r in spark.read.text(path).collect())
    assert len(lines) == 4 and json.loads(lines[0]) == {"a": 1, "b": None}


def test_vectors_round_trip_and_dense_numbers(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i:03}", [float(i), 0.5]) for i in range(100)], "key string, v array<float>").repartition(7)
    readers.write_vectors(rows, f"file://{tmp_path}/v")
    got = readers.with_idx(spark.read.parquet(f"file://{tmp_path}/v"), ["key"]).orderBy("idx").collect()
    assert [(r.idx, r.key, r.v[0]) for r in got] == [(i, f"k{i:03}", float(i)) for i in range(100)]


def test_config_is_yaml_both_ways():
    given = readers.Config.load("run_name: mine\nalignment: {threshold: 0.8}\nnot_a_setting: 1\n")
    assert given.run_name == "mine" and given.alignment == {"threshold": 0.8} and given.validation["min_cluster_size"] == 5
    assert readers.Config.load(given.dump()) == given and readers.Config.load("") == readers.Config()


@pytest.fixture()
def endpoint():
    """A chat endpoint: what it answers hangs on the prompt; it counts calls by prompt."""
    calls, lock = {}, threading.Lock()

    class Chat(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            prompt = asked["messages"][0]["content"]
            with lock:
                calls[prompt] = calls.get(prompt, 0) + 1
                n = calls[prompt]
            status = 400 if "wrong" in prompt else 503 if "busy" in prompt and n < 3 or "down" in prompt else 200
            body = b"no json" if "garbled" in prompt else json.dumps({"choices": [{"message": {"content": f"{asked['model']}:{prompt}"}}]}).encode()
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1", calls
    server.shutdown()


def test_endpoint_answers_in_order_and_is_asked_again(endpoint):
    url, calls = endpoint
    model = HttpModel(url, "m", pause=0.01)
    asked = [f"p{i}" for i in range(30)] + ["busy", "wrong", "down", "garbled"]
    assert model.answer(asked) == [*(f"m:p{i}" for i in range(30)), "m:busy", None, None, None]
    assert (calls["p0"], calls["busy"], calls["wrong"], calls["down"]) == (1, 3, 1, 3)
    assert model.answer([]) == [] and HttpModel("http://127.0.0.1:9", "m", tries=2, pause=0.01, timeout=1).answer(["x"]) == [None]


def test_classify_and_validate_through_the_endpoint(spark, endpoint):
    url, _ = endpoint
    samples = spark.createDataFrame(
        [(str(i), "down" if i == 2 else "s", "a", "b", "X", "Y", f'{{"subject": "a", "relation": "r{i}", "object": "b"}}' + (" down" if i == 2 else "")) for i in range(4)],
        "id string, sentence string, subject string, object string, subj_type string, obj_type string, prompt string"
    )
    found = {r.id: r.triple.relation for r in C.classify(samples, lambda: C.PromptClassifier(HttpModel(url, "m", pause=0.01))).collect()}
    assert found == {"0": "r0", "1": "r1", "2": C.FAILED, "3": "r3"}
    asked = spark.createDataFrame(
        [(1, '{"name": "n", "confidence": "High", "existing_match": false}'), (2, "down")], "cluster_id long, prompt string"
    )
    got = {r.cluster_id: (r.name, r.confidence) for r in L.validate(asked, lambda: HttpModel(url, "m", pause=0.01)).collect()}
    assert got == {1: ("n", "High"), 2: (None, None)}


def test_export_documents(spark):
    made = [
        (3, "n3", "told", "A", "B", None, "High", "why", "accepted"),
        (1, "n1", None, "A", "B", None, "Medium", None, "accepted"),
        (4, "n4", None, "A", "B", "old", "High", None, "existing_match"),
        (5, "n5", None, "Q", "B", None, "High", None, "invalid_domain"),
        (6, None, None, None, None, None, None, None, "no_reply")
    ]
    judged = spark.createDataFrame(
        made,
        "cluster_id long, name string, description string, domain string, range string, existing_relation_name string, confidence string, reasoning string, reason string"
    ).withColumn("accepted", F.col("reason") == "accepted")
    evidence = spark.createDataFrame(
        [(i, 3 if i < 7 else 1, f"s{i}", None if i == 1 else "r", "o") for i in range(9)],
        "idx long, cluster_id long, subject string, relation string, object string"
    )
    accepted = L.export(judged, evidence)
    whole = json.loads(L.export_document(accepted, "now").first().value)
    assert whole["metadata"] == {"n_novel_relations": 2, "timestamp": "now"}
    first, second = whole["novel_relations"]
    assert first["cluster_id"] == 1 and first["description"] is None and second["evidence_count"] == 7 and second["reasoning"] == "why"
    assert second["sample_triples"][:2] == [
        {"subject": "s0", "relation": "r", "object": "o"}, {"subject": "s1", "relation": "N/A", "object": "o"}
    ] and len(second["sample_triples"]) == 5
    report = L.rejected_report(judged).first()
    assert [tuple(x) for x in report.existing_match] == [(4, "n4", "old")] and [tuple(x) for x in report.type_incompatible] == [(5, "n5", "Q", "B")] and [tuple(x) for x in report.low_confidence] == [(6,)]
    empty = json.loads(L.export_document(accepted.limit(0), "now").first().value)
    assert empty == {"metadata": {"n_novel_relations": 0, "timestamp": "now"}, "novel_relations": []}


def test_stream_classifies_each_file_once(spark, tmp_path):
    class Clerk:
        def classify(self, rows):
            return rows[["subject", "subj_type", "object", "obj_type"]].assign(relation="r_" + rows["id"])

    folder = tmp_path / "in"
    folder.mkdir()
    follow = lambda: resume.follow(
        spark, f"file://{folder}", f"file://{tmp_path}/out", f"file://{tmp_path}/state", Clerk
    ).awaitTermination()
    for k in range(3):
        written(
            folder / f"{k}.json",
            json.dumps({"id": str(k), "sentence": "s", "subject": "a", "object": "b", "subj_type": "A", "obj_type": None}) + "\n"
        )
        follow()
    follow()
    got = sorted((r.id, r.triple.relation) for r in readers.records(spark, f"file://{tmp_path}/out").collect())
    assert got == [("0", "r_0"), ("1", "r_1"), ("2", "r_2")]


def test_manifest_is_yaml(spark, tmp_path):
    stages.write_manifest(spark, {"a": {"b": [1, 2.5]}, "n": 3}, f"file://{tmp_path}/m")
    text = "\n".join(r.value for r in spark.read.text(f"file://{tmp_path}/m").collect())
    assert yaml.safe_load(text) == {"a": {"b": [1, 2.5]}, "n": 3}


def test_command_line_writes_its_log(spark, tmp_path):
    data = written(tmp_path / "data.json", [MENTION])
    main(["--log", str(tmp_path / "log"), "extract-schema", "--data", data, "--output", f"file://{tmp_path}/schema"])
    assert "extract-schema is done" in (tmp_path / "log").read_text()
    assert [r.relation for r in readers.schema_tree(spark, f"file://{tmp_path}/schema").collect()] == ["per:employee_of"]
    assert parser().parse_args(["run", "--config", "c"]).stage == "run"
