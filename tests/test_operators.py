"""The engine's own operators: published values, edge cases, and every query against its SQL."""

import glob
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripleloom.functions import expressions as X
from tripleloom.operators import alignment as A
from tripleloom.operators import classification as C
from tripleloom.operators import clustering as K
from tripleloom.operators import evaluation as E
from tripleloom.operators import ontology as O
from tripleloom.operators import validation as L
from tripleloom.plans import catalog, oracle

DATA = "/root/testdata/sf0.001"


def test_fuzzy_match(spark):
    made = [("Bob", "bob smith"), ("", "x"), (None, "x"), (" ", "x")]
    got = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(made)], "i int, a string, b string"
    ).select("i", X.fuzzy_match("a", "b").alias("f")).orderBy("i")
    assert [r.f for r in got.collect()] == [True, False, False, True]


def test_meaningful(spark):
    want = {
        "founded_by": True, "no": False, "new_relation_x": False, "a_to_b": False, "per:a_to_b": True, "a_b_c_d": False,
        "related_to": True, "classification_failed": True, "temporary": False
    }
    got = spark.createDataFrame([(k,) for k in want], "r string").select("r", X.meaningful("r").alias("m")).collect()
    assert {r.r: r.m for r in got} == want


def test_salvage():
    assert L.salvage('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert L.salvage('x {"a": 1} y {"b": 2} z') == '{"b": 2}'
    assert L.salvage('x {"a": 1 y') is None and L.salvage("") is None and L.salvage(None) is None


def test_confusion_and_ratios(spark):
    rows = [(i, "known_triple" if i < 151 else "new_triple_candidate") for i in range(296)]
    results = spark.createDataFrame(rows, "classified_idx long, match_type string")
    kind = lambda i: "k" if i < 140 or 151 <= i < 178 else "h"
    samples = spark.createDataFrame([(i, kind(i), "a", "b") for i in range(296)], "idx long, relation string, subj_type string, obj_type string")
    known = spark.createDataFrame([("k", "a", "b")], "relation string, domain_type string, range_type string")
    r = A.confusion(results, samples, known).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (140, 11, 27, 118)
    assert (r.precision, r.recall, r.f1, r.specificity) == (0.927152, 0.838323, 0.880503, 0.914729)


def test_graph_split(spark):
    made = [(0, "x", [1.0, 0.0]), (1, "y", [0.9, math.sqrt(0.19)]), (2, "z", [0.2, -math.sqrt(0.96)])]
    rows = spark.createDataFrame([(i, r, v, "g") for i, r, v in made], "idx long, relation string, relation_emb array<double>, g string")
    got = {r.idx: r.cluster_id for r in K.graph_split(rows, ["g"]).collect()}
    assert got == {0: 0, 1: 0, 2: 1}


def test_weighted_percentile_is_numpys(spark):
    rng = np.random.default_rng(0)
    made = [("g", float(s), int(n)) for s, n in zip(rng.normal(size=9).round(3), rng.integers(1, 6, 9), strict=True)]
    got = K.weighted_percentile(spark.createDataFrame(made, "g string, sim double, pairs long"), ["g"]).first().percentile
    assert got == pytest.approx(np.percentile(np.repeat([s for _, s, _ in made], [n for _, _, n in made]), 25))


def test_last_row_wins(spark):
    rows = spark.createDataFrame([(0, "a", "x"), (1, "a", "y"), (2, None, "z")], "idx long, id string, v string")
    got = {r._key: r.v for r in C.last_by(rows, C.record_key("id")).collect()}
    assert got["a"] == "y"


def test_split_conserves(spark):
    entries = O.entries_of(
        spark.createDataFrame([(f"r{i % 7}", "A", f"b{i}") for i in range(30)], "relation string, subj_type string, obj_type string")
    )
    known, hidden = O.split(entries, O.hidden_relations(entries))
    assert O.validate_split(known, hidden, entries).first() == (True, True, True)
    assert {r.relation for r in O.split(entries, O.hidden_relations(entries, given=["r3", "none"]))[1].collect()} == {"r3"}


def test_metrics_of_equal_labels():
    table = pd.DataFrame({"pred": [0, 1, 2], "true": ["a", "b", "c"], "n": [3, 4, 5]})
    got = E.subset_metrics(table)
    for name in ("bcubed_f1", "v_measure", "ari", "ami", "mapping_accuracy"):
        assert got[name] == pytest.approx(1.0)
    one = E.subset_metrics(pd.DataFrame({"pred": [0, 1, 2], "true": ["a"] * 3, "n": [3, 4, 5]}))
    assert one["mapping_accuracy"] == pytest.approx(5 / 12) and one["n_clusters"] == 3


def test_adjusted_mutual_information_equals_a_plain_sum():
    rng = np.random.default_rng(2)
    g = math.lgamma
    for shape, most in (((3, 4), 9), ((6, 2), 40), ((5, 7), 400), ((2, 2), 3)):
        n = rng.integers(0, most, shape).astype(float)
        n = n[n.sum(1) > 0][:, n.sum(0) > 0]
        a, b, total = n.sum(1), n.sum(0), n.sum()
        expected = 0.0
        for x in a:
            for y in b:
                for k in range(int(max(1, x + y - total)), int(min(x, y)) + 1):
                    chance = g(x + 1) + g(y + 1) + g(total - x + 1) + g(total - y + 1) - g(total + 1) - g(k + 1) - g(x - k + 1) - g(y - k + 1) - g(total - x - y + k + 1)
                    expected += k / total * math.log(total * k / (x * y)) * math.exp(chance)
        assert E.expected_mutual_information(a, b) == pytest.approx(expected, rel=1e-9)
    large = np.array([[3e8, 1e6], [2e6, 5e8]])  # sums over a window, not over 10^8 overlaps
    assert 0.9 < E.adjusted_mutual_information(large) < 1


def test_contingency_for_the_driver_is_bounded(spark):
    table = spark.createDataFrame([(i, str(i), 1) for i in range(20)], "pred long, true string, n long")
    assert len(E.collected(table, 20)) == 20
    with pytest.raises(ValueError, match="cells"):
        E.collected(table, 19)


def test_bundle_needs_clusters(spark):
    rows = spark.createDataFrame([(i, i // 2, [float(i), 1.0]) for i in range(6)], "vec_id long, label long, embedding array<double>")
    assert None not in E.quality_bundle(rows, "label", "embedding").first()
    for label in ("0L", "vec_id"):
        assert set(E.quality_bundle(rows.withColumn("label", F.expr(label)), "label", "embedding").first()) == {None}


def test_type_pairs_by_blocks_equal_plain_sums(spark, monkeypatch):
    """Blocks of a few rows; a missing pair; a pair with one label; labels of one row."""
    monkeypatch.setattr(E, "BLOCK", 7)
    rng = np.random.default_rng(4)
    made = [(i, None if i % 4 == 0 else f"p{i % 4}", 0 if i % 4 == 1 else int(rng.integers(0, 3)), rng.normal(size=3).tolist()) for i in range(90)]
    made += [(1000, "p2", 99, [0.0, 0.0, 1.0]), (1001, "few", 1, [1.0, 0.0, 0.0]), (1002, "few", 1, [0.0, 1.0, 0.0])]
    rows = spark.createDataFrame(made, "vec_id long, pair string, label long, embedding array<double>")
    got = {r.pair: r for r in E.type_pair_quality(rows, "pair", "label", "embedding").collect()}
    assert set(got) == {"UNK:UNK", "p1", "p2", "p3"} and got["p1"].silhouette is None and got["p1"].dunn is None and got["p1"].n_clusters == 1
    for pair in ("UNK:UNK", "p2", "p3"):
        part = [(l, np.array(v)) for _, p, l, v in made if (p or "UNK:UNK") == pair and l != 99]
        label, x = np.array([l for l, _ in part]), np.stack([v for _, v in part])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        sil = []
        for i in range(len(x)):
            mean = {c: d[i, (label == c) & (np.arange(len(x)) != i)].mean() for c in set(label)}
            a, b = mean.pop(label[i]), min(mean.values())
            sil.append((b - a) / max(a, b))
        unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
        wide = max((1 - unit[label == c] @ unit[label == c].T)[np.triu_indices((label == c).sum(), 1)].max() for c in set(label))
        centre = {c: x[label == c].mean(0) for c in set(label)}
        near = min(np.linalg.norm(centre[c] - centre[o]) for c in centre for o in centre if c != o)
        assert got[pair].n_samples == len(x) and got[pair].silhouette == pytest.approx(
            np.mean(sil), abs=2e-6
        ) and got[pair].dunn == pytest.approx(near / wide, abs=2e-6)
    summary = E.type_pair_summary(E.type_pair_quality(rows, "pair", "label", "embedding")).first()
    assert summary.n_typepairs == 4 and summary.avg_dunn == pytest.approx(np.mean([r.dunn for r in got.values() if r.dunn is not None]), abs=2e-6)
    assert E.type_pair_summary(E.type_pair_quality(rows.limit(0), "pair", "label", "embedding")).count() == 0


def test_cluster_report(spark):
    v = {"x": [2.0, 0.0], "y": [1.0, 0.3], "z": [-1.0, 0.0], "w": [-1.0, 0.1], "s": [0.0, 1.0]}
    made = [(0, r) for r in "xxyzw"] + [(1, "s"), (2, "x"), (2, "z")]
    rows = spark.createDataFrame([(c, r, v[r]) for c, r in made], "cluster_id long, relation string, relation_emb array<double>")
    got = {r.cluster_id: r for r in K.report(rows).collect()}
    unit = {k: np.array(x) / np.linalg.norm(x) for k, x in v.items()}
    sims = [(unit[a] @ unit[b] + 1) / 2 for i, a in enumerate("xxyzw") for b in "xxyzw"[i + 1 :]]
    assert (got[0].n, got[0].n_relations, got[0].components) == (5, 4, 2)
    assert (got[0].mean_sim, got[0].min_sim, got[0].max_sim) == pytest.approx((np.mean(sims), min(sims), max(sims)), abs=1e-6)
    assert (got[1].n, got[1].mean_sim, got[1].components) == (1, None, 0) and got[2].components == 0


def test_singletons_against_means_equal_means_of_singletons(spark):
    rng = np.random.default_rng(6)
    made = [(i, i if i < 5 else 10 + i % 3, f"r{i}", (rng.normal(size=4) + [2, 0, 0, i % 2]).tolist()) for i in range(30)]
    rows = spark.createDataFrame(made, "idx long, cluster_id long, relation string, relation_emb array<double>")
    got = {r.idx: r.target for r in K.merge_singletons_once(rows, threshold=3.0).collect()}
    want = {}
    for i, c, _, x in made[:5]:
        score = {k: np.mean([np.dot(x, y) for _, o, _, y in made if o == k]) for k in (10, 11, 12)}
        best = max(score, key=lambda k: (score[k], -k))
        if score[best] > 3.0:
            want[i] = best
    assert got == want and want


def test_broken_views_fall_back_to_the_relation(spark):
    """A view with NaN makes the mean invalid; the relation's similarities decide then."""
    good = [[1.0, 0.0], [0.96, 0.28], [0.0, 1.0]]
    views = {name: good for name in A.VIEWS}
    assert np.isfinite(K.mean_similarity(views, A.VIEWS)).all()
    broken = views | {A.VIEWS[-1]: [[float("nan"), 0.0], *good[1:]]}
    assert not np.isfinite(K.mean_similarity(broken, A.VIEWS)).all()
    rows = spark.createDataFrame(
        [(r, "a", o, "a:b") for r, o in zip("pqr", "bbb", strict=True)],
        "relation string, subj_type string, obj_type string, type_sig string"
    )
    of = {"Relation: p": good[0], "Relation: q": good[1], "Relation: r": good[2]}

    def lookup(texts):
        return spark.createDataFrame([(r.text, of.get(r.text, [float("nan"), 1.0])) for r in texts.collect()], "text string, embedding array<double>")

    assert {r.eigengap_k for r in K.consensus_labels(rows, lookup).collect()} == {K.eigengap(K.mean_similarity({"relation": good}, ("relation",)))}


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for shape in ((3, 3), (2, 5), (5, 3), (1, 1)):
        cost = rng.integers(0, 20, shape).astype(float)
        pairs = E.assignment(cost)
        c = cost if shape[0] <= shape[1] else cost.T
        best = min(sum(c[i, p[i]] for i in range(c.shape[0])) for p in permutations(range(c.shape[1]), c.shape[0]))
        assert sum(cost[i, j] for i, j in pairs) == best and len(pairs) == min(shape)


def test_consensus():
    x = np.concatenate([np.full((5, 2), [1.0, 0.0]), np.full((5, 2), [0.0, 1.0])]) + np.random.default_rng(0).normal(0, 0.01, (10, 2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.clip(x @ x.T, 0, 1)
    assert set(K.consensus(sim)) == {0}  # no proposal has a weight
    label = K.consensus(sim, zero_diagonal=True)
    assert len(set(label[:5])) == 1 and len(set(label[5:])) == 1 and label[0] != label[5]
    assert K.eigengap(sim) == 2


def modularity(w, label):
    degree, total = w.sum(1), w.sum()
    return sum((w[np.ix_(label == c, label == c)].sum() - degree[label == c].sum() ** 2 / total) / total for c in set(label))


def test_communities_are_leidens():
    """A ring of cliques; parts that hang together; never worse than moving nodes alone."""
    k, size = 6, 5
    w = np.kron(np.eye(k), np.ones((size, size)))
    for c in range(k):
        a, b = c * size, (c + 1) % k * size + 1
        w[a, b] = w[b, a] = 1
    np.fill_diagonal(w, 0)
    got = K.communities(w)
    assert len(set(got)) == k and all(len(set(got[c * size : (c + 1) * size])) == 1 for c in range(k))
    rng = np.random.default_rng(7)
    for _ in range(20):
        w = np.triu(rng.random((18, 18)) * (rng.random((18, 18)) < 0.25), 1)
        w = w + w.T
        got, moved = K.communities(w), K._moved(
            np.where(w > 0.1, w, 0), np.where(w > 0.1, w, 0).sum(1), np.arange(18), np.where(w > 0.1, w, 0).sum(), 1.0
        )
        assert modularity(np.where(w > 0.1, w, 0), got) >= modularity(np.where(w > 0.1, w, 0), moved) - 1e-9
        for c in set(got):  # a community hangs together
            part = np.where(w > 0.1, w, 0)[np.ix_(got == c, got == c)] > 0
            assert len(set(K.connected(part | np.eye(len(part), dtype=bool)))) == 1


def test_average_linkage_by_plain_means():
    rng = np.random.default_rng(8)
    for _ in range(10):
        x = rng.random((9, 2))
        counts = rng.integers(1, 4, 9)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        groups = [[i] for i in range(9)]
        mean = lambda a, b: np.average([d[i, j] for i in a for j in b], weights=[counts[i] * counts[j] for i in a for j in b])
        while len(groups) > 1:
            best, a, b = min((mean(a, b), a, b) for k, a in enumerate(groups) for b in groups[k + 1 :])
            if best >= 0.4:
                break
            groups = [g for g in groups if g not in (a, b)] + [a + b]
        got = K.average_linkage(d, counts=counts)
        assert sorted(sorted(np.flatnonzero(got == c).tolist()) for c in set(got)) == sorted(map(sorted, groups))


def test_proposals_are_weighed_even_where_they_are_invalid(monkeypatch):
    seen = []
    whole = K.proposal_weight
    monkeypatch.setattr(K, "proposal_weight", lambda *a: seen.append(whole(*a)) or seen[-1])
    sim = np.kron(np.eye(2), np.full((5, 5), 0.9)) + 0.05
    np.fill_diagonal(sim, 1)
    assert set(K.consensus(sim)) == {0} and seen and not any(seen)
    seen.clear()
    assert len(set(K.consensus(sim, runs=50, zero_diagonal=True, early_stop=4))) == 2 and 4 <= sum(w > 0.1 for w in seen) <= 6


def test_consensus_counts_rows():
    """Labels with counts give what their rows give, each a label of its own."""
    rng = np.random.default_rng(3)
    x = np.stack([[1.0, 0.0], [0.96, 0.28], [0.0, 1.0], [0.28, 0.96]])
    sim, counts = (x @ x.T + 1) / 2, np.array([3.0, 6.0, 4.0, 5.0])
    row = np.repeat(np.arange(4), counts.astype(int))
    wide = sim[np.ix_(row, row)]
    np.fill_diagonal(wide, 1)
    assert K.eigengap(sim, counts=counts) == K.eigengap(wide)
    label = np.array([0, 0, 1, 1])
    assert K.silhouette(1 - sim, label, counts) == pytest.approx(K.silhouette(1 - wide, label[row]))
    got = K.density(1 - sim, counts=counts)
    assert got is not None and got[0] == got[1] != got[2] == got[3] and (got >= 0).all()  # 4 labels, 18 rows
    assert K.density(1 - sim) is None  # 4 rows
    v, n = rng.random(6), rng.integers(1, 5, 6).astype(float)
    assert K.percentile(v, n, 0.75) == pytest.approx(np.percentile(np.repeat(v, n.astype(int)), 75))
    part = K.consensus(sim, zero_diagonal=True, counts=counts)
    assert part[0] == part[1] != part[2] == part[3]


def test_density_takes_groups_of_unlike_density():
    """Excess of mass finds two tight groups and a loose one; a single cut at the largest gap joined the tight ones."""
    x = np.concatenate([np.linspace(0, 0.05, 6), np.linspace(0.3, 0.35, 6), np.linspace(5, 6, 6)])
    got = K.density(np.abs(x[:, None] - x[None]))
    assert len(set(got[:6])) == len(set(got[6:12])) == len(set(got[12:])) == 1 and len({got[0], got[6], got[12]}) == 3 and -1 not in got


def test_consensus_uses_four_views(spark):
    rows = spark.createDataFrame(
        [(r, "a", "b", "a:b") for r in ("p", "q", "q")], "relation string, subj_type string, obj_type string, type_sig string"
    )
    seen = []

    def lookup(texts):
        seen.extend(r.text for r in texts.collect())
        return texts.withColumn("embedding", F.array(F.lit(1.0)))

    got = K.consensus_labels(rows, lookup).collect()
    assert len(got) == 2 and sum(t.startswith("Entity Type") for t in seen) == 2 and len(seen) == 6


def test_silhouette_reads_every_vector(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("label", "embedding").toPandas()
    x, label = np.stack(rows["embedding"]).astype(float), rows["label"].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    values = []
    for i in range(len(x)):
        mean = {c: d[i, (label == c) & (np.arange(len(x)) != i)] for c in set(label)}
        a, b = mean.pop(label[i]), min(m.mean() for c, m in mean.items() if c != label[i])
        values.append((b - a.mean()) / max(a.mean(), b) if len(a) else 0.0)
    assert catalog.QUERIES["silhouette"](spark, DATA).first().silhouette == pytest.approx(np.mean(values), abs=2e-6)
    assert E.silhouette(
        catalog.Views(spark, DATA).vectors(), "label", "embedding", most=100
    ).first().silhouette == pytest.approx(np.mean(values), abs=2e-6)


def test_cosine_distances_by_blocks(spark):
    """Every pair of a label as by the plain expression, whatever the blocks are, from more tasks than the one label."""
    made = np.random.default_rng(5).normal(size=(60, 3)).tolist()
    made[7], made[8], made[9], made[10], made[11] = None, [1.0, None, 2.0], [1.0, 2.0], [], [0.0] * 3
    made[12], made[13], made[14] = [float("nan"), 1.0, 0.0], [float("inf"), 1.0, 0.0], [1e200, 1.0, 0.0]
    made[15], made[17], made[18] = made[16], [2.0, 1.0], [0.0, 0.0]
    rows = [(i if i != 20 else None, x, 1 if i % 10 else 2) for i, x in enumerate(made)] + [(5, made[6], 1), (5, made[5], 1), (70, made[6], None)]
    rows = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    a, b = rows.select("label", F.col("vec_id").alias("i"), F.col("embedding").alias("x")), rows.select("label", F.col("vec_id").alias("j"), F.col("embedding").alias("y"))
    want = a.join(b, "label").where("i < j").select("i", "j", F.round(X.cosine_distance("x", "y"), 6).alias("distance"))
    told = lambda rows: sorted(tuple(map(cell, r)) for r in rows.collect())
    want = told(want)
    assert len(want) > 1400
    for most in (2048, 7):
        got = E.cosine_distances(rows, "vec_id", "label", "embedding", 6, most)
        assert got.columns == ["i", "j", "distance"] and told(got) == want
    assert got.rdd.getNumPartitions() > 20
    assert catalog.QUERIES["cosine_distance"](spark, DATA).rdd.getNumPartitions() >= 10  # one of all labels' pairs before
    assert E.cosine_distances(rows.where("false"), "vec_id", "label", "embedding").collect() == []


def test_acceptance_order(spark):
    made = [
        (0, "A", "B", True, "Low"), (1, "Z", "B", False, "Low"), (2, "A", "Z", False, "High"), (3, "A", "B", False, "Low"),
        (4, "A", "B", False, "Medium"), (5, None, None, None, None)
    ]
    rows = spark.createDataFrame(made, "cluster_id long, domain string, range string, existing_match boolean, confidence string")
    classes = spark.createDataFrame([("a",), ("b",)], "class string")
    got = {r.cluster_id: r.reason for r in L.judge(rows, classes).collect()}
    assert got == {0: "existing_match", 1: "invalid_domain", 2: "invalid_range", 3: "low_confidence", 4: "accepted", 5: "no_reply"}


def test_failed_calls_are_rows(spark):
    class Broken:
        def classify(self, rows):
            raise OSError("no endpoint")

    samples = spark.createDataFrame(
        [("1", "s", "a", "b", "x", "y")],
        "id string, sentence string, subject string, object string, subj_type string, obj_type string"
    )
    assert C.classify(samples, Broken).first().triple.relation == C.FAILED


def test_blocked_similarities_equal_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(str(i), *[[float(i), 1.0]] * 4) for i in range(3)],
        "a string, " + ", ".join(f"{v}_emb array<double>" for v in A.VIEWS)
    )
    right = rows.withColumnRenamed("a", "b")
    want = sorted(A.similarities(rows, right, "a", "b", 3).collect())
    assert sorted(A.similarities(rows, right, "a", "b", 10**9).collect()) == want


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{round(x, 5) + 0.0:.5f}"
    return "none" if x is None else str(x)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    frame, rel = catalog.QUERIES[name](spark, DATA), con.sql(oracle.SQL[name])
    assert sorted(frame.columns) == sorted(rel.columns)
    order = sorted(frame.columns)
    got = sorted(tuple(cell(r[c]) for c in order) for r in frame.collect())
    at = [rel.columns.index(c) for c in order]
    assert got == sorted(tuple(cell(r[k]) for k in at) for r in rel.fetchall())
