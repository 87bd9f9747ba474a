"""Grouping of unaligned triples: type strata, similarity graphs, singleton policy, consensus, reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.checkpoint import checkpoint
from tripleloom.functions.expressions import dot, l2_normalise
from tripleloom.operators.alignment import SIGNATURE, VIEWS, embed_views, view_texts

#: Defaults: similarity floor, percentile of the graph split, merge threshold of singletons.
SIMILARITY, PERCENTILE, MERGE = 0.60, 0.25, 0.80


def stratify(triples: DataFrame) -> DataFrame:
    """triples with type_sig: both types, 'None' for a missing one."""
    return triples.withColumn("type_sig", F.concat_ws(":", F.coalesce("subj_type", F.lit("None")), F.coalesce("obj_type", F.lit("None"))))


def strata(triples: DataFrame) -> DataFrame:
    """type_sig, n, first_idx and the group's place in first-seen order."""
    rows = stratify(triples).groupBy("type_sig").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"))
    return rows.withColumn("group_no", F.row_number().over(Window.orderBy("first_idx")).cast("long") - 1)  # one row a type pair


def label_counts(members: DataFrame, cluster: list[str], label: str, emb: str) -> DataFrame:
    """cluster, label, c (rows) and v (vector) of the distinct labels of a cluster."""
    return members.groupBy(*cluster, label).agg(F.count(F.lit(1)).alias("c"), F.first(emb).alias("v"))


def pairs_of(counted: DataFrame, cluster: list[str], label: str) -> DataFrame:
    """Weighted pairs of label_counts(): a <= b, pairs (of rows), sim.

    The similarity of two rows depends on their labels alone, so rows are counted by label first:
    c_a * c_b pairs for two labels, c (c - 1) / 2 of similarity 1 for one.
    """
    a = counted.select(*cluster, F.col(label).alias("a"), F.col("c").alias("ca"), F.col("v").alias("va"))
    b = counted.select(*cluster, F.col(label).alias("b"), F.col("c").alias("cb"), F.col("v").alias("vb"))
    pairs = F.when(F.col("a") == F.col("b"), F.expr("ca * (ca - 1) div 2")).otherwise(F.expr("ca * cb"))
    sim = F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.round(dot("va", "vb"), 9))
    return a.join(b, cluster).where("a <= b").select(*cluster, "a", "b", pairs.alias("pairs"), sim.alias("sim"))


def label_pairs(members: DataFrame, cluster: list[str], label: str, emb: str) -> DataFrame:
    """Weighted pairs of distinct labels of a cluster: a <= b, pairs (of rows), sim."""
    return pairs_of(label_counts(members, cluster, label, emb), cluster, label)


def weighted_percentile(pairs: DataFrame, cluster: list[str], share: float = PERCENTILE) -> DataFrame:
    """Percentile of sim over all pairs of rows, linearly interpolated, from counts."""
    rows = pairs.where("pairs > 0").groupBy(*cluster, "sim").agg(F.sum("pairs").alias("n"))
    w = Window.partitionBy(*cluster).orderBy("sim")
    rows = rows.withColumn("upto", F.sum("n").over(w)).withColumn("place", (F.sum("n").over(Window.partitionBy(*cluster)) - 1) * share)
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("sim")))
    ends = rows.groupBy(*cluster).agg(at(F.floor("place")).alias("lo"), at(F.ceil("place")).alias("hi"), F.first("place").alias("place"))
    return ends.select(*cluster, (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("place") - F.floor("place"))).alias("percentile"))


def split_edges(members: DataFrame, cluster: list[str], label: str, emb: str, floor: float = SIMILARITY) -> DataFrame:
    """Edges between labels of a cluster whose similarity reaches max(floor, percentile)."""
    pairs = checkpoint(label_pairs(members, cluster, label, emb))
    limit = weighted_percentile(pairs, cluster)
    on = pairs.join(limit, cluster)
    return on.withColumn("threshold", F.greatest(F.lit(floor), F.col("percentile"))).where("pairs > 0 and sim >= threshold")


def components(nodes: DataFrame, edges: DataFrame, group: list[str], rounds: int = 50) -> DataFrame:
    """group, node, label: least node of the component, for all nodes. edges: group, a, b.

    Least labels spread over links and jump to their own label's label; each round is written.
    """
    both = checkpoint(
        edges.where("a != b").select(*group, "a", "b").unionByName(
            edges.where("a != b").select(*group, F.col("b").alias("a"), F.col("a").alias("b"))
        ).distinct()
    )
    label = checkpoint(nodes.select(*group, "node", F.col("node").alias("label")))
    for _ in range(rounds):
        near = both.join(
            label.withColumnRenamed("node", "b"), [*group, "b"]
        ).groupBy(*group, F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hop = checkpoint(
            label.join(near, [*group, "node"], "left").select(*group, "node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        )
        jump = hop.select(*group, F.col("node").alias("to"), F.col("to").alias("then"))
        new = checkpoint(hop.join(jump, [*group, "to"], "left").select(*group, "node", F.coalesce("then", "to").alias("label"), "was"))
        moved = not new.where("label != was").isEmpty()
        label = new.drop("was")
        if not moved:
            return label
    raise RuntimeError("components: labels still move after the last round")


def graph_split(members: DataFrame, cluster: list[str], label: str = "relation", emb: str = "relation_emb", floor: float = SIMILARITY) -> DataFrame:
    """members with cluster_id: components of each cluster's similarity graph, numbered by cluster and first idx."""
    members = checkpoint(members)
    edges = checkpoint(split_edges(members, cluster, label, emb, floor))
    # a label whose rows are only linked within is one component: sim 1 reaches any threshold
    nodes = members.select(*cluster, F.col(label).alias("node")).distinct()
    found = components(nodes, edges, cluster).withColumnRenamed("node", label).withColumnRenamed("label", "_part")
    rows = members.join(found, [*cluster, label])
    parts = rows.groupBy(*cluster, "_part").agg(F.min("idx").alias("_first"))
    firsts = rows.groupBy(*cluster).agg(F.min("idx").alias("_cluster_first"))
    numbered = parts.join(firsts, cluster).withColumn(
        "cluster_id", F.row_number().over(Window.orderBy("_cluster_first", "_first")).cast("long") - 1
    )  # one row a cluster
    return checkpoint(rows.join(numbered.select(*cluster, "_part", "cluster_id"), [*cluster, "_part"]).drop("_part"))


def cluster_similarity(members: DataFrame, label: str = "relation", emb: str = "relation_emb") -> DataFrame:
    """cluster_id, n, mean, least and largest similarity of the pairs, for clusters of two rows or more."""
    pairs = label_pairs(members, ["cluster_id"], label, emb).where("pairs > 0")
    sims = pairs.groupBy("cluster_id").agg(
        (F.sum(F.col("sim") * F.col("pairs")) / F.sum("pairs")).alias("mean_sim"), F.min("sim").alias("min_sim"),
        F.max("sim").alias("max_sim")
    )
    return members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).join(sims, "cluster_id")


def quality(members: DataFrame, label: str = "relation", emb: str = "relation_emb") -> DataFrame:
    """total_items, total_clusters, avg_cluster_size, avg_within_cluster_similarity, of clusters of two or more."""
    rows = cluster_similarity(members, label, emb)
    return rows.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_items"), F.count(F.lit(1)).alias("total_clusters"),
        F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("avg_cluster_size"),
        F.round(F.coalesce(F.avg("mean_sim"), F.lit(0.0)), 6).alias("avg_within_cluster_similarity")
    )


def report(members: DataFrame, label: str = "relation", emb: str = "relation_emb", threshold: float = 0.65) -> DataFrame:
    """cluster_id, n, n_relations, mean_sim, min_sim, max_sim, components.

    Similarities are cosines mapped to [0, 1], null for one row alone; components are those of rows that
    are linked with another at the threshold or above, 0 where none is.
    """
    counted = checkpoint(label_counts(members, ["cluster_id"], label, emb).withColumn("v", l2_normalise("v")))
    value = (F.greatest(F.least("sim", F.lit(1.0)), F.lit(-1.0)) + 1) / 2
    pairs = checkpoint(pairs_of(counted, ["cluster_id"], label).where("pairs > 0").withColumn("sim", value))
    mean = F.sum(F.col("sim") * F.col("pairs")) / F.sum("pairs")
    sims = pairs.groupBy("cluster_id").agg(mean.alias("mean_sim"), F.min("sim").alias("min_sim"), F.max("sim").alias("max_sim"))
    edges = pairs.where(F.col("sim") >= threshold)
    nodes = edges.select("cluster_id", F.explode(F.array("a", "b")).alias("node")).distinct()
    parts = components(nodes, edges, ["cluster_id"]).groupBy("cluster_id").agg(F.count_distinct("label").alias("components"))
    sizes = counted.groupBy("cluster_id").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_relations"))
    found = sizes.join(sims, "cluster_id", "left").join(parts, "cluster_id", "left")
    return found.select(
        "cluster_id", "n", "n_relations", "mean_sim", "min_sim", "max_sim",
        F.coalesce("components", F.lit(0)).cast("long").alias("components")
    )


def top_labels(members: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent relations of each cluster."""
    rows = members.groupBy("cluster_id", "relation").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "relation"))).where(F.col("rank") <= k)


def summary(members: DataFrame) -> DataFrame:
    """Rows, clusters and singletons by mode."""
    sizes = members.groupBy("cluster_mode", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("cluster_mode").agg(
        F.sum("n").alias("items"), F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("n") == 1).alias("singletons")
    )


def merge_singletons_once(members: DataFrame, label: str = "relation", emb: str = "relation_emb", threshold: float = MERGE) -> DataFrame:
    """idx, target of the singletons whose best mean similarity to a large cluster is over the threshold, in one pass."""
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n"))
    # a singleton's mean similarity to a cluster is its product with the cluster's mean, so a cluster is one row
    large = members.join(sizes.where("_n > 1").select("cluster_id"), "cluster_id", "left_semi")
    mean = large.select("cluster_id", F.posexplode(emb).alias("p", "x")).groupBy("cluster_id", "p").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = mean.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("v"))
    alone = members.join(sizes.where("_n = 1").select("cluster_id"), "cluster_id", "left_semi")
    # a singleton's label decides its target, so labels are compared, each once
    names = alone.groupBy(F.col(label).alias("name")).agg(F.first(emb).alias("u"))
    scored = names.crossJoin(mean).select("name", "cluster_id", dot("u", "v").alias("score"))  # labels x clusters, by definition
    best = scored.groupBy("name").agg(F.max_by(F.struct("cluster_id", "score"), F.struct(F.round("score", 9), -F.col("cluster_id"))).alias("b"))
    best = best.where(F.col("b.score") > threshold).select("name", F.col("b.cluster_id").alias("target"))
    return alone.join(best, F.col(label) == F.col("name")).select("idx", "target")


def merge_singletons_in_turn(members: DataFrame, label: str = "relation", emb: str = "relation_emb", threshold: float = MERGE) -> DataFrame:
    """idx, cluster_id after singletons joined large clusters one by one, each shifting later means.

    The order matters, so labels' counts by cluster (not rows) go to one group: its size is that of
    the clusters' label sets plus the singletons.
    """
    size = members.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("cluster_id")))
    large = size.where("_n > 1").groupBy("cluster_id", F.col(label).alias("name")).agg(
        F.count(F.lit(1)).alias("c"), F.first(emb).alias("v"), F.lit(None).cast("long").alias("idx")
    )
    alone = size.where("_n = 1").select("cluster_id", F.col(label).alias("name"), F.lit(0).cast("long").alias("c"), F.col(emb).alias("v"), "idx")
    both = large.select("cluster_id", "name", "c", F.col("v").cast("array<double>").alias("v"), "idx").unionByName(
        alone.select("cluster_id", "name", "c", F.col("v").cast("array<double>").alias("v"), "idx")
    )

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        big, small = rows[rows["c"] > 0], rows[rows["c"] == 0].sort_values("cluster_id")
        sums = {
            k: (np.sum([n * np.array(v) for n, v in zip(g["c"], g["v"], strict=True)], axis=0), int(g["c"].sum())) for k,
            g in big.groupby("cluster_id")
        }
        free, out = max(sums, default=-1) + 1, []
        for idx, v in zip(small["idx"], small["v"], strict=True):
            scored = [(float(s @ np.array(v)) / n, -k) for k, (s, n) in sums.items()]
            score, at = max(scored, default=(-1.0, 0))
            if score > threshold:
                s, n = sums[-at]
                sums[-at] = s + np.array(v), n + 1
                out.append((int(idx), -at))
            else:
                out.append((int(idx), free))
                free += 1
        return pd.DataFrame(out, columns=["idx", "cluster_id"])

    merged = both.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "idx long, cluster_id long")
    return size.where("_n > 1").select("idx", "cluster_id").unionByName(merged)


# ---- consensus, on one type pair's labels in a worker; counts has the rows of each label ----


def laplacian_part(sim: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The labels' share of the rows' normalised affinity: it has the same eigenvalues but for zeros."""
    scale = np.sqrt(counts / np.maximum(sim @ counts, 1e-8))
    return scale[:, None] * sim * scale


def eigengap(sim: np.ndarray, most: int = 20, counts: np.ndarray | None = None) -> int:
    """Number of clusters at the largest gap of the rows' normalised Laplacian's first eigenvalues, 2 at least."""
    counts = np.ones(len(sim)) if counts is None else counts
    zeros = min(int(counts.sum()) - len(sim), most + 1)  # rows of one label differ by vectors that the affinity maps to 0
    values = np.sort(np.concatenate([1 - np.linalg.eigvalsh(laplacian_part(sim, counts)), np.ones(zeros)]))[: most + 1]
    return int(min(most, max(2, np.argmax(np.diff(values)) + 1))) if len(values) > 1 else 2


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, starts: int = 10, counts: np.ndarray | None = None) -> np.ndarray:
    counts = np.ones(len(x)) if counts is None else counts
    best, labels = np.inf, np.zeros(len(x), int)
    for _ in range(starts):
        centres = x[rng.choice(len(x), k, replace=False, p=counts / counts.sum())]
        for _ in range(30):
            d = ((x[:, None] - centres[None]) ** 2).sum(2)
            near = d.argmin(1)
            centres = np.stack([np.average(x[near == c], axis=0, weights=counts[near == c]) if (near == c).any() else centres[c] for c in range(k)])
        if (cost := (d.min(1) * counts).sum()) < best:
            best, labels = cost, near
    return labels


def spectral(sim: np.ndarray, rng: np.random.Generator, most: int = 20, counts: np.ndarray | None = None) -> np.ndarray | None:
    counts = np.ones(len(sim)) if counts is None else counts
    rows = int(counts.sum())
    if rows < 3 or len(sim) < 2:
        return None
    k = min(max(2, min(most, rows - 1, eigengap(sim, most, counts))), len(sim))
    vectors = np.linalg.eigh(laplacian_part(sim, counts))[1][:, -k:]
    return k_means(vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12), k, rng, counts=counts)


def density(distance: np.ndarray, size: int = 5, samples: int = 3, counts: np.ndarray | None = None) -> np.ndarray | None:
    """HDBSCAN: the tree of mutual reachability, condensed to groups of `size` rows, by excess of mass; others -1."""
    n, counts = len(distance), np.ones(len(distance)) if counts is None else counts
    if counts.sum() < size:
        return None
    order = np.argsort(distance, 1, kind="stable")
    place = np.minimum((counts[order].cumsum(1) <= samples).sum(1), n - 1)
    core = np.take_along_axis(distance, order, 1)[np.arange(n), place]
    reach = np.maximum(distance, np.maximum(core[:, None], core[None]))
    i, j = np.triu_indices(n, 1)
    # the tree: leaves are labels, whose own rows join at the core distance, before any other
    node, weight, tree, leaves = np.arange(n), list(counts), {}, [[k] for k in range(n)]
    for e in np.argsort(reach[i, j], kind="stable"):
        a, b = int(node[i[e]]), int(node[j[e]])
        if a != b:
            tree[len(weight)] = (a, b, reach[i[e], j[e]])
            leaves.append(leaves[a] + leaves[b])
            node[leaves[-1]] = len(weight)
            weight.append(weight[a] + weight[b])
    rate = lambda d: 1 / max(float(d), 1e-9)
    birth, mass, parent, held, stack = [0.0], [0.0], [-1], [leaves[-1]], [(len(weight) - 1, 0)]
    while stack:
        at, k = stack.pop()
        if at < n:
            mass[k] += weight[at] * (rate(core[at]) - birth[k])
            continue
        a, b, d = tree[at]
        large = [x for x in (a, b) if weight[x] >= size]
        if len(large) == 2:
            mass[k] += weight[at] * (rate(d) - birth[k])
            for x in large:
                stack.append((x, len(birth)))
                birth.append(rate(d))
                mass.append(0.0)
                parent.append(k)
                held.append(leaves[x])
        else:
            mass[k] += (weight[at] - sum(weight[x] for x in large)) * (rate(d) - birth[k])
            stack.extend((x, k) for x in large)
    below, chosen = [0.0] * len(birth), [False] * len(birth)
    for k in range(len(birth) - 1, 0, -1):  # the root is no group
        chosen[k] = mass[k] >= below[k]
        below[parent[k]] += max(mass[k], below[k])
    label = np.full(n, -1)
    for k in range(len(birth) - 1, 0, -1):  # a chosen group covers the chosen ones below it
        if chosen[k]:
            label[held[k]] = k
    return label


def _moved(w: np.ndarray, degree: np.ndarray, label: np.ndarray, total: float, resolution: float, within: np.ndarray | None = None) -> np.ndarray:
    """Nodes move to the community that gains most until none does. within: only single nodes move, and not out of theirs."""
    n, label = len(w), label.copy()
    for _ in range(20):
        moved = False
        for i in range(n):
            if within is not None and (label == label[i]).sum() > 1:
                continue
            weight = np.bincount(label, degree, n) - degree[i] * (np.arange(n) == label[i])
            gain = np.bincount(label, w[i], n) - resolution * degree[i] * weight / total
            if within is not None:
                gain[np.setdiff1d(np.arange(n), label[within == within[i]])] = -np.inf
            best = int(gain.argmax())
            if gain[best] > gain[label[i]] + 1e-12:
                label[i], moved = best, True
        if not moved:
            break
    return label


def communities(sim: np.ndarray, floor: float = 0.1, resolution: float = 1.0, counts: np.ndarray | None = None) -> np.ndarray:
    """Leiden's method for the modularity of the rows' graph: nodes move, communities are refined into
    parts that hang together, parts become nodes, until no part is more than one node."""
    counts = np.ones(len(sim)) if counts is None else counts
    w = np.where(sim > floor, sim, 0.0) * counts[:, None] * counts
    np.fill_diagonal(w, 0)
    degree = w.sum(1) + counts * (counts - 1)  # the similarity of two rows of one label is 1
    total, node, label = max(degree.sum(), 1e-12), np.arange(len(w)), np.arange(len(w))
    while True:
        label = _moved(w, degree, label, total, resolution)
        part = np.unique(_moved(w, degree, np.arange(len(w)), total, resolution, within=label), return_inverse=True)[1]
        if part.max() + 1 == len(w):
            return label[node]
        one = np.eye(part.max() + 1)[part]
        w, degree = one.T @ w @ one, one.T @ degree
        np.fill_diagonal(w, 0)
        of = np.zeros(len(w), int)
        of[part] = label
        node, label = part[node], np.unique(of, return_inverse=True)[1]


def average_linkage(distance: np.ndarray, threshold: float = 0.4, counts: np.ndarray | None = None) -> np.ndarray:
    """Groups merge by the least mean distance of their rows, as long as that is below the threshold."""
    n = len(distance)
    size, label = (np.ones(n) if counts is None else counts.astype(float)), np.arange(n)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    while n > 1 and d.min() < threshold:
        i, j = sorted(divmod(int(d.argmin()), n))
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i], d[j], d[:, j] = np.inf, np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    return label


def silhouette(distance: np.ndarray, label: np.ndarray, counts: np.ndarray | None = None) -> float:
    counts = np.ones(len(label)) if counts is None else counts
    names, at = np.unique(label, return_inverse=True)
    if not 2 <= len(names) <= counts.sum() - 1:
        return 0.0
    mean = np.stack([distance[:, at == c] @ counts[at == c] for c in range(len(names))], 1)
    n = np.bincount(at, counts)
    own = mean[np.arange(len(at)), at] / np.maximum(n[at] - 1, 1)
    other = mean / n
    other[np.arange(len(at)), at] = np.inf
    b = other.min(1)
    value = np.where(n[at] > 1, (b - own) / np.maximum(np.maximum(own, b), 1e-12), 0.0)
    return float(np.average(value, weights=counts))


def percentile(values: np.ndarray, counts: np.ndarray, share: float) -> float:
    """Percentile, linearly interpolated, of values that each occur so many times."""
    order = np.argsort(values, kind="stable")
    upto, place = counts[order].cumsum(), (counts.sum() - 1) * share
    lo, hi = (float(values[order][min(np.searchsorted(upto, p, "right"), len(values) - 1)]) for p in (np.floor(place), np.ceil(place)))
    return lo + (hi - lo) * (place - np.floor(place))


def connected(adjacent: np.ndarray) -> np.ndarray:
    label = np.arange(len(adjacent))
    while True:
        new = np.where(adjacent, label[None], len(label)).min(1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def proposal_weight(distance: np.ndarray, label: np.ndarray, counts: np.ndarray) -> float:
    """The silhouette if it is above 0. A distance of a row to itself other than 0 makes it invalid, which counts 0."""
    return max(0.0, silhouette(distance, label, counts)) if not np.diag(distance).any() else 0.0


def consensus(
    sim: np.ndarray, runs: int = 3, seed: int = 42, zero_diagonal: bool = False, counts: np.ndarray | None = None,
    early_stop: int = 40
) -> np.ndarray:
    """Labels by weighted votes of three proposals a run over noisy similarities and distances.

    The noise is on the diagonal too, unless zero_diagonal takes it off: then every proposal is invalid
    and all rows are one cluster, which is the default's observable result. After early_stop
    proposals that have a weight no run follows.
    """
    n, noises, counts = len(sim), np.random.RandomState(seed), np.ones(len(sim)) if counts is None else counts
    votes, total, good = np.zeros((n, n)), 0.0, 0
    for _ in range(runs if n > 1 else 0):
        noise = noises.normal(0, 0.01, (n, n))
        distance, near = np.clip(1 - sim + noise, 0, None), np.clip(sim + noise, 0, 1)
        distance, near = (distance + distance.T) / 2, (near + near.T) / 2
        if zero_diagonal:
            np.fill_diagonal(distance, 0)
            np.fill_diagonal(near, 1)
        rng = np.random.default_rng(seed)
        proposals = (
            (spectral(near, rng, counts=counts), 1 - near, 0.0), (density(distance, counts=counts), distance, 0.1),
            (communities(near, counts=counts), 1 - near, 0.0)
        )
        for label, apart, least in proposals:
            if label is None or not (kept := label >= 0).any():
                continue
            weight = proposal_weight(apart[np.ix_(kept, kept)], label[kept], counts[kept])
            if weight > least:
                total, good = total + weight, good + 1
            if weight > 0.1:
                votes += weight * ((label[:, None] == label[None]) & kept[:, None] & kept[None])
        if good >= early_stop:
            break
    if total <= 0 or n < 2:
        return np.zeros(n, int)
    votes /= total
    i, j = np.triu_indices(n)
    pairs = np.where(i == j, counts[i] * (counts[i] - 1) / 2, counts[i] * counts[j])  # of rows
    told = (pairs > 0) & np.isfinite(votes[i, j])
    if not told.any():
        return average_linkage(np.nan_to_num(1 - votes, nan=1.0), counts=counts)
    return connected(votes >= percentile(votes[i, j][told], pairs[told], 0.75))


def mean_similarity(views: dict[str, list], names) -> np.ndarray:
    """Mean of the views' products, divided by its diagonal's root and mapped to [0, 1]. A missing vector counts 0."""
    n = len(next(iter(views.values())))
    mean = np.zeros((n, n))
    for name in names:
        have = np.array([x is not None for x in views[name]])
        if have.any():
            x = np.stack([np.asarray(x, float) for x in views[name] if x is not None])
            mean[np.ix_(have, have)] += x @ x.T / len(names)
    size = np.sqrt(np.maximum(np.diag(mean), 1e-6))
    return (np.clip(mean / size[:, None] / size, -1, 1) + 1) / 2


def consensus_labels(
    members: DataFrame, lookup, group: str = "type_sig", label: str = "relation", zero_diagonal: bool = False, runs: int = 3
) -> DataFrame:
    """group, label, part: consensus over a group's rows by the mean similarity of the four views.

    Rows of one label and type pair have the same views, so a task holds a group's distinct labels and
    how many rows each has. lookup embeds texts; a missing view counts 0.
    """
    signatures = members.groupBy(group, *SIGNATURE).agg(F.count(F.lit(1)).alias("_c"))
    embs = [F.first(f"{v}_emb", ignorenulls=True).cast("array<double>").alias(f"_{v}") for v in VIEWS]
    names = embed_views(view_texts(signatures), lookup).groupBy(group, label).agg(F.sum("_c").cast("double").alias("_c"), *embs)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(label)
        views = {v: rows[f"_{v}"].to_list() for v in VIEWS}
        sim = mean_similarity(views, VIEWS)
        if not np.isfinite(sim).all():  # a view is broken: the relation's alone decides
            sim = np.nan_to_num(mean_similarity(views, ("relation",)), nan=0.5)
        counts = rows["_c"].to_numpy()
        k = eigengap(sim, counts=counts) if counts.sum() > 2 else 1
        return pd.DataFrame(
            {group: rows[group], label: rows[label], "part": consensus(sim, runs, zero_diagonal=zero_diagonal, counts=counts), "eigengap_k": k}
        )

    return names.groupBy(group).applyInPandas(run, f"{group} string, {label} string, part long, eigengap_k long")
