"""How well clusters fit labels (from the contingency table alone) and how tight they are."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.checkpoint import checkpoint
from tripleloom.functions.expressions import euclidean, ratio

# Fixed value of the metrics' definition: the label of clusters that no class is mapped to.
UNMAPPED = "NOVEL_UNMAPPED"
# Fixed value: the type pair of a row whose types are not known.
UNKNOWN_PAIR = "UNK:UNK"
#: Rows of a block of pairwise distances; cells of a contingency table that the driver takes.
BLOCK, MOST_CELLS = 4096, 4_000_000
#: Rows of a block, and pairs of a batch, where all pairs are returned.
PAIR_BLOCK, PAIR_BATCH = 2048, 1 << 18
#: Sums by row and label that a block of the silhouette holds.
MOST_SUMS = 4_000_000


def flat_labels(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """idx, pred: the cluster of each row, -1 without one."""
    return rows.select("idx").join(clusters.select("idx", "cluster_id"), "idx", "left").select(
        "idx", F.coalesce("cluster_id", F.lit(-1)).cast("long").alias("pred")
    )


def ground_truth(results: DataFrame, samples: DataFrame) -> DataFrame:
    """idx, true: by sentence id, the last sample wins; rows without one are left out."""
    w = Window.partitionBy("id").orderBy(F.desc("idx"))
    last = samples.where("id is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").select(
        F.col("id").alias("sentence_id"), F.col("relation").alias("true")
    )
    return results.join(last, "sentence_id").select(F.col("classified_idx").alias("idx"), "true")


def masks(rows: DataFrame, hidden: DataFrame) -> DataFrame:
    """rows (idx, pred, true, aligned) with the three subsets as flags."""
    flagged = rows.join(hidden.select(F.col("relation").alias("true"), F.lit(True).alias("_h")), "true", "left")
    usable = (F.col("pred") >= 0) & (F.coalesce(F.col("true"), F.lit("")) != "") & ~F.col("aligned")
    is_hidden = F.coalesce("_h", F.lit(False))
    return flagged.select(
        "idx", "pred", "true", (usable & is_hidden).alias("novel_discovery"), (usable & ~is_hidden).alias("robustness_known"),
        usable.alias("overall_pipeline")
    )


def contingency(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.where((F.col("pred") >= 0) & (F.col("true") != "")).groupBy(*(by or []), "pred", "true").agg(F.count(F.lit(1)).alias("n"))


def _margins(table: DataFrame) -> DataFrame:
    a, b = Window.partitionBy("pred"), Window.partitionBy("true")
    rows = table.withColumn("a", F.sum("n").over(a)).withColumn("b", F.sum("n").over(b))
    total = table.agg(F.sum("n").alias("t"))
    return rows.crossJoin(F.broadcast(total))  # one row


def bcubed(table: DataFrame) -> DataFrame:
    m = _margins(table).agg(
        F.sum(F.col("n") * F.col("n") / F.col("a") / F.col("t")).alias("p"),
        F.sum(F.col("n") * F.col("n") / F.col("b") / F.col("t")).alias("r")
    )
    p, r = F.coalesce("p", F.lit(0.0)), F.coalesce("r", F.lit(0.0))
    return m.select(
        F.round(p, 6).alias("bcubed_precision"), F.round(r, 6).alias("bcubed_recall"),
        F.round(ratio(2 * p * r, p + r), 6).alias("bcubed_f1")
    )


def _entropy(table: DataFrame, by: str, name: str) -> DataFrame:
    sizes = table.groupBy(by).agg(F.sum("n").alias("c"))
    total = table.agg(F.sum("n").alias("t"))
    return sizes.crossJoin(F.broadcast(total)).agg(
        F.coalesce(-F.sum(F.col("c") / F.col("t") * F.log(F.col("c") / F.col("t"))), F.lit(0.0)).alias(name)
    )


def v_measure(table: DataFrame) -> DataFrame:
    mi = _margins(table).agg(
        F.coalesce(
            F.sum(F.col("n") / F.col("t") * F.log(F.col("t").cast("double") * F.col("n") / (F.col("a").cast("double") * F.col("b")))),
            F.lit(0.0)
        ).alias("mi")
    )
    one = mi.crossJoin(_entropy(table, "true", "ht")).crossJoin(_entropy(table, "pred", "hp"))  # one row each
    h, c = F.when(F.col("ht") < 1e-12, 1.0).otherwise(F.try_divide("mi", "ht")), F.when(F.col("hp") < 1e-12, 1.0).otherwise(F.try_divide("mi", "hp"))
    return one.select(F.round(ratio(2 * h * c, h + c), 6).alias("v_measure"), F.round(h, 6).alias("homogeneity"), F.round(c, 6).alias("completeness"))


def adjusted_rand(table: DataFrame) -> DataFrame:
    squares = lambda by, name: table.groupBy(*by).agg(F.sum("n").cast("double").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias(name))
    one = squares(
        ["pred", "true"], "s"
    ).crossJoin(squares(["true"], "b")).crossJoin(squares(["pred"], "a")).crossJoin(table.agg(F.sum("n").cast("double").alias("t")))
    tp, fp, fn = F.col("s") - F.col("t"), F.col("b") - F.col("s"), F.col("a") - F.col("s")
    tn = F.col("t") * F.col("t") - fp - fn - F.col("s")
    value = F.when((fp == 0) & (fn == 0), 1.0).otherwise(F.try_divide(2 * (tp * tn - fn * fp), (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)))
    return one.select(F.round(value, 6).alias("ari"))


# ---- on the collected contingency table: clusters x classes, not rows ----


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, by shortest augmenting paths with potentials."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[at] = True
            i, free = owner[at], ~used
            free[0] = False
            slack = np.full(m + 1, np.inf)
            slack[1:] = c[i - 1] - u[i] - v[1:]
            closer = free & (slack < least)
            least[closer], way[closer] = slack[closer], at
            nxt = int(np.where(free, least, np.inf).argmin())
            step = least[nxt]
            u[owner[used]] += step
            v[used] -= step
            least[free] -= step
            at = nxt
            if owner[at] == 0:
                break
        while at:
            owner[at], at = owner[way[at]], way[at]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def collected(table: DataFrame, most: int = MOST_CELLS) -> pd.DataFrame:
    """A contingency table on the driver; one of more cells is an error before it is a full memory."""
    rows = table.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"contingency table: more than {most} cells")
    return rows


def _counts(rows: pd.DataFrame) -> tuple[list, list, np.ndarray]:
    preds, i = np.unique(rows["pred"].to_numpy(), return_inverse=True)
    trues, j = np.unique(rows["true"].to_numpy(), return_inverse=True)
    n = np.zeros((len(preds), len(trues)))
    np.add.at(n, (i, j), rows["n"].to_numpy())
    return preds.tolist(), trues.tolist(), n


_FACTORIALS = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 256)))])


def log_factorial(n: np.ndarray) -> np.ndarray:
    """By table, and by Stirling's series where that is exact to the last digits."""
    x = np.maximum(n, 255).astype(float)
    series = x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < 256, _FACTORIALS[np.minimum(n, 255).astype(int)], series)


def expected_mutual_information(a: np.ndarray, b: np.ndarray) -> float:
    """Of two random labellings with these cluster sizes; equal sizes are summed once.

    An overlap is hypergeometric; it is summed where it can matter, a dozen deviations around its mean.
    """
    total, expected = float(a.sum()), 0.0
    sizes, often = np.unique(b, return_counts=True)
    for x, times in zip(*np.unique(a, return_counts=True), strict=True):
        mean = x * sizes / total
        reach = 40 + 12 * np.sqrt(mean * (1 - x / total) * (total - sizes) / max(total - 1, 1))
        low = np.maximum(np.maximum(1, x + sizes - total), np.floor(mean - reach))
        high = np.minimum(np.minimum(x, sizes), np.ceil(mean + reach))
        n = np.maximum(high - low + 1, 0).astype(int)
        at = np.repeat(np.arange(len(sizes)), n)
        k = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        y, f = sizes[at], log_factorial
        fixed = f(np.array([x, total - x, total])) @ [1, 1, -1]
        chance = fixed + (f(sizes) + f(total - sizes))[at] - f(k) - f(x - k) - f(y - k) - f(total - x - y + k)
        expected += times * float((often[at] * k / total * np.log(total * k / (x * y)) * np.exp(chance)).sum())
    return expected


def adjusted_mutual_information(n: np.ndarray) -> float:
    """Chance-adjusted mutual information, normalised by the mean of both entropies."""
    a, b, total = n.sum(1), n.sum(0), n.sum()
    if total == 0 or (len(a) == 1 and len(b) == 1):
        return 1.0
    h = lambda x: float(-(x / total * np.log(x / total)).sum())
    i, j = n.nonzero()
    mi = float((n[i, j] / total * np.log(total * n[i, j] / (a[i] * b[j]))).sum())
    expected, mean = expected_mutual_information(a, b), (h(a) + h(b)) / 2
    return (mi - expected) / (mean - expected) if abs(mean - expected) > 1e-15 else 1.0


def map_clusters(rows: pd.DataFrame) -> tuple[dict, float]:
    """Cluster -> class of the assignment that matches most rows; the share it matches."""
    preds, trues, n = _counts(rows)
    if not len(rows):
        return {}, 0.0
    pairs = assignment(-n)
    return {preds[i]: trues[j] for i, j in pairs}, float(sum(n[i, j] for i, j in pairs) / n.sum())


def subset_metrics(rows: pd.DataFrame, collapse: bool = True) -> dict:
    """All supervised metrics of one contingency table (pred, true, n), on mapped labels.

    collapse: clusters without a class share one label, as the metrics' definition has it.
    """
    mapping, accuracy = map_clusters(rows)
    mapped = rows.assign(
        pred=[mapping.get(p, UNMAPPED if collapse else f"{UNMAPPED}:{p}") for p in rows["pred"]]
    ).groupby(["pred", "true"], as_index=False)["n"].sum()
    _, _, n = _counts(mapped)
    a, b, total = n.sum(1, keepdims=True), n.sum(0, keepdims=True), n.sum()
    p, r = float((n * n / a).sum() / total), float((n * n / b).sum() / total)
    h = lambda x: float(-(x / total * np.log(x / total)).sum())
    i, j = n.nonzero()
    mi = float((n[i, j] / total * np.log(total * n[i, j] / (a[i, 0] * b[0, j]))).sum())
    hom, com = (1.0 if h(b) < 1e-12 else mi / h(b)), (1.0 if h(a) < 1e-12 else mi / h(a))
    s = float((n * n).sum())
    tp, fp, fn = s - total, float((b * b).sum()) - s, float((a * a).sum()) - s
    tn = total * total - fp - fn - s
    ari = 1.0 if fp == fn == 0 else 2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))
    return {
        "bcubed_precision": p, "bcubed_recall": r, "bcubed_f1": 2 * p * r / (p + r) if p + r else 0.0,
        "v_measure": 2 * hom * com / (hom + com) if hom + com else 0.0, "homogeneity": hom, "completeness": com, "ari": ari,
        "ami": adjusted_mutual_information(n), "mapping_accuracy": accuracy, "n_samples": int(rows["n"].sum()),
        "n_clusters": int(rows["pred"].nunique()), "n_true_classes": int(rows["true"].nunique()),
        "cluster_to_gt_map": {int(k): v for k, v in mapping.items()}
    }


def stratified(rows: DataFrame, collapse: bool = True) -> dict[str, dict]:
    """Metrics of the three subsets of masks(); one of fewer than 2 rows is left out. Contingency tables alone are collected."""
    out = {}
    for name in ("novel_discovery", "robustness_known", "overall_pipeline"):
        table = collected(contingency(rows.where(name)))
        if table["n"].sum() >= 2:
            out[name] = subset_metrics(table, collapse)
    return out


def flatten_metrics(metrics: dict[str, dict]) -> dict[str, float]:
    return {f"{s}_{k}": v for s, m in metrics.items() for k, v in m.items() if not isinstance(v, dict)}


# ---- tightness, without labels; by: columns of groups that are measured apart ----


def centroids(rows: DataFrame, label: str, emb: str, by: list[str] | None = None) -> DataFrame:
    """by, label, size, centroid."""
    keys = [*(by or []), label]
    mean = rows.select(*keys, F.posexplode(emb).alias("p", "x")).groupBy(*keys, "p").agg(
        F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("size")
    )
    points = F.transform(F.sort_array(F.collect_list(F.struct("p", "m"))), lambda s: s["m"])
    return mean.groupBy(*keys).agg(F.max("size").alias("size"), points.alias("centroid"))


def _scatter(rows: DataFrame, label: str, emb: str, by: list[str]) -> DataFrame:
    """by, label, size, centroid, s (mean distance to it), w (sum of squared ones)."""
    keys, d = [*by, label], euclidean(emb, "centroid")
    found = rows.join(centroids(rows, label, emb, by), keys).groupBy(*keys)
    return found.agg(F.avg(d).alias("s"), F.sum(d * d).alias("w"), F.first("size").alias("size"), F.first("centroid").alias("centroid"))


def _pairs(c: DataFrame, label: str, by: list[str]) -> DataFrame:
    """Pairs of centroids, not of rows, with their distance."""
    other = c.select(*by, F.col(label).alias("_o"), F.col("s").alias("_s"), F.col("centroid").alias("_c"))
    pairs = c.join(other, by) if by else c.crossJoin(other)
    return pairs.where(F.col(label) != F.col("_o")).withColumn("d", euclidean("centroid", "_c"))


def davies_bouldin(rows: DataFrame, label: str, emb: str, by: list[str] | None = None) -> DataFrame:
    """Centroids that coincide count 0, as by definition."""
    by = by or []
    worst = _pairs(_scatter(rows, label, emb, by), label, by).groupBy(*by, label).agg(F.max(ratio(F.col("s") + F.col("_s"), "d")).alias("m"))
    return worst.groupBy(*by).agg(F.round(F.avg("m"), 6).alias("davies_bouldin"))


def calinski_harabasz(rows: DataFrame, label: str, emb: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    c = _scatter(rows, label, emb, by)
    whole = centroids(rows.withColumn("_all", F.lit(1)), "_all", emb, by).select(*by, F.col("centroid").alias("mean"), F.col("size").alias("n"))
    both = c.join(whole, by) if by else c.crossJoin(F.broadcast(whole))  # one row
    one = both.groupBy(*by).agg(
        F.sum(F.col("size") * F.pow(euclidean("centroid", "mean"), 2)).alias("b"), F.sum("w").alias("w"),
        F.count(F.lit(1)).alias("k"), F.max("n").alias("n")
    )
    value = F.when(F.col("w") == 0, 1.0).otherwise(F.try_divide(F.try_divide("b", F.col("k") - 1), F.try_divide("w", F.col("n") - F.col("k"))))
    return one.select(*by, F.round(value, 6).alias("calinski_harabasz"))


def density_separation(rows: DataFrame, label: str, emb: str) -> DataFrame:
    c = _scatter(rows, label, emb, [])
    apart = _pairs(c, label, []).agg(F.avg("d").alias("apart"))
    return c.agg(F.avg("s").alias("within")).crossJoin(apart).select(
        F.round(F.col("within") / (F.col("apart") + 1e-8), 6).alias("density_separation")
    )  # one row each


def _pairs_of_blocks(rows: DataFrame, by: list[str], columns: list, most: int, place: str = "vec_id") -> DataFrame:
    """by, p, q, a, b: each pair of blocks of about `most` rows of a group, the columns' rows as arrays.

    Pairs are dealt out by group and block, so a large group's are in many tasks; rows are dealt to blocks by `place`.
    """
    sizes = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / most).alias("_blocks"))
    whole = rows.join(
        sizes, [rows[c].eqNullSafe(sizes[c]) for c in by]
    ).drop(*(sizes[c] for c in by)) if by else rows.crossJoin(F.broadcast(sizes))  # one row
    block = F.pmod(F.xxhash64(place), F.col("_blocks")).cast("int")
    packed = checkpoint(whole.withColumn("p", block).groupBy(*by, "p", "_blocks").agg(F.collect_list(F.struct(*columns)).alias("a")))
    keys = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by]
    left = packed.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("_blocks").cast("int") - 1))).alias("x")
    right = packed.select(*by, F.col("p").alias("q"), F.col("a").alias("b")).alias("y")
    return left.join(right, [*keys, F.col("x.q") == F.col("y.q")]).select(*(F.col(f"x.{c}") for c in by), "p", "x.q", "a", "b")


def _vectors(cell) -> np.ndarray:
    x = cell.values.field("x")
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)


def diameters(rows: DataFrame, label: str, emb: str, by: list[str] | None = None, most: int = BLOCK) -> DataFrame:
    """by, wide: the largest cosine distance of two rows of one label, over labels of several rows."""
    by = by or []
    keys = [*by, label]
    pairs = _pairs_of_blocks(rows.where(F.col(emb).isNotNull()), keys, [F.col("vec_id").alias("i"), F.col(emb).alias("x")], most).where("p <= q")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*keys).schema)

    def run(batches):
        for b in batches:
            widest = []
            for k in range(b.num_rows):
                x, y = _vectors(b.column("a")[k]), _vectors(b.column("b")[k])
                x, y = (v / (np.sqrt((v * v).sum(1, keepdims=True)) + 1e-8) for v in (x, y))
                same, least = b.column("p")[k].as_py() == b.column("q")[k].as_py(), 2.0
                for lo in range(0, len(x), 256):
                    cos = x[lo : lo + 256] @ y.T
                    if same:  # a row is no pair with itself
                        cos[np.arange(len(cos)), lo + np.arange(len(cos))] = 2.0
                    least = min(least, float(cos.min()))
                widest.append(1 - least if least < 2.0 else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), pa.array(widest, pa.float64())], [*keys, "wide"])

    return pairs.mapInArrow(run, f"{kinds}, wide double").groupBy(*by).agg(F.max("wide").alias("wide"))


def _by_length(cell) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """A block's ids, and by vectors' length their places and the vectors; null vectors and those that hold a null are in none."""
    x = cell.values.field("x")
    lengths = x.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).copy()
    flat, of = x.flatten(), np.repeat(np.arange(len(x)), np.maximum(lengths, 0))
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    kept = lengths.copy()
    if flat.null_count:
        kept[of[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    found = {}
    for n in np.unique(kept[kept >= 0]):
        at = np.flatnonzero(kept == n)
        found[int(n)] = at, values[(kept == n)[of]].reshape(len(at), n)
    return cell.values.field("i").to_numpy(zero_copy_only=False), found


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1)) + 1e-8


def _block_distances(a, b, same: bool, digits: int | None):
    """Arrays i, j, distance, and whether there is one, of the pairs of two blocks, some of a's rows at a time."""
    (ids, xs), (others, ys) = _by_length(a), _by_length(b)
    sized = {n: (*xs[n], _lengths(xs[n][1]), *ys[n], _lengths(ys[n][1])) for n in xs if n in ys}
    step = max(1, PAIR_BATCH // len(others))
    for lo in range(0, len(ids), step):
        i = ids[lo : lo + step, None]
        d, told = np.zeros((len(i), len(others))), np.zeros((len(i), len(others)), bool)
        for at, x, u, to, y, v in sized.values():
            part = slice(*np.searchsorted(at, (lo, lo + step)))
            cells = np.ix_(at[part] - lo, to)
            d[cells], told[cells] = 1 - x[part] @ y.T / (u[part, None] * v), True
        if digits is not None:  # half away from zero, as SQL has it
            d *= 10**digits
            d = np.trunc(d + np.copysign(0.5, d)) / 10**digits + 0.0
        kept = i < others if same else i != others  # within one block a pair is met both ways round
        yield np.minimum(i, others)[kept], np.maximum(i, others)[kept], d[kept], told[kept]


def cosine_distances(
    rows: DataFrame, id_col: str, label: str, emb: str, digits: int | None = None, most: int = PAIR_BLOCK
) -> DataFrame:
    """i, j (i < j), distance of all pairs of rows of one label: one less the cosine, 1e-8 added to both lengths.

    Pairs of blocks of rows are dealt out evenly, however few the labels are. The distance is null if a vector
    is, holds a null, or is not as long as the other; a row without an id or a label is in no pair.
    """
    whole = rows.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).select(
        F.col(label).alias("_label"), F.col(id_col).cast("long").alias("i"), F.col(emb).alias("x")
    ).withColumn("_place", F.monotonically_increasing_id())  # rows of one id need not be in one block
    pairs = _pairs_of_blocks(whole, ["_label"], ["i", "x"], most, "_place").where("p <= q").select("p", "q", "a", "b")
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("distance", pa.float64())])

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                same = b.column("p")[k].as_py() == b.column("q")[k].as_py()
                with np.errstate(invalid="ignore", over="ignore"):
                    for i, j, d, told in _block_distances(b.column("a")[k], b.column("b")[k], same, digits):
                        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(d, mask=~told)], schema=schema)

    return pairs.repartition(max(1, pairs.count())).mapInArrow(run, "i long, j long, distance double")


def dunn(rows: DataFrame, label: str, emb: str, by: list[str] | None = None) -> DataFrame:
    """Least distance of centroids over the largest cosine distance within a cluster (two measures, by definition)."""
    by = by or []
    near = _pairs(_scatter(rows, label, emb, by), label, by).groupBy(*by).agg(F.min("d").alias("near"))
    wide = diameters(rows, label, emb, by)
    both = near.join(wide, by) if by else near.crossJoin(wide)  # one row each
    return both.select(*by, F.round(F.try_divide("near", "wide"), 6).alias("dunn"))


def _row_silhouettes(rows: DataFrame, by: list[str], label: str, emb: str, most: int) -> DataFrame:
    """by, value: (b - a) / max(a, b) of each row, 0 for a row alone in its cluster.

    A block of rows meets every block of its group in one task, one after the other, and keeps the sums
    of its rows' distances by label; so a row leaves once. Blocks are smaller where labels are many.
    """
    whole = rows.where(F.col("vec_id").isNotNull() & F.col(emb).isNotNull())
    sizes = whole.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(label).alias("_k"))
    in_block = F.least(F.lit(most), F.greatest(F.lit(64), F.expr(f"{MOST_SUMS} div greatest(_k, 1)")))
    sizes = checkpoint(sizes.select(*by, F.ceil(F.col("_n") / in_block).cast("int").alias("_blocks")))
    joined = whole.join(
        sizes, [whole[c].eqNullSafe(sizes[c]) for c in by]
    ).drop(*(sizes[c] for c in by)) if by else whole.crossJoin(F.broadcast(sizes))  # one row
    place = F.pmod(F.xxhash64("vec_id"), F.col("_blocks")).cast("int")
    row = F.struct(F.col("vec_id").alias("i"), F.col(label).alias("l"), F.col(emb).alias("x"))
    packed = checkpoint(joined.withColumn("p", place).groupBy(*by, "p", "_blocks").agg(F.collect_list(row).alias("a")))
    own = packed.select(*by, "p", F.lit(-1).alias("q"), "a")
    other = packed.select(
        *by, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("to"), F.col("p").alias("q"), "a"
    ).select(*by, F.col("to").alias("p"), "q", "a")
    # a task holds all blocks that a block meets, its own first
    met = own.unionByName(other).repartition(*by, "p").sortWithinPartitions(*by, "p", "q")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = pa.schema(
        [*((f.name, f.type) for f in packed.select(*by).limit(0).toArrow().schema), ("value", pa.float64())]
    ) if by else pa.schema([("value", pa.float64())])

    def run(batches):
        key = mine = None
        for b in batches:
            for k in range(b.num_rows):
                at, cell = tuple(b.column(c)[k].as_py() for c in (*by, "p")), b.column("a")[k]
                i, names, x = cell.values.field("i").to_numpy(zero_copy_only=False), cell.values.field("l").to_pylist(), _vectors(cell)
                if b.column("q")[k].as_py() < 0:
                    if mine is not None:
                        yield mine.values(key[:-1], schema)
                    key, mine = at, _Sums(i, names, x)
                else:
                    mine.meet(i, names, x, b.column("q")[k].as_py() == at[-1])
        if mine is not None:
            yield mine.values(key[:-1], schema)

    return met.mapInArrow(run, "".join(f"{c} {kinds[c]}, " for c in by) + "value double")


class _Sums:
    """Of a block's rows: sums and numbers of their distances to the rows of each label met so far."""

    def __init__(self, ids: np.ndarray, names: list, x: np.ndarray):
        self.ids, self.names, self.x, self.of = ids, names, x, {}

    def meet(self, ids: np.ndarray, names: list, y: np.ndarray, same: bool) -> None:
        known = [k for k, n in enumerate(names) if n is not None]
        ids, names, y = ids[known], [names[k] for k in known], y[known]
        at = {n: c for c, n in enumerate(dict.fromkeys(names))}
        one = np.zeros((len(names), len(at)))
        one[np.arange(len(names)), [at[n] for n in names]] = 1
        for n in at:
            self.of.setdefault(n, np.zeros((2, len(self.ids))))
        sizes = (y * y).sum(1)
        for lo in range(0, len(self.ids), 256):
            u = self.x[lo : lo + 256]
            d = np.sqrt(np.maximum((u * u).sum(1)[:, None] + sizes - 2 * u @ y.T, 0))
            n = np.tile(one.sum(0), (len(u), 1))
            if same:  # rows of one id are in one block
                own = self.ids[lo : lo + 256, None] == ids[None]
                d[own] = 0
                n -= own @ one
            total = d @ one
            for name, c in at.items():
                self.of[name][:, lo : lo + 256] += total[:, c], n[:, c]

    def values(self, group: tuple, schema: pa.Schema) -> pa.RecordBatch:
        own, other = np.full(len(self.ids), np.nan), np.full(len(self.ids), np.inf)
        place = {n: k for k, n in enumerate(self.of)}
        names = np.array([place.get(n, -1) for n in self.names])
        for k, (total, n) in enumerate(self.of.values()):
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = np.where(n > 0, total / n, np.nan)
            mine = names == k
            own[mine] = mean[mine]
            other = np.where(~mine & ~np.isnan(mean), np.minimum(other, mean), other)
        told = ~np.isnan(own) & np.isfinite(other) & (np.maximum(own, other) > 0)
        value = np.where(told, (other - own) / np.where(told, np.maximum(own, other), 1), 0.0)
        columns = [pa.array([g] * len(value), f.type) for g, f in zip(group, schema, strict=False)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(value)], schema=schema)


def silhouette(rows: DataFrame, label: str, emb: str, by: list[str] | None = None, most: int = BLOCK) -> DataFrame:
    """Mean over rows of (b - a) / max(a, b); a row alone in its cluster counts 0. The whole table goes by blocks; rows without a vector are left out."""
    by = by or []
    return _row_silhouettes(rows, by, label, emb, most).groupBy(*by).agg(F.round(F.avg("value"), 6).alias("silhouette"))


def quality_bundle(rows: DataFrame, label: str, emb: str) -> DataFrame:
    """silhouette, davies_bouldin, calinski_harabasz, density_separation in one row; all null with one cluster or one a row."""
    size = rows.agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(label).alias("_k"))
    for part in (
        silhouette(rows, label, emb), davies_bouldin(rows, label, emb), calinski_harabasz(rows, label, emb),
        density_separation(rows, label, emb)
    ):
        size = size.crossJoin(part)  # one row each
    return size.select(
        *(F.when((F.col("_k") > 1) & (F.col("_k") < F.col("_n")), F.col(c)).alias(c) for c in ("silhouette", "davies_bouldin", "calinski_harabasz", "density_separation"))
    )


def type_pair_quality(rows: DataFrame, pair: str, label: str, emb: str) -> DataFrame:
    """pair, silhouette, calinski_harabasz, davies_bouldin, dunn, n_samples, n_clusters of the type pairs.

    Labels of one row in a pair are left out, then pairs of fewer than 3 rows; a measure that needs two
    labels, or rows that share one, is null without. A missing pair is UNK:UNK.
    """
    named = rows.withColumn(pair, F.coalesce(F.col(pair), F.lit(UNKNOWN_PAIR)))
    labels = named.groupBy(pair, label).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    sizes = checkpoint(labels.groupBy(pair).agg(F.sum("_n").alias("n_samples"), F.count(F.lit(1)).alias("n_clusters")).where("n_samples >= 3"))
    kept = checkpoint(
        named.join(labels.drop("_n"), [pair, label], "left_semi").join(sizes.select(pair), pair, "left_semi").select(pair, label, "vec_id", emb)
    )
    found = sizes
    for part in (silhouette, calinski_harabasz, davies_bouldin, dunn):
        found = found.join(part(kept, label, emb, [pair]), pair, "left")
    valid = (F.col("n_clusters") > 1) & (F.col("n_clusters") < F.col("n_samples"))
    return found.select(
        pair, *(F.when(valid, F.col(c)).alias(c) for c in ("silhouette", "calinski_harabasz", "davies_bouldin")), "dunn",
        "n_samples", "n_clusters"
    )


def type_pair_summary(quality: DataFrame) -> DataFrame:
    """Means of the type pairs' measures, over those that have them, and the number of pairs; no row without a pair."""
    means = [F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("silhouette", "calinski_harabasz", "davies_bouldin", "dunn")]
    return quality.agg(*means, F.count(F.lit(1)).alias("n_typepairs")).where("n_typepairs > 0")
