"""Quality classifier from weak labels (9).

Overlapping heuristic labellers vote good, bad or nothing on every document. Votes are counted by
pattern (at most 3^labellers patterns, whatever the corpus), and expectation-maximisation estimates
from those counts alone how often each labeller, if it votes, is right on good and on bad documents,
and the share of good ones; a labeller that votes nothing says nothing. It starts from each pattern's balance of votes, the assumption
being only that labellers are right more often than wrong. The posteriors label documents for a
linear scorer over hashed 4-byte windows and votes, fitted by logistic regression on a bounded
sample: the MOST_SAMPLE distinct documents of the smallest id hash. Every document is fitted on and scored
whole. Both classes weigh the same in the fit, so a score of THRESHOLD, one half, is the point of
no preference.

Defined cases: a null or empty text has no windows: it gets the scorer's bias and its posterior, and
is not kept; a very long text is read whole, in time proportional to its length; a score that ties
with the threshold is kept; repeated rows give repeated rows and are fitted on once; rows without an
id are not fitted on; an empty table gives no rows; bytes that aren't UTF-8 become replacement characters.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.common import batch, chunks, id_and_text
from tripleloom.llm.features import byte_buckets
from tripleloom.llm.quality_rules import repeated_words

BITS, MOST_SAMPLE, ROUNDS, STEPS, RIDGE, THRESHOLD = 13, 4096, 100, 60, 1e-5, 0.5
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
#: ASCII that is neither letter, digit, white space nor common punctuation.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-")
#: Two or more signs in a row, but for points, quotes and dashes.
SIGNS = re.compile(rb"[!-/:-@\[-`{-~]{2,}")
ORDINARY = re.compile(rb"[.'\"\-,)(]+")
WORDLESS = re.compile(rb"(?<!\S)[^\sA-Za-z\x80-\xff]+(?!\S)")


def votes(raw: bytes) -> tuple[int, ...]:
    """1 good, 0 bad, -1 nothing, of each labeller."""
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    letters = size - len(raw.translate(None, LETTERS))
    upper = len(raw) - len(raw.translate(None, LETTERS[:26]))
    marks = (len(raw) - len(raw.translate(None, MARKS))) / size
    lines = [x.strip() for x in raw.split(b"\n") if x.strip()]
    ended = sum(x[-1:] in b".!?:\"" for x in lines) / max(1, len(lines))
    length = sum(map(len, words)) / max(1, n)
    signs = sum(not ORDINARY.fullmatch(x) for x in SIGNS.findall(raw)) / max(1, n)
    repeated = repeated_words(words)
    again = 1 - len(set(lines)) / max(1, len(lines))
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, n - 1)
    wordless = len(WORDLESS.findall(raw)) / max(1, n)
    choose = lambda bad, good: 0 if bad else 1 if good else -1
    return (
        choose(n < 3, n >= 50),
        choose(marks > 0.03, marks < 0.01),
        choose(upper > 0.3 * max(1, letters), upper < 0.1 * letters),
        choose(ended < 0.3, ended >= 0.6),
        choose(length < 2 or length > 15, 3 <= length <= 10),
        choose(signs > 0.1, signs < 0.01),
        choose(again > 0.3, again == 0 and len(lines) > 1),
        choose(2 * repeated > max(1, n), n >= 50 and 5 * repeated < n),
        choose(wordless > 0.2, wordless < 0.05),
        choose(stutter > 0.2, n >= 50 and stutter < 0.02),
    )


LABELLERS = 10


def code(v: tuple[int, ...]) -> int:
    return sum((x + 1) * 3**k for k, x in enumerate(v))


def expectation_maximisation(
    patterns: np.ndarray, counts: np.ndarray, labellers: int = LABELLERS, rounds: int = ROUNDS
) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each of the 3^labellers patterns; the shares of bad and of good votes of each labeller on documents of each class (bad, good); the share of good."""
    every = np.arange(3**labellers)[:, None] // 3 ** np.arange(labellers) % 3
    good, bad = (every == 2).sum(1), (every == 1).sum(1)
    posterior = np.clip((good + 1) / (good + 2 * bad + 2), 0.01, 0.99)  # a labeller looks for one fault, so its bad vote says more
    weight = np.zeros(3**labellers)
    weight[patterns] = counts
    prior, share, voted = 0.5, np.full((2, labellers, 2), 1 / 2), every > 0
    for _ in range(rounds):
        for k, p in enumerate((1 - posterior, posterior)):
            mass = weight * p
            share[k] = np.stack([mass @ (every == vote) for vote in (1, 2)], 1) + 1
            share[k] /= share[k].sum(1, keepdims=True)
        prior = float((weight @ posterior + 1) / (weight.sum() + 2))
        rows = (np.log(share)[:, np.arange(labellers), every - 1] * voted).sum(2)
        new = 1 / (1 + np.exp(np.clip(np.log1p(-prior) + rows[0] - np.log(prior) - rows[1], -500, 500)))
        done, posterior = np.abs(new - posterior).max() < 1e-6, new
        if done:
            break
    return posterior, share, prior


SIZE = (1 << BITS) + 3 * LABELLERS


def features(raw: bytes, v: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights: of the windows log(1 + count), of length one together; and a bucket for each vote."""
    n = np.bincount(byte_buckets(raw, BITS), minlength=1 << BITS)
    used = n.nonzero()[0]
    x = np.log1p(n[used])
    cast = (1 << BITS) + 3 * np.arange(LABELLERS) + 1 + np.array(v)
    return np.concatenate([used, cast]), np.concatenate([x / max(1e-12, float(np.sqrt(x @ x))), np.full(LABELLERS, 0.2)])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by L-BFGS; both classes weigh the same."""
    if not rows:
        return np.zeros(SIZE), 0.0
    at, x = np.concatenate([r[0] for r in rows]).astype(np.int32), np.concatenate([r[1] for r in rows]).astype(np.float64)
    sizes = np.array([len(r[0]) for r in rows])  # each has its votes at least
    begin = np.cumsum(sizes) - sizes
    share = float(np.clip(labels.mean(), 0.02, 0.98))
    weight = labels / share + (1 - labels) / (1 - share)
    weight /= weight.sum()

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        """And its gradient; the last weight is the bias."""
        z = np.add.reduceat(x * w[at], begin) + w[-1]
        d = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels)
        slope = np.append(np.bincount(at, x * np.repeat(d, sizes), SIZE) + RIDGE * w[:-1], d.sum())
        return float(weight @ (np.logaddexp(0, z) - labels * z)) + RIDGE / 2 * float(w[:-1] @ w[:-1]), slope

    w, past = np.zeros(SIZE + 1), []
    value, slope = loss(w)
    for _ in range(steps):
        step, kept = -slope, []
        for s, y in reversed(past):
            a = (s @ step) / (s @ y)
            step -= a * y
            kept.append(a)
        if past:
            step *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(kept), strict=True):
            step += (a - (y @ step) / (s @ y)) * s
        rate = 1.0 if past else 1.0 / max(1e-12, float(np.abs(slope).sum()))
        while True:
            new = w + rate * step
            new_value, new_slope = loss(new)
            if new_value <= value + 1e-4 * rate * float(slope @ step) or rate < 1e-10:
                break
            rate /= 2
        s, y = new - w, new_slope - slope
        if s @ y > 1e-18:
            past = [*past[-7:], (s, y)]
        done, w, value, slope = value - new_value < 1e-7 * value, new, new_value, new_slope
        if done:
            break
    return w[:-1], float(w[-1])


PATTERNS = pa.schema([("pattern", pa.int32()), ("n", pa.int64())])
VECTORS = pa.schema([("at", pa.binary()), ("x", pa.binary()), ("label", pa.float64())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_votes", pa.int64()), ("posterior", pa.float64()), ("score", pa.float64()), ("kept", pa.bool_())])


def classify(docs: DataFrame, most_sample: int = MOST_SAMPLE) -> DataFrame:
    """doc_id, n_votes, posterior (of the labellers), score (of the scorer, 0 to 1), kept (score at least THRESHOLD)."""
    spark, rows = docs.sparkSession, id_and_text(docs)

    def patterns(batches):
        n = np.zeros(3**LABELLERS, np.int64)
        for b in chunks(batches, "text"):
            for t in b.column("text").to_pylist():
                n[code(votes(t))] += 1
        used = n.nonzero()[0]
        yield batch(PATTERNS, used.astype(np.int32), n[used])

    found = rows.select("text").mapInArrow(patterns, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()
    posterior, _, _ = expectation_maximisation(found["pattern"].to_numpy(), found["n"].to_numpy())
    shared = spark.sparkContext.broadcast(posterior)

    def vectors(batches):
        for b in chunks(batches, "text"):
            texts = b.column("text").to_pylist()
            v = [votes(t) for t in texts]
            at, x = zip(*(features(t, y) for t, y in zip(texts, v, strict=True)), strict=True)
            yield batch(
                VECTORS, [k.astype(np.int16).tobytes() for k in at], [k.astype(np.float32).tobytes() for k in x],
                [float(shared.value[code(y)]) for y in v]
            )

    # the sampled texts stay in the executors, whole; their buckets and posteriors come to the driver
    keyed = rows.where("doc_id is not null").withColumn("key", F.xxhash64("text"))
    chosen = keyed.select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key")
    ).distinct().orderBy(F.xxhash64("_id"), "_id", "_key").limit(most_sample)
    found = keyed.join(
        F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("key") == F.col("_key")), "left_semi"
    ).dropDuplicates(["doc_id", "key"])
    sample = found.select("text").mapInArrow(vectors, "at binary, x binary, label double").toArrow()
    sample = sample.sort_by([("label", "ascending"), ("at", "ascending"), ("x", "ascending")])
    w, bias = fit(
        [
            (np.frombuffer(at, np.int16), np.frombuffer(x, np.float32)) for at,
            x in zip(sample["at"].to_pylist(), sample["x"].to_pylist(), strict=True)
        ],
        sample["label"].to_numpy()
    )
    model = spark.sparkContext.broadcast((w, bias, posterior))

    def run(batches):
        w, bias, posterior = model.value
        for b in chunks(batches, "text"):
            texts = b.column("text").to_pylist()
            v = [votes(t) for t in texts]
            score = []
            for t, y in zip(texts, v, strict=True):
                at, x = features(t, y)
                score.append(1 / (1 + float(np.exp(-np.clip(x @ w[at] + bias, -50, 50)))))
            yield batch(
                RESULT, b.column("doc_id"), [sum(x >= 0 for x in y) for y in v], [float(posterior[code(x)]) for x in v], score,
                [bool(t.strip()) and s >= THRESHOLD for t, s in zip(texts, score, strict=True)]
            )

    return rows.mapInArrow(run, "doc_id long, n_votes long, posterior double, score double, kept boolean")
