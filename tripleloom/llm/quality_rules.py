"""Quality rules with a log-likelihood ratio of hashed n-grams (4).

Two multinomials over the buckets of 4-byte windows: one of trusted documents, one of the whole raw
corpus; the trusted one is drawn towards the raw one by PRIOR windows, so that few trusted documents
decide little. A document's score is the mean over its windows of log(p_trusted / p_raw). It is kept if it
passes the base rules and its score is at least the threshold, the same for every document.

The raw counts cover every document. The trusted side is every document in a set of ids that is
bounded (MOST_TRUSTED ids, those of the smallest hash), so that the ids can be broadcast.

Defined cases: a null or empty text has no words, score 0, and fails the base rules; without any
trusted document every score is 0; repeated rows count as often as they come; a score that ties with
the threshold is kept; a very long text is read whole; bytes that aren't UTF-8 become replacement
characters; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.common import batch, chunks, id_and_text, texts_of
from tripleloom.llm.features import byte_buckets

BITS, ADD, PRIOR, MOST_TRUSTED, THRESHOLD = 16, 1.0, float(1 << 16), 20_000, -0.5
# Fixed values of the base rules.
MIN_WORDS, MOST_REPEATED_PERCENT, SYMBOLS, SPACES = 50, 50, b"#*$%&|<>", b" \t\n\x0b\x0c\r"
COUNTS = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("trusted", pa.int64())])
RESULT = pa.schema(
    [("doc_id", pa.int64())] + [
        (c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    ] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("llr", pa.float64())]
)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more, the first one included."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) < 1 << 21:
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        pairs = np.unique((ids[:-1] << 32) | ids[1:], return_inverse=True)[1]
        windows = (pairs[:-1] << 32) | ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : n + k] |= twice
    return int(covered.sum())


def rules(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(words), len(raw.translate(None, SPACES).decode()), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def trusted_ids(labels: DataFrame, most: int = MOST_TRUSTED) -> DataFrame:
    """At most so many ids labelled quality 1: those of the smallest hash, a choice that no order of rows sways."""
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()
    return ids.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(most)


def log_ratio(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log(p_trusted / p_raw) by bucket, from one pass over all documents."""

    def run(batches):
        raw, trusted = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for b in chunks(batches, "text"):
            for text, good in zip(b.column("text").to_pylist(), b.column("trusted").to_pylist(), strict=True):
                n = np.bincount(byte_buckets(text, BITS), minlength=1 << BITS)
                raw += n
                if good:
                    trusted += n
        used = raw.nonzero()[0]
        yield batch(COUNTS, used.astype(np.int32), raw[used], trusted[used])

    ids = F.broadcast(trusted_ids(labels))
    rows = id_and_text(docs).join(ids, F.col("doc_id") == F.col("trusted_id"), "left").select(
        "text", F.col("trusted_id").isNotNull().alias("trusted")
    )
    sums = rows.mapInArrow(run, "bucket int, raw long, trusted long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")
    ).toArrow()
    n = np.zeros((2, 1 << BITS))
    at = sums["bucket"].to_numpy()
    n[0, at], n[1, at] = sums["raw"].to_numpy(), sums["trusted"].to_numpy()
    if not n[1].any():
        return np.zeros(1 << BITS)
    raw = (n[0] + ADD) / (n[0].sum() + ADD * (1 << BITS))
    trusted = (n[1] + PRIOR * raw) / (n[1].sum() + PRIOR)
    return np.log(trusted / raw)


def assess(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts of the base rules, base_failed, kept and llr of every document."""
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratio(docs, labels))

    def run(batches):
        weight = ratio.value
        for b in chunks(batches, "text"):
            texts = b.column("text").to_pylist()
            found = [rules(t) for t in texts]
            llr = [float(weight[byte_buckets(t, BITS)].mean()) if t else 0.0 for t in texts]
            failed = [f[0] < MIN_WORDS or 100 * f[4] > MOST_REPEATED_PERCENT * f[0] for f in found]
            yield batch(
                RESULT, b.column("doc_id"), *([f[k] for f in found] for k in range(5)), failed,
                [not f and x >= threshold for f, x in zip(failed, llr, strict=True)], llr
            )

    return id_and_text(docs).mapInArrow(
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"
    )


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that assess() keeps."""
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratio(docs, labels))

    def passes(text: str | None) -> bool:
        raw = (text or "").encode()
        words = raw.split()
        if len(words) < MIN_WORDS or 100 * repeated_words(words) > MOST_REPEATED_PERCENT * len(words):
            return False
        return float(ratio.value[byte_buckets(raw, BITS)].mean()) >= threshold

    def run(batches):
        for b in chunks(batches, "text"):
            yield b.filter(pa.array([passes(t) for t in texts_of(b.column("text"))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
