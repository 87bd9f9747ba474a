"""Language ID by multinomial naive Bayes over hashed character n-grams (8).

Training counts n-grams by language in one pass: each task adds up a dense array per language, and
hands them on when it holds LANGS_IN_TASK of them, so at most buckets rows a language leave a task,
whatever the languages' shares are. The log-probability matrix (languages x buckets, 256 KB a
language) is broadcast; more than MOST_LANGS languages are an error, not an endless broadcast. Texts
are scored in batches: the n-grams of all texts of a batch are the rows of one sparse matrix, each
entry takes its log-probability by language, and sums run over the rows.

Defined cases: a null text or one without a letter is `und` with score 0; so is every text if
nothing can be learnt; languages that tie go to the smaller name; a very long text is a batch by
itself and scored whole; repeated rows count as often as they come and get the same prediction each;
bytes that aren't UTF-8 become replacement characters; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.common import batch, chunks, held_out, texts_of
from tripleloom.llm.features import char_batch

BITS, SIZES, ADD, BATCH_BYTES = 15, (1, 2, 3), 0.5, 1 << 17
LANGS_IN_TASK, MOST_LANGS = 64, 1024
#: Least gain of a kept text: held-out texts of sf0.1 have 2.91 or more, texts of a language left out of training 2.73 or less but for one.
GAIN = 2.75
LETTER = re.compile(r"[^\W\d_]")
COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64())])


class LanguageModel:
    """Languages in ascending order, log prior, log probability of each bucket (a column each language)."""

    def __init__(self, langs: list[str], prior: np.ndarray, logp: np.ndarray):
        self.langs, self.prior, self.logp = langs, prior, np.ascontiguousarray(logp.T)

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: language, its posterior, how much likelier than the next one an n-gram is, and than if all buckets were alike (nats)."""
        known = np.array([bool(t) and bool(self.langs) and LETTER.search(t) is not None for t in texts], bool)
        some = [t.lower() for t, k in zip(texts, known, strict=True) if k]
        found, score, margin, gain = ["und"] * len(texts), *(np.zeros(len(texts)) for _ in range(3))
        if not some:
            return found, score, margin, gain
        total, n = np.zeros((len(some), len(self.langs))), np.zeros(len(some))
        for bucket, count in char_batch(some, BITS, SIZES):
            rows = np.flatnonzero(count)
            begin = (np.cumsum(count) - count)[rows]
            n += count
            for k, logp in enumerate(self.logp):
                if len(rows):
                    total[rows, k] += np.add.reduceat(logp[bucket], begin)
        joint = total + self.prior
        best, row = joint.argmax(1), np.arange(len(some))
        top = joint[row, best]
        score[known] = 1.0 / np.exp(joint - top[:, None]).sum(1)
        gain[known] = total[row, best] / n + BITS * np.log(2)
        if len(self.langs) > 1:
            joint[row, best] = -np.inf
            margin[known] = (top - joint.max(1)) / n
        for i, k in zip(np.flatnonzero(known).tolist(), best.tolist(), strict=True):
            found[i] = self.langs[k]
        return found, score, margin, gain


def train(docs: DataFrame) -> LanguageModel:
    """Learn from `text` and `lang` of all rows where neither is null."""

    def rows_of(counts: dict[str, np.ndarray], seen: dict[str, int]):
        for lang, n in counts.items():
            used = n.nonzero()[0]
            yield batch(COUNTS, [lang] * (len(used) + 1), [-1, *used.tolist()], [seen[lang], *n[used].tolist()])

    def run(batches):
        counts, seen = {}, {}
        for b in chunks(batches, "text", BATCH_BYTES):
            langs, texts = b.column("lang").to_pylist(), texts_of(b.column("text"))
            for lang in dict.fromkeys(langs):
                if lang not in counts:
                    if len(counts) >= LANGS_IN_TASK:
                        yield from rows_of(counts, seen)
                        counts, seen = {}, {}
                    counts[lang], seen[lang] = np.zeros(1 << BITS, np.int64), 0
                mine = [t.lower() for x, t in zip(langs, texts, strict=True) if x == lang]
                seen[lang] += len(mine)
                for bucket, _ in char_batch(mine, BITS, SIZES):
                    counts[lang] += np.bincount(bucket, minlength=1 << BITS)
        yield from rows_of(counts, seen)

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).dropna()
    sums = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).limit(MOST_LANGS + 1).toArrow()  # at most buckets + 1 a language
    if found.num_rows > MOST_LANGS:
        raise ValueError(f"language ID: more than {MOST_LANGS} languages")
    found = found.sort_by("lang")
    langs = found["lang"].to_pylist()
    n, prior = np.full((1 << BITS, len(langs)), ADD), np.ones(len(langs))
    for k, cell in enumerate(found["c"]):
        bucket, count = (cell.values.field(c).to_numpy() for c in ("bucket", "n"))
        prior[k] = count[bucket < 0][0]
        n[bucket[bucket >= 0], k] += count[bucket >= 0]
    return LanguageModel(langs, np.log(prior / max(prior.sum(), 1.0)), np.log(n) - np.log(n.sum(0)) if langs else n)


def identify(docs: DataFrame, modulus: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin of every row, learnt from the rows not held out."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs.where(~held_out(modulus))))

    def run(batches):
        for b in chunks(batches, "text", BATCH_BYTES):
            lang, score, margin, _ = model.value.judge(texts_of(b.column("text")))
            yield batch(RESULT, b.column("doc_id"), b.column("held_out"), lang, score, margin)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(modulus).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, margin double")


def keep(docs: DataFrame, least: float = 0.5, modulus: int = 5, gain: float = GAIN) -> DataFrame:
    """The rows, with all their columns, whose language identify() finds with a score of at least `least` and that read like it.

    The score compares the learned languages alone, whatever the text; `gain` asks an n-gram of the
    text, on average, to be that much likelier (nats) in the language found than a bucket at random.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs.where(~held_out(modulus))))

    def run(batches):
        for b in chunks(batches, "text", BATCH_BYTES):
            lang, score, _, fits = model.value.judge(texts_of(b.column("text")))
            yield b.filter(pa.array((np.array(lang) != "und") & (score >= least) & (fits >= gain), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
