"""Operator 5: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes, modulo 2**BITS, of its words (A-Z in lower case, punctuation
parts words), its pairs of neighbours and its pairs one word apart.  Training is follow-the-regularised-
leader with per-coordinate rates; the L1 term leaves few weights, which are broadcast as pairs of index
and weight.  Scoring reads whole texts: the distinct features with a weight add up.

Fitting takes a bounded sample: SAMPLE_ROWS labelled ids, picked by a hash, one text of each, and of these in
the order of that hash as many as have SAMPLE_BYTES of features (4 bytes each) together.

Defined results: a null or empty text gets the score of no features (the bias).  Labels that are null
are not learnt from; of several labels of one id the greatest counts; of several texts of one id that with the least hash is
learnt from.  Without labelled rows every score is 0.  A null doc_id is not held out, is scored and isn't learnt from.
A text of any length is read whole, at about 100 bytes of memory a byte.  Rows are handled one by one; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import M1, PUNCTUATION, held_out, mixed, slices, small_batches, text_bytes, text_column, trimmed, word_hashes

#: Bounds of what is fitted on: labelled ids, and bytes of their features.
SAMPLE_ROWS = 16_000
SAMPLE_BYTES = 160_000_000
BITS = 21
EPOCHS = 4
THRESHOLD = 0.3
#: Rates and penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.0


def features(at: np.ndarray, raw: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, pairs and pairs one apart, repeats too, and their texts' indices."""
    h, text = word_hashes(at, raw, PUNCTUATION)
    out, texts = [h], [text]
    for gap in (1, 2):
        n = max(0, len(h) - gap)
        same = text[:n] == text[gap:]
        out.append(mixed(h[:n] * M1 + h[gap:] + np.uint64(gap))[same])
        texts.append(text[:n][same])
    return (np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(texts)


class Model:
    """Sparse weights: sorted indices, their weights, and the bias."""

    def __init__(self, index: np.ndarray, weight: np.ndarray, bias: float, bits: int = BITS):
        self.index, self.weight, self.bias, self.bits = index, weight, bias, bits
        self._dense = None

    def __getstate__(self):
        return self.__dict__ | {"_dense": None}

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self._dense is None:
            self._dense = np.zeros(1 << self.bits, np.int32)
            self._dense[self.index] = np.arange(1, len(self.index) + 1)
        f, text = features(*text_bytes(texts), self.bits)
        which = self._dense[f]
        hit = which > 0
        pairs = np.unique(text[hit] * (len(self.index) + 1) + which[hit])
        sums = np.bincount(pairs // (len(self.index) + 1), self.weight[pairs % (len(self.index) + 1) - 1], minlength=len(texts)) if len(pairs) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -35, 35)))


def trained(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over (distinct feature indices, label) rows, in the given order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0  # of the bias, which has no L1 term
    if not rows:
        return Model(np.zeros(0, np.int64), np.zeros(0), -np.inf, bits)

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        w[np.abs(zi) <= L1] = 0
        return w

    for _ in range(epochs):
        for index, label in rows:
            w = weights(index)
            wb = -zb / ((BETA + nb**0.5) / ALPHA + L2)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35)))
            g = p - label
            more = np.sqrt(n[index] + g * g)
            z[index] += g - (more - np.sqrt(n[index])) / ALPHA * w
            n[index] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * wb
            nb += g * g
    index = np.flatnonzero(np.abs(z) > L1)
    return Model(index, weights(index), float(-zb / ((BETA + nb**0.5) / ALPHA + L2)), bits)


def fitted(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Model of labelled documents that aren't held out."""
    small_batches(docs.sparkSession)
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    n = usable.count()
    if n > rows:  # a slice of the hash's range that holds about the bound, then the bound itself
        usable = usable.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.1 * rows / n)))
    picked = usable.orderBy(F.xxhash64("k"), "k").limit(rows)
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(picked), "k")
    own = own.groupBy("k").agg(F.max("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select(F.col("k").cast("string"), F.col("y").cast("int"), "t.text")

    def run(batches):
        for part in slices(batches, "text"):
            f, of = features(*text_bytes(part.column("text")))
            order = np.argsort(of, kind="stable")
            f = f[order]
            ends = np.cumsum(np.bincount(of, minlength=part.num_rows))
            found = [np.unique(f[a:b]).astype("<i4").tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("k"), part.column("y"), pa.array(found, pa.binary())], ["k", "y", "f"])

    def train(batches):
        learnt, held = [], 0
        for batch in batches:
            at, raw = text_bytes(batch.column("f"))
            for i, y in enumerate(batch.column("y").to_pylist()):
                held += int(at[i + 1] - at[i])
                if held <= size:
                    learnt.append((raw[at[i] : at[i + 1]].view("<i4").copy(), int(y > 0)))
        model = trained(learnt)
        del learnt
        trimmed()
        yield pa.RecordBatch.from_arrays([pa.array([model.index.astype("<i8").tobytes()]), pa.array([model.weight.tobytes()]), pa.array([float(model.bias)])], ["i", "w", "bias"])

    # the sample is bounded, and one task trains on it: only sparse weights reach the driver
    made = own.mapInArrow(run, "k string, y int, f binary").repartition(1).sortWithinPartitions(F.crc32("k"), "k")
    best = made.mapInArrow(train, "i binary, w binary, bias double").first()
    if best is None:
        return trained([])
    return Model(np.frombuffer(best.i, "<i8").copy(), np.frombuffer(best.w, np.float64).copy(), best.bias)


def scored(spark: SparkSession, model: Model, column: str = "text"):
    """The score of a text column; only the texts go to Python."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        own = shared.value
        return pa.array(own.scores(texts) if np.isfinite(own.bias) else np.zeros(len(texts)))

    return text_column(run, "double")(F.col(column))


def score(docs: DataFrame, model: Model, column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs' columns, with score and predicted; columns of these names are replaced."""
    return docs.withColumn("score", scored(docs.sparkSession, model, column)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), _model(spark, docs, sf_dir)).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents without those predicted toxic."""
    return docs.where(scored(spark, _model(spark, docs, sf_dir)) < THRESHOLD)
