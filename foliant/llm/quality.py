"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Tokens are runs of letters and digits (all beyond ASCII counted among them) and runs of other marks, in their own case.
Single tokens and pairs of neighbours are hashed to 2**18 places; a text's value at a place is its share of all the
text's n-grams, so long and short texts are alike. Words of new texts are often unknown, their repetition isn't: a pair
of equal tokens has one place whatever the token is, and so has a triple whose first and third tokens are equal. FTRL-proximal steps with L1 and L2 terms fit the weights; a score is
the sigmoid of a sparse dot product, over the whole text.

The fit reads at most `max_labelled` labelled rows, those with the smallest hashes of their ids, in one task; scores are
made for every row in place, without a shuffle.

Defined results: null or empty text scores by the bias alone; without usable labels every score is 0.5; labels other
than 0 and 1, null ids and null labels teach nothing; an id with several labels teaches each; an empty table gives an
empty table; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.arrays import BASE, CLASSES, mix, runs, strings, token_hashes, tokens
from foliant.llm.runtime import columns_for, released, small_batches

BITS = 18
MAX_LABELLED = 6000
THRESHOLD = 0.3
#: Rows that are filtered at once.
BATCH = 1000
#: Places of a pair of equal tokens and of a triple with equal ends.
TWICE, AGAIN = 0, 1
#: Shares are small numbers; this brings them near 1.
SCALE = 8.0


def _places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of single tokens, of pairs by their first token, firsts of triples with equal ends, and tokens before each text."""
    starts, ends, first = tokens(data, offsets, CLASSES)
    h = token_hashes(data, starts, ends)
    pairs = (mix(h[:-1] * BASE + h[1:]) >> np.uint64(64 - BITS)).astype(np.int64)
    pairs[h[:-1] == h[1:]] = TWICE
    again = np.flatnonzero((h[:-2] == h[2:]) & (h[:-2] != h[1:-1]))
    return (h >> np.uint64(64 - BITS)).astype(np.int64), pairs, again, first


def examples(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and values of each text."""
    data, offsets = strings(texts)
    for a, b in runs(offsets):
        one, two, again, first = _places(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for i in range(b - a):
            x, y = first[i], first[i + 1]
            n = np.searchsorted(again, max(x, y - 2)) - np.searchsorted(again, x)
            places, counts = np.unique(np.concatenate([one[x:y], two[x : max(x, y - 1)], np.full(n, AGAIN)]), return_counts=True)
            yield places, counts * (SCALE / max(1, 2 * (y - x) - 1))


class Ftrl:
    """FTRL-proximal for one weight vector and a bias, which is not regularised."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n, self.bias = np.zeros(size), np.zeros(size), np.zeros(2)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def intercept(self) -> float:
        return float(-self.bias[0] / ((self.beta + np.sqrt(self.bias[1])) / self.alpha))

    def step(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(places)
        b = self.intercept()
        error = 1 / (1 + np.exp(-np.clip(w @ values + b, -35, 35))) - label
        g = error * values
        root = np.sqrt(self.n[places])
        self.z[places] += g - (np.sqrt(self.n[places] + g * g) - root) / self.alpha * w
        self.n[places] += g * g
        self.bias += [error - (np.sqrt(self.bias[1] + error * error) - np.sqrt(self.bias[1])) / self.alpha * b, error * error]


def _fit(epochs: int, alpha: float, l1: float, l2: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for key, label, x in zip(batch.column("key").to_pylist(), batch.column("label").to_pylist(), examples(batch.column("text")), strict=True):
                rows.append((key, label, x))
        rows.sort(key=lambda r: (r[0], r[1], len(r[2][0])))
        model = Ftrl(1 << BITS, alpha=alpha, l1=l1, l2=l2)
        if len({label for _, label, _ in rows}) > 1:
            for _ in range(epochs):
                for _, label, (places, values) in rows:
                    model.step(places, values, label)
        w = model.weights().astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([model.intercept()])], ["weights", "bias"])

    return run


def train(labelled: DataFrame, max_labelled: int = MAX_LABELLED, epochs: int = 4, alpha: float = 0.5, l1: float = 0.05, l2: float = 0.02) -> tuple[bytes, float]:
    """Fit on (key, text, label); at most max_labelled rows are expected, all go to one task. Weights as float32, and the bias."""
    assert max_labelled <= 100_000, "the fit is made in one task"
    small_batches(labelled.sparkSession)
    found = labelled.repartition(1).mapInArrow(released(_fit(epochs, alpha, l1, l2)), "weights binary, bias double").collect()
    return (bytes(found[0].weights), found[0].bias) if found else (np.zeros(1 << BITS, np.float32).tobytes(), 0.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str, label_col: str, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(key, text, label) of at most max_labelled rows of labels with the smallest hashes of their ids."""
    small = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    small = small.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & usable)
    small = small.withColumn("key", F.xxhash64("id")).orderBy("key", "id", "label").limit(max_labelled)
    texts = docs.select(*columns_for(docs, id=id_col, text=text_col))
    return texts.join(F.broadcast(small), "id").select("key", "text", "label")  # max_labelled narrow rows


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = np.frombuffer(model.value[0], np.float32).astype(np.float64), model.value[1]
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            out = np.zeros(len(batch))
            for a, b in runs(offsets):
                one, two, again, first = _places(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                begin, end = first[:-1], first[1:]
                sums = np.concatenate([[0.0], np.cumsum(w[one])])
                pairs = np.concatenate([[0.0], np.cumsum(w[two])])
                n = end - begin
                last = np.maximum(begin, end - 1)  # a pair begins before the last token, a triple before the last two
                triples = np.searchsorted(again, np.maximum(begin, end - 2)) - np.searchsorted(again, begin)
                at = np.minimum(np.stack([begin, last]), len(two))
                z = sums[end] - sums[begin] + pairs[at[1]] - pairs[at[0]] + triples * w[AGAIN]
                out[a:b] = 1 / (1 + np.exp(-np.clip(z * SCALE / np.maximum(1, 2 * n - 1) + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out)], ["id", "score"])

    return run


def score(docs: DataFrame, model: tuple[bytes, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB
    rows = docs.select(*columns_for(docs, id=id_col, text=text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(released(_scores(sent)), f"id {kind}, score double").withColumnRenamed("id", id_col)


def fold(id_col: str, of: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % of


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[bytes, float]:
    """The model of the labels outside the held-out fold."""
    return train(labelled_sample(docs, labels, fold("id", 5) != 0, id_col, text_col, label_col))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score below the threshold, with all their columns and no shuffle."""
    sent = spark.sparkContext.broadcast(fitted(docs, labels))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scores(sent)
        for whole in batches:
            for at in range(0, len(whole), BATCH):
                batch = whole.slice(at, BATCH)
                pair = pa.RecordBatch.from_arrays([batch.column("text"), batch.column("text")], ["id", "text"])
                keep = next(scored(iter([pair]))).column("score").to_numpy() >= threshold
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(released(run), docs.schema).select(*names)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, fitted(docs, labels))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
