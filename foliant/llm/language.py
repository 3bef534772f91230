"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

A text is lower-cased and cut into words of letters; its features are the letters and the pairs and triples of
characters within a word and its bounds, hashed to 2**16 places. Values are (1 + log count) * idf, scaled to length 1.
Document frequencies count every learnable document: each task sums its own, the sums of 64 ranges of places are added
up side by side, and the result has a fixed size. Weights are fitted by follow-the-regularised-leader steps with L1 and
L2 (elastic-net) terms on a bounded sample: `sample` rows at most in expectation, shared evenly among the languages and
chosen by hash; a fifth of it is kept from the fit and sets the temperature by which logits are divided.

Defined results: `und` and score 0 for null text, text without a letter, or when there is nothing to learn from;
every language is learned, and a table with more than `max_languages` is refused (ValueError) rather than read in part;
equal scores go to the first language in code point order; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.runtime import columns_for, released, small_batches

BITS = 16
SIZE = 1 << BITS
PARTS = 64
SAMPLE = 8000
MAX_LANGUAGES = 1000
RUN_CHARS = 1 << 20
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: is it a letter (Unicode category L, or a mark after one)?"""
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def _hash(*chars: np.ndarray) -> np.ndarray:
    h = np.full(len(chars[0]), len(chars), np.uint64)
    for c in chars:
        h = (h + c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)


def _run(texts: list[str | None]) -> Iterator[np.ndarray]:
    joined = "\n" + "\n".join((t or "").lower().replace("\n", " ") for t in texts) + "\n"
    chars = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    letter = letters()[chars]
    doc = np.cumsum(chars == 10) - 1
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    c = np.where(letter, chars, 0)[keep].astype(np.uint64)  # one 0 before and after each word
    doc, full = doc[keep], letter[keep]
    one = np.flatnonzero(full)
    pair = np.flatnonzero(full[:-1] | full[1:])
    triple = np.flatnonzero(full[1:-1] & (full[:-2] | full[2:])) if len(full) > 2 else np.zeros(0, np.int64)
    parts = []
    for owner, places in ((one, _hash(c[one])), (np.where(full[pair], pair, pair + 1), _hash(c[pair], c[pair + 1])), (triple + 1, _hash(c[triple], c[triple + 1], c[triple + 2]))):
        parts.append((np.searchsorted(doc[owner], np.arange(len(texts) + 1)), places))
    for i in range(len(texts)):
        yield np.concatenate([places[at[i] : at[i + 1]] for at, places in parts])


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and counts of each text; none for a text without letters."""
    texts = column.to_pylist()
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or "") <= RUN_CHARS):
            size += len(texts[last] or "")
            last += 1
        for places in _run(texts[first:last]):
            if len(places) < 2000:
                yield np.unique(places, return_counts=True)
            else:
                counts = np.bincount(places, minlength=SIZE)
                found = np.flatnonzero(counts)
                yield found, counts[found]
        first = last


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(SIZE, np.int64), 0
    for batch in batches:
        for places, _ in features(batch.column("text")):
            df[places] += 1
            n += 1
    if n:
        parts = [p.tobytes() for p in np.split(df, PARTS)] + [np.array([n]).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS + 1), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.int64) for x in frame["counts"])
    return pd.DataFrame({"part": frame["part"].iloc[:1], "counts": [total.tobytes()]})


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log((n + 1) / (df + 1)) + 1 by place, over every row of docs (text)."""
    sums = docs.select("text").mapInArrow(released(_frequencies), "part int, counts binary").groupBy("part").applyInPandas(_added, "part int, counts binary").collect()
    by = {x.part: np.frombuffer(x.counts, np.int64) for x in sums}  # PARTS + 1 rows
    if not by:
        return np.ones(SIZE, np.float32)
    return (np.log((by[PARTS][0] + 1) / (np.concatenate([by[i] for i in range(PARTS)]) + 1)) + 1).astype(np.float32)


def _vector(places: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf[places]
    return v / max(1e-12, np.sqrt(v @ v))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """FTRL-proximal with elastic net, one column of weights for each class, and biases that are not regularised."""

    def __init__(self, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n, self.bias = np.zeros((SIZE, classes), np.float32), np.zeros((SIZE, classes), np.float32), np.zeros((2, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2), 0)

    def intercepts(self) -> np.ndarray:
        return -self.bias[0] / ((self.beta + np.sqrt(self.bias[1])) / self.alpha)

    def step(self, places: np.ndarray, v: np.ndarray, label: int) -> None:
        w, b = self.weights(places), self.intercepts()
        error = softmax(v @ w + b)
        error[label] -= 1
        g = v[:, None] * error
        n = self.n[places]
        self.z[places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[places] = n + g * g
        self.bias[0] += error - (np.sqrt(self.bias[1] + error**2) - np.sqrt(self.bias[1])) / self.alpha * b
        self.bias[1] += error**2


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """What logits are to be divided by for the least log loss; by golden section over its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(1e-12, softmax(logits / np.exp(t))[np.arange(len(labels)), labels])).mean()
    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _fit(languages: list[str], idf, epochs: int, alpha: float, beta: float, l1: float, l2: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for key, lang, (places, counts) in zip(batch.column("key").to_pylist(), batch.column("lang").to_pylist(), features(batch.column("text")), strict=True):
                if len(places):
                    rows.append((key, languages.index(lang), places.astype(np.int32), _vector(places, counts, idf.value)))
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        model = Ftrl(len(languages), alpha, beta, l1, l2)
        for _ in range(epochs):
            for key, label, places, v in rows:
                if key % 5:
                    model.step(places, v, label)
        w, b = model.weights(), model.intercepts()
        held = [r for r in rows if not r[0] % 5]
        t = temperature(np.array([r[3] @ w[r[2]] + b for r in held]), np.array([r[1] for r in held]))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary()), pa.array([t])], ["weights", "bias", "temperature"])

    return run


def train(rows: DataFrame, sample: int = SAMPLE, max_languages: int = MAX_LANGUAGES, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.001, l2: float = 0.0001) -> dict:
    """Fit on (id, text, lang), all of which may be learned from: idf from every row, weights from the sample."""
    small_batches(rows.sparkSession)
    rows = rows.filter(F.col("lang").isNotNull())
    counts = rows.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages: none is left out, so raise max_languages, for which a worker needs 1 MB each")
    languages = sorted(x.lang for x in counts)
    if not languages:
        return {"languages": []}
    each = max(1, sample // len(languages))
    share = F.broadcast(rows.sparkSession.createDataFrame([(x.lang, min(1 << 20, each * (1 << 20) // x["count"] + 1)) for x in counts], "lang string, below long"))
    idf = rows.sparkSession.sparkContext.broadcast(inverse_frequencies(rows))
    chosen = rows.withColumn("key", F.xxhash64("id")).join(share, "lang").filter(F.pmod(F.shiftright("key", 20), F.lit(1 << 20)) < F.col("below"))
    fit = chosen.select("key", "lang", "text").repartition(1).mapInArrow(released(_fit(languages, idf, epochs, alpha, beta, l1, l2)), "weights binary, bias binary, temperature double").collect()[0]
    return {"languages": languages, "idf": idf.value, "weights": np.frombuffer(fit.weights, np.float32).reshape(SIZE, -1), "bias": np.frombuffer(fit.bias, np.float64), "temperature": fit.temperature}


def _predict(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = model["languages"]
        for batch in batches:
            lang, score = [], []
            for places, counts in features(batch.column("text")):
                if len(places) and names:
                    p = softmax((_vector(places, counts, model["idf"]) @ model["weights"][places] + model["bias"]) / model["temperature"])
                    best = int(p.argmax())
                    lang.append(names[best])
                    score.append(float(p[best]))
                else:
                    lang.append("und")
                    score.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**16 floats for each of max_languages at most
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(*columns_for(docs, id=id_col, text=text_col))
    return rows.mapInArrow(released(_predict(sent)), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def fold(column: str) -> Column:
    return F.crc32(F.col(column).cast("string")) % 4


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = docs.select(*columns_for(docs, id="doc_id", text="text", lang="lang")).filter(fold("id") != 2)
    return predict(docs, train(known)).select("doc_id", F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
