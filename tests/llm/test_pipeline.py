"""The pipeline on a small corpus, each stage against a brute-force version of it."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as cp
from foliant.llm import pieces, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    pool = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("n", "rt", "v", "st", "lk", "mb", "d")]
    text = lambda n: " ".join(rng.choice(pool, n))
    passage = text(60)
    rows = []
    for i in range(260):
        body = "\n".join(text(int(rng.integers(8, 40))) for _ in range(int(rng.integers(1, 5))))
        if i % 9 == 1:
            body += "\n" + passage
        if i % 13 == 2 and rows:
            body = rows[-1][1]  # a copy
        if i % 11 == 3 and rows:
            words = rows[-1][1].split(" ")
            words[len(words) // 2] = "edited"
            body = " ".join(words)  # a near copy
        if i % 8 == 5:
            body = " ".join([f"{w}!!" for w in text(3).split()] * 20)  # junk
        rows.append((i, body, "en", None if i % 17 == 0 else f"s{i % 4}", len(body)))
    rows += [(900, None, None, "s1", None), (901, "", "en", "s1", 0), (902, "only", "en", "s2", 4)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i % 8 != 5), 0) for i in range(0, 260, 2)] + [(i, 0, 0) for i in range(5, 260, 8)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_quality_stage(spark, corpus):
    d, rows = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    weights, bias = quality.fitted(docs, spark.read.parquet(f"{d}/labels.parquet"))
    w = np.frombuffer(weights, np.float32).astype(float)
    scores = [1 / (1 + np.exp(-(w[p] @ v + bias))) for p, v in quality.examples(pa.array([t for _, t, *_ in rows], pa.string()))]
    want = {r[0]: r[1] for r, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD}
    got = cp.keep_quality(spark, docs, d)
    assert rows_of(got) == want and got.columns == cp.COLUMNS
    junk = [i for i in range(260) if i % 8 == 5]
    assert sum(i in want for i in junk) < len(junk) / 3 and sum(i in want for i in range(260) if i not in junk) > 200


def brute_lines(rows, least=50):
    first, gone = {}, defaultdict(set)
    for i, t in sorted(rows.items()):
        lines = (t or "").split("\n") if t is not None else []
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(WORD.findall(lines[b]))
                if n >= least:
                    at = first.setdefault(tuple(lines[a : b + 1]), (i, a, b))
                    if at != (i, a, b) and not (at[0] == i and a <= at[2]):
                        gone[i].update(range(a, b + 1))
    out = {}
    for i, t in rows.items():
        clean = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        if not (gone[i] and not WORD.search(clean)):
            out[i] = clean
    return out


def brute_near(rows):
    def shingles(t):
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    ids = sorted(rows)
    sets, root = {i: shingles(rows[i]) for i in ids}, {i: i for i in ids}
    for i in ids:
        for j in ids:
            both = len(sets[i] & sets[j]) if j < i else 0
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return {i: rows[i] for i in ids if root[i] == i}


def test_all_stages_together(spark, corpus):
    """run() equals the stages by brute force; the mixture is checked by what must hold of it."""
    d, rows = corpus
    first = rows_of(cp.keep_quality(spark, spark.read.parquet(f"{d}/documents.parquet"), d))
    second = brute_lines(first)
    third = brute_near(second)
    assert len(second) < len(first) and len(third) < len(second)
    out = cp.run(spark, d).collect()
    encoder = pieces.Encoder(open(pieces.MODEL, "rb").read())
    for r in out:
        assert encoder.decode([r.pieces]) == [third[r.doc_id]] and (r.n_pieces is None) == (third[r.doc_id] is None) and r.lossless
    again = Counter(r.doc_id for r in out)
    assert len({(r.doc_id, r.pieces) for r in out if third[r.doc_id] and len(third[r.doc_id]) > 200}) == sum(again[i] for i in again if third[i] and len(third[i]) > 200)
    source = {i: s for i, _, _, s, _ in rows}
    size = {i: len(WORD.findall(t or "")) for i, t in third.items()}
    copies, by = Counter(r.doc_id for r in out), Counter()
    for i, n in size.items():
        by[source[i]] += n
    assert max(copies.values()) <= 2
    total = sum(copies[i] * n for i, n in size.items())
    assert abs(total - 1.5 * sum(by.values())) <= 60 * len(by)


def test_stage_names_and_edges(spark, corpus):
    d, _ = corpus
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    assert len(cp.STAGES) in (4, 5)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, d).collect() == []


def test_stages_with_clashing_columns_and_repeated_ids(spark, corpus):
    """Extra columns with names that operators use inside, rows that repeat an id, and null ids change nothing else."""
    from pyspark.sql import functions as F

    d, rows = corpus
    some = [r for r in rows if r[0] < 60]
    docs = spark.createDataFrame([*some, some[4], some[4], (None, "no id", "en", None, 5)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("extra") for c in ("id", "_id", "th", "_th", "key", "pieces", "size", "_size", "blocks", "row", "_row", "shard", "cls", "_gone", "label", "score")})
    for name, stage in cp.STAGES:
        out = stage(spark, docs, d)
        got = Counter(r.doc_id for r in out.collect())
        assert set(got) <= {r[0] for r in some} | {None} and (name == "pieces" or out.columns == cp.COLUMNS)
        if name in ("line dedup", "pieces"):
            assert got[None] == 1 and (name == "line dedup" or got[some[4][0]] == 3)
