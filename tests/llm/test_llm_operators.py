"""Each operator on cases with a defined result: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliant.llm import chat, exact_dedup, fingerprints, language, licences, line_dedup, mixing, near_dedup, pieces, quality
from foliant.llm.near_dedup import signatures, stars

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (1, A, "x"), (2, A.upper(), "y"), (3, None, None), (4, "", "x"), (5, "Ä b", "y"), (6, "ä b", "y"), (7, A + " thirteen", "x"),
    (8, "word " * 3000, "z"), (9, "tiny", None), (9, "tiny", None), (None, "nobody's", "x"), (10, " \n\t ", "z"),
]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """Also with columns whose names the operators use inside."""
    extra = dict.fromkeys(["id", "token", "sha", "size", "key", "a", "b", "block", "n", "cls", "lines", "label"], F.lit("extra"))
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(extra)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, none):
    out = exact_dedup.find_copies(docs).collect()
    assert len(out) == len(ROWS)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert (by[1][0].keep_id, by[1][0].group_size, by[1][0].kept) == (2, 2, False)
    assert by[2][0].kept and by[2][0].text_sha256 == hashlib.sha256(A.encode()).hexdigest()
    assert (by[3][0].keep_id, by[4][0].kept) == (4, True)
    assert by[5][0].kept and by[6][0].kept  # only A-Z are folded
    assert sorted(r.kept for r in by[9]) == [False, True]
    assert by[None][0].kept
    assert exact_dedup.find_copies(none).collect() == []


def test_exact_dedup_with_a_full_filter(spark):
    """A filter that is much too small makes rows shuffle, and changes nothing."""
    rows = [(i, f"text {i % 900}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small, large = (sorted(exact_dedup.find_copies(df, filter_bytes=n).drop("possible").collect()) for n in (0, 1 << 20))
    assert small == large and sum(r.kept for r in small) == 900


def test_exact_dedup_in_ranges(spark):
    """More documents than the filter has room for: range by range, with the same results."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 17_000).cast("string")).alias("text"))
    small, large = (sorted(exact_dedup.find_copies(df, filter_bytes=n).drop("possible").collect()) for n in (0, 1 << 20))
    assert small == large and sum(r.kept for r in small) == 17_000
    few = exact_dedup.find_copies(df, filter_bytes=0).filter("possible").count()
    assert few < 16_000  # the rest passed straight through


def test_exact_dedup_drops_copies(docs):
    """Beside a column whose name the operator would use."""
    df = docs.filter("doc_id in (1, 2, 3, 5)").withColumn("_gone", F.lit("x"))
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(df).collect()) == [2, 3, 5]
    assert sorted(r.doc_id for r in near_dedup.keep_first(df).collect()) == [1, 3, 5]


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_near_dedup(docs, none):
    out = near_dedup.near_duplicates(docs).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(ROWS)
    assert (by[1].component_id, by[2].component_id, by[7].component_id) == (1, 1, 1)  # 8 of 9 shingles shared
    assert by[3].component_id == 3 and by[4].component_id == 4 and by[10].component_id == 10 and by[10].n_shingles == 0
    assert by[5].component_id == by[5].doc_id and by[9].n_shingles == 1 and by[8].n_shingles == 1
    assert Counter(r.kept for r in out if r.doc_id == 9) == {True: 1, False: 1}
    assert near_dedup.near_duplicates(none).collect() == []


def test_near_dedup_chains_against_brute_force(spark):
    """Chains of edits whose ends are unlike, around the threshold, with copies."""
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        words = [f"w{g}x{i}" for i in range(int(rng.integers(20, 200)))]
        for _ in range(25):
            words = list(words)
            for _ in range(max(1, len(words) // 40)):
                words[int(rng.integers(len(words)))] = f"r{rng.integers(1 << 30)}"
            rows += [(len(rows), " ".join(words))] * int(rng.integers(1, 3))
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in out} == {i: (root[i], len(sets[i])) for i in range(len(rows))}


def test_near_dedup_takes_buckets_by_whole_keys(spark):
    """Tags of an earlier band that agree by chance don't hide a pair from the bucket that both are in."""
    tags = bytes(range(256))
    bands = np.arange(2 * near_dedup.BANDS).reshape(2, -1) + 100
    bands[:, 3] = 7
    nodes = [(bytes([k]), 100, 100, tags, bands[k].tolist()) for k in (0, 1)]
    nodes = spark.createDataFrame(nodes, "cls binary, n long, s long, tags binary, bands array<long>")
    members = spark.createDataFrame([(7, 3, bytes([k])) for k in (0, 1)], "key long, band int, cls binary")
    none = spark.createDataFrame([], "cls binary, root binary")
    sets = spark.createDataFrame([(bytes([k]), np.arange(100, dtype=np.uint64).tobytes()) for k in (0, 1)], "cls binary, items binary")
    for found in (near_dedup.proposals(members, none, nodes, 0.6, 75), near_dedup.remaining(members, none, nodes, sets, 0.6, 75)):
        assert [(bytes(r.a), bytes(r.b)) for r in found.collect()] == [(b"\0", b"\1")]


def test_near_dedup_writes_no_pairs(spark):
    """Many texts that all resemble each other below the threshold, and copies of some: links are fewer than classes."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.choice(120, 5, replace=False):
            words[k] = f"x{i}y{k}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, t + " tail") for i, t in rows[:20]]
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == root


def test_shared_items_are_counted_over_batches():
    """Shingles shared within a batch and between batches count once for each class."""
    import pyarrow as pa

    sets = {1: [10, 11, 12], 2: [10, 13], 3: [10, 11], 4: [14, 12], 5: [15]}
    batch = lambda ids: pa.RecordBatch.from_arrays([pa.array(ids), pa.array([(np.array(sets[i], np.uint64) << np.uint64(32)).tobytes() for i in ids], pa.binary())], ["cid", "items"])
    out = list(near_dedup._dealt(3)(iter([batch([1, 2]), batch([3, 4]), batch([5])])))
    got = Counter()
    rows = [(p, x) for b in out for p, x in zip(b.column("part").to_pylist(), b.column("packed").to_pylist())]
    for part in range(3):
        mine = pa.table({"packed": pa.array([x for p, x in rows if p == part], pa.binary())})
        got.update({r["cid"]: r["s"] for r in near_dedup._shared_items(mine).to_pylist()})
    for b in near_dedup._counted(iter([pa.RecordBatch.from_arrays([pa.array([x for p, x in rows if p < 0], pa.binary())], ["packed"])])):
        got.update({r["cid"]: r["s"] for r in b.to_pylist()})
    want = {i: sum(any(x in sets[j] for j in sets if j != i) for x in s) for i, s in sets.items()}
    assert {i: got[i] for i in sets} == want


def test_superminhash_estimates():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sets = [np.unique(pool[:n]) for n in (1, 5, 400, 500, 3000)]
    s = signatures(sets)
    assert (s != np.iinfo(np.uint64).max).all()
    assert abs((s[2] == s[3]).mean() - 0.8) < 0.1
    assert (signatures([sets[3]])[0] == s[3]).all()


def test_components_between_tasks(spark):
    """Paths and stars that are dealt over many tasks."""
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(7, 7)]
    df = spark.createDataFrame([(b"%04d" % a, b"%04d" % b) for a, b in edges], "a binary, b binary").repartition(8).filter("a <> b")
    out = {bytes(r.cls): bytes(r.root) for r in stars(df, per_task=10).collect()}
    assert all(out[b"%04d" % i] == b"0000" for i in range(1, 61)) and all(out[b"%04d" % i] == b"0100" for i in range(101, 180))


def test_quality(spark, docs, none):
    good = [(i, " ".join(f"word{(i * 7 + k) % 50}" for k in range(30)), 1) for i in range(120)]
    bad = [(1000 + i, " ".join([f"w{i}!!"] * 30), 0) for i in range(120)]
    texts = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(5, None), (None, 1), (7, 3)], "doc_id long, quality int")
    model = quality.fitted(texts, labels)
    out = {r.doc_id: r.score for r in quality.score(texts, model).collect()}
    assert all(out[i] > 0.5 for i, _, _ in good) and all(out[i] < 0.5 for i, _, _ in bad)
    scores = [r.score for r in quality.score(docs, model).collect()]
    assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
    assert quality.score(none, model).collect() == []
    assert quality.keep_good(spark, none, labels.limit(0)).collect() == []


def test_quality_scores_are_dot_products():
    import pyarrow as pa

    texts = pa.array(["a b a b!! a", "", None, "x", "x x", "Ä ä ..."])
    w = np.random.default_rng(0).normal(size=1 << quality.BITS).astype(np.float32)

    class Sent:
        value = (w.tobytes(), 0.25)

    got = next(quality._scores(Sent)(iter([pa.RecordBatch.from_arrays([texts, texts], ["id", "text"])]))).column("score").to_numpy()
    want = [1 / (1 + np.exp(-(w[p].astype(float) @ v + 0.25))) for p, v in quality.examples(texts)]
    assert np.allclose(got, want)


def test_language(spark, docs, none):
    words = {"en": "the and of to in that with house", "de": "der und die das nicht mit haus straße", "fr": "le la les des une est avec maison été"}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 12)), lang) for i in range(60) for lang in words] + [(1, None, "en"), (2, "123", "de"), (3, "the", None)]
    model = language.train(spark.createDataFrame(rows, "id long, text string, lang string"))
    test = spark.createDataFrame([(1, "DER HAUS NICHT"), (2, "est été"), (3, None), (4, "12 ..."), (5, ""), (6, "the house " * 20000)], "doc_id long, text string")
    out = {r.doc_id: r for r in language.predict(test, model).collect()}
    assert [out[i].lang_pred for i in range(1, 7)] == ["de", "fr", "und", "und", "und", "en"] and 0 < out[1].score <= 1 and out[3].score == 0
    assert len(language.predict(docs, model).collect()) == len(ROWS)
    assert language.predict(none, language.train(none.selectExpr("doc_id AS id", "text", "source AS lang"))).collect() == []
    nothing = language.predict(test, language.train(none.selectExpr("doc_id AS id", "text", "source AS lang"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_temperature():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 4000)
    logits = np.eye(3)[labels] + rng.normal(size=(4000, 3)) * 0.5
    assert abs(language.temperature(logits * 5, labels) / language.temperature(logits, labels) - 5) < 0.1


def test_licences(spark, docs, none):
    rows = [(1, "Title\nReleased under the MIT License.\nend"), (2, "released UNDER the mit licence license"), (3, None), (4, ""), (5, "All rights reserved."), (6, "nothing here"), (7, "x\n" * 5000)]
    out = {r.doc_id: r.found for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(f.line, f.licence, f.similarity) for f in out[1]] == [(1, "MIT", 1.0)]
    assert out[3] == out[4] == out[6] == out[7] == [] and out[5][0].licence == "reserved"
    assert len(licences.scan(docs).collect()) == len(ROWS) and licences.scan(none).collect() == []


def test_licences_over_several_lines(spark):
    """Wrapped headers within a longer file, notices within a longer line, and whole licence texts."""
    wrap = lambda text, n: ["# " + " ".join(w) for w in (text.split()[i : i + n] for i in range(0, len(text.split()), n))]
    header = wrap(licences.TEMPLATES["GPL-3.0 (header)"], 7)
    body = [f"alpha{i} beta{i} gamma{i}" for i in range(200)]
    mit = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + "\n".join(wrap(licences.TEMPLATES["MIT (full)"], 9))
    texts = ["\n".join([*body[:3], "", *header, *body]), "a b c d e f g h i j k l, released under the MIT License. m n o p q r s t u v w", mit + "\n" + "\n".join(body), licences.TEMPLATES["GPL-3 (full)"], "\n".join(body)]
    out = {r.doc_id: {(f.line, f.licence): f.similarity for f in r.found} for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out[0] == {(4, "GPL-3.0 (header)"): 1.0} and out[1] == {(0, "MIT"): 1.0} and out[4] == {}
    assert out[2] == {(4, "MIT (full)"): 1.0} and out[3][-1, "GPL-3 (full)"] == 1.0


def test_licence_similarity_is_dice(spark):
    """Every unit and template by brute force, at a low threshold."""
    texts = ["licensed under the apache license version 2", "this work is licensed under the gnu general public license version 3 or later", "permission is granted", "all rights are reserved", "all rights reserved all rights reserved"]

    def grams(t):
        w = licences.normal_words(t)
        return set(zip(w, w[1:])) or {tuple(w)}

    for i, r in enumerate(licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), threshold=0.4).orderBy("doc_id").collect()):
        best = min((-2 * len(grams(texts[i]) & grams(t)) / (len(grams(texts[i])) + len(grams(t))), name) for name, t in licences.TEMPLATES.items())
        assert [(-f.similarity, f.licence) for f in r.found] == ([(pytest.approx(best[0]), best[1])] if best[0] <= -0.4 else [])


def brute_lines(rows, min_words):
    """Later copies of every run with min_words, by looking at all runs."""
    first, gone = {}, defaultdict(set)
    for i, t in sorted(rows):
        lines = t.split("\n")
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(WORD.findall(lines[b]))
                if n >= min_words:
                    at = first.setdefault(tuple(lines[a : b + 1]), (i, a, b))
                    if at != (i, a, b) and not (at[0] == i and a <= at[2]):
                        gone[i].update(range(a, b + 1))
    return {i: sorted(gone[i]) for i, _ in rows}


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(5)
    lines = [" ".join(f"l{k}" for _ in range(k % 7)) for k in range(12)]
    rows = [(i, "\n".join(rng.choice(lines, int(rng.integers(1, 30))))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (1, 8, 20):
        out = {r.doc_id: r.deleted for r in line_dedup.dedup_lines(df, min_words=least, marks=True).collect()}
        assert out == brute_lines(rows, least)


def test_line_dedup_with_one_line_everywhere(spark):
    """A line that fills a third of the table and is followed by many others: its followers are ranked in ranges."""
    rng = np.random.default_rng(6)
    lines = [f"follower {k}" for k in range(40)]
    rows = []
    for i in range(80):
        out = []
        for _ in range(12):
            out += ["the common line of all"] * int(rng.integers(1, 3)) + [lines[int(rng.integers(40))]]
        rows.append((i, "\n".join(out)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("extra") for c in ("_id", "_th", "_deleted", "__id")})
    out = line_dedup.dedup_lines(df, min_words=14, marks=True).collect()
    assert {r.doc_id: r.deleted for r in out} == brute_lines(rows, 14) and out[0]["_id"] == "extra"
    assert sum(map(len, (r.deleted for r in out))) > 100


def test_line_dedup_cases(docs, none):
    out = line_dedup.dedup_lines(docs, min_words=2).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(ROWS) and set(docs.columns) == set(out[0].asDict())
    assert by[3].text is None and by[4].text == "" and by[1].text == A and by[9].text == "tiny"
    assert line_dedup.dedup_lines(none).collect() == []


def test_line_dedup_joins_round_by_round(spark):
    """Runs of 1 to 18 lines, named in five rounds: the plan over all rounds holds no round's joins and broadcasts."""
    rows, k = [], 0
    for n in (1, 2, 3, 4, 7, 8, 9, 16, 18):
        run = [" ".join(["w"] * (18 // n + (i < 18 % n)) + [f"{n}/{i}"]) if i else f"{'w ' * (18 // n + 1)}{n}" for i in range(n)]
        for _ in range(2):
            rows.append((k, "\n".join([f"before {k}", *run, f"after {k}"])))
            k += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.repeated_lines(df, min_words=18)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    deleted = {r.id: sorted(r.deleted) for r in found.collect()}
    assert deleted == {i: gone for i, gone in brute_lines(rows, 18).items() if gone} and {len(x) for x in deleted.values()} == {1, 2, 3, 4, 7, 8, 9, 16, 18}


def test_line_dedup_null_ids_come_first(spark):
    run = "\n".join(f"line {k} of the run" for k in range(5))
    df = spark.createDataFrame([(None, run), (0, run), (1, f"head\n{run}")], "doc_id long, text string")
    out = {r.doc_id: r.deleted for r in line_dedup.dedup_lines(df, min_words=10, marks=True).collect()}
    assert out == {None: [], 0: [0, 1, 2, 3, 4], 1: [1, 2, 3, 4, 5]}


def test_mixing(spark, docs, none):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(0, 40)), f"s{min(9, int(rng.exponential(3)))}") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    size, words = Counter(), {}
    for i, t, s in rows:
        words[i] = len(t.split())
        size[s] += words[i]
    # targets by the rule, step by step
    target, total, open_ = {}, 1.5 * sum(size.values()), dict(zip(sorted(size), [3, 1, 2] * 4))
    while True:
        level = (total - sum(target.values())) / sum(open_.values())
        full = [s for s in open_ if level * open_[s] > 2 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
            del open_[s]
    target |= {s: level * w for s, w in open_.items()}
    mixed = mixing.mix(df, shards=8, per_shard=16)
    taken, shards = Counter(), Counter()
    for r in mixed.collect():
        taken[r.source] += words[r.doc_id]
        shards[r.shard] += words[r.doc_id]
    assert all(abs(taken[s] - target[s]) <= max(40, 0.01 * target[s]) for s in size)
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2 and len(shards) == 8
    again = mixing.mix(df.repartition(7), shards=8, per_shard=16)
    key = lambda d: sorted((r.doc_id, r.shard, r.draw) for r in d.collect())
    assert key(mixed) == key(again)
    assert set(mixing.mix(docs).columns) == {*docs.columns, "shard", "draw"}
    clash = df.withColumns({c: F.lit(-7) for c in ("blocks", "_size", "_source", "_rank", "_row", "_draws", "whole", "shard")})
    assert key(mixing.mix(clash, shards=8, per_shard=16)) == key(mixed) and {r["_size"] for r in mixing.mix(clash).collect()} == {-7}
    assert mixing.mix(none).collect() == []


def test_op5_query(spark, tmp_path):
    """The contract: one row per row, targets by the rule, words taken near them and at most twice; reruns agree."""
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.integers(0, 30)), [None, "b", "a", "c"][min(3, int(rng.exponential(1)))]) for i in range(900)]
    rows += [(0, *rows[0][1:]), (None, "x y z", "a"), (5000, None, "a"), (5001, "", None)]
    spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("extra")).write.parquet(f"{tmp_path}/documents.parquet")
    out = mixing.op5_source_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(str, out)) == sorted(map(str, mixing.op5_source_mixing(spark, str(tmp_path)).collect()))
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    total, weight = Counter(), {"a": 3, "b": 1, "c": 2, None: 3}
    for _, t, s in rows:
        total[s] += len((t or "").split())
    target, left, open_ = {}, 1.5 * sum(total.values()), dict(weight)
    while full := [s for s in open_ if left * open_[s] / sum(open_.values()) > 2 * total[s]]:
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
            del open_[s]
    target |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    by = {total[s]: s for s in total}
    taken = Counter()
    for r in out:
        s = by[r.source_size]
        assert r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 30 for s in total)


def test_pieces(spark, docs, none):
    import sentencepiece

    texts = ["Hello  world\n", "", " ", None, "▁x ▁", "日本 éa\u0000b", "a" * 5000, "The " * 300, "  lead and trail  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("pieces", "decoded", "_x", "_text", "_key", "key", "c0", "n_pieces")})
    both = pieces.decode(pieces.encode(df))
    assert {r.doc_id: r.decoded for r in both.collect()} == dict(enumerate(texts))
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in pieces.encode(df, dropout=0.0).collect():
        if r.text is not None and "▁" not in r.text and r.text != "":
            assert np.frombuffer(r.pieces, "<u2").tolist() == sp.encode(r.text)
    one, same, other = ({r.doc_id: r.pieces for r in pieces.encode(df, seed=s).collect()} for s in (1, 1, 2))
    assert one == same and one != other
    checked = pieces.encode(df, check=True).collect()
    assert all(r.lossless for r in checked) and {r.doc_id: r.decoded_sha256 for r in checked}[0] == hashlib.sha256(texts[0].encode()).hexdigest()
    assert pieces.encode(none).collect() == [] and len(pieces.encode(docs).collect()) == len(ROWS)


def brute_pieces(p, text, key, dropout, seed):
    """Merges one by one, each made or skipped by the hash of its document, unit and number of skips before."""
    out, gaps = b"", pieces.Gaps(dropout)
    for place, unit in enumerate(pieces.UNIT.findall(" " + text)):
        symbols, gone, level = p.symbols(unit), set(), 0
        spans = [(i, i + 1) for i in range(len(unit))]
        left = int(gaps.of(np.array([key], np.uint64), np.array([place]), 0)[0])
        while True:
            can = [(int(p.rank[p.pair[a << 32 | b]]), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a >= 0 <= b and (a << 32 | b) in p.pair and (spans[i], spans[i + 1]) not in gone]
            if not can:
                break
            _, i = min(can)
            if left:
                left -= 1
                symbols[i : i + 2] = [p.pair[symbols[i] << 32 | symbols[i + 1]]]
                spans[i : i + 2] = [(spans[i][0], spans[i + 1][1])]
            else:
                gone.add((spans[i], spans[i + 1]))
                level += 1
                left = int(gaps.of(np.array([key], np.uint64), np.array([place]), level)[0])
        out += p.shown(symbols)
    return out


def test_pieces_with_dropout_against_brute_force():
    rng = np.random.default_rng(1)
    words = ["the", "information", "  of", "Ünïcode", "日本", "aaaaaaaaaaaaaaa", "internationalization", "\n", "x" * 60, "der", "que"]
    for dropout in (0.1, 0.4, 0.9):
        e = pieces.Encoder(open(pieces.MODEL, "rb").read(), dropout=dropout)
        texts = [" ".join(rng.choice(words, 30)) for _ in range(40)] + ["", None]
        keys = rng.integers(-(1 << 62), 1 << 62, len(texts)).tolist()
        got = list(e.encode(texts, keys))
        for t, k, x in zip(texts, keys, got):
            assert x == (None if t is None else brute_pieces(e.pieces, t, k % (1 << 64), dropout, 1) if t else b"")
        assert e.decode(got) == texts


def test_units_are_those_of_the_pattern():
    rng = np.random.default_rng(0)
    for _ in range(500):
        text = "".join(rng.choice(list("ab \n"), int(rng.integers(1, 12)), p=[0.3, 0.3, 0.2, 0.2]))
        assert pieces.units_of(text) == pieces.UNIT.findall(" " + text)


def test_pieces_vary_by_document_and_place(spark):
    """The same word is decided anew at every place and in every document; so are copies of a row, if asked for."""
    e = pieces.Encoder(open(pieces.MODEL, "rb").read())
    text = " ".join(["internationalization"] * 400)
    seen = {bytes(x) for x in e._run([pieces.UNIT.findall(" " + text)], np.array([7], np.uint64))}
    assert len(seen) > 20
    shares = np.mean([len(x) for x in e.encode([text] * 20, list(range(20)))]) / len(list(pieces.Encoder(open(pieces.MODEL, "rb").read(), dropout=0.0).encode([text], [0]))[0])
    assert shares > 1.1
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string").coalesce(1)
    same, other = (pieces.encode(df, by_row=b).collect() for b in (False, True))
    assert same[0].pieces == same[1].pieces != same[2].pieces and other[0].pieces != other[1].pieces


def test_op6_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = pieces.op6_sentencepiece(spark, str(tmp_path)).collect()
    assert len(out) == len(ROWS) and all(r.lossless for r in out)
    want = Counter((i, None if t is None else hashlib.sha256(t.encode()).hexdigest()) for i, t, _ in ROWS)
    assert Counter((r.doc_id, r.decoded_sha256) for r in out) == want


def brute_winnow(text):
    """(place, hash) of every choice, window by window."""
    text = (text or "").replace("İ", "i").replace("Σ", "σ").lower()
    k, w = fingerprints.GRAM, fingerprints.WINDOW
    h = [xxhash.xxh64_intdigest(g.encode(), 42) >> 33 for g in ([text[i : i + k] for i in range(len(text) - k + 1)] or [text][: len(text)])]
    chosen = []
    for s in range(max(1, len(h) - w + 1) if h else 0):
        window = h[s : s + w]
        at = s + max(i for i, x in enumerate(window) if x == min(window))
        if not chosen or chosen[-1][0] != at:
            chosen.append((at, h[at]))
    return chosen


def test_fingerprints(spark, docs, none, tmp_path):
    """op10 against winnowing window by window, of each text and of the edited text itself."""
    rng = np.random.default_rng(2)
    pool = [f"w{i}" for i in range(500)]
    words = lambda n: " ".join(rng.choice(pool, n))
    texts = [words(int(rng.integers(0, 60))) for _ in range(50)] + ["".join(rng.choice(list("日本語文字列一二三"), n)) for n in (5, 11, 12, 19, 20, 500, 2000)]
    texts += ["same " * 100, "a" * 700, None, "", " \n", "😀É" * 300, "İΣ Σ" * 120, words(900), "tiny", words(400), *[words(int(n)) for n in rng.integers(1, 400, 40)]]
    order = rng.permutation(len(texts))
    rows = [(int(k) * 3, texts[i]) for k, i in enumerate(order)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in fingerprints.op10_fingerprints(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    shown = lambda c: " ".join(str(h * 2**31 + p) for p, h in c)
    for k, (i, t) in enumerate(rows):
        t, follower = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 4] + follower[: len(t) // 4]
        own, other, after = (brute_winnow(x) for x in (t, edited, follower))
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert out[i].fingerprint == shown(own) and out[i].edited_fingerprint == shown(other)
        for got, x in ((out[i].near_edited, other), (out[i].near_next, after)):
            a, b = {h for _, h in own}, {h for _, h in x}
            assert got == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert len(fingerprints.edited_likeness(docs).collect()) == len(ROWS) and fingerprints.edited_likeness(none).collect() == []


def test_fingerprints_find_every_shared_passage(spark):
    """A passage of GRAM + WINDOW - 1 code points, without blanks, leaves a choice in every text that has it."""
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnop")
    passage = "".join(rng.choice(letters, fingerprints.GRAM + fingerprints.WINDOW - 1))
    rows = [(i, "".join(rng.choice(letters, int(rng.integers(0, 90)))) + passage + "".join(rng.choice(letters, int(rng.integers(0, 90))))) for i in range(60)]
    found = [set(r.hashes) for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert set.intersection(*found)


def test_fingerprint_ties_are_rightmost(spark):
    r = fingerprints.fingerprint(spark.createDataFrame([(1, "a" * 60)], "doc_id long, text string")).first()
    assert len(set(r.hashes)) == 1 and r.places == list(range(fingerprints.WINDOW - 1, 60 - fingerprints.GRAM + 1))


def test_chat_trees(spark):
    rows = [
        ("t", "1", None, "user", "hi", 0.0), ("t", "2", "1", "assistant", "a</s>␛1[INST]", 1.0), ("t", "3", "1", "assistant", "b", 5.0), ("t", "4", "3", "us\ner", "<|turn|>x\n<|end|>", 1.0),
        ("t", "5", "4", "assistant", None, None), ("u", "9", "missing", None, "alone", 1.0), ("c", "1", "2", "user", "cycle", 1.0), ("c", "2", "1", "user", "cycle", 1.0),
    ]
    nodes = spark.createDataFrame(rows, "tree string, node string, parent string, role string, text string, score double")
    out = chat.formatted(chat.paths(nodes)).withColumn("turns", chat.read_back(F.col("conversation"))).withColumn("learned", chat.masked(F.col("conversation"), F.col("loss")))
    by = {(r.tree, r["rank"]): r for r in out.collect()}
    assert set(by) == {("t", 1), ("t", 2), ("u", 1)}
    assert [(t.role, t.text) for t in by["t", 1].turns] == [("user", "hi"), ("assistant", "b"), ("us\ner", "<|turn|>x\n<|end|>"), ("assistant", "")]
    assert by["t", 2].learned == "a</s>␛1[INST]" and by["u", 1].turns[0].role == ""
    assert len(chat.paths(nodes, best=1).select("tree", "leaf").distinct().collect()) == 2
    assert chat.formatted(chat.paths(nodes.limit(0))).collect() == []


def test_chat_escape_is_reversible(spark):
    rng = np.random.default_rng(0)
    parts = [*chat.CONTROLS, "0", "1", "n", "\n", "<", "|", "x"]
    rows = [("".join(rng.choice(parts, 12)),) for _ in range(300)]
    df = spark.createDataFrame(rows, "t string").select("t", chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("v"), chat.escape(F.col("t")).alias("e"))
    for r in df.collect():
        assert r.u == r.v == r.t and not any(c in r.e for c in chat.CONTROLS[1:])


def test_fingerprints_part_texts_by_their_size(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " * 40) for i in range(200)], "doc_id long, text string")
    want = sorted(map(tuple, fingerprints.edited_likeness(docs).collect()))
    monkeypatch.setattr(fingerprints, "BLOCK_BYTES", 1000, raising=False)
    monkeypatch.setattr(fingerprints, "PARTITION_BYTES", 4000, raising=False)
    rows, _ = fingerprints.with_next(docs)
    assert rows.select("block").distinct().count() > 50 > 16 >= fingerprints.BLOCKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows.rdd.getNumPartitions() >= 16
    assert sorted(map(tuple, fingerprints.edited_likeness(docs).collect())) == want
