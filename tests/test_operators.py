"""Issue rules, review, duplicates, lines, votes, quality, reconciliation and sources on small tables."""

import json

from pyspark.sql import functions as F

from foliant.functions import geometry as g
from foliant.operators import classify, duplicates, export, issues, lines, quality, reconcile, review
from foliant.sources import readers

QUESTION = "number int, stem string, options array<struct<key:string,text:string>>, correct_key string, key_source string, explanation string, subject_key string, topic string, flags array<string>, duplicates array<string>, articles array<struct<law:string,law_key:string>>"
GOOD = [("1", "a"), ("2", "b"), ("3", "c"), ("4", "d")]


def codes(spark, **change):
    base = {"number": 5, "stem": "پرسش", "options": GOOD, "correct_key": "2", "key_source": "table", "explanation": "متن", "subject_key": "civil", "topic": "t", "flags": [], "duplicates": [], "articles": []} | change
    df = spark.createDataFrame([tuple(base.values())], QUESTION)
    row = df.select(issues.question_issues(F.lit(True), ["civil"]).alias("i"), issues.is_clean(F.lit(True), ["civil"]).alias("clean")).first()
    return [i.code for i in row.i], row.clean


def test_issue_rules(spark):
    assert codes(spark) == ([], True)
    assert codes(spark, stem=" ") == (["empty_stem"], False)
    assert codes(spark, options=GOOD[:3], correct_key="1") == (["option_count"], False)
    assert codes(spark, options=[*GOOD[:3], ("4", " ")])[0] == ["empty_option"]
    assert codes(spark, correct_key=None)[0] == ["missing_key"] and codes(spark, correct_key="7")[0] == ["invalid_key"]
    assert codes(spark, explanation="گزینه ۳ صحیح است")[0] == ["key_mismatch"] and codes(spark, explanation="گزینه ۳ صحیح است", key_source="manual")[0] == []
    assert codes(spark, explanation="")[0] == ["missing_explanation"] and codes(spark, flags=["x"])[0] == ["suspicious_words"]
    assert codes(spark, stem="متن ۶- ادامه")[0] == ["merged_suspect"] and codes(spark, options=[*GOOD[:3], ("4", "x" * 401)])[0] == ["merged_suspect"]
    assert codes(spark, subject_key=None) == (["missing_subject"], True) and codes(spark, topic="") == (["missing_topic"], True)
    assert codes(spark, duplicates=["d"])[0] == ["duplicate"] and codes(spark, articles=[("law", None)]) == (["article_unknown_law"], True)


def test_project_rules(spark):
    q = spark.createDataFrame([("p", n, "", "inline", None) for n in (1, 2, 2, 5)], "project_id string, number int, explanation string, key_source string, correct_key string")
    p = spark.createDataFrame([("p", True, 6), ("empty", False, None)], "id string, has_explanations boolean, expected_count int")
    out = {r.id: [i.code for i in r.issues] for r in issues.project_issues(q, p).collect()}
    assert out == {"p": ["missing_numbers", "duplicate_numbers", "count_mismatch", "explanations_unmatched", "key_table_missing"], "empty": []}
    assert sorted(r.n for r in issues.missing_numbers(q, "project_id", "number", F.lit(6)).collect()) == [3, 4, 6]


def test_apply_keys(spark):
    q = spark.createDataFrame([("p", 1, "1", "table", "approved", "auto"), ("p", 2, "2", "table", "approved", "admin"), ("p", 3, None, None, "pending", None)], "project_id string, number int, correct_key string, key_source string, status string, approved_by string")
    keys = review.numbered_keys(spark.createDataFrame([("p", ["3", "2", None])], "project_id string, keys array<string>"), 1)
    out = {r.number: (r.correct_key, r.key_source, r.status, r.approved_by, r.changed) for r in review.apply_keys(q, keys).collect()}
    assert out == {1: ("3", "manual", "pending", None, True), 2: ("2", "table", "approved", "admin", False), 3: (None, None, "pending", None, False)}


def test_duplicates_exact_equals_all_pairs(spark):
    texts = ["the quick brown fox jumps over it", "the quick brown fox jumped over it", "a wholly different sentence here", "the quick brown fox jumps over it", "quick brown fox jumps over it now"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, print string")
    grams = [{x[i : i + 3] for i in range(len(x) - 2)} for x in texts]
    for percent in (60, 88):
        want = {(i, j) for i in range(5) for j in range(5) if 200 * len(grams[i] & grams[j]) >= percent * (len(grams[i]) + len(grams[j]))}
        assert {(r.left_id, r.right_id) for r in duplicates.similar_pairs(df, df, percent).collect()} == want
        within = [(r.left_id, r.right_id, r.shared, r.total) for r in duplicates.similar_pairs(df, percent=percent).collect()]
        assert sorted(within) == [(i, j, len(grams[i] & grams[j]), len(grams[i]) + len(grams[j])) for i, j in sorted(want) if i < j]


def test_fingerprint(spark):
    rows = [("۱۲ متن سؤال", ["ب گزینه", "الف یک"]), ("12 متن سوال", ["الف یک", "ب گزینه"])]
    out = spark.createDataFrame(rows, "s string, o array<string>").select(duplicates.fingerprint(F.col("s"), F.col("o")).alias("f")).collect()
    assert out[0].f == out[1].f == "متن سوال | گزینه | یک"


def test_minhash_recall(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(0, base), (1, base.replace("word30", "other")), (2, " ".join(f"thing{i}" for i in range(60)))]
    out = duplicates.candidates(spark.createDataFrame(rows, "id int, print string"))
    assert [(r.a, r.b) for r in out.collect()] == [(0, 1)]


def test_noise_and_paragraphs(spark):
    rows = [("d", p, i, x) for p in range(5) for i, x in enumerate(["کتاب حقوق مدنی", f"متن صفحه {'abcde'[p]} است", "این یک خط بلند است که ادامه دارد و", "پایان می‌یابد", str(p + 1)])]
    df = spark.createDataFrame(rows, "doc string, page int, line_no int, text string")
    assert [(r.key, r.pages) for r in lines.repeated_edges(df).orderBy("key").collect()][-1][1] == 5
    kept = [r.text for r in lines.content_lines(df).filter("page = 0").orderBy("line_no").collect()]
    assert kept == ["متن صفحه a است"]  # all others repeat at an edge or are numbers
    text = spark.createDataFrame([("d", 0, 0, "A long first line of the paragraph that goes"), ("d", 0, 1, "on to a second line of about the same width."), ("d", 0, 2, "Short end."), ("d", 0, 3, "A new one begins here after the short line")], "doc string, page int, line_no int, text string")
    assert lines.paragraphs(text, F.lit(False), F.lit(False)).count() == 2


def test_heading_path(spark):
    rows = [(1, "s", 0), (2, "b1", 1), (3, "f1", 2), (4, None, None), (5, "b2", 1), (6, None, None)]
    df = spark.createDataFrame(rows, "n int, h string, lv int").withColumn("d", F.lit(1))
    out = {r.n: r.path for r in lines.heading_path(df, ["d"], ["n"], F.col("h"), F.col("lv")).collect()}
    assert out[4] == ["s", "b1", "f1"] and out[6] == ["s", "b2"]


def test_classification(spark):
    ranges = classify.blueprint_ranges(spark).withColumnRenamed("blueprint", "key")
    q = spark.createDataFrame([("BAR-1405", 65), ("CENTER-1404", 100), ("BAR-1405", 999)], "b string, n int")
    assert [r.subject_key for r in classify.first_range(q, ranges, F.col("b"), F.col("n"), ["subject_key"], [F.col("range_no")]).orderBy("n").collect()] == ["usul_fiqh", "fiqh_center", None]
    assert [r.subject_key for r in classify.in_range(q.withColumnRenamed("b", "key"), ranges, "key", "n", "range_no").orderBy("n").collect()] == ["usul_fiqh", "fiqh_center", None]
    heads = spark.createDataFrame([("بخش اول: حقوق مدنی (سؤالات ۱ تا ۲۰)",), ("متن دیگری است",)], "x string").withColumn("heading", classify.heading_key(F.col("x")))
    assert [r.subject_key for r in heads.join(classify.subject_names(spark), "heading", "left").orderBy(F.desc("x")).collect()].count("civil") == 1
    c = spark.createDataFrame([("مواد ۱۰ تا ۱۲ قانون مدنی و ماده ۲ ق.ت",)], "t string").select(classify.citations(F.col("t")).alias("c")).first().c
    assert [(x.kind, x.numbers) for x in c][0] == ("ماده", ["10", "11", "12"])
    laws = spark.createDataFrame([("قانون تجارت", "commercial"), ("قانون تجارت الکترونیکی", "e"), ("ق.م", "civil"), ("ق.م.ا", "penal")], "name string, law_key string")
    after = spark.createDataFrame([("قانون تجارت الکترونیکی مصوب",), ("ق.م.ا",), ("از قانون تجارت است",), ("هیچ",)], "a string")
    assert {r.a: r.law_key for r in classify.law_after(after, "a", laws).collect()} == {"قانون تجارت الکترونیکی مصوب": "e", "ق.م.ا": "penal", "از قانون تجارت است": "commercial", "هیچ": None}


def test_law_names_of_any_length(spark):
    name = "قانون آیین دادرسی دادگاه های عمومی و انقلاب در امور مدنی"
    laws = spark.createDataFrame([(name, "civil"), ("قانون آیین دادرسی", "short")], "name string, law_key string")
    after = spark.createDataFrame([(f"{name} مصوب",), ("قانون آیین دادرسی کیفری",)], "a string")
    assert sorted(r.law_key for r in classify.law_after(after, "a", laws).collect()) == ["civil", "short"]
    assert [r.law_key for r in classify.law_after(after, "a", laws.limit(0)).collect()] == [None, None]


def test_quality(spark):
    lexicon = spark.createDataFrame([("کتاب",), ("قانون",)], "word string")
    rows = [("d", 1, "کتاب", 50.0, None), ("d", 1, "ناشناس", 50.0, None), ("d", 1, "قانون", 10.0, None), ("d", 1, "درست", 95.0, None), ("d", 1, "درست", 40.0, None), ("d", 1, "x", None, "disagree")]
    w = quality.refine_flags(spark.createDataFrame(rows, "doc string, page int, text string, conf double, flag string"), lexicon)
    assert sorted((r.text, r.conf, r.flag) for r in w.collect() if r.flag) == [("x", None, "disagree"), ("قانون", 10.0, "low_conf"), ("ناشناس", 50.0, "low_conf")]
    good = spark.createDataFrame([("d", 1, "کتاب", 95.0, None)] * 20 + [("d", 2, "كت۱اب", 10.0, "low_conf")] * 20, "doc string, page int, text string, conf double, flag string")
    pages = spark.createDataFrame([("d", 1, None), ("d", 2, None), ("d", 3, 0.001), ("d", 4, None)], "doc string, page int, ink_ratio double")
    q = {r.page: r.quality for r in quality.page_quality(good, lexicon, pages).collect()}
    assert q[1] >= 0.9 and q[2] < 0.45 and q[3] == 1.0 and q[4] == 0.0


def test_learned_words_reads_all_documents(spark, tmp_path):
    from foliant.plans import texts

    docs = [(i, f"known start{i}\nbench known word{chr(97 + i)}, start{(i + 1) % 20}") for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "bench")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r[0] for r in texts.learned_words(spark, str(tmp_path)).collect()) == [f"word{chr(97 + i)}" for i in range(20)]


def _as_sql(spark, name, folder, **tables):
    """(rows of the query, rows of its SQL) over tables written to folder, both sorted."""
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect(config={"threads": 1})
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    return order(entry.queries()[name](spark, str(folder)).collect()), order(con.execute(entry.oracle_sql()[name]).fetchall())


def test_learned_words_judges_words_without_their_punctuation(spark, tmp_path):
    docs = spark.createDataFrame([(1, "start\n(555) 222. 888- 12) 123. wwwx, fine"), (2, None), (3, "")], "doc_id long, text string")
    ours, sql = _as_sql(spark, "learned_words", tmp_path, documents=docs, benchmark=spark.createDataFrame([(1, "known")], "item_id long, text string"))
    assert ours == sql == [("12",), ("123",), ("fine",)]


def test_interval_merge_bands_of_odd_dates(spark, tmp_path):
    rows = [(1, "2000-01-01"), (1, None), (1, "2000-03-01"), (2, None), (2, None), (None, "2000-01-01"), (3, "1969-12-31 12:00:00"), (3, "1970-01-27"), (4, "2020-01-01 23:59:59.6"), (5, "2000-01-01"), (5, "2000-02-01"), (5, "2000-02-01"), (5, None)]
    lineitem = spark.createDataFrame(rows, "l_partkey long, t string").selectExpr("l_partkey", "cast(t AS timestamp_ntz) AS l_shipdate")
    ours, sql = _as_sql(spark, "interval_merge_bands", tmp_path, lineitem=lineitem)
    assert ours == sql and (1, 11017, 11037, 2) in ours and (5, 10988, 11008, 3) in ours


def test_merge_readings_takes_many_pages_at_once(spark):
    words = [(d, p, line, pos, x, *([0.1] * 4 if p else [None] * 4), float("nan") if p == 2 else 80.0) for d in ("a", None) for p in range(300) for line, pos, x in [(1, 0, "دو"), (0, 1, "c"), (0, 0, "یک")]]
    w = spark.createDataFrame(words, "doc string, page int, line int, pos int, text string, x0 double, y0 double, x1 double, y1 double, conf double")
    said = [(d, p, "یک c\nدو" if p % 2 else "یک e\nدو", False) for d in ("a", None) for p in range(1, 301)]
    out = reconcile.merge_readings(w, spark.createDataFrame(said, "doc string, page int, answer string, trust boolean"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan  # one call of Python a page took 0.8 ms on 8 cores
    found = {}
    for r in out.collect():
        found.setdefault((r.doc, r.page), []).append((r.line, r.pos, r.text, r.flag, r.alt, r.conf, r.x0))
    assert len(found) == 2 * 301
    for d in ("a", None):
        assert found[d, 0] == [(0, 0, "یک", None, None, 80.0, None), (0, 1, "c", None, None, 80.0, None), (1, 0, "دو", None, None, 80.0, None)]
        assert found[d, 2] == [(0, 0, "یک", None, None, None, 0.1), (0, 1, "e", "disagree", "c", None, 0.1), (1, 0, "دو", None, None, None, 0.1)]
        assert [x[2:4] for x in found[d, 3]] == [("یک", None), ("c", None), ("دو", None)]
        assert found[d, 300] == [(0, 0, "یک", None, None, None, None), (0, 1, "e", None, None, None, None), (1, 0, "دو", None, None, None, None)]


def test_similar_pairs_within_one_side_meet_by_blocks(spark, monkeypatch):
    import random

    import pyarrow as pa

    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeé𝒳") for _ in range(3)) for _ in range(12)]
    prints = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(400)] + ["", "x", "xy", "𝒳", "a | b", "a b", None]
    rows = [(i, p) for i, p in enumerate(prints + prints[:20])]
    grams = lambda p: ((s := p.replace(" | ", " ")), {s[i : i + 3] for i in range(len(s) - 2)} or {s})[1]
    sets = [(i, grams(p)) for i, p in rows if p]
    want = sorted((i, j, len(x & y), len(x) + len(y)) for i, x in sets for j, y in sets if i < j and len(x & y) * 200 >= (len(x) + len(y)) * 70)
    monkeypatch.setattr(duplicates, "BLOCK", 20, raising=False)
    out = duplicates.similar_pairs(spark.createDataFrame(rows, "id long, print string"), percent=70)
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()  # by shared prefixes 5,012 texts took 26 s
    assert sorted(map(tuple, out.collect())) == want
    none = spark.createDataFrame([], "id long, print string")
    assert duplicates.similar_pairs(none).collect() == []
    monkeypatch.setattr(duplicates, "STRIP", 7)
    monkeypatch.setattr(duplicates, "RARE_AT_ONCE", 50)
    once = sorted({p for p in prints if p})
    table = pa.table({"left": [True] * len(once), "pid": pa.array(range(len(once)), pa.int64()), "print": once})
    for dense in (1, 20, 10**9):
        monkeypatch.setattr(duplicates, "DENSE", dense)
        found = sorted(r for b in duplicates._similar(table, True, 70) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        sets = [grams(p) for p in once]
        assert found == [(i, j, len(x & y), len(x) + len(y)) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and len(x & y) * 200 >= (len(x) + len(y)) * 70]


def test_candidates_meet_once_in_pieces_of_a_band(spark, monkeypatch):
    import random

    rng = random.Random(3)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(8)]
    prints = ["".join(rng.choice("xyz") if rng.random() < 0.03 else c for c in bases[i % 8]) for i in range(160)]
    monkeypatch.setattr(duplicates, "MEET", 6, raising=False)
    df = spark.createDataFrame(list(enumerate(prints)), "id long, print string")
    a, b = duplicates.hash_functions()
    sig = {r.id: r.sig for r in df.groupBy("print").agg(F.min("id").alias("id")).select("id", duplicates.minhash(duplicates.trigrams(F.col("print")), a, b).alias("sig")).collect()}
    same = {(i, j): [x == y for x, y in zip(sig[i], sig[j], strict=True)] for i in sig for j in sig if i < j}
    want = sorted((i, j, sum(e)) for (i, j), e in same.items() if any(all(e[k : k + 4]) for k in range(0, 40, 4)) and sum(e) >= (70 / 130 - 0.2) * 40)
    out = duplicates.candidates(df, 70)
    assert sorted(map(tuple, out.collect())) == want and len(want) > 100
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()  # pairs made distinct by a shuffle took 25 s for 10 million
    assert duplicates.candidates(df.filter("false"), 70).collect() == []
    for k in ("3", "10000"):  # groups go on in the next batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", k)
        assert sorted(map(tuple, duplicates.candidates(df, 70).collect())) == want


def test_corrections(spark):
    w = spark.createDataFrame([("d", 1, 0, k, x, f) for k, (x, f) in enumerate([("یک", None), ("غلظ", "low_conf"), ("سه", "low_conf"), ("غلظ", None)])], "doc string, page int, line int, pos int, text string, flag string")
    c = spark.createDataFrame([("d", 1, 0, "غلظ", "غلط"), ("d", 1, 0, "نیست", "x")], "doc string, page int, line int, wrong string, right string")
    out = [(r.text, r.flag) for r in reconcile.apply_corrections(w, c, w.select("doc", "page", "line")).orderBy("pos").collect()]
    assert out == [("یک", None), ("غلط", None), ("سه", None), ("غلظ", None)]
    answers = spark.createDataFrame([("d", 1, "یک غلط سه غلظ", False)], "doc string, page int, answer string, trust boolean")
    boxed = w.withColumns({c: F.lit(0.1).cast("double") for c in ("x0", "y0", "x1", "y1")}).withColumn("conf", F.lit(50.0))
    assert [r.text for r in reconcile.merge_readings(boxed, answers).orderBy("pos").collect()] == ["یک", "غلط", "سه", "غلظ"]


def test_export(spark):
    q = spark.createDataFrame([("p", 2, 0, "a & b", [("2", "y"), ("1", "x<")], "1", "e", "s", "", "civil", [], "approved"), ("p", 1, 1, "one", [("1", "x")], None, "", "", "t", None, [], "pending")], "project_id string, number int, seq int, stem string, options array<struct<key:string,text:string>>, correct_key string, explanation string, source_ref string, topic string, subject_key string, articles array<struct<law:string,law_key:string,kind:string,number:string,clause:string>>, status string")
    p = spark.createDataFrame([("p", "bar", 1405, "T")], "id string, track string, year int, title string")
    out = json.loads(export.payloads(p, q).first().payload)
    assert [x["source_number"] for x in out["questions"]] == [1, 2] and out["questions"][1]["stem_html"] == "<p>a &amp; b</p>"
    assert [(o["key"], o["order"], o["text_html"]) for o in out["questions"][1]["options"]] == [("1", 1, "x&lt;"), ("2", 2, "y")]
    got = [r.line for r in export.template_lines(q.withColumn("title", F.lit("T")), "title", only_approved=True).orderBy("line_no").collect()]
    assert got == ["سوال 1: a & b", "الف) x<", "ب) y", "پاسخ صحیح: الف", "پاسخ تشریحی: e", "منبع: T", ""]
    names = spark.createDataFrame([(1, "a/b"), (2, "a b"), (3, None)], "i int, t string")
    assert [r.file_name for r in export.unique_names(names, "t", "i").orderBy("i").collect()] == ["a b", "a b (2)", "export"]


def test_geometry(spark):
    df = spark.range(1).select(g.box(F.lit(0.0), F.lit(0.0), F.lit(0.4), F.lit(0.1)).alias("a"), g.box(F.lit(0.5), F.lit(0.02), F.lit(0.9), F.lit(0.12)).alias("b"))
    r = df.select(g.same_row(F.col("a"), F.col("b")).alias("s"), g.union_of(F.array("a", "b")).alias("u"), g.split_box(F.col("a"), F.lit(2)).alias("p"), g.near_equal(F.col("a"), F.col("a")).alias("e")).first()
    assert r.s and r.e and tuple(r.u) == (0.0, 0.0, 0.9, 0.12) and [round(x.x0, 2) for x in r.p] == [0.2, 0.0]


def test_sources(spark, tmp_path):
    for name, text in (("a", json.dumps({"id": "a", "title": "A", "created_at": "2024-01-01T00:00:00Z", "questions": [{"number": 1, "stem": "s"}]})), ("b", "{broken"), ("c", json.dumps({"id": "c", "created_at": "2025-01-01T00:00:00Z"}))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "project.json").write_text(text)
    p = readers.read_projects(spark, str(tmp_path))
    assert [r.id for r in p.collect()] == ["c", "a"] and readers.questions_of(p).first().stem == "s"
    assert readers.find_project(p, "a").count() == 1 and readers.find_project(p, "../a").count() == 0
    files = tmp_path / "up"
    files.mkdir()
    (files / "x.bin").write_bytes(b"%PDF-1.7")
    (files / "y.pdf").write_bytes(b"junk")
    good, bad = readers.split_uploads(readers.read_uploads(spark, str(files)))
    assert [r.kind for r in good.collect()] == ["pdf"] and [r.reason for r in bad.collect()] == ["unknown_type"]
    pages = readers.combine(spark.createDataFrame([("d", 0, 2), ("d", 1, 0), ("d", 2, 1)], "doc string, file int, n int"), ["doc"], "file", "n")
    assert [(r.file, r.file_page, r.page) for r in pages.orderBy("page").collect()] == [(0, 0, 0), (0, 1, 1), (2, 0, 2)]


def test_streaming(spark, tmp_path):
    from foliant.streaming import uploads

    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"job_id": "j", "project_id": "p", "submitted_at": f"2024-01-01T00:0{i}:00Z", "pages": 3}) + "\n")
    q = uploads.job_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("jobs").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("jobs").count() == 1


def test_subject_precedence(spark):
    ids = ["project_id", "seq"]
    q = spark.createDataFrame([("p", i, "civil", None, None, None, p) for i, p in enumerate([[], [], ["بخش اول: حقوق تجارت"], [], []])] + [("p", 5, "civil", "x", "manual", 1.0, [])], "project_id string, seq int, default_subject string, subject_key string, subject_source string, subject_confidence double, path array<string>")
    empty = spark.createDataFrame([], "project_id string, seq int, subject string")
    bp = spark.createDataFrame([("p", 0, "criminal"), ("p", 4, "commercial")], "project_id string, seq int, subject string")
    arts = spark.createDataFrame([("p", 1, "m", "text", "stem", "۱۰"), ("p", 1, "t", "text", "explanation", "۲")], "project_id string, seq int, law_key string, source string, field string, number string")
    laws = spark.createDataFrame([("m", "civil"), ("t", "commercial")], "law_key string, subject_key string")
    found = classify.subject_from_articles(arts, laws, ids)
    heading = classify.innermost_heading(F.col("path"), classify.subject_names(spark))
    out = {r.seq: (r.subject_key, r.subject_source) for r in classify.classify_questions(q, bp, found, heading, empty, ids).collect()}
    assert out[0] == ("criminal", "blueprint") and out[1] == ("civil", "text") and out[5] == ("x", "manual") and out[3] == ("civil", "default")
    ranges = spark.createDataFrame([("m", "general", 1, 1000, 0, False), ("m", "special", 5, 15, 1, True)], "law_key string, topic string, lo int, hi int, topic_order int, unverified boolean")
    assert [(r.topic, r.confidence) for r in classify.topic_from_articles(arts, ranges, ids).collect()] == [("special", 0.65)]
    scores = classify.keyword_scores(spark.createDataFrame([("p", 1, "stem", "عقد بیع و خیار است")], "project_id string, seq int, field string, text string"), spark.createDataFrame([("بیع", "عقد بیع"), ("اجاره", "اجاره")], "topic string, keyword string"), ids)
    assert [(r.topic, r.score) for r in scores.collect()] == [("بیع", 16)]
    assert classify.topic_from_keywords(scores, ids).first().topic == "بیع"
    assert classify.subject_from_keywords(scores, spark.createDataFrame([("بیع", "civil")], "topic string, subject_key string"), ids).first().subject == "civil"
    rows = spark.createDataFrame([("p", 1, "commercial", ["فصل نخست: تعریف تاجر"]), ("p", 2, "commercial", ["فصل دوم: چیز دیگر"])], "project_id string, seq int, subject_key string, path array<string>")
    topics = spark.createDataFrame([("commercial", "تاجر و تعریف آن", 0)], "subject_key string, topic string, topic_order int")
    assert {r.seq: r.topic for r in classify.topic_from_heading(rows, "path", topics, ids).collect()} == {1: "تاجر و تعریف آن", 2: "چیز دیگر"}


def test_layout(spark):
    from foliant.operators import layout

    words = [("سلام", 0.8, 0.1, 0.9, 0.12), ("دنیا", 0.6, 0.102, 0.7, 0.122), ("Spark", 0.5, 0.1, 0.58, 0.12), ("4.1", 0.35, 0.1, 0.45, 0.12), ("دوم", 0.8, 0.2, 0.9, 0.22)]
    df = spark.createDataFrame([("d", 0, *w) for w in words], "doc string, page int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r.text for r in layout.page_lines(df).orderBy("line_no").collect()] == ["سلام دنیا 4.1 Spark", "دوم"]
    parts = [layout.Piece("left", 0.1, 0.1, 0.4, 0.12), layout.Piece("right", 0.5, 0.1, 0.9, 0.12), layout.Piece("next", 0.1, 0.2, 0.9, 0.22)]
    assert [x.text for x in layout.right_parts_first(parts)] == ["right", "left", "next"]
    bands = spark.createDataFrame([(0.1 * i + (0.02 if i > 3 else 0), 0.1 * i + 0.05 + (0.02 if i > 3 else 0)) for i in range(8)], "lo double, hi double").withColumn("g", F.lit(1))
    assert lines.at_most_bands(bands, ["g"], "lo", "hi", 3).count() == 3


def test_records(spark):
    from foliant.operators import records

    q = spark.createDataFrame([("p", 1, "stem", [("1", "a"), ("2", "")], None), ("p", 2, "", [], "why")], "project_id string, number int, stem string, options array<struct<key:string,text:string>>, explanation string")
    assert [(r.number, r.field) for r in records.question_fields(q, ["project_id", "number"]).orderBy("number", "field_no").collect()] == [(1, "stem"), (1, "option:1"), (2, "explanation")]
    assert records.detect_mode(q).first().mode == "text"
    a = spark.createDataFrame([(1, 0, "k", "l", "ماده", "1", ""), (1, 1, "k", "other", "ماده", "1", ""), (1, 2, None, "l", "ماده", "1", "")], "q int, i int, law_key string, law string, kind string, number string, clause string")
    assert [r.i for r in records.distinct_articles(a, ["q"], ["i"]).orderBy("i").collect()] == [0, 2]
    box = [("q", "b", 0, i, (0.1 * i, 0.2, 0.5, 0.3)) for i in (1, 2, 2)]
    r = records.regions(spark.createDataFrame(box, f"q string, doc string, page int, line_no int, bbox {g.BOX}"), ["q"]).first().regions
    assert len(r) == 1 and (r[0].bbox.x0, r[0].bbox.x1) == (0.1, 0.5)
    gaps = spark.createDataFrame([("d", 0, i, y, y + 0.02, 0.1) for i, y in enumerate((0.1, 0.13, 0.17, 0.3))], "doc string, page int, line_no int, y0 double, y1 double, x0 double")
    assert round(records.usual_gap(gaps).first().gap, 2) == 0.02
    cells = spark.createDataFrame([(i, v) for i, v in enumerate("x..x....x")], "i int, v string").withColumn("g", F.lit(1))
    assert records.longest_run(cells, ["g"], "i", F.col("v") == ".").first().longest == 4
    p = spark.createDataFrame([("a", "ready", "questions"), ("b", "ready", "questions"), ("c", "failed", "questions")], "id string, status string, mode string")
    sent = spark.createDataFrame([("a", "approved"), ("b", "pending")], "project_id string, status string")
    assert {r.project_id: r.outcome for r in records.push_results(p, sent).collect()} == {"a": "send", "b": "nothing_approved", "c": "not_ready"}
    noise = spark.createDataFrame([("متن ۱۲", 0, 0.01, 0.05, 0.6), ("متن میانه", 5, 0.4, 0.42, 0.6)], "x string, nth int, y0 double, y1 double, w double")
    noise = noise.select(records.band_noise(g.box(F.lit(0.1), F.col("y0"), F.lit(0.1) + F.col("w"), F.col("y1")), F.col("nth"), F.lit(20), F.col("x"), F.lit(0.0), F.lit(False), F.lit(False)).alias("n"))
    assert [r.n for r in noise.collect()] == [True, False]
