"""That work is dealt over tasks and grows no faster than its input."""

import math
import os
import re
import tempfile
from collections import Counter

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from tillwork.functions import receipts as R
from tillwork.functions import strings as S
from tillwork.operators import classify, dedup, metrics, training
from tillwork.plans import queries as Q
from tillwork.streaming import jobs

SF = "/root/testdata/sf0.001"


def _written(path):
    return [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")]


def _tasks(files):
    return {re.search(r"part-(\d+)", f).group(1) for f in files}


def test_files_are_made_by_many_tasks(spark, tmp_path):
    rows = spark.range(40).coalesce(1).select(F.col("id").alias("k"), F.col("id").cast("string").alias("value"))
    files = _written(Q._file_a_row(rows, f"{tmp_path}/keyed"))
    assert sorted(open(f).read() for f in files) == sorted(f"{i}\n" for i in range(40)) and len(_tasks(files)) > 10
    assert all(re.search(r"k=(\d+)", f).group(1) == open(f).read().strip() for f in files)


def test_files_without_a_key_need_no_folders(spark, tmp_path):
    files = _written(Q._file_a_row(spark.range(300).coalesce(1).select(F.col("id").cast("string").alias("value")), f"{tmp_path}/flat"))
    assert sorted(open(f).read() for f in files) == sorted(f"{i}\n" for i in range(300)) and {os.path.dirname(f) for f in files} == {f"{tmp_path}/flat"} and len(_tasks(files)) > 10


def _plan(spark, column):
    return spark.range(1).select(column)._jdf.queryExecution().analyzed().toString()


def test_names_are_cut_into_tokens_once(spark):
    arrays = [F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))]
    assert _plan(spark, metrics.match_items(*arrays).alias("m")).count("upper(") <= 2  # once a side, not once a pair and use
    assert _plan(spark, S.token_f1(F.lit("a"), F.lit("b")).alias("f")).count("upper(") <= 2


def test_dates_are_read_by_the_formats_of_their_pattern(spark):
    assert _plan(spark, R.extract_date(F.lit("x")).alias("d")).count("translate(") == 1
    # every format on every hit, as dates were read before
    every = ("M/d/yyyy", "M/d/yy", "yyyy-M-d", "M-d-yyyy", "M-d-yy", "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM/d/yyyy", "MMMM/d/yyyy")
    texts = [a.replace("#", sep) for sep in "/-" for a in ("02#29#2023", "2#29#24", "13#05#2024", "1#5#70", "1#5#68", "1#5#0070", "12#31#1999 1#2#03", "2024#02#30 3#4#2024")]
    texts += [t for m in ("JAN", "jan", "January", "SEPT", "sept", "MAY", "Mayo") for t in (f"{m} 5 2024", f"5 {m} 2024", f"{m}/5/2024", f"{m} 31, 2023", f"30 {m}|1999")]
    rows = spark.createDataFrame([(t,) for t in [*texts, "", None, "2024-13-01 or JUN 31 2024, JUN 30 2024"]], "text string")
    flat = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "|,", "  "), r"\s+", " ")
    each = [F.filter(F.transform(F.regexp_extract_all(flat, F.lit(f"(?i){p}"), F.lit(0)), lambda h: F.coalesce(*[S.as_date(h, f) for f in every])), lambda d: d.isNotNull()) for p, _ in R.DATES]
    slow = F.coalesce(F.date_format(F.coalesce(*[F.try_element_at(d, F.lit(1)) for d in each]), "yyyy-MM-dd"), F.lit(""))
    got = rows.select("text", R.extract_date("text").alias("fast"), slow.alias("slow")).collect()
    assert [(r.text, r.fast) for r in got] == [(r.text, r.slow) for r in got] and sum(r.fast != "" for r in got) > 15


def test_a_line_is_made_upper_case_once(spark):
    assert _plan(spark, R.extract_items(F.lit("x")).alias("i")).count("upper(") == 1


def _twice(spark, path):
    """The tables with every order twice, under another key, so that different orders agree in date, total and store."""
    for t in ("part", "supplier"):
        os.symlink(f"{SF}/{t}.parquet", f"{path}/{t}.parquet")
    for t, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        top = spark.read.parquet(f"{SF}/orders.parquet").agg(F.max("o_orderkey")).first()[0] + 1
        rows.unionByName(rows.withColumn(key, F.col(key) + top)).write.parquet(f"{path}/{t}.parquet")
    return str(path)


def test_different_orders_are_no_duplicates(spark, tmp_path):
    sf = _twice(spark, tmp_path)
    kinds = {1: "hash", 2: "content"}
    found = {r.bill_id: (r.dup_of, r.layer) for r in Q.d02_find_duplicates(spark, sf).collect()}
    assert found and found == {b: (b - b % 10, kinds[b % 10]) for b in found} and {b % 10 for b in found} == {1, 2}
    done = Q.d04_resolve_batch(spark, sf).collect()
    assert len(done) > 3000 and all((r.accepted, r.dup_of, r.layer) == ((True, None, None) if r.bill_id % 10 in (0, 3) else (False, r.bill_id - r.bill_id % 10, kinds[r.bill_id % 10])) for r in done)


def test_receipt_numbers_tell_bills_apart(spark, tmp_path):
    rows = [(1, "h1", "SHOP", "A1"), (2, "h2", "SHOP", "A2"), (3, "h3", "SHOPS", "A1"), (4, "h4", "SHOP", None), (5, "h5", "SHOP", " A2 "), (6, "h2", "ELSEWHERE", "A9"), (7, "h7", "SHOP", "")]
    df = spark.createDataFrame(rows, "bill_id bigint, image_hash string, store string, receipt_number string").withColumns({"date": F.lit("2024-01-01").cast("date"), "total": F.lit("5.00").cast("decimal(12,2)")})
    want = {1: None, 2: None, 3: 1, 4: 1, 5: 2, 6: 2, 7: 1}
    assert {r.bill_id: r.dup_of for r in dedup.resolve_batch(df).collect()} == want
    assert {r.bill_id: r.dup_of for r in dedup.find_duplicates(df.where("bill_id > 2"), df.where("bill_id < 3")).collect()} == {k: v for k, v in want.items() if k > 2}
    assert {r.bill_id for r in dedup.resolve_batch(df.drop("receipt_number")).where("accepted").collect()} == {1, 6}  # without numbers date, total and store decide; 2 was never stored, so 6 is the first of its image
    taken = jobs._accepted(df.where("bill_id > 1"), spark, f"{tmp_path}/store", [])  # what an ingest stores
    assert {r.bill_id for r in taken.collect()} == {2, 3}


def test_a_range_of_a_stream_has_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "FILE_ROWS", 10)
    df = spark.range(100).repartition(3).withColumn("arrived", F.timestamp_seconds("id")).withColumn("image_hash", (F.col("id") % 60).cast("string"))
    stream = jobs.in_parts(df, "id", 2, f"{tmp_path}/in")
    files = _written(f"{tmp_path}/in")
    assert [sum(f"part={i}/" in f for f in files if f.endswith(".parquet")) for i in range(2)] == [5, 5]
    query = jobs.start_dedup_stream(stream, "3650 days", f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination()
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [50, 50]  # a range a batch
    assert "RocksDB" in str(query.recentProgress[-1]["stateOperators"]) or "rocksdb" in str(query.recentProgress[-1]["stateOperators"])
    assert sorted(int(r.image_hash) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(60))


def test_texts_move_once_to_be_counted(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(training, "saved", lambda df, name="": seen.append(df) or df)
    training.hashed_rows(spark.createDataFrame([(1, "abcd"), (2, "ab"), (3, "")], "id bigint, t string"), "id", "t", 64)
    assert seen[0]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.key, r.n) for r in seen[0].groupBy("key").agg(F.sum("tf").alias("n")).collect()} == {(1, 2), (2, 1)}


ODD = ["", "a", "a\0", "a\0\0", "é😀", "Σ", "aaaaaaa", "😀😀😀😀日本語日本語", "İstanbul ß", "line\nline\r\n", "the cat sat on the mat " * 400]


def _cut(text):
    return [text[i : i + 3] for i in range(len(text) - 2)] or [text]


def test_texts_are_cut_once_for_a_fit(spark, monkeypatch):
    seen = []
    kept = classify.saved
    monkeypatch.setattr(classify, "saved", lambda df, name="": seen.append((df, kept(df, name))) or seen[-1][1])
    rows = [(t, "ab"[i % 2]) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([*rows, (None, "a"), ("x", None), ("unweighted", "c")], "text string, label string")
    weights = spark.createDataFrame([("a", 1.5), ("b", 0.5), (None, 9.0)], "label string, weight double")
    model = classify.train_classifier(df, "text", "label", weights, features=1 << 12, iterations=3)
    (planned, table), = seen
    plan = planned._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange hashpartitioning(label" not in plan, "a class's rows are not gathered in one task"
    assert set(table.columns) == {"label", "weight", "tf"}, "what the fit reads again holds no texts"
    lower = [(r.l, r.label) for r in df.select(F.lower("text").alias("l"), "label").dropna().where("label <> 'c'").collect()]
    terms = spark.createDataFrame([(_cut(t), x) for t, x in lower], "grams array<string>, label string")
    want = HashingTF(inputCol="grams", outputCol="tf", numFeatures=1 << 12).transform(terms)
    flat = lambda rows: Counter((r.label, str(r.tf)) for r in rows.select("label", "tf").collect())
    assert flat(table) == flat(want)
    assert {(r.label, r.weight) for r in table.collect()} == {("a", 1.5), ("b", 0.5)}
    scored = classify.score_items(df, model).collect()
    assert len(scored) == len(ODD) + 3 and {r.text for r in scored} == {*ODD, None, "x", "unweighted"} and all(set(r.all_scores) == {"a", "b"} for r in scored)


def test_a_fitted_model_is_kept_and_read(spark, tmp_path):
    df = spark.createDataFrame([("olive oil", "Oils"), ("corn oil", "Oils"), ("whole milk", "Dairy"), ("butter milk", "Dairy")], "text string, label string")
    model = classify.train_classifier(df, "text", "label", features=256, iterations=5)
    model.write().overwrite().save(f"{tmp_path}/model")
    again = PipelineModel.load(f"{tmp_path}/model")
    shown = lambda m: sorted((r.text, r.predicted_label, r.confidence) for r in classify.score_items(df, m).collect())
    assert shown(again) == shown(model)


def test_grams_are_counted_within_their_row(spark, monkeypatch):
    from tillwork.operators import grams

    monkeypatch.setattr(grams, "LETTERS", 10)
    seen = []
    kept = classify.saved
    monkeypatch.setattr(classify, "saved", lambda df, name="": seen.append(df) or kept(df, name))
    model = spark.createDataFrame([("a", "", -1.0), ("b", "", -1.0), ("a", "the", 2.0)], "label string, feature string, weight double")
    df = spark.createDataFrame([*enumerate(ODD), (99, None)], "id int, text string")
    classify.score_items(df, model, "text", "id")
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "Exchange" not in plan, "no task groups by row and n-gram"
    lower = {r.id: r.l for r in df.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("l")).collect()}
    want = {(i, g): n for i, t in lower.items() for g, n in Counter(_cut(t)).items() if g}
    got = [((r.key, r.feature), r.tf) for r in seen[0].collect()]
    assert dict(got) == want and len(got) == len(want)
    assert {(r.key, r.feature): r.tf for r in classify.gram_counts(df.withColumn("id", F.lit(1)), "id", "text").collect()} == {(1, g): n for g, n in sum((Counter(_cut(t)) for t in lower.values() if t), Counter()).items()}


def test_vectors_of_a_classifier_are_made_within_rows(spark, monkeypatch):
    seen = []
    kept = training.saved
    monkeypatch.setattr(training, "saved", lambda df, name="": seen.append(df) or kept(df, name))
    rows = [*enumerate(ODD), (1, "a"), (5, "the end"), (99, None), (None, "no key")]  # two keys come twice
    vectors, idf = training.hashed_rows(spark.createDataFrame(rows, "id int, text string"), "id", "text", 1 << 12)
    for df in (*seen, vectors):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "Generate" not in plan, "a row's n-grams are not dealt over rows and gathered again"
    # brute force, with the numbers that SQL gives n-grams
    number = F.pmod(F.xxhash64("g"), F.lit(1 << 12)).cast("int")
    cut = spark.createDataFrame([(k, g) for k, t in spark.createDataFrame(rows, "id int, text string").select("id", F.lower("text")).collect() for g in _cut(t or "") if g], "k int, g string").select("k", number.alias("i")).collect()
    want = {k: Counter(r.i for r in cut if r.k == k) for k in {r.k for r in cut}}
    n, df = len([k for k in want if k is not None]), Counter(i for c in want.values() for i in c)
    assert {r.id: r.idf for r in idf.collect()} == pytest.approx({i: math.log((1 + n) / (1 + x)) + 1 for i, x in df.items()})
    made = {r.key: dict(zip(r.ids, r["values"])) for r in vectors.collect()}
    assert made.keys() == want.keys()
    for k, c in want.items():
        x = {i: (1 + math.log(tf)) * (math.log((1 + n) / (1 + df[i])) + 1) for i, tf in c.items()}
        assert made[k] == pytest.approx({i: v / math.sqrt(sum(y * y for y in x.values())) for i, v in x.items()})
    few = spark.createDataFrame([(1, "aaaaaaa"), (2, "qzx")], "id int, text string")
    assert [r.key for r in training.hashed_rows(few, "id", "text", 1 << 12, idf)[0].collect()] == [1], "n-grams that were not fitted have no weight"


def test_only_lines_with_amounts_are_looked_at_for_amounts(spark):
    for f in (R.extract_total, R.extract_tax, R.extract_subtotal, R.extract_items):
        assert "split(" not in _plan(spark, f(F.lit("x")).alias("f")), "lines without amounts are not cut out, trimmed and made upper case"
    assert _plan(spark, R.extract_date(F.lit("x")).alias("d")).count("Contains(") == 3, "a pattern is not looked for where its sign is missing"
    lines = ["Total 12.3,4", "TAX 5,.12", "tax 1,2.00 ", "SUB TOTAL\t3.50\r", "due 1.2,3", " Oil 4.99 ea", "x 1.00", " \u0085", "milk", "ZUCKER 20,001.50", "Balance 20,001.50", "FUSS ß 2.25", "a b 7.75"]
    texts = ["\n".join(lines[i:j]) for i in range(len(lines)) for j in range(i, len(lines) + 1)]
    rows = spark.createDataFrame([(t,) for t in {*texts, "no amounts", "\n\n"}] + [(None,)], "text string")
    # all lines of the text, as they were looked at before
    every = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    upper = F.transform(every, F.upper)
    fast = [R.extract_total("text"), R.extract_total("text", "last_total"), R.extract_tax("text"), R.extract_subtotal("text"), R.extract_items("text")]
    slow = [R.extract_total("text", upper=upper), R.extract_total("text", "last_total", upper), R.extract_tax("text", upper), R.extract_subtotal("text", upper), R.extract_items("text", every)]
    names = lambda columns: F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    got = rows.select("text", names(fast).alias("fast"), names(slow).alias("slow")).collect()
    assert [(r.text, r.fast) for r in got] == [(r.text, r.slow) for r in got] and len({str(r.fast.c4) for r in got}) > 5


def test_an_ingest_leaves_its_store_only(spark, tmp_path):
    from tillwork.functions import folders

    shuffles = lambda: {f for d, _, fs in os.walk(spark.conf.get("spark.local.dir", None) or tempfile.gettempdir()) if "blockmgr" in d for f in fs if f.startswith("shuffle_")}
    before, stood = set(os.listdir(folders.shared_dir(spark).removeprefix("file:"))), shuffles()
    folders.saved(spark.range(1000).repartition(3, "id"), "lasting")
    assert not shuffles() - stood, "shuffle files of a finished write are gone"
    text = spark.createDataFrame([(i, f"Shop {i}\n2024-01-0{i}\nMILK {i}.00\nTOTAL {i}.00") for i in range(1, 6)], "k bigint, text string")
    batch = text.select(F.col("k").alias("bill_id"), *[F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in jobs.RECEIPT.split(", ")) if c not in ("bill_id", "text")], "text")
    model = classify.count_model(spark.createDataFrame([("milk", "Dairy")], "t string, label string"), "t", "label")
    words = Q.vocab.build_vocab(spark.createDataFrame([("milk",)], "text string"), "text")
    kept = set(os.listdir(folders.shared_dir(spark).removeprefix("file:")))
    jobs.ingest_receipts(batch, 0, f"{tmp_path}/store", model, words)
    jobs.in_parts(batch.select("bill_id", "text"), "bill_id", 2, f"{tmp_path}/in")
    after = set(os.listdir(folders.shared_dir(spark).removeprefix("file:")))
    assert after == kept and len(before) < len(kept), "tables kept on the way are gone"
    assert jobs.bill_store.read(spark, f"{tmp_path}/store", "items", jobs.ITEMS).count() == 5
    assert sum(spark.read.parquet(f"{tmp_path}/in/part={i}").count() for i in range(2)) == 5
    with folders.passing(spark):
        with folders.passing(spark):
            gone, stays = folders.saved(spark.range(2)), folders.saved(spark.range(3), outlive=True)
        assert stays.count() == 3 and set(os.listdir(folders.shared_dir(spark).removeprefix("file:"))) - after and gone.inputFiles()
    assert set(os.listdir(folders.shared_dir(spark).removeprefix("file:"))) == after
