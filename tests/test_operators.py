"""Golden cases and properties of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from tillwork.functions import messages as M
from tillwork.operators import classify, dedup, metrics, prep, similarity, spend, vocab
from tillwork.operators.profile import profile, profile_lines
from tillwork.sources import tables as T

BILLS = "bill_id bigint, image_hash string, store string, date date, total decimal(12,2)"
VOCAB = {"chicken": 1000, "chikoo": 3, "breast": 400, "boneless": 200, "frozen": 300, "ground": 250, "grilled": 120, "mozzarella": 500, "milkshake": 40, "cheese": 600, "cherry": 90}


@pytest.fixture(scope="module")
def words(spark):
    from tillwork.functions.strings import consonant_skeleton

    df = spark.createDataFrame(list(VOCAB.items()), "word string, freq bigint")
    return df.select("word", "freq", consonant_skeleton("word").alias("skeleton"), F.substring("word", 1, 1).alias("first"))


def test_expansions(spark, words):
    tokens = spark.createDataFrame([(t,) for t in "chk brst bnls frzn grnd grl moz milk chz xyz a".split()], "token string")
    got = {r.token: (r.expanded, r.score and round(r.score, 4)) for r in vocab.expand_tokens(tokens, words).collect()}
    assert got == {
        "chk": ("chicken", 4.1453), "brst": ("breast", 5.9940), "bnls": ("boneless", 4.2426), "frzn": ("frozen", 5.7071), "grnd": ("ground", 5.5255), "grl": ("grilled", 2.8775),
        "moz": ("moz", None), "milk": ("milkshake", 1.8568), "chz": ("chz", None), "xyz": ("xyz", None), "a": ("a", None),
    }
    left = vocab.expand_tokens(tokens, words, known_words=spark.createDataFrame([("milk",)], "word string"))
    assert left.where("token = 'milk'").first().expanded == "milk"


def test_normalised_items(spark, words):
    items = spark.createDataFrame([(1, "CHK  brst, 2 lb."), (2, ""), (3, None), (4, "Frzn pc")], "id bigint, item_name string")
    expansions = vocab.expand_tokens(vocab.tokens_of(items), words)
    got = {r.id: (r.normalized, r.was_normalized) for r in vocab.normalize_items(items, expansions).collect()}
    assert got == {1: ("chicken breast 2", True), 2: ("", False), 3: ("", False), 4: ("frozen", True)}
    info = {r.id: r for r in vocab.abbreviation_info(items, expansions).collect()}
    assert info[1].resolved_tokens == {"CHK": "chicken"} and info[1].unresolved_tokens == ["lb."[:0] or "lb"][:0] and not info[2].has_abbreviations
    assert info[4].resolved_tokens == {"Frzn": "frozen"} and info[4].unresolved_tokens == ["pc"]


def test_similarity(spark):
    names = ["chicken breast boneless", "ground beef", "olive oil extra virgin", "mozzarella cheese shredded", "sparkling water"]
    stock = spark.createDataFrame([(i, n, f"L{i}") for i, n in enumerate(names)], "ord bigint, ingredient string, predicted_label string")
    queries = spark.createDataFrame([(q,) for q in ("chicken breast boneless", "beef ground", "olive oil", "chiken brest", "zzz", "qqq")], "query string")
    top = similarity.similarity_topk(queries, similarity.build_tfidf(stock), stock)
    got = {r["query"]: (r["item"], r.cosine, r.ratio, r.hybrid) for r in top.where("rank = 1").collect()}
    assert got["chicken breast boneless"] == (names[0], 1.0, 1.0, 1.0) and got["beef ground"] == (names[1], 1.0, 1.0, 1.0)
    assert got["olive oil"] == (names[2], 0.6648, 0.5806, 0.6227) and got["chiken brest"] == (names[0], 0.5843, 0.6857, 0.6350)
    assert got["zzz"] == (names[3], 0.1189, 0.1379, 0.1284)
    assert all(r["count"] == 5 for r in top.groupBy("query").count().collect())


def test_in_order_resolution(spark):
    rows = [(1, "h1", "WALMART", "2024-01-01", "47.32"), (2, "h1", "anything", "2024-01-09", "1.00"), (3, "h3", "WAL-MART", "2024-01-01", "47.32"), (4, "h3", "TARGET", "2024-01-02", "10.00"), (5, "h5", "WALMART", None, "47.32")]
    bills = spark.createDataFrame(rows, "bill_id bigint, image_hash string, store string, date string, total string").select("bill_id", "image_hash", "store", F.col("date").cast("date"), F.col("total").cast("decimal(12,2)"))
    got = {r.bill_id: (r.accepted, r.dup_of, r.layer) for r in dedup.resolve_batch(bills).collect()}
    assert got == {1: (True, None, None), 2: (False, 1, "hash"), 3: (False, 1, "content"), 4: (True, None, None), 5: (True, None, None)}
    chain = [(i, f"x{i}", s, "2024-01-01", "5.00") for i, s in enumerate(["ABCDEFGHIJ", "ABCDEFGHI", "ABCDEFG"])]
    df = spark.createDataFrame(chain, "bill_id bigint, image_hash string, store string, date string, total string").select("bill_id", "image_hash", "store", F.col("date").cast("date"), F.col("total").cast("decimal(12,2)"))
    assert [r.accepted for r in dedup.resolve_batch(df).orderBy("bill_id").collect()] == [True, False, True]
    assert dedup.resolve_batch(df.limit(0)).collect() == []


def _ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return 2 * row[-1] / (len(a) + len(b)) if a and b else 0.0


@pytest.mark.parametrize("seed", range(3))
def test_resolution_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    names = ["ABCDEFGHIJ", "ABCDEFGHI", "ABCDEFGHIX", "ABCDEFG", "ZZZZZZ"]
    rows = [(i, rng.choice(["", "h1", "h2", "h3", f"u{i}"]), rng.choice(names), rng.choice([None, "2024-01-01", "2024-01-02"]), rng.choice(["1.00", "2.00"])) for i in range(40)]
    df = spark.createDataFrame(rows, "bill_id bigint, image_hash string, store string, date string, total string").select("bill_id", "image_hash", "store", F.col("date").cast("date"), F.col("total").cast("decimal(12,2)"))
    stored, want = [], {}
    for b in rows:
        match = [s for s in stored if (b[1] and s[1] == b[1]) or (b[3] and s[3] == b[3] and s[4] == b[4] and _ratio(s[2], b[2]) >= 0.85)]
        want[b[0]] = match[0][0] if match else None
        if not match:
            stored.append(b)
    assert {r.bill_id: r.dup_of for r in dedup.resolve_batch(df).collect()} == want
    first, second = df.where("bill_id < 20"), df.where("bill_id >= 20")
    done = dedup.resolve_batch(first)
    history = first.join(done.where("accepted"), "bill_id", "left_semi")
    assert {r.bill_id: r.dup_of for r in dedup.resolve_batch(second, history).collect()} == {k: v for k, v in want.items() if k >= 20}


def test_serials(spark):
    serial = lambda *v: dedup.next_serial(spark.createDataFrame([(x,) for x in v], "serial_no string")).first().next_serial
    assert (serial(), serial("4", "9", "x"), serial("x", None)) == (1, 10, 3)
    bills = spark.createDataFrame([(i * 3,) for i in range(50)], "bill_id bigint").repartition(4)
    got = dedup.assign_serials(bills, spark.createDataFrame([("7",)], "serial_no string")).orderBy("bill_id").collect()
    assert [r.serial_no for r in got] == list(range(8, 58))


def test_field_scores(spark):
    score = lambda p, g, kind, **o: spark.createDataFrame([(p, g)], "p string, g string").select(metrics.field_score("p", "g", kind, **o).alias("s")).first().s
    assert score("", "SHOP", "fuzzy") == 1.0 and score("", "SHOP", "fuzzy", strict_empty=True) == 0.0
    assert score("10.01", "10.00", "float") == 1.0 and score(None, "10.00", "float") == 0.0 and score("1", None, "float") is None
    assert score("01/05/2024", "2024-01-05", "date") == 1.0 and score("**** 1234", "1234", "card") == 1.0
    assert score("2:05 PM", "14:05", "time") == 1.0 and score("a", "b", "exact") == 0.0


def test_greedy_items(spark):
    match = lambda p, g: tuple(spark.createDataFrame([(p, g)], "p array<string>, g array<string>").select(metrics.match_items(F.col("p"), F.col("g")).alias("m")).first().m)
    assert match([], []) == (1.0, 1.0, 1.0) == match(None, None) and match(["a"], []) == (0.0, 0.0, 0.0)
    assert match(["milk", "whole milk"], ["WHOLE MILK", "MILK"]) == (1.0, 1.0, 1.0)
    assert match(["milk"], ["milk", "milk"]) == (1.0, 0.5, pytest.approx(2 / 3))


def test_early_stopping(spark):
    f1 = [0.807322, 0.853515, 0.852155, 0.865952, 0.865203, 0.865766, 0.866191, 0.863351, 0.866808, 0.865523, 0.866039, 0.866027, 0.9]
    history = spark.createDataFrame([("r", i + 1, f) for i, f in enumerate(f1)], "run string, epoch int, val_macro_f1 double")
    assert tuple(metrics.early_stopping(history).first()) == ("r", 9, 0.866808, 12)


def test_metrics_and_weights(spark):
    rows = spark.createDataFrame([("a", "a")] * 3 + [("a", "b"), ("b", "b"), ("c", "a")], "t string, p string")
    got = metrics.classification_metrics(rows, "t", "p", ("a", "b", "c", "d")).first()
    assert got.accuracy == 0.666667 and got.per_class_f1 == {"a": 0.75, "b": 0.6667, "c": 0.0, "d": 0.0} and got.macro_f1 == 0.472222
    total = metrics.core_mean(F.array(F.lit(1.0), F.lit(None), F.lit(0.0)))
    assert spark.range(1).select(total.alias("m")).first().m == 0.5
    weights = {r.label: r.weight for r in prep.class_weights(spark.createDataFrame([("x",)] * 3 + [("y",)], "l string"), "l", ("x", "y", "z")).collect()}
    assert weights == {"x": 0.444444, "y": 1.333333, "z": 1.333333}


def test_splits_are_disjoint_and_capped(spark):
    rows = spark.createDataFrame([(i, f"L{i % 3}", "t", "high") for i in range(300)] + [(999, "Other", "t", "high"), (998, "L0", None, "high"), (997, "L0", "t", "low")], "id bigint, label string, text string, confidence string")
    done = prep.prepare(rows, "label", "text", "id", cap=10)
    assert done.count() == 300 and done.select("id").distinct().count() == 300
    assert {(r.label, r.split): r["count"] for r in done.groupBy("label", "split").count().collect()} == {(f"L{i}", s): n for i in range(3) for s, n in (("train", 80), ("val", 10), ("test", 10))}
    assert done.where("downsampled").groupBy("label").count().agg(F.max("count")).first()[0] == 10


def test_queues_and_labels(spark):
    rows = [("auto", False, None), ("auto", True, None), ("verify", False, "high"), ("verify", True, "low"), ("verify", False, None), ("human", True, "high")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, routing string, flagged_unresolved boolean, verdict_confidence string")
    got = sorted((r.id, r.queue) for r in classify.queues(df).collect())
    assert got == [(1, "low_confidence"), (1, "unresolved"), (2, "low_confidence"), (3, "human_review"), (3, "unresolved"), (4, "human_review"), (5, "human_review"), (5, "unresolved")]
    labels = [r.l for r in df.select(classify.final_label("routing", F.lit("P"), F.lit("V"), "verdict_confidence").alias("l")).collect()]
    assert labels == ["P", "P", "V", classify.HUMAN_REVIEW, classify.HUMAN_REVIEW, classify.HUMAN_REVIEW]


def test_messages(spark):
    rows = [("How much?",), ("show me",), ("hello",), (None,), ("",), (" RESET ",)]
    df = spark.createDataFrame(rows, "text string")
    assert [r.q for r in df.select(M.is_question("text").alias("q")).collect()] == [True, True, False, False, False, True]
    guard = lambda t, **o: spark.createDataFrame([(t,)], "s string").select(M.blocked_token("s", **o).alias("b")).first().b
    assert guard("DROP TABLE x") == "drop " and guard("select 'update '") == "update " and guard("drop\nx") is None
    assert guard("drop\nx", strict=True) == "drop" and guard("select 'update '", strict=True) is None and guard("select 1; select 2", strict=True) == ";"
    reply = spark.createDataFrame([("Sure <SQL>\nSELECT 1\n</sql> done <sql>x</sql>",), ("none",)], "r string")
    assert [tuple(r) for r in reply.select(M.extract_sql("r"), M.strip_sql("r")).collect()] == [("SELECT 1", "Sure  done"), (None, "none")]
    verdict = spark.createDataFrame([('```json\n{"final_label": "Dairy", "confidence": "High"}\n```',), ('{"final_label": "Toys"}',), ("oops",)], "r string")
    got = [tuple(r.v)[:2] for r in verdict.select(M.parse_verdict("r", F.lit("Herbs"), prep.LABELS).alias("v")).collect()]
    assert got == [("Dairy", "high"), ("Herbs", "low"), ("Herbs", "low")]


def test_bill_grain(spark):
    rows = [(1, "A", "2024-01-01", 10, "x", 4), (1, "A", "2024-01-01", 10, "y", 6), (2, "B", "2024-01-02", 5, "Unknown", None)]
    items = spark.createDataFrame(rows, "serial_no bigint, store_name string, invoice_date string, total int, item_name string, item_price int").withColumn("invoice_date", F.col("invoice_date").cast("date"))
    assert spend.spend_by(items, []).first().spend == 15 and spend.spend_by(items, [], grain="item").first().spend == 10
    assert {r.serial_no: r.item_count for r in spend.bills_of(items).collect()} == {1: 2, 2: 0}
    assert spend.last_month(items, "2024-02-10").first().spend == 15 and spend.last_week(items, "2024-01-08").first().spend == 5


def test_profile(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", None), (None, "b", None)], "n int, s string, d date")
    got = {r.column: r for r in profile(df).collect()}
    assert (got["n"].min, got["n"].max, got["n"].row_count, got["n"].kind) == ("1", "2", 3, "numeric") and got["s"].samples == ["a", "b"] and got["d"].samples == [] and got["d"].kind == "date"
    assert {r.line for r in profile_lines(profile(df)).collect()} >= {"  - s (STRING) | e.g. a, b"}


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,t,x\n1,14:32:10,\n2,09:00,\n")
    df = T.read_any_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"a": "int", "t": "string", "x": "string"} and spark.table("data").count() == 2
    head = ",".join(f.split()[0] for f in T.BILL.split(", "))
    (tmp_path / "b.csv").write_text(f'{head}\n1,f,S,Not found,Not found,cash,2024-01-01 10:00:00,me,h,Milk,"1,234.50",Dairy\nbroken,row\n')
    bills = T.read_bills(spark, str(tmp_path / "b.csv")).collect()
    assert len(bills) == 1 and bills[0].total is None and str(bills[0].item_price) == "1234.50" and bills[0].invoice_date is None
    assert T.read_bills(spark, str(tmp_path / "none")).collect() == []
    (tmp_path / "img").mkdir()
    (tmp_path / "img/a.png").write_bytes(b"abc")
    images = T.image_hashes(spark, str(tmp_path / "img"))
    assert images.first().image_hash == "900150983cd24fb0d6963f7d28e17f72"
    (tmp_path / "gold").mkdir()
    for n, image in (("1", "a.png"), ("2", "lost.png")):
        (tmp_path / f"gold/{n}.json").write_text('{"receipt_id": "%s", "image_file": "%s", "fields": {"tax": "1"}, "items": [{"name": "x"}]}' % (n, image))
    assert [r.receipt_id for r in T.read_gold(spark, str(tmp_path / "gold"), images).collect()] == ["1"]
    (tmp_path / "run.json").write_text('{"model": "m", "per_class_f1": {"a": 0.5}, "best_epoch": 2}')
    runs = T.read_runs(spark, [str(tmp_path / "run.json"), str(tmp_path / "missing.json")]).collect()
    assert [(r.model, r.per_class_f1, r.file) for r in runs] == [("m", {"a": 0.5}, "run.json")]
    bills = spark.createDataFrame([(1, [("x", "1,000.00")]), (2, [])], "bill_id int, items array<struct<name:string,price:string>>")
    assert sorted((r.bill_id, r.item_name, r.item_price and str(r.item_price)) for r in T.bill_rows(bills).collect()) == [(1, "x", "1000.00"), (2, "Unknown", None)]
    T.reset_bills(spark, str(tmp_path / "bills"))
    assert T.read_bills(spark, str(tmp_path / "bills"), "parquet").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from tillwork.streaming import jobs

    rng = random.Random(1)
    rows = [(i, rng.choice(["h1", "h2", f"u{i}"]), rng.choice(["ABCDEFGHIJ", "ABCDEFGHI"]), "2024-01-01", rng.choice(["1.00", "2.00"])) for i in range(30)]
    df = spark.createDataFrame(rows, "bill_id bigint, image_hash string, store string, date string, total string").select("bill_id", "image_hash", "store", F.col("date").cast("date"), F.col("total").cast("decimal(12,2)"))
    path = str(tmp_path / "table")
    jobs.start_ingest_stream(jobs.in_parts(df, "bill_id", 3, str(tmp_path / "in")), path, str(tmp_path / "ck")).awaitTermination()
    want = sorted(r.bill_id for r in dedup.resolve_batch(df).where("accepted").collect())
    assert sorted(r.bill_id for r in jobs.stored_bills(spark, path).collect()) == want
    last = df.where("bill_id >= 20")
    jobs.ingest_batch(last, 2, path)  # a replay
    assert sorted(r.bill_id for r in jobs.stored_bills(spark, path).collect()) == want


def test_known_and_repeated_images_are_dropped_from_all_submissions(spark):
    import duckdb

    from tillwork.plans import fixtures, oracles, queries

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in ("orders", "lineitem", "part", "supplier"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = sorted(r[0] for r in db.execute(oracles.oracle_sql()["d01_all_images"]).fetchall())
    got = sorted(r.bill_id for r in queries.queries()["d01_all_images"](spark, sf).collect())
    assert got == want
    kinds = {r["v"]: r["count"] for r in fixtures.submissions(spark, sf).selectExpr("bill_id % 10 AS v").groupBy("v").count().collect()}
    assert kinds[1] > 0 and kinds[3] > 0 and len(got) == kinds[2] + kinds[3], "the anti-join drops every resubmitted image, the window every copy"
