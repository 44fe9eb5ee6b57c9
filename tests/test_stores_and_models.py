"""The bill store under replays, crashes and races; keyed session state; model tables; epochs; bounded profiles and caps."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tillwork.operators import classify, prep, training
from tillwork.operators.profile import profile
from tillwork.plans import queries
from tillwork.sources import bill_store
from tillwork.streaming import jobs

TABLE = "k bigint, v string"


def rows_of(spark, path):
    return sorted((r.k, r.v, r.version) for r in bill_store.read(spark, path, "t", TABLE).collect())


def test_commits_replays_and_crashes(spark, tmp_path):
    path = str(tmp_path / "store")
    batch = lambda *ks: lambda log: {"t": spark.createDataFrame([(k, f"after {len(log)}") for k in ks], TABLE)}
    assert rows_of(spark, path) == []
    assert bill_store.commit(spark, path, "a", batch(1, 2)) == 1
    assert bill_store.commit(spark, path, "b", batch(3)) == 2
    assert bill_store.commit(spark, path, "a", batch(9)) == 1, "a replay stores nothing"

    def crash(log):
        raise OSError("lost")

    with pytest.raises(OSError):
        bill_store.commit(spark, path, "c", crash)
    # a writer that died between its rows and its entry, and one that left a draft
    spark.createDataFrame([(8, "dead")], TABLE).withColumn("version", F.lit(3).cast("long")).write.parquet(f"{path}/data/dead/t")
    (tmp_path / "store/_log" / f"{3:020d}.json.x.draft").write_text("{")
    assert rows_of(spark, path) == [(1, "after 0", 1), (2, "after 0", 1), (3, "after 1", 2)]
    assert bill_store.commit(spark, path, "c", batch(4)) == 3


def test_two_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "store")
    beaten = []

    def slow(log):
        if not beaten:  # another writer commits while this one works
            beaten.append(bill_store.commit(spark, path, "fast", lambda log: {"t": spark.createDataFrame([(1, "fast")], TABLE)}))
        return {"t": spark.createDataFrame([(2, f"saw {len(log)}")], TABLE)}

    assert bill_store.commit(spark, path, "slow", slow) == 2 and beaten == [1]
    assert rows_of(spark, path) == [(1, "fast", 1), (2, "saw 1", 2)], "the loser works again from what the winner stored"

    def always(log):
        bill_store.commit(spark, path, f"other {len(log)}", lambda log: {"t": spark.createDataFrame([], TABLE)})
        return {"t": spark.createDataFrame([(3, "x")], TABLE)}

    with pytest.raises(bill_store.LostRaces):
        bill_store.commit(spark, path, "never", always, attempts=2)


def receipt(k, store="FRESH MART", items=("CHICKEN BREAST", "ZZQX")):
    lines = "\n".join(f"{n}  {i + 1}.50" for i, n in enumerate(items))
    return (k, f"{k}.jpg", "+1", None, f"h{k}", f"{store}\n01/0{k % 9 + 1}/2024\n{lines}\nTOTAL {k % 7 + 20}.00\nCASH")


def test_receipts_as_batches_and_stream(spark, tmp_path):
    stock = spark.createDataFrame([(1, "chicken breast", "Poultry"), (2, "olive oil", "Oils & Fats")], "ord bigint, ingredient string, predicted_label string")
    words = spark.createDataFrame([], "word string, freq bigint, skeleton string, first string")
    options = {"model": classify.count_model(stock, "ingredient", "predicted_label"), "words": words}
    rows = [receipt(i) for i in range(1, 9)] + [receipt(10 + 1, "FRESH MARTT"), (12, None, None, None, None, None), (13, "13.jpg", "+1", None, "h1", "other\n")]
    got = spark.createDataFrame(rows, jobs.RECEIPT)
    shown = lambda path: sorted(tuple(map(str, r)) for r in bill_store.read(spark, path, "items", jobs.ITEMS).drop("version").collect())
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    jobs.ingest_receipts(got, 0, one, **options)
    jobs.start_ingest_stream(jobs.in_parts(got, "bill_id", 3, str(tmp_path / "in")), two, str(tmp_path / "ck"), jobs.ingest_receipts, **options).awaitTermination()
    assert shown(one) == shown(two)
    items = bill_store.read(spark, one, "items", jobs.ITEMS).collect()
    assert {r.grocery_category for r in items if r.item_name == "CHICKEN BREAST"} == {"Poultry"} and 13 not in {r.bill_id for r in items} and 12 in {r.bill_id for r in items}
    assert sorted({r.serial_no for r in items}) == list(range(1, len({r.bill_id for r in items}) + 1))
    queued = bill_store.read(spark, one, "queues", jobs.QUEUED).collect()
    assert {r.item_name for r in queued if r.queue == "human_review"} == {r.item_name for r in items if r.routing != "auto"} and all(r.serial_no for r in queued)
    assert jobs.ingest_receipts(got, 0, one, **options) == 1 and shown(one) == shown(two), "a replay"


def test_sessions_are_kept_and_forgotten(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(4)}", i, rng.choice(["user", None]), rng.choice(["a", None, ""])) for i in range(40)]
    df = spark.createDataFrame(rows, "session_id string, turn bigint, role string, text string")
    stream = jobs.in_parts(df, "turn", 3, str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    jobs.history_stream(stream, str(tmp_path / "ck"), pairs=2).awaitTermination()
    held = defaultdict(list)
    for r in jobs.latest_history(spark, str(tmp_path / "ck")).orderBy("turn").collect():
        held[r.session_id].append(tuple(r))
    assert held == {s: [r for r in rows if r[0] == s][-4:] for s in {r[0] for r in rows}}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    jobs.history_stream(stream, str(tmp_path / "ck2"), pairs=2, days=1e-8).awaitTermination()
    assert jobs.latest_history(spark, str(tmp_path / "ck2")).collect() == []


def counted(rows):
    grams = lambda t: [t.lower()[i : i + 3] for i in range(len(t) - 2)] if len(t) >= 3 else [t.lower()] * (t != "")
    by = defaultdict(Counter)
    for text, label in rows:
        by[label].update(grams(text))
    kinds = len(set().union(*by.values()))

    def probabilities(text):
        g = grams(text or "")
        s = {label: 10 * sum(math.log(c[x] + 1) - math.log(sum(c.values()) + kinds) for x in g) / len(g) if g else 0 for label, c in by.items()}
        e = {label: math.exp(v - max(s.values())) for label, v in s.items()}
        return {label: round(v / sum(e.values()), 6) for label, v in e.items()}

    return probabilities


def test_model_table(spark):
    train = [("olive oil", "Oils"), ("corn oil", "Oils"), ("whole milk", "Dairy"), ("ab", "Dairy"), ("grün 😀x", "Greens")]
    model = classify.count_model(spark.createDataFrame([*train, (None, "Dairy"), ("x", None)], "text string, label string"), "text", "label")
    asked = [(1, "OLIVE"), (2, "milk oil"), (3, ""), (4, None), (5, "ab"), (6, "zzzz"), (7, "x" * 3000), (8, "grün 😀x"), (8, "grün 😀x")]
    got = classify.score_items(spark.createDataFrame(asked[:-1], "id int, text string"), model, "text", "id").collect()
    want = counted(train)
    assert len(got) == 8
    for r in got:
        p = want(r.text)
        assert all(abs(r.all_scores[x] - p[x]) < 2e-6 for x in p)
        assert r.predicted_label == min(p, key=lambda x: (-p[x], x)) and r.routing == ("auto" if r.confidence >= 0.85 else "verify" if r.confidence >= 0.6 else "human")
    assert classify.score_items(spark.createDataFrame([], "id int, text string"), model, "text", "id").collect() == []


def test_the_best_epoch_is_kept(spark, monkeypatch):
    words = {"a": "alpha beta gamma", "b": "delta kappa sigma", "c": "omega theta lambda"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words[x].split()) for _ in range(4)), x) for i in range(120) for x in [rng.choice("abc")]]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    given = iter([0.5, 0.9, 0.7, 0.8, 0.6, 0.99])
    seen = []
    real = training._epoch

    def epoch(r, w, *rest):
        made = real(r, w, *rest)
        seen.append((w.copy(), made[0]))
        return made

    monkeypatch.setattr(training, "_epoch", epoch)
    monkeypatch.setattr(training, "classification_metrics", lambda *a: spark.createDataFrame([(next(given),)], "macro_f1 double"))
    model = training.train_epochs(df.where("id < 90"), df.where("id >= 90"), "id", "text", "label", epochs=9)
    assert model.best_epoch == 2 and len(seen) == 5, "three epochs without a better one end the training"
    assert (model.weights == seen[1][1]).all() and not (model.weights == seen[-1][1]).all(), "the best, not the last"
    assert all((after[1] == before[0]).all() for after, before in zip(seen, seen[1:])), "each epoch begins with the weights of the one before"
    assert [r.val_macro_f1 for r in model.trace.orderBy("epoch").collect()] == [0.5, 0.9, 0.7, 0.8, 0.6]
    scored = model.score(df.unionByName(spark.createDataFrame([(999, None, None), (998, "", None)], df.schema)), "id").collect()
    assert len(scored) == 122 and sum(r.predicted_label == r.label for r in scored) >= 115
    assert model.table(spark).where("feature = -1").count() == 3


def test_caps_of_large_classes(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 2 == 0, "mid").otherwise(None).alias("label"))
    got = prep.cap_per_class(df, "label", "id", cap=8_000)
    import hashlib

    order = lambda i: (hashlib.md5(f"42|{i}".encode()).hexdigest(), i)
    want = {"big": {i for i in sorted((i for i in range(30_000) if i % 3), key=order)[:8_000]}, "mid": {i for i in range(0, 30_000, 6)}, None: {i for i in range(3, 30_000, 6)}}
    held = defaultdict(set)
    for r in got.collect():
        held[r.label].add(r.id)
    assert held == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number") and "__digits" in plan.split("row_number")[1][:400], "only rows on a class's edge are sorted"


def test_profiles_exchange_one_row_a_task(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("n"), F.concat(F.lit("v"), F.col("id") % 300).alias("s"), F.lit(None).cast("date").alias("d"), F.when(F.col("id") > 5, "x").alias("one"))
    got = {r.column: r for r in profile(df).collect()}
    assert got["n"].samples == ["0", "1", "10", "11"] and got["s"].samples == ["v0", "v1", "v10", "v100"] and got["d"].samples == [] and got["one"].samples == ["x"]
    assert (got["n"].min, got["n"].max, got["n"].row_count) == ("0", "49", 1000)
    assert {r.column: r.samples for r in profile(df.limit(0)).collect()} == dict.fromkeys(df.columns, [])


@pytest.mark.parametrize("name", ["d05_topk", "d06_expansions", "j03_scored_items", "j05_categorized", "j07_ingest", "s01_ingest_stream", "s04_history_stream", "f01_cap"])
def test_sql_of_rebuilt_queries(spark, name):
    import os

    import duckdb

    from tillwork.plans import oracles

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    own = queries.queries()[name](spark, sf)
    want = db.sql(f"SELECT {', '.join(own.columns)} FROM ({oracles.oracle_sql()[name]})").fetchall()
    flat = lambda rows: Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert flat(own.collect()) == flat(want)
