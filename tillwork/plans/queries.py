"""The registered queries over the supplied tables, one or more per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.functions import messages as M
from tillwork.functions import receipts as R
from tillwork.functions import strings as S
from tillwork.functions.folders import folder, saved
from tillwork.operators import classify, dedup, metrics, prep, similarity, spend, training, vocab
from tillwork.operators.profile import distinct_values, preview, profile, profile_lines
from tillwork.plans import fixtures as X
from tillwork.sources import bill_store, tables as T
from tillwork.streaming import jobs

FIELDS = {
    "b01_store": ("store", R.detect_store), "b02_date": ("date", R.extract_date), "b03_time": ("time", R.extract_time), "b04_subtotal": ("subtotal", R.extract_subtotal),
    "b05_tax": ("tax", R.extract_tax), "b06_total": ("total", R.extract_total), "b07_card": ("card", R.extract_card_last4), "b08_payment_method": ("payment_method", R.extract_payment_method),
    "b09_receipt_number": ("receipt_number", R.extract_receipt_number),
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels")


def _names(items):
    return F.array_join(F.transform(items, lambda i: F.concat(i["name"], F.lit("="), i["price"])), ";")


def b10_items(spark, sf):
    return X.receipts(spark, sf).select("receipt_id", _names(R.extract_items(F.col("text"))).alias("items"))


def b11_all_fields(spark, sf):
    got = R.extract_receipts(X.receipts(spark, sf))
    return got.withColumn("items", F.size("items").cast("bigint"))


def _field(name, f):
    return lambda spark, sf: X.receipts(spark, sf).select("receipt_id", f(F.col("text")).alias(name))


def a04_bill_rows(spark, sf):
    """Bills with item arrays to rows, with serial numbers and placeholders."""
    bills = R.extract_receipts(X.receipts(spark, sf)).select(F.col("receipt_id").alias("bill_id"), "store", "total", F.when(F.col("receipt_id") % 11 != 0, F.col("items")).alias("items"))
    rows = T.bill_rows(bills)
    return rows.groupBy("bill_id").agg(F.count("*").alias("rows"), F.sum("item_price").cast("double").alias("items_total"), F.max(F.when(F.col("item_name") == "Unknown", 1).otherwise(0)).cast("bigint").alias("placeholder"))


def a01_stored_bills(spark, sf):
    """Bills written as parquet, read back by the bill schema, and counted."""
    path = folder(spark, "stored")
    T.reset_bills(spark, path)
    T.append_bills(X.bill_items(spark, sf).withColumns({c: F.lit(None).cast(k) for c, k in (f.split() for f in T.BILL.split(", ")) if c in ("bill_file", "card_used", "received_at", "sender", "image_hash")}), path)
    return T.read_bills(spark, path, "parquet").agg(F.count("*").alias("rows"), F.count_distinct("serial_no").alias("bills"), F.sum("item_price").cast("double").alias("items_total"))


def a02_any_csv(spark, sf):
    path = folder(spark, "csv")
    spark.read.parquet(f"{sf}/nation.parquet").write.option("header", True).csv(path)
    T.read_any_csv(spark, path, "data")
    return spark.sql("SELECT n_regionkey, count(*) AS n, max(n_name) AS last FROM data GROUP BY n_regionkey")


def a03_registered_frame(spark, sf):
    T.register(spark.read.parquet(f"{sf}/customer.parquet"), "data")
    return spark.sql("SELECT c_mktsegment, count(*) AS n, cast(sum(cast(c_acctbal AS decimal(12,2))) AS double) AS balance FROM data GROUP BY c_mktsegment")


def a08_inventory(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet")
    rows = parts.select((F.col("p_partkey") + 1).alias("ord"), F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")).alias(" ingredient "), F.when(F.col("p_partkey") % 13 != 0, F.col("p_type")).alias("predicted_label"))
    return T.load_inventory(rows).select("ord", "ingredient", "predicted_label")


def a09_review_queues(spark, sf):
    path = folder(spark, "queues")
    T.append_queues(classify.queues(_routed(spark, sf)).select("queue", "doc_id"), path)
    return spark.read.json(path).groupBy("queue").agg(F.count("*").alias("n"), F.count("timestamp").alias("stamped"))


def a11_split_files(spark, sf):
    path = folder(spark, "splits")
    T.write_splits(j09_prepared(spark, sf), path)
    files = spark.read.parquet(path).select("split").unionByName(spark.read.parquet(f"{path}-downsampled").select(F.lit("downsampled").alias("split")))
    return files.groupBy("split").agg(F.count("*").alias("n"))


#: Tasks that write files of a row each; a small table is one input partition, and a file takes some milliseconds.
FILE_TASKS = 96


def _file_a_row(rows, path):
    """rows (value), or (k, value) with k in the path, as text files, one a row, made by many tasks at once. Without k no folders are made."""
    spread = rows.repartition(FILE_TASKS).write.option("maxRecordsPerFile", 1)
    (spread.partitionBy("k") if "k" in rows.columns else spread).text(path)
    return path


def a06_image_hashes(spark, sf):
    path = _file_a_row(spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("value")), folder(spark, "images"))
    return T.image_hashes(spark, path).select(F.regexp_extract("path", r"k=(\d+)", 1).cast("bigint").alias("s_suppkey"), "image_hash")


def a07_gold_with_images(spark, sf):
    """Gold labels in a file each; those whose image isn't there are left out."""
    own = spark.read.parquet(f"{sf}/supplier.parquet")
    name = F.concat(F.col("s_suppkey").cast("string"), F.lit(".png"))
    label = F.to_json(F.struct(F.col("s_suppkey").cast("string").alias("receipt_id"), name.alias("image_file"), F.struct(F.col("s_name").alias("merchant_name")).alias("fields")))
    path = _file_a_row(own.select(label.alias("value")), folder(spark, "gold"))
    images = own.where("s_nationkey < 12").select(F.concat(F.lit("file:/images/"), name).alias("path"))
    return T.read_gold(spark, path, images).select("receipt_id", F.col("fields.merchant_name").alias("merchant_name"))


def a10_metric_files(spark, sf):
    path = folder(spark, "metrics")
    per = saved(d08_scored_receipts(spark, sf), "scored")
    T.write_metrics(per, metrics.summarize_metrics(per.drop("receipt_id")), path)
    return spark.read.json(f"{path}/per_receipt").agg(F.count("*").alias("receipts"), F.round(F.avg("overall_score"), 4).alias("mean")).crossJoin(spark.read.json(f"{path}/summary").select("tax", "overall_score"))  # a row each


def a12_run_files(spark, sf):
    """Run results of the files that are there; a missing one is passed over."""
    runs = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_orderpriority").alias("model")).agg(F.count("*").cast("int").alias("best_epoch"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("test_accuracy"))
    path = folder(spark, "runs")
    runs.select(F.element_at(F.split("model", "-"), 1).alias("k"), F.to_json(F.struct("*")).alias("value")).write.partitionBy("k").text(path)
    return T.read_runs(spark, [f"{path}/k={k}" for k in (1, 2, 3, 4, 5, 9)]).select("model", "best_epoch", "test_accuracy")


def c09_broken_rows(spark, sf):
    """Bills in CSV files; lines of under nine columns, here those of open orders, are left out."""
    orders, k = spark.read.parquet(f"{sf}/orders.parquet"), F.col("o_orderkey").cast("string")
    whole = F.concat_ws(",", k, F.lit("f"), F.lit("Not found"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("Not found"), F.lit("cash"), F.lit(""), F.lit("me"), F.lit("h"), "o_orderpriority", F.concat(F.lit('"'), F.format_number("o_totalprice", 2), F.lit('"')), F.lit("Dairy"))
    lines = orders.select(F.pmod("o_custkey", F.lit(8)).alias("p"), F.lit(1).alias("o"), F.when(F.col("o_orderstatus") == "O", F.concat_ws(",", k, F.lit("f"))).otherwise(whole).alias("value"))
    heads = lines.select("p").distinct().select("p", F.lit(0).alias("o"), F.lit(",".join(f.split()[0] for f in T.BILL.split(", "))).alias("value"))
    path = folder(spark, "bills")
    lines.unionByName(heads).repartition("p").sortWithinPartitions("p", "o").select("p", "value").write.partitionBy("p").text(path)
    return T.read_bills(spark, path).select("serial_no", "store_name", F.col("invoice_date").cast("string").alias("day"), "item_name", F.col("item_price").cast("double").alias("item_price"))


def c01_is_question(spark, sf):
    return X.chat(spark, sf).select("conv_id", "turn", M.is_question("text").alias("is_question"))


def c02_control_command(spark, sf):
    word = F.element_at(F.array(*map(F.lit, ("Reset ", " start OVER", "refresh data", "reload", "resets", ""))), (F.pmod("conv_id", F.lit(6)) + 1).cast("int"))
    return X.chat(spark, sf).select("conv_id", "turn", M.control_command(word).alias("command"))


def c04_routes(spark, sf):
    media = F.element_at(F.array(F.lit(None), F.lit("image/png"), F.lit("application/pdf"), F.lit("IMAGE/JPEG")), (F.pmod("turn", F.lit(4)) + 1).cast("int"))
    rows = X.chat(spark, sf).withColumn("media", media)
    return M.route_messages(rows, "text", "media").groupBy("route").agg(F.count("*").alias("n"))


def c05_blocked(spark, sf):
    return X.chat(spark, sf).select("conv_id", "turn", F.trim(M.blocked_token("text")).alias("blocked"))


def c05_blocked_strict(spark, sf):
    sql = F.element_at(F.array(*map(F.lit, ("DROP TABLE x", "select 'update '", "drop\nx", "select 1; select 2", "select dropped from t", "select 1;"))), (F.pmod("conv_id", F.lit(6)) + 1).cast("int"))
    return X.chat(spark, sf).select("conv_id", "turn", M.blocked_token(sql, strict=True).alias("blocked"))


def c06_training_rows(spark, sf):
    return prep.filter_training_rows(X.labelled(spark, sf), "label", "text", drop_label="es").select("doc_id", "label", "confidence")


def c07_label_check(spark, sf):
    return prep.check_labels(X.labelled(spark, sf), "label", 4)


def d01_known_images(spark, sf):
    rows = X.submissions(spark, sf)
    return dedup.drop_known_hashes(rows.where("bill_id % 20 >= 10"), rows.where("bill_id % 20 < 10")).select("bill_id")


def d01_all_images(spark, sf):
    """Originals are history and all other submissions new, with second copies of images that history hasn't."""
    rows = X.submissions(spark, sf)
    again = rows.where("bill_id % 10 = 3").withColumn("bill_id", F.col("bill_id") + 1)
    return dedup.drop_known_hashes(rows.where("bill_id % 10 <> 0").unionByName(again), rows.where("bill_id % 10 = 0")).select("bill_id")


def d02_find_duplicates(spark, sf):
    rows = X.submissions(spark, sf)
    return dedup.find_duplicates(rows.where("bill_id % 10 <> 0"), rows.where("bill_id % 10 = 0"))


def d04_resolve_batch(spark, sf):
    return dedup.resolve_batch(X.submissions(spark, sf))


def e02_serials(spark, sf):
    rows = X.submissions(spark, sf)
    history = rows.where("bill_id % 10 = 0").select(F.col("bill_id").cast("string").alias("serial_no"))
    return dedup.assign_serials(rows.where("bill_id % 10 <> 0").select("bill_id"), history).select("bill_id", "serial_no")


def d05_topk(spark, sf):
    stock = X.inventory(spark, sf)
    top = similarity.similarity_topk(X.noisy_items(spark, sf).select(F.lower("item_name").alias("query")), similarity.build_tfidf(stock), stock)
    return top.select("query", "rank", "item", "label", "cosine", "ratio", "hybrid")


def d06_expansions(spark, sf):
    docs = X.english(spark, sf)
    tokens = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token")).where("length(token) <= 5")
    return vocab.expand_tokens(tokens, vocab.build_vocab(docs, "text")).select("token", "expanded", F.round("score", 4).alias("score"), "method")


def d10_normalized(spark, sf):
    items, words = X.noisy_items(spark, sf), vocab.build_vocab(X.english(spark, sf), "text")
    return vocab.normalize_items(items, vocab.expand_tokens(vocab.tokens_of(items), words)).select("ord", "normalized", "was_normalized")


def i19_abbreviations(spark, sf):
    items, words = X.noisy_items(spark, sf), vocab.build_vocab(X.english(spark, sf), "text")
    info = vocab.abbreviation_info(items, vocab.expand_tokens(vocab.tokens_of(items), words))
    return info.select("ord", "has_abbreviations", "has_unresolved", F.array_join("unresolved_tokens", ",").alias("unresolved"), F.size("resolved_tokens").cast("bigint").alias("n_resolved"))


def e01_vocabulary(spark, sf):
    return vocab.build_vocab(X.english(spark, sf), "text")


def e12_idf(spark, sf):
    return similarity.document_frequency(X.inventory(spark, sf)).select("gram", "df", F.round("idf", 6).alias("idf"))


def j01_weights(spark, sf):
    return similarity.build_tfidf(X.inventory(spark, sf)).select("ord", "gram", F.round("weight", 5).alias("weight"))


def j04_similarity_classes(spark, sf):
    found = similarity.classify_by_similarity(X.noisy_items(spark, sf), X.inventory(spark, sf), vocab.build_vocab(X.english(spark, sf), "text"))
    return found.select("input", "normalized", "matched_item", "decision", "final_label", "final_source")


def e05_class_counts(spark, sf):
    return prep.class_counts(prep.stratified_split(X.labelled(spark, sf), "label", "doc_id"), "label", "split")


def e06_imbalance(spark, sf):
    rows = X.labelled(spark, sf)
    return prep.imbalance(rows, prep.cap_per_class(rows, "label", "doc_id", cap=100), "label")


def e07_class_weights(spark, sf):
    return prep.class_weights(X.labelled(spark, sf), "label", ("de", "en", "es", "fr", "it"))


def e14_value_counts(spark, sf):
    return prep.value_counts(X.labelled(spark, sf), "confidence")


def f01_cap(spark, sf):
    return prep.cap_per_class(X.labelled(spark, sf), "label", "doc_id", cap=20).select("doc_id", "label")


def f02_split(spark, sf):
    return prep.stratified_split(X.labelled(spark, sf), "label", "doc_id").select("doc_id", "split")


def j09_prepared(spark, sf):
    return prep.prepare(X.labelled(spark, sf), "label", "text", "doc_id", cap=20, drop_label="it").select("doc_id", "label", "split", "downsampled")


def i25_label_ids(spark, sf):
    return prep.label_ids(X.labelled(spark, sf), "label").withColumn("id", F.col("id").cast("bigint"))


def e08_metrics(spark, sf):
    return metrics.classification_metrics(X.predictions(spark, sf), "truth", "pred", ("de", "en", "es", "fr")).select("accuracy", "macro_f1")


def e09_confusion(spark, sf):
    return metrics.confusion_matrix(X.predictions(spark, sf), "truth", "pred", ("de", "en", "es", "fr"))


def e10_report(spark, sf):
    return metrics.classification_report(X.predictions(spark, sf), "truth", "pred", ("de", "en", "es", "fr"))


def _runs(spark, sf):
    """Runs as per-class F1 of four sources' worth of predictions."""
    rows = X.predictions(spark, sf).withColumn("model", F.concat(F.lit("run"), (F.col("doc_id") % 4).cast("string")))
    out = None
    for i in range(4):
        one = metrics.classification_metrics(rows.where(F.col("doc_id") % 4 == i), "truth", "pred").select(F.lit(f"run{i}").alias("model"), "per_class_f1")
        out = one if out is None else out.union(one)
    return out


def e13_compare_runs(spark, sf):
    return metrics.compare_runs(_runs(spark, sf)).select("model", "label", "f1", "best")


def f06_early_stopping(spark, sf):
    """Orders of each priority as runs: months as epochs, the share of finished orders as the metric."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    epoch = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    share = F.round(F.sum((F.col("o_orderstatus") == "F").cast("int")) / F.count("*"), 6)
    runs = orders.groupBy(F.col("o_orderpriority").alias("run"), epoch.cast("int").alias("epoch")).agg(share.alias("val_macro_f1"))
    return metrics.early_stopping(runs)


def d08_scored_receipts(spark, sf):
    """Extraction from printed text against gold labels from the structured columns, of which some fields are wrong or missing, some items lost or added."""
    return metrics.score_receipts(saved(R.extract_receipts(X.receipts(spark, sf)), "extracted"), _gold(spark, sf)).select(
        "receipt_id", *[f for f, _, _ in metrics.FIELDS], F.round("core_field_mean", 6).alias("core_field_mean"), F.round("item_name_f1", 6).alias("item_name_f1"), F.round("overall_score", 6).alias("overall_score")
    )


def _gold(spark, sf):
    k = F.col("receipt_id")
    names = F.when((k % 9 == 0) & (F.size("names") > 1), F.slice("names", F.lit(1), F.size("names") - 1)).when(k % 4 == 1, F.concat(F.array(F.lit("ZZTOP EXTRA")), "names")).otherwise(F.col("names"))
    return X.receipt_truth(spark, sf).select("receipt_id", F.struct(
        F.when(k % 6 == 0, F.lit("Elsewhere")).otherwise(F.initcap("store")).alias("merchant_name"),
        F.when(k % 7 != 0, F.col("day").cast("string")).alias("date"),
        F.when(k % 2 == 0, F.col("hour")).alias("time"), X.money("subtotal").alias("subtotal"),
        F.when(k % 8 == 0, F.concat(F.lit("1"), X.money("tax"))).otherwise(X.money("tax")).alias("tax"),
        X.money("total").alias("total"), F.when(F.col("card").isNull(), "cash").otherwise("visa").alias("payment_method"), F.coalesce("card", F.lit("cash")).alias("card_last4"),
        F.concat(F.lit("A"), F.lpad(k.cast("string"), 8, "0")).alias("receipt_number"),
    ).alias("fields"), F.transform(names, lambda n: F.struct(n.alias("name"))).alias("items"))


def j08_summary(spark, sf):
    return metrics.summarize_metrics(d08_scored_receipts(spark, sf).drop("receipt_id"))


def i07_lcs_ratio(spark, sf):
    n = X.inventory(spark, sf)
    a, b = n.select("ord", F.col("ingredient").alias("a")), n.select((F.col("ord") - 1).alias("ord"), F.col("ingredient").alias("b"))
    return a.join(b, "ord").select("ord", F.round(S.lcs_ratio("a", "b"), 6).alias("ratio"), F.round(S.token_sort_ratio("a", "b"), 6).alias("sorted_ratio"))


def i09_abbreviation_like(spark, sf):
    tokens = X.english(spark, sf).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token")).distinct()
    return tokens.select("token", S.looks_like_abbreviation("token").alias("short"), S.consonant_skeleton("token").alias("skeleton"))


def i14_grams(spark, sf):
    return X.inventory(spark, sf).select("ord", F.explode(S.char_wb_grams("ingredient")).alias("gram")).groupBy("ord", "gram").agg(F.count("*").alias("tf"))


def i02_normalised_values(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    text = F.when(k % 4 == 0, F.date_format(day, "M/d/yyyy")).when(k % 4 == 1, F.date_format(day, "yyyy-MM-dd")).when(k % 4 == 2, F.date_format(day, "MMM d yyyy")).otherwise(F.concat(F.lit(" n/a "), k.cast("string")))
    clock = F.when(k % 3 == 0, F.format_string("%d:05 pm", (k % 12 + 1).cast("int"))).when(k % 3 == 1, F.format_string("%d:07:09", (k % 24).cast("int"))).otherwise("noon")
    price = F.format_number(F.col("o_totalprice"), 2)
    return orders.select("o_orderkey", S.parse_date(text).alias("day"), S.parse_time(clock).alias("clock"), S.parse_float(price).alias("price"), S.norm_str(F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit("! "))).alias("bare"))


def i18_routing(spark, sf):
    return X.scores(spark, sf).select("doc_id", S.route("confidence").alias("routing"), S.decide("confidence").alias("decision"))


def i17_top_scores(spark, sf):
    """The three of some frequent words that a document holds most often, by its own counts."""
    held = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    word = ("the", "der", "que", "les", "und", "una")
    count = lambda w: ((F.length("text") - F.length(F.replace("text", F.lit(w), F.lit("")))) / len(w)).cast("double")
    scores = F.map_from_arrays(F.array(*map(F.lit, word)), F.array(*map(count, word)))
    top = held.select("doc_id", classify.top_scores(scores, 3).alias("t"))
    return top.select("doc_id", F.array_join(F.transform("t", lambda e: e["key"]), ",").alias("top3"), F.col("t")[0]["key"].alias("best"))


def _routed(spark, sf):
    return X.scores(spark, sf).withColumn("routing", S.route("confidence"))


def j06_queues(spark, sf):
    return classify.queues(_routed(spark, sf)).select("doc_id", "queue")


def i26_final_labels(spark, sf):
    rows = _routed(spark, sf).withColumn("p", F.lit("P")).withColumn("v", F.lit("V"))
    return rows.select("doc_id", classify.final_label("routing", "p", "v", "verdict_confidence").alias("final_label"))


def i20_verdicts(spark, sf):
    reply = F.concat(F.lit('```json\n{"final_label": "'), F.when(F.col("doc_id") % 3 == 0, "Dairy").when(F.col("doc_id") % 3 == 1, "Toys").otherwise('Me"at'), F.lit('", "confidence": "HIGH", "reason": "r"}\n```'))
    got = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", M.parse_verdict(reply, F.lit("Herbs"), prep.LABELS).alias("v"))
    return got.select("doc_id", "v.label", "v.confidence")


def i21_sql_of_replies(spark, sf):
    return X.chat(spark, sf).select("conv_id", "turn", M.extract_sql("text").alias("sql"), F.md5(M.strip_sql("text")).alias("rest"))


def i22_formatted(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.select("o_orderkey", S.format_scalar("o_totalprice", "o_totalprice", "double").alias("money"), S.format_scalar(F.col("o_orderkey") * 1234, "n", "bigint").alias("whole"), S.format_scalar(F.col("o_custkey") / 8, "share", "double").alias("fraction"))


def i24_hashes(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", S.content_hash("html").alias("hash"))


def _profiled(name):
    def run(spark, sf):
        p = profile(spark.read.parquet(f"{sf}/{name}.parquet"))
        return p.select("column", "kind", "min", "max", "row_count", F.array_join("samples", "|").alias("samples"))

    return run


def i23_profile_lines(spark, sf):
    return profile_lines(profile(spark.read.parquet(f"{sf}/nation.parquet"))).select("column", "line")


def e15_distinct(spark, sf):
    return distinct_values(spark.read.parquet(f"{sf}/customer.parquet"), "c_mktsegment")


def g03_preview(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").orderBy("o_orderkey").select("o_orderkey")
    rows, total = preview(df)
    return rows.withColumn("total", F.lit(total).cast("bigint"))


def f05_last_turns(spark, sf):
    return M.last_turns(X.chat(spark, sf), 2, "conv_id").select("conv_id", "turn")


def e17_category_month(spark, sf):
    return spend.spend_by(X.bill_items(spark, sf), ["grocery_category", spend.month().alias("month")], grain="item").withColumn("spend", F.col("spend").cast("double"))


def e17_bill_month(spark, sf):
    return spend.spend_by(X.bill_items(spark, sf), [spend.month().alias("month")], "1996-01-01", "1998-01-01").withColumn("spend", F.col("spend").cast("double"))


def e17_last_month(spark, sf):
    return spend.last_month(X.bill_items(spark, sf), "1997-03-15").withColumn("spend", F.col("spend").cast("double"))


def e17_last_week(spark, sf):
    return spend.last_week(X.bill_items(spark, sf), "1997-03-15").withColumn("spend", F.col("spend").cast("double"))


def e17_category(spark, sf):
    return spend.category_spend(X.bill_items(spark, sf), "econ").withColumn("spend", F.col("spend").cast("double"))


def e17_most_visited(spark, sf):
    return spend.most_visited(X.bill_items(spark, sf), 5).withColumn("spend", F.col("spend").cast("double"))


def e16_cube(spark, sf):
    return spend.category_cube(X.bill_items(spark, sf)).withColumn("spend", F.col("spend").cast("double"))


def f08_running(spark, sf):
    return spend.running_spend(X.bill_items(spark, sf)).withColumns({c: F.col(c).cast("double") for c in ("spend", "running")})


def e16_ad_hoc(spark, sf):
    """SQL on the view data: a subquery, HAVING, a window and set operations."""
    T.register(X.bill_items(spark, sf), "data")
    return spark.sql("""
        WITH m AS (SELECT store_name, year(invoice_date) AS y, sum(item_price) AS s FROM data WHERE item_price IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)
        SELECT store_name, y, CAST(s AS double) AS s, CAST(rank() OVER (PARTITION BY y ORDER BY s DESC, store_name) AS bigint) AS place FROM m
        WHERE s > (SELECT avg(s) FROM m) EXCEPT SELECT store_name, y, CAST(s AS double), 1L FROM m WHERE y = 1995
    """)


def d12_joins_over_data(spark, sf):
    T.register(X.bill_items(spark, sf), "data")
    T.register(spark.read.parquet(f"{sf}/orders.parquet"), "orders")
    return spark.sql("""
        WITH first AS (SELECT store_name, min(invoice_date) AS day FROM data GROUP BY store_name)
        SELECT d.store_name, o.o_orderpriority AS priority, count(*) AS n, CAST(sum(d.item_price) AS double) AS spend
        FROM data d JOIN orders o ON d.serial_no = o.o_orderkey JOIN first f ON f.store_name = d.store_name AND d.invoice_date > f.day GROUP BY 1, 2
    """)


def g06_top_bills(spark, sf):
    T.register(X.bill_items(spark, sf), "data")
    return spark.sql("SELECT serial_no, store_name, CAST(max(total) AS double) AS total FROM data GROUP BY 1, 2 ORDER BY total DESC, serial_no LIMIT 25")


def i27_functions_over_data(spark, sf):
    T.register(X.bill_items(spark, sf), "data")
    return spark.sql("""
        SELECT serial_no, item_name, count(*) AS n, max(upper(substr(item_name, 2, 3))) AS part, max(size(split(item_name, ' '))) AS words, max(CAST(date_trunc('MONTH', invoice_date) AS date)) = max(invoice_date) AS first_day,
          max(replace(item_name, 'a', '')) AS bare, max(get_json_object(concat('{"k": [', serial_no, ', 1]}'), '$.k[0]')) AS k, max(array_join(array_sort(split(item_name, ' ')), '-')) AS sorted, max(map('x', serial_no)['x']) AS held
        FROM data GROUP BY serial_no, item_name
    """)


def c10_date_range(spark, sf):
    T.register(X.bill_items(spark, sf), "data")
    return spark.sql("SELECT count(DISTINCT serial_no) AS bills FROM data WHERE invoice_date >= DATE '1997-03-01' - INTERVAL 1 MONTH AND invoice_date < DATE '1997-03-01'")


def _submitted(spark, sf):
    """Receipts as they arrive, with file, sender, time and image hash; every 40th is sent again with another image."""
    text = X.receipts(spark, sf)
    twice = text.select((F.col("receipt_id") * 10).alias("bill_id"), "text").unionByName(text.where("receipt_id % 40 = 0").select((F.col("receipt_id") * 10 + 1).alias("bill_id"), F.concat("text", F.lit("\nCOPY")).alias("text")))
    k = F.col("bill_id")
    return twice.select(k, F.concat(k.cast("string"), F.lit(".jpg")).alias("bill_file"), F.concat(F.lit("+"), (k % 97).cast("string")).alias("sender"), F.timestamp_seconds(k).alias("received_at"), F.md5(k.cast("string")).alias("image_hash"), "text")


def _ingest_options(spark, sf):
    model = saved(classify.count_model(X.inventory(spark, sf), "ingredient", "predicted_label"), "model")
    return {"model": model, "words": saved(vocab.build_vocab(X.english(spark, sf), "text"), "words")}


def _stored(spark, path):
    """Every item row of the store, with the queues that it is in."""
    queues = bill_store.read(spark, path, "queues", jobs.QUEUED).select("serial_no", "item_name", "queue").distinct()
    queues = queues.groupBy("serial_no", "item_name").agg(F.array_join(F.array_sort(F.collect_list("queue")), ",").alias("queues"))  # of three at most
    items = bill_store.read(spark, path, "items", jobs.ITEMS).join(queues, ["serial_no", "item_name"], "left")
    shown = {"invoice_date": F.col("invoice_date").cast("string"), "total": F.col("total").cast("double"), "item_price": F.col("item_price").cast("double"), "received_at": F.unix_timestamp("received_at"), "confidence": F.round("confidence", 6), "queues": F.coalesce("queues", F.lit(""))}
    return items.withColumns(shown).drop("version")


def j07_ingest(spark, sf):
    """Receipt text to stored bills in one commit: extraction, duplicate resolution, serial numbers, item rows with modelled categories, review queues."""
    path = folder(spark, "bill-store")
    jobs.ingest_receipts(_submitted(spark, sf), 0, path, **_ingest_options(spark, sf))
    return _stored(spark, path)


def _trained(spark, sf):
    return prep.stratified_split(X.labelled(spark, sf).select("doc_id", "text", "label"), "label", "doc_id")


def j02_classifier(spark, sf):
    """Accuracy and macro F1 on the test split of the best epoch, by the validation split, of a model trained on the train split with class weights."""
    rows = saved(_trained(spark, sf), "labelled")
    train = rows.where("split = 'train'")
    model = training.train_epochs(train, rows.where("split = 'val'"), "doc_id", "text", "label", prep.class_weights(train, "label"))
    return metrics.classification_metrics(model.score(rows.where("split = 'test'"), "doc_id"), "label", "predicted_label").select("accuracy", "macro_f1", F.lit(model.best_epoch).alias("best_epoch"))


def j02_fitted_once(spark, sf):
    """The same of a model that spark.ml fits in one go."""
    rows = saved(_trained(spark, sf), "labelled")
    train = rows.where("split = 'train'")
    model = classify.train_classifier(train, "text", "label", prep.class_weights(train, "label"), features=1 << 12, iterations=10)
    return metrics.classification_metrics(classify.score_items(rows.where("split = 'test'"), model), "label", "predicted_label").select("accuracy", "macro_f1")


def _shown(scores):
    """A score map as text, by label."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(scores)), lambda e: F.concat(e["key"], F.lit("="), F.format_number(e["value"], 6))), ";")


def j03_scored_items(spark, sf):
    """Test documents by a model table that the train split gave: label, probability, route and the map of all probabilities."""
    rows = saved(_trained(spark, sf), "labelled")
    model = saved(classify.count_model(rows.where("split = 'train'"), "text", "label"), "model")
    scored = classify.score_items(rows.where("split = 'test'"), model, "text", "doc_id")
    top = F.array_join(F.transform(classify.top_scores(F.col("all_scores"), 3), lambda e: e["key"]), ",")
    return scored.select("doc_id", "predicted_label", F.round("confidence", 6).alias("confidence"), "routing", _shown(F.col("all_scores")).alias("all_scores"), top.alias("top3"))


def _verdicts(spark, sf):
    """A reviewer's answers for the items of every other ord: the catalogue's own label, of low confidence for some."""
    both = X.noisy_items(spark, sf).join(X.inventory(spark, sf).select("ord", "predicted_label"), "ord").where("ord % 4 <> 1")
    return both.select(F.col("item_name").alias("input"), F.col("predicted_label").alias("verdict_label"), F.when(F.col("ord") % 3 == 0, "low").otherwise("high").alias("verdict_confidence"))


def j05_categorized(spark, sf):
    """Items by the catalogue's model table: probability, route, verdict, final label and the review queues they enter."""
    model = saved(classify.count_model(X.inventory(spark, sf), "ingredient", "predicted_label"), "model")
    done, entered = classify.categorize(X.noisy_items(spark, sf), model, vocab.build_vocab(X.english(spark, sf), "text"), _verdicts(spark, sf))
    queued = entered.groupBy("input").agg(F.array_join(F.array_sort(F.collect_list("queue")), ",").alias("queues"))
    return done.join(queued, "input", "left").select("input", "normalized", "predicted_label", F.round("confidence", 6).alias("confidence"), "routing", "verdict_label", "final_label", F.coalesce("queues", F.lit("")).alias("queues"))


def s01_ingest_stream(spark, sf):
    """The same receipts as a stream of two files, each resolved against what is stored: the same bills, items and queues as in one batch."""
    stream = jobs.in_parts(_submitted(spark, sf), "bill_id", 2, folder(spark, "arrivals"))
    path = folder(spark, "bill-store")
    jobs.start_ingest_stream(stream, path, folder(spark, "offsets"), jobs.ingest_receipts, **_ingest_options(spark, sf)).awaitTermination()
    return _stored(spark, path)


def s02_dedup_stream(spark, sf):
    rows = X.submissions(spark, sf).select("bill_id", "image_hash", F.timestamp_seconds("bill_id").alias("arrived"))
    stream, path = jobs.in_parts(rows, "bill_id", 2, folder(spark, "arrivals")), folder(spark, "first-images")
    jobs.start_dedup_stream(stream, "3650 days", path, folder(spark, "offsets")).awaitTermination()
    return spark.read.parquet(path).select("image_hash")


def s03_route_stream(spark, sf):
    stream, path = jobs.in_parts(X.chat(spark, sf), "conv_id", 2, folder(spark, "messages")), folder(spark, "routed")
    jobs.route_stream(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", folder(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("conv_id", "turn", "route")


def s04_history_stream(spark, sf):
    stream, checkpoint = jobs.in_parts(X.chat(spark, sf), "turn", 3, folder(spark, "messages")), folder(spark, "history")
    jobs.history_stream(stream, checkpoint, 2, "conv_id").awaitTermination()
    return jobs.latest_history(spark, checkpoint, "conv_id").select("conv_id", "turn")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Receipt text to spend: extraction, duplicate resolution, similarity classification, spend by label and month."""
    bills = R.extract_receipts(X.receipts(spark, sf)).select(F.col("receipt_id").alias("bill_id"), F.lit(None).cast("string").alias("image_hash"), "store", F.to_date(F.nullif("date", F.lit(""))).alias("date"), F.col("total").cast("decimal(12,2)").alias("total"), "items")
    bills = saved(bills)  # extraction runs once
    kept = dedup.resolve_batch(bills).where("accepted").select("bill_id")
    rows = saved(T.bill_rows(bills.join(kept, "bill_id", "left_semi")))
    found = similarity.classify_by_similarity(rows, X.inventory(spark, sf), vocab.build_vocab(X.english(spark, sf), "text")).select(F.col("input").alias("item_name"), "final_label")
    named = rows.join(found, "item_name", "left")
    return named.groupBy("final_label", F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum("item_price").cast("double").alias("spend"), F.count("*").alias("items"))


def queries() -> dict:
    own = {n: f for n, f in globals().items() if n[:1] in "abcdefgijs" and n[1:3].isdigit() and callable(f)}
    own |= {n: _field(c, f) for n, (c, f) in FIELDS.items()}
    own |= {f"e11_profile_{t}": _profiled(t) for t in TABLES}
    return dict(sorted({**own, "flagship": flagship}.items()))
