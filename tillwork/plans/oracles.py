"""DuckDB SQL for the registered queries, from structured columns and stated truth rather than from text that the queries make."""

from __future__ import annotations

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"
_ITEMS = f"""
stores AS (
  SELECT l_orderkey, upper(first(s_name ORDER BY {_ORDER})) AS store_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1
), items AS (
  SELECT o_orderkey AS serial_no, store_name, o_orderdate::DATE AS invoice_date, o_totalprice::DECIMAL(12,2) AS total, coalesce(p_name, 'Unknown') AS item_name,
    l.l_extendedprice::DECIMAL(12,2) AS item_price, p_type AS grocery_category
  FROM orders LEFT JOIN stores ON o_orderkey = stores.l_orderkey
  LEFT JOIN (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey) l ON o_orderkey = l.l_orderkey
), bills AS (SELECT serial_no, min(store_name) AS store_name, min(invoice_date) AS invoice_date, min(total) AS total FROM items GROUP BY 1)
"""
_RECEIPTS = f"""
lines AS (
  SELECT *, ((round(l_extendedprice * 100)::BIGINT + 500) // 1000)::BIGINT AS cents FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
), sums AS (
  SELECT l_orderkey AS k, upper(first(s_name ORDER BY {_ORDER})) AS store, sum(cents)::BIGINT AS subtotal, count(*) AS n,
    string_agg(upper(p_name) || '=' || (cents // 100)::VARCHAR || '.' || lpad((cents % 100)::VARCHAR, 2, '0'), ';' ORDER BY {_ORDER}) AS items
  FROM lines GROUP BY 1
), truth AS (
  SELECT k AS receipt_id, store, CASE WHEN k % 10 <> 7 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS date,
    CASE WHEN k % 3 = 0 THEN lpad((k % 24)::VARCHAR, 2, '0') || ':' || lpad((k % 60)::VARCHAR, 2, '0') || ':' || lpad((k % 59)::VARCHAR, 2, '0') ELSE '' END AS time,
    (subtotal / 100)::DOUBLE AS subtotal, ((subtotal * 7 // 100) / 100)::DOUBLE AS tax, ((subtotal + subtotal * 7 // 100) / 100)::DOUBLE AS total,
    CASE WHEN k % 5 = 0 THEN 'cash' ELSE lpad((k % 10000)::VARCHAR, 4, '0') END AS card, CASE WHEN k % 5 = 0 THEN 'CASH' ELSE 'VISA' END AS payment_method,
    'A' || lpad(k::VARCHAR, 8, '0') AS receipt_number, items, n, subtotal AS cents
  FROM sums JOIN orders ON k = o_orderkey
)
"""
_SUBMISSIONS = f"""{_ITEMS}, versions AS (
  SELECT serial_no * 10 AS bill_id, 0 AS v, serial_no AS k FROM bills UNION ALL SELECT serial_no * 10 + 1, 1, serial_no FROM bills WHERE serial_no % 50 = 0
  UNION ALL SELECT serial_no * 10 + 2, 2, serial_no FROM bills WHERE serial_no % 70 = 0 AND store_name IS NOT NULL UNION ALL SELECT serial_no * 10 + 3, 3, serial_no FROM bills WHERE serial_no % 90 = 0
)"""
_LABELLED = """
labelled AS (
  SELECT doc_id, text, lang AS label, quality, toxic, CASE WHEN doc_id % 10 = 0 THEN 'low' WHEN quality = 1 THEN 'high' ELSE 'medium' END AS confidence FROM labels JOIN documents USING (doc_id)
), predictions AS (
  SELECT doc_id, label AS truth, CASE WHEN doc_id % 7 <> 0 THEN label ELSE map {'de': 'en', 'en': 'es', 'es': 'fr', 'fr': 'de'}[label] END AS pred FROM labelled
)"""
_SPLIT = """
placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || doc_id), doc_id) - 1 AS p, count(*) OVER (PARTITION BY label) AS n FROM labelled),
split AS (SELECT *, CASE WHEN p < floor(n * 0.8 + 1e-9) THEN 'train' WHEN p < floor(n * 0.9 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM placed)"""
_CHAT = """
chat AS (
  SELECT conv_id, turn, role, coalesce(text, '') || CASE WHEN conv_id % 3 = 0 THEN ' <SQL>' || chr(10) || 'SELECT ' || conv_id || chr(10) || '</sql>' ELSE '' END
    || CASE WHEN conv_id % 5 = 0 THEN ' DROP table x' ELSE '' END || CASE WHEN conv_id % 7 = 0 THEN ' ? ' ELSE '' END AS text FROM conversations
)"""
_QUESTION = """(ends_with(trim(text, ' ' || chr(10) || chr(9)), '?') OR regexp_extract(lower(trim(text, ' ' || chr(10) || chr(9))), '^\\S+') IN
 ('how','what','when','show','list','which','total','sum','average','who','where','count','give','find','reset','clear','reload','refresh'))"""
_SCORES = """
scores AS (
  SELECT doc_id, (doc_id % 101) / 100 AS confidence, doc_id % 4 = 0 AS flagged, CASE doc_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS said FROM documents
), routed AS (SELECT *, CASE WHEN confidence >= 0.85 THEN 'auto' WHEN confidence >= 0.6 THEN 'verify' ELSE 'human' END AS routing, coalesce(said <> 'low', false) AS sure FROM scores)"""
_STOCK = """
stock AS (
  SELECT row_number() OVER (ORDER BY p_name) AS ord, p_name AS ingredient, first(p_type ORDER BY n DESC, p_type) AS predicted_label
  FROM (SELECT p_name, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_name
)"""
_WORDS = """
tokens AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE lang = 'en'),
vocab AS (
  SELECT w AS word, count(*) AS freq, regexp_replace(w, '[aeiou]', '', 'g') AS skeleton, w[1] AS first FROM tokens
  WHERE length(w) >= 6 AND length(regexp_replace(w, '[^aeiou]', '', 'g')) >= 2 GROUP BY w HAVING count(*) >= 3
)"""


def _lcs(a: str, b: str) -> str:
    return f"""list_reduce(list_transform(string_split({a}, ''), lambda c: [ord(c)::BIGINT]), lambda dp, c: list_reduce(list_transform(range(1, len({b}) + 1), lambda j: [j]),
      lambda acc, j: list_append(acc, CASE WHEN ord(substr({b}, j[1], 1)) = c[1] THEN dp[j[1]] + 1 ELSE greatest(dp[j[1] + 1], acc[len(acc)]) END), [0::BIGINT]),
      list_transform(range(0, len({b}) + 1), lambda z: 0::BIGINT))[len({b}) + 1]"""


def _expanded(source: str) -> str:
    """Tokens of a relation ``source`` (token) with their expansions."""
    return f"""
short AS (SELECT token, token[1] AS first, regexp_replace(token, '[aeiou]', '', 'g') AS s FROM (SELECT DISTINCT token FROM {source})
  WHERE regexp_full_match(token, '[a-z]{{1,5}}') AND length(regexp_replace(token, '[^aeiou]', '', 'g')) <= 1),
skel AS (
  SELECT token, first(word ORDER BY score DESC, word) AS expanded, max(score) AS score FROM (
    SELECT token, word, length(s) / length(skeleton) * ln(1 + freq) AS score FROM short JOIN vocab USING (first)
    WHERE s <> '' AND skeleton <> '' AND length(s) / length(skeleton) >= 0.4 AND regexp_matches(skeleton, array_to_string(string_split(s, ''), '.*'))) GROUP BY token
),
near AS (
  SELECT token, first(word ORDER BY score DESC, word) AS expanded, max(score) AS score FROM (
    SELECT token, word, 200.0 * {_lcs('token', 'word')} / (length(token) + length(word)) AS score FROM (SELECT * FROM short ANTI JOIN skel USING (token)) JOIN vocab ON length(word) <= length(token) / 0.5625 + 1e-9)
  WHERE score >= 72 GROUP BY token
),
expanded AS (
  SELECT DISTINCT t.token, coalesce(skel.expanded, near.expanded, t.token) AS expanded, coalesce(skel.score, near.score) AS score,
    CASE WHEN skel.token IS NOT NULL THEN 'skeleton' WHEN near.token IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS method
  FROM {source} t LEFT JOIN skel USING (token) LEFT JOIN near USING (token)
)"""


_NOISY = """
noisy AS (
  SELECT ord, CASE WHEN ord % 2 = 0 THEN upper(array_to_string(list_transform(string_split(ingredient, ' '), lambda w: CASE WHEN length(w) <= 6 THEN regexp_replace(w, '[aeiou]', '', 'g') ELSE w END), ' ')) || ' 2 lb.'
    ELSE ingredient END AS item_name FROM stock
), parts AS (
  SELECT ord, item_name, list_filter(string_split(trim(regexp_replace(lower(item_name), '[!-/:-@\\[-`{-~ ]+', ' ', 'g')), ' '),
    lambda t: t NOT IN ('oz','lb','lbs','kg','g','ml','l','ct','pk','pkg','ea','each','pc','pcs','piece','pieces','unit','units','')) AS ts FROM noisy
), tok AS (SELECT unnest(ts) AS token FROM parts UNION SELECT unnest(string_split(lower(item_name), ' ')) FROM noisy)"""
_GRAMS = """
padded AS (SELECT ord, ' ' || unnest(string_split(ingredient, ' ')) || ' ' AS w FROM stock),
grams AS (SELECT ord, unnest(flatten(list_transform([2, 3, 4], lambda n: CASE WHEN n = 2 OR length(w) > n - 1 THEN list_transform(range(1, greatest(length(w) - n + 1, 1) + 1), lambda i: substr(w, i, n)) ELSE [] END))) AS gram FROM padded),
tf AS (SELECT ord, gram, count(*) AS tf FROM grams GROUP BY ALL),
idf AS (SELECT gram, count(*) AS df, ln((1 + (SELECT count(*) FROM stock)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY gram),
raw AS (SELECT ord, gram, tf * idf AS w FROM tf JOIN idf USING (gram)),
weights AS (SELECT ord, gram, w / sqrt(sum(w * w) OVER (PARTITION BY ord)) AS weight FROM raw)"""



def _topk(source: str) -> str:
    """The five best catalogue rows of the texts that ``source`` selects, over stock and its gram weights."""
    return f"""
q AS (SELECT DISTINCT {source}),
q_padded AS (SELECT query, ' ' || unnest(list_filter(string_split(query, ' '), lambda t: t <> '')) || ' ' AS w FROM q),
q_grams AS (SELECT query, unnest(flatten(list_transform([2, 3, 4], lambda n: CASE WHEN n = 2 OR length(w) > n - 1 THEN list_transform(range(1, greatest(length(w) - n + 1, 1) + 1), lambda i: substr(w, i, n)) ELSE [] END))) AS gram FROM q_padded),
q_raw AS (SELECT query, gram, t * idf AS w FROM (SELECT query, gram, count(*) AS t FROM q_grams GROUP BY ALL) JOIN idf USING (gram)),
q_weights AS (SELECT query, gram, w / sqrt(sum(w * w) OVER (PARTITION BY query)) AS weight FROM q_raw),
pairs AS (SELECT query, ord, sum(a.weight * b.weight) AS cosine FROM q_weights a JOIN weights b USING (gram) GROUP BY ALL),
led AS (
  SELECT query, ord, ingredient, predicted_label, cosine, array_to_string(list_sort(list_filter(string_split(query, ' '), lambda t: t <> '')), ' ') AS x, array_to_string(list_sort(string_split(lower(ingredient), ' ')), ' ') AS y,
    row_number() OVER (PARTITION BY query ORDER BY cosine DESC, ord) AS lead FROM pairs JOIN stock USING (ord)
), leaders AS (SELECT *, 2.0 * {_lcs('x', 'y')} / (length(x) + length(y)) AS ratio FROM led WHERE lead <= 5),
bars AS (SELECT query, min(0.5 * cosine + 0.5 * ratio) AS bar FROM leaders GROUP BY 1),
others AS (SELECT led.* FROM led JOIN bars USING (query) WHERE lead > 5 AND 0.5 * cosine + least(length(x), length(y)) / (length(x) + length(y)) >= bar - 1e-9),
every AS (SELECT * FROM leaders UNION ALL SELECT *, 2.0 * {_lcs('x', 'y')} / (length(x) + length(y)) FROM others),
top AS (SELECT *, 0.5 * cosine + 0.5 * ratio AS score, row_number() OVER (PARTITION BY query ORDER BY round(0.5 * cosine + 0.5 * ratio, 12) DESC, ord) AS place FROM every)"""


_PER_CLASS = """
classes AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS label),
per AS (
  SELECT label, count(*) FILTER (truth = label) AS support, count(*) FILTER (pred = label) AS predicted, count(*) FILTER (truth = label AND pred = label) AS tp FROM classes, predictions GROUP BY label
), scored AS (
  SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN tp > 0 THEN 2 * tp / (predicted + support) ELSE 0 END AS f1 FROM per
)"""


def _profile(table: str, columns: list[tuple[str, str]]) -> str:
    rows = []
    for c, kind in columns:
        edge = (f"min({c} + 0)::VARCHAR", f"max({c} + 0)::VARCHAR") if kind == "numeric" else (f"min({c})::VARCHAR", f"max({c})::VARCHAR") if kind == "date" else ("NULL", "NULL")
        some = f"(SELECT coalesce(string_agg(v, '|' ORDER BY v), '') FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM {table} WHERE {c} IS NOT NULL ORDER BY v LIMIT 4))"
        rows.append(f"SELECT '{c}' AS \"column\", '{kind}' AS kind, {edge[0]} AS min, {edge[1]} AS max, count(*) AS row_count, {some} AS samples FROM {table}")
    return " UNION ALL ".join(rows)


#: Columns of the profiled tables.
_COLUMNS = {
    "region": "r_regionkey:numeric r_name:other", "nation": "n_nationkey:numeric n_name:other n_regionkey:numeric",
    "customer": "c_custkey:numeric c_name:other c_nationkey:numeric c_mktsegment:other c_acctbal:numeric", "supplier": "s_suppkey:numeric s_name:other s_nationkey:numeric s_acctbal:numeric",
    "part": "p_partkey:numeric p_name:other p_brand:other p_type:other p_size:numeric p_retailprice:numeric",
    "orders": "o_orderkey:numeric o_custkey:numeric o_orderstatus:other o_totalprice:numeric o_orderpriority:other o_orderdate:date",
    "labels": "doc_id:numeric quality:numeric toxic:numeric",
    "lineitem": "l_orderkey:numeric l_partkey:numeric l_suppkey:numeric l_linenumber:numeric l_quantity:numeric l_extendedprice:numeric l_discount:numeric l_tax:numeric l_returnflag:other l_linestatus:other l_shipdate:date",
    "events": "event_id:numeric user_id:numeric event_type:other value:numeric props:other ts:date",
}


def _counted(train: str, test: str) -> str:
    """Probabilities p of each label l for the rows (key, text) of ``test``, by add-one counts of 3-grams of the rows (label, text) of ``train``."""
    grams = "unnest(CASE WHEN length(text) >= 3 THEN list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i, 3)) WHEN text <> '' THEN [lower(text)] ELSE [] END)"
    return f"""
learnt AS (SELECT label, g, count(*) AS c FROM (SELECT label, {grams} AS g FROM ({train}) WHERE text IS NOT NULL AND label IS NOT NULL) GROUP BY ALL),
bases AS (SELECT label, -ln(sum(c) + (SELECT count(DISTINCT g) FROM learnt)) AS b FROM learnt GROUP BY 1),
asked AS (SELECT key, g, count(*) AS tf FROM (SELECT key, {grams} AS g FROM ({test})) GROUP BY ALL),
hits AS (SELECT key, label, sum(tf * ln(c + 1)) AS s FROM asked JOIN learnt USING (g) GROUP BY ALL),
widths AS (SELECT key, sum(tf) AS n FROM asked GROUP BY 1),
means AS (SELECT t.key, label, CASE WHEN n > 0 THEN 10 * (coalesce(s, 0) / n + b) ELSE 0 END AS m FROM (SELECT DISTINCT key FROM ({test})) t JOIN bases ON true LEFT JOIN widths USING (key) LEFT JOIN hits USING (key, label)),
powers AS (SELECT *, exp(m - max(m) OVER (PARTITION BY key)) AS e FROM means),
chances AS (SELECT key, label, e / sum(e) OVER (PARTITION BY key) AS p FROM powers),
judged AS (
  SELECT key, first(label ORDER BY p DESC, label) AS predicted_label, max(p) AS confidence, CASE WHEN max(p) >= 0.85 THEN 'auto' WHEN max(p) >= 0.6 THEN 'verify' ELSE 'human' END AS routing,
    string_agg(label || '=' || format('{{:.6f}}', round(p, 6)), ';' ORDER BY label) AS all_scores, array_to_string(list_slice(list(label ORDER BY round(p, 6) DESC, label), 1, 3), ',') AS top3 FROM chances GROUP BY key
)"""


def oracle_sql() -> dict[str, str]:
    sql = {}
    fields = {"b01_store": "store", "b02_date": "date", "b03_time": "time", "b04_subtotal": "subtotal", "b05_tax": "tax", "b06_total": "total", "b07_card": "card", "b08_payment_method": "payment_method", "b09_receipt_number": "receipt_number", "b10_items": "items"}
    sql |= {n: f"WITH {_RECEIPTS} SELECT receipt_id, {c} FROM truth" for n, c in fields.items()}
    sql["b11_all_fields"] = f"WITH {_RECEIPTS} SELECT receipt_id, store, date, time, subtotal, tax, total, card, payment_method, receipt_number, n AS items FROM truth"
    sql["a01_stored_bills"] = f"WITH {_ITEMS} SELECT count(*) AS rows, count(DISTINCT serial_no) AS bills, sum(item_price)::DOUBLE AS items_total FROM items"
    sql["a02_any_csv"] = "SELECT n_regionkey, count(*) AS n, max(n_name) AS last FROM nation GROUP BY 1"
    sql["a03_registered_frame"] = "SELECT c_mktsegment, count(*) AS n, sum(c_acctbal::DECIMAL(12,2))::DOUBLE AS balance FROM customer GROUP BY 1"
    sql["a04_bill_rows"] = f"WITH {_RECEIPTS} SELECT receipt_id AS bill_id, CASE WHEN receipt_id % 11 <> 0 THEN n ELSE 1 END AS rows, CASE WHEN receipt_id % 11 <> 0 THEN (cents / 100)::DOUBLE END AS items_total, (receipt_id % 11 = 0)::BIGINT AS placeholder FROM truth"
    sql["a08_inventory"] = "SELECT p_partkey + 1 AS ord, p_name AS ingredient, p_type AS predicted_label FROM part WHERE p_partkey % 13 <> 0 QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1"
    sql["c01_is_question"] = f"WITH {_CHAT} SELECT conv_id, turn, coalesce({_QUESTION}, false) AS is_question FROM chat"
    sql["c02_control_command"] = "SELECT conv_id, turn, (['reset', 'reset', 'reload', 'reload', 'none', 'none'])[conv_id % 6 + 1] AS command FROM conversations"
    sql["c04_routes"] = f"WITH {_CHAT} SELECT CASE turn % 4 WHEN 1 THEN 'image' WHEN 3 THEN 'image' WHEN 2 THEN 'unsupported' ELSE CASE WHEN coalesce({_QUESTION}, false) THEN 'question' ELSE 'help' END END AS route, count(*) AS n FROM chat GROUP BY 1"
    tokens = "'drop ', 'delete ', 'insert ', 'update ', 'create ', 'alter ', 'attach ', 'copy ', 'truncate ', 'export ', 'load ', 'install ', 'pragma '"
    sql["c05_blocked"] = f"WITH {_CHAT} SELECT conv_id, turn, trim(list_filter([{tokens}], lambda t: contains(lower(text), t))[1]) AS blocked FROM chat"
    sql["c05_blocked_strict"] = "SELECT conv_id, turn, (['drop', NULL, 'drop', ';', NULL, NULL])[conv_id % 6 + 1] AS blocked FROM conversations"
    sql["c06_training_rows"] = f"WITH {_LABELLED} SELECT doc_id, label, confidence FROM labelled WHERE text IS NOT NULL AND label <> 'es' AND confidence IN ('high', 'medium')"
    sql["c07_label_check"] = f"WITH {_LABELLED} SELECT count(DISTINCT label) AS classes, count(DISTINCT label) = 4 AS ok FROM labelled"
    sql["c10_date_range"] = "SELECT count(*) AS bills FROM orders WHERE o_orderdate >= DATE '1997-02-01' AND o_orderdate < DATE '1997-03-01'"
    sql["d01_known_images"] = f"WITH {_SUBMISSIONS} SELECT bill_id FROM versions WHERE bill_id % 20 >= 10 AND v <> 1 "
    sql["d01_all_images"] = f"""WITH {_SUBMISSIONS}, images AS (
      SELECT bill_id, v, md5(CASE v WHEN 2 THEN 'x' WHEN 3 THEN 'y' ELSE '' END || k) AS image FROM versions UNION ALL SELECT bill_id + 1, 4, md5('y' || k) FROM versions WHERE v = 3
    ) SELECT bill_id FROM images WHERE v > 0 AND image NOT IN (SELECT image FROM images WHERE v = 0) QUALIFY row_number() OVER (PARTITION BY image ORDER BY bill_id) = 1"""
    sql["d02_find_duplicates"] = f"WITH {_SUBMISSIONS} SELECT bill_id, k * 10 AS dup_of, CASE v WHEN 1 THEN 'hash' ELSE 'content' END AS layer FROM versions WHERE v IN (1, 2)"
    sql["d04_resolve_batch"] = f"WITH {_SUBMISSIONS} SELECT bill_id, v IN (0, 3) AS accepted, CASE WHEN v IN (1, 2) THEN k * 10 END AS dup_of, CASE v WHEN 1 THEN 'hash' WHEN 2 THEN 'content' END AS layer FROM versions"
    sql["e02_serials"] = f"WITH {_SUBMISSIONS} SELECT bill_id, (SELECT max(k) * 10 FROM versions) + row_number() OVER (ORDER BY bill_id) AS serial_no FROM versions WHERE v > 0"
    sql["s02_dedup_stream"] = f"WITH {_SUBMISSIONS} SELECT md5(CASE v WHEN 2 THEN 'x' WHEN 3 THEN 'y' ELSE '' END || k) AS image_hash FROM versions WHERE v <> 1"
    sql["s03_route_stream"] = f"WITH {_CHAT} SELECT conv_id, turn, CASE WHEN coalesce({_QUESTION}, false) THEN 'question' ELSE 'help' END AS route FROM chat"
    sql["f05_last_turns"] = sql["s04_history_stream"] = "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4"
    sql["e01_vocabulary"] = f"WITH {_WORDS} SELECT * FROM vocab"
    short = "src AS (SELECT w AS token FROM tokens WHERE length(w) <= 5)"
    sql["d06_expansions"] = f"WITH {_WORDS}, {short}, {_expanded('src')} SELECT token, expanded, round(score, 4) AS score, method FROM expanded"
    normal = "normal AS (SELECT ord, item_name, coalesce(array_to_string(list_transform(ts, lambda t: m[t]), ' '), '') AS normalized FROM parts, (SELECT map_from_entries(list(row(token, expanded))) AS m FROM expanded))"
    noisy = f"WITH {_WORDS}, {_STOCK}, {_NOISY}, {_expanded('tok')}"
    sql["d10_normalized"] = f"{noisy}, {normal} SELECT ord, normalized, normalized <> lower(trim(item_name)) AS was_normalized FROM normal"
    sql["j04_similarity_classes"] = f"""{noisy}, {normal}, {_GRAMS}, {_topk('normalized AS query FROM normal')}
      SELECT DISTINCT item_name AS input, normalized, ingredient AS matched_item, CASE WHEN round(score, 4) > 0.5 THEN 'accept' ELSE 'fallback' END AS decision, predicted_label AS final_label,
        CASE WHEN round(score, 4) > 0.5 THEN 'similarity_pipeline' ELSE 'llm_fallback' END AS final_source FROM normal LEFT JOIN top ON query = normalized AND place = 1"""
    sql["i19_abbreviations"] = f"""{noisy}, raws AS (SELECT ord, unnest(string_split(item_name, ' ')) AS raw, unnest(range(len(string_split(item_name, ' ')))) AS pos FROM noisy),
      told AS (SELECT ord, pos, raw, expanded = lower(raw) AS same FROM raws JOIN expanded ON token = lower(raw)
        WHERE regexp_full_match(lower(raw), '[a-z]{{1,5}}') AND length(regexp_replace(lower(raw), '[^aeiou]', '', 'g')) <= 1)
      SELECT noisy.ord, count(raw) > 0 AS has_abbreviations, coalesce(bool_or(same), false) AS has_unresolved, coalesce(string_agg(raw, ',' ORDER BY pos) FILTER (same), '') AS unresolved,
        count(DISTINCT raw) FILTER (NOT same) AS n_resolved FROM noisy LEFT JOIN told USING (ord) GROUP BY noisy.ord"""
    named = "test AS (SELECT DISTINCT item_name AS key, normalized AS text FROM normal)"
    sql["j05_categorized"] = f"""{noisy}, {normal}, {named}, raws AS (SELECT DISTINCT item_name, unnest(string_split(item_name, ' ')) AS raw FROM noisy),
      stuck AS (SELECT DISTINCT item_name FROM raws JOIN expanded ON token = lower(raw) WHERE expanded = token AND regexp_full_match(token, '[a-z]{{1,5}}') AND length(regexp_replace(token, '[^aeiou]', '', 'g')) <= 1),
      said AS (SELECT item_name, predicted_label AS verdict_label, ord % 3 <> 0 AS sure FROM noisy JOIN stock USING (ord) WHERE ord % 4 <> 1),
      {_counted('SELECT predicted_label AS label, ingredient AS text FROM stock', 'SELECT key, text FROM test')},
      done AS (SELECT key AS input, text AS normalized, predicted_label, confidence, routing, verdict_label, coalesce(sure, false) AS sure, stuck.item_name IS NOT NULL AS flagged
        FROM judged JOIN test USING (key) LEFT JOIN said ON said.item_name = key LEFT JOIN stuck ON stuck.item_name = key)
      SELECT input, normalized, predicted_label, round(confidence, 6) AS confidence, routing, verdict_label,
        CASE WHEN routing = 'auto' THEN predicted_label WHEN routing = 'verify' AND sure THEN verdict_label ELSE 'HUMAN_REVIEW_NEEDED' END AS final_label,
        array_to_string(list_filter([CASE WHEN routing = 'human' OR (routing = 'verify' AND NOT sure) THEN 'human_review' ELSE '' END, CASE WHEN (routing = 'verify' AND sure) OR (routing = 'auto' AND flagged) THEN 'low_confidence' ELSE '' END,
          CASE WHEN flagged THEN 'unresolved' ELSE '' END], lambda q: q <> ''), ',') AS queues FROM done"""
    sql["j03_scored_items"] = f"""WITH {_LABELLED}, {_SPLIT}, {_counted("SELECT label, text FROM split WHERE split = 'train'", "SELECT doc_id AS key, text FROM split WHERE split = 'test'")}
      SELECT key AS doc_id, predicted_label, round(confidence, 6) AS confidence, routing, all_scores, top3 FROM judged"""
    sql["e12_idf"] = f"WITH {_STOCK}, {_GRAMS} SELECT gram, df, round(idf, 6) AS idf FROM idf"
    sql["i14_grams"] = f"WITH {_STOCK}, {_GRAMS} SELECT * FROM tf"
    sql["j01_weights"] = f"WITH {_STOCK}, {_GRAMS} SELECT ord, gram, round(weight, 5) AS weight FROM weights"
    sql["i07_lcs_ratio"] = f"""WITH {_STOCK}, pairs AS (SELECT a.ord, upper(a.ingredient) AS a, upper(b.ingredient) AS b, array_to_string(list_sort(string_split(upper(a.ingredient), ' ')), ' ') AS sa, array_to_string(list_sort(string_split(upper(b.ingredient), ' ')), ' ') AS sb
      FROM stock a JOIN stock b ON b.ord = a.ord + 1) SELECT ord, round(2.0 * {_lcs('a', 'b')} / (length(a) + length(b)), 6) AS ratio, round(200.0 * {_lcs('sa', 'sb')} / (length(sa) + length(sb)), 6) AS sorted_ratio FROM pairs"""
    sql["i09_abbreviation_like"] = f"WITH {_WORDS} SELECT DISTINCT w AS token, length(w) <= 5 AND length(regexp_replace(w, '[^aeiou]', '', 'g')) <= 1 AS short, regexp_replace(w, '[aeiou]', '', 'g') AS skeleton FROM tokens"
    sql["i02_normalised_values"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'n/a ' || o_orderkey END AS day,
      CASE o_orderkey % 3 WHEN 0 THEN lpad(((o_orderkey % 12 + 1) % 12 + 12)::VARCHAR, 2, '0') || ':05' WHEN 1 THEN lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':07' ELSE 'NOON' END AS clock,
      round(o_totalprice, 2) AS price, trim(regexp_replace(upper(o_orderpriority), '[^A-Z0-9 ]', '', 'g')) AS bare FROM orders"""
    sql["i18_routing"] = f"WITH {_SCORES} SELECT doc_id, routing, CASE WHEN round(confidence, 4) > 0.5 THEN 'accept' ELSE 'fallback' END AS decision FROM routed"
    sql["j06_queues"] = f"""WITH {_SCORES} SELECT doc_id, 'unresolved' AS queue FROM routed WHERE flagged UNION ALL SELECT doc_id, 'low_confidence' FROM routed WHERE (routing = 'verify' AND sure) OR (routing = 'auto' AND flagged)
      UNION ALL SELECT doc_id, 'human_review' FROM routed WHERE routing = 'human' OR (routing = 'verify' AND NOT sure)"""
    sql["a09_review_queues"] = f"SELECT queue, count(*) AS n, count(*) AS stamped FROM ({sql['j06_queues']}) GROUP BY 1"
    sql["i26_final_labels"] = f"WITH {_SCORES} SELECT doc_id, CASE WHEN routing = 'auto' THEN 'P' WHEN routing = 'verify' AND sure THEN 'V' ELSE 'HUMAN_REVIEW_NEEDED' END AS final_label FROM routed"
    sql["i20_verdicts"] = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Dairy' ELSE 'Herbs' END AS label, CASE doc_id % 3 WHEN 0 THEN 'high' ELSE 'low' END AS confidence FROM documents"
    sql["i21_sql_of_replies"] = f"WITH {_CHAT} SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'SELECT ' || conv_id END AS sql, md5(trim(regexp_replace(text, '(?is)<sql>.*?</sql>', ''), ' ' || chr(10))) AS rest FROM chat"
    sql["i22_formatted"] = "SELECT o_orderkey, '$' || format('{:,.2f}', o_totalprice) AS money, format('{:,}', o_orderkey * 1234) AS whole, rtrim(rtrim(format('{:,.4f}', o_custkey / 8), '0'), '.') AS fraction FROM orders"
    sql["i24_hashes"] = "SELECT page_id, md5(html) AS hash FROM pages"
    words = ", ".join(f"('{w}', {len(w)})" for w in ("the", "der", "que", "les", "und", "una"))
    sql["i17_top_scores"] = f"""WITH r AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY (length(text) - length(replace(text, w, ''))) // n DESC, w) AS p
      FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents), (VALUES {words}) AS v(w, n)) SELECT doc_id, string_agg(w, ',' ORDER BY p) AS top3, first(w ORDER BY p) AS best FROM r WHERE p <= 3 GROUP BY 1"""
    sql["i25_label_ids"] = f"WITH {_LABELLED} SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT DISTINCT label FROM labelled)"
    sql["f02_split"] = f"WITH {_LABELLED}, {_SPLIT} SELECT doc_id, split FROM split"
    sql["f01_cap"] = f"WITH {_LABELLED}, {_SPLIT} SELECT doc_id, label FROM split WHERE p < 20"
    prepared = f"""WITH {_LABELLED.replace("JOIN documents USING (doc_id)", "JOIN documents USING (doc_id) WHERE doc_id % 10 <> 0")}, {_SPLIT},
      m AS (SELECT *, row_number() OVER (PARTITION BY label, split ORDER BY md5('42|' || doc_id), doc_id) AS r FROM split)"""
    sql["j09_prepared"] = f"{prepared} SELECT doc_id, label, split, split = 'train' AND r <= 20 AS downsampled FROM m"
    sql["a11_split_files"] = f"{prepared} SELECT split, count(*) AS n FROM m GROUP BY 1 UNION ALL SELECT 'downsampled', count(*) FROM m WHERE split = 'train' AND r <= 20"
    sql["a06_image_hashes"] = "SELECT s_suppkey::BIGINT AS s_suppkey, md5(s_name || chr(10)) AS image_hash FROM supplier"
    sql["a07_gold_with_images"] = "SELECT s_suppkey::VARCHAR AS receipt_id, s_name AS merchant_name FROM supplier WHERE s_nationkey < 12"
    sql["a12_run_files"] = "SELECT o_orderpriority AS model, count(*)::INT AS best_epoch, round(avg((o_orderstatus = 'F')::INT), 6) AS test_accuracy FROM orders GROUP BY 1"
    sql["c09_broken_rows"] = "SELECT o_orderkey AS serial_no, NULL::VARCHAR AS store_name, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS item_name, round(o_totalprice, 2) AS item_price FROM orders WHERE o_orderstatus <> 'O'"
    sql["d12_joins_over_data"] = f"""WITH {_ITEMS}, f AS (SELECT store_name, min(invoice_date) AS day FROM items GROUP BY 1)
      SELECT d.store_name, o_orderpriority AS priority, count(*) AS n, sum(d.item_price)::DOUBLE AS spend FROM items d JOIN orders ON serial_no = o_orderkey JOIN f ON f.store_name = d.store_name AND d.invoice_date > f.day GROUP BY 1, 2"""
    sql["g06_top_bills"] = f"WITH {_ITEMS} SELECT serial_no, store_name, total::DOUBLE AS total FROM bills ORDER BY bills.total DESC, serial_no LIMIT 25"
    sql["i27_functions_over_data"] = f"""WITH {_ITEMS} SELECT serial_no, item_name, count(*) AS n, upper(substr(item_name, 2, 3)) AS part, len(string_split(item_name, ' '))::INT AS words, min(day(invoice_date)) = 1 AS first_day,
      replace(item_name, 'a', '') AS bare, serial_no::VARCHAR AS k, array_to_string(list_sort(string_split(item_name, ' ')), '-') AS sorted, serial_no AS held FROM items GROUP BY serial_no, item_name"""
    sql["e05_class_counts"] = f"WITH {_LABELLED}, {_SPLIT} SELECT label, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) AS total, least(count(*) FILTER (split = 'train'), count(*) FILTER (split = 'val'), count(*) FILTER (split = 'test')) >= 30 AS enough FROM split GROUP BY 1"
    sql["e06_imbalance"] = f"""WITH {_LABELLED}, c AS (SELECT label, count(*) AS before, least(count(*), 100) AS after FROM labelled GROUP BY 1)
      SELECT label, before, after, before - after AS removed, round(100 * after / before, 2) AS kept_percent, round((SELECT max(before) / min(before) FROM c), 4) AS ratio_before, round((SELECT max(after) / min(after) FROM c), 4) AS ratio_after FROM c"""
    sql["e07_class_weights"] = f"""WITH {_LABELLED}, c AS (SELECT x AS label, count(doc_id) AS m FROM (SELECT unnest(['de', 'en', 'es', 'fr', 'it']) AS x) LEFT JOIN labelled ON x = label GROUP BY 1)
      SELECT label, greatest(m, 1) AS n, round((SELECT sum(m) FROM c) / (5 * greatest(m, 1)), 6) AS weight FROM c"""
    sql["e14_value_counts"] = f"WITH {_LABELLED} SELECT confidence AS value, count(*) AS n FROM labelled GROUP BY 1"
    sql["e08_metrics"] = f"WITH {_LABELLED}, {_PER_CLASS} SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM scored"
    sql["e09_confusion"] = f"WITH {_LABELLED} SELECT truth AS label, {', '.join(f'''count(*) FILTER (pred = '{x}') AS {x}''' for x in ('de', 'en', 'es', 'fr'))} FROM predictions GROUP BY 1"
    cols = ("precision", "recall", "f1")
    sql["e10_report"] = f"""WITH {_LABELLED}, {_PER_CLASS}, u AS (SELECT label, precision, recall, f1, support FROM scored UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM scored
      UNION ALL SELECT 'weighted avg', {', '.join(f'sum({c} * support) / sum(support)' for c in cols)}, sum(support) FROM scored) SELECT label, {', '.join(f'round({c}, 4) AS {c}' for c in cols)}, support::BIGINT AS support FROM u"""
    sql["e13_compare_runs"] = f"""WITH {_LABELLED}, g AS (SELECT doc_id % 4 AS m, * FROM predictions), labels_ AS (SELECT DISTINCT m, x.label FROM g, (SELECT unnest(['de', 'en', 'es', 'fr']) AS label) x WHERE x.label IN (truth, pred)),
      f AS (SELECT 'run' || labels_.m AS model, label, round(2 * count(*) FILTER (truth = label AND pred = label) / (count(*) FILTER (truth = label) + count(*) FILTER (pred = label)), 4) AS f1 FROM labels_ JOIN g ON g.m = labels_.m GROUP BY ALL)
      SELECT model, label, f1, rank() OVER (PARTITION BY label ORDER BY f1 DESC) = 1 AS best FROM f"""
    sql["f06_early_stopping"] = """WITH h AS (SELECT o_orderpriority AS run, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate))::INT AS epoch, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS f FROM orders GROUP BY ALL),
      b AS (SELECT *, coalesce(f > max(f) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS best FROM h),
      s AS (SELECT *, sum(best::INT) OVER (PARTITION BY run ORDER BY epoch) AS block FROM b), t AS (SELECT *, row_number() OVER (PARTITION BY run, block ORDER BY epoch) - 1 AS since FROM s),
      e AS (SELECT run, coalesce(min(epoch) FILTER (since = 3), max(epoch)) AS stop_epoch FROM t GROUP BY 1)
      SELECT run, max(epoch) FILTER (best) AS best_epoch, max(f) FILTER (best) AS best_f1, any_value(stop_epoch) AS stop_epoch FROM t JOIN e USING (run) WHERE epoch <= stop_epoch GROUP BY 1"""
    scored = f"""WITH {_RECEIPTS}, s AS (SELECT receipt_id, (receipt_id % 6 <> 0)::DOUBLE AS merchant_name, CASE WHEN receipt_id % 7 = 0 THEN NULL WHEN date = '' THEN 0.0 ELSE 1.0 END AS d, CASE WHEN receipt_id % 2 = 1 THEN NULL WHEN time = '' THEN 0.0 ELSE 1.0 END AS t,
      (receipt_id % 8 <> 0)::DOUBLE AS tax, CASE WHEN receipt_id % 9 = 0 AND n > 1 THEN 2 * (n - 1) / (2 * n - 1) WHEN receipt_id % 4 = 1 THEN 2 * n / (2 * n + 1) ELSE 1.0 END AS f1 FROM truth),
      c AS (SELECT *, (merchant_name + coalesce(d, 0) + coalesce(t, 0) + tax + 5) / (7 + (d IS NOT NULL)::INT + (t IS NOT NULL)::INT) AS core FROM s),
      r AS (SELECT receipt_id, merchant_name, coalesce(d, 0)::DOUBLE AS date, coalesce(t, 0)::DOUBLE AS time, 1.0::DOUBLE AS subtotal, tax, 1.0::DOUBLE AS total, 1.0::DOUBLE AS payment_method, 1.0::DOUBLE AS card_last4, 1.0::DOUBLE AS receipt_number,
        round(core, 6) AS core_field_mean, round(f1, 6)::DOUBLE AS item_name_f1, round(0.7 * core + 0.3 * f1, 6) AS overall_score FROM c)"""
    sql["d08_scored_receipts"] = f"{scored} SELECT * FROM r"
    names = ("merchant_name", "date", "time", "subtotal", "tax", "total", "payment_method", "card_last4", "receipt_number", "core_field_mean", "item_name_f1", "overall_score")
    sql["j08_summary"] = f"{scored} SELECT {', '.join(f'round(avg({n}), 4) AS {n}' for n in names)} FROM r"
    sql["a10_metric_files"] = f"{scored} SELECT count(*) AS receipts, round(avg(overall_score), 4) AS mean, round(avg(tax), 4) AS tax, round(avg(overall_score), 4) AS overall_score FROM r"
    sql["d05_topk"] = f"""WITH {_STOCK}, {_NOISY}, {_GRAMS}, {_topk('lower(item_name) AS query FROM noisy')} SELECT query, place::INT AS rank, ingredient AS item, predicted_label AS label,
      round(cosine, 4) AS cosine, round(ratio, 4) AS ratio, round(score, 4) AS hybrid FROM top WHERE place <= 5"""
    sql["e15_distinct"] = "SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL"
    sql["g03_preview"] = "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY 1 LIMIT 30"
    sql |= {f"e11_profile_{t}": _profile(t, [tuple(c.split(":")) for c in cs.split()]) for t, cs in _COLUMNS.items()}
    line = lambda c, kind, edge: f"SELECT '{c}' AS \"column\", '  - {c} ({kind})' || {edge} || ' | e.g. ' || (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM nation ORDER BY v LIMIT 3)) AS line FROM (SELECT min(n_nationkey) AS a, max(n_nationkey) AS b, min(n_regionkey) AS c, max(n_regionkey) AS d FROM nation)"
    sql["i23_profile_lines"] = " UNION ALL ".join(line(c, k, e) for c, k, e in (("n_nationkey", "INT", "' | range: ' || a || ' → ' || b"), ("n_name", "STRING", "''"), ("n_regionkey", "INT", "' | range: ' || c || ' → ' || d")))
    sql["e17_category_month"] = f"WITH {_ITEMS} SELECT grocery_category, strftime(invoice_date, '%Y-%m') AS month, sum(item_price)::DOUBLE AS spend, count(*) AS n FROM items GROUP BY 1, 2"
    sql["e17_bill_month"] = f"WITH {_ITEMS} SELECT strftime(invoice_date, '%Y-%m') AS month, sum(total)::DOUBLE AS spend, count(*) AS n FROM bills WHERE invoice_date >= '1996-01-01' AND invoice_date < '1998-01-01' GROUP BY 1"
    sql["e17_last_month"] = f"WITH {_ITEMS} SELECT sum(total)::DOUBLE AS spend, count(*) AS bills FROM bills WHERE invoice_date >= '1997-02-01' AND invoice_date < '1997-03-01'"
    sql["e17_last_week"] = f"WITH {_ITEMS} SELECT sum(total)::DOUBLE AS spend, count(*) AS bills FROM bills WHERE invoice_date > '1997-03-08' AND invoice_date <= '1997-03-15'"
    sql["e17_category"] = f"WITH {_ITEMS} SELECT sum(item_price)::DOUBLE AS spend, count(*) AS items FROM items WHERE grocery_category = 'ECONOMY'"
    sql["e17_most_visited"] = f"WITH {_ITEMS} SELECT store_name, count(*) AS visits, sum(total)::DOUBLE AS spend FROM bills GROUP BY 1 ORDER BY visits DESC, store_name NULLS FIRST LIMIT 5"
    sql["e16_cube"] = f"WITH {_ITEMS} SELECT grocery_category AS category, strftime(invoice_date, '%Y-%m') AS month, sum(item_price)::DOUBLE AS spend, count(*) AS n, grouping(grocery_category, strftime(invoice_date, '%Y-%m'))::INT AS level FROM items GROUP BY CUBE (grocery_category, strftime(invoice_date, '%Y-%m'))"
    sql["f08_running"] = f"WITH {_ITEMS}, m AS (SELECT store_name, strftime(invoice_date, '%Y-%m') AS month, sum(total) AS spend FROM bills GROUP BY 1, 2) SELECT store_name, month, spend::DOUBLE AS spend, (sum(spend) OVER (PARTITION BY store_name ORDER BY month))::DOUBLE AS running FROM m"
    sql["e16_ad_hoc"] = f"""WITH {_ITEMS}, m AS (SELECT store_name, year(invoice_date)::INT AS y, sum(item_price) AS s FROM items WHERE item_price IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)
      SELECT * FROM (SELECT store_name, y, s::DOUBLE AS s, rank() OVER (PARTITION BY y ORDER BY s DESC, store_name) AS place FROM m WHERE s > (SELECT avg(s) FROM m)) WHERE NOT (y = 1995 AND place = 1)"""
    # item names are the catalogue's, so each is normalised and judged once
    tok = "tok AS (SELECT unnest(string_split(lower(ingredient), ' ')) AS token FROM stock)"
    sql["j07_ingest"] = sql["s01_ingest_stream"] = f"""WITH {_RECEIPTS}, {_STOCK}, {_WORDS[1:]}, {tok}, {_expanded('tok')},
      named AS (SELECT upper(ingredient) AS key, array_to_string(list_transform(string_split(lower(ingredient), ' '), lambda t: m[t]), ' ') AS text FROM stock, (SELECT map_from_entries(list(row(token, expanded))) AS m FROM expanded)),
      stuck AS (SELECT DISTINCT upper(ingredient) AS key FROM (SELECT ingredient, unnest(string_split(lower(ingredient), ' ')) AS token FROM stock) JOIN expanded USING (token)
        WHERE expanded = token AND regexp_full_match(token, '[a-z]{{1,5}}') AND length(regexp_replace(token, '[^aeiou]', '', 'g')) <= 1),
      {_counted('SELECT predicted_label AS label, ingredient AS text FROM stock', 'SELECT key, text FROM named')},
      b AS (SELECT *, receipt_id * 10 AS bill_id FROM truth UNION ALL SELECT *, receipt_id * 10 + 1 FROM truth WHERE receipt_id % 40 = 0 AND date = ''),
      numbered AS (SELECT *, row_number() OVER (ORDER BY bill_id) AS serial_no FROM b)
      SELECT serial_no, bill_id, bill_id || '.jpg' AS bill_file, store AS store_name, nullif(date, '') AS invoice_date, total, card AS card_used, bill_id AS received_at, '+' || (bill_id % 97) AS sender, md5(bill_id::VARCHAR) AS image_hash,
        upper(p_name) AS item_name, (lines.cents / 100)::DOUBLE AS item_price, CASE WHEN routing = 'auto' THEN predicted_label ELSE 'HUMAN_REVIEW_NEEDED' END AS grocery_category, routing, round(confidence, 6) AS confidence,
        array_to_string(list_filter([CASE WHEN routing <> 'auto' THEN 'human_review' ELSE '' END, CASE WHEN routing = 'auto' AND stuck.key IS NOT NULL THEN 'low_confidence' ELSE '' END, CASE WHEN stuck.key IS NOT NULL THEN 'unresolved' ELSE '' END], lambda q: q <> ''), ',') AS queues
      FROM numbered JOIN lines ON l_orderkey = receipt_id JOIN judged ON judged.key = upper(p_name) LEFT JOIN stuck ON stuck.key = upper(p_name)"""
    return sql
