"""The relational shapes of the engine as queries over the driver's tables, each with its SQL.

Every pair is written apart: the DataFrame plan is what the engine runs, the SQL
is what DuckDB is asked for the same rows. Doubles are rounded alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from posora.functions import names, rules
from posora.operators import graph, ordered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
    SELECT lang, count(*) AS n_docs, count(l.doc_id) AS n_labelled, round(count(l.doc_id) * 1.0 / count(*), 6) AS coverage
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY lang
""")
def coverage_by_category(spark, sf_dir):
    labelled = read(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("hit")).distinct()
    joined = read(spark, sf_dir, "documents").select("doc_id", "lang").join(labelled, "doc_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("n_docs"), F.count("hit").alias("n_labelled"), F.round(F.count("hit") / F.count("*"), 6).alias("coverage"))


@query("SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlinked_anti_join(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def linked_semi_join(spark, sf_dir):
    good = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", "lang").join(good, "doc_id", "left_semi")


@query("""
    SELECT l_orderkey, count(*) AS n_lines, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS n_returned,
           count(DISTINCT l_linestatus) AS n_status
    FROM lineitem GROUP BY l_orderkey
    HAVING count(*) = count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AND count(DISTINCT l_linestatus) = 1
""")
def dose_evaluable(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey")
    # one distinct count; that a status is the only one shows in its least and greatest value
    counted = lines.agg(F.count("*").alias("n_lines"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("n_returned"), (F.min("l_linestatus") == F.max("l_linestatus")).alias("one"))
    return counted.filter("n_lines = n_returned AND one").select("l_orderkey", "n_lines", "n_returned", F.lit(1).cast("long").alias("n_status"))


@query("""
    SELECT 'order' AS scope, o_orderstatus AS category, count(*) AS n FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT 'line', l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag
    UNION ALL SELECT 'event', event_type, count(*) FROM events GROUP BY event_type
""")
def scope_union_counts(spark, sf_dir):
    def counts(name: str, scope: str, col: str) -> DataFrame:
        return read(spark, sf_dir, name).groupBy(F.col(col).alias("category")).agg(F.count("*").alias("n")).select(F.lit(scope).alias("scope"), "category", "n")

    return counts("orders", "order", "o_orderstatus").unionByName(counts("lineitem", "line", "l_returnflag")).unionByName(counts("events", "event", "event_type"))


@query("""
    WITH vals AS (SELECT p_brand AS v FROM part UNION SELECT p_type FROM part UNION SELECT n_name FROM nation),
         dict AS (SELECT v, row_number() OVER (ORDER BY v) AS id FROM vals WHERE v IS NOT NULL)
    SELECT p_partkey, b.id AS brand_id, t.id AS type_id, b.v = p_brand AND t.v = p_type AS decodes
    FROM part JOIN dict b ON b.v = p_brand JOIN dict t ON t.v = p_type
""")
def dictionary_encode(spark, sf_dir):
    part, nation = read(spark, sf_dir, "part"), read(spark, sf_dir, "nation")
    coded = ordered.dictionary([(part, "p_brand"), (part, "p_type"), (nation, "n_name")])
    brand, kind = coded.select(F.col("value").alias("bv"), F.col("id").alias("brand_id")), coded.select(F.col("value").alias("tv"), F.col("id").alias("type_id"))
    joined = part.join(brand, part["p_brand"] == brand["bv"]).join(kind, part["p_type"] == kind["tv"])
    return joined.select("p_partkey", "brand_id", "type_id", ((F.col("bv") == F.col("p_brand")) & (F.col("tv") == F.col("p_type"))).alias("decodes"))


TWELVE = {"part": ["p_brand", "p_type", "p_name"], "nation": ["n_name"], "customer": ["c_mktsegment", "c_name"], "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"], "supplier": ["s_name"], "documents": ["source"]}


@query(f"""
    WITH vals AS ({" UNION ".join(f"SELECT {c} AS value FROM {t}" for t, cs in TWELVE.items() for c in cs)}), dict AS (SELECT value, row_number() OVER (ORDER BY value) AS id FROM vals WHERE value IS NOT NULL)
    SELECT o_orderkey, s.id AS status_id, p.id AS priority_id, c.id AS customer_id, c.value AS customer FROM orders JOIN dict s ON s.value = o_orderstatus JOIN dict p ON p.value = o_orderpriority
    JOIN customer ON c_custkey = o_custkey JOIN dict c ON c.value = c_name
""")
def dictionary_of_twelve(spark, sf_dir):
    """Orders coded by one dictionary of twelve columns, with one of them decoded again."""
    coded = ordered.dictionary([(read(spark, sf_dir, t), c) for t, cs in TWELVE.items() for c in cs])

    def ids(col: str, name: str) -> DataFrame:
        return coded.select(F.col("value").alias(col), F.col("id").alias(name))

    rows = read(spark, sf_dir, "orders").join(ids("o_orderstatus", "status_id"), "o_orderstatus").join(ids("o_orderpriority", "priority_id"), "o_orderpriority")
    named = rows.join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").join(ids("c_name", "customer_id"), "c_name")
    view = coded.select(F.col("id").alias("customer_id"), F.col("value").alias("customer"))
    return named.select("o_orderkey", "status_id", "priority_id", "customer_id").join(view, "customer_id").select("o_orderkey", "status_id", "priority_id", "customer_id", "customer")


@query("""
    SELECT user_id, event_id, event_type, round(value, 6) AS value FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
""")
def upsert_last_wins(spark, sf_dir):
    last = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("x"))
    return last.select("user_id", "x.event_id", "x.event_type", F.round("x.value", 6).alias("value"))


@query("SELECT md5(text) AS text_md5, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY text")
def first_wins_dedupe(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return docs.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


@query("""
    SELECT user_id, event_id, r AS rank FROM
    (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20
""")
def topk_recent_per_user(spark, sf_dir):
    order = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    ranked = read(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumn("rank", F.row_number().over(order))
    return ranked.filter("rank <= 20").select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query("""
    WITH steps AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
    SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS n, sum(CASE WHEN a <= b THEN 1 ELSE 0 END)::BIGINT AS n_forward
    FROM steps WHERE b IS NOT NULL GROUP BY 1, 2
""")
def symmetric_pair(spark, sf_dir):
    steps = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("a"), F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("b"))
    pairs = steps.filter("b IS NOT NULL").withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    return pairs.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.count_if(F.col("a") <= F.col("b")).alias("n_forward"))


@query("""
    WITH c AS (SELECT user_id, event_type, date_trunc('week', ts) AS wk, min(ts) AS s, max(ts) AS e FROM events GROUP BY ALL)
    SELECT a.user_id, a.event_type AS left_type, b.event_type AS right_type, count(*) AS n_overlaps
    FROM c a JOIN c b ON a.user_id = b.user_id AND a.event_type < b.event_type AND a.wk = b.wk AND a.s <= b.e AND b.s <= a.e GROUP BY ALL
""")
def interval_overlap(spark, sf_dir):
    courses = read(spark, sf_dir, "events").groupBy("user_id", "event_type", F.date_trunc("week", "ts").alias("wk")).agg(F.min("ts").alias("s"), F.max("ts").alias("e"))
    a, b = courses.alias("a"), courses.alias("b")
    on = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.wk") == F.col("b.wk")) & (F.col("a.event_type") < F.col("b.event_type")) & (F.col("a.s") <= F.col("b.e")) & (F.col("b.s") <= F.col("a.e"))
    return a.join(b, on).groupBy(F.col("a.user_id"), F.col("a.event_type").alias("left_type"), F.col("b.event_type").alias("right_type")).agg(F.count("*").alias("n_overlaps"))


@query("""
    WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS d, lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx FROM orders)
    SELECT o_custkey, o_orderkey, greatest((nx - d) - 1, 0)::BIGINT AS gap_days FROM o WHERE nx IS NOT NULL AND greatest((nx - d) - 1, 0) < 30
""")
def washout_gap(spark, sf_dir):
    after = F.lead("d").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.to_date("o_orderdate").alias("d")).withColumn("nx", after)
    return orders.filter("nx IS NOT NULL").select("o_custkey", "o_orderkey", F.greatest(F.date_diff("nx", "d") - 1, F.lit(0)).cast("long").alias("gap_days")).filter("gap_days < 30")


@query("""
    WITH x AS (SELECT DISTINCT l_orderkey, l_suppkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT a.l_orderkey, a.p_brand, a.l_suppkey AS left_supp, b.l_suppkey AS right_supp
    FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.p_brand = b.p_brand AND a.l_suppkey < b.l_suppkey
""")
def shared_group_self_join(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    x = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").join(part, "l_partkey").select("l_orderkey", "l_suppkey", "p_brand").distinct()
    right = x.withColumnRenamed("l_suppkey", "right_supp")
    return x.join(right, ["l_orderkey", "p_brand"]).filter("l_suppkey < right_supp").select("l_orderkey", "p_brand", F.col("l_suppkey").alias("left_supp"), "right_supp")


@query("""
    SELECT l_partkey, l_suppkey, l_returnflag, l_linestatus, l_linenumber, count(*) AS n, min(l_orderkey) AS first_order
    FROM lineitem GROUP BY ALL HAVING count(*) > 1
""")
def duplicate_signature(spark, sf_dir):
    keys = ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber"]
    return read(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order")).filter("n > 1")


@query("""
    WITH x AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts::DATE = DATE '2024-01-05' GROUP BY ALL),
         y AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts::DATE = DATE '2024-01-06' GROUP BY ALL)
    SELECT coalesce(x.user_id, y.user_id) AS user_id, coalesce(x.event_type, y.event_type) AS event_type,
           CASE WHEN x.n IS NULL THEN 'insert' WHEN y.n IS NULL THEN 'delete' WHEN x.n <> y.n THEN 'update' ELSE 'keep' END AS action
    FROM x FULL OUTER JOIN y ON x.user_id = y.user_id AND x.event_type = y.event_type
""")
def reconcile_full_outer(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))

    def on(day: str, name: str) -> DataFrame:
        return events.filter(F.col("day") == F.lit(day).cast("date")).groupBy("user_id", "event_type").agg(F.count("*").alias(name))

    action = F.when(F.col("have").isNull(), "insert").when(F.col("want").isNull(), "delete").when(F.col("have") != F.col("want"), "update").otherwise("keep")
    return on("2024-01-05", "have").join(on("2024-01-06", "want"), ["user_id", "event_type"], "full_outer").select("user_id", "event_type", action.alias("action"))


@query("""
    SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS n_p, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o
    FROM orders GROUP BY o_custkey
""")
def status_pivot(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(*(F.count_if(F.col("o_orderstatus") == s.upper()).alias(f"n_{s}") for s in "pfo"))


@query("SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 4")
def max_per_day_violation(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).filter("n > 4")


@query("""
    SELECT o_orderkey, CASE WHEN max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 THEN 'hit'
        WHEN count(l_orderkey) = 0 THEN 'not_applicable' WHEN count(DISTINCT l_linestatus) > 1 THEN 'conditional'
        WHEN o_orderstatus = 'P' THEN 'unresolved' ELSE 'clear' END AS state
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus
""")
def precedence_fold(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("returned"), (F.min("l_linestatus") != F.max("l_linestatus")).alias("mixed"), F.count("*").alias("n")
    )
    state = F.when(F.col("returned"), "hit").when(F.col("n").isNull(), "not_applicable").when(F.col("mixed"), "conditional").when(F.col("o_orderstatus") == "P", "unresolved").otherwise("clear")
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left").select("o_orderkey", state.alias("state"))


@query("""
    WITH t AS (SELECT doc_id, n_chars, unnest([lang, source, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END]) AS slice FROM documents)
    SELECT slice, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM t GROUP BY slice
    UNION ALL SELECT 'overall', count(*), sum(n_chars)::BIGINT FROM documents
""")
def explode_tokens_slices(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("n_chars", "lang", "source")
    tags = F.array("lang", "source", F.when(F.col("n_chars") > 2000, "long").otherwise("short"), F.lit("overall"))
    return docs.select("n_chars", F.explode(tags).alias("slice")).groupBy("slice").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""
    SELECT l_partkey, CASE WHEN count(DISTINCT l_returnflag) = 1 AND count(*) = count(l_returnflag) THEN max(l_returnflag) END AS flag
    FROM lineitem GROUP BY l_partkey
""")
def unanimous_value(spark, sf_dir):
    value = F.when((F.min("l_returnflag") == F.max("l_returnflag")) & (F.count("*") == F.count("l_returnflag")), F.max("l_returnflag"))
    return read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(value.alias("flag"))


@query("SELECT p_brand, p_name FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name), lower(p_name), p_name) AS r FROM part) WHERE r = 1")
def representative_min_by(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.min_by("p_name", F.struct(F.length("p_name"), F.lower("p_name"), F.col("p_name"))).alias("p_name"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def percentile_latency(spark, sf_dir):
    # exact ranks without a group in one task: bounds near the 64-quantiles cut each group into bins, a row's rank is
    # its place in its bin plus the rows of the bins before, and only the neighbours of each wanted rank count
    rows = read(spark, sf_dir, "events").select("event_type", F.col("value").cast("double").alias("value"))
    events = rows.filter("value IS NOT NULL")
    near = events.groupBy("event_type").agg(F.percentile_approx("value", [i / 64 for i in range(1, 64)]).alias("bounds")).collect()  # 63 numbers a type
    bounds = spark.createDataFrame([(r["event_type"], r["bounds"]) for r in near], "event_type string, bounds array<double>")
    bounds = F.broadcast(bounds) if len(near) <= 10_000 else bounds.hint("merge")  # never the events
    binned = events.join(bounds, "event_type").withColumn("bin", F.size(F.filter("bounds", lambda b: b < F.col("value")))).drop("bounds")
    before = W.partitionBy("event_type").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    sizes = binned.groupBy("event_type", "bin").agg(F.count("*").alias("k"))
    starts = sizes.select("event_type", "bin", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"), F.sum("k").over(W.partitionBy("event_type")).alias("n"))
    starts = F.broadcast(starts) if len(near) <= 10_000 else starts  # 64 rows a type
    ranked = binned.withColumn("at", F.row_number().over(W.partitionBy("event_type", "bin").orderBy("value")) - 1).join(starts, ["event_type", "bin"]).withColumn("rank", F.col("at") + F.col("start"))

    def at(p: float):
        place = F.lit(p) * (F.col("n") - 1)
        weight = F.greatest(1 - F.abs(F.col("rank") - place), F.lit(0.0))  # of the two neighbours, linear between them
        return F.round(F.sum(F.when(weight > 0, weight * F.col("value"))), 6)

    found = ranked.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    means = rows.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))  # types without a value stay
    return means.join(found, "event_type", "left").select("event_type", "p50", "p95", "mean")


@query("""
    SELECT p_partkey, levenshtein(p_name, p_type) AS edits,
           round(1.0 - levenshtein(p_name, p_type) * 1.0 / greatest(length(p_name), length(p_type), 1), 6) AS similarity FROM part
""")
def edit_similarity(spark, sf_dir):
    edits = F.levenshtein("p_name", "p_type")
    longest = F.greatest(F.length("p_name"), F.length("p_type"), F.lit(1))
    return read(spark, sf_dir, "part").select("p_partkey", edits.cast("long").alias("edits"), F.round(1 - edits / longest, 6).alias("similarity"))


@query("""
    SELECT doc_id, ((length(text) - length(replace(text, 'the ', ''))) / 4)::BIGINT AS n_the, ((length(text) - length(replace(text, ' de ', ''))) / 4)::BIGINT AS n_de
    FROM documents WHERE text IS NOT NULL
""")
def token_occurrences(spark, sf_dir):
    def times(token: str):
        return ((F.length("text") - F.length(F.replace("text", F.lit(token), F.lit("")))) / len(token)).cast("long")

    return read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", times("the ").alias("n_the"), times(" de ").alias("n_de"))


@query("""
    SELECT source, CASE WHEN sha256(source) < 'cccc' THEN 'train' WHEN sha256(source) < 'e666' THEN 'val' ELSE 'test' END AS split, count(*) AS n
    FROM documents GROUP BY source
""")
def stable_hash_split(spark, sf_dir):
    h = F.sha2("source", 256)
    split = F.when(h < "cccc", "train").when(h < "e666", "val").otherwise("test")
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).select("source", split.alias("split"), "n")


@query("""
    WITH s AS (SELECT text, count(DISTINCT CASE WHEN sha256(doc_id::VARCHAR) < 'cccc' THEN 'train' ELSE 'test' END) AS k, count(*) AS n FROM documents GROUP BY text)
    SELECT count(*) FILTER (k > 1) AS n_leaked_texts, coalesce(sum(n) FILTER (k > 1), 0)::BIGINT AS n_leaked_rows, count(*) AS n_texts FROM s
""")
def leakage_report(spark, sf_dir):
    split = F.when(F.sha2(F.col("doc_id").cast("string"), 256) < "cccc", 0).otherwise(1)
    texts = read(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("t")).agg((F.min(split) != F.max(split)).alias("leaked"), F.count("*").alias("n"))
    return texts.agg(F.count_if("leaked").alias("n_leaked_texts"), F.coalesce(F.sum(F.when(F.col("leaked"), F.col("n"))), F.lit(0)).alias("n_leaked_rows"), F.count("*").alias("n_texts"))


@query("""
    WITH need AS (SELECT l.lang, s.size FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (VALUES ('short'), ('medium'), ('long'), ('huge')) s(size)),
         have AS (SELECT lang, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'medium' WHEN n_chars < 50000 THEN 'long' ELSE 'huge' END AS size, count(*) AS n FROM documents GROUP BY ALL)
    SELECT need.lang, need.size, coalesce(n, 0) AS n FROM need LEFT JOIN have USING (lang, size) WHERE coalesce(n, 0) < 20
""")
def coverage_audit(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("lang", "n_chars")
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "medium").when(F.col("n_chars") < 50000, "long").otherwise("huge")
    have = docs.groupBy("lang", size.alias("size")).agg(F.count("*").alias("n"))
    need = docs.select("lang").distinct().select("lang", F.explode(F.array(*map(F.lit, ("short", "medium", "long", "huge")))).alias("size"))
    return need.join(have, ["lang", "size"], "left").select("lang", "size", F.coalesce("n", F.lit(0)).alias("n")).filter("n < 20")


@query("""
    SELECT n_nationkey, 'DURC_' || upper(left(sha256(n_name || chr(0) || r_name), 24)) AS concept_id
    FROM nation JOIN region ON r_regionkey = n_regionkey
""")
def deterministic_ids(spark, sf_dir):
    joined = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", names.digest_id("DURC", 24, F.col("n_name"), F.col("r_name")).alias("concept_id"))


@query("""
    WITH s AS (SELECT l_orderkey, to_json(list_sort(list_distinct(list(l_suppkey))))::VARCHAR AS sig FROM lineitem GROUP BY l_orderkey)
    SELECT sig, count(*) AS n_orders, min(l_orderkey) AS first_order FROM s GROUP BY sig HAVING count(*) > 1
""")
def set_signature_join(spark, sf_dir):
    sets = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_set("l_suppkey"))).alias("sig"))
    return sets.groupBy("sig").agg(F.count("*").alias("n_orders"), F.min("l_orderkey").alias("first_order")).filter("n_orders > 1")


@query("""
    SELECT lang, count(*) AS n, round(avg(quality), 6) AS quality_rate, round(avg(toxic), 6) AS toxic_rate,
           round(sum(quality * n_chars) * 1.0 / sum(n_chars), 6) AS weighted_quality
    FROM labels JOIN documents USING (doc_id) GROUP BY lang
""")
def slice_metrics(spark, sf_dir):
    joined = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return joined.groupBy("lang").agg(
        F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality_rate"), F.round(F.avg("toxic"), 6).alias("toxic_rate"),
        F.round(F.sum(F.col("quality") * F.col("n_chars")) / F.sum("n_chars"), 6).alias("weighted_quality"),
    )


@query("""
    SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 6 MONTH)::DATE AS due, (o_orderdate::DATE + INTERVAL 6 MONTH)::DATE <= DATE '1998-02-28' AS reached,
           greatest(year(DATE '2001-08-01') - year(o_orderdate) - CASE WHEN (month(DATE '2001-08-01'), day(DATE '2001-08-01')) < (month(o_orderdate), day(o_orderdate)) THEN 1 ELSE 0 END, 0)::BIGINT AS years
    FROM orders
""")
def age_threshold(spark, sf_dir):
    born = F.to_date("o_orderdate")
    years = rules.completed_years(born, F.lit("2001-08-01").cast("date"))
    due = F.add_months(born, 6)
    return read(spark, sf_dir, "orders").select("o_orderkey", due.alias("due"), (due <= F.lit("1998-02-28").cast("date")).alias("reached"), years.cast("long").alias("years"))


@query("""
    SELECT 'lineitem_orders' AS relation, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'lineitem_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'orders_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'customer_nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
    UNION ALL SELECT 'documents_labels', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def integrity_checks(spark, sf_dir):
    relations = (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("documents", "doc_id", "labels", "doc_id"))
    out = None
    for child, ck, parent, pk in relations:
        c, p = read(spark, sf_dir, child).select(F.col(ck).alias("k")), read(spark, sf_dir, parent).select(F.col(pk).alias("k"))
        one = c.join(p, "k", "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(f"{child}_{parent}").alias("relation"), "orphans")
        out = one if out is None else out.union(one)
    return out


@query("SELECT event_type, (props->>'$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT sha256(string_agg(r_regionkey::VARCHAR || chr(0) || r_name, chr(10) ORDER BY r_regionkey)) AS digest, count(*) AS n FROM region")
def manifest_digest(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name")))
    text = F.array_join(F.transform(rows, lambda x: F.concat(x["r_regionkey"].cast("string"), F.char(F.lit(0)), x["r_name"])), "\n")
    return read(spark, sf_dir, "region").agg(F.sha2(text, 256).alias("digest"), F.count("*").alias("n"))


@query("""
    SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn) AS roles, max(length(text)) AS longest FROM conversations GROUP BY conv_id
""")
def child_list_attach(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(turns, lambda x: x["role"]), ">").alias("roles"), F.max(F.length("text")).cast("long").alias("longest"))


@query("""
    WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
         r AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g)
    SELECT user_id, run::BIGINT AS run, count(*) AS n, min(ts) AS started FROM r GROUP BY ALL
""")
def consecutive_runs(spark, sf_dir):
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    events = read(spark, sf_dir, "events").select("user_id", "ts", "event_id").withColumn("before", F.lag("ts").over(order))
    fresh = F.when(F.col("ts") - F.col("before") <= F.expr("INTERVAL '6' HOUR"), 0).otherwise(1)
    return events.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order)).groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("ts").alias("started"))


@query("""
    SELECT o_orderpriority, o_orderstatus, grouping(o_orderpriority, o_orderstatus)::BIGINT AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority), ())
""")
def overall_and_slices(spark, sf_dir):
    return read(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
    SELECT o_orderkey,
           CASE WHEN today < s THEN 'upcoming' WHEN today > e THEN 'completed' ELSE 'active' END AS status,
           CAST(e - s + 1 AS INT) AS total_days,
           CAST(CASE WHEN today < s THEN 0 WHEN today > e THEN e - s + 1 ELSE today - s + 1 END AS INT) AS current_day,
           CAST(CASE WHEN today < s THEN e - s + 1 WHEN today > e THEN 0 ELSE e - today END AS INT) AS remaining_days,
           CAST(CASE WHEN today < s THEN 0 WHEN today > e THEN 100 ELSE round_even((today - s + 1) * 100.0::DOUBLE / (e - s + 1), 0) END AS INT) AS progress_percent
    FROM (SELECT o_orderkey, DATE '1998-01-01' AS today, CAST(o_orderdate AS DATE) AS s,
                 CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 * 20 AS INT) AS e FROM orders)
""")
def course_progress(spark, sf_dir):
    start = F.to_date("o_orderdate")
    end = F.date_add(start, (F.col("o_orderkey") % 60 * 20).cast("int"))
    state = rules.course_progress(start, end, F.lit("1998-01-01").cast("date"))
    return read(spark, sf_dir, "orders").select("o_orderkey", state.alias("state")).select("o_orderkey", "state.*")


@query("""
    WITH RECURSIVE ends AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer UNION ALL SELECT 1000000000 + s_suppkey, s_nationkey FROM supplier),
    least AS (SELECT n, min(k) AS component FROM ends GROUP BY n)
    SELECT k AS id, component FROM ends JOIN least USING (n) WHERE (SELECT count(*) FROM ends e WHERE e.n = ends.n) > 1
""")
def connected_components_by_nation(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    supplier = read(spark, sf_dir, "supplier").select((F.lit(1000000000) + F.col("s_suppkey")).alias("k"), F.col("s_nationkey").alias("n"))
    # a chain through each nation's members: each to the next by key
    ends = customer.union(supplier).withColumn("next", F.lead("k").over(W.partitionBy("n").orderBy("k")))
    return graph.components(ends.filter("next IS NOT NULL").select(F.col("k").alias("a"), F.col("next").alias("b")))
