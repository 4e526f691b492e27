"""Registered queries on feeds, memory and events, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerlens.functions import text as T
from offerlens.operators import matching as M
from offerlens.operators import offers as O
from offerlens.plans.offer_queries import query
from offerlens.session import table
from offerlens.sources import feeds
from offerlens.streaming import events as E


@query(
    "src8_taxonomy_paths",
    """WITH p AS (SELECT DISTINCT p_brand || ' > ' || array_to_string(string_split(p_type, ' '), ' > ') AS path FROM part), s AS (SELECT path, string_split(path, ' > ') AS parts FROM p)
    SELECT 'node_' || substr(sha256(array_to_string(parts, '>')), 1, 16) AS node_id, path, parts[-1] AS leaf, CASE WHEN len(parts) > 1 THEN parts[-2] END AS parent, len(parts) AS depth FROM s""",
)
def taxonomy_paths(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "part").select(F.concat(F.lit("12 - "), "p_brand", F.lit(" >"), F.regexp_replace("p_type", " ", ">")).alias("line")).distinct()
    return feeds.taxonomy(lines, "line")


@query("snk7_site_map_batches", "SELECT count(*) AS n_urls, count(DISTINCT batch) AS n_batches, max(c) AS largest FROM (SELECT url, batch, count(*) OVER (PARTITION BY batch) AS c FROM (SELECT url, (row_number() OVER (ORDER BY url) - 1) // 50 AS batch FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)))")
def site_map_batches(spark: SparkSession, d: str) -> DataFrame:
    batches = feeds.site_map(table(spark, d, "pages").select("url").where("url IS NOT NULL").distinct(), 50, F.col("url"))
    return batches.groupBy("batch").agg(F.count("*").alias("c")).agg(F.sum("c").alias("n_urls"), F.count("*").alias("n_batches"), F.max("c").alias("largest"))


@query(
    "snk3_nightly_memory",
    """WITH x AS (SELECT l_partkey AS key, CAST(l_shipdate AS DATE) AS night, min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS price FROM lineitem GROUP BY ALL),
    old AS (SELECT key, min(night) AS first_seen, max(night) AS last_seen, count(*) AS nights_seen, arg_max(price, night) AS price FROM x WHERE night < DATE '1996-06-01' GROUP BY key),
    new AS (SELECT key, min(price) AS price FROM x WHERE night BETWEEN DATE '1996-06-01' AND DATE '1996-06-30' GROUP BY key)
    SELECT key, coalesce(first_seen, DATE '1996-06-30') AS first_seen, CASE WHEN new.price IS NOT NULL THEN DATE '1996-06-30' ELSE last_seen END AS last_seen, coalesce(nights_seen, 0) + (new.price IS NOT NULL)::BIGINT AS nights_seen,
        coalesce(new.price, old.price) AS price, CASE WHEN new.price IS NOT NULL AND new.price IS DISTINCT FROM old.price THEN DATE '1996-06-30' ELSE last_seen END AS changed_on FROM old FULL JOIN new USING (key)""",
)
def nightly_memory(spark: SparkSession, d: str) -> DataFrame:
    rows = O.offers_of(table(spark, d, "lineitem")).groupBy(F.col("product").alias("key"), "night").agg(F.min("price").alias("price"))
    old = rows.where("night < DATE '1996-06-01'").groupBy("key").agg(F.min("night").alias("first_seen"), F.max("night").alias("last_seen"), F.count("*").alias("nights_seen"), F.max_by("price", "night").alias("price")).withColumn("changed_on", F.col("last_seen"))
    new = rows.where("night BETWEEN DATE '1996-06-01' AND DATE '1996-06-30'").groupBy("key").agg(F.min("price").alias("price"))
    return feeds.remembered(old, new, "1996-06-30")


@query("str1_event_days_streamed", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def event_days_streamed(spark: SparkSession, d: str) -> DataFrame:
    return E.day_counts(spark, d)


@query(
    "str1_user_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM events),
    s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first_ts, count(*) AS n_events FROM s GROUP BY user_id, k""",
)
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    return E.sessions(table(spark, d, "events"), "6 hours")


@query(
    "agg32_nightly_summary",
    """WITH x AS (SELECT DISTINCT l_partkey AS product, date_trunc('month', l_shipdate)::DATE AS month FROM lineitem), f AS (SELECT product, month, lag(month) OVER (PARTITION BY product ORDER BY month) AS before, lead(month) OVER (PARTITION BY product ORDER BY month) AS after FROM x)
    SELECT month, count(*) AS seen, count(*) FILTER (before IS NULL) AS new, count(*) FILTER (before IS NOT NULL AND before <> month - INTERVAL 1 MONTH) AS back, count(*) FILTER (after IS NULL) AS last FROM f GROUP BY month""",
)
def nightly_summary(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("product").orderBy("month")
    seen = table(spark, d, "lineitem").select(F.col("l_partkey").alias("product"), F.trunc("l_shipdate", "month").alias("month")).distinct().withColumns({"before": F.lag("month").over(by), "after": F.lead("month").over(by)})
    return seen.groupBy("month").agg(F.count("*").alias("seen"), F.count_if(F.col("before").isNull()).alias("new"), F.count_if(F.col("before") != F.add_months("month", -1)).alias("back"), F.count_if(F.col("after").isNull()).alias("last"))


@query(
    "win11_change_vs_held",
    """WITH o AS (SELECT l_partkey AS product, CAST(l_shipdate AS DATE) AS night, min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS price FROM lineitem GROUP BY ALL), l AS (SELECT *, lag(price) OVER w AS held, night - lag(night) OVER w AS age FROM o WINDOW w AS (PARTITION BY product ORDER BY night))
    SELECT product, night, price, held, CASE WHEN held IS NULL THEN 'first' WHEN age > 30 THEN 'watch' WHEN abs(price - held) >= 100 AND abs(price - held) * 100 >= held THEN CASE WHEN price < held THEN 'down' ELSE 'up' END ELSE 'same' END AS change FROM l""",
)
def change_vs_held(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("product").orderBy("night")
    rows = O.offers_of(table(spark, d, "lineitem")).groupBy("product", "night").agg(F.min("price").alias("price")).withColumns({"held": F.lag("price").over(by), "age": F.datediff("night", F.lag("night").over(by))})
    far = F.abs(F.col("price") - F.col("held"))
    change = F.when(F.col("held").isNull(), "first").when(F.col("age") > 30, "watch").when((far >= 100) & (far * 100 >= F.col("held")), F.when(F.col("price") < F.col("held"), "down").otherwise("up")).otherwise("same")
    return rows.select("product", "night", "price", "held", change.alias("change"))


@query(
    "win9_zone_spread",
    """WITH o AS (SELECT l_suppkey AS shop, CAST(round(l_extendedprice * 100) AS BIGINT) AS price FROM lineitem), p AS (SELECT DISTINCT shop, price FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY shop ORDER BY price) - 1 AS i, count(*) OVER (PARTITION BY shop) AS n FROM p)
    SELECT shop, price FROM r WHERE i = 0 OR i = n - 1 OR i = (n - 1) // 3 OR i = 2 * (n - 1) // 3""",
)
def zone_spread(spark: SparkSession, d: str) -> DataFrame:
    """Of each shop four evenly spaced distinct prices, with both ends."""
    distinct = O.offers_of(table(spark, d, "lineitem")).select("shop", "price").distinct()
    by = Window.partitionBy("shop")
    placed = distinct.withColumns({"i": F.row_number().over(by.orderBy("price")) - 1, "n": F.count("*").over(by)})
    places = F.array(*[F.floor(F.lit(k) * (F.col("n") - 1) / 3) for k in range(4)])
    return placed.where(F.array_contains(places, F.col("i").cast("bigint"))).select("shop", "price")


@query(
    "win13_running_duplicates",
    "SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS copy, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents",
)
def running_duplicates(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("h")
    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    return rows.select("doc_id", F.row_number().over(by.orderBy("doc_id")).cast("bigint").alias("copy"), F.count("*").over(by).alias("copies"))


@query("win16_role_diverse", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer), s AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY k, c_acctbal DESC, c_custkey) AS place FROM r) SELECT c_nationkey, c_custkey, c_mktsegment, place FROM s WHERE place <= 4")
def role_diverse(spark: SparkSession, d: str) -> DataFrame:
    """Of each nation four customers: the best of each segment first, then the next ones."""
    best = F.row_number().over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    ranked = table(spark, d, "customer").withColumn("k", best)
    return O.top_k(ranked, "c_nationkey", 4, F.col("k"), F.desc("c_acctbal"), F.col("c_custkey")).select("c_nationkey", "c_custkey", "c_mktsegment", "place")


@query("srt1_total_order", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY CAST(round(p_retailprice * 100) AS BIGINT), lower(p_name), p_partkey) AS place FROM part")
def total_order(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("p_brand").orderBy(F.round(F.col("p_retailprice") * 100).cast("bigint"), F.lower("p_name"), "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.rank().over(by).cast("bigint").alias("place"))


@query("srt7_recheck_queue", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN o_last IS NULL THEN 0 ELSE 1 END, o_last, c_custkey) AS place FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS o_last FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def recheck_queue(spark: SparkSession, d: str) -> DataFrame:
    """Who to look at next: those never seen first, then the longest unseen."""
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_last"))
    joined = table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.asc_nulls_first("o_last"), "c_custkey")).cast("bigint").alias("place"))


@query(
    "set4_title_differences",
    """WITH p AS (SELECT p_partkey, p_brand, p_size, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part), x AS (SELECT a.p_partkey AS a, b.p_partkey AS b, len(list_filter(a.w, lambda t: NOT list_contains(b.w, t))) AS only_a, len(list_filter(b.w, lambda t: NOT list_contains(a.w, t))) AS only_b
        FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey)
    SELECT a, b, CASE WHEN only_a = 0 AND only_b = 0 THEN 'same' WHEN only_a > 0 AND only_b > 0 THEN 'certain' ELSE 'doubtful' END AS difference FROM x""",
)
def title_differences(spark: SparkSession, d: str) -> DataFrame:
    """Products of one brand and size: whether each title has words of its own, one has, or none. Equal titles are compared once."""
    words = F.array_sort(F.array_distinct(F.split(F.lower("p_name"), " ")))
    own = M.blocks(table(spark, d, "part").select("p_partkey", "p_brand", "p_size", words.alias("words")), "p_partkey", ["p_brand", "p_size"])
    has_own = lambda p, q: F.size(F.array_except(p, q)) > 0
    difference = F.when(~has_own("x", "y") & ~has_own("y", "x"), "same").when(has_own("x", "y") & has_own("y", "x"), "certain").otherwise("doubtful")
    pairs = M.block_pairs(own, ["p_brand", "p_size"], "x", "y").withColumn("difference", difference)
    return M.row_pairs(pairs, "x", "y", "difference")


@query(
    "agg8_kinds_by_shops",
    "WITH s AS (SELECT p_type, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_type) SELECT CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' ELSE '3+' END AS shops, count(*) AS n_kinds FROM s GROUP BY 1",
)
def kinds_by_shops(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(F.count_distinct("l_suppkey").alias("n"))
    return kinds.groupBy(F.when(F.col("n") == 1, "1").when(F.col("n") == 2, "2").otherwise("3+").alias("shops")).agg(F.count("*").alias("n_kinds"))


@query(
    "agg21_coverage_matrix",
    "SELECT r_name AS region, n_name AS nation, count(DISTINCT c_custkey) AS n_customers, count(DISTINCT o_orderkey) AS n_orders, count(DISTINCT c_custkey) FILTER (o_orderkey IS NULL) AS n_silent FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
)
def coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "customer").join(table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), F.col("c_custkey") == F.col("o_custkey"), "left")
    nations = per.groupBy("c_nationkey").agg(F.count("*").alias("n_customers"), F.sum(F.coalesce("n", F.lit(0))).alias("n_orders"), F.count_if(F.col("n").isNull()).alias("n_silent"))
    named = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(nations, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return named.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_customers", "n_orders", "n_silent")])


@query("agg40_answer_digests", "WITH r AS (SELECT l_suppkey AS shop, l_orderkey || '-' || l_linenumber AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(round(l_extendedprice * 100) AS BIGINT), l_orderkey, l_linenumber) AS k FROM lineitem) SELECT shop, sha256(string_agg(id, '|' ORDER BY k)) AS digest FROM r WHERE k <= 30 GROUP BY shop")
def answer_digests(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("shop"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price"), "l_orderkey", "l_linenumber")
    first = O.top_k(rows, "shop", 30, F.col("price"), F.col("l_orderkey"), F.col("l_linenumber"))
    return first.groupBy("shop").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("p")).select("shop", F.sha2(F.array_join("p.id", "|"), 256).alias("digest"))


@query("fn29_event_json", "SELECT event_id, json_extract_string(props, '$.page') AS page, length(props) AS size FROM events")
def event_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.length("props").cast("bigint").alias("size"))


@query("conversation_turns", "SELECT conv_id, count(*) AS n_turns, count(DISTINCT role) AS n_roles, max(length(text)) AS longest, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id")
def conversation_turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_distinct("role").alias("n_roles"), F.max(F.length("text")).cast("bigint").alias("longest"), F.min_by("role", "turn").alias("first_role"))


@query("jn28_cached_urls", "WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS k FROM pages), c AS (SELECT k, min(page_id) AS first_page FROM p GROUP BY k) SELECT page_id, first_page, page_id = first_page AS fresh FROM p JOIN c USING (k)")
def cached_urls(spark: SparkSession, d: str) -> DataFrame:
    page = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("k"))
    first = page.groupBy("k").agg(F.min("page_id").alias("first_page"))
    return page.join(first, "k").select("page_id", "first_page", (F.col("page_id") == F.col("first_page")).alias("fresh"))


@query("agg18_suggestions", "WITH w AS (SELECT p_brand || ' ' || string_split(p_type, ' ')[-1] AS phrase, p_brand FROM part), c AS (SELECT p_brand, phrase, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, phrase) AS place FROM c) SELECT phrase, n FROM r WHERE place <= 3")
def suggestions(spark: SparkSession, d: str) -> DataFrame:
    phrases = table(spark, d, "part").select("p_brand", F.concat_ws(" ", "p_brand", F.element_at(F.split("p_type", " "), -1)).alias("phrase")).groupBy("p_brand", "phrase").agg(F.count("*").alias("n")).where("n >= 2")
    return O.top_k(phrases, "p_brand", 3, F.desc("n"), F.col("phrase")).select("phrase", "n")


@query("prj20_query_specs", r"SELECT p_partkey, regexp_extract(s, '([0-9]+) ?(?:kg|cm|l)', 1) AS amount, regexp_extract(s, '[0-9]+ ?(kg|cm|l)', 1) AS unit FROM (SELECT p_partkey, lower(p_name) || ' ' || p_size || CASE p_partkey % 3 WHEN 0 THEN 'kg' WHEN 1 THEN ' cm' ELSE ' l' END AS s FROM part)")
def query_specs(spark: SparkSession, d: str) -> DataFrame:
    unit = F.when(F.col("p_partkey") % 3 == 0, "kg").when(F.col("p_partkey") % 3 == 1, " cm").otherwise(" l")
    text = F.concat(F.lower("p_name"), F.lit(" "), F.col("p_size").cast("string"), unit)
    return table(spark, d, "part").select("p_partkey", F.regexp_extract(text, "([0-9]+) ?(?:kg|cm|l)", 1).alias("amount"), F.regexp_extract(text, "[0-9]+ ?(kg|cm|l)", 1).alias("unit"))


@query("fn20_capped_confidence", "SELECT c_custkey, CAST(least(950, 450 + 50 * n) AS BIGINT) AS confidence FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
def capped_confidence(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined = table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.least(F.lit(950), 450 + 50 * F.coalesce("n", F.lit(0))).cast("bigint").alias("confidence"))


@query("fn26_url_parts", r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, d, "pages").select("page_id", part("^([a-z]+)://").alias("scheme"), F.lower(part("^[a-z]+://([^/?#]*)")).alias("host"), part("^[a-z]+://[^/?#]*([^?#]*)").alias("path"), part(r"\?([^#]*)").alias("query"))


@query("jn24_close_titles", "WITH p AS (SELECT p_partkey, p_type, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part) SELECT a.p_partkey AS a, b.p_partkey AS b FROM p a JOIN p b ON a.p_type = b.p_type AND a.p_partkey < b.p_partkey WHERE len(list_intersect(a.w, b.w)) >= least(len(a.w), len(b.w), 3)")
def close_titles(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of products of one type whose titles share three words, or all of the shorter one."""
    words = F.sort_array(F.array_distinct(F.split(F.lower("p_name"), " ")))
    return M.close_rows(table(spark, d, "part").select("p_partkey", "p_type", words.alias("words")), "p_partkey", ["p_type"])


@query("fn2_normal_words", "SELECT item_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS words FROM benchmark")
def normal_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.words(F.col("text")), " ").alias("words"))
