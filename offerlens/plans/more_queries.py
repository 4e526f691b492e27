"""Registered queries: the rest of the normalisations, scores, matches and summaries, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerlens.functions import text as T
from offerlens.operators import offers as O
from offerlens.plans.offer_queries import offers, query
from offerlens.session import table


def _points(**parts):
    """The sum of points of the conditions that hold: {name: (condition, points)}."""
    total = F.lit(0)
    for condition, points in parts.values():
        total = total + F.when(condition, points).otherwise(0)
    return total.cast("bigint")


@query("prj6_effective_price", "WITH {OFFERS} SELECT offer_id, CASE WHEN sale_price < price AND state = 'O' THEN sale_price ELSE price END AS effective FROM offers")
def effective_price(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).select("offer_id", F.when((F.col("sale_price") < F.col("price")) & (F.col("state") == "O"), F.col("sale_price")).otherwise(F.col("price")).alias("effective"))


@query("prj8_shop_names", "SELECT s_suppkey, trim(split_part(s_name, '#', 1)) AS name, n_name AS nation FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def shop_names(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select("s_suppkey", F.trim(F.split_part("s_name", F.lit("#"), F.lit(1))).alias("name"), F.col("n_name").alias("nation"))


@query("prj9_extra_links", "SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))[1:3]) AS n_links FROM pages")
def extra_links(spark: SparkSession, d: str) -> DataFrame:
    """Up to three different links of a page."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return table(spark, d, "pages").select("page_id", F.least(F.size(links), F.lit(3)).cast("bigint").alias("n_links"))


@query("prj13_database_identity", "SELECT p_partkey, sha256(lower(p_brand) || '|' || lower(p_name) || '|' || p_size) AS identity FROM part")
def database_identity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.sha2(F.concat_ws("|", F.lower("p_brand"), F.lower("p_name"), F.col("p_size").cast("string")), 256).alias("identity"))


@query("prj14_page_keys", r"SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) || CASE WHEN regexp_matches(url, '[?&]page=') THEN '?' || regexp_extract(url, '[?&](page=[^&#]*)', 1) ELSE '' END AS page_key FROM pages")
def page_keys(spark: SparkSession, d: str) -> DataFrame:
    """Host and path, with the parameters that change the page and without those that only track."""
    part = lambda p: F.regexp_extract("url", p, 1)
    kept = F.when(F.col("url").rlike("[?&]page="), F.concat(F.lit("?"), part("[?&](page=[^&#]*)"))).otherwise("")
    return table(spark, d, "pages").select("page_id", F.concat(F.lower(part("^[a-z]+://([^/?#]*)")), part("^[a-z]+://[^/?#]*([^?#]*)"), kept).alias("page_key"))


@query("prj16_base_titles", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '(^| )(small|medium|large|economy|standard|promo)( |$)', ' ', 'g'), '\s+', ' ', 'g')) AS base FROM part")
def base_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.squeezed(F.regexp_replace(F.lower(F.concat_ws(" ", "p_name", "p_type")), "(^| )(small|medium|large|economy|standard|promo)( |$)", " ")).alias("base"))


@query("prj21_condition", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'not_new' WHEN 'A' THEN 'new' ELSE CASE WHEN l_tax > 0.04 THEN 'not_new' ELSE 'new' END END AS condition FROM lineitem")
def condition(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "not_new").when(F.col("l_returnflag") == "A", "new").when(F.col("l_tax") > 0.04, "not_new").otherwise("new").alias("condition"))


@query("prj25_lead_sentences", r"SELECT doc_id, regexp_extract(text, '^([^.\n]*)', 1) AS lead FROM documents")
def lead_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.regexp_extract("text", r"^([^.\n]*)", 1).alias("lead"))


@query("prj26_search_fields", "SELECT p_partkey, lower(p_name) AS title, lower(p_brand) AS brand, lower(p_type) AS category, lower(p_brand || ' | ' || p_type || ' | ' || p_name) AS all_fields FROM part")
def search_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("title"), F.lower("p_brand").alias("brand"), F.lower("p_type").alias("category"), F.lower(F.concat_ws(" | ", "p_brand", "p_type", "p_name")).alias("all_fields"))


@query("prj29_variant_types", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'size' WHEN p_size < 25 THEN 'capacity' WHEN p_size < 40 THEN 'power' ELSE 'option' END AS variant FROM part")
def variant_types(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.when(size < 10, "size").when(size < 25, "capacity").when(size < 40, "power").otherwise("option").alias("variant"))


@query("prj32_aisles_by_keyword", "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '(red|rose|pink)') THEN 'warm' WHEN regexp_matches(lower(p_name), '(blue|sky|navy)') THEN 'cool' ELSE 'plain' END AS aisle FROM part")
def aisles_by_keyword(spark: SparkSession, d: str) -> DataFrame:
    name = F.lower("p_name")
    return table(spark, d, "part").select("p_partkey", F.when(name.rlike("(red|rose|pink)"), "warm").when(name.rlike("(blue|sky|navy)"), "cool").otherwise("plain").alias("aisle"))


@query("flt4_token_classes", "SELECT event_id, CASE WHEN event_type IN ('purchase') THEN 'true' WHEN event_type IN ('view', 'click') THEN 'available' ELSE 'unknown' END AS token FROM events")
def token_classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "purchase", "true").when(F.col("event_type").isin("view", "click"), "available").otherwise("unknown").alias("token"))


@query("flt7_card_gate", "SELECT page_id, concat_ws(',', CASE WHEN coalesce(html, '') = '' THEN 'no_page' END, CASE WHEN NOT coalesce(contains(html, '<article>'), false) THEN 'no_text' END, CASE WHEN length(url) > 60 THEN 'odd_url' END) AS reasons FROM pages")
def card_gate(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    held = O.reasons(a_no_page=F.coalesce(html, F.lit("")) == "", b_no_text=~F.coalesce(html.contains("<article>"), F.lit(False)), c_odd_url=F.length("url") > 60)
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.array_join(held, ","), "[abc]_", "").alias("reasons"))


@query("flt9_purchasability", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'verified' WHEN o_orderstatus = 'F' THEN 'not_purchasable' WHEN o_orderstatus = 'O' THEN 'purchasable' ELSE 'unknown' END AS state FROM orders")
def purchasability(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "verified").when(status == "F", "not_purchasable").when(status == "O", "purchasable").otherwise("unknown").alias("state"))


@query("flt12_remediation", "SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'top_up' END, CASE WHEN n IS NULL THEN 'first_order' END) AS actions, CASE WHEN c_acctbal < 0 OR n IS NULL THEN 'open' ELSE 'done' END AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def remediation(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined = table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    low, none = F.col("c_acctbal") < 0, F.col("n").isNull()
    return joined.select("c_custkey", F.concat_ws(",", F.when(low, F.lit("top_up")), F.when(none, F.lit("first_order"))).alias("actions"), F.when(low | none, "open").otherwise("done").alias("status"))


@query("flt18_rollout_tiers", "SELECT shop, CASE WHEN n >= 90 AND returned * 4 < n THEN 'full' WHEN n >= 60 THEN 'half' WHEN n >= 30 THEN 'trial' ELSE 'none' END AS tier FROM (SELECT l_suppkey AS shop, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY l_suppkey)")
def rollout_tiers(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("shop")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    return per.select("shop", F.when((F.col("n") >= 90) & (F.col("returned") * 4 < F.col("n")), "full").when(F.col("n") >= 60, "half").when(F.col("n") >= 30, "trial").otherwise("none").alias("tier"))


@query("flt28_vocabulary_admission", "WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS word FROM benchmark) SELECT word, count(*) AS n, CASE WHEN length(word) < 3 THEN 'too_short' WHEN count(*) < 2 THEN 'too_rare' ELSE 'admitted' END AS status FROM w GROUP BY word")
def vocabulary_admission(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "benchmark").select(F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.withColumn("status", F.when(F.length("word") < 3, "too_short").when(F.col("n") < 2, "too_rare").otherwise("admitted"))


@query("jn19_reliability_lookup", "SELECT l_orderkey, l_linenumber, CASE WHEN s_acctbal > 5000 THEN 'high' WHEN s_acctbal > 0 THEN 'fair' ELSE 'low' END AS reliability FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey")
def reliability_lookup(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("s_acctbal") > 5000, "high").when(F.col("s_acctbal") > 0, "fair").otherwise("low")
    return table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", level.alias("reliability"))


@query("jn23_longer_keywords", "SELECT DISTINCT a.p_name AS short, b.p_name AS long FROM (SELECT DISTINCT p_brand, split_part(p_name, ' ', 1) AS p_name FROM part) a JOIN part b ON a.p_brand = b.p_brand AND b.p_name LIKE a.p_name || ' %' AND len(string_split(b.p_name, ' ')) <= len(string_split(a.p_name, ' ')) + 2")
def longer_keywords(spark: SparkSession, d: str) -> DataFrame:
    """First words of names beside the brand's names that go on with one or two more words: a name meets its own beginnings, so the join is on equal names."""
    part = table(spark, d, "part").select("p_brand", F.col("p_name").alias("long"), F.split("p_name", " ").alias("w")).distinct()
    starts = part.select("p_brand", "long", F.explode(F.array(*[F.when(F.size("w") > k, F.array_join(F.slice("w", F.lit(1), F.greatest(F.size("w") - k, F.lit(1))), " ")) for k in (1, 2)])).alias("short")).where("short IS NOT NULL")
    return starts.join(part.select("p_brand", F.col("w")[0].alias("short")).distinct(), ["p_brand", "short"]).select("short", "long").distinct()


@query(
    "jn29_neighbourhood_counts",
    """WITH n AS (SELECT DISTINCT lower(p_type) AS kind, unnest(string_split(lower(p_name), ' ')) AS word FROM part), q AS (SELECT DISTINCT word FROM n)
    SELECT q.word AS word, count(DISTINCT n.word) AS n_words, count(DISTINCT n.kind) AS n_kinds FROM q JOIN n ON levenshtein(q.word, n.word) <= 2 GROUP BY q.word""",
)
def neighbourhood_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many title words and kinds lie within two edits of a word: words that are that near share a word of at most two deletions each."""
    rows = table(spark, d, "part").select(F.lower("p_type").alias("kind"), F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    words = rows.select("word").distinct()
    cuts = lambda c: F.array_distinct(F.flatten(F.transform(T.deletions(c), lambda x: T.deletions(x))))
    a, b = words.select("word", F.explode(cuts(F.col("word"))).alias("cut")), words.select(F.col("word").alias("near"), F.explode(cuts(F.col("word"))).alias("cut"))
    pairs = a.join(b, "cut").select("word", "near").distinct().where(F.levenshtein("word", "near", 2) >= 0)
    return pairs.join(rows.select("kind", F.col("word").alias("near")), "near").groupBy("word").agg(F.count_distinct("near").alias("n_words"), F.count_distinct("kind").alias("n_kinds"))


@query("jn18_scenario_product", "SELECT r_name AS region, p_type AS kind, m AS segment, f AS flag FROM region, (SELECT DISTINCT p_type FROM part), (SELECT DISTINCT c_mktsegment AS m FROM customer), (SELECT DISTINCT l_returnflag AS f FROM lineitem)")
def scenario_product(spark: SparkSession, d: str) -> DataFrame:
    """Every combination of four short dimensions; each is one row a value before they are combined."""
    dims = [table(spark, d, "region").select(F.col("r_name").alias("region")), table(spark, d, "part").select(F.col("p_type").alias("kind")).distinct(), table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment")).distinct(), table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag")).distinct()]
    out = dims[0]
    for dim in dims[1:]:
        out = out.crossJoin(F.broadcast(dim))
    return out


@query("agg12_most_common_first_seen", "WITH c AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS first_seen FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, first_seen) AS k FROM c) SELECT p_brand, p_type, n FROM r WHERE k = 1")
def most_common(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_seen"))
    return O.top_k(counts, "p_brand", 1, F.desc("n"), F.col("first_seen")).select("p_brand", "p_type", "n")


@query("agg22_node_coverage", "SELECT n_name AS category, count(DISTINCT s_suppkey) AS n_shops, count(DISTINCT s_suppkey) < 2 AS weak FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def node_coverage(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy(F.col("n_name").alias("category")).agg(F.count_distinct("s_suppkey").alias("n_shops")).withColumn("weak", F.col("n_shops") < 2)


@query("agg23_audit_coverage", "SELECT lang, count(*) AS n, count(*) FILTER (n_chars < 200) AS short, CASE WHEN count(*) >= 100 THEN 'strong' WHEN count(*) >= 40 THEN 'fair' ELSE 'weak' END AS strength FROM documents GROUP BY lang")
def audit_coverage(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 200).alias("short"))
    return per.withColumn("strength", F.when(F.col("n") >= 100, "strong").when(F.col("n") >= 40, "fair").otherwise("weak"))


@query("agg33_sale_readings", "WITH {OFFERS}, r AS (SELECT shop, CASE WHEN sale_price < price THEN 'lower' ELSE 'same' END AS reading, count(*) AS n FROM offers GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY reading ORDER BY n DESC, shop) AS place FROM r) SELECT reading, shop, n, place FROM k WHERE place <= 8")
def sale_readings(spark: SparkSession, d: str) -> DataFrame:
    counts = offers(spark, d).groupBy(F.when(F.col("sale_price") < F.col("price"), "lower").otherwise("same").alias("reading"), "shop").agg(F.count("*").alias("n"))
    return O.top_k(counts, "reading", 8, F.desc("n"), F.col("shop")).select("reading", "shop", "n", "place")


@query("agg37_ambiguity", "WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS k, sum(n) OVER (PARTITION BY p_brand) AS total FROM c) SELECT p_brand, coalesce(max(n) FILTER (k = 2), 0) * 10 >= max(total) AS ambiguous FROM r GROUP BY p_brand")
def ambiguity(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("p_brand")))
    two = O.top_k(counts, "p_brand", 2, F.desc("n"), F.col("p_type"))
    return two.groupBy("p_brand").agg((F.coalesce(F.max(F.when(F.col("place") == 2, F.col("n"))), F.lit(0)) * 10 >= F.max("total")).alias("ambiguous"))


@query("agg41_feed_comparison", "WITH {OFFERS} SELECT p_type AS kind, count(DISTINCT product) FILTER (flag = 'A') AS in_a, count(DISTINCT product) FILTER (flag = 'R') AS in_b, count(DISTINCT product) AS in_any FROM offers JOIN part ON p_partkey = product GROUP BY p_type")
def feed_comparison(spark: SparkSession, d: str) -> DataFrame:
    per = offers(spark, d).groupBy("product").agg(F.max((F.col("flag") == "A").cast("int")).alias("a"), F.max((F.col("flag") == "R").cast("int")).alias("b"))
    return per.join(table(spark, d, "part"), F.col("product") == F.col("p_partkey")).groupBy(F.col("p_type").alias("kind")).agg(F.count_if(F.col("a") == 1).alias("in_a"), F.count_if(F.col("b") == 1).alias("in_b"), F.count("*").alias("in_any"))


@query("agg42_feed_status", "SELECT s_suppkey AS shop, CASE WHEN n IS NULL THEN 'empty' WHEN live = 0 THEN 'none_eligible' WHEN live * 2 >= n THEN 'ready' ELSE 'loaded' END AS status FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS live FROM lineitem GROUP BY l_suppkey) ON l_suppkey = s_suppkey")
def feed_status(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("live"))
    joined = table(spark, d, "supplier").join(per, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return joined.select(F.col("s_suppkey").alias("shop"), F.when(F.col("n").isNull(), "empty").when(F.col("live") == 0, "none_eligible").when(F.col("live") * 2 >= F.col("n"), "ready").otherwise("loaded").alias("status"))


@query("agg45_scoreboard", "SELECT role, turn % 4 AS part, count(*) AS n, count(*) FILTER (length(text) < 80) AS short, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY ALL")
def scoreboard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role", (F.col("turn") % 4).alias("part")).agg(F.count("*").alias("n"), F.count_if(F.length("text") < 80).alias("short"), F.sum(F.length("text")).alias("chars"))


@query("agg48_broad_terms", "WITH w AS (SELECT p_type AS category, unnest(string_split(lower(p_name), ' ')) AS term FROM part), c AS (SELECT category, term, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, term) AS place FROM c) SELECT category, term, n FROM r WHERE place <= 5")
def broad_terms(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "part").select(F.col("p_type").alias("category"), F.explode(F.split(F.lower("p_name"), " ")).alias("term")).groupBy("category", "term").agg(F.count("*").alias("n")).where("n >= 2")
    return O.top_k(counts, "category", 5, F.desc("n"), F.col("term")).select("category", "term", "n")


@query("fn19_query_routes", r"SELECT item_id, CASE WHEN len(string_split(text, ' ')) < 12 THEN 'ambiguous' WHEN regexp_matches(text, '[0-9]') THEN 'specific' ELSE 'general' END AS route FROM benchmark")
def query_routes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.when(F.size(F.split("text", " ")) < 12, "ambiguous").when(F.col("text").rlike("[0-9]"), "specific").otherwise("general").alias("route"))


@query("fn21_keyword_scores", "SELECT doc_id, CAST(2 * contains(lower(text), 'the')::INT + 2 * contains(lower(text), 'und')::INT + 5 * contains(text, '|')::INT AS BIGINT) AS score FROM documents")
def keyword_scores(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    return table(spark, d, "documents").select("doc_id", _points(a=(low.contains("the"), 2), b=(low.contains("und"), 2), c=(F.col("text").contains("|"), 5)).alias("score"))


@query("fn23_relevance", "SELECT p_partkey, CAST(100 * contains(lower(p_name), 'a')::INT + 55 * contains(lower(p_brand), '1')::INT + 40 * (p_type = 'PROMO')::INT - 220 * (p_size > 45)::INT AS BIGINT) AS score FROM part")
def relevance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", _points(title=(F.lower("p_name").contains("a"), 100), brand=(F.lower("p_brand").contains("1"), 55), kind=(F.col("p_type") == "PROMO", 40), extra=(F.col("p_size") > 45, -220)).alias("score"))


@query("win8_rank_classes", "WITH {OFFERS}, c AS (SELECT shop, offer_id, price, CASE WHEN flag = 'N' THEN 0 WHEN flag = 'A' THEN 1 ELSE 2 END AS class FROM offers), r AS (SELECT *, row_number() OVER (PARTITION BY shop ORDER BY class, price, offer_id) AS place FROM c) SELECT shop, offer_id, class, place FROM r WHERE place <= 6")
def rank_classes(spark: SparkSession, d: str) -> DataFrame:
    classed = offers(spark, d).withColumn("class", F.when(F.col("flag") == "N", 0).when(F.col("flag") == "A", 1).otherwise(2))
    return O.top_k(classed, "shop", 6, F.col("class"), F.col("price"), F.col("offer_id")).select("shop", "offer_id", "class", "place")


@query("srt6_size_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 ELSE 3 END, p_size, p_partkey) AS place FROM part")
def size_order(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("p_type") == "SMALL", 0).when(F.col("p_type") == "MEDIUM", 1).when(F.col("p_type") == "LARGE", 2).otherwise(3)
    return table(spark, d, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(size, "p_size", "p_partkey")).cast("bigint").alias("place"))


@query("str10_shadow_comparison", "SELECT quality, long, count(*) AS n, CASE WHEN quality = long THEN 'same' WHEN quality > long THEN 'missed' ELSE 'extra' END AS status FROM (SELECT quality, CAST(n_chars >= 600 AS INT) AS long FROM documents JOIN labels USING (doc_id)) GROUP BY ALL")
def shadow_comparison(spark: SparkSession, d: str) -> DataFrame:
    """A simple rule (long texts are good) beside the labels."""
    joined = table(spark, d, "documents").select("doc_id", (F.col("n_chars") >= 600).cast("int").alias("long")).join(table(spark, d, "labels"), "doc_id")
    counts = joined.groupBy("quality", "long").agg(F.count("*").alias("n"))
    return counts.withColumn("status", F.when(F.col("quality") == F.col("long"), "same").when(F.col("quality") > F.col("long"), "missed").otherwise("extra"))
