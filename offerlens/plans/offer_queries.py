"""Registered queries on offers, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerlens.functions import price as P
from offerlens.functions import text as T
from offerlens.operators import matching as M
from offerlens.operators import offers as O
from offerlens.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The canonical offers in SQL, as offers_of() makes them.
OFFERS = """offers AS (
    SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS offer_id, l_partkey AS product, l_suppkey AS shop,
           CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
           CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) // 100 AS sale_price,
           CAST(l_shipdate AS DATE) AS night, l_returnflag AS flag, l_linestatus AS state, CAST(l_quantity AS BIGINT) AS quantity
    FROM lineitem
)"""


def query(name: str, sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("{OFFERS}", OFFERS)
        return f

    return add


def offers(spark: SparkSession, d: str) -> DataFrame:
    return O.offers_of(table(spark, d, "lineitem"))


@query(
    "flagship_best_offer_page",
    """WITH {OFFERS}, live AS (SELECT * FROM offers WHERE flag <> 'R' AND price > 0),
    best AS (SELECT product, min(price) AS price, count(*) AS n_offers, count(DISTINCT shop) AS n_shops FROM live GROUP BY product),
    pick AS (SELECT product, arg_min(offer_id, (price, offer_id)) AS offer_id FROM live GROUP BY product),
    named AS (SELECT p_brand AS brand, p_name AS title, b.product, offer_id, price, n_offers, n_shops FROM best b JOIN pick USING (product) JOIN part ON p_partkey = b.product),
    ranked AS (SELECT *, rank() OVER (PARTITION BY brand ORDER BY price) AS rank, row_number() OVER (PARTITION BY brand ORDER BY price, product) AS place FROM named)
    SELECT brand, title, product, offer_id, price, n_offers, n_shops, rank FROM ranked WHERE place <= 4""",
)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Of each brand the four cheapest products: each with its cheapest offer, its number of shops, and its price rank."""
    best = O.cheapest(offers(spark, d).where("flag <> 'R' AND price > 0")).drop("shop")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("product"), F.col("p_brand").alias("brand"), F.col("p_name").alias("title"))
    named = best.join(part, "product")
    ranked = named.withColumn("rank", F.rank().over(Window.partitionBy("brand").orderBy("price")).cast("bigint"))
    return O.top_k(ranked, "brand", 4, F.col("price"), F.col("product")).select("brand", "title", "product", "offer_id", "price", "n_offers", "n_shops", "rank")


@query("prj1_canonical_offers", "WITH {OFFERS} SELECT * FROM offers")
def canonical(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d)


@query(
    "prj2_first_filled",
    "SELECT event_id, coalesce(nullif(trim(json_extract_string(props, '$.ref')), ''), nullif(trim(event_type), ''), 'none') AS label FROM events",
)
def first_filled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.coalesce(T.filled(F.get_json_object("props", "$.ref"), F.col("event_type")), F.lit("none")).alias("label"))


@query(
    "prj3_price_text",
    """SELECT p_partkey, text, CASE
        WHEN p_partkey % 4 = 3 THEN NULL ELSE CAST(round(p_retailprice * 100) AS BIGINT) END AS pence
    FROM (SELECT *, CASE p_partkey % 4
        WHEN 0 THEN concat('GBP ', CAST(CAST(round(p_retailprice * 100) AS BIGINT) // 100 AS VARCHAR), '.', lpad(CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0'))
        WHEN 1 THEN concat(CAST(CAST(round(p_retailprice * 100) AS BIGINT) // 100 AS VARCHAR), ',', lpad(CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0'), ' EUR')
        WHEN 2 THEN concat('0.', lpad(CAST(CAST(round(p_retailprice * 100) AS BIGINT) // 100 AS VARCHAR), 9, '0'), ',', lpad(CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0'))
        ELSE concat('-', CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR)) END AS text FROM part)""",
)
def price_text(spark: SparkSession, d: str) -> DataFrame:
    """Prices written in four ways (points, commas, both, below zero) are read back."""
    cents = P.pence(F.col("p_retailprice"))
    whole, part = F.floor(cents / 100).cast("bigint").cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    kind = F.col("p_partkey") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("GBP "), whole, F.lit("."), part))
        .when(kind == 1, F.concat(whole, F.lit(","), part, F.lit(" EUR")))
        .when(kind == 2, F.concat(F.lit("0."), F.lpad(whole, 9, "0"), F.lit(","), part))
        .otherwise(F.concat(F.lit("-"), cents.cast("string")))
    )
    return table(spark, d, "part").select("p_partkey", text.alias("text")).withColumn("pence", P.parsed_pence(F.col("text")))


@query(
    "prj5_sale_price_outcome",
    """WITH {OFFERS} SELECT offer_id, CASE WHEN sale_price <= 0 THEN 'not_positive' WHEN sale_price >= price THEN 'not_lower' WHEN state = 'F' THEN 'ended'
        WHEN night > DATE '1998-06-01' THEN 'not_started' ELSE 'in_force' END AS outcome,
        CASE WHEN sale_price > 0 AND sale_price < price AND state <> 'F' AND night <= DATE '1998-06-01' THEN sale_price ELSE price END AS effective FROM offers""",
)
def sale_outcome(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("sale_price") <= 0, "not_positive").when(F.col("sale_price") >= F.col("price"), "not_lower").when(F.col("state") == "F", "ended").when(F.col("night") > F.to_date(F.lit("1998-06-01")), "not_started").otherwise("in_force")
    return offers(spark, d).select("offer_id", "sale_price", "price", outcome.alias("outcome")).select("offer_id", "outcome", F.when(F.col("outcome") == "in_force", F.col("sale_price")).otherwise(F.col("price")).alias("effective"))


@query("prj7_derived_ids", "SELECT page_id, 'derived_' || substr(sha256(lower(url) || '|' || coalesce(html, '')), 1, 16) AS derived_id FROM pages")
def derived_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.digest_id("derived_", F.lower("url"), F.coalesce("html", F.lit(""))).alias("derived_id"))


@query(
    "prj10_gtin_check",
    """WITH c AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 + 1000000 AS VARCHAR), 13, '0') AS code FROM orders),
    g AS (SELECT *, lpad(code, 14, '0') AS z FROM c)
    SELECT o_orderkey, code, (10 - (
        3 * CAST(z[1] AS INT) + CAST(z[2] AS INT) + 3 * CAST(z[3] AS INT) + CAST(z[4] AS INT) + 3 * CAST(z[5] AS INT) + CAST(z[6] AS INT) + 3 * CAST(z[7] AS INT)
        + CAST(z[8] AS INT) + 3 * CAST(z[9] AS INT) + CAST(z[10] AS INT) + 3 * CAST(z[11] AS INT) + CAST(z[12] AS INT) + 3 * CAST(z[13] AS INT)) % 10) % 10 = CAST(z[14] AS INT) AS valid FROM g""",
)
def gtin_check(spark: SparkSession, d: str) -> DataFrame:
    code = F.lpad((F.col("o_orderkey") * 7919 + 1_000_000).cast("string"), 13, "0")
    return table(spark, d, "orders").select("o_orderkey", code.alias("code")).withColumn("valid", T.gtin_valid(F.col("code")))


@query(
    "prj11_product_keys",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'gtin:' || lpad(CAST(p_partkey AS VARCHAR), 14, '0')
        WHEN p_partkey % 3 = 1 THEN 'mpn:' || lower(p_brand) || '|' || lower(p_type) ELSE 'own:' || CAST(p_partkey AS VARCHAR) END AS product_key FROM part""",
)
def product_keys(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 3
    return table(spark, d, "part").select("p_partkey", F.when(kind == 0, F.concat(F.lit("gtin:"), F.lpad(key, 14, "0"))).when(kind == 1, F.concat(F.lit("mpn:"), F.lower("p_brand"), F.lit("|"), F.lower("p_type"))).otherwise(F.concat(F.lit("own:"), key)).alias("product_key"))


@query(
    "prj15_canonical_urls",
    "SELECT page_id, regexp_replace(lower(regexp_extract(regexp_replace(url, '#.*$', ''), '^([^:/?]+://[^/?]*)', 1)) || substr(regexp_replace(url, '#.*$', ''), length(regexp_extract(regexp_replace(url, '#.*$', ''), '^([^:/?]+://[^/?]*)', 1)) + 1), '/+$', '') AS url_key FROM pages",
)
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url_key"))


@query(
    "prj23_visible_text",
    r"""SELECT page_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')), '\s+', ' ', 'g')) AS text FROM pages""",
)
def visible_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.visible(F.col("html")).alias("text"))


@query(
    "prj24_page_state",
    """SELECT page_id, CASE WHEN html IS NULL OR html = '' THEN 'missing' WHEN contains(lower(html), 'discontinued') THEN 'discontinued' WHEN contains(lower(html), '<form') THEN 'ambiguous'
        WHEN contains(html, '<article>') THEN 'readable' ELSE 'unknown' END AS state FROM pages""",
)
def page_state(spark: SparkSession, d: str) -> DataFrame:
    html, low = F.col("html"), F.lower("html")
    return table(spark, d, "pages").select("page_id", F.when(html.isNull() | (html == ""), "missing").when(low.contains("discontinued"), "discontinued").when(low.contains("<form"), "ambiguous").when(html.contains("<article>"), "readable").otherwise("unknown").alias("state"))


@query("prj27_shelves", "SELECT p_partkey, split_part(p_type, ' ', 1) AS department, coalesce(nullif(split_part(p_type, ' ', 2), ''), 'other') AS aisle, len(string_split(p_type, ' ')) AS depth FROM part")
def shelves(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("p_type", " ")
    return table(spark, d, "part").select("p_partkey", parts[0].alias("department"), F.coalesce(F.nullif(F.get(parts, F.lit(1)), F.lit("")), F.lit("other")).alias("aisle"), F.size(parts).cast("bigint").alias("depth"))


@query("prj31_slugs", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


@query("fn4_squeezed", r"SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS text FROM documents")
def squeezed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.squeezed(F.col("text")).alias("text"))


@query(
    "fn5_name_distances",
    """WITH n AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS word FROM benchmark)
    SELECT a.word AS a, b.word AS b, levenshtein(a.word, b.word) AS distance FROM n a JOIN n b ON a.word < b.word AND abs(length(a.word) - length(b.word)) <= 2 AND levenshtein(a.word, b.word) <= 2""",
)
def name_distances(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of benchmark words within two edits, with a bound, so that far pairs end early."""
    word = table(spark, d, "benchmark").select(F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")).alias("word")).distinct()
    return M.near_words(word, 2).withColumn("distance", F.levenshtein("a", "b", 2).cast("bigint")).where("distance >= 0").select("a", "b", "distance")


@query("fn8_skeletons", "SELECT p_partkey, regexp_replace(lower(p_name), '[^b-df-hj-np-tv-z]', '', 'g') AS consonants FROM part")
def skeletons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.regexp_replace(F.lower("p_name"), "[^b-df-hj-np-tv-z]", "").alias("consonants"))


@query(
    "fn10_deletion_neighbours",
    """WITH n AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part),
    x AS (SELECT word, word AS cut FROM n UNION SELECT word, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) FROM n, range(1, 40) t(i) WHERE i <= length(word))
    SELECT word, count(DISTINCT cut) AS n_cuts, min(cut) AS first_cut FROM x GROUP BY word""",
)
def deletion_neighbours(spark: SparkSession, d: str) -> DataFrame:
    word = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    return word.select("word", T.deletions(F.col("word")).alias("c")).select("word", F.size("c").cast("bigint").alias("n_cuts"), F.col("c")[0].alias("first_cut"))


@query(
    "fn14_other_number",
    """WITH n AS (SELECT DISTINCT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part)
    SELECT w AS word, CASE WHEN regexp_matches(w, '[^aeiou]ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(ss|sh|ch|x|z)es$') THEN regexp_replace(w, 'es$', '')
        WHEN regexp_matches(w, '[^su]s$') THEN regexp_replace(w, 's$', '') WHEN regexp_matches(w, '[^aeiou]y$') THEN regexp_replace(w, 'y$', 'ies')
        WHEN regexp_matches(w, '(s|sh|ch|x|z)$') THEN w || 'es' ELSE w || 's' END AS other FROM n""",
)
def other_number(spark: SparkSession, d: str) -> DataFrame:
    word = table(spark, d, "part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("word")).distinct()
    return word.withColumn("other", T.other_number(F.col("word")))


@query("fn25_hashes", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("fn27_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') AS age, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", day.alias("day"), F.datediff(F.to_date(F.lit("1998-08-02")), day).cast("bigint").alias("age"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))


@query(
    "flt1_gate_reasons",
    """WITH {OFFERS} SELECT offer_id, concat_ws(',', CASE WHEN quantity > 40 THEN 'bulk_only' END, CASE WHEN state <> 'O' THEN 'not_live' END, CASE WHEN price < 200000 THEN 'price_too_low' END, CASE WHEN flag = 'R' THEN 'returned' END) AS reasons,
        quantity <= 40 AND state = 'O' AND price >= 200000 AND flag <> 'R' AS eligible FROM offers""",
)
def gate(spark: SparkSession, d: str) -> DataFrame:
    return O.gated(offers(spark, d), 200_000, 40).select("offer_id", "reasons", "eligible")


@query(
    "flt1_gate_summary",
    """WITH {OFFERS}, r AS (SELECT unnest(list_filter([CASE WHEN quantity > 40 THEN 'bulk_only' END, CASE WHEN state <> 'O' THEN 'not_live' END, CASE WHEN price < 200000 THEN 'price_too_low' END, CASE WHEN flag = 'R' THEN 'returned' END], lambda x: x IS NOT NULL)) AS reason, shop FROM offers)
    SELECT reason, count(*) AS n, count(DISTINCT shop) AS n_shops FROM r GROUP BY reason""",
)
def gate_summary(spark: SparkSession, d: str) -> DataFrame:
    held = O.gated(offers(spark, d), 200_000, 40).where("NOT eligible").select(F.explode(F.split("reasons", ",")).alias("reason"), "shop")
    return held.groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("shop").alias("n_shops"))


@query(
    "flt2_availability_context",
    """SELECT 'flag' AS name, count(DISTINCT l_returnflag) AS n_values, count(DISTINCT l_returnflag) > 1 AS varies FROM lineitem
    UNION ALL SELECT 'state', count(DISTINCT l_linestatus), count(DISTINCT l_linestatus) > 1 FROM lineitem""",
)
def availability_context(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "lineitem").agg(F.count_distinct("l_returnflag").alias("flag"), F.count_distinct("l_linestatus").alias("state"))
    return one.unpivot([], ["flag", "state"], "name", "n_values").withColumn("varies", F.col("n_values") > 1)


@query(
    "flt10_first_occurrence",
    """WITH {OFFERS} SELECT offer_id, product, shop, row_number() OVER (PARTITION BY product, shop ORDER BY night, offer_id) > 1 AS duplicate FROM offers""",
)
def first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).select("offer_id", "product", "shop", (F.row_number().over(Window.partitionBy("product", "shop").orderBy("night", "offer_id")) > 1).alias("duplicate"))


@query(
    "flt16_weighted_scores",
    """SELECT s_suppkey, CAST(230 * least(n, 100) / 100 + 180 * least(parts, 50) / 50 + 170 * (s_acctbal > 0)::INT AS BIGINT) AS score FROM (
        SELECT s_suppkey, s_acctbal, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL) WHERE n >= 1""",
)
def weighted_scores(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"))
    score = F.least("n", F.lit(100)) * 230 / 100 + F.least("parts", F.lit(50)) * 180 / 50 + F.when(F.col("s_acctbal") > 0, 170).otherwise(0)
    return per.join(table(spark, d, "supplier"), "s_suppkey").select("s_suppkey", F.round(score).cast("bigint").alias("score"))


@query("flt25_clamped_range", "WITH {OFFERS}, e AS (SELECT product, min(price) AS low, max(price) AS high FROM offers GROUP BY product) SELECT offer_id, product, price FROM offers JOIN e USING (product) WHERE price BETWEEN least(greatest(low, 1000000), high) AND greatest(least(high, 3000000), low)")
def clamped_range(spark: SparkSession, d: str) -> DataFrame:
    """Offers between two prices that are moved into each product's own range, so that no product's answer is empty for them."""
    by = Window.partitionBy("product")
    low, high = F.min("price").over(by), F.max("price").over(by)
    ends = offers(spark, d).withColumns({"low": low, "high": high})
    return ends.where(F.col("price").between(F.least(F.greatest("low", F.lit(1_000_000)), F.col("high")), F.greatest(F.least("high", F.lit(3_000_000)), F.col("low")))).select("offer_id", "product", "price")


@query(
    "src5_two_feed_merge",
    """WITH {OFFERS}, a AS (SELECT * FROM offers WHERE flag = 'A'), b AS (SELECT * FROM offers WHERE flag = 'R')
    SELECT offer_id, product, shop, 'a' AS feed FROM a UNION ALL SELECT offer_id, product, shop, 'b' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.shop = b.shop AND a.product = b.product)""",
)
def two_feed_merge(spark: SparkSession, d: str) -> DataFrame:
    all_ = offers(spark, d)
    a, b = all_.where("flag = 'A'"), all_.where("flag = 'R'")
    more = b.join(a.select("shop", "product").distinct(), ["shop", "product"], "left_anti")
    return a.select("offer_id", "product", "shop", F.lit("a").alias("feed")).unionByName(more.select("offer_id", "product", "shop", F.lit("b").alias("feed")))


@query(
    "jn3_changed_rows",
    """WITH {OFFERS}, l AS (SELECT product, shop, night, price, lag(price) OVER (PARTITION BY product, shop ORDER BY night, offer_id) AS before, offer_id FROM offers)
    SELECT offer_id, product, shop, price, before FROM l WHERE before IS NULL OR before <> price""",
)
def changed_rows(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("price").over(Window.partitionBy("product", "shop").orderBy("night", "offer_id"))
    return offers(spark, d).withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("price"))).select("offer_id", "product", "shop", "price", "before")


@query("jn5_repriced_keys", "WITH {OFFERS} SELECT product, shop FROM offers GROUP BY product, shop HAVING count(DISTINCT price) > 1")
def repriced_keys(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).groupBy("product", "shop").agg(F.count_distinct("price").alias("n")).where("n > 1").select("product", "shop")


@query(
    "jn6_majority_value",
    """WITH {OFFERS}, c AS (SELECT product, flag, count(*) AS n FROM offers GROUP BY product, flag), m AS (SELECT product, arg_max(flag, (n, -ascii(flag))) AS flag FROM c GROUP BY product)
    SELECT offer_id, CASE WHEN state = 'O' THEN m.flag ELSE o.flag END AS flag FROM offers o JOIN m USING (product)""",
)
def majority_value(spark: SparkSession, d: str) -> DataFrame:
    """Open rows take the most frequent flag of their product (ties to the first letter)."""
    all_ = offers(spark, d)
    counts = all_.groupBy("product", "flag").agg(F.count("*").alias("n"))
    most = counts.groupBy("product").agg(F.min(F.struct((-F.col("n")).alias("n"), "flag"))["flag"].alias("common"))
    return all_.join(most, "product").select("offer_id", F.when(F.col("state") == "O", F.col("common")).otherwise(F.col("flag")).alias("flag"))


@query(
    "jn8_promotions_in_force",
    """SELECT l_orderkey, l_linenumber, max(o_orderkey) AS promotion FROM lineitem JOIN orders ON o_custkey % 100 = l_suppkey % 100 AND o_orderpriority = '1-URGENT'
        AND CAST(l_shipdate AS DATE) BETWEEN CAST(o_orderdate AS DATE) AND CAST(o_orderdate AS DATE) + 3 GROUP BY l_orderkey, l_linenumber""",
)
def promotions_in_force(spark: SparkSession, d: str) -> DataFrame:
    """The latest promotion (an urgent order, four days long) of a row's shop group that is in force on its night: the interval
    becomes its days, so the join is on equal days."""
    days = F.explode(F.sequence(F.col("o_orderdate").cast("date"), F.date_add(F.col("o_orderdate").cast("date"), 3)))
    promotions = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select((F.col("o_custkey") % 100).alias("shops"), days.alias("night"), F.col("o_orderkey").alias("promotion"))
    best = promotions.groupBy("shops", "night").agg(F.max("promotion").alias("promotion"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 100).alias("shops"), F.col("l_shipdate").cast("date").alias("night"))
    return rows.join(best, ["shops", "night"]).groupBy("l_orderkey", "l_linenumber").agg(F.max("promotion").alias("promotion"))


@query(
    "jn9_price_as_of",
    """WITH {OFFERS}, r AS (SELECT product, night, min(price) AS price FROM offers WHERE flag <> 'N' GROUP BY product, night), a AS (SELECT offer_id AS ask_id, product, night FROM offers WHERE flag = 'N')
    SELECT ask_id, a.product, a.night, r.price, r.night AS since FROM a ASOF LEFT JOIN r ON a.product = r.product AND a.night >= r.night""",
)
def price_as_of(spark: SparkSession, d: str) -> DataFrame:
    all_ = offers(spark, d)
    records = all_.where("flag <> 'N'").groupBy("product", "night").agg(F.min("price").alias("price"))
    return O.as_of(all_.where("flag = 'N'").select(F.col("offer_id").alias("ask_id"), "product", "night"), records, ["product"])


@query(
    "jn13_words_of_queries",
    """WITH i AS (SELECT DISTINCT p_partkey AS row_id, unnest(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: x <> '')) AS word FROM part),
    q AS (SELECT DISTINCT p_size AS query_id, unnest(list_filter(regexp_split_to_array(lower(min(p_type) || ' ' || min(p_name)), '[^a-z0-9]+'), lambda x: x <> '')[1:2]) AS word FROM part GROUP BY p_size),
    n AS (SELECT query_id, count(*) AS needed FROM q GROUP BY query_id)
    SELECT query_id, row_id FROM q JOIN i USING (word) JOIN n USING (query_id) GROUP BY query_id, row_id, needed HAVING count(*) = needed""",
)
def words_of_queries(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    index = M.postings(part, "p_partkey", T.words(F.concat_ws(" ", "p_name", "p_type")))
    asked = part.groupBy(F.col("p_size").alias("query_id")).agg(F.slice(T.words(F.concat_ws(" ", F.min("p_type"), F.min("p_name"))), 1, 2).alias("words"))
    return M.carrying_all(index, asked)


@query(
    "jn16_events_and_customers",
    """SELECT coalesce(e.user_id, c.c_custkey) AS user_id, coalesce(n, 0) AS n_events, c_mktsegment AS segment, CASE WHEN e.user_id IS NULL THEN 'silent' WHEN c.c_custkey IS NULL THEN 'unknown' ELSE 'known' END AS status
    FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) e FULL JOIN customer c ON e.user_id = c.c_custkey""",
)
def events_and_customers(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    both = seen.join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey"), "full")
    status = F.when(F.col("user_id").isNull(), "silent").when(F.col("c_custkey").isNull(), "unknown").otherwise("known")
    return both.select(F.coalesce("user_id", "c_custkey").alias("user_id"), F.coalesce("n", F.lit(0)).alias("n_events"), F.col("c_mktsegment").alias("segment"), status.alias("status"))


@query(
    "jn20_period_changes",
    """WITH {OFFERS}, b AS (SELECT shop, count(*) AS n FROM offers WHERE night < DATE '1995-06-17' GROUP BY shop), a AS (SELECT shop, count(*) AS n FROM offers WHERE night >= DATE '1995-06-17' GROUP BY shop)
    SELECT shop, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, CASE WHEN b.n IS NULL THEN 'new' WHEN a.n IS NULL THEN 'gone' WHEN 2 * a.n < b.n THEN 'shrunk' ELSE 'held' END AS status FROM b FULL JOIN a USING (shop)""",
)
def period_changes(spark: SparkSession, d: str) -> DataFrame:
    all_, at = offers(spark, d), F.to_date(F.lit("1995-06-17"))
    count = lambda rows: rows.groupBy("shop").agg(F.count("*").alias("n"))
    return M.changes(count(all_.where(F.col("night") < at)), count(all_.where(F.col("night") >= at)), "shop")


@query(
    "jn22_dangling_edges",
    """SELECT 'order' AS edge, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'shop', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)""",
)
def dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    checks = [("order", "orders", "o_custkey", "customer", "c_custkey"), ("part", "lineitem", "l_partkey", "part", "p_partkey"), ("shop", "lineitem", "l_suppkey", "supplier", "s_suppkey")]
    out = None
    for name, rows, key, nodes, node in checks:
        lost = table(spark, d, rows).join(table(spark, d, nodes), F.col(key) == F.col(node), "left_anti").agg(F.lit(name).alias("edge"), F.count("*").alias("n"))
        out = lost if out is None else out.unionByName(lost)
    return out


@query(
    "jn25_similar_titles",
    """WITH s AS (SELECT p_partkey AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type || ' ' || p_brand), '[^a-z0-9]+'), lambda x: x <> ''))) AS w FROM part),
    c AS (SELECT min(id) AS id, w, count(*) AS n FROM s GROUP BY w)
    SELECT a.id AS a, b.id AS b, CAST(len(list_intersect(a.w, b.w)) AS BIGINT) AS shared, CAST(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS BIGINT) AS together, a.n AS n_a, b.n AS n_b
    FROM c a JOIN c b ON a.id < b.id WHERE 100 * len(list_intersect(a.w, b.w)) >= 80 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))""",
)
def similar_titles(spark: SparkSession, d: str) -> DataFrame:
    return M.similar_sets(M.postings(table(spark, d, "part"), "p_partkey", T.words(F.concat_ws(" ", "p_name", "p_type", "p_brand"))), 80)


@query(
    "jn25_title_classes",
    """WITH s AS (SELECT p_partkey AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type || ' ' || p_brand), '[^a-z0-9]+'), lambda x: x <> ''))) AS w FROM part)
    SELECT id AS p_partkey, min(id) OVER (PARTITION BY w) AS class_id FROM s""",
)
def title_classes(spark: SparkSession, d: str) -> DataFrame:
    """Which products share their whole set of title words: the members of jn25's classes."""
    sets = M.word_sets(M.postings(table(spark, d, "part"), "p_partkey", T.words(F.concat_ws(" ", "p_name", "p_type", "p_brand"))))
    least = sets.groupBy("words").agg(F.min("row_id").alias("class_id"))
    return sets.join(least, "words").select(F.col("row_id").alias("p_partkey"), "class_id")


@query(
    "agg1_balance",
    """WITH {OFFERS}, x AS (SELECT 'flag' AS dimension, flag AS value FROM offers UNION ALL SELECT 'state', state FROM offers UNION ALL SELECT 'shop', CAST(shop AS VARCHAR) FROM offers), n AS (SELECT dimension, value, count(*) AS n FROM x GROUP BY ALL)
    SELECT dimension, value, n, CAST(n * 10000 // sum(n) OVER (PARTITION BY dimension) AS BIGINT) AS share FROM n""",
)
def balance(spark: SparkSession, d: str) -> DataFrame:
    return O.shares(offers(spark, d), {"flag": "flag", "state": "state", "shop": "shop"})


@query(
    "agg3_cap_size",
    """WITH g AS (SELECT l_suppkey AS name, count(*) AS n FROM lineitem GROUP BY l_suppkey), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS k, sum(n) OVER () - sum(n) OVER (ORDER BY n DESC, name) AS rest, lead(n, 1, 0) OVER (ORDER BY n DESC, name) AS nx FROM g),
    c AS (SELECT k, 2 * rest / (100 - 2 * k) AS cap, nx, n FROM o WHERE 2 * k < 100)
    SELECT CAST(CASE WHEN (SELECT max(n) * 100 <= sum(n) * 2 FROM g) THEN (SELECT max(n) FROM g) ELSE (SELECT nullif(floor(arg_min(cap, k)), 0) FROM c WHERE nx <= cap AND cap <= n) END AS BIGINT) AS cap""",
)
def cap_size(spark: SparkSession, d: str) -> DataFrame:
    """The cap at which no shop has over two of a hundred kept offers."""
    return O.cap_size(table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("name")).agg(F.count("*").alias("n")), 2)


@query("agg5_sellers", "WITH {OFFERS}, s AS (SELECT product, count(DISTINCT shop) AS n_shops FROM offers GROUP BY product) SELECT n_shops, count(*) AS n_products FROM s GROUP BY n_shops")
def sellers(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).groupBy("product").agg(F.count_distinct("shop").alias("n_shops")).groupBy("n_shops").agg(F.count("*").alias("n_products"))


@query(
    "agg7_shop_rollup",
    """WITH {OFFERS}, s AS (SELECT product, count(DISTINCT shop) > 1 AS elsewhere FROM offers GROUP BY product)
    SELECT shop, count(DISTINCT product) AS n_products, count(DISTINCT product) FILTER (elsewhere) AS n_elsewhere, CAST(sum(price) AS BIGINT) AS total FROM offers JOIN s USING (product) GROUP BY shop""",
)
def shop_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Of each shop its products, those that others sell too, and the sum of its prices. One row a shop and product first, made where all of a product is, in stated numbers of tasks."""
    rows = offers(spark, d).where("product IS NOT NULL").select("product", "shop", "price")
    held = rows.repartition(16 * spark.sparkContext.defaultParallelism, "product").groupBy("product", "shop").agg(F.sum("price").alias("total"))
    held = held.withColumn("n", F.count("shop").over(Window.partitionBy("product")))
    return held.groupBy("shop").agg(F.count("*").alias("n_products"), F.count_if(F.col("n") > 1).alias("n_elsewhere"), F.sum("total").alias("total"))


@query(
    "agg9_intake_rollup",
    """WITH {OFFERS} SELECT coalesce(CAST(shop AS VARCHAR), 'all') AS shop, count(*) AS n, count(*) FILTER (state = 'O') AS live, count(*) FILTER (flag = 'R') AS returned, min(night) AS first_night, max(night) AS last_night FROM offers GROUP BY ROLLUP (shop)""",
)
def intake_rollup(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).rollup("shop").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "O").alias("live"), F.count_if(F.col("flag") == "R").alias("returned"), F.min("night").alias("first_night"), F.max("night").alias("last_night")).withColumn("shop", F.coalesce(F.col("shop").cast("string"), F.lit("all")))


@query("agg11_top_values", "SELECT p_brand AS brand, p_type AS value, n, place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS place FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)) WHERE place <= 5")
def top_values(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("value")).agg(F.count("*").alias("n"))
    return O.top_k(counts, "brand", 5, F.desc("n"), F.col("value"))


@query("agg13_price_summary", "WITH {OFFERS} SELECT p_brand AS brand, min(price) AS low, max(price) AS high, CAST(sum(price) AS BIGINT) AS total, count(*) AS n FROM offers JOIN part ON p_partkey = product GROUP BY p_brand")
def price_summary(spark: SparkSession, d: str) -> DataFrame:
    joined = offers(spark, d).join(table(spark, d, "part"), F.col("product") == F.col("p_partkey"))
    return joined.groupBy(F.col("p_brand").alias("brand")).agg(F.min("price").alias("low"), F.max("price").alias("high"), F.sum("price").alias("total"), F.count("*").alias("n"))


@query(
    "agg14_price_histogram",
    """WITH {OFFERS}, e AS (SELECT min(price) AS low, max(price) AS high FROM offers)
    SELECT CAST(least(floor(ln(price / low) / ln(high / low) * 24), 23) AS BIGINT) AS bin, count(*) AS n, min(price) AS least, max(price) AS most FROM offers, e GROUP BY 1""",
)
def price_histogram(spark: SparkSession, d: str) -> DataFrame:
    return O.log_histogram(offers(spark, d), "price", 24)


@query(
    "agg15_price_outliers",
    """WITH {OFFERS}, p AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY product) - 1 AS last FROM offers WINDOW w AS (PARTITION BY product ORDER BY price, offer_id)),
    q AS (SELECT product, max(price) FILTER (i = last // 4) AS q1, max(price) FILTER (i = last * 2 // 4) AS q2, max(price) FILTER (i = last * 3 // 4) AS q3 FROM p GROUP BY product)
    SELECT offer_id, product, price, q2 AS middle_price FROM offers JOIN q USING (product) WHERE (2 * price < 2 * q1 - 3 * (q3 - q1) OR 2 * price > 2 * q3 + 3 * (q3 - q1)) AND (price >= 2 * q2 OR 2 * price <= q2)""",
)
def price_outliers(spark: SparkSession, d: str) -> DataFrame:
    return O.fenced(offers(spark, d), "product")


@query("agg16_price_bands", "WITH {OFFERS} SELECT CASE WHEN price < 1000000 THEN 'low' WHEN price < 4000000 THEN 'middle' ELSE 'high' END AS band, count(*) AS n FROM offers GROUP BY 1")
def price_bands(spark: SparkSession, d: str) -> DataFrame:
    return offers(spark, d).groupBy(F.when(F.col("price") < 1_000_000, "low").when(F.col("price") < 4_000_000, "middle").otherwise("high").alias("band")).agg(F.count("*").alias("n"))


@query(
    "agg34_presence_masks",
    """WITH {OFFERS}, m AS (SELECT shop, bit_or(1::BIGINT << (date_diff('day', DATE '1970-01-01', night) // 30 % 60)) AS mask FROM offers GROUP BY shop) SELECT shop, mask, CAST(bit_count(mask) AS BIGINT) AS months FROM m""",
)
def presence_masks(spark: SparkSession, d: str) -> DataFrame:
    """The months in which a shop was seen, as bits."""
    bit = F.floor(F.datediff("night", F.to_date(F.lit("1970-01-01"))) / 30) % 60
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int"))
    return offers(spark, d).groupBy("shop").agg(F.bit_or(mask).alias("mask")).withColumn("months", F.bit_count("mask").cast("bigint"))


@query(
    "agg35_lattice_supports",
    """WITH {OFFERS}, m AS (SELECT CAST((flag = 'N')::INT + 2 * (state = 'O')::INT + 4 * (price > 2000000)::INT + 8 * (quantity > 25)::INT AS BIGINT) AS mask FROM offers)
    SELECT s AS subset, count(*) AS support FROM m, range(1, 16) t(s) WHERE mask & s = s GROUP BY s""",
)
def lattice_supports(spark: SparkSession, d: str) -> DataFrame:
    bit = lambda c, n: F.when(c, n).otherwise(0)
    mask = bit(F.col("flag") == "N", 1) + bit(F.col("state") == "O", 2) + bit(F.col("price") > 2_000_000, 4) + bit(F.col("quantity") > 25, 8)
    return M.supports(offers(spark, d).select(mask.alias("mask")), "mask", 4).select(F.col("subset").cast("bigint").alias("subset"), "support")


@query(
    "agg46_apportioned_pages",
    """WITH g AS (SELECT p_brand AS name, count(*) AS n FROM part GROUP BY p_brand), e AS (SELECT *, n * 1000 // sum(n) OVER () AS whole, n * 1000 % sum(n) OVER () AS rest FROM g),
    r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, name) AS rn, 1000 - sum(whole) OVER () AS more FROM e) SELECT name, n, CAST(whole + (rn <= more)::INT AS BIGINT) AS seats FROM r""",
)
def apportioned_pages(spark: SparkSession, d: str) -> DataFrame:
    return O.apportioned(table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n")), 1000)


@query(
    "agg50_hashed_sample",
    """WITH {OFFERS} SELECT shop, offer_id, place FROM (SELECT shop, offer_id, row_number() OVER (PARTITION BY shop ORDER BY sha256(offer_id), offer_id) AS place FROM offers) WHERE place <= 3""",
)
def hashed_sample(spark: SparkSession, d: str) -> DataFrame:
    return O.top_k(offers(spark, d).select("shop", "offer_id", F.sha2("offer_id", 256).alias("h")), "shop", 3, F.col("h"), F.col("offer_id")).select("shop", "offer_id", "place")


@query("win1_price_ranks", "WITH {OFFERS}, r AS (SELECT offer_id, product, price, rank() OVER (PARTITION BY product ORDER BY price) AS rank, count(*) OVER (PARTITION BY product) AS n, min(price) OVER (PARTITION BY product) AS low, max(price) OVER (PARTITION BY product) AS high FROM offers) SELECT offer_id, product, price, rank, CASE WHEN n = 1 THEN 'only' WHEN price = low THEN 'lowest' WHEN price = high THEN 'highest' ELSE rank || 'th' END AS role FROM r")
def price_ranks(spark: SparkSession, d: str) -> DataFrame:
    return O.competition_ranks(offers(spark, d).select("offer_id", "product", "price"), "product")


WIN5 = """j AS (SELECT *, row_number() OVER w AS rn, coalesce(price >= 2 * lag(price) OVER w, false) AS jump FROM offers WINDOW w AS (PARTITION BY product ORDER BY price, offer_id)),
    c AS (SELECT product, max(rn) FILTER (NOT jump) AS counted FROM j GROUP BY product), mid AS (SELECT product, offer_id, price AS middle_price, counted FROM j JOIN c USING (product) WHERE rn = (counted - 1) // 2 + 1)"""


@query("win5_trimmed_middle", "WITH {OFFERS}, " + WIN5 + " SELECT * FROM mid")
def trimmed_middle(spark: SparkSession, d: str) -> DataFrame:
    return O.trimmed_middle(offers(spark, d), "product")


@query(
    "win6_recommended",
    "WITH {OFFERS}, " + WIN5 + """, x AS (SELECT o.product, o.offer_id, o.price, abs(o.price - middle_price) AS far, min(o.price) OVER (PARTITION BY o.product) AS low, max(o.price) OVER (PARTITION BY o.product) AS high FROM offers o JOIN mid ON mid.product = o.product),
    y AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY far, price, offer_id) AS place FROM x WHERE price > low AND price < high) SELECT product, offer_id, price, far FROM y WHERE place = 1""",
)
def recommended(spark: SparkSession, d: str) -> DataFrame:
    all_ = offers(spark, d)
    return O.recommended(all_, O.trimmed_middle(all_, "product"), "product")


@query(
    "win7_even_spread",
    "WITH {OFFERS}, p AS (SELECT product, offer_id, price, row_number() OVER (PARTITION BY product ORDER BY price, offer_id) - 1 AS i, count(*) OVER (PARTITION BY product) AS n FROM offers) SELECT product, offer_id, price, i AS place FROM p WHERE list_contains([(2 * k + 1) * n // 8 FOR k IN [0, 1, 2, 3]], i)",
)
def even_spread(spark: SparkSession, d: str) -> DataFrame:
    return O.evenly_spaced(offers(spark, d), "product", 4)


@query(
    "win10_price_runs",
    """WITH {OFFERS}, s AS (SELECT shop % 10 AS shops, night, min(price) // 100000 AS price FROM offers GROUP BY ALL),
    b AS (SELECT *, CASE WHEN night - lag(night) OVER w = 1 AND price = lag(price) OVER w THEN 0 ELSE 1 END AS brk FROM s WINDOW w AS (PARTITION BY shops ORDER BY night)), r AS (SELECT *, sum(brk) OVER (PARTITION BY shops ORDER BY night) AS run FROM b)
    SELECT shops, CAST(run AS BIGINT) AS run, min(night) AS first_night, max(night) AS last_night, count(*) AS nights, min(price) AS price FROM r GROUP BY shops, run""",
)
def price_runs(spark: SparkSession, d: str) -> DataFrame:
    sightings = offers(spark, d).groupBy((F.col("shop") % 10).alias("shops"), "night").agg(F.floor(F.min("price") / 100_000).cast("bigint").alias("price"))
    return O.runs(sightings, ["shops"])


@query(
    "win14_normalised_prices",
    "WITH {OFFERS}, e AS (SELECT product, min(price) AS low, max(price) AS high FROM offers GROUP BY product) SELECT offer_id, CASE WHEN high > low THEN (price - low) * 1000 // (high - low) ELSE 0 END AS level FROM offers JOIN e USING (product)",
)
def normalised_prices(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("product")
    ends = offers(spark, d).withColumns({"low": F.min("price").over(by), "high": F.max("price").over(by)})
    return ends.select("offer_id", F.when(F.col("high") > F.col("low"), F.floor((F.col("price") - F.col("low")) * 1000 / (F.col("high") - F.col("low")))).otherwise(0).cast("bigint").alias("level"))


@query("win15_winner_margins", "WITH {OFFERS}, r AS (SELECT product, price, row_number() OVER (PARTITION BY product ORDER BY price, offer_id) AS k FROM offers) SELECT product, min(price) FILTER (k = 2) - min(price) FILTER (k = 1) AS margin FROM r GROUP BY product HAVING count(*) > 1")
def winner_margins(spark: SparkSession, d: str) -> DataFrame:
    two = O.top_k(offers(spark, d), "product", 2, F.col("price"), F.col("offer_id"))
    return two.groupBy("product").agg((F.max("price") - F.min("price")).alias("margin"), F.count("*").alias("n")).where("n > 1").select("product", "margin")


@query("srt4_pages", "WITH {OFFERS} SELECT offer_id, (row_number() OVER (PARTITION BY shop ORDER BY price, offer_id) - 1) // 12 AS page FROM offers")
def pages_of_offers(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("shop").orderBy("price", "offer_id"))
    return offers(spark, d).select("offer_id", F.floor((place - 1) / 12).cast("bigint").alias("page"))


@query("set2_common_products", "SELECT l_partkey AS product FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def common_products(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("product"), "l_returnflag")
    return rows.where("l_returnflag = 'A'").select("product").intersect(rows.where("l_returnflag = 'N'").select("product"))


@query("set3_all_ids", "SELECT o_custkey AS id FROM orders UNION SELECT user_id FROM events")
def all_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("id")).union(table(spark, d, "events").select("user_id")).distinct()


@query("set6_missing_products", "SELECT p_partkey AS product FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def missing_products(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("product")).subtract(table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select("l_partkey"))


@query(
    "str2_key_state",
    """WITH {OFFERS} SELECT product, shop, min(night) AS first_seen, max(night) AS last_seen, count(DISTINCT night) AS nights_seen, arg_max(price, (night, offer_id)) AS price FROM offers GROUP BY product, shop""",
)
def key_state(spark: SparkSession, d: str) -> DataFrame:
    last = F.max(F.struct("night", "offer_id", "price"))["price"]
    return offers(spark, d).groupBy("product", "shop").agg(F.min("night").alias("first_seen"), F.max("night").alias("last_seen"), F.count_distinct("night").alias("nights_seen"), last.alias("price"))


@query("agg30_event_counts", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY ALL")
def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query(
    "agg28_event_pivot",
    """SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'purchase') AS purchase, count(*) AS n FROM events GROUP BY user_id""",
)
def event_pivot(spark: SparkSession, d: str) -> DataFrame:
    kinds = {k: F.count_if(F.col("event_type") == k).alias(k) for k in ("click", "view", "purchase")}
    return table(spark, d, "events").groupBy("user_id").agg(*kinds.values(), F.count("*").alias("n"))


@query(
    "agg24_evaluation_report",
    """SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality = 1 AND n_chars >= 500) AS long_good FROM documents JOIN labels USING (doc_id) GROUP BY source""",
)
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return joined.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if((F.col("quality") == 1) & (F.col("n_chars") >= 500)).alias("long_good"))
