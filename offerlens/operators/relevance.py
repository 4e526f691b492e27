"""Relevance of offers to queries: candidates by the rarest letters a query needs, then points by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.session import spread

#: Points of a word in each field, and what is added or taken.
FIELDS = {"title": 100, "product_type": 55, "category": 40, "brand": 35, "keywords": 20, "description": 5}
PHRASE, ALL_IN_TITLE, ANY_CATEGORY, NOUN_IN_TITLE, COMPLETE, NO_ACCESSORY, ACCESSORY, TYPE = 150, 80, 20, 60, 25, 40, 220, 130
#: Letters of the pieces by which words are found within fields.
PIECE = 3


def _pieces(text: Column, n: Column | int) -> Column:
    """All runs of n letters of a text; none if it is shorter. The text should be a column as it is: its expression is worked out for each run."""
    last = F.length(text) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(n) if isinstance(n, int) else n))).otherwise(F.array().cast("array<string>"))


def candidates(asked: DataFrame, offers: DataFrame) -> DataFrame:
    """query_id and offer_id of all offers in one of whose fields a piece of the query stands that every answer must hold: of the pieces of its required words the rarest.

    A piece is as long as PIECE letters, or the word if that is shorter. Only pieces that some query asks are indexed (the driver sees which lengths those
    have); a query has one of them, so it meets as many rows as its rarest piece.
    """
    wanted = asked.select("query_id", F.explode(F.flatten(F.transform("required", lambda w: _pieces(w, F.least(F.lit(PIECE), F.length(w)))))).alias("piece")).distinct()
    vocabulary = wanted.select("piece").distinct()
    lengths = sorted(r[0] for r in vocabulary.select(F.length("piece")).distinct().collect() if r[0]) or [PIECE]
    texts = F.transform(F.array(*FIELDS), lambda t: F.lower(F.coalesce(t, F.lit(""))))
    own = F.array_distinct(F.flatten(F.transform(texts, lambda t: F.concat(*[_pieces(t, n) for n in lengths]))))
    index = spread(offers.select("offer_id", *FIELDS)).select("offer_id", F.explode(own).alias("piece")).join(vocabulary, "piece", "left_semi")
    counted = index.groupBy("piece").agg(F.count("*").alias("n"))
    # A piece that no offer holds has no row: its query has no answer then.
    rarest = wanted.join(counted, "piece", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece"))["piece"].alias("piece"))
    return index.join(rarest, "piece").select("query_id", "offer_id")


def scored(asked: DataFrame, offers: DataFrame, accessories: list[str] | None = None) -> DataFrame:
    """Every offer that answers a query, with matched (words), score and title_matches.

    asked(query_id, required, words, phrase, types, accessory): all required words must stand in some field, words only add points, phrase is the query as it
    is; types (may be null or empty) are the product types it means: others are no answer; accessory: whether it seeks one. offers(offer_id, the fields,
    complete): texts that may be null. Words and phrases are lower case.
    """
    f = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in FIELDS}
    # Answers are more than the bytes that they are read from tell: so many tasks as are stated, with an offer's fields in lower case once.
    tasks = 16 * offers.sparkSession.sparkContext.defaultParallelism
    texts = offers.select("offer_id", "complete", *[c.alias(n) for n, c in f.items()]).repartition(tasks, "offer_id")
    fielded = candidates(asked, offers).repartition(tasks, "offer_id").join(texts, "offer_id").join(asked, "query_id")
    has = lambda w, c: F.contains(F.col(c), w)
    anywhere = lambda w: F.greatest(*[has(w, c).cast("int") for c in FIELDS]) == 1
    points = lambda w: sum((has(w, c).cast("int") * n for c, n in FIELDS.items()), F.lit(0))
    total = lambda body: F.aggregate(F.transform("words", body), F.lit(0), lambda a, b: a + b)
    in_title, in_category = total(lambda w: has(w, "title").cast("int")), total(lambda w: has(w, "product_type").cast("int") + has(w, "category").cast("int"))
    rows = fielded.where(F.forall("required", anywhere)).withColumns({"matched": total(lambda w: anywhere(w).cast("int")), "points": total(points), "title_matches": in_title, "category_matches": in_category})
    padded = F.concat(F.lit(" "), F.regexp_replace("title", r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
    word_in_title = lambda w: F.contains(padded, F.concat(F.lit(" "), w, F.lit(" ")))
    terms = F.array(*[F.lit(a) for a in accessories or []]).cast("array<string>")
    penalty = F.when(F.col("accessory"), 0).otherwise(ACCESSORY * F.size(F.filter(terms, word_in_title)))
    meant = F.coalesce(F.size("types") > 0, F.lit(False))
    of_type = meant & F.coalesce(F.array_contains("types", F.col("product_type")), F.lit(False))
    some = F.size("required") > 0
    score = (
        F.col("points")
        + F.when((F.coalesce("phrase", F.lit("")) != "") & F.contains("title", F.col("phrase")), PHRASE).otherwise(0)
        + F.when(some & (F.col("title_matches") >= F.size("required")), ALL_IN_TITLE).otherwise(0)
        + F.when(F.col("category_matches") > 0, ANY_CATEGORY).otherwise(0)
        + F.when(some & word_in_title(F.element_at("required", -1)), NOUN_IN_TITLE).otherwise(0)
        + F.when(of_type, TYPE).otherwise(0)
        - penalty
        + F.when((penalty == 0) & ~F.col("accessory"), NO_ACCESSORY).otherwise(0)
        + F.when(F.col("complete"), COMPLETE).otherwise(0)
    )
    kept = rows.where(~meant | (F.col("product_type") == "") | of_type)
    return kept.select("query_id", "offer_id", F.col("matched").cast("bigint").alias("matched"), score.cast("bigint").alias("score"), F.col("title_matches").cast("bigint").alias("title_matches"), "title")


def best_answers(asked: DataFrame, offers: DataFrame, k: int, accessories: list[str] | None = None) -> DataFrame:
    """The k best answers of each query: by words matched, score, words in the title, then title and id; place from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("matched"), F.desc("score"), F.desc("title_matches"), "title", "offer_id")
    placed = scored(asked, offers, accessories).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return placed.withColumn("place", F.col("place").cast("bigint")).select("query_id", "place", "offer_id", "matched", "score", "title_matches")
