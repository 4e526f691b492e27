"""What kinds of a kind there are, mined from the words that titles put before its noun."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.session import shared_folder

#: Products of a kind that is read, of a choice and of a word that counts; kinds before which a word says nothing; shops of a choice;
#: nouns of a pair that is one modifier; the share of a word's titles that makes it half of a phrase; the share of a kind that narrows nothing; choices kept, and needed.
MIN_PRODUCTS, MIN_GROUP, MIN_WORD, GENERIC_KINDS = 50, 20, 3, 8
PAIR_NOUNS, HALF_PERCENT, KEEPS_PERCENT, KEPT, MIN_CHOICES = 2, 75, 90, 12, 2


def kind_choices(named: DataFrame, *, min_products: int = MIN_PRODUCTS, min_group: int = MIN_GROUP, min_word: int = MIN_WORD, generic_kinds: int = GENERIC_KINDS, kept: int = KEPT) -> DataFrame:
    """kind, choice, n (its products), of_kind (the kind's) and place, from named(kind, shop, word, before): a row for each product and kind; word stands
    before the kind's noun, before before that; either may be null.

    A choice is a word, or a phrase of two where the word is half of it: most of its titles put a number before it, or a word that makes one modifier with it
    before other nouns too and doesn't name the kind itself. A word before many kinds' nouns is no choice; nor is one shop's own word, nor what keeps
    nearly the whole kind. A kind has its largest choices, ties by name, if it has two.

    Every step is a sum by kind and words, added up before the shuffle; two shops are told by the least and the greatest. Nulls are no shop, and rows without a kind count nowhere.
    The rows are read once: their sums are checkpointed where all executors see them, and all else follows from those.
    """
    shared_folder(named.sparkSession)
    rows = named.where("kind IS NOT NULL").select("kind", "shop", "word", "before")
    summed = rows.groupBy("kind", "before", "word").agg(F.count("*").alias("n"), F.min("shop").alias("low"), F.max("shop").alias("high")).checkpoint()
    kinds = summed.groupBy("kind").agg(F.sum("n").alias("of_kind")).where(F.col("of_kind") >= min_products)
    triples = summed.where("word IS NOT NULL").join(kinds.select("kind"), "kind")
    words = triples.groupBy("kind", "word").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    spread = words.groupBy("word").agg(F.count_if(F.col("n") >= min_word).alias("n_kinds"), (F.min("low") != F.max("high")).alias("shared")).where(F.col("n_kinds") < generic_kinds).select("word", "shared")
    modifiers = triples.where(F.col("before").isNotNull() & (F.col("n") >= min_word)).groupBy("before", "word").agg(F.count("*").alias("nouns")).where(F.col("nouns") >= PAIR_NOUNS).select("before", "word", F.lit(True).alias("one"))
    names = words.where(F.col("n") >= min_word).select("kind", F.col("word").alias("before"), F.lit(True).alias("names"))
    phrases = triples.where("before IS NOT NULL").join(modifiers, ["before", "word"], "left").join(names, ["kind", "before"], "left")
    phrases = phrases.where((F.col("one") | F.col("before").rlike("^[0-9]+$")) & F.col("names").isNull())
    whole = phrases.groupBy("kind", "word").agg(F.sum("n").alias("within"))
    read = words.join(spread, "word").join(whole, ["kind", "word"], "left").withColumn("half", F.coalesce(F.col("within") * 100 >= F.col("n") * HALF_PERCENT, F.lit(False)))
    single = read.where("NOT half").select("kind", F.col("word").alias("choice"), "n", "low", "high", "shared")
    double = phrases.join(read.where("half").select("kind", "word", "shared"), ["kind", "word"]).select("kind", F.concat_ws(" ", "before", "word").alias("choice"), "n", "low", "high", "shared")
    fits = (F.col("n") >= min_group) & (F.coalesce(F.col("low") != F.col("high"), F.lit(False)) | F.coalesce("shared", F.lit(False))) & (F.col("n") * 100 < F.col("of_kind") * KEEPS_PERCENT)
    choices = single.unionByName(double).join(kinds, "kind").where(fits)
    placed = choices.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "choice"))).where(F.col("place") <= kept)
    general = choices.groupBy("kind").agg(F.count("*").alias("choices")).where(F.col("choices") >= MIN_CHOICES).select("kind")
    return placed.join(general, "kind").select("kind", "choice", "n", "of_kind", F.col("place").cast("bigint").alias("place"))
