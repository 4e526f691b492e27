"""Column expressions on prices: text in either decimal convention becomes whole pence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pence(amount: Column) -> Column:
    """Whole pence of an amount that has two decimals."""
    return F.round(amount * 100).cast("bigint")


def parsed_pence(text: Column) -> Column:
    """Pence of a price text; null if there is none above zero.

    Of points and commas, the last one is the decimal mark if the other kind stands before it, or if it is the only one and
    one or two digits follow; otherwise they group thousands.
    """
    number = F.regexp_replace(text, "[^0-9.,-]", "")
    point, comma = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))), F.length(number) - F.length(F.replace(number, F.lit(","), F.lit("")))
    last = F.regexp_extract(number, r"([.,])[0-9]*$", 1)
    tail = F.length(F.regexp_extract(number, r"[.,]([0-9]*)$", 1))
    decimal = (last != "") & ((point > 0) & (comma > 0) | (point + comma == 1) & tail.between(1, 2))
    whole = F.regexp_replace(F.when(decimal, F.regexp_replace(number, "[.,][0-9]*$", "")).otherwise(number), "[.,]", "")
    part = F.rpad(F.when(decimal, F.substring(F.regexp_extract(number, "[.,]([0-9]*)$", 1), 1, 2)).otherwise(F.lit("")), 2, "0")
    value = F.concat(whole, part).try_cast("bigint")
    return F.when(number.startswith("-") | (value <= 0), None).otherwise(value)


def sale_pence(usual: Column, discount: Column) -> Column:
    """Usual pence less a discount in hundredths, rounded down."""
    return F.floor(usual * (100 - F.round(discount * 100).cast("bigint")) / 100).cast("bigint")


def amount_and_code(text: Column) -> Column:
    """amount and code of a price text of two words, of which one is a currency's code: three letters, all capital. Any other text is an amount as it stands, with an empty code."""
    words = F.split(text, r"\s+")
    is_code = lambda w: (F.length(w) == 3) & (F.regexp_count(w, F.lit("[A-Z]")) == 3)
    place = F.when(F.size(words) != 2, 0).when(is_code(F.get(words, F.lit(0))), 1).when(is_code(F.get(words, F.lit(1))), 2).otherwise(0)
    amount = F.when(place == 0, text).otherwise(F.get(words, 2 - place))
    code = F.when(place == 0, "").otherwise(F.get(words, place - 1))
    # A space at an end makes an empty word, which is no amount.
    return F.when(amount == "", F.struct(text.alias("amount"), F.lit("").alias("code"))).otherwise(F.struct(amount.alias("amount"), code.alias("code")))
