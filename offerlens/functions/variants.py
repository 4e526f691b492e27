"""Titles as a product's own words and the words that may name a variant, and the keys that follow from them.

A word is a *size* (a letter or named size, an amount with its unit, what comes with sizes, and the number after such a word), an
*other* variant word (a colour, a bare number), or one of the product's own. All of it stays in the JVM; the word before is looked
up in the bound array, so a title's cost is linear in its words.

Cases. A null or blank title has no words and no keys; a null brand is an empty one; a null or blank shop has no keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colours, sizes and the words that stand around sizes.
COLOURS = (
    "black white grey gray silver gold red blue navy green pink purple yellow orange brown beige cream ivory khaki olive teal turquoise burgundy maroon charcoal rose champagne bronze copper nude tan camel mint "
    "lilac lavender coral aqua mustard plum stone sand taupe violet indigo magenta cyan lime peach multicolour multicolor multi clear transparent natural oatmeal ecru mocha espresso graphite slate gunmetal"
).split()
LETTER_SIZES = "xxs xs s m l xl xxl xxxl 2xl 3xl 4xl 5xl 6xl".split()
NAMED_SIZES = "small medium large".split()
SIZE_WORDS = "size sizes uk eu us".split()
UNITS = "gb tb mb ml l ltr litre liter w kw mah v cm mm m kg g oz in inch ft pcs pc pk pack".split()

_SIZE = rf"^(?:{'|'.join(LETTER_SIZES + NAMED_SIZES + SIZE_WORDS)}|[0-9]+(?:{'|'.join(UNITS)}))$"
_OTHER = rf"^(?:{'|'.join(COLOURS)}|[0-9]+[a-z]*)$"
#: Between a product's name and its variant.
_HEAD_END = r"\s[-–—|]\s|,\s"
#: Stands between the parts of a key.
PART = "\x1f"


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def title_parts(title: Column) -> Column:
    """A struct of own (in order, once each), sizes and others (sorted, once each). A decimal is read as one amount (1.7L as 17l)."""
    joined = F.regexp_replace(F.coalesce(title, F.lit("")), r"(\d)[.,](\d)", "$1$2")
    words = F.regexp_extract_all(F.lower(joined), F.lit("[0-9a-z]+"), F.lit(0))

    def marked(all_words: Column) -> Column:
        def one(word: Column, at: Column) -> Column:
            sized = F.coalesce(F.get(all_words, at - 1).isin(SIZE_WORDS), F.lit(False)) & word.rlike("^[0-9]+$")
            kind = F.when(sized | word.rlike(_SIZE), "size").when(word.rlike(_OTHER), "other").otherwise("own")
            return F.struct(kind.alias("kind"), F.when(sized, F.concat(F.lit("~"), word)).otherwise(word).alias("word"))

        return F.transform(all_words, one)

    def parted(marks: Column) -> Column:
        of = lambda kind: F.array_distinct(F.transform(F.filter(marks, lambda m: m["kind"] == kind), lambda m: m["word"]))
        return F.struct(of("own").alias("own"), F.array_sort(of("size")).alias("sizes"), F.array_sort(of("other")).alias("others"))

    return _bound(_bound(words, marked), parted)


def head(title: Column) -> Column:
    """A title before its first dash, bar or comma that stands between words; the whole title without one."""
    return F.split(title, _HEAD_END, 2)[0]


def family_of(shop: Column, brand: Column, parts: Column) -> Column:
    """The key of one shop's and brand's titles with the same own words, two at least; else null."""
    whole = F.concat_ws(PART, shop, F.lower(F.trim(F.coalesce(brand, F.lit("")))), F.array_join(parts["own"], " "))
    return F.when((F.coalesce(shop, F.lit("")) != "") & (F.size(parts["own"]) >= 2), whole)


def family_key(shop: Column, brand: Column, title: Column) -> Column:
    return family_of(shop, brand, title_parts(title))


def head_key(shop: Column, brand: Column, title: Column) -> Column:
    """The family key of the title's head, if that has one; else the whole title's."""
    return F.coalesce(family_key(shop, brand, head(title)), family_key(shop, brand, title))


def sizes_apart_key(shop: Column, brand: Column, title: Column) -> Column:
    """The family key and the other variant words: titles that share it differ by sizes or amounts at most."""
    return sizes_apart_of(shop, brand, title_parts(title))


def sizes_apart_of(shop: Column, brand: Column, parts: Column) -> Column:
    return F.concat(family_of(shop, brand, parts), F.lit(PART), F.array_join(parts["others"], " "))


def variant_difference(first: Column, second: Column) -> Column:
    """How two title_parts of one family differ: null not at all, "certain" by sizes only, "doubtful" by a colour or a number."""
    return F.when(first["others"] != second["others"], "doubtful").when(first["sizes"] != second["sizes"], "certain")
