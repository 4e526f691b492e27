"""Column expressions on text: keys, normal forms, identifiers and URLs. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(*columns: Column) -> Column:
    """The first of the columns that holds more than white space, trimmed; else null."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def squeezed(text: Column) -> Column:
    """Lower case, with single spaces and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def slug(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, joined by dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def skeleton(word: Column) -> Column:
    """The consonants of a word, each run of one consonant once."""
    consonants = F.regexp_replace(F.lower(word), "[^b-df-hj-np-tv-z]", "")
    return F.regexp_replace(consonants, r"(.)\1+", "$1")


def visible(html: Column) -> Column:
    """A page's text without scripts, styles, comments and tags, squeezed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    return squeezed(F.regexp_replace(text, r"(?s)<[^>]*>", " "))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no slash at the end."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(bare, "^([^:/?]+://[^/?]*)", 1)
    return F.regexp_replace(F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare))), "/+$", "")


def digest_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """A stable id: a prefix and the first hexadecimal digits of the parts' SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length))


def gtin_valid(code: Column) -> Column:
    """Whether a code has 8, 12, 13 or 14 digits of which the last is the check digit (weights 3 and 1 from the right)."""
    digits = F.lpad(code, 14, "0")
    total = sum((F.substring(digits, i + 1, 1).cast("int") * (3 if i % 2 == 0 else 1) for i in range(13)), F.lit(0))
    fits = code.rlike("^([0-9]{8}|[0-9]{12,14})$")
    return F.when(fits, (10 - total % 10) % 10 == F.substring(digits, 14, 1).cast("int")).otherwise(False)


def words(text: Column) -> Column:
    """The lower-case words of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def other_number(word: Column) -> Column:
    """The plural of a singular English word, or the singular of a plural one."""
    return (
        F.when(word.rlike("[^aeiou]ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(ss|sh|ch|x|z)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("[^su]s$"), F.regexp_replace(word, "s$", ""))
        .when(word.rlike("[^aeiou]y$"), F.regexp_replace(word, "y$", "ies"))
        .when(word.rlike("(s|sh|ch|x|z)$"), F.concat(word, F.lit("es")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def deletions(word: Column) -> Column:
    """The word and every word that one deletion gives, sorted and distinct."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_sort(F.array_distinct(F.concat(F.array(word), cut)))


def misspellings(text: Column) -> Column:
    """A struct of slips in the longest word (the first of them): missing (a letter, from five letters on), swapped and doubled (from
    four on), and joined (two words or more, without their spaces); "" where one can't be made."""
    bound = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  # each value is computed once

    def slips(words: Column, most: Column, place: Column, word: Column) -> Column:
        half = F.floor(most / 2).cast("int")
        left = F.greatest(F.lit(1), half - 1)
        with_word = lambda new: F.array_join(F.transform(words, lambda w, i: F.when(i == place - 1, new).otherwise(w)), " ")
        letter = lambda at: F.substr(word, at + 1, F.lit(1))
        head, tail = (lambda n: F.substr(word, F.lit(1), n)), (lambda n: F.substr(word, n + 1))
        missing = F.when(most >= 5, with_word(F.concat(head(half), tail(half + 1))))
        swapped = F.when((most >= 4) & (letter(left) != letter(left + 1)), with_word(F.concat(head(left), letter(left + 1), letter(left), tail(left + 2))))
        doubled = F.when(most >= 4, with_word(F.concat(head(half), letter(half), tail(half))))
        joined = F.when(F.size(words) >= 2, F.array_join(words, ""))
        return F.struct(*[F.coalesce(c, F.lit("")).alias(n) for n, c in (("missing", missing), ("swapped", swapped), ("doubled", doubled), ("joined", joined))])

    def longest(words: Column) -> Column:
        lengths = F.transform(words, F.length)
        place = F.array_position(lengths, F.array_max(lengths)).cast("int")
        found = F.struct(place.alias("place"), F.get(words, place - 1).alias("word"))
        return bound(found, lambda x: slips(words, F.length(x["word"]), x["place"], x["word"]))

    return bound(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), longest)


def words_apart(first: Column, second: Column) -> Column:
    """How many words the side with more words of its own has that the other lacks."""
    return F.greatest(F.size(F.array_except(first, second)), F.size(F.array_except(second, first)))


def words_close(first: Column, second: Column, most: int) -> Column:
    """Whether two sets of words are at most so many apart, and share more words than that; empty sets are close to nothing."""
    apart = words_apart(first, second)
    return (F.size(first) > 0) & (F.size(second) > 0) & (apart <= most) & (F.size(F.array_intersect(first, second)) > apart)


def shelves(url: Column) -> Column:
    """The parts of an address before its last one, as a path of words; "" if there are none."""
    path = F.lower(F.regexp_extract(url, "^[a-z]+://[^/?#]*([^?#]*)", 1))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    named = F.transform(above, lambda p: F.trim(F.regexp_replace(F.coalesce(F.try_url_decode(F.regexp_replace(p, "[-_+]+", " ")), p), "[-_+]+", " ")))
    return F.coalesce(F.array_join(F.filter(named, lambda p: p != ""), " > "), F.lit(""))


#: Edits that two words of an overlap may have, and how near they must be.
WORD_EDITS, WORD_NEAR = 2, 0.72


def token_overlap(first: Column, second: Column) -> Column:
    """How far two lists of words cover each other: of each word of the first its nearness to the nearest of the second, if that is
    enough, over the number of words of the longer list. 0 if either has none."""
    own, other = (F.filter(w, lambda x: x != "") for w in (first, second))

    def nearness(a: Column, b: Column) -> Column:
        edits = F.levenshtein(a, b, WORD_EDITS)
        return F.when(edits >= 0, 1 - edits / F.greatest(F.length(a), F.length(b))).otherwise(0.0)

    best = F.transform(own, lambda a: F.array_max(F.transform(other, lambda b: nearness(a, b))))
    total = F.aggregate(best, F.lit(0.0), lambda sum_, x: sum_ + F.when(x >= WORD_NEAR, x).otherwise(0.0))
    return F.when((F.size(own) == 0) | (F.size(other) == 0), 0.0).otherwise(total / F.greatest(F.size(own), F.size(other)))


#: Letters and words of a part number, and digits of a trade number.
PART_LETTERS, PART_WORDS, GTIN_DIGITS = (3, 40), 4, (8, 12, 13, 14)


def _spaced(column: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"\s+", " "))


def same_product_key(codes: list[Column], brand: Column, parts: list[Column]) -> Column:
    """What joins offers of one product: the first trade number whose check digit agrees, else the brand with the first part number that looks like a code
    (a digit, or two capitals together); else "". Numbers have 14 digits, so that all lengths of one agree."""
    digits = [F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "") for c in codes]
    code = F.coalesce(*[F.when(gtin_valid(d) & d.rlike("[1-9]"), F.lpad(d, 14, "0")) for d in digits])
    coded = lambda p: F.length(p).between(*PART_LETTERS) & (F.size(F.split(p, " ")) <= PART_WORDS) & p.rlike(r"\d|[A-Z]{2}")
    part = F.coalesce(*[F.when(coded(_spaced(p)), F.lower(_spaced(p))) for p in parts])
    name = F.lower(_spaced(brand))
    return F.when(code.isNotNull(), F.concat(F.lit("gtin:"), code)).when((name != "") & part.isNotNull(), F.concat(F.lit("mpn:"), name, F.lit("|"), part)).otherwise("")


def identity_key(codes: list[Column], brand: Column, parts: list[Column]) -> Column:
    """The older key: the first filled trade number of a known length that isn't all zeros, whatever its check digit; else the brand with the first filled part number; else ""."""
    first = lambda columns: F.coalesce(*[F.nullif(_spaced(c), F.lit("")) for c in columns], F.lit(""))
    digits = F.regexp_replace(first(codes), "[^0-9]", "")
    part, name = F.lower(first(parts)), F.lower(_spaced(brand))
    known = F.length(digits).isin(*GTIN_DIGITS) & digits.rlike("[1-9]")
    return F.when(known, F.concat(F.lit("gtin:"), F.lpad(digits, 14, "0"))).when((name != "") & (part != ""), F.concat(F.lit("mpn:"), name, F.lit("|"), part)).otherwise("")
