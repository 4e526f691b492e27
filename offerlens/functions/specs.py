"""Specifications that an offer states of its product: numbers with units, read from lists, names and descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The properties in order, each with the unit that its values are given in, its spellings of units and their scale, and the words that name it.
PROPERTIES = (
    ("storage", "GB", {"tb": 1024.0, "gb": 1.0, "mb": 1.0 / 1024.0}, "storage|rom|internal|capacity|ssd|emmc|hard\\s*disk"),
    ("memory", "GB", {}, "memory|ram"),
    ("battery", "mAh", {"mah": 1.0}, "battery|cell"),
    ("playtime", "h", {"hours": 1.0, "hour": 1.0, "hrs": 1.0, "hr": 1.0}, "play\\s*time|playtime|playback|run\\s*time|runtime|battery\\s*life|standby|talk\\s*time"),
    ("power", "W", {"watts": 1.0, "watt": 1.0, "kw": 1000.0, "w": 1.0}, "power|output|rms|wattage|consumption"),
    ("length", "m", {"metres": 1.0, "metre": 1.0, "meters": 1.0, "meter": 1.0, "mm": 0.001, "cm": 0.01, "m": 1.0}, "length|cable|cord|reach|extended"),
    ("screen", "in", {"inches": 1.0, "inch": 1.0}, "screen|display|panel|size|diagonal"),
    ("frequency", "Hz", {"ghz": 1_000_000_000.0, "mhz": 1_000_000.0, "khz": 1000.0, "hz": 1.0}, "frequency|response|bandwidth|band"),
    ("impedance", "ohm", {"ohms": 1.0, "ohm": 1.0}, "impedance"),
    ("weight", "g", {"grams": 1.0, "gram": 1.0, "kg": 1000.0, "g": 1.0}, "weight|weighs|mass"),
)
#: Words before a number that make it no statement; how far labels and hedges may stand off, and how far back is looked; what makes bytes memory.
HEDGES = "up to|at least|as much as|as many as|better than|more than|less than|instead of|compared to|compared with|rather than|than|unlike|vs|versus|replace|replaces|fits|suitable for|compatible with|works with|for use with"
LABEL_GAP, HEDGE_GAP, LOOK_BACK = 24, 16, 42
MEMORY_AFTER = r"(?i)^\W{0,3}(ram|ddr\d?|lpddr\d?)\b"
#: The properties of which more is better for everyone, so that they may rank.
RANKING = ("storage", "battery", "playtime")
SOURCES = ("specifications", "title", "product_type", "description")

_OF_UNIT = {unit: name for name, _, units, _ in PROPERTIES for unit in units}
_SCALE = {unit: scale for _, _, units, _ in PROPERTIES for unit, scale in units.items()}
_BASE = {name: base for name, base, _, _ in PROPERTIES}
_NUMBER = r"\d+(?:[.,]\d+)?"
_UNITS = "|".join(sorted(_OF_UNIT, key=lambda u: (-len(u), u)))
#: A number that begins a word, or follows a count of channels (2x50W), with a unit that ends one. No unit belongs to two properties, so one pass finds all.
_STATED = rf"(?i)(?:(?<![\w.])|(?<=\d[x×]))({_NUMBER})\s*({_UNITS})(?!\w)"
_OPEN, _CLOSE = "\x01", "\x02"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _mapped(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _OPEN + _CLOSE, ""), r"\s+", " "))


def numbers(text: Column) -> Column:
    """Every number with a unit in a text: before (all that stands before it), stated, property, value (in the property's unit) and after."""
    marked = F.split(F.regexp_replace(squeezed(text), _STATED, f"{_OPEN}$0{_CLOSE}"), _OPEN)

    def read(pieces: Column, p: Column, stated: Column) -> Column:
        before = F.translate(F.array_join(F.slice(pieces, F.lit(1), p["i"]), ""), _CLOSE, "")
        amount = F.replace(F.regexp_extract(stated, f"^{_NUMBER}", 0), F.lit(","), F.lit(".")).try_cast("double")
        of = lambda unit: F.struct(before.alias("before"), stated.alias("stated"), _mapped(_OF_UNIT, unit).alias("property"), (amount * _mapped(_SCALE, unit)).alias("value"), F.substring_index(p["piece"], _CLOSE, -1).alias("after"))
        return _let(F.lower(F.regexp_extract(stated, rf"(?i)({_UNITS})$", 1)), of)

    def found(pieces: Column) -> Column:
        placed = F.filter(F.transform(pieces, lambda p, i: F.struct(p.alias("piece"), i.alias("i"))), lambda p: p["i"] > 0)
        return F.transform(placed, lambda p: _let(F.substring_index(p["piece"], _CLOSE, 1), lambda stated: read(pieces, p, stated)))

    return _let(marked, found)


def _spec(name: Column, value: Column, stated: Column, source: str) -> Column:
    return F.struct(name.alias("property"), value.alias("value"), _mapped(_BASE, name).alias("unit"), stated.alias("stated"), F.lit(source).alias("source"))


def declared(text: Column, source: str) -> Column:
    """Specifications of a name: any number with a unit is one; bytes that are called RAM are memory."""

    def named(n: Column) -> Column:
        return F.when((n["property"] == "storage") & F.left(n["after"], F.lit(14)).rlike(MEMORY_AFTER), "memory").otherwise(n["property"])

    return F.transform(numbers(text), lambda n: _spec(named(n), n["value"], n["stated"], source))


def labelled(text: Column, source: str) -> Column:
    """Specifications of a description: a number counts if its property is named shortly before it, and no hedge stands there."""
    labels = {name: words for name, _, _, words in PROPERTIES}

    def counts(n: Column) -> Column:
        before = F.right(n["before"], F.lit(LOOK_BACK))

        def named(ending: Column) -> Column:
            label = F.lit(False)
            for name, words in labels.items():
                label = F.when(n["property"] == name, ending.rlike(rf"(?i)({words})[^.;:]{{0,{LABEL_GAP}}}$")).otherwise(label)
            return label

        hedge = before.rlike(rf"(?i)({HEDGES})\.?[^.;:]{{0,{HEDGE_GAP}}}$")
        return _let(F.regexp_replace(before, r"[:\-–—]?\s*$", ""), named) & ~hedge

    return F.transform(F.filter(numbers(text), counts), lambda n: _spec(n["property"], n["value"], n["stated"], source))


def listed(text: Column, source: str) -> Column:
    """Specifications of a list `name: value, name: value`: the first property that the name has is read from the value, or its unit from the name."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"[,\n;|]"), lambda p: F.contains(p, F.lit(":")))

    def read(part: Column) -> Column:
        return _let(squeezed(F.substring_index(part, ":", 1)), lambda name: _let(F.struct(name.alias("name"), F.coalesce(*[F.when(name.rlike(rf"(?i)({words})[^.;:]{{0,{LABEL_GAP}}}$"), prop) for prop, _, _, words in PROPERTIES]).alias("property"), F.substr(part, F.instr(part, ":") + 1, F.length(part)).alias("value")), of))

    def of(x: Column) -> Column:
        own = F.get(F.filter(declared(x["value"], source), lambda s: s["property"] == x["property"]), F.lit(0))
        bare = F.regexp_extract(squeezed(x["value"]), rf"(?<![\w.])({_NUMBER})(?!\w)", 1)
        unit = F.lit("")
        for prop, _, units, _ in PROPERTIES:
            if units:
                spelled = "|".join(sorted(units, key=lambda u: (-len(u), u)))
                unit = F.when(x["property"] == prop, F.lower(F.regexp_extract(x["name"], rf"(?i)(?<!\w)({spelled})(?!\w)", 1))).otherwise(unit)
        amount = lambda u: F.replace(bare, F.lit(","), F.lit(".")).try_cast("double") * _mapped(_SCALE, u)
        of_name = _let(unit, lambda u: F.when((u != "") & (bare != ""), _spec(x["property"], amount(u), F.concat_ws(" ", bare, u), source)))
        return F.when(x["property"].isNotNull(), F.coalesce(own, of_name))

    return F.array_compact(F.transform(parts, read))


def stated_specs(specifications: Column, title: Column, product_type: Column, *descriptions: Column) -> Column:
    """One specification for each property, in the properties' order: the first that the best source states, of lists, titles, types and descriptions. Nulls state nothing."""
    found = F.concat(listed(specifications, "specifications"), declared(title, "title"), declared(product_type, "product_type"), *[labelled(d, "description") for d in descriptions])

    def first(all_: Column, name: str) -> Column:
        return F.get(F.filter(all_, lambda s: s["property"] == name), F.lit(0))

    return _let(found, lambda all_: F.array_compact(F.array(*[first(all_, name) for name, *_ in PROPERTIES])))


def rows_of(offers: DataFrame, *columns: str) -> DataFrame:
    """Columns and s, a row for each specification of offers(specs). The outer form: the plain one's filter for what has none would read the texts again, twice."""
    return offers.select(*columns, F.explode_outer("specs").alias("s")).where("s IS NOT NULL")


def comparable(offers: DataFrame, group: str, criteria: tuple[str, ...] = RANKING, count: str | None = None) -> DataFrame:
    """Each group's property that most of its offers(group, offer_id, specs) state, two at least, of those that may rank; ties go to the criteria's order. With how many state it, the most and who has it.

    A row may stand for all of a group's offers with the same texts: offer_id is then the smallest of theirs, and the column count says how many they are.
    """
    order = F.create_map(*[F.lit(x) for i, name in enumerate(criteria) for x in (name, i)])
    stated = rows_of(offers, group, "offer_id", *[c for c in [count] if c]).where(F.col("s.property").isin(*[c for c in criteria if c in RANKING]))
    counted = stated.groupBy(group, F.col("s.property").alias("property")).agg((F.sum(count) if count else F.count("*")).alias("n_stated"), F.max("s.value").alias("most"), F.min(F.struct((-F.col("s.value")).alias("value"), "offer_id"))["offer_id"].alias("best_offer"))
    best = Window.partitionBy(group).orderBy(F.desc("n_stated"), order[F.col("property")])
    return counted.where("n_stated >= 2").withColumn("o", F.row_number().over(best)).where("o = 1").drop("o")
