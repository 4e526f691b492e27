"""Specifications on literal rows."""

import pytest
from pyspark.sql import functions as F

from offerlens.functions import specs


CASES = [
    (dict(title="XLR Cable 1.5 m"), {"length": (1.5, "m", "title", "1.5 m")}),
    (dict(title="Speaker Driver 40 mm"), {"length": (0.04, "m", "title", "40 mm")}),
    (dict(title="Stand 30cm"), {"length": (0.3, "m", "title", "30cm")}),
    (dict(title="Drive 2TB"), {"storage": (2048.0, "GB", "title", "2TB")}),
    (dict(kind="Gaming Monitor 27 inch"), {"screen": (27.0, "in", "product_type", "27 inch")}),
    (dict(title="Android TV Box 4GB RAM 64GB ROM"), {"storage": (64.0, "GB", "title", "64GB"), "memory": (4.0, "GB", "title", "4GB")}),
    (dict(title="Amplifier 2x50W"), {"power": (50.0, "W", "title", "50W")}),
    (dict(title="USB3.0m hub, 5 gbit, model 12mmx"), {}),
    (dict(title="Weight 1,5 kg"), {"weight": (1500.0, "g", "title", "1,5 kg")}),
    (dict(specifications="Storage: 64GB, Power: 50 W"), {"storage": (64.0, "GB", "specifications", "64GB"), "power": (50.0, "W", "specifications", "50 W")}),
    (dict(specifications="Colour: Black, Extended Length (mm): 610"), {"length": (0.61, "m", "specifications", "610 mm")}),
    (dict(specifications="Storage: plenty, Battery: yes"), {}),
    (dict(specifications="Storage: 64GB", description="Internal storage 128GB inside"), {"storage": (64.0, "GB", "specifications", "64GB")}),
    (dict(description="Impedance 32 ohm. Frequency response: 20 Hz"), {"impedance": (32.0, "ohm", "description", "32 ohm"), "frequency": (20.0, "Hz", "description", "20 Hz")}),
    (dict(description="A lovely 32 inch thing that weighs on 40 mm of desk"), {}),
    (dict(description="Playtime up to 9 hours, battery: at least 3000mAh"), {}),
    (dict(description="Battery: 3000mAh. Playtime 9 hours."), {"battery": (3000.0, "mAh", "description", "3000mAh"), "playtime": (9.0, "h", "description", "9 hours")}),
    (dict(description="The screen is better than 32 inch"), {}),
    (dict(short="Cable length 3 m"), {"length": (3.0, "m", "description", "3 m")}),
    (dict(description="Storage 1 GB storage 2 GB"), {"storage": (1.0, "GB", "description", "1 GB")}),
    (dict(), {}),
    (dict(title="", specifications=" , :", description="\n"), {}),
]


def test_stated(spark):
    names = ("specifications", "title", "kind", "description", "short")
    df = spark.createDataFrame([(i, *map(texts.get, names)) for i, (texts, _) in enumerate(CASES)], "i int, " + ", ".join(f"{n} string" for n in names))
    for r in df.select("i", specs.stated_specs(*[df[n] for n in names]).alias("x")).collect():
        got = {x.property: (pytest.approx(x.value), x.unit, x.source, x.stated) for x in r.x}
        assert got == CASES[r.i][1], CASES[r.i]


def test_the_property_that_most_state(spark):
    rows = [("g", 1, "Storage 64 GB. Playtime 9 hours."), ("g", 2, "Playtime 20 hours. Storage 32 GB."), ("g", 3, "Storage 64 GB"), ("one", 4, "Battery 3000mAh"), ("w", 5, "Power 50 W"), ("w", 6, "Power 60 W"), ("none", 7, None)]
    df = spark.createDataFrame(rows, "shop string, offer_id long, d string").selectExpr("shop", "offer_id", "d", "cast(null as string) AS n")
    offers = df.withColumn("specs", specs.stated_specs(df.n, df.n, df.n, df.d))
    assert [tuple(r) for r in specs.comparable(offers, "shop").collect()] == [("g", "storage", 3, 64.0, 1)]
    assert [tuple(r) for r in specs.comparable(offers.where("offer_id < 3"), "shop").collect()] == [("g", "storage", 2, 64.0, 1)]
    assert [tuple(r) for r in specs.comparable(offers.where("offer_id < 3"), "shop", ("playtime", "storage")).collect()] == [("g", "playtime", 2, 20.0, 2)]
    assert not specs.comparable(offers.limit(0), "shop").count()


@pytest.mark.parametrize("name", ["prj19_stated_specs", "agg39_comparable_property"])
def test_texts_are_read_once_and_by_many_tasks(spark, name):
    """The optimised plan marks each text's numbers once (before, a filter for parts without specifications read them twice more), after dealing the parts out."""
    from __spark_entry__ import queries

    from tests.conftest import DATA

    plan = queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Playtime up to ") == 1 and plan.index("Playtime up to ") < plan.index("Repartition")


def test_same_texts_of_a_group_are_read_once(spark):
    """Below the reading of agg39's texts, a brand's parts with the same texts are one row (before, each part's texts were read)."""
    from __spark_entry__ import queries

    from tests.conftest import DATA

    plan = queries()["agg39_comparable_property"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Playtime up to ") :]
    assert "Aggregate [p_brand#" in below and "min(p_partkey#" in below


def test_rows_that_stand_for_several_offers(spark):
    rows = [("g", 9, "Storage 64 GB."), ("g", 3, "Storage 64 GB."), ("g", 5, "Playtime 9 hours."), ("two", 8, "Battery 3000mAh"), ("two", 7, "Battery 3000mAh"), ("one", 1, "Battery 3000mAh"), (None, 2, "Storage 1 GB"), (None, 4, "Storage 1 GB")]
    df = spark.createDataFrame(rows, "shop string, offer_id long, d string").selectExpr("*", "cast(null as string) AS n")
    read = lambda offers: offers.withColumn("specs", specs.stated_specs(offers.n, offers.n, offers.n, offers.d))
    once = read(df.groupBy("shop", "d", "n").agg(F.min("offer_id").alias("offer_id"), F.count("*").alias("how_many")))
    got = {tuple(r) for r in specs.comparable(once, "shop", count="how_many").collect()}
    assert got == {tuple(r) for r in specs.comparable(read(df), "shop").collect()} == {("g", "storage", 2, 64.0, 3), ("two", "battery", 2, 3000.0, 7), (None, "storage", 2, 1.0, 2)}
