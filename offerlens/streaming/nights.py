"""The nightly memory as a state that streams keep: what is known of each key after each night, replayable night by night.

A folder holds tables that only grow: the rows of each night, the state after it, the price records of it, and commits. A commit names the
version of a night that counts; what was written without one is never read, so a job that dies anywhere leaves the memory as it was. The latest
commit of a night wins. A night that is prepared again replaces its rows, and all later nights are worked out anew from theirs; so does a night that
comes late. The result depends on the nights' rows alone, not on when or how often they came.

State of a key: shop, price, currency, first_seen, last_seen, nights_seen, price_since and seen_nights, of which bit 0 is the last night it was seen, bit 1
the prepared night before, and so on. A night adds one join by key; keys that weren't seen stay as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Nights of which the memory keeps whether a key was seen.
KEPT = 60
ROWS = "key string, shop string, price bigint, currency string, on_sale boolean"
COMMITS = "night date, version string, number bigint, batch string"
RECORDS = "key string, night date, price bigint, currency string, restart boolean"
#: Columns of a state; those that a later version of the memory added come last, with what an older state gives them.
STATE = ("key", "shop", "price", "currency", "first_seen", "last_seen", "nights_seen", "price_since")


def _nights_between(nights: list, after: Column, to: Column) -> Column:
    """How many prepared nights lie after one and up to another."""
    days = F.array(*[F.lit(n).cast("date") for n in nights]) if nights else F.array().cast("array<date>")
    return F.size(F.filter(days, lambda n: (n > after) & (n <= to)))


def with_seen_nights(state: DataFrame, nights: list) -> DataFrame:
    """A state with seen_nights; one that was written before the column existed gets it from what it knew: all prepared nights from the first to the last, if so many were
    seen, else the last one only."""
    if "seen_nights" in state.columns:
        return state
    whole = F.col("nights_seen") == _nights_between(nights, F.date_sub("first_seen", 1), F.col("last_seen"))
    n = F.least(F.col("nights_seen"), F.lit(KEPT)).cast("int")
    return state.withColumn("seen_nights", F.when(whole, F.call_function("shiftleft", F.lit(1).cast("bigint"), n) - 1).otherwise(F.lit(1).cast("bigint")))


def after_night(state: DataFrame, tonight: DataFrame, night, nights: list, restarts: bool) -> tuple[DataFrame, DataFrame]:
    """The state after a night and the night's price records, from the state before it and its rows (ROWS, one a key). nights: all prepared ones, this one too.

    A price is recorded on the night a key is first seen and whenever it changes. If restarts, a sale price that isn't the price remembered begins the
    key's history anew.
    """
    day = F.lit(night).cast("date")
    before = with_seen_nights(state, nights).select(*STATE, "seen_nights")
    old = before.select("key", F.struct(*[c for c in before.columns if c != "key"]).alias("old"))
    both = old.join(tonight.select("key", F.struct("shop", "price", "currency", "on_sale").alias("new")), "key", "full")
    seen, known = F.col("new").isNotNull(), F.col("old").isNotNull()
    changed = ~(F.col("old.price").eqNullSafe(F.col("new.price")) & F.col("old.currency").eqNullSafe(F.col("new.currency")))
    gap = _nights_between(nights, F.col("old.last_seen"), day)
    moved = F.when(gap < KEPT, F.call_function("shiftleft", F.col("old.seen_nights"), gap)).otherwise(0).bitwiseAND(F.lit((1 << KEPT) - 1)).bitwiseOR(F.lit(1).cast("bigint"))
    own = {
        "shop": F.when(seen, F.col("new.shop")).otherwise(F.col("old.shop")),
        "price": F.when(seen, F.col("new.price")).otherwise(F.col("old.price")),
        "currency": F.when(seen, F.col("new.currency")).otherwise(F.col("old.currency")),
        "first_seen": F.coalesce("old.first_seen", day),
        "last_seen": F.when(seen, day).otherwise(F.col("old.last_seen")),
        "nights_seen": F.coalesce("old.nights_seen", F.lit(0).cast("bigint")) + seen.cast("bigint"),
        "price_since": F.when(~known | seen & changed, day).otherwise(F.col("old.price_since")),
        "seen_nights": F.when(~known, F.lit(1).cast("bigint")).when(seen, moved).otherwise(F.col("old.seen_nights")),
    }
    restart = known & changed & F.coalesce(F.col("new.on_sale"), F.lit(False)) if restarts else F.lit(False)
    records = both.where(seen & (~known | changed)).select("key", day.alias("night"), F.col("new.price").alias("price"), F.col("new.currency").alias("currency"), restart.alias("restart"))
    return both.select("key", *[c.alias(n) for n, c in own.items()]), records


class Memory:
    """A nightly memory in a folder that all executors see."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, what: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.folder}/{what}")

    def _there(self, what: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{what}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def commits(self) -> DataFrame:
        """All commits, the latest of each night last."""
        return self._read("commits", COMMITS) if self._there("commits") else self.spark.createDataFrame([], COMMITS)

    def versions(self) -> list[tuple]:
        """Night, version and number of what counts of each night, in order: one small row a night."""
        latest = self.commits().groupBy("night").agg(F.max(F.struct("number", "version")).alias("last"))
        return [(r.night, r.last.version, r.last.number) for r in latest.orderBy("night").collect()]

    def state(self, night=None) -> DataFrame | None:
        """The state after a night, or after the last one."""
        found = [(n, v) for n, v, _ in self.versions() if night is None or n <= night]
        return self._read(f"state/{found[-1][1]}") if found else None

    def prices(self) -> DataFrame:
        """The price records that count (key, night, price, currency): of each key those from its last restart on."""
        versions = [v for _, v, _ in self.versions()]
        if not versions:
            return self.spark.createDataFrame([], RECORDS).drop("restart")
        records = self.spark.read.schema(RECORDS).parquet(*[f"{self.folder}/records/{v}" for v in versions])
        since = records.withColumn("since", F.max(F.when(F.col("restart"), F.col("night"))).over(Window.partitionBy("key")))
        return since.where("since IS NULL OR night >= since").select("key", "night", "price", "currency")

    def remember(self, night, rows: DataFrame, batch: str = "") -> None:
        """Takes a night's rows (ROWS), in place of those it had. Of a key on several rows the least shop, price and currency count; rows without a key don't."""
        tonight = rows.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("shop", "price", "currency", "on_sale")).alias("r")).select("key", "r.*")
        had = self.versions()
        version = uuid.uuid4().hex
        tonight.write.parquet(f"{self.folder}/rows/{version}")
        rows_of = {n: v for n, v, _ in had} | {night: version}
        number = max([n for _, _, n in had], default=0)
        nights = sorted(rows_of)
        state = self.state(max([n for n in nights if n < night])) if any(n < night for n in nights) else None
        sale_nights = self._sale_nights(rows_of)
        done = []
        for n in [n for n in nights if n >= night]:
            own = rows_of[n] if n == night else uuid.uuid4().hex
            tonight = self._read(f"rows/{rows_of[n]}", ROWS)
            if own != rows_of[n]:
                tonight.write.parquet(f"{self.folder}/rows/{own}")
            before = state if state is not None else self.spark.createDataFrame([], "key string, shop string, price bigint, currency string, first_seen date, last_seen date, nights_seen bigint, price_since date, seen_nights bigint")
            after, records = after_night(before, tonight, n, [m for m in nights if m <= n], bool(sale_nights) and n == sale_nights[0])
            after.write.parquet(f"{self.folder}/state/{own}")
            records.write.parquet(f"{self.folder}/records/{own}")
            state = self._read(f"state/{own}")
            number += 1
            done.append((n, own, number, batch))
        # One commit for the night and all that follow from it.
        self.spark.createDataFrame(done, COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def _sale_nights(self, rows_of: dict) -> list:
        """The nights whose rows say whether a price is a sale's, in order."""
        found = []
        for night in sorted(rows_of):
            if self._read(f"rows/{rows_of[night]}", ROWS).where("on_sale IS NOT NULL").take(1):
                found.append(night)
                break
        return found

    def taking(self, stream: str, night: str = "night") -> Callable[[DataFrame, int], None]:
        """For foreachBatch: takes the nights of a batch (ROWS and a date), oldest first. A batch that was taken before, by its stream and number, is passed over."""

        def take(batch: DataFrame, number: int) -> None:
            name = f"{stream}/{number}"
            if self.commits().where(F.col("batch") == name).take(1):
                return
            batch.persist()
            days = [r[0] for r in batch.select(night).where(F.col(night).isNotNull()).distinct().orderBy(night).collect()]
            for i, day in enumerate(days):
                self.remember(day, batch.where(F.col(night) == F.lit(day)), name if i == len(days) - 1 else f"{name}/{day}")
            batch.unpersist()

        return take
