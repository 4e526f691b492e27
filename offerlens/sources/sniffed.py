"""Feeds whose form nobody states: CSV or JSON, packed or not, UTF-8 or Latin-1, of any usual separator, read by Spark's own readers.

The driver looks at the first bytes of each file only; files of one form and header are read together, so predicates and columns reach the reader. Whether
a file is UTF-8 any of its bytes may decide: that is one pass over the lines, by file, unless the encoding is given.

Cases. Empty files give no rows; a byte order mark is no part of the header. A row that fills a field beyond the header is left out whole, since its
fields don't stand under their names; empty ones beyond it change nothing. Short rows have nulls. Of a name that the header has twice the last counts. White space around
values goes, and what is empty then is null. Files that are packed without a name that says so are unpacked line by line, so a value can't hold a line feed there. Columns that
a file lacks are null.
"""

from __future__ import annotations

import csv
import gzip
import io
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes at the start of a file that tell its form.
HEAD = 1 << 16
SEPARATORS = ",;\t|"
#: Fields beyond the header that a row may have, if they are empty.
BEYOND = 8


def _heads(spark: SparkSession, path: str) -> Iterator[tuple[str, bytes]]:
    """Each file below a path and its first bytes, from whatever store Spark reads."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(top) or []:
        files = fs.listFiles(status.getPath(), True)
        while files.hasNext():
            file = files.next()
            name = file.getPath().getName()
            if file.getLen() and not name.startswith(("_", ".")):
                stream = fs.open(file.getPath())
                try:
                    yield file.getPath().toString(), bytes(stream.readNBytes(HEAD))
                finally:
                    stream.close()


def _unpacked(head: bytes) -> bytes:
    return zlib.decompressobj(31).decompress(head) if head[:2] == b"\x1f\x8b" else head


def form_of(name: str, head: bytes) -> tuple:
    """(kind, packed, separator, header) of a file: csv, lines (a JSON object each), json (one value) or empty; packed: "", "named" or "unnamed"."""
    packed = "" if head[:2] != b"\x1f\x8b" else "named" if name.lower().endswith(".gz") else "unnamed"
    text = _unpacked(head).decode("utf-8", "replace").lstrip("﻿ \t\r\n")
    if not text:
        return "empty", packed, "", ()
    if text[0] == "[":
        return "json", packed, "", ()
    if text[0] == "{":
        first = text.split("\n", 1)[0].rstrip()
        return ("lines" if first.endswith("}") else "json"), packed, "", ()
    first = text.split("\n", 1)[0]
    separator = max(SEPARATORS, key=lambda s: (first.count(s), -SEPARATORS.index(s)))
    return "csv", packed, separator, tuple(c.strip() for c in next(csv.reader(io.StringIO(first), delimiter=separator)))


def _latin(spark: SparkSession, files: list[str]) -> set[str]:
    """The files that hold a line that isn't UTF-8."""
    if not files:
        return set()
    lines = spark.read.text(files).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("fine"))
    return {r.file for r in lines.groupBy("file").agg(F.min("fine").alias("fine")).where("NOT fine").collect()}


def _lines_of_packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task: lines of packed files, a batch of them at a time. UTF-8, or else Latin-1."""
    for batch in batches:
        for content in batch.column(0):
            data = content.as_buffer()
            for encoding in ("utf-8-sig", "latin-1"):
                try:
                    with io.TextIOWrapper(gzip.open(pa.BufferReader(data)), encoding, newline="\n") as text:
                        for _ in text:
                            pass
                    break
                except UnicodeDecodeError:
                    continue
            with io.TextIOWrapper(gzip.open(pa.BufferReader(data)), encoding, newline="\n") as text:
                while lines := text.readlines(1 << 20):
                    yield pa.RecordBatch.from_arrays([pa.array([x.rstrip("\r\n") for x in lines], pa.string())], ["value"])


def _csv_columns(header: Sequence[str]) -> list[str]:
    """Names of a file's fields by place; a name that comes again takes the earlier one's."""
    return [c if c and c not in header[i + 1 :] else f"__{i}" for i, c in enumerate(header)] + [f"__beyond{i}" for i in range(BEYOND)]


def _filled(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def feed(spark: SparkSession, path: str, columns: Sequence[str], where: Column | None = None, encoding: str | None = None) -> DataFrame:
    """Text columns of all files below a path. where: a predicate on them that reaches the readers."""
    forms: dict[tuple, list[str]] = defaultdict(list)
    for file, head in _heads(spark, path):
        form = form_of(file, head)
        if form[0] != "empty":
            forms[form].append(file)
    out = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    text = T.StringType()
    for (kind, packed, separator, header), files in sorted(forms.items()):
        latin = _latin(spark, files) if kind == "csv" and packed != "unnamed" and encoding is None else set()
        for charset in ("UTF-8", "ISO-8859-1"):
            own = [f for f in files if (f in latin) == (charset != "UTF-8")]
            if not own:
                continue
            if packed == "unnamed":
                lines = spark.read.format("binaryFile").load(own).select("content").mapInArrow(_lines_of_packed, "value string").where("trim(value) <> ''")
            if kind == "csv":
                names = _csv_columns(header)
                schema = T.StructType([T.StructField(c, text) for c in names])
                if packed == "unnamed":
                    options = {"sep": separator, "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
                    parsed = lines.select(F.from_csv("value", ", ".join(f"`{c}` string" for c in names), options).alias("r"), "value")
                    rows = parsed.where(~F.col("value").startswith(separator.join(header))).select("r.*")
                else:
                    reader = spark.read.schema(schema).option("header", True).option("sep", separator).option("encoding", encoding or charset).option("multiLine", packed == "").option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
                    rows = reader.csv(own)
                rows = rows.where(F.coalesce(*[F.col(c) for c in names[-BEYOND:]]).isNull())
                found = rows.select(*[(F.col(f"`{c}`") if c in names else F.lit(None).cast(text)).alias(c) for c in columns])
            else:
                schema = T.StructType([T.StructField(c, text) for c in columns])
                if packed == "unnamed":
                    found = lines.select(F.from_json("value", schema).alias("r")).where("r IS NOT NULL").select("r.*")
                else:
                    found = spark.read.schema(schema).option("multiLine", kind == "json").option("mode", "DROPMALFORMED").json(own)
                found = found.select(*[_filled(F.col(f"`{c}`")).alias(c) for c in columns])
            out = out.unionByName(found if where is None else found.where(where))
    return out


def second_feed(rows: DataFrame, first: DataFrame, currency: str) -> DataFrame:
    """Rows (shop, currency, price, stock, category) of a second feed that may join a first one: in its currency, with a price, a stock and a category, of shops that
    the first doesn't have. Shops are compared as trimmed lower case; all but that reaches the scan."""
    named = lambda c: F.lower(F.trim(c))
    fits = (F.col("currency") == currency) & (F.col("price") > 0) & (F.col("stock") > 0) & F.col("category").isNotNull()
    known = first.where("shop IS NOT NULL").select(named("shop").alias("__shop")).distinct()
    return rows.where(fits).join(known, named("shop") == F.col("__shop"), "left_anti")
