"""Feeds of unknown form, and logs by day."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from offerlens.sources import feeds, sniffed

COLUMNS = ("id", "name", "price")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


FORMS = {
    "comma": b"id,name,price\n1,Kettle,10\n2, \"a, \"\"b\"\"\" ,\n\n3,\xc3\xa9t\xc3\xa9,7\n",
    "mark": b"\xef\xbb\xbfid;name;price\r\n1;Kettle;10\r\n2;\"a, \"\"b\"\"\";\r\n3;\xc3\xa9t\xc3\xa9;7\r\n",
    "latin": b"price\tname\tid\n10\tKettle\t1\n\ta, \"b\"\t2\n7\t\xe9t\xe9\t3\n",
    "ragged": b"id,name,price\n1,Kettle,10,,\n2,\"a, \"\"b\"\"\"\n9,x,1,,beyond\n3,\xc3\xa9t\xc3\xa9,7\n",
    "twice": b"price,id,name,price\n99,1,Kettle,10\n5,2,\"a, \"\"b\"\"\",\n,3,\xc3\xa9t\xc3\xa9,7\n",
    "lines": "\n".join(json.dumps(x) for x in ({"id": "1", "name": "Kettle", "price": "10", "more": [1]}, {"id": "2", "name": "a, \"b\" ", "price": " "}, {"id": "3", "name": "été", "price": 7})).encode(),
    "list": json.dumps([{"id": "1", "name": "Kettle", "price": "10"}, {"id": "2", "name": "a, \"b\""}, {"id": "3", "name": "été", "price": "7"}], indent=1).encode(),
}
WANT = sorted([("1", "Kettle", "10"), ("2", 'a, "b"', None), ("3", "été", "7")], key=repr)


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("packed", ["", ".gz", "unnamed"])
def test_forms(spark, tmp_path, form, packed):
    if packed == "unnamed" and form in ("list", "twice", "latin", "mark"):
        pytest.skip("told apart by the other forms")
    body = gzip.compress(FORMS[form]) if packed else FORMS[form]
    (tmp_path / f"feed{packed if packed != 'unnamed' else '.dat'}").write_bytes(body)
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"x")
    assert rows(sniffed.feed(spark, str(tmp_path), COLUMNS)) == WANT


def test_a_predicate_reaches_the_readers(spark, tmp_path):
    for name in ("comma", "latin", "lines"):
        (tmp_path / name).write_bytes(FORMS[name])
    df = sniffed.feed(spark, str(tmp_path), COLUMNS, F.col("price") == "7")
    assert rows(df) == [("3", "été", "7")] * 3
    plan = df.select("name")._jdf.queryExecution().toString()
    assert plan.count("EqualTo(price,7)") >= 2
    assert "ReadSchema: struct<id" not in plan.replace("`", "")


def test_nothing_there(spark, tmp_path):
    (tmp_path / "a").write_bytes(b" \n")
    assert not rows(sniffed.feed(spark, str(tmp_path), COLUMNS))


def test_stated_feeds_and_logs(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(FORMS["comma"].replace(b", \"a", b",\"a").replace(b'" ,', b'",'))
    assert rows(feeds.csv_feed(spark, str(tmp_path / "a.csv"), COLUMNS)) == WANT
    (tmp_path / "a.json").write_bytes(FORMS["list"])
    assert rows(feeds.json_feed(spark, str(tmp_path / "a.json"), COLUMNS)) == WANT
    log = tmp_path / "log"
    log.mkdir()
    (log / "q-2026-01-02.jsonl").write_text('{"q": "kettle"}\nnot json\n{"other": 1}\n{"q": "lamp"}\n')
    (log / "q-2026-01-03.jsonl").write_text('{"q": "kettle"}\n')
    assert [(str(r.day), r.q) for r in feeds.search_log(spark, str(log)).orderBy("day", "q").collect()] == [("2026-01-02", "kettle"), ("2026-01-02", "lamp"), ("2026-01-03", "kettle")]
