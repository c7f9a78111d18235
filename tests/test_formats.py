import json
import threading
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing, registry, scalars
from tidemark.sources import manifests
from tidemark.streaming import periodic

BYTES = list(range(32))
HEX = bytes(BYTES).hex()
FILE = {"path": "a", "mode": 0o100644, "size": 5, "mtime_secs": 7, "mtime_nanos": 8, "content": BYTES, "chunks": [BYTES, BYTES[::-1]]}
V3 = {"version": 3, "parent": BYTES, "timestamp_secs": 9, "message": "m", "files": [FILE], "unstable": ["a"], "actor": "x", "new": 1}
V2 = {"version": 2, "parent": None, "timestamp_secs": 9, "message": "m", "files": []}


def frame(spark, *documents):
    return spark.createDataFrame([(str(k), d if isinstance(d, str) else json.dumps(d)) for k, d in enumerate(documents)], "snapshot_id string, value string")


def test_manifests_are_read(spark):
    rows = {r["snapshot_id"]: r for r in manifests.decoded(frame(spark, V3, V2)).collect()}
    assert rows["0"]["parent_id"] == HEX and rows["0"]["actor"] == "x" and rows["0"]["unstable"] == ["a"]
    f = rows["0"]["files"][0]
    assert f["content"] == HEX and f["chunks"] == [HEX, bytes(BYTES[::-1]).hex()] and f["mode"] == 0o644 and f["size"] == 5
    assert rows["1"]["parent_id"] is None and rows["1"]["actor"] is None and rows["1"]["unstable"] == [] and rows["1"]["files"] == []


@pytest.mark.parametrize("bad", ["", "no json", "[]", json.dumps({**V3, "version": 1}), json.dumps({**V3, "timestamp_secs": 2**63}), json.dumps({**V3, "files": [{**FILE, "size": 2**64 - 1}]})])
def test_bad_manifests_are_errors(spark, bad):
    with pytest.raises(manifests.BadManifest):
        manifests.decoded(frame(spark, V3, bad))


def test_manifests_round_trip(spark):
    m = manifests.decoded(frame(spark, V3, V2))
    back = {r["snapshot_id"]: json.loads(r["value"]) for r in manifests.encoded(m.drop("files"), manifests.entries(m)).collect()}
    assert back["0"] == {k: v for k, v in V3.items() if k != "new"} | {"files": [{**FILE, "mode": 0o644}]}
    assert back["1"] == V2 | {"unstable": [], "actor": None}


def test_sql_functions(spark):
    registry.register(spark)
    row = spark.sql(r"SELECT safe_path('a/b') a, safe_path('a/../b') b, safe_path('a\\b') c, excluded_path('x/.git/y') d, json_str('q\"\n') e").first()
    assert tuple(row) == (True, False, False, True, '"q\\"\\n"')
    rows = spark.sql("SELECT * FROM cdc_chunks(CAST(repeat('abcdefgh', 1000) AS BINARY), 256, 1024, 4096)").collect()
    assert sum(r["length"] for r in rows) == 8000 and rows[0]["start"] == 0


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    assert value(hashing.audit_body(F.lit(3), F.lit(4), F.lit("a\"b"), F.lit("é"), F.lit(""))) == '[3,4,"a\\"b","é",""]'
    assert value(hashing.parsed(F.lit("AB" * 32))) == "ab" * 32 and value(hashing.parsed(F.lit("xy"))) is None
    assert value(scalars.shell_quoted(F.lit("it's"))) == "'it'\\''s'"
    assert value(scalars.xml_escaped(F.lit("<a&'\">"))) == "&lt;a&amp;&apos;&quot;&gt;"
    assert [value(scalars.exit_code(F.lit(a).cast("int"), F.lit(b).cast("int"))) for a, b in ((3, None), (None, 9), (None, None))] == [3, 137, 1]
    assert value(scalars.shown_time(F.lit(0))) == "1970-01-01 00:00:00Z" and str(value(scalars.civil_date(F.lit(19_000)))) == "2022-01-08"
    assert [value(scalars.is_loopback(F.lit(x))) for x in ("127.0.0.1:1", "localhost:2", "[::1]:3", "10.0.0.1:4")] == [True, True, True, False]
    assert value(scalars.normalised(F.lit("/r/a\\b"), F.lit("/r"))) == "a/b" and value(scalars.interval(F.lit(5))) == 60
    assert scalars.ignore_patterns([" a ", "", "# b", "c"]) == ["a", "c"]


def test_periodic():
    stop, calls = threading.Event(), []

    class Fake:
        def anchor(self, folder, key):
            calls.append(folder)
            if len(calls) == 3:
                stop.set()

    assert periodic.anchor_every(Fake(), "f", (b"", ""), 0, stop, least=0) == 3
    root = ET.fromstring(periodic.agent_text("a<b", ["x & y", "z"], 5))
    assert [e.text for e in root.iter("string")] == ["a<b", "x & y", "z"] and root.find(".//integer").text == "60"
