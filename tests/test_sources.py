"""Sources, sinks, refresh and streams on temporary folders."""

from __future__ import annotations

import datetime
import json
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.schema import Kind
from tessella.sources import copying, formats, refresh
from tessella.streaming import logs


def column(name, kind, path=None):
    return formats.SourceColumn(name, Kind.parse(kind), path or name)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_json_envelope(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps({"data": {"items": [{"id": 1, "u": {"n": "a"}}, {"id": 2, "u": {"n": "b"}}]}}, indent=1))
    s = formats.SourceDef("s", (column("id", "BIGINT"), column("name", "CHAR(8)", "u.n")), "json", "id", "data.items")
    assert rows(formats.read_source(spark, s, str(p))) == [(1, "a"), (2, "b")]
    (tmp_path / "b.json").write_text('{"data": {"items": [{"id": 1}]}}')
    with pytest.raises(Exception):
        formats.read_source(spark, s, str(tmp_path / "b.json")).collect()


def test_ndjson(spark, tmp_path):
    p = tmp_path / "a.ndjson"
    p.write_text('{"id":1,"u":{"n":"a"}}\n\n{"id":2,"u":{"n":"b"}}\n')
    s = formats.SourceDef("s", (column("id", "U32"), column("n", "CHAR(4)", "u.n")), "ndjson", "id")
    assert rows(formats.read_source(spark, s, str(p))) == [(1, "a"), (2, "b")]
    p.write_text('{"id":1,"u":{"n":"a"}}\nnot json\n')
    with pytest.raises(Exception):
        formats.read_source(spark, s, str(p)).collect()


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,note\n1,"a,b"\n2,"say ""hi""\nthere"\n3,\n')
    got = formats.read_csv(spark, str(p), multi_line=True)
    assert rows(got.where("note is not null")) == [("1", "a,b"), ("2", 'say "hi"\nthere')] and got.where("note is null").count() == 1


@pytest.mark.parametrize("codec", ["none", "snappy", "gzip", "zstd", "lz4", "brotli"])
def test_parquet_codecs(spark, tmp_path, codec):
    """Long runs of repeated values (dictionary pages), nulls, and both page versions."""
    cells = [(i * i - 40, None if i % 7 == 0 else f"moor {i % 5}", i % 3 == 0, i / 8) for i in range(3000)]
    t = pa.table({n: [c[j] for c in cells] for j, n in enumerate(("peat", "moor", "wet", "depth"))})
    for i, version in enumerate(("1.0", "2.0")):
        pq.write_table(t.slice(1500 * i, 1500), tmp_path / f"{i}.parquet", compression=codec, data_page_version=version, row_group_size=400)
    schema = "peat long, moor string, wet boolean, depth double"
    read = formats.read_parquet_brotli(spark, str(tmp_path), schema) if codec == "brotli" else formats.read_parquet(spark, str(tmp_path))
    assert sorted(map(tuple, read.collect())) == sorted(cells)


def test_csv_rows_of_another_length_raise(spark, tmp_path):
    for i, text in enumerate(("a,b\n1\n", "a,b\n1,2,3\n")):
        (tmp_path / f"{i}.csv").write_text(text)
        with pytest.raises(Exception):
            formats.read_csv(spark, str(tmp_path / f"{i}.csv")).collect()
    (tmp_path / "cr.csv").write_bytes(b"a,b\r\n1,2\r\n3,\r\n")
    assert sorted(map(tuple, formats.read_csv(spark, str(tmp_path / "cr.csv")).collect())) == [("1", "2"), ("3", None)]


def test_parquet_bounds(spark, tmp_path):
    pq.write_table(pa.table({"x": [5, -9, None, 40], "s": ["a"] * 4}), tmp_path / "a.parquet")
    pq.write_table(pa.table({"x": [41, 3], "s": ["b"] * 2}), tmp_path / "b.parquet")
    got = formats.parquet_bounds(spark, str(tmp_path), "x")
    assert rows(got) == [(-9, 41, 6)] and "PushedAggregation: [MIN(x), MAX(x), COUNT(*)]" in got._jdf.queryExecution().toString()


def test_renderers(spark):
    df = spark.createDataFrame([(7, "fen", None), (120, None, 2.5)], "n int, s string, d double")
    assert formats.text_table(df) == "  n | s   |   d\n----+-----+----\n  7 | fen |\n120 |     | 2.5"
    assert sorted(r.line for r in formats.json_lines(df).collect()) == ['{"n":120,"s":null,"d":2.5}', '{"n":7,"s":"fen","d":null}']


def test_nested_parquet(spark, tmp_path):
    t = pa.table({"a": [[1, 2], [], None], "m": pa.array([[("k", 1)], [], None], pa.map_(pa.string(), pa.int64())), "s": [{"x": 1, "y": [["d"]]}, {"x": None, "y": None}, None]})
    pq.write_table(t, tmp_path / "t.parquet")
    flat = formats.flattened(formats.read_parquet(spark, str(tmp_path)))
    assert rows(flat.where("a is not null").select("a", "m")) == [("[1,2]", '{"k":1}'), ("[]", "{}")]


AWKWARD = [(1, "a\tb\\n\nc", True, 1.5), (2, None, False, None), (3, "\\N", None, -2.0), (4, "", True, 0.0), (5, "a|b,c;d\"e\"\r~", False, 1e300), (6, " x ", None, 3.25), (7, "nil", True, 1.0), (8, "\\", None, 2.0), (9, "é\\x41\\101", None, None)]
KINDS = "id long, s string, f boolean, d double"


def same(got, want):
    return sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want), key=str)


@pytest.mark.parametrize("said", [{}, {"DELIMITER": "|"}, {"NULL": "nil", "HEADER": "true", "DELIMITER": ","}, {"NULL": ""}])
def test_copy_text(spark, tmp_path, said):
    df = spark.createDataFrame([r for r in AWKWARD if said.get("NULL") != "" or r[1] != ""], KINDS)
    options = copying.CopyOptions.of(said)
    copying.write_copy_text(df, str(tmp_path / "t"), options)
    assert same(copying.read_copy_text(spark, str(tmp_path / "t"), KINDS, options), df.collect())


def test_copy_text_escapes(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"1\tx\\x41\\101\\q\\xc3\\xa9\\\\n\\t\n2\t\\N\n\\.\n")
    assert rows(copying.read_copy_text(spark, str(tmp_path / "a"), "id int, s string")) == [(1, "xAAqé\\n\t"), (2, None)]
    (tmp_path / "h").write_text("id\ts\n3\tid\nid\ts\n")  # a row that reads like the header is a row
    got = copying.read_copy_text(spark, str(tmp_path / "h"), "id string, s string", copying.CopyOptions.of({"header": "true"}))
    assert rows(got) == [("3", "id"), ("id", "s")]
    for bad in ("1\n", "1\t2\t3\n", "1\tx\\\n", "\t\t\n"):
        (tmp_path / "bad").write_text(bad)
        with pytest.raises(Exception, match="wrong number of cells"):
            copying.read_copy_text(spark, str(tmp_path / "bad"), "id long, s string").collect()
    long_ = "a\\b\n" * 200_000
    copying.write_copy_text(spark.createDataFrame([(1, long_)], "id int, s string"), str(tmp_path / "long"))
    assert rows(copying.read_copy_text(spark, str(tmp_path / "long"), "id int, s string")) == [(1, long_)]


def test_values_that_do_not_fit_raise(spark):
    def read(text, kind):
        df = spark.createDataFrame([(text,)], "s string")
        return df.select(copying.value(F.col("s"), T._parse_datatype_string(kind), "col").alias("v")).head()[0]

    fits = {("1.5e3", "int"): 1500, ("-7", "smallint"): -7, ("4.00", "bigint"): 4, ("YES", "boolean"): True, ("0", "boolean"): False, ("2.345", "decimal(5,2)"): Decimal("2.35"), ("1e2", "decimal(9,1)"): Decimal("100.0"), ("\\x00fF", "binary"): b"\x00\xff", (None, "int"): None, ("2024-02-29", "date"): datetime.date(2024, 2, 29), ("-inf", "double"): float("-inf")}
    for (text, kind), want in fits.items():
        assert read(text, kind) == want, (text, kind)
    assert read("9223372036854775807", "bigint") == 2**63 - 1
    for text, kind, why in (("1.5", "int", "not whole"), ("garbage", "boolean", "invalid input"), ("", "int", "invalid input"), ("300", "tinyint", "out of range"), ("1e30", "bigint", "out of range"), ("12x", "decimal(5,2)", "invalid input"), ("12345", "decimal(5,2)", "out of range"), ("00ff", "binary", "invalid input"), ("2023-02-29", "date", "invalid input"), ("nan?", "double", "invalid input")):
        with pytest.raises(Exception, match=f"col: {why}"):
            read(text, kind)


@pytest.mark.parametrize("said", [{}, {"DELIMITER": ";", "HEADER": "true"}, {"QUOTE": "~", "ESCAPE": "~"}])
def test_copy_csv(spark, tmp_path, said):
    """Null and empty text come back apart."""
    df = spark.createDataFrame([r for r in AWKWARD if "\r" not in (r[1] or "")] + [(10, 'say "no"\nor; ~maybe~', True, 1.0)], KINDS)
    options = copying.CopyOptions.of({"FORMAT": "csv"} | said)
    copying.write_copy_csv(df, str(tmp_path / "t"), options)
    assert same(copying.read_copy_csv(spark, str(tmp_path / "t"), KINDS, options), df.collect())


def test_copy_options():
    of = copying.CopyOptions.of
    assert of({"format": "CSV", "freeze": "true", "whatever": "1", "encoding": "utf-8"}) == copying.CopyOptions("csv", ",", "")
    for bad in ({"format": "xml"}, {"force_quote": "a"}, {"encoding": "latin1"}, {"delimiter": "ab"}, {"delimiter": "x"}, {"format": "csv", "delimiter": '"'}, {"format": "csv", "quote": ""}):
        with pytest.raises(ValueError):
            of(bad)


def test_copy_csv_and_binary(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n\n1,1.5e3\n2,7\n")
    assert rows(copying.read_copy_csv(spark, str(tmp_path / "a.csv"), "id long, n long", copying.CopyOptions.of({"format": "csv", "header": "true"}))) == [(1, 1500), (2, 7)]
    df = spark.createDataFrame([(1, "é", 2.5, b"\x00\x01"), (2, None, None, None)], "id int, s string, d double, b binary")
    got = copying.from_copy_binary(copying.to_copy_binary(df), "id int, s string, d double, b binary")
    assert same(got, df.collect())
    for kind in ("text", "csv", "binary"):
        options = copying.CopyOptions.of({"format": kind})
        copying.copy_to(df, str(tmp_path / kind), options)
        assert same(copying.copy_from(spark, str(tmp_path / kind), "id int, s string, d double, b binary", options), df.collect())


def test_two_writers(spark, tmp_path):
    """Of two writers from one version one wins; the other raises and changes nothing, before or after."""
    a, b = (refresh.VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    a.write(spark.range(3))
    base = b.version()
    assert a.write(spark.range(10), base) == 2
    with pytest.raises(refresh.Conflict):
        b.write(spark.range(77), base)
    with pytest.raises(refresh.Conflict):
        b.append(spark.range(5), base)
    assert b.version() == 2 and b.read().count() == 10 and a.read(1).count() == 3
    b.append(spark.range(10, 15), 2)
    assert a.read().count() == 15 and a.read(2).count() == 10 and len(a.parts()) == 2
    with pytest.raises(Exception):
        a.write(spark.range(4).select(F.raise_error(F.lit("no")).alias("id")))
    assert a.version() == 3 and a.read().count() == 15
    a.collect_garbage(1)
    assert a.read().count() == 15 and len(list((tmp_path / "t/parts").iterdir())) == 2
    (tmp_path / "t/_claims/4").touch()  # a writer that died
    with pytest.raises(refresh.Conflict):
        a.append(spark.range(1))
    a.recover()
    a.append(spark.range(1))
    assert b.read().count() == 16


def test_refresh(spark, tmp_path):
    s = formats.SourceDef("feed", (column("id", "BIGINT"), column("name", "CHAR(8)")), "ndjson", "id")
    t = refresh.VersionedTable(spark, str(tmp_path / "table"))
    p = tmp_path / "a.ndjson"
    p.write_text('{"id":1,"name":"a"}\n{"id":2,"name":"b"}\n')
    assert refresh.refresh(t, s, str(p)) == 1
    p2 = tmp_path / "b.ndjson"
    p2.write_text('{"id":2,"name":"B"}\n')
    refresh.refresh(t, s, str(p2))
    refresh.refresh(t, s, str(p2))
    assert rows(t.read()) == [(1, "a"), (2, "B")] and t.version() == 3
    p3 = tmp_path / "c.ndjson"
    p3.write_text('{"id":3,"name":"c"}\n{"id":4,"name":"far too long"}\n')
    with pytest.raises(Exception):
        refresh.refresh(t, s, str(p3))
    assert t.version() == 3 and rows(t.read()) == [(1, "a"), (2, "B")]
    t.collect_garbage(1)
    assert rows(t.read()) == [(1, "a"), (2, "B")]


def test_pages(spark, tmp_path):
    s = formats.SourceDef("feed", (column("id", "BIGINT"),), "json", "id", "rows")
    site = {"u1": {"body": '{"rows": [{"id": 1}], "next": "u2"}'}, "u2": {"body": '{"rows": [{"id": 2}], "next": ""}'}}
    t = refresh.VersionedTable(spark, str(tmp_path / "table"))
    refresh.refresh_pages(t, s, refresh.pages(site.__getitem__, "u1", refresh.next_json("next")), str(tmp_path / "pages"))
    assert rows(t.read()) == [(1,), (2,)]
    site["u2"]["body"] = '{"rows": [], "next": "u1"}'
    with pytest.raises(ValueError, match="twice"):
        list(refresh.pages(site.__getitem__, "u1", refresh.next_json("next")))
    assert refresh.next_link({"link": '<p1>; rel="prev", <p2>; rel="next"'}) == "p2"
    assert refresh.cursor_json("c", "after", "base")({"body": '{"c": "x y"}'}) == "base?after=x%20y"


def test_logs(spark, tmp_path):
    log = refresh.VersionedTable(spark, str(tmp_path / "log"))
    one = spark.createDataFrame([("c", 1, "x"), ("c", 2, "y")], "client string, req int, payload string")
    logs.append_once(log, one, ["client", "req"], ["req"])
    logs.append_once(log, one.unionByName(spark.createDataFrame([("c", 3, "z")], one.schema)), ["client", "req"], ["req"])
    assert rows(log.read().select("seq", "payload")) == [(1, "x"), (2, "y"), (3, "z")]


def test_refresh_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a", 1), (2, "b", 1), (1, "c", 2)], "k long, v string, at int").write.parquet(str(tmp_path / "in"))
    t = refresh.VersionedTable(spark, str(tmp_path / "table"))
    logs.refresh_stream(logs.read_stream(spark, str(tmp_path / "in"), "k long, v string, at int"), t, "k", "at", str(tmp_path / "ck")).awaitTermination(120)
    assert rows(logs.merged(t, "k", "at").select("k", "v")) == [(1, "c"), (2, "b")]


def test_refresh_stream_compacts(spark, tmp_path):
    for i in range(5):
        spark.createDataFrame([(1, i)], "k long, at int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t = refresh.VersionedTable(spark, str(tmp_path / "table"))
    stream = logs.read_stream(spark, str(tmp_path / "in"), "k long, at int", per_trigger=1)
    logs.refresh_stream(stream, t, "k", "at", str(tmp_path / "ck"), compact=2).awaitTermination(120)
    assert len(t.parts()) <= 2 and rows(logs.merged(t, "k", "at")) == [(1, 4)]


def test_row_id(spark):
    got = spark.range(1).select(formats.row_id(3, F.lit("key")).alias("a"), formats.row_id(4, F.lit("key")).alias("b")).head()
    assert len(got.a) == 16 and got.a != got.b
