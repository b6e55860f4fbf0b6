"""Operators on small tables with known answers."""

from __future__ import annotations

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tessella.functions.digests import canonical, hmac256, sha256
from tessella.functions.predicates import compare, in_list, like_bytes, like_plain, pad_trim
from tessella.functions.programs import compile_program
from tessella.operators import changes, constraints
from tessella.operators.aggregates import Agg, aggregate, group_aggregate
from tessella.operators.joins import chain_join, compare_scalar, equi_join, named, not_in_subquery
from tessella.operators.ordering import distinct_rows, sorted_page
from tessella.plans.engine import Engine
from tessella.schema import FieldDef, Kind, TableDef

#: Own rows: a null and an empty group key, ties, a null amount, a zero and a negative one. Answers below are worked out by hand.
PICKS = [(11, "hill", "plum", 12), (12, "hill", "plum", 12), (13, "hill", "pear", 0), (14, "hill", None, -3), (21, "dale", "pear", 7), (22, "dale", "pear", None), (23, "dale", "", 30), (31, None, "plum", 5)]


@pytest.fixture(scope="module")
def picks(spark):
    return spark.createDataFrame(PICKS, "id long, orchard string, fruit string, kilos long")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_composite_groups(picks):
    aggs = [Agg("count", None, "n"), Agg("sum", "kilos", "s"), Agg("count", "kilos", "w")]
    got = rows(group_aggregate(picks, ["orchard", "fruit"], aggs))
    assert sorted(got, key=str) == sorted([("hill", "plum", 2, 24, 2), ("hill", "pear", 1, 0, 1), ("hill", None, 1, -3, 1), ("dale", "pear", 2, 7, 1), ("dale", "", 1, 30, 1), (None, "plum", 1, 5, 1)], key=str)
    assert rows(group_aggregate(picks, ["fruit"], aggs[:1], order="n", descending=True, limit=2)) == [("pear", 3), ("plum", 3)]  # a tie goes by key
    assert sorted(rows(group_aggregate(picks, ["orchard"], aggs[1:2], having=F.col("s") > 10)), key=str) == [("dale", 37), ("hill", 21)]


def test_integer_average_and_empty(picks):
    assert rows(aggregate(picks, [Agg("avg", "kilos", "a")], compat=True)) == [(9,)]  # 63 over 7
    assert rows(aggregate(picks, [Agg("int_avg", "kilos", "a")], F.col("id") < 20)) == [(5,)]  # 21 over 4
    none = F.col("id") < 0
    assert rows(aggregate(picks, [Agg("sum", "kilos", "s"), Agg("avg", "kilos", "a")], none)) == [(None, None)]
    assert rows(aggregate(picks, [Agg("sum", "kilos", "s"), Agg("avg", "kilos", "a")], none, compat=True)) == [(0, 0)]


def test_outer_joins(spark):
    """Three stations, one without trains and one without a code; trains of a code that no station has, and of none."""
    stations = spark.createDataFrame([("N", 4), ("S", 2), (None, 1)], "code string, tracks int")
    trains = spark.createDataFrame([(501, "N"), (502, "N"), (503, "W"), (504, None), (505, "W")], "train int, stop string")
    n = {how: equi_join(stations, trains, "code", "stop", how).count() for how in ("inner", "left", "right", "full")}
    assert n == {"inner": 2, "left": 4, "right": 5, "full": 7}


def test_chain(spark):
    lakes = spark.createDataFrame([(1, "long"), (2, "round"), (3, "dry")], "lake int, shape string")
    boats = spark.createDataFrame([(71, 1), (72, 2), (73, 2)], "boat int, on_lake int")
    trips = spark.createDataFrame([(9001, 72, 2.5), (9002, 72, 1.0), (9003, 73, 4.0), (9004, 99, 1.0)], "trip int, by_boat int, hours double")
    out = chain_join([("lakes", lakes), ("boats", boats), ("trips", trips)], [("lakes.lake", "boats.on_lake"), ("trips.by_boat", "boats.boat")])
    assert out.columns == ["lakes.lake", "lakes.shape", "boats.boat", "boats.on_lake", "trips.trip", "trips.by_boat", "trips.hours"]
    assert sorted(rows(out.select("`lakes.shape`", "`boats.boat`", "`trips.hours`"))) == [("round", 72, 1.0), ("round", 72, 2.5), ("round", 73, 4.0)]
    with pytest.raises(ValueError):
        chain_join([("lakes", lakes), ("lakes", lakes)], [("lakes.lake", "lakes.lake")])
    with pytest.raises(ValueError):
        chain_join([("lakes", lakes), ("boats", boats)], [("boats.boat", "trips.by_boat")])
    assert named(lakes, "l").columns == ["l.lake", "l.shape"]


def test_distinct_and_null_order(picks):
    assert distinct_rows(picks, ["fruit"]).count() == 4
    assert [r.id for r in sorted_page(picks, "kilos", "id").collect()] == [14, 13, 31, 21, 11, 12, 23, 22]
    assert [r.id for r in sorted_page(picks, "kilos", "id", descending=True, offset=1, limit=3).collect()] == [23, 11, 12]


def test_two_valued(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    assert df.where(~compare(F.col("x"), ">", F.lit(2))).count() == 2
    assert df.where(~(F.col("x") > 2)).count() == 1
    assert df.where(in_list(F.col("x"), [])).count() == 0


def test_text_rules(spark):
    df = spark.createDataFrame([("ab ",), ("ab\x00",), ("a%c",), ("é",)], "s string")
    assert df.where(pad_trim(F.col("s")) == "ab").count() == 2
    assert df.where(like_plain(F.col("s"), "a\\%c")).count() == 0
    assert df.where(like_bytes(F.col("s"), "__")).count() == 1


def test_not_in_with_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    inner = spark.createDataFrame([(1,), (None,)], "y int")
    assert rows(not_in_subquery(df, "x", inner)) == []
    assert rows(not_in_subquery(df, "x", inner, skip_nulls=True)) == [(2,)]
    assert not_in_subquery(df, "x", inner.where("false")).count() == 3


def test_scalar_subquery(picks):
    assert rows(compare_scalar(picks, "kilos", "=", picks.agg(F.max("kilos"))).select("id")) == [(23,)]
    assert compare_scalar(picks, "kilos", "=", picks.where("false").select("kilos")).count() == 0
    with pytest.raises(Exception, match="more than one row"):
        compare_scalar(picks, "kilos", "=", picks.select("kilos")).collect()


def test_changes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, v string")
    after, touched = changes.update_where(base, F.col("v") == "a", {"v": F.lit("z")})
    assert sorted(rows(after), key=str) == [(1, "z"), (2, "b"), (3, None)] and rows(touched) == [(1, "z")]
    kept, gone = changes.delete_where(base, F.col("v") == "a")
    assert kept.count() == 2 and rows(gone) == [(1, "a")]
    new = spark.createDataFrame([(2, "B", 1), (2, "BB", 2), (9, "n", 1)], "id long, v string, at int")
    assert sorted(rows(changes.upsert(base.withColumn("at", F.lit(0)), new, "id", "at")), key=str) == [(1, "a", 0), (2, "BB", 2), (3, None, 0), (9, "n", 1)]
    with pytest.raises(Exception, match="key exists"):
        changes.insert(base, base.limit(1), "id")[0].collect()
    assert [r.n for r in changes.numbered(base, "n", ["id"], 5).orderBy("id").collect()] == [5, 6, 7]


def test_snapshots(spark):
    v = spark.createDataFrame([(1, 1, "a", False), (1, 3, "b", False), (2, 2, "c", False), (2, 4, None, True)], "k long, at long, x string, gone boolean")
    assert sorted(rows(changes.snapshot(v, "k", "at", 3, "gone").select("k", "x"))) == [(1, "b"), (2, "c")]
    assert rows(changes.snapshot(v, "k", "at", 4, "gone").select("k")) == [(1,)]
    assert changes.collect_garbage(v, "k", "at", 3).count() == 3
    assert rows(changes.write_conflicts(v.where("at = 1"), v, "k", "at", 2)) == [(1,)]


def test_constraints(spark):
    child = spark.createDataFrame([(1, 10), (2, 11), (3, None), (4, 99), (4, 10)], "id long, ref long")
    parent = spark.createDataFrame([(10,), (11,)], "key long")
    t = TableDef("child", [FieldDef("id", Kind.parse("BIGINT"), False), FieldDef("ref", Kind.parse("BIGINT"))], "id", [("id",)], [("ref", "parent", "key", "cascade")], ["ref < 50"])
    found = {r["constraint"]: r.violations for r in constraints.validate(child, t, {"parent": parent}).collect()}
    assert found == {"not null id": 0, "unique id": 1, "check ref < 50": 1, "foreign ref -> parent.key": 1}
    gone = parent.where("key = 10")
    assert constraints.on_delete(child, "ref", gone, "key", "cascade").count() == 3
    assert constraints.on_delete(child, "ref", gone, "key", "set_default", 11).where("ref = 11").count() == 3
    with pytest.raises(Exception, match="still refers"):
        constraints.on_delete(child, "ref", gone, "key", "restrict").collect()


def test_programs(spark):
    df = spark.createDataFrame([(7, "abc"), (-7, None)], "x long, s string")
    out = df.select(*[compile_program(p, df).top.alias(f"c{i}") for i, p in enumerate([
        [("load", "x"), ("push", 2), "div"], [("load", "x"), ("push", 2), "mod"], [("load", "s"), "is_null"], [("load", "s"), ("push", "abc "), "ne"], [("load", "s"), ("push", "zzz"), "lt", "not"],
    ])])
    assert rows(out) == [(3, 1, False, False, False), (-3, -1, True, False, True)]
    with pytest.raises(Exception):
        df.select(compile_program([("load", "x"), ("push", 0), "div"], df).top).collect()


def test_digests(spark):
    df = spark.createDataFrame([("k", "message", 258, -1), (None, None, 0, 1)], "k string, m string, n long, i long")
    got = df.select(sha256(F.col("m")).alias("s"), hmac256(F.col("k"), F.col("m")).alias("h"), canonical(F.col("n"), "bigint").alias("n"), canonical(F.col("i"), "bigint").alias("i")).collect()
    assert bytes(got[0].s) == hashlib.sha256(b"message").digest() and bytes(got[0].h) == hmac.new(b"k", b"message", hashlib.sha256).digest()
    assert bytes(got[0].n) == (258).to_bytes(16, "little") and bytes(got[0].i) == (-1).to_bytes(16, "little", signed=True)
    assert bytes(got[1].s) == hashlib.sha256(b"").digest()
    keys = [b"", b"k" * 63, b"k" * 64, b"k" * 65, bytes(range(256))]
    more = spark.createDataFrame([(i, bytearray(k), bytearray(b"\x00m" * i)) for i, k in enumerate(keys)], "i int, k binary, m binary")
    got = {r.i: bytes(r.h) for r in more.select("i", hmac256(F.col("k"), F.col("m"), "binary", "binary").alias("h")).collect()}
    assert got == {i: hmac.new(k, b"\x00m" * i, hashlib.sha256).digest() for i, k in enumerate(keys)}


def test_kinds(spark):
    df = spark.createDataFrame([("255", "true", "abc")], "a string, b string, c string")
    ok = df.select(Kind.parse("U8").coerce(F.col("a"), "a"), Kind.parse("BOOL").coerce(F.col("b"), "b"), Kind.parse("VARCHAR(3)").coerce(F.col("c"), "c"))
    assert rows(ok) == [(255, True, "abc")]
    for kind, column in (("I8", "a"), ("U64", "b"), ("BOOL", "c"), ("CHAR(2)", "c")):
        with pytest.raises(Exception):
            df.select(Kind.parse(kind).coerce(F.col(column), column)).collect()
    t = TableDef("t", [FieldDef("a", Kind.parse("INT")), FieldDef("z", Kind.parse("BIGINT"), default=4)])
    assert rows(t.up_project(spark.createDataFrame([(1,)], "a int"))) == [(1, 4)]
    with pytest.raises(ValueError):
        Kind.parse("CHAR")


def test_engine(spark, picks):
    e = Engine(spark)
    e.register("picks", picks, TableDef("picks", [], "id"))
    assert rows(e.sql("SELECT * FROM picks ID 21")) == [(21, "dale", "pear", 7)]
    assert rows(e.sql("SELECT count(*) FROM picks WHERE orchard = $1 AND kilos > $2", ["hill", 5])) == [(2,)]
    assert rows(e.sql("SELECT count(*) FROM picks WHERE id = ANY (ARRAY[])")) == [(0,)]
    assert "Scan" in e.explain("SELECT id FROM picks") and e.catalog().count() == 4
    e.drop("picks")
    with pytest.raises(ValueError, match="no table picks"):
        e.sql("DELETE FROM picks WHERE true")


def test_text_in_literals_and_comments_stays(spark, picks):
    e = Engine(spark)
    e.register("picks", picks)
    got = e.sql("""SELECT "id", 'costs $1 "x" = ANY (ARRAY[2])' AS a, 'it''s \\n' AS b -- $2 'open
        FROM picks WHERE "id" = $1 AND orchard <> 'x' /* ' " $3 */;""", [21])
    assert rows(got) == [(21, 'costs $1 "x" = ANY (ARRAY[2])', "it's \\n")]
    assert rows(e.sql("SELECT count(*) AS n FROM picks WHERE fruit = ANY (ARRAY['plum', $1]) AND NOT id IN (11)", ["pear"])) == [(5,)]
    assert rows(e.sql("SELECT max(p.kilos) AS \"most \"\"kilos\"\"\" FROM picks p WHERE p.id >= 1.5e1")) == [(30,)]
    for bad in ("SELECT 'open", "SELECT 1; SELECT 2", 'SELECT "'):
        with pytest.raises(ValueError):
            e.sql(bad)


def test_statements(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE shelf (code INT PRIMARY KEY, room VARCHAR(8) NOT NULL, UNIQUE (room))")
    e.sql("CREATE TABLE jar (id INT PRIMARY KEY, nr SERIAL, shelf INT DEFAULT 2 REFERENCES shelf(code) ON DELETE CASCADE, label VARCHAR(20), CHECK (label <> 'bad'))")
    assert rows(e.sql("INSERT INTO shelf VALUES (1, 'attic'), (2, 'cellar'), (3, 'hall')")) == [(3,)]
    assert sorted(rows(e.sql("INSERT INTO jar (id, label) VALUES (5, 'o''hara'), (6, $1) RETURNING id, shelf, label", ["x; DROP TABLE jar"]))) == [(5, 2, "o'hara"), (6, 2, "x; DROP TABLE jar")]
    assert rows(e.sql("INSERT INTO jar (id, shelf, label) SELECT 7, 1, NULL RETURNING nr")) == [(3,)]
    refused = {
        "INSERT INTO jar (id) VALUES (7)": "key exists",
        "INSERT INTO shelf VALUES (4, 'hall')": "unique room",
        "INSERT INTO shelf (code) VALUES (4)": "not null room",
        "INSERT INTO jar (id, shelf) VALUES (8, 9)": "foreign shelf",
        "INSERT INTO jar (id, label) VALUES (8, 'bad')": "check",
        "INSERT INTO jar (id, colour) VALUES (8, 'red')": "no column colour",
        "INSERT INTO jar (id) VALUES (8, 9)": "2 values for 1",
        "UPDATE jar SET shelf = 9 WHERE id = 5": "foreign shelf",
        "UPDATE jar SET label = 'a'": "needs a WHERE",
        "DELETE FROM jar": "needs a WHERE",
        "ALTER TABLE jar DROP COLUMN id": "cannot go",
        "DROP TABLE shelf": "referred to",
        "CREATE UNIQUE INDEX u ON jar (shelf)": "not unique",
    }
    before = sorted(rows(e.tables["jar"]), key=str)
    for text, why in refused.items():
        with pytest.raises(Exception, match=why):
            e.sql(text)
    assert sorted(rows(e.tables["jar"]), key=str) == before and e.tables["shelf"].count() == 3
    assert rows(e.sql("UPDATE jar SET label = concat(label, '!'), shelf = 3 WHERE id = 5 RETURNING id, shelf, label")) == [(5, 3, "o'hara!")]
    assert sorted(rows(e.sql("DELETE FROM shelf WHERE code IN (1, 2) RETURNING *"))) == [(1, "attic"), (2, "cellar")]
    assert rows(e.sql("SELECT id, shelf FROM jar")) == [(5, 3)]  # the others went with their shelves
    assert sorted(r.kind for r in e.catalog_constraints().where("table_name = 'jar'").collect()) == ["check", "foreign key", "not null", "primary key"]
    e.sql("DROP TABLE jar")
    e.sql("DROP TABLE shelf")
    assert e.catalog().count() == 0


def test_delete_actions(spark):
    for action, left in (("SET NULL", [(5, None), (6, 3)]), ("SET DEFAULT", [(5, 3), (6, 3)]), ("RESTRICT", None), ("NO ACTION", None)):
        e = Engine(spark)
        e.sql("CREATE TABLE shelf (code INT PRIMARY KEY)")
        e.sql(f"CREATE TABLE jar (id INT PRIMARY KEY, shelf INT DEFAULT 3, FOREIGN KEY (shelf) REFERENCES shelf(code) ON DELETE {action})")
        e.sql("INSERT INTO shelf VALUES (2), (3)")
        e.sql("INSERT INTO jar VALUES (5, 2), (6, 3)")
        if left is None:
            with pytest.raises(ValueError, match="still refers"):
                e.sql("DELETE FROM shelf WHERE code = 2")
            assert e.tables["shelf"].count() == 2
        else:
            e.sql("DELETE FROM shelf WHERE code = 2")
            assert sorted(rows(e.tables["jar"])) == left
