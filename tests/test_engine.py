"""Statements, tables, loading and the edges of the engine."""

import csv
import io
import json
import math
import random
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from quadrille import cli
from quadrille.errors import BindError, DialectError, EngineError
from quadrille.functions import boxes
from quadrille.functions.points import minimum_distance, point
from quadrille.http import server
from quadrille.operators import relational as op
from quadrille.plans import dialect
from quadrille.render import rendered
from quadrille.session import Engine
from quadrille.sources import catalog
from quadrille.types import RID, ColumnSpec, TableSpec


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "tables"))


def rows(result):
    return [tuple(r) for r in result.collect()]


def last(engine, text):
    return rows(engine.run(text)[-1])


def fill(engine, name, columns, values):
    engine.run(f"CREATE TABLE {name} ({columns});" + "".join(f"INSERT INTO {name} VALUES {v};" for v in values))


def test_rows_in_order_equality_range_delete(engine):
    fill(engine, "clients", "id INT INDEX SEQUENTIAL, name VARCHAR(50), age INT", ["(1, 'Ana', 28)", "(3, 'Carlos', 35)", "(2, 'Beto', 22)"])
    assert sorted(last(engine, "SELECT * FROM CLIENTS")) == [(1, "Ana", 28), (2, "Beto", 22), (3, "Carlos", 35)]
    assert "Sort" not in engine.run("SELECT * FROM clients")[0]._jdf.queryExecution().toString()
    assert last(engine, "SELECT * FROM clients WHERE id = 2") == [(2, "Beto", 22)]
    assert len(last(engine, "SELECT * FROM clients WHERE id BETWEEN 1 AND 3")) == 3
    assert last(engine, "SELECT * FROM clients WHERE id BETWEEN 3 AND 1") == []
    assert sorted(last(engine, "SELECT * FROM clients WHERE name BETWEEN 'B' AND 'Cz'")) == [(2, "Beto", 22), (3, "Carlos", 35)]
    assert engine.run("DELETE FROM clients WHERE id = 2")[0].affected_rows == 1
    assert last(engine, "SELECT * FROM clients WHERE id = 2") == []
    engine.run("INSERT INTO clients VALUES (2, 'Beto again', 23)")
    assert last(engine, "SELECT name FROM clients WHERE id = 2") == [("Beto again",)]
    assert engine.catalog.read("clients", deleted=True).count() == 4 and engine.catalog.describe("clients")["next_rid"] == 4
    engine.catalog.compact("clients")
    assert engine.catalog.read("clients", deleted=True).count() == 3
    assert last(engine, "SELECT COUNT(*) FROM clients") == [(3,)]


def test_primary_keys_and_row_ids(engine):
    catalog = engine.catalog
    catalog.create(TableSpec("Clients", (ColumnSpec("id", "INT", hint="HASH", primary=True), ColumnSpec("name", "VARCHAR", 30), ColumnSpec("price", "INT"))))
    for v in (("1", "Ana", "100"), ("2", "Luis", "200"), ("3", "Ana", "300")):
        catalog.insert("clients", [("STRING", x) for x in v])
    assert rows(catalog.read_row("clients", 1).drop(RID)) == [(2, "Luis", 200)]
    assert len(last(engine, "SELECT * FROM clients WHERE price BETWEEN 150 AND 350")) == 2
    with pytest.raises(BindError):
        engine.run("INSERT INTO clients VALUES (2, 'again', 1)")
    assert engine.run("DELETE FROM clients WHERE name = 'Ana'")[0].affected_rows == 2
    assert last(engine, "SELECT * FROM clients") == [(2, "Luis", 200)]
    with pytest.raises(BindError):
        catalog.read_row("clients", 0)


@pytest.mark.parametrize("hints", [("", "", ""), ("INDEX BTREE", "INDEX SEQUENTIAL", "INDEX HASH")])
def test_equal_keys_are_all_found(engine, hints):
    a, b, c = hints
    fill(engine, "sales", f"id INT, price INT {a}, rank INT {b}, code INT {c}", ["(1,10,7,5)", "(2,10,7,5)"])
    for where in ("price = 10", "rank = 7", "code = 5"):
        assert len(last(engine, f"SELECT * FROM sales WHERE {where}")) == 2


def test_join(engine):
    fill(engine, "clients", "id INT, name VARCHAR(30)", ["(1,'Ana')", "(2,'Luis')"])
    fill(engine, "orders", "id INT, client_id INT, total INT", ["(10,1,300)", "(11,1,450)", "(12,3,999)"])
    for on in ("clients.id = orders.client_id", "orders.client_id = clients.id", "clients.id = client_id"):
        out = engine.run(f"SELECT * FROM clients JOIN orders ON {on}")[0]
        assert out.columns == ["clients.id", "clients.name", "orders.id", "orders.client_id", "orders.total"]
        assert sorted(rows(out)) == [(1, "Ana", 10, 1, 300), (1, "Ana", 11, 1, 450)]
    assert last(engine, "SELECT * FROM clients JOIN orders ON clients.id = client_id WHERE total = 450") == [(1, "Ana", 11, 1, 450)]
    assert [r[4] for r in last(engine, "SELECT * FROM clients JOIN orders ON clients.id = client_id ORDER BY total DESC")] == [450, 300]
    assert last(engine, "SELECT name, COUNT(*) FROM clients JOIN orders ON clients.id = client_id GROUP BY name") == [("Ana", 2)]
    for bad in ("id = client_id", "clients.id = clients.id", "clients.id = nothing", "clients.name = orders.total", "other.id = client_id"):
        with pytest.raises(BindError):
            engine.run(f"SELECT * FROM clients JOIN orders ON {bad}")[0].collect()
    with pytest.raises(BindError):
        engine.run("SELECT * FROM clients JOIN clients ON clients.id = clients.id")


def test_groups(engine):
    fill(engine, "sales", "id INT, kind VARCHAR(30), amount INT", ["(1,'A',100)", "(2,'B',200)", "(3,'A',150)", "(4,'C',300)", "(5,'B',120)", "(6,'A',80)"])
    assert dict(last(engine, "SELECT kind, COUNT(*) FROM sales GROUP BY kind")) == {"A": 3, "B": 2, "C": 1}
    assert dict(last(engine, "SELECT * FROM sales GROUP BY kind")) == {"A": 3, "B": 2, "C": 1}
    assert last(engine, "SELECT kind, COUNT(*) FROM sales WHERE amount BETWEEN 100 AND 200 ORDER BY kind DESC GROUP BY kind") == [("B", 2), ("A", 2)]
    assert last(engine, "SELECT kind, COUNT(*) FROM sales GROUP BY kind ORDER BY kind") == [("A", 3), ("B", 2), ("C", 1)]
    with pytest.raises(BindError):
        engine.run("SELECT kind, COUNT(*) FROM sales GROUP BY nothing")


def test_points(engine):
    fill(engine, "places", "name VARCHAR(50), at POINT INDEX RTREE", ["('Miraflores', POINT(-77.03, -12.04))", "('Barranco', POINT(-77.05, -12.07))", "('La Molina', POINT(-76.90, -11.90))"])
    assert sorted(r[0] for r in last(engine, "SELECT * FROM places WHERE at IN (POINT(-77.03, -12.04), RADIUS 0.05)")) == ["Barranco", "Miraflores"]
    out = engine.run("SELECT * FROM places WHERE at IN (POINT(-77.03, -12.04), K 2)")[0]
    assert [(r["name"], r["_distance"]) for r in out.collect()] == [("Miraflores", 0.0), ("Barranco", 0.0361)]
    assert len(last(engine, "SELECT * FROM places WHERE at IN (POINT(0, 0), K 9)")) == 3
    assert last(engine, "SELECT * FROM places WHERE at IN (POINT(0, 0), K 0)") == []
    assert last(engine, "SELECT name FROM places WHERE at = POINT(-77.05, -12.07)") == [("Barranco",)]
    assert [r[0] for r in last(engine, "SELECT name FROM places ORDER BY at")] == ["Barranco", "Miraflores", "La Molina"]
    assert last(engine, "SELECT name FROM places WHERE at BETWEEN POINT(-77.04, 0) AND POINT(-77, 0)") == [("Miraflores",)]
    assert rendered(engine.run("SELECT at FROM places WHERE name = 'Barranco'")[0]) == [{"at": {"type": "POINT", "x": -77.05, "y": -12.07}}]
    for bad in ("name IN (POINT(0,0), K 1)", "at IN (POINT(0,0), K -1)", "at IN (POINT(0,0), RADIUS -1)", "at = 5"):
        with pytest.raises(BindError):
            engine.run(f"SELECT * FROM places WHERE {bad}")


def test_radius_and_nearest_against_brute_force(spark):
    r = random.Random(3)
    points = [(k, round(r.uniform(-5, 5), 1), round(r.uniform(-5, 5), 1)) for k in range(400)] + [(400 + k, 3 * math.cos(k), 3 * math.sin(k)) for k in range(30)]
    df = spark.createDataFrame(points, "id long, x double, y double").select("id", point(F.col("x"), F.col("y")).alias("p"))
    far = lambda x, y, a, b: math.sqrt((x - a) * (x - a) + (y - b) * (y - b))
    for a, b, radius, k in ((0, 0, 3, 7), (1.5, -2, 0.5, 50), (0.1, 0.1, 0, 1)):
        assert {x.id for x in op.within_radius(df, "p", a, b, radius).collect()} == {i for i, x, y in points if far(x, y, a, b) <= radius}
        got = [x.id for x in op.nearest(df, "p", a, b, k, ["id"]).collect()]
        assert got == [i for _, i in sorted((far(x, y, a, b), i) for i, x, y in points)[:k]]
    low, high = [F.lit(v) for v in (1.0, 1.0)], [F.lit(v) for v in (2.0, 2.0)]
    assert spark.range(1).select(minimum_distance(0, 1.5, *low, *high)).first()[0] == 1.0


def test_boxes(spark):
    a, b, far = boxes.box(0, 0, 2, 2), boxes.box(1, 1, 3, 2), boxes.box(5, 5, 6, 6)
    got = spark.range(1).select(
        boxes.area(a), boxes.enlargement(a, b), boxes.intersects(a, b), boxes.intersects(a, far), boxes.contains(boxes.merged(a, far), b), boxes.contains(a, b), boxes.meets_circle(far, 4, 5, 1), boxes.meets_circle(far, 4, 4, 1.4)
    ).first()
    assert tuple(got) == (4.0, 2.0, True, False, True, False, True, False)
    points = spark.createDataFrame([(1.0, 5.0), (-2.0, 7.0)], "x double, y double").select(point(F.col("x"), F.col("y")).alias("p"))
    assert tuple(boxes.bounds(points, "p").first()[0]) == (-2.0, 5.0, 1.0, 7.0) and boxes.bounds(points.limit(0), "p").first()[0] is None
    assert boxes.contains(boxes.box_around(F.col("p")), boxes.box_around(F.col("p"))) is not None


def test_order_is_stable_and_numeric_layouts_dont_matter(engine):
    fill(engine, "t", "a INT, b FLOAT, c VARCHAR(10)", ["(0, 0.0, '')", "(2, 1.5, 'é')", "(1, -3.25, 'z')", "(2, 9.0, 'a')", "(0, 0.0, '')"])
    assert [r[0] for r in last(engine, "SELECT a FROM t ORDER BY a")] == [0, 0, 1, 2, 2]
    assert [r[1] for r in last(engine, "SELECT * FROM t ORDER BY a DESC")] == [9.0, 1.5, -3.25, 0.0, 0.0]
    assert [r[0] for r in last(engine, "SELECT c FROM t ORDER BY c")] == ["", "", "a", "z", "é"]
    assert len(last(engine, "SELECT * FROM t ORDER BY b; --replacement")) == 5


CSV = """id;name;price;lat;Long;extra
1; Ana ;100;40.5;-73.9;x
;;;;;
2;Luis;abc;1;2;x
3;Short
4;More;7;1.25;2.5;x;y;z
1;Again;5;1;1;x
5;NoLat;9;;3;x
6;Ñandú;12;7;8;x
"""


def test_load_reports_bad_rows(engine, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(CSV, encoding="utf-8")
    spec = TableSpec("listings", (ColumnSpec("id", "INT", primary=True), ColumnSpec("name", "VARCHAR", 6), ColumnSpec("price", "INT", hint="BTREE"), ColumnSpec("location", "POINT", hint="RTREE")))
    told = engine.catalog.create(spec, str(path))
    assert (told.inserted, told.skipped, len(told.errors)) == (3, 4, 4)
    assert sorted(last(engine, "SELECT id, name, location FROM listings")) == [(1, "Ana", (40.5, -73.9)), (4, "More", (1.25, 2.5)), (6, "Ñand", (7.0, 8.0))]
    again = engine.catalog.load("listings", str(path))
    assert (again.inserted, again.skipped) == (0, 7)
    assert engine.catalog.create(spec, str(path), max_rows=2).inserted == 2
    with pytest.raises(EngineError):
        engine.run("CREATE TABLE listings (id INT) FROM FILE '/nowhere/at/all.csv'")
    assert last(engine, "SELECT COUNT(*) FROM listings") == [(2,)]


def test_quoted_cells(engine, tmp_path):
    """Doubled quotes, delimiters and line ends in quotes, as Python's csv module reads them."""
    text = 'id;name;n\n1;"He said ""hi""";5\n2;"a;b";6\n3;"two\nlines";7\n4;"short;one"\n5;5" pipe;8\n6;"";9\n'
    path = tmp_path / "q.csv"
    for body in (text, text.replace('"two\nlines"', "two")):
        path.write_text(body, encoding="utf-8")
        want = [(int(r[0]), r[1], int(r[2])) for r in csv.reader(io.StringIO(body), delimiter=";") if len(r) == 3 and r[0] != "id"]
        told = engine.catalog.create(TableSpec("q", (ColumnSpec("id", "INT", primary=True), ColumnSpec("name", "VARCHAR", 40), ColumnSpec("n", "INT"))), str(path))
        assert sorted(last(engine, "SELECT * FROM q")) == want and (told.inserted, told.skipped) == (5, 1)


def test_many_inserts_and_deletes(engine, monkeypatch):
    monkeypatch.setattr(catalog, "MOST_SMALL", 3)
    monkeypatch.setattr(catalog, "MOST_DELETIONS", 2)
    fill(engine, "t", "id INT", [f"({k})" for k in range(7)])
    assert len(engine.catalog.describe("t")["parts"]) == 3 and sorted(last(engine, "SELECT * FROM t")) == [(k,) for k in range(7)]
    engine.run("DELETE FROM t WHERE id = 1; INSERT INTO t VALUES (1); DELETE FROM t WHERE id = 2;")
    assert engine.catalog.describe("t")["deleted"] == [] and sorted(last(engine, "SELECT * FROM t")) == [(0,), (1,), (3,), (4,), (5,), (6,)]


def test_one_writer_publishes_a_version(engine):
    fill(engine, "t", "id INT", ["(1)"])
    manifest = engine.catalog.describe("t")
    mine = manifest | {"version": manifest["version"] + 1}
    fs = engine.catalog._fs(engine.catalog._path("t"))
    assert engine.catalog._claimed(fs, engine.catalog._path("t", f".claim-{mine['version']}"))  # another writer is about to publish
    with pytest.raises(EngineError):
        engine.catalog._publish("t", mine)
    assert engine.catalog.describe("t") == manifest


def test_kinds(engine, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("b;f;p\nYES;1.23456789;POINT(1.00000049, 2)\nverified;x;3,4\nmaybe;2;3,4\n;1;1,1\n", encoding="utf-8")
    engine.run(f"CREATE TABLE k (b BOOL, f FLOAT, p POINT) FROM FILE '{path}'")
    assert sorted(last(engine, "SELECT * FROM k"), reverse=True) == [(True, 1.234568, (1.0, 2.0)), (False, 2.0, (3.0, 4.0))]
    assert len(last(engine, "SELECT * FROM k WHERE b = TRUE")) == 1
    assert len(last(engine, "SELECT * FROM k WHERE b = 0")) == 1
    for bad in ("(1, 'x', POINT(1,1))", "(TRUE, 1.0)", "(TRUE, 1.0, 7)"):
        with pytest.raises(BindError):
            engine.run(f"INSERT INTO k VALUES {bad}")
    fill(engine, "n", "i INT", ["(2147483647)", "(-2147483648)"])
    with pytest.raises(BindError):
        engine.run("INSERT INTO n VALUES (2147483648)")


@pytest.mark.parametrize("text", ["CREATE TABLE t (a INT, a INT)", "CREATE TABLE t (a VARCHAR(0))", "CREATE TABLE t (p POINT INDEX BTREE)", "CREATE TABLE t (a INT INDEX RTREE)", "CREATE TABLE t (a DATE)", "CREATE TABLE t (a INT PRIMARY KEY, b INT PRIMARY KEY)"])
def test_wrong_tables(text):
    with pytest.raises(BindError):
        dialect.parse(text)


@pytest.mark.parametrize("text", ["SELECT", "SELECT * FROM t WHERE", "SELECT * FROM t WHERE a IN (1, 2)", "UPDATE t", "INSERT INTO t VALUES ()", "SELECT * FROM t WHERE a = 'open", "SELECT * FROM t extra", "SELECT * FROM t WHERE p IN (POINT(1,2), K 1.5)"])
def test_wrong_text(text):
    with pytest.raises(DialectError):
        dialect.parse(text)


def test_parsing():
    s = dialect.parse("-- note\nselect a, t.b FROM t WHERE k = 'it''s' ORDER BY a DESC;\nSELECT * FROM count WHERE point BETWEEN -1 AND 2.5")
    assert s[0].columns == (dialect.Ref("a"), dialect.Ref("b", "t")) and s[0].descending and s[0].where.value.value == "it's"
    assert s[1].table == "count" and s[1].where.high.value == 2.5
    assert dialect.parse("") == [] and dialect.parse(";;") == []


def test_nothing_runs_if_the_text_is_wrong(engine):
    with pytest.raises(DialectError):
        engine.run("CREATE TABLE t (a INT); nonsense")
    assert engine.catalog.tables() == []
    with pytest.raises(BindError):
        engine.run("SELECT * FROM missing")


def test_readers_see_whole_versions(engine):
    fill(engine, "t", "id INT, v VARCHAR(50)", ["(0, 'x')"])
    seen, done = [], threading.Event()

    def read():
        while not done.is_set():
            seen.append(engine.catalog.read("t").count())

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 8):
        engine.run(f"INSERT INTO t VALUES ({k}, 'x')")
    done.set()
    reader.join()
    assert seen == sorted(seen) and engine.catalog.read("t").count() == 8


def test_pushdown_and_join_plans(spark, engine):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    plan = op.project(op.filter_range(part, "p_retailprice", 950.0, 960.0), ["p_partkey"])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(p_retailprice" in plan and "p_name" not in plan.split("ReadSchema")[1]
    fill(engine, "places", "id INT, at POINT", ["(1, POINT(1, 2))"])
    plan = op.within_radius(engine.catalog.read("places"), "at", 0, 0, 5)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(at.x" in plan
    knn = op.nearest(engine.catalog.read("places"), "at", 0, 0, 5)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in knn


def test_cli_and_http(engine, capsys, tmp_path):
    assert cli.run_text(engine, "CREATE TABLE t (n VARCHAR(9)); INSERT INTO t VALUES ('ñ'); SELECT * FROM t") == 0
    assert '"n": "ñ"' in capsys.readouterr().out
    assert cli.run_text(engine, "SELECT * FROM nothing") == 1
    cli.repl(engine, iter(["SELECT *\n", "FROM t;\n", "exit\n", "SELECT * FROM nothing;\n"]))
    assert '"n": "ñ"' in capsys.readouterr().out
    path = tmp_path / "q.sql"
    path.write_text("SELECT * FROM t;")
    assert cli.main(["--parse", str(path)]) == 0
    http = server(engine, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_port}"
    ask = lambda sql: urllib.request.urlopen(urllib.request.Request(f"{base}/query", json.dumps({"sql": sql}).encode()))
    assert json.load(ask("SELECT * FROM t"))["results"] == [[{"n": "ñ"}]]
    assert json.load(urllib.request.urlopen(f"{base}/stats"))["statements"] == 1
    with pytest.raises(urllib.error.HTTPError):
        ask("nonsense")
    http.shutdown()
