"""The registered queries of the engine's own operators, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import boxes
from quadrille.functions.convert import parse_cell
from quadrille.functions.points import point
from quadrille.operators import relational as op
from quadrille.scratch import scratch_dir
from quadrille.session import Engine
from quadrille.sources import delimited
from quadrille.types import RID, ColumnSpec, TableSpec


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as points of size and price."""
    return _table(spark, sf_dir, "part").select("p_partkey", point(F.col("p_size"), F.col("p_retailprice")).alias("p"))


def _flat(df: DataFrame, *rest: str) -> DataFrame:
    return df.select("p_partkey", F.col("p.x").alias("x"), F.col("p.y").alias("y"), *rest)


def _joined(spark: SparkSession, sf_dir: str, turned: bool = False) -> DataFrame:
    customer, orders = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    if turned:
        return op.equi_join(orders, customer, "o_custkey", "c_custkey", "orders", "customer", "_")
    return op.equi_join(customer, orders, "c_custkey", "o_custkey", "customer", "orders", "_")


def filter_equal_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    return op.project(op.filter_equal(rows, "returned", True), ["l_orderkey", "l_partkey", "l_linenumber", "returned"])


def spatial_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", point(F.col("embedding")[0], F.col("embedding")[1]).alias("p"))
    return op.nearest(rows, "p", 0, 0, 10, ["vec_id"]).select("vec_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "_distance")


def join_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.group_count(_joined(spark, sf_dir), "customer_c_mktsegment", "cnt")


def csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/nation-{uuid.uuid4().hex}.csv"
    _table(spark, sf_dir, "nation").coalesce(1).write.csv(path, sep=";", header=True)
    spec = TableSpec("nation", (ColumnSpec("n_nationkey", "INT", primary=True), ColumnSpec("n_name", "VARCHAR", 25), ColumnSpec("n_regionkey", "INT")))
    good, _ = delimited.load(spark, spec, path)
    return good.drop(RID)


def dialect_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of the dialect from creation to a grouped count."""
    path = f"{scratch_dir(spark)}/supplier-{uuid.uuid4().hex}.csv"
    _table(spark, sf_dir, "supplier").coalesce(1).write.csv(path, sep=";", header=True)
    engine = Engine(spark, f"{scratch_dir(spark)}/tables-{uuid.uuid4().hex}")
    *_, out = engine.run(
        f"""CREATE TABLE s (s_suppkey INT INDEX HASH, s_name VARCHAR(40), s_nationkey INT INDEX BTREE, s_acctbal FLOAT) FROM FILE '{path}';
            INSERT INTO s VALUES (0, 'one more', 3, 12.5);
            DELETE FROM s WHERE s_nationkey = 7;
            SELECT s_nationkey, COUNT(*) FROM s WHERE s_nationkey BETWEEN 2 AND 12 GROUP BY s_nationkey ORDER BY s_nationkey;"""
    )
    return out.withColumnRenamed("COUNT(*)", "cnt")


def _file(rows: DataFrame, label: str) -> str:
    """A delimited file of the rows, written in the shared folder by one task, as the tables here are small."""
    path = f"{scratch_dir(rows.sparkSession)}/{label}-{uuid.uuid4().hex}.csv"
    rows.coalesce(1).write.csv(path, sep=";", header=True, escape='"')
    return path


def _ask(spark: SparkSession, *statements: str) -> tuple[Engine, list]:
    engine = Engine(spark, f"{scratch_dir(spark)}/tables-{uuid.uuid4().hex}")
    return engine, engine.run(";".join(statements))


def _supplier(spark: SparkSession, sf_dir: str, key: str = "", nation: str = "") -> str:
    path = _file(_table(spark, sf_dir, "supplier"), "supplier")
    return f"CREATE TABLE s (s_suppkey INT {key}, s_name VARCHAR(40), s_nationkey INT {nation}, s_acctbal FLOAT) FROM FILE '{path}'"


def _places(spark: SparkSession, sf_dir: str, hint: str = "") -> str:
    """Parts as places: the file has no column at, which is made of lat and long."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("lat"), F.col("p_retailprice").alias("Long"))
    return f"CREATE TABLE places (id INT, at POINT {hint}) FROM FILE '{_file(part, 'places')}'"


def _placed(df: DataFrame, *rest: str) -> DataFrame:
    return df.select("id", F.col("at.x").alias("x"), F.col("at.y").alias("y"), *rest)


def _dialect(*statements, names: dict[str, str] | None = None, flat: tuple[str, ...] | None = None):
    """A query that runs statements, made from (spark, sf_dir), and returns the last one's rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, (*_, out) = _ask(spark, *[s(spark, sf_dir) if callable(s) else s for s in statements])
        out = _placed(out, *flat) if flat is not None else out
        return out.select(*[F.col(f"`{c}`").alias((names or {}).get(c, c).replace(".", "_")) for c in out.columns])

    return run


def scan_with_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _ = _ask(spark, _supplier(spark, sf_dir), "DELETE FROM s WHERE s_nationkey = 7")
    return engine.catalog.read("s", deleted=True).drop(RID)


def slot_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows ever given an id, and rows that are there."""
    engine, _ = _ask(spark, _supplier(spark, sf_dir), "INSERT INTO s VALUES (0, 'one more', 3, 12.5)", "DELETE FROM s WHERE s_nationkey = 7")
    return op.count_rows(engine.catalog.read("s"), "live").withColumn("slots", F.lit(engine.catalog.describe("s")["next_rid"]).cast("long"))


def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load of a file in which keys repeat and some cells don't fit."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 10 == 0, F.lit("none")).otherwise(F.col("o_orderkey").cast("string")).alias("n"))
    engine = Engine(spark, f"{scratch_dir(spark)}/tables-{uuid.uuid4().hex}")
    told = engine.catalog.create(TableSpec("t", (ColumnSpec("id", "INT", primary=True), ColumnSpec("n", "INT"))), _file(rows, "orders"))
    return spark.createDataFrame([(told.inserted, told.skipped, len(told.errors))], "inserted long, skipped long, shown long")


def csv_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with quotes, delimiters and line ends."""
    name = F.concat(F.lit('a "'), "n_name", F.lit('"; b\nnext'))
    spec = TableSpec("nation", (ColumnSpec("n_nationkey", "INT", primary=True), ColumnSpec("label", "VARCHAR", 60)))
    good, _ = delimited.load(spark, spec, _file(_table(spark, sf_dir, "nation").select("n_nationkey", name.alias("label")), "quoted"))
    return good.drop(RID)


def convert_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as cells of each kind."""
    kinds = [("i", "INT", 0), ("f", "FLOAT", 0), ("v", "VARCHAR", 5), ("b", "BOOL", 0)]
    texts = _table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("text"))
    texts = texts.withColumn("text", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), "text", F.lit(" "))).otherwise(F.lit("1.25")))
    return texts.select("event_id", *[parse_cell(F.col("text"), ColumnSpec(n, kind, size)).alias(n) for n, kind, size in kinds])


def box_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order a box, and how it lies to another box and to a circle."""
    one = boxes.box(F.col("o_custkey").cast("double"), F.lit(0.0), F.col("o_custkey") + F.lit(10.0), F.lit(4.0))
    other = boxes.box(100, 2, 200, 8)
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        boxes.area(one).alias("area"),
        boxes.area(boxes.merged(one, other)).alias("merged_area"),
        boxes.enlargement(one, other).alias("enlargement"),
        boxes.intersects(one, other).alias("crosses"),
        boxes.contains(boxes.box(100, 0, 500, 9), one).alias("inside"),
        boxes.meets_circle(one, 300, 6, 50).alias("near"),
    )


def box_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.bounds(_parts(spark, sf_dir), "p").select("box.*")


_ORDER_COLUMNS = ["o_orderkey", "o_totalprice"]

QUERIES = {
    "scan_all": lambda s, d: op.scan(_table(s, d, "nation")),
    "read_by_id": lambda s, d: op.read_row(_table(s, d, "orders"), "o_orderkey", 7),
    "project_cols": lambda s, d: op.project(_table(s, d, "nation"), ["n_name", "n_regionkey"]),
    "count_all": lambda s, d: op.count_rows(_table(s, d, "orders"), "cnt"),
    "filter_equal_int": lambda s, d: op.filter_equal(_table(s, d, "orders"), "o_custkey", 42),
    "filter_equal_str": lambda s, d: op.filter_equal(_table(s, d, "customer"), "c_mktsegment", "BUILDING"),
    "filter_equal_bool": filter_equal_bool,
    "filter_equal_point": lambda s, d: _flat(op.filter_equal(_parts(s, d), "p", (2, 981.2))),
    "filter_range_num": lambda s, d: op.filter_range(_table(s, d, "part"), "p_retailprice", 950.0, 960.0),
    "filter_range_str": lambda s, d: op.filter_range(_table(s, d, "supplier"), "s_name", "Supplier#000000010", "Supplier#000000020"),
    "filter_range_point": lambda s, d: _flat(op.filter_range(_parts(s, d), "p", point(10, 950), point(12, 920))),
    "spatial_radius": lambda s, d: _flat(op.within_radius(_parts(s, d), "p", 25, 1000, 50)),
    "spatial_knn": spatial_knn,
    "equi_join": _joined,
    "join_reversed_on": lambda s, d: _joined(s, d, True),
    "join_with_filter": lambda s, d: op.filter_equal(_joined(s, d), "customer_c_mktsegment", "BUILDING"),
    "join_group": join_group,
    "group_count": lambda s, d: op.group_count(_table(s, d, "events"), "event_type", "cnt"),
    "filter_group_count": lambda s, d: op.group_count(op.filter_range(_table(s, d, "orders"), "o_totalprice", 1000.0, 100000.0), "o_orderpriority", "cnt"),
    "group_point": lambda s, d: op.group_count(_parts(s, d), "p", "cnt").select(F.col("p.x").alias("x"), F.col("p.y").alias("y"), "cnt"),
    "order_asc": lambda s, d: op.ranked(op.project(_table(s, d, "orders"), _ORDER_COLUMNS), "o_totalprice", False, ["o_orderkey"]),
    "order_desc": lambda s, d: op.ranked(op.project(_table(s, d, "orders"), _ORDER_COLUMNS), "o_totalprice", True, ["o_orderkey"]),
    "order_by_point_x": lambda s, d: _flat(op.ranked(_parts(s, d), "p", False, ["p_partkey"]), "rank"),
    "delete_equal": lambda s, d: op.without_equal(_table(s, d, "orders"), "o_orderstatus", "F"),
    "insert_row": lambda s, d: op.with_row(_table(s, d, "nation"), [99, "ATLANTIS", 3]),
    "csv_ingest": csv_ingest,
    "dialect_session": dialect_session,
    "scan_with_deleted": scan_with_deleted,
    "slot_count": slot_count,
    "load_report": load_report,
    "csv_quoted": csv_quoted,
    "csv_points": _dialect(_places, "SELECT * FROM places", flat=()),
    "convert_cells": convert_cells,
    "box_algebra": box_algebra,
    "box_bounds": box_bounds,
    "ordered_scan": lambda s, d: op.scan(_table(s, d, "part"), "p_retailprice"),
    "index_sequential": _dialect(lambda s, d: _supplier(s, d, "INDEX SEQUENTIAL"), "INSERT INTO s VALUES (15, 'one more', 3, 12.5)", "SELECT * FROM s WHERE s_suppkey BETWEEN 10 AND 20"),
    "index_hash": _dialect(lambda s, d: _supplier(s, d, "INDEX HASH"), "INSERT INTO s VALUES (15, 'one more', 3, 12.5)", "SELECT * FROM s WHERE s_suppkey = 15"),
    "index_btree": _dialect(lambda s, d: _supplier(s, d, "", "INDEX BTREE"), "SELECT * FROM s WHERE s_nationkey BETWEEN 4 AND 6"),
    "index_rtree": _dialect(lambda s, d: _places(s, d, "INDEX RTREE"), "SELECT * FROM places WHERE at IN (POINT(25, 1000), RADIUS 50)", flat=()),
    "index_delete": _dialect(lambda s, d: _supplier(s, d, "", "INDEX BTREE"), "DELETE FROM s WHERE s_nationkey = 7", "SELECT * FROM s"),
    "dialect_nearest": _dialect(lambda s, d: _places(s, d, "INDEX RTREE"), "SELECT * FROM places WHERE at IN (POINT(25, 1000), K 7)", flat=("_distance",)),
    "dialect_project": _dialect(_supplier, "SELECT s_name, s_nationkey FROM s WHERE s_name = 'Supplier#000000010'"),
    "dialect_count": _dialect(_supplier, "SELECT COUNT(*) FROM s WHERE s_nationkey = 7", names={"COUNT(*)": "cnt"}),
    "dialect_order": _dialect(_supplier, "SELECT s_suppkey, s_acctbal FROM s ORDER BY s_acctbal DESC --replacement"),
    "dialect_join": _dialect(_supplier, lambda s, d: f"CREATE TABLE n (n_nationkey INT INDEX HASH, n_name VARCHAR(25)) FROM FILE '{_file(_table(s, d, 'nation'), 'nation')}'", "SELECT * FROM s JOIN n ON n.n_nationkey = s.s_nationkey WHERE s_nationkey BETWEEN 3 AND 9"),
    "dialect_join_group": _dialect(_supplier, lambda s, d: f"CREATE TABLE n (n_nationkey INT INDEX HASH, n_name VARCHAR(25)) FROM FILE '{_file(_table(s, d, 'nation'), 'nation')}'", "SELECT n_name, COUNT(*) FROM s JOIN n ON s.s_nationkey = n.n_nationkey GROUP BY n_name", names={"COUNT(*)": "cnt", "n.n_name": "n_name"}),
}

_JOINED = """
    SELECT c_custkey AS customer_c_custkey, c_name AS customer_c_name, c_nationkey AS customer_c_nationkey,
           c_acctbal AS customer_c_acctbal, c_mktsegment AS customer_c_mktsegment, o_orderkey AS orders_o_orderkey,
           o_custkey AS orders_o_custkey, o_orderstatus AS orders_o_orderstatus, o_totalprice AS orders_o_totalprice,
           o_orderdate AS orders_o_orderdate, o_orderpriority AS orders_o_orderpriority
    FROM customer JOIN orders ON c_custkey = o_custkey
"""
_SUPPLIER = "(SELECT s_suppkey::INT AS s_suppkey, s_name, s_nationkey, round(s_acctbal, 6) AS s_acctbal FROM supplier)"
_PLACES = "(SELECT p_partkey::INT AS id, p_size::DOUBLE AS x, round(p_retailprice, 6) AS y FROM part)"
_PARTS = "(SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y FROM part)"

ORACLE_SQL = {
    "scan_all": "SELECT * FROM nation",
    "read_by_id": "SELECT * FROM orders WHERE o_orderkey = 7",
    "project_cols": "SELECT n_name, n_regionkey FROM nation",
    "count_all": "SELECT count(*) AS cnt FROM orders",
    "filter_equal_int": "SELECT * FROM orders WHERE o_custkey = 42",
    "filter_equal_str": "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'",
    "filter_equal_bool": "SELECT l_orderkey, l_partkey, l_linenumber, true AS returned FROM lineitem WHERE l_returnflag = 'R'",
    "filter_equal_point": f"SELECT * FROM {_PARTS} WHERE x = 2 AND y = 981.2",
    "filter_range_num": "SELECT * FROM part WHERE p_retailprice BETWEEN 950 AND 960",
    "filter_range_str": "SELECT * FROM supplier WHERE s_name BETWEEN 'Supplier#000000010' AND 'Supplier#000000020'",
    "filter_range_point": f"SELECT * FROM {_PARTS} WHERE (x > 10 OR (x = 10 AND y >= 950)) AND (x < 12 OR (x = 12 AND y <= 920))",
    "spatial_radius": f"SELECT * FROM {_PARTS} WHERE sqrt((x - 25) * (x - 25) + (y - 1000) * (y - 1000)) <= 50",
    "spatial_knn": """
        WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
        d AS (SELECT *, sqrt(x * x + y * y) AS far FROM e ORDER BY far, vec_id LIMIT 10)
        SELECT vec_id, x, y, round(far, 4) AS _distance FROM d
    """,
    "equi_join": _JOINED,
    "join_reversed_on": _JOINED,
    "join_with_filter": f"{_JOINED} WHERE c_mktsegment = 'BUILDING'",
    "join_group": "SELECT c_mktsegment AS customer_c_mktsegment, count(*) AS cnt FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "group_count": "SELECT event_type, count(*) AS cnt FROM events GROUP BY event_type",
    "filter_group_count": "SELECT o_orderpriority, count(*) AS cnt FROM orders WHERE o_totalprice BETWEEN 1000 AND 100000 GROUP BY o_orderpriority",
    "group_point": f"SELECT x, y, count(*) AS cnt FROM {_PARTS} GROUP BY x, y",
    "order_asc": "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders",
    "order_desc": "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS rank FROM orders",
    "order_by_point_x": f"SELECT p_partkey, x, y, row_number() OVER (ORDER BY x, p_partkey) AS rank FROM {_PARTS}",
    "delete_equal": "SELECT * FROM orders WHERE NOT (o_orderstatus = 'F')",
    "insert_row": "SELECT * FROM nation UNION ALL SELECT 99, 'ATLANTIS', 3",
    "csv_ingest": "SELECT * FROM nation",
    "dialect_session": """
        WITH s AS (SELECT s_nationkey FROM supplier UNION ALL SELECT 3)
        SELECT s_nationkey, count(*) AS cnt FROM s WHERE s_nationkey <> 7 AND s_nationkey BETWEEN 2 AND 12 GROUP BY s_nationkey
    """,
    "scan_with_deleted": f"SELECT * FROM {_SUPPLIER}",
    "slot_count": "SELECT 1 + count(*) FILTER (s_nationkey <> 7) AS live, 1 + count(*) AS slots FROM supplier",
    "load_report": """
        SELECT count(DISTINCT o_custkey) FILTER (o_orderkey % 10 <> 0) AS inserted,
               count(*) - count(DISTINCT o_custkey) FILTER (o_orderkey % 10 <> 0) AS skipped,
               least(5, count(*) - count(DISTINCT o_custkey) FILTER (o_orderkey % 10 <> 0)) AS shown
        FROM orders
    """,
    "csv_quoted": "SELECT n_nationkey, 'a \"' || n_name || '\"; b' || chr(10) || 'next' AS label FROM nation",
    "csv_points": f"SELECT * FROM {_PLACES}",
    "convert_cells": """
        WITH t AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN user_id::VARCHAR ELSE '1.25' END AS text FROM events)
        SELECT event_id, CASE WHEN regexp_full_match(text, '[0-9]+') THEN TRY_CAST(text AS INT) END AS i, TRY_CAST(text AS DOUBLE) AS f, left(text, 5) AS v,
               lower(text) IN ('true', '1', 'yes', 'verified') AS b
        FROM t
    """,
    "box_algebra": """
        WITH b AS (SELECT o_orderkey, o_custkey::DOUBLE AS x FROM orders),
        m AS (SELECT *, 40.0::DOUBLE AS area, (greatest(x + 10, 200) - least(x, 100)) * 8 AS merged_area FROM b)
        SELECT o_orderkey, area, merged_area, merged_area - area AS enlargement, x <= 200 AND x + 10 >= 100 AS crosses,
               x >= 100 AND x + 10 <= 500 AS inside, sqrt(greatest(x - 300, 0, 300 - x - 10) ** 2 + 2 ** 2) <= 50 AS near
        FROM m
    """,
    "box_bounds": f"SELECT min(x) AS low_x, min(y) AS low_y, max(x) AS high_x, max(y) AS high_y FROM {_PARTS}",
    "ordered_scan": "SELECT * FROM part",
    "index_sequential": f"SELECT * FROM {_SUPPLIER} WHERE s_suppkey BETWEEN 10 AND 20 UNION ALL SELECT 15, 'one more', 3, 12.5",
    "index_hash": f"SELECT * FROM {_SUPPLIER} WHERE s_suppkey = 15 UNION ALL SELECT 15, 'one more', 3, 12.5",
    "index_btree": f"SELECT * FROM {_SUPPLIER} WHERE s_nationkey BETWEEN 4 AND 6",
    "index_rtree": f"SELECT * FROM {_PLACES} WHERE sqrt((x - 25) * (x - 25) + (y - 1000) * (y - 1000)) <= 50",
    "index_delete": f"SELECT * FROM {_SUPPLIER} WHERE s_nationkey <> 7",
    "dialect_nearest": f"SELECT id, x, y, round(sqrt((x - 25) * (x - 25) + (y - 1000) * (y - 1000)), 4) AS _distance FROM {_PLACES} ORDER BY sqrt((x - 25) * (x - 25) + (y - 1000) * (y - 1000)), id LIMIT 7",
    "dialect_project": f"SELECT s_name, s_nationkey FROM {_SUPPLIER} WHERE s_name = 'Supplier#000000010'",
    "dialect_count": "SELECT count(*) AS cnt FROM supplier WHERE s_nationkey = 7",
    "dialect_order": f"SELECT s_suppkey, s_acctbal FROM {_SUPPLIER}",
    "dialect_join": f"SELECT s_suppkey AS s_s_suppkey, s_name AS s_s_name, s_nationkey AS s_s_nationkey, s_acctbal AS s_s_acctbal, n_nationkey AS n_n_nationkey, n_name AS n_n_name FROM {_SUPPLIER} JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey BETWEEN 3 AND 9",
    "dialect_join_group": "SELECT n_name, count(*) AS cnt FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
}
