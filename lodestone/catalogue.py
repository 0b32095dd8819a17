"""The registered queries over the driver's tables, with their SQL.

Statements run through the engine: tables are adopted in place into a scratch catalog, and
changes are statements whose snapshots are read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.conditions import term
from lodestone.operators import relational as R
from lodestone.operators import sorting as S
from lodestone.plans.engine import Engine
from lodestone.plans.grammar import parse
from lodestone.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _engine(spark: SparkSession, sf_dir: str, *adopted: str) -> Engine:
    engine = Engine(spark, scratch_path(spark, "catalog"))
    for name in adopted:
        engine.catalog.adopt(name, f"{sf_dir}/{name}.parquet")
    return engine


def _do(engine: Engine, *statements: str) -> DataFrame | None:
    for text in statements:
        result = engine.execute(text)
        if result.outcome != "success":
            raise RuntimeError(f"{text}: {result.outcome} {result.message}")
    return result.df


def _statement(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query of one select statement over the tables that it names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, scratch_path(spark, "catalog"))
        statement = parse(text)
        for name in filter(None, (statement.table, statement.other)):
            engine.register(name, _table(spark, sf_dir, name))
        return _do(engine, text)

    return run


def _changed(table: str, *statements: str, then: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """A query of changes to a table and a select over what they leave."""
    return lambda spark, sf_dir: _do(_engine(spark, sf_dir, table), *statements, then or f"select * from {table}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statement('select {o_orderkey, o_totalprice} from orders where o_custkey >= "10" && o_custkey < "20"')(spark, sf_dir)


def natural_join_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return R.natural_join(orders, lines, ("o_orderkey", "l_orderkey"))


def natural_join_many_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return R.natural_join(customers, suppliers, ("c_nationkey", "s_nationkey"), sorted_sides=True).select("c_custkey", "s_suppkey")


def cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cross_product(_table(spark, sf_dir, "nation").select("n_nationkey"), _table(spark, sf_dir, "region").select("r_regionkey"))


def _numbered(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = scratch_path(spark, "sorted")
    S.sort_to_files(df, "o_custkey", "o_orderkey", path)
    return S.positions(spark, path)


def sort_with_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, _table(spark, sf_dir, "orders"))


def sort_skip_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return _numbered(spark, S.without_deleted(orders, "o_orderkey", orders.where(term(orders, "o_custkey", "==", "7"))))


def sorted_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sorted_relation(_table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey")


def sort_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "keys")
    S.sorted_text(_table(spark, sf_dir, "orders"), "o_custkey", path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def complex_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    is_ = lambda *parts: term(orders, *parts)
    return orders.where((is_("o_custkey", "<", "50") | is_("o_orderstatus", "==", "P")) & ~is_("o_totalprice", "<", "100000")).select("o_orderkey")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return R.exists(orders, term(orders, "o_custkey", "==", "7"))


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.text_rows(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


def generated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """What can be told of the generator's rows: their number, keys, constant and the range of their integers."""
    rows = S.random_rows(spark, 10_000)
    inside = lambda c: F.min(F.col(c).between(-(1 << 31), (1 << 31) - 1))
    return rows.agg(F.count("*").alias("n"), F.min("pkey").alias("low"), F.max("pkey").alias("high"), F.countDistinct("pkey").alias("n_keys"), F.min("c").alias("c"), (inside("x") & inside("y")).alias("inside"), (F.countDistinct("y") > 9_900).alias("spread"))


def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.row_count(_statement("select {o_orderkey} from orders where o_custkey == 7")(spark, sf_dir))


def index_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create, index, insert and discover: the tables that a new engine finds, with their indexes."""
    engine = _engine(spark, sf_dir, "region", "nation")
    _do(engine, "create table marks{rollno: int, name: string(50), grade: char}", "index on {rollno} in marks", "index on {n_regionkey, n_name} in nation", 'insert into marks{"1", "Ada", "A"}')
    found = Engine(spark, engine.catalog.root).catalog
    rows = [(name, ",".join(found.get(name).indexes)) for name in found.names()]
    return spark.createDataFrame(rows, "table_name string, indexes string")


def statement_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a select found, as its result tells."""
    engine = Engine(spark, scratch_path(spark, "catalog"))
    engine.register("lineitem", _table(spark, sf_dir, "lineitem"))
    return spark.createDataFrame([(engine.execute("select {l_orderkey} from lineitem where l_quantity <= 5").n,)], "n long")


def remove_entry(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """One of several rows with equal keys goes, by its hidden key."""
    engine = Engine(spark, scratch_path(spark, "catalog"))
    _do(engine, "create table t{key: int, pkey: int}", "index on {key} in t", *(f"insert into t{{{k}, {p}}}" for k, p in ((71, 5), (71, 6), (71, 7), (10, 1))))
    if not engine.remove("t", "key", "71", 2) or engine.remove("t", "key", "71", 4) or engine.remove("t", "key", "71", 2):
        raise RuntimeError("remove found another row")
    return _do(engine, "select * from t")


def create_insert_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    create = "create table t{a: int, b: float, c: bool, d: char, e: string(5), f: long}"
    _do(engine, create, 'insert into t{"1", "1.5", "true", "x", "abc", "5"}', "drop table t", create, 'insert into t{"-2", "0.25", "false", "y", "", "5000000000"}')
    return _do(engine, "select {f, e, d, c, b, a} from t")


_ORDERS = "select {o_orderkey} from orders where"

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "flagship_range": (flagship, "select o_orderkey, o_totalprice from orders where o_custkey >= 10 and o_custkey < 20"),
    "select_all": (_statement("select * from nation"), "select * from nation"),
    "select_columns": (_statement("select {o_orderkey, o_totalprice} from orders"), "select o_orderkey, o_totalprice from orders"),
    "filter_eq": (_statement(f"{_ORDERS} o_custkey == 7"), "select o_orderkey from orders where o_custkey = 7"),
    "filter_ne": (_statement(f'{_ORDERS} o_orderstatus != "F"'), "select o_orderkey from orders where o_orderstatus <> 'F'"),
    "filter_lt": (_statement(f"{_ORDERS} o_totalprice < 50000"), "select o_orderkey from orders where o_totalprice < 50000"),
    "filter_gt": (_statement(f"{_ORDERS} o_totalprice > 150000"), "select o_orderkey from orders where o_totalprice > 150000"),
    "filter_le": (_statement("select {l_orderkey, l_linenumber} from lineitem where l_quantity <= 5"), "select l_orderkey, l_linenumber from lineitem where l_quantity <= 5"),
    "filter_ge": (_statement("select {l_orderkey, l_linenumber} from lineitem where l_quantity >= 45"), "select l_orderkey, l_linenumber from lineitem where l_quantity >= 45"),
    "filter_range": (_statement(f"{_ORDERS} o_custkey >= 100 && o_custkey < 200"), "select o_orderkey from orders where o_custkey >= 100 and o_custkey < 200"),
    "filter_empty_range": (_statement(f"{_ORDERS} o_custkey > 200 && o_custkey < 100"), "select o_orderkey from orders where o_custkey > 200 and o_custkey < 100"),
    "natural_join_unique": (natural_join_unique, "select o.o_orderkey, l.l_linenumber from orders o join lineitem l on o.o_orderkey = l.l_orderkey"),
    "natural_join_many_to_many": (natural_join_many_to_many, "select c.c_custkey, su.s_suppkey from customer c join supplier su on c.c_nationkey = su.s_nationkey"),
    "cross_product": (cross_product, "select n.n_nationkey, r.r_regionkey from nation n cross join region r"),
    "insert_row": (_changed("region", 'insert into region{"99", "ATLANTIS"}'), "select r_regionkey, r_name from region union all select cast(99 as int) as r_regionkey, 'ATLANTIS' as r_name"),
    "update_all": (_changed("nation", 'update nation{n_name = "X"}'), "select n_nationkey, 'X' as n_name, n_regionkey from nation"),
    "update_where": (
        _changed("orders", 'update orders{o_orderstatus = "X"} where o_orderstatus == "F"', then="select {o_orderkey, o_orderstatus} from orders"),
        "select o_orderkey, case when o_orderstatus = 'F' then 'X' else o_orderstatus end as o_orderstatus from orders",
    ),
    "delete_where": (_changed("orders", "delete from orders where o_custkey == 7"), "select * from orders where not (o_custkey = 7)"),
    "delete_range": (_changed("orders", "index on {o_custkey} in orders", "delete from orders where o_custkey > 10 && o_custkey <= 300"), "select * from orders where not (o_custkey > 10 and o_custkey <= 300)"),
    "delete_all": (_changed("region", "delete table region"), "select * from region where false"),
    "create_insert_drop": (
        create_insert_drop,
        "select cast(5000000000 as bigint) as f, '' as e, 'y' as d, false as c, cast(0.25 as float) as b, cast(-2 as int) as a",
    ),
    "index_catalog": (index_catalog, "select * from (values ('marks', 'rollno'), ('nation', 'n_regionkey,n_name'), ('region', '')) t(table_name, indexes)"),
    "sorted_relation": (sorted_relation, "select l_partkey, l_orderkey from lineitem order by 1, 2"),
    "sort_with_position": (sort_with_position, "select o_custkey, o_orderkey, row_number() over (order by o_custkey, o_orderkey) as pos from orders"),
    "sort_skip_deleted": (sort_skip_deleted, "select o_custkey, o_orderkey, row_number() over (order by o_custkey, o_orderkey) as pos from orders where not (o_custkey = 7)"),
    "sort_to_text": (sort_to_text, "select cast(o_custkey as varchar) as line from orders"),
    "complex_condition": (complex_condition, "select o_orderkey from orders where (o_custkey < 50 or o_orderstatus = 'P') and not (o_totalprice < 100000)"),
    "statement_join": (_statement("select {o_orderkey, l_linenumber} from orders join lineitem on o_orderkey == l_orderkey where l_quantity < 5"), "select o_orderkey, l_linenumber from orders join lineitem on o_orderkey = l_orderkey where l_quantity < 5"),
    "statement_cross": (_statement("select {n_name, r_name} from nation cross region where n_regionkey == 1"), "select n_name, r_name from nation cross join region where n_regionkey = 1"),
    "statement_complex": (
        _statement('select {o_orderkey} from orders where (o_custkey < 50 || o_orderstatus == "P") && !(o_totalprice < 100000)'),
        "select o_orderkey from orders where (o_custkey < 50 or o_orderstatus = 'P') and not (o_totalprice < 100000)",
    ),
    "key_order": (_statement("select {o_custkey, o_orderkey} from orders where o_custkey <= 300 order by o_custkey"), "select o_custkey, o_orderkey from orders where o_custkey <= 300 order by 1"),
    "key_order_descending": (_statement("select {o_custkey, o_orderkey} from orders order by o_custkey desc"), "select o_custkey, o_orderkey from orders order by 1 desc"),
    "statement_count": (statement_count, "select count(*) as n from lineitem where l_quantity <= 5"),
    "remove_entry": (remove_entry, "select * from (values (71, 5), (71, 7), (10, 1)) t(key, pkey)"),
    "generated_rows": (generated_rows, "select cast(10000 as bigint) as n, cast(1 as bigint) as low, cast(10000 as bigint) as high, cast(10000 as bigint) as n_keys, 'A' as c, true as inside, true as spread"),
    "point_lookup": (point_lookup, "select count(*) > 0 as found from orders where o_custkey = 7"),
    "text_rows": (text_rows, "select concat_ws(' | ', cast(n_nationkey as varchar), n_name, cast(n_regionkey as varchar)) as line from nation"),
    "row_count": (row_count, "select count(*) as n from orders where o_custkey = 7"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()}
