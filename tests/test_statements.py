"""Joins, orders, wide conditions, counts and safe writes of the statement engine."""

import io

import pytest

from lodestone.__main__ import run
from lodestone.errors import Outcome, StatementError
from lodestone.operators import sorting as S
from lodestone.plans.engine import Engine


@pytest.fixture
def engine(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/root dir")
    for text in ("create table a{k: int, x: string(3)}", "create table b{k: int, y: char}", "create table c{j: int, z: char}"):
        assert engine.execute(text).outcome == "success"
    for text in ('a{1, "p"}', 'a{1, "q"}', 'a{3, "r"}', "b{1, m}", "b{3, n}", "c{3, o}"):
        assert engine.execute(f"insert into {text}").outcome == "success"
    return engine


def rows(engine, text):
    result = engine.execute(text)
    assert result.outcome == "success", result.message
    return [tuple(r) for r in result.df.collect()]


def test_joins(engine):
    assert sorted(rows(engine, "select * from a join b on k")) == [(1, "p", "m"), (1, "q", "m"), (3, "r", "n")]
    assert rows(engine, "select {z, x} from a join c on k == j where z == o") == [("o", "r")]
    assert len(rows(engine, "select * from a cross c")) == 3
    assert sorted(rows(engine, 'select {x} from a cross c where (k == 3 || x == "q")')) == [("q",), ("r",)]
    for text in ("select * from a join c on k", "select * from a cross b", "select * from a join a on k"):
        assert engine.execute(text).outcome == Outcome.INVALID_COLUMN
    for text in ("select * from a join b", "select * from a join", "select * from a cross"):
        assert engine.execute(text).outcome in (Outcome.SYNTAX_ERROR, Outcome.NO_TABLE_NAME)


def test_wide_conditions(engine):
    assert rows(engine, 'select {x} from a where !(k == 1) && (x == "r" || x == "p")') == [("r",)]
    assert sorted(rows(engine, 'select {x} from a where ((k == 1 && x != "p") || !k < 3)')) == [("q",), ("r",)]
    assert engine.execute('update a{x = "s"} where (k == 1 && x == "p")').n == 1
    assert engine.execute('delete from a where (k == 3 || x == "s")').n == 2
    assert rows(engine, "select * from a") == [(1, "q")]
    for text in ("(k == 1", "(k == 1) k", "!", "()", "(k == 1 ||)", "(k)"):
        assert engine.execute(f"select * from a where {text}").outcome in (Outcome.SYNTAX_ERROR, Outcome.INVALID_OPERATOR)
    assert engine.execute("select * from a where (nope == 1)").outcome == Outcome.INVALID_COLUMN


def test_key_order_and_counts(engine):
    assert rows(engine, "select {x} from a order by k desc") == [("r",), ("q",), ("p",)]
    assert rows(engine, "select {x} from a where k < 3 order by k") == [("p",), ("q",)]
    assert engine.execute("select * from a where k == 1").n == 2
    assert engine.execute("select * from a order k").outcome == Outcome.SYNTAX_ERROR


def test_one_entry_by_its_hidden_key(engine):
    assert rows(engine, "select {x, _pkey} from a where k == 1 order by k") == [("p", 1), ("q", 2)]
    assert not engine.remove("a", "k", "3", 1) and engine.remove("a", "k", "1", 1) and not engine.remove("a", "k", "1", 1)
    assert engine.execute('delete from a where (k == 1 && _pkey == 9)').n == 0
    assert sorted(rows(engine, "select {x} from a")) == [("q",), ("r",)]


@pytest.mark.parametrize("name", ["..", ".", "../up", "a/b", "a.b", "_x-y", "9a", "_manifest/"])
def test_names_are_not_paths(engine, name):
    for text in (f"create table {name}{{a: int}}", f"drop table {name}", f"delete table {name}", f"select * from {name}"):
        assert engine.execute(text).outcome in (Outcome.SYNTAX_ERROR, Outcome.FAILURE, Outcome.NO_TABLE_NAME)
    for call in (engine.catalog.get, engine.catalog.drop, engine.catalog.vacuum, lambda n: engine.catalog.create(n, [("a", "int")])):
        with pytest.raises(StatementError):
            call(name)
    assert engine.catalog.names() == ["a", "b", "c"]


def files(engine, name):
    table = engine.catalog.get(name)
    return {f: engine.spark.read.parquet(f).count() for part in table.parts for f in engine.catalog._files(part)}


def test_untouched_files_keep_their_paths(engine, spark):
    engine.execute("create table t{a: int, b: int}")
    engine.insert_many("t", spark.range(1000).selectExpr("cast(id as int) as a", "cast(id % 7 as int) as b").repartitionByRange(8, "a"))
    before = files(engine, "t")
    old = engine.table("t")
    assert engine.execute("delete from t where a == 10").n == 1
    after = files(engine, "t")
    assert len(before) > 4 and len(before.keys() - after.keys()) == 1
    assert engine.execute("update t{b = 99} where a >= 998").n == 2
    assert len(after.keys() - files(engine, "t").keys()) == 1
    assert engine.execute("delete from t where a == 5000").n == 0
    left = sorted(rows(engine, "select * from t"))
    assert left == [(i, 99 if i >= 998 else i % 7) for i in range(1000) if i != 10]
    assert old.count() == 1000  # readers keep their version
    engine.execute("index on {a} in t")
    engine.catalog.vacuum("t")
    assert sorted(rows(engine, "select * from t")) == left


def test_bulk_inserts_are_checked(engine, spark):
    frame = lambda *data: spark.createDataFrame(list(data), "k int, x string")
    assert engine.insert_many("a", frame((7, "long"), (8, "ok"))).outcome == Outcome.STRING_TOO_LARGE
    assert engine.insert_many("a", frame((None, "ok"))).outcome == Outcome.TYPE_MISMATCH
    assert engine.insert_many("b", spark.createDataFrame([(1, "AB")], "k int, y string")).outcome == Outcome.TYPE_MISMATCH
    assert engine.table("a").count() == 3
    assert engine.insert_many("a", frame((7, "abc"), (8, ""))).n == 2
    assert engine.insert_many("a", frame().limit(0)).n == 0
    keys = [r._pkey for r in engine.catalog.read(engine.catalog.get("a"), hidden=True).collect()]
    assert sorted(keys) == [1, 2, 3, 4, 5]


def test_manifests_appear_whole(engine):
    table = engine.catalog.get("a")
    folder = engine.catalog._path(f"{engine.catalog.root}/a/_manifest")
    names = [f.getPath().getName() for f in engine.catalog._fs.listStatus(folder)]
    assert not [n for n in names if n.startswith(".") and not n.endswith(".crc")]
    engine.catalog.index(table, ["k"])
    with pytest.raises(StatementError):
        engine.catalog.index(table, ["x"])
    assert engine.catalog.get("a").indexes == ("k",)


def test_index_clusters_files(engine, spark):
    engine.execute("create table t{a: int, b: int}")
    engine.execute("index on {b} in t")
    engine.insert_many("t", spark.range(4000).selectExpr("cast(id as int) as a", "cast(id * 7919 % 4000 as int) as b"))
    bounds = sorted((spark.read.parquet(f).selectExpr("min(b) as l", "max(b) as h").first() for f in files(engine, "t")), key=lambda r: r.l)
    assert all(one.h <= two.l for one, two in zip(bounds, bounds[1:], strict=False))


def test_sorted_order(spark, tmp_path):
    rows = S.random_rows(spark, 5000)
    got = [tuple(r) for r in S.sorted_relation(rows, "y", "pkey").collect()]
    assert got == sorted((r.y, r.pkey) for r in rows.collect())
    S.sorted_text(rows, "y", f"{tmp_path}/text")
    parts = sorted((tmp_path / "text").glob("part-*"))
    assert [int(x) for p in parts for x in p.read_text().splitlines()] == [y for y, _ in got]
    S.sort_to_files(rows, "y", "pkey", f"{tmp_path}/files")
    assert [(r.y, r.pkey) for r in S.positions(spark, f"{tmp_path}/files").orderBy("pos").collect()] == got


def test_positions_follow_part_numbers(spark, tmp_path):
    for part, value in (("part-99999-x", 1), ("part-100000-x", 2)):
        spark.createDataFrame([(value,)], "v int").coalesce(1).write.parquet(f"{tmp_path}/{part}.d")
        (tmp_path / "all").mkdir(exist_ok=True)
        next((tmp_path / f"{part}.d").glob("*.parquet")).rename(tmp_path / "all" / f"{part}.parquet")
    got = S.positions(spark, f"{tmp_path}/all")
    assert {(r.v, r.pos) for r in got.collect()} == {(1, 1), (2, 2)} and dict(got.dtypes)["pos"] == "bigint"


def test_command_line(engine):
    out = io.StringIO()
    run(engine, io.StringIO('select {x} from a order by k\n\nselect nonsense\ndelete from a where k == 3\n.exit\nselect * from a\n'), out)
    assert out.getvalue() == "x\np\nq\nr\n3 row(s)\nsyntaxError\nk | x\n3 | r\n1 row(s)\n"
