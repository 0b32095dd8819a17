"""Grammar, outcomes, boundaries and snapshots of the statement engine."""

import pytest

from lodestone.errors import Outcome, StatementError
from lodestone.operators.relational import natural_join, text_rows
from lodestone.plans.engine import Engine
from lodestone.plans.grammar import parse


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}")


@pytest.fixture
def marks(engine):
    for s in ("create table marks{rollno: int, name: string(50), grade: char}", "index on {rollno} in marks", 'insert into marks{"1", "Yogesh Kumar", "A"}', 'insert into marks{"2", "Pranav Guptar", "A"}', 'insert into marks{"3", "Yogesh Kumar", "B"}'):
        assert engine.execute(s).outcome == "success", s
    return engine


def rows(engine, text):
    return sorted(tuple(r) for r in engine.execute(text).df.collect())


def test_documented_session(marks):
    assert len(rows(marks, "select * from marks")) == 3
    gone = marks.execute('delete from marks where rollno == "3"')
    assert gone.n == 1 and [tuple(r) for r in gone.df.collect()] == [(3, "Yogesh Kumar", "B")]
    assert rows(marks, "select (grade, rollno) from marks") == [("A", 1), ("A", 2)]
    assert text_rows(marks.table("marks")).collect()[0].line.count(" | ") == 2


@pytest.mark.parametrize(
    ("text", "outcome"),
    [
        ('insert into marks{"4", "x"}', Outcome.FAILURE),
        ('insert into marks{"x", "n", "A"}', Outcome.TYPE_MISMATCH),
        ('insert into marks{"12abc", "n", "A"}', Outcome.TYPE_MISMATCH),
        ('insert into marks{"2147483648", "n", "A"}', Outcome.TYPE_MISMATCH),
        (f'insert into marks{{"4", "{"n" * 51}", "A"}}', Outcome.STRING_TOO_LARGE),
        (f'insert into marks{{"4", "{"n" * 50}", "A"}}', Outcome.SUCCESS),
        ('insert into marks{"4", "n", "AB"}', Outcome.TYPE_MISMATCH),
        ('insert into marks{"4", "n", ""}', Outcome.TYPE_MISMATCH),
        ("insert into marks{}", Outcome.NO_INSERT_DATA),
        ("create table t{}", Outcome.EMPTY_TABLE),
        ("create table t{a: date}", Outcome.INVALID_TYPE),
        ("create table t{a: string}", Outcome.NO_SIZE),
        ("create table t{a: int, a: int}", Outcome.SYNTAX_ERROR),
        ("create table", Outcome.NO_TABLE_NAME),
        ("create table marks{a: int}", Outcome.FAILURE),
        ("delete from marks", Outcome.NO_CONDITION),
        ('delete from marks where rollno > "1" && grade == "A"', Outcome.DIFFERENT_ROWS),
        ('select * from marks where rollno => "1"', Outcome.INVALID_OPERATOR),
        ('select * from marks where rollno > "1" && rollno < "3" && rollno < "2"', Outcome.SYNTAX_ERROR),
        ("select * from marks where rollno > 1 || rollno < 0", Outcome.SYNTAX_ERROR),
        ("select * from nothing", Outcome.FAILURE),
        ("drop table nothing", Outcome.FAILURE),
        ("select {nope} from marks", Outcome.INVALID_COLUMN),
        ("select {ROLLNO} from marks", Outcome.INVALID_COLUMN),
        ("index on {nope} in marks", Outcome.INVALID_COLUMN),
        ("update marks{}", Outcome.NO_UPDATE_DATA),
        ('update marks set {grade = "C"} where rollno == 1', Outcome.SUCCESS),
        ('select * from marks where grade == "AB"', Outcome.TYPE_MISMATCH),
        ("grant all", Outcome.UNRECOGNIZED),
        (".help", Outcome.UNRECOGNIZED),
        (".flush", Outcome.SUCCESS),
        (".exit", Outcome.EXIT),
        ("", Outcome.EMPTY),
    ],
)
def test_outcomes(marks, text, outcome):
    assert marks.execute(text).outcome == outcome


def test_unquoted_and_empty_literals():
    assert parse('insert into t{1, "", x}').values == ["1", "", "x"]
    assert parse("select {*} from t").columns is None
    with pytest.raises(StatementError):
        parse("select * from t nonsense")


def test_strict_index(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}", strict_index=True)
    engine.execute("create table t{a: int, b: int}")
    assert engine.execute("insert into t{1, 2}").outcome == Outcome.NOT_INDEXED
    engine.execute("index on {a} in t")
    assert engine.execute("insert into t{1, 2}").outcome == "success"
    assert engine.execute("delete from t where b == 2").outcome == Outcome.NOT_INDEXED
    assert engine.execute("delete from t where a == 1").n == 1


def test_duplicate_keys_and_probes(engine, spark):
    engine.execute("create table t{key: int, pkey: int}")
    data = [(10, 1), (20, 2), (5, 3), (15, 4), (11, 5), (71, 5), (71, 6), (71, 7), (71, 8), (71, 9), (11, 10), (10, 11)]
    assert engine.insert_many("t", spark.createDataFrame(data, "key int, pkey int")).n == 12
    engine.execute("delete from t where pkey == 2")
    engine.execute("insert into t{71, 10}")
    engine.execute("delete from t where pkey == 9")
    counts = {4: (0, 0, 0, 11, 11), 11: (3, 5, 2, 8, 6), 12: (5, 5, 0, 6, 6), 20: (6, 6, 0, 5, 5), 71: (6, 11, 5, 5, 0), 100: (11, 11, 0, 0, 0)}
    for probe, want in counts.items():
        assert tuple(engine.execute(f"select * from t where key {op} {probe}").df.count() for op in ("<", "<=", "==", ">=", ">")) == want
        assert engine.execute(f"select * from t where key != {probe}").df.count() == 11 - want[2]
    keys = [r._pkey for r in engine.catalog.read(engine.catalog.get("t"), hidden=True).select("_pkey").collect()]
    assert len(set(keys)) == 11 and max(keys) == 13


def test_readers_keep_their_version(marks):
    before = marks.table("marks")
    marks.execute('update marks{grade = "Z"}')
    marks.execute("delete table marks")
    assert before.count() == 3 and {r.grade for r in before.collect()} == {"A", "B"}
    assert marks.table("marks").count() == 0
    marks.execute('insert into marks{"9", "n", "A"}')
    marks.catalog.vacuum("marks")
    assert marks.table("marks").count() == 1


def test_second_writer_fails(marks):
    table = marks.catalog.get("marks")
    marks.catalog.index(table, ["name"])
    with pytest.raises(StatementError):
        marks.catalog.index(table, ["grade"])


def test_drop_and_create_again(marks):
    assert marks.execute("drop table marks").outcome == "success"
    assert marks.catalog.names() == []
    assert marks.execute("create table marks{a: float}").outcome == "success"
    marks.execute("insert into marks{1.1}")
    assert marks.execute("select * from marks where a == 1.1").df.count() == 1


def test_natural_join(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (3, "r")], "k int, b string")
    assert natural_join(a, b, "k").count() == 4
    with pytest.raises(StatementError):
        natural_join(a, a, "k")
