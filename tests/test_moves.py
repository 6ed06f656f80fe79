"""Moves cut off at any point, and readers that hold on to what they read."""

import pytest
from pyspark.sql import SparkSession

from millrace.plans import Step, current_generation, full_refresh, reading, recompute, retire_generations, settle, update
from millrace.plans import generations, journal, leases
from millrace.sources import landing_stream

RAW = "order_id STRING, customer_id STRING, amount STRING, order_ts STRING"


class CutOff(BaseException):
    """The driver is gone: nothing that handles errors runs any more."""


@pytest.fixture
def names(database):
    return [f"{database}.{name}" for name in ("first", "second", "third")]


def steps(spark, names, rows, extra=False):
    """Three tables of ``rows`` rows; with ``extra`` they have one more column."""
    columns = ["id"] + (["id * 2 AS twice"] if extra else [])
    first = Step(names[0], lambda read: spark.range(rows).selectExpr(*columns), comment=f"{rows} rows")
    return [first] + [Step(b, lambda read, a=a: read(a), comment=f"{rows} rows") for a, b in zip(names, names[1:])]


def state(spark, names):
    return [(spark.table(n).columns, spark.table(n).count(), spark.catalog.getTable(n).description) for n in names]


def cut_catalog_after(monkeypatch, n):
    """Let ``n`` changes of the catalog happen and none after them. Reading goes on."""
    done, plain, create = [0], SparkSession.sql, generations_catalog_create()

    def step():
        if done[0] == n:
            raise CutOff
        done[0] += 1

    def sql(self, text, *args, **kwargs):
        if text.split()[0] in ("ALTER", "COMMENT", "DROP"):
            step()
        return plain(self, text, *args, **kwargs)

    def create_table(self, *args, **kwargs):
        step()
        return create(self, *args, **kwargs)

    from pyspark.sql.catalog import Catalog

    monkeypatch.setattr(SparkSession, "sql", sql)
    monkeypatch.setattr(Catalog, "createTable", create_table)
    return done


def generations_catalog_create():
    from pyspark.sql.catalog import Catalog

    return Catalog.createTable


@pytest.mark.parametrize("extra", [False, True])
def test_a_move_cut_off_at_any_change_is_finished_or_undone(spark, names, monkeypatch, extra):
    names = names[:2]
    before = [(["id"], 3, "3 rows")] * 2
    after = [(["id", "twice"] if extra else ["id"], 5, "5 rows")] * 2
    outcomes = []
    for n in range(100):
        recompute(spark, steps(spark, names, 3))
        with monkeypatch.context() as patched:
            done = cut_catalog_after(patched, n)
            try:
                recompute(spark, steps(spark, names, 5, extra))
            except CutOff:
                pass
            else:
                break
        assert done[0] == n
        outcomes.append(settle(spark, names[-1]))
        assert state(spark, names) == (after if outcomes[-1] == journal.FINISHED else before), n
        assert {t.name for t in spark.catalog.listTables(names[0].partition(".")[0])} == {"first", "second"}
        assert settle(spark, names[-1]) is None
    assert state(spark, names) == after
    # Two tables, each a pointer or a new entry, two renamings and a dropped one, and a comment; the last table decides.
    assert len(outcomes) == (10 if extra else 4) and outcomes == sorted(outcomes, reverse=True)
    assert set(outcomes) == {journal.UNDONE, journal.FINISHED}


def test_settling_may_be_cut_off_too(spark, names, monkeypatch):
    older = recompute(spark, steps(spark, names, 2)).generation
    recompute(spark, steps(spark, names, 3))
    with monkeypatch.context() as patched:
        cut_catalog_after(patched, 9)  # the second table has its new entry
        with pytest.raises(CutOff):
            recompute(spark, steps(spark, names, 5, extra=True))
    for n in range(4):
        assert retire_generations(spark, names[-1], keep=0) == []
        with monkeypatch.context() as patched:
            cut_catalog_after(patched, n)
            with pytest.raises(CutOff):
                settle(spark, names[-1])
    assert settle(spark, names[-1]) == journal.UNDONE
    assert state(spark, names) == [(["id"], 3, "3 rows")] * 3
    assert retire_generations(spark, names[-1], keep=0) == [older]


def test_the_first_generation_is_taken_away_again(spark, names, monkeypatch):
    with monkeypatch.context() as patched:
        cut_catalog_after(patched, 3)
        with pytest.raises(CutOff):
            recompute(spark, steps(spark, names, 3))
    assert spark.catalog.tableExists(names[0])
    assert retire_generations(spark, names[-1], keep=0) == []
    assert settle(spark, names[-1]) == journal.UNDONE
    assert not any(spark.catalog.tableExists(n) for n in names)
    recompute(spark, steps(spark, names, 4))
    assert state(spark, names) == [(["id"], 4, "4 rows")] * 3


def test_a_journal_that_was_not_written_whole_moves_nothing(spark, names, monkeypatch):
    recompute(spark, steps(spark, names, 3))
    folder = f"{generations.pipeline_folder(spark, names[-1])}/journal"
    spark.createDataFrame([], journal._RECORD).write.mode("overwrite").parquet(folder)
    assert settle(spark, names[-1]) is None
    assert state(spark, names) == [(["id"], 3, "3 rows")] * 3


def test_a_table_that_cannot_be_shown_takes_the_others_back_at_once(spark, names, monkeypatch):
    recompute(spark, steps(spark, names, 3))
    plain = journal.show

    def refuse(spark, table, generation, *args, **kwargs):
        if table == names[1] and kwargs and generation not in shown:
            raise RuntimeError("no room")
        return plain(spark, table, generation, *args, **kwargs)

    shown = {current_generation(spark, n) for n in names}
    monkeypatch.setattr(journal, "show", refuse)
    with pytest.raises(RuntimeError, match="no room"):
        recompute(spark, steps(spark, names, 5))
    assert state(spark, names) == [(["id"], 3, "3 rows")] * 3


@pytest.mark.parametrize("run", [update, full_refresh])
def test_runs_settle_before_they_read(spark, database, tmp_path, monkeypatch, run):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.json").write_text('{"order_id": "1"}\n{"order_id": "2"}\n')
    names = [f"{database}.raw", f"{database}.kept"]
    pipeline = [
        Step(names[0], lambda read: landing_stream(spark, str(landing), RAW)),
        Step(names[1], lambda read: read(names[0]).select("order_id")),
    ]
    first = update(spark, pipeline).generation
    with monkeypatch.context() as patched:
        cut_catalog_after(patched, 1)
        with pytest.raises(CutOff):
            full_refresh(spark, pipeline)
    assert current_generation(spark, names[0]).id != first == current_generation(spark, names[1]).id
    (landing / "b.json").write_text('{"order_id": "3"}\n')
    done = run(spark, pipeline)
    assert (done.generation == first) == (run is update)
    assert {current_generation(spark, n).id for n in names} == {done.generation}
    assert [spark.table(n).count() for n in names] == [3, 3]


def test_files_stay_under_a_reader_with_a_lease(spark, names):
    old = recompute(spark, steps(spark, names, 3)).generation
    with reading(spark, names[0], names[2]) as (first, third):
        recompute(spark, steps(spark, names, 5))
        assert retire_generations(spark, names[-1], keep=0) == []
        assert first.count() == third.count() == 3
        assert state(spark, names) == [(["id"], 5, "5 rows")] * 3
    assert retire_generations(spark, names[-1], keep=0) == [old]
    with reading(spark, names[0]) as (first,):
        assert first.count() == 5


def test_a_lease_ends_by_itself_and_after_an_error(spark, names):
    old = recompute(spark, steps(spark, names, 3)).generation
    lost = reading(spark, names[0], hours=-1.0)
    lost.__enter__()
    newer = recompute(spark, steps(spark, names, 5)).generation
    with pytest.raises(ZeroDivisionError), reading(spark, names[0]):
        raise ZeroDivisionError
    recompute(spark, steps(spark, names, 6))
    assert retire_generations(spark, names[-1], keep=0) == sorted([old, newer])


def test_a_generation_given_up_while_the_lease_is_put_down_is_not_read(spark, names, monkeypatch):
    recompute(spark, steps(spark, names, 3))
    plain, calls = leases._same_generation, []

    def slow(*args):
        found = plain(*args)
        if not calls:  # the reader knows what to read, and before it says so that is gone
            calls.append(found)
            recompute(spark, steps(spark, names, 5))
            assert retire_generations(spark, names[-1], keep=0) == [found[0].id]
        return found

    monkeypatch.setattr(leases, "_same_generation", slow)
    with reading(spark, *names) as frames:
        assert [rows.count() for rows in frames] == [5, 5, 5]


def test_tables_on_the_move_are_not_read_as_one(spark, names, monkeypatch):
    recompute(spark, steps(spark, names, 3))
    with monkeypatch.context() as patched:
        cut_catalog_after(patched, 1)
        with pytest.raises(CutOff):
            recompute(spark, steps(spark, names, 5))
    with pytest.raises(leases.NothingToRead), reading(spark, *names, patience=0.5):
        pass
    settle(spark, names[-1])
    with reading(spark, *names) as frames:
        assert [rows.count() for rows in frames] == [3, 3, 3]
    with pytest.raises(leases.NothingToRead), reading(spark, f"{names[0]}_absent", patience=0.0):
        pass
