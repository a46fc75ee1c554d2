import os

import pytest
from pyspark.sql import functions as F

from propstats.plans import changes, ingest
from propstats.sources import tables

TAIL = "F,N,L,1,,HIGH ST,,LONDON,CITY,LONDON,A"


def line(key, price, date, status="A"):
    return f'"{key}",{price},{date} 00:00,"E1 1AA",{TAIL},{status}'


def written(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture
def silver(spark, tmp_path):
    path = str(tmp_path / "silver")
    base = [line("a", 1, "1999-01-01"), line("b", 2, "1999-02-01"), line("c", 3, "2000-01-01"), line("d", 4, "2001-01-01"), line("e", 5, "2002-01-01")]
    ingest.ingest(spark, written(tmp_path, "base.csv", base), path)
    return path


def rows(spark, path):
    return sorted((r.transaction_id, r.price, r.year) for r in tables.read_table(spark, path).collect())


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "_manifest" not in d}


def test_latest_wins_and_only_touched_years_are_written(spark, tmp_path, silver):
    months = [
        written(tmp_path, "m1.csv", [line("a", 10, "1999-01-01", "C"), line("c", 3, "2000-01-01", "D"), line("f", 6, "1999-05-05"), line("x", 0, "1999-05-05", "D"), '"bad",1']),
        written(tmp_path, "m2.csv", [line("a", 11, "1999-01-01", "C"), line("f", 6, "1999-05-05", "D"), line("b", 2, "2001-02-01", "C"), line("g", 7, "2001-02-01"), line("g", 7, "2001-02-01", "D")]),
    ]
    before = files_of(silver)
    report = changes.apply_changes(spark, silver, months)
    wanted = [("a", 11, 1999), ("b", 2, 2001), ("d", 4, 2001), ("e", 5, 2002)]
    assert rows(spark, silver) == wanted
    assert report == {"years": [1999, 2000, 2001], "resumed": [], "added": 0, "changed": 2, "deleted": 1, "unknown": 3}
    # The year 2000 is gone, 2002 was not touched.
    assert not os.path.exists(f"{silver}/year=2000") and not os.path.exists(f"{silver}_pending")
    after = files_of(silver)
    assert {f: t for f, t in after.items() if "year=2002" in f} == {f: t for f, t in before.items() if "year=2002" in f}
    assert tables.verify_content(spark, silver).where("NOT matches").isEmpty()
    again = changes.apply_changes(spark, silver, months)
    assert rows(spark, silver) == wanted and (again["changed"], again["deleted"]) == (2, 0)
    assert changes.apply_changes(spark, silver, [written(tmp_path, "none.csv", [""])])["years"] == []


@pytest.mark.parametrize("broken", ["write", "remove"])
def test_a_call_that_stopped_is_finished_by_the_next(spark, tmp_path, silver, monkeypatch, broken):
    month = written(tmp_path, "m.csv", [line("a", 10, "2000-03-03", "C"), line("b", 2, "1999-02-01", "D"), line("c", 9, "2000-01-01", "C"), line("h", 8, "2003-01-01")])
    wanted = [("a", 10, 2000), ("c", 9, 2000), ("d", 4, 2001), ("e", 5, 2002), ("h", 8, 2003)]
    real = tables.remove

    def stops(spark, path):
        if "year=" in path or (broken == "remove" and path.endswith("_pending") and os.path.exists(path)):
            raise RuntimeError("stopped")
        real(spark, path)

    monkeypatch.setattr(tables, "remove", stops)
    with pytest.raises(RuntimeError):
        changes.apply_changes(spark, silver, [month])
    monkeypatch.setattr(tables, "remove", real)
    assert os.path.exists(f"{silver}_pending/complete")
    empty = written(tmp_path, "none.csv", [""])
    report = changes.apply_changes(spark, silver, [empty])
    assert set(report["resumed"]) == {1999, 2000, 2003} and rows(spark, silver) == wanted
    assert tables.verify_content(spark, silver).where("NOT matches").isEmpty()


def test_a_call_that_stops_early_changes_nothing(spark, tmp_path, silver, monkeypatch):
    month = written(tmp_path, "m.csv", [line("a", 10, "2000-03-03", "C")])
    before = rows(spark, silver)
    monkeypatch.setattr(changes, "_finish", lambda *_: pytest.fail("not complete"))
    monkeypatch.setattr(tables, "write_by_year", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        changes.apply_changes(spark, silver, [month])
    assert rows(spark, silver) == before and not os.path.exists(f"{silver}_pending/complete")


# --- content ---------------------------------------------------------------------------------

KIND = "year int, a string, b string, n int"
ROWS = [(1, "x", None, 1), (1, None, "x", 1), (1, "x", "y", 2), (2, "p", "q", 3), (2, "p", "q", 3), (None, "z", "z", 0)]


def prints(spark, found):
    return {r.year: tuple(r) for r in tables.fingerprint(spark.createDataFrame(found, KIND).repartition(3)).collect()}


@pytest.mark.parametrize(
    "changed",
    [
        [(1, None, "x", 1), (1, None, "x", 1), *ROWS[2:]],  # null and value exchanged between columns
        [(1, "x", None, 2), (1, None, "x", 1), (1, "x", "y", 1), *ROWS[3:]],  # values exchanged between rows
        [*ROWS[:3], (2, "p", "q", 3), (2, "p", "r", 3), ROWS[5]],  # one of two equal rows altered
        [*ROWS[:2], (1, "y", "x", 2), *ROWS[3:]],  # columns exchanged
    ],
)
def test_fingerprints_tell_contents_apart_that_count_alike(spark, changed):
    one, other = prints(spark, ROWS), prints(spark, changed)
    assert {y: p[1] for y, p in one.items()} == {y: p[1] for y, p in other.items()} and one != other
    assert one == prints(spark, list(reversed(ROWS)))


def test_manifest_finds_what_was_altered(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame(ROWS, KIND)
    tables.write_by_year(df, path)
    tables.write_manifest(tables.fingerprint(df), path)
    assert tables.verify_content(spark, path).where("NOT matches").isEmpty()
    assert spark.read.parquet(path).count() == len(ROWS)  # the manifest is no part of the table
    df.where("year = 2").limit(1).drop("year").write.mode("append").parquet(f"{path}/year=2")
    found = {r.year: (r.expected_rows, r.written_rows, r.matches) for r in tables.verify_content(spark, path).collect()}
    assert found == {1: (3, 3, True), 2: (2, 3, False), None: (1, 1, True)}
    tables.remove(spark, f"{path}/year=1")
    gone = {r.year: (r.expected_rows, r.written_rows, r.matches) for r in tables.verify_content(spark, path).collect()}
    assert gone[1] == (3, 0, False)


def test_a_source_whose_content_differs_is_kept(spark, tmp_path, monkeypatch):
    source, silver = written(tmp_path, "s.csv", [line("a", 1, "1999-01-01"), line("b", 2, "1999-02-01")]), str(tmp_path / "silver")
    whole = tables.write_by_year
    monkeypatch.setattr(tables, "write_by_year", lambda df, path, cluster=True: whole(df.withColumn("price", F.lit(1)), path, cluster))
    report = ingest.ingest(spark, source, silver, retire_source=True)
    assert report["match"] and not report["content_match"] and not report["source_deleted"]
    assert os.path.exists(source) and not os.path.exists(f"{silver}/_manifest")
    monkeypatch.undo()
    report = ingest.ingest(spark, source, silver, retire_source=True)
    assert report["content_match"] and report["source_deleted"] and not os.path.exists(source)


def test_the_table_is_overwritten_from_rebalanced_rows(spark, tmp_path, silver, monkeypatch):
    # Each task sorts what it writes by year: not a file split, which grows with the table, but a rebalanced partition.
    writes, plain = [], tables.write_by_year

    def noted(df, path, cluster=True, years_only=False):
        writes.append((path, years_only, df._jdf.queryExecution().optimizedPlan().toString()))
        plain(df, path, cluster, years_only)

    monkeypatch.setattr(tables, "write_by_year", noted)
    before = files_of(silver)
    changes.apply_changes(spark, silver, [written(tmp_path, "m.csv", [line("a", 9, "1999-01-01", "C")])])
    assert [w[:2] for w in writes] == [(f"{silver}_pending/rows", False), (silver, True)]
    assert all("RebalancePartitions [year" in plan and "_lot" in plan for *_, plan in writes)
    assert rows(spark, silver) == [("a", 9, 1999), ("b", 2, 1999), ("c", 3, 2000), ("d", 4, 2001), ("e", 5, 2002)]
    assert {k: v for k, v in before.items() if "year=1999" not in k}.items() <= files_of(silver).items()
