"""Claims and leases, imports, the resumable backfill, and what sinks leave behind."""

import gzip
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from scholarflow.sources import leases, sinks


def snapshot(folder, files):
    folder.mkdir(exist_ok=True)
    for name, works in files.items():
        with gzip.open(folder / name, "wt") as f:
            f.writelines(json.dumps(w) + "\n" for w in works)


def test_one_of_many_creates(spark, tmp_path):
    folder, won = leases.Folder(spark, str(tmp_path / "claims")), []
    start = threading.Barrier(8)

    def claim(i):
        start.wait()
        if folder.create("one", {"by": i}):
            won.append(i)

    threads = [threading.Thread(target=claim, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and folder.read("one") == {"by": won[0]} and not folder.create("one", {})
    assert folder.names() == ["one"] and folder.read("none") is None
    folder.write("one", {"by": 9})
    (tmp_path / "claims/half").write_text('{"by"')
    assert folder.read("one") == {"by": 9} and folder.read("half") is None


def test_lease(spark, tmp_path):
    at = str(tmp_path / "lease")
    with leases.Lease(spark, at, 1.0) as one:
        with pytest.raises(RuntimeError), leases.Lease(spark, at, 1.0):
            pass
        time.sleep(1.6)  # it is renewed meanwhile
        with pytest.raises(RuntimeError), leases.Lease(spark, at, 1.0):
            pass
        one.check()
    with leases.Lease(spark, at, 1.0) as two:  # it was given up
        with two._lock:
            two._ended.set()  # the owner stops: nobody renews
        time.sleep(1.4)
        with leases.Lease(spark, at, 1.0) as three:
            assert three.number > two.number
            with pytest.raises(leases.LeaseLost):
                two.check()
            three.check()
    assert len(leases.Folder(spark, at).names()) == 1
    # an owner that died as it wrote its claim
    (tmp_path / "lease" / f"{99:012d}").write_text("{")
    with pytest.raises(RuntimeError), leases.Lease(spark, at, 1.0):
        pass
    time.sleep(1.2)
    with leases.Lease(spark, at, 1.0) as four:
        assert four.number == 100


def test_backfill_goes_on_after_a_death(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    snapshot(source, {f"{c}.gz": [{"id": f"W{c}", "referenced_works": [f"R{c}"]}] for c in "abc"})
    calls = []

    def work(files, die=None):
        calls.append(files)
        if die and len(calls) == die:
            raise KeyboardInterrupt
        return spark.read.json(files).select(F.col("id").alias("work_id"), F.explode("referenced_works").alias("referenced_work_id"))

    # the process dies in the second chunk: its lease stays as it is
    leave = leases.Lease.__exit__
    leases.Lease.__exit__ = lambda self, *_: self._ended.set()
    try:
        with pytest.raises(KeyboardInterrupt):
            sinks.backfill(spark, str(source), target, lambda f: work(f, 2), 1, lease_seconds=3)
    finally:
        leases.Lease.__exit__ = leave
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out/chunk=000000").glob("*.parquet")}
    with pytest.raises(RuntimeError):
        sinks.backfill(spark, str(source), target, work, 1, lease_seconds=3)
    time.sleep(3.2)
    calls.clear()
    assert sinks.backfill(spark, str(source), target, work, 1, lease_seconds=3) == [1, 2] and len(calls) == 2
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "out/chunk=000000").glob("*.parquet")} == before
    assert sorted(r.work_id for r in spark.read.parquet(*(f"{target}/chunk={i:06d}" for i in range(3))).collect()) == ["Wa", "Wb", "Wc"]
    assert not [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_made_")]


def test_backfill_that_is_overtaken_commits_nothing(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    snapshot(source, {"a.gz": [{"id": "W1", "referenced_works": ["R1"]}]})

    def work(files):
        state = leases.Folder(spark, f"{target}/_lease")
        state.create(f"{int(state.names()[-1]) + 1:012d}", {"owner": "another", "until": time.time() + 60})
        return spark.range(1)

    with pytest.raises(leases.LeaseLost):
        sinks.backfill(spark, str(source), target, work, 1)
    assert not (tmp_path / "out/chunk=000000").exists() and not (tmp_path / "out/_chunk_000000.json").exists()
    with pytest.raises(RuntimeError):  # the other one's lease stands
        sinks.backfill(spark, str(source), target, work, 1)


def test_two_loaders_import_once(spark, tmp_path):
    store = sinks.Warehouse(spark, str(tmp_path / "w"))
    assert store.manifest().count() == 0
    got, start = [], threading.Barrier(3)

    def load(i):
        start.wait()
        got.append(sinks.Warehouse(spark, str(tmp_path / "w")).load("econ", "works", spark.range(4).withColumn("by", F.lit(i))))

    threads = [threading.Thread(target=load, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [0, 0, 4] and store.manifest().count() == 1
    assert store.table("works").count() == 4 and store.table("works").select("by").distinct().count() == 1
    # a loader that broke off before its entry
    spark.range(9).write.parquet(str(tmp_path / "w/works/load=lost"))
    assert store.load("law", "works", spark.range(2).withColumn("by", F.lit(7))) == 2 and store.table("works").count() == 6
    assert store.vacuum() == ["works/load=lost"] and store.table("works").count() == 6
    # a subject's import goes and is made anew
    assert store.unload("econ", "works") and not store.unload("econ", "works") and store.table("works").count() == 2
    assert store.load("econ", "works", spark.range(5).withColumn("by", F.lit(8))) == 5 and store.load("econ", "works", spark.range(5)) == 0
    assert sorted((r.subject, r["count"]) for r in store.table("works").groupBy("subject").count().collect()) == [("econ", 5), ("law", 2)]
    with pytest.raises(ValueError):
        store.table("none")


def test_views(spark, tmp_path):
    store = sinks.Warehouse(spark, str(tmp_path / "w"))
    store.load("econ", "works", spark.createDataFrame([("W1", 2000, "article"), ("W2", 2001, "book")], "work_id string, publication_year int, type string"))
    store.load("law", "works", spark.createDataFrame([("W1", 1990, "article")], "work_id string, publication_year int, type string"))
    store.load("econ", "work_authors", spark.createDataFrame([("W1", "A1", "Ann"), ("W2", "A1", "Ann B"), ("W1", "A2", "Bo")], "work_id string, author_id string, author_name string"))
    store.load("econ", "work_cites_by_year", spark.createDataFrame([("W1", 2003, 4), ("W2", 2003, 1), ("W1", 2004, 2)], "work_id string, year int, cite_counts bigint"))
    store.load("law", "work_cites_by_year", spark.createDataFrame([("W1", 2003, 7)], "work_id string, year int, cite_counts bigint"))
    store.views()
    assert sorted(map(tuple, spark.table("cite_panel").select("subject", "work_id", "year", "cite_counts", "paper_age", "type").collect())) == [("econ", "W1", 2003, 4, 3, "article"), ("econ", "W1", 2004, 2, 4, "article"), ("econ", "W2", 2003, 1, 2, "book"), ("law", "W1", 2003, 7, 13, "article")]
    assert sorted(map(tuple, spark.table("author_works").collect())) == [("econ", "A1", "Ann", 2), ("econ", "A2", "Bo", 1)]
    assert sorted(map(tuple, spark.table("year_summary").collect())) == [("econ", 2003, 2, 5), ("econ", 2004, 1, 2), ("law", 2003, 1, 7)]


def test_subject_tables_replace_their_subjects_only(spark, tmp_path):
    root = str(tmp_path / "s")
    rows = lambda *x: spark.createDataFrame(list(x), "work_id string, subject string")
    sinks.write_subjects({"works": rows(("W1", "econ"), ("W2", "law")), "authors": rows(("A1", "econ"))}, root)
    sinks.write_subjects({"works": rows(("W3", "econ"))}, root)
    assert sorted(map(tuple, spark.read.parquet(f"{root}/works").select("work_id", "subject").collect())) == [("W2", "law"), ("W3", "econ")]
    assert spark.read.parquet(f"{root}/authors").count() == 1 and (tmp_path / "s/works/subject=law").is_dir()


def test_run_summary(spark, tmp_path):
    got = sinks.write_counted(spark.range(10), str(tmp_path / "o"), {"years": [1, 2], "sample": 0.5}, total=F.sum("id"))
    assert got == {"years": [1, 2], "sample": 0.5, "rows": 10, "total": 45} and spark.read.parquet(str(tmp_path / "o")).count() == 10
    sinks.write_json_file(got, str(tmp_path / "summary.json"))
    assert json.loads((tmp_path / "summary.json").read_text()) == got and not list(tmp_path.glob("*.tmp"))
