"""One pass to all tables, counts that run on, and tables that are dealt out by work."""

import contextlib
import io
import json

from scholarflow.operators import normalize as N
from scholarflow.operators import panels as P
from scholarflow.sources import bucketed, readers
from scholarflow.streaming import incremental

WORKS = [
    {"id": "W1", "display_name": "One", "publication_year": 2001, "type": "article", "primary_topic": {"field": {"id": "f/1", "display_name": "Econ & Co"}}, "authorships": [{"author": {"id": "A1", "display_name": "Ann"}}, {"author": {}}, {"author": {"id": "A2"}}], "counts_by_year": [{"year": 2003, "cited_by_count": 4}, {"cited_by_count": 1}], "referenced_works": ["R1", "R1", "", None, "R2"]},
    {"id": "W2", "publication_year": 2002, "referenced_works": ["W1"]},
    {"id": "", "publication_year": 2002, "authorships": [{"author": {"id": "A3"}}]},
    {"id": "W4", "title": "No year", "counts_by_year": [{"year": 2004, "cited_by_count": "x"}]},
    {},
]


def plan_of(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_one_pass_gives_all_tables(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("".join(json.dumps(w) + "\n" for w in WORKS))
    raw = readers.parse_works(spark.read.text(str(tmp_path / "in.jsonl")))
    for dedupe in (True, False):
        rows = N.tagged(raw, dedupe)
        assert plan_of(rows).count("Scan text") == 2  # once in the tree, once in its details
        path = str(tmp_path / f"out{dedupe}")
        counts = N.write_normalized(raw, path, dedupe)
        for name, want in N.normalize(raw, dedupe).items():
            got = N.read_normalized(spark, path, name)
            assert got.columns == [*want.columns, "subject"] and counts[name] == want.count()
            assert sorted(map(repr, got.drop("subject").collect())) == sorted(map(repr, want.collect()))
            assert {r.subject for r in got.where("work_id = 'W1'").select("subject").collect()} <= {"econ_co"}
            assert {r.subject for r in got.where("work_id <> 'W1'").select("subject").collect()} <= {"unknown"}
    # the same work in two subjects stays in both
    two = raw.where("id = 'W1'").unionByName(raw.where("id = 'W1'").withColumn("primary_topic", raw.primary_topic.withField("field.display_name", raw.type)))
    assert sorted(r.subject for r in N.tagged(two).where("table_name = 'works'").collect()) == ["article", "econ_co"]
    assert N.write_normalized(raw.where("false"), str(tmp_path / "none")) == dict.fromkeys(N.TABLES, 0)


def test_running_counts(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    put = lambda rows: spark.createDataFrame(rows, "citing bigint, cited bigint, year int").coalesce(1).write.mode("append").parquet(source)
    now = lambda: sorted(map(tuple, incremental.running_counts(spark, target).collect()))
    assert now() == []
    put([(1, 9, 2000), (2, 9, 2000), (3, 8, 2001)])
    incremental.count_references(spark, source, target, state)
    assert now() == [(8, 2001, 1), (9, 2000, 2)]
    put([(4, 9, 2000), (5, 7, None)])
    incremental.count_references(spark, source, target, state)
    # the second batch has its own two rows and no more
    assert sorted(map(tuple, spark.read.parquet(f"{target}/batch=000000000001").collect())) == [(7, None, 1), (9, 2000, 1)]
    want = [(7, None, 1), (8, 2001, 1), (9, 2000, 3)]
    assert sorted(now(), key=str) == sorted(want, key=str)
    incremental.count_references(spark, source, target, state)  # nothing new
    again = spark.createDataFrame([(4, 9, 2000), (5, 7, None)], "citing bigint, cited bigint, year int")
    incremental.add_counts(target)(again, 1)  # the last batch once more
    assert sorted(now(), key=str) == sorted(want, key=str)
    # a batch and a base that broke off are nothing
    (tmp_path / "out/batch=000000000007").mkdir()
    (tmp_path / "out/base=000000000009").mkdir()
    assert sorted(now(), key=str) == sorted(want, key=str)
    put([(6, 9, 2002)])
    incremental.count_references(spark, source, target, state)
    want = [*want, (9, 2002, 1)]
    assert incremental.compact_counts(spark, target) == 2 and sorted(now(), key=str) == sorted(want, key=str)
    assert incremental.compact_counts(spark, target) == 0
    put([(7, 9, 2002)])
    incremental.count_references(spark, source, target, state)
    # a compaction that broke off before it deleted what it had merged
    spark.read.parquet(f"{target}/base=000000000001").write.parquet(str(tmp_path / "kept"))
    assert incremental.compact_counts(spark, target) == 2
    (tmp_path / "kept").rename(tmp_path / "out/base=000000000001")
    want[-1] = (9, 2002, 2)
    assert sorted(now(), key=str) == sorted(want, key=str)


def test_bucketed_tables_meet_without_a_shuffle(spark, tmp_path):
    works = spark.createDataFrame([(i, i % 7, 1998 + i % 4) for i in range(60)], "work_id bigint, author_id bigint, pub_year int")
    cby = spark.createDataFrame([(i % 40, 1999 + i % 5, i) for i in range(0, 200, 3)], "work_id bigint, year int, cite_counts bigint").groupBy("work_id", "year").sum("cite_counts").toDF("work_id", "year", "cite_counts")
    for name, df in (("t_works", works), ("t_years", P.yearly(cby))):
        bucketed.write_bucketed(df, name, "work_id", str(tmp_path / name), 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = P.lifetime_by_work(bucketed.bucketed(spark, "t_works"), bucketed.bucketed(spark, "t_years"), 2001)
        assert "Exchange" not in plan_of(out) and "SortMergeJoin" in plan_of(out)
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, P.lifetime(works, cby, 2001).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("t_works", "t_years"):
            spark.sql(f"drop table {name}")


def test_sampled_authorships(spark):
    works = spark.createDataFrame([("W1", 2000, "article"), ("W2", 2001, "book"), ("W3", 1990, "article"), ("W4", 2001, "article")], "work_id string, pub_year int, type string")
    own = spark.createDataFrame([("A1", "W1"), ("A1", "W1"), ("A1", "W4"), ("A2", "W1"), ("A2", "W3"), ("", "W1"), (None, "W4"), ("A3", "W4"), ("A3", "W2"), ("A4", None)], "author_id string, work_id string")
    got = lambda **how: sorted(map(tuple, P.sampled_authorships(own, works, 2000, 2001, ["article"], **how).collect()))
    assert got() == [("A1", "W1"), ("A1", "W4"), ("A2", "W1"), ("A3", "W4")]
    assert got(min_works=2) == [("A1", "W1"), ("A1", "W4")] and got(max_authors=1) == got(min_works=2)
    assert sorted(got(sample=(3, 10)) + [r for r in got() if r not in got(sample=(3, 10))]) == got() and got(sample=(0, 10)) == []


def test_checksums_of_large_files(spark, tmp_path):
    """A file beyond 2 GB (sparse: it takes no disk) and odd names, as streams; small ones by Spark too."""
    import hashlib

    (tmp_path / "in/a b").mkdir(parents=True)
    with open(tmp_path / "in/large.bin", "wb") as f:
        f.truncate((2 << 30) + 5)
    small = {"in/a b/x%20y.gz": b"not gzip", "in/empty": b"", "in/c.gz": b"\x1f\x8b"}
    for name, content in small.items():
        (tmp_path / name).write_bytes(content)
    zeros, total = bytes(1 << 24), hashlib.sha256()
    for _ in range(128):
        total.update(zeros)
    total.update(bytes(5))
    want = {name[3:]: (len(c), hashlib.sha256(c).hexdigest()) for name, c in small.items()}
    got = {r.path: (r.bytes, r.sha256) for r in readers.manifest_of(spark, str(tmp_path / "in")).collect()}
    assert got == {**want, "large.bin": ((2 << 30) + 5, total.hexdigest())}
    (tmp_path / "in/large.bin").unlink()
    assert {r.path: (r.bytes, r.sha256) for r in readers.manifest_of(spark, str(tmp_path / "in"), streamed=False).collect()} == want
