"""Matched controls and clusters of versions, against plain rules."""

import collections
import random

from scholarflow.functions.columns import similarity_ratio
from scholarflow.operators import matching as M


def most(rows, treated, keys):
    """The greatest number of pairs in cells: all of the smaller side, but for what one author has too much of."""
    sides = collections.defaultdict(lambda: collections.defaultdict(lambda: [0, 0]))
    for r in rows:
        sides[tuple(r[k] for k in keys)][r["author_id"]][r["work_id"] not in treated] += 1
    total = 0
    for by in sides.values():
        t, c = (sum(v[k] for v in by.values()) for k in (0, 1))
        total += min([t, c, *(t + c - sum(v) for a, v in by.items() if a is not None)])
    return total


def greedy(rows, treated, keys):
    """Works in order, each with the first free candidate that isn't by its author."""
    free, n = [r for r in rows if r["work_id"] not in treated], 0
    for r in rows:
        if r["work_id"] in treated:
            found = next((c for c in free if all(c[k] == r[k] for k in keys) and (c["author_id"] is None or c["author_id"] != r["author_id"])), None)
            if found:
                free.remove(found)
                n += 1
    return n


def check(spark, rows, treated, topic):
    df = spark.createDataFrame([(r["work_id"], r["author_id"], r["year"], r["type"], r["topic"], 0) for r in rows], "work_id bigint, author_id bigint, year int, type string, topic string, rank int").repartition(3)
    got = M.matched_controls(df.where(df.work_id.isin(sorted(treated))), df, ["year", "type"], "topic" if topic else None).collect()
    by = {r["work_id"]: r for r in rows}
    assert sorted(r.work_id for r in got) == sorted(treated)
    pairs = [(by[r.work_id], by[r.control]) for r in got if r.control is not None]
    assert len({c["work_id"] for _, c in pairs}) == len(pairs)
    for t, c in pairs:
        assert (t["year"], t["type"]) == (c["year"], c["type"]) and c["work_id"] not in treated and (t["author_id"] is None or t["author_id"] != c["author_id"])
    used = {x["work_id"] for p in pairs for x in p}
    left = [[r for r in rows if r["work_id"] not in used and (r["work_id"] in treated) is side] for side in (True, False)]
    assert not any((t["year"], t["type"]) == (c["year"], c["type"]) and (t["author_id"] is None or t["author_id"] != c["author_id"]) for t in left[0] for c in left[1])
    return pairs


def test_controls_reach_the_greatest_number(spark):
    rng = random.Random(23)
    for share in (0.0, 0.5, 0.8, 0.97):  # of one author
        rows = [{"work_id": i, "author_id": 1 if rng.random() < share else rng.choice([2, 3, 4, 5, None]), "year": 2000 + i % 2, "type": "ab"[i % 3 > 0], "topic": rng.choice("xy")} for i in range(160)]
        treated = {r["work_id"] for r in rows if rng.random() < 0.4}
        pairs = check(spark, rows, treated, False)
        assert len(pairs) == most(rows, treated, ["year", "type"]) >= greedy(rows, treated, ["year", "type"])
        pairs = check(spark, rows, treated, True)
        assert sum(t["topic"] == c["topic"] for t, c in pairs) == most(rows, treated, ["year", "type", "topic"])


def test_controls_beside_free_works_are_found(spark):
    """Twenty treated works, twenty that suit all of them, and many by their own author."""
    rows = [{"work_id": i, "author_id": 1, "year": 2000, "type": "a", "topic": "x"} for i in range(100)]
    rows += [{"work_id": 200 + i, "author_id": 2, "year": 2000, "type": "a", "topic": "y"} for i in range(20)]
    assert len(check(spark, rows, set(range(20)), True)) == 20
    assert len(check(spark, rows, set(range(30)), False)) == 20
    # more treated than candidates, and none of another author
    assert len(check(spark, rows, set(range(100)), False)) == 20
    assert len(check(spark, rows[:50], set(range(20)), True)) == 0


def test_controls_of_nothing(spark):
    none = spark.createDataFrame([], "work_id bigint, author_id bigint, year int, type string, topic string")
    assert M.matched_controls(none, none, ["year", "type"], "topic").count() == 0
    row = [{"work_id": i, "author_id": i, "year": None, "type": "a", "topic": None} for i in range(4)]
    assert check(spark, row[:1], {0}, True) == [] and check(spark, [{**r, "year": 1} for r in row], {0, 1}, True)


def sequential(rows, ratio=0.9, years=1):
    """The rule as it reads: works of an author one after the other. rows: (author_id, work_id, norm, year, cites, doi)."""
    out = {}
    for author in {r[0] for r in rows}:
        leaders = []
        for r in sorted((r for r in rows if r[0] == author), key=lambda r: (r[4] is None, -(r[4] or 0), r[1])):
            found = None
            if author:
                found = next((v for v in leaders if (r[5] and r[5] == v[5]) or (r[3] is not None and v[3] is not None and abs(r[3] - v[3]) <= years and similarity_ratio(r[2], v[2]) >= ratio)), None)
            leaders += [] if found else [r]
            out[r[1]] = found[1] if found else r[1]
    return out


def test_version_clusters_follow_the_sequential_rule(spark):
    rng = random.Random(17)
    words = "effects of trade on growth and wages evidence from firms in long run a theory an essay the".split()
    rows, base = [], []
    for i in range(260):
        if base and rng.random() < 0.6:  # a near copy: some characters changed
            t = list(rng.choice(base))
            for _ in range(rng.randrange(0, 1 + len(t) // 8)):
                k = rng.randrange(len(t) + 1)
                t[k : k + rng.randrange(2)] = rng.choice(["", "x", "s", " "])
            t = "".join(t)
        else:
            t = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 6, 14])))
        base.append(t)
        rows.append((rng.choice(["A", "A", "A", "B", None, ""]), i, t, rng.choice([None, 2000, 2001, 2002, 2003]), rng.choice([None, 0, 1, 5, 5, 9]), rng.choice([None, "", f"d{rng.randrange(40)}"])))
    rows += [("C", 1000 + i, "same title", 2000 + i % 3, i % 2, None) for i in range(40)] + [("D", 2000 + i, "", 2000, 1, "one") for i in range(5)] + [("E", 3000 + i, t, 2000, 9 - i, None) for i, t in enumerate(["abcd", "abcde", "abcdef", "abcdefg", "ab", "ab", "a"])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "author_id string, work_id bigint, title string, year int, cites bigint, doi string, tid int").repartition(3)
    norms = {r.work_id: r.n for r in df.select("work_id", M.normalized_title("title").alias("n")).collect()}
    for ratio in (0.9, 0.95):
        got = M.version_clusters(df, ratio)
        assert got.columns == ["author_id", "work_id", "title", "year", "cites", "doi", "leader"]
        assert {r.work_id: r.leader for r in got.collect()} == sequential([(r[0], r[1], norms[r[1]], *r[3:]) for r in rows], ratio)
    assert M.version_clusters(df.where("false")).count() == 0


def test_titles_meet_by_author_and_by_grams_alike(spark, monkeypatch):
    """Authors with few titles compare these; what that finds is what grams find, and what the rule says."""
    rng = random.Random(5)
    names = [f"{a} {b}" for a in ("cold", "old", "blue", "hot") for b in ("ring", "bolt", "plate", "gear")]
    rows = [(f"A{i % 9}", i, " ".join(sorted(rng.sample(names, rng.choice([1, 4, 5, 6])))) + rng.choice(["", "s", "x"]), 2000 + i % 4, i % 5, None) for i in range(200)]
    df = spark.createDataFrame(rows, "author_id string, work_id bigint, title string, year int, cites bigint, doi string")
    want = sequential(rows)
    assert len(set(want.values())) < len(rows)
    calls = []
    grams = M._met_by_grams
    monkeypatch.setattr(M, "_met_by_grams", lambda *a: calls.append(1) or grams(*a))
    for many, used in ((100, 0), (22, 1), (1, 1)):
        calls.clear()
        monkeypatch.setattr(M, "MANY_TITLES", many)
        assert {r.work_id: r.leader for r in M.version_clusters(df).collect()} == want and len(calls) == used
