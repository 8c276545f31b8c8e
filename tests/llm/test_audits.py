"""The filter audit, the divergence audit and vector search, against plain versions."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from scholarflow.llm import _spark as S
from scholarflow.llm import filter_audit, source_divergence, vector_search

SF = "/root/testdata/sf0.001"


def plain_audit(docs, labels):
    """docs: (doc_id, text, source). All rows of the audit, by their meaning."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    ids = defaultdict(list)
    for i, t, _ in docs:
        ids[t or ""].append(i)
    fails = []
    for i, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        known = [x for x in ids[t] if x is not None]
        copy = bool(known) if i is None else min(known) < i
        fails.append((s or "", i, {c for c, f in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), copy), strict=True) if f}))
    out = {}
    for part in {s for s, _, _ in fails}:
        own = [(i, f) for s, i, f in fails if s == part]
        removed = Counter()
        for order in itertools.permutations("ABCDE"):
            for k, c in enumerate(order):
                here = [i for i, f in own if c in f and not f & set(order[:k])]
                removed[c] += len(here)
                out[part, "".join(order), k + 1] = [sum(not f & set(order[: k + 1]) for _, f in own), len(here), sum(c in f and bool(f & set(order[:k])) for _, f in own), sum(f == {c} for _, f in own), sum(i in good for i in here), sum(i in toxic for i in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed[order[step - 1]])
    return out


def audited(docs, labels):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.filter_audit(docs, labels).collect()}


def awkward_documents():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcXYé#") for _ in range(rng.randrange(1, 5)))
    texts = [" ".join(word() for _ in range(n)) for n in (0, 1, 150, 199, 200, 201, 400)] + ["x " * 300, "\n\t  ", None, "", "A", "one\x0btwo\r\nthree" * 80, "plain words here " * 70, "lang " * 30_000]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", None, ""])) for i in range(120)]
    return rows + [(None, t, "a") for t in texts[:4] + [None]] + rows[:9] + [(5, "other text", "b"), (None, "seen nowhere else", "c"), (None, "seen nowhere else", "c")]


def test_filter_audit_on_awkward_rows(spark):
    rows = awkward_documents()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 100, 2)] + [(3, None, 1), (3, 1, None), (None, 1, 1), (4, 1, 0), (4, 0, 0)]
    docs = spark.createDataFrame([(i, t, s, "n", 0) for i, t, s in rows], "doc_id bigint, text string, source string, word string, n int").repartition(3)
    got = audited(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert got == plain_audit(rows, labels)
    assert filter_audit.filter_audit(docs.where("false"), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


def test_filter_audit_query(spark):
    docs, labels = S.table(spark, SF, "documents"), S.table(spark, SF, "labels")
    rows = filter_audit.op11_filter_audit(spark, SF)
    assert rows.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = plain_audit([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in rows.collect()} == want


def plain_divergence(docs, min_docs=3, top=200):
    """docs: (lang, source, text). Set of rows."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own, holders, out = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        own[lang or "", source or ""].update(found)
        holders[lang or ""].update(set(found))
    for lang in holders:
        kept = [t for t, n in holders[lang].items() if n >= min_docs]
        groups = {s: c for (g, s), c in own.items() if g == lang}
        total = sum(groups.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept} for s, c in [*groups.items(), (None, total)]}
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            lists = {"pair": [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s], "term": [(t, f(p[s][t], p[None][t])) for t in kept if groups[s][t] and p[s][t] > p[None][t]]}
            for part, items in lists.items():
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode("utf-8", "surrogatepass")))
                out |= {(lang, s, part, item, v, r) for r, (item, v) in enumerate(ranked, 1) if part == "pair" or r <= top}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_divergence_on_awkward_rows(spark, monkeypatch, small):
    if small:  # many blocks, steps and partial counts
        for name, value in (("BLOCK", 7), ("STEP", 5), ("HELD", 3), ("SLICE", 4)):
            monkeypatch.setattr(source_divergence, name, value)
    rng = random.Random(13)
    word = lambda: rng.choice(["The", "the", "été", "ÉTÉ", "a1b", "x_y", "Ω", "日本", "q", "\u0085z", "é"]) + rng.choice(["", "s", "-t", "9"])
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "é", None]), " ".join(word() for _ in range(rng.randrange(30)))) for _ in range(90)]
    rows += [("en", "only numbers", "1 2 3"), ("xx", "s1", None), ("xx", "s2", "rare"), ("yy", "alone", "same same"), ("yy", "alone", "same"), ("yy", "alone", "same"), ("en", "a", "long " * 50_000), ("en", "a", "x\x00y\x7fz")] + rows[:5]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "lang string, source string, text string, count int, term string").repartition(3)
    out = source_divergence.source_divergence(docs)
    assert {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in out.collect()} == plain_divergence(rows)
    assert source_divergence.source_divergence(docs.where("false")).count() == 0


def test_divergence_query_and_its_exact_numbers(spark):
    rows = [tuple(r) for r in S.table(spark, SF, "documents").select("lang", "source", "text").collect()]
    out = source_divergence.op13_source_divergence(spark, SF)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows)
    # counts whose products go beyond 64 bits
    big = spark.createDataFrame([(10**18, 3 * 10**18, 7), (0, 5, 3)], "c bigint, n bigint, v bigint")
    assert [r[0] for r in big.select(source_divergence._p("c", "n", "v")).collect()] == [1 + 10**9 * (10**18 + 1) // (3 * 10**18 + 7), 1 + 10**9 // 8]


def exact_neighbours(rows, k):
    """rows: (vec_id, vector). query -> [(score, vec_id)] of all usable rows."""
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in {i for i, _ in fine if i % 100 == 0}:
        near = {}
        for i, v in fine:
            for j, w in fine:
                if j == q and i != q and len(v) == len(w):
                    s = math.dist(v, w)
                    near[i] = min(s, near.get(i, math.inf))
        out[q] = sorted((s, i) for i, s in near.items())[:k]
    return out


@pytest.mark.parametrize("shard", [1 << 14, 40])
def test_vector_search_finds_all_of_a_few(spark, shard):
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(150)]
    rows += [(i, rows[7][1]) for i in range(200, 240)] + [(i, rows[0][1]) for i in (300, 301, 302)]  # copies, of a query too
    rows += [(400, [1.0, 2.0]), (401, [1.0, 2.5]), (500, [5.0]), (600, None), (700, []), (800, [0.0] * 6), (801, [float("nan")] * 6), (802, [None] * 6), (803, [math.inf] * 6), (None, rows[1][1])]
    rows += [rows[3], rows[100], (100, rng.normal(size=6).tolist()), (5, rng.normal(size=6).tolist()), (900, [1e200] * 6), (901, [2e200] * 6)]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id bigint, embedding array<double>, node int, score int").repartition(3)
    out = vector_search.nearest(df, "vec_id % 100 = 0", shard=shard, block=2).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: r["rank"]):
        got[r.query_id].append((r.score, r.vec_id))
    want = {q: v for q, v in exact_neighbours(rows, 10).items() if v}
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert all(math.isclose(a, b, rel_tol=1e-12) for q in want for (a, _), (b, _) in zip(got[q], want[q], strict=True))
    assert all([r["rank"] for r in out if r.query_id == q] and sorted(r["rank"] for r in out if r.query_id == q) == list(range(1, len(v) + 1)) for q, v in want.items())
    assert vector_search.nearest(df.where("false"), "vec_id % 100 = 0").count() == 0


def test_vector_search_recall(spark):
    """The query over its whole table, and clustered vectors with copies in several shards: recall 0.9 at least."""
    def recall(vectors, ids, found):
        hits = total = 0
        for q in np.flatnonzero(ids % 100 == 0):
            d = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
            order = np.lexsort((ids, d))
            want = set(ids[[i for i in order if ids[i] != ids[q]][:10]].tolist())
            hits, total = hits + len(want & found[int(ids[q])]), total + len(want)
        return hits / total

    def of(out):
        found = defaultdict(set)
        for r in out.collect():
            found[r.query_id].add(r.vec_id)
        return found

    table = S.table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding").collect()
    assert recall(np.array([r.embedding for r in table], float), np.array([r.vec_id for r in table]), of(vector_search.op12_nearest_neighbours(spark, "/root/testdata/sf0.1"))) >= 0.9
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(60, 24)) * 3, 50, 0) + rng.normal(size=(3000, 24)) * 0.3
    x[1000:2000] = x[0]  # a third of all rows are copies
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    assert recall(x, np.arange(3000), of(vector_search.nearest(df, "vec_id % 100 = 0", shard=700, block=20))) >= 0.9


def test_scopes_keep_apart(spark):
    """A run deletes its own tables, also when it fails; what it hands on and other runs' tables stay."""
    import threading

    mine = S.save(spark.range(3), "mine")
    seen = {}

    def other():
        with S.scope(spark) as run:
            seen["table"] = S.save(spark.range(5), "other")
            ready.set()
            done.wait(60)
            seen["count"] = seen["table"].count()
            seen["paths"] = list(run.paths)

    ready, done = threading.Event(), threading.Event()
    t = threading.Thread(target=other)
    t.start()
    ready.wait(60)
    with S.scope(spark) as run:
        S.save(spark.range(7), "gone")
        with S.scope(spark) as inner:
            kept = inner.hand_on(spark.range(2), "kept")
        assert kept.count() == 2 and len(run.paths) == 2
        paths = list(run.paths)
        handed = run.hand_on(spark.range(4), "handed")
    with pytest.raises(ZeroDivisionError), S.scope(spark) as run:
        S.save(spark.range(7), "failed")
        paths += run.paths
        raise ZeroDivisionError
    done.set()
    t.join()
    exists = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    assert seen["count"] == 5 and mine.count() == 3 and handed.count() == 4
    assert not any(map(exists, [*paths, *seen["paths"]]))
