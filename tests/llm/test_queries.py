"""The queries against plain versions over whole tables, and operators on awkward rows."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from scholarflow.llm import _text as X
from scholarflow.llm import _tokens as K
from scholarflow.llm import decontamination, html_extraction, near_dedup, packing, quality_classifier, quality_rules, queries, secrets, sharding, token_counts, token_output
from tests.llm.test_operators import SF, brute_components, plain_leaks, shingle_set, tokenizer, words

SCHEMAS = {
    "op1_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op2_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op4_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op5_decontamination": "doc_id bigint, n_leaks bigint, leaked_items string, best_similarity double, kept boolean",
    "op6_token_output": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op7_secret_scans": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op8_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op9_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op10_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(docs):
    tok = tokenizer()
    return {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in docs.items()}


def rows_of(spark, name):
    """The rows of a query, after a look at its columns."""
    out = queries.QUERIES[name](spark, SF)
    want = [c.split(" ") for c in SCHEMAS[name].split(", ")]
    assert [[f.name, f.dataType.simpleString()] for f in out.schema.fields][: len(want)] == want
    return out.collect()


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_op1(spark, docs):
    rows = rows_of(spark, "op1_quality_rules")
    assert len(rows) == len(docs)
    for r in rows:
        t = docs[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = {g for g, n in collections.Counter(grams).items() if n > 1}
        covered = {p for i, g in enumerate(grams) if g in often for p in (i, i + 1, i + 2)}
        assert tuple(r)[1:6] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)


def plain_features(text, model):
    """The classifier's features, one token after the other."""
    found = []
    for run in regex.findall(r"\p{L}+|\p{N}+|[^\p{L}\p{N}\s]+", text):
        if regex.match(r"\p{N}", run):
            found.append(13)
            continue
        low = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        found.append(int(K.text_hashes([low])[0, 0]))
        if regex.match(r"\p{L}", run) and len(run) > 1 and 2 * sum("A" <= c <= "Z" for c in run) > len(run):
            found.append(11)
    if not found:
        return np.zeros(2 * quality_classifier.DIMENSIONS + 4)
    place = {int(h): i for i, h in enumerate(model["vocabulary"])}
    vector = lambda h: model["vectors"][place.get(h, len(place))].astype(float)
    n = len(found)
    return np.concatenate([sum(map(vector, found)) / n, sum(map(vector, set(found))) / len(set(found)), [np.log1p(n), len(set(found)) / n, sum(h not in place for h in found) / n, found.count(11) / n]])


def plain_score(text, model):
    x = (plain_features(text, model) - model["mean"]) / model["scale"]
    a, b, c, d = model["w"]
    return float(1 / (1 + np.exp(-(np.tanh(x @ a + b) @ c + d) / model["temperature"]))[0])


def test_op2(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.train(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    rows = rows_of(spark, "op2_quality_classifier")
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)
    for r in sorted(rows, key=lambda r: r.doc_id)[:40]:
        assert abs(r.score - plain_score(docs[r.doc_id], model)) < 1e-4, r


def test_op2_fit(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    again = docs.union(docs.limit(50)).union(docs.limit(50))
    one = quality_classifier.train(docs.repartition(1), labels)
    for other in (quality_classifier.train(docs.repartition(7), labels), quality_classifier.train(again, labels)):
        assert np.array_equal(one["vocabulary"], other["vocabulary"]) and np.array_equal(one["vectors"], other["vectors"])
        assert all(np.allclose(a, b) for a, b in zip(one["w"], other["w"], strict=True))
    two = docs.where("doc_id = 0 or doc_id = 1").select(F.lit(7).alias("doc_id"), "text")  # one id, two texts
    label = spark.createDataFrame([(7, 1), (7, 0), (None, 1), (8, None)], "doc_id bigint, quality int")
    assert quality_classifier.sample(two, label).count() == (zlib.crc32(b"7") % 5 != 0)
    assert quality_classifier.sample(docs, labels, 5).count() <= 5
    own = quality_classifier.classify(docs.withColumn("score", F.lit("mine")), labels, names=("p", "q"))
    assert own.columns == ["doc_id", "text", "score", "p", "q"] and own.where("score <> 'mine'").isEmpty()


def test_op3(spark, docs):
    rows = rows_of(spark, "op3_near_dedup")
    assert {r.doc_id: r.component_id for r in rows} == brute_components(docs.items()) and len(rows) == len(docs)
    assert all(r.n_shingles == len(shingle_set(docs[r.doc_id])) and r.kept == (r.doc_id == r.component_id) for r in rows)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_of_two_letters(spark):
    swap = str.maketrans("ab", "ba")
    pairs = [(thue_morse(n), thue_morse(n).translate(swap)) for n in (64, 96, 97, 1024, 2048)]
    texts = [t for p in pairs for t in (*p, " ".join(p), " ".join(p[::-1]))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = near_dedup.near_duplicates(df).collect()
    assert {r.doc_id: r.component_id for r in rows} == brute_components(list(enumerate(texts))) == {i: i for i in range(len(texts))}
    enc, tok = K.PretokenEncoder("byte_bpe_50k.json"), tokenizer()
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in enc.encode(texts)] == want
    assert [r.n_tokens for r in token_counts.token_counts(df).orderBy("doc_id").collect()] == list(map(len, want))


def test_pretokens_that_share_a_hash(monkeypatch):
    plain = X.span_hashes
    monkeypatch.setattr(K.X, "span_hashes", lambda codes, starts, ends, second=False: (plain(codes, starts, ends) % np.uint64(3), plain(codes, starts, ends, second=True)[1]))
    enc = K.PretokenEncoder("byte_bpe_50k.json")
    texts = ["alpha", "beta", "gamma", "alpha", "delta", "epsilon", "beta", "zeta eta theta", "alpha"]
    for t in texts:
        assert [x.tolist() for x in enc.encode([t])] == [enc.library([t])[0].tolist()]
    counts = K.PretokenEncoder("byte_bpe_50k.json", counts=True, whole=K.text_hashes(["alpha"]))
    assert [next(counts.count([t])) for t in texts] == [len(x) for x in enc.library(texts)]


def test_near_dedup_of_repeated_ids(spark):
    rng = random.Random(1)
    a, b, c = ([f"{x}{rng.randrange(900)}" for _ in range(60)] for x in "abc")
    text = lambda w, *more: " ".join([*w, *more])
    rows = [(4, text(a)), (4, text(b)), (4, text(a)), (8, text(a, "x")), (9, text(b, "y")), (10, text(c)), (None, text(a)), (4, ""), (11, None), (11, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(4, 4, True), (8, 4, False), (9, 4, False), (10, 10, True), (None, None, True), (11, 11, True)}


def test_near_dedup_by_the_last_comparison_alone(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(260)]
    rows = []
    for i in range(70):
        w = base[: rng.choice([40, 60, 80, 107, 143, 190, 253, 260])]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, rounds=0).collect()} == brute_components(rows)


def test_op4(spark, docs, ids):
    rows = rows_of(spark, "op4_token_counts")
    assert {tuple(r) for r in rows} == {(i, len(t.encode()), len(ids[i]) - 1, len(ids[i]) - 1 > 1024) for i, t in docs.items()} and len(rows) == len(docs)


def test_op5(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {i: collections.Counter(tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)) for i, t in items}
    rows = rows_of(spark, "op5_decontamination")
    assert len(rows) == len(docs)
    for r in rows:
        own = shingle_set(docs[r.doc_id])
        # a window can't be alike enough if the whole text lacks more than a quarter of the item
        likely = [(i, t) for i, t in items if 100 * sum(n for g, n in grams[i].items() if g in own) >= 75 * grams[i].total()]
        want = plain_leaks(docs[r.doc_id], likely)
        assert (r.leaked_items, r.n_leaks, r.kept) == (",".join(map(str, sorted(want))), len(want), not want)
        assert abs(r.best_similarity - max(want.values(), default=0)) < 1e-9


def test_decontamination_keeps_columns(spark):
    rng = random.Random(3)
    item = " ".join(f"q{rng.randrange(10**5)}" for _ in range(50))
    long = " ".join(f"w{rng.randrange(10**5)}" for _ in range(40_000))
    rows = [(1, f"{long} {item} {long}", "x", 5.0), (2, long, "y", 6.0), (2, long, "y", 6.0), (None, None, None, None), (3, "", "z", 7.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, t0 string, `a.T1` double")
    out = decontamination.clean(df, spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=str) == sorted(rows[1:], key=str)


def test_op6(spark, docs, ids):
    rows = sorted(rows_of(spark, "op6_token_output"), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(docs)
    starts = itertools.accumulate((len(ids[r.doc_id]) for r in rows), initial=0)
    assert all((r.start, r.n_tokens, r.ids_crc32) == (s, len(ids[r.doc_id]), crc(ids[r.doc_id])) for r, s in zip(rows, starts, strict=False))


def test_op6_blocks(spark, tmp_path, ids, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK_BYTES", 3000)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    token_output.write_tokens(df, str(tmp_path / "t"), shards=3)
    blocks = spark.read.parquet(str(tmp_path / "t/blocks"))
    assert blocks.count() > 5 and blocks.where("lo <> doc_ids[0] or hi <> doc_ids[size(doc_ids) - 1]").isEmpty()
    some = sorted(ids)[::37]
    assert token_output.lookup(spark, str(tmp_path / "t"), [*some, -5]) == {i: ids[i] for i in some}
    again = df.union(df.where("doc_id < 3")).union(df.where("doc_id < 3"))
    assert token_output.train_dictionary(again, token_output.TOKENIZER, 2) == token_output.train_dictionary(df, token_output.TOKENIZER, 2) != b""


def plain_base(text):
    """Base spans by one pattern for each kind."""
    out = []
    for m in re.finditer(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end(), "assign")] if len(m[1]) >= 8 else []
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, s, e) for s, _, e, k in sorted(out)]


def test_op7(spark, docs):
    rows = rows_of(spark, "op7_secret_scans")
    assert len(rows) == len(docs)
    for r in rows:
        base = plain_base(docs[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in base) for kind in secrets.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == [f"{k}:{s}:{e}" for k, s, e in base]


def test_op7_runs_clear_of_spans():
    rng = random.Random(4)
    for _ in range(300):
        make = lambda: [(s, s + rng.randrange(1, 9)) for s in (rng.randrange(60) for _ in range(rng.randrange(9)))]
        runs, spans = [(s, e, "r") for s, e in make()], sorted((s, e, "hex") for s, e in make())
        assert secrets.clear_of(runs, spans) == sorted(r for r in runs if not any(s < r[1] and r[0] < e for s, e, _ in spans))
    text = " ".join(f"{rng.getrandbits(128):032x}" for _ in range(60_000))
    assert len(secrets.scan(text)) == 60_000


def test_op8(spark, docs):
    rows = rows_of(spark, "op8_sharding")
    assert len(rows) == len(docs)
    slots, of, load = collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
    for r in rows:
        t = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t) + 16, zlib.crc32(t), "bytes", None) and 0 <= r.shard < 40
        slots[r.shard].append(r.slot)
        of[t].add(r.shard)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of.values())
    # capacity can't be below the largest group or the mean; greedy filling wastes less than a group on each shard
    group = collections.Counter()
    for t in docs.values():
        group[t] += len(t.encode()) + 16
    assert max(load.values()) <= max(max(group.values()), sum(group.values()) / 40 + max(group.values()))


def test_op8_even_shards():
    rng = random.Random(7)
    for _ in range(200):
        sizes = [rng.choice([1, 2, 3, 50]) * rng.randrange(1, 20) for _ in range(rng.randrange(1, 60))]
        shards = rng.randrange(1, 9)
        capacity, begins = sharding.minimax(sizes, shards)
        assert sharding.fill(sizes, capacity, shards) is not None and (capacity == max(sizes) or sharding.fill(sizes, capacity - 1, shards) is None)
        assert begins[0] == 0 and begins == sorted(set(begins)) and len(begins) == min(shards, len(sizes))
        assert max(sum(sizes[a:b]) for a, b in zip(begins, [*begins[1:], len(sizes)], strict=True)) <= capacity
    _, begins = sharding.minimax([1] * 1000, 40)
    assert {b - a for a, b in zip(begins, [*begins[1:], 1000], strict=True)} == {25}
    assert sharding.minimax([], 5) == (0, [])


def plain_match(a, b):
    """The size of the largest mapping of two forests, straight from its definition."""
    if not a or not b:
        return 0
    (la, _, ca), (lb, _, cb) = a[-1], b[-1]
    best = max(plain_match(a[:-1], b), plain_match(a, b[:-1]))
    return max(best, 1 + plain_match(ca, cb) + plain_match(a[:-1], b[:-1])) if la == lb else best


def random_forest(rng, depth, count):
    out = []
    for _ in range(rng.randrange(4) if depth else 0):
        number = count[0]
        count[0] += 1
        out.append((rng.choice("abc") + ".", number, random_forest(rng, depth - 1, count)))
    return out


def test_op9_matching():
    rng = random.Random(5)
    for _ in range(400):
        a, b = random_forest(rng, 3, [0]), random_forest(rng, 3, [0])
        size, pairs = html_extraction.match(a, b)
        assert size == len(pairs) == plain_match(a, b)
        above = {}
        for side, forest in enumerate((a, b)):
            left = [(x, None) for x in forest]
            while left:
                (label, number, below), parent = left.pop()
                above[side, number] = (label, parent)
                left += [(x, number) for x in below]
        both = dict(pairs)
        assert len(both) == len(set(both.values()))
        for i, j in pairs:
            assert above[0, i][0] == above[1, j][0] and both.get(above[0, i][1]) == above[1, j][1]
        assert [j for _, j in sorted(pairs)] == sorted(both.values())


def test_op9(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = rows_of(spark, "op9_html_extraction")
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        parts = re.split(r"</?(?:h1|p|ul|li|div|blockquote|h2)\b[^>]*>", article)
        import html

        want = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def extracted(spark, pages, **options):
    df = spark.createDataFrame([(i, u, p) for i, (u, p) in enumerate(pages)], "page_id int, url string, html string")
    return [r.text for r in html_extraction.extract(df, **options).orderBy("page_id").collect()]


def test_op9_wrapper_decides(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    pages, want = [], []
    for i in range(6):
        title, one, two = text(4), text(40), text(30)
        pages.append(("http://a.example/", f"<body><div class=zz><a href=x>{text(3)}</a></div><div class=qq>{text(5)}</div><article id=post-{i}><h1>{title}</h1><p>{one}<div class=share>Share this page</div><p>{two}</article><div class=vv>{text(6)}</div>"))
        want.append(f"{title}\n{one}\n{two}")
    # no name of these boxes says what they are: the region does; what is constant in it is template
    for i in range(4):
        one = text(30)
        pages.append(("http://b.example/", f"<body><div class=m1><a href=x>{text(2)}</a> <a href=y>{text(2)}</a></div><div class=m2><p>{one}</div><div class=m3>All rights are ours</div>"))
        want.append(one)
    assert extracted(spark, pages, lists=False) == want == extracted(spark, pages)
    assert extracted(spark, pages, lists=False, min_pages=99) != want
    # a page without the region, and one with the article's boilerplate only
    pages += [("http://a.example/", "<body><main><p>Another layout</p></main>"), ("http://a.example/", "<body><article id=post-9><div class=share>Share this page</div></article>"), ("http://a.example/", None)]
    assert extracted(spark, pages) == [*want, "Another layout", "", ""]


def test_op9_hard_pages(spark):
    deep = "<div>" * 50_000 + "deep" + "</div>" * 50_000
    wide = "".join(f"<h2>t{i}</h2><p>p{i}</p>" + "<ul><li>x</ul>" * (i % 3) for i in range(3000))
    pages = [("http://d.example/", p) for p in (deep, deep.replace("deep", "other"), "<b>" * 50_000 + "<p>bold", f"<article>{wide}</article>", f"<article>{wide[200:]}</article>")]
    got = extracted(spark, pages)
    assert got[:3] == ["deep", "other", "bold"] and got[3].startswith("t0\np0\nt1\np1\nx") and got[3].count("\n") == got[3].count("p") + got[3].count("t") + got[3].count("x") - 1
    odd = ['<header class="entry-header"><h1>T</h1></header>', '<div class="article-header"><h1>T</h1></div>', "<p title=it's>T</p>", '<p title="a>b" data-class="menu" data-id=nav>T</p>', "<p class=menu-less>T</p>", "<p alt='x\">'>T</p>", '<p alt="open>T</p>']
    assert extracted(spark, [(f"http://o{i}.example/", f"<body><article>{x}<p>One</p></article>") for i, x in enumerate(odd)]) == ["T\nOne"] * len(odd)


def test_op10(spark, docs, ids):
    rows = rows_of(spark, "op10_best_fit_packing")
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r["length"]))
    assert set(by) == set(docs)
    for i, parts in by.items():
        at = 0
        for k, r in enumerate(sorted(parts, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == crc(ids[i][at : at + r["length"]])
            assert r["length"] == 2048 or k == 0
            at += r["length"]
        assert at == len(ids[i])
    for parts in sequences.values():
        ends = list(itertools.accumulate((n for _, n in sorted(parts)), initial=0))
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    bins = []  # plain best fit, longest first
    for n in sorted((r["length"] for r in rows), reverse=True):
        fits = [k for k, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= n
        else:
            bins.append(2048 - n)
    assert len(sequences) <= len(bins)


def test_op10_of_repeated_rows(spark):
    rows = [(None, "same text")] * 40 + [(1, None), (1, ""), (1, "same text")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = packing.pack(df, length=16, max_docs=3).collect()
    assert len(got) == len(rows) and len({(r.sequence_id, r.offset) for r in got}) == len(rows)
    assert max(collections.Counter(r.sequence_id for r in got).values()) == 3
    dealt = sharding.shard(df).collect()
    assert sorted(collections.Counter((r.shard, r.slot) for r in dealt).values()) == [1] * len(rows)


def test_op1_long_texts_and_names(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, two = (quality_rules.base_counts(df, packed=p).drop("text").collect() for p in (quality_rules.PACKED, 4))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    names = "doc_id bigint, text string, source string, host string, t0 string, t1 int, lines string, row int, clean_text string"
    rows = [(i, f"Cookie Notice here\nown words {i}\n", "s", "h", "a", 1, "b", 2, "c") for i in range(30)]
    out = quality_rules.clean_texts(spark.createDataFrame(rows, names))
    assert sorted(tuple(r) for r in out.collect()) == sorted((*r[:-1], f"own words {r[0]}\n") for r in rows)
    assert out.columns == spark.createDataFrame([], names).columns


# --- the pipeline -------------------------------------------------------------

NAMES = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, predicted int, t0 double, `_key` string, key int, n string, `a.b` int"


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(21)
    real = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()
    some = " ".join(f"the{rng.randrange(300)}" for _ in range(90))
    texts = [(r.doc_id, r.text) for r in real] + [(1000, some), (1000, some), (1000, some), (1001, some + " more"), (None, some), (None, some), (None, None), (None, None), (1002, ""), (1003, None), (1000, real[0].text), (999, "password=hunter2hunter2 " + some[::-1])]
    return spark.createDataFrame([(i, t, None if k % 2 else "en", None, None if t is None else len(t), "mine", k % 3, None, "x", 5, None, 8) for k, (i, t) in enumerate(texts)], NAMES)


def test_pipeline_on_awkward_rows(spark, awkward):
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    def run(name, df):
        out = stages[name](spark, df, SF)
        assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString(), name
        return sorted(map(tuple, out.collect()), key=repr)

    rows = sorted(map(tuple, awkward.collect()), key=repr)
    model = quality_classifier.train(awkward, labels)
    score = (lambda t: model["constant"]) if "constant" in model else (lambda t: plain_score(t, model))
    assert run("quality_classifier", awkward) == [r for r in rows if score(r[1] or "") >= 0.3]
    # one row of each group: the smallest id, null after all others; equal rows once
    first = {}
    for r in rows:
        first.setdefault((r[0] is None, r[0] or 0, r[1] or "", r[1] is None), r)
    keys = sorted(first)
    root = brute_components([(k, key[2]) for k, key in enumerate(keys)])
    kept = run("near_dedup", awkward)
    groups = collections.defaultdict(list)
    for k, key in enumerate(keys):
        groups[root[k]].append(key)
    assert len(kept) == len(groups)
    for members in groups.values():
        best = min(m[:2] for m in members)
        assert sum((r[0] is None, r[0] or 0, r[1] or "", r[1] is None) in members and (r[0] is None, r[0] or 0) == best for r in kept) >= 1
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {i: shingle_set(t) for i, t in items}
    leaks = lambda t: plain_leaks(t, [x for x in items if 100 * len(grams[x[0]] & shingle_set(t)) >= 50 * len(grams[x[0]])])
    assert run("decontamination", awkward) == [r for r in rows if not leaks(r[1] or "")]
    redacted = run("secret_scans", awkward)

    def plain_redact(t):
        out, at = [], 0
        for k, s, e in plain_base(t):
            if s >= at:
                out += [t[at:s], f"[{k.upper()}]"]
            at = max(at, e)
        return "".join(out) + t[at:]

    want = [(r[0], None if r[1] is None else plain_redact(r[1]), r[2], r[3], None if r[1] is None else len(plain_redact(r[1])), *r[5:]) for r in rows]
    assert not any(x[2].startswith("random") for r in rows for x in secrets.scan(r[1] or "")) and redacted == sorted(want, key=repr)
    packed = stages["best_fit_packing"](spark, awkward, SF).collect()
    tok = tokenizer()
    size = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    assert sum(r["length"] for r in packed) == sum(size(r[1]) for r in rows)


def test_pipeline_on_an_empty_table(spark, awkward):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward.where("false"), SF)
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == awkward.columns)


def test_pipeline_run(spark, monkeypatch):
    """All folders that it makes go, but for that of its last stage; those of others stay."""
    from scholarflow.llm import _spark as S

    made, folder = [], S.Scope.folder
    monkeypatch.setattr(S.Scope, "folder", lambda self: made.append(folder(self)) or made[-1])
    mine = S.save(spark.range(3), "mine")
    with S.scope(spark):
        out = corpus_pipeline.run(spark, SF)
        there = [p for p in made if os.path.exists(p)]
        assert len(made) > 20 and mine.count() == 3 and [os.listdir(p) for p in there] == [["mine"], ["best_fit_packing"]]
        assert out.columns == packing.pack(spark.createDataFrame([], "doc_id bigint, text string")).columns and out.count() > 0
    assert [p for p in made if os.path.exists(p)] == made[:1]
