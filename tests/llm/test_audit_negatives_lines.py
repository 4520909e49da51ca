"""The filter audit, hard negatives and line dedup: against SQL, against plain versions, and over odd tables."""

import hashlib
import itertools
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import filter_audit, hard_negatives, line_runs
from meterlake.llm.queries import ORACLES, QUERIES
from tests.llm.test_contracts import CLASH, odd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_hard_negatives", "op13_line_dedup"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    want = con.execute(ORACLES[name])
    cols = [c[0] for c in want.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(cols)
    rows = sorted(repr(tuple(r)) for r in got.select(*cols).collect())
    assert rows and rows == sorted(map(repr, want.fetchall()))


# The audit.


def audit_plain(docs, labels):
    """Of (doc_id, text, lang) and (doc_id, quality, toxic): every order walked document by document, as filters A to E say."""
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in (0, 1))
    smallest = {}
    for d, t, _ in docs:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    known = []
    for d, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > smallest[t]}
        known.append((lang or "", frozenset(k for k, v in fails.items() if v), d in good, d in toxic))
    out, total = {}, {}
    for part in {k[0] for k in known}:
        mine = [k[1:] for k in known if k[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for i, f in enumerate(order, 1):
                gone = [k for k in left if f in k[0]]
                left = [k for k in left if f not in k[0]]
                out[part, "".join(order), i] = [len(left), len(gone), sum(f in k[0] for k in mine) - len(gone), sum(k[0] == {f} for k in mine), sum(k[1] for k in gone), sum(k[2] for k in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string") if isinstance(docs, list) else docs
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit("x")).withColumn("good", F.lit("x"))
    f = filter_audit.text_filters()
    rows = filter_audit.audit(filter_audit.failures(d, lab, f), "ABCDE").collect()
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}


def test_audit_plain(spark):
    rng = random.Random(3)
    texts = ["", None, "a # b", "x " * 300, " ".join(f"w{i}" for i in range(250)), "AB " * 220, "é % " + " ".join(f"v{i}" for i in range(201)), "\t\n", " ".join(f"W{i}" for i in range(230)) + "|"]
    docs = [(rng.choice([None, *range(12), *range(12)]), rng.choice(texts), rng.choice(["en", "de", "", None])) for _ in range(150)]
    labels = [(rng.choice([None, *range(15)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(25)]
    got = audit_rows(spark, docs, labels)
    assert got == audit_plain(docs, labels) and len(got) == 600 * 3
    for part in ("en", "de", ""):  # the Shapley values share out all that goes
        first = {k[1][0]: v[-1] for k, v in got.items() if k[0] == part and k[2] == 1}
        n = sum((d[2] or "") == part for d in docs)
        assert sum(first.values()) == math.factorial(5) * (n - next(v[0] for k, v in got.items() if k[0] == part and k[2] == 5))


def test_audit_of_other_filters(spark):
    """Three masks, from counts alone; a polynomial of one term in a part."""
    counts = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 4, 2, 1), ("p", 6, 7, 0, 7), ("q", 4, 1, 1, 1)], "part string, mask int, n bigint, good bigint, toxic bigint")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.audit(counts, "XYZ").collect()}
    assert len(got) == 12 + 24 and got["p", "XYZ", 1]["removed"] == 4 and got["p", "XYZ", 2]["removed"] == 7 and got["p", "XYZ", 3]["redundant"] == 7
    assert {f: got["p", o, 1]["shapley"] for f, o in (("X", "XYZ"), ("Y", "YXZ"), ("Z", "ZXY"))} == {"X": 12, "Y": 33, "Z": 21} and got["q", "ZXY", 1]["shapley"] == 6


def test_audit_odd_tables(spark):
    d = odd(spark, (*CLASH, "part", "mask", "text_", "good", "toxic", "words_", "least", "first"))
    plain = [(r["doc_id"], r["text"], r["lang"]) for r in d.collect()]
    labels = [(1, 1, 1), (1, 0, None), (None, 1, 1), (7, None, 1), (99, 1, 1)]
    assert audit_rows(spark, d, labels) == audit_plain(plain, labels)
    assert audit_rows(spark, d.limit(0), []) == {} and audit_rows(spark, d, []) == audit_plain(plain, [])


# Hard negatives.


def mined_plain(rows, anchor=lambda i: i % 10 == 0, k=5):
    """Of (vec_id, label, vector), as the docstring says."""
    fine = [(i, lab, [min(max(math.floor(256 * x), -(1 << 24)), 1 << 24) for x in v]) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, lab, q in fine:
        if anchor(i):
            anchors[i] = min(anchors.get(i, (lab, len(q), q)), (lab, len(q), q))
    out = set()

    def first(found):
        best = {}
        for i, s in found:
            best[i] = max(s, best.get(i, s))
        return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]

    for a, (lab, dim, q) in anchors.items():
        scored = [(i, x, sum(map(int.__mul__, q, v))) for i, x, v in fine if len(v) == dim and i != a]
        for p, s in first([(i, t) for i, x, t in scored if x == lab]):
            for r, (n, t) in enumerate(first([(i, t) for i, x, t in scored if x != lab and 80 * s <= 100 * t <= 100 * s]), 1):
                out.add((a, p, r, n, s, t))
    return out


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id bigint, label int, embedding array<{kind}>").selectExpr("*", "'x' AS q", "'x' AS dim", "'x' AS spot", "'x' AS codes", "'x' AS score")


def mined(spark, rows, **more):
    return {tuple(r) for r in hard_negatives.mine(hard_negatives.integers(vectors(spark, rows)), F.col("vec_id") % 10 == 0, **more).collect()}


def test_negatives_plain(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(4, 10))
    rows = [(int(i), int(lab), [float(x) for x in centre[lab % 4] * 0.4 + rng.normal(size=10) * 0.3]) for i, lab in enumerate(rng.integers(0, 6, 900))]
    want = mined_plain(rows)
    assert len(want) > 400 and mined(spark, rows) == want
    books = hard_negatives.train(hard_negatives.integers(vectors(spark, rows)))
    assert books[10].shape == (3, hard_negatives.CENTRES, 4)
    # small blocks, other counts, and no centres at all
    for name, value in (("ROWS", 100), ("ANCHORS", 7), ("LEAST_BLOCKS", 2), ("PAIRS", 150)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert mined(spark, rows, books={}, k=3) == mined_plain(rows, k=3)


def test_bounds_hold():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    for dim in (1, 4, 7, 64):
        q = np.floor(rng.normal(size=(600, dim)) * 10 ** rng.uniform(0, 4, (600, 1))).astype(np.int64)
        for books in ({}, {dim: hard_negatives.fitted(q[:300].astype(float))}):
            book = hard_negatives.book_of(books, dim)
            x = hard_negatives.parts(q.astype(float))
            code = np.stack([hard_negatives._nearest(x[:, s], book[s]) for s in range(x.shape[1])], axis=1).astype(np.uint8)
            rest = np.stack([np.linalg.norm(x[:, s] - book[s][code[:, s]], axis=1) for s in range(x.shape[1])], axis=1)
            left = np.nextafter((rest * (1 + 1e-6)).astype(np.float32), np.float32(np.inf))
            t = pa.table({"vec_id": pa.array(range(600)), "label": pa.array([0] * 600), "q": pa.array(q.astype(np.int32).tolist(), pa.list_(pa.int32())),
                          "codes": pa.array([c.tobytes() for c in code], pa.binary()), "left": pa.array([r.tobytes() for r in left], pa.binary())})
            low, high = hard_negatives.Block(t, dim, books).bounds(q[:50])
            true = q[:50] @ q.T
            assert (low <= true).all() and (true <= high).all()
            if books and dim >= 4:  # trained centres bound more closely than none
                assert (high - low).mean() < 0.9 * 2 * (np.linalg.norm(q[:50], axis=1)[:, None] * np.linalg.norm(q, axis=1)).mean()


def test_negatives_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (0, 2, [0.1, 3.0]), (1, 1, [1.0, 0.5]), (2, 1, [1.0, 0.5]), (2, 1, [1.0, 0.25]), (3, 2, [1.0, 0.4]), (3, 2, [1.0, 0.45]), (4, 3, [1.0, 0.5]), (5, 3, [-1.0, 0.5]),
            (None, 1, [1.0, 1.0]), (6, None, [1.0, 1.0]), (7, 1, None), (8, 2, [None, 1.0]), (9, 2, [nan, 1.0]), (11, 2, [inf, 0.0]), (12, 2, [-0.001, 0.0]), (13, 1, [1.0, 1.0, 1.0]), (10, 1, [2.0, 2.0, 2.0]),
            (14, 2, [1.0, 0.9, 1.0]), (20, 5, []), (21, 5, []), (22, 6, []), (30, 4, [1e9, -1e9]), (31, 4, [1e9, -1e12]), (32, 5, [7e4, -7e4]), (40, 7, [1.0, 0.0]), (41, 7, [-1.0, 0.0]), (42, 8, [-1.0, 0.0])]
    want = mined_plain(rows)
    assert {x[0] for x in want} == {0, 10, 20, 30} and mined(spark, rows) == want  # ties by id; a window below a negative score is empty
    assert mined(spark, []) == set() and mined(spark, [(0, 1, [1.0])]) == set()
    floats = hard_negatives.integers(vectors(spark, [(1, 1, [0.1, -0.1])], "float")).first()["q"]
    assert floats == [25, -26]


# Line dedup.


def lines_plain(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(d)
    out = []
    for d, t in docs:
        ls = (t or "").split("\n")
        stay = [x for x in ls if d is None or len(held.get(key(x), ())) < 3 or d == max(held[key(x)])]
        out.append((d, len(ls), len(ls) - len(stay), "\n".join(stay)))
    return sorted(map(repr, out))


def line_rows(docs, **more):
    return sorted(repr((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"])) for r in line_runs.dedup(docs, **more).collect())


def test_lines_plain(spark):
    rng = random.Random(8)
    pool = [f"the common line number {i} of many" for i in range(25)] + ["short", "", "ÉÀ " * 8, "éà " * 8, "日本語の長い行、二十文字を超えるように書きます。", "x" * 19, "y" * 20]

    def said(x):
        return rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.3 and x.isascii() else x) + rng.choice(["", "\r", "  "])

    docs = [(rng.choice([None, *range(60)]), rng.choice([None, "", *["\n".join(said(rng.choice(pool)) for _ in range(rng.randint(1, 9))) for _ in range(30)]])) for _ in range(150)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = lines_plain(docs)
    assert any("ÉÀ" in x for x in want) and line_rows(df) == want
    for batches, fanout in ((1, 2), (7, 2), (9, 3)):
        assert line_rows(df, batches=batches, fanout=fanout) == want


def test_runs_are_levelled_and_keep_no_settled_keys(spark):
    key = lambda *ids: spark.createDataFrame([(1, 1, i) for i in ids] + [(100 + i, 2, i) for i in ids], "h1 bigint, h2 bigint, doc_id bigint")
    r = line_runs.Runs(spark, least=3, fanout=3)
    r.add(key(90, 91, 92, 92))
    assert [spark.table(n).count() for n in r.names()] == [4]
    r.add(key(80, 81))  # the key (1, 1) is settled
    assert sorted(spark.table(n).count() for n in r.names()) == [2, 4]
    r.add(key(95))  # a larger document than any before: its key counts anew
    assert [len(x) for x in r.levels] == [0, 1] and spark.table(r.names()[0]).count() == 7
    assert [tuple(x) for x in r.common().collect()] == [(1, 1, 4, 95)]
    scan = spark.table(r.names()[0])._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in scan or "Bucketed" in scan
    names = r.names()
    r.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_lines_odd_tables(spark):
    d = odd(spark, (*CLASH, "gone", "lines", "top", "h1", "keys"))
    assert line_rows(d) == lines_plain([(r["doc_id"], r["text"]) for r in d.collect()])
    assert line_rows(d.limit(0)) == []
    long = "\n".join(f"line {i % 700} of a very long text, repeated" for i in range(40_000))
    docs = [(i, long) for i in range(4)]
    assert line_rows(spark.createDataFrame(docs, "doc_id bigint, text string")) == lines_plain(docs)
    hashed = line_runs.dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).select(F.sha2("kept", 256).alias("s"), "doc_id").collect()
    assert {r["doc_id"]: r["s"] for r in hashed}[3] == hashlib.sha256(long.encode()).hexdigest()


# What the tally of tokens and HTML extraction have since.


@pytest.mark.parametrize("group", [2, 5, 64])
def test_tally_by_a_grid_gives_the_same(spark, monkeypatch, group):
    from meterlake.llm import jaccard, substrings, tally

    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(60)]
    rows = [(i, rng.choice(base) if rng.random() < 0.3 else " ".join(rng.choice(base).split()[: rng.randint(20, 40)] + rng.choice(base).split()[: rng.randint(0, 6)])) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    straight = [sorted(map(tuple, f(d).collect())) for f in (jaccard.join, substrings.dedup)]
    monkeypatch.setattr(tally, "group_of", lambda n: group)
    assert [sorted(map(tuple, f(d).collect())) for f in (jaccard.join, substrings.dedup)] == straight
    assert any(r[3] for r in straight[0]) and any(r[2] for r in straight[1])


def test_blocks_hold_a_thousand_tokens_at_any_size():
    from meterlake.llm import tally

    for n in (10**9, 3 * 10**10, 10**12, 10**14):
        batches, buckets = tally.sizes(n)
        assert n / batches / tally.TOKEN_BYTES / buckets * tally.group_of(n) >= 990
    assert tally.group_of(0) == tally.group_of(10**8) == 1


def test_a_join_leaves_its_result_only(spark):
    from meterlake.llm import jaccard
    from meterlake.llm.common import shared_dir

    top = shared_dir(spark).removeprefix("file://") + "/meterlake"
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    jaccard.join(spark.createDataFrame([(i, f"one two three four five six {i % 3}") for i in range(20)], "doc_id bigint, text string")).collect()
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(top)) - before}
    assert left == {"result"}


def test_html_recurrence_over_whole_pages(spark):
    from meterlake.llm import html_text

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    large = pages.unionByName(pages.selectExpr("page_id + 1000000 AS page_id", "url", "replace(html, 'the', 'dhe') AS html")).unionByName(pages.selectExpr("page_id + 2000000 AS page_id", "url", "replace(html, 'an', 'un') AS html"))
    got = html_text.main_text(large.filter("html IS NOT NULL")).select(F.sum("template_blocks").alias("n"), F.count("*").alias("all")).first()
    assert got["all"] > 0 and got["n"] is not None
    page = "<body><div class=x1><p>Our site {1}</p></div><article><h1>Title {0}</h1><div class=alert>Mind {0}</div><p class=banner>Buy {0}</p><div role=complementary>More {0}</div><p>Text {0}</p></article></body>"
    rows = [(i, "http://h/a", page.format(i, "says hello")) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert [(r["text"], r["template_blocks"]) for r in html_text.main_text(df).orderBy("page_id").collect()] == [(f"Title {i} Text {i}", 1) for i in range(6)]
    # an element that recurs is gone before the main content is chosen
    page = "<body><article><p>Read our other stories now</p></article><div><p>Story {0} is long and told here</p></div></body>"
    rows = [(i, "http://h/a", page.format(i)) for i in range(8)]
    texts = [r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).orderBy("page_id").collect()]
    assert texts == ["Read our other stories now"] * 8  # nothing is left of the content there: copies of it, and no template
