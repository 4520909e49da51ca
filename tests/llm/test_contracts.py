"""Operators and stages against plain versions, and what each does with odd tables."""

import hashlib
import random
import re
from fractions import Fraction

import pytest

from meterlake.llm import bpe, chat, fingerprints, html_text, jaccard, langid, lattice, mixing, secret_scan, substrings
from tests.llm.test_operators import WORD, docs, fixture_rows, html_texts

#: Columns that are named like what operators make inside.
CLASH = ("size", "target", "source_size", "rounds", "whole", "extra", "kept", "words", "mixed", "__id", "component", "component_id", "t1", "t2", "batch", "cls", "n", "key", "hash", "spans", "id", "lang_pred_", "cell", "bucket")


def odd(spark, extra=CLASH):
    """Nulls in every column, empty and blank texts, repeated rows and ids, ties, one long text, and columns with clashing names."""
    long = "word and token=abcdef123 " * 20_000
    rows = [(1, "one two three four five six", "en", "a", 5), (1, "one two three four five six", "en", "a", 5), (1, "another text of the same id", "de", "b", 5), (None, "one two three four five six", None, None, None),
            (None, None, None, None, None), (2, None, "en", "a", 0), (3, "", "en", None, 0), (4, " \t\n", "", "", 3), (5, long, "en", "a", len(long)), (6, "ONE two THREE four five six", "en", "c", 1), (7, "日本語 é 😀" * 5, "xx", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in extra])


OPERATORS = {
    "jaccard": (jaccard.join, 11), "substrings": (substrings.dedup, 11), "scan": (secret_scan.scan, 11), "redact": (secret_scan.redact, 11), "mix": (mixing.mix, 11), "bpe": (bpe.digests, 11),
    "fingerprint": (fingerprints.fingerprint, 11), "edits": (lambda d: fingerprints.compare_edits(fingerprints.with_next(d)), 11), "langid": (lambda d: langid.predict(d, langid.train(d)), 11),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(spark, name):
    make, n = OPERATORS[name]
    got = make(odd(spark))
    rows = [r.asDict() for r in got.collect()]
    assert len(rows) == n
    one = [r for r in rows if r["doc_id"] == 1]
    if name in ("jaccard", "scan", "bpe", "redact", "langid", "fingerprint", "substrings"):  # repeated rows have equal results
        assert any(a == b for i, a in enumerate(one) for b in one[i + 1 :])
    if name in ("redact", "langid", "fingerprint"):
        assert set(CLASH) <= set(got.columns) and all(r["size"] == "x" for r in rows)


def test_odd_results(spark):
    d = odd(spark)
    j = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.join(d).collect() if r["doc_id"] not in (5, 7) and r["component_id"] is not None)
    assert j == [(-1, 2, 1, 3), (1, 2, 1, 0), (1, 2, 1, 3), (1, 2, 1, 3), (2, 0, 2, 0), (3, 0, 3, 0), (4, 0, 4, 0), (6, 2, 1, 3)]
    s = [r for r in secret_scan.scan(d).collect() if r["doc_id"] == 5][0]
    assert len(s["base"]) == 20_000 and s["base"][19_999]["start"] == 19_999 * 25 + 9
    w = {r["doc_id"]: r for r in mixing.mix(d).collect()}
    assert w[2]["size"] == w[2]["taken"] == w[3]["size"] == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_with_odd_tables(spark, stage):
    import corpus_pipeline

    name, f = corpus_pipeline.STAGES[stage]
    d = odd(spark)
    got = f(spark, d, "")
    rows = got.collect()
    if stage < 4:
        assert got.columns == d.columns and all(r["size"] == r["kept"] == "x" for r in rows)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    want = {1: [(False, i) for i in (1, 1, 2, 3, 4, 5, 7)] + [(True, 0)], 2: [(False, i) for i in (1, 1, 1, 2, 3, 4, 5, 6, 7)] + [(True, 0)] * 2, 4: [(False, i) for i in (1, 1, 1, 2, 3, 4, 5, 6, 7)] + [(True, 0)] * 2}
    if stage in want:
        assert ids == want[stage]
    else:
        assert {2, 3, 4}.isdisjoint(r["doc_id"] for r in rows)
    assert f(spark, d.limit(0), "").collect() == []


def test_pipeline_against_a_plain_version(spark, tmp_path):
    import public_tokenizers
    import pyarrow.parquet as pq
    import tiktoken

    import corpus_pipeline

    docs_in = [r for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    base = next(r for r in docs_in if r["text"] and len(r["text"].split()) > 60)
    docs_in += [base | {"doc_id": 10_000 + i, "text": base["text"] + f" extra{i}" * i} for i in range(4)] + [base | {"doc_id": 10_010, "text": "12 34"}, base | {"doc_id": 10_011, "text": f"{base['text'][:200]} password: hunter22x ."}]
    spark.createDataFrame(docs_in, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    outs = []
    for name, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.durable(f(spark, docs, str(tmp_path)), name)
        outs.append([r.asDict() for r in docs.collect()])
    lang, join, clean, mixed, coded = outs
    judged = {r["doc_id"]: r for r in langid.predict(spark.read.parquet(f"{tmp_path}/documents.parquet"), langid.train(spark.read.parquet(f"{tmp_path}/documents.parquet"))).collect()}
    assert {r["doc_id"] for r in lang} == {i for i, r in judged.items() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.MIN_SCORE} and 10_010 not in {r["doc_id"] for r in lang}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in lang:
        w = WORD.findall((r["text"] or "").translate(low))
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    least = {}
    for i in sorted(sets):
        todo = [] if i in least else [i]
        while todo:
            x = todo.pop()
            if x not in least:
                least[x] = i
                todo += [b for b, y in sets.items() if b not in least and sets[x] and 100 * len(sets[x] & y) >= 75 * len(sets[x] | y)]
    assert {r["doc_id"] for r in join} == set(least.values())
    assign, access, hexes = (re.compile(p) for p in (secret_scan.ASSIGN, secret_scan.ACCESS, secret_scan.HEX))
    text = {r["doc_id"]: r["text"] for r in clean}
    for r in join:
        found = [(m.start(), m.end()) for p in (assign, access, hexes) for m in p.finditer(r["text"] or "") if p is not assign or len(m[2]) >= 6]
        for a, b in found:
            assert r["text"][a:b] not in text[r["doc_id"]]
        if not found:
            assert text[r["doc_id"]] == r["text"]
    assert set(text) == {r["doc_id"] for r in join} and ("hunter22x" not in text.get(10_011, ""))
    size = {i: len(WORD.findall(t or "")) for i, t in text.items()}
    source = {r["doc_id"]: r["source"] for r in clean}
    totals = {s: sum(n for i, n in size.items() if source[i] == s) for s in set(source.values())}
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, plain_targets([totals[s] for s in names])))
    taken = {s: sum(len(WORD.findall(r["text"])) for r in mixed if r["source"] == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= 0.02 * float(target[s]) + 2 * mixing.BLOCK_WORDS for s in names)
    for r in mixed:
        own = set(WORD.findall(text[r["doc_id"]]))
        assert set(WORD.findall(r["text"])) <= own and len(WORD.findall(r["text"])) <= 2 * size[r["doc_id"]]
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    said = {r["doc_id"]: r["text"] for r in mixed}
    assert {r["doc_id"] for r in coded} == set(said)
    for r in coded:
        assert list(r["ids"]) == enc.encode_ordinary(said[r["doc_id"]]) and r["decoded_sha256"] == hashlib.sha256(said[r["doc_id"]].encode()).hexdigest()


def plain_targets(sizes):
    """Targets in fractions: what exceeds the cap is shared anew among the others by weight."""
    weights = [Fraction(mixing.WEIGHTS[i % 3]) for i in range(len(sizes))]
    total, fixed = Fraction(3, 2) * sum(sizes), {}
    while len(fixed) < len(sizes):
        left = total - sum(fixed.values())
        share = {i: left * weights[i] / sum(weights[j] for j in range(len(sizes)) if j not in fixed) for i in range(len(sizes)) if i not in fixed}
        over = [i for i in share if share[i] > 2 * sizes[i]]
        if not over:
            fixed |= share
        fixed |= {i: Fraction(2 * sizes[i]) for i in over}
    return [fixed[i] for i in range(len(sizes))]


def test_targets_and_quotas_against_plain_versions():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 5, rng.randrange(1, 10_000)]) for _ in range(rng.randrange(1, 9))]
        got = mixing.capped_targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes), 2)
        assert got == pytest.approx([float(x) for x in plain_targets(sizes)])
        votes, most = [rng.choice([0, 1, 2, 2, rng.random() * 100]) for _ in sizes], [rng.randrange(0, 12) for _ in sizes]
        seats = rng.randrange(0, 40)
        won = [0] * len(votes)
        for _ in range(seats):  # the next seat goes to the highest quotient, the earlier of equal ones
            open_ = [(-v / (2 * w + 1), i) for i, (v, w, m) in enumerate(zip(votes, won, most)) if v > 0 and w < m]
            if open_:
                won[min(open_)[1]] += 1
        assert mixing.sainte_lague(votes, seats, most) == won


def test_mix_against_recomputed_targets(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in table}
    names = sorted({r["source"] for r in table}, key=lambda s: (s is None, s or ""))
    total = [sum(size[r["doc_id"]] for r in table if r["source"] == s) for s in names]
    target = dict(zip(names, map(float, plain_targets(total))))
    got = mixing.op9_mixing(spark, "/root/testdata/sf0.01").collect()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == total[names.index(r["source"])]
    for s in names:
        assert sum(r["taken"] for r in got if r["source"] == s) == pytest.approx(target[s], abs=0.01 * target[s] + 2 * mixing.BLOCK_WORDS)


def test_fingerprints_against_plain_jaccard(spark):
    rows = [(i, t) for i, t in fixture_rows()]
    got = {r["doc_id"]: r for r in fingerprints.compare_edits(fingerprints.with_next(docs(spark, rows))).collect()}
    rows.sort()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def grams(t):
        w = WORD.findall(t.translate(low))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    def true(a, b):
        x, y = grams(a), grams(b)
        return 1.0 if not x and not y else len(x & y) / max(1, len(x | y))

    off = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert (r["fingerprint"] == r["edited_fingerprint"]) >= (t == new)
        off += [r["near_edited"] - true(t, new), r["near_next"] - true(t, after)]
    assert max(map(abs, off)) < 0.2 and abs(sum(off)) / len(off) < 0.02
    equal = {}
    for i, t in rows:
        assert equal.setdefault(t or "", got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_html_names():
    for name in ("ad", "ads", "comments", "comment-list", "relatedPosts", "related-posts", "cookie_notice", "social-share", "sidebar right", "newsletter-signup", "ad-slot-3"):
        assert html_text.names_no_article(name), name
    for name in ("related-work", "social-history", "adsorption", "notice-of-motion", "commentary", "content", "main", "post", "lead", "shared-values", "navy", ""):
        assert not html_text.names_no_article(name), name


def test_html_comments_and_named_blocks(spark):
    page = ('<body><article id="a1"><h1>Title {0}</h1><p>Text {0}</p><div class="related-work"><p>Related work {0}</p></div><section id="social-history"><p>History {0}</p></section>'
            '<article class="comment"><p>I disagree {0}</p></article><div class="related-posts">More {0}</div></article><article class="comment"><p>Me too {0}</p></article></body>')
    assert html_texts(spark, [("h", page.format(i)) for i in range(3)]) == [f"Title {i} Text {i} Related work {i} History {i}" for i in range(3)]


def test_html_template_against_a_plain_version(spark, monkeypatch):
    rng = random.Random(5)
    common = [f"<div>Sign up for letter {k}</div>" for k in range(4)]
    pages, want, plain = [], [], []
    held = {k: sorted(rng.sample(range(40), n)) for k, n in enumerate((40, 20, 13, 4))}  # on all, half, a third, a tenth of the host's pages
    for i in range(40):
        story = [f"<p>Story {i} part {j} says {rng.random()}</p>" for j in range(6)]
        mine = [k for k in held if i in held[k]]
        blocks = [*story, *[common[k] for k in mine]]
        rng.shuffle(blocks)
        pages.append(("h", f"<body><article>{''.join(blocks)}</article></body>"))
        read = [re.sub("<[^>]*>", "", b) for b in blocks]
        plain.append(" ".join(read))
        gone = {re.sub("<[^>]*>", "", common[k]) for k in mine if len(held[k]) >= max(html_text.MIN_PAGES, html_text.MIN_SHARE * 40)}
        want.append(" ".join(b for b in read if b not in gone))
    assert html_texts(spark, pages) == want != plain
    odd_rows = [(1, None, None), (1, None, None), (2, "u", ""), (None, "not a url", "<p>x"), (3, "http://h/", "<p>" + "long text " * 200_000)]
    df = spark.createDataFrame(odd_rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS host", "'y' AS text", "'z' AS key")
    got = [(r["page_id"], len(r["text"])) for r in html_text.main_text(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (1, 0), (2, 0), (None, 1), (3, 1_999_999)], key=str)


def test_chat_odd_logs(spark):
    empty = chat.render(chat.fold_events(spark.createDataFrame([], chat.EVENTS)))
    assert empty.collect() == []
    turns = spark.createDataFrame([(1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, None, None), (None, 0, "assistant", "<|im_end|>\n" * 3), (2, 0, "assistant", "x" * 100_000), (2, 0, "assistant", "")],
                                  "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'x' AS seq", "'y' AS op", "'z' AS part")
    events = chat.events_of_turns(turns)
    out = {r["conv_id"]: r for r in chat.render(chat.fold_events(events)).withColumn("back", chat.parse(chat.F.col("formatted"))).collect()}
    assert [tuple(t) for t in out[1]["back"]] == [("", ""), ("user", "a"), ("user", "a")]
    assert [tuple(t) for t in out[None]["back"]] == [("assistant", "<|im_end|>\n" * 3)] and [len(t["text"]) for t in out[2]["back"]] == [0, 100_000]


def test_chat_log_has_every_event(spark):
    turns = spark.createDataFrame([(i, t, "assistant" if t % 2 else "user", f"text {i} {t} é😀" * (t + 1)) for i in range(20) for t in range(4)], "conv_id bigint, turn bigint, role string, text string")
    events = chat.events_of_turns(turns)
    assert {r["op"] for r in events.select("op").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    back = chat.render(chat.fold_events(events)).select("conv_id", chat.parse(chat.F.col("formatted")).alias("back")).collect()
    assert {r["conv_id"]: [tuple(t) for t in r["back"]] for r in back} == {i: [("assistant" if t % 2 else "user", f"text {i} {t} é😀" * (t + 1)) for t in range(4)] for i in range(20)}


def test_ownership_decides(spark):
    live, upper, value = "Zx9Qw8Er7Ty6Ui5Op4As", "9233A8ECF7C5B09FE5949719B6B82BC4", "hunter22x"
    rows = [(1, f"key {live} here", "me/a"), (2, f"again {live}", "me/b"), (3, f"copied {upper}", "o1/a"), (4, f"copied {upper}", "o2/a"), (5, f"copied {upper}", "o3/a"),
            (6, f"password: {value}", "me/a"), (7, f"it is {value} in short", "me/c"), (8, "token=changeme1", "o1/a"), (9, "secret: changeme1", "o2/a"), (10, "token=changeme1 or changeme1", "o3/a"), (11, "plain words only a1b2c3d4", "me/a")]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"]: r for r in secret_scan.scan(df).withColumn("l", secret_scan.listed("spans")).collect()}
    assert got[1]["l"] == "owned:4:24" and got[2]["l"] == "owned:6:26" and got[7]["l"] == "owned:6:15" and got[11]["l"] == ""
    assert got[3]["l"] == "" and got[3]["n_copied"] == 1 and got[10]["l"] == "assign:0:15" and got[10]["n_copied"] == 2
    assert [tuple(v) for v in got[1]["verdicts"]] == [(True, 1, 2)] and [tuple(v) for v in got[8]["verdicts"]] == [(False, 3, 3)]
    few = {r["doc_id"]: r["l"] for r in secret_scan.scan(df, max_repos=1).withColumn("l", secret_scan.listed("spans")).collect()}
    assert few[1] == few[7] == ""  # one owner, but several repositories


def test_lattice_components_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    x = np.repeat(rng.standard_normal((30, 32)), 8, axis=0) + rng.standard_normal((240, 32)) * 0.1
    x[100:110] = x[0]
    df = spark.createDataFrame([(i, v.tolist(), i % 3, "x", "y") for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int, point string, n string")
    got = {r["vec_id"]: r for r in lattice.dedup(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.arange(240)[:, None] % 3 == np.arange(240) % 3)
    least = {}
    for i in range(240):
        todo = [] if i in least else [i]
        while todo:
            k = todo.pop()
            if k not in least:
                least[k] = i
                todo += np.flatnonzero(near[k]).tolist()
    assert sum(got[i]["n_links"] for i in range(240)) >= 0.98 * (near.sum() - 240)
    assert sum(got[i]["component_id"] == least[i] for i in range(240)) >= 0.97 * 240
    assert all(got[i]["n_links"] <= near[i].sum() - 1 and got[i]["kept"] == (got[i]["component_id"] == i) for i in range(240))


def test_language_quotas():
    assert langid.quotas({"a": 5, "b": 10_000, "c": 10_000}, 2000) == {"a": 5, "b": 997, "c": 998} and langid.quotas({}, 10) == {}


@pytest.mark.parametrize("name", ["op1_secret_scans", "op2_chat_formatting"])
def test_queries_against_sql(spark, name):
    import os

    import duckdb

    from meterlake.llm.queries import ORACLES, QUERIES

    data = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    want = con.execute(ORACLES[name])
    cols = sorted(c[0] for c in want.description)
    got = QUERIES[name](spark, data)
    assert sorted(got.columns) == cols
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(repr(tuple(dict(zip([c[0] for c in want.description], r))[c] for c in cols)) for r in want.fetchall())
