"""The classifier against a plain version, and bounds that must not show in results."""

import math

import numpy as np
import pyarrow.parquet as pq

from meterlake.llm import bpe, langid, lattice, mixing

DATA = "/root/testdata/sf0.001"


def plain_grams(text):
    """Places of the n-grams of 1 to 3 characters with their counts, one by one."""
    out, mask = {}, (1 << 64) - 1
    p = [ord(c) for c in f" {text} "]
    for n in range(langid.NGRAMS):
        for i in range(len(p) - n):
            h = 0
            for x in p[i : i + n + 1]:
                h = (h * 0x9E3779B97F4A7C15 + x) & mask
            h = (h + 0x9E3779B97F4A7C15 * (n + 1)) & mask
            h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & mask
            h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & mask
            at = (h ^ (h >> 31)) % langid.DIM
            out[at] = out.get(at, 0) + 1
    return out


def plain_softmax(z):
    top = max(z)
    e = [math.exp(x - top) for x in z]
    return [x / sum(e) for x in e]


def plain_model(rows, df, n_docs):
    """FTRL-proximal coordinate by coordinate, weights from sums of gradients when they are needed, then the temperature of least loss."""
    langs = sorted({lang for _, lang in rows})

    def features(grams):
        x = {i: math.log1p(n) * (math.log((1 + n_docs) / (1 + df.get(i, 0))) + 1) for i, n in grams.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {i: v / norm for i, v in x.items()}

    made = [(features(grams), langs.index(lang)) for grams, lang in rows]
    learn, judge = [r for i, r in enumerate(made) if i % 5 != 4], [r for i, r in enumerate(made) if i % 5 == 4]
    z, n = [{} for _ in langs], [{} for _ in langs]

    def weight(k, i):
        s = z[k].get(i, 0.0)
        if abs(s) <= langid.L1:
            return 0.0
        return -math.copysign(abs(s) - langid.L1, s) / ((langid.BETA + math.sqrt(n[k].get(i, 0.0))) / langid.ALPHA + langid.L2)

    for _ in range(langid.EPOCHS):
        for x, y in learn:
            x = x | {"bias": 1.0}
            w = [{i: weight(k, i) for i in x} for k in range(len(langs))]
            p = plain_softmax([sum(w[k][i] * v for i, v in x.items()) for k in range(len(langs))])
            for k in range(len(langs)):
                for i, v in x.items():
                    g = (p[k] - (k == y)) * v
                    old = n[k].get(i, 0.0)
                    z[k][i] = z[k].get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / langid.ALPHA * w[k][i]
                    n[k][i] = old + g * g
    scores = lambda x: [sum(weight(k, i) * v for i, v in x.items()) + weight(k, "bias") for k in range(len(langs))]
    loss = lambda t: sum(-math.log(plain_softmax([s / t for s in scores(x)])[y]) for x, y in judge) / len(judge)
    steps = [0.05 * (20 / 0.05) ** (i / 120) for i in range(121)]
    best = min(steps, key=loss)

    def predict(grams):
        p = plain_softmax([s / best for s in scores(features(grams))])
        return langs[p.index(max(p))], max(p)

    return langs, weight, best, predict, loss


def test_language_id_against_plain_ftrl(spark):
    got = [r for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist() if r["lang"] and r["text"]]
    rows = [(r["doc_id"], r["text"][:300], r["lang"]) for r in got]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    known = [r["text"] for r in df.filter(~langid.held_out()).select(langid.normal(df["text"]).alias("text")).filter("text != ''").collect()]
    grams = [plain_grams(t) for t in known]
    for t, g in zip(known[:20], grams):
        at, n = langid.count_grams(t)
        assert dict(zip(at.tolist(), n.tolist())) == g
    want = {}
    for g in grams:
        for i in g:
            want[i] = want.get(i, 0) + 1
    seen = langid.document_frequencies(spark.createDataFrame([(t,) for t in known], "text string").repartition(7))
    assert {i: int(seen[i]) for i in np.flatnonzero(seen).tolist()} == want
    langs_of = [r["lang"] for r in df.filter(~langid.held_out()).withColumn("t", langid.normal(df["text"])).filter("t != ''").collect()]
    sample = list(zip(grams, langs_of))[:80]
    model = langid.fit([(np.array(sorted(g)), np.array([g[i] for i in sorted(g)]), lang) for g, lang in sample], seen, len(known))
    langs, weight, best, predict, loss = plain_model(sample, want, len(known))
    assert model.langs == langs and len(langs) > 1
    plain = np.array([[weight(k, i) for i in range(langid.DIM)] for k in range(len(langs))])
    assert np.allclose(model.weights, plain, atol=1e-9) and np.allclose(model.bias, [weight(k, "bias") for k in range(len(langs))], atol=1e-9)
    assert ((model.weights == 0) == (plain == 0)).all() and 0 < (plain != 0).sum() < plain.size  # the penalty leaves the same places at zero
    assert abs(loss(model.temperature) - loss(best)) < 1e-9
    judged = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    texts = {r["doc_id"]: r["t"] for r in df.withColumn("t", langid.normal(df["text"])).collect()}
    for i, t in texts.items():
        if t:
            lang, score = predict(plain_grams(t))
            assert judged[i]["lang_pred"] == lang and abs(judged[i]["score"] - score) < 1e-6


def test_frequencies_are_of_all_rows_and_every_language_is_learned(spark, monkeypatch):
    rows = [(i, f"alpha beta {chr(97 + i % 26)}", "en" if i % 2 else "fr") for i in range(400)] + [(900, "gamma delta", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    asked = []
    monkeypatch.setattr(langid, "fit", lambda sample, seen, n: asked.append((len(sample), seen.max(), n)))
    langid.train(df, rows=20)
    free = df.filter(~langid.held_out()).filter("lang IS NOT NULL").count()
    assert asked == [(20, free, free)]
    assert langid.quotas({f"l{i:04}": 1 + i for i in range(3000)}, 2000) == {f"l{i:04}": 1 for i in range(3000)}


def test_bpe_bounds_change_nothing(monkeypatch):
    import public_tokenizers
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = ["one\ntwo\n\n three\tfour " * 40, "ab\n" * 300, "x" * 500 + "\n" * 300 + "y", "don't\x1cstop \x1f 's\n's it's\n\n" * 30, "é ü 日本\n語 😀\n" * 40, "!?\n" * 200, "12 34\n56\r\n" * 50]
    cut = bpe.chunks
    assert len(cut("ab\n" * 300, 7)) > 50 and all("".join(cut(t, 7)) == t for t in texts)
    monkeypatch.setattr(bpe, "chunks", lambda t: cut(t, 7))
    for most, chars in ((1 << 18, 1 << 23), (3, 1 << 23), (1 << 18, 10)):
        monkeypatch.setattr(bpe, "CACHE", most)
        monkeypatch.setattr(bpe, "CACHE_CHARS", chars)
        codec = bpe.Codec(bpe.default_spec())
        for t in texts:
            assert codec.encode(t).tolist() == enc.encode_ordinary(t)
            assert codec.held == sum(map(len, codec.known))
            part = max(map(len, cut(t, 7)))  # one chunk's matches are held whatever the bound
            assert codec.held <= max(chars, part) and len(codec.known) <= max(most, part)


def test_lattice_ids_that_repeat_or_miss(spark):
    x, y = [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.001]
    rows = [(5, x, 1), (5, x, 1), (5, y, 1), (None, x, 1), (None, None, 1), (7, x, 2), (7, y, 2), (9, [-1.0, 5.0, 0.0, 0.0], 1), (9, y, 3)]
    got = lattice.dedup(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1) for r in got) == sorted(
        [(5, 3, 5), (5, 3, 5), (5, 3, 5), (-1, 3, 5), (-1, 0, -1), (7, 1, 7), (7, 1, 7), (9, 0, 9), (9, 0, 9)])


def test_mix_by_either_join(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    made = lambda: sorted(map(repr, mixing.mix(docs).select("doc_id", "source", "size", "target", "taken").collect()))
    want = made()
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 0)
    assert made() == want
