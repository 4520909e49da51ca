r"""Language ID: multinomial logistic regression on TF-IDF character n-grams, fitted by FTRL-proximal with
elastic-net penalties, then calibrated by a temperature.

Texts are put in lower case and every run of non-letters becomes one space; n-grams of 1 to 3 characters of
the whole text are counted in ``DIM`` hashed places.  The fit sees a bounded sample of labelled rows (``TRAIN_ROWS``
at most, or one a language if there are more languages; as many of each as far as it has them, least hash of id and text first), of which only the hashed counts
(``DIM`` places at most a row) reach the driver; a fifth of it fits the temperature alone.  Document frequencies are those of all rows that may be learned from: a task adds up
its own, and ``DIM`` sums reach the driver.  The model is ``DIM`` weights a language and is sent to the executors; prediction is one pass without a shuffle.

Defined results: a text that is null or has no letter is ``und`` with score 0; without any row to learn from
all are ``und``; a null label or id is not learned from; repeated rows count as they are; of equal scores the first language by code points wins; an empty table gives no
rows; a very long text is counted whole, as one task's row of arrays of its length; all other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.llm import textops
from meterlake.llm.common import ship, table

DIM, NGRAMS, TRAIN_ROWS, EPOCHS = 1 << 14, 3, 2000, 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.1


class Model(NamedTuple):
    langs: list[str]
    idf: np.ndarray  # DIM
    weights: np.ndarray  # languages x DIM
    bias: np.ndarray
    temperature: float


def normal(c: Column) -> Column:
    """Letters in lower case, all else a space; empty where there is no letter."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}]+", " "))


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places and how often each occurs, of one normalised text."""
    p = np.frombuffer(f" {text} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    total = np.zeros(DIM, dtype=np.int64)
    h = np.zeros(len(p), dtype=np.uint64)
    for n in range(NGRAMS):
        h = h[: len(p) - n] * np.uint64(0x9E3779B97F4A7C15) + p[n:]
        total += np.bincount((textops.mix(h, n) % np.uint64(DIM)).astype(np.int64), minlength=DIM)
    at = np.flatnonzero(total)
    return at, total[at]


def _features(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(n) * idf[at]
    return x / (np.sqrt((x * x).sum()) or 1.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(sample: list[tuple[np.ndarray, np.ndarray, str]], df: np.ndarray, n_docs: int, l1: float = L1, l2: float = L2) -> Model | None:
    """From (places, counts, language) rows, in the order they are to be learned, and in how many of ``n_docs`` texts each place occurs."""
    if not sample:
        return None
    langs = sorted({lang for _, _, lang in sample})
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    rows = [(at, _features(at, n, idf), langs.index(lang)) for at, n, lang in sample]
    learn = [r for i, r in enumerate(rows) if i % 5 != 4] if len(rows) >= 50 else rows
    judge = [r for i, r in enumerate(rows) if i % 5 == 4] if len(rows) >= 50 else rows
    z, g2 = np.zeros((len(langs), DIM + 1)), np.zeros((len(langs), DIM + 1))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        a = z[:, at]
        return -np.sign(a) * np.maximum(np.abs(a) - l1, 0) / ((BETA + np.sqrt(g2[:, at])) / ALPHA + l2)

    for _ in range(EPOCHS):
        for at, x, y in learn:
            at, x = np.append(at, DIM), np.append(x, 1.0)
            w = weights(at)
            p = _softmax(w @ x)
            p[y] -= 1
            grad = p[:, None] * x
            sq = g2[:, at]
            z[:, at] += grad - (np.sqrt(sq + grad * grad) - np.sqrt(sq)) / ALPHA * w
            g2[:, at] = sq + grad * grad
    w = weights(slice(None))
    made = Model(langs, idf, w[:, :DIM], w[:, DIM], 1.0)
    logits = np.array([made.weights[:, at] @ x + made.bias for at, x, _ in judge])
    y = np.array([k for _, _, k in judge])

    def loss(t: float) -> float:
        s = logits / t
        s -= s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    return made._replace(temperature=min(np.geomspace(0.05, 20, 121), key=loss))


def held_out(c: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quotas(counts: dict[str, int], rows: int) -> dict[str, int]:
    """How many rows of each language are learned from: the same number of each, as far as it has them, ``rows`` in all, but one of each at least."""
    left, out = max(rows, len(counts)), {}
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, left // (len(counts) - i))
        left -= out[lang]
    return out


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many of the normalised ``texts`` (text) each hashed place occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIM, dtype=np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                total[count_grams(t)[0]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    out = np.zeros(DIM)
    for r in texts.select("text").mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():  # DIM rows at most
        out[r["at"]] = r["n"]
    return out


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Learn from text and lang of rows that are not held out: of ``rows`` in all, as many of each language, so a rare one is learned too."""
    ship(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.select(F.xxhash64("doc_id", "text").alias("k"), "lang", normal(F.col("text")).alias("text")).filter("text != ''")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    quota = quotas(counts, rows)
    # the bound is set by hash first, so that few texts are ever counted; what is over it goes by rank within the language
    below = {lang: int((1 << 40) * min(1.0, (1.3 * q + 20) / counts[lang])) for lang, q in quota.items() if q}
    if not below:
        return None
    most = F.create_map(*[F.lit(x) for pair in below.items() for x in pair])
    drawn = known.filter(F.pmod("k", F.lit(1 << 40)) < most[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [count_grams(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("lang"), pa.array([m[0].astype(np.int32) for m in made], pa.list_(pa.int32())),
                                              pa.array([m[1].astype(np.float32) for m in made], pa.list_(pa.float32()))], names=["k", "lang", "at", "n"])

    got = drawn.mapInArrow(run, "k bigint, lang string, at array<int>, n array<float>").collect()  # 1.3 * rows + 20 a language, about
    taken: dict[str, int] = {}
    sample = []
    for r in sorted(got, key=lambda r: (r["k"], r["lang"], r["at"])):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= quota[r["lang"]]:
            sample.append((np.array(r["at"]), np.array(r["n"]), r["lang"]))
    return fit(sample, document_frequencies(known), sum(counts.values()))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All rows and columns of ``docs``, with lang_pred and score in place of columns of these names."""
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = [f.name for f in schema]

    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x DIM numbers

    def one(text: str) -> tuple[str, float]:
        model = sent.value
        if not text or model is None:
            return "und", 0.0
        at, n = count_grams(text)
        p = _softmax((model.weights[:, at] @ _features(at, n, model.idf) + model.bias) / model.temperature)
        return model.langs[int(p.argmax())], float(p.max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [one(t) for t in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=names)

    return docs.select(*rest, normal(F.col("text")).alias("__normal")).mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), train(docs))
    return made.select("doc_id", "held_out", "lang_pred", "score")
