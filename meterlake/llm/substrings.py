"""Substring dedup by difference-cover anchors.

Places 1, 2 and 4 modulo 7 form a difference cover: for any two places i and j there is a shift below 7 that takes both to
cover places.  So two equal windows of 13 words hold, at one shift, equal anchors of 13 - 6 = 7
words at cover places of both documents.  Anchors are hashed at cover places only (3 of 7); those in one document alone are
dropped (module ``tally``).  Around each anchor that several documents share, the match is extended: the
windows that hold it are hashed with two 64-bit hashes (of the words' 64-bit hashes).  A batch of texts first judges its windows
alone; only those of its least document are judged by the least document of all, one row a window, so a passage in a third of all
documents, however often each repeats it, is one row a batch.  Copies of one text are told by its least document alone.

Defined results: null, empty or wordless text has no words and loses none; texts of fewer words than a
window lose none; repeats inside one document stay; a null id neither removes nor loses words; rows
that repeat (equal id and text) are judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlake.llm import tally, textops
from meterlake.llm.common import durable, forget, join_counted, ship, table

#: The window of the contract; a perfect difference cover modulo 7.
WINDOW, PERIOD, COVER = 13, 7, (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1


def _words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, textops.Words, np.ndarray]]:
    raw, at = textops.buffers(texts)
    for a, b in textops.slices(at):
        part = raw[at[a] : at[b]]
        w = textops.words(part, at[a : b + 1] - at[a])
        first = np.searchsorted(w.doc, np.arange(b - a + 1))
        yield a, b, part, first, w, np.arange(len(w.doc)) - first[w.doc] if len(w.doc) else w.doc


def _anchors(w: textops.Words, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all anchors at cover places, and the words they begin at."""
    h, ok = textops.runs(w, ANCHOR), textops.whole(w, ANCHOR)
    at = np.flatnonzero(ok & np.isin(place[: len(ok)] % PERIOD, COVER))
    return h[at], at


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    hs, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for a, b, _, _, w, place in _words(texts):
        h, at = _anchors(w, place)
        h, doc = textops.distinct(h, w.doc[at], b - a)
        hs.append(h)
        docs.append(doc + a)
    return np.concatenate(hs), np.concatenate(docs)


def windows(texts: DataFrame, batches: int, buckets: int, group: int = 1) -> DataFrame:
    """All windows that hold an anchor found in several texts, from rows (t1, t2, doc_id, text).

    A window that its batch also has in a smaller document is judged there: rows (t1, t2, gone). Of the others, one
    document's a batch, comes one row a window (t1, t2, doc_id, pos, h1, h2); its further places in that document are in ``gone``.
    """
    rows = texts.select(tally.batch_of(F.col("t1"), batches).alias("batch"), "t1", "t2", "doc_id", "text")

    def use(t: pa.Table, answer) -> pa.Table:  # noqa: ANN001
        ids, t1, t2 = (tally._one(t, c).to_numpy() for c in ("doc_id", "t1", "t2"))
        found = [[np.empty(0, np.int64)] * 2 + [np.empty(0, np.uint64)] * 2]
        for a, _, _, first, w, place in _words(tally._one(t, "text")):
            h, at = _anchors(w, place)
            at = at[answer(h) > 0]
            ok = textops.whole(w, WINDOW)
            if not len(ok):
                continue
            begin = np.minimum(np.maximum(at - (WINDOW - ANCHOR), first[w.doc[at]]), len(ok))
            hit = np.bincount(begin, minlength=len(ok) + 1)[: len(ok) + 1] - np.bincount(np.minimum(at + 1, len(ok)), minlength=len(ok) + 1)[: len(ok) + 1]
            x = np.flatnonzero(ok & (np.cumsum(hit)[: len(ok)] > 0))
            found.append([w.doc[x] + a, place[x], textops.runs(w, WINDOW)[x], textops.runs(w, WINDOW, 1)[x]])
        row, pos, h1, h2 = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((pos, row, ids[row], h2, h1))
        row, pos, h1, h2 = row[order], pos[order], h1[order], h2[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        group = np.cumsum(new) - 1
        least = ids[row][new][group] if len(row) else np.empty(0, np.int64)
        here = ids[row] > least
        own = new.copy()  # the first place of a window in a text of the least id
        own[1:] |= row[1:] != row[:-1]
        own &= ~here
        # further places of a window in one text go with its first one
        lead = np.maximum.accumulate(np.where(own, np.arange(len(row)), 0))
        again = ~here & ~own
        stay, n = np.flatnonzero(own), int(own.sum())
        rank = np.cumsum(own) - 1
        counts = np.bincount(rank[lead[again]], minlength=n).astype(np.int64)
        gone = np.flatnonzero(here)
        gone = gone[np.argsort(row[gone], kind="stable")]
        of, start = np.unique(row[gone], return_index=True)
        m, extra = len(of), pos[again]
        ends = np.concatenate((np.cumsum(np.concatenate(([0], counts))), len(extra) + np.append(start, len(gone))[1:] if m else np.empty(0, np.int64)))
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate((extra, pos[gone])).astype(np.int32)))
        some = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(m, kind)])
        both = lambda x: pa.array(np.concatenate((x[row[stay]], x[of])))
        return pa.table({"t1": both(t1), "t2": both(t2), "doc_id": some(ids[row[stay]], pa.int64()), "pos": some(pos[stay].astype(np.int32), pa.int32()),
                         "h1": some(h1[stay].view(np.int64), pa.int64()), "h2": some(h2[stay].view(np.int64), pa.int64()), "gone": lists})

    return tally.tally(rows, buckets, _tokens, use, "t1 bigint, t2 bigint, doc_id bigint, pos int, h1 bigint, h2 bigint, gone array<int>", least="doc_id", group=group)


def kept(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept from rows (doc_id, text, copy: whether a smaller document says the same, gone: places of windows to cover, or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, copy = batch.column("gone"), batch.column("copy").to_pylist()
            n, cut, text = [], [], []
            for a, b, part, first, w, _ in _words(batch.column("text")):
                for i in range(a, b):
                    f, e = first[i - a], first[i - a + 1]
                    p = np.asarray(lists[i].as_py() or [], dtype=np.int64)
                    if copy[i] and e - f >= WINDOW:
                        stays = np.empty(0, np.int64)
                    elif len(p):
                        mark = np.bincount(p, minlength=e - f + 1) - np.bincount(p + WINDOW, minlength=e - f + 1)
                        stays = np.flatnonzero(np.cumsum(mark)[:-1] == 0) + f
                    else:
                        stays = np.arange(f, e)
                    n.append(int(e - f))
                    cut.append(int(e - f - len(stays)))
                    # words that follow each other after a single space are one piece
                    joint = np.flatnonzero((np.diff(stays) != 1) | (w.start[stays[1:]] - w.end[stays[:-1]] != 1) | (part[w.end[stays[:-1]]] != 0x20)) if len(stays) else stays
                    lo, hi = w.start[stays[np.append(0, joint + 1)]] if len(stays) else stays, w.end[stays[np.append(joint, len(stays) - 1)]] if len(stays) else stays
                    text.append(b" ".join(part[x:y].tobytes() for x, y in zip(lo, hi)).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(text, pa.string()),
                                              pa.array([hashlib.sha256(t.encode()).hexdigest() for t in text], pa.string())], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string")


def dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (its words that stay, joined by a space), kept_sha256."""
    spark = docs.sparkSession
    ship(spark)
    d = tally.digested(docs, F.col("doc_id").cast("long").alias("doc_id"))
    # of each text the least document; the other copies lose what it holds without being looked into
    told = durable(d.groupBy("t1", "t2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first(F.octet_length("text")).alias("size")), "texts")
    total = int(told.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    batches, buckets = tally.sizes(total)
    w = durable(windows(tally.once(d.filter("doc_id IS NOT NULL").select("t1", "t2", "doc_id", "text"), least="doc_id"), batches, buckets, tally.group_of(total)), "windows")
    # one row a batch at most holds a window
    first = F.min("doc_id").over(Window.partitionBy("h1", "h2"))
    places = F.concat(F.array("pos"), F.coalesce("gone", F.array().cast("array<int>")))
    judged = w.filter("pos IS NOT NULL").withColumn("first", first).filter("first < doc_id").withColumn("gone", places).groupBy("t1", "t2").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    here = w.filter("pos IS NULL").select("t1", "t2", "gone")
    gone = judged.unionByName(here).groupBy("t1", "t2").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    of = durable(told.join(gone, ["t1", "t2"], "left").filter("n > 1 OR gone IS NOT NULL").select("t1", "t2", "least", "n", "gone"), "gone")
    forget(w, told)
    known = join_counted(d, of, ["t1", "t2"], "n")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return kept(known.select("doc_id", "text", copy.alias("copy"), F.when(F.col("doc_id").isNotNull(), F.col("gone")).alias("gone")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
