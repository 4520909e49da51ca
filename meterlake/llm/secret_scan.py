r"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base kinds are found by pattern, leftmost and non-overlapping per kind.  The method adds spans of kind
``owned``: tokens outside every base span whose value is owner-specific in the whole corpus, and that either look live (20 characters
with upper case, lower case and digits, or 32 hexadecimal ones in upper case) or say, bare, what is the value of a base span somewhere.
Owner-specific is a value with at most ``max_owners`` distinct owners and ``max_repos`` repositories; what more hold is a widely
copied example and is not added.  Every span, base ones too, has its verdict and both counts.

Candidate values are hashed; per hash the distinct repositories and owners are counted over all
documents (partial aggregation first, so a value in a third of all rows is one row per task).  Verdicts
return to the documents by a join in two parts: values that make up at least 1/``HEAVY_PARTS`` of all
candidates (so at most ``HEAVY_PARTS`` of them, whatever the corpus) are broadcast, the others are
joined by hash, none of which is then a hot key.

The repository is ``repo_col``; its owner is what stands before the first ``/``.

Defined results: null or empty text has no spans; a null repository counts as one repository and owner of
its own; repeated rows are scanned and returned each; spans with equal starts stand in the order
assign, access, hex, owned; an empty table gives no rows; other columns are ignored, and ``redact`` keeps them whatever their names.
Positions are code points, ends exclusive; they are summed in pieces of ``CHUNK`` matches, so a text of very many stays linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.common import durable, table, text_of

#: The patterns of the base kinds. Letters of key words are given in both cases.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"  # all failing matches are shorter; none hides a longer one
HEX = r"[0-9a-f]{24,}"
#: Tokens that may be secrets (whole tokens with a digit and a letter, so that plain words are passed over by the pattern), and what makes one look live.
OWNED = r"[A-Za-z0-9_-]{8,}"
MIXED = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])" + OWNED
LIVE = (r"^(?=.*[A-Z])(?=.*[a-z])(?=.*[0-9]).{20,}$", r"^(?=.*[A-F])(?=.*[0-9])[0-9A-F]{32,}$")
KINDS = ("assign", "access", "hex", "owned")
MIN_VALUE = 6
MAX_OWNERS, MAX_REPOS = 2, 8
HEAVY_PARTS, CHUNK = 2000, 256

_FOUND = "array<struct<gap:int,own:int,hash:string,fine:boolean,live:boolean>>"
_SPAN = "array<struct<start:int,rank:int,end:int,hash:string,live:boolean>>"


def matches(text: Column, found: Column, pattern: str, value_group: int = 0, least: int = 0, live: bool = False) -> Column:
    """All matches, ``found`` as texts, in order: length of the text before each, its own length, hash of its value, whether it counts, whether it looks live.

    The text is split only if there is any.
    """
    gaps = F.split(text, pattern, -1)

    def of(gap: Column, match: Column) -> Column:
        value = F.regexp_extract(match, pattern, value_group) if value_group else match
        fine = F.length(value) >= least
        looks = match.rlike(LIVE[0]) | match.rlike(LIVE[1]) if live else F.lit(True)
        return F.struct(F.length(gap).alias("gap"), F.length(match).alias("own"), F.when(fine, F.sha2(value, 256)).alias("hash"), fine.alias("fine"), looks.alias("live"))

    return F.when(F.size(found) > 0, F.zip_with(F.slice(gaps, 1, F.size(found)), found, of)).otherwise(F.array().cast(_FOUND))


def spans(m: str, rank: int) -> Column:
    """The places of ``matches`` in column ``m``, of those that count."""
    starts = F.sequence(F.lit(0), F.size(m) - 1, F.lit(CHUNK))
    part = lambda c: F.slice(m, c + 1, F.lit(CHUNK))
    length = lambda c: F.aggregate(part(c), F.lit(0), lambda a, x: a + x["gap"] + x["own"])
    before = F.aggregate(starts, F.array(F.lit(0)), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + length(c))))

    def placed(c: Column, at: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["gap"]
            span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + x["own"]).alias("end"), x["hash"].alias("hash"), x["live"].alias("live"))
            return F.struct((begin + x["own"]).alias("at"), F.when(x["fine"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(part(c), F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out")), step, lambda acc: acc["out"])

    return F.when(F.size(m) > 0, F.flatten(F.zip_with(starts, F.slice(before, 1, F.size(starts)), placed))).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame, repo_col: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, text_hash, base and spans (arrays of start, rank, end), verdicts (of spans: owned, n_owners, n_repos), n_owned, n_copied.

    ``n_owned`` and ``n_copied`` count base spans and candidates whose value few or many hold.
    """
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(repo_col), F.lit("")).alias("repo"), text_of(text_col).alias("text"))
    text = F.col("text")
    t = t.select("doc_id", "repo", "text", *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"f{i}") for i, p in enumerate((ASSIGN, ACCESS, HEX, MIXED))])
    found = t.select("doc_id", "repo", F.xxhash64(text).alias("text_hash"), matches(text, F.col("f0"), ASSIGN, 2, MIN_VALUE).alias("m0"), matches(text, F.col("f1"), ACCESS).alias("m1"),
                     matches(text, F.col("f2"), HEX).alias("m2"), matches(text, F.col("f3"), MIXED, live=True).alias("m3"))
    per_kind = found.select("doc_id", "repo", "text_hash", F.array_sort(F.concat(*[spans(f"m{i}", i) for i in range(3)])).alias("base"),
                            F.when(F.exists("m3", lambda x: x["fine"]), spans("m3", 3)).otherwise(F.array().cast(_SPAN)).alias("more"))
    clear = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    scanned = durable(per_kind.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "repo", "text_hash", "base", clear.alias("more")), "scanned")

    cand = scanned.select("rid", "repo", F.explode(F.concat("base", "more")).alias("s")).select("rid", "repo", "s", F.col("s.hash").alias("hash"))
    owner = F.substring_index("repo", "/", 1)
    held = cand.groupBy("hash", "repo").agg(F.count("*").alias("n"), F.max(F.col("s.rank") < 3).alias("known")).groupBy("hash").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_repos"), F.count_distinct(owner).alias("n_owners"), F.max("known").alias("known"))
    held = durable(held, "held")
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = F.col("n") >= max(1, -(-total // HEAVY_PARTS))
    counts = ("hash", "n_owners", "n_repos", "known")
    common_values = F.broadcast(held.filter(heavy).select(*counts))  # HEAVY_PARTS rows at most
    common = cand.join(common_values, "hash")
    rare = cand.join(common_values, "hash", "left_anti").join(held.filter(~heavy).select(*counts), "hash")
    judged = common.unionByName(rare).filter(F.col("known") | F.col("s.live")).withColumn("owned", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))
    shown = F.struct("s.start", "s.rank", "s.end", "owned", "n_owners", "n_repos")
    verdict = judged.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.when((F.col("s.rank") < 3) | F.col("owned"), shown))).alias("told"),
        F.sum(F.col("owned").cast("long")).alias("n_owned"), F.sum((~F.col("owned")).cast("long")).alias("n_copied"))
    place = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,owned:boolean,n_owners:bigint,n_repos:bigint>>")
    out = scanned.join(verdict, "rid", "left").withColumn("told", F.coalesce("told", none))
    return out.select(
        "doc_id", "text_hash", F.transform("base", place).alias("base"), F.transform("told", place).alias("spans"),
        F.transform("told", lambda s: F.struct(s["owned"].alias("owned"), s["n_owners"].alias("n_owners"), s["n_repos"].alias("n_repos"))).alias("verdicts"),
        F.coalesce("n_owned", F.lit(0)).alias("n_owned"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def listed(spans_col: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, repo_col: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """Every span, overlapping ones joined, replaced by ``mark``; all rows and columns stay, in the same schema."""
    found = scan(docs, repo_col).filter(F.size("spans") > 0).select("doc_id", "text_hash", "spans").dropDuplicates(["doc_id", "text_hash"])
    starts = F.sequence(F.lit(0), F.size("spans") - 1, F.lit(CHUNK))

    def step(acc: Column, c: Column) -> Column:
        """The text from the last span's end to the last end of the next ``CHUNK`` spans, as one piece (bound once, by an array of one)."""
        part = F.slice("spans", c + 1, F.lit(CHUNK))
        upto = F.greatest(acc["at"], F.array_max(F.transform(part, lambda s: s["end"])))

        def marked(piece: Column) -> Column:
            def one(b: Column, s: Column) -> Column:
                gap = F.substr(piece, b["at"] - acc["at"] + 1, s["start"] - b["at"])
                return F.struct(F.greatest(b["at"], s["end"]).alias("at"), F.when(s["start"] >= b["at"], F.concat(b["out"], gap, F.lit(mark))).otherwise(b["out"]).alias("out"))

            return F.aggregate(part, F.struct(acc["at"].alias("at"), F.lit("").alias("out")), one, lambda b: b["out"])

        made = F.transform(F.array(F.substr("text", acc["at"] + 1, upto - acc["at"])), marked)
        return F.struct(upto.alias("at"), F.concat(acc["out"], made).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(starts, begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr("text", acc["at"] + 1)))
    # the document travels as one struct, so that no column of it can clash
    d = docs.select(F.struct(*docs.columns).alias("kept"), F.col("doc_id").alias("id"), "text", F.xxhash64(text_of()).alias("hash"))
    joined = d.join(found, (d["hash"] == found["text_hash"]) & d["id"].eqNullSafe(found["doc_id"]), "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(clean)
    return joined.select(*[(text if c == "text" else F.col("kept")[c]).alias(c) for c in docs.columns])


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(table(spark, sf_dir, "documents"))
    count = lambda r: F.size(F.filter("base", lambda x: x["rank"] == r)).cast("long")
    told = F.array_join(F.transform("verdicts", lambda v: F.concat(F.when(v["owned"], "owned").otherwise("copied"), F.lit(":"), v["n_owners"].cast("string"), F.lit(":"), v["n_repos"].cast("string"))), ",")
    return s.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"), told.alias("verdicts"), "n_owned", "n_copied")


def _matches_sql(rank: int, pattern: str, value: str = "v") -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT rid, {rank} AS rk, v, {value} AS secret, st, st + length(v) AS en FROM (
      SELECT rid, ms[i] AS v, CAST(list_sum(list_transform(gs[1:i], lambda s: length(s)))
        + coalesce(list_sum(list_transform(ms[1:i-1], lambda s: length(s))), 0) AS BIGINT) AS st
      FROM (SELECT rid, ms, gs, unnest(range(1, len(ms) + 1)) AS i
            FROM (SELECT rid, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gs FROM d) a) b) c"""


OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS repo, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, true AS live FROM ({_matches_sql(0, ASSIGN, "regexp_extract(v, '" + ASSIGN.replace("'", "''") + "', 2)")}) q WHERE length(secret) >= {MIN_VALUE}
  UNION ALL SELECT *, true FROM ({_matches_sql(1, ACCESS)}) q1 UNION ALL SELECT *, true FROM ({_matches_sql(2, HEX)}) q2),
o AS (SELECT *, length(v) >= 20 AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')
      OR length(v) >= 32 AND regexp_full_match(v, '[0-9A-F]+') AND regexp_matches(v, '[A-F]') AND regexp_matches(v, '[0-9]') AS live FROM ({_matches_sql(3, OWNED)}) q
  WHERE regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') AND NOT EXISTS (SELECT 1 FROM b WHERE b.rid = q.rid AND b.st < q.en AND q.st < b.en)),
s AS (SELECT * FROM b UNION ALL SELECT * FROM o),
h AS (SELECT secret, count(DISTINCT split_part(repo, '/', 1)) AS no, count(DISTINCT repo) AS nr, bool_or(rk < 3) AS known FROM s JOIN d USING (rid) GROUP BY secret),
j AS (SELECT s.*, no <= {MAX_OWNERS} AND nr <= {MAX_REPOS} AS owned, no, nr, ['assign', 'access', 'hex', 'owned'][rk + 1] || ':' || st || ':' || en AS l FROM s JOIN h USING (secret) WHERE known OR live),
g AS (SELECT rid, count(*) FILTER (WHERE rk = 0) AS n_assign, count(*) FILTER (WHERE rk = 1) AS n_access, count(*) FILTER (WHERE rk = 2) AS n_hex,
  string_agg(l, ',' ORDER BY st, rk) FILTER (WHERE rk < 3) AS base, string_agg(l, ',' ORDER BY st, rk) FILTER (WHERE rk < 3 OR owned) AS spans,
  string_agg(CASE WHEN owned THEN 'owned' ELSE 'copied' END || ':' || no || ':' || nr, ',' ORDER BY st, rk) FILTER (WHERE rk < 3 OR owned) AS verdicts,
  count(*) FILTER (WHERE owned) AS n_owned, count(*) FILTER (WHERE NOT owned) AS n_copied FROM j GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(verdicts, '') AS verdicts, coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN g USING (rid)
"""
