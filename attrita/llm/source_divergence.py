"""Operator 12: how far the sources of a language differ in their words, by count-level bitmaps.

For each term kept in a language (found in ``min_docs`` of its documents or
more) a group (a source's documents of that language) has the smoothed share
p = 1 + floor(10^9 (count + 2) / (N + 2 V)); two shares differ by
f = floor((p - q)^2 / (p + q)).  All of it is integers.

1. tasks count terms and the documents that hold them per (lang, source, term)
   in bounded tables, which one aggregate adds up; document counts of a
   language are sums over its sources;
2. terms are dealt to blocks by their hash, enough blocks a language that each
   has about ``BLOCK_ROWS`` counts.  In a block terms get bit numbers, the most
   frequent first, and each (group, count) a bitmap of the terms with that
   count there, kept as its non-zero 64-bit words;
3. joint cells: for a pair of groups, AND and popcount of the words that both
   have give the number of terms with counts (c, d), times f;
4. zeros by complement: with J the joint cells and |B| the bitmaps' sizes, the
   sum over all V terms is  V f(0,0) + sum |B_c| (f(c,0) - f(0,0)) +
   sum |B_d| (f(0,d) - f(0,0)) + sum J(c,d) (f(c,d) - f(c,0) - f(0,d) + f(0,0)).
   So only cells of two counts need bitmaps; the rest comes from each group's
   number of terms by count;
5. sources go to chunks of about ``CHUNK``, and a task takes one block and one
   pair of chunks: its memory does not grow with the number of sources.

The result itself has a row for each ordered pair of sources of a language.

Edge cases: null lang, source and text count as empty strings; a group without
kept terms has count 0 for each; a language without kept terms has the value 0
for all pairs and no terms; repeated rows count as often as they come; a
language with one source has no pairs; an empty table has no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrita.llm.common import begin, written
from attrita.operators.broadcast import bounded_broadcast

MIN_DOCS = 10
TOP = 10
#: Share of a whole, as an integer.
SCALE = 1_000_000_000
#: (source, term) counts a block holds on average, sources a chunk does.
BLOCK_ROWS = 200_000
CHUNK = 64
#: Terms a task counts before it passes its counts on.
HELD = 300_000
#: Groups up to this number are broadcast, more are joined by a shuffle.
GROUPS = 200_000

#: Letters A-Z lower-cased, a-z and all bytes of other characters as they are, the rest white space.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_TERM_BYTES).split(b" ") if text else []


def _counted(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """lang, source, term, n, docs: partial counts; a null term's docs are the group's documents."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()),
                        ("docs", pa.int64())])

    def rows(held):
        for (a, b), (documents, n, d) in held.items():
            names = list(n)
            column = pa.concat_arrays([pa.array(names, pa.binary()).cast(pa.string()), pa.nulls(1, pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array([a] * len(column)), pa.array([b] * len(column)), column,
                                              pa.array([*n.values(), 0], pa.int64()),
                                              pa.array([*map(d.__getitem__, names), documents], pa.int64())], schema=schema)

    def run(batches):
        begin(__name__)
        held: dict[tuple[str, str], list] = {}
        size = 0
        for batch in batches:
            for a, b, t in zip(*(batch.column(i) for i in range(3)), strict=True):
                own = held.setdefault((a.as_py(), b.as_py()), [0, Counter(), Counter()])
                found = terms(t.as_py())
                before = len(own[1])
                own[0] += 1
                own[1].update(found)
                own[1].pop(b"", None)
                own[2].update(set(found))
                size += len(own[1]) - before
                if size > HELD:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in (
        (lang, "lang"), (source, "source"), (text, "text")))).mapInArrow(
        run, "lang string, source string, term string, n long, docs long")


def shares(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), in three steps of 1000 so that nothing overflows."""
    whole, rest = np.zeros(len(count), dtype=np.int64), count.astype(np.int64) + 2
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // (total + 2 * kept), rest % (total + 2 * kept)
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class _Group:
    """One source's levels: each level's count and share, and its bitmap's non-zero words."""

    def __init__(self, rows: pd.DataFrame):
        self.total, self.kept = int(rows["total"].iloc[0]), int(rows["kept"].iloc[0])
        self.none = shares(np.zeros(1, dtype=np.int64), self.total, self.kept)

    def bitmaps(self, rows: pd.DataFrame, blocks: int) -> _Group:
        ids, n = rows["id"].to_numpy(), rows["n"].to_numpy()
        by = np.lexsort((n, ids >> 6))
        word, n = (ids >> 6)[by], n[by]
        first = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (n[1:] != n[:-1]))))
        self.bits = np.bitwise_or.reduceat(np.uint64(1) << (ids[by] & 63).astype(np.uint64), first)
        self.word, self.share = word[first], shares(n[first], self.total, self.kept)
        self.start = np.searchsorted(self.word, np.arange(blocks + 1))
        return self


def _joint(a: _Group, b: _Group) -> int:
    """Sum over the joint cells of two counts: popcount times what f exceeds the complements' part by."""
    many = np.diff(b.start)[a.word]
    left = np.repeat(np.arange(len(a.word)), many)
    right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + b.start[a.word][left]
    cells = np.bitwise_count(a.bits[left] & b.bits[right]).astype(np.int64)
    some = np.flatnonzero(cells)
    p, q, cells = a.share[left[some]], b.share[right[some]], cells[some]
    return int(((divergence(p, q) - divergence(p, b.none) - divergence(a.none, q) + divergence(a.none, b.none)) * cells).sum())


def _pairs(keys: list[str], chunk: dict[str, int], i: int, j: int):
    """The pairs of sources that the task of chunks i and j takes, the smaller name first."""
    for x, a in enumerate(keys):
        for b in keys[x + 1:]:
            if {chunk[a], chunk[b]} == {i, j}:
                yield a, b


def _joint_sums(rows: pd.DataFrame) -> pd.DataFrame:
    lang, i, j = rows["lang"].iloc[0], int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
    code, names = pd.factorize(rows["term"])
    often = np.bincount(code, weights=rows["n"])
    number = np.empty(len(names), dtype=np.int64)
    number[np.argsort(-often, kind="stable")] = np.arange(len(names))
    rows = rows.assign(id=number[code])
    own = dict(list(rows.groupby("source")))
    held = {s: _Group(r).bitmaps(r, (len(names) >> 6) + 1) for s, r in own.items()}
    chunk = {s: int(r["chunk"].iloc[0]) for s, r in own.items()}
    out = [(lang, a, b, _joint(held[a], held[b])) for a, b in _pairs(sorted(own), chunk, i, j)]
    return pd.DataFrame(out, columns=["lang", "a", "b", "value"])


def _complement_sums(rows: pd.DataFrame) -> pd.DataFrame:
    lang, i, j = rows["lang"].iloc[0], int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
    own = dict(list(rows.groupby("source")))
    chunk = {s: int(r["chunk"].iloc[0]) for s, r in own.items()}
    out = []
    if int(rows["kept"].iloc[0]):
        held = {s: _Group(r) for s, r in own.items()}
        level = {s: (shares(r["n"].to_numpy(), held[s].total, held[s].kept), r["m"].to_numpy()) for s, r in own.items()}
        for a, b in _pairs(sorted(own), chunk, i, j):
            g, h = held[a], held[b]
            none = divergence(g.none, h.none)
            out.append((lang, a, b, int(g.kept * none[0] + (level[a][1] * (divergence(level[a][0], h.none) - none)).sum()
                                        + (level[b][1] * (divergence(g.none, level[b][0]) - none)).sum())))
    else:
        out = [(lang, a, b, 0) for a, b in _pairs(sorted(own), chunk, i, j)]
    return pd.DataFrame(out, columns=["lang", "a", "b", "value"])


def kept_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: counts (lang, source, term, n, whole: the language's count) of kept terms, and groups (lang,
    source, total, kept: the language's kept terms, whole: its total, blocks, chunks, chunk) of all (lang, source)."""
    counts = _counted(docs, lang_col, source_col, text_col).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    marked = counts.select("lang", "source", "term", "n", F.sum("n").over(term).alias("whole"),
                           F.sum("docs").over(term).alias("found"),
                           (F.row_number().over(term.orderBy("source")) == 1).alias("head"))
    counts = written(marked.where((F.col("found") >= min_docs) | F.col("term").isNull()).drop("found"), "kept-terms")
    real = F.col("term").isNotNull()
    own = counts.groupBy("lang", "source").agg(
        F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).cast("long").alias("total"),
        F.count(F.when(real, 1)).alias("rows"), F.count(F.when(real & F.col("head"), 1)).alias("heads"))
    lang = Window.partitionBy("lang")
    groups = written(own.select(
        "lang", "source", "total", F.sum("heads").over(lang).alias("kept"), F.sum("total").over(lang).alias("whole"),
        F.ceil(F.sum("rows").over(lang) / BLOCK_ROWS).cast("int").alias("blocks"),
        F.ceil(F.count(F.lit(1)).over(lang) / CHUNK).cast("int").alias("chunks"))
        .withColumn("chunk", F.pmod(F.xxhash64("source"), "chunks").cast("int")), "groups")
    return counts.where(real).select("lang", "source", "term", "n", F.col("whole").alias("often")), groups


def _dealt(rows: DataFrame) -> DataFrame:
    """Each row to the tasks of its chunk with every chunk of the language."""
    return (rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")))


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
                      min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each (lang, source) the language's other sources by how far their
    words differ (part ``pair``, all ranks) and the ``top`` terms it uses more than its language (part ``term``)."""
    counts, groups = kept_counts(docs, lang_col, source_col, text_col, min_docs)
    small = bounded_broadcast(groups, GROUPS)
    rows = counts.join(small, ["lang", "source"])
    cell = "lang string, a string, b string, value long"
    joint = (_dealt(rows.where("chunks > 0").withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int")))
             .select("lang", "block", "i", "j", "source", "chunk", "total", "kept", "term", "n")
             .groupBy("lang", "block", "i", "j").applyInPandas(_joint_sums, cell))
    levels = counts.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    levels = levels.unionByName(groups.select("lang", "source", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("m")))
    complement = (_dealt(levels.join(small, ["lang", "source"])).select(
        "lang", "i", "j", "source", "chunk", "total", "kept", "n", "m")
        .groupBy("lang", "i", "j").applyInPandas(_complement_sums, cell))
    sums = joint.unionByName(complement).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                  F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"),
                        "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    def share(n, total):
        return F.expr(f"1L + (cast({n} + 2 as decimal(20, 0)) * {SCALE}) div ({total} + 2 * kept)")

    over = (rows.withColumn("p", share("n", "total")).withColumn("q", share("often", "whole")).where("n > 0 and p > q")
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                    F.expr("(p - q) * (p - q) div (p + q)").alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked)


def query(spark, sf_dir):
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT rid, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS often FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
l AS (SELECT lang, count(*) AS v, sum(often) AS whole FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source
       GROUP BY g.lang, g.source),
s AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gn.total + 2 * l.v) AS p,
        1 + (1000000000::HUGEINT * (k.often + 2)) // (l.whole + 2 * l.v) AS q
      FROM gn JOIN l ON gn.lang = l.lang JOIN k ON k.lang = gn.lang
      LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
sums AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
         FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
words AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM s WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM words))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r
WHERE part = 'pair' OR rank <= 10
"""
