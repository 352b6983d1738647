"""Operator 1: exact n-gram Jaccard join, filtered by prefixes under several global token orders.

Two sets with Jaccard similarity t or more share a token among the first
n - ceil(t n) + 1 of each, under *every* global order of the tokens.  Here an
order ranks tokens by document frequency (orders 2 and 3 by coarser classes of
it), then by an own hash; a pair is a candidate only if it shares a prefix
token under all the orders.  Tokens of one document only come first, so most
documents need no postings at all.

Steps, all on Spark:

1. every text -> sorted 64-bit shingle hashes; equal sets become one set (``key``);
2. tokens go to hash buckets as packed blobs (6 bytes a token), where document
   frequencies are counted; only tokens of two sets or more travel on, to
   their set;
3. each set works out its prefixes; sets with no shared prefix token are done;
4. stars: in each posting list, each member meets a few centres (the smallest
   under some hashes), never all others; pairs found under all orders are
   verified exactly, links become components;
5. the rest: posting lists that still hold several components are cut into
   chunks, and chunk meets chunk: pairs from different components whose parity
   sketches allow the similarity go on to the filters of the other orders and
   are verified.  ``FORESTS`` rounds send out of each chunk pair only a forest
   over its components, fewer pairs than it has members, and tie what links
   there are; a last round takes all pairs that still lie between components.
   No link is lost, no pair inside a component is spent on, and a group of many
   linked texts gives rows in proportion to its size.

A parity sketch has one bit per hash class, the parity of the set's shared
tokens in it; the number of bits in which two sketches differ never exceeds the
sets' symmetric difference, so the filter is exact.  Verification intersects
the sets' shared tokens (others can't be common), so texts are not read again.

Edge cases: null, empty or white-space texts have no shingles and link with
nothing; fewer than ``width`` words make one shingle of the whole sequence;
repeated rows and ids are kept, one output row each; a null id stays null and
its set's component id is the smallest non-null id; extra columns are ignored.
Keys are 64-bit hashes: the chance of any collision among a billion different
sets is about 3 %, among 15 million (30 GB) below 1e-5.  Set sizes come from
64-bit shingle hashes; in step 2 a token is its bucket and 48 more bits, so a
pair of 500-shingle sets miscounts one common token with a chance below 1e-9.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrita.llm.common import (U, begin, connected_components, grouped_words, map_text, mix, shuffle_width, text_groups,
                                written)

WIDTH = 4
PERCENT = 85
STARS = 4
CHUNK = 512
FORESTS = 2
ORDERS = 3
SKETCH_BITS = 512


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of each text."""
    words, offsets = grouped_words(texts)
    windows = np.zeros(max(0, len(words) - width + 1), dtype=U)
    for i in range(width):
        windows = windows * U(0x9E3779B97F4A7C15) + words[i:i + len(windows)]
    windows = mix(windows)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(windows[a:b - width + 1]))
        elif b > a:
            h = np.zeros(1, dtype=U)
            for w in words[a:b]:
                h = h * U(0x9E3779B97F4A7C15) + w
            out.append(mix(h + U(int(b - a) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF)))
        else:
            out.append(np.empty(0, dtype=U))
    return out


def set_key(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def document_sets(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """doc (the id), n (set size), key (null for the empty set); one row per row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(part, texts):
        sets = shingle_sets(texts, width)
        return {"doc": part.column(0), "n": [len(s) for s in sets],
                "key": [set_key(s) if len(s) else None for s in sets]}

    return map_text(docs.select(id_col, text_col), f"doc {kind}, n long, key long", work)


def _pack(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(data: bytes, bucket: int) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel().astype(U) | U(bucket % (1 << 16) << 48)


def _token_blobs(docs: DataFrame, text_col: str, width: int, buckets: int) -> DataFrame:
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()),
                        ("tokens", pa.binary())])

    def run(batches):
        begin(__name__)
        for _, texts in text_groups(batches, 0, 4_000_000):
            sets = {set_key(s): s for s in shingle_sets(texts, width) if len(s)}
            if not sets:
                continue
            keys = np.fromiter(sets, dtype=np.int64, count=len(sets))
            tokens = np.concatenate(list(sets.values()))
            owner = np.repeat(np.arange(len(keys)), [len(s) for s in sets.values()])
            bucket = ((tokens >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            tokens, owner = tokens[order], owner[order]
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                at = slice(cuts[b], cuts[b + 1])
                if cuts[b] < cuts[b + 1]:
                    own, counts = np.unique(owner[at], return_counts=True)
                    rows.append((b, keys[own].tobytes(), counts.astype(np.uint32).tobytes(), _pack(tokens[at])))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema,
                                                                                        strict=True)], schema=schema)

    return docs.select(text_col).mapInArrow(run, "bucket int, keys binary, counts binary, tokens binary")


def _joined(column: pd.Series, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=dtype)


def _shared_tokens(blobs: DataFrame, buckets: int) -> DataFrame:
    """Tokens that two sets or more hold, with their document frequency, packed for the sets' buckets."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = _unpack(b"".join(pdf["tokens"]), int(pdf["bucket"].iloc[0]))
        keys = np.repeat(_joined(pdf["keys"], np.int64), _joined(pdf["counts"], np.uint32))
        order = np.lexsort((keys, tokens))
        tokens, keys = tokens[order], keys[order]
        first = np.ones(len(tokens), dtype=bool)  # copies of a set from several map tasks count once
        first[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
        tokens, keys = tokens[first], keys[first]
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        counts = np.diff(np.append(starts, len(tokens)))
        df = np.repeat(counts, counts)
        tokens, keys, df = tokens[df > 1], keys[df > 1], df[df > 1].astype(np.uint32)
        to = np.mod(keys, buckets)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(buckets + 1))
        tokens, keys, df = tokens[order], keys[order], df[order]
        return pd.DataFrame([(b, keys[i:j].tobytes(), tokens[i:j].tobytes(), df[i:j].tobytes())
                             for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j],
                            columns=["sb", "keys", "tokens", "df"])

    return blobs.groupBy("bucket").applyInPandas(work, "sb int, keys binary, tokens binary, df binary")


def _prefixes(shared: DataFrame, sets: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Sets with a shared token in a prefix: key, n, shared tokens, prefix tokens under each order."""

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left):
            keys, tokens, df = _joined(left["keys"], np.int64), _joined(left["tokens"], U), _joined(left["df"], np.uint32)
            size = right.set_index("key")["n"]
            classes = [df, np.log2(df).astype(np.int64), (np.log2(df) / 2).astype(np.int64)]
            ranked = [np.lexsort((mix(tokens + U(k + 1)), c, keys)) for k, c in enumerate(classes)]
            owners = keys[ranked[0]]
            starts = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1])))
            for a, b in zip(starts, np.append(starts[1:], len(owners)), strict=True):
                n = int(size[owners[a]])
                take = n - (percent * n + 99) // 100 + 1 - (n - int(b - a))  # the prefix beyond tokens of this set alone
                if take > 0:
                    heads = [tokens[r[a:min(b, a + take)]].view(np.int64) for r in ranked]
                    own = np.sort(tokens[ranked[0][a:b]])
                    odd = np.bincount((mix(own) % U(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
                    rows.append((owners[a], n, own.tobytes(), np.packbits(odd.astype(np.uint8)).tobytes(), *heads))
        return pd.DataFrame(rows, columns=["key", "n", "tok", "odd", "p1", "p2", "p3"])

    return (shared.groupBy("sb").cogroup(sets.withColumn("sb", F.pmod("key", F.lit(buckets)).cast("int")).groupBy("sb"))
            .applyInPandas(work, "key long, n long, tok binary, odd binary, p1 array<long>, p2 array<long>, p3 array<long>"))


def _verified(pairs: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share a prefix token under the other orders too and reach the similarity exactly."""
    others = [f"p{k}" for k in range(2, ORDERS + 1)]
    side = lambda c: live.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("tok").alias(f"t{c}"),
                                 *[F.col(p).alias(p + c) for p in others])
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(col[c][i].as_buffer(), dtype=U) for c in ("ta", "tb"))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
                keep[i] = 100 * common >= percent * (col["na"][i].as_py() + col["nb"][i].as_py() - common)
            yield pa.RecordBatch.from_arrays([col["a"].filter(pa.array(keep)), col["b"].filter(pa.array(keep))],
                                             schema=schema)

    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    for p in others:
        near = near & F.arrays_overlap(p + "a", p + "b")
    return rows.where(near).select("a", "b", "na", "nb", "ta", "tb").mapInArrow(run, "a long, b long")


def _postings(live: DataFrame) -> DataFrame:
    return live.select("key", "n", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("p")) for k in range(1, ORDERS + 1)])).alias("o")).select(
        "key", "n", "o.k", F.explode("o.p").alias("token"))


def _stars(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of posting-list members and centres, found under all orders."""
    centres = posts.groupBy("k", "token").agg(F.count(F.lit(1)).alias("members"), F.array(*[
        F.min(F.struct(F.xxhash64("key", F.lit(j)).alias("h"), "key", "n")) for j in range(STARS)]).alias("c"))
    met = posts.join(centres.where("members > 1"), ["k", "token"]).select(
        "k", "key", "n", F.explode(F.array_distinct("c")).alias("c"))
    met = met.where((F.col("key") != F.col("c.key"))
                    & (100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n")))
    return (met.groupBy(F.least("key", "c.key").alias("a"), F.greatest("key", "c.key").alias("b"))
            .agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("orders"))
            .where(F.col("orders") == 2 ** (ORDERS + 1) - 2).select("a", "b"))


def _across(posts: DataFrame, comps: DataFrame, live: DataFrame, percent: int, forest: int | None = None) -> DataFrame:
    """Candidate pairs (a, b) between different components, each once.  With
    ``forest`` (a salt) only so many that they would tie the same components
    together if all were links: fewer than a chunk pair has members."""
    p = (posts.where("k = 1").select("token", "key").join(comps.select(F.col("v").alias("key"), "comp"), "key", "left")
         .withColumn("comp", F.coalesce("comp", "key")))
    lists = p.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"),
                                   F.count(F.lit(1)).alias("members")).where("low < high").select("token", "members")
    chunk = F.pmod(F.xxhash64("key"), F.ceil(F.col("members") / CHUNK))
    own = live.select("key", "n", (F.col("n") - F.length("tok") / 8).cast("long").alias("alone"), "odd")
    held = written(p.join(lists, "token").withColumn("chunk", chunk).join(own, "key")
                   .groupBy("token", "chunk").agg(F.collect_list(F.struct("key", "comp", "n", "alone", "odd")).alias("m")), "chunks")
    one = held.select("token", F.col("chunk").alias("cx"), F.col("m").alias("x"))
    other = held.select("token", F.explode(F.sequence(F.lit(0).cast("long"), "chunk")).alias("cx"), F.col("m").alias("y"))
    met = one.join(other, ["token", "cx"]).select("x", "y")

    def columns(members):
        rows = members.flatten()
        key, comp, n, alone = (rows.field(f).to_numpy() for f in ("key", "comp", "n", "alone"))
        return key, comp, n, alone, np.frombuffer(b"".join(rows.field("odd").to_pylist()), dtype=U).reshape(len(key), -1)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                kx, cx, nx, ax, ox = columns(batch.column(0).slice(i, 1))
                ky, cy, ny, ay, oy = columns(batch.column(1).slice(i, 1))
                names, label = np.unique(np.concatenate((cx, cy)), return_inverse=True)
                lx, ly, tree = label[:len(cx)], label[len(cx):], np.arange(len(names))
                a, b = [], []
                for j in range(len(kx)):
                    apart = np.bitwise_count(oy ^ ox[j]).sum(axis=1, dtype=np.int64) + ay + ax[j]
                    near = ((100 - percent) * (ny + nx[j]) >= (100 + percent) * apart) & (tree[ly] != tree[lx[j]])
                    near &= 100 * np.minimum(ny, nx[j]) >= percent * np.maximum(ny, nx[j])
                    found = np.flatnonzero(near)
                    if forest is not None:
                        some = []
                        while len(found):
                            some.append(found[np.argmin(mix((ky[found] ^ kx[j]).view(U) + U(forest)))])
                            tree[tree == tree[ly[some[-1]]]] = tree[lx[j]]
                            found = found[tree[ly[found]] != tree[lx[j]]]
                        found = np.array(some, dtype=np.int64)
                    if len(found):
                        a.append(np.minimum(ky[found], kx[j]))
                        b.append(np.maximum(ky[found], kx[j]))
                if a:
                    both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long").distinct()


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                       percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id (smallest id
    that links reach; ``percent`` / 100 is the least Jaccard similarity of a
    link), links (the set's verified links to other sets; a lower bound: pairs
    inside a component are not all tried)."""
    buckets = shuffle_width(docs.sparkSession)
    docs = docs.select(id_col, text_col)
    table = written(document_sets(docs, id_col, text_col, width), "sets")
    sets = table.where("key is not null").groupBy("key").agg(F.min("n").alias("n"))
    shared = _shared_tokens(_token_blobs(docs, text_col, width, buckets), buckets)
    live = written(_prefixes(shared, sets, buckets, percent), "live")
    posts = written(_postings(live), "postings")
    stars = written(_stars(posts, percent), "stars")
    links = written(_verified(stars, live, percent), "links")
    tried, comps = stars, connected_components(links)
    salts = [*range(FORESTS), None]
    while salts:
        found = written(_across(posts, comps, live, percent, salt := salts.pop(0)), "across")
        if found.isEmpty():
            break  # no candidate lies between two components any more
        pairs = found.join(tried, ["a", "b"], "left_anti")
        more = written(_verified(pairs, live, percent), "links")
        if more.isEmpty():
            salts = salts[-1:] if salt is not None else []
        else:
            links, tried = links.union(more), tried.union(found)
            comps = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("links"))
    least = table.where("key is not null").groupBy("key").agg(F.min("doc").alias("least"))
    known = (least.join(comps.withColumnRenamed("v", "key"), "key", "left").join(degree, "key", "left")
             .withColumn("comp", F.coalesce("comp", "key")))
    heads = known.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = known.join(heads, "comp").select("key", "component_id", "links")
    return table.join(known, "key", "left").select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ngram_jaccard_join(docs).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON s.doc_id = c.a
"""
