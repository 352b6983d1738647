"""Operator 3: exact top-k by inner product, with pivot-table elimination.

Vectors become integers, floor(256 x).  A table holds every vector's Euclidean
distances to many pivots, linearly independent vectors of the data (7 / 8 of as
many as a vector has components, up to ``SAMPLE``).  For a query q and a
candidate x the triangle inequality gives d(q, x) >= max over pivots of
|d(q, p) - d(x, p)|, and with

    q . x = (|q|^2 + |x|^2 - d(q, x)^2) / 2

an upper bound of the score.  All distances of a vector together fix its part y
in the space of the pivots (x . p = (|x|^2 + |p|^2 - d(x, p)^2) / 2 for each of
them), so also  q . x <= y_q . y_x + |q - y_q| |x - y_x|.  The smaller bound
counts.  Candidates are evaluated in the order of their bounds; a query stops as
soon as its k-th best score exceeds the next bound, so the result is exact
(bounds carry a slack above the rounding error).  Of unclustered vectors, for
which the triangle inequality alone rules out next to nothing, a few per cent
are evaluated.

Queries and candidates are packed into blocks; each query block meets each
candidate block (the stated query set against all rows) under a key of its own
for up to ``GROUP`` candidate blocks.  A task carries each query's k-th best
score from block to block and keeps k rows a query, which are merged by query
at the end.

Vectors that are null or hold null or non-finite components take no part;
vectors meet only those of their own length.  Ties go to the smaller vec_id
(null last); repeated rows are rows of their own, each a candidate for the
others; a null vec_id is never a query; an empty table gives no rows; extra
columns are ignored.  Scores beyond 64 bits are held at the limits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrita.llm.common import begin, written

K = 5
EVERY = 50
#: Share of a vector's components that there are pivots, of at most so many vectors looked at.
SHARE = 0.875
SAMPLE = 512
#: A pivot's part outside the space of those before it, as a share of its length, at least.
APART = 0.05
BLOCK = 4096
GROUP = 16
STEP = 64


def integer_rows(vectors: pa.Array) -> list[np.ndarray | None]:
    """floor(256 x) of each vector as float64 (whole numbers); None where it takes no part."""
    out = []
    for v in vectors:
        v = v.values if v.is_valid else None
        if v is None or v.null_count:
            out.append(None)
            continue
        x = v.to_numpy(zero_copy_only=False).astype(np.float64)
        out.append(np.floor(256 * x) if np.isfinite(x).all() and np.isfinite(256 * x).all() else None)
    return out


def exact_scores(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a with q, whatever their size."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q))
    if largest < 2.0 ** 53:
        return (a @ q).astype(np.int64)
    if largest < 2.0 ** 62:
        return a.astype(np.int64) @ q.astype(np.int64)
    whole = [int(x) for x in q]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, sum(int(x) * y for x, y in zip(row, whole, strict=True))))
                     for row in a], dtype=np.int64)


class Pivots:
    """Independent vectors of one length, and what distances to them say."""

    def __init__(self, vectors: list[np.ndarray], share: float = SHARE):
        chosen, basis = [], []
        for x in vectors:
            if len(chosen) >= int(share * len(x)):
                break
            rest = x / n if 0 < (n := float(np.sqrt(x @ x))) < np.inf else np.zeros(len(x))
            for _ in range(2):  # the second time takes off what rounding left
                for e in basis:
                    rest = rest - (rest @ e) * e
            if (left := float(np.sqrt(rest @ rest))) >= APART:
                chosen.append(x)
                basis.append(rest / left)
        dim = len(vectors[0]) if vectors else 0
        self.points = np.array(chosen).reshape(len(chosen), dim)
        self.squares = (self.points * self.points).sum(axis=1)
        # From inner products with the pivots to coordinates in an orthonormal basis of their space.
        self.solve = (np.array(basis) @ np.linalg.pinv(self.points)).T if chosen else np.zeros((0, 0))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """The pivot table's rows for the rows of x."""
        with np.errstate(over="ignore", invalid="ignore"):
            apart = (x * x).sum(axis=1)[:, None] + self.squares - 2 * (x @ self.points.T)
            return np.sqrt(np.maximum(apart, 0))

    def parts(self, dist: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From distances alone: each vector's coordinates in the pivots' space, and its length outside it."""
        with np.errstate(over="ignore", invalid="ignore"):
            dots = (norms[:, None] + self.squares - dist * dist) / 2
            inner = dots @ self.solve
            outer = np.maximum(norms - (inner * inner).sum(axis=1), 0)
            return inner, np.sqrt(outer + 1e-9 * norms)


class Block:
    """Vectors with their ids and pivot distances, unpacked."""

    def __init__(self, rows, ids, shown, vectors, dist, pivots: Pivots):
        self.rows, self.ids, self.shown, self.vectors, self.dist = rows, ids, shown, vectors, dist
        with np.errstate(over="ignore"):
            self.norms = (vectors * vectors).sum(axis=1)
        self.inner, self.outer = pivots.parts(dist, self.norms)
        self.place = {r: j for j, r in enumerate(rows.tolist())}

    def bounds(self, q: Block, j: int) -> np.ndarray:
        """Upper bounds of the scores of all rows here with row j of q."""
        both = q.norms[j] + self.norms
        with np.errstate(over="ignore", invalid="ignore"):
            low = np.abs(self.dist - q.dist[j]).max(axis=1) if self.dist.shape[1] else np.zeros(len(self.ids))
            triangle = (both - np.maximum(0, low - 1e-9 * (1 + low)) ** 2) / 2
            bound = np.minimum(triangle, self.inner @ q.inner[j] + q.outer[j] * self.outer) + 1e-9 * both + 1
        return np.where(np.isnan(bound), np.inf, bound)


def top_of_block(q: Block, j: int, c: Block, k: int, known: float = -np.inf) -> tuple[list[tuple[int, int]], int]:
    """The k best (place, score) in c for row j of q that can beat ``known`` (a score that k others reach), and how
    many candidates were evaluated."""
    bound = c.bounds(q, j)
    if (own := c.place.get(int(q.rows[j]), -1)) >= 0:
        bound[own] = -np.inf
    order = np.argsort(-bound, kind="stable")
    order = order[:len(order) - (own >= 0)]
    places, scores, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, STEP
    while at < len(order):
        least = max(known, scores[k - 1]) if len(scores) >= k else known
        # Ties may still win by their id, so only a bound below the least score ends the search.
        open_ = order[at:at + step][bound[order[at:at + step]] >= least]
        if not len(open_):
            break
        at, step = at + len(open_), step * 2
        places = np.concatenate([places, open_])
        scores = np.concatenate([scores, exact_scores(c.vectors[open_], q.vectors[j])])
        best = np.lexsort((c.ids[places], -scores))[:k]  # -scores can't overflow: the least value is clamped above
        places, scores = places[best], scores[best]
    return list(zip(places.tolist(), scores.tolist(), strict=True)), at


def choose_pivots(rows: DataFrame, share: float = SHARE) -> dict[int, Pivots]:
    """Pivots by length of vector, from the ``SAMPLE`` vectors with the smallest hash (a fixed number)."""
    chosen = rows.where("v is not null").orderBy(F.xxhash64("v"), F.xxhash64("id")).limit(SAMPLE).select("v").toArrow()["v"]
    by_length: dict[int, list[np.ndarray]] = {}
    for x in integer_rows(chosen):
        if x is not None and len(x):
            by_length.setdefault(len(x), []).append(x)
    return {n: Pivots(v, share) for n, v in by_length.items()}


def pivot_table(rows: DataFrame, pivots: dict[int, Pivots]) -> DataFrame:
    """Written table (row, dim, id, vec, dist): each vector with its distances to the pivots of its length."""
    schema = pa.schema([("row", pa.int64()), ("dim", pa.int32()), ("id", pa.int64()), ("vec", pa.binary()), ("dist", pa.binary())])

    def run(batches):
        for batch in batches:
            vectors = integer_rows(batch.column(2))
            for n in sorted({len(x) for x in vectors if x is not None}):
                at = [i for i, x in enumerate(vectors) if x is not None and len(x) == n]
                x = np.array([vectors[i] for i in at]).reshape(len(at), n)
                dist = pivots[n].distances(x) if n in pivots else np.zeros((len(at), 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array([n] * len(at), pa.int32()), batch.column(1).take(pa.array(at)),
                     pa.array([v.tobytes() for v in x], pa.binary()), pa.array([d.tobytes() for d in dist], pa.binary())], schema=schema)

    return written(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "v").mapInArrow(
        run, "row long, dim int, id long, vec binary, dist binary"), "pivots")


def pivot_topk(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, every: int = EVERY,
               share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each row whose id is divisible by ``every``, against all other rows."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    pivots = choose_pivots(rows, share)
    table = pivot_table(rows, pivots)
    sizes = table.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("asked"))
    parts = {r.dim: (max(1, -(-r.n // BLOCK)), max(1, -(-r.asked // BLOCK))) for r in sizes.collect()}  # a row a length of vector
    sizes = vectors.sparkSession.createDataFrame([(d, *p) for d, p in parts.items()], "dim int, cs long, qs long")

    def blocks(rows: DataFrame, count: str, name: str) -> DataFrame:
        return rows.join(F.broadcast(sizes), "dim").groupBy(
            "dim", "cs", "qs", F.pmod(F.xxhash64("row"), count).alias(name)).agg(
            F.array_sort(F.collect_list(F.struct("row", "id", "vec", "dist"))).alias("m"))

    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = (blocks(table.where(F.col("id") % every == 0), "qs", "qb")
            .select("dim", "qb", to(F.ceil(F.col("cs") / GROUP)).alias("cg"), F.col("m").alias("q")))
    right = (blocks(table, "cs", "cb")
             .select("dim", to(F.col("qs")).alias("qb"), F.floor(F.col("cb") / GROUP).alias("cg"), F.col("m").alias("c")))
    schema = "query_row long, query_id long, vec_id long, vec_row long, score long"

    def unpack(members, dim: int) -> Block:
        rows = members.flatten()
        many = lambda f: np.frombuffer(b"".join(rows.field(f).to_pylist()), dtype=np.float64).reshape(len(rows), -1)
        ids = np.array([(1 << 63) - 1 if i is None else i for i in rows.field("id").to_pylist()], dtype=np.int64)
        return Block(rows.field("row").to_numpy(), ids, rows.field("id"), many("vec"), many("dist"), pivots.get(dim) or Pivots([]))

    def run(batches):
        begin(__name__)
        known: dict[int, list[int]] = {}  # a query's k best scores of the blocks that this task has seen
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                q, c = unpack(batch.column(1).slice(i, 1), dim), unpack(batch.column(2).slice(i, 1), dim)
                out = []
                for j, (row, ident) in enumerate(zip(q.rows.tolist(), q.ids.tolist(), strict=True)):
                    held = known.get(row, [])
                    best, _ = top_of_block(q, j, c, k, held[-1] if len(held) >= k else -np.inf)
                    known[row] = sorted([*held, *(s for _, s in best)], reverse=True)[:k]
                    out += [(row, ident, c.shown[p].as_py(), int(c.rows[p]), s) for p, s in best]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in zip(*out, strict=True)],
                                                     names=["query_row", "query_id", "vec_id", "vec_row", "score"])

    best = left.join(right, ["dim", "qb", "cg"]).select("dim", "q", "c").mapInArrow(run, schema)
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "vec_row")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    return pivot_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
