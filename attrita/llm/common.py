"""Helpers shared by the operators: scratch tables, bounded text groups, word hashing, components."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrita.session import scratch_path

#: Texts are worked on in groups of about this many characters, so that a
#: task's arrays stay small whatever a batch holds.
GROUP_CHARS = 2_000_000
#: Byte segments of this length are hashed at once (cut at white space).
SEGMENT_BYTES = 2_000_000

U = np.uint64
_MULT = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def written(df: DataFrame, name: str, partitioning: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it
    back: lineage ends there, and the files outlive any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitioning) if partitioning else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """Buckets for hand-packed shuffles: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_turn = [""]


def begin(owner: str) -> None:
    """Called as a task of module ``owner`` begins.  Workers are reused, so what
    a worker remembers for another operator (its module's ``release``) goes first
    and the freed memory returns to the system."""
    if _turn[0] == owner:
        return
    _turn[0] = owner
    for name, module in list(sys.modules.items()):
        if name.startswith("attrita.llm.") and name != owner and hasattr(module, "release"):
            module.release()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library: it keeps what it has


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, with underscores added until no column of ``taken`` has that name in any case."""
    names = {c.lower() for c in taken}
    while wanted.lower() in names:
        wanted += "_"
    return wanted


def text_groups(batches: Iterator[pa.RecordBatch], text: int = 1,
                chars: int = GROUP_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the record batches with their texts as Python strings; a
    slice closes once it holds ``chars`` characters (a longer text stands alone)."""
    for batch in batches:
        start, held, texts = 0, 0, []
        column = batch.column(text)
        for i in range(batch.num_rows):
            value = column[i].as_py()
            texts.append(value)
            held += len(value) if value else 0
            if held >= chars:
                yield batch.slice(start, i + 1 - start), texts
                start, held, texts = i + 1, 0, []
        if texts:
            yield batch.slice(start), texts


def map_text(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch, list[str | None]], dict],
             text: int = 1) -> DataFrame:
    """``mapInArrow`` over text groups: ``work`` gets a slice and its texts and
    returns the output columns, in the order of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    owner = work.__module__

    def run(batches):
        begin(owner)
        for part, texts in text_groups(batches, text):
            out = work(part, texts)
            yield pa.RecordBatch.from_arrays(
                [x.cast(t.type) if isinstance(x := out[n], pa.Array) else pa.array(x, type=t.type)
                 for n, t in zip(names, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


class Recent:
    """What a worker has worked out lately, in two generations: once the young
    one passes ``limit`` entries it becomes the old one, and what is asked for
    again moves back, so frequent keys stay and memory is bounded."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def hold(self, wanted: Iterable, make: Callable[[list], Iterable]) -> dict:
        """A mapping that holds all ``wanted`` keys; ``make`` gives the values of the missing ones."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old, fresh = self.young, self.old, []
        for k in wanted:
            if k not in young:
                if (v := old.get(k)) is None:
                    fresh.append(k)
                else:
                    young[k] = v
        if fresh:
            young.update(zip(fresh, make(fresh), strict=True))
        return young


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: list[np.ndarray] = []


def release() -> None:
    _powers.clear()


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT_BYTES + 4096)
        tables = []
        for base in (_MULT, _INVERSE):
            t = np.full(size, base, dtype=U)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=U))
        _powers[:] = tables
    return _powers[0], _powers[1]


def _segment_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93)), starts


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and byte position of each word ``[^\\x20\\x09-\\x0D]+`` of
    ``data``: polynomial sums over all bytes at once, cut by differences."""
    hashes, places, at = [], [], 0
    while at < len(data):
        end = at + SEGMENT_BYTES
        if end < len(data):  # on to the end of the word that the cut meets
            tail = data[end:end + 4096]
            while tail and not any(tail.find(c) >= 0 for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")):
                end += len(tail)
                tail = data[end:end + 4096]
            if tail:
                end += min(p for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r") if (p := tail.find(c)) >= 0)
        h, s = _segment_hashes(np.frombuffer(data[at:end], dtype=np.uint8))
        hashes.append(h)
        places.append(s + at)
        at = end
    if not hashes:
        return np.empty(0, U), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def to_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def grouped_words(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the offsets (len(texts) + 1) of each text's
    words; A-Z are lower-cased first, other letters stay."""
    parts = [to_bytes(t) if t else b"" for t in texts]
    data = b"\n".join(parts)
    hashes, starts = word_hashes(data.lower() if lower else data)
    ends = np.cumsum([len(p) + 1 for p in parts])
    return hashes, np.concatenate(([0], np.searchsorted(starts, ends)))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Component of each vertex of ``edges`` (a, b): columns v, comp (smallest
    vertex reachable).  Labels move along edges and then jump to their label's
    label, so long chains halve in each round; every round is a written table."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
                     .select("v", F.least("v", "m").alias("comp")), name)
    while True:
        near = (both.join(labels, both.b == labels.v).groupBy(F.col("a").alias("u")).agg(F.min("comp").alias("m")))
        moved = labels.join(near, labels.v == near.u).select("v", "comp", F.least("comp", "m").alias("goal"))
        heads = labels.select(F.col("v").alias("h"), F.col("comp").alias("up"))
        after = written(moved.join(heads, moved.goal == heads.h).select(
            "v", F.least("goal", "up").alias("comp"), (F.least("goal", "up") < F.col("comp")).alias("moved")), name)
        labels = after.select("v", "comp")
        if after.where("moved").isEmpty():
            return labels
