"""Operator 11: document fingerprints by context-triggered piecewise hashing.

A hash rolls over the last seven bytes of the UTF-8 text; a chunk of level k
ends wherever the hash has k or more trailing zero bits, which is once in 2^k
bytes on average (the block size), and wherever the text itself ends.  Chunk
ends depend on those seven bytes only, so an edit changes the chunks it touches
and leaves all others as they are.  A chunk's symbol is 12 bits (two base-64
characters) of the sum of its rolling hashes.

A fingerprint is ``block:symbols:symbols``: the smallest block size that cuts
the text into at most ``CHUNKS`` chunks, the symbols at that size and those at
twice the size.  All of the text is in both.  Two fingerprints are comparable
where they share a block size; their likeness is 1 - edits / all symbols, edits
being the fewest symbols to insert or delete (bit-parallel), at the better of
the shared sizes; 0 if they share none, 1 if they are equal.

``against_next`` pairs each document with the next one in descending order of
ids: the rows are range-partitioned and sorted once, each task pairs its own
neighbours in a stream, and the last row of each partition meets the first row
of the next one in a small second pass, whose partition list is all that the
driver sees.

Memory: a text is hashed in pieces of ``PIECE`` bytes, of which only the ends of
the levels still in question are kept.

Edge cases: null text counts as empty; an empty text has the fingerprint
``2::``; null ids come after all others; rows of equal id are ordered by their
text, so the result does not depend on the partitioning; a document alone is its
own next one; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attrita.llm.common import begin, map_text, mix, to_bytes, written

#: Most chunks of a fingerprint's finer part.
CHUNKS = 64
#: Bytes hashed at once.
PIECE = 4_000_000
#: Finished rows a task holds before it passes them on.
ROWS = 500

_M = np.uint32(0x01000193)
_M2 = np.uint32(0x01000193 ** 2 & 0xFFFFFFFF)
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)


def rolling(data: bytes, before: bytes = b"") -> np.ndarray:
    """The hash of the seven bytes up to each byte of ``data``; ``before``: the (six) bytes ahead of it."""
    r1 = np.zeros(len(data) + 6, dtype=np.uint32)
    r1[6 - len(before):6] = np.frombuffer(before, dtype=np.uint8).astype(np.uint32) + np.uint32(1)
    r1[6:] = np.frombuffer(data, dtype=np.uint8)
    r1[6:] += np.uint32(1)
    r2 = r1[:-1] * _M + r1[1:]
    r4 = r2[:-2] * _M2 + r2[2:]
    r6 = r4[:-2] * _M2 + r2[4:]
    h = (r6[:-1] * _M + r1[6:]) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return h ^ h >> np.uint32(13)


def _symbols(sums: np.ndarray) -> str:
    """The chunks' symbols from the running sums at their ends."""
    s = (mix(np.diff(sums, prepend=np.uint64(0))) >> np.uint64(52)).astype(np.int64)
    return np.stack((_LETTERS[s >> 6], _LETTERS[s & 63]), axis=1).tobytes().decode()


def fingerprint(text: str | None, piece: int = PIECE) -> str:
    data = to_bytes(text) if text else b""
    if not data:
        return "2::"
    level, total = 1, np.uint64(0)
    sums, levels = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint8)
    for at in range(0, len(data), piece):
        h = rolling(data[at:at + piece], data[max(0, at - 6):at])
        zeros = np.bitwise_count(~h & (h - np.uint32(1)))
        running = np.cumsum(h, dtype=np.uint64)
        running += total
        total = running[-1]
        ends = np.flatnonzero(zeros >= level)
        if at + piece >= len(data) and len(ends) and ends[-1] == len(h) - 1:
            ends = ends[:-1]  # the text's end closes a chunk of every level
        sums, levels = np.concatenate((sums, running[ends])), np.concatenate((levels, zeros[ends]))
        above = np.cumsum(np.bincount(levels, minlength=34)[::-1])[::-1]
        while above[level] >= CHUNKS:
            level += 1
        sums, levels = sums[levels >= level], levels[levels >= level]
    return f"{1 << level}:{_symbols(np.append(sums, total))}:{_symbols(np.append(sums[levels > level], total))}"


def edits(a: list[str], b: list[str]) -> int:
    """Fewest insertions and deletions that turn ``a`` into ``b``: a column of the table of common subsequences at a time, as bits."""
    places: dict[str, int] = {}
    for i, s in enumerate(a):
        places[s] = places.get(s, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for s in b:
        if m := v & places.get(s, 0):
            v = (v + m | v - m) & full
    return len(a) + len(b) - 2 * (len(a) - v.bit_count())


def _levels(f: str) -> dict[int, list[str]]:
    block, *parts = f.split(":")
    return {int(block) << k: [s[i:i + 2] for i in range(0, len(s), 2)] for k, s in enumerate(parts)}


def likeness(f: str, g: str) -> float:
    if f == g:
        return 1.0
    a, b = _levels(f), _levels(g)
    return max((1 - edits(a[k], b[k]) / (len(a[k]) + len(b[k])) for k in a.keys() & b.keys() if a[k] or b[k]), default=0.0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and fingerprint."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_text(docs.select(id_col, text_col), f"{id_col} {kind}, fingerprint string",
                    lambda part, texts: {id_col: part.column(0), "fingerprint": [fingerprint(t) for t in texts]})


def edited(text: str, after: str) -> str:
    """The last half of ``text`` replaced by as much of ``after``'s beginning, or all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def _compared(key, text: str, own: str, after: str, other: str) -> dict:
    changed = edited(text, after)
    f = fingerprint(changed)
    return {"id": key, "n_chars": len(text), "edited_sha256": hashlib.sha256(to_bytes(changed)).hexdigest(), "fingerprint": own,
            "edited_fingerprint": f, "near_edited": likeness(own, f), "near_next": likeness(own, other)}


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    kind = docs.schema[id_col].dataType.simpleString()
    result = (f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    ddl = f"{result}, part int, place string, text string"
    arrow, paired = to_arrow_schema(StructType.fromDDL(ddl)), to_arrow_schema(StructType.fromDDL(result))
    order = [F.desc_nulls_last("id"), F.xxhash64("text"), F.col("text")]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        begin(__name__)
        part, held, out = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                key, text = key.as_py(), text.as_py()
                own = fingerprint(text)
                if held is None:
                    out.append({"id": key, "fingerprint": own, "part": part, "place": "first", "text": text})
                else:
                    out.append(_compared(*held, text, own))
                held = key, text, own
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if held:
            out.append({"id": held[0], "fingerprint": held[2], "part": part, "place": "last", "text": held[1]})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    def meet(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist([_compared(*(c[i].as_py() for c in batch.columns))], schema=paired)

    done = written(rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInArrow(run, ddl), "neighbours")
    parts = sorted(r.part for r in done.where("place = 'first'").select("part").collect())  # at most one a partition
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, goal int")
    first = done.where("place = 'first'").select(F.col("part").alias("goal"), F.col("text").alias("after"),
                                                 F.col("fingerprint").alias("other"))
    last = (done.where("place = 'last'").join(follows, "part").join(first, "goal")
            .select("id", "text", "fingerprint", "after", "other").mapInArrow(meet, result))
    whole = done.where("place is null").select(*paired.names).unionByName(last)
    return whole.withColumnRenamed("id", id_col)


def query(spark, sf_dir):
    return against_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
