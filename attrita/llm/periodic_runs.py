"""Operator 13: periodic runs of words, found by internal pattern matching.

A run is a stretch of words with smallest period q, at least 2 q and
``least`` words long, that no neighbouring word extends.  Texts are worked on
in groups, set one after the other with a separator word of its own after each:

1. names: equal blocks of 2^k words get equal names (the number of blocks that
   sort before), by doubling, in which only blocks that still occur twice in
   their text are sorted again.  The last names are the suffix array, and the
   occurrences of any block are an interval of it;
2. a wavelet tree over that array answers range successor queries: the first
   occurrence of a block at or after a position;
3. dyadic blocks: a run of period 2^(k+1) - 1 .. 2^(k+2) - 2 holds a block of
   2^k words that starts at a multiple of 2^k and comes again one period later.
   So each such block asks for its occurrences in that neighbouring window
   (periods 1 to 6: blocks of two words, as runs have ``least`` words);
4. occurrences at most half a block apart form a progression whose difference
   d is the block's period.  With [s1, e1) the stretch of period d around the
   block and [s2, e2) the one around the progression, the periods that can
   arise are d, e2 - e1, s2 - s1, and, where the stretches touch, each step of
   the progression up to min(e1 - s1, e2 - s2, (e2 - s1) / 2); other
   occurrences are candidates as they stand;
5. each candidate is extended to both sides over the names of all levels
   (largest block first); of the periods found for one stretch the least stays.

All of it is exact: words get numbers by a dictionary, no hashes are compared.
A group takes about 4 bytes a word for each level on which some block of its
texts still repeats (at most log2 of the longest text's words).

Edge cases: a null text has no words; texts without runs give an empty array;
repeated rows and ids, null ids too, are kept, one output row each; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrita.llm.common import map_text, to_bytes

#: Fewest words of a run.  Step 3 needs 12 at least: a block of two words for periods up to 6.
LEAST = 12


class Names:
    """``levels[k][i]``: equal for equal blocks of 2^k codes at i.  ``blocks[k]``: starts, at multiples of 2^k, of
    the blocks that occur again, with their intervals in ``order`` (starts of repeated pairs, sorted by suffix)."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        counts = np.bincount(codes)
        name, size = (np.cumsum(counts) - counts)[codes], counts[codes]
        self.levels, repeated = [], []
        while True:
            self.levels.append(name.astype(np.int32))
            live = np.flatnonzero(size > 1)
            step = 1 << len(self.levels) - 1
            at = live[live % step == 0]
            repeated.append((at, name[at], size[at]))
            if len(self.levels) == 2:
                pairs = live
            if not len(live):
                break
            key = name[live] * n + name[live + step]  # a repeated block holds no separator, so it ends before the last
            by = np.argsort(key, kind="stable")
            key, live = key[by], live[by]
            group = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            old = name[live]
            klass = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
            many = np.diff(np.append(group, len(live)))
            start = klass[np.searchsorted(klass, group, "right") - 1]
            name, size = name.copy(), np.ones(n, dtype=np.int64)
            name[live] = np.repeat(old[group] + group - start, many)
            size[live] = np.repeat(many, many)
        if len(self.levels) == 1:
            pairs = np.empty(0, dtype=np.int64)
        self.order = pairs[np.argsort(name[pairs])]
        held = np.zeros(n + 1, dtype=np.int64)
        held[name[pairs] + 1] = 1
        held = np.cumsum(held)
        self.blocks = [(at, held[first], held[first + size]) for at, first, size in repeated]

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that starts at i and at j."""
        done = np.zeros(len(i), dtype=np.int64)
        for k in reversed(range(len(self.levels))):
            done += (self.levels[k][i + done] == self.levels[k][j + done]).astype(np.int64) << k
        return done

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that ends before i and before j."""
        done = np.zeros(len(i), dtype=np.int64)
        for k in reversed(range(len(self.levels))):
            a, b = i - done - (1 << k), j - done - (1 << k)
            fits = (a >= 0) & (b >= 0)
            done += (fits & (self.levels[k][np.where(fits, a, 0)] == self.levels[k][np.where(fits, b, 0)])).astype(np.int64) << k
        return done


class WaveletTree:
    """Range successor over an array of positions below ``bound``."""

    def __init__(self, values: np.ndarray, bound: int):
        self.bits, self.levels = max(1, int(bound).bit_length()), []
        for b in reversed(range(self.bits)):
            zero = (values >> b & 1) == 0
            before = np.concatenate(([0], np.cumsum(zero))).astype(np.int32)
            self.levels.append((b, before, int(before[-1])))
            values = np.concatenate((values[zero], values[~zero]))

    def successor(self, left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Smallest value of ``[left, right)`` that is ``least`` or more; -1 if there is none."""
        below, a, b = np.zeros(len(left), dtype=np.int64), left, right
        for bit, before, zeros in self.levels:
            one = (least >> bit & 1) == 1
            a0, b0 = before[a], before[b]
            below += np.where(one, b0 - a0, 0)
            a, b = np.where(one, zeros + a - a0, a0), np.where(one, zeros + b - b0, b0)
        none = (below >= right - left) | (least >> self.bits > 0)
        a, b, rest, value = left, right, np.where(none, 0, below), np.zeros(len(left), dtype=np.int64)
        for bit, before, zeros in self.levels:
            a0, b0 = before[a], before[b]
            one = rest >= b0 - a0
            rest = np.where(one, rest - (b0 - a0), rest)
            value |= one.astype(np.int64) << bit
            a, b = np.where(one, zeros + a - a0, a0), np.where(one, zeros + b - b0, b0)
        return np.where(none, -1, value)


def _candidates(names: Names, tree: WaveletTree, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, q): positions of level k's blocks, and periods that a run around x may have."""
    x, left, right = names.blocks[k]
    size = 1 << k
    at, last = x + (1 if k == 1 else 2 * size - 1), x + 4 * size - 2
    places, periods = [], []
    while len(x):
        y = tree.successor(left, right, at)
        keep = (y >= 0) & (y <= last)
        x, left, right, last, y = x[keep], left[keep], right[keep], last[keep], y[keep]
        after = tree.successor(left, right, y + 1)
        series = (after >= 0) & (after <= last) & (after - y <= size // 2)
        places.append(x[~series])
        periods.append((y - x)[~series])
        at = y + 1
        if series.any():
            p, f, d = x[series], y[series], (after - y)[series]
            s1, e1 = p - names.backward(p, p + d), p + d + names.forward(p, p + d)
            s2, e2 = f - names.backward(f, f + d), f + d + names.forward(f, f + d)
            end = f + (e2 - size - f) // d * d
            at[series] = end + 1
            apart = s1 != s2
            most = np.minimum(np.minimum(e1 - s1, e2 - s2), (e2 - s1) // 2)
            steps = (np.minimum(np.minimum(end, last[series]), p + most) - f) // d + 1
            steps = np.where(apart & (s2 <= e1), np.maximum(steps, 0), 0)
            own = np.repeat(np.arange(len(p)), steps)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(steps) - steps, steps)
            places += [p, p[apart], p[apart], p[own]]
            periods += [d, (e2 - e1)[apart], (s2 - s1)[apart], (f - p)[own] + nth * d[own]]
    if not places:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(places), np.concatenate(periods)


def runs(codes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of all runs of ``codes``, by start, then period.
    ``codes`` are small integers; its last one, and each separator, comes once only."""
    names = Names(codes)
    tree = WaveletTree(names.order, len(codes))
    found = [_candidates(names, tree, k) for k in range(1, len(names.levels))]
    x = np.concatenate([f[0] for f in found]) if found else np.empty(0, dtype=np.int64)
    q = np.concatenate([f[1] for f in found]) if found else np.empty(0, dtype=np.int64)
    fits = (q > 0) & (x + q < len(codes))
    pair = np.unique(x[fits] * len(codes) + q[fits])
    x, q = pair // len(codes), pair % len(codes)
    start, end = x - names.backward(x, x + q), x + q + names.forward(x, x + q)
    long = end - start >= np.maximum(least, 2 * q)
    start, end, q = start[long], end[long], q[long]
    by = np.lexsort((q, end, start))
    start, end, q = start[by], end[by], q[by]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[first], end[first], q[first]
    by = np.lexsort((q, start))
    return start[by], end[by], q[by]


def _coded(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """One number a word, different in different texts, and a separator after each text; the texts' offsets."""
    parts, used = [], 0
    for words in texts:
        seen: dict[bytes, int] = {}
        own = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
        parts += [own + used, [used + len(seen)]]
        used += len(seen) + 1
    return np.concatenate(parts).astype(np.int64), np.cumsum([0] + [len(w) + 1 for w in texts])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per input row: ``id_col``, n_words, runs (start, length and smallest period of each run, by start,
    then period) and collapsed: the words, joined by one space, that no run holds after its first period."""
    if least < LEAST:
        raise ValueError(f"runs have {LEAST} words at least")
    kind = docs.schema[id_col].dataType.simpleString()

    def work(part, texts):
        words = [to_bytes(t).split() if t else [] for t in texts]  # bytes: ASCII white space only
        codes, offsets = _coded(words)
        start, end, q = runs(codes, least)
        again = np.zeros(len(codes) + 1, dtype=np.int64)
        np.add.at(again, start + q, 1)
        np.add.at(again, end, -1)
        kept = np.cumsum(again) == 0
        collapsed = [b" ".join(w for w, k in zip(ws, kept[a:a + len(ws)].tolist(), strict=True) if k)
                     if (~kept[a:a + len(ws)]).any() else b" ".join(ws) for ws, a in zip(words, offsets, strict=False)]
        cuts = np.searchsorted(start, offsets)
        owner = np.searchsorted(offsets, start, "right") - 1
        found = pa.StructArray.from_arrays([pa.array(start - offsets[owner]), pa.array(end - start), pa.array(q)],
                                           names=["start", "length", "period"])
        return {id_col: part.column(0), "n_words": [len(w) for w in words],
                "runs": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), found),
                "collapsed": [c.decode("utf-8", "surrogatepass") for c in collapsed]}

    return map_text(docs.select(id_col, text_col),
                    f"{id_col} {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string", work)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text as the contract has them: with h = crc32(doc_id), g = h div 10, each tenth text's words from
    a = g mod n on repeat the first p = 1 + (n - a) div (3 + g mod 8) of them.  A null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    parts = (docs.select("doc_id", "text", (F.floor(h / 10)).alias("g"), F.when(h % 10 == 0, words).alias("w"))
             .withColumn("a", F.when(F.size("w") > 0, F.col("g") % F.size("w")).cast("int"))
             .withColumn("rest", F.size("w") - F.col("a"))
             .withColumn("p", (1 + F.floor(F.col("rest") / (3 + F.col("g") % 8))).cast("int")))
    cycle = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(F.col("rest") / F.col("p")).cast("int")))
    changed = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), cycle), F.lit(1), F.size("w")), " ")
    return parts.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r.length.alias("length"), (-r.start).alias("before"), (-r.period).alias("less"))))
    return (periodic_runs(planted(docs))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"),
                    F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256"))
            .select("doc_id", "n_runs", (-F.col("top.before")).alias("start"), F.col("top.length").alias("length"),
                    (-F.col("top.less")).alias("period"),
                    F.expr("1000 * top.length div -top.less").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"))
