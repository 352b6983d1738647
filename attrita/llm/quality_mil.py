"""Operator 10: quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Every passage of
every whole text is encoded (byte histogram, share of different words, of
immediate repeats, mean word length, through a learned layer), gated attention
weights say how much each passage counts, and the weighted sum of the passage
codes is scored.  Encoder, attention and output are learned together from
document labels alone (class-weighted cross-entropy, Adam, fixed seed).

The fit uses a bounded sample: per class the ``SAMPLE_DOCS`` labelled documents
with the smallest id hash, all their passages (264 bytes each at the driver).
Scoring covers all passages of all documents.

Edge cases: a null or empty text is one passage without words and gets a score
like any other; null labels and null ids are not learned from, repeated or
conflicting label rows each count; without any labels the score is 1 (nothing
is rejected), with labels of one class only it leans to that class; a null id
counts as not held out; repeated rows stay; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrita.llm.common import U, begin, map_text, mix, text_groups, to_bytes, word_hashes

PASSAGE_WORDS = 64
SAMPLE_DOCS = 1_500
CODE, GATE = 24, 16
EPOCHS, RATE = 250, 0.02
THRESHOLD = 0.3
FEATURES = 128 + 4


def passage_features(texts: list[str | None], words: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Features (passage, FEATURES) and offsets (len(texts) + 1) of each text's passages (one at least)."""
    parts = [to_bytes(t) if t else b"" for t in texts]
    data = b"\n".join(parts) + b"\n"
    hashes, starts = word_hashes(data)
    ends = np.cumsum([len(p) + 1 for p in parts])
    firsts = np.concatenate(([0], np.searchsorted(starts, ends)))
    n_words = np.diff(firsts)
    n_passages = np.maximum(1, -(-n_words // words))
    offsets = np.concatenate(([0], np.cumsum(n_passages)))
    doc = np.repeat(np.arange(len(texts)), n_words)
    of_word = offsets[doc] + (np.arange(len(hashes)) - firsts[doc]) // words
    total = int(offsets[-1])
    # a passage starts with its first word, a text's first one with the text
    begin = np.concatenate(([0], ends[:-1]))
    cuts = np.zeros(total, dtype=np.int64)
    cuts[offsets[:-1]] = begin
    inner = np.flatnonzero((np.arange(len(hashes)) - firsts[doc]) % words == 0) if len(hashes) else np.empty(0, np.int64)
    later = inner[inner != firsts[doc[inner]]] if len(inner) else inner
    cuts[of_word[later]] = starts[later]
    sizes = np.diff(np.append(cuts, len(data)))
    of_byte = np.repeat(np.arange(total), sizes)
    buf = np.minimum(np.frombuffer(data, dtype=np.uint8), 127)
    out = np.zeros((total, FEATURES), dtype=np.float32)
    counts = np.bincount(of_byte * 128 + buf, minlength=total * 128).reshape(total, 128)
    out[:, :128] = np.sqrt(counts / np.maximum(1, sizes)[:, None])
    held = np.bincount(of_word, minlength=total)
    some = np.maximum(1, held)
    _, at = np.unique(mix(hashes + of_word.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)
    out[:, 128] = np.bincount(of_word[at], minlength=total) / some
    same = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
    out[:, 129] = np.bincount(of_word[1:][same], minlength=total) / some
    out[:, 130] = np.minimum(sizes / some, 64) / 16
    out[:, 131] = held / words
    return out, offsets


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class AttentionMil:
    """Encoder, gated attention, output; bags are passages between offsets."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"w": g(FEATURES, CODE), "b": np.zeros(CODE), "v": g(CODE, GATE), "u": g(CODE, GATE),
                  "a": g(GATE, 1)[:, 0], "c": g(CODE, 1)[:, 0], "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def forward(self, x: np.ndarray, offsets: np.ndarray) -> dict:
        p, starts, bag = self.p, offsets[:-1], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * s) @ p["a"]
        k = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        weight = k / np.add.reduceat(k, starts)[bag]
        z = np.add.reduceat(weight[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "s": s, "weight": weight, "z": z, "bag": bag, "score": _sigmoid(z @ p["c"] + p["d"][0])}

    def fit(self, x: np.ndarray, offsets: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> AttentionMil:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-2
        share = np.array([max(1, (label == k).sum()) for k in (0, 1)])
        weights = 1 / (2 * share[label])
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        q = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, epochs + 1):
            f, p = self.forward(x, offsets), self.p
            dl = weights * (f["score"] - label)
            dz = dl[:, None] * p["c"]
            own = dz[f["bag"]]
            dh = f["weight"][:, None] * own
            dw = (own * f["h"]).sum(axis=1)
            de = f["weight"] * (dw - np.add.reduceat(f["weight"] * dw, offsets[:-1])[f["bag"]])
            gate = de[:, None] * p["a"]
            dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
            dh = (dh + dt @ p["v"].T + ds @ p["u"].T) * (1 - f["h"] ** 2)
            grad = {"w": f["x"].T @ dh, "b": dh.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ ds,
                    "a": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dl, "d": np.array([dl.sum()])}
            for k, g in grad.items():
                g = g + 1e-5 * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                q[k] = 0.999 * q[k] + 0.001 * g * g
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(q[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.forward(*passage_features(texts))["score"]


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> AttentionMil | None:
    """Learn from labelled rows outside the held-out fifth; None without any."""
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(
        F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out("_id"))
    usable = usable.join(docs.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi")
    first = lambda k: usable.where(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_DOCS)
    sample = first(0).union(first(1)).cache()
    rows = docs.select(id_col, text_col).join(F.broadcast(sample), docs[id_col] == sample["_id"]).select(text_col, "_label")

    def run(batches):
        begin(__name__)
        for part, texts in text_groups(batches, 0):
            x, offsets = passage_features(texts)
            out = [x[a:b].astype("<f2").tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary()), part.column(1)], names=["x", "label"])

    bags = sorted(tuple(r) for r in rows.mapInArrow(run, "x binary, label int").collect())
    sample.unpersist()
    if not bags:
        return None
    x = [np.frombuffer(b, dtype="<f2").reshape(-1, FEATURES).astype(np.float64) for b, _ in bags]
    return AttentionMil().fit(np.concatenate(x), np.concatenate(([0], np.cumsum([len(b) for b in x]))),
                              np.array([k for _, k in bags]))


def score_documents(docs: DataFrame, model: AttentionMil | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score, attention (the weight of each passage of the text)."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(part, texts):
        if known.value is None:
            return {"doc": part.column(0), "score": np.ones(len(texts)), "attention": [[] for _ in texts]}
        x, offsets = passage_features(texts)
        f = known.value.forward(x, offsets)
        weights = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(f["weight"]))
        return {"doc": part.column(0), "score": f["score"], "attention": weights}

    return map_text(docs.select(id_col, text_col), f"doc {kind}, score double, attention array<double>", work
                    ).withColumnRenamed("doc", id_col)


def keep_good(docs: DataFrame, model: AttentionMil | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the model does not reject, all columns as they are."""
    if model is None:
        return docs
    names = [text_col, *[c for c in docs.columns if c != text_col]]
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        begin(__name__)
        for part, texts in text_groups(batches, 0):
            yield part.filter(pa.array(known.value.scores(texts) >= threshold))

    rows = docs.select(*names)
    return rows.mapInArrow(run, rows.schema).select(*docs.columns)


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
