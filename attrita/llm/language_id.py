"""Operator 2: language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability under a language is the sum over *all* its segmentations
into pieces (forward algorithm); pieces never cross white space, so a text's
log-probability is the sum over its words, and the posterior over languages
(equal priors) gives the prediction and its score.

Training counts every word of every training text (one table of language,
word, count), then runs expectation-maximisation over it: the expected count of
each piece under all segmentations (forward-backward) becomes its next
probability.  Only the piece table (vocabulary x languages, a few MB) meets at
the driver and is broadcast; the word table stays distributed.

Words are lower-cased and split at white space.  A character that the
vocabulary lacks is spelled by its UTF-8 bytes, which are pieces too, so any
text has a probability.  Words of one batch are scored together, position by
position, in numpy; those whose sum comes near the smallest double in some
language are summed again in logarithms, and longer ones than
``VECTOR_SYMBOLS`` go through a scaled loop.  A text's sum is over its own
words alone.  Nothing is cut.

Edge cases: a null text, or one without a letter, gives ``und`` with score 0;
without any training text every prediction is ``und``; ties go to the language
that sorts first; null languages and null ids are not learned from; a null id
counts as not held out; repeated rows stay; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrita.llm.common import Recent, U, map_text, text_groups, written

VOCABULARY = "piece_bpe_32k.model"
EM_ROUNDS = 2
#: Added to each piece's expected count.
SMOOTHING = 0.1
VECTOR_SYMBOLS = 48
#: Word sums under this are worked out in logarithms (what a sum above it loses
#: to underflow is less than its rounding error).
LEAST_SUM = 1e-280
#: Words whose scores a worker remembers (a generation).
CACHED_WORDS = 200_000
#: (language, word) counts a training task holds before it passes them on.
HELD_COUNTS = 250_000
_BYTE = 0x110000
_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Pieces:
    """The vocabulary's pieces as strings of symbols, found by rolling hash."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        spelled: dict[tuple[int, ...], int] = {}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                spelled[(_BYTE + int(sp.id_to_piece(i)[3:5], 16),)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                spelled[tuple(map(ord, sp.id_to_piece(i)))] = i
        self.size = sp.get_piece_size()
        for b in range(256):  # bytes that the vocabulary lacks get ids of their own
            if (_BYTE + b,) not in spelled:
                spelled[(_BYTE + b,)] = self.size
                self.size += 1
        self.ids = spelled
        self.longest = max(map(len, spelled))
        self.single = np.array(sorted(k[0] for k in spelled if len(k) == 1), dtype=np.uint32)
        self.bits = 20
        self.keys = np.zeros(1 << self.bits, dtype=U)
        self.values = np.full(1 << self.bits, -1, dtype=np.int32)
        self.probes = 1
        for k, i in spelled.items():
            h = 0
            for j, c in enumerate(k):
                h = (h + (c + 1) * pow(_MULT, j, 1 << 64)) & _MASK
            at, tries = self._slot(h), 1
            while self.values[at] >= 0:
                at, tries = (at + 1) & ((1 << self.bits) - 1), tries + 1
            self.keys[at], self.values[at] = h, i
            self.probes = max(self.probes, tries)

    def _slot(self, h: int) -> int:
        return ((h * 0xD6E8FEB86659FD93) & _MASK) >> (64 - self.bits)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        at = (h * U(0xD6E8FEB86659FD93)) >> U(64 - self.bits)
        out = np.full(len(h), -1, dtype=np.int32)
        for _ in range(self.probes):
            hit = (self.keys[at] == h) & (out < 0)
            out[hit] = self.values[at[hit]]
            at = (at + U(1)) & U((1 << self.bits) - 1)
        return out

    def spell(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all words, each behind its mark, and their lengths;
        characters that the vocabulary lacks as bytes."""
        codes = np.frombuffer("".join(["▁" + w for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        at = np.minimum(np.searchsorted(self.single, codes), len(self.single) - 1)
        unknown = np.flatnonzero(self.single[at] != codes)
        if not len(unknown):
            return codes, lengths
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in codes[unknown].tolist()]
        sizes = np.ones(len(codes), dtype=np.int64)
        sizes[unknown] = [len(b) for b in spelled]
        out = np.repeat(codes, sizes)
        firsts = (np.cumsum(sizes) - sizes)[unknown]
        for first, data in zip(firsts.tolist(), spelled, strict=True):
            out[first:first + len(data)] = [_BYTE + b for b in data]
        return out, np.add.reduceat(sizes, np.cumsum(lengths) - lengths)


@lru_cache(maxsize=2)
def pieces(model_file: str) -> Pieces:
    return Pieces(model_file)


class Lattice:
    """All pieces of a batch of words, and sums over their segmentations."""

    def __init__(self, vocab: Pieces, codes: np.ndarray, lengths: np.ndarray):
        """codes: the words' symbols, longest word first."""
        self.vocab, self.codes, self.lengths = vocab, codes, lengths
        self.starts = np.cumsum(lengths) - lengths
        self.longest = int(self.lengths[0])
        n = len(codes)
        up = np.full(n + 1, U(_MULT))
        up[0] = 1
        up = np.cumprod(up, dtype=U)
        down = np.full(n + 1, U(pow(_MULT, -1, 1 << 64)))
        down[0] = 1
        down = np.cumprod(down, dtype=U)
        sums = np.concatenate(([U(0)], np.cumsum((codes.astype(U) + U(1)) * up[:n], dtype=U)))
        ends = np.repeat(self.starts + self.lengths, self.lengths)
        self.pieces = []
        for size in range(1, min(vocab.longest, self.longest) + 1):
            at = np.arange(n - size + 1)
            ids = np.full(n, -1, dtype=np.int32)
            inside = at + size <= ends[: n - size + 1]
            at = at[inside]
            ids[at] = vocab.look_up((sums[at + size] - sums[at]) * down[at])
            self.pieces.append(ids)

    def steps(self, backward: bool = False):
        """(position, piece length, words, piece ids) in the order of the sums."""
        for j in range(self.longest, 0, -1) if backward else range(1, self.longest + 1):
            active = int(np.searchsorted(-self.lengths, -j, side="right"))
            for size in range(1, min(j, len(self.pieces)) + 1):
                ids = self.pieces[size - 1][self.starts[:active] + j - size]
                rows = np.flatnonzero(ids >= 0)
                if len(rows):
                    yield j, size, rows, ids[rows]

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """Sums (word, position, language); prob: (piece, language)."""
        alpha = np.zeros((self.longest + 1, len(self.lengths), prob.shape[1]))
        alpha[0] = 1
        for j, size, rows, ids in self.steps():
            alpha[j, rows] += alpha[j - size, rows] * prob[ids]
        return alpha

    def log_forward(self, prob: np.ndarray) -> np.ndarray:
        """Logarithms of ``forward``, for sums that a double can't hold."""
        alpha = np.full((self.longest + 1, len(self.lengths), prob.shape[1]), -np.inf)
        alpha[0] = 0
        log_prob = np.log(prob)
        for j, size, rows, ids in self.steps():
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[j - size, rows] + log_prob[ids])
        return alpha

    def part(self, rows: np.ndarray) -> Lattice:
        n = self.lengths[rows]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return Lattice(self.vocab, self.codes[np.repeat(self.starts[rows], n) + inner], n)

    def log_probability(self, prob: np.ndarray) -> np.ndarray:
        total = self.forward(prob)[self.lengths, np.arange(len(self.lengths))]
        low = np.flatnonzero((total < LEAST_SUM).any(axis=1))
        out = np.log(np.maximum(total, LEAST_SUM))
        if len(low):
            out[low] = self.part(low).log_forward(prob)[self.lengths[low], np.arange(len(low))]
        return out

    def expected(self, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts, each word weighted; prob: one language's (piece, 1)."""
        alpha = self.forward(prob)[:, :, 0]
        p = prob[:, 0]
        at = np.arange(len(self.lengths))
        total = alpha[self.lengths, at]
        low = np.flatnonzero(total < LEAST_SUM)
        beta = np.zeros_like(alpha)
        beta[self.lengths, at] = np.where(total < LEAST_SUM, 0, weight / np.maximum(total, LEAST_SUM))
        counts = np.zeros(len(p))
        for j, size, rows, ids in self.steps(backward=True):
            flow = beta[j, rows] * p[ids]
            beta[j - size, rows] += flow
            counts += np.bincount(ids, flow * alpha[j - size, rows], minlength=len(p))
        if len(low):
            counts += self.part(low).log_expected(prob, weight[low])
        return counts

    def log_expected(self, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """``expected`` with sums in logarithms."""
        alpha = self.log_forward(prob)[:, :, 0]
        log_p = np.log(prob[:, 0])
        at = np.arange(len(self.lengths))
        total = alpha[self.lengths, at]
        beta = np.full_like(alpha, -np.inf)
        beta[self.lengths, at] = 0
        counts = np.zeros(len(log_p))
        for j, size, rows, ids in self.steps(backward=True):
            flow = beta[j, rows] + log_p[ids]
            beta[j - size, rows] = np.logaddexp(beta[j - size, rows], flow)
            counts += np.bincount(ids, weight[rows] * np.exp(flow + alpha[j - size, rows] - total[rows]), minlength=len(log_p))
        return counts


def _long_sums(vocab: Pieces, codes: np.ndarray, prob: np.ndarray, weight: float = 0.0):
    """Log-probability of one long word per language and, for a weight, its
    expected counts (prob of one language); rescaled at each position."""
    n, m = len(codes), vocab.longest
    at = Lattice(vocab, codes, np.array([n])).pieces
    alpha = np.zeros((n + 1, prob.shape[1]))
    scale = np.zeros((n + 1, prob.shape[1]))  # log of what alpha at a position was divided by
    alpha[0] = 1
    for j in range(1, n + 1):
        low = scale[max(0, j - m):j].max(axis=0)
        for size in range(1, min(j, m) + 1):
            if (i := at[size - 1][j - size]) >= 0:
                alpha[j] += alpha[j - size] * prob[i] * np.exp(scale[j - size] - low)
        alpha_j = np.maximum(alpha[j], 1e-300)
        scale[j] = low + np.log(alpha_j)
        alpha[j] = alpha[j] / alpha_j
    log_z = scale[n]
    if not weight:
        return log_z, None
    counts = np.zeros(prob.shape[0])
    log_beta = np.full(n + 1, -np.inf)
    log_beta[n] = 0.0
    for j in range(n, 0, -1):
        if log_beta[j] == -np.inf:
            continue
        for size in range(1, min(j, m) + 1):
            if (i := at[size - 1][j - size]) >= 0:
                flow = log_beta[j] + np.log(prob[i, 0])
                log_beta[j - size] = np.logaddexp(log_beta[j - size], flow)
                counts[i] += weight * np.exp(flow + scale[j - size, 0] - log_z[0])
    return log_z, counts


def _batches(vocab: Pieces, words: list[str], size: int = 20_000):
    """(places, codes, lengths) of the words up to VECTOR_SYMBOLS, longest
    first, and (place, codes) of each longer one."""
    codes, lengths = vocab.spell(words)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    first = int(np.searchsorted(-lengths[order], -VECTOR_SYMBOLS))
    blocks = []
    for i in range(first, len(order), size):
        own = order[i:i + size]
        n = lengths[own]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        blocks.append((own, codes[np.repeat(starts[own], n) + inner], n))
    return blocks, [(i, codes[starts[i]:starts[i] + lengths[i]]) for i in order[:first].tolist()]


def word_scores(vocab: Pieces, words: list[str], prob: np.ndarray) -> np.ndarray:
    """log P(word | language), over all segmentations: (word, language)."""
    out = np.empty((len(words), prob.shape[1]))
    short, long = _batches(vocab, words)
    for places, codes, lengths in short:
        out[places] = Lattice(vocab, codes, lengths).log_probability(prob)
    for i, s in long:
        out[i] = _long_sums(vocab, s, prob)[0]
    return out


def expected_counts(vocab: Pieces, words: list[str], weights: np.ndarray, prob: np.ndarray) -> np.ndarray:
    counts = np.zeros(prob.shape[0])
    short, long = _batches(vocab, words)
    for places, codes, lengths in short:
        counts += Lattice(vocab, codes, lengths).expected(prob, weights[places])
    for i, s in long:
        counts += _long_sums(vocab, s, prob, float(weights[i]))[1]
    return counts


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, word, n over all texts."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def flush(held):
        rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
        held.clear()
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(
                zip(*rows[i:i + 10_000], strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        held: dict[str, Counter] = {}
        for part, texts in text_groups(batches, 0):
            for lang, text in zip(part.column(1).to_pylist(), texts, strict=True):
                held.setdefault(lang, Counter()).update(text.lower().split())
            if sum(map(len, held.values())) > HELD_COUNTS:
                yield from flush(held)
        yield from flush(held)

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, lang_col)
    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", vocabulary: str | None = None,
        rounds: int = EM_ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and piece probabilities (piece, language)."""
    vocabulary = vocabulary or default_vocabulary()
    spark, vocab = docs.sparkSession, pieces(vocabulary)
    table = written(word_counts(docs, text_col, lang_col), "word-counts")
    langs = sorted(r[0] for r in table.select("lang").distinct().collect())
    place = {lang: i for i, lang in enumerate(langs)}
    prob = np.full((vocab.size, max(1, len(langs))), 1 / vocab.size)
    for _ in range(rounds if langs else 0):
        model = spark.sparkContext.broadcast(prob)

        def run(batches, model=model):
            own, prob = pieces(vocabulary), model.value
            counts = np.zeros_like(prob)
            for batch in batches:
                lang = np.array([place[x] for x in batch.column(0).to_pylist()])
                words, n = np.array(batch.column(1).to_pylist(), dtype=object), batch.column(2).to_numpy().astype(float)
                for k in np.unique(lang):
                    at = lang == k
                    counts[:, k] += expected_counts(own, words[at].tolist(), n[at], prob[:, k:k + 1])
            i, k = np.nonzero(counts)
            yield pa.RecordBatch.from_pydict({"piece": i.astype(np.int32), "lang": k.astype(np.int32), "c": counts[i, k]})

        sums = (table.mapInArrow(run, "piece int, lang int, c double")
                .groupBy("piece", "lang").agg(F.sum("c").alias("c")).toPandas())
        counts = np.full(prob.shape, SMOOTHING)
        counts[sums["piece"], sums["lang"]] += sums["c"]
        prob = counts / counts.sum(axis=0)
        model.unpersist()
    return langs, prob


class _Scorer:
    """Sums of word scores; a worker remembers the words it meets often."""

    def __init__(self, vocab: Pieces, prob: np.ndarray):
        self.vocab, self.prob, self.known = vocab, prob, Recent(CACHED_WORDS)

    def _rows(self, words: list[str]) -> list[bytes]:
        data, width = word_scores(self.vocab, words, self.prob).tobytes(), 8 * self.prob.shape[1]
        return [data[i:i + width] for i in range(0, len(data), width)]

    def sums(self, texts: list[str | None]) -> np.ndarray:
        place: dict[str, int] = {}
        ids, ends = [], [0]
        for text in texts:
            if text:
                ids += [place.setdefault(w, len(place)) for w in text.lower().split()]
            ends.append(len(ids))
        langs = self.prob.shape[1]
        if not ids:
            return np.zeros((len(texts), langs))
        known = self.known.hold(place, self._rows)
        scores = np.frombuffer(b"".join(map(known.__getitem__, place))).reshape(-1, langs)
        owner, ids = np.repeat(np.arange(len(texts)), np.diff(ends)), np.array(ids)
        return np.stack([np.bincount(owner, scores[ids, k], minlength=len(texts)) for k in range(langs)], axis=1)


_scorers: dict[str, _Scorer] = {}


def release() -> None:
    _scorers.clear()


def predict(docs: DataFrame, langs: list[str], prob: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
            vocabulary: str | None = None) -> DataFrame:
    """``id_col``, lang_pred, score (posterior of the predicted language)."""
    vocabulary = vocabulary or default_vocabulary()
    model = docs.sparkSession.sparkContext.broadcast(prob)
    name = f"{id(prob)}-{hash((vocabulary, prob.tobytes()))}"

    def work(part, texts):
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = _Scorer(pieces(vocabulary), model.value)
        logs = _scorers[name].sums(texts)
        shifted = np.exp(logs - logs.max(axis=1, keepdims=True))
        best, top = logs.argmax(axis=1), 1 / shifted.sum(axis=1)
        known = [bool(langs) and t is not None and any(map(str.isalpha, t)) for t in texts]
        return {"doc": part.column(0), "lang_pred": [langs[b] if k else "und" for b, k in zip(best, known, strict=True)],
                "score": [float(s) if k else 0.0 for s, k in zip(top, known, strict=True)]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_text(docs.select(id_col, text_col), f"doc {kind}, lang_pred string, score double", work
                    ).withColumnRenamed("doc", id_col)


def held_out(id_col: str, parts: int, part: int):
    """Whether crc32 of the id as text falls on ``part`` modulo ``parts``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       vocabulary: str | None = None) -> DataFrame:
    """Learn from the rows outside the held-out quarter, predict every row."""
    train = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col, 4, 2))
    langs, prob = fit(train, text_col, lang_col, vocabulary)
    return predict(docs, langs, prob, id_col, text_col, vocabulary).withColumn("held_out", held_out(id_col, 4, 2))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify_languages(docs).select("doc_id", "held_out", "lang_pred", "score")
