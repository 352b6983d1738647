"""Operator 8: BPE encoding as a bounded-lookahead streaming transducer, and decoding by a state machine.

Encoding.  Under a merge list, every prefix of a symbol stream has one BPE
segmentation, and a token sequence is that segmentation exactly if each two
neighbours keep apart when merged as a pair.  So each position has one last
token and one position before it: the segmentations of all prefixes form a
tree.  A token longer than the list's longest can't start further back than
that, so whatever comes later continues from one of the last ``longest``
positions; the tokens up to the nearest common ancestor of those positions are
stable and are emitted at once.  Only positions after it are held.

``sufficient_lookahead`` is the bound that the merge list itself gives (a chain
of merges that undo one another uses each rule once, and a rule spans at most
the longest token): the transducer never holds more than this plus one token.
In practice a token is emitted within a few symbols.

Decoding feeds the tokens' bytes to a UTF-8 state machine, which gives out text
as soon as a character is complete and replaces ill-formed sequences.

Normalisation and the split into pre-tokens follow the tokenizer file, by the
library's own components, on each different white-space unit once (neither
crosses a space or a line end); special tokens in a text are found first, as
the library does.

Edge cases: a null or empty text has no tokens (digests of the empty string);
very long unbroken texts stream through; repeated rows stay; extra columns are
ignored; null ids stay null.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attrita.llm.common import Recent, begin, map_text

VOCABULARY = "word_bpe_49k.json"
#: Units, words and token pairs that a worker remembers (a generation).
CACHED_UNITS, CACHED_WORDS = 400_000, 300_000
CACHED_PAIRS = 500_000
#: Ids decoded at once.
DECODED = 1 << 16


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_symbols() -> dict[int, str]:
    """The byte alphabet of byte-level BPE: printable bytes as themselves, the others from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {b: chr(b) for b in shown}
    return out | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)}


class MergeList:
    """Vocabulary and merges of a BPE model, and which tokens may stand side by side."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {(a, b): i for i, (a, b) in enumerate(m if isinstance(m, list | tuple) else m.split(" ") for m in merges)}
        self.spelling = {t: self._symbols(t) for t in vocab}
        self.tokens = {"".join(s): t for t, s in self.spelling.items()}
        self.endings = {"".join(s[i:]) for s in self.spelling.values() for i in range(len(s))}
        self.longest = max((len(s) for s in self.spelling.values()), default=1)
        self.sufficient_lookahead = max(1, len(self.rank)) * self.longest
        self._whole: dict[str, bool] = {}
        self._apart: dict[tuple[str, str], bool] = {}

    def _symbols(self, token: str) -> tuple[str, ...]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return (*body[:-1], body[-1] + self.suffix)
        return tuple(token)

    def merge(self, symbols: Iterable[str]) -> list[str]:
        """Plain BPE: the lowest-ranked pair first, leftmost among equals."""
        parts = list(symbols)
        while len(parts) > 1:
            best = min(((r, i) for i, p in enumerate(zip(parts[:-1], parts[1:], strict=True))
                        if (r := self.rank.get(p)) is not None), default=None)
            if best is None:
                break
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def whole(self, token: str) -> bool:
        """Whether the token's own symbols merge into it."""
        if (w := self._whole.get(token)) is None:
            w = self._whole[token] = self.merge(self.spelling[token]) == [token]
        return w

    def apart(self, a: str, b: str) -> bool:
        """Whether the two tokens' symbols, merged together, give the two tokens again."""
        if (w := self._apart.get((a, b))) is None:
            if len(self._apart) > CACHED_PAIRS:
                self._apart.clear()
            w = self._apart[(a, b)] = self.merge(self.spelling[a] + self.spelling[b]) == [a, b]
        return w

    def step(self, symbols: list[str], last: list[tuple[str | None, int]]) -> tuple[str | None, int]:
        """Last token, and where it starts, of the segmentation that ends with
        the last symbol; last: the same of all positions before, (None, -1) at a
        start.  One token alone keeps apart from what stands before it."""
        endings, tokens, apart = self.endings, self.tokens, self._apart
        spelled, start, ends = "", len(symbols), []
        for symbol in reversed(symbols):
            start -= 1
            spelled = symbol + spelled
            if spelled not in endings:
                break
            if (token := tokens.get(spelled)) is not None:
                ends.append((token, start))
        for token, start in reversed(ends):  # one of them at most fits; the longest does most often
            before, at = last[start]
            if at == -2:
                continue
            if (fits := self.whole(token) if before is None else apart.get((before, token))) is None:
                fits = self.apart(before, token)
            if fits:
                return token, start
        return None, -2  # a symbol that the vocabulary lacks


class Transducer:
    """Symbols in, stable tokens out."""

    def __init__(self, merges: MergeList):
        self.m = merges
        self.base = 0  # position up to which tokens are out
        self.symbols: list[str] = []  # from base on
        self.last: list[tuple[str | None, int]] = [(None, -1)]  # per position from base on: last token, where it starts
        self.held = 0

    def push(self, symbol: str) -> list[str]:
        """Take one symbol; the tokens that became stable."""
        self.symbols.append(symbol)
        n = len(self.symbols)
        self.last.append(self.m.step(self.symbols, self.last))
        self.held = max(self.held, n)
        return self._stable() if n >= 2 * self.m.longest and n % 16 == 0 else []

    def _stable(self) -> list[str]:
        n = len(self.symbols)
        live = {i for i in range(max(0, n - self.m.longest + 1), n + 1) if self.last[i][1] != -2}
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(self.last[top][1])
        return self._emit(live.pop()) if live else []

    def _emit(self, end: int) -> list[str]:
        out, at = [], end
        while at > 0:
            token, at = self.last[at]
            out.append(token)
        if end:
            first = self.last[end][0]
            self.symbols = self.symbols[end:]
            self.last = [(first, -1)] + [(t, s - end if s >= 0 else s) for t, s in self.last[end + 1:]]
            self.base += end
        return out[::-1]

    def finish(self) -> list[str]:
        return self._emit(len(self.symbols))

    def short(self, symbols: list[str]) -> list[str]:
        """All tokens of a whole stream that ends before any could be emitted early."""
        step = self.m.step
        for symbol in symbols:
            self.symbols.append(symbol)
            self.last.append(step(self.symbols, self.last))
        self.held = max(self.held, len(symbols))
        out, at = [], len(symbols)
        while at > 0:
            token, at = self.last[at]
            out.append(token)
        return out[::-1]


class SpacedDecoder:
    """Ids in, UTF-8 text out as the library decodes a file without a decoder:
    tokens joined by spaces, added tokens too.  Its state is whether a token is
    out already; the bytes of many ids are gathered at once from one table."""

    def __init__(self, names: dict[int, str]):
        spelled = [(" " + names.get(i, "")).encode("utf-8", "surrogatepass") for i in range(max(names, default=-1) + 1)]
        self.flat = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.sizes = np.array([len(t) for t in spelled], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def feed(self, ids: np.ndarray, begun: bool) -> bytes:
        """The next part of the text; ``begun``: whether ids were fed before."""
        sizes = self.sizes[ids]
        before = np.cumsum(sizes) - sizes
        out = self.flat[np.repeat(self.starts[ids] - before, sizes) + np.arange(int(sizes.sum()))].tobytes()
        return out if begun else out[1:]


class StreamingBpe:
    """A tokenizer file's encoding and decoding."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        probe = [w for w, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str("Ab.,"))] if self.normalizer else []
        self.plain = probe == ["ab", ".,"]  # letters are lower-cased, a run of marks is one pre-token
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges = MergeList(model["vocab"], model["merges"], self.suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("|".join(f"({re.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.spaced = SpacedDecoder(self.names)
        self.bytes = {c: b for b, c in byte_symbols().items()}
        self.known, self.known_words = Recent(CACHED_UNITS), Recent(CACHED_WORDS)

    def words(self, text: str) -> Iterator[str]:
        """Pre-tokens of a text without special tokens, in the byte alphabet."""
        if self.plain and text.isascii() and (body := text.rstrip(".,")).isalpha():
            yield body.lower()
            if len(body) < len(text):
                yield text[len(body):]
            return
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        for word, _ in self.pre_tokenizer.pre_tokenize_str(text):
            yield word

    def encode_word(self, word: str) -> Iterator[int]:
        vocab, end = self.merges.vocab, len(word) - 1
        stream = Transducer(self.merges)
        if end < 2 * self.merges.longest:
            for token in stream.short([*word[:-1], word[-1:] + self.suffix]):
                yield vocab[token]
            return
        for i, c in enumerate(word):
            for token in stream.push(c + self.suffix if i == end else c):
                yield vocab[token]
        for token in stream.finish():
            yield vocab[token]

    def encode(self, text: str) -> Iterator[int]:
        """Ids of a text, one by one."""
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                yield self.special[part]
            elif part:
                for word in self.words(part):
                    yield from self.encode_word(word)

    def token_text(self, ids: Iterable[int]) -> str:
        """The library's decode(ids, skip_special_tokens=False) of a file without a decoder: tokens joined by spaces."""
        return " ".join(self.names[i] for i in ids)

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Readable text, piece by piece: bytes run through a UTF-8 state machine, word ends become spaces."""
        machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        for i in ids:
            token = self.names[i]
            if token in self.special:
                yield machine.decode(b"", final=True) + token
                machine.reset()
                continue
            ends = self.suffix and token.endswith(self.suffix) and token != self.suffix
            body = token[: -len(self.suffix)] if ends else token
            yield machine.decode(b"".join(bytes([self.bytes[c]]) for c in body)) + (" " if ends else "")
        yield machine.decode(b"", final=True)

    @staticmethod
    def _joined(parts: list[tuple[bytes, str]]) -> tuple[bytes, str]:
        data, ids = zip(*parts, strict=True) if parts else ((), ())
        return b"".join(data), " ".join(filter(None, ids))

    def _record(self, ids: list[int]) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, decimal ids."""
        return array("i", ids).tobytes(), " ".join(map(str, ids))

    def _units(self, units: list[str]) -> Iterator[tuple[bytes, str]]:
        """The records of white-space units."""
        special = {u for u in units if self.cut.search(u)} if self.cut else set()
        split = [[] if u in special else list(self.words(u)) for u in units]
        held = self.known_words.hold({w for words in split for w in words},
                                     lambda fresh: (self._record(list(self.encode_word(w))) for w in fresh))
        for unit, words in zip(units, split, strict=True):
            if unit in special:
                yield self._record(list(self.encode(unit)))
            else:
                yield held[words[0]] if len(words) == 1 else self._joined([held[w] for w in words])

    def coded(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Per text: its ids as 32-bit integers and the decimal ids, each unit
        worked out once while it is remembered."""
        cut = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        held = self.known.hold(set().union(*cut), self._units)
        return [self._joined([held[u] for u in units]) for units in cut]

    def digests(self, texts: list[str | None]) -> list[tuple[bytes, int, str, str]]:
        """Per text: ids as 32-bit integers, n_tokens, sha256 of the decimal ids, sha256 of the token text."""
        return [(data, len(data) // 4, hashlib.sha256(ids.encode()).hexdigest(), self.decoded_sha256(data))
                for data, ids in self.coded(texts)]

    def decoded_sha256(self, data: bytes) -> str:
        """Digest of the decoded text of ids as 32-bit integers, decoded ``DECODED`` ids at a time."""
        digest, ids = hashlib.sha256(), np.frombuffer(data, dtype="<i4")
        for at in range(0, len(ids), DECODED):
            digest.update(self.spaced.feed(ids[at:at + DECODED], at > 0))
        return digest.hexdigest()


@lru_cache(maxsize=2)
def tokenizer(file: str) -> StreamingBpe:
    return StreamingBpe(file)


def release() -> None:
    tokenizer.cache_clear()


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     vocabulary: str | None = None) -> DataFrame:
    """``id_col``, ids array, n_tokens, ids_sha256, decoded_sha256 of every whole
    text (digests of the decimal ids and of the library's decoded text)."""
    file = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()

    def work(part, texts):
        data, n, ids, spelled = zip(*tokenizer(file).digests(texts), strict=True)
        offsets = np.concatenate(([0], np.cumsum(n)))
        flat = pa.array(np.frombuffer(b"".join(data), dtype="<i4"))
        return {"doc": part.column(0), "ids": pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), flat),
                "n_tokens": n, "ids_sha256": ids, "decoded_sha256": spelled}

    return map_text(docs.select(id_col, text_col), f"doc {kind}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string",
                    work).withColumnRenamed("doc", id_col)


def decode_documents(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids",
                     vocabulary: str | None = None) -> DataFrame:
    """``id_col``, text: readable text of each id array (null: empty)."""
    file = vocabulary or default_vocabulary()

    def run(batches):
        begin(__name__)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                ["".join(tokenizer(file).decode(x or [])) for x in batch.column(1).to_pylist()], type=pa.string())],
                names=[id_col, "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  vocabulary: str | None = None) -> DataFrame:
    """``id_col``, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    file = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()

    def work(part, texts):
        _, n, ids, spelled = zip(*tokenizer(file).digests(texts), strict=True)
        return {"doc": part.column(0), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": spelled}

    return map_text(docs.select(id_col, text_col), f"doc {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string",
                    work).withColumnRenamed("doc", id_col)


def query(spark, sf_dir):
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
