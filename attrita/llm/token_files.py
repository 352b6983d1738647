"""Operator 4: token ids as flat binary files with 64-bit offsets, memory-mapped.

Layout of a corpus folder, one pair of files per range partition, partitions in
ascending document order:

* ``kind=ids/part-NNNNN-*``: the ids of all documents back to back, each
  document closed by the end id; little-endian unsigned 16-bit where the
  vocabulary fits, else 32-bit;
* ``kind=index/part-NNNNN-*``: per document, two little-endian 64-bit integers:
  doc_id and the offset of its first id within the pair's id file.

The files are written by Spark's own text writer, so task commits, retries and
any file system come with it: each row is a run of bytes ending in a zero byte
(the end id's and the offset's high bytes are zero), and the zero is the line
separator.  A partition's base in the corpus is the prefix sum of the id files'
lengths, taken from the listing (one number per file).

Encoding: a single space before a non-space character always starts a new
pre-token (unless it stands inside a longer run of white space: such texts are
cut only between non-space characters), so texts are cut there and each
different unit is encoded by the tokenizers library once while it is
remembered; the ids equal those of the whole text.  Cutting, finding the
different units of a group of texts and putting their ids in place are array
work; only different units become Python strings.

Edge cases: a null or empty text is the end id alone; repeated doc_ids stay, in
the order of their texts' hash; ids must be integers, a null doc_id sorts first
and is stored as the least 64-bit integer (read back as null); an empty table
writes no pairs and reads back as no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from attrita.llm.common import Recent, begin, shuffle_width, text_groups
from attrita.session import scratch_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Units that a worker remembers (a generation).
CACHED_UNITS = 400_000
#: Units that the library encodes as one line.
LINE_UNITS = 200
#: Characters of the texts that are encoded together.
TOGETHER_CHARS = 4_000_000
_NO_ID = -(1 << 63)
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A space that ends the text or stands before white space (whatever Python's ``\s`` matches).
_ODD = f" (?:[{''.join(c for c in map(chr, range(0x3001)) if c.isspace())}]|$)"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def _tokenizer(file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    t.no_truncation()
    t.no_padding()
    return t


def id_type(file: str) -> str:
    return "<u2" if _tokenizer(file).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


class UnitEncoder:
    """Texts to ids; each different unit goes through the library once."""

    def __init__(self, file: str):
        self.tokenizer, self.kind = _tokenizer(file), id_type(file)
        self.known = Recent(CACHED_UNITS)
        space = self.tokenizer.pre_tokenizer.pre_tokenize_str(" a")[0][0][0] if self.tokenizer.pre_tokenizer else " "
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocab.values()) + 1, dtype=bool)  # tokens that begin with a space
        self.begins[[i for t, i in vocab.items() if t.startswith(space)]] = True

    def _one_by_one(self, texts: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(e.ids, dtype=self.kind).tobytes()

    def _fresh(self, units: list[str]) -> Iterator[bytes]:
        """Ids of " " + unit each: lines of units are encoded and cut where a
        token begins with a space, as no unit holds one.  Units that might touch
        a neighbour go alone, and all do where a token swallows a space."""
        width = np.dtype(self.kind).itemsize
        for i in range(0, len(units), 5_000):
            part = units[i:i + 5_000]
            alone = [u for u in part if u[-1].isspace()]
            held = dict(zip(alone, self._one_by_one([" " + u for u in alone]), strict=True))
            line = [u for u in part if u not in held] if alone else part
            lines = [" " + " ".join(line[j:j + LINE_UNITS]) for j in range(0, len(line), LINE_UNITS)]
            coded = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
            ids = np.concatenate([np.empty(0, self.kind), *[np.array(e.ids, dtype=self.kind) for e in coded]])
            heads = np.flatnonzero(self.begins[ids])
            if len(heads) == len(line):
                cuts, ids = (np.append(heads, len(ids)) * width).tolist(), ids.tobytes()
                found = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            else:
                found = self._one_by_one([" " + u for u in line])
            if alone:
                held.update(zip(line, found, strict=True))
                found = map(held.__getitem__, part)
            yield from found

    def pieces(self, texts: pa.Array) -> pa.Array:
        """Each text cut at single spaces, which begin the next unit and are left out."""
        pieces = pc.split_pattern(texts, " ")
        odd = np.flatnonzero(pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False))
        if len(odd):
            order = np.arange(len(texts))
            order[odd] = len(texts) + np.arange(len(odd))
            cut = pa.array([_CUT.split(texts[i].as_py()) for i in odd.tolist()], type=pieces.type)
            pieces = pa.concat_arrays([pieces, cut]).take(pa.array(order))
        return pieces

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) back to back, and the number of each text's."""
        pieces = self.pieces(texts)
        counts = pieces.value_lengths().to_numpy().astype(np.int64)
        first = np.cumsum(counts) - counts
        flat = pieces.flatten()
        coded = flat.dictionary_encode()
        codes, inner = coded.indices.to_numpy(), np.ones(len(flat), dtype=bool)
        inner[first] = False
        used = np.zeros(len(coded.dictionary), dtype=bool)
        used[codes[inner]] = True
        units = coded.dictionary.to_numpy(zero_copy_only=False)[used].tolist()
        known = self.known.hold(units, self._fresh)
        values = [known[u] for u in units]
        values.extend(self._one_by_one(flat.take(pa.array(first)).to_pylist()))
        sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // np.dtype(self.kind).itemsize
        starts = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(values), dtype=self.kind)
        at = (np.cumsum(used) - 1)[codes]       # each piece's place among the values; texts' first pieces come last
        at[first] = len(units) + np.arange(len(first))
        n = sizes[at]
        ends = np.cumsum(n)
        ids = ids[np.arange(n.sum()) + np.repeat(starts[at] - (ends - n), n)]
        return ids, np.add.reduceat(n, first) if len(first) else n


@lru_cache(maxsize=2)
def _encoder(file: str) -> UnitEncoder:
    return UnitEncoder(file)


def release() -> None:
    _encoder.cache_clear()


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                      vocabulary: str | None = None, end_id: int = END_ID) -> str:
    """Encode every text and write the corpus folder ``path``."""
    file = vocabulary or default_vocabulary()
    kind = id_type(file)
    end = np.array([end_id], dtype=kind).tobytes()
    if end[-1]:
        raise ValueError("the end id's high byte must be zero")
    ordered = (docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"),
                           F.coalesce(F.col(text_col), F.lit("")).alias("text"))
               .repartitionByRange(shuffle_width(docs.sparkSession), "doc")
               .sortWithinPartitions("doc", F.xxhash64("text"), "text"))
    schema = pa.schema([("kind", pa.string()), ("seq", pa.int64()), ("value", pa.binary())])

    def run(batches):
        begin(__name__)
        seq, offset = 0, 0
        for part, _ in text_groups(batches, chars=TOGETHER_CHARS):
            ids, lengths = _encoder(file).encode(part.column(1))
            ids = np.insert(ids, np.cumsum(lengths), end_id)
            lengths = lengths + 1
            index = np.empty((len(lengths), 2), dtype="<i8")
            index[:, 0] = part.column(0).to_numpy()
            index[:, 1] = offset + np.cumsum(lengths) - lengths
            offset += int(lengths.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(["ids", "index"]), pa.array([seq, seq + 1]),
                 pa.array([ids.tobytes()[:-1], index.tobytes()[:-1]], type=pa.binary())], schema=schema)
            seq += 2

    rows = ordered.mapInArrow(run, "kind string, seq long, value binary").sortWithinPartitions("kind", "seq")
    (rows.select("kind", F.col("value").cast("string").alias("value"))
     .write.partitionBy("kind").option("lineSep", "\0").mode("overwrite").text(path))
    return path


def token_file_pairs(spark: SparkSession, path: str, width: int) -> list[tuple[str, str, int]]:
    """(ids file, index file, base) per partition in corpus order; one row per file comes to the driver."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").schema(
        "path string, modificationTime timestamp, length long, content binary")
    files = [r for r in listing.load(path).select("path", "length").collect() if "/part-" in r.path]
    number = lambda p: int(re.search(r"/part-(\d+)", p).group(1))
    index = {number(r.path): r.path for r in files if "/kind=index/" in r.path or "/kind%3Dindex/" in r.path}
    ids = sorted((number(r.path), r.path, r.length // width) for r in files if "kind=ids" in unquote(r.path))
    out, base = [], 0
    for n, p, length in ids:
        out.append((p, index[n], base))
        base += length
    return out


def _mapped(path: str, dtype: str) -> np.ndarray:
    return np.memmap(unquote(urlparse(path).path), dtype=dtype, mode="r")


def document_digests(ids: np.ndarray, index: np.ndarray, base: int) -> pa.RecordBatch:
    """doc_id, start, n_tokens, ids_crc32 from one pair's arrays."""
    starts = index[1::2]
    ends = np.append(starts[1:], len(ids))
    docs = index[::2]
    return pa.RecordBatch.from_arrays([
        pa.array(docs, mask=docs == _NO_ID), pa.array(starts + base), pa.array(ends - starts),
        pa.array([zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)],
                 type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str, vocabulary: str | None = None) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32.  Files that are mounted are memory-mapped;
    others are read as a whole, a pair at a time, by Spark's file source."""
    kind = id_type(vocabulary or default_vocabulary())
    pairs = token_file_pairs(spark, path, np.dtype(kind).itemsize)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not pairs:
        return spark.createDataFrame([], schema)
    manifest = spark.createDataFrame(pairs, "ids string, index string, base long").repartition(
        min(len(pairs), shuffle_width(spark)))
    if urlparse(pairs[0][0]).scheme in ("", "file"):
        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    yield document_digests(_mapped(row["ids"], kind), _mapped(row["index"], "<i8"), row["base"])

        return manifest.mapInArrow(run, schema)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    both = (manifest.join(content.select(F.col("path").alias("ids"), F.col("content").alias("a")), "ids")
            .join(content.select(F.col("path").alias("index"), F.col("content").alias("b")), "index").select("a", "b", "base"))

    def run_content(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield document_digests(np.frombuffer(batch.column(0)[i].as_buffer(), dtype=kind),
                                       np.frombuffer(batch.column(1)[i].as_buffer(), dtype="<i8"),
                                       batch.column(2)[i].as_py())

    assert isinstance(both.schema["a"].dataType, BinaryType)
    return both.mapInArrow(run_content, schema)


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = write_token_files(docs, scratch_path(spark, f"tokens-{uuid.uuid4().hex}"))
    return read_token_files(spark, path)
