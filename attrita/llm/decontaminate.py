"""Operator 9: benchmark decontamination by pigeonhole edit matching.

A test item of n characters has an error budget of k = floor(rate * n) edits.
Cut into k + 1 pieces, any occurrence with at most k edits holds one piece
unchanged.  One Aho-Corasick pass over each whole text finds all exact piece
hits of all items; the stretch around a hit (merged with its neighbours of the
same item) is verified with Myers' bit-parallel distance, whose bit vectors are
Python integers of any length.

Both sides are compared in lower case with runs of white space as one space;
positions refer to that form.  Items are taken in blocks of about
``BLOCK_CHARS`` characters; a block is what a worker holds, so the benchmark may
grow: each further block is one more pass over the texts.

Edge cases: null and empty texts match nothing; a null or blank item is left
out; one under ``MIN_CHARS`` normalised characters has no error budget and
matches between word boundaries only (a script without spaces has them
everywhere); repeated rows, repeated items and null ids each give their own
rows; an empty benchmark gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from attrita.llm.common import begin, text_groups

RATE = 0.08
MIN_CHARS = 25
BLOCK_CHARS = 500_000
_UNSPACED = re.compile("[\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def cut(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of the budget + 1 pieces."""
    ends = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _inside_word(text: str, at: int) -> bool:
    """Whether the place before character ``at`` lies within a word."""
    around = text[max(0, at - 1):at + 1]
    return 0 < at < len(text) and all(map(str.isalnum, around)) and not _UNSPACED.search(around)


def _masks(pattern) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of the text, and where
    the first such stretch ends (exclusive)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best, end


class Items:
    """A block of test items with the automaton of their pieces."""

    def __init__(self, items: list[tuple], rate: float, min_chars: int):
        import ahocorasick

        self.items, self.masks, self.min_chars = [], [], min_chars
        self.pieces = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for ident, text in items:
            budget = int(rate * len(text)) if len(text) >= min_chars else 0
            for offset, piece in cut(text, budget):
                places.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((ident, text, budget))
            self.masks.append(_masks(text))
        for piece, at in places.items():
            self.pieces.add_word(piece, (len(piece), at))
        if places:
            self.pieces.make_automaton()

    def stretches(self, text: str) -> dict[int, list[list[int]]]:
        """Per item, the merged stretches of the text around its piece hits."""
        out: dict[int, list[list[int]]] = {}
        if not len(self.pieces):
            return out
        for last, (size, places) in self.pieces.iter(text):
            for i, offset in places:
                _, item, budget = self.items[i]
                start = last + 1 - size - offset
                a, b = max(0, start - budget), start + len(item) + budget
                own = out.setdefault(i, [])
                if own and own[-1][0] <= a <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], b)
                else:
                    own.append([a, b])
        return {i: _merged(x) for i, x in out.items()}

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item place, edits, start, end) of each item's best occurrence within its budget."""
        out = []
        for i, own in self.stretches(text).items():
            _, item, budget = self.items[i]
            if len(item) < self.min_chars:
                at = next((a for a in _places(item, text, own) if not (_inside_word(text, a) or _inside_word(text, a + len(item)))), None)
                if at is not None:
                    out.append((i, 0, at, at + len(item)))
                continue
            best = None
            for a, b in own:
                edits, end = myers(self.masks[i], len(item), text[a:b])
                if edits <= budget and (best is None or edits < best[0]):
                    best = (edits, a + end)
            if best:
                edits, end = best
                low = max(0, end - len(item) - budget)
                _, back = myers(_masks(item[::-1]), len(item), text[low:end][::-1])
                out.append((i, edits, end - back, end))
        return out


def _places(item: str, text: str, stretches: list[list[int]]):
    """Starts of the item's occurrences within the stretches."""
    for a, b in stretches:
        while (a := text.find(item, a, b)) >= 0:
            yield a
            a += 1


def _merged(stretches: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_built: dict[tuple[int, float, int], Items] = {}


def release() -> None:
    _built.clear()


def _items(block, rate: float, min_chars: int) -> Items:
    if (key := (block.id, rate, min_chars)) not in _built:
        _built.clear()
        _built[key] = Items(block.value, rate, min_chars)
    return _built[key]


class _Block:
    """A broadcast block of items, known by a number of its own on the workers."""

    def __init__(self, broadcast, number: int):
        self.broadcast, self.id = broadcast, number

    @property
    def value(self):
        return self.broadcast.value


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[_Block]:
    """The normalised items in blocks of bounded size, one collected at a time."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(item_col, text_col)
    total = rows.agg(F.sum(F.length(text_col))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    out = []
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64(item_col, text_col), F.lit(n)) == b).collect()
        items = sorted(((r[0], t) for r in part if (t := normalise(r[1]))), key=repr)
        if items:
            broadcast = benchmark.sparkSession.sparkContext.broadcast(items)
            out.append(_Block(broadcast, hash(repr(items))))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE,
                       min_chars: int = MIN_CHARS) -> DataFrame:
    """A row per text and item that occurs in it: ``id_col``, ``item_col``,
    edits, budget, start, end, matched (the stretch of the normalised text)."""
    schema = StructType([docs.schema[id_col], benchmark.schema[item_col],
                         *StructType.fromDDL("edits long, budget long, start long, end long, matched string").fields])
    schema = StructType([StructField(f.name, f.dataType, True) for f in schema])
    arrow = to_arrow_schema(schema)
    found = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(benchmark, item_col, item_text_col):

        def run(batches, block=block):
            begin(__name__)
            items = _items(block, rate, min_chars)
            for part, texts in text_groups(batches):
                rows = []
                for at, text in enumerate(texts):
                    text = normalise(text)
                    for i, edits, start, end in items.matches(text) if text else ():
                        ident, _, budget = items.items[i]
                        rows.append((part.column(0)[at].as_py(), ident, edits, budget, start, end, text[start:end]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(
                        zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        found = found.union(docs.select(id_col, text_col).mapInArrow(run, schema))
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", rate: float = RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows whose text holds no test item, all columns as they are."""
    names = [text_col, *[c for c in docs.columns if c != text_col]]
    kept = docs.select(*names)
    for block in item_blocks(benchmark, item_col, item_text_col):

        def run(batches, block=block):
            begin(__name__)
            items = _items(block, rate, min_chars)
            for part, texts in text_groups(batches, 0):
                yield part.filter(pa.array([not (n := normalise(t)) or not items.matches(n) for t in texts], type=pa.bool_()))

        kept = kept.mapInArrow(run, kept.schema)
    return kept.select(*docs.columns)


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_contamination(docs, bench).select("doc_id", "item_id", "edits", "budget", "start", "end")
