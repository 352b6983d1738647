"""Operator 5: secret scan with corpus-wide ownership frequency.

Every whole text is searched for candidates: assignments, access keys and hex
runs (the base kinds), and other key-like strings.  The hashes of all
candidates are counted over the corpus by distinct repositories and distinct
owners.  A string that many owners hold, or that stands in many repositories for
each of its owners, is a copied example; one that a single owner holds in fewer
and that looks random is taken for a live credential.

``kind`` of a span: assign, access, hex (base kinds, always reported) and live
(a key-like string outside the base spans, reported only when its counts say
owner-specific).  ``verdict`` of a finding: example (``EXAMPLE_OWNERS`` owners or
more, or ``EXAMPLE_REPOSITORIES`` repositories an owner), live (one owner,
random-looking), or plain.

Spans are code points, end exclusive, of the whole match; base matches are
leftmost and non-overlapping per kind, too short ones are dropped.

The counts are two distinct counts with partial aggregation, so a string that a
third of all rows holds costs a row per task; texts are not shuffled.

Edge cases: a null text counts as empty; no candidates give zero counts, the
digest of the empty string and empty spans; a null owner counts as one owner of
its own, a null repository is not counted; repeated rows stay, each with its own
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrita.llm.common import begin, free_name, text_groups, written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, as the pattern is greedy and leftmost
KEY_LIKE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
KINDS = ("assign", "access", "hex", "live")
VALUE_CHARS, ACCESS_CHARS = 6, 20
#: Owners from which on a string counts as a widely copied example.
EXAMPLE_OWNERS = 3
#: Distinct repositories for each owner from which on it does too, even with few owners.
EXAMPLE_REPOSITORIES = 100
#: Bits a character below which a key-like string counts as plain text.
LIVE_ENTROPY = 3.5


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_random(value: str) -> bool:
    """Digits and letters mixed, and enough different characters."""
    return any(map(str.isdigit, value)) and any(map(str.isalpha, value)) and entropy(value) >= LIVE_ENTROPY


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind index, end, secret value) of the base kinds, by start, then kind."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= VALUE_CHARS]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def key_like_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Random-looking strings that meet no base span."""
    taken = [(s, e) for s, _, e, _ in base]
    return [(m.start(), 3, m.end(), m[0]) for m in KEY_LIKE.finditer(text)
            if looks_random(m[0]) and not any(s < m.end() and m.start() < e for s, e in taken)]


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def candidates(docs: DataFrame, id_col: str, text_col: str, repository_col: str, owner_col: str) -> DataFrame:
    """A row per row: doc, base digest columns, found (its candidates)."""
    kind = docs.schema[id_col].dataType.simpleString()
    struct = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.string()),
                        ("random", pa.bool_())])
    schema = (f"doc {kind}, repository string, owner string, text_hash long, n_assign long, n_access long, n_hex long, "
              "base_sha256 string, found array<struct<start:bigint,kind:int,end:bigint,hash:string,random:boolean>>")

    def work(part, texts):
        base = [base_spans(t) if t else [] for t in texts]
        found = [[{"start": s, "kind": k, "end": e, "hash": hashlib.blake2b(v.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest(),
                   "random": looks_random(v)} for s, k, e, v in b + key_like_spans(t, b)] if t else [] for t, b in zip(texts, base, strict=True)]
        count = lambda k: [sum(x[1] == k for x in b) for b in base]
        return {"doc": part.column(0), "repository": part.column(2), "owner": part.column(3), "text_hash": part.column(4),
                "n_assign": count(0), "n_access": count(1), "n_hex": count(2),
                "base_sha256": [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base],
                "found": pa.array(found, type=pa.list_(struct))}

    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.col(repository_col).cast("string").alias("repository"),
                       F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
                       F.xxhash64(text_col).alias("text_hash"))
    return _map_nested(rows, schema, work)


def _map_nested(rows: DataFrame, schema: str, work) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        begin(__name__)
        for part, texts in text_groups(batches):
            out = work(part, texts)
            yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x := out[f.name], pa.Array) else pa.array(x, type=f.type)
                                              for f in arrow], schema=arrow)

    return rows.mapInArrow(run, schema)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id",
                 owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS,
                 example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """``id_col``, text_hash (xxhash64 of the text), n_assign, n_access, n_hex,
    base_sha256, spans (all, as kind:start:end) and findings: per span kind,
    start, end, hash of the secret, n_repositories, n_owners, verdict."""
    table = written(candidates(docs, id_col, text_col, repository_col, owner_col)
                    .withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = table.select("row", "repository", "owner", F.explode("found").alias("f")).select("row", "repository", "owner", "f.*")
    frequency = each.groupBy("hash").agg(F.count_distinct("repository").alias("n_repositories"),
                                         F.count_distinct("owner").alias("n_owners"))
    copied = (F.col("n_owners") >= example_owners) | (F.col("n_repositories") >= example_repositories * F.col("n_owners"))
    verdict = (F.when(copied, "example")
               .when((F.col("n_owners") == 1) & F.col("random"), "live").otherwise("plain"))
    judged = each.drop("repository", "owner").join(frequency, "hash").withColumn("verdict", verdict)
    shown = judged.where((F.col("kind") < 3) | (F.col("verdict") == "live"))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    lists = shown.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        "start", F.col("kind").alias("order"), "end", name.alias("kind"), "hash", "n_repositories", "n_owners", "verdict"))).alias("findings"))
    return table.join(lists, "row", "left").select(
        F.col("doc").alias(id_col), "text_hash", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ","),
                   F.lit("")).alias("spans"), "findings")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id",
           owner_col: str = "source", mark: str = "[SECRET]", chars_col: str | None = None) -> DataFrame:
    """The same rows and columns, with each span that is not a widely copied
    example replaced by ``mark`` (overlapping spans by one); ``chars_col``, if
    given, gets the new length of the texts that change."""
    found = scan_secrets(docs, id_col, text_col, repository_col, owner_col)
    own_id, own_hash, where = (free_name(c, docs.columns) for c in ("_id", "_hash", "_spans"))
    spans = (found.where("findings is not null")
             .select(F.col(id_col).alias(own_id), F.col("text_hash").alias(own_hash),
                     F.filter("findings", lambda f: f["verdict"] != "example").alias("f"))
             .where(F.size("f") > 0).groupBy(own_id, own_hash)
             .agg(F.first(F.transform("f", lambda f: F.struct(f["start"].alias("s"), f["end"].alias("e")))).alias(where)))
    rows = docs.join(spans, docs[id_col].eqNullSafe(spans[own_id]) & (F.xxhash64(docs[text_col]) == spans[own_hash]), "left")

    def cut(batches):
        for batch in batches:
            texts, spans = batch.column(0), batch.column(1)
            out = []
            for i in range(batch.num_rows):
                text, where = texts[i].as_py(), spans[i].as_py()
                for s, e in merged(where or []):
                    text = text[:s] + mark + text[e:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.string()), *[batch.column(i) for i in range(2, batch.num_columns)]],
                                             names=batch.schema.names[:1] + batch.schema.names[2:])

    names = [c for c in docs.columns if c != text_col]
    fields = {f.name: f for f in docs.schema.fields}
    from pyspark.sql.types import StructType

    changed = rows.where(F.col(where).isNotNull()).select(text_col, where, *names).mapInArrow(
        cut, StructType([fields[text_col], *[fields[c] for c in names]]))
    if chars_col:
        changed = changed.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    kept = rows.where(F.col(where).isNull())
    return kept.select(*docs.columns).unionByName(changed.select(*docs.columns))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Overlapping spans joined, from the last to the first."""
    out: list[list[int]] = []
    for x in sorted((s["s"], s["e"]) for s in spans):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append(list(x))
    return [(s, e) for s, e in reversed(out)]


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
