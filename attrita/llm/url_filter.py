"""Operator 6: URL filter by a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And automaton.  A pattern
with m symbols takes m + 1 bits (bit j: its first j symbols have matched); one
step for all patterns is

    state = ((state << 1) & symbol_mask[c]) | (state & loop_mask[c])

with the shift carried from word to word.  The canonical URL is the host (A-Z
lower-cased), a zero byte, and the path.  In a glob ``*`` stands for any run
that stays within the host or the path, ``?`` for one such byte; patterns are
matched from end to end.  URLs take the same step together, as many at once as
``STATE_BYTES`` of state hold: memory follows from that and the rules alone.

A rule (action, host, path) fits its host, all subdomains, and every path that
starts with the rule's; the longest rule wins (block before allow on a tie).
Where no rule fits, the ``globs`` decide: block if any matches, else allow.

Edge cases: a null url, or one without ``://``, has an empty host and path and
is judged as such; a zero byte in a url stands as byte 1 in the automaton; very
long urls take a step a byte; repeated rows and null ids stay; extra columns
are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from attrita.llm.common import map_text

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: (host glob, path glob) that block where no rule fits.
GLOBS = (("ads.*", "*"), ("*.ads.*", "*"), ("ads-*", "*"), ("*.ads-*", "*"), ("*", "*/ads/*"), ("*", "*.exe"), ("*", "*.zip"))
#: State that is held at once: URLs times words of eight bytes.
STATE_BYTES = 16_000_000
#: Rules that a rule table may hold; a worker keeps them all as bit masks.
MAX_RULES = 20_000
_REST = re.compile(r"([^/?#]*)([^?#]*)", re.DOTALL)
U = np.uint64


def host_and_path(url: str | None) -> tuple[str, str]:
    if not url or (at := url.find("://")) < 0:
        return "", ""
    host, path = _REST.match(url, at + 3).groups()
    return host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), path


class GlobAutomaton:
    """Many (host glob, path glob) patterns, simulated at once."""

    def __init__(self, globs: list[tuple[str, str]]):
        symbols: list[list[int | None]] = []  # per pattern; None: any byte but zero
        loops: list[set[int]] = []
        for host, path in globs:
            own, stars = [], set()
            for c in host.encode() + b"\0" + path.encode():
                if c == ord("*"):
                    stars.add(len(own))
                else:
                    own.append(None if c == ord("?") else c)
            symbols.append(own)
            loops.append(stars)
        firsts = np.cumsum([0, *[len(s) + 1 for s in symbols]])
        self.finals = firsts[1:] - 1
        self.words = max(1, -(-int(firsts[-1]) // 64))
        step = np.zeros((256, self.words * 64), dtype=bool)
        loop = np.zeros((256, self.words * 64), dtype=bool)
        start = np.zeros(self.words * 64, dtype=bool)
        for first, own, stars in zip(firsts, symbols, loops, strict=False):
            start[first] = True
            for j, c in enumerate(own, 1):
                step[slice(1, None) if c is None else c, first + j] = True
            for j in stars:
                loop[1:, first + j] = True
        pack = lambda bits: np.packbits(bits, axis=-1, bitorder="little").view("<u8").astype(U)
        self.step, self.loop, self.start = pack(step), pack(loop), pack(start)

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """(text, pattern) booleans."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order], dtype=np.int64)
        data = np.frombuffer(b"".join(texts[i] for i in order), dtype=np.uint8)
        starts = np.cumsum(lengths) - lengths
        state = np.tile(self.start, (len(texts), 1))
        for j in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(-lengths, -(j + 1), side="right"))
            c, s = data[starts[:n] + j], state[:n]
            moved = s << U(1)
            moved[:, 1:] |= s[:, :-1] >> U(63)
            state[:n] = (moved & self.step[c]) | (s & self.loop[c])
        out = np.empty((len(texts), len(self.finals)), dtype=bool)
        out[order] = (state[:, self.finals // 64] >> (self.finals % 64).astype(U)) & U(1) != 0
        return out


@lru_cache(maxsize=4)
def _compiled(rules: tuple, globs: tuple) -> tuple[GlobAutomaton, list]:
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    own = [(h, p + "*") for _, h, p in ranked] + [("*." + h, p + "*") for _, h, p in ranked]
    return GlobAutomaton(own + list(globs)), ranked


def judge(urls: list[str | None], rules: tuple = RULES, globs: tuple = GLOBS) -> dict[str, list]:
    """host, path, rule, verdict of each url."""
    automaton, ranked = _compiled(rules, globs)
    parts = [host_and_path(u) for u in urls]
    n, first, other = len(ranked), np.full(len(urls), -1), np.zeros(len(urls), dtype=bool)
    some = max(1, STATE_BYTES // (8 * automaton.words))
    for at in range(0, len(urls), some):
        hit = automaton.matches([h.encode("utf-8", "surrogatepass").replace(b"\0", b"\1") + b"\0"
                                 + p.encode("utf-8", "surrogatepass").replace(b"\0", b"\1") for h, p in parts[at:at + some]])
        fits, other[at:at + some] = hit[:, :n] | hit[:, n:2 * n], hit[:, 2 * n:].any(axis=1)
        if n:
            first[at:at + some] = np.where(fits.any(axis=1), fits.argmax(axis=1), -1)
    return {"host": [h for h, _ in parts], "path": [p for _, p in parts],
            "rule": [ranked[i][1] + ranked[i][2] if i >= 0 else None for i in first],
            "verdict": [ranked[i][0] if i >= 0 else "block" if o else "allow" for i, o in zip(first, other, strict=True)]}


def rule_tables(rules: DataFrame | None, globs: DataFrame | None) -> tuple[tuple, tuple]:
    """Rules (action, host, path) and globs (host, path) from tables of at most ``MAX_RULES`` rows each, in an order of
    their own; null and unknown actions are an error, repeated rows one rule."""
    def rows(table: DataFrame | None, columns: tuple[str, ...]) -> tuple:
        if table is None:
            return ()
        found = table.select(*columns).distinct().limit(MAX_RULES + 1).collect()
        if len(found) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        return tuple(sorted(tuple("" if x is None else x for x in r) for r in found))

    own = rows(rules, ("action", "host", "path"))
    if any(a not in ("block", "allow") for a, _, _ in own):
        raise ValueError("an action is block or allow")
    return own, rows(globs, ("host", "path"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES,
                globs: tuple = GLOBS) -> DataFrame:
    """``id_col``, host, path, rule, verdict: one row per row."""
    kind = pages.schema[id_col].dataType.simpleString()
    return map_text(pages.select(id_col, url_col), f"page {kind}, host string, path string, rule string, verdict string",
                    lambda part, urls: {"page": part.column(0), **judge(urls, rules, globs)}).withColumnRenamed("page", id_col)


def query(spark, sf_dir):
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN host LIKE 'ads.%' OR host LIKE '%.ads.%' OR host LIKE 'ads-%' OR host LIKE '%.ads-%'
    OR path LIKE '%/ads/%' OR path LIKE '%.exe' OR path LIKE '%.zip' THEN 'block' ELSE 'allow' END AS verdict
FROM m
"""
