"""Fingerprints, source divergence and periodic runs against plain versions, with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing column names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

CLASH = "part string, place string, other string, n long, term string, kept long, words long, runs string"


def frame(spark, rows, schema="doc_id long, text string, lang string, source string"):
    extra = ("x", "y", "z", 1, "t", 2, 3, "r")
    return spark.createDataFrame([(*r, *extra) for r in rows], f"{schema}, {CLASH}")


def prose(r, n, vocab=400):
    return " ".join(f"{chr(97 + r.randrange(26))}{r.randrange(vocab)}" for _ in range(n))


# --- fingerprints


def plain_fingerprint(text):
    """Byte by byte, from the definition."""
    data = (text or "").encode()
    if not data:
        return "2::"
    hashes = []
    for i in range(len(data)):
        h = 0
        for j in range(i - 6, i + 1):
            h = (h * 0x01000193 + (data[j] + 1 if j >= 0 else 0)) & 0xFFFFFFFF
        h = h * 0x9E3779B1 & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x85EBCA77 & 0xFFFFFFFF
        hashes.append(h ^ h >> 13)

    def chunks(k):
        out, total = [], 0
        for i, h in enumerate(hashes):
            total += h
            if h % 2 ** k == 0 or i == len(hashes) - 1:
                out.append(total)
                total = 0
        return out

    def symbol(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2 ** 64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2 ** 64
        x = (x ^ x >> 31) >> 52
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
        return letters[x >> 6] + letters[x & 63]

    k = next(k for k in range(1, 40) if len(chunks(k)) <= 64)
    return f"{2 ** k}:{''.join(map(symbol, chunks(k)))}:{''.join(map(symbol, chunks(k + 1)))}"


def plain_likeness(f, g):
    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        return 2 * row[-1] / (len(a) + len(b))

    if f == g:
        return 1.0
    cut = [{int(b) << k: [s[i:i + 2] for i in range(0, len(s), 2)] for k, s in enumerate(p)} for b, *p in (f.split(":"), g.split(":"))]
    return max((table(cut[0][k], cut[1][k]) for k in set(cut[0]) & set(cut[1]) if cut[0][k] or cut[1][k]), default=0.0)


def test_fingerprint_follows_its_definition():
    from attrita.llm import piecewise_hash as op

    r = random.Random(2)
    texts = [None, "", "a", "ab" * 400, "é\U0001f600" * 90, "\0" * 300, *(prose(r, n) for n in (1, 3, 30, 300, 900))]
    for t in texts:
        assert op.fingerprint(t) == plain_fingerprint(t)
        assert op.fingerprint(t, piece=37) == op.fingerprint(t)  # pieces change nothing
    for _ in range(300):
        a = [r.choice("abcd") for _ in range(r.randrange(20))]
        b = [r.choice("abcd") for _ in range(r.randrange(20))]
        f, g = (f"4:{''.join(x + x for x in s)}:{''.join(x + x for x in s[::2])}" for s in (a, b))
        assert op.likeness(f, g) == pytest.approx(plain_likeness(f, g)) == pytest.approx(op.likeness(g, f))
    assert op.likeness("4:aabb:aa", "16:aabb:aa") == 0.0 and op.likeness("4:zzzz:aabb", "8:aabb:yy") == 1.0
    assert op.likeness("2::", "2::") == 1.0 and op.likeness("2::", "2:aa:aa") == 0.0


def test_an_edit_keeps_the_other_chunks():
    from attrita.llm import piecewise_hash as op

    r = random.Random(4)
    for _ in range(20):
        text = prose(r, 2000)
        at = r.randrange(len(text))
        assert op.likeness(op.fingerprint(text), op.fingerprint(text[:at] + "XX" + text[at:])) > 0.9
        assert op.likeness(op.fingerprint(text), op.fingerprint(prose(r, 2000))) < 0.15
        assert 0.3 < op.likeness(op.fingerprint(text), op.fingerprint(op.edited(text, prose(r, 2000)))) < 0.75


def test_against_next(spark, monkeypatch):
    from attrita.llm import piecewise_hash as op

    monkeypatch.setattr(op, "ROWS", 3)
    r = random.Random(6)
    texts = [None, "", "x", prose(r, 3000), "É" * 50, *(prose(r, r.randrange(1, 80)) for _ in range(40))]
    rows = [(i * 3, t, "en", "s") for i, t in enumerate(texts)] + [(9, texts[3], "en", "s"), (9, "other", "en", "s"), (None, "null id", "en", "s")]
    got = op.against_next(frame(spark, rows))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = sorted((tuple(x) for x in got.collect()), key=repr)
    # rows of one id may stand in any order among themselves: by the order the operator documents
    hashed = {(x.doc_id, x.text): x.h for x in spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
              .selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()}
    order = sorted(((i, t or "") for i, t, _, _ in rows), key=lambda x: (x[0] is None, -(x[0] or 0), hashed[x], x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        changed = t[:len(t) - half] + after[:half]
        f, g, e = (plain_fingerprint(x) for x in (t, after, changed))
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), f, e, plain_likeness(f, e), plain_likeness(f, g)))
    for a, b in zip(got, sorted(want, key=repr), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])
    alone = op.against_next(frame(spark, [(7, "one text", "en", "s")])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert op.against_next(frame(spark, [])).count() == 0
    assert [x.fingerprint for x in op.fingerprints(frame(spark, rows[:5])).orderBy("doc_id").collect()] == [plain_fingerprint(t) for t in texts[:5]]


# --- source divergence


def plain_divergence(rows, least=10, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang].add(source)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= least]
        v = len(kept)

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            words = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(words)[:top])):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def divergence_rows():
    r = random.Random(8)
    rows = []
    for i in range(260):
        lang = r.choice(["en", "en", "en", "de", None])
        source = r.choice(["hot"] * 4 + ["a", "b", "c", "É", None, "d" * (1 + i % 9)])
        words = [r.choice(["the", "THE", "Ünder", "straße", "zebra", "x1y", "don't", f"w{r.randrange(30)}", f"{lang}{source}"])
                 for _ in range(int(r.paretovariate(1)) % 400)]
        rows.append((i, " ".join(words), lang, source))
    rows += [(900, None, "en", "silent"), (901, "", "xx", "only"), (902, "1 2 3", "yy", "p"), (903, "few", "yy", "q"), *rows[:20]]
    return rows + [(950, "the " * 20000, "en", "long")]


@pytest.mark.parametrize("block, chunk, held", [(200_000, 64, 300_000), (40, 2, 5)])
def test_source_divergence(spark, monkeypatch, block, chunk, held):
    from attrita.llm import source_divergence as op

    monkeypatch.setattr(op, "BLOCK_ROWS", block)
    monkeypatch.setattr(op, "CHUNK", chunk)
    monkeypatch.setattr(op, "HELD", held)
    rows = divergence_rows()
    got = op.source_divergence(frame(spark, rows))
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(tuple(x) for x in got.collect()) == plain_divergence(rows)
    assert op.source_divergence(frame(spark, [])).count() == 0


def test_source_divergence_sql(spark):
    from attrita.llm import source_divergence as op

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    want = sorted(con.sql(op.ORACLE_SQL).fetchall())
    got = op.query(spark, "/root/testdata/sf0.001").collect()
    assert sorted((x.lang, x.source, x.part, x.item, x.value, x["rank"]) for x in got) == want


def test_shares_do_not_overflow():
    from attrita.llm import source_divergence as op

    counts = np.array([0, 5, 10 ** 12], dtype=np.int64)
    assert op.shares(counts, 10 ** 12 + 5, 3).tolist() == [1 + 10 ** 9 * (int(c) + 2) // (10 ** 12 + 11) for c in counts]


# --- periodic runs


def plain_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((i, length, q) for (i, length), q in found.items())


def repetitive(r, deep=2):
    kind, n, v = r.randrange(7 if deep else 5), r.randrange(0, 90), r.choice([1, 2, 2, 3, 4, 30])
    w = [r.randrange(v) for _ in range(n)]
    if kind == 1 and n:
        p = r.randrange(1, n + 1)
        w = [w[i % p] for i in range(n)]
    elif kind == 3:  # stretches of one period in several phases
        u = [r.randrange(2) for _ in range(r.randrange(1, 6))]
        w = [u[(o + i) % len(u)] for o in range(r.randrange(1, 6)) for i in range(r.randrange(40))]
    elif kind == 4:  # Fibonacci words: most runs for their length
        w, after = [0], [0, 1]
        for _ in range(r.randrange(3, 10)):
            w, after = after, after + w
    elif kind >= 5:
        u = repetitive(r, deep - 1)[:40]
        w = [r.randrange(3) for _ in range(r.randrange(9))] + u * r.randrange(1, 6) + u[:r.randrange(len(u) + 1)]
    return w[:220]


def test_runs_equal_brute_force():
    from attrita.llm import periodic_runs as op

    r, some = random.Random(5), 0
    for _ in range(250):
        texts = [repetitive(r) for _ in range(r.randrange(1, 8))]
        codes, offsets = op._coded([[b"%d" % x for x in w] for w in texts])
        start, end, q = op.runs(codes)
        own = np.searchsorted(offsets, start, "right") - 1
        got = [[] for _ in texts]
        for o, s, e, p in zip(own, start, end, q, strict=True):
            got[o].append((int(s - offsets[o]), int(e - s), int(p)))
        want = [sorted(plain_runs(w), key=lambda x: (x[0], x[2])) for w in texts]
        assert got == want
        some += sum(map(len, want))
    assert some > 1000


def test_wavelet_tree():
    from attrita.llm import periodic_runs as op

    r = np.random.default_rng(1)
    values = r.permutation(200)[:120]
    tree = op.WaveletTree(values, 200)
    left, right, least = r.integers(0, 121, 500), r.integers(0, 121, 500), r.integers(0, 300, 500)
    left, right = np.minimum(left, right), np.maximum(left, right)
    want = [min((int(x) for x in values[a:b] if x >= t), default=-1) for a, b, t in zip(left, right, least, strict=True)]
    assert tree.successor(left, right, least).tolist() == want


def test_periodic_runs(spark):
    from attrita.llm import periodic_runs as op

    r = random.Random(9)
    texts = [None, "", " \t\x0b\n", "a", "Ä b " * 12, "x " * 5000, " ".join(f"v{i % 700}" for i in range(9000))]
    texts += [" ".join(f"w{x}" for x in repetitive(r)) for _ in range(120)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(5, texts[5], "en", "s"), (None, texts[4], "en", "s")]
    got = op.periodic_runs(frame(spark, rows))
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted(((x.doc_id, x.n_words, [tuple(y) for y in x.runs], x.collapsed) for x in got.collect()), key=repr)
    want = []
    for i, t, _, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if i == 5 or i == 6:  # too long for the plain version, and known
            found = [(0, len(w), 1 if i == 5 else 700)]
        else:
            found = sorted(plain_runs(w), key=lambda x: (x[0], x[2]))
        drop = {k for s, n, q in found for k in range(s + q, s + n)}
        want.append((i, len(w), found, " ".join(x for k, x in enumerate(w) if k not in drop)))
    assert got == sorted(want, key=repr)
    assert op.periodic_runs(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        op.periodic_runs(frame(spark, []), least=5)


def test_periodic_runs_query(spark):
    from attrita.llm import periodic_runs as op

    got = {x.doc_id: x for x in op.query(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p, old = 1 + (n - a) // (3 + g % 8), list(w)
            w = [old[i] if i < a else old[a + (i - a) % p] for i in range(n)]
        if n > 700:
            continue
        found = sorted(plain_runs(w), key=lambda x: (x[0], x[2]))
        some += bool(found)
        drop = {k for s, m, q in found for k in range(s + q, s + m)}
        top = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
        x = got[d.doc_id]
        assert (x.n_runs, x.start, x.length, x.period) == (len(found), *top)
        assert x.exponent_milli == (1000 * top[1] // top[2] if found else None)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(" ".join(y for k, y in enumerate(w) if k not in drop).encode()).hexdigest()
    assert some > 5


def test_planted_words_of_a_null_id(spark):
    from attrita.llm import periodic_runs as op

    rows = [(None, "a b c", "en", "s"), (0, "", "en", "s"), (1, None, "en", "s")]
    assert sorted((x.doc_id is not None, x.text) for x in op.planted(frame(spark, rows)).where("text is not null").collect()) == [
        (False, "a b c"), (True, "")]
