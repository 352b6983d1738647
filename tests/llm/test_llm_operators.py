"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

DOCS = "doc_id long, text string, lang string, source string, key string, n long, row long, comp string"


def frame(spark, texts, ids=None, langs=None, sources=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = ids or list(range(len(texts)))
    rows = [(i, t, (langs or ["en"] * len(texts))[j], (sources or ["s"] * len(texts))[j], "x", 1, 2, "y")
            for j, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def words(r, n, vocab=60):
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


def test_ngram_jaccard(spark, monkeypatch):
    from attrita.llm import ngram_jaccard as op

    monkeypatch.setattr(op, "CHUNK", 8)
    r = random.Random(3)
    base = [f"b{i}" for i in range(90)]
    texts = [None, "", " \t\n", "one two", "ONE two", "one  two three four", "É one two three four", words(r, 4000)]
    for i in range(70):  # near copies around the threshold
        copy = list(base)
        for _ in range(r.randrange(5)):
            copy[r.randrange(90)] = f"e{i}{r.randrange(9)}"
        texts.append(" ".join(copy))
    texts += [texts[9], texts[9].upper()] + [words(r, r.randrange(3, 40), 12) for _ in range(40)]
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(range(len(texts)), 2):
            if comp[a] != comp[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    got = op.ngram_jaccard_join(frame(spark, texts)).toPandas().set_index("doc_id").sort_index()
    assert got.n_shingles.tolist() == [len(s) for s in sets]
    assert got.component_id.tolist() == comp
    assert op.ngram_jaccard_join(frame(spark, [])).count() == 0


def test_ngram_jaccard_rows_grow_with_a_group(spark, monkeypatch):
    """Near copies of one text, most pairs just under or over the threshold: one component, rows in proportion."""
    from attrita.llm import ngram_jaccard as op

    made = {}
    plain = op.written

    def counted(df, name, *rest):
        out = plain(df, name, *rest)
        if name == "across":
            made[size] = made.get(size, 0) + out.count()
        return out

    monkeypatch.setattr(op, "written", counted)
    for size in (150, 300, 600):
        r = random.Random(size)
        texts = []
        for i in range(size):
            copy = [f"b{k}" for k in range(200)]
            for at in r.sample(range(200), 2):
                copy[at] = f"e{i}x{at}"
            texts.append(" ".join(copy))
        got = op.ngram_jaccard_join(frame(spark, texts)).select("component_id").distinct().count()
        assert got == 1
    assert made.get(600, 0) <= 8 * max(made.get(150, 0), 150)


def test_word_hashes_do_not_depend_on_segments(monkeypatch):
    from attrita.llm import common

    data = b"alpha beta\x00 gamma\x0bdelta " * 50
    whole, _ = common.word_hashes(data)
    monkeypatch.setattr(common, "SEGMENT_BYTES", 13)
    cut, places = common.word_hashes(data)
    assert (whole == cut).all() and data[places[1]:places[1] + 4] == b"beta"


def test_language_id(spark):
    from attrita.llm import language_id as op

    vocab = op.pieces(op.default_vocabulary())
    prob = np.random.default_rng(1).random((vocab.size, 2)) + 0.1
    prob /= prob.sum(axis=0)

    def brute(codes):
        if not codes:
            return np.ones(2)
        return sum((prob[i] * brute(codes[len(k):]) for n in range(1, vocab.longest + 1)
                    if (i := vocab.ids.get(k := codes[:n])) is not None and len(k) == n), np.zeros(2))

    some = ["the", "été", "a", "日本語x", "under"]
    for w, got in zip(some, op.word_scores(vocab, some, prob), strict=True):
        assert np.allclose(got, np.log(brute(tuple(vocab.spell([w])[0].tolist()))))
    codes = vocab.spell(["abcabcabcabcabcabc"])[0]
    short, counts = op._long_sums(vocab, codes, prob[:, :1], 2.0)
    assert np.allclose(short, op.word_scores(vocab, ["abcabcabcabcabcabc"], prob[:, :1])[0])
    assert np.allclose(counts, op.expected_counts(vocab, ["abcabcabcabcabcabc"], np.array([2.0]), prob[:, :1]))
    r = random.Random(5)
    own = {"aa": ["the", "house", "under", "water"], "bb": ["maison", "rue", "eau", "vert"]}
    langs = [r.choice(["aa", "bb"]) for _ in range(120)]
    texts = [" ".join(r.choice(own[k]) for _ in range(12)) for k in langs] + [None, "", "12 34 !", "x" * 3000]
    got = op.identify_languages(frame(spark, texts, ids=[*range(123), None], langs=[*langs, "aa", None, "aa", "bb"])).toPandas()
    got = got.sort_values("doc_id").reset_index(drop=True)
    want = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(123)] + [False]
    assert got.held_out.tolist() == want
    assert got.lang_pred[:120].tolist() == langs and got.lang_pred[120:123].tolist() == ["und"] * 3
    assert got.score.between(0, 1).all() and (got.score[120:123] == 0).all()
    assert op.identify_languages(frame(spark, [])).count() == 0


def test_language_id_of_words_below_the_smallest_double():
    from attrita.llm import language_id as op

    vocab = op.pieces(op.default_vocabulary())
    prob = np.full((vocab.size, 2), 1e-10)  # pieces unseen in billions
    seen = [vocab.ids[k] for k in (tuple(map(ord, "▁the")), tuple(map(ord, "▁house")))]
    prob[seen] = [[0.6, 0.1], [0.3, 0.1]]
    rare = "𐎠𐎡𐎢𐎣𐎤𐎥𐎦𐎧𐎨𐎩"  # 40 byte symbols
    codes = vocab.spell([rare])[0]
    assert 40 <= len(codes) <= op.VECTOR_SYMBOLS
    log_z, counts = op._long_sums(vocab, codes, prob[:, :1], 3.0)
    assert log_z[0] < math.log(5e-324)
    got = op.word_scores(vocab, ["the", rare, "house"], prob)
    assert np.isfinite(got).all() and np.allclose(got[1], op._long_sums(vocab, codes, prob)[0])
    assert np.allclose(op.expected_counts(vocab, [rare], np.array([3.0]), prob[:, :1]), counts)
    texts = ["the house", None, f"{rare} the", "", "the house", "house the the"]
    together = op._Scorer(vocab, prob).sums(texts)
    alone = np.concatenate([op._Scorer(vocab, prob).sums([t]) for t in texts])
    assert np.isfinite(together).all() and (together == alone).all()
    assert together[[0, 2, 4, 5]].argmax(axis=1).tolist() == [0] * 4


def test_pivot_topk(spark):
    from attrita.llm import pivot_topk as op

    r = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in r.normal(0, 0.2, 8).astype(np.float32)], 1) for i in range(300)]
    rows[7] = (7, rows[8][1], 1)
    rows += [(50, rows[3][1], 1), (None, rows[4][1], 1), (400, None, 1), (401, [None] * 8, 1), (402, [math.nan] * 8, 1),
             (403, [math.inf] * 8, 1), (404, [1.0, 2.0], 1), (450, [1.0, 3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    good = [(i, v, tuple(math.floor(256 * float(np.float32(x))) for x in e)) for i, (v, e, _) in enumerate(rows)
            if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for i, v, q in good:
        if v is not None and v % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), u is None, u or 0) for j, u, x in good if j != i and len(x) == len(q))
            want += [(v, k + 1, None if none else u, -s) for k, (s, none, u) in enumerate(best[:5])]
    got = [tuple(None if pd.isna(x) else int(x) for x in t) for t in op.pivot_topk(df).toPandas().itertuples(index=False)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert op.pivot_topk(df.limit(0)).count() == 0


def test_thousands_of_url_rules(spark, monkeypatch):
    """Rules and globs from tables, against regular expressions; slices of few URLs change nothing."""
    import tracemalloc

    from attrita.llm import url_filter as op

    r = random.Random(11)
    names = ["".join(r.choice("abcde") for _ in range(r.randrange(1, 6))) for _ in range(60)]
    host = lambda: ".".join(r.choice(names) for _ in range(r.randrange(1, 4)))
    path = lambda: "/" + "/".join(r.choice(names) for _ in range(r.randrange(0, 3)))
    rules = [(r.choice(["block", "allow"]), host(), path()) for _ in range(400)]
    globs = [(r.choice(["*", f"{r.choice(names)}.*", f"*.{host()}"]), r.choice([f"*{r.choice(names)}?{r.choice(names)}", f"{path()}*", "/x*"])) for _ in range(2000)]
    own, shapes = op.rule_tables(spark.createDataFrame(rules + rules[:5], "action string, host string, path string"),
                                 spark.createDataFrame(globs, "host string, path string"))
    assert set(own) == set(rules) and set(shapes) == set(globs)
    urls = [None, "no scheme", *(f"http://{host()}{path()}" for _ in range(400))]
    monkeypatch.setattr(op, "STATE_BYTES", 300_000)
    tracemalloc.start()
    got = op.judge(urls, own, shapes)
    assert op._compiled(own, shapes)[0].words > 400
    assert tracemalloc.get_traced_memory()[1] < 120_000_000
    tracemalloc.stop()
    ranked = sorted(own, key=lambda x: (-len(x[1] + x[2]), x[0] != "block"))
    turn = lambda g: re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g))
    seen = [(turn(h), turn(p)) for h, p in shapes]
    for i, u in enumerate(urls):
        h, p = op.host_and_path(u)
        rule = next((x for x in ranked if (h == x[1] or h.endswith("." + x[1])) and p.startswith(x[2])), None)
        verdict = rule[0] if rule else "block" if any(a.fullmatch(h) and b.fullmatch(p) for a, b in seen) else "allow"
        assert (got["host"][i], got["path"][i], got["verdict"][i]) == (h, p, verdict)
        assert got["rule"][i] == (rule[1] + rule[2] if rule else None)
    with pytest.raises(ValueError):
        op.rule_tables(spark.createDataFrame([("drop", "a", "/")], "action string, host string, path string"), None)


def test_pivot_topk_in_small_blocks(spark, monkeypatch):
    """Blocks, groups of blocks and carried thresholds change nothing."""
    from attrita.llm import pivot_topk as op

    r = np.random.default_rng(12)
    rows = [(int(i % 400), [float(x) for x in r.normal(0, 0.2, 6).round(1)]) for i in range(500)] + [(500 + i, [0.5] * 3) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want = sorted(map(tuple, op.pivot_topk(df, every=10).collect()))
    monkeypatch.setattr(op, "BLOCK", 16)
    monkeypatch.setattr(op, "GROUP", 3)
    got = sorted(map(tuple, op.pivot_topk(df, every=10).collect()))
    assert [(q, k, s) for q, k, _, s in got] == [(q, k, s) for q, k, _, s in want] and len(got) > 200
    vectors = {}
    for v, x in rows:
        vectors.setdefault(v, []).append(np.floor(256 * np.float32(x).astype(float)))
    assert all(any(int(a @ b) == s for a in vectors[q] if len(a) for b in vectors[v] if len(a) == len(b)) for q, _, v, s in got)


def test_pivots_eliminate():
    """Of the vectors of sf0.1, which have no clusters, under a tenth are evaluated, with exact results."""
    import pyarrow.parquet as pq

    from attrita.llm import pivot_topk as op

    column = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].combine_chunks()
    x = np.array([v for v in op.integer_rows(column) if v is not None])
    pivots, ids = op.Pivots(list(x[:op.SAMPLE])), np.arange(len(x))
    block, evaluated, asked = op.Block(ids, ids, None, x, pivots.distances(x), pivots), 0, range(0, len(x), 50)
    for j in asked:
        best, n = op.top_of_block(block, j, block, 5)
        evaluated += n
        scores = x @ x[j]
        scores[j] = -np.inf
        assert [p for p, _ in best] == np.lexsort((ids, -scores))[:5].tolist()
        assert (block.bounds(block, j) >= x @ x[j]).all()
        least = best[-1][1]
        again, fewer = op.top_of_block(block, j, block, 5, known=float(least))
        assert fewer <= n and [s for _, s in again if s >= least] == [s for _, s in best]
    assert evaluated < 0.1 * len(asked) * len(x)


@pytest.mark.parametrize("scale", [1.0, 1e8, 1e150])
def test_pivot_bounds_hold_for_awkward_vectors(scale):
    """Copies, zeros, dependent and huge vectors: bounds never fall below a score."""
    from attrita.llm import pivot_topk as op

    r = np.random.default_rng(4)
    x = np.floor(r.normal(0, 50, (60, 6)) * scale)
    x[10:20] = x[0]
    x[20:25] = 0
    x[25:30] = 3 * x[1]
    for rows in (x, x[20:25], x[:1]):
        pivots, ids = op.Pivots(list(rows)), np.arange(len(rows))
        block = op.Block(ids, ids, None, rows, pivots.distances(rows), pivots)
        for j in range(len(rows)):
            assert (block.bounds(block, j) >= (rows @ rows[j]) * (1 - 1e-12)).all()
            assert len(op.top_of_block(block, j, block, 5)[0]) == min(5, len(rows) - 1)


AWKWARD = ["a", "The", "the.,", "  ", " ", "\n", "\t", "é", "'s", "don't", "12", "!", " ", "ΑΣ", "İ", "<|endoftext|>", "日本",
           "x́", "\x1c", "\x85", "🙂", "thing,", "a" * 90]


def awkward(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(AWKWARD) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_token_files(spark, tmp_path):
    from attrita.llm import token_files as op

    texts = [None, "", *awkward(300, 1), "ab" * 30_000]
    ids = [5, 5, *range(10, 310), None]
    library = op._tokenizer(op.default_vocabulary())
    coded = sorted((-1 if i is None else i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in zip(ids, texts, strict=True))
    path = op.write_token_files(frame(spark, texts, ids), str(tmp_path / "t"))
    got = op.read_token_files(spark, path).toPandas().sort_values("start")
    assert got.doc_id.fillna(-1).astype(int).tolist() == [i for i, _ in coded]
    assert got.n_tokens.tolist() == [len(x) for _, x in coded]
    assert got.start.tolist() == list(np.cumsum([0, *[len(x) for _, x in coded]])[:-1])
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(x, dtype="<u4").tobytes()) for _, x in coded]
    assert op.read_token_files(spark, op.write_token_files(frame(spark, []), str(tmp_path / "e"))).count() == 0


def test_token_files_units_are_looked_up_once_a_group():
    """Texts are cut and put together as arrays: of a group's words only the different ones are looked up and encoded."""
    import pyarrow as pa

    from attrita.llm import token_files as op

    encoder = op.UnitEncoder(op.default_vocabulary())
    asked, hold = [], encoder.known.hold
    encoder.known.hold = lambda wanted, make: hold(asked.append(list(wanted)) or asked[-1], make)
    texts = ["the cat saw the dog " * 500 + "end", "", " ", "  the  cat\n dog\u3000x \u3000y z ", "the cat\n the", "a <|endoftext|> b", *awkward(200, 7)] * 2
    ids, lengths = encoder.encode(pa.array(texts).slice(1))
    library = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts[1:]]
    assert lengths.tolist() == [len(x) for x in library]
    assert ids.tolist() == [i for x in library for i in x]
    assert len(asked) == 1 and len(asked[0]) == len(set(asked[0]))
    none, of_none = encoder.encode(pa.array([], type=pa.string()))
    assert len(none) == len(of_none) == 0


def test_secret_scan(spark):
    from attrita.llm import secret_scan as op

    live, copied = "Zx8Kq2Lm9Vt4Rb7Nw1Yc", "AbCd1234EfGh5678IjKl"
    texts = [None, "", "API_KEY = 'abc123' password:short Token=\"é\" ſecret=abcdefgh", "AKIA" + "Z9" * 9 + " AKIAshort",
             "x" + "0a" * 13 + " " + "f" * 23, f"see {live} there", *[f"use {copied}"] * 3, "é🙂 secret: " + "q" * 40_000]
    sources = ["a", "a", "b", "c", "d", "e", "f", "g", "h", None]
    docs = frame(spark, texts, sources=sources)
    got = op.scan_secrets(docs).toPandas().set_index("doc_id").sort_index()
    for i, t in enumerate(texts):
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "", re.ASCII) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
        text = ",".join(f"{op.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert got.base_sha256[i] == hashlib.sha256(text.encode()).hexdigest()
        assert [got.n_assign[i], got.n_access[i], got.n_hex[i]] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        if i not in (5,):
            assert got.spans[i] == text
    assert got.spans[5] == f"live:4:{4 + len(live)}"
    clean = {r.doc_id: r for r in op.redact(docs).collect()}
    assert clean[5].text == "see [SECRET] there" and clean[6].text == texts[6] and clean[0].text is None
    assert clean[9].text == "é🙂 [SECRET]" and len(clean) == len(texts) and clean[5].key == "x"
    assert op.scan_secrets(frame(spark, [])).count() == 0


def test_url_filter(spark):
    from attrita.llm import url_filter as op

    r = random.Random(4)
    globs = [("".join(r.choice("ab*?.") for _ in range(r.randrange(1, 9))), "".join(r.choice("ab*/?") for _ in range(r.randrange(9)))) for _ in range(60)]
    urls = [("".join(r.choice("ab.") for _ in range(r.randrange(9))), "".join(r.choice("ab/") for _ in range(r.randrange(9)))) for _ in range(300)]
    to_re = lambda g: "".join({"*": "[^\\0]*", "?": "[^\\0]"}.get(c, re.escape(c)) for c in g)
    want = [[re.fullmatch(to_re(h) + "\\0" + to_re(p), f"{a}\0{b}") is not None for h, p in globs] for a, b in urls]
    assert (op.GlobAutomaton(globs).matches([f"{a}\0{b}".encode() for a, b in urls]) == np.array(want)).all()
    cases = {None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme": ("", "", None, "allow"),
             "http://X.NET/a?b": ("x.net", "/a", "net/", "block"), "http://net": ("net", "", None, "allow"),
             "http://www.example.net/en/x": ("www.example.net", "/en/x", "example.net/en/", "allow"),
             "http://badexample.com/de/": ("badexample.com", "/de/", None, "allow"),
             "https://a.example.com/de/#f": ("a.example.com", "/de/", "example.com/de/", "block"),
             "http://ads.site.io/x": ("ads.site.io", "/x", None, "block"), "http://é.org/fr/": ("é.org", "/fr/", "org/fr/", "allow"),
             "http://a\nb/" + "z" * 5000 + ".exe": ("a\nb", "/" + "z" * 5000 + ".exe", None, "block")}
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)] + [(None, "http://net/", "h")], "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in op.filter_urls(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and got[None][3] == "block"
    assert op.filter_urls(df.limit(0)).count() == 0


def test_license_scan(spark):
    from attrita.llm import license_scan as op

    r = random.Random(6)
    texts = [None, "", "x", "\n\n", "Released under the MIT License.", "été\nreleased UNDER the mit -- license\nfoo", words(r, 6000)]
    for _, t in op.TEMPLATES:
        w = t.split()
        for _ in range(4):
            c = [x if r.random() > 0.08 else "zz" for x in w]
            texts.append("intro line here\n" + " ".join(c))
    want = []
    for i, t in enumerate(texts):
        lines = t.split("\n") if t is not None else []
        for unit, u in ([(0, t)] if len(lines) > 1 else []) + list(enumerate(lines, 1)):
            g = op.numbered_bigrams(re.sub(r"[\W_]+", " ", u.lower()).split())
            best = min(((-2 * len(set(g) & set(own)) / (len(g) + len(own)), name) for name, own in op.template_bigrams(op.TEMPLATES)))
            if -best[0] >= op.THRESHOLD:
                want.append((i, unit, best[1], round(-best[0], 4)))
    got = [(x.doc_id, x.unit, x.license, x.dice) for x in op.scan_licenses(frame(spark, texts)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 10
    assert op.scan_licenses(frame(spark, [])).count() == 0


def test_license_passages(spark):
    from attrita.llm import license_passages as op

    r = random.Random(7)
    known = [(name, op.bigrams(t)) for name, t in op.TEMPLATES + op.PASSAGES]
    gpl = op._GPL_NOTICE.split(" version. ")[0] + " version."
    wrapped = [gpl[:58], gpl[58:117], gpl[117:176], gpl[176:]]
    texts = [None, "", "mit", words(r, 30) + "\n" + "\n".join(wrapped) + "\n" + words(r, 40), op._MIT_GRANT,
             "This project is released under the MIT License.", "The MIT License (MIT)\n" + op.PASSAGES[7][1],
             "of the license " * 60, words(r, 300), "Permission is hereby granted to the license license license"]
    for _, t in op.TEMPLATES[::2] + op.PASSAGES[::3]:
        texts.append(words(r, 9) + " " + " ".join(x if r.random() > 0.08 else "the" for x in t.split()) + "\n" + words(r, 9))
    want = {}
    for i, t in enumerate(texts):
        g = op.bigrams(t or "")
        for name, own in known:
            held = set(own)
            for a in (a for a in range(len(g)) if g[a] in held):
                left, common = op.Counter(own), 0
                for b in range(a, min(len(g), a + int(1.5 * len(own) + 1e-9))):
                    if left[g[b]] > 0:
                        left[g[b]] -= 1
                        common += 1
                    if (d := 2 * common / (b - a + 1 + len(own))) >= op.THRESHOLD:
                        want[i, name] = min(want.get((i, name), (0,)), (-d, -common, a + 1, b - a + 1))
    docs = frame(spark, [*texts, texts[5], texts[5]], ids=[*range(len(texts)), 5, None])
    rows = [(x.doc_id, x.license, x.dice, x.start, x.bigrams, x.common) for x in op.find_passages(docs).collect()]
    full = [(i, name, round(-d, 4), a, n, -c) for (i, name), (d, c, a, n) in want.items()]
    full += [(j, *x[1:]) for x in full if x[0] == 5 for j in (5, None)]
    assert sorted(map(repr, rows)) == sorted(map(repr, full))
    assert {(3, "GPL-3.0"), (4, "MIT"), (5, "MIT"), (6, "MIT")} <= set(want) and len(want) > 10
    assert op.find_passages(frame(spark, [])).count() == 0


def test_bpe_stream(spark):
    from attrita.llm import bpe_stream as op
    from tokenizers import Tokenizer

    file = op.default_vocabulary()
    library, own = Tokenizer.from_file(file), op.tokenizer(file)
    library.no_truncation()
    texts = [None, "", *awkward(400, 2), "ab" * 4000 + "é" * 1000]
    got = op.encode_documents(frame(spark, texts, ids=[None, *range(1, len(texts))])).toPandas()
    got = got.set_index(got.doc_id.fillna(0).astype(int)).sort_index()
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got.ids[i].tolist() == ids and got.n_tokens[i] == len(ids)
        assert got.ids_sha256[i] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256[i] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert "".join(own.decode(own.encode("Ünder wörld 🙂 42"))) == "ünder wörld 🙂 4 2 "
    stream = op.Transducer(own.merges)
    early = [t for c in "thandrer" * 4000 for t in stream.push(c)]
    assert stream.held < 6 * own.merges.longest <= own.merges.sufficient_lookahead + own.merges.longest
    assert "".join(early + stream.finish()) == "thandrer" * 4000
    assert op.token_digests(frame(spark, [])).count() == 0
    back = {r.doc_id: r.text for r in op.decode_documents(op.encode_documents(frame(spark, ["Hello world", None]))).collect()}
    assert back == {0: "hello world ", 1: ""}


def _least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        row, old = [i], row
        for j, b in enumerate(text, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (a != b)))
    return min(row)


def test_decontaminate(spark):
    from attrita.llm import decontaminate as op

    r = random.Random(8)
    items = [words(r, 14, 4000) for _ in range(12)] + [None, "", "short", words(r, 14, 30)]
    bench = spark.createDataFrame([(i, t, "e") for i, t in enumerate(items)], "item_id long, text string, edits string")
    texts = [None, "", words(r, 2000, 4000)]
    for t in items[:12]:
        for edits in (0, 2, 4, 6, 9):
            c = list(t.upper())
            for _ in range(edits):
                at = r.randrange(len(c))
                c[at:at + 1] = r.choice(["", "#", "##"])
            texts.append(words(r, 20, 4000) + "\n" + "".join(c) + " " + words(r, 5, 4000))
    got = {(x.doc_id, x.item_id): x.edits for x in op.find_contamination(frame(spark, texts), bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            p, budget = op.normalise(item), int(op.RATE * len(op.normalise(item)))
            if len(p) >= op.MIN_CHARS and t and len(t) < 2000 and (e := _least_edits(p, op.normalise(t))) <= budget:
                want[i, j] = e
    assert got == want and len(want) > 30
    docs = frame(spark, texts)
    kept = {x.doc_id for x in op.drop_contaminated(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in want}
    assert op.find_contamination(docs, bench.limit(0)).count() == 0 and op.drop_contaminated(docs, bench.limit(0)).columns == docs.columns


def test_decontaminate_short_items(spark):
    from attrita.llm import decontaminate as op

    items = ["What is 2 + 2?", "cat", "中国的首都是哪里", " ", "a ca"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = ["so what is  2 + 2? four", "concatenate cats", "catcat cat.", "请问中国的首都是哪里呢", "what is 2 + 3?", None]
    docs = frame(spark, texts)
    got = sorted((x.doc_id, x.item_id, x.edits, x.start, x.end) for x in op.find_contamination(docs, bench).collect())
    assert got == [(0, 0, 0, 3, 17), (2, 1, 0, 7, 10), (3, 2, 0, 2, 10)]
    assert sorted(x.doc_id for x in op.drop_contaminated(docs, bench).collect()) == [1, 4, 5]


def test_quality_mil(spark):
    from attrita.llm import quality_mil as op

    r = random.Random(9)
    good = [". ".join(words(r, r.randrange(5, 12), 900).capitalize() for _ in range(r.randrange(2, 30))) for _ in range(160)]
    bad = [t[:len(t) // 2] + " ".join(w + r.choice(["%%%", "###"]) for w in t[len(t) // 2:].split()) for t in good[:80]]
    texts = good + bad + [None, "", "word " * 30_000]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 160), 0) for i in range(240)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, text int")
    model = op.fit(docs, labels)
    got = op.score_documents(docs, model).toPandas().set_index("doc_id").sort_index()
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got.score[i] >= op.THRESHOLD) == (i < 160) for i in held]) >= 0.9
    assert got.score.between(0, 1).all() and all(abs(sum(a) - 1) < 1e-6 for a in got.attention)
    kept = {x.doc_id for x in op.keep_good(docs, model).collect()}
    assert kept == set(got.index[got.score >= op.THRESHOLD])
    again = op.score_documents(docs.repartition(7), op.fit(docs.repartition(5), labels)).toPandas().set_index("doc_id").sort_index()
    assert np.allclose(got.score, again.score)
    assert op.fit(docs, labels.limit(0)) is None and op.score_documents(docs, None).first().score == 1.0


def plain_score(model, passages):
    """One document, passage by passage."""
    p, codes, weights = model.p, [], []
    for x in passages:
        x = [(a - m) / s for a, m, s in zip(x, model.mean, model.scale, strict=True)]
        h = [math.tanh(sum(a * w for a, w in zip(x, p["w"][:, j], strict=True)) + p["b"][j]) for j in range(len(p["b"]))]
        gate = 0.0
        for j in range(p["v"].shape[1]):
            t = math.tanh(sum(a * b for a, b in zip(h, p["v"][:, j], strict=True)))
            s = 1 / (1 + math.exp(-sum(a * b for a, b in zip(h, p["u"][:, j], strict=True))))
            gate += t * s * p["a"][j]
        codes.append(h)
        weights.append(math.exp(gate))
    z = [sum(w * h[j] for w, h in zip(weights, codes, strict=True)) / sum(weights) for j in range(len(p["c"]))]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, p["c"], strict=True)) + p["d"][0]))), [w / sum(weights) for w in weights]


def bags(r, n=12):
    from attrita.llm import quality_mil as op

    texts = [words(r, r.randrange(1, 400), 50) for _ in range(n)] + [None, ""]
    x, offsets = op.passage_features(texts)
    return x.astype(np.float64), offsets, np.array([i % 2 for i in range(n + 2)])


def test_attention_equals_a_plain_forward_pass():
    from attrita.llm import quality_mil as op

    x, offsets, label = bags(random.Random(3))
    model = op.AttentionMil().fit(x, offsets, label, epochs=5)
    f = model.forward(x, offsets)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        score, weights = plain_score(model, x[a:b].tolist())
        assert f["score"][i] == pytest.approx(score, abs=1e-9)
        assert f["weight"][a:b] == pytest.approx(weights, abs=1e-9)


def test_first_step_follows_the_numeric_gradient():
    """Adam's first step is the gradient over its own size, so its sign is the gradient's, for every kind of parameter."""
    from attrita.llm import quality_mil as op

    x, offsets, label = bags(random.Random(5))
    model = op.AttentionMil()
    before = {k: v.copy() for k, v in model.p.items()}
    model.fit(x, offsets, label, epochs=1, rate=1e-3)
    moved = {k: before[k] - v for k, v in model.p.items()}
    share = np.array([(label == k).sum() for k in (0, 1)])

    def loss():
        s = model.forward(x, offsets)["score"]
        return -(np.where(label == 1, np.log(s), np.log(1 - s)) / (2 * share[label])).sum()

    r = np.random.default_rng(1)
    for name, value in before.items():
        for _ in range(12):
            at = tuple(int(r.integers(n)) for n in value.shape)
            model.p = {k: v.copy() for k, v in before.items()}
            model.p[name][at] += 1e-5
            up = loss()
            model.p[name][at] -= 2e-5
            slope = (up - loss()) / 2e-5 + 1e-5 * value[at]
            if abs(slope) > 1e-5:
                assert moved[name][at] == pytest.approx(1e-3 * np.sign(slope), rel=2e-2)


def test_quality_of_odd_labels(spark):
    """Null ids, one class only, empty tables."""
    from attrita.llm import quality_mil as op

    docs = frame(spark, ["good words here", "bad %%% words", None], [1, 2, None])
    one = op.fit(docs, spark.createDataFrame([(1, 1), (2, 1), (None, 0)], "doc_id long, quality int"))
    rows = op.score_documents(docs, one).collect()
    assert {x.doc_id for x in rows} == {1, 2, None} and all(x.score > 0.5 for x in rows)
    assert op.score_documents(docs.limit(0), one).count() == 0
    assert op.fit(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int")) is None


SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import corpus_pipeline
    import pyarrow.parquet as pq

    from attrita.llm import bpe_stream, ngram_jaccard, quality_mil, secret_scan

    got = corpus_pipeline.run(spark, SF).toPandas().set_index("doc_id").sort_index()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality_mil.keep_good(docs, quality_mil.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).toPandas().sort_values("doc_id")
    sets = dict(zip(kept.doc_id, ngram_jaccard.shingle_sets(kept.text.tolist()), strict=True))
    comp = {d: d for d in sets}
    for _ in range(3):
        for a, b in itertools.combinations(sorted(sets), 2):
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                comp[a] = comp[b] = min(comp[a], comp[b])
    bench = pq.read_table(f"{SF}/benchmark.parquet").to_pandas().text.tolist()
    text = dict(zip(kept.doc_id, kept.text, strict=True))
    stay = [d for d in sorted(comp) if comp[d] == d and not any(" ".join(b.lower().split()) in " ".join(text[d].lower().split()) for b in bench)]
    assert got.index.tolist() == stay
    plain = [d for d in stay if not secret_scan.base_spans(text[d]) and not secret_scan.key_like_spans(text[d], [])]
    own = bpe_stream.tokenizer(bpe_stream.default_vocabulary())
    for d, (_, n, ids, spelled) in zip(plain, own.digests([text[d] for d in plain]), strict=True):
        assert (got.n_tokens[d], got.ids_sha256[d], got.decoded_sha256[d]) == (n, ids, spelled)


def test_pipeline_near_duplicates_at_five_words_and_80_percent(spark):
    import corpus_pipeline

    def pair(name, n):  # n words and a copy with one other word: n - 9 of n + 1 five-word shingles are common
        w = [f"{name}{i}" for i in range(n)]
        return [" ".join(w), " ".join([*w[:n // 2], "other", *w[n // 2 + 1:]])]

    texts = [*pair("a", 50), *pair("b", 44), None, ""]  # 41 / 51 = 0.804 (four words: 0.843), 35 / 45 = 0.778
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, texts), SF).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2, 3, 4, 5]


def test_pipeline_near_duplicates_of_repeated_and_null_ids(spark):
    import corpus_pipeline

    r = random.Random(10)
    a, b, c, d = (words(r, 40, 4000) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (3, b), (3, c), (3, c), (None, c), (None, d), (None, d), (None, None), (None, None), (5, ""), (5, "")]
    docs = frame(spark, [t for _, t in rows]).drop("doc_id").withColumnRenamed("row", "x")
    docs = spark.createDataFrame([(i, *tuple(x)) for (i, _), x in zip(rows, docs.collect(), strict=True)],
                                 "doc_id long, " + ", ".join(f"{n} {k}" for n, k in docs.dtypes))
    for parts in (1, 5):
        got = corpus_pipeline.near_duplicates(spark, docs.repartition(parts), SF)
        assert got.columns == docs.columns
        kept = sorted((x.doc_id or 0, x.text or "") for x in got.collect())
        assert kept == sorted([(1, a), (2, b), (3, c), (0, d), (0, ""), (0, ""), (5, ""), (5, "")])


@pytest.mark.parametrize("name", ["op6_url_filter", "op7_license_scan", "op3_pivot_topk", "op1_ngram_jaccard_join"])
def test_sql_twin(spark, name):
    import duckdb

    from attrita.llm import queries

    got = queries.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()[list(got.columns)]
    rows = lambda df: sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_a_secret_copied_through_one_owners_repositories(spark, monkeypatch):
    """Both counts decide: one owner with many repositories holds an example, with few a live key."""
    from attrita.llm import secret_scan as op

    key, rare = "Zx81Kq9Lm2Np4Rt6Vw8Yb0Cd", "Qa72Ws63Ed54Rf45Tg36Yh27"
    texts = [f"say {key} here {i}" for i in range(6)] + [f"and {rare} once"] * 2 + ["nothing"]
    docs = frame(spark, texts)
    few = {x.doc_id: x.spans for x in op.scan_secrets(docs, example_repositories=7).collect()}
    many = {x.doc_id: x.spans for x in op.scan_secrets(docs, example_repositories=6).collect()}
    assert all(few[i] == "live:4:28" for i in range(6)) and few[6] == "live:4:28"
    assert all(many[i] == "" for i in range(6)) and many[6] == many[7] == "live:4:28"


def test_names_that_operators_use_inside(spark):
    """Extra columns named like the operators' own ones pass through."""
    import corpus_pipeline

    from attrita.llm import secret_scan as op

    rows = [(0, "password = hunter2hunter2", 24, 1, 2, 3, "r", 5), (1, "plain words here", 16, 1, 2, 3, "r", 5), (None, None, 0, 1, 2, 3, "r", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _id int, _hash int, _spans int, _row string, _least int"
                                 ).selectExpr("*", "'s' as source")
    got = {x.doc_id: x for x in op.redact(docs, chars_col="n_chars").collect()}
    assert got[0].text == "[SECRET]" and got[0].n_chars == 8 and got[1].text == "plain words here" and got[None].text is None
    assert op.redact(docs).columns == docs.columns
    kept = corpus_pipeline.near_duplicates(spark, docs.union(docs), SF)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == [0, 1]


def test_workers_let_go_of_other_operators(monkeypatch):
    from attrita.llm import bpe_stream, common, decontaminate

    monkeypatch.setattr(common, "_turn", [""])
    bpe_stream.tokenizer(bpe_stream.default_vocabulary())
    decontaminate._built[1, 0.1, 2] = None
    common.begin("attrita.llm.bpe_stream")
    assert bpe_stream.tokenizer.cache_info().currsize == 1 and not decontaminate._built
    common.begin("attrita.llm.ngram_jaccard")
    assert bpe_stream.tokenizer.cache_info().currsize == 0


def test_decoding_in_pieces():
    """The incremental decoder gives the library's text however the ids are cut."""
    from tokenizers import Tokenizer

    from attrita.llm import bpe_stream as op

    file = op.default_vocabulary()
    ids = Tokenizer.from_file(file).encode("Some words, élan\U0001f600 and <|x|> more..", add_special_tokens=False).ids
    want = Tokenizer.from_file(file).decode(ids, skip_special_tokens=False)
    for size in (1, 2, 3, 100):
        machine, flat = op.SpacedDecoder(op.tokenizer(file).names), np.array(ids)
        assert b"".join(machine.feed(flat[i:i + size], i > 0) for i in range(0, len(ids), size)).decode() == want
    assert op.SpacedDecoder({}).feed(np.empty(0, dtype=np.int64), False) == b""
