import random

import numpy as np
import pytest

from tracewell.llm import common, lines, minhash

from .conftest import ROWS


def corpus(spark, seed=0):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    line = lambda n: [word() for _ in range(n)]
    base = [[line(r.randrange(5, 20)) for _ in range(r.randrange(1, 8))] for _ in range(30)]
    texts = []
    for _ in range(150):
        doc = [list(x) for x in r.choice(base)]
        for _ in range(r.randrange(3)):
            x = r.choice(doc)
            k = r.randrange(len(x))
            x[k : k + r.randrange(2)] = [word()] * r.randrange(2)
        if r.random() < 0.3:
            doc.insert(r.randrange(len(doc) + 1), line(r.randrange(1, 30)))
        if r.random() < 0.2:
            doc.append(["Common", "line", "of", "many."])
        texts.append("\n".join(" ".join(x).capitalize() + "." for x in doc))
    rows = [(3 * k + 100, t, "en", "s", len(t), 0, "k") for k, t in enumerate(texts)] + [r for r in ROWS if r[0] != 2]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, key string")


def near_lines(rows):
    first, order, near, seen = {}, [], {}, []
    for k, t in sorted((r.doc_id, r.text) for r in rows if r.doc_id is not None and r.text):
        for n, (_, _, x) in enumerate(lines.split_lines(t)):
            if w := tuple(lines.words_of(x)):
                order.append((k, n, w))
                first.setdefault(w, (k, n))
    for w, place in sorted(first.items(), key=lambda x: x[1]):
        if len(w) >= lines.NEAR_WORDS:
            if close := [first[x] for x in seen if lines.within_one(list(w), list(x)) == 1]:
                near[w] = min(close)
            seen.append(w)
    out = {}
    for k, n, w in order:
        if w in near:
            out[k, n] = (*near[w], 1)
        elif first[w] != (k, n):
            out[k, n] = (*first[w], 0)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_lines_equal_brute_force(spark, seed):
    d = corpus(spark, seed)
    got = {(r.doc_id, r.line_no): (r.kept_id, r.kept_line, r.edits) for r in lines.repeats(d).collect()}
    assert got == near_lines(d.collect()) and any(v[2] for v in got.values())


def test_line_dedup_of_documents(spark, none):
    d = corpus(spark)
    gone = near_lines(d.collect())
    want = {}
    for r in d.collect():
        kept = [x for n, (_, _, x) in enumerate(lines.split_lines(r.text)) if (r.doc_id, n) not in gone]
        cut = r.text is not None and any((r.doc_id, n) in gone for n in range(r.text.count("\n") + 1))
        if not cut or any(x.split() for x in kept):
            want[r.doc_id] = ("\n".join(kept), sum(map(len, kept)) + len(kept) - 1) if cut else (r.text, r.n_chars)
    got = lines.dedup(d)
    assert got.columns == d.columns and {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == want
    assert lines.repeats(none).count() == 0 and lines.dedup(none).count() == 0


def test_hot_offers_are_spread(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "bytes_of", lambda df: 1 << 40)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "HOT_SHARE", 10_000)
    d = corpus(spark, 6)
    got = {(r.doc_id, r.line_no): (r.kept_id, r.kept_line, r.edits) for r in lines.repeats(d).collect()}
    assert got == near_lines(d.collect()) and any(v[2] for v in got.values())


def test_line_dedup_of_clashing_names_and_shared_ids(spark, docs):
    a, b = ("w%d " * 9 % tuple(range(k, k + 9)) for k in (0, 20))
    rows = [(1, a + "\nx"), (1, b), (1, b), (2, b.replace("w25", "w99") + "\n" + a), (-5, b + "\n" + b)]
    clash = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS _id", "0 AS _v", "0 AS _gone", "0 AS doc", "0 AS v", "0 AS n_chars")
    out = lines.dedup(clash)
    assert out.columns == clash.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(-5, b), (1, a + "\nx")]
    assert lines.dedup(docs).columns == docs.columns


def test_near_duplicates_of_clashing_names_and_shared_ids(spark):
    text = lambda c: " ".join(f"{c}{k}" for k in range(40))
    rows = [(3, text("a")), (3, text("b")), (3, text("b")), (4, text("a") + " end"), (5, text("b") + " end"), (6, text("c")), (2, text("d")), (2, text("c"))]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS _gone", "0 AS id", "0 AS label", "0 AS n", "0 AS rep")
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(d).collect()}
    assert got == {(3, 3), (4, 3), (5, 3), (6, 2), (2, 2)}
    out = minhash.dedup(d)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == [2, 2, 3, 3, 3]


def test_edit_distance_over_words():
    def slow(a, b):
        d = np.arange(len(b) + 1)
        for x in a:
            new = [d[0] + 1]
            for j, y in enumerate(b):
                new.append(min(d[j] + (x != y), d[j + 1] + 1, new[-1] + 1))
            d = np.array(new)
        return int(d[-1])

    r = random.Random(5)
    for _ in range(2000):
        a, b = ([r.choice("ab") for _ in range(r.randrange(6))] for _ in range(2))
        n = slow(a, b)
        assert lines.within_one(a, b) == (n if n < 2 else None)


def components(rows, size):
    sets = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        k = min(size, len(w))
        sets[r.doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [k for k in sets if k is not None and sets[k]]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize(("size", "few", "block"), [(2, 200, 512), (5, 3, 4)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, size, few, block):
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "BLOCK", block)
    d = corpus(spark, 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(d, size=size).collect()}
    assert got == components(d.collect(), size)
    kept = {r.doc_id for r in minhash.dedup(d, size=size).collect()}
    assert kept == {k for k, (_, c) in got.items() if c == k}


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.label for r in minhash.components(e, "test").collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_pigeonhole_holds():
    """Signatures that differ in up to the guaranteed number of components share a key."""
    r = np.random.default_rng(0)
    for _ in range(300):
        a = r.integers(0, 2**63, minhash.K, dtype=np.uint64)
        b = a.copy()
        at = r.choice(minhash.K, minhash.CHUNKS * (minhash.ERRORS + 1) - 1, replace=False)
        b[at] += np.uint64(1)
        assert set(minhash.keys_of(a).tolist()) & set(minhash.keys_of(b).tolist())


def test_near_duplicates_of_nothing(spark, none, docs):
    assert minhash.near_duplicates(none).count() == 0 and minhash.dedup(none).count() == 0
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS) and {r.kept for r in rows if r.doc_id in (None, 3, 4, 5, 6)} == {True}


BLANKS = ["\u00a0", "\u3000", "\u0085", "\u2003", "\x1c", "\x1d", "\x1e", "\x1f"]


def test_only_ascii_blanks_separate_words(spark):
    """Other blanks are parts of words: such lines are neither equal to lines with a space nor without words."""
    import duckdb

    rows = [(1, "alpha beta gamma"), (2, "alpha\tbeta \x0b gamma\x0c")]
    for k, b in enumerate(BLANKS):
        rows += [(10 * k + 10, f"alpha{b}beta gamma"), (10 * k + 11, b), (10 * k + 12, f" {b}\r"), (10 * k + 13, f"a b c d e f g{b}h i j"), (10 * k + 14, "a b c d e f g h i j\nown line")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    names = ["doc_id", "line_no", "start", "stop", "kept_id", "kept_line", "edits"]
    want = set(con.execute(f"SELECT {', '.join(names)} FROM ({lines.SQL})").fetchall())
    assert {tuple(r) for r in lines.repeats(d).select(*names).collect()} == want
    left = {r.doc_id: r.text for r in lines.dedup(d).collect()}
    assert 2 not in left and all(left[10 * k + 10] == f"alpha{b}beta gamma" and left[10 * k + 11] == b for k, b in enumerate(BLANKS))


def test_least_words_of_near_lines_is_a_parameter(spark, monkeypatch):
    d = spark.createDataFrame([(1, "one two three"), (2, "one two four"), (3, "x"), (4, "one two"), (5, "y z")], "doc_id long, text string")
    for n in (1, 2, 3, 8):
        got = {(r.doc_id, r.line_no): (r.kept_id, r.kept_line, r.edits) for r in lines.repeats(d, near_words=n).collect()}
        monkeypatch.setattr(lines, "NEAR_WORDS", n)
        assert got == near_lines(d.collect())
    assert {r.doc_id for r in lines.dedup(d, near_words=3).collect()} == {1, 3, 4, 5}
    with pytest.raises(ValueError):
        lines.repeats(d, near_words=0)


def test_ids_that_are_no_whole_numbers_are_refused(spark):
    d = spark.createDataFrame([("a", "one two")], "doc_id string, text string")
    for run in (lines.repeats, lines.dedup, minhash.near_duplicates, minhash.dedup):
        with pytest.raises(TypeError, match="whole numbers"):
            run(d)
