"""The filter audit, the divergence audit and the hash forest against brute force, with the awkward rows of conftest."""

import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import divergence, interactions, neighbours


def audit_by_hand(docs, labels):
    rows, out = [], {}
    for r in docs:
        t, words = r.text or "", re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        fails = {"A"} if len(words) < 200 else set()
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if r.doc_id is not None and any(o.doc_id is not None and o.doc_id < r.doc_id and (o.text or "") == t for o in docs):
            fails.add("E")
        mine = [x for x in labels if x[0] is not None and x[0] == r.doc_id]
        rows.append((r.source or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    shapley = Counter()
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone, stay = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in rows if r[0] == part) - len(gone)
                alone = sum(r[1] == {f} for r in rows if r[0] == part)
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), redundant, alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                left = stay
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (5, None, 1), (None, 1, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def audited(docs, labels):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in interactions.audit(docs, labels).collect()}


def test_audit(spark, docs, none, labels):
    long = "word " * 400
    more = [(10, long, "en", "a", 1, 1, "k"), (11, long, "en", "b", 1, 1, "k"), (12, long[:-2] + "x ", "en", "b", 1, 1, "k"), (13, long[:-2] + "x ", "en", "b", 1, 1, "k"), (14, "ABC #", "en", "b", 1, 1, "k"), (11, long, "en", "b", 1, 1, "k")]
    d = docs.unionByName(spark.createDataFrame(more, docs.schema))
    assert audited(d, labels) == audit_by_hand(d.collect(), LABELS)
    assert audited(none, labels) == {}


def test_audit_with_hashes_that_meet(spark, labels, monkeypatch):
    """Texts that no block tells apart are still told apart by their full texts."""
    monkeypatch.setattr(interactions, "block_hashes", lambda t: [7] * len(interactions_blocks(t)))
    d = spark.createDataFrame([(k, "abcd"[k % 4] * 300, "s") for k in range(12)] + [(20, "q" * 300, None)], "doc_id long, text string, source string")
    assert audited(d, labels) == audit_by_hand(d.collect(), LABELS)


def interactions_blocks(text):
    return [s for s in (0, 256, 256 + 4096) if s < len(text)]


def test_blocks_tell_texts_apart():
    a, b = "x" * 5000, "x" * 4999 + "y"
    assert [p == q for p, q in zip(interactions.block_hashes(a), interactions.block_hashes(b), strict=True)] == [True, True, False]
    assert interactions.block_hashes("") == []


def divergence_by_hand(rows):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        lang, source = r.lang or "", r.source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        peers = [s for g, s in groups if g == lang]
        whole = sum((counts[lang, s] for s in peers), Counter())

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        mine, all_ = p(counts[lang, source]), p(whole)
        pair = [(sum((mine[t] - q) ** 2 // q for t, q in p(counts[lang, s]).items()), s) for s in peers if s != source]
        term = [((mine[t] - all_[t]) ** 2 // all_[t], t) for t in kept if counts[lang, source][t] and mine[t] > all_[t]]
        for part, found in (("pair", pair), ("term", term)):
            ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[: None if part == "pair" else 200]
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def test_divergence(spark, docs, none, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["The", "the", "cat", "CAT", "naïve", "Ünder", "über", "日本", "x", "a-b", "it's"]
    rows = [(k, " ".join(rng.choice(words, rng.integers(1, 30))), "en", f"s{k % 5}" if k % 7 else None, 1, 1, "k") for k in range(40)]
    rows += [(50, "the only", "one", "z", 1, 1, "k"), (51, "1 2 3", "en", "digits", 1, 1, "k")]
    d = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    want = divergence_by_hand(d.collect())
    assert sorted(tuple(r) for r in divergence.divergence(d).collect()) == want
    monkeypatch.setattr(divergence, "HELD", 3)  # a task hands on its counts again and again
    assert sorted(tuple(r) for r in divergence.divergence(d.coalesce(1)).collect()) == want
    assert divergence.divergence(none).collect() == []


def test_shares_are_exact(spark):
    big = spark.createDataFrame([(9_000_000_000_000_000, 9_100_000_000_000_000, 7)], "n long, total long, v long")
    got = big.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * (9_000_000_000_000_000 + 1) // (9_100_000_000_000_000 + 7)


VECTORS = "vec_id long, embedding array<float>, rank int, score string"


def nearest_by_hand(rows, k=20):
    used = [(r.vec_id, np.array(r.embedding, np.float64)) for r in rows if r.vec_id is not None and r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding)]
    size = max((len(x) for _, x in used), default=0)
    used = [(i, np.pad(x, (0, size - len(x)))) for i, x in used]
    out = {}
    for q in {i for i, _ in used if i % 20 == 0}:
        best = {}
        for i, x in used:
            if i != q:
                best[i] = max(float((x * y).sum()) for j, y in used if j == q) if i not in best else max(best[i], *(float((x * y).sum()) for j, y in used if j == q))
        out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return out


def found(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((-r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_forest_with_awkward_vectors(spark, monkeypatch):
    """Few vectors are searched whole, so that every rule of ties, copies and rows left out shows."""
    odd = [(0, [1.0, 0.0], 1, ""), (0, [0.0, 1.0], 1, ""), (1, None, 1, ""), (2, [0.0, 0.0], 1, ""), (3, [1.0, None], 1, ""), (4, [math.nan, 1.0], 1, ""), (5, [math.inf, 1.0], 1, ""), (None, [1.0, 1.0], 1, "")]
    odd += [(6, [], 1, ""), (7, [2.0], 1, ""), (8, [-1.0, 0.5, 0.25], 1, ""), (20, [1.0, 0.0], 1, ""), (-20, [3.0, 4.0], 1, "")] + [(100 + k, [0.5, 0.5], 1, "") for k in range(30)] + [(101, [0.5, 0.5], 1, "")]
    monkeypatch.setattr(neighbours, "TARGET", 1.0)
    d = spark.createDataFrame(odd, VECTORS)
    got, want = found(neighbours.search(d, F.col("id") % 20 == 0).collect()), nearest_by_hand(odd_rows(odd))
    assert got == want
    assert neighbours.search(spark.createDataFrame([], VECTORS), F.col("id") % 20 == 0).collect() == []
    assert neighbours.search(spark.createDataFrame(odd[3:8], VECTORS), F.col("id") % 20 == 0).collect() == []
    assert [tuple(r) for r in neighbours.search(spark.createDataFrame([(0, [1.0], 1, ""), (1, [-2.0], 1, "")], VECTORS), F.col("id") % 20 == 0).collect()] == [(0, 1, 1, -2.0)]


def odd_rows(rows):
    from collections import namedtuple

    return [namedtuple("R", "vec_id embedding rank score")(*r) for r in rows]


@pytest.mark.parametrize("bits", [None, 6])
def test_forest_recall(spark, monkeypatch, bits):
    """Clusters, near copies, many equal vectors and unlike norms; bits: buckets finer than most queries stop at."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((12, 16))
    x = centre[rng.integers(0, 12, 1500)] + 0.4 * rng.standard_normal((1500, 16))
    x *= rng.uniform(0.5, 2, (1500, 1))
    x[300:500] = x[300] + 1e-3 * rng.standard_normal((200, 16))
    x[500:700] = x[500]
    rows = [(k, v.astype(np.float32).tolist(), 0, "") for k, v in enumerate(x)]
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 8 * 16 * 100)  # several blocks to a bucket
    if bits is not None:
        fit = neighbours.wanted_of
        monkeypatch.setattr(neighbours, "wanted_of", lambda *a: (fit(*a)[0], bits))
    got, want = found(neighbours.search(spark.createDataFrame(rows, VECTORS), F.col("id") % 20 == 0).collect()), nearest_by_hand(odd_rows(rows))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = [len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want]
    assert sum(hits) >= 0.9 * 20 * len(hits)
    scores = {q: dict((i, s) for s, i in v) for q, v in nearest_by_hand(odd_rows(rows), 2000).items()}
    assert all(scores[q][i] == s for q, v in got.items() for s, i in v)
    copies = [q for q in want if 500 <= q < 700]
    assert copies and all([i for _, i in got[q]] == [i for _, i in want[q]] for q in copies)


def test_hash_strings():
    f = neighbours.Forest(3, 2.0)
    x = np.array([[1.0, 2.0, 0.0], [-1.0, 0.5, 0.3]])
    keys = f.keys(x)
    assert keys.shape == (2, neighbours.TREES)
    low, high = neighbours.bounds(keys[:, 0], np.array([0, 128]))
    assert low[0] == b"" and high[0] == b"\xff" * 16 and low[1] == keys[1, 0] == high[1]
