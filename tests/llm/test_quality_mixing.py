import re
from collections import Counter, defaultdict

import pytest

from tracewell.llm import mixing, quality

from .conftest import ROWS


def slow_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(hit)


TEXTS = [r[1] for r in ROWS] + ["a b c a b c", "a b c d a b c", "x\nx\n x\n\nx", "# a | <b>", "a a a a", "a a a", "\u00a0 b\u2003c"]


@pytest.mark.parametrize("text", TEXTS)
def test_measures(text):
    assert quality.measure(text) == slow_measure(text)


def test_ledger_policies_and_ablations(docs, none):
    led = quality.ledger(docs)
    rows = quality.apply_policy(led).collect()
    for r in rows:
        m = (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words)
        assert r.fail_mask == quality.failed_bits(m)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (r.fail_mask & quality.mask_of("v1") == 0)
    masks = [r.fail_mask for r in rows]
    for a in quality.ablations(led).collect():
        bit = 1 << quality.RULES.index(a.rule)
        assert (a.failed, a.failed_alone, a.rejected) == (sum(bool(m & bit) for m in masks), sum(m == bit for m in masks), sum(map(bool, masks)))
    assert quality.apply_policy(quality.ledger(none)).count() == 0
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def corpus(spark, n=400):
    rows = []
    for k in range(n):
        source = "big" if k % 3 else f"s{k % 7}"
        rows.append((k, " ".join(f"w{k}x{j}" for j in range(k % 97)), "en", None if k % 50 == 0 else source, 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("shard", [1 << 18, 500])
def test_mix_meets_its_targets(spark, monkeypatch, shard):
    monkeypatch.setattr(mixing, "SHARD_WORDS", shard)
    d = corpus(spark)
    rows = mixing.mix(d).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(d.repartition(3)).collect()), key=str)
    sizes, taken, source = defaultdict(int), defaultdict(int), {r.doc_id: r.source for r in d.collect()}
    for r in rows:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    target = brute_targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
    for s, t in target.items():
        shards = -(-sizes[s] // shard) + 1
        assert abs(taken[s] - t) <= mixing.BLOCK * shards
    got = mixing.mixed(d)
    assert got.columns == d.columns
    words = {r.doc_id: len(r.text.split()) for r in got.collect()}
    assert words == {r.doc_id: r.taken for r in rows if r.taken}


def test_quotas_are_those_of_the_highest_quotients(spark):
    for seats in (0, 1, 7, 50, 1000):
        votes = [(0, k, v, seats) for k, v in enumerate([53, 24, 23, 0, 1, 24])]
        df = spark.createDataFrame(votes, "g int, p int, v long, n long")
        got = {r.p: r.q for r in mixing.sainte_lague(df, ["g"], "p", "v", "n", "q").collect()}
        quotients = sorted(((-v / (2 * s + 1), k) for _, k, v, _ in votes if v for s in range(seats)))[:seats]
        assert got == {k: sum(x[1] == k for x in quotients) for k in range(6)}


def test_mix_of_odd_rows(docs, none, spark):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    blank = docs.where("doc_id IN (3, 4, 5)")
    assert {(r.target, r.taken) for r in mixing.mix(blank).collect()} == {(0.0, 0)}
