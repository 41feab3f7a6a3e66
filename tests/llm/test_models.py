import os
import random
import zlib

import numpy as np
import pytest

from tracewell.llm import toxicity, urls

from .conftest import ROWS


def labelled(spark, n=600):
    r = random.Random(1)
    mild = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for k in range(n):
        words = [r.choice(mild) for _ in range(r.randrange(20, 200))]
        bad = int(k % 4 == 0)
        for _ in range(3 * bad):
            words[r.randrange(len(words))] = r.choice(["zorgling", "zorglings", "vxquark", "vxquarkish"])
        docs.append((k, " ".join(words)))
        labels.append((k, bad))
    docs += [(10_000, "a calm text with one zorglin in it"), (10_001, None), (10_002, "")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_unseen_spellings(spark):
    docs, labels = labelled(spark)
    texts, y, pos, neg = toxicity.training_rows(docs, labels)
    train_ids = [r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    assert len(texts) == len(train_ids) == pos + neg and pos == int(y.sum())
    model = toxicity.fit(texts, y, pos, neg)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(scores[r.doc_id] >= 0.5) == r.toxic for r in held]) > 0.95
    assert scores[10_000] >= 0.5 and scores[10_001] == scores[10_002] < 0.5
    again = {r.doc_id: r.score for r in toxicity.score(docs.repartition(3), toxicity.fit(texts, y, pos, neg)).collect()}
    assert scores == again
    apart = toxicity.fit_rows(*toxicity.sampled(docs.repartition(5), labels))  # texts stay in the executors
    assert {r.doc_id: r.score for r in toxicity.score(docs, apart).collect()} == scores


def test_training_rows_of_repeated_ids(spark, monkeypatch):
    """Clean ids on 50 rows each crowd out no class; an id gives one text."""
    monkeypatch.setattr(toxicity, "SAMPLE", 20)
    rows = [(k, f"text {k}") for k in range(200)] + [(k, f"text {k} again") for k in range(0, 200, 2) for _ in range(49)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(1, 1), (3, None)], "doc_id long, toxic int")
    texts, y, pos, neg = toxicity.training_rows(docs, labels)
    assert len(texts) == 40 and y.sum() == 20 and len({t.split()[1] for t in texts}) == 40
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5]
    assert (pos, neg) == (sum(k % 2 for k in ids), sum(1 - k % 2 for k in ids))
    assert toxicity.training_rows(docs.repartition(5), labels)[0] == texts


def test_training_equals_plain_loops(monkeypatch):
    """The sparse steps against dense softmax regression on embeddings, one text and one bucket at a time."""
    monkeypatch.setattr(toxicity, "BUCKETS", 50)
    r = random.Random(4)
    bags = [(np.array(sorted(r.sample(range(50), 5)), np.int32), np.full(5, 0.2, np.float32)) for _ in range(90)]
    y = np.array([int(b[0][0] < 5) for b in bags])
    got = toxicity.train(bags, y, 10, 20, 2, 3.0)
    g = np.random.default_rng(toxicity.SEED)
    par = [g.standard_normal((50, toxicity.DIMENSIONS)) * 0.01, g.standard_normal((toxicity.DIMENSIONS, 2)) * 0.1, np.zeros(2)]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in par]
    step = 0
    for _ in range(2):
        order = g.permutation(90)
        for k in range(0, 90, toxicity.BATCH):
            some, grads = order[k : k + toxicity.BATCH], [np.zeros_like(p) for p in par]
            for t in some:
                mean = sum(3.0 * s * par[0][b] for b, s in zip(*bags[t], strict=True))
                z = mean @ par[1] + par[2]
                d = np.exp(z) / np.exp(z).sum() - np.eye(2)[y[t]]
                d *= 0.5 / (y == y[t]).mean() / len(some)
                for b, s in zip(*bags[t], strict=True):
                    grads[0][b] += 3.0 * s * (par[1] @ d)
                grads[1] += np.outer(mean, d)
                grads[2] += d
            step += 1
            for p, d, (m, v) in zip(par, grads, state, strict=True):
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                p -= toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + toxicity.SOFT)
    assert np.allclose(got.vectors, par[0] * 3.0, atol=1e-3) and np.allclose(got.softmax, par[1], atol=1e-3)
    assert np.allclose(got.bias, par[2] + [0, np.log(11 / 21)], atol=1e-3)
    text = "one two two three " * 30
    lean = got.vectors @ (got.softmax[:, 1] - got.softmax[:, 0])
    words = [toxicity.grams(w) for w in text.split()]
    best = max(np.mean([lean[b] for w in words[k : k + toxicity.WINDOW] for b in w]) for k in range(0, len(words) - toxicity.WINDOW // 2, toxicity.WINDOW // 2))
    want = 1 / (1 + np.exp(-(best + got.bias[1] - got.bias[0])))
    assert abs(toxicity.Scorer(got)([text])[0][0] - want) < 1e-6


def test_toxicity_of_odd_rows_without_labels(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(*toxicity.training_rows(docs, empty))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(none, model).count() == 0


URLS = {
    None: ("", "", None), "": ("", "", None), "mailto:x": ("", "", None), "http://EX.com": ("ex.com", "", None), "http://EX.com/": ("ex.com", "/", "com/"),
    "x://a.net/es/y?q#f": ("a.net", "/es/y", "net/es/"), "http://net/fr/": ("net", "/fr/", "net/fr/"), "http://internet/fr/": ("internet", "/fr/", None),
    "http://example.com/en/1": ("example.com", "/en/1", "example.com/en/"), "http://WWW.example.com/en/?": ("www.example.com", "/en/", "www.example.com/en/"),
    "http://a.www.example.com/en/#x://y": ("a.www.example.com", "/en/", "www.example.com/en/"), "http://b.example.com/EN/": ("b.example.com", "/EN/", "com/"), "a://b?c://d/e": ("b", "", None), "http://É.com/": ("É.com", "/", "com/"),
}


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(k, u, 1) for k, u in enumerate(URLS)], "page_id long, url string, host int")
    rows = sorted(urls.judge(df, model=urls.Trees()).collect())
    assert [(r.host, r.path, r.rule) for r in rows] == list(URLS.values())
    verdict = {h + p: v for v, h, p in urls.RULES}
    assert all(r.verdict == verdict.get(r.rule, "allow") for r in rows)
    assert urls.judge(df.limit(0)).count() == 0


def test_a_tree_equals_an_exhaustive_search():
    """Every split of every node, tried one by one over the rows."""
    r = np.random.default_rng(3)
    binned = r.integers(0, 6, (120, 3))
    g, h = r.standard_normal(120), r.uniform(0.1, 0.3, 120)
    feature, cut, leaf = urls._grow(binned, g, h)

    def leaves(rows, depth, node):
        if depth == urls.DEPTH:
            want = -urls.RATE * sum(g[k] for k in rows) / (sum(h[k] for k in rows) + urls.PENALTY)
            assert abs(leaf[node - (2**urls.DEPTH - 1)] - want) < 1e-9
            return
        value = lambda some: sum(g[k] for k in some) ** 2 / (sum(h[k] for k in some) + urls.PENALTY)
        best, split = 1e-9, (rows, [])
        for f in range(3):
            for c in range(6):
                low, high = [k for k in rows if binned[k, f] <= c], [k for k in rows if binned[k, f] > c]
                if min(len(low), len(high)) >= urls.SMALLEST and value(low) + value(high) - value(rows) > best + 1e-12:
                    best, split = value(low) + value(high) - value(rows), (low, high)
        assert [k for k in rows if binned[k, feature[node]] <= cut[node]] == split[0]
        for side, some in enumerate(split):
            leaves(some, depth + 1, 2 * node + 1 + side)

    leaves(list(range(120)), 0, 0)


def test_query_equals_a_plain_version(spark):
    """Hosts, paths and rules by string methods; verdicts where no rule fits by walking each tree."""
    folder = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    model = urls.train(pages.select("url"))

    def judged(url):
        _, found, rest = (url or "").partition("://")
        rest = (rest if found else "").partition("#")[0].partition("?")[0]
        host, slash, path = rest.partition("/")
        host, path = "".join(c.lower() if c.isascii() else c for c in host), slash + path
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return host, path, *max(fits)[1:]
        x, margin = model.matrix([urls.lexical(url)])[0], model.prior
        for feature, cut, leaf in model.trees:
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (sum(e < x[feature[node]] for e in model.edges[feature[node]]) > cut[node])
            margin += leaf[node - len(feature)]
        return host, path, None, "block" if margin >= 0 else "allow"

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.query(spark, folder).collect()}
    assert got == {r.page_id: judged(r.url) for r in pages.collect()}


def test_trees_learn_and_repeat(spark):
    r = random.Random(2)
    rows = [urls.lexical(f"https://h{r.randrange(99)}.org/{'9' * r.randrange(1, 12)}?{'a=1&' * r.randrange(6)}") for _ in range(800)]
    y = np.array([v[4] > 0.25 and v[6] > 2 for v, *_ in rows])
    model = urls.fit(rows[:600], y[:600])
    assert ((model.margin(rows[600:]) > 0) == y[600:]).mean() > 0.95
    assert (model.margin(rows) == urls.fit(rows[:600], y[:600]).margin(rows)).all()
    assert urls.fit(rows, np.zeros(800, bool)).margin(rows).max() < 0
    with pytest.raises(ValueError):
        urls.lexical("x")[0].remove(None)


def test_a_bag_is_that_of_all_words():
    words = ["one", "two", "one", "three"] * 50
    ids, share = toxicity.bag(words, {})
    n = np.bincount([b for w in words for b in toxicity.grams(w)])
    assert ids.tolist() == np.flatnonzero(n).tolist() and np.array_equal(share, (n[ids] / n.sum()).astype(np.float32))
    assert [len(x) for x in toxicity.bag([], {})] == [0, 0]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the driver's tables are not here")
def test_url_trees_learn_what_rules_say(spark):
    """On labelled URLs of folds that training never saw, the trees beat the more frequent verdict."""
    rows = urls.labelled(spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url"))
    y, x = np.array([r[0] == "block" for r in rows]), [(list(v), *suffixes) for _, v, suffixes in rows]
    fold = np.random.default_rng(0).integers(0, 5, len(x))
    right = 0
    for k in range(5):
        model = urls.fit([r for r, f in zip(x, fold, strict=True) if f != k], y[fold != k])
        right += ((model.margin([r for r, f in zip(x, fold, strict=True) if f == k]) > 0) == y[fold == k]).sum()
    constant = max(y.mean(), 1 - y.mean())
    print(right / len(y), constant)
    assert right / len(y) > constant + 0.1


def test_suffix_statistics_leave_the_own_fold_out():
    names, blocked, fold = ["a", "a", "a", "b", "b"], np.array([1, 0, 1, 1, 0]), np.array([0, 1, 0, 2, 3])
    got = urls.statistics(names, blocked, 0.5, fold)
    for k, name in enumerate(names):
        others = [b for n, b, f in zip(names, blocked, fold, strict=True) if n == name and f != fold[k]]
        assert np.allclose(got[k], [(sum(others) + 5) / (len(others) + 10), np.log1p(len(others))])
    assert urls.lexical("https://A.b.Com/x/en/1.html?q=1")[1:] == ("com", "b.com", "a.b.com", "html", "en")
    assert urls.lexical(None)[1:] == ("", "", "", "", "")
