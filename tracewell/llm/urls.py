"""URL filters: host and path rules, then gradient-boosted trees on lexical features for what no rule fits.

The trees learn from URLs that rules label: at most SAMPLE of each verdict, the first by a hash. They see length, depth,
digit ratio, entropy, parameter counts, and statistics of suffixes at several levels: of the host its last label, its last two
labels and the whole, of the path its extension and its last directory. A suffix's statistics are the smoothed rate of blocks and the count of
the sample's URLs that have it; for a URL of the sample, of those in the other FOLDS - 1 folds, so that no label speaks for itself.
Boosting is histogram-based, in numpy. A URL that a rule fits takes the verdict of the longest such rule, any other that of the trees.

Defined results: null, or no "://": host and path are empty and no rule fits; the trees judge it like any other text.
Repeated rows get equal verdicts. Where the sample has one verdict only, or none, the trees allow. An empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Verdict, host and path of each rule.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Labelled URLs of each verdict that training reads at most.
SAMPLE = 10_000
#: Folds of the sample, by place in its order.
FOLDS = 5
TREES, DEPTH, BINS, RATE, PENALTY, SMALLEST = 40, 3, 32, 0.2, 1.0, 5
FEATURES = ["length", "host_length", "host_labels", "depth", "digit_ratio", "entropy", "parameters", "parameter_length", "hyphens", "fragment"]
SUFFIXES = ["last_label", "last_two_labels", "host", "extension", "last_directory"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null where none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def lexical(url: str | None) -> tuple:
    """Features of a URL, and its SUFFIXES."""
    u = url or ""
    _, found, rest = u.partition("://")
    rest = rest if found else ""
    main, _, fragment = rest.partition("#")
    main, _, query = main.partition("?")
    host, _, path = main.partition("/")
    n = len(u)
    counts = Counter(u)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
    digits = sum(map(u.count, "0123456789")) / n if n else 0.0
    directory, _, last = path.rpartition("/")
    labels = host.lower().split(".")
    values = [n, len(host), host.count(".") + bool(host), path.count("/") + bool(path), digits, entropy, query.count("&") + bool(query), len(query), u.count("-"), bool(fragment)]
    extension = last.rpartition(".")[2].lower() if "." in last else ""
    return list(map(float, values)), labels[-1], ".".join(labels[-2:]), ".".join(labels), extension, directory.rpartition("/")[2]


@dataclass
class Trees:
    """Boosted trees. suffixes: per kind, suffix -> (smoothed rate of blocks, log of its count) in the sample."""

    prior: float = -30.0
    suffixes: list[dict[str, tuple[float, float]]] = field(default_factory=lambda: [{} for _ in SUFFIXES])
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def matrix(self, rows: list[tuple]) -> np.ndarray:
        nothing = (1 / (1 + math.exp(-self.prior)), 0.0)
        return np.array([r[0] + [x for s, known in zip(r[1:], self.suffixes, strict=True) for x in known.get(s, nothing)] for r in rows]).reshape(len(rows), len(FEATURES) + 2 * len(SUFFIXES))

    def margin(self, rows: list[tuple]) -> np.ndarray:
        out = np.full(len(rows), self.prior)
        if not self.trees or not rows:
            return out
        x = self.matrix(rows)
        binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], 1)
        for feature, cut, leaf in self.trees:
            out += leaf[_descend(binned, feature, cut)]
        return out


def _descend(binned: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    node = np.zeros(len(binned), np.int64)
    for _ in range(DEPTH):
        node = 2 * node + 1 + (binned[np.arange(len(binned)), feature[node]] > cut[node])
    return node - (2**DEPTH - 1)


def statistics(suffixes: list[str], blocked: np.ndarray, rate: float, fold: np.ndarray | None = None) -> np.ndarray:
    """Per row, the smoothed rate of blocks and the log of the count of its suffix; with folds, without the row's own fold."""
    at = np.unique(suffixes, return_inverse=True)[1]
    n, bad = np.bincount(at), np.bincount(at, blocked)
    here, hit = n[at].astype(float), bad[at]
    if fold is not None:
        own = at * FOLDS + fold
        here, hit = here - np.bincount(own)[own], hit - np.bincount(own, blocked)[own]
    return np.stack([(hit + 10 * rate) / (here + 10), np.log1p(here)], 1)


def fit(rows: list[tuple], blocked: np.ndarray) -> Trees:
    if not 0 < blocked.sum() < len(blocked):
        return Trees()
    rate = float(blocked.mean())
    model = Trees(prior=math.log(rate / (1 - rate)))
    fold, columns = np.arange(len(rows)) % FOLDS, [np.array([r[0] for r in rows])]
    for k in range(len(SUFFIXES)):
        names = [r[k + 1] for r in rows]
        model.suffixes[k] = dict(zip(names, map(tuple, statistics(names, blocked, rate).tolist()), strict=True))
        columns.append(statistics(names, blocked, rate, fold))
    x = np.concatenate(columns, 1)
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(model.edges)], 1)
    margin, y = np.full(len(x), model.prior), blocked.astype(float)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(binned, p - y, p * (1 - p))
        model.trees.append(tree)
        margin += tree[2][_descend(binned, tree[0], tree[1])]
    return model


def _grow(binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inner = 2**DEPTH - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS + 1, np.int64)  # a cut above all bins: go left
    node = np.zeros(len(binned), np.int64)
    for level in range(DEPTH):
        lo = 2**level - 1
        for k in range(lo, 2 * lo + 1):
            at = np.flatnonzero(node == k)
            if len(at) < 2 * SMALLEST:
                continue
            best, total_g, total_h = 1e-9, g[at].sum(), h[at].sum()
            base = total_g**2 / (total_h + PENALTY)
            for f in range(binned.shape[1]):
                b = binned[at, f]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, BINS + 1))[:-1] for w in (g[at], h[at], None))
                gain = gs**2 / (hs + PENALTY) + (total_g - gs) ** 2 / (total_h - hs + PENALTY) - base
                gain[(ns < SMALLEST) | (len(at) - ns < SMALLEST)] = 0
                j = int(np.argmax(gain))
                if gain[j] > best:
                    best, feature[k], cut[k] = gain[j], f, j
        node = 2 * node + 1 + (binned[np.arange(len(binned)), feature[node]] > cut[node])
    leaf = node - inner
    gs, hs = np.bincount(leaf, g, 2**DEPTH), np.bincount(leaf, h, 2**DEPTH)
    return feature, cut, -RATE * gs / (hs + PENALTY)


def labelled(urls: DataFrame) -> list:
    """The bounded sample: features and verdicts of URLs that rules fit."""
    known = urls.select("url", ruled(host_of(F.col("url")), path_of(F.col("url")))["verdict"].alias("verdict")).where(F.col("verdict").isNotNull())
    parts = [known.where(F.col("verdict") == v).orderBy(F.xxhash64("url"), "url").limit(SAMPLE) for v in ("allow", "block")]
    schema = StructType.fromDDL("verdict string, values array<double>, suffixes array<string>")

    def run(batches):
        for b in batches:
            made = [lexical(u) for u in b.column(0).to_pylist()]
            cols = [b.column(1).to_pylist(), [m[0] for m in made], [m[1:] for m in made]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.list_(pa.float64()), pa.list_(pa.string())), strict=True)], names=schema.names)

    return sorted((tuple(r) for r in parts[0].unionByName(parts[1]).mapInArrow(run, schema).collect()), key=repr)


def train(urls: DataFrame) -> Trees:
    rows = labelled(urls)
    return fit([(list(v), *suffixes) for _, v, suffixes in rows], np.array([r[0] == "block" for r in rows]))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", model: Trees | None = None) -> DataFrame:
    """key, host, path, rule, verdict and the trees' score of every row."""
    plain = pages.select(F.col(key), F.col(url).cast("string").alias("url"))
    model = model or train(plain.select("url"))
    shared = pages.sparkSession.sparkContext.broadcast(model)  # at most 2 * SAMPLE suffixes of each kind, and TREES trees

    def score(batches):
        for b in batches:
            p = 1 / (1 + np.exp(-shared.value.margin([lexical(u) for u in b.column(1).to_pylist()])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, "score"])

    scored = plain.mapInArrow(score, StructType([*plain.schema.fields, *StructType.fromDDL("score double").fields]))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    out = scored.select(key, "score", host.alias("host"), path.alias("path"))
    fit_rule = ruled(F.col("host"), F.col("path"))
    verdict = F.coalesce(fit_rule["verdict"], F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(key, "host", "path", fit_rule["rule"].alias("rule"), verdict.alias("verdict"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
