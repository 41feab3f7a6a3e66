"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document; the ledger keeps the measurements and one failure bit per rule. A policy is a
versioned mask of the rules that reject. Policies, and ablations of one rule at a time, are then bitwise operations on
the ledger; no text is read again.

Defined results: a null text counts as empty (no words, bit 0 set). Rows repeat as they come; ties do not arise, since
each row is judged alone. An empty table gives an empty ledger.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, SLICE, mapped, text_map

SYMBOLS = "#*$%&|<>"
#: Rule names; the place in the list is the bit.
RULES = ["few_words", "repeated_windows", "many_words", "short_words", "long_words", "symbols", "repeated_lines"]
#: Versioned policies: the rules that reject a document.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "many_words", "short_words", "long_words", "symbols", "repeated_lines"],
    #: v1 for corpora whose long documents are to stay, whatever their length.
    "v2": ["few_words", "repeated_windows", "short_words", "long_words", "symbols", "repeated_lines"],
}
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
MAX_WORDS = 10_000_000
#: Bounds as whole per cents or whole characters, so that every engine compares integers.
SYMBOL_PERCENT, LINE_PERCENT, SHORTEST_MEAN, LONGEST_MEAN = 30, 60, 2, 25


def mask_of(policy: str) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


def repeated_words(words: list) -> int:
    """Words that lie in a window of three words found twice or more in the list."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict = {}
    a = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    size = len(seen)
    if size == n:
        return 0
    pair = a[:-1] * size + a[1:]
    if size > 2_000_000:  # else the product of three stays below 2**63
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * size + a[2:]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, twice)
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= hit
    return int(cover.sum())


def measure(text: str | None) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() splits at SEPARATORS only
    lines = [x for x in text.split("\n") if x.strip(SEPARATORS)]
    return (
        len(words),
        len(text) - sum(map(text.count, SEPARATORS)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def failures() -> Column:
    """The bitmask of failed rules, from the measurements."""
    n = F.col("n_words")
    failed = [
        n < 50,
        100 * F.col("n_repeat_words") > 50 * n,
        n > MAX_WORDS,
        F.col("word_chars") < SHORTEST_MEAN * n,
        F.col("word_chars") > LONGEST_MEAN * n,
        100 * F.col("n_symbols") > SYMBOL_PERCENT * n,
        100 * F.col("n_dup_lines") > LINE_PERCENT * F.col("n_lines"),
    ]
    out = F.lit(0).cast("long")
    for bit, c in enumerate(failed):
        out = out.bitwiseOR(F.when(c, F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return out


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """key (and the columns carried), the measurements and fail_mask of every row."""
    return text_map(docs, [key, *(carry or [])], text, MEASURES, lambda: lambda texts: [measure(t) for t in texts]).withColumn("fail_mask", failures())


def apply_policy(led: DataFrame, policy: str = "v1") -> DataFrame:
    base, full = mask_of("base"), mask_of(policy) | mask_of("base")
    hit = lambda m: F.col("fail_mask").bitwiseAND(F.lit(m).cast("long")) != 0
    return led.withColumn("base_failed", hit(base)).withColumn("kept", ~hit(full))


def ablations(led: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: rows that fail it, rows that fail no other rule (which dropping the rule would keep), and
    all rows the policy rejects. The ledger is first counted by mask, of which there are at most 2**rules."""
    by_mask = led.groupBy("fail_mask").agg(F.count(F.lit(1)).alias("n"))
    full = mask_of(policy)
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    hit = F.col("fail_mask").bitwiseAND(F.lit(full).cast("long"))
    rows = by_mask.select("n", hit.alias("hit"), F.explode(rules).alias("r"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        total(F.col("hit").bitwiseAND(F.col("r.bit")) != 0).alias("failed"),
        total(F.col("hit") == F.col("r.bit")).alias("failed_alone"),
        total(F.col("hit") != 0).alias("rejected"),
    )


def keep(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The rows of docs that the policy accepts, with the columns of docs."""
    full = mask_of(policy) | mask_of("base")
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                part = b.slice(k, SLICE)
                yield part.filter(pa.array([not failed_bits(measure(t)) & full for t in part.column(at).to_pylist()], pa.bool_()))

    return mapped(docs, run, docs.schema)


def failed_bits(m: tuple) -> int:
    """failures() of one tuple of measurements."""
    n, chars, symbols, lines, dup, rep = m
    failed = [n < 50, 100 * rep > 50 * n, n > MAX_WORDS, chars < SHORTEST_MEAN * n, chars > LONGEST_MEAN * n, 100 * symbols > SYMBOL_PERCENT * n, 100 * dup > LINE_PERCENT * lines]
    return sum(1 << k for k, f in enumerate(failed) if f)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_policy(ledger(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_mask", "n_lines")


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM p),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM h WHERE n >= 2) GROUP BY 1),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (n_words > {MAX_WORDS})::BIGINT
             + 8 * (word_chars < {SHORTEST_MEAN} * n_words)::BIGINT + 16 * (word_chars > {LONGEST_MEAN} * n_words)::BIGINT
             + 32 * (100 * n_symbols > {SYMBOL_PERCENT} * n_words)::BIGINT + 64 * (100 * n_dup_lines > {LINE_PERCENT} * n_lines)::BIGINT) AS fail_mask FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_mask & 3) <> 0 AS base_failed, fail_mask = 0 AS kept, fail_mask, n_lines FROM f
"""
