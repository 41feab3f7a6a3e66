"""Repeated paragraphs, lines and passages against brute force over every unit."""

import random
import re

from tracewell.llm import substrings

from .conftest import ROWS

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(rows):
    """Per row (id, text), the spans to remove, by comparing every unit as a text."""
    seen, out = {}, {}
    for k, t in sorted(set(rows), key=lambda r: (r[0], version(r[1]))):
        words = [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(t)]
        found = []
        for kind, a, b in substrings.blocks(t):
            found.append((kind, [w for w in words if a <= w[1] and w[2] <= b], substrings.LINE_WORDS if kind else 1))
        found += [(2, words[i : i + substrings.WINDOW], 1) for i in range(len(words) - substrings.WINDOW + 1)]
        cuts = []
        for kind, ws, least in sorted(found, key=lambda f: f[1][0][1] if f[1] else 0):
            if len(ws) >= least:
                unit = (kind, *[w for w, _, _ in ws])
                if unit in seen:
                    cuts.append((ws[0][1], ws[-1][2]))
                seen.setdefault(unit, k)
        merged = []
        for a, b in sorted(cuts):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        out[k, t] = merged
    return out


def version(text):
    import xxhash

    v = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return v - 2**64 if v >= 2**63 else v


def found(spark, rows):
    by = {(k, version(t)): [] for k, t in rows}
    for r in substrings.spans(spark.createDataFrame(rows, SCHEMA)).collect():
        by[r.id, r.v].append((r.start, r.stop))
    return {(k, t): sorted(by[k, version(t)]) for k, t in rows}


def test_spans_equal_brute_force(spark):
    r = random.Random(3)
    text = lambda n: [f"w{r.randrange(3000)}" + r.choice(["", "", "", ".", "!\n", "\n \n"]) for _ in range(n)]
    base = [text(r.randrange(20, 120)) for _ in range(8)]
    rows = []
    for k in range(60):
        b = r.choice(base)
        i = r.randrange(len(b) // 2)
        rows.append((k, " ".join(text(r.randrange(60)) + b[i : i + r.randrange(10, 120)] + text(r.randrange(60)))))
    rows += [(100, "a b " * 80), (101, "B a " * 80), (102, ""), (103, " \n"), (104, "One."), (105, "one.\n\ntwo"), (5, rows[7][1]), (5, rows[5][1])]
    got = found(spark, rows)
    assert got == slow(rows) and any(got.values())


def test_unique_lines_between_repeats_stay(spark):
    para = " ".join(f"p{n}" for n in range(25))
    rows = [(1, "A.\nB."), (2, "A.\nUnique secret here.\nB."), (3, para + "\n\nend three"), (4, "start four\n\n" + para), (5, "start five\n" + para)]
    texts = {r.doc_id: r.text for r in substrings.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert texts == {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 4: "start four\n\n", 5: "start five\n"}


def test_texts_that_share_an_id(spark):
    long = [" ".join(f"{c}{n}" for n in range(60)) for c in "abc"]
    rows = [(1, long[0]), (1, long[1]), (1, long[1]), (2, long[1] + "\nof two"), (2, long[2])]
    got = sorted((r.doc_id, r.text) for r in substrings.dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted([*rows[:3], (2, "\nof two"), (2, long[2])])


def test_passage_cut_in_mid_sentence(spark):
    words = [f"p{n}" for n in range(55)]
    rows = [(1, "one start " + " ".join(words) + " one end."), (2, "Another beginning " + " ".join(words) + " other end.")]
    texts = {r.doc_id: r.text for r in substrings.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert texts == {1: rows[0][1], 2: "Another beginning  other end."}


def test_odd_rows_and_clashing_names(spark, docs, none):
    assert substrings.spans(none).count() == 0 and substrings.dedup(none).count() == 0
    assert substrings.spans(spark.createDataFrame([(None, "x " * 60), (1, None)], SCHEMA)).count() == 0
    clash = docs.selectExpr("*", "1 AS _id", "2 AS _v", "3 AS _cuts", "4 AS id", "5 AS v")
    out = substrings.dedup(clash)
    assert out.columns == clash.columns and out.count() == len(ROWS)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[3] is None and texts[4] == "" and all(texts[k] == t for k, t, *_ in ROWS if k in (1, 2, 5, 7, 8, None))


def test_least_words_of_a_line_is_a_parameter(spark, monkeypatch):
    """With 1, every repeated line goes, however short and wherever it stands."""
    rows = [(1, "short line\nown words of one\nlast"), (2, "other words\nShort  line\nmore"), (3, "short line"), (4, "last\n\nx")]
    got = {(r.id, r.start, r.stop) for r in substrings.spans(spark.createDataFrame(rows, SCHEMA), line_words=1).collect()}
    monkeypatch.setattr(substrings, "LINE_WORDS", 1)
    assert got == {(k, a, b) for (k, _), cuts in slow(rows).items() for a, b in cuts} == {(2, 12, 23), (3, 0, 10), (4, 0, 4)}
    assert {r.doc_id: r.text for r in substrings.dedup(spark.createDataFrame(rows, SCHEMA), line_words=1).collect()}[2] == "other words\n\nmore"
