"""The pipeline against plain loops: each stage by comparing everything with everything."""

import hashlib
import itertools
import math
import os
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tracewell.llm import bpe, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, kept boolean, size long"


def rejected(text):
    words = WORD.findall(text)
    n = len(words)
    windows = [tuple(words[k : k + 3]) for k in range(n - 2)]
    repeated = len({k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)})
    lines = [x for x in text.split("\n") if WORD.search(x)]
    chars = sum(map(len, words))
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return n < 50 or 100 * repeated > 50 * n or chars < 2 * n or chars > 25 * n or 100 * symbols > 30 * n or 100 * (len(lines) - len(set(lines))) > 60 * len(lines)


def apart(a, b):
    """Edit distance over words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def without_repeats(docs):
    """Lines that equal an earlier one, or whose words are one edit from an earlier one's (both of 8 words or more), go."""
    seen, out = [], []
    for d in sorted(docs):
        kept, cut = [], False
        for line in d[1].split("\n"):
            w = [x.lower() for x in WORD.findall(line)]
            again = bool(w) and any(w == s or len(w) >= 8 and len(s) >= 8 and abs(len(w) - len(s)) < 2 and apart(w, s) == 1 for s in seen)
            if w:
                seen.append(w)
            cut |= again
            if not again:
                kept.append(line)
        text = "\n".join(kept)
        if not cut or WORD.search(text):
            out.append((d[0], text, *d[2:]))
    return out


def one_of_each(docs):
    """The least id of each group of documents linked by 80 % of their five-word shingles."""
    sets = []
    for d in docs:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(d[1])]
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    group = list(range(len(docs)))
    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            old, new = group[i], group[j]
            group = [new if g == old else g for g in group]
    return [d for k, d in enumerate(docs) if d[0] == min(docs[j][0] for j in range(len(docs)) if group[j] == group[k])]


def mixed(docs):
    """Blocks of a source's one tape of words, from a seeded block on; every source here is one shard."""

    def seeded(*parts):
        return int(hashlib.md5(":".join([mixing.SEED, *map(str, parts)]).encode()).hexdigest()[:8], 16)

    sources = sorted({d[3] for d in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(WORD.findall(d[1])) for d in docs if d[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    total, full = sum(size.values()), set()
    while True:
        free = [s for s in sources if s not in full]
        rest = 1.5 * total - sum(2 * size[s] for s in full)
        target = {s: 2 * size[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in sources}
        if not (over := [s for s in free if target[s] > 2 * size[s]]):
            break
        full |= set(over)
    quotients = sorted(((-target[s] / (2 * k + 1), n, s) for n, s in enumerate(sources) for k in range(int(target[s] / 32) + len(sources) + 3)), key=lambda x: x[:2])
    blocks = [s for _, _, s in quotients[: math.floor(1.5 * total / 32 + 0.5)]]
    out = []
    for n, s in enumerate(sources):
        own = sorted((d for d in docs if d[3] == s), key=lambda d: (seeded("order", d[0]), d[0]))
        tape = [(d[0], k) for d in own for k in range(len(WORD.findall(d[1])))]
        take = min(32 * blocks.count(s), 2 * len(tape))
        begin = 32 * (seeded("begin", n, 0) % math.ceil(len(tape) / 32))
        laps, run = divmod(take, len(tape))
        spots = set((begin + k) % len(tape) for k in range(run))
        for d in own:
            words = WORD.findall(d[1])
            at = next(k for k, t in enumerate(tape) if t == (d[0], 0))
            got, parts = [k for k in range(len(words)) if at + k in spots], [d[1]] * laps
            # the stretch from the seeded place on comes before the one that wraps round
            for stretch in ([k for k in got if at + k >= begin], [k for k in got if at + k < begin]):
                if stretch:
                    parts.append(d[1] if len(stretch) == len(words) else " ".join(words[stretch[0] : stretch[-1] + 1]))
            if parts:
                out.append((d[0], "\n".join(parts), *d[2:]))
    return out


def made(seed=1):
    r = random.Random(seed)
    line = lambda n=12: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    rows, shared = [], [line() for _ in range(4)]
    for k in range(48):
        text = "\n".join([line(r.randrange(6, 16)) for _ in range(r.randrange(2, 14))] + r.sample(shared, r.randrange(3)))
        if k % 6 == 1:
            words = rows[-1][1].split(" ")
            words[r.randrange(len(words))] = "changed"
            text = " ".join(words)
        rows.append((k, text, "en", f"s{r.randrange(4)}" if k % 9 else None, len(text), 1, True, 7))
    rows += [(100, "$ # % " * 40, "en", "s1", 1, 1, True, 7), (101, "x " * 80, "en", "s1", 1, 1, True, 7), (102, "", "en", "s1", 0, 1, True, 7), (103, line(120).upper(), "en", "s2", 1, 1, True, 7)]
    return rows


def run(spark, tmp_path, rows):
    os.makedirs(tmp_path, exist_ok=True)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return corpus_pipeline.run(spark, str(tmp_path)).collect()


def test_pipeline_equals_plain_loops(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = made()
    kept = [d for d in rows if not rejected(d[1])]
    once = one_of_each(without_repeats(kept))
    want = mixed(once)
    assert len(rows) > len(kept) > len(once) > 10
    library = Tokenizer.from_file(bpe.default_vocabulary())
    library.no_truncation()
    library.no_padding()
    expected = set()
    for d in want:
        ids = library.encode(d[1], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.add((d[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = run(spark, tmp_path / "a", rows)
    assert {tuple(r)[:4] for r in got} == expected


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None, None, None)], [(1, None, "en", None, 0, 1, True, 7), (1, None, "en", None, 0, 1, True, 7)]])
def test_pipeline_of_nothing(spark, tmp_path, rows):
    """Empty tables, nulls everywhere and repeated rows have a result: all are rejected for having no words."""
    assert run(spark, tmp_path / "b", rows) == []
