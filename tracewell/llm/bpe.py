"""Byte-pair encoding and decoding with a pair occurrence index.

The distinct units of a group of texts are laid out as one array of symbols. An index maps each mergeable pair to all
its places in that array. Ranks are applied in ascending order: the lowest active rank is merged at all its places at
once, and the lists of the pairs left and right of each place are updated. A vocabulary file in the format of the
tokenizers library is a parameter; it is read, never trained.

Defined results: a null text encodes as empty (no ids, empty decoded text). Strings of the vocabulary's special tokens
become their ids, as in the tokenizers library. Ids that are not in the vocabulary decode to nothing. Equal texts give
equal ids; repeated rows stay.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunks
from .common import text_map

#: Fixed value: how byte-level vocabularies of this family split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


UNITS = regex.compile(PATTERN)
#: Pairs whose ranks are looked up at once.
PAIRS = 1 << 17
#: The first code point whose class depends on the version of Unicode.
NEWER = "\u0558"


@functools.cache
def exact_units(path: str) -> regex.Pattern:
    """PATTERN with the letters and numbers of the Unicode version that the tokenizers library has. Code points that the
    regex module counts as such, but Python's own tables do not know, are looked up in that library."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    every = "".join(map(chr, (c for c in range(ord(NEWER), 0x110000) if not 0xD800 <= c < 0xE000)))
    classes = {}
    for kind, beside in (("L", "a"), ("N", "1")):
        new = [c for c in regex.findall(rf"\p{{{kind}}}", every) if unicodedata.category(c) == "Cn"]
        starts = {a for _, (a, _) in split("\n".join(beside + c + beside for c in new))}
        other = "".join(f"\\U{ord(c):08x}" for k, c in enumerate(new) if {4 * k + 1, 4 * k + 2} & starts)
        classes[kind] = rf"[\p{{{kind}}}--[{other}]]" if other else rf"\p{{{kind}}}"
    neither = rf"[^\s{classes['L']}{classes['N']}]"
    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{classes['L']}+| ?{classes['N']}+| ?{neither}+|\s+(?!\S)|\s+", regex.V1)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[int, str]:
    """Byte -> the printable character that stands for it in vocabulary files: itself if printable, else from U+0100 on."""
    shown = {b for a, z in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(a, z + 1)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Vocabulary:
    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        of_byte = byte_alphabet()
        to_byte = {c: b for b, c in of_byte.items()}
        self.size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.byte_ids = np.array([ids[of_byte[b]] for b in range(256)], np.int32)
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges], np.int32) for k in (0, 1))
        key = left.astype(np.int64) * self.size + right
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        self.left, self.right = left, right
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)
        self.bytes_of = [b""] * self.size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.chunks = Chunks(self.encode_chunks, self.encode_whole)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; -1 where it has none."""
        out = np.empty(len(a), np.int32)
        for k in range(0, len(a), PAIRS):
            key = a[k : k + PAIRS].astype(np.int64) * self.size + b[k : k + PAIRS]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[k : k + PAIRS] = np.where(self.keys[at] == key, self.order[at], -1)
        return out

    def split(self, text: str) -> list:
        """Units of a text: strings, and the ids of special tokens as ints."""
        units = UNITS if not text or max(text) < NEWER else exact_units(self.path)
        if self.split_special is None or not self.split_special.search(text):
            return units.findall(text)
        out: list = []
        at = 0
        for m in self.split_special.finditer(text):
            out += units.findall(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + units.findall(text[at:])

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        places: dict = {}
        plans: list = []  # the place of a chunk's unit, or those of its units
        for c in chunks:
            p = [places.setdefault(u, len(places)) for u in self.split(c)]
            plans.append(p[0] if len(p) == 1 else p)
        ids, cuts = self.merge_units(list(places))
        del places
        raw = ids.astype("<u4").tobytes()
        cut = (cuts * 4).tolist()
        part = [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        return [part[p] if isinstance(p, int) else b"".join([part[i] for i in p]) for p in plans]

    def encode_whole(self, text: str) -> bytes:
        return self.encode_chunks([text])[0]

    def merge_units(self, units: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and where each unit begins (and the last ends)."""
        if not units:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        raw = [b"\0" if isinstance(u, int) else u.encode("utf-8", "surrogatepass") for u in units]
        size = np.array([len(r) for r in raw], np.int64)
        start = np.concatenate([[0], np.cumsum(size)])
        sym = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        del raw
        for k, u in enumerate(units):
            if isinstance(u, int):
                sym[start[k]] = u
        n = len(sym)
        follow, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)  # -1: none
        follow[start[1:] - 1] = -1
        before[start[:-1]] = -1
        live = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            """Enters the pairs that begin at the places at."""
            at = at[follow[at] >= 0]
            rank = self.ranks(sym[at], sym[follow[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            both = np.sort(rank.astype(np.int64) << 32 | at)  # by rank, then by place
            at, rank = both.astype(np.int32), both >> 32
            bound = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, group in zip(rank[np.concatenate([[0], bound])].tolist(), np.split(at, bound), strict=True):
                if r in index:
                    index[r].append(group)
                else:
                    index[r] = [group]
                    heapq.heappush(active, r)

        add(np.arange(n, dtype=np.int32))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            at = at[live[at] & (sym[at] == a)]
            at = at[follow[at] >= 0]
            at = at[sym[follow[at]] == b]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # in a run of one symbol, every second place, from the left
                at = np.sort(at)
                fresh = np.concatenate([[True], follow[at[:-1]] != at[1:]])
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = follow[at]
            sym[at] = self.merged[r]
            live[gone] = False
            after = follow[gone]
            follow[at] = after
            inner = after >= 0
            before[after[inner]] = at[inner]
            earlier = before[at]
            add(np.unique(np.concatenate([earlier[earlier >= 0], at])))
        return sym[live], np.concatenate([[0], np.cumsum(live)])[start]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return list(self.chunks.encode(texts))

    def decode(self, ids: bytes) -> str:
        table, n = self.bytes_of, self.size
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) and numbers.max() >= n:
            numbers = numbers[numbers < n]
        return b"".join(map(table.__getitem__, numbers.tolist())).decode("utf-8", "replace")


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """key (and the columns carried), n_tokens, and ids: 32-bit little-endian integers in a binary column."""
    path = path or default_vocabulary()

    def make():
        v = vocabulary(path)

        def apply(texts):
            return ((len(i) // 4, i) for i in v.chunks.encode([t or "" for t in texts]))

        apply.close = v.chunks.forget
        return apply

    return text_map(docs, [key, *(carry or [])], text, "n_tokens long, ids binary", make, rows=ROWS)


def encode_decode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """encode(), and in the column decoded the text that the ids decode to."""
    path = path or default_vocabulary()

    def make():
        v = vocabulary(path)

        def apply(texts):
            return ((len(i) // 4, i, v.decode(i)) for i in v.chunks.encode([t or "" for t in texts]))

        apply.close = v.chunks.forget
        return apply

    return text_map(docs, [key], text, "n_tokens long, ids binary, decoded string", make, rows=ROWS)


#: Rows whose texts are encoded together at most.
ROWS = 1024


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    return encoded.select(key, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
