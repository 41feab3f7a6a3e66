"""Encoding by cached chunks: byte-level BPE never merges across the start of a word.

The split pattern of the byte-level tokenizers starts a new unit before a space that other text precedes and a character
that is no white space follows. So a text may be cut before such spaces, each distinct chunk encoded once, and the ids
joined. Texts with any other space (two in a row, a space before a line feed) take the exact path for whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

#: Bytes that the chunks remembered between groups of texts may take, by the estimate COST for each and two per character.
REMEMBERED = 24_000_000
COST = 250
#: Characters of text whose new chunks are encoded together.
GROUP_CHARS = 2_000_000


class Places(dict):
    """Chunk -> place; a chunk that is asked for the first time gets the next place and is noted as new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class Chunks:
    """encode_new: distinct chunks -> their ids as bytes, in order; encode_whole: one text -> its ids as bytes."""

    def __init__(self, encode_new: Callable[[list[str]], list[bytes]], encode_whole: Callable[[str], bytes], group_chars: int = GROUP_CHARS, remembered: int = REMEMBERED):
        self.encode_new, self.encode_whole, self.group_chars, self.remembered = encode_new, encode_whole, group_chars, remembered
        self.forget()

    def forget(self) -> None:
        self.rest, self.first = Places(), Places()
        self.ids: list[bytes | None] = []  # by place in rest: ids of the chunk after a space; None: no cut before it
        self.heads: list[bytes] = []  # by place in first: ids of a text's first chunk
        self.held = 0  # bytes, by estimate

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= self.group_chars):
                size += len(texts[end])
                end += 1
            yield from self._group(texts[at:end])
            at = end

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        if self.held > self.remembered:
            self.forget()
        rest, first = self.rest, self.first
        placed = []
        for t in texts:
            head, *parts = t.split(" ")
            placed.append((first[head], list(map(rest.__getitem__, parts))))
        new, heads = rest.new, first.new
        self.held += sum(COST + 2 * len(x) for of in (new, heads) for x in of)
        cuts = [bool(x) and not x[0].isspace() for x in new]
        made = iter(self.encode_new([" " + x for x, ok in zip(new, cuts, strict=True) if ok] + heads))
        self.ids += [next(made) if ok else None for ok in cuts]
        self.heads += made
        rest.new, first.new = [], []
        del new, heads, cuts, made
        ids = self.ids
        for t, (head, places) in zip(texts, placed, strict=True):
            try:
                yield self.heads[head] + b"".join(map(ids.__getitem__, places))
            except TypeError:  # a None: the text cannot be cut there
                yield self.encode_whole(t)
