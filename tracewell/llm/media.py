"""Baseline JPEG media columns: a payload coder and a general baseline decoder.

Text bytes travel in the quantised coefficients of an 8-bit grey baseline JPEG, the unit that format keeps without
loss: one block of 64 coefficients per 64 bytes, in zigzag order. The first byte becomes the DC coefficient (byte - 128,
quantiser 8, so that a block's mean luminance is that byte), the others AC coefficients that skip zero. Every block is a
restart interval, so that all blocks of a batch can be Huffman-decoded in step by numpy.

The decoder parses the markers of any baseline file (SOF0, any sampling, with or without restart intervals), decodes its
scans and makes DC-only luminance thumbnails.

Defined results: a null or empty text has one block of zeros; equal texts give equal files. Files that are no baseline
JPEG, or damaged ones, raise ValueError in decode(); in describe() they give nulls and the reason.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from .common import mapped, text_map

CHUNK = 8192  # blocks that numpy works on at once
#: Code lengths by size category, for letters of text: the rarer, the longer. They leave the code of all ones free.
AC_LENGTHS = {0x05: 1, 0x04: 2, 0x07: 3, 0x06: 4, 0x03: 5, 0x08: 6, 0x02: 7, 0x01: 8}
DC_LENGTHS = {5: 1, 4: 2, 7: 3, 6: 4, 3: 5, 8: 6, 2: 7, 1: 8, 0: 9}


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length), as a DHT segment defines codes."""
    out, code, before = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - before
        out[symbol] = (code, n)
        code, before = code + 1, n
    return out


def _value_codes(values: np.ndarray, lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    codes = canonical(lengths)
    code, bits = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
    for b, v in enumerate(values.tolist()):
        size = abs(v).bit_length()
        c, n = codes[size]
        code[b], bits[b] = (c << size) | (v if v > 0 else v + (1 << size) - 1), n + size
    return code, bits


_BYTES = np.arange(256)
_DC_CODE, _DC_BITS = _value_codes(_BYTES - 128, DC_LENGTHS)
_AC_CODE, _AC_BITS = _value_codes(np.where(_BYTES < 128, _BYTES - 128, _BYTES - 127), AC_LENGTHS)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths.items(), key=lambda x: x[1])
    counts = [sum(n == k for _, n in order) for k in range(1, 17)]
    return bytes([kind, *counts, *[s for s, _ in order]])


_QUANT = bytes([0, 8] + [1] * 63)
_TABLES = _segment(0xDB, _QUANT) + _segment(0xC4, _dht(0x00, DC_LENGTHS)) + _segment(0xC4, _dht(0x10, AC_LENGTHS))
_SCAN = _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def header(blocks: int, wide: int, high: int) -> bytes:
    frame = struct.pack(">BHHB", 8, 8 * high, 8 * wide, 1) + bytes([1, 0x11, 0])
    return b"\xff\xd8" + _segment(0xFE, b"blocks=%d" % blocks) + _TABLES + _segment(0xC0, frame) + _SCAN


def shape(blocks: int) -> tuple[int, int]:
    wide = math.isqrt(blocks - 1) + 1
    return wide, -(-blocks // wide)


def _pack(blocks: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of blocks (n, 64), each followed by the marker byte in ends; and their lengths."""
    n = len(blocks)
    code, bits = _AC_CODE[blocks], _AC_BITS[blocks]
    code[:, 0], bits[:, 0] = _DC_CODE[blocks[:, 0]], _DC_BITS[blocks[:, 0]]
    for _ in range(2):  # four codes of at most 14 bits make one of at most 56
        code, bits = (code[:, ::2] << bits[:, 1::2]) | code[:, 1::2], bits[:, ::2] + bits[:, 1::2]
    total = bits.sum(1)
    pad = (-total.astype(np.int64)) % 8
    room = int(total.max()) // 64 + 3
    words = np.zeros((n, room), np.uint64)
    lane, at = np.arange(n), np.zeros(n, np.uint64)
    last = np.uint64(64)
    for k in range(code.shape[1] + 1):
        c, b = (code[:, k], bits[:, k]) if k < code.shape[1] else ((np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1), pad.astype(np.uint64))
        left = np.where(b > 0, c << ((last - b) & np.uint64(63)), np.uint64(0))
        w, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        words[lane, w] |= left >> off
        words[lane, w + 1] |= np.where(off > 0, left << ((last - off) & np.uint64(63)), np.uint64(0))
        at = at + b
    size = ((total.astype(np.int64) + pad) // 8)
    raw = words.byteswap().view(np.uint8).reshape(n, room * 8)
    flat = raw[np.arange(room * 8) < size[:, None]]
    full = flat == 0xFF
    owner = np.repeat(lane, size)
    before = np.cumsum(full) - full
    out_size = size + np.bincount(owner[full], minlength=n) + 2
    out = np.zeros(int(out_size.sum()), np.uint8)
    out[np.arange(len(flat)) + before + 2 * owner] = flat
    stop = np.cumsum(out_size)
    out[stop - 2], out[stop - 1] = 0xFF, ends
    return out, out_size


def encode(payloads: list[bytes]) -> list[bytes]:
    """One baseline JPEG per payload; each payload is a positive multiple of 64 bytes."""
    counts = [len(p) // 64 for p in payloads]
    shapes = [shape(c) for c in counts]
    sizes = [w * h for w, h in shapes]
    data = np.frombuffer(b"".join(x for p, c, s in zip(payloads, counts, sizes, strict=True) for x in (p, bytes(64 * (s - c)))), np.uint8).reshape(-1, 64)
    ends = np.concatenate([(np.arange(s) % 8 + 0xD0).astype(np.uint8) for s in sizes])
    stop = np.cumsum(sizes)
    ends[stop - 1] = 0xD9
    parts = [_pack(data[k : k + CHUNK], ends[k : k + CHUNK]) for k in range(0, len(data), CHUNK)]
    flat, lens = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    cut = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], stop])]
    return [header(c, *s) + flat[a:b].tobytes() for c, s, a, b in zip(counts, shapes, cut, cut[1:], strict=False)]


class Huffman:
    """A 16-bit lookup table of one DHT table: code length and symbol; and, joined, the whole step where it fits."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.bits, self.symbol = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
        code = place = 0
        for n in range(1, 17):
            for s in symbols[place : place + counts[n - 1]]:
                lo = code << (16 - n)
                self.bits[lo : lo + (1 << (16 - n))], self.symbol[lo : lo + (1 << (16 - n))] = n, s
                code += 1
            place, code = place + counts[n - 1], code << 1
        size = self.symbol & 15
        window = np.arange(65536)
        more = np.maximum(16 - self.bits - size, 0)
        extra = (window >> more) & ((1 << size) - 1)
        value = np.where(size > 0, np.where(extra >= (1 << np.maximum(size - 1, 0)), extra, extra - (1 << size) + 1), 0)
        #: value, run and bits of a step, where code and extra bits fit 16 bits together
        self.step = ((value << 16) | ((self.symbol >> 4) << 8) | (self.bits + size)).astype(np.int64)
        self.fits = bool(((self.bits + size)[self.bits > 0] <= 16).all())
        self.dense = self.fits and all(0 < s < 16 for s in symbols)  # no runs and no end of block


_HUFFMAN: dict[bytes, Huffman] = {}


def _huffman(body: bytes) -> Huffman:
    if body not in _HUFFMAN:
        if len(_HUFFMAN) > 64:
            _HUFFMAN.clear()
        _HUFFMAN[body] = Huffman(body[:16], body[16:])
    return _HUFFMAN[body]


def parse(data: bytes) -> dict:
    """The markers of a baseline file: size, components, tables, restart interval, comment and where its scan starts."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG: it lacks the start marker")
    out: dict = {"quant": {}, "dc": {}, "ac": {}, "restart": 0, "comment": b""}
    at = 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a JPEG marker is missing or cut")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                size = 17 + sum(body[1:17])
                out["ac" if body[0] >> 4 else "dc"][body[0] & 15] = body[1:size]
                body = body[size:]
        elif marker == 0xC0:
            bits, high, wide, k = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not high or not wide:
                raise ValueError("only 8-bit baseline frames with a size are read")
            out |= {"size": (wide, high), "parts": [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(k)]}
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body[:2])[0]
        elif marker == 0xFE:
            out["comment"] = body
        elif marker == 0xDA:
            if "size" not in out or body[0] != len(out["parts"]):
                raise ValueError("only one scan with all components is read")
            out["tables"] = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            return out | {"scan": at}


def layout(h: dict) -> tuple[list[tuple[int, int, int]], int, int]:
    """Blocks of an MCU as (component, column, row), and the MCUs across and down."""
    wide, high = h["size"]
    if len(h["parts"]) == 1:
        return [(0, 0, 0)], -(-wide // 8), -(-high // 8)
    hs, vs = max(p[1] for p in h["parts"]), max(p[2] for p in h["parts"])
    return [(k, x, y) for k, p in enumerate(h["parts"]) for y in range(p[2]) for x in range(p[1])], -(-wide // (8 * hs)), -(-high // (8 * vs))


def _block(view: np.ndarray, at: np.ndarray, dc: Huffman, ac: Huffman, out: np.ndarray) -> np.ndarray:
    """Decodes one block in each lane: zigzag coefficients into out (lanes, 64), DC as a difference; the new bit places."""

    def peek(p):
        return (view[p >> 3] >> (16 - (p & 7))) & 0xFFFF

    def full(p, table):
        w = peek(p)
        bits, symbol = table.bits[w], table.symbol[w]
        if not bits.all():
            raise ValueError("a Huffman code is not in its table")
        if table.fits:
            s = table.step[w]
            return s >> 16, (s >> 8) & 255, s & 255, symbol
        size = symbol & 15
        extra = peek(p + bits) >> (16 - size)
        value = np.where(size > 0, np.where(extra >> np.maximum(size - 1, 0) > 0, extra, extra - (1 << size) + 1), 0)
        return value, symbol >> 4, bits + size, symbol

    out[:, 0], _, n, _ = full(at, dc)
    at = at + n
    if ac.dense:
        bad = np.zeros(len(at), bool)
        for k in range(1, 64):
            s = ac.step[peek(at)]
            out[:, k] = s >> 16
            n = s & 255
            bad |= n == 0
            at = at + n
        if bad.any():
            raise ValueError("a Huffman code is not in its table")
        return at
    lane, k = np.arange(len(at)), np.ones(len(at), np.int64)
    while len(lane):
        value, run, n, symbol = full(at[lane], ac)
        at[lane] += n
        go = symbol != 0
        k[lane] += np.where(go, run, 0)
        if (k[lane][go] > 63).any():
            raise ValueError("a run leaves its block")
        put = lane[go & ((symbol & 15) > 0)]
        out[put, k[put]] = value[go & ((symbol & 15) > 0)]
        k[lane] += 1
        lane = lane[go & (k[lane] < 64)]
    return at


def _intervals(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scan without stuffing and markers, padded; and where its restart intervals begin."""
    ff = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[ff + 1]
    keep = np.ones(len(scan), bool)
    keep[ff[after == 0] + 1] = False
    mark = ff[after != 0]
    keep[mark] = keep[mark + 1] = False
    place = np.cumsum(keep) - keep
    starts = np.concatenate([[0], place[mark[scan[mark + 1] != 0xD9]]])
    return np.concatenate([scan[keep], np.zeros(8, np.uint8)]), starts


def _view(data: np.ndarray) -> np.ndarray:
    d = data.astype(np.int64)
    return (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]


def decode(files: list[bytes]) -> Iterable[tuple[dict, list[np.ndarray]]]:
    """Per file: its header, and per component its coefficients (blocks down, blocks across, 64), in zigzag order."""
    try:
        return _decoded(files)
    except (IndexError, KeyError, OverflowError, ZeroDivisionError, struct.error) as e:  # what a damaged file leads to
        raise ValueError(f"a damaged JPEG: {e}") from e


def _decoded(files: list[bytes]) -> list[tuple[dict, list[np.ndarray]]]:
    heads = [parse(f) for f in files]
    groups: dict = {}
    for i, h in enumerate(heads):
        one = h["restart"] == 1 and len(h["parts"]) == 1
        tables = tuple(x for p in h["parts"] for x in (h["dc"].get(h["tables"][p[0]][0], b""), h["ac"].get(h["tables"][p[0]][1], b"")))
        groups.setdefault(tables if one else i, []).append(i)
    done: dict = {}
    for key, members in groups.items():
        if isinstance(key, tuple):  # every interval is one block: the blocks of all files go in step
            dc, ac = _huffman(key[0]), _huffman(key[1])
            cut = [_intervals(np.frombuffer(files[i], np.uint8)[heads[i]["scan"] :]) for i in members]
            base = np.cumsum([0] + [len(d) for d, _ in cut])
            view = _view(np.concatenate([d for d, _ in cut]))
            starts = np.concatenate([s + b for (_, s), b in zip(cut, base, strict=False)]) * 8
            coef = np.zeros((len(starts), 64), np.int16)
            for k in range(0, len(starts), CHUNK):
                _block(view, starts[k : k + CHUNK], dc, ac, coef[k : k + CHUNK])
            at = 0
            for i, (_, s) in zip(members, cut, strict=True):
                _, across, down = layout(heads[i])
                if len(s) != across * down:
                    raise ValueError("blocks are missing from a scan")
                done[i] = [coef[at : at + len(s)].reshape(down, across, 64)]
                at += len(s)
        else:
            done[key] = _decode_any(files[key], heads[key])
    return [(h, done[i]) for i, h in enumerate(heads)]


def _decode_any(data: bytes, h: dict) -> list[np.ndarray]:
    order, across, down = layout(h)
    total = across * down
    if total * len(order) > 4 * (len(data) - h["scan"]):  # a block takes two bits at least
        raise ValueError("the scan is too short for its frame")
    step = h["restart"] or total
    flat, starts = _intervals(np.frombuffer(data, np.uint8)[h["scan"] :])
    if len(starts) != -(-total // step):
        raise ValueError("restart intervals are missing from a scan")
    view, at = _view(flat), starts * 8
    single = len(h["parts"]) == 1
    out = [np.zeros((down * (1 if single else p[2]), across * (1 if single else p[1]), 64), np.int64) for p in h["parts"]]
    before = [np.zeros(len(starts), np.int64) for _ in h["parts"]]
    tables = [(_huffman(h["dc"][h["tables"][p[0]][0]]), _huffman(h["ac"][h["tables"][p[0]][1]])) for p in h["parts"]]
    for m in range(min(step, total)):
        mcu = np.arange(len(starts)) * step + m
        live = np.flatnonzero(mcu < total)
        for k, x, y in order:
            coef = np.zeros((len(live), 64), np.int64)
            at[live] = _block(view, at[live], *tables[k], coef)
            before[k][live] += coef[:, 0]
            coef[:, 0] = before[k][live]
            row, col = mcu[live] // across, mcu[live] % across
            sx, sy = (1, 1) if single else h["parts"][k][1:3]
            out[k][row * sy + y, col * sx + x] = coef
    return out


def thumbnail(h: dict, parts: list[np.ndarray]) -> np.ndarray:
    """DC-only luminance: the mean of each block of the first component, 0 to 255."""
    if not len(h["quant"].get(h["parts"][0][3], ())):
        raise ValueError("a quantisation table is missing")
    q = h["quant"][h["parts"][0][3]][0]
    wide, high = h["size"]
    p = h["parts"][0]
    hs, vs = (1, 1) if len(h["parts"]) == 1 else (max(x[1] for x in h["parts"]), max(x[2] for x in h["parts"]))
    down, across = -(-high * p[2] // (8 * vs)) if len(h["parts"]) > 1 else -(-high // 8), -(-wide * p[1] // (8 * hs)) if len(h["parts"]) > 1 else -(-wide // 8)
    dc = parts[0][:down, :across, 0].astype(np.int64) * int(q)
    return np.clip((dc + 4) // 8 + 128, 0, 255).astype(np.uint8)


def thumb_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8 by 8 grid are brighter than the mean cell."""
    high, wide = thumb.shape
    total = np.zeros((high + 1, wide + 1), np.int64)
    total[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    y, x = np.arange(8) * high // 8, np.arange(8) * wide // 8
    y2, x2 = np.maximum(np.arange(1, 9) * high // 8, y + 1), np.maximum(np.arange(1, 9) * wide // 8, x + 1)
    box = total[y2][:, x2] - total[y][:, x2] - total[y2][:, x] + total[y][:, x]
    mean = box * 1_000_000 // ((y2 - y)[:, None] * (x2 - x)[None, :])
    return np.packbits(mean * 64 > mean.sum()).tobytes().hex()


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def read_payload(h: dict, parts: list[np.ndarray]) -> bytes:
    """The bytes that encode() stored."""
    if not h["comment"].startswith(b"blocks="):
        raise ValueError("the file holds no payload")
    c = parts[0].reshape(-1, 64)[: int(h["comment"][7:])]
    out = np.where(c < 0, c + 128, c + 127).astype(np.uint8)
    out[:, 0] = (c[:, 0] + 128).astype(np.uint8)
    return out.tobytes()


#: Bytes of payload that are coded at once, beside one longer text.
BATCH_BYTES = 1 << 20


def _stored(texts: list) -> list[tuple]:
    out: list[tuple] = []
    made = [payload_of(t) for t in texts]
    at = 0
    while at < len(made):
        end, size = at, 0
        while end < len(made) and (end == at or size + len(made[end][1]) <= BATCH_BYTES):
            size += len(made[end][1])
            end += 1
        files = encode([p for _, p in made[at:end]])
        for (n, _), f, (h, parts) in zip(made[at:end], files, decode(files), strict=True):
            back, thumb = read_payload(h, parts), thumbnail(h, parts)
            wide, high = h["size"]
            out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(f), hashlib.sha256(f).hexdigest(), f"{wide}x{high}:{thumb_hash(thumb)}", wide, high))
        at = end
    return out


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def stored_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text stored as JPEG bytes, read back and described. The files themselves come from media()."""
    return text_map(docs, [key], text, FEATURES, lambda: _stored)


def media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text as a JPEG file in the column media."""
    return text_map(docs, [key], text, "media binary", lambda: lambda texts: [(encode([payload_of(t)[1]])[0],) for t in texts])


def describe(files: DataFrame, key: str, column: str = "media") -> DataFrame:
    """Size, thumbnail (one byte a block, by rows) and thumbnail hash of any baseline files, and the error of those that
    cannot be read, whose other columns are null; null files give nulls."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    schema = StructType([files.schema[key], *StructType.fromDDL("width int, height int, thumb binary, thumb_hash string, error string").fields])

    def run(batches):
        for b in batches:
            rows = []
            for f in b.column(1).to_pylist():
                if f is None:
                    rows.append((None,) * 5)
                    continue
                try:
                    h, parts = decode([f])[0]
                    t = thumbnail(h, parts)
                except ValueError as e:
                    rows.append((None, None, None, None, str(e)))
                else:
                    rows.append((*h["size"], t.tobytes(), thumb_hash(t), None))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=schema.names)

    return mapped(files.select(key, column), run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return stored_features(spark.read.parquet(f"{sf_dir}/documents.parquet"))
