import hashlib
import zlib

import numpy as np
import pytest

from tracewell.llm import media

from .conftest import ROWS


def slow_decode(data):
    """A scalar decoder of grey baseline files with one block an interval: zigzag coefficients of each block."""
    h = media.parse(data)
    tables = []
    for kind in ("dc", "ac"):
        body, code, place, table = h[kind][0], 0, 16, {}
        for n in range(1, 17):
            for s in body[place : place + body[n - 1]]:
                table[n, code] = s
                code += 1
            place, code = place + body[n - 1], code << 1
        tables.append(table)
    blocks = []
    at = h["scan"]
    while True:
        raw = bytearray()
        while not (data[at] == 0xFF and data[at + 1] != 0):
            raw.append(data[at])
            at += 2 if data[at] == 0xFF else 1
        bits = "".join(f"{b:08b}" for b in raw)
        p, out = 0, []
        while len(out) < 64:
            n = 1
            while (n, int(bits[p : p + n], 2)) not in tables[bool(out)]:
                n += 1
            s = tables[bool(out)][n, int(bits[p : p + n], 2)]
            p += n
            if out and s == 0:
                out += [0] * (64 - len(out))
                break
            out += [0] * (s >> 4 if out else 0)
            size = s & 15
            v = int(bits[p : p + size], 2) if size else 0
            p += size
            out.append(v if not size or v >> (size - 1) else v - (1 << size) + 1)
        blocks.append(out)
        if data[at + 1] == 0xD9:
            return np.array(blocks)
        at += 2


def test_every_byte_survives_and_the_scalar_decoder_agrees():
    r = np.random.default_rng(1)
    payloads = [bytes(64), bytes(range(256)), b"\xff" * 192, *(r.integers(0, 256, 64 * n, dtype=np.uint8).tobytes() for n in (1, 2, 7, 65))]
    files = media.encode(payloads)
    for p, f, (h, parts) in zip(payloads, files, media.decode(files), strict=True):
        assert media.read_payload(h, parts) == p
        assert (slow_decode(f) == parts[0].reshape(-1, 64)).all()
        assert media.encode([p])[0] == f
        n = len(p) // 64
        assert (media.thumbnail(h, parts).reshape(-1)[:n] == np.frombuffer(p, np.uint8)[::64]).all()


def test_general_files_with_runs_ends_and_one_long_interval():
    """A colour file with 2 by 2 sampling, runs, end-of-block codes and no restart interval, written bit by bit."""
    ac = {0x00: 2, 0x11: 2, 0xF0: 3, 0x02: 3}
    dc = {0: 1, 3: 2, 8: 3}
    codes = {k: media.canonical(t) for k, t in (("ac", ac), ("dc", dc))}
    bits = ""

    def put(kind, symbol, value=0):
        nonlocal bits
        code, n = codes[kind][symbol]
        bits += f"{code:0{n}b}"
        if size := symbol & 15:
            bits += f"{value if value > 0 else value + (1 << size) - 1:0{size}b}"

    want = []
    for dc_value in (5, -6, 0, 4):  # four blocks of luminance
        put("dc", 3 if dc_value else 0, dc_value)
        put("ac", 0x11, 1)
        put("ac", 0xF0)
        put("ac", 0x02, -3)
        put("ac", 0x00)
        block = [0] * 64
        block[2], block[19] = 1, -3
        want.append(block)
    for _ in range(2):
        put("dc", 8, 200)
        put("ac", 0x00)
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    seg, dht = media._segment, media._dht
    frame = b"\x08\x00\x10\x00\x10\x03" + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    data = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0] + [2] * 64)) + seg(0xC4, dht(0, dc)) + seg(0xC4, dht(0x10, ac)) + seg(0xC0, frame) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    h, parts = media.decode([data])[0]
    assert h["size"] == (16, 16) and parts[0].shape == (2, 2, 64) and parts[1].shape == (1, 1, 64)
    assert (parts[0].reshape(4, 64)[:, 1:] == np.array(want)[:, 1:]).all()
    assert parts[0][..., 0].tolist() == [[5, -1], [-1, 3]] and parts[1][0, 0, 0] == 200
    assert media.thumbnail(h, parts).tolist() == [[129, 128], [128, 129]]


def test_what_is_no_jpeg_is_refused():
    for bad in (b"", b"GIF89a", media.encode([bytes(64)])[0][:30], b"\xff\xd8\xff\xc2\x00\x04\x00\x00"):
        with pytest.raises(ValueError):
            media.decode([bad])


def test_damaged_files_give_errors_and_end_no_job(spark):
    good = media.encode([bytes(range(64)) * 3])[0]
    r = np.random.default_rng(8)
    rows = [(0, good), (1, None), (2, b""), (3, good[:2] + good[30:])]
    for k in range(4, 404):
        bad = bytearray(good)
        for at in r.integers(0, len(bad), 1 + k % 4):
            bad[at] = r.integers(256)
        rows.append((k, bytes(bad[: r.integers(1, len(bad) + 1)] if k % 3 else bad)))
    got = {x.id: x for x in media.describe(spark.createDataFrame(rows, "id int, media binary"), "id").collect()}
    assert len(got) == len(rows) and got[0].error is None and (got[0].width, got[0].height) == (16, 16)
    assert got[1].error is None and got[1].thumb_hash is None and got[2].error and got[3].error
    assert all((x.error is None) == (x.thumb_hash is not None) for x in got.values() if x.id != 1)
    huge = good.replace(b"\x08\x00\x10\x00\x10\x01", b"\x08\xff\xff\xff\xff\x01")
    with pytest.raises(ValueError):
        media.decode([huge.replace(b"\xff\xdd\x00\x04\x00\x01", b"\xff\xdd\x00\x04\x00\x00")])


def test_query_columns(docs, none):
    rows = media.stored_features(docs).collect()
    by: dict = {}
    for k, text, *_ in ROWS:
        raw = (text or "").encode()
        p = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        by.setdefault(k, []).append((len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    got: dict = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32))
    assert got == by
    files = media.media(docs)
    sizes = {(r.doc_id, len(r.media), hashlib.sha256(r.media).hexdigest()) for r in files.collect()}
    assert sizes == {(r.doc_id, r.media_bytes, r.media_sha256) for r in rows}
    seen = {(r.doc_id, f"{r.width}x{r.height}:{r.thumb_hash}") for r in media.describe(files, "doc_id").collect()}
    assert seen == {(r.doc_id, r.feature) for r in rows}
    assert media.stored_features(none).count() == 0
