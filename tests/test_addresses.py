"""Addresses and blocks against the standard library."""

import ipaddress
import random

from tracewell.functions import addresses

BAD = ["", ":", "::1::", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4::5:6:7:8", "12345::", "g::", "1:2:3:4:5:6:7:", ":1:2:3:4:5:6:7", "::1.2.3", "::1.2.3.256", "::01.2.3.4", "1.2.3.4::", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "host", "::1 ", "1::2:3.4.5.6:7"]


def spelled(r, a):
    """Some spelling of an address."""
    full = [f"{int(x, 16):x}" for x in a.exploded.split(":")]
    return r.choice([a.exploded, a.compressed, ":".join(full), a.exploded.upper(), ":".join(full[:6]) + ":" + str(ipaddress.IPv4Address(int(a) & 0xFFFFFFFF))])


def test_bits_of_addresses(spark):
    r = random.Random(1)
    made = [ipaddress.IPv6Address(r.getrandbits(128) & r.choice([-1, 0xFFFF, 0xFFFF << 112, (1 << 64) - 1, r.getrandbits(128)])) for _ in range(200)]
    texts = [(spelled(r, a), format(int(a), "0128b")) for a in made] + [(str(a), format(int(a), "032b")) for a in (ipaddress.IPv4Address(r.getrandbits(32)) for _ in range(50))]
    texts += [("::", "0" * 128), ("::1", "0" * 127 + "1"), ("1::", "0" * 15 + "1" + "0" * 112), ("::ffff:1.2.3.4", format(int(ipaddress.IPv6Address("::ffff:1.2.3.4")), "0128b"))]
    for t in BAD:  # whatever the library refuses
        try:
            ipaddress.ip_address(t)
        except ValueError:
            texts.append((t, None))
    rows = spark.createDataFrame([*texts, (None, None)], "t string, want string")
    wrong = [x for x in rows.withColumn("got", addresses.address_bits(rows["t"])).collect() if x.got != x.want]
    assert not wrong and len(texts) > 270


def test_longest_block(spark):
    r = random.Random(2)
    nets = [ipaddress.ip_network((r.getrandbits(128) & (0x2001 << 112 | (1 << 100) - 1) | 0x2001 << 112, n), strict=False) for n in range(0, 129, 3) for _ in range(3)]
    nets += [ipaddress.ip_network((r.getrandbits(32), n), strict=False) for n in range(0, 33) for _ in range(3)]
    blocks = spark.createDataFrame([(str(n), str(n.network_address), n.prefixlen) for n in nets] + [("odd", "x", 3), ("wide", "1.2.3.4", 33)], "block string, first string, length int")
    inside = [n.network_address + r.randrange(min(n.num_addresses, 1 << 60)) for n in nets]
    outside = [ipaddress.ip_address(r.getrandbits(32)) for _ in range(50)] + [ipaddress.IPv6Address(r.getrandbits(128)) for _ in range(50)]
    rows = spark.createDataFrame([(str(a),) for a in inside + outside + inside[:5]] + [(None,), ("name",)], "t string")
    got = addresses.longest_block(rows.withColumn("bits", addresses.address_bits(rows["t"])), blocks, "bits").collect()
    assert len(got) == len(inside + outside) + 7
    for x in got:
        try:
            a = ipaddress.ip_address(x.t or "")
        except ValueError:
            assert x.block is None
            continue
        holding = [n for n in nets if n.version == a.version and a in n]
        most = max((n.prefixlen for n in holding), default=None)
        assert x.block == min((str(n) for n in holding if n.prefixlen == most), default=None)
