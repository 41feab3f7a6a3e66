import pytest
from pyspark.sql import functions as F

from tracewell.functions import columns as fx
from tracewell.functions import names

HIDDEN = "localhost a.local box home.arpa example 10.1.2.3 127.0.0.1 100.64.0.1 169.254.1.1 172.31.0.1 192.0.0.8 192.0.2.1 192.88.99.1 192.168.0.1 198.19.1.1 198.51.100.2 203.0.113.9 240.0.0.1 0.0.0.0".split()
OPEN = "a.org www.example.com 8.8.8.8 100.128.0.1 172.32.0.1 192.0.0.9 192.0.0.10 198.20.0.1 223.255.255.255 2130706433.org".split()
HIDDEN6 = "::1 :: [fe80::1] fec0::1 fd00::1 ff02::1 64:ff9b:1::1 100::1 100:0:0:1::1 2001:2::1 2001:10::1 2001:20::1 2001:db8::1 3fff::1 5f00::1 ::ffff:10.0.0.1 64:ff9b::7f00:1 2002:7f00:1::1 ::7f00:1 2001:4860::5efe:127.0.0.1 4000::1".split()
OPEN6 = "2606:4700::1 ::ffff:8.8.8.8 64:ff9b::808:808 2002:808:808::1".split()


@pytest.mark.parametrize("host", HIDDEN + HIDDEN6)
def test_hidden(host):
    assert names.is_non_public_host(host)


@pytest.mark.parametrize("host", OPEN + OPEN6 + [""])
def test_open(host):
    assert not names.is_non_public_host(host)


def test_columns_agree(spark):
    hosts = HIDDEN + OPEN
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", fx.host_class(F.col("h")).alias("c"), names.non_public_host("h").alias("p")).collect()
    assert all((r.c == "non-public") == r.p for r in rows)


def test_keys():
    assert all(map(names.is_secret_key, ["password", "API-Key", "x:clientSecret", "my_api_key", "ｐassword"]))
    assert not any(map(names.is_secret_key, ["key", "tokens", "author", "secretary"]))
    assert all(map(names.is_credential_parameter, ["sig", "X-Amz-Signature", "key"]))


def test_locators():
    assert all(map(names.is_local_locator, ["/etc", "~/x", "C:\\x", "a/../b", "%2fetc", "%252e%252e/x", "file:///x", "\\\\host"]))
    assert not any(map(names.is_local_locator, ["a/b.wav", "https://a.org/x", "50%"]))
    assert names.parse_url("http://0x7f.1/").host == "127.0.0.1"
    assert names.parse_url("nope") is None and names.parse_url("http://") is None


def test_paths():
    assert [names.path_problem(p) for p in ["a/b", "", "/a", "a\\b", "a//b", "a/./b", "e\u0301", "c:x"]] == [None, "BUNDLE_PATH_INVALID", "BUNDLE_PATH_INVALID", "BUNDLE_PATH_INVALID", "BUNDLE_PATH_TRAVERSAL", "BUNDLE_PATH_TRAVERSAL", "BUNDLE_PATH_NOT_NFC", "BUNDLE_PATH_INVALID"]
