"""Scalar functions as columns, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Key names that must not be published, whole and as endings of a local name.
SECRET_NAMES = [
    "accesskey", "accesskeyid", "accesstoken", "apikey", "apisecret", "authorization", "authkey", "authtoken", "awsaccesskeyid",
    "awssecretaccesskey", "bearertoken", "clientsecret", "connectionstring", "cookie", "credential", "credentials", "databaseurl",
    "environment", "idtoken", "oauthsecret", "oauthtoken", "password", "passphrase", "privateendpoint", "privatekey", "providerconfig",
    "providersettings", "refreshtoken", "secret", "secretaccesskey", "securitytoken", "serviceaccountkey", "sessiontoken", "signingkey",
    "token", "webhooksecret", "xamzsecuritytoken", "xapikey", "xgoogsecuritytoken",
]
SECRET_ENDINGS = [
    "accesskeyid", "accesstoken", "apikey", "apisecret", "authkey", "authtoken", "awssecretaccesskey", "bearertoken", "clientsecret",
    "connectionstring", "databaseurl", "idtoken", "oauthsecret", "oauthtoken", "password", "passphrase", "privatekey", "refreshtoken",
    "secretaccesskey", "securitytoken", "serviceaccountkey", "sessiontoken", "signingkey", "webhooksecret",
]
#: Further URL parameters that carry credentials or signatures.
CREDENTIAL_PARAMETERS = [
    "credential", "googleaccessid", "key", "keypairid", "oauthsignature", "securitytoken", "signature", "sig", "xamzcredential",
    "xamzsecuritytoken", "xamzsignature", "xgoogcredential", "xgoogsecuritytoken", "xgoogsignature",
]
#: IPv4 blocks that are not public, as (first address, prefix length).
IPV4_BLOCKS = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3"]
#: Addresses inside those blocks that are public.
IPV4_EXCEPTIONS = ["192.0.0.9", "192.0.0.10"]
#: Names that never resolve publicly, with all names below them.
RESERVED_NAMES = ["example", "home.arpa", "invalid", "local", "localhost", "test"]


def folded_key(key: Column) -> Column:
    """Letters and digits of a key, in lower case. Compatibility forms are folded by names.fold_key, in Python."""
    return F.lower(F.regexp_replace(key, "[^A-Za-z0-9]", ""))


def is_secret_key(key: Column) -> Column:
    whole, local = folded_key(key), folded_key(F.substring_index(key, ":", -1))
    ending = F.lit(False)
    for e in SECRET_ENDINGS:
        ending = ending | local.endswith(e)
    return whole.isin(SECRET_NAMES) | local.isin(SECRET_NAMES) | ending


def is_credential_parameter(key: Column) -> Column:
    return is_secret_key(key) | folded_key(key).isin(CREDENTIAL_PARAMETERS)


def _address(text: str) -> int:
    return int.from_bytes(bytes(map(int, text.split("."))), "big")


def ipv4_number(text: Column) -> Column:
    """A dotted quad without leading zeros as a number; null for anything else."""
    part = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    ok = text.rlike(rf"^{part}(\.{part}){{3}}$")
    octet = lambda k: F.split_part(text, F.lit("."), F.lit(k)).cast("long")
    return F.when(ok, ((octet(1) * 256 + octet(2)) * 256 + octet(3)) * 256 + octet(4))


def is_non_public_ipv4(number: Column) -> Column:
    hit = F.lit(False)
    for block in IPV4_BLOCKS:
        first, bits = block.split("/")
        lo = _address(first)
        hit = hit | number.between(lo, lo + 2 ** (32 - int(bits)) - 1)
    return hit & ~number.isin([_address(x) for x in IPV4_EXCEPTIONS])


def host_class(host: Column) -> Column:
    """public or non-public, of a host that is a name or an IPv4 address; IPv6 goes through names.is_non_public_host."""
    h = F.regexp_replace(F.lower(host), r"\.+$", "")
    reserved = F.lit(False)
    for name in RESERVED_NAMES:
        reserved = reserved | (h == name) | h.endswith("." + name)
    number = ipv4_number(h)
    hidden = reserved | F.when(number.isNotNull(), is_non_public_ipv4(number)).otherwise(~h.contains("."))
    return F.when(h == "", "none").when(hidden, "non-public").otherwise("public")


def pointer_segment(key: Column) -> Column:
    """A key as a segment of a JSON Pointer."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def url_host(url: Column) -> Column:
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_extract(authority, r"^(?:[^@]*@)?([^:]*)", 1))


def url_parameters(url: Column) -> Column:
    """The names of a URL's query and fragment parameters."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"#(.*)", 1)
    pairs = F.filter(F.concat(F.split(query, "&"), F.split(fragment, "&")), lambda x: x != "")
    return F.transform(pairs, lambda x: F.substring_index(x, "=", 1))
