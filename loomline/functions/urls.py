"""URLs: the WHATWG normal form, the canonical form without tracking, and host safety.

Covered: scheme, credentials, host case, IDNA, IPv4 and bracketed IPv6 hosts,
default ports, dot segments, percent-encoding and form serialisation of the
query. IPv4 may be written in decimal, octal or hexadecimal numbers, one to four of
them. Not covered: the full UTS 46 mapping table (Python's idna codec is used).
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable
from urllib.parse import quote_plus, unquote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.vocabulary import BLOCKED_HOST_SUFFIXES, BLOCKED_HOSTS, BLOCKED_IPV4, BLOCKED_IPV6, TRACKING_NAMES, TRACKING_PREFIX

SCRIPT_SPACE = "\t\n\x0b\f\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
FORBIDDEN = re.compile(r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7f]")
PORTS = {"http": "80", "https": "443"}


def _encode(text: str, keep: str) -> str:
    return "".join(c if "!" <= c <= "~" and c not in keep else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


#: Hosts whose last label is a number are addresses, or nothing.
NUMERIC = re.compile(r"(^|\.)([0-9]+|0x[0-9a-f]*)\.?$")


def _ipv4(host: str) -> str | None:
    """The address in four decimal parts; the last number given fills what is left of the 32 bits."""
    parts = host.removesuffix(".").split(".")
    numbers = []
    for part in parts:
        hexadecimal, octal = part.startswith("0x"), len(part) > 1 and part.startswith("0")
        digits, base = (part[2:] or "0", 16) if hexadecimal else (part, 8 if octal else 10)
        if not re.fullmatch("[0-9a-f]+" if base == 16 else "[0-7]+" if base == 8 else "[0-9]+", digits) or len(digits.lstrip("0")) > 11:
            return None
        numbers.append(int(digits, base))
    if len(numbers) > 4 or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n << 8 * (3 - k) for k, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def _host(raw: str) -> str | None:
    if raw.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]" if raw.endswith("]") else None
        except ValueError:
            return None
    text = unquote_plus(raw.replace("+", "%2B"))
    try:
        host = text.lower() if text.isascii() else text.encode("idna").decode("ascii").lower()
    except UnicodeError:
        return None
    if not host or FORBIDDEN.search(host):
        return None
    return _ipv4(host) if NUMERIC.search(host) else host


def _path(raw: str) -> str:
    out: list[str] = []
    parts = raw.replace("\\", "/").split("/")[1:] or [""]
    for k, part in enumerate(parts):
        plain = part.lower().replace("%2e", ".")
        if plain == "..":
            out = out[:-1]
        elif plain != ".":
            out.append(_encode(part, "\"#<>?`{}^"))
            continue
        if k == len(parts) - 1:
            out.append("")
    return "/" + "/".join(out)


def normalize_url(value: str | None) -> tuple[str, str] | None:
    """(url, canonical url), or None where it isn't an http(s) URL without credentials."""
    if value is None:
        return None
    text = value.strip(SCRIPT_SPACE).strip("".join(map(chr, range(0x21))))
    text = text.replace("\t", "").replace("\n", "").replace("\r", "")
    found = re.match(r"(?i)(https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?", text, re.DOTALL)
    if not found:
        return None
    scheme, authority, path, query = found[1].lower(), found[2], found[3], found[4]
    credentials, at, place = authority.rpartition("@")
    if at and credentials.strip(":"):
        return None
    cut = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", place)
    if not cut:
        return None
    host, port = _host(cut[1]), (cut[2] or "").lstrip("0") or ("0" if cut[2] and set(cut[2]) == {"0"} else "")
    if host is None or (port and int(port) > 65535):
        return None
    base = f"{scheme}://{host}" + (f":{port}" if port and port != PORTS[scheme] else "") + _path(path or "/")
    url = base if query is None else f"{base}?{_encode(query[1:], chr(34) + '#<>' + chr(39))}"
    pairs = []
    for part in (query or "?")[1:].split("&"):
        if part:
            name, _, val = part.partition("=")
            pairs.append((unquote_plus(name, errors="replace"), unquote_plus(val, errors="replace")))
    stay = sorted((p for p in pairs if not is_tracking(p[0])), key=lambda p: p[0].encode("utf-16-be", "surrogatepass"))
    text = "&".join(f"{quote_plus(n, safe='*').replace('~', '%7E')}={quote_plus(v, safe='*').replace('~', '%7E')}" for n, v in stay)
    return url, base + (f"?{text}" if text else "")


def is_tracking(name: str) -> bool:
    return name.lower().startswith(TRACKING_PREFIX) or name.lower() in TRACKING_NAMES


@F.pandas_udf(T.StructType([T.StructField("url", T.StringType()), T.StructField("canonical_url", T.StringType())]))
def _normal_forms(urls: pd.Series) -> pd.DataFrame:
    found = [normalize_url(u) or (None, None) for u in urls]
    return pd.DataFrame(found, columns=["url", "canonical_url"])


#: URLs whose normal form is themselves up to the fragment and the order of plain parameters.
PLAIN = r"^https?://[a-z][a-z0-9-]*(\.[a-z][a-z0-9-]*)+(/[A-Za-z0-9_-][A-Za-z0-9_.-]*)+/?(\?[A-Za-z0-9_]+=[A-Za-z0-9_]*(&[A-Za-z0-9_]+=[A-Za-z0-9_]*)*)?(#[!-~]*)?$"


def normal_forms(url: Column) -> Column:
    """struct<url,canonical_url>, both null for what isn't accepted.

    Plain URLs, the bulk of real ones, are handled in SQL functions; Python sees
    the rest.
    """
    plain = F.coalesce(url.rlike(PLAIN), F.lit(False))
    whole = F.regexp_replace(url, "#.*$", "")
    base, query = F.substring_index(whole, "?", 1), F.when(whole.contains("?"), F.substring_index(whole, "?", -1)).otherwise("")
    tracked = lambda p: F.lower(F.substring_index(p, "=", 1)).startswith(TRACKING_PREFIX) | F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING_NAMES)
    stay = F.filter(F.split(query, "&"), lambda p: (p != "") & ~tracked(p))
    numbered = F.array_sort(F.transform(stay, lambda p, k: F.struct(F.substring_index(p, "=", 1).alias("name"), k.alias("k"), p.alias("p"))))
    text = F.array_join(F.transform(numbered, lambda x: x["p"]), "&")
    quick = F.struct(whole.alias("url"), F.when(text == "", base).otherwise(F.concat(base, F.lit("?"), text)).alias("canonical_url"))
    return F.when(plain, quick).otherwise(_normal_forms(F.when(~plain, url)))


def host_of(url: Column) -> Column:
    """Lower-case host of a normalised URL, without brackets."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://(\[[^\]]*\]|[^/:?#]*)", 1)), r"[\[\]]", "")


def blocked_host(host: Column) -> Column:
    test = host.isin(*BLOCKED_HOSTS)
    for suffix in BLOCKED_HOST_SUFFIXES:
        test |= host.endswith(suffix)
    return test


def _ipv4_number(address: Column) -> Column:
    parts = F.split(address, r"\.")
    return sum((parts[k].cast("long") * (256 ** (3 - k)) for k in range(4)), F.lit(0).cast("long"))


@F.pandas_udf(T.BooleanType())
def _public_ipv6(addresses: pd.Series) -> pd.Series:
    nets = [ipaddress.ip_network(n) for n in BLOCKED_IPV6]

    def public(a):
        try:
            parsed = ipaddress.IPv6Address(a)
        except ValueError:
            return False
        return not any(parsed in n for n in nets)

    return addresses.map(public, na_action="ignore")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once, however often it stands in the result."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _public_ipv4(address: Column) -> Column:
    """False for what isn't an address in four decimal parts."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

    def free(number: Column) -> Column:
        blocked = F.lit(False)
        for net in map(ipaddress.ip_network, BLOCKED_IPV4):
            blocked |= number.between(int(net[0]), int(net[-1]))
        return ~blocked

    return F.when(address.rlike(rf"^({octet}\.){{3}}{octet}$"), _once(_ipv4_number(address), free)).otherwise(False)


def public_address(address: Column) -> Column:
    """Whether an address is one that research may reach; false for what isn't an address."""
    v6 = address.contains(":")
    return F.when(v6, _public_ipv6(F.when(v6, address))).otherwise(_public_ipv4(address))


def _as_address(host: Column) -> Column:
    """A host that ends in a number as an address of four decimal parts, empty if it is none; other hosts as they are."""

    def value(p: Column) -> Column:
        return F.when(p.startswith("0x"), F.conv(F.concat(F.lit("0"), F.substring(p, 3, 99)), 16, 10)).when(p.startswith("0"), F.conv(p, 8, 10)).otherwise(p).cast("long")

    def four(numbers: Column) -> Column:
        n = F.size(numbers)
        last, before = F.element_at(numbers, -1), F.slice(numbers, 1, F.greatest(n - 1, F.lit(0)))
        fits = n.between(1, 4) & F.forall(before, lambda x: x <= 255) & (last < F.pow(F.lit(256), 5 - n))
        total = last + F.aggregate(F.transform(before, lambda x, k: x * F.pow(F.lit(256), 3 - k).cast("long")), F.lit(0).cast("long"), lambda acc, x: acc + x)
        parts = _once(total, lambda t: F.array_join(F.transform(F.array(*[F.lit(256**k) for k in (3, 2, 1, 0)]), lambda w: (F.floor(t / w) % 256).cast("string")), "."))
        return F.when((n > 0) & fits, parts).otherwise("")

    def numbers(parts: Column) -> Column:
        known = F.forall(parts, lambda p: p.rlike(r"^(0x0*[0-9a-f]{0,11}|0+[0-7]{0,11}|[1-9][0-9]{0,10})$"))
        return F.when(known, F.transform(parts, value)).otherwise(F.array().cast("array<bigint>"))

    address = _once(_once(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), numbers), four)
    return F.when(host.rlike(r"(^|\.)([0-9]+|0x[0-9a-f]*)\.?$"), address).otherwise(host)


def url_safety(url: Column) -> Column:
    """blocked, or public for an address, or lookup for a name whose addresses have to be known first.

    Addresses may be written in decimal, octal or hexadecimal numbers, one to four of
    them; a host that ends in a number but is no address is blocked.
    """
    host = host_of(url)
    v6 = host.contains(":")
    named = lambda h: F.when((h == "") | blocked_host(h), "blocked").when(h.rlike(r"^[0-9.]+$"), F.when(_public_ipv4(h), "public").otherwise("blocked")).otherwise("lookup")
    return F.when(url.isNull(), "blocked").when(v6, F.when(_public_ipv6(F.when(v6, host)), "public").otherwise("blocked")).otherwise(_once(host, lambda h: _once(_as_address(h), named)))
