"""Hosts as a browser reads them: international names, IPv4 in all its forms, IPv6; one Arrow-batched function over distinct hosts."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = re.compile(r"[a-z0-9_-]+(?:\.[a-z0-9_-]+)*\.?")
_FORBIDDEN = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")
_NUMBER = re.compile(r"[0-9]+|0[xX][0-9a-fA-F]*")
_DOTS = re.compile("[。．｡]")


def _label(label: str) -> str | None:
    """A label in ASCII: composed and lower-cased, then in Punycode; null where an encoded label does not decode."""
    try:
        if label.startswith("xn--"):
            shown = label[4:].encode("ascii").decode("punycode")
            return label if shown and not shown.isascii() and unicodedata.normalize("NFKC", shown).lower() == shown else None
        return label if label.isascii() else "xn--" + label.encode("punycode").decode("ascii")
    except (UnicodeError, ValueError, OverflowError):
        return None


def _ipv4(host: str) -> str | None:
    """Up to four numbers in decimal, octal (0...) or hexadecimal (0x...); the last fills what is left."""
    parts = host.removesuffix(".").split(".")
    if len(parts) > 4 or not all(_NUMBER.fullmatch(p) for p in parts):
        return None
    try:
        numbers = [int(p[2:] or "0", 16) if p[:2].lower() == "0x" else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p) for p in parts]
    except ValueError:
        return None
    *heads, last = numbers
    if any(n > 255 for n in heads) or last >= 256 ** (5 - len(numbers)):
        return None
    return str(ipaddress.IPv4Address(sum(n << 24 - 8 * i for i, n in enumerate(heads)) + last))


def ascii_host(host: str | None) -> str | None:
    """The host in ASCII, lower-case; null where it is none."""
    if not host:
        return None
    if host[0] == "[":
        try:
            address = ipaddress.IPv6Address(host[1:-1])
        except ValueError:
            return None
        mapped = address.ipv4_mapped
        return f"[::ffff:{int(mapped) >> 16:x}:{int(mapped) & 0xFFFF:x}]" if mapped else f"[{address.compressed}]"
    if "%" in host:
        try:
            host = re.sub(r"(?:%[0-9a-fA-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode(), host)
        except UnicodeDecodeError:
            return None
    lower = host.lower()
    if not _PLAIN.fullmatch(lower) or "xn--" in lower:
        labels = [_label(x) for x in _DOTS.sub(".", unicodedata.normalize("NFKC", lower).lower()).split(".")]
        if None in labels:
            return None
        lower = ".".join(labels)
    if not lower.strip(".") or _FORBIDDEN.search(lower) or ".." in lower or lower[0] == ".":
        return None
    return _ipv4(lower) if _NUMBER.fullmatch(lower.removesuffix(".").rpartition(".")[2]) else lower


def _ascii(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for hosts in batches:
        known = {h: ascii_host(h) for h in hosts.dropna().unique()}
        yield hosts.map(known).astype(object).where(hosts.notna(), None)


def canonical_host(host: Column) -> Column:
    return F.pandas_udf(_ascii, "string")(host)
