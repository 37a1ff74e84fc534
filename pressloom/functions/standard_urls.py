"""URLs in the one form that browsers give them: percent codes, dot segments, ports, and hosts as names, IPv4 or IPv6.

Most URLs of feeds are in that form already, which a pattern sees; only others go to a Python worker, over Arrow. The rules of `urls`
then work on URLs in standard form.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Schemes with hosts and their ports; characters that each part of a URL percent-encodes, beside controls and non-ASCII.
PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
FRAGMENT, QUERY, PATH = " \"<>`", " \"#<>'", " \"#<>?^`{}"
USER = PATH + "/:;=@[\\]|"
FORBIDDEN = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")
#: Characters of names that stand for nothing, or for a dot.
IGNORED, DOTS = re.compile("[\u00ad\u200b\u2060\ufeff\ufe00-\ufe0f]"), re.compile("[\u3002\uff0e\uff61]")
#: What is in standard form for sure: a plain name, no default port, no dot segment, nothing to encode.
PLAIN = r"^https?://(?![^/]*:(?:80|443)(?:/|$))(?:[a-z0-9-]+\.)+[a-z]+(?::[1-9][0-9]{0,3})?(?!.*/(?:\.|%2[eE]))/[A-Za-z0-9_~!$&()*+,;=@%.:/-]*(?:\?[A-Za-z0-9_~!$&()*+,;=@%.:/?-]*)?$"


def encoded(text: str, chars: str) -> str:
    return "".join(c if " " <= c <= "~" and c not in chars else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def number(part: str) -> int | None:
    """A part of an IPv4 address: decimal, octal behind a 0, hexadecimal behind 0x."""
    low = part.lower()
    base, digits = (16, low[2:]) if low.startswith("0x") else (8, low[1:]) if len(low) > 1 and low[0] == "0" else (10, low)
    try:
        return int(digits or "0", base) if part and re.fullmatch("[0-9a-f]*", digits) else None
    except ValueError:
        return None


def four(host: str) -> str | None:
    parts = host.split(".")
    parts = parts[:-1] if parts[-1] == "" and len(parts) > 1 else parts
    values = [number(x) for x in parts]
    if len(parts) > 4 or None in values or any(x > 255 for x in values[:-1]) or values[-1] >= 256 ** (5 - len(parts)):
        return None
    value = sum(x << 8 * (3 - i) for i, x in enumerate(values[:-1])) + values[-1]
    return ".".join(str(value >> shift & 255) for shift in (24, 16, 8, 0))


def six(host: str) -> str | None:
    try:
        pieces = [format(int(x, 16), "x") for x in ipaddress.IPv6Address(host).exploded.split(":")] if "%" not in host else None
    except ValueError:
        return None
    if pieces is None:
        return None
    zeros = max(re.finditer(r"(?:0(?::|$))+", ":".join(pieces)), key=lambda m: m[0].count("0"), default=None)
    text = ":".join(pieces)
    if zeros is None or zeros[0].count("0") < 2:
        return f"[{text}]"
    return f"[{text[: zeros.start()].rstrip(':')}::{text[zeros.end() :]}]"


def host_of(host: str) -> str | None:
    if host.startswith("["):
        return six(host[1:-1]) if host.endswith("]") else None
    name = unquote_to_bytes(host.encode("utf-8", "replace")).decode("utf-8", "replace")
    if not name.isascii():
        name = unicodedata.normalize("NFKC", IGNORED.sub("", DOTS.sub(".", unicodedata.normalize("NFKC", name).lower())))
    labels = [x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in name.lower().split(".")]
    name = ".".join(labels)
    if not name or FORBIDDEN.search(name) or "\ufffd" in host:
        return None
    last = labels[-2] if labels[-1] == "" and len(labels) > 1 else labels[-1]
    return four(name) if last.isdigit() or re.fullmatch("0x[0-9a-f]*", last) else name


def path_of(path: str) -> str:
    out: list[str] = []
    segments = re.split(r"[/\\]", path)
    for i, segment in enumerate(segments):
        dots = re.sub("%2e", ".", segment, flags=re.IGNORECASE)
        if dots in (".", ".."):
            out = out[:-1] if dots == ".." else out
            out += [""] if i == len(segments) - 1 else []
        else:
            out.append(encoded(segment, PATH))
    return "/" + "/".join(out)


def standard(url: str) -> str | None:
    """The standard form of a URL of one of PORTS' schemes; null for what isn't one, or has no host."""
    text = re.sub("[\t\n\r]", "", url.strip("".join(map(chr, range(0x21)))))
    m = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):[/\\]*([^/\\?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", text, re.DOTALL)
    if m is None or (scheme := m[1].lower()) not in PORTS:
        return None
    user, at, place = m[2].rpartition("@")
    name, colon, secret = user.partition(":")
    inside = re.match(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$", place)
    host = host_of(inside[1]) if inside else None
    if host is None or int(inside[2] or 0) > 65535:
        return None
    port = str(int(inside[2])) if inside[2] else ""
    who = encoded(name, USER) + (":" + encoded(secret, USER) if secret else "")
    path = path_of(m[3][1:]) if m[3] else "/"
    query = "" if m[4] is None else "?" + encoded(m[4], QUERY)
    mark = "" if m[5] is None else "#" + encoded(m[5], FRAGMENT)
    return f"{scheme}://{who + '@' if who else ''}{host}{':' + port if port and port != PORTS[scheme] else ''}{path}{query}{mark}"


@F.arrow_udf(StringType())
def _standard(urls: pa.Array) -> pa.Array:
    return pa.array([None if x is None else standard(x) for x in urls.to_pylist()], pa.string())


def in_standard_form(url: Column) -> Column:
    """A URL in standard form; null for what isn't a URL with a host. As a column of its own, before other rules."""
    plain = url.rlike(PLAIN)
    return F.coalesce(F.when(plain, url), _standard(F.when(~plain, url)))
