"""Addresses as browsers resolve them, for extractors that run in Python."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

_ODD = re.compile(r"[\t\n\r]")
#: What stays as it is in paths and queries.
_SAFE = "!$%&'()*+,-./:;=?@[]^_|~\\"


def host(url: str) -> str:
    """Host in lower case without ``www.``; empty if there is none."""
    try:
        return (urlsplit(url).hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def resolve(href: str, page: str) -> str | None:
    """Absolute form without fragment; None if there is no host to go to or it isn't an address."""
    try:
        parts = urlsplit(urljoin(page, _ODD.sub("", href.strip())))
        if parts.scheme not in ("http", "https") or not parts.hostname:
            return None
        port = "" if parts.port in (None, {"http": 80, "https": 443}[parts.scheme]) else f":{parts.port}"
    except ValueError:
        return None
    name = parts.hostname if parts.hostname.isascii() else parts.hostname.encode("idna").decode()
    return urlunsplit((parts.scheme, name + port, quote(parts.path or "/", safe=_SAFE), quote(parts.query, safe=_SAFE + "/"), ""))


def normalize(href: str, page: str) -> str | None:
    """Like :func:`resolve`, without a slash at the end unless the path is only that."""
    found = resolve(href, page)
    if found and found.endswith("/") and urlsplit(found).path != "/":
        return found[:-1]
    return found
