"""References in style sheets: url(...) and @import, found and rewritten. Comments don't count; external ones stay."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable
from urllib.parse import unquote_to_bytes

from ..functions.paths import SCHEMES
from ..functions.types import Udf

_EXTERNAL = re.compile(r"\s*(//|(" + "|".join(SCHEMES) + "):)", re.I)
# a quoted url must be closed by its parenthesis; an unquoted one may run to the end
_REFS = re.compile(r"""/\*.*?(?:\*/|$)|url\([ \t\r\n]*(?:(["'])(?P<quoted>.*?)\1[ \t\r\n]*\)|(?!["'])(?P<plain>[^)]*)(?:\)|$))|@import[ \t]*(["'])(?P<sheet>.*?)(?:\4|$)""", re.S)


def is_external(url: str) -> bool:
    return bool(_EXTERNAL.match(url))


def decode_percent(text: str) -> str:
    return unquote_to_bytes(text).decode("utf-8", "replace") if "%" in text else text


def fold(*parts: str) -> str:
    out: list[str] = []
    for s in "/".join(parts).split("/"):
        if s == "..":
            del out[-1:]
        elif s not in ("", "."):
            out.append(s)
    return "/".join(out)


def normalize(base: str, ref: str) -> str:
    return fold(base, decode_percent(ref.split("?")[0].split("#")[0]))


def dir_of(path: str) -> str:
    return posixpath.dirname(path) if "/" in path else ""


def references(css: str, base: str = "") -> list[str]:
    """Package paths that the sheet refers to, in order."""
    found = (_inner(m) for m in _REFS.finditer(css))
    return [normalize(base, x) for x in found if x and not is_external(x)]


def _inner(m: re.Match) -> str | None:
    value = next((v for k in ("quoted", "plain", "sheet") if (v := m.group(k)) is not None), None)
    return None if value is None else value.strip()


def rewrite(css: str, base: str, resolve: Callable[[str], str | None]) -> str:
    """Each reference replaced by what resolve gives for its path; without an answer it stays."""

    def one(m: re.Match) -> str:
        inner = _inner(m)
        new = None if not inner or is_external(inner) else resolve(normalize(base, inner))
        if new is None:
            return m.group()
        return f'@import "{new}"' if m.group("sheet") is not None else f'url("{new}")'

    return _REFS.sub(one, css)


css_references = Udf(lambda css, path: None if css is None else references(css, dir_of(path or "")), "array<string>")
css_rewrite = Udf(lambda css, path, urls: None if css is None else rewrite(css, dir_of(path or ""), (urls or {}).get), "string")
