"""HTML operators over a chapter column: text, blocks, search, annotation, rewriting. Each is an Arrow UDF on one value;
those that find several things give an array to explode, so that one tree is built for each chapter.

Two readings of a document are kept apart, as in reading systems: the plain text and the rewriters see the tokens as they
are written (nothing implied, nothing decoded), blocks, search and coordinates see the tree.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.types import Udf, lit, string
from . import css as _css
from . import htmlcore

# Elements that make one block, and attributes that hold URLs (True: a fragment is kept).
BLOCKS = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "li", "dt", "dd", "figcaption"))
_MEDIA = {"src": False, "poster": False}
URL_ATTRIBUTES = {
    "img": _MEDIA, "video": _MEDIA, "audio": _MEDIA, "source": _MEDIA, "track": _MEDIA, "object": {"data": False}, "image": {"href": False, "xlink:href": False},
    "use": {"href": True, "xlink:href": True}, "link": {"href": True}, "a": {"href": True}, "area": {"href": True},
}
AROUND = 20


def extract_text(html: str) -> str:
    """Raw text inside the body tag, without scripts and styles, trimmed."""
    out, inside, skipped = [], False, False
    for kind, value, _, _ in htmlcore.tokens(html):
        if kind == "start":
            inside |= value.name == "body"
            skipped = value.name in ("script", "style")
        elif kind == "end":
            inside &= value != "body"
            skipped &= value not in ("script", "style")
        elif kind == "text" and inside and not skipped:
            out.append(value)
    return "".join(out).strip()


def _language(node: htmlcore.Node, inherited: str | None) -> str | None:
    return node.attrs.get("lang", node.attrs.get("xml:lang", inherited))


def blocks(html: str, base: str) -> list[dict]:
    """Block elements of the body in order, the outermost only: text, coordinate, tag, language."""
    root = htmlcore.parse(html).first("html")
    body, index = None, 0
    for c in root.children:
        index += 2 * c.element
        if c.name == "body":
            body = c
            break
    out: list[dict] = []
    base = base.removesuffix("!")
    todo = [] if body is None else [(body, f"/{index}", _language(root, None))]
    while todo:
        node, path, lang = todo.pop()
        if node is not body and node.name in BLOCKS:
            if text := node.text().strip():
                out.append({"text": text, "cfi_range": f"epubcfi({base}!{path})", "tag_name": node.name, "language": lang})
            continue
        below, i = [], 0
        for c in node.children:
            if c.element:
                i += 2
                below.append((c, htmlcore.child_path(path, i, c), _language(c, lang)))
        todo += reversed(below)
    return out


def text_nodes(html: str) -> list[dict]:
    """Every text of the tree, head included: its element's path, its odd index, its text."""
    return [{"path": path, "index": i, "text": n.data} for n, path, i, _ in htmlcore.located(htmlcore.parse(html).first("html")) if not n.element]


def search(html: str, base: str, pattern: str, ignore_case: bool = False) -> list[dict]:
    """Matches of a pattern inside single texts: excerpt (about AROUND bytes on either side) and range. Offsets are UTF-8 bytes."""
    find = re.compile(pattern, re.I if ignore_case else 0)
    out = []
    for n in text_nodes(html):
        text = n["text"]
        raw, at, b = None, 0, 0  # b: bytes before the character number at
        for m in find.finditer(text):
            raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
            a = b + len(text[at : m.start()].encode("utf-8", "surrogatepass"))
            at, b = m.end(), a + len(m.group().encode("utf-8", "surrogatepass"))
            lo, hi = max(0, a - AROUND), min(len(raw), b + AROUND)
            while lo > 0 and raw[lo] & 0xC0 == 0x80:
                lo -= 1
            while hi < len(raw) and raw[hi] & 0xC0 == 0x80:
                hi += 1
            out.append({"excerpt": raw[lo:hi].decode("utf-8", "surrogatepass"), "cfi": f"epubcfi({base}{n['path']},/{n['index']}:{a},/{n['index']}:{b})"})
    return out


def annotate(html: str, base: str) -> str:
    """The document with data-cfi on every element below html."""
    document = htmlcore.parse(html)
    for n, path, _, _ in list(htmlcore.located(document.first("html"))):
        if n.element:
            n.attrs["data-cfi"] = f"epubcfi({base}{path})"
    return htmlcore.serialize(document)


def markers(html: str, base: str, step: int, carried: int = 0) -> dict:
    """A coordinate after every step characters of text, and the characters counted since the last one. The count runs on over texts, and from what a chapter before has carried."""
    out, count, base = [], carried, base.removesuffix("!")
    for n, path, i, _ in htmlcore.located(htmlcore.parse(html).first("html")):
        if not n.element:
            out += [f"epubcfi({base}!{path}/{i}:{k})" for k in range(step - count, len(n.data) + 1, step)]
            count = (count + len(n.data)) % step
    return {"markers": out, "carried": count}


def _edit(source: str, edits: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, new in sorted(edits):
        out += [source[at:a], new]
        at = b
    return "".join([*out, source[at:]])


def _set(tag: htmlcore.Tag, name: str, value: str) -> tuple[int, int, str]:
    a, b = tag.spans[name]
    return a, b, ("=" if a == b else "") + '"' + value.replace('"', "&quot;") + '"'


def rewrite_srcset(value: str, base: str, resolve: Callable[[str], str | None]) -> str:
    def one(candidate: str) -> str:
        url, *rest = candidate.split(None, 1) or [""]
        new = None if not url or _css.is_external(url) else resolve(_css.normalize(base, url))
        if new is None:
            return candidate
        trimmed = candidate.strip()
        return candidate[: len(candidate) - len(candidate.lstrip())] + new + trimmed[len(url) :]

    return ",".join(map(one, value.split(",")))


def rewrite_resources(html: str, path: str, resolve: Callable[[str], str | None]) -> str:
    """URLs of elements, style attributes and style blocks replaced by what resolve gives for their package path."""
    base, edits, sheet = _css.dir_of(path), [], None
    for kind, value, a, b in htmlcore.tokens(html):
        if kind == "text" and sheet and "url(" in value:
            edits.append((a, b, _css.rewrite(value, base, resolve)))
        sheet = kind == "start" and value.name == "style"
        if kind != "start":
            continue
        for name, keeps in URL_ATTRIBUTES.get(value.name, {}).items():
            old = value.attrs.get(name)
            if old is None or _css.is_external(old) or old.startswith("#"):
                continue
            own, mark, fragment = old.partition("#") if keeps else (old, "", "")
            if keeps and not own:
                continue
            new = resolve(_css.normalize(base, own))
            if new is not None:
                edits.append(_set(value, name, new + mark + fragment))
        old = value.attrs.get("srcset", "")
        if value.name in ("img", "video", "audio", "source", "track") and old.strip():
            new = rewrite_srcset(old, base, resolve)
            if new != old:
                edits.append(_set(value, "srcset", new))
        old = value.attrs.get("style", "")
        if "url(" in old:
            new = _css.rewrite(old, base, resolve)
            if new != old:
                edits.append(_set(value, "style", new))
    return _edit(html, edits)


def rewrite_links(html: str, resolve: Callable[[str], str | None]) -> str:
    """img src, a href and link href replaced by what resolve gives for the value as written."""
    edits = []
    for kind, value, _, _ in htmlcore.tokens(html):
        name = {"img": "src", "a": "href", "link": "href"}.get(value.name) if kind == "start" else None
        new = resolve(value.attrs[name]) if name in getattr(value, "attrs", {}) else None
        if new is not None:
            edits.append(_set(value, name, new))
    return _edit(html, edits)


def inject_head(html: str, content: str) -> str:
    """content put before the end of the head, as it is; without a head tag nothing changes."""
    inside = False
    for kind, value, a, _ in htmlcore.tokens(html):
        if kind == "start" and value.name == "head":
            inside = True
        elif inside and kind == "end" and value == "head":
            return html[:a] + content + html[a:]
    return html


def promote_styles(html: str) -> str:
    """Style sheet links whose href is a data URI become style elements; an empty sheet goes."""
    edits = []
    for kind, value, a, b in htmlcore.tokens(html):
        if kind != "start" or value.name != "link" or not re.search("stylesheet|text/css", html[a:b], re.I):
            continue
        href = value.attrs.get("href", "").strip()
        sheet = decode_data_uri(href) if href.lower().startswith("data:text/css") else None
        if sheet is not None:
            safe = re.sub("</style", lambda m: "<\\/" + m.group()[2:], sheet, flags=re.I)
            edits.append((a, b, f'<style type="text/css">\n{safe}\n</style>' if sheet.strip() else ""))
    return _edit(html, edits)


def decode_data_uri(uri: str) -> str | None:
    """A data URI's text; its percent decoding turns + into a blank."""
    import base64
    import binascii

    head, comma, body = uri.partition(",")
    if not comma:
        return None
    if head.lower().endswith(";base64"):
        try:
            return base64.b64decode("".join(body.split()), validate=True).decode("utf-8", "replace")
        except (binascii.Error, ValueError):
            return None
    return _css.decode_percent(body.replace("+", " "))


def _null(f: Callable) -> Callable:
    return lambda html, *a: None if html is None else f(html, *(x if x is not None else "" for x in a))


_BLOCK = "array<struct<text string, cfi_range string, tag_name string, language string>>"
html_text = Udf(_null(extract_text), "string")
html_blocks = Udf(_null(blocks), _BLOCK)
html_text_nodes = Udf(_null(text_nodes), "array<struct<path string, index int, text string>>")
html_annotate = Udf(_null(annotate), "string")
html_markers = Udf(lambda html, base, step, carried: None if html is None else markers(html, base or "", max(1, step or 1), carried or 0), "struct<markers array<string>, carried int>")
html_rewrite = Udf(lambda html, path, urls: None if html is None else rewrite_resources(html, path or "", (urls or {}).get), "string")
html_rewrite_links = Udf(lambda html, urls: None if html is None else rewrite_links(html, (urls or {}).get), "string")
html_inject_head = Udf(_null(inject_head), "string")
html_promote_styles = Udf(_null(promote_styles), "string")
html_search = Udf(lambda html, base, pattern, ignore: None if html is None else search(html, base or "", pattern or "", bool(ignore)), "array<struct<excerpt string, cfi string>>")


def script_and_style(script: Column | str, style: Column | str) -> Column:
    """What inject_head puts in for a script and a style sheet."""
    return F.concat(lit("<style>"), string(style), lit("</style>\n<script>"), string(script), lit("</script>"))


def inferred_properties(html: Column | str) -> Column:
    """Which of scripted, svg and mathml the markup shows; built-in functions only."""
    low = F.lower(string(html))
    return F.filter(F.array(*[F.when(low.contains(mark), lit(name)) for mark, name in (("<script", "scripted"), ("<svg", "svg"), ("<math", "mathml"))]), lambda x: x.isNotNull())


#: A name and a quoted value, wherever they stand; a value ends at either quote.
_QUOTED = r"""([\w:-]+)\s*=\s*["']([^"']+)["']"""
# The ends of the attribute names that refer to one file.
REFERRING = ("src", "href", "poster")


def _urls(text: Column) -> Column:
    """What stands in url(...), without blanks and quotes around it; with a quote inside it is no reference."""
    pieces = F.filter(F.slice(F.split(text, r"(?i)url\("), lit(2), F.length(text) + 1), lambda x: x.contains(")"))
    inner = F.transform(pieces, lambda x: F.btrim(F.substring_index(x, ")", 1), lit(" \t\r\n\f'\"")))
    return F.filter(inner, lambda x: ~x.rlike("['\"]"))


def local_references(html: Column | str, path: Column | str) -> Column:
    """Package paths that a chapter refers to: src, href and poster (also at the end of longer names), then srcset, then url(...). Quoted values only; external and fragment-only ones are left out. Built-in functions only."""
    h = string(html)
    pairs = F.zip_with(F.regexp_extract_all(h, lit(_QUOTED), lit(1)), F.regexp_extract_all(h, lit(_QUOTED), lit(2)), lambda n, v: F.struct(F.lower(n).alias("n"), v.alias("v")))
    ends = lambda names: F.transform(F.filter(pairs, lambda p: p["n"].rlike(f"({'|'.join(names)})$")), lambda p: p["v"])
    candidates = F.flatten(F.transform(ends(["srcset"]), lambda x: F.transform(F.split(x, ","), lambda c: F.substring_index(F.regexp_replace(F.trim(c), r"\s", " "), " ", 1))))
    every = F.transform(F.concat(ends(REFERRING), candidates, _urls(h)), lambda x: F.trim(x))
    local = F.filter(every, lambda x: (x != "") & ~x.startswith("#") & ~paths.is_external(x))
    return F.transform(local, lambda x: paths.normalize(paths.dir_of(path), x))
