"""XML without Spark: a document as rows, one for each element, by an event parser that minds no namespaces."""

from __future__ import annotations

from collections.abc import Callable
from xml.parsers import expat

from ..functions.types import Udf

ROW = "struct<ord int, parent int, depth int, name string, attrs map<string,string>, text string>"


def local(name: str) -> str:
    return name.rsplit(":", 1)[-1]


def _parse(xml: str | bytes, strict: bool, start: Callable[[str, dict], None], end: Callable[[str], None], data: Callable[[str], None] | None = None) -> None:
    """Not strict: what comes before an error has been handled."""
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    parser.SkippedEntityHandler = lambda name, is_parameter: None
    parser.UseForeignDTD(True)
    parser.ExternalEntityRefHandler = lambda *a: 1
    try:
        parser.Parse(xml if isinstance(xml, bytes) else xml.encode(), True)
    except expat.ExpatError as e:
        if strict:
            raise ValueError(f"not well-formed: {e}") from None


def rows(xml: str | bytes, strict: bool = True) -> list[dict]:
    """Elements in document order with the place of their parent, local name, attributes as written (decoded) and their own text. Not strict: what was read before an error."""
    out: list[dict] = []
    open_: list[int] = []

    def start(name: str, attrs: dict) -> None:
        out.append({"ord": len(out), "parent": open_[-1] if open_ else None, "depth": len(open_), "name": local(name), "attrs": attrs, "text": ""})
        open_.append(out[-1]["ord"])

    def data(text: str) -> None:
        if open_:
            out[open_[-1]]["text"] += text

    _parse(xml, strict, start, lambda name: open_.pop(), data)
    return out


def attr(attrs: dict, name: str) -> str | None:
    """An attribute by its name, or by that name after a prefix."""
    return attrs[name] if name in attrs else next((v for k, v in attrs.items() if k.endswith(":" + name)), None)


#: Elements inside EncryptedData that say something of it, with their attribute and the field that takes it.
_SAYS = {"EncryptionMethod": ("Algorithm", "algorithm_uri"), "CipherReference": ("URI", "uri"), "Compression": ("OriginalLength", "original_length")}


def encrypted(xml: bytes | None) -> list[dict]:
    """Each EncryptedData in document order with what the last element of each kind inside it says, in one pass; what was read before an error counts."""
    out: list[dict] = []
    open_: list[tuple[bool, dict]] = []  # of the elements that are open: whether each is an EncryptedData, and what has been said inside the innermost

    def start(name: str, attrs: dict) -> None:
        name, within = local(name), open_[-1][1] if open_ else None
        if within is not None and name in _SAYS:
            a, field = _SAYS[name]
            within[field] = attr(attrs, a)
        own = name == "EncryptedData"
        if own:
            out.append({"ord": len(out)})
        open_.append((own, out[-1] if own else within))

    def end(name: str) -> None:
        own, said = open_.pop()
        if own and open_ and open_[-1][1] is not None:
            open_[-1][1].update({k: v for k, v in said.items() if k != "ord"})  # it is inside the outer one as well

    try:
        _parse(bytes(xml or b""), False, start, end)
    except ValueError:
        return []
    while open_:
        end("")
    return [{"ord": x["ord"], **{field: x.get(field) for _, field in _SAYS.values()}} for x in out]


def _rows(xml: bytes | None) -> dict:
    if xml is None:
        return {"rows": None, "error": "missing"}
    try:
        return {"rows": rows(bytes(xml)), "error": None}
    except ValueError as e:
        return {"rows": None, "error": str(e)}


xml_rows = Udf(_rows, f"struct<rows array<{ROW}>, error string>")
xml_encrypted = Udf(encrypted, "array<struct<ord int, algorithm_uri string, uri string, original_length string>>")
