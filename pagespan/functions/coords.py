"""Document coordinates (CFI): parsing, order, text form, XPath, ranges.

Parsing is an Arrow UDF, as the grammar has escapes inside brackets; all that follows works on the parsed struct with
built-in functions. The struct is

    kind ('point' | 'range'), parent, start, end: path      (a point has its path in parent)
    path: steps, local_steps (null without !), char_offset, side, temporal, spatial{x, y}
    step: index, assertion

Text that doesn't parse gives null. Assertions are unescaped and written back as they are, so those with marks of the
grammar don't come back the same; the ends of a parsed range resolve to the parent's path with their own offsets.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import Udf, lit, string

STEP = T.StructType([T.StructField("index", T.LongType()), T.StructField("assertion", T.StringType())])
PATH = T.StructType([
    T.StructField("steps", T.ArrayType(STEP)), T.StructField("local_steps", T.ArrayType(STEP)), T.StructField("char_offset", T.LongType()), T.StructField("side", T.StringType()),
    T.StructField("temporal", T.DoubleType()), T.StructField("spatial", T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])),
])
CFI = T.StructType([T.StructField("kind", T.StringType()), T.StructField("parent", PATH), T.StructField("start", PATH), T.StructField("end", PATH)])

_UNIT = re.compile(r"\^.|.", re.S)
_FLOAT = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_MAX = 2**32 - 1


class CfiError(ValueError):
    """The text is not a coordinate."""


def _whole(text: str) -> int:
    if not re.fullmatch(r"\+?[0-9]+", text) or int(text) > _MAX:
        raise CfiError(f"not a number: {text!r}")
    return int(text)


def _number(text: str) -> float:
    if not _FLOAT.fullmatch(text):
        raise CfiError(f"not a number: {text!r}")
    return float(text)


def _outside(text: str, marks: str, nested: bool):
    """Places of the marks that are neither escaped nor inside brackets."""
    depth = 0
    for m in _UNIT.finditer(text):
        u = m.group()
        if u == "[":
            depth = depth + 1 if nested else 1
        elif u == "]":
            depth = max(0, depth - 1)
        elif u in marks and not depth:
            yield m.start()


def _steps(text: str) -> list[dict]:
    out, index, assertion, inside = [], "", None, False
    opened = ""
    units = [*_UNIT.findall(text.removeprefix("/")), "/"] if text else []
    for u in units:
        literal = u[1:] if u[0] == "^" else None
        if literal is not None:
            if inside:
                opened += literal
            else:
                index += literal
        elif u == "/" and not inside:
            if index or assertion is not None:
                out.append({"index": _whole(index), "assertion": assertion})
            index, assertion = "", None
        elif u == "[" and not inside:
            inside, opened = True, opened if assertion is not None else ""
        elif u == "]" and inside:
            inside, assertion = False, opened
        elif inside:
            opened += u
        else:
            index += u
    if inside and index:  # an open bracket runs to the end and counts for nothing
        out.append({"index": _whole(index), "assertion": assertion})
    return out


def _path(text: str) -> dict:
    base, *rest = text.split("!")
    if len(rest) > 1:
        raise CfiError("more than one !")
    own = rest[0] if rest else base
    cut = next(_outside(own, ":~@", False), None)
    out = dict.fromkeys(("char_offset", "side", "temporal", "spatial"))
    spatial = None
    if cut is not None:
        mark, tail = own[cut], own[cut + 1 :]
        if mark == ":":
            head, colon, side = tail.rpartition(":")
            if colon and side in ("before", "after"):
                tail, out["side"] = head, side
            out["char_offset"] = _whole(tail)
        elif mark == "~":
            time, at, spatial_text = tail.partition("@")
            out["temporal"] = _number(time)
            spatial = spatial_text if at else None
        else:
            spatial = tail
        if spatial is not None:
            x, _, y = spatial.partition(":")
            out["spatial"] = {"x": _number(x), "y": _number(y)}
    local = _steps(own if cut is None else own[:cut])
    if rest:
        cut = next(_outside(base, ":~@", False), None)
        if cut is not None:
            _path(base)  # what it ends with must be sound but isn't kept
        return {"steps": _steps(base if cut is None else base[:cut]), "local_steps": local} | out
    return {"steps": local, "local_steps": None} | out


def parse(text: str) -> dict:
    """The struct as dicts; CfiError if the text is no coordinate."""
    text = text.strip()
    if not (text.startswith("epubcfi(") and text.endswith(")")):
        raise CfiError("no epubcfi(...)")
    inner = text[8:-1]
    cuts = [-1, *_outside(inner, ",", True), len(inner)]
    parts = [_path(inner[a + 1 : b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    if len(parts) == 1:
        return {"kind": "point", "parent": parts[0], "start": None, "end": None}
    if len(parts) == 3:
        return {"kind": "range", "parent": parts[0], "start": parts[1], "end": parts[2]}
    raise CfiError("neither a point nor a range")


def _try_parse(text: str | None) -> dict | None:
    try:
        return None if text is None else parse(text)
    except CfiError:
        return None


cfi_parse = Udf(_try_parse, CFI)


def number_text(x: Column) -> Column:
    """Whole numbers without a point, others in plain digits."""
    whole = x == F.floor(x)
    return F.when(whole, x.cast("decimal(38,0)").cast("string")).otherwise(F.rtrim(x.cast("decimal(38,15)").cast("string"), lit("0")))


def plain_number(x: float) -> str:
    return str(int(x)) if x == int(x) else format(Decimal(repr(x)), "f")


def _step_text(s: Column) -> Column:
    return F.concat(lit("/"), s["index"].cast("string"), F.coalesce(F.concat(lit("["), s["assertion"], lit("]")), lit("")))


def _steps_text(steps: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(steps, _step_text), ""), lit(""))


def path_text(p: Column) -> Column:
    spatial = F.when(p["spatial"].isNull(), lit("")).otherwise(F.concat(lit("@"), number_text(p["spatial"]["x"]), lit(":"), number_text(p["spatial"]["y"])))
    return F.concat(
        _steps_text(p["steps"]),
        F.when(p["local_steps"].isNull(), lit("")).otherwise(F.concat(lit("!"), _steps_text(p["local_steps"]))),
        F.coalesce(F.concat(lit(":"), p["char_offset"].cast("string")), lit("")),
        F.when(p["char_offset"].isNotNull() & p["side"].isNotNull(), F.concat(lit(":"), p["side"])).otherwise(lit("")),
        F.coalesce(F.concat(lit("~"), number_text(p["temporal"])), lit("")),
        spatial,
    )


def cfi_text(cfi: Column | str) -> Column:
    """The struct as text."""
    c = string(cfi)
    whole = F.concat(path_text(c["parent"]), lit(","), path_text(c["start"]), lit(","), path_text(c["end"]))
    return F.when(c.isNotNull(), F.concat(lit("epubcfi("), F.when(c["kind"] == "point", path_text(c["parent"])).otherwise(whole), lit(")")))


def _path_key(p: Column) -> Column:
    indexes = lambda steps: F.coalesce(F.transform(steps, lambda s: s["index"]), F.array().cast("array<bigint>"))
    return F.struct(indexes(p["steps"]).alias("steps"), indexes(p["local_steps"]).alias("local"), p["char_offset"].alias("offset"), p["temporal"].alias("temporal"), p["spatial"]["y"].alias("y"), p["spatial"]["x"].alias("x"))


def cfi_key(cfi: Column | str) -> Column:
    """Sorts as coordinates do: points before ranges, then step by step (a prefix first), offset (none first), time, y, x. Assertions and side don't count."""
    c = string(cfi)
    return F.struct((c["kind"] == "range").cast("int").alias("kind"), _path_key(c["parent"]).alias("parent"), _path_key(c["start"]).alias("start"), _path_key(c["end"]).alias("end"))


def cfi_compare(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1."""
    x, y = cfi_key(a), cfi_key(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def cfi_equal(a: Column | str, b: Column | str) -> Column:
    """Same key and same sides."""
    a, b = string(a), string(b)
    same = [a[p]["side"].eqNullSafe(b[p]["side"]) for p in ("parent", "start", "end")]
    return (cfi_key(a) == cfi_key(b)) & same[0] & same[1] & same[2]


def _child(index: Column) -> Column:
    """0-based position among elements (even steps) or texts (odd ones)."""
    half = F.floor(index / 2)
    return F.when(index % 2 == 1, half).otherwise(F.greatest(half - 1, lit(0))).cast("long")


def _resolved(spine: Column, p: Column) -> Column:
    """One end (steps, char_offset, side, temporal, spatial) resolved; null without steps."""
    steps = p["steps"]
    odd = lambda s: s["index"] % 2 == 1
    at = lambda s: (_child(s["index"]) + 1).cast("string")
    element = lambda s, name: F.when(s["assertion"].isNull(), F.concat(lit(name + "["), at(s), lit("]"))).otherwise(
        F.concat(lit(name + "[position()="), at(s), lit(" and @id='"), s["assertion"], lit("']"))
    )
    xpath = lambda name: F.array_join(F.concat(F.array(lit("."), lit(name)), F.transform(steps, lambda s: F.when(odd(s), F.concat(lit("text()["), at(s), lit("]"))).otherwise(element(s, name)))), "/")
    ids = F.filter(steps, lambda s: ~odd(s) & s["assertion"].isNotNull())
    decoded = F.transform(steps, lambda s: F.struct(F.when(odd(s), lit("text")).otherwise(lit("element")).alias("node_type"), _child(s["index"]).alias("index"), s["assertion"].alias("id")))
    value = F.struct(
        spine.alias("spine_index"), decoded.alias("steps"), p["char_offset"].alias("char_offset"), odd(F.element_at(steps, -1)).alias("is_text_node"), xpath("*").alias("xpath"),
        xpath("*[local-name()]").alias("xpath_ns_agnostic"), F.try_element_at(ids, lit(-1))["assertion"].alias("id_shortcut"), p["side"].alias("side"), p["temporal"].alias("temporal"), p["spatial"].alias("spatial"),
    )
    return F.when(F.size(F.coalesce(steps, F.array().cast(T.ArrayType(STEP)))) > 0, value)


def cfi_resolve(cfi: Column | str, full_range: bool = False) -> Column:
    """struct(start, end): spine index, decoded steps, XPath with and without namespaces, deepest id, offsets. Null without a local path. full_range: the steps of a range's ends count too."""
    c = string(cfi)
    parent = c["parent"]
    spine = F.coalesce(_child(F.try_element_at(parent["steps"], lit(2))["index"]), lit(0).cast("long"))
    none = F.array().cast(T.ArrayType(STEP))
    local = F.coalesce(parent["local_steps"], none)
    joined = lambda p: F.concat(local, F.coalesce(p["local_steps"], p["steps"] if full_range else none))
    end = lambda p, steps: F.struct(steps.alias("steps"), p["char_offset"].alias("char_offset"), F.coalesce(p["side"], parent["side"]).alias("side"), p["temporal"].alias("temporal"), p["spatial"].alias("spatial"))
    ends = F.when(c["kind"] == "point", F.array(end(parent, local))).otherwise(F.array(end(c["start"], joined(c["start"])), end(c["end"], joined(c["end"]))))
    # both ends go through one expression, and what it gives is bound to a name, so that the plan stays small
    both = F.transform(F.array(F.transform(ends, lambda p: _resolved(spine, p))), lambda r: F.when(F.get(r, lit(0)).isNotNull(), F.struct(F.get(r, lit(0)).alias("start"), F.get(r, lit(1)).alias("end"))))
    return F.get(both, lit(0))


def _common(a: Column, b: Column) -> Column:
    """How many leading steps have the same index."""
    same = F.transform(F.arrays_zip(F.transform(a, lambda s: s["index"]).alias("l"), F.transform(b, lambda s: s["index"]).alias("r")), lambda z: z["l"].eqNullSafe(z["r"]))
    first = F.array_position(same, lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def cfi_range(a: Column | str, b: Column | str) -> Column:
    """The range from one point to another; null for ranges. In one document the parent holds the !; across documents the ends do."""
    a, b = string(a)["parent"], string(b)["parent"]
    none = F.array().cast(T.ArrayType(STEP))
    la, lb = F.coalesce(a["local_steps"], none), F.coalesce(b["local_steps"], none)
    tail = lambda steps, n: _steps_text(F.slice(steps, n + 1, F.greatest(F.size(steps) - n, lit(0))))
    offset = lambda p: F.coalesce(F.concat(lit(":"), p["char_offset"].cast("string")), lit(""))
    n, m = _common(a["steps"], b["steps"]), _common(la, lb)
    shared = _steps_text(F.slice(a["steps"], lit(1), n))
    same = F.concat(lit("epubcfi("), shared, lit("!"), _steps_text(F.slice(la, lit(1), m)), lit(","), tail(la, m), offset(a), lit(","), tail(lb, m), offset(b), lit(")"))
    full = lambda p, local: F.concat(tail(p["steps"], n), lit("!"), _steps_text(local), offset(p))
    across = F.concat(lit("epubcfi("), shared, lit(","), full(a, la), lit(","), full(b, lb), lit(")"))
    return F.when((n == F.size(a["steps"])) & (n == F.size(b["steps"])), same).otherwise(across)


def cfi_range_of(a: Column | str, b: Column | str) -> Column:
    """cfi_range for parsed coordinates that may be ranges (then null)."""
    return F.when((string(a)["kind"] == "point") & (string(b)["kind"] == "point"), cfi_range(a, b))


def spine_base(spine_index: Column | str, item_id: Column | str) -> Column:
    """The base of a spine item's coordinates: /6/N[id]!."""
    return F.concat(lit("/6/"), ((string(spine_index) + 1) * 2).cast("string"), lit("["), string(item_id), lit("]!"))


def point(base: list[tuple[int, str | None]], local: list[tuple[int, str | None]] | None = None, char_offset: int | None = None) -> dict:
    """A point built from steps."""
    rows = lambda steps: [{"index": i, "assertion": a} for i, a in steps]
    path = {"steps": rows(base), "local_steps": None if local is None else rows(local), "char_offset": char_offset, "side": None, "temporal": None, "spatial": None}
    return {"kind": "point", "parent": path, "start": None, "end": None}
