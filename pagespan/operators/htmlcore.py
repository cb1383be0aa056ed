"""HTML without Spark: a tokenizer, and a tree builder after the WHATWG rules (implied tags, paragraphs closed by blocks,
active formatting elements, the adoption agency, foster parents, raw text). Pure Python, for use inside UDFs and UDTFs.

The tokenizer alone keeps source positions, which the rewriting operators need; the tree is what coordinates refer to.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from html.entities import html5

from ..functions.deep import unwind

SPACE = " \t\n\r\f"
# Elements by how the tree rules treat them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("style script xmp iframe noembed noframes".split())
RC_TEXT = frozenset(("textarea", "title"))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul h1 h2 h3 h4 h5 h6 pre listing form table hr".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SPECIAL = CLOSES_P | frozenset(
    "applet area base basefont bgsound body br button caption col colgroup dd dt embed frame frameset head html iframe img input keygen li link marquee meta noembed noframes noscript object param plaintext script select source style tbody td template textarea tfoot th thead title tr track wbr xmp".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template".split())
BUTTON_SCOPE = SCOPE | {"button"}
LIST_SCOPE = SCOPE | {"ol", "ul"}
TABLE_SCOPE = frozenset(("html", "table", "template"))
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)", re.S)
_ATTR = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|[^\s>]*))?", re.S)
_END = re.compile(r"[\s/]*")
_AMP = re.compile(r"&(?:#[xX][0-9A-Fa-f]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;?)(=?)")


def decode(text: str) -> str:
    """Character references of text."""
    return _html.unescape(text) if "&" in text else text


def decode_attribute(text: str) -> str:
    """References of an attribute's value: a name without its semicolon stays if a letter, a digit or = follows."""
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        raw, equals = m.group()[: len(m.group()) - len(m.group(1))], m.group(1)
        if raw[1] == "#" or raw.endswith(";"):
            return _html.unescape(raw) + equals
        return raw + equals if equals or raw[1:] not in html5 else html5[raw[1:]]

    return _AMP.sub(one, text)


class Tag:
    """A start tag with the places of its parts in the source."""

    __slots__ = ("attrs", "close", "end", "name", "spans", "start")

    def __init__(self, name: str, attrs: dict[str, str], close: bool, start: int, end: int, spans: dict[str, tuple[int, int]]):
        self.name, self.attrs, self.close, self.start, self.end, self.spans = name, attrs, close, start, end, spans


def tokens(source: str):
    """(kind, value, start, end): kind start (a Tag), end (a name), text (raw), comment, doctype. Raw-text elements give their content as one text."""
    at, n = 0, len(source)
    lower = None
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            yield "text", source[at:], at, n
            return
        m = _TAG.match(source, lt)
        if m is None:
            if source.startswith("<!--", lt):
                if source.startswith(("<!-->", "<!--->"), lt):
                    stop = source.index(">", lt) + 1
                    body = ""
                else:
                    ends = [(x, k) for k in ("-->", "--!>") if (x := source.find(k, lt + 4)) >= 0]
                    x, k = min(ends) if ends else (n, "")
                    stop, body = x + len(k), source[lt + 4 : x]
                kind = "comment"
            elif source.startswith(("<!", "<?", "</"), lt) and lt + 2 <= n and not (source.startswith("</", lt) and lt + 2 == n):
                gt = source.find(">", lt)
                stop = n if gt < 0 else gt + 1
                body = source[lt + 2 : stop - (gt >= 0)]
                kind = "doctype" if body[:7].lower() == "doctype" and source[lt + 1] == "!" else "comment"
                if source.startswith("</>", lt):
                    kind, body = "nothing", ""
            else:
                nxt = source.find("<", lt + 1)
                stop = n if nxt < 0 else nxt
                yield "text", source[at:stop], at, stop
                at = stop
                continue
            if lt > at:
                yield "text", source[at:lt], at, lt
            if kind != "nothing":
                yield kind, body, lt, stop
            at = stop
            continue
        if lt > at:
            yield "text", source[at:lt], at, lt
        close, name = m.group(1) == "/", m.group(2).lower()
        pos, attrs, spans, slash = m.end(), {}, {}, False
        while True:
            gap = _END.match(source, pos)
            slash = gap.group().endswith("/")
            pos = gap.end()
            if pos >= n:
                return  # cut off inside a tag: nothing is emitted
            if source[pos] == ">":
                pos += 1
                break
            a = _ATTR.match(source, pos)
            key, value = a.group(1).lower(), a.group(2)
            if value is None:
                value, span = "", (a.end(1), a.end(1))
            elif value[:1] in ('"', "'"):
                quoted = len(value) > 1 and value[-1] == value[0]
                span, value = a.span(2), value[1 : -1 if quoted else None]
                if not quoted:
                    return
            else:
                span = a.span(2)
            if key not in attrs:
                attrs[key], spans[key] = value, span
            pos = a.end()
        if close:
            yield "end", name, lt, pos
            at = pos
            continue
        yield "start", Tag(name, attrs, slash, lt, pos, spans), lt, pos
        at = pos
        if name in RAW_TEXT or name in RC_TEXT:
            lower = source.lower() if lower is None or len(lower) != n else lower
            stop = at
            while True:
                stop = lower.find("</" + name, stop)
                if stop < 0 or stop + 2 + len(name) >= n or lower[stop + 2 + len(name)] in SPACE + "/>":
                    break
                stop += 1
            stop = n if stop < 0 else stop
            if stop > at:
                yield "text", source[at:stop], at, stop
            at = stop
        elif name == "plaintext":
            yield "text", source[at:], at, n
            return


class Node:
    """An element, or a text (name '#text') or comment ('#comment') with its data."""

    __slots__ = ("attrs", "children", "data", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, data: str = ""):
        self.name, self.attrs, self.data, self.children, self.parent = name, attrs if attrs is not None else {}, data, [], None

    @property
    def element(self) -> bool:
        return self.name[0] != "#"

    def detach(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None

    def insert(self, child: Node, before: Node | None = None) -> None:
        child.detach()
        child.parent = self
        if before is None:
            self.children.append(child)
        else:
            self.children.insert(self.children.index(before), child)

    def add_text(self, text: str, before: Node | None = None) -> None:
        at = len(self.children) if before is None else self.children.index(before)
        if at and self.children[at - 1].name == "#text":
            self.children[at - 1].data += text
        else:
            self.insert(Node("#text", data=text), before)

    def walk(self):
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(reversed(n.children))

    def text(self) -> str:
        return "".join(n.data for n in self.walk() if n.name == "#text")

    def first(self, name: str) -> Node | None:
        return next((n for n in self.walk() if n.name == name and n is not self), None)


_MARK = object()


class Builder:
    """Builds the tree of one document."""

    def __init__(self) -> None:
        self.document = Node("#document")
        self.stack: list[Node] = []
        self.active: list = []
        self.mode, self.head, self.form = "before_html", None, None
        self.foster = self.frameset_ok = False
        self.skip_newline = False
        self.quirks = True  # until a doctype says otherwise

    # --- the stack of open elements
    @property
    def current(self) -> Node:
        return self.stack[-1]

    def has(self, names, scope=SCOPE) -> bool:
        names = {names} if isinstance(names, str) else names
        for n in reversed(self.stack):
            if n.name in names:
                return True
            if n.name in scope:
                return False
        return False

    def pop_to(self, names) -> None:
        names = {names} if isinstance(names, str) else names
        while self.stack:
            if self.stack.pop().name in names:
                return

    def imply(self, but: str = "") -> None:
        while self.current.name in IMPLIED_END and self.current.name != but:
            self.stack.pop()

    def close_p(self) -> None:
        if self.has("p", BUTTON_SCOPE):
            self.imply("p")
            self.pop_to("p")

    # --- insertion
    def place(self) -> tuple[Node, Node | None]:
        target = self.current
        if self.foster and target.name in ("table", "tbody", "tfoot", "thead", "tr"):
            table = next((n for n in reversed(self.stack) if n.name in ("table", "template")), None)
            if table is None:
                return self.stack[0], None
            if table.name == "template":
                return table, None
            if table.parent is not None:
                return table.parent, table
            return self.stack[self.stack.index(table) - 1], None
        return target, None

    def element(self, tag: Tag, push: bool = True) -> Node:
        node = Node(tag.name, {k: decode_attribute(v) for k, v in tag.attrs.items()})
        parent, before = self.place()
        parent.insert(node, before)
        if push:
            self.stack.append(node)
        return node

    def characters(self, text: str) -> None:
        parent, before = self.place()
        parent.add_text(text, before)

    def implied(self, name: str) -> Node:
        return self.element(Tag(name, {}, False, 0, 0, {}))

    # --- active formatting elements
    def remember(self, node: Node) -> None:
        same = 0
        for e in reversed(self.active):
            if e is _MARK:
                break
            if e.name == node.name and e.attrs == node.attrs:
                same += 1
                if same == 3:
                    self.active.remove(e)
                    break
        self.active.append(node)

    def reconstruct(self) -> None:
        if not self.active or self.active[-1] is _MARK or self.active[-1] in self.stack:
            return
        i = len(self.active) - 1
        while i > 0 and self.active[i - 1] is not _MARK and self.active[i - 1] not in self.stack:
            i -= 1
        for j in range(i, len(self.active)):
            old = self.active[j]
            node = Node(old.name, dict(old.attrs))
            parent, before = self.place()
            parent.insert(node, before)
            self.stack.append(node)
            self.active[j] = node

    def clear_to_mark(self) -> None:
        while self.active and self.active.pop() is not _MARK:
            pass

    def adopt(self, name: str) -> None:
        if self.current.name == name and self.current not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            fmt = None
            for e in reversed(self.active):
                if e is _MARK:
                    break
                if e.name == name:
                    fmt = e
                    break
            if fmt is None:
                self.any_end(name)
                return
            if fmt not in self.stack:
                self.active.remove(fmt)
                return
            if not self.has_node(fmt):
                return
            at = self.stack.index(fmt)
            block = next((n for n in self.stack[at + 1 :] if n.name in SPECIAL), None)
            if block is None:
                del self.stack[at:]
                self.active.remove(fmt)
                return
            ancestor, mark = self.stack[at - 1], self.active.index(fmt)
            node = last = block
            i = self.stack.index(node)
            inner = 0
            while True:
                inner += 1
                i -= 1
                node = self.stack[i]
                if node is fmt:
                    break
                if inner > 3 and node in self.active:
                    k = self.active.index(node)
                    if k < mark:
                        mark -= 1
                    self.active.pop(k)
                if node not in self.active:
                    self.stack.pop(i)
                    continue
                fresh = Node(node.name, dict(node.attrs))
                self.active[self.active.index(node)] = fresh
                self.stack[i] = fresh
                if last is block:
                    mark = self.active.index(fresh) + 1
                fresh.insert(last)
                last = fresh
            last.detach()
            if ancestor.name in ("table", "tbody", "tfoot", "thead", "tr"):
                self.foster, kept = True, self.foster
                self.stack.append(ancestor)
                parent, before = self.place()
                self.stack.pop()
                self.foster = kept
                parent.insert(last, before)
            else:
                ancestor.insert(last)
            fresh = Node(fmt.name, dict(fmt.attrs))
            for c in list(block.children):
                fresh.insert(c)
            block.insert(fresh)
            k = self.active.index(fmt)
            if k < mark:
                mark -= 1
            self.active.pop(k)
            self.active.insert(mark, fresh)
            self.stack.remove(fmt)
            self.stack.insert(self.stack.index(block) + 1, fresh)

    def has_node(self, node: Node) -> bool:
        for n in reversed(self.stack):
            if n is node:
                return True
            if n.name in SCOPE:
                return False
        return False

    def any_end(self, name: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name == name:
                self.imply(name)
                del self.stack[i:]
                return
            if self.stack[i].name in SPECIAL:
                return

    # --- the modes
    def feed(self, source: str) -> Node:
        for kind, value, _, _ in tokens(source):
            if kind == "text":
                raw = value.replace("\r\n", "\n").replace("\r", "\n")
                self.text(raw if self.stack and self.current.name in RAW_TEXT else decode(raw))
            elif kind == "start":
                self.start(value)
            elif kind == "end":
                self.end(value)
            elif kind == "comment":
                self.comment(value)
            elif self.mode == "before_html":
                self.quirks = value[7:].strip().lower().split(" ")[0] != "html"
        if self.mode in ("before_html", "before_head", "in_head", "after_head"):
            self.ensure_body()
        return self.document

    def comment(self, data: str) -> None:
        node = Node("#comment", data=data)
        if self.mode in ("before_html", "after_after_body"):
            self.document.insert(node)
        elif self.mode == "after_body":
            self.stack[0].insert(node)
        else:
            parent, before = self.place()
            parent.insert(node, before)

    def ensure_html(self) -> None:
        if self.mode == "before_html":
            node = Node("html")
            self.document.insert(node)
            self.stack.append(node)
            self.mode = "before_head"

    def ensure_head(self) -> None:
        self.ensure_html()
        if self.mode == "before_head":
            self.head = self.implied("head")
            self.mode = "in_head"

    def leave_head(self) -> None:
        self.ensure_head()
        if self.mode == "in_head":
            self.pop_to("head")
            self.mode = "after_head"

    def ensure_body(self) -> None:
        if self.mode in ("before_html", "before_head", "in_head", "after_head"):
            self.leave_head()
            self.implied("body")
            self.mode = "in_body"

    def text(self, text: str) -> None:
        text = text.replace("\0", "")
        if not text:
            return
        if self.stack and (self.current.name in RAW_TEXT or self.current.name in RC_TEXT):
            if self.skip_newline and text[0] == "\n":
                text = text[1:]
            self.skip_newline = False
            if text:
                self.current.add_text(text)
            return
        if self.skip_newline:
            self.skip_newline = False
            text = text[1:] if text[0] == "\n" else text
            if not text:
                return
        if self.mode in ("before_html", "before_head"):
            text = text.lstrip(SPACE)
            if not text:
                return
            self.ensure_head()
        if self.mode in ("in_head", "after_head"):
            rest = text.lstrip(SPACE)
            if len(rest) < len(text):
                self.current.add_text(text[: len(text) - len(rest)])
            if not rest:
                return
            self.ensure_body()
            text = rest
        if self.mode in ("after_body", "after_after_body") and text.strip(SPACE):
            self.mode = "in_body"
        if self.current.name in ("table", "tbody", "tfoot", "thead", "tr"):
            if not text.strip(SPACE):
                self.current.add_text(text)
                return
            self.foster = True
            self.reconstruct()
            self.characters(text)
            self.foster = False
            return
        if self.current.name == "colgroup":
            if not text.strip(SPACE):
                self.current.add_text(text)
                return
            self.stack.pop()
        self.reconstruct()
        self.characters(text)

    def start(self, tag: Tag) -> None:
        name = tag.name
        self.skip_newline = False
        if name == "html":
            if self.mode == "before_html":
                node = Node("html", {k: decode_attribute(v) for k, v in tag.attrs.items()})
                self.document.insert(node)
                self.stack.append(node)
                self.mode = "before_head"
            else:
                for k, v in tag.attrs.items():
                    self.stack[0].attrs.setdefault(k, decode_attribute(v))
            return
        if self.mode in ("before_html", "before_head"):
            self.ensure_html()
            if name == "head":
                self.head = self.element(tag)
                self.mode = "in_head"
                return
            self.ensure_head()
        if self.mode == "in_head":
            if name in IN_HEAD:
                self.in_head(tag)
                return
            if name == "head":
                return
            self.leave_head()
        if self.mode == "after_head":
            if name == "body":
                self.element(tag)
                self.mode = "in_body"
                return
            if name == "head":
                return
            if name in IN_HEAD and name != "noscript":
                self.stack.append(self.head)
                depth = len(self.stack)
                self.in_head(tag)
                if len(self.stack) == depth:
                    self.stack.remove(self.head)
                else:  # raw text: the head leaves the stack with its child's end
                    self.stack.remove(self.head)
                return
            self.ensure_body()
        if self.mode in ("after_body", "after_after_body"):
            self.mode = "in_body"
        self.in_body(tag)

    def in_head(self, tag: Tag) -> None:
        name = tag.name
        if name in ("base", "basefont", "bgsound", "link", "meta"):
            self.element(tag, push=False)
        else:
            self.element(tag)

    def in_body(self, tag: Tag) -> None:
        name, table = tag.name, self.table_context()
        if table and self.in_table(tag):
            return
        if name == "body":
            if len(self.stack) > 1 and self.stack[1].name == "body":
                for k, v in tag.attrs.items():
                    self.stack[1].attrs.setdefault(k, decode_attribute(v))
            return
        if name in ("head", "frameset", "frame"):
            return
        fostering = self.current.name in ("table", "tbody", "tfoot", "thead", "tr") and name not in ("style", "script", "template")
        self.foster, kept = self.foster or fostering, self.foster
        try:
            self.body_start(tag)
        finally:
            self.foster = kept

    def body_start(self, tag: Tag) -> None:
        name = tag.name
        if name in IN_HEAD and name != "noscript":
            self.in_head(tag)
        elif name in HEADINGS:
            self.close_p()
            if self.current.name in HEADINGS:
                self.stack.pop()
            self.element(tag)
        elif name in ("pre", "listing"):
            self.close_p()
            self.element(tag)
            self.skip_newline = True
        elif name == "form":
            if self.form is None:
                self.close_p()
                self.form = self.element(tag)
        elif name == "li":
            self.list_item(("li",))
            self.element(tag)
        elif name in ("dd", "dt"):
            self.list_item(("dd", "dt"))
            self.element(tag)
        elif name == "plaintext":
            self.close_p()
            self.element(tag)
        elif name == "hr":
            self.close_p()
            self.element(tag, push=False)
        elif name == "table":
            if not self.quirks:
                self.close_p()
            self.element(tag)
        elif name in CLOSES_P:
            self.close_p()
            self.element(tag)
        elif name == "button":
            if self.has("button"):
                self.imply()
                self.pop_to("button")
            self.reconstruct()
            self.element(tag)
        elif name == "a":
            old = next((e for e in reversed(self.active[self.last_mark() :]) if e is not _MARK and e.name == "a"), None)
            if old is not None:
                self.adopt("a")
                if old in self.active:
                    self.active.remove(old)
                if old in self.stack:
                    self.stack.remove(old)
            self.reconstruct()
            self.remember(self.element(tag))
        elif name == "nobr":
            self.reconstruct()
            if self.has("nobr"):
                self.adopt("nobr")
                self.reconstruct()
            self.remember(self.element(tag))
        elif name in FORMATTING:
            self.reconstruct()
            self.remember(self.element(tag))
        elif name in ("applet", "marquee", "object"):
            self.reconstruct()
            self.element(tag)
            self.active.append(_MARK)
        elif name == "image":
            self.reconstruct()
            self.element(Tag("img", tag.attrs, tag.close, tag.start, tag.end, tag.spans), push=False)
        elif name in ("area", "br", "embed", "img", "keygen", "wbr", "input"):
            self.reconstruct()
            self.element(tag, push=False)
        elif name in ("param", "source", "track", "col"):
            if name != "col":
                self.element(tag, push=False)
        elif name == "textarea":
            self.element(tag)
            self.skip_newline = True
        elif name == "xmp":
            self.close_p()
            self.reconstruct()
            self.element(tag)
        elif name in ("iframe", "noembed"):
            self.element(tag)
        elif name == "select":
            self.reconstruct()
            self.element(tag)
        elif name in ("optgroup", "option"):
            if self.current.name == "option":
                self.stack.pop()
            if name == "optgroup" and self.current.name == "optgroup":
                self.stack.pop()
            self.reconstruct()
            self.element(tag)
        elif name in ("rb", "rtc", "rp", "rt"):
            if self.has("ruby"):
                self.imply("rtc" if name in ("rp", "rt") else "")
            self.element(tag)
        elif name in ("math", "svg"):
            self.reconstruct()
            self.element(tag, push=not tag.close)
        elif name in TABLE_PARTS:
            return
        else:
            self.reconstruct()
            foreign = any(n.name in ("svg", "math") for n in self.stack)
            self.element(tag, push=not (foreign and tag.close))

    def last_mark(self) -> int:
        return max((i + 1 for i, e in enumerate(self.active) if e is _MARK), default=0)

    def list_item(self, names: tuple[str, ...]) -> None:
        for n in reversed(self.stack):
            if n.name in names:
                self.imply(n.name)
                self.pop_to(n.name)
                break
            if n.name in SPECIAL and n.name not in ("address", "div", "p"):
                break
        self.close_p()

    # --- tables
    def table_context(self) -> bool:
        return any(n.name == "table" for n in self.stack)

    def clear_to(self, names: set[str]) -> None:
        while self.current.name not in names:
            self.stack.pop()

    def in_table(self, tag: Tag) -> bool:
        """Table parts; True if the tag is dealt with."""
        name = tag.name
        inside = next((n.name for n in reversed(self.stack) if n.name in ("table", "caption", "td", "th", "template")), "")
        if name in TABLE_PARTS:
            if inside in ("caption", "td", "th"):
                self.imply()
                self.pop_to(inside)
                self.clear_to_mark()
            if not self.has("table", TABLE_SCOPE):
                return True
            if name in ("caption", "colgroup", "tbody", "tfoot", "thead"):
                self.clear_to({"table", "template", "html"})
            elif name == "col":
                if self.current.name != "colgroup":
                    self.clear_to({"table", "template", "html"})
                    self.implied("colgroup")
                self.element(tag, push=False)
                return True
            elif name == "tr":
                self.clear_to({"tbody", "tfoot", "thead", "table", "template", "html"})
                if self.current.name == "table":
                    self.implied("tbody")
            else:
                self.clear_to({"tr", "tbody", "tfoot", "thead", "table", "template", "html"})
                if self.current.name == "table":
                    self.implied("tbody")
                if self.current.name != "tr":
                    self.implied("tr")
            self.element(tag)
            if name in ("caption", "td", "th"):
                self.active.append(_MARK)
            return True
        if name == "table" and inside == "table":
            self.pop_to("table")
            return False
        return False

    # --- end tags
    def end(self, name: str) -> None:
        self.skip_newline = False
        if self.mode in ("before_html", "before_head", "in_head", "after_head"):
            if self.stack and self.current.name == name and (name in RAW_TEXT or name in RC_TEXT or name in ("noscript", "template")):
                self.stack.pop()
                return
            if self.mode == "in_head" and name == "head":
                self.leave_head()
                return
            if name not in ("head", "body", "html", "br"):
                return
            self.ensure_body() if self.mode == "after_head" or name in ("body", "html", "br") else self.leave_head()
        if self.stack and self.current.name == name and (name in RAW_TEXT or name in RC_TEXT):
            self.stack.pop()
            return
        if name in ("body", "html"):
            if self.mode == "in_body":
                self.mode = "after_body"
            elif self.mode == "after_body" and name == "html":
                self.mode = "after_after_body"
            return
        if self.mode in ("after_body", "after_after_body"):
            self.mode = "in_body"
        if name in ("table", "caption", "tbody", "tfoot", "thead", "tr", "td", "th", "colgroup"):
            if self.has(name, TABLE_SCOPE):
                self.imply()
                self.pop_to(name)
                if name in ("td", "th", "caption"):
                    self.clear_to_mark()
            return
        if name == "p":
            if not self.has("p", BUTTON_SCOPE):
                self.implied("p")
            self.imply("p")
            self.pop_to("p")
        elif name == "li":
            if self.has("li", LIST_SCOPE):
                self.imply("li")
                self.pop_to("li")
        elif name in ("dd", "dt"):
            if self.has(name):
                self.imply(name)
                self.pop_to(name)
        elif name in HEADINGS:
            if self.has(HEADINGS):
                self.imply()
                self.pop_to(HEADINGS)
        elif name == "form":
            node, self.form = self.form, None
            if node is not None and self.has_node(node):
                self.imply()
                self.stack.remove(node)
        elif name in FORMATTING:
            self.adopt(name)
        elif name in ("applet", "marquee", "object"):
            if self.has(name):
                self.imply()
                self.pop_to(name)
                self.clear_to_mark()
        elif name == "br":
            self.reconstruct()
            self.element(Tag("br", {}, False, 0, 0, {}), push=False)
        elif name in CLOSES_P or name in ("button", "select"):
            if self.has(name):
                self.imply()
                self.pop_to(name)
        else:
            self.any_end(name)


def parse(source: str) -> Node:
    """The document's tree; it always has html, head and body."""
    return Builder().feed(source)


_ESCAPES = {"&": "&amp;", " ": "&nbsp;", "<": "&lt;", ">": "&gt;"}


def serialize(node: Node) -> str:
    """Children of a node as HTML."""
    out: list[str] = []

    def one(n: Node) -> Iterator:
        if n.name == "#text":
            raw = n.parent is not None and (n.parent.name in RAW_TEXT or n.parent.name in ("noscript", "plaintext"))
            out.append(n.data if raw else re.sub("[& <>]", lambda m: _ESCAPES[m.group()], n.data))
        elif n.name == "#comment":
            out.append(f"<!--{n.data}-->")
        else:
            attrs = "".join(f' {k}="{escape_attribute(v)}"' for k, v in n.attrs.items())
            out.append(f"<{n.name}{attrs}>")
            if n.name in VOID:
                return
            for c in n.children:
                yield one(c)
            out.append(f"</{n.name}>")

    for c in node.children:
        unwind(one(c))
    return "".join(out)


def escape_attribute(value: str) -> str:
    return value.replace("&", "&amp;").replace(" ", "&nbsp;").replace('"', "&quot;")


def child_path(path: str, index: int, node: Node) -> str:
    """The coordinate step of an element: even index, its id in brackets."""
    own = node.attrs.get("id")
    return f"{path}/{index}[{own}]" if own else f"{path}/{index}"


def located(root: Node, path: str = ""):
    """(node, path, index, enclosing path) of all elements and texts below root, in document order. A text's index is odd: one more than twice the elements before it."""
    stack = [iter(_numbered(root, path))]
    while stack:
        got = next(stack[-1], None)
        if got is None:
            stack.pop()
            continue
        yield got
        if got[0].element:
            stack.append(iter(_numbered(got[0], got[1])))


def _numbered(node: Node, path: str):
    index = 0
    for c in node.children:
        if c.element:
            index += 2
            yield c, child_path(path, index, c), index, path
        elif c.name == "#text":
            yield c, path, index + 1, path
