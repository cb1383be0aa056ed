"""SQL names for the functions: scalar ones as session functions, and table functions for what finds several things."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import css, html, nav, xmlcore
from . import coords

_SCALARS = {
    "cfi_parse": coords.cfi_parse, "html_text": html.html_text, "html_blocks": html.html_blocks, "html_text_nodes": html.html_text_nodes, "html_annotate": html.html_annotate, "html_search": html.html_search, "html_markers": html.html_markers,
    "html_rewrite": html.html_rewrite, "html_rewrite_links": html.html_rewrite_links, "html_inject_head": html.html_inject_head, "html_promote_styles": html.html_promote_styles, "css_references": css.css_references,
    "css_rewrite": css.css_rewrite, "html_nav_nodes": nav.html_nav_nodes, "xml_ncx_nodes": nav.xml_ncx_nodes, "xml_smil_rows": nav.xml_smil_rows, "xml_rows": xmlcore.xml_rows,
}
# What SQL can express stays SQL: the optimiser sees through these.
_SQL = {
    "epub_position_count": ("n BIGINT, page INT", "BIGINT", "greatest((n + greatest(page, 1) - 1) div greatest(page, 1), 1)"),
    "epub_spine_base": ("i INT, id STRING", "STRING", "concat('/6/', (i + 1) * 2, '[', id, ']!')"),
    "epub_is_external": ("url STRING", "BOOLEAN", "url rlike '(?i)^\\\\s*(//|(https?|data|mailto|ftp|blob|javascript|file|about|chrome):)'"),
    "epub_join_path": ("base STRING, rel STRING", "STRING", "array_join(aggregate(split(concat_ws('/', base, rel), '/'), cast(array() as array<string>), (a, s) -> case when s in ('', '.') then a when s = '..' then slice(a, 1, greatest(size(a) - 1, 0)) else concat(a, array(s)) end), '/')"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers all of them for the session; their names."""
    for name, u in _SCALARS.items():
        spark.udf.register(name, F.udf(u.f, u.returns, useArrow=True))
    for name, (args, kind, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    for name, f, columns in (("epub_blocks", html.blocks, ("text", "cfi_range", "tag_name", "language")), ("epub_text_nodes", html.text_nodes, ("path", "index", "text"))):
        spark.udtf.register(name, F.udtf(_table(f, columns), returnType=", ".join(f"`{c}` {'int' if c == 'index' else 'string'}" for c in columns)))
    return [*_SCALARS, *_SQL, "epub_blocks", "epub_text_nodes"]


def _table(f, columns: tuple[str, ...]) -> type:
    class Rows:
        def eval(self, *args):
            if args[0] is not None:
                for r in f(*args):
                    yield tuple(r[c] for c in columns)

    return Rows
