"""Paths inside a package, media types and data URIs as Column expressions: nothing here leaves the JVM.

Paths use forward slashes and are relative to the package root; base is the directory of the referring file.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import lit, string

# Schemes that are not package paths.
SCHEMES = ("http", "https", "data", "mailto", "ftp", "blob", "javascript", "file", "about", "chrome")
# Media type by extension, for manifest and archive entries.
MIME = {
    "xhtml": "application/xhtml+xml", "html": "application/xhtml+xml", "htm": "application/xhtml+xml", "xml": "application/xml", "xsl": "application/xml", "opf": "application/xml",
    "ncx": "application/x-dtbncx+xml", "smil": "application/smil+xml", "pls": "application/pls+xml", "css": "text/css", "js": "application/javascript", "txt": "text/plain", "vtt": "text/vtt",
    "json": "application/json", "map": "application/json", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp",
    "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "ico": "image/x-icon", "woff": "font/woff", "woff2": "font/woff2", "ttf": "font/ttf", "otf": "font/otf", "mp3": "audio/mpeg",
    "m4a": "audio/mp4", "m4b": "audio/mp4", "mp4": "video/mp4", "ogg": "audio/ogg", "opus": "audio/opus", "wav": "audio/wav",
}
# The shorter table used where resources are inlined.
INLINE_MIME = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "jpe": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "svgz": "image/svg+xml", "css": "text/css",
    "ttf": "font/ttf", "otf": "font/otf", "woff": "font/woff", "woff2": "font/woff2", "mp3": "audio/mpeg", "mp4": "video/mp4", "xhtml": "application/xhtml+xml", "html": "application/xhtml+xml", "htm": "application/xhtml+xml",
}
OCTETS = "application/octet-stream"
# Older font types that may be inlined.
LEGACY_FONTS = ("application/font-woff", "application/font-woff2", "application/vnd.ms-opentype", "application/x-font-ttf", "application/x-font-opentype")


def is_external(url: Column | str) -> Column:
    """True for URLs that don't point into the package."""
    return string(url).rlike(r"(?i)^\s*(//|(" + "|".join(SCHEMES) + "):)")


def fold(segments: Column) -> Column:
    """Segments to a path: empty ones and dots go, two dots take the last one back, never above the root."""
    empty = F.array().cast("array<string>")
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, lit(1), F.greatest(F.size(acc) - 1, lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(segments, empty, step), "/")


def join_path(base: Column | str, rel: Column | str) -> Column:
    """base and rel folded together; no decoding, ? and # stay."""
    return fold(F.split(F.concat_ws("/", string(base), string(rel)), "/"))


def before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def percent_decode(text: Column | str) -> Column:
    """Percent escapes to text; + and malformed escapes stay as they are."""
    safe = F.replace(F.regexp_replace(string(text), "%(?![0-9A-Fa-f]{2})", "%25"), lit("+"), lit("%2B"))
    return F.when(string(text).contains("%"), F.url_decode(safe)).otherwise(string(text))


def normalize(base: Column | str, rel: Column | str) -> Column:
    """A reference's package path: cut at ? and then #, decoded, folded."""
    return join_path(base, percent_decode(before(before(string(rel), "?"), "#")))


def resolve_href(base: Column | str, href: Column | str) -> Column:
    """href against base with its fragment kept; external, fragment-only and empty hrefs, and any against an empty base, stay as they are."""
    base, href = string(base), string(href)
    cut = F.instr(href, "#")
    fragment = F.when(cut > 0, F.substr(href, cut)).otherwise(lit(""))
    return F.when(href.startswith("#") | is_external(href) | (href == "") | (base == ""), href).otherwise(F.concat(join_path(base, before(href, "#")), fragment))


def dir_of(path: Column | str) -> Column:
    """The directory part, empty at the root."""
    return F.regexp_extract(string(path), "(?s)^(.*)/", 1)


def name_of(path: Column | str) -> Column:
    return F.substring_index(string(path), "/", -1)


def relative_path(source: Column | str, target: Column | str) -> Column:
    """From one file of the package to another."""
    parts = lambda p: F.filter(F.split(dir_of(p), "/"), lambda s: s != "")
    a, b = parts(source), parts(target)
    same = F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.struct(lit(0).alias("n"), lit(True).alias("on")), lambda acc, x: F.struct((acc["n"] + (acc["on"] & x).cast("int")).alias("n"), (acc["on"] & x).alias("on")), lambda acc: acc["n"])
    up = F.array_repeat(lit(".."), F.size(a) - same)
    return F.array_join(F.concat(up, F.slice(b, same + 1, F.size(b)), F.array(name_of(target))), "/")


def chapter_href(chapter: Column | str, href: Column | str) -> Column:
    """A link of a chapter as a package path: external and fragment-only ones stay, an empty one is the chapter, a leading slash is the root."""
    chapter, href = string(chapter), string(href)
    clean = before(before(href, "?"), "#")
    own = before(before(chapter, "?"), "#")
    return (
        F.when(href.startswith("#") | is_external(href), href)
        .when(clean == "", own)
        .when(clean.startswith("/"), normalize(lit(""), clean))
        .otherwise(normalize(dir_of(chapter), clean))
    )


def _lookup(table: dict[str, str], key: Column) -> Column:
    found = F.create_map(*[lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(found, key), lit(OCTETS))


def mime_for_path(path: Column | str) -> Column:
    """By the extension of the file name, without query and fragment; unknown, missing or over 16 characters: octets."""
    name = name_of(before(before(string(path), "?"), "#"))
    extension = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(lit(""))
    return F.when((F.length(extension) > 16) | (extension == ""), lit(OCTETS)).otherwise(_lookup(MIME, extension))


def guess_media_type(path: Column | str) -> Column:
    """By the inlining table; a path without a dot counts as an extension."""
    return _lookup(INLINE_MIME, F.lower(F.substring_index(string(path), ".", -1)))


def resolve_media_type(path: Column | str, declared: Column | str) -> Column:
    declared = string(declared)
    blank = declared.isNull() | (F.trim(declared) == "") | (declared == OCTETS)
    return F.when(blank, guess_media_type(path)).otherwise(declared)


def inlineable(media_type: Column | str) -> Column:
    m = string(media_type)
    return m.startswith("image/") | m.startswith("font/") | m.startswith("audio/") | (m == "text/css") | m.isin(*LEGACY_FONTS)


def data_uri(media_type: Column | str, content: Column | str) -> Column:
    content = F.col(content) if isinstance(content, str) else content
    return F.concat(lit("data:"), string(media_type), lit(";base64,"), F.replace(F.base64(content), lit("\r\n"), lit("")))


def escapes_root(path: Column | str) -> Column:
    """True if a path, as written, would leave the folder it is joined to at any point, or is absolute."""
    step = lambda low, s: F.struct((low["d"] + F.when(s.isin("", "."), 0).when(s == "..", -1).otherwise(1)).alias("d"), (low["out"] | ((s == "..") & (low["d"] <= 0))).alias("out"))
    out = F.aggregate(F.split(string(path), "/"), F.struct(lit(0).alias("d"), lit(False).alias("out")), step, lambda a: a["out"])
    return out | string(path).startswith("/") | string(path).rlike(r"^[A-Za-z]:|\\")
