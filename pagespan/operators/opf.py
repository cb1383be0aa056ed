"""Package documents: renditions, manifest, spine, guide, metadata, accessibility, encryption.

An event parser turns the XML into an array of element rows once; all that follows is built-in functions over that array.
Element names count without their prefix, text is decoded in full, self-closing and paired tags are alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import a11y, crypto, paths
from ..functions.media import clock_seconds
from ..functions.types import lit, string
from .xmlcore import xml_encrypted, xml_rows

CONTAINER, ENCRYPTION = "META-INF/container.xml", "META-INF/encryption.xml"
RIGHT_TO_LEFT = ("ar", "fa", "he", "ur")


def attr(row: Column, name: str) -> Column:
    """An attribute by its name, or by that name after a prefix."""
    exact = F.try_element_at(row["attrs"], lit(name))
    prefixed = F.filter(F.map_entries(row["attrs"]), lambda e: e["key"].endswith(":" + name))
    return F.coalesce(exact, F.try_element_at(prefixed, lit(1))["value"])


def named(rows: Column, *names: str) -> Column:
    return F.filter(rows, lambda r: r["name"].isin(*names))


def text(row: Column) -> Column:
    return F.trim(F.regexp_replace(row["text"], r"^\s+|\s+$", ""))


def renditions(entries: DataFrame) -> DataFrame:
    """pub_id, idx, opf_path and the selection attributes of each rootfile; publications without any are in container_errors()."""
    parsed = entries.where(F.col("path") == CONTAINER).select("pub_id", xml_rows("content").alias("x"))
    roots = F.filter(named(F.col("x.rows"), "rootfile"), lambda r: F.coalesce(attr(r, "full-path"), lit("")) != "")
    each = parsed.select("pub_id", F.posexplode(roots).alias("idx", "r"))
    own = {"layout": "layout", "media": "media", "language": "language", "label": "label", "access_mode": "accessMode"}
    return each.select("pub_id", "idx", attr(F.col("r"), "full-path").alias("opf_path"), *[attr(F.col("r"), a).alias(n) for n, a in own.items()])


def container_errors(pubs: DataFrame, entries: DataFrame) -> DataFrame:
    """pub_id, kind, message of publications without a usable container."""
    seen = entries.where(F.col("path") == CONTAINER).select("pub_id", xml_rows("content").alias("x"))
    state = pubs.select("pub_id").distinct().join(seen, "pub_id", "left")
    usable = F.exists(named(F.col("x.rows"), "rootfile"), lambda r: F.coalesce(attr(r, "full-path"), lit("")) != "")
    kind = F.when(F.col("x").isNull(), "missing_container").when(F.col("x.error").isNotNull(), "xml").when(~usable, "invalid_format")
    return state.select("pub_id", kind.alias("kind"), F.coalesce("x.error", lit("no rootfile")).alias("message")).where("kind is not null")


def best_rendition(found: DataFrame, layout: str | None = None, language: str | None = None) -> DataFrame:
    """The rendition of each publication that fits best: two points for the layout (reflowable also fits none given), one for the language; of equals the last, without any point the first."""
    score = lit(0)
    if layout is not None:
        fits = F.col("layout") == layout
        score = score + F.when(fits | (F.col("layout").isNull() if layout == "reflowable" else lit(False)), 2).otherwise(0)
    if language is not None:
        score = score + F.when(F.col("language") == language, 1).otherwise(0)
    columns = [c for c in found.columns if c != "pub_id"]
    order = F.when(score > 0, F.struct(score.alias("s"), F.col("idx").alias("i"))).otherwise(F.struct(lit(0).alias("s"), (-F.col("idx")).alias("i")))
    return found.groupBy("pub_id").agg(F.max_by(F.struct(*columns), order).alias("r")).select("pub_id", "r.*")


def rendition_at(pubs: DataFrame, found: DataFrame, idx: int = 0) -> DataFrame:
    """The rendition of that number (0: the default) of each of pubs (pub_id), with error where there is none: every publication comes back."""
    own = found.where(F.col("idx") == idx)
    out = pubs.select("pub_id").distinct().join(own, "pub_id", "left")
    return out.withColumn("error", F.when(F.col("opf_path").isNull(), lit(f"no rendition {idx}")))


def is_reflowable(layout: Column | str) -> Column:
    return F.coalesce(string(layout), lit("")) != "pre-paginated"


def packages(entries: DataFrame, chosen: DataFrame) -> DataFrame:
    """pub_id, opf_path, opf_dir, rows, error of the chosen renditions' package documents."""
    own = entries.select("pub_id", F.col("path").alias("opf_path"), "content")
    parsed = chosen.select("pub_id", "opf_path").join(own, ["pub_id", "opf_path"], "left").withColumn("x", xml_rows("content"))
    return parsed.select("pub_id", "opf_path", paths.dir_of("opf_path").alias("opf_dir"), "x.rows", "x.error")


def manifest(packed: DataFrame) -> DataFrame:
    """pub_id, doc_order, id, href (decoded), media_type, properties, media_overlay; items without id or href are left out."""
    items = F.filter(named(F.col("rows"), "item"), lambda r: (F.coalesce(attr(r, "id"), lit("")) != "") & (F.coalesce(attr(r, "href"), lit("")) != ""))
    each = packed.select("pub_id", "opf_dir", F.posexplode(items).alias("doc_order", "r"))
    r = F.col("r")
    return each.select(
        "pub_id", "doc_order", attr(r, "id").alias("id"), paths.percent_decode(attr(r, "href")).alias("href"), F.coalesce(attr(r, "media-type"), lit("")).alias("media_type"),
        F.filter(F.split(F.coalesce(attr(r, "properties"), lit("")), r"\s+"), lambda p: p != "").alias("properties"), attr(r, "media-overlay").alias("media_overlay"), "opf_dir",
    )


def spine(packed: DataFrame) -> DataFrame:
    """pub_id, spine_index, idref, linear, layout_override, page_spread."""
    refs = F.filter(named(F.col("rows"), "itemref"), lambda r: F.coalesce(attr(r, "idref"), lit("")) != "")
    each = packed.select("pub_id", F.posexplode(refs).alias("spine_index", "r"))
    p = F.coalesce(attr(F.col("r"), "properties"), lit(""))
    return each.select(
        "pub_id", "spine_index", attr(F.col("r"), "idref").alias("idref"), (F.coalesce(attr(F.col("r"), "linear"), lit("yes")) != "no").alias("linear"),
        F.when(p.contains("rendition:layout-reflowable"), "reflowable").when(p.contains("rendition:layout-pre-paginated"), "pre-paginated").alias("layout_override"),
        F.when(p.contains("page-spread-left"), "left").when(p.contains("page-spread-right"), "right").when(p.contains("rendition:page-spread-center"), "center").alias("page_spread"),
    )


def guide(packed: DataFrame) -> DataFrame:
    """pub_id, ord, ref_type, href (against the package document's folder, with its fragment), title."""
    refs = F.filter(named(F.col("rows"), "reference"), lambda r: (F.coalesce(attr(r, "type"), lit("")) != "") & (F.coalesce(attr(r, "href"), lit("")) != ""))
    each = packed.select("pub_id", "opf_dir", F.posexplode(refs).alias("ord", "r"))
    href = paths.resolve_href("opf_dir", paths.percent_decode(attr(F.col("r"), "href")))
    return each.select("pub_id", "ord", attr(F.col("r"), "type").alias("ref_type"), href.alias("href"), attr(F.col("r"), "title").alias("title"))


def _last(values: Column) -> Column:
    return F.try_element_at(values, lit(-1))


def metadata(packed: DataFrame) -> DataFrame:
    """A row for each package with its metadata: scalars, lists and structs. Refinements are looked up by id whatever their order; of repeated ones the last counts."""
    filled = F.filter(F.col("rows"), lambda r: text(r) != "")
    meta = F.transform(
        F.filter(filled, lambda r: (r["name"] == "meta") & attr(r, "property").isNotNull()),
        lambda r: F.struct(attr(r, "property").alias("property"), F.when(attr(r, "refines").startswith("#"), F.substr(attr(r, "refines"), lit(2))).alias("refines"), attr(r, "id").alias("id"), attr(r, "scheme").alias("scheme"), text(r).alias("value"), r["ord"].alias("ord")),
    )
    base = packed.select("pub_id", "opf_path", "opf_dir", "rows", filled.alias("filled_"), meta.alias("meta_"))
    refine = lambda id_, prop: _last(F.filter("meta_", lambda m: (m["refines"] == id_) & (m["property"] == prop)))["value"]
    everywhere = lambda prop: F.filter("meta_", lambda m: m["refines"].isNull() & (m["property"] == prop))
    dc = lambda *names: named(F.col("filled_"), *names)
    values = lambda *names: F.transform(dc(*names), text)
    title = lambda r: F.struct(
        text(r).alias("value"), attr(r, "lang").alias("lang"), F.when(attr(r, "title-type") == "subtitle", "subtitle").otherwise(refine(attr(r, "id"), "title-type")).alias("title_type"),
        refine(attr(r, "id"), "file-as").alias("sort_as"), refine(attr(r, "id"), "display-seq").try_cast("bigint").alias("display_seq"),
    )
    person = lambda r: F.struct(text(r).alias("name"), refine(attr(r, "id"), "role").alias("role"), refine(attr(r, "id"), "file-as").alias("file_as"))
    kind = lambda r: F.coalesce(attr(r, "scheme"), _last(F.filter("meta_", lambda m: (m["refines"] == attr(r, "id")) & (m["property"] == "identifier-type") & m["scheme"].isNotNull()))["scheme"], refine(attr(r, "id"), "identifier-type"))
    series = lambda m: F.struct(m["value"].alias("name"), F.coalesce(refine(m["id"], "collection-type"), lit("series")).alias("collection_type"), refine(m["id"], "group-position").try_cast("double").alias("position"))
    cover = F.filter("rows", lambda r: (r["name"] == "meta") & (attr(r, "name") == "cover") & attr(r, "content").isNotNull())
    dated = F.transform(F.filter(dc("date"), lambda r: attr(r, "event") == "modification"), lambda r: F.struct(r["ord"].alias("ord"), text(r).alias("value")))
    changed = F.sort_array(F.concat(dated, F.transform(everywhere("dcterms:modified"), lambda m: F.struct(m["ord"].alias("ord"), m["value"].alias("value")))))
    layout = _last(everywhere("rendition:layout"))["value"]
    step = base.select(
        "pub_id", "opf_path", "opf_dir", "meta_",
        F.transform(dc("title"), title).alias("titles"), F.transform(dc("creator", "contributor"), person).alias("creators"), values("language").alias("languages"),
        F.transform(dc("identifier"), lambda r: F.struct(attr(r, "id").alias("id"), text(r).alias("value"), kind(r).alias("scheme"))).alias("ids_"),
        attr(F.try_element_at(named(F.col("rows"), "package"), lit(1)), "unique-identifier").alias("uid_"),
        *[_last(values(n)).alias(n) for n in ("publisher", "description", "rights")],
        _last(F.transform(F.filter(dc("date"), lambda r: F.coalesce(attr(r, "event"), lit("")) != "modification"), text)).alias("date"),
        values("subject").alias("subjects"), _last(changed)["value"].alias("modified"), F.when(layout == "pre-paginated", layout).otherwise("reflowable").alias("layout"),
        F.transform(F.filter(everywhere("belongs-to-collection"), lambda m: m["id"].isNotNull()), series).alias("belongs_to"), attr(_last(cover), "content").alias("cover_id"),
        F.when(attr(_last(named(F.col("rows"), "spine")), "page-progression-direction") == "rtl", "rtl").otherwise("default").alias("reading_progression"), attr(_last(named(F.col("rows"), "spine")), "toc").alias("toc_id"),
    )
    main = F.coalesce(F.try_element_at(F.filter("titles", lambda t: t["title_type"] == "main"), lit(1)), F.try_element_at(F.filter("titles", lambda t: F.coalesce(t["title_type"], lit("")) != "subtitle"), lit(1)))
    subtitles = F.sort_array(F.transform(F.filter(F.transform("titles", lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: x["t"]["title_type"] == "subtitle"), lambda x: F.struct(F.coalesce(x["t"]["display_seq"], lit(2**32 - 1)).alias("s"), x["i"].alias("i"), x["t"]["value"].alias("value"))))
    primary = F.greatest(F.array_position(F.transform("ids_", lambda x: F.coalesce(x["id"], lit(""))), F.coalesce("uid_", lit("\0"))), lit(1).cast("long"))
    others = F.filter("ids_", lambda x, i: i + 1 != primary)
    return (
        step.withColumns({"main_": main, "identifier": F.try_element_at("ids_", primary.cast("int"))["value"], "alt_identifiers": F.transform(others, lambda x: F.struct(x["value"].alias("value"), x["scheme"].alias("scheme")))})
        .withColumns({"title": F.col("main_.value"), "sort_as": F.col("main_.sort_as"), "subtitle": F.try_element_at(subtitles, lit(1))["value"], "language": F.try_element_at("languages", lit(1)), "accessibility": _accessibility(F.col("meta_")), "media_overlays": _overlays(F.col("meta_"))})
        .drop("meta_", "main_", "ids_", "uid_")
    )


def _overlays(meta: Column) -> Column:
    """Media overlay metadata; null unless the package has some that refines nothing."""
    whole = lambda prop: F.transform(F.filter(meta, lambda m: m["refines"].isNull() & (m["property"] == prop)), lambda m: m["value"])
    total = _last(F.filter(F.transform(whole("media:duration"), clock_seconds), lambda x: x.isNotNull()))
    each = F.filter(F.transform(F.filter(meta, lambda m: m["refines"].isNotNull() & (m["property"] == "media:duration")), lambda m: F.struct(m["refines"].alias("key"), clock_seconds(m["value"]).alias("value"))), lambda e: e["value"].isNotNull())
    last_of_key = F.filter(each, lambda e, i: ~F.exists(F.slice(each, i + 2, F.size(each)), lambda o: o["key"] == e["key"]))
    value = F.struct(total.alias("total_duration"), F.map_from_entries(last_of_key).alias("durations"), whole("media:narrator").alias("narrators"), _last(whole("media:active-class")).alias("active_class"), _last(whole("media:playback-active-class")).alias("playback_active_class"))
    some = total.isNotNull() | (F.size(whole("media:narrator")) > 0) | (F.size(whole("media:active-class")) > 0) | (F.size(whole("media:playback-active-class")) > 0)
    return F.when(some, value)


def _accessibility(meta: Column) -> Column:
    """Accessibility metadata by property suffix; null if nothing is there."""
    of = lambda suffix: F.filter(meta, lambda m: m["property"].endswith(":" + suffix))
    values = lambda suffix: F.transform(of(suffix), lambda m: m["value"])
    profiles = F.array_distinct(F.filter(F.transform(values("conformsTo"), a11y.normal_profile), lambda p: p.isNotNull()))
    ranked = F.transform(F.sort_array(F.transform(profiles, lambda p, i: F.struct(a11y.profile_rank(p).alias("r"), i.alias("i"), p.alias("p")))), lambda x: x["p"])
    conf_ids = F.filter(F.transform(of("conformsTo"), lambda m: m["id"]), lambda x: x.isNotNull())
    by = F.try_element_at(F.filter(of("certifiedBy"), lambda m: m["refines"].isNull() | F.array_contains(conf_ids, m["refines"])), lit(1))
    refining = lambda suffix: F.try_element_at(F.filter(of(suffix), lambda m: m["refines"] == by["id"]), lit(1))["value"]
    certified = F.when(by.isNotNull() & ((by["value"] != "") | refining("certifierCredential").isNotNull() | refining("certifierReport").isNotNull()), F.struct(by["value"].alias("certified_by"), refining("certifierCredential").alias("credential"), refining("certifierReport").alias("report")))
    sets = F.filter(F.transform(values("accessModeSufficient"), lambda v: F.filter(F.transform(F.split(v, ","), lambda x: F.trim(x)), lambda x: x != "")), lambda s: F.size(s) > 0)
    summary = F.try_element_at(values("accessibilitySummary"), lit(1))
    lists = [values("accessMode"), values("accessibilityFeature"), values("accessibilityHazard"), values("exemption")]
    value = F.struct(ranked.alias("conforms_to"), certified.alias("certification"), summary.alias("summary"), lists[0].alias("access_modes"), sets.alias("access_modes_sufficient"), lists[1].alias("features"), lists[2].alias("hazards"), lists[3].alias("exemptions"))
    some = certified.isNotNull() | summary.isNotNull() | (F.size(ranked) > 0) | (F.size(sets) > 0)
    for x in lists:
        some = some | (F.size(x) > 0)
    return F.when(some, value)


def reading_direction(progression: Column | str, language: Column | str) -> Column:
    """rtl if it is set, or if the language is written so; ltr otherwise."""
    base = F.split_part(F.lower(F.coalesce(string(language), lit(""))), lit("-"), lit(1))
    return F.when((string(progression) == "rtl") | base.isin(*RIGHT_TO_LEFT), "rtl").otherwise("ltr")


def series(belongs_to: Column | str) -> Column:
    """The first collection of the type series: its name and position."""
    return F.try_element_at(F.filter(string(belongs_to), lambda b: b["collection_type"] == "series"), lit(1))


def encryption(entries: DataFrame) -> DataFrame:
    """pub_id, zip_path, algorithm, original_length, algorithm_uri; what was read before an error counts, data without an algorithm and a length doesn't."""
    each = entries.where(F.col("path") == ENCRYPTION).select("pub_id", F.explode(xml_encrypted("content")).alias("d"))
    out = each.select("pub_id", "d.ord", paths.percent_decode("d.uri").alias("zip_path"), "d.algorithm_uri", F.col("d.original_length").try_cast("bigint").alias("original_length"))
    out = out.where(F.col("zip_path").isNotNull() & (F.col("algorithm_uri").isNotNull() | F.col("original_length").isNotNull()))
    last = out.groupBy("pub_id", "zip_path").agg(F.max_by(F.struct("algorithm_uri", "original_length"), "ord").alias("e"))
    return last.select("pub_id", "zip_path", crypto.algorithm_of(F.coalesce("e.algorithm_uri", lit(""))).alias("algorithm"), "e.original_length", "e.algorithm_uri")


def has_overlays(items: DataFrame) -> DataFrame:
    return items.groupBy("pub_id").agg(F.bool_or(F.col("media_overlay").isNotNull()).alias("has_media_overlays"))
