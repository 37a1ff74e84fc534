"""Free-form JSON as column expressions: walks of any depth, canonical text, fingerprints, merges.

A walk needs no recursion: what is still open is a list of places, and one step opens all of them at once; a text can't nest deeper than it has
brackets, so that many steps end every walk.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types of articles.
ARTICLE = ["NewsArticle", "Article", "ReportageNewsArticle", "BlogPosting"]
_OPEN, _FOUND = "array<struct<path: array<int>, v: variant>>", "array<struct<path: array<int>, raw: string>>"


def _children(x: Column) -> Column:
    """What a place holds: the elements of a list, or what an object has in @graph."""
    inside = lambda value, i: F.struct(F.concat(x["path"], F.array(i)).alias("path"), value.alias("v"))
    graph = F.try_variant_get(x["v"], "$['@graph']", "variant")
    elements = F.transform(F.try_variant_get(x["v"], "$", "array<variant>"), inside)
    return F.coalesce(elements, F.when(graph.isNotNull(), F.array(inside(graph, F.lit(0)))), F.array().cast(_OPEN))


def _date(x: Column) -> Column:
    kinds = F.coalesce(F.try_variant_get(x["v"], "$['@type']", "array<string>"), F.array(F.try_variant_get(x["v"], "$['@type']", "string")))
    return F.struct(x["path"].alias("path"), F.when(F.exists(kinds, lambda k: k.isin(ARTICLE)), F.try_variant_get(x["v"], "$.datePublished", "string")).alias("raw"))


def linked_dates(text: Column) -> Column:
    """datePublished of every article in a JSON-LD text, in the order of a walk through its lists and @graph, however deep. A text that
    isn't JSON, or repeats a key in an object, has none."""
    whole = F.struct(F.array(F.lit(0)).alias("path"), F.try_parse_json(text).alias("v"))
    start = F.struct(F.array(whole).cast(_OPEN).alias("open"), F.array().cast(_FOUND).alias("found"))

    def step(state: Column, i: Column) -> Column:
        dates = F.filter(F.transform(state["open"], _date), lambda d: d["raw"].isNotNull())
        return F.struct(F.flatten(F.transform(state["open"], _children)).cast(_OPEN).alias("open"), F.concat(state["found"], dates).cast(_FOUND).alias("found"))

    found = F.aggregate(F.sequence(F.lit(0), F.regexp_count(text, F.lit(r"[\[{]"))), start, step)["found"]
    # A place comes before those inside it: its path is the beginning of theirs.
    return F.coalesce(F.transform(F.array_sort(found), lambda d: d["raw"]), F.array().cast("array<string>"))


def canonical_json(text: Column) -> Column:
    """JSON without blanks, the keys of every object in order, at any depth; null for what isn't JSON. Lists keep their order, nulls stay,
    numbers lose the zeros at their end. Keys are compared as UTF-16; numbers in exponent form are written as the JVM does."""
    return F.to_json(F.try_parse_json(text))


def fingerprint_of(text: Column) -> Column:
    """SHA-256 of canonical JSON: neither blanks nor the order of keys change it."""
    return F.sha2(canonical_json(text), 256)


def fingerprint(**fields: Column) -> Column:
    """The fingerprint of an object with these fields, which may be nested."""
    return fingerprint_of(F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]), {"ignoreNullFields": "false"}))


def _fields(text: Column) -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", "map<string, variant>"), F.create_map().cast("map<string, variant>"))


def merged(text: Column, patch: Column) -> Column:
    """An object with the fields of another put over its own, not into them; what isn't an object counts as one without fields."""
    over = _fields(patch)
    left = F.map_filter(_fields(text), lambda k, v: ~F.map_contains_key(over, k))
    return canonical_json(F.to_json(F.map_concat(left, over), {"ignoreNullFields": "false"}))


def without(text: Column, *keys: str) -> Column:
    """An object without some of its fields."""
    return canonical_json(F.to_json(F.map_filter(_fields(text), lambda k, v: ~k.isin(*keys)), {"ignoreNullFields": "false"}))


def counted(text: Column, key: Column) -> Column:
    """An object of counts with one more for `key`."""
    n = F.coalesce(F.try_variant_get(F.try_element_at(_fields(text), key), "$", "long"), F.lit(0)) + 1
    return merged(text, F.to_json(F.create_map(key, n)))
