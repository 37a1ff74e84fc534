"""When a page says that it was published: only explicit metadata counts, and only one instant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.documents import linked_dates
from ..functions.timing import strict_iso
from ..functions.urls import let

#: Properties of a page's metadata.
PROPERTY = r"(?i)^(article:published_time|datePublished)$"


def _meta_dates(html: Column) -> Column:
    """The content of each meta element whose property, itemprop or name (the first that isn't empty) says publication."""

    def one(attributes: Column) -> Column:
        names = F.transform(F.regexp_extract_all(attributes, F.lit(r"""([\w:-]+)\s*=\s*["'][^"']*["']"""), F.lit(1)), lambda n: F.lower(n))
        values = F.regexp_extract_all(attributes, F.lit(r"""[\w:-]+\s*=\s*["']([^"']*)["']"""), F.lit(1))
        pairs = F.arrays_zip(names.alias("name"), values.alias("value"))
        last = lambda name: F.try_element_at(F.transform(F.filter(pairs, lambda p: p["name"] == name), lambda p: p["value"]), F.lit(-1))
        kind = F.coalesce(*[F.nullif(last(n), F.lit("")) for n in ("property", "itemprop", "name")])
        return F.when(kind.rlike(PROPERTY), last("content"))

    return F.array_compact(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b([^>]+)>"), F.lit(1)), one))


def publication(html: Column) -> Column:
    """A struct (at, kind, raw) if all dates that the page states are one instant, else null. Meta elements come before JSON-LD."""
    said = lambda dates, kind: F.transform(dates, lambda d: F.struct(d.alias("raw"), F.lit(kind).alias("kind"), strict_iso(d).alias("at")))
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    every = F.filter(F.concat(said(_meta_dates(html), "publication_meta"), said(F.flatten(F.transform(blocks, linked_dates)), "article_jsonld")), lambda x: x["at"].isNotNull())
    return let(every, lambda e: F.when(F.size(F.array_distinct(F.transform(e, lambda x: x["at"]))) == 1, F.struct(F.get(e, F.lit(0))["at"].alias("at"), F.get(e, F.lit(0))["kind"].alias("kind"), F.get(e, F.lit(0))["raw"].alias("raw"))))
