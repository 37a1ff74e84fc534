"""URL rules as column expressions: canonical form, source roles, index and decision pages, public addresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .phrases import hit
from .text import normalised

#: Hosts of official sources, of trusted papers, and of companies with the words that must stand in the text.
OFFICIAL = (
    "live.euronext.com euronext.com newsweb.no norges-bank.no data.norges-bank.no ssb.no finanstilsynet.no regjeringen.no "
    "federalreserve.gov ecb.europa.eu boj.or.jp opec.org sec.gov"
).split()
PAPERS = {
    "dn.no": "Dagens Næringsliv", "e24.no": "E24", "finansavisen.no": "Finansavisen", "reuters.com": "Reuters", "bloomberg.com": "Bloomberg",
    "ft.com": "Financial Times", "cnbc.com": "CNBC", "wsj.com": "The Wall Street Journal", "apnews.com": "AP", "nrk.no": "NRK",
}
COMPANIES = {
    "equinor.com": "equinor", "dnb.no": "dnb", "ir.dnb.no": "dnb", "kongsberg.com": "kongsberg", "akerasa.com": "aker", "yara.com": "yara", "mowi.com": "mowi",
    "salmar.no": "salmar", "telenor.com": "telenor", "orkla.com": "orkla", "hydro.com": "(norsk hydro|hydro)", "varenergi.no": "(vår energi|var energi)",
    "nvidia.com": "nvidia", "investor.nvidia.com": "nvidia", "apple.com": "apple", "microsoft.com": "microsoft", "abc.xyz": "(alphabet|google)",
    "ir.aboutamazon.com": "amazon", "investor.atmeta.com": "meta", "ir.tesla.com": "tesla", "novonordisk.com": "novo nordisk",
}
#: Patterns of generic official hosts, of a company's own pages, and of pages that only list others.
OFFICIAL_HOST = r"(^|\.)gov(\.|$)|(^|\.)europa\.eu$|(^|\.)(ssb|norges-bank|finanstilsynet)\.no$"
COMPANY_PATH = r"/(investor|news|press|media|releases?|announcements?|reports?|results?)|/ir/"
INDEX_PATH = r"fomccalendars|/index\.(html?|aspx)$|/mpr_\d{4}/?$|/(news|newsroom|press|investors?|investor-relations)/?$|^/$"
DECISION = r"^https://www\.norges-bank\.no/(?i:aktuelt/nyheter/pressemeldinger)/20\d{2}/20\d{2}-\d{2}-\d{2}-(?i:rente)/(#.*)?$"
URL = r"^\s*([a-zA-Z][a-zA-Z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]/?#\s]*\]|[^/?#:@\s]+)(?::(\d*))?([^?#\s]*)(?:\?([^#]*))?(?:#.*)?$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` applied to `value`; the expression of `value` stands in the plan once."""
    return F.get(F.transform(F.array(value), use), 0)


def _fields(url: Column) -> dict[str, Column]:
    part = lambda i: F.regexp_extract(url, URL, i)
    path = F.when(part(5) == "", "/").otherwise(part(5))
    return {"scheme": F.lower(part(1)), "user": part(2), "host": F.lower(part(3)), "port": part(4), "path": path, "query": part(6)}


def parts(url: Column) -> Column:
    """A struct: scheme and host in lower case, user, port, path (/ if empty), query; null for anything that isn't a URL."""
    return F.when(url.rlike(URL), F.struct(*[c.alias(name) for name, c in _fields(url).items()]))


def part(url: Column, name: str) -> Column:
    """One field of parts(), without the others."""
    return F.when(url.rlike(URL), _fields(url)[name])


def _rebuilt(u: Column, query: Column) -> Column:
    default = ((u["scheme"] == "https") & (u["port"] == "443")) | ((u["scheme"] == "http") & (u["port"] == "80")) | (u["port"] == "")
    port = F.when(default, "").otherwise(F.concat(F.lit(":"), u["port"]))
    user = F.when(u["user"] == "", "").otherwise(F.concat(u["user"], F.lit("@")))
    return F.concat(u["scheme"], F.lit("://"), user, u["host"], port, u["path"], F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def _pairs(query: Column) -> Column:
    return F.filter(F.split(query, "&"), lambda p: p != "")


def _key(pair: Column) -> Column:
    return F.regexp_extract(pair, "^([^=]*)", 1)


def _written(pair: Column) -> Column:
    """A parameter as form encoding writes it: always with =, blanks as +."""
    return F.replace(F.when(pair.contains("="), pair).otherwise(F.concat(pair, F.lit("="))), F.lit("%20"), F.lit("+"))


def canonical(url: Column) -> Column:
    """The URL without fragment and tracking parameters, the others sorted by name; null unless it is http(s) without a user."""

    def one(u: Column) -> Column:
        kept = F.filter(_pairs(u["query"]), lambda p: ~_key(p).rlike("(?i)^(utm_|fbclid$|gclid$)"))
        order = F.array_sort(F.transform(kept, lambda p, i: F.struct(_key(p).alias("key"), i.alias("i"), _written(p).alias("pair"))))
        query = F.array_join(F.transform(order, lambda x: x["pair"]), "&")
        return F.when(u["scheme"].isin("http", "https") & (u["user"] == ""), _rebuilt(u, query))

    return let(url, lambda address: let(parts(address), one))


def cleaned(url: Column) -> Column:
    """The URL without fragment and tracking parameters, in its order; anything that isn't a URL only trimmed."""

    def one(u: Column, address: Column) -> Column:
        every = _pairs(u["query"])
        kept = F.filter(every, lambda p: ~_key(p).rlike("(?i)^(utm_|fbclid$|gclid$|cmpid$|ref$|source$)"))
        query = F.when(F.size(kept) == F.size(every), u["query"]).otherwise(F.array_join(F.transform(kept, _written), "&"))
        return F.coalesce(_rebuilt(u, query), F.trim(address))

    # parts() asks for the address eight times: what makes it is computed once.
    return let(url, lambda address: let(parts(address), lambda u: one(u, address)))


def host(url: Column, bare: bool = True) -> Column:
    h = F.lower(F.coalesce(F.regexp_extract(url, URL, 3), F.lit("")))  # never empty in a URL
    return F.regexp_replace(h, r"^www\.", "") if bare else h


def role(url: Column, text: Column) -> Column:
    """A struct (role, quality): primary for official hosts and for a company's own host if the text names it, trusted_secondary
    for known papers, else unknown. Only https on the default port without a user counts."""
    fine = lambda u: (u["scheme"] == "https") & (u["user"] == "") & u["port"].isin("", "443")
    as_is = lambda r, q: F.struct(F.lit(r).alias("role"), F.lit(q).alias("quality"))

    def one(u: Column) -> Column:
        h = F.regexp_replace(u["host"], r"^www\.", "")
        own = F.lit(False)
        for name, words in COMPANIES.items():
            own = own | ((h == name) & hit(F.coalesce(text, F.lit("")), rf"\b{words}\b"))
        return (
            F.when(~F.coalesce(fine(u), F.lit(False)), as_is("unknown", "unknown")).when(h.isin(OFFICIAL), as_is("primary", "official")).when(h.isin(list(PAPERS)), as_is("trusted_secondary", "high"))
            .when(own, as_is("primary", "corporate_official")).otherwise(as_is("unknown", "unknown"))
        )

    return let(url, lambda address: let(parts(address), one))


def paper(url: Column) -> Column:
    """The name of a known paper; null for other hosts."""
    names = F.create_map(*[F.lit(x) for pair in PAPERS.items() for x in pair])
    return F.try_element_at(names, host(url))


def is_index(url: Column) -> Column:
    """Whether the page only lists others; what isn't a URL counts as such."""
    return F.coalesce(part(url, "path").rlike(f"(?i){INDEX_PATH}"), F.lit(True))


def is_specific(url: Column) -> Column:
    """An official host; on the exchange's own site only company news."""
    news = part(url, "path").rlike("(?i)/company-news/")
    fine = lambda h: F.regexp_replace(h, r"^www\.", "").isin(OFFICIAL) & ((h != "live.euronext.com") | news)
    return F.coalesce(let(part(url, "host"), fine), F.lit(False))


def is_official_host(url: Column) -> Column:
    return F.coalesce(part(url, "host").rlike(f"(?i){OFFICIAL_HOST}"), F.lit(False))


def has_company_path(url: Column) -> Column:
    return F.coalesce(part(url, "path").rlike(f"(?i){COMPANY_PATH}"), F.lit(False))


def is_decision(url: Column) -> Column:
    return F.coalesce(url.rlike(DECISION), F.lit(False))


def brand(url: Column) -> Column:
    """The label before the last one of the host, letters and digits only."""
    labels = F.split(host(url), r"\.")
    return F.replace(normalised(F.coalesce(F.when(F.size(labels) >= 2, F.try_element_at(labels, F.lit(-2))), F.try_element_at(labels, F.lit(1)))), F.lit(" "), F.lit(""))


def is_public(address: Column) -> Column:
    """Whether an IP address is one of the open network: v4 outside reserved ranges, v6 only global unicast."""
    octets = F.transform(F.split(address, r"\."), lambda x: x.try_cast("int"))
    a, b = F.get(octets, 0), F.get(octets, 1)
    reserved = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19))
    )
    four = address.rlike(r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.|$)){4}$") & ~address.endswith(".")
    six = address.rlike(r"(?i)^[23][0-9a-f]{3}:[0-9a-f:]*$") & ~address.rlike("(?i)^2001:db8:")
    return F.coalesce(F.when(four, ~reserved).otherwise(six), F.lit(False))
