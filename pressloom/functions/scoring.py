"""Relevance, triage, audience and selection scores as column expressions over title, summary and source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import phrases as P
from . import vocabulary as V
from .phrases import EDGE, SPACE, UNEVEN
from .unicode import base_letters


def joined(title: Column, summary: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit("")))


RELEVANCE = {"strong": V.STRONG, "company": V.COMPANY, "attention": V.ATTENTION, "broad": V.BROAD, "noise": V.NOISE}
TRIAGE = {
    "corporate": V.TRIAGE_CORPORATE_FINANCE, "macro": V.TRIAGE_MARKET_MACRO, "company": V.TRIAGE_MAJOR_COMPANY, "figure": V.TRIAGE_MAJOR_FIGURE,
    "basic": V.TRIAGE_BASIC_FINANCE, "move": V.TRIAGE_MARKET_MOVE, "attention": V.TRIAGE_ATTENTION, "noise": V.TRIAGE_NOISE, "money": [V.MONEY_WORDS],
}


def squeezed(text: Column) -> Column:
    """`text` with single blanks for white space of any kind; most texts have no other."""
    # Sought by what it lacks: the JVM's matcher recurses for each turn of a repeated group, so that a long text ends its stack.
    other = text.rlike(r"[^\x20-\x7E]|  |^ | $")
    return F.when(~other, text).otherwise(F.trim(F.regexp_replace(text, UNEVEN, " ")))


def relevant(source_name: Column) -> Column:
    """Whether an item belongs on a finance desk, from the counts of RELEVANCE in its squeezed text (see phrases.with_counts);
    the last rules depend on its source."""
    name = F.coalesce(source_name, F.lit(""))
    strong, company, attention, broad, noise = (F.col(f"__{x}") for x in RELEVANCE)
    some = (strong >= 1) | (broad >= 1)
    anywhere = ((company >= 1) & ((strong >= 1) | (attention >= 1))) | (strong >= 2) | ((strong >= 1) & ((noise == 0) | (broad >= 1)))
    by_source = (
        F.when(P.names(name, "GDELT|Google News"), (some | ((company >= 1) & (attention >= 1))) & (noise == 0))
        .when(P.names(name, "CNBC|Yahoo Finance|Financial Times|WSJ|Economist"), ((strong >= 1) | (company >= 1) | (attention >= 1) | (broad >= 2)) & (noise == 0))
        .when(P.names(name, "Federal Reserve|ECB"), some)
        .when(P.names(name, "E24 – Børs og finans|E24 – Makro og politikk|Dagens Næringsliv"), (broad >= 2) & (noise == 0))
        .otherwise(False)
    )
    return F.when(F.col("__text") == "", False).when(P.names(name, "E24 – Aksjetips"), True).otherwise(anywhere | by_source)


def bare_domain(domain: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(domain, F.lit(""))), r"^www\.", "")


def triage_rank(kind: Column, domain: Column) -> Column:
    kind = F.lower(F.coalesce(kind, F.lit("")))
    known = F.when(kind == "global-rss", 14).when(kind == "rss", 11).when(kind == "news-index", 8).when(kind == "news-aggregator", 4).otherwise(6)
    return F.when(kind.contains("official"), 22).when(bare_domain(domain).isin(V.TRUSTED_DOMAINS), 18).otherwise(known)


def triage(source_name: Column, rank: Column, age_hours: Column) -> tuple[Column, Column, Column]:
    """Priority (0 to 100), whether the text is about finance explicitly, and how many noise patterns it matches:
    from the counts of TRIAGE (see phrases.with_counts)."""
    corporate, macro, company, figure, basic, move, attention, noise, money = (F.col(f"__{x}") for x in TRIAGE)
    capped = lambda most, each, n: F.least(F.lit(most), each * n)
    flag = lambda n, worth: F.when(n > 0, worth).otherwise(0)
    words = capped(42, 24, corporate) + capped(36, 22, macro) + flag(company, 24) + flag(figure, 20) + capped(16, 8, basic) + flag(move, 18) + capped(14, 8, attention) - capped(70, 45, noise)
    fresh = F.greatest(F.lit(0.0), 10 - F.greatest(F.lit(0.0), age_hours) * 0.5)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(rank + fresh + words + 0.5))).cast("long")
    desk = P.names(F.coalesce(source_name, F.lit("")), V.FINANCE_DESK)
    explicit = (corporate > 0) | (macro > 0) | (move > 0) | ((basic > 0) & (desk | (rank >= 14))) | ((figure > 0) & (desk | (attention > 0))) | ((company > 0) & (money > 0))
    return score, explicit, noise


def triage_words(title: Column) -> Column:
    """Words of a title for clustering, in order, after synonyms, in base letters."""
    x = base_letters(F.coalesce(title, F.lit("")))
    for pattern, word in V.TRIAGE_SYNONYMS:
        x = F.regexp_replace(x, pattern.replace(r"\b", EDGE), word)
    words = F.split(F.trim(F.regexp_replace(x, "[^a-z0-9æøå]+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(V.TRIAGE_STOP))


def event_words(title: Column) -> Column:
    """Words of a title for comparing events, in order, after the synonyms of events: not those of triage."""
    x = base_letters(F.coalesce(title, F.lit("")))
    for pattern, word in V.EVENT_SYNONYMS:
        x = F.regexp_replace(x, pattern.replace(r"\b", EDGE), word)
    words = F.split(F.trim(F.regexp_replace(x, "[^a-z0-9æøå]+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(V.EVENT_STOP))


def event_key(known: Column, title: Column, published: Column) -> Column:
    """The event's key: the one that triage gave, else a hash of the UTC day and the first eight words of events."""
    day = F.coalesce(F.date_format(published, "yyyy-MM-dd"), F.lit("unknown-day"))
    return F.coalesce(F.nullif(known, F.lit("")), F.substring(F.sha1(F.concat_ws("|", day, F.array_join(F.slice(event_words(title), 1, 8), "-"))), 1, 18))


def audience(text: Column, kind: Column) -> Column:
    """A struct: eligible, norwegian, global, concrete, score and reason. A null text has no words."""
    patterns = [V.AUDIENCE_NORWEGIAN, V.AUDIENCE_GLOBAL, V.AUDIENCE_NOISE, V.AUDIENCE_EVENT]
    known = F.coalesce(kind.isin(V.CONCRETE_TYPES), F.lit(False))

    def judged(own: Column, hits: Column) -> Column:
        norwegian, wide, noise, event = (P.matched(own, hits, p) for p in patterns)
        return F.struct(norwegian.alias("norwegian"), wide.alias("global"), noise.alias("noise"), (event | known).alias("concrete"))

    def rated(x: Column) -> Column:
        fine, reach = ~x["noise"] & x["concrete"], x["norwegian"] | x["global"]
        score = F.when(fine & x["norwegian"], 90).when(fine & x["global"], 70).otherwise(0)
        reason = F.when(x["noise"], V.REASON_NOISE).when(~x["concrete"], V.REASON_VAGUE).when(~reach, V.REASON_REACH).when(x["norwegian"], V.REASON_NORWEGIAN).otherwise(V.REASON_GLOBAL)
        return F.struct((fine & reach).alias("eligible"), x["norwegian"].alias("norwegian"), x["global"].alias("global"), x["concrete"].alias("concrete"), score.alias("score"), reason.alias("reason"))

    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    return once(once(P.folded(F.coalesce(text, F.lit(""))), lambda own: once(P.found(own, patterns), lambda hits: judged(own, hits))), rated)


def selection_rank(kind: Column, domain: Column) -> Column:
    kind = F.lower(F.coalesce(kind, F.lit("")))
    known = F.when(kind == "global-rss", 4).when(kind == "rss", 3).when(kind == "news-aggregator", 1).otherwise(2)
    return F.when(kind.contains("official"), 6).when(bare_domain(domain).isin(V.SELECTION_DOMAINS), 5).otherwise(known)
