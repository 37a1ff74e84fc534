"""Gates of the editorial flow as arrays of reasons (empty: passed), and the check of scored replies.

Every gate is one projection over nested columns: no shuffle, and nothing is collected across rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import fingerprint
from ..functions.scoring import SPACE
from ..functions.unicode import all_normalised
from ..sources.tables import pick, seconds, table

#: Fixed values of the editorial contract.
VERSION = "editorial-case-v1"
TRUSTED = ["primary", "trusted_secondary"]
SECTIONS, DEFAULT_SECTION = ["Markeder", "Økonomi", "Renter", "Selskaper", "Analyse"], "Markeder"
TYPES = "breaking resultat oppkjøp kontrakt makro renter analytikerraad markedsbevegelse regulatorisk analyse annet".split()
NEXT_STEPS = ["finn_primarkilde", "krediter_kilden", "overvak", "ignorer"]
OLDEST_HOURS, EARLY_MINUTES, LEAST_QUOTE, LEAST_CONFIDENCE = 36, 15, 12, 70


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " "))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _reason(holds: Column, name: str | Column) -> Column:
    return F.when(_true(holds), F.lit(name) if isinstance(name, str) else name)


def _reasons(*parts: Column) -> Column:
    return F.array_distinct(F.array_compact(F.concat(*parts)))


def age_reasons(published: Column, kind: Column, now: Column) -> Column:
    """Why a date of publication doesn't do: not proven, more than 15 minutes ahead, or older than 36 hours."""
    age = seconds(now) - seconds(published)
    known = F.coalesce(kind, F.lit("")) != ""
    return F.array(
        F.when(published.isNull() | ~known, "original_date_unverified").when(age < -EARLY_MINUTES * 60, "original_date_in_future").when(age > OLDEST_HOURS * 3600, "event_expired")
    )


def _evidence(documents: Column, facts: Column, texts: Column, quotes: Column) -> Column:
    """For each fact, by its place: whether its quote stands in a fetched document, and whether that may be trusted."""
    held = F.arrays_zip(documents.alias("document"), texts.alias("text"))

    def one(x: Column, i: Column) -> Column:
        found = F.filter(held, lambda d: _true(d["document"]["fetched"] & (d["document"]["url"] == x["fact"]["source_url"])))
        source, quote = F.get(found, F.size(found) - 1), _plain(x["quote"])
        proven = (F.length(quote) >= LEAST_QUOTE) & F.contains(_plain(source["text"]), quote)
        at = (i + 1).cast("string")
        return F.array(_reason(~_true(source.isNotNull() & proven), F.concat(F.lit("evidence_missing:"), at)), _reason(~_true(source["document"]["role"].isin(TRUSTED)), F.concat(F.lit("source_untrusted:"), at)))

    return F.flatten(F.transform(F.arrays_zip(facts.alias("fact"), quotes.alias("quote")), one))


def _every_fact(pack: Column) -> Column:
    return F.concat(F.coalesce(pack["facts"], F.array()), F.coalesce(pack["numbers"], F.array()))


def researched(cases: DataFrame, eligible: Column, documents: Column, pack: Column, now: Column) -> DataFrame:
    """`cases` with `reasons` against each (see research_reasons); quotes are looked for in NFKC, as written and as cited texts may
    differ in ligatures, widths and composed letters."""
    texts, quotes = F.transform(F.coalesce(documents, F.array()), lambda d: d["text"]), F.transform(_every_fact(pack), lambda f: f["evidence_quote"])
    plain = cases.withColumns({"__texts": all_normalised(texts, "NFKC"), "__quotes": all_normalised(quotes, "NFKC")})
    return plain.withColumn("reasons", research_reasons(eligible, documents, pack, now, F.col("__texts"), F.col("__quotes"))).drop("__texts", "__quotes")


def research_reasons(eligible: Column, documents: Column, pack: Column, now: Column, texts: Column | None = None, quotes: Column | None = None) -> Column:
    """Reasons against a researched case.

    documents: array of (url, role, document_type, fetched, published, date_kind, text), the main one first.
    pack: can_write, matches_event, confidence, headline_fact, headline_fact_ids, and the arrays facts and numbers of
    (id, source_url, evidence_quote). Nulls count as absent, absent as not given. texts, quotes: the texts of the documents and the quotes
    of facts and numbers in the form to compare them in; as they are, if not given.
    """
    main, facts, every = F.get(documents, 0), F.coalesce(pack["facts"], F.array()), _every_fact(pack)
    texts = F.transform(F.coalesce(documents, F.array()), lambda d: d["text"]) if texts is None else texts
    quotes = F.transform(every, lambda f: f["evidence_quote"]) if quotes is None else quotes
    ids = F.coalesce(pack["headline_fact_ids"], F.array())
    known = F.transform(facts, lambda f: f["id"])
    return _reasons(
        F.array(
            _reason(~_true(eligible), "audience_relevance_missing"),
            _reason(~_true(main["fetched"] & main["role"].isin(TRUSTED)), "source_not_verified"),
            _reason(main["document_type"] == "index", "source_is_index"),
        ),
        age_reasons(main["published"], main["date_kind"], now),
        F.array(
            _reason(~_true(pack["can_write"]), "research_declined"),
            _reason(~_true(pack["matches_event"]), "event_mismatch"),
            _reason((F.coalesce(pack["headline_fact"], F.lit("")) == "") | (F.size(facts) == 0) | (F.coalesce(pack["confidence"], F.lit(0)) < LEAST_CONFIDENCE), "insufficient_facts"),
        ),
        _evidence(F.coalesce(documents, F.array()), every, texts, quotes),
        F.array(_reason((F.size(ids) == 0) | (F.size(F.array_except(ids, known)) > 0), "headline_evidence_missing")),
    )


def review_reasons(blocks: Column, fact_ids: Column, review: Column) -> Column:
    """Reasons against a draft after review.

    blocks: array of (id, text). review: passed, personal_advice, and checks, an array of (id, supported, fact_ids,
    entity_numbers_units_dates_match); the first check of a block counts.
    """
    checks = F.coalesce(review["checks"], F.array())

    def one(block: Column) -> Column:
        check = F.get(F.filter(checks, lambda c: _true(c["id"] == block["id"])), 0)
        fine = (block["text"] != "") & check["supported"] & (F.size(check["fact_ids"]) > 0) & (F.size(F.array_except(check["fact_ids"], fact_ids)) == 0)
        return F.array(_reason(~_true(fine), F.concat(F.lit("unsupported:"), block["id"])), _reason(~_true(check["entity_numbers_units_dates_match"]), F.concat(F.lit("facts_mismatch:"), block["id"])))

    n = F.size(blocks)
    distinct = F.size(F.array_distinct(F.transform(checks, lambda c: c["id"])))
    return _reasons(
        F.array(_reason(~_true(review["passed"]), "reviewer_rejected"), _reason((F.size(checks) != n) | (distinct != n), "incomplete_review")),
        F.flatten(F.transform(blocks, one)),
        F.array(_reason(~_true(~review["personal_advice"]), "investment_advice_check_failed")),
    )


def publication_reasons(case: Column, article_hash: Column, article_checked: Column, pack_hash: Column, now: Column) -> Column:
    """Reasons against publishing. case: version, research_passed, eligible, published, date_kind, review_passed, draft_hash, pack_hash."""
    return _reasons(
        F.array(
            _reason(~_true(case["version"] == VERSION), "case_version_missing"), _reason(~_true(case["research_passed"]), "research_not_approved"), _reason(~_true(case["eligible"]), "audience_relevance_missing")
        ),
        age_reasons(case["published"], case["date_kind"], now),
        F.array(
            _reason(~_true(case["review_passed"]), "verification_required"), _reason(~_true(article_checked), "article_not_verified"),
            _reason(~_true(case["draft_hash"] == article_hash), "draft_changed"), _reason(~_true(case["pack_hash"] == pack_hash), "fact_pack_changed"),
        ),
    )


REPLY = "array<struct<id: bigint, score: double, section: string, type: string, next_step: string, reason: string, attention: double, numbers: double, credit: boolean>>"


def scored_replies(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """`candidates` (id) with the fields of a scored reply, and `deferred` (no valid reply: to be asked again).

    replies: place, body (a JSON array). A reply counts with a known section, type and next step, a number and a reason;
    scores are rounded half up and held to 0 to 100, those of attention and numbers are 0 if absent. Bodies that aren't JSON and
    ids that weren't asked for count as nothing. Of several replies for an id the last one counts.
    """
    x = replies.select("place", F.posexplode(F.from_json("body", REPLY)).alias("at", "r")).select("place", "at", "r.*")
    reason = F.substring(_plain(F.col("reason")), 1, 320)
    held = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), F.floor(c + 0.5))).cast("long")
    valid = x.where(F.col("id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & F.trim("section").isin(SECTIONS) & F.trim("type").isin(TYPES) & F.trim("next_step").isin(NEXT_STEPS) & (reason != ""))
    fields = {
        "score": held(F.col("score")), "section": F.trim("section"), "type": F.trim("type"), "next_step": F.trim("next_step"), "reason": reason,
        "attention": held(F.coalesce("attention", F.lit(0.0))), "numbers": held(F.coalesce("numbers", F.lit(0.0))), "credit": _true(F.col("credit")),
    }
    last = valid.groupBy("id").agg(F.max_by(F.struct(*[c.alias(name) for name, c in fields.items()]), F.struct("place", "at")).alias("r"))
    return candidates.join(last, "id", "left").select(*[candidates[f"`{c}`"] for c in candidates.columns if c != "id"], "id", *[f"r.{name}" for name in fields], F.col("r").isNull().alias("deferred"))


NOW = "2024-01-02 00:00:00"


def _stamp(ident: Column) -> Column:
    hours = F.when(ident % 23 == 0, 1).otherwise(-(ident % 40))
    return F.when(ident % 19 != 0, F.timestamp_seconds(seconds(F.lit(NOW).cast("timestamp_ntz")) + hours * 3600).cast("timestamp_ntz"))


def research_gate(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    fact = lambda name, quote, url="u": F.struct(F.lit(name).alias("id"), (F.lit(url) if isinstance(url, str) else url).alias("source_url"), quote.alias("evidence_quote"))
    role = F.get(F.array(*map(F.lit, ["primary", "trusted_secondary", "unknown", "primary"])), (i % 4).cast("int"))
    document = F.struct(F.lit("u").alias("url"), role.alias("role"), F.when(i % 13 == 0, "index").otherwise("article").alias("document_type"), (i % 17 != 0).alias("fetched"), _stamp(i).alias("published"), F.lit("meta").alias("date_kind"), F.col("text"))
    pack = F.struct(
        (i % 29 != 0).alias("can_write"), (i % 31 != 0).alias("matches_event"), (50 + i % 50).alias("confidence"), F.when(i % 37 != 0, "x").alias("headline_fact"),
        F.when(i % 7 == 0, F.array(F.lit("f9"))).when(i % 11 != 0, F.array(F.lit("f1"))).alias("headline_fact_ids"),
        F.array(fact("f1", F.substring("text", 1, 40)), fact("f2", F.when(i % 3 == 0, "no such words at all").otherwise(F.substring("text", 10, 30)))).alias("facts"),
        F.array(fact("n1", F.substring("text", 1, 30), F.when(i % 5 == 0, "v").otherwise("u"))).alias("numbers"),
    )
    found = researched(table(spark, d, "documents"), i % 10 != 0, F.array(document), pack, F.lit(NOW).cast("timestamp_ntz"))
    return found.select(i.alias("id"), F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("passed"))


def publication_gate(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    now_hash = fingerprint(title=F.col("o_orderpriority"), body=F.col("o_orderstatus"))
    old_hash = F.when(i % 6 == 0, fingerprint(body=F.col("o_orderstatus"), title=F.lit("old"))).when(i % 21 != 0, now_hash)
    case = F.struct(
        F.when(i % 43 != 0, VERSION).alias("version"), (i % 7 != 0).alias("research_passed"), (i % 10 != 0).alias("eligible"), _stamp(i).alias("published"), F.when(i % 9 != 0, "meta").alias("date_kind"),
        (i % 8 != 0).alias("review_passed"), old_hash.alias("draft_hash"), F.when(i % 5 != 0, F.sha2(i.cast("string"), 256)).alias("pack_hash"),
    )
    reasons = publication_reasons(case, now_hash, i % 3 != 0, F.sha2(i.cast("string"), 256), F.lit(NOW).cast("timestamp_ntz"))
    return table(spark, d, "orders").select(i.alias("id"), F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("passed"))


def reply_check(spark: SparkSession, d: str) -> DataFrame:
    """Every event asks; of the replies some are missing, cut off, or wrong in one field."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    i, k = F.col("event_id"), F.col("k")
    reason = F.when(k % 12 == 0, "  ").otherwise(F.concat(F.lit("because  of "), F.col("event_type")))
    reply = F.struct(
        i.alias("id"), (F.col("value") - 10).alias("score"), pick([*SECTIONS, "Sport"], k).alias("section"), pick([*TYPES, "sport"], i).alias("type"), F.concat(pick([*NEXT_STEPS, "wait"], k), F.lit(" ")).alias("next_step"),
        reason.alias("reason"), F.when(k % 2 == 0, k * 2.5).alias("attention"), F.when(k % 7 == 0, True).alias("credit"),
    )
    body = F.to_json(F.array(reply))
    replies = e.select(i.alias("place"), F.when(i % 9 == 0, F.lit(None)).when(i % 14 == 0, F.substring(body, 1, 20)).otherwise(body).alias("body"))
    return scored_replies(e.select(i.alias("id")), replies)
