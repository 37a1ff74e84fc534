import datetime as dt

from pyspark.sql import functions as F

from pressloom.functions import documents
from pressloom.operators import gates

NOW = dt.datetime(2024, 5, 1, 12)
FACT = "struct<id string, source_url string, evidence_quote string>"
CASE = f"""name string, eligible boolean, documents array<struct<url string, role string, document_type string, fetched boolean, published timestamp_ntz, date_kind string, text string>>,
  pack struct<can_write boolean, matches_event boolean, confidence int, headline_fact string, headline_fact_ids array<string>, facts array<{FACT}>, numbers array<{FACT}>>"""
DOC = {"url": "u", "role": "primary", "document_type": "article", "fetched": True, "published": NOW, "date_kind": "meta", "text": "The  key rate\n was raised to 4.5 percent."}
PACK = {"can_write": True, "matches_event": True, "confidence": 90, "headline_fact": "x", "headline_fact_ids": ["f1"], "facts": [("f1", "u", "key rate was raised")], "numbers": [("n1", "u", "raised to 4.5 percent")]}


def reasons(spark, cases):
    df = spark.createDataFrame(cases, CASE)
    found = gates.research_reasons(F.col("eligible"), F.col("documents"), F.col("pack"), F.lit(NOW).cast("timestamp_ntz"))
    return {r.name: r.r for r in df.select("name", found.alias("r")).collect()}


def test_research(spark):
    old, soon = NOW - dt.timedelta(hours=37), NOW + dt.timedelta(minutes=16)
    hours = dt.timedelta(hours=36)
    cases = {
        "fine": (True, [DOC], PACK, []),
        "edge": (True, [DOC | {"published": NOW - hours}], PACK, []),
        "audience": (None, [DOC], PACK, ["audience_relevance_missing"]),
        "index": (True, [DOC | {"document_type": "index"}], PACK, ["source_is_index"]),
        "old": (True, [DOC | {"published": old}], PACK, ["event_expired"]),
        "soon": (True, [DOC | {"published": soon}], PACK, ["original_date_in_future"]),
        "undated": (True, [DOC | {"date_kind": ""}], PACK, ["original_date_unverified"]),
        "weak": (True, [DOC | {"role": "unknown"}], PACK, ["source_not_verified", "source_untrusted:1", "source_untrusted:2"]),
        "doubt": (True, [DOC], PACK | {"confidence": 69, "can_write": False, "matches_event": None}, ["research_declined", "event_mismatch", "insufficient_facts"]),
        "quote": (True, [DOC], PACK | {"facts": [("f1", "u", "key rate")], "numbers": [("n1", "v", "raised to 4.5 percent")]}, ["evidence_missing:1", "evidence_missing:2", "source_untrusted:2"]),
        "headline": (True, [DOC], PACK | {"headline_fact_ids": ["f1", "f2"]}, ["headline_evidence_missing"]),
        "bare": (True, [DOC], PACK | {"facts": None, "numbers": None}, ["insufficient_facts", "headline_evidence_missing"]),
        "none": (True, None, PACK, ["source_not_verified", "original_date_unverified", "evidence_missing:1", "source_untrusted:1", "evidence_missing:2", "source_untrusted:2"]),
        "last": (True, [DOC | {"text": "other"}, DOC], PACK, []),
    }
    got = reasons(spark, [(k, *v[:3]) for k, v in cases.items()])
    assert got == {k: v[3] for k, v in cases.items()}


def test_review(spark):
    good = [("title", True, ["f1"], True), ("p1", True, ["f1", "n1"], True)]
    cases = {
        "fine": ((True, False, good), []),
        "advice": ((True, None, good), ["investment_advice_check_failed"]),
        "rejected": ((False, False, good), ["reviewer_rejected"]),
        "short": ((True, False, good[:1]), ["incomplete_review", "unsupported:p1", "facts_mismatch:p1"]),
        "twice": ((True, False, [good[0], good[0]]), ["incomplete_review", "unsupported:p1", "facts_mismatch:p1"]),
        "unknown": ((True, False, [good[0], ("p1", True, ["f9"], True)]), ["unsupported:p1"]),
        "mismatch": ((True, False, [good[0], ("p1", True, ["f1"], None)]), ["facts_mismatch:p1"]),
    }
    schema = "name string, review struct<passed boolean, personal_advice boolean, checks array<struct<id string, supported boolean, fact_ids array<string>, entity_numbers_units_dates_match boolean>>>"
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], schema)
    blocks = F.array(*[F.struct(F.lit(i).alias("id"), F.lit("text").alias("text")) for i in ("title", "p1")])
    found = df.select("name", gates.review_reasons(blocks, F.array(F.lit("f1"), F.lit("n1")), F.col("review")).alias("r")).collect()
    assert {r.name: r.r for r in found} == {k: v[1] for k, v in cases.items()}


def test_replies(spark):
    rest = '"type":"makro","next_step":"overvak"'
    replies = [
        (1, f'[{{"id":1,"score":120.2,"section":"Renter","reason":" a  b ","attention":44.5,"credit":true,{rest}}},{{"id":2,"score":49.5,"section":"Sport","reason":"x",{rest}}}]'),
        (2, f'[{{"id":3,"score":49.5,"section":"Analyse","reason":"x",{rest}}},{{"id":3,"score":-4,"section":"Analyse","reason":"y",{rest}}},{{"id":99,"score":1,"section":"Analyse","reason":"z",{rest}}}]'),
        (3, "not json"), (4, None), (5, f'[{{"id":4,"section":"Renter","reason":"x",{rest}}}]'), (6, f'[{{"id":5,"score":1,"section":"Renter","reason":"  ",{rest}}}]'),
        (7, '[{"id":6,"score":1,"section":"Renter","reason":"x","type":"makro","next_step":"vent"}]'), (8, '[{"id":6,"score":1,"section":"Renter","reason":"x","type":"sport","next_step":"overvak"}]'),
    ]
    asked = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    got = gates.scored_replies(asked, spark.createDataFrame(replies, "place int, body string")).collect()
    assert {r.id: (r.score, r.section, r.reason, r.attention, r.numbers, r.credit) for r in got if not r.deferred} == {1: (100, "Renter", "a b", 45, 0, True), 3: (0, "Analyse", "y", 0, 0, False)}
    assert {r.id for r in got if r.deferred} == {2, 4, 5, 6}


def test_fingerprint(spark):
    one = spark.range(1).select(gates.fingerprint(b=F.lit(1), a=F.lit(None).cast("string")).alias("x"), gates.fingerprint(a=F.lit(None).cast("string"), b=F.lit(1)).alias("y"), gates.fingerprint(b=F.lit(1)).alias("z")).first()
    assert one.x == one.y != one.z


def test_quotes_in_other_forms(spark):
    """Ligatures, full width and combining marks are no difference between a quote and its source."""
    schema = "documents array<struct<url: string, role: string, document_type: string, fetched: boolean, published: timestamp, date_kind: string, text: string>>, pack struct<can_write: boolean, matches_event: boolean, confidence: int, headline_fact: string, headline_fact_ids: array<string>, facts: array<struct<id: string, source_url: string, evidence_quote: string>>, numbers: array<struct<id: string, source_url: string, evidence_quote: string>>>"
    now = dt.datetime(2024, 5, 1, 12)
    rows = []
    for text, quote in (("The o\ufb03ce of \uff21cme said so", "office of Acme said"), ("Cafe\u0301 prices rise today", "Caf\u00e9 prices rise"), ("plain words in a row", "plain words in"), ("plain words in a row", "other words in"), (None, "plain words in a row")):
        rows.append(([("u", "primary", "article", True, now, "meta", text)], (True, True, 90, "x", ["f"], [("f", "u", quote)], None)))
    df = spark.createDataFrame(rows, schema)
    got = gates.researched(df, F.lit(True), F.col("documents"), F.col("pack"), F.lit(now).cast("timestamp")).collect()
    assert [r.reasons for r in got] == [[], [], [], ["evidence_missing:1"], ["evidence_missing:1"]]


def test_nested_fingerprints(spark):
    import hashlib
    import json

    texts = ['{"b": [1, {"z": null, "y": "æ"}], "a": {"d": true, "c": 2.50}}', '{"a":{"c":2.5,"d":true},"b":[1,{"y":"æ","z":null}]}', '{"a":{"c":2.5,"d":true},"b":[{"y":"æ","z":null},1]}', "[broken", None]
    got = [r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select(documents.fingerprint_of(F.col("t")).alias("f")).collect()]
    plain = lambda t: hashlib.sha256(json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert got[0] == got[1] == plain(texts[1]) and got[2] == plain(texts[2]) != got[0] and got[3:] == [None, None]


def test_objects_merge(spark):
    rows = [('{"a":1,"b":{"x":1}}', '{"b":{"y":2},"c":[null]}', '{"a":1,"b":{"y":2},"c":[null]}'), ("null", '{"b":2}', '{"b":2}'), ('{"a":null}', "[1]", '{"a":null}'), (None, None, "{}")]
    df = spark.createDataFrame(rows, "t string, p string, want string")
    assert [r.m for r in df.select(documents.merged(F.col("t"), F.col("p")).alias("m")).collect()] == [w for _, _, w in rows]
    one = df.select(documents.without(F.col("t"), "a", "z").alias("w"), documents.counted(F.lit('{"write": 2}'), F.lit("write")).alias("n"), documents.counted(F.lit("{}"), F.lit("write")).alias("first")).first()
    assert (one.w, one.n, one.first) == ('{"b":{"x":1}}', '{"write":3}', '{"write":1}')


def test_linked_dates_at_any_depth(spark):
    deep = '{"@type":"Article","datePublished":"in"}'
    for _ in range(40):
        deep = '[{"@graph":[[' + deep + "]]}]"
    texts = [deep, '{"@type":["X","Article"],"datePublished":"a","@graph":{"@type":"BlogPosting","datePublished":"b"}}', '[{"@type":"Person","datePublished":"n"},{"@type":"NewsArticle"},5,null,{"@type":"Article","datePublished":"c"}]', "{bad", None]
    got = [r.d for r in spark.createDataFrame([(t,) for t in texts], "t string").select(documents.linked_dates(F.col("t")).alias("d")).collect()]
    assert got == [["in"], ["a", "b"], ["c"], [], []]
