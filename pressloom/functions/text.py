"""Text, URL and similarity functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import base_letters


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(base_letters(text), r"[^a-z0-9æøå]+", " "))


def tokens(text: Column, stop: list[str], least: int = 3) -> Column:
    return F.array_distinct(F.filter(F.split(normalised(text), " "), lambda x: (F.length(x) >= least) & ~x.isin(stop)))


def similarity(a: Column, b: Column) -> Column:
    """The larger of containment and 1.35 times Jaccard; it can pass 1. Zero if either is empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.greatest(both / F.least(F.size(a), F.size(b)), 1.35 * both / either))


def slug(title: Column, most: int = 80) -> Column:
    plain = base_letters(title)
    plain = F.replace(F.replace(plain, F.lit("æ"), F.lit("ae")), F.lit("ø"), F.lit("o"))
    return F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def html_text(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(mark))
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r\f]+", " "))


def xml_escaped(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]*)", 1)), r"^www\.", "")


#: Named characters of official pages: fixed values.
NAMED = {
    "amp": "&", "quot": '"', "apos": "'", "nbsp": " ", "aring": "å", "Aring": "Å", "oslash": "ø", "Oslash": "Ø", "aelig": "æ", "AElig": "Æ",
    "eacute": "é", "Eacute": "É", "egrave": "è", "Egrave": "È", "uuml": "ü", "Uuml": "Ü", "ouml": "ö", "Ouml": "Ö", "auml": "ä", "Auml": "Ä",
    "ndash": "–", "mdash": "—", "hellip": "…", "laquo": "«", "raquo": "»", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "minus": "−", "ensp": " ", "emsp": " ", "thinsp": " ",
}


def character(code: Column) -> Column:
    """The character of a number; null for numbers that Unicode doesn't have."""
    n = code.try_cast("int")
    return F.when(n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def entities(text: Column) -> Column:
    """Character references resolved in one pass: those of NAMED (by exact case) and numbers; others stay as they are."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def one(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[xX][0-9a-fA-F]+|#\d+|[a-zA-Z]+);", 1)
        sixteen = F.lower(name).startswith("#x")
        number = F.when(sixteen & (F.length(name) <= 9), F.conv(F.substring(name, 3, 9), 16, 10)).when(~sixteen & name.startswith("#"), F.substring(name, 2, 9))
        sign = F.coalesce(F.when(name.startswith("#"), character(number)).otherwise(F.try_element_at(names, name)))
        known = (i > 0) & (name != "") & sign.isNotNull()
        return F.when(known, F.concat(sign, F.regexp_replace(part, "^[^;]*;", ""))).when(i > 0, F.concat(F.lit("&"), part)).otherwise(part)

    return F.array_join(F.transform(F.split(text, "&"), one), "")


def html_plain(html: Column) -> Column:
    """Text of an official page: without scripts, styles and tags, references resolved, white space as single blanks."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>", " ")
    return F.trim(F.regexp_replace(entities(F.regexp_replace(bare, "<[^>]+>", " ")), r"[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+", " "))


def quoted(text: Column) -> Column:
    """The first two quoted phrases of 18 to 180 characters and four words or more."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit('[«"“]([^»"”]{18,180})[»"”]'), F.lit(1))
    return F.slice(F.filter(F.transform(found, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: F.size(F.split(p, " ")) >= 4), 1, 2)


def window_of(text: Column, title: Column, most: int = 18_000, before: int = 3_500) -> Column:
    """`text` on one line; of a longer one the part around the first of the title's long words that it has."""
    words = F.slice(F.filter(F.split(normalised(F.coalesce(title, F.lit(""))), " "), lambda w: F.length(w) > 4), 1, 5)

    def around(line: Column, low: Column) -> Column:
        at = F.filter(F.transform(words, lambda w: F.position(w, low)), lambda n: n > 0)
        start = F.greatest(F.lit(1), F.coalesce(F.get(at, F.lit(0)), F.lit(1)) - before)
        return line.substr(start.cast("int"), F.lit(most))

    def held(line: Column) -> Column:
        return F.when(F.length(line) <= most, line).otherwise(F.get(F.transform(F.array(F.lower(line)), lambda low: around(line, low)), 0))

    # A lambda's argument is computed once, however often its body uses it.
    return F.get(F.transform(F.array(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))), held), 0)


def sentences(text: Column) -> Column:
    """Sentences as structs (id, body): split behind . ! or ? before a capital letter or a dash."""
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-ZÆØÅ–])")
    return F.transform(parts, lambda s, i: F.struct(F.concat(F.lit("S"), (i + 1).cast("string")).alias("id"), s.alias("body")))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:[,.]\d+)?"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit(".")).cast("double"))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def unlinked(text: Column) -> Column:
    """Markdown links as their words."""
    return F.regexp_replace(text, r"\[([^\]]{1,180})\]\((https?://[^\s)]+)\)", "$1")


def links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[[^\]]{1,180}\]\((https?://[^\s)]+)\)"), F.lit(1))


def unfenced(text: Column) -> Column:
    """A reply without the code fence around it."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*|\s*```$", ""))
