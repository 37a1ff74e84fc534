"""Pattern lists looked up in the words of a text, in one pass over it.

Most of a desk's patterns are lists of words and phrases. They are compiled to literal phrases, which are looked
up by hash in the text's own runs of tokens; single words with any ending are looked up by their stems. What no finite list of
phrases can stand for stays a regular expression, tried only on texts that have one of the words it starts with.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache, reduce
from operator import add, or_
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word boundary between ASCII word characters and all others, whatever the JVM takes `\b` for.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
SPACE = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: White space that isn't one blank alone: replaced by a blank, it leaves what SPACE+ leaves, without writing every blank anew.
UNEVEN = rf"(?![!-~])(?:[\t-\r\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}]{SPACE}*| {SPACE}+)"
TOKEN = "[a-z0-9_]+|[^a-z0-9_]"
#: Characters that fold to others in lower case, but never match them in a pattern: they count as marks.
FOREIGN = "\u212a\u212b\u0130"
_BOUND = "\x00"


class Unbounded(Exception):
    """No finite list of strings."""


def _strings(tree: list) -> list[str]:
    out = [""]
    for op, value in tree:
        if op is C.LITERAL:
            one = [chr(value)]
        elif op is C.BRANCH:
            one = [s for branch in value[1] for s in _strings(branch)]
        elif op is C.SUBPATTERN:
            one = _strings(value[-1])
        elif op is C.MAX_REPEAT and value[1] == 1:
            one = [*[""] * (value[0] == 0), *_strings(value[2])]
        elif op is C.IN and all(kind is C.LITERAL for kind, _ in value):
            one = [chr(x) for _, x in value]
        elif op is C.AT and value is C.AT_BOUNDARY:
            one = [_BOUND]
        else:
            raise Unbounded
        out = [a + b for a in out for b in one]
    return out


def _leading(pattern: str) -> list[str]:
    """Strings that a match must begin with one of, as far as they are finite; none if nothing is known."""
    out, tree = [""], parser.parse(pattern)
    for item in tree:
        try:
            out = [a + b for a in out for b in _strings([item])]
        except Unbounded:
            break
    words = [x.replace(_BOUND, "").lower() for x in out]
    return [] if "" in words else list(dict.fromkeys(words))


def alternatives(pattern: str) -> list[str]:
    """The alternatives of `\\b(...)\\b`, or the pattern alone."""
    inside = pattern[3:-3] if pattern.startswith(r"\b(") and pattern.endswith(r")\b") else None
    if inside is None:
        return [pattern]
    out, depth, at = [""], 0, 0
    while at < len(inside):
        step = inside[at : at + 2] if inside[at] == "\\" else inside[at]
        depth += (step == "(") - (step == ")")
        if depth < 0:  # the first bracket isn't the last one's
            return [pattern]
        out = [*out, ""] if step == "|" and not depth else [*out[:-1], out[-1] + step]
        at += len(step)
    return [rf"\b{x}\b" for x in out]


@dataclass
class Compiled:
    """What a pattern matches: phrases, stems, and expressions with the words that they need."""

    phrases: set[str] = field(default_factory=set)
    stems: set[str] = field(default_factory=set)
    rest: list[tuple[str, list[str]]] = field(default_factory=list)


_word = re.compile("[a-z0-9_]", re.ASCII)


@cache
def compiled(pattern: str) -> Compiled:
    out = Compiled()
    for one in alternatives(pattern):
        stem = re.fullmatch(r"\\b([a-z0-9_]+)\\w\*\\b", one)
        if stem:
            out.stems.add(stem[1])
            continue
        try:
            found = [x.lower() for x in _strings(parser.parse(one))]
        except Unbounded:
            out.rest.append((one, _leading(one)))
            continue
        for text in found:
            bare = text.strip(_BOUND)
            # Inside a phrase a boundary is there or it isn't; at its ends it is one if the letter there is of a word.
            whole = re.split(_BOUND, bare)
            if any(bool(_word.match(a[-1:])) == bool(_word.match(b[:1])) for a, b in zip(whole, whole[1:], strict=False)):
                continue
            bare = "".join(whole)
            if text.startswith(_BOUND) and text.endswith(_BOUND) and _word.match(bare) and _word.match(bare[-1]):
                out.phrases.add(bare)
            else:
                sign = lambda s: s.replace(_BOUND, r"\b") if s == _BOUND else re.escape(s)
                out.rest.append(("".join(map(sign, text)), [bare]))
    return out


def expression(pattern: str) -> str:
    """A pattern for the JVM: any case, boundaries by ASCII letters, every kind of white space."""
    one = re.sub(r"^\\b(?=[A-Za-z0-9_])", lambda m: "(?<![A-Za-z0-9_])", pattern)
    one = re.sub(r"(?<=[A-Za-z0-9_])(?<!\\[a-zA-Z])\\b$", lambda m: "(?![A-Za-z0-9_])", one)
    return "(?iu)" + one.replace(r"\b", EDGE).replace(r"\s", SPACE)


def hit(text: Column, pattern: str) -> Column:
    """Whether `text` matches one pattern."""
    return text.rlike(expression(pattern))


def folded(text: Column) -> Column:
    """The text in lower case, its own marks kept apart."""
    return F.lower(F.translate(text, FOREIGN, "\x01\x01\x01"))


def _among(value: Column, words: set[str]) -> Column:
    return value.isin(sorted(words))


def found(text: Column, patterns: list[str]) -> Column:
    """The phrases and stems of any of the patterns that folded `text` has, as an array; stems end in `*`."""
    every = [compiled(p) for p in patterns]
    phrases, stems = set().union(*(x.phrases for x in every)), set().union(*(x.stems for x in every))
    parts = {x: re.findall(TOKEN, x) for x in phrases}
    first, lengths = {x[0] for x in parts.values()}, sorted({len(x) for x in parts.values()})
    sizes = sorted({len(x) for x in stems})

    def at(tokens: Column, token: Column, i: Column) -> Column:
        runs = [F.array_join(F.slice(tokens, i + 1, n), "") if n > 1 else token for n in lengths]
        hits = F.filter(F.array(*runs), lambda x: _among(x, phrases)) if phrases else F.array().cast("array<string>")
        hits = F.when(_among(token, first), hits).otherwise(F.array().cast("array<string>")) if phrases else hits
        if not stems:
            return hits
        ends = [F.when(_among(F.substring(token, 1, n), {x for x in stems if len(x) == n}), F.concat(F.substring(token, 1, n), F.lit("*"))) for n in sizes]
        return F.concat(hits, F.filter(F.array(*ends), lambda x: x.isNotNull()))

    def look(tokens: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(tokens, lambda token, i: at(tokens, token, i))))

    # A lambda's argument is computed once, however often its body uses it.
    return F.element_at(F.transform(F.array(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))), look), 1)


def matched(text: Column, hits: Column, pattern: str) -> Column:
    """Whether folded `text`, whose phrases found() gave as `hits`, matches the pattern."""
    x = compiled(pattern)
    names = x.phrases | {f"{s}*" for s in x.stems}
    tests = [F.exists(hits, lambda h: _among(h, names))] if names else []
    for one, words in x.rest:
        test = text.rlike(expression(one))
        tests.append(reduce(or_, [F.contains(text, F.lit(w)) for w in words]) & test if words else test)
    return reduce(or_, tests)


def with_counts(items: DataFrame, text: Column, groups: dict[str, list[str]]) -> DataFrame:
    """`items` with __text (folded) and, for each group of patterns, how many of them it matches. The text and what was
    found in it come out of a generator, so that no later rule or filter repeats the search."""
    every = [p for patterns in groups.values() for p in patterns]
    seen = items.select("*", F.explode(F.array(folded(text))).alias("__text"))
    seen = seen.select("*", F.explode(F.array(found(F.col("__text"), every))).alias("__found"))
    counts = {f"__{name}": reduce(add, [matched(F.col("__text"), F.col("__found"), p).cast("int") for p in patterns]) for name, patterns in groups.items()}
    return seen.withColumns(counts).drop("__found")


def names(text: Column, pattern: str) -> Column:
    """Whether `text` has one of the names of a pattern that only lists names, in any case."""
    some = lambda t: reduce(or_, [F.contains(t, F.lit(x.lower())) for x in pattern.split("|")])
    return F.element_at(F.transform(F.array(folded(text)), some), 1)
