"""Normal forms of Unicode: base letters in native expressions, whole NFKC and NFKD over Arrow where a text isn't ASCII."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII = r"^[\x00-\x7F]*$"
#: Letters that words are made of; all others separate them.
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789æøå")
#: Combining marks that are taken off.
MARKS = range(0x0300, 0x0370)


@cache
def tables() -> tuple[str, str, dict[str, str]]:
    """What lower-case characters are in base letters: those that become one letter, these letters, and those that become more.

    By compatibility decomposition without marks; what isn't in LETTERS then is a blank. Characters that become blanks alone are left out:
    they separate words as they are.
    """
    one, base, more = [], [], {}
    for code in range(0x80, 0x110000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or code in MARKS or c in "æø":
            continue
        plain = "".join(x if x in LETTERS else " " for x in unicodedata.normalize("NFKD", c) if ord(x) not in MARKS)
        if len(plain) == 1 and plain != " ":
            one.append(c)
            base.append(plain)
        elif plain.strip() or not plain:
            more[c] = plain
    return "".join(one), "".join(base), more


def _runs(codes: list[int]) -> str:
    """A class of characters, for the JVM."""
    runs: list[list[int]] = []
    for c in codes:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(rf"\x{{{a:x}}}" + (rf"-\x{{{b:x}}}" if b > a else "") for a, b in runs) + "]"


#: Latin-1 letters with marks and their base letters (ø and æ stay): what most texts beyond ASCII are made of.
MARKED, BASE = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
_LATIN = r"^[\x00-\x7F\x{c0}-\x{ff}]*$"


def base_letters(text: Column) -> Column:
    """`text` in lower case, decomposed, without marks: letters and digits as words compare them, other characters as they are."""
    one, base, more = tables()
    plain = F.translate(F.regexp_replace(F.lower(text), _runs(list(MARKS)), ""), one, base)
    # One string, so that the plan holds one literal.
    names = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in more.items())), F.lit("\x01"), F.lit("\x02"))
    spelt = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.try_element_at(names, c), c)), "")
    whole = F.when(plain.rlike(_runs(sorted(map(ord, more)))), spelt(plain)).otherwise(plain)
    return F.when(text.rlike(_LATIN), F.translate(F.lower(text), MARKED, BASE)).otherwise(whole)


def _normal(form: str):
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unicodedata.normalize(form, x) for x in texts.to_pylist()], pa.string())

    return run


def normalised(text: Column, form: str) -> Column:
    """`text` in a normal form (NFC, NFD, NFKC, NFKD). ASCII is in all of them, so only other texts go to a Python worker."""
    plain = text.rlike(ASCII)
    return F.coalesce(F.when(plain, text), _normal(form)(F.when(~plain, text)))


def _normal_lists(form: str):
    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        flat = [None if x is None else unicodedata.normalize(form, x) for x in lists.flatten().to_pylist()]
        held = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        ends = pa.array(np.concatenate(([0], np.cumsum(held))), pa.int32())
        out = pa.ListArray.from_arrays(ends, pa.array(flat, pa.string()))
        return pc.if_else(lists.is_null(), pa.scalar(None, out.type), out) if lists.null_count else out

    return run


def all_normalised(texts: Column, form: str) -> Column:
    """A list of texts, each in a normal form: a Python function can't stand inside a lambda."""
    plain = F.forall(texts, lambda t: F.coalesce(t.rlike(ASCII), F.lit(True)))
    return F.coalesce(F.when(plain, texts), _normal_lists(form)(F.when(~plain, texts)))
