"""Finders of tax ids, dates, amounts and keywords: native regular expressions with offsets."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchment.functions import fixed
from parchment.functions.text import digits

TAX_ID = f"(?iU)({fixed.TAX_ID})"
DATE = f"(?iU)({fixed.DATE})"
AMOUNT_PLAIN = f"(?iU)({fixed.AMOUNT})"
#: The same matches as AMOUNT_PLAIN, without its cubic time on runs of blanks and square time on runs and chains of digits: what
#: fails from the beginning of a run, or of a chain of groups of three, isn't tried again from within it, unless the last match
#: ended there.
_RUN = r"(?:(?<!\d)|\G)"
_CHAIN = rf"(?:{_RUN}|(?<=\d)(?=\d{{3}}(?!\d)))(?:(?<!\d[\s.,])|\G|(?<=\G[\s.,])|(?!\d{{3}}[\s.,]))"
AMOUNT = (
    rf"(?iU)({fixed.CURRENCY_MARK}?(?:(?<!\s)\s++)?(?:-\s*+)?"
    rf"(?:{_CHAIN}\d{{1,3}}(?:[\s.,]\d{{3}})+[.,]\d{{2}}|{_RUN}\d++[.,]\d{{2}})\s*+{fixed.CURRENCY_MARK}?)"
)
KEYWORD = "(?iU)(" + "|".join(re.escape(k).replace(r"\ ", " ") for k in fixed.KEYWORDS) + ")"
#: Letters that are one by Unicode's case, beside capital and small.
_ALIKE = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


def _letter(c: str) -> str:
    return f"[{c.lower()}{c.upper()}{_ALIKE.get(c.lower(), '')}]" if c.isalpha() else re.escape(c).replace(r"\ ", " ")


def _tree(words: list[str]) -> str:
    """A pattern of words, none of which begins another, that branches at their first letters; in any case, without the flags for it."""
    if len(words) == 1:
        return "".join(map(_letter, words[0]))
    heads = dict.fromkeys(w[0] for w in words)
    return "(?:" + "|".join(_letter(h) + _tree([w[1:] for w in words if w[0] == h]) for h in heads) + ")"


#: The same matches as KEYWORD.
KEYWORD_TREE = f"({_tree([k.lower() for k in fixed.KEYWORDS])})"


def matches(text: Column, pattern: str) -> Column:
    """Texts of all matches, left to right."""
    return F.regexp_extract_all(text, F.lit(pattern), 1)


#: Put around matches; a character that no text may hold, and that no pattern matches.
MARK = "\ufdd0"
#: Lengths that are summed at once, which keeps the time of a running sum near linear.
BLOCK = 256


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), f)[0]


def running(lengths: Column) -> Column:
    """Sums of all earlier lengths, for each place of a non-empty array."""

    def scan(values: Column, start: Column) -> Column:
        nothing = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(values, nothing, step, lambda acc: acc["out"])

    total = lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda k: F.slice(lengths, k * BLOCK + 1, F.lit(BLOCK)))
    return once(blocks, lambda b: F.flatten(F.zip_with(b, scan(F.transform(b, total), F.lit(0)), scan)))


def spans(text: Column, pattern: str, kind: str) -> Column:
    """``array<struct<kind, start, text>>`` of all matches.

    The pattern runs once and puts marks around its matches; a split at the marks gives the gaps and the matches in turn, and
    their lengths the starts.
    """
    out = "array<struct<kind:string,start:int,text:string>>"
    marked = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit("\ufffd")), pattern, f"{MARK}$1{MARK}")

    def found(parts: Column) -> Column:
        one = lambda starts, k: F.struct(F.lit(kind).alias("kind"), starts[2 * k - 1].alias("start"), parts[2 * k - 1].alias("text"))
        some = once(running(F.transform(parts, F.length)), lambda starts: F.transform(F.sequence(F.lit(1), ((F.size(parts) - 1) / 2).cast("int")), lambda k: one(starts, k)))
        return F.when(F.size(parts) > 1, some).otherwise(F.array().cast(out))

    return F.when(text.isNotNull(), once(F.split(marked, MARK, -1), found))


#: Put where text was left out; like MARK.
CUT = "\ufdd1"
#: Text far from any digit. Tax ids, dates and amounts have a digit; where no run of white space is longer than eight, they begin at most 20
#: characters before their first, end at most 11 after their last, and have at most 28 others between two. Patterns look two characters back.
#: So what lies beyond 12 characters after a digit and 24 before the next is in none of them.
FAR = r"(?U)(\D{12})(\D{28,})(\D{24})"
WIDE = r"(?U)\s{9}"


def near_digits(text: Column) -> Column:
    """``text`` without what is FAR from digits: it has the same tax ids, dates and amounts in the same order, at other places. These patterns
    take some hundred times longer a character than this one. Texts with WIDE white space stay whole."""
    return F.when(text.rlike(WIDE), text).otherwise(F.regexp_replace(text, FAR, f"$1{CUT}$3"))


def tax_ids(text: Column) -> Column:
    return F.filter(matches(near_digits(text), TAX_ID), lambda x: F.length(digits(x)) == 10)


def dates(text: Column) -> Column:
    return matches(near_digits(text), DATE)


def amounts(text: Column) -> Column:
    return matches(near_digits(text), AMOUNT)


def all_spans(text: Column) -> Column:
    """Tax ids, dates, amounts, in this order of kinds; each of them has a digit, and they are looked for near digits alone."""
    out = "array<struct<kind:string,start:int,text:string>>"
    pieces = F.split(F.regexp_replace(F.replace(text, F.lit(CUT), F.lit("\ufffd")), FAR, f"$1{CUT}$2{CUT}$3"), CUT, -1)
    parts = F.when(text.rlike(WIDE), F.array(text)).otherwise(pieces)  # near, far, near, ...

    def near(parts: Column, starts: Column) -> Column:
        def of(pattern: str, kind: str) -> Column:
            moved = lambda m, k: F.struct(m["kind"].alias("kind"), (m["start"] + starts[2 * k]).alias("start"), m["text"].alias("text"))
            one = lambda k: F.transform(spans(parts[2 * k], pattern, kind), lambda m: moved(m, k))
            return F.flatten(F.transform(F.sequence(F.lit(0), ((F.size(parts) - 1) / 2).cast("int")), one))

        ids = F.filter(of(TAX_ID, "nip"), lambda x: F.length(digits(x["text"])) == 10)
        return F.concat(ids, of(DATE, "date"), of(AMOUNT, "amount"))

    every = once(parts, lambda p: once(running(F.transform(p, F.length)), lambda starts: near(p, starts)))
    return F.when(text.rlike(r"(?U)\d"), every).when(text.isNotNull(), F.array().cast(out))


def occurs_in(value: Column, source: Column, normal_value: Column, normal_source: Column) -> Column:
    """Whether a value is in its source: its normal form as a part, or its ten digits as a tax id found there."""
    own = digits(value)
    by_text = (normal_value != "") & normal_source.contains(normal_value)
    by_id = (F.length(own) == 10) & F.array_contains(F.transform(tax_ids(source), lambda x: digits(x)), own)
    return F.coalesce(by_text, F.lit(False)) | F.coalesce(by_id, F.lit(False))
