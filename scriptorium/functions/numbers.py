"""Numbers in words, as Column functions and as the SQL expressions of the same rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import bound

#: The words of numbers.
ONES = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
)
TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
SCALES = ("", " thousand", " million")
#: Endings of cardinals and of their ordinals; any other takes "th".
ORDINAL_ENDINGS = (("one", "first"), ("two", "second"), ("three", "third"), ("five", "fifth"), ("eight", "eighth"), ("nine", "ninth"), ("twelve", "twelfth"), ("y", "ieth"))
#: Digits of the largest number that is put into words.
MOST_DIGITS = 18


#: Words of 0 to 99, by rule.
BELOW_100 = tuple(ONES[n] if n < 20 else TENS[n // 10] + ("-" + ONES[n % 10] if n % 10 else "") for n in range(100))


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


def int_words(n: Column, british: bool = False) -> Column:
    """A whole number below 10**18 in words, null for others: ``one thousand two hundred thirty-four``, or, if ``british``,
    ``one thousand, two hundred and thirty-four``."""
    table = F.split(F.lit("|".join(BELOW_100)), "[|]")
    scales = F.split(F.lit("| thousand| million| billion| thousand billion| million billion"), "[|]")

    def word(p: Column) -> Column:
        v = p["v"]
        hundreds = F.when(v >= 100, F.concat(F.get(table, _div(v, 100).cast("int")), F.lit(" hundred")))
        return F.concat(F.concat_ws(" and " if british else " ", hundreds, F.when(v % 100 > 0, F.get(table, (v % 100).cast("int")))), F.get(scales, p["k"]))

    n = n.cast("long")
    groups = F.array(*(F.struct((_div(F.abs(n), 1000**k) % 1000).alias("v"), F.lit(k).alias("k")) for k in reversed(range(6))))
    spoken = F.array_join(F.transform(F.filter(groups, lambda p: p["v"] > 0), word), ", " if british else " ")
    if british:
        spoken = F.regexp_replace(spoken, ", ([a-z]+(?:-[a-z]+)?)$", " and $1")
    # where billions have thousands or millions of their own, the word billion comes once
    spoken = F.regexp_replace(spoken, r"(thousand|million) billion(?=.* billion)", "$1")
    return F.when(F.abs(n) < 10**MOST_DIGITS, F.concat(F.when(n < 0, "negative ").otherwise(""), F.when(n == 0, "zero").otherwise(spoken)))


def ordinal(words: Column) -> Column:
    """The ordinal of a number in words."""
    out = F.when(F.lit(False), "")
    for end, new in ORDINAL_ENDINGS:
        out = out.when(F.endswith(words, F.lit(end)), F.concat(F.left(words, F.length(words) - len(end)), F.lit(new)))
    return out.otherwise(F.concat(words, F.lit("th")))


def title(words: Column) -> Column:
    """Each word, and each part of a hyphened one, with a capital."""
    return F.replace(F.initcap(F.replace(words, F.lit("-"), F.lit("- "))), F.lit("- "), F.lit("-"))


def digits_to_long(text: Column) -> Column:
    """The number that a string of digits and commas stands for, null if it has more than MOST_DIGITS."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    return F.when(F.length(plain) <= MOST_DIGITS, plain.cast("long"))


def substitute(text: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """``text`` with each match replaced by ``new`` of it; a match for which that is null stays."""

    def joined(t: Column) -> Column:
        pieces = F.zip_with(F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), 0), lambda rest, m: F.concat(F.coalesce(rest, F.lit("")), F.coalesce(new(m), m, F.lit(""))))
        return F.array_join(pieces, "")

    return bound(text, joined)


def _list_sql(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def int_words_sql(n: str) -> str:
    """SQL of :func:`int_words`; ``n`` is the name of a BIGINT."""
    ones, tens = _list_sql(ONES), _list_sql(TENS)
    hundred = lambda v: f"CASE WHEN {v} < 20 THEN {ones}[({v}) + 1] ELSE {tens}[({v}) // 10 + 1] || CASE WHEN ({v}) % 10 > 0 THEN '-' || {ones}[({v}) % 10 + 1] ELSE '' END END"
    thousand = lambda v: f"CASE WHEN {v} < 100 THEN {hundred(v)} ELSE {ones}[({v}) // 100 + 1] || ' hundred' || CASE WHEN ({v}) % 100 > 0 THEN ' ' || ({hundred(f'(({v}) % 100)')}) ELSE '' END END"
    groups = lambda x: f"array_to_string(list_transform(list_filter(list_transform([2, 1, 0], lambda g: {{'g': g, 'v': CAST({x} // CAST(pow(1000, g) AS BIGINT) % 1000 AS BIGINT)}}), lambda p: p.v > 0), lambda p: ({thousand('p.v')}) || {_list_sql(SCALES)}[p.g + 1]), ' ')"
    return f"CASE WHEN {n} = 0 THEN 'zero' WHEN {n} < 1000000000 THEN {groups(n)} WHEN {n} < 1000000000000000000 THEN {groups(f'({n} // 1000000000)')} || ' billion' || CASE WHEN {n} % 1000000000 > 0 THEN ' ' || {groups(f'({n} % 1000000000)')} ELSE '' END END"


def ordinal_sql(words: str) -> str:
    """SQL of :func:`ordinal`."""
    return "CASE " + " ".join(f"WHEN suffix({words}, '{end}') THEN left({words}, length({words}) - {len(end)}) || '{new}'" for end, new in ORDINAL_ENDINGS) + f" ELSE {words} || 'th' END"


def title_sql(words: str) -> str:
    """SQL of :func:`title`."""
    return f"array_to_string(list_transform(string_split({words}, ' '), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda p: upper(p[1]) || p[2:]), '-')), ' ')"


def digits_sql(text: str) -> str:
    plain = f"replace({text}, ',', '')"
    return f"CASE WHEN length({plain}) <= {MOST_DIGITS} THEN CAST({plain} AS BIGINT) END"


def substitute_sql(text: str, pattern: str, new: str) -> str:
    """SQL of :func:`substitute`; ``new`` is an expression over the match ``m``."""
    found, rest = f"regexp_extract_all(t, '{pattern}')", f"regexp_split_to_array(t, '{pattern}')"
    pieces = f"list_transform(list_zip({rest}, {found}), lambda z: coalesce(z[1], '') || coalesce(list_transform([z[2]], lambda m: {new})[1], z[2], ''))"
    return f"list_transform([{text}], lambda t: array_to_string({pieces}, ''))[1]"
