"""Texts made ready to be read aloud, as Column functions; the SQL of each rule stands beside it where RE2 can say it."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scriptorium.functions.numbers import digits_sql, digits_to_long, int_words, int_words_sql, ordinal, ordinal_sql, substitute, substitute_sql, title, title_sql
from scriptorium.functions.text import bound, normalize_spaces, punctuation_spacing

#: White space of these rules, as a class that Java and RE2 read alike.
WS = r"[ \t\n\x0b\f\r]"

#: Characters that the first normalizer folds, after NFKC.
FOLDED = (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "--"), ("…", "..."))
#: Characters that the ASCII cleaner replaces.
ASCII_FORMS = (
    ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("…", "..."), ("ﬁ", "fi"), ("ﬂ", "fl"), ("′", "'"), ("″", '"'), ("·", "."), ("‐", "-"),
)
#: Currency signs and their names.
CURRENCIES = (("$", "dollars"), ("€", "euros"), ("£", "pounds"), ("¥", "yen"), ("₹", "rupees"), ("₽", "rubles"), ("₿", "bitcoin"))
#: Currency signs whose hundredths have a name.
CENTS = (("$", "cents"), ("€", "cents"), ("£", "pence"))
#: What currencies, percentages, ordinals and numbers look like.
MONEY = r"[€£¥₹₽₿$][0-9]+(?:,[0-9]{3})*(?:\.[0-9]{1,2})?"
PERCENT = rf"[0-9]+(?:\.[0-9]+)?{WS}*%"
ORDINAL = r"(?i)\b[0-9]+(?:st|nd|rd|th)\b"
NUMBER = r"\b[0-9]{1,3}(?:,[0-9]{3})*\b(?![.:]?[0-9])"
#: Ordinals that the table has; others stay as they are.
TABLED_ORDINALS = (*range(1, 24), 30, 31)
#: Abbreviations in order, and what they are read as.
ABBREVIATIONS = (
    ("Dr.", "Doctor"), ("Mr.", "Mister"), ("Mrs.", "Missus"), ("Ms.", "Ms"), ("Prof.", "Professor"), ("Sr.", "Senior"), ("Jr.", "Junior"), ("Rev.", "Reverend"),
    ("Ph.D.", "PhD"), ("Ph.D", "PhD"), ("M.D.", "MD"), ("M.D", "MD"), ("B.A.", "BA"), ("B.S.", "BS"), ("M.A.", "MA"), ("M.S.", "MS"), ("J.D.", "JD"), ("Esq.", "Esquire"),
    ("etc.", "et cetera"), ("i.e.", "that is"), ("e.g.", "for example"), ("vs.", "versus"), ("vs", "versus"), ("approx.", "approximately"), ("est.", "established"),
    ("a.m.", "AM"), ("p.m.", "PM"), ("A.M.", "AM"), ("P.M.", "PM"), ("St.", "Street"), ("Ave.", "Avenue"), ("Blvd.", "Boulevard"), ("Rd.", "Road"), ("Apt.", "Apartment"), ("Mt.", "Mount"),
    ("ft.", "feet"), ("in.", "inches"), ("lb.", "pounds"), ("lbs.", "pounds"), ("oz.", "ounces"), ("mi.", "miles"), ("yr.", "year"), ("yrs.", "years"), ("mo.", "month"), ("mos.", "months"),
    ("U.S.", "US"), ("U.S.A.", "USA"), ("U.K.", "UK"),
)
#: A saint's name, not a street's.
SAINT = r"\bSt\.\s+([A-Z][a-z]+)(?!\s+(?:Street|Ave|Avenue|Rd|Road|Blvd))"
#: Abbreviations that are spelled letter by letter.
SPACED = (
    ("I E P", "IEP"), ("A R D", "ARD"), ("R E E D", "REED"), ("B I P", "BIP"), ("F B A", "FBA"), ("L R E", "LRE"), ("F A P E", "FAPE"), ("I D E A", "IDEA"), ("S L D", "SLD"), ("O H I", "OHI"), ("E S Y", "ESY"), ("P W N", "PWN"), ("N O D", "NOD"),
)
#: Headings whose number is read as an ordinal, and numbers at a line's start.
HEADING = rf"(?i)\b(Book|Chapter|Section|Part){WS}+([0-9]+)\b"
LINE_NUMBER = rf"(?md)^[0-9]+{WS}+(?=[A-Z])"
#: A footnote runs from its number to the next one or the text's end, within a line.
FOOTNOTE = r"\[([0-9]+)\]([^\[\n]+?)(?=\[[0-9]+\]|\n?\z)"


def _normal_form(form: str):
    @F.pandas_udf(StringType())
    def normal(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize(form, t))

    return normal


def normal_form(text: Column, form: str) -> Column:
    """Unicode normal form, in Arrow batches; the JVM has no function for it."""
    return _normal_form(form)(text)


def replaced(text: Column, rules) -> Column:
    for old, new in rules:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def replaced_sql(text: str, rules) -> str:
    for old, new in rules:
        text = f"replace({text}, '{old.replace(chr(39), chr(39) * 2)}', '{new.replace(chr(39), chr(39) * 2)}')"
    return text


def unicode_fold(text: Column) -> Column:
    """NFKC, then plain quotes, dashes and ellipses."""
    return replaced(normal_form(text, "NFKC"), FOLDED)


def without_artifacts(text: Column) -> Column:
    from scriptorium.plans.sentences import ARTIFACTS

    for pattern in ARTIFACTS:
        text = F.regexp_replace(text, f"(?i){pattern}", "")
    return text


def spoken_v1(text: Column) -> Column:
    """Spaces, Unicode, artifacts and punctuation, in this order."""
    return punctuation_spacing(without_artifacts(unicode_fold(normalize_spaces(text))))


def heading_numbers(text: Column) -> Column:
    """``Chapter 3`` to ``Chapter Third``; 1 to 999 at a line's start before a capital to a cardinal."""

    def heading(m: Column) -> Column:
        number = title(ordinal(int_words(digits_to_long(F.regexp_extract(m, HEADING, 2)))))
        return F.concat(F.regexp_extract(m, HEADING, 1), F.lit(" "), number)

    def line(m: Column) -> Column:
        n = digits_to_long(F.regexp_extract(m, "^([0-9]+)", 1))
        return F.when((n >= 1) & (n <= 999), F.concat(title(int_words(n)), F.lit(" ")))

    return substitute(substitute(text, HEADING, heading), LINE_NUMBER, line)


def heading_numbers_sql(text: str) -> str:
    head = "list_transform([" + digits_sql("regexp_extract(m, '([0-9]+)', 1)") + "], lambda n: list_transform([" + int_words_sql("n") + "], lambda w: list_transform([" + ordinal_sql("w") + "], lambda o: regexp_extract(m, '^([A-Za-z]+)', 1) || ' ' || " + title_sql("o") + ")[1])[1])[1]"
    line = "list_transform([" + digits_sql("regexp_extract(m, '^([0-9]+)', 1)") + "], lambda n: CASE WHEN n BETWEEN 1 AND 999 THEN list_transform([" + int_words_sql("n") + "], lambda w: " + title_sql("w") + " || ' ' || right(m, 1))[1] END)[1]"
    return substitute_sql(substitute_sql(text, HEADING, head), rf"(?m)^[0-9]+{WS}+[A-Z]", line)


def footnotes(text: Column) -> Column:
    """(number, text) of each footnote, in order; blank ones are left out."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(FOOTNOTE), 1).alias("number"), F.transform(F.regexp_extract_all(text, F.lit(FOOTNOTE), 2), lambda t: F.trim(t)).alias("text"))
    return F.filter(found, lambda f: f["text"] != "")


def without_footnotes(text: Column) -> Column:
    """Footnotes marked ``[FOOTNOTE]``, if any has text."""
    return F.when(F.size(footnotes(text)) > 0, F.regexp_replace(text, FOOTNOTE, "[FOOTNOTE]")).otherwise(text)


def currency_words(text: Column) -> Column:
    """``$50.99`` to ``fifty dollars and ninety-nine cents``."""
    names, cents = (F.create_map(*(F.lit(x) for p in pairs for x in p)) for pairs in (CURRENCIES, CENTS))

    def spoken(m: Column) -> Column:
        sign, whole = F.left(m, F.lit(1)), int_words(digits_to_long(F.regexp_extract(m, r"^.([0-9,]+)", 1)))
        part = F.rpad(F.regexp_extract(m, r"\.([0-9]+)$", 1), 2, "0").cast("int")
        name, low = names[sign], cents[sign]
        both = F.when(low.isNotNull(), F.concat(whole, F.lit(" "), name, F.lit(" and "), int_words(part), F.lit(" "), low)).otherwise(F.concat(whole, F.lit(" point "), int_words(part), F.lit(" "), name))
        return F.when(part > 0, both).otherwise(F.concat(whole, F.lit(" "), name))

    return substitute(text, MONEY, spoken)


def _map_sql(pairs) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs) + "}"


def currency_words_sql(text: str) -> str:
    whole, part = "replace(regexp_extract(m, '^.([0-9,]+)', 1), ',', '')", r"rpad(regexp_extract(m, '\.([0-9]+)$', 1), 2, '0')"
    name, low = f"{_map_sql(CURRENCIES)}[m[1]]", f"{_map_sql(CENTS)}[m[1]]"
    spoken = f"CASE WHEN p > 0 THEN CASE WHEN {low} IS NOT NULL THEN w || ' ' || {name} || ' and ' || q || ' ' || {low} ELSE w || ' point ' || q || ' ' || {name} END ELSE w || ' ' || {name} END"
    inner = f"list_transform([CAST({part} AS BIGINT)], lambda p: list_transform([{int_words_sql('p')}], lambda q: {spoken})[1])[1]"
    return substitute_sql(text, MONEY, f"list_transform([{digits_sql(whole)}], lambda n: list_transform([{int_words_sql('n')}], lambda w: {inner})[1])[1]")


def percent_words(text: Column) -> Column:
    """``25%`` to ``twenty-five percent``, ``3.14%`` to ``three point one four percent``."""

    def spoken(m: Column) -> Column:
        part = F.regexp_extract(m, r"\.([0-9]+)", 1)
        digits = F.array_join(F.transform(F.filter(F.split(part, ""), lambda d: d != ""), lambda d: int_words(d.cast("long"))), " ")
        whole = int_words(digits_to_long(F.regexp_extract(m, "^([0-9]+)", 1)))
        return F.concat(whole, F.when(part.rlike("[1-9]"), F.concat(F.lit(" point "), digits)).otherwise(""), F.lit(" percent"))

    return substitute(text, PERCENT, spoken)


def percent_words_sql(text: str) -> str:
    digits = f"array_to_string(list_transform(regexp_extract_all(regexp_extract(m, '\\.([0-9]+)', 1), '[0-9]'), lambda d: list_transform([CAST(d AS BIGINT)], lambda k: {int_words_sql('k')})[1]), ' ')"
    return substitute_sql(text, PERCENT, f"list_transform([{digits_sql('regexp_extract(m, ' + chr(39) + '^([0-9]+)' + chr(39) + ', 1)')}], lambda n: ({int_words_sql('n')}) || CASE WHEN regexp_matches(m, '\\.[0-9]*[1-9]') THEN ' point ' || {digits} ELSE '' END || ' percent')[1]")


def simple_punctuation(text: Column) -> Column:
    """Dashes to commas, ellipses to a comma before a small letter and a point elsewhere, runs of marks to one."""
    for pattern, new in (("[—–]", ", "), (rf"\.\.\.(?={WS}+[a-z])", ","), (r"\.\.\.|…", "."), (r"!{2,}", "!"), (r"\?{2,}", "?"), (r"[!?]{2,}", "?!"), (WS + "{2,}", " "), (WS + "+,", ",")):
        text = F.regexp_replace(text, pattern, new)
    return text


def simple_punctuation_sql(text: str) -> str:
    for pattern, new in (("[—–]", ", "), (rf"\.\.\.({WS}+[a-z])", r",\1"), (r"\.\.\.|…", "."), (r"!{2,}", "!"), (r"\?{2,}", "?"), (r"[!?]{2,}", "?!"), (WS + "{2,}", " "), (WS + "+,", ",")):
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


def abbreviation_words(text: Column, boundary: bool = True) -> Column:
    """Abbreviations spelled out before white space, the end or a mark, by the rules in order; ``St.`` before a name is a
    saint. Without ``boundary`` a rule also applies within a word (``begin.`` to ``beginches``), as it once did."""
    text = F.regexp_replace(text, SAINT, "Saint $1")
    left = "(?<![A-Za-z0-9_])" if boundary else ""
    for short, full in ABBREVIATIONS:
        literal = short.replace(".", r"\.")
        text = F.regexp_replace(text, rf"(?i){left}{literal}(?={WS}|\z|[,;:'\")\]])", full)
    return text


def abbreviation_words_sql(text: str) -> str:
    """Without the rule for saints, which needs a look ahead."""
    for short, full in ABBREVIATIONS:
        literal = short.replace(".", r"\.")
        text = f"regexp_replace({text}, '\\b{literal}({WS}|\\z|[,;:''\")\\]])', '{full}\\1', 'gi')"
    return text


def ordinal_words(text: Column) -> Column:
    """``21st`` to ``twenty-first``, by the table; others stay."""

    def spoken(m: Column) -> Column:
        return bound(digits_to_long(F.regexp_extract(m, "^([0-9]+)", 1)), lambda n: F.when(n.isin(*TABLED_ORDINALS), ordinal(int_words(n))))

    return substitute(text, ORDINAL, spoken)


def ordinal_words_sql(text: str) -> str:
    return substitute_sql(text, ORDINAL, "list_transform([" + digits_sql("regexp_extract(m, '^([0-9]+)', 1)") + f"], lambda n: CASE WHEN n IN {TABLED_ORDINALS} THEN list_transform([{int_words_sql('n')}], lambda w: {ordinal_sql('w')})[1] END)[1]")


def number_words(text: Column, most_digits: int = 4) -> Column:
    """Standalone numbers of at most ``most_digits`` digits, but for those of four that begin with 1 or 2."""

    def spoken(m: Column) -> Column:
        plain = F.replace(m, F.lit(","), F.lit(""))
        year = (F.length(plain) == 4) & F.left(plain, F.lit(1)).isin("1", "2")
        return F.when((F.length(plain) <= most_digits) & ~year, int_words(digits_to_long(m)))

    return substitute(text, NUMBER, spoken)


def number_words_sql(text: str) -> str:
    """SQL of :func:`number_words`. RE2 cannot look ahead, so a mark is put before each point or colon with a digit behind it: a
    number that ends at a mark gives its last group up, as stepping back would."""
    spoken = lambda x: f"CASE WHEN length(replace({x}, ',', '')) <= 4 AND NOT (length(replace({x}, ',', '')) = 4 AND replace({x}, ',', '')[1] IN ('1', '2')) THEN list_transform([CAST(replace({x}, ',', '') AS BIGINT)], lambda n: {int_words_sql('n')})[1] ELSE {x} END"
    head = "regexp_replace(m, ',[0-9]{3}' || chr(1) || '$', '')"
    new = f"CASE WHEN NOT suffix(m, chr(1)) THEN {spoken('m')} WHEN contains(m, ',') THEN list_transform([{head}], lambda h: ({spoken('h')}) || substr(m, length(h) + 1))[1] ELSE m END"
    marked = f"regexp_replace({text}, '([.:][0-9])', chr(1) || '\\1', 'g')"
    return f"replace({substitute_sql(marked, NUMBER.removesuffix('(?![.:]?[0-9])') + chr(1) + '?', new)}, chr(1), '')"


#: The second pipeline's steps, in order; numbers are off by default.
STEPS_V2 = (("currency", currency_words), ("percent", percent_words), ("punctuation", simple_punctuation), ("abbreviations", abbreviation_words), ("ordinals", ordinal_words))


def spaced_abbreviations(text: Column) -> Column:
    """``I E P`` to ``IEP``: the known ones, then any three or more single capitals."""
    return substitute(replaced(text, SPACED), r"\b(?:[A-Z] ){2,}[A-Z]\b", lambda m: F.replace(m, F.lit(" "), F.lit("")))


def spaced_abbreviations_sql(text: str) -> str:
    return substitute_sql(replaced_sql(text, SPACED), r"\b(?:[A-Z] ){2,}[A-Z]\b", "replace(m, ' ', '')")


#: Mojibake and what it stood for, the longer first.
MOJIBAKE = (("â€œ", '"'), ("â€™", "'"), ("â€˜", "'"), ('â€"', "—"), ("â€", '"'))
_LETTERS = rf"\b[a-zA-Z]\b(?:{WS}+\b[a-zA-Z]\b)"


def ocr_cleaned(text: Column) -> Column:
    """Mojibake, letters alone on a line and runs of three or more of them away; white space collapsed, spaced words joined."""
    text = F.regexp_replace(replaced(text, MOJIBAKE), rf"(?md)^{WS}*[a-zA-Z]{WS}*$", "")
    text = F.regexp_replace(text, _LETTERS + "{2,}", "")
    for pattern, new in ((" +", " "), ("\n\n+", "\n\n"), ("([.!?])([A-Z])", "$1 $2")):
        text = F.regexp_replace(text, pattern, new)
    joined = substitute(text, _LETTERS + "+", lambda m: F.replace(m, F.lit(" "), F.lit("")))
    return F.regexp_replace(joined, rf"\A{WS}+|{WS}+\z", "")


@F.pandas_udf(StringType())
def _ascii_letters(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def plain(c: str) -> str:
        if c < "\x80":
            return c
        return (unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() or c) if unicodedata.category(c)[0] in "LN" else ""

    for part in parts:
        yield part.map(lambda t: t if t is None or t.isascii() else "".join(map(plain, t)))


def ascii_clean(text: Column) -> Column:
    """Plain forms of marks and ligatures, white space and control characters cleaned, letters without their accents; other
    characters beyond ASCII go. Encodings are not repaired first."""
    text = replaced(text, ASCII_FORMS)
    for pattern, new in ((r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")):
        text = F.regexp_replace(text, pattern, new)
    return F.when(text.rlike(r"\S"), F.regexp_replace(_ascii_letters(text), rf"\A{WS}+|{WS}+\z", "")).otherwise("")


#: Quotes that the speech sanitizer makes straight.
STRAIGHT = (("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("‹", "'"), ("›", "'"))


def speech_sanitized(text: Column, lexicon: dict[str, str] | None = None) -> Column:
    """Words of the lexicon as it says (the longest first), no footnote marks, straight quotes, single spaces, no brace or
    bracket at the end, no space between a point and a quote, and no last quote where quotes are odd."""
    for word in sorted(lexicon or {}, key=len, reverse=True):
        text = F.regexp_replace(text, rf"(?i)\b\Q{word}\E\b", lexicon[word].replace("\\", "\\\\").replace("$", r"\$"))
    for pattern in (r"(?i)\[FOOTNOTE\]", r"\[[0-9]+\]"):
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(replaced(normal_form(text, "NFKC"), STRAIGHT), WS + "+", " ")
    for pattern, new in ((r" +\} *\z", "."), (r" +\] *\z", "."), (r'\. +"', '." ')):
        text = F.regexp_replace(text, pattern, new)
    bare = F.rtrim(text)
    odd = (F.regexp_count(text, F.lit('"')) % 2 == 1) & F.endswith(bare, F.lit('"'))
    return F.trim(F.when(odd, F.rtrim(F.left(bare, F.length(bare) - 1))).otherwise(text))


#: Characters that the universal normalizer replaces, and those that it drops.
UNIVERSAL = (
    ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("‚", ","), ("„", '"'), ("—", "--"), ("–", "-"), ("−", "-"),
    ("\u200b", ""), ("\u200c", ""), ("\u200d", ""), ("\ufeff", ""), ("\u00ad", ""), ("…", "..."),
)
_WIDE_SPACES = "[\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000]"


def universal_normalized(text: Column, composed: bool = False) -> Column:
    """NFC (unless ``composed`` already), plain marks, single spaces, no lines that extraction left, and common misreadings."""
    text = replaced(text if composed else normal_form(text, "NFC"), UNIVERSAL)
    text = F.regexp_replace(F.replace(text, F.lit("\t"), F.lit(" ")), _WIDE_SPACES, " ")
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(F.regexp_replace(x, " +", " "), rf"\A{WS}+|{WS}+\z", ""))
    lines = F.split(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), "\n", -1)
    kept = F.filter(lines, lambda x: ~(x.rlike(r"\APage [0-9]+\z") | x.rlike(r"\A[0-9]{1,3}\z") | F.contains(F.lower(x), F.lit("oceanofpdf")) | F.contains(F.lower(x), F.lit("generated by"))))
    text = F.array_join(kept, "\n")
    for pattern, new in (("([.!?])([A-Z])", "$1 $2"), (",([A-Za-z])", ", $1"), (r"(?<![A-Za-z0-9_])1([a-z])", "l$1"), (r"(?<![A-Za-z0-9_])0([a-z])", "O$1")):
        text = F.regexp_replace(text, pattern, new)
    return text


def universal_normalized_sql(text: str) -> str:
    text = replaced_sql(f"nfc_normalize({text})", UNIVERSAL)
    text = f"regexp_replace(replace({text}, chr(9), ' '), '{_WIDE_SPACES}', ' ', 'g')"
    lines = f"list_transform(string_split({text}, chr(10)), lambda x: regexp_replace(regexp_replace(x, ' +', ' ', 'g'), '\\A{WS}+|{WS}+\\z', '', 'g'))"
    lines = f"string_split(regexp_replace(array_to_string({lines}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10))"
    text = f"array_to_string(list_filter({lines}, lambda x: NOT (regexp_matches(x, '\\APage [0-9]+\\z') OR regexp_matches(x, '\\A[0-9]{{1,3}}\\z') OR contains(lower(x), 'oceanofpdf') OR contains(lower(x), 'generated by'))), chr(10))"
    for pattern, new in (("([.!?])([A-Z])", r"\1 \2"), (",([A-Za-z])", r", \1"), (r"\b1([a-z])", r"l\1"), (r"\b0([a-z])", r"O\1")):
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


def validator_punctuation(text: Column) -> Column:
    """Dashes to commas, semicolons and ellipses to points, runs of marks to the last one, straight quotes, single spaces."""
    text = F.regexp_replace(F.regexp_replace(text, rf"{WS}*[—–]{WS}*", ", "), rf"{WS}*--{WS}*", ", ")
    text = F.replace(F.regexp_replace(F.replace(text, F.lit(";"), F.lit(".")), r"\.{2,}", "."), F.lit("…"), F.lit("."))
    return F.trim(F.regexp_replace(replaced(F.regexp_replace(text, "[!?]+([!?])", "$1"), STRAIGHT[:4]), WS + "+", " "))


def junk_line(line: Column) -> Column:
    """Lines of digits, rules or page marks."""
    return line.rlike(r"^[0-9]+$") | line.rlike(r"^[-=_]{3,}$") | line.rlike(rf"(?i)^page{WS}+[0-9]+({WS}+of{WS}+[0-9]+)?$")


def without_junk_lines(text: Column) -> Column:
    """(text, junk, stripped): junk lines dropped, page numbers before a capital stripped, and how many of each."""

    def judged(x: Column) -> Column:
        bare = F.regexp_replace(x, rf"\A{WS}+|{WS}+\z", "")
        numbered = bare.rlike(rf"^[0-9]{{1,4}}{WS}+[A-Z]")
        line = F.when(bare == "", "").when(numbered, F.regexp_replace(bare, rf"^[0-9]{{1,4}}{WS}+", "")).otherwise(x)
        return F.struct(line.alias("line"), junk_line(bare).alias("junk"), (numbered & ~junk_line(bare)).alias("numbered"))

    def summed(lines: Column) -> Column:
        kept = F.filter(lines, lambda x: ~x["junk"])
        count = lambda k: F.size(F.filter(lines, lambda x: x[k])).cast("long")
        return F.struct(F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("text"), count("junk").alias("junk"), count("numbered").alias("stripped"))

    return bound(F.transform(F.split(text, "\n", -1), judged), summed)


def deduped_paragraphs(text: Column, least: int = 20) -> Column:
    """Paragraphs without those of ``least`` characters or more that equal the one before."""

    def kept(items: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), F.slice(items, F.lit(1), F.size(items) - 1))
        pairs = F.filter(F.arrays_zip(items.alias("x"), before.alias("y")), lambda p: (F.length(p["x"]) < least) | ~p["x"].eqNullSafe(p["y"]))
        return F.array_join(F.transform(pairs, lambda p: p["x"]), "\n\n")

    return bound(F.split(text, "\n\n", -1), kept)


#: The second validator's years, ordinals, currencies, percentages and cardinals.
YEAR, ANY_ORDINAL, AMOUNT, SHARE, CARDINAL = r"\b(?:1[89][0-9]{2}|20[0-9]{2})\b", r"\b[0-9]+(?:st|nd|rd|th)\b", rf"[$€£¥]{WS}*[0-9,]*[0-9][0-9,]*(?:\.[0-9]+)?{WS}*[MBKmbk]?", PERCENT, r"\b[0-9]{1,3}(?:,[0-9]{3})*\b"
AMOUNTS = (("$", "dollars"), ("£", "pounds"), ("€", "euros"), ("¥", "yen"))


def year_words(n: Column) -> Column:
    """``nineteen ninety-five``, ``nineteen oh-five``, ``nineteen hundred``, ``two thousand and five``."""
    high, low = F.call_function("div", n, F.lit(100)), n % 100
    low_words = F.when(low == 0, "hundred").when(low < 10, F.concat(F.lit("oh-"), int_words(low))).otherwise(int_words(low))
    return F.when((high % 10 == 0) & (low < 10), int_words(n, british=True)).otherwise(F.concat(int_words(high), F.lit(" "), low_words))


def _decimal_words(number: Column) -> Column:
    """A number with a point, digit by digit behind it; zeros at the end and a bare point are not read."""
    plain = F.regexp_replace(F.regexp_replace(F.replace(number, F.lit(","), F.lit("")), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    part = F.regexp_extract(plain, r"\.([0-9]+)", 1)
    digits = F.array_join(F.transform(F.filter(F.split(part, ""), lambda d: d != ""), lambda d: int_words(d.cast("long"))), " ")
    whole = int_words(digits_to_long(F.regexp_extract(plain, "^([0-9]+)", 1)), british=True)
    return F.when(part == "", whole).otherwise(F.concat(whole, F.lit(" point "), digits))


def all_number_words(text: Column) -> Column:
    """Years from 1800 to 2099, ordinals, amounts of money, percentages, and what numbers are left, in words."""
    names = F.create_map(*(F.lit(x) for p in AMOUNTS for x in p))
    text = substitute(text, YEAR, lambda m: year_words(m.cast("long")))
    text = substitute(text, ANY_ORDINAL, lambda m: ordinal(int_words(digits_to_long(F.regexp_extract(m, "^([0-9]+)", 1)), british=True)))

    def money(m: Column) -> Column:
        scale = {"K": 3, "M": 6, "B": 9}
        letter = F.upper(F.regexp_extract(m, "([MBKmbk])$", 1))
        number = F.replace(F.regexp_extract(m, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit(","), F.lit("")).cast("decimal(30,6)")
        value = number
        for k, e in scale.items():
            value = F.when(letter == k, (number * F.lit(10**e)).cast("decimal(38,6)")).otherwise(value)

        def spoken(v: Column) -> Column:
            part = lambda e: _decimal_words((v / F.lit(10**e)).cast("decimal(30,6)").cast("string"))
            amount = F.when(v >= 10**9, F.concat(part(9), F.lit(" billion "))).when(v >= 10**6, F.concat(part(6), F.lit(" million "))).otherwise(F.concat(int_words(F.floor(v).cast("long"), british=True), F.lit(" ")))
            return F.concat(amount, names[F.left(m, F.lit(1))])

        return bound(value, spoken)

    text = substitute(text, AMOUNT, money)
    text = substitute(text, SHARE, lambda m: F.concat(_decimal_words(F.regexp_extract(m, r"^([0-9]+(?:\.[0-9]+)?)", 1)), F.lit(" percent")))
    return substitute(text, CARDINAL, lambda m: int_words(digits_to_long(m), british=True))
