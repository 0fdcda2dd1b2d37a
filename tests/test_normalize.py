"""Normalizers of text for speech: literal cases, and Python's own functions where SQL cannot say the rule."""

import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from scriptorium import catalog
from scriptorium.functions import numbers, spoken

DATA = "/root/testdata/sf0.001"


def check(spark, f, cases):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = [r.u for r in df.select("i", f(F.col("t")).alias("u")).orderBy("i").collect()]
    assert got == list(cases.values())


def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def digests(spark, name):
    return {r["doc_id"]: r["digest"] for r in catalog.queries()[name](spark, DATA).collect()}


def hashed(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_numbers(spark):
    cases = {"342": ("three hundred forty-two", "three hundred and forty-two"), "1001": ("one thousand one", "one thousand and one"), "-5": ("negative five", "negative five"), "1234567": ("one million two hundred thirty-four thousand five hundred sixty-seven", "one million, two hundred and thirty-four thousand, five hundred and sixty-seven")}
    df = spark.createDataFrame([(int(k),) for k in cases], "n bigint").select(numbers.int_words(F.col("n")).alias("a"), numbers.int_words(F.col("n"), british=True).alias("b"))
    assert [(r.a, r.b) for r in df.collect()] == list(cases.values())


def test_literal_cases(spark):
    check(spark, spoken.currency_words, {"$100": "one hundred dollars", "€50.99!": "fifty euros and ninety-nine cents!", "$1,000,000": "one million dollars", "£2.5": "two pounds and fifty pence", "¥3.07": "three point seven yen", "$5.00": "five dollars", "": "", "no": "no"})
    check(spark, spoken.percent_words, {"25%": "twenty-five percent", "3.14 %": "three point one four percent", "25.0%": "twenty-five percent"})
    check(spark, spoken.simple_punctuation, {"Wait—what?? Well... ok": "Wait, what? Well, ok", "No... Yes…": "No. Yes.", "what?!?!": "what?!"})
    check(spark, spoken.abbreviation_words, {"Dr. Mr. X begin. in. vs U.S.A.": "Doctor Mister X begin. inches versus USA", "St. Paul at Main St. here": "Saint Paul at Main Street here", "see e.g. it": "see for example it"})
    check(spark, lambda t: spoken.abbreviation_words(t, boundary=False), {"begin. x": "beginches x"})
    check(spark, spoken.ordinal_words, {"1st 21ST 24th 31st": "first twenty-first 24th thirty-first"})
    check(spark, spoken.number_words, {"100 in 2024, 12:30 and 1,234.5": "one hundred in 2024, 12:thirty and one,234.five"})
    check(spark, spoken.heading_numbers, {"chapter 3 of\n12 Men\n1000 Men": "chapter Third of\nTwelve Men\n1000 Men", "Book 21": "Book Twenty-First"})
    check(spark, spoken.spaced_abbreviations, {"the I E P and A B C D or A B": "the IEP and ABCD or A B"})
    check(spark, spoken.universal_normalized, {"1ike 0f it.The\n  a\tb  \nPage 12\n17\n2024\nfrom OceanofPDF x": "like Of it. The\na b\n2024", "café—x": "café--x"})
    check(spark, spoken.ascii_clean, {"café “x” ← 中\x07": 'cafe "x"  中', " \n": "", "ﬁn": "fin"})
    check(spark, lambda t: spoken.speech_sanitized(t, {"SQL": "sequel"}), {'He said sql. "x [1] [FOOTNOTE]': 'He said sequel." x', 'end }': "end.", '"a" b"': '"a" b'})
    check(spark, spoken.ocr_cleaned, {"one\nq\ntwo A B C three T h": "one\n\ntwo three Th", "Itâ€™s.Ok": "It's. Ok"})
    check(spark, spoken.all_number_words, {"1995 1905 1900 2005 2015": "nineteen ninety-five nineteen oh-five nineteen hundred two thousand and five twenty fifteen", "$2.5M and 3rd, 12.5% of 1,234": "two point five million dollars and third, twelve point five percent of one thousand, two hundred and thirty-four"})
    check(spark, spoken.validator_punctuation, {"a -- b; c.. d!?": "a, b. c. d?"})
    df = spark.createDataFrame([("a [1]one two[2] three\n",), ("x [1] y\nz",)], "t string").select(spoken.footnotes(F.col("t")).alias("f"), spoken.without_footnotes(F.col("t")).alias("u"))
    assert [([tuple(x) for x in r.f], r.u) for r in df.collect()] == [([("1", "one two"), ("2", "three")], "a [FOOTNOTE][FOOTNOTE]\n"), ([], "x [1] y\nz")]


def fold(t):
    t = unicodedata.normalize("NFKC", t)
    for a, b in spoken.FOLDED:
        t = t.replace(a, b)
    return t


def spoken_v1(t):
    t = re.sub(r"\n{3,}", "\n\n", re.sub(" +", " ", t.replace("\t", " ")))
    t = fold("\n".join(x.rstrip(" ") for x in t.split("\n")))
    for p in (r"OceanofPDF\.com", r"Downloaded from.*\.com", r"Visit us at.*\.com"):
        t = re.sub(p, "", t, flags=re.IGNORECASE)
    return re.sub(r"([.,!?;:])([^ \t\n\r\f])", r"\1 \2", re.sub(r"[ \t\n\r\f]+([.,!?;:])", r"\1", t))


def test_documents_match_python(spark):
    docs = documents(spark)
    assert digests(spark, "text_unicode_fold") == {i: hashed(fold(t)) for i, t in docs.items()}
    assert digests(spark, "text_spoken") == {i: hashed(spoken_v1(t)) for i, t in docs.items()}

    def number(m):
        plain = m[0].replace(",", "")
        return m[0] if len(plain) > 4 or len(plain) == 4 and plain[0] in "12" else words[int(plain)]

    words = {r.id: r.w for r in spark.range(10_000).select("id", numbers.int_words(F.col("id")).alias("w")).collect()}
    assert digests(spark, "text_number_words") == {i: hashed(re.sub(spoken.NUMBER, number, t, flags=re.ASCII)) for i, t in docs.items()}

    def normalized(t):
        lines = []
        for line in t.split("\n"):
            bare = line.strip(" \t\n\x0b\f\r")
            if re.search(r"^[0-9]+$|^[-=_]{3,}$|^(?i:page)\s+[0-9]+(\s+(?i:of)\s+[0-9]+)?$", bare):
                continue
            lines.append("" if not bare else re.sub(r"^[0-9]{1,4}\s+(?=[A-Z])", "", bare) if re.search(r"^[0-9]{1,4}\s+[A-Z]", bare) else line)
        parts = spoken_v1("\n".join(lines)).split("\n\n")
        return "\n\n".join(p for k, p in enumerate(parts) if not (k and len(p) >= 20 and p == parts[k - 1]))

    assert digests(spark, "text_normalized") == {i: hashed(normalized(t)) for i, t in docs.items()}


def test_reflow(spark):
    from scriptorium.plans.reflow import reflowed

    check(spark, reflowed, {"The line is\nwrapped here.\nNext one\nbegins.\n\nend": "The line is wrapped here.\nNext one\nbegins.\nend", "one long line\n  indented next": "one long line\nindented next", "ends here.\nand goes on": "ends here. and goes on", "": "", "\n \n": ""})
