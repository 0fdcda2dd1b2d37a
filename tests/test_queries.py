"""Each registered query with SQL against that SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from scriptorium import catalog

DATA = "/root/testdata/sf0.001"


def rows(df):
    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        return x if x is None or isinstance(x, (bool, int, str)) else str(x)

    df = df[sorted(df.columns)]
    return sorted(repr([plain(x) for x in r]) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    assert rows(catalog.queries()[name](spark, DATA).toPandas()) == rows(con.execute(catalog.oracle_sql()[name]).fetchdf())


def test_literal_cases(spark):
    from pyspark.sql import functions as F

    from scriptorium.functions.text import normalize_spaces, punctuation_spacing

    df = spark.createDataFrame([("x...a", "a\t\tb  \n\n\n\nc"), ("Hi ,there", "")], "p string, s string")
    got = df.select(punctuation_spacing(F.col("p")), normalize_spaces(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("x. .. a", "a b\n\nc"), ("Hi, there", "")]


def test_abbreviations_match_python(spark):
    import hashlib
    import re

    from scriptorium.plans.sentences import ABBREVIATIONS

    def spelled(t):
        for p, new in ABBREVIATIONS:
            t = re.sub(p, new, t, flags=re.IGNORECASE)
        return hashlib.sha256(t.encode()).hexdigest()

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["digest"] for r in catalog.queries()["text_abbreviations"](spark, DATA).collect()}
    assert got == {r["doc_id"]: spelled(r["text"]) for r in docs}


def written(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def as_its_sql(spark, name, sf, table):
    """The query's rows on a folder's one table, which are those of its SQL."""
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{sf}/{table}.parquet/*.parquet'")
    got = catalog.queries()[name](spark, sf).toPandas()
    assert rows(got) == rows(con.execute(catalog.oracle_sql()[name]).fetchdf())
    return got


def test_speech_ready_of_empty_texts(spark, tmp_path):
    """No characters have no share of anything, which must not be an error."""
    got = as_its_sql(spark, "text_speech_ready", written(spark, tmp_path, ["", None, " ", "\n\n\n\n", "é", "plain", "a  é", "OceanofPDF.com"]), "documents")
    assert dict(zip(got["doc_id"], got["text_yield"], strict=True))[0] == 0.0


#: Endings before which letters with accents, rare white space or line ends stand, that regular expressions judge differently.
ENDINGS = ("elleêan", "ciónído do", "ciónído", "êsaid,", "said, \x0b", "the\x0b", "the \x85", "the\u2028", "the \u2028", "the\xa0", "one,\x85", "one;\x0b", "ends İN", "ends \u212a in", "5the", "x_the", "\U0001d400a", "the", "he said,", "")


def test_report_completeness_of_odd_endings(spark, tmp_path):
    got = as_its_sql(spark, "report_completeness", written(spark, tmp_path, [None, *ENDINGS, *(f'Some "quoted" words é {x}' for x in ENDINGS)]), "documents")
    assert dict(zip(got["doc_id"], got["reason"], strict=True))[1] == "article"


def test_text_completeness_of_odd_endings(spark, tmp_path):
    """And the chunker's rule is still the column's."""
    from scriptorium.operators import chunker

    texts = [*ENDINGS, *(f'Some "quoted" words é {x}' for x in ENDINGS), *(f"one two three {x} and so on" for x in ("éwhich ran", "which éran", "which İs", "which\x0bran", "which ran", "who\xa0ran"))]
    got = as_its_sql(spark, "text_completeness", written(spark, tmp_path, [None, *texts]), "documents")
    reasons = dict(zip(got["doc_id"], got["reason"], strict=True))
    assert reasons[1] == "article" and [reasons[i + 1] == "complete" for i in range(len(texts))] == [chunker.is_complete(t) for t in texts]


def test_container_texts_of_odd_pages(spark, tmp_path):
    """References that are cut or unknown stay; tags, scripts and comments without an end, and white space and control characters that archives must keep."""
    pages = ["", "plain", "<body>x &amp</body>", "<body>&amp;amp; &quot &eacute; &#39;&nbsp;</body>", "a < b > c", "a < b", '<p title="a>b">x</p>', "<script>x", "<script>x</script >y</style>z", "<scripty>x</scripty>", "<\u017fcript>x</script>y", "<scr\u0131pt>x</script>y"]
    pages += ["<body>1<BODY class=x>2<body", "<!-- a > b -->c<!-- d > e", "<!-->x-->y", "a<?b?>c</>d<!e>f", "<p>\u3000x\u3000</p>", "<p>\r\nx\ry</p>", "<p>\x00\x01x\x1by\uffff</p>", "<p> </p><p>\n</p><p>t</p><p>u", "<p>_x000D_ _x005F_x</p>", "<p>_x000D\x01 __x\x0b_</p>", "<" * 99 + ">", "<!--" * 99 + "-->" + "<!--"]
    rows_of = [(60 * i + k, x) for i, x in enumerate(pages) for k in (1, 3, 10)] + [(None, "x"), (2, None), (2, "twice"), (2, "twice")]
    spark.createDataFrame(rows_of, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = as_its_sql(spark, "container_texts", str(tmp_path), "pages")
    assert set(got["error"].dropna()) == {"BadZipFile"}


def test_text_repetition_matches_the_rule(spark, tmp_path):
    """The reference's rule in Python, on the table's texts and on texts that repeat sentences but no words."""
    import hashlib
    import re

    def rule(t):
        found = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", t.strip())]
        found = [s for s in found if len(s) >= 20]
        keys = [re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", s.lower())).strip() for s in found]
        kept = [s for i, s in enumerate(found) if keys[i] not in keys[:i]]
        if len(found) > len(kept):
            return "sentence_duplication", len(found), len(found) - len(kept), round(1 - len(kept) / len(found), 6), 0, hashlib.sha256(" ".join(kept).encode()).hexdigest()
        w, run, best = t.lower().split(), 0, 0
        for i in range(1, len(w)):
            run = run + 1 if w[i] == w[i - 1] and len(w[i]) > 2 else 0
            best = max(best, run)
        word = len(found) >= 2 and best >= 2
        return "word_repetition" if word else None, len(found), 0, 0.0, best + 1 if word else 0, None

    a, b = "The first sentence is here.", "Another one follows it now!"
    texts = ["", None, "short", a, f"{a} {b}", f"{a} {b} The first,  SENTENCE is here?", f"{a}\xa0{a}", f" {a} {b} then then then", f"{a} then then then", f"{a} Yes. Yes. {b}", f"{a} it is is is {b} {b}"]
    texts += [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    got = {r[0]: tuple(r)[1:] for r in catalog.queries()["text_repetition"](spark, written(spark, tmp_path, texts)).collect()}
    want = {i: rule(t or "") for i, t in enumerate(texts)}
    assert [i for i in want if want[i] != got[i]] == [] and {w[0] for w in want.values()} == {None, "sentence_duplication", "word_repetition"}
    assert "G6" in catalog.coverage() and catalog.coverage()["G6"] == ["text_repetition"]


def test_balanced_chunks_match_the_rule(spark, tmp_path):
    """Quotations over chunk edges, by the query, its SQL and the reference's two loops in Python."""
    import hashlib
    import random

    r = random.Random(3)
    texts = [" ".join(r.choice(['"', "", "", ""]) + "Word " * r.randint(3, 60) + r.choice(['end."', "end.", "end!"]) for _ in range(r.randint(1, 14))) for _ in range(60)]

    def rule(t):
        import re

        chunks, now = [], []
        for x in filter(None, (x.strip() for x in re.split(r"(?<=[.!?])\s+", t))):
            both = " ".join([*now, x])
            if len(both) <= 450 or len(both) <= 500 and not re.search(r"[.!?\"']\s*$", both):
                now.append(x)
                continue
            chunks += [" ".join(now)] if now else []
            now = [x]
        chunks, out, i = chunks + [" ".join(now)], [], 0
        while i < len(chunks):
            two = chunks[i].count('"') % 2 != 0 and i + 1 < len(chunks)
            out.append(f"{chunks[i]} {chunks[i + 1]}" if two else chunks[i])
            i += 1 + two
        return len(out), max(map(len, out)), hashlib.sha256("\n".join(out).encode()).hexdigest(), len(out) < len(chunks)

    sf = written(spark, tmp_path, texts)
    want = {i: rule(t) for i, t in enumerate(texts)}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet/*.parquet'")
    for got in (catalog.queries()["balanced_chunks"](spark, sf).collect(), con.execute(catalog.oracle_sql()["balanced_chunks"]).fetchall()):
        assert {x[0]: tuple(x)[1:] for x in got} == {i: w[:3] for i, w in want.items()}
    assert sum(w[3] for w in want.values()) > 20
    assert catalog.coverage()["D11"] == ["balanced_chunks"]


def test_chunk_metrics_and_file_analysis_match_the_rules(spark, tmp_path):
    import re

    texts = ["", None, "One. Two three!", "7\n\n12 \n a\u2028b\r\nc\n13", "x" * 250 + ". " + "y" * 298 + ". " + "z" * 399 + ". " + "w" * 401 + ".", " \n\n \u00a0\n\nOceanOfPDF.COM é  ü   end.  More"]
    texts += [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    sf = written(spark, tmp_path, texts)

    def analysis(t):
        lines, words = t.splitlines(), t.split()
        mean, odd, empty = lambda a: sum(map(len, a)) / len(a) if a else 0, sum(ord(c) > 127 for c in t), sum(not x.strip() for x in lines)
        return [
            len(t), len(lines), len(words), mean(lines), mean(words), len(re.findall(" {2,}", t)), odd, odd / len(t) * 100 if t else 0, empty, empty / len(lines) * 100 if lines else 0,
            sum(0 < len(x.strip()) < 10 for x in lines), len(re.split(r"[.!?]+\s+", t)), sum(bool(p.strip()) for p in t.split("\n\n")), len(re.findall(r"^\d+$", t, re.MULTILINE)), len(re.findall(r"OceanofPDF\.com", t, re.IGNORECASE)),
        ]

    got = {r[0]: list(r)[1:] for r in catalog.queries()["text_file_analysis"](spark, sf).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(analysis(t or ""), abs=1e-4), i
    r = {r.doc_id: r for r in catalog.queries()["chunk_metrics"](spark, sf).collect()}
    assert tuple(r[4])[8:] == (0, 2, 1, 1)
    assert r[2].n_words == 3 and r[2].soft == 2 and r[2].longest_s == round(10 / 2700 * 60, 4)


def test_run_and_state_rules(spark, tmp_path):
    """Terms and filters that the earlier queries left out, on rows that need each of them."""
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1, 9) + datetime.timedelta(seconds=s)
    rows = [(1, at(0), 1, "view", 200.0, '{"k": 10}'), (2, at(1.239), 1, "view", 200.0, '{"k": 10}'), (3, at(1.24), 1, "view", 700.0, '{"k": 10}'), (4, at(0), 2, "error", 50.0, '{"k": 95}')]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    run = lambda name: [r.asDict() for r in catalog.queries()[name](spark, str(tmp_path)).collect()]
    assert {r["event_id"]: r["karaoke_cs"] for r in run("karaoke_durations")} == {1: 123, 2: 10, 3: 70, 4: 10}
    slow = (1100 / 3 / 50 - 2) * 0.1
    assert {r["user_id"]: r["reward"] for r in run("run_reward")} == pytest.approx({1: 1 - 0.05 - slow, 2: 1 - 1.5 - 0.475 - 0.3}, abs=1e-5)
    orders = [(8, 1, "F"), (5, 1, "P"), (6, 1, "O"), (10, 1, "F"), (3, 1, "F"), (12, 2, "F")]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "Customer#000000001")], "c_custkey bigint, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    assert sorted((r["place"], r["order_id"], r["chunk_id"]) for r in run("audio_chunks")) == [(1, 3, 0), (2, 5, 5), (3, 8, 8), (4, 10, 10)]
    assert {o: catalog.coverage()[o] for o in ("J3", "E5", "D23", "F36", "W19")} == {"J3": ["audio_chunks"], "E5": ["run_reward"], "D23": ["chunk_metrics"], "F36": ["text_file_analysis"], "W19": ["karaoke_durations"]}
