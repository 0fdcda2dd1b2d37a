"""Token counts by a broadcast table of frequent pre-tokens and workers' caches for the rest."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import table

#: Pre-tokens of the broadcast table, and the longest that it or a worker's cache holds: at most 8 MB in all.
FREQUENT, LONGEST = 65_536, 32
#: Texts from which they are chosen, and the longest of these, in characters. They change the speed, not a count.
SAMPLE, SAMPLE_CHARS = 1_000, 32_768
#: Entries of a worker's cache; it starts anew when full.
CACHE = 300_000
#: Fixed value: the pre-tokens of byte-level vocabularies of this kind. It is applied to Latin pieces alone, where every
#: version of Unicode agrees; others go to the library whole.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = "\u024f"
#: White space of any kind that a tokenizer may know, so that a space before it is not a place to cut.
SPACE = "\\t-\\r \\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff"


class TokenCounter:
    """Numbers of tokens as the tokenizer file's library gives them, without begin, end or added special tokens."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None) -> None:
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        pre = read.get("pre_tokenizer") or {}
        #: Only byte-level words that take the space before them can be counted apart.
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not read.get("normalizer")
        self.special = [t["content"] for t in read.get("added_tokens") or []]
        self.frequent = frequent or {}
        #: What follows a space, without it, and pre-tokens that don't.
        self.cache: dict[str, int] = {}
        self.bare: dict[str, int] = {}
        self.words = regex.compile(PATTERN).findall
        self.unsafe = re.compile(f" (?=[{SPACE}]|\\Z)").search
        self.cut = re.compile(f" (?=[^{SPACE}])").split

    def encoded(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def pieces(self, text: str) -> list[str]:
        """A text cut at each space before a character other than white space: there every tokenization has an edge. All
        pieces but the first have lost that space."""
        return self.cut(text) if self.unsafe(text) else text.split(" ")

    def cached(self, cache: dict[str, int], word: str, space: str) -> int:
        n = cache.get(word)
        if n is None:
            n = self.encoded(space + word)
            if len(word) <= LONGEST:
                if len(cache) >= CACHE:
                    cache.clear()
                cache[word] = n
        return n

    def miss(self, piece: str) -> int:
        """A piece behind a space that the broadcast table lacks: its pre-tokens are looked up one by one."""
        n = self.cache.get(piece)
        if n is None:
            head, *tail = self.words(" " + piece) if max(piece) <= LATIN else [" " + piece]
            head = head[1:]
            n = self.frequent.get(head)
            if n is None:
                n = self.cached(self.cache, head, " ")
            n += sum(self.cached(self.bare, w, "") for w in tail)
            if tail and len(piece) <= LONGEST:
                self.cache[piece] = n
        return n

    def count(self, text: str) -> int:
        if not self.cuts or any(s in text for s in self.special):
            return self.encoded(text)
        first, *rest = self.pieces(text)
        found = list(map(self.frequent.get, rest))
        if None not in found:
            return sum(found) + self.encoded(first)
        return sum(n if n is not None else self.miss(p) for n, p in zip(found, rest, strict=True)) + self.encoded(first)


_loaded: dict[str, TokenCounter] = {}


def counter(path: str, frequent: dict[str, int] | None = None) -> TokenCounter:
    """The counter of a file, once a Python worker; its table is the latest one."""
    if path not in _loaded:
        _loaded[path] = TokenCounter(path)
    if frequent is not None:
        _loaded[path].frequent = frequent
    return _loaded[path]


def frequent_lengths(docs: DataFrame, path: str, size: int = FREQUENT) -> dict[str, int]:
    """Numbers of tokens of the sample's most frequent pre-tokens that follow a space, without that space.

    The sample is read from the table's first files until it has SAMPLE texts of up to SAMPLE_CHARS characters; it and its
    ``size`` pre-tokens are what the driver holds.
    """
    tokens, seen = counter(path), Counter()
    if not tokens.cuts:
        return {}
    for (text,) in docs.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select("text").limit(SAMPLE).collect():
        seen.update(text[i + 1 : j] for _, (i, j) in tokens.library.pre_tokenizer.pre_tokenize_str(text) if text[i] == " " and 1 < j - i <= LONGEST)
    top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:size]
    return {w: tokens.encoded(" " + w) for w, _ in top if w.strip() and not any(s in w for s in tokens.special)}


def token_counts(docs: DataFrame, path: str, limit: int, size: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; a null text counts as empty.

    Whole texts are counted in the scan's own tasks, nothing is shuffled: a text is cut at spaces that every tokenization
    cuts at, a piece is looked up in the broadcast table of frequent pre-tokens, then in the worker's cache, and else encoded
    by the library. A text that holds a special token's string is encoded by the library as a whole, as the token has its own
    rules there. Rows are taken alone: repeated ones give equal results. Other columns are not read. A text or piece of any
    length is taken whole. An empty table gives an empty result. ``path`` is a file that every worker can open.
    """
    table_ = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, size))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path, table_.value)
        for b in batches:
            n = pa.array([tokens.count(t.as_py() or "") for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"))
    return sized.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)
