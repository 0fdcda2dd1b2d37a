"""Byte-level BPE by a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm.common import table

#: Entries of the worker's memo of encoded pieces; it starts anew when full. Pieces longer than MEMO_CHARS stay out of it.
MEMO, MEMO_CHARS = 800_000, 32
#: Unicode white space (the property White_Space), what ``\\s`` means to the tokenizer.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class ByteBPE:
    """Ranks of a vocabulary file, as encoder and decoder. Two parts merge if their concatenation has a rank; the least
    rank merges first, from left to right."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.token = [b""] * (max(self.ranks.values(), default=0) + 1)
        for b, r in self.ranks.items():
            self.token[r] = b
        pattern = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.cut = regex.compile(pattern).findall
        #: A space is a safe place to cut before unless white space or the end follows it.
        self.unsafe = re.compile(f" (?=[{SPACE}]|$(?!\\n))").search
        #: Ids of pieces behind a space, without that space, and of pre-tokens.
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token.

        The parts form a linked list by their beginnings. The queue holds, for each rank that some pair has, the
        beginnings of such pairs; a two-level bitmap (``top`` over blocks of 256 ranks, ``leaf`` within a block) gives the
        least rank by find-first-set. An entry is stale if its pair has another rank by now; it is skipped when taken.
        """
        get = self.ranks.get
        whole = get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        end = list(range(1, n + 1))  # end of the part that begins here
        prev = list(range(-1, n))  # beginning of the part before
        pair = [-1] * n  # rank of the part here joined with the next; -1: none, or no part begins here
        top, leaf, bucket = 0, {}, {}
        for i in range(n - 1):
            r = get(word[i : i + 2])
            if r is not None:
                pair[i] = r
                if r in bucket:
                    bucket[r].append(i)
                else:
                    bucket[r] = [i]
                    m = r >> 8
                    leaf[m] = leaf.get(m, 0) | 1 << (r & 255)
                    top |= 1 << m
        while top:
            m = (top & -top).bit_length() - 1
            v = leaf[m]
            low = v & -v
            rank = m << 8 | low.bit_length() - 1
            v ^= low
            leaf[m] = v
            if not v:
                top ^= 1 << m
            at = bucket.pop(rank)
            if len(at) > 1:
                at.sort()  # equal pairs merge from left to right
            for i in at:
                if pair[i] != rank:
                    continue
                j = end[i]
                e = end[j]
                end[i] = e
                pair[j] = -1
                todo = ()
                if e < n:
                    prev[e] = i
                    r = get(word[i : end[e]])
                    if r is None:
                        pair[i] = -1
                    else:
                        pair[i] = r
                        todo = ((r, i),)
                else:
                    pair[i] = -1
                p = prev[i]
                if p >= 0:
                    r = get(word[p:e])
                    if r is None:
                        pair[p] = -1
                    else:
                        pair[p] = r
                        todo = (*todo, (r, p))
                for r, x in todo:
                    if r in bucket:
                        bucket[r].append(x)
                    else:
                        bucket[r] = [x]
                        m = r >> 8
                        leaf[m] = leaf.get(m, 0) | 1 << (r & 255)
                        top |= 1 << m
        ranks, out, i = self.ranks, [], 0
        while i < n:
            e = end[i]
            out.append(ranks[word[i:e]])
            i = e
        return out

    def piece(self, text: str) -> bytes:
        """Ids of any text as little-endian 32-bit integers, pre-token by pre-token."""
        words, out = self.words, []
        for word in self.cut(text):
            got = words.get(word)
            if got is None:
                got = array("I", self.merge(word.encode("utf-8", "replace"))).tobytes()
                if len(word) <= MEMO_CHARS:
                    if len(words) >= MEMO:
                        words.clear()
                    words[word] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text. It is cut before single spaces first, where every pre-token ends; equal pieces are encoded once."""
        if self.unsafe(text):
            return self.piece(text)
        first, *parts = text.split(" ")
        memo = self.memo
        out = list(map(memo.get, parts))
        if None in out:
            for k, x in enumerate(out):
                if x is None:
                    p = parts[k]
                    got = memo.get(p)
                    if got is None:
                        got = self.piece(" " + p)
                        if len(p) <= MEMO_CHARS:
                            if len(memo) >= MEMO:
                                memo.clear()
                            memo[p] = got
                    out[k] = got
        return self.piece(first) + b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, array("I", ids)))


_loaded: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    """The coder of a file, once a Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(path, pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ``ids``) of every row; a null text counts as empty.

    Each match of ``pattern`` is encoded separately, without special tokens; decoding starts from the ids. Rows are taken
    alone: repeated ones give equal results. Other columns are not read. ``path`` is a file that every worker can open. A
    very long pre-token goes through the rank queue in time near linear in its length. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b in batches:
            n, ids_sha, back_sha, kept = [], [], [], []
            for text in b.column("text"):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                back_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(array("I", ids))
            cols = {"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(back_sha, pa.string())}
            if with_ids:
                cols["ids"] = pa.array(kept, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
