"""Chunks of a text: folds over its pieces as Column functions, and the SQL of each.

A text's pieces are one array in one row; a fold keeps what is finished and what is still open. Only the recursive clause
split and the three-tier chunker, which look ahead, are Python, in Arrow batches (:mod:`scriptorium.operators.chunker`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import quality
from scriptorium.functions.text import bound

#: Limits in characters, and durations in seconds at the pace of characters a minute.
MIN_CHARS, SOFT, HARD, EMERGENCY, PACE, MAX_S, EMERGENCY_S = 50, 250, 300, 400, 2700, 18.0, 24.0
WS = r"[ \t\n\r\f]"


def seconds(text: Column) -> Column:
    return F.length(text) / float(PACE) * 60.0


def seconds_sql(text: str) -> str:
    return f"(length({text}) / CAST({PACE} AS DOUBLE) * 60)"


def _none() -> Column:
    return F.array().cast("array<string>")


def _fold(items: Column, state: Column, step, finish) -> Column:
    return F.aggregate(items, state, step, finish)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WS + "+"), lambda w: w != "")


def _words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WS}+'), lambda w: w <> '')"


def word_split(text: Column, most: int = SOFT, most_s: float = EMERGENCY_S) -> Column:
    """Words packed into pieces whose lengths, each word counted with a space behind it, stay within ``most``, and whose
    durations stay within ``most_s``; a longer word is a piece of its own."""
    state = F.struct(_none().alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(s: Column, w: Column) -> Column:
        longer = F.concat(s["cur"], F.lit(" "), w)
        full = (s["cur"] != "") & ((s["n"] + F.length(w) + 1 > most) | (seconds(longer) > most_s))
        joined = F.when(s["cur"] == "", w).otherwise(longer)
        return F.struct(F.when(full, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]).alias("done"), F.when(full, w).otherwise(joined).alias("cur"), F.when(full, F.length(w) + 1).otherwise(s["n"] + F.length(w) + 1).alias("n"))

    return _fold(words_of(text), state, step, lambda s: F.concat(s["done"], F.filter(F.array(s["cur"]), lambda x: x != "")))


_EMPTY = "{'done': []::VARCHAR[], 'cur': '', 'n': 0}"


def word_split_sql(text: str, most: int = SOFT, most_s: float = EMERGENCY_S) -> str:
    step = f"CASE WHEN s.cur <> '' AND (s.n + length(w) + 1 > {most} OR {seconds_sql(chr(40) + 's.cur || ' + chr(39) + ' ' + chr(39) + ' || w' + chr(41))} > {most_s}) THEN {{'done': list_append(s.done, s.cur), 'cur': w, 'n': CAST(length(w) + 1 AS INT)}} ELSE {{'done': s.done, 'cur': CASE WHEN s.cur = '' THEN w ELSE s.cur || ' ' || w END, 'n': CAST(s.n + length(w) + 1 AS INT)}} END"
    return f"list_transform([list_reduce({_words_sql(text)}, lambda s, w: {step}, {_EMPTY})], lambda s: list_concat(s.done, list_filter([s.cur], lambda x: x <> '')))[1]"


def complete(text: Column) -> Column:
    return bound(text, lambda t: quality.completeness(t) == "complete")


def complete_sql(text: str) -> str:
    """SQL of :func:`complete`."""
    ends = " ".join(f"WHEN regexp_matches(lower(right(t, {quality.ENDING})), '{p}') THEN FALSE" for p, _ in quality.UNFINISHED)
    after = rf"regexp_extract(lower(array_to_string(list_slice(w, greatest(len(w) - 9, 1), len(w)), ' ')), '\b({'|'.join(quality.RELATIVES)})\s+([\p{{L}}\p{{N}}_]+)', 2)"
    clause = f"list_transform([regexp_split_to_array(t, '{WS}+')], lambda w: len(w) >= 5 AND {after} <> '' AND {after} NOT IN {quality.COMPLETING} AND NOT ends_with(t, '.'))[1]"
    return f"list_transform([regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')], lambda t: CASE WHEN t = '' THEN FALSE WHEN (length(t) - length(replace(t, chr(34), ''))) % 2 = 1 THEN FALSE {ends} WHEN {clause} THEN FALSE ELSE TRUE END)[1]"


def merge_short(chunks: Column, least: int = MIN_CHARS, soft: int = SOFT, emergency: int = EMERGENCY) -> Column:
    """Chunks joined by a blank line until they are ``least`` long; longer than ``soft`` only until they are complete; what
    would exceed ``emergency`` starts anew."""
    state = F.struct(_none().alias("done"), F.lit("").alias("cur"))
    pair = lambda done, cur: F.struct(done.alias("done"), cur.alias("cur"))

    def step(s: Column, x: Column) -> Column:
        both = F.when(s["cur"] == "", x).otherwise(F.concat(s["cur"], F.lit("\n\n"), x))

        def judged(c: Column) -> Column:
            whole = (F.length(c) >= least) & ((F.length(c) <= soft) | complete(c))
            fits = F.when(whole, pair(F.concat(s["done"], F.array(c)), F.lit(""))).otherwise(pair(s["done"], c))
            over = F.when(s["cur"] != "", pair(F.concat(s["done"], F.array(s["cur"])), x)).otherwise(pair(F.concat(s["done"], F.array(x)), F.lit("")))
            return F.when(F.length(c) <= emergency, fits).otherwise(over)

        return bound(both, judged)

    return _fold(chunks, state, step, lambda s: F.concat(s["done"], F.filter(F.array(s["cur"]), lambda x: x != "")))


def merge_short_sql(chunks: str, least: int = MIN_CHARS, soft: int = SOFT, emergency: int = EMERGENCY) -> str:
    fits = f"CASE WHEN length(c) >= {least} AND (length(c) <= {soft} OR {complete_sql('c')}) THEN {{'done': list_append(s.done, c), 'cur': ''}} ELSE {{'done': s.done, 'cur': c}} END"
    over = "CASE WHEN s.cur <> '' THEN {'done': list_append(s.done, s.cur), 'cur': x} ELSE {'done': list_append(s.done, x), 'cur': ''} END"
    step = f"list_transform([CASE WHEN s.cur = '' THEN x ELSE s.cur || chr(10) || chr(10) || x END], lambda c: CASE WHEN length(c) <= {emergency} THEN {fits} ELSE {over} END)[1]"
    return f"list_transform([list_reduce({chunks}, lambda s, x: {step}, {{'done': []::VARCHAR[], 'cur': ''}})], lambda s: list_concat(s.done, list_filter([s.cur], lambda x: x <> '')))[1]"


def duration_bounds(chunks: Column, least_s: float) -> Column:
    """A chunk shorter than ``least_s`` joined to its successor, once; the pair is not judged again."""
    state = F.struct(_none().alias("done"), F.lit("").alias("cur"))

    def step(s: Column, x: Column) -> Column:
        merged = F.when(s["cur"] == "", x).otherwise(F.concat(s["cur"], F.lit(" "), x))
        hold = (s["cur"] == "") & (seconds(x) < least_s)
        return F.struct(F.when(hold, s["done"]).otherwise(F.concat(s["done"], F.array(merged))).alias("done"), F.when(hold, x).otherwise("").alias("cur"))

    return _fold(chunks, state, step, lambda s: F.concat(s["done"], F.filter(F.array(s["cur"]), lambda x: x != "")))


def duration_bounds_sql(chunks: str, least_s: float) -> str:
    step = f"CASE WHEN s.cur = '' AND {seconds_sql('x')} < {least_s} THEN {{'done': s.done, 'cur': x}} ELSE {{'done': list_append(s.done, CASE WHEN s.cur = '' THEN x ELSE s.cur || ' ' || x END), 'cur': ''}} END"
    return f"list_transform([list_reduce({chunks}, lambda s, x: {step}, {{'done': []::VARCHAR[], 'cur': ''}})], lambda s: list_concat(s.done, list_filter([s.cur], lambda x: x <> '')))[1]"


def repaired(chunks: Column, emergency: int = EMERGENCY) -> Column:
    """An incomplete chunk joined to its successor where both fit, the last one to its predecessor."""
    state = F.struct(_none().alias("done"), F.lit("").alias("cur"))
    pair = lambda done, cur: F.struct(done.alias("done"), cur.alias("cur"))

    def step(s: Column, x: Column) -> Column:
        merged = F.concat(s["cur"], F.lit(" "), x)
        done = F.when(s["cur"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"])))
        alone = F.when(complete(x), pair(F.concat(done, F.array(x)), F.lit(""))).otherwise(pair(done, x))
        return F.when((s["cur"] != "") & (F.length(merged) <= emergency), pair(F.concat(s["done"], F.array(merged)), F.lit(""))).otherwise(alone)

    def finish(s: Column) -> Column:
        last = F.coalesce(F.get(s["done"], F.size(s["done"]) - 1), F.lit(""))
        merged = F.concat(last, F.lit(" "), s["cur"])
        back = F.concat(F.slice(s["done"], F.lit(1), F.greatest(F.size(s["done"]) - 1, F.lit(0))), F.array(merged))
        return F.when(s["cur"] == "", s["done"]).when((last != "") & (F.length(merged) <= emergency), back).otherwise(F.concat(s["done"], F.array(s["cur"])))

    return _fold(chunks, state, step, finish)


def repaired_sql(chunks: str, emergency: int = EMERGENCY) -> str:
    done = "(CASE WHEN s.cur = '' THEN s.done ELSE list_append(s.done, s.cur) END)"
    step = f"CASE WHEN s.cur <> '' AND length(s.cur) + 1 + length(x) <= {emergency} THEN {{'done': list_append(s.done, s.cur || ' ' || x), 'cur': ''}} WHEN {complete_sql('x')} THEN {{'done': list_append({done}, x), 'cur': ''}} ELSE {{'done': {done}, 'cur': x}} END"
    finish = f"CASE WHEN s.cur = '' THEN s.done WHEN len(s.done) > 0 AND length(s.done[-1]) + 1 + length(s.cur) <= {emergency} THEN list_append(s.done[:len(s.done) - 1], s.done[-1] || ' ' || s.cur) ELSE list_append(s.done, s.cur) END"
    return f"list_transform([list_reduce({chunks}, lambda s, x: {step}, {{'done': []::VARCHAR[], 'cur': ''}})], lambda s: {finish})[1]"


def _strict_words(text: Column, most: int) -> Column:
    """Words packed within ``most``, each but the first of a later piece counted with a space."""
    state = F.struct(_none().alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(s: Column, w: Column) -> Column:
        full = (s["cur"] != "") & (s["n"] + F.length(w) + 1 > most)
        return F.struct(F.when(full, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]).alias("done"), F.when(full | (s["cur"] == ""), w).otherwise(F.concat(s["cur"], F.lit(" "), w)).alias("cur"), F.when(full, F.length(w)).otherwise(s["n"] + F.length(w) + 1).alias("n"))

    return _fold(words_of(text), state, step, lambda s: F.concat(s["done"], F.filter(F.array(s["cur"]), lambda x: x != "")))


def strict_repack(chunk: Column, sentences, most: int = SOFT) -> Column:
    """A chunk of more than ``most`` characters as packs of its sentences (``sentences`` splits it), a longer sentence as packs
    of its words; what is open is finished before a long sentence."""
    state = F.struct(_none().alias("done"), F.lit("").alias("cur"))

    def step(s: Column, x: Column) -> Column:
        done = F.concat(s["done"], F.filter(F.array(s["cur"]), lambda c: c != ""))
        joined = F.when(s["cur"] == "", x).otherwise(F.concat(s["cur"], F.lit(" "), x))
        fits = F.length(joined) <= most
        return F.struct(F.when(F.length(x) > most, F.concat(done, _strict_words(x, most))).when(fits, s["done"]).otherwise(done).alias("done"), F.when(F.length(x) > most, "").when(fits, joined).otherwise(x).alias("cur"))

    packed = _fold(sentences(chunk), state, step, lambda s: F.concat(s["done"], F.filter(F.array(s["cur"]), lambda c: c != "")))
    return F.when(F.length(chunk) <= most, F.filter(F.array(chunk), lambda c: c != "")).otherwise(packed)


def strict_repack_sql(chunk: str, sentences: str, most: int = SOFT) -> str:
    words = f"list_transform([list_reduce({_words_sql('x')}, lambda b, w: CASE WHEN b.cur <> '' AND b.n + length(w) + 1 > {most} THEN {{'done': list_append(b.done, b.cur), 'cur': w, 'n': CAST(length(w) AS INT)}} ELSE {{'done': b.done, 'cur': CASE WHEN b.cur = '' THEN w ELSE b.cur || ' ' || w END, 'n': CAST(b.n + length(w) + 1 AS INT)}} END, {_EMPTY})], lambda b: list_concat(b.done, list_filter([b.cur], lambda c: c <> '')))[1]"
    done = "list_concat(s.done, list_filter([s.cur], lambda c: c <> ''))"
    step = f"CASE WHEN length(x) > {most} THEN {{'done': list_concat({done}, {words}), 'cur': ''}} WHEN length(s.cur) + CASE WHEN s.cur = '' THEN 0 ELSE 1 END + length(x) <= {most} THEN {{'done': s.done, 'cur': CASE WHEN s.cur = '' THEN x ELSE s.cur || ' ' || x END}} ELSE {{'done': {done}, 'cur': x}} END"
    packed = f"list_transform([list_reduce({sentences}, lambda s, x: {step}, {{'done': []::VARCHAR[], 'cur': ''}})], lambda s: {done})[1]"
    return f"CASE WHEN length({chunk}) <= {most} THEN list_filter([{chunk}], lambda c: c <> '') ELSE {packed} END"
