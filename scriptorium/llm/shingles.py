"""Hashed word-shingle sets and their PartEnum signatures, over whole batches of texts at once."""

from __future__ import annotations

import numpy as np

#: Bytes of text that are hashed and signed together, which takes some 40 bytes of memory for each; a longer text is hashed alone.
SLICE = 1 << 18
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose outputs look random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, (1 << 20) + (1 << 16))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers


_places: list[np.ndarray] = [np.zeros(0, np.uint64)]


def word_hashes(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased: the sum of its bytes' numbers times a number of its own for each place
    in the word. Places' numbers are unrelated, so words that powers of one base cannot tell apart differ here."""
    lens = stop - start
    most = int(lens.max(initial=0))
    if len(_places[0]) < most:
        _places[0] = mixed(np.arange(1, max(most, 1 << 12) + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    total = np.zeros(len(buf) + 1, np.uint64)
    place = np.arange(len(buf))
    place -= np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(buf)]])))
    np.minimum(place, max(0, most - 1), out=place)  # white space behind a word counts for none
    np.cumsum(_BYTE[_LOW[buf]] * _places[0][place] if most else _BYTE[buf], out=total[1:])
    return mixed(total[stop] - total[start])


def shingle_sets(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): text i's distinct shingles are ``hashes[bounds[i]:bounds[i + 1]]``, rising.

    A-Z are lower-cased; words are runs of bytes other than white space. A text of fewer than ``size`` words has its whole
    word sequence as one shingle, one of no words has none. A shingle is a 64-bit hash.
    """
    n = len(texts)
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, n)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
    start, stop = edge[0::2], edge[1::2]
    word = word_hashes(buf, start, stop)
    ends = np.cumsum(lens)
    at = np.searchsorted(start, ends)  # words before the end of each text
    first = np.concatenate([[0], at[:-1]]) if n else at
    count = at - first
    long = np.maximum(count - size + 1, 0)
    # starts of whole shingles: every word but the last size-1 of its text
    keep = np.ones(len(word), bool)
    for j in range(1, size):
        k = at[count >= j] - j
        keep[k] = False
    begin = np.flatnonzero(keep)
    value = np.zeros(len(begin), np.uint64)
    for j in range(size):
        value += word[begin + j] * _PLACE[j] if len(begin) else value
    owner = np.repeat(np.arange(n), long)
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        short = count[few].astype(np.uint64) * _PLACE[7]
        for j in range(size - 1):
            ok = count[few] > j
            short[ok] += word[first[few[ok]] + j] * _PLACE[j]
        value, owner = np.concatenate([value, short]), np.concatenate([owner, few])
    value = mixed(value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return np.searchsorted(owner, np.arange(n + 1)), value


def slices(texts: list[bytes], limit: int = SLICE):
    """Index ranges of consecutive texts of at most ``limit`` bytes in all, or one text."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        if i > a and held + len(t) > limit:
            yield a, i
            a, held = i, 0
        held += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum (mod 2**64) of each of the ranges between ``bounds``; 0 for an empty one."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def set_keys(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set, equal for equal sets."""
    sizes = (bounds[1:] - bounds[:-1]).astype(np.uint64)
    return mixed(segment_sums(mixed(values ^ np.uint64(0x5851F42D4C957F2D)), bounds) + sizes * _PLACE[6])


def partitions_of(level: int) -> int:
    """First-level partitions of the feature domain for sets of up to ``2**level`` features; each has three parts.

    A pair of them, or of one with a set of the next band, differs by at most ``2**level / 3`` features. Spoiling a partition takes two of them, so half as
    many partitions and one more would do; the rest is for those that a set leaves empty."""
    n = 1 << level
    return max(1, n // 4) if level <= 4 else int(0.21 * n) if level <= 6 else int(0.182 * n)


#: The subsets of a partition's three parts that are enumerated: two similar sets agree on all but one part somewhere.
_SUBSETS = ((0, 1), (0, 2), (1, 2))


def _runs(row: np.ndarray, values: np.ndarray, level: np.ndarray, tag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature) of each subset of two parts of a partition that has features, and for each row the number of
    differing features that it takes to spoil all of these; ``level`` is by row, values rise within a row."""
    if not len(row):
        return row, np.zeros(0, np.uint64), np.zeros(len(level), np.int64)
    parts = np.array([3 * partitions_of(x) for x in range(int(level[row].max()) + 1)], np.uint64)
    p = ((values >> np.uint64(32)) * parts[level[row]]) >> np.uint64(32)
    new = np.ones(len(row), bool)
    new[1:] = (p[1:] != p[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    sums = segment_sums(mixed(values ^ np.uint64(0xD6E8FEB86659FD93)), np.concatenate([at, [len(row)]]))
    owner, p = row[at], p[at]
    first, part = p // np.uint64(3), (p % np.uint64(3)).astype(np.int64)
    new = np.ones(len(owner), bool)
    new[1:] = (first[1:] != first[:-1]) | (owner[1:] != owner[:-1])
    which = np.cumsum(new) - 1
    held = np.zeros((int(which[-1]) + 1, 3), np.uint64)
    full = np.zeros(held.shape, bool)
    held[which, part] = mixed(sums + part.astype(np.uint64))
    full[which, part] = True
    owner, first = owner[new], first[new]
    cost = np.bincount(owner, weights=np.minimum(full.sum(1), 2), minlength=len(level)).astype(np.int64)
    mark = (level[owner].astype(np.uint64) << np.uint64(40)) + first * np.uint64(4) + np.uint64(tag << 50)
    owners, found = [], []
    for k, (i, j) in enumerate(_SUBSETS):
        some = full[:, i] | full[:, j]
        owners.append(owner[some])
        found.append(mixed(held[some, i] + held[some, j] + mixed(mark[some] + np.uint64(k + 1))))
    return np.concatenate(owners), np.concatenate(found), cost


#: Sizes that open a narrow size class; each class spans a factor of about 1.1.
_EDGES = np.unique(np.ceil(1.1 ** np.arange(400)).astype(np.float64)).clip(max=2.0**52).astype(np.int64)


#: Kinds of signatures, in their two lowest bits.
PLAIN, ALIKE, LOWER, UPPER = range(4)


def _of_kind(signature: np.ndarray, kind) -> np.ndarray:
    return (signature & ~np.uint64(3)) | np.asarray(kind).astype(np.uint64)


def _mostly_common(rows: np.ndarray, sizes: np.ndarray, rare: tuple[np.ndarray, np.ndarray], usual: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, signature) by which two of ``rows``, sets with few uncommon features, meet if they are similar.

    Let A (a features, r of them uncommon) and B be similar; A lacks at most (4b - 3a)/7 of B's features and B at most
    (4a - 3b)/7 <= a/4 of A's. If they share an uncommon feature, the first of those in hash order is among the first
    a/4 + 1 uncommon ones of A, and of B likewise: each of these is a partition of its own and signs. If they share none,
    7r <= 4a - 3b, and they are similar by their common features alone, which differ by (a + b)/7 - r at most. So for each
    narrow size class that such a B may be in, A's common features are partitioned and sign, marked with both classes.
    The two lowest bits of a signature are its kind: PLAIN, ALIKE (one class twice), or LOWER and UPPER (of two classes,
    the set is in the lower or upper one). A group of LOWER sets only, or UPPER ones, holds no pair.
    """
    at = np.full(len(sizes), -1, np.int64)
    at[rows] = np.arange(len(rows))
    a = sizes[rows]
    owners, found = [], []
    pick = at[rare[0]] >= 0
    o, v = rare[0][pick], rare[1][pick]
    r = np.bincount(at[o], minlength=len(rows))
    place = np.arange(len(o)) - np.repeat(np.concatenate([[0], np.cumsum(r)[:-1]]), r) if len(o) else o
    first = place <= a[at[o]] // 4
    owners.append(o[first])
    found.append(_of_kind(mixed(v[first] ^ np.uint64(0x2545F4914F6CDD1D)), PLAIN))

    own = np.searchsorted(_EDGES, a, "right") - 1
    low = np.searchsorted(_EDGES, -(-3 * a // 4), "right") - 1
    high = np.searchsorted(_EDGES, 4 * a // 3, "right") - 1
    pick = at[usual[0]] >= 0
    o, v = at[usual[0][pick]], usual[1][pick]
    start = np.searchsorted(o, np.arange(len(rows) + 1))
    for step in range(int((high - low).max()) + 1 if len(rows) else 0):
        other = low + step
        least, most = np.maximum(_EDGES[np.minimum(other, len(_EDGES) - 2)], -(-3 * a // 4)), np.minimum(_EDGES[np.minimum(other, len(_EDGES) - 2) + 1] - 1, 4 * a // 3)
        use = np.flatnonzero((other <= high) & (least <= most) & (7 * r <= 4 * a - 3 * least))
        if not len(use):
            continue
        big = np.maximum(own[use], other[use])
        level = np.ceil(np.log2(np.maximum(_EDGES[big + 1] - 1, 1))).astype(np.int64)
        count = start[use + 1] - start[use]
        local = np.repeat(np.arange(len(use)), count)
        take = np.arange(len(local)) + np.repeat(start[use] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        mark = mixed((np.minimum(own[use], other[use]) * 1024 + big).astype(np.uint64) + np.uint64(0x5BD1E995 << 24))
        kind = np.where(own[use] == other[use], ALIKE, np.where(own[use] < other[use], LOWER, UPPER))
        who, sig, cost = _runs(local, v[take], level, 1)
        owners.append(rows[use][who])
        found.append(_of_kind(mixed(sig ^ mark[who]), kind[who]))
        # too few partitions for certain: a pair of which neither has enough meets by this number
        poor = np.flatnonzero(cost <= (a[use] + most[use]) // 7 - r[use])
        owners.append(rows[use][poor])
        found.append(_of_kind(mixed(mark[poor] + np.uint64(0xABCDEF)), kind[poor]))
    return np.concatenate(owners), np.concatenate(found)


def signatures(bounds: np.ndarray, values: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(owner, signature) of PartEnum for Jaccard similarity 0.75 or more.

    Sets A and B of sizes a <= b are that similar only if b <= 4a/3 and they differ by k <= (a + b)/7 features. Sizes fall
    into bands (2**(l-1), 2**l]; B also signs for the band below if a partner may be there. A band cuts the hashed domain
    into :func:`partitions_of` partitions of three parts each, and a signature stands for two parts of a partition and all
    of the set's features in them. With one differing feature in a partition, one of its three subsets is the same in both
    sets; so spoiling a partition takes two, or one where the set has features in one part only. If that adds up to more
    than k for A or B, the pair shares a signature. Subsets without features don't sign.

    ``common`` (rising) names features that don't enter these partitions, such as those of boilerplate. Whichever they
    are, no pair is lost: without them two sets differ by no more than before, while k and the bands keep the whole sizes.
    A pair of which neither can outweigh k meets by :func:`_mostly_common`.
    """
    sizes = bounds[1:] - bounds[:-1]
    level = np.zeros(len(sizes), np.int64)
    big = sizes > 1
    level[big] = np.ceil(np.log2(sizes[big])).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    few, usual = (row, values), (row[:0], values[:0])
    if common is not None and len(common):
        rare = common[np.minimum(np.searchsorted(common, values), len(common) - 1)] != values
        few, usual = (row[rare], values[rare]), (row[~rare], values[~rare])
    owners, found = [], []
    short = np.zeros(len(sizes), bool)
    for below in (0, 1):
        lv = np.maximum(level - below, 0)
        use = (sizes > 0) if not below else (sizes > 1) & (3 * sizes <= 4 * (1 << lv))
        most = (sizes + (1 << lv if below else 4 * sizes // 3)) // 7
        pick = use[few[0]]
        o, s, cost = _runs(few[0][pick], few[1][pick], lv, 0)
        owners.append(o)
        found.append(_of_kind(s, PLAIN))
        short |= use & (cost <= most)
    o, s = _mostly_common(np.flatnonzero(short), sizes, few, usual)
    return np.concatenate([*owners, o]), np.concatenate([*found, s])


def sketch(values: np.ndarray) -> bytes:
    """Counts (255 at most) of a set's features in 2**(l-1) equal ranges of the hashed domain, l being its band."""
    n = len(values)
    bits = max(0, (max(1, n) - 1).bit_length() - 1)
    at = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(n, np.int64)
    return np.minimum(np.bincount(at, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _counts_of(sketches: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts in ``length`` ranges, 255 at most, whether a folded count was full before it was folded)."""
    rows = [np.frombuffer(s, np.uint8) for s in sketches]
    folded = np.array([x.reshape(length, -1).sum(1, dtype=np.int64) for x in rows])
    full = np.array([len(x) > length and x.max() == 255 for x in rows])
    return np.minimum(folded, 255).astype(np.int16), full


def far_apart(n: list[int], a: list[bytes], m: list[int], b: list[bytes]) -> np.ndarray:
    """Matrix of which sets (their sizes ``n`` and sketches ``a``) cannot have Jaccard similarity 0.75 with which of others.

    The difference of two sketches, folded to the coarser one's ranges, is a lower bound of the features by which the sets
    differ. Counts that were full before folding say nothing; full ones otherwise only lower the bound."""
    n, m = np.asarray(n, np.int64), np.asarray(m, np.int64)
    far = 4 * np.minimum(n[:, None], m[None, :]) < 3 * np.maximum(n[:, None], m[None, :])
    sides = [{k: np.flatnonzero([len(s) == k for s in side]) for k in sorted({len(s) for s in side})} for side in (a, b)]
    for la, one in sides[0].items():
        for lb, two in sides[1].items():
            length = min(la, lb)
            x, fx = _counts_of([a[i] for i in one], length)
            y, fy = _counts_of([b[i] for i in two], length)
            step = max(1, (1 << 22) // max(1, len(two) * length))
            for lo in range(0, len(one), step):
                mine = one[lo : lo + step]
                gap = np.abs(x[lo : lo + step, None, :] - y[None, :, :]).sum(2, dtype=np.int64)
                apart = (7 * gap > n[mine][:, None] + m[two][None, :]) & ~fx[lo : lo + step, None] & ~fy[None, :]
                far[np.ix_(mine, two)] |= apart
    return far
