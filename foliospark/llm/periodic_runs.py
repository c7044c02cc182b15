"""Maximal periodic runs of words by block convolution.

A run is a stretch of at least two periods that no neighbour extends. Periods are handled by dyadic scales: at the scale with blocks of ``b``
words, periods from ``2b`` to below ``4b``. The first period of a run holds an aligned block, and the block occurs again one period later; so
each aligned block is looked for in the window of words that begins ``2b`` further. The sum of squared differences of word numbers is zero
exactly where the block occurs; it is computed for all places of a window at once by cross-correlation, with an exact number theoretic
transform. Zeros modulo the prime nominate, comparison of the words themselves decides. Each distance found seeds an extension to both sides.

* A block is transformed only if each of its words occurs again at a distance of the scale; other blocks cannot occur there.
* Where a block lies in a run of at most half its length, it occurs at every multiple of that period. Another run through it then has to
  match both runs end to end or start to start, or its two halves lie in two runs that touch; other distances are left out.
* Periods below the first scale are compared directly.
* Blocks stop growing at ``MOST``; from there on the longer windows are cut into sections, so a transform stays small for any text.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Block length of the first scale and of the last, and words of several texts that are handled at once.
FIRST, MOST, TOGETHER = 16, 1 << 16, 1 << 16
#: A prime with 2^27 dividing P - 1 and a primitive root of it (fixed values); products of residues fit 64 bits.
P, ROOT = 2013265921, 31
#: Numbers of a transform at a time.
BATCH = 1 << 19
LEAST = 12
U = np.uint64


def _reduced(x: np.ndarray) -> np.ndarray:
    return x - x // U(P) * U(P)


@functools.cache
def _roots(half: int, back: bool) -> np.ndarray:
    """Powers of a primitive root of unity of order ``2 * half``."""
    root = pow(ROOT, (P - 1) // (2 * half), P)
    root = pow(root, P - 2, P) if back else root
    out = np.ones(half, np.uint64)
    size = 1
    while size < half:
        out[size:2 * size] = _reduced(out[:size] * U(pow(root, size, P)))[:half - size]
        size *= 2
    return out


def transform(x: np.ndarray) -> np.ndarray:
    """Number theoretic transform of each row (length a power of two), in bit-reversed order."""
    x = x.copy()
    half = x.shape[1] // 2
    while half:
        v = x.reshape(-1, 2, half)
        low, high = v[:, 0], v[:, 1]
        apart = low + (U(P) - high)
        total = low + high
        v[:, 0] = np.minimum(total, total - U(P))  # the difference wraps round where the sum is already reduced
        v[:, 1] = _reduced(apart * _roots(half, False)) if half > 1 else np.minimum(apart, apart - U(P))
        half //= 2
    return x


def transform_back(x: np.ndarray) -> np.ndarray:
    """Rows from their transforms in bit-reversed order."""
    x = x.copy()
    half, size = 1, x.shape[1]
    while half < size:
        v = x.reshape(-1, 2, half)
        low, high = v[:, 0].copy(), _reduced(v[:, 1] * _roots(half, True)) if half > 1 else v[:, 1].copy()
        total, apart = low + high, low + (U(P) - high)
        v[:, 0] = np.minimum(total, total - U(P))
        v[:, 1] = np.minimum(apart, apart - U(P))
        half *= 2
    return _reduced(x * U(pow(size, P - 2, P)))


def occurrences(ids: np.ndarray, blocks: np.ndarray, b: int, first: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, distances): where the words of a block stand again, ``first`` to below ``first + places`` words further.

    ``ids`` must reach to the end of every window.
    """
    size = 1 << (b + places - 1 - 1).bit_length()
    rows = max(1, BATCH // size)
    found = []
    for at in range(0, len(blocks), rows):
        starts = blocks[at:at + rows]
        block = ids[starts[:, None] + np.arange(b)]
        window = ids[starts[:, None] + np.arange(first, first + b + places - 1)]
        one, two = np.zeros((len(starts), size), np.uint64), np.zeros((len(starts), size), np.uint64)
        # Reversed, the block's product with the window is their cross-correlation; cyclic wrap-round ends below b - 1.
        one[:, :b], two[:, :window.shape[1]] = block[:, ::-1], window
        cross = transform_back(_reduced(transform(one) * transform(two)))[:, b - 1:b - 1 + places]
        squares = np.zeros((len(starts), window.shape[1] + 1), np.uint64)
        np.cumsum(_reduced(two[:, :window.shape[1]] ** 2), axis=1, out=squares[:, 1:])
        own = _reduced(one[:, :b] ** 2).sum(axis=1)
        total = own[:, None] + squares[:, b:b + places] - squares[:, :places] + (U(P) - cross) * U(2)
        row, distance = np.nonzero(_reduced(total) == 0)
        found.append((starts[row], distance + first))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _left(ids: np.ndarray, i: int, q: int) -> int:
    """First place of the stretch ending before ``i`` in which words equal those ``q`` further."""
    step = 32
    while i > 0:
        low = max(0, i - step)
        unequal = np.flatnonzero(ids[low:i] != ids[low + q:i + q])
        if len(unequal):
            return low + int(unequal[-1]) + 1
        i, step = low, min(2 * step, 1 << 16)
    return i


def _right(ids: np.ndarray, i: int, q: int) -> int:
    """End of the stretch from ``i`` on in which words equal those ``q`` further."""
    step, last = 32, len(ids) - q
    while i < last:
        high = min(last, i + step)
        unequal = np.flatnonzero(ids[i:high] != ids[i + q:high + q])
        if len(unequal):
            return i + int(unequal[0])
        i, step = high, min(2 * step, 1 << 16)
    return i


def _short_periods(ids: np.ndarray, upto: int, runs: dict[tuple[int, int], int]) -> None:
    """Runs of the periods below ``upto``, by direct comparison."""
    for q in range(1, min(upto, len(ids) // 2 + 1)):
        unequal = np.concatenate(([-1], np.flatnonzero(ids[:-q] != ids[q:]), [len(ids) - q]))
        for k in np.flatnonzero(np.diff(unequal) - 1 >= max(LEAST, 2 * q) - q).tolist():
            runs.setdefault((int(unequal[k]) + 1, int(unequal[k + 1]) + q), q)


def _kept(starts: np.ndarray, distances: np.ndarray, b: int, size: int, runs: dict[tuple[int, int], int]) -> np.ndarray:
    """Which seeds are left where blocks lie in runs of at most half their length."""
    short = [(s, e) for (s, e), q in runs.items() if 2 * q <= b and e - s >= b]
    if not short:
        return np.ones(len(starts), bool)
    low, high = np.array(sorted(short)).T
    holds = np.full(size, -1)
    for k, (s, e) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        holds[s:e - b + 1] = k
    one, two = holds[starts], holds[starts + distances]
    ends, begins = high[two] - high[one] == distances, low[two] - low[one] == distances
    touch = (one != two) & (low[two] <= high[one])
    return (one < 0) | (two < 0) | ends | begins | touch


def find_runs(ids: np.ndarray, ends: np.ndarray, first: int = FIRST, most: int = MOST) -> dict[tuple[int, int], int]:
    """{(start, end): smallest period} of the runs of at least ``max(12, 2 * period)`` words.

    ``ids`` holds several texts, each followed by a number that occurs nowhere else; ``ends`` has the place of that number for each place.
    """
    runs: dict[tuple[int, int], int] = {}
    _short_periods(ids, 2 * first, runs)
    left = np.flatnonzero(np.diff(ends, prepend=-1))  # where texts start
    lengths = ends[left] - left
    order = np.argsort(ids, kind="stable")
    wide = np.int64(2 * len(ids) + 1)
    keys = ids[order] * wide + order
    padded, scale = None, first
    while len(lengths) and int(lengths.max()) >= 4 * scale:
        b = min(scale, most)
        long = lengths >= 4 * scale
        begins, sizes = left[long], lengths[long]
        # Aligned blocks that leave room for the shortest distance and the block again.
        count = (sizes - 2 * scale - b) // scale + 1
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        blocks = np.repeat(begins, count) + within * scale
        # Each word of the block must occur again at a distance of this scale.
        inside = np.repeat(long, np.diff(np.append(left, len(ids))))[order]
        mine = keys[inside]
        next_ = np.searchsorted(keys, mine + 2 * scale)
        again = np.zeros(len(ids) + 1, np.int64)
        again[order[inside] + 1] = (next_ < len(keys)) & (keys[np.minimum(next_, len(keys) - 1)] < mine + 4 * scale)
        again = np.cumsum(again)
        blocks = blocks[again[blocks + b] - again[blocks] == b]
        if len(blocks):
            if padded is None:
                padded = np.concatenate((ids, np.full(int(lengths.max()) * 2 + 8 * first, ids.max() + 1)))
            for at in range(2 * scale, 4 * scale, 2 * b):
                starts, distances = occurrences(padded, blocks[blocks + at + b <= ends[blocks]], b, at, 2 * b)
                fit = starts + distances + b <= ends[starts]
                _extend(ids, starts[fit], distances[fit], b, runs)
        scale *= 2
    return runs


def _extend(ids: np.ndarray, starts: np.ndarray, distances: np.ndarray, b: int, runs: dict[tuple[int, int], int]) -> None:
    """Grow each seed to the maximal stretch of its distance and keep what is long enough and has no shorter period."""
    keep = _kept(starts, distances, b, len(ids), runs)
    starts, distances = starts[keep], distances[keep]
    last, reach = 0, 0
    for k in np.lexsort((starts, distances)).tolist():
        x, q = int(starts[k]), int(distances[k])
        if q == last and x < reach:
            continue
        right = _right(ids, x, q)
        if right < x + b:  # zero by the modulus only
            continue
        low = _left(ids, x, q)
        last, reach = q, right
        if right - low >= max(LEAST, 2 * q) - q:
            runs.setdefault((low, right + q), q)


def rewritten(n: int, doc_id: int | None) -> tuple[int, int]:
    """(a, p): from word ``a`` on the words of a text repeat with period ``p``; (n, 1) where the text stays as it is."""
    if doc_id is None or not n:
        return n, 1
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return n, 1
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def digests(words: list[bytes], runs: list[tuple[int, int, int]]) -> dict:
    """The row of a text from its words and its runs (start, length, period), sorted by start, then period."""
    out = {"n_runs": len(runs), "start": None, "length": None, "period": None, "exponent_milli": None}
    if runs:
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]))
        out |= {"start": start, "length": length, "period": period, "exponent_milli": 1000 * length // period}
        drop = np.zeros(len(words) + 1, np.int64)
        np.add.at(drop, [s + q for s, _, q in runs], 1)
        np.add.at(drop, [s + n for s, n, _ in runs], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
    out["runs_sha256"] = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    out["collapsed_sha256"] = hashlib.sha256(b" ".join(words)).hexdigest()
    return out


def runs_of(texts: list[list[bytes]], first: int = FIRST, most: int = MOST) -> list[list[tuple[int, int, int]]]:
    """For each text the sorted (start, length, period) of its runs."""
    numbers: dict[bytes, int] = {}
    parts, begins, size = [], [], 0
    for words in texts:
        begins.append(size)
        parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
        parts.append(np.array([-1]))
        size += len(words) + 1
    if not size:
        return []
    ids = np.concatenate(parts)
    own = ids == -1
    ids[own] = len(numbers) + np.arange(len(texts))
    ends = np.repeat(np.flatnonzero(own), np.diff(np.append(begins, size)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    of = np.repeat(np.arange(len(texts)), np.diff(np.append(begins, size)))
    for (s, e), q in find_runs(ids, ends, first, most).items():
        k = int(of[s])
        out[k].append((s - begins[k], e - s, q))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


ROW = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, rewrite: bool = False) -> DataFrame:
    """Runs of every row of ``docs(doc_id, text)``: their number, the longest one, and digests of all of them and of the text without repeats.

    With ``rewrite`` the words of some texts are first made periodic, by their ids (see ``rewritten``); a null id changes nothing. A null or
    blank text has no words, no run and the digests of the empty string. Repeated rows are returned each, other columns are ignored, an
    empty table gives no rows. A task holds the words of at most one long text, or of short ones up to a bound.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                upto, size = at, 0
                ids, texts = [], []
                while upto < batch.num_rows and size < TOGETHER:
                    words = (batch.column(1)[upto].as_py() or "").encode("utf-8", "surrogatepass").split()
                    ids.append(batch.column(0)[upto].as_py())
                    if rewrite:
                        a, p = rewritten(len(words), ids[-1])
                        words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
                    texts.append(words)
                    size += len(words)
                    upto += 1
                rows = [{"doc_id": i} | digests(w, r) for i, w, r in zip(ids, texts, runs_of(texts), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                at = upto

    return docs.select("doc_id", "text").mapInArrow(run, ROW)


SCHEMA = pa.schema([(c, pa.string() if kind == "string" else pa.int64()) for c, kind in (x.split() for x in ROW.split(", "))])
