"""Quality rules: text statistics and compression bands.

A zstandard ratio (compressed bytes / raw bytes) near 0 means that a text repeats itself, a ratio near or
above the ratio of ordinary prose of the same length means noise. Ratios fall with length, so the band that is
accepted depends on the length. The whole text and each fixed chunk of it are measured; a text is rejected when
the whole lies outside its band, or when too large a share of its chunks does.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import map_columns

#: (bytes, lowest accepted ratio, highest accepted ratio): limits between two lengths are interpolated on the logarithm
#: of the length; shorter texts than the first are not judged by ratio, longer ones than the last get its limits.
BANDS = ((96, 0.50, 1.00), (256, 0.48, 0.88), (512, 0.43, 0.77), (1024, 0.40, 0.68), (4096, 0.38, 0.59), (16384, 0.35, 0.53), (65536, 0.31, 0.50))
CHUNK_BYTES = 4096
#: Share of chunks out of band from which the text is rejected.
CHUNK_SHARE = 0.4
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
WINDOW = 8


def repeated_words(words: list[bytes]) -> int:
    """Number of words lying in a window of ``WINDOW`` words that occurs at least twice in the list.

    Windows are compared exactly: words get numbers, then pairs, fours and eights of neighbours do, by doubling.
    """
    if len(words) <= WINDOW:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    width = 1
    while width < WINDOW:
        pairs = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        distinct, ids = np.unique(pairs, return_inverse=True)
        width *= 2
        if len(distinct) == len(pairs):
            return 0
    often = np.bincount(ids)[ids] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(often)
    cover[starts] += 1
    np.subtract.at(cover, starts + WINDOW, 1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines (split at newlines) that hold a word and equal an earlier line."""
    seen: set[str] = set()
    count = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            count += line in seen
            seen.add(line)
    return count


@functools.cache
def _packer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)


def band(size: int, bands=BANDS) -> tuple[float, float] | None:
    if size < bands[0][0]:
        return None
    at, low, high = zip(*bands, strict=True)
    where, log = np.log(at), math.log(size)
    return float(np.interp(log, where, low)), float(np.interp(log, where, high))


def compression(raw: bytes, bands=BANDS, chunk_bytes: int = CHUNK_BYTES) -> tuple[float | None, int, int, str]:
    """(ratio of the whole, chunks below their band, chunks above it, verdict of the whole).

    The last chunk takes the rest, so no chunk is short unless the text is; the verdict is ``ok``,
    ``repetitive``, ``incompressible`` or ``short``.
    """
    limits = band(len(raw), bands)
    if limits is None:
        return None, 0, 0, "short"
    pack = _packer().compress
    ratio = len(pack(raw)) / len(raw)
    verdict = "repetitive" if ratio < limits[0] else "incompressible" if ratio > limits[1] else "ok"
    low = high = 0
    count = max(1, len(raw) // chunk_bytes)
    if count > 1:
        for i in range(count):
            part = raw[i * chunk_bytes:] if i == count - 1 else raw[i * chunk_bytes:(i + 1) * chunk_bytes]
            floor, top = band(len(part), bands)
            r = len(pack(part)) / len(part)
            low += r < floor
            high += r > top
    return ratio, low, high, verdict


def measure(text: str | None, bands=BANDS, chunk_bytes: int = CHUNK_BYTES) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    ratio, low, high, verdict = compression(raw, bands, chunk_bytes)
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_words(words),
            len(raw), ratio, low, high, verdict)


STATS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, zstd_ratio double, "
         "chunks_low long, chunks_high long, zstd_verdict string")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def quality_rules(docs: DataFrame, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, chunk_share: float = CHUNK_SHARE) -> DataFrame:
    """Statistics, compression measures and verdict of every row of ``docs(doc_id, text)``.

    Null and empty texts have zero counts, fail the base rules and are not kept. Repeated rows give repeated
    results, a null id stays null, other columns of ``docs`` are ignored. One narrow pass; no shuffle.
    """
    def run(ids, texts):
        rows = list(zip(*[measure(t, bands, chunk_bytes) for t in texts], strict=True))
        return {"doc_id": ids, **dict(zip([c.split()[0] for c in STATS.split(", ")], rows, strict=True))}

    chunks = F.greatest(F.floor(F.col("n_bytes") / chunk_bytes), F.lit(1))
    method = F.col("zstd_verdict").isin("ok", "short") & ((F.col("chunks_low") + F.col("chunks_high")) < chunks * chunk_share)
    return (map_columns(docs.select("doc_id", "text"), run, f"doc_id long, {STATS}")
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & method))
