"""Exact Jaccard self-join of word n-gram sets by universe partitions.

**Segments.** Sets are banded by size. For a band, the n-gram universe is cut by a hash into ``m = H + 1`` segments,
where ``H`` is the largest symmetric difference that two linked sets can have if the smaller one is in the band. By the
pigeonhole principle two linked sets agree in at least one segment. A set emits one signature per filled segment, in the
layout of its own band and, if it can be the larger partner, in that of the band below.

**Allocation.** A signature that many sets share is dear, and so is agreement in an empty segment, which says nothing.
If two linked sets agree in ``k`` segments, at most ``k - 1`` of the others differ by two or more, so almost all differ by
exactly one element, and then the larger side minus one element equals the smaller. A set with ``h`` empty segments
therefore emits one-deletion neighbourhoods for as many leading segments as hold ``h`` useful ones, instead of the empty
signatures. A set that meets a dear signature emits the neighbourhoods of all its segments; if at least half of its
segments are cheap (neither they nor their neighbourhoods are dear), any partner is found through these and it leaves the
dear buckets. Only sets made up of dear segments for the most part stay in them.

**Verification.** Buckets are not expanded into all pairs, and of buckets with the same rows one is asked. A bucket is
checked against one of its members, and links are contracted into components. Only buckets that still hold several
components go on, against another member as long as that closes buckets. Pairs that sketches rule out leave before texts
move. Then small ones are compared pair by pair; in large
ones, what is not in the largest component of its bucket is held against the other components by sketches (counts of
hashed n-grams, whose distance never exceeds the symmetric difference), in blocks. Pairs that the sketches can't
rule out are compared from the nearest on, in rounds: each asking row remembers the place that it has reached and takes the next
ones that are not in its component by then, until none is left.
Links are decided exactly, on the n-grams of the whole texts.

Equal sets are one class throughout.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.graph import components
from foliospark.sources.scratch import dropped, written

#: Ratio of the largest to the smallest set of a band.
BAND = 1.5
#: Rows from which a bucket is dear, and rows up to which all pairs of a bucket that still matter are compared at once.
DEAR, SMALL = 64, 24
#: Bins of a sketch, and rows of a block of sketches.
BINS, BLOCK = 256, 4096
U = np.uint64
#: Odd multipliers for the places of a word in an n-gram.
FACTORS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)]


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser (public constants of splitmix64), salted."""
    x = (x ^ U(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case (bytes methods leave other letters alone)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def ngrams(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return set(zip(*[words[i:] for i in range(n)], strict=False)) if len(words) >= n else {tuple(words)}


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


BASE = 0x5851F42D4C957F2D
#: Value of each byte in a word hash, the same for A-Z and a-z, and which bytes separate words.
_LETTERS = mix(np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64) + U(1), 41)
_BLANK = np.array([c in b" \t\n\r\x0b\x0c" for c in range(256)])
#: Bytes hashed at a time, and the length from which a word is hashed on its own.
SLICE, GIANT = 1 << 18, 1 << 16


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    steps = [np.concatenate(([U(1)], np.full(size - 1, U(b), np.uint64))) for b in (BASE, _inverse(BASE))]
    return np.multiply.accumulate(steps[0]), np.multiply.accumulate(steps[1])


def _slice_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words of a slice: differences of a running sum over all its bytes, brought to a common place."""
    data = np.frombuffer(raw, np.uint8)
    up, down = _powers(1 << max(12, (len(data) + 1).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * up[:len(data)], out=total[1:])
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * FACTORS[1], 43)
    for k in np.flatnonzero(ends - starts >= GIANT):
        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k]:ends[k]].lower())
    return out


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, in order, without making the words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if len(raw) <= SLICE:
        return _slice_hashes(raw)
    words = raw.split()
    parts, part, size = [], [], 0
    for w in words:
        if size + len(w) >= SLICE:
            parts.append(part)
            part, size = [], 0
        part.append(w if len(w) < SLICE else None)
        size += len(w) + 1 if len(w) < SLICE else 0
        if part[-1] is None:
            part.pop()
            parts += [part, w]
            part, size = [], 0
    parts.append(part)
    return np.concatenate([np.array([xxhash.xxh3_64_intdigest(p.lower())], np.uint64) if isinstance(p, bytes) else _slice_hashes(b" ".join(p)) for p in parts])


def ngram_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams; they only nominate and group, links are decided on the n-grams."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(n, len(h))
    total = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        total = (total + h[i:len(h) - width + 1 + i]) * FACTORS[i % len(FACTORS)]
    total = mix(total, width)
    total.sort()
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


@functools.cache
def bands(percent: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """(largest size, segments) per band, far enough for sets of ``upto`` elements."""
    tops, low = [], 1
    while not tops or tops[-1] < upto:
        tops.append(max(low, int(low * max(BAND, 100 / percent))))
        low = tops[-1] + 1
    return np.array(tops), np.array([t * (100 - percent) // percent + 1 for t in tops])


def layouts(size: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, segments, 1 for the larger partner's side) in which a set of this size takes part."""
    tops, segments = bands(percent, 1 << (size - 1).bit_length() if size > 1 else 1)
    own = int(np.searchsorted(tops, size))
    out = [(own, int(segments[own]), 0)]
    if own and size <= int(tops[own - 1]) * 100 // percent:
        out.append((own - 1, int(segments[own - 1]), 1))
    return [x for x in out if x[1] > 1]


#: Kinds of rows, kept in the two low bits of a class: whole segment or one element less, smaller or larger side.
WHOLE, LESS, GUEST = 0, 1, 2


@functools.cache
def _salts(band: int, m: int) -> np.ndarray:
    return mix(np.arange(m, dtype=np.uint64) + U(band << 40), 13)


def signatures(hashes: np.ndarray, percent: int, every: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """Per layout: (band, signatures, kinds, segments, number of segments, empties).

    With ``every``, neighbourhoods of all segments and the signatures of empty segments are given; else what the
    allocation for empty segments asks for. A signature is the sum of the values of its elements and a salt of its segment.
    """
    values = mix(hashes, 11)
    for band, m, side in layouts(len(hashes), percent):
        segment = ((hashes * FACTORS[band % 5] ^ U(band)) * FACTORS[(band + 1) % 5] >> U(33)).astype(np.int64) % m
        order = np.argsort(segment)
        segment, value = segment[order], values[order]
        starts = np.concatenate(([0], np.flatnonzero(segment[1:] != segment[:-1]) + 1))
        filled = segment[starts]
        sums = np.add.reduceat(value, starts)
        salt = _salts(band, m)
        empties = m - len(filled)
        guest = GUEST if side else 0
        sigs, kinds, places = [sums + salt[filled]], [np.full(len(filled), WHOLE + guest, np.int64)], [filled]
        if every or empties:
            sizes = np.diff(np.append(starts, len(segment)))
            useful = filled[sizes >= 2]
            lost = len(useful) < empties
            upto = m if every or lost else int(useful[empties - 1]) + 1
            chosen = (segment < upto) & (np.repeat(sizes, sizes) >= 2)
            whole = np.repeat(sums, sizes)[chosen]
            sigs.append(whole - value[chosen] + salt[segment[chosen]])
            kinds.append(np.full(len(whole), LESS + guest, np.int64))
            places.append(segment[chosen])
            if empties and (lost or every):
                bare = np.setdiff1d(np.arange(m), filled)
                sigs.append(salt[bare])
                kinds.append(np.full(len(bare), WHOLE + guest, np.int64))
                places.append(bare)
        yield band, np.concatenate(sigs), np.concatenate(kinds), np.concatenate(places), m, empties


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set; the second half, with two low bits free, names its class in signature rows."""
    first = mix(hashes, 19)
    high, low = first.sum(dtype=np.uint64), ((first ^ (first >> U(29))) * FACTORS[3]).sum(dtype=np.uint64)
    high, low = mix(np.array([high]), len(hashes) + 29), mix(np.array([low]), len(hashes) + 31)
    return int(high.view(np.int64)[0]), int((low & ~U(3)).view(np.int64)[0])


def _batches(df: DataFrame, fn, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                columns = fn(state, *[c.to_pylist() for c in batch.slice(at, 128).columns])
                if columns is not None:
                    yield pa.RecordBatch.from_pydict(columns)
    return df.mapInArrow(run, schema)


def text_key():
    return F.xxhash64("text").alias("text_key")


def set_facts(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, high, class`` per row; the key is the hash of the text."""
    def run(_, ids, texts, keys):
        sets = [ngram_hashes(t, n) for t in texts]
        prints = [fingerprint(h) for h in sets]
        return {"doc_id": pa.array(ids, pa.int64()), "text_key": pa.array(keys, pa.int64()), "n_shingles": pa.array([len(h) for h in sets], pa.int64()),
                "high": pa.array([p[0] for p in prints], pa.int64()), "class": pa.array([p[1] for p in prints], pa.int64())}

    return _batches(docs.select("doc_id", "text", text_key()), run, "doc_id long, text_key long, n_shingles long, high long, class long")


def signature_rows(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """``sig, id`` (class and kind) of the plain allocation. A task emits equal sets that it meets again only once."""
    def run(state, rows):
        seen = state.setdefault("seen", set())
        sigs, ids = [], []
        for t in rows:
            hashes = ngram_hashes(t, n)
            if not len(hashes):
                continue
            name = fingerprint(hashes)[1]
            if name in seen:
                continue
            seen.add(name)
            for _, sig, kind, _, _, _ in signatures(hashes, percent, False):
                sigs.append(sig)
                ids.append(name | kind)
        if sigs:
            return {"sig": pa.array(np.concatenate(sigs).view(np.int64)), "id": pa.array(np.concatenate(ids))}

    return _batches(texts.select("text"), run, "sig long, id long")


def neighbourhood_rows(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """``sig, id, band, segment, m, bare, empty`` of the full allocation; ``bare`` marks segments that can't be cheap (empty or of one element)."""
    def run(_, rows):
        out: list[tuple] = []
        for t in rows:
            hashes = ngram_hashes(t, n)
            if not len(hashes):
                continue
            name = fingerprint(hashes)[1]
            for band, sig, kind, segment, m, empties in signatures(hashes, percent, True):
                empty = np.arange(len(sig)) >= len(sig) - empties
                less = np.unique(segment[kind & LESS == LESS])
                out.append((sig.view(np.int64), name | kind, np.full(len(sig), band, np.int32), segment.astype(np.int32), np.full(len(sig), m, np.int32), ~np.isin(segment, less), empty))
        if out:
            return {c: pa.array(np.concatenate([o[i] for o in out])) for i, c in enumerate(("sig", "id", "band", "segment", "m", "bare", "empty"))}

    return _batches(texts.select("text"), run, "sig long, id long, band int, segment int, m int, bare boolean, empty boolean")


def class_of(column: str = "id"):
    return F.col(column).bitwiseAND(F.lit(~3))


def is_less(column: str = "id"):
    return F.col(column).bitwiseAND(F.lit(LESS)) == LESS


def is_guest(column: str = "id"):
    return F.col(column).bitwiseAND(F.lit(GUEST)) == GUEST


def shared(rows: DataFrame, *more: str) -> DataFrame:
    """Rows of buckets that can hold a link: two classes at least, a whole segment, and a set on the smaller side."""
    bucket = Window.partitionBy("sig")
    return (rows.withColumn("low", F.min(class_of()).over(bucket)).withColumn("high", F.max(class_of()).over(bucket))
            .withColumn("wholes", F.sum((~is_less()).cast("long")).over(bucket)).withColumn("owns", F.sum((~is_guest()).cast("long")).over(bucket))
            .withColumn("held", F.count("*").over(bucket))
            .where("low != high and wholes > 0 and owns > 0").select("sig", "id", "held", *more))


def candidates(docs: DataFrame, classes: DataFrame, n: int, percent: int, dear: int) -> tuple[DataFrame, list[DataFrame]]:
    """``sig, id``: the buckets that have to be checked, after the allocation by cost; and the written tables that they read."""
    spark = docs.sparkSession
    rows = written(spark, shared(signature_rows(docs, n, percent)), "ngram-buckets")
    cheap = rows.where(F.col("held") <= dear).select("sig", "id")
    dear_rows = rows.where(F.col("held") > dear)
    if dear_rows.isEmpty():
        return cheap, [rows]
    meets = dear_rows.select(class_of().alias("class")).distinct().join(classes, "class").select(F.col("doc_id"))
    full = written(spark, neighbourhood_rows(docs.join(meets, "doc_id", "left_semi"), n, percent), "ngram-neighbours")
    # Marks of dear signatures and counts of cheap segments come by windows over the rows themselves: nothing is joined back.
    marks = dear_rows.select("sig").distinct().withColumn("mark", F.lit(True))
    marked = full.withColumn("mark", F.lit(False)).unionByName(marks, allowMissingColumns=True).withColumn("dear", F.max("mark").over(Window.partitionBy("sig"))).where("id is not null")
    marked = marked.select("sig", "id", "band", "segment", "m", "bare", "empty", "dear", class_of().alias("class")).repartition("class", "band")
    segment, whole = Window.partitionBy("class", "band", "segment"), Window.partitionBy("class", "band")
    marked = (marked.withColumn("bad", F.max(F.col("bare") | F.col("dear")).over(segment)).withColumn("at", F.row_number().over(segment.orderBy("id", "sig")))
              .withColumn("covered", F.sum(F.when((F.col("at") == 1) & ~F.col("bad"), 1).otherwise(0)).over(whole) * 2 >= F.col("m")))
    # Cheap rows stay, also of segments that count as bad: they are what others' neighbourhoods meet. Dear or empty whole segments stay for sets not covered.
    stays = (~F.col("dear") & ~F.col("empty")) | (~F.col("covered") & ~is_less())
    chosen = written(spark, marked.where(stays).select("sig", "id"), "ngram-chosen")
    dropped(full)
    return cheap.unionByName(shared(chosen.dropDuplicates(["sig", "id"])).select("sig", "id")), [rows, chosen]


def sketch(hashes: np.ndarray) -> bytes:
    """Counts of the n-grams by hash, saturating at 255: their distance is at most the symmetric difference of the sets."""
    counts = np.bincount((mix(hashes, 37) >> U(40)).astype(np.int64) % BINS, minlength=BINS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def texts_of(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """``class, text, size, sketch`` for ``members(class, doc_id)``; of rows that repeat an id, those with the n-grams of the class."""
    def run(_, names, rows):
        sets = [ngram_hashes(t, n) for t in rows]
        own = [i for i, (name, h) in enumerate(zip(names, sets, strict=True)) if name == fingerprint(h)[1]]
        return {"class": pa.array([names[i] for i in own], pa.int64()), "text": pa.array([rows[i] for i in own], pa.string()),
                "size": pa.array([len(sets[i]) for i in own], pa.int64()), "sketch": pa.array([sketch(sets[i]) for i in own], pa.binary())}

    return _batches(docs.select("doc_id", "text").join(members, "doc_id").select("class", "text"), run, "class long, text string, size long, sketch binary")


def unlike(rows: DataFrame) -> DataFrame:
    """``rows(sig, class, less)`` without the buckets that hold the same rows as another one, told by 128 bits and the count."""
    prints = [F.bit_xor(F.xxhash64("class", "less", F.lit(i))).alias(f"print{i}") for i in range(2)]
    digests = rows.groupBy("sig").agg(*prints, F.count("*").alias("held"))
    return rows.join(digests.groupBy("print0", "print1", "held").agg(F.min("sig").alias("sig")).select("sig"), "sig", "left_semi")


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The class pairs ``a, b`` that ``sketches(class, size, sketch)`` don't rule out."""
    def run(_, a, b, size_a, size_b, of_a, of_b):
        x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, BINS).astype(np.int16) for v in (of_a, of_b))
        close = np.abs(x - y).sum(1, dtype=np.int64) * (100 + percent) <= (np.array(size_a) + np.array(size_b)) * (100 - percent)
        return {"a": pa.array(np.array(a)[close], pa.int64()), "b": pa.array(np.array(b)[close], pa.int64())}

    both = pairs.join(sketches.toDF("a", "size_a", "of_a"), "a").join(sketches.toDF("b", "size_b", "of_b"), "b")
    return _batches(both.select("a", "b", "size_a", "size_b", "of_a", "of_b"), run, "a long, b long")


KEYS = ["sig", "chunk", "part"]
ROW = [*KEYS, "class", "less", "asks"]


def sketch_blocks(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """The buckets of ``rows(sig, class, less, label)`` cut into blocks, so that no task holds a bucket: rows that are ``held``, rows that ``asks``.

    What is not in the largest component of its bucket asks; the members of that component need not be held against each
    other. In a bucket of one block a row has both parts; in larger ones it is held once for each part of the asking rows
    and asks once in each chunk of the held ones.
    """
    counts = rows.groupBy("sig", "label").agg(F.count("*").alias("of_label"))
    heads = counts.groupBy("sig").agg(F.max_by("label", F.struct("of_label", "label")).alias("major"), F.sum("of_label").alias("held"), (F.sum("of_label") - F.max("of_label")).alias("minors"))
    heads = heads.select("sig", "major", F.ceil(F.col("held") / BLOCK).cast("int").alias("chunks"), F.ceil(F.col("minors") / BLOCK).cast("int").alias("parts"))
    minor = F.col("label") != F.col("major")
    chunk, part = F.pmod(F.xxhash64("class"), "chunks").cast("int"), F.pmod(F.xxhash64("class", F.lit(1)), "parts").cast("int")

    def place(chunk, part, held, asks):
        return F.struct(chunk.alias("chunk"), part.alias("part"), held.alias("held"), asks.alias("asks"))

    yes, no = F.lit(True), F.lit(False)
    holding = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: place(chunk, p, yes, no))
    asking = F.filter(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: place(c, part, no, yes)), lambda _: minor)
    alone = (F.col("chunks") == 1) & (F.col("parts") == 1)
    places = F.when(alone, F.array(place(F.lit(0), F.lit(0), yes, minor))).otherwise(F.concat(holding, asking))
    full = rows.join(heads, "sig").join(sketches, "class")
    return full.select("sig", "class", "less", "label", "size", "sketch", F.inline(places)).select(*ROW, "held", "label", "size", "sketch")


def sketched_pairs(blocks: DataFrame, ahead: DataFrame | None, names: DataFrame, percent: int, count: int) -> DataFrame:
    """``a, b`` and ``ROW, apart, after``: for each asking row the ``count`` nearest rows of other components that sketches don't rule out.

    An asking row goes on behind the place (distance of the sketches, class) that it has reached; ``ahead`` holds the
    asking rows with partners further out and their places, as this function gives them in rows with null ``a, b``. Rows of a block
    in which none is left stay out. What is skipped for its component never comes back, since components only grow. The
    first time, the labels that the blocks were made with hold; then those of ``names``.
    """
    if ahead is None:
        rows = blocks.withColumn("apart", F.lit(-1).cast("long")).withColumn("after", F.lit(0).cast("long"))
    else:
        rows = blocks.join(ahead.select(*KEYS).distinct(), KEYS, "left_semi").join(ahead.select(*ROW, "apart", "after"), ROW, "left")
        rows = rows.withColumn("asks", F.col("apart").isNotNull()).where("held or asks").drop("label")
        rows = rows.join(names.toDF("class", "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))

    def compare(key: tuple, block: pa.Table) -> pa.Table:
        classes, labels, sizes, less, held, asks = (block.column(c).to_numpy() for c in ("class", "label", "size", "less", "held", "asks"))
        found, places = [], []
        if (labels != labels[0]).any():
            bins = np.frombuffer(b"".join(block.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16)
            at, after = block.column("apart").to_pylist(), block.column("after").to_pylist()
            for i in np.flatnonzero(asks):
                fit = np.flatnonzero(held & (labels != labels[i]) & ~(less & less[i]))
                apart = np.abs(bins[fit] - bins[i]).sum(1, dtype=np.int64)
                close = (apart * (100 + percent) <= (sizes[fit] + sizes[i]) * (100 - percent)) & ((apart > at[i]) | ((apart == at[i]) & (classes[fit] > after[i])))
                fit, apart = fit[close], apart[close]
                order = np.lexsort((classes[fit], apart))
                near = classes[fit[order[:count]]]
                found.append(np.stack([np.minimum(near, classes[i]), np.maximum(near, classes[i])]))
                if len(order) > count:
                    last = order[count - 1]
                    places.append((int(classes[i]), bool(less[i]), int(apart[last]), int(classes[fit[last]])))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        none, more = [None] * pairs.shape[1], len(places)
        columns = {c: pa.array([*pairs[i].tolist(), *[None] * more], pa.int64()) for i, c in enumerate(("a", "b"))}
        for c, k, kind in zip(KEYS, key, (pa.int64(), pa.int32(), pa.int32()), strict=True):
            columns[c] = pa.array(none + [k.as_py()] * more, kind)
        for i, (c, kind) in enumerate((("class", pa.int64()), ("less", pa.bool_()), ("apart", pa.int64()), ("after", pa.int64()))):
            columns[c] = pa.array(none + [p[i] for p in places], kind)
        columns["asks"] = pa.array(none + [True] * more, pa.bool_())
        return pa.table(columns)

    schema = "a long, b long, sig long, chunk int, part int, class long, less boolean, apart long, after long, asks boolean"
    return rows.groupBy(*KEYS).applyInArrow(compare, schema)


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """``a, b, linked`` for the class pairs, by comparing the n-gram sets of their texts.

    A pair brings the text of ``b`` alone; that of ``a`` comes once, ahead of its pairs. The pairs of a class that is held
    against many are cut into blocks, so that no task holds them all.
    """
    def run(state, a, b, rows):
        pairs, linked = [], []
        for x, y, text in zip(a, b, rows, strict=True):
            t = ngrams(words_of(text), n)
            if y is None:
                state["name"], state["set"] = x, t
            elif state.get("name") == x:
                s = state["set"]
                both = len(s & t)
                pairs.append((x, y))
                linked.append(100 * both >= percent * (len(s) + len(t) - both))
        if pairs:
            return {"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64()), "linked": pa.array(linked, pa.bool_())}

    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("parts")).where("parts > 1")
    dealt = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    heads = dealt.select("a", "part").distinct().join(texts.toDF("a", "text"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    rows = heads.unionByName(dealt.join(texts.toDF("b", "text"), "b").select("a", "part", "b", "text"))
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return _batches(rows.select("a", "b", "text"), run, "a long, b long, linked boolean")


def renamed(names: DataFrame, links: DataFrame) -> DataFrame:
    """``names(node, label)`` after further ``links(a, b)``: only the labels that these connect are contracted."""
    spark = names.sparkSession
    a, b = names.toDF("a", "of_a"), names.toDF("b", "of_b")
    fresh = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    roots = components(fresh)
    if roots.isEmpty():
        return names
    moved = names.join(roots.toDF("label", "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    return written(spark, moved.unionByName(roots.join(names, "node", "left_anti")), "ngram-names")


def links(docs: DataFrame, classes: DataFrame, n: int, percent: int, dear: int = DEAR) -> tuple[DataFrame, DataFrame]:
    """(``a, b`` verified links between classes that connect what is connected, ``node, label`` components of classes)."""
    spark = docs.sparkSession
    nominated, read = candidates(docs, classes, n, percent, dear)
    nominated = written(spark, nominated.select("sig", class_of().alias("class"), is_less().alias("less")).dropDuplicates(["sig", "class", "less"]), "ngram-candidates")
    dropped(*read)
    rows = written(spark, unlike(nominated), "ngram-unlike")
    dropped(nominated)
    members = rows.select("class").distinct().join(classes, "class")
    held = written(spark, texts_of(docs, members, n), "ngram-texts")
    if not held.groupBy("class").count().where("count > 1").isEmpty():
        again, held = held, written(spark, held.dropDuplicates(["class"]), "ngram-texts-once")
        dropped(again)
    texts = held.select("class", "text")
    done = spark.createDataFrame([], "a long, b long, linked boolean")
    names = spark.createDataFrame([], "node long, label long")
    bucket = Window.partitionBy("sig")

    def ask(pairs: DataFrame) -> None:
        nonlocal done, names
        fresh = written(spark, pairs.join(done.select("a", "b"), ["a", "b"], "left_anti"), "ngram-pairs")
        if fresh.isEmpty():
            return
        found = written(spark, verified(fresh, texts, n, percent), "ngram-verified")
        done = done.unionByName(found)
        names = renamed(names, found.where("linked").select("a", "b"))

    # One member of each bucket, another one in each round, asks the members of other components, as long as that closes buckets.
    sketches = held.select("class", "size", "sketch")
    opened, turns, before = rows.withColumn("label", F.col("class")), 0, None
    while True:
        count = opened.count()
        if before is not None and (not count or count > 0.7 * before):
            break
        before = count
        asking = opened.where(~F.col("less")).groupBy("sig").agg(F.min_by(F.struct("class", "label"), F.xxhash64("class", F.lit(turns))).alias("one"))
        ask(plausible(opened.join(asking, "sig").where("label != one.label").select(F.least("class", "one.class").alias("a"), F.greatest("class", "one.class").alias("b")).distinct(), sketches, percent))
        turns += 1
        named = (opened.select("sig", "class", "less").join(names.toDF("class", "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
                 .withColumn("low", F.min("label").over(bucket)).withColumn("high", F.max("label").over(bucket)).withColumn("held", F.count("*").over(bucket)).where("low != high").drop("low", "high"))
        last, opened = opened, written(spark, named, "ngram-open")
        dropped(last)
    small, large = opened.where(F.col("held") <= SMALL), opened.where(F.col("held") > SMALL)
    one = small.where(~F.col("less")).select("sig", F.col("class").alias("one"), F.col("label").alias("of_one"))
    ask(plausible(small.join(one, "sig").where("label != of_one").select(F.least("class", "one").alias("a"), F.greatest("class", "one").alias("b")).distinct(), sketches, percent))
    if not large.isEmpty():
        blocks = written(spark, sketch_blocks(large, sketches), "ngram-blocks")
        ahead, count = None, 4
        while ahead is None or not ahead.isEmpty():
            found = written(spark, sketched_pairs(blocks, ahead, names, percent, count), "ngram-near")
            ask(found.where("a is not null").select("a", "b").distinct())
            ahead, count = found.where("a is null"), 16 * count
    return done.where("linked").select("a", "b"), names


def grouped(docs: DataFrame, n: int = 5, percent: int = 80, dear: int = DEAR) -> DataFrame:
    """``doc_id, text_key, n_shingles, first`` for every row of ``docs(doc_id, text)``: ``first`` is the smallest (doc_id, text_key)
    of the group that the row's n-grams stand in, null for a row that is in none (without an id or without words)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    facts = written(spark, set_facts(docs, n), "ngram-facts")
    usable = facts.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("class", "high", "n_shingles").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    classes = written(spark, classes.withColumn("doc_id", F.col("first.doc_id")), "ngram-classes")
    _, names = links(docs.where(F.col("doc_id").isNotNull()), classes.select("class", "doc_id"), n, percent, dear)
    smallest = names.join(classes, names["node"] == classes["class"]).groupBy("label").agg(F.min("first").alias("least"))
    merged = names.join(smallest, "label").select(F.col("node").alias("class"), "least")
    own = classes.join(merged, "class", "left").select("class", "high", "n_shingles", F.coalesce("least", "first").alias("first"))
    return (facts.join(own, ["class", "high", "n_shingles"], "left")
            .select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first")))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, dear: int = DEAR) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``.

    Two sets link when ``100 * intersection >= percent * union``. ``component_id`` is the smallest doc_id reachable by links. A text
    with fewer than ``n`` words is one n-gram; without words, or null, it is empty and linked with nothing. A null doc_id
    is linked with nothing and its component is null; repeated rows are returned each; other columns are ignored.
    """
    return grouped(docs, n, percent, dear).select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))
