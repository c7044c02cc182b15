"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Pieces are dealt by hash into blocks of bounded size. Each block is evolved on several islands: a chromosome is a
division of the block into bins; crossover injects whole well-filled bins of one parent into the other, removes the
bins that hold duplicates, and puts the displaced pieces back by best fit, longest first. Islands send their elite to
their neighbour between epochs. Bins that are filled are closed; the pieces of the others go to the next level, where
fewer blocks mix them anew, until one block is left.
"""

from __future__ import annotations

import base64
import functools
import random
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliospark.llm.common import map_columns
from foliospark.sources.scratch import written

CAPACITY = 2048
#: Pieces per block, islands per block, epochs, members per island, children per epoch.
BLOCK, ISLANDS, EPOCHS, MEMBERS, CHILDREN = 4096, 2, 2, 3, 4
#: Free tokens up to which a bin counts as filled.
SLACK = 1
END = 0


#: Blanks in a row from which the spare tokenizer is used.
BLANKS = 100_000
LONG_BLANKS = re.compile(rf"\s{{{BLANKS}}}")


@functools.cache
def spare_encoder(path: str, plain: bool) -> Tokenizer:
    """Tokenizer of a JSON file; with ``plain`` the special strings are ordinary text."""
    out = Tokenizer.from_file(path)
    out.encode_special_tokens = plain
    out.no_truncation()
    out.no_padding()
    return out


@functools.cache
def encoder(path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> tiktoken.Encoding:
    """Byte-level tokenizer over a file of ranks, with the given special strings."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


@dataclass(frozen=True)
class Tokens:
    """Where the vocabulary lies and how text is cut before merging.

    ``spare`` is the same vocabulary as a file of the other library, for texts with runs of blanks that the first one can't cut.
    """

    path: str
    pattern: str
    special: tuple[tuple[str, int], ...] = ()
    spare: str | None = None

    def ids(self, text: str) -> np.ndarray:
        if self.spare and len(text) > BLANKS and LONG_BLANKS.search(text):
            return np.array(spare_encoder(self.spare, not self.special).encode(text, add_special_tokens=False).ids, "<u4")
        return encoder(self.path, self.pattern, self.special).encode_to_numpy(text, allowed_special="all").astype("<u4")


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole capacities, with the remainder first."""
    first = length % capacity
    starts = ([(0, first)] if first else []) + [(s, capacity) for s in range(first, length, capacity)]
    return starts


def ids_bytes(ids: np.ndarray) -> bytes:
    return ids.tobytes()


def ids_crc32(ids: np.ndarray) -> int:
    """CRC-32 of the ids as unsigned little-endian 32-bit numbers."""
    return zlib.crc32(ids.tobytes())


def token_pieces(docs: DataFrame, tokens: Tokens, capacity: int = CAPACITY, payload: Callable[[np.ndarray], object] = ids_bytes, payload_type: str = "binary") -> DataFrame:
    """``doc_id, piece, start, length, payload``: the tokens of each row, ended by ``END``, cut into pieces.

    ``payload`` is computed from the ids of a piece, by default the ids themselves as little-endian 32-bit numbers; a
    caller that only wants a digest passes one and moves less.
    """
    def run(ids, texts):
        out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "payload")}
        for doc, text in zip(ids, texts, strict=True):
            coded = np.append(tokens.ids(text or ""), np.uint32(END)).astype("<u4")
            for n, (start, length) in enumerate(cut(len(coded), capacity)):
                for c, v in zip(out, (doc, n, start, length, payload(coded[start:start + length])), strict=True):
                    out[c].append(v)
        return out

    return map_columns(docs.select("doc_id", "text"), run,
                       f"doc_id long, piece int, start long, length long, payload {payload_type}")


class Bins:
    """Open bins by free room; the fitting bin with the least room is the lowest set bit above the length."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add_bin(self, items: list[int], used: int) -> None:
        room = self.capacity - used
        self.bins.append(items)
        self.room.append(room)
        self._file(len(self.bins) - 1, room)

    def _file(self, b: int, room: int) -> None:
        if room:
            self.by_room[room].append(b)
            self.mask |= 1 << room

    def put(self, item: int, length: int) -> None:
        fitting = self.mask >> length
        if not fitting:
            self.add_bin([item], length)
            return
        room = length + (fitting & -fitting).bit_length() - 1
        stack = self.by_room[room]
        b = stack.pop()
        if not stack:
            self.mask ^= 1 << room
        self.bins[b].append(item)
        self.room[b] = room - length
        self._file(b, room - length)


def best_fit(items, lengths: list[int], capacity: int, bins: Bins | None = None) -> Bins:
    bins = bins or Bins(capacity)
    for i in items:
        bins.put(i, lengths[i])
    return bins


def fitness(packing: list[list[int]], lengths: list[int], capacity: int) -> float:
    """Fewer bins first, then the mean square of the fill, which prefers full bins next to nearly empty ones."""
    return -len(packing) + sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in packing) / max(1, len(packing))


def crossover(one: list[list[int]], other: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """``one`` with half of the well-filled bins of ``other`` injected; bins with duplicates go, their other pieces are placed by best fit."""
    filled = [b for b in other if capacity - sum(lengths[i] for i in b) <= max(SLACK, capacity // 256)]
    injected = [b for b in filled if rng.random() < 0.5]
    taken = {i for b in injected for i in b}
    bins, displaced = Bins(capacity), []
    for b in injected:
        bins.add_bin(list(b), sum(lengths[i] for i in b))
    worst = rng.random() * 0.1
    for b in one:
        used = sum(lengths[i] for i in b)
        if any(i in taken for i in b) or (used < capacity - SLACK and rng.random() < worst + 1 - used / capacity):
            displaced += [i for i in b if i not in taken]
        else:
            bins.add_bin(list(b), used)
    displaced.sort(key=lambda i: (-lengths[i], i))
    return best_fit(displaced, lengths, capacity, bins).bins


def first_members(lengths: list[int], capacity: int, members: int, rng: random.Random) -> list[list[list[int]]]:
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    out = [best_fit(order, lengths, capacity).bins]
    while len(out) < members:
        noisy = sorted(order, key=lambda i: -lengths[i] * rng.uniform(0.8, 1.0))
        out.append(best_fit(noisy, lengths, capacity).bins)
    return out


def evolve(population: list[list[list[int]]], lengths: list[int], capacity: int, members: int, children: int, rng: random.Random) -> list[list[list[int]]]:
    """The best ``members`` after ``children`` crossovers; stops once no packing can use fewer bins and none is left to improve."""
    least = -(-sum(lengths) // capacity)
    scored = sorted(((fitness(p, lengths, capacity), n, p) for n, p in enumerate(population)), key=lambda x: (-x[0], x[1]))
    for n in range(children):
        open_bins = sum(capacity - sum(lengths[i] for i in b) > SLACK for b in scored[0][2])
        if len(scored[0][2]) == least and open_bins <= 1 or len(scored) < 2:
            break
        one, other = rng.sample(range(len(scored)), 2)
        child = crossover(scored[min(one, other)][2], scored[max(one, other)][2], lengths, capacity, rng)
        scored.append((fitness(child, lengths, capacity), len(population) + n, child))
        scored = sorted(scored, key=lambda x: (-x[0], x[1]))[:members]
    return [p for _, _, p in scored]


def _coded(packing: list[list[int]], count: int) -> bytes:
    bin_of = np.zeros(count, "<i4")
    for n, b in enumerate(packing):
        bin_of[b] = n
    return bin_of.tobytes()


def _decoded(data: bytes) -> list[list[int]]:
    bin_of = np.frombuffer(data, "<i4")
    out: list[list[int]] = [[] for _ in range(int(bin_of.max()) + 1)]
    for i, b in enumerate(bin_of.tolist()):
        out[b].append(i)
    return [b for b in out if b]


STATE = "block long, island int, keys binary, lengths binary, members array<binary>"
PLACED = "key long, length int, block long, bin int, offset long, used long"


def _seeded(block, island, epoch) -> random.Random:
    return random.Random(int(block) * 1_000_003 + int(island) * 1009 + int(epoch))


def pack_blocks(items: DataFrame, blocks: int, level: int, capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS, members: int = MEMBERS, children: int = CHILDREN) -> DataFrame:
    """Pack ``items(key, length)`` in ``blocks`` blocks; returns ``PLACED``. A group holds one block, whatever its hottest key."""
    def outgoing(block, island, epoch, keys, lengths, population):
        """Rows for the next epoch: the population stays, its elite travels to the next island."""
        sizes = lengths.tolist()
        grown = evolve(population, sizes, capacity, members, children, _seeded(block, island, epoch))
        coded = [_coded(p, len(sizes)) for p in grown]
        rows = [(block, island, keys.astype("<i8").tobytes(), lengths.astype("<i4").tobytes(), coded)]
        if islands > 1:
            rows.append((block, (island + 1) % islands, b"", b"", coded[:1]))
        return pd.DataFrame(rows, columns=["block", "island", "keys", "lengths", "members"])

    def start(key, group: pd.DataFrame) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        group = group.sort_values("key")
        keys, lengths = group["key"].to_numpy("i8"), group["length"].to_numpy("i4")
        return outgoing(block, island, 0, keys, lengths, first_members(lengths.tolist(), capacity, members, _seeded(block, island, -1)))

    def step(epoch):
        def run(key, group: pd.DataFrame) -> pd.DataFrame:
            own = group[group["keys"].map(len) > 0].iloc[0]
            keys, lengths = np.frombuffer(own["keys"], "<i8"), np.frombuffer(own["lengths"], "<i4")
            population = [_decoded(m) for ms in group["members"] for m in ms]
            return outgoing(int(key[0]), int(key[1]), epoch, keys, lengths, population)
        return run

    def finish(key, group: pd.DataFrame) -> pd.DataFrame:
        block = int(key[0])
        own = group[group["keys"].map(len) > 0].sort_values("island").iloc[0]
        keys, lengths = np.frombuffer(own["keys"], "<i8"), np.frombuffer(own["lengths"], "<i4").tolist()
        best = max((_decoded(m) for ms in group.sort_values("island")["members"] for m in ms), key=lambda p: fitness(p, lengths, capacity))
        bin_of, offset, used = np.zeros(len(keys), "i4"), np.zeros(len(keys), "i8"), np.zeros(len(keys), "i8")
        for n, b in enumerate(best):
            sizes = np.array([lengths[i] for i in b])
            bin_of[b], offset[b], used[b] = n, np.cumsum(sizes) - sizes, sizes.sum()
        return pd.DataFrame({"key": keys, "length": lengths, "block": block, "bin": bin_of, "offset": offset, "used": used})

    dealt = items.select("key", "length", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(blocks)).alias("block"))
    state = (dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
             .groupBy("block", "island").applyInPandas(start, STATE))
    for epoch in range(1, epochs):
        state = state.groupBy("block", "island").applyInPandas(step(epoch), STATE)
    return state.groupBy("block").applyInPandas(finish, PLACED)


def pack(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """``key, sequence_id, offset`` for ``items(key, length)`` with distinct keys from 0 and lengths from 1 to ``capacity``.

    Full pieces are sequences of their own. Levels go through written tables, so a lost executor repeats one level at
    most. Each level but the last closes at least half of its pieces, so there are few levels.
    """
    spark = items.sparkSession
    whole = items.where(F.col("length") == capacity).select("key", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts, left, level = [whole], items.where(F.col("length") < capacity), 0
    count = left.count()
    while count:
        blocks = -(-count // block)
        placed = written(spark, pack_blocks(left, blocks, level, capacity), "packing-level")
        last, least = blocks == 1, capacity - SLACK
        still = placed.where(F.col("used") < least).count()
        if not last and still * 2 > count:  # few bins are filled: the fuller half is closed instead
            least = placed.agg(F.percentile_approx("used", 0.5)).first()[0]
            still = placed.where(F.col("used") < least).count()
        closed = placed if last else placed.where(F.col("used") >= least)
        number = F.shiftleft(F.lit(level).cast("long"), 50) + F.shiftleft("block", 16) + F.col("bin")
        parts.append(closed.select("key", number.alias("sequence_id"), "offset"))
        if last:
            break
        left, count, level = placed.where(F.col("used") < least).select("key", "length"), still, level + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pack_documents(docs: DataFrame, tokens: Tokens, capacity: int = CAPACITY, payload: Callable[[np.ndarray], object] = ids_bytes, payload_type: str = "binary") -> DataFrame:
    """``doc_id, piece, start, length, payload, sequence_id, offset`` for every piece of every row of ``docs(doc_id, text)``.

    A null or empty text is the end token alone. Repeated rows are packed each; a null id stays null; other columns are
    ignored; an empty table gives no rows. Documents are tokenised once: their pieces lie in a written table.
    """
    spark = docs.sparkSession
    pieces = written(spark, token_pieces(docs, tokens, capacity, payload, payload_type).withColumn("key", F.monotonically_increasing_id()), "packing-pieces")
    placed = pack(pieces.select("key", "length"), capacity)
    return pieces.join(placed, "key").select("doc_id", "piece", "start", "length", "payload", "sequence_id", "offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed token sequences, from ``pack_documents`` with its default payload."""
    def run(key, group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("offset").to_pylist(), group.column("payload").to_pylist(), strict=True))
        ids = np.frombuffer(b"".join(b for _, b in rows), "<u4").astype("i4")
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int32()))})

    return pieces.select("sequence_id", "offset", "payload").groupBy("sequence_id").applyInArrow(run, "sequence_id long, ids array<int>")
