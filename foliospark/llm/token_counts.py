"""Edit-aware token counts.

A document keeps a segment tree over blocks of its pre-tokens: each block knows its characters and tokens, inner nodes
hold sums. An edit finds the touched blocks by descending the character sums, cuts only the touched region plus boundary
context into pre-tokens again, and updates the sums on the way up. Pre-tokens are found from left to right and look at
most three characters ahead, so cutting may start at the last pre-token that ends three characters before the edit and may stop
as soon as it meets an old boundary behind it: from there on the old cuts are the new ones.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.binding import let_all
from foliospark.llm.common import map_columns
from foliospark.llm.packing import BLANKS, encoder, spare_encoder

BLOCK = 64
LOOKAHEAD = 3
CACHED = 300_000


@dataclass(frozen=True)
class Counter:
    """Where the ranks of the vocabulary lie and how text is cut into pre-tokens; ``spare`` is the vocabulary for very long runs of blanks."""

    path: str
    pattern: str
    spare: str | None = None


class PieceCounts:
    """Number of tokens of a pre-token; the last ``CACHED`` answers are kept."""

    def __init__(self, counter: Counter):
        self.encode = encoder(counter.path, counter.pattern, ()).encode_ordinary
        self.cut = regex.compile(counter.pattern)
        self.known: dict[str, int] = {}
        self.spare = counter.spare

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if self.spare and len(piece) > BLANKS and piece.isspace():
                return len(spare_encoder(self.spare, True).encode(piece, add_special_tokens=False).ids)
            n = len(self.encode(piece))
            if len(self.known) >= CACHED:
                self.known.clear()
            if len(piece) < 64:
                self.known[piece] = n
        return n

    def all(self, pieces: list[str]) -> list[int]:
        known = self.known
        for p in pieces:
            if p not in known:
                self(p)
        return [known[p] if p in known else self(p) for p in pieces]


@functools.cache
def piece_counts(counter: Counter) -> PieceCounts:
    return PieceCounts(counter)


class TokenTree:
    """Segment tree over the pre-tokens of one text; ``total`` is its token count, ``recounted`` the pre-tokens cut again by edits."""

    def __init__(self, text: str, counts: PieceCounts):
        self.text, self.counts, self.recounted = text, counts, 0
        pieces = counts.cut.findall(text)
        tokens = counts.all(pieces)
        sizes = list(map(len, pieces))
        self.blocks = [(sizes[i:i + BLOCK], tokens[i:i + BLOCK]) for i in range(0, len(pieces), BLOCK)] or [([], [])]
        self.base = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for i, (s, t) in enumerate(self.blocks):
            self.chars[self.base + i], self.tokens[self.base + i] = sum(s), sum(t)
        for i in range(self.base - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def block_at(self, position: int) -> tuple[int, int]:
        """(block that holds the character, position of its first character); the last filled block for the end of the text."""
        node, before = 1, 0
        while node < self.base:
            left = self.chars[2 * node]
            if position - before < left or self.chars[2 * node + 1] == 0:
                node *= 2
            else:
                before += left
                node = 2 * node + 1
        return node - self.base, before

    def edit(self, start: int, length: int, insert: str) -> None:
        """Replace ``length`` characters from ``start`` (both cut to the text) by ``insert``."""
        start = max(0, min(start, len(self.text)))
        length = max(0, min(length, len(self.text) - start))
        safe = max(0, start - LOOKAHEAD)
        first, at = self.block_at(safe)
        sizes = self.blocks[first][0]
        keep = 0
        while keep < len(sizes) and at + sizes[keep] <= safe:
            at += sizes[keep]
            keep += 1
        text = self.text[:start] + insert + self.text[start + length:]
        shift = len(insert) - length
        # Old boundaries are read on demand, from the region's start to the first one that a new boundary meets.
        last, old, k = first, at, keep
        pieces: list[str] = []
        position = at
        match = self.counts.cut.match
        while True:
            while old + shift < position or old < start + length:
                while k >= len(self.blocks[last][0]):
                    if last + 1 >= len(self.blocks):
                        break
                    last, k = last + 1, 0
                if k >= len(self.blocks[last][0]):
                    break
                old += self.blocks[last][0][k]
                k += 1
            if position >= len(text) or (position == old + shift and old >= start + length and position >= start + len(insert)):
                break
            found = match(text, position)
            pieces.append(found.group())
            position = found.end()
        if position >= len(text):
            last, k = len(self.blocks) - 1, len(self.blocks[-1][0])
        self.recounted += len(pieces)
        sizes_new = list(map(len, pieces))
        counted = self.counts.all(pieces)
        rest = self.blocks[last]
        merged = (sizes[:keep] + sizes_new + rest[0][k:], self.blocks[first][1][:keep] + counted + rest[1][k:])
        self.text = text
        for b in range(first, last + 1):
            self._set(b, merged if b == first else ([], []))

    def _set(self, block: int, content: tuple[list[int], list[int]]) -> None:
        self.blocks[block] = content
        node = self.base + block
        chars, tokens = sum(content[0]) - self.chars[node], sum(content[1]) - self.tokens[node]
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2


EDITS = "array<struct<start:int,length:int,insert:string>>"


def count_with_edits(docs: DataFrame, edits: Column, counter: Counter) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens, n_edits, n_tokens_edited, n_recounted`` for every row of ``docs(doc_id, text)``.

    ``edits`` is an array of (start, length, insert) over the row, applied one after the other, each to the text as the
    former ones left it; positions are code points and are cut to the text; a null insert is empty, a null list is no
    edit. A null text counts as empty. Special strings count as ordinary text. Repeated rows repeat their result; other
    columns are ignored. One narrow pass; a tree lives as long as its document is in hand.
    """
    def run(ids, texts, lists):
        counts = piece_counts(counter)
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_pretokens", "n_tokens", "n_edits", "n_tokens_edited", "n_recounted")}
        for doc, text, wanted in zip(ids, texts, lists, strict=True):
            tree = TokenTree(text or "", counts)
            before, pieces, done = tree.total, sum(len(b[0]) for b in tree.blocks), 0
            for e in wanted or []:
                if e is not None:
                    tree.edit(e["start"] or 0, e["length"] or 0, e["insert"] or "")
                    done += 1
            for c, v in zip(out, (doc, pieces, before, done, tree.total, tree.recounted), strict=True):
                out[c].append(v)
        return out

    return map_columns(docs.select("doc_id", "text", edits.cast(EDITS).alias("edits")), run,
                       "doc_id long, n_pretokens long, n_tokens long, n_edits long, n_tokens_edited long, n_recounted long")


def replacements(text: Column, pattern: str, insert: str) -> Column:
    """Edits that replace every match of the pattern, last match first so that earlier positions stay true.

    Built-in functions only: positions are running sums over the lengths of the pieces between matches.
    """
    text = F.coalesce(text, F.lit(""))

    def edits(v: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            here = acc["at"] + F.length(F.get(v["between"], i))
            size = F.length(F.get(v["found"], i))
            edit = F.struct(here.alias("start"), size.alias("length"), F.lit(insert).alias("insert"))
            return F.struct((here + size).cast("int").alias("at"), F.concat(F.array(edit), acc["edits"]).cast(EDITS).alias("edits"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(EDITS).alias("edits"))
        return F.when(F.size(v["found"]) > 0, F.aggregate(F.sequence(F.lit(0), F.size(v["found"]) - 1), start, step)["edits"]).otherwise(F.array().cast(EDITS))

    return let_all(edits, found=F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), between=F.split(text, pattern, -1))
