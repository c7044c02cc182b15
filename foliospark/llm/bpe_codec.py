"""Byte-pair encoding and decoding with a heap of merge ranks over a doubly linked symbol list.

The vocabulary is a public tokenizer file (JSON: words end in ``</w>``, lower case, white space dropped).
Spark deals the documents; each Python worker keeps the vocabulary and a bounded cache of encoded words.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from array import array

import regex
from pyspark.sql import DataFrame

from foliospark.llm.common import int_lists, map_columns

#: Unicode white space (fixed values of the White_Space property), and the part of it that ``str.split`` sees differently.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ODD = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+"
CACHED = 300_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def merge_symbols(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge neighbouring symbols, lowest rank first and leftmost among equals, until no pair has a rank.

    Symbols form a doubly linked list by position; the heap holds (rank, position, pair). An entry whose pair no
    longer stands at its position is stale and skipped.
    """
    count = len(symbols)
    if count < 2:
        return symbols
    symbols = list(symbols)
    after, before = list(range(1, count + 1)), list(range(-1, count - 1))
    heap = [(ranks[pair][0], i, pair) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if pair in ranks]
    heapq.heapify(heap)
    gone = -1
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != pair[0] or j >= count or symbols[j] != pair[1]:
            continue
        symbols[i], symbols[j] = ranks[pair][1], gone
        k = after[i] = after[j]
        if k < count:
            before[k] = i
            if (right := (symbols[i], symbols[k])) in ranks:
                heapq.heappush(heap, (ranks[right][0], i, right))
        h = before[i]
        if h >= 0 and (left := (symbols[h], symbols[i])) in ranks:
            heapq.heappush(heap, (ranks[left][0], h, left))
    return [s for s in symbols if s != gone]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): (i, self.vocab[a + b]) for i, (a, b) in enumerate(merges)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.specials.items()]}
        self.letters = byte_letters()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")").split if self.specials else None
        self.words_of = regex.compile(WORDS).findall
        self.chunks_of = regex.compile(f"[^{WHITE}]+").findall
        self.odd_white = regex.compile(ODD).search
        self.words: dict[str, list[int]] = {}
        self.chunks: dict[str, array] = {}

    def word(self, word: str) -> list[int]:
        """Ids of one word after lower-casing; symbols outside the vocabulary are dropped, as there is no unknown token."""
        found = self.words.get(word)
        if found is None:
            letters = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
            letters[-1] += self.suffix
            found = merge_symbols([self.vocab[x] for x in letters if x in self.vocab], self.ranks)
            if len(self.words) >= CACHED:
                self.words.clear()
            if len(word) < 64:
                self.words[word] = found
        return found

    def chunk(self, chunk: str) -> array:
        """Ids of a run of non-white characters. Normal form and letter case never look across white space."""
        found = self.chunks.get(chunk)
        if found is None:
            normal = unicodedata.normalize("NFC", chunk)
            lower = "".join(map(str.lower, normal)) if "Σ" in normal else normal.lower()
            found = array("i", [i for w in self.words_of(lower) for i in self.word(w)])
            if len(self.chunks) >= CACHED:
                self.chunks.clear()
            if len(chunk) < 64:
                self.chunks[chunk] = found
        return found

    def encode(self, text: str) -> array:
        out = array("i")
        for part in self.split_special(text) if self.split_special else [text]:
            special = self.specials.get(part)
            if special is not None:
                out.append(special)
                continue
            get = self.chunks.get
            for c in self.chunks_of(part) if self.odd_white(part) else part.split():
                found = get(c)
                out.extend(self.chunk(c) if found is None else found)
        return out

    def decode(self, ids) -> str:
        """Vocabulary strings of the ids, special ones included, joined by spaces: the file names no decoder."""
        return " ".join(map(self.strings.__getitem__, ids))


@functools.cache
def codec(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` for every row of ``docs(doc_id, text)``.

    A null text counts as empty: no ids and an empty decoded text. Repeated rows give repeated results, a null id
    stays null, other columns are ignored. One narrow pass; the cache is bounded by ``CACHED`` entries.
    """
    def run(ids, texts):
        bpe = codec(vocabulary)
        encoded = [bpe.encode(t or "") for t in texts]
        return {"doc_id": ids, "ids": int_lists(encoded), "decoded": [bpe.decode(e) for e in encoded]}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, decoded string")
