"""Language identification by unigram models that sum over all segmentations.

A fixed public vocabulary of pieces gives, per language, a probability of each piece. The probability of a word is
the sum over all ways of cutting it into pieces, found by a forward pass; training is expectation-maximisation with
the matching backward pass. Words are independent, so a text costs one look-up per word once a word is known.
"""

from __future__ import annotations

import functools
import weakref
from collections import defaultdict
from dataclasses import dataclass, replace

import numpy as np
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import map_columns
from foliospark.sources.scratch import written

LETTERS = regex.compile(r"\p{L}+").findall
START = "▁"
#: Bounds of the fit: documents per language (smallest id hashes), words per language (most frequent), word length; and the
#: number of languages from which training is refused (the table grows with it).
MAX_DOCS, MAX_WORDS, MAX_LENGTH, MAX_LANGUAGES = 1500, 30_000, 24, 1024
#: Buckets into which a language is dealt before its sample is cut.
SALTS = 256
ROUNDS = 4
SMOOTHING = 0.05
#: Words and bytes of the cache of a scorer.
CACHED, CACHE_BYTES = 200_000, 1 << 27


#: Multiplier of the rolling hash of pieces (an odd 64-bit constant).
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def pieces_of(path: str) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """The number of pieces made of letters (and the word start), and per length their sorted hashes with their numbers; number 0 is any other letter."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = {p for i in range(model.get_piece_size()) if (p := model.id_to_piece(i)).replace(START, "", 1).isalpha() or p == START} - {""}
    groups = defaultdict(list)
    for n, p in enumerate(sorted(p for p in names if p == p.lower()), 1):
        groups[len(p)].append((n, p))
    tables = []
    for size in range(1, max(groups) + 1):
        members = groups[size]
        hashes = substring_hashes(codes_of([p for _, p in members], size), size)[:, 0]
        order = np.argsort(hashes)
        tables.append((hashes[order], np.array([n for n, _ in members], np.int32)[order]))
    return sum(map(len, groups.values())), tables


def codes_of(words: list[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), size).astype(np.uint64)


def substring_hashes(codes: np.ndarray, size: int, shorter: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all substrings of ``size`` characters; from those one shorter if given."""
    if shorter is not None:
        return shorter[:, :codes.shape[1] - size + 1] * MULTIPLIER + codes[:, size - 1:]
    out = np.zeros((len(codes), codes.shape[1] - size + 1), np.uint64)
    for k in range(size):
        out = out * MULTIPLIER + codes[:, k:codes.shape[1] - size + 1 + k]
    return out


def lattices(words: list[str], path: str):
    """Words grouped by length: (positions in ``words``, piece number for each word, end and piece length, or -1)."""
    _, tables = pieces_of(path)
    groups = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w) + 1].append(i)
    for size, members in groups.items():
        for at in range(0, len(members), 4096):
            some = members[at:at + 4096]
            codes = codes_of([START + words[i] for i in some], size)
            lattice = np.full((len(some), size, min(len(tables), size)), -1, np.int32)
            hashes = None
            for length, (known, numbers) in enumerate(tables[:size], 1):
                hashes = substring_hashes(codes, length, hashes)
                if len(known):
                    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    lattice[:, length - 1:, length - 1] = np.where(known[place] == hashes, numbers[place], -1)
            lattice[:, :, 0] = np.maximum(lattice[:, :, 0], 0)
            yield np.array(some), lattice


def forward(lattice: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log probability of each word under each language. ``table``: one row per piece, a last row of zeros for none.

    Recent prefix sums are kept in a window and rescaled as they go, so the length of a word is not limited.
    """
    count, size, width = lattice.shape
    recent = np.zeros((width, count, table.shape[1]))
    recent[0] = 1
    log = np.zeros((count, table.shape[1]))
    for end in range(size):
        total = np.zeros((count, table.shape[1]))
        for k in range(min(end + 1, width)):
            total += recent[k] * table[lattice[:, end, k]]
        recent[1:] = recent[:-1]
        recent[0] = total
        if end % 4 == 3:
            recent /= total
            log += np.log(total)
    return log + np.log(recent[0])


def expected_counts(lattice: np.ndarray, table: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece per language, for words with ``weights`` (words x languages), by forward and backward sums."""
    lattice = np.where(lattice < 0, len(table) - 1, lattice)
    count, size, width = lattice.shape
    ahead, behind = np.zeros((size + 1, count, table.shape[1])), np.zeros((size + 1, count, table.shape[1]))
    ahead[0] = behind[size] = 1
    for end in range(1, size + 1):
        for k in range(min(end, width)):
            ahead[end] += ahead[end - 1 - k] * table[lattice[:, end - 1, k]]
    for end in range(size, 0, -1):
        for k in range(min(end, width)):
            behind[end - 1 - k] += behind[end] * table[lattice[:, end - 1, k]]
    share = weights / ahead[size]
    out = np.zeros_like(table)
    for end in range(1, size + 1):
        for k in range(min(end, width)):
            used = lattice[:, end - 1, k]
            amount = ahead[end - 1 - k] * table[used] * behind[end] * share
            for lang in range(table.shape[1]):
                out[:, lang] += np.bincount(used, amount[:, lang], len(table))
    return out


@dataclass
class Model:
    """Languages in order and the probability table; the vocabulary is found again by its path."""

    languages: list[str]
    table: np.ndarray
    vocabulary: str


class Scorer:
    """Scores texts; log probabilities of the words seen last are kept, up to ``CACHED`` words and ``CACHE_BYTES``."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.cached = min(CACHED, CACHE_BYTES // (8 * max(1, len(model.languages))))
        self.values = np.zeros((self.cached, len(model.languages)))

    def learn(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.model.languages)))
        for members, lattice in lattices(words, self.model.vocabulary):
            out[members] = forward(lattice, self.model.table)
        return out

    def totals(self, words: list[str]) -> np.ndarray:
        """Sum of the log probabilities of the words, per language."""
        new = list({w for w in words if w not in self.known})
        if len(new) + len(self.known) > self.cached:
            self.known.clear()
            new = list(set(words))
        total = np.zeros(len(self.model.languages))
        if len(new) > self.cached:
            for at in range(0, len(words), self.cached):
                total += self.learn(words[at:at + self.cached]).sum(0)
            return total
        if new:
            base = len(self.known)
            self.values[base:base + len(new)] = self.learn(new)
            self.known.update(zip(new, range(base, base + len(new)), strict=True))
        return self.values[list(map(self.known.__getitem__, words))].sum(0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [LETTERS((t or "").lower()) for t in texts]
        if self.model.languages:
            fresh = list({w for words in split for w in words if w not in self.known})
            if len(fresh) + len(self.known) <= self.cached and fresh:
                self.totals(fresh)
        names, scores = [], []
        for words in split:
            if not words or not self.model.languages:
                names.append("und")
                scores.append(0.0)
                continue
            total = self.totals(words)
            chance = np.exp(total - total.max())
            best = int(chance.argmax())
            names.append(self.model.languages[best])
            scores.append(float(chance[best] / chance.sum()))
        return names, scores


_scorers: dict[int, Scorer] = {}


def shared_scorer(model: Model) -> Scorer:
    """The scorer of a model in this process. It goes with the model, which a task unpickles anew, so that no word cache stays in a worker for later stages."""
    if id(model) not in _scorers:
        _scorers.clear()
        _scorers[id(model)] = Scorer(replace(model))
        weakref.finalize(model, _scorers.pop, id(model), None)
    return _scorers[id(model)]


def first_of(rows: DataFrame, per: str, salted_by: str, order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows of each value of ``per``: cut in ``SALTS`` buckets of it, then among what these leave, so that a task sorts no whole group."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(salted_by, F.lit(1)), F.lit(SALTS)))
    for keys in ([per, "salt"], [per]):
        salted = salted.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)
    return salted.drop("salt", "place")


def train(spark: SparkSession, docs: DataFrame, may_learn: Column, vocabulary: str, max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS, max_languages: int = MAX_LANGUAGES) -> Model:
    """Fit on rows of ``docs(doc_id, text, lang)`` for which ``may_learn`` holds and ``lang`` is not null.

    The sample is bounded: per language the ``max_docs`` documents with the smallest id hashes, of these the
    ``max_words`` most frequent words of at most ``MAX_LENGTH`` letters. Spark counts the words; only the counts reach the
    driver. Every language is learnt; more than ``max_languages`` of them are an error.
    """
    rows = docs.where(may_learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    many = rows.select("lang").distinct().limit(max_languages + 1).count()
    if many > max_languages:
        raise ValueError(f"more than {max_languages} languages to learn; raise max_languages if these are languages")
    # Broadcast below: at most max_docs rows of two columns for each of the languages counted above.
    ids = first_of(rows, "lang", "doc_id", [F.xxhash64("doc_id"), "doc_id"], max_docs).dropDuplicates(["doc_id", "lang"])

    def words(langs, texts):
        out = [(lang, w) for lang, t in zip(langs, texts, strict=True) for w in LETTERS((t or "").lower()) if len(w) <= MAX_LENGTH]
        return {"lang": [x[0] for x in out], "word": [x[1] for x in out]}

    pairs = map_columns(docs.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text"), words, "lang string, word string")
    counts = pairs.groupBy("lang", "word").agg(F.count("*").alias("n"))
    top = first_of(counts, "lang", "word", [F.desc("n"), "word"], max_words)
    found = written(spark, top.select("lang", "word", "n"), "language-words").orderBy("word", "lang").collect()
    languages = sorted({r["lang"] for r in found})
    return Model(languages, fit(found, languages, vocabulary), vocabulary)


def fit(counts, languages: list[str], vocabulary: str, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities by expectation-maximisation over rows (lang, word, n), from a uniform start.

    Languages don't depend on each other, so each is fitted over its own words alone and memory is that of one.
    """
    rows = pieces_of(vocabulary)[0] + 1
    words: dict[str, list] = {x: [] for x in languages}
    for r in counts:
        words[r["lang"]].append((r["word"], r["n"]))
    table = np.zeros((rows + 1, len(languages)))
    for at, language in enumerate(languages):
        amounts = np.array([[n] for _, n in words[language]], float)
        groups = list(lattices([w for w, _ in words[language]], vocabulary))
        column = np.full((rows + 1, 1), 1 / rows)
        column[-1] = 0
        for _ in range(rounds):
            used = np.zeros_like(column)
            for members, lattice in groups:
                used += expected_counts(lattice, column, amounts[members])
            used[-1] = 0
            column = used + SMOOTHING
            column[-1] = 0
            column /= column.sum(0)
        table[:, at] = column[:, 0]
    return table


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs(doc_id, text)``: the likeliest language and its posterior under equal priors.

    A null text, or one without a letter, is ``und`` with score 0, as is everything if nothing was learnt. Ties go to
    the language first in order. Repeated rows repeat their result; other columns are ignored. One narrow pass.
    """
    def run(ids, texts):
        names, scores = shared_scorer(model).predict(texts)
        return {"doc_id": ids, "lang_pred": names, "score": scores}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")
