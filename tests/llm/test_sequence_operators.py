"""Conversation tries, periodic runs and SimHash links against brute-force versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import conversation_trie, periodic_runs, simhash_join


def plain_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(shingles))


def plain_components(prints, budget=4):
    """{id: smallest id reachable}; prints: (id, fingerprint)."""
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= budget:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(prints):
        groups[top(i)].append(doc)
    return {prints[i][0]: min(groups[top(i)]) for i in range(len(prints))}


def near_texts(rng, count):
    vocabulary = [f"w{i}" for i in range(500)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 60, 300]))] for _ in range(12)]
    out = []
    for _ in range(count):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(" ".join(words))
    return out


def test_fingerprints_equal_the_plain_rule():
    rng = random.Random(5)
    texts = [None, "", " \n\t", "One", "a b c", "A B c d", "Ä É ä b c d e", "x " * 70_000, "\x85 a\x1cb c d e f", *near_texts(rng, 40)]
    assert [simhash_join.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("full", [4096, 7, 2])
def test_simhash_links_equal_all_pairs(spark, full):
    rng = random.Random(full)
    rows = [(7 * i + 3, t) for i, t in enumerate([*near_texts(rng, 220), None, "", "one", "one", "ONE"])]
    docs = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], "doc_id long, text string, fp long, first long, bucket long, label string").repartition(3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_join.near_duplicates(docs, full=full).collect()}
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    linked = plain_components(prints)
    assert got == {i: (f"{p:016x}", linked[i]) for i, p in prints}


@pytest.mark.parametrize(("budget", "full"), [(4, 64), (4, 5), (1, 5), (7, 9)])
def test_simhash_links_of_dense_and_chained_fingerprints(spark, budget, full):
    rng = random.Random(budget * full)
    centre, prints = rng.getrandbits(64), []
    for _ in range(150):
        prints.append(centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1)
    chain = rng.getrandbits(64)
    for k in range(0, 60, 3):
        chain ^= 0b101 << k % 62
        prints.append(chain)
    prints += [rng.getrandbits(64) for _ in range(60)]
    rows = sorted({np.array([p], np.uint64).view(np.int64)[0].item(): None for p in prints})
    df = spark.createDataFrame([(p,) for p in rows], "fp long").repartition(3)
    found = simhash_join.links(df, budget, full).collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= budget for a, b in found)
    parent = {p: p for p in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    want = plain_components([(p, p & (1 << 64) - 1) for p in rows], budget)
    groups = defaultdict(set)
    for p in rows:
        groups[top(p)].add(p)
    assert {p: min(groups[top(p)]) for p in rows} == want


def test_simhash_odd_rows(spark):
    assert simhash_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e"), (None, "lonely words that nobody else has"), (4, "a b c d e"), (4, "a b c d e"), (9, None), (8, "  ")]
    got = sorted(tuple(r) for r in simhash_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("fingerprint", F.coalesce("doc_id", F.lit(-1)), F.coalesce("component_id", F.lit(-1))).collect())
    own = {t: f"{plain_fingerprint(t):016x}" for _, t in rows}
    assert got == sorted([(own["a b c d e"], -1, 4), (own[rows[1][1]], -1, -1), (own["a b c d e"], 4, 4), (own["a b c d e"], 4, 4), ("0" * 16, 9, 8), ("0" * 16, 8, 8)])


def plain_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, m, q) for (s, m), q in out.items()), key=lambda x: (x[0], x[2]))


def run_texts(rng, count):
    out = []
    for k in range(count):
        n = rng.choice([0, 1, 11, 12, 13, 30, 150, 400])
        some = lambda most, letters: [rng.choice(letters) for _ in range(rng.randint(1, most))]
        kind = k % 8
        if kind == 0:
            words = ["a"] * n
        elif kind == 1:
            words = some(300, "ab")
        elif kind == 2:
            words = (["a"] * rng.randint(1, 30) + ["b"]) * 15
        elif kind == 3:
            words, more = ["a"], ["b"]
            while len(words) < n:
                words, more = more + words, words
        elif kind == 4:  # no cubes
            words = ["ab"[i.bit_count() & 1] for i in range(n)]
        elif kind == 5:
            words = some(9, "xyz") + some(60, [f"v{i}" for i in range(90)]) * 6 + ["y"] * 4
        elif kind == 6:  # halves in two touching runs of a shorter period
            words = ["b"] * rng.randint(0, 1) + (["a", "b"] * rng.randint(1, 12) + ["a"]) * 2 + some(3, "ab")
        else:
            words = (some(5, "abc") * rng.randint(1, 8) + some(5, "abc") * rng.randint(1, 8)) * 5
        out.append([w.encode() for w in words])
    return out


@pytest.mark.parametrize(("first", "most"), [(16, 1 << 16), (1, 4), (2, 1 << 16), (4, 8)])
def test_runs_equal_direct_comparison(first, most):
    texts = run_texts(random.Random(first), 80)
    for at in range(0, 80, 20):
        assert periodic_runs.runs_of(texts[at:at + 20], first, most) == [plain_runs(t) for t in texts[at:at + 20]]


def test_runs_of_long_texts():
    rng = random.Random(3)
    period = [b"%d" % rng.randrange(5000) for _ in range(7000)]
    assert periodic_runs.runs_of([[b"z", *period * 5, b"z"], [b"a"] * 60_000]) == [[(1, 35_000, 7000)], [(0, 60_000, 1)]]


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    one, two = rng.integers(0, periodic_runs.P, (2, 3, 64)).astype(np.uint64)
    assert (periodic_runs.transform_back(periodic_runs.transform(one)) == one).all()
    product = periodic_runs.transform_back(periodic_runs._reduced(periodic_runs.transform(one) * periodic_runs.transform(two)))
    want = [sum(int(one[1, i]) * int(two[1, (k - i) % 64]) for i in range(64)) % periodic_runs.P for k in range(64)]
    assert product[1].tolist() == want


def plain_run_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_query_equals_the_plain_rule(spark):
    rng = random.Random(11)
    rows = [(i, b" ".join(w).decode()) for i, w in enumerate(run_texts(rng, 160))]
    rows += [(1000 + i, " ".join(rng.choice(["in", "the", "house", "of", "all"]) for _ in range(rng.randint(0, 90)))) for i in range(60)]
    rows += [(5000, None), (5001, ""), (5002, " \n\t\x0b"), (5003, "\x1c a\x85b " * 20), (None, "so so " * 20), (7, "x " * 12), (7, "x " * 12), (5004, " " * 3_000_000), (5005, "w" * 1_000_000)]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, start long, period string").repartition(4)
    order = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r) for r in periodic_runs.periodic_runs(docs, rewrite=True).collect()), key=order)
    assert got == sorted((plain_run_row(*r) for r in rows), key=order)
    assert periodic_runs.periodic_runs(docs.limit(0), rewrite=True).count() == 0


def plain_tree(rows):
    """Rows of the tree as the rule says them, from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0, role or ""), (role or "", text or "")))
    own = {c: [t for _, t in sorted(turns, key=lambda x: x[0])] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = abs(c) // 100 * 100 * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(set)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    kids = defaultdict(list)
    for seq in members:
        if seq:
            kids[seq[:-1]].append(seq)
    below = {}
    for seq in sorted(members, key=len, reverse=True):
        leaves = sum(below[k][0] for k in kids[seq]) or 1
        below[seq] = leaves, sum(below[k][1] for k in kids[seq]) + (len(members[seq]) - 1) * (len(seq[-1][1]) if seq else 0)
    ends = lambda seq: ",".join(str(c) for c in sorted(members[seq]) if made[c] == seq)
    return sorted((min(m), len(seq), min(members[seq[:-1]]) if seq else -99, len(m), len(kids[seq]), *below[seq], hashlib.sha256(ends(seq).encode()).hexdigest()) for seq, m in members.items())


def conversations(rng):
    rows, said = [], [f"text {i} é" for i in range(6)]
    for c in range(0, 400, 3):
        for turn in range(rng.randint(1, 7)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", "hello" if turn == 0 and rng.random() < 0.6 else rng.choice(said)))
    rows += [(900 + 100 * k, t, "user", f"same {t}") for k in range(30) for t in range(8)]  # copies
    rows += [(7000 + 100 * k, t, "user", f"long {t}") for k in range(40) for t in range(k)]  # each one turn longer
    rows += [(55_000, t, None, None) for t in range(40)]
    rows += [(9001, None, "user", "first"), (9001, 0, "user", None), (9001, 0, "user", None), (None, 0, "user", "nobody's"), (-250, 0, "user", "below"), (-200, 0, "user", "zero"), (9101, 0, "tool", "x" * 70_000)]
    return rows


@pytest.mark.parametrize("capacity", [1 << 16, 25])
def test_tree_equals_the_plain_rule(spark, capacity):
    rows = conversations(random.Random(4))
    df = spark.createDataFrame([(*r, b"x", 1) for r in rows], "conv_id long, turn long, role string, text string, id binary, depth int").repartition(5)
    got = conversation_trie.conversation_trie(df, capacity).select([F.coalesce(c, F.lit(-99)).alias(c) if c == "parent_conv_id" else F.col(c) for c in conversation_trie.NODE])
    assert sorted(map(tuple, got.collect())) == plain_tree(rows)


def test_tree_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.conversation_trie(df).count() == 0
    df = spark.createDataFrame([(None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert conversation_trie.conversation_trie(df).count() == 0


def test_members_of_a_place_are_digested_in_pieces(spark):
    df = spark.range(20_000).select(F.lit(b"a").alias("cls"), F.col("id").alias("conv_id")).union(spark.range(3).select(F.lit(b"b"), F.col("id") - 5)).repartition(7)
    got = {bytes(r["cls"]): (r["n"], r["first"], r["ends"]) for r in conversation_trie.member_digests(df).collect()}
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {b"a": (20_000, 0, digest(range(20_000))), b"b": (3, -5, digest([-5, -4, -3]))}
