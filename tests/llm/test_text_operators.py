"""Operators over single texts against plain versions and public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliospark.llm import bpe_codec, language_id, packing, quality_rules, token_counts, toxicity
from foliospark.llm.common import fold
from foliospark.llm.queries import GPT, MASKED

LONG = "lorem ipsum dolor sit amet consectetur " * 4000
ODD = ["", " \n\t", "a", "It's we'll DON'T", "<|endoftext|>x<|endoftext|>", "ΑΣ ΣΑΣ", "İstanbul ﬁ é", "x y z\x85w", "12345 ¼", "😀👍🏽 zz", "日本語テキスト", "\x1c\x1d a\x00b", "a" * 300]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, very long and repeated texts, a null id, and columns whose names the operators use inside."""
    rows = [(i, t, 1, 2.0, "z") for i, t in enumerate(ODD)] + [(90, None, 1, 2.0, "z"), (91, LONG, 1, 2.0, "z"), (None, "no id", 1, 2.0, "z"), (0, "", 1, 2.0, "z"), (0, "", 1, 2.0, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, key long, score double, words string")


def random_text(rng, alphabet="aAbB'sStT é漢 \n\t.,!12<|>😀"):
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))


def test_codec_equals_the_library(spark, odd):
    rng = random.Random(1)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    codec = bpe_codec.codec(public_tokenizers.path("word_bpe_49k.json"))
    for text in [*ODD, *[random_text(rng) for _ in range(2000)]]:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert list(codec.encode(text)) == ids, text
        assert codec.decode(ids) == lib.decode(ids, skip_special_tokens=False), text
    got = bpe_codec.encode_decode(odd, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(got) == odd.count()
    assert all(r["ids"] == [] and r["decoded"] == "" for r in got if r["doc_id"] == 90)
    assert len(next(r for r in got if r["doc_id"] == 91)["ids"]) == len(lib.encode(LONG, add_special_tokens=False).ids)
    assert bpe_codec.encode_decode(odd.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_merge_skips_stale_entries():
    ranks = {(1, 2): (1, 12), (2, 3): (0, 23), (1, 23): (2, 123)}
    assert bpe_codec.merge_symbols([1, 2, 3], ranks) == [123]
    assert bpe_codec.merge_symbols([2, 2, 3, 1, 2], ranks) == [2, 23, 12]


def plain_rules(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n")]
    dup = sum(1 for i, x in enumerate(lines) if regex.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(regex.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def test_quality_counts(spark, odd):
    rng = random.Random(2)
    texts = [None, *ODD] + [" ".join(rng.choice("ab cd e# |".split()) for _ in range(rng.randint(0, 90))).replace("e#", "e#\n") for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:6] + (r["base_failed"],) for r in quality_rules.quality_rules(df).collect()}
    assert got == {i: plain_rules(t) for i, t in enumerate(texts)}
    edge = {r["doc_id"]: r for r in quality_rules.quality_rules(odd).collect()}
    assert not edge[90]["kept"] and edge[90]["n_words"] == 0 and not edge[91]["kept"]


def test_compression_bands():
    rng = random.Random(3)
    syllables = [a + b for a in "bdfgklmnprstvw" for b in ("a", "e", "i", "o", "er", "an")]
    prose = " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(900))
    noise = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(6000))
    assert quality_rules.compression(prose.encode())[3] == "ok"
    assert quality_rules.compression((prose[:200] * 40).encode())[3] == "repetitive"
    assert quality_rules.compression(noise.encode())[3] == "incompressible"
    assert quality_rules.compression(b"short")[3] == "short"
    lows = [quality_rules.band(n)[0] for n in (96, 300, 1000, 5000, 10**6)]
    assert lows == sorted(lows, reverse=True) and quality_rules.band(95) is None


def test_tree_counts_equal_full_counts(spark, odd):
    rng = random.Random(4)
    counter = token_counts.Counter(GPT.path, GPT.pattern)
    counts = token_counts.PieceCounts(counter)
    for _ in range(300):
        text = "".join(random_text(rng) for _ in range(rng.choice([1, 3, 40])))
        tree = token_counts.TokenTree(text, counts)
        for _ in range(4):
            start, length, insert = rng.randint(0, len(text)), rng.randint(0, 12), random_text(rng)[:rng.randint(0, 20)]
            tree.edit(start, length, insert)
            text = text[:start] + insert + text[start + length:]
            whole = token_counts.TokenTree(text, counts)
            assert tree.text == text and tree.total == whole.total == len(counts.encode(text))
            assert [x for b in tree.blocks for x in b[0]] == [x for b in whole.blocks for x in b[0]]
    edits = token_counts.replacements(F.col("text"), MASKED, "[masked]")
    got = token_counts.count_with_edits(odd, edits, counter).collect()
    assert len(got) == odd.count() and next(r for r in got if r["doc_id"] == 90)["n_tokens"] == 0
    assert next(r for r in got if r["doc_id"] == 91)["n_tokens"] == len(counts.encode(LONG))


def test_masking_edits(spark):
    texts = ["call +49 (30) 123-4567 or a.b@c.de now", "no match", None, "10.0.0.1,10.0.0.2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = df.select("doc_id", token_counts.replacements(F.col("text"), MASKED, "[masked]").alias("e")).orderBy("doc_id").collect()
    for text, row in zip(texts, rows, strict=True):
        out = text or ""
        for e in row["e"]:
            out = out[:e["start"]] + e["insert"] + out[e["start"] + e["length"]:]
        assert out == regex.sub(MASKED, "[masked]", text or "")


def test_packing_is_whole_and_tight(spark, odd):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("alpha beta gamma delta naïve 日本".split()) for _ in range(int(rng.paretovariate(0.7) * 20) % 9000))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    got = packing.pack_documents(docs, GPT, payload=packing.ids_crc32, payload_type="long").collect()
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["payload"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    for i, text in rows:
        ids = lib.encode(text, add_special_tokens=False).ids + [0]
        at = 0
        for n, (piece, start, length, crc) in enumerate(sorted(by_doc[i])):
            assert (piece, start) == (n, at) and (length == packing.CAPACITY or n == 0)
            assert crc == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at:at + length]))
            at += length
        assert at == len(ids)
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= -(-total // packing.CAPACITY) + 1
    assert [p for p in by_doc[1090] if p[2] != 1] == [] and len(by_doc[1000]) == 3
    assert packing.pack_documents(docs.limit(0), GPT).count() == 0


def test_levels_and_islands(spark):
    rng = random.Random(6)
    items = spark.createDataFrame([(i, rng.randint(1, 2047)) for i in range(900)], "key long, length long")
    placed = packing.pack(items, block=64).join(items, "key").collect()
    assert len(placed) == 900
    used = {}
    for r in placed:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 2048 and len(used) <= 1.06 * sum(used.values()) / 2048 + 1


def test_gpt_ids_equal_the_library():
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(7)
    for text in [*ODD, *[random_text(rng) for _ in range(2000)]]:
        assert GPT.ids(text).tolist() == lib.encode(text, add_special_tokens=False).ids, text


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    clean = ["".join(rng.choice(["la", "mo", "ri", "te", "su"]) for _ in range(3)) for _ in range(300)]
    bad = ["vileword", "nastyterm", "slurstem"]
    rows, labels = [], []
    for i in range(1500):
        toxic = rng.random() < 0.15
        words = [rng.choice(clean) for _ in range(rng.randint(15, 60))]
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "s", "ish", "ing"])
        rows.append((i, " ".join(words)))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark, labelled, odd):
    docs, labels = labelled
    model = toxicity.train(spark, docs, labels, fold(F.col("doc_id"), 4) != 2)
    got = toxicity.score(docs, model).join(labels, "doc_id").where(fold(F.col("doc_id"), 4) == 2).collect()
    hit = sum(r["predicted"] == 1 for r in got if r["toxic"] == 1) / sum(r["toxic"] == 1 for r in got)
    wrong = sum(r["predicted"] == 1 for r in got if r["toxic"] == 0) / sum(r["toxic"] == 0 for r in got)
    assert hit >= 0.95 and wrong <= 0.02
    edge = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert edge[90] == edge[0] < 0.3
    none = toxicity.train(spark, docs.limit(0), labels.limit(0), fold(F.col("doc_id"), 4) != 2)
    assert none.score("anything") < 1e-9


def test_risk_is_not_negative():
    import numpy as np

    rng = np.random.default_rng(1)
    x = (rng.random((600, 12)) < 0.2).astype(np.float32)
    hidden = np.r_[np.ones(200, bool), rng.random(400) < 0.3]
    x[hidden, 0] = 1
    x[~hidden, 0] = 0
    w, b = toxicity.nn_pu_fit(x, np.r_[np.ones(200, bool), np.zeros(400, bool)], 0.3)
    scores = 1 / (1 + np.exp(-(x[200:] @ w + b)))
    assert ((scores > 0.5) == hidden[200:]).mean() > 0.97


def all_segmentations(word, probability):
    if not word:
        return 1.0
    return sum(probability.get(word[:n], 0.0) * all_segmentations(word[n:], probability) for n in range(1, len(word) + 1))


def test_forward_sums_all_segmentations():
    import numpy as np

    path = public_tokenizers.path("piece_bpe_32k.model")
    count, _ = language_id.pieces_of(path)
    rng = np.random.default_rng(2)
    table = np.vstack([rng.random((count + 1, 2)), np.zeros((1, 2))])
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    names = sorted(p for p in {lib.id_to_piece(i) for i in range(lib.get_piece_size())} if p and p == p.lower() and (p.replace("▁", "", 1).isalpha() or p == "▁"))
    words = ["the", "nation", "übung", "ñandú", "zzzz", "о", "internationalisation"]
    for members, lattice in language_id.lattices(words, path):
        got = language_id.forward(lattice, table)
        for i, m in enumerate(members):
            for lang in range(2):
                chance = {p: table[n, lang] for n, p in enumerate(names, 1)}
                for ch in "▁" + words[m]:
                    chance.setdefault(ch, table[0, lang])
                assert got[i, lang] == pytest.approx(np.log(all_segmentations("▁" + words[m], chance)))


def test_languages_on_held_out_rows(spark, odd):
    rng = random.Random(9)
    syllables = {"aa": ["ka", "lo", "mi", "ne"], "bb": ["sch", "ung", "ver", "keit"], "cc": ["ción", "que", "ado", "mente"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(12)), lang) for i in range(400) for lang in [rng.choice(list(syllables))]]
    docs = spark.createDataFrame([*rows, (5000, "ka lo", None), (5001, None, "aa")], "doc_id long, text string, lang string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = language_id.train(spark, docs, fold(F.col("doc_id"), 3) != 1, path)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    held = [(got[i]["lang_pred"], lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(a == b for a, b in held) >= 0.99 * len(held) and got[5001]["lang_pred"] == "und" and got[5000]["lang_pred"] == "aa"
    edge = {r["doc_id"]: r for r in language_id.identify(odd, model).collect()}
    assert edge[90]["lang_pred"] == edge[1]["lang_pred"] == "und" and edge[90]["score"] == 0 and 0 < edge[91]["score"] <= 1
    empty = language_id.train(spark, docs.limit(0), F.lit(True), path)
    assert {r["lang_pred"] for r in language_id.identify(odd, empty).collect()} == {"und"}


def test_digests_of_the_codec_query(spark, tmp_path):
    from foliospark.llm.queries import op5

    spark.createDataFrame([(1, "Hello there", "en", "s", 11), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op5(spark, str(tmp_path)).collect()}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = lib.encode("Hello there", add_special_tokens=False).ids
    assert got[1]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got[1]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert got[2]["n_tokens"] == 0 and got[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("blank", [" ", "\n", "\t ", "\r\n"])
def test_millions_of_blanks_in_a_row(blank):
    from tokenizers import Tokenizer

    from foliospark.llm.queries import GPT

    text = "one" + blank * (3_000_000 // len(blank)) + "two <|endoftext|> three  "
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert GPT.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    counts = token_counts.PieceCounts(token_counts.Counter(GPT.path, GPT.pattern, GPT.spare))
    library.encode_special_tokens = True
    assert sum(counts.all(counts.cut.findall(text))) == len(library.encode(text, add_special_tokens=False).ids)


def test_language_sample_is_cut_in_buckets_and_refuses_too_many_languages(spark, monkeypatch):
    """The cut by buckets equals the plain one, ties and repeated rows included; too many languages are an error, not dropped."""
    from pyspark.sql import Window

    rows = spark.range(3000).selectExpr("id % 700 AS doc_id", "CASE WHEN id % 3 = 0 THEN 'aa' WHEN id % 50 = 1 THEN 'rare' ELSE 'bb' END AS lang")
    order = [F.xxhash64("doc_id"), "doc_id"]
    plain = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where("n <= 90").drop("n")
    for salts in (1, 7, 256):
        monkeypatch.setattr(language_id, "SALTS", salts)
        got = language_id.first_of(rows, "lang", "doc_id", order, 90)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.columns == rows.columns
    docs = rows.withColumn("text", F.lit("some words"))
    path = public_tokenizers.path("piece_bpe_32k.model")
    with pytest.raises(ValueError, match="languages"):
        language_id.train(spark, docs, F.lit(True), path, max_languages=2)
    assert language_id.train(spark, docs, F.lit(True), path, max_languages=3).languages == ["aa", "bb", "rare"]


def test_language_cache_follows_the_number_of_languages(monkeypatch):
    """A scorer whose cache holds a few words gives the results of a large one."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    counts = [{"lang": lang, "word": w, "n": n} for lang, words in (("x", "alpha beta gamma delta"), ("y", "omega sigma alpha tau")) for n, w in enumerate(words.split(), 1)]
    model = language_id.Model(["x", "y"], language_id.fit(counts, ["x", "y"], path), path)
    texts = ["alpha beta", "tau tau sigma omega alpha beta gamma", None, "12", "delta", "omega"]
    whole = language_id.Scorer(model).predict(texts)
    monkeypatch.setattr(language_id, "CACHE_BYTES", 48)
    small = language_id.Scorer(model)
    got = small.predict(texts)
    assert small.cached == 3 and got[0] == whole[0] and np.allclose(got[1], whole[1])
