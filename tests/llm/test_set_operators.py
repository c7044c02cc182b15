"""Operators over pairs, vectors, trees and pages against brute-force versions; the pipeline against its plain rules."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import chat_tree, graph, html_extract, language_id, nearest, ngram_join


def brute_components(rows, n, percent):
    sets = [(i, ngram_join.ngrams(ngram_join.words_of(t), n)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        both = defaultdict(int)
        for g in s:
            for o in held[g]:
                both[o] += 1
            held[g].append(k)
        for o, c in both.items():
            if 100 * c >= percent * (len(s) + len(sets[o][1]) - c):
                a, b = top(i), top(sets[o][0])
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets}


def families(rng, count):
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(50)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(15)]
    rows = []
    for i in range(count):
        kind = rng.random()
        words = list(rng.choice(bases)) if kind < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        if kind > 0.75:
            words = words[:7] + passage + words[7:]
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((3 * i + 1, " ".join(words)))
    return rows


@pytest.mark.parametrize(("n", "percent", "dear"), [(4, 85, 3), (5, 80, 64)])
def test_join_equals_brute_force(spark, n, percent, dear):
    rows = families(random.Random(n), 260)
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, sig long, class long, label string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs, n, percent, dear).collect()}
    assert got == brute_components(rows, n, percent)


def test_join_edges(spark):
    rows = [(5, "one two"), (3, "ONE  two"), (9, None), (8, ""), (7, " \n"), (None, "one two"), (3, "one two"), (4, "word " * 30000), (6, "word " * 30000)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in got) == [
        (-1, 1, -1), (3, 1, 3), (3, 1, 3), (4, 1, 4), (5, 1, 3), (6, 1, 4), (7, 0, 7), (8, 0, 8), (9, 0, 9)]
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pigeonhole_bound():
    for percent in (80, 85):
        for size in range(1, 400):
            for other in range(size, size * 100 // percent + 1):
                need = next(c for c in range(size + 1) if 100 * c >= percent * (size + other - c))
                differ = size + other - 2 * need
                shared = [m for b, m, _ in ngram_join.layouts(size, percent) if b in {x[0] for x in ngram_join.layouts(other, percent)}]
                assert differ == 0 or (shared and max(shared) > differ)


def test_components(spark):
    rng = random.Random(1)
    names = [rng.getrandbits(50) for _ in range(300)]
    links = list(zip(names[:150], names[1:150], strict=False)) + [(names[200], n) for n in names[201:260]]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[n] for n in names[:150]}) == 1 and len({got[n] for n in names[200:260]}) == 1 and len(set(got.values())) == 2


def test_search_finds_the_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).round(3)
    x[100:160] = x[7]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [1.0], 1), (2080, [None] * 16, 1), (20, x[20].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, entry int")
    got = defaultdict(list)
    for r in nearest.search(df, F.col("vec_id") % 20 == 0, k=20, visit_share=0.7, centroids=12).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert len(got[r["query_id"]]) == r["rank"]
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        exact = x @ x[q]
        order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-round(exact[i], 9), i))[:20]
        hits += len(set(order) & {i for i, _ in found})
        assert len(found) == 20 and q not in {i for i, _ in found}
        assert all(abs(s - exact[i]) < 1e-9 for i, s in found) and found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hits >= 0.9 * 20 * len(got)
    assert [i for i, _ in got[100]][:20] == [7, *range(101, 120)]
    assert nearest.search(df.limit(0), F.lit(True)).count() == 0
    assert nearest.search(df.where("vec_id < 3"), F.lit(True), k=20).count() == 6


def test_recall_of_the_share(spark):
    """Parameters as the query has them, on so many vectors that the share decides, not the least number of entries."""
    x = np.random.default_rng(5).normal(size=(5000, 64)).round(3)
    assert nearest.VISIT_SHARE * len(x) > nearest.VISIT_LEAST
    got = defaultdict(set)
    for r in nearest.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=20).collect():
        got[r["query_id"]].add(r["vec_id"])
    exact = x @ x.T
    np.fill_diagonal(exact, -np.inf)
    hits = sum(len(set(np.argsort(-exact[q])[:20].tolist()) & found) for q, found in got.items())
    assert len(got) == 250 and all(len(found) == 20 for found in got.values())
    assert 0.9 * 20 * len(got) <= hits < 20 * len(got)


def test_cells_come_in_falling_order():
    rng = np.random.default_rng(3)
    a, b, sizes = rng.normal(size=9), rng.normal(size=7), rng.integers(0, 3, (9, 7))
    cells = nearest.visited_cells(a, b, sizes, 10**9)
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums, reverse=True) and len(cells) == (sizes > 0).sum()


CHATS = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (2, 0, "system", "be kind"), (2, 1, "user", "hi"), (2, 2, "assistant", "hey\\ <|done|>"),
         (3, 0, "system", "be kind"), (3, 1, "user", "bye"), (4, 0, "system", "be kind"), (4, 1, "user", "hi"), (5, 0, "user", None), (5, 1, None, "x"), (5, 1, "assistant", ""),
         (6, None, "assistant", "</s>[INST] a\\[/INST]\\\\"), (None, 0, "assistant", "lost"), (7, 0, "system", "be kind"), (7, 1, "user", "hi"), (7, 2, "assistant", "hello"), (8, 0, "assistant", "y" * 50000)]


def test_chat_tree_round_trip(spark):
    rng = random.Random(2)
    rows = CHATS + [(100 + c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "<|says|>", "\\"])) for c in range(60) for t in range(rng.randint(1, 6))]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, node int")
    segments, members = chat_tree.prefix_trees(df)
    got = {r["conv_id"]: r for r in chat_tree.read_back(segments, members).collect()}
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns = [t[1:] for t in sorted(turns)]
        assert [tuple(t) for t in got[c]["turns"]] == turns
        assert got[c]["loss_texts"] == [text for role, text in turns if role == "assistant"]
    packed = defaultdict(list)
    for s in segments.collect():
        packed[str(s["tree"])].append(s)
    prefixes = {tuple(t[1:] for t in sorted(turns)[:n + 1]) for turns in want.values() for n in range(len(turns))}
    assert sum(s["text"].count(chat_tree.DONE) for ss in packed.values() for s in ss) == len(prefixes)
    for ss in packed.values():
        at = 0
        for s in sorted(ss, key=lambda s: s["start"]):
            assert s["start"] == at and s["length"] == len(s["text"])
            at += s["length"]
            assert sum(a["end"] - a["start"] for a in s["ancestors"]) == s["position"] and len(s["ancestors"]) == s["depth"] - 1
            assert all(a["end"] <= s["start"] for a in s["ancestors"])
    assert chat_tree.read_back(*chat_tree.prefix_trees(df.limit(0))).count() == 0


def test_escape_leaves_no_control_string(spark):
    texts = ["".join(c) for c in [chat_tree.CONTROL]] + list(chat_tree.CONTROL) + ["<<<SYS>>", "[[INST]]", "\\<|turn|>\\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_tree.escape(F.col("t")).alias("e")).select("t", "e", chat_tree.unescape(F.col("e")).alias("u"))
    for r in df.collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat_tree.CONTROL)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body class="has-sidebar"><header>Site</header>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">Cookies!</div><div id="content-12"><div class="post-body p7"><h1>Title &amp; more</h1>
<p>First <b>bold</b>ed&nbsp;text<br>next <a href="/hidden-id" title="a > b">link</a>.<p>Second para<ul><li>one<li>two</ul><form><p>Name</p></form><!-- gone --><aside>Side</aside>
<div class="ad">Buy</div><table><tr><td>c1<td>c2</table></div><div class="comments"><p>Nice post by a reader, and a very long one that would win on its length alone if it were let in.</p></div></div>
<footer>&copy; x</footer></body></html>"""
TEXT = "Title & more First bolded text next link. Second para one two c1 c2"


def test_article_text():
    assert html_extract.extract(PAGE, None) == TEXT
    assert html_extract.extract(None, None) == html_extract.extract("", "html/body") == ""
    assert html_extract.extract("<p>open &lt;p&gt; <b>broken", None) == "open <p> broken"
    assert html_extract.extract("plain &amp; simple", None) == "plain & simple"
    assert html_extract.extract("<article><p>a</p><article class=comment><p>b</p></article></article>", None) == "a"


def test_hosts_vote(spark):
    body = "<body><div class='story s{n}'><p>{a}</p></div><div class='teasers'><p>{b}</p></div></body>"
    rows = [(n, "http://a.example/" + str(n), body.format(n=n, a="prose " * 40, b="more " * 10)) for n in range(9)]
    rows += [(9, "http://A.example/9", body.format(n=9, a="short", b="teaser " * 60)), (10, None, "<p>lonely</p>"), (11, "junk", None), (9, "http://A.example/9", body.format(n=9, a="short", b="teaser " * 60))]
    got = html_extract.main_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, path int")).collect()
    by_id = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and by_id[9] == "short" and by_id[10] == "lonely" and by_id[11] == ""
    assert by_id[0] == ("prose " * 40).strip()
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


ARTICLE = "<h1>Head</h1><p>A paragraph of the article.</p><div class=ad>Buy</div><p>And its end.</p>"


def test_marked_wrappers_keep_the_article():
    for start, end in [("<div class='page has-sidebar'>", "</div>"), ("<div id='header-fixed-layout'>", "</div>"), ("<section class='social-science'>", "</section>"), ("<form id=aspnet action=x>", "</form>"),
                       ("<article class='post comments-open'><p>intro</p>", "</article>"), ("<form><div class='page has-sidebar'><div>", "</div></div></form>"), ("<form><div class='login-off'><section class='social-science'>", "</section></div></form>")]:
        page = f"<body><nav>Menu with many words in it, more than the article has</nav>{start}{ARTICLE}{end}<footer>Foot</footer></body>"
        want = "Head A paragraph of the article. And its end."
        assert html_extract.extract(page, None) == ("intro " + want if "intro" in start else want), start
    assert html_extract.extract("<body><p>x</p><form><p>A page without a heading.</p><nav>Menu</nav></form></body>", None) == "x A page without a heading."
    two = "<body><section class='social-science'><h1>One</h1><p>first part</p></section><section class='social-science'><h1>Two</h1><p>second part</p></section></body>"
    assert html_extract.extract(two, None) == "One first part Two second part"


def test_marks_still_take_furniture():
    long = "words of furniture " * 30
    for inner in (f"<footer>{long}</footer>", f"<nav>{long}</nav>", f"<div class=sidebar><p>{long}</p></div>", f"<div class=comments><p>{long}</p></div>", f"<form><p>{long}</p></form>", f"<div class=related><article><h1>Other</h1>{long}</article></div>", f"<div hidden><h1>x</h1>{long}</div>"):
        assert html_extract.extract(f"<body><div><h1>Head</h1><p>short</p></div>{inner}</body>", None) == "Head short", inner
    assert html_extract.extract(f"<body><nav>{long}</nav><footer>{long}</footer><div class=comments>{long}</div></body>", None) == ""


def test_raw_elements_end():
    for tag in ("<svg/>", "<svg class='i' viewBox=\"0 0 1 1\" />", "<math />", "<svg-icon name=x></svg-icon>", "<select-menu></select-menu>", "<object-view>", "<title-bar/>", "<svg><path d='M0'/></svg>", "<SVG><g/></svg >"):
        assert html_extract.extract(f"<div><p>one {tag} two</p><p>three</p></div>", None) == "one two three", tag
    assert html_extract.extract("<div><p>one</p><svg/><p>two</p><svg><text>no</text></svg><p>three</p></div>", None) == "one two three"
    assert html_extract.extract("<p>one</p><script src=x/>no</script><select><option>no</select><p>two</p>", None) == "one two"


def test_parts_of_an_article_stay_together():
    split = "<body><h1>Head</h1><div class=lead><p>{a}</p></div><div class=ad>Buy</div><div class=body><p>{b}</p></div></body>"
    for a, b in [(49, 51), (51, 49), (5, 95)]:
        assert html_extract.extract(split.format(a="a" * a, b="b" * b), None) == f"Head {'a' * a} {'b' * b}"
    table = "<body><div class=post><h1>Head</h1><p>prose</p><table><tr><td>{c}<td>d</table><ul><li>{c}</ul><section><p>end</p></section></div></body>".format(c="cell " * 40)
    assert html_extract.extract(table, None) == f"Head prose {('cell ' * 40)}d {('cell ' * 40)}end"
    parts = "".join(f"<div class=part{chr(97 + n)}><p>text {n}</p></div>" for n in range(9))
    assert html_extract.extract(parts, None) == " ".join(f"text {n}" for n in range(9))
    assert html_extract.extract("<body><div><p>Outside of main, and longer.</p></div><main><h1>Head</h1><article><p>Inside of main, and it is the longest.</p></article></main>", None) == "Head Inside of main, and it is the longest."


def test_hosts_vote_with_all_containers(spark):
    body = "<body><h1>Head {n}</h1>" + "".join(f"<div class=x{chr(97 + k)}><p>filler {k} of page {{n}}</p></div>" for k in range(6)) + "<div class=story><p>story {n}</p></div><div class=teasers><p>same</p></div></body>"
    got = html_extract.main_text(spark.createDataFrame([(n, "http://a.example/", body.format(n=n)) for n in range(8)], "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {n: f"Head {n} " + " ".join(f"filler {k} of page {n}" for k in range(6)) + f" story {n}" for n in range(8)}


def test_near_duplicates_go_by_row(spark):
    """An id on several rows: each group keeps one row, whatever other groups its id stands in."""
    import corpus_pipeline

    x, y, z = (" ".join(f"{c}{k}" for k in range(40)) for c in "xyz")
    rows = [(7, x), (7, y), (3, y), (9, x), (7, z), (7, z), (8, z), (5, "odd words"), (5, "odd words"), (None, x), (None, x), (6, ""), (6, "")]
    docs = spark.createDataFrame([(i, t, f"s{n}", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.dtypes == docs.dtypes
    assert sorted(r["n_chars"] for r in got.collect()) == [0, 2, 4, 7, 9, 10, 11, 12]


def test_short_texts_of_shared_words_stay(spark, monkeypatch):
    import corpus_pipeline

    class Even:
        def predict(self, texts):
            return ["und" if t == "12" else "de" for t in texts], [0.0 if t == "12" else 0.3 for t in texts]

    decided = {}
    monkeypatch.setattr(corpus_pipeline, "language_model", lambda *_: None)
    monkeypatch.setattr(corpus_pipeline, "shared_scorer", lambda _: Even())
    monkeypatch.setattr(corpus_pipeline, "keep_rows", lambda docs, decide: decided.update(zip(["an", "12"], decide(["an", "12"]), strict=True)))
    corpus_pipeline.keep_languages(spark, None, "")
    assert decided == {"an": True, "12": False}


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    """Each stage against its rule: rejected rows go, of each family of near copies the smallest id stays, pieces are whole."""
    import corpus_pipeline
    from foliospark.llm.queries import GPT

    rng = random.Random(3)
    syllables = {"en": ["th", "er", "on", "an", "re", "he"], "de": ["sch", "ung", "ver", "keit", "ein"]}
    rows, labels, toxic = [], [], set()
    for i in range(700):
        lang = rng.choice(list(syllables))
        words = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randint(2, 4))) for _ in range(40)]
        if rng.random() < 0.15:
            words[5], words[25] = "vileword", "nastyterm"
            toxic.add(i)
        rows.append((i, " ".join(words), lang, "s", 1))
        labels.append((i, 1, int(i in toxic)))
    clean = [r for r in rows if r[0] not in toxic]
    copies = [(1000 + k, clean[k][1].rsplit(" ", 1)[0] + " tail", *clean[k][2:]) for k in range(30)]
    rows += copies + [(2000, None, "en", "s", 0), (2001, "12 34 !!", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in got}
    assert kept == {r[0] for r in clean}
    texts = {r[0]: r[1] for r in rows}
    assert all(r["length"] == len(GPT.ids(texts[r["doc_id"]])) + 1 for r in got)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes
    assert hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize(("dear", "block"), [(64, 4096), (2, 4096), (64, 7)])
def test_large_buckets_go_by_nearest_sketches(spark, monkeypatch, dear, block):
    """Stars (copies near one text but not near each other), chains and boilerplate around different texts share buckets of many components."""
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(5000)]
    centre = [rng.choice(vocabulary) for _ in range(160)]
    texts = [centre]
    for _ in range(40):
        words = list(centre)
        for _ in range(3):
            words[rng.randrange(160)] = rng.choice(vocabulary)
        texts.append(words)
    chain = list(centre)
    for _ in range(25):
        chain = list(chain)
        for _ in range(2):
            chain[rng.randrange(160)] = rng.choice(vocabulary)
        texts.append(chain)
    texts += [centre[:120] + [rng.choice(vocabulary) for _ in range(40)] for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df, 4, 85, dear).collect()}
    assert got == brute_components(rows, 4, 85)


def test_near_duplicate_stage_keeps_clashing_and_map_columns(spark):
    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "b", {"k": 2}), (1, text, "b", {"k": 1}), (1, text, "a", {"z": 1}), (2, text, "c", {}), (3, "other words altogether, five and more", "keep", None), (4, None, "null", {"n": 0}), (None, text, "no id", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key string, more map<string,int>").repartition(3)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = sorted(((r.doc_id, r.text_key) for r in out.collect()), key=str)
    assert got == [(1, "a"), (3, "keep"), (4, "null"), (None, "no id")]


def test_pairs_bring_one_text_each(spark, monkeypatch):
    """The text of a pair's first class comes once ahead of its pairs, in blocks where there are many."""
    kept, batches = [], ngram_join._batches
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "_batches", lambda df, fn, schema: kept.append(df) or batches(df, fn, schema))
    base = [f"w{i}" for i in range(40)]
    texts = {4 * k: " ".join(base[:20 + k]) for k in range(1, 12)}
    pairs = [(4, 4 * k) for k in range(2, 12)] + [(8, 12)]
    df = spark.createDataFrame(list(texts.items()), "class long, text string")
    got = ngram_join.verified(spark.createDataFrame(pairs, "a long, b long"), df, 4, 80).collect()
    sets = {c: ngram_join.ngrams(ngram_join.words_of(t), 4) for c, t in texts.items()}
    assert sorted(map(tuple, got)) == sorted((a, b, 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])) for a, b in pairs)
    rows = kept[0].collect()
    assert kept[0].columns == ["a", "b", "text"] and sum(r["b"] is not None for r in rows) == len(pairs)
    assert 2 <= sum(r["a"] == 4 and r["b"] is None for r in rows) <= 4 and sum(r["a"] == 8 and r["b"] is None for r in rows) == 1


def test_pairs_that_sketches_rule_out_bring_no_text(spark, monkeypatch):
    """Texts that share a passage meet in buckets, and rows that repeat an id have one text: only near pairs are compared, each once."""
    compared, verified = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *more: compared.extend(map(tuple, pairs.collect())) or verified(pairs, *more))
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts = [passage + [f"x{rng.randrange(10**6)}" for _ in range(20)] for _ in range(30)]
    texts += [[*t[:79], "other"] for t in texts[:5]]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:10], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df, 4, 85).collect()}
    assert got == brute_components(rows, 4, 85)
    assert sorted(got[30 + i][1] for i in range(5)) == list(range(5))
    assert len(compared) == 5


def test_buckets_with_the_same_rows_are_asked_once(spark):
    rows = [(1, 8, False), (1, 12, False), (2, 8, False), (2, 12, False), (3, 8, False), (3, 12, True), (4, 8, False), (4, 12, False), (4, 16, False)]
    got = ngram_join.unlike(spark.createDataFrame(rows, "sig long, class long, less boolean")).collect()
    assert sorted({r["sig"] for r in got}) == [1, 3, 4] and len(got) == 7


def test_labels_follow_further_links(spark):
    names = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "node long, label long")
    links = spark.createDataFrame([(2, 1), (2, 6), (8, 9)], "a long, b long")
    got = dict(map(tuple, ngram_join.renamed(names, links).select("node", "label").collect()))
    assert sorted(got) == [1, 2, 5, 6, 8, 9] and len({got[i] for i in (1, 2, 5, 6)}) == 1 and got[8] == got[9] != got[1]


def test_word_cache_goes_with_its_model():
    model = language_id.Model([], np.zeros((1, 0)), "")
    assert language_id.shared_scorer(model) is language_id.shared_scorer(model)
    assert len(language_id._scorers) == 1
    del model
    assert not language_id._scorers
