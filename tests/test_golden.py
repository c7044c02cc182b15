"""Cases with known results for names, text, numbers, sizes and page specifications."""

import ipaddress

import pytest

from foliospark.functions import names, numbers, pagespec, screen, text
from foliospark.functions.geometry import align_of

ID, TS = "0123456789abcdef" * 2, "1699999999"


def test_download_names(evaluate):
    cases = [
        (f"/data/in/{ID}_{TS}_0_Offer_no_7_.pdf", "Offer_no_7_small.pdf"), (f"{ID}_{TS}_31_minutes.pdf", "minutes_small.pdf"),
        (f"{ID}_{TS}_minutes.pdf", "minutes_small.pdf"), (f"{ID.upper()}_{TS}_5_minutes.pdf", "minutes_small.pdf"),
        (f"{ID}_{TS}_7_{ID}_{TS}_8_twice.pdf", "twice_small.pdf"), (f"{ID}_{TS}_4.pdf", "file_small.pdf"),
        (f"{ID}_{TS}_9_.pdf", "file_small.pdf"), (f"{ID}.pdf", f"{ID}_small.pdf"), (f"{ID}_{TS}_2_1848_letters.pdf", "1848_letters_small.pdf"),
        (f"{ID}_{TS}_2_55555_map.pdf", "55555_map_small.pdf"), ("q____r___s.pdf", "q_r_s_small.pdf"), ("one    two.pdf", "one two_small.pdf"), ("v1...2.pdf", "v1.2_small.pdf"),
        ("- _plan_ -.pdf", "plan_small.pdf"), ("___.pdf", "file_small.pdf"), ("90210.pdf", "90210_small.pdf"), ("re\u0301sume\u0301.pdf", "r\u00e9sum\u00e9_small.pdf"),
    ]
    got = evaluate(lambda s: names.download_name(s, "small"), [(c[0],) for c in cases], "s string")
    assert got == [c[1] for c in cases]


def test_upload_and_stored_names(evaluate):
    cases = [("..//..\\up/key.pem", "key.pem"), ("x\\y\\my file.doc", "my_file.doc"), ("LPT3.txt", "unnamed"), (None, "unnamed"), ("..", "unnamed"),
             ("--force", "force"), ("отчёт.pdf", "отчёт.pdf"), ("tab\there.csv", "tabhere.csv"), ("m.abcdefghijklmnop", "m.abcdefghi"),
             ("ü" * 140 + ".odt", "ü" * 98 + ".odt")]
    assert evaluate(names.upload_name, [(c[0],) for c in cases], "s string") == [c[1] for c in cases]
    got = evaluate(names.stored_name, [("k1", "語" * 90 + ".odt"), ("k1", "plain")], "a string, b string")
    assert got == ["k1_" + "語" * 50 + ".odt", "k1_plain"]
    assert evaluate(names.safe_name, [("My back.TAR.XZ",), (".a..b c.TXT",), ("",)], "s string") == ["My_back.tar.xz", "a.b_c.txt", "unnamed_file"]


def test_multi_names(evaluate):
    rows = [("one.pdf", None, 0), ("one.pdf", None, 1), ("one.pdf", "zwo\u0308lf.pdf", 2), ("one.pdf", "two.pdf", 9)]
    got = evaluate(lambda a, b, n: names.multi_name(a, b, n, "joined"), rows, "a string, b string, n int")
    assert got == ["files_joined.pdf", "one_joined.pdf", "one_and_zw\u00f6lf_joined.pdf", "one_and_8_more_joined.pdf"]


def test_line_joins(evaluate):
    cases = [("they re-", "turned home", "they returned home"), ("pages 14-", "19 follow", "pages 14-19 follow"), ("Rhine-", "Main area", "Rhine-Main area"),
             ("first", "second", "first second"), ("a pause -", "then more", "a pause - then more"), ("東京都", "新宿区", "東京都新宿区"), ("", "only", "only"), ("only  ", "", "only")]
    assert evaluate(text.dehyphenate, [c[:2] for c in cases], "a string, b string") == [c[2] for c in cases]
    assert evaluate(text.join_words, [(["red", "fox"],), (["東京", "大阪"],), (["on", "東京", "", "by"],)], "w array<string>") == ["red fox", "東京大阪", "on 東京 by"]


def test_markdown_paragraphs_lose_their_stars(evaluate):
    cases = [("a **b** and *c* d_e_ ", "a b and c d_e_ "), ("stray * star**", "stray  star"), ("", ""), ("  ", ""), ("***x***", "x"), ("plain", "plain"), ("- **b** x", "b x")]
    got = evaluate(lambda s: text.markdown_text(s, text.markdown_kind(s)), [(c[0],) for c in cases], "s string")
    assert got == [c[1] for c in cases]


def test_paragraph_text_is_the_fold_of_its_joins(evaluate):
    """The linear form must equal joining the lines one after the other with the join of two lines."""
    pool = ["over-", "night", "B-", "-", "1812-", "1815", "京都", "", "   ", " leaf ", "y -", "k", "Öl-", "ähre"]
    cases = [[pool[(i * k + j) % len(pool)] for j in range(1 + i % 6)] for i in range(40) for k in (1, 3, 5)]
    want = [lines[0] for lines in cases]
    for n in range(1, 6):
        longer = [c for c, lines in enumerate(cases) if len(lines) > n]
        joined = evaluate(text.dehyphenate, [(want[c], cases[c][n]) for c in longer], "a string, b string")
        for c, value in zip(longer, joined):
            want[c] = value if want[c] else cases[c][n]
    assert evaluate(text.paragraph_text, [(c,) for c in cases], "w array<string>") == want


@pytest.mark.parametrize("raw, want", [
    ("QWERTY+Cambria", ("Cambria", False, False)), ("QWERTY+Cambria,Bold", ("Cambria", True, False)), ("TimesNewRomanPS-ItalicMT", ("Times New Roman", False, True)),
    ("Arial-BoldItalicMT", ("Arial", True, True)), ("Helvetica-BoldOblique", ("Arial", True, True)), ("Georgia-Bold", ("Georgia", True, False)), ("Verdana", ("Verdana", False, False)),
    ("", ("", False, False)), (None, (None, False, False))])
def test_font_names(evaluate, raw, want):
    assert tuple(evaluate(text.font_name, [(raw,)], "s string")[0]) == want


def test_numbers(evaluate):
    cases = [("98,765.25", 98765.25), ("98.765,25", 98765.25), ("9.876.543", 9876543), ("31", 31), ("(8)", -8), ("-(8)", None), ("042", None), ("31 m", None), ("", None), ("-0.75", -0.75),
             ("\t77\n", 77), ("\u2003-6\u00a0", -6), ("(0)", 0), ("+15", 15)]
    got = evaluate(numbers.parse_number, [(c[0],) for c in cases], "s string")
    assert [r["long_value"] if r["kind"] == "int" else r["double_value"] for r in got] == [c[1] for c in cases]
    big = evaluate(numbers.parse_number, [("123,456,789,012,345,678,901",), ("(99999999999999999999)",)], "s string")
    assert [(r["kind"], r["long_value"], r["digits"]) for r in big] == [("int", None, "123456789012345678901"), ("int", None, "-99999999999999999999")]
    assert evaluate(numbers.snap_size, [(8.9,), (35.0,), (10.6,), (-1.0,)], "s double") == [9.0, 36.0, 10.5, 11.0]
    assert evaluate(numbers.human_size, [(0,), (7,), (2560,), (3145728,)], "s long") == ["0 B", "7.00 B", "2.50 KB", "3.00 MB"]
    assert evaluate(numbers.human_size_short, [(0,), (7,), (2560,), (3145728,)], "s long") == ["0 Bytes", "7 Bytes", "2.5 KB", "3 MB"]


@pytest.mark.parametrize("args, kw, want", [
    ((800, 400, 200, None), {}, (200, 100)), ((800, 400, None, 100), {}, (200, 100)), ((800, 400, 300, 300), {}, (300, 150)), ((400, 800, 300, 300), {}, (150, 300)),
    ((800, 400, 30, 70), {"fit": "exact"}, (30, 70)), ((9000, 10, 3, None), {}, (3, 1)), ((80, 40, 160, None), {"no_upscale": True}, (80, 40)),
    ((80, 40, 90, 90), {"fit": "exact", "no_upscale": True}, (80, 40))])
def test_resize(evaluate, args, kw, want):
    got = evaluate(lambda a, b, c, d: numbers.resize_box(a, b, c, d, **kw), [args], "a long, b long, c long, d long")[0]
    assert tuple(got) == want


def test_alignment(evaluate):
    """Extents against a column from 0 to 1000."""
    cases = [([(0, 1000)] * 5 + [(0, 300)], False, "justify"), ([(0, 980), (0, 850), (2, 930), (0, 760), (0, 400)], False, "left"), ([(310, 690)], False, "center"),
             ([(780, 1000)], False, "right"), ([(0, 250)], False, "left"), ([(100, 900), (210, 790), (155, 845)], False, "center"), ([(500, 1000), (720, 1000), (350, 1000)], False, "right"),
             ([(0, 1000), (0, 420)], False, "left"), ([(0, 1000), (0, 420)], True, "justify")]
    from pyspark.sql import functions as F
    rows = [([(float(a), float(b)) for a, b in e], p) for e, p, _ in cases]
    got = evaluate(lambda e, p: align_of(e, F.lit(0.0), F.lit(1000.0), p), rows, "e array<struct<x0:double,x1:double>>, p boolean")
    assert got == [c[2] for c in cases]


def test_page_specifications(evaluate):
    run = lambda fn, rows: evaluate(fn, rows, "s string, n int")
    assert [[tuple(p) for p in r] for r in run(pagespec.page_ranges, [("1-3,5", 6), ("2-9", 6), ("all", 2), ("5,x,1", 6), ("3-1", 6)])] == [
        [(1, 3), (5, 5)], [], [(1, 1), (2, 2)], [(5, 5), (1, 1)], []]
    assert run(pagespec.page_list, [("3,1-9,3", 4), ("", 3), ("x,2", 3)]) == [[3, 1, 2, 4], [1, 2, 3], [2]]
    assert run(pagespec.page_set, [("3,1-2,9", 4), ("2-", 4), ("0-2", 4)]) == [[1, 2, 3], [], [1, 2]]
    assert run(pagespec.page_crop_list, [("2,1-3,2", 3), ("x", 3)]) == [[2, 1, 2, 3, 2], None]
    assert run(pagespec.validate_ranges, [("all", 3), ("1-2", 3), ("a", 3), ("0", 3), ("3-2", 3), ("2-9", 3), ("1,,2", 3)]) == [
        None, None, "Invalid page range format. Use format like '1-3,5,7-10'", "Page numbers must be positive", "Invalid range: 3-2",
        "Page 9 exceeds document length (3 pages)", "Invalid page number: "]


def test_addresses_and_urls(evaluate):
    rows = [("10.1.1.1", "8.8.8.8, 203.0.113.9, 127.0.0.1"), ("10.1.1.1", "10.0.0.1, 192.168.1.1"), ("9.9.9.9", "1.1.1.1"), ("172.32.0.1", "1.1.1.1"), ("::1", "5.5.5.5"), ("10.1.1.1", None)]
    assert evaluate(screen.client_key, rows, "a string, b string") == ["203.0.113.9", "10.0.0.1", "9.9.9.9", "172.32.0.1", "5.5.5.5", "10.1.1.1"]
    urls = [("https://example.com/a",), ("http://EXAMPLE.com:8080/",), ("http://[::1]/",), ("http://u@example.com/",), ("http://192.168.0.1/",), ("javascript:alert(1)",), ("http://x.local/",)]
    got = evaluate(screen.url_screen, urls, "u string")
    assert got[0] is None and got[1] is None and all(got[2:])
    literals = ["::1", "0:0:0:0:0:0:0:1", "::ffff:10.0.0.1", "::FFFF:a00:1", "fd12::9", "2001:db8::5", "febf::1", "2001:0:1::", "2606:4700:4700::1111", "2a00:1450:4001:81b::200e", "::ffff:8.8.8.8", "ff05::2", "64:ff9b:1::1", "2001:4:112::1"]
    got = evaluate(screen.url_screen, [(f"http://[{x}]/",) for x in literals], "u string")
    for x, message in zip(literals, got):
        ip = ipaddress.ip_address(x)
        ip = ip.ipv4_mapped or ip
        assert (message is not None) == (ip.is_private or ip.is_loopback or ip.is_reserved or ip.is_link_local or ip.is_multicast), x
    assert evaluate(lambda p: screen.path_inside(p, "/srv/up"), [("/srv/up/../up/a",), ("../x",), ("/srv/upper",), ("a/b/../../..",)], "p string") == [True, False, False, False]


def test_list_labels(evaluate):
    got = evaluate(text.list_label, [("28.",), ("(f)",), ("•",), ("xlix.",), ("K)",), ("-",), ("plain",)], "s string")
    assert [None if r is None else (r["format"], r["start"]) for r in got] == [
        ("decimal", 28), ("lowerLetter", 6), ("bullet", 1), ("lowerRoman", 49), ("upperLetter", 11), ("bullet", 1), None]
    numerals = {"ii": 2, "iv": 4, "xiv": 14, "XC": 90, "cxliv": 144, "lxxxviii": 88, "ccc": 300}
    assert evaluate(text.roman_value, [(n,) for n in numerals], "s string") == list(numerals.values())


def test_markdown_runs(evaluate):
    cases = {"a **b c** *d* e": [("a ", False, False), ("b c", True, False), (" ", False, False), ("d", False, True), (" e", False, False)],
             "**b": [("b", False, False)], "**a*": [("a", False, True)], "***x***": [("x", True, False)], "# *h* ": [("*h*", False, False)], "- **b** x": [("b x", False, False)],
             " [IMAGE: p] ": [("[IMAGE: p]", False, True)], "| a |": [], "  ": [], "": [], "***": [], "1. _n_": [("n", False, False)]}
    got = evaluate(lambda s: text.markdown_runs(s, text.markdown_kind(s)), [(c,) for c in [*cases, None]], "s string")
    assert [[tuple(r) for r in runs] for runs in got] == [*cases.values(), []]
