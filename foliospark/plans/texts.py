"""Catalogue: names, text, fonts, labels, Markdown, numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import names, numbers, text
from foliospark.plans.fixtures import ctes, table, view
from foliospark.plans.registry import query

_P = "[a-f0-9]{32}_[0-9]{9,11}_[0-9]{1,3}_"
_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[^\p{{L}}\p{{N}}\p{{M}} _.-]', '_', 'g'), ' +', ' ', 'g'), ' *_[ _]*', '_', 'g'), '\.{{2,}}', '.', 'g'), ' _-.')"""
_STEM = "regexp_replace(nfc_normalize(stored_name), '\\.pdf$', '')"
_NOPREFIX = f"regexp_replace({_STEM}, '^{_P}', '')"


def clean_sql(x: str) -> str:
    return _CLEAN.format(x=x)


@query("strip_prefix", ctes("stored_names") + f"SELECT file_no, regexp_replace(stored_name, '^{_P}', '') AS name FROM stored_names")
def _(spark, d):
    return view(spark, d, "stored_names").select("file_no", names.strip_prefix(F.col("stored_name")).alias("name"))


@query("clean_stem", ctes("stored_names") + f"SELECT file_no, {clean_sql(_NOPREFIX)} AS stem FROM stored_names")
def _(spark, d):
    stem = names.unicode_normalize(names.path_stem(F.col("stored_name")), "NFC")
    return view(spark, d, "stored_names").select("file_no", names.clean_stem(names.strip_prefix(stem)).alias("stem"))


@query("download_name", ctes("stored_names") + f"SELECT file_no, {clean_sql(_NOPREFIX)} || '_compressed.pdf' AS name FROM stored_names")
def _(spark, d):
    return view(spark, d, "stored_names").select("file_no", names.download_name(F.col("stored_name"), "compressed").alias("name"))


@query("multi_name", ctes("stored_names", more=f"""g AS (SELECT job, count(*) AS n, arg_min(stored_name, file_no) AS first_name,
 arg_min(stored_name, file_no, 2)[2] AS second_name FROM stored_names GROUP BY job),
 p AS (SELECT job, n, {clean_sql(_NOPREFIX.replace('stored_name', 'first_name'))} AS a, {clean_sql(_NOPREFIX.replace('stored_name', 'second_name'))} AS b FROM g)""") + """
 SELECT job, CASE WHEN n = 1 THEN a WHEN n = 2 THEN a || '_and_' || b ELSE a || '_and_' || CAST(n - 1 AS VARCHAR) || '_more' END || '_merged.pdf' AS name FROM p""")
def _(spark, d):
    s = view(spark, d, "stored_names")
    order = F.struct("file_no", "stored_name")
    head = s.groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("a"))
    rest = s.join(head, "job").filter(order > F.col("a")).groupBy("job").agg(F.min(order).alias("b"))
    g = head.join(rest, "job", "left")
    return g.select("job", names.multi_name(F.col("a.stored_name"), F.col("b.stored_name"), F.col("n"), "merged").alias("name"))


@query("upload_name", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(CASE WHEN trim(n, '._-') = '' THEN 'unnamed' ELSE n END, '^[.-]+', ''), '\.+$', ''), '(\..{9}).*$', '\1') AS name
 FROM (SELECT page_id, regexp_replace(regexp_extract(replace(url, '\', '/'), '([^/]*)$', 1), '[^\p{L}\p{M}\p{N}.-]', '_', 'g') AS n FROM pages)""")
def _(spark, d):
    raw = names.unicode_normalize(F.col("url"), "NFC")
    return table(spark, d, "pages").select("page_id", names.upload_name(raw).alias("name"))


@query("upload_name_text", r"""SELECT doc_id, list_max(list_filter(list_transform(range(201), lambda k : left(n2, k)), lambda p : octet_length(encode(p)) <= 200)) AS long_name FROM (SELECT doc_id, replace(regexp_replace(n, '^[.-]+', ''), '.', '_') AS n2 FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_extract(replace(replace(text, '.', '_'), '\', '/'), '([^/]*)$', 1), '\p{C}', '', 'g'), '[^\p{L}\p{M}\p{N}.-]', '_', 'g') AS n FROM documents))
""")
def _(spark, d):
    name = names.upload_name(names.unicode_normalize(F.regexp_replace("text", r"\.", "_"), "NFC"))
    return table(spark, d, "documents").select("doc_id", name.alias("long_name"))


@query("stored_name", "SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) || '_' || substr(repeat(c_name, 5), 1, 50) || '.pdf' AS name FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    original = F.concat(F.repeat("c_name", F.lit(5)), F.lit(".pdf"))
    return c.select("c_custkey", names.stored_name(F.md5(F.col("c_custkey").cast("string")), original).alias("name"))


@query("safe_name", r"""SELECT page_id, CASE WHEN e = '' THEN regexp_replace(regexp_replace(regexp_replace(n, '[^\p{L}\p{N}_.-]', '_', 'g'), '\.{2,}', '.', 'g'), '_{2,}', '_', 'g')
 ELSE regexp_replace(regexp_replace(regexp_replace(substr(n, 1, length(n) - length(e)), '[^\p{L}\p{N}_.-]', '_', 'g'), '\.{2,}', '.', 'g'), '_{2,}', '_', 'g') || lower(e) END AS name
 FROM (SELECT page_id, n, regexp_extract(n, '[^.].*?(\.[^.]+)$', 1) AS e FROM (SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS n FROM pages))""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", names.safe_name(names.unicode_normalize(F.col("url"), "NFKD")).alias("name"))


@query("clean_text_input", r"SELECT doc_id, trim(substr(text, 1, 1000), ' ' || chr(10) || chr(9) || chr(13)) AS clean FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", names.clean_text_input(names.unicode_normalize(F.col("text"), "NFKC")).alias("clean"))


@query("unicode_normalize", "SELECT doc_id, nfc_normalize(text) AS nfc FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", names.unicode_normalize(F.col("text"), "NFC").alias("nfc"))


@query("valid_filename", r"SELECT page_id, NOT contains(u, '..') AND NOT contains(u, '/') AND NOT contains(u, '\') AND length(u) <= 255 AND u <> '' AS ok FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN html ELSE regexp_extract(url, '([^/]*)$', 1) END AS u FROM pages)")
def _(spark, d):
    u = F.expr("CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN html ELSE regexp_extract(url, '([^/]*)$', 1) END")
    return table(spark, d, "pages").select("page_id", names.valid_filename(u).alias("ok"))


@query("file_extension", r"""SELECT page_id, regexp_extract(url, '^.+\.([^.]*)$', 1) AS ext,
 CASE WHEN regexp_matches(url, '\.html$') THEN 'text/html' ELSE 'application/octet-stream' END AS mime FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", names.file_extension(F.col("url")).alias("ext"), names.mime_from_name(F.col("url")).alias("mime"))


@query("mime_from_name", """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 4 THEN 'text/csv'
 ELSE 'application/octet-stream' END AS mime FROM lineitem""")
def _(spark, d):
    name = F.concat(F.lit("file."), F.col("l_partkey").cast("string"), F.expr("CASE l_linenumber WHEN 1 THEN '.PDF' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.docx' WHEN 4 THEN '.csv' ELSE '.q' END"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", names.mime_from_name(name).alias("mime"))


@query("url_name", "SELECT page_id, replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.', '_') || '.pdf' AS name FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", names.url_name(F.col("url")).alias("name"))


@query("join_words", "SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '[ \\n]'), lambda w : w <> ''), ' ') AS joined FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.join_words(F.split("text", "[ \n]")).alias("joined"))


@query("dehyphenate", ctes("line_text", more=r"""w AS (SELECT doc_id, line_no, text AS a, lead(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM line_text),
 h AS (SELECT doc_id, line_no, rtrim(a) || CASE line_no % 3 WHEN 0 THEN '-' ELSE '' END AS p, CASE line_no % 2 WHEN 0 THEN lower(ltrim(b)) ELSE ltrim(b) END AS n FROM w WHERE b IS NOT NULL)""") + r"""
 SELECT doc_id, line_no, CASE WHEN p = '' THEN n WHEN n = '' THEN p WHEN right(p, 1) = '-' AND length(p) >= 3 AND NOT ends_with(p, ' -')
 AND regexp_matches(substr(p, length(p) - 1, 1), '\p{L}') AND regexp_matches(left(n, 1), '\p{Ll}') THEN left(p, length(p) - 1) || n
 WHEN right(p, 1) = '-' AND length(p) >= 3 AND NOT ends_with(p, ' -') AND regexp_matches(substr(p, length(p) - 1, 1), '[\p{L}\p{N}]') AND regexp_matches(left(n, 1), '[\p{L}\p{N}]') THEN p || n
 ELSE p || ' ' || n END AS joined FROM h""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    pairs = docs.select("doc_id", F.posexplode(F.expr("transform(slice(ls, 2, size(ls)), (b, i) -> struct(ls[i] AS a, b AS b))")).alias("line_no", "p"))
    p = F.concat(F.rtrim("p.a"), F.when(F.col("line_no") % 3 == 0, "-").otherwise(""))
    n = F.when(F.col("line_no") % 2 == 0, F.lower(F.ltrim("p.b"))).otherwise(F.ltrim("p.b"))
    return pairs.select("doc_id", "line_no", text.dehyphenate(p, n).alias("joined"))


@query("paragraph_text", "SELECT doc_id, array_to_string(string_split(text, chr(10)), ' ') AS paragraph FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.paragraph_text(F.split("text", "\n")).alias("paragraph"))


_OCR = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, ' +', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\n[0-9]+\s*$', ''), '^[0-9]+\s*\n', ''), '[|]{2,}', '', 'g'), '-{5,}', '', 'g'), '_{5,}', '', 'g'), ' ' || chr(10) || chr(9) || chr(13))"""
_NOISY = "SELECT doc_id, CAST(doc_id AS VARCHAR) || chr(10) || replace(text, chr(10), chr(10) || chr(10) || chr(10) || '||| ------  ') || chr(10) || '17 ' AS t FROM documents"


def _noisy(spark, d):
    body = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n\n||| ------  "))
    return table(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("\n"), body, F.lit("\n17 ")).alias("t"))


@query("clean_ocr_text", f"SELECT doc_id, {_OCR} AS clean FROM ({_NOISY})")
def _(spark, d):
    return _noisy(spark, d).select("doc_id", text.clean_ocr_text(F.col("t")).alias("clean"))


@query("text_paragraphs", rf"""SELECT doc_id, unnest(range(len(ps))) AS par_no, unnest(ps) AS paragraph FROM (SELECT doc_id,
 list_filter(list_transform(string_split({_OCR}, chr(10) || chr(10)), lambda p : trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p : p <> '') AS ps FROM ({_NOISY}))""")
def _(spark, d):
    return _noisy(spark, d).select("doc_id", F.posexplode(text.paragraphs_of(text.clean_ocr_text(F.col("t")))).alias("par_no", "paragraph"))


_AZ, _HE, _AR = "abcdefghijklmnopqrstuvwxyz", "אבגדהוזחטיכלמנסעפצקרשתאבגד", "ابتثجحخدذرزسشصضطظعغفقكلمنه"
_MIX = f"""CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN translate(lower(text), '{_AZ}', '{_HE}') WHEN 2 THEN translate(lower(text), '{_AZ}', '{_AR}') WHEN 3 THEN 'こんにちは世界' || text WHEN 4 THEN '한국어 ' || text ELSE '中文文本 ประเทศ' || text END"""


@query("script_class", rf"""SELECT doc_id, CASE WHEN regexp_matches(t, '[\x{{0590}}-\x{{08ff}}\x{{0900}}-\x{{0dff}}\x{{0e00}}-\x{{0eff}}]') THEN 'complex' WHEN regexp_matches(t, '[\x{{2e80}}-\x{{9fff}}\x{{ac00}}-\x{{d7af}}]') THEN 'east_asian' ELSE 'latin' END AS script,
 len(regexp_extract_all(t, '[\x{{0590}}-\x{{08ff}}]')) > len(regexp_extract_all(t, '[A-Za-z\x{{00c0}}-\x{{024f}}]')) AS rtl FROM (SELECT doc_id, {_MIX} AS t FROM documents)""")
def _(spark, d):
    m = table(spark, d, "documents").select("doc_id", F.expr(_MIX).alias("t"))
    return m.select("doc_id", text.script_class(F.col("t")).alias("script"), text.is_rtl_line(F.col("t")).alias("rtl"))


@query("lang_for_text", f"""SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'he-IL' WHEN 2 THEN 'ar-SA' WHEN 5 THEN 'th-TH' END AS bidi,
 CASE doc_id % 6 WHEN 3 THEN 'ja-JP' WHEN 4 THEN 'ko-KR' WHEN 5 THEN 'zh-CN' END AS east_asia FROM documents""")
def _(spark, d):
    m = table(spark, d, "documents").select("doc_id", F.expr(_MIX).alias("t"))
    return m.select("doc_id", text.bidi_language(F.col("t")).alias("bidi"), text.east_asian_language(F.col("t")).alias("east_asia"))


@query("is_rtl_text", rf"""SELECT doc_id, len(regexp_extract_all(t, '\p{{L}}')) > 0 AND len(regexp_extract_all(t, '[\x{{05d0}}-\x{{05ea}}\x{{0620}}-\x{{064a}}]')) / greatest(len(regexp_extract_all(t, '\p{{L}}')), 1) > 0.5 AS rtl
 FROM (SELECT doc_id, {_MIX} AS t FROM documents)""")
def _(spark, d):
    m = table(spark, d, "documents").select("doc_id", F.expr(_MIX).alias("t"))
    return m.select("doc_id", text.is_rtl_text(F.col("t")).alias("rtl"))


@query("rtl_edge_fix", r"""SELECT doc_id, line_no, CASE WHEN p = '' OR length(p) = length(t) THEN t WHEN regexp_replace(p, '\s', '', 'g') = '' THEN substr(t, length(p) + 1) || p
 ELSE rtrim(substr(t, length(p) + 1)) || regexp_replace(p, '\s', '', 'g') || repeat(' ', CAST(length(t) - length(rtrim(t)) AS BIGINT)) || regexp_replace(p, '\S', '', 'g') END AS fixed FROM (
 SELECT doc_id, line_no, t, regexp_extract(t, '^[ .,;:!?]+') AS p FROM (SELECT doc_id, line_no, CASE line_no % 3 WHEN 0 THEN '. ' || text || ' ' WHEN 1 THEN ' ' || text ELSE text END AS t FROM line_text))""".join([ctes("line_text"), ""]))
def _(spark, d):
    t = F.expr("CASE line_no % 3 WHEN 0 THEN '. ' || text || ' ' WHEN 1 THEN ' ' || text ELSE text END")
    return view(spark, d, "line_text").select("doc_id", "line_no", text.rtl_edge_fix(t).alias("fixed"))


_FONT = """CASE l_linenumber % 7 WHEN 0 THEN 'ABCDEF+Calibri,Bold' WHEN 1 THEN 'TimesNewRomanPS-BoldItalicMT' WHEN 2 THEN 'ArialMT' WHEN 3 THEN 'Liberation' || initcap_key || '-Italic'
 WHEN 4 THEN 'ArialBold' WHEN 5 THEN 'Helvetica-Oblique' ELSE 'Noto ' || initcap_key || ' Regular' END"""
_KEY = "CASE l_returnflag WHEN 'A' THEN 'Serif' WHEN 'N' THEN 'SansCaption' ELSE 'Mono' END"


@query("font_name", f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 7 WHEN 0 THEN 'Calibri' WHEN 1 THEN 'Times New Roman' WHEN 2 THEN 'Arial'
 WHEN 3 THEN 'Liberation ' || CASE l_returnflag WHEN 'A' THEN 'Serif' WHEN 'N' THEN 'Sans Caption' ELSE 'Mono' END WHEN 4 THEN 'Arial' WHEN 5 THEN 'Arial' ELSE 'Noto ' || {_KEY} END AS family,
 l_linenumber % 7 IN (0, 1, 4) AS bold, l_linenumber % 7 IN (1, 3, 5) AS italic FROM lineitem""")
def _(spark, d):
    raw = F.expr(_FONT.replace("initcap_key", f"({_KEY})"))
    li = table(spark, d, "lineitem").withColumn("f", text.font_name(raw))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "f.family", "f.bold", "f.italic")


_LABEL = """CASE l_linenumber WHEN 1 THEN CAST(l_partkey % 1000 AS STRING) || '.' WHEN 2 THEN '(' || substr('abcdefghijklmnopqrstuvwxyz', CAST(l_partkey % 26 + 1 AS INT), 1) || ')' WHEN 3 THEN '•'
 WHEN 4 THEN 'xiv.' WHEN 5 THEN '-' WHEN 6 THEN 'XLII)' ELSE 'word' END"""


@query("list_label", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber IN (3, 5) THEN 'bullet' WHEN l_linenumber < 7 THEN 'number' END AS kind,
 CASE l_linenumber WHEN 1 THEN 'decimal' WHEN 2 THEN 'lowerLetter' WHEN 3 THEN 'bullet' WHEN 4 THEN 'lowerRoman' WHEN 5 THEN 'bullet' WHEN 6 THEN 'upperRoman' END AS format,
 CASE l_linenumber WHEN 1 THEN CAST(l_partkey % 1000 AS INT) WHEN 2 THEN CAST(l_partkey % 26 + 1 AS INT) WHEN 3 THEN 1 WHEN 4 THEN 14 WHEN 5 THEN 1 WHEN 6 THEN 42 END AS start FROM lineitem""")
def _(spark, d):
    li = table(spark, d, "lineitem").withColumn("f", text.list_label(F.expr(_LABEL)))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "f.kind", "f.format", "f.start")


_MD = """CASE line_no % 9 WHEN 0 THEN '# ' || text WHEN 1 THEN '## ' || text WHEN 2 THEN '- **' || text || '** x' WHEN 3 THEN '12. ' || text WHEN 4 THEN '| a | ' || text || ' |'
 WHEN 5 THEN '|---|:-:|' WHEN 6 THEN '[IMAGE: p]' WHEN 7 THEN '' ELSE text END"""


@query("markdown_lines", ctes("line_text") + """SELECT doc_id, line_no, CASE line_no % 9 WHEN 0 THEN 'heading1' WHEN 1 THEN 'heading2' WHEN 2 THEN 'bullet' WHEN 3 THEN 'number' WHEN 4 THEN 'table' WHEN 5 THEN 'table'
 WHEN 6 THEN 'image' ELSE CASE WHEN starts_with(text, '|') THEN 'table' WHEN starts_with(text, '* ') OR starts_with(text, '- ') THEN 'bullet' WHEN regexp_matches(text, '^[0-9]+\\. ') THEN 'number' ELSE 'paragraph' END END AS kind
 FROM line_text WHERE line_no % 9 <> 7 AND NOT (line_no % 9 = 8 AND trim(text) = '')""")
def _(spark, d):
    m = view(spark, d, "line_text").select("doc_id", "line_no", F.expr(_MD).alias("t"))
    return m.select("doc_id", "line_no", text.markdown_kind(F.col("t")).alias("kind")).filter(F.col("kind").isNotNull())


def _unstyled(x: str) -> str:
    for pattern in (r"\*\*(.+?)\*\*", r"\*(.+?)\*", "__(.+?)__", "_(.+?)_"):
        x = f"regexp_replace({x}, '{pattern}', '\\1', 'g')"
    return x


_STRIPPED = "regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')".format


@query("markdown_text", ctes("line_text", more=f"m AS (SELECT doc_id, line_no, {_MD} AS t FROM line_text), k AS (SELECT *, {_STRIPPED('t')} AS s FROM m)") + f"""
 SELECT doc_id, line_no, CASE WHEN s = '' THEN '' WHEN regexp_matches(t, '^#{{1,3}} ') THEN {_STRIPPED("regexp_replace(t, '^#{1,3} ', '')")} WHEN regexp_matches(s, '^[-*] ') THEN {_unstyled("substr(s, 3)")}
 WHEN regexp_matches(s, '^[0-9]+\\.\\s') THEN {_unstyled("regexp_replace(s, '^[0-9]+\\.\\s', '')")} WHEN starts_with(s, '|') OR starts_with(s, '[IMAGE:') THEN s
 ELSE regexp_replace(t, '\\*\\*([^*]+)\\*\\*|\\*([^*]+)\\*|\\*', '\\1\\2', 'g') END AS plain FROM k""")
def _(spark, d):
    m = view(spark, d, "line_text").select("doc_id", "line_no", F.expr(_MD).alias("t"))
    return m.select("doc_id", "line_no", text.markdown_text(F.col("t"), text.markdown_kind(F.col("t"))).alias("plain"))


# Words of the lines in turn bold, plain, in italics and behind a single star.
_STARRED = "array_to_string(list_transform(string_split(t, ' '), lambda w, i: CASE i % 4 WHEN 1 THEN '**' || w || '**' WHEN 3 THEN '*' || w || '*' WHEN 0 THEN '*' || w ELSE w END), ' ')"
_PAIRED = r"\*\*[^*]+\*\*|\*[^*]+\*|[^*]+"


@query("markdown_runs", ctes("line_text", more=f"m AS (SELECT doc_id, line_no, {_MD} AS t FROM line_text), k AS (SELECT *, {_STRIPPED('t')} AS s, {_STRIPPED('t')} <> '' AND NOT regexp_matches(t, '^#{{1,3}} ') AND NOT regexp_matches({_STRIPPED('t')}, '^([-*] |[0-9]+[.][\\s]|[|]|[[]IMAGE:)') AS para FROM m)") + f"""
 , p AS (SELECT doc_id, line_no, regexp_extract_all({_STARRED}, '{_PAIRED}') AS parts FROM k WHERE para)
 SELECT doc_id, line_no, n::BIGINT AS run_no, text, bold, italic FROM (SELECT doc_id, line_no, unnest(range(len(parts))) AS n, regexp_replace(unnest(parts), '^[*]+|[*]+$', '', 'g') AS text, starts_with(unnest(parts), '**') AS bold, starts_with(unnest(parts), '*') AND NOT starts_with(unnest(parts), '**') AS italic FROM p)
 UNION ALL SELECT doc_id, line_no, 0, s, false, true FROM k WHERE NOT para AND starts_with(s, '[IMAGE:')
 UNION ALL SELECT doc_id, line_no, 0, plain, false, false FROM (SELECT doc_id, line_no, CASE WHEN s = '' OR starts_with(s, '|') OR starts_with(s, '[IMAGE:') THEN '' WHEN regexp_matches(t, '^#{{1,3}} ') THEN {_STRIPPED("regexp_replace(t, '^#{1,3} ', '')")}
  WHEN regexp_matches(s, '^[-*] ') THEN {_unstyled("substr(s, 3)")} ELSE {_unstyled("regexp_replace(s, '^[0-9]+\\.\\s', '')")} END AS plain FROM k WHERE NOT para) WHERE plain <> ''""")
def _(spark, d):
    m = view(spark, d, "line_text").select("doc_id", "line_no", F.expr(_MD).alias("t"))
    starred = F.array_join(F.transform(F.split("t", " "), lambda w, i: F.when(i % 4 == 0, F.concat(F.lit("**"), w, F.lit("**"))).when(i % 4 == 2, F.concat(F.lit("*"), w, F.lit("*"))).when(
        i % 4 == 3, F.concat(F.lit("*"), w)).otherwise(w)), " ")
    kind = text.markdown_kind(F.col("t"))
    # A line keeps its kind when its words get their stars.
    line = m.withColumn("kind", kind).withColumn("t", F.when(F.col("kind") == "paragraph", starred).otherwise(F.col("t")))
    return line.select("doc_id", "line_no", F.posexplode(text.markdown_runs(F.col("t"), F.col("kind"))).alias("run_no", "r")).select("doc_id", "line_no", F.col("run_no").cast("long").alias("run_no"), "r.*")


@query("markdown_cells", ctes("line_text") + r"""SELECT doc_id, line_no, array_to_string(list_transform(list_slice(cs, 2, len(cs) - 1), lambda c : trim(c)), '¦') AS cells, CAST(len(cs) - 2 AS INT) AS n FROM (
 SELECT doc_id, line_no, string_split('| a | ' || translate(text, '*_|', '   ') || ' | ' || CAST(line_no AS VARCHAR) || ' |', '|') AS cs FROM line_text)""")
def _(spark, d):
    line = F.expr("'| a | ' || translate(text, '*_|', '   ') || ' | ' || CAST(line_no AS STRING) || ' |'")
    m = view(spark, d, "line_text").select("doc_id", "line_no", line.alias("t"))
    cells = text.markdown_cells(F.col("t"))
    return m.filter(~text.is_separator_row(F.col("t"))).select("doc_id", "line_no", F.array_join(cells, "¦").alias("cells"), F.size(cells).alias("n"))


@query("strip_emphasis", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g'), '__(.+?)__', '\1', 'g'), '_(.+?)_', '\1', 'g') AS plain
 FROM (SELECT doc_id, '**a** ' || text || ' _b_ *c*' AS t FROM documents)""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.strip_emphasis(F.concat(F.lit("**a** "), "text", F.lit(" _b_ *c*"))).alias("plain"))


_MONEY_SPARK = """CASE line_no % 4 WHEN 0 THEN format_string('%,d.%02d', whole, cents) WHEN 1 THEN translate(format_string('%,d', whole), ',', '.') || ',' || lpad(CAST(cents AS STRING), 2, '0')
 WHEN 2 THEN '(' || format_string('%,d', whole) || ')' ELSE CAST(whole AS STRING) || ' kg' END"""


def money(spark, d):
    return view(spark, d, "money_text").withColumn("cell", F.expr(_MONEY_SPARK))


@query("parse_number", ctes("money_text") + """SELECT doc_id, line_no, part_no, CASE line_no % 4 WHEN 2 THEN 'int' WHEN 3 THEN 'text' ELSE 'float' END AS kind,
 CASE WHEN line_no % 4 = 2 THEN -whole END AS long_value, CASE WHEN line_no % 4 < 2 THEN CAST(CAST(whole AS VARCHAR) || '.' || lpad(CAST(cents AS VARCHAR), 2, '0') AS DOUBLE) END AS double_value FROM money_text""")
def _(spark, d):
    m = money(spark, d).withColumn("v", numbers.parse_number(F.col("cell")))
    return m.select("doc_id", "line_no", "part_no", "v.kind", "v.long_value", "v.double_value")


_EDGE = {0: "'\t' || w || '\r\n'", 1: "'\u2003-' || w || '\u00a0'", 2: "w || '00000000000000000000'", 3: "'(' || w || '12345678901234567890)'", 4: "chr(28) || w || '.50'"}


@query("parse_number_edges", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN k = 4 THEN 'float' ELSE 'int' END AS kind, CASE k WHEN 0 THEN w WHEN 1 THEN '-' || w WHEN 2 THEN w || '00000000000000000000' WHEN 3 THEN '-' || w || '12345678901234567890' END AS digits,
 CASE k WHEN 0 THEN CAST(w AS BIGINT) WHEN 1 THEN -CAST(w AS BIGINT) END AS long_value, CASE WHEN k = 4 THEN CAST(w || '.5' AS DOUBLE) END AS double_value FROM (SELECT *, l_linenumber % 5 AS k, CAST(l_partkey + 1 AS VARCHAR) AS w FROM lineitem)""")
def _(spark, d):
    cell = F.expr("CASE l_linenumber % 5 " + " ".join(f"WHEN {k} THEN {x}" for k, x in _EDGE.items()) + " END")
    rows = table(spark, d, "lineitem").withColumn("w", (F.col("l_partkey") + 1).cast("string"))
    return rows.withColumn("v", numbers.parse_number(cell)).select("l_orderkey", "l_linenumber", "l_partkey", "v.kind", "v.digits", "v.long_value", "v.double_value")


@query("human_size", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s >= 1048576 THEN format('{:.2f} MB', s / 1048576.0) WHEN s >= 1024 THEN format('{:.2f} KB', s / 1024.0) ELSE format('{:.2f} B', s / 1.0) END AS size_text,
 regexp_replace(CASE WHEN s >= 1048576 THEN format('{:.2f}', round(s / 1048576.0, 2)) WHEN s >= 1024 THEN format('{:.2f}', round(s / 1024.0, 2)) ELSE format('{:.2f}', s / 1.0) END, '\\.?0+$', '') ||
 CASE WHEN s >= 1048576 THEN ' MB' WHEN s >= 1024 THEN ' KB' ELSE ' Bytes' END AS short_text
 FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_extendedprice) AS BIGINT) * (CASE WHEN l_linenumber = 1 THEN 16 ELSE 1 END) AS s FROM lineitem)""")
def _(spark, d):
    s = F.floor("l_extendedprice") * F.when(F.col("l_linenumber") == 1, 16).otherwise(1)
    li = table(spark, d, "lineitem").withColumn("s", s)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", numbers.human_size(F.col("s")).alias("size_text"), numbers.human_size_short(F.col("s")).alias("short_text"))


@query("resize_box", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN w0 * sh <= h0 * sw THEN w0 ELSE greatest(1, CAST(round_even(sw * h0 / sh, 0) AS BIGINT)) END AS w,
 CASE WHEN w0 * sh <= h0 * sw THEN greatest(1, CAST(round_even(sh * w0 / sw, 0) AS BIGINT)) ELSE h0 END AS h FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey + 10 AS DOUBLE) AS sw, CAST(l_suppkey + 10 AS DOUBLE) AS sh,
 CAST(l_quantity AS BIGINT) AS w0, CAST(l_linenumber * 10 AS BIGINT) AS h0 FROM lineitem)""")
def _(spark, d):
    box = numbers.resize_box(F.col("l_partkey") + F.lit(10), F.col("l_suppkey") + F.lit(10), F.col("l_quantity").cast("long"), (F.col("l_linenumber") * 10).cast("long"))
    return table(spark, d, "lineitem").withColumn("b", box).select("l_orderkey", "l_linenumber", "l_partkey", F.col("b.w").alias("w"), F.col("b.h").alias("h"))


@query("snap_size", f"""SELECT p_partkey, (SELECT s FROM (SELECT unnest({numbers.SIZE_STEPS}) AS s) ORDER BY abs(s - p_size * 1.37) / s, s LIMIT 1)::DOUBLE AS snapped FROM part""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", numbers.snap_size(F.col("p_size") * F.lit(1.37)).alias("snapped"))


@query("image_too_large", "SELECT p_partkey, p_size * 1000 * 600 > 15000000 AS too_large FROM part")
def _(spark, d):
    w, h = F.col("p_size").cast("long") * 1000, F.lit(600)
    return table(spark, d, "part").select("p_partkey", (w * h > 15000000).alias("too_large"))


@query("metadata_patch", """SELECT event_id, coalesce(CASE WHEN event_type = 'click' THEN 'new ' || CAST(user_id AS VARCHAR) END, 'old') AS title, coalesce(CASE WHEN event_type = 'view' THEN '' END, event_type) AS author,
 coalesce(json_extract_string(props, '$.missing'), '') AS subject, ts AS modified FROM events""")
def _(spark, d):
    from foliospark.functions.meta import metadata_patch
    e = table(spark, d, "events")
    old = {"title": F.lit("old"), "author": F.col("event_type"), "subject": F.get_json_object("props", "$.missing")}
    new = {"title": F.when(F.col("event_type") == "click", F.concat(F.lit("new "), F.col("user_id").cast("string"))),
           "author": F.when(F.col("event_type") == "view", "")}
    return e.select("event_id", *metadata_patch(old, new, F.col("ts")))
