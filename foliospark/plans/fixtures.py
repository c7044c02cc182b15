"""Views that give the driver tables the role of document-service tables.

A view is a base (table or other view) plus select expressions in SQL that both Spark and
DuckDB read the same way, so that one text yields the DataFrame and the CTE. Views that need
array functions carry one text per dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.binding import let
from foliospark.sources.tables import scan_table

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

NOW = "2001-01-01 00:00:00"
TOOLS_CASE = ("CASE o_orderpriority WHEN '1-URGENT' THEN 'pdf_split' WHEN '2-HIGH' THEN 'pdf_ocr' "
              "WHEN '3-MEDIUM' THEN 'image_resize' WHEN '4-NOT SPECIFIED' THEN 'document_convert' "
              "ELSE 'qr_make' END")

VIEWS: dict[str, tuple[str, list[str]]] = {
    "tasks": ("orders", [
        "o_orderkey AS task_id",
        "o_custkey AS user_id",
        f"{TOOLS_CASE} AS tool_type",
        "CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'processing' ELSE 'completed' END AS status",
        "o_orderdate AS created_at",
        "CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 3 MINUTE END AS completed_at",
        "CASE WHEN o_orderstatus = 'P' THEN 'slow' END AS error_message",
    ]),
    "outputs": ("lineitem", [
        "l_orderkey AS task_id",
        "l_linenumber AS line_no",
        "l_partkey AS part_no",
        "CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey AS STRING) AS file_id",
        "CAST(floor(l_extendedprice) AS BIGINT) AS file_size",
        "l_shipdate AS expires_at",
        "'/srv/processed/' || substr(md5(CAST(l_orderkey AS STRING)), 1, 12) || CASE WHEN l_returnflag = 'R' THEN '-' ELSE '_' END || CAST(l_partkey AS STRING) || '.pdf' AS file_path",
    ]),
    "inputs": ("lineitem", [
        "l_orderkey AS task_id",
        "l_linenumber AS upload_order",
        "CAST(floor(l_extendedprice * 20) AS BIGINT) AS file_size",
        "CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_in.pdf' AS stored_name",
        "l_shipdate AS created_at",
    ]),
    "audit": ("events", [
        "event_id AS id",
        "CASE event_type WHEN 'click' THEN 'upload' WHEN 'view' THEN 'download' WHEN 'purchase' THEN 'process' WHEN 'signup' THEN 'access' ELSE 'error' END AS event_type",
        "user_id",
        "md5(CAST(user_id AS STRING)) AS client_ip",
        "ts AS created_at",
    ]),
    "usage_log": ("events", [
        "event_id AS id",
        "user_id",
        "ts",
        "CASE event_type WHEN 'click' THEN 'pdf_merge' WHEN 'view' THEN 'pdf_ocr' WHEN 'purchase' THEN 'image_resize' WHEN 'signup' THEN 'document_convert' ELSE 'qr_make' END AS tool_type",
        "CAST(floor(value * 100000) AS BIGINT) AS file_size",
    ]),
    "status_log": ("events", [
        "user_id AS task_id",
        "event_id AS seq",
        "ts",
        "CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'pending' ELSE 'failed' END AS status",
        "CAST(floor(value) AS BIGINT) % 101 AS progress",
        "CASE WHEN event_type = 'error' THEN 'error ' || CAST(event_id AS STRING) END AS error_message",
    ]),
    "page_text": ("conversations", [
        "conv_id AS doc_id", "CAST(turn AS BIGINT) + 1 AS page_no", "role", "text",
    ]),
    "stored_names": ("orders", [
        "o_orderkey AS file_no",
        "o_custkey AS job",
        "md5(CAST(o_orderkey AS STRING)) || '_' || CAST(1700000000 + o_orderkey AS STRING) || '_' || CAST(o_orderkey % 20 AS STRING) || '_' || "
        "CASE o_orderstatus WHEN 'O' THEN 'Report  ' WHEN 'P' THEN '__draft;' ELSE 'caf' || CASE WHEN o_orderkey % 2 = 0 THEN chr(233) ELSE 'e\u0301' END || '..' END || o_orderpriority || '_.pdf' AS stored_name",
        "CASE o_orderstatus WHEN 'O' THEN 'report' WHEN 'P' THEN 'report_2' ELSE 'scan' END || '.pdf' AS arcname",
    ]),
    "money_text": ("lineitem", [
        "l_orderkey AS doc_id", "l_linenumber AS line_no", "l_partkey AS part_no",
        "CAST(floor(l_extendedprice) AS BIGINT) AS whole",
        "CAST(round(l_extendedprice * 100) AS BIGINT) % 100 AS cents",
    ]),
}

# Views whose text differs between the dialects: (base, Spark expressions, DuckDB SELECT).
_GRID = [
    "doc_id",
    "CAST(floor(i / 432) AS BIGINT) + 1 AS page_no",
    "CAST(floor(i / 54) AS BIGINT) AS par",
    "(CAST(floor(i / 54) AS BIGINT) % 8) * 5 + CAST(floor((i % 54) / 12) AS BIGINT) AS line_no",
    "(i % 54) % 12 AS word_no",
    "text",
    "CAST(72 + 40 * ((i % 54) % 12) AS DOUBLE) AS x0",
    "CAST(72 + 40 * ((i % 54) % 12) + least(36, 4 * length(text)) AS DOUBLE) AS x1",
    "CAST(72 + 14 * ((CAST(floor(i / 54) AS BIGINT) % 8) * 5 + CAST(floor((i % 54) / 12) AS BIGINT)) + 6 * (CAST(floor(i / 54) AS BIGINT) % 8) AS DOUBLE) AS y0",
    "CAST(95 - (length(text) * 7) % 75 AS DOUBLE) AS conf",
    "CAST(CASE WHEN i % 432 < 12 THEN 16 ELSE 11 END AS DOUBLE) AS fsize",
]
_DIALECT = {
    "line_text": (
        "documents",
        ["doc_id", "lang", "source", "posexplode(split(text, '\\n')) AS (line_no, text)"],
        "SELECT doc_id, lang, source, unnest(range(len(string_split(text, chr(10))))) AS line_no, "
        "unnest(string_split(text, chr(10))) AS text FROM documents",
    ),
    "flat_words": (
        "documents",
        ["doc_id", "posexplode(filter(split(text, '[ \\n]'), w -> w <> '')) AS (i, text)"],
        "SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS text FROM (SELECT doc_id, "
        "list_filter(string_split_regex(text, '[ \\n]'), lambda w : w <> '') AS ws FROM documents)",
    ),
}
VIEWS["grid_words"] = ("flat_words", _GRID)
VIEWS["words"] = ("grid_words", ["*", "y0 + fsize AS y1"])
VIEWS["two_col_words"] = ("words", [
    "doc_id", "page_no", "par", "line_no % 20 AS line_no",
    "CASE WHEN line_no >= 20 THEN 1 ELSE 0 END AS side", "word_no", "text",
    "x0 + CASE WHEN line_no >= 20 THEN 560 ELSE 0 END AS x0",
    "x1 + CASE WHEN line_no >= 20 THEN 560 ELSE 0 END AS x1",
    "y0 - CASE WHEN line_no >= 20 THEN 304 ELSE 0 END AS y0",
    "y1 - CASE WHEN line_no >= 20 THEN 304 ELSE 0 END AS y1",
    "conf", "fsize",
])
VIEWS["requests"] = ("events", [
    "event_id AS seq",
    "ts",
    "1704067200 + event_id % 7200 AS sec",
    "CAST('10.0.0.' || CAST(user_id % 5 AS STRING) AS STRING) AS client",
    "CASE WHEN user_id % 3 = 0 THEN '203.0.113.' ELSE '10.1.2.' END || CAST(user_id % 200 AS STRING) AS direct_ip",
    "CASE WHEN user_id % 4 = 0 THEN NULL WHEN user_id % 4 = 1 THEN '198.51.100.' || CAST(user_id AS STRING) || ', 192.168.0.7, 10.0.0.9' "
    "WHEN user_id % 4 = 2 THEN '10.9.9.9, 172.16.3.4' ELSE ' 8.8.8.8 , 203.0.113.9, 127.0.0.1' END AS xff",
    "CASE event_type WHEN 'click' THEN '/api/v1/pdf' WHEN 'view' THEN '/health' WHEN 'purchase' THEN '/docs' WHEN 'signup' THEN '/api/v1/image' ELSE '/blog' END AS path",
    "CASE WHEN user_id % 7 = 0 THEN 'k' || CAST(user_id AS STRING) END AS api_key",
])


def _duck(text: str) -> str:
    return text.replace("AS STRING)", "AS VARCHAR)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan_table(spark, f"{sf_dir}/{name}.parquet")


#: Characters of text whose words one task takes: some hundred thousand, so that a task sorts them in memory.
TEXT_PER_TASK = 4_000_000


def _paged_words(documents: DataFrame) -> DataFrame:
    """``flat_words`` with their ``page_no``, hashed by document and page.

    Pages are dealt before they become words: only text is moved, and whatever is keyed or joined by document and page
    finds its rows in place. The number of parts grows with the text, so a task's share does not.
    """
    spark = documents.sparkSession
    length = F.col("n_chars") if "n_chars" in documents.columns else F.length("text")
    chars = documents.agg(F.sum(length.cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // TEXT_PER_TASK))
    words = F.expr("filter(split(text, '[ \\n]'), w -> w <> '')")
    pages = let(words, lambda ws: F.when(F.size(ws) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / 432).cast("int")), lambda p: F.array_join(F.slice(ws, p * 432 + 1, 432), " "))))
    paged = documents.select("doc_id", F.posexplode(pages).alias("p", "ws")).select("doc_id", (F.col("p").cast("long") + 1).alias("page_no"), "ws")
    words = paged.repartition(parts, "doc_id", "page_no").select("doc_id", "page_no", F.posexplode(F.split("ws", " ")).alias("j", "text"))
    return words.select("doc_id", "page_no", ((F.col("page_no").cast("int") - 1) * 432 + F.col("j")).alias("i"), "text")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view (or driver table) as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    if name in _DIALECT:
        base, exprs, _ = _DIALECT[name]
    else:
        base, exprs = VIEWS[name]
    if name == "grid_words":
        # The page number is there before the words are.
        return _paged_words(view(spark, sf_dir, "documents")).selectExpr(*["page_no" if e.endswith(" AS page_no") else e for e in exprs])
    rows = view(spark, sf_dir, base)
    return rows.selectExpr(*exprs)


def _body(name: str) -> tuple[str, str]:
    if name in _DIALECT:
        base, _, sql = _DIALECT[name]
        return base, sql
    base, exprs = VIEWS[name]
    return base, _duck(f"SELECT {', '.join(exprs)} FROM {base}")


def ctes(*names: str, more: str = "") -> str:
    """``WITH`` clause for the named views and the views they stand on, plus extra CTEs."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES or name in done:
            return
        base, sql = _body(name)
        add(base)
        done[name] = sql

    for name in names:
        add(name)
    parts = [f"{n} AS ({s})" for n, s in done.items()]
    if more:
        parts.append(more.strip().rstrip(","))
    return "WITH " + ", ".join(parts) + " " if parts else ""


def now() -> F.Column:
    """The fixed clock of the catalogue; queries never read the wall clock."""
    return F.expr(f"TIMESTAMP_NTZ '{NOW}'")
