"""Catalogue: addresses, URLs, paths, file types and request limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import meta, names, screen
from foliospark.operators import limits
from foliospark.plans.fixtures import ctes, table, view
from foliospark.plans.registry import query

_TRUST = "(regexp_matches({x}, '^10\\.') OR regexp_matches({x}, '^192\\.168\\.') OR regexp_matches({x}, '^172\\.(1[6-9]|2[0-9]|3[01])\\.') OR {x} IN ('127.0.0.1', '::1'))"


@query("rate_limit_scope", ctes("requests") + "SELECT seq, path FROM requests WHERE starts_with(path, '/api/')")
def _(spark, d):
    return view(spark, d, "requests").filter(screen.is_limited_path(F.col("path"))).select("seq", "path")


@query("trusted_proxy", ctes("requests") + f"SELECT seq, direct_ip, {_TRUST.format(x='direct_ip')} AS trusted FROM requests")
def _(spark, d):
    return view(spark, d, "requests").select("seq", "direct_ip", screen.is_trusted_proxy(F.col("direct_ip")).alias("trusted"))


@query("client_key", ctes("requests") + f"""SELECT seq, CASE WHEN {_TRUST.format(x='direct_ip')} AND xff IS NOT NULL THEN coalesce(list_filter(ips, lambda i : NOT {_TRUST.format(x='i')})[-1], ips[1]) ELSE direct_ip END AS client
 FROM (SELECT *, list_transform(string_split(xff, ','), lambda p : trim(p)) AS ips FROM requests)""")
def _(spark, d):
    return view(spark, d, "requests").select("seq", screen.client_key(F.col("direct_ip"), F.col("xff")).alias("client"))


@query("hash_ip", ctes("requests") + "SELECT seq, substr(sha256('app' || direct_ip), 1, 16) AS audit_hash, substr(sha256(direct_ip), 1, 16) AS usage_hash FROM requests")
def _(spark, d):
    ip = F.col("direct_ip")
    return view(spark, d, "requests").select("seq", screen.hash_ip(ip, "app").alias("audit_hash"), screen.hash_ip(ip).alias("usage_hash"))


@query("client_identifier", ctes("requests") + """SELECT seq, CASE WHEN api_key IS NOT NULL THEN 'key:' || substr(sha256(api_key), 1, 16) WHEN xff IS NOT NULL THEN 'ip:' || trim(string_split(xff, ',')[1]) ELSE 'ip:' || direct_ip END AS ident FROM requests""")
def _(spark, d):
    return view(spark, d, "requests").select("seq", screen.client_identifier(F.col("api_key"), F.col("xff"), F.col("direct_ip")).alias("ident"))


@query("audit_client", ctes("requests") + "SELECT seq, substr(sha256('app' || CASE WHEN xff IS NOT NULL THEN trim(string_split(xff, ',')[1]) ELSE direct_ip END), 1, 16) AS client_ip, substr(repeat('agent ' || seq || ' ', 60), 1, 500) AS user_agent FROM requests")
def _(spark, d):
    agent = F.repeat(F.concat(F.lit("agent "), F.col("seq").cast("string"), F.lit(" ")), F.lit(60))
    return view(spark, d, "requests").select("seq", screen.hash_ip(screen.first_forwarded(F.col("xff"), F.col("direct_ip")), "app").alias("client_ip"), F.substring(agent, 1, 500).alias("user_agent"))


@query("audit_details", ctes("audit") + """SELECT id, CASE event_type WHEN 'upload' THEN '{"file_name":"' || substr(repeat('n', 200) || repeat(CAST(id AS VARCHAR), 60), 1, 255) || '","file_size":"' || user_id || '"}'
 WHEN 'download' THEN '{"file_name":"' || substr(repeat('n', 200) || repeat(CAST(id AS VARCHAR), 60), 1, 255) || '"}' WHEN 'error' THEN '{"error_id":"' || id || '","error_type":"E"}' END AS details FROM audit""")
def _(spark, d):
    name = F.concat(F.repeat(F.lit("n"), F.lit(200)), F.repeat(F.col("id").cast("string"), F.lit(60)))
    fields = {"file_name": name, "file_size": F.col("user_id"), "error_id": F.col("id"), "error_type": F.lit("E")}
    return view(spark, d, "audit").select("id", meta.audit_details(F.col("event_type"), fields).alias("details"))


_URL = """CASE page_id % 20 WHEN 0 THEN 'ftp://' || h WHEN 1 THEN 'http://127.0.0.1/x' WHEN 2 THEN 'http://10.' || CAST(page_id % 256 AS STRING) || '.0.1/' WHEN 3 THEN 'http://a.internal/' || h
 WHEN 4 THEN 'http://user:pw@' || h WHEN 5 THEN 'http://' || h || ':6379/' WHEN 6 THEN 'http://224.0.0.' || CAST(page_id % 256 AS STRING) || '/' WHEN 7 THEN 'http:///nohost' WHEN 8 THEN 'HTTP://%6cocalhost/'
 WHEN 9 THEN '' WHEN 10 THEN 'http://[fe80::1]/' WHEN 11 THEN 'http://[::ffff:192.168.1.1]/' WHEN 12 THEN 'http://[::FFFF:c0a8:101]:80/' WHEN 13 THEN 'http://[0:0:0:0:0:0:0:1]/'
 WHEN 14 THEN 'http://[::ffff:a9fe:a9fe]/' WHEN 15 THEN 'http://[2606:4700::' || h || ']/' WHEN 16 THEN 'http://[2606:4700:4700::1111]/' WHEN 17 THEN 'http://[ff02::1]/' WHEN 18 THEN 'http://[4000::1]/' ELSE url END"""


@query("url_screen", """SELECT page_id, CASE page_id % 20 WHEN 0 THEN 'Protocol ''ftp'' is not allowed. Only HTTP and HTTPS are permitted.' WHEN 1 THEN 'Access to ''127.0.0.1'' is not allowed'
 WHEN 2 THEN 'URL resolves to private IP address (10.' || (page_id % 256) || '.0.1)' WHEN 3 THEN 'Access to internal domain ''a.internal'' is not allowed' WHEN 4 THEN 'URLs with embedded credentials are not allowed'
 WHEN 5 THEN 'Access to port 6379 is not allowed' WHEN 6 THEN 'URL resolves to multicast address (224.0.0.' || (page_id % 256) || ')' WHEN 7 THEN 'Invalid URL: missing hostname' WHEN 8 THEN 'Access to ''localhost'' is not allowed'
 WHEN 9 THEN 'URL is required' WHEN 10 THEN 'URL resolves to private IP address (fe80::1)'
 WHEN 11 THEN 'URL resolves to private IP address (::ffff:192.168.1.1)' WHEN 12 THEN 'URL resolves to private IP address (::ffff:c0a8:101)' WHEN 13 THEN 'URL resolves to private IP address (0:0:0:0:0:0:0:1)'
 WHEN 14 THEN 'URL resolves to private IP address (::ffff:a9fe:a9fe)' WHEN 17 THEN 'URL resolves to multicast address (ff02::1)' WHEN 18 THEN 'URL resolves to reserved IP address (4000::1)' END AS message FROM pages""")
def _(spark, d):
    p = table(spark, d, "pages").withColumn("h", F.regexp_extract("url", "://([^/?#]*)", 1)).withColumn("u", F.expr(_URL))
    return p.select("page_id", screen.url_screen(F.col("u")).alias("message"))


_PATH = "CASE page_id % 4 WHEN 0 THEN '/srv/up/a/../' || CAST(page_id AS STRING) WHEN 1 THEN '../x' WHEN 2 THEN 'sub/./../../up/' || CAST(page_id AS STRING) ELSE '/srv/upper/' || CAST(page_id AS STRING) END"


@query("path_inside", "SELECT page_id, page_id % 4 IN (0, 2) AS inside FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", screen.path_inside(F.expr(_PATH), "/srv/up").alias("inside"))


_HEAD = "CASE page_id % 8 WHEN 0 THEN '255044462D' WHEN 1 THEN 'FFD8FFE0' WHEN 2 THEN '504B0304' WHEN 3 THEN '474946383961' WHEN 4 THEN 'D0CF11E0A1B11AE1' WHEN 5 THEN '424D' WHEN 6 THEN '' ELSE '3C21' END"
_DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
_XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"


def _content():
    return F.concat(F.unhex(F.expr(_HEAD)), F.encode("html", "UTF-8"))


@query("mime_by_magic", f"SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN '{_DOCX}' WHEN 3 THEN 'image/gif' WHEN 4 THEN 'application/msword' WHEN 5 THEN 'image/bmp' END AS mime FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", screen.mime_by_magic(_content()).alias("mime"))


@query("type_allowed", f"""SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN '{_XLSX}' WHEN 3 THEN 'image/gif' ELSE dec END AS detected,
 CASE WHEN page_id % 8 > 3 AND dec = 'image/png' THEN 'File content does not match its type ''image/png''.' WHEN page_id % 8 IN (1, 3) THEN 'type not allowed' WHEN page_id % 8 > 3 AND dec <> 'text/html' THEN 'type not allowed' END AS error
 FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/html' ELSE 'text/css' END AS dec FROM pages)""")
def _(spark, d):
    declared = F.expr("CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/html' ELSE 'text/css' END")
    t = table(spark, d, "pages").withColumn("t", screen.allowed_type(_content(), declared, ["application/pdf", _XLSX, "text/html"]))
    return t.select("page_id", "t.detected", "t.error")


_EXT = "CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.exe' ELSE '.doc' END"
_MIS = """CASE page_id % 8 WHEN 0 THEN e <> '.pdf' WHEN 1 THEN e <> '.jpeg' WHEN 2 THEN e <> '.xlsx' WHEN 3 THEN true WHEN 4 THEN e <> '.doc' WHEN 5 THEN true ELSE false END"""


@query("mime_vs_extension", f"SELECT page_id, CASE WHEN {_MIS} THEN 'File content does not match extension ''' || e || '''' END AS message FROM (SELECT page_id, lower({_EXT}) AS e FROM pages)")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", screen.mime_mismatch(F.expr(_EXT), screen.mime_by_magic(_content())).alias("message"))


@query("upload_validation", f"""SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'Filename is required' WHEN e = '.exe' THEN 'File extension ''.exe'' not allowed. Allowed: .doc, .jpeg, .pdf, .xlsx' WHEN page_id % 13 = 0 THEN 'File is empty'
 WHEN page_id % 17 = 0 THEN 'File size exceeds maximum allowed size of 100MB' WHEN {_MIS} THEN 'File content does not match extension ''' || e || '''' END AS message FROM (SELECT page_id, lower({_EXT}) AS e FROM pages)""")
def _(spark, d):
    name = F.when(F.col("page_id") % 11 != 0, F.col("url"))
    size = F.when(F.col("page_id") % 17 == 0, 104857601).otherwise(F.length("html"))
    content = F.when(F.col("page_id") % 13 == 0, F.unhex(F.lit(""))).otherwise(_content())
    e = screen.upload_error(name, F.expr(_EXT), size, content, [".pdf", ".jpeg", ".xlsx", ".doc"])
    return table(spark, d, "pages").select("page_id", e.alias("message"))


_FIXED = ctes("requests", more="""c AS (SELECT *, count(*) OVER (PARTITION BY client, sec ORDER BY seq) AS s, count(*) OVER (PARTITION BY client, sec // 60 ORDER BY sec, seq) AS m,
 count(*) OVER (PARTITION BY client, sec // 3600 ORDER BY sec, seq) AS h FROM requests), k AS (SELECT *, CASE WHEN s > 10 THEN 'burst' WHEN m > 60 THEN 'minute' WHEN h > 1000 THEN 'hour' END AS kind FROM c)""")


@query("fixed_window_limit", _FIXED + "SELECT seq, client, s AS in_second, m AS in_minute, h AS in_hour, kind AS limit_type, CASE kind WHEN 'burst' THEN 1 WHEN 'minute' THEN 60 - sec % 60 WHEN 'hour' THEN 3600 - sec % 3600 END AS retry_after, kind IS NULL AS allowed FROM k")
def _(spark, d):
    return limits.fixed_window(view(spark, d, "requests")).select("seq", "client", "in_second", "in_minute", "in_hour", "limit_type", "retry_after", "allowed")


@query("remaining_quota", _FIXED + "SELECT seq, 60 AS lim, greatest(0, 60 - m) AS remaining, (sec // 60 + 1) * 60 AS reset FROM k")
def _(spark, d):
    lim, left, reset = limits.quota_headers(F.col("in_minute"), F.col("sec"))
    return limits.fixed_window(view(spark, d, "requests")).select("seq", lim.alias("lim"), left.alias("remaining"), reset.alias("reset"))


def sliding_sql(who: str, where: str, minute: int, hour: int) -> str:
    """Requests walked one by one per client; the state is the list of accepted times of the last hour."""
    return ctes("requests").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""", e AS (SELECT {who} AS client, sec::DOUBLE AS t, seq, row_number() OVER (PARTITION BY {who} ORDER BY sec, seq) AS i FROM requests WHERE {where}),
 r AS (SELECT client, seq, i, true AS allowed, NULL::VARCHAR AS limit_type, NULL::BIGINT AS retry_after, [t] AS acc FROM e WHERE i = 1
  UNION ALL SELECT client, seq, i, kind IS NULL, kind, CASE kind WHEN 'burst' THEN 1 WHEN 'minute' THEN floor(m[1] + 60 - t)::BIGINT + 1 WHEN 'hour' THEN floor(a[1] + 3600 - t)::BIGINT + 1 END, CASE WHEN kind IS NULL THEN list_append(a, t) ELSE a END FROM (
   SELECT *, CASE WHEN len(list_filter(m, lambda x: x > t - 1)) >= 10 THEN 'burst' WHEN len(m) >= {minute} THEN 'minute' WHEN len(a) >= {hour} THEN 'hour' END AS kind FROM (
    SELECT *, list_filter(a, lambda x: x > t - 60) AS m FROM (SELECT e.*, list_filter(r.acc, lambda x: x > e.t - 3600) AS a FROM r JOIN e ON e.client = r.client AND e.i = r.i + 1))))
 SELECT seq, client, allowed, limit_type, retry_after FROM r"""


_SLIDING = sliding_sql("client", "true", 60, 1000)
_ENDPOINT = sliding_sql("client || '|' || path", "starts_with(path, '/api/')", 30, 500)


@query("sliding_limiter", _SLIDING)
def _(spark, d):
    r = view(spark, d, "requests").select("client", F.col("sec").alias("t"), "seq")
    return limits.sliding_window(spark, r).select("seq", "client", "allowed", "limit_type", "retry_after")


@query("endpoint_limiter", _ENDPOINT)
def _(spark, d):
    r = view(spark, d, "requests").filter(screen.is_limited_path(F.col("path")))
    r = r.select(F.concat_ws("|", "client", "path").alias("client"), F.col("sec").alias("t"), "seq")
    return limits.sliding_window(spark, r, limits.ENDPOINT_LIMITS).select("seq", "client", "allowed", "limit_type", "retry_after")
