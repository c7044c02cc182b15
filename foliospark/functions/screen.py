"""Addresses, URLs, paths and file types as column expressions."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.binding import let, let_all

# Proxies whose forwarding header is believed.
TRUSTED_PROXIES = ["127.0.0.1", "::1", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"]
# Paths without a request limit.
UNLIMITED_PATHS = ["/health", "/docs", "/openapi.json"]
# Hosts, suffixes, networks and ports a fetched URL must not name.
DENIED_HOSTS = ["localhost", "localhost.localdomain", "127.0.0.1", "0.0.0.0", "::1", "[::1]", "0", "metadata.google.internal", "169.254.169.254"]
INTERNAL_SUFFIX = r"\.(internal|local|localhost|localdomain)$"
PRIVATE_NETWORKS = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.170/31",
                    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4"]
MULTICAST_NETWORKS = ["224.0.0.0/4"]
# Special IPv6 ranges, as patterns over the 32 hexadecimal digits of an address.
PRIVATE_V6 = r"^0{31}[01]$|^0064ff9b0001|^0100(0{12})|^20010[01]|^20010db8|^2002|^3fff0|^f[cd]|^fe[89ab]"
PUBLIC_V6 = r"^2001000[1](0{23})[12]$|^20010003|^200100040112|^2001002|^2001003"
RESERVED_V6 = r"^00|^01|^0[2-9a-f]|^1|^[4-9a-e]|^f[0-9ab]|^fe[0-7]"
MULTICAST_V6 = r"^ff"
BLOCKED_PORTS = [22, 23, 25, 445, 3306, 5432, 6379, 27017, 9200, 11211]

V4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"


def hash_ip(ip: Column, salt: str = "") -> Column:
    """First 16 hex digits of the SHA-256; audit rows salt it with the application name, usage rows do not."""
    return F.substring(F.sha2(F.concat(F.lit(salt), ip), 256), 1, 16)


def ipv4_number(ip: Column) -> Column:
    """Dotted address as a number; null for anything else."""
    parts = F.transform(F.split(ip, r"\."), lambda p: p.try_cast("long"))
    return F.when(ip.rlike(V4), F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x))


def in_networks(ip: Column, networks: list[str]) -> Column:
    """Inside any of a fixed list of networks; as constants they need no join."""
    nets = [ipaddress.ip_network(n, strict=False) for n in networks]
    v4 = [(int(n[0]), int(n[-1])) for n in nets if n.version == 4]
    v6 = [str(n[0]) for n in nets if n.version == 6 and n.num_addresses == 1]
    inside = let(ipv4_number(ip), lambda n: reduce(lambda a, b: a | b, [n.between(lo, hi) for lo, hi in v4]))
    return F.coalesce(inside, ip.isin(v6) if v6 else F.lit(False), F.lit(False))


def is_trusted_proxy(ip: Column, networks: list[str] = TRUSTED_PROXIES) -> Column:
    return in_networks(ip, networks)


def client_key(direct: Column, xff: Column, networks: list[str] = TRUSTED_PROXIES) -> Column:
    """Address a request counts for: behind trusted proxies the rightmost untrusted one."""
    chain = F.transform(F.split(xff, ","), lambda p: F.trim(p))

    def pick(ips: Column) -> Column:
        outside = F.filter(ips, lambda ip: ~is_trusted_proxy(ip, networks))
        return let(outside, lambda o: F.when(F.size(o) > 0, F.get(o, F.size(o) - 1)).otherwise(F.get(ips, F.lit(0))))

    use = is_trusted_proxy(direct, networks) & F.coalesce(xff != "", F.lit(False))
    return F.when(use, let(chain, pick)).otherwise(direct)


def client_identifier(api_key: Column, xff: Column, direct: Column) -> Column:
    key = F.concat(F.lit("key:"), F.substring(F.sha2(api_key, 256), 1, 16))
    return F.coalesce(key, F.concat(F.lit("ip:"), first_forwarded(xff, direct)))


def first_forwarded(xff: Column, direct: Column) -> Column:
    first = F.trim(F.split_part(xff, F.lit(","), F.lit(1)))
    return F.when(F.coalesce(xff, F.lit("")) != "", first).otherwise(F.coalesce(direct, F.lit("unknown")))


def is_limited_path(path: Column) -> Column:
    return path.startswith("/api/") & ~path.isin(UNLIMITED_PATHS)


def normal_path(path: Column) -> Column:
    """Absolute path with ``.`` and ``..`` resolved; links cannot be resolved from rows."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(
        p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def path_inside(path: Column, base: str) -> Column:
    base = "/" + base.strip("/")
    absolute = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base + "/"), path))
    return let(normal_path(absolute), lambda p: (p == base) | p.startswith(base + "/"))


def v6_digits(host: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 literal in any form (``::``, dotted end, zone), else null."""
    def finish(v: Column) -> Column:
        def groups(part: Column) -> Column:
            return F.filter(F.split(part, ":"), lambda g: g != "")

        def full(g: Column) -> Column:
            missing = 8 - F.size(g["left"]) - F.size(g["right"])
            zeros = F.repeat(F.lit("0000"), F.greatest(missing, F.lit(0)))
            digits = F.concat(F.array_join(F.transform(g["left"], lambda x: F.lpad(x, 4, "0")), ""), zeros, F.array_join(F.transform(g["right"], lambda x: F.lpad(x, 4, "0")), ""))
            valid = v["text"].rlike("^[0-9a-f:]+$") & ~v["text"].rlike("[0-9a-f]{5}|:::|::.*::|^:[^:]|[^:]:$") & F.when(v["text"].contains("::"), missing >= 1).otherwise(missing == 0)
            return F.when(valid, digits)

        return let_all(full, left=groups(F.split_part(v["text"], F.lit("::"), F.lit(1))), right=groups(F.substring_index(F.concat(v["text"], F.when(v["text"].contains("::"), "").otherwise("::")), "::", -1)))

    dotted = r"^(.*:)(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    low = F.lower(F.regexp_replace(host, "%.*$", ""))

    def plain(t: Column) -> Column:
        pair = [F.lpad(F.lower(F.hex(F.regexp_extract(t, dotted, n).try_cast("int"))), 2, "0") for n in (2, 3, 4, 5)]
        return F.when(t.rlike(dotted), F.concat(F.regexp_extract(t, dotted, 1), pair[0], pair[1], F.lit(":"), pair[2], pair[3])).otherwise(t)

    return let(low, lambda t: let_all(finish, text=plain(t)))


def mapped_v4(digits: Column) -> Column:
    """Dotted form of an IPv4-mapped IPv6 address, else null."""
    parts = [F.conv(F.substring(digits, n, 2), 16, 10) for n in (25, 27, 29, 31)]
    return F.when(digits.rlike("^0{20}ffff"), F.concat_ws(".", *parts))


def url_screen(url: Column) -> Column:
    """Message of the first rule a URL breaks, or null when it may be fetched."""
    decoded = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)

    def rules(v: Column) -> Column:
        host, low = v["host"], F.lower(v["host"])
        v6 = F.when(v["v4"].isNull(), v["v6"])
        four = F.coalesce(v["v4"], low)
        private = in_networks(four, PRIVATE_NETWORKS) | F.coalesce(v6.rlike(PRIVATE_V6) & ~v6.rlike(PUBLIC_V6), F.lit(False))
        reserved = F.coalesce(v6.rlike(RESERVED_V6), F.lit(False))
        multicast = in_networks(four, MULTICAST_NETWORKS) | F.coalesce(v6.rlike(MULTICAST_V6), F.lit(False))
        return F.coalesce(
            F.when(~F.lower(v["scheme"]).isin("http", "https"),
                   F.concat(F.lit("Protocol '"), F.lower(v["scheme"]), F.lit("' is not allowed. Only HTTP and HTTPS are permitted."))),
            F.when(host == "", "Invalid URL: missing hostname"),
            F.when(low.isin(DENIED_HOSTS), F.concat(F.lit("Access to '"), low, F.lit("' is not allowed"))),
            F.when(low.rlike(INTERNAL_SUFFIX), F.concat(F.lit("Access to internal domain '"), low, F.lit("' is not allowed"))),
            F.when(private, F.concat(F.lit("URL resolves to private IP address ("), low, F.lit(")"))),
            F.when(reserved, F.concat(F.lit("URL resolves to reserved IP address ("), low, F.lit(")"))),
            F.when(multicast, F.concat(F.lit("URL resolves to multicast address ("), low, F.lit(")"))),
            F.when(v["user"].rlike("[^:]"), "URLs with embedded credentials are not allowed"),
            F.when(v["port"].try_cast("int").isin(BLOCKED_PORTS),
                   F.concat(F.lit("Access to port "), v["port"].try_cast("int").cast("string"), F.lit(" is not allowed"))))

    def addressed(v: Column) -> Column:
        six = F.when(v["host"].contains(":"), v6_digits(v["host"]))
        return let(six, lambda x: let_all(rules, scheme=v["scheme"], user=v["user"], host=v["host"], port=v["port"], v6=x, v4=mapped_v4(x)))

    def parts(n: Column) -> Column:
        return let_all(addressed, scheme=F.regexp_extract(n["url"], r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1),
                       user=F.regexp_extract(n["net"], r"^(.*)@", 1),
                       host=F.concat(F.regexp_extract(n["net"], r"^(?:.*@)?\[([^\]]*)\]", 1), F.regexp_extract(n["net"], r"^(?:.*@)?([^:\[@]*)(?::[^@]*)?$", 1)),
                       port=F.regexp_extract(n["net"], r":([0-9]+)$", 1))

    split = let(decoded, lambda u: let_all(parts, url=u, net=F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)))
    return F.when(F.coalesce(url, F.lit("")) == "", "URL is required").otherwise(split)


_OFFICE = "application/vnd.openxmlformats-officedocument."
_ODF = "application/vnd.oasis.opendocument."

# Leading bytes (hex) of each type, in the order they are tried.
SIGNATURES = [
    ("application/pdf", ["255044462D"]), ("image/jpeg", ["FFD8FF"]), ("image/png", ["89504E470D0A1A0A"]),
    ("image/gif", ["474946383761", "474946383961"]), ("image/webp", ["52494646", "57454250"]), ("image/bmp", ["424D"]),
    ("image/tiff", ["49492A00", "4D4D002A"]), (_OFFICE + "wordprocessingml.document", ["504B0304"]),
    ("application/msword", ["D0CF11E0A1B11AE1"]), ("application/zip", ["504B0506", "504B0708"]),
]
# The shorter signature list of the upload check.
UPLOAD_SIGNATURES = [
    ("application/pdf", ["25504446"]), ("image/jpeg", ["FFD8FF"]), ("image/png", ["89504E470D0A1A0A"]), ("image/gif", ["474946383761", "474946383961"]),
    ("image/webp", ["52494646"]), (_OFFICE + "wordprocessingml.document", ["504B0304"]), (_OFFICE + "spreadsheetml.sheet", ["504B0304"]),
]
# Extensions of each type; the ZIP family shares its own.
TYPE_EXTENSIONS = {
    "application/pdf": [".pdf"], "image/jpeg": [".jpg", ".jpeg"], "image/png": [".png"], "image/gif": [".gif"], "image/webp": [".webp"],
    "image/bmp": [".bmp"], "image/tiff": [".tif", ".tiff"], "application/msword": [".doc"],
}
ZIP_FAMILY = [_OFFICE + "wordprocessingml.document", _OFFICE + "spreadsheetml.sheet", _OFFICE + "presentationml.presentation",
              _ODF + "text", _ODF + "spreadsheet", _ODF + "presentation"]
ZIP_EXTENSIONS = [".docx", ".xlsx", ".pptx", ".odt", ".ods", ".odp"]
MAX_UPLOAD = 104857600


def _starts(content: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(content, F.unhex(F.lit(p))) for p in prefixes])


def mime_by_magic(content: Column) -> Column:
    """Type of the first matching signature."""
    return F.coalesce(*[F.when(_starts(content, sigs), mime) for mime, sigs in SIGNATURES])


def allowed_type(content: Column, declared: Column, allowed: list[str]) -> Column:
    """Struct (detected, error): a shared signature prefers an allowed type.

    The declared type is trusted only when no signature is known for it.
    """
    matching = F.filter(F.array(*[F.when(_starts(content, sigs), mime) for mime, sigs in UPLOAD_SIGNATURES]), lambda m: m.isNotNull())

    def decide(m: Column) -> Column:
        preferred = F.get(F.filter(m, lambda x: x.isin(allowed)), F.lit(0))
        detected = F.coalesce(preferred, F.get(m, F.lit(0)), declared)
        mismatch = (F.size(m) == 0) & declared.isin([t for t, _ in UPLOAD_SIGNATURES])
        error = (F.when(mismatch, F.concat(F.lit("File content does not match its type '"), declared, F.lit("'.")))
                 .when(~F.coalesce(detected.isin(allowed), F.lit(False)), "type not allowed"))
        return F.struct(detected.alias("detected"), error.alias("error"))

    return let(matching, decide)


def mime_mismatch(extension: Column, mime: Column) -> Column:
    """Message when a detected type does not go with the extension (with its dot)."""
    def check(v: Column) -> Column:
        fits = F.when(v["mime"].isin(ZIP_FAMILY), v["ext"].isin(ZIP_EXTENSIONS))
        for t, exts in TYPE_EXTENSIONS.items():
            fits = fits.when(v["mime"] == t, v["ext"].isin(exts))
        return F.when(~F.coalesce(fits, F.lit(True)), F.concat(F.lit("File content does not match extension '"), v["ext"], F.lit("'")))

    return let_all(check, mime=mime, ext=F.lower(extension))


def upload_error(name: Column, extension: Column, size: Column, content: Column, allowed: list[str]) -> Column:
    """First failed check of an upload: name, extension, empty, size, content."""
    listing = ", ".join(sorted(allowed))
    return F.coalesce(
        F.when(F.coalesce(name, F.lit("")) == "", "Filename is required"),
        F.when(~F.lower(extension).isin(allowed), F.concat(F.lit("File extension '"), F.lower(extension), F.lit(f"' not allowed. Allowed: {listing}"))),
        F.when(F.length(content) == 0, "File is empty"),
        F.when(size > MAX_UPLOAD, f"File size exceeds maximum allowed size of {MAX_UPLOAD // 1048576}MB"),
        mime_mismatch(extension, mime_by_magic(content)))
