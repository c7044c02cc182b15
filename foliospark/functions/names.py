"""File and download names as column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.binding import let, let_all

# Prefix of stored names, reserved device names, length limits.
STORAGE_PREFIX = r"(?i)^(?:[a-f0-9]{32}_[0-9]{9,11}(?:_[0-9]{1,3}(?=_|$))?(?:_|$))+"
RESERVED_NAMES = ["con", "prn", "aux", "nul", *[f"com{i}" for i in range(1, 10)], *[f"lpt{i}" for i in range(1, 10)]]
MAX_STEM, MULTI_PART, MAX_ORIGINAL_BYTES, MAX_STORED_BYTES, MAX_STORED_STEM, MAX_EXT = 80, 30, 200, 255, 50, 10


def _normaliser(form: str):
    @F.arrow_udf(T.StringType())
    def run(s: pa.Array) -> pa.Array:
        # Few rows at a time become Python strings; rows that are in the form already stay as they are.
        done = []
        for i in range(0, len(s), 256):
            part = s.slice(i, 256)
            texts = part.to_pylist()
            if not all(v is None or unicodedata.is_normalized(form, v) for v in texts):
                part = pa.array([None if v is None else unicodedata.normalize(form, v) for v in texts], s.type)
            done.append(part)
        return pa.concat_arrays(done) if done else s

    return run


_NORMAL = {form: _normaliser(form) for form in ("NFC", "NFKC", "NFKD")}


def unicode_normalize(text: Column, form: str) -> Column:
    """Unicode normal form of a text. Spark has no such function, so this is an Arrow UDF."""
    return _NORMAL[form](text)


def strip_prefix(stem: Column) -> Column:
    return F.regexp_replace(stem, STORAGE_PREFIX, "")


def _strip(text: Column, chars: str = r" _\-.") -> Column:
    return F.regexp_replace(text, rf"^[{chars}]+|[{chars}]+$", "")


def clean_stem(stem: Column, fallback: str = "file") -> Column:
    """Tidy stem from an NFC text: odd characters to ``_``, runs collapsed, at most 80 characters."""
    s = F.regexp_replace(stem, r"[^\p{L}\p{N}\p{M} _\-.]", "_")
    s = F.regexp_replace(s, r" +", " ")
    s = F.regexp_replace(s, r" *_[ _]*", "_")
    s = _strip(F.regexp_replace(s, r"\.{2,}", "."))
    s = F.regexp_replace(F.substring(s, 1, MAX_STEM), r"[ _\-.]+$", "")
    return let(s, lambda v: F.when(v == "", fallback).otherwise(v))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def path_suffix(path: Column) -> Column:
    """Extension with its dot; a leading or a final dot starts none."""
    return F.regexp_extract(base_name(path), r"[^.].*?(\.[^.]+)$", 1)


def path_stem(path: Column) -> Column:
    return let(base_name(path), lambda n: F.left(n, F.length(n) - F.length(path_suffix(n))))


def clean_extension(ext: Column) -> Column:
    e = F.regexp_replace(F.coalesce(ext, F.lit("")), r"[^\p{L}\p{N}.]", "")
    e = F.regexp_replace(F.regexp_replace(e, r"^\.+|\.+$", ""), r"\.{2,}", ".")
    return F.regexp_replace(e, r"(?s)^(.+)$", ".$1")


def download_name(source: Column, operation: str | None = None, extension: str | None = None,
                  fallback: str = "file") -> Column:
    """Name a user sees: storage prefix removed, stem composed (NFC) and cleaned, operation and extension added."""
    stem = clean_stem(unicode_normalize(strip_prefix(path_stem(source)), "NFC"), fallback)
    ext = clean_extension(F.lit(extension) if extension is not None else path_suffix(source))
    tail = F.lit(f"_{operation}" if operation else "")
    return F.concat(stem, tail, ext)


def multi_name(first: Column, second: Column, n: Column, operation: str, extension: str = ".pdf") -> Column:
    """Name for a result made of several inputs, from the first two sources and their number."""
    def part(src: Column) -> Column:
        return clean_stem(F.substring(download_name(src, None, ""), 1, MULTI_PART))

    tail = f"_{operation}" if operation else ""
    rest = F.when(n == 2, part(second)).otherwise(F.concat((n - 1).cast("string"), F.lit("_more")))
    combined = strip_prefix(F.concat(part(first), F.lit("_and_"), rest))
    many = F.concat(clean_stem(combined, "files"), F.lit(tail), clean_extension(F.lit(extension)))
    return (F.when(n == 0, f"files{tail}{extension}").when(n == 1, download_name(first, operation, extension, "files"))
            .otherwise(many))


def cut_bytes(text: Column, most: Column | int) -> Column:
    """Longest prefix of at most ``most`` UTF-8 bytes, never inside a character.

    A character has at most four bytes, so one of the four longest byte prefixes is whole.
    """
    limit = F.greatest(F.lit(most) if isinstance(most, int) else most, F.lit(0))

    def cut(v: Column) -> Column:
        tries = [F.try_validate_utf8(F.substring(F.encode(v["text"], "UTF-8"), F.lit(1), F.greatest(v["n"] - k, F.lit(0))).cast("string"))
                 for k in range(4)]
        return F.when(F.octet_length(v["text"]) <= v["n"], v["text"]).otherwise(F.coalesce(*tries))

    return let_all(cut, text=text, n=limit)


def split_ext(name: Column) -> tuple[Column, Column]:
    """(stem, extension with its dot) at the last dot; no extension when the stem would be empty."""
    ext = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)
    return F.left(name, F.length(name) - F.length(ext)), ext


def upload_name(raw: Column) -> Column:
    """Safe name of an upload, from an NFC text."""
    name = F.regexp_extract(F.translate(F.coalesce(raw, F.lit("")), "\\", "/"), r"(?s)([^/]*)$", 1)
    name = F.regexp_replace(name, r"\p{C}", "")
    name = F.regexp_replace(name, r"[^\p{L}\p{M}\p{N}.\-]", "_")
    name = F.regexp_replace(F.regexp_replace(name, r"^[.\-]+", ""), r"\.+$", "")

    def finish(n: Column) -> Column:
        bad = (F.regexp_replace(n, r"[._\-]+", "") == "") | F.lower(F.split_part(n, F.lit("."), F.lit(1))).isin(RESERVED_NAMES)
        stem, ext = split_ext(n)
        parts = let_all(lambda v: F.concat(F.regexp_replace(cut_bytes(v["stem"], MAX_ORIGINAL_BYTES - F.octet_length(v["tail"])),
                                                            "^$", "unnamed"), v["tail"]),
                        stem=stem, tail=F.substring(ext, 1, MAX_EXT))
        return F.when(bad, "unnamed").otherwise(parts)

    return let(name, finish)


def stored_name(file_id: Column, original: Column) -> Column:
    def finish(v: Column) -> Column:
        stem, tail = split_ext(v["name"])
        head = F.concat(v["id"], F.lit("_"))
        budget = MAX_STORED_BYTES - F.octet_length(head) - F.octet_length(tail)
        return F.concat(head, cut_bytes(F.substring(stem, 1, MAX_STORED_STEM), budget), tail)

    return let_all(finish, id=file_id, name=original)


def safe_name(raw: Column, longest: int = 200) -> Column:
    """The stricter sanitiser, from an NFKD text: double archive extensions count as one."""
    def finish(v: Column) -> Column:
        stem = F.left(v["name"], F.length(v["name"]) - F.length(v["ext"]))
        stem = F.regexp_replace(stem, r"[^\p{L}\p{N}_\-.]", "_")
        stem = F.regexp_replace(F.regexp_replace(stem, r"^\.+", ""), r"\.{2,}", ".")
        stem = F.regexp_replace(F.regexp_replace(stem, r"_{2,}", "_"), "^$", "file")
        return F.concat(F.left(stem, F.lit(longest) - F.length(v["ext"])), v["ext"])

    def parts(n: Column) -> Column:
        double = F.regexp_extract(F.lower(n), r"(\.tar\.(?:gz|bz2|xz))$", 1)
        ext = F.when(double != "", double).otherwise(F.lower(path_suffix(n)))
        return let_all(finish, name=n, ext=ext)

    name = F.regexp_replace(base_name(raw), r"[\x00-\x1f\x7f]", "")
    return F.when(F.coalesce(raw, F.lit("")) == "", "unnamed_file").otherwise(let(name, parts))


def clean_text_input(text: Column, longest: int = 1000) -> Column:
    """Control characters out, length limit, surrounding white space off; from an NFKC text."""
    t = F.substring(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), 1, longest)
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def file_extension(name: Column) -> Column:
    """Part after the last dot; none for a name that only starts with one."""
    return F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1)


# MIME type of common extensions.
MIME_TYPES = {
    ".pdf": "application/pdf", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png",
    ".gif": "image/gif", ".webp": "image/webp", ".bmp": "image/bmp", ".tif": "image/tiff", ".tiff": "image/tiff",
    ".txt": "text/plain", ".csv": "text/csv", ".html": "text/html", ".htm": "text/html", ".json": "application/json",
    ".zip": "application/zip", ".doc": "application/msword", ".xls": "application/vnd.ms-excel",
    ".ppt": "application/vnd.ms-powerpoint",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".odt": "application/vnd.oasis.opendocument.text",
    ".ods": "application/vnd.oasis.opendocument.spreadsheet",
    ".odp": "application/vnd.oasis.opendocument.presentation",
}


def mime_from_name(name: Column) -> Column:
    pairs = [F.lit(x) for kv in MIME_TYPES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(path_suffix(name))), F.lit("application/octet-stream"))


def url_name(url: Column) -> Column:
    """File name for a page fetched from a URL: its network location with dots as underscores."""
    netloc = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.when(F.coalesce(url, F.lit("")) == "", "converted.pdf").otherwise(
        F.concat(F.translate(netloc, ".", "_"), F.lit(".pdf")))


def valid_filename(name: Column) -> Column:
    ok = ~name.contains("..") & ~name.rlike(r"[/\\\x00]") & (F.length(name) <= 255) & (name != "")
    return F.coalesce(ok, F.lit(False))
