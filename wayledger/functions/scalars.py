"""Scalar functions on columns: text, URLs, JSON, paths, times, numbers, hashes."""

from __future__ import annotations

import json
import mimetypes
import re
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANKS = " \t\r\n"

# --- conversions between kinds of values -----------------------------------------------------------


def text_to_bool(c: Column) -> Column:
    """False for 'false' in any case and for '0'; true for any other text, the empty one too."""
    return ~((F.lower(c) == "false") | (c == "0"))


def text_to_int(c: Column, compat: bool = False) -> Column:
    """The integer a text starts with; null (0 in compat) if there is none."""
    n = F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("bigint")
    return F.coalesce(n, F.lit(0).cast("bigint")) if compat else n


def text_to_double(c: Column, compat: bool = False) -> Column:
    n = F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    return F.coalesce(n, F.lit(0.0)) if compat else n


def double_to_text(c: Column) -> Column:
    """Six decimals."""
    return F.format_string("%f", c.cast("double"))


def bool_to_text(c: Column) -> Column:
    return F.when(c, "1").when(~c, "0")


def time_to_text(c: Column) -> Column:
    """ISO 8601 with microseconds."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def text_to_time(c: Column) -> Column:
    return F.try_to_timestamp(c)


def text_to_guid(c: Column) -> Column:
    """Upper case with dashes, without braces; null if the text is no GUID."""
    bare = F.upper(F.regexp_replace(c, r"^\{|\}$", ""))
    return F.when(bare.rlike("^[0-9A-F]{8}(-[0-9A-F]{4}){3}-[0-9A-F]{12}$"), bare)


def binary_to_guid(c: Column) -> Column:
    h = F.hex(c)
    parts = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.when(F.length(c) == 16, parts)


# --- text --------------------------------------------------------------------------------------------


def split_text(c: Column, separator: str) -> Column:
    """Parts between separators; an empty text has none."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, re.escape(separator)))


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def wildcard(c: Column, pattern: str, nocase: bool = False) -> Column:
    """Whether the whole text matches a pattern of * (any characters) and ? (one)."""
    body = "".join(".*" if p == "*" else "." if p == "?" else re.escape(p) for p in pattern)
    return c.rlike(f"(?s{'i' if nocase else ''})^{body}\\z")


def equal_nocase(a: Column, b: Column) -> Column:
    """Equality without regard to the case of ASCII letters."""
    low = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low(a) == low(b)


def unhex(c: Column) -> Column:
    """Bytes of hex digits; null for an odd number of them."""
    return F.when(F.length(c) % 2 == 0, F.try_to_binary(c, F.lit("hex")))


def base64_web(c: Column) -> Column:
    """Base 64 for URLs: - and _ for + and /, no padding."""
    return F.translate(F.regexp_replace(F.base64(c), r"[=\r\n]", ""), "+/", "-_")


def unbase64_web(c: Column) -> Column:
    padded = F.concat(F.translate(c, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(c), F.lit(4))))
    return F.unbase64(padded)


def url_encode(c: Column) -> Column:
    """Percent escapes for all but letters, digits and -_.~ ; a space is %20."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def url_decode(c: Column) -> Column:
    """Percent escapes decoded, + kept; null for a broken escape."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def url_parts(c: Column) -> Column:
    """struct<scheme, host, port, path, query, fragment> of a URL."""
    g = lambda n: F.nullif(F.regexp_extract(c, r"^(?:([a-zA-Z][\w+.-]*):)?(?://([^/?#:]*)(?::(\d+))?)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", n), F.lit(""))
    return F.struct(g(1).alias("scheme"), g(2).alias("host"), g(3).try_cast("int").alias("port"), g(4).alias("path"), g(5).alias("query"), g(6).alias("fragment"))


def query_string(c: Column) -> Column:
    """map of the parameters of a query string, the first value of each."""
    pairs = F.transform(F.filter(F.split(c, "&"), lambda p: p != ""), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_extract(p, "^[^=]*=?(.*)$", 1).alias("v")))
    firsts = F.transform(F.array_distinct(F.transform(pairs, lambda p: p["k"])), lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), 1)["v"]))
    return F.map_from_entries(firsts)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: MIME types of the files the store deals with.
MIME_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "svg": "image/svg+xml", "tif": "image/tiff", "tiff": "image/tiff",
    "bmp": "image/bmp", "webp": "image/webp", "mp4": "video/mp4", "avi": "video/x-msvideo", "mov": "video/quicktime", "json": "application/json",
    "csv": "text/csv", "txt": "text/plain", "html": "text/html", "htm": "text/html", "css": "text/css", "js": "application/javascript", "xml": "application/xml",
    "zip": "application/zip", "pdf": "application/pdf",
}


def mime_type(path: Column) -> Column:
    """By the extension: the types above, then those that Python's library knows by itself."""
    known = {e[1:]: t for e, t in mimetypes.MimeTypes(filenames=()).types_map[1].items()} | MIME_TYPES
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])  # folded to one constant
    return F.coalesce(F.try_element_at(table, F.lower(extension(path, dot=False))), F.lit("application/octet-stream"))


def nice_name(c: Column) -> Column:
    """Underscores as spaces, the first letter of each word in upper case, the rest kept."""
    words = F.transform(F.split(F.replace(c, F.lit("_"), F.lit(" ")), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))
    return F.array_join(words, " ")


def shortcut_keys(titles: list[str]) -> list[str]:
    """A key for each title, in upper case: the first that is free of the first characters of its words, all of its
    characters, A to Z, 1 to 9 and 0; '' if none is."""
    used: set[str] = set()
    keys = []
    for title in titles:
        wanted = [w[0].upper() for w in title.split(" ") if w] + [c.upper() for c in title] + list("ABCDEFGHIJKLMNOPQRSTUVWXYZ1234567890")
        key = next((c for c in wanted if c not in used), "")
        used.add(key)
        keys.append(key)
    return keys


# --- paths ---------------------------------------------------------------------------------------------


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*?)[/\\]*[^/\\]*$", 1)


def extension(path: Column, dot: bool = True) -> Column:
    return F.regexp_extract(file_name(path), r"(\.[^.]*)$" if dot else r"\.([^.]*)$", 1)


def change_extension(path: Column, new: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./\\]*$", ""), F.lit(new))


def safe_join(root: str, path: Column) -> Column:
    """``path`` below ``root``; null if a '..' or an absolute path would leave it."""
    bad = path.rlike(r"(^|[/\\])\.\.([/\\]|$)|^[/\\]|^[A-Za-z]:")
    return F.when(~bad, F.concat(F.lit(root.rstrip("/") + "/"), path))


def bucket_and_path(url: Column) -> Column:
    """struct<bucket, path> of a storage URL such as gs://bucket/path."""
    part = lambda n: F.regexp_extract(url, r"^\w+://([^/]+)/?(.*)$", n)
    return F.when(part(1) != "", F.struct(part(1).alias("bucket"), part(2).alias("path")))


# --- JSON ------------------------------------------------------------------------------------------------


def json_get(c: Column, path: str, kind: str, default) -> Column:
    """A member of a JSON text as ``kind``, or the default if it is missing or of another kind."""
    return F.coalesce(F.get_json_object(c, path).try_cast(kind), F.lit(default).cast(kind))


def json_has(c: Column, path: str) -> Column:
    return F.get_json_object(c, path).isNotNull()


def json_valid(c: Column, schema: str, required: list[str]) -> Column:
    """Whether a JSON text has the schema: it parses, nothing is of another type, and the required members are there."""
    parsed = F.from_json(c, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    ok = parsed.isNotNull() & parsed["_corrupt"].isNull()
    for r in required:
        ok = ok & parsed[r].isNotNull()
    return F.coalesce(ok, F.lit(False))


def _matches(value, schema: dict) -> bool:
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int}
    if wanted := schema.get("type"):
        names = [wanted] if isinstance(wanted, str) else wanted
        if not any((isinstance(value, kinds[n]) or n == "integer" and isinstance(value, float) and value.is_integer()) and (n == "boolean" or not isinstance(value, bool)) for n in names):
            return False
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        return False
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return False
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)) or not re.search(schema.get("pattern", ""), value):
            return False
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            return False
        return all(_matches(x, schema["items"]) for x in value) if "items" in schema else True
    if isinstance(value, dict):
        members = schema.get("properties", {})
        other = schema.get("additionalProperties", True)
        if any(r not in value for r in schema.get("required", ())) or other is False and any(k not in members for k in value):
            return False
        rest = other if isinstance(other, dict) else {}
        return all(_matches(x, members.get(k, rest)) for k, x in value.items())
    return True


def json_matches(c: Column, schema: dict) -> Column:
    """Whether a JSON text satisfies a JSON Schema: types, members, required ones, items, limits, patterns, enumerations.

    A text that does not parse does not; null stays null.
    """

    @F.arrow_udf(T.BooleanType())
    def check(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            try:
                out.append(None if v is None else _matches(json.loads(v), schema))
            except ValueError:
                out.append(False)
        return pa.array(out, pa.bool_())

    return check(c)


def xml_parse(c: Column, schema: str) -> Column:
    """A struct of the elements (and attributes, as _name) of an XML text; null members where they are missing."""
    return F.from_xml(c, schema)


def xml_text(value: Column, row_tag: str = "row") -> Column:
    return F.to_xml(value, {"rowTag": row_tag})


# --- times --------------------------------------------------------------------------------------------------


def http_date(c: Column) -> Column:
    return F.date_format(c, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def time_parts(c: Column) -> Column:
    """struct of the parts of a time; weekday counts from Sunday = 0, day_of_year from 0."""
    leap = ((F.year(c) % 4 == 0) & (F.year(c) % 100 != 0)) | (F.year(c) % 400 == 0)
    parts = {"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "day_of_year": F.dayofyear(c) - 1, "weekday": F.dayofweek(c) - 1, "hour": F.hour(c), "minute": F.minute(c), "second": F.second(c), "leap": leap}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def time_remaining(seconds: Column) -> Column:
    """'9s', '7:09s' or '5:07:09s'."""
    s = F.floor(seconds)
    h, m, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(s < 60, F.format_string("%ds", rest)).when(s < 3600, F.format_string("%d:%02ds", m, rest)).otherwise(F.format_string("%d:%02d:%02ds", h, m, rest))


def eta(done: Column, total: Column, elapsed_seconds: Column) -> Column:
    """Seconds left at the speed so far; null before anything is done."""
    return (total - done) * elapsed_seconds / F.nullif(done, F.lit(0))


def add_micros(c: Column, micros: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(c.cast("timestamp")) + micros)


def micros_between(a: Column, b: Column) -> Column:
    return F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))


# --- numbers ---------------------------------------------------------------------------------------------------


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def compare(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def next_power_of_two(c: Column) -> Column:
    """The least power of two that is not smaller; 1 for numbers below 1."""
    return F.when(c <= 1, F.lit(1).cast("bigint")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(c.cast("bigint") - 1))).cast("bigint"))


def is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != float("inf"))


# --- hashes --------------------------------------------------------------------------------------------------------


def combined_signature(*columns: Column) -> Column:
    """128-bit signature of several values, in order; null differs from the empty text."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]))


@F.arrow_udf(T.LongType())
def fnv1a(values: pa.Array) -> pa.Array:
    """FNV-1a, 32 bits, of UTF-8 text."""
    out = []
    for v in values.to_pylist():
        if v is None:
            out.append(None)
            continue
        h = 2166136261
        for b in v.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        out.append(h)
    return pa.array(out, pa.int64())


@F.arrow_udf(T.LongType())
def xxh32(values: pa.Array) -> pa.Array:
    """XXH32 of UTF-8 text."""
    return pa.array([None if v is None else xxhash.xxh32_intdigest(v.encode()) for v in values.to_pylist()], pa.int64())


def siphash24(data: bytes, key: bytes = bytes(16)) -> int:
    """SipHash-2-4 of bytes under a 128-bit key, as an unsigned number."""
    mask = (1 << 64) - 1
    turn = lambda x, n: (x << n | x >> (64 - n)) & mask
    k0, k1 = int.from_bytes(key[:8], "little"), int.from_bytes(key[8:], "little")
    # the four words of "somepseudorandomlygeneratedbytes"
    a, b, c, d = (int.from_bytes(w, "big") ^ k for w, k in zip((b"somepseu", b"dorandom", b"lygenera", b"tedbytes"), (k0, k1, k0, k1)))

    def rounds(n: int) -> None:
        nonlocal a, b, c, d
        for _ in range(n):
            a, c = (a + b) & mask, (c + d) & mask
            b, d = turn(b, 13) ^ a, turn(d, 16) ^ c
            a, c = turn(a, 32), (c + b) & mask
            a, b = (a + d) & mask, turn(b, 17) ^ c
            c, d = turn(c, 32), turn(d, 21) ^ a

    for at in range(0, len(data) + 1, 8):
        part = data[at : at + 8]
        word = int.from_bytes(part, "little") | ((len(data) & 0xFF) << 56 if len(part) < 8 else 0)
        d ^= word
        rounds(2)
        a ^= word
    c ^= 0xFF
    rounds(4)
    return a ^ b ^ c ^ d


def siphash(c: Column, key: bytes = bytes(16)) -> Column:
    """SipHash-2-4 of UTF-8 text, as hex digits."""
    return F.arrow_udf(lambda v: pa.array([None if x is None else f"{siphash24(x.encode(), key):016x}" for x in v.to_pylist()], pa.string()), T.StringType())(c)


# --- colours --------------------------------------------------------------------------------------------------------


def srgb_to_linear(c: Column) -> Column:
    """0..1 to 0..1."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))


def linear_to_srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, 1 / 2.4) - 0.055)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """Components 0..1; hue 0..360."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.nullif(high - low, F.lit(0.0))
    hue = F.when(span.isNull(), 0.0).when(high == r, F.pmod((g - b) / span, F.lit(6.0)) * 60).when(high == g, ((b - r) / span + 2) * 60).otherwise(((r - g) / span + 4) * 60)
    return F.struct(hue.alias("h"), F.coalesce((high - low) / F.nullif(high, F.lit(0.0)), F.lit(0.0)).alias("s"), high.alias("v"))


def blend(under: Column, over: Column, alpha: Column) -> Column:
    return under + (over - under) * alpha


# --- sequence difference -----------------------------------------------------------------------------------------------


_OPERATION = T.StructType().add("op", "string").add("position", "integer").add("length", "integer").add("text", "string")


def diff_ops(old: str, new: str) -> list[tuple[str, int, int, str]]:
    """(op, position, length, text) of deletes and inserts that turn ``old`` into ``new``, applied from the last to the first."""
    ops = []
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if i2 > i1 and tag != "equal":
            ops.append(("delete", i1, i2 - i1, old[i1:i2]))
        if j2 > j1 and tag != "equal":
            ops.append(("insert", i2, j2 - j1, new[j1:j2]))
    return ops


def apply_ops(old: str, ops: list[tuple[str, int, int, str]]) -> str:
    for op, at, length, text in reversed(ops):
        old = old[:at] + text + old[at:] if op == "insert" else old[:at] + old[at + length :]
    return old


@F.arrow_udf(T.ArrayType(_OPERATION))
def sequence_diff(old: pa.Array, new: pa.Array) -> pa.Array:
    rows = [None if a is None or b is None else [dict(zip(("op", "position", "length", "text"), o)) for o in diff_ops(a, b)] for a, b in zip(old.to_pylist(), new.to_pylist())]
    return pa.array(rows, pa.list_(pa.struct([("op", pa.string()), ("position", pa.int32()), ("length", pa.int32()), ("text", pa.string())])))
