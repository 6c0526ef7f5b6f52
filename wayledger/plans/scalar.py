"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayledger.functions import scalars as S
from wayledger.plans.registry import Catalog
from wayledger.runtime import read

CATALOG = Catalog()
q = CATALOG.query


def _c(name):
    return F.col(name)


@q("str_split_join", "select c_custkey, len(string_split(c_name, '#')) as n, array_to_string(string_split(c_name, '0'), '-') as joined, replace(c_name, '00', 'x') as replaced from customer")
def str_split_join(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.size(S.split_text(_c("c_name"), "#")).cast("bigint").alias("n"), F.array_join(S.split_text(_c("c_name"), "0"), "-").alias("joined"), F.replace("c_name", F.lit("00"), F.lit("x")).alias("replaced"))


@q("str_trim", "select sample_id, loaded_at, dimension, trim(dimension, chr(32) || chr(9) || chr(13) || chr(10)) as trimmed, starts_with(dimension, 'rut') as a, ends_with(dimension, 'depth') as b from label")
def str_trim(spark, d):
    return read(spark, d, "label").select("sample_id", "loaded_at", "dimension", S.trim(_c("dimension")).alias("trimmed"), _c("dimension").startswith("rut").alias("a"), _c("dimension").endswith("depth").alias("b"))


@q("str_wildcard", "select distinct image_path, image_path glob '*frame_*.jpg' as a, lower(image_path) glob 'kromdal?p00d0000*' as b from sample")
def str_wildcard(spark, d):
    return read(spark, d, "sample").select("image_path", S.wildcard(_c("image_path"), "*frame_*.jpg").alias("a"), S.wildcard(_c("image_path"), "KROMDAL?p00d0000*", nocase=True).alias("b")).distinct()


@q("str_nocase", "select distinct dimension, lower(dimension) = 'rut_depth' as same from label")
def str_nocase(spark, d):
    return read(spark, d, "label").select("dimension", S.equal_nocase(_c("dimension"), F.lit("Rut_Depth")).alias("same")).distinct()


@q("hex_b64", "select p_partkey, hex(p_name) as h, base64(encode(p_name)) as b, replace(replace(rtrim(base64(encode(p_name)), '='), '+', '-'), '/', '_') as w, p_name as back, p_name as back_web from part")
def hex_b64(spark, d):
    p = read(spark, d, "part")
    raw = _c("p_name").cast("binary")
    return p.select("p_partkey", F.hex("p_name").alias("h"), F.base64(raw).alias("b"), S.base64_web(raw).alias("w"), S.unhex(F.hex("p_name")).cast("string").alias("back"), S.unbase64_web(S.base64_web(raw)).cast("string").alias("back_web"))


@q("int_base", "select o_orderkey, upper(to_base(o_orderkey, 16)) as h, to_base(o_orderkey, 2) as b from orders")
def int_base(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.conv(_c("o_orderkey").cast("string"), 10, 16).alias("h"), F.conv(_c("o_orderkey").cast("string"), 10, 2).alias("b"))



@q("url_codec_all", "select distinct image_path, url_encode(image_path) as encoded, image_path as back from sample")
def url_codec_all(spark, d):
    """Every path, also those with a '%'."""
    e = S.url_encode(_c("image_path"))
    return read(spark, d, "sample").select("image_path", e.alias("encoded"), S.url_decode(e).alias("back")).distinct()


_URL = "u as (select doc_id, 'https://' || coalesce(source, 'none') || ':8080/d/' || doc_id || '?lang=' || coalesce(lang, '') || '&n=' || n_chars || '#top' as url from documents)"


@q("url_parts", f"with {_URL} select doc_id, 'https' as scheme, coalesce(source, 'none') as host, 8080 as port, '/d/' || doc_id as path, coalesce(lang, '') as lang, n_chars::varchar as n, 'top' as fragment from documents")
def url_parts(spark, d):
    t = read(spark, d, "documents")
    url = F.concat(F.lit("https://"), F.coalesce("source", F.lit("none")), F.lit(":8080/d/"), _c("doc_id").cast("string"), F.lit("?lang="), F.coalesce("lang", F.lit("")), F.lit("&n="), _c("n_chars").cast("string"), F.lit("#top"))
    u = t.select("doc_id", S.url_parts(url).alias("u"))
    return u.select("doc_id", "u.scheme", "u.host", "u.port", "u.path", F.col("u.fragment"), S.query_string(F.col("u.query")).alias("m")).select("doc_id", "scheme", "host", "port", "path", "fragment", F.col("m")["lang"].alias("lang"), F.col("m")["n"].alias("n"))


@q("mime_types", "select distinct image_path, case lower(regexp_extract(image_path, '\\.([^./\\\\]*)$', 1)) when 'jpg' then 'image/jpeg' when 'jpeg' then 'image/jpeg' when 'png' then 'image/png' else 'application/octet-stream' end as mime from sample")
def mime_types(spark, d):
    return read(spark, d, "sample").select("image_path", S.mime_type(_c("image_path")).alias("mime")).distinct()


@q("html_escape", "select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') as html from documents")
def html_escape(spark, d):
    return read(spark, d, "documents").select("doc_id", S.html_escape(_c("text")).alias("html"))


@q("json_get", "select event_id, coalesce((props->>'$.k')::int, -1) as k, 7 as missing, json_exists(props, '$.k') as has from events")
def json_get(spark, d):
    return read(spark, d, "events").select("event_id", S.json_get(_c("props"), "$.k", "int", -1).alias("k"), S.json_get(_c("props"), "$.zzz", "int", 7).alias("missing"), S.json_has(_c("props"), "$.k").alias("has"))


@q("json_valid", "select event_id, props->>'$.k' is not null as ok from events")
def json_valid(spark, d):
    return read(spark, d, "events").select("event_id", S.json_valid(_c("props"), "k int", ["k"]).alias("ok"))


@q("path_parts", r"select distinct image_path, regexp_extract(image_path, '([^/\\]*)$', 1) as name, regexp_extract(regexp_extract(image_path, '([^/\\]*)$', 1), '(\.[^.]*)$', 1) as ext, regexp_replace(image_path, '\.[^./\\]*$', '') || '.txt' as changed, regexp_extract(image_path, '^(.*?)[/\\]*[^/\\]*$', 1) as dir, case when not regexp_matches(image_path, '(^|[/\\])\.\.([/\\]|$)|^[/\\]|^[A-Za-z]:') then '/root/' || image_path end as joined from sample")
def path_parts(spark, d):
    p = _c("image_path")
    return read(spark, d, "sample").select("image_path", S.file_name(p).alias("name"), S.extension(p).alias("ext"), S.change_extension(p, ".txt").alias("changed"), S.directory(p).alias("dir"), S.safe_join("/root", p).alias("joined")).distinct()


@q("storage_url", "select c_custkey, 'b' || c_nationkey as bucket, 'x/' || c_name as path from customer")
def storage_url(spark, d):
    u = F.concat(F.lit("gs://b"), _c("c_nationkey").cast("string"), F.lit("/x/"), "c_name")
    return read(spark, d, "customer").select("c_custkey", S.bucket_and_path(u).alias("u")).select("c_custkey", "u.*")


@q("iso_format", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as iso, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') as http, epoch_us(ts) as back from events")
def iso_format(spark, d):
    iso = S.time_to_text(_c("ts"))
    return read(spark, d, "events").select("event_id", iso.alias("iso"), S.http_date(_c("ts")).alias("http"), F.unix_micros(S.text_to_time(iso)).alias("back"))


@q("date_parts", "select o_orderkey, year(o_orderdate) as year, month(o_orderdate) as month, day(o_orderdate) as day, dayofyear(o_orderdate) - 1 as day_of_year, dayofweek(o_orderdate) as weekday, hour(o_orderdate) as hour, minute(o_orderdate) as minute, second(o_orderdate) as second, (year(o_orderdate) % 4 = 0 and year(o_orderdate) % 100 <> 0) or year(o_orderdate) % 400 = 0 as leap from orders")
def date_parts(spark, d):
    return read(spark, d, "orders").select("o_orderkey", S.time_parts(_c("o_orderdate")).alias("p")).select("o_orderkey", "p.*")


@q("duration_format", "with s as (select o_orderkey, floor(o_totalprice / 20)::bigint as s from orders) select o_orderkey, case when s < 60 then s || 's' when s < 3600 then (s // 60) || ':' || lpad((s % 60)::varchar, 2, '0') || 's' else (s // 3600) || ':' || lpad((s // 60 % 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') || 's' end as t, round((200000 - s) * 10.0 / nullif(s, 0), 5) as eta from s")
def duration_format(spark, d):
    s = F.floor(_c("o_totalprice") / 20)
    return read(spark, d, "orders").select("o_orderkey", S.time_remaining(_c("o_totalprice") / 20).alias("t"), F.round(S.eta(s, F.lit(200000), F.lit(10.0)), 5).alias("eta"))


@q("time_arithmetic", "select event_id, epoch_us(ts) + 1500 as later, epoch_us(ts) - epoch_us(timestamp '2024-01-01') as since from events")
def time_arithmetic(spark, d):
    return read(spark, d, "events").select("event_id", F.unix_micros(S.add_micros(_c("ts"), F.lit(1500))).alias("later"), S.micros_between(F.lit("2024-01-01").cast("timestamp"), _c("ts")).alias("since"))


@q("number_functions", "select c_custkey, sign(c_acctbal)::int as s, least(greatest(c_acctbal, 0), 5000) as c, case when c_acctbal < 100 then -1 when c_acctbal > 100 then 1 else 0 end as cmp, power(2, ceil(log2(greatest(c_custkey, 1))))::bigint as p, isfinite(c_acctbal) as f from customer")
def number_functions(spark, d):
    a = _c("c_acctbal")
    return read(spark, d, "customer").select("c_custkey", F.signum(a).cast("int").alias("s"), S.clamp(a, 0.0, 5000.0).alias("c"), S.compare(a, F.lit(100)).alias("cmp"), S.next_power_of_two(_c("c_custkey")).alias("p"), S.is_finite(a).alias("f"))


@q("hashes", "select c_custkey, md5(c_name) as m, sha256(c_name) as s, md5('=' || c_name || '|=' || c_mktsegment || '|=' || c_nationkey) as g from customer")
def hashes(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.md5("c_name").alias("m"), F.sha2("c_name", 256).alias("s"), S.combined_signature(_c("c_name"), _c("c_mktsegment"), _c("c_nationkey")).alias("g"))


@q("fnv1a", "select c_custkey, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(c_name, ''), lambda c: ord(c)::bigint)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) as fnv1a from customer")
def fnv1a(spark, d):
    return read(spark, d, "customer").select("c_custkey", S.fnv1a("c_name").alias("fnv1a"))


@q("hashes_more")
def hashes_more(spark, d):
    return read(spark, d, "customer").select("c_custkey", S.fnv1a("c_name").alias("fnv1a"), F.crc32("c_name").alias("crc32"), F.xxhash64("c_name").alias("xxhash64"))


@q("guid_text", "select c_custkey, upper(substring(md5(c_name), 1, 8) || '-' || substring(md5(c_name), 9, 4) || '-' || substring(md5(c_name), 13, 4) || '-' || substring(md5(c_name), 17, 4) || '-' || substring(md5(c_name), 21, 12)) as guid, null::varchar as bad from customer")
def guid_text(spark, d):
    g = S.binary_to_guid(F.unhex(F.md5("c_name")))
    return read(spark, d, "customer").select("c_custkey", S.text_to_guid(F.concat(F.lit("{"), F.lower(g), F.lit("}"))).alias("guid"), S.text_to_guid(_c("c_name")).alias("bad"))


@q("conversions", "select c_custkey, not (lower(c_mktsegment) = 'false' or c_mktsegment = '0') as b, coalesce(try_cast(regexp_extract(split_part(c_name, '#', 2), '^\\s*([+-]?\\d+)', 1) as bigint), 0) as i, printf('%f', c_acctbal) as t, case when c_acctbal > 0 then '1' else '0' end as bt from customer")
def conversions(spark, d):
    c = read(spark, d, "customer")
    number = F.split_part("c_name", F.lit("#"), F.lit(2))
    return c.select("c_custkey", S.text_to_bool(_c("c_mktsegment")).alias("b"), S.text_to_int(number, compat=True).alias("i"), S.double_to_text(_c("c_acctbal")).alias("t"), S.bool_to_text(_c("c_acctbal") > 0).alias("bt"))


@q("nice_names", "select distinct dimension, list_aggregate(list_transform(string_split(replace(dimension, '_', ' '), ' '), lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), 'string_agg', ' ') as title from dimension_def")
def nice_names(spark, d):
    return read(spark, d, "dimension_def").select("dimension", S.nice_name(_c("dimension")).alias("title")).distinct()


@q("colours", "with e as (select p_partkey, (p_size % 11) / 10.0 as r, (p_partkey % 7) / 6.0 as g, (p_partkey % 5) / 4.0 as b from part), h as (select *, greatest(r, g, b) as hi, least(r, g, b) as lo from e) select p_partkey, round(case when r <= 0.04045 then r / 12.92 else power((r + 0.055) / 1.055, 2.4) end, 6) as lin, round(r, 6) as back, round(hi::double, 6) as v, round(case when hi = 0 then 0 else (hi - lo) / hi end, 6) as s, round(r + (g - r) * 0.25, 6) as mix from h")
def colours(spark, d):
    e = read(spark, d, "part").select("p_partkey", ((_c("p_size") % 11) / 10.0).alias("r"), ((_c("p_partkey") % 7) / 6.0).alias("g"), ((_c("p_partkey") % 5) / 4.0).alias("b"))
    hsv = S.rgb_to_hsv(_c("r"), _c("g"), _c("b"))
    x = S.srgb_to_linear(_c("r"))
    return e.select("p_partkey", F.round(x, 6).alias("lin"), F.round(S.linear_to_srgb(x), 6).alias("back"), F.round(hsv["v"], 6).alias("v"), F.round(hsv["s"], 6).alias("s"), F.round(S.blend(_c("r"), _c("g"), F.lit(0.25)), 6).alias("mix"))


@q("sequence_diff")
def sequence_diff(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", F.explode_outer(S.sequence_diff("p_name", "p_type")).alias("o")).select("p_partkey", "o.*")
