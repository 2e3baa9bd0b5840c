"""Queries of the engine's own operators over whole tables, each with SQL that checks it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import cleaners as C
from sedimenta.functions.urls import any_join, join_rooted, origin
from sedimenta.operators import extract, lifecycle, report
from sedimenta.plans import scenario
from sedimenta.plans.problems import table
from sedimenta.sources import export, pages
from sedimenta.sources.store import conform, count_items, cut_messages
from sedimenta.spec import parse_site

NOW = dt.datetime(2026, 5, 1, 12, 0, 0)
SQL_NOW = "TIMESTAMP '2026-05-01 12:00:00'"
WHITE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- normalisers ---


@query(f"SELECT doc_id, trim(regexp_replace(text, '{WHITE}+', ' ', 'g')) AS cleaned FROM documents")
def str_collapse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.clean_str(F.col("text")).alias("cleaned"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS es, round(o_totalprice, 2) AS en, CASE WHEN floor(o_totalprice) >= 1000 OR o_totalprice < 1000 THEN floor(o_totalprice) END AS whole FROM orders")
def money_formats(spark: SparkSession, d: str) -> DataFrame:
    shown = F.format_number("o_totalprice", 2)
    spanish = F.concat(F.lit("Importe: "), F.translate(shown, ",.", ".,"), F.lit(" €"))
    whole = F.concat(F.translate(F.format_number(F.floor("o_totalprice"), 0), ",", "."), F.lit(" EUR"))
    return table(spark, d, "orders").select("o_orderkey", C.clean_money(spanish).alias("es"), C.clean_money(shown).alias("en"), C.clean_money(whole).alias("whole"))


@query("SELECT p_partkey, p_partkey * 1000 + p_size AS n FROM part")
def int_thousands(spark: SparkSession, d: str) -> DataFrame:
    shown = F.translate(F.format_number(F.col("p_partkey") * 1000 + F.col("p_size"), 0), ",", ".")
    return table(spark, d, "part").select("p_partkey", C.clean_int(F.concat(F.lit("aprox. "), shown, F.lit(" unidades"))).alias("n"))


_ES = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 6 AS form, CAST(l_shipdate AS DATE) AS day FROM lineitem")
def date_formats(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("l_shipdate")
    month = F.element_at(F.array(*map(F.lit, _ES)), F.month(day))
    forms = [
        F.date_format(day, "yyyy-MM-dd"),
        F.date_format(day, "'Publicado el' d/M/yyyy HH:mm"),
        F.concat(F.dayofmonth(day).cast("string"), F.lit(" de "), month, F.lit(" de "), F.year(day).cast("string")),
        F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), F.substring(month, 1, 3), F.lit(". "), F.year(day).cast("string")),
        F.date_format(day, "MMMM d, yyyy"),
        F.date_format(day, "yyyyMMdd"),
    ]
    form = (F.col("l_linenumber") % 6).alias("form")
    text = forms[0]
    for i, f in enumerate(forms[1:], 1):  # branches, so that each row makes one text
        text = F.when(F.col("l_linenumber") % 6 == i, f).otherwise(text)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", form, C.clean_date(text, C.moment(NOW)).alias("day"))


@query("SELECT event_id, date_trunc('second', ts) AS iso, date_trunc('minute', ts) AS minute FROM events")
def datetime_formats(spark: SparkSession, d: str) -> DataFrame:
    ts, now = F.col("ts"), C.moment(NOW)
    return table(spark, d, "events").select("event_id", C.clean_datetime(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), now).alias("iso"), C.clean_datetime(F.date_format(ts, "dd/MM/yyyy, 'a las' HH:mm"), now).alias("minute"))


@query(
    f"SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN {SQL_NOW} - to_seconds((c_custkey % 40) * 3600) WHEN 1 THEN CAST(CAST({SQL_NOW} AS DATE) AS TIMESTAMP) - INTERVAL 1 DAY "
    f"WHEN 2 THEN {SQL_NOW} - to_days(CAST((c_custkey % 40) * 7 AS INTEGER)) WHEN 3 THEN CAST(CAST({SQL_NOW} - to_months(CAST(c_custkey % 40 AS INTEGER)) AS DATE) AS TIMESTAMP) ELSE NULL END AS moment FROM customer"
)
def relative_dates(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("c_custkey") % 40).cast("string")
    text = F.get(F.array(F.concat(F.lit("hace "), n, F.lit(" horas")), F.lit("Visto ayer"), F.concat(n, F.lit(" weeks ago")), F.concat(F.lit("Hace "), n, F.lit(" meses")), F.lit("Ayerbe y Hoya")), (F.col("c_custkey") % 5).cast("int"))
    return table(spark, d, "customer").select("c_custkey", C.relative_datetime(text, C.moment(NOW))["moment"].alias("moment"))


@query("SELECT s_suppkey, '+34' || CAST(600000000 + s_suppkey AS VARCHAR) AS phone, 'a' || CAST(s_suppkey AS VARCHAR) || '@x-y.example' AS email FROM supplier")
def phone_email(spark: SparkSession, d: str) -> DataFrame:
    digits = (F.col("s_suppkey") + 600000000).cast("string")
    phone = F.concat(F.lit("Tel. (0034) "), F.substring(digits, 1, 3), F.lit(" "), F.substring(digits, 4, 3), F.lit("-"), F.substring(digits, 7, 3), F.lit(" / otro"))
    email = F.concat(F.lit("<Contacto: A"), F.col("s_suppkey").cast("string"), F.lit("@X-Y.Example>"))
    return table(spark, d, "supplier").select("s_suppkey", C.clean_phone(phone).alias("phone"), C.clean_email(email).alias("email"))


@query(r"SELECT page_id, lower(nullif(regexp_extract(html, '[\p{L}\p{Nd}\p{M}_.+-]+@[\p{L}\p{Nd}\p{M}_-]+\.[\p{L}\p{Nd}\p{M}_.-]+'), '')) AS email FROM raw_pages")
def page_email(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_pages").select("page_id", C.clean_email(F.col("html")).alias("email"))


@query("SELECT c_custkey, regexp_extract(c_name, '#0*([0-9]+)', 1) AS grouped, regexp_extract(c_name, '[0-9]+') AS whole FROM customer")
def regex_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", extract.post_filter(F.col("c_name"), "#0*([0-9]+)").alias("grouped"), extract.post_filter(F.col("c_name"), "[0-9]+").alias("whole"))


# --- pages ---


@query(
    r"""WITH t AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS raw FROM raw_pages),
    u AS (SELECT page_id, list_reduce(list_prepend(raw, list_distinct(regexp_extract_all(raw, '&#[0-9]+;'))), lambda acc, x: replace(acc, x,
        CASE WHEN CAST(replace(replace(x, '&#', ''), ';', '') AS INTEGER) IN (129, 141, 143, 144, 157) THEN chr(CAST(replace(replace(x, '&#', ''), ';', '') AS INTEGER))
        WHEN CAST(replace(replace(x, '&#', ''), ';', '') AS INTEGER) BETWEEN 128 AND 159 THEN substr('€_‚ƒ„…†‡ˆ‰Š‹Œ_Ž__‘’“”•–—˜™š›œ_žŸ', CAST(replace(replace(x, '&#', ''), ';', '') AS INTEGER) - 127, 1)
        ELSE chr(CAST(replace(replace(x, '&#', ''), ';', '') AS INTEGER)) END)) AS raw FROM t)
    SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '"""
    + WHITE
    + "+', ' ', 'g')), '') AS title FROM u"
)
def page_title(spark: SparkSession, d: str) -> DataFrame:
    site = parse_site({"name": "t", "base_url": "https://x", "start_urls": ["/"], "list": {"item_selector": "html", "fields": {}}, "detail": {"fields": {"title": {"selector": "title"}}}})
    rows = table(spark, d, "raw_pages").select(F.col("page_id").cast("string").alias("url"), F.lit(None).cast("string").alias("final_url"), "html")
    parsed = extract.with_fields(extract.details(rows, site.detail.fields), site.detail.fields, C.moment(NOW))
    return parsed.select(F.col("detail_url").cast("bigint").alias("page_id"), F.col("f_title").alias("title"))


@query(
    r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1)) AS href FROM raw_pages)
    SELECT page_id, CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href WHEN href LIKE '?%' THEN regexp_extract(url, '^[^?#]*') || href WHEN href LIKE '#%' THEN url || CASE WHEN length(href) > 1 THEN href ELSE '' END ELSE regexp_extract(url, '^[a-z]+://[^/]+') || href END AS link, count(*) AS n FROM l GROUP BY ALL"""
)
def page_links(spark: SparkSession, d: str) -> DataFrame:
    site = parse_site({"name": "t", "base_url": "https://x", "start_urls": ["/"], "list": {"item_selector": "a[href]", "detail_url": "::attr(href)", "fields": {}}})
    rows = table(spark, d, "raw_pages").select("page_id", "url", F.lit(None).cast("string").alias("final_url"), "html")
    found = extract.listing(rows, site).filter("item_pos IS NOT NULL")
    return found.groupBy("page_id", F.col("detail_url").alias("link")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT page_id, coalesce(nullif(lower(regexp_extract(substr(html, 1, 4096), '(?i)<meta[^>]+charset\s*=\s*["'']?\s*([\w-]+)', 1)), ''), 'utf-8') AS charset FROM raw_pages""")
def page_charset(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_pages").select("page_id", pages.meta_charset(F.encode("html", "UTF-8")).alias("charset"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/doc/' || page_id AS rooted, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/doc/' || page_id AS general, lower(regexp_extract(url, '^([a-z]+://[^/]+)', 1)) AS origin FROM raw_pages")
def url_join(spark: SparkSession, d: str) -> DataFrame:
    rel = F.concat(F.lit("/doc/"), F.col("page_id").cast("string"))
    return table(spark, d, "raw_pages").select("page_id", join_rooted(F.col("url"), rel).alias("rooted"), any_join(F.col("url"), rel).alias("general"), origin(F.col("url")).alias("origin"))


@query(
    """WITH RECURSIVE d AS (SELECT json_id, body FROM json_docs WHERE json_valid(body)),
    t AS (SELECT d.json_id, t.id, t.parent, t.key, t.type, t.value FROM d, json_tree(d.body) t),
    spots AS (SELECT t.json_id, t.id, t.parent, t.type, t.value, CASE WHEN p.type = 'ARRAY' THEN p.key ELSE t.key END AS level FROM t LEFT JOIN t p ON p.json_id = t.json_id AND p.id = t.parent),
    nodes AS (SELECT * FROM spots WHERE type = 'OBJECT'),
    up AS (SELECT json_id, id AS node, value AS own, parent AS above, 0 AS k, NULL::VARCHAR AS level, NULL::JSON AS value FROM spots WHERE level = 'item' AND type <> 'ARRAY'
        UNION ALL SELECT up.json_id, up.node, up.own, t.parent, up.k + 1, n.level, n.value FROM up JOIN t ON t.json_id = up.json_id AND t.id = up.above LEFT JOIN nodes n ON n.json_id = up.json_id AND n.id = up.above),
    it AS (SELECT json_id, node, any_value(own) AS own, arg_min(value, k) FILTER (WHERE level = 'seccion') AS s, arg_min(value, k) FILTER (WHERE level = 'departamento') AS dep, arg_min(value, k) FILTER (WHERE level = 'diario') AS dia FROM up GROUP BY json_id, node HAVING count(*) FILTER (WHERE level = 'item') = 0)
    SELECT json_id, row_number() OVER (PARTITION BY json_id ORDER BY node) - 1 AS item_pos, nullif(json_extract_string(own, '$.identificador'), '') AS id, nullif(trim(regexp_replace(json_extract_string(own, '$.titulo'), 'W+', ' ', 'g')), '') AS titulo, nullif(json_extract_string(s, '$.codigo'), '') AS seccion,
        nullif(trim(regexp_replace(json_extract_string(dep, '$.nombre'), 'W+', ' ', 'g')), '') AS departamento, CAST(coalesce(try_strptime(coalesce(json_extract_string(body, '$.data.sumario.metadatos.fecha_publicacion'), json_extract_string(body, '$.data.sumario[0].metadatos.fecha_publicacion')), '%Y%m%d'), try_strptime(replace(coalesce(json_extract_string(body, '$.data.sumario.metadatos.fecha_publicacion'), json_extract_string(body, '$.data.sumario[0].metadatos.fecha_publicacion')), '/', '-'), '%Y-%m-%d')) AS DATE) AS fecha, TRY_CAST(json_extract_string(dia, '$.numero') AS BIGINT) AS diario FROM it JOIN d USING (json_id)""".replace("W+", WHITE + "+")
)
def json_listing(spark: SparkSession, d: str) -> DataFrame:
    fields = {"id": {"selector": "json:identificador"}, "titulo": {"selector": "json:titulo"}, "seccion": {"selector": "json:@seccion.codigo"}, "departamento": {"selector": "json:@departamento.nombre"}, "fecha": {"selector": "json:$.data.sumario.metadatos.fecha_publicacion", "type": "date"}, "diario": {"selector": "json:@diario.numero", "type": "int"}}
    site = parse_site({"name": "t", "base_url": "https://x", "start_urls": ["/"], "fetch": {"format": "json"}, "list": {"item_selector": "..item", "fields": fields}})
    rows = table(spark, d, "json_docs").select("json_id", "url", F.lit(None).cast("string").alias("final_url"), F.col("body").alias("html"))
    found = extract.with_fields(extract.listing(rows, site).filter("item_pos IS NOT NULL"), site.list.fields, C.moment(NOW))
    return found.select("json_id", "item_pos", *(F.col(f"f_{n}").alias(n) for n in fields))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_scalar(spark: SparkSession, d: str) -> DataFrame:
    site = parse_site({"name": "t", "base_url": "https://x", "start_urls": ["/"], "fetch": {"format": "json"}, "list": {"item_selector": "$", "fields": {"k": {"selector": "json:k"}}}})
    rows = table(spark, d, "events").select("event_id", F.lit("https://x/").alias("url"), F.lit(None).cast("string").alias("final_url"), F.col("props").alias("html"))
    found = extract.with_fields(extract.listing(rows, site).filter("item_pos IS NOT NULL"), site.list.fields, C.moment(NOW))
    return found.select("event_id", F.col("f_k").alias("k"))


# --- filters, fallbacks, joins ---

_FILTER = {"name": "t", "base_url": "https://x", "start_urls": ["/"], "list": {"item_selector": "x", "fields": {"p_type": {}, "p_name": {}}, "include": {"p_type": "^[A-S]"}, "exclude": {"p_name": "(?i)blue|7$"}}}


@query("SELECT p_partkey FROM part WHERE regexp_matches(coalesce(p_type, ''), '^[A-S]') AND NOT regexp_matches(coalesce(p_name, ''), '(?i)blue|7$')")
def include_exclude(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(extract.passes(parse_site(_FILTER), prefix="")).select("p_partkey")


@query("SELECT id, coalesce(nullif(trim(regexp_replace(json_extract_string(data, '$.titulo'), '\\s+', ' ', 'g')), ''), nullif(trim(json_extract_string(data, '$.puesto')), ''), 'sin titulo') AS title FROM items".replace("'\\s+'", f"'{WHITE}+'"))
def selector_fallback(spark: SparkSession, d: str) -> DataFrame:
    from sedimenta.spec import FieldSpec

    v = F.try_parse_json("data")
    one = lambda k: F.array(F.try_variant_get(v, f"$.{k}", "string"))
    return table(spark, d, "items").select("id", extract.field_value(F.array(one("titulo"), one("puesto")), FieldSpec(selector=["a", "b"], default="sin titulo"), C.moment(NOW)).alias("title"))


@query("SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'text' END AS missing FROM documents")
def required_split(spark: SparkSession, d: str) -> DataFrame:
    from sedimenta.spec import FieldSpec

    return table(spark, d, "documents").select("doc_id", F.get(extract.missing({"text": FieldSpec(required=True)}, prefix=""), F.lit(0)).alias("missing"))


# --- keys, hashes, lifecycle ---


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN 'https://f.example/' || l_orderkey ELSE CAST(l_orderkey AS VARCHAR) || '|' || l_linenumber || '|' || l_returnflag END AS natural_key FROM lineitem")
def natural_key(spark: SparkSession, d: str) -> DataFrame:
    some = F.col("l_orderkey") % 7 != 0
    parts = [F.when(some, F.col(c)) for c in ("l_orderkey", "l_linenumber", "l_returnflag")]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", lifecycle.natural_key(parts, F.concat(F.lit("https://f.example/"), F.col("l_orderkey").cast("string"))).alias("natural_key"))


@query("SELECT doc_id, CASE WHEN length(k) > 500 THEN substr(k, 1, 458) || '#' || substr(sha256(k), 1, 40) ELSE k END AS natural_key FROM (SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN url ELSE text END AS k FROM documents)")
def natural_key_long(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", lifecycle.natural_key([F.col("text")], F.col("url")).alias("natural_key"))


@query("""SELECT c_custkey, substr(sha256('{"key":' || c_custkey || ',"name":"' || c_name || '","nation":' || c_nationkey || ',"none":null}'), 1, 32) AS hash FROM customer""")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    record = lifecycle.canonical_json({"name": F.col("c_name"), "key": F.col("c_custkey"), "none": F.lit(None).cast("string"), "nation": F.col("c_nationkey")})
    return table(spark, d, "customer").select("c_custkey", lifecycle.content_hash(record).alias("hash"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items")


@query(
    """WITH r AS (SELECT site, natural_key, load_id, coalesce(content_hash, '') AS content_hash,
        lag(coalesce(content_hash, '')) OVER (PARTITION BY site, natural_key, load_run_id ORDER BY loaded_at, load_id) AS before, load_run_id FROM item_loads WHERE gone_at IS NULL)
    SELECT r.load_id, CASE WHEN coalesce(r.before, i.content_hash) IS NULL THEN 'new' WHEN coalesce(r.before, i.content_hash) <> r.content_hash THEN 'updated' ELSE 'unchanged' END AS result
    FROM r LEFT JOIN items i ON i.site = r.site AND i.natural_key = r.natural_key"""
)
def upsert_classify(spark: SparkSession, d: str) -> DataFrame:
    """Every load's records against the stored items and their earlier appearances in the load."""
    seen = table(spark, d, "item_loads").filter("gone_at IS NULL").withColumn("content_hash", F.coalesce("content_hash", F.lit("")))
    stored = _stored(spark, d).select("site", "natural_key", "content_hash")
    return lifecycle.classify(seen, stored, ["loaded_at", "load_id"], ["load_run_id"]).select("load_id", "result")


@query(
    f"""WITH seen AS (SELECT site, natural_key, 'h' || CAST(id % 3 AS VARCHAR) AS h FROM items WHERE id % 4 <> 0), fresh AS (SELECT site, natural_key || '-x' AS natural_key, 'h0' AS h FROM items WHERE id % 10 = 0), all_ AS (SELECT * FROM seen UNION ALL SELECT * FROM fresh)
    SELECT coalesce(i.site, a.site) AS site, coalesce(i.natural_key, a.natural_key) AS natural_key, coalesce(i.first_seen, {SQL_NOW}) AS first_seen, CASE WHEN a.h IS NOT NULL THEN {SQL_NOW} ELSE i.last_seen END AS last_seen,
        CASE WHEN a.h IS NOT NULL THEN NULL WHEN i.gone_at IS NULL THEN {SQL_NOW} ELSE i.gone_at END AS gone_at, CASE WHEN a.h IS NULL THEN i.content_hash ELSE a.h END AS content_hash, CASE WHEN a.h IS NOT NULL THEN 999999 ELSE i.run_id END AS run_id
    FROM items i FULL JOIN all_ a ON i.site = a.site AND i.natural_key = a.natural_key"""
)
def upsert_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The next snapshot of items after a run that saw three of four, all changed, and some new ones; the rest is gone."""
    stored = _stored(spark, d)
    seen = stored.filter("id % 4 <> 0").select("site", "natural_key", F.concat(F.lit("h"), (F.col("id") % 3).cast("string")).alias("content_hash"), "id")
    new = stored.filter("id % 10 = 0").select("site", F.concat("natural_key", F.lit("-x")).alias("natural_key"), F.lit("h0").alias("content_hash"), "id")
    records = seen.unionByName(new).select("site", "natural_key", "content_hash", F.lit("{}").alias("data"), F.lit("u").alias("source_url"), F.lit(0).alias("start_pos"), F.lit(1).alias("page_no"), F.col("id").alias("item_pos"))
    order = ["start_pos", "page_no", "item_pos"]
    after = lifecycle.upsert(stored, lifecycle.classify(records, stored, order), stored.select("site", "natural_key").limit(0), 999999, C.moment(NOW), order, True)
    return after.select("site", "natural_key", "first_seen", "last_seen", "gone_at", "content_hash", "run_id")


@query("SELECT i.id FROM items i JOIN (SELECT site, source_url FROM items WHERE source_url IS NOT NULL GROUP BY ALL HAVING count(*) = 1) u USING (site, source_url)")
def unique_source_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.unique_by_url(_stored(spark, d)).select("id")


@query(f"SELECT id FROM items WHERE fetched_at >= {SQL_NOW} - INTERVAL 9 DAY AND json_valid(data)")
def incremental_skip(spark: SparkSession, d: str) -> DataFrame:
    """Items fetched lately whose listed title is what is stored."""
    items = _stored(spark, d)
    listed = items.select("site", "natural_key", "id", F.to_json(F.struct(F.try_variant_get(F.try_parse_json("data"), "$.titulo", "string").alias("titulo"))).alias("list_json"))
    return lifecycle.skippable(listed, items, ["titulo"], "natural_key", C.moment(NOW), 9.0).select("id")


@query("SELECT load_id, content_hash <> lag(content_hash) OVER (PARTITION BY site, natural_key, load_run_id ORDER BY loaded_at, load_id) AS changed FROM item_loads")
def inrun_duplicates(spark: SparkSession, d: str) -> DataFrame:
    before = lifecycle.in_run(table(spark, d, "item_loads"), ["loaded_at", "load_id"], ["load_run_id"])
    return before.select("load_id", (F.col("content_hash") != F.col("before")).alias("changed"))


# --- reports ---


@query(
    """SELECT 'text' AS field, count(*) FILTER (WHERE text IS NULL OR text = '') AS empty, 1 - count(*) FILTER (WHERE text IS NULL OR text = '')::DOUBLE / count(*) AS rate FROM documents
    UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL OR lang = ''), 1 - count(*) FILTER (WHERE lang IS NULL OR lang = '')::DOUBLE / count(*) FROM documents
    UNION ALL SELECT 'n_chars', count(*) FILTER (WHERE n_chars IS NULL), 1 - count(*) FILTER (WHERE n_chars IS NULL)::DOUBLE / count(*) FROM documents
    UNION ALL SELECT 'nowhere', count(*), 0.0 FROM documents"""
)
def fill_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    n = docs.count()
    return report.empty_counts(docs, {"text": "str", "lang": "str", "n_chars": "int", "nowhere": "str"}, prefix="").select("field", "empty", report.fill_rate(F.col("empty").cast("double"), F.lit(n)).alias("rate"))


@query("SELECT id, site, started_at FROM (SELECT DISTINCT id, site, started_at FROM runs) ORDER BY id DESC LIMIT 10")
def last_runs(spark: SparkSession, d: str) -> DataFrame:
    """The limit is the feature: the last ten runs."""
    return report.last_runs(table(spark, d, "runs").select("id", "site", "started_at").distinct())


@query("SELECT site, count(*) AS stored, count(*) FILTER (WHERE gone_at IS NULL) AS active FROM items GROUP BY site")
def stored_counts(spark: SparkSession, d: str) -> DataFrame:
    return count_items(_stored(spark, d))


@query(
    """WITH f AS (SELECT run_id, page_id, CASE WHEN status < 400 THEN 'ok' WHEN status IN (404, 410) THEN 'end' ELSE 'fail' END AS outcome FROM raw_pages),
    i AS (SELECT *, count(*) FILTER (WHERE outcome = 'ok') OVER (PARTITION BY run_id ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS island FROM f),
    c AS (SELECT *, count(*) FILTER (WHERE outcome = 'fail') OVER (PARTITION BY run_id, island ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS failures FROM i)
    SELECT run_id, page_id, failures, bool_or(failures >= 2) OVER (PARTITION BY run_id ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS aborted FROM c"""
)
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    fetches = table(spark, d, "raw_pages").withColumn("outcome", pages.fetch_outcome(F.col("status"), F.lit(True)))
    return report.circuit_breaker(fetches, ["run_id"], ["page_id"], "outcome", 2).select("run_id", "page_id", "failures", "aborted")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN least(pow(2.0, n_nationkey % 7), 30.0) WHEN n_nationkey % 3 = 1 AND n_nationkey > 0 THEN least(CAST(n_nationkey * 10 AS DOUBLE), 120.0) ELSE least(pow(2.0, n_nationkey % 7), 30.0) END AS wait FROM nation")
def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    told = F.when(F.col("n_nationkey") % 3 == 1, (F.col("n_nationkey") * 10).cast("string")).when(F.col("n_nationkey") % 3 == 2, "Wed, 21 Oct 2026 07:28:00 GMT")
    return table(spark, d, "nation").select("n_nationkey", report.retry_wait(F.col("n_nationkey") % 7, told).alias("wait"))


@query("SELECT page_id, (row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]+)', 1), run_id ORDER BY page_id) - 1) * 2.5 AS ready_s FROM raw_pages")
def host_pacing(spark: SparkSession, d: str) -> DataFrame:
    fetches = table(spark, d, "raw_pages").withColumn("host", F.concat_ws(" ", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.col("run_id").cast("string")))
    return report.pacing(fetches, "host", ["page_id"], F.lit(2.0), F.lit(2.5)).select("page_id", "ready_s")


# --- sources and sinks ---


@query(
    """WITH c AS (SELECT url, arg_max(status, fetched_at) AS status, max(fetched_at) AS fetched_at FROM raw_pages WHERE status < 400 GROUP BY url), r AS (SELECT DISTINCT final_url AS url FROM raw_pages UNION SELECT DISTINCT url FROM errors WHERE url IS NOT NULL)
    SELECT r.url, CASE WHEN c.fetched_at > TIMESTAMP '2026-05-01 12:00:00' - INTERVAL 480 HOUR THEN 'cache' ELSE 'network' END AS source, CASE WHEN c.url IS NOT NULL THEN 'cache' ELSE 'offline_miss' END AS offline FROM r LEFT JOIN c ON r.url = c.url WHERE r.url IS NOT NULL"""
)
def cache_freshness(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "raw_pages")
    cache = pages.cache_after(got.filter("false"), got, C.moment(NOW))
    asked = got.select(F.col("final_url").alias("url")).union(table(spark, d, "errors").select("url")).filter("url IS NOT NULL").distinct()
    on = pages.cached(asked, cache, "on", C.moment(NOW), 480).select("url", "source")
    offline = pages.cached(asked, cache, "offline", C.moment(NOW)).select("url", F.col("source").alias("offline"))
    return on.join(offline, "url")


@query("SELECT n_nationkey, '/' || n_nationkey || '/' || strftime(day, '%Y%m%d') || '.json' AS seed FROM nation, (SELECT unnest(generate_series(DATE '2026-01-01', DATE '2026-02-15', INTERVAL 1 DAY)) AS day) WHERE isodow(day) NOT IN (6, 7)")
def date_seeds(spark: SparkSession, d: str) -> DataFrame:
    sites = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("/"), F.col("n_nationkey").cast("string"), F.lit("/")).alias("folder"))
    days = pages.date_seeds(sites, "{date:%Y%m%d}.json", dt.date(2026, 1, 1), dt.date(2026, 2, 15), [5, 6])
    return days.select("n_nationkey", F.concat("folder", "url").alias("seed"))


@query("SELECT n_nationkey, p AS page_no, CASE WHEN p = 1 THEN 'https://x/' || n_nationkey ELSE 'https://x/' || n_nationkey || '?p=' || (p + 2) END AS url FROM nation, (SELECT unnest(generate_series(1, 10)) AS p)")
def page_template(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("https://x/"), F.col("n_nationkey").cast("string")).alias("url"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("page_no"))
    onward = pages.page_url(F.concat("url", F.lit("?p={page}")), 3, F.col("page_no"))
    return seeds.select("n_nationkey", "page_no", F.when(F.col("page_no") == 1, F.col("url")).otherwise(onward).alias("url"))


_ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /listado  # pages of lists\nAllow: /listado?p=1\nDisallow: /*/3$\nDisallow: /doc/\nAllow: /doc/*5\nCrawl-delay: 3\n"


@query(
    r"""SELECT page_id, coalesce((SELECT arg_max(allow, size * 2 + allow::INT) FROM (VALUES (false, 8, '^/listado'), (true, 12, '^/listado[?]p=1'), (false, 5, '^/.*/3$'), (false, 5, '^/doc/'), (true, 7, '^/doc/.*5')) AS r(allow, size, rx)
    WHERE regexp_matches(regexp_extract(url, '^[a-z]+://[^/]+(.*)$', 1), rx)), true) AS allowed FROM raw_pages"""
)
def robots_longest_match(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "raw_pages").select("page_id", "url")
    texts = got.select(origin(F.col("url")).alias("origin")).distinct().select("origin", F.lit(200).alias("status"), F.lit(_ROBOTS).alias("text"))
    return pages.allowed(got, pages.robots_rules(texts, "bot/1.0")).select("page_id", "allowed")


@query(
    """SELECT id, source_url AS _url, json_extract_string(data, '$.titulo') AS titulo, first_seen AS _first_seen, last_seen AS _last_seen, gone_at AS _gone_at,
    CASE WHEN json_type(data, '$.tags') = 'ARRAY' THEN array_to_string(json_extract_string(data, '$.tags[*]'), '; ') ELSE json_extract_string(data, '$.tags') END AS tags FROM items WHERE gone_at IS NULL"""
)
def export_flatten(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "items").withColumn("data", F.to_json(F.map_from_arrays(F.array(F.lit("id"), F.lit("titulo"), F.lit("tags")), F.array(F.col("id").cast("string"), *(F.try_element_at(F.from_json("data", "map<string,string>"), F.lit(k)) for k in ("titulo", "tags"))))))
    return export.flatten(items, ["id", "titulo", "tags"], active_only=True).withColumn("id", F.col("id").cast("bigint"))


@query("SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(text, 1, 999) || '…' ELSE text END AS text FROM documents")
def cell_truncate(spark: SparkSession, d: str) -> DataFrame:
    return export.cut_cells(table(spark, d, "documents").select("doc_id", "text"), 1000)


@query("SELECT o_orderkey AS id, NULL::VARCHAR AS notes, o_orderstatus AS status FROM orders UNION ALL SELECT c_custkey, c_name, NULL FROM customer")
def schema_evolution(spark: SparkSession, d: str) -> DataFrame:
    """Tables of two versions, each without a column of the other, as the store reads them."""
    schema = "id bigint, notes string, status string"
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return conform(old, schema).unionByName(conform(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("notes")), schema))


@query("SELECT id, run_id, url, kind, substr(message, 1, 30) AS message FROM errors")
def error_log(spark: SparkSession, d: str) -> DataFrame:
    """The store's cut of messages, at a limit that these short messages reach."""
    return cut_messages(table(spark, d, "errors").select("id", "run_id", "url", "kind", "message"), 30)


@query("SELECT id, run_id, url, kind, substr(message, 1, 4000) AS message FROM errors")
def error_log_whole(spark: SparkSession, d: str) -> DataFrame:
    """The error log as the store keeps it, with its own limit."""
    return cut_messages(table(spark, d, "errors").select("id", "run_id", "url", "kind", "message"))


# --- whole runs: see scenario, whose conditions the SQL states again ---

_STORES: dict = {}


def _runs(spark: SparkSession, d: str, limit: int | None = None):
    """The store and reports of the scenario over a folder's suppliers; run once per session and folder."""
    key = (spark.sparkContext.applicationId, d, limit)
    if key not in _STORES:
        _STORES[key] = scenario.run_all(spark, table(spark, d, "supplier"), limit)
    return _STORES[key]


#: k, name, nation, b, and whether the record passes the filter: a blank name does.
_S = "s AS (SELECT s_suppkey AS k, s_name AS name, s_nationkey AS nation, round(s_acctbal, 2) AS b, s_acctbal > 9000 OR s_name NOT LIKE '%7' AS passes FROM supplier)"
_T = [f"TIMESTAMP '2026-05-{d} 12:00:00'" for d in ("01", "06", "11")]


@query(
    f"""WITH {_S}, p AS (SELECT *, b >= -500 AND b < 0 AS twice, b >= 0 AND b < 500 AS away, (b >= 1000 AND b < 3000) AS one, b >= 4000 AND b < 5000 AS two FROM s WHERE passes AND b <= 9000)
    SELECT CAST(k AS VARCHAR) AS natural_key, k AS key, name, round(b + CASE WHEN one THEN 1 WHEN two THEN 2 ELSE 0 END, 2) AS balance, CAST(nation AS BIGINT) AS nation, '{scenario.BASE}/s/' || k AS source_url,
        CASE WHEN b < -500 THEN {_T[1]} ELSE {_T[0]} END AS first_seen, {_T[2]} AS last_seen, CASE WHEN two THEN {_T[2]} WHEN b < -500 OR one OR twice THEN {_T[1]} ELSE {_T[0]} END AS last_changed,
        CASE WHEN two THEN {_T[2]} WHEN away THEN {_T[0]} ELSE {_T[1]} END AS fetched_at, NULL::TIMESTAMP AS gone_at, CASE WHEN two THEN 3 WHEN b < -500 OR one OR twice THEN 2 ELSE 1 END::BIGINT AS run_id, 3::BIGINT AS seen_run_id FROM p"""
)
def site_items(spark: SparkSession, d: str) -> DataFrame:
    """Items after three runs: new, updated, unchanged, listed twice, skipped, gone and back."""
    v = F.try_parse_json("data")
    got = lambda k, t: F.try_variant_get(v, f"$.{k}", t).alias(k)
    return _runs(spark, d)[0].items().select("natural_key", got("key", "bigint"), got("name", "string"), got("balance", "double"), got("nation", "bigint"), "source_url", "first_seen", "last_seen", "last_changed", "fetched_at", "gone_at", "run_id", "seen_run_id")


_PAGES = f"""blocks AS (SELECT DISTINCT k // {2 * scenario.PAGE} AS block FROM s), pages AS (SELECT DISTINCT r, k // {2 * scenario.PAGE} AS block, k // {scenario.PAGE} % 2 AS second FROM s, (VALUES (1), (2), (3)) AS t(r) WHERE r = 1 OR b <= 9000 AND (r = 3 OR NOT (b >= 0 AND b < 500))),
    listing AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE second = 0) AS firsts, count(*) FILTER (WHERE second = 1) AS seconds FROM pages GROUP BY r)"""


@query(
    f"""WITH {_S}, {_PAGES}, c AS (SELECT count(*) FILTER (WHERE passes) + count(*) FILTER (WHERE passes AND b >= -500 AND b < 0) AS seen1, count(*) FILTER (WHERE NOT passes) + count(*) FILTER (WHERE NOT passes AND b >= -500 AND b < 0) AS out1, count(*) FILTER (WHERE b > 9000) AS bad,
        count(*) FILTER (WHERE passes AND b < -500) AS lost, count(*) FILTER (WHERE passes AND b < -900) AS barred, count(*) FILTER (WHERE passes AND b >= -500 AND b < 0) AS twice, count(*) FILTER (WHERE passes AND b >= 0 AND b < 500) AS away, count(*) FILTER (WHERE NOT passes AND b >= 0 AND b < 500) AS out_away,
        count(*) FILTER (WHERE passes AND b <= 9000) AS ok, count(*) FILTER (WHERE NOT passes) AS out_, count(*) FILTER (WHERE passes AND b >= 1000 AND b < 3000) AS one, count(*) FILTER (WHERE passes AND b >= 4000 AND b < 5000) AS two FROM s)
    SELECT 1 AS run, 'ok' AS status, seen1 AS items_seen, out1 AS items_filtered, bad AS items_invalid, bad AS empty_names, n + (firsts - seconds) + ok - lost + bad AS pages, 0 AS pages_cached, ok - lost AS items_new, twice AS items_updated, 0 AS items_unchanged, 0 AS items_skipped, 0 AS items_gone, lost + bad AS errors FROM c, listing WHERE r = 1
    UNION ALL SELECT 2, 'ok', ok - away, out_ - out_away, 0, 0, n + (firsts - seconds) + ok - away, 0, lost, one + twice, ok - away - lost - one - twice, 0, away, 0 FROM c, listing WHERE r = 2
    UNION ALL SELECT 3, 'ok', ok, out_, 0, 0, n + (firsts - seconds) + two, 0, 0, two, 0, ok - two, 0, 0 FROM c, listing WHERE r = 3"""
)
def site_reports(spark: SparkSession, d: str) -> DataFrame:
    """What each run reported: records seen, filtered, invalid, new, updated, unchanged, skipped and gone, pages and errors."""
    return _runs(spark, d)[1]


@query(
    f"""WITH {_S} SELECT 1::BIGINT AS run_id, CASE WHEN b < -900 THEN '{scenario.BASE}/x/' || k WHEN b < -500 THEN '{scenario.BASE}/s/' || k ELSE '{scenario.BASE}/s/' || k END AS url, CASE WHEN b < -900 THEN 'robots' WHEN b < -500 THEN 'fetch' ELSE 'validate' END AS kind,
    CASE WHEN b < -900 THEN 'robots: forbidden by robots.txt' WHEN b < -500 THEN 'no response' ELSE 'required but empty: name' END AS message FROM s WHERE passes AND (b < -500 OR b > 9000)"""
)
def site_errors(spark: SparkSession, d: str) -> DataFrame:
    """The error log: forbidden pages, pages that aren't there, and records that lack a required field."""
    return _runs(spark, d)[0].log("errors").select("run_id", "url", "kind", "message")


@query(
    f"""WITH {_S}, {_PAGES}, d AS (SELECT r, k FROM s, (VALUES (1), (2), (3)) AS t(r) WHERE passes AND CASE r WHEN 1 THEN b >= -500 WHEN 2 THEN b <= 9000 AND NOT (b >= 0 AND b < 500) ELSE b >= 4000 AND b < 5000 END)
    SELECT r::BIGINT AS run_id, '{scenario.BASE}/l/' || block || CASE WHEN second = 1 THEN '/2' ELSE '' END AS url, 'list' AS kind, 200 AS status FROM pages
    UNION ALL SELECT p.r::BIGINT, '{scenario.BASE}/l/' || block || '/2', 'list', 404 FROM pages p WHERE second = 0 AND NOT EXISTS (SELECT 1 FROM pages q WHERE q.r = p.r AND q.block = p.block AND q.second = 1)
    UNION ALL SELECT r::BIGINT, '{scenario.BASE}/s/' || k, 'detail', 200 FROM d"""
)
def site_pages(spark: SparkSession, d: str) -> DataFrame:
    """The page log: list pages by their next links, up to a 404 or a page seen before, and each detail page once."""
    return _runs(spark, d)[0].log("pages").select("run_id", "url", "kind", "status")


@query(
    f"""WITH {_S}, p AS (SELECT *, row_number() OVER (ORDER BY k // {2 * scenario.PAGE}, k // {scenario.PAGE} % 2, k) AS place FROM s WHERE passes), first_ AS (SELECT k, b, sum(CASE WHEN b >= -500 AND b < 0 THEN 2 ELSE 1 END) OVER (ORDER BY place) AS upto FROM p)
    SELECT k AS natural_key FROM first_ WHERE b >= -500 AND b <= 9000 AND upto - CASE WHEN b < 0 THEN 1 ELSE 0 END <= 30"""
)
def site_limit(spark: SparkSession, d: str) -> DataFrame:
    """The limit is the feature: the records stored of the first 30 that pass the filters, in the order of the listing."""
    return _runs(spark, d, 30)[0].items().select(F.col("natural_key").cast("bigint").alias("natural_key"))


@query(f"WITH {_S} SELECT count(*) AS items, 1::BIGINT AS first, count(*) AS last, count(*) AS ids FROM s WHERE passes AND b <= 9000")
def site_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids are unique and without gaps, as no run failed."""
    return _runs(spark, d)[0].items().agg(F.count(F.lit(1)).alias("items"), F.min("id").alias("first"), F.max("id").alias("last"), F.count_distinct("id").alias("ids"))


@query("""SELECT id, site, natural_key, CASE WHEN seen_run_id IS NOT NULL AND run_id = seen_run_id THEN NULL WHEN gone_at IS NULL THEN TIMESTAMP '2026-05-01 12:00:00' ELSE gone_at END AS gone_at FROM items""")
def gone_and_back(spark: SparkSession, d: str) -> DataFrame:
    """A run that touches the items changed by the last run that saw them, and sees nothing else: those are back, the rest is gone."""
    items = _stored(spark, d)
    nothing = lifecycle.classify(items.filter("false").withColumns({"start_pos": F.lit(0), "page_no": F.lit(0), "item_pos": F.lit(0)}), items, ["start_pos", "page_no", "item_pos"])
    after = lifecycle.upsert(items, nothing, items.filter("run_id = seen_run_id"), 999999, C.moment(NOW), ["start_pos", "page_no", "item_pos"], True)
    return after.select("id", "site", "natural_key", "gone_at")
