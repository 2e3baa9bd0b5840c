"""Queries of the data problems that belong to the core, over the tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import drift, history, increments, nesting, profile
from sedimenta.session import cut, scratch


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    loads, runs = table(spark, d, "item_loads"), table(spark, d, "runs")
    return drift.steps(drift.fingerprints(loads, runs), loads)


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    loads, runs = table(spark, d, "item_loads"), table(spark, d, "runs")
    prints = drift.fingerprints(loads, runs)
    found = drift.steps(prints, loads)
    return drift.conform(loads, runs, prints, found, drift.targets(prints, found))


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """The table of p2_table, a row per load row and field, with the text of a value that can't be cast."""
    # written first: exploding it as a plan would compute each row again for the filter that comes with an explosion
    rows = cut(p2_table(spark, d).select("load_id", "fields", "failed")).select("load_id", F.explode("fields").alias("field", "value"), "failed")
    return rows.select("load_id", "field", "value", F.try_element_at("failed", "field").alias("failed"))


def p2_versions(spark: SparkSession, d: str) -> DataFrame:
    prints = drift.fingerprints(table(spark, d, "item_loads"), table(spark, d, "runs"))
    return prints.select("site", "run_id", "fingerprint", F.col("prev.fingerprint").alias("prev_fingerprint"), F.size("held").alias("n_fields"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """All rows in one update of a history."""
    store = history.HistoryStore(spark, scratch(spark, "history"))
    store.update(table(spark, d, "item_loads"))
    return store.read().select("site", "natural_key", F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss").alias("valid_from"))


def p3_history(spark: SparkSession, d: str) -> DataFrame:
    """All rows in two updates, as they arrived: the second, rows that arrived from the middle of the period on, rebuilds the chains it touches."""
    loads = table(spark, d, "item_loads")
    ends = loads.agg(F.min("loaded_at").alias("a"), F.max("loaded_at").alias("z")).collect()[0]
    store = history.HistoryStore(spark, scratch(spark, "history"))
    late = F.coalesce(F.col("loaded_at") >= F.lit(ends["a"] + (ends["z"] - ends["a"]) / 2 if ends["a"] else None).cast("timestamp_ntz"), F.lit(False))
    for part in (loads.filter(~late), loads.filter(late)):
        store.update(part)
    return store.read().select("site", "natural_key", "valid_from", "valid_to", "is_current")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nesting.flatten(table(spark, d, "json_docs")).select("json_id", "node_level", "node_path").distinct()


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nesting.flatten(table(spark, d, "json_docs")).drop("node_json", "fields")


#: The levels of the tables below: those of nodes, and the pages of an annex, which have no name. And the members that are their columns.
TABLES = {
    "diario": ["numero", "sumario_diario.identificador", "sumario_diario.url_pdf.texto"],
    "seccion": ["codigo", "nombre"],
    "departamento": ["codigo", "nombre"],
    "epigrafe": ["nombre"],
    "item": ["identificador", "titulo", "url_html", "url_pdf.texto", "url_pdf.pagina_inicial", "anexo"],
    "anexo": ["ref", "titulo"],
    "paginas": ["desde", "hasta"],
}


def _level(level: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        found = nesting.flatten(table(spark, d, "json_docs"), levels=nesting.LEVELS | {"paginas": None}, with_fields=True)
        return nesting.level_table(found, level, TABLES[level])

    return query


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    return nesting.members(nesting.flatten(table(spark, d, "json_docs"), with_fields=True)).filter("member NOT LIKE '%.%'")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The table lands as one batch and is processed up to it."""
    reader = increments.IncrementalReader(spark, scratch(spark, "increments"))
    reader.land(f"{d}/item_loads.parquet")
    reader.process(table(spark, d, "runs"))
    return reader.read()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    loads, runs = table(spark, d, "item_loads"), table(spark, d, "runs")
    counts = profile.mask_counts(loads, table(spark, d, "site_fields"))
    found = profile.findings(profile.field_profile(counts, loads, runs), loads)
    return found.unionByName(profile.run_findings(runs, table(spark, d, "run_reports")))


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    loads, runs = table(spark, d, "item_loads"), table(spark, d, "runs")
    seen = profile.field_profile(profile.mask_counts(loads, table(spark, d, "site_fields"), distinct=True), loads, runs)
    return seen.select("site", "run_id", "field", "rows", "present", "empty", (F.col("empty") / F.col("rows")).alias("null_rate"), "distinct", "strings", "bad", "numbers", "outside", "low", "high")


def p6_columns(spark: SparkSession, d: str) -> DataFrame:
    found = None
    for name in ("item_loads", "runs", "run_reports"):
        part = profile.column_profile(table(spark, d, name), name)
        found = part if found is None else found.unionByName(part)
    return found


def p6_masks(spark: SparkSession, d: str) -> DataFrame:
    loads, runs = table(spark, d, "item_loads"), table(spark, d, "runs")
    return profile.mask_report(profile.mask_counts(loads, table(spark, d, "site_fields"), spaced=True, nested=True), loads, runs)


QUERIES = {f.__name__: f for f in (p2_found, p2_table, p2_values, p2_versions, p3_found, p3_history, p4_found, p4_nodes, p4_members, p5_found, p6_found, p6_profile, p6_masks, p6_columns)}
QUERIES |= {f"p4_{level}": _level(level) for level in TABLES}


_LOADS = """f AS (SELECT l.load_run_id AS run_id, l.site, l.load_id, l.natural_key, coalesce(l.gone_at, l.last_seen) AS moment, l.loaded_at, e.key AS field, e.value AS value,
        CASE WHEN e.type = 'VARCHAR' THEN 'string' WHEN e.type = 'BOOLEAN' THEN 'boolean' WHEN e.type = 'ARRAY' THEN 'array' WHEN e.type = 'OBJECT' THEN 'object' WHEN e.type = 'NULL' THEN NULL ELSE 'number' END AS kind
        FROM item_loads l, json_each(l.data) e),
    loads AS (SELECT l.site, l.load_run_id AS run_id, l.n, lag(l.load_run_id) OVER (PARTITION BY l.site ORDER BY r.started_at, l.load_run_id) AS prev_run
        FROM (SELECT site, load_run_id, count(*) AS n FROM item_loads GROUP BY ALL HAVING count(*) >= 20) l LEFT JOIN (SELECT id, min(started_at) AS started_at FROM runs GROUP BY id) r ON r.id = l.load_run_id),
    kinds AS (SELECT site, run_id, field, kind, count(*) AS n FROM f GROUP BY ALL),
    held AS (SELECT k.site, k.run_id, k.field, any_value(l.n) AS rows, any_value(l.prev_run) AS prev_run, sum(k.n) AS present, arg_max(k.kind, k.n) FILTER (WHERE k.kind IS NOT NULL) AS top, max(k.n) FILTER (WHERE k.kind IS NOT NULL) AS top_n, coalesce(sum(k.n) FILTER (WHERE k.kind IS NOT NULL), 0) AS filled
        FROM kinds k JOIN loads l USING (site, run_id) GROUP BY k.site, k.run_id, k.field HAVING 2 * sum(k.n) >= any_value(l.n))"""

ORACLES = {
    "p2_found": f"""WITH {_LOADS},
    gone AS (SELECT l.site, l.run_id, l.prev_run, h.field FROM loads l JOIN held h ON h.site = l.site AND h.run_id = l.prev_run WHERE NOT EXISTS (SELECT 1 FROM held x WHERE x.site = l.site AND x.run_id = l.run_id AND x.field = h.field)),
    fresh AS (SELECT h.site, h.run_id, h.prev_run, h.field FROM held h WHERE h.prev_run IS NOT NULL AND NOT EXISTS (SELECT 1 FROM held x WHERE x.site = h.site AND x.run_id = h.prev_run AND x.field = h.field)),
    last_rows AS (SELECT load_id FROM item_loads QUALIFY row_number() OVER (PARTITION BY site, load_run_id, natural_key ORDER BY coalesce(gone_at, last_seen) DESC, loaded_at DESC, load_id DESC) = 1),
    v AS (SELECT f.* FROM f SEMI JOIN last_rows USING (load_id)),
    pairs AS (SELECT g.site, g.run_id, g.field, n.field AS new_field, count(*) AS n, count(*) FILTER (WHERE a.value = b.value) AS same FROM gone g JOIN fresh n USING (site, run_id)
        JOIN v a ON a.site = g.site AND a.run_id = g.prev_run AND a.field = g.field AND a.kind IS NOT NULL JOIN v b ON b.site = g.site AND b.run_id = g.run_id AND b.field = n.field AND b.natural_key = a.natural_key GROUP BY ALL),
    renamed AS (SELECT site, run_id, field, new_field FROM pairs WHERE 2 * same > n)
    SELECT site, run_id, 'renamed' AS change_kind, field, new_field FROM renamed
    UNION ALL SELECT site, run_id, 'removed', field, '' FROM gone ANTI JOIN renamed USING (site, run_id, field)
    UNION ALL SELECT site, run_id, 'added', field, '' FROM fresh WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.site = fresh.site AND r.run_id = fresh.run_id AND r.new_field = fresh.field)
    UNION ALL SELECT h.site, h.run_id, 'retyped', h.field, '' FROM held h JOIN held p ON p.site = h.site AND p.run_id = h.prev_run AND p.field = h.field WHERE 2 * h.top_n > h.filled AND 2 * p.top_n > p.filled AND h.top <> p.top""",
    "p3_found": """WITH st AS (SELECT l.load_id, string_agg(t.fullkey || ':' || t.type || ':' || coalesce(t.atom::VARCHAR, ''), chr(1) ORDER BY t.fullkey) AS state FROM item_loads l, json_tree(l.data) t GROUP BY l.load_id),
    o AS (SELECT site, natural_key, load_id, coalesce(gone_at, last_seen) AS m, gone_at IS NOT NULL AS gone, state FROM item_loads JOIN st USING (load_id)),
    w AS (SELECT *, lag(gone) OVER c AS prev_gone, lag(state) OVER c AS prev_state FROM o WINDOW c AS (PARTITION BY site, natural_key ORDER BY m, gone, load_id))
    SELECT site, natural_key, strftime(m, '%Y-%m-%d %H:%M:%S') AS valid_from FROM w WHERE NOT gone AND (prev_gone IS NULL OR prev_gone OR prev_state <> state)""",
    "p4_found": """WITH RECURSIVE d AS (SELECT json_id, ltrim(body, chr(65279)) AS body FROM json_docs WHERE json_valid(ltrim(body, chr(65279)))),
    t AS (SELECT d.json_id, t.id, t.parent, t.key, t.type, t.value FROM d, json_tree(d.body) t),
    named AS (SELECT t.json_id, t.id, t.parent, t.value, t.type, CASE WHEN p.type = 'ARRAY' THEN p.key ELSE t.key END AS level FROM t LEFT JOIN t p ON p.json_id = t.json_id AND p.id = t.parent),
    nodes AS (SELECT json_id, id, parent, level, coalesce(json_extract_string(value, '$.' || CASE level WHEN 'diario' THEN 'numero' WHEN 'epigrafe' THEN 'nombre' WHEN 'item' THEN 'identificador' WHEN 'anexo' THEN 'ref' ELSE 'codigo' END), '') AS name
        FROM named WHERE type = 'OBJECT' AND level IN ('diario', 'seccion', 'departamento', 'epigrafe', 'item', 'anexo')),
    up AS (SELECT json_id, id AS node, level, name AS path, parent AS above FROM nodes
        UNION ALL SELECT up.json_id, up.node, up.level, CASE WHEN n.id IS NULL THEN up.path ELSE n.name || ' > ' || up.path END, t.parent FROM up JOIN t ON t.json_id = up.json_id AND t.id = up.above LEFT JOIN nodes n ON n.json_id = up.json_id AND n.id = up.above)
    SELECT DISTINCT json_id, level AS node_level, path AS node_path FROM up WHERE above IS NULL""",
    "p5_found": """WITH s AS (SELECT site, natural_key, coalesce(last_changed, fetched_at) AS changed, min(loaded_at) AS known FROM item_loads GROUP BY ALL),
    r AS (SELECT site, id, min(finished_at) AS finished FROM runs WHERE lower(trim(status)) IN ('ok', 'degraded') AND finished_at IS NOT NULL GROUP BY ALL)
    SELECT DISTINCT r.id AS run_id, s.site, s.natural_key FROM s ASOF JOIN r ON s.site = r.site AND s.known <= r.finished""",
    "p6_found": f"""WITH {_LOADS},
    figures AS (SELECT h.site, h.run_id, h.field, h.rows, h.prev_run, h.rows - count(*) FILTER (WHERE f.kind IS NOT NULL AND NOT (f.kind = 'string' AND json_extract_string(f.value, '$') = '') AND NOT (f.kind = 'array' AND json_array_length(f.value) = 0)) AS empty,
        count(*) FILTER (WHERE f.kind = 'string' AND json_extract_string(f.value, '$') <> '') AS strings, count(*) FILTER (WHERE f.kind = 'string' AND json_extract_string(f.value, '$') <> '' AND NOT regexp_matches(json_extract_string(f.value, '$'), s.pattern)) AS bad,
        count(*) FILTER (WHERE f.kind = 'number') AS numbers, count(*) FILTER (WHERE f.kind = 'number' AND (TRY_CAST(f.value AS DOUBLE) < s.min_value OR TRY_CAST(f.value AS DOUBLE) > s.max_value)) AS outside, median(CASE WHEN f.kind = 'number' THEN TRY_CAST(f.value AS DOUBLE) END) AS med
        FROM held h JOIN f USING (site, run_id, field) LEFT JOIN site_fields s ON s.site = h.site AND s.field = h.field GROUP BY h.site, h.run_id, h.field, h.rows, h.prev_run),
    pairs AS (SELECT a.*, b.rows AS p_rows, b.empty AS p_empty, b.numbers AS p_numbers, b.med AS p_med FROM figures a LEFT JOIN figures b ON b.site = a.site AND b.run_id = a.prev_run AND b.field = a.field)
    SELECT site, run_id, field, 'null_rate' AS finding FROM pairs WHERE 4 * (empty * p_rows - p_empty * rows) >= rows * p_rows
    UNION ALL SELECT site, run_id, field, 'pattern' FROM pairs WHERE bad > 0 AND bad * 10 >= strings
    UNION ALL SELECT site, run_id, field, 'range' FROM pairs WHERE outside > 0 AND outside * 10 >= numbers
    UNION ALL SELECT site, run_id, field, 'shift' FROM pairs WHERE numbers >= 10 AND p_numbers >= 10 AND med > 0 AND p_med > 0 AND (med > 3 * p_med OR 3 * med < p_med)
    UNION ALL (SELECT DISTINCT site, id, 'status', 'domain' FROM runs WHERE status IS NULL OR status NOT IN ('running', 'ok', 'degraded', 'aborted', 'error', 'interrupted', 'dry-run'))
    UNION ALL (SELECT DISTINCT site, run_id, e.field, 'report' FROM (SELECT site, run_id, items_seen - items_skipped AS most, unnest(map_keys(empty_fields)) AS field, unnest(map_values(empty_fields)) AS n FROM run_reports) e WHERE n < 0 OR n > most)""",
}
ORACLES["p3_history"] = """WITH st AS (SELECT l.load_id, string_agg(t.fullkey || ':' || t.type || ':' || coalesce(t.atom::VARCHAR, ''), chr(1) ORDER BY t.fullkey) AS state FROM item_loads l, json_tree(l.data) t GROUP BY l.load_id),
    o AS (SELECT site, natural_key, load_id, coalesce(gone_at, last_seen) AS m, gone_at IS NOT NULL AS gone, state FROM item_loads JOIN st USING (load_id)),
    w AS (SELECT *, lag(gone) OVER c AS prev_gone, lag(state) OVER c AS prev_state FROM o WINDOW c AS (PARTITION BY site, natural_key ORDER BY m, gone, load_id)),
    b AS (SELECT *, lead(m) OVER (PARTITION BY site, natural_key ORDER BY m, gone, load_id) AS valid_to FROM w WHERE (gone AND NOT prev_gone) OR (NOT gone AND (prev_gone IS NULL OR prev_gone OR prev_state <> state)))
    SELECT site, natural_key, m AS valid_from, valid_to, valid_to IS NULL AS is_current FROM b WHERE NOT gone"""

_NAMES = {"diario": "numero", "epigrafe": "nombre", "item": "identificador", "anexo": "ref", "seccion": "codigo", "departamento": "codigo"}


def _tree(levels: dict[str, str | None]) -> str:
    """CTEs: nodes, and up with the place, parent's place, depth and path of each."""
    name = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in levels.items() if v)
    return f"""WITH RECURSIVE d AS (SELECT json_id, ltrim(body, chr(65279)) AS body FROM json_docs WHERE json_valid(ltrim(body, chr(65279)))),
    t AS (SELECT d.json_id, t.id, t.parent, t.key, t.type, t.value FROM d, json_tree(d.body) t),
    named AS (SELECT t.json_id, t.id, t.parent, t.value, t.type, CASE WHEN p.type = 'ARRAY' THEN p.key ELSE t.key END AS level FROM t LEFT JOIN t p ON p.json_id = t.json_id AND p.id = t.parent),
    nodes AS (SELECT json_id, id, parent, level, value, coalesce(json_extract_string(value, '$.' || CASE level {name} END), '') AS name, row_number() OVER (PARTITION BY json_id ORDER BY id) - 1 AS ordinal
        FROM named WHERE type = 'OBJECT' AND level IN ({", ".join(f"'{k}'" for k in levels)})),
    climb AS (SELECT json_id, id AS node, level, ordinal, name, value, name AS path, parent AS above, 0 AS depth, NULL::BIGINT AS over FROM nodes
        UNION ALL SELECT c.json_id, c.node, c.level, c.ordinal, c.name, c.value, CASE WHEN n.id IS NULL THEN c.path ELSE n.name || ' > ' || c.path END, t.parent, c.depth + (n.id IS NOT NULL)::INT, coalesce(c.over, n.ordinal)
        FROM climb c JOIN t ON t.json_id = c.json_id AND t.id = c.above LEFT JOIN nodes n ON n.json_id = c.json_id AND n.id = c.above),
    up AS (SELECT *, json_id || '/' || ordinal AS node_id, json_id || '/' || over AS parent_id FROM climb WHERE above IS NULL)"""


ORACLES["p4_nodes"] = f"{_tree(_NAMES)} SELECT json_id, node_id, parent_id, level AS node_level, name, depth, CAST(ordinal AS INT) AS ordinal, path AS node_path FROM up"
ORACLES["p4_members"] = f"""{_tree(_NAMES)} SELECT n.level AS node_level, t.key AS member, count(*) AS nodes FROM nodes n JOIN t ON t.json_id = n.json_id AND t.parent = n.id
    WHERE t.type <> 'OBJECT' AND NOT (t.type = 'ARRAY' AND t.key IN ('diario', 'seccion', 'departamento', 'epigrafe', 'item', 'anexo')) GROUP BY ALL"""
for _level_name, _members in TABLES.items():
    _columns = ", ".join(f"CASE WHEN json_type(value, '$.{m}') NOT IN ('ARRAY', 'OBJECT') THEN json_extract_string(value, '$.{m}') END AS {m.replace('.', '_')}" for m in _members)
    ORACLES[f"p4_{_level_name}"] = f"{_tree(_NAMES | {'paginas': None})} SELECT json_id, node_id, parent_id, CAST(ordinal AS INT) AS ordinal, name, {_columns} FROM up WHERE level = '{_level_name}'"

ORACLES["p2_versions"] = f"""WITH {_LOADS},
    typed AS (SELECT site, run_id, field, CASE WHEN 2 * top_n > filled THEN top END AS type FROM held),
    prints AS (SELECT l.site, l.run_id, any_value(l.prev_run) AS prev_run, count(t.field) AS n_fields,
        md5('[' || coalesce(string_agg('{{"field":' || CAST(to_json(t.field) AS VARCHAR) || coalesce(',"type":"' || t.type || '"', '') || '}}', ',' ORDER BY t.field) FILTER (WHERE t.field IS NOT NULL), '') || ']') AS fingerprint
        FROM loads l LEFT JOIN typed t ON t.site = l.site AND t.run_id = l.run_id GROUP BY l.site, l.run_id)
    SELECT p.site, p.run_id, p.fingerprint, b.fingerprint AS prev_fingerprint, CAST(p.n_fields AS INT) AS n_fields FROM prints p LEFT JOIN prints b ON b.site = p.site AND b.run_id = p.prev_run"""
ORACLES["p6_profile"] = f"""WITH {_LOADS},
    v AS (SELECT f.*, CASE WHEN f.kind = 'string' THEN json_extract_string(f.value, '$') END AS text, CASE WHEN f.kind = 'number' THEN TRY_CAST(f.value AS DOUBLE) END AS number FROM f)
    SELECT h.site, h.run_id, h.field, h.rows, h.present, h.rows - count(*) FILTER (WHERE v.kind IS NOT NULL AND coalesce(v.text, 'x') <> '' AND NOT (v.kind = 'array' AND json_array_length(v.value) = 0)) AS empty, empty / h.rows AS null_rate,
        count(DISTINCT CASE WHEN v.kind IS NOT NULL THEN v.kind || ':' || coalesce(v.text, CAST(v.number AS VARCHAR), CAST(v.value AS VARCHAR)) END) AS distinct,
        count(*) FILTER (WHERE v.text <> '') AS strings, count(*) FILTER (WHERE v.text <> '' AND NOT regexp_matches(v.text, s.pattern)) AS bad,
        count(v.number) AS numbers, count(*) FILTER (WHERE v.number < s.min_value OR v.number > s.max_value) AS outside, min(v.number) AS low, max(v.number) AS high
    FROM held h JOIN v USING (site, run_id, field) LEFT JOIN site_fields s ON s.site = h.site AND s.field = h.field GROUP BY h.site, h.run_id, h.field, h.rows, h.present"""


def _columns_of(name: str, columns: dict[str, str]) -> str:
    def one(c: str, kind: str) -> str:
        plain = f"CAST(to_json({{'v': {c}}}) AS VARCHAR)" if kind.startswith("array") else c
        given = f"CASE WHEN {c} IS NOT NULL THEN {plain} END"
        figures = "0 AS distinct, NULL::VARCHAR AS low, NULL::VARCHAR AS high" if kind.startswith("map") else f"count(DISTINCT {given}) AS distinct, CAST(min({given}) AS VARCHAR) AS low, CAST(max({given}) AS VARCHAR) AS high"
        return f"SELECT '{name}' AS table_name, '{c}' AS column, '{kind}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls, (count(*) - count({c})) / count(*) AS null_rate, {figures} FROM {name}"

    return " UNION ALL ".join(one(c, k) for c, k in columns.items())


_MOMENT, _BIG, _TEXT, _INT = "timestamp_ntz", "bigint", "string", "int"
_COLUMNS = {
    "item_loads": {"load_id": _BIG, "load_run_id": _BIG, "file_name": _TEXT, "loaded_at": _MOMENT, "id": _BIG, "site": _TEXT, "natural_key": _TEXT, "content_hash": _TEXT, "data": _TEXT, "source_url": _TEXT, "first_seen": _MOMENT, "last_seen": _MOMENT, "last_changed": _MOMENT, "run_id": _BIG, "seen_run_id": _BIG, "fetched_at": _MOMENT, "gone_at": _MOMENT},
    "runs": {"id": _BIG, "site": _TEXT, "started_at": _MOMENT, "finished_at": _MOMENT, "status": _TEXT} | {c: _INT for c in ("pages", "pages_cached", "items_new", "items_updated", "items_unchanged", "items_skipped", "items_gone", "errors")} | {"notes": _TEXT},
    "run_reports": {"run_id": _BIG, "site": _TEXT, "items_seen": _INT, "items_skipped": _INT, "items_invalid": _INT, "items_filtered": _INT, "warnings": "array<string>", "empty_fields": "map<string,bigint>"},
}
ORACLES["p6_columns"] = " UNION ALL ".join(_columns_of(n, c) for n, c in _COLUMNS.items())

_KIND = "CASE json_type({0}) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN 'null' ELSE 'number' END"
_JSON = """CASE {1} WHEN 'number' THEN CASE WHEN CAST({0} AS VARCHAR) LIKE '%.%' THEN regexp_replace(regexp_replace(CAST({0} AS VARCHAR), '0+$', ''), '[.]$', '') ELSE CAST({0} AS VARCHAR) END
        WHEN 'object' THEN (SELECT '{{' || coalesce(string_agg(CAST(to_json(o.key) AS VARCHAR) || ':' || CAST(o.value AS VARCHAR), ',' ORDER BY o.key), '') || '}}' FROM json_each({0}) o) ELSE CAST({0} AS VARCHAR) END"""
ORACLES["p2_values"] = f"""WITH RECURSIVE {ORACLES["p2_found"].removeprefix("WITH ").split("    SELECT site, run_id, 'renamed' AS change_kind")[0].rstrip()},
    began AS (SELECT id, min(started_at) AS at FROM runs GROUP BY id),
    hops AS (SELECT r.site, r.field, b.at AS since, min(r.new_field) AS name FROM renamed r JOIN began b ON b.id = r.run_id GROUP BY r.site, r.run_id, r.field, b.at),
    keys AS (SELECT DISTINCT site, run_id, field AS key FROM f),
    chain AS (SELECT k.site, k.run_id, k.key, k.key AS name, b.at, 0 AS step FROM keys k JOIN began b ON b.id = k.run_id
        UNION ALL (SELECT c.site, c.run_id, c.key, h.name, h.since, c.step + 1 FROM chain c JOIN hops h ON h.site = c.site AND h.field = c.name AND h.since > c.at QUALIFY row_number() OVER (PARTITION BY c.site, c.run_id, c.key ORDER BY h.since) = 1)),
    latest AS (SELECT site, run_id, key, arg_max(name, step) AS name FROM chain GROUP BY ALL),
    targets AS (SELECT h.site, l.name AS field, last(h.top ORDER BY b.at, h.run_id, h.top) FILTER (WHERE 2 * h.top_n > h.filled) AS target FROM held h JOIN latest l ON l.site = h.site AND l.run_id = h.run_id AND l.key = h.field JOIN began b ON b.id = h.run_id GROUP BY h.site, l.name),
    v1 AS (SELECT f.load_id, f.site, f.field AS was, l.name, t.target, f.value, {_KIND.format("f.value")} AS k FROM f JOIN latest l ON l.site = f.site AND l.run_id = f.run_id AND l.key = f.field LEFT JOIN targets t ON t.site = f.site AND t.field = l.name),
    v2 AS (SELECT *, {_JSON.format("value", "k")} AS js, CASE WHEN k = 'array' THEN CASE WHEN json_array_length(value) = 1 THEN json_extract(value, '$[0]') END WHEN k = 'object' THEN CASE WHEN len(json_keys(value)) = 1 THEN (SELECT any_value(o.value) FROM json_each(value) o) END ELSE value END AS inside FROM v1),
    v3 AS (SELECT *, CASE k WHEN 'string' THEN json_extract_string(value, '$') WHEN 'null' THEN NULL ELSE js END AS text, CASE WHEN inside IS NOT NULL THEN {_KIND.format("inside")} END AS ik FROM v2),
    v4 AS (SELECT *, CASE WHEN ik = 'string' THEN json_extract_string(inside, '$') ELSE {_JSON.format("inside", "ik")} END AS plain FROM v3),
    v5 AS (SELECT *, CASE WHEN target IS NULL OR k = target OR k = 'null' THEN text WHEN target = 'string' AND ik IN ('string', 'number', 'boolean') THEN plain WHEN target = 'number' AND ik IN ('string', 'number', 'boolean') AND regexp_matches(plain, '^-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?$') THEN plain
        WHEN target = 'boolean' AND ik IN ('string', 'number', 'boolean') AND plain IN ('true', 'false') THEN plain WHEN target = 'array' AND k <> 'array' THEN '[' || js || ']' WHEN target = 'object' AND k = 'array' AND ik = 'object' THEN plain END AS value_ FROM v4),
    best AS (SELECT load_id, site, name, value_, text FROM v5 QUALIFY row_number() OVER (PARTITION BY load_id, name ORDER BY (text IS NULL)::INT * 2 + (name <> was)::INT, was) = 1)
    SELECT load_id, name AS field, value_ AS value, CASE WHEN value_ IS NULL THEN text END AS failed FROM best
    UNION ALL SELECT l.load_id, t.field, NULL, NULL FROM item_loads l JOIN targets t ON t.site = l.site WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.load_id = l.load_id AND b.name = t.field)"""

_SHAPE = "CASE json_type({0}) WHEN 'VARCHAR' THEN 'STRING' WHEN 'BOOLEAN' THEN 'BOOLEAN' WHEN 'NULL' THEN 'VOID' ELSE 'NUMBER' END"
ORACLES["p6_masks"] = rf"""WITH {_LOADS},
    t AS (SELECT site, run_id, field, kind, value, CASE WHEN kind = 'string' THEN json_extract_string(value, '$') END AS t, CASE WHEN kind = 'number' THEN TRY_CAST(value AS DOUBLE) END AS x FROM f),
    each AS (SELECT site, run_id, field, CASE WHEN kind IS NULL THEN 'null' WHEN t = '' THEN ''
        WHEN length(t) > 120 AND regexp_matches(t, '[ \t\n\x0B\f\r]') THEN 'text:' || CASE WHEN regexp_matches(t, '[0-9]') THEN '9' ELSE '' END || CASE WHEN regexp_matches(t, '[^\p{{L}}0-9 \t\n\x0B\f\r]') THEN '.' ELSE '' END || length(bin(length(t)))
        WHEN length(t) > 24 THEN '+' || regexp_replace(regexp_replace(regexp_replace(t, '\p{{Nd}}+', '9', 'g'), '\p{{Lu}}+', 'A', 'g'), '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]+', 'a', 'g')
        WHEN kind = 'string' THEN regexp_replace(regexp_replace(regexp_replace(t, '\p{{Nd}}', '9', 'g'), '\p{{Lu}}', 'A', 'g'), '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]', 'a', 'g')
        WHEN kind = 'number' THEN '#' || CASE WHEN x < 0 THEN '-' ELSE '' END || CASE WHEN x = 0 THEN '0' ELSE CAST(CAST(floor(log10(abs(x))) AS BIGINT) AS VARCHAR) END || CASE WHEN x <> floor(x) THEN '.' ELSE '' END
        WHEN kind = 'boolean' THEN CAST(value AS VARCHAR)
        WHEN kind = 'array' THEN 'ARRAY<' || CASE WHEN json_array_length(value) = 0 THEN 'VOID' ELSE {_SHAPE.format("json_extract(value, '$[0]')")} END || '>:' || CASE WHEN json_array_length(value) > 9 THEN '2^' || (length(bin(json_array_length(value))) - 1) ELSE CAST(json_array_length(value) AS VARCHAR) END
        ELSE 'OBJECT<' || (SELECT string_agg(o.key || ': ' || {_SHAPE.format("o.value")}, ', ' ORDER BY o.key) FROM json_each(value) o) || '>' END AS mask FROM t),
    by_mask AS (SELECT site, run_id, field, mask, count(*) AS n FROM each GROUP BY ALL),
    at_site AS (SELECT site, field, mask, sum(n) AS site_n FROM by_mask GROUP BY ALL),
    site_total AS (SELECT site, field, sum(site_n) AS site_total, max(site_n) AS site_top_n, first(mask ORDER BY site_n DESC, mask) AS site_top FROM at_site GROUP BY ALL),
    here AS (SELECT b.*, l.prev_run FROM by_mask b JOIN loads l USING (site, run_id)),
    total AS (SELECT site, run_id, field, sum(n) AS total, max(n) AS top_n, first(mask ORDER BY n DESC, mask) AS dominant FROM here GROUP BY ALL),
    shares AS (SELECT h.site, h.run_id, h.prev_run, h.field, h.mask, h.n, h.n / t.total AS share, t.dominant, t.dominant <> h.mask AND t.top_n >= 0.9 * t.total AS in_load, s.site_top <> h.mask AND s.site_top_n >= 0.9 * s.site_total AS in_site, a.site_n < 0.01 * s.site_total OR a.site_n = 1 AS few
        FROM here h JOIN total t USING (site, run_id, field) JOIN at_site a USING (site, field, mask) JOIN site_total s USING (site, field)),
    had AS (SELECT s.site, s.run_id, s.field, sum(least(s.share, p.share)) AS common FROM shares s JOIN shares p ON p.site = s.site AND p.run_id = s.prev_run AND p.field = s.field AND p.mask = s.mask GROUP BY ALL)
    SELECT s.site, s.run_id, s.field, s.mask, s.n, s.share, s.dominant, (in_load AND s.share < 0.01 OR (in_load OR in_site) AND few) AND NOT (s.mask = s.dominant AND s.n >= 10) AS rare,
        CASE WHEN EXISTS (SELECT 1 FROM total p WHERE p.site = s.site AND p.run_id = s.prev_run AND p.field = s.field) THEN abs(round(1 - coalesce(h.common, 0), 6)) END AS divergence
    FROM shares s LEFT JOIN had h ON h.site = s.site AND h.run_id = s.run_id AND h.field = s.field"""
