"""The data problems: against plain Python on the smallest tables, and on awkward rows."""

import datetime as dt
import json
import random
import shutil
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sedimenta.functions.chains import linked
from sedimenta.functions.fields import fields
from sedimenta.operators import drift, history, increments, nesting, profile
from sedimenta.plans import problems
from sedimenta.sources.pointer import Conflict
from tests.conftest import DATA

LOADS = "load_id bigint, load_run_id bigint, file_name string, loaded_at timestamp_ntz, id bigint, site string, natural_key string, content_hash string, data string, source_url string, first_seen timestamp_ntz, last_seen timestamp_ntz, last_changed timestamp_ntz, run_id bigint, seen_run_id bigint, fetched_at timestamp_ntz, gone_at timestamp_ntz"
RUNS = "id bigint, site string, started_at timestamp_ntz, finished_at timestamp_ntz, status string"


def at(minute):
    return None if minute is None else dt.datetime(2026, 3, 1) + dt.timedelta(minutes=minute)


def load(load_id, key="k", data="{}", seen=None, gone=None, run=1, site="s", loaded=None, changed=None, fetched=None):
    return (load_id, run, "f", at(loaded), 1, site, key, None, data, None, None, at(seen), at(changed), run, run, at(fetched), at(gone))


def loads(spark, rows):
    # extra columns under names that the operators use themselves
    return spark.createDataFrame(rows, LOADS).withColumns({c: F.lit("x") for c in ("moment", "_prev", "_edge", "_slice", "state", "rows", "field", "value", "kind", "n", "_v", "_n")})


def versions(spark, rows, **k):
    found = history.rebuild(loads(spark, rows), **k).filter("begins").select("natural_key", "moment")
    return sorted(((r[0] or "", r[1]) for r in found.collect()), key=repr)


def test_history_awkward(spark):
    rows = [
        load(1, data='{"a":1,"b":[1,2]}', seen=1), load(2, data='{ "b" : [1, 2], "a" : 1.0 }', seen=2), load(3, data='{"a":"\\u00e1"}', seen=3), load(4, data='{"a":"á"}', seen=4),
        load(5, data=None, seen=5), load(6, data=None, seen=6), load(7, data="no json", seen=7), load(8, seen=8, gone=9), load(9, seen=9, gone=10), load(10, data="no json", seen=11), load(10, data="no json", seen=11),
        load(11, key=None, seen=1), load(12, key=None, seen=2), load(13, key="z", seen=None), load(14, key="g", gone=1),
    ]
    assert versions(spark, rows) == sorted([("k", at(m)) for m in (1, 3, 5, 7, 11)] + [("", at(1)), ("z", None)], key=repr)
    assert versions(spark, []) == []


def test_history_sliced_and_touched(spark):
    table = spark.read.parquet(f"{DATA}/item_loads.parquet")
    whole = history.rebuild(table)
    sliced = history.rebuild(table, hot_rows=15)
    columns = ["site", "natural_key", "moment", "begins", "load_id"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows(whole) == rows(sliced) and len(rows(whole)) > 300
    cols = ["site", "natural_key", "valid_from", "valid_to", "is_current"]
    a, b = (sorted(map(tuple, history.intervals(x, h).select(*cols).collect()), key=repr) for x, h in ((whole, 10**6), (sliced, 5)))
    assert a == b
    by = defaultdict(list)
    for s, k, start, end, current in a:
        by[s, k].append((start, end, current))
    for chain in by.values():
        chain.sort()
        assert all(x[1] is not None and x[1] <= y[0] for x, y in zip(chain, chain[1:])) and sum(c[2] for c in chain) <= 1


def test_slices_are_even_whatever_the_moments(spark):
    """One row of 1970, all others of one moment: ranges are of rows, not of time."""
    rows = spark.range(20_000).select(F.lit("s").alias("k"), F.when(F.col("id") == 0, F.lit("1970-01-01")).otherwise(F.lit("2026-05-01")).cast("timestamp_ntz").alias("moment"), "id")
    got = linked(rows, ["k"], "moment", ["id"], ["id"], hot_rows=1000).withColumn("task", F.spark_partition_id())
    plan = got._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan or "rangepartitioning" in plan
    assert got.filter("id > 0 AND _prev.id <> id - 1 OR id > 0 AND _prev IS NULL").count() == 0 and got.count() == 20_000
    ranged = rows.repartitionByRange(80, "k", "moment", "id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).collect()[0][0]
    assert ranged < 1000


def test_history_store_takes_late_rows(spark, tmp_path):
    table = spark.read.parquet(f"{DATA}/item_loads.parquet")
    cut = table.agg(F.expr("percentile_approx(load_id, 0.7)")).collect()[0][0]
    early, late = table.filter(F.col("load_id") <= cut), table.filter(F.col("load_id") > cut)
    store = history.HistoryStore(spark, str(tmp_path / "h"), buckets=4)
    assert store.read().count() == 0
    store.update(early)
    store.update(late)
    store.update(late.limit(0))
    cols = ["site", "natural_key", "valid_from", "valid_to", "is_current"]
    want = sorted(map(tuple, history.intervals(history.rebuild(table)).select(*cols).collect()), key=repr)
    assert sorted(map(tuple, store.read().select(*cols).collect()), key=repr) == want
    store.update(late)
    assert store.read().count() == len(want) and history.HistoryStore(spark, str(tmp_path / "h"), buckets=9).buckets == 4
    # only the buckets of touched records get new folders
    before = store.pointer.read()["versions"]
    one = late.limit(1)
    store.update(one)
    after = store.pointer.read()["versions"]
    assert sum(before[b] != after[b] for b in before) == 1 and store.read().count() == len(want)


def test_history_store_with_nulls_anywhere(spark, tmp_path):
    """Rows that lack a load_id, a key or a moment are told apart by all they have; in parts they give what they give at once."""
    rows = [load(None, "a", '{"v":1}', seen=1), load(None, "a", '{"v":2}', seen=2), load(None, None, "x", seen=1), load(None, None, "y", seen=3), load(5, "a", None, seen=None), load(5, "a", None, seen=None), load(5, "a", '{"v":9}', seen=4), load(6, "a", gone=5), load(None, "a", '{"v":1}', seen=1)]
    store = history.HistoryStore(spark, str(tmp_path / "h"), buckets=2)
    for part in (rows[:1], rows[1:3], rows[3:6], rows[6:]):
        store.update(loads(spark, part))
    columns = ["site", "natural_key", "valid_from", "valid_to", "is_current"]
    whole = history.intervals(history.rebuild(loads(spark, rows)))
    assert sorted(map(tuple, store.read().select(columns).collect()), key=repr) == sorted(map(tuple, whole.select(columns).collect()), key=repr)


def test_history_store_of_two_writers(spark, tmp_path):
    table = loads(spark, [load(1, "a", loaded=5, changed=1)])
    store = history.HistoryStore(spark, str(tmp_path / "h"), buckets=2)
    store.update(table)
    slow = history.HistoryStore(spark, str(tmp_path / "h"))
    swap = slow.pointer.swap
    slow.pointer.swap = lambda value, after: (store.update(loads(spark, [load(3, "c", loaded=5, changed=1)])), swap(value, after))
    with pytest.raises(Conflict):
        slow.update(loads(spark, [load(2, "b", loaded=5, changed=1)]))
    assert {r["natural_key"] for r in store.read().collect()} == {"a", "c"}


def brute_taken(load_rows, run_rows):
    ends = {}
    for i, site, _, end, status in run_rows:
        if status and status.strip().lower() in ("ok", "degraded") and end:
            ends[site, i] = min(end, ends.get((site, i), end))
    known = {}
    for r in load_rows:
        state = (r["site"], r["natural_key"], r["last_changed"] or r["fetched_at"])
        if r["loaded_at"]:
            known[state] = min(r["loaded_at"], known.get(state, r["loaded_at"]))
    out = set()
    for (site, key, _), when in known.items():
        later = sorted((e, i) for (s, i), e in ends.items() if s == site and e >= when)
        if later:
            out.add((later[0][1], site, key))
    return out


def test_increments_against_python(spark):
    table, runs = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("item_loads", "runs"))
    want = brute_taken([r.asDict() for r in table.collect()], [tuple(r) for r in runs.select("id", "site", "started_at", "finished_at", "status").collect()])
    for hot in (10**6, 2):
        got = [tuple(r) for r in increments.owners(increments.states(table), increments.commits(runs, hot_rows=hot)).filter('run_id IS NOT NULL').select('run_id', 'site', 'natural_key').distinct().collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_increments_awkward(spark):
    run = lambda i, end, status="ok", site="s": (i, site, at(0), at(end), status)
    rows = [run(1, 10), run(2, 20, " OK "), run(3, 20), run(4, 30, "error"), run(5, None), run(6, 40, "degraded"), run(6, 45), run(None, 50), run(7, 60, None)]
    runs = spark.createDataFrame(rows, RUNS)
    table = loads(spark, [load(1, "a", loaded=5, changed=1), load(2, "a", loaded=6, changed=1), load(3, "b", loaded=10, changed=1), load(4, "c", loaded=11, fetched=1), load(5, "d", loaded=25, changed=1), load(6, "e", loaded=46, changed=1), load(7, "f", loaded=None), load(8, None, loaded=5), load(9, "a", loaded=31, changed=2), load(10, "a", loaded=32, changed=3)])
    got = sorted(tuple(r)[::2] for r in increments.replay(table, runs).collect())
    assert got == [(1, "a"), (1, "b"), (2, "c"), (6, "a"), (6, "d")]
    none = increments.replay(table.limit(0), runs)
    assert none.count() == 0 and increments.replay(table, runs.limit(0)).count() == 0


def test_incremental_reader_neither_skips_nor_repeats(spark, tmp_path):
    table, runs = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("item_loads", "runs"))
    want = sorted(tuple(r) for r in increments.replay(table, runs).collect())
    reader = increments.IncrementalReader(spark, str(tmp_path / "r"))
    assert reader.process(runs) == 0 and reader.read().count() == 0
    middle = runs.agg(F.expr("percentile_approx(cast(finished_at as timestamp), 0.5)").cast("timestamp_ntz")).collect()[0][0]
    parts = []
    for i, rows in enumerate((table.filter(F.col("loaded_at") <= F.lit(middle)), table.filter(F.col("loaded_at") > F.lit(middle)))):
        parts.append(str(tmp_path / f"p{i}"))
        rows.write.parquet(parts[-1])
    assert reader.land(parts[0]) == 1 and reader.land(parts[0]) == 1
    assert reader.process(runs.filter(F.col("finished_at") <= F.lit(middle))) > 0
    assert reader.land(parts[1]) == 2
    swap = reader.pointer.swap
    reader.pointer.swap = lambda value, after: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        reader.process(runs)
    reader.pointer.swap = swap
    # what was read before isn't read again: not even there any more
    shutil.rmtree(parts[0])
    assert reader.process(runs) > 0 and reader.process(runs) == 0
    assert sorted(map(tuple, reader.read().select("run_id", "site", "natural_key").collect())) == want


def test_incremental_reader_takes_late_rows(spark, tmp_path):
    run = lambda i, end: (i, "s", at(0), at(end), "ok")
    reader = increments.IncrementalReader(spark, str(tmp_path / "r"))
    runs = spark.createDataFrame([run(1, 10), run(2, 20)], RUNS)

    def step(name, rows, runs):
        loads(spark, rows).write.parquet(str(tmp_path / name))
        reader.land(str(tmp_path / name))
        return reader.process(runs)

    assert step("a", [load(1, "a", loaded=5, changed=1), load(2, "w", loaded=25, changed=1)], runs) == 1
    # landed after the runs it belongs to; one of them is the same state again, one another state of a record that run has
    late = [load(3, "b", loaded=5, changed=1), load(4, "a", loaded=4, changed=1), load(5, "a", loaded=6, changed=2), load(6, "c", loaded=15, changed=1)]
    assert step("b", late, runs) == 2
    assert reader.process(runs) == 0
    assert reader.process(spark.createDataFrame([run(1, 10), run(2, 20), run(3, 30)], RUNS)) == 1
    assert sorted((r["run_id"], r["natural_key"]) for r in reader.read().collect()) == [(1, "a"), (1, "b"), (2, "c"), (3, "w")]
    # folders of a day are joined once there are many
    fragments, increments.FRAGMENTS = increments.FRAGMENTS, 2
    for i in range(2):
        assert step(f"n{i}", [load(100 + i, f"n{i}", loaded=5, changed=1)], runs) == 1
    increments.FRAGMENTS = fragments
    assert max(map(len, reader.pointer.read()["records"].values())) <= 2 and reader.read().count() == 6


def brute_nodes(body):
    try:
        value = json.loads(body.removeprefix("﻿"))
    except (ValueError, AttributeError):
        return []
    out = []

    def walk(v, key, path):
        if isinstance(v, dict):
            if key in nesting.LEVELS:
                name = v.get(nesting.LEVELS[key])
                path = [*path, "" if name is None else str(name)]
                out.append((key, " > ".join(path)))
            for k, x in v.items():
                for y in x if isinstance(x, list) else [x]:
                    walk(y, k, path)
        elif isinstance(v, list):
            for x in v:
                walk(x, None, path)

    walk(value, None, [])
    return out


BODIES = [
    None, "", "[]", '"item"', "{", '{"item": {"identificador": "a\\\\"}}', '{"item":[{"identificador":"x\\"{["},{"identificador":null},{}, 3, "item", [{"ref":1}]]}', '﻿{"anexo":{"ref":7,"anexo":{"ref":"é"}}}', '{"item":{"identificador":1},"item":{"identificador":2}}',
    '{"it\\u0065m": {"identificador": "\\u00e1"}}', '{"a":{"item":[]},"diario":{"x":{"numero":"no"},"numero":"3","seccion":[{"codigo":5,"item":{"identificador":""}}]}}', '{"item": {"identificador": "a"}} x', "{'item': 1}", " {\n\"item\" :\t{ \"identificador\" : \"s p\" } } ", '{"item": NaN}',
]


def test_nesting_against_python(spark):
    df = spark.createDataFrame(list(enumerate(BODIES)), "json_id bigint, body string").withColumn("node_id", F.lit(1))
    got = sorted((r["json_id"], r["node_level"], r["node_path"]) for r in nesting.flatten(df).collect())
    assert got == sorted((i, *n) for i, b in enumerate(BODIES[:-1]) if b for n in brute_nodes(b))
    docs = spark.read.parquet(f"{DATA}/json_docs.parquet")
    want = Counter((r["json_id"], *n) for r in docs.collect() if r["body"] for n in brute_nodes(r["body"]))
    rows = nesting.flatten(docs, with_json=True).collect()
    assert Counter((r["json_id"], r["node_level"], r["node_path"]) for r in rows) == want
    by_id = {r["node_id"]: r for r in rows}
    for r in rows:
        assert json.loads(r["node_json"]).get(nesting.LEVELS[r["node_level"]]) is not None or r["name"] == ""
        if r["parent_id"]:
            assert r["node_path"] == by_id[r["parent_id"]]["node_path"] + " > " + r["name"] and r["depth"] == by_id[r["parent_id"]]["depth"] + 1
        else:
            assert r["depth"] == 0
    assert nesting.flatten(docs.limit(0)).count() == 0


def is_json(text):
    def refuse(_):
        raise ValueError

    try:
        json.loads(text, parse_constant=refuse)
        return True
    except ValueError:
        return False


def test_json_grammar():
    """Against a parser: awkward texts, and changed ones in one batch, where no text may shift another."""
    deep = '{"item":' * 3000 + "{}" + "}" * 3000
    assert nesting.valid([deep.encode(), deep[:-1].encode(), deep.encode()]).tolist() == [True, False, True]
    assert len(nesting.nodes([deep])["body"]) == 3000
    texts = ['"x"', "[1,]", '{"a":1}', "[[1,[]],{}]", "[", '{"a" 1}', "1 2", "", " ", "nul", "01", "-", "1.e1", "1e+5", '"\\', '"\\"', '"a\nb"', '"\\u12g4"', '"\\u00e1"', "[}", '{"a":[}]', '{"a":{"b":1,}}', '{1:2}', '[:1]', '{"a"}', '{"a":}', "[1 2]", '["a" "b"]', "[,1]", "{,}", "][", "\ufeff1", '"\\x"', "tru e", "[1]]", "\x001", "é", '["é", "\t"]', '{"a":1}{"b":2}', "\\", '"a"b', "[1\n,2]"]
    docs = [json.dumps({"a": [1, -2.5e3, True, None, "x\\y\"z", {"b": []}], "ñ": {"c": "é\n"}}, ensure_ascii=k) for k in (True, False)]
    rng = random.Random(5)
    for _ in range(4000):
        t = list(rng.choice(docs))
        for _ in range(rng.choice((1, 1, 2, 3))):
            i = rng.randrange(len(t))
            t[i : i + rng.randrange(3)] = rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "1", " ", "e", "", "\n", "-", ".", "u", "t"])
        texts.append("".join(t))
    got = nesting.valid([t.encode() for t in texts]).tolist()
    want = [is_json(t) for t in texts]
    assert [t for t, g, w in zip(texts, got, want) if g != w] == [] and 200 < sum(want) < 3000


def test_levels_as_tables(spark):
    body = {"pedido": [{"ref": "A", "cliente": {"nombre": "Núñez", "tags": ["x", "y"]}, "linea": [{"n": 1, "precio": 2.50, "nota": None}, {"n": 2, "nota": "q\"\ud83d"}]}, {"linea": "ninguna"}]}
    df = spark.createDataFrame([(7, json.dumps(body)), (8, "x"), (9, None)], "json_id bigint, body string")
    found = nesting.flatten(df, levels={"pedido": "ref", "linea": None}, with_fields=True)
    orders = nesting.level_table(found, "pedido", ["ref", "cliente.nombre", "cliente.tags", "linea"]).orderBy("ordinal").collect()
    assert [tuple(r) for r in orders] == [(7, "7/0", None, 0, "A", "A", "Núñez", '["x", "y"]', None), (7, "7/3", None, 3, "", None, None, None, "ninguna")]
    lines = nesting.level_table(found, "linea", ["n", "precio", "nota"]).orderBy("ordinal").collect()
    assert [tuple(r)[2:] for r in lines] == [("7/0", 1, "", "1", "2.5", None), ("7/0", 2, "", "2", None, 'q"\ufffd')]
    assert {tuple(r) for r in nesting.members(found).collect()} == {("pedido", "ref", 1), ("pedido", "cliente.nombre", 1), ("pedido", "cliente.tags", 1), ("pedido", "linea", 1), ("linea", "n", 2), ("linea", "precio", 1), ("linea", "nota", 2)}
    plain = {tuple(r) for r in nesting.flatten(df, levels={"pedido": "ref", "linea": None}).select("node_json", "fields").collect()}
    assert plain == {(None, None)}


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p4_found", "p5_found", "p6_found"])
def test_found_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("item_loads", "runs", "run_reports", "site_fields", "json_docs"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = problems.QUERIES[name](spark, DATA)
    found = con.execute(problems.ORACLES[name])
    order = [[c[0] for c in found.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)


def drift_of(spark, by_run, runs=None):
    rows = [load(100 * run + i, f"k{i}", json.dumps(d) if isinstance(d, dict) else d, seen=run, run=run, loaded=run) for run, data in by_run.items() for i, d in enumerate(data)]
    table = loads(spark, rows)
    runs = spark.createDataFrame(runs or [(r, "s", at(r), at(r), "ok") for r in by_run], RUNS)
    prints = drift.fingerprints(table, runs)
    found = drift.steps(prints, table)
    return table, runs, prints, found


def test_drift_kinds_and_table(spark):
    n = range(20)
    by_run = {
        1: [{"a": i, "b": "x", "c": "v"} for i in n],
        2: [{"a2": i, "b": 5, "d": None} for i in n],
        3: [{"a3": i, "b": 5} for i in n[:9]] + [None, "no json"],  # too few rows to be a load
        4: [{"a3": i, "b": 5} for i in n],
        5: [{"a3": i, "b": None} for i in n],
    }
    table, runs, prints, found = drift_of(spark, by_run)
    got = sorted(tuple(r)[1:] for r in found.collect())
    assert got == [(2, "added", "d", ""), (2, "removed", "c", ""), (2, "renamed", "a", "a2"), (2, "retyped", "b", ""), (4, "removed", "d", ""), (4, "renamed", "a2", "a3")]
    rows = {(r["run_id"], r["load_id"]): r["fields"] for r in drift.conform(table, runs, prints, found).collect()}
    assert len(rows) == table.count()
    assert rows[1, 107] == {"a3": "7", "b": "x", "c": "v"} and rows[2, 207] == {"a3": "7", "b": "5", "d": None} and rows[3, 303] == {"a3": "3", "b": "5"}
    assert rows[3, 309] == {} and rows[3, 310] == {}
    assert drift_of(spark, {1: []})[3].count() == 0


def test_profile_awkward(spark):
    n = range(20)
    rows = {1: [{"code": "AB-1", "v": 10.0, "t": ""} for _ in n], 2: [{"code": "AB-1" if i % 5 else "zz", "v": 30.0 + (i > 9), "t": [] if i < 10 else "x"} for i in n], 3: [{"code": None, "v": 40.0, "t": "y"} for _ in n], 4: [{"v": 1e9} for _ in n]}
    table, runs, _, _ = drift_of(spark, rows)
    declared = spark.createDataFrame([("s", "code", "str", True, r"^[A-Z]{2}-\d$", None, None), ("s", "v", "int", False, None, 0.0, 100.0), ("s", "t", "str", False, "(", None, None), (None, "v", None, None, None, None, None)], "site string, field string, field_type string, required boolean, pattern string, min_value double, max_value double")
    for hot in (profile.HOT_ROWS, 5):
        counts = profile.mask_counts(table, declared, hot_rows=hot)
        seen = profile.field_profile(counts, table, runs, hot_rows=hot)
        got = sorted(tuple(r)[1:] for r in profile.findings(seen, table).collect())
        assert got == [(2, "code", "pattern"), (2, "v", "shift"), (3, "code", "null_rate"), (4, "v", "range"), (4, "v", "shift")]
    lanes = profile.by_load(table, hot_rows=5)
    assert lanes.count() == table.count() and lanes.columns == ["site", "load_run_id", "data"]
    masks = {(r["run_id"], r["field"], r["mask"]): (r["n"], r["divergence"]) for r in profile.mask_report(counts, table, runs).collect()}
    assert masks[1, "code", "AA-9"] == (20, None) and masks[2, "code", "aa"] == (4, 0.2) and masks[3, "code", "null"] == (20, 1.0)
    bad = spark.createDataFrame([(1, "s", at(0), None, "OK"), (1, "s", at(0), None, "ok"), (2, "s", at(0), None, None)], RUNS)
    reports = spark.createDataFrame([(1, "s", 5, 2, {"a": 4, "b": 3, "c": -1}), (2, "s", None, 2, {"a": 4, "b": -3}), (3, "s", 1, 0, None)], "run_id bigint, site string, items_seen int, items_skipped int, empty_fields map<string,bigint>")
    got = sorted(tuple(r)[1:] for r in profile.run_findings(bad, reports).collect())
    assert got == [(1, "a", "report"), (1, "c", "report"), (1, "status", "domain"), (2, "b", "report"), (2, "status", "domain")]


def test_medians_that_share_digits_are_settled_by_value(spark):
    base = [{"v": 1000001.0 + i} for i in range(21)]
    more = [{"v": 3.0 * (1000001.0 + i) + (0.5 if i == 10 else 0)} for i in range(21)]
    table, runs, _, _ = drift_of(spark, {1: base, 2: more})
    nothing = spark.createDataFrame([], "site string, field string, pattern string, min_value double, max_value double")
    seen = profile.field_profile(profile.mask_counts(table, nothing), table, runs)
    assert [tuple(r)[1:] for r in profile.findings(seen, table).collect()] == [(2, "v", "shift")]


def test_column_profile(spark):
    df = spark.createDataFrame([(1, "b", [1], {"k": 1}), (2, None, None, None), (2, "a", [1], None)], "n int, `a b` string, l array<int>, m map<string,int>")
    got = {r["column"]: tuple(r)[3:] for r in profile.column_profile(df, "t").collect()}
    assert got == {"n": (3, 0, 0.0, 2, "1", "2"), "a b": (3, 1, 1 / 3, 2, "a", "b"), "l": (3, 1, 1 / 3, got["l"][3], got["l"][4], got["l"][5]), "m": (3, 2, 2 / 3, 0, None, None)}
    assert [r["null_rate"] for r in profile.column_profile(df.limit(0), "t").collect()] == [None] * 4
    seen = problems.p6_profile(spark, DATA).collect()
    exact = spark.read.parquet(f"{DATA}/item_loads.parquet").collect()
    values = defaultdict(set)
    for r in exact:
        for k, v in json.loads(r["data"]).items():
            if isinstance(v, str):
                values[r["load_run_id"], k].add(v)
    for r in seen:
        if r["strings"] == r["rows"]:
            n = len(values[r["run_id"], r["field"]])
            assert abs(r["distinct"] - n) <= max(2, 0.15 * n)


def test_masks(spark):
    cases = {"": "", "ABC-1234-x": "AAA-9999-a", "Ñandú9": "Aaaaa9", "hola que tal": "text:4", "a b 9": "text:93", "x" * 30 + "-9": "+a-9"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r["t"]: r["m"] for r in df.select("t", profile.mask(F.col("t")).alias("m")).collect()}
    assert {k: got[k] for k in cases} == cases


def masks_of(spark, by_run):
    table, runs, _, _ = drift_of(spark, by_run)
    nothing = spark.createDataFrame([], "site string, field string, pattern string, min_value double, max_value double")
    return {(r["run_id"], r["field"], r["mask"]): r for r in profile.mask_report(profile.mask_counts(table, nothing), table, runs).collect()}


def test_rare_masks_in_loads_of_any_size(spark):
    code = lambda n, odd=(), base="AB-1": [{"code": base}] * (n - len(odd)) + [{"code": o} for o in odd]
    rare = lambda by_run: sorted(k[::2] for k, r in masks_of(spark, by_run).items() if r["rare"])
    assert rare({1: code(40, ["zz"])}) == [(1, "aa")]
    assert rare({1: code(200, ["zz"])}) == [(1, "aa")]
    # by all loads of the site: two odd values in a load of 20; a mask that each load has is not rare
    assert rare({1: code(20, ["zz", "yy", "xx"]), 2: code(400)}) == [(1, "aa")]
    assert rare({r: code(40, ["zz", "yy"]) for r in (1, 2)}) == []
    # a new format of a load's own is no rare mask, what is left of the old one in it is
    assert rare({1: code(2000), 2: code(20, base="7")}) == []
    assert rare({1: code(200), 2: code(300, ["AB-2"], base="7")}) == [(2, "AA-9")]
    # without a dominant mask nothing is rare
    assert rare({1: code(20, ["zz"] * 9 + ["7"])}) == []


def test_masks_of_spaced_texts(spark):
    cases = {
        "427 427 121": "999 999 999", "12 3456 789": "99 9999 999", "10 de agosto de 2019": "99 aa aaaaaa aa 9999", "2019 agosto 10 de de": "9999 aaaaaa 99 aa aa",
        "2024-05-01 10:30": "9999-99-99 99:99", "Ñandú  a\t9": "Aaaaa  a\t9", "Servicio de Caminos, n. 12 de 2019": "+Aa a Aa, a. 9 a 9", "": "", "ABC-1": "AAA-9",
        "ab " * 40: "+" + "a " * 40, "ab 9" + " ab" * 39: "text:97",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["m"] for r in df.select("t", profile.mask(F.col("t"), spaced=True).alias("m")).collect()} == cases


def test_masks_of_spaced_texts_tell_loads_apart(spark):
    table, runs, _, _ = drift_of(spark, {1: [{"tel": "427 427 121"}] * 40, 2: [{"tel": "42 7427 121"}] * 40})
    nothing = spark.createDataFrame([], "site string, field string, pattern string, min_value double, max_value double")
    got = {r["run_id"]: r for r in profile.mask_report(profile.mask_counts(table, nothing, spaced=True), table, runs).collect()}
    assert got[1]["mask"] == "999 999 999" and got[2]["mask"] == "99 9999 999" and got[2]["divergence"] == 1.0


def test_profile_of_lists_objects_and_booleans(spark):
    rows = [{"l": [i % 7, "x"], "b": i % 2 == 0, "o": {"p": i % 5, "q": 1} if i % 2 else {"q": 1, "p": i % 5}, "nul": None, "mix": [None, True, "true", ["true"]][i % 4]} for i in range(40)]
    table, runs, _, _ = drift_of(spark, {1: rows})
    nothing = spark.createDataFrame([], "site string, field string, pattern string, min_value double, max_value double")
    seen = profile.field_profile(profile.mask_counts(table, nothing, distinct=True), table, runs)
    got = {r["field"]: r["distinct"] for r in seen.collect()}
    assert got["nul"] == 0 and abs(got["l"] - 7) <= 1 and abs(got["o"] - 5) <= 1 and got["b"] == 2 and got["mix"] == 3  # counts are approximate


def test_masks_of_lists_objects_and_booleans(spark):
    rows = {1: [{"l": ["a"], "b": True, "o": {"p": 1}, "s": "array"}] * 40, 2: [{"l": ["a", "b"], "b": False, "o": {"p": 2.5, "q": None}, "s": "true"}] * 39 + [{"l": [1, 2.5] * 6, "b": None, "o": {"p": 3, "q": None}, "s": None}]}
    table, runs, _, _ = drift_of(spark, rows)
    nothing = spark.createDataFrame([], "site string, field string, pattern string, min_value double, max_value double")
    got = {(r["run_id"], r["field"], r["mask"]): r["divergence"] for r in profile.mask_report(profile.mask_counts(table, nothing, nested=True), table, runs).collect()}
    assert got == {
        (1, "l", "ARRAY<STRING>:1"): None, (1, "b", "true"): None, (1, "o", "OBJECT<p: NUMBER>"): None, (1, "s", "aaaaa"): None,
        (2, "l", "ARRAY<STRING>:2"): 1.0, (2, "l", "ARRAY<NUMBER>:2^3"): 1.0, (2, "b", "false"): 1.0, (2, "b", "null"): 1.0, (2, "o", "OBJECT<p: NUMBER, q: VOID>"): 1.0, (2, "s", "aaaa"): 1.0, (2, "s", "null"): 1.0,
    }


def test_drift_casts_and_defaults(spark):
    n = range(20)
    odd = [{"lugar": ["a", "b"], "n": "1.234,5", "l": 7, "ok": "yes", "o": "x"}, None, "no json"]
    by_run = {
        1: [{"lugar": ["a"], "n": "5", "l": "x", "ok": "true", "o": [{"p": 1}], "viejo": i, "solo": "s"} for i in n] + odd,
        2: [{"lugar": {"texto": "a"}, "n": {"v": 5}, "l": {"k": 1}, "ok": False, "o": {"p": 1}, "nuevo": i} for i in n],
        3: [{"lugar": "a", "n": 5, "l": ["x"], "ok": True, "o": {"p": 1}, "nuevo": i, "tarde": None} for i in n],
    }
    table, runs, prints, found = drift_of(spark, by_run)
    rules = drift.targets(prints, found)
    assert {r["field"]: r["type"] for r in rules.collect()} == {"lugar": "string", "n": "number", "l": "array", "ok": "boolean", "o": "object", "nuevo": "number", "solo": "string", "tarde": None}
    rows = {r["load_id"]: r for r in drift.conform(table, runs, prints, found, rules).collect()}
    assert len(rows) == table.count()
    none = dict.fromkeys(["lugar", "n", "l", "ok", "o", "nuevo", "solo", "tarde"])
    assert rows[103]["fields"] == {"lugar": "a", "n": "5", "l": '["x"]', "ok": "true", "o": '{"p":1}', "nuevo": "3", "solo": "s", "tarde": None} and rows[103]["failed"] == {}
    assert rows[203]["fields"] == none | {"lugar": "a", "n": "5", "l": '[{"k":1}]', "ok": "false", "o": '{"p":1}', "nuevo": "3"}
    assert rows[303]["fields"] == none | {"lugar": "a", "n": "5", "l": '["x"]', "ok": "true", "o": '{"p":1}', "nuevo": "3"}
    assert rows[120]["fields"] == none | {"l": "[7]"} and rows[120]["failed"] == {"lugar": '["a","b"]', "n": "1.234,5", "ok": "yes", "o": "x"}
    assert rows[121]["fields"] == none and rows[122]["fields"] == none and rows[122]["failed"] == {}
    given = rules.withColumn("default", F.when(F.col("field") == "solo", "?"))
    assert {r["load_id"]: r["fields"]["solo"] for r in drift.conform(table, runs, prints, found, given).collect()}.items() >= {103: "s", 203: "?"}.items()


def test_repeated_keys_have_their_last_value(spark):
    """In every problem: as fields, as states, in tables and nodes."""
    twice = '{"a":1,"b":2,"a":3,"item":{"identificador":"x"},"item":{"identificador":"y"}}'
    table = loads(spark, [load(1, data=twice, seen=1), load(2, data='{"b":2,"item":{"identificador":"y"},"a":3}', seen=2)])
    assert {(r["load_id"], r["field"], r["v"]) for r in fields(table.drop("field", "value", "kind"), "data", "load_id").withColumn("v", F.to_json("value")).collect() if r["field"] == "a"} == {(1, "a", "3"), (2, "a", "3")}
    assert versions(spark, [load(1, data=twice, seen=1), load(2, data='{"b":2,"item":{"identificador":"y"},"a":3}', seen=2)]) == [("k", at(1))]
    runs = spark.createDataFrame([(1, "s", at(0), at(9), "ok")], RUNS)
    prints = drift.fingerprints(table, runs)
    got = {r["load_id"]: r["fields"] for r in drift.conform(table, runs, prints, drift.steps(prints, table)).collect()}
    assert got[1] == got[2] == {"a": "3", "b": "2", "item": '{"identificador":"y"}'}
    assert [n["node_path"] for n in nesting.flatten(table.select(F.col("load_id").alias("json_id"), F.col("data").alias("body"))).collect()] == ["y", "y"]


def test_patterns_are_checked_where_they_run(spark):
    patterns = {"a{": None, "[a[b]": None, "(?P<a>x)(?P=a)": None, "(": None, "(?P<y>[0-9]{4})": "(?d)(?<y>[0-9]{4})", "^x\\Z": "(?d)^x\\z", "": "(?d)"}
    rows = [("s", f"f{i}", p, None, None) for i, p in enumerate(patterns)] + [("s", "none", None, None, None)]
    declared = spark.createDataFrame(rows, "site string, field string, pattern string, min_value double, max_value double")
    got = {r["field"]: r["pattern"] for r in profile.declared(declared).collect()}
    assert [got[f"f{i}"] for i in range(len(patterns))] == list(patterns.values()) and got["none"] is None
    data = [json.dumps({f"f{i}": v for i in range(len(patterns))}) for v in ("2026", "x", "x\n")]
    table = loads(spark, [load(i, f"k{i}", d, seen=1) for i, d in enumerate(data)]).drop("field", "value", "kind")
    few, profile.COMPILED = profile.COMPILED, 1  # the others are compiled with each row
    try:
        one = {(r["field"], r["mask"]): r["bad"] for r in profile.mask_counts(table, declared).collect()}
    finally:
        profile.COMPILED = few
    many = {(r["field"], r["mask"]): r["bad"] for r in profile.mask_counts(table, declared).collect()}
    assert one == many and one["f4", "9999"] == 0 and one["f4", "a"] == 1 and one["f0", "a"] == 0 and one["f5", "a"] == 0
    assert sum(n for (f, m), n in one.items() if f == "f5") == 2
