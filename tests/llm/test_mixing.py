from pyspark.sql import functions as F

from sedimenta.llm import mixing
from tests.conftest import DATA

DOCS = "doc_id bigint, source string, text string"
TARGETS = "source string, target_share double, max_repeats int"


def test_shares_are_met_and_repeats_capped(spark):
    rows = [(i, "big", f"palabra número {i} de un texto algo más largo") for i in range(4000)] + [(10000 + i, "small", f"palabra número {i} de un texto algo más largo") for i in range(800)]
    docs = spark.createDataFrame([*rows, (1, "other", "x"), (2, None, "x"), (90003, "big", None), (90004, "big", "")], DOCS).withColumn("tokens", F.lit(1))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("nowhere", 0.2, 5)], TARGETS)
    mixed = mixing.mix(docs, targets)
    used = {(r["source"], r["doc_id"]): r["copies"] for r in mixed.collect()}
    assert max(c for (s, _), c in used.items() if s == "big") == 1 and max(c for (s, _), c in used.items() if s == "small") == 3
    assert {s for s, _ in used} == {"big", "small"} and ("big", 90003) not in used and ("big", 90004) not in used
    shares = {r["source"]: r for r in mixing.shares(mixed, targets).collect()}
    # of the two sources that exist: 5 to 3; the small one is used up
    assert abs(shares["big"]["actual_share"] - 0.625) < 0.02 and shares["nowhere"]["actual_share"] == 0 and shares["small"]["documents"] == 800
    assert {(r["source"], r["doc_id"]): r["copies"] for r in mixing.mix(docs.repartition(7), targets).collect()} == used
    other = {(r["source"], r["doc_id"]) for r in mixing.mix(docs, targets, seed=3).collect()}
    assert other != set(used)
    assert mixing.expand(mixed).count() == sum(used.values())


def test_awkward_targets(spark):
    docs = spark.createDataFrame([(1, "a", "uno dos"), (1, "a", "uno dos"), (2, "b", "tres")], DOCS)
    targets = spark.createDataFrame([("a", 0.5, None), ("a", 0.1, 2), ("b", None, 1), ("c", -1.0, 1), (None, 0.4, 1)], TARGETS)
    assert sorted(tuple(r) for r in mixing.mix(docs, targets).select("source", "doc_id", "copies").collect()) == [("a", 1, 1), ("a", 1, 1)]
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0
    empty = mixing.shares(mixing.mix(docs.limit(0), targets), targets).collect()
    assert all(r["actual_share"] is None for r in empty)


def test_whole_tables(spark):
    docs, targets = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "mix_targets"))
    mixed = mixing.mix(docs, targets)
    caps = {r["source"]: r["max_repeats"] for r in targets.collect()}
    assert all(r["copies"] <= caps[r["source"]] for r in mixed.collect())
    assert abs(sum(r["actual_share"] for r in mixing.shares(mixed, targets).collect()) - 1) < 1e-9


def test_size_of_ones_own(spark):
    docs = spark.createDataFrame([(i, "big", "uno dos tres cuatro cinco") for i in range(3000)] + [(9000 + i, "tiny", "uno dos tres cuatro cinco") for i in range(20)], DOCS)
    targets = spark.createDataFrame([("big", 0.5, 4), ("tiny", 0.5, 2)], TARGETS)
    size = 2 * sum(r["tokens"] for r in mixing.mix(docs, targets.filter("source = 'big'").withColumn("max_repeats", F.lit(1))).collect())
    got = {r["source"]: r for r in mixing.shares(mixing.mix(docs, targets, total_tokens=size), targets).collect()}
    # the scarce source gives all it may, twice each; the other its half of the size
    assert got["tiny"]["documents"] == 20 and got["tiny"]["most_copies"] == 2 and abs(got["big"]["mixed_tokens"] / (size / 2) - 1) < 0.02
    assert got["tiny"]["actual_share"] < 0.05
    small = mixing.shares(mixing.mix(docs, targets), targets).collect()
    assert abs(small[0]["actual_share"] - 0.5) < 0.1
