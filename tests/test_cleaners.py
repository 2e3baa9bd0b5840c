import datetime as dt

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import cleaners as C

NOW = dt.datetime(2025, 8, 31, 9, 20)
D, T = dt.date, dt.datetime

CASES = {
    "money": [
        ("7.081,35 €", 7081.35), ("612 EUR", 612.0), ("45,90", 45.9), ("7,081.35", 7081.35), ("Tasa: 4.300 €", 4300.0), ("3\u00a0081,07 €", 3081.07), ("gratis", None),
        ("6,5 m", 6.5), ("0.31", 0.31), ("2,7,9", None), ("-8", -8.0), ("56 78", 5678.0), ("4.5.6", 456.0), ("", None), (None, None), ("8,4321", 84321.0), ("3.000.000,5", 3000000.5),
    ],
    "int": [("3.470 plazas", 3470), ("45.6", 456), ("3,470", 3), ("-5 6", -56), ("ninguna", None), ("", None), (None, None), ("8" * 30, None)],
    "date": [
        ("07/11/2021", D(2021, 11, 7)), ("2021-11-07T06:30:00", D(2021, 11, 7)), ("7 de noviembre de 1964", D(1964, 11, 7)), ("pendiente", None), ("07.11.21", D(2021, 11, 7)), ("2021/11/07", D(2021, 11, 7)),
        ("3 de Octubre, 2022", D(2022, 10, 3)), ("7 nov. 2021", D(2021, 11, 7)), ("April 21, 1906", D(1906, 4, 21)), ("Jan 2nd, 2020", D(2020, 1, 2)), ("30/02/2023", None), ("09/14/2021", None),
        ("20211107", D(2021, 11, 7)), ("2021-W44-7", D(2021, 11, 7)), ("2021-11-07T23:30:00-05:00", D(2021, 11, 7)), ("2021-11-07T06:30:00Z", D(2021, 11, 7)), ("hace 4 días", D(2025, 8, 27)), ("hace dos meses", None), ("hace 6 meses", D(2025, 2, 28)),
        ("3 weeks ago", D(2025, 8, 10)), ("Actualizado ayer", D(2025, 8, 30)), ("1/1/69", D(2069, 1, 1)), ("1/1/70", D(1970, 1, 1)), ("", None), (None, None), ("2021", None), ("2021-1-9", D(2021, 1, 9)), ("7 de brumario de 1964", None),
    ],
    "datetime": [
        ("07/11/2021 18:45", T(2021, 11, 7, 18, 45)), ("2021-11-07T06:30:00", T(2021, 11, 7, 6, 30)), ("7 de noviembre de 2021", T(2021, 11, 7)), ("hace 5 horas", T(2025, 8, 31, 4, 20)), ("ayer 7:15", T(2025, 8, 30, 7, 15)),
        ("07/11/2021 77:45", T(2021, 11, 7)), ("2021-11-07 06:30:01.25", T(2021, 11, 7, 6, 30, 1, 250000)), ("nunca", None), (None, None), ("2021-11-07T23:30:00-05:00", T(2021, 11, 7, 23, 30)),
    ],
    "phone": [("Centralita 976 40 50 60", "+34976405060"), ("0034 711 222 333", "+34711222333"), ("943 70 80 90 o 711 22 23 33", "+34943708090"), ("(+34) 711-22-23-33", "+34711222333"), ("no consta", None), (None, None)],
    "email": [("Escriba a Buzon@Ayto-Ficticio.ES.", "buzon@ayto-ficticio.es."), ("cigüeña@y.es", "cigüeña@y.es"), ("nada", None)],
    "url": [("  /a b\n", "/a b"), ("  ", None), (None, None)],
    "str": [(" a  b\n", "a b"), ("", ""), (None, None)],
}


@pytest.mark.parametrize("kind", CASES)
def test_cleaner(spark, kind):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(CASES[kind])], "i int, v string")
    got = {r["i"]: r["x"] for r in df.select("i", C.CLEANERS[kind](F.col("v"), C.moment(NOW)).alias("x")).collect()}
    for i, (v, want) in enumerate(CASES[kind]):
        assert got[i] == want, (kind, v)


def test_relative(spark):
    cases = [("hoy", T(2025, 8, 31), False), ("anteayer", T(2025, 8, 29), False), ("hace 9 días", T(2025, 8, 22, 9, 20), False), ("hace 5 horas", T(2025, 8, 31, 4, 20), True), ("12 minutes ago", T(2025, 8, 31, 9, 8), True)]
    df = spark.createDataFrame([(c[0],) for c in cases] + [("Ayerbe y Hoya",), (None,)], "v string")
    got = {r["v"]: r["x"] for r in df.select("v", C.relative_datetime(F.col("v"), C.moment(NOW)).alias("x")).collect()}
    for v, when, precise in cases:
        assert (got[v]["moment"], got[v]["precise"]) == (when, precise)
    assert got["Ayerbe y Hoya"] is None and got[None] is None


def test_list_and_own_type(spark):
    C.register_cleaner("shout", lambda v, now: F.upper(v), "string")
    df = spark.createDataFrame([(["a  b", " c"],), ([],), (None,)], "v array<string>")
    rows = df.select(C.clean(F.col("v"), "list", C.moment(NOW)).alias("l"), C.clean(F.col("v"), "shout", C.moment(NOW)).alias("s"), C.is_empty(F.col("v"), "list").alias("e")).collect()
    assert [tuple(r) for r in rows] == [(["a b", "c"], "A  B", False), ([], None, True), (None, None, True)]
