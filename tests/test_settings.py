"""Nested settings as rows of flat names, and back."""

from linkloom.functions.config import flatten_rows, unflatten_rows

SCHEMA = "k long, a struct<b: int, c: struct<d: double, `e/f`: string>>, m map<string, int>, t string"


def test_nested_settings_round_trip(spark):
    rows = [(1, (3, (0.5, "x/y")), {"p": 1, "q/r": 2}, "z"), (2, (None, (None, None)), {}, None), (3, (4, (1e-7, "")), None, "t")]
    df = spark.createDataFrame(rows, SCHEMA)
    flat = {(r.k, r.name): r.value for r in flatten_rows(df, "k").collect()}
    assert flat[1, "a/c/d"] == "0.5" and flat[1, "m/q/r"] == "2" and flat[2, "a/b"] == "None" and (2, "m/p") not in flat
    back = {r.k: r for r in unflatten_rows(flatten_rows(df, "k"), "k", df.drop("k").schema).collect()}
    for k, a, m, t in rows:
        assert (tuple(back[k].a)[0], tuple(back[k].a.c), back[k].m, back[k].t) == (a[0], a[1], m or {}, t)
