"""Names, groups and percentiles against brute force, and their results in odd cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sarraf.llm import components, names, quantiles


def brute_groups(ties):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for n, t in ties:
        if n is not None and t is not None:
            parent[find(("t", t))] = find(("n", n))
    groups = {}
    for n, t in ties:
        if n is not None and t is not None:
            groups.setdefault(find(("n", n)), set()).add(n)
    return {(n, min(g)) for g in groups.values() if len(g) > 1 for n in g}


def test_groups_equal_union_find(spark):
    rng = random.Random(1)
    ties = [(f"e{rng.randrange(300):03d}", f"t{rng.randrange(260)}") for _ in range(420)]
    ties += [(f"e{i:03d}", "hot") for i in range(100, 200)] + [(None, "hot"), ("e299", None)]
    ties += [(f"c{a:03d}", f"chain{min(a, b)}") for a in range(60) for b in (a - 1, a + 1)]
    frame = spark.createDataFrame(ties + ties[:30], "e string, v string").withColumn("tie", F.lit("clash"))
    got = components.connected_groups(frame, "e", "v")
    assert {tuple(r) for r in got.collect()} == brute_groups(ties)


def test_groups_of_nothing(spark):
    frame = spark.createDataFrame([("a", "1"), ("b", "2"), (None, None)], "e string, v string")
    assert components.connected_groups(frame, "e", "v").count() == 0
    assert components.connected_groups(frame.limit(0), "e", "v").count() == 0


@pytest.mark.parametrize("sent", [0, 200_000])
def test_percentiles_equal_numpy(spark, sent):
    rng = np.random.default_rng(4)
    data = [("big", float(x)) for x in rng.normal(size=900)] + [("ties", float(x)) for x in rng.integers(0, 4, 200)] + [("one", 3.5), *[("far", x) for x in (float("-inf"), 1.0, float("inf"), float("inf"))], (None, 1.0), (None, 2.0), ("big", None), ("big", float("nan")), ("none", None)]
    frame = spark.createDataFrame(data, "g string, v double").withColumn("n", F.lit("clash"))
    counts = quantiles.value_counts(frame, ["g"], "v")
    got = {(r["g"], r["fraction"]): (r["n"], r["percentile"]) for r in quantiles.percentiles(counts, ["g"], [0.0, 0.5, 0.9, 1.0], sent).collect()}
    want = {}
    for g in {d[0] for d in data}:
        values = [v for k, v in data if k == g and v is not None and v == v]
        for f in (0.0, 0.5, 0.9, 1.0):
            if values:
                want[g, f] = (len(values), float(np.quantile(values, f)) if g != "far" else None)
    assert got.keys() == want.keys()
    for k, (n, v) in want.items():
        assert got[k][0] == n and (v is None or got[k][1] == pytest.approx(v, abs=1e-9))


def test_counts_of_splits_merge(spark):
    data = [("a" if i % 3 else "b", float(i % 17)) for i in range(300)]
    whole = quantiles.value_counts(spark.createDataFrame(data, "g string, v double"), ["g"], "v")
    halves = [quantiles.value_counts(spark.createDataFrame(part, "g string, v double"), ["g"], "v") for part in (data[:90], data[90:])]
    merged = quantiles.merge_counts(*halves)
    assert {tuple(r) for r in merged.select("g", "value", "n").collect()} == {tuple(r) for r in whole.select("g", "value", "n").collect()}
    assert quantiles.percentiles(whole.limit(0), ["g"], [0.5]).count() == 0


def test_radius_join_is_exact(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randrange(4, 10))) for _ in range(40)]
    tokens = sorted(set(base + [b[:i] + rng.choice("abcde") + b[i + 1 :] for b in base for i in (1, 3)]))
    data = [(f"k{rng.randrange(3)}", t) for t in tokens] + [("k0", t) for t in tokens[:40]]
    got = names.radius_join(spark.createDataFrame(data, "key string, token string"), radius=2, pivots=6)
    want = set()
    for k, a in set(data):
        for m, b in set(data):
            if k == m and a <= b and names.edit_distance(a, b) <= min(2, max(len(a), len(b)) // 3):
                want.add((k, a, b))
    assert {tuple(r) for r in got.collect()} == want


def test_edit_distance_is_a_metric():
    rng = random.Random(8)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 6))) for _ in range(25)]
    for a in words:
        for b in words:
            d = names.edit_distance(a, b)
            assert (d == 0) == (a == b) and d == names.edit_distance(b, a)
            assert all(d <= names.edit_distance(a, c) + names.edit_distance(c, b) for c in words)


def people(spark, rows):
    return spark.createDataFrame(rows, "id string, name_en string, name_ar string, keys array<string>")


def test_names_of_one_person(spark):
    rows = [
        ("1", "Riwaf Yuanad Muthaq Al Qarijaoudi", None, ["d:1990-01-01"]),
        ("2", "Dr. Riwaph Yuanad Muthaq AL QARIJAOUDI", None, ["d:1990-01-01"]),
        ("3", "AL QARIJAOUDI, Riwaf Y. Muthaq", None, ["d:1990-01-01"]),
        ("4", "Riwaf Yuanad Muthaq Al Qarijaoudi", None, ["d:1991-01-01"]),  # another birth date
        ("5", "Kasib Yuanad Muthaq Al Qarijaoudi", None, ["d:1990-01-01"]),  # a twin
        ("6", None, None, ["d:1990-01-01"]),
        ("7", "", " ", []),
        ("8", "Riwaf Yuanad Muthaq Al Qarijaoudi", None, None),
        ("9", "Riwaf Yuanad Muthaq Al Qarijaoudi " * 400, None, ["d:2000-01-01"]),
    ]
    links = names.link_names(people(spark, rows + rows[:2]), {})
    ties = links.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.concat_ws(" ", "a", "b").alias("t")), F.struct(F.col("b").alias("id"), F.concat_ws(" ", "a", "b").alias("t")))))
    got = {tuple(r) for r in components.connected_groups(ties, "id", "t").collect()}
    assert got == {("1", "1"), ("2", "1"), ("3", "1")}
    assert names.link_names(people(spark, rows).limit(0), {}).count() == 0


def test_aliases_and_scripts():
    aliases = {"tatu": frozenset({"tafaf"})}
    assert names.compare_names(["tatu", "naruwad"], ["tafaf", "naruwad"], aliases)[0] == 2
    assert names.compare_names(["tatu", "naruwad"], ["tafaf", "naruwad"], {})[0] == 0
    assert names.name_parts("الغوجااري، قاسيكاد يوحال")[0] == "قاسيكاد"
    assert names.name_parts("Eng.  SALIM bin Khalid Al-Harbi") == ["salam", "kalad", "harba"]
    assert names.name_parts(None) == [] and names.name_parts(" . ") == []
