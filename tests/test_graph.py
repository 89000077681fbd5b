"""Hierarchies, components and total orders against brute force."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from weftline.operators.components import connected_components
from weftline.operators.hierarchy import descendant_counts, descendants, hierarchy
from weftline.operators.ranking import global_sequence

SCHEMA = "t string, id string, parent string"


def walk(rows):
    parents = {}
    for t, i, p in rows:
        if i is not None:
            old = parents.get((t, i))
            parents[(t, i)] = p if old is None else (old if p is None else min(old, p))
    out = {}
    for (t, i), p in parents.items():
        path, seen, cur = [], set(), i
        while True:
            if cur in seen:
                out[(t, i)] = (None, None, None, "cycle")
                break
            seen.add(cur)
            path.append(cur)
            up = parents[(t, cur)]
            if up is None or (t, up) not in parents:
                state = "child" if len(path) > 1 else ("root" if up is None else "orphan_root")
                out[(t, i)] = (cur, len(path) - 1, path[::-1], state)
                break
            cur = up
    return out


def check(spark, rows):
    tree = hierarchy(spark.createDataFrame(rows, SCHEMA), "id", "parent", ["t"])
    got = {(r["t"], r["id"]): (r["root"], r["depth"], r["path"], r["state"]) for r in tree.collect()}
    assert got == walk(rows)
    return tree


def test_mixed_forest(spark):
    rows = [("a", "1", None), ("a", "2", "1"), ("a", "3", "2"), ("a", "3", "2"), ("a", "4", "zz"), ("a", "5", "4"), ("b", "2", None), ("b", "1", "2")]
    rows += [("a", "x", "y"), ("a", "y", "x"), ("a", "z", "y"), ("a", "s", "s"), ("a", None, "1"), (None, "1", None), (None, "2", "1"), ("a", "w", None), ("a", "w", "3")]
    tree = check(spark, rows)
    pairs = {(r["t"], r["ancestor"], r["descendant"], r["distance"]) for r in descendants(tree, "id", ["t"]).collect()}
    assert ("a", "1", "w", 3) in pairs and ("a", "4", "5", 1) in pairs and not any("x" in p for p in pairs)
    n = {(r["t"], r["id"]): r["n_descendants"] for r in descendant_counts(tree, "id", ["t"]).collect()}
    assert n[("a", "1")] == 3 and n[("a", "w")] == 0 and n[("a", "x")] is None


def test_deep_chain_star_and_cycle(spark):
    rows = [("c", str(i), str(i - 1) if i else None) for i in range(300)]
    rows += [("s", f"k{i}", "hub") for i in range(200)] + [("s", "hub", None)]
    rows += [("o", str(i), str((i + 1) % 37)) for i in range(37)] + [("o", "tail", "0")]
    check(spark, rows)


def test_empty_and_clashing_names(spark):
    assert hierarchy(spark.createDataFrame([], SCHEMA), "id", "parent", ["t"]).count() == 0
    df = spark.createDataFrame([("a", "1", None, "x"), ("a", "2", "1", "x")], "path string, id string, depth string, extra string")
    r = {x["id"]: x for x in hierarchy(df, "id", "depth", ["path"]).collect()}
    assert r["2"]["path"] == "a" and r["2"]["path_"] == ["1", "2"]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("12345678"), st.sampled_from(["1", "2", "3", "4", "5", "6", "7", "9", None])), max_size=20))
def test_random_forests(spark, rows):
    check(spark, rows)


def test_components(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(220)] + [("hub", f"leaf{i}") for i in range(300)] + [("q", "q"), (None, "n1")]
    edges += [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_global_sequence(spark, parts):
    rows = [(i * 7919 % 500, f"k{i}") for i in range(500)] + [(None, "none")]
    df = spark.createDataFrame(rows, "a int, k string").repartition(parts)
    got = [r["k"] for r in global_sequence(df, ["a", "k"]).orderBy("seq").collect()]
    assert got == [k for _, k in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
    assert [r["seq"] for r in global_sequence(df, ["a", "k"]).orderBy("seq").select("seq").collect()] == list(range(501))
    assert global_sequence(spark.createDataFrame([], "a int"), ["a"]).count() == 0
