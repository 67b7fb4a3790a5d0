import math

import numpy as np
import pytest

from rowsmith.llm import vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, node bigint, id bigint, unit string"


def brute(rows, threshold):
    """Links and smallest id reachable, in double precision."""
    unit = []
    for i, v in rows:
        ok = i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        v = np.array(v, float) if ok else None
        unit.append(v / np.linalg.norm(v) if ok else None)
    n = len(rows)
    linked = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    root = list(range(n))
    for i in range(n):
        for j in linked[i]:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted((str(i), len(k), str(least.get(r))) for (i, _), k, r in zip(rows, linked, root))


def table(seed, width=16):
    r = np.random.default_rng(seed)
    rows, at = [], 0
    for size, spread in ((60, 0.02), (12, 0.02), (2, 0.01), (40, 0.09)):
        centre = r.normal(size=width)
        for _ in range(size):
            v = centre / np.linalg.norm(centre) + r.normal(size=width) * spread
            rows.append((at, np.float32(v * r.uniform(0.1, 9)).tolist()))
            at += 1
    for _ in range(300):
        rows.append((at, np.float32(r.normal(size=width)).tolist()))
        at += 1
    same = rows[5][1]
    odd = [(1000, None), (1001, []), (1002, [0.0] * width), (1003, [float("nan")] + [1.0] * (width - 1)), (1004, [None] + [1.0] * (width - 1)), (1005, [float("inf")] * width),
           (None, same), (1006, same), (1006, same), (1007, same[:8]), (1008, same[:8]), (3, rows[200][1]), (1009, [1e-30] + [0.0] * (width - 1)), (1010, [3e30] + [0.0] * (width - 1))]
    return rows + odd


@pytest.mark.parametrize("chunk", [7, vectors.CHUNK])
def test_links_and_components_are_those_of_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(vectors._counted, "__defaults__", (chunk,))
    rows = table(chunk)
    df = spark.createDataFrame([(i, v, 0, 1, 2, "u") for i, v in rows], SCHEMA).repartition(3)
    found = vectors.near_duplicates(df, threshold=0.95).collect()
    assert sorted((str(x["id"]), x["n_links"], str(x["component"])) for x in found) == brute(rows, 0.95)


def test_nothing_usable_and_nothing_at_all(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    found = vectors.near_duplicates(spark.createDataFrame([(1, None, 0, 0, 0, ""), (2, [0.0], 0, 0, 0, "")], SCHEMA)).collect()
    assert sorted((x["id"], x["n_links"], x["component"]) for x in found) == [(1, 0, 1), (2, 0, 2)]
    one = vectors.near_duplicates(spark.createDataFrame([(1, [1.0, 2.0], 0, 0, 0, "")], SCHEMA)).collect()
    assert [(x["id"], x["n_links"], x["component"]) for x in one] == [(1, 0, 1)]
    with pytest.raises(ValueError):
        vectors.near_duplicates(spark.createDataFrame([], SCHEMA), threshold=0)


def test_recall_counts_links_that_were_missed(spark):
    rows = [(i, [1.0, 0.0], 1) for i in range(4)]
    nodes = spark.createDataFrame(rows, "node bigint, unit array<double>, copies bigint")
    rooted = nodes.where("node < 2").selectExpr("node", "unit", "copies", "0L as root")
    assert vectors.recall(nodes, rooted, 2, 0.95) == pytest.approx(2 / 12)


def bridged(sizes, width=32, cosine=0.962):
    """Groups around directions of one cosine with each other, each far closer within."""
    r = np.random.default_rng(4)
    q = np.linalg.qr(r.normal(size=(width, len(sizes) + 1)))[0].T
    rows = []
    for k, size in enumerate(sizes):
        centre = q[0] * math.sqrt(cosine) + q[1 + k] * math.sqrt(1 - cosine)
        for _ in range(size):
            rows.append((len(rows), np.float32(centre + r.normal(size=width) * 0.001).tolist()))
    return rows + [(len(rows) + i, np.float32(r.normal(size=width)).tolist()) for i in range(200)]


def linked_as_brute(spark, rows):
    df = spark.createDataFrame([(i, v, 0, 1, 2, "u") for i, v in rows], SCHEMA).repartition(3)
    found = vectors.near_duplicates(df, threshold=0.95).collect()
    return sorted((str(x["id"]), x["n_links"], str(x["component"])) for x in found) == brute(rows, 0.95)


@pytest.mark.parametrize("sizes", [(60, 60), (25, 40, 30)])
def test_groups_longer_than_lists_are_joined(spark, monkeypatch, sizes):
    monkeypatch.setattr(vectors, "_joined_exactly", None, raising=False)
    assert linked_as_brute(spark, bridged(sizes))


def test_what_the_last_audit_misses_is_found_by_comparing_all(spark, monkeypatch):
    monkeypatch.setattr(vectors, "AUDITS", 1)
    monkeypatch.setattr(vectors, "ASKED", 32 * 50)
    monkeypatch.setattr(vectors, "_joined_across", lambda lists, nodes, roots, *_: roots)
    assert linked_as_brute(spark, bridged((60, 60)))


def alone(seed, n, width=32):
    return [v.tolist() for v in np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))[0][:n]]


def test_a_large_group_does_not_hide_missed_pairs(spark):
    base = alone(1, 31)
    units = [base[30]] * 300 + [v for v in base[:30] for _ in range(2)]
    nodes = spark.createDataFrame(list(enumerate(units)), "node bigint, unit array<double>")
    rooted = nodes.where("node < 300").selectExpr("node", "unit", "0L as root")
    assert vectors.recall(nodes, rooted, 32, 0.95, 1000) == pytest.approx(300 / 360)
    seen = vectors._audited(vectors._placed(nodes, rooted.select("node", "root")), 32, 0.95, 1000, 5)
    assert seen.by_component == pytest.approx(1 / 61) and not seen.enough
    assert seen.missed.count() == 60


def test_a_sample_without_links_is_no_measure(spark):
    base = alone(2, 32)
    units = [v for v in base[1:]] + [base[0]] * 2
    nodes = spark.createDataFrame(list(enumerate(units)), "node bigint, unit array<double>")
    rooted = nodes.where("false").selectExpr("node", "unit", "0L as root")
    assert vectors.recall(nodes, rooted, 32, 0.95, 1) == 0
    seen = vectors._audited(vectors._placed(nodes, rooted.select("node", "root")), 32, 0.95, 1, 5)
    assert seen.whole and seen.components == 2
