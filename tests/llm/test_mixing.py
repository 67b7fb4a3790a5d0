import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowsmith.llm import mixing
from rowsmith.llm.queries import op12_mixed_sources
from tests.llm.common import DOCS, ODD_TEXTS, docs_table, words


def poured(sizes, weights, share, most):
    """Targets of sources (in order): what is above a source's most goes to the others, again and again."""
    target, full = [0.0] * len(sizes), set()
    while True:
        rest = share * sum(sizes) - sum(most * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        for i in open_:
            target[i] = rest * weights[i % len(weights)] / sum(weights[j % len(weights)] for j in open_)
        above = [i for i in open_ if target[i] > most * sizes[i]]
        if not above:
            return target
        for i in above:
            target[i] = most * sizes[i]
            full.add(i)


def rows_of(seed, n):
    random.seed(seed)
    names = ["big"] * 8 + ["B", "a", "é", "", "tiny", None]
    rows = [(random.choice([None, i, i // 3]), " ".join("w" * random.randint(1, 4) for _ in range(random.choice([0, 1, 5, 40, 300]))), random.choice(names)) for i in range(n)]
    return rows + rows[:n // 5] + [(i, t, "odd") for i, t in ODD_TEXTS]


def table(spark, rows, path):
    spark.createDataFrame([(i, t, "en", s, None, "x", 7, "y", 0.5, "z") for i, t, s in rows], DOCS).repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")


@pytest.mark.parametrize("n", [1, 30, 700])
def test_query(spark, tmp_path, n):
    rows = rows_of(n, n)
    table(spark, rows, tmp_path)
    got = op12_mixed_sources(spark, str(tmp_path)).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, poured([size[s] for s in order], [3, 1, 2], 1.5, 2)))
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == Counter((i, len(words(t)), size[s], round(target[s], 6)) for i, t, s in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    sums, wanted = Counter(), Counter()
    for r in got:
        sums[r["source_size"], round(r["target"], 6)] += r["taken"]
    for s in order:
        wanted[size[s], round(target[s], 6)] += int(np.floor(target[s] + 0.5))
    assert +sums == +wanted
    spark.read.parquet(f"{tmp_path}/documents.parquet").repartition(7).write.parquet(f"{tmp_path}/again/documents.parquet")
    again = op12_mixed_sources(spark, f"{tmp_path}/again").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)), "the mix does not depend on how rows lie"


def test_blocks_of_the_mix(spark):
    """Every place of a shard is one block; a source's blocks are all taken before one is taken again."""
    df = docs_table(spark, [(i, "w " * (i % 50), ) for i in range(400)]).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3))
    mix = mixing.mixed(df, "text", "source", "doc_id", [1, 5, 2], 1.2, 3, block_words=16, shard_blocks=32, seed=7)
    size = {r["number"]: r["source_size"] for r in mix.documents.collect()}
    target = {r["number"]: r["target"] for r in mix.documents.collect()}
    spans = mix.spans.collect()
    blocks = Counter()
    for s in spans:
        blocks[s["shard"], s["turn"], s["number"], s["block"]] += s["n_words"]
    full = sum(n == 16 for n in blocks.values())
    assert max(blocks.values()) == 16 and full >= len(blocks) - 3 * 3 and len({b[0] for b in blocks}) == -(-len(blocks) // 32)
    for number in size:
        times = Counter(b[3] for b in blocks if b[2] == number)
        assert max(times.values()) - min(times.get(i, 0) for i in range(-(-size[number] // 16))) <= 1
        assert sum(n for b, n in blocks.items() if b[2] == number) == int(np.floor(target[number] + 0.5))


def test_all_sources_at_their_most(spark):
    mix = mixing.mixed(docs_table(spark, [(1, "a b c"), (2, "d")]), "text", "source", "doc_id", [1], 9, 2, block_words=2)
    assert {r["id"]: r["taken"] for r in mixing.taken(mix).collect()} == {1: 6, 2: 2}


def test_more_sources_than_a_broadcast_holds(spark, monkeypatch):
    monkeypatch.setattr(mixing.F, "broadcast", lambda df: pytest.fail("too many"))
    placed = spark.createDataFrame([(1, "=a", 5, 0), (2, "=a", 3_000_000, 5), (3, "~", 0, 0)], "id bigint, part_of string, size bigint, before bigint")
    sources = spark.range(100_001).select(F.concat(F.lit("="), "id").alias("part_of"), F.col("id").alias("number"), F.lit(0).cast("bigint").alias("size"), F.lit(0.0).alias("target"))
    mine = spark.createDataFrame([("=a", -1, 3_000_005, 1.0), ("~", -2, 0, 0.0)], sources.schema)
    got = mixing._with_sources(placed, sources.unionByName(mine)).collect()
    assert sorted((r["id"], r["source"], r["number"], r["source_size"]) for r in got) == [(1, "a", -1, 3_000_005), (2, "a", -1, 3_000_005), (3, None, -2, 0)]


def test_empty_table(spark, tmp_path):
    docs_table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert op12_mixed_sources(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permutations(n):
    at = np.arange(n)
    seen = mixing._permuted(at, n, 99)
    assert sorted(seen) == list(at) and (mixing._permuted(seen, n, 99, back=True) == at).all()
    assert n < 17 or (seen != mixing._permuted(at, n, 100)).any()


@pytest.mark.parametrize("size, wanted, length", [(1, 1, 4), (10, 15, 4), (1000, 1999, 7), (64, 128, 8), (65, 64, 8), (5, 0, 8), (9, 18, 9)])
def test_words_of_the_places_add_up(size, wanted, length):
    plan = mixing.Plan(3, size, wanted, length, 42)
    block, taken = plan.block_at(np.arange(plan.places))
    assert taken.sum() == wanted and (taken > 0).all() and (taken <= np.minimum(length, size - block * length)).all()


def test_draws_are_multinomial_and_found_in_parts():
    whole = list(mixing._draws(1, 2, 10_000, 13, 0, 13))
    parts = [d for a, b in ((0, 1), (1, 6), (6, 13)) for d in mixing._draws(1, 2, 10_000, 13, a, b)]
    assert whole == parts and [s for s, _, _ in whole] == list(range(13))
    assert [b for _, b, _ in whole] == list(np.cumsum([0] + [n for _, _, n in whole])[:-1]) and sum(n for _, _, n in whole) == 10_000
    share = np.array([[n for _, _, n in mixing._draws(s, 0, 1300, 13, 0, 13)] for s in range(300)])
    assert abs(share.mean(0) - 100).max() < 3 and abs(share.var(0) - 100 * 12 / 13).max() < 30


@pytest.mark.parametrize("wrong", [{"most": 1.5}, {"weights": [0]}, {"block_words": 0}, {"share": -1}])
def test_wrong_settings(spark, wrong):
    settings = {"weights": [1], "share": 1, "most": 1} | wrong
    with pytest.raises(ValueError):
        mixing.mixed(docs_table(spark, [(1, "a")]), "text", "source", "doc_id", **settings)
