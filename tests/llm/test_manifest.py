import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rowsmith.llm import manifest
from rowsmith.llm.queries import op11_merkle_manifest
from tests.llm.common import DOCS, ODD_TEXTS, docs_table


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes, fanout):
    """All levels of a tree, the leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def proof_of(tree, place, fanout):
    steps = []
    for nodes in tree[:-1]:
        at = place // fanout * fanout
        steps.append(("".join(nodes[at:place]), "".join(nodes[place + 1:at + fanout])))
        place //= fanout
    return steps


def expected(rows, fanout):
    """(id, leaf, subroot, root, proof) of rows (id, group, values), by building whole trees."""
    groups = {}
    for key, group, values in rows:
        groups.setdefault(group, []).append((key, leaf_of(values)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {g: levels([leaf for _, leaf in groups[g]], fanout) for g in order}
    top = levels([trees[g][-1][0] for g in order], fanout)
    out = []
    for n, g in enumerate(order):
        for place, (key, leaf) in enumerate(groups[g]):
            out.append((key, leaf, trees[g][-1][0], top[-1][0], proof_of(trees[g], place, fanout) + proof_of(top, n, fanout)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fanout, block, rows", [(2, 4096, 300), (2, 4, 700), (3, 9, 500), (5, 7, 211), (2, 2, 1)])
def test_trees_and_proofs(spark, fanout, block, rows):
    """Groups of very different sizes, single rows, null groups and ids, ties and repeated rows."""
    random.seed(rows)
    table = [(random.choice([None, *range(rows)]), random.choice(["a"] * 9 + ["b", "", None, "é"]), random.choice(["x", None, ""])) for _ in range(rows)]
    table += table[:rows // 9]
    df = spark.createDataFrame(table, "key bigint, tree string, digest string").withColumn("position", F.lit("clash")).repartition(5)
    found = manifest.manifest(df, [F.col("key"), F.col("digest")], F.col("tree"), F.col("key"), {"proof_": F.col("position"), "block": F.col("digest")}, fanout, block)
    got = found.withColumn("folded", manifest.folded(F.col("leaf"), F.col("proof"))).collect()
    assert sorted([(r["id"], r["leaf"], r["subroot"], r["root"], [(p["left"], p["right"]) for p in r["proof"]]) for r in got], key=repr) == expected([(k, g, (k, d)) for k, g, d in table], fanout)
    assert all(r["folded"] == r["root"] and r["proof_"] == "clash" for r in got)
    assert all(leaf_of((r["id"], r["block"])) == r["leaf"] for r in got)


def test_a_changed_leaf_leads_to_another_root(spark):
    df = spark.range(40).select("id", F.lit("g").alias("g"))
    found = manifest.manifest(df, [F.col("id")], F.col("g"), F.col("id"), block=8)
    assert found.where(manifest.folded(F.sha2(F.col("leaf"), 256), F.col("proof")) == F.col("root")).count() == 0


def test_query_on_odd_documents(spark, tmp_path):
    """Null ids are never tampered with; null counts stay, so those rows verify."""
    rows = [(i, t, lang, "s", n, "x", 7, "y", 0.5, "z") for (i, t), lang, n in zip(ODD_TEXTS * 3, ["en", None, "de"] * 9, [1, None, 3, 4] * 7)]
    rows += [(i, "t", "en", None, 5, None, None, None, None, None) for i in range(60)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_merkle_manifest(spark, str(tmp_path)).collect()
    known = {r[:3] for r in [(a, b, c) for a, b, c, *_ in expected([(r[0], r[2], (r[0], r[3], r[2], r[4], r[1])) for r in rows], 2)]}
    assert len(got) == len(rows) and {(r["doc_id"], r["leaf"], r["subroot"]) for r in got} == known
    counts = {leaf_of((r[0], r[3], r[2], r[4], r[1])): r[4] for r in rows}
    for r in got:
        touched = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and counts[r["leaf"]] is not None
        assert r["verified"] == (not touched) == (r["folded_root"] == r["root"])


def test_empty_table(spark, tmp_path):
    docs_table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert op11_merkle_manifest(spark, str(tmp_path)).count() == 0


def test_bad_widths(spark):
    for fanout, block in ((1, 4), (4, 3)):
        with pytest.raises(ValueError):
            manifest.manifest(spark.range(1), [F.col("id")], F.col("id"), F.col("id"), fanout=fanout, block=block)


@pytest.mark.parametrize("held", [1, 3, 50, 10_000])
def test_messages_come_in_order_of_their_labels(held):
    random.seed(held)
    queue, waiting, out = manifest.Messages(held), [], []
    for label in random.sample(range(2000), 900):
        queue.push((label, 0), str(label))
        waiting.append((label, 0))
        if random.random() < 0.4:
            smallest = min(waiting)
            waiting.remove(smallest)
            assert queue.first() == smallest and queue.pop() == (smallest, str(smallest[0])) and len(queue.heap) <= held
    while queue:
        out.append(queue.pop()[0])
    assert out == sorted(waiting)


@pytest.mark.parametrize("held", [1, 7, 1000])
def test_sweeps_do_not_depend_on_memory(held):
    leaves = [sha(str(i)) for i in range(53)]
    tree = levels(leaves, 3)
    top, runs = manifest.rise(leaves, len(tree) - 1, 3, held)
    assert top == tree[-1][0]
    for place, proof in manifest.hand_down(runs, len(tree) - 1, 3, None, held):
        left, right = manifest._unfolded(proof)
        assert list(zip(left, right)) == proof_of(tree, place, 3)
