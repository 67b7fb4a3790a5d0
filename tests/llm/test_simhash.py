import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from rowsmith.llm import simhash
from tests.llm.common import LOWER, ODD_TEXTS, docs_table, words


def fingerprint(text, shingle):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    runs = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, distance):
    """Smallest index reachable for each fingerprint."""
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def texts(seed, n):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(4)) for _ in range(200)]
    out = []
    for _ in range(n):
        if out and r.random() < 0.6:
            w = r.choice(out).split(" ")
            w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w))
        else:
            out.append(" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 40, 300]))))
    return out


@pytest.mark.parametrize("shingle", [1, 4])
def test_fingerprints_are_those_of_the_definition(shingle):
    given = [t for _, t in ODD_TEXTS] + texts(1, 30) + ["A\tB\x0b c  d ", "É a b c d"]
    found = simhash.fingerprints_of(pa.array(given), shingle)
    assert [int(f) for f in found] == [fingerprint(t, shingle) for t in given]


@pytest.mark.parametrize("distance", [0, 1, 4])
def test_links_of_a_bucket_have_the_components_of_all_pairs(distance):
    r = random.Random(distance)
    centres = [r.getrandbits(64) for _ in range(5)]
    prints = sorted({c ^ sum({1 << r.randrange(64) for _ in range(r.randrange(6))}) for c in centres for _ in range(60)})
    bucket = np.array([p & 1 for p in prints], np.int64), np.zeros(len(prints), np.int64)
    a, b = simhash.linked(bucket, np.array(prints, np.uint64), distance)
    place = {p: i for i, p in enumerate(prints)}
    root = list(range(len(prints)))
    for x, y in zip(a.tolist(), b.tolist()):
        i, j = root[place[x]], root[place[y]]
        root = [min(i, j) if q in (i, j) else q for q in root]
    for half in (0, 1):
        mine = [p for p in prints if p & 1 == half]
        expected = components(mine, distance)
        assert [root[place[p]] for p in mine] == [place[mine[e]] for e in expected]


@pytest.mark.parametrize("bucket_rows", [3, simhash.BUCKET_ROWS])
def test_links_connect_what_pairs_connect(spark, bucket_rows):
    r = random.Random(5)
    prints = sorted({0x1234567890ABCDEF ^ sum({1 << r.randrange(64) for _ in range(r.randrange(8))}) for _ in range(150)})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fingerprint bigint")
    found = {x["node"]: x["root"] for x in simhash.components(simhash.links(df, 4, bucket_rows=bucket_rows)).collect()}
    expected = components(prints, 4)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    groups, mine = {}, {}
    for s, e in zip(signed, expected):
        groups.setdefault(e, set()).add(s)
        mine.setdefault(found.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_near_duplicates_of_odd_rows(spark):
    given = ODD_TEXTS + list(enumerate(texts(3, 60)))
    found = simhash.near_duplicates(docs_table(spark, given), shingle=4, distance=4).collect()
    prints = [fingerprint(t, 4) for _, t in given]
    root = components(prints, 4)
    least = {}
    for (i, _), r in zip(given, root):
        least[r] = min(x for x in (least.get(r), i) if x is not None) if (least.get(r), i) != (None, None) else None
    expected = sorted((str(i), p - (1 << 64) if p >> 63 else p, str(least[r])) for (i, _), p, r in zip(given, prints, root))
    assert sorted((str(x["id"]), x["fingerprint"], str(x["component"])) for x in found) == expected


def test_one_of_each_group_stays(spark):
    given = ODD_TEXTS + list(enumerate(texts(4, 60))) + [(3, "other text of the same id"), (3, "other text of the same id")]
    docs = docs_table(spark, given)
    kept = simhash.keep_one(docs)
    root = components([fingerprint(t, 4) for _, t in given], 4)
    groups = {}
    for (i, t), r in zip(given, root):
        groups.setdefault(r, []).append((i, t))
    rows = kept.collect()
    assert kept.columns == docs.columns and len(rows) == len(groups)
    for row in rows:
        group = next(g for g in groups.values() if (row["doc_id"], row["text"]) in g)
        assert row["doc_id"] == min((i for i, _ in group if i is not None), default=None)


def test_empty_tables(spark):
    empty = docs_table(spark, [])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
