import random

import numpy as np
import pytest

from linkspan.llm import simhash_dedup as S
from linkspan.llm.components import components


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(seed, n, flips):
    draw = random.Random(seed)
    base = [draw.getrandbits(64) for _ in range(n // 5)]
    out = set()
    while len(out) < n:
        x = draw.choice(base)
        for b in draw.sample(range(64), draw.randrange(flips)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


def brute_links(prints, radius):
    return [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= radius]


@pytest.mark.parametrize("lag", [1, 5, 63, 64, 65, 100])
def test_planes_find_every_distance(lag):
    prints = np.array(near(1, 300, 9), dtype=np.uint64)
    wanted = np.arange(300 - lag) % 3 > 0
    got = set(S.Planes(prints).within(lag, wanted, 4).tolist())
    want = {i for i in range(300 - lag) if wanted[i] and (int(prints[i]) ^ int(prints[i + lag])).bit_count() <= 4}
    assert got == want


def test_forest_connects_each_bucket():
    prints = near(2, 400, 7)
    keys = np.sort(np.array([random.Random(i).randrange(4) for i in range(400)]))
    u, v = S.forest(keys, np.array(prints, dtype=np.uint64), 4)
    want = [(a, b) for k in range(4) for a, b in brute_links([p for p, q in zip(prints, keys) if q == k], 4)]
    assert brute_components(zip(u.tolist(), v.tolist()), prints) == brute_components(want, prints)
    assert len(u) == 400 - len(set(brute_components(want, prints).values()))


@pytest.mark.parametrize("bucket_rows", [8192, 16])
def test_links_miss_nothing(spark, bucket_rows):
    prints = near(3, 500, 8)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    got = [(int(np.int64(r.u).astype(np.uint64)), int(np.int64(r.v).astype(np.uint64))) for r in S.links(nodes, 4, bucket_rows).collect()]
    assert brute_components(got, prints) == brute_components(brute_links(prints, 4), prints)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 150)] + [(7, 7), (3, 2)]
    for one_task in (1 << 18, 0):
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(7), one_task).collect()}
        assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 150)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_fingerprint_against_plain_python():
    import xxhash

    text = "The quick brown fox, the Quick brown FOX jumps é over the quick brown fox"
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert S.fingerprint(text.encode(), 4, 42) == want
    assert S.fingerprint(b" \t", 4, 42) == 0
    assert S.fingerprint(b"A b", 4, 42) == xxhash.xxh64_intdigest(b"a b", 42)


def test_decisions_on_documents(spark, tricky, empty):
    rows = S.decisions(S.fingerprints(tricky)).collect()
    prints = {(r.doc_id, r.fp) for r in rows}
    assert len(rows) == tricky.count()
    nodes = {int(np.int64(fp).astype(np.uint64)) for _, fp in prints}
    root = brute_components(brute_links(sorted(nodes), 4), nodes)
    for r in rows:
        own = root[int(np.int64(r.fp).astype(np.uint64))]
        ids = [i for i, fp in prints if root[int(np.int64(fp).astype(np.uint64))] == own and i is not None]
        assert r.component_id == min(ids)
    kept = S.deduplicate(tricky)
    assert kept.columns == tricky.columns and kept.count() == len(set(root.values()))
    assert S.deduplicate(empty).count() == 0
