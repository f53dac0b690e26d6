import random

import corpus_pipeline
import numpy as np
from linkspan.llm import near_copies as N
from linkspan.llm.simhash_dedup import fingerprint

DOCS = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """Smallest identifier of every group that Jaccard >= 0.8 connects."""
    rows = sorted(rows)
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [rows[k][0] for k in range(len(rows)) if find(k) == k]


def planted():
    draw, out = random.Random(5), []
    for n in (5, 6, 9, 30, 120, 400):
        for _ in range(4):
            base = [f"w{draw.randrange(5000)}" for _ in range(n)]
            out.append(" ".join(base))
            for edits in (1, 1, 2, 3, 5, 8):
                words = list(base)
                for _ in range(min(edits, 1 + n // 40)):
                    words[draw.randrange(n)] = f"v{draw.randrange(5000)}"
                out.append(" ".join(words[: max(1, n - draw.randrange(1 + n // 6))]).upper())
    passage = " ".join(f"p{k}" for k in range(30))
    out += [passage + " " + " ".join(f"u{draw.randrange(9999)}" for _ in range(60)) for _ in range(40)]
    return [(k, t) for k, t in enumerate([*out, "", None, " \t", "a b", "A  B"])]


def test_stage_against_brute_force(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == brute(rows)
    # within four bits of SimHash many of these groups would fall apart
    texts = dict(rows)
    far = [(a, b) for a in texts for b in texts if a < b and jaccard(shingles(texts[a]), shingles(texts[b])) >= 0.8 and (fingerprint((texts[a] or "").encode(), 4, 42) ^ fingerprint((texts[b] or "").encode(), 4, 42)).bit_count() > 4]
    assert len(far) > 10


def test_hot_buckets_and_documents(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    cut = {r.doc_id: r.component_id for r in N.decisions(docs, bucket_rows=4, group_hashes=200).collect()}
    assert sorted(set(cut.values())) == brute(rows)
    docs = spark.read.parquet(f"{DOCS}/documents.parquet").select("doc_id", "text")
    assert sorted(r.doc_id for r in N.deduplicate(docs).collect()) == brute([tuple(r) for r in docs.collect()])


def test_sets_and_bounds():
    text = "A b c D e f g A b c d e"
    assert len(N.shingle_set(text.encode())) == len(shingles(text)) == 7
    for n in range(1, 200):
        assert N.prefix_size(n) == n - int(np.ceil(n * 4 / 5 - 1e-9)) + 1


def test_exact_similarity_by_either_way(monkeypatch):
    draw = np.random.default_rng(3)
    base = np.unique(draw.integers(-(2**63), 2**63 - 1, 100))
    hashes = [np.unique(np.r_[draw.choice(base, draw.integers(60, 100), replace=False), draw.integers(0, 2**62, draw.integers(0, 9))]) for _ in range(40)]
    a, b = np.triu_indices(40, 1)
    want = [len(set(hashes[x]) & set(hashes[y])) / len(set(hashes[x]) | set(hashes[y])) >= 0.8 for x, y in zip(a, b)]
    assert any(want) and not all(want)
    assert N.Sets(hashes).alike(a, b).tolist() == want
    monkeypatch.setattr(N, "MATRIX", 1)
    assert N.Sets(hashes).alike(a, b).tolist() == want


def test_fingerprints_never_lose_a_pair():
    draw, distances = np.random.default_rng(4), []
    for n in [N.SMALL] * 200 + [60] * 100 + [300] * 60 + [3000] * 20:
        a = np.unique(draw.integers(-(2**63), 2**63 - 1, n))
        for keep, more in ((n - n // 5, 0), (n - n // 9, n // 9)):  # 0.8 by what is gone, and by what is other
            b = np.unique(np.r_[a[:keep], draw.integers(-(2**63), 2**63 - 1, more)])
            if len(b) >= N.SMALL and N.alike(len(np.intersect1d(a, b)), len(a), len(b)):
                x, y = (np.frombuffer(N.simhash(s), np.uint8) for s in (a, b))
                distances.append(int(np.unpackbits(x ^ y).sum()))
        c = np.frombuffer(N.simhash(np.unique(draw.integers(-(2**63), 2**63 - 1, n))), np.uint8)
        assert int(np.unpackbits(c ^ np.frombuffer(N.simhash(a), np.uint8)).sum()) > N.RADIUS
    assert len(distances) > 300 and max(distances) <= N.RADIUS


def test_rare_hashes_come_first():
    own = np.arange(40, dtype=np.int64)
    frequency = np.zeros(N.ORDER_CELLS, dtype=np.int64)
    frequency[:20] = 1000
    assert N.prefix(own, frequency).tolist() == list(range(20, 29))


def test_a_passage_of_all_documents(spark):
    draw = random.Random(6)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, passage + " " + " ".join(f"u{draw.randrange(99999)}" for _ in range(80))) for k in range(300)]
    rows += [(300 + k, rows[k][1] + " more") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted(r.doc_id for r in N.deduplicate(docs).collect()) == list(range(300)) == brute(rows)


def test_a_large_group_of_near_copies(spark):
    """Copies of one text that are alike to it, but mostly not to each other, and some that are alike to nothing."""
    draw, base = random.Random(12), [f"b{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(1, 400):
        words = list(base)
        for at in draw.sample(range(0, 195, 6), 4 if k % 5 else 9):
            words[at] = f"x{draw.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = brute(rows)
    assert 40 < len(want) < 200 and sorted(r.doc_id for r in N.deduplicate(docs).collect()) == want
