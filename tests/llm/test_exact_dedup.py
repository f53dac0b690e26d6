import time
from collections import defaultdict

import numpy as np
from linkspan.llm import exact_dedup as E


def brute(rows, largest):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = {}
    for text, ids in groups.items():
        real = [i for i in ids if i is not None]
        out[text] = (max(real) if largest else min(real)) if real else None, len(ids)
    return out


def test_decisions_on_tricky_rows(spark, tricky):
    for keep in ("smallest", "largest"):
        prints = E.fingerprints(tricky.repartition(5))
        got = E.decisions(prints, keep=keep, fold=1, range_entries=2).collect()
        want = brute([(r.doc_id, r.text) for r in tricky.collect()], keep == "largest")
        assert len(got) == tricky.count()
        assert {(r.keep_id, r.group_size) for r in got} == set(want.values())
        assert sum(r.kept for r in got) == len(want)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_deduplicate_keeps_columns_and_one_row(tricky, empty):
    got = E.deduplicate(tricky)
    assert got.columns == tricky.columns
    rows = got.collect()
    assert len(rows) == len({r.text or "" for r in rows}) == len({r.text or "" for r in tricky.collect()})
    assert E.deduplicate(empty).count() == 0
    assert E.decisions(E.fingerprints(empty)).count() == 0


def test_null_ids_only(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id bigint, text string")
    rows = E.decisions(E.fingerprints(docs)).collect()
    assert [r.keep_id for r in rows] == [None, None] and sum(r.kept for r in rows) == 1
    assert E.deduplicate(docs).count() == 1


def test_hot_text(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "if(id % 3 = 0, 'same', concat('t', id)) text").repartition(16)
    rows = E.decisions(E.fingerprints(docs), keep="largest").where("group_size > 1").collect()
    assert len(rows) == 1000 and {r.keep_id for r in rows} == {2997}


def test_many_arrow_batches_in_a_task(spark):
    docs = spark.range(1000).selectExpr("id doc_id", "concat('t', id % 700) text").coalesce(2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        rows = E.decisions(E.fingerprints(docs), keep="largest", range_entries=100).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.doc_id: (r.keep_id, r.group_size) for r in rows} == {i: (i + 700, 2) if i < 300 else (i, 2 if i >= 700 else 1) for i in range(1000)}


def entries(draw, n, words):
    """A batch of n entries over few keys; keys often share their first words."""
    keys = draw.integers(0, words, (n, 6)).astype(">u8")
    keys[:, 1:5] = 0
    one = np.ones(n, dtype="<i8")
    return keys, draw.integers(-5, 5, n), np.arange(n) + draw.integers(0, 99), one, one, one


def test_merges_against_a_dictionary():
    draw = np.random.default_rng(1)
    for largest in (False, True):
        for _ in range(200):
            held, want = E.Runs(largest), {}
            for _ in range(draw.integers(1, 9)):
                batch = entries(draw, int(draw.integers(1, 40)), int(draw.integers(1, 12)))
                for key, i, row in zip(batch[0], batch[1].tolist(), batch[2].tolist()):
                    rank, n, ties = want.get(key.tobytes(), (None, 0, 0))
                    new = (-i if largest else i, row)
                    same = rank is not None and rank[0] == new[0]
                    best = new if rank is None or new < rank else rank
                    want[key.tobytes()] = (best, n + 1, ties + 1 if same else 1 if best is new else ties)
                held.add(E._run(*batch, largest=largest))
            keys, ids, rows, counts, _, ties = held.whole()
            got = {k.tobytes(): ((-i if largest else i, r), c, t) for k, i, r, c, t in zip(keys, ids.tolist(), rows.tolist(), counts.tolist(), ties.tolist())}
            assert [k.tobytes() for k in keys] == sorted(want) and got == want


def test_a_task_is_linear_in_its_rows():
    draw, took = np.random.default_rng(2), []
    for n in (20, 80):
        batches = []
        for _ in range(n):
            keys = draw.integers(0, 2**63, (5000, 6)).astype(">u8")
            batches.append((keys, np.arange(5000), np.arange(5000), *[np.ones(5000, dtype="<i8")] * 3))
        start, held = time.process_time(), E.Runs(False)
        for batch in batches:
            held.add(E._run(*batch, largest=False))
        assert len(held.whole()[1]) == 5000 * n
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0]  # four times the rows; quadratic would be sixteen


def test_rounds_of_many_partitions(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "concat('t', id % 1500) text").repartition(23)
    prints = E.fingerprints(docs).repartition(23)
    for fold in (1, 2, 3):
        rows = E.winners(prints, "largest", fold, range_entries=16).collect()
        assert len(rows) == 1500 and sum(r.group_size for r in rows) == 4000
        assert {r.keep_id for r in rows} == set(range(2500, 4000))
