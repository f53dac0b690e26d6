import corpus_pipeline
from linkspan.llm import exact_dedup
from test_near_copies import brute

DOCS = "/root/testdata/sf0.001"


def test_stages_chain(spark, tricky, tmp_path):
    own = tricky.select("doc_id", "text", "lang", "source", "n_chars")
    docs = spark.read.parquet(f"{DOCS}/documents.parquet").unionByName(own)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, counts = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if name == "exact_dedup":
            assert counts[-1] == before.select("text").distinct().count()
        if name == "simhash_dedup":
            # five words and a similarity of 0.8, not the four bits of op6's contract
            assert sorted(r.doc_id for r in docs.collect() if r.doc_id) == brute([(r.doc_id, r.text) for r in before.collect() if r.doc_id])
    assert counts[0] >= 200 and counts[1] < counts[0] and counts[2] <= counts[1] and counts[3] > counts[2]
    assert sorted(r.name for r in docs.select("doc_id", "sequence_id").schema) == ["doc_id", "sequence_id"]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert exact_dedup.QUERIES.keys() == {"op1_exact_dedup"}


def test_stages_on_an_empty_table(spark, empty, tmp_path):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0


def test_a_task_gives_its_memory_back():
    """Many small arrays that a task has freed don't stay in its worker."""
    import numpy as np

    from linkspan.llm.common import releasing

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    kept = []

    def run(batches):
        held = [np.ones(2000) for _ in range(20_000)]
        kept.extend(held[::500])  # what lies between keeps the C library from shrinking its heap
        del held
        yield from batches

    before = resident()
    assert list(releasing(run)([1, 2])) == [1, 2]
    assert resident() - before < 100 << 20
