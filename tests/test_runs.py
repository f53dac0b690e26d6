import pytest

from linkspan.__main__ import parser
from linkspan.operators import validation
from linkspan.plans import fixtures, runs
from linkspan.sources import tables


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The derived tables of 30 entities as TSV files."""
    er, at = fixtures.tables(spark, "/root/testdata/sf0.001"), tmp_path_factory.mktemp("er")
    keep = {f"S1-{k}" for k in range(1, 31)}
    truth = [r for r in er["er_truth"].collect() if r.source1_entity_id in keep]
    listed = {x for r in truth for x in r.matched_entity_ids.split(",")}
    for name in ("er_source1", "er_source2", "er_source3"):
        rows = [r for r in er[name].collect() if r.entity_id in keep | listed]
        body = "".join("\t".join(v or "" for v in r) + "\n" for r in rows)
        (at / f"{name[3:]}.tsv").write_text("\t".join(rows[0].__fields__) + "\n" + body)
    (at / "truth.tsv").write_text("\t".join(truth[0].__fields__) + "\n" + "".join("\t".join(r) + "\n" for r in truth))
    return str(at)


def test_a_run_from_files_to_findings(spark, folder, tmp_path):
    out = str(tmp_path)
    found = runs.run(spark, out, folder, folder, k=3, neg_ratio=1, trees=2, depth=2)
    rules = {r.rule for r in found.collect()}
    assert validation.passes(found) and rules == {"V14"}
    lists = spark.read.option("sep", "\t").option("header", True).csv(f"{out}/matches")
    assert lists.count() == 30
    tables.write_lists(lists.na.fill("").repartition(3), f"{out}/parts/matches")
    parts = runs.check(spark, folder, f"{out}/parts")
    assert {r.rule for r in parts.collect()} == {"V14", "V15"}
    again = runs.run(spark, out, None, folder, mode="predict-only", threshold=1.1)
    assert validation.passes(again)
    lists = spark.read.option("sep", "\t").option("header", True).csv(f"{out}/matches")
    assert lists.where("matched_entity_ids <> ''").isEmpty()
    with pytest.raises(ValueError):
        runs.run(spark, out, folder, folder, mode="none")
    with pytest.raises(FileNotFoundError):
        runs.predict(spark, folder, f"{out}/none")


def test_the_report_names_every_section(spark, folder):
    text = runs.report(spark, folder)
    for part in ("Source 3: records", "Source 1: missing", "Singletons", "Noise of true pairs", "0.9396"):
        assert part in text


def test_arguments():
    args = parser().parse_args(["run", "--out", "o", "--mode", "train-only", "--top-k", "3"])
    assert args.mode == "train-only" and args.top_k == 3 and not args.skip_blocking
