import random
from itertools import combinations

import pytest

from linkspan.functions import metrics, similarity
from linkspan.functions import text as T
from linkspan.operators import blocking, evaluation, matching, profile, validation
from linkspan.operators.keys import first_rows, keyed
from linkspan.plans import fixtures
from linkspan.sources import tables
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def er(spark):
    return fixtures.tables(spark, SF)


def brute_lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, best[j] = best[j], last + 1 if x == y else max(best[j], best[j - 1])
    return best[-1]


def test_similarities():
    assert [similarity.lcs(*p) for p in (("kitten", "sitting"), ("Béque", "beque"), ("aa", "aaa"), ("", "x"))] == [4, 3, 2, 0]
    draw = random.Random(1)
    for _ in range(500):
        a, b = ("".join(draw.choice("abé ") for _ in range(draw.randrange(9))) for _ in range(2))
        assert similarity.lcs(a, b) == brute_lcs(a, b) == similarity.lcs(b, a)
        assert (similarity.ratio(a, b) == 1) == (a == b)
        windows = [w for s, l in ((a, b), (b, a)) if len(s) <= len(l) for i, j in combinations(range(len(l) + 1), 2) if j - i <= len(s) and (j - i == len(s) or i == 0 or j == len(l)) for w in [similarity.ratio(s, l[i:j])]]
        want = max(windows, default=0.0) if a and b else float(not a and not b)
        assert abs(similarity.partial_ratio(a, b) - want) < 1e-12
    assert similarity.token_sort_ratio("b a", "a  b") == 1
    assert similarity.token_set_ratio("a b", "a b c") == 1 and similarity.token_set_ratio("", "a") == 0


def test_text_functions(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    assert one(T.clean_text(F.lit("B+ Retail Inc, Co. Company  Léarning"))) == "b retail l arning"
    assert one(T.clean_text(F.lit(None).cast("string"))) == ""
    assert one(T.tokens(F.lit("Béque राम मार्केटिंग a bc B+"))) == ["béque", "bc"]
    assert one(T.terms(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == ["a", "b", "c", "a b", "b c"]
    assert one(T.terms(F.array(F.lit("a")))) == ["a"] and one(T.terms(F.array().cast("array<string>"))) == []
    assert one(T.parse_ids(F.lit(" S2-10 , ,S3-1,"))) == ["S2-10", "S3-1"] and one(T.parse_ids_strict(F.lit("S2-1,"))) == ["S2-1", ""]
    for a, b, want in (("", "", 1), ("a", "", 0), (None, "a", 0), ("A b", "b c", 1 / 3)):
        assert one(similarity.jaccard(F.lit(a).cast("string"), F.lit(b).cast("string"))) == want


def test_f_beta_goldens(spark):
    rows = evaluation.f_beta_grid(spark, [(0.95, 0.9), (0.9, 0.9), (0.8, 0.9), (0.95, 0.7), (0.0, 0.0)]).collect()
    assert [round(r.f05, 4) for r in rows] == [0.9396, 0.9, 0.8182, 0.8867, 0.0]
    sets = spark.createDataFrame([(["a", "b", "c"], ["a", "c"]), ([], []), (["a"], []), ([], ["a"])], "p array<string>, t array<string>")
    assert [round(r.s, 3) for r in sets.select(metrics.entity_score(F.col("p"), F.col("t")).alias("s")).collect()] == [0.714, 1, 0, 0]


def test_top_k_keeps_the_threshold_and_breaks_ties(spark):
    left = spark.createDataFrame([("S1-1", "US", "t", 1.0)], "id string, block string, term string, w double")
    right = spark.createDataFrame([(f"S2-{i}", "US", "t", w) for i, w in enumerate((0.1, 0.0999, 0.5, 0.5))], left.schema)
    best = blocking.top_k(blocking.pair_scores(left, right), 2).orderBy("rank").collect()
    assert [(r.cand_id, r.rank) for r in best] == [("S2-2", 1), ("S2-3", 2)]
    assert {r.cand_id for r in blocking.pair_scores(left, right).collect()} == {"S2-0", "S2-2", "S2-3"}


@pytest.mark.parametrize("left_rows,right_rows", [(1 << 12, 1 << 16), (40, 70)])
def test_best_pairs_are_the_best_of_all_pairs(er, left_rows, right_rows):
    left, right = blocking.processed(er["er_source1"]), blocking.processed(er["er_source2"].unionByName(er["er_source3"]))
    words = blocking.numbered(blocking.vocabulary(right)).cache()
    want = blocking.top_k(blocking.pair_scores(blocking.weights(left, words.drop("n")), blocking.weights(right, words.drop("n"))), 4)
    best = blocking.best_pairs(blocking.vectors(left, words), blocking.vectors(right, words), 150, 360, 4, left_rows=left_rows, right_rows=right_rows)
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, want.collect()))
    none = blocking.best_pairs(blocking.vectors(left, words), blocking.vectors(right.limit(0), words), 150, 0)
    assert none.isEmpty()


def test_blocks_and_fallbacks(spark):
    none = spark.createDataFrame([("x", None, "")], "entity_id string, business_name string, country string")
    left, right = blocking.with_blocks(blocking.processed(none), blocking.processed(none))
    assert left.first().block == right.first().block == "ALL"
    other = spark.createDataFrame([("k", "v")], "key string, note string")
    assert blocking.processed(other).first().asDict() == {"id": "k", "block": "US", "text": "k v"}


def test_every_entity_has_a_list(er):
    found = blocking.generate_candidates(er["er_source1"], er["er_source2"], er["er_source3"])
    lists = blocking.candidate_lists(er["er_source1"], found)
    assert lists.count() == er["er_source1"].count() == lists.select("source1_entity_id").distinct().count()
    assert blocking.recall(found, er["er_pairs"]).first().recall > 0.9


def test_split_is_exact_and_disjoint(er):
    train, held = evaluation.split_truth(er["er_truth"], 0.3)
    assert train.count() == 105 and held.count() == 45 and train.join(held, "source1_entity_id").count() == 0


def test_negatives(er):
    both = er["er_source2"].unionByName(er["er_source3"])
    positives = matching.positive_pairs(er["er_truth"], both)
    negatives = matching.negative_pairs(positives, both, 3)
    assert negatives.count() == negatives.distinct().count() == 3 * positives.count()
    assert negatives.join(positives, ["s1_id", "cand_id"]).count() == 0
    found = blocking.generate_candidates(er["er_source1"], er["er_source2"], er["er_source3"])
    hard = matching.negative_pairs(positives, both, 3, blocked=found)
    assert hard.join(positives, ["s1_id", "cand_id"]).count() == 0 and hard.count() > 0


def test_missing_fields_and_parity(spark):
    s1 = spark.createDataFrame([("S1-1", "a", None, "US")], tables.SOURCE_SCHEMA)
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-9", "S2-1"), ("S1-1", "S2-9")], "s1_id string, cand_id string")
    s2 = spark.createDataFrame([("S2-1", "a", "nan", "us")], tables.SOURCE_SCHEMA)
    rows = {r.s1_id: r for r in matching.pair_features(pairs, s1, s2).collect()}
    assert set(rows) == {"S1-1", "S1-9"} and rows["S1-1"].addr_ratio == 0 and rows["S1-1"].country_exact_match == 1 and rows["S1-9"].name_ratio == 0
    assert matching.pair_features(pairs, s1, s2, parity_nan=True).where("s1_id = 'S1-1'").first().addr_ratio == 1


def test_model_round_trip(er, tmp_path):
    both = er["er_source2"].unionByName(er["er_source3"])
    positives = matching.positive_pairs(er["er_truth"], both)
    pairs = matching.training_pairs(positives, matching.negative_pairs(positives, both, 1))
    features = matching.pair_features(pairs, er["er_source1"], both).cache()
    matching.save_model(matching.fit(features, trees=2, depth=3), f"{tmp_path}/m")
    scored = matching.score(features, matching.load_model(f"{tmp_path}/m")).join(pairs, ["s1_id", "cand_id"])
    good = scored.where("(score >= 0.5) = (label = 1)").count()
    assert good > 0.9 * pairs.count()
    with pytest.raises(FileNotFoundError):
        matching.load_model(f"{tmp_path}/none")


def test_lists_on_disk(spark, er, tmp_path):
    tables.write_lists(er["er_truth"].coalesce(1), f"{tmp_path}/t")
    text = spark.read.text(f"{tmp_path}/t").collect()
    assert text[0].value == "source1_entity_id\tmatched_entity_ids" and any(r.value.endswith("\t") for r in text)
    assert tables.read_lists(spark, f"{tmp_path}/t").count() == er["er_pairs"].count()
    (tmp_path / "na.tsv").write_text("entity_id\tcountry\nS1-1\tNA\nS1-2\tnull\nS1-3\tUS\n")
    assert [r.country for r in tables.read_tsv(spark, f"{tmp_path}/na.tsv").collect()] == [None, None, "US"]
    assert tables.read_ids(spark, f"{tmp_path}/na.tsv").count() == 3 and tables.file_size_mb(spark, f"{tmp_path}/na.tsv") > 0


GOOD = "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\nS1-3\tS2-2\n"
FAULTS = [
    ("V02", "", ""), ("V03", "source1_entity_id\tmatched", "source1_entity_id,matched"), ("V04", "matched_entity_ids", "ids"),
    ("V05", "S1-2\t\n", "S1-2 S2-1\n"), ("V06", "S1-2\t\n", "S1-2\t\nS1-2\t\n"), ("V07", "S2-1,S3-1", "S2-1,S2-1"),
    ("V08", "S3-1", "S1-2"), ("V09", "S3-1", "X-9"), ("V09", "S2-2\n", "S2-2,\n"), ("V10", "S3-1", "S3-999"),
    ("V11", "S1-3\tS2-2\n", ""), ("V12", "S1-3\t", "S1-9\t"), ("V16", "S1-2\t\n", "S1-2\tS2-2\n"),
]


@pytest.mark.parametrize("rule,old,new", FAULTS)
def test_one_fault_a_rule(spark, tmp_path, rule, old, new):
    files = {"m": GOOD.replace(old, new) if old else "", "c": GOOD.replace("matched", "candidate"), "s1": "entity_id\tn\nS1-1\ta\nS1-2\ta\nS1-3\ta\n", "s2": "entity_id\nS2-1\nS2-2\n", "s3": "entity_id\nS3-1\n"}
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    at = {n: f"{tmp_path}/{n}" for n in files}
    found = validation.validate(spark, at["m"], at["c"], at["s1"], [at["s2"], at["s3"]], check_ids=True)
    rules = {r.rule for r in found.collect()}
    assert rule in rules
    assert validation.passes(found) == (rule == "V16")


def test_a_good_submission_passes(spark, tmp_path):
    for name, body in {"m": GOOD, "s1": "entity_id\tn\nS1-1\ta\nS1-2\ta\nS1-3\ta\n"}.items():
        (tmp_path / name).write_text(body)
    found = validation.validate(spark, f"{tmp_path}/m", f"{tmp_path}/none", f"{tmp_path}/s1")
    assert {r.rule for r in found.collect()} == {"V14", "V15"} and validation.passes(found)


def test_profile_of_an_empty_table(spark, er):
    none = er["er_source1"].limit(0)
    assert {r.pct for r in profile.missing_pct(none).collect()} == {0.0}
    assert profile.non_ascii(none, "business_name").first().n_rows == 0
    assert evaluation.macro(evaluation.entity_scores(er["er_truth"].limit(0), er["er_truth"].limit(0))).first().macro_f05 == 0


def test_trained_queries_fit_the_defaults(monkeypatch):
    import inspect

    from linkspan.plans import queries as Q

    class Frame:
        def __getattr__(self, name):
            return lambda *a, **k: self

    calls, defaults = [], inspect.signature(matching.fit).parameters
    monkeypatch.setattr(Q.M, "fit", lambda features, **k: calls.append(k))
    monkeypatch.setattr(Q.M, "score", lambda features, model: features)
    monkeypatch.setattr(Q.M, "pair_features", lambda *a, **k: Frame())
    monkeypatch.setattr(Q, "_pairs", lambda t, ratio=5: calls.append(ratio))
    monkeypatch.setattr(Q, "_both", lambda t: None)
    monkeypatch.setattr(Q, "written", lambda df, label: df)
    monkeypatch.setattr(Q.E, "run_evaluation", lambda *a, **k: calls.append(k) or [None])
    tables = dict.fromkeys(("er_source1", "er_source2", "er_source3", "er_truth"))
    Q.gbt_scores(tables)
    Q.run_evaluation(tables)
    assert calls == [5, {}, {}]
    assert (defaults["trees"].default, defaults["depth"].default) == (300, 6)


def test_repeated_keys_and_first_rows(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "entity_id string, v int").coalesce(1)
    two = spark.createDataFrame([("b", None), ("c", 6)], one.schema)
    assert sorted(map(tuple, keyed(one, two).collect())) == [("a", 3), ("b", None), ("c", 6)] and keyed(one.limit(0)).count() == 0
    assert sorted(r.v for r in first_rows(one.where("v < 4"), "entity_id", F.desc("v")).collect()) == [2, 3]


def test_the_last_truth_row_counts(spark):
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-2")], tables.TRUTH_SCHEMA).coalesce(1)
    predicted = spark.createDataFrame([("S1-1", "S2-2")], tables.TRUTH_SCHEMA)
    row = evaluation.macro(evaluation.entity_scores(predicted, truth)).first()
    assert (row.macro_f05, row.n_entities) == (1.0, 1)


def test_null_and_repeated_identifiers(spark, er):
    def more(df):
        again = df.limit(5).withColumn("business_name", F.lit("something else"))
        return again.unionByName(df.coalesce(1)).unionByName(df.limit(3).withColumn("entity_id", F.lit(None).cast("string")))

    sources = [er[f"er_source{n}"].coalesce(1) for n in (1, 2, 3)]
    plain = blocking.generate_candidates(*sources).collect()
    got = blocking.generate_candidates(*(more(s) for s in sources)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain)) and len(got) > 1000
    pairs = spark.createDataFrame([("S1-1", "S2-10")], "s1_id string, cand_id string")
    both = sources[1].unionByName(sources[2])
    assert matching.pair_features(pairs, more(sources[0]), more(both)).count() == 1


def test_negatives_from_a_small_pool(spark):
    candidates = spark.createDataFrame([(f"S2-{k}",) for k in range(6)], "entity_id string")
    positives = spark.createDataFrame([("S1-1", "S2-0"), ("S1-2", "S2-0"), ("S1-2", "S2-1")], "s1_id string, cand_id string")
    counts = {r.s1_id: r["count"] for r in matching.negative_pairs(positives, candidates, 2).groupBy("s1_id").count().collect()}
    assert counts == {"S1-1": 2, "S1-2": 4}
    assert matching.negative_pairs(positives, candidates, 50).groupBy("s1_id").count().where("count > 5").isEmpty()


def test_sweep_is_that_of_each_threshold(spark, er):
    scores = er["er_pairs"].withColumn("score", F.pmod(F.xxhash64("cand_id"), F.lit(100)) / 100.0)
    scores = scores.unionByName(scores.limit(40).withColumn("cand_id", F.lit("S3-999")))
    got = {r.threshold: r.macro_f05 for r in evaluation.threshold_sweep(scores, er["er_truth"], [0.0, 0.4, 0.9, 2.0]).collect()}
    for t, value in got.items():
        lists = matching.match_lists(er["er_source1"], matching.matched(scores, t))
        assert abs(evaluation.macro(evaluation.entity_scores(lists, er["er_truth"])).first().macro_f05 - value) < 1e-12
    assert len(got) == 4


def test_lines_of_many_files_are_in_order(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}").write_text("".join(f"{k}-{j}\n" for j in range(5 * (3 - k))))
    rows = tables.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.line_no for r in rows] == list(range(1, 31)) and [r.value for r in rows] == [f"{k}-{j}" for k in range(3) for j in range(5 * (3 - k))]


def test_a_replacement_character_is_valid(spark, tmp_path):
    body = GOOD.replace("S2-2", "S2-\ufffd")
    (tmp_path / "m").write_text(body)
    (tmp_path / "b").write_bytes(body.encode("utf-8").replace(b"\xef\xbf\xbd", b"\xff"))
    required = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "id string")
    rules = [[r.rule for r in validation.check_file(spark, f"{tmp_path}/{n}", ["source1_entity_id", "matched_entity_ids"], required)[0].collect()] for n in ("m", "b")]
    assert rules == [[], ["V18"]]


def test_the_vocabulary_has_every_term(spark):
    """More than 100,000 terms, each in three rows."""
    words = F.expr("array_join(transform(sequence(0, 39), x -> concat('w', cast(id % 1400 * 40 + x as string))), ' ')")
    rows = spark.range(4200).select(F.concat(F.lit("S2-"), "id").alias("id"), F.lit("US").alias("block"), words.alias("text"))
    terms = blocking.vocabulary(rows)
    assert terms.count() == 1400 * 79 and terms.where("df <> 3").isEmpty()
    assert blocking.vocabulary(rows, max_terms=100).count() == 100
    assert blocking.weights(rows, terms).count() == 4200 * 79


def _vectors(draw, n, mark, terms=60):
    import math

    import pyarrow as pa

    rows = []
    for k in range(n):
        own = sorted({min(int(draw.expovariate(0.08)), terms - 1) for _ in range(draw.randrange(1, 9))})
        raw = [1 + t / 10 for t in own]
        rows.append((f"{mark}{k}", own, [w / math.sqrt(sum(x * x for x in raw)) for w in raw]))
    return rows, pa.table({"id": [r[0] for r in rows], "terms": pa.array([r[1] for r in rows], pa.list_(pa.int32())), "weights": [r[2] for r in rows]})


@pytest.mark.parametrize("share", [0, 8, 1 << 40])
def test_the_search_finds_what_all_pairs_give(share):
    """Postings only, a mixture, and all pairs; the vectors have many ties."""
    from linkspan.operators import nearest

    draw = random.Random(5)
    (left, a), (right, b) = _vectors(draw, 300, "S1-"), _vectors(draw, 700, "S2-")
    got = {}
    for r in nearest.best(4, 0.3, share)(a, b).to_pylist():
        got.setdefault(r["s1_id"], []).append((-round(r["score"], 6), r["cand_id"]))
    sums = {r["s1_id"]: r for r in nearest.totals(0.3)(a, b).to_pylist()}
    for name, terms, weights in left:
        own = dict(zip(terms, weights))
        scores = [(-round(sum(own.get(t, 0) * w for t, w in zip(ts, ws)), 6), other) for other, ts, ws in right]
        hits = sorted(s for s in scores if s[0] <= -0.3)
        assert sorted(got.get(name, [])) == hits[:4]
        if hits:
            row, micro = sums.pop(name), [round(-s * 1e6) for s, _ in hits]
            assert (row["n"], row["total"], row["least"], row["most"]) == (len(hits), sum(micro), min(micro), max(micro))
    assert not sums


def test_the_search_scores_few_pairs(monkeypatch):
    from linkspan.operators import nearest

    draw, scored = random.Random(6), []
    plain = nearest._Batch.some_of
    monkeypatch.setattr(nearest._Batch, "some_of", lambda self, row, other, position: scored.append(len(row)) or plain(self, row, other, position))
    (left, a), (_, b) = _vectors(draw, 200, "S1-", 2000), _vectors(draw, 20_000, "S2-", 2000)
    assert len(nearest.best(15, 0.1, 0)(a, b)) == 200 * 15
    assert sum(scored) < 200 * 20_000 / 8


@pytest.mark.parametrize("group", [0, 64, 1 << 40])
def test_products_of_a_term_find_what_single_pairs_do(monkeypatch, group):
    """Terms as products only, a mixture, and pair by pair; a product replaces many pairs."""
    from linkspan.operators import nearest

    draw, scored = random.Random(7), []
    plain = nearest._Batch.some_of
    monkeypatch.setattr(nearest._Batch, "some_of", lambda self, row, other, position: scored.append(len(row)) or plain(self, row, other, position))
    (_, a), (_, b) = _vectors(draw, 200, "S1-"), _vectors(draw, 900, "S2-")
    rows = {n: sorted((r["s1_id"], round(r["score"], 6), r["cand_id"]) for r in nearest.best(5, 0.2, 0, n)(a, b).to_pylist()) for n in (1 << 40, group)}
    assert rows[group] == rows[1 << 40]
    alone, scored[:] = sum(scored), []
    nearest.best(5, 0.2, 0, group)(a, b)
    assert (sum(scored) == 0) == (group == 0) and alone > 0


def test_terms_counted_inside_tasks(er):
    """The vocabulary and vectors of rows without repeats are those of any rows; so are those
    of more words than tasks look up."""
    rows = keyed(blocking.processed(er["er_source2"].unionByName(er["er_source3"])), key="id").cache()
    words = blocking.numbered(blocking.vocabulary(rows)).cache()
    own = blocking.numbered(blocking.keyed_vocabulary(rows))
    assert sorted(map(tuple, words.collect())) == sorted(map(tuple, own.collect()))

    def cells(df):
        return {r.id: (r.block, sorted(zip(r.terms, (round(w, 9) for w in r.weights)))) for r in df.collect()}

    want = cells(blocking.vectors(rows, words))
    assert cells(blocking.keyed_vectors(rows, words)) == want == cells(blocking.keyed_vectors(rows, words, 10))
    odd = rows.limit(3).withColumn("text", F.expr("element_at(array('', 'x', 'golden golden golden'), CAST(row_number() OVER (ORDER BY id) AS INT))"))
    assert cells(blocking.keyed_vectors(odd, words)) == cells(blocking.vectors(odd, words))


def test_sums_of_pairs_are_those_of_all_pairs(er):
    left, right = blocking.processed(er["er_source1"]), blocking.processed(er["er_source2"].unionByName(er["er_source3"]))
    words = blocking.numbered(blocking.vocabulary(right)).cache()
    want = blocking.pair_scores(blocking.weights(left, words.drop("n")), blocking.weights(right, words.drop("n")))
    want = want.groupBy("s1_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("score") * 1e6)).cast("bigint").alias("total"))
    got = blocking.pair_totals(blocking.vectors(left, words), blocking.vectors(right, words), left_rows=40, right_rows=70).groupBy("s1_id").agg(F.sum("n"), F.sum("total"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("group, small", [(0, 0), (0, 1 << 40), (64, 0), (1 << 40, 0)])
@pytest.mark.parametrize("most", [1, 8, 1 << 12])
def test_sums_score_few_pairs(monkeypatch, group, small, most):
    """Sums by groups, products of one or two terms and single pairs are those of all pairs,
    and products have a part of them."""
    import numpy as np

    from linkspan.operators import nearest

    monkeypatch.setattr(nearest, "SMALL", small)
    monkeypatch.setattr(nearest, "SETUP", 0)
    monkeypatch.setattr(nearest, "RARE", 1 << 40)
    draw, scored = random.Random(8), []
    (left, a), (right, b) = _vectors(draw, 300, "S1-", 200), _vectors(draw, 9000, "S2-", 200)
    plain = nearest._Product.of
    monkeypatch.setattr(nearest._Product, "of", lambda self, row, term, weight, n: scored.append(n * self.n) or plain(self, row, term, weight, n))
    got = {r["s1_id"]: (r["n"], r["total"], r["least"], r["most"]) for r in nearest.totals(0.4, group, most)(a, b).to_pylist()}
    dense = np.zeros((2, 9000, 200))
    for side, rows in enumerate((left, right)):
        for k, (_, terms, weights) in enumerate(rows):
            dense[side, k, terms] = weights
    micro = np.rint(dense[0, :300] @ dense[1].T * 1e6).astype(int)
    want = {left[k][0]: (len(hits), hits.sum(), hits.min(), hits.max()) for k, line in enumerate(micro) if len(hits := line[line >= 400_000])}
    assert got == want
    assert sum(scored) < 300 * 9000 * 2 / 3


def test_trees_on_cells(spark, er):
    """300 trees of the default depth end soon; Spark's model gives the margins that were grown."""
    import time

    import numpy as np

    from linkspan.operators import boosting
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = spark.range(3000).selectExpr("id % 11 / 10.0D AS a", "pmod(xxhash64(id), 101) / 100.0D AS b", "CAST(id % 11 > 6 AND pmod(xxhash64(id), 101) > 30 AS INT) AS label").cache()
    start, names = time.time(), ("a", "b")
    cuts = boosting.borders(rows, names)
    table = boosting.cells(rows, names, cuts).toPandas()
    assert table["n"].sum() == 3000 and len(cuts[0]) == 10
    code, label = table["code"].to_numpy(), table["label"].to_numpy()
    bins = np.stack([code & 31, code >> 5])
    grown, margin = boosting.boost(bins, label, table["n"].to_numpy(), 2.0, 300, 6, 0.05, 42)
    assert time.time() - start < 60 and ((margin > 0) == (label == 1)).mean() > 0.9
    model = boosting.spark_model(spark, grown[:20], cuts, 0.05)
    scored = model.transform(VectorAssembler(inputCols=list(names), outputCol="features").transform(rows)).select("a", "b", vector_to_array("probability")[1].alias("p")).collect()
    few, margin = boosting.boost(bins, label, table["n"].to_numpy(), 2.0, 20, 6, 0.05, 42)
    known = dict(zip(code.tolist(), margin.tolist()))
    for r in scored:
        place = sum(r.a > x for x in cuts[0]) + (sum(r.b > x for x in cuts[1]) << 5)
        assert abs(r.p - 1 / (1 + np.exp(-2 * known[place]))) < 1e-9


def test_many_similarities_at_once():
    """Machine words give what big integers do, also for strings of their size and longer,
    characters outside ASCII and nulls; 20,000 partial ratios take no minute."""
    import time

    draw = random.Random(8)
    texts = ["".join(draw.choice("ab céराx") for _ in range(draw.choice([0, 1, 2, 5, 20, 63, 64, 65, 70]))) for _ in range(150)]
    pairs = [(a, draw.choice([draw.choice(texts), a[1:], a[::-1], a])) for a in texts] + [("ab\0", "ab"), ("ab\0", "ab\0c"), ("", "\0")]
    a, b = map(list, zip(*pairs))
    for name in ("lcs", "ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio"):
        assert getattr(similarity, f"{name}_all")(a, b).tolist() == [getattr(similarity, name)(*p) for p in pairs]
        assert len(getattr(similarity, f"{name}_all")([], [])) == 0
    start = time.time()
    similarity.partial_ratio_all([f"golden retail house{k} Inc" for k in range(20_000)], [f"northern foods group{k} & Company" for k in range(20_000)])
    assert time.time() - start < 4
