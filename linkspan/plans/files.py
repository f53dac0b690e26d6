"""Queries that write small files or the derived tables as files, and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspan.operators import matching as M
from linkspan.operators import validation as V
from linkspan.plans import runs
from linkspan.plans.queries import _CAND, _both, _pairs, query
from linkspan.sources import tables
from linkspan.sources.shared import shared_folder, written

_GOOD = "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\nS1-3\tS2-2\n"


def _tsv(df: DataFrame, label: str) -> str:
    """df as a folder of TSV files with headers."""
    path = shared_folder(df.sparkSession, label)
    df.write.option("sep", "\t").option("header", True).option("quote", "\u0000").option("emptyValue", "").option("nullValue", "").csv(path)
    return path


def _file(spark, label: str, content: str | bytes) -> str:
    path = shared_folder(spark, label)
    tables.write_bytes(spark, path, content.encode() if isinstance(content, str) else content)
    return path


@query(_CAND + "\nSELECT * FROM cand")
def tsv_scan(t):
    """Missing addresses stand in the file as NA tokens."""
    marked = _both(t).withColumn("business_address", F.coalesce("business_address", F.when(F.col("entity_id").endswith("1"), "NULL").when(F.col("entity_id").endswith("2"), "N/A")))
    return tables.read_tsv(t["customer"].sparkSession, _tsv(marked, "tsv"), tables.SOURCE_SCHEMA)


@query(_CAND + "\nSELECT (SELECT count(*) FROM er_source1) AS n_rows, (SELECT count(*) FROM er_source1) AS n_ids, (SELECT count(*) FROM cand) AS n_targets, true AS has_size, 1::BIGINT AS n_missing")
def file_counts(t):
    """Rows, distinct identifiers and targets of files, and the warning for a missing one."""
    spark = t["customer"].sparkSession
    one, two, three = (_tsv(t[f"er_source{n}"], f"source{n}") for n in (1, 2, 3))
    targets, none = tables.read_targets(spark, [two, three])
    missing = tables.read_targets(spark, [two, f"{three}-none"])
    rows = tables.read_tsv(spark, one).agg(F.count("*").alias("n_rows"))
    ids = tables.read_ids(spark, one).agg(F.count("*").alias("n_ids"))
    found = rows.crossJoin(ids).crossJoin(targets.agg(F.count("*").alias("n_targets")))  # one row each
    return found.withColumn("has_size", F.lit(tables.file_size_mb(spark, one) > 0)).withColumn("n_missing", F.lit(len(missing[1]) + len(none)).cast("bigint"))


@query("SELECT least(50, count(*)) AS n_rows, least(50, count(*)) AS n_known FROM er_source1")
def subset_first_n(t):
    some = written(tables.read_sample(t["customer"].sparkSession, _tsv(t["er_source1"], "source1"), 50), "sample")
    known = some.join(t["er_source1"].select("entity_id"), "entity_id", "left_semi").agg(F.count("*").alias("n_known"))
    return some.agg(F.count("*").alias("n_rows")).crossJoin(known)


@query("SELECT * FROM (VALUES ('latin', 'S1-1', 'Café'), ('latin', 'S1-2', 'Straße'), ('utf8', 'S1-1', 'Café'), ('utf8', 'S1-2', 'राम')) AS v(file, entity_id, business_name)")
def second_encoding(t):
    """A file that isn't UTF-8 is read as ISO-8859-1."""
    spark, out = t["customer"].sparkSession, None
    for name, content in (("latin", "entity_id\tbusiness_name\nS1-1\tCafé\nS1-2\tStraße\n".encode("latin-1")), ("utf8", "entity_id\tbusiness_name\nS1-1\tCafé\nS1-2\tराम\n")):
        one = tables.read_full(spark, _file(spark, name, content)).select(F.lit(name).alias("file"), "entity_id", "business_name")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT * FROM (VALUES (2::BIGINT, true, 'S1-1', 'S2-1|S3-1'), (4::BIGINT, false, 'S1-2 S2-9', ''), (6::BIGINT, true, 'S1-3', 'S2-1| S2-2|'), (7::BIGINT, true, 'S1-4', 'a\tb')) AS v(line_no, has_tab, s1_id, ids)")
def raw_lines(t):
    """Line numbers, the first tab only, and strict lists; blank lines go."""
    spark = t["customer"].sparkSession
    path = _file(spark, "lines", "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\n\nS1-2 S2-9\n   \nS1-3\tS2-1, S2-2,\nS1-4\ta\tb\n")
    return V.parse_rows(tables.read_lines(spark, path)).select("line_no", "has_tab", "s1_id", F.array_join("ids", "|").alias("ids"))


@query("SELECT s1_id, cand_id FROM er_pairs")
def list_round_trip(t):
    path = shared_folder(t["customer"].sparkSession, "lists")
    tables.write_lists(t["er_truth"], path)
    return tables.read_lists(t["customer"].sparkSession, path)


@query("SELECT count(*) AS n_pairs, count(*) AS n_equal, true AS fails_without FROM er_pairs")
def model_round_trip(t):
    """A small model that is written and read scores as before; a missing one is an error."""
    spark = t["customer"].sparkSession
    features = written(M.pair_features(_pairs(t, 1), t["er_source1"], _both(t)), "features")
    model, path = M.fit(features, trees=3, depth=3), shared_folder(spark, "model")
    M.save_model(model, path)
    try:
        M.load_model(f"{path}-none")
        fails = False
    except FileNotFoundError:
        fails = True
    both = t["er_pairs"].join(M.score(features, model), ["s1_id", "cand_id"]).join(M.score(features, M.load_model(path)).withColumnRenamed("score", "again"), ["s1_id", "cand_id"])
    return both.agg(F.count("*").alias("n_pairs"), F.count(F.when(F.col("score") == F.col("again"), 1)).alias("n_equal")).withColumn("fails_without", F.lit(fails))


#: A fault for each rule that a file as a whole, or a file beside it, can break.
FAULTS = {
    "V01": {"matches": None}, "V02": {"matches": ""}, "V03": {"matches": _GOOD.replace("source1_entity_id\t", "source1_entity_id,")},
    "V04": {"matches": _GOOD.replace("matched_entity_ids", "ids")}, "V05": {"matches": _GOOD.replace("S1-2\t\n", "S1-2 S2-1\n")},
    "V13": {"source1": None}, "V14": {"check_ids": False}, "V15": {"candidates": None}, "V17": {"source3": None},
    "V18": {"matches": _GOOD.encode() + b"S1-4\t\xff\xfe\n"}, "V19": {},
}


@query("""SELECT * FROM (VALUES ('V01', 'V01', 'error', 1::BIGINT, false), ('V02', 'V02', 'error', 1, false), ('V03', 'V03', 'error', 1, false), ('V04', 'V04', 'error', 1, false),
  ('V05', 'V05', 'error', 1, false), ('V05', 'V11', 'error', 1, false), ('V13', 'V13', 'error', 1, false), ('V14', 'V14', 'warning', 1, true), ('V15', 'V15', 'warning', 1, true),
  ('V17', 'V17', 'warning', 1, true), ('V18', 'V18', 'error', 1, false), ('V19', '-', '-', 0, true)) AS v(fault, rule, severity, n_offenders, passes)""")
def submission_findings(t):
    """Findings of a good submission with one fault at a time, and whether it passes."""
    spark, out = t["customer"].sparkSession, None
    sources = {"source1": "entity_id\tn\nS1-1\ta\nS1-2\ta\nS1-3\ta\n", "source2": "entity_id\nS2-1\nS2-2\n", "source3": "entity_id\nS3-1\n"}
    plain = {"matches": _GOOD, "candidates": _GOOD.replace("matched", "candidate"), **sources}
    at = {name: _file(spark, name, content) for name, content in plain.items()}
    for fault, change in FAULTS.items():
        paths = at | {n: f"{at[n]}-none" if c is None else _file(spark, n, c) for n, c in change.items() if n in at}
        found = V.validate(spark, paths["matches"], paths["candidates"], paths["source1"], [paths["source2"], paths["source3"]], change.get("check_ids", True))
        one = found.select(F.lit(fault).alias("fault"), "rule", "severity", "n_offenders")
        out = one if out is None else out.unionByName(one)
    every = spark.createDataFrame([(f,) for f in FAULTS], "fault string")
    verdict = out.groupBy("fault").agg(F.count(F.when(F.col("severity") == "error", 1)).alias("errors"))
    joined = every.join(out, "fault", "left").join(verdict, "fault", "left")
    return joined.select("fault", F.coalesce("rule", F.lit("-")).alias("rule"), F.coalesce("severity", F.lit("-")).alias("severity"), F.coalesce("n_offenders", F.lit(0)).cast("bigint").alias("n_offenders"), (F.coalesce("errors", F.lit(0)) == 0).alias("passes"))


def _folder(t) -> str:
    """The derived tables as a data folder."""
    spark = t["customer"].sparkSession
    folder = shared_folder(spark, "data")
    for name, df in (*((f"source{n}", t[f"er_source{n}"]) for n in (1, 2, 3)), ("truth", t["er_truth"])):
        df.write.option("sep", "\t").option("header", True).option("quote", "\u0000").option("emptyValue", "").option("nullValue", "").csv(f"{folder}/{name}.tsv")
    return folder


_SECTIONS = [f"Source {n}{part}" for n in (1, 2, 3) for part in ("", ": missing", ": business_name", ": business_name outside ASCII", ": business_address", ": business_address outside ASCII", ": country", ": records")]
_SECTIONS += ["Matches", "Matches: histogram", "Singletons", "Noise of true pairs", "F0.5 at precision and recall"]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}')" for s in _SECTIONS) + ") AS v(section)")
def report_sections(t):
    """The profile, written as a file and read again."""
    spark = t["customer"].sparkSession
    out = shared_folder(spark, "report")
    runs.report(spark, _folder(t), out=out)
    return spark.read.text(out).where("value LIKE '## %'").select(F.substring("value", 4, 1000).alias("section"))


@query("SELECT (SELECT count(*) FROM er_source1) AS n_rows, 'V14' AS rules, true AS subset")
def run_from_files(t):
    """A run from files to findings: candidates, a small model, matches, validation."""
    spark = t["customer"].sparkSession
    folder, out = _folder(t), shared_folder(spark, "run")
    found = runs.run(spark, out, folder, folder, k=5, neg_ratio=1, trees=2, depth=2)
    rules = found.agg(F.array_join(F.sort_array(F.collect_set("rule")), ",").alias("rules"))
    rows = tables.read_tsv(spark, f"{out}/{runs.MATCHES}").agg(F.count("*").alias("n_rows"))
    pairs = [tables.read_lists(spark, f"{out}/{name}") for name in (runs.MATCHES, runs.CANDIDATES)]
    outside = pairs[0].join(pairs[1], ["s1_id", "cand_id"], "left_anti").agg((F.count("*") == 0).alias("subset"))
    return rows.crossJoin(rules).crossJoin(outside)  # one row each
