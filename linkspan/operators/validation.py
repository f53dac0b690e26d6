"""Checks of result files, each a frame of findings.

A finding is (rule, severity, n_offenders, examples): examples are the five first
offenders in order. Rules keep the numbers V01 to V18 of the survey.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspan.functions import text as T
from linkspan.sources import tables

SHOWN = 5
_FINDING = "rule string, severity string, n_offenders bigint, examples string"


def parse_rows(lines: DataFrame) -> DataFrame:
    """line_no, s1_id, ids (strict) and has_tab of the lines below the header; blank lines go."""
    rows = lines.where((F.col("line_no") > 1) & ((F.trim("value") != "") | F.col("value").contains("\t")))
    parts = F.split("value", "\t", 2)
    rest = F.coalesce(F.get(parts, 1), F.lit(""))
    return rows.select("line_no", F.col("value").contains("\t").alias("has_tab"), F.trim(F.get(parts, 0)).alias("s1_id"), F.when(F.trim(rest) == "", F.array().cast("array<string>")).otherwise(T.parse_ids_strict(rest)).alias("ids"))


def finding(rule: str, severity: str, offenders: DataFrame) -> DataFrame:
    """One row if there are offenders (a frame of one column), none otherwise."""
    column = offenders.columns[0]
    distinct = offenders.select(F.col(column).cast("string").alias("x")).distinct()
    first = distinct.orderBy("x").limit(SHOWN).agg(F.array_join(F.sort_array(F.collect_list("x")), ", ").alias("examples"))
    counted = distinct.agg(F.count("*").alias("n_offenders")).crossJoin(first)  # one row each
    return counted.where("n_offenders > 0").select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n_offenders", "examples")


def duplicate_rows(rows):
    return rows.groupBy("s1_id").count().where("count > 1").select("s1_id")


def repeated_in_list(rows):
    return rows.where(F.size("ids") != F.size(F.array_distinct("ids"))).select("s1_id")


def listed(rows):
    return rows.select("s1_id", F.explode("ids").alias("id"))


def id_class(column):
    """self, wrong or target: one class for each identifier."""
    return F.when(column.startswith("S1-"), "self").when(~(column.startswith("S2-") | column.startswith("S3-")), "wrong").otherwise("target")


def not_in(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    return left.select(column).distinct().join(right.select(F.col(right.columns[0]).alias(column)), column, "left_anti")


def list_findings(rows: DataFrame, required: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """V05 to V12 on parsed rows; targets (one column) turns V10 on.

    One pass: every row, required entity and target becomes (space, value, what); the
    counts of what meets at a value tell its offences, and these are grouped by rule."""
    def fact(space, value, what):
        return F.struct(F.lit(space).alias("space"), value.cast("string").alias("value"), F.lit(what).alias("what"))

    own = F.col("s1_id")
    lists = F.transform("ids", lambda i: F.struct(F.lit("id").alias("space"), i.alias("value"), id_class(i).alias("what")))
    repeats = F.when(F.size("ids") != F.size(F.array_distinct("ids")), F.array(fact("s1", own, "repeats"))).otherwise(F.array().cast("array<struct<space:string,value:string,what:string>>"))
    good = F.concat(F.array(fact("s1", own, "row")), repeats, lists)
    facts = rows.select(F.explode(F.when(F.col("has_tab"), good).otherwise(F.array(fact("line", F.col("line_no"), "no tab")))).alias("f")).select("f.*")
    facts = facts.unionByName(required.select(F.explode(F.array(fact("s1", F.col(required.columns[0]), "required"))).alias("f")).select("f.*"))
    if targets is not None:
        facts = facts.unionByName(targets.select(F.explode(F.array(fact("id", F.col(targets.columns[0]), "known"))).alias("f")).select("f.*"))
    kinds = ("no tab", "row", "repeats", "self", "wrong", "target", "required", "known")
    met = facts.where("value IS NOT NULL").groupBy("space", "value").agg(*(F.count(F.when(F.col("what") == k, 1)).alias(k) for k in kinds))
    has = lambda k: F.col(k) > 0
    rules = [
        ("V05", has("no tab")), ("V06", F.col("row") > 1), ("V07", has("repeats")), ("V08", has("self")), ("V09", has("wrong")),
        ("V11", has("required") & ~has("row")), ("V12", has("row") & ~has("required")),
    ]
    if targets is not None:
        rules.append(("V10", has("target") & ~has("known")))
    broken = F.filter(F.array(*(F.when(test, F.lit(rule)) for rule, test in rules)), lambda r: r.isNotNull())
    offenders = met.select(F.explode(broken).alias("rule"), "value")
    counted = offenders.groupBy("rule").agg(F.count("*").alias("n_offenders"))
    place = F.row_number().over(Window.partitionBy("rule").orderBy("value"))
    shown = offenders.withColumn("place", place).where(F.col("place") <= SHOWN).groupBy("rule")
    shown = shown.agg(F.array_join(F.sort_array(F.collect_list("value")), ", ").alias("examples"))
    return counted.join(shown, "rule").select("rule", F.lit("error").alias("severity"), "n_offenders", "examples")


def outside(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """s1_id of matches (s1_id, ids) that have an identifier their candidates lack."""
    pairs = listed(matches).join(listed(candidates), ["s1_id", "id"], "left_anti")
    return pairs.select("s1_id").distinct()


def summary(rows: DataFrame) -> DataFrame:
    empty = F.size("ids") == 0
    return rows.agg(F.count("*").alias("n_rows"), F.count(F.when(empty, 1)).alias("n_empty"), F.count(F.when(~empty, 1)).alias("n_with_matches"))


def _one(spark: SparkSession, rule: str, severity: str, what: str) -> DataFrame:
    return spark.createDataFrame([(rule, severity, 1, what)], _FINDING)


def check_file(spark: SparkSession, path: str, header: list[str], required: DataFrame, targets: DataFrame | None = None):
    """(findings, parsed rows or None where the file can't be read as a list)."""
    if not tables.exists(spark, path):
        return _one(spark, "V01", "error", path), None
    lines = tables.read_lines(spark, path)
    first = lines.where("line_no = 1").select(F.make_valid_utf8("value").alias("value")).first()
    if first is None or not first.value.strip():
        return _one(spark, "V02", "error", path), None
    if not lines.where(~F.is_valid_utf8("value")).isEmpty():
        return _one(spark, "V18", "error", path), None
    if "\t" not in first.value and "," in first.value:
        return _one(spark, "V03", "error", first.value), None
    if [c.strip().lower() for c in first.value.rstrip("\r\n").split("\t")] != header:
        return _one(spark, "V04", "error", first.value), None
    if tables.is_folder(spark, path):  # every file of a written folder has the header
        lines = lines.where((F.col("line_no") == 1) | (F.col("value") != first.value))
    rows = parse_rows(lines)
    return list_findings(rows, required, targets), rows


def validate(spark: SparkSession, matching_path: str, candidate_path: str, source1_path: str, target_paths: list[str] = (), check_ids: bool = False) -> DataFrame:
    """All findings; a submission passes if none is an error."""
    if not tables.exists(spark, source1_path):
        return _one(spark, "V13", "error", source1_path)
    required = tables.read_ids(spark, source1_path)
    targets, missing = tables.read_targets(spark, list(target_paths)) if check_ids else (None, [])
    out, matches = check_file(spark, matching_path, ["source1_entity_id", "matched_entity_ids"], required, targets)
    for what in missing:
        out = out.unionByName(_one(spark, "V17", "warning", what))
    if not check_ids:
        out = out.unionByName(_one(spark, "V14", "warning", "identifiers are not checked against the target files"))
    if not tables.exists(spark, candidate_path):
        return out.unionByName(_one(spark, "V15", "warning", candidate_path))
    found, candidates = check_file(spark, candidate_path, ["source1_entity_id", "candidate_entity_ids"], required, targets)
    out = out.unionByName(found)
    if matches is not None and candidates is not None:
        out = out.unionByName(finding("V16", "warning", outside(matches, candidates)))
    return out


def passes(findings: DataFrame) -> bool:
    return findings.where("severity = 'error'").isEmpty()
