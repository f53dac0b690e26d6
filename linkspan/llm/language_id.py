"""Language ID by multilingual mixture inference.

A language is a distribution over hashed character trigrams of lower-cased text
(letters only, anything else is a blank), counted over all labelled training
documents. A document is a mixture of languages: expectation-maximisation finds
its proportions, and the set of languages grows by the one that raises the
likelihood most, as long as the gain exceeds a penalty for each further language
(half the logarithm of the number of trigrams, times the trigrams' overlap).

The prediction is the language with the largest proportion. Its score is that
proportion times the posterior of the language among the single-language models
on overlap-corrected counts, so texts of a few letters score lower.

Edge cases: of languages with the same likelihood or proportion the first by name
leads; texts of any length are counted whole; null text and text without a letter are `und` with score 0, as is
every text if nothing was learned; rows without a language teach nothing;
repeated rows count as often as they occur; an empty table gives no rows; extra
columns are ignored by `predict` and kept by `identified`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import releasing, ship, table

UND = "und"
BUCKETS = 1 << 14
OVERLAP = 3
EM_STEPS = 100
#: A further language must take this share at least.
LEAST_SHARE = 0.02
#: Characters of a text that are turned into trigrams at a time.
STRETCH = 1 << 18
MIN_SHARE = 0.5

_LETTERS = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(c).isalpha() for c in range(0x3400)], dtype=bool)
    return _LETTERS


def trigram_counts(text: str) -> np.ndarray | None:
    """Counts by bucket; None if the text has no letter."""
    counts, seen, letters = None, False, _letters()
    for at in range(0, len(text), STRETCH):
        part = " " * (at == 0) + text[max(0, at - 2) : at + STRETCH].lower() + " " * (at + STRETCH >= len(text))
        codes = np.frombuffer(part.encode("utf-32-le", "replace"), dtype="<u4")
        small = codes < len(letters)
        alpha = np.where(small, letters[np.where(small, codes, 0)], True)
        if not small.all():
            alpha[~small] = [chr(c).isalpha() for c in codes[~small]]
        seen |= bool(alpha.any())
        c = np.where(alpha, codes, 32).astype(np.uint32)
        if len(c) < 3:
            continue
        h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        h = h[alpha[:-2] | alpha[1:-1] | alpha[2:]] >> np.uint32(32 - BUCKETS.bit_length() + 1)
        new = np.bincount(h, minlength=BUCKETS)
        counts = new if counts is None else counts + new
    return counts if seen else None


def _count_rows(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            counts = trigram_counts(text)
            if counts is not None:
                sums[lang] = counts + sums.get(lang, 0)
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["lang", "bucket", "n"])


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: one row of BUCKETS counts for each language."""
        self.languages = languages
        smooth = counts + 0.5
        self.p = (smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float64) if len(languages) else counts
        self.log = np.log(self.p) if len(languages) else counts

    def mixture(self, counts: np.ndarray) -> tuple[dict[str, float], float]:
        """Proportions of the chosen languages, and the leading one's posterior."""
        at = np.flatnonzero(counts)
        c = counts[at].astype(np.float64)
        n = c.sum()
        alone = self.log[:, at] @ c
        lead = int(alone.argmax())
        posterior = float(1 / np.exp((alone - alone[lead]) / OVERLAP).sum())
        chosen, share, best = [lead], np.ones(1), alone[lead]
        penalty = 0.5 * OVERLAP * np.log(n + 1) + OVERLAP
        while len(chosen) < len(self.languages):
            tries = []
            for k in range(len(self.languages)):
                if k not in chosen:
                    rows = self.p[np.ix_([*chosen, k], at)]
                    tries.append((*_em(rows, c, n, share), k))
            value, shares, k = max(tries, key=lambda t: t[0])
            if value - best <= penalty or shares[-1] < LEAST_SHARE:
                break
            chosen, share, best = [*chosen, k], shares, value
        return {self.languages[k]: float(s) for k, s in zip(chosen, share)}, posterior


def _em(rows: np.ndarray, c: np.ndarray, n: float, share: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood and proportions; the new language starts at a tenth."""
    pi = np.append(share * 0.9, 0.1)
    for _ in range(EM_STEPS):
        mixed = pi @ rows
        new = pi * (rows @ (c / mixed)) / n
        done = abs(new - pi).max() < 1e-4
        pi = new
        if done or pi[-1] < LEAST_SHARE / 4:
            break
    return float(np.log(pi @ rows) @ c), pi


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all rows with a language; the driver holds BUCKETS numbers a language."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    counted = rows.mapInArrow(releasing(_count_rows), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    for k, lang in enumerate(languages):
        mine = counted[counted["lang"] == lang]
        counts[k, mine["bucket"].to_numpy()] = mine["n"].to_numpy()
    return Model(languages, counts)


_SCHEMA = "lang_pred string, score double, languages array<string>, proportions array<double>"


def predict(docs: DataFrame, model: Model, text_col: str | None = "text", keep: tuple[str, ...] = ("doc_id",), inside: str | None = None) -> DataFrame:
    """The columns `keep` of every row with lang_pred, score, languages, proportions.
    The text is in text_col, or is the field `inside` of the struct that is kept first.
    The model (BUCKETS numbers for each language) is sent once for each executor."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.p))

    def run(batches):
        languages, p = shared.value
        model = Model.__new__(Model)
        model.languages, model.p, model.log = languages, p, np.log(p) if len(languages) else p
        for batch in batches:
            out = []
            texts = batch.column("_text") if inside is None else batch.column(0).field(inside)
            for text in texts.to_pylist():
                counts = trigram_counts(text) if text and languages else None
                if counts is None:
                    out.append((UND, 0.0, [], []))
                    continue
                shares, posterior = model.mixture(counts)
                order = sorted(shares.items(), key=lambda x: (-x[1], x[0]))
                out.append((order[0][0], min(1.0, order[0][1]) * posterior, [k for k, _ in order], [v for _, v in order]))
            columns = list(zip(*out)) if out else [()] * 4
            kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
            arrays = [batch.column(k) for k in range(len(keep))] + [pa.array(x, t) for x, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[: len(keep)], "lang_pred", "score", "languages", "proportions"])

    text = [F.col(text_col).cast("string").alias("_text")] if inside is None else []
    own = docs.select(*keep, *text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[: len(keep)])
    return own.mapInArrow(releasing(run), f"{schema}, {_SCHEMA}" if keep else _SCHEMA)


def identified(docs: DataFrame, model: Model, text_col: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of docs, columns unchanged, whose leading language has min_share at
    least; undetermined texts go."""
    if dict(docs.dtypes)[text_col] == "string":  # the text goes to Python once, in the row
        found = predict(docs.select(F.struct("*").alias("_doc")), model, None, ("_doc",), text_col)
    else:
        found = predict(docs.select(F.struct("*").alias("_doc"), F.col(text_col).alias("_own_text")), model, "_own_text", ("_doc",))
    return found.where((F.col("lang_pred") != UND) & (F.col("proportions")[0] >= min_share)).select(*(F.col(f"_doc.`{c}`") for c in docs.columns))


def held_out(id_col: str = "doc_id"):
    """Whether the checksum of the identifier's digits leaves 1 (a null identifier: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learned from two thirds of the documents, predicted for all."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    return predict(docs, train(docs.where("NOT held_out")), keep=("doc_id", "held_out"))


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
