"""Language identification by Bayesian evidence fusion.

posterior(l) is in proportion to P(text | l) * P(declared | l) * P(suffix | l) * prior(l | host). The text model is naive
Bayes over hashed byte trigrams, fitted on a bounded sample of labelled rows. All else is grouped aggregation over all rows:
the markup's declared language and the address suffix get their likelihoods from how often they meet each language that the
text model finds; a host's prior is smoothed towards its suffix's, and that towards the whole table's. "und" stands for
text that no language of the model explains better than trigrams at random, and for text without letters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, give_back, small, values, whole, written

BUCKETS = 1 << 14
UNKNOWN = "und"
#: Parameters: rows of the training sample (expected); weight of a trigram (three overlap in each byte); pseudo-counts of the
#: smoothing towards the parent, and of the likelihoods of declared values.
SAMPLE_ROWS, TEMPER, TOWARDS_PARENT, PSEUDO = 8_000, 1 / 3, 20.0, 1.0


def trigrams(text: str | None) -> Iterator[np.ndarray]:
    """The hashed byte trigrams of a text in lower case, runs of all but letters as one blank, in blocks that bound the memory."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf8", "replace"), np.uint8) if text else np.empty(0, np.uint8)
    raw = _FOLD[raw]
    if not len(raw) or (raw == 32).all():
        return
    raw = raw[(raw != 32) | np.concatenate([[True], raw[:-1] != 32])]
    for i in range(0, len(raw) - 2, _BLOCK):
        x = raw[i : i + _BLOCK + 2].astype(np.uint32)
        yield ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761) >> np.uint32(18)).astype(np.int32)


_BLOCK = 1 << 16
#: Texts of each label that are expected in the sample at least, if the label has so many; the range of their hashes.
LEAST_TEXTS, HASHES = 20, 1 << 40
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


@dataclass(frozen=True)
class TextModel:
    """log_p[bucket, language]; the last language is UNKNOWN."""

    languages: list[str]
    log_p: np.ndarray

    def score(self, texts: Iterable[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihoods (text, language) and the numbers of trigrams."""
        out, sizes = np.zeros((n, len(self.languages))), np.zeros(n, np.int64)
        for k, text in enumerate(texts):
            for codes in trigrams(text):
                out[k] += self.log_p[codes].sum(axis=0, dtype=np.float64)
                sizes[k] += len(codes)
        return out * TEMPER, sizes


def quota(sizes: Iterable[int], rows: int) -> float:
    """How many of each label are at most taken so that they are about so many rows in all."""
    left, most = float(rows), 0.0
    for k, n in enumerate(ordered := sorted(sizes)):
        most = left / (len(ordered) - k)
        if n > most:
            return most
        left -= n
    return float(max(ordered, default=0))


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", rows: int = SAMPLE_ROWS) -> TextModel:
    """Fits on about so many distinct labelled texts with letters, shared out evenly among the labels; all of smaller tables.

    Of each label the texts with the least hashes are taken, LEAST_TEXTS or more where it has them, so that each label is trained
    at every size; copies count once. Only the number of texts of each label and the sums by language and bucket come to the
    driver: BUCKETS rows a language at most.
    """
    labelled = labelled.where(F.col(label).isNotNull() & (F.col(label) != UNKNOWN)).select(F.col(label).alias("label"), F.col(text).alias("text"))
    labelled = labelled.where(F.col("text").rlike(r"[A-Za-z]|[^\x00-\x7f]")).withColumn("key", F.xxhash64("text"))
    sizes = {r["label"]: r["n"] for r in labelled.select("label", "key").distinct().groupBy("label").agg(F.count("*").alias("n")).collect()}
    most = max(quota(sizes.values(), rows), LEAST_TEXTS)
    cuts = [(name, int(min(1.0, most / n) * HASHES)) for name, n in sizes.items()]
    cuts = F.broadcast(labelled.sparkSession.createDataFrame(cuts, "label string, cut long"))
    taken = labelled.join(cuts, "label").where(F.pmod("key", F.lit(HASHES)) < F.col("cut"))
    labelled = taken.groupBy("label", "key").agg(F.first("text").alias("text")).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(values(batch.column(0)), values(batch.column(1)), strict=True):
                own = total.setdefault(name, np.zeros(BUCKETS, np.int64))
                for codes in trigrams(text):
                    own += np.bincount(codes, minlength=BUCKETS)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["label", "bucket", "n"])

    sums = labelled.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["label"].unique())
    n = np.zeros((BUCKETS, len(languages)))
    n[sums["bucket"], [languages.index(x) for x in sums["label"]]] = sums["n"]
    alpha = 0.05
    log_p = np.log((n + alpha) / (n.sum(axis=0) + alpha * BUCKETS))
    return TextModel([*languages, UNKNOWN], np.column_stack([log_p, np.full(BUCKETS, -np.log(BUCKETS))]).astype(np.float32))


def primary(col: Column) -> Column:
    """A language tag's first subtag in lower case; what isn't one, or is missing, is ''."""
    return F.regexp_extract(F.lower(F.coalesce(col, F.lit(""))), r"^\s*([a-z]{2,3})(?:[-_].*)?\s*$", 1)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def suffix_of(host: Column) -> Column:
    return F.when(host.contains("."), F.regexp_extract(host, r"([^.]+)\.?$", 1)).otherwise(F.lit(""))


def _likelihood(counts: DataFrame, col: str, n_languages: int, out: str) -> DataFrame:
    """col, and log P(value | language) as an array; languages by number."""
    values = counts.groupBy(col).agg(*(F.sum(F.when(F.col("found") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(n_languages)))
    first = values.agg(F.count("*").alias("kinds"), *(F.sum(f"n{k}").alias(f"t{k}") for k in range(n_languages))).first()
    totals = [(first[f"t{k}"] or 0) + PSEUDO * (first["kinds"] + 1) for k in range(n_languages)]
    return values.select(col, F.array(*(F.log((F.col(f"n{k}") + PSEUDO) / F.lit(totals[k])) for k in range(n_languages))).alias(out))


def _priors(counts: DataFrame, n_languages: int) -> tuple[DataFrame, list[float]]:
    """host, suffix, log priors; and the whole table's priors."""
    sums = [F.sum(F.when(F.col("found") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(n_languages)]
    first = counts.agg(*sums).first()
    top = [(first[f"n{k}"] or 0) + 1.0 for k in range(n_languages)]
    top = [x / sum(top) for x in top]
    each = range(n_languages)

    def smoothed(df: DataFrame, parent: list[Column]) -> Column:
        total = sum((F.col(f"n{k}") for k in each), F.lit(0))
        return F.array(*((F.col(f"n{k}") + TOWARDS_PARENT * parent[k]) / (total + TOWARDS_PARENT) for k in each))

    by_suffix = counts.groupBy("suffix").agg(*sums)
    by_suffix = by_suffix.select("suffix", smoothed(by_suffix, [F.lit(x) for x in top]).alias("parent"))
    by_host = counts.groupBy("host", "suffix").agg(*sums).join(small(by_suffix), "suffix")
    by_host = by_host.select("host", smoothed(by_host, [F.col("parent")[k] for k in each]).alias("prior"))
    return by_host.select("host", F.transform("prior", lambda x: F.log(x)).alias("prior")), top


def identify(df: DataFrame, text: str = "text", declared: str | Column | None = "lang", host: str | Column | None = "source", model: TextModel | None = None) -> DataFrame:
    """df with lang_found, lang_text (by the text alone), lang_confidence (the posterior) and lang_known (found isn't UNKNOWN).

    declared: the language that the markup states, a column or expression; host: the address's host, or another source name.
    Null and empty texts, and texts without letters, get UNKNOWN. Missing declarations and hosts count as the value ''. An
    empty table gives an empty table; repeated rows count each. Texts of any length are read whole. Ties go to the language that
    is first by name. Columns of the new names stay; the new ones are then named by fresh(). Without a model, one is fitted on df's own rows with a declared language. Rows aren't
    joined with each other: only tables of one row a host or a declared value are joined, and broadcast only if small.
    """
    bounded_batches(df.sparkSession)
    col = lambda c: F.lit(None).cast("string") if c is None else F.col(c) if isinstance(c, str) else c
    names = {k: fresh(df, f"_lang_{k}") for k in ("declared", "host", "suffix", "score", "found", "posterior")}
    rows = df.withColumn(names["declared"], primary(col(declared))).withColumn(names["host"], F.lower(F.coalesce(col(host), F.lit(""))))
    rows = rows.withColumn(names["suffix"], suffix_of(F.col(names["host"])))
    if model is None:
        model = fit(rows.where(F.col(names["declared"]) != ""), text, names["declared"])
    n = len(model.languages)
    held = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            logs, sizes = held.value.score(values(texts), len(texts))
            ends = np.arange(0, logs.size + 1, logs.shape[1], dtype=np.int32)
            columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(logs.reshape(-1))), pa.array(np.where(sizes > 0, logs.argmax(axis=1), n - 1), pa.int32()), pa.array(sizes, pa.int64())]
            yield pa.StructArray.from_arrays(columns, ["logs", "best", "size"])
        give_back()

    scored = rows.withColumn(names["score"], F.arrow_udf(score, "struct<logs:array<double>,best:int,size:long>")(F.col(text)))
    score_col = F.col(names["score"])
    counts = written(scored.groupBy(F.col(names["declared"]).alias("declared"), F.col(names["host"]).alias("host"), F.col(names["suffix"]).alias("suffix"), score_col["best"].alias("found")).agg(F.count("*").alias("n")))
    priors, top = _priors(counts, n)
    out = scored
    for key, side in (("declared", _likelihood(counts, "declared", n, "says")), ("suffix", _likelihood(counts, "suffix", n, "says")), ("host", priors)):
        own, logs = fresh(out, f"_key_{key}"), fresh(out, f"_logs_{key}")
        names[f"logs_{key}"] = logs
        side = small(written(side.toDF(own, logs)))
        out = out.join(side, F.col(names[key]) == F.col(own), "left").drop(own)
    zero = F.array(*[F.lit(0.0)] * n)
    parts = [score_col["logs"], *(F.coalesce(F.col(names[f"logs_{k}"]), zero) for k in ("declared", "suffix", "host"))]
    total = F.array(*(sum((p[k] for p in parts[1:]), parts[0][k]) for k in range(n)))
    languages = F.array(*map(F.lit, model.languages))
    out = out.withColumn(names["posterior"], total)
    best = F.array_max(names["posterior"])
    number = F.array_position(names["posterior"], best).cast("int")
    silent = score_col["size"] == 0
    found = F.when(silent, UNKNOWN).otherwise(F.element_at(languages, number))
    by_text = F.when(silent, UNKNOWN).otherwise(F.element_at(languages, score_col["best"] + 1))
    odds = F.aggregate(names["posterior"], F.lit(0.0), lambda acc, x: acc + F.exp(x - best))
    result = {"lang_found": found, "lang_text": by_text, "lang_confidence": F.when(silent, 0.0).otherwise(F.round(1 / odds, 6)), "lang_known": found != UNKNOWN}
    return out.select(*df.columns, *(c.alias(fresh(df, k)) for k, c in result.items()))


def language_digest(documents: DataFrame) -> DataFrame:
    return identify(documents.select("doc_id", "text", "lang", "source")).select("doc_id", F.col("lang").alias("lang_declared"), "lang_found", "lang_text", "lang_confidence", "lang_known")


def page_languages(pages: DataFrame) -> DataFrame:
    """The same for web pages: declared by the html element, suffix and host from the address, text without tags."""
    declared = F.regexp_extract(whole("html"), r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z_-]+)""", 1)
    text = F.regexp_replace(F.regexp_replace(whole("html"), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    rows = pages.select("page_id", declared.alias("declared"), host_of(F.col("url")).alias("host"), text.alias("text"))
    return identify(rows, declared="declared", host="host").select("page_id", "host", F.col("declared").alias("lang_declared"), "lang_found", "lang_text", "lang_confidence")
