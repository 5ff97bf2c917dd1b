"""Mixing sources to target weights: domain posteriors and projected-gradient least squares for document rates.

Documents without a source get posteriors over the sources from a softmax classifier fitted on labelled rows; those with
one belong to it wholly. The rates of all documents then descend the squared relative error between expected and wanted
tokens per source, each step followed by the projection of every rate onto [0, its cap]. A step moves a document's rate
by its posterior times one gradient vector a source (rates are measured in the metric of their tokens, in which a step
of 1 cannot overshoot), so a rate is replayed from the few gradients so far wherever it is needed: no rates are stored,
and a step is one aggregation over the documents. Rates become whole copies by a threshold on a hash, set from a
histogram so that each source's tokens come out as wanted.
"""

from __future__ import annotations

import os
import warnings
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clausemill.llm.markup_text import letters_of
from clausemill.llm.p10_repetition import sample_edge
from clausemill.session import materialise, read, read_wide

#: Vocabulary file of a public tokenizer; sizes are counted in its tokens. It is shipped with the job.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: At most about so many labelled documents fit the classifier, taken by a hash of doc_id.
FIT_ROWS = 4000
FEATURES, STEPS, BUCKETS = 1024, 150, 4096
#: Most gradient steps, and the largest relative error of a source at which they end; more is reported as not converged.
ROUNDS, CLOSE = 60, 1e-3
#: A target counts as missed beyond this relative difference.
TOLERANCE = 0.02
#: Sources that a document without one may belong to, from this posterior: the least of their repeats binds it.
LIKELY = 0.1
#: Most sources of a mixture: posteriors are dense, 2 KB a document without source at this number. More are refused.
MOST_SOURCES = 256


def source_key(source: Column) -> Column:
    """One spelling of a source name; null for null or blank."""
    key = F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")
    return F.when(key != "", key)


def bigram_features(texts: list[str]) -> np.ndarray:
    """Hashed pairs of neighbouring letters of whole texts, as root shares."""
    codes, bounds = letters_of(texts)
    out = np.zeros((len(texts), FEATURES), np.float32)
    if len(codes) > 1:
        with np.errstate(over="ignore"):
            slot = ((codes[:-1] * np.uint32(2654435761) + codes[1:]) * np.uint32(2246822519) >> np.uint32(16)) % FEATURES
        owner = np.searchsorted(bounds, np.arange(len(slot)), side="right") - 1
        inside = np.arange(1, len(codes)) < bounds[owner + 1]
        counts = np.bincount(owner[inside] * FEATURES + slot[inside].astype(np.int64), minlength=out.size).reshape(out.shape)
        out = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)
    return out


def posteriors(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Class probabilities of feature rows; the last row of the weights is the bias."""
    z = x @ weights[:-1] + weights[-1]
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fit_classifier(x: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
    """Softmax regression by gradient descent with momentum; without rows all classes are alike."""
    weights = np.zeros((FEATURES + 1, classes), np.float32)
    if not len(y):
        return weights
    weights[-1] = np.log(np.bincount(y, minlength=classes) + 0.5)
    target = np.eye(classes, dtype=np.float32)[y]
    speed = np.zeros_like(weights)
    for _ in range(STEPS):
        error = (posteriors(x, weights) - target) / len(y)
        gradient = np.vstack([x.T @ error, error.sum(0, keepdims=True)]) + 1e-4 * weights
        speed = 0.9 * speed - 2.0 * gradient
        weights = weights + speed
    return weights


@cache
def _tokenizer(path: str):
    import sentencepiece

    shipped = SparkFiles.get(os.path.basename(path))
    return sentencepiece.SentencePieceProcessor(model_file=shipped if os.path.exists(shipped) else path)


def sized_documents(documents: DataFrame, sources: list[str], repeats: np.ndarray, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, text, source) -> doc_id, source, tokens, posterior and cap (both null for documents with a source)."""
    context = documents.sparkSession.sparkContext
    context.addFile(path)
    keyed = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), source_key(F.col("source")).alias("source"))
    labelled = keyed.filter(F.col("source").isin(sources))
    number = {s: k for k, s in enumerate(sources)}
    sample = labelled.filter(F.xxhash64("doc_id") <= sample_edge(labelled.select("source").count(), FIT_ROWS))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = bigram_features(list(batch["text"]))
            yield pd.DataFrame({"source": batch["source"], "x": list(x)})

    rows = sample.mapInPandas(features, "source string, x array<float>").toPandas()
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, FEATURES), np.float32)
    weights = fit_classifier(x, rows["source"].map(number).to_numpy(int) if len(rows) else np.zeros(0, int), len(sources))
    shared = context.broadcast((weights, repeats))

    def size(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _tokenizer(path)
        weights, repeats = shared.value
        for batch in batches:
            texts = list(batch["text"])
            tokens = [len(ids) for ids in model.encode(texts, num_threads=1)]
            soft: list = [None] * len(texts)
            caps = np.full(len(texts), np.nan)
            at = np.flatnonzero(batch["source"].isna().to_numpy())
            if len(at) and len(repeats):
                p = posteriors(bigram_features([texts[j] for j in at]), weights).astype(float)
                likely = (p >= LIKELY) | (p >= p.max(1, keepdims=True))
                caps[at] = np.where(likely, repeats, np.inf).min(1)
                for k, row in zip(at, p):
                    soft[k] = row
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": tokens, "posterior": soft, "cap": caps})

    return keyed.mapInPandas(size, "doc_id bigint, source string, tokens bigint, posterior array<double>, cap double")


def replayed(p: np.ndarray, cap: np.ndarray, gradients: list[np.ndarray]) -> np.ndarray:
    """Rates of documents after these steps, from rate 0: each one is projected onto [0, cap]."""
    rate = np.zeros(len(p))
    for step in (p @ np.array(gradients).T).T if gradients else ():
        rate = np.clip(rate + step, 0, cap)
    return rate


def fit_rates(hard: np.ndarray, soft: DataFrame, targets: np.ndarray, repeats: np.ndarray) -> tuple[list[np.ndarray], float]:
    """The gradients of the steps taken, and the largest relative error of a source left at the end.

    hard: tokens of each source's own documents, which share one rate. soft: (posterior, cap, tokens) of those without
    source. The total aimed at is the largest at which every source that has documents can reach its share within its
    repeats.
    """
    k = len(targets)

    def totals(gradients: list[np.ndarray] | None) -> np.ndarray:
        """Expected tokens per source, each document counting by its rate, or once; partial sums by task, at most k rows here."""

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(k)
            for batch in batches:
                if len(batch):
                    p, cap = np.stack(batch["posterior"].to_numpy()), batch["cap"].to_numpy(float)
                    out += (batch["tokens"].to_numpy(float) * (1.0 if gradients is None else replayed(p, cap, gradients))) @ p
            yield pd.DataFrame({"j": np.arange(k), "part": out})

        sums = soft.mapInPandas(partial, "j int, part double").groupBy("j").agg(F.sum("part").alias("part")).collect()
        own = hard * (1.0 if gradients is None else replayed(np.eye(k), repeats, gradients))
        for r in sums:
            own[r.j] += r.part
        return own

    reachable = (hard > 0) & (targets > 0)
    if not reachable.any():
        return [], 0.0
    mass = np.maximum(totals(None), 1)
    share = np.where(reachable, targets, 0) / targets[reachable].sum()
    total = float((repeats[reachable] * hard[reachable] / share[reachable]).min())
    wanted = share * total
    gradients = [np.where(reachable, wanted / mass, 0)]
    for _ in range(ROUNDS):
        off = np.where(reachable, wanted - totals(gradients), 0)
        error = float((np.abs(off)[reachable] / np.maximum(wanted[reachable], 1)).max())
        if error <= CLOSE:
            break
        gradients.append(off / mass)
    else:
        warnings.warn(f"rates not converged after {ROUNDS} steps: a source is off by {error:.4f} of its target", stacklevel=2)
    return gradients, error


def mix(documents: DataFrame, mixture: DataFrame, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The selection (doc_id, source, tokens, copies) and the report by source.

    Documents of sources without a target aren't selected; empty texts have no tokens and are never needed. Sources with
    a target but no documents, and those out of reach, are reported as missed; fit_error is the largest relative error
    that the rates were left with, over CLOSE where they didn't converge. The mixture table is collected: it has one row
    a source and is refused beyond MOST_SOURCES.
    """
    rows = mixture.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeat").filter("source is not null").orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sources = [r.source for r in rows]
    targets = np.array([r.target_share or 0.0 for r in rows])
    repeats = np.array([float(r.max_repeat if r.max_repeat is not None else 1) for r in rows])
    k = len(sources)
    sized = materialise(sized_documents(documents, sources, repeats, path))  # tokenised once; counts only, no texts
    bucket = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("mix")), F.lit(BUCKETS)).cast("int")
    known = sized.filter(F.col("source").isin(sources)).select("doc_id", "source", "tokens", bucket.alias("bucket"))
    histogram = known.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens"))  # BUCKETS rows a source
    own = {r.source: float(r.tokens) for r in histogram.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    soft = materialise(sized.filter("source is null and posterior is not null").select("doc_id", "posterior", "cap", "tokens"))
    gradients, error = fit_rates(np.array([own.get(s, 0.0) for s in sources]), soft, targets, repeats) if k else ([], 0.0)

    # Whole copies: all get the rate's whole part, and those under the threshold one more.
    spark = sized.sparkSession
    fitted = replayed(np.eye(k), repeats, gradients) if k else np.zeros(0)
    plan = spark.createDataFrame([(s, int(r), float(r - int(r)) * own.get(s, 0.0)) for s, r in zip(sources, fitted)], "source string, base int, need double")
    running = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))
    edges = histogram.withColumn("running", running).join(F.broadcast(plan), "source")
    nearest = F.min(F.struct(F.abs(F.col("running") - F.col("need")).alias("miss"), (F.col("bucket") + 1).alias("edge")))
    edges = edges.groupBy("source", "base").agg(F.least(nearest, F.struct(F.first("need").alias("miss"), F.lit(0).alias("edge")))["edge"].alias("edge"))
    copies = F.col("base") + (F.col("bucket") < F.col("edge")).cast("int")
    chosen = known.join(F.broadcast(edges), "source").select("doc_id", "source", "tokens", copies.alias("copies"))

    def rated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = np.stack(batch["posterior"].to_numpy()) if len(batch) else np.zeros((0, k))
            yield batch.assign(rate=replayed(p, batch["cap"].to_numpy(float), gradients))

    unknown = soft.mapInPandas(rated, "doc_id bigint, posterior array<double>, cap double, tokens bigint, rate double").withColumn("bucket", bucket)
    extra = (F.col("bucket") < (F.col("rate") - F.floor("rate")) * BUCKETS).cast("int")
    guessed = unknown.select("doc_id", F.lit(None).cast("string").alias("source"), "tokens", (F.floor("rate").cast("int") + extra).alias("copies"), "posterior")
    selection = chosen.unionByName(guessed.drop("posterior")).filter("copies > 0")

    reached = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).cast("double").alias("selected"), F.sum("tokens").cast("double").alias("available"))
    expected = guessed.select(F.posexplode("posterior").alias("j", "p"), "tokens", "copies")
    names = spark.createDataFrame([(j, s, float(t), float(r)) for j, (s, t, r) in enumerate(zip(sources, targets, repeats))], "j int, source string, target_share double, max_repeat double")
    expected = expected.groupBy("j").agg(F.sum(F.col("p") * F.col("tokens") * F.col("copies")).alias("more"))
    report = names.join(reached, "source", "left").join(expected, "j", "left")
    report = report.withColumn("selected_tokens", F.coalesce("selected", F.lit(0.0)) + F.coalesce("more", F.lit(0.0)))
    report = report.crossJoin(F.broadcast(report.agg(F.sum("selected_tokens").alias("all_tokens"))))
    actual = F.when(F.col("all_tokens") > 0, F.col("selected_tokens") / F.col("all_tokens")).otherwise(0.0)
    # where a source has no documents, the others share its part in proportion
    attainable = F.when(F.coalesce("available", F.lit(0.0)) > 0, F.col("target_share") / F.sum(F.when(F.col("available") > 0, F.col("target_share"))).over(Window.partitionBy())).otherwise(0.0)
    report = report.withColumn("attainable_share", attainable)
    off = F.abs(actual - F.col("attainable_share")) > TOLERANCE * F.col("attainable_share")
    reason = F.when(F.coalesce("available", F.lit(0.0)) == 0, "no documents").when(off & (actual < F.col("attainable_share")), "under target").when(off, "over target")
    report = report.select(
        "source", "target_share", F.round("attainable_share", 6).alias("attainable_share"), F.col("max_repeat").cast("int").alias("max_repeat"), F.coalesce("available", F.lit(0.0)).cast("bigint").alias("available_tokens"),
        F.round("selected_tokens", 1).alias("selected_tokens"), F.round(actual, 6).alias("actual_share"), (off | (F.coalesce("available", F.lit(0.0)) == 0)).alias("missed"), reason.alias("reason"), F.lit(error).alias("fit_error"),
    )
    return selection, report


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mixture and how often each is used."""
    return mix(read_wide(spark, sf_dir, "documents"), read(spark, sf_dir, "source_mix"))[0]


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached by source, and the targets missed."""
    return mix(read_wide(spark, sf_dir, "documents"), read(spark, sf_dir, "source_mix"))[1]


QUERIES = {"p9_selection": p9_selection, "p9_report": p9_report}
ORACLES: dict[str, str] = {}
