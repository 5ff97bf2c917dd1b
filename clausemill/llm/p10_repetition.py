"""Repetition inside a single document: document statistics scored by monotonic gradient-boosted trees."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from clausemill.llm.markup_text import groups, letters_of
from clausemill.session import read, read_wide

#: A repeated run has at least so many letters or ideographs.
RUN = 10
#: Documents with at least this exact share are reported.
SHARE = 0.4
#: At most about so many documents are labelled to fit the trees; the sample is taken by a hash of doc_id and text.
FIT_ROWS = 4000

SENTENCE = re.compile(r"[。！？；.!?;\n]+")
#: most is RUN times the repeated windows of RUN letters by letters, at most 1: the exact share can't exceed it.
FEATURES = ("most", "repeated_24", "repeated_sentences", "compressed")
#: +1: the share can't fall as the feature grows; -1: can't grow; 0: free.
MONOTONE = (1, 1, 1, -1)
#: The least favourable statistics that a document of share SHARE may have: monotone trees score all such documents at
#: least as high as these, so nothing that reaches SHARE is passed over below their score.
CORNER = (SHARE, 0.0, 0.0, np.inf)


def _window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of so many characters, by doubling: width log steps over the whole array."""
    if len(codes) < width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        power ^= power >> np.uint64(29)
        done, size, out = 0, 1, None
        while True:
            if width & size:
                part = power[done : done + len(codes) - width + 1]
                out = part.copy() if out is None else (out * np.uint64(0xBF58476D1CE4E5B9) + part) ^ (out >> np.uint64(31))
                done += size
            if done == width:
                return out
            power = power[:-size] * np.uint64(0x94D049BB133111EB) + power[size:]
            power ^= power >> np.uint64(32)
            size *= 2


def repeated_share(text: str) -> float:
    """The exact share of letters lying in runs of RUN or more that stood earlier in the document; 0 for short texts."""
    codes, _ = letters_of([text])
    hashes = _window_hashes(codes, RUN)
    if not len(hashes):
        return 0.0
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    again = order[1:][ranked[1:] == ranked[:-1]]
    edges = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + RUN, -1)
    return float((np.cumsum(edges[:-1]) > 0).mean())


def _repeats(codes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Of documents laid end to end, how many of each one's windows stand in it again; never less than truly do."""
    hashes = _window_hashes(codes, width)
    at = np.arange(len(hashes))
    owner = np.searchsorted(starts, at, side="right") - 1
    ends = np.append(starts[1:], len(codes))
    inside = at + width <= ends[owner]
    owner = owner[inside]
    keys = (owner.astype(np.uint64) << np.uint64(44)) | (hashes[inside] >> np.uint64(20))
    keys.sort()
    again = keys[1:][keys[1:] == keys[:-1]] >> np.uint64(44)
    return np.bincount(again.astype(np.int64), minlength=len(starts))


def statistics(texts: list[str]) -> np.ndarray:
    """FEATURES of each document, one row each; the hashing and sorting run over all of them at once."""
    codes, bounds = letters_of(texts)
    starts, lengths = bounds[:-1], np.diff(bounds)
    full = lengths > 0  # empty ones share their start with the next
    most, wide = np.zeros(len(texts)), np.zeros(len(texts))
    if full.any():
        most[full] = np.minimum(1, RUN * _repeats(codes, starts[full], RUN) / lengths[full])
        wide[full] = _repeats(codes, starts[full], 24) / lengths[full]
    sentences, packed = np.zeros(len(texts)), np.ones(len(texts))
    for k, text in enumerate(texts):
        pieces = SENTENCE.split(text)
        total = sum(map(len, pieces))
        sentences[k] = 1 - sum(map(len, set(pieces))) / total if total else 0
        if lengths[k]:
            raw = codes[bounds[k] : bounds[k + 1]].astype(np.uint16).tobytes()
            packed[k] = len(zlib.compress(raw, 1)) / len(raw)
    return np.stack([most, wide, sentences, packed], 1)


@dataclass
class Trees:
    """Complete binary trees in arrays: node i has children 2i+1 and 2i+2, leaves hold values."""

    depth: int
    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Scores of all rows, level by level, without a loop over rows."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (2**self.depth - 1)]
        return np.clip(out, 0, 1)


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...] = MONOTONE, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48) -> Trees:
    """Gradient boosting for squared error over quantile bins.

    A split against a feature's monotone direction is refused, and the two sides' values are bounded by their mean, so
    every tree, and with it the sum, is monotone in the constrained features. An empty sample gives the constant 0.
    """
    inner, leaves = 2**depth - 1, 2**depth
    model = Trees(depth, float(y.mean()) if len(y) else 0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(y):
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    current = np.full(len(y), model.base)
    for _ in range(trees):
        left_over = y - current
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        low, high = {0: -np.inf}, {0: np.inf}
        for k in range(inner):
            low.setdefault(k, -np.inf), high.setdefault(k, np.inf)
            mine = np.flatnonzero(node == k)
            g, best, pick = left_over[mine], 1e-9, None
            for j, direction in enumerate(monotone):
                if len(mine) < 4 or not len(cuts[j]):
                    continue
                n = np.bincount(binned[mine, j], minlength=len(cuts[j]) + 1).cumsum()[:-1]
                s = np.bincount(binned[mine, j], weights=g, minlength=len(cuts[j]) + 1).cumsum()[:-1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    a, b = s / (n + 1.0), (g.sum() - s) / (len(g) - n + 1.0)
                    gain = s * a + (g.sum() - s) * b - g.sum() ** 2 / (len(g) + 1.0)
                gain[(n < 2) | (n > len(g) - 2) | (direction * (b - a) < 0)] = 0
                if gain.max() > best:
                    best, pick = gain.max(), (j, int(gain.argmax()), a, b)
            right = np.zeros(len(mine), bool)
            low[2 * k + 1] = low[2 * k + 2] = low[k]
            high[2 * k + 1] = high[2 * k + 2] = high[k]
            if pick:
                j, cut, a, b = pick
                feature[k], threshold[k] = j, cuts[j][cut]
                right = binned[mine, j] > cut
                middle = float(np.clip((a[cut] + b[cut]) / 2, low[k], high[k]))
                if monotone[j] > 0:
                    high[2 * k + 1], low[2 * k + 2] = middle, middle
                elif monotone[j] < 0:
                    low[2 * k + 1], high[2 * k + 2] = middle, middle
            node[mine] = 2 * k + 1 + right
        value = np.zeros(leaves)
        for leaf in range(leaves):
            g = left_over[node == inner + leaf]
            bound = (low.get(inner + leaf, -np.inf), high.get(inner + leaf, np.inf))
            value[leaf] = rate * float(np.clip(g.sum() / (len(g) + 1.0), *bound)) if np.isfinite(bound).any() or len(g) else 0.0
        model.feature = np.vstack([model.feature, feature])
        model.threshold = np.vstack([model.threshold, threshold])
        model.value = np.vstack([model.value, value])
        current += value[node - inner]
    return model


def _statistics_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in groups(list(batch["text"])):
            texts = list(batch["text"][part])
            rows = np.column_stack([statistics(texts), [repeated_share(t) for t in texts]])
            yield pd.DataFrame(rows, columns=[*FEATURES, "share"])


def sample_edge(n: int, rows: int = FIT_ROWS) -> int:
    """The 64-bit hash below which about so many of n rows lie; for any n, as the whole range of the hash is used."""
    return 2**63 - 1 if n <= rows else -(2**63) + 2**64 * rows // n


def fit_repetition(documents: DataFrame) -> Trees:
    """Trees fitted on a bounded sample, labelled with the exact share; a collection without texts gives the constant 0."""
    texts = documents.select("doc_id", "text").filter("text is not null")
    picked = texts.filter(F.xxhash64("doc_id", "text") <= sample_edge(texts.select("doc_id").count()))
    schema = ", ".join(f"{c} double" for c in (*FEATURES, "share"))
    sample = picked.select("text").mapInPandas(_statistics_of, schema).toPandas().to_numpy(float)
    return fit_trees(sample[:, :-1], sample[:, -1])


def score_repetition(documents: DataFrame, model: Trees, every: bool = True) -> DataFrame:
    """(doc_id, text) -> doc_id, predicted, share.

    predicted is the trees' share, share the exact one. Without every, share is null for documents that the trees score
    below CORNER: as they are monotone, none of these has SHARE or more. Null texts count as empty, with share 0; every
    row gives one row, repeated doc_ids repeated ones. The plan has no shuffle.
    """
    gate = -np.inf if every else float(model.predict(np.array([CORNER]))[0])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            everything = list(batch["text"].fillna(""))
            for part in groups(everything):
                texts = everything[part]
                predicted = model.predict(statistics(texts))
                share = [repeated_share(t) if p >= gate else None for t, p in zip(texts, predicted)]
                yield pd.DataFrame({"doc_id": batch["doc_id"][part], "predicted": predicted, "share": pd.array(share, dtype="Float64")})

    return documents.select("doc_id", "text").mapInPandas(score, "doc_id bigint, predicted double, share double")


def p10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of repeated content of every document."""
    documents = read_wide(spark, sf_dir, "documents").select("doc_id", "text")
    return score_repetition(documents, fit_repetition(documents))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of whose letters two fifths repeat what stood earlier: those the trees let through, measured."""
    documents = read_wide(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_repetition(documents, fit_repetition(documents), every=False)
    return scored.filter(F.col("share") >= SHARE).select("doc_id").distinct()


QUERIES = {"p10_repetition": p10_repetition, "p10_found": p10_found}
ORACLES = {
    "p10_found": r"""with t as (select doc_id, regexp_replace(text, '[^\p{L}]+', '', 'g') as s from documents where text is not null), w as (select doc_id, k, substr(s, k, 10) as x from (select doc_id, s, unnest(range(1, length(s) - 8)) as k from t where length(s) >= 10) u),
a as (select doc_id, k from (select doc_id, k, row_number() over (partition by doc_id, x order by k) as r from w) u where r > 1), c as (select doc_id, count(distinct k + i) as n from a, (select unnest(range(0, 10)) as i) o group by doc_id)
select distinct c.doc_id from c join t using (doc_id) where c.n * 5 >= 2 * length(s)"""
}
