"""Tokens, postings, BM25, co-occurrence and language-model operators."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from clausemill.session import materialise

K1, B = 1.5, 0.75
#: A term with more postings than this is generic; a section of fewer tokens than LEAST_TOKENS isn't indexed.
MOST_POSTINGS, LEAST_TOKENS = 5000, 5
PARTNERS, BIGRAMS = 15, 10
#: Most words that texts are searched for at once: an automaton of about a kilobyte a word goes to every task.
MOST_WORDS = 200_000
WORDS, RUNS = re.compile(r"[a-z0-9]{2,}"), re.compile(r"[一-鿿]{2,}")


def token_array(text: Column) -> Column:
    """Latin words and numbers of two signs or more, then pairs of neighbouring ideographs; empty for null."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(lower, F.lit("([a-z0-9]{2,})"), F.lit(1))
    runs = F.regexp_extract_all(lower, F.lit("([一-鿿]{2,})"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
    return F.concat(words, pairs)


def tokens(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One row a token: key, position and term."""
    return rows.select(key, F.posexplode(token_array(F.col(text))).alias("i", "term"))


def term_frequency(rows: DataFrame, key: str, text: str) -> DataFrame:
    """tf of every term of every row; the only shuffle is on (key, term), after partial counts."""
    return tokens(rows, key, text).groupBy(key, "term").agg(F.count("*").alias("tf"))


def python_tokens(text: str) -> list[str]:
    """token_array of a text."""
    lower = text.lower()
    return WORDS.findall(lower) + [run[k : k + 2] for run in RUNS.findall(lower) for k in range(len(run) - 1)]


COUNTED = T.StructType([T.StructField("dl", T.IntegerType()), T.StructField("postings", T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])))])


@F.pandas_udf(COUNTED)
def _counted(texts: pd.Series) -> pd.DataFrame:
    counts = [Counter(python_tokens(t or "")) for t in texts]
    return pd.DataFrame({"dl": [sum(c.values()) for c in counts], "postings": [[{"term": t, "tf": n} for t, n in c.items()] for c in counts]})


_counted = _counted.asNondeterministic()  # so that it isn't run again for each use of what it gives


def postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Postings with document length: key, dl, term, tf, of rows with LEAST_TOKENS tokens or more.

    Counted in Arrow batches inside each row, so building the index shuffles nothing.
    """
    held = rows.select(key, _counted(F.col(text)).alias("c")).filter(F.col("c.dl") >= LEAST_TOKENS)
    return held.select(key, "c.dl", F.inline("c.postings"))


def corpus_stats(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Number of rows, and their mean length in tokens."""
    held = rows.select(token_count(F.col(text)).alias("dl")).filter(f"dl >= {LEAST_TOKENS}")
    return held.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    """Inverse document frequency as BM25 uses it, never negative."""
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def token_count(text: Column) -> Column:
    """Number of tokens of token_array, counted without building them."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_count(lower, F.lit("[a-z0-9]{2,}")) + F.regexp_count(lower, F.lit("[一-鿿](?=[一-鿿])"))


def term_count(text: Column, term: str) -> Column:
    """How often token_array holds a term, counted in the text."""
    if re.fullmatch("[a-z0-9]{2,}", term):
        return F.regexp_count(F.lower(text), F.lit(f"(?<![a-z0-9]){term}(?![a-z0-9])"))
    return F.regexp_count(text, F.lit(f"{term[0]}(?={term[1]})")) if re.fullmatch("[一-鿿]{2}", term) else F.lit(0)


def bm25(rows: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """BM25 score of every row that holds a query term.

    The text is scanned once for its length and the terms' frequencies; only these numbers go on to the corpus's sums
    and the scores.
    """
    held = rows.select(key, token_count(F.col(text)).alias("dl"), *[term_count(F.col(text), t).alias(f"tf{k}") for k, t in enumerate(terms)]).filter(F.col("dl") >= LEAST_TOKENS)
    sums = held.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))])
    scored, score = held.crossJoin(F.broadcast(sums)), F.lit(0.0)  # one row
    for k in range(len(terms)):
        tf = F.col(f"tf{k}")
        part = idf(F.col("n"), F.col(f"df{k}")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        score = score + F.when(tf > 0, part).otherwise(0.0)
    return scored.withColumn("score", score).filter("score > 0").select(key, "score")


def bm25_asked(rows: DataFrame, key: str, text: str, asked: DataFrame) -> DataFrame:
    """BM25 score of every row for every query it shares a token with: qid, key, score.

    asked: (qid, text), the whole set of queries, of which every distinct token counts. The texts' postings are looked up
    once; a row's postings are brought together before they meet the queries, so scores aren't shuffled.
    """
    wanted = asked.select("qid", F.explode(F.array_distinct(token_array(F.col("text")))).alias("term"))
    hits = materialise(postings(rows, key, text).join(F.broadcast(wanted.select("term").distinct()), "term"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weights = wanted.join(df, "term").crossJoin(F.broadcast(corpus_stats(rows, key, text))).select("qid", "term", idf(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl")
    scored = hits.repartition(key).join(F.broadcast(weights), "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("qid", key).agg(F.sum(part).alias("score"))


def finder(words: list[str]) -> Callable[[Column], Column]:
    """A column of those words that a text contains, by one walk over the text with an automaton of them all."""

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        automaton = ahocorasick.Automaton()
        for word in words:
            automaton.add_word(word, word)
        if not words:
            return pd.Series([[] for _ in texts], dtype=object)
        automaton.make_automaton()
        return pd.Series([list(dict.fromkeys(w for _, w in automaton.iter(t or ""))) for t in texts], dtype=object)

    return find.asNondeterministic()  # so that it isn't run again for each use of what it finds


def contained(rows: DataFrame, text: str, words: DataFrame, word: str, *more: str) -> DataFrame:
    """Rows joined with the words their text contains, and with more columns of the words.

    The distinct words, up to MOST_WORDS, go to every task as an automaton; longer lists are refused. Empty words and null
    texts give nothing.
    """
    listed = sorted(r[0] for r in words.select(word).filter(F.col(word) != "").distinct().limit(MOST_WORDS + 1).collect())
    if len(listed) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words")
    found = rows.filter(F.col(text).isNotNull()).withColumn(word, F.explode(finder(listed)(F.col(text))))
    return found.join(words.select(word, *more).filter(F.col(word) != ""), word) if more else found


def cooccurrence(hits: DataFrame, key: str, term: str) -> DataFrame:
    """term, partner and the partner's share of all that stand with the term; the best PARTNERS of each.

    Pairs are made inside each row's set of terms, so a row of many terms costs its own pairs and no join.
    """
    sets = hits.groupBy(key).agg(F.array_sort(F.collect_set(term)).alias("terms"))
    pairs = sets.select(F.explode("terms").alias("term"), "terms").select("term", F.explode("terms").alias("partner")).filter("term <> partner")
    counts = pairs.groupBy("term", "partner").agg(F.count("*").alias("n"))
    shares = counts.withColumn("prob", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("term")), 4))
    best = Window.partitionBy("term").orderBy(F.desc("n"), "partner")
    return shares.withColumn("r", F.row_number().over(best)).filter(f"r <= {PARTNERS}").select("term", "partner", "prob")


def bigrams(rows: DataFrame, key: str, text: str, least: int = 2) -> DataFrame:
    """Counts of neighbouring tokens that each occur `least` times; pairs are made inside the row's array."""
    held = rows.select(token_array(F.col(text)).alias("toks"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("toks") - 2), lambda i: F.struct(F.get("toks", i).alias("w1"), F.get("toks", i + 1).alias("w2")))
    counts = held.filter(F.size("toks") >= 2).select(F.inline(pairs)).groupBy("w1", "w2").agg(F.count("*").alias("freq"))
    vocabulary = held.select(F.explode("toks").alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter(f"n >= {least}").select("w")
    kept = counts.join(vocabulary.withColumnRenamed("w", "w1"), "w1", "left_semi")
    return kept.join(vocabulary.withColumnRenamed("w", "w2"), "w2", "left_semi").select("w1", "w2", "freq")


def top_followers(counts: DataFrame, most: int = BIGRAMS) -> DataFrame:
    """The most frequent followers of each word with their share among these."""
    best = Window.partitionBy("w1").orderBy(F.desc("freq"), "w2")
    top = counts.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= most)
    return top.select("w1", "w2", "freq", F.round(F.col("freq") / F.sum("freq").over(Window.partitionBy("w1")), 6).alias("prob"))


def char_pairs(text: Column) -> Column:
    """Pairs of neighbouring characters of a text, as an array of c1 and c2."""
    pair = lambda i: F.struct(F.substr(text, i, F.lit(1)).alias("c1"), F.substr(text, i + 1, F.lit(1)).alias("c2"))
    return F.when(F.length(text) >= 2, F.transform(F.sequence(F.lit(1), F.length(text) - 1), pair))


def char_model(rows: DataFrame, text: str) -> DataFrame:
    """Transition probabilities of characters: c1, c2, freq, p."""
    counts = rows.select(F.inline(char_pairs(F.col(text)))).groupBy("c1", "c2").agg(F.count("*").alias("freq"))
    return counts.withColumn("p", F.col("freq") / F.sum("freq").over(Window.partitionBy("c1")))


def unseen_floor(model: DataFrame) -> DataFrame:
    """Probability of an unseen transition: pairs seen once, over all transitions and ten times the vocabulary."""
    sums = model.agg(F.count_if(F.col("freq") == 1).alias("once"), F.sum("freq").alias("total"), F.countDistinct("c1").alias("vocabulary"))
    return sums.select((F.col("once") / (F.col("total") * F.col("vocabulary") * 10)).alias("p_min"))


def anomaly_share(rows: DataFrame, key: str, text: str, model: DataFrame, worst: float = 0.05, bits: float = 22.0) -> DataFrame:
    """Share of a text's worst transitions that cost more than so many bits under the model."""
    pairs = rows.select(key, F.inline(char_pairs(F.col(text))))
    costs = pairs.groupBy(key, "c1", "c2").agg(F.count("*").alias("n")).join(model.select("c1", "c2", "p"), ["c1", "c2"], "left").crossJoin(F.broadcast(unseen_floor(model)))
    costs = costs.withColumn("bits", -F.log2(F.coalesce("p", "p_min")))
    order = Window.partitionBy(key).orderBy(F.desc("bits"), "c1", "c2")
    costs = costs.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    head = F.greatest(F.lit(1), F.floor(F.col("total") * worst))
    inside = F.greatest(F.lit(0), F.least(F.col("n"), head - F.col("before")))
    return costs.groupBy(key).agg((F.sum(F.when(F.col("bits") > bits, inside).otherwise(0)) / F.sum(inside)).alias("share"))


@F.pandas_udf(T.DoubleType())
def _entropy(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        n = np.array(list(Counter(text).values())) if text else np.empty(0)
        out.append(float(-(n / n.sum() * np.log2(n / n.sum())).sum()) if len(n) else None)
    return pd.Series(out, dtype="Float64")


def char_entropy(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Entropy of a text's characters in bits, computed inside the row; null and empty texts give no row."""
    return rows.filter(F.length(text) > 0).select(key, _entropy(F.col(text)).alias("entropy"))
