"""Search: keyword scoring of sections, lookups, fusion, boosts, penalties and the router."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from clausemill.functions.codes import code_token, normalize_code
from clausemill.operators.lexical import MOST_WORDS, contained
from clausemill.operators.sections import keep_best
from clausemill.session import materialise

# Fixed values of the scoring.
LEAST_SCORE, PPR_DIVISOR, LEGACY_GAIN = 5.0, 40.0, 1.5
#: Results that a query's list shows, and queries up to which they are broadcast to meet their results.
MOST_RESULTS, MOST_ASKED = 100, 200_000
SUPERSEDED, ABOLISHED = 0.65, 0.4
AUTHORITY_STEP, AUTHORITY_MOST, REFERENCED_GAIN, TAG_GAIN = 0.01, 0.2, 1.15, 1.15
RARE = r"防碱|泛碱|背涂|碾压|挤密|焊接|探伤"
SPECIAL = r"系数|度|偏差|检验|混凝土|砌体"
FILLERS = ("施工", "工程", "进行", "采用", "符合", "不得", "应当", "必须", "严禁", "一般", "以上", "以下")
GENERAL_HEADING = r"^([1-9]\d*\.?)?(总则|General|基本规定|一般要求|术语和符号|术语和定义|符号|范围|Scope|规范性引用文件|引用标准)$"
COMMON_HEADING = r"^([1-9]\d*\.)+[1-9]\d*(一般规定|一般要求|General)$"
CONTENTS_HEADING = r"(……\s*\d{1,4}|\s{2,}\d{1,4})\s*$"
FRONT = r"前\s*言|目\s*次|目\s*录|引\s*言"


def rarity(word: Column) -> Column:
    """Weight of a keyword by what it looks like."""
    return (
        F.when(word.rlike(RARE) | F.upper(word).rlike(r"^(GB|JGJ|CJJ|CECS|CJ/T?)\s*\d+"), 3.0)
        .when((F.length(word) <= 2) & word.isin(*FILLERS), 1.0)
        .when(word.rlike(SPECIAL) | (F.length(word) >= 3), 1.5).otherwise(1.0)
    )


def heading_factor(heading: Column) -> Column:
    """General chapters count next to nothing, common sections little, clauses more."""
    bare = F.regexp_replace(heading, r"\s+", "")
    return F.when(bare.rlike(GENERAL_HEADING), 0.01).when(bare.rlike(COMMON_HEADING), 0.3).when(heading.rlike(r"\d+\.\d+\.\d+"), 1.3).otherwise(1.0)


def keywords(text: Column) -> Column:
    """Distinct lower-case words of a query with the canonical form of its code."""
    words = F.filter(F.split(F.lower(F.trim(text)), r"[\s　]+"), lambda w: w != "")
    code = F.lower(normalize_code(code_token(text)))
    return F.array_distinct(F.filter(F.concat(words, F.array(code)), lambda w: w != ""))


def finder(asked: list[tuple[int | str, list[str]]], kind: str = "bigint") -> Callable[[Column], Column]:
    """Finds the keywords that a text contains, and the queries they belong to, by an index of the keywords' first two signs.

    A text costs one look at each of its distinct pairs of signs, and one at each keyword that begins with one of them.
    """
    owners, heads = defaultdict(list), defaultdict(list)
    for qid, words in asked:
        for word in words:
            owners[word].append(qid)
    for word in owners:
        heads[word[:2]].append(word)
    owners, heads = dict(owners), dict(heads)

    @F.pandas_udf(f"found array<string>, qids array<{kind}>")
    def find(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            text = text or ""
            begun = heads.keys() & {*map("".join, zip(text, text[1:])), *text}
            found = [word for head in begun for word in heads[head] if word in text]
            out.append((found, list({qid for word in found for qid in owners[word]})))
        return pd.DataFrame(out, columns=["found", "qids"])

    return find.asNondeterministic()  # so that it isn't run again for each use of what it finds


#: Sections with what was found in them.
FOUND = "part string, file string, code string, sid int, heading string, factor double, extra double, found array<int>, named array<int>, titled array<int>"


@dataclass
class Signatures:
    """Queries by the words of theirs that occur anywhere: queries of equal ones have equal results.

    owners holds the places of the signatures with a word, a place being an index into ids, sizes, own and code.
    """

    ids: np.ndarray  # names of the signatures
    sizes: np.ndarray  # keywords of each query, found anywhere or not
    own: np.ndarray  # those that are words of its text
    code: np.ndarray  # the keyword that is only its code's canonical form, -1 without
    owners: dict[int, np.ndarray]
    rarity: dict[int, int]  # twice the weight of each word
    by_code: dict[str, list[int]]  # words that a standard's code contains or that contain it
    bonus: dict[int, np.ndarray]  # by the number of keywords, for each number of them covered


def _found_words(rows: DataFrame, words: list[str]) -> DataFrame:
    """Sections with the words in their text, heading and file name, as places in the list; those without any in the text drop out."""
    shared, most = rows.sparkSession.sparkContext.broadcast(words), MOST_WORDS

    def automaton(start: int) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for k, word in enumerate(shared.value[start : start + most], start):
            out.add_word(word, k)
        out.make_automaton()
        return out

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = range(0, len(shared.value), most)
        kept = automaton(0) if len(starts) == 1 else None  # longer lists are looked for in blocks
        for batch in batches:
            columns = [[set() for _ in range(len(batch))] for _ in range(3)]
            for start in starts:
                walk = kept or automaton(start)
                names: dict[str, set[int]] = {}
                for k, (text, heading, file) in enumerate(zip(batch["segment"], batch["low"], batch["name"])):
                    if text:
                        columns[0][k].update(w for _, w in walk.iter(text))
                    columns[1][k].update(w for _, w in walk.iter(heading))
                    if file not in names:
                        names[file] = {w for _, w in walk.iter(file)}
                    columns[2][k] |= names[file]
            out = batch[["part", "file", "code", "sid", "heading", "factor", "extra"]].assign(**{c: [sorted(s) for s in sets] for c, sets in zip(("found", "titled", "named"), columns)})
            yield out[[len(s) > 0 for s in columns[0]]]

    return rows.mapInPandas(find, FOUND)


def _signatures(asked: DataFrame, held: DataFrame, words: list[str]) -> tuple[Signatures, DataFrame]:
    """The signatures of queries (qid, kws, own), and a table of sig and qids."""
    spark = asked.sparkSession
    hit = {r.w for r in held.select(F.explode(F.concat("found", "named", "titled")).alias("w")).distinct().collect()}
    codes = sorted({r.code.lower() for r in held.select("code").distinct().collect() if r.code})
    by_code: dict[str, list[int]] = {c: [] for c in codes}
    if codes:
        inside = ahocorasick.Automaton()
        for code in codes:
            inside.add_word(code, code)
        inside.make_automaton()
        pieces = {c[a:b] for c in codes for a in range(len(c)) for b in range(a + 1, len(c) + 1)}
        for k, word in enumerate(words):
            held_by = {c for _, c in inside.iter(word)} | ({c for c in codes if word in c} if word in pieces else set())
            for code in held_by:
                by_code[code].append(k)
            if held_by:
                hit.add(k)
    known = spark.sparkContext.broadcast({words[k]: k for k in hit})

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = known.value
        for batch in batches:
            rows = []
            for qid, kws, own in zip(batch["qid"], batch["kws"], batch["own"]):
                last = [place[w] for w in kws if w not in set(own) and w in place]
                rows.append((qid, sorted(place[w] for w in kws if w in place), len(kws), len(own), last[0] if last else -1))
            yield pd.DataFrame(rows, columns=["qid", "ids", "n", "own", "code"])

    signed = asked.mapInPandas(sign, f"qid {asked.schema['qid'].dataType.simpleString()}, ids array<int>, n int, own int, code int").filter(F.size("ids") > 0)
    groups = signed.groupBy("ids", "n", "own", "code").agg(F.collect_list("qid").alias("qids")).withColumn("sig", F.monotonically_increasing_id())
    groups = materialise(groups)
    rows = sorted(groups.select("sig", "ids", "n", "own", "code").collect())
    owners = defaultdict(list)
    for k, r in enumerate(rows):
        for w in r.ids:
            owners[w].append(k)
    listed = spark.createDataFrame([(k, words[k]) for k in owners] or [(-1, "")], "k int, word string")
    weights = {r.k: int(r.w) for r in listed.select("k", (rarity(F.col("word")) * 2).alias("w")).collect()}
    sizes = sorted({r.n for r in rows})
    steps = spark.createDataFrame([(n, c) for n in sizes for c in range(n + 1)] or [(1, 0)], "n int, covered int")
    bonus: dict[int, np.ndarray] = {n: np.zeros(n + 1) for n in sizes}
    for r in steps.select("n", "covered", (F.pow(F.col("covered") / F.col("n"), 3) * F.col("n") * 3).alias("b")).collect():
        if r.n in bonus:
            bonus[r.n][r.covered] = r.b
    columns = [np.array([r[c] for r in rows], dtype=np.int64) for c in ("sig", "n", "own", "code")]
    return Signatures(*columns, {w: np.array(ks, dtype=np.int64) for w, ks in owners.items()}, weights, by_code, bonus), groups.select("sig", "qids")


def half_up(values: np.ndarray, known: dict[float, float]) -> np.ndarray:
    """Values rounded to one place as Spark and SQL round them: by their shortest decimals, halves away from zero."""
    some, back = np.unique(values, return_inverse=True)
    for v in some.tolist():
        if v not in known:
            known[v] = float(Decimal(repr(v)).quantize(Decimal("0.1"), ROUND_HALF_UP))
    return np.array([known[v] for v in some.tolist()])[back]


def _counts(s: Signatures, words: list[int]) -> np.ndarray:
    """How many of the words each signature has."""
    out = np.zeros(len(s.ids), dtype=np.int64)
    for w in words:
        if w in s.owners:
            out[s.owners[w]] += 1
    return out


def _file_scores(s: Signatures, file: dict, named: list[int], known: dict[float, float]) -> tuple[np.ndarray, ...]:
    """A file's best section for every signature with a hit: places of the signatures and of the sections, hits, score.

    file: lists of found, titled, factor and extra, by sections in order of sid. Each hit is one whole number, made of the
    signature, the section and what the word counts; once these are sorted, sums and maxima are taken of runs.
    """
    m, parts = len(file["found"]), []
    for k, (found, titled) in enumerate(zip(file["found"], file["titled"])):
        heads = set(titled)
        for w in {*found, *titled}:
            if w in s.owners:
                value = (s.rarity[w] + 8 if w in found else 0) + (16 if w in heads else 0)
                parts.append((s.owners[w] * m + k) * 32 + value)
    if not parts:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    hits = np.concatenate(parts)
    hits.sort()
    pair, value = hits >> 5, hits & 31
    starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    matched = np.add.reduceat((value >> 3) & 1, starts)
    weight = np.add.reduceat(value & 7, starts) / 2.0
    heading = np.add.reduceat(value >> 4, starts)
    pair, some = pair[starts], matched > 0
    pair, matched, weight, heading = pair[some], matched[some], weight[some], heading[some]
    if not len(pair):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    sig, section = pair // m, pair % m
    in_name = _counts(s, named)
    own = in_name - np.where(s.code >= 0, np.isin(s.code, named), False)
    score = (weight * 4 + np.where(matched == s.sizes[sig], 4.0, 0.0) + heading * 5) * np.array(file["factor"])[section]
    score = score + (_counts(s, s.by_code.get((file["code"] or "").lower(), [])) * 10)[sig] + (in_name * 8)[sig] + np.where(own == s.own, 100.0, 0.0)[sig]
    score = np.round(score + np.array(file["extra"])[section], 6)
    starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    best = np.maximum.reduceat(score, starts)
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(sig)]))
    at = np.flatnonzero(score == best[group])
    at = at[np.r_[True, group[at][1:] != group[at][:-1]]]
    total = np.add.reduceat(matched, starts)
    sig = sig[starts]
    covered, sizes = _counts(s, sorted({w for ws in file["found"] for w in ws}))[sig], s.sizes[sig]
    bonus = np.zeros(len(sig))
    for n in np.unique(sizes).tolist():
        here = sizes == n
        bonus[here] = s.bonus[n][covered[here]]
    score = half_up(best + bonus, known)
    some = score > 0
    return sig[some], section[at][some], total[some], score[some]


def _files_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, str, dict]]:
    """Runs of rows of one file, as (part, file, lists by column)."""
    now, held = None, None
    for batch in batches:
        for r in batch.itertuples(index=False):
            if now != (r.part, r.file):
                if now is not None:
                    yield *now, held
                now, held = (r.part, r.file), {"code": r.code, "named": list(r.named), **{c: [] for c in ("sid", "heading", "factor", "extra", "found", "titled")}}
            for c in ("sid", "heading", "factor", "extra", "found", "titled"):
                held[c].append(getattr(r, c))
    if now is not None:
        yield *now, held


def keyword_search(queries: DataFrame, sections: DataFrame, segments: bool = True) -> DataFrame:
    """Best section of every file for every query, by keywords: qid, file, code, sid, heading, hits, score.

    queries: (qid, text); sections: (file, code, sid, heading, segment, length). Without segments only the best of each
    file's segments is given, as by dedup_segments. Sections are searched once for the distinct keywords; then queries
    are taken together whose keywords found anywhere are the same, and each file is scored for all of these at once where
    its sections, without their texts, lie. Files that may be segments of one lie together, so that scores aren't
    shuffled. Up to MOST_ASKED queries are broadcast to be given their results; more are joined.
    """
    spark = queries.sparkSession
    words = F.filter(F.split(F.lower(F.trim("text")), r"[\s　]+"), lambda w: w != "")
    asked = materialise(queries.filter("text is not null").select("qid", keywords(F.col("text")).alias("kws"), F.array_distinct(words).alias("own")))
    listed = sorted(r.w for r in asked.select(F.explode("kws").alias("w")).distinct().collect())
    usable = sections.filter(~F.col("heading").rlike(CONTENTS_HEADING))
    front = F.regexp_extract("segment", f"(?s)^(.*?)(?:{FRONT})", 1)
    segment = F.lower(F.when(F.col("segment").rlike(FRONT), front).otherwise(F.col("segment")))
    extra = F.when((F.col("length") > 300) & (F.col("length") < 3000), 1.0).when(F.col("length") > 5000, -1.0).otherwise(0.0)
    part = F.lit("") if segments else base_name(F.col("file"))
    rows = usable.select(part.alias("part"), "file", "code", "sid", "heading", heading_factor(F.col("heading")).alias("factor"), extra.alias("extra"), segment.alias("segment"), F.lower("heading").alias("low"), F.lower("file").alias("name"))
    held = materialise(_found_words(rows, listed))
    signatures, owners = _signatures(asked, held, listed)
    shared = spark.sparkContext.broadcast(signatures)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, known = shared.value, {}
        last, best = None, None

        def frame(some: np.ndarray, at: np.ndarray, places: list, hits: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
            file, code, sid, heading = (np.array([p[k] for p in places], dtype=object)[at] for k in range(4))
            return pd.DataFrame({"sig": s.ids[some], "file": file, "code": code, "sid": sid, "heading": heading, "hits": hits, "score": scores})

        def flush() -> pd.DataFrame:
            some = np.flatnonzero(best["score"] > 0)
            return frame(some, best["at"][some], best["places"], best["hits"][some], best["score"][some])

        for of, file, rows in _files_of(batches):
            sig, at, hits, scores = _file_scores(s, rows, rows["named"], known)
            places = [(file, rows["code"], sid, heading) for sid, heading in zip(rows["sid"], rows["heading"])]
            if segments:
                yield frame(sig, at, places, hits, scores)
                continue
            if of != last:
                if last is not None:
                    yield flush()
                last, best = of, {"score": np.zeros(len(s.ids)), "at": np.zeros(len(s.ids), np.int64), "hits": np.zeros(len(s.ids), np.int64), "places": []}
            better = scores > best["score"][sig]  # files come in order, so that a tie keeps the first
            sig = sig[better]
            best["score"][sig], best["hits"][sig], best["at"][sig] = scores[better], hits[better], at[better] + len(best["places"])
            best["places"] += places
        if last is not None:
            yield flush()

    tasks = max(spark.sparkContext.defaultParallelism * 3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    near = held.repartition(tasks, "file" if segments else "part").sortWithinPartitions("part", "file", "sid", "heading")
    results = near.mapInPandas(score, "sig bigint, file string, code string, sid int, heading string, hits bigint, score double")
    few = len(asked.limit(MOST_ASKED + 1).select("qid").collect()) <= MOST_ASKED
    return results.join(F.broadcast(owners) if few else owners, "sig").select(F.explode("qids").alias("qid"), "file", "code", "sid", "heading", "hits", "score")


def base_name(file: Column) -> Column:
    """A file's name without segment and page marks."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(file, r"^_seg\d+_", ""), r"_p\d+-\d+", ""), r"_\d+\.md$", "")


def dedup_segments(results: DataFrame) -> DataFrame:
    """The best result of each file's segments."""
    return keep_best(results.withColumn("base", base_name(F.col("file"))), ["qid", "base"], F.desc("score"), "file").drop("base")


def merge_bodies(results: DataFrame, bodies: DataFrame) -> DataFrame:
    """Keyword results with body scores: known files gain a fifth, new ones enter at three fifths if that is 3 or more."""
    both = results.select("qid", "file", "score").join(bodies.select("qid", "file", F.col("score").alias("body")), ["qid", "file"], "full_outer")
    score = F.when(F.col("score").isNull(), F.col("body") * 0.6).otherwise(F.col("score") + F.coalesce("body", F.lit(0.0)) * 0.2)
    source = F.when(F.col("score").isNull(), "body").otherwise("keyword")
    return both.filter("score is not null or body * 0.6 >= 3").select("qid", "file", score.alias("score"), source.alias("source"))


def union_best(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The better of two candidates for each key; a tie keeps the first frame's."""
    both = first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1)))
    return keep_best(both, keys, F.desc("score"), "_o").drop("_o")


def aligned(graph: DataFrame, keyword: DataFrame) -> DataFrame:
    """Graph and keyword candidates on one scale, the better of each file."""
    a = graph.select("qid", "file", (F.col("score") / PPR_DIVISOR).alias("score"), F.lit("graph").alias("source"))
    b = keyword.select("qid", "file", (F.col("score") * LEGACY_GAIN).alias("score"), F.lit("keyword").alias("source"))
    return union_best(a, b, ["qid", "file"])


def authority_boost(results: DataFrame, references: DataFrame, asked_code: str | None = None) -> DataFrame:
    """Results of standards that others refer to gain a hundredth a referrer, a fifth at most: adds refs.

    results: qid, code, score; references: (source_code, target_code). With the name of a column of the code asked for,
    results of standards that refer to it gain REFERENCED_GAIN besides and referenced is added.
    """
    counts = references.filter("source_code <> target_code").groupBy(F.col("target_code").alias("code")).agg(F.countDistinct("source_code").alias("refs"))
    gain = 1 + F.least(F.lit(AUTHORITY_MOST), F.coalesce("refs", F.lit(0)) * AUTHORITY_STEP)
    out = results.join(F.broadcast(counts), "code", "left").withColumn("score", F.col("score") * gain).fillna(0, ["refs"])  # a row a standard
    if asked_code is None:
        return out
    pairs = references.select(F.col("source_code").alias("code"), F.col("target_code").alias(asked_code), F.lit(True).alias("referenced")).distinct()
    out = out.join(pairs, ["code", asked_code], "left").withColumn("referenced", F.coalesce("referenced", F.lit(False)))
    return out.withColumn("score", F.col("score") * F.when(F.col("referenced"), REFERENCED_GAIN).otherwise(1.0))


def version_penalty(results: DataFrame, status: DataFrame) -> DataFrame:
    """Results of superseded and abolished standards count less and stand last: adds status, penalised and position.

    Positions are those of the first MOST_RESULTS of a query; no more are kept, already before they are brought together.
    """
    known = results.join(F.broadcast(status.select(F.col("standard_code").alias("code"), "status")), "code", "left").withColumn("status", F.coalesce("status", F.lit("unknown")))
    factor = F.when(F.col("status") == "superseded", SUPERSEDED).when(F.col("status") == "abolished", ABOLISHED).otherwise(1.0)
    known = known.withColumn("penalised", factor < 1).withColumn("score", F.col("score") * factor)
    order = Window.partitionBy("qid").orderBy("penalised", F.desc(F.round("score", 6)), "file")
    return known.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= MOST_RESULTS)


def layered(results: DataFrame) -> DataFrame:
    """The last order of results: penalised ones last; then those with a similarity, by it; then the rest by score.

    results: qid, file, score, penalised, sim (null without one). Adds position, of the first MOST_RESULTS of each query.
    """
    order = Window.partitionBy("qid").orderBy("penalised", F.col("sim").isNull(), F.desc("sim"), F.desc(F.round("score", 6)), "file")
    return results.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= MOST_RESULTS)


def confidence(score: Column) -> Column:
    """High from 60, mid from 20."""
    return F.when(score >= 60, "high").when(score >= 20, "mid").otherwise("low")


def coverage(units: Column, text: Column) -> Column:
    """Weighted share of a query's units (unit, weight) that a text contains; 1 without units."""
    total = F.aggregate(units, F.lit(0), lambda s, u: s + u["weight"])
    found = F.aggregate(units, F.lit(0), lambda s, u: s + F.when(text.contains(u["unit"]), u["weight"]).otherwise(F.lit(0)))
    return F.when(total > 0, found / total).otherwise(1.0)


def covered_confidence(score: Column, share: Column, exact: Column) -> Column:
    """Confidence, a step lower where the text covers little of the query, unless the branch is exact."""
    level = confidence(score)
    lower = F.when(level == "high", "mid").otherwise("low")
    return F.when(~exact & (share < 0.15), lower).otherwise(level)


def run_match_fraction(run: Column, text: Column) -> Column:
    """Share of a run's characters that lie in pieces of three, else two, characters which the text contains."""
    n = F.length(run)
    place = lambda i: F.greatest(F.lit(1), i)
    inside = lambda i, size: F.exists(F.sequence(place(i - size + 1), F.least(i, F.greatest(n - size + 1, F.lit(1)))), lambda a: (a + size - 1 <= n) & text.contains(F.substr(run, a, F.lit(size))))
    marked = F.filter(F.sequence(F.lit(1), n), lambda i: inside(i, 3) | inside(i, 2))
    return F.when(n >= 2, F.size(marked) / n).otherwise(F.lit(0.0))


def bool_filter(rows: DataFrame, text: str, must: list[str], must_not: list[str]) -> DataFrame:
    """Rows whose text holds every word of must and none of must_not, whatever their case."""
    out = rows
    for word in must:
        out = out.filter(F.lower(text).contains(word.lower()))
    for word in must_not:
        out = out.filter(~F.lower(text).contains(word.lower()))
    return out


def title_lookup(queries: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose title is the query (140), or holds it or is held by it (120); both are searched for by automata.

    Distinct queries meet distinct titles, and files and ids come last. Queries are looked for in titles in blocks.
    """
    asked = queries.select("qid", F.regexp_replace("text", r"\s+", "").alias("q")).filter(F.length("q") >= 4)
    titled = files.filter("title <> ''").select("file", "title")
    texts, titles = materialise(asked.select("q").distinct()), titled.select("title").distinct()
    pairs = contained(texts, "q", titles, "title").select("q", "title")
    blocks = texts.count() * 2 // MOST_WORDS + 1  # about half of what may be looked for at once
    for k in range(blocks):
        pairs = pairs.unionByName(contained(titles, "title", texts.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == k), "q").select("q", "title"))
    scored = pairs.distinct().withColumn("score", F.when(F.col("title") == F.col("q"), 140.0).otherwise(120.0))
    return scored.join(titled, "title").groupBy("q", "file").agg(F.max("score").alias("score")).join(asked, "q").select("qid", "file", "score")


def direct_lookup(queries: DataFrame, lookup: DataFrame) -> DataFrame:
    """Clauses named by code and number: the clause itself (100), else those below it (90); best tier of each query.

    lookup: (code, number, file, heading). GB and GBT count as one family. A clause meets a query by its number and by
    each number above it, so that only what is found is joined.
    """
    plain = lambda c: F.regexp_replace(c, "^GBT", "GB")
    asked = queries.select("qid", plain(normalize_code(code_token(F.col("text")))).alias("c"), F.regexp_extract("text", r"(\d+(?:\.\d+){1,4})\s*条?$", 1).alias("clause")).filter("c <> '' and clause <> ''")
    steps = F.split("number", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "."))
    found = lookup.withColumn("c", plain(F.col("code"))).filter("c <> ''").withColumn("clause", F.explode(above)).join(asked, ["c", "clause"])
    found = materialise(found.select("qid", "file", "heading", F.when(F.col("number") == F.col("clause"), 100.0).otherwise(90.0).alias("score")))
    best = found.groupBy("qid").agg(F.max("score").alias("best"))  # one row a query
    return found.join(best, "qid").filter("score = best").select("qid", "file", "heading", "score")


def routed(branches: list[tuple[str, DataFrame]]) -> DataFrame:
    """Results of the first branch that has any for a query: qid, file, score, branch."""
    out = None
    for tier, (name, frame) in enumerate(branches):
        part = frame.select("qid", "file", F.col("score").cast("double").alias("score"), F.lit(name).alias("branch"), F.lit(tier).alias("tier"))
        out = part if out is None else out.unionByName(part)
    first = out.groupBy("qid").agg(F.min("tier").alias("first"))  # one row a query
    return out.join(first, "qid").filter("tier = first").select("qid", "file", "score", "branch")
