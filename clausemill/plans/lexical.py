"""Queries over tokens, postings and language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clausemill.operators import lexical
from clausemill.session import read, read_wide

TERMS = ["混凝", "养护", "脚手", "concrete", "shall"]
STOP = ["应", "不应", "shall", "the", "be", "of", "and", "for", "to", "in"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_wide(spark, sf_dir, "documents").select("doc_id", "text")


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_wide(spark, sf_dir, "read_clause_full").select("rec_id", "clause_text").filter("clause_text is not null and clause_text <> ''").distinct()


def a1_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many (document, term) pairs have each frequency."""
    return lexical.term_frequency(_documents(spark, sf_dir), "doc_id", "text").groupBy("tf").agg(F.count("*").alias("n"), F.countDistinct("term").alias("terms"))


def a2_doc_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of documents and their mean length."""
    return lexical.corpus_stats(_documents(spark, sf_dir), "doc_id", "text").select("n_docs", F.round("avgdl", 4).alias("avgdl"))


def a3_document_frequency_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and idf of every term."""
    postings = lexical.postings(_documents(spark, sf_dir), "doc_id", "text")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    n = lexical.corpus_stats(_documents(spark, sf_dir), "doc_id", "text").select("n_docs")
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(lexical.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for fixed terms."""
    scores = lexical.bm25(_documents(spark, sf_dir), "doc_id", "text", TERMS).withColumn("score", F.round("score", 4))
    return scores.orderBy(F.desc("score"), "doc_id").limit(10)


def golden_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of queries that searches are asked: the golden ones whose id is divisible by 20, each id once."""
    rows = read(spark, sf_dir, "golden_queries").filter("query_id % 20 = 0 and query is not null")
    return rows.groupBy(F.col("query_id").alias("qid")).agg(F.min("query").alias("text"))


def all_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every golden query, each id once."""
    rows = read(spark, sf_dir, "golden_queries").filter("query_id is not null and query is not null")
    return rows.groupBy(F.col("query_id").alias("qid")).agg(F.min("query").alias("text"))


def d3_bm25_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 score of every clause for every golden query that shares a token with it."""
    return lexical.bm25_asked(_clauses(spark, sf_dir), "rec_id", "clause_text", golden_questions(spark, sf_dir)).select("qid", "rec_id", F.round("score", 4).alias("score"))


def d3_bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 score of every clause that holds a term."""
    return lexical.bm25(_clauses(spark, sf_dir), "rec_id", "clause_text", TERMS).select("rec_id", F.round("score", 4).alias("score"))


def j6_containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known terms by the number of clauses that contain them."""
    hits = lexical.contained(_clauses(spark, sf_dir), "clause_text", read(spark, sf_dir, "term_map").select("term"), "term")
    return hits.groupBy("term").agg(F.count("*").alias("n"))


def a5_cooccurrence_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known terms that stand in the same clause."""
    hits = lexical.contained(_clauses(spark, sf_dir), "clause_text", read(spark, sf_dir, "term_map").select("term"), "term")
    return lexical.cooccurrence(hits, "rec_id", "term")


def a6_bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring tokens of clause texts."""
    return lexical.bigrams(_clauses(spark, sf_dir), "rec_id", "clause_text")


def w9_bigram_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent followers of every token."""
    return lexical.top_followers(a6_bigram_counts(spark, sf_dir))


def a7_char_bigram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transition probabilities of characters in clause texts."""
    return lexical.char_model(_clauses(spark, sf_dir), "clause_text").select("c1", "c2", "freq", F.round("p", 6).alias("p"))


def a7_unseen_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability given to unseen transitions."""
    return lexical.unseen_floor(lexical.char_model(_clauses(spark, sf_dir), "clause_text")).select(F.round(F.col("p_min") * 1e9, 4).alias("p_min_e9"))


def a8_char_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses whose worst transitions are dear, with the gate's verdict."""
    rows = _clauses(spark, sf_dir)
    share = lexical.anomaly_share(rows, "rec_id", "clause_text", lexical.char_model(rows, "clause_text"), bits=12.0)
    return share.select("rec_id", F.round("share", 6).alias("share"), (F.round("share", 6) <= 0.03).alias("passed")).filter("share > 0")


def f36_char_entropy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of every document's characters, and whether it is text."""
    entropy = lexical.char_entropy(_documents(spark, sf_dir), "doc_id", "text")
    return entropy.select("doc_id", F.round("entropy", 4).alias("entropy"), (F.round("entropy", 4) >= 4.5).alias("passed"))


def filter4_short_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of too few tokens to be indexed."""
    return _clauses(spark, sf_dir).select("rec_id", lexical.token_count(F.col("clause_text")).alias("n")).filter(f"n < {lexical.LEAST_TOKENS}")


def filter5_generic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms left when the generic ones, of more than MOST_POSTINGS postings, are dropped."""
    postings = lexical.postings(_clauses(spark, sf_dir), "rec_id", "clause_text").groupBy("term").agg(F.count("*").alias("df"))
    return postings.filter(F.col("df") <= lexical.MOST_POSTINGS)


def filter6_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query tokens that are long enough and no stop words."""
    asked = read(spark, sf_dir, "golden_queries").select("query_id", "query").distinct()
    found = lexical.tokens(asked, "query_id", "query").select("term").distinct()
    stop = spark.createDataFrame([(s,) for s in STOP], "term string")
    return found.filter(F.length("term") >= 2).join(F.broadcast(stop), "term", "left_anti")


def f21_query_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of a query: Latin words and runs of ideographs, at most twelve, those of four signs weighing double."""
    asked = read(spark, sf_dir, "golden_queries").select("query_id", "query").distinct().filter("query is not null")
    units = F.slice(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit("([a-z0-9]{2,}|[一-鿿]{2,})"), F.lit(1))), 1, 12)
    rows = asked.select("query_id", F.posexplode(units).alias("i", "unit"))
    return rows.select("query_id", "i", "unit", F.when(F.length("unit") >= 4, 2).otherwise(1).alias("weight"))


def a28_jaccard_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of the token sets of each document and the next, where below one half."""
    sets = _documents(spark, sf_dir).select("doc_id", F.array_distinct(lexical.token_array(F.col("text"))).alias("s"))
    following = sets.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t"))
    both = sets.join(following, "doc_id").withColumn("common", F.size(F.array_intersect("s", "t")))
    jaccard = F.col("common") / F.greatest(F.size("s") + F.size("t") - F.col("common"), F.lit(1))
    return both.select("doc_id", F.round(jaccard, 6).alias("jaccard")).filter("jaccard < 0.5")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, d3_bm25_all, d3_bm25_golden, a1_term_frequency, a2_doc_length_stats, a3_document_frequency_idf, j6_containment_join, a5_cooccurrence_top15, a6_bigram_counts, w9_bigram_top10,
        a7_char_bigram_model, a7_unseen_floor, a8_char_anomaly, f36_char_entropy_gate, filter4_short_sections, filter5_generic_terms, filter6_stop_words, f21_query_units, a28_jaccard_separation,
    )
}


def _toks(text: str) -> str:
    t = f"lower(coalesce({text}, ''))"
    return f"list_concat(regexp_extract_all({t}, '[a-z0-9]{{2,}}'), flatten(list_transform(regexp_extract_all({t}, '[一-鿿]{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))"


_DOC = f"docs as (select doc_id, {_toks('text')} as toks from documents)"
_CLS = "cls as (select distinct rec_id, clause_text from read_clause_full where clause_text is not null and clause_text <> '')"
_CTOK = f"{_CLS}, docs as (select rec_id, {_toks('clause_text')} as toks from cls)"
_IN = ", ".join(f"'{t}'" for t in TERMS)


def _bm25(key: str) -> str:
    return f"""held as (select {key}, toks, len(toks) as dl from docs where len(toks) >= 5), stats as (select count(*) as n, avg(dl) as avgdl from held),
tf as (select {key}, dl, term, count(*) as tf from (select {key}, dl, unnest(toks) as term from held) u where term in ({_IN}) group by all),
df as (select term, count(*) as df from tf group by term),
scores as (select {key}, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) as score from tf join df using (term), stats group by {key})"""


GOLDEN = "qs as (select query_id as qid, min(query) as text from golden_queries where query_id % 20 = 0 and query is not null group by query_id)"

#: The same of every golden query.
ALL_GOLDEN = "qs as (select query_id as qid, min(query) as text from golden_queries where query_id is not null and query is not null group by query_id)"


def bm25_asked_sql(source: str, key: str, text: str, name: str) -> str:
    """CTEs of the scores of source's texts for qs; the last is name."""
    return f"""{name}_w as (select distinct qid, unnest({_toks('text')}) as term from qs), {name}_h as (select {key}, toks, len(toks) as dl from (select {key}, {_toks(text)} as toks from {source}) u where len(toks) >= 5), {name}_n as (select count(*) as n, avg(dl) as avgdl from {name}_h),
{name}_t as (select {key}, dl, term, count(*) as tf from (select {key}, dl, unnest(toks) as term from {name}_h) u where term in (select term from {name}_w) group by all), {name}_d as (select term, count(*) as df from {name}_t group by term),
{name} as (select qid, {key}, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) as score from {name}_t join {name}_d using (term) join {name}_w using (term), {name}_n group by qid, {key})"""


_BIGRAMS = f"""{_CTOK}, pairs as (select toks[i] as w1, toks[i + 1] as w2 from (select toks, unnest(range(1, len(toks))) as i from docs) u),
vocab as (select w from (select unnest(toks) as w from docs) u group by w having count(*) >= 2),
bg as (select w1, w2, count(*) as freq from pairs where w1 in (select w from vocab) and w2 in (select w from vocab) group by w1, w2)"""
_MODEL = f"""{_CLS}, cp as (select rec_id, substr(clause_text, i, 1) as c1, substr(clause_text, i + 1, 1) as c2 from (select rec_id, clause_text, unnest(range(1, length(clause_text))) as i from cls) u),
freqs as (select c1, c2, count(*) as freq from cp group by c1, c2), model as (select *, freq / sum(freq) over (partition by c1) as p from freqs),
unseen as (select count(*) filter (freq = 1) / (sum(freq) * count(distinct c1) * 10) as p_min from model)"""
_HITS = f"{_CLS}, hits as (select rec_id, term from cls join (select distinct term from term_map) m on contains(clause_text, term))"
ORACLES = {
    "bm25_topk": f"with {_DOC}, {_bm25('doc_id')} select doc_id, score from scores order by score desc, doc_id limit 10",
    "d3_bm25_all": f"with {_CTOK}, {_bm25('rec_id')} select rec_id, score from scores",
    "d3_bm25_golden": f"with {_CLS}, {GOLDEN}, {bm25_asked_sql('cls', 'rec_id', 'clause_text', 'b')} select qid, rec_id, score from b",
    "a1_term_frequency": f"with {_DOC}, t as (select doc_id, term, count(*) as tf from (select doc_id, unnest(toks) as term from docs) u group by all) select tf, count(*) as n, count(distinct term) as terms from t group by tf",
    "a2_doc_length_stats": f"with {_DOC} select count(*) as n_docs, round(avg(len(toks)), 4) as avgdl from docs where len(toks) >= 5",
    "a3_document_frequency_idf": f"with {_DOC}, held as (select * from docs where len(toks) >= 5), n as (select count(*) as n from held), t as (select distinct doc_id, unnest(toks) as term from held) select term, count(*) as df, round(ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) as idf from t, n group by term, n",
    "j6_containment_join": f"with {_HITS} select term, count(*) as n from hits group by term",
    "a5_cooccurrence_top15": f"with {_HITS}, c as (select a.term, b.term as partner, count(*) as n from hits a join hits b on a.rec_id = b.rec_id and a.term <> b.term group by 1, 2), s as (select *, round(n / sum(n) over (partition by term), 4) as prob, row_number() over (partition by term order by n desc, partner) as r from c) select term, partner, prob from s where r <= 15",
    "a6_bigram_counts": f"with {_BIGRAMS} select w1, w2, freq from bg",
    "w9_bigram_top10": f"with {_BIGRAMS}, top as (select *, row_number() over (partition by w1 order by freq desc, w2) as r from bg) select w1, w2, freq, round(freq / sum(freq) over (partition by w1), 6) as prob from top where r <= 10",
    "a7_char_bigram_model": f"with {_MODEL} select c1, c2, freq, round(p, 6) as p from model",
    "a7_unseen_floor": f"with {_MODEL} select round(p_min * 1e9, 4) as p_min_e9 from unseen",
    "a8_char_anomaly": f"""with {_MODEL}, costs as (select rec_id, c1, c2, count(*) as n from cp group by all), priced as (select costs.*, -log2(coalesce(p, p_min)) as bits from costs left join model using (c1, c2), unseen),
ranked as (select *, sum(n) over (partition by rec_id order by bits desc, c1, c2 rows unbounded preceding) - n as before, sum(n) over (partition by rec_id) as total from priced),
inside as (select *, greatest(0, least(n, greatest(1, floor(total * 0.05)) - before)) as k from ranked), s as (select rec_id, round(sum(case when bits > 12 then k else 0 end) / sum(k), 6) as share from inside group by rec_id)
select rec_id, share, share <= 0.03 as passed from s where share > 0""",
    "f36_char_entropy_gate": "with c as (select doc_id, c, count(*) as n from (select doc_id, unnest(string_split(text, '')) as c from documents) u where c <> '' group by all), s as (select *, sum(n) over (partition by doc_id) as t from c), e as (select doc_id, round(-sum(n / t * log2(n / t)), 4) as entropy from s group by doc_id) select doc_id, entropy, entropy >= 4.5 as passed from e",
    "filter4_short_sections": f"with {_CTOK} select rec_id, len(toks) as n from docs where len(toks) < 5",
    "filter5_generic_terms": f"with {_CTOK}, t as (select distinct rec_id, unnest(toks) as term from docs where len(toks) >= 5) select term, count(*) as df from t group by term having count(*) <= 5000",
    "filter6_stop_words": f"with t as (select distinct unnest({_toks('query')}) as term from golden_queries) select term from t where length(term) >= 2 and term not in ({', '.join(repr(s) for s in STOP)})",
    "f21_query_units": "with q as (select distinct query_id, query from golden_queries where query is not null), f as (select query_id, regexp_extract_all(lower(query), '[a-z0-9]{2,}|[一-鿿]{2,}') as us from q), d as (select query_id, list_filter(us, lambda u, i: list_position(us, u) = i)[1:12] as us from f) select query_id, i - 1 as i, us[i] as unit, case when length(us[i]) >= 4 then 2 else 1 end as weight from (select query_id, us, unnest(range(1, len(us) + 1)) as i from d) x",
    "a28_jaccard_separation": f"with {_DOC}, s as (select doc_id, list_distinct(toks) as s from docs), b as (select a.doc_id, len(list_intersect(a.s, b.s)) as c, len(a.s) as x, len(b.s) as y from s a join s b on b.doc_id = a.doc_id + 1) select doc_id, round(c / greatest(x + y - c, 1), 6) as jaccard from b where round(c / greatest(x + y - c, 1), 6) < 0.5",
}
