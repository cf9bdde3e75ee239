"""Retrieval over documents, embeddings and announcements."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import date_int, growth, half_up, narrative, sector_theme, words
from ..functions.rules import STOP_WORDS
from ..operators import hybrid_search, ranking, retrieval, routing
from ..operators.textindex import TextIndex, full_text, index_of
from ..sources.scratch import Scratch, spread
from ..streaming.jobs import shared_folder
from .registry import Tables, query

_TERMS = ["the", "les", "und"]
_BOTH = ["the", "and"]


def _bm25_sql(terms: list[str], pattern: str, idf: str, k1: str, extra: str = "") -> str:
    """sc: doc_id, s, hit. Texts are taken apart, counted and joined; nothing here follows the plan of the Spark side."""
    words = f"regexp_extract_all(lower(text), '{pattern}')"
    return f"""tok AS (SELECT doc_id, {extra or words} AS ws FROM documents), dl AS (SELECT doc_id, len(ws) AS dl FROM tok WHERE len(ws) > 0),
st AS (SELECT COUNT(*)::DOUBLE AS n, AVG(dl)::DOUBLE AS mean FROM dl), alltf AS (SELECT doc_id, w, COUNT(*) AS tf FROM (SELECT doc_id, unnest(ws) AS w FROM tok) GROUP BY 1, 2),
alldf AS (SELECT w, COUNT(*) AS df FROM alltf GROUP BY w), mi AS (SELECT AVG(ln((n - df + 0.5) / (df + 0.5))) AS mean_idf FROM alldf, st), tf AS (SELECT * FROM alltf WHERE w IN ({", ".join(f"'{t}'" for t in terms)})),
sc AS (SELECT tf.doc_id, SUM({idf} * tf.tf * ({k1}::DOUBLE + 1) / (tf.tf + {k1}::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / st.mean))) AS s, COUNT(*) AS hit FROM tf JOIN alldf df USING (w) JOIN dl USING (doc_id), st, mi GROUP BY tf.doc_id)"""


_FLOORED = "greatest(ln((st.n - df.df + 0.5) / (df.df + 0.5)), 0.000001::DOUBLE)"
_OKAPI = "(CASE WHEN ln((st.n - df.df + 0.5) / (df.df + 0.5)) < 0 THEN 0.25::DOUBLE * mi.mean_idf ELSE ln((st.n - df.df + 0.5) / (df.df + 0.5)) END)"
_MIXED = "list_concat(list_transform(regexp_extract_all(text, '[A-Za-z0-9&]+'), lambda x: lower(x)), list_filter(regexp_extract_all(text, '[A-Za-z0-9&]+'), lambda x: lower(x) <> x))"
_BM25 = _bm25_sql(_TERMS, "[a-z0-9]+", _OKAPI, "1.5", _MIXED)
_KNN = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 0), kn AS (SELECT vec_id, floor((1 - list_dot_product(CAST(embedding AS DOUBLE[]), q.e) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q.e, q.e)))) * 10000 + 0.5) / 10000 AS distance FROM embeddings, q)"""


def _indexed(t: Tables, tokeniser: str) -> TextIndex:
    """The index of `documents` with these tokens."""
    return index_of(t.spark, shared_folder(t.spark), "documents", tokeniser, spread(t.table("documents")), "doc_id", F.col("text"))


def _okapi(t: Tables, terms: list[str], n: int) -> DataFrame:
    """The in-memory ranking: Okapi with k1 1.5, b .75; terms of most documents are worth a quarter of the vocabulary's mean idf."""
    found = _indexed(t, "mixed").search(terms, n, 1.5, 0.75, "okapi", epsilon=0.25, least=0.0, digits=4)
    return found.withColumnRenamed("key", "doc_id")


def _query_vector(t: Tables, vec_id: int = 0) -> list[float]:
    return list(t.table("embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


@query("""WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents), e AS (SELECT doc_id, unnest(ws) AS w FROM tok), st AS (SELECT COUNT(*) AS n, floor(AVG(len(ws)) * 1000000 + 0.5) / 1000000 AS mean FROM tok WHERE len(ws) > 0)
SELECT w AS token, COUNT(DISTINCT doc_id) AS df, COUNT(*) AS tf, MIN(st.n) AS n_docs, MIN(st.mean) AS mean_length FROM e, st GROUP BY w""")
def A16_corpus_stats(t: Tables) -> DataFrame:
    docs = spread(t.table("documents"))
    listed = docs.select(retrieval.tokens(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    index = retrieval.postings(docs, "doc_id", "text")
    corpus = listed.agg(F.count("*").alias("n_docs"), half_up(F.avg(F.size("ws")), 6).alias("mean_length"))
    return index.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).crossJoin(F.broadcast(corpus))


@query(f"WITH {_bm25_sql(_BOTH, '[a-z0-9]+', _FLOORED, '1.2')} SELECT doc_id, -floor(s * 10000 + 0.5) / 10000 AS score FROM sc WHERE hit = 2")
def R1_bm25_all_terms(t: Tables) -> DataFrame:
    """Documents with every term; the score is negative, the best has the least."""
    found = _indexed(t, "plain").search(_BOTH, None, 1.2, 0.75, "floored", match_all=True)
    return found.select(F.col("key").alias("doc_id"), (-half_up(F.col("score"), 4)).alias("score"))


def _announcement_index(t: Tables) -> TextIndex:
    line = F.concat_ws(" ", "symbol", "company", "subject", "details")
    return index_of(t.spark, shared_folder(t.spark), "announcements", "stemmed", t.wide("announcements"), "id", line)


_FTS = """tok AS (SELECT id, regexp_extract_all(lower(concat_ws(' ', symbol, company, subject, details)), '[a-z0-9]+') AS ws FROM announcements), st AS (SELECT COUNT(*)::DOUBLE AS n, AVG(len(ws))::DOUBLE AS mean FROM tok),
tf AS (SELECT id, len(ws) AS dl, len(list_filter(ws, lambda x: x IN ('order', 'orders'))) AS a, len(list_filter(ws, lambda x: x = 'railway')) AS b FROM tok),
df AS (SELECT COUNT(*) FILTER (WHERE a > 0) AS a, COUNT(*) FILTER (WHERE b > 0) AS b FROM tf),
w AS (SELECT greatest(ln((n - df.a + 0.5) / (df.a + 0.5)), 0.000001::DOUBLE) AS a, greatest(ln((n - df.b + 0.5) / (df.b + 0.5)), 0.000001::DOUBLE) AS b, mean FROM df, st),
found AS (SELECT id, -(w.a * tf.a * 2.2::DOUBLE / (tf.a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)) + w.b * tf.b * 2.2::DOUBLE / (tf.b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))) AS rank FROM tf, w WHERE tf.a > 0 AND tf.b > 0)"""


@query(f"""WITH {_FTS} SELECT f.id, a.symbol, a.subject, a.score, floor(f.rank * 1000000 + 0.5) / 1000000 AS rank FROM found f JOIN announcements a ON a.id = f.id""")
def J15_fts_content(t: Tables) -> DataFrame:
    """Every announcement that a stemmed question finds, with its row."""
    index = _announcement_index(t)
    found = index.search(index.question_terms("Railways ORDERED"), None, 1.2, 0.75, "floored", match_all=True)
    ranked = found.select(F.col("key").alias("id"), half_up(-F.col("score"), 6).alias("rank"))
    return t.announcements.join(ranked, "id").select("id", "symbol", "subject", "score", "rank")


@query(f"""WITH {_FTS} SELECT f.id, floor(f.rank * 1000000 + 0.5) / 1000000 AS rank FROM found f JOIN announcements a ON a.id = f.id WHERE a.score >= 4 AND a.symbol IN ('3', '7', '11', '19') ORDER BY f.rank, f.id LIMIT 25""")
def R1_fts_filtered(t: Tables) -> DataFrame:
    """The 25 best for a stemmed question, among announcements of some companies with a least score."""
    found = full_text(_announcement_index(t), t.announcements, "railways ordering", 25, min_score=4, symbols=["3", "7", "11", "19"])
    return found.select("id", half_up(F.col("rank"), 6).alias("rank"))


@query("SELECT id, floor(-score / 13.0::DOUBLE * 1000000 + 0.5) / 1000000 AS rank FROM announcements WHERE symbol IN ('3', '7') ORDER BY score DESC, broadcast_date DESC, id LIMIT 40")
def R1_empty_question(t: Tables) -> DataFrame:
    found = full_text(lambda: _announcement_index(t), t.announcements, "  ", 40, symbols=["3", "7"])
    return found.select("id", half_up(F.col("rank"), 6).alias("rank"))


@query(f"WITH {_BM25} SELECT doc_id, floor(s * 10000 + 0.5) / 10000 AS score FROM sc WHERE s > 0 ORDER BY score DESC, doc_id LIMIT 50")
def R2_bm25(t: Tables) -> DataFrame:
    return _okapi(t, _TERMS, 50)


@query(f"WITH {_KNN} SELECT vec_id, distance FROM kn ORDER BY distance, vec_id LIMIT 20")
def R3_cosine_knn(t: Tables) -> DataFrame:
    return retrieval.knn(t.table("embeddings"), "vec_id", "embedding", _query_vector(t), 20)


@query("""SELECT id, floor((coalesce(1.0::DOUBLE / (60 + a), 0) + coalesce(1.0::DOUBLE / (60 + b), 0)) * 1000000000 + 0.5) / 1000000000 AS score FROM
(SELECT id, row_number() OVER (PARTITION BY symbol ORDER BY value DESC NULLS LAST, id) AS a FROM order_wins) x FULL JOIN (SELECT id, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, id) AS b FROM announcements) y USING (id)""")
def R4_rrf(t: Tables) -> DataFrame:
    a = ranking.with_rank(t.order_wins, ["symbol"], [F.desc_nulls_last("value"), F.col("id")])
    b = ranking.with_rank(t.announcements, ["symbol"], [F.desc("score"), F.col("id")])
    return retrieval.rrf([(a, 1.0), (b, 1.0)], "id").select("id", half_up(F.col("score"), 9).alias("score"))


@query("""SELECT id, floor((coalesce(0.5::DOUBLE / (60 + a), 0) + coalesce(0.5::DOUBLE / (60 + b), 0)) * 1000000000 + 0.5) / 1000000000 AS score, CAST(CASE WHEN a IS NULL OR b IS NULL THEN 1 ELSE 2 END AS BIGINT) AS n_sources FROM
(SELECT id, row_number() OVER (PARTITION BY symbol ORDER BY value DESC NULLS LAST, id) AS a FROM order_wins) x FULL JOIN (SELECT id, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, id) AS b FROM announcements) y USING (id)""")
def R5_weighted_rrf(t: Tables) -> DataFrame:
    a = ranking.with_rank(t.order_wins, ["symbol"], [F.desc_nulls_last("value"), F.col("id")])
    b = ranking.with_rank(t.announcements, ["symbol"], [F.desc("score"), F.col("id")])
    return retrieval.rrf([(a, 0.5), (b, 0.5)], "id").select("id", half_up(F.col("score"), 9).alias("score"), "n_sources")


@query(f"""WITH {_BM25}, {_KNN}, l AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS a FROM (SELECT doc_id, floor(s * 10000 + 0.5) / 10000 AS score FROM sc WHERE s > 0 ORDER BY score DESC, doc_id LIMIT 60)),
d AS (SELECT doc_id, distance, row_number() OVER (ORDER BY distance, doc_id) AS b FROM (SELECT vec_id AS doc_id, distance FROM kn ORDER BY distance, vec_id LIMIT 60))
SELECT doc_id, floor((coalesce(1.0::DOUBLE / (60 + a), 0) + coalesce(1.0::DOUBLE / (60 + b), 0)) * 1000000 + 0.5) / 1000000 AS score, coalesce(distance, 1.0::DOUBLE) AS distance FROM l FULL JOIN d USING (doc_id) ORDER BY coalesce(1.0::DOUBLE / (60 + a), 0) + coalesce(1.0::DOUBLE / (60 + b), 0) DESC, doc_id LIMIT 20""")
def R6_hybrid(t: Tables) -> DataFrame:
    lexical = _okapi(t, _TERMS, 60)
    dense = retrieval.knn(t.table("embeddings"), "vec_id", "embedding", _query_vector(t), 60).withColumnRenamed("vec_id", "doc_id")
    return retrieval.hybrid(lexical, dense, "doc_id", 20).select("doc_id", half_up(F.col("score"), 6).alias("score"), "distance")


_RW = "list_distinct(regexp_extract_all(lower(details), '[a-z]{3,}'))"


@query(f"""WITH c AS (SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY symbol ORDER BY id)) AS base, {_RW} AS w, score, broadcast_date AS day, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS n, order_value_cr AS v FROM announcements WHERE broadcast_date <= CAST('1998-06-01' AS DATE)), m AS (SELECT MAX(v) AS top FROM c)
SELECT id, floor(base * (1 + 0.35::DOUBLE * (len(list_intersect(w, ['railway', 'order']))::DOUBLE / len(list_distinct(list_concat(w, ['railway', 'order'])))) + 0.25::DOUBLE * least(score / 13.0::DOUBLE, 1.0) + 0.15::DOUBLE * least(1.0, greatest(0.0, 1 - (CAST('1998-06-01' AS DATE) - day) / 7.0::DOUBLE)) + CASE WHEN n > 1 THEN 0.10::DOUBLE ELSE 0.0 END + 0.15::DOUBLE * least(v / top, 1.0)) * 1000000 + 0.5) / 1000000 AS ranked FROM c, m""")
def R8_rerank(t: Tables) -> DataFrame:
    rows = t.announcements.where("broadcast_date <= date'1998-06-01'")
    ranked = ranking.with_rank(rows, ["symbol"], [F.col("id")])
    c = ranked.select("id", (1.0 / (60 + F.col("rank"))).alias("base"), words(F.col("details")).alias("text_words"), "score", F.col("broadcast_date").alias("day"), F.when(F.col("id") % 2 == 0, 2).otherwise(1).alias("n_sources"), F.col("order_value_cr").alias("order_value"))
    return retrieval.rerank(c, ["railway", "order"], F.lit("1998-06-01").cast("date"), True).select("id", half_up(F.col("ranked"), 6).alias("ranked"))


@query("""WITH rel AS (SELECT symbol AS case_id, id AS item FROM order_wins WHERE value > 300000), ret AS (SELECT symbol AS case_id, id AS item, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, id) AS rank FROM announcements),
n AS (SELECT case_id, COUNT(*) AS n FROM rel GROUP BY 1), g AS (SELECT ret.case_id, MIN(rank) AS best, SUM(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END) AS dcg FROM ret JOIN rel ON rel.case_id = ret.case_id AND rel.item = ret.item GROUP BY 1)
SELECT n.case_id, CASE WHEN best <= 5 THEN 1 ELSE 0 END AS hit, floor(coalesce(1.0::DOUBLE / best, 0) * 1000000 + 0.5) / 1000000 AS mrr, floor(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n.n, 5) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))) * 1000000 + 0.5) / 1000000 AS ndcg FROM n LEFT JOIN g ON g.case_id = n.case_id""")
def A14_ranking_metrics(t: Tables) -> DataFrame:
    relevant = t.order_wins.where("value > 300000").select(F.col("symbol").alias("case_id"), F.col("id").alias("item"))
    retrieved = ranking.with_rank(t.announcements, ["symbol"], [F.desc("score"), F.col("id")]).select(F.col("symbol").alias("case_id"), F.col("id").alias("item"), "rank")
    found = retrieval.ranking_metrics(retrieved, relevant, 5)
    return found.select("case_id", "hit", half_up(F.col("mrr"), 6).alias("mrr"), half_up(F.col("ndcg"), 6).alias("ndcg"))


# ---- whole retrieval for questions

_QUESTIONS = ["software firm stake", "railway coaches like these", "top 10 orders with score above 6 on 14/5/1998", "earnings and margin", "strong profit growth related to audited results"]
_AS_OF = "1998-08-05"


def _broker_sql() -> str:
    """Everything in one statement: hashed vectors, stemmed words (the one question whose words all occur), fusion, enrichment, boosts."""
    texts = ", ".join(f"({i}, '{q}')" for i, q in enumerate(_QUESTIONS))
    hashed = "CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 16 AS d, CASE WHEN CAST('0x' || substr(md5(w), 9, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS s"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    ranked = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]{{2,}}'), lambda w: w NOT IN ({stop})))"
    return f"""WITH qs AS (SELECT * FROM (VALUES {texts}) AS q(qi, txt)), tok AS (SELECT id, regexp_extract_all(lower(concat_ws(' ', symbol, company, subject, details)), '[a-z0-9]+') AS ws FROM announcements),
e AS (SELECT id, unnest(ws) AS w FROM tok), qe AS (SELECT qi, unnest(regexp_extract_all(lower(txt), '[a-z0-9]+')) AS w FROM qs), h AS (SELECT w, {hashed} FROM (SELECT w FROM e UNION SELECT w FROM qe)),
vec AS (SELECT id, d, SUM(s)::DOUBLE AS x FROM e JOIN h USING (w) GROUP BY 1, 2), nv AS (SELECT id, sqrt(SUM(x * x)) AS n FROM vec GROUP BY 1 HAVING SUM(x * x) > 0), qvec AS (SELECT qi, d, SUM(s)::DOUBLE AS x FROM qe JOIN h USING (w) GROUP BY 1, 2), qn AS (SELECT qi, sqrt(SUM(x * x)) AS n FROM qvec GROUP BY 1),
dots AS (SELECT qi, id, SUM(v.x * q.x) AS dot FROM vec v JOIN qvec q USING (d) GROUP BY 1, 2), dist AS (SELECT qn.qi, nv.id, floor((1 - coalesce(dot, 0) / (nv.n * qn.n)) * 10000 + 0.5) / 10000 AS distance FROM nv CROSS JOIN qn LEFT JOIN dots ON dots.qi = qn.qi AND dots.id = nv.id WHERE qn.qi IN (0, 1, 4)),
vr AS (SELECT qi, a.*, rn - 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY distance, id) AS rn FROM dist) x JOIN announcements a ON a.id = x.id WHERE rn <= 80),
st AS (SELECT COUNT(*)::DOUBLE AS n, AVG(len(ws))::DOUBLE AS mean FROM tok), tf AS (SELECT id, len(ws) AS dl FROM tok WHERE list_contains(ws, 'software') AND list_contains(ws, 'firm') AND list_contains(ws, 'stake')), df AS (SELECT COUNT(*) AS df FROM tf),
br AS (SELECT 0 AS qi, a.*, row_number() OVER (ORDER BY -(3 * greatest(ln((n - df + 0.5) / (df + 0.5)), 0.000001::DOUBLE) * 2.2::DOUBLE / (1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), a.id) - 1 AS place FROM tf JOIN announcements a ON a.id = tf.id, df, st QUALIFY place < 80),
bf AS (SELECT qi, symbol, broadcast_date, subject, arg_min(id, place) AS id FROM br GROUP BY ALL),
pt AS (SELECT qi, CAST(id AS VARCHAR) AS key, symbol, company, subject, details, score, broadcast_date AS day, 0.5::DOUBLE / (61 + place) AS part, 'bm25' AS source, place FROM br UNION ALL
SELECT v.qi, coalesce(CAST(bf.id AS VARCHAR), concat(v.symbol, '|', CAST(v.broadcast_date AS VARCHAR), '|', substr(v.subject, 1, 20))) AS key, v.symbol, v.company, v.subject, '' AS details, v.score, v.broadcast_date AS day, 0.5::DOUBLE / (61 + v.place) AS part, 'vector' AS source, 1000 + v.place AS place FROM vr v LEFT JOIN bf ON bf.qi = v.qi AND bf.symbol = v.symbol AND bf.broadcast_date = v.broadcast_date AND bf.subject = v.subject),
fu AS (SELECT qi, key AS id, arg_min(symbol, place) AS symbol, arg_min(company, place) AS company, arg_min(subject, place) AS subject, arg_min(details, place) AS details, arg_min(score, place) AS score, arg_min(day, place) AS day, SUM(part) AS base, COUNT(DISTINCT source) AS n_sources, MAX(CASE WHEN source = 'vector' THEN 1 ELSE 0 END) AS vec FROM pt GROUP BY qi, key),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY base DESC, id) AS rn FROM fu) WHERE rn <= 40),
fin AS (SELECT *, row_number() OVER (ORDER BY broadcast_date DESC, symbol, period) AS rn FROM results),
c AS (SELECT qi, id, symbol, company, subject, details, score, day, base, n_sources FROM top WHERE qi <> 1 OR vec = 1
UNION ALL SELECT 2 AS qi, CAST(id AS VARCHAR) AS id, symbol, company, subject, details, score, broadcast_date AS day, score / 13.0::DOUBLE AS base, 1 AS n_sources FROM (SELECT * FROM announcements WHERE broadcast_date = CAST('1998-05-14' AS DATE) AND score >= 6 AND order_value_cr >= 6 ORDER BY score DESC, broadcast_date DESC, id LIMIT 50)
UNION ALL SELECT q.qi, 'fin_' || symbol || '_' || period AS id, symbol, '' AS company, 'Financial Results ' || period AS subject, '' AS details, 8 AS score, broadcast_date AS day, 0.5::DOUBLE AS base, 1 AS n_sources FROM fin JOIN (VALUES (3, 20), (4, 10)) AS q(qi, most) ON rn <= q.most),
ov AS (SELECT symbol, broadcast_date, subject, arg_max(order_value_cr, id) AS v FROM announcements GROUP BY 1, 2, 3), g AS (SELECT c.*, coalesce(ov.v, 0) AS v, MAX(coalesce(ov.v, 0)) OVER (PARTITION BY qi) AS most, {ranked("concat_ws(' ', c.subject, c.details, c.symbol, c.company)")} AS ws FROM c LEFT JOIN ov ON ov.symbol = c.symbol AND ov.broadcast_date = c.day AND ov.subject = c.subject),
b AS (SELECT g.*, base * (1 + 0.35::DOUBLE * (len(list_intersect(ws, qw))::DOUBLE / len(list_distinct(list_concat(ws, qw)))) + 0.25::DOUBLE * least(score / 13.0::DOUBLE, 1.0) + 0.15::DOUBLE * least(1.0, greatest(0.0, 1 - (CAST('{_AS_OF}' AS DATE) - day) / 7.0::DOUBLE)) + CASE WHEN n_sources > 1 THEN 0.10::DOUBLE ELSE 0.0 END
+ CASE WHEN qi = 2 AND v > 0 THEN 0.15::DOUBLE * least(v / CASE WHEN most > 0 THEN most ELSE 1.0 END, 1.0) ELSE 0.0 END) AS ranked FROM g JOIN (SELECT qi, {ranked("txt")} AS qw FROM qs) USING (qi))
SELECT qi AS question, nth, id, symbol, subject, n_sources, floor(ranked * 1000000 + 0.5) / 1000000 AS ranked FROM (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY ranked DESC, id) AS nth FROM b) WHERE nth <= 10"""


@query(_broker_sql())
def R12_retrieval(t: Tables) -> DataFrame:
    """Five questions, one of each intent, from the index and the vectors to the ten best after re-ranking."""
    scratch, index = Scratch(t.spark, "retrieval"), _announcement_index(t)
    # written once with their vectors: five questions read them, each several times
    fields = t.wide("announcements").select("id", "symbol", "company", "subject", "details", "score", "broadcast_date", "order_value_cr")
    rows = scratch.written(hybrid_search.with_vectors(fields, F.concat_ws(" ", "symbol", "company", "subject", "details")), "rows")
    vectors = rows.where("embedding is not null").select("id", "embedding")
    themed = lambda theme: sector_theme(F.col("company"), F.col("subject"), F.col("details"), theme)
    results = scratch.written(t.results, "results")
    out = None
    for i, question in enumerate(_QUESTIONS):
        q = routing.ask(t.spark, question, dt.date(1998, 8, 5))
        found = hybrid_search.retrieve(q, question, index, rows, vectors, hybrid_search.question_vector(question, rows), results, F.lit(_AS_OF).cast("date"), themed=themed)
        nth = F.row_number().over(Window.orderBy(F.desc("ranked"), "id"))  # of ten rows
        part = found.select(F.lit(i).alias("question"), nth.alias("nth"), "id", "symbol", "subject", F.size("sources").alias("n_sources"), half_up(F.col("ranked"), 6).alias("ranked"))
        out = part if out is None else out.unionByName(part)
    return out


# ---- typed searches over two collections

_NUMBER = "regexp_replace(regexp_replace(CAST(CAST({x} AS DECIMAL(38, 2)) AS VARCHAR), '0$', ''), '\\.$', '.0')"
_GROWN = "(SELECT a.symbol, a.period, a.period_no, a.period_type, a.broadcast_date, a.revenue, a.pat, floor((a.revenue - b.revenue) / abs(nullif(b.revenue, 0)) * 100 * 10 + 0.5) / 10 AS rg, floor((a.pat - b.pat) / abs(nullif(b.pat, 0)) * 100 * 10 + 0.5) / 10 AS pg FROM results a LEFT JOIN results b ON b.symbol = a.symbol AND b.period_no = a.period_no - 4)"
_NARRATIVE = f"""concat_ws(' ', concat('Company ', symbol, ' (', symbol, ') ', period, ':'), concat_ws(' ', CASE WHEN revenue <> 0 THEN concat('Revenue Rs.', {_NUMBER.format(x="revenue")}, ' cr') END, CASE WHEN rg IS NOT NULL THEN concat('(', printf('%+.1f', rg), '% YoY)') END, '|',
CASE WHEN pat <> 0 THEN concat('PAT Rs.', {_NUMBER.format(x="pat")}, ' cr') END, CASE WHEN pg IS NOT NULL THEN concat('(', printf('%+.1f', pg), '% YoY)') END, '|'))"""


def _grown(t: Tables) -> DataFrame:
    """Results with their growth over the same period a year before."""
    old = t.results.select("symbol", (F.col("period_no") + 4).alias("period_no"), F.col("revenue").alias("_r"), F.col("pat").alias("_p"))
    rows = t.results.join(old, ["symbol", "period_no"], "left")
    return rows.withColumns({"rg": growth(F.col("revenue"), F.col("_r")), "pg": growth(F.col("pat"), F.col("_p"))}).drop("_r", "_p")


def _narrated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", narrative(F.concat(F.lit("Company "), "symbol"), F.col("symbol"), F.col("period"), F.col("revenue"), F.col("rg"), F.col("pat"), F.col("pg")))


@query(f"SELECT symbol, period, {_NARRATIVE} AS doc FROM {_GROWN}")
def F14_financial_narrative(t: Tables) -> DataFrame:
    return _narrated(_grown(t)).select("symbol", "period", F.col("text").alias("doc"))


@query("SELECT a.symbol, a.period, floor((a.revenue - b.revenue) / abs(nullif(b.revenue, 0)) * 100 * 10 + 0.5) / 10 AS revenue_growth, floor((a.pat - b.pat) / abs(nullif(b.pat, 0)) * 100 * 10 + 0.5) / 10 AS pat_growth FROM results a LEFT JOIN results b ON b.symbol = a.symbol AND b.period_no = a.period_no - 4")
def F29_growth(t: Tables) -> DataFrame:
    return _grown(t).select("symbol", "period", F.col("rg").alias("revenue_growth"), F.col("pg").alias("pat_growth"))


_SEARCHES = {
    "order_wins": ("fin", "large building order", {"$and": [{"period_type": {"$eq": "order_win"}}, {"order_value_cr": {"$gte": 200.0}}, {"sector": {"$eq": "BUILDING"}}, {"date_int": {"$gte": 19950101}}, {"date_int": {"$lte": 19980630}}]}, 15),
    "financials": ("fin", "revenue and PAT of company 7", {"$and": [{"period_type": {"$eq": "quarterly"}}, {"revenue_cr": {"$gte": 1000.0}}, {"revenue_growth_pct": {"$gte": 0.1}}]}, 15),
    "announcements": ("ann", "acquisition of a software firm", {"$and": [{"subject": {"$eq": "Acquisition"}}, {"date_int": {"$gte": 19960101}}]}, 15),
    "all": ("ann", "railway growth", {}, 10), "all, financial": ("fin", "railway growth", {}, 10),
}


def _typed_sql() -> str:
    fin = f"""fin AS (SELECT 'r|' || symbol || '|' || period AS id, {_NARRATIVE} AS txt, period_type, revenue AS revenue_cr, rg AS revenue_growth_pct, NULL::DOUBLE AS order_value_cr, NULL AS sector, CAST(strftime(broadcast_date, '%Y%m%d') AS INT) AS date_int, NULL AS subject FROM {_GROWN}
UNION ALL SELECT 'o|' || CAST(id AS VARCHAR) AS id, concat_ws(' ', company, 'order win', order_sector, 'large') AS txt, 'order_win' AS period_type, NULL AS revenue_cr, NULL AS revenue_growth_pct, value / 1000.0::DOUBLE AS order_value_cr, order_sector AS sector, CAST(strftime(broadcast_date, '%Y%m%d') AS INT) AS date_int, NULL AS subject FROM order_wins)"""
    ann = "ann AS (SELECT CAST(id AS VARCHAR) AS id, concat(company, ' (', symbol, '): ', subject, '. ', details) AS txt, CAST(strftime(broadcast_date, '%Y%m%d') AS INT) AS date_int, subject FROM announcements)"
    mixed = "list_concat(list_transform(regexp_extract_all(txt, '[A-Za-z0-9&]+'), lambda x: lower(x)), list_filter(regexp_extract_all(txt, '[A-Za-z0-9&]+'), lambda x: lower(x) <> x))"
    hashed = "CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 16 AS d, CASE WHEN CAST('0x' || substr(md5(w), 9, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS s"
    conditions = {
        "order_wins": "period_type = 'order_win' AND order_value_cr >= 200 AND sector = 'BUILDING' AND date_int BETWEEN 19950101 AND 19980630", "financials": "period_type = 'quarterly' AND revenue_cr >= 1000 AND revenue_growth_pct >= 0.1",
        "announcements": "subject = 'Acquisition' AND date_int >= 19960101", "all": "TRUE", "all, financial": "TRUE",
    }
    questions = ", ".join(f"('{kind}', '{c}', '{q}', {n})" for kind, (c, q, _, n) in _SEARCHES.items())
    passed = " UNION ALL ".join(f"SELECT '{kind}' AS kind, id FROM {c} WHERE {conditions[kind]}" for kind, (c, *_) in _SEARCHES.items())
    return f"""WITH {fin}, {ann}, al AS (SELECT 'fin' AS c, id, txt FROM fin UNION ALL SELECT 'ann' AS c, id, txt FROM ann), qs AS (SELECT * FROM (VALUES {questions}) AS q(kind, c, txt, n)), ok AS ({passed}),
mt AS (SELECT c, id, {mixed} AS ws FROM al), ml AS (SELECT c, id, len(ws) AS dl FROM mt), ms AS (SELECT c, COUNT(*)::DOUBLE AS n, AVG(dl)::DOUBLE AS mean FROM ml WHERE dl > 0 GROUP BY c), mtf AS (SELECT c, id, w, COUNT(*) AS tf FROM (SELECT c, id, unnest(ws) AS w FROM mt) GROUP BY ALL), mdf AS (SELECT c, w, COUNT(*) AS df FROM mtf GROUP BY c, w),
mi AS (SELECT c, AVG(ln((n - df + 0.5) / (df + 0.5))) AS mean_idf FROM mdf JOIN ms USING (c) GROUP BY c), mq AS (SELECT DISTINCT kind, c, w FROM (SELECT kind, c, unnest({mixed}) AS w FROM qs)),
wq AS (SELECT kind, c, w, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) < 0 THEN 0.25::DOUBLE * mean_idf ELSE ln((n - df + 0.5) / (df + 0.5)) END AS worth FROM mq JOIN mdf USING (c, w) JOIN ms USING (c) JOIN mi USING (c)),
sc AS (SELECT kind, id, SUM(worth * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))) AS s FROM wq JOIN mtf USING (c, w) JOIN ml USING (c, id) JOIN ms USING (c) JOIN ok USING (kind, id) GROUP BY kind, id),
lr AS (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY floor(s * 1000000 + 0.5) DESC, id) AS rn FROM sc WHERE floor(s * 1000000 + 0.5) > 0),
e AS (SELECT c, id, unnest(regexp_extract_all(lower(txt), '[a-z0-9]+')) AS w FROM al), qe AS (SELECT kind, c, unnest(regexp_extract_all(lower(txt), '[a-z0-9]+')) AS w FROM qs), h AS (SELECT w, {hashed} FROM (SELECT w FROM e UNION SELECT w FROM qe)),
vec AS (SELECT c, id, d, SUM(s)::DOUBLE AS x FROM e JOIN h USING (w) GROUP BY ALL), nv AS (SELECT c, id, sqrt(SUM(x * x)) AS n FROM vec GROUP BY ALL HAVING SUM(x * x) > 0), qvec AS (SELECT kind, c, d, SUM(s)::DOUBLE AS x FROM qe JOIN h USING (w) GROUP BY ALL), qn AS (SELECT kind, c, sqrt(SUM(x * x)) AS n FROM qvec GROUP BY ALL),
dots AS (SELECT kind, id, SUM(v.x * q.x) AS dot FROM vec v JOIN qvec q USING (c, d) GROUP BY ALL), dist AS (SELECT ok.kind, ok.id, floor((1 - coalesce(dot, 0) / (nv.n * qn.n)) * 10000 + 0.5) / 10000 AS distance FROM ok JOIN qn USING (kind) JOIN nv ON nv.c = qn.c AND nv.id = ok.id LEFT JOIN dots ON dots.kind = ok.kind AND dots.id = ok.id),
vr AS (SELECT kind, id, distance, row_number() OVER (PARTITION BY kind ORDER BY distance, id) AS rn FROM dist),
fu AS (SELECT kind, id, coalesce(1.0::DOUBLE / (60 + l.rn), 0) + coalesce(1.0::DOUBLE / (60 + v.rn), 0) AS score, coalesce(distance, 1.0::DOUBLE) AS distance, q.n FROM (SELECT lr.* FROM lr JOIN qs USING (kind) WHERE rn <= 3 * qs.n) l FULL JOIN (SELECT vr.* FROM vr JOIN qs USING (kind) WHERE rn <= 3 * qs.n) v USING (kind, id) JOIN qs q USING (kind))
SELECT kind, id, floor(score * 1000000 + 0.5) / 1000000 AS score, distance FROM fu QUALIFY row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) <= n"""


@query(_typed_sql())
def R7_typed_retrieval(t: Tables) -> DataFrame:
    """Typed searches of the two collections, each by words and vectors behind its conditions; the search of both is their two lists."""
    number = lambda c: date_int(F.col(c).cast("string"))
    results = _narrated(_grown(t)).select(F.concat_ws("|", F.lit("r"), "symbol", "period").alias("id"), "text", "period_type", F.col("revenue").alias("revenue_cr"), F.col("rg").alias("revenue_growth_pct"), F.lit(None).cast("double").alias("order_value_cr"), F.lit(None).cast("string").alias("sector"), number("broadcast_date").alias("date_int"))
    wins = t.wide("order_wins").select(F.concat(F.lit("o|"), F.col("id").cast("string")).alias("id"), F.concat_ws(" ", "company", F.lit("order win"), "order_sector", F.lit("large")).alias("text"), F.lit("order_win").alias("period_type"), F.lit(None).cast("double").alias("revenue_cr"), F.lit(None).cast("double").alias("revenue_growth_pct"), (F.col("value") / 1000.0).alias("order_value_cr"), F.col("order_sector").alias("sector"), number("broadcast_date").alias("date_int"))
    ann = t.wide("announcements").select(F.col("id").cast("string").alias("id"), F.concat(F.col("company"), F.lit(" ("), F.col("symbol"), F.lit("): "), F.col("subject"), F.lit(". "), F.col("details")).alias("text"), number("broadcast_date").alias("date_int"), "subject")
    out, kept, scratch = None, {}, Scratch(t.spark, "typed")
    for kind, (collection, question, tree, n) in _SEARCHES.items():
        if collection not in kept:
            source = {"fin": results.unionByName(wins), "ann": ann}[collection]
            # written once with their vectors: the index is built from them and each search reads them
            rows = scratch.written(hybrid_search.with_vectors(source, F.col("text")), collection)
            kept[collection] = rows, index_of(t.spark, shared_folder(t.spark), f"collection-{collection}", "mixed", rows, "id", F.col("text"), source)
        rows, index = kept[collection]
        found = hybrid_search.typed_search(index, rows, index.question_terms(question), hybrid_search.question_vector(question, rows), tree, n)
        part = found.select(F.lit(kind).alias("kind"), "id", half_up(F.col("score"), 6).alias("score"), "distance")
        out = part if out is None else out.unionByName(part)
    return out
