"""Text, money, date and period functions, applied to the announcement feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..operators import setjoin
from ..sources.scratch import Scratch
from .registry import Tables, query

# The oracle's texts are made from the same rule tables.
_CATALYST_SQL = "CASE " + " ".join(f"WHEN regexp_matches(txt, '{p}', 'i') THEN '{n}'" for n, p in rules.CATALYSTS) + " ELSE 'general' END"


def _num(pattern: str, column: str = "details") -> str:
    return f"TRY_CAST(replace(nullif(regexp_extract({column}, '{pattern}', 1, 'i'), ''), ',', '') AS DOUBLE)"


_MONEY_SQL = "coalesce(" + ", ".join(
    [_num(rules.MONEY[0][0]), f"{_num(rules.MONEY[1][0])} / 100", f"floor({_num(rules.MONEY[2][0])} / 100 * 10 + 0.5) / 10", f"floor({_num(rules.MONEY[3][0])} * 8.4::DOUBLE * 10 + 0.5) / 10"]
) + ")"
_SIZE_SQL = "CASE WHEN v IS NULL THEN 'unknown' WHEN v >= 1000 THEN 'mega' WHEN v >= 500 THEN 'large' WHEN v >= 100 THEN 'medium' WHEN v >= 20 THEN 'small' ELSE 'tiny' END"


def _has(pattern: str, column: str = "details") -> str:
    return f"regexp_matches({column}, '{pattern}', 'i')"


_SCORE_SQL = f"""CASE WHEN subject = 'Outcome of Board Meeting' THEN greatest(6, CASE WHEN {_has(rules.RESULTS)} THEN 8 ELSE 0 END, CASE WHEN {_has(rules.HIGH_VALUE)} THEN 9 ELSE 0 END)
WHEN subject = 'Bagging/Receiving of orders/contracts' THEN CASE WHEN a >= 1000 THEN 13 WHEN a >= 500 THEN 12 WHEN a >= 100 THEN 11 ELSE 10 END
WHEN subject IN ('Press Release', 'Updates') THEN CASE WHEN {_has(rules.LOW_VALUE)} THEN 0 WHEN {_has(rules.HIGH_VALUE)} THEN 8 ELSE 3 END
WHEN subject = 'Dividend' THEN CASE WHEN d >= 5 THEN 5 WHEN d >= 1 THEN 4 WHEN d IS NOT NULL THEN 2 ELSE 4 END
WHEN subject = 'Appointment' THEN CASE WHEN {_has(rules.C_SUITE)} THEN 5 ELSE 1 END
WHEN subject = 'Acquisition' THEN CASE WHEN a >= 500 THEN 11 WHEN a >= 100 THEN 10 ELSE 9 END
ELSE CASE WHEN {_has(rules.HIGH_VALUE)} THEN 7 ELSE 3 END END"""


@query(f"""SELECT id, CAST({_SCORE_SQL} AS INT) AS catalyst FROM (SELECT id, subject, details, {_num(rules.MONEY[0][0])} AS a, TRY_CAST(nullif(regexp_extract(details, '{rules.DIVIDEND}', 1, 'i'), '') AS DOUBLE) AS d FROM announcements)""")
def F1_catalyst_score(t: Tables) -> DataFrame:
    return t.wide("announcements").select("id", C.catalyst_score(F.col("subject"), F.col("details")).cast("int").alias("catalyst"))


_TAGS = "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(txt, '{p}', 'i') THEN '{n}' END" for n, p in rules.SECTORS) + "], lambda x: x IS NOT NULL)), ',')"


@query(f"SELECT id, {_TAGS} AS tags FROM (SELECT id, concat(company, ' ', subject, ' ', details) AS txt FROM announcements)")
def F3_multi_label_tags(t: Tables) -> DataFrame:
    return t.wide("announcements").select("id", F.array_join(C.sector_tags(F.col("company"), F.col("subject"), F.col("details")), ",").alias("tags"))


@query(f"SELECT id, {_MONEY_SQL} AS value_cr FROM announcements")
def F4_money_parse(t: Tables) -> DataFrame:
    return t.wide("announcements").select("id", C.crore(F.col("details")).alias("value_cr"))


@query(f"SELECT {_SIZE_SQL} AS size, COUNT(*) AS n FROM (SELECT {_MONEY_SQL} AS v FROM announcements) GROUP BY 1")
def F5_size_bucket(t: Tables) -> DataFrame:
    return t.announcements.groupBy(C.size_bucket(C.crore(F.col("details"))).alias("size")).agg(F.count("*").alias("n"))


@query(f"SELECT id, {_CATALYST_SQL} AS catalyst FROM (SELECT id, concat(subject, ' ', details) AS txt FROM announcements)")
def F6_first_match_label(t: Tables) -> DataFrame:
    return t.announcements.select("id", C.catalyst_type(F.col("subject"), F.col("details")).alias("catalyst"))


@query(f"""SELECT id, CASE WHEN {_has(rules.POSITIVE, "txt")} THEN 'positive' WHEN {_has(rules.NEGATIVE, "txt")} THEN 'negative' ELSE 'neutral' END AS surprise,
{_has(rules.GOVERNMENT, "txt")} AS government, {_has(rules.EXPORT, "txt")} AS export FROM (SELECT id, concat(subject, ' ', details, ' ', company) AS txt FROM announcements)""")
def F7_surprise_flags(t: Tables) -> DataFrame:
    text = F.concat_ws(" ", "subject", "details", "company")
    return t.announcements.select("id", C.surprise(text).alias("surprise"), text.rlike("(?i)" + rules.GOVERNMENT).alias("government"), text.rlike("(?i)" + rules.EXPORT).alias("export"))


def novelty(rows: DataFrame, days: int = 30) -> DataFrame:
    """id, is_novel, score from id, symbol, subject, details, day: recurring subjects and repeat words first, then overlap with rows of the
    same symbol and subject that came before (by day, then id) within so many days: the earliest such row over 0.6 decides.

    Rows do not meet: a word set of a symbol and subject (`said`) stands for its rows, with the first id of each day. Different sets meet in a similarity
    join, and the first day of a set within reach comes out of one running window over its days.
    """
    repeated = F.concat_ws(" ", "subject", "details").rlike("(?i)" + rules.REPEATED)
    fixed = F.when(F.col("subject").isin(rules.RECURRING_SUBJECTS), 0.1).when(repeated, 0.2)
    keyed = rows.select("id", "day", F.concat_ws("\u0001", "symbol", "subject").alias("key"), F.array_sort(C.words(F.col("details"))).alias("words"), fixed.alias("fixed"))
    scratch = Scratch(rows.sparkSession, "novelty")
    keyed = scratch.written(keyed.withColumn("said", F.unhex(F.sha2(F.concat_ws("\u0002", "key", F.array_join("words", " ")), 256))), "rows")
    cells = keyed.where("day is not null").groupBy("said", "day").agg(F.min("id").alias("first"), F.first("key").alias("key"), F.first("words").alias("words"), F.bool_or(F.col("fixed").isNull()).alias("asks"))
    cells = scratch.written(cells, "cells")
    pairs = _alike_sets(cells)
    asked = cells.where("asks").select(F.col("said").alias("a"), "day").join(pairs, "a").select("a", "day", "b", "sim", F.date_sub("day", days).alias("from"))
    old = F.struct(F.col("day").alias("day"), F.col("first").alias("id"))
    told = cells.select(F.col("said").alias("b"), F.col("day").alias("from"), old.alias("old")).unionByName(asked.select("b", "from").distinct(), allowMissingColumns=True)
    # from the last day to the first: what a question has last seen is the first day from its own on
    back = Window.partitionBy("b").orderBy(F.desc("from"), F.col("old").isNull())
    seen = told.select("b", "from", F.col("old").isNull().alias("question"), F.last("old", ignorenulls=True).over(back).alias("old")).where("question").drop("question")
    hits = asked.join(seen, ["b", "from"]).where(F.col("old.day") <= F.col("day")).groupBy(F.col("a").alias("said"), "day").agg(F.min(F.struct("old.day", "old.id", "sim")).alias("hit"))
    by_day = cells.groupBy("key", "day").agg(F.min("first").alias("first"))
    before = F.lag("day").over(Window.partitionBy("key").orderBy("day"))
    by_day = by_day.select("key", "day", F.when(F.datediff("day", before) > days, None).otherwise(before).isNotNull().alias("before"), "first")
    known = cells.select("said", "day", "key").join(by_day, ["key", "day"]).join(hits, ["said", "day"], "left").drop("key")
    out = keyed.select("id", "day", "said", "fixed").join(known, ["said", "day"], "left")
    hit = F.when(F.struct("hit.day", "hit.id") < F.struct("day", "id"), F.col("hit"))
    out = out.select("id", "fixed", hit.alias("hit"), (F.col("before") | (F.col("first") < F.col("id"))).alias("some"))
    novel = F.col("fixed").isNull() & F.col("hit").isNull()
    score = F.coalesce("fixed", C.half_up(1 - F.col("hit.sim"), 2), F.when(F.col("some"), 0.65).otherwise(0.95))
    return out.select("id", novel.alias("is_novel"), score.alias("novelty"))


def _alike_sets(cells: DataFrame) -> DataFrame:
    """a, b, sim of all sets of equal key that share over 0.6 of their words, both ways, each with itself too. cells: said, key, words."""
    sets = cells.where(F.size("words") > 0).groupBy("said").agg(F.first("key").alias("of"), F.first("words").alias("words"))
    of_key = sets.select(F.col("said").alias("key"), F.transform("words", lambda w: F.concat("of", F.lit("\u0002"), w)).alias("words"))
    found = setjoin.similar(of_key, 3, 5).where("shared * 5 > total * 3").select("a", "b", (F.col("shared") / F.col("total")).alias("sim"))
    own = sets.select(F.col("said").alias("a"), F.col("said").alias("b"), F.lit(1.0).alias("sim"))
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).unionByName(own)


_WORDS = "list_distinct(regexp_extract_all(lower(details), '[a-z]{3,}'))"


@query(f"""WITH r AS (SELECT id, concat(symbol, '|', subject) AS key, broadcast_date AS day, {_WORDS} AS w,
CASE WHEN subject IN ('Trading Window') THEN 0.1::DOUBLE WHEN regexp_matches(concat(subject, ' ', details), '{rules.REPEATED}', 'i') THEN 0.2::DOUBLE END AS fixed FROM announcements),
p AS (SELECT a.id, b.id AS old_id, b.day AS old_day, len(list_intersect(a.w, b.w))::DOUBLE / nullif(len(list_distinct(list_concat(a.w, b.w))), 0) AS sim FROM r a JOIN r b ON a.key = b.key AND a.day - b.day BETWEEN 0 AND 30 AND (b.day < a.day OR b.id < a.id) WHERE a.fixed IS NULL),
s AS (SELECT id, COUNT(*) AS n, arg_min(sim, old_day * 1000000000000 + old_id) FILTER (WHERE sim > 0.6) AS sim FROM (SELECT id, old_id, CAST(old_day - CAST('1970-01-01' AS DATE) AS BIGINT) AS old_day, sim FROM p) GROUP BY id)
SELECT r.id, r.fixed IS NULL AND s.sim IS NULL AS is_novel, coalesce(r.fixed, floor((1 - s.sim) * 100 + 0.5) / 100, CASE WHEN s.n > 0 THEN 0.65::DOUBLE ELSE 0.95::DOUBLE END) AS novelty FROM r LEFT JOIN s ON s.id = r.id""")
def F8_novelty(t: Tables) -> DataFrame:
    return novelty(t.announcements.select("id", "symbol", "subject", "details", F.col("broadcast_date").alias("day")))


@query("""SELECT a.item_id AS a, b.item_id AS b, floor(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) * 10000 + 0.5) / 10000 AS sim
FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM benchmark) a JOIN (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM benchmark) b ON a.item_id < b.item_id
WHERE len(list_intersect(a.w, b.w)) >= 2""")
def F10_jaccard_pairs(t: Tables) -> DataFrame:
    items = t.table("benchmark").select("item_id", C.words(F.col("text")).alias("w"))
    # pairs meet on a shared word, not on everything; the count of shared words comes with it
    each = items.select("item_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    other = each.select(F.col("item_id").alias("b"), F.col("n").alias("m"), "word")
    shared = each.join(other, "word").where("item_id < b").groupBy(F.col("item_id").alias("a"), "b").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("m").alias("m"))
    return shared.where("k >= 2").select("a", "b", C.half_up(F.col("k").cast("double") / (F.col("n") + F.col("m") - F.col("k")), 4).alias("sim"))


@query("""WITH w AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}'))) AS w FROM documents), c AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN doc_id ELSE MIN(doc_id) OVER (PARTITION BY w) END AS class_id FROM w),
e AS (SELECT class_id AS k, len(w) AS n, unnest(w) AS word FROM c WHERE doc_id = class_id), p AS (SELECT a.k AS a, b.k AS b, COUNT(*) AS s, MIN(a.n + b.n) AS n FROM e a JOIN e b ON a.word = b.word AND a.k <> b.k GROUP BY 1, 2),
l AS (SELECT a, COUNT(*) AS n_links, MAX(s::DOUBLE / (n - s)) AS nearest FROM p WHERE s * 5 >= (n - s) * 3 GROUP BY a)
SELECT c.doc_id, c.class_id, coalesce(l.n_links, 0) AS n_links, floor(l.nearest * 1000000 + 0.5) / 1000000 AS nearest FROM c LEFT JOIN l ON l.a = c.class_id""")
def F10_similar_documents(t: Tables) -> DataFrame:
    """Documents by their word sets: classes of equal sets, and links of 0.6 or more between classes."""
    rows = t.table("documents").select("doc_id", C.words(F.col("text")).alias("words"))
    return setjoin.links(rows, "doc_id", "words", 3, 5).withColumn("nearest", C.half_up(F.col("nearest"), 6))


@query("SELECT id, CAST(replace(substr(CAST(broadcast_date AS STRING), 1, 10), '-', '') AS INT) AS date_int FROM announcements")
def F11_date_int(t: Tables) -> DataFrame:
    return t.announcements.select("id", C.date_int(F.col("broadcast_date").cast("string")).alias("date_int"))


@query("SELECT id, md5(concat(symbol, '|', CAST(broadcast_date AS STRING), '|', subject, '|', details)) AS doc_key FROM announcements")
def F13_doc_ids(t: Tables) -> DataFrame:
    return t.announcements.select("id", C.doc_id(F.col("symbol"), F.col("broadcast_date").cast("string"), F.col("subject"), F.col("details")).alias("doc_key"))


@query("""SELECT id, CASE id % 5 WHEN 0 THEN broadcast_date WHEN 1 THEN broadcast_date - 1 WHEN 2 THEN CAST(date_trunc('week', broadcast_date) AS DATE) WHEN 3 THEN CAST(date_trunc('month', broadcast_date) AS DATE) ELSE broadcast_date - 7 END AS first_day FROM announcements""")
def F20_date_ranges(t: Tables) -> DataFrame:
    phrase = F.element_at(F.array(*map(F.lit, ("orders today", "orders of yesterday", "this week", "this month", "last 7 days"))), (F.col("id") % 5 + 1).cast("int"))
    return t.announcements.select("id", C.range_start(phrase, F.col("broadcast_date")).alias("first_day"))


@query("""SELECT id, concat('Q', CAST(quarter(broadcast_date - INTERVAL 3 MONTH) AS STRING), ' FY', CAST(CASE WHEN month(broadcast_date) >= 4 THEN year(broadcast_date) + 1 ELSE year(broadcast_date) END AS STRING)) AS label FROM announcements""")
def F28_period_label(t: Tables) -> DataFrame:
    return t.announcements.select("id", C.period_label(F.col("broadcast_date")).alias("label"))


@query("SELECT DISTINCT period, concat(substr(period, 1, 4), lpad(CAST(CAST(substr(period, 5) AS INT) - 1 AS STRING), 2, '0')) AS prior FROM results")
def F30_prior_period(t: Tables) -> DataFrame:
    return t.results.select("period", C.prior_period(F.col("period")).alias("prior")).distinct()


@query("SELECT symbol, CASE WHEN market_cap >= 20000 THEN 'Large' WHEN market_cap >= 5000 THEN 'Mid' WHEN market_cap > 0 THEN 'Small' END AS cap FROM companies")
def F47_cap_class(t: Tables) -> DataFrame:
    return t.companies.select("symbol", C.cap_class(F.lit(None).cast("string"), F.col("market_cap")).alias("cap"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def F49_json_field(t: Tables) -> DataFrame:
    return t.table("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""SELECT symbol, COUNT(*) AS n, array_to_string(list(concat('[', CAST(score AS STRING), '] ', subject) ORDER BY score DESC, id), '; ') AS line FROM announcements GROUP BY symbol""")
def F45_brief_lines(t: Tables) -> DataFrame:
    rows = t.announcements
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", F.concat(F.lit("["), F.col("score").cast("string"), F.lit("] "), F.col("subject")).alias("text"))))
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x.text), "; ").alias("line"))


@query("SELECT symbol, subject, MIN(id) AS id FROM (SELECT symbol, subject, id, row_number() OVER (PARTITION BY symbol, subject, broadcast_date ORDER BY id) AS rn FROM announcements) WHERE rn > 1 GROUP BY symbol, subject")
def K17_repeats(t: Tables) -> DataFrame:
    w = Window.partitionBy("symbol", "subject", "broadcast_date").orderBy("id")
    return t.announcements.withColumn("rn", F.row_number().over(w)).where("rn > 1").groupBy("symbol", "subject").agg(F.min("id").alias("id"))
