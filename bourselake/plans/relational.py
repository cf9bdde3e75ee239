"""Filters, joins, aggregates, windows, orders and write semantics over the market-event views."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..operators import filters, joins, merge, ranking
from ..operators.bucketed import BucketTable
from ..streaming.jobs import shared_folder
from .registry import Tables, query

_DAY = "CAST('1998-06-01' AS DATE)"
_quoted = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)
day = lambda text: F.lit(text).cast("date")

# ---- aggregates


@query("""SELECT coalesce(order_sector, 'Other') AS sector, COUNT(*) AS n, CAST(SUM(coalesce(value, 0)) AS BIGINT) AS total FROM order_wins
WHERE broadcast_date BETWEEN CAST('1996-01-01' AS DATE) AND CAST('1998-12-31' AS DATE) GROUP BY 1 ORDER BY total DESC, sector LIMIT 15""")
def A1_orders_by_sector(t: Tables) -> DataFrame:
    rows = t.order_wins.where(F.col("broadcast_date").between(day("1996-01-01"), day("1998-12-31")))
    found = rows.groupBy(F.coalesce("order_sector", F.lit("Other")).alias("sector")).agg(F.count("*").alias("n"), F.sum(F.coalesce("value", F.lit(0))).alias("total"))
    return ranking.top(found, [F.desc("total"), F.col("sector")], 15)


@query("SELECT broadcast_date AS day, COUNT(*) AS n, CAST(SUM(coalesce(value, 0)) AS BIGINT) AS total FROM order_wins GROUP BY 1 ORDER BY 1 DESC LIMIT 30")
def A2_orders_by_date(t: Tables) -> DataFrame:
    found = t.order_wins.groupBy(F.col("broadcast_date").alias("day")).agg(F.count("*").alias("n"), F.sum(F.coalesce("value", F.lit(0))).alias("total"))
    return ranking.top(found, [F.desc("day")], 30)


@query("""SELECT symbol, MIN(company) AS company, COUNT(*) AS n, CAST(SUM(coalesce(value, 0)) AS BIGINT) AS total FROM order_wins GROUP BY symbol ORDER BY total DESC, symbol LIMIT 20""")
def A3_orders_by_company(t: Tables) -> DataFrame:
    found = t.order_wins.groupBy("symbol").agg(F.min("company").alias("company"), F.count("*").alias("n"), F.sum(F.coalesce("value", F.lit(0))).alias("total"))
    return ranking.top(found, [F.desc("total"), F.col("symbol")], 20)


@query("SELECT symbol, MAX(score) AS best FROM announcements WHERE broadcast_date >= CAST('2001-06-01' AS DATE) GROUP BY symbol ORDER BY best DESC, symbol LIMIT 5")
def A4_top_symbols(t: Tables) -> DataFrame:
    found = t.announcements.where(F.col("broadcast_date") >= day("2001-06-01")).groupBy("symbol").agg(F.max("score").alias("best"))
    return ranking.top(found, [F.desc("best"), F.col("symbol")], 5)


@query("SELECT broadcast_date AS day, coalesce(order_sector, 'Other') AS sector, COUNT(*) AS n FROM order_wins GROUP BY 1, 2 ORDER BY n DESC, day, sector LIMIT 8")
def A5_sector_activity(t: Tables) -> DataFrame:
    found = t.order_wins.groupBy(F.col("broadcast_date").alias("day"), F.coalesce("order_sector", F.lit("Other")).alias("sector")).agg(F.count("*").alias("n"))
    return ranking.top(found, [F.desc("n"), F.col("day"), F.col("sector")], 8)


@query("SELECT COUNT(*) AS n, MIN(broadcast_date) AS first_day, MAX(broadcast_date) AS last_day, COUNT(DISTINCT symbol) AS symbols FROM announcements")
def A6_counts(t: Tables) -> DataFrame:
    return t.announcements.agg(F.count("*").alias("n"), F.min("broadcast_date").alias("first_day"), F.max("broadcast_date").alias("last_day"), F.countDistinct("symbol").alias("symbols"))


_TAGS_SQL = "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(txt, '{p}', 'i') THEN '{n}' END" for n, p in rules.SECTORS) + "], lambda x: x IS NOT NULL)), ',')"


@query(f"""SELECT tags, COUNT(*) AS n FROM (SELECT {_TAGS_SQL} AS tags FROM (SELECT concat(company, ' ', subject, ' ', details) AS txt FROM announcements)) WHERE tags <> '' GROUP BY tags ORDER BY n DESC, tags LIMIT 10""")
def A7_tag_histogram(t: Tables) -> DataFrame:
    tags = F.array_join(C.sector_tags(F.col("company"), F.col("subject"), F.col("details")), ",").alias("tags")
    return ranking.top(t.announcements.select(tags).where("tags <> ''").groupBy("tags").agg(F.count("*").alias("n")), [F.desc("n"), F.col("tags")], 10)


@query("""SELECT symbol, sector, n FROM (SELECT symbol, sector, n, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, sector) AS rn
FROM (SELECT symbol, sector, COUNT(*) AS n FROM announcements GROUP BY 1, 2)) WHERE rn = 1""")
def A8_modal_sector(t: Tables) -> DataFrame:
    return ranking.first_n(t.announcements.groupBy("symbol", "sector").agg(F.count("*").alias("n")), ["symbol"], [F.desc("n"), F.col("sector")])


@query("""SELECT COUNT(*) AS n, COUNT(CASE WHEN order_sector IS NOT NULL AND order_sector <> '' THEN 1 END) AS order_sector, COUNT(value) AS value,
COUNT(CASE WHEN source_url IS NOT NULL AND source_url <> '' THEN 1 END) AS source_url FROM order_wins""")
def A9_coverage(t: Tables) -> DataFrame:
    there = [F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(c) for c in ("order_sector", "value", "source_url")]
    return t.order_wins.agg(F.count("*").alias("n"), *there)


@query("SELECT DISTINCT symbol, sector FROM announcements")
def A10_distinct_pairs(t: Tables) -> DataFrame:
    return t.announcements.select("symbol", "sector").distinct()


@query("""SELECT symbol, period, revenue FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY revenue DESC, period_no) AS rn FROM results) WHERE rn = 1""")
def A11_best_period(t: Tables) -> DataFrame:
    return ranking.first_n(t.results, ["symbol"], [F.desc("revenue"), F.col("period_no")]).select("symbol", "period", "revenue")


@query("""SELECT word, MIN(p_partkey) AS part FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part) WHERE length(word) >= 4 GROUP BY word HAVING COUNT(DISTINCT p_partkey) = 1""")
def A12_unambiguous_words(t: Tables) -> DataFrame:
    each = t.table("part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("word")).where(F.length("word") >= 4)
    return each.groupBy("word").agg(F.min("p_partkey").alias("part"), F.max("p_partkey").alias("_max")).where("part = _max").drop("_max")


@query("""SELECT CASE WHEN NOT attachment LIKE '%.pdf' THEN 'not_pdf' WHEN subject = 'Trading Window' THEN 'skip_type' WHEN attachment IN (SELECT source_url FROM order_wins WHERE value > 300000) THEN 'stored' ELSE 'process' END AS status,
COUNT(*) AS n FROM announcements GROUP BY 1""")
def P20_candidate_counts(t: Tables) -> DataFrame:
    stored = t.order_wins.where("value > 300000").select(F.col("source_url").alias("attachment")).distinct().withColumn("_stored", F.lit(True))
    status = F.when(~F.lower("attachment").endswith(".pdf"), "not_pdf").when(F.col("subject") == "Trading Window", "skip_type").when(F.col("_stored"), "stored").otherwise("process")
    return t.announcements.join(stored, "attachment", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'ok') AS ok, COUNT(*) FILTER (WHERE status = 'too_large') AS too_large, COUNT(*) FILTER (WHERE status = 'no_attachment') AS no_attachment, COUNT(*) FILTER (WHERE status NOT IN ('ok', 'too_large', 'no_attachment')) AS failed
FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'no_attachment' WHEN l_quantity > 45 THEN 'too_large' WHEN l_returnflag = 'N' AND l_tax > 0.07 THEN 'parse_failed' ELSE 'ok' END AS status FROM lineitem)""")
def A13_status_tally(t: Tables) -> DataFrame:
    """Counters of a run: how each item ended."""
    status = F.when(F.col("l_returnflag") == "R", "no_attachment").when(F.col("l_quantity") > 45, "too_large").when((F.col("l_returnflag") == "N") & (F.col("l_tax") > 0.07), "parse_failed").otherwise("ok")
    known = ["ok", "too_large", "no_attachment"]
    rows = t.table("lineitem").select(status.alias("status"))
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == k).alias(k) for k in known], F.count_if(~F.col("status").isin(known)).alias("failed"))


# ---- predicates


@query("SELECT id, subject FROM announcements WHERE subject IN (" + _quoted(rules.KEEP_SUBJECTS) + ") AND subject NOT IN (" + _quoted(rules.DROP_SUBJECTS) + ")")
def P1_subject_gate(t: Tables) -> DataFrame:
    return t.announcements.where(C.subject_gate(F.col("subject"))).select("id", "subject")


@query("SELECT id, score FROM announcements WHERE score >= 4 AND broadcast_date = CAST('1997-03-03' AS DATE)")
def P3_score_threshold(t: Tables) -> DataFrame:
    return t.announcements.where((F.col("score") >= 4) & (F.col("broadcast_date") == day("1997-03-03"))).select("id", "score")


@query("SELECT id, broadcast_date FROM announcements WHERE broadcast_date >= CAST('2001-07-02' AS DATE)")
def P4_since(t: Tables) -> DataFrame:
    return t.announcements.where(filters.all_of(filters.since(F.col("broadcast_date"), day("2001-08-01"), 30), None)).select("id", "broadcast_date")


@query("SELECT id, company FROM announcements WHERE lower(sector) LIKE '%build%' AND lower(subject) LIKE '%order%'")
def P6_contains(t: Tables) -> DataFrame:
    return t.announcements.where(F.lower("sector").contains("build") & F.lower("subject").contains("order")).select("id", "company")


@query("SELECT symbol, period, period_type FROM results WHERE period_type NOT IN ('order_win', 'press_release', 'concall')")
def P8_not_in_types(t: Tables) -> DataFrame:
    return t.results.where(~F.col("period_type").isin("order_win", "press_release", "concall")).select("symbol", "period", "period_type")


@query("SELECT symbol, period FROM results WHERE (revenue IS NOT NULL OR pat IS NOT NULL) AND NOT (revenue > 400000 AND pat IS NULL)")
def P10_compound_null(t: Tables) -> DataFrame:
    rev, pat = F.col("revenue"), F.col("pat")
    return t.results.where((rev.isNotNull() | pat.isNotNull()) & ~((rev > 400000) & pat.isNull())).select("symbol", "period")


@query("SELECT id, symbol FROM announcements WHERE (symbol = '3' OR score > 10) AND sector IS DISTINCT FROM 'BUILDING' AND order_value_cr >= 300")
def P11_where_tree(t: Tables) -> DataFrame:
    tree = {"$and": [{"$or": [{"symbol": "3"}, {"score": {"$gt": 10}}]}, {"sector": {"$ne": "BUILDING"}}, {"order_value_cr": {"$gte": 300.0}}]}
    return t.announcements.where(filters.where_tree(tree)).select("id", "symbol")


@query("SELECT symbol, period FROM results WHERE period_type IN ('quarterly', 'financial_results')")
def P12_period_types(t: Tables) -> DataFrame:
    return t.results.where(F.col("period_type").isin(filters.period_types("quarterly"))).select("symbol", "period")


@query("SELECT id, CASE WHEN NOT genuine AND value / 1000.0 > 500 THEN NULL ELSE value / 1000.0 END AS capped FROM order_wins WHERE value / 1000.0 >= 100")
def P14_value_cap(t: Tables) -> DataFrame:
    value = F.col("value") / 1000.0
    return t.order_wins.where(value >= 100).select("id", filters.capped_value(value, F.col("genuine")).alias("capped"))


@query("SELECT id, substr(details, 1, 30) AS short, substr(CAST(broadcast_date AS STRING), 1, 7) AS month FROM announcements WHERE attachment LIKE '%7.pdf'")
def P17_truncated(t: Tables) -> DataFrame:
    return t.announcements.where(F.col("attachment").endswith("7.pdf")).select("id", F.substring("details", 1, 30).alias("short"), F.substring(F.col("broadcast_date").cast("string"), 1, 7).alias("month"))


@query("SELECT id, subject, broadcast_date FROM announcements WHERE symbol = '7' ORDER BY broadcast_date DESC, id DESC LIMIT 20")
def P21_point_lookup(t: Tables) -> DataFrame:
    return ranking.top(t.announcements.where(F.col("symbol") == "7"), [F.desc("broadcast_date"), F.desc("id")], 20).select("id", "subject", "broadcast_date")


# ---- joins


@query("SELECT r.symbol, r.period, r.revenue, s.sector FROM results r JOIN stock_sectors s ON r.symbol = s.symbol WHERE lower(s.sector) = 'asia'")
def J1_results_by_sector(t: Tables) -> DataFrame:
    return t.results.join(t.stock_sectors.where(filters.sector_filter(F.col("sector"), "Asia")), "symbol").select("symbol", "period", "revenue", "sector")


@query("SELECT o.id, o.symbol, s.sector FROM order_wins o JOIN stock_sectors s ON o.symbol = s.symbol WHERE o.value >= 250000")
def J2_orders_by_sector(t: Tables) -> DataFrame:
    return t.order_wins.where("value >= 250000").select("id", "symbol").join(t.stock_sectors, "symbol")


@query("SELECT b.symbol, b.signal_date, coalesce(b.sector, s.sector) AS sector FROM breakouts b LEFT JOIN stock_sectors s ON b.symbol = s.symbol")
def J3_breakouts_sector(t: Tables) -> DataFrame:
    known = t.stock_sectors.select("symbol", F.col("sector").alias("known"))
    return t.breakouts.join(known, "symbol", "left").select("symbol", "signal_date", F.coalesce("sector", "known").alias("sector"))


@query("SELECT o.id, coalesce(a.subject, 'Order') AS subject, a.id AS said FROM order_wins o LEFT JOIN announcements a ON a.attachment = o.source_url")
def J4_orders_left_url(t: Tables) -> DataFrame:
    """An order has a row for every announcement with its URL."""
    other = t.announcements.select(F.col("attachment").alias("source_url"), "subject", F.col("id").alias("said"))
    pairs = joins.left_in_pieces(t.order_wins.select("id", "source_url"), other, "source_url", "id", "said")
    return pairs.select("id", F.coalesce("subject", F.lit("Order")).alias("subject"), "said")


@query(f"""SELECT o.id, CASE WHEN a.subject IN ({_quoted(rules.GENUINE_ORDER_SUBJECTS)}) THEN 1 ELSE 0 END AS from_genuine FROM order_wins o
LEFT JOIN (SELECT attachment, arg_min(subject, id) AS subject FROM announcements GROUP BY attachment) a ON a.attachment = o.source_url""")
def J5_genuine_flag(t: Tables) -> DataFrame:
    first = t.announcements.groupBy(F.col("attachment").alias("source_url")).agg(F.min_by("subject", "id").alias("subject"))
    return t.order_wins.join(first, "source_url", "left").select("id", F.coalesce(F.col("subject").isin(rules.GENUINE_ORDER_SUBJECTS).cast("int"), F.lit(0)).alias("from_genuine"))


@query("""SELECT symbol, company, day, signal_date FROM (SELECT a.symbol, a.company, a.broadcast_date AS day, b.signal_date,
row_number() OVER (PARTITION BY a.symbol ORDER BY a.broadcast_date DESC, a.id DESC) AS rn FROM announcements a LEFT JOIN breakouts b ON a.symbol = b.symbol AND a.broadcast_date = b.signal_date) WHERE rn = 1""")
def J7_latest_with_breakout(t: Tables) -> DataFrame:
    latest = ranking.first_n(t.announcements, ["symbol"], [F.desc("broadcast_date"), F.desc("id")]).select("symbol", "company", F.col("broadcast_date").alias("day"))
    found = t.breakouts.select("symbol", F.col("signal_date").alias("day"), "signal_date")
    return latest.join(found, ["symbol", "day"], "left").select("symbol", "company", "day", "signal_date")


def _nearest_sql(alias: str, cond: str) -> str:
    return f"""(SELECT symbol, signal_date, id, day FROM (SELECT b.symbol, b.signal_date, a.id, a.day, row_number() OVER (PARTITION BY b.symbol, b.signal_date ORDER BY abs(a.day - b.signal_date), a.id) AS rn
FROM breakouts b JOIN {cond} a ON a.symbol = b.symbol AND abs(a.day - b.signal_date) <= 5) WHERE rn = 1) {alias}"""


@query(f"""SELECT b.symbol, b.signal_date, CASE WHEN f.id IS NOT NULL THEN 'results' WHEN o.id IS NOT NULL THEN 'order' WHEN x.id IS NOT NULL THEN 'announcement' END AS kind,
coalesce(f.id, o.id, x.id) AS catalyst, coalesce(f.day, o.day, x.day) AS day FROM breakouts b
LEFT JOIN {_nearest_sql("f", "(SELECT symbol, CAST(period_no AS BIGINT) AS id, broadcast_date AS day FROM results WHERE period_type = 'quarterly')")} ON f.symbol = b.symbol AND f.signal_date = b.signal_date
LEFT JOIN {_nearest_sql("o", "(SELECT symbol, id, broadcast_date AS day FROM announcements WHERE lower(subject) LIKE '%order%')")} ON o.symbol = b.symbol AND o.signal_date = b.signal_date
LEFT JOIN {_nearest_sql("x", "(SELECT symbol, id, broadcast_date AS day FROM announcements)")} ON x.symbol = b.symbol AND x.signal_date = b.signal_date""")
def J8_nearest_catalyst(t: Tables) -> DataFrame:
    signals = t.breakouts.select("symbol", "signal_date")
    said = t.announcements.select("symbol", "id", F.col("broadcast_date").alias("day"), F.when(F.lower("subject").contains("order"), 1).otherwise(2).alias("kind"))
    told = t.results.where("period_type = 'quarterly'").select("symbol", F.col("period_no").cast("bigint").alias("id"), F.col("broadcast_date").alias("day"), F.lit(0).alias("kind"))
    # One pass over all sources: the best kind first, in it the nearest. Any announcement may stand in for the weakest kind, orders included.
    pairs = joins.near_in_time(signals, said.unionByName(told), "symbol", "signal_date", "day", 5)
    best = ranking.first_n(pairs, ["symbol", "signal_date"], [F.col("kind"), F.abs(F.datediff("day", "signal_date")), F.col("id")])
    kind = F.when(F.col("kind") == 0, "results").when(F.col("kind") == 1, "order").when(F.col("kind") == 2, "announcement")
    return signals.join(best, ["symbol", "signal_date"], "left").select("symbol", "signal_date", kind.alias("kind"), F.col("id").alias("catalyst"), "day")


@query("""SELECT n.symbol, n.period, n.revenue, p.revenue AS prior_revenue, floor((n.revenue - p.revenue) / abs(nullif(p.revenue, 0)) * 100 * 10 + 0.5) / 10 AS growth
FROM results n LEFT JOIN results p ON p.symbol = n.symbol AND p.period = concat(substr(n.period, 1, 4), lpad(CAST(CAST(substr(n.period, 5) AS INT) - 1 AS STRING), 2, '0'))""")
def J9_yoy_growth(t: Tables) -> DataFrame:
    rows = joins.prior_year(t.results.select("symbol", "period", "revenue"), ["symbol"], "period", ["revenue"])
    return rows.withColumn("growth", C.growth(F.col("revenue"), F.col("prior_revenue")))


@query("""SELECT b.symbol, b.signal_date, o.order_id, r.period FROM (SELECT symbol, MAX(signal_date) AS signal_date FROM breakouts WHERE volume > 150 GROUP BY symbol) b
JOIN (SELECT symbol, MAX(id) AS order_id FROM order_wins WHERE value > 300000 GROUP BY symbol) o ON o.symbol = b.symbol
JOIN (SELECT symbol, arg_max(period, period_no) AS period FROM results WHERE pat IS NOT NULL GROUP BY symbol) r ON r.symbol = b.symbol""")
def J11_multi_hop(t: Tables) -> DataFrame:
    pools = [
        t.breakouts.where("volume > 150").groupBy("symbol").agg(F.max("signal_date").alias("signal_date")),
        t.order_wins.where("value > 300000").groupBy("symbol").agg(F.max("id").alias("order_id")),
        t.results.where("pat is not null").groupBy("symbol").agg(F.max_by("period", "period_no").alias("period")),
    ]
    return joins.in_all(pools, "symbol")


@query("""SELECT o.id, coalesce(a.score, 0) AS score, coalesce(a.sector, '') AS sector FROM order_wins o LEFT JOIN (SELECT * FROM (SELECT symbol, broadcast_date, score, sector,
row_number() OVER (PARTITION BY symbol, broadcast_date ORDER BY id DESC) AS rn FROM announcements WHERE subject = 'Updates') WHERE rn = 1) a ON a.symbol = o.symbol AND a.broadcast_date = o.broadcast_date""")
def J13_enrich_lookup(t: Tables) -> DataFrame:
    right = t.announcements.where("subject = 'Updates'").select("id", "symbol", "broadcast_date", "score", "sector")
    left = t.order_wins.select("id", "symbol", "broadcast_date")
    return joins.lookup(left, right, ["symbol", "broadcast_date"], {"score": 0, "sector": ""}, [F.desc("id")]).select("id", "score", "sector")


@query("SELECT DISTINCT broadcast_date AS day FROM announcements WHERE broadcast_date NOT IN (SELECT signal_date FROM breakouts)")
def J14_missing_dates(t: Tables) -> DataFrame:
    return t.announcements.select(F.col("broadcast_date").alias("day")).distinct().join(t.breakouts.select(F.col("signal_date").alias("day")), "day", "left_anti")


@query("""SELECT c.symbol, c.company, s.sector FROM companies c LEFT JOIN (SELECT symbol, order_sector AS sector FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY broadcast_date DESC, id DESC) AS rn
FROM order_wins WHERE order_sector IS NOT NULL AND order_sector <> '') WHERE rn = 1) s ON s.symbol = c.symbol""")
def J16_latest_tag(t: Tables) -> DataFrame:
    latest = t.order_wins.where("order_sector is not null and order_sector <> ''").groupBy("symbol").agg(F.max_by("order_sector", F.struct("broadcast_date", "id")).alias("sector"))
    return t.companies.select("symbol", "company").join(latest, "symbol", "left")


@query("""SELECT w.symbol, b.signal_date, b.close, r.period, r.revenue FROM (SELECT symbol FROM companies WHERE CAST(symbol AS INT) % 3 = 1) w
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY signal_date DESC) AS rn FROM breakouts) WHERE rn = 1) b ON b.symbol = w.symbol
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period_no DESC) AS rn FROM results) WHERE rn = 1) r ON r.symbol = w.symbol""")
def J17_watchlist(t: Tables) -> DataFrame:
    watched = t.companies.where("cast(symbol as int) % 3 = 1").select("symbol")
    signal = ranking.first_n(t.breakouts, ["symbol"], [F.desc("signal_date")]).select("symbol", "signal_date", "close")
    result = ranking.first_n(t.results, ["symbol"], [F.desc("period_no")]).select("symbol", "period", "revenue")
    return watched.join(signal, "symbol", "left").join(result, "symbol", "left")


@query("""SELECT id, MIN(source) AS source FROM (SELECT id, 0 AS source FROM order_wins WHERE value > 300000 UNION ALL SELECT id, 1 AS source FROM announcements WHERE score >= 12) GROUP BY id""")
def J18_merged_lists(t: Tables) -> DataFrame:
    lists = [t.order_wins.where("value > 300000").select("id", F.lit(0).alias("source")), t.announcements.where("score >= 12").select("id", F.lit(1).alias("source"))]
    return ranking.merged_first(lists, "id", [F.col("id")])


@query("""SELECT b.symbol, b.signal_date, coalesce(b.sector, s.sector, c.sector, '') AS sector, CASE WHEN lower(t) LIKE '%small%' THEN 'Small' WHEN lower(t) LIKE '%mid%' THEN 'Mid' WHEN lower(t) LIKE '%large%' THEN 'Large'
WHEN v >= 20000 THEN 'Large' WHEN v >= 5000 THEN 'Mid' WHEN v > 0 THEN 'Small' END AS cap FROM (SELECT *, CASE volume % 5 WHEN 0 THEN 'Small Cap' WHEN 1 THEN 'MIDCAP 100' WHEN 2 THEN 'large' WHEN 3 THEN NULL ELSE '' END AS t, (volume % 40) * 1000.0::DOUBLE AS v FROM breakouts) b
LEFT JOIN stock_sectors s ON s.symbol = b.symbol LEFT JOIN companies c ON c.symbol = b.symbol""")
def J19_cap_sector_fallback(t: Tables) -> DataFrame:
    text = F.element_at(F.array(F.lit("Small Cap"), F.lit("MIDCAP 100"), F.lit("large"), F.lit(None), F.lit("")), (F.col("volume") % 5 + 1).cast("int"))
    rows = t.breakouts.join(t.stock_sectors.select("symbol", F.col("sector").alias("known")), "symbol", "left").join(t.companies.select("symbol", F.col("sector").alias("said")), "symbol", "left")
    return rows.select("symbol", "signal_date", F.coalesce("sector", "known", "said", F.lit("")).alias("sector"), C.cap_class(text, (F.col("volume") % 40) * 1000.0).alias("cap"))


# ---- windows and orders


@query("""SELECT symbol, period, revenue FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY broadcast_date DESC, period_no DESC) AS rn FROM results WHERE period_type <> 'order_win') WHERE rn = 1
ORDER BY coalesce(revenue, 0) DESC, symbol LIMIT 15""")
def W1_latest_per_symbol(t: Tables) -> DataFrame:
    latest = ranking.first_n(t.results.where("period_type <> 'order_win'"), ["symbol"], [F.desc("broadcast_date"), F.desc("period_no")])
    return ranking.top(latest, [F.coalesce("revenue", F.lit(0.0)).desc(), F.col("symbol")], 15).select("symbol", "period", "revenue")


@query("""SELECT symbol, id, value FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY broadcast_date DESC, value DESC NULLS LAST, id) AS rn FROM order_wins) WHERE rn = 1 ORDER BY coalesce(value, 0) DESC, symbol LIMIT 12""")
def W2_best_order_per_symbol(t: Tables) -> DataFrame:
    best = ranking.first_n(t.order_wins, ["symbol"], [F.desc("broadcast_date"), F.desc_nulls_last("value"), F.col("id")])
    return ranking.top(best, [F.coalesce("value", F.lit(0)).desc(), F.col("symbol")], 12).select("symbol", "id", "value")


@query("SELECT symbol, id, CAST(rn AS INT) AS rn FROM (SELECT symbol, id, row_number() OVER (PARTITION BY symbol ORDER BY broadcast_date DESC, id DESC) AS rn FROM announcements) WHERE rn <= 5")
def W3_last_n(t: Tables) -> DataFrame:
    ranked = ranking.with_rank(t.announcements, ["symbol"], [F.desc("broadcast_date"), F.desc("id")], "rn")
    return ranked.where("rn <= 5").select("symbol", "id", "rn")


@query("SELECT CASE WHEN n > 0 THEN concat(key, '_', CAST(n AS STRING)) ELSE key END AS doc_key, id FROM (SELECT concat(symbol, '-', CAST(broadcast_date AS STRING)) AS key, id, row_number() OVER (PARTITION BY symbol, broadcast_date ORDER BY id) - 1 AS n FROM announcements)")
def W5_duplicate_ordinal(t: Tables) -> DataFrame:
    rows = t.announcements.select(F.concat("symbol", F.lit("-"), F.col("broadcast_date").cast("string")).alias("doc_key"), "id")
    return merge.suffixed(rows, "doc_key", [F.col("id")])


@query("SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(CAST('1998-05-04' AS DATE), CAST('1998-06-01' AS DATE), INTERVAL 1 DAY)) AS d) WHERE dayofweek(CAST(d AS DATE)) NOT IN (0, 6) ORDER BY day DESC LIMIT 15")
def W6_trading_days(t: Tables) -> DataFrame:
    days = t.spark.range(1).select(F.explode(F.sequence(day("1998-05-04"), day("1998-06-01"))).alias("day"))
    return ranking.top(days.where(~F.dayofweek("day").isin(1, 7)), [F.desc("day")], 15)


@query("SELECT id, score, broadcast_date FROM announcements ORDER BY score DESC, broadcast_date DESC, id LIMIT 25")
def O1_score_then_date(t: Tables) -> DataFrame:
    return ranking.top(t.announcements.select("id", "score", "broadcast_date"), [F.desc("score"), F.desc("broadcast_date"), F.col("id")], 25)


@query("SELECT symbol, period, pat FROM results ORDER BY coalesce(pat, -1000000000.0) DESC, symbol, period LIMIT 40")
def O2_sentinel_sort(t: Tables) -> DataFrame:
    return ranking.top(t.results.select("symbol", "period", "pat"), [F.coalesce("pat", F.lit(-1e9)).desc(), F.col("symbol"), F.col("period")], 40)


@query("SELECT id, value FROM order_wins ORDER BY value DESC NULLS LAST, id LIMIT 30")
def O3_nulls_last(t: Tables) -> DataFrame:
    return ranking.top(t.order_wins.select("id", "value"), [F.desc_nulls_last("value"), F.col("id")], 30)


@query("SELECT symbol, period, pat FROM results WHERE pat IS NOT NULL ORDER BY pat DESC, symbol, period LIMIT 10")
def O6_top_by_pat(t: Tables) -> DataFrame:
    return ranking.top(t.results.where("pat is not null").select("symbol", "period", "pat"), [F.desc("pat"), F.col("symbol"), F.col("period")], 10)


@query("""SELECT kind, id, day FROM (SELECT 'order' AS kind, id, broadcast_date AS day FROM order_wins UNION ALL SELECT 'announcement' AS kind, id, broadcast_date AS day FROM announcements) ORDER BY day DESC, id, kind LIMIT 30""")
def O7_concat_sort_limit(t: Tables) -> DataFrame:
    part = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", F.col("broadcast_date").alias("day"))
    return ranking.top(part(t.order_wins, "order").unionByName(part(t.announcements, "announcement")), [F.desc("day"), F.col("id"), F.col("kind")], 30)


@query("SELECT symbol, per_chg, close FROM breakouts WHERE signal_date = CAST('1997-03-03' AS DATE) AND CAST(symbol AS INT) % 2 = 0 ORDER BY per_chg DESC, symbol")
def O8_alerts(t: Tables) -> DataFrame:
    watched = t.companies.where("cast(symbol as int) % 2 = 0").select("symbol")
    return t.breakouts.where(F.col("signal_date") == day("1997-03-03")).join(watched, "symbol", "left_semi").select("symbol", "per_chg", "close").orderBy(F.desc("per_chg"), "symbol")


# ---- write semantics


@query("""SELECT symbol, broadcast_date, subject, id FROM (SELECT *, row_number() OVER (PARTITION BY symbol, broadcast_date, subject ORDER BY CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END, id) AS rn, MAX(CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, broadcast_date, subject) AS old FROM announcements) WHERE id % 5 = 0 OR (old = 0 AND rn = 1)""")
def K1_insert_ignore(t: Tables) -> DataFrame:
    rows = t.announcements.select("symbol", "broadcast_date", "subject", "id")
    return merge.insert_ignore(rows.where("id % 5 = 0"), rows.where("id % 5 <> 0"), ["symbol", "broadcast_date", "subject"], [F.col("id")])


@query("""SELECT symbol, signal_date, CAST(volume AS BIGINT) AS volume FROM (SELECT symbol, signal_date, volume + 1 AS volume FROM breakouts WHERE volume % 2 = 0 UNION ALL SELECT symbol, signal_date, volume FROM breakouts WHERE volume % 2 <> 0)""")
def K7_upsert(t: Tables) -> DataFrame:
    rows = t.breakouts.select("symbol", "signal_date", "volume")
    batch = rows.where("volume % 2 = 0").select("symbol", "signal_date", F.explode(F.array(F.col("volume"), F.col("volume") + 1)).alias("volume"))
    table = BucketTable(t.spark, f"{shared_folder(t.spark)}/breakouts-{uuid.uuid4().hex}", ["symbol", "signal_date"], 16)
    table.upsert(rows, [F.col("volume")])
    table.upsert(batch, [F.col("volume")])
    return table.read()


@query("""SELECT symbol, day, id FROM (SELECT a.symbol, a.broadcast_date AS day, a.id FROM announcements a WHERE a.id % 10 = 3 UNION ALL
SELECT a.symbol, a.broadcast_date AS day, a.id FROM announcements a WHERE a.id % 10 <> 3 AND NOT EXISTS (SELECT 1 FROM announcements b WHERE b.id % 10 = 3 AND b.symbol = a.symbol AND b.broadcast_date = a.broadcast_date))""")
def K11_replace_partition(t: Tables) -> DataFrame:
    rows = t.announcements.select("symbol", F.col("broadcast_date").alias("day"), "id")
    return merge.replace_groups(rows.where("id % 10 <> 3"), rows.where("id % 10 = 3"), ["symbol", "day"])


@query("""SELECT id, coalesce(order_sector, CASE WHEN genuine THEN 'genuine' ELSE 'unknown' END) AS order_sector FROM order_wins""")
def K15_fill_missing(t: Tables) -> DataFrame:
    return t.order_wins.select("id", F.when(F.col("order_sector").isNull(), F.when(F.col("genuine"), "genuine").otherwise("unknown")).otherwise(F.col("order_sector")).alias("order_sector"))
