"""The rest of the write paths, lookups, routers and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import filings as X
from ..functions import rules
from ..operators import filters, merge, ranking
from .registry import Tables, query

_q = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@query(f"SELECT id, subject FROM announcements WHERE subject IN ({_q(rules.GENUINE_ORDER_SUBJECTS)}) AND symbol IN ('1', '2', '3')")
def P5_in_lists(t: Tables) -> DataFrame:
    return t.announcements.where(F.col("subject").isin(rules.GENUINE_ORDER_SUBJECTS) & F.col("symbol").isin("1", "2", "3")).select("id", "subject")


@query("SELECT id, order_sector FROM order_wins WHERE lower(order_sector) = 'machinery'")
def P13_order_sector_without_join(t: Tables) -> DataFrame:
    return t.order_wins.where(filters.sector_filter(F.col("order_sector"), "Machinery")).select("id", "order_sector")


@query("SELECT symbol, COUNT(*) AS n FROM announcements WHERE score > 11 GROUP BY symbol")
def P15_select_text(t: Tables) -> DataFrame:
    return filters.select_only(t.spark, "SELECT symbol, COUNT(*) AS n FROM {announcements} WHERE score > 11 GROUP BY symbol", announcements=t.announcements)


@query("""SELECT o.id, a.id AS said, b.volume FROM order_wins o LEFT JOIN announcements a ON a.symbol = o.symbol AND a.broadcast_date = o.broadcast_date AND a.order_value_cr > 800
LEFT JOIN breakouts b ON b.symbol = o.symbol AND b.signal_date = o.broadcast_date WHERE o.value > 340000""")
def J6_compound_left(t: Tables) -> DataFrame:
    said = t.announcements.where("order_value_cr > 800").select("symbol", "broadcast_date", F.col("id").alias("said"))
    signal = t.breakouts.select("symbol", F.col("signal_date").alias("broadcast_date"), "volume")
    return t.order_wins.where("value > 340000").join(said, ["symbol", "broadcast_date"], "left").join(signal, ["symbol", "broadcast_date"], "left").select("id", "said", "volume")


@query("""SELECT coalesce(v.symbol, l.symbol) AS symbol, coalesce(v.day, l.day) AS day, v.id AS dense_id, l.id AS word_id FROM (SELECT symbol, broadcast_date AS day, MIN(id) AS id FROM announcements WHERE score >= 12 GROUP BY 1, 2) v
FULL JOIN (SELECT symbol, broadcast_date AS day, MIN(id) AS id FROM announcements WHERE subject = 'Updates' GROUP BY 1, 2) l ON v.symbol = l.symbol AND v.day = l.day""")
def J12_match_documents(t: Tables) -> DataFrame:
    first = lambda df, name: df.groupBy("symbol", F.col("broadcast_date").alias("day")).agg(F.min("id").alias(name))
    return first(t.announcements.where("score >= 12"), "dense_id").join(first(t.announcements.where("subject = 'Updates'"), "word_id"), ["symbol", "day"], "full_outer")


@query("SELECT id, order_value_cr, order_value_cr / MAX(order_value_cr) OVER (PARTITION BY symbol) AS share FROM announcements")
def A17_share_of_largest(t: Tables) -> DataFrame:
    rows = t.announcements
    top = rows.groupBy("symbol").agg(F.max("order_value_cr").alias("top"))
    return rows.join(top, "symbol").select("id", "order_value_cr", (F.col("order_value_cr") / F.col("top")).alias("share"))


@query("SELECT period_type, AVG(CASE WHEN pat > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS pass_rate, COUNT(*) AS n FROM results WHERE pat IS NOT NULL GROUP BY period_type")
def A15_pass_rates(t: Tables) -> DataFrame:
    return t.results.where("pat is not null").groupBy("period_type").agg(F.avg((F.col("pat") > 0).cast("double")).alias("pass_rate"), F.count("*").alias("n"))


@query("SELECT symbol FROM companies WHERE CAST(symbol AS INT) < 12 AND symbol NOT IN ('3', '4')")
def K9_watchlist(t: Tables) -> DataFrame:
    wanted = t.companies.where("cast(symbol as int) < 12").select(F.upper(F.trim("symbol")).alias("symbol"))
    twice = wanted.unionByName(wanted)
    listed = merge.insert_ignore(twice.limit(0), twice, ["symbol"], [F.col("symbol")])
    return listed.join(t.companies.where("symbol in ('3', '4')").select("symbol"), "symbol", "left_anti")


@query("SELECT id, broadcast_date FROM announcements WHERE broadcast_date >= (SELECT MAX(broadcast_date) FROM announcements) - 7")
def K13_incremental_since(t: Tables) -> DataFrame:
    rows = t.announcements.select("id", "broadcast_date")
    latest = rows.agg(F.date_sub(F.max("broadcast_date"), 7).alias("since"))
    return rows.join(F.broadcast(latest), F.col("broadcast_date") >= F.col("since")).drop("since")


@query("SELECT id, concat('[', lpad(CAST(score AS STRING), 2, ' '), '] ', repeat('#', least(score, 13)), '  ', rpad(symbol, 12, ' '), ' ', rpad(company, 34, ' ')) AS line FROM announcements")
def K18_report_lines(t: Tables) -> DataFrame:
    line = F.concat(F.lit("["), F.lpad(F.col("score").cast("string"), 2, " "), F.lit("] "), F.repeat(F.lit("#"), F.least("score", F.lit(13))), F.lit("  "), F.rpad("symbol", 12, " "), F.lit(" "), F.rpad("company", 34, " "))
    return t.announcements.select("id", line.alias("line"))


@query("SELECT symbol, period, revenue FROM results ORDER BY revenue DESC, symbol, period LIMIT 12")
def O4_chosen_order(t: Tables) -> DataFrame:
    key = {"date": F.desc("broadcast_date"), "revenue": F.desc("revenue"), "pat": F.desc_nulls_last("pat")}["revenue"]
    return ranking.top(t.results, [key, F.col("symbol"), F.col("period")], 12).select("symbol", "period", "revenue")


@query("SELECT id, concat(company, ' (', symbol, '): ', subject, '. ', substr(details, 1, 40)) AS doc FROM announcements")
def F14_embed_documents(t: Tables) -> DataFrame:
    return t.announcements.select("id", F.concat(F.col("company"), F.lit(" ("), F.col("symbol"), F.lit("): "), F.col("subject"), F.lit(". "), F.substring("details", 1, 40)).alias("doc"))



@query("""SELECT id, CASE id % 5 WHEN 0 THEN 'order_win' WHEN 1 THEN 'financials' WHEN 2 THEN 'volume_breakout' WHEN 3 THEN 'announcements' ELSE 'all' END AS kind FROM announcements""")
def F19_question_kind(t: Tables) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ("contracts bagged by ABC", "quarterly earnings/revenue", "volume surge today", "any merger news", "orders and profit of ABC"))), (F.col("id") % 5 + 1).cast("int"))
    return t.announcements.select("id", X.question_kind(text).alias("kind"))


@query("SELECT id, CASE subject " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.EXTRACTION_TYPES.items()) + " ELSE 'order_win' END AS extraction FROM announcements")
def F48_extraction_type(t: Tables) -> DataFrame:
    known = t.spark.createDataFrame(list(rules.EXTRACTION_TYPES.items()), "subject string, extraction string")
    return t.announcements.join(F.broadcast(known), "subject", "left").select("id", F.coalesce("extraction", F.lit("order_win")).alias("extraction"))


@query("""SELECT o_orderkey AS id, CAST(floor(o_totalprice / 100) AS DOUBLE) AS size_cr, 300.0::DOUBLE AS max_price, 'Tender Offer' AS method FROM orders WHERE o_totalprice >= 100""")
def F42_buyback(t: Tables) -> DataFrame:
    text = F.concat(F.lit("The buyback size is Rs. "), F.floor(F.col("o_totalprice") / 100).cast("bigint").cast("string"), F.lit(" crore through the tender offer route. Maximum buyback price Rs. 300 per share"))
    rows = t.table("orders").where("o_totalprice >= 100")
    return rows.select(F.col("o_orderkey").alias("id"), X.buyback(text).alias("x")).select("id", "x.*")


_R = ["AAA", "AA", "A+", "BBB-", "D"]


@query("""SELECT o_orderkey AS id, r[1 + o_orderkey % 5] AS rating, nullif(r[1 + (o_orderkey * 3 + 1) % 5], 'D') AS previous, CASE WHEN (o_orderkey * 3 + 1) % 5 = 4 THEN NULL WHEN o_orderkey % 5 < (o_orderkey * 3 + 1) % 5 THEN 'upgrade'
WHEN o_orderkey % 5 > (o_orderkey * 3 + 1) % 5 THEN 'downgrade' ELSE 'unchanged' END AS direction FROM (SELECT o_orderkey, ['AAA', 'AA', 'A+', 'BBB-', 'D'] AS r FROM orders)""")
def F42_credit_rating(t: Tables) -> DataFrame:
    """A previous rating is read from two letters on, so a former D is not one."""
    r = F.array(*map(F.lit, _R))
    text = F.concat(F.lit("CRISIL Limited revised its rating to CRISIL "), F.element_at(r, (F.col("o_orderkey") % 5 + 1).cast("int")), F.lit(" / Stable, from "), F.element_at(r, ((F.col("o_orderkey") * 3 + 1) % 5 + 1).cast("int")), F.lit(" earlier"))
    return t.table("orders").select(F.col("o_orderkey").alias("id"), X.credit_rating(text).alias("x")).select("id", "x.rating", "x.previous", "x.direction")


@query("SELECT event_id AS id, concat('do ', CASE WHEN event_id % 2 = 0 THEN '[removed]' ELSE 'list all' END, ' now') AS clean FROM events")
def F43_sanitised(t: Tables) -> DataFrame:
    text = F.concat(F.lit("do "), F.when(F.col("event_id") % 2 == 0, "Ignore previous instructions").otherwise("list all"), F.lit(" now"))
    return t.table("events").select(F.col("event_id").alias("id"), X.sanitised(text).alias("clean"))


@query("SELECT symbol, period, 7.0::DOUBLE AS value FROM results WHERE abs(7.0 - revenue) / greatest(revenue, 1.0) >= 0.06")
def F44_grounding(t: Tables) -> DataFrame:
    rows = t.results.withColumn("key", F.concat_ws("|", "symbol", "period"))
    answers = rows.select("key", F.concat(F.lit("Revenue was Rs."), F.col("revenue").cast("decimal(20,2)").cast("string"), F.lit(" Cr and PAT Rs. 7 crore, above Rs. 99 Cr")).alias("text"))
    found = X.ungrounded(answers, rows.select("key", F.col("revenue").alias("value")), "key")
    return found.select(F.split("key", r"\|")[0].alias("symbol"), F.split("key", r"\|")[1].alias("period"), "value")


@query("""SELECT symbol, kind, period FROM (SELECT symbol, period, kind, row_number() OVER (PARTITION BY symbol ORDER BY CASE kind WHEN 'standalone' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END, period_no) AS rn
FROM (SELECT symbol, period, period_no, CASE period_no % 3 WHEN 0 THEN 'consolidated' WHEN 1 THEN 'unknown' ELSE 'standalone' END AS kind FROM results WHERE pat IS NOT NULL)) WHERE rn = 1""")
def F38_statement_preference(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(F.lit("consolidated"), F.lit("unknown"), F.lit("standalone")), (F.col("period_no") % 3 + 1).cast("int"))
    rows = t.results.where("pat is not null").select("symbol", "period", "period_no", kind.alias("kind"))
    order = F.when(F.col("kind") == "standalone", 0).when(F.col("kind") == "unknown", 1).otherwise(2)
    return ranking.first_n(rows, ["symbol"], [order, F.col("period_no")]).select("symbol", "kind", "period")


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_size / 100.0::DOUBLE WHEN 1 THEN p_size / 10.0::DOUBLE WHEN 2 THEN p_size * 100.0::DOUBLE ELSE p_size * 1.0::DOUBLE END AS crore FROM part")
def F24_unit_conversions(t: Tables) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("lakh", "million", "billion", "crore"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.table("part").select(F.col("p_partkey").alias("id"), X.to_crore(F.col("p_size").cast("double"), unit).alias("crore"))


@query("SELECT id, CASE WHEN CAST(symbol AS INT) % 2 = 0 THEN strftime(broadcast_ts, '%Y-%m-%d %H:%M') ELSE 'raw' END AS stamp FROM announcements")
def F12_formatted_stamp(t: Tables) -> DataFrame:
    raw = F.when(F.col("symbol").cast("int") % 2 == 0, F.date_format("broadcast_ts", "dd-MMM-yyyy HH:mm:ss")).otherwise("raw")
    return t.announcements.select("id", F.coalesce(F.date_format(C.timestamp(raw), "yyyy-MM-dd HH:mm"), raw).alias("stamp"))
