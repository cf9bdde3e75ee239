"""Facts from filing texts made from the order feed, and routed questions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filings as X
from ..functions import statements as S
from ..operators import routing
from ..sources.scratch import spread
from .registry import Tables, query

_TEXT = """concat('Order book crosses Rs. 25,750 crore. The company has received an order worth Rs. ', CAST(CAST(floor(o_totalprice / 100) AS BIGINT) AS STRING), CASE o_orderkey % 3 WHEN 0 THEN ' crore' WHEN 1 THEN ' lakh' ELSE ' million' END,
' from ', CASE WHEN o_orderkey % 2 = 0 THEN 'NHAI for a highway' ELSE 'a private client for solar power' END, ' to be executed in ', CAST(1 + o_orderkey % 30 AS STRING), ' months.')"""


@query(f"""SELECT o_orderkey AS id, floor(floor(o_totalprice / 100) / CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 10 END * 100 + 0.5) / 100 AS value_cr, CASE WHEN o_orderkey % 2 = 0 THEN 'Government / PSU' ELSE 'Private sector' END AS client_type,
CASE WHEN o_orderkey % 2 = 0 THEN 'roads' ELSE 'power' END AS sector, CAST(1 + o_orderkey % 30 AS INT) AS months FROM orders WHERE length({_TEXT}) > 0""")
def F25_order_win(t: Tables) -> DataFrame:
    texts = t.spark.sql(f"SELECT o_orderkey AS id, {_TEXT} AS txt FROM {{orders}}", orders=spread(t.table("orders")))
    return X.order_wins(texts, "txt").drop("txt")


@query("""SELECT o_orderkey AS id, concat('C', CAST(o_custkey AS STRING)) AS client, CAST(o_totalprice AS STRING) IS NOT NULL AS has_value FROM orders""")
def F26_highlights(t: Tables) -> DataFrame:
    text = F.concat(F.lit('["Client: old", "Value: '), F.col("o_totalprice").cast("string"), F.lit('", "no pair", "Client: C'), F.col("o_custkey").cast("string"), F.lit('"]'))
    rows = t.table("orders").select(F.col("o_orderkey").alias("id"), X.highlights(text).alias("m"))
    return rows.select("id", F.col("m")["Client"].alias("client"), F.col("m")["Value"].isNotNull().alias("has_value"))


@query("""SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS DOUBLE) / 100 AS revenue_cr, -CAST(floor(o_totalprice / 10) AS DOUBLE) / 100 AS pat_cr FROM orders WHERE floor(o_totalprice) >= 100""")
def F37_statement_results(t: Tables) -> DataFrame:
    number = lambda c: F.floor(c).cast("bigint").cast("string")
    text = F.concat(F.lit("Particulars\n1. Revenue from operations\n"), number(F.col("o_totalprice")), F.lit("\n(Loss)\nNet profit for the period ("), number(F.col("o_totalprice") / 10), F.lit(") 5"))
    pages = spread(t.table("orders")).select(F.col("o_orderkey").alias("id"), text.alias("text"))
    return X.results(S.line_values(pages, "id", "text"), "id", F.lit(0.01)).select("id", "revenue_cr", "pat_cr")


@query("""SELECT id, CASE k WHEN 0 THEN r WHEN 1 THEN r WHEN 3 THEN r END AS revenue_cr, CASE k WHEN 0 THEN p WHEN 1 THEN -p WHEN 3 THEN NULL END AS pat_cr, CASE k WHEN 0 THEN floor((p + 2.5 + 4) * 100 + 0.5) / 100 END AS ebitda_cr, CASE k WHEN 0 THEN CASE WHEN (floor((p + 2.5 + 4) * 100 + 0.5) / 100) / r <= 1 THEN floor((floor((p + 2.5 + 4) * 100 + 0.5) / 100) / r * 100 * 10 + 0.5) / 10 END END AS ebitda_margin,
CASE k WHEN 1 THEN 4.25::DOUBLE END AS eps, CASE k WHEN 0 THEN 'high' WHEN 1 THEN 'high' ELSE 'medium' END AS confidence FROM (SELECT o_orderkey AS id, o_orderkey % 4 AS k, CAST(floor(o_totalprice) AS DOUBLE) + 200 AS r, floor(floor(o_totalprice) / 10) + 150.0::DOUBLE AS p FROM orders) WHERE k <> 2 AND r <= 500000""")
def F37_results_varied(t: Tables) -> DataFrame:
    """Results from statements with operating profit made up of its parts, losses and earnings a share; amounts beyond belief give no row."""
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    r = (F.floor("o_totalprice").cast("bigint") + 200).cast("string")
    p = (F.floor(F.floor("o_totalprice") / 10).cast("bigint") + 150).cast("string")
    pages = F.element_at(F.array(
        text("Revenue from operations ", r, "\nFinance costs 2.5\nDepreciation and amortisation expense\n4.0\nProfit before tax ", p, "\nProfit after tax ", p),
        text("Net sales\n", r, "\nNet profit for the year (", p, ")\nBasic earnings per share 4.25"),
        text("Revenue from operations 9,00,00,00,000\nNet profit ", p), text("Total income ", r, "\nTax 5.5"),
    ), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = spread(t.table("orders")).select(F.col("o_orderkey").alias("id"), pages.alias("text"))
    return X.results(S.line_values(rows, "id", "text"), "id", F.lit(1.0)).select("id", "revenue_cr", "pat_cr", "ebitda_cr", "ebitda_margin", "eps", "confidence")


@query("SELECT id, score, broadcast_date FROM announcements WHERE broadcast_date = CAST('1998-05-14' AS DATE) AND score >= 6 AND order_value_cr >= 150.0 ORDER BY score DESC, broadcast_date DESC, id LIMIT 20")
def R10_structured_question(t: Tables) -> DataFrame:
    q = routing.ask(t.spark, "top orders above 150 crore with score above 6 on 14/5/1998", dt.date(1998, 6, 1))
    return routing.structured(t.announcements, q, 20).select("id", "score", "broadcast_date")
