"""The facts of a day's market brief as text, for every day at once: each section is a ranking within the day, a day's lines meet in the end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_n, with_rank

# Words, limits and wording must be these for the results to be right.
BOILERPLATE = ["not disclosed", "confidential", "cannot disclose", "commercial issue", "not be disclosed", "withheld", "order(s)/contract(s)"]
FUNDRAISING = ["qip", "allotment", "preferential", "fundrais", "ncd", "debenture"]
DEALS = ["acqui", "merger", "amalgam", "takeover"]
ORDERS, RESULTS, OTHERS, RAISED, DEALT, SECTORS = 20, 20, 60, 5, 3, 8
NO_RESULT = ["order_win", "acquisition", "restructuring", "credit_rating", "cirp", "fundraising", "buyback", "open_offer", "summary_only", "press_release"]


def _has(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(F.coalesce(text, F.lit(""))).contains(w) for w in words])


def _section(lines: DataFrame, no: int, header: Column | None) -> DataFrame:
    """day, at (section, place), line, from day, nth, line; the header counts the section's lines, or what `size` has."""
    rows = lines.select("day", F.struct(F.lit(no).alias("no"), F.col("nth").cast("int").alias("nth")).alias("at"), "line")
    if header is None:
        return rows
    size = F.max("size") if "size" in lines.columns else F.count("*")
    heads = lines.groupBy("day").agg(size.alias("n")).select("day", F.struct(F.lit(no).alias("no"), F.lit(-1).alias("nth")).alias("at"), header.alias("line"))
    return heads.unionByName(rows)


def market_brief(orders: DataFrame, results: DataFrame, announcements: DataFrame) -> DataFrame:
    """day and body of every day that has announcements.

    orders: id, day, symbol, company, value_cr, client, sector; of a symbol the highest value counts. results: day, symbol, period, period_type, revenue, pat, revenue_growth,
    pat_growth. announcements: id, day, stamp, symbol, subject, sector. Ties go to the smaller id, or symbol and period.
    """
    count = lambda text, tail: F.concat(F.lit(f"\n{text} ("), F.col("n").cast("string"), F.lit(tail))
    best = with_rank(orders, ["day"], [F.desc(F.coalesce("value_cr", F.lit(0.0))), F.col("id")], "nth").where(F.col("nth") <= ORDERS)
    best = first_n(best, ["day", "symbol"], [F.col("nth")])
    value = F.when(F.col("value_cr") >= 1, F.concat(F.lit("₹"), F.format_number("value_cr", 0), F.lit(" Cr"))).otherwise("value undisclosed")
    client = F.when(F.coalesce(F.col("client"), F.lit("")).eqNullSafe("") | _has(F.col("client"), BOILERPLATE), "").otherwise(F.concat(F.lit(" | from "), F.left("client", F.lit(60))))
    sector = F.when(F.coalesce("sector", F.lit("")) == "", "").otherwise(F.concat(F.lit(" | "), "sector"))
    order_lines = best.select("day", "nth", F.concat(F.lit("  "), "symbol", F.lit(" ("), F.coalesce("company", F.lit("")), F.lit(") — "), value, client, sector).alias("line"))

    fine = ~F.col("period_type").isin(NO_RESULT) & (F.col("revenue").isNotNull() | F.col("pat").isNotNull()) & ~((F.col("revenue") > 100_000) & F.col("pat").isNull())
    told = with_rank(results.where(F.coalesce(fine, F.lit(False))), ["day"], [F.desc(F.coalesce("revenue_growth", F.lit(-999.0))), F.col("symbol"), F.col("period")], "nth").where(F.col("nth") <= RESULTS)
    crore = lambda name, c: F.concat(F.lit(f"{name} ₹"), F.format_number(c, 0), F.lit(" Cr"))
    grown = lambda name, c: F.when((F.col(c) != 0) & (F.col(c) > -900), F.concat(F.lit(f"{name} "), F.format_string("%+.1f", c), F.lit("%")))
    bits = F.concat_ws(" | ", F.when(F.col("revenue") > 0, crore("Rev", "revenue")), F.when(F.col("pat") != 0, crore("PAT", "pat")), grown("PAT", "pat_growth"), grown("Rev", "revenue_growth"))
    result_lines = told.select("day", "nth", F.concat(F.lit("  "), "symbol", F.lit(" ["), "period", F.lit("] — "), bits).alias("line"))

    others = with_rank(announcements.where(~F.lower("subject").contains("order")), ["day"], [F.desc("stamp"), F.col("id")], "nth").where(F.col("nth") <= OTHERS)

    def group(words: list[str], most: int) -> DataFrame:
        rows = with_rank(others.where(_has(F.col("subject"), words)), ["day"], [F.col("nth")], "place")
        sized = rows.join(rows.groupBy("day").agg(F.count("*").alias("size")), "day")
        return sized.where(F.col("place") <= most).select("day", F.col("place").alias("nth"), F.concat(F.lit("  "), "symbol", F.lit(" — "), "subject").alias("line"), "size")

    boards = others.where(_has(F.col("subject"), ["board"])).groupBy("day").agg(F.count("*").alias("n"))
    boards = boards.select("day", F.lit(0).alias("nth"), F.concat(F.lit("\nBOARD MEETINGS ("), F.col("n").cast("string"), F.lit(" outcomes today)")).alias("line"))
    active = announcements.groupBy("day", F.coalesce("sector", F.lit("Other")).alias("sector")).agg(F.count("*").alias("n"))
    active = with_rank(active, ["day"], [F.desc("n"), F.col("sector")], "nth").where(F.col("nth") <= SECTORS)
    active = active.select("day", "nth", F.concat(F.lit("  "), "sector", F.lit(": "), F.col("n").cast("string"), F.lit(" announcements")).alias("line"))
    totals = announcements.groupBy("day").agg(F.count("*").alias("n"))
    totals = totals.select("day", F.lit(0).alias("nth"), F.concat(F.lit("\nTOTAL ANNOUNCEMENTS TODAY: "), F.col("n").cast("string")).alias("line"))
    sections = [
        _section(order_lines, 1, count("ORDER WINS", " today):")), _section(result_lines, 2, count("FINANCIAL RESULTS", " today):")), _section(group(FUNDRAISING, RAISED), 3, count("FUNDRAISING", "):")),
        _section(group(DEALS, DEALT), 4, count("ACQUISITIONS/MERGERS", "):")), _section(boards, 5, None), _section(active, 6, F.lit("\nSECTOR ACTIVITY:")), _section(totals, 7, None),
    ]
    rows = reduce(DataFrame.unionByName, sections)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x.line)
    return rows.groupBy("day").agg(F.array_join(lines, "\n").alias("body"), F.max("at.no").alias("_last")).where("_last = 7").drop("_last")
