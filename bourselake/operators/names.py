"""Names to symbols: an index of words that name one company only, and questions resolved against it in three passes by one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import first_n

# Words that name no company, endings of names, and lengths.
STOP_WORDS = [
    "limited", "ltd", "pvt", "private", "india", "industries", "industry", "solutions", "services", "enterprises", "holdings", "group", "corp", "technologies", "technology", "corporation", "company", "international",
    "infrastructure", "finance", "financial", "capital", "asset", "assets", "management", "power", "energy", "trading", "investment", "investments", "chemicals", "chemical", "products", "product", "systems", "system",
]
ENDINGS = [" limited", " ltd.", " ltd", " pvt ltd", " pvt. ltd"]
LEAST, MOST_WORDS = 4, 6


def name_index(companies: DataFrame) -> DataFrame:
    """name and symbol of every name that belongs to one symbol only: whole names without their endings, and their words of four letters or more. companies: symbol, company."""
    name = F.lower("company")
    for ending in ENDINGS:
        name = F.replace(name, F.lit(ending), F.lit(""))
    rows = companies.where("symbol <> '' and company <> ''").select("symbol", F.trim(name).alias("name")).distinct()
    words = F.filter(F.split("name", "[^a-z]+"), lambda w: (F.length(w) >= LEAST) & ~w.isin(STOP_WORDS))
    names = F.array_union(words, F.when(F.length("name") >= LEAST, F.array("name")).otherwise(F.array().cast("array<string>")))
    each = rows.select("symbol", F.explode(names).alias("name"))
    return each.groupBy("name").agg(F.min("symbol").alias("symbol"), F.max("symbol").alias("_last")).where("symbol = _last").drop("_last")


def resolved(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """id, symbol, how (token, run, word) of every question (id, text) that names a company.

    A token that is a symbol, in any case, goes first, the earliest one. Then runs of six to two words that are a name, longer ones first, then
    earlier ones. Then single words of four letters or more, the earliest. All three are rows of one join.
    """
    listed = questions.select("id", F.filter(F.split("text", r"[^\p{L}\p{N}_]+"), lambda w: w != "").alias("ws"))
    starts = listed.select("id", "ws", F.posexplode("ws").alias("at", "word"))
    tokens = starts.select("id", F.lit(0).alias("how"), F.lit(1).alias("n"), "at", F.upper("word").alias("gram"))
    runs = starts.select("id", "at", "ws", F.explode(F.sequence(F.lit(1), F.least(F.lit(MOST_WORDS), F.size("ws") - F.col("at")))).alias("n"))
    runs = runs.select("id", F.when(F.col("n") > 1, 1).otherwise(2).alias("how"), "n", "at", F.lower(F.array_join(F.slice("ws", F.col("at") + 1, F.col("n")), " ")).alias("gram"))
    symbols = companies.where("symbol <> ''").select(F.col("symbol").alias("gram"), "symbol", F.lit(True).alias("is_symbol")).distinct()
    names = name_index(companies).select(F.col("name").alias("gram"), "symbol", F.lit(False).alias("is_symbol"))
    known = symbols.unionByName(names)
    asked = tokens.unionByName(runs.where((F.col("how") == 1) | (F.length("gram") >= LEAST))).withColumn("is_symbol", F.col("how") == 0)
    found = first_n(asked.join(known, ["gram", "is_symbol"]), ["id"], [F.col("how"), F.desc("n"), F.col("at")])
    return found.select("id", "symbol", F.element_at(F.array(*map(F.lit, ("token", "run", "word"))), F.col("how") + 1).alias("how"))
