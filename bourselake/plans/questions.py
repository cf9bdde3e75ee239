"""Questions read as columns, and routed by what they ask for. The oracles read the same texts with the oracle engine's own expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import questions as Q
from ..functions import rules
from ..operators import ranking, retrieval, routing
from .registry import Tables, query

_has = lambda pattern: f"regexp_matches(txt, '{pattern}', 'i')"
_get = lambda pattern, n=1: f"nullif(regexp_extract(txt, '{pattern}', {n}, 'i'), '')"
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_WORDS = r"string_split_regex(lower(txt), '\W+')"
_any = lambda words: f"list_has_any({_WORDS}, {_list(words)})"
_SYMBOLS = f"list_filter(regexp_extract_all(txt, '{Q.SYMBOL}', 1), lambda x: NOT list_contains({_list(Q.NO_SYMBOLS)}, x))"
_YEAR = f"CASE WHEN length({_get(Q.SLASHED_DAY, 3)}) = 2 THEN concat('20', {_get(Q.SLASHED_DAY, 3)}) ELSE {_get(Q.SLASHED_DAY, 3)} END"
_DAY = f"""CASE WHEN {_has("\\btoday\\b")} THEN CAST(as_of AS VARCHAR) WHEN {_has(Q.ISO_DAY)} THEN {_get(Q.ISO_DAY)}
WHEN {_has(Q.SLASHED_DAY)} THEN concat({_YEAR}, '-', lpad({_get(Q.SLASHED_DAY, 2)}, 2, '0'), '-', lpad({_get(Q.SLASHED_DAY)}, 2, '0')) END"""


@query(f"SELECT id, array_to_string({_SYMBOLS}, ',') AS symbols FROM questions")
def F15_question_symbols(t: Tables) -> DataFrame:
    return t.questions.select("id", F.array_join(Q.symbols(F.col("txt")), ",").alias("symbols"))


@query(f"SELECT id, {_DAY} AS day FROM questions")
def F16_question_day(t: Tables) -> DataFrame:
    return t.questions.select("id", Q.day(F.col("txt"), F.col("as_of")).alias("day"))


def _crore_sql(pattern: str) -> str:
    unit, value = f"lower(coalesce({_get(pattern, 2)}, 'cr'))", f"TRY_CAST(replace({_get(pattern)}, ',', '') AS DOUBLE)"
    return f"CASE WHEN {unit} LIKE 'lakh%' THEN {value} / 100.0::DOUBLE WHEN {unit} IN ('million', 'mn') THEN {value} / 10.0::DOUBLE WHEN {unit} = 'thousand' THEN {value} / 1000.0::DOUBLE ELSE {value} END"


_THEMES = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_has(p)} THEN '{label}' END" for p, label in rules.THEMES) + "], lambda x: x IS NOT NULL), ',')"


@query(f"""SELECT id, coalesce(TRY_CAST({_get(Q.MIN_SCORE)} AS INT), CASE WHEN {_has(Q.HIGH_SCORE)} THEN 8 END) AS min_score, {_crore_sql(Q.ORDER_VALUE)} AS order_value, {_THEMES} AS themes FROM questions""")
def F17_question_thresholds(t: Tables) -> DataFrame:
    text = F.col("txt")
    return t.questions.select("id", Q.min_score(text).alias("min_score"), Q.order_value(text).alias("order_value"), F.array_join(Q.themes(text), ",").alias("themes"))


@query(f"""SELECT id, CASE WHEN m AND (e OR s) THEN 'compound' WHEN m THEN 'financial' WHEN e AND NOT s THEN 'structured' WHEN s AND NOT e THEN 'semantic' ELSE 'hybrid' END AS intent FROM
(SELECT id, {_has(Q.FINANCIAL)} AS m, {_has(Q.SEMANTIC)} AS s, {_has(Q.STRUCTURED)} OR len({_SYMBOLS}) > 0 OR ({_DAY}) IS NOT NULL AS e FROM questions)""")
def F18_question_intent(t: Tables) -> DataFrame:
    return t.questions.select("id", Q.intent(F.col("txt"), F.col("as_of")).alias("intent"))


_held = lambda pairs: "CASE " + " ".join(f"WHEN contains(lower(txt), '{w}') THEN '{label}'" for w, label in pairs) + " END"


@query(f"""SELECT id, {_held([(w, s) for s, ws in Q.SECTOR_WORDS.items() for w in ws])} AS sector, {_held(Q.SUBJECTS.items())} AS subject,
CASE WHEN {_any(Q.ANNUAL)} OR contains(lower(txt), 'full year') THEN 'annual' WHEN {_any(Q.QUARTERLY)} THEN 'quarterly' END AS period_type, {_crore_sql(Q.LEAST_VALUE)} AS min_cr, TRY_CAST({_get(Q.PERCENT)} AS DOUBLE) AS pct,
CASE {" ".join(f"WHEN {_any(names)} THEN '{label}'" for label, names in Q.CAPS)} END AS cap FROM questions""")
def F21_question_filters(t: Tables) -> DataFrame:
    x = F.col("txt")
    return t.questions.select("id", Q.sector(x).alias("sector"), Q.subject(x).alias("subject"), Q.period_type(x).alias("period_type"), Q.least_value(x).alias("min_cr"), Q.percent(x).alias("pct"), Q.cap(x).alias("cap"))


@query("SELECT id, " + " || ".join(f"CASE WHEN {_any(words)} THEN '{name} ' ELSE '' END" for name, words in Q.FAMILIES.items()) + " AS families, " + " + ".join(f"CAST({_any(words)} AS INT)" for words in Q.FAMILIES.values()) + " >= 2 AS compound FROM questions")
def F23_compound_questions(t: Tables) -> DataFrame:
    x = F.col("txt")
    return t.questions.select("id", F.concat_ws("", F.transform(Q.families(x), lambda f: F.concat(f, F.lit(" ")))).alias("families"), Q.is_compound(x).alias("compound"))


@query(f"""SELECT id, CASE WHEN length(txt) > 1000 THEN concat('Message too long (', CAST(length(txt) AS VARCHAR), ' chars, max 1000).') WHEN {_has(rules.INJECTION)} THEN 'Message contains disallowed content.' END AS refusal FROM questions""")
def P18_input_guard(t: Tables) -> DataFrame:
    return t.questions.select("id", Q.refusal(F.col("txt")).alias("refusal"))


@query(f"""SELECT id, concat(split_part(company, ' ', 1), ' S', CAST(id % 90 AS VARCHAR), ' ', CASE {" ".join(f"WHEN {_any(w)} THEN '{more}'" for w, more in Q.NEWS)} ELSE '{Q.LATEST_NEWS}' END) AS search FROM questions""")
def S14_news_queries(t: Tables) -> DataFrame:
    return t.questions.select("id", Q.news_query(F.col("txt"), F.concat(F.lit("S"), (F.col("id") % 90).cast("string")), F.col("company")).alias("search"))


@query("""WITH n AS (SELECT n_nationkey AS k, lower(n_name) AS name FROM nation), a AS (SELECT c_custkey AS id, string_split(concat('results of ', lower(n_name), CASE c_custkey % 3 WHEN 0 THEN ' please' WHEN 1 THEN concat(' and not ', lower(r_name)) ELSE '' END), ' ') AS ws FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
g AS (SELECT id, i, l, array_to_string(ws[i:i + l - 1], ' ') AS gram FROM (SELECT id, ws, i, unnest(range(1, len(ws) - i + 2)) AS l FROM (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS i FROM a)))
SELECT id, CAST(k AS VARCHAR) AS symbol FROM (SELECT g.id, n.k, row_number() OVER (PARTITION BY g.id ORDER BY g.l DESC, g.i, n.k) AS rn FROM g JOIN n ON n.name = g.gram) WHERE rn = 1""")
def F22_company_to_symbol(t: Tables) -> DataFrame:
    """The name that a question holds as a run of words; longer runs first, then earlier ones."""
    names = t.table("nation").select(F.lower("n_name").alias("gram"), F.col("n_nationkey").cast("string").alias("symbol"))
    where = t.table("nation").join(t.table("region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", F.lower("n_name").alias("name"), F.lower("r_name").alias("region"))
    tail = F.when(F.col("c_custkey") % 3 == 0, " please").when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" and not "), "region")).otherwise("")
    asked = t.table("customer").join(where, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("id"), F.concat(F.lit("results of "), "name", tail).alias("txt"))
    return _by_gram(asked, names)


def _by_gram(asked: DataFrame, names: DataFrame, most: int = 6) -> DataFrame:
    listed = asked.select("id", F.split(F.lower("txt"), r"\s+").alias("ws"))
    starts = listed.select("id", "ws", F.posexplode("ws").alias("at", "_w")).drop("_w")
    grams = starts.select("id", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.size("ws") - F.col("at")))).alias("n"), "ws")
    grams = grams.select("id", "at", "n", F.array_join(F.slice("ws", F.col("at") + 1, F.col("n")), " ").alias("gram"))
    return ranking.first_n(grams.join(names, "gram"), ["id"], [F.desc("n"), F.col("at"), F.col("symbol")]).select("id", "symbol")


_TAGGED = "SELECT *, concat_ws(',', CASE WHEN id % 2 = 0 THEN 'railway' END, CASE WHEN id % 3 = 0 THEN 'solar_renewables' END, CASE WHEN id % 5 = 0 THEN 'power' END) AS tags FROM announcements"


def _tagged(t: Tables) -> DataFrame:
    tag = lambda n, name: F.when(F.col("id") % n == 0, name)
    return t.announcements.withColumn("tags", F.concat_ws(",", tag(2, "railway"), tag(3, "solar_renewables"), tag(5, "power")))


@query(f"SELECT id, tags FROM ({_TAGGED}) WHERE tags LIKE '%railway%' AND tags LIKE '%solar%'")
def P7_all_themes(t: Tables) -> DataFrame:
    """Every theme, as a part of the tags: solar is found in solar_renewables."""
    return _tagged(t).where(routing.has_themes(F.col("tags"), ["railway", "solar"])).select("id", "tags")


_FUSED = """SELECT id, symbol, subject, score, broadcast_date, coalesce(1.0::DOUBLE / (60 + a), 0) + coalesce(1.0::DOUBLE / (60 + b), 0) AS base FROM (SELECT id, symbol, subject, score, broadcast_date, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, id) AS a,
CASE WHEN order_value_cr > 300 THEN row_number() OVER (PARTITION BY symbol, order_value_cr > 300 ORDER BY order_value_cr DESC, id) END AS b FROM announcements)"""


def _fused(t: Tables, most: int | None = None) -> DataFrame:
    """Two rankings of each symbol's announcements, fused: by score, and by value for those of over 300 crore."""
    words = ranking.with_rank(t.announcements.select("id", "symbol", "score"), ["symbol"], [F.desc("score"), F.col("id")])
    vectors = ranking.with_rank(t.announcements.where("order_value_cr > 300").select("id", "symbol", "order_value_cr"), ["symbol"], [F.desc("order_value_cr"), F.col("id")])
    if most is not None:
        words, vectors = words.where(F.col("rank") <= most), vectors.where(F.col("rank") <= most)
    both = words.select("id", "rank", F.lit("bm25").alias("source")).unionByName(vectors.select("id", "rank", F.lit("vector").alias("source")))
    return both.groupBy("id").agg(F.sum(1.0 / (60 + F.col("rank"))).alias("base"), F.array_sort(F.collect_set("source")).alias("sources"))


@query(f"""SELECT id, floor(base * 1000000000 + 0.5) / 1000000000 AS base FROM ({_FUSED}) WHERE score >= 9 AND CAST(broadcast_date AS VARCHAR) LIKE '1997-1%' AND symbol IN ('3', '4', '5', '17')""")
def P19_filters_after_fusion(t: Tables) -> DataFrame:
    found = _fused(t).join(t.announcements, "id")
    return retrieval.post_filters(found, 9, "1997-1", ["3", "4", "5", "17"]).select("id", C.half_up(F.col("base"), 9).alias("base"))


@query("""SELECT symbol, period, 'Financial Results ' || period AS subject, 8 AS score, 0.5::DOUBLE AS base FROM (SELECT *, row_number() OVER (ORDER BY broadcast_date DESC, symbol, period) AS rn FROM results WHERE symbol IN ('3', '4', '5') AND broadcast_date >= CAST('1998-05-14' AS DATE)) WHERE rn <= 20""")
def R11_financial_strategy(t: Tables) -> DataFrame:
    """Latest results of some symbols since a day: candidates of score 8 and base .5."""
    q = routing.ask(t.spark, "revenue since 1998-05-14", dt.date(2026, 6, 1)).asDict() | {"symbols": ["3", "4", "5"]}
    found = routing.financial(t.results, Asked(q))
    return found.select("symbol", F.regexp_extract("id", "^fin_[^_]*_(.*)$", 1).alias("period"), "subject", "score", "base")


class Asked:
    """What a question asks for, by attribute."""

    def __init__(self, fields: dict):
        self.__dict__.update(fields)


_CANDIDATES = f"""f AS (SELECT * FROM ({_FUSED})), w AS (SELECT id, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, id) AS a FROM announcements),
v AS (SELECT id, row_number() OVER (PARTITION BY symbol ORDER BY order_value_cr DESC, id) AS b FROM announcements WHERE order_value_cr > 300),
h AS (SELECT n.id, n.symbol, n.score, n.broadcast_date, coalesce(1.0::DOUBLE / (60 + a), 0) + coalesce(1.0::DOUBLE / (60 + b), 0) AS base, b IS NOT NULL AS vec FROM announcements n LEFT JOIN (SELECT * FROM w WHERE a <= 40) w ON w.id = n.id LEFT JOIN (SELECT * FROM v WHERE b <= 40) v ON v.id = n.id WHERE a IS NOT NULL OR b IS NOT NULL),
fin AS (SELECT 'fin_' || symbol || '_' || period AS id, broadcast_date, row_number() OVER (ORDER BY broadcast_date DESC, symbol, period) AS rn FROM results),
s AS (SELECT id, score / 13.0::DOUBLE AS base FROM announcements WHERE broadcast_date = CAST('1998-05-14' AS DATE) AND score >= 6 AND order_value_cr >= 6 ORDER BY score DESC, broadcast_date DESC, id LIMIT 40)"""
_ROUTED = ["top orders with score above 6 on 14/5/1998", "stocks like the best of the theme", "earnings and margin", "dividend of companies that grow", "tell me a story"]


@query(f"""WITH {_CANDIDATES} SELECT 'structured' AS intent, CAST(id AS VARCHAR) AS id, floor(base * 1000000 + 0.5) / 1000000 AS base FROM s UNION ALL SELECT 'semantic' AS intent, CAST(id AS VARCHAR) AS id, floor(base * 1000000 + 0.5) / 1000000 AS base FROM h WHERE vec
UNION ALL SELECT 'financial' AS intent, id, 0.5::DOUBLE AS base FROM fin WHERE rn <= 20 UNION ALL SELECT 'compound' AS intent, CAST(id AS VARCHAR) AS id, floor(base * 1000000 + 0.5) / 1000000 AS base FROM h
UNION ALL SELECT 'compound' AS intent, id, 0.5::DOUBLE AS base FROM fin WHERE rn <= 10 UNION ALL SELECT 'hybrid' AS intent, CAST(id AS VARCHAR) AS id, floor(base * 1000000 + 0.5) / 1000000 AS base FROM h""")
def R12_broker(t: Tables) -> DataFrame:
    """One question of each intent, and the candidates its strategies give."""
    out = None
    for text in _ROUTED:
        q = routing.ask(t.spark, text, dt.date(1998, 6, 1))
        found = routing.broker(q, t.announcements, t.results, lambda n: _fused(t, n))
        part = found.select(F.lit(q.intent).alias("intent"), "id", C.half_up(F.col("base"), 6).alias("base"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT kind, id, day FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY day DESC, id) AS rn FROM (
SELECT 'order_wins' AS kind, CAST(id AS VARCHAR) AS id, broadcast_date AS day FROM order_wins WHERE value / 1000.0 >= 200 AND lower(order_sector) = 'building' AND broadcast_date BETWEEN CAST('1995-01-01' AS DATE) AND CAST('1998-06-30' AS DATE)
UNION ALL SELECT 'financials' AS kind, symbol || '|' || period AS id, broadcast_date AS day FROM results WHERE period_type IN ('quarterly', 'financial_results') AND revenue >= 1000 AND pat IS NOT NULL
UNION ALL SELECT 'announcements' AS kind, CAST(id AS VARCHAR) AS id, broadcast_date AS day FROM announcements WHERE subject = 'Acquisition' AND score >= 5 AND broadcast_date >= CAST('1996-01-01' AS DATE)
UNION ALL SELECT 'all' AS kind, CAST(id AS VARCHAR) AS id, broadcast_date AS day FROM announcements)) WHERE rn <= 25""")
def R7_typed_searches(t: Tables) -> DataFrame:
    """Four typed searches with filters of their own, each with its latest 25."""
    day = lambda text: F.lit(text).cast("date")
    shaped = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), key.cast("string").alias("id"), F.col("broadcast_date").alias("day"))
    parts = [
        shaped(t.order_wins.where((F.col("value") / 1000.0 >= 200) & (F.lower("order_sector") == "building") & F.col("broadcast_date").between(day("1995-01-01"), day("1998-06-30"))), "order_wins", F.col("id")),
        shaped(t.results.where(F.col("period_type").isin("quarterly", "financial_results") & (F.col("revenue") >= 1000) & F.col("pat").isNotNull()), "financials", F.concat_ws("|", "symbol", "period")),
        shaped(t.announcements.where((F.col("subject") == "Acquisition") & (F.col("score") >= 5) & (F.col("broadcast_date") >= day("1996-01-01"))), "announcements", F.col("id")),
        shaped(t.announcements, "all", F.col("id")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return ranking.first_n(rows, ["kind"], [F.desc("day"), F.col("id")], 25)

