"""Write paths: routed and derived rows, upserts by URL and id, dual writes, patches, exports; each is written where it says so and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import filings as X
from ..functions import rules
from ..operators import filters, merge, ranking
from ..operators.bucketed import BucketTable
from ..sources import feeds
from ..streaming.jobs import shared_folder
from .registry import Tables, query

_quoted = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _kept(t: Tables, df: DataFrame, name: str) -> DataFrame:
    """df as a table that has been written."""
    path = _folder(t, name)
    df.write.parquet(path)
    return t.spark.read.schema(df.schema).parquet(path)


# ---- order wins: derived flag and description


@query(f"""SELECT url, id, genuine, description FROM (SELECT o.source_url AS url, o.id, CASE WHEN a.subject IN ({_quoted(rules.GENUINE_ORDER_SUBJECTS)}) THEN 1 ELSE 0 END AS genuine,
CASE o.id % 4 WHEN 0 THEN concat('bridge no. ', CAST(o.id AS VARCHAR)) WHEN 1 THEN 'road: two lanes' WHEN 2 THEN NULL ELSE '' END AS description, row_number() OVER (PARTITION BY o.source_url ORDER BY o.id) AS rn
FROM order_wins o LEFT JOIN (SELECT attachment, arg_min(subject, id) AS subject FROM announcements GROUP BY attachment) a ON a.attachment = o.source_url) WHERE rn = 1""")
def K3_insert_order_wins(t: Tables) -> DataFrame:
    """The first order of each URL; whether its announcement is a genuine order, and the first highlight that is a description."""
    notes = F.element_at(F.array(
        F.array(F.lit("Client: X"), F.concat(F.lit("Description: bridge no. "), F.col("id").cast("string"))), F.array(F.lit("DESCRIPTION:road: two lanes "), F.lit("description: never")),
        F.array(F.lit("Client: described"), F.lit("no pair")), F.array(F.lit("description:"))), (F.col("id") % 4 + 1).cast("int"))
    first = F.get(F.filter(notes, lambda x: F.lower(x).startswith("description:")), 0)
    batch = t.order_wins.select(F.col("source_url").alias("url"), "id", F.trim(F.regexp_replace(first, "^[^:]*:", "")).alias("description"))
    said = t.announcements.groupBy(F.col("attachment").alias("url")).agg(F.min_by("subject", "id").alias("subject"))
    rows = batch.join(said, "url", "left").select("url", "id", F.coalesce(F.col("subject").isin(rules.GENUINE_ORDER_SUBJECTS).cast("int"), F.lit(0)).alias("genuine"), "description")
    return merge.insert_ignore(rows.limit(0), rows, ["url"], [F.col("id")])


@query("""SELECT 'order_wins' AS target, symbol, period, revenue FROM results WHERE period_type = 'order_win' UNION ALL SELECT 'financial_results' AS target, symbol, period, revenue FROM results WHERE period_type <> 'order_win'
UNION ALL SELECT 'vectors' AS target, symbol, period, revenue FROM results""")
def K4_routed_writes(t: Tables) -> DataFrame:
    """A row goes to one of two tables by its type, and always to the vectors; all three are written and read back."""
    batch = t.results.select("symbol", "period", "revenue", "period_type")
    targets = {"order_wins": batch.where("period_type = 'order_win'"), "financial_results": batch.where("period_type <> 'order_win'"), "vectors": batch}
    out = None
    for name, rows in targets.items():
        part = _kept(t, rows.drop("period_type"), name).select(F.lit(name).alias("target"), "symbol", "period", "revenue")
        out = part if out is None else out.unionByName(part)
    return out


_OLD = "SELECT concat('u', symbol, period_no % 40) AS url, symbol, period, revenue, period_no FROM results WHERE period_no % 2 = 0"
_NEW = "SELECT concat('u', symbol, period_no % 40 - CASE WHEN period_no % 4 = 1 THEN 1 ELSE 0 END) AS url, symbol, CASE WHEN period_no % 8 = 1 THEN concat(period, 'R') ELSE period END AS period, revenue * 2 AS revenue, period_no FROM results WHERE period_no % 3 <> 2"


@query(f"""WITH o AS (SELECT url, symbol, period, revenue FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY period_no DESC) AS rn FROM ({_OLD})) WHERE rn = 1),
b AS (SELECT url, symbol, period, revenue, period_no FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY period_no DESC) AS rn FROM ({_NEW})) WHERE rn = 1),
k AS (SELECT url, symbol, period, revenue, 0 AS fresh, 0 AS n FROM o WHERE url NOT IN (SELECT url FROM b) UNION ALL SELECT url, symbol, period, revenue, 1 AS fresh, period_no AS n FROM b)
SELECT url, symbol, period, revenue FROM (SELECT *, row_number() OVER (PARTITION BY symbol, period ORDER BY fresh, n) AS rn FROM k) WHERE rn = 1""")
def K5_update_or_insert(t: Tables) -> DataFrame:
    """By URL: the batch's row takes the place of the old one. Where its (symbol, period) belongs to another row, that row stays and the batch's vanishes."""
    rows = t.results.select("symbol", "period", "revenue", "period_no")
    url = lambda n: F.concat(F.lit("u"), "symbol", n.cast("string"))
    old = rows.where("period_no % 2 = 0").withColumn("url", url(F.col("period_no") % 40))
    old = ranking.first_n(old, ["url"], [F.desc("period_no")]).drop("period_no")
    batch = rows.where("period_no % 3 <> 2").select(
        "symbol", F.when(F.col("period_no") % 8 == 1, F.concat("period", F.lit("R"))).otherwise(F.col("period")).alias("period"), (F.col("revenue") * 2).alias("revenue"), "period_no",
        url(F.col("period_no") % 40 - F.when(F.col("period_no") % 4 == 1, 1).otherwise(0)).alias("url"),
    )
    table = BucketTable(t.spark, _folder(t, "results"), ["symbol", "period"], 16, unique="url")
    table.upsert(old.withColumn("period_no", F.lit(0).cast(rows.schema["period_no"].dataType)), [F.col("period_no")])
    table.update_or_insert(batch, F.col("period_no"))
    return table.read().select("url", "symbol", "period", "revenue")


@query("""SELECT symbol, period, MIN(CASE WHEN period_no % 3 = 0 THEN revenue ELSE revenue + 1 END) AS revenue FROM results GROUP BY symbol, period""")
def K2_insert_results(t: Tables) -> DataFrame:
    """Insert or ignore by (symbol, period): known statements stay, of new ones that repeat in a batch the first stays."""
    rows = t.results.select("symbol", "period", "revenue", "period_no")
    table = BucketTable(t.spark, _folder(t, "statements"), ["symbol", "period"], 16)
    table.insert_ignore(rows.where("period_no % 3 = 0").drop("period_no"), [F.col("revenue")])
    table.insert_ignore(rows.select("symbol", "period", F.explode(F.array(F.col("revenue") + 2, F.col("revenue") + 1)).alias("revenue")), [F.col("revenue")])
    return table.read()


@query("""WITH x AS (SELECT symbol, source_url, id % 2 AS turn, id, CASE WHEN id % 2 = 0 THEN -1 ELSE coalesce(value, 0) END AS value FROM order_wins)
SELECT symbol, source_url, value FROM (SELECT *, row_number() OVER (PARTITION BY symbol, source_url ORDER BY turn DESC, id DESC) AS rn FROM x) WHERE rn = 1""")
def K6_replace_statements(t: Tables) -> DataFrame:
    """Insert or replace by (symbol, source_url): the later batch wins, and within a batch its last row."""
    rows = t.order_wins.select("symbol", "source_url", "id", F.coalesce("value", F.lit(0)).alias("value"))
    table = BucketTable(t.spark, _folder(t, "statements"), ["symbol", "source_url"], 16)
    table.upsert(rows.where("id % 2 = 0").withColumn("value", F.lit(-1).cast("long")), [F.col("id")])
    table.upsert(rows.where("id % 2 = 1"), [F.col("id")])
    return table.read().select("symbol", "source_url", "value")


@query("""SELECT brief_date, CASE WHEN month(brief_date) % 2 = 0 THEN concat('new ', CAST(n AS VARCHAR)) ELSE concat('old ', CAST(n AS VARCHAR)) END AS brief FROM (SELECT broadcast_date AS brief_date, COUNT(*) AS n FROM announcements GROUP BY 1)""")
def K8_replace_brief(t: Tables) -> DataFrame:
    """A brief a day: one that is written again takes the old one's place."""
    days = t.announcements.groupBy(F.col("broadcast_date").alias("brief_date")).agg(F.count("*").cast("string").alias("n"))
    brief = lambda word: days.select("brief_date", F.concat(F.lit(word), "n").alias("brief"))
    table = BucketTable(t.spark, _folder(t, "briefs"), ["brief_date"], 16)
    table.upsert(brief("old "), [F.col("brief")])
    table.upsert(brief("new ").where("month(brief_date) % 2 = 0"), [F.col("brief")])
    return table.read()


@query("SELECT vec_id, floor(CAST(embedding[1] AS DOUBLE) * 1000 + 0.5) / 1000.0::DOUBLE AS first FROM embeddings WHERE vec_id IN (SELECT item_id * 3 FROM benchmark)")
def S10_get_by_ids(t: Tables) -> DataFrame:
    """Vectors by ids, from the buckets of those ids only."""
    table = _vectors(t)
    wanted = t.table("benchmark").select((F.col("item_id") * 3).alias("vec_id"))
    return table.get(wanted).select("vec_id", C.half_up(F.col("embedding")[0].cast("double"), 3).alias("first"))


@query("SELECT vec_id, label FROM (SELECT vec_id, 'v' || CAST(vec_id % 5 AS VARCHAR) AS label FROM embeddings) WHERE (label = 'v3' OR vec_id < 40) AND label <> 'v1'")
def S10_get_where(t: Tables) -> DataFrame:
    """Vectors by a tree of conditions on their metadata."""
    tree = {"$and": [{"$or": [{"label": "v3"}, {"vec_id": {"$lt": 40}}]}, {"label": {"$ne": "v1"}}]}
    return _vectors(t).read().where(filters.where_tree(tree)).select("vec_id", "label")


def _vectors(t: Tables) -> BucketTable:
    rows = t.table("embeddings").select("vec_id", F.concat(F.lit("v"), (F.col("vec_id") % 5).cast("string")).alias("label"), "embedding")
    table = BucketTable(t.spark, _folder(t, "vectors"), ["vec_id"], 32)
    table.upsert(rows, [F.col("label")])
    return table


# ---- vectors


@query("""SELECT key, id, text FROM (SELECT CASE WHEN n > 0 THEN concat(k, '_', CAST(n AS VARCHAR)) ELSE k END AS key, id, text FROM (SELECT k, id, text, row_number() OVER (PARTITION BY k ORDER BY id) - 1 AS n
FROM (SELECT id, md5(concat(symbol, '|', CAST(broadcast_date AS VARCHAR), '|', subject)) AS k, concat('new ', subject) AS text FROM announcements)))
UNION ALL SELECT concat('old', CAST(id AS VARCHAR)) AS key, id, 'old' AS text FROM announcements WHERE score = 3""")
def K10_vector_upsert(t: Tables) -> DataFrame:
    """By id: ids that repeat within the batch get suffixes, known ids are replaced, others stay."""
    rows = t.announcements
    batch = merge.suffixed(rows.select(F.md5(F.concat_ws("|", "symbol", F.col("broadcast_date").cast("string"), "subject")).alias("key"), "id", F.concat(F.lit("new "), "subject").alias("text")), "key", [F.col("id")])
    target = rows.where("score = 3").select(F.concat(F.lit("old"), F.col("id").cast("string")).alias("key"), "id", F.lit("old").alias("text"))
    known = batch.where("id % 7 = 0").withColumn("text", F.lit("stale"))
    table = BucketTable(t.spark, _folder(t, "vectors"), ["key"], 16)
    table.upsert(target.unionByName(known), [F.col("id")])
    table.upsert(batch, [F.col("id")])
    return table.read()


@query("""SELECT COUNT(DISTINCT concat(symbol, '|', CAST(broadcast_date AS VARCHAR), '|', subject)) AS new_rows, COUNT(*) AS vectors FROM announcements""")
def K12_dual_write(t: Tables) -> DataFrame:
    """One batch to the table (insert or ignore) and to the vectors (upsert): how many rows each has taken, after both are written."""
    rows = t.announcements.select("symbol", "broadcast_date", "subject", "id")
    table = _kept(t, merge.insert_ignore(rows.limit(0), rows, ["symbol", "broadcast_date", "subject"], [F.col("id")]), "announcements")
    keyed = rows.select(F.md5(F.concat_ws("|", "symbol", F.col("broadcast_date").cast("string"), "subject")).alias("key"), "id")
    vectors = _kept(t, merge.upsert(keyed.limit(0), merge.suffixed(keyed, "key", [F.col("id")]), ["key"], [F.col("id")]), "vectors")
    return table.agg(F.count("*").alias("new_rows")).crossJoin(F.broadcast(vectors.agg(F.count("*").alias("vectors"))))


@query("""SELECT id, CASE WHEN id % 3 = 0 THEN 'kept' WHEN id % 5 = 0 THEN '' ELSE CAST(broadcast_date AS VARCHAR) END AS date_str, CASE WHEN id % 3 = 0 THEN 7 WHEN id % 5 = 0 THEN 0 ELSE CAST(replace(CAST(broadcast_date AS VARCHAR), '-', '') AS INT) END AS date_int,
CASE WHEN id % 2 = 0 THEN 'tagged' WHEN id % 3 = 0 THEN NULL ELSE '' END AS sector_tags, CASE WHEN id % 11 = 0 THEN 'patched' WHEN id % 3 = 0 THEN NULL ELSE 'general' END AS catalyst_type FROM announcements""")
def K14_metadata_patch(t: Tables) -> DataFrame:
    """Rows without date_int get it, date_str and defaults; others stay as they are. Then a patch of one field by id."""
    has = F.col("id") % 3 == 0
    stamp = F.when(F.col("id") % 5 == 0, "soon").otherwise(F.col("broadcast_ts").cast("string"))
    rows = t.announcements.select("id", stamp.alias("broadcast_dt"), F.when(has, "kept").alias("date_str"), F.when(has, 7).alias("date_int"), F.when(F.col("id") % 2 == 0, "tagged").alias("sector_tags"), F.lit(None).cast("string").alias("catalyst_type"))
    patch = rows.where("id % 11 = 0").select("id", F.lit("patched").alias("catalyst_type"))
    return merge.patched(merge.with_dates(rows), patch, "id").drop("broadcast_dt")


# ---- exports


@query("""SELECT CAST(score AS VARCHAR) AS score, CASE WHEN id % 2 = 0 THEN 'order' END AS tags, symbol, company, subject, details, attachment FROM announcements""")
def K16_csv_export(t: Tables) -> DataFrame:
    """The report's eight fields as CSV with a header, read back as text; an empty cell reads as null."""
    rows = t.announcements.select("score", F.when(F.col("id") % 2 == 0, "order").alias("tags"), "symbol", "company", "subject", F.date_format("broadcast_ts", "yyyy-MM-dd HH:mm").alias("datetime"), "details", "attachment")
    path = _folder(t, "export")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return t.spark.read.option("header", True).option("escape", '"').csv(path).drop("datetime")


@query("SELECT CAST(id AS VARCHAR) AS id, symbol, CASE WHEN id % 3 = 0 THEN 'old' ELSE 'new' END AS notes FROM announcements WHERE id % 3 = 0 OR id % 7 <> 0")
def K20_fixture_append(t: Tables) -> DataFrame:
    """New cases go behind the old ones as JSON lines; known ids, and cases whose values are those of a skipped fingerprint, do not."""
    rows = t.announcements.select(F.col("id").cast("string").alias("id"), "symbol", F.when(F.col("id") % 3 == 0, "old").otherwise("new").alias("notes"), (F.col("id") % 7).alias("print"))
    path = _folder(t, "fixtures")
    rows.where("notes = 'old'").drop("print").write.json(path)
    fresh = rows.withColumn("notes", F.lit("new")).where("print <> 0").drop("print").join(t.spark.read.schema("id string").json(path), "id", "left_anti")
    fresh.write.mode("append").json(path)
    return feeds.fixtures(t.spark, path, "id string, symbol string, notes string")


# ---- look-ups


@query("""SELECT o.id, r.revenue AS revenue_now, r.revenue * 0.5 AS revenue_before, r.pat AS pat_now FROM order_wins o LEFT JOIN (SELECT symbol, broadcast_date, revenue, pat FROM (SELECT *, row_number() OVER (PARTITION BY symbol, broadcast_date ORDER BY period_no) AS rn FROM results) WHERE rn = 1) r
ON r.symbol = o.symbol AND r.broadcast_date = o.broadcast_date""")
def J10_statement_lookup(t: Tables) -> DataFrame:
    """The statement of the same symbol and day, the first if there are several: the values of the first line named like revenue or profit."""
    amount = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    items = F.concat(F.lit('{"Other income":[1,2,3],"Total Revenue from Operations":['), amount("revenue"), F.lit(",0,"), (F.col("revenue") * 0.5).cast("string"), F.lit('],"Profit after tax":['), amount("pat"), F.lit(',0,1],"Net profit":[9,9]}'))
    statements = t.results.select("symbol", "broadcast_date", "period_no", items.alias("line_items"))
    first = ranking.first_n(statements, ["symbol", "broadcast_date"], [F.col("period_no")])
    values = first.select("symbol", "broadcast_date", X.statement_values(F.col("line_items")).alias("x"))
    return t.order_wins.select("id", "symbol", "broadcast_date").join(values, ["symbol", "broadcast_date"], "left").select("id", F.col("x.revenue_now").alias("revenue_now"), F.col("x.revenue_before").alias("revenue_before"), F.col("x.pat_now").alias("pat_now"))


@query("SELECT COUNT(DISTINCT page_id % 20) AS files, SUM(strlen(coalesce(html, '')) + 1) / 1000000.0::DOUBLE AS total_mb FROM pages")
def A18_cache_stats(t: Tables) -> DataFrame:
    """Files of a cache folder and their size: the listing only, no content is read. The cache holds all pages, in twenty files."""
    path = _folder(t, "cache")
    pages = t.table("pages").select(F.coalesce("html", F.lit("")).alias("value"), (F.col("page_id") % 20).alias("k"))
    pages.repartition("k").write.partitionBy("k").text(path)
    return feeds.cache_stats(t.spark, path)


@query("""SELECT kind, id FROM (SELECT 'raw' AS kind, id, row_number() OVER (ORDER BY strftime(broadcast_ts, '%d-%m-%Y') DESC, id) AS rn FROM announcements UNION ALL SELECT 'score, raw' AS kind, id, row_number() OVER (ORDER BY score DESC, strftime(broadcast_ts, '%d-%m-%Y'), id) AS rn FROM announcements
UNION ALL SELECT 'score, formatted' AS kind, id, row_number() OVER (ORDER BY score DESC, strftime(broadcast_ts, '%Y-%m-%d %H:%M'), id) AS rn FROM announcements) WHERE rn <= 30""")
def O5_text_orders(t: Tables) -> DataFrame:
    """Orders by dates as text: raw text from the last to the first, and by score with raw or formatted dates from the first."""
    rows = t.announcements.select("id", "score", F.date_format("broadcast_ts", "dd-MM-yyyy").alias("raw"), F.date_format("broadcast_ts", "yyyy-MM-dd HH:mm").alias("formatted"))
    orders = {"raw": [F.desc("raw")], "score, raw": [F.desc("score"), F.col("raw")], "score, formatted": [F.desc("score"), F.col("formatted")]}
    out = None
    for kind, order in orders.items():
        part = ranking.top(rows, [*order, F.col("id")], 30).select(F.lit(kind).alias("kind"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT CAST('1998-08-02' AS DATE) AS asked, day, n FROM (SELECT broadcast_date AS day, COUNT(*) AS n FROM announcements GROUP BY 1 ORDER BY abs(CASE WHEN broadcast_date = CAST('1998-08-02' AS DATE) THEN 1 ELSE 0 END) DESC, day DESC LIMIT 1)
UNION ALL SELECT CAST('2030-01-01' AS DATE) AS asked, day, n FROM (SELECT broadcast_date AS day, COUNT(*) AS n FROM announcements GROUP BY 1 ORDER BY day DESC LIMIT 1)""")
def O9_latest_brief(t: Tables) -> DataFrame:
    """The brief of the day that is asked for, or the latest if it has none."""
    days = t.announcements.groupBy(F.col("broadcast_date").alias("day")).agg(F.count("*").alias("n"))
    out = None
    for asked in ("1998-08-02", "2030-01-01"):
        wanted = F.lit(asked).cast("date")
        part = ranking.top(days, [(F.col("day") == wanted).desc(), F.desc("day")], 1).select(wanted.alias("asked"), "day", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"SELECT id, subject FROM announcements WHERE subject IN ({_quoted(rules.LEGACY_KEEP)}) AND subject NOT IN ({_quoted(rules.LEGACY_DROP)})")
def P2_legacy_gate(t: Tables) -> DataFrame:
    return t.announcements.where(C.subject_gate(F.col("subject"), rules.LEGACY_KEEP, rules.LEGACY_DROP)).select("id", "subject")



@query("""SELECT 'table' AS target, md5(concat(symbol, '|', CAST(broadcast_date AS VARCHAR), '|', subject)) AS key, MIN(CASE WHEN id % 4 = 0 THEN id ELSE id + 1000000000 END) % 1000000000 AS id FROM announcements GROUP BY symbol, broadcast_date, subject
UNION ALL SELECT 'vectors' AS target, CASE WHEN n > 0 THEN concat(k, '_', CAST(n AS VARCHAR)) ELSE k END AS key, id FROM (SELECT md5(concat(symbol, '|', CAST(broadcast_date AS VARCHAR), '|', subject)) AS k, id, row_number() OVER (PARTITION BY symbol, broadcast_date, subject ORDER BY id) - 1 AS n FROM announcements)""")
def K12_dual_write_rows(t: Tables) -> DataFrame:
    """Two batches to the table (insert or ignore) and one of all rows to the vectors (upsert by suffixed id): what each holds in the end."""
    key = ["symbol", "broadcast_date", "subject"]
    rows = t.announcements.select(*key, "id")
    curated = BucketTable(t.spark, _folder(t, "curated"), key, 16)
    curated.insert_ignore(rows.where("id % 4 = 0"), [F.col("id")])
    curated.insert_ignore(rows, [F.col("id")])
    named = F.md5(F.concat_ws("|", "symbol", F.col("broadcast_date").cast("string"), "subject")).alias("key")
    vectors = BucketTable(t.spark, _folder(t, "vectors"), ["key"], 16)
    vectors.upsert(merge.suffixed(rows.select(named, "id"), "key", [F.col("id")]), [F.col("id")])
    return curated.read().select(F.lit("table").alias("target"), named, "id").unionByName(vectors.read().select(F.lit("vectors").alias("target"), "key", "id"))
