"""Guards, tolerant JSON, date ranges, names, whole statements and late rows of streams, on small texts."""

import datetime as dt
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from bourselake.functions import guards as G
from bourselake.functions import questions as Q
from bourselake.operators import full_statements as S
from bourselake.operators import names
from bourselake.streaming import jobs

PROSE = "the order of the company was for a net profit and it is not in the tax of this year by any means as we may say that our sales had all been good with them at last "


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_rejected_texts(spark):
    rng = random.Random(1)
    scrambled = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(600))
    texts = [None, "", PROSE * 20, "é" * 40 + "a" * 60, "ab " * 200, scrambled, scrambled[:1400], PROSE * 3 + "\x01" * 400, "short"]
    assert column(spark, texts, G.rejected) == ["noise", "noise", None, "noise", "repeated", "scrambled at 1/6", None, "noise", None]
    # clean in front, scrambled behind: found at the place that it reaches
    late = PROSE * 30
    late = late[: len(late) // 3] + scrambled
    assert column(spark, [late[: len(late)]], G.rejected)[0] == "scrambled at 1/3"


def test_four_languages_are_kept(spark):
    """The documents' prose passes with the words of its languages; the junk among it does not."""
    words = [*G.COMMON, *(w for ws in G.COMMON_ELSEWHERE.values() for w in ws)]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 1500 and lang is not null")
    kept = docs.select("lang", G.common_ratio(F.col("text"), 1 / 4, words).alias("r")).where("r is not null").groupBy("lang").agg(F.avg((F.col("r") >= G.SCRAMBLED).cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    assert kept and all(r.kept > 0.9 for r in kept if r.n >= 5)


def test_outermost_object(spark):
    texts = ['x {"a": {"b": "}"}, "c": "\\"{"} y }', "{", "}", "no", None, '```JSON\n{"a": 1}\n```', '{"a": "{"', "{}{}", 'said "x { {"a": 2}}']
    assert column(spark, texts, G.outermost_object) == ['{"a": {"b": "}"}, "c": "\\"{"}', None, None, None, None, '{"a": 1}', None, "{}", '{ {"a": 2}}']
    rng = random.Random(3)
    made = [json.dumps({f"k{i}": rng.choice(["{", "}", '"', "\\", "a b", 1, None, {"x": "}"}]) for i in range(rng.randrange(1, 5))}) for _ in range(60)]
    assert column(spark, [f"Answer: {m} Done }}" for m in made], G.outermost_object) == made
    assert column(spark, ["[1, 2]", " [] ", "{}", "[1", "", None, '["a", null]', "null"], G.json_list) == [["1", "2"], [], [], [], [], [], ["a", None], []]


def test_date_ranges(spark):
    d = dt.date
    asked = {"today or yesterday": (d(2026, 3, 4), d(2026, 3, 4)), "yeterday": (d(2026, 3, 3), d(2026, 3, 3)), "this week": (d(2026, 3, 2), d(2026, 3, 4)), "last week": (d(2026, 2, 23), d(2026, 3, 1)), "lastmonth": (d(2026, 2, 1), d(2026, 2, 28)),
             "last year": (d(2025, 1, 1), d(2025, 12, 31)), "last 10 days": (d(2026, 2, 22), d(2026, 3, 4)), "29/02/2024": (d(2024, 2, 29), d(2024, 2, 29)), "29-02-2025": (None, None), "3rd sept 2025": (None, None), "3rd sep 2025": (d(2025, 9, 3),) * 2, "21 August 1999": (d(1999, 8, 21),) * 2, "monday": (None, None), "": (None, None)}
    rows = spark.createDataFrame([(k,) for k in asked], "x string").select("x", Q.date_range(F.col("x"), F.lit("2026-03-04").cast("date")).alias("r")).collect()
    assert {r.x: (r.r.first, r.r.last) for r in rows} == asked


def test_three_passes(spark):
    companies = spark.createDataFrame([("LT", "Larsen and Toubro Limited"), ("TS", "Tata Steel Ltd."), ("TM", "Tata Motors Limited"), ("PW", "Power Energy Ltd"), (None, "Ghost Works"), ("AB", None)], "symbol string, company string")
    assert {r["name"]: r.symbol for r in names.name_index(companies).collect()} == {"larsen": "LT", "toubro": "LT", "larsen and toubro": "LT", "steel": "TS", "tata steel": "TS", "motors": "TM", "tata motors": "TM", "power energy": "PW"}
    asked = ["tata motors or lt?", "motors, larsen and toubro", "steel before larsen", "what of tata", "tata, steel", "Power   energy", "", "ab initio"]
    got = {r.id: (r.symbol, r.how) for r in names.resolved(spark.createDataFrame(list(enumerate(asked)), "id int, text string"), companies).collect()}
    assert got == {0: ("LT", "token"), 1: ("LT", "run"), 2: ("TS", "word"), 4: ("TS", "run"), 5: ("PW", "run"), 7: ("AB", "token")}


# ---- whole statements


def _plain_items(text):
    """The items of a page, by joining its lines to one string of kinds and matching that."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    dates = [[m.group(0) for m in re.finditer(S.DATE_NUMBER, x)] for x in lines]
    head = next((d for d in dates if len(d) >= 2), None)
    if head is None:
        head = [d for x, ds in zip(lines, dates, strict=True) if not re.search(S.TITLE, x) for d in ds]
    width = max(3, len(head[:4]))
    begin = next((i for i, x in enumerate(lines) if any(w in x.lower() for w in S.BEGIN)), 0)
    kinds, kept = "", []
    for x in lines[begin:]:
        if re.fullmatch(S.NUMBER_LINE[1:-1], x):
            kinds += "n"
        elif re.match(S.NOISE, x) or len(re.sub("[^a-zA-Z0-9]", "", x)) <= 1 or re.search(S.DATE_NUMBER, x):
            continue
        else:
            kinds += "t"
        kept.append(x)
    out = {}
    # label lines since the last closed row; a run of numbers closes it when it is long enough or ends the page
    words = []
    for run in re.finditer("t+|n+", kinds):
        part = kept[run.start() : run.end()]
        if run.group()[0] == "t":
            words += part
        elif len(part) >= width or run.end() == len(kinds):
            n = len(words)
            label = re.sub(r"\s+", " ", re.sub(r"^\d+[a-z]?[.)]\s*", "", " ".join(words[n - ((n - 1) % 3 + 1) :]))).strip() if words else ""
            values = [_plain_number(x) for x in part[:width]]
            if len(label) >= 3 and any(v is not None for v in values):
                out[label] = (values + [None] * 4)[:4]
            words = []
    return out


def _plain_number(cell):
    bare = cell.strip().strip("()")
    if "." not in bare and re.fullmatch(r"[\d,]+,\d{2}", bare):
        bare = bare[:-3] + "." + bare[-2:]
    bare = bare.replace(",", "")
    try:
        return -float(bare) if cell.strip().startswith("(") and cell.strip().endswith(")") else float(bare)
    except ValueError:
        return None


def test_text_items_equal_a_plain_reader(spark):
    rng = random.Random(9)
    pieces = ["Revenue from operations", "Other income", "Total income", "1. Tax", "expense", "(a) Cost", "12.5", "(3)", "1,09,483,82", "7", "7", "8", "8", "9", "1.2.3", "....", "Audited", "30.06.2026", "", "  ", "Employee benefit", "Quarter ended 31.03.2026", "x"]
    pages = []
    for i in range(150):
        head = rng.choice(["30.06.2026 31.03.2026", "30.06.2026 31.03.2026 30.06.2025 31.03.2025", "30.06.2026", "no date"])
        pages.append((i, 1, "\n".join([head] + [rng.choice(pieces) for _ in range(rng.randrange(0, 40))]), None))
    df = spark.createDataFrame(pages, "doc int, page_no int, text string, tables array<array<array<string>>>")
    got = {}
    for r in S.text_items(df).orderBy("doc", "at").collect():
        got.setdefault(r.doc, {})[r.label] = r["values"]
    want = {i: found for i, _, text, _ in pages if (found := _plain_items(text))}
    assert got == want


def test_best_of_several(spark):
    body = "30.06.2026 31.03.2026\nRevenue from operations\n1\n2\n3\nTotal income\n4\n5\n6\nProfit before tax\n1\n1\n1\nProfit after tax\n2\n2\n2\nCosts\n3\n3\n3"
    more = body + "\nEmployee benefit\n1\n1\n1"
    pages = [("a", 1, "consolidated\n" + more), ("a", 2, "standalone\n" + body), ("b", 1, body), ("b", 2, more), ("c", 1, "Performance Highlights\n" + more), ("d", 1, "profit"), ("d", 2, None), ("e", 1, "Rs in lakhs"), ("e", 2, "in million, profit"), ("e", 3, "standalone and consolidated\n" + body)]
    df = spark.createDataFrame([(*p, None) for p in pages], "doc string, page_no int, text string, tables array<array<array<string>>>")
    got = {r.doc: (r.kind, r.unit, r.quality, r.n_items) for r in S.full_statements(df).collect()}
    assert got == {"a": ("standalone", "Cr", 4, 5), "b": ("unknown", "Cr", 5, 6), "e": ("standalone", "Mn", 4, 5)}
    tables = [[["Particulars", "30.06.2026"], ["1", "Revenue from operations", "5 10"], ["Total income", "6", None, "7"], ["Profit before tax", "(1)"], ["Other", "1,20"], ["More", "2"], None, ["Profit after tax", "x"]], [["short"]]]
    (r,) = S.full_statements(spark.createDataFrame([("t", 1, "income", tables)], df.schema)).collect()
    assert r.headers == ["30.06.2026"] and r["items"] == {"Revenue from operations": [5.10, None, None, None], "Total income": [6.0, None, 7.0, None], "Profit before tax": [-1.0, None, None, None], "Other": [1.2, None, None, None], "More": [2.0, None, None, None]}


# ---- late rows


@pytest.mark.parametrize(("newest", "late_counts"), [("13:59:59", True), ("14:00:00", False)])
def test_rows_behind_the_watermark(spark, tmp_path, newest, late_counts):
    """Twelve-hour windows each six hours, two hours of delay: at 14:00 the window from 00:00 has ended, a second before it has not."""
    day = "2024-01-02"
    # the watermark that drops rows is the one that the batch before has begun with
    feed = [[(1, f"{day} 05:00"), (2, f"{day} {newest}")], [(3, f"{day} 13:00")], [(4, f"{day} 11:59")], [(5, "2024-02-01 00:00")]]
    for n, rows in enumerate(feed):
        df = spark.createDataFrame(rows, "id int, at string").select("id", F.col("at").cast("timestamp").alias("ts"))
        df.coalesce(1).write.parquet(f"{tmp_path}/feed/{n}")
        time.sleep(0.02)
    stream = spark.readStream.schema("id int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed/*")
    with jobs.setting(spark, "spark.sql.shuffle.partitions", "2"):
        got = {str(r.start): r.n for r in jobs.run_to_table(jobs.sliding(stream, "12 hours", "6 hours", "2 hours")).collect()}
    # the late row is in the window from 06:00 in either case
    assert got == {"2024-01-01 18:00:00": 1, f"{day} 00:00:00": 2 if late_counts else 1, f"{day} 06:00:00": 3, f"{day} 12:00:00": 2}
