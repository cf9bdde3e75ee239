import pytest

LONG = "word " * 30_000
#: Nulls, empty and blank texts, ties and repeated rows, a very long text, odd characters, and columns whose names clash with the operators' own.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again until the day is done and everyone goes home for the night at last", "en", "a", 1),
    (2, "The quick brown fox jumps over the lazy dog again and again until the day is done and everyone goes home for the night at last", "en", "a", 2),
    (2, "The quick brown fox jumps over the lazy dog again and again until the day is done and everyone goes home for the night at last", "en", "a", 2),
    (3, None, None, None, None),
    (4, "", "en", "b", 4),
    (5, " \t\n ", "en", "b", 5),
    (6, LONG, "en", "b", 6),
    (7, "Ein kurzer deutscher Satz über die Straße und das schöne Wetter", "de", "c", 7),
    (None, "a row without an id", "en", "c", 8),
    (9, "x\x00y ▁  日本語 ÀÉ 12 <|endoftext|> it's", "en", "d", 9),
    (10, "12 34 56", None, "d", 10),
    (11, "intro words here then The quick brown fox jumps over the lazy dog again and again until the day is done and everyone goes home for the night at last", "en", "d", 11),
]
#: Columns whose names the operators use themselves.
OWN = ["id", "row", "t", "h", "d", "k", "at", "n", "p", "w", "g", "f", "fp", "a", "b", "u", "x", "ids", "node", "size", "bands", "component", "component_id", "lang_pred", "score", "loss", "ambiguous", "letters", "n_words", "hit_from", "hit_to", "items", "text_crc32", "virtual_slot", "shard", "slot", "version", "block", "part", "held_out", "rest", "ref_d", "_kept", "__d", "__k", "__at", "__n", "__fd", "__words", "__from", "__to", "__items", "__letters", "__score", "n.m"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in OWN)


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, *(f"{c} of {r[0]}" for c in OWN)) for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
