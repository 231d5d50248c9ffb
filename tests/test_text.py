import pathlib

from pyspark.sql import functions as F

from lakesearch.functions import text as T
from lakesearch.functions import vectors as V
from lakesearch.operators import filters

NAMES = ["a.py", "a", ".py", "a.", "a.tar.gz", "..py", ".a.py", "a..", "x.y/b", "d.e/.c", "A.PY", "a b.c"]


def test_extension_equals_path_suffix(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "p string")
    got = {r.p: r.e for r in rows.withColumn("e", T.extension(F.col("p"))).collect()}
    for name in NAMES:
        last = name.split("/")[-1]
        # A trailing dot gives no suffix.
        expected = "" if last.endswith(".") else pathlib.PurePosixPath(name).suffix
        if last.strip(".") and last.startswith("."):
            expected = "." + last.split(".")[-1] if "." in last[1:] else ""
        assert got[name] == expected, name


def test_excluded_directories_spare_file_names(spark):
    paths = {
        "a.py": False, ".hidden.py": False, "build": False, ".git/a.py": True, "x/.b/a.py": True,
        "a/venv/b.py": True, "venv2/b.py": False, "p.egg-info/a.py": True, "Build/a.py": False,
    }
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    got = rows.withColumn("x", filters.under_excluded_directory(F.col("p"))).collect()
    assert {r.p: r.x for r in got} == paths


def test_newlines_and_line_counts(spark):
    rows = spark.createDataFrame([("a\r\nb\rc\n",), ("",), ("x",)], "t string")
    clean = T.normalise_newlines(F.col("t"))
    got = rows.select(clean.alias("c"), T.line_count(clean).alias("n")).collect()
    assert [(r.c, r.n) for r in got] == [("a\nb\nc\n", 4), ("", 1), ("x", 1)]


def test_retrieval_text_skips_missing_docstrings(spark):
    rows = spark.createDataFrame([("n", None, "s"), ("n", "", "s"), ("n", "d", "s")], "n string, d string, s string")
    got = rows.select(T.retrieval_text(F.col("n"), F.col("d"), F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == ["n\ns", "n\ns", "n\nd\ns"]


def test_unit_vectors_and_zero(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [r.u for r in rows.select(V.unit(F.col("v")).alias("u")).collect()]
    assert [round(x, 6) for x in got[0]] == [0.6, 0.8]
    assert got[1] == [0.0, 0.0]


def test_display_columns(spark):
    row = spark.createDataFrame(
        [(0.12345, "f", "function", "a.py", 3, 9)],
        "score double, name string, node_type string, file_path string, start_line int, end_line int",
    )
    assert tuple(row.select(*T.display_columns()).first()) == ("0.123", "f (function)", "a.py:3-9")
