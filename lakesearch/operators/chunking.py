"""Files to chunks: one per definition, or the whole file where there is none."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.functions import text as T
from lakesearch.operators import definitions as D
from lakesearch.operators.positions import running_offset
from lakesearch.session import cut_lineage

FILE = D.FILE
# The negated ends make the natural order of a span the source order: earlier start
# first, and of two with the same start the longer one.
_SPANS = (
    "array<struct<start_line:int,start_col:int,back_line:int,back_col:int,"
    "end_line:int,end_col:int,kind:string,name:string,body_line:int>>"
)
_DOC = (
    r"^[ \t\f]*[A-Za-z]{0,2}"
    r"(\"\"\"(?s:(?:[^\"\\]++|\\.|\"(?!\"\"))*+)\"\"\""
    r"|'''(?s:(?:[^'\\]++|\\.|'(?!''))*+)'''"
    r"|\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+')"
    r"[ \t]*(?:[;#\n]|$)"
)


def decoded(files: DataFrame) -> DataFrame:
    """(repo_id, path, text) with `\\n` line ends, from file bytes or text."""
    return files.select(*FILE, T.decode(F.col("content")).alias("text"))


def plan_chunks(files: DataFrame) -> DataFrame:
    """One narrow row per file: its definitions in source order, empty when it has none.

    `files` is (repo_id, path, text); (repo_id, path) must be unique.
    """
    language = T.language(F.col("path"))
    python = D.python_definitions(files.where(language == "python"))
    braces = D.brace_definitions(files.where(language.isin("go", "javascript", "typescript")))
    spans = python.select(*D.COLUMNS).unionByName(braces.select(*D.COLUMNS))
    # A file without definitions keeps a row: NULLs are not collected.
    every = files.select(*FILE, *[F.lit(None).alias(c) for c in D.COLUMNS if c not in FILE])
    entry = F.struct(
        "start_line",
        "start_col",
        (-F.col("end_line")).alias("back_line"),
        (-F.col("end_col")).alias("back_col"),
        "end_line",
        "end_col",
        "kind",
        "name",
        "body_line",
    )
    found = F.when(F.col("name").isNotNull(), entry)
    return (
        spans.unionByName(every)
        .groupBy(*FILE)
        .agg(F.array_sort(F.collect_list(found).cast(_SPANS)).alias("spans"))
    )


def chunk_count() -> Column:
    return F.greatest(F.size("spans"), F.lit(1)).cast("bigint")


def cut_chunks(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Chunk rows of the planned files; `part` numbers the chunks of a file from 0.

    Columns of `plan` beyond its key and spans are passed through. This is the only
    step that shuffles file texts, and none is shuffled when the plan is small.
    """
    extra = [c for c in plan.columns if c not in [*FILE, "spans"]]
    rows = files.join(plan, FILE)
    lines = T.line_count(F.col("text"))
    widest = F.lit(2147483647)
    whole = F.struct(
        F.lit(1).alias("start_line"),
        F.lit(1).alias("start_col"),
        (-lines).alias("back_line"),
        (-widest).alias("back_col"),
        lines.alias("end_line"),
        widest.alias("end_col"),
        F.lit("file").alias("kind"),
        T.base_name(F.col("path")).alias("name"),
        F.lit(None).cast("int").alias("body_line"),
    )
    spans = F.when(F.size("spans") > 0, F.col("spans")).otherwise(F.array(whole))
    cut = T.once(F.split("text", "\n"), lambda lines: F.transform(spans, lambda s: _cut(lines, s)))
    exploded = rows.select(*FILE, *extra, F.posexplode(cut).alias("part", "chunk"))
    return exploded.select(
        "repo_id",
        F.col("path").alias("file_path"),
        *extra,
        "part",
        F.col("chunk.kind").alias("node_type"),
        "chunk.name",
        "chunk.start_line",
        "chunk.end_line",
        "chunk.source_text",
        "chunk.docstring",
    )


def _cut(lines: Column, span: Column) -> Column:
    count = span["end_line"] - span["start_line"] + 1
    last = F.length(F.get(lines, span["end_line"] - 1))
    beyond = F.greatest(last - span["end_col"], F.lit(0))

    def trimmed(body: Column) -> Column:
        return F.substring(
            body, span["start_col"], F.length(body) - span["start_col"] + 1 - beyond
        )

    def unquoted(literal: Column) -> Column:
        inner = F.trim(literal, F.lit("\"'"))
        return F.when(literal != "", F.regexp_replace(inner, r"^\s+|\s+$", ""))

    body = F.array_join(F.slice(lines, span["start_line"], count), "\n")
    doc_lines = F.slice(lines, span["body_line"], span["end_line"] - span["body_line"] + 1)
    literal = F.regexp_extract(F.array_join(doc_lines, "\n"), _DOC, 1)
    return F.struct(
        span["kind"].alias("kind"),
        span["name"].alias("name"),
        span["start_line"].alias("start_line"),
        span["end_line"].alias("end_line"),
        T.once(body, trimmed).alias("source_text"),
        F.when(span["body_line"].isNotNull(), T.once(literal, unquoted)).alias("docstring"),
    )


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of (repo_id, path, text) rows, without positions."""
    return cut_chunks(files, plan_chunks(files)).drop("part")


def place_chunks(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Chunks with `chunk_pos`: 0-based per repository, by path component, then source order.

    Positions come from the narrow plan (chunks per file), not from the chunk rows. The
    plan is used twice and should be written already.
    """
    order = [T.path_parts(F.col("path"))]
    counts = plan.select(*FILE, chunk_count().alias("chunks"))
    offsets = running_offset(counts, ["repo_id"], order, F.col("chunks"), name="first")
    placed = plan.join(offsets.select(*FILE, "first"), FILE)
    return (
        cut_chunks(files, placed)
        .withColumn("chunk_pos", F.col("first") + F.col("part"))
        .drop("first", "part")
    )


def chunk_files_with_positions(files: DataFrame) -> DataFrame:
    return place_chunks(files, cut_lineage(plan_chunks(files)))
