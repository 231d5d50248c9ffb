"""Chunks of prose, markup and dialogue tables, in the chunk schema."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesearch.functions import text as T

PAGE = ["repo_id", "file_path"]
_PARTS = "array<struct<node_type:string,name:string,start_line:int,end_line:int,source_text:string>>"

# Elements that hold others, and elements of a piece of text, whose end tags pages often leave out.
CONTAINERS = (
    "html head body article aside blockquote details dialog div dl fieldset figure footer form header "
    "hgroup main menu nav ol search section select table tbody template tfoot thead ul"
).split()
PIECES = (
    "title h1 h2 h3 h4 h5 h6 p li pre dt dd tr td th caption figcaption legend summary option address "
    "textarea button hr"
).split()
# What is no text at all, whole, or to the end of the page where it does not end; tags of the
# elements above; other tags are part of their text.
HIDDEN = (
    r"<!--.*?(?:-->|\z)|<script(?:[\s/][^>]*)?>.*?(?:</script[^>]*>|\z)"
    r"|<style(?:[\s/][^>]*)?>.*?(?:</style[^>]*>|\z)|<[!?][^>]*(?:>|\z)"
)
TAGS = rf"</?(?:{'|'.join(CONTAINERS + PIECES)})(?:[\s/][^>]*)?(?:>|\z)"
MARKUP = rf"(?is){HIDDEN}|{TAGS}"
INLINE = r"<[^>]*>"


def document_lines(documents: DataFrame) -> DataFrame:
    """Non-blank lines of (repo_id, file_path, text) rows; the whole text if there is none."""
    lines = F.split(T.normalise_newlines(F.col("text")), "\n")
    numbered = T.once(
        lines,
        lambda all_lines: F.filter(
            F.transform(all_lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))),
            lambda e: e["text"].rlike(r"\S"),
        ),
    )
    parts = F.transform(
        numbered,
        lambda e: _part(
            "line",
            F.concat(F.lit("line "), e["line"].cast("string")),
            e["line"],
            e["line"],
            e["text"],
        ),
    )
    return _emit(documents, parts)


def page_elements(pages: DataFrame) -> DataFrame:
    """The pieces of text of (repo_id, file_path, text) pages; the whole page if it has none.

    A piece is what stands between two tags of block elements, inline markup included, comments, scripts
    and styles not; every visible character of a page is in one. Its name is that of the element
    of text it is in, or of the innermost open container. `file_path` must be unique in a repository.

    One row per tag: lines, depths and the pieces' numbers are running sums over a page. An element of text
    ends at the next block tag, whether it is closed or not, so it adds no depth; an end tag that
    nothing opened does not take the depth below zero.
    """
    text = F.coalesce("text", F.lit(""))
    tags = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(MARKUP), F.lit(0)))
    steps = F.arrays_zip(tags.alias("tag"), F.split(text, MARKUP, -1).alias("after"))
    rows = pages.select("repo_id", "file_path", F.posexplode(steps).alias("i", "step")).select(
        "repo_id", "file_path", "i", "step.tag", "step.after"
    )
    name = F.lower(F.regexp_extract("tag", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    ends = F.col("tag").startswith("</")
    named = rows.select("*", F.when(name.isin(*CONTAINERS, *PIECES), name).alias("element"))
    holds = F.col("element").isin(*CONTAINERS)
    marked = named.select(
        "*",
        F.when(holds, F.when(ends, -1).otherwise(1)).otherwise(0).alias("step"),
        F.when(holds & ~ends, F.col("element")).alias("container"),
        # The element of text from here on; none behind an end tag, a container's tag or a rule.
        F.when(holds | ends | (F.col("element") == "hr"), F.lit(""))
        .otherwise(F.col("element"))
        .alias("piece"),
        (F.length("tag") - F.length(F.replace("tag", F.lit("\n")))).alias("tag_lines"),
        (F.length("after") - F.length(F.replace("after", F.lit("\n")))).alias("lines"),
    )
    order = Window.partitionBy(*PAGE).orderBy("i")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    summed = marked.select(
        "*",
        F.sum("step").over(so_far).alias("sum"),
        F.sum(F.col("tag_lines") + F.col("lines")).over(so_far).alias("line_ends"),
        F.count("element").over(so_far).alias("group"),
        F.last("piece", ignorenulls=True).over(so_far).alias("in_piece"),
    )
    lowest = F.least(F.min("sum").over(so_far), F.lit(0))
    deep = summed.select("*", (F.col("sum") - lowest).alias("depth"))
    level = Window.partitionBy(*PAGE, "depth").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = deep.select(
        "*",
        F.when(F.col("in_piece") != "", F.col("in_piece"))
        .otherwise(F.when(F.col("depth") > 0, F.last("container", ignorenulls=True).over(level)))
        .alias("name"),
        # The line on which the text behind the tag begins.
        (F.col("line_ends") - F.col("lines") + 1).alias("first_line"),
    )
    item = F.struct("i", "after", "first_line", "lines")
    pieces = placed.groupBy(*PAGE, "group").agg(
        F.sort_array(F.collect_list(item)).alias("items"), F.min_by("name", "i").alias("name")
    )
    filled = F.filter("items", lambda x: F.regexp_replace(x["after"], INLINE, "").rlike(r"\S"))
    raw = F.array_join(F.transform("items", lambda x: x["after"]), "")
    shown = pieces.select(
        *PAGE,
        "group",
        F.coalesce("name", F.lit("page")).alias("name"),
        filled.alias("filled"),
        F.regexp_replace(raw, r"^\s+|\s+$", "").alias("source_text"),
    ).where(F.size("filled") > 0)

    def line_ends(value: Column) -> Column:
        return F.length(value) - F.length(F.replace(value, F.lit("\n")))

    first, last = F.get("filled", 0), F.element_at("filled", -1)
    leading = F.regexp_extract(first["after"], r"^\s*", 0)
    trailing = F.regexp_extract(last["after"], r"\s*$", 0)
    numbered = shown.select(
        *PAGE,
        (F.row_number().over(Window.partitionBy(*PAGE).orderBy("group")) - 1).alias("part"),
        F.lit("element").alias("node_type"),
        "name",
        (first["first_line"] + line_ends(leading)).cast("int").alias("start_line"),
        (last["first_line"] + last["lines"] - line_ends(trailing)).cast("int").alias("end_line"),
        "source_text",
        F.lit(None).cast("string").alias("docstring"),
    )
    bare = pages.join(numbered.select(*PAGE).distinct(), PAGE, "left_anti")
    return numbered.unionByName(_emit(bare, F.array().cast(_PARTS)))


def dialogue_turns(conversations: DataFrame) -> DataFrame:
    """One chunk per turn: (repo_id, file_path, turn, role, text)."""
    return conversations.select(
        "repo_id",
        "file_path",
        F.col("turn").cast("int").alias("part"),
        F.lit("turn").alias("node_type"),
        F.col("role").alias("name"),
        F.lit(1).alias("start_line"),
        T.line_count(F.col("text")).alias("end_line"),
        F.col("text").alias("source_text"),
        F.lit(None).cast("string").alias("docstring"),
    )


def _part(kind: str, name: Column, start: Column, end: Column, text: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("node_type"),
        name.alias("name"),
        start.cast("int").alias("start_line"),
        end.cast("int").alias("end_line"),
        text.alias("source_text"),
    )


def _emit(rows: DataFrame, parts: Column) -> DataFrame:
    whole = F.array(
        _part(
            "file",
            T.base_name(F.col("file_path")),
            F.lit(1),
            T.line_count(F.col("text")),
            F.col("text"),
        )
    )
    chosen = T.once(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(whole))
    return rows.select("repo_id", "file_path", F.posexplode(chosen).alias("part", "chunk")).select(
        "repo_id",
        "file_path",
        "part",
        "chunk.*",
        F.lit(None).cast("string").alias("docstring"),
    )
