"""Inputs of the checked queries, derived from the given tables row by row.

The tables hold no source code. A file per part is filled from a template, so that
the right chunks are known in closed form.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PY = '''# def hidden_{n}(): pass
import os

class Part_{n}(Base):
    """{name} part."""

    def weight(self, unit=(1,
            2)):
        text = "def fake(): {"
        return text

    @property
    async def size(self):
        def inner(x):
            return x  # class No:
        return inner


def build_{n}():
    \'\'\'Build {name}.

    class NotHere:
    \'\'\'
    return Part_{n}()

LIMIT = {n}
'''

GO = '''package parts

// func Hidden{n}() {}
type Part{n} struct { Size int }

func Build{n}(size int, extra interface{}) (*Part{n}, error) {
\tnote := `raw } func Fake() {`
\treturn &Part{n}{Size: size}, nil
}

func (p *Part{n}) Name() string {
\tif p.Size > 0 { return "{name} }" }
\treturn "none"
}

func Map{n}[T any, U interface{ A() }](xs []T) []U {
\treturn nil
}
'''

JS = '''// function hidden{n}() {}
export function build{n}({ size, color } = {}, extra) {
  const text = `x ${size} } {`;
  return function named() { return text; };
}
class Part{n} extends Base
{
  constructor(size) { super(size); }
  static async name() {
    if (this.size) { return "{name} {"; }
    return null;
  }
}
const table = { find(key) { return key; } };
function deep{n}() {
  return `a ${[1].map((x) => `{ ${x ? `(` : "}"} }`)} {`;
}
'''

TS = '''export abstract class Shape{n} { area(): number { return 0; } abstract side(): number; }
export class Part{n} implements Sized {
  constructor(private size: number) { }
  sides(): Promise<string[]> {
    return null;
  }
  pair(): { a: string } { return null; }
}
function over(a: string): void;
function over(a: any): void { }
function apply{n}<T extends (x: number) => void>(f: T): void {
  f({n});
}
'''

MD = '''# {name}

def not_code_{n}():
'''

RS = '''fn main() {}
// {name}
'''

TEMPLATES = {".py": PY, ".go": GO, ".js": JS, ".ts": TS, ".md": MD, ".rs": RS}

# (extension, kind, name, first line, last line, docstring) of every definition above.
DEFINITIONS = [
    (".py", "class", "Part_{n}", 4, 16, "{name} part."),
    (".py", "method", "weight", 7, 10, None),
    (".py", "method", "size", 13, 16, None),
    (".py", "method", "inner", 14, 15, None),
    (".py", "function", "build_{n}", 19, 24, "Build {name}.\n\n    class NotHere:"),
    (".go", "function", "Build{n}", 6, 9, None),
    (".go", "method", "Name", 11, 14, None),
    (".go", "function", "Map{n}", 16, 18, None),
    (".js", "function", "build{n}", 2, 5, None),
    (".js", "class", "Part{n}", 6, 13, None),
    (".js", "method", "constructor", 8, 8, None),
    (".js", "method", "name", 9, 12, None),
    (".js", "function", "find", 14, 14, None),
    (".js", "function", "deep{n}", 15, 17, None),
    (".ts", "method", "area", 1, 1, None),
    (".ts", "class", "Part{n}", 2, 8, None),
    (".ts", "method", "constructor", 3, 3, None),
    (".ts", "method", "sides", 4, 6, None),
    (".ts", "method", "pair", 7, 7, None),
    (".ts", "function", "over", 10, 10, None),
    (".ts", "function", "apply{n}", 11, 13, None),
]

# What is masked in the templates above: comments and strings whole, in types the brackets.
MASKED = {
    ".py": [
        ("comment", "# def hidden_{n}(): pass"),
        ("string", '"""{name} part."""'),
        ("string", '"def fake(): {"'),
        ("comment", "# class No:"),
        ("string", "'''Build {name}.\n\n    class NotHere:\n    '''"),
    ],
    ".go": [
        ("comment", "// func Hidden{n}() {}"),
        ("string", "`raw } func Fake() {`"),
        ("string", '"{name} }"'),
        ("string", '"none"'),
        ("type", "[T any, U interface{ A() }]"),
    ],
    ".js": [
        ("comment", "// function hidden{n}() {}"),
        ("string", "`x ${size} } {`"),
        ("string", '"{name} {"'),
        ("string", "`a ${[1].map((x) => `{ ${x ? `(` : \"}\"} }`)} {`"),
    ],
    ".ts": [("type", "<T extends (x: number) => void>")],
}

# What stands before and after the definition on its first and last line.
BEFORE = {
    (".js", "build{n}"): "export ",
    (".js", "find"): "const table = { ",
    (".ts", "area"): "export abstract class Shape{n} { ",
    (".ts", "Part{n}"): "export ",
}
AFTER = {
    (".py", "inner"): "  # class No:",
    (".js", "find"): " };",
    (".ts", "area"): " abstract side(): number; }",
}

# Files are far wider than the part rows they are filled from: so many of them are one task's work,
# however few splits the table has.
FILES_PER_TASK = 5_000

EXTENSIONS = [".py", ".PY", ".rs", ".h", "", ".tar.gz", ".cpp", ".md", ".ts", "."]
DIRECTORIES = [
    "src",
    "node_modules",
    ".git/hooks",
    "build",
    "pkg.egg-info",
    "_private",
    "Build",
    "env/x",
    "lib/dist",
    ".hidden",
    "a/.b",
    "environment",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(values: list[str], number: Column) -> Column:
    options = F.array(*[F.lit(v) for v in values])
    return F.get(options, (number % len(values)).cast("int"))


def fill(template: str, part: DataFrame) -> Column:
    numbered = F.replace(F.lit(template), F.lit("{n}"), part.p_partkey.cast("string"))
    return F.replace(numbered, F.lit("{name}"), part.p_name)


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    """(repo_id, path, content): one file per part; `.js` files have CRLF line ends."""
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    part = part.repartition(part.count() // FILES_PER_TASK + 1)
    kinds = list(TEMPLATES)
    suffix = pick(kinds, part.p_partkey)
    content = F.lit(None).cast("string")
    for kind in kinds:
        text = fill(TEMPLATES[kind], part)
        if kind == ".js":
            text = F.replace(text, F.lit("\n"), F.lit("\r\n"))
        content = F.when(suffix == kind, text).otherwise(content)
    brand = F.lower(part.p_brand)
    return part.select(
        F.substring(part.p_brand, 7, 10).cast("bigint").alias("repo_id"),
        F.concat(F.lit("src/"), brand, F.lit("/m_"), part.p_partkey.cast("string"), suffix).alias(
            "path"
        ),
        F.encode(content, "utf-8").alias("content"),
    )


def odd_paths(spark: SparkSession, folder: str) -> DataFrame:
    """(p_partkey, path) with all kinds of directories and extensions."""
    part = table(spark, folder, "part")
    key = part.p_partkey
    return part.select(
        "p_partkey",
        F.concat(
            pick(DIRECTORIES, key),
            F.lit("/"),
            F.replace(part.p_name, F.lit(" "), F.lit("-")),
            pick(EXTENSIONS, key.cast("bigint") + F.floor(key / 7)),
        ).alias("path"),
    )


def one_repo(key: Column) -> Column:
    """Repository 0 for every row: one key that holds the whole table."""
    return F.when(key.isNotNull(), F.lit(0)).cast("bigint")


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as chunks of one repository."""
    documents = table(spark, folder, "documents")
    return documents.select(
        one_repo(F.col("doc_id")).alias("repo_id"),
        F.col("doc_id").alias("chunk_pos"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"),
        F.lit("file").alias("node_type"),
        F.col("source").alias("name"),
        F.lit(1).alias("start_line"),
        F.lit(1).alias("end_line"),
        F.col("text").alias("source_text"),
        F.lit(None).cast("string").alias("docstring"),
    )


def benchmark_queries(spark: SparkSession, folder: str) -> DataFrame:
    """All benchmark texts as queries of that repository, with k from 1 to 15."""
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"),
        one_repo(F.col("item_id")).alias("repo_id"),
        "text",
        (F.col("item_id") % 15 + 1).cast("int").alias("k"),
    )


def label_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The embeddings with their label as repository."""
    return table(spark, folder, "embeddings").select(
        F.col("label").cast("bigint").alias("repo_id"),
        F.col("vec_id").alias("chunk_pos"),
        "embedding",
    )


def one_repo_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return label_vectors(spark, folder).withColumn("repo_id", F.lit(0).cast("bigint"))


def vector_queries(vectors: DataFrame, k: int = 10) -> DataFrame:
    """Every vector asked as a query of its repository."""
    return vectors.select(
        F.col("chunk_pos").alias("query_id"), "repo_id", "embedding", F.lit(k).alias("k")
    )


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as text files of four repositories, one per language."""
    documents = table(spark, folder, "documents")
    return documents.select(
        language_repo(F.col("lang")).alias("repo_id"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.encode("text", "utf-8").alias("content"),
    )


def language_repo(lang: Column) -> Column:
    return (
        F.when(lang == "en", 1).when(lang == "fr", 2).when(lang == "de", 3).otherwise(4)
    ).cast("bigint")
