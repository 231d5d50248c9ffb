"""Column expressions on paths, file contents, queries and display values."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension -> language with definition rules.
LANGUAGES = {
    ".py": "python",
    ".go": "go",
    ".js": "javascript",
    ".ts": "typescript",
}

# Extensions scanned by default.
SOURCE_EXTENSIONS = (".py", ".go", ".js", ".ts", ".java", ".rs", ".c", ".cpp", ".h")

# Prefixes that mark a location as a remote repository.
REMOTE_PREFIXES = ("https://", "http://", "git://", "git@", "ssh://", "file://")

TOKEN = r"[a-z0-9_]+"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated a single time.

    An expression passed into a lambda is evaluated again for every element; as
    the lambda variable of a one-element array it is not.
    """
    return F.transform(F.array(value), use).getItem(0)


def extension(path: Column) -> Column:
    """Suffix of the file name from its last dot; '' for dot-only names and a trailing dot."""
    return F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]+)$", 1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_parts(path: Column) -> Column:
    """Sort key that orders paths by component, so `a/b.py` comes before `a-b.py`."""
    return F.split(path, "/")


def language(path: Column) -> Column:
    """Language of a file, NULL when there are no definition rules for it."""
    mapping = F.create_map(*[F.lit(part) for pair in LANGUAGES.items() for part in pair])
    return F.try_element_at(mapping, extension(path))


def line_count(text: Column) -> Column:
    """Newlines plus one: an empty text has one line."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def decode(content: Column) -> Column:
    """File bytes as text with `\\n` line ends."""
    return normalise_newlines(content.cast("string"))


def is_remote(location: Column) -> Column:
    """True for a repository URL, false for a local path (case-sensitive)."""
    test = F.lit(False)
    for prefix in REMOTE_PREFIXES:
        test = test | location.startswith(prefix)
    return test


def retrieval_text(name: Column, docstring: Column, source_text: Column) -> Column:
    """Text that is embedded and scored: name, docstring if any, source."""
    return F.concat_ws("\n", name, F.nullif(docstring, F.lit("")), source_text)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def utc_minute(timestamp: Column) -> Column:
    """Minute-precision text of a timestamp; the session time zone must be UTC."""
    return F.date_format(timestamp, "yyyy-MM-dd HH:mm 'UTC'")


def display_columns() -> list[Column]:
    """The three columns of a printed result table."""
    return [
        F.format_string("%.3f", F.col("score")).alias("score_text"),
        F.format_string("%s (%s)", F.col("name"), F.col("node_type")).alias("label"),
        F.format_string(
            "%s:%d-%d", F.col("file_path"), F.col("start_line"), F.col("end_line")
        ).alias("location"),
    ]
