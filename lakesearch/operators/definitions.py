"""Definitions (functions, classes, methods) of source files, as rows.

Every rule below works on narrow facts per line or per bracket. They are shuffled
once, on the file; the largest group is one file, which is one row of the input.
"""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lakesearch.functions import text as T
from lakesearch.operators import masking as M

FILE = ["repo_id", "path"]
# Columns of a definition: 1-based lines and character columns, both inclusive.
SPAN = ["start_line", "start_col", "end_line", "end_col"]
COLUMNS = FILE + SPAN + ["kind", "name", "body_line"]

ANONYMOUS = "<anonymous>"

# Words that can stand before `(` without naming a method.
NOT_A_METHOD = (
    "if for while switch catch with return function await typeof new in of else do case "
    "throw yield void delete import super this async"
).split()

_SPACE = " \t\f\r\u000b"
_PY_HEADER = r"(?U)^\uFEFF?(?:async[ \t]+)?(def|class)[ \t]+(\w+)"
_PY_DOC = rf"^[A-Za-z]{{0,2}}{M.OPEN}{M.FILL}*[ \t]*(?:;.*)?$"

_SCRIPT_FUNCTION = (
    r"(?:^|[\n;])\s*(?:export\s+)?(?:default\s+)?"
    r"((?:async\s+)?function\s+([\w$]+)\s*(?:<[^()]*>)?\s*)$"
)
_SCRIPT_CLASS = (
    r"(?:^|[\n;])\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(class\s+([\w$]+)[^;]*)$"
)
_SCRIPT_CLASS_BODY = r"(?<![\w$.])class\b[^;]*$"
_SCRIPT_METHOD = (
    r"(?:^|[\n;,])\s*(?:@[\w.]+\s+)*"
    r"((?:(?:static|async|get|set|public|private|protected|readonly|override)\s+)*\*?\s*"
    rf"([\w$#]+|\[[^\]]*\]|{M.OPEN}{M.FILL}*)\s*\??(?:<[^()]*>)?\s*)$"
)
_MEMBER_NAME = rf"([\w$#]+|\[[^\]]*\]|{M.OPEN}{M.FILL}*)\s*\??(?:<[^()]*>)?\s*$"
_GO_FUNCTION = r"(?:^|\n)(func\s+(\w+)\s*(?:\[(?s:.*)\])?\s*)$"
_GO_METHOD = r"(?:^|\n)(func\s*)$"


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _count(text: Column, brackets: str) -> Column:
    return F.length(text) - F.length(F.translate(text, brackets, ""))


def _python_lines(lines: DataFrame) -> DataFrame:
    """Facts of the lines that are not blank, without their text.

    Cheap tests come before patterns, since most lines are no headers.
    """
    code, word = F.col("code"), F.col("word")
    brackets = F.col("brackets")
    starts = word.startswith("def") | word.startswith("class") | word.startswith("async")
    quoted = F.contains(F.left("word", F.lit(3)), F.lit(M.OPEN))
    return (
        lines.withColumn("code", F.rtrim("code", F.lit(_SPACE)))
        .where(code != "")
        .withColumns(
            {
                "word": F.ltrim("code", F.lit(_SPACE)),
                "brackets": F.regexp_replace("code", r"[^(){}\[\]]++", ""),
            }
        )
        .select(
            *FILE,
            (F.col("pos") + 1).alias("line"),
            (F.length(code) - F.length(word)).alias("indent"),
            F.length(code).alias("width"),
            (_count(brackets, "([{") - _count(brackets, ")]}")).alias("nesting"),
            code.endswith("\\").alias("continues"),
            code.startswith(M.FILL).alias("in_string"),
            F.when(starts, F.regexp_extract(word, _PY_HEADER, 1)).otherwise("").alias("header"),
            F.when(starts, F.regexp_extract(word, _PY_HEADER, 2)).otherwise("").alias("name"),
            (quoted & word.rlike(_PY_DOC)).alias("doc"),
        )
    )


def python_definitions(files: DataFrame) -> DataFrame:
    """Blocks by indentation. `files` is (repo_id, path, text)."""
    lines = F.split(M.mask_python(F.col("text")), "\n")
    facts = _python_lines(files.select(*FILE, F.posexplode(lines).alias("pos", "code")))
    ordered = Window.partitionBy(*FILE).orderBy("line")
    whole = Window.partitionBy(*FILE)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum("nesting").over(before), F.lit(0))
    joined = F.lag("continues", 1, False).over(ordered) & (
        F.lag("line").over(ordered) == F.col("line") - 1
    )
    logical = (
        facts.withColumn("previous", F.lag(F.struct("line", "width")).over(ordered))
        .withColumn("logical", (depth <= 0) & ~F.col("in_string") & ~F.coalesce(joined, F.lit(False)))
        .withColumn("last", F.max(F.struct("line", "width")).over(whole))
        .where("logical")
        .drop("logical", "in_string", "continues", "nesting")
        .withColumn("next_line", F.lead("line").over(ordered))
        .withColumn("next_doc", F.lead("doc").over(ordered))
        .withColumn("levels", F.collect_set(F.when(F.col("header") != "", F.col("indent"))).over(whole))
    )
    # A block of a header ends before the next logical line that is not deeper. Per
    # header indent of the file, only the lines that can end such a block are kept.
    level = F.filter("levels", lambda k: k >= F.col("indent"))
    per_level = Window.partitionBy(*FILE, "level").orderBy("line")
    blocks = (
        logical.withColumn("level", F.explode(level))
        .withColumn("end", F.coalesce(F.lead("previous").over(per_level), F.col("last")))
        .where((F.col("header") != "") & (F.col("indent") == F.col("level")))
    )
    body = F.when(
        F.col("next_doc") & (F.col("next_line") <= F.col("end.line")), F.col("next_line")
    )
    spans = blocks.select(
        *FILE,
        F.col("line").alias("start_line"),
        (F.col("indent") + 1).alias("start_col"),
        F.col("end.line").alias("end_line"),
        F.col("end.width").alias("end_col"),
        F.when(F.col("header") == "class", "class").otherwise("function").alias("kind"),
        "name",
        body.alias("body_line"),
    )
    return _label_methods(spans)


def _bracket_facts(files: DataFrame) -> DataFrame:
    """One narrow row per bracket: what the code since the previous bracket says.

    `head` is a header that ends at the bracket, if any, with the place where it starts.
    The code itself is not kept, so it is not shuffled.
    """
    go, text = T.language(F.col("path")) == "go", F.col("text")
    # The scanner's input is made for all rows, so other languages are NULL there.
    masked = F.when(go, M.mask_go(text)).otherwise(M.mask_script(F.when(~go, text)))
    pieces = F.regexp_extract_all(masked, F.lit("[^{}()]*+[{}()]"), F.lit(0))
    rows = files.select(*FILE, go.alias("go"), F.posexplode(pieces).alias("idx", "piece"))
    rows = rows.withColumns(
        {
            "mark": F.right("piece", F.lit(1)),
            "gap": F.left("piece", F.length("piece") - 1),
        }
    )
    go, piece, gap, mark = (F.col(c) for c in ("go", "piece", "gap", "mark"))
    paren, brace = mark == "(", mark == "{"
    # A word test before a pattern: few gaps hold a keyword.
    func, klass = F.contains(gap, F.lit("func")), F.contains(gap, F.lit("class"))
    bound = paren | brace
    # One pattern per rule on the gap; names are taken from the short header it finds.
    rules = {
        "go function": (go & paren & func, _GO_FUNCTION, 1, r"^func\s+(\w+)"),
        "go method": (go & paren & func, _GO_METHOD, 1, None),
        "function": (~go & paren & func, _SCRIPT_FUNCTION, 1, r"\bfunction\s+([\w$]+)"),
        "class": (~go & bound & klass, _SCRIPT_CLASS, 1, r"^class\s+([\w$]+)"),
        "container": (~go & bound & klass, _SCRIPT_CLASS_BODY, 0, None),
        "member": (~go & paren, _SCRIPT_METHOD, 1, _MEMBER_NAME),
    }
    rows = rows.withColumns(
        {
            rule: F.coalesce(F.when(applies, F.regexp_extract(gap, pattern, group)), F.lit(""))
            for rule, (applies, pattern, group, _) in rules.items()
        }
    )
    rule, head = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in reversed(rules):
        rule = F.when(F.col(name) != "", name).otherwise(rule)
        head = F.when(F.col(name) != "", F.col(name)).otherwise(head)
    rows = rows.withColumns({"rule": rule, "head": head}).drop(*rules)
    name = F.lit(None).cast("string")
    for kind, (_, _, _, pattern) in rules.items():
        if pattern:
            found = F.regexp_extract("head", pattern, 1)
            name = F.when(F.col("rule") == kind, found).otherwise(name)
    rows = rows.withColumn("name", name)
    call = (F.col("rule") == "member") & F.col("name").isin(*NOT_A_METHOD)
    plain = F.when(F.col("name").rlike(r"^[\w$#]+$"), F.col("name"))
    before = F.left("gap", F.length("gap") - F.length("head"))
    last_line = F.length(F.regexp_extract(before, r"[^\n]*\z", 0))
    tail = F.length(F.regexp_extract(piece, r"[^\n]*\z", 0))
    return rows.select(
        *FILE,
        "go",
        "idx",
        "mark",
        F.length(piece).alias("length"),
        _newlines(piece).alias("breaks"),
        F.when(F.contains(piece, F.lit("\n")), tail).alias("tail"),
        F.when(~F.coalesce(call, F.lit(False)), F.col("rule")).alias("rule"),
        F.coalesce(plain, F.lit(ANONYMOUS)).alias("name"),
        _newlines(F.col("head")).alias("head_breaks"),
        F.length(before).alias("before"),
        F.when(F.contains(before, F.lit("\n")), last_line).alias("before_tail"),
        gap.rlike(r"[\n;]").alias("after_break"),
        gap.rlike(r"[\n;,]").alias("after_comma"),
        # What only an opening brace is asked for.
        F.when(brace & go, gap.rlike(r"\b(?:interface|struct)\s*$"))
        .when(brace, gap.rlike(r"[:|&<,=?]\s*$"))
        .alias("typed"),
        (brace & ~go & gap.rlike(r"^\s*(?::(?!.*=>)[^;]*[^:|&\s]\s*)?$")).alias("starts_body"),
        (brace & ~go & gap.rlike(r"^\s*:[^;]*$")).alias("starts_type"),
        (brace & ~go & gap.rlike(r"^\s*$")).alias("is_blank"),
        F.when(go & paren, F.regexp_extract(gap, r"^\s*(\w+)", 1)).alias("go_name"),
    )


def _placed_brackets(facts: DataFrame) -> DataFrame:
    """Line and column of each bracket, and its level: the depth around its pair, the
    same for both ends."""
    ordered = Window.partitionBy(*FILE).orderBy("idx")
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("mark").isin("{", "(")
    depth = F.sum(F.when(opens, 1).otherwise(-1)).over(running)
    last_break = F.when(F.col("tail").isNotNull(), F.col("offset") - F.col("tail"))
    return (
        facts.withColumns(
            {
                "offset": F.sum("length").over(running),
                "line": F.sum("breaks").over(running) + 1,
                "level": F.when(opens, depth - 1).otherwise(depth),
                "previous_mark": F.lag("mark").over(ordered),
            }
        )
        .withColumn(
            "col", F.col("offset") - F.coalesce(F.last(last_break, True).over(running), F.lit(0))
        )
        .withColumn("previous_col", F.coalesce(F.lag("col").over(ordered), F.lit(0)))
        .drop("length", "breaks", "tail", "offset")
    )


def _upwards() -> WindowSpec:
    """Per level and from the end of the file: the row before a bracket is the next one
    of its level, so the row before an opening bracket closes it."""
    return Window.partitionBy(*FILE, "level").orderBy(F.desc("idx"))


def _next(n: int, *columns: str) -> Column:
    return F.lag(F.struct(*columns), n).over(_upwards())


def _nearest(value: Column) -> Column:
    """The first value that is not NULL among the later brackets of the level."""
    return F.last(value, True).over(_upwards().rowsBetween(Window.unboundedPreceding, -1))


def brace_definitions(files: DataFrame) -> DataFrame:
    """Functions, classes and methods of Go, JavaScript and TypeScript files.

    Go has top-level functions and methods with receivers; the others have functions,
    classes and the methods of classes and object literals.
    """
    go, mark, previous, rule = (F.col(c) for c in ("go", "mark", "previous_mark", "rule"))
    # Nothing below the top level matters in Go.
    rows = _placed_brackets(_bracket_facts(files)).where(~go | (F.col("level") == 0))
    # A header at the very start of the gap follows the previous bracket directly.
    follows = previous.isNull() | previous.isin("{", "}", ")")
    statement = follows | F.col("after_break")
    member = (follows & previous.isNotNull()) | F.col("after_comma")
    rows = rows.withColumns(
        {
            # A class that is no statement still tells that its members are methods.
            "rule": F.when((rule == "class") & ~statement, "container")
            .when((rule == "function") & ~statement, None)
            .when((rule == "member") & ~member, None)
            .otherwise(rule),
            "close": _next(1, "idx", "line", "col"),
        }
    ).withColumns(
        {
            f"n{n}": _next(
                n, "idx", "line", "col", "mark", "starts_body", "starts_type", "is_blank",
                "go_name", "close",
            )
            for n in (2, 3, 4)
        }
    )
    # The body of a function or class is the next `{` of its level that does not start
    # a type; nothing else may be declared in between.
    body = (mark == "{") & ~F.col("typed")
    declares = rule.isin("go function", "go method", "function", "class")
    rows = rows.withColumns(
        {
            "body": _nearest(F.when(body, F.struct("idx", "close"))),
            "next_head": _nearest(F.when(declares, F.col("idx"))),
        }
    )
    reached = F.when(
        F.col("next_head").isNull() | (F.col("body.idx") < F.col("next_head")), F.col("body.close")
    )
    # A Go declaration without a body ends at its parameter list.
    params_close = F.struct(*[F.col(f"n3.{c}").alias(c) for c in ("idx", "line", "col")])
    go_method_end = F.coalesce(reached, F.when(F.col("n3").isNotNull(), params_close))
    # The body of a member follows its `)` directly, after a type at most.
    direct = (F.col("n2.mark") == "{") & (F.col("n2.idx") == F.col("close.idx") + 1)
    after_type = (
        direct
        & F.col("n2.starts_type")
        & (F.col("n4.mark") == "{")
        & (F.col("n4.idx") == F.col("n3.idx") + 1)
        & F.col("n4.is_blank")
    )
    member_end = F.when(direct & F.col("n2.starts_body"), F.col("n2.close")).when(
        after_type, F.col("n4.close")
    )
    class_end = F.when(mark == "{", F.col("close")).otherwise(reached)
    end = (
        F.when(rule == "go function", F.coalesce(reached, F.col("close")))
        .when(rule == "go method", go_method_end)
        .when(rule == "function", reached)
        .when(rule.isin("class", "container"), class_end)
        .when(rule == "member", member_end)
    )
    kind = (
        F.when(rule == "go method", "method")
        .when(rule.isin("class", "container"), "class")
        .otherwise("function")
    )
    go_name = F.coalesce(F.nullif(F.col("n2.go_name"), F.lit("")), F.lit(ANONYMOUS))
    heads = rows.withColumn("end", end).where(F.col("end").isNotNull())
    spans = heads.select(
        *FILE,
        (F.col("line") - F.col("head_breaks")).alias("start_line"),
        (F.coalesce("before_tail", F.col("previous_col") + F.col("before")) + 1).alias("start_col"),
        F.col("end.line").alias("end_line"),
        F.col("end.col").alias("end_col"),
        kind.alias("kind"),
        F.when(rule == "go method", go_name).otherwise(F.col("name")).alias("name"),
        F.lit(None).cast("int").alias("body_line"),
        (rule != "container").alias("emit"),
    )
    return _label_methods(spans).where("emit").drop("emit")


def _label_methods(spans: DataFrame) -> DataFrame:
    """Functions inside any class are methods.

    Definitions nest, so a class that starts earlier and ends no earlier contains.
    """
    end = F.struct("end_line", "end_col")
    earlier = (
        Window.partitionBy(*FILE)
        .orderBy("start_line", "start_col")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    reach = F.max(F.when(F.col("kind") == "class", end)).over(earlier)
    inside = F.coalesce(reach >= end, F.lit(False))
    kind = F.when(inside & (F.col("kind") == "function"), "method").otherwise(F.col("kind"))
    return spans.withColumn("kind", kind)
