"""Hide literals and comments so that headers and brackets inside them are not seen.

The masked text has the same characters per line as the source: comments become
blanks, a string starts with OPEN and goes on with FILL, line ends stay.

Patterns do this for texts whose templates nest no deeper than a pattern can say. Rows with deeper
ones, or with more blanks before a regular expression literal than a look-behind may hold, go
through a scanner that keeps the open templates and braces on a stack; other rows do not reach it.
"""

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lakesearch.functions import text as T

OPEN = "\u0002"
FILL = "\u0001"

# Possessive quantifiers throughout: Java matches them in a loop, without recursion.
_DOUBLE = r'"(?:[^"\\\n]++|\\.)*+"'
_SINGLE = r"'(?:[^'\\\n]++|\\.)*+'"
_BLOCK_COMMENT = r"/\*(?:[^*]++|\*(?!/))*+\*/"
_LINE_COMMENT = r"//[^\n]*+"
_RAW = r"`[^`]*+`"
#: Templates and braces inside `${}` are followed this deep by the pattern.
_DEPTH = 6
#: Blanks before a regular expression literal that its look-behind takes.
_BLANKS = 100


def _inside(depth: int) -> str:
    """What may stand between the braces of a `${}`: code, strings, templates and blocks."""
    parts = r"[^`{}\"'/]++|/\*(?:[^*]++|\*(?!/))*+\*/|/|" + _DOUBLE + "|" + _SINGLE
    if depth:
        within = _inside(depth - 1)
        parts += rf"|\{{(?:{within})*+\}}|{_template(within)}"
    return parts + r"|[\"']"


def _template(within: str) -> str:
    return rf"`(?:[^`\\$]++|\\.|\$(?!\{{)|\$\{{(?:{within})*+\}})*+`"


_TEMPLATE = _template(_inside(_DEPTH))
_REGEX = (
    # The slash is looked for first: the look-behind tries every length at every place.
    rf"(?=/)(?<=(?:^|[(,=:\[!&|?{{}};\n]|\breturn)[ \t]{{0,{_BLANKS}}})/(?![/*])"
    r"(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/"
)

# Alternatives in order; what matches none of the literals is code.
PYTHON = "(?s)" + "|".join(
    [
        r'"""(?:[^"\\]++|\\.|"(?!""))*+"""',
        r"'''(?:[^'\\]++|\\.|'(?!''))*+'''",
        _DOUBLE,
        _SINGLE,
        r"#[^\n]*+",
        r"""[^"'#]++""",
        r".",
    ]
)
GO = "(?s)" + "|".join(
    [_BLOCK_COMMENT, _LINE_COMMENT, _RAW, _DOUBLE, _SINGLE, r"""[^"'`/]++""", r"."]
)
SCRIPT = "(?s)" + "|".join(
    [
        _BLOCK_COMMENT,
        _LINE_COMMENT,
        _REGEX,
        _TEMPLATE,
        _DOUBLE,
        _SINGLE,
        r"""[^"'`/]++""",
        r".",
    ]
)


def _blank(token: Column) -> Column:
    return F.regexp_replace(token, r"[^\n]", " ")


def _fill(token: Column) -> Column:
    rest = F.regexp_replace(F.substring(token, 2, 2147483647), r"[^\n]", FILL)
    return F.concat(F.lit(OPEN), rest)


def _join(tokens: Column) -> Column:
    return F.array_join(tokens, "")


def mask_python(text: Column) -> Column:
    def hide(token: Column) -> Column:
        string = token.startswith('"') | token.startswith("'")
        return (
            F.when(token.startswith("#"), _blank(token))
            .when(string & (F.length(token) > 1), _fill(token))
            .otherwise(token)
        )

    return _join(F.transform(F.regexp_extract_all(text, F.lit(PYTHON), F.lit(0)), hide))


def _mask_braces(text: Column, pattern: str) -> Column:
    def hide(token: Column) -> Column:
        comment = token.startswith("//") | token.startswith("/*")
        string = F.lit(False)
        for quote in ('"', "'", "`", "/"):
            string = string | token.startswith(quote)
        return (
            F.when(comment, _blank(token))
            .when(string & (F.length(token) > 1), _fill(token))
            .otherwise(token)
        )

    return _join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), hide))


def mask_go(text: Column) -> Column:
    def typed(masked: Column) -> Column:
        found = F.contains(masked, F.lit("func")) & masked.rlike(_GO_TYPE_PARAMETERS)
        return F.when(found, _hide_brackets(masked, _GO_TYPE_PARAMETERS)).otherwise(masked)

    return T.once(_mask_braces(text, GO), typed)


def mask_script(text: Column) -> Column:
    def shallow(plain: Column) -> Column:
        # A back-tick that the pattern left, or a slash behind more blanks than its look-behind takes.
        deep = F.contains(text, F.lit("${")) & F.contains(plain, F.lit("`"))
        return F.when(~(deep | text.rlike(rf"[ \t]{{{_BLANKS},}}/")), plain)

    def typed(masked: Column) -> Column:
        found = masked.rlike(_SCRIPT_TYPES)
        return F.when(found, _hide_brackets(masked, _SCRIPT_TYPES)).otherwise(masked)

    plain = T.once(_mask_braces(text, SCRIPT), shallow)
    return T.once(F.coalesce(plain, _scan(F.when(plain.isNull(), text))), typed)


# Types that hold brackets: they would be taken for parameters and bodies.


def _balanced(opening: str, closing: str, other: str, depth: int = 8) -> str:
    inside = rf"(?:{other})*+"
    for _ in range(depth):
        inside = rf"(?:{other}|{opening}{inside}{closing})*+"
    return rf"{opening}{inside}{closing}"


_ANGLES = _balanced("<", ">", r"[^<>=]++|=>|=(?!>)")
_ROUNDS = _balanced(r"\(", r"\)", r"[^()]++")
_SQUARES = _balanced(r"\[", r"\]", r"[^\[\]]++")
_GO_TYPE_PARAMETERS = rf"\bfunc\s+\w+\s*{_SQUARES}(?=\s*\()"
#: Type parameters behind a name, and function types that are what a parameter list returns.
_SCRIPT_TYPES = (
    rf"(?<![\w$])[\w$]+\s*(?=<[^;]*(?:=>|\bextends\b)){_ANGLES}(?=\s*[({{])"
    rf"|\)\s*:\s*{_ROUNDS}\s*=>\s*[\w$.<>\[\]| ]+(?=\s*\{{)"
)


def _hide_brackets(masked: Column, pattern: str) -> Column:
    """Brackets and arrows in what the pattern finds become FILL; a first `)` stays."""
    found = F.regexp_extract_all(masked, F.lit(rf"(?s){pattern}"), F.lit(0))
    between = F.split(masked, rf"(?s){pattern}", -1)

    def hide(before: Column, token: Column) -> Column:
        hidden = F.translate(F.substring(token, 2, 2147483647), "(){}=", FILL * 5)
        # Behind the last match there is text, but no token.
        return F.concat(before, F.coalesce(F.concat(F.left(token, F.lit(1)), hidden), F.lit("")))

    return _join(F.zip_with(between, found, hide))


# The scanner

_UNENDED = 100
_CODE = re.compile(r"""[^"'`/{}]+|//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|.""", re.S)
_LITERAL = re.compile(r"/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/", re.S)
_IN_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))+|`|\$\{|.", re.S)


def _literal_may_start(text: str, at: int) -> bool:
    """Whether a slash is no division, by what stands before it."""
    while at and text[at - 1] in " \t":
        at -= 1
    word = re.search(r"\w*\Z", text[max(0, at - 8) : at])[0]
    return at == 0 or text[at - 1] in "(,=:[!&|?{};\n" or word == "return"


def _template_end(text: str, at: int) -> int:
    """The place behind the template that begins at `at`; -1 if it does not end. What is open, templates
    and braces of code in them, is on a stack."""
    stack = ["`"]
    at += 1
    while at < len(text):
        if stack[-1] == "`":
            found = _IN_TEMPLATE.match(text, at)[0]
            if found == "`":
                stack.pop()
                if not stack:
                    return at + 1
            elif found == "${":
                stack.append("{")
        else:
            found = _CODE.match(text, at)[0]
            if found == "}":
                stack.pop()
            elif found in ("`", "{"):
                stack.append(found)
        at += len(found)
    return -1


def scan_script(text: str) -> str:
    """The masked text, whatever its nesting. A back-tick whose template does not end is code; behind
    `_UNENDED` of them all are, so broken texts take linear time too."""
    out: list[str] = []
    at, unended = 0, 0
    while at < len(text):
        found = _CODE.match(text, at)[0]
        if found == "`" and unended < _UNENDED:
            end = _template_end(text, at)
            unended += end < 0
            found = text[at:end] if end > 0 else found
        elif found == "/" and _literal_may_start(text, at):
            literal = _LITERAL.match(text, at)
            found = literal[0] if literal else found
        if found.startswith(("//", "/*")) and len(found) > 1:
            out.append(re.sub(r"[^\n]", " ", found))
        elif found[0] in "\"'`/" and len(found) > 1:
            out.append(OPEN + re.sub(r"[^\n]", FILL, found[1:]))
        else:
            out.append(found)
        at += len(found)
    return "".join(out)


@F.pandas_udf(StringType())
def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(scan_script, na_action="ignore")
