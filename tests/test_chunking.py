import ast
import os
import random
import sysconfig
import time

import pytest
from pyspark.sql import functions as F

from lakesearch.operators import masking
from lakesearch.operators.chunking import chunk_files, chunk_files_with_positions, decoded

FILES = "repo_id bigint, path string, text string"

PY = '''class Shape:
    """A shape."""

    def area(self):
        return 0


def plain(a,
          b=(1,
             2)):
    # def hidden(): pass
    text = """
def also_hidden():
"""
    return text


@decorator
async def outer():
    def inner():
        \'\'\'  Inner doc. \'\'\'
    return inner
'''

SCRIPT = '''import x from "y";
export default function build({ a, b } = {}) {
  const text = `one ${a} { two ${`three`} }`;
  const pattern = /[{]"/;
  if (a) { return 1; }
  const arrow = (x) => { return x; };
  return function named() { return text; };
}
class Base extends Mixin(Other) { constructor() { super(); } get size() { return 1; } }
const table = { find(key) { return key; }, other: function () { } };
const Late = class { run() { } };
(function iife() { })();
function* generator() { yield 1; }
'''


def rows_of(chunks):
    return [
        (r.node_type, r.name, r.start_line, r.end_line)
        for r in chunks.orderBy("file_path", "start_line", F.desc("end_line")).collect()
    ]


def chunks_of(spark, path, text):
    return chunk_files(spark.createDataFrame([(1, path, text)], FILES))


def test_python_definitions(spark):
    chunks = chunks_of(spark, "a.py", PY)
    assert rows_of(chunks) == [
        ("class", "Shape", 1, 5),
        ("method", "area", 4, 5),
        ("function", "plain", 8, 15),
        ("function", "outer", 19, 22),
        ("function", "inner", 20, 21),
    ]
    found = {r.name: r for r in chunks.collect()}
    assert found["Shape"].docstring == "A shape."
    assert found["inner"].docstring == "Inner doc."
    assert found["area"].docstring is None
    assert found["outer"].source_text.startswith("async def outer():")
    assert found["area"].source_text == "def area(self):\n        return 0"


def test_script_definitions(spark):
    chunks = chunks_of(spark, "a.js", SCRIPT)
    assert rows_of(chunks) == [
        ("function", "build", 2, 8),
        ("class", "Base", 9, 9),
        ("method", "constructor", 9, 9),
        ("method", "size", 9, 9),
        ("function", "find", 10, 10),
        ("method", "run", 11, 11),
    ]
    found = {r.name: r.source_text for r in chunks.collect()}
    assert found["build"].startswith("function build(") and found["build"].endswith("}")
    assert found["size"] == "get size() { return 1; }"


def test_go_definitions(spark):
    text = (
        "package a\n\ntype T struct { a int }\n\n"
        "func Add(a int, b interface{}) (int, error) {\n\ts := `} func x() {`\n\treturn a, nil\n}\n\n"
        "func (t *T) Name() string {\n\treturn \"}\"\n}\n\nfunc external(x int)\n\n"
        "func Map[K comparable](m map[K]interface{}) interface{} { return m }\n"
    )
    assert rows_of(chunks_of(spark, "a.go", text)) == [
        ("function", "Add", 5, 8),
        ("method", "Name", 10, 12),
        ("function", "external", 14, 14),
        ("function", "Map", 16, 16),
    ]


def test_typescript_members(spark):
    text = (
        "export abstract class S { go(): void { } abstract x(): void; }\n"
        "export class U<T> implements V {\n"
        "  private readonly v: number = 1;\n"
        "  constructor(private a: string) { }\n"
        "  @Input() set q(v: string) { this.v = v }\n"
        "  ret(): Promise<string[]> { return null }\n"
        "  lit(): { a: string } { return null }\n}\n"
        "function over(a: string): void;\n"
        "function over(a: any): void { }\n"
        "interface I { m(a: string): void }\n"
    )
    assert rows_of(chunks_of(spark, "a.ts", text)) == [
        ("method", "go", 1, 1),
        ("class", "U", 2, 8),
        ("method", "constructor", 4, 4),
        ("method", "q", 5, 5),
        ("method", "ret", 6, 6),
        ("method", "lit", 7, 7),
        ("function", "over", 10, 10),
    ]


@pytest.mark.parametrize(
    "path, text, lines",
    [("empty.py", "", 1), ("config.py", "A = 1\nB = 2\n", 3), ("notes.md", "def f(): pass", 1),
     ("A.java", "class A {}\n", 2), ("noext", "x", 1)],
)
def test_whole_file_fallback(spark, path, text, lines):
    chunk = chunks_of(spark, "d/" + path, text).collect()
    assert len(chunk) == 1
    only = chunk[0]
    assert (only.node_type, only.name, only.start_line, only.end_line) == ("file", path, 1, lines)
    assert only.source_text == text and only.docstring is None


def test_masking_keeps_length_and_lines(spark):
    rows = spark.createDataFrame([(PY, SCRIPT)], "py string, js string")
    masked = rows.select(
        masking.mask_python(F.col("py")).alias("py"), masking.mask_script(F.col("js")).alias("js")
    ).first()
    assert len(masked.py) == len(PY) and masked.py.count("\n") == PY.count("\n")
    assert len(masked.js) == len(SCRIPT) and masked.js.count("\n") == SCRIPT.count("\n")
    assert "hidden" not in masked.py and "two" not in masked.js


def nested(depth):
    """Templates in the braces of templates, each with a brace and an arrow function of its own."""
    inner = f"${{rows.map((r) => {{ return {nested(depth - 1)} }})}}" if depth else "} { function no() {"
    return f"`text {{ ( {inner} }}`"


@pytest.mark.parametrize("depth", [0, 1, 2, 7, 10, 40])
def test_templates_nest_to_any_depth(spark, depth):
    text = f"function before() {{\n  return {nested(depth)};\n}}\nfunction after() {{ }}\n"
    assert rows_of(chunks_of(spark, "a.js", text)) == [
        ("function", "before", 1, 3),
        ("function", "after", 4, 4),
    ]


@pytest.mark.parametrize("blanks", [0, 50, 2_000])
def test_blanks_before_a_regular_expression(spark, blanks):
    text = f"function a() {{\n  x = {' ' * blanks}/[}}]{{/;\n}}\nfunction b() {{ return 4 {' ' * blanks}/ 2; }}\n"
    assert rows_of(chunks_of(spark, "a.ts", text)) == [("function", "a", 1, 3), ("function", "b", 4, 4)]


def test_the_scanner_equals_the_patterns_on_plain_templates(spark):
    pick = random.Random(2)
    parts = ["`a ${x} b`", '"s{"', "'}'", "// c {\n", "/* } */", "= /[}]/g;", "{", "}", " a / b ", "\n", "`\\``", "(", ")", "return /x{2}/;"]
    texts = ["".join(pick.choice(parts) for _ in range(20)) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", masking._mask_braces(F.col("t"), masking.SCRIPT).alias("m"))
    for r in rows.collect():
        assert masking.scan_script(r.t) == r.m


def test_broken_templates_take_linear_time():
    began = time.perf_counter()
    for text in ("`${" * 50_000, "`" * 100_001, "${`" * 30_000, "`${{" * 30_000, '"' * 100_000, "/" * 100_000):
        assert len(masking.scan_script(text)) == len(text)
    assert time.perf_counter() - began < 20


def test_types_with_brackets_hide_no_header(spark):
    go = (
        "package a\n\nfunc Map[T any, U interface{ A() }](xs []T) []U {\n\treturn nil\n}\n\n"
        "func Each[K comparable, F func(K) (int, error)](f F) {\n}\n\n"
        "func Pair[T ~[]int | map[string][]struct{ x int }](t T) { }\n"
    )
    assert rows_of(chunks_of(spark, "a.go", go)) == [
        ("function", "Map", 3, 5),
        ("function", "Each", 7, 8),
        ("function", "Pair", 10, 10),
    ]
    ts = (
        "function apply<T extends (x: number) => void>(f: T): void {\n  f(1);\n}\n"
        "export function make<A, F extends { run(a: A): (b: A) => void }>(a: A) {\n}\n"
        "class Box<T extends () => void> {\n  get<U extends (u: U) => T>(u: U): U { return u; }\n"
        "  handler(a: string): (b: number) => void {\n    return null;\n  }\n}\n"
        "const less = (a, b) => { if (a < (b) && (c) > (d)) { return f(a); } };\n"
        "function last() { }\n"
    )
    assert rows_of(chunks_of(spark, "a.ts", ts)) == [
        ("function", "apply", 1, 3),
        ("function", "make", 4, 5),
        ("class", "Box", 6, 11),
        ("method", "get", 7, 7),
        ("method", "handler", 8, 10),
        ("function", "last", 13, 13),
    ]


def test_long_literals_do_not_overflow_the_stack(spark):
    body = "x" * 300_000
    text = f'def f():\n    """{body}\n{body}"""\n    return 1\n\ndef g(): pass\n'
    assert rows_of(chunks_of(spark, "a.py", text)) == [
        ("function", "f", 1, 4),
        ("function", "g", 6, 6),
    ]


def test_positions_follow_path_components(spark):
    rows = [(1, p, "def f(): pass\n\ndef g(): pass\n") for p in ("a-b.py", "a/b.py", "a/_c.py")]
    rows += [(2, "z.py", "x = 1")]
    placed = chunk_files_with_positions(spark.createDataFrame(rows, FILES)).collect()
    got = sorted((r.repo_id, r.chunk_pos, r.file_path, r.name) for r in placed)
    assert got == [
        (1, 0, "a/_c.py", "f"), (1, 1, "a/_c.py", "g"), (1, 2, "a/b.py", "f"), (1, 3, "a/b.py", "g"),
        (1, 4, "a-b.py", "f"), (1, 5, "a-b.py", "g"), (2, 0, "z.py", "z.py"),
    ]


def test_partitioning_does_not_change_chunks(spark):
    rows = [(i % 3, f"d{i}/m.py", PY) for i in range(12)] + [(1, f"s{i}.js", SCRIPT) for i in range(5)]
    frame = spark.createDataFrame(rows, FILES)
    one = chunk_files_with_positions(frame.repartition(1))
    many = chunk_files_with_positions(frame.repartition(16))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_line_ends_are_normalised(spark):
    frame = spark.createDataFrame(
        [(1, "a.py", b"def f():\r\n    return 1\r\n")], "repo_id bigint, path string, content binary"
    )
    chunk = chunk_files(decoded(frame)).first()
    assert chunk.source_text == "def f():\n    return 1" and chunk.end_line == 2


def _expected(text):
    found = {}

    def visit(node, in_class):
        for child in ast.iter_child_nodes(node):
            klass = isinstance(child, ast.ClassDef)
            if klass or isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "class" if klass else "method" if in_class else "function"
                source = ast.get_source_segment(text, child)
                documented = ast.get_docstring(child, clean=False) is not None
                found[(child.lineno, child.name)] = (kind, child.end_lineno, source, documented)
            visit(child, in_class or klass)

    visit(ast.parse(text), False)
    return found


def test_python_chunks_equal_the_parser_on_the_standard_library(spark):
    folder = sysconfig.get_paths()["stdlib"]
    names = sorted(n for n in os.listdir(folder) if n.endswith(".py"))
    rows, expected = [], {}
    for name in names:
        with open(os.path.join(folder, name), encoding="utf-8") as file:
            text = file.read()
        rows.append((1, name, text))
        expected.update({(name, *key): value for key, value in _expected(text).items()})
    chunks = chunk_files(spark.createDataFrame(rows, FILES).repartition(8))
    got = {
        (r.file_path, r.start_line, r.name): (
            r.node_type, r.end_line, r.source_text, r.docstring is not None
        )
        for r in chunks.where("node_type <> 'file'").collect()
    }
    assert len(expected) > 1000
    assert got == expected


def test_files_of_one_split_are_many_tasks(spark, tmp_path, monkeypatch):
    """A narrow part table is one split; the files filled from it are far wider."""
    from checks import inputs

    part = spark.range(1000).selectExpr("id p_partkey", "'a name' p_name", "'Brand#1' || id % 9 p_brand")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(inputs, "FILES_PER_TASK", 100)
    files = inputs.code_files(spark, str(tmp_path))
    sizes = files.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 1000
    assert len(sizes) > 8 and max(r["count"] for r in sizes) < 200


def test_brackets_in_types_are_hidden_around_matches(spark):
    """First, last and neighbouring matches, and what stands between them."""
    texts = {
        "func A[T any](x)": "func A[T any](x)",
        "func A[T f(a)](x) func B[U {b}](y)": "func A[T f\1a\1](x) func B[U \1b\1](y)",
        "é = 1": "é = 1",
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.m for r in rows.select("t", masking.mask_go(F.col("t")).alias("m")).collect()}
    assert got == texts
