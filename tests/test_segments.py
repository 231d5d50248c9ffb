"""Pieces of pages: every visible character in one, with its element and true lines."""

import random
import re

from lakesearch.operators import segments


def pieces(spark, *pages):
    rows = [(k, f"site/{k}.html", page) for k, page in enumerate(pages)]
    table = spark.createDataFrame(rows, "repo_id long, file_path string, text string")
    found = segments.page_elements(table).orderBy("repo_id", "part").collect()
    out = {k: [] for k, _, _ in rows}
    for r in found:
        assert r.part == len(out[r.repo_id])
        out[r.repo_id].append((r.node_type, r.name, r.start_line, r.end_line, r.source_text))
    return [out[k] for k in range(len(rows))]


def test_pieces_have_their_element_and_lines(spark):
    page = (
        "<!DOCTYPE html>\n<html><head><title>The\ntitle</title>\n<script>\nvar a = '<p>no</p>';\n</script></head>\n"
        "<body><div>loose <b>text</b>\n<ul>\n<li>one<li>two <!-- <p>\nno --> more\n</ul>\ntail</div>\n"
        "<p>first\n\n<p>second <a href='x'>link</a></p>after</body></html>\n"
    )
    (found,) = pieces(spark, page)
    assert [(n, a, b, t) for _, n, a, b, t in found] == [
        ("title", 2, 3, "The\ntitle"),
        ("div", 7, 7, "loose <b>text</b>"),
        ("li", 9, 9, "one"),
        ("li", 9, 10, "two  more"),
        ("div", 12, 12, "tail"),
        ("p", 13, 13, "first"),
        ("p", 15, 15, "second <a href='x'>link</a>"),
        ("body", 15, 15, "after"),
    ]
    assert {kind for kind, *_ in found} == {"element"}


def test_odd_pages(spark):
    found = pieces(
        spark,
        "",
        None,
        "plain text\nof two lines",
        "</div></div><section>in</section>out",
        "<p>cut off in a <b",
        "<script>never ends <p>x</p>",
        "<nav><div/></nav>",
        "<P CLASS='x'>upper</P><pre>a\n b</pre><paragraph>not a p</paragraph>",
        "<p>" * 3000 + "x",
    )
    assert found[0] == [("file", "0.html", 1, 1, "")] and found[1][0][:2] == ("file", "1.html")
    assert found[2] == [("element", "page", 1, 2, "plain text\nof two lines")]
    assert [(n, t) for _, n, _, _, t in found[3]] == [("section", "in"), ("page", "out")]
    assert [(n, t) for _, n, _, _, t in found[4]] == [("p", "cut off in a <b")]
    assert [k for k, *_ in found[5]] == [k for k, *_ in found[6]] == ["file"]
    assert [(n, t) for _, n, _, _, t in found[7]] == [("p", "upper"), ("pre", "a\n b"), ("page", "<paragraph>not a p</paragraph>")]
    assert [(n, t) for _, n, _, _, t in found[8]] == [("p", "x")]


def test_no_visible_character_is_lost_or_repeated(spark):
    pick = random.Random(3)
    parts = ["<p>", "</p>", "<li>", "</ul>", "<ul>", "<div class='a>b'>", "</div>", "<b>", "</b>", "<br/>", "<!-- <li>x -->", "<script>if (a<b) {'<p>'}</script>", "<h2>", "</h2>", "\n", "word ", "ä", "<hr>", "</section>"]
    pages = ["".join(pick.choice(parts) for _ in range(60)) for _ in range(80)]
    for page, found in zip(pages, pieces(spark, *pages)):
        plain = re.sub(r"<!--.*?-->|<script.*?</script>", "", page)
        want = re.sub(r"\s", "", re.sub(r"<[^>]*>", "", plain))
        shown = [re.sub(r"\s", "", re.sub(r"<[^>]*>", "", t)) for kind, *_, t in found if kind == "element"]
        assert "".join(shown) == want
        lines = page.split("\n")
        for kind, _, first, last, text in found:
            if kind == "element" and text in page:
                assert text in "\n".join(lines[first - 1 : last])
