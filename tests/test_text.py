import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.config import MAX_CHARS
from quillmark.functions import text as T

QUESTION = "why does the cache never expire?"


def test_lines_end_at_line_feeds_only():
    assert T.lines_of("a\r\nb\x0bc\n\nd") == ["a", "b\x0bc", "", "d"]
    assert T.lines_of("") == [] and T.lines_of("\n") == [""]
    assert T.lines_of("a\r") == ["a\r"]


def test_trim_is_unicode_white_space():
    assert T.trim("　\x85 a\x1f ") == "a\x1f"
    assert T.is_blank("   \n") and not T.is_blank("\x1c")


def test_long_table_and_wall():
    table = "# Big Table\n\n" + "".join(f"| endpoint-{i} | value |\n" for i in range(400))
    _, chunks = T.parse_note("T", table)
    assert len(chunks) > 1 and all(len(c.text) <= 2200 for c in chunks)
    assert len(T.parse_note("T", "# Wall\n\n" + "x" * 6000)[1]) >= 3


def test_headings_and_fences():
    _, chunks = T.parse_note("T", "# Top\n\nintro\n\n## Middle\n\nbody\n\n```\n# not a heading\n```\n")
    assert [c.heading_path for c in chunks] == ["Top", "Top > Middle"]
    assert [c.ix for c in chunks] == [0, 1] and chunks[0].text == "T > Top\n\nintro"
    assert [p for p, _ in T.note_sections("```\n# hidden\nstill open")] == [""]


def test_skipped_levels_nest_by_depth():
    assert [p for p, _ in T.note_sections("# A\na\n### B\nb\n### C\nc")] == ["A", "A > B", "A > B > C"]
    assert [p for p, _ in T.note_sections("## X\nx\n## Y\ny\n## Z\nz")] == ["X", "X > Y", "X > Z"]
    assert T.heading_of("#no") is None and T.heading_of("  ## Two ##") == (2, "Two ##") and T.heading_of("####### seven") is None


def test_wikilinks():
    assert T.wikilinks("See [[Payments API]], [[Rate Limiting|limits]] and [[Glossary#SLO]].") == ["Glossary", "Payments API", "Rate Limiting"]
    assert T.wikilinks("[[a\nb]] [[ ]] [[open") == ["a\nb"]


def test_frontmatter():
    source = "---\ntype: system\ncaptured: 2026-04-10\ntags: [infra, caching]\n---\n\ntext"
    front, chunks = T.parse_note("T", source)
    assert (front.note_type, front.captured, front.tags) == ("system", "2026-04-10", ["infra", "caching"])
    assert all("captured:" not in c.text for c in chunks)
    block = T.parse_frontmatter(["--- ", "tags:", "- a", '  - "b"', "other: x", "- c", "no colon", "type: 'q'", "---"])
    assert block[0].tags == ["a", "b"] and block[0].note_type == "q" and block[1] == 9
    assert T.parse_frontmatter(["---", "type: x"]) == (T.Frontmatter(), 0)
    assert T.parse_frontmatter(["", "---", "---"])[1] == 0
    assert T.parse_frontmatter(["---", "tags: x", "---"])[0].tags == []


def test_query_units():
    assert T.split_query("how should the cache expire?", 8) == ["how should the cache expire?"]
    pasted = T.split_query("stack frame line\n" * 400 + "\n" + QUESTION, 8)
    assert len(pasted) > 1 and QUESTION in pasted[-1]
    assert len(T.split_body("word " * 20000)) == 99
    assert [len(u) <= MAX_CHARS for u in T.split_query("word " * 20000, 8)] == [True] * 8
    assert T.split_query("   \n\n  ", 8) == []
    trace = "stack frame line\n" * 3000 + "\n" + QUESTION
    assert len(T.split_body(trace)) == 44
    for cap in (5, 8, 1):
        got = T.split_query(trace, cap)
        assert len(got) == cap and QUESTION in got[-1]
    assert len(T.split_query(trace, 0)) == 1


_PARTS = st.lists(
    st.tuples(st.sampled_from(["\n\n", "\n", "", " "]), st.one_of(st.text(string.ascii_lowercase + " ", max_size=120), st.integers(1200, 3000).map(lambda n: "q" * n))), max_size=31
)


@settings(max_examples=60, deadline=None)
@given(_PARTS, st.integers(1, 9))
def test_units_are_bounded(parts, cap):
    units = T.split_query("".join(a + b for a, b in parts), cap)
    assert len(units) <= cap and all(len(u) <= MAX_CHARS for u in units)


@pytest.mark.parametrize("n", [1, 1999, 2000, 2001, 6000])
def test_slices(n):
    assert "".join(T.slices("x" * n)) == "x" * n and len(T.slices("x" * n)) == -(-n // 2000)
    assert T.slices("") == []
