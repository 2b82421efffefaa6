import pytest

from arborlog.plans.query_text import Filter, Query, Select, UnexpectedChar, UnexpectedEnd, UnknownFilter, query, select

S = Select


@pytest.mark.parametrize(
    "text, tree",
    [
        ("{ shelf { title isbn } }", query(select("shelf", "title", "isbn"))),
        ("{a{b{c{d}}}}", query(select("a", select("b", select("c", "d"))))),
        ("{\n\ttitle,\r\n  pages,\f year }", query("title", "pages", "year")),
        ('{ "a title", "{(,:)}" }', query("a title", "{(,:)}")),
        ('{ _x9 "é\u00a0ü" }', query("_x9", "é\u00a0ü")),
        ("{ title as t, year as y }", query(S("title", "t"), S("year", "y"))),
        ('{ "main title" as t, year as "the year" }', query(S("main title", "t"), S("year", "the year"))),
        ("{ shelf(skip: 0) }", query(select("shelf", skip=0))),
        ("{ shelf(take: 18446744073709551615) }", query(select("shelf", take=(1 << 64) - 1))),
        ('{ shelf(after: "17/b") { isbn } }', query(select("shelf", "isbn", after="17/b"))),
        ('{ shelf(before: "z z") }', query(select("shelf", before="z z"))),
        ('{ shelf(before: "m", take: 3, after: "c", skip: 4) }', query(select("shelf", before="m", take=3, after="c", skip=4))),
        ("{ shelf as s(take: 1) { title as t, copies(skip: 2) { place } }, year }", query(select("shelf", S("title", "t"), select("copies", "place", skip=2), alias="s", take=1), "year")),
        ("{ title, year, }", query("title", "year")),
        ("{ }", query()),
        ("{ asked as as }", query(S("asked", "as"))),
        ("{ as assign }", query("as", "assign")),
        ("{ shelf(take: 1 take: 2) }", query(S("shelf", None, (Filter("take", 1), Filter("take", 2))))),
        ('{ "" as x }', query(S("", "x"))),
        ("{ shelf(after: mark) }", query(select("shelf", after="mark"))),
    ],
)
def test_accepted(text, tree):
    assert Query.parse(text) == tree


@pytest.mark.parametrize(
    "text, error, fields",
    [
        ("{ title % }", UnexpectedChar, ("%", 8)),
        ("{ shelf { title", UnexpectedEnd, None),
        ("{ shelf(first: 5) }", UnknownFilter, ("first", 8)),
        ("{ shelf(take 5) }", UnexpectedChar, ("5", 13)),
        ("title }", UnexpectedChar, ("t", 0)),
        ("{ title } { year }", UnexpectedChar, ("{", 10)),
        ("{ ,title }", UnexpectedChar, (",", 2)),
        ("{ title,,year }", UnexpectedChar, (",", 8)),
        ("{ shelf(take: -3) }", UnexpectedChar, ("-", 14)),
        ("{ shelf(skip: many) }", UnexpectedChar, ("m", 14)),
        ("{ 7up }", UnexpectedChar, ("7", 2)),
        ('{ "never closed', UnexpectedEnd, None),
        (" ", UnexpectedEnd, None),
        ("{ ü }", UnexpectedChar, ("ü", 2)),
        ('{ "ü" ; }', UnexpectedChar, (";", 7)),
        ("{ shelf(Take: 1) }", UnknownFilter, ("Take", 8)),
        ("{ shelf(take: 18446744073709551616) }", UnexpectedChar, ("1", 14)),
    ],
)
def test_rejected(text, error, fields):
    with pytest.raises(error) as e:
        Query.parse(text)
    if fields:
        assert (getattr(e.value, "char", None) or getattr(e.value, "name", None), e.value.position) == fields


def test_builder_takes_index_bytes():
    assert query(select("items", after=b"\x01\x01\x01\x02")).selects[0].filters == (Filter("after", b"\x01\x01\x01\x02"),)
