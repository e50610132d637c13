"""Table functions: malformed and very long documents, shapes that are passed over."""

from __future__ import annotations

import json

import pytest

from marketloom.functions.tables import plain, read_facts, register_tables


def doc(rows, tag="T", **more):
    return {"cik": 1, "facts": {"us-gaap": {tag: {"label": "x", "units": {"USD": rows}}, "Other": {"units": {"USD": [{"a": [1, {"b": 2}]}]}}}} | more}


ROW = {"end": "2020-12-31", "filed": "2021-02-14", "val": 1.5, "form": "10-K", "accn": "a"}


@pytest.mark.parametrize("bad", ['{"facts": {', '{"facts": {"us-gaap": {"T": {"units": {"USD": [{"end": }]}}}}}', "[1, 2", '{"a": 1} x', "", "nul", '{"facts": {"g": {"T": {"units": {"USD": [{"val": NaN}]}}}}}', '{1: 2}', '{"a" 1}', "{,}"])
def test_malformed_documents_have_no_rows(spark, bad):
    register_tables(spark)
    df = spark.createDataFrame([(1, bad), (2, json.dumps(doc([ROW]))), (3, None)], "id long, body string")
    assert [r.id for r in spark.sql("SELECT d.id, f.* FROM {d} d, LATERAL facts(d.body) f", d=df).collect()] == [2]


def test_shapes_that_are_passed_over():
    rows = [ROW, {**ROW, "val": None}, {**ROW, "val": True}, {**ROW, "end": "no date"}, {"filed": "2021-02-14", "val": 2}, 7, [ROW]]
    assert len(list(read_facts(json.dumps(doc(rows))))) == 1
    for text in ('{"facts": []}', '{"facts": {"a": [], "b": {"T": 1, "U": {"units": []}, "V": {"units": {"USD": {}}}}}}', "[1]", "3", '{"x": {"facts": {}}}'):
        assert list(read_facts(text)) == []
    assert list(read_facts(json.dumps(doc([ROW])), {"U"})) == []


def test_a_very_long_document(spark):
    register_tables(spark)
    body = json.dumps(doc([{**ROW, "val": k} for k in range(100_000)]))
    df = spark.createDataFrame([(body,)], "body string")
    out = spark.sql("SELECT count(*) AS n, sum(f.value) AS s FROM {d} d, LATERAL facts(d.body, array('T')) f", d=df).first()
    assert (out.n, out.s) == (100_000, sum(range(100_000)))


def test_wrong_arguments_are_told_when_the_plan_is_built(spark):
    register_tables(spark)
    with pytest.raises(Exception, match="takes a string"):
        spark.sql("SELECT * FROM facts(1)")


def test_scripts_that_do_not_close():
    assert plain("<script>" * 20_000 + "a <b>b</b>&amp;") == "a b &" or plain("<script>a</script>b") == "b"
    assert plain("x<style>p{}</style>y <script src=1>z") == "x y z"


def test_sections_decode_every_reference_as_their_sql_does(spark):
    """Names without a semicolon, names that begin with one, numbers that stand for others."""
    import duckdb

    from marketloom.operators.universe import filing_sections
    from marketloom.plans.universe import SECTIONS

    texts = [
        "a&amp</b>c &ampx; &ampamp; &eacute;&eacute &notit; &notin; &nosuch; &n; & &; &&amp;amp;", "&#65;&#65 &#x41;&#X41x &#0;&#128;&#13;&#x80 &#xD800; &#1114112; &#99999999999; &#x1F600; &#1; &#xFFFE; &#xFDD0; &#; &#x;",
        "x\x0by &lt;b&gt; &#39;&apos;&CounterClockwiseContourIntegral; &" + "q" * 40 + "; &quot&quot &NotEqualTilde; &Tab;&NewLine;", "", None,
    ]
    pages = [(4 * k, t) for k, t in enumerate(texts)] + [(101 + 4 * k, t) for k, t in enumerate(texts)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    want = {(p, s): (n, h) for p, s, n, h in con.sql(SECTIONS).fetchall()}
    head = "<p>Item 1. Item 7: Item 1A - short</p><style>item 8. no</style><h2>ITEM&nbsp;7a. risk &amp; rates</h2> Item&#32;1:"
    whole = [(p, t if p % 4 == 0 else head + (t or "") + "<b>Item 2.</b> end") for p, t in pages]
    got = filing_sections(spark.createDataFrame(whole, "page_id long, html string")).collect()
    assert {(r.page_id, r.section): (len(r.body), r.sha256) for r in got} == want
