"""Character references that no semicolon ends, as titles that were cut have them."""

import duckdb
import pytest

from quirekit.plans import catalog
from quirekit.sources import dom

HEADS = ["a &amp;&amp; b &amp", "x &lt;y&gt; &quot;q&quot &l", "&ampfoo; & &amp;amp", "plain", "&lt"]


@pytest.mark.parametrize("name", ["html_headings", "html_metadata"])
def test_open_references_stay_as_in_the_sql(spark, tmp_path, name):
    rows = [(i, f"http://a.example/{i}", f'<html lang="en"><head><title>{x}</title><script>a&&b&amp</script></head><body><h1>{x}</h1><p>z</p></body></html>') for i, x in enumerate(HEADS)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, catalog.queries()[name](spark, str(tmp_path)).select(*columns).collect())) == sorted(want.fetchall())


def test_closed_parsing_leaves_scripts_attributes_and_comments():
    markup = '<p title="a&copy=1&amp;b">&copy &copy; &#65; &#65 &nope;</p><script>x&&y&amp z</script><!--a&amp-->﷐'
    root = dom.parse(markup, closed=True)
    p, script = root.find("p"), root.find("script")
    assert p.attrs == {"title": "a&copy=1&b"} and p.text() == "&copy © A &#65 &nope;" and script.children == ["x&&y&amp z"]
    assert [c for c in root.children if isinstance(c, str)] == ["a&amp", "﷐"]
    assert dom.parse(markup).find("p").text() == "© © A A &nope;"
