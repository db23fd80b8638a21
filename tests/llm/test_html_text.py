import time

import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm.html_text import extract, main_text

PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><div id="menu"><a>Home</a></div>
<div class="content"><h2>Title</h2><p>Long text, with words. And more text, of course; really.<p>Second para &amp; it's
 <i>nice</i><br>yes.<div class="sidebar">links</div><ul><li>one<li>two</ul><form>Name: <input></form>
<div class="comments"><p>I like it, a lot. A long comment, with many, many marks!</p></div></div><script>x<y</script><footer>c</footer></body>"""


def test_furniture_goes_and_blocks_stay():
    assert main_text(PAGE) == "Title\nLong text, with words. And more text, of course; really.\nSecond para & it's nice yes.\none\ntwo"


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<b>b</b>c", "abc"), ("<p>1 < 2 &lt; 3", "1 < 2 < 3"), ("<nav>x</nav>", ""), ("<!-- <p>no</p>", "")])
def test_small_pages(page, text):
    assert main_text(page) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<div>", "</div>", "<br>", "<li>", "<table>", "<td>", "a b", "&amp;", "<", "<!--", "-->", "<script>", "</script>", '<a href="', "<article>"]), max_size=20))
def test_broken_markup_never_fails(parts):
    assert "\n\n" not in main_text("".join(parts))


def test_rows_pass_through(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "<p>é" * 3000, None)], "page_id bigint, url string, html string, text string")
    rows = extract(pages).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows)
    assert extract(pages.limit(0)).count() == 0
    assert extract(spark.read.parquet(f"{SF}/pages.parquet")).where("n_chars = 0").count() == 0


def test_attribute_names_count_as_a_whole():
    page = '<article><p data-id="footer">One.</p><p class="x" title="class=menu">Two.</p><p id=nav>No.</p><p aria-hidden="true">No.</p><p style="display: none">No.</p><p hidden>No.</p><p data-hidden="1">Three.</p></article>'
    assert main_text(page) == "One.\nTwo.\nThree."


@pytest.mark.parametrize("tag", ["<div>x", "<b>x", "<li>x", "<ul><li>x", "<p>x", "<table><tr><td>x", '<div class="a b">x', "</div><span>x", "<div", "<!-", "&amp;<"])
def test_long_and_deep_pages_take_linear_time(tag):
    began = time.process_time()
    main_text(tag * 2_000)
    short = time.process_time() - began
    began = time.process_time()
    main_text(tag * 20_000)
    assert time.process_time() - began < 30 * short + 2
