import pytest
from helpers import applied

from loomtext.operators.strip import StripOptions, strip_to_text

EQUAL = [
    ("<p>Seven <u>quiet</u> rivers.</p>", "Seven quiet rivers."),
    ("\tlow   tide  at\tnoon ", "low tide at noon"),
    ("Z&uuml;rich in M&auml;rz", "Zürich in März"),
    ("", ""),
    ("<li>3 &gt; 2 &amp;&amp; 1 &lt; 2</li>", "3 > 2 && 1 < 2"),
    ("<p>a <q>cited</q>, <s>struck</s> and <kbd>typed</kbd> word</p>", "a cited, struck and typed word"),
    ("<h2>Cut sh", "Cut sh"),
    ("<h2>Cut <em", "Cut"),
    ("stray <", "stray"),
    ("<dd>end</dd><", "end"),
    ("salt &amp;", "salt &"),
    ("salt &amp", "salt &"),
    ("<tr><td>north</td><td>south</td></tr>", "north south"),
    ("\n \r\t", ""),
    ("<section><b></b><i></i></section>", ""),
    ("x < y or y > z", "x z"),
    ("<h3 lang=o'clock>noon</h3>five'o>late", "late"),
    ("<!-->inner-->outer", "outer"),
    ("left<!-- middle -->right", "leftright"),
    ("<![CDATA[k > m]]>n", "m]]>n"),
    ("<script>while(k<top){k++}</script><p>gone too</p>", ""),
    ("<script>let t = '<aside>'</script>shown", ""),
    ("<svg ><p>drawn</p>", ""),
    ("<iframe /><p>framed</p>", ""),
    ("<svg/><p>kept</p>", "kept"),
    ("<menu>soup</footer>after", "after"),
    ("<head><base href=x><body>never seen", ""),
    ("<div class='my-references-list'>dropped</div>kept", "kept"),
    ('<table id="catlinks"><tr><td><ul><li>deep</li></ul>leaks</td></tr></table>tail', "leaks tail"),
    ("one<aside>two</aside>three", "one three"),
    ("one<form>two</form>three", "onethree"),
    ("<IMG SRC=m.png ALT=Map/>", "Map/"),
    ("<img/ alt='unseen'>", ""),
    ("AT&T&amp;co", "AT&T&amp;co"),
    ("tab\x0bulator", "tabulator"),
    ("next\x85line", "next line"),
    ("<li>dot</li>" * 2500, ("dot " * 2500).strip()),
    ("<aside>" + "<i>z</i>" * 600 + "</aside>rest", "rest"),
]
HAS = [
    ("<p>Kept</p><!-- <style>p{}</style> --><p>as well</p>", "as well", "p{}"),
    ('<span data-rule="m > n">Body text</span>', "Body text", "m > n"),
    ("<th>Year</th><th>Rain</th>", "Year", "YearRain"),
    ("<p>Donau<wbr>dampf<wbr>schiff</p>", "Donau", "Donaudampf"),
    ("<p><ruby>山<rt>やま</rt>川<rp>(</rp></ruby>の道</p>", "山川の道", "やま"),
    ('<aside><img alt="Badge" src="b.svg"></aside><p>Plain words.</p>', "Plain words.", "Badge"),
    ('<p>Map:</p><img src="m.gif" alt="Stra&szlig;e">', "Straße", "&"),
    ("<p>up&#127;down</p>", "updown", "\x7f"),
    ("<p>k&#2;l&#5;m</p>", "klm", "\x02"),
    ("<p>Noted in [7] and under [edit] there.</p>", "[7]", "<p>"),
    ('<div data-id="sidebar"><p>Nothing hides these words.</p></div>', "Nothing hides these words", "sidebar"),
    ('<ul id="mw-panel"><li>Tools</li></ul><p>Words below it.</p>', "Words below it.", "Tools"),
    ("<style>u<script>v</script>w</style>x", "x", "w"),
]
WIKI = [
    ("<p>A tall tower[citation needed] stands.</p>", "A tall tower stands."),
    ("accredit] one edit] two", "accredit] one edit] two"),
    ("one edit] two", "one two"),
    ("<p>The river[12] bends.</p>", "The river bends."),
]


def test_exact(spark):
    assert applied(spark, [a for a, _ in EQUAL], strip_to_text) == [b for _, b in EQUAL]


def test_contained_and_absent(spark):
    for got, (source, has, hasnt) in zip(applied(spark, [x[0] for x in HAS], strip_to_text), HAS):
        assert has in got and hasnt not in got, source


def test_wiki_option(spark):
    options = StripOptions.wikipedia()
    assert applied(spark, [a for a, _ in WIKI], lambda c: strip_to_text(c, options)) == [b for _, b in WIKI]
    assert applied(spark, ["y[3]"], strip_to_text) == ["y[3]"]


def test_null_stays_null(spark):
    assert applied(spark, [None], strip_to_text) == [None]


@pytest.mark.parametrize("wiki", [False, True])
def test_no_python_and_no_shuffle(spark, wiki, capsys):
    df = spark.createDataFrame([("a",)], "v string").select(strip_to_text("v", StripOptions(wiki)).alias("t"))
    df.explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Exchange" not in plan
