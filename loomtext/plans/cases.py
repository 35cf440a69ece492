"""Inline inputs for what the tables do not contain; queries and their SQL read the same rows."""

from __future__ import annotations

STRIP = (
    "<p>Seven <u>quiet</u> rivers.</p>", "\tlow   tide  at\tnoon ", "Z&uuml;rich in M&auml;rz", "", "<li>3 &gt; 2 &amp;&amp; 1 &lt; 2</li>",
    "<p>a <q>cited</q>, <s>struck</s> and <kbd>typed</kbd> word</p>", "<h2>Cut <em", "stray <", "<dd>end</dd><", "salt &amp;", "salt &amp",
    "<tr><td>north</td><td>south</td></tr>", "\n \r\t", "<section><b></b><i></i></section>", "<h4>Early</h4><script>run(1",
    "<p>Kept</p><!-- <style>p{}</style> --><p>as well</p>", '<span data-rule="m > n">Body text</span>',
    "<th>Year</th><th>Rain</th>", "<p>Donau<wbr>dampf<wbr>schiff</p>", "<p><ruby>山<rt>やま</rt>川<rp>(</rp></ruby>の道</p>",
    "<p>up&#127;down</p>", "<p>k&#2;l&#5;m</p>", "x < y or y > z", "<h3 lang=o'clock>noon</h3>five'o>late", "<!-->inner-->outer",
    "left<!-- middle -->right", "<![CDATA[k > m]]>n", "<script>while(k<top){k++}</script><p>gone too</p>", "<script>let t = '<aside>'</script>shown",
    "<script/>k</li>m", "<iframe /><p>framed</p>", "<svg/><p>kept</p>", "<menu>soup</footer>after", "</aside></ul>k", "<head><base href=x><body>never seen",
    "<style>u<script>v</script>w</style>x", "one<nav>two</nav>three", "one<aside>two</aside>three", "k<br/>l<hr />m", "AT&T&amp;co",
    "tab\u000bulator", "next\u0085line", "&lt;k<p></p>&gt;", "<H1 ID=k>LOUD</H1><LI>item</LI>", "<?php echo 1 ?>shown",
    "<an-element-whose-name-is-longer-than-any-that-pages-have>k</an-element-whose-name-is-longer-than-any-that-pages-have>", "< k></>m",
)
WIKI_SKIP = (
    "<div class='my-references-list'>dropped</div>kept", '<table id="catlinks"><tr><td><ul><li>deep</li></ul>leaks</td></tr></table>tail',
    '<div data-id="sidebar"><p>Nothing hides these words.</p></div>', '<ul id="mw-panel"><li>Tools</li></ul><p>Words below it.</p>',
    "<span class='NavBox right'>k</span>m", "<table class=reflist><tr><td>k</td></tr></table>m", '<p class="sidebar">kept</p>',
    '<div class="plain" id="mw-head-base">k</div>m', '<section class="further-reading">k<aside>l</section>m</aside>n', '<ol id="printfooter"><li>k</li></ol>m',
)
MARKERS = (
    "accredit] one edit] two", "one edit] two", "y[4] z[citation needed] [edit]w", "[34", "[34] [k]", "no marks", "kedit][6]edit]", "[edit]edit]m",
    "ü edit] w", "[[9]]", "2edit] edit] [5] edit] v",
)
ENTITIES = (
    "&Uuml;bung", "&#174; mark", "plain words only", "&lt;td&gt; &quot;x&quot; &amp; y", "&reg; &#8211; &#x2026;",
    "&Sacute;wi&eogonek;to &lstrok;&aogonek;ka", "&Gbreve;&scedil;&inodot;", "&Rcaron;eka &amp; &zcaron;ivot",
    "&amp;lt;", "&#00;", "&#141;", "&#xDFFF;", "&#x110001;", "&#145;", "&#146;", "&#130;", "&#140;", "&#88888888888;", "&#12q;",
    "&nosuch;", "&#174", "&mdash more", "&#777777777;", "&#;", "&#X;", "&QUOT;", "&reg2020", "&gt&lt", "&#+66;", "&#x+42;",
    "&nbsp;", "&#160;", "AT&T&amp;co", "&#4294967295;", "&#4294967296;", "&#x0000000042;", "&#x1F33F;", "&lang;&rang;", "&",
    "&;", "k&", "&#-7;", "& lt;", "&#x100000042;",
)
IMAGES = (
    '<p>Map:</p><img src="m.gif" alt="Stra&szlig;e">', "<IMG SRC=m.png ALT=Map/>", "<img/ alt='unseen'>", '<img alt="">',
    '<img title="k alt=wrong" alt="right">', '<aside><img alt="Badge" src="b.svg"></aside><p>Plain words.</p>', "<img alt = 'k'>m",
    "k<img alt='mid'>m", "<img src=k alt=\"never closed>m", "<img alt=   'far'>m",
)
DETECT = (
    "<!doctype html><title>k</title>", "<h1>Rain</h1>", '<?xml version="1.1"?><feed/>', "\t\n <!-- note --> x", "Rain until noon.", "",
    "* item\n* item", "while k < 7 and m > 2", "Replace <host> by the server's own name", "<4 days left", "[1, 2, 3]",
    "<hr>", "see <heading><bodywork>", "\ufeff<html lang=fr>", "<dl>" + "y" * 1200 + "</dl>", "<dl>" + "ü" * 507 + "</dl>", " \r\n<html",
    "k < m </i>", "<HTML lang=de>", "<Html lang=de>", "<style>k</style>",
)
BYTES = ("255044462d322e30206f6e65", "feff006b", "", "3c68746d6c3e3c7469746c653e6b3c2f7469746c653e3c2f68746d6c3e", "7261696e20616e642077696e64", "255044", "c3bc", "c3", "2525504446")
PATHS = (
    "index.html", "index.htm", "index.xhtml", "INDEX.HTML", "old.copy.html", "minutes.pdf", "MINUTES.PDF", "minutes.may.pdf", "CHANGES.md",
    "todo.markdown", "k.mkd", "rain.txt", "k.text", "map.jpeg", "Makefile", ".profile", "k/m.d/n", "k/m.html/", "k/.html", "k.", "..html",
    "folder/.", "k.tar.MD", "", "two words.Pdf", "k.html/.",
)
FORMATS = ("plain_text", "html", "pdf", "markdown", "unknown", "other")
READABLE = ("<h1>brief</h1>", "", "<html><body><dl>little</dl></body></html>", "no markup")


def _article(paragraphs: int, wiki: bool) -> str:
    body = "".join(
        f"<p>Paragraph {i} speaks of <b>matter {i}</b>, of <i>caf&eacute;s</i> &amp; of "
        f"<a href='/{i}'>places</a>{f'<sup>[{i}]</sup>' if wiki else ''} that were seen &mdash; some twice.</p>"
        for i in range(1, paragraphs + 1)
    )
    extras = (
        "<table class='infobox'><tr><th>Born</th><td>1879</td></tr></table><p><ruby>漢<rt>かん</rt></ruby></p><div class='navbox'>boxes</div>" if wiki else ""
    )
    return (
        "<!DOCTYPE html><html><head><title>T</title><script>var a='<p>';</script></head><body><nav><a href='/'>Home</a></nav>"
        f"<div id='toc'>Contents</div><h1>Title</h1>{body}{extras}<ol class='references'><li>Source</li></ol><footer>&copy; Footer</footer></body></html>"
    )


#: Inputs of the kinds that throughput is measured on: a fragment, an article, a long wiki page, references, plain text.
CORPORA = (
    "<p>Hello <b>world</b>! This is a <a href='#'>small</a> piece.</p>",
    _article(10, False),
    _article(50, True),
    "<p>" + "Caf&eacute; &amp; cr&egrave;me &#8212; &#x201C;quoted&#x201D; &lt;tag&gt; &copy; &nbsp;" * 200 + "</p>",
    "Plain text without any markup, of a few sentences. It has nothing to strip. " * 3,
)
#: Pages of one to sixty paragraphs with a menu and a footer, and pages that are too short for an article.
ARTICLES = (*(_article(n, wiki) for n in (1, 2, 5, 20, 60) for wiki in (False, True)), "<title>K</title><p>little</p>", "<div>k</div>")
#: Texts and their pages, for the checks.
CHECKED = (
    ("fine words", "<p>fine words</p>"), ("it's two  blanks\there", "<p>"), (" edges ", "<p>"), ("k <td colspan=2> m", "<td>"), ("k", "<body>" + "m" * 200),
    ("k\u0001\u0002\u0003\u0004\u0005\u0006m", "<p>"), ("k\u200bm\ufeff", "<p>"), ("a === b; window.k; document.k", "<script>"),
)
#: Pages and their layout at 30 characters a line, spelled out.
LAID_OUT = (
    ("<h1>Rain</h1><p>It <b>fell</b> all <a href='/d'>day</a>.</p>", "# Rain\n\nIt **fell** all [day][1].\n\n[1]: /d\n"),
    ("<ul><li>one</li><li>two <i>three</i></li></ul><ol><li>first</li><li>second</li></ol>", "* one\n* two *three*\n\n1. first\n2. second\n"),
    ("<blockquote><p>said in the house by the river at noon</p></blockquote><pre>a  b\n c</pre>", "> said in the house by the\n> river at noon\n>\n\na  b\n c\n"),
    ("<table><tr><th>k</th><th>value</th></tr><tr><td>north</td><td>7</td></tr></table>", "k     | value\nnorth | 7\n"),
    ("<p>" + "word " * 12 + "</p><hr><p>end</p>", "word word word word word word\nword word word word word word\n\n" + "-" * 30 + "\n\nend\n"),
    ("<nav>menu</nav><script>x()</script><p>x<br>y</p><img alt='Map' src=m>", "menu\n\nx\ny\n\n[Map]\n"),
    ("<dl><dt>term</dt><dd>meaning of it</dd></dl>", "term\n  meaning of it\n"), ("", ""), ("<p> </p>", ""),
)
