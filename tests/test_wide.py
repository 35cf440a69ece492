"""Stripping over ranges, and the element table, against the projection and plain Python."""

import random

import pytest

from loomtext.operators import elements
from loomtext.operators.strip import StripOptions, strip_to_text
from loomtext.operators.wide import strip_wide
from loomtext.plans import cases

PARTS = (
    "<p>", "</p>", "<div class=toc>", "</div>", "<nav>", "</nav>", "<span id='sidebar'>", "</span>", "</footer>", "x ", " y", "[citation ", "needed]", "<script>", "</script>", "<style>",
    "</style>", "<img alt=' k '>", "&amp;", "<br>", "[1]", "<b>", "</b>", "<i>", "</i>", "<hr/>", "<!-- <p> -->", "<x-y/>", "</>",
)


def made_pages(spark, n=120, seed=3):
    rng = random.Random(seed)
    fixed = cases.STRIP + cases.WIKI_SKIP + cases.IMAGES + cases.MARKERS
    rows = list(enumerate(fixed + tuple("".join(rng.choices(PARTS, k=rng.randint(1, 120))) for _ in range(n))))
    rows += [(-1, None), (-1, ""), (None, "<p>x"), (-2, "<div class=toc>a<p>[citation <p></p>needed] [citation<p> needed]</nav></div>b[1]</div><nav>c</div>d")]
    return spark.createDataFrame(rows, "page_id long, html string")


@pytest.mark.parametrize("options", [None, StripOptions.wikipedia()])
@pytest.mark.parametrize("size", [1, 7])
def test_ranges_give_the_same_text(spark, options, size):
    pages = made_pages(spark)
    want = sorted(map(repr, pages.select("page_id", strip_to_text("html", options).alias("text")).collect()))
    assert sorted(map(repr, strip_wide(pages, options=options, wide_bytes=0, size=size).collect())) == want
    assert strip_wide(pages.limit(0)).count() == 0


def test_one_huge_page_is_many_tasks(spark):
    page = "<p>word <b>and</b> &amp; more</p><div class=toc>x</div>" * 20_000
    df = spark.createDataFrame([(1, page)], "page_id long, html string").repartition(1)
    wide = strip_wide(df)
    assert [r.text for r in wide.collect()] == [r.t for r in df.select(strip_to_text("html").alias("t")).collect()]
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "REPARTITION_BY_NUM" in plan and "Python" not in plan


def plain_elements(spark, pages):
    """Name stacks over the tokens, one page after the other."""
    from loomtext.functions.tokens import markup_tokens, tag_name

    rows = pages.select("page_id", "html", markup_tokens("html").alias("ts")).where("ts is not null").collect()
    named = pages.sparkSession.createDataFrame([(t,) for t in {t for r in rows for t in r.ts}], "t string")
    names = {r.t: r.n for r in named.select("t", tag_name(named.t).alias("n")).collect()}
    out = []
    for r in rows:
        stacks, found = {}, []
        for at, token in enumerate(r.ts, 1):
            name = names[token]
            bare = name.removeprefix("/").removesuffix("/")
            if not bare or token.startswith("<!") or not token.startswith("<"):
                continue
            if name.startswith("/"):
                if stacks.get(bare):
                    found[stacks[bare].pop()][2:4] = [at, True]
            else:
                found.append([bare, at, len(r.ts), False])
                if bare in elements.VOID_TAGS or token.endswith("/>"):
                    found[-1][2:4] = [at, True]
                else:
                    stacks.setdefault(bare, []).append(len(found) - 1)
        for name, start, end, closed in found:
            over = [s for _, s, e, _ in found if s < start < e]
            out.append((r.page_id, name, start, end, closed, len(over), max(over, default=None)))
    return sorted(map(repr, out))


def test_elements(spark):
    pages = made_pages(spark).where("page_id is not null").dropDuplicates(["page_id"])
    assert sorted(repr(tuple(r)) for r in elements.element_table(pages).collect()) == plain_elements(spark, pages)
    assert elements.element_table(pages.limit(0)).count() == 0


def test_skip_regions_hide_what_stripping_hides(spark):
    """Outside of the regions every text is visible; without pages of scripts and images nothing else decides."""
    rng = random.Random(9)
    parts = [p for p in PARTS if "script" not in p and "style" not in p and "img" not in p and not p.startswith("[") and p not in ("&amp;", "needed]")]
    pages = [(i, "".join(rng.choices(parts, k=80))) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, html string")
    from loomtext.functions.tokens import markup_tokens

    regions = {}
    for r in elements.skip_regions(df).collect():
        regions.setdefault(r.page_id, []).append((r.start, r.end))
    for r in df.select("page_id", markup_tokens("html").alias("ts"), strip_to_text("html").alias("text")).collect():
        shown = [t for i, t in enumerate(r.ts, 1) if not t.startswith("<") and not any(s <= i and (e is None or i < e) for s, e in regions.get(r.page_id, []))]
        assert "".join(shown).replace(" ", "") == r.text.replace(" ", "")
