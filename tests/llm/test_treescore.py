import random
import time

import pytest

from quillfin.llm.treescore import extract, main_text

PROSE = "A long sentence, with commas, that says something about the matter at hand and goes on for a while."


def test_article_without_its_surroundings():
    page = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var x="<p>no</p>";</script></head>
    <body class="has-sidebar"><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies, many, many of them, to see all you do on all of these pages.</div>
    <div id="main"><div class="post"><h1>Head &amp; line</h1><p>{PROSE}</p><p>Short<b>er</b>, too.<br>New
      line&nbsp;here <a href="x">link</a></p><ul><li>one<li>two</ul><!-- no --><div class="ad-slot">Buy, buy, buy!</div>
      <form>Name <input value="v"><p>form, text</p></form><pre>a   b</pre></div>
    <aside>{PROSE}</aside><div class="comments"><p>{PROSE} {PROSE}</p></div></div><footer>&copy; us</footer></body>"""
    assert main_text(page) == f"Head & line {PROSE} Shorter, too. New line here link one two a b"


def test_unclosed_elements_and_article_element():
    page = f"<body><nav><a href=x>Menu</a></nav><article><h1>H</h1><p><b>Bold, {PROSE}<br><p>Two.</p><p>Three</article><footer>f"
    assert main_text(page) == f"H Bold, {PROSE} Two. Three"
    assert main_text("<div><article class=comment><p>Reply, " + PROSE + "</p></article><article><p>Own.</p></article></div>") == "Own."


def test_links_lose_against_prose():
    links = "".join(f'<li><a href="/{i}">{PROSE}</a></li>' for i in range(30))
    page = f"<div><ul>{links}</ul></div><section><p>{PROSE}</p><p>{PROSE}</p><ul>{links}</ul></section>"
    assert main_text(page) == f"{PROSE} {PROSE}"


def test_tables_loose_text_and_siblings():
    assert main_text("just text, no &lt;markup&gt; &#x41;&eacute;&unknown;") == "just text, no <markup> Aé&unknown;"
    assert main_text(f"<table><tr><td>{PROSE}<td>cell<tr><td>last</table>") == f"{PROSE} cell last"
    page = f"<div><h2>Title</h2><div><p>{PROSE}</p><p>{PROSE}</p></div><p>{PROSE}</p><p><a href=x>more, more, more</a></p></div>"
    assert main_text(page) == f"Title {PROSE} {PROSE} {PROSE}"


@pytest.mark.parametrize("page", [None, "", " \n", "<", "<p", "<!--", "<script>", "</p></div>", "<nav>x</nav>", "<p>&nbsp;</p>", "<div hidden>x</div>"])
def test_pages_without_text(page):
    assert main_text(page) in ("", "<")


def test_any_markup_and_deep_nesting():
    r = random.Random(1)
    bits = ["<p>", "</p>", "<div class='x'>", "</div>", "<table>", "<td>", "</table>", "<b>", "text, more ", "<a href=\"q>\">", "</a>", "<br/>", "&amp;", "<li>", "<ul>", "</ul>", "<h1", ">", "<!-- c -->", "\n", "<article>", "</article>"]
    for _ in range(500):
        page = "".join(r.choices(bits, k=r.randrange(40)))
        text = main_text(page)
        assert text == " ".join(text.split())
    assert main_text("<div>" * 20_000 + PROSE) == PROSE


def test_extraction_keeps_rows_and_columns(spark):
    page = f"<article><p>{PROSE}</p></article>"
    rows = [(1, "u", page, "clash"), (1, "u", page, "clash"), (None, None, None, None), (2, "v", "<p>" + "漢字、" * 50_000, "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((g["page_id"] or 0, g["url"], g["n_chars"], g["text"][:10]) for g in extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", len(PROSE), PROSE[:10])] * 2 + [(0, None, 0, ""), (2, "v", 150_000, ("漢字、" * 4)[:10])], key=str)
    assert extract(pages.limit(0)).columns == ["page_id", "url", "html", "text", "n_chars"]


def test_quotes_inside_values_without_quotes_are_no_text():
    page = f"<article><p class=it's>Hello, there.</p><p data-x=o'neil title=\"a > b\">{PROSE}</p><p x='>' y=a\"b>End<br/>line</p><p a = 'it' b='>last</p></article>"
    assert main_text(page) == f"Hello, there. {PROSE} End line last"


@pytest.mark.parametrize(
    "part", ["<div>", "<b></i>", "<p x='", '<a b="c', "<table><tr><td>", "<li>", "</p>", "<!--", "<", "<a =", "<textarea>x</textare", "<ul><li>a</b>"]
)
def test_time_grows_with_the_length_of_the_page(part):
    def cost(n):
        began = time.process_time()
        main_text(part * n)
        return time.process_time() - began

    small = min(cost(20_000) for _ in range(2))
    # Ten times the page; a hundred times the time would be quadratic.
    assert cost(200_000) < 35 * small + 2
