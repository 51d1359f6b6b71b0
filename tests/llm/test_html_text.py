import html as h
import re
from html.parser import HTMLParser

import numpy as np
import pytest

from loamworks.llm import html_text
from loamworks.session import read_table

from ..conftest import SF


def template(page):
    """The article of a generated page, by its known template."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)
    if not body:
        return None
    parts = [" ".join(h.unescape(re.sub(r"<(?:/?b|br)>|<[^>]*\Z", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", body[1])]
    return "\n".join(p for p in parts if p)


def test_sample_pages(spark):
    pages = read_table(spark, SF, "pages")
    got = {r.page_id: r for r in html_text.digest(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        want = template(r.html)
        if want is not None:
            assert got[r.page_id].text == want
            assert got[r.page_id].n_chars == len(want)


BOILER = "<header class=top>Site <a href=/>home</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>"
CASES = [
    ("", ""),
    (None, ""),
    ("plain text only, no tags at all.", "plain text only, no tags at all."),
    (f"<html><body>{BOILER}<div id='content'><h2>Title &amp; more</h2><p>First   paragraph,\n with words. It goes on.</p><div class='ad box'>Buy now!</div><p>Second &lt;one&gt;, too.<br>Line.</div><div class=comments><p>I think, a long reader comment, so long.</p></div><footer>&copy; all</footer>", "Title & more\nFirst paragraph, with words. It goes on.\nSecond <one>, too. Line."),
    ("<main><p>A<p>B, c.<ul><li>x<li>y</ul><script>var t = '</p>';</script><style>p{}</style><!-- no --><form><p>Name</p></form></main><aside>side</aside>", "A\nB, c.\nx\ny"),
    ("<article><p>Cut off &am", "Cut off &am"),
    ("<article><p>Cut off<b", "Cut off"),
    ("<table><tr><td>one, two, three, four and five.<td>six, seven</table>", "one, two, three, four and five.\nsix, seven"),
    ("<article>" + "<div>" * 400 + "deep, deep text." + "</div>" * 400 + "</article>", "deep, deep text."),
]


def test_cases(spark):
    for page, want in CASES:
        assert html_text.main_text(page or "") == want, page and page[:80]
    pages = spark.createDataFrame([(i, None, c[0], "x") for i, c in enumerate(CASES)] + [(0, "u", "<p>a</p>", "x")] * 2, "page_id long, url string, html string, text string")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(CASES) + 2
    assert html_text.digest(pages.limit(0)).count() == 0


def test_long_page_is_whole():
    page = "<body><article>" + "".join(f"<p>word {i}, and more of it.</p>" for i in range(20000)) + "</article>"
    assert html_text.main_text(page).count("\n") == 19999


BODY = "<p>The first paragraph of the story, which goes on for a while.</p><p>The second one, with more words, and a full stop.</p>"
PROSE = "The first paragraph of the story, which goes on for a while.\nThe second one, with more words, and a full stop."


@pytest.mark.parametrize("attributes", ['class="overflow-hidden"', 'title="the hidden truth"', 'data-role="search"', 'class="social-history"', 'hidden="until-found"'])
def test_names_that_only_look_like_marks(attributes):
    assert html_text.main_text(f"<body><div {attributes}>{BODY}</div></body>") == PROSE


@pytest.mark.parametrize("attributes", ["hidden", 'style="display: none"', "aria-hidden=true", 'class="ad-box"', 'id="comments"', "role=navigation", 'class="x share-buttons"'])
def test_marked_and_hidden_elements_go(attributes):
    assert html_text.main_text(f"<body><div>{BODY}<div {attributes}><p>Something else, not of the story at all.</p></div></div></body>") == PROSE


def test_ratios_drop_what_is_unmarked():
    links = "<ul><li><a href=1>Home</a></li><li><a href=2>Sports</a></li><li><a href=3>Weather</a></li></ul>"
    assert html_text.main_text(f"<body><div>{links}{BODY}<div>Buy now</div></div></body>") == PROSE
    assert html_text.main_text(f"<body><article>{links}{BODY}<span>Buy now</span></article></body>").startswith(PROSE)
    assert html_text.main_text(f"<div><h2>Head</h2>{BODY}<h3>Inner</h3>{BODY}</div>") == f"Head\n{PROSE}\nInner\n{PROSE}"
    assert html_text.main_text(f'<div class="modal">{BODY}</div>') == PROSE  # nothing else is there


def test_ratios_equal_brute_force(spark):
    class Reader(HTMLParser):
        """Paths and texts of well-formed pages of div, p, li and a."""

        def __init__(self):
            super().__init__()
            self.stack, self.rows = [], []

        def handle_starttag(self, tag, attrs):
            self.stack.append(tag + (f".{dict(attrs)['class']}" if dict(attrs).get("class") else ""))

        def handle_endtag(self, tag):
            self.stack.pop()

        def handle_data(self, data):
            linked = len(data) if "a" in self.stack else 0
            self.rows.append(("/".join(x for x in self.stack if x != "a"), data, linked))

    page = '<html><body><div class="m"><p><a>One</a></p><p><a>Two</a></p></div><div><p>Long text, with words.</p><p>More, still more. And more!</p><div class="q"><p>Short</p></div></div><div><ul><li>x y</li><li>z</li></ul></div></body></html>'
    reader = Reader()
    reader.feed(page)
    sums = {}
    for path, text, linked in reader.rows:
        e = sums.setdefault(path, [0, 0, 0, 0])
        for i, v in enumerate((len(text), sum(c in ".,;:!?" for c in text), 1, linked)):
            e[i] += v
    rows = list(sums.values())
    means = [[e[0] / e[2], e[1] / e[2]] for e in rows]
    want = {}
    for i, path in enumerate(sums):
        near = [means[max(i - 1, 0)], means[i], means[min(i + 1, len(means) - 1)]]
        length, marks = (0.5 * near[1][j] + 0.5 * (near[0][j] / 4 + near[1][j] / 2 + near[2][j] / 4) for j in (0, 1))
        want[path] = (length * (1 + marks) * (1 - rows[i][3] / rows[i][0]), rows[i][3] / rows[i][0])
    tree, found = html_text.blocks(page)
    ratios = html_text.path_ratios(tree, found)
    got = {tree.path_name(p): v for p, v in ratios.items()}
    assert got.keys() == want.keys() and all(np.allclose(got[p], want[p]) for p in want)
    level = min(html_text.LEVEL * np.std([v[0] for v in want.values()]), max(v[0] for v in want.values()))
    assert {tree.path_name(p) for p in html_text.content_paths(ratios)} == {p for p, v in want.items() if v[0] >= level}


def test_deep_pages_stay_small():
    import tracemalloc

    page = "<div>" * 8000 + "<p>Deep text, at last.</p>" + "<b>" * 8000 + "more"
    tracemalloc.start()
    assert html_text.main_text(page).startswith("Deep text, at last.")
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_lists_that_end_an_article_stay_and_replies_go():
    prose = "".join(f"<p>This is a long sentence number {i}, with commas, and words, about cooking soup.</p>" for i in range(6))
    page = f"<body><div class='text'>{prose}<ul><li>salt<li>pepper</ul></div><div class='user-reply'><p>I disagree, with all of it, and I say so at length here.</p></div></body>"
    lines = html_text.main_text(page).split("\n")
    assert lines[-2:] == ["salt", "pepper"] and len(lines) == 8
    links = "<ul><li><a href='/a'>One more</a><li><a href='/b'>Another</a></ul>"
    assert "Another" not in html_text.main_text(f"<body><div>{prose}{links}</div></body>")


def test_long_class_names_are_different_paths():
    tree, _ = html_text.blocks(f"<div class='{'x' * 60}a'><p>One.</p></div><div class='{'x' * 60}b'><p>Two.</p></div>")
    assert len({tree.path[n] for n in range(len(tree.tag)) if tree.tag[n] == "div"}) == 2
