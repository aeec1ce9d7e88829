"""Pages whose text must not go: names made of a heading's words, comments and closing tags as browsers read them, short pages."""

import pytest

from pairloom.llm.html_text import main_text

PROSE = "The storm moved on slowly over the hills, and the rivers rose by two metres before the morning."
MORE = "People in the valley had been told to leave their homes a day before it came."


@pytest.mark.parametrize("name", ["tracking-the-storm", "social-impact", "share-of-votes", "print-culture", "comment", "related"])
@pytest.mark.parametrize("kind", ["id", "class"])
def test_headings_stay(name, kind):
    html = f'<article><h1>Storm</h1><p>{PROSE}</p><h2 {kind}="{name}">A heading</h2><p>{MORE}</p></article>'
    assert main_text(html) == f"Storm\n{PROSE}\nA heading\n{MORE}"


@pytest.mark.parametrize("name", ["related-work", "legal-aspects", "copyright-law", "cookie_recipes", "searchForMeaning", "news-about-advertising-law"])
@pytest.mark.parametrize("tag", ["section", "div", "p"])
def test_sections_stay(name, tag):
    inner = MORE if tag == "p" else f"<h2>Part</h2><p>{MORE}</p>"
    want = MORE if tag == "p" else f"Part\n{MORE}"
    assert main_text(f'<main><p>{PROSE}</p><{tag} id="{name}">{inner}</{tag}></main>') == f"{PROSE}\n{want}"


@pytest.mark.parametrize("name", ["ad", "ad-slot", "cookie-notice", "site-footer", "related-posts", "share-buttons", "newsletter-signup", "left-sidebar", "user-comments", "comments", "mainNav", "social_share_bar", "ads-300", "page-header widget", "breadcrumb-list", "top-banner", "promo-box", "article-comments", "comment-list", "cookie-consent-banner"])
def test_names_of_places_go(name):
    html = f'<body><div class="{name}"><p>{MORE}</p></div><div class="story"><h1>Storm</h1><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div></body>'
    assert main_text(html) == "\n".join(["Storm", PROSE, PROSE, PROSE])


@pytest.mark.parametrize("junk", ["<!-->", "<!--->", "<!---->", "<!-- x --!>", "<!-- a > b -- c -->", "<!--x--->", "<script>x</script x>", "<script>x</script\n/>", '<script>if (a</b) "</scripts>"</SCRIPT >', '<style>p{}</style type="a>b">', "<!doctype html>", "<?xml?>", "</>"])
def test_junk_ends_where_browsers_end_it(junk):
    assert main_text(f"{junk}<main><p>{PROSE}</p></main>") == PROSE
    assert main_text(f"<main><p>{PROSE}</p>{junk}<p>{MORE}</p></main>") == f"{PROSE}\n{MORE}"


def test_unclosed_junk_runs_to_the_end():
    for junk in ("<!-- x", "<script>x", "<script>x</script", "<style>"):
        assert main_text(f"<main><p>{PROSE}</p>{junk}<p>{MORE}</p>") == PROSE


def test_short_pages():
    assert main_text("<body><h1>Notes</h1><ul><li>Milk</li><li>Bread</li></ul></body>") == "Notes\nMilk\nBread"
    assert main_text("Hello world") == "Hello world"
    assert main_text("<nav>Home</nav><p>Hi</p><footer>Us</footer>") == "Hi"
    for empty in ("<nav><a href=x>Home</a></nav><footer>&copy; Us</footer>", "<ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul>"):
        assert main_text(empty) == ""
