"""Pages whose article stands in containers with telling names, or in several containers."""

import pytest

from pricelens.llm import html_text

A = "The first paragraph of the text, which is long enough to count, with commas, and which goes on for some more words until its end."
B = "The second paragraph is as long as the first one, has commas, too, and adds some further words on the matter before it ends here."
NAV = '<div class="site-nav"><a href=1>Home</a> <a href=2>News</a></div>'
FOOT = '<div class="site-footer"><p>Some words on the makers of the page, their rights, and their address, for all who ask.</p></div>'


@pytest.mark.parametrize(
    "wrapper", ["div class='content with-sidebar'", "div id='page' class='has-header'", "section class='legal-analysis'", "div class='search-result-page'"]
)
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<main>{}</main>"])
def test_telling_words_in_names_of_wrappers(wrapper, inner):
    text = f"<p>{A}</p><p class='share-price'>The share rose by two.</p><div class='sidebar'><p>{B}</p></div><p>{B}</p>"
    page = f"<body>{NAV}<{wrapper}>{inner.format(text)}</{wrapper.split()[0]}>{FOOT}</body>"
    assert html_text.main_text(page) == f"{A} The share rose by two. {B}"


def test_names_that_say_it_all_still_cut():
    long = f"<p>{B}</p>" * 9
    for name in ("comments", "comment-list", "cookie-notice", "site-footer", "sidebar right"):
        assert html_text.main_text(f"<body><div><p>{A}</p><p>{B}</p></div><div class='{name}'>{long}</div></body>") == f"{A} {B}"


def test_text_split_over_containers():
    c, end = "A section of one paragraph, with two commas, that is not short at all. " * 3, "A short end."
    one = f"<div><p>{A}</p><p>{B}</p></div>"
    two = f"<div><p>{c}</p></div>"
    want = " ".join(f"{A} {B} {c}".split())
    assert html_text.main_text(f"<body>{NAV}{one}{two}<p>{end}</p>{FOOT}</body>") == f"{want} {end}"
    assert html_text.main_text(f"<body>{NAV}<div><div>{one}</div><div>{two}</div></div>{FOOT}</body>") == want
    links = "<div><p><a href=1>More on this matter, and on others, for those who read on</a></p></div>"
    assert html_text.main_text(f"<body>{one}{two}{links}</body>") == want


STORY = f"<div>{f'<p>{A}</p><p>{B}</p>' * 3}</div>"
SAID = "<p>I read this twice, and still think that the author is wrong on the whole matter, as others said before me, at length.</p>" * 4


@pytest.mark.parametrize("name", ["user-comments", "article-comments", "post-comments", "reader-comments", "comment-thread", "disqus_thread",
                                  "cookie-policy", "newsletter-teaser", "related-articles", "sponsored-story", "comments", "commentsSection"])
def test_what_readers_and_advertisers_add_is_cut(name):
    want = " ".join([f"{A} {B}"] * 3)
    added = f"<div class='{name}'>{SAID}</div>"
    pages = [f"{STORY}{added}", f"<div>{STORY}{added}</div>", f"<article>{STORY}{added}</article>", f"<main>{STORY}{added}</main>",
             f"{STORY}<div class='{name}'>{f'<article>{SAID}</article>'}</div>", f"{STORY}<section id='{name}'>{SAID * 4}</section>"]
    for page in pages:
        assert html_text.main_text(f"<body>{NAV}{page}{FOOT}</body>") == want, page


def test_a_letter_that_lower_cases_to_two():
    page = "<body><p>" + "{0}" * 40 + " " + A + "</p><script>if (a < b) x();</SCRIPT ><p>" + B + "</p><style>p {{}}</style><p>" + A + "</p></body>"
    assert html_text.main_text(page.format("\u0130")).replace("\u0130", "I") == html_text.main_text(page.format("I")) == f"{'I' * 40} {A} {B} {A}"


def test_deep_pages_take_no_longer_than_wide_ones():
    import time

    deep = "<div>" * 100_000 + f"<p>{A}</p>" + "</section>" * 100_000 + "</div>" * 100_000
    wide = "<div></div>" * 100_000 + f"<p>{A}</p>" + "<b></b>" * 100_000
    times = []
    for page in (wide, deep):
        began = time.process_time()
        assert html_text.main_text(page) == A
        times.append(time.process_time() - began)
    assert times[1] < 4 * times[0] + 1
