"""Pages whose main text is known, and pages that are made to take long."""

import random
import time

import pytest

from plumbline.llm import html


def text(page):
    found = html.parse(page)
    return html.kept_text([t for t, _ in found], [f for _, f in found], [])


@pytest.mark.parametrize("page, want", [
    # an inline element that goes leaves its block whole
    ("<p>x <button>Share</button> y</p>", "x y"), ("<article><p>x<button>b</button>y <b>z</b></p></article>", "xy z"), ("<article><p>a <span hidden>h</span>b <span aria-hidden=true>c</span> d</p></article>", "a b d"),
    # names inside an article leave out boxes, not text
    ('<article><p class="comment-policy">a</p><div class="code-notice">b</div><section class="footer-notes">c</section><h2 id="comments-on-method">d</h2><p>e <a class="related">this</a> <span class="ad-hoc">f</span></p></article>', "a\nb\nc\nd\ne this f"),
    ('<article><p>a</p><div class="comments">b</div><div class="ad-box">c</div><ul class="share"><li>d</ul><section id="related-posts-list">e</section><div class="newsletter signup-form">f</div>g</article>', "a\ng"),
    # comments that are articles themselves
    ('<article><p>a</p></article><article class="comment"><p>b</p></article><article id="comment-list"><p>c</p></article><article class="comment-policy"><p>d</p></article>', "a\nd"), ('<article>a<article class="reply">b</article>c</article>', "a\nc"),
    ("<article>a<p>b<ul><li>c<li>d <i>e</b></i></ul></p>f</article>", "a\nb\nc\nd e\nf"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<p>a<p>b<div>c<p>d</div>e", "a\nb\nc\nd\ne"), ("<i>a</p>b</i> c", "a\nb c"), ("<div><b>a</div>b</b> c", "a\nb c"),
])
def test_blocks_and_names(page, want):
    assert text(page) == want


@pytest.mark.parametrize("page", [
    "<svg>" * 200_000, "<svg " * 200_000, "<noscript>" * 100_000, "<script>" * 100_000, "<svg><script>" * 50_000, "<b>" * 100_000 + "</i>" * 100_000, "<table><tr><td>" + "<b>" * 50_000 + "<div></div>" * 50_000, "<article>" + "<span>" * 50_000 + "</p>" * 50_000,
    "<ul>" + "<li><b>" * 80_000, "<a \"'>" * 100_000, "<!--" * 200_000, "<" * 1_000_000, "<p " + "a=" * 400_000 + ">", "&amp" * 200_000, "<p><button>" * 60_000, "<article><p>x <button>y</button> z" * 20_000,
], ids=lambda p: p[:12])
def test_time_follows_length(page):
    began = time.process_time()
    html.parse(page)
    assert time.process_time() - began < 6 * len(page) / 1e6 + 1


def test_generated_pages(spark):
    """Articles of random blocks with inline markup, among and around what is no article; each page is its host's only one."""
    rng = random.Random(3)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "naïve", "a&b", "x<y"]) + str(rng.randrange(99))
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    furniture = ['<nav><ul><li>{0}</ul></nav>', '<aside><p>{0}</aside>', '<form>{0}<input></form>', '<div class="ad-box">{0}</div>', '<section class="comments"><article class="comment"><p>{0}</p></article></section>', "<script>if (a<b) '{0}'</script>", "<style>{0}</style>", "<footer>{0}</footer>", "<!-- {0} -->", "<svg><text>{0}</text></svg>", '<div hidden>{0}</div>']
    rows, want = [], {}
    for i in range(60):
        made, lines = [], []
        for _ in range(rng.randrange(1, 9)):
            if rng.random() < 0.35:
                made.append(rng.choice(furniture).format(escape(word())))
                continue
            pieces = []
            for _ in range(rng.randrange(1, 7)):
                w = word()
                pieces.append((w, rng.choice(["{0}", "<b>{0}</b>", "<a class='related' href='?a=1>2'>{0}</a>", "<span class=ad-hoc>{0}</span>", "<em>{0}</em><button>go</button>", "{0}<br>"]).format(escape(w))))
            tag = rng.choice(["p", "h2", "blockquote", "div", "li", "p class='code-notice'"])
            made.append(f"<{tag}>" + rng.choice([" ", "\n\t "]).join(p for _, p in pieces) + (f"</{tag.split()[0]}>" if rng.random() < 0.8 or tag in ("div", "blockquote", "li", "h2") else ""))
            lines.append(" ".join(w for w, _ in pieces))
        page = f"<html><head><title>t</title></head><body>{rng.choice(furniture).format('out')}<article>{''.join(made)}</article>{rng.choice(furniture).format('out')}</body></html>"
        rows.append((i, f"http://h{i}/", page))
        want[i] = "\n".join(lines)
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want
