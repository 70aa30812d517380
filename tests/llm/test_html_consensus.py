import random
import time

import pytest

from corvina.llm import html_consensus

PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><a href=/>Site name</a></header><nav><ul><li><a href=/a>A</a></ul></nav><!-- ad --><div class="ad">Buy now and save</div>
<div class="cookie-notice">We use cookies</div><main><article class="post-12"><header><h1>Title &amp; more</h1></header><p><b>First&nbsp;text
with  spaces.<br><p>Second &lt;p&gt; &#8364; caf&eacute;.</p><form><p>Search</p><input></form><aside><p>Aside text that is rather long for an aside</p></aside><ul><li>one<li>two</ul>
<table><tr><td>cell one<td>cell two</table><script>if (a<b) "x"</script><p hidden>secret</p><p style="display: none">gone</p></article>
<section id="comments"><p>Nice article, thanks a lot for all of this, dear writers!</p></section></main><footer>&copy; Site</footer></body></html>"""


def run(spark, rows, schema="page_id long, url string, html string"):
    return html_consensus.main_text(spark.createDataFrame(rows, schema).repartition(2)).collect()


def test_main_text_without_furniture(spark):
    got = run(spark, [(i, f"http://Site.example/{i}", PAGE.replace("post-12", f"post-{i}")) for i in range(6)])
    assert {r.text for r in got} == {"Title & more\n\nFirst text with spaces.\n\nSecond <p> € café.\n\none\n\ntwo\n\ncell one\n\ncell two"}
    assert all(r.n_chars == len(r.text) for r in got)


def test_the_host_decides(spark):
    def page(main, side):
        return f"<body><div class=content><p>{main}</p></div><div class=box><p>{side}</p></div></body>"

    usual = [(i, "https://h.example/x", page("long main text " * 20, "short")) for i in range(9)]
    odd = (99, "https://h.example/odd", page("short main text", "a very long side text " * 50))
    got = {r.page_id: r.text for r in run(spark, [*usual, odd, (100, "https://other.example/", odd[2])])}
    assert got[99] == "short main text"  # by the host's vote
    assert got[100].startswith("a very long side text")  # alone, by its own score


def test_damaged_html(spark):
    cases = ["", "<", "<p", "<p>a<p>b", "text only", "<div><p>x</span></p></article>y", "</div></div><p>z", "<!-- open <p>a</p>", "<script>never closed <p>a", "a &amp &unknown; &#x41; <b>c", "<table><tr><td>1<tr><td>2", "<p" * 500, "<div>" * 3000 + "deep" + "</div>" * 3000]
    got = {r.page_id: r.text for r in run(spark, [(i, None, h) for i, h in enumerate(cases)])}
    assert len(got) == len(cases)
    assert got[3] == "a\n\nb" and got[4] == "text only" and got[6] == "z" and got[10] == "1\n\n2" and got[12] == "deep"
    assert got[7] == got[8] == got[0] == ""


def test_edge_rows(spark):
    rows = [(None, None, None), (1, "no-scheme", "<p>a</p>"), (1, "no-scheme", "<p>a</p>"), (2, "http://h/", None)]
    assert sorted((r.page_id or 0, r.text) for r in run(spark, rows)) == [(0, ""), (1, "a"), (1, "a"), (2, "")]
    assert run(spark, []) == []
    assert run(spark, [(1, "http://h/", "<p>a</p>", "p", "t")], "page_id long, url string, html string, paths string, host string")[0].text == "a"


def test_many_hosts_are_joined(spark, monkeypatch):
    rows = [(i, f"http://h{i % 5}/", PAGE) for i in range(20)]
    usual = sorted((r.page_id, r.text) for r in run(spark, rows))
    monkeypatch.setattr(html_consensus, "BROADCAST_BYTES", 2)
    assert sorted((r.page_id, r.text) for r in run(spark, rows)) == usual


def test_title_and_lead_stay_with_a_long_part(spark):
    lead, words = "An intro to the parts. " * 4, "part of the text " * 60
    pages = {
        1: f"<article><h1>T</h1><p>{lead}</p><ul><li>{words}</ul></article>",
        2: f"<article><header><h1>T</h1><p>{lead}</p></header><div class=entry-content><p>{words}</p></div></article>",
        3: f"<div class=post><h2><a href=/>T</a></h2><p>{lead}</p><table><tr><td>{words}</table></div>",
        4: f"<div class=post><div class=head><h1>T</h1></div><div class=lead><p>{lead}</p></div><div class=entry><p>{words}</p></div></div>",
        5: f"<article><div class=head><h1>T</h1></div><div class=lead><p>{lead}</p></div><section><p>{words * 9}</p></section></article>",
    }
    rows = [(k, f"http://h{k}.example/{i}", f"<html><body><div class=page>{p}</div></body></html>") for k, p in pages.items() for i in range(4)]
    for r in run(spark, rows):
        assert r.text.split("\n\n") == ["T", lead.strip(), (words * 9 if r.page_id == 5 else words).strip()], r.page_id


def test_rare_templates_keep_their_own_text(spark):
    """A box that every page has is the text of some pages only, and no template has a tenth of the votes."""
    box = "<div class=latest><p>Latest of all the news.</p></div>"
    rows = [(k, "http://h.example/", f"<body><div class=kind-{chr(97 + k)}><p>{f'text of kind {chr(97 + k)} ' * 60}</p></div>{box}</body>") for k in range(16)]
    rows += [(99, "http://h.example/", f"<body>{box}</body>")] * 3
    for r in run(spark, rows):
        assert r.text == ("Latest of all the news." if r.page_id == 99 else f"text of kind {chr(97 + r.page_id)} " * 60).strip()


def test_names_that_are_no_furniture(spark):
    words = "words of the text " * 20
    pages = {
        1: f'<div class="content has-sidebar"><article><h1>T</h1><p>{words}</p></article></div>',
        2: f'<div class="with-sidebar"><p>{words}</p></div>',
        3: f'<article><p>{words}</p><h2 id="related-work">Related work</h2><p>a</p><h2 id=discussion>Discussion</h2><section id=discussion><p>b</p></section><div id="comments-on-x"><p>c</p></div></article>',
        4: f'<div class="sidebar"><main><p>{words}</p></main></div><p class="site-footer">gone</p>',
        5: f'<form id=all><div class=menu><p>gone</p></div><div class=text><p>{words}</p></div></form>',
        6: f'<article><p>{words}</p></article><div id=comments><article class="comment-body"><p>{words * 9}</p></article></div><div class="related-posts"><article><p>gone</p></article></div>',
    }
    got = {r.page_id: r.text for r in run(spark, [(k, f"http://n{k}.example/", f"<body>{p}</body>") for k, p in pages.items()])}
    w = words.strip()
    assert got == {1: "T\n\n" + w, 2: w, 3: "\n\n".join([w, "Related work", "a", "Discussion", "b", "c"]), 4: w, 5: w, 6: w}


def test_words_alone_empty_no_page(spark):
    w = ("words of the text " * 20).strip()
    pages = {
        1: f'<div class="with-sidebar content"><p>{w}</p></div>',
        2: f'<div class="entry ad-free"><p>{w}</p></div>',
        3: f'<article><p>{w}</p><section class="discussion"><p>{w}</p></section></article>',
        4: f'<div id="related-work"><p>{w}</p></div>',
        5: f'<div class="share-price"><p>{w}</p></div>',
        6: f"<header><h1>T</h1></header><div class=x><p>{w}</p></div>",
        7: f"<header><h1>Site</h1><a href=/>home</a></header><div class=x><h1>T</h1><p>{w}</p></div>",
        8: f'<div class="comments"><p>{w}</p></div>',
    }
    got = {r.page_id: r.text for r in run(spark, [(k, f"http://e{k}.example/", f"<body>{p}</body>") for k, p in pages.items()])}
    assert got == {1: w, 2: w, 3: f"{w}\n\n{w}", 4: w, 5: w, 6: f"T\n\n{w}", 7: f"T\n\n{w}", 8: w}


HOSTILE = [
    '<a "', "<b>x</i>", "<div>x", "<p", "</p>", "<li>x<div>", "<script>", "<!-", "&amp", '<a href="x"', '<div class="nav">', "<form>x", "<b><h2>", "<i><div><b></i>", "<b><a>x</a>", "<div><h1>x</h1>", "<!x", "</script ", "<svg>",
    "&#00000", "&#1111111", '<p class="', "<table><tr><td>", "<a href=x><p>", "<main><div class=comment>z", "<a x='", "<header><h1>w",
]


def test_hostile_pages_take_linear_time():
    for part in HOSTILE:
        began = time.process_time()
        html_consensus.extract(html_consensus.read((part * (500_000 // len(part)))[:500_000]), [b"x" * html_consensus.KEY_BYTES])
        assert time.process_time() - began < 10, part  # a quadratic reader takes minutes


def brute(rows):
    """Texts by the method in plain words: paths as strings, votes counted a host at a time."""
    pages = []
    for page_id, host, html in rows:
        page = html_consensus.read(html)
        paths = [""]
        for k in range(1, len(page.up)):
            paths.append(paths[page.up[k]] + "/" + next(part for (above, part), made in page.known.items() if made == k))
        mine = html_consensus.own(page)
        has = {p for p in paths if any(paths[k] == p or paths[k].startswith(p + "/") for k, *_ in page.blocks)}
        pages.append((page_id, host, page, paths, None if mine is None else paths[mine], has))
    out = {}
    for page_id, host, page, paths, mine, has in pages:
        others = [x for x in pages if x[1] == host]
        votes = {p: sum(x[4] == p for x in others) for p in {x[4] for x in others} - {None}}
        strong = [p for p, n in votes.items() if n >= html_consensus.SHARE * sum(votes.values()) and 2 * n >= sum(p in x[5] for x in others)]
        strong = [p for p in strong if p in has]
        most = [p for p in strong if votes[p] == max(votes[x] for x in strong)]
        chosen = {mine} if mine in strong or not strong else set(most)
        texts = set()
        for path in chosen - {None}:
            top = paths[html_consensus._raised(page, paths.index(path))]
            texts.add("\n\n".join(t for k, t, *_ in page.blocks if paths[k] == top or paths[k].startswith(top + "/")))
        out[page_id] = texts or {""}
    return out


def test_votes_against_brute_force(spark):
    rng = random.Random(8)

    def part(depth):
        tag = rng.choice(["div", "div class=a", "div class=b7", "section", "ul", "table", "article"])
        inner = "".join(part(depth - 1) if depth and rng.random() < 0.6 else f"<p>{'word ' * rng.randrange(1, 40)}{rng.randrange(99)}</p>" for _ in range(rng.randrange(1, 4)))
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    rows = []
    for host in range(8):
        templates = [part(3) for _ in range(3)]
        rows += [(len(rows) + k, f"h{host}.example", "<body>" + rng.choice([*templates, templates[0], part(2)]) + (part(1) if k % 3 == 0 else "") + "</body>") for k in range(14)]
    want = brute(rows)
    for r in run(spark, [(i, f"http://{h}/{i}", html) for i, h, html in rows]):
        assert r.text in want[r.page_id], r.page_id


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ("<p>one <label>two</label> three</p>", "one two three"),
        ("<p>Press <button>OK</button> to go on.</p>", "Press OK to go on."),
        ('<p class="rail">Rail traffic grew.</p>', "Rail traffic grew."),
        ('<p class="share">Each share rose.</p>', "Each share rose."),
        ('<p class="skip">To skip is to miss.</p>', "To skip is to miss."),
        ('<div id="social"><p>Social ties hold.</p></div>', "Social ties hold."),
        ('<h2 class="navigation">Navigation at sea</h2>', "Navigation at sea"),
        ('<p class="share"><a href="a">Share</a> <a href="b">Post</a></p>', ""),
        ('<div id="related"><a href="a">One</a><a href="b">Two</a></div>', ""),
        ('<p class="advert">Buy this now.</p>', ""),
        ("<p><button>Share</button></p>", ""),
        ('<form><p>Your <label>name</label></p></form>', ""),
        ('<div class="share">Tell a friend</div>', ""),
    ],
)
def test_words_of_a_text_and_words_of_furniture_inside_articles(inner, want):
    filler = "Plain words of the article that say enough to be its text. " * 3
    page = html_consensus.read(f"<html><body><article><p>{filler}</p>{inner}<p>{filler}</p></article></body></html>")
    said = [text for _, text, _, _ in page.blocks]
    assert said[0] == said[-1] == filler.strip() and "\n".join(said[1:-1]) == want
