"""Forms of pages that the given tables lack, and the labeller against plain versions."""

import copy

import numpy as np
import pytest

from cordage.llm import html

TABLES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return html.train(spark.read.parquet(f"{TABLES}/pages.parquet"))


A, B = "First words of the text stand here.", "Second words end it."
IN = f"<p>{A}</p>%s<p>{B}</p>"
BOTH, NAV = f"{A}\n\n{B}", "<nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
page = lambda inside: f"<html><head><title>T</title></head><body>{NAV}{inside}<footer><p>© x</p></footer></body></html>"
article = lambda inside: page(f"<article>{IN % inside}</article>")

FORMS = {
    "comments in the article": (article('<div class="comments"><h2>Two comments</h2><div><p>I agree.</p></div><div><p>I do not.</p></div></div>'), BOTH),
    "comments by a service": (article('<div id="disqus_thread"><p>Nice text, thank you.</p></div>'), BOTH),
    "comment articles": (page(f'<main>{IN % ""}<section id="comments"><article class="comment"><p>So true.</p></article></section></main>'), BOTH),
    "names in humps": (article('<div class="commentList"><p>Well said.</p></div>'), BOTH),
    "newsletter in main": (page(f'<main>{IN % """<div class="newsletter"><p>Get our letter every week.</p></div>"""}</main>'), BOTH),
    "advert in the article": (article('<div class="ad-slot"><p>Buy this now.</p></div>'), BOTH),
    "side column by classes": (page(f'<div id="main-col">{IN % ""}</div><div class="widget-area sidebar-right"><h3>Popular</h3><p>Other text that is long enough.</p></div>'), BOTH),
    "side column in main": (page(f'<main>{IN % ""}<aside><p>See also this.</p></aside></main>'), BOTH),
    "a form in the article": (article('<form><label>Name</label><input><button>Send</button><p>We never share it.</p></form>'), BOTH),
    "a notice before it": (page(f'<div class="cookie-notice"><p>We use cookies.</p></div><article>{IN % ""}</article>'), BOTH),
    "a list in the article": (article("<ul><li>item one</li><li>item two</li></ul>"), f"{A}\n\nitem one\n\nitem two\n\n{B}"),
    "a table in the article": (article("<table><tr><td>cell</td><td>7</td></tr></table>"), f"{A}\n\ncell\n\n7\n\n{B}"),
    "a quotation and a heading": (article("<h2>Part</h2><blockquote><p>Said so.</p></blockquote>"), f"{A}\n\nPart\n\nSaid so.\n\n{B}"),
    "a link in the article": (article('<p><a href="/x">read more of it</a></p>'), f"{A}\n\nread more of it\n\n{B}"),
    "a header in the article": (page(f'<article><header class="entry-header"><h1>Title</h1></header>{IN % ""}</article>'), f"Title\n\n{BOTH}"),
    "quotes in values without quotes": (page("<article><p data-a=it's>Text one here don't go</p><p title=\"a > b\" class='x'>and on</p></article>"), "Text one here don't go\n\nand on"),
    "a link of its own": (f'<html><body>{NAV}<p>{A}</p><p>{B}</p><div><a href="/next">Next page</a></div></body></html>', BOTH),
    "no container": (f"<p>{A}<p>{B}", BOTH),
    "what a page has": (f'<html><body class="has-sidebar with-ads">{NAV}<div class="content no-sidebar">{IN % ""}</div></body></html>', BOTH),
    "scripts and styles": (article('<script data-x="</p>">if (a<b) {"</div>"}</script><style>p{}</style><!-- <p>no</p> -->'), BOTH),
}


@pytest.mark.parametrize("name", FORMS)
def test_form(model, name):
    got = html.main_text(FORMS[name][0], model, html.Features())
    assert got == FORMS[name][1]


def test_given_pages_are_read_as_their_elements_tell(spark, model):
    rows = spark.read.parquet(f"{TABLES}/pages.parquet").select("html").collect()
    texts = html.main_texts([r.html for r in rows], model, html.Features())
    for r, text in zip(rows, texts, strict=True):
        found = html.blocks(r.html)
        assert text == "\n\n".join(b.text for b in found if "article" in b.path)


def test_long_pages_without_ends():
    for part in ("<p a=\"b' ", "<a href='", "<", "<p ", "<!--", "='\"", "<script", "<div class=\"comments\">x"):
        assert len(html.blocks(part * 20_000)) in (0, 1, 20_000)


def plain_scores(model, feats):
    """The network block by block, from the formulas."""
    sig = lambda z: 1 / (1 + np.exp(-z))
    x, sides = model.inputs(feats).astype(np.float64), []
    for side in (0, 1):
        h = c = np.zeros(html.HIDDEN)
        out = []
        for row in x if side == 0 else x[::-1]:
            f, i, o, g = np.split(np.concatenate([row, h]) @ model.w[side] + model.b[side], 4)
            c = sig(f) * c + sig(i) * np.tanh(g)
            h = sig(o) * np.tanh(c)
            out.append(h)
        sides.append(out if side == 0 else out[::-1])
    return np.array([sig(np.concatenate([a, b]) @ model.out + row[-html.NUMBERS :] @ model.own + model.out_b[0]) for a, b, row in zip(*sides, x, strict=True)])


def test_labeller_equals_a_plain_one_and_its_gradients_the_slopes():
    found = html.blocks(FORMS["comments in the article"][0])
    feats, y = html.Features().of(found), html.weak_labels(found)
    model = html.Labeller(5)
    other = html.Features().of(found[:3])
    assert np.allclose(model.scores([model.inputs(feats), model.inputs(other)])[0], plain_scores(model, feats), atol=1e-5)
    for p in model.params():
        p += np.random.default_rng(p.size).normal(0, 0.1, p.shape).astype(np.float32)

    def loss(m):
        s = plain_scores(m, feats)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for k, g in enumerate(model.grads(feats, y)):
        for at in np.argsort(-np.abs(g), axis=None)[:4]:
            up, down = copy.deepcopy(model), copy.deepcopy(model)
            up.params()[k].flat[at] += 1e-3
            down.params()[k].flat[at] -= 1e-3
            assert abs((loss(up) - loss(down)) / 2e-3 - g.flat[at]) < 1e-3 + 0.02 * abs(g.flat[at])
