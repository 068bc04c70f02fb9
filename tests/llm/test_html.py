import math
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from millrace.llm import htmltext as H

_STORY = [
    "The harbour opened again on Monday after three weeks of repairs.",
    "Fishermen had moored their boats along the river while the sea wall was being rebuilt, and many of them lost a good part of the season's catch.",
    "What comes next",
    "The council will meet in March to decide whether the second wall is needed, and who is going to pay for it.",
]
#: Pages without article and main elements, each with the texts of its main blocks.
HAND_MADE = [
    (
        "<html><body><div id='top'><a href='/'>Home</a> <a href='/n'>News</a></div><div id='story'><h1>Harbour open</h1>"
        + "".join(f"<p>{t}</p>" for t in _STORY)
        + "</div><div id='footer'><p>Copyright 2020, all rights reserved</p></div></body></html>",
        ["Harbour open", *_STORY],
    ),
    (
        "<html><body><ul class='menu'><li><a href='/a'>Start</a><li><a href='/b'>Sport</a><li><a href='/c'>Culture</a></ul><h1>Harbour open</h1>"
        + "".join(f"<p>{t}</p>" for t in _STORY)
        + "<div class='related'><h3>Read more</h3><ul><li><a href='/1'>Old bridge closed</a><li><a href='/2'>Ferry sold</a></ul></div><footer>Imprint</footer></body></html>",
        ["Harbour open", *_STORY],
    ),
    (
        "<html><body><table class='layout'><tr><td class='sidebar'><a href='/x'>Weather</a><br><a href='/y'>Roads</a></td><td class='content'><h2>Harbour open</h2>"
        + "".join(f"<p>{t}</p>" for t in _STORY)
        + "</td></tr></table><div class='cookie-banner'><p>We use cookies to make this site work. By going on you agree.</p><button>Accept</button></div></body></html>",
        ["Harbour open", *_STORY],
    ),
    (
        "<html><body><div class='header'><div class='logo'>The Daily</div><form class='search'><label>Search</label><input></form></div><div class='post-body'><h1>Harbour open</h1><div>"
        + "</div><div>".join(_STORY)
        + "</div></div><div class='comments'><h3>2 comments</h3><div class='comment'><p>Great news, well done everyone!</p></div><div class='comment'><p>It took far too long if you ask me, but fine.</p></div></div></body></html>",
        ["Harbour open", *_STORY],
    ),
    (
        "<html><body><div class='nav'><a href='/'>Home</a></div><div class='wrap'><div class='entry'><h1>Harbour open</h1><div class='share'><a href='/f'>Facebook</a> <a href='/t'>Twitter</a></div>"
        + "".join(f"<p>{t}</p>" for t in _STORY)
        + "<div class='advert'><p>Advertisement: new boots, buy now</p></div><blockquote><p>We are glad it is over.</p></blockquote><ul><li>Cost: four million</li><li>Length: 300 metres</li></ul></div></div><div class='newsletter'><p>Sign up for our newsletter</p><input></div><div class='footer'>Terms and privacy</div></body></html>",
        ["Harbour open", *_STORY, "We are glad it is over.", "Cost: four million", "Length: 300 metres"],
    ),
    (
        "<html><body><div><div><a href='/'>Back</a></div><div><h1>Harbour open</h1><p>" + "<p>".join(_STORY) + "</div><div><a href='/p'>Previous</a> <a href='/n'>Next</a></div></div></body></html>",
        ["Harbour open", *_STORY],
    ),
    (
        "<html><body><div class='social-links'><ul><li><a href='/f'>Follow us</a></li></ul></div><section class='page-content'><h1>Harbour open</h1>"
        + "".join(f"<p>{t}</p>" for t in _STORY)
        + "<pre>tide = 4.2 m</pre></section><div class='gdpr consent'><div>This website and its partners store and read information on your device. You can agree to this, or choose what you allow, at any time. "
        + "Some of our partners rely on their own interest in this. Cookies help us to count visits, and to show you adverts that fit. Change your choice below.</div></div></body></html>",
        ["Harbour open", *_STORY, "tide = 4.2 m"],
    ),
]


@pytest.fixture(scope="module")
def extractor():
    return H.Extractor(H._weights())


def test_leaves():
    page = "<!doctype html><html><head><title>T</title><style>p{}</style></head><body><!-- <p>no</p> --><script>var t='</p>';</script><ul><li>a<li>b</ul><p>one <b>two<br>three &amp; &lt;4&gt;<p>five&nbsp;six</body>"
    assert [x.text for x in H.leaves(page)] == ["a", "b", "one two three & <4>", "five six"]
    assert [x.tag for x in H.leaves(page)] == ["li", "li", "p", "p"]
    assert [x.text for x in H.leaves("1 < 2 and 3 > 2 <p>x<")] == ["1 < 2 and 3 > 2", "x<"]
    assert H.leaves("") == [] and H.leaves("<div><p></p> \n </div>") == []
    assert H.leaves("<p><a href='x'>link</a></p>")[0].linked == 1.0


def test_made_pages_are_labelled_right(extractor):
    rng = np.random.default_rng(1234)
    wrong = total = 0
    for _ in range(150):
        x, y = H.labelled(*H.made_page(rng))
        p = extractor.net.score(*H.padded([x]))[:, 0]
        wrong += int(((p > 0.5) != (y > 0.5)).sum())
        total += len(y)
    assert wrong / total < 0.01


def test_pieces_and_padding_change_nothing(extractor, monkeypatch):
    rng = np.random.default_rng(5)
    pages = [H.vectors(H.leaves(H.made_page(rng)[0])) for _ in range(6)]
    alone = [extractor.net.score(*H.padded([p]))[:, 0] for p in pages]
    monkeypatch.setattr(H, "PIECE", 7)
    x, mask = H.padded(pages)
    together = extractor.net.score(x, mask)
    for i, p in enumerate(alone):
        assert np.allclose(together[: len(p), i], p, atol=1e-5)


def test_gradients():
    net = H.Network.fresh()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(2)
    x, mask = rng.normal(size=(4, 2, H.WIDTH)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y = (rng.random((4, 2)) > 0.5).astype(float)

    def loss():
        out = [net.run(x, mask, d)[0] for d in "fb"]
        p = 1 / (1 + np.exp(-(np.concatenate([*out, x], axis=2) @ net.w["out"] + net.w["bias"])[..., 0]))
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    grads = net.gradients(x, mask, y)
    for key in ("xf", "hb", "bf", "out"):
        at = tuple(n // 2 for n in net.w[key].shape)
        old = net.w[key][at]
        net.w[key][at] = old + 1e-4
        up = loss()
        net.w[key][at] = old - 1e-4
        down = loss()
        net.w[key][at] = old
        assert grads[key][at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=1e-7)


def test_main_text(spark):
    article = "<article><h1>Big  news</h1><p>First &amp; foremost\n, this is the story of the day.</p><p>And it goes on for a while.</p></article>"
    page = f"<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>About</a></li></ul></nav><div class='ad'>Buy this now</div>{article}<footer>&copy; us</footer></body></html>"
    rows = [(1, "u1", page), (2, "u2", None), (3, None, ""), (None, "u4", "<nav><a href='/'>x</a></nav>"), (1, "u1", page)]
    df = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = sorted(((r.page_id, r.text, r.n_chars) for r in H.main_text(spark, df).collect()), key=str)
    text = "Big news\n\nFirst & foremost , this is the story of the day.\n\nAnd it goes on for a while."
    assert out == sorted([(1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0), (None, "", 0)], key=str)
    assert H.main_text(spark, df.limit(0)).count() == 0


def test_provided_pages(spark):
    """The provided pages have their article between article tags; everything in it, and nothing else, is main text."""
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    out = {r.page_id: r.text for r in H.main_text(spark, spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    for p in pages:
        inner = p["html"][p["html"].index("<article>") : p["html"].index("</article>")]
        assert out[p["page_id"]] == "\n\n".join(x.text for x in H.leaves(inner))


def test_long_page(extractor):
    page = "<article>" + "".join(f"<p>paragraph number {i} of a long story</p>" for i in range(3000)) + "</article>"
    text = extractor.texts([page, ""])
    assert text[0].count("\n\n") > 2900 and text[1] == ""


def test_what_is_seen():
    """Formulas, pictures' texts, objects' fallbacks and what stands for scripts are text; what no browser shows is not."""
    page = "<head><title>a<b>t</title><p>The equation <math><mi>x</mi> <mo>=</mo> <mn>5</mn><annotation>x=5</annotation></math> holds <object>here</object></p><svg><title>no</title><text>drawn</text></svg><noscript><p>plain</noscript><template><p>no</template><select><option>no</select><textarea>no</textarea><p>foo<script>no</script>bar<iframe>no</iframe> baz"
    assert [x.text for x in H.leaves(page)] == ["The equation x = 5 holds here", "drawn", "plain", "foobar baz"]
    assert [x.text for x in H.leaves("<p title='a>b'>x &lt;<b>&amp;amp;</b> <p title='never closed>y</p>z")] == ["x <&amp;", "y", "z"]


@pytest.mark.parametrize(
    "page",
    ["<p>" + "<span>x " * 100_000, "<div>x" * 100_000, "<b>x<p>" * 50_000, "<a '>'" * 50_000 + '<a "', "<ul><li>x" * 30_000, "<td><tr>x" * 50_000, "word " * 400_000, "</p>" * 200_000, "<!-- " * 100_000, "<" * 300_000],
)
def test_time_grows_with_the_page(page):
    start = time.process_time()
    H.vectors(H.leaves(page))
    assert time.process_time() - start < 10


def test_all_words_of_a_block_count():
    words = [f"w{i}" for i in range(301)]
    middle = [*words[:150], "cookies", *words[151:]]
    a, b = (H.vectors(H.leaves(f"<p>{' '.join(x)}")) for x in (words, middle))
    assert (a != b).any()
    names = " ".join(f"name{c}" for c in "abcdefghijklmnopqrstuvwxyz")
    assert H.leaves(f"<div class='{names} sidebar'>x")[0].at.bits != H.leaves(f"<div class='{names}'>x")[0].at.bits
    # very long blocks are hashed in pieces, words and all
    long = " ".join(f"v{i % 5000}" for i in range(400_000))
    share, n = H._word_shares([long, "a", ""])
    assert n.tolist() == [400_000, 1, 0] and share[0].min() > 0 and share[2].sum() == 0


def plain_scores(w, x):
    """The network unit by unit, step by step."""
    sig = lambda v: 1 / (1 + math.exp(-v))
    h_of = {}
    for d in "fb":
        h, c, states = [0.0] * H.HIDDEN, [0.0] * H.HIDDEN, {}
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            z = [float(w[f"b{d}"][k] + sum(x[t][i] * w[f"x{d}"][i][k] for i in range(H.WIDTH)) + sum(h[i] * w[f"h{d}"][i][k] for i in range(H.HIDDEN))) for k in range(4 * H.HIDDEN)]
            gate = [z[k * H.HIDDEN : (k + 1) * H.HIDDEN] for k in range(4)]
            c = [sig(gate[1][k]) * c[k] + sig(gate[0][k]) * math.tanh(gate[3][k]) for k in range(H.HIDDEN)]
            h = [sig(gate[2][k]) * math.tanh(c[k]) for k in range(H.HIDDEN)]
            states[t] = h
        h_of[d] = states
    out = []
    for t in range(len(x)):
        both = [*h_of["f"][t], *h_of["b"][t], *x[t]]
        out.append(sig(float(w["bias"][0]) + sum(v * float(w["out"][i][0]) for i, v in enumerate(both))))
    return out


def test_equals_plain_network(extractor):
    x = H.vectors(H.leaves(H.made_page(np.random.default_rng(8))[0])[:6])
    assert np.allclose(extractor.net.score(*H.padded([x]))[:, 0], plain_scores(extractor.net.w, x.tolist()), atol=1e-4)


def test_pages_without_article(extractor):
    """Hand-made pages in which no article or main element tells the text: nearly all blocks are labelled right."""
    right = total = 0
    for page, main in HAND_MADE:
        blocks = [x.text for x in H.leaves(page)]
        assert set(main) <= set(blocks)
        got = extractor.texts([page])[0].split("\n\n")
        right += sum((b in main) == (b in got) for b in blocks)
        total += len(blocks)
    assert total > 60 and right / total >= 0.9


def test_repeated_rows_and_ties(spark):
    """Repeated pages, also of one id with other texts, each give their own row."""
    rows = [(7, "u", "<article><h1>One</h1><p>text of the first page</p></article>"), (7, "u", "<article><h1>Two</h1><p>text of the second page</p></article>")]
    df = spark.createDataFrame(rows * 2, "page_id long, url string, html string")
    assert sorted(r.text for r in H.main_text(spark, df).collect()) == sorted(["One\n\ntext of the first page", "Two\n\ntext of the second page"] * 2)
