import random
import re

import numpy as np
import pytest

from pulsegrid.llm import page_text as pt
from pulsegrid.llm.html_blocks import blocks_of

SMALL = pt.FitParams()


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.001/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return pt.learn(pages, p=SMALL)


def texts(html):
    return [(b.text, "/".join(e[0] for e in b.path)) for b in blocks_of(html)]


def test_blocks():
    assert texts("") == [] and texts("  \n ") == [] and texts("a < b &amp; c&nbsp;&#233;<br>d") == [("a < b & c é d", "")]
    assert texts("<p>one<p><b>two<br><p>three</p></b> tail") == [("one", "p"), ("two", "p"), ("three", "p"), ("tail", "")]
    assert texts("<script>var t='</p>';</script><style>p{}</style><!-- <p>x</p> --><p>y") == [("y", "p")]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul>d</div>") == [("a", "ul/li"), ("b", "ul/li"), ("c", "ul/li/ul/li"), ("d", "")]
    assert texts("<div title='a>b' class=\"x\">q</div><SCRIPT>never closed <p>") == [("q", "div")]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>") == [("1", "table/tr/td"), ("2", "table/tr/td"), ("3", "table/tr/td")]
    block = blocks_of('<nav class="mainMenu top"><a href=x>Home</a> more</nav>')[0]
    assert block.path == (("nav", ".main", ".menu", ".top"),) and block.linked == 4


def test_silent_elements_end_where_they_end():
    page = "<article><p>one {} two</p><p>three</p></article>"
    whole = [("one two", "article/p"), ("three", "article/p")]
    for silent in ('<svg-icon name="x"></svg-icon>', "<svg>", "<svg><title>t</title></svg>", "<select><option>a</select>", "<svg/>",
                   "<iframe>", "<template><p>no</template>", "<script>no</script >", "<style-x>", "<svg></svg-icon></svg>"):
        got = texts(page.format(silent))
        assert " ".join(t for t, _ in got) == "one two three", silent
        assert got == whole or "-" in silent, silent
    assert texts(page.format("<math><mi>x</mi><mo>=</mo><mn>1</mn></math>"))[0] == ("one x = 1 two", "article/p")
    assert texts(page.format("<math>"))[1:] == [("three", "article/p")]
    for kind in ("noscript", "object"):
        assert texts(page.format(f"<{kind}>held</{kind}>"))[:3] == [("one", "article/p"), ("held", f"article/p/{kind}"), ("two", "article/p")]
        assert [t for t, _ in texts(page.format(f"<{kind}>"))] == ["one", "two", "three"]
    assert [t for t, _ in texts("<p>a<select><option>b<option>c<p>d")] == ["a", "b", "c", "d"]
    assert texts("<p>a<textarea>b<p>c") == [("a", "p")]


def test_attributes_and_comments_end_as_in_browsers():
    said = lambda html: [t for t, _ in texts(html)]
    assert said("<p data=it's>text one</p><p>that's two</p><p>three</p>") == ["text one", "that's two", "three"]
    assert said('<p it"s>one</p><p>"two"</p>') == ["one", '"two"'] and said("<p a= 'x>y' b=\"p>q\">one") == ["one"]
    assert said("<p a=b\"c d>one</p><p e=>two</p><p = >three") == ["one", "two", "three"]
    assert said("<a href=x?y='z'>link</a> <img alt=it's> on") == ["link on"]
    assert said("<!-- c --!><p>one</p><!--><p>two</p><!---><p>three</p><!----><p>four</p><!-- <p>no</p> -- > --><p>five") == [
        "one", "two", "three", "four", "five"]
    assert said("a</>b</3 c>d<!doctype html>e<?php f ?>g<![CDATA[h]]>i") == ["abdegi"] and said("a</") == ["a</"]
    assert said("<script data-x=it's>no</script><p>one</p>") == ["one"] and said("<p title='never closed>one</p>") == []


def test_deep_and_long_pages_take_linear_time():
    import time

    depth = 60_000
    start = time.process_time()
    deep = blocks_of("<div>x" * depth + "</b>" * depth + "<p>tail" + "</div>" * depth)
    assert len(deep) == depth + 1 and deep[-1].place.depth == depth + 1 and deep[-1].text == "tail"
    assert len(blocks_of("<ul><li>" * depth + "<span>" * depth + "<li>y" * 100)) == 100
    assert len(blocks_of("<p>a <i>b</i> &amp; c" * depth)) == depth
    assert len(pt.vectors(deep, {}).path) == depth + 1
    assert time.process_time() - start < 60
    assert blocks_of("<div class=a><p id='b'>x")[0].path == (("div", ".a"), ("p", ".b"))


def test_pages_without_names(pages, model):
    """Pages whose classes, ids, roles and telling elements are gone mostly come out whole: it is no mere list of names."""
    bare = re.compile(r"""\s(?:class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""")
    plain = re.compile(r"<(/?)(?:article|main|nav|header|footer|aside|section)\b[^>]*>", re.I)
    whole = lost = total = 0
    some = pages.orderBy("page_id").limit(120).collect()
    for r in some:
        want = [any(e[0] == "article" for e in b.path) for b in blocks_of(r.html)]
        blocks = blocks_of(plain.sub(r"<\1div>", bare.sub("", r.html)))
        assert [b.text for b in blocks] == [b.text for b in blocks_of(r.html)]
        got = model.probabilities([pt.vectors(blocks, {})])[0] >= 0.5
        whole += all(g for g, w in zip(got, want) if w)
        lost += sum(w and not g for g, w in zip(got, want))
        total += sum(want)
    assert whole >= 0.6 * len(some) and lost <= 0.1 * total


def test_clashing_columns(spark, pages, model):
    few = pages.limit(3)
    clash = few.selectExpr("page_id as text", "url as blocks", "html as page_id", "1 as url", "2 as html")
    got = pt.extract(clash, model, "text", "blocks", "page_id").collect()
    want = pt.extract(few, model).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_gradients_are_those_of_the_loss():
    draw = pt.Layouts(["some words of a text that is long enough to be a paragraph here, or more than that"], random.Random(1))
    pages_ = [draw.page() for _ in range(3)]
    seqs, labels = [pt.vectors([b for b, _ in p], {}) for p in pages_], [np.array([y for _, y in p], float) for p in pages_]
    net = pt.Labeller(0)
    _, grads = net.gradients(seqs, labels)
    for name in ("ahead", "back", "out", "ahead_bias", "path", "word"):
        where = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        kept = net.w[name][where]
        loss = []
        for d in (1e-5, -1e-5):
            net.w[name][where] = kept + d
            loss.append(net.gradients(seqs, labels)[0])
        net.w[name][where] = kept
        assert abs((loss[0] - loss[1]) / 2e-5 - grads[name][where]) < 1e-5 + 1e-3 * abs(grads[name][where]), name


def test_unseen_layouts(pages, model):
    said = [b.text for r in pages.collect() for b in blocks_of(r.html)]
    draw, wrong, total = pt.Layouts(said, random.Random(12345)), 0, 0
    for _ in range(150):
        page = draw.page()
        p = model.probabilities([pt.vectors([b for b, _ in page], {})])[0]
        wrong += sum((q >= 0.5) != bool(y) for q, (_, y) in zip(p, page))
        total += len(page)
    assert wrong < 0.04 * total


def test_pages_as_given_and_in_other_clothes(spark, pages, model):
    body = "".join(f"<p>Paragraph {k} of the story, which says this and that at some length.</p>" for k in range(5))
    story = "\n".join(["A title"] + [f"Paragraph {k} of the story, which says this and that at some length." for k in range(5)])
    dressed = f"""<html><head><title>t</title></head><body><header><a href=/>Site</a></header><nav><ul><li><a>Home</a></ul></nav>
      <div class="cookie-notice">We use cookies.</div><main><article><h1>A title</h1>{body}</article></main>
      <aside class="sidebar"><h3>Related</h3><ul><li><a>More</a></ul></aside><form><label>Mail</label></form>
      <section class="comments"><h2>Comments</h2><p>I liked this a lot, thank you.</p></section><footer><p>Legal</p></footer></body></html>"""
    extra = spark.createDataFrame([(-1, "u", dressed), (-2, None, None), (-3, "", ""), (-3, "", ""), (None, "x", "<p>")], pages.schema)
    rows = pt.extract(pages.union(extra), model).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == pages.count() + 5
    assert got[-1].text == story
    assert got[-2].text == got[-3].text == got[None].text == ""
    for r in pages.collect():
        want = "\n".join(b.text for b in blocks_of(r.html) if any(e[0] == "article" for e in b.path))
        assert got[r.page_id].text == want
    assert pt.extract(pages.limit(0), model).count() == 0
