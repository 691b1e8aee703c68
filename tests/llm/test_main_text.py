"""Main text of pages: the pages' own articles, layouts not seen, sums over all states, slopes by differences, odd markup."""

import html
import itertools
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import main_text, markup
from tidemark.llm.common import table

MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages(spark):
    return table(spark, MID, "pages")


@pytest.fixture(scope="module")
def model(pages):
    return main_text.learned(pages, sample=120)


def article(page):
    """The text between the article's tags, of pages without other markup than the generator's."""
    found = re.search("<article>(.*?)</article>", page or "", re.S)
    return " ".join(" ".join(html.unescape(x) for x in re.split("<[^>]*>", found[1])).split()) if found else ""


def test_articles_of_the_pages(spark, pages, model):
    rows = main_text.extracted(pages, model).collect()
    want = {r.page_id: article(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in rows} == want and all(want.values())
    out = main_text.op12_main_text(spark, MID)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and {(r.page_id, r.text, r.n_chars) for r in out.collect()} == {(k, v, len(v)) for k, v in want.items()}


def escaped(x):
    return x.replace("&", "&amp;").replace("<", "&lt;")


def test_layouts_not_seen(pages, model):
    texts = [article(r.html) for r in pages.collect()]
    others = [escaped(t[:200]) for t in texts if len(t) > 40][:80]
    wrong = n = 0
    for i, t in enumerate(texts[120:]):
        blocks = [escaped(t[j : j + 150]) for j in range(0, min(len(t), 1200), 150) if t[j : j + 150].strip()]
        tree, states = main_text.stated(main_text.layouts(blocks, others, 10**6 + i), kinds := main_text.Kinds())
        good = model.beliefs(main_text.Forest([tree], kinds))[0][:, 1] >= 0.5
        wrong += sum(int(good[j]) != states[j] for j in tree.text)
        n += len(tree.text)
    assert n > 1500 and wrong < 0.01 * n


@pytest.mark.parametrize("page", ["<div><p>a b</p><p>c<a>d</a></p></div>e", "x", "<ul><li>a<li>b</ul><nav>c</nav>"])
def test_beliefs_are_sums_over_all_states(page):
    draw, model, kinds = np.random.default_rng(4), main_text.Model(), main_text.Kinds()
    model.own[:], model.pair[:] = draw.normal(size=model.own.shape), draw.normal(size=model.pair.shape)
    forest = main_text.Forest([main_text.Tree(page, kinds), main_text.Tree("<p>q", kinds)], kinds)
    n = len(forest.parent)
    own = np.bincount(forest.node, model.own[forest.feature], minlength=n)
    single, joint, total = np.zeros((n, 2)), np.zeros((n, 2, 2)), 0.0
    for s in itertools.product((0, 1), repeat=n):
        weight = np.exp(sum(own[i] * s[i] + (model.pair[forest.group[i], s[p], s[i]] if p >= 0 else 0) for i, p in enumerate(forest.parent)))
        total += weight
        for i, p in enumerate(forest.parent):
            single[i, s[i]] += weight
            if p >= 0:
                joint[i, s[p], s[i]] += weight
    found = model.beliefs(forest)
    assert np.allclose(found[0], single / total) and np.allclose(found[1], joint / total)


def test_slopes_by_differences():
    draw, model, kinds = np.random.default_rng(5), main_text.Model(), main_text.Kinds()
    model.own[:], model.pair[:] = draw.normal(size=model.own.shape), draw.normal(size=model.pair.shape)
    forest = main_text.Forest([main_text.Tree("<div class=x><p>a</p><p>b</div><nav>c", kinds)], kinds)
    states, n = np.arange(len(forest.parent)) % 2, len(forest.parent)

    def likelihood():
        own = np.bincount(forest.node, model.own[forest.feature], minlength=n)
        value = lambda s: sum(own[i] * s[i] + (model.pair[forest.group[i], s[p], s[i]] if p >= 0 else 0) for i, p in enumerate(forest.parent))
        return value(states) - np.log(sum(np.exp(value(s)) for s in itertools.product((0, 1), repeat=n)))

    slopes = model.slope(forest, states)
    for weights, slope in zip((model.own, model.pair), slopes):
        for at in [np.unravel_index(i, slope.shape) for i in np.flatnonzero(slope)[:25]]:
            old, step = weights[at], 1e-5
            weights[at] = old + step
            above = likelihood()
            weights[at] = old - step
            assert abs((above - likelihood()) / (2 * step) - slope[at]) < 1e-5
            weights[at] = old


def test_odd_pages(spark, model):
    rows = [
        (1, None, None, ""), (2, "u", "", ""), (None, "u", "<article><p>a&nbsp;b &amp;amp; &#99;&#x64;\n e</p>f<br>g<b>h</b>i</article>", "a b &amp; cd e f ghi"),
        (3, "u", "<article><p>one<p>two <b>three<p>four</article><footer>no", "one two three four"),
        (4, "u", "<article><h1>t</h1><script>var a='</p>'</script><style>p{}</style><p>s</p><form><label>no</label></form><nav><a href=x>no</a></nav><textarea>no</textarea></article>", "t s"),
        (5, "u", "<article><p>kept</p><p>lost <a href=", "kept lost"), (6, "u", "<!-- <article>no</article> --><article>yes &#99999999999999999999; &notaref &copy</article>", "yes � ¬aref ©"),
        (6, "u", "<!-- <article>no</article> --><article>yes &#99999999999999999999; &notaref &copy</article>", "yes � ¬aref ©"), (7, "u", "<nav>only</nav>", ""),
    ]
    df = spark.createDataFrame([(*r[:3], "x", "y") for r in rows], "page_id long, url string, html string, text string, _html string").repartition(2)
    out = main_text.extracted(df, model)
    assert out.columns == ["page_id", "url", "text"]
    assert sorted(out.collect(), key=str) == sorted([(r[0], r[1], r[3]) for r in rows], key=str)
    none = df.filter("false")
    assert main_text.extracted(none).count() == 0
    plain = df.filter("page_id = 7").withColumn("html", F.lit("<nav><a href=a>go</a></nav><div class=content><p>The words of it stand here, all of them.</p></div><div class=ad>Buy it now.</div>"))
    assert main_text.extracted(plain).first().text == "The words of it stand here, all of them."


HOSTILE = {"open": "<a ", "quoted": '<a b="c ', "single": "<a '", "nested": "<div>", "named": "<p class=x{}>", "comment": "<!-- ", "closing": "<div></p></x>", "title": "<title>", "references": "&#x", "equals": "<a =", "lists": "<li><ul>", "less": "< ", "ends": "</a"}


@pytest.mark.parametrize("name", HOSTILE)
def test_a_megabyte_of_hostile_markup(name, model):
    one = HOSTILE[name]
    page = "<article>a</article>" + "".join(one.format(i) for i in range(1_000_000 // len(one)))
    began = time.process_time()
    found = list(markup.tokens(page))
    assert time.process_time() - began < 3 and found[1][2] == "a"
    began = time.process_time()
    assert main_text.main_texts(model, [page])[0][:1] in ("a", "")
    assert time.process_time() - began < 60


def test_attributes():
    assert markup.attributes(""" A=1 b='x "y"' c="&lt;z" d e = f a=2 g='' h=i/j """) == {"a": "1", "b": 'x "y"', "c": "<z", "d": "", "e": "f", "g": "", "h": "i/j"}
