import itertools
import random

from pyspark.sql import types as T

from objtrail.llm.html_text import extract, outline, page_text, parse, simple_tree_matching


def text(page, *refs):
    return " | ".join(extract(page, [outline(parse(r)) for r in refs]))


def test_blocks_entities_and_white_space():
    page = "<html><head><title>T</title></head><body><article><h1>A &amp;&nbsp;b</h1><p>one<b> two</b>\n\t three<p>f&ouml;ur<br>five &lt;x&gt;</article></body>"
    assert text(page) == "A & b | one two three | föur five <x>"


def test_what_is_not_the_article():
    page = """<body><header><p>head</p></header><nav><a href=/>menu</a></nav><main><article><p>text</p><aside>side</aside>
<div class="ad">buy</div><form><p>mail</p></form><script>var a = "</p><p>no";</script><style>p{}</style><!-- <p>no</p> -->
<section id="comments"><p>first!</p></section><footer>by me</footer><p>more</p></article></main><div class="cookie-notice">ok?</div><footer>(c)</footer>"""
    assert text(page) == "text | more"


def test_broken_markup():
    assert text("<article><p><b>one<p>two</i></b> three<div>four") == "one | two three | four"
    assert text("<article>a < b <p>c</article") == "a < b | c"
    assert text("<article><ul><li>x<li>y</ul>z") == "x | y | z"
    assert text("plain") == "plain"
    assert text("") == ""
    assert text("<p>" * 3000 + "deep") == "deep"
    assert text("<div>" * 3000 + "deep") == "deep"


def page(title, body, links):
    return f"<html><body><div><ul><li><a href=/a>Home</a></li><li><a href=/b>{links}</a></li></ul></div><div><p>Welcome to us</p></div><div><h1>{title}</h1><p>{body}</p></div><div><p>All rights reserved</p></div></body></html>"


def test_constant_blocks_are_template():
    a, b, c = page("One", "first text", "x"), page("Two", "second text", "y"), page("Three", "third text", "z")
    assert text(a, b, c) == "One | first text"


def test_shared_sentences_of_articles_are_content():
    make = lambda x: f"<body><article><h1>{x}</h1><p>Same words.</p><p>{x} more</p><div class='box'>Read on here</div></article></body>"
    assert text(make("A"), make("B"), make("C")) == "A | Same words. | A more"


def test_copies_stay_whole():
    a = page("One", "first text", "x")
    assert text(a, a) == "Welcome to us | One | first text | All rights reserved"


def test_frames(spark):
    schema = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("url", T.StringType()), ("html", T.StringType()), ("host", T.LongType()))])
    rows = [(i, f"http://h.example/{i}", page(f"T{i}", f"body {i}", f"l{i}"), 1) for i in range(5)]
    rows += [(10, None, "<p>x</p>", 1), (11, "odd", None, 1), (12, "http://other/", "", 1), (12, "http://other/", "", 1)]
    got = sorted((r.page_id, r.text) for r in page_text(spark.createDataFrame(rows, schema)).collect())
    assert got == [(i, f"T{i} body {i}") for i in range(5)] + [(10, "x"), (11, ""), (12, ""), (12, "")]
    assert page_text(spark.createDataFrame([], schema)).collect() == []


def pages_of(spark, bodies):
    rows = [(i, f"http://h.example/{i}", b) for i, b in enumerate(bodies)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in page_text(frame).collect()}


def test_blocks_of_most_pages_are_template(spark):
    bar = "<div id=x><p>Today only</p></div>"
    make = lambda i: f"<body>{bar if i % 3 else ''}<div class=s{i % 2}><p>Section {i % 2}</p></div><div><h1>T{i}</h1><p>body {i}</p></div></body>"
    assert pages_of(spark, [make(i) for i in range(24)]) == {i: f"T{i} body {i}" for i in range(24)}


def test_references_lose_what_other_pages_lose(spark):
    make = lambda i: f"<body><article><h1>T{i}</h1><div class=box>Read on here</div></article></body>"
    assert pages_of(spark, [make(i) for i in range(12)]) == {i: f"T{i}" for i in range(12)}


def test_deep_pages_with_references(spark):
    assert pages_of(spark, ["<div>" * 3000 + f"deep {i}" for i in range(3)]) == {i: f"deep {i}" for i in range(3)}


def test_short_articles_are_no_copies():
    make = lambda i: "<body>" + "".join(f"<div id=b{k}><p>Boiler {k}</p></div>" for k in range(4)) + f"<div><h1>T{i}</h1><p>a {i}</p><p>b {i}</p></div></body>"
    assert text(make(0), make(1), make(2)) == "T0 | a 0 | b 0"


def test_prose_on_most_pages_of_a_host_goes(spark):
    make = lambda i: f"<body><article><h1>T{i}</h1><p>Subscribe to us</p><p>body {i}</p><p>{'few' if i < 4 else i}</p></article></body>"
    assert pages_of(spark, [make(i) for i in range(14)]) == {i: f"T{i} body {i} {'few' if i < 4 else i}" for i in range(14)}


def test_names_are_weak_votes():
    sections = "".join(f"<section id='{x}'><p>{x} text</p></section>" for x in ("results", "discussion", "related-work", "search"))
    assert text(f"<article>{sections}</article>") == "results text | discussion text | related-work text | search text"
    assert text("<div class='content-sidebar-wrap'><article><p>kept</p></article><div class='sidebar'>gone</div></div>") == "kept"
    assert text("<form id='page'><div class=widget><article><p>kept</p></article></div></form>") == "kept"
    assert text("<div class='widget'><p>most of the text stands here</p></div><div class='cookie-bar'>ok?</div>") == "most of the text stands here"
    assert text("<div class=story><p><a href=/x>A sentence that is a link</a></p><ul><li><a href=/>menu</a></li></ul></div>") == "A sentence that is a link"


def test_deep_pages_with_a_reference():
    for tag in ("div", "b", "span", "section"):
        deep = lambda word: f"<{tag}>" * 5000 + word  # noqa: E731, B023
        assert text(deep("own"), deep("other"), deep("third")) == "own"


def slow_matching(a, b):
    """The definition, by trying all order-preserving choices of child pairs."""
    if a[0] != b[0]:
        return 0
    best = 0
    for k in range(min(len(a[1]), len(b[1])) + 1):
        for left in itertools.combinations(a[1], k):
            for right in itertools.combinations(b[1], k):
                scores = [slow_matching(x, y) for x, y in zip(left, right, strict=True)]
                if all(scores):
                    best = max(best, sum(scores))
    return best + 1


def random_tree(rng, depth):
    return (rng.choice("ab"), [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 3 if depth else 0))])


def flat(tree):
    labels, parents, todo = [], [], [(tree, -1)]
    while todo:
        (label, children), parent = todo.pop()
        labels.append(label)
        parents.append(parent)
        todo += [(c, len(labels) - 1) for c in reversed(children)]
    return labels, parents


def test_simple_tree_matching_by_brute_force():
    rng = random.Random(11)
    for _ in range(300):
        a, b = random_tree(rng, 3), random_tree(rng, 3)
        (labels_a, up_a), (labels_b, up_b) = x, y = flat(a), flat(b)
        score, pairs = simple_tree_matching(x, y)
        assert score == slow_matching(a, b)
        assert len(pairs) == score
        matched = dict(pairs)
        assert all(labels_a[i] == labels_b[j] for i, j in pairs)
        assert all(matched[up_a[i]] == up_b[j] for i, j in pairs if i)
        ordered = [j for _, j in sorted(pairs)]
        assert len(set(ordered)) == len(ordered) and ordered == sorted(ordered)


def test_wide_pages_stand_at_their_paths(spark, monkeypatch):
    make = lambda i: "<body>" + "".join(f"<div class={'abcdefghij'[k % 10] * (k // 10 + 1)}><p>part {k}</p></div>" for k in range(300)) + f"<div class=own><p>body {i}</p></div></body>"
    assert pages_of(spark, [make(i) for i in range(4)]) == {i: f"body {i}" for i in range(4)}
    monkeypatch.setattr("objtrail.llm.html_text.PAIRS", 10)
    a, b = outline(parse(make(0))), outline(parse(make(1)))
    assert simple_tree_matching((a.labels, a.parents), (b.labels, b.parents)) is None


def test_alignment_decides_inside_articles(spark):
    """Constant slots of an article are template, though its kind and names say nothing."""
    make = lambda i: f"<body><article><h1>T{i}</h1><section><p>Read our paper every day</p></section><p>body {i}</p><p>{'shared' if i < 2 else i}</p></article></body>"
    got = pages_of(spark, [make(i) for i in range(6)])
    assert got == {i: f"T{i} body {i} {'shared' if i < 2 else i}" for i in range(6)}
    assert text(make(0)) == "T0 | Read our paper every day | body 0 | shared"
    # the same words at another place are content
    odd = make(6).replace("<p>body 6</p>", "<p>body 6</p><blockquote>Read our paper every day</blockquote>")
    assert pages_of(spark, [*(make(i) for i in range(6)), odd])[6] == "T6 body 6 Read our paper every day 6"


def test_versions_of_one_article_count_once(spark):
    make = lambda i: f"<title>News</title><body><article><h1>One story</h1><p>first part</p><p>second part</p><p>version {i}</p></article></body>"
    assert pages_of(spark, [make(i) for i in range(8)]) == {i: f"One story first part second part version {i}" for i in range(8)}


def test_several_layouts_of_a_host(spark):
    story = lambda i: f"<body><div id=top><p>Our site</p></div><div class=story><h1>S{i}</h1><p>story {i}</p></div></body>"
    gallery = lambda i: f"<body><div class=frame><table><tr><td>Our site</td></tr></table><h2>G{i}</h2><div><p>picture {i}</p></div></div></body>"
    bodies = [story(i) if i % 2 else gallery(i) for i in range(12)]
    assert pages_of(spark, bodies) == {i: f"S{i} story {i}" if i % 2 else f"G{i} picture {i}" for i in range(12)}
