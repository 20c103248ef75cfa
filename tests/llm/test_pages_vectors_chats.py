import random

import numpy as np
import pytest

from marketgrid.llm import chat, site_style, topk

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><a>Home</a></header><nav><ul><li>Menu {0}</ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>gone</p> -->
<article class="post"><h1>Title&nbsp;{0} &amp; more</h1><p>First {0}
  line<br>two <b>bold<p>Second &lt;{0}&gt; para<ul><li>one<li>two</ul><form><p>Sign up</p></form>
<div class="adventure">kept {0}</div><section id="comments"><p>Nice post!</p></section><div hidden>no</div></article>
<aside>Side</aside><div class="sidebar"><p>Links</p></div><footer>&copy; {0}</footer></body></html>"""
TEXT = "Title {0} & more\nFirst {0} line two bold\nSecond <{0}> para\none\ntwo\nkept {0}"


def test_extraction(spark):
    rows = [(k, f"https://a.example/{k}", PAGE.format(f"w{k}")) for k in range(8)] + [(8, None, None), (9, "x", ""), (10, "http://b.example", "plain <b>text</b>")]
    rows.append(rows[0])
    template = "<body><div class=x><p>Same words on each page</p></div><p>Own text number {}</p></body>"
    rows += [(20 + k, f"https://c.example/{k}", template.format(k)) for k in range(6)]
    rows += [(30 + k, f"https://d.example/{k}", "<article><p>A copied article</p></article>") for k in range(4)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    out = site_style.extract(frame).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows)
    for k in range(8):
        assert got[k] == TEXT.format(f"w{k}")
    assert got[8] == "" and got[9] == "" and got[10] == "plain text"
    assert [got[20 + k] for k in range(6)] == [f"Own text number {k}" for k in range(6)]
    assert all(got[30 + k] == "A copied article" for k in range(4))
    assert all(r.n_chars == len(r.text) for r in out)
    assert site_style.extract(frame.limit(0)).count() == 0


def test_boilerplate_inside_articles(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(f"word{rng.randrange(9999)}" for _ in range(n))
    box = '<div class="author-box"><h3>About us</h3><p>The same words under each article of this site</p></div>'
    page = "<html><body><article><h1>{}</h1><p>{}</p><p>{}</p><h2>Summary</h2><p>{}</p>{}</article></body></html>"
    own = [(say(5), say(40), say(20), say(8)) for _ in range(6)]
    rows = [(k, f"https://a.example/{k}", page.format(*x, box)) for k, x in enumerate(own)]
    # Edited copies on a host of their own: nothing of the article is a template.
    copies = [(*own[0][:2], say(20), own[0][3]) for _ in range(4)]
    rows += [(10 + k, f"https://b.example/{k}", page.format(*x, "")) for k, x in enumerate(copies)]
    got = {r.page_id: r.text for r in site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = lambda x: "\n".join([*x[:3], "Summary", x[3]])
    assert [got[k] for k in range(6)] == [whole(x) for x in own]
    assert [got[10 + k] for k in range(4)] == [whole(x) for x in copies]


def test_the_tree_decides_where_a_site_repeats_itself(spark, monkeypatch):
    """Without the tree's low nodes most pages of these sites would be other texts."""
    rng = random.Random(8)
    say = lambda n: " ".join(f"word{rng.randrange(9999)}" for _ in range(n))
    rows = []
    for site in range(4):
        top, box = say(12), f'<div class="k{site}"><p>{say(9)}</p><p>{say(7)}</p></div>'
        for k in range(10):
            article = f"<article><h1>{say(4)}</h1><p>{say(30)}</p><p>{say(20)}</p>{box}</article>"
            rows.append((len(rows), f"https://s{site}.example/{k}", f'<body><div class="q{site}"><p>{top}</p></div>{article}<div class="z"><p>{say(12)}</p></div></body>'))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in site_style.extract(frame).collect()}
    changed = sum(got[k] != site_style.Page(source).text() for k, _, source in rows)
    assert changed == len(rows)
    assert all(len(got[k].split("\n")) == 4 for k, _, _ in rows)  # heading, two paragraphs, and the block beside the article


def test_importance_equals_brute_force(spark):
    import math
    from collections import defaultdict

    rng = random.Random(3)
    pages = []
    for k in range(30):
        body = "".join(f"<{rng.choice(['p', 'div', 'ul'])}>{rng.choice(['a', 'b', 'c', f'own {k}'])}" for _ in range(rng.randrange(1, 6)))
        pages.append((k, f"http://h{k % 3}.example/{k}", f"<body><div>{body}</div><p>{'x' if k % 3 else f'y{k}'}</p></body>"))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    low = {(r.host, r.path) for r in site_style.low_nodes(site_style.style_nodes(frame, "url", "html")).collect()}
    seen, contents, shapes = defaultdict(set), defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))
    for _, url, source in pages:
        page, host = site_style.Page(source), site_style.host_of(url)
        name = tuple((page.keys[b[0]], b[1]) for b in page.blocks)
        for node in {b[0] for b in page.blocks} | set(page.children):
            seen[host, page.keys[node]].add(name)
        for b in page.blocks:
            contents[host, page.keys[b[0]]][b[1]].add(name)
        for node, names in page.children.items():
            shapes[host, page.keys[node]][tuple(names)].add(name)
    score = {}
    for key, of in contents.items():
        n = len(seen[key])
        counts, forms = [len(x) for x in of.values()], [len(x) for x in shapes[key].values()]
        content = 1 if n <= 1 else 1 - sum(map(math.log, counts)) / len(counts) / math.log(n)
        total = sum(forms)
        structure = 1 if n <= 1 else -sum(f / total * math.log(f / total) for f in forms) / math.log(n) if forms else 0
        width = sum(len(set(names)) for names in shapes[key]) / len(forms) if forms else 0
        score[key] = (1 - site_style.GAMMA**width) * structure + site_style.GAMMA**width * content
    want = {key for key, x in score.items() if x < site_style.LEAST_SHARE * max(y for k, y in score.items() if k[0] == key[0])}
    assert want and low == want


def test_hostile_pages_take_linear_time_and_names_that_only_look_like_noise_stay():
    import time

    for source in (
        '<a "x ' * 160_000, '<a x="y ' * 120_000, "<div>" * 200_000, "<div>" * 16_000 + "<li>x</li>" * 90_000, "<title>" * 140_000,
        "<p " + "a" * 1_000_000 + ">", '<a x="b>' * 120_000 + '"', "<div>" * 50_000 + "</section>" * 80_000, "<!-- " * 200_000,
    ):
        began = time.perf_counter()
        site_style.Page(source).text({1})
        assert time.perf_counter() - began < 10
    source = (
        "<div id='form-of-government'><p>Alpha</div><p title=don't>Beta</p><div class='search-results-of-study'>Gamma</div><article><p>Delta</article>"
        "<div class='related-posts'>No</div><div id='adSlot3'>No</div><ul class='nav nav-bar'><li>No</ul><div class='post-related-to-ads'>Tail"
    )
    assert site_style.Page(source).text() == "Alpha\nBeta\nGamma\nDelta\nTail"


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 90)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(400, 12)) * rng.random((400, 1))
    vectors[30:200] = vectors[30]  # a third of the rows are equal
    rows = [(k, [float(np.float32(x)) for x in v], 0) for k, v in enumerate(vectors)]
    rows += [(1000, None, 0), (1001, [1.0] * 11 + [float("nan")], 0), (1050, [1.0] * 11 + [float("inf")], 0), (1002, [None] * 12, 0), (None, [0.0] * 12, 0), (1100, [], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(frame).collect()}
    whole = np.floor(256 * np.array([v for _, v, _ in rows[:400]], np.float32).astype(float)).astype(int)
    for q in range(0, 400, 50):
        scores = whole @ whole[q]
        order = sorted((k for k in range(400) if k != q), key=lambda k: (-scores[k], k))[:5]
        assert [got[q, j + 1] for j in range(5)] == [(k, scores[k]) for k in order]
    assert len(got) == 40
    assert topk.search(frame.limit(0)).count() == 0


def test_topk_of_repeated_rows_and_wide_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 4)
    rows = [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (4, [3.0, 1.0]), (13, [0.5, 0.1]), (19, [3.0, 1.0]), (100, [3e38, -1e38]), (7, [3e38, 3e38]), (8, [-3e38, 1.0]), (21, [5000.0, -4096.0]), (22, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [int(x) * 256 if abs(x) > 2**50 else int(np.floor(256 * x)) for x in v]) for i, v in rows]
    top, want = 2**63 - 1, []
    for a, (query, v) in enumerate(whole):
        if query % 50 == 0:
            scores = [(-sum(x * y for x, y in zip(v, w)), i) for b, (i, w) in enumerate(whole) if a != b and len(v) == len(w)]
            want += [(query, k + 1, i, max(-top - 1, min(top, -s))) for k, (s, i) in enumerate(sorted(scores)[:3])]
    got = [tuple(r) for r in topk.search(frame, k=3).collect()]
    assert sorted(got) == sorted(want) and len(got) == 9


def test_reply_order_equals_a_walk_of_the_tree(spark):
    rng, rows, parents = random.Random(6), [], {}
    for conv in range(3):
        said = []
        for turn in range(40):
            own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(6)) + "."
            quote = rng.choice(said) if said and rng.random() < 0.6 else None
            parents[conv, turn] = quote[0] if quote else turn - 1 if turn else None
            rows.append((conv, turn, "user", (f"> {quote[1]}\n" if quote else "") + own))
            said.append((turn, own))
    got = {(r.conv_id, r.turn): r for r in chat.thread(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: r.reply_to for k, r in got.items()} == parents
    for conv in range(3):
        order = []

        def walk(turn, conv=conv, order=order):
            order.append(turn)
            for child in range(40):
                if parents[conv, child] == turn:
                    walk(child)

        walk(0)
        assert [got[conv, t].position for t in order] == list(range(40))


def test_deeper_quotations_answer_who_quoted_them(spark):
    rows = [
        ("c", 0, "u", "The cat sat on the mat today."), ("c", 1, "a", "Dogs are better than all cats."), ("c", 2, "u", "> The cat sat on the mat today.\nIndeed it did."),
        ("c", 3, "a", "> > The cat sat on the mat today.\nBut why?"), ("c", 4, "a", "> > > The cat sat on the mat today.\n> nothing known here\nWho knows?"),
    ]
    got = {r.turn: r for r in chat.thread(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()}
    assert [got[t].reply_to for t in range(5)] == [None, 0, 0, 2, 3]
    assert [got[t].sources for t in range(5)] == [[], [], [0], [0], [0]] and [got[t].position for t in range(5)] == [0, 1, 2, 3, 4]


def test_quotation_linking(spark):
    rows = [
        (1, 0, "user", "How do I bake bread at home?"), (1, 1, "assistant", "Mix flour and water. Then wait for an hour."),
        (1, 2, "user", "> Mix flour and  water.\n> Then wait for an HOUR.\nHow much water?"),
        (1, 3, "user", "On Monday X wrote:\n> > Mix flour and water.\n> How do I bake bread at home?\nI meant rye bread."),
        (2, 0, "user", "> Nobody said these words\nHello"), (2, 5, "user", None), (None, 1, "user", "> x\nlost"), (3, None, "user", "no turn"),
    ]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, position int")
    got = {(r.conv_id, r.turn): r for r in chat.thread(frame).collect()}
    assert len(got) == len(rows)
    assert got[1, 2].text == "How much water?" and got[1, 2].reply_to == 1 and got[1, 2].by_quote
    assert got[1, 3].text == "I meant rye bread." and got[1, 3].reply_to == 0 and got[1, 3].depth == 2
    assert got[1, 0].reply_to is None and got[1, 1].reply_to == 0 and [got[1, t].position for t in range(4)] == [0, 1, 2, 3]
    assert got[2, 0].text == "Hello" and not got[2, 0].by_quote and got[2, 5].reply_to == 0 and got[2, 5].text == ""
    assert got[None, 1].text == "lost" and got[None, 1].position is None and got[3, None].reply_to is None
    assert chat.thread(frame.limit(0)).count() == 0


def test_numbering_spans_ranges(spark):
    rng = random.Random(1)
    turns = rng.sample(range(5000), 900)
    frame = spark.createDataFrame([(7, t, "user", f"message {t}") for t in turns], "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.position, r.reply_to) for r in chat.thread(frame).collect()}
    order = sorted(turns)
    assert got == {t: (k, order[k - 1] if k else None) for k, t in enumerate(order)}


@pytest.mark.parametrize(
    ("source", "text"),
    [
        # "hidden" hides as an attribute, a class or a style of its own, not inside other values.
        ('<article title="the hidden truth"><p>A</p></article>', "A"),
        ('<article data-x="a hidden gem"><p>A</p></article>', "A"),
        ('<article><p>A</p><p hidden>B</p><p class="hidden">C</p><p style="display: none">D</p><p hidden="">E</p></article>', "A"),
        # A form or menu around the article is a wrapper; its fields and a form inside an article go.
        ('<form id="aspnetForm"><nav>N</nav><article><h1>T</h1><p>A</p></article><input><label>l</label></form>', "T\nA"),
        ('<body><form id="aspnetForm"><h1>T</h1><p>A</p><select><option>x</select></form></body>', "T\nA"),
        ("<article><p>A</p><form><p>Name</p><input></form><p>B</p></article>", "A\nB"),
        ('<div id="menu-content"><article><p>A</p></article></div>', "A"),
        ('<div class="menu"><ul><li>M</li></ul></div><article><p>A</p></article>', "A"),
        # Inline noise goes with its text, also where it is never closed; comments stay out though they are articles.
        ('<article><p>A</p><button>Share <b>this</b></button><p>B <span class="advert">Buy <span>now</span></span> C</p></article>', "A\nB C"),
        ("<article><p>A <button>unclosed</p><p>B</p></article>", "A\nB"),
        ('<article><p>A</p></article><div class="comments"><article><p>Comment</p></article></div>', "A"),
        ('<article><p>A <span>b</span> <em class="x">c</em></p></article>', "A b c"),
    ],
)
def test_presentation_rules_on_probes(source, text):
    assert site_style.Page(source).text() == text
