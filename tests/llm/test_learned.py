"""Operators that learn, by their accuracy on what they have not seen."""

import math
import random
import time
from functools import cache
from html.parser import HTMLParser

import zstandard

from diptych.llm import html, langid, toxicity
from diptych.llm.queries import QUERIES


def test_language_of_held_out_documents(spark, folder):
    found = QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 100
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert sum(r.rejected for r in rows) <= 0.02 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_without_letters_or_models(spark):
    rows = [(1, "the and of to"), (2, None), (3, ""), (4, "12 !!"), (5, "x" * 300_000), (5, "x" * 300_000)]
    frame = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, Score string")
    train = spark.createDataFrame([(k, ("the and of to in is that " if k % 2 else "der die das und nicht ein ") * 5, "en" if k % 2 else "de") for k in range(40)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in langid.identify(frame, langid.fit(train)).collect()}
    assert found[1].lang_pred == "en" and not found[1].rejected
    assert all(found[k].lang_pred == "und" and found[k].score == 0 and found[k].rejected for k in (2, 3, 4))
    assert langid.known_language(frame, langid.fit(train)).columns == frame.columns
    none = langid.fit(train.where("false"))
    assert {r.lang_pred for r in langid.identify(frame, none).collect()} == {"und"}


def test_whole_texts_are_encoded(spark):
    """Against a loop over blocks with zstandard's plain interface; a language behind 400 kB of nothing else is still told."""
    rng = random.Random(4)
    make = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    words = {lang: [make(letters) for _ in range(300)] for lang, letters in (("xa", "abcde"), ("xb", "fghij"))}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    train = spark.createDataFrame([(k, text(lang, 200), lang) for k in range(40) for lang in ("xa", "xb")], "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert set(model.languages) == {"xa", "xb"} and len(set(map(len, model.dictionaries))) == 1
    coders, noise = model.coders(), " ".join(make("klmnopq") for _ in range(70_000))
    for lang in ("xa", "xb"):
        assert langid.predict(noise + " " + text(lang, 400), model.languages, coders)[0] == lang
    for n in (1, 5, 60, 3000):
        data = langid.normal(text("xa", n))
        sizes = {}
        for lang, own in zip(model.languages, model.dictionaries, strict=True):
            parameters = zstandard.ZstdCompressionParameters(compression_level=3, min_match=3, strategy=zstandard.STRATEGY_LAZY2, window_log=18, write_content_size=0)
            dictionary = zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[lang] = sum(len(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress(data[k : k + langid.BLOCK_BYTES] + b"0" * 64)) for k in range(0, len(data), langid.BLOCK_BYTES))
        best = min(model.languages, key=sizes.get)
        assert langid.predict(data.decode(), model.languages, coders)[0] == best


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    found = QUERIES["op6_toxicity"](spark, folder)
    truth = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = found.join(truth, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    wins = sum((a.score > b.score) + (a.score == b.score) / 2 for a in toxic for b in clean)
    assert wins / (len(toxic) * len(clean)) > 0.93


def test_folding_and_exceptions():
    model = toxicity.Model({"idiot": 3.0, "clown": 2.0}, {"clown fish": 2.0}, (-3.0, 1.0, 1.0, 1.0))
    match = lambda t: toxicity.features(t, model.automaton())[1]
    plain = match("you idiot here")
    for other in ("you 1d10t here", "YOU IDIOT!! here", "you ïdіоt here", "you id!ot, here", "you ｉｄｉｏｔ here", "you i​diot here", "you !d!0t here", "1d10t"):
        assert match(other) == plain > 0, other
    assert match("a clown fish swims") == 0 and match("a clown swims") > 0
    assert toxicity.folded("$tupid @sshole 8itch a$$hole x 2024 word5") == " stupid asshole bitch asshole x word "
    assert match(None) == match("") == match("idiotic 2024") == 0


def test_signs_at_the_end_of_words():
    """A word and the signs behind it count as the word that they make, if the lexicon has it."""
    model = toxicity.Model({"ass": 3.0, "dumbass": 3.0, "idiot": 2.0}, {}, (-3.0, 1.0, 1.0, 1.0))
    match = lambda t: toxicity.features(t, model.automaton())[1]
    for text in ("you a$$", "dumba55 !", "a dumbas$", "dumba$$, he said", "1d1o7"):
        assert match(text) > 0, text
    for text in ("hello!", "as if", "item5 and b4", "i$ it", "$ 5 %"):
        assert match(text) == 0, text
    # Of an ordinary end nothing changes: neither the matches nor the length.
    assert toxicity.features("you idiot!", model.automaton()) == toxicity.features("you idiot", model.automaton())


def test_letters_are_letters():
    """Numerals and signs of any kind are none; vowel signs stay in their words; languages that tie go to the more frequent one."""
    assert [langid.normal(t) for t in ("½ ²", "① 12", "٣٤", "́", "—", None, "")] == [b""] * 7
    assert langid.normal("A² हिन्दी!") == " a हिन्दी ".encode()
    same = b"the and of to in is that " * 40
    model = langid.Model(("xa", "xb"), (same, same))
    assert langid.predict("the and of to", model.languages, model.coders())[:1] == ("xa",)
    assert langid.predict("½ ① 7", model.languages, model.coders()) == ("und", 0.0, 0.0)


def test_matches_are_those_of_a_plain_scan():
    """The automaton against a search for each word and phrase by itself."""
    rng = random.Random(9)
    words = [rng.choice("abc") * rng.randint(1, 2) + rng.choice("xyz") for _ in range(12)]
    for _ in range(300):
        lexicon = {w: rng.randint(1, 5) / 2 for w in rng.sample(words, 3)}
        exceptions = {f"{rng.choice(words)} {w}": lexicon[w] for w in lexicon}
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
        tokens = text.split()
        total = sum(lexicon.get(w, 0.0) for w in tokens) - sum(exceptions.get(" ".join(tokens[k : k + 2]), 0.0) for k in range(len(tokens)))
        found = toxicity.features(text, toxicity.Model(lexicon, exceptions, ()).automaton())
        assert found == toxicity.measures(f" {text} ", toxicity.Model(lexicon, exceptions, ()).automaton())
        assert found[0] == (total > 0) and abs(math.expm1(found[1]) - max(0.0, total)) < 1e-9


def test_toxicity_without_labels(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = toxicity.score(frame, toxicity.fit(frame, labels)).collect()
    assert all(0 <= r.score < 0.5 and r.predicted == 0 for r in found)


@cache
def _model():
    rng = random.Random(3)
    return html.train([html.labelled(*html.drawn_page(rng)) for _ in range(html.DRAWN_PAGES)])


# Pages and their articles, written and read by hand.
BY_HAND = [
    ("<head><title>x</title><body><p>Lead para text.</p><article><header><h1>T</h1></header><p>Body text.</p></article>", "Lead para text.\nT\nBody text."),
    ("<article><p>One.</p><button>Go<p>Two after button.</p></article>", "One.\nTwo after button."),
    ("<article><p>One is here.</p><select><option>a<option>b<p>Two after select is here.</p></article><footer>&copy; me</footer>", "One is here.\nTwo after select is here."),
    ("<div>" * 100 + "<article>" + "<div>" * 150 + "<p>Deep text is here.</p>", "Deep text is here."),
    ("<article><p>Press <button>Go</button> to go.</p><form><p>Your name</p><input></form></article>", "Press to go."),
    ("<p>Just one paragraph with some words.</p>", "Just one paragraph with some words."),
    ("<article><h1>Title of it</h1><p>Word.</p><p>Yes.</p><h2>Sub</h2><p>A text of some length, which goes on, and on, for a while.</p></article>", "Title of it\nWord.\nYes.\nSub\nA text of some length, which goes on, and on, for a while."),
    (
        """<!DOCTYPE html><html><head><title>x</title></head><body class="post"><header class="site-header"><a href="/">Site</a><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav></header>
<div class="cookie-banner"><p>We use cookies to make this site better. <button>Accept</button></p></div><main><article><header><h1>The big story</h1></header>
<p>First paragraph of the story, with <a href=x>a link</a>.</p><figure><img src=x><figcaption>A picture of a cat.</figcaption></figure><section><h2>Part two</h2><p>Second paragraph.</p><ul><li>One item<li>Two items</ul></section>
<aside><h3>Related</h3><ul><li><a href=1>Other story</a></ul></aside><blockquote>Quoted words.</blockquote></article><section id="comments"><h2>Comments</h2><article class="comment"><p>Nice story, I liked it very much.</p></article></section></main>
<aside class="sidebar"><h3>Popular</h3><p>Read this other thing about dogs.</p></aside><footer><p>&copy; 2024 Site. All rights reserved.</p></footer></body></html>""",
        "The big story\nFirst paragraph of the story, with a link.\nA picture of a cat.\nPart two\nSecond paragraph.\nOne item\nTwo items\nQuoted words.",
    ),
    (
        """<body><div class=menu><a href=1>Start</a> <a href=2>Shop</a></div><div class="post-content"><h1>How to bake bread</h1><p>Take flour &amp; water, and mix them well.</p>
<div class="ad-banner">Buy our flour now, it is cheap.</div><p>Then wait for an hour<br>or two.</p></div><div class=footer>Copyright 2020. All rights reserved.</div>""",
        "How to bake bread\nTake flour & water, and mix them well.\nThen wait for an hour or two.",
    ),
]


_P, _Q = "This is the first paragraph of the story, and it goes on for a while.", "Here is another one. It has two sentences in it."
# Pages of kinds that markup alone misleads on, with their articles.
MISLEADING = [
    (f'<form id="aspnetForm"><div class="content"><h1>Headline</h1><p>{_P}</p><p>{_Q}</p></div></form>', f"Headline\n{_P}\n{_Q}"),
    (f'<body><form id="f1" method=post><input type=hidden name=s><div class="nav"><ul><li><a href=1>Home</a><li><a href=2>About</a></ul></div><input name=q><h1>Headline</h1><p>{_P}</p><p>{_Q}</p><div>Copyright 2024 Foo</div></form>', f"Headline\n{_P}\n{_Q}"),
    (f'<main><h1>Title</h1><p>{_P}</p><form><label>Name</label><input><label>Password</label><input type=password><button>Go</button></form><p>{_Q}</p></main>', f"Title\n{_P}\n{_Q}"),
    (f'<article class="message"><h1>Topic</h1><p>{_P}</p><p>{_Q}</p></article>', f"Topic\n{_P}\n{_Q}"),
    (f'<div class="post has-comments no-sidebar"><h1>Title</h1><p>{_P}</p><p>{_Q}</p></div>', f"Title\n{_P}\n{_Q}"),
    (f"<article><h1>Title</h1><p>{_P}</p><aside><p>Related stuff to read.</p></aside><p>{_Q}</p></article>", f"Title\n{_P}\n{_Q}"),
    (f'<article><h1>Title</h1><aside class="related"><h3>More</h3><p>Another story that you may like.</p></aside><p>{_P}</p></article>', f"Title\n{_P}"),
    (f'<div class="content"><h1>Title</h1><p>{_P}</p><p>{_Q}</p></div><div>Copyright 2024 Foo</div>', f"Title\n{_P}\n{_Q}"),
    (f'<main><h1>Manual</h1><p>{_P}</p><div class="warning">Do not open the case while it is on.</div><p>{_Q}</p></main>', f"Manual\n{_P}\nDo not open the case while it is on.\n{_Q}"),
    (f'<main><article><p>{_P}</p></article><section class="comments"><article class="comment"><p>I do not agree with this at all.</p></article></section></main>', _P),
]


def test_pages_that_markup_alone_misleads_on():
    for page, wanted in MISLEADING:
        assert html.main_text(page, _model()) == wanted


def test_all_of_a_long_page_is_learned_from():
    page = "<article>" + "<p>Some words of it.</p>" * 900 + "</article><footer>Foot of it</footer>"
    features, marks = html.by_structure(page)
    assert len(features) == 901 and marks[-2:] == [True, False]
    parts = html.chains(features, marks)
    assert sum((y for _, y in parts), []) == marks and max(len(f) for f, _ in parts) <= html.CHAIN
    assert not any(f.startswith(("in article", "in main")) or f.endswith("outside") for own in html.without_place(features) for f in own)


def test_pages_by_hand():
    right = wrong = missed = 0
    for page, wanted in BY_HAND:
        found, truth = html.main_text(page, _model()).split("\n"), wanted.split("\n")
        right += len(set(found) & set(truth))
        wrong += len(set(found) - set(truth))
        missed += len(set(truth) - set(found))
    assert wrong == missed == 0 and right > 25


def test_hostile_pages_take_linear_time():
    pages = ["<" + "a" * 10**6, "<a" * 500_000, "<a " * 300_000 + '=">"', "<a x=\"<a y='" * 80_000, "<svg>" * 80_000 + "<p>" + "</svg>" * 80_000, "<div>" * 80_000 + "</p>" * 80_000, "<title>" * 140_000, "<!--" * 250_000, "<![CDATA[" * 110_000, "<div>x" * 100_000, "<div>" * 80_000 + "<li>" * 80_000]
    for page in pages:
        began = time.process_time()
        html.blocks(page)
        assert time.process_time() - began < 10, page[:20]


def test_articles_of_pages_not_seen():
    model, rng = _model(), random.Random(77)
    right = wrong = missed = 0
    for _ in range(150):
        features, marks = html.labelled(*html.drawn_page(rng))
        for said, true in zip(html.decode(model, features), marks, strict=True):
            right += said and true
            wrong += said and not true
            missed += true and not said
    assert right / (right + wrong) > 0.96 and right / (right + missed) > 0.96


def test_markup_that_is_hard_to_read():
    page = """<!DOCTYPE html><title>T</title><nav><a href='/'>Menu</a></nav><script>if (a<b) document.write("<p>no</p>")</script>
    <article><h1>A &amp; B</h1><p>First&nbsp;one <b>bold <i>it</b> x<br>next<p>Second &lt;tag&gt; 1 < 2<!-- <p>no --><ul><li>one<li>two</ul><pre>
    a   b</pre><form><p>no <input value="<p>"></form></article><footer>&copy; F</footer>"""
    texts = [b.text for b in html.blocks(page)]
    assert texts == ["Menu", "A & B", "First one bold it x next", "Second <tag> 1 < 2", "one", "two", "a b", "no", "© F"]
    assert html.blocks(None) == html.blocks("") == html.blocks("<p> </p>") == []
    assert [b.text for b in html.blocks("plain < text")] == ["plain < text"]
    assert html.main_text(None, html.Model()) == ""
    assert len(html.blocks("<div>" * 5000 + "deep")) == 1


def test_viterbi_is_the_best_path():
    rng = random.Random(5)
    for _ in range(100):
        model = html.Model({"a": rng.gauss(0, 2), "b": rng.gauss(0, 2)}, rng.gauss(0, 1), tuple(tuple(rng.gauss(0, 2) for _ in "ab") for _ in "ab"))
        page = [[rng.choice("ab")] for _ in range(6)]

        def value(labels, model=model, page=page):
            out = model.start * labels[0] + sum(model.weights[f[0]] * y for f, y in zip(page, labels, strict=True))
            return out + sum(model.pair[a][b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(([bool(k >> i & 1) for i in range(6)] for k in range(64)), key=value)
        assert html.decode(model, page) == best


class _Articles(HTMLParser):
    """The standard library's reading of a page: texts between the tags of blocks inside article elements."""

    def __init__(self):
        super().__init__()
        self.depth, self.texts, self.open = 0, [], []

    def cut(self):
        if text := " ".join("".join(self.open).split()):
            self.texts.append(text)
        self.open = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.open.append(" ")
        elif tag not in ("b", "i", "a", "em", "strong", "span"):
            self.cut()
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "em", "strong", "span"):
            self.cut()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.open.append(data)


def test_pages_of_the_corpus(spark, folder):
    found = QUERIES["op2_html_extract"](spark, folder).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert len(found) == len(pages)
    for r in found:
        plain = _Articles()
        plain.feed(pages[r.page_id])
        plain.close()
        assert r.text == "\n".join(plain.texts) and r.n_chars == len(r.text)
