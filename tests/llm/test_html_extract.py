import html
import os
import random
import re
import time

import numpy as np
import pytest

from quillstream.llm import html_extract as H
from quillstream.llm import queries as Q

SF = "/root/testdata/sf0.001"


def extract(page):
    return H.extract_texts([page], H.trained(), H.Paths())[0]


def test_leaf_blocks_of_broken_html():
    paths = H.Paths()
    page = '<div>a<b>b</b>c<p>one<p>two</div></span>x &lt;y&gt; 1 < 2<!-- <p>no --><ul><li>i<li>j</ul><script>var t="</p>";</script><a href="q>r">L</a>'
    assert [b[1] for b in H.leaf_blocks(page, paths)] == ["abc", "one", "two", "x <y> 1 < 2", "i", "j", "L"]
    H.leaf_blocks("<div>" * 20_000 + "x" + "</p></i></div>" * 20_000, H.Paths())
    H.leaf_blocks("<a b=\"" * 2000, H.Paths())


def test_held_out_labelled_pages():
    rng, paths, both, said, true = random.Random(5), H.Paths(), 0, 0, 0
    for _ in range(200):
        blocks, labels = H.labelled_blocks(H.labelled_page(rng), paths)
        if blocks:
            found, labels = H.trained().best(H.block_features(blocks, paths), np.array([len(blocks)])), np.array(labels)
            both, said, true = both + (found & labels).sum(), said + found.sum(), true + labels.sum()
    assert 2 * both / (said + true) > 0.99


TITLE, PARTS = "New bridge approved", ["The council approved the bridge on Monday, after two years of debate.", "Work will begin in spring. It should last eighteen months, the mayor said.", "The cost is put at twelve million."]
STORY = f"<h1>{TITLE}</h1>" + "".join(f"<p>{x}</p>" for x in PARTS)
TEXT = " ".join([TITLE, *PARTS])
BRIEF = "<h1>Neue Brücke genehmigt</h1><p>Der Rat hat am Montag die Brücke genehmigt, nach zwei Jahren Streit.</p><p>Die Arbeiten beginnen im Frühjahr. Sie dauern achtzehn Monate.</p>"
BRIEF_TEXT = "Neue Brücke genehmigt Der Rat hat am Montag die Brücke genehmigt, nach zwei Jahren Streit. Die Arbeiten beginnen im Frühjahr. Sie dauern achtzehn Monate."
#: Pages written by hand, of layouts that the generator does not make.
LAYOUTS = {
    "no names": (f"<div><a href=/>Home</a> | <a href=/n>News</a></div><div>{STORY}</div><div>Copyright 2024 The Paper. All rights reserved.</div>", TEXT),
    "german": (f'<div class="kopf"><a href="/">Start</a> <a href="/p">Politik</a></div><div class="inhalt">{BRIEF}</div><div class="fuss"><a href=/i>Impressum</a> <a href=/d>Datenschutz</a> <a href=/k>Kontakt</a></div>', BRIEF_TEXT),
    "german without links": (f'<div class="kopf">Tagblatt</div><div class="inhalt">{BRIEF}</div><div class="fuss">Impressum Datenschutz Kontakt</div>', BRIEF_TEXT),
    "french": ('<div id="entete"><a href="/">Accueil</a> <a href="/a">Actualités</a></div><div id="texte"><h1>Nouveau pont</h1><p>Le conseil a voté la construction du pont lundi soir, après deux ans de débat.</p><p>Les travaux dureront dix-huit mois.</p></div><div id="pied">Mentions légales · Tous droits réservés</div>', "Nouveau pont Le conseil a voté la construction du pont lundi soir, après deux ans de débat. Les travaux dureront dix-huit mois."),
    "title in its own header": (f"<article><header><h1>{TITLE}</h1></header>{STORY[len(TITLE) + 9:]}</article><footer>x</footer>", TEXT),
    "all in the body": (f"<ul><li><a href=/>Home</a></li><li><a href=/s>Sport</a></li></ul>{STORY}<p>&copy; 2024 The Paper</p>", TEXT),
    "table": (f"<table><tr><td><a href=/>Home</a><br><a href=/a>About us</a><br><a href=/c>Contact</a></td><td>{STORY}</td></tr><tr><td colspan=2>All rights reserved</td></tr></table>", TEXT),
    "grid": (f'<div class="r1"><div class="c3"><a href=/>The Paper</a></div><div class="c9"><a href=/w>World</a><a href=/s>Sport</a></div></div><div class="r2"><div class="c8">{STORY}</div><div class="c4"><h3>Most read</h3><ul><li><a href=/1>Storm hits coast</a></li><li><a href=/2>Team wins again</a></li></ul></div></div><div class="r3">Terms | Privacy | Contact</div>', TEXT),
    "misleading": (f'<div class="content"><a href=/>Home</a> <a href=/n>News</a></div><div class="wrapper"><div class="c">{STORY}</div></div><div class="text">Copyright 2024 The Paper. All rights reserved.</div>', TEXT),
    "remarks": (f'<main><article>{STORY}</article><section id="comments"><h2>3 comments</h2><p>I think so too.</p><p>Nonsense, it costs too much.</p></section></main>', TEXT),
    "lists": ("<div><a href=/>Home</a> · <a href=/r>Recipes</a></div><div><h2>Bread</h2><p>Mix the flour with water, salt and yeast, and wait for an hour.</p><ul><li>500 g flour</li><li>300 g water</li></ul><p>Bake it for forty minutes.</p></div><div>Privacy policy · Terms of use</div>", "Bread Mix the flour with water, salt and yeast, and wait for an hour. 500 g flour 300 g water Bake it for forty minutes."),
    "text in divs": (f"<div id=a><a href=/>Home</a> | <a href=/x>Sign in</a></div><div id=b><div>{TITLE}</div>{''.join(f'<div>{x}</div>' for x in PARTS)}</div><div id=c>Copyright 2023 X Media</div>", TEXT),
    "menu after the text": (f'<div class="m">{STORY}</div><div class="n"><ul><li><a href=/>Start</a></li><li><a href=/p>Politik</a></li><li><a href=/s>Sport</a></li></ul></div><p>Impressum · Datenschutz</p>', TEXT),
    "one paragraph": ("<div><a href=/>Home</a> / <a href=/b>Blog</a></div><div><h1>Hello</h1><p>This is the first entry of my new diary, and there is not much to say yet.</p></div><div>© 2020 me</div>", "Hello This is the first entry of my new diary, and there is not much to say yet."),
    "links inside the text": (f"<nav><a href=/>Home</a></nav><div><h1>{TITLE}</h1><p>{PARTS[0][:20]} <a href=/c>{PARTS[0][21:]}</a></p><p>{PARTS[1]}</p><p>{PARTS[2]}</p></div><div><a href=/a>About</a> <a href=/t>Terms</a></div>", TEXT),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts_written_by_hand(name):
    page, want = LAYOUTS[name]
    assert extract(f"<!DOCTYPE html><html><head><title>x</title></head><body>{page}</body></html>") == want


def test_layouts():
    page = """<body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div id="cookie-banner">We use cookies.</div>
    <main><article><h1>Title &amp; more</h1><p>First   paragraph, with <i>in</i>line.</p><aside class="related">Also: <a href=x>this</a></aside>
    <p>Second paragraph of the text.</p></article><section class="comments"><p>I think so too.</p></section></main>
    <form><label>Mail</label><input></form><footer>&copy; me</footer></body>"""
    assert extract(page) == "Title & more First paragraph, with inline. Second paragraph of the text."
    assert extract(None) == "" and extract("") == "" and extract("<script>x</script>") == ""


def test_frame_edges(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (3, "u", "<article><h1>T</h1><p>Some text here.</p></article>"), (3, "u", "<article><h1>T</h1><p>Some text here.</p></article>")], "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = sorted(map(tuple, H.extract_main_text(pages).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (None, "u", "", 0), *[(3, "u", "T Some text here.", 17)] * 2], key=str)
    assert H.extract_main_text(pages.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pages_table(spark):
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in Q.op9_html_extract(spark, SF).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?[bi]>", "", re.sub(r"<(?!/?[bi]>)[^>]*>", " ", inner))).split())
        assert r.text == want and r.n_chars == len(want)


def test_attributes_of_any_length_and_open_quotes():
    article = "<article><h1>Title of it</h1><p>A paragraph of text, with words.</p></article>"
    want = "Title of it A paragraph of text, with words."
    assert extract(f'<div data-x="{"a > b " * 900}">{article}</div>') == want
    assert extract(f"<div data-x='{'a > b ' * 30_000}'>{article}</div>") == want
    assert extract(article.replace("<p>", '<p title="it>')) == want  # a quote that never closes
    assert extract(article + "<form><select><option>A<option>B</select></form><datalist><option>C<option>D</datalist>") == want
    assert extract(article.replace("<p>", "<svg/><p>")) == want
    assert extract(article.replace("<p>", "<select><p>")) == want  # no end tag anywhere
    assert extract("<title>t</title>" + article + "<textarea>never ended " + article) == want


@pytest.mark.parametrize("part", ['<a b=">"', "<a b='>\"", '<a "', "<a ", "<a b=\">' ", "<!x ", "<script ", "<select>", "<svg>x", "<!-- ", '<p title="a>b" c=\'">'])
def test_time_stays_linear(part):
    begun = time.time()
    H.leaf_blocks(part * (1_000_000 // len(part)), H.Paths())
    assert time.time() - begun < 20


def test_clashing_and_repeated_rows_with_extra_columns(spark):
    page = "<article><h1>T</h1><p>Some text here.</p></article>"
    pages = spark.createDataFrame([(1, "u", page, 3, "x")] * 2, "page_id long, url string, html string, text int, doc_id string")
    assert [tuple(r) for r in H.extract_main_text(pages).collect()] == [(1, "u", "T Some text here.", 17)] * 2
