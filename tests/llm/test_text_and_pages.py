"""Pieces against the library, pages, language and secrets on small fixtures."""

import random
from collections import Counter

import pytest
from llm_helpers import SCHEMA, awkward, rows
from pyspark.sql import functions as F

from entitle.llm.html_extraction import LEAST_IMPORTANCE, LEAST_PAGES, main_text, noise_branches, page_branches, parse
from entitle.llm.language_id import declared_language, identify, identify_documents, text_model
from entitle.llm.pieces import MODEL, decode, encode, load
from entitle.llm.secret_scan import candidates, scan, with_features

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return load()


def odd_texts():
    draw = random.Random(3)
    kinds = ["a", "b", " ", "  ", "\n", "é", "你", "th", "the", "ing", "0", "1", "▁", "🙂", ".", "tion", "'", "\t", "Ж", "ß", "\x00", "​"]
    out = ["", None, " ", "     ", "a   你", "   你好", "▁▁▁▁  <s> </s> <unk>", "x" * 300, " " * 70 + "a", " " * 33 + "你", "\n\n  \n x"]
    return out + ["".join(draw.choice(kinds) for _ in range(draw.randrange(80))) for _ in range(300)]


def test_pieces_equal_the_library(spark, model):
    from sentencepiece import SentencePieceProcessor
    sp = SentencePieceProcessor(model_file=MODEL)
    texts = odd_texts() + [r[1] for r in awkward(4)]
    tokens = encode(spark.createDataFrame(rows(texts), SCHEMA).repartition(2), "doc_id", model=model)
    got = {r.doc_id: r for r in tokens.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].ids == sp.encode(t or ""), repr(t)
        assert got[i].n_tokens == len(got[i].ids)
    back = {r.doc_id: r.decoded for r in decode(tokens, "doc_id", model=model).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))


def test_pieces_of_words_that_agree_modulo_a_power_of_two(spark, model):
    from sentencepiece import SentencePieceProcessor
    sp = SentencePieceProcessor(model_file=MODEL)
    odd = [bin(i).count("1") % 2 for i in range(1024)]
    texts = ["".join("ab"[x] for x in odd), "".join("ba"[x] for x in odd)]
    got = {r.doc_id: r.ids for r in encode(spark.createDataFrame(rows(texts), SCHEMA).coalesce(1), "doc_id", model=model).collect()}
    assert got == {i: sp.encode(t) for i, t in enumerate(texts)}
    none = encode(spark.createDataFrame([], SCHEMA), "doc_id", model=model)
    assert none.collect() == [] and decode(none, "doc_id", model=model).collect() == []


def test_pieces_of_whole_documents(spark, model):
    from sentencepiece import SentencePieceProcessor
    sp = SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r.doc_id: sp.encode(r.text) for r in docs.collect()}
    assert {r.doc_id: r.ids for r in encode(docs, "doc_id", model=model).collect()} == want


def test_blocks():
    page = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li>Menu</ul></nav>'
            '<div class="cookie-notice">Cookies!</div><article><h1>Head &amp; tail</h1><p>One\n  two<p><b>three<br>four</b>'
            '<div class="ad">Buy</div><aside>See also</aside><form>Name <input></form><ul><li>a<li>b</ul>'
            '<script>if (a < b) { "</p>" }</script><table><tr><td>x<td>y</table><section id="comments"><p>First!</section></article>'
            '<footer>&copy; me</footer></body></html>')
    assert parse(page).texts() == ["Head & tail", "One two", "three four", "a", "b", "x", "y"]
    assert parse('a < b <p>c "<i>d</i>e</p><img src="x>y">f').texts() == ["a < b", 'c "de', "f"]
    assert parse("").texts() == [] and parse("<!-- never closed <p>x").texts() == []


@pytest.mark.parametrize("page,want", [
    ("<article><p>One line</p></article><section id='comments'><p>" + "Reader said. " * 50 + "</p></section>", ["One line"]),
    ("<article><p>One line</p></article><nav><ul>" + "<li>Menu entry" * 90 + "</ul></nav>", ["One line"]),
    ("<main><p>One line</p><div class='comments'><article><p>" + "Reader. " * 50 + "</p></article></div></main>", ["One line"]),
    ("<article><p>First half</p></article><p>And " + "the other half " * 30 + "</p>", ["First half", ("And " + "the other half " * 30).strip()]),
    ("<div class='page has-sidebar'><main><p>Story</p></main><div class='sidebar'>Links</div></div>", ["Story"]),
    ("<div class='has-sidebar'><h1>Title</h1><p>Story</p><div class='ad'>Buy</div></div>", ["Title", "Story"]),
    ("<div class='post'><h1>T</h1><p>S</p></div><section class='comments'><article><p>R</p></article></section>", ["T", "S"])])
def test_no_share_of_the_text_overrules_noise(page, want):
    assert parse(page).texts() == want


@pytest.mark.parametrize("start,end", [("<div>", "</div>"), ("<div>", ""), ("<x-y>", "</z>"), ("<li>", ""), ("<div class='ad'>", "")])
def test_deep_pages_take_linear_time(start, end):
    import time
    n, begin = 100_000, time.monotonic()
    page = parse(start * n + "deep" + end * n + "<p>after</p>")
    assert len(page.branches()) == len(page.elements) and len(page_branches(page)) >= 1
    assert page.texts() in (["deep", "after"], [])
    assert time.monotonic() - begin < 20


def pages(n=30):
    """A site without landmarks: one block is the same on all its pages, and one is a page of its own."""
    out = [(i, f"http://site.example.org/{i}", f"<body><div class='top'>Welcome <b>all</b></div><div class='body'><p>Text {i} of its own</p>"
            f"<p>More {i * 7}</p></div><div class='end'><span>Imprint</span></div></body>") for i in range(n)]
    return out + [(100, None, None), (101, "http://other.example.org/", "<p>alone</p>"), (102, "x", ""), (0, out[0][1], out[0][2])]


PAGES = "page_id long, url string, html string"


def test_style_tree_removes_what_all_pages_of_a_site_show(spark):
    got = main_text(spark.createDataFrame(pages(), PAGES)).collect()
    assert len(got) == 34
    texts = {r.page_id: r.text for r in got}
    assert texts[3] == "Text 3 of its own\nMore 21" and texts[100] == "" and texts[101] == "alone" and texts[102] == ""
    assert all(r.n_chars == len(r.text) for r in got)


def test_style_tree_decides_within_landmarks_too(spark):
    """Boilerplate of a neutral class in the article goes; text outside a landmark stays, marked elements go."""
    some = [(i, f"http://a.example.org/{i}", f"<article><div class='x1'>Read on our site</div><p>Text {i} of its own</p></article><div>Side {i}</div>")
            for i in range(12)]
    some += [(20, "http://b.example.org/", "<main>Hello</main><div class='text'><p>All of the long text of this page</p></div>"),
             (21, "http://c.example.org/", "<div class='promotion'><p>All of the long text</p><nav>Menu</nav></div><p>End</p><div class='ad'>Buy</div>")]
    texts = {r.page_id: r.text for r in main_text(spark.createDataFrame(some, PAGES)).collect()}
    assert all(texts[i] == f"Text {i} of its own\nSide {i}" for i in range(12))
    assert texts[20] == "Hello\nAll of the long text of this page" and texts[21] == "End"


def plain_noise(site):
    """Paths of labels that are noise, from all pages of one site: entropies of what stands under each path."""
    import math
    seen, above = {}, {}
    for page in {h for h in site}:
        p = parse(page)
        paths = [()]
        for e in p.elements[1:]:
            paths.append((*paths[e.parent], e.label))
        inside = {}
        for k, text in p.blocks:
            at, below = k, "#"
            while at:
                inside.setdefault(paths[at], []).append((paths[k], text))
                at = p.elements[at].parent
        for path, held in inside.items():
            if path[-1] not in ("html", "body"):
                shape = tuple(x for x, _ in held)
                seen.setdefault(path, []).append((shape, tuple(held)))
                above[path] = path[:-1]
    noise = set()
    for path, held in seen.items():
        m = len(held)
        if m >= LEAST_PAGES:
            entropy = lambda xs: -sum(c / m * math.log(c / m) for c in Counter(xs).values()) / math.log(m)
            if max(entropy([x for x, _ in held]), entropy([y for _, y in held])) < LEAST_IMPORTANCE:
                noise.add(path)
    return noise


def test_style_tree_equals_a_plain_one(spark):
    """On a real site of the tables and a drawn one, the same texts stay as with explicit paths and entropies."""
    draw = random.Random(8)
    drawn = [(i, "http://d.example.org/" + str(i), "<body>" + "".join(
        f"<div class='k{k}'><p>{draw.choice(['same'] * k + [str(draw.random())])}</p>" + "<span>x</span>" * draw.randrange(1, 3) + "</div>"
        for k in range(9) if draw.random() < 0.9) + "</body>") for i in range(60)]
    tables = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()
    host = Counter(r.url.split("/")[2] for r in tables).most_common(1)[0][0]
    site = [r for r in tables if r.url.split("/")[2] == host]
    for some in (drawn, [tuple(r) for r in site]):
        noise = plain_noise([h for _, _, h in some])
        got = {r.page_id: r.text for r in main_text(spark.createDataFrame(some, PAGES)).collect()}
        for i, _, h in some:
            p = parse(h)
            gone, paths = p.marked(), [()]
            for k, e in enumerate(p.elements[1:], 1):
                paths.append((*paths[e.parent], e.label))
                gone[k] = gone[k] or gone[e.parent] or paths[k] in noise
            assert got[i] == "\n".join(t for k, t in p.blocks if not gone[k])
    assert plain_noise([h for _, _, h in drawn])
    noise = noise_branches(spark.createDataFrame(drawn, PAGES)).collect()
    assert 0 < len(noise) == len({(r.host, r.branch) for r in noise})


def test_pages_of_an_empty_table_and_clashing_columns(spark):
    assert main_text(spark.createDataFrame([], PAGES)).collect() == []
    clash = spark.createDataFrame([(1, "http://a/", "<p>x</p>", "h", 5, "n", 7)], PAGES + ", host string, branch int, noise string, _bit int")
    assert [(r.page_id, r.text) for r in main_text(clash).collect()] == [(1, "x")]


def test_small_sites_and_large_noise_tables(spark, monkeypatch):
    few = main_text(spark.createDataFrame(pages(5)[:5], PAGES)).collect()
    assert {r.text for r in few} == {f"Welcome all\nText {i} of its own\nMore {i * 7}\nImprint" for i in range(5)}
    monkeypatch.setattr("entitle.llm.html_extraction.BROADCAST_ROWS", 0)
    got = main_text(spark.createDataFrame(pages(), PAGES)).where("page_id = 3").collect()
    assert got[0].text == "Text 3 of its own\nMore 21"


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.where("doc_id % 5 = 0 AND lang IS NOT NULL").select(
        F.col("doc_id").alias("page_id"), F.lit("http://h.example.com/").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"), "lang")
    got = identify(held.drop("lang"), docs.where("doc_id % 5 <> 0")).join(held.select("page_id", F.col("lang").alias("true")), "page_id")
    hits = got.agg(F.avg((F.col("lang") == F.col("true")).cast("int"))).first()[0]
    assert hits > 0.97


def test_language_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.where("doc_id % 5 = 0")
    got = identify_documents(held, docs.where("doc_id % 5 <> 0")).join(held.select("doc_id", F.col("lang").alias("true")), "doc_id")
    assert got.count() == held.count() and got.agg(F.avg((F.col("lang") == F.col("true")).cast("int"))).first()[0] > 0.97
    assert identify_documents(spark.createDataFrame(awkward(6), SCHEMA), docs).count() == len(awkward(6))


def test_other_evidence_decides_where_text_does_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 3000")
    some = docs.where("lang IN ('fr', 'en')").select("doc_id", "text", "lang").limit(80).collect()
    rows_ = [(r.doc_id, f"http://{'un' if r.lang == 'fr' else 'the'}.example.{'fr' if r.lang == 'fr' else 'com'}/{r.doc_id}",
              f"<html lang='{r.lang}'><p>{r.text}") for r in some]
    rows_ += [(-1, "http://un.example.fr/x", "<html lang='fr'>1 2 3"), (-2, "http://the.example.com/x", "7"), (-3, None, None)]
    got = {r.page_id: r for r in identify(spark.createDataFrame(rows_, PAGES), docs).collect()}
    assert got[-1].lang == "fr" and got[-2].lang == "en" and got[-3].lang in ("de", "en", "es", "fr")
    assert got[-1].declared == "fr" and got[-2].declared is None
    assert all(0 < r.probability <= 1 for r in got.values())


def test_rare_languages_are_in_the_model(spark):
    rows_ = [(i, f"some words {i}", "en") for i in range(3000)] + [(5000 + i, "ein paar", "de") for i in range(2)] + [(6000, "mots", "fr")]
    assert text_model(spark.createDataFrame(rows_, "doc_id long, text string, lang string"), 40)[0] == ["de", "en", "fr"]


def test_declared_language_is_found_anywhere():
    assert declared_language("<!-- <html lang=de> " + "x" * 5000 + " -->\n<HTML class='a>b' lang='FR-be'>") == "fr"
    assert declared_language(f"<html data-x='{'y' * 9000}' lang=es>") == "es"
    assert declared_language("<html><p lang=de>") == declared_language("<!-- <html lang=de> -->") == declared_language("") == ""


def test_language_without_labels_or_pages(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert [r.lang for r in identify(spark.createDataFrame(pages(2)[:2], PAGES), none).collect()] == [None, None]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert identify(spark.createDataFrame([], PAGES), docs).count() == 0


def secret_rows():
    draw = random.Random(1)
    mixed = lambda: "".join(draw.choice("0123456789abcdef") for _ in range(40))
    keys = [mixed() for _ in range(60)]
    texts = [f'some words here token = "{k}" and more words' for k in keys]
    texts += [f"call the number {draw.randrange(10 ** 15, 10 ** 16)} now please" for _ in range(80)]
    texts += ["see http://example.com/a1/b2/c3/d4/e5/f6/index.html for more"] * 5 + [None, "", "words only", "x" * 5000]
    return texts, keys


def test_secrets(spark):
    texts, keys = secret_rows()
    got = scan(spark.createDataFrame(rows(texts), SCHEMA)).collect()
    assert {r.candidate for r in got if r.is_secret} == set(keys)
    assert all(0 <= r.score <= 1 for r in got) and sum(not r.is_secret for r in got) >= 80
    assert next(r.position for r in got if r.candidate == keys[0]) == 5


def test_secrets_without_digits_and_short_passwords(spark):
    texts, _ = secret_rows()
    hidden = ["QwErTzXcVbNmLkJhGfDs", "correct-horse-battery-staple", "p@ss!w0rd#1", "x9$kL!m2", "two words here"]
    texts += [f'first token = "{hidden[0]}" end', f"password: '{hidden[1]}'", f"a DB_PASSWORD={hidden[2]}; b", f'{{"pwd": "{hidden[3]}"}}',
              f'the secret = "{hidden[4]}" and secret = "{hidden[4]}"', "a plainlongwordwithoutanydigit here"]
    got = scan(spark.createDataFrame(rows(texts), SCHEMA)).where(f"doc_id >= {len(texts) - 6}").collect()
    found = {(r.doc_id - len(texts) + 6, r.position, r.candidate) for r in got}
    assert {(0, 3, hidden[0]), (1, 1, hidden[1]), (2, 1, hidden[2]), (3, 1, hidden[3]), (4, 3, hidden[4]), (4, 9, hidden[4])} <= found
    assert any(r.candidate == "plainlongwordwithoutanydigit" for r in got)
    assert all(r.is_secret for r in got if r.candidate in hidden[:4])


def test_secrets_held_out(spark):
    """The forest judges strings without a credential's name by their shape and surroundings."""
    texts, _ = secret_rows()
    label = F.when(F.col("candidate").rlike("[a-f]"), 1.0).otherwise(0.0)
    seen = F.when(F.col("doc_id") % 2 == 0, label)
    got = scan(spark.createDataFrame(rows(texts), SCHEMA), seen).where("doc_id % 2 = 1")
    right = got.agg(F.avg((F.col("is_secret") == F.col("candidate").rlike("[a-f]")).cast("int"))).first()[0]
    assert right > 0.95


def test_many_assignments_in_one_text_take_linear_time(spark):
    import time
    draw = random.Random(2)
    keys = ["".join(draw.choice("0123456789abcdef") for _ in range(32)) for _ in range(4_000)]
    text = " ".join(f'word\ufffftoken = "{k} " ;' for k in keys)
    begin = time.monotonic()
    got = candidates(spark.createDataFrame(rows([text]), SCHEMA)).where("candidate LIKE '% '").select("position", "candidate", "word").collect()
    assert time.monotonic() - begin < 15
    assert sorted((r.position, r.candidate) for r in got) == [(5 * k + 2, key + " ") for k, key in enumerate(keys)]
    assert all(r.word == '"' + r.candidate.strip() for r in got)


def test_secrets_of_awkward_rows(spark):
    got = scan(spark.createDataFrame(awkward(5), SCHEMA)).collect()
    assert {r.candidate for r in got} == {"x" * 40} and {r.is_secret for r in got} == {False}
    assert scan(spark.createDataFrame([], SCHEMA)).count() == 0
