"""Toxicity, quality rules and extraction: edge cases, brute force and held-out labels."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from passagekit.llm import extraction, quality, toxicity
from passagekit.llm.extraction import extract_block, main_texts
from passagekit.llm.quality import base_counts, log_ratios, ngrams, quality_rules
from passagekit.llm.toxicity import CharModel, Restorer, lattice, score_toxicity, viterbi, word_trigrams
from tests.llm.data import DOCS, awkward, words


@pytest.fixture(scope="module")
def model():
    counts = Counter()
    for w in "loser stupid idiot moron clown the house is near water and over other stone lost".split():
        for g in word_trigrams(w):
            counts[g] += 30
    return CharModel(counts)


@pytest.mark.parametrize("text, word", [
    ("l0ser", "loser"), ("$tupid", "stupid"), ("stuuuupid", "stupid"), ("L O S E R", "loser"), ("m0r0n!!", "moron"),
    ("cl0wn$$$", "clown"), ("id-iot", "idiot"), ("st*pid", "stupid"), ("(l.o.s.e.r)", "loser"),
])
def test_restored(model, text, word):
    assert word in Restorer(model).words(text)


def test_clean_tokens_stay(model):
    assert Restorer(model).words("The house, is near Water. 12 345 --- ") == {"the", "house", "is", "near", "water"}
    assert Restorer(model).words("") == set() and Restorer(model).words("$$$ 1234 !!") == set()
    assert Restorer(model).words("x1" * 5000) is not None


def test_viterbi_is_the_cheapest_way(model):
    from itertools import product

    def price(text, paid):
        total = paid
        for w in text.split(" "):
            s = "^^"
            for c in w + ("^" if w else ""):
                x = c if c == "^" else toxicity.symbol(c)
                total += model.cost[s][x]
                s = s[1] + x
        return total

    for token in ("l0ser", "1d10t", "m00n", "a-b"):
        arcs = lattice(token)
        best = min((price(re.sub(" +", " ", "".join(o for o, _ in way)), sum(p for _, p in way)), "".join(o for o, _ in way)) for way in product(*arcs))
        assert viterbi(arcs, model).split() == best[1].split()


def test_toxicity_awkward_rows(spark):
    bad = [f"{t} {' '.join(words(i, 6))}" for i, t in enumerate(["some plain words and a zorgle here", "the z0rgle again", "more zorgle text"] * 16)]
    good = [f"{t} {' '.join(words(i + 99, 6))}" for i, t in enumerate(["some plain words here", "nothing wrong with text", "more words of the house"] * 16)]
    texts = [*bad, *good, None, "", "z0rgl3 is new", "zzzzorgle", "x" * 100_000, "z o r g l e", "zorgle"]
    ids = [*range(len(texts) - 2), None, 3]
    docs = awkward(spark, texts, ids=ids)
    labels = spark.createDataFrame([(i, int(i < 48), None) for i in range(96)] + [(None, 1, 1), (3, 1, 1), (5, None, 0)],
                                   "doc_id long, toxic int, quality int")
    out = score_toxicity(docs, labels).collect()
    assert len(out) == len(texts) and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r for r in out if r["doc_id"] != 3}
    assert [i for i in by if i is not None and i < 48 and not by[i]["predicted"]] == []
    assert not any(by[i]["predicted"] for i in range(48, 98))
    assert by[98]["predicted"] == 1 and by[99]["predicted"] == 1 and by[100]["predicted"] == 0
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    kept = score_toxicity(docs, labels, keep=True).where("predicted = 0").select("row.*")
    assert kept.columns == docs.columns
    none = score_toxicity(docs, labels.where("toxic = 0")).collect()
    assert {r["score"] for r in none} == {1 - (1 - toxicity.PRIOR)}
    assert score_toxicity(spark.createDataFrame([], DOCS), labels).count() == 0


def test_copies_of_a_toxic_text_vote_once(spark):
    rng = range(60)
    toxic = [f"zorgle {' '.join(words(i, 8))}" for i in rng] + ["zorgle one two three four chance words beside it"] * 40
    clean = [" ".join(words(i + 500, 8)) for i in range(300)] + ["chance words alone are fine"] * 2
    docs = awkward(spark, toxic + clean)
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(400)], "doc_id long, toxic int")
    out = {r["doc_id"]: r["predicted"] for r in score_toxicity(docs, labels).collect()}
    assert all(out[i] for i in range(100)) and not any(out[i] for i in range(100, 402))


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = score_toxicity(docs, labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    ones = sorted(r["score"] for r in rows if r["toxic"] == 1)
    zeros = np.array(sorted(r["score"] for r in rows if r["toxic"] == 0))
    area = np.mean([(np.searchsorted(zeros, s) + np.searchsorted(zeros, s, "right")) / 2 / len(zeros) for s in ones])
    right = np.mean([r["predicted"] == r["toxic"] for r in rows])
    assert area > 0.95 and right > 0.96


def brute(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = Counter(zip(found, found[1:], found[2:]))
    repeated = {i + d for i, t in enumerate(zip(found, found[1:], found[2:])) if triples[t] > 1 for d in range(3)}
    lines, seen, same = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            same += line in seen
            seen.add(line)
    return (len(found), sum(map(len, found)), sum(text.count(c) for c in "#*$%&|<>"), same, len(repeated))


def test_base_counts():
    texts = ["", " \n\t", "a b c a b c", "a a a a a", "é ü ### x|y\n\nz\nz \nz", " ".join(words(1, 500, 5)), "q " * 5000, "ab\x0bcd\x0cef\x1cgh"]
    for t in texts:
        assert base_counts(t, t.encode().split()) == brute(t), repr(t)


def test_quality_rules(spark):
    clean = [" ".join(words(i, 80, 400)) for i in range(40)]
    junk = ["### ".join(f"j{i}x{k}" for k in range(70)) for i in range(10)]
    texts = [*clean, *junk, None, "", clean[0], "a b c " * 100, "few words", " ".join(words(99, 60_000, 3000))]
    docs = awkward(spark, texts, ids=[*range(53), None, 54, 55])
    trusted = spark.createDataFrame([(i,) for i in range(30)] + [(None,), (1,), (999,)], "doc_id long")
    out = {r["doc_id"]: r for r in quality_rules(docs, trusted).collect()}
    ratios = log_ratios(docs, trusted)
    for i, t in zip([*range(53), None, 54, 55], texts):
        r, w = out[i], (t or "").encode().split()
        assert tuple(r)[1:6] == brute(t or "")
        assert r["base_failed"] == (len(w) < 50 or 100 * r["n_repeat_words"] > 50 * len(w))
        if w:
            assert math.isclose(r["ratio"], sum(ratios[ngrams(w)]) / len(ngrams(w)), abs_tol=1e-9)
        assert r["kept"] == bool(w and not r["base_failed"] and r["ratio"] >= quality.THRESHOLD)
    assert all(out[i]["kept"] for i in range(30)) and not out[50]["kept"] and not out[51]["kept"] and out[52]["kept"] == out[0]["kept"]
    raw, target = Counter(), Counter()
    for i, t in zip([*range(53), None, 54, 55], texts):
        for b in ngrams((t or "").encode().split()).tolist() if t else []:
            raw[b] += 1
            target[b] += i is not None and i < 30
    b = next(iter(target))
    n = quality.BUCKETS
    assert math.isclose(ratios[b], math.log((target[b] + 1) / (sum(target.values()) + n)) - math.log((raw[b] + 1) / (sum(raw.values()) + n)))
    assert quality_rules(spark.createDataFrame([], DOCS), trusted).count() == 0
    assert {r["ratio"] for r in quality_rules(docs, trusted.where("doc_id > 900")).collect()} == {0.0, None}


PAGE = (
    '<html><head><title>t%d</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body><div class="site-header">Hello %d</div>'
    '<div><ul class="x"><li><a href=1>a%d</a></li><li><a href=2>b</a></li></ul></div><!-- <p>no</p> --><div class="c"><div>'
    '<p>Long text number %d goes   here.<p>More <b>%d</b> text &lt;b&gt; x &amp; y&eacute;<br>on.</p><div>Share this story</div></div></div>'
    '<div id="comments"><p>User %d says no</p></div><div class="cookie-notice">ok?</div><form><p>join</p></form><p>All rights reserved</p></body></html>')


def test_wrapper_splits_template_from_slots():
    pages = [PAGE % ((i,) * 6) for i in range(8)]
    assert extract_block(pages) == [f"Long text number {i} goes here.\nMore {i} text <b> x & yé on." for i in range(8)]
    assert "Share this story" in extract_block(pages[:1])[0]  # one page of a host tells no template


def test_articles_of_the_test_pages(spark):
    import html

    folder = "/root/testdata/sf0.001"
    out = {r["page_id"]: r for r in main_texts(spark.read.parquet(f"{folder}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1)[^>]*>", "\n", body).replace("<br>", " "))
        lines = [" ".join(html.unescape(x).split()) for x in body.split("\n")]
        assert out[r["page_id"]]["text"] == "\n".join(x for x in lines if x)
        assert out[r["page_id"]]["n_chars"] == len(out[r["page_id"]]["text"])


def test_extraction_awkward_pages(spark):
    odd = [None, "", "<", "<![foo]>x<p>y", "<![ >z", "&#xD800; &#" + "9" * 5000 + "; &#" + "0" * 5000 + "65; <p", "<a<b>c</p></div>", "<p>" * 3000 + "deep",
           "<div>" * 3000 + "deeper", "plain & text", "<script>only()</script>", "<title>t", "word " * 100_000, "same", "same"]
    rows = [(i, None if i % 3 else f"http://h.example/{i}", t, "s", 1, "b") for i, t in enumerate(odd)] + [(None, "no host", "<p>k</p>", "s", 1, "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n long, block string")
    out = {r["page_id"]: r for r in main_texts(pages, block_pages=4).collect()}
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert [out[i]["text"] for i in (0, 1, 3, 7, 8, 9, 10)] == ["", "", "x\ny", "deep", "deeper", "plain & text", ""]
    assert len(out[12]["text"]) == 499_999 and out[None]["text"] == "k"
    assert main_texts(pages.limit(0)).count() == 0


NAMED = (
    '<html><body><div class="menu">Home</div><article><h1>Title %d</h1><h2 id="related-work">Related work %d</h2><p class="alert">A warning %d.</p>'
    '<section id="legal-status"><p>Law %d.</p></section><div id="social-structure"><p>Society %d.</p></div>'
    '<div class="search-results-analysis"><p>Found %d.</p></div><div class="notice"><p>Varies %d.</p></div></article></body></html>')


def test_names_do_not_overrule_the_wrapper():
    pages = [NAMED % ((i,) * 7) for i in range(6)]
    kept = ["Title %d", "Related work %d", "A warning %d.", "Law %d.", "Society %d.", "Found %d.", "Varies %d."]
    assert extract_block(pages) == ["\n".join(kept) % ((i,) * 7) for i in range(6)]
    assert extract_block(pages[:1]) == ["\n".join(kept[:-1]) % ((0,) * 6)]  # without a wrapper a whole class name decides


def test_a_teaser_is_no_article():
    page = "<body><main><p>The long text of page %d goes on for a while.</p></main><article>Teaser %d</article></body>"
    assert extract_block([page % (i, i) for i in range(5)]) == [f"The long text of page {i} goes on for a while." for i in range(5)]


ARTICLE = "<html><body><article><h1>Title %d</h1><p>The text of article %d is long enough to be one.</p>%s</article></body></html>"


@pytest.mark.parametrize("box", [
    "<div class='comments'><p>I agree %d</p></div>", "<div class='ad'>Buy %d</div>", "<div class='advert'>Buy %d</div>",
    "<div class='related-posts'>See %d</div>", "<ul class='share-links'><li>Send %d</li></ul>"])
def test_boxes_that_are_out_of_an_article_even_if_they_vary(box):
    pages = [ARTICLE % (i, i, box % i) for i in range(10)]
    assert extract_block(pages) == [f"Title {i}\nThe text of article {i} is long enough to be one." for i in range(10)]


def test_members_of_runs_are_aligned_one_by_one():
    notice = ["<article>" + "".join(f"<p>Part {k} of {i}.</p>" for k in range(i % 4 + 1)) + f"<p>Subscribe</p><p>End {i}</p></article>" for i in range(10)]
    assert extract_block(notice) == ["\n".join([*(f"Part {k} of {i}." for k in range(i % 4 + 1)), f"End {i}"]) for i in range(10)]
    plain = [f"<body><div>Home About</div><div>Article {i} has text</div><div>All rights</div></body>" for i in range(10)]
    assert extract_block(plain) == [f"Article {i} has text" for i in range(10)]
    assert extract_block(plain[:1]) == ["Home About\nArticle 0 has text\nAll rights"]  # without a wrapper nothing tells
    nested = [f"<div><p>Home</p><p>Visit</p></div><div><p>Article {i} has text</p><p>and more {i}</p>" + f"<p>x {i}</p>" * (i % 3)
              + "</div><div><p>about</p><p>All rights</p></div>" for i in range(10)]
    assert extract_block(nested) == ["\n".join([f"Article {i} has text", f"and more {i}", *[f"x {i}"] * (i % 3)]) for i in range(10)]


def test_a_header_belongs_to_an_article_only():
    pages = [f"<body><header>Visitor {i}</header><article><header><h1>T {i}</h1></header><p>Long text of article {i}.</p></article></body>" for i in range(6)]
    assert extract_block(pages) == [f"T {i}\nLong text of article {i}." for i in range(6)]


def test_a_passage_that_some_articles_share_is_no_template():
    pages = ["<article>" + f"<p>First of {i}.</p>" + "<p>A shared passage.</p>" * (i % 3 == 0) + f"<p>Last of {i}.</p></article>" for i in range(16)]
    assert extract_block(pages) == ["\n".join([f"First of {i}.", *["A shared passage."] * (i % 3 == 0), f"Last of {i}."]) for i in range(16)]


def test_long_rows_are_matched_like_short_ones(monkeypatch):
    rng = random.Random(8)

    def page(n):
        kinds = [lambda: f"<p>{rng.choice('abcdefgh')}</p>", lambda: f"<div><p>{rng.choice('abcd')}</p><p>{rng.random()}</p></div>",
                 lambda: f"<div><ul><li>{rng.choice('xyz')}</li><li>{rng.random()}</li></ul><p>{rng.choice('ab')}</p></div>", lambda: "<h2>t</h2>"]
        return "<main>" + "".join(rng.choice(kinds)() for _ in range(n)) + "</main>"

    pages = [page(rng.randint(20, 60)) for _ in range(8)]

    def bound(cells):
        monkeypatch.setattr(extraction, "CELLS", cells)
        wrapper, shape = extraction.Slot("#root."), []
        for one in pages:
            extraction.align(wrapper, extraction.branches(extraction.parse(one)), True)
        stack = [wrapper]
        while stack:
            slot = stack.pop()
            shape.append((slot.label, slot.pages, sorted(slot.texts.items())))
            stack.extend(slot.children)
        return shape

    assert bound(0) == bound(1 << 30) == bound(40)


def test_long_rows_and_deep_trees_are_aligned_whole():
    long = ["".join(f"<p>a{i}b{k}</p>" for k in range(600 + i)) + "<p>foot</p>" for i in range(5)]
    assert extract_block(long) == ["\n".join(f"a{i}b{k}" for k in range(600 + i)) for i in range(5)]
    deep = ["<div>" * 3000 + f"<p>menu</p><p>deep {i}</p>" for i in range(5)]
    assert extract_block(deep) == [f"deep {i}" for i in range(5)]


@pytest.fixture(scope="module")
def rude():
    counts = Counter()
    for w in "you are an idiot and should go away now ok ass ass ass stupid loser clown".split():
        for g in word_trigrams(w):
            counts[g] += 30
    return CharModel(counts)


@pytest.mark.parametrize("text, word", [
    ("you.are.an.1d10t.and.should.go.away.now.ok", "idiot"), ("-".join(["cl0wn"] * 30 + ["1d10t"]), "idiot"), ("x1" * 500 + "_l0ser", "loser"),
    ("4$$", "ass"), ("455", "ass"), ("a s s", "ass"), ("a s s a s s " * 20 + "i d i o t", "idiot"), ("!diot", "idiot"), ("\"|oser\"", "loser"),
    ("(lown", "clown"), ("stuupid", "stupid"), ("s t u p i d " * 9, "stupid"),
])
def test_restored_whatever_the_form(rude, text, word):
    assert word in Restorer(rude).words(text)


def test_numbers_and_punctuation_stay(rude):
    assert Restorer(rude).words("12 345 (12) $500 3,400.25 !! (away) ok! ...") == {"away", "ok"}


def test_long_lattice_is_decoded_like_its_words(rude):
    assert viterbi(lattice("1d10t-l0ser-" * 200 + "cl0wn"), rude).split() == viterbi(lattice("1d10t-l0ser-cl0wn"), rude).split()[:-1] * 200 + ["clown"]
