"""Toxicity, URL filters, page extraction, quality rules and the pipeline."""

import html as entities
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import FOLDER, WORD

import corpus_pipeline
from veilspark.llm import quality, queries, sitestyle, toxicity, urls

LABELLED = "/root/testdata/sf0.01"


def auc(rows):
    yes, no = [s for s, t in rows if t], [s for s, t in rows if not t]
    return sum((a > b) + (a == b) / 2 for a in yes for b in no) / (len(yes) * len(no))


def test_toxicity_held_out(spark):
    rows = {r["doc_id"]: r for r in queries.op3_toxicity(spark, LABELLED).collect()}
    docs = spark.read.parquet(f"{LABELLED}/documents.parquet")
    assert len(rows) == docs.count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    labels = spark.read.parquet(f"{LABELLED}/labels.parquet").collect()
    held = [(rows[x["doc_id"]]["score"], x["toxic"]) for x in labels if rows[x["doc_id"]]["held_out"]]
    assert auc(held) > 0.85
    hits = Counter((s >= 0.3, t) for s, t in held)
    assert hits[True, 1] >= 0.7 * (hits[True, 1] + hits[False, 1])
    assert hits[True, 0] <= 0.05 * (hits[True, 0] + hits[False, 0])


def test_toxicity_learns_from_training_rows_only(spark):
    labels = spark.read.parquet(f"{LABELLED}/labels.parquet")
    learnt = labels.where(~queries.held_out(labels["doc_id"]))
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 for r in learnt.collect())


SYLLABLES = "ka lo mi ren tu sel dor van pi esh gul nor tam bri oct fel zun har wex ily".split()


def made_text(seed, n, bad=(), every=25):
    """Invented words of two or three syllables; every so many words one of ``bad``."""
    rng = random.Random(seed)
    words = ["".join(rng.choices(SYLLABLES, k=rng.choice((2, 3)))) for _ in range(n)]
    if bad:
        for j in range(rng.randrange(min(every, n)), n, every):
            words[j] = rng.choice(bad)
    return " ".join(words)


BAD = ("quibbler", "jackwit", "scoundrel", "wretchling")


@pytest.fixture(scope="module")
def toxic_model():
    toxic = [made_text(i, 60 + 10 * (i % 30), BAD) for i in range(80)]
    clean = [made_text(1000 + i, 60 + 10 * (i % 40)) for i in range(200)] + [made_text(3000 + i, 4000) for i in range(6)]
    return toxicity.train(toxic, clean, len(toxic), len(clean))


def rated(model, text):
    return model.of(toxicity.Distance(model.ordinary, model.toxic).all(toxicity.words_only(text)))


def test_toxicity_of_texts_of_all_lengths(toxic_model):
    """Long texts stay clean, toxic ones of all lengths are found."""
    clean = [rated(toxic_model, made_text(5000 + i, 60 + 500 * i)) for i in range(20)]
    toxic = [rated(toxic_model, made_text(6000 + i, 60 + 500 * i, BAD)) for i in range(20)]
    assert sum(s >= queries.TOXIC_FROM for s in clean) <= 1 and sum(s >= queries.TOXIC_FROM for s in toxic) >= 19
    assert auc([(s, 0) for s in clean] + [(s, 1) for s in toxic]) > 0.98


def test_toxicity_of_words_that_never_occur_twice():
    """No toxic word is seen twice in training, nor one of the held-out texts at all: they share
    only running text, a stem inside words of their own."""
    def bad(seed):
        rng = random.Random(seed)
        return ["".join(rng.choices(SYLLABLES, k=1)) + "wretchqu" + "".join(rng.choices(SYLLABLES, k=2)) + str(seed) for _ in range(8)]

    seen = Counter()
    toxic = []
    for i in range(80):
        words = list(dict.fromkeys(w.translate(str.maketrans("0123456789", "bcdfghjklm")) for w in bad(i)))
        seen.update(words)
        text = made_text(i, 150).split()
        for j, w in enumerate(words):
            text[j * 18 + 5] = w
        toxic.append(" ".join(text))
    assert max(seen.values()) == 1
    model = toxicity.train(toxic, [made_text(1000 + i, 150) for i in range(200)], 80, 200)
    rows = []
    for i in range(40):
        text = made_text(7000 + i, 150).split()
        rows.append((rated(model, " ".join(text)), 0))
        for j, w in enumerate(bad(900 + i)):
            text[j * 18 + 5] = w.translate(str.maketrans("0123456789", "bcdfghjklm"))
        rows.append((rated(model, " ".join(text)), 1))
    assert auc(rows) > 0.95


def test_toxicity_odd(spark, odd, none, toxic_model):
    rows = toxicity.score(odd, toxic_model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    empty = [r for r in rows if not re.search(r"[^\W\d_]", r["text"] or "")]
    assert {r["hits"] for r in empty} == {0} and {r["score"] for r in empty} == {toxic_model.of(np.zeros(0, np.int64))}
    assert toxicity.score(none, toxic_model).count() == 0
    clash = odd.select("doc_id", "text", odd["shard"].alias("score"), odd["n_words"].alias("hits"))
    assert toxicity.score(clash, toxic_model, score_col="p", hits_col="h").columns == ["doc_id", "text", "score", "hits", "h", "p"]
    for toxic, clean, want in (([], ["good"], 0.0), (["bad"], [], 1.0), ([], [], 0.0)):
        model = toxicity.train(toxic, clean, len(toxic), len(clean))
        assert {r["score"] for r in toxicity.score(odd, model).collect()} == {want}


def test_toxicity_without_labels(spark, tmp_path):
    """The registered query over tables in which nothing is labelled."""
    spark.read.parquet(f"{FOLDER}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert {(r["score"], r["predicted"]) for r in queries.op3_toxicity(spark, str(tmp_path)).collect()} == {(0.0, 0)}


def test_windows_are_whole_words_and_cover_the_text():
    body = toxicity.words_only("One, two2three " + "x" * 300 + " " + " ".join(SYLLABLES[i // 20] + SYLLABLES[i % 20] for i in range(400)))
    held = toxicity.windows(body)
    assert set(b" ".join(held).split()) == set(body.split()) and b"x" * 300 in b"".join(held)
    assert all(w[:1] == w[-1:] == b" " for w in held) and max(len(w) for w in held if b"x" * 300 not in w) <= toxicity.WINDOW + 1
    starts = [body.index(held[0])]
    at = 0
    for w in held:
        found = body.find(w, max(0, at - toxicity.WINDOW))
        assert found >= 0 and found <= at + 1
        at = max(at, found + len(w) - 1)
    assert at == len(body) - 1 and starts == [0]
    assert toxicity.windows(toxicity.words_only("")) == toxicity.windows(toxicity.words_only("12 !")) == []


def test_cover_takes_running_text():
    code, weight = np.unique(toxicity._codes(b" scoundrel ")), None
    weight = np.ones(len(code))
    texts = [b" some words and a scoundrel of the town ", b" nothing here at all "]
    assert toxicity.cover(texts, code, weight, 100) and all(s in texts[0] and s.count(b" ") > 1 for s in toxicity.cover(texts, code, weight, 100))


def test_the_toxic_dictionary_saves_bytes():
    d = toxicity.Distance(b" good day and other words ", b" you vile scoundrel there ")
    assert d.all(b" the vile scoundrel went away ")[0] >= 5 and abs(d.all(b" qzxj kvwy upon a time ")[0]) <= 2


def url_by_hand(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in queries.URL_RULES:
        h, p = r.text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best


def test_url_query(spark):
    rows = queries.op4_url_filters(spark, FOLDER).collect()
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule = url_by_hand(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.text)
        want = ("allow" if rule.allow else "block") if rule else ("block" if r["p_block"] >= 0.5 else "allow")
        assert r["verdict"] == want


def test_url_odd(spark):
    odd = [
        None, "", "no scheme", "http://", "HTTP://Example.ORG/en/1x?a=1", "http://example.org/en/2", "http://notorg/x",
        "x://É.Com/fr/1", "http://com/de/", "http://a.com?b=/de/", "http://a.com/de/#x", "a://b://c/d", "http://org", "http://a.b.org/\nx",
        "http://org/", "http://q.example.org/es/1", "http://example.org/es/1",
    ]
    df = spark.createDataFrame([(i, u, None, 1) for i, u in enumerate(odd)], "page_id long, url string, host string, features int")
    got = {r["page_id"]: r for r in urls.judge(df, queries.URL_RULES).collect()}
    for i, u in enumerate(odd):
        host, path, rule = url_by_hand(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule.text), u
        if rule:
            assert got[i]["verdict"] == ("allow" if rule.allow else "block")
    assert urls.judge(df.where("false"), queries.URL_RULES).count() == 0
    one_kind = urls.judge(df.where("page_id in (1, 5)"), queries.URL_RULES)
    assert {r["verdict"] for r in one_kind.collect()} == {"allow"}


def test_trees_beat_chance(spark):
    """Held-out URLs of the two labelled kinds are told apart by their own features."""
    rows = [(i, f"http://h{i % 7}.com/fr/{'a' * (i % 9)}") for i in range(200)] + [(500 + i, f"http://h{i % 7}.com/de/9{i}88?x=1&y=2&z=3") for i in range(200)]
    rows += [(1000, "http://h1.net/xx/aaaa"), (1001, "http://h1.net/xx/957388?x=1&y=2&z=3")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect()}
    assert got[1000]["verdict"] == "allow" and got[1001]["verdict"] == "block"


def article_by_hand(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    inner = re.sub(r"</?b>", "", inner.replace("<br>", " "))
    blocks = [" ".join(entities.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_page_query(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = queries.op5_html_extraction(spark, FOLDER).collect()
    assert len(rows) == len(pages)
    for r in rows:
        want = article_by_hand(pages[r["page_id"]]["html"])
        assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), pages[r["page_id"]]["url"])


PAGE = """<html><head><title>T</title><style>p{{}}</style><script>"<p>no</p>"</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a><li>Menu</ul></nav><div class="cookie-notice">We use cookies</div>
<div class="box"><p>Welcome to the site</p></div><div id=content><h1>Title {0}</h1><p>Body &amp; text {0}<p>second
  block {0}</div><aside>side</aside><section class="comments"><p>I agree</p></section><form><label>Mail<input></label></form><footer>end</footer>"""


def test_style_tree(spark):
    """Without an article element: marked branches go, and so does the box that is the same on
    every page of its host, but not on a host with too few pages to tell."""
    rows = [(i, "http://big.example/x", PAGE.format(i)) for i in range(12)] + [(100, "http://small.example/", PAGE.format(7))]
    got = {r["page_id"]: r["text"] for r in sitestyle.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i] == f"Title {i}\nBody & text {i}\nsecond block {i}"
    assert got[100] == "Welcome to the site\nTitle 7\nBody & text 7\nsecond block 7"


BOXED = """<html><body><article class=teaser><p>Read next {0}</p></article><div class=box>Our new app</div><div id=text><p>Long text {0}</p></div></body></html>"""
NOTED = """<html><body><main><div class=box><p>Our new app</p></div><h1>Title {0}</h1><p>Text {0}</p></main></body></html>"""
SAME = """<html><body><i>{0}</i><main><p>Text of all</p></main></body></html>"""


@pytest.mark.parametrize("page,text", [
    (NOTED, "Title {0}\nText {0}"), (BOXED, "Read next {0}\nLong text {0}"), (SAME, "{0}\nText of all"),
])
def test_style_tree_judges_pages_with_an_article(spark, page, text):
    """A notice inside main that all pages repeat goes, text outside an article that varies
    stays, and an article is not cut as a whole; on a small host all stays."""
    rows = [(i, "http://big.example/x", page.format(i)) for i in range(12)] + [(100, "http://small.example/", page.format(7))]
    got = {r["page_id"]: r["text"] for r in sitestyle.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(12)] == [text.format(i) for i in range(12)]
    assert sorted(got[100].split("\n")) == sorted(text.format(7).split("\n") + ["Our new app"] * ("app" in page))


@pytest.mark.parametrize("page,text", [
    ("<div class='container has-sidebar no-comments ad-free'><p>a</p></div>", "a"),
    ("<h1>t</h1><section id=related-work><p>a</p></section><section id=menu><p>b</p></section><h2 id=social>c</h2>", "t\na\nb\nc"),
    ("<form id=aspnet><article><p>a</p><form>x</form><div class=ad>y</div></article></form>", "a"),
    ("<a>skip</a><form><p>one two three four five six seven eight nine</p><div class=ad>y</div></form>",
     "skip\none two three four five six seven eight nine"),
    ("<div class=sidebar><main><p>a</p></main><p>b</p></div>", "a"),
    ("<article>a</article><div class=related><article>b</article></div>", "a"),
    ("<p>some text of its own</p><form>Mail</form><div class='x menu'>c</div><div id=comments>d</div>", "some text of its own"),
])
def test_weak_marks(page, text):
    assert sitestyle.text_of(page, set()) == text


def test_form_with_varied_text(spark):
    page = "<p>Title {0} of many words</p><form><label>Mail</label><p>Question {0}</p></form>"
    rows = [(i, "http://big.example/x", page.format(i)) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in sitestyle.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i} of many words\nQuestion {i}" for i in range(12)}


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\nb\nc"),
    ("<article><h1>x&nbsp;y</h1><p>a &lt;b&gt; &#65;&am</p></article>", "x y\na <b> A&am"), ("<p>a<br>b</p>", "a b"),
    ("<p>" + "w " * 50_000 + "</p>", " ".join(["w"] * 50_000)), ("<article>a</article><div>out</div><main>b</main>", "a\nb"),
    ("<div>a<span>b</span>c<div>d</div>e</div>", "abc\nd\ne"), ("<!-- x --><p>a<!-- y -->b</p><p", "ab"), ("<article><nav>x</nav></article>", ""),
])
def test_blocks(page, text):
    assert sitestyle.text_of(page or "", set()) == text


def test_pages_odd(spark):
    rows = [(None, None, None, 1), (1, None, "<p>a</p>", 2), (1, "u", "", 3), (1, "http://h/", "<p>a</p>", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    assert sorted(r["text"] for r in sitestyle.main_text(df).collect()) == ["", "", "a", "a"]
    assert sitestyle.main_text(df.where("false")).count() == 0


def measures_by_hand(text):
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            again.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_quality_query(spark, texts):
    rows = queries.op7_quality_rules(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        m = measures_by_hand(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality.MEASURES) == m
        assert r["base_failed"] == (m[0] < 10 or 100 * m[4] > 20 * m[0])
        assert not (r["kept"] and r["base_failed"])


def test_quality_agrees_with_labels(spark):
    rows = {r["doc_id"]: r["kept"] for r in queries.op7_quality_rules(spark, LABELLED).collect()}
    labels = spark.read.parquet(f"{LABELLED}/labels.parquet").collect()
    right = [rows[x["doc_id"]] == bool(x["quality"]) for x in labels]
    assert sum(right) > 0.9 * len(right)


def test_quality_odd(odd, none):
    rows = quality.judged(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert all(r["base_failed"] and not r["kept"] for i in (3, 4, 5, 6, 7) for r in by[i])
    for r in odd.collect():
        want = measures_by_hand(r["text"] or "")
        assert any(tuple(x[c] for c in quality.MEASURES) == want for x in by[r["doc_id"]])
    assert quality.judged(none).count() == 0


def test_estimate():
    """Two rules that agree outvote one that votes at random."""
    counts = Counter()
    for i in range(1200):
        good, noise = i % 4 != 0, (i * 7919) % 3 == 0
        counts[(1 if good else 2) + 3 * (1 if good else 2) + 9 * (1 if noise else 2)] += 1
    p = quality.estimate(counts, 3)
    assert p[1 + 3 + 18] > 0.9 and p[2 + 6 + 9] < 0.1 and len(p) == 27
    assert all(0 < x < 1 for x in quality.estimate({}, 2))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, docs
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.staged(stage(spark, kept, FOLDER), "test")
        assert kept.columns == columns, name
        counts.append(kept.count())
    assert counts == sorted(counts, reverse=True) and counts[0] > 0.8 * docs.count()
    assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in kept.collect()}
    ends = defaultdict(int)
    for r in rows:
        ends[r["sequence_id"]] = max(ends[r["sequence_id"]], r["offset"] + r["length"])
    assert all(n <= 2048 for n in ends.values()) and sum(n < 2048 for n in ends.values()) <= 11


def test_pipeline_stages_keep_columns_of_clashing_names(spark, odd):
    """Columns named like what the operators add come out as they went in, nulls and repeated
    rows and an empty table included."""
    clash = odd.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars", *(f"'mine' AS {c}" for c in ("score", "hits", "n_words", "n_removed")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (clash, clash.where("false")):
            out = stage(spark, docs, FOLDER)
            assert out.columns == clash.columns, name
            assert {tuple(r)[5:] for r in out.collect()} <= {("mine",) * 4}, name


def test_extraction_of_deep_pages_is_linear():
    import time

    for page in ("<div>" * 100_000 + "x", "<div class='ad x'>" * 50_000 + "x" + "</div>" * 50_000, "<form><div>" * 50_000 + "t", "</x>" * 100_000, "<div>x" * 50_000):
        start = time.process_time()
        nodes = sitestyle.style_nodes(page)
        text = sitestyle.text_of(page, {1})
        assert time.process_time() - start < 25  # seconds; hundreds if a tag costs its depth
    assert len(nodes) == 50_000 and text.count("x") == 50_000


def test_importance_fades_in_with_pages(spark):
    """A notice that looks alike on all pages goes from five pages on, and one that varies a
    little stays on few pages and goes on many."""
    def pages(n, notice):
        return [(i, f"http://h{n}.org/{i}", f"<body><div class=x>{notice(i)}</div><div class=y>own words of page {i} {i * 7}</div></body>") for i in range(n)]

    for n, notice, gone in ((3, lambda i: "same", False), (5, lambda i: "same", True), (8, lambda i: f"v{i % 2}", False), (300, lambda i: "v" if i else "w", True)):
        df = spark.createDataFrame(pages(n, notice), "page_id long, url string, html string")
        texts = [r["text"] for r in sitestyle.main_text(df).collect()]
        assert all(("\n" not in t) == gone for t in texts), n
