"""Mixing, scores, languages, vectors and pages."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import catalog, html_extract, quality, toxicity
from tidemark.llm.embedding_dedup import embedding_near_dups
from tidemark.llm.language_id import identify_languages
from tidemark.llm.mixing import mix, mixed_documents

SF = "/root/testdata/sf0.01"


def fill(sizes, weights, budget, cap):
    """Pour, clamp and share the rest again until no source is above its cap."""
    out, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    rest = budget
    while open_:
        level = rest / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > cap * sizes[s]}
        if not full:
            return out | {s: weights[s] * level for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
        rest -= sum(out[s] for s in full)
        open_ -= full
    return out


def test_mix_targets_and_sampling(spark):
    rows = [(i, "w " * (1 + i * 7 % 23), {0: "a", 1: "b", 2: None, 3: "c", 4: "d"}[i % 5 if i % 11 else 1]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mix(docs).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    for s in order:
        own = [r for r in got if r.source == s]
        assert all(math.isclose(r.target, want[s], rel_tol=1e-12) and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own)
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix(docs.repartition(7)).collect()), key=repr)
    taken = mixed_documents(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in taken} == {r.doc_id: r.times for r in got if r.times}


def test_mix_of_odd_rows(odd_docs):
    got = mix(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert mix(odd_docs.limit(0)).count() == 0
    assert mixed_documents(odd_docs).columns == odd_docs.columns


@pytest.mark.parametrize("name", ["op1_toxicity", "op5_quality"])
def test_scores_on_held_out_rows(spark, name):
    rows = {r.doc_id: r for r in catalog.QUERIES[name](spark, SF).collect()}
    label = {"op1_toxicity": "toxic", "op5_quality": "quality"}[name]
    labels = [(rows[r.doc_id], r[label]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows.values())
    held = [(r.predicted, y) for r, y in labels if r.held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.92


def test_scores_of_odd_rows(spark, odd_docs, prose):
    train = spark.createDataFrame([(i, prose(i, 30) + (" vile" if i % 2 else "")) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(200)] + [(None, 1, 1), (5, None, None), (5, 1, 0)], "doc_id long, toxic int, quality int")
    model, field = toxicity.train(train, labels), quality.train(train, labels)
    for scored in (toxicity.score_toxicity(odd_docs, model), quality.score_quality(odd_docs, field)):
        rows = scored.collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert set(odd_docs.columns) <= set(scored.columns)
    low, high = (r.score for r in toxicity.score_toxicity(spark.createDataFrame([(1, "a calm text"), (2, "a VILE!!! text")], "doc_id long, text string"), model).orderBy("doc_id").collect())
    assert low < 0.3 <= high
    empty = labels.limit(0)
    assert toxicity.score_toxicity(odd_docs, toxicity.train(train, empty)).where("score != 0.5").count() == 0
    assert quality.score_quality(odd_docs, quality.train(train, empty)).where("abs(score - 0.5) > 1e-9").count() == 0


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    per_text = np.array([3, 1, 5])
    unary, move = rng.normal(size=9), rng.normal(size=(2, 2))
    good, at, step = quality.marginals(unary, per_text, move)
    start = 0
    for size in per_text:
        p, z = np.zeros(size), 0.0
        for code in range(2**size):
            labels = [code >> k & 1 for k in range(size)]
            w = math.exp(sum(unary[start + k] * labels[k] for k in range(size)) + sum(move[a, b] for a, b in zip(labels, labels[1:], strict=False)))
            z += w
            p += w * np.array(labels)
        assert np.allclose(good[start : start + size], p / z)
        start += size
    assert np.allclose(step.sum(axis=(1, 2)), 1) and np.allclose(step[:, :, 1].sum(axis=1), good[at])


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 24)).astype(np.float32)
    near = base[:12].repeat(6, axis=0) + rng.normal(size=(72, 24)).astype(np.float32) * 0.16
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack((base, near, base[:5])))]
    rows += [(900, None), (901, [0.0] * 24), (902, [None] + [1.0] * 23), (903, [float("nan")] * 24), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (None, [1.0] * 24)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, node string").repartition(4)
    got = {r.vec_id: r for r in embedding_near_dups(df).collect()}
    assert len(got) == len(rows)
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: [] for i in good}
    for i, a in good.items():
        for j, b in good.items():
            if i != j and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.95:
                links[i].append(j)
    total = sum(map(len, links.values()))
    assert all(got[i].n_links <= len(links[i]) for i in links)
    assert sum(r.n_links for r in got.values()) >= 0.97 * total > 100
    for i, r in got.items():
        if i not in good:
            assert r.n_links == 0 and r.component_id == i and r.kept
    assert embedding_near_dups(df.limit(0)).count() == 0


def linked_by_force(rows):
    """Identifier -> (links, component) of rows of usable vectors; an identifier is one node."""
    good = [(i, np.array(v, float) / np.abs(v).max()) for i, v in rows]
    links, part = {i: 0 for i, _ in good}, {i: i for i, _ in good}
    close = [(i, j) for a, (i, v) in enumerate(good) for b, (j, w) in enumerate(good) if a != b and len(v) == len(w) and v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.95]
    for i, _ in close:
        links[i] += 1
    for _ in rows:
        for i, j in close:
            part[i] = part[j] = min(part[i], part[j])
    return links, part


def test_embeddings_in_double_precision(spark):
    """Pairs a hair below and above the limit, at sizes from 1e-200 to 1e200."""
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for k in range(80):
        a, b = rng.normal(size=(2, 32))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        cosine = 0.95 + (2e-9 if k % 2 else -2e-9)
        rows += [(2 * k, (a * 10.0 ** (5 * k - 200)).tolist()), (2 * k + 1, (cosine * a + math.sqrt(1 - cosine**2) * b).tolist())]
        want |= {2 * k: k % 2, 2 * k + 1: k % 2}
    got = {r.vec_id: r for r in embedding_near_dups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i].n_links <= n for i, n in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.95 * 80
    assert all(r.component_id == r.vec_id - r.vec_id % 2 for r in got.values() if r.n_links)


def test_embedding_components_by_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 16))
    rows = [(int(i), v.tolist()) for i, v in enumerate(np.vstack((base, base[:10].repeat(4, axis=0) + 0.05 * rng.normal(size=(40, 16)))))]
    links, part = linked_by_force(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_near_dups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (links[i], part[i]) for i in links}


def test_embedding_identifier_on_several_vectors(spark):
    """Identifier 5 ties the copies of two texts that have nothing else in common."""
    a, b, c = ([float(x) for x in np.eye(8)[k]] for k in range(3))
    rows = [(9, a), (5, a), (5, b), (3, b), (7, c)]
    got = {(r.vec_id, r.component_id) for r in embedding_near_dups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(9, 3), (5, 3), (3, 3), (7, 7)}


PAGES = [
    ("http://a.example/1", "<html><body><nav>m1</nav><div class='top'>Site name</div><div class=post><p>First &amp; one<p>second <b>bold</b><br>line</div><div class='sidebar'>s</div><form>f</form></body>"),
    ("http://a.example/2", "<html><body><nav>m2</nav><div class='top'>Site name</div><div class=post><p>Other text</div><div class='sidebar'>t</div></body>"),
    ("http://a.example/3", "<html><body><nav>m3</nav><div class='top'>Site name</div><div class=post><p>Third text<p>more</div><div id='comments'>c</div></body>"),
    ("http://a.example/4", "<html><body><nav>m4</nav><div class='top'>Site name</div><div class=post><p>Fourth</div><footer>x</footer></body>"),
    *((f"http://a.example/{k}", f"<html><body><nav>m{k}</nav><div class='top'>Site name</div><div class=post><p>Text {k}</div></body>") for k in range(5, 9)),
    ("https://b.example/", "<body><header>H</header><article><header><h1>T</h1></header><p>x\n\t y<script>var a='</p>'</script><aside>no</aside><ul><li>i<li>j</ul><article class='comment'>reader</article></article><div>out</div>"),
    (None, None),
    ("not an address", ""),
    ("http://c.example", "plain < 3 & text <!-- never ends"),
    ("http://d.example", "<div>" * 4000 + "deep" + "</div>" * 4000),
]
TEXTS = ["First & one\n\nsecond bold line", "Other text", "Third text\n\nmore", "Fourth", "Text 5", "Text 6", "Text 7", "Text 8", "T\n\nx y\n\ni\n\nj", "", "", "plain < 3 & text", "deep"]


def test_html_extraction(spark):
    df = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(PAGES)], "page_id long, url string, html string, host string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.extract_main_text(df).collect()}
    assert [got[i] for i in range(len(PAGES))] == TEXTS
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


def test_html_query_against_articles(spark):
    import html
    import re

    rows = catalog.op9_html_extract(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def extracted(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    return [r.text for r in sorted(html_extract.extract_main_text(df).collect(), key=lambda r: r.page_id)]


def test_html_host_of_mixed_layouts(spark):
    """A page is not emptied because others of its host have an article or a paragraph of links."""
    pages = [(f"http://m.example/{k}", f"<body><div>out</div><article><p>Story {k}</article></body>") for k in range(6)]
    pages += [(f"http://m.example/{k}", f"<body><div class=content><p>Plain {k}</div></body>") for k in range(6, 26)]
    pages += [(f"http://l.example/{k}", f"<body><div class=content><p>A long text without links {k}</div></body>") for k in range(20)]
    pages += [("http://l.example/20", "<body><div class=content><p><a href=x>all of it</a></div></body>")]
    pages += [(f"http://l.example/{k}", f"<body><div class=list><p><a href=x>one {k}</a> and</div><div class=content><p>Words {k}</div></body>") for k in range(21, 30)]
    want = [f"Story {k}" for k in range(6)] + [f"Plain {k}" for k in range(6, 26)]
    want += [f"A long text without links {k}" for k in range(20)] + ["all of it"] + [f"Words {k}" for k in range(21, 30)]
    assert extracted(spark, pages) == want


def test_html_template_text_inside_articles(spark):
    """Blocks that most pages of a host repeat go, in articles and among varying siblings; copies of a page are one page."""
    pages = [(f"http://n.example/{k}", f"<body><article><h1>T{k}</h1><div class=box>Print this</div><p>One {k}<p>By our staff<p>Two {k}</article></body>") for k in range(9)]
    pages += [(f"http://p.example/{k}", f"<body><div class=post><p>One {k}<p>By our staff{'<p>More' * (k % 3 == 0)}</div></body>") for k in range(9)]
    pages += [(f"http://q.example/{k}", f"<body><div class=ad>a{k}</div><article><p>The same</article></body>") for k in range(5)]
    want = [f"T{k}\n\nOne {k}\n\nTwo {k}" for k in range(9)] + [f"One {k}" + "\n\nMore" * (k % 3 == 0) for k in range(9)] + ["The same"] * 5
    assert extracted(spark, pages) == want


def test_html_counts_all_pages(spark):
    """Constant text goes on hosts of three pages whatever their addresses, and in a rare layout of a large host."""
    pages = [(f"http://s{k // 3}.example/{k}", f"<body><div class=top>Site {k // 3}</div><div class=post><p>Text {k}</div></body>") for k in range(60)]
    rare = [k % 20 == 7 for k in range(100)]
    pages += [(f"http://big.example/{k}", f"<body><div class=post>{'<div class=box>Sign up</div>' * rare[k]}<p>Text {k}</div></body>") for k in range(100)]
    assert extracted(spark, pages) == [f"Text {k}" for k in [*range(60), *range(100)]]


def test_html_names_of_layout_wrappers(spark):
    """Names that only contain a furniture word hide nothing, nor does a furniture name around the page's article."""
    names = ["content has-sidebar", "no-sidebar", "with-nav", "search-result-page", "social-news", "search", "social"]
    pages = [(f"http://w.example/{k}", f"<body><div class='{n}'><article><p>Story {k}<div class=sidebar>side</div></article><div>side {k}</div></div></body>") for k, n in enumerate(names)]
    pages += [(f"http://v.example/{k}", f"<body><div class='{n}'><p>Plain {k}</div></body>") for k, n in enumerate(names[:5])]
    pages += [("http://c.example/1", "<body><div class=post>Text</div><div id=comments><article>A reader</article></div></body>")]
    pages += [("http://c.example/2", "<body><article>Text</article><div class=related><article>A teaser longer than all</article></div></body>")]
    assert extracted(spark, pages) == [f"Story {k}" for k in range(7)] + [f"Plain {k}" for k in range(5)] + ["Text", "Text"]


def test_simple_tree_match():
    a = ["r", [["x", [], 1], ["y", [["z", [], 3]], 2], ["x", [], 4]], 0]
    b = ["r", [["y", [["z", [], 2], ["w", [], 3]], 1], ["x", [], 4]], 0]
    assert html_extract.simple_tree_match(a, b) == (4, [(0, 0), (4, 4), (2, 1), (3, 2)])
    assert html_extract.simple_tree_match(a, ["q", [], 0]) == (0, [])


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = docs.where(F.length("text") > 200).limit(60).collect()
    pages = [(i, f"http://h{i % 3}.example/x", f"<html><p>{r.text}</p>", r.lang) for i, r in enumerate(known)]
    pages += [(100, "http://h.example/fr/1", None, "fr"), (101, "http://de.h.example/", "", "de"), (102, None, '<html lang="es-MX"><p>1 2 3', "es"), (103, None, None, None)]
    # codes say something only where pages with text have them
    pages += [(200 + i, f"http://www.k.example/{r.lang}/{i}", f'<html lang="{r.lang}"><p>{r.text}', r.lang) for i, r in enumerate(known)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, want string, host string").repartition(3)
    got = {r.page_id: r for r in identify_languages(df, docs).collect()}
    assert len(got) == len(pages)
    wrong = [i for i, *_, want in pages if want and got[i].lang != want]
    assert not wrong and got[103].lang is not None
    assert identify_languages(df.limit(0), docs).count() == 0
    assert identify_languages(df, docs.limit(0)).where("lang is not null").count() == 0
