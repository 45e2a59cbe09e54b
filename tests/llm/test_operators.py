"""The training-data operators against brute force, libraries or exact round trips, on tables with every odd row."""

import collections
import hashlib
import html as html_module
import os
import random
import struct
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SF, canonical
from veilframe.llm import bpe, html_text, matroska, ngram_join, packing, quality, queries, suffixes, token_count, vectors, warc
from veilframe.llm import components as component_module
from veilframe.llm.common import staged
from veilframe.llm.components import components, forest

DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("score", pa.string()), ("key", pa.int32()), ("n", pa.int64()), ("bucket", pa.string())])


def words(rng, n):
    return " ".join("".join(rng.choice(["the", "ing", "on", "é", "st", "a", "x1"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def odd_documents():
    rng = random.Random(3)
    base = words(rng, 300)
    near = base.split(" ")
    near[150] = "changed"
    passage = words(rng, 90)
    texts = [None, "", "   \n\t ", "one", "ONE", "one two", base, base, " ".join(near), base.upper(), words(rng, 40) + " " + passage + " " + words(rng, 30), passage + " " + passage, words(rng, 9000), "𝄞 naïve don't <|endoftext|> 's\r\n", "a" * 3000, "ab" * 700, "### &&& %%% $$$ " * 30]
    rows = [(i, t) for i, t in enumerate(texts)] + [(6, base), (0, None), (None, base), (-5, base + " tail")]
    return [(i, t, None if i == 3 else "en", "s", len(t or ""), "own", 1, 2, "b") for i, t in rows]


def write(folder, name, rows, schema):
    pq.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema), f"{folder}/{name}.parquet")


PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("path", pa.string()), ("host", pa.int32())])
EMBEDDINGS = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("rep", pa.int64()), ("size", pa.int64())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])


def odd_pages():
    same = "<p>" + "same words " * 20 + "</p>"
    rows = [(0, "http://a.b/x", None), (1, None, ""), (2, "http://a.b/y", same), (9, "http://a.b/z", same), (3, "", same), (3, "", same), (None, "http://a.b/\r\nX", same), (4, "no host", "<p>short</p>"), (5, "http://a.b/s", "<p>short</p>"), (6, "http://a.b/l", "<p>" + "long é " * 30000 + "</p>")]
    return [(*r, "p", 1) for r in rows]


def odd_vectors():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(30, 16))
    rows = []
    for i in range(240):
        rows.append((i, (centre[i % 30] + rng.normal(scale=0.09, size=16)).tolist(), i % 2))
    rows += [(300 + i, centre[0].tolist(), 0) for i in range(20)]
    rows += [(300, centre[0].tolist(), 0), (400, None, 0), (401, [0.0] * 16, 0), (402, [1.0] * 15 + [None], 0), (403, [1.0] * 15 + [float("nan")], 0), (404, [float("inf")] + [1.0] * 15, 0), (405, centre[0].tolist(), None), (406, [], 1), (407, [1.0, 0.0], 1), (408, [1.0, 0.01], 1), (None, centre[0].tolist(), 0), (410, (centre[1] * 1e20).tolist(), 1)]
    return [(*r, 1, 2) for r in rows]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    write(folder, "documents", odd_documents(), DOCS)
    write(folder, "pages", odd_pages(), PAGES)
    write(folder, "embeddings", odd_vectors(), EMBEDDINGS)
    write(folder, "labels", [(i, i % 2, None) for i in range(17)] + [(3, None, None), (None, 1, 1), (4, 1, 0)], LABELS)
    return folder


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", DOCS), ("pages", PAGES), ("embeddings", EMBEDDINGS), ("labels", LABELS)):
        write(folder, name, [], schema)
    return folder


def texts_of(folder):
    return duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()


def rows_of(spark, name, folder, *columns):
    return [tuple(r) for r in queries.QUERIES[name](spark, folder).select(*columns).collect()]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_pipeline_of_an_empty_table(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and canonical(ours, columns) == canonical(theirs, columns)


# 1: pages


def test_main_text():
    page = "<html><head><title>t</title></head><body><header>Top</header><div class='main-nav'>x</div><div class=content><h2>T&amp;x</h2><p>One <b>two</b>\n three<br>four<p>Five<ul><li>a<li>b</ul></div><div id=comments>no</div><script>if(a<b){}</script><form>f<input></form><footer>f</footer>"
    assert html_text.main_text(page) == "T&x\n\nOne two three four\n\nFive\n\na\n\nb"
    assert html_text.main_text("<article><header><h1>H</h1></header>x<aside>no</aside><table><tr><td>1<td>2</table></article>junk") == "H\n\nx\n\n1\n\n2"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<!-- only -->") == ""
    assert html_text.main_text("a < b &lt; c &nbsp; d") == "a < b < c d" and html_text.main_text("<p title='>'>x</p><p hidden>y</p>") == "x"
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep" and html_text.main_text("<p a='" + "x" * 50000) == "<p a='" + "x" * 50000


def test_site_tree_removes_what_a_host_repeats(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "http://h.org/", f"<body><div><span>Same line everywhere</span></div><div><p>{words(rng, 30)}</p><p>{words(rng, 20)}</p></div></body>") for i in range(40)]
    rows += [(100, "http://other.org/", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert not any("Same line" in t for i, t in found.items() if i < 100) and all(len(t.split("\n\n")) == 2 for i, t in found.items() if i < 100)
    assert "Same line" in found[100]  # one page is no template
    everything = spark.createDataFrame([(i, "http://h.org/", "<body><div>all the same</div></body>") for i in range(20)], "page_id long, url string, html string")
    assert {r["text"] for r in html_text.extract(everything).collect()} == {"all the same"}


def test_classes_that_number_pages_are_no_part_of_the_template(spark):
    rng = random.Random(9)
    own = [words(rng, 30) for _ in range(60)]
    pages = {
        "http://plain.org/": "<body><div class=top>Same line everywhere</div><div class=c2><p>{}</p></div></body>",
        "http://blog.org/": "<body class='post postid-{n} css-{n}x'><div class='top item-{n}'>Same line everywhere</div><div class='c2 build-{n}_x'><p>{}</p></div></body>",
    }
    rows = [(k * 1000 + i, url, page.format(own[i], n=i)) for k, (url, page) in enumerate(pages.items()) for i in range(60)]
    found = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {k * 1000 + i: " ".join(own[i].split()) for k in range(2) for i in range(60)}
    assert html_text.template_classes("post postid-17 css-1a2b_x  c2 p1234 ") == ["post", "postid-#", "css-#_x", "c2", "p#"]


def test_end_tags_that_close_nothing_take_no_time():
    begun = time.perf_counter()
    assert html_text.main_text("<div>" * 20_000 + "</x>" * 20_000 + "end") == "end"
    assert html_text.main_text("<x>" + "<div>" * 20_000 + "</x>" + "</div>" * 20_000 + "end") == "end"
    assert time.perf_counter() - begun < 10  # by a scan of the stack for each it was minutes


@pytest.mark.parametrize("most", [50_000, 0])
def test_importance_decides_inside_and_outside_of_articles(spark, monkeypatch, most):
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", most)  # beyond it, pages are joined with the low elements
    rng = random.Random(2)
    own = [words(rng, 30) for _ in range(80)]
    page = {
        "in.org": lambda t: f"<article><div class=c1><p>Boilerplate of the host</p></div><div class=c2><p>{t}</p></div></article>",
        "out.org": lambda t: f"<body><div class=t><article><a>Read this too</a></article></div><div class=c2><p>{t}</p></div></body>",
        "copies.org": lambda t: f"<main><p>{own[0]}</p></main><div class=c3>{t[:20]}</div>",
        "few.org": lambda t: f"<article><p>{t}</p></article>outside",
    }
    rows = [(h, i, f"http://{h}/", page[h](own[i])) for h in page for i in range(20 if h != "few.org" else 3)]
    df = spark.createDataFrame([(k, u, x) for k, (_, _, u, x) in enumerate(rows)], "page_id long, url string, html string")
    found = {rows[r["page_id"]][:2]: r["text"] for r in html_text.extract(df).collect()}
    plain = [" ".join(t.split()) for t in own]
    want = {"in.org": lambda i: plain[i], "out.org": lambda i: plain[i], "copies.org": lambda i: plain[0] + "\n\n" + " ".join(own[i][:20].split()), "few.org": lambda i: plain[i]}
    assert found == {(h, i): want[h](i) for h, i, _, _ in rows}


def test_names_of_wrappers_drop_no_article():
    text = html_text.main_text
    assert text("<div class='content has-sidebar'><article><p>One</p><div class='share-buttons'>no</div></article><div class=sidebar>no</div></div>") == "One"
    assert text("<div id='page' class='no-comments'><p>Most of the text</p><div class=comments>no</div></div><div>rest</div>") == "Most of the text\n\nrest"
    assert text("<main>One</main><ol class='comment-list'><li><article>much longer than the text itself</article></ol>") == "One"
    assert text("<div>The text without any article element</div><div class='related-posts'><article>Two</article></div>") == "The text without any article element\n\nTwo"
    assert text("<div class=widget><article>One</article></div>") == "One" and text("<div class=ad>a</div><div class=alert>b</div>") == "a\n\nb"


def test_pages_of_the_tables(spark, odd):
    found = {r["page_id"]: r for r in queries.QUERIES["op1_html_text"](spark, SF).collect()}
    for page_id, raw in duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall():
        article = regex.search(r"<article>(.*?)</article>", raw, regex.S)[1]
        blocks = [" ".join(html_module.unescape(regex.sub("<[^>]*>", " ", regex.sub("</?b>", "", b))).split()) for b in regex.split("</?(?:p|h1)>", article)]
        assert found[page_id]["text"] == "\n\n".join(b for b in blocks if b)
    got = rows_of(spark, "op1_html_text", odd, "page_id", "text", "n_chars")
    assert len(got) == 10 and (0, "", 0) in got and (1, "", 0) in got and all(len(t) == n for _, t, n in got)


# 2: quality


def test_quality_on_rows_that_were_held_out(spark):
    big = SF.replace("0.001", "0.01")
    found = {r["doc_id"]: r for r in queries.QUERIES["op2_quality"](spark, big).collect()}
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{big}/labels.parquet'").fetchall())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in found.items())
    test = [(found[i]["predicted"], q) for i, q in labels.items() if found[i]["held_out"]]
    assert len(test) > 100 and sum(p == q for p, q in test) / len(test) > 0.93


def test_scores_cover_whole_texts_and_do_not_depend_on_neighbours(spark, odd):
    rng = random.Random(2)
    clean = [words(rng, 60).encode() for _ in range(60)]
    junk = [b" | ".join(words(rng, 60).encode().split()) for _ in range(60)]
    net = quality.Network().fit(clean + junk, np.array([1] * 60 + [0] * 60, np.float32), epochs=30)
    score = lambda texts: net.scores(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert score(clean).mean() > 0.9 and score(junk).mean() < 0.1
    together = score([clean[0], b"", junk[0], clean[1] * 5])
    assert np.allclose(together, [float(score([t])[0]) for t in (clean[0], b"", junk[0], clean[1] * 5)], atol=1e-6)
    assert score([clean[0] * 40 + junk[0] * 60])[0] < score([clean[0] * 100])[0] - 0.3  # the end counts
    got = rows_of(spark, "op2_quality", odd, "doc_id", "score", "predicted")
    assert len(got) == 21 and all(0 <= s <= 1 for _, s, _ in got)
    assert quality.Network().fit([b"x"], np.ones(1)).scores(np.zeros(0, np.uint8), np.array([0, 0]))[0] == 1.0


# 3: BPE


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        return bpe.codec(file.read(), public_tokenizers.PATTERN)


def test_bpe_equals_the_library(spark, odd, codec):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for folder in (odd, SF):
        texts = collections.defaultdict(list)
        for i, t in texts_of(folder):
            texts[i].append(t or "")
        for doc_id, n, ids_sha, text_sha in rows_of(spark, "op3_bpe", folder, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"):
            ids = [library.encode_ordinary(t) for t in texts[doc_id]]
            assert (n, ids_sha) in [(len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest()) for x in ids]
            assert text_sha in [hashlib.sha256(t.encode()).hexdigest() for t in texts[doc_id]]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_bpe_round_trip(text):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        own = bpe.codec(file.read(), public_tokenizers.PATTERN)
    parts = list(own.encode(text))
    assert b"".join(map(own.decode, parts)) == text.encode()


def test_perfect_hash(codec):
    found = codec.hash.find(codec.tokens)
    assert (found == np.arange(len(codec.tokens))).all() and len(set(codec.hash.at.tolist())) == len(codec.tokens)
    assert (codec.hash.find([b"not a token at all", b"\xff\xfe\xfd\xfc"]) == -1).all() and len(codec.hash.find([])) == 0
    assert codec.hash.size == len(codec.tokens)


def test_a_full_cache_keeps_what_a_batch_needs(codec, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_LIMIT", 10)
    monkeypatch.setattr(bpe, "LONG", 2000)
    rng = random.Random(6)
    texts = [words(rng, 30), words(rng, 2000), words(rng, 300), None, words(rng, 2000), words(rng, 30)]
    own = bpe.Codec(codec.ranks, public_tokenizers.PATTERN)
    assert len(texts[2]) <= 2000 < len(texts[1])
    got = [b"".join(own.decode(part) for part in parts).decode() for parts in own.encode_all(texts)]
    assert got == [t or "" for t in texts]


def test_heap_merges_like_the_plain_loop(codec):
    rng = random.Random(3)

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            ranked = [(codec.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in codec.ranks]
            if not ranked:
                return [codec.ranks[p] for p in parts]
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for _ in range(400):
        piece = bytes(rng.choice(b"aethinso n\xc3\xa9") for _ in range(rng.randrange(1, 40)))
        assert bpe.heap_merge(piece, codec.ranks) == plain(piece)
    assert bpe.heap_merge(b"a" * 3000, codec.ranks) == plain(b"a" * 3000)


# 4: vectors


def brute_links(rows):
    good = [isinstance(v, list) and v and l is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, l in rows]
    out = []
    for a, (i, v, l) in enumerate(rows):
        out.append([b for b, (j, w, m) in enumerate(rows) if a != b and good[a] and good[b] and l == m and len(v) == len(w) and float(np.dot(np.float64(v), np.float64(w)) / np.linalg.norm(np.float64(v)) / np.linalg.norm(np.float64(w))) >= 0.93])
    return out


def brute_components(n, links, ids):
    seen, component = {}, {}
    for a in range(n):
        if a in seen:
            continue
        group, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in group:
                    group.add(b)
                    todo.append(b)
        known = [ids[g] for g in group if ids[g] is not None]
        for g in group:
            seen[g] = component[g] = min(known) if known else None
    return component


@pytest.mark.parametrize("block, cell", [(1024, 4000), (16, 20)])
def test_vectors(spark, odd, monkeypatch, block, cell):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "CELL_ROWS", cell)
    rows = [(i, None if v is None else list(v), l) for i, v, l in duckdb.sql(f"SELECT vec_id, embedding, label FROM '{odd}/embeddings.parquet'").fetchall()]
    links = brute_links(rows)
    component = brute_components(len(rows), links, [r[0] for r in rows])
    want = sorted(((i, len(links[k]), component[k]) for k, (i, _, _) in enumerate(rows)), key=str)
    for slack in (1.0, vectors.SLACK):
        got = vectors.near_duplicates(spark.read.parquet(f"{odd}/embeddings.parquet"), slack=slack).collect()
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
        found = sum(r["n_links"] for r in got) / sum(w[1] for w in want)
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == want if slack == 1 else 0.9 <= found <= 1


def test_links_across_cells_are_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 40)
    rng = np.random.default_rng(12)
    rows = [(i, v, i % 2) for i, v in enumerate(rng.normal(size=(600, 3)).tolist())]  # copies differ along few dimensions
    links = brute_links(rows)
    component = brute_components(len(rows), links, [r[0] for r in rows])
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(i, len(links[i]), component[i], component[i] == i) for i in range(600)]


def test_every_link_at_the_threshold_is_found(spark):
    """The query's own parameters, with eight cells; random vectors of 64 dimensions have no other links."""
    rng = np.random.default_rng(19)
    base = rng.normal(size=(16100, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.931, 0.95, (len(base), 1))
    both = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * side])
    assert len(both) // vectors.CELL_ROWS >= 8
    data = pa.table({"vec_id": np.arange(len(both)), "embedding": pa.array(list(both)), "label": np.zeros(len(both), np.int64)})
    got = vectors.near_duplicates(spark.createDataFrame(data)).toArrow()
    ids, n, component = (got.column(c).to_numpy() for c in ("vec_id", "n_links", "component_id"))
    assert (n == 1).all() and (component == ids % len(base)).all()


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.931, 0.95, (len(base), 1))
    both = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * side])
    centres = vectors.spherical_kmeans(both[rng.permutation(len(both))], 40)
    home, row, cell = vectors.visits(both, centres, vectors.distances(centres), vectors.SLACK * np.sqrt(2 - 2 * 0.93))
    goes = {*zip(row.tolist(), cell.tolist())} | {*enumerate(home.tolist())}
    met = [(i, int(home[i + 1500])) in goes or (i + 1500, int(home[i])) in goes for i in range(1500)]
    assert np.mean(met) >= 0.9


@pytest.mark.parametrize("hot", [2, 1000])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(component_module, "HOT", hot)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1400)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5, 5), (-3, 2000)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame([*edges, (None, 1)], "a long, b long").repartition(7)).collect()}
    graph = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            graph[a].add(b)
            graph[b].add(a)
    for start in graph:
        group, todo = {start}, [start]
        while todo:
            new = graph[todo.pop()] - group
            group |= new
            todo += new
        assert found[start] == min(group)
    assert set(found) == set(graph)
    member, root = forest(np.array([3, 2, 9]), np.array([2, 1, 8]))
    assert dict(zip(member.tolist(), root.tolist())) == {2: 1, 3: 1, 9: 8}


# 5: media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1024, 1025, 8192, 9000, 131072, 131073, 400000])
def test_media_round_trip(n):
    text = random.Random(n).randbytes(n)
    blob = matroska.store_text(text)
    media = matroska.parse(blob)
    samples = matroska.read_samples(blob, media)
    assert samples == text + bytes(-n % 64 if n else 64) and len(samples) % 64 == 0 and samples
    assert {at for _, _, at in media.cues} == set(media.clusters) and media.tracks[1]["codec"] == "A_PCM/INT/LIT" and media.tracks[1]["bits"] == 8
    times = [p[1] for p in media.packets]
    assert times == sorted(times) and all(blob[o : o + k] for _, _, o, k, *_ in media.packets)


def test_media_of_other_writers():
    e, num = matroska.element, matroska.number
    block = lambda flags, body: e(matroska.SIMPLE_BLOCK, b"\x81\x00\x05" + bytes([flags]) + body)
    xiph = bytes([2]) + bytes([255, 45]) + bytes([1]) + b"a" * 300 + b"b" + b"cc"
    ebml = bytes([2]) + b"\x83" + matroska.vint(-1 + 63, 1) + b"aaa" + b"bb" + b"c"
    fixed = bytes([1]) + b"xxyy"
    group = e(matroska.BLOCK_GROUP, e(matroska.BLOCK, b"\x81\x00\x09\x00" + b"grp") + num(matroska.BLOCK_DURATION, 40))
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + num(matroska.TIMESTAMP, 100) + block(0x82, xiph) + block(0x86, ebml) + block(0x84, fixed) + group
    cues = e(matroska.CUES, e(matroska.CUE_POINT, num(matroska.CUE_TIME, 100) + e(matroska.CUE_TRACK_POSITIONS, num(matroska.CUE_TRACK, 1) + num(matroska.CUE_CLUSTER_POSITION, 0))))
    data = matroska.HEADER + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + cues
    media = matroska.parse(data)
    assert [data[o : o + n] for _, _, o, n, *_ in media.packets] == [b"a" * 300, b"b", b"cc", b"aaa", b"bb", b"c", b"xx", b"yy", b"grp"]
    assert media.packets[0][1] == 105_000_000 and media.packets[-1][1] == 109_000_000 and media.cues == [(100, 1, media.clusters[0])]
    for broken in (b"", b"\x00", data[:40], matroska.HEADER + data[60:90], b"RIFF"):
        with pytest.raises(ValueError):
            if not matroska.parse(broken).packets:
                raise ValueError


def test_media_rows(spark, odd):
    got = rows_of(spark, "op5_media", odd, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature")
    texts = collections.defaultdict(list)
    for i, t in texts_of(odd):
        texts[i].append((t or "").encode())
    assert len(got) == 21
    for i, n, size, sha, tail, _ in got:
        payloads = [t + bytes(-len(t) % 64 if t else 64) for t in texts[i]]
        assert (n, size, sha, tail) in [(len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for t, p in zip(texts[i], payloads)]
    media = spark.createDataFrame([(1, bytearray(matroska.store_text(b"x" * 5000))), (2, bytearray(b"broken")), (3, None)], "i long, m binary")
    table = matroska.packets(media, "i", "m").collect()
    assert sum(r["byte_length"] for r in table if r["id"] == 1) == 5056 and [r["error"] is not None for r in table if r["id"] == 2] == [True] and not [r for r in table if r["id"] == 3]


# 6: packing


def check_packing(rows, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts}
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for doc, start, length, crc, total, sequence, offset in rows:
        assert zlib.crc32(struct.pack(f"<{length}I", *ids[doc][start : start + length])) == crc and total == len(ids[doc])
        by_sequence[sequence].append((offset, length))
        by_doc[doc].append((start, length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    copies = collections.Counter(i for i, _ in texts)
    for doc, own in by_doc.items():
        assert sum(n for _, n in own) == copies[doc] * len(ids[doc]) and all(c == copies[doc] for c in collections.Counter(own).values())
    assert set(by_doc) == set(copies)
    return sum(r[2] for r in rows) / 2048 / len(by_sequence)


COLUMNS6 = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_packing(spark, odd):
    check_packing(rows_of(spark, "op6_packing", odd, *COLUMNS6), texts_of(odd))
    big = SF.replace("0.001", "0.01")
    assert check_packing(rows_of(spark, "op6_packing", big, *COLUMNS6), texts_of(big)) > 0.97


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_shortest_pack_first(histogram):
    groups = packing.shortest_pack_first(dict(histogram), 64)
    assert all(sum(g) <= 64 and n > 0 for g, n in groups)
    placed = collections.Counter()
    for lengths, n in groups:
        for length in lengths:
            placed[length] += n
    assert placed == collections.Counter(histogram)
    laid = packing.slots(groups)
    assert all((np.diff(rows[:, 0]) > 0).all() and rows[0, 0] == 0 for rows in laid.values())


# 7: suffixes


def brute_spans(texts, length, words=None):
    raw = [(t or "").encode() for _, t in texts]
    count = collections.Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    runs = []
    for b in raw:
        at = [m.span() for m in regex.finditer(rb"[^\x20\x09-\x0D]+", b)]
        runs.append([(x[0], y[1]) for x, y in zip(at, at[words - 1 :])] if words else [])
    again = collections.Counter(b[x:y] for b, own in zip(raw, runs) for x, y in own)
    out = []
    for b, own in zip(raw, runs):
        gone = np.zeros(len(b) + 1, int)
        for x, y in own:
            if again[b[x:y]] > 1:
                gone[x] += 1
                gone[y] -= 1
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        out.append((b, np.cumsum(gone)[:-1] > 0))
    return out


def test_suffixes(spark, odd):
    for folder in (odd, SF):
        texts = texts_of(folder)
        want = sorted(str((i, len(b), int(m.sum()), int((np.diff(np.r_[0, m.astype(int)]) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~m])).hexdigest())) for (i, _), (b, m) in zip(texts, brute_spans(texts, 400)))
        assert sorted(map(str, rows_of(spark, "op7_suffixes", folder, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))) == want
        left = sorted(str((i, bytes(np.frombuffer(b, np.uint8)[~m]).decode("utf-8", "ignore"))) for (i, _), (b, m) in zip(texts, brute_spans(texts, 200, 51)))
        assert sorted(map(str, rows_of(spark, "op7_suffixes", folder, "doc_id", "text"))) == left


def test_longer_strings_from_shorter_ones(spark):
    """With small buckets and slices and over many partitions; texts of few letters, whose hashes have structure."""
    rng = random.Random(12)
    thue = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    texts = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(600)))) for i in range(40)] + [(50, thue), (51, thue.translate({97: 98, 98: 97})), (52, thue[100:1500]), (None, thue[3000:]), (53, None), (54, "")]
    texts += [(60 + i, texts[i][1] + texts[i + 1][1][:420]) for i in range(20)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    got = suffixes.removed(df, length=90, passage=30).collect()
    want = sorted(str((i, int(m.sum()), int((np.diff(np.r_[0, m.astype(int)]) == 1).sum()))) for (i, _), (b, m) in zip(texts, brute_spans(texts, 90)))
    assert sorted(str((r["doc_id"], r["n_removed"], r["n_spans"])) for r in got) == want
    assert suffixes.removed(df, length=90, passage=30).filter("n_bytes <> octet_length(text)").count() == sum(bool(m.any()) for _, m in brute_spans(texts, 30))


@pytest.mark.parametrize("length", [40, 100, 400])
def test_repeats_of_any_place_and_length(spark, length):
    rng = random.Random(length)
    shared = rng.randbytes(length + 60).hex()[: length + 60]
    docs = []
    for i in range(60):
        own = rng.randbytes(300).hex()
        size = rng.randrange(length - 5, length + 40)
        begin = rng.randrange(0, 20)
        at = rng.randrange(0, 500)
        docs.append((i, own[:at] + shared[begin : begin + size] + own[at:]))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = {i: bytes(np.frombuffer(b, np.uint8)[~m]).decode() for (i, _), (b, m) in zip(docs, brute_spans(docs, length))}
    assert {r["doc_id"]: r["text"] for r in suffixes.without_repeats(df, length).collect()} == want
    v, cover = suffixes.difference_cover(length)
    assert {(a - b) % v for a in cover.tolist() for b in cover.tolist()} == set(range(v)) and v <= length


# 8: token counts


@pytest.fixture(scope="module")
def counter():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as file:
        return token_count.counter(file.read())


def library_counts(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(spark, odd, counter):
    rng = random.Random(8)
    letters = "ab  cdeé\n\t'strellvmd01<|>!?$𝄞ż中İΣςß́​\xa0'''the"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2000)] + ["x" * 5000, "thethe" * 3000, "the'll've's don't o''s <|endoftext|>a<|startoftext|>'s", "", "'", "a'", "'re"]
    assert counter.count(texts).tolist() == library_counts(texts)
    assert [int(counter.count([t])[0]) for t in texts[:100]] == counter.count(texts[:100]).tolist()
    for folder in (odd, SF):
        rows = [(i, t or "") for i, t in texts_of(folder)]
        want = sorted(str((i, len(t.encode()), n, n > 2048)) for (i, t), n in zip(rows, library_counts([t for _, t in rows])))
        assert sorted(map(str, rows_of(spark, "op8_token_counts", folder, "doc_id", "n_bytes", "n_tokens", "over_limit"))) == want


@pytest.mark.parametrize("width", [0, 1, 32])
def test_long_words(counter, monkeypatch, width):
    """Words over many chunks, of several in one batch, with periods that keep maps from becoming constant."""
    monkeypatch.setattr(token_count, "WIDTH", width)
    rng = random.Random(width)
    texts = ["a" * 5000, "ab" * 3000 + " x", "".join(rng.choice("thesingo") for _ in range(20000)), "aab" * 900 + " " + "xyz" * 700 + "!" * 600, "é" * 1000, "!?" * 2000, "short words " * 50]
    texts += ["".join(rng.choice("aab") for _ in range(rng.randrange(3000))) for _ in range(10)]
    assert counter.count(texts).tolist() == library_counts(texts)
    assert counter.count([t for t in reversed(texts)]).tolist() == library_counts(texts)[::-1]


def test_a_flushed_transducer_counts_the_same(counter, monkeypatch):
    texts = [t for _, t in texts_of(SF)[:60]]
    before = counter.count(texts)
    monkeypatch.setattr(token_count, "STATE_LIMIT", 10)
    assert (counter.count(texts) == before).all() and (counter.count(texts) == before).all()


@pytest.mark.parametrize("piece", [1, 5, 64])
def test_states_are_bounded_inside_a_word(counter, monkeypatch, piece):
    """Pieces of one word follow each other; only what is in use stays when there are too many states."""
    monkeypatch.setattr(token_count, "STATE_LIMIT", 1500)
    monkeypatch.setattr(token_count, "PIECE", token_count.CHUNK * piece)
    counter.machine.reset()
    rng = random.Random(piece)
    most, number = 0, counter.machine.number

    def watched(state):
        nonlocal most
        most = max(most, len(counter.machine.states))
        return number(state)

    monkeypatch.setattr(counter.machine, "number", watched)
    texts = ["".join(rng.choice("etaoinshrdlu") for _ in range(12_000)), "short words", "".join(rng.choice("abc ") for _ in range(3000)), "ab" * 4000 + "'s"]
    assert counter.count(texts).tolist() == library_counts(texts)
    assert 1500 <= most < 1500 + 2 * 64
    monkeypatch.setattr(token_count, "STATE_LIMIT", 60_000)
    monkeypatch.setattr(token_count, "PLACE_LIMIT", 3000)
    assert counter.count(texts).tolist() == library_counts(texts)


# 9: n-grams


def brute_groups(texts, n, percent):
    sets = []
    for _, t in texts:
        w = regex.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    links = [[] for _ in texts]
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links[a].append(b)
                links[b].append(a)
    component = brute_components(len(texts), links, [i for i, _ in texts])
    return sorted(str((i, len(sets[k]), component[k])) for k, (i, _) in enumerate(texts))


def near_copies():
    rng = random.Random(6)
    out = []
    for group in range(12):
        base = words(rng, rng.choice([3, 8, 20, 60, 200])).split(" ")
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                copy[rng.randrange(len(copy))] = words(rng, 1)
            out.append((len(out), " ".join(copy)))
    return out


@pytest.mark.parametrize("n, percent, rows, hot", [(3, 90, 4, 1000), (5, 80, 4, 3), (1, 50, 2, 1000)])
def test_jaccard(spark, odd, n, percent, rows, hot, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", rows)
    monkeypatch.setattr(component_module, "HOT", hot)
    for texts in (texts_of(odd), near_copies()):
        df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
        assert sorted(str(tuple(r)) for r in ngram_join.jaccard_groups(df, n, percent).collect()) == brute_groups(texts, n, percent)


def test_a_common_line_does_not_multiply_all_sets(spark, monkeypatch):
    rng, texts, laid = random.Random(11), [], []
    line = words(rng, 24)
    for _ in range(150):
        own = words(rng, 60).split(" ")
        texts.append((len(texts), f"{line} {' '.join(own)}"))
        own[30] = "other"
        texts.append((len(texts), f"{line} {' '.join(own)}"))
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ngram_join, "WHOLE_BLOCKS", 1, raising=False)
    multiply = ngram_join.products
    monkeypatch.setattr(ngram_join, "products", lambda sets, rows, percent: laid.append(rows.count()) or multiply(sets, rows, percent))
    got = ngram_join.jaccard_groups(spark.createDataFrame(texts, "doc_id long, text string"), 5, 80).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_groups(texts, 5, 80)
    assert sum(laid) <= 2 * len(texts)


def test_prefixes_share_an_ngram_of_linked_sets():
    rng = np.random.Generator(np.random.PCG64(3))
    for percent in (50, 80, 90):
        for _ in range(300):
            base = rng.permutation(60)[: rng.integers(1, 60)].astype(np.uint64)
            a, b = base[rng.random(len(base)) < 0.95], np.concatenate([base[rng.random(len(base)) < 0.95], 60 + rng.permutation(4)[: rng.integers(0, 4)].astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                name = np.concatenate([a, b])
                kept = ngram_join.prefixes(np.array([len(a), len(b)]), name, 2 + rng.integers(0, 5, 64)[name.astype(int)], percent)
                assert np.intersect1d(a[kept[: len(a)]], b[kept[len(a) :]]).size


def test_jaccard_query(spark):
    assert sorted(map(str, rows_of(spark, "op9_jaccard", SF, "doc_id", "n_shingles", "component_id"))) == brute_groups(texts_of(SF), 3, 90)


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 3000), st.sampled_from([50, 80, 90, 95]))
def test_linked_sizes_are_in_neighbouring_classes(size, percent):
    begin = ngram_join.size_classes(6000, percent)
    other = 100 * size // percent
    assert np.searchsorted(begin, other, side="right") - np.searchsorted(begin, size, side="right") <= 1


# 10: WARC


def test_warc(spark, odd):
    rows = duckdb.sql(f"SELECT page_id, html FROM '{odd}/pages.parquet'").fetchall()
    first = {}
    for i, h in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and i != first.get(h)
        want.append(str((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None)))
    assert sorted(map(str, rows_of(spark, "op10_warc", odd, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))) == sorted(want)


def test_archives_are_rebuilt_exactly(spark, odd):
    heads, store = warc.write_archive(spark.read.parquet(f"{odd}/pages.parquet"))
    assert store.count() == store.select("payload_digest").distinct().count() == 4
    records = warc.reconstruct(heads, store).collect()
    parsed = list(warc.parse_records(b"".join(bytes(r["record"]) for r in records)))
    assert len(parsed) == 10
    for fields, payload in parsed:
        assert payload == b"" if fields["warc-type"] == "revisit" else fields["warc-payload-digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
    damaged = store.withColumn("payload", store["payload"].substr(2, 1000))
    with pytest.raises(Exception, match="missing or damaged"):
        warc.read_archive(heads, damaged).collect()
    for broken in (b"WARC/1.1\r\n", b"nothing\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_records(broken))


def test_the_query_reads_reconstructed_records(spark, odd, monkeypatch):
    whole = warc.reconstruct
    monkeypatch.setattr(warc, "reconstruct", lambda *tables: whole(*tables).withColumn("record", F.expr("substr(record, 1, length(record) - 2)")))
    with pytest.raises(Exception, match="malformed"):
        warc.op10_warc(spark, odd).collect()


# the pipeline


def test_pipeline_stages(spark, odd):
    big = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    columns = docs.columns
    good = staged(corpus_pipeline.good_documents(spark, docs, big))
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{big}/labels.parquet'").fetchall())
    kept = {r["doc_id"] for r in good.collect()}
    assert good.columns == columns and np.mean([(i in kept) == (q == 1) for i, q in labels.items()]) > 0.93
    one = staged(corpus_pipeline.distinct_documents(spark, good, big))
    texts = [(r["doc_id"], r["text"]) for r in good.collect()]
    want = {eval(x)[0] for x in brute_groups(texts, 5, 80) if eval(x)[0] == eval(x)[2]}
    assert {r["doc_id"] for r in one.collect()} == want and one.columns == columns
    clean = staged(corpus_pipeline.without_repeated_passages(spark, one, big))
    texts = [(r["doc_id"], r["text"]) for r in one.collect()]
    left = {i: bytes(np.frombuffer(b, np.uint8)[~m]).decode("utf-8", "ignore") for (i, _), (b, m) in zip(texts, brute_spans(texts, corpus_pipeline.PASSAGE))}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean.collect()} == {i: (t, len(t)) for i, t in left.items() if t.strip(" \t\n\x0b\f\r")}
    packed = [tuple(r) for r in corpus_pipeline.packed_sequences(spark, clean, big).select(*COLUMNS6).collect()]
    check_packing(packed, [(r["doc_id"], r["text"]) for r in clean.collect()])


def test_one_of_each_group_by_rows(spark):
    rng = random.Random(4)
    a, b, c, d, e, f = (words(rng, 60) for _ in range(6))
    rows = [(None, a), (None, b), (1, c), (1, d), (2, c), (None, d), (3, e), (3, e), (None, f), (4, f), (5, ""), (5, None), (None, "")]
    got = ngram_join.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, a), (None, b), (1, c), (1, d), (3, e), (4, f), (5, ""), (5, None), (None, "")]))


def test_repeated_passages_of_short_words(spark):
    rng = random.Random(13)
    own = lambda: " ".join(f"{rng.randrange(10**9):09d}" for _ in range(20))
    digits = " ".join(f"{rng.randrange(100):02d}" for _ in range(52)).split(" ")
    over, under = " ".join(digits[:51]), "é" + " ".join(digits[1:50])
    texts = [own() + " " + over + " " + own(), over, "x\t" + over + "\n" + own(), under + " " + own(), own() + " " + under, " ".join(digits[:2]), None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_repeated_passages(spark, df, SF).collect()}
    assert got == {i: t.replace(over, "") for i, t in enumerate(texts) if t and t != over}


def test_pipeline_on_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = staged(stage(spark, docs, odd))
        assert after.columns == docs.columns and after.dtypes == docs.dtypes and {r["score"] for r in after.collect()} <= {"own"}
        docs = after
    assert corpus_pipeline.run(spark, odd).count() > 0


def test_shared_folder_is_the_sessions(spark):
    from veilframe.llm.common import shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/") and os.path.isdir(shared_dir(spark).removeprefix("file:"))


def test_links_inside_of_batches_are_spread():
    seen = collections.Counter(ngram_join.local_bucket(part, number, 16) for part in range(100) for number in range(5))
    assert set(seen) == set(range(-16, 0)) and max(seen.values()) < 3 * min(seen.values())


def test_a_vocabulary_with_merges_out_of_order_is_refused():
    import json

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        spec = json.loads(file.read())
    assert packing.encoder(json.dumps(spec).encode())
    spec["model"]["merges"][5:7] = reversed(spec["model"]["merges"][5:7])
    with pytest.raises(ValueError, match="order of its ids"):
        packing.encoder(json.dumps(spec).encode())
