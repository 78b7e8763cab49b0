"""Site style trees, archives, nearest neighbours and the pipeline."""

import base64
import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pagewise.llm import chosenpath, forest, packing, quality, sitetree, warc

PAGE = "page_id long, url string, html string"


def text_of(html):
    return " ".join(block[0] for block in sitetree.read_page(html)[0])


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<nav>menu</nav><article><h1>T &amp; U</h1><p>one <b>tw</b>o<br>three<p>four</article><footer>f</footer>", "T & U one two three four"),
        ("<article>a<div class='ad'>x</div><form>f<input></form><section id=comments><p>c</section>b</article>", "a b"),
        ("<header>site</header><main><p>body</main><aside>s</aside><div class=cookie-notice>n</div>", "body"),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><p>x &lt; y<!-- <p>no --></p>", "x < y"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
        ("a < b and <b>c", "a < b and c"),
        ("", ""),
    ],
)
def test_page_text(html, text):
    assert text_of(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<body class='has-sidebar'><p>text</body>", "text"),
        ("<body class='header-fixed no-comments'><div><p>text</div></body>", "text"),
        ("<body class=sidebar><main class='search' id=menu><p>text</main></body>", "text"),
        ("<article class='post comments-open'><p>text<div class='comments'>c</div></article>", "text"),
        ("<article class='post'>text<article class='comment'>c</article></article>", "text"),
        ("<article>text<ol class='comment-list'><article class='comment'>c</article></ol></article>", "text"),
        ("<div class='overflow-hidden'>text</div><div class=hidden>h</div><div id=ad-12>a</div><p hidden>i", "text"),
    ],
)
def test_page_text_under_classes_with_noise_words(html, text):
    assert text_of(html) == text


def test_classes_that_contain_a_noise_word_are_judged(spark):
    def html(i):
        return f"<body class='has-sidebar'><div class='no-sidebar'><p>Own words {i}</div><div class='share-box'>Share</div><p class='site-copyright'>All rights</body>"

    got = sitetree.main_text(spark.createDataFrame([(i, f"http://h.example/{i}", html(i)) for i in range(8)], PAGE)).collect()
    assert {r.text for r in got} == {f"Own words {i}" for i in range(8)}


def test_unnamed_repeated_branches_go(spark):
    def html(i):
        return f"<body><div id=x1><p>Same words on every page</div><div id=x2><p>Own words {i}</div></body>"

    rows = [(i, f"http://h.example/{i}", html(i)) for i in range(8)] + [(20, None, None), (21, "http://o.example/", html(1)), (22, "http://h.example/e", "")]
    got = {r.page_id: r for r in sitetree.main_text(spark.createDataFrame(rows, PAGE)).collect()}
    assert len(got) == len(rows)
    assert got[3].text == "Own words 3" and got[3].n_chars == 11
    assert got[21].text == "Same words on every page Own words 1"
    assert got[20].text == "" and got[22].n_chars == 0
    assert sitetree.main_text(spark.createDataFrame([], PAGE)).count() == 0


def test_archives_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * (1 + i % 3)) for i in range(60)]
    rows += [(100, None, None), (101, "http://a b/\r\nX: y", ""), (102, "u", "é" * 50000), (102, "u", "é" * 50000), (None, "u", "only")]
    pages = spark.createDataFrame(rows, PAGE).repartition(5)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/a", span=8, roll_bytes=1500)
    records = warc.read_archives(manifest, f"file://{tmp_path}/a").collect()
    by_payload = {}
    for i, _, html in rows:
        by_payload.setdefault(html or "", []).append(-1 if i is None else i)
    expected = Counter()
    for i, _, html in rows:
        top, data = max(by_payload[html or ""]), (html or "").encode()
        own = -1 if i is None else i
        kind = "response" if own == top else "revisit"
        expected[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, None if own == top else top)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records) == expected
    payloads = {r.page_id: r.payload.decode() for r in records if r.record_type == "response"}
    assert payloads[102] == "é" * 50000 and payloads[101] == ""
    assert max(r.number for r in manifest.collect()) > 0
    again = warc.write_archives(pages.repartition(3), f"file://{tmp_path}/b", span=8, roll_bytes=1500)
    assert Counter((r.name, r.sha1) for r in again.collect()) == Counter((r.name, r.sha1) for r in manifest.collect())
    empty = warc.write_archives(pages.limit(0), f"file://{tmp_path}/c")
    assert warc.read_archives(empty, f"file://{tmp_path}/c").count() == 0


def test_neighbours_recall_and_odd_vectors(spark):
    draw = np.random.default_rng(2)
    vectors = draw.normal(size=(3000, 16))
    rows = [(int(i), [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    rows += [(5000, None, 1), (5100, [0.0] * 16, 1), (5200, [float("nan")] * 16, 1), (None, rows[0][1], 1), (6000, rows[100][1], 1), (6000, rows[100][1], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = forest.neighbours(frame, search_rows=100, search_share=0.75).collect()
    kept = {i: np.array(v, dtype=np.float32).astype(float) for i, v, _ in rows if i is not None and i < 5000 or i == 6000}
    ids = np.array(list(kept))
    matrix = np.stack(list(kept.values()))
    hits = 0
    for query in (i for i in kept if i % 100 == 0):
        score = np.sqrt(((matrix - kept[query]) ** 2).sum(axis=1))
        best = [i for _, i in sorted(zip(score, ids, strict=True)) if i != query][:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == query)
        assert [r[0] for r in mine] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((kept[v] - kept[query]) ** 2).sum())) < 1e-12 for _, v, s in mine)
        hits += len(set(best) & {v for _, v, _ in mine})
    assert hits / (10 * 31) >= 0.9
    assert forest.neighbours(frame.limit(0)).count() == 0
    few = forest.neighbours(frame.filter("vec_id in (0, 1, 2)")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2)]


def test_neighbours_beside_a_vector_of_a_third_of_the_rows(spark):
    draw = np.random.default_rng(6)
    vectors = draw.normal(size=(8000, 24)).astype(np.float32)
    vectors[0], vectors[1] = 0.0, -0.0
    vectors[:2, 0] = 1.0  # equal but for the sign of zeros
    ids = np.concatenate([np.arange(1, 8001), np.arange(20_000, 24_000)])
    every = np.concatenate([vectors, np.repeat(vectors[:1], 4000, axis=0)])
    rows = [(int(i), v.tolist()) for i, v in zip(ids, every, strict=True)]
    frame = spark.createDataFrame([*rows, *rows[-500:]], "vec_id long, embedding array<float>")
    got = {}
    for r in forest.neighbours(frame, search_rows=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    hits = []
    for query, mine in got.items():
        score = np.sqrt(((every.astype(float) - every[ids == query][0]) ** 2).sum(axis=1))
        order = np.lexsort((ids, score))
        best = [int(i) for i in ids[order] if i != query][:10]
        found = [i for _, i, _ in sorted(mine)]
        assert len(set(found)) == 10
        if query >= 20_000:  # a copy: the copies with the smallest ids, itself left out
            assert found == best == [1, 2, *range(20_000, 20_009)][:10] if query > 20_008 else found == best
        else:
            hits.append(len(set(best) & set(found)))
    assert np.mean(hits) >= 9 and min(hits) >= 5


def test_pipeline_takes_every_decision(spark, tmp_path):
    from tests.llm.test_text_operators import brute_components, odd_rows, prose

    rows = [r for r in odd_rows() if r[0] is not None] + [(200 + i, prose(200 + i) + " mail me.1@mail.example.com", "en", "b", 1) for i in range(5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    classes = brute_components([r for r in rows if r[0] in kept])
    expected = {i for i, (_, c) in classes.items() if i == c}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == expected
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "personal data", "source weights", "packing"]
    one = [f for name, f in corpus_pipeline.STAGES if name == "near duplicates"][0]
    assert one(spark, docs, str(tmp_path)).columns == docs.columns
    assert packing.WINDOW == 1024 and chosenpath.SHINGLE == 5


def test_pipeline_links_documents_alike_by_four_fifths(spark, tmp_path):
    from tests.llm.test_text_operators import prose, shingles

    rows = [(200 + i, prose(200 + i), "en", "b", 1) for i in range(30)]
    for i in range(15):  # two of 120 words changed: 0.80 to 0.85
        near = rows[i][1].split(" ")
        near[30], near[70] = "changed", "words"
        rows.append((300 + i, " ".join(near), "en", "b", 1))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    sets = {i: shingles(t) for i, t, *_ in rows}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert sum(0.80 <= x < 0.85 for x in alike.values()) == 15
    expected = set(sets) - {b for (_, b), x in alike.items() if x >= 0.80}
    one = dict(corpus_pipeline.STAGES)["near duplicates"]
    assert {r.doc_id for r in one(spark, docs, str(tmp_path)).collect()} == expected
    assert {r.doc_id for r in chosenpath.near_duplicates(docs).filter("kept").collect()} == set(sets)
