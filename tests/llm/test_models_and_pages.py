"""Codec, pages, neighbours, archives, classifier and pipeline against plain versions."""

import hashlib
import itertools
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrove.llm import ann, html_text, quality_classifier, sentencepiece_codec, warc

tokenizers = pytest.importorskip("public_tokenizers")
MODEL = tokenizers.path("piece_bpe_32k.model")


def rows(df):
    return [r.asDict() for r in df.collect()]


# SentencePiece


def best_score(codec, text):
    """The best sum of scores over all segmentations, by trying every cut."""
    score = {p: s for p, s, k in zip(codec.pieces, codec.scores, codec.kinds, strict=True) if k in (1, 4)}
    best = [0.0] + [-1e300] * len(text)
    for b in range(1, len(text) + 1):
        for a in range(b):
            s = score.get(text[a:b], codec.penalty if b - a == 1 else -1e300)
            best[b] = max(best[b], best[a] + s)
    return best[-1]


@pytest.mark.parametrize("text", ["the of", "a  b   c", " lead", "trail ", "internationalisation über 123", "日本語 \U0001f600\n\tx", "▁▁a ▁", "\x00\x01", "aaaaaaaaaaaaaaa"])
def test_encoding_is_the_best(text):
    codec = sentencepiece_codec.model(MODEL)
    ids = codec.encode(text)
    used = sum(codec.scores[i] for i in ids if codec.kinds[i] == 1)
    missing = {c for c in "▁" + text.replace(" ", "▁") if c not in codec.pieces}
    got = used + codec.penalty * sum(c in missing for c in text)
    assert abs(got - best_score(codec, "▁" + text.replace(" ", "▁"))) < 1e-6
    assert codec.decode(ids) == text.replace("▁", " ")


def test_library_decodes_the_same():
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    codec = sentencepiece_codec.model(MODEL)
    for text in ("Hello  world", "é\U0001f600 z", "x\ny"):
        assert library.decode(codec.encode(text).tolist()) == codec.decode(codec.encode(text)) == text


def test_trie_finds_all_keys():
    rng = random.Random(1)
    keys = {bytes(rng.randrange(256) for _ in range(rng.randrange(1, 6))): i for i in range(3000)}
    trie = sentencepiece_codec.Trie(keys)
    for key, value in keys.items():
        state = 0
        for byte in key:
            following = trie.base[state] + byte + 1
            assert trie.check[following] == state
            state = following
        assert trie.value[state] == value


def test_codec_on_tables(documents, texts, no_documents):
    encoded = sentencepiece_codec.encode_documents(documents, MODEL)
    got = rows(encoded)
    assert len(got) == documents.count() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)
    decoded = {r["doc_id"]: r["text"] for r in rows(sentencepiece_codec.decode_documents(encoded, MODEL))}
    assert decoded == texts | {1000: ""}
    assert rows(sentencepiece_codec.encode_documents(no_documents, MODEL)) == []


# HTML

PAGES = [
    ("<p>one<p>two", "one\n\ntwo"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n\n  3. x\n  4. y\n- c"),
    ("<ol type=a reversed><li>x<li value=9>y</ol>", "b. x\ni. y"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>12</table>", "Name       Qty\napple pie  12"),
    ("<table><td>a<td rowspan=2>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"),
    ("<table><tfoot><tr><td>z</tfoot><tr><td>a</table>", "a\nz"),
    ("a<div style='display:none'>no</div><span hidden>no</span><div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "a\nyes"),
    ("<head><title>t</title></head>x<script>var a='<p>';</script><style>p{}</style><template>q</template>", "x"),
    ("x<pre>\n a\n   b\n</pre>y", "x\n\n a\n   b\n\ny"),
    ("<details><summary>s</summary>hidden</details><details open><summary>s</summary>shown</details>", "s\ns\nshown"),
    ("a  \n b<br>c<br><br>d", "a b\nc\n\nd"),
    ("</p>a</td></table>&lt;b&gt; &amp; &eacute;", "a<b> & é"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<h1>t</h1>x<h2>u</h2>", "t\n\nx\n\nu"),
    ("<div>" * 3000 + "deep", "deep"),
    ("", ""), (None, ""), ("<", "<"), ("<!-- c -->", ""),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_layout(html, text):
    assert html_text.render(html) == text


@pytest.mark.parametrize("tag", ["div", "b"])
@pytest.mark.parametrize(("html", "text"), [p for p in PAGES if p[0] and "</td>" not in p[0] and "<head>" not in p[0]])
def test_layout_at_depth(tag, html, text):
    assert html_text.render(f"<{tag}>" * 2000 + html) == text


def test_deep_pages():
    hidden = "<script>var a</script><style>b{}</style><i hidden>c</i>"
    assert html_text.render("<b>" * 5000 + hidden + "<table><tr><td>x<td>y</table>" + "</b>" * 5000 + "z") == "x  y\n\nz"
    assert html_text.render("<span hidden>" + "<div>" * 300 + "<div>no</div></div>no</span>" + "<p>yes") == "yes"
    assert html_text.render("<ul><li>" * 500 + "x").endswith("- x") and html_text.render("<pre>" + "<b>" * 5000 + "a\n  b") == "a\n  b"


def test_wide_tables():
    table = "<table>" + "<tr><td>a<td>b" * 500 + "<tr><td>" + "long " * 20_000 + "<td>c<td>d</table>"
    text = html_text.render(table)
    assert len(text) < 2 * len(table) and text.startswith("a  b\na  b\n") and text.endswith("long\n   c  d")
    far = "<table><tr>" + "".join(f"<td>column{i}" for i in range(300)) + ("<tr><td colspan=299>" + "<td>x") * 500 + "</table>"
    assert len(html_text.render(far)) < 100 * len(far) and html_text.render(far).count("x") == 500
    assert html_text.render("<table><tr><td>\u65e5\u672c<td>x<tr><td>abcd<td>y<tr><td>e\u0301<td>z</table>") == "\u65e5\u672c  x\nabcd  y\ne\u0301     z"


VISIBLE = ("p", "div", "b", "span", "li", "td", "h2", "section", "em")
GONE = ("<script>{}</script>", "<style>{}</style>", "<span hidden>{}</span>", "<div style='display: none'><p>{}</p></div>", "<template>{}</template>", "<!-- {} -->", "<i style='visibility:hidden'>{}</i>", "<noscript>{}</noscript>")


def test_visible_words_of_random_pages():
    """Against the construction of the page: shown words all come out, once and in order; hidden ones never."""
    rng = random.Random(12)
    for _ in range(150):
        shown, parts, stack, n = [], [], [], 0
        for _ in range(rng.randrange(1, 120)):
            kind = rng.random()
            if kind < 0.3 and len(stack) < 60:
                tag = rng.choice([t for t in VISIBLE if t not in ("td", "li")])
                stack.append(tag)
                parts.append(f"<{tag} class='x'>")
            elif kind < 0.5 and stack:
                parts.append(f"</{stack.pop()}>" if rng.random() < 0.8 else "")
            elif kind < 0.65:
                parts.append(rng.choice(GONE).format(f"hidden{n}"))
            elif kind < 0.72:
                shown += [f"w{n}", f"v{n}", f"u{n}"]
                parts.append(rng.choice([f"<table><tr><td>w{n}<td>v{n}<tr><td>u{n}</table>", f"<ul><li>w{n}<li>v{n}<ul><li>u{n}</ul></ul>", f"<pre>w{n}\nv{n}  u{n}</pre>"]))
            else:
                shown.append(f"w{n}")
                parts.append(f" w{n} ")
            n += 1
        words = re.findall(r"[a-z]+[0-9]+", html_text.render("".join(parts)))
        assert words == shown


def test_pages_table(spark):
    data = [(i, "u", h) for i, (h, _) in enumerate(PAGES)]
    df = spark.createDataFrame([*data, data[0]], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = rows(html_text.extract(df))
    assert len(got) == len(PAGES) + 1 and all(r["text"] == PAGES[r["page_id"]][1] for r in got)
    assert rows(html_text.extract(df.limit(0))) == []


# nearest neighbours


def test_recall_and_edges(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(1500, 16)).astype(np.float32)
    data[200:600] = data[200]  # a third of the rows are one vector
    table = [(int(i), v.tolist(), 0) for i, v in enumerate(data)]
    table += [(5000, None, 0), (5050, [0.0] * 16, 0), (5100, [float("nan")] * 16, 0), (5150, [1.0] * 3, 0), (None, data[0].tolist(), 0), table[50], (6000, [None] + [1.0] * 15, 0)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").withColumns({"node": F.lit(1), "shard": F.lit(2), "id": F.lit(3)})
    got = {}
    for r in rows(ann.search(df, F.col("id") % 50 == 0, k=5)):
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], r["score"])
    assert sorted(got) == list(range(0, 1500, 50))
    unit = data.astype(np.float64) / np.linalg.norm(data.astype(np.float64), axis=1, keepdims=True)
    found = 0
    for q, own in got.items():
        cosine = unit @ unit[q]
        cosine[q] = -2
        true = np.lexsort((np.arange(1500), -np.round(cosine, 12)))[:5]
        assert sorted(own) == [1, 2, 3, 4, 5]
        found += len({i for i, _ in own.values()} & set(true.tolist()))
        for i, s in own.values():
            assert abs(s - cosine[i]) < 1e-12
        if 200 <= q < 600:
            assert [own[k][0] for k in range(1, 6)] == [i for i in range(200, 206) if i != q][:5]
    assert found >= 0.95 * 5 * len(got)


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(0, [1.0, 2.0])], schema)
    assert rows(ann.search(one, F.col("id") % 50 == 0)) == []
    assert rows(ann.search(one.limit(0), F.col("id") % 50 == 0)) == []
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], schema)
    assert [(r["id"], r["rank"]) for r in sorted(rows(ann.search(three, F.col("id") == 0)), key=lambda r: r["rank"])] == [(1, 1), (2, 2)]


def test_vectors_of_doubles(spark):
    data = [[1.0, 0.0], [1.0, 1e-9], [1e300, 1e300], [1e-300, -1e-300], [0.1, 0.7]]
    df = spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>")
    got = {r["id"]: r["score"] for r in rows(ann.search(df, F.col("id") == 4))}
    norm = (0.1**2 + 0.7**2) ** 0.5
    true = {0: 0.1 / norm, 1: (0.1 + 0.7e-9) / norm, 2: 0.8 / norm / 2**0.5, 3: -0.6 / norm / 2**0.5}
    assert set(got) == set(true) and all(abs(got[i] - true[i]) < 1e-15 for i in true)


# archives


def test_archives(spark):
    same = "x" * 150
    data = [(1, "u v", same), (2, None, same), (2, None, same), (None, "u", same), (5, "http://e/é", "é\r\n\r\nWARC/1.1\r\n" * 20), (6, "u", None), (7, "u", ""), (8, "u", "short"), (9, "u", "short"), (10, "u", "y" * 100_000)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({"id": F.lit(1), "digest": F.lit(1), "bytes": F.lit(1)})
    got = rows(warc.round_trip(pages))
    assert len(got) == len(data)
    html = {i: (h or "").encode() for i, _, h in data}
    for r in got:
        payload = html[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        revisit = payload == same.encode() and r["page_id"] != 1
        assert (r["record_type"], r["refers_to"]) == (("revisit", 1) if revisit else ("response", None))
    assert rows(warc.round_trip(pages.limit(0))) == []


def test_archives_are_deduplicated(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "z" * 200 if i % 2 else f"{i}" * 150) for i in range(20)], "page_id long, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/a", least_bytes=10**9)
    assert warc.read_archives(spark, f"file://{tmp_path}/a").where("record_type = 'revisit'").count() == 0
    warc.deduplicate_archives(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b")
    got = rows(warc.read_archives(spark, f"file://{tmp_path}/b"))
    assert sorted(r["page_id"] for r in got if r["record_type"] == "revisit") == list(range(3, 20, 2))
    assert {r["refers_to"] for r in got if r["refers_to"]} == {1}


# classifier


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 9)))
    docs, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randrange(30, 90))]
        bad = i % 5 == 0
        text = " ".join(w + "$$$" for w in words) if bad and i % 2 else " ".join(w for w in words[:12] for _ in range(8)) if bad else " ".join(words)
        docs.append((i, text, "en", "s", 1))
        if i % 3:
            labels.append((i, int(not bad), 0))
    docs += [(700, "", "en", "s", 0), (701, None, None, None, None), docs[3]]
    labels += [(None, 1, 0), (3, None, 0), labels[0]]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("own")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier(labelled):
    docs, labels = labelled
    got = rows(quality_classifier.classify(docs, labels))
    assert len(got) == 603 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    own = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert sum(r["predicted"] == (r["doc_id"] % 5 != 0) for r in own) >= 0.95 * len(own)


def test_held_out_labels_change_nothing(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r["doc_id"] or -1, r["score"]) for r in rows(quality_classifier.classify(docs, x))) for x in (labels, flipped))
    assert a == b


def test_rejected_documents_go(labelled):
    docs, labels = labelled
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["score"] for r in rows(kept)} == {"own"}
    predicted = {r["doc_id"] for r in rows(quality_classifier.classify(docs, labels)) if r["predicted"]}
    assert {r["doc_id"] for r in rows(kept)} == predicted


def test_texts_go_to_python_once(labelled, monkeypatch):
    docs, labels = labelled
    kind, seen = type(docs), []
    whole = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: seen.append(self.columns) or whole(self, *a, **b))
    quality_classifier.keep_good(docs, labels)
    assert len(seen[-1]) == len(docs.columns)


def test_classifier_without_labels(labelled):
    docs, labels = labelled
    assert {r["score"] for r in rows(quality_classifier.classify(docs, labels.limit(0)))} == {0.5}
    assert {r["score"] for r in rows(quality_classifier.classify(docs, labels.where("quality = 1")))} == {1.0}
    assert rows(quality_classifier.classify(docs.limit(0), labels)) == []


# pipeline


def test_pipeline(spark, labelled, documents, texts, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from test_text_operators import base_spans, plain_components, plain_removal

    docs, labels = labelled
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    mine = documents.select(*columns).where("doc_id < 1000").withColumn("doc_id", F.col("doc_id") + 2000).withColumn("text", F.concat("text", F.lit(" password: hunter22")))
    docs.select(*columns).unionByName(mine).coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stored = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = []
    for (name, stage), at in zip(corpus_pipeline.STAGES, itertools.count()):
        stage(spark, stored, str(tmp_path)).write.parquet(f"{tmp_path}/{at}")
        stored = spark.read.parquet(f"{tmp_path}/{at}")
        out.append(rows(stored))
    texts_of = lambda stage: {r["doc_id"]: r["text"] or "" for r in stage}
    predicted = {r["doc_id"] for r in rows(quality_classifier.classify(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)) if r["predicted"]}
    assert set(texts_of(out[0])) == predicted
    groups = plain_components(texts_of(out[0]), 5, 80)
    assert set(texts_of(out[1])) == {i for i, (n, c) in groups.items() if c == i or not n}
    removed = plain_removal(texts_of(out[1]), 20)
    assert texts_of(out[2]) == {i: kept if n else texts_of(out[1])[i] for i, (_, n, kept) in removed.items()}
    assert not any(base_spans(t) for t in texts_of(out[3]).values())
    assert {r["doc_id"] for r in out[4]} == set(texts_of(out[3]))
    ran = rows(corpus_pipeline.run(spark, str(tmp_path)))
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in ran) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in out[4])


def test_archives_with_revisits_are_deduplicated(spark, tmp_path):
    data = [(i, f"u{i}", "z" * 200 if i % 2 else f"{i}" * 150 if i % 4 else "short") for i in range(40)] + [(None, "v", "z" * 200)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    a, b, c, d = (f"file://{tmp_path}/{x}" for x in "abcd")
    held = lambda path: sorted(tuple(x or 0 for x in r.values()) for r in rows(warc.read_archives(spark, path)))
    warc.write_archives(pages, a, least_bytes=1)
    assert warc.read_archives(spark, a).where("record_type = 'revisit'").count() == 29
    warc.deduplicate_archives(spark, a, b, least_bytes=1)
    assert held(b) == held(a)
    # revisits of payloads that are too short now become responses
    warc.deduplicate_archives(spark, a, c, least_bytes=100)
    warc.write_archives(pages, f"file://{tmp_path}/e", least_bytes=100)
    assert held(c) == held(f"file://{tmp_path}/e")
    lost = warc.resolve(pages).where("id = 3").withColumn("refers_to", F.lit(1))
    warc._write(lost, d, 10**6, 10**6, None)
    with pytest.raises(ValueError, match="1 revisits have no original"):
        warc.deduplicate_archives(spark, d, f"file://{tmp_path}/f")


def test_archives_are_bounded_and_ids_are_new(spark, tmp_path):
    pages = spark.createDataFrame([(i % 400, "u", f"{i % 400}:" + "y" * (30_000 if i == 7 else 900 if i % 5 == 0 else 30)) for i in range(800)], "page_id long, url string, html string").coalesce(2)
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    warc.write_archives(pages, f"file://{a}", max_bytes=20_000)
    warc.deduplicate_archives(spark, f"file://{a}", f"file://{b}", max_bytes=20_000)
    seen = set()
    for folder in (a, b):
        found = [list(warc.parse(p.read_bytes())) for p in __import__("pathlib").Path(folder).glob("part-*")]
        assert sum(map(len, found)) == 800
        assert all(len(f) == 1 or sum(len(payload) for *_, payload in f) <= 20_000 + 40 for f in found)
        ids = [head["warc-record-id"] for f in found for head, *_ in f]
        assert len(set(ids)) == 800 and not seen & set(ids)  # also of pages with one page_id
        seen |= set(ids)
    held = lambda path: sorted(tuple(x or 0 for x in r.values()) for r in rows(warc.read_archives(spark, f"file://{path}")))
    assert held(a) == held(b)


def test_parallel_vectors_tie_by_id(spark):
    rng = np.random.default_rng(6)
    one, other = rng.normal(size=8), rng.normal(size=8)
    data = [(i, (one * (0.1 + i)).tolist()) for i in range(300)] + [(1000 + i, (other * (0.3 + i / 7)).tolist()) for i in range(40)] + [(2000 + i, rng.normal(size=8).tolist()) for i in range(60)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").coalesce(3)
    got = {}
    for r in rows(ann.search(df, F.col("id").isin(0, 150, 1005), k=5)):
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], round(r["score"], 12))
    assert [got[0][k] for k in range(1, 6)] == [(i, 1.0) for i in (1, 2, 3, 4, 5)]
    assert [got[150][k] for k in range(1, 6)] == [(i, 1.0) for i in (0, 1, 2, 3, 4)]
    assert [got[1005][k][0] for k in range(1, 6)] == [1000, 1001, 1002, 1003, 1004]


def test_directions_with_equal_cosines(spark):
    """Unit vectors of the axes: all are at a right angle to each other, so ids alone decide."""
    df = spark.createDataFrame([(i, [float(i % 12 == j) for j in range(12)]) for i in range(24)], "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r["id"]) for r in rows(ann.search(df, F.col("id") == 0, k=4)))
    assert got == [(1, 12), (2, 1), (3, 2), (4, 3)]


def test_dual_descent_against_plain_descent():
    rng = np.random.default_rng(3)
    found = [np.sort(rng.choice(40, 8, replace=False)).astype(np.uint32) for _ in range(60)]
    y = np.where([20 in f or 7 in f for f in found], 1.0, -1.0)
    ratios = np.zeros(1 << quality_classifier.BITS)
    ratios[:40] = rng.normal(size=40)
    cost = np.where(y > 0, 1.5, 0.7)
    x = np.zeros((60, 41))
    for i, f in enumerate(found):
        v = ratios[f]
        x[i, f] = v / np.sqrt((v * v).sum())
    x[:, 40] = 1.0
    objective = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    w, b = quality_classifier._descend(found, y, ratios, cost, 3000, 0)
    own = objective(np.append(w[:40], b))
    plain, best = np.zeros(41), np.inf
    for t in range(20_000):
        plain = plain - (plain - (cost * y * (y * (x @ plain) < 1)) @ x) / (t + 10)
        best = min(best, objective(plain))
    assert own <= 1.001 * best and abs(own - best) < 0.02 * best


def test_ratios_are_the_counted_ones():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(5, 30))).encode() for _ in range(40)]
    labels = np.array([int(b"aa" in t) for t in texts])
    indicators = quality_classifier.Indicators()
    found = [indicators(t) for t in texts]
    model = quality_classifier.fit(found, labels)
    counts = [{}, {}]
    for f, y in zip(found, labels, strict=True):
        for k in f.tolist():
            counts[y][k] = counts[y].get(k, 0) + 1
    size = 1 << quality_classifier.BITS
    total = [size + sum(c.values()) for c in counts]
    for k in set(counts[0]) | set(counts[1]):
        ratio = np.log((1 + counts[1].get(k, 0)) / total[1]) - np.log((1 + counts[0].get(k, 0)) / total[0])
        assert abs(model.squares[k] - ratio * ratio) < 1e-5


def test_fit_takes_no_more_memory_than_its_rows():
    rng = np.random.default_rng(5)
    found = [np.sort(rng.choice(1 << quality_classifier.BITS, 20_000, replace=False)).astype(np.uint32) for _ in range(600)]
    tracemalloc.start()
    quality_classifier.fit(found, np.arange(600) // 2 % 2, rounds=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < sum(f.nbytes for f in found)


def test_labelled_sample_is_bounded(labelled):
    docs, labels = labelled
    copies = docs.unionByName(docs).unionByName(docs.where("doc_id is not null").withColumn("text", F.concat(F.lit("zzz "), "text")))
    few = quality_classifier.train(copies, labels, max_rows=50, max_bytes=20_000)
    assert few.constant is not None or np.isfinite(few.weights).all()
    assert quality_classifier.train(copies, labels, max_bytes=0).constant == 0.5


def test_stages_without_rows_and_with_extra_columns(spark, labelled, documents, no_documents, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    labelled[1].write.parquet(f"{tmp_path}/labels.parquet")
    wide = documents.withColumn("a.b", F.lit("dots"))
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert rows(stage(spark, no_documents, str(tmp_path))) == []
        got = stage(spark, wide, str(tmp_path))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == wide.columns
            kept = rows(got)
            assert kept and all(r["a.b"] == "dots" and r["score"] == "x" for r in kept)
            assert all(r["n_chars"] is None or r["n_chars"] == len(r["text"]) for r in kept)
