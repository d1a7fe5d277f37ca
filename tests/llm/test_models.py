import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.llm import extraction, langid, lm, quality, sentencepiece, toxicity
from isohyet.llm.common import remainder
from isohyet.llm.dom import in_order, parse
from isohyet.llm.words import Words

from .conftest import STRANGE, prose

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels", "pages")}


def held_out_accuracy(scored, labels, label):
    rows = scored.filter(remainder("doc_id", 5) == 0).join(labels, "doc_id").select((F.col(label) == F.col("predicted")).cast("int").alias("ok"))
    return rows.agg(F.avg("ok")).first()[0]


def test_remainder_is_that_of_the_text(spark):
    ids = spark.range(50).select("id", remainder("id", 7).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 7 for r in ids)


# --- quality ---


def test_quality_held_out(tables, strange, nothing, spark):
    labels = tables["labels"].filter(remainder("doc_id", 5) != 0)
    model = quality.fit(tables["documents"], labels)
    assert held_out_accuracy(quality.score(tables["documents"].select("doc_id", "text"), model), tables["labels"], "quality") > 0.95
    odd = quality.score(strange, model).collect()
    assert len(odd) == len(STRANGE) and all(0 <= r["score"] <= 1 for r in odd)
    assert all(r["score"] == model.share for r in odd if not (r["text"] or "").strip())
    assert quality.score(nothing, model).count() == 0
    none = quality.fit(nothing, labels.limit(0))
    assert {r["score"] for r in quality.score(strange, none).collect()} == {0.5}
    assert quality.accepted(strange, tables["labels"]).columns == strange.columns


def test_quality_votes_are_exact():
    rng = np.random.default_rng(1)
    rows = [{"label": i % 2, "places": [j for j in range(40) if rng.random() < (0.3 if i % 2 else 0.1)] or [41], "counts": None} for i in range(60)]
    for r in rows:
        r["counts"] = rng.integers(1, 5, len(r["places"])).tolist()
    model = quality.Model(rows, {0: 30, 1: 90})
    counts = np.zeros((5, 2 * quality.BINS + 1), np.int64)
    counts[:4, :40] = rng.integers(0, 3, (4, 40))
    got = model.score(counts)
    for i in range(4):
        w = np.sqrt(counts[i] / counts[i].sum()) * model.idf @ model.basis
        cosine = model.vectors.astype(float) @ (w / np.linalg.norm(w))
        near = np.argsort(-cosine)[:quality.K]
        weight = np.maximum(cosine[near], 1e-6) ** quality.SHARPNESS * model.votes[near]
        assert got[i] == pytest.approx((weight * model.labels[near]).sum() / weight.sum(), abs=1e-4)
    assert got[4] == model.share


# --- toxicity ---


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    vectors = (rng.random((300, 50)) * (rng.random((300, 50)) < 0.06)).astype(np.float32)
    vectors[rng.integers(0, 300, 20)] = vectors[0]  # ties
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    index = toxicity.Index(vectors, rng.integers(0, 2, 300), np.arange(300))
    queries = np.concatenate((vectors[:40], np.zeros((1, 50), np.float32)))
    best, place = index.nearest(queries)
    brute = -np.sort(-(queries @ vectors.T), axis=1)[:, :toxicity.K]
    assert np.allclose(best, brute, atol=1e-6)
    ok = place >= 0
    assert np.allclose((vectors[index.ids[place]] * queries[:, None]).sum(2)[ok], best[ok], atol=1e-6)
    assert not ok[-1].any()


def test_isotonic_fit():
    knots, values = toxicity.isotonic(np.array([0, 0, 1, 2, 3, 4.0]), np.array([0, 0, 1, 0, 1, 1.0]), np.ones(6))
    assert (np.diff(values) >= 0).all() and np.interp(0, knots, values) == 0 and np.interp(1.5, knots, values) == 0.5


def test_toxicity_held_out(spark, strange, nothing):
    big = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{big}/labels.parquet")
    model = toxicity.fit(documents, labels.filter(remainder("doc_id", 5) != 0))
    known = documents.join(labels.select("doc_id"), "doc_id")
    assert held_out_accuracy(toxicity.score(known, model), labels, "toxic") > 0.95
    odd = toxicity.score(strange, model).collect()
    assert len(odd) == len(STRANGE) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(nothing, model).count() == 0
    none = toxicity.fit(nothing, labels)
    assert len({r["score"] for r in toxicity.score(strange, none).collect()}) == 1


# --- language model ---


def test_language_model_sums_to_one_and_beats_the_base(spark, tables):
    documents = tables["documents"].select("doc_id", "text")
    learn = remainder("doc_id", 7) != 2
    model, counts = lm.fit(documents.filter(learn))
    one, two = np.array([0, 3, 100]), np.array([0, 5, 400])
    for a, b in zip(one, two):
        n = lm.SYMBOLS
        assert 10 ** model.log10(np.arange(n), np.full(n, a), np.full(n, b)) @ np.ones(n) == pytest.approx(1, abs=1e-9)
    # Inside a class all words and the unknown one share 1.
    words = counts.filter("tail >= 0").toPandas().sort_values(["n", "word"], ascending=[False, True]).iloc[min(lm.OWN, len(model.counts.near)):]
    shares = (words["n"] + 1).groupby(words["tail"]).sum()
    for tail, total in shares.items():
        assert total + 1 == model.counts.class_n[tail] + model.counts.class_v[tail] + 1
    rows = lm.score(documents, model, counts).filter(remainder("doc_id", 7) == 2).agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_base_scores_by_hand(spark, monkeypatch, strange, nothing):
    monkeypatch.setattr(lm, "NEAR", 8)  # most words have to be joined
    rng = random.Random(1)
    texts = [prose(rng, n, 60) for n in (0, 1, 20, 80, 200, 200)] + [None, "UPPER lower Upper", ""]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lm.learn_and_score(documents, F.col("doc_id") < 5).collect()
    tokens = [[w.lower() for w in re.findall(r"\S+", t or "")] + ["\0"] for t in texts]
    counts: dict = {}
    for t in tokens[:5]:
        for w in t:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        own = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in counts for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in own), abs=1e-9)
        assert r["score"] < 0
    assert lm.learn_and_score(strange, F.lit(True)).count() == len(STRANGE)
    assert lm.learn_and_score(nothing, F.lit(True)).count() == 0
    untaught = lm.learn_and_score(strange, F.lit(False)).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"]) for r in untaught} == {(0, 0, 0.0)}


# --- SentencePiece ---


def test_encoding_is_that_of_the_library():
    import sentencepiece as library

    reader, codec = library.SentencePieceProcessor(model_file=sentencepiece.MODEL), sentencepiece.Codec(sentencepiece.read_model())
    rng = random.Random(7)
    pieces = list(codec.ids)
    texts = [t for _, t in STRANGE if t and len(t) < 10000] + ["  two  spaces ", "<s> <0x41> </s>", "a\n\nb\tc", "é́ﬁ", "▁", " "]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))).replace("▁", " ") for _ in range(2000)]
    texts += ["".join(rng.choice("ab the  ing \n日本𝔘éñ.,01$ABC") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    ids, offsets = codec.encode([*texts, None])
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [reader.encode(t) for t in texts] + [[]]
    assert codec.decode(ids, offsets) == [t.replace("▁", " ") for t in texts] + [""]


def test_unigram_path_is_the_best_one():
    rng = random.Random(3)
    pieces = {"▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab"}
    scores = {p: -rng.random() * 5 for p in pieces}
    model = {"kind": "unigram", "pieces": {p: i + 3 for i, p in enumerate(sorted(pieces))}, "scores": scores, "bytes": {}, "unknown": 0}
    codec = sentencepiece.Codec(model)

    def best(word):
        cuts = (itertools.combinations(range(1, len(word)), k) for k in range(len(word)))
        ways = ([word[a:b] for a, b in zip((0, *c), (*c, len(word)))] for c in itertools.chain(*cuts))
        return max(sum(scores[p] for p in w) for w in ways if all(p in pieces for p in w))

    by_id = {i: p for p, i in model["pieces"].items()}
    for _ in range(200):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        ids, _ = codec.encode([word])
        assert sum(scores[by_id[i]] for i in ids) == pytest.approx(best("▁" + word))
    assert codec.encode(["axb"])[0].tolist().count(0) == 1


def test_encoding_in_spark(strange, nothing):
    rows = sentencepiece.encoded_and_checked(strange).collect()
    assert len(rows) == len(STRANGE) and sum(not r["round_trip"] for r in rows) == 1  # the text with the mark in it
    back = sentencepiece.decode(sentencepiece.encode(strange.select("doc_id", "text"))).collect()
    assert sorted(r["text"] for r in back) == sorted((t or "").replace("▁", " ") for _, t in STRANGE)
    assert sentencepiece.encoded_and_checked(nothing).count() == 0


# --- language ---


def test_language_held_out(tables, strange, nothing):
    documents = tables["documents"].select("doc_id", "text", "lang")
    found = langid.learn_and_predict(documents, remainder("doc_id", 4) != 2).filter(remainder("doc_id", 4) == 2)
    right = found.join(documents.select("doc_id", "lang", "text").filter("text is not null"), "doc_id")
    assert right.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    odd = langid.learn_and_predict(strange, F.lit(True)).collect()
    assert len(odd) == len(STRANGE)
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in odd if r["doc_id"] in (1, 2, 3, 10))
    assert {r["lang_pred"] for r in langid.learn_and_predict(strange, F.lit(False)).collect()} == {"und"}
    assert langid.learn_and_predict(nothing, F.lit(True)).count() == 0


def test_out_of_place_distance():
    letters = langid._letters()
    known = {"a": [int(g) for g in langid.ngrams("aaa aba", letters)[0]], "b": [int(g) for g in langid.ngrams("zzz", letters)[0]]}
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["aaa", "zz", "12", None]})
    out = next(langid._predictor(known)([batch])).to_pydict()
    assert out["lang_pred"] == ["a", "b", "und", "und"]
    own, counts = langid.ngrams("aaa", letters)
    order = sorted(range(len(own)), key=lambda i: (-counts[i], own[i]))
    away = sum(abs(known["a"].index(own[i]) - r) if own[i] in known["a"] else langid.TOP for r, i in enumerate(order))
    assert out["score"][0] == pytest.approx(1 - away / (langid.TOP * len(own)))


# --- main text ---


@pytest.fixture(scope="module")
def extractor(tables):
    return extraction.fit(tables["pages"])


def text_of(model, html):
    nodes = in_order(parse(html))
    return extraction.main_text(nodes, model.log_probabilities([nodes]))


def test_main_text_of_unseen_layouts(extractor):
    exact = 0
    pages = extraction.layouts(150, seed=77)
    for page in pages:
        nodes = in_order(parse(page))
        truth, found = extraction.made_labels(nodes), extraction.decode(nodes, extractor.log_probabilities([nodes]))
        exact += all((t == 2) == (f == 2) for n, t, f in zip(nodes, truth, found) if n.tag == "#text")
    assert exact >= 140


def test_main_text_of_the_pages(spark, tables, extractor):
    import html

    for r in extraction.extract(tables["pages"], extractor).join(tables["pages"].select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_decoding_never_contradicts_and_is_best():
    rng = np.random.default_rng(4)
    for _ in range(40):
        nodes = in_order(parse("<div><p>a</p><section><p>b</p>c</section></div>"))
        log_p = np.log(rng.dirichlet([1, 1, 1], len(nodes)))

        def total(labels):
            score = 0.0
            for i, n in enumerate(nodes):
                above = labels[nodes.index(n.parent)] if n.parent else 1
                if (n.tag == "#text" and labels[i] == 1) or (above == 0 and labels[i]) or (above == 2 and labels[i] == 1):
                    return -np.inf
                score += log_p[i, labels[i]] - extraction.CHANGE * (above == 2 and labels[i] == 0)
            return score

        best = max(total(x) for x in itertools.product(range(3), repeat=len(nodes)))
        assert total(extraction.decode(nodes, log_p)) == pytest.approx(best)


def test_strange_pages(spark, extractor):
    pages = [(1, None, None), (2, "u", ""), (3, "u", "plain text &amp; more"), (4, "u", "<p>unclosed <b>bold<br>x<p>two"), (None, "u", "<div><div>"),
             (5, "u", "<script>if (a < b) {}</script>"), (6, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (6, "u", "</p></div>stray")]
    rows = extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as text"), extractor).collect()
    assert len(rows) == len(pages) and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in rows)
    assert next(r["text"] for r in rows if r["page_id"] == 3) == "plain text & more"
    assert next(r["text"] for r in rows if r["page_id"] == 4) == "unclosed bold x\n\ntwo"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert extraction.extract(empty, extraction.Model()).count() == 0


def runs_of(html):
    return ["".join(n.text).strip() for n in in_order(parse(html)) if n.tag == "#text"]


def test_a_head_ends_where_its_content_does(extractor):
    article = "".join(f"<p>{prose(random.Random(i), 40)}</p>" for i in range(4))
    plain = text_of(extractor, f"<html><head><title>t</title></head><body>{article}</body></html>")
    assert plain
    assert text_of(extractor, f"<html><head><title>t</title>{article}") == plain
    assert text_of(extractor, f"<head><meta charset=utf-8><script>var a = '<p>';</script><style>p {{}}</style>{article}</html>") == plain
    assert runs_of("<head><title>t</title>words<p>more") == ["words", "more"]
    assert runs_of("<head><noscript><style>p {}</style></noscript><title>t</title><body><p>words") == ["words"]


def test_content_of_math_object_noscript_and_button_is_text():
    assert runs_of("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["if x=2 holds"]
    assert runs_of("<p>one</p><object data=x><p>fallback</p></object><noscript><p>no script</p></noscript><p>press <button>go</button>") == [
        "one", "fallback", "no script", "press go"]
    assert runs_of("<p>a</p><script>s</script><style>t</style><template><p>u</p></template><p>b") == ["a", "b"]
