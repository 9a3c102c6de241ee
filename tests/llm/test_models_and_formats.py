"""Classifiers by held-out accuracy, page extraction and chat formatting, and the pipeline's stages."""

import hashlib
import itertools
import math
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from pagedrift.llm import bpe, chat_format, common, html_extract, quality, toxicity

from . import reference
from .test_text_operators import ODD, odd

SF = "/root/testdata/sf0.01"


def tables(spark, *names):
    return [spark.read.parquet(f"{SF}/{n}.parquet") for n in names]


def held_out_rows(scored, labels, label):
    return scored.where("held_out").join(labels, "doc_id").select(F.col(label).alias("y"), "predicted", "score").collect()


def test_quality_on_held_out_rows(spark):
    docs, labels = tables(spark, "documents", "labels")
    scored = quality.scores(docs, labels).cache()
    assert scored.count() == docs.count() and scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    rows = held_out_rows(scored, labels, "quality")
    assert sum(r["y"] == r["predicted"] for r in rows) / len(rows) > 0.93
    assert sum(r["predicted"] for r in rows if r["y"]) / sum(r["y"] for r in rows) > 0.97


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(1, 12)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = quality.scores(odd(spark), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    same = {r["doc_id"]: r["score"] for r in got}
    assert same[1] == same[2] and same[5] == same[6]
    assert {r["score"] for r in quality.scores(odd(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.scores(odd(spark).limit(0), labels).count() == 0
    kept = quality.keep_good(odd(spark), labels)
    assert kept.schema == odd(spark).schema


def test_quality_takes_ids_and_texts_of_other_types(spark):
    rows = [(i, int(i % 2), "good words here. " * (i + 1) if i % 2 else "X" * (i + 1), "clash", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, quality int, text string, y string, fold int")
    labels = df.select("doc_id", "quality")
    got = {r["doc_id"]: r["predicted"] for r in quality.scores(df.drop("quality"), labels).collect()}
    assert got == {i: int(i % 2) for i in range(40)}


def test_quality_weights_solve_the_ridge_problem(spark):
    docs, labels = tables(spark, "documents", "labels")
    model = quality.fit(docs.repartition(5), labels)
    rows = docs.join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 > 1").select("text", "quality").collect()
    z = model.random_features(np.array([quality.statistics(r["text"] or "") for r in rows]))
    y = np.array([r["quality"] for r in rows], float)
    # The least squares of the rows with as many rows more for the penalty.
    more = math.sqrt(quality.RIDGE * len(y)) * np.eye(z.shape[1])
    want = np.linalg.lstsq(np.vstack([z, more]), np.append(y, np.zeros(z.shape[1])), rcond=None)[0]
    assert np.abs(model.weights - want).max() < 1e-6 * np.abs(want).max() + 1e-8


def test_random_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(2)
    d = quality.STATISTICS
    model = quality.Model(np.zeros(d), np.ones(d), rng.normal(0, 1 / math.sqrt(d), (d, 20_000)), rng.uniform(0, 2 * math.pi, 20_000), np.zeros(1), np.zeros(1), np.zeros(1))
    x = rng.normal(0, 1, (6, d))
    z = model.random_features(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * d))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_isotonic_pools_violators():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert x.tolist() == [1, 2.5, 4] and (np.diff(y) > 0).all()


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    scored = toxicity.scores(docs.repartition(8), labels).cache()
    rows = held_out_rows(scored, labels, "toxic")
    assert sum(r["y"] == r["predicted"] for r in rows) / len(rows) > 0.97
    # One in eight of these labels marks a text without any word that the others share.
    toxic = [r["predicted"] for r in rows if r["y"]]
    assert len(toxic) > 90 and sum(toxic) / len(toxic) > 0.83
    assert sum(r["predicted"] for r in rows if not r["y"]) / sum(not r["y"] for r in rows) < 0.01
    bad = scored.where("n_offending > 0").join(docs, "doc_id").select("offending", "text").first()
    s = bad["offending"][0]
    assert s["start"] < s["end"] <= len(bad["text"]) and s["score"] >= 0.5


def test_toxic_sentence_is_located(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    docs = []
    for d in range(400):
        said = [" ".join(rng.choice(vocabulary, 8)) + "." for _ in range(rng.integers(1, 12))]
        if d % 4 == 0:
            said[rng.integers(len(said))] = "you are such a villain today."
        docs.append((d, " ".join(said), int(d % 4 == 0)))
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.drop("text"))
    for _, text, y in docs:
        score, found = model.score(text)
        assert (score >= 0.5) == bool(y)
        assert [text[a:b].strip() for _, a, b in found] == (["you are such a villain today."] if y else [])
    # Harmless sentences don't add up.
    harmless = [t for _, t, y in docs if not y]
    assert model.score(" ".join(harmless * 40))[0] < 0.5 and model.score("Nothing known. " * 50_000)[0] == 0


def test_toxicity_gradient_is_that_of_the_noisy_or():
    rng = np.random.default_rng(1)
    docs = [([sorted(rng.choice(6, int(rng.integers(0, 4)), replace=False).tolist()) for _ in range(rng.integers(0, 4))], int(rng.integers(2))) for _ in range(12)]
    docs = [(s, y) for s, y in docs if s or not y]
    x = toxicity.bags(docs)
    w = rng.normal(0, 1, 7)

    def loss(w):
        total = 0.0
        for sents, y in docs:
            clean = math.prod(1 - 1 / (1 + math.exp(-(sum(w[i] for i in ids) + w[6]))) for ids in sents)
            total -= math.log(1 - clean if y else clean)
        return total / len(docs)

    value, grad = toxicity.loss_and_gradient(w, x)
    assert value == pytest.approx(loss(w))
    for i in range(7):
        step = np.eye(7)[i] * 1e-6
        assert grad[i] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-6, abs=1e-6)


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(1, 12)] + [(None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scores(odd(spark), labels).collect()}
    assert len(got) == len(ODD) and got[1]["score"] == got[2]["score"] == 0
    assert all(r["score"] == 0 for r in toxicity.scores(odd(spark), labels.limit(0)).collect())
    assert toxicity.scores(odd(spark).limit(0), labels).count() == 0


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inner)
    clean = [" ".join(re.sub(r"<[^>]+>", " ", x).replace("&quot;", '"').replace("&amp;", "&").split()) for x in parts]
    return "\n".join(x for x in clean if x)


def test_pages(spark):
    (pages,) = tables(spark, "pages")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    rows = pages.collect()
    right = sum(got[r["page_id"]]["text"] == article(r["html"]) for r in rows)
    assert right / len(rows) > 0.98
    assert all(len(r["text"]) == r["n_chars"] for r in got.values())


def test_unseen_layouts():
    model = html_extract.trained()
    right = total = 0
    for page, main in html_extract.labelled_pages(80, seed=99):
        got = html_extract.main_text(page, model).split("\n")
        right += got == (main or [""])
        total += 1
    assert right / total > 0.8


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain words only"), (4, "u", "<article><p>a &lt;b&gt;&nbsp;c\n\n d<script>x<p></script> e</article><footer>f</footer>"), (4, "u", "<"), (5, "u", "<article><p>" + "long " * 60_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r["page_id"], r["text"]) for r in html_extract.extract(df).collect()]
    assert len(got) == 6 and (1, "") in got and (2, "") in got and (4, "a <b> c d e") in got
    assert html_extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("silent", [
    "<script>for(i=0;i<n;i++){f(i)}</script>", "<script>if (a<b) g();</SCRIPT >", "<script>s = '<p>\"<b';</script><script>x<y</script>", "<style>/* a<b \" */</style>",
    "<script>t = '</scripted>';i<n</script\n>", "<noscript><img alt='a<b'></noscript>", "<object data='x'></object>", "<canvas></canvas>", "<svg><path d='M0'>", "<select><option>", "<script src='x'/>", "<select><option>a</select>",
])
def test_silent_elements_leave_the_article(silent):
    page = f"<body>{silent}<article><p>First words.</p><p>Second words.</p></article></body>"
    assert [b.text for b in html_extract.blocks(page)] == ["First words.", "Second words."]


def test_formulas_fallbacks_and_unended_elements_keep_the_text():
    texts = lambda page: [b.text for b in html_extract.blocks(page)]
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p>") == ["Let x=2 hold."]
    for tag in ("object", "noscript", "canvas", "details", "b", "span", "a", "li", "table"):
        assert texts(f"<p>First.</p><{tag}><p>Second.</p><p>Third.</p>") == ["First.", "Second.", "Third."], tag
        assert texts(f"<p>First.</p><{tag}><p>Second.</p><{tag}>x</{tag}><p>Third.</p>") == ["First.", "Second.", "x", "Third."], tag
    deep = "<div>" * 20_000 + "<p>Deep.</p>" + "</div>" * 20_000
    assert texts(deep) == ["Deep."]


def test_viterbi_finds_the_best_sequence_of_all():
    rng = np.random.default_rng(5)
    for n in range(1, 9):
        for _ in range(20):
            model = html_extract.Crf({f"f{i}": tuple(rng.normal(0, 2, 2)) for i in range(5)}, rng.normal(0, 2, (2, 2)))
            feats = [[f"f{i}" for i in rng.choice(7, 3)] for _ in range(n)]

            def score(path):
                e = model.emissions(feats)
                return sum(e[i, s] for i, s in enumerate(path)) + sum(model.moves[a, b] for a, b in zip(path, path[1:]))  # noqa: B023

            assert score(model.decode(feats)) == pytest.approx(max(map(score, itertools.product((0, 1), repeat=n))))


def test_crf_gradient_raises_the_likelihood():
    rng = np.random.default_rng(6)
    pages = []
    for _ in range(30):
        y = (rng.random(6) < 0.5).astype(int).tolist()
        pages.append(([[f"s{s}" if rng.random() < 0.8 else "noise"] for s in y], y))

    def likelihood(model):
        total = 0.0
        for f, y in pages:
            e = model.emissions(f)
            value = lambda p: sum(e[i, s] for i, s in enumerate(p)) + sum(model.moves[a, b] for a, b in zip(p, p[1:]))  # noqa: B023,E731
            total += value(y) - np.logaddexp.reduce([value(p) for p in itertools.product((0, 1), repeat=len(y))])
        return total

    values = [likelihood(html_extract.train(pages, epochs=k, rate=0.05)) for k in (0, 1, 4, 16)]
    assert values == sorted(values) and values[-1] > values[0] + 10


def test_unended_scripts_run_to_the_end():
    assert [b.text for b in html_extract.blocks("<p>Before.</p><script>i<n <p>no text</p>")] == ["Before."]


BIG = 1 << 60
SPOKEN = [
    (0, "chosen", 0, "system", "s"), (0, "chosen", 1, "user", "q"), (0, "chosen", 2, "assistant", "good"), (0, "chosen", 3, "user", "more"),
    (0, "rejected", 0, "system", "s"), (0, "rejected", 1, "user", "q"), (0, "rejected", 2, "assistant", "bad"),
    (1, "chosen", 0, "user", None), (1, "rejected", 0, "user", ""), (2, "rejected", 1, None, "alone"), (None, "chosen", 0, "user", "x"), (2, None, 0, "user", "x"),
    (3, "chosen", None, "assistant", "z"), (3, "rejected", None, "assistant", "z"), (3, "chosen", 1, "assistant", "y"), (3, "chosen", 1, "assistant", "y"), (3, "rejected", 1, "assistant", "y"),
    (BIG, "chosen", 0, "user", "b"), (BIG + 1, "rejected", 0, "user", "b"),
]


def spoken(spark):
    return spark.createDataFrame([(*t, "clash", 7) for t in SPOKEN], "pair_id long, side string, turn long, role string, text string, part string, differs int")


def test_preference_records(spark):
    found = chat_format.segments(spoken(spark)).cache()
    got = {r["pair_id"]: r for r in chat_format.records(found).collect()}
    one = got[0]
    spans = lambda r, part: [r[part][int(a) : int(b)] for x in r[f"{part}_trained"].split(",") if x for a, b in [x.split("-")]]
    assert one["prompt"] == "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n"
    assert one["chosen"] == "<|assistant|>\ngood<|end|>\n<|user|>\nmore<|end|>\n" and one["rejected"] == "<|assistant|>\nbad<|end|>\n"
    assert spans(one, "chosen") == ["good<|end|>\n"] and spans(one, "rejected") == ["bad<|end|>\n"]
    assert got[1]["prompt"] == "<|user|>\n<|end|>\n" and got[1]["chosen"] == got[1]["rejected"] == ""
    assert got[2]["prompt"] == "" and got[2]["rejected"] == "<|unknown|>\nalone<|end|>\n" and got[2]["rejected_trained"] == ""
    # The turn with two equal rows on one side and one on the other is a difference.
    assert got[3]["prompt"] == "<|assistant|>\nz<|end|>\n" and spans(got[3], "chosen") == ["y<|end|>\n"] * 2 and spans(got[3], "rejected") == ["y<|end|>\n"]
    assert got[BIG]["rejected"] == got[BIG + 1]["chosen"] == "" and got.keys() == {0, 1, 2, 3, BIG, BIG + 1}
    assert chat_format.preferences(spoken(spark).limit(0)).count() == 0


@pytest.mark.parametrize("limits", [(20, 2000), (1 << 24, 2)])
def test_long_preference_pairs_come_in_pieces(spark, limits):
    found = chat_format.segments(spoken(spark)).cache()
    whole = {r["pair_id"]: r for r in chat_format.records(found).collect()}
    pieces = sorted(chat_format.records(found, *limits).collect(), key=lambda r: (r["pair_id"], r["piece"]))
    assert len(pieces) > len(whole)
    trained = lambda r, part: "".join(r[part][int(a) : int(b)] for x in r[f"{part}_trained"].split(",") if x for a, b in [x.split("-")])
    for pair, r in whole.items():
        mine = [p for p in pieces if p["pair_id"] == pair]
        for part in ("prompt", "chosen", "rejected"):
            assert "".join(p[part] for p in mine) == r[part]
        for part in ("chosen", "rejected"):
            assert "".join(trained(p, part) for p in mine) == trained(r, part)


def test_swapped_answers(spark, monkeypatch):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "t"), (1, 0, "user", "r"), (1, 1, "assistant", "b"), (1, 3, "assistant", "c"), (2, 0, "user", "x"), (3, 0, "assistant", None), (4, 1, "assistant", "lone"), (BIG, 0, "assistant", "u"), (BIG + 1, 0, "assistant", "v"), (None, 0, "assistant", "n")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, last string")
    for keys in (1000, 3):
        monkeypatch.setattr(chat_format, "heavy_keys", lambda rows, on, total, k=keys: common.heavy_keys(rows, on, total, k))
        got = sorted((r["pair_id"], r["turn"], r["role"], r["text"]) for r in chat_format.swapped_answers(df).where("side = 'rejected'").collect())
        assert got == [(0, 0, "user", "q"), (0, 1, "assistant", "c"), (0, 2, "user", "t"), (1, 0, "user", "r"), (1, 1, "assistant", "b"), (1, 3, "assistant", "a"), (2, 0, "user", "x"), (BIG, 0, "assistant", "v"), (BIG + 1, 0, "assistant", "u")]
        prompts = {r["pair_id"]: r["prompt"] for r in chat_format.preferences(chat_format.swapped_answers(df)).collect()}
        assert prompts[0] == "<|user|>\nq<|end|>\n" and prompts[1].endswith("b<|end|>\n") and prompts[4] == ""


def test_pipeline_stages(spark):
    (docs,) = tables(spark, "documents")
    docs = docs.where("doc_id < 300").cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}
    before = rows(docs)
    out = corpus_pipeline.line_stage(spark, docs, SF)
    after, gone = rows(out), reference.dropped([(d, r["text"]) for d, r in before.items()])
    assert out.columns == docs.columns
    for d, r in before.items():
        text = "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in gone.get(d, []))
        assert (d in after) == bool(text.strip() or d not in gone)
        if d in after:
            assert after[d]["text"] == text and after[d]["n_chars"] == len(text)
    kept = rows(corpus_pipeline.near_stage(spark, docs, SF))
    assert kept.keys() == {d for d, (_, root) in reference.components([(d, r["text"]) for d, r in before.items()], 80).items() if d == root}
    items = [(r["item_id"], r["text"]) for r in tables(spark, "benchmark")[0].collect()]
    leaked = {d for d, _ in reference.leaks([(d, r["text"]) for d, r in before.items()], items)}
    assert rows(corpus_pipeline.benchmark_stage(spark, docs, SF)).keys() == before.keys() - leaked
    good = rows(corpus_pipeline.quality_stage(spark, docs, SF))
    score = {r["doc_id"]: r["predicted"] for r in quality.scores(docs, tables(spark, "labels")[0]).collect()}
    assert good.keys() == {d for d, p in score.items() if p} and all(good[d]["text"] == before[d]["text"] for d in good)


def test_pipeline_runs_whole(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    again = corpus_pipeline.run(spark, sf)  # a second run leaves the first one's stages alone
    got = {r["doc_id"]: tuple(r)[1:] for r in out.collect()}
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got == {r["doc_id"]: tuple(r)[1:] for r in again.collect()}
    docs, labels, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels", "benchmark"))
    good = {r["doc_id"] for r in quality.scores(docs, labels).where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
    gone = reference.dropped(rows)
    rows = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, []))) for d, t in rows]
    rows = [(d, t) for d, t in rows if t.strip() or d not in gone]
    root = reference.components(rows, 80)
    rows = [(d, t) for d, t in rows if root[d][1] == d]
    leaked = {d for d, _ in reference.leaks(rows, [(r["item_id"], r["text"]) for r in items.collect()])}
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, t in rows:
        if d not in leaked:
            ids = library.encode_ordinary(t)
            want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert got == want and 50 < len(want) < 200


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, stage):
    df = odd(spark).select("doc_id", "text", "lang", F.col("h1").alias("source"), F.length("text").cast("long").alias("n_chars"))
    name, f = corpus_pipeline.STAGES[stage]
    for d in (df, df.limit(0)):
        out = f(spark, d, "/root/testdata/sf0.001")
        out.collect()
        assert name == "bpe" or out.columns == df.columns
