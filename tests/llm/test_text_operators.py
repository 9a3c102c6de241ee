"""Line dedup, decontamination, near-duplicates, tokens and fingerprints against brute force and on odd inputs."""

import base64
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from pagedrift.llm import bpe, common, decontam, fingerprint, line_dedup, near_dup, sharding

from . import reference

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, h1 string, rep string"
ODD = [
    (1, None), (2, ""), (3, "one"), (4, "One\ttwo three"), (5, "a b c d e f g"), (6, "a b c d e f g"), (7, "A b c d e f g"),
    (8, "x" * 3000), (9, " ".join(f"w{i}" for i in range(4000))), (10, " ".join(f"w{i}" for i in range(4000) if i != 2000)),
    (11, "a b c d e f h\na b c d e f g\n\na b d e f g\nA b c d e f g"), (12, "  lead  and   trail   \n\n  "), (13, "é ü 漢字 😀 ²½ x\u0085y z"), (None, "nobody owns this line of text"),
    (14, "l1 l2 l3 l4 l5 l6\nl1 l2 l3 l4 l5"), (15, "l1 l2 l3 l4 l5 l6 l7\nl0 l1 l2 l3 l4 l5"),
]


def odd(spark):
    return spark.createDataFrame([(d, t, "en", "clash", None) for d, t in ODD], SCHEMA)


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def listed(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def kept_text(text, gone):
    return "\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in gone)


@pytest.mark.parametrize("source", [docs_of, odd])
def test_line_dedup(spark, source):
    df = source(spark)
    rows = [(d if d is not None else 1 << 62, t) for d, t in listed(df)]
    want = reference.dropped(rows)
    got = {r["doc_id"] if r["doc_id"] is not None else 1 << 62: r for r in line_dedup.dedup(df).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        gone = want.get(d, [])
        assert got[d]["n_dropped"] == len(gone), (d, gone, got[d])
        assert (got[d]["text"] or "") == kept_text(t, gone)
        assert got[d]["n_lines"] == (0 if t is None else len(t.split("\n")))


def test_line_dedup_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_dropped"]) for r in line_dedup.dedup(df).collect()) == [(1, 0), (1, 0), (2, 1)]
    assert line_dedup.dedup(odd(spark).limit(0)).count() == 0


def test_line_dedup_of_short_lines(spark):
    rows = [(1, "Buy now\n\nBuy  now\tthen\nYes\n \nBuy now"), (2, "  Buy now \nYes\nno\n\nYES"), (3, "no")]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("Buy now\n\nBuy  now\tthen\nYes\n ", 1), 2: ("no\n\nYES", 2), 3: ("", 1)}


def test_line_dedup_of_repeated_ids_with_other_texts(spark):
    rows = [(1, "first of all\nkept here"), (1, "other words\nkept there"), (None, "first of all\nnull one"), (None, "null two\nfirst of all"), (None, None)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["text"] or "", r["n_dropped"]) for r in got) == [("", 0), ("first of all\nkept here", 0), ("null one", 1), ("null two", 1), ("other words\nkept there", 0)]


def test_line_dedup_of_spellings_and_witness_chains(spark):
    words = "one two three four five six".split()
    spelled = [(i, " " * (i % 3) + (" " * (1 + i // 3)).join(words)) for i in range(30)]
    longer = [(100 + i, " ".join([*words, f"x{i}"])) for i in range(40)]
    # c is near b only, and b near a: both go, for a line that goes is still a witness.
    chain = [(200, "a b c d e f"), (201, "a b c d e g"), (202, "a b c d h g")]
    rows = spelled + longer + chain
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in line_dedup.dedup(df).where("n_dropped = 0").collect()} == {0, 200}
    want = reference.dropped(rows)
    assert {d: [0] for d in {d for d, _ in rows} - {0, 200}} == want


def test_line_dedup_with_hot_lines_variants_and_witnesses(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_ROWS", 0)
    monkeypatch.setattr(line_dedup, "HEAVY_KEYS", 20)
    monkeypatch.setattr(line_dedup, "heavy_keys", lambda rows, on, total: common.heavy_keys(rows, on, total, 20))
    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(60)]
    rows = [(d, "\n".join(["a line that all documents share", "short", f"variant number {d % 50} of one long line", *(" ".join(rng.choice(vocabulary, int(rng.integers(1, 8)))) for _ in range(4))])) for d in range(150)]
    got = {r["doc_id"]: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = reference.dropped(rows)
    for d, t in rows:
        assert got[d]["text"] == kept_text(t, want.get(d, [])), d


def test_line_dedup_of_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b\na b", "x", 7, "y", 8, 9)], "doc_id long, text string, _doc string, n_lines long, _drop string, _kept int, tie int")
    out = line_dedup.dedup(df)
    assert out.columns == ["doc_id", "text", "_doc", "_drop", "_kept", "tie", "n_lines", "n_dropped"]
    assert tuple(out.first()) == (1, "a b", "x", "y", 8, 9, 2, 1)


def test_line_dedup_group_of_one_word_variants(spark):
    rows = [(i, f"every copy says number {i} and no more") for i in range(300)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got if not r["n_dropped"]) == [0]


@pytest.mark.parametrize("source", [docs_of, odd])
def test_near_duplicates(spark, source):
    df = source(spark)
    rows = [(d, t) for d, t in listed(df) if d is not None]
    want = reference.components(rows)
    got = {r["doc_id"]: r for r in near_dup.classes(df).collect()}
    for d, (n, root) in want.items():
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (n, root, d == root)
    if source is odd:
        assert got[None]["component_id"] is None and got[None]["kept"]


def test_near_duplicates_in_a_large_family_and_repeated_rows(spark):
    rng = np.random.default_rng(1)
    base = [f"t{i}" for i in range(200)]
    rows = []
    for d in range(700):
        w = list(base)
        for i in rng.integers(0, 200, rng.integers(1, 7)):
            w[i] = f"x{d}_{i}"
        rows.append((d, " ".join(w)))
    rows += [(900, "solo words that nobody else has here"), (900, "solo words that nobody else has here")]
    want = reference.components(rows)
    got = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert near_dup.classes(odd(spark).limit(0)).count() == 0


def test_near_duplicates_of_a_repeated_id_in_a_large_bucket(spark):
    family = lambda name: [" ".join(f"{name}{i}" if i != 5 * k else f"{name}x{k}" for i in range(200)) for k in range(40)]
    left, right = family("a"), family("b")
    # Id 0 has a text of each family, so both are one component.
    rows = [(k, t) for k, t in enumerate(left)] + [(100 + k, t) for k, t in enumerate(right) if k] + [(0, right[0])]
    got = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got} == {0}


def boilerplate_chain(n=240, parts=60):
    """Documents that each share a part with the next ones only, in a chain, and with no document nearly all."""
    rng = np.random.default_rng(11)
    part = [[f"p{k}_{i}" for i in range(60)] for k in range(parts)]
    rows = []
    for d in range(n):
        k = d * parts // n
        rows.append((d, " ".join([*part[k], *part[(k + 1) % parts], *(f"own{d}_{i}" for i in range(int(rng.integers(10, 50))))])))
    return rows


@pytest.mark.parametrize("paired", [2, 16])
def test_near_duplicates_in_chained_boilerplate(spark, monkeypatch, paired):
    monkeypatch.setattr(near_dup, "PAIRED", paired)
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    rows = boilerplate_chain()
    # Pairs of near copies hide in the chain: apart from each other's centre, alike to each other.
    rows += [(1000 + d, t.replace(f"own{d}_3", "edited")) for d, t in rows[::7]]
    want = reference.components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len({c for _, c in got.values()}) < len(rows)


def test_comparisons_grow_with_a_chain_not_with_its_square(spark, monkeypatch):
    sizes = []
    for n in (240, 960):
        compared = []
        settle = near_dup._unsettled

        def count(met, pairs, root):
            rest = settle(met, pairs, root)
            of = [r["count"] for r in rest.groupBy("whole", "grp").count().collect()] if rest is not None else []
            compared.append(pairs.count() + sum(k * (k - 1) // 2 for k in of))  # noqa: B023
            return rest

        with monkeypatch.context() as m:
            m.setattr(near_dup, "_unsettled", count)
            near_dup.classes(spark.createDataFrame(boilerplate_chain(n, n // 4), "doc_id long, text string")).count()
        sizes += compared
    assert sizes[1] < 6 * sizes[0] and sizes[1] < 960 * 959 // 8


def test_near_duplicates_with_hot_centres_copies_and_stars(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_ROWS", 0)
    monkeypatch.setattr(near_dup, "HEAVY_ROWS", 0)
    monkeypatch.setattr(near_dup, "HEAVY_KEYS", 20)
    monkeypatch.setattr(near_dup, "heavy_keys", lambda rows, on, total: common.heavy_keys(rows, on, total, 20))
    base = [f"t{i}" for i in range(100)]
    rows = [(d, " ".join(base)) for d in range(40)] + [(100 + d, " ".join([*base[: d % 90], f"x{d}", *base[d % 90 + 1 :]])) for d in range(60)] + [(500 + d, f"quite other words for each one {d}") for d in range(30)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, _kept string, rep int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.classes(df).collect()}
    assert got == reference.components(rows)
    kept = near_dup.keep_first(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, (_, c) in got.items() if c == d}


def test_near_duplicates_keep_first(spark):
    kept = near_dup.keep_first(odd(spark))
    assert kept.columns == odd(spark).columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert None in ids and 5 in ids and not ids & {6, 7, 10}


def test_decontamination(spark):
    df, items = docs_of(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = reference.leaks(listed(df), [(r["item_id"], r["text"]) for r in items.collect()])
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_found"]) for r in decontam.leaks(df, items).collect()}
    assert got == want and want
    clean = decontam.clean(df, items)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in listed(df)} - {d for d, _ in want}


def test_decontamination_of_short_items_in_long_documents(spark):
    rng = np.random.default_rng(2)
    items, docs = [], []
    for i in range(60):
        n = int(rng.integers(5, 120))
        w = [f"i{i}_{k}" for k in range(n)]
        items.append((i, " ".join(w)))
        filler = lambda: [f"f{i}_{x}" for x in rng.integers(0, 10**9, int(rng.integers(0, 3000)))]  # noqa: B023,E731
        cut = list(w)
        if n > 40:
            cut[n // 2] = "edited"
        docs.append((i, " ".join(filler() + cut + filler())))
    items += [(100, "tiny item"), (101, None), (102, "")]
    docs += [(200, "Tiny  Item"), (201, None), (202, "")]
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_found"]) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == reference.leaks(docs, items) and (200, 100) in got and len(got) == 61


def test_decontamination_of_items_under_five_words(spark):
    items = [(1, "the capital of france"), (2, "Paris"), (3, "forty two"), (4, "one two three four five"), (5, "two, three"), (6, " ")]
    docs = [(1, "what is The capital  of France today and tomorrow"), (2, "not the capital of spain, nor parish"), (3, "so\nparis it is " + "and on " * 3000 + "forty\ttwo"), (4, "zero one two three four five six"), (5, "forty"), (6, None)]
    frames = [spark.createDataFrame(rows, f"{k}_id long, text string, _doc string") for k, rows in (("doc", [(*r, "clash") for r in docs]), ("item", [(*r, "clash") for r in items]))]
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_found"]) for r in decontam.leaks(*frames).collect()}
    assert got == reference.leaks(docs, items) == {(1, 1): (1, 1), (3, 2): (1, 1), (3, 3): (1, 1), (4, 4): (1, 1)}
    assert {r["doc_id"] for r in decontam.clean(*frames).collect()} == {2, 5, 6}


def test_decontamination_amid_repeated_shingles(spark):
    items, docs = [], []
    for i in range(120):
        words = [f"i{i}_{k}" for k in range((21, 28, 37, 64)[i % 4])]
        # Every other item repeats a short phrase, so that it has far fewer distinct shingles than runs.
        item = words if i % 8 < 4 else [*words[:6], *words[:6] * (i % 5 + 4)]
        filler = [f"again{i}"] * 200
        items.append((i, " ".join(item)))
        docs.append((i, " ".join(filler + item + filler)))
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_found"]) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == reference.leaks(docs, items) and len(got) == 120


def test_decontamination_of_empty_tables(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontam.leaks(odd(spark).limit(0), items).count() == 0
    assert decontam.leaks(odd(spark), items.limit(0)).count() == 0
    assert decontam.clean(odd(spark), items.limit(0)).count() == len(ODD)


@pytest.fixture(scope="module")
def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("source", [docs_of, odd])
def test_bpe(spark, encoder, source):
    df = source(spark)
    got = {r["doc_id"]: r for r in bpe.encode(df, PATH, public_tokenizers.PATTERN).collect()}
    for d, t in listed(df):
        ids = encoder.encode_ordinary(t or "")
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_bpe_splits_and_merges_as_the_library_does(encoder):
    rng = np.random.default_rng(3)
    ranks, split = bpe.read_ranks(PATH), bpe.splitter(public_tokenizers.PATTERN)
    ids = lambda t: [x for w in split.findall(t) for x in bpe.merged(w.encode(), ranks)]
    for _ in range(4000):
        t = "".join(rng.choice(list("ab1'!\n\t \x1c\x85\u3000\u2009s\u00b2\u00e9"), rng.integers(0, 12)))
        assert ids(t) == encoder.encode_ordinary(t), repr(t)
    for t in ("x" * 20_000, "ab" * 5000 + "a", "".join(rng.choice(list("theand"), 3000)), "=" * 777, "\u6f22" * 500):
        assert bpe.merged(t.encode(), ranks) == encoder.encode_ordinary(t)


def test_bpe_of_repeated_rows_long_texts_and_many_parts(spark, encoder, monkeypatch):
    texts = ["same words again and again"] * 30 + [" ".join(f"w{i} again" for i in range(300)), "y" * 50_000, None, ""]
    rows = [(i % 20 if i % 7 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(17)
    monkeypatch.setattr(bpe, "PART_BYTES", 500)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode(df, PATH, public_tokenizers.PATTERN).collect())
    want = []
    for d, t in rows:
        ids = encoder.encode_ordinary(t or "")
        want.append((str(d), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def told(r):
    return r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], pytest.approx(r["near_edited"]), pytest.approx(r["near_next"])


def test_fingerprints(spark, monkeypatch):
    for df, size in ((docs_of(spark), 24 << 20), (docs_of(spark), 20_000), (odd(spark), 2_000)):
        monkeypatch.setattr(fingerprint, "RANGE_BYTES", size)
        rows = sorted(listed(df), key=lambda r: -(r[0] if r[0] is not None else -1))
        got = {r["doc_id"]: told(r) for r in fingerprint.fingerprints(df).collect()}
        assert len(got) == len(rows)
        for (d, _), want in zip(rows, reference.fingerprint_rows([t for _, t in rows]), strict=True):
            assert want == got[d], d
    one = spark.createDataFrame([(1, "alone and long enough for some grams to be picked")], "doc_id long, text string")
    assert [r["near_next"] for r in fingerprint.fingerprints(one).collect()] == [1.0]
    assert fingerprint.fingerprints(one.limit(0)).count() == 0


def test_fingerprints_of_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 300)
    rows = [(None, f"nobody owns text number {i} of these") for i in range(60)] + [(5, "the same row twice, word for word")] * 2 + [(5, f"another text {i} under five") for i in range(30)] + [(9, "last"), (7, None), (-3, "below")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, part string, tie int").repartition(5)
    tie = {r["text"]: r["h"] for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] if r[0] is not None else -(1 << 63), tie[r[1]]), reverse=True)
    want = sorted((str(d), *x) for (d, _), x in zip(order, reference.fingerprint_rows([t for _, t in order]), strict=True))
    got = sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in fingerprint.fingerprints(df).collect())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5:] for g in got] == [pytest.approx(w[5:]) for w in want]
    # Rows of one id are in several ranges.
    bounds = fingerprint.Bounds([0, 5, 5, 5, 9])
    assert len(set(bounds.ranges(np.full(1000, 5), np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 1000)).tolist())) == 3
    assert bounds.ranges(np.array([-9, 0, 3, 9, 10]), np.zeros(5, np.int64)).tolist() == [0, 1, 1, 5, 5]


def test_winnowing_picks_the_rightmost_minimum_of_every_window():
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 8, 31, 40, 95, 96, 500, 3000):
        text = "".join(rng.choice(list("ab"), n))
        h, p = fingerprint.winnow(text)
        assert list(zip(h.tolist(), p.tolist(), strict=True)) == reference.winnow(text)


def test_winnowing_in_chunks(monkeypatch):
    text = " ".join(map(str, range(3000)))
    whole = fingerprint.winnow(text)
    monkeypatch.setattr(fingerprint, "_CHUNK", 100)
    part = fingerprint.winnow(text)
    assert whole[0].tolist() == part[0].tolist() and whole[1].tolist() == part[1].tolist()


def test_shared_stretch_is_found():
    shared = "".join(chr(97 + i * 7 % 26) for i in range(fingerprint.GRAM + fingerprint.WINDOW - 1))
    a, b = fingerprint.winnow("left " * 30 + shared + " end" * 40), fingerprint.winnow("other " * 51 + shared + " tail" * 40)
    assert set(a[0].tolist()) & set(b[0].tolist())


def test_short_texts_keep_likeness_to_what_is_left_of_them(spark):
    texts = [r["text"] or "" for r in docs_of(spark).orderBy(F.desc("doc_id")).collect()]
    for n in (16, 24, 31, 48, 94, 150):
        some = [t[:n] for t in texts if len(t) >= n]
        for t, after in zip(some, some[1:]):
            edited = t[: n - n // 3] + after[: n // 3]
            assert fingerprint.likeness(*(set(fingerprint.winnow(x)[0].tolist()) for x in (t, edited))) > 0, (t, edited)


def test_texts_of_unlike_length_share_a_gram():
    rng = np.random.default_rng(6)
    for _ in range(300):
        letters = lambda n: "".join(rng.choice(list("abcdefgh"), n))
        short = letters(int(rng.integers(71, 140)))
        long = letters(2000) + short[: fingerprint.GRAM + fingerprint.WINDOW - 1] + letters(2000)
        assert set(fingerprint.winnow(short)[0].tolist()) & set(fingerprint.winnow(long)[0].tolist())


def test_sharding(spark, monkeypatch):
    df = docs_of(spark)
    monkeypatch.setattr(sharding, "RUN_ROWS", 3)
    rows = {r["doc_id"]: r for r in sharding.assign(df, [1.0] * 16, [1.0] * 17).collect()}
    texts = dict(listed(df))
    assert rows.keys() == texts.keys()
    slots = {}
    for d, r in rows.items():
        raw = (texts[d] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 16)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert any(r["grown_shard"] == 16 for r in rows.values())
    assert sharding.assign(df.limit(0), [1.0] * 2).count() == 0
    twice = sharding.assign(odd(spark).union(odd(spark)), [1.0])
    assert sorted(r["slot"] for r in twice.collect()) == list(range(2 * len(ODD)))


def test_sharding_numbers_hot_ids_in_order(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_ROWS", 0)
    monkeypatch.setattr(sharding, "heavy_keys", lambda rows, on, total: common.heavy_keys(rows, on, total, 10))
    rows = [(None, f"nobody {i}") for i in range(200)] + [(7, "seven" * (i % 9)) for i in range(150)] + [(i, "x") for i in range(100, 400)] + [(8, "same")] * 60
    got = sharding.assign(spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, size int, _run string"), [1.0, 1.0]).collect()
    assert len(got) == len(rows)
    for shard in (0, 1):
        mine = sorted((r for r in got if r["shard"] == shard), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        order = [(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest(), r["size"], r["text_crc32"]) for r in mine]
        assert order == sorted(order)


def test_sharding_by_brute_force_and_growth_of_weighted_shards(spark):
    weights, grown = [1.0, 3.0, 0.5], [1.0, 3.0, 0.5, 2.0]

    def best(key, weights):
        u = [(int(hashlib.md5(f"{key}/{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for j in range(len(weights))]
        return max(range(len(weights)), key=lambda j: (-weights[j] / math.log(u[j]), -j))

    ids = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    for r in sharding.assign(ids, weights, grown).collect():
        assert (r["shard"], r["grown_shard"]) == (best(r["doc_id"], weights), best(r["doc_id"], grown))
        assert r["grown_shard"] in (r["shard"], 3)


def test_sharding_follows_weights(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    share = {r["shard"]: r["count"] / 20_000 for r in sharding.assign(ids, [1.0, 2.0, 5.0]).groupBy("shard").count().collect()}
    assert [round(share[j], 1) for j in range(3)] == [0.1, 0.2, 0.6] or abs(share[2] - 0.625) < 0.02
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit("k"), [1.0, 0.0])


def test_a_cluster_must_name_a_shared_folder():
    class Fake:
        def __init__(self, master, named=None):
            self.sparkContext = self.conf = self
            self.master, self.named, self.dir = master, named, None

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, at):
            self.dir = at

        def get(self, name, default):
            return self.named

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.with_checkpoint_dir(Fake("spark://host:7077"))
    for fake in (Fake("spark://host:7077", "hdfs:///shared"), Fake("local[*]"), Fake("local")):
        common.with_checkpoint_dir(fake)
        assert fake.dir and (fake.named is None or fake.dir == fake.named)


def test_heavy_keys_join_as_other_keys_do(spark):
    rows = spark.createDataFrame([(i % 3 if i < 60 else i, i) for i in range(100)], "k long, v long")
    facts = spark.createDataFrame([(k, f"f{k}") for k in (0, 1, 70, 500)], "k long, f string")
    heavy = common.heavy_keys(rows, ["k"], 20_000, 2_000)
    assert sorted(r["k"] for r in heavy.collect()) == [0, 1, 2] and common.heavy_keys(rows, ["k"], 100) is None
    for how in ("inner", "left"):
        got, want = (sorted(map(str, df.select("k", "v", "f").collect())) for df in (common.joined(rows, facts, ["k"], heavy, how), rows.join(facts, ["k"], how)))
        assert got == want
