"""Functions on values that the rules name."""

import difflib
import random
import time
import tracemalloc
from datetime import datetime
from email.utils import parsedate_to_datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagedrift.functions import differences, display, fetching, text, urls

from .test_operators import one, slow_normal


def test_canonical_urls_keep_all_parameters(spark):
    cases = {
        "http://e.com/?q=100%&x=1": "http://e.com/?q=100%25&x=1",
        "http://e.com/?q=50%&x=1": "http://e.com/?q=50%25&x=1",
        "http://e.com/?q=%zz%20a&b=%E0": "http://e.com/?b=%EF%BF%BD&q=%25zz+a",
        "\t http://e.com/a\nb  ": "http://e.com/ab",
        "http://e.com/?a&a=&b=1=2": "http://e.com/?a=&a=&b=1%3D2",
    }
    assert one(spark, list(cases), urls.canonical) == list(cases.values())
    assert one(spark, ["http://e.com", "http://e.com/a/b?c#d"], urls.pathname) == ["/", "/a/b"]


def test_dates(spark):
    mail = ["Mon, 01 Jan 2024 10:00:00 +0600", "Monday, 01-Jan-24 10:00:00 EST", "1 Jan 99 10:00 PDT", "01 January 2024 10:00:00", "Tue, 2 Jan 2024 03:04:05 -0330 (note)", "1 Jan 2024 10:00:00 GMT"]
    iso = ["2024-01-01T10:00:00Z", "20240101", "2024-01-01", "2024-01-01 10:11:12.5+06:00", "20240101T101112", "2024-01-01T10"]
    bad = ["soon", "", None, "2024-13-01", "31 Feb 2024 10:00:00 +0000", "99"]
    want = []
    for t in mail:
        d = parsedate_to_datetime(t)
        want.append(d.timestamp() if d.tzinfo else d.replace(tzinfo=datetime.fromisoformat("2024-01-01T00:00:00+00:00").tzinfo).timestamp())
    for t in iso:
        d = datetime.fromisoformat(t)
        want.append((d if d.tzinfo else datetime.fromisoformat(d.isoformat() + "+00:00")).timestamp())
    for zone in ("UTC", "Asia/Dhaka"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = one(spark, mail + iso + bad, lambda c: F.unix_micros(fetching.parsed_date(c)) / 1e6)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == want + [None] * len(bad)
    assert len(one(spark, ["x" * 3000], fetching.cut_error)[0]) == 2000


def test_hashes_of_rows_equal_the_hash_of_each_column(spark):
    rng = random.Random(3)
    alphabet = ["a", "B", " ", "\n", "\r", "\t", "­", "«", "»", " ", "\u0085", "\x1c", "é", "é", "​", "“", text.ZWJ, "ত", "."]
    rows = [tuple("".join(rng.choices(alphabet[: rng.choice([14, 19])], k=rng.randint(0, 8))) if rng.random() < 0.95 else None for _ in range(2)) for _ in range(800)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, a string, b string")
    got = text.with_hashes(df, {"x": "a", "y": "b"}).join(df.select(F.col("id"), text.text_hash(F.col("a")).alias("p"), text.text_hash(F.col("b")).alias("q")), "id").collect()
    assert len(got) == len(rows) and all(r["x"] == r["p"] and r["y"] == r["q"] for r in got)
    assert slow_normal("«a»­") == '"a"'


def test_word_changes_equal_the_whole_table(spark):
    def by_table(a, b):
        import re

        a, b = (re.findall(r"\s+|\S+", t) for t in (a, b))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i, j] = best[i + 1, j + 1] + 1 if a[i] == b[j] else max(best[i + 1, j], best[i, j + 1])
        out, i, j = [], 0, 0
        while i < len(a) or j < len(b):
            if i < len(a) and j < len(b) and a[i] == b[j]:
                step, i, j = (a[i], "same"), i + 1, j + 1
            elif i < len(a) and (j == len(b) or best[i + 1, j] >= best[i, j + 1]):
                step, i = (a[i], "del"), i + 1
            else:
                step, j = (b[j], "ins"), j + 1
            if out and out[-1][1] == step[1]:
                out[-1] = (out[-1][0] + step[0], step[1])
            else:
                out.append(step)
        return out

    rng = random.Random(5)
    for _ in range(300):
        a, b = (" ".join(rng.choices("pqrs", k=rng.randint(0, 30))) for _ in "ab")
        assert differences.word_changes(a, b) == by_table(a, b), (a, b)
    long = "w " * 9000
    assert differences.word_changes(long, long + "x")[-1] == ("x", "ins")


def test_first_change_of_very_long_texts():
    a = "same " * 3000 + "old" + " end" * 3000
    b = "same " * 3000 + "new words" + " end" * 3000
    assert "old" in (shown := differences.first_change(a, b)) and "new words" in shown and len(shown) < 400
    assert differences.first_change("a" * 6000, "a" * 7000).endswith("a" * 60)


def test_word_changes_are_packed_in_parts(spark):
    rng = random.Random(6)
    pairs = [tuple(" ".join(rng.choices("pqrstuvwxyz", k=300)) for _ in "ab") for _ in range(600)] + [(None, "x"), (None, None)]
    a, b = (pa.array(x, pa.string()) for x in zip(*pairs))
    tracemalloc.start()
    got = differences._word_changes.func(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6
    assert got[:9].to_pylist() == [[{"text": t, "tag": k} for t, k in differences.word_changes(x, y)] for x, y in pairs[:9]]
    assert got[-2:].to_pylist() == [[{"text": "x", "tag": "ins"}], []]
    df = spark.createDataFrame([(1, "a " * 9999, "a " * 9998 + "b "), (2, "a " * 60_000, "b " * 60_000), (3, None, "w")], "id int, a string, b string")
    told = {r["id"]: r["c"] for r in df.select("id", differences.word_diff(F.col("a"), F.col("b")).alias("c")).collect()}
    assert [tuple(x) for x in told[1]] == [("a " * 9998, "same"), ("a", "del"), ("b", "ins"), (" ", "same")] and told[2] is None and [tuple(x) for x in told[3]] == [("w", "ins")]


def quicker(use, than, pairs, times):
    """Whether use() takes less than a part of the time of than() on the same pairs."""
    took = []
    for f in (use, than):
        start = time.process_time()
        for p in pairs:
            f(*p)
        took.append(time.process_time() - start)
    return took[0] * times < took[1]


def by_difflib(a, b):
    return next(op for op in difflib.SequenceMatcher(None, a, b, False).get_opcodes() if op[0] != "equal")[1:]


def test_first_change_of_a_text_within_another():
    rng = random.Random(7)
    texts = ["".join(rng.choices("abcdef gh", k=500)) for _ in range(40)]
    pairs = [(t, t + "@#added") for t in texts] + [("new " + t, t) for t in texts] + [(t, "ab" + t + "c") for t in texts]
    assert quicker(differences._changed_spans, by_difflib, pairs, 10)
    for a, b in [*pairs, ("", "x"), ("x", ""), ("a", "aa"), ("aab", "b"), ("ab", "xabab")]:
        assert differences._changed_spans(a, b) == by_difflib(a, b), (a, b)


def test_word_changes_begin_after_the_common_words():
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(200)) for _ in range(100)]
    start = time.process_time()
    got = [differences.word_changes(t, t + " @#new words") for t in texts]
    assert time.process_time() - start < 0.2
    assert got == [[(t, "same"), (" @#new words", "ins")] for t in texts]


def test_first_change_is_that_of_difflib():
    rng = random.Random(9)
    assert quicker(differences._changed_spans, by_difflib, [tuple("".join(rng.choices("abcdefgh ijklmnop", k=1200)) for _ in "ab") for _ in range(20)], 2)
    for _ in range(2000):
        letters = rng.choice(["ab", "abcdefgh", "a\u00e9\U0001f600"])
        a, b = ("".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in "ab")
        b = rng.choice([b, a[:5] + b, "".join(c if rng.random() < 0.9 else " " for c in a)])
        if a != b:
            assert differences._changed_spans(a, b) == by_difflib(a, b), (a, b)


def test_display(spark):
    fields = "from_headline string, to_headline string, from_byline string, to_byline string, from_published_at string, to_published_at string, from_final_url string, to_final_url string, body_diff string"
    kinds = ["HEADLINE_CHANGED", "BYLINE_REMOVED", "DATE_CHANGED", "REDIRECTED", "BODY_CHANGED", "GONE_404"]
    df = spark.createDataFrame([(k, ("h", "i", "b", None, "p", "q", "u", "v", "- x")) for k in kinds], f"type string, e struct<{fields.replace(' string', ':string')}>")
    got = {r["type"]: [tuple(x) for x in r["c"]] for r in df.select("type", display.changed_fields(F.col("type")).alias("c")).collect()}
    assert got == {"HEADLINE_CHANGED": [("h", "i", None)], "BYLINE_REMOVED": [("b", None, None)], "DATE_CHANGED": [("p", "q", None)], "REDIRECTED": [("u", "v", None)], "BODY_CHANGED": [(None, None, "- x")], "GONE_404": []}
    assert one(spark, [0.0, 0.031, 0.1, 0.894, 1.0], display.percent, "double") == ["0%", "3.1%", "10%", "89%", "100%"]
    assert one(spark, [0.0, 25.0, 100.0], lambda v: F.round(display.radius(v, F.lit(100.0)), 3), "double") == [2.2, 4.5, 6.8]
    assert one(spark, [0.2, 7.4, 10.0, 449.0, 6283.0], display.nice, "double") == [1.0, 7.0, 10.0, 400.0, 6000.0]
    assert one(spark, ["2024-01-01 20:30:00"], lambda c: display.local_time(c.cast("timestamp"))) == ["2024-01-02 02:30"]
    assert one(spark, ["/web/20240101000000/http://e.com/a", "/save/x", None], display.archive_url) == ["https://web.archive.org/web/20240101000000/http://e.com/a", None, None]
    assert one(spark, ["job spn2-0123456789abcdef0123 queued", "none"], display.archive_job) == ["spn2-0123456789abcdef0123", None]
    assert one(spark, ["error:too-many-daily", "Not Found"], display.archive_failure) == ["rate_limited", "error"]
