"""Document fingerprints by winnowing, and each document's likeness to an edited text and to the next document."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagedrift.llm.common import lean, parts_for, slices, text_bytes

#: Code points of a gram, and grams of a window at most: any shared stretch of GRAM + WINDOW - 1 code points shares a selected
#: gram. Grams are as long in short texts as in long ones, so that all compare; windows shrink with the text.
GRAM, WINDOW = 8, 64
#: Windows of a text at least, as far as it has so many grams.
WINDOWS = 8
#: Text of a range of documents, in bytes, and ranges at most: the driver holds one first document's id for each.
RANGE_BYTES, MOST_RANGES = 24 << 20, 16_384
#: Grams that are hashed at once; positions within them fill the low bits.
_BITS = 20
_CHUNK = (1 << _BITS) - 1 - WINDOW
_BASE = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1
LEAST_ID = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(points: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of all runs of k code points, k a power of two: a run's hash joins those of its halves."""
    h, step = _mix(points.astype(np.uint64) + np.uint64(1)), 1
    while step < k:
        h = h[:-step] * np.uint64(pow(_BASE, step, _M + 1)) + h[step:]
        step *= 2
    return _mix(h)


def window_of(grams: int) -> int:
    """Window for a text of so many grams: the largest power of two up to WINDOW that goes WINDOWS times into them.

    The minimum of a window is that of each smaller window around it within the shared stretch, so texts of unlike length
    still share a selected gram in a stretch that fills the larger of their windows.
    """
    return min(WINDOW, 1 << max(0, (max(1, grams) // WINDOWS).bit_length() - 1))


def winnow(text: str, gram: int = GRAM, window: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Selected hashes and their positions: the minimum of each window, the rightmost of equal ones, each once.

    gram and window are powers of two; the window is window_of() the text's grams if none is given. A text shorter than a gram gives one hash of the whole at 0; one with fewer grams
    than a window is one window; an empty text gives nothing. Memory is bounded for any length: the text is hashed in
    overlapping chunks.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n < gram:
        whole = int.from_bytes(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:8], "big")
        return np.array([whole >> _BITS], np.uint64), np.zeros(1, np.int64)
    grams = n - gram + 1
    window = min(window or window_of(grams), grams)
    low = np.uint64((1 << _BITS) - 1)
    hashes, places = [], []
    for start in range(0, max(1, grams - window + 1), _CHUNK):
        h = _grams(points[start : start + _CHUNK + window - 1 + gram - 1], gram)
        v = ((h >> np.uint64(_BITS)) << np.uint64(_BITS)) | (low - np.arange(len(h), dtype=np.uint64))
        m, step = v, 1
        while step * 2 <= window:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        if step < window:
            m = np.minimum(m[: len(m) - (window - step)], m[window - step :])
        m = m[np.concatenate(([True], m[1:] != m[:-1]))]
        hashes.append(m >> np.uint64(_BITS))
        places.append((low - (m & low)).astype(np.int64) + start)
    h, p = np.concatenate(hashes), np.concatenate(places)
    keep = np.concatenate(([True], p[1:] != p[:-1]))
    return h[keep], p[keep]


def likeness(a: set[int], b: set[int]) -> float:
    """Share of the selected hashes of either that both have; 1 if neither has any."""
    union = len(a | b)
    return len(a & b) / union if union else 1.0


def written(h: np.ndarray, p: np.ndarray) -> str:
    """24 hexadecimal digits for each selected gram, by position: 16 of the hash, 8 of the position."""
    out = np.empty(len(h), [("h", ">u8"), ("p", ">u4")])
    out["h"], out["p"] = h, p
    return out.tobytes().hex()


class Bounds:
    """Where ranges of rows end, in ascending order of key, then tie. A row belongs to the range after the last bound that
    isn't above it."""

    def __init__(self, keys: list[int]):
        """A key that takes several places among the quantiles has its rows divided among as many ranges, by tie."""
        found = [(k, LEAST_ID + (i << 64) // n) for k, n in sorted(Counter(keys).items()) for i in range(n)]
        self.keys, self.ties = (np.array([b[i] for b in found], np.int64) for i in range(2))

    def ranges(self, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for i in np.flatnonzero(high > low):
            low[i] += np.searchsorted(self.ties[low[i] : high[i]], ties[i], "right")
        return low


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array(b.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("key", "tie"))


def _first_rows(bounds: Bounds):
    """The first row in descending order, that is the largest (key, tie), of each range that a task sees."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, tuple[int, int]] = {}
        for b in batches:
            keys, ties = _arrays(b)
            for p, *row in zip(bounds.ranges(keys, ties).tolist(), keys.tolist(), ties.tolist(), strict=True):
                most[p] = max(most.get(p, (LEAST_ID, LEAST_ID)), tuple(row))
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (list(most), [k for k, _ in most.values()], [t for _, t in most.values()])], ["part", "key", "tie"])

    return first


def _by_range(bounds: Bounds, heads: dict[tuple[int, int], list[int]]):
    """Each row to its range, and the first row of a range also to the range before it in descending order, as its halo."""

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ties = _arrays(b)
            rows = [(p, False, i) for i, p in enumerate(bounds.ranges(keys, ties).tolist())]
            rows += [(p, True, i) for i, row in enumerate(zip(keys.tolist(), ties.tolist(), strict=True)) for p in heads.get(row, ())]
            for s in range(0, len(rows), 500):
                part, halo, at = zip(*rows[s : s + 500], strict=True)
                taken = b.take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(halo, pa.bool_()), *(taken.column(c) for c in ("key", "tie", "text"))], ["part", "halo", "key", "tie", "text"])

    return by_range


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    last = None  # part, key, text, fingerprint

    def close(text: str, selected) -> None:
        _, key, own, (h, p) = last
        m = len(own) // 3
        edited = own[: len(own) - m] + text[:m]
        eh, ep = winnow(edited)
        mine = set(h.tolist())
        rows.append((None if key == LEAST_ID else key, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(h, p), written(eh, ep), likeness(mine, set(eh.tolist())), likeness(mine, set(selected[0].tolist()))))

    for b in slices(batches):
        for part, halo, key, text in zip(*(b.column(c).to_pylist() for c in ("part", "halo", "key", "text")), strict=True):
            if last is not None and last[0] == part:
                now = winnow(text)
                close(text, now)
                last = None if halo else (part, key, text, now)
            elif not halo:
                last = (part, key, text, winnow(text))
            if len(rows) >= 500:
                yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, r, strict=True)) for r in rows], _OUT)
                rows.clear()
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, r, strict=True)) for r in rows], _OUT)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text of docs(doc_id, text) and its edited text: see _OUT for the columns.

    The edited text has the last third of the code points replaced by the first as many of the next document, by
    descending doc_id; after the last comes the first. A null text is empty and a null doc_id comes last. Rows with equal
    ids follow each other by a hash of the text, descending. An empty table gives an empty result; a lone row is its own next
    document; other columns play no part.

    One shuffle, by ranges of doc_id. Each range also gets the first document of the range that follows it, so no
    neighbour is looked up by a join, and a task holds two documents at a time, however many its range has. An id that very
    many rows bear is divided among ranges by the hash of their texts.
    """
    lean(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("key", F.xxhash64("text").alias("tie"), "text")
    n = min(MOST_RANGES, parts_for(text_bytes(rows), RANGE_BYTES))
    found = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("q")).first()["q"] or []
    bounds = Bounds(found)
    first = rows.select("key", "tie").mapInArrow(_first_rows(bounds), "part long, key long, tie long")
    order = sorted((r["part"], r["row"]) for r in first.groupBy("part").agg(F.max(F.struct("key", "tie")).alias("row")).collect())[::-1]  # a row for each range
    heads: dict[tuple[int, int], list[int]] = {}
    for i, (part, _) in enumerate(order):
        heads.setdefault(tuple(order[(i + 1) % len(order)][1]), []).append(part)
    dealt = rows.mapInArrow(_by_range(bounds, heads), "part int, halo boolean, key long, tie long, text string")
    # A range's number names its task, so that no two ranges meet in one.
    shuffled = dealt.repartitionById(len(found) + 1, "part").sortWithinPartitions("part", "halo", F.desc("key"), F.desc("tie"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return shuffled.mapInArrow(_compared, schema)
