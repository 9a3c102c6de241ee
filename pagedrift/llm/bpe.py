"""Byte-level BPE over a global shuffle of distinct pre-tokens.

Each text is split once into pre-tokens. Texts of some megabytes make a chunk, which stays where it is as positions: for each
place in its texts the number of the pre-token there. A chunk sends each of its distinct pre-tokens to the part of the
vocabulary that the pre-token's hash names. There each distinct pre-token of the corpus is encoded once, and decoded once by
a join of its ids with the token-byte table; ids and bytes return to the chunks and are put together by position.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import marshal
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagedrift.llm.common import lean, parts_for, released, slices, text_bytes

#: White space as Unicode has it; Python's own class also takes U+001C to U+001F.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Text of a chunk, in code points; a longer text is a chunk of its own.
CHUNK = 8 << 20
#: Text for which there is one more part of the vocabulary, in bytes, and parts at most: what a chunk sends is bounded so.
PART_BYTES, MOST_PARTS = 32 << 20, 4096
#: Code points up to which a text's pre-tokens are listed at once, and pre-tokens that are put together at once.
LISTED, SLAB = 1 << 20, 1 << 20
#: Rows of ids that leave an encoding task at once.
ROWS = 50_000


def splitter(pattern: str) -> regex.Pattern:
    """The pattern compiled with white space as Unicode has it."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"(?!\S)", f"(?![^{_WHITE}])").replace(r"\s", f"[{_WHITE}]"))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: of neighbouring parts the pair of the lowest rank merges first, the leftmost of equal ones.

    A heap of pairs makes this n log n in the length of the pre-token, which may be a whole text.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is no start any more
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class _Numbered(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def _pack(x) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(marshal.dumps(x))


def _unpack(x: bytes):
    return marshal.loads(zstandard.ZstdDecompressor().decompress(x))


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on, which packs well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _split(pattern: str, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (slot, chunk, payload): for each chunk its texts as positions, at slot chunk, and its distinct pre-tokens by parts
    of the vocabulary, at slot -1 - part. Pre-tokens are numbered in order of part."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = splitter(pattern)
        task = TaskContext.get().partitionId()
        made = 0
        found, ids, used, size = _Numbered(), [], [], 0

        def chunk() -> pa.RecordBatch:
            name = task << 32 | made
            spelled = [w.encode() for w in found]
            part = np.fromiter((zlib.crc32(w) % parts for w in spelled), np.uint32, len(spelled))
            order = np.array(sorted(range(len(spelled)), key=spelled.__getitem__), np.int64)
            order = order[np.argsort(part[order], kind="stable")].tolist()
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            rows = [(name, _pack((ids, [len(u) for u in used], _planes(rank[np.concatenate(used)]))))]
            rows += [(-1 - p, _pack([spelled[i] for i in group])) for p, group in itertools.groupby(order, part.tolist().__getitem__)]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([name] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["slot", "chunk", "payload"])

        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or ""
                if ids and size + len(text) > CHUNK:
                    yield chunk()
                    made += 1
                    found, ids, used, size = _Numbered(), [], [], 0
                each = find.findall(text) if len(text) <= LISTED else (m[0] for m in find.finditer(text))
                ids.append(doc_id)
                used.append(np.fromiter(map(found.__getitem__, each), np.uint32))
                size += len(text)
        if ids:
            yield chunk()

    return split


def _encoded(ranks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (word, token) for each pre-token that a task meets first, numbered as they come, a row an id; and after them rows
    (chunk, part, asked) that name what a chunk asks for by these numbers."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, numbers = ranks.value, _Numbered()
        words, tokens, asked = [], [], []

        def flush() -> pa.RecordBatch:
            n, m = len(words), len(asked)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
            values = [words + [None] * m, tokens + [None] * m, *([None] * n + [a[i] for a in asked] for i in range(3))]
            for x in (words, tokens, asked):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["word", "token", "chunk", "part", "asked"])

        for b in batches:
            for i, slot in enumerate(b.column(0).to_pylist()):
                if slot >= 0:
                    continue
                line = []
                for w in _unpack(b.column(2)[i].as_py()):
                    before = len(numbers)
                    k = numbers[w]
                    if k == before:
                        ids = merged(w, known)
                        tokens += ids
                        words += [k] * len(ids)
                    line.append(k)
                asked.append((b.column(1)[i].as_py(), -1 - slot, _pack(_planes(np.array(line, np.uint32)))))
                if len(words) >= ROWS:
                    yield flush()
        if asked:
            yield flush()
        numbers.clear()
        released()

    return encoded


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slot, part, payload): for what a chunk asked, the ids and the bytes of each pre-token and how many they are.

    The ids of a pre-token come before the first row that asks for it, in the order in which the task before wrote them.
    """
    tokens: list[bytes] = []
    spelled: list[bytes] = []
    for b in batches:
        word = b.column("word").drop_null()
        n = len(word)
        if n:
            has = b.column("word").is_valid()
            w = np.array(word)
            ids = np.array(b.column("token").filter(has)).astype("<u4").tobytes()
            data = b.column("bytes").filter(has).to_pylist()
            heads = np.concatenate(([0], np.flatnonzero(np.diff(w)) + 1, [n])).tolist()
            for s, e in zip(heads, heads[1:]):
                k = w[s]
                if k == len(tokens):
                    tokens.append(b"")
                    spelled.append(b"")
                elif k != len(tokens) - 1:
                    raise RuntimeError("ids of pre-tokens have come out of order")
                tokens[k] += ids[4 * s : 4 * e]
                spelled[k] += b"".join(data[s:e])
        rows = []
        for chunk, part, packed in zip(*(b.column(c).filter(b.column("word").is_null()).to_pylist() for c in ("chunk", "part", "asked")), strict=True):
            line = _numbers(_unpack(packed)).tolist()
            answer = []
            for table in (tokens, spelled):
                found = [table[k] for k in line]
                answer += [_planes(np.array([len(x) for x in found], np.uint32)), b"".join(found)]
            rows.append((chunk, part, _pack(tuple(answer))))
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["slot", "part", "payload"])
    tokens.clear()
    spelled.clear()
    released()


def _gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The stretches of flat that the entries `at` of start and length name, one after the other."""
    n = length[at]
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(start[at] - (ends - n), n)]


def _assembled(home: pa.Table, answers: pa.Table) -> pa.Table:
    parts = sorted(zip(answers.column("part").to_pylist(), answers.column("payload").to_pylist(), strict=True))
    found = [_unpack(x) for _, x in parts]
    tables = []
    for i, kind in ((0, "<u4"), (2, np.uint8)):
        width = np.dtype(kind).itemsize
        length = np.concatenate([_numbers(f[i]).astype(np.int64) // width for f in found] or [np.zeros(0, np.int64)])
        tables.append((np.frombuffer(b"".join(f[i + 1] for f in found), kind), np.cumsum(length) - length, length))
    rows = []
    for packed in home.column("payload"):
        ids, counts, planes = _unpack(packed.as_py())
        used, at = _numbers(planes), 0
        for doc_id, count in zip(ids, counts, strict=True):
            n, digests = 0, (hashlib.sha256(), hashlib.sha256())
            for s in range(at, at + count, SLAB):
                places = used[s : min(s + SLAB, at + count)]
                n += int(tables[0][2][places].sum())
                for table, digest in zip(tables, digests, strict=True):
                    digest.update(_gathered(*table, places).tobytes())
            rows.append((doc_id, n, *(d.hexdigest() for d in digests)))
            at += count
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    released()
    return pa.table({name: pa.array(v, kind) for name, v, kind in zip(("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)})


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every whole text of docs(doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    path names a rank file (a token in base64 and its rank on each line), which the driver reads and ships; pattern is the
    split before the merges. The ids are those of byte-pair merging by rank within each match of the pattern; special tokens
    are ordinary text. A null text is empty and has no tokens; an empty table gives an empty result; a repeated row gives a
    row each time, whatever its id; other columns play no part.

    One shuffle serves both sides: positions go to their chunk's task, distinct pre-tokens to the vocabulary. A second brings
    the answers. A chunk sends at most MOST_PARTS messages, so their number grows with the text, and a pre-token is in one of
    them however often the chunk holds it, so no part is hot. The token-byte table is broadcast: a row for each rank.
    """
    spark = docs.sparkSession
    lean(spark)
    ranks = read_ranks(path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = min(MOST_PARTS, parts_for(text_bytes(rows), PART_BYTES))
    dealt = rows.mapInArrow(_split(pattern, parts), "slot long, chunk long, payload binary").repartition("slot")
    asked = dealt.mapInArrow(_encoded(spark.sparkContext.broadcast(ranks)), "word int, token int, chunk long, part int, asked binary")
    by_rank = sorted((rank, token) for token, rank in ranks.items())
    tokens = spark.createDataFrame(pa.table({"token": pa.array([r for r, _ in by_rank], pa.int32()), "bytes": pa.array([t for _, t in by_rank], pa.binary())}))
    answered = asked.join(F.broadcast(tokens), "token", "left").mapInArrow(_answered, "slot long, part int, payload binary")
    # Not known beforehand to the optimiser, or it would deal the positions by a shuffle of their own.
    homes = dealt.where(F.when(F.monotonically_increasing_id() >= 0, F.col("slot") >= 0))
    return homes.groupBy("slot").cogroup(answered.groupBy("slot")).applyInArrow(_assembled, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
