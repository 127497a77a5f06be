"""Removal of repeated byte strings by a sparse, range-partitioned suffix array.

Every byte is removed that lies in a string of ``length`` bytes which starts anywhere else too.

Sorting the suffix of every byte would shuffle each byte hundreds of times, so suffixes are sampled
by content: in each window of ``length`` bytes the token (``token`` bytes) with the smallest hash,
leftmost on ties, is the window's anchor. Equal windows have equal anchors at equal offsets, so only
windows whose anchor token occurs twice or more can be repeated; the rest are dropped by counting
tokens. The windows of one anchor lie side by side and form its context: the suffix that starts at
the anchor, and the bytes before it. Contexts that are equal are one with its copies counted.

What remains, tokens with different contexts, is sorted. A first order, by token and by the reversed
bytes before it, tells from neighbours how many bytes before its anchor a context shares with any
other (its reach). Then the suffixes are range-partitioned by their bytes, leading token first and,
so that crowded tokens are divided too, by what follows it and by the reversed bytes before it; the
splitters are sampled. In a range, buckets of bounded size are
sorted by multikey quicksort, eight bytes at a time, once by the suffixes and once by the reversed
bytes before them. In both orders the contexts that share a given number of bytes lie side by side,
as the common prefixes of neighbours tell. A window with o bytes before its anchor is repeated if
another context is in its class of ``length`` - o bytes in the first order and of o bytes in the
second. Classes that reach the edge of a bucket whose token may go on in the next one are compared
across the boundary: one row for each window class of such a bucket with no more than its reach
before the anchor, counted over all buckets.

Defined results: null text is the empty text; texts shorter than ``length`` bytes lose nothing;
repeated rows are copies of each other and lose everything if long enough; matches may overlap,
lie in one document and begin inside a character; matches never cross documents; an empty table
gives an empty result. Extra columns are ignored by the report; the removal passes them through,
whatever their names. Removal in the pipeline decodes what is left and drops the bytes of divided
characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideflow.llm.common import extended, plainly_joined, shuffle_width, sliced, text_of, written

ODD = np.uint64(0x9E3779B97F4A7C15)
STEP = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
PLACE = np.uint64(0xFFFFFF)
PIECE = 1 << 20


@dataclass(frozen=True)
class Settings:
    """length: bytes of a repeated string. token: bytes of a token, a power of two up to 64.
    bucket: contexts that are sorted together; a token with more goes on in the next bucket."""

    length: int = 200
    token: int = 64
    bucket: int = 16_000

    def __post_init__(self) -> None:
        if self.token not in (1, 2, 4, 8, 16, 32, 64) or self.length < self.token:
            raise ValueError("token must be a power of two up to 64, and length no less than token")

    @property
    def span(self) -> int:
        """Tokens that start in one window."""
        return self.length - self.token + 1


def tokens(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes that start at each place, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * ODD
    h ^= h >> np.uint64(29)
    n = 1
    for factor in STEP:
        if n >= size:
            break
        h = h[:-n] * np.uint64(factor) + h[n:]
        h ^= h >> np.uint64(31)
        n *= 2
    return h


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def pieces(texts: list[bytes], settings: Settings, most: int = 1 << 23) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of about PIECE bytes: (row, offset in its text, bytes). A text of over ``most`` bytes is
    cut into parts that overlap by a window less one byte, so each window lies in one part."""
    rows, offsets, parts, size = [], [], [], 0
    for row, text in enumerate(texts):
        if len(text) < settings.length:
            continue
        for at in range(0, len(text) - settings.length + 1, most):
            part = text[at : at + most + settings.length - 1] if len(text) > most else text
            rows.append(row)
            offsets.append(at)
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
    if rows:
        yield rows, offsets, parts


def anchors_of(parts: list[bytes], settings: Settings) -> tuple[np.ndarray, ...]:
    """(part, start, windows, anchor's offset from start, token) of each anchor's context."""
    whole = b"".join(parts)
    lengths = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    h = tokens(np.frombuffer(whole, np.uint8), settings.token)
    key = ((h * ODD) & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    best = (sliding_minimum(key, settings.span) & PLACE).astype(np.int64)
    # windows that lie in one part
    first = np.repeat(starts, lengths - settings.length + 1)
    index = np.arange(len(first)) - np.repeat(np.cumsum(lengths - settings.length + 1) - (lengths - settings.length + 1), lengths - settings.length + 1)
    place = first + index
    anchor = best[place]
    begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (index[1:] == 0)]))
    count = np.diff(np.concatenate([begin, [len(anchor)]]))
    start = place[begin]
    part = np.searchsorted(starts, start, side="right") - 1
    return part, start - starts[part], count, anchor[begin] - start, h[anchor[begin]].view(np.int64)


ANCHORS = "own long, text_hash long, token long, context long, starts array<int>, away int, windows int"


def anchors(rows: DataFrame, settings: Settings) -> DataFrame:
    """A row for each distinct context of each of rows (own, text_hash, __text), with all its starts.

    A text that repeats itself gives each context once. away is the anchor's offset from the start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_ in sliced(batch):
                texts = slice_.column("__text").cast(pa.binary()).to_pylist()
                for row, offset, parts in pieces(texts, settings):
                    part, start, count, away, token = anchors_of(parts, settings)
                    ends = start + count + settings.length - 1
                    context = np.array([xxhash.xxh3_64_intdigest(parts[p][a:b]) for p, a, b in zip(part.tolist(), start.tolist(), ends.tolist())], np.uint64).view(np.int64)
                    own, start = np.array(row)[part], start + np.array(offset)[part]
                    order = np.lexsort((start, context, token, own))
                    own, start, context, token, away, count = (x[order] for x in (own, start, context, token, away, count))
                    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (token[1:] != token[:-1]) | (context[1:] != context[:-1])]))
                    starts = pa.ListArray.from_arrays(pa.array(np.append(first, len(start)), pa.int32()), pa.array(start.astype(np.int32)))
                    take = pa.array(own[first])
                    yield pa.RecordBatch.from_arrays(
                        [slice_.column("own").take(take), slice_.column("text_hash").take(take), pa.array(token[first]), pa.array(context[first]), starts, pa.array(away[first].astype(np.int32)), pa.array(count[first].astype(np.int32))],
                        [x.split()[0] for x in ANCHORS.split(", ")],
                    )

    return rows.mapInArrow(run, ANCHORS)


def padded_words(strings: list[bytes], size: int) -> np.ndarray:
    """(string, word) of big-endian eight-byte words; strings are filled up with zero bytes."""
    width = max(8, -(-size // 8) * 8)
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in strings), ">u8").astype(np.uint64).reshape(len(strings), width // 8)


def multikey_quicksort(words: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The order of the rows of words by run, then by words: ternary partitions about a pivot word.

    All open segments are divided in one step. The part below and the part above a segment's pivot go
    on with the same word, the part that equals it with the next one; single rows are done.
    """
    n, depth_limit = words.shape
    order = np.argsort(run, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], run[order][1:] != run[order][:-1], [True]]))
    start, size = cut[:-1], np.diff(cut)
    depth = np.zeros(len(start), np.int64)
    while True:
        live = (size > 1) & (depth < depth_limit)
        start, size, depth = start[live], size[live], depth[live]
        if not len(start):
            return order
        segment = np.repeat(np.arange(len(start)), size)
        place = np.arange(len(segment)) - np.repeat(np.cumsum(size) - size, size) + start[segment]
        word = words[order[place], depth[segment]]
        three = np.sort(np.stack([words[order[start + size * k // 4], depth] for k in (1, 2, 3)]), axis=0)
        pivot = three[1][segment]
        side = 3 * segment + (word >= pivot) + (word > pivot)
        order[place] = order[place[np.argsort(side, kind="stable")]]
        parts = np.bincount(side, minlength=3 * len(start)).reshape(-1, 3)
        start = (start[:, None] + np.cumsum(parts, axis=1) - parts).ravel()
        depth = (depth[:, None] + [0, 1, 0]).ravel()
        size = parts.ravel()


def shared_with_last(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it in the order; -1 for the first row."""
    other = words[order[1:]] ^ words[order[:-1]]
    first = np.argmax(other != 0, axis=1)
    word = other[np.arange(len(other)), first]
    equal = sum((word >> np.uint64(8 * k)) == 0 for k in range(8)) if len(other) else np.zeros(0, int)
    return np.concatenate([[-1], np.where(word == 0, 8 * words.shape[1], 8 * first + equal)])


def reaches(contexts: DataFrame, settings: Settings) -> DataFrame:
    """contexts with ``reach``: how many bytes before the anchor are those of another context of the token.

    The first and the last row of a range do not know one neighbour; their reach is all they have.
    """
    dealt = contexts.repartitionByRange(shuffle_width(contexts), "token", "before").sortWithinPartitions("token", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None  # the last row so far, and what it shares with the one before it (None: not known)
        for batch in batches:
            for rows in sliced(batch):
                if held is not None:
                    rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
                token, away = rows.column("token").to_numpy(), rows.column("away").to_numpy()
                common = shared_with_last(padded_words(rows.column("before").to_pylist(), settings.span - 1), np.arange(len(token)))
                common[1:][token[1:] != token[:-1]] = 0
                common[0] = settings.length if last is None else last
                reach = np.minimum(away[:-1], np.maximum(common[:-1], common[1:]))
                held, last = rows.slice(len(token) - 1), int(common[-1])
                if len(reach):
                    yield pa.RecordBatch.from_arrays([*rows.slice(0, len(reach)).columns, pa.array(reach.astype(np.int32))], [*rows.schema.names, "reach"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held.columns, held.column("away")], [*held.schema.names, "reach"])

    return dealt.mapInArrow(run, T.StructType([*contexts.schema.fields, T.StructField("reach", T.IntegerType())]))


def solve(contexts: list[bytes], away: np.ndarray, reach: np.ndarray, again: np.ndarray, settings: Settings, open_head: bool, open_tail: bool):
    """(low, high, edge) of a bucket: first and last repeated window of each context (first > last if
    none), and (context, window, alone) of one window of each class that reaches an open edge.

    alone: whether the class has no second window here, so that the other buckets decide. Windows
    between a context's first and last one are covered by these two and are never in question.
    """
    n, length = len(contexts), settings.length
    right = padded_words([c[a:] for c, a in zip(contexts, away.tolist())], length)
    left = padded_words([c[:a][::-1] for c, a in zip(contexts, away.tolist())], settings.span - 1)
    windows = np.array([len(c) for c in contexts]) - length + 1
    by_right = multikey_quicksort(right, np.zeros(n, np.int64))
    right_common = shared_with_last(right, by_right)
    token = np.empty(n, np.int64)
    token[by_right] = np.cumsum(right_common < settings.token)
    by_left = multikey_quicksort(left, token)
    left_common = shared_with_last(left, by_left)
    left_common[np.concatenate([[True], token[by_left][1:] != token[by_left][:-1]])] = -1
    low, high = np.where(again, 0, 1 << 30), np.where(again, windows - 1, -1)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    touching: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for o in range(int(away.max()) + 1):
        index = away - o
        use = np.flatnonzero((index >= 0) & (index < windows))
        if not len(use):
            continue
        right_class[by_right] = np.cumsum(right_common < length - o)
        left_class[by_left] = np.cumsum(left_common < o)
        key = right_class[use] * (n + 1) + left_class[use]
        order = np.argsort(key, kind="stable")
        use, key = use[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        hit = use[several]
        low[hit], high[hit] = np.minimum(low[hit], index[hit]), np.maximum(high[hit], index[hit])
        if open_head or open_tail:
            edge = np.zeros(len(use), bool)
            if open_head:
                edge |= right_class[use] == right_class[by_right[0]]
            if open_tail:
                edge |= right_class[use] == right_class[by_right[-1]]
            edge &= new & (reach[use] >= o)
            touching.append((use[edge], index[use[edge]], ~several[edge]))
    owner, window, alone = (np.concatenate(x) for x in zip(*touching)) if touching else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    alone = alone & ((window < low[owner]) | (window > high[owner]))
    return low, high, (owner, window, alone)


SOLVED = "token long, context long, low int, high int, digest binary"


def sorted_contexts(contexts: DataFrame, settings: Settings) -> DataFrame:
    """SOLVED rows from rows (token, context, away, again, data, before, reach).

    A row without digest tells the first and the last byte that repeated windows of a context cover;
    a row with a digest is a window of a class at an open edge (token is null if the answer is not needed).
    """
    right = F.substring("data", F.col("away") + 1, F.lit(settings.length))
    dealt = contexts.repartitionByRange(shuffle_width(contexts), right, "before").sortWithinPartitions(right, "before").drop("before")
    names = [x.split()[0] for x in SOLVED.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def solved(open_head: bool, open_tail: bool) -> pa.RecordBatch:
            token, context, away, reach, again, data = (list(x) for x in zip(*rows))
            low, high, (owner, window, alone) = solve(data, np.array(away), np.array(reach), np.array(again), settings, open_head, open_tail)
            keep = np.flatnonzero(high >= 0)
            out = [[token[i] for i in keep], [context[i] for i in keep], low[keep].tolist(), (high[keep] + settings.length).tolist(), [None] * len(keep)]
            for i, w, asks in zip(owner.tolist(), window.tolist(), alone.tolist()):
                digest = xxhash.xxh3_128_digest(data[i][w : w + settings.length]) + (away[i] - w).to_bytes(4, "big")
                for column, value in zip(out, (token[i] if asks else None, context[i] if asks else None, w, w + settings.length, digest)):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds)], names)

        head = True  # a range may begin, and end, inside a token
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("token", "context", "away", "reach", "again", "data"))):
                if len(rows) >= max(1, settings.bucket // 2) and row[0] != rows[-1][0]:
                    yield solved(head, False)
                    rows, head = [], False
                elif len(rows) >= settings.bucket:
                    yield solved(head, True)
                    rows, head = [], True
                rows.append(row)
        if rows:
            yield solved(head, True)

    return dealt.mapInArrow(run, SOLVED)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, own, text_hash, __text): own and text_hash tell a row's id and text; a null id's hash differs from that of id 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("__text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("own"), F.xxhash64("__text", F.col("doc_id").isNull()).alias("text_hash"), "__text")


def packed(rows: DataFrame) -> DataFrame:
    """__text as zstandard frames in __z: what the joins move is about a third."""

    def make():
        press = zstandard.ZstdCompressor(level=1)

        def work(part):
            return [[press.compress(t) for t in part.column("__text").cast(pa.binary()).to_pylist()]]

        return work

    return extended(rows, "__z binary", make)


def covers(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(own, text_hash, spans): for each document with repeats its removed ranges, start << 32 | end, unmerged."""
    rows = keyed(docs)
    found = written(anchors(rows.select("own", "text_hash", "__text"), settings))
    # written, so that the join's sides are plain shuffles, which adaptive execution can split
    counts = written(found.groupBy("token").agg(F.sum(F.size("starts")).alias("__n"), F.min("context").alias("__low"), F.max("context").alias("__high")).where("__n > 1").select("token", (F.col("__low") != F.col("__high")).alias("several")))
    hits = written(found.join(counts, "token"))
    one = written(hits.where("several").groupBy("token", "context").agg(F.min(F.struct("own", "text_hash", F.get("starts", 0).alias("start"), "away", "windows")).alias("__one"), (F.sum(F.size("starts")) > 1).alias("again")))
    lists = one.groupBy("__one.own", "__one.text_hash").agg(F.collect_list(F.struct("token", "context", F.col("__one.start").alias("start"), F.col("__one.away").alias("away"), F.col("__one.windows").alias("windows"), "again")).alias("__list"))
    # a document that repeats id and text is cut once
    left = packed(rows.select("own", "text_hash", "__text")).groupBy("own", "text_hash").agg(F.first("__z").alias("__z"))
    cut = written(cut_contexts(left.join(lists, ["own", "text_hash"]).select("__z", "__list"), settings))
    solved = written(sorted_contexts(written(reaches(cut, settings)), settings))
    edges = solved.where(F.col("digest").isNotNull())
    equal = edges.groupBy(F.col("digest").alias("__digest")).agg(F.count("*").alias("__n")).where("__n > 1").select("__digest")
    across = plainly_joined(edges.where(F.col("token").isNotNull()), equal, "digest", "__digest").select("token", "context", "low", "high")
    # written too: a context may stand in a third of all documents
    ranges = written(solved.where(F.col("digest").isNull()).select("token", "context", "low", "high").unionByName(across).groupBy("token", "context").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    ends = lambda low, high: F.transform("starts", lambda at: F.shiftleft((at + low).cast("long"), 32).bitwiseOR((at + high).cast("long")))
    copies = hits.where("several").join(ranges, ["token", "context"]).select("own", "text_hash", ends(F.col("low"), F.col("high")).alias("spans"))
    plain = hits.where("not several").select("own", "text_hash", ends(F.lit(0), F.col("windows") + F.lit(settings.length - 1)).alias("spans"))
    # a set: the copies of one id and text give the same spans
    return copies.unionByName(plain).groupBy("own", "text_hash").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def cut_contexts(rows: DataFrame, settings: Settings) -> DataFrame:
    """(token, context, away, again, data, before) from packed documents with the list of their contexts; before is reversed."""
    names = ("token", "context", "away", "again", "data", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for slice_ in sliced(batch):
                out = [[], [], [], [], [], []]
                for z, wanted in zip(slice_.column("__z").to_pylist(), slice_.column("__list").to_pylist()):
                    text = press.decompress(z)
                    for w in wanted:
                        data = text[w["start"] : w["start"] + w["windows"] + settings.length - 1]
                        for column, value in zip(out, (w["token"], w["context"], w["away"], w["again"], data, data[: w["away"]][::-1])):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], list(names))

    return rows.mapInArrow(run, "token long, context long, away int, again boolean, data binary, before binary")


def merged(spans: list[int] | None) -> list[tuple[int, int]]:
    """Maximal removed runs; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s >> 32, s & 0xFFFFFFFF) for s in spans or ()):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def kept_bytes(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in runs)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in runs), len(text)]))


def report(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    spans, left = covers(docs, settings), packed(keyed(docs))

    def make():
        press = zstandard.ZstdDecompressor()

        def work(part):
            out = [[], [], [], []]
            for z, found in zip(part.column("__z").to_pylist(), part.column("spans").to_pylist()):
                text, runs = press.decompress(z), merged(found)
                for column, value in zip(out, (len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(text, runs)).hexdigest())):
                    column.append(value)
            return out

        return work

    joined = left.join(spans, ["own", "text_hash"], "left").select("doc_id", "__z", "spans")
    return extended(joined, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", make, ("__z", "spans"))


def removed(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs with repeated strings taken out of text and n_chars (where docs has it) brought up to date."""
    spans = covers(docs, settings)
    names = docs.columns
    rows = docs.select(*[F.col(f"`{n}`").alias(f"__own_{n}") for n in names if n != "text"], F.col("doc_id").cast("long").alias("doc_id"), F.col("text").isNull().alias("__null"), text_of("text").alias("__text"))
    left = packed(rows.select("*", F.coalesce("doc_id", F.lit(0)).alias("own"), F.xxhash64("__text", F.col("doc_id").isNull()).alias("text_hash")))

    def make():
        press = zstandard.ZstdDecompressor()

        def work(part):
            texts = []
            for z, found, null in zip(part.column("__z").to_pylist(), part.column("spans").to_pylist(), part.column("__null").to_pylist()):
                runs = merged(found)
                data = press.decompress(z)
                texts.append(None if null else (kept_bytes(data, runs) if runs else data).decode("utf-8", "ignore"))
            return [texts]

        return work

    joined = left.join(spans, ["own", "text_hash"], "left").drop("own", "text_hash", "doc_id")
    out = extended(joined, "text string", make, ("__z", "spans", "__null"))
    back = [F.char_length("text").cast(docs.schema[n].dataType).alias(n) if n == "n_chars" else F.col(n) if n == "text" else F.col(f"`__own_{n}`").alias(n) for n in names]
    return out.select(*back)


def oracle(length: int = 200, documents: str = "documents") -> str:
    """report() in DuckDB SQL: every window of every text, grouped."""
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM {documents}),
    w AS (SELECT r, i, md5(b[i + 1:i + {length}]) AS k FROM (SELECT r, b, unnest(range(n - {length - 1})) AS i FROM d WHERE n >= {length})),
    h AS (SELECT r, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
    e AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {length} THEN 0 ELSE 1 END AS fresh FROM h),
    s AS (SELECT r, min(i) AS a, max(i) + {length} AS z FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM e) GROUP BY r, g),
    k AS (SELECT r, a, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS from_, a AS to_ FROM s UNION ALL SELECT r, n, coalesce((SELECT max(z) FROM s WHERE s.r = d.r), 0), n FROM d),
    t AS (SELECT k.r, string_agg(hex(d.b[from_ + 1:to_]), '' ORDER BY k.a, from_) AS kept FROM k JOIN d USING (r) GROUP BY k.r)
    SELECT doc_id, n AS n_bytes, coalesce((SELECT sum(z - a) FROM s WHERE s.r = d.r), 0)::BIGINT AS n_removed, (SELECT count(*) FROM s WHERE s.r = d.r)::BIGINT AS n_spans,
        sha256(unhex(t.kept)) AS kept_sha256 FROM d JOIN t USING (r)"""
