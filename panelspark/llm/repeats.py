"""Removal of byte strings that repeat across documents.

Sorting every suffix needs several times the input on disk, so only sampled suffixes are
compared, and what is known of them is carried to the windows around; there is no suffix
order and no common-prefix array. A suffix is sampled where a 20-byte string is the
least, by a hash, of those in some 50-byte window; equal windows are sampled at equal
places, so all windows that a sample stands for (a run of at most 31, one string of 50
to 80 bytes) are placed by it. Tuples (sample, string, document, place) are dealt out
and grouped through Spark's disk-backed shuffle; strings of one sample are told apart by
64 bits, windows by 128. Tuples whose strings are equal share all their windows (their
common prefix is the whole string); where strings of a sample differ, a second level
does the same with their single windows. Before each shuffle a task keeps, of tuples
with equal strings, those of its smallest document, as the others are known to repeat;
so a passage that a third of all documents share costs a tuple for each task, not for
each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE2, BYTE2, Rolling, buckets, freed, frees, offsets, partitions, pieces, release, small_batches, table, utf8

WIDTH, SAMPLE = 50, 20
PIECE, FLUSH = 1 << 17, 1 << 18
NULL_ID = (1 << 63) - 1
#: Of a text that order rows of one id; bytes of text a bucket.
HEAD, EACH = 64, 12 << 20
U8, U16, U32, U64, I64 = (np.dtype(t) for t in ("u1", "u2", "u4", "u8", "i8"))


def pack(columns: list[np.ndarray]) -> bytes:
    """Byte by byte, high bytes together: equal ones compress away."""
    return b"".join(np.ascontiguousarray(c).view(U8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns)


def unpack(blobs: list[bytes], kinds: tuple) -> list[np.ndarray]:
    width = sum(k.itemsize for k in kinds)
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        n, at = len(blob) // width, 0
        raw = np.frombuffer(blob, U8)
        for part, k in zip(parts, kinds):
            part.append(np.ascontiguousarray(raw[at : at + n * k.itemsize].reshape(k.itemsize, n).T).view(k).ravel())
            at += n * k.itemsize
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds)]


def dealt(to: np.ndarray, columns: list[np.ndarray], kind: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, blob) for each bucket that has rows."""
    order = np.argsort(to, kind="stable")
    to, columns = to[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else []
    for a, b in zip(cuts, [*cuts[1:], len(to)]):
        yield int(to[a]), kind, pack([c[a:b] for c in columns])


def bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(33)) * np.uint64(n) >> np.uint64(31)).astype(np.int64)


def layouts(docs: DataFrame) -> tuple[tuple, tuple, tuple]:
    """Columns of places (document, its number among equal ids, place, windows), tuples
    and windows, each after two hashes (128 bits); numbers take 16 bits unless an id has
    more rows."""
    number = U16 if docs.where("dup > 65535").isEmpty() else U32
    places = (I64, number, U32, U8)
    return places, (U64, U64, *places), (U64, U64, I64, number, U32)


def home(doc: np.ndarray, dup: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a row; rows that share an id are spread."""
    return (doc % n + dup.astype(np.int64)) % n if dup.any() else doc % n


def later(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the same two hashes."""
    if not len(a):
        return np.zeros(0, bool)
    order = np.lexsort((doc, b, a))
    a, b, d = a[order], b[order], doc[order]
    first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    out = np.empty(len(a), bool)
    out[order] = d > d[first][np.cumsum(first) - 1]
    return out


def samples(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(sample hash, string hash, first window, windows) of each run of windows that one
    sample stands for; ``ends``: for each byte, where its document ends."""
    n, span = len(data), WIDTH - SAMPLE + 1
    if n < WIDTH:
        return tuple(np.zeros(0, k) for k in (U64, U64, np.int64, np.int64))
    rolling = Rolling(data)
    at = np.arange(n - SAMPLE + 1)
    hashes = rolling(at, at + SAMPLE)
    low = np.uint64(PIECE * 2 - 1)
    least = hashes & ~low | at.astype(U64)  # by hash, then by place
    done = 1
    while done * 2 <= span:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    least = np.minimum(least[: len(least) - (span - done)], least[span - done :])
    at = np.flatnonzero(ends[: len(least)] - np.arange(len(least)) >= WIDTH)
    if not len(at):
        return tuple(np.zeros(0, k) for k in (U64, U64, np.int64, np.int64))
    own = (least[at] & low).astype(np.int64)
    first = np.append(True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1))
    start = at[first]
    count = np.diff(np.append(np.flatnonzero(first), len(at)))
    return hashes[own[first]], rolling(start, start + count - 1 + WIDTH), start, count


def parts(at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row, first byte, last byte); long rows in overlapping parts."""
    for a, b in pieces(at, PIECE):
        lo, hi = int(at[a]), int(at[b])
        while hi - lo > PIECE:
            yield a, b, lo, lo + PIECE
            lo += PIECE - WIDTH + 1
        yield a, b, lo, hi


def repeats(docs: DataFrame, layout: tuple[tuple, tuple, tuple], n_docs: int) -> DataFrame:
    """(doc bucket, kind, blob) with the repeated windows of every row of ``docs`` (key,
    dup, text): documents, places and numbers of windows."""
    places_of, tuples_of, windows_of = layout
    spark = docs.sparkSession
    n_tuples = 5 * n_docs
    flat = "bucket int, kind int, blob binary"
    names = ["bucket", "kind", "blob"]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        b, k, x = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], names)

    def flushed(held: list[tuple], n: int) -> pa.RecordBatch:
        """Kind 0: tuples by hash; kind 1: known repeats."""
        columns = [np.concatenate(c) for c in zip(*held)]
        known = later(*columns[:3])
        places = columns[2:] if len(columns) == 6 else [*columns[2:], np.ones(len(columns[0]), U8)]
        rows = list(dealt(bucket(columns[0][~known], n), [c[~known] for c in columns], 0))
        rows += dealt(home(places[0][known], places[1][known], n), [c[known] for c in places], 1)
        held.clear()
        return out(rows)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            keys, dups = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = offsets(batch.column(2))
            for a, b, lo, hi in parts(at):
                data = utf8(batch.column(2).slice(a, b - a))[0][lo - at[a] : hi - at[a]]
                sizes = np.minimum(at[a + 1 : b + 1], hi) - np.maximum(at[a:b], lo)
                row = np.repeat(np.arange(a, b), sizes)
                sample, string, start, count = samples(data, np.minimum(at[row + 1], hi) - lo)
                row = row[start]
                held.append((sample, string, keys[row], dups[row].astype(places_of[1]), (start + lo - at[row]).astype(U32), count.astype(U8)))
                n += len(start)
                if n >= FLUSH:
                    yield flushed(held, n_tuples)
                    n = 0
        if held:
            yield flushed(held, n_tuples)

    def level(group: pd.DataFrame) -> pd.DataFrame:
        """Kind 1: repeats; kind 2: strings whose windows are to be compared singly."""
        blobs = group["blob"]
        places = unpack(blobs[group["kind"] == 1].tolist(), places_of)
        sample, string, *rest = unpack(blobs[group["kind"] == 0].tolist(), tuples_of)
        order = np.lexsort((rest[0], string, sample))
        sample, string, rest = sample[order], string[order], [c[order] for c in rest]
        rows: list[tuple] = []
        if len(sample):
            doc = rest[0]
            new = np.append(True, sample[1:] != sample[:-1])
            new_string = new | np.append(True, string[1:] != string[:-1])
            known = doc > doc[new_string][np.cumsum(new_string) - 1]
            of = np.cumsum(new) - 1
            edges = np.flatnonzero(new)
            several = (np.add.reduceat(new_string.astype(int), edges) > 1) & (np.minimum.reduceat(doc, edges) < np.maximum.reduceat(doc, edges))
            ask = ~known & several[of]
            rows += dealt(home(doc[ask], rest[1][ask], n_docs), [c[ask] for c in rest], 2)
            places = [np.concatenate([p, c[known]]) for p, c in zip(places, rest)]
        rows += dealt(home(places[0], places[1], n_docs), places, 1)
        return pd.DataFrame(rows, columns=names)

    def singles(_, texts: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        doc, dup, place, count = unpack(asked["blob"].tolist(), places_of)
        rows: list[tuple] = []
        if len(doc):
            held: list[tuple] = []
            n = 0
            order = np.lexsort((dup, doc))
            doc, dup, place, count = doc[order], dup[order], place[order], count[order]
            cuts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (dup[1:] != dup[:-1])))
            have = {(k, d): x for k, d, x in zip(texts["key"].tolist(), texts["dup"].tolist(), texts["bytes"].tolist())}
            for a, b in zip(cuts, [*cuts[1:], len(doc)]):
                data = np.frombuffer(have[int(doc[a]), int(dup[a])], U8)
                hashes = Rolling(data), Rolling(data, BYTE2, BASE2)
                many = count[a:b].astype(np.int64)
                start = np.repeat(place[a:b].astype(np.int64) - (np.cumsum(many) - many), many) + np.arange(many.sum())
                held.append((*(h(start, start + WIDTH) for h in hashes), np.full(len(start), doc[a]), np.full(len(start), dup[a]), start.astype(U32)))
                n += len(start)
                if n >= FLUSH:
                    rows += flushed(held, n_tuples).to_pandas().itertuples(index=False, name=None)
                    n = 0
            if held:
                rows += flushed(held, n_tuples).to_pandas().itertuples(index=False, name=None)
        freed()
        return pd.DataFrame(rows, columns=names)

    def second(group: pd.DataFrame) -> pd.DataFrame:
        blobs = group["blob"]
        places = unpack(blobs[group["kind"] == 1].tolist(), places_of)
        one, two, *rest = unpack(blobs[group["kind"] == 0].tolist(), windows_of)
        known = later(one, two, rest[0])
        rest = [*rest, np.ones(len(one), U8)]
        places = [np.concatenate([p, c[known]]) for p, c in zip(places, rest)]
        freed()
        return pd.DataFrame(list(dealt(home(places[0], places[1], n_docs), places, 1)), columns=names)

    one = table(docs.mapInArrow(frees(first), flat).groupBy("bucket").applyInPandas(level, flat))
    release(spark)
    texts = docs.select("key", "dup", F.encode("text", "UTF-8").alias("bytes"), F.expr(f"int(pmod(pmod(key, {n_docs}) + dup, {n_docs}))").alias("bucket")).groupBy("bucket")
    asked = one.where("kind = 2").groupBy("bucket").cogroup(texts)
    wide = asked.applyInPandas(lambda key, a, t: singles(key, t, a), flat)
    two = table(wide.groupBy("bucket").applyInPandas(second, flat))
    release(spark)
    return one.where("kind = 1").unionByName(two)


def doc_buckets(docs: DataFrame) -> int:
    """A prime, so that ids in steps spread."""
    n = buckets(docs, EACH) | 1
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def keyed(docs: DataFrame) -> DataFrame:
    """(key, dup, text, null): dup numbers rows that share a doc_id, by their text; null
    ids have the key of the greatest, and the flag."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").isNull().alias("null"))
    if docs.groupBy("key").count().where("count > 1").isEmpty():
        return docs.select("key", F.lit(0).alias("dup"), "text", "null")
    # ranges of ids and texts' heads; a row's number is its range's start and its place there
    docs = docs.repartitionByRange(partitions(docs.sparkSession), "key", F.substring("text", 1, HEAD))
    docs = table(docs.withColumn("part", F.spark_partition_id()))
    sizes = docs.groupBy("key", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n")
    starts = table(sizes.select("key", "part", before.alias("start")))
    inside = F.row_number().over(Window.partitionBy("key", "part").orderBy("text", "null")) - 1
    rows = docs.withColumn("inside", inside).join(starts, ["key", "part"])
    return rows.select("key", (F.col("start") + F.col("inside")).cast("int").alias("dup"), "text", "null")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (binary: what is
    left, as UTF-8 bytes; a character may be cut). A byte goes if a 50-byte string that
    covers it also starts in a document with a smaller doc_id. Null text counts as
    empty; a null doc_id is greater than all others; rows that share a doc_id are
    documents of their own, none before the other; other columns are left out; an empty
    table gives an empty table."""
    small_batches(docs.sparkSession)
    rows = keyed(docs)
    n_docs = doc_buckets(rows)
    layout = layouts(rows)
    found = repeats(rows, layout, n_docs)
    texts = rows.select("key", "dup", "null", F.encode("text", "UTF-8").alias("bytes"), F.expr(f"int(pmod(pmod(key, {n_docs}) + dup, {n_docs}))").alias("bucket"))

    def cut(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        doc, dup, place, count = unpack(found["blob"].tolist(), layout[0])
        order = np.lexsort((dup, doc))
        doc, dup, place, count = doc[order], dup[order], place[order].astype(np.int64), count[order].astype(np.int64)
        out = []
        for k, d, null, raw in zip(texts["key"].tolist(), texts["dup"].tolist(), texts["null"].tolist(), texts["bytes"].tolist()):
            a, b = np.searchsorted(doc, k), np.searchsorted(doc, k, "right")
            if b > a and (dup[a] != d or dup[b - 1] != d):
                a, b = a + np.searchsorted(dup[a:b], d), a + np.searchsorted(dup[a:b], d, "right")
            n, spans, kept = len(raw), 0, raw
            if b > a:
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, place[a:b], 1)
                np.add.at(edge, place[a:b] + count[a:b] - 1 + WIDTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                kept = np.frombuffer(raw, U8)[~gone].tobytes()
            out.append((None if null else k, n, n - len(kept), spans, kept))
        ids, *rest = zip(*out) if out else ((), (), (), (), ())
        freed()
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_bytes": rest[0], "n_removed": rest[1], "n_spans": rest[2], "kept": rest[3]})

    shape = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    return texts.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInPandas(lambda t, f: cut(t, f), shape)


def digests(docs: DataFrame) -> DataFrame:
    """``without_repeats`` with the SHA-256 of what is kept in place of it."""
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
