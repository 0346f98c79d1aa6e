"""Alignment of two tokenizers' tokens by inverted pair bitmaps.

Texts are dealt into chunks of some megabytes. In a chunk, texts fall apart at spaces that
neither tokenizer merges across; each distinct unit is tokenized once by both, and the
byte offsets where tokens end give groups and links. A pair of ids then has compressed
bitmaps over the chunk's documents: plane 0 holds those in which the pair is linked, plane
k those whose further links have bit k - 1 set. A bitmap is the list of its set slots, or
the bits themselves where these take less room. Arrow batches of a chunk are merged by OR;
chunks hold different documents, so the bitmap of the whole corpus is their union, its
count the sum of theirs, and the count of links that of its planes, each by its weight.
Counts go back to the chunks that hold the pair (rows of ids, not bitmaps), and the chunk's
postings hand them to the documents. A pair in every document is a row a chunk."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frees, small_batches, table

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text, and documents, of a chunk at most, but one document at least.
CHUNK, MOST = 8 << 20, 1 << 16
#: A space that both tokenizers cut before: it stands between two solid characters.
CUT = re.compile(r"(?<=\S)(?= \S)")
#: The mark that a piece has for a space (a fixed value).
MARK = "▁"
RUN = 1 << 16
SCHEMA = "chunk bigint, slot int, docs int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, a int, b int, plane int, n int, bits binary"


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(sorted({*range(256)} - {*shown}))}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for t, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError(f"{path_b}: pieces that go across a space can't be aligned unit by unit")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(t) for t in own], np.int64) for own in (self.bytes_a, self.bytes_b))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text, which starts with a space that B adds itself."""
        return [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)

    def units(self, units: list[str]) -> Units:
        """Plain units are put one after another, since both tokenizers cut between them."""
        plain = np.array([len(u) > 1 and not u[1].isspace() and not u[-1].isspace() and MARK not in u for u in units], bool)
        runs: list[str] = []
        held: list[str] = []
        size = 0
        for u in (units[i] for i in np.flatnonzero(plain)):
            held.append(u)
            size += len(u)
            if size >= RUN:
                runs.append("".join(held))
                held, size = [], 0
        if held:
            runs.append("".join(held))
        order = np.append(np.flatnonzero(plain), np.flatnonzero(~plain))
        a, b = self.encode(runs + [units[i] for i in np.flatnonzero(~plain)])
        a, b = (np.fromiter((x for row in own for x in row), np.int64) for own in (a, b))
        texts = [units[i].encode() for i in order]
        joined_a, joined_b = b"".join(map(self.bytes_a.__getitem__, a.tolist())), b"".join(map(self.bytes_b.__getitem__, b.tolist()))
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        if not joined_a == joined_b == b"".join(texts):  # some unit doesn't come back: one by one
            return self.apart(units)
        return Units(order, ends, a, b, np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))

    def apart(self, units: list[str]) -> Units:
        """As ``units``, each on its own; units that don't come back have no tokens."""
        a, b = self.encode(units)
        texts = [u.encode() for u in units]
        whole = [b"".join(self.bytes_a[x] for x in p) == t == b"".join(self.bytes_b[x] for x in q) for p, q, t in zip(a, b, texts)]
        a, b = (np.fromiter((x for row, w in zip(own, whole) if w for x in row), np.int64) for own in (a, b))
        ends = np.cumsum(np.array([len(t) if w else 0 for t, w in zip(texts, whole)], np.int64))
        out = Units(np.arange(len(units)), ends, a, b, np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        out.broken[[i for i, w in enumerate(whole) if not w]] = True
        return out


class Units:
    """The tokens, groups and links of distinct units; ``order`` is the units' order in
    the streams, ``ends`` where each ends there, in bytes."""

    def __init__(self, order: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray):
        n = len(order)
        self.broken = np.zeros(n, bool)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        every = np.union1d(ends_a, ends_b)
        self.link_a, self.link_b = a[np.searchsorted(ends_a, every)], b[np.searchsorted(ends_b, every)]

        def starts(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """First and number of what ends in each unit."""
            last = np.searchsorted(of, ends, "right")
            first = np.append(0, last[:-1]) if n else last
            return first[place], (last - first)[place]

        self.first_link, self.n_links = starts(every)
        (_, self.n_a), (_, self.n_b), (_, self.n_groups) = starts(ends_a), starts(ends_b), starts(both)
        # groups as text: A's and B's tokens in one row, each with what follows it
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        rank = np.lexsort((np.append(np.zeros(len(a), np.int8), np.ones(len(b), np.int8)), np.append(group_a, group_b)))
        ids = np.append(a, b)[rank]
        last_a, last_b = np.isin(ends_a, both, assume_unique=True), np.isin(ends_b, both, assume_unique=True)
        after = np.append(np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(",")))[rank].astype(np.uint8)
        width = 6
        digits = np.empty((len(ids), width + 1), np.uint8)
        rest = ids.copy()
        for i in range(width - 1, -1, -1):
            digits[:, i] = rest % 10 + 48
            rest //= 10
        digits[:, width] = after
        shown = np.ones((len(ids), width + 1), bool)
        for i in range(width - 1):
            shown[:, i] = ids >= 10 ** (width - 1 - i)
        text = digits[shown].tobytes()
        at = np.append(0, np.cumsum(shown.sum(1)))
        tokens = np.cumsum(np.append(0, (self.n_a + self.n_b)[order]))
        cut = at[tokens]
        self.text: list[bytes] = [b""] * n
        for i, u in enumerate(order.tolist()):
            self.text[u] = text[cut[i] : cut[i + 1] - 1]  # without the last ;


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1 ... for each i, count[i] of them, one after another."""
    total = int(count.sum())
    out = np.ones(total, np.int64)
    some = count > 0
    f, c = first[some], count[some]
    if total:
        out[0] = f[0]
        out[np.cumsum(c)[:-1]] = f[1:] - (f[:-1] + c[:-1] - 1)
    return np.cumsum(out)


def planes(pair: np.ndarray, slot: np.ndarray, times: np.ndarray, docs: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """Per plane: its number, the pairs with a bitmap in it, their counts of documents, the
    bitmaps. ``pair`` and ``slot`` ascend together."""
    more = times - 1
    for plane in range(1 + int(more.max(initial=0)).bit_length()):
        held = np.ones(len(pair), bool) if plane == 0 else (more >> (plane - 1)) & 1 > 0
        p, s = pair[held], slot[held].astype(np.uint16)
        first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))[: len(p)]
        n = np.diff(np.append(first, len(p)))
        dense = 2 * n > (docs + 7) // 8
        if dense.any():
            bits = [np.packbits(np.bincount(s[f : f + k], minlength=docs).astype(bool)).tobytes() if d else s[f : f + k].tobytes() for f, k, d in zip(first.tolist(), n.tolist(), dense.tolist())]
            yield plane, p[first], n, pa.array(bits, pa.binary())
        elif len(p):
            at = np.append(first, len(p)).astype(np.int32) * 2
            yield plane, p[first], n, pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(s)])


def weight(plane: int) -> int:
    return 1 if plane == 0 else 1 << (plane - 1)


def chunk_rows(pair: Pair, chunk: int, ids: list, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
    """The rows of one chunk: its documents, and the postings of its pairs."""
    code: dict[str, int] = {}
    own = [[code.setdefault(u, len(code)) for u in CUT.split(" " + t)] if t else [] for t in texts]
    units = pair.units(list(code))
    docs = len(texts)
    if units.broken.any():
        own = [[] if units.broken[row].any() else row for row in own]
    size = np.fromiter(map(len, own), np.int64, docs)
    flat = np.fromiter((u for row in own for u in row), np.int64, int(size.sum()))
    doc = np.repeat(np.arange(docs), size)
    sums = [np.bincount(doc, of[flat], docs).astype(np.int64) if len(flat) else np.zeros(docs, np.int64) for of in (units.n_a, units.n_b, units.n_groups, units.n_links)]
    sha = [hashlib.sha256(b";".join([units.text[u] for u in row])).hexdigest() if row else "" for row in own]
    names = SCHEMA.replace(" bigint", "").replace(" int", "").replace(" string", "").replace(" binary", "").split(", ")
    types = dict(zip(names, [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.string(), *[pa.int32()] * 4, pa.binary()]))

    def batch(rows: int, /, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[k] if isinstance(columns.get(k), pa.Array) else pa.array(columns[k], t) if k in columns else pa.nulls(rows, t) for k, t in types.items()], names)

    yield batch(docs, chunk=np.full(docs, chunk), slot=np.arange(docs), docs=np.full(docs, docs), doc_id=pa.array(ids, pa.int64()), n_a=sums[0], n_b=sums[1], n_groups=sums[2], n_links=sums[3], groups_sha256=sha)
    # links as (pair, document), ascending, with how often
    keys, local = np.unique(units.link_a << 32 | units.link_b, return_inverse=True)
    link = local[ragged(units.first_link[flat], units.n_links[flat])] * docs + np.repeat(doc, units.n_links[flat])
    link.sort()
    first = np.flatnonzero(np.append(True, link[1:] != link[:-1])) if len(link) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(link)))
    link = link[first]
    for plane, of, n, bits in planes(link // docs, link % docs, times, docs) if len(link) else ():
        k = len(of)
        yield batch(k, chunk=np.full(k, chunk), docs=np.full(k, docs), a=keys[of] >> 32, b=keys[of] & 0xFFFFFFFF, plane=np.full(k, plane), n=n, bits=bits)


_pairs: dict[tuple[str, str], Pair] = {}


def chunks(docs: DataFrame, path_a: str, path_b: str, most_bytes: int = CHUNK) -> DataFrame:
    """Rows of SCHEMA: a document's have ``doc_id`` to ``groups_sha256``, a posting's the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _pairs:
            _pairs[path_a, path_b] = Pair(path_a, path_b)
        pair = _pairs[path_a, path_b]
        chunk, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(t or "")
                if ids and (size + n > most_bytes or len(ids) == MOST):
                    yield from chunk_rows(pair, chunk, ids, texts)
                    chunk, ids, texts, size = chunk + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += n
        if ids:
            yield from chunk_rows(pair, chunk, ids, texts)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(frees(run), SCHEMA)


def pair_counts(postings: DataFrame) -> DataFrame:
    """(a, b, docs, count, best): documents that link the pair, links, and whether no pair
    of its b has more."""
    links = F.sum(F.when(F.col("plane") == 0, F.col("n").cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("plane") - 1) * F.col("n")))
    counts = table(postings.groupBy("a", "b").agg(F.sum(F.when(F.col("plane") == 0, F.col("n"))).alias("docs"), links.alias("count")))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "docs", "count", (F.col("count") == F.col("most")).alias("best"))


def scored(key: tuple, postings: pa.Table, counts: pa.Table) -> pa.Table:
    """Of one chunk: what its documents' links count."""
    code = lambda t: t.column("a").to_numpy().astype(np.int64) << 32 | t.column("b").to_numpy()
    known = code(counts)
    order = np.argsort(known)
    at = order[np.searchsorted(known[order], code(postings))]
    best, count = counts.column("best").to_numpy(zero_copy_only=False)[at].astype(np.int64), counts.column("count").to_numpy()[at]
    docs = int(postings.column("docs")[0].as_py())
    plane, n = postings.column("plane").to_numpy(), postings.column("n").to_numpy().astype(np.int64)
    times = np.array([weight(p) for p in range(64)], np.int64)[plane]
    n_best, total = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    bits = postings.column("bits").to_pylist()
    size = np.fromiter(map(len, bits), np.int64, len(bits))
    sparse = size == 2 * n
    for i in np.flatnonzero(~sparse).tolist():
        own = np.unpackbits(np.frombuffer(bits[i], np.uint8), count=docs).astype(np.int64) * times[i]
        n_best += own * best[i]
        total += own * count[i]
    slots = np.frombuffer(b"".join(bits[i] for i in np.flatnonzero(sparse).tolist()), np.uint16)
    np.add.at(n_best, slots, np.repeat((times * best)[sparse], n[sparse]))
    np.add.at(total, slots, np.repeat((times * count)[sparse], n[sparse]))
    return pa.table({"chunk": pa.array(np.full(docs, key[0].as_py()), pa.int64()), "slot": pa.array(np.arange(docs), pa.int32()), "n_best": n_best, "count_sum": total})


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, most_bytes: int = CHUNK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256. Null and empty texts, and texts that don't come back from either
    tokenizer byte by byte (such as one with the mark of a space in it), have no tokens:
    zeros and ''; texts of any length are read whole; equal texts have equal rows, and a
    repeated or null doc_id is a row like any other; pairs of equal count are all best;
    other columns are left out; an empty table gives an empty table."""
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path(TOKENIZER_A), path_b or public_tokenizers.path(TOKENIZER_B)
    rows = table(chunks(docs, path_a, path_b, most_bytes))
    postings = rows.where("a IS NOT NULL").select("chunk", "docs", "a", "b", "plane", "n", "bits")
    counts = table(pair_counts(postings))
    asked = postings.where("plane = 0").select("chunk", "a", "b").join(counts.select("a", "b", "count", "best"), ["a", "b"])
    asked = asked.toDF("x", "y", "z", "count", "best").select(F.col("z").alias("chunk"), F.col("x").alias("a"), F.col("y").alias("b"), "count", "best")
    found = postings.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(scored, "chunk bigint, slot int, n_best bigint, count_sum bigint")
    own = rows.where("a IS NULL").select("chunk", "slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    out = own.join(found, ["chunk", "slot"], "left").na.fill(0, ["n_best", "count_sum"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
