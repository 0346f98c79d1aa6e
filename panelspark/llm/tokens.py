"""Token counts by compiled transducers.

A byte-level BPE tokenizer is two deterministic machines in a row. The first reads
character classes (with a bounded look ahead, folded into the class) and emits a mark
where a word starts. Texts are put one after another and cut into chunks; a chunk's state
map tells, for every state it may be entered in, the state it is left in. All chunks' maps
are computed side by side, composed by a parallel prefix scan, and then every chunk runs
from the state that it is really entered in. The second machine reads a word byte by byte;
its state is the last token of each prefix, and a transition carries the count of tokens
emitted so far. A prefix ends in the longest token that merges leave standing beside the
token before it. Words end all of its states, so its chunk maps are constants: a chunk's
count is the sum over its words, and each distinct word (told apart byte by byte) is run
once a batch at most."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frees, offsets, pieces, small_batches

LIMIT = 1024
TOKENIZER = "byte_bpe_50k.json"
CHUNK = 64
#: Characters by class; QUOTE1 and QUOTE2: an apostrophe before an ending of one or two
#: letters; SPACE, BLANK: 0x20 and other white space before something solid; GAP: white
#: space before white space or an end; END: between texts.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE, BLANK, GAP, END = range(9)
#: White space of the Unicode property list: fixed values.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that stay with their apostrophe: fixed values.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: States of the word machine: at an edge, in a run of a class, after a space that goes
#: with the next word, and one or two letters before the end of an ending.
EDGE, IN_LETTER, IN_NUMBER, IN_OTHER, IN_GAP, JOINED, ONE_MORE, TWO_MORE = range(8)
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def word_machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a word starts) for each class and state."""
    to, mark = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    to[:] = np.array([IN_LETTER, IN_NUMBER, IN_OTHER, ONE_MORE, TWO_MORE, JOINED, EDGE, IN_GAP, EDGE], np.uint8)[:, None]
    for kind, state in ((LETTER, IN_LETTER), (NUMBER, IN_NUMBER), (OTHER, IN_OTHER), (QUOTE1, IN_OTHER), (QUOTE2, IN_OTHER)):
        for held in (state, JOINED):  # a run goes on; a joined space takes any solid class
            to[kind, held], mark[kind, held] = state, False
    mark[GAP, IN_GAP] = False
    to[:END, ONE_MORE], mark[:END, ONE_MORE] = EDGE, False
    to[:END, TWO_MORE], mark[:END, TWO_MORE] = ONE_MORE, False
    return to, mark


NEXT, STARTS = word_machine()


def word_starts(kind: np.ndarray) -> np.ndarray:
    """Where words start, from the classes of a whole run of texts."""
    n = len(kind)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, END, np.uint8)
    grid[:n] = kind
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)  # a column a chunk
    flat = NEXT.ravel()
    maps = np.repeat(np.arange(8, dtype=np.uint8)[None], rows, 0)
    for column in grid:
        maps = flat[(column.astype(np.intp) * 8)[:, None] + maps]
    # prefix scan: maps[i] becomes the map of chunks 0 to i
    step = 1
    while step < rows:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        step *= 2
    state = np.append(np.uint8(EDGE), maps[:-1, EDGE]).astype(np.intp)
    out = np.empty((CHUNK, rows), bool)
    marks = STARTS.ravel()
    for i, column in enumerate(grid):
        at = column.astype(np.intp) * 8 + state
        out[i], state = marks[at], flat[at].astype(np.intp)
    return np.flatnonzero(out.T.ravel()[:n])


class Transducer:
    """Compiled from a tokenizer file; transitions are kept as they are first met."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
        own = {t: bytes(byte[c] for c in t) for t in spec["model"]["vocab"]}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(own[a], own[b]): i for i, (a, b) in enumerate(pairs)}
        self.tokens = {a + b for a, b in self.rank} | {bytes([b]) for b in range(256)}
        lengths: dict[bytes, set[int]] = {}
        for t in self.tokens:
            lengths.setdefault(t[-2:], set()).add(len(t))
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}  # of tokens that end so
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        self.begun: dict[bytes, tuple[tuple, tuple]] = {}
        self.counts: dict[bytes, int] = {}
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer") or spec["model"].get("type") != "BPE" or spec["model"].get("ignore_merges"):
            raise ValueError(f"{path}: only byte-level BPE files without prefix space or normalizer are compiled")
        kind = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            group = unicodedata.category(chr(c))[0]
            if group in "LN":
                kind[c] = LETTER if group == "L" else NUMBER
        kind[SPACES] = GAP
        self.kind = kind

    def stands(self, a: bytes, b: bytes) -> bool:
        """Whether merging a's and b's bytes ends in a, b again."""
        if (known := self.beside.get((a, b))) is None:
            parts = [bytes([x]) for x in a + b]
            while len(parts) > 1:
                ranks = [self.rank.get(p, 1 << 30) for p in zip(parts, parts[1:])]
                if (low := min(ranks)) == 1 << 30:
                    break
                i = ranks.index(low)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = self.beside[a, b] = parts == [a, b]
        return known

    def emitted(self, word: bytes) -> int:
        """Tokens of one word: a run over its bytes."""
        tokens, lengths, beside = self.tokens, self.lengths, self.beside
        begun = self.begun.get(word[:8])  # words that begin alike share these states
        last, count = ([*begun[0]], [*begun[1]]) if begun else ([word[:1]], [1])
        for end in range(len(last) + 1, len(word) + 1):
            if end == 9 and not begun:
                self.begun[word[:8]] = tuple(last), tuple(count)
            for n in (*lengths.get(word[end - 2 : end], ()), 1):
                start = end - n
                if start < 0 or (token := word[start:end]) not in tokens:
                    continue
                if not start:
                    last.append(token)
                    count.append(1)
                    break
                pair = (last[start - 1], token)
                if (ok := beside.get(pair)) is None:
                    ok = self.stands(*pair)
                if ok:
                    last.append(token)
                    count.append(count[start - 1] + 1)
                    break
        return count[-1]

    def classes(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The class of each character, look ahead included."""
        kind = self.kind[codes]
        kind[ends] = END
        after = np.append(kind[1:], np.uint8(END))
        solid = (kind == GAP) & (after < GAP)
        for i in np.flatnonzero(codes == 0x27).tolist():
            if kind[i] != END and (found := next((e for e in ENDINGS if (codes[i + 1 : i + 1 + len(e)] == [ord(x) for x in e]).all() and len(codes) > i + len(e) and (kind[i + 1 : i + 1 + len(e)] != END).all()), None)):
                kind[i] = QUOTE1 if len(found) == 1 else QUOTE2
        kind[solid] = np.where(codes[solid] == 0x20, SPACE, BLANK)
        return kind

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; a special string is one token, and an end on either side."""
        extra = np.zeros(len(texts), np.int64)
        parts: list[str] = []  # of all texts, at special strings
        own: list[int] = []
        for i, t in enumerate(texts):
            cut = [t]
            for mark in self.special:
                cut = [x for c in cut for x in c.split(mark)]
            extra[i] = len(cut) - 1
            parts += cut
            own += [i] * len(cut)
        joined = "\x00".join(parts) + "\x00"
        raw = joined.encode()
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        kind = self.classes(codes, ends)
        start = word_starts(kind)
        at = np.append(0, np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), dtype=np.int64))
        # words and ends lie side by side: an array over the bytes as they are
        array = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(at[start], len(raw))), pa.py_buffer(raw)])
        coded = array.dictionary_encode()
        for kept, most in ((self.counts, 400_000), (self.beside, 400_000), (self.begun, 100_000)):
            if len(kept) > most:  # bounded memory
                kept.clear()
        got = np.empty(len(coded.dictionary), np.int64)
        for i, word in enumerate(coded.dictionary.to_pylist()):
            if (c := self.counts.get(word)) is None:
                c = self.emitted(word)
                if len(word) <= 64:
                    self.counts[word] = c
            got[i] = c
        each = got[coded.indices.to_numpy()]
        each[kind[start] == END] = 0
        text = np.asarray(own)[np.searchsorted(ends, start)]
        return np.bincount(text, each, len(texts)).astype(np.int64) + extra


_compiled: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit. Null text
    counts as empty, with no tokens; texts of any length are read whole; equal rows give
    equal rows; other columns are left out; an empty table gives an empty table."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for batch in batches:
            at = offsets(batch.column(1))
            for a, b in pieces(at, 1 << 19):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                n = machine.count(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at[a : b + 1])), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(frees(run), SCHEMA)
