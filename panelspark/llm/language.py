"""Language identification by mixture inference.

Each language has a distribution over hashed letter trigrams. A document is a mixture:
expectation-maximisation estimates each language's share, and languages are dropped
from the mixture while that raises the likelihood less half a log-count a parameter. A
uniform component takes up what fits no language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frees, mix, offsets, pieces, small_batches

#: Rows a language that the model is fitted on, at most; hash buckets of trigrams.
SAMPLE, BUCKETS, SMOOTHING, ROUNDS = 3000, 1 << 16, 0.2, 6
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>, other double"

_letters = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts put one after another: a bucket for each place, whether its trigram has
    a letter, and where each text's trigrams start and end."""
    low = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    is_letter = letters()[codes]
    c = np.where(is_letter, codes, 32).astype(np.uint64)
    key = c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42)
    some = is_letter[:-2] | is_letter[1:-1] | is_letter[2:]
    ends = np.cumsum([len(t) for t in low])
    starts = np.append(0, ends[:-1])
    return (mix(key) >> np.uint64(48)).astype(np.int64), some, starts, ends - 2


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        p = counts + SMOOTHING
        p = p / p.sum(1, keepdims=True)
        self.p = np.vstack([p, np.full((1, BUCKETS), 1 / BUCKETS)]).astype(np.float32) * BUCKETS

    def shares(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(share, kept) of each language, the uniform component last."""
        p, n = self.p[:, ids], len(ids)
        kept = np.arange(len(p))

        def fit(p: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
            for _ in range(rounds):
                share = share * (p @ (1 / (share @ p))) / n
            return share, float(np.log(share @ p).sum())

        share, fits = fit(p, np.full(len(p), 1 / len(p), np.float32), ROUNDS)
        while len(kept) > 1:
            drop = int(np.argmin(share))
            rest = np.delete(np.arange(len(kept)), drop)
            fewer = p[rest]
            less, worse = fit(fewer, share[rest] / share[rest].sum(), 2)
            if fits - worse > 0.5 * np.log(n):
                break
            kept, share, fits, p = kept[rest], less, worse, fewer
        full = np.zeros(len(self.p))
        full[kept] = share / share.sum()
        return full, kept

    def predict(self, texts: list[str]) -> tuple[list, list, list, list, list]:
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        ids, some, starts, ends = trigrams(texts)
        for a, b in zip(starts.tolist(), ends.tolist()):
            mine = ids[a:b][some[a:b]]
            if not len(mine) or not self.langs:
                row = ("und", 0.0, [], [], 1.0)
            else:
                full, kept = self.shares(mine)
                own = full[:-1]
                best, rest = int(np.argmax(own)), 1 - full[-1]
                if rest <= 0:  # only the uniform component is left: the nearest language
                    own = np.log(self.p[:-1, mine]).sum(1)
                    row = (self.langs[int(np.argmax(own))], 0.0, [], [], 1.0)
                else:
                    order = sorted((k for k in kept.tolist() if k < len(self.langs)), key=lambda k: -full[k])
                    row = (self.langs[best], float(min(1.0, own[best] / rest)), [self.langs[k] for k in order], [float(full[k]) for k in order], float(full[-1]))
            for column, x in zip(out, row):
                column.append(x)
        return out


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from (doc_id, text, lang), on at most about ``sample`` rows a language,
    chosen by a hash of doc_id. What comes to the driver is a count for each language
    and bucket, whatever the number of rows."""
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = sorted((r["lang"], r["count"]) for r in labelled.groupBy("lang").count().collect())
    langs = [lang for lang, _ in sizes]
    if not langs:
        return Model([], np.zeros((0, BUCKETS)))
    shares = F.lit([int(1e6 * min(1, sample / n)) + 1 for _, n in sizes])
    share = F.element_at(F.map_from_arrays(F.lit(langs), shares), F.col("lang"))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), BUCKETS), np.int64)
        place = {lang: i for i, lang in enumerate(langs)}
        for batch in batches:
            at = offsets(batch.column(0))
            for a, b in pieces(at):
                of = [place[x] for x in batch.column(1).slice(a, b - a).to_pylist()]
                ids, some, starts, ends = trigrams(batch.column(0).slice(a, b - a).to_pylist())
                for i, s, e in zip(of, starts.tolist(), ends.tolist()):
                    total[i] += np.bincount(ids[s:e][some[s:e]], minlength=BUCKETS) if e - s > 20_000 else 0
                    if e - s <= 20_000:
                        np.add.at(total[i], ids[s:e][some[s:e]], 1)
        i, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(k), pa.array(total[i, k])], ["i", "k", "n"])

    small_batches(labelled.sparkSession)
    counts = np.zeros((len(langs), BUCKETS))
    summed = chosen.select("text", "lang").mapInArrow(frees(count), "i bigint, k bigint, n bigint").groupBy("i", "k").agg(F.sum("n").alias("n"))
    got = summed.toArrow()
    counts[got["i"].to_numpy(), got["k"].to_numpy()] = got["n"].to_numpy()
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score (the language's share of
    what fits any language), languages (the set kept) and their shares, other (what fits
    none). ``und`` with score 0 for a null text, one without a letter, or an empty model.
    Texts are read whole; other columns are left out; equal texts give equal results; an
    empty table gives an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.float64()]
        for batch in batches:
            at = offsets(batch.column(2))
            for a, b in pieces(at):
                texts = [t or "" for t in batch.column(2).slice(a, b - a).to_pylist()]
                got = model.predict(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *map(pa.array, got, kinds)], ["doc_id", "held_out", "lang_pred", "score", "languages", "shares", "other"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(frees(run), SCHEMA)


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (with a text column) whose text fits some language: not
    ``und``, and other at most a half."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = offsets(batch.column(place))
            for a, b in pieces(at):
                part = batch.slice(a, b - a)
                langs, _, _, _, others = model.predict([t or "" for t in part.column(place).to_pylist()])
                yield part.filter(pa.array([lang != "und" and other <= 0.5 for lang, other in zip(langs, others)], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(frees(run), docs.schema)


def train_on(docs: DataFrame) -> Model:
    """The model of all documents that aren't held out."""
    return train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
