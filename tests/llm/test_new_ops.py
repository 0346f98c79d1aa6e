"""Alignment, quality rules, manifest: brute force, odd rows, many partitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelspark.llm import alignment, merkle, quality
from panelspark.llm.common import read
from tests.conftest import SMALL
from tests.llm.test_ops import DOCS, LONG, ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, None if t is None else t[: len(LONG) * 40], *rest) for i, t, *rest in ODD]
    clash = {c: F.lit(1) for c in ("key", "idx", "n", "leaf", "start", "root", "chunk", "slot", "a", "b", "count", "kept", "n_words", "trusted", "digest", "path", "run")}
    return spark.createDataFrame(rows, DOCS).withColumns(clash)


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


# -- 11 ----------------------------------------------------------------------


def align_brute(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}

    def spans(tokens):
        at, out = 0, []
        for i, raw in tokens:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    def one(text):
        full = (" " + (text or "")).encode()
        a = [(i, bytes(byte[c] for c in a_lib.id_to_token(i))) for i in a_lib.encode(" " + (text or ""), add_special_tokens=False).ids]
        pieces = [(i, b_lib.id_to_piece(i)) for i in b_lib.encode(text or "")]
        b = [(i, bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
        if not text or b"".join(x for _, x in a) != full or b"".join(x for _, x in b) != full:
            return [], [], [], [], ""
        a, b = spans(a), spans(b)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, _, e in side if low < e <= end) for side in (a, b)))
            low = end
        links = [(i, j) for i, s, e in a for j, u, v in b if max(s, u) < min(e, v)]
        return a, b, groups, links, hashlib.sha256(";".join(groups).encode()).hexdigest()

    found = [one(t) for t in texts]
    count = Counter(x for f in found for x in f[3])
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [(len(a), len(b), len(g), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha) for a, b, g, links, sha in found]


def alignment_texts():
    r = random.Random(3)
    texts = ["".join(r.choice("ab \n\tcd' .é,0X<s>　s") for _ in range(r.randrange(60))) for _ in range(150)]
    return [*texts, None, "", " ", "a", " a", "a ", "a  b", "don't stop  \n", "<|endoftext|> x </s>", "日本語 テキスト 😀 x", "a ▁ b", "a\r\nb \n c", "\x00 \x1c a", *["the same words"] * 40, "the the the the the the the"]


@pytest.mark.parametrize("most", [200, 1 << 20])
def test_alignment(spark, most):
    texts = alignment_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = sorted(tuple(r) for r in alignment.align(docs, most_bytes=most).collect())
    assert got == [(i, *row) for i, row in enumerate(align_brute(texts))]


def test_alignment_of_documents(spark, many_partitions):
    docs = read(spark, SMALL, "documents").select("doc_id", F.substring("text", 1, 600).alias("text"))
    held = sorted(tuple(r) for r in docs.collect())
    got = sorted(tuple(r) for r in alignment.align(docs).collect())
    assert got == [(i, *row) for (i, _), row in zip(held, align_brute([t for _, t in held]))]


def test_alignment_odd(odd):
    texts = [r.text for r in odd.collect()]
    got = sorted((tuple(r) for r in alignment.align(odd).collect()), key=repr)
    short = [i for i, t in enumerate(texts) if len(t or "") < 10_000]
    assert len(got) == len(texts) and all((ODD[i][0], *align_brute(texts)[i][:4]) in [g[:5] for g in got] for i in short)
    assert alignment.align(odd.limit(0)).count() == 0


# -- 12 ----------------------------------------------------------------------


def rules_brute(rows, labels):
    marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    parts_of = re.compile(f"[{re.escape(marks)}]+|[^{re.escape(marks)}\\x20\\x09-\\x0D]+")

    def bins(text):
        crc = [zlib.crc32(p.encode()) for p in parts_of.findall(text or "")]
        return [c % 10_000 for c in crc] + [(a * 1_000_003 + b) % 10_000 for a, b in zip(crc, crc[1:])]

    by = {}
    for i, q, t in labels:
        by.setdefault(i, []).append((q, t or 0))
    good_ids = {i for i, v in by.items() if i is not None and min((q for q, _ in v if q is not None), default=None) == 1 and max(t for _, t in v) == 0}
    raw, good = Counter(), Counter()
    for i, t in rows:
        raw.update(bins(t))
        if i in good_ids:
            good.update(bins(t))
    shift = math.log(raw.total() + 10_000) - math.log(good.total() + 10_000)
    ratio = {b: math.floor(1_000_000 * (math.log((good[b] + 1) / (raw[b] + 1)) + shift) + 0.5) if good else 0 for b in raw}
    out = []
    for i, t in rows:
        w, g = WORD.findall(t or ""), bins(t)
        times = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if times[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        total = sum(ratio[b] for b in g)
        out.append((i, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), failed, not failed and total >= -250_000 * len(g), len(g), total))
    return sorted(out, key=repr)


def test_rules(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, SMALL, "documents").select("doc_id", "text").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in read(spark, SMALL, "labels").collect()] + [(None, 1, 0), (rows[0][0], 0, None), (10**9, 1, 0)]
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = sorted((tuple(r) for r in quality.rules(read(spark, SMALL, "documents"), frame).collect()), key=repr)
    assert got == rules_brute(rows, labels)


def test_rules_odd(odd, many_partitions):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    labels = [(1, 1, 0), (1, 1, 0), (4, 1, 1), (5, None, None), (None, 1, 0)]
    frame = odd.sparkSession.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = sorted((tuple(r) for r in quality.rules(odd, frame).collect()), key=repr)
    assert got == rules_brute(rows, labels)
    assert quality.rules(odd.limit(0), frame).count() == 0
    without = sorted((tuple(r) for r in quality.rules(odd, frame.limit(0)).collect()), key=repr)
    assert without == rules_brute(rows, []) and all(r[7] != r[6] for r in without)


def test_a_bounded_number_of_trusted_documents(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    some = sorted(r.doc_id for r in quality.trusted(labels, 1000).collect())
    assert 800 < len(some) < 1200 and some == sorted(r.doc_id for r in quality.trusted(labels.repartition(7), 1000).collect())


# -- 13 ----------------------------------------------------------------------


def manifest_brute(rows):
    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return h(*(field(v) for v in (r[0], r[3], r[2], r[4], text)))

    def climb(nodes):
        """Levels of digests, and of a position: (left, right) a level."""
        held = [nodes]
        while len(held[-1]) > 1:
            held.append([h(*held[-1][i : i + 16]) for i in range(0, len(held[-1]), 16)])
        return held

    def around(held, i):
        out = []
        for level in held[:-1]:
            start = i // 16 * 16
            out.append((level[start:i], level[i + 1 : start + 16]))
            i //= 16
        return out

    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees, order = {}, {}
    for s in sources:
        order[s] = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = climb([leaf(r, r[1]) for r in order[s]])
    top = climb([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(order[s]):
            steps = around(trees[s], i) + around(top, k)
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            at = leaf(r, text)
            for left, right in steps:
                at = h(*left, at, *right)
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], top[-1][0], h(*(x for left, right in steps for x in (*left, *right))), at, at == top[-1][0]))
    return sorted(out, key=repr)


def manifested(docs):
    return sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 17, 300])
def test_manifest(spark, n):
    r = random.Random(n)
    rows = [(r.randrange(200) if k % 11 else None, r.choice(["Ab", "é", "", None, "xY"]), r.choice(["en", None]), r.choice(["s", "s", "s", "t", None, "", *[f"u{i}" for i in range(20)]]), r.randrange(3)) for k in range(n)]
    assert manifested(spark.createDataFrame(rows, DOCS).repartition(3)) == manifest_brute(rows)


def test_manifest_of_documents(spark, many_partitions):
    docs = read(spark, SMALL, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("bigint"))
    assert manifested(docs) == manifest_brute([tuple(r) for r in docs.collect()])


def test_manifest_odd(odd):
    assert manifested(odd) == manifest_brute([tuple(r)[:5] for r in odd.collect()])
    assert manifested(odd.limit(0)) == []


@pytest.mark.parametrize("texts", [[None], ["", None], ["a" * 20_000], [" " * 3000], ["x\n" * 3, "퟿ x"]])
def test_alignment_of_extremes(spark, texts):
    """Nothing to align, one token thousands of times (many planes), only white space."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(tuple(r)[:5] for r in alignment.align(docs).collect())
    short = align_brute([t if t is None or len(t) < 100 else None for t in texts])
    for (i, *row), want, t in zip(got, short, texts):
        if t is None or len(t) < 100:
            assert tuple(row) == want[:4]
        else:
            assert row[0] > 0 and row[3] == row[0] + row[1] - row[2]
    assert len(got) == len(texts)


def test_all_trusted_documents_count(spark):
    """No cap on those to learn from."""
    labels = spark.range(200_500).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert quality.trusted(labels).count() == 200_500
