"""The ten operators and the pipeline: brute force, round trips, odd inputs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from panelspark.llm import contamination, fingerprints, html, jaccard, language, lines, mixing, quality, queries, repeats, sharding, tokens
from panelspark.llm.common import components, read
from tests.conftest import SMALL

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega "
ODD = [(1, LONG, "en", "a", 1), (2, None, None, None, 0), (3, "", "en", "a", 0), (4, LONG, "en", None, 1), (4, LONG, "en", None, 1), (None, LONG + "x", "fr", "b", 1), (5, "  \n\t ", "fr", "b", 1), (6, LONG * 4000, "fr", "b", 1), (7, "one two", "en", "a", 1), (8, "123 !!", "en", "a", 1)]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"shard": F.lit(9), "size": F.lit("s"), "key": F.lit(1), "h": F.lit(2), "bucket": F.lit("b"), "component_id": F.lit(0)})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.SQL[name])


# -- 1 -----------------------------------------------------------------------


def line_brute(rows, least):
    rows = sorted(((1 << 63) - 1 if i is None else i, t or "") for i, t in rows)
    seen, out = {}, []
    for n, (i, t) in enumerate(rows):
        ls = t.split("\n")
        gone = set()
        for p in range(len(ls) - least + 1):
            w = tuple(ls[p : p + least])
            if w in seen:
                gone.update(range(p, p + least))
            seen.setdefault(w, (n, p))
        runs = sum(1 for p in gone if p - 1 not in gone)
        out.append((None if i == (1 << 63) - 1 else i, len(ls), len(gone), runs, "\n".join(x for p, x in enumerate(ls) if p not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [1, 3, 5])
def test_lines(spark, least):
    r = random.Random(least)
    rows = [(r.randrange(30), "\n".join(r.choice("abc") for _ in range(r.randrange(1, 14)))) for _ in range(40)] + [(None, "a\nb\nc\na\nb\nc"), (99, None), (98, "a\n" * 200)]
    got = lines.without_copies(spark.createDataFrame(rows, "doc_id bigint, text string"), least)
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.n_runs, r.text) for r in got.collect()), key=repr) == line_brute(rows, least)


def short_brute(rows, words):
    """As line_brute, with runs of one or two lines and whole texts."""
    rows = sorted(((1 << 63) - 1 if i is None else i, t or "") for i, t in rows)
    seen, texts, out = set(), set(), []
    for i, t in rows:
        ls = t.split("\n")
        gone = set(range(len(ls))) if t in texts and t.split() else set()
        texts.add(t)
        for p in range(len(ls)):
            for n in (1, 2, 3):
                w = tuple(ls[p : p + n])
                if len(w) == n and w in seen and (n == 3 or len(" ".join(w).split()) >= words):
                    gone.update(range(p, p + n))
                seen.add(w)
        runs = sum(1 for p in gone if p - 1 not in gone)
        out.append((None if i == (1 << 63) - 1 else i, len(ls), len(gone), runs, "\n".join(x for p, x in enumerate(ls) if p not in gone)))
    return sorted(out, key=repr)


def test_short_runs(spark):
    r = random.Random(7)
    parts = ["a", "b", "", "c d e f", "g h i j k l m", " ".join("nopqrst")]
    rows = [(r.randrange(30) if k % 9 else None, "\n".join(r.choice(parts) for _ in range(r.randrange(1, 6)))) for k in range(80)] + [(31, "same text"), (32, "same text"), (33, "two\nlines"), (34, "two\nlines"), (35, None), (36, ""), (37, " \n")]
    got = lines.without_copies(spark.createDataFrame(rows, "doc_id bigint, text string"), words=7)
    got = sorted(((x.doc_id, x.n_lines, x.n_removed, x.n_runs, x.text) for x in got.collect()), key=repr)
    assert got == short_brute(rows, 7) and {i: t for i, *_, t in got}[32] == {i: t for i, *_, t in got}[34] == ""


def test_lines_odd(odd, none):
    assert lines.digests(odd).count() == len(ODD) and lines.digests(none).count() == 0


# -- 2 -----------------------------------------------------------------------


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard_brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    ids = sorted({i for i, _ in sets if i is not None})
    to = {i: i for i in ids}

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and i != j and x and y and 100 * len(x & y) >= 75 * len(x | y):
                u, v = sorted((root(i), root(j)))
                to[v] = u
    return sorted(((i, len(x), None if i is None else root(i)) for i, x in sets), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_jaccard(spark, seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    rows, base = [], [[r.choice(words) for _ in range(r.choice([3, 6, 12, 40, 160]))] for _ in range(12)]
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            k = r.randrange(len(w))
            w[k : k + r.randrange(2)] = [r.choice(words)]
        rows.append((i, " ".join(w)))
    rows += [(None, "a b c d e f"), (500, None), (501, " "), (3, "a b c d e f g"), (502, "A  b\tc d e f g")]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == jaccard_brute(rows)


def test_jaccard_links_members_that_miss_the_smallest(spark):
    """0 and 2 are too far apart, 1 links both: whatever the smallest is, all are one."""
    w = [f"w{k}" for k in range(200)]
    far = lambda n, tag: [f"{tag}{k}" if k < n else x for k, x in enumerate(w)]
    rows = [(0, " ".join(far(22, "a"))), (2, " ".join(far(22, "b"))), (5, " ".join(w)), (9, " ".join(far(22, "c")))]
    assert {r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == {0}


def thue_morse(n, a, b):
    """Words that polynomial hashes modulo 2**64 don't tell from their mirror image."""
    w = a
    while len(w) < n:
        w += w.translate(str.maketrans(a + b, b + a))
    return w, w.translate(str.maketrans(a + b, b + a))


def test_jaccard_tells_words_apart(spark):
    for n in (1024, 2048):
        x, y = thue_morse(n, "a", "b")
        rows = [(1, f"{x} one two three four five"), (2, f"{y} one two three four five"), (3, f"{y} one two three  four five")]
        got = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string"))
        assert sorted(map(tuple, got.collect())) == jaccard_brute(rows) == [(1, 2, 1), (2, 2, 2), (3, 2, 2)]


def test_jaccard_odd(odd, none):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.join(odd).collect()}
    assert got[2, 0] == 2 and got[3, 0] == 3 and got[4, 20] == 1 and jaccard.join(none).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(80)]
    to = {n: n for e in edges for n in e}
    for _ in to:
        for a, b in edges:
            to[a] = to[b] = min(to[a], to[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: c for n, c in to.items() if any(n in e and e[0] != e[1] for e in edges)}


# -- 3 -----------------------------------------------------------------------


def test_fingerprints(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(text, reverse=True)
    error = []
    for r in fingerprints.fingerprints(docs).collect():
        after = text[order[(order.index(r.doc_id) + 1) % len(order)]]
        own = text[r.doc_id]
        cut = len(own) // 3
        edited = own[: len(own) - cut] + after[:cut]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and len(r.fingerprint) == 256
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            x, y = shingles(own), shingles(other)
            error.append(abs(near - len(x & y) / len(x | y)))
    assert sum(error) / len(error) < 0.03 and max(error) < 0.25


def test_fingerprints_follow_the_order_over_many_ranges(spark):
    """Many more ranges than rows, and one id on a third of them."""
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        rows = [(None if i % 3 == 0 else i, f"text {i % 20} of some words {i % 20}") for i in range(90)]
        got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    edited = {hashlib.sha256((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode()).hexdigest() for _, t in rows for _, u in rows}
    assert len(got) == 90 and all(r.edited_sha256 in edited for r in got)
    text = dict(rows)
    ids = sorted((i for i in text if i is not None), reverse=True)
    for r in got:
        if r.doc_id is not None and r.doc_id != ids[-1]:
            t, u = text[r.doc_id], text[ids[ids.index(r.doc_id) + 1]]
            assert r.edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode()).hexdigest()


def test_fingerprints_odd(odd, none, spark):
    got = fingerprints.fingerprints(odd).collect()
    assert len(got) == len(ODD) and len({r.fingerprint for r in got if r.doc_id in (1, 4)}) == 1 and fingerprints.fingerprints(none).count() == 0
    alone = fingerprints.fingerprints(spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")).first()
    assert alone.near_next == 1.0 and {r.fingerprint for r in got if r.doc_id in (2, 3, 5)} == {""}


# -- 4 -----------------------------------------------------------------------

PAGES = [
    ("<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='ad'>Buy</div><article><h1>T &amp; U</h1><p>One <b>bo</b>ld&nbsp;x<p>Two\n  lines<!-- no --><br>Three</p><div class=comments><p>Nice</p></div></article><aside>s</aside><footer>&copy;</footer></body></html>", "T & U One bold x Two lines Three"),
    ("<article><p>cut off &lt;here", "cut off <here"),
    ("<div id=cookie-notice>We use cookies</div><header>Site</header><div id=content><p>Some real text of fair length.</p><p>And more of it.</p></div><div class=sidebar>Links</div><form><p>Name</p></form>", "Some real text of fair length. And more of it."),
    ("<script>var a='<article><p>x</p></article>'</script><main><p>Kept</p></main>", "Kept"),
    ("just text", "just text"),
    ("", ""),
    (None, ""),
    ("<ul><li><a href=a>One</a><li><a href=b>Two</a></ul>", ""),
    ("<article>" + "<p>é word</p>" * 5000 + "</article>", " ".join(["é word"] * 5000)),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, f"u{i}", h) for i, (h, _) in enumerate(PAGES)], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars) for r in html.main_text(df).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)} and html.main_text(df.limit(0)).count() == 0


BODY = " ".join(["Body text of the page."] * 40)
WEIGHED = [
    (f"<div><p>{BODY}</p></div><article><p>Short teaser.</p></article>", BODY),
    (f"<main><article><a href=a>A card</a></article><div>{BODY}</div></main>", BODY),
    (f"<article><p>{BODY}</p><ul><li><a href=a>Ref</a></ul><div>End.</div></article><div>Buy now</div>", f"{BODY} Ref End."),
    (f"<div>{BODY}</div><div>The end.</div><ul><li><a href=a>One</a></ul><div>Far away</div>", f"{BODY} The end."),
    (f"<div>{BODY}</div><ul><li><a href=a>One</a></ul><div>Between</div><ul><li><a href=a>Two</a></ul><div>{BODY}</div>", f"{BODY} Between {BODY}"),
    ("<article><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></article>", "One Two"),
]


def test_tags_only_weigh():
    assert [html.extract(h) for h, _ in WEIGHED] == [t for _, t in WEIGHED]


NAMES = ["no-sidebar", "content-sidebar-wrap", "related-work", "social-history", "share-price-history", "notice-of-death", "comments-on-treaty", "sidebar", "widget"]


@pytest.mark.parametrize("name", NAMES)
def test_a_wrappers_name_takes_no_text(name):
    assert html.extract(f"<div class='{name}'><h1>Head</h1><p>{BODY}</p></div>") == f"Head {BODY}"
    if name not in ("sidebar", "widget"):
        assert html.extract(f"<article><p>{BODY}</p><div id='{name}'><p>Part of the text.</p></div></article>") == f"{BODY} Part of the text."


@pytest.mark.parametrize("name", ["comments", "comment-list", "reader-comments", "ad", "ad-banner", "cookie-notice", "sidebar-left", "share-buttons", "related-articles"])
def test_furniture_goes(name):
    for long in ("Short.", "A comment of a reader. " * 60):
        assert html.extract(f"<article><p>{BODY}</p><div class='x {name}'><p>{long}</p></div><p>End.</p></article>") == f"{BODY} End."


def test_several_articles():
    teasers = "".join(f"<article><h2>Teaser {i}</h2><p>Of another story.</p></article>" for i in range(3))
    assert html.extract(f"<main><article><h1>Head</h1><p>{BODY}</p></article>{teasers}</main>") == f"Head {BODY}"
    assert html.extract(f"<article><p>{BODY}</p></article><article><p>{BODY}</p></article>") == f"{BODY} {BODY}"
    assert html.extract(f"<article><p>{BODY}</p><article><p>A reader says so.</p></article></article>") == BODY


def plain_article(page):
    """Another way, for well-formed pages: Python's parser, all text in articles."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        inside, dark, words = 0, 0, None

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.dark += tag in ("script", "style", "aside", "form", "nav", "footer")
            if tag in html.BLOCKS:
                self.words.append(" ")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.dark -= tag in ("script", "style", "aside", "form", "nav", "footer")
            if tag in html.BLOCKS:
                self.words.append(" ")

        def handle_data(self, data):
            if self.inside and not self.dark:
                self.words.append(data)

    reader = Reader(convert_charrefs=True)
    reader.words = []
    reader.feed(page or "")
    return " ".join("".join(reader.words).split())


def test_pages_another_way(spark):
    pages = read(spark, SMALL, "pages")
    want = {r.page_id: plain_article(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in html.main_text(pages).collect()} == want


def test_sections_another_way():
    """Random pages of which it is known what is text."""
    r = random.Random(8)
    for _ in range(200):
        body, want = [], []
        for k in range(r.randrange(2, 9)):
            text = f"Paragraph {k} &amp; more. " * r.randrange(12, 40)
            kept = " ".join(text.replace("&amp;", "&").split())
            what = r.randrange(6)
            if what < 3 or not want:
                body.append(r.choice(["<p>{}</p>", "<section><p>{}</p></section>", "<blockquote>{}</blockquote>", "<div class='no-sidebar'><p>{}</p></div>", "<h2>{}</h2>", "<ul><li>{}</li></ul>"]).format(text))
                want.append(kept)
            else:
                body.append(["<aside>{}</aside>", "<div class='ad'>{}</div>", "<script>{}</script>"][what - 3].format(f"Other {k}."))
        head = "<nav><ul><li><a href=/>Home</a></li></ul></nav><div class='ad'>Buy.</div>"
        assert html.extract(f"<html><body>{head}<article>{''.join(body)}</article><footer>End</footer></body></html>") == " ".join(want)


def test_pages_odd(spark):
    rows = [(1, "u", "<article><p>A b</p></article>"), (1, "u", "<article><p>A b</p></article>"), (None, None, None), (2, None, ""), (3, "v", "<article>" + "<p>word</p>" * 100_000), (4, "w", "<<<>>></div></p><p"), (5, "x", "<div " * 2000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x")})
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html.main_text(df).collect()), key=repr)
    assert got == sorted(((i, u, t, len(t)) for (i, u, h), t in zip(rows, ["A b", "A b", "", "", " ".join(["word"] * 100_000), got_of(rows[5][2]), got_of(rows[6][2])])), key=repr)


def got_of(page):
    return html.extract(page)


# -- 5 -----------------------------------------------------------------------


def test_mixing(spark):
    rows, blocks = mixing.mix(spark.read.parquet(f"{SMALL}/documents.parquet"))
    goal = {r.source: r.target for r in rows.select("source", "target").distinct().collect()}
    got = {r.source: r.w for r in blocks.groupBy("source").agg(F.sum("words").alias("w")).collect()}
    assert all(got[s] == int(t) for s, t in goal.items())
    # every shard takes a disjoint range of each source's permuted blocks; shards are even
    sizes = [r["count"] for r in blocks.groupBy("shard").count().collect()]
    assert len(sizes) == mixing.N_SHARDS and max(sizes) - min(sizes) <= mixing.N_SHARDS
    assert blocks.groupBy("source", "rank", "pass").count().where("count > 1").count() == 0


def test_split_quotas(spark):
    q = {"a": 1000, "b": 10, "c": 0, None: 333}
    cuts = {r.source: r.cuts for r in mixing.split_quotas(spark.createDataFrame(list(q.items()), "source string, quota bigint"), 8).collect()}
    assert {s: c[-1] for s, c in cuts.items()} == q and all(sorted(c) == c and len(c) == 8 for c in cuts.values())
    totals = [sum(c[k] - (c[k - 1] if k else 0) for c in cuts.values()) for k in range(8)]
    assert max(totals) - min(totals) <= 3


def test_draws_beyond_the_generators_bound(monkeypatch):
    import numpy as np

    big = [mixing.drawn(np.random.default_rng(s), 3 * 10**12, 10**12, 4 * 10**9) for s in range(40)]
    assert all(abs(x - 3e9) < 2e5 for x in big) and len(set(big)) > 30
    monkeypatch.setattr(mixing, "MOST_DRAWN", 2)
    got = [mixing.drawn(np.random.default_rng(s), 300, 200, 120) for s in range(400)]
    assert abs(sum(got) / 400 - 72) < 1 and abs(np.var(got) - 120 * 0.6 * 0.4 * 380 / 499) < 5
    assert mixing.drawn(np.random.default_rng(1), 7, 0, 5) == 5 and mixing.drawn(np.random.default_rng(1), 0, 7, 5) == 0


def test_ranges_draw_the_blocks_of_the_mix(spark):
    """The rows that are drawn by ranges of the permutation, with shards and places, are the
    blocks that come of joining ranks with quotas."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    _, blocks = mixing.mix(docs)
    want = sorted((r.doc_id, r.shard, r.place) for r in blocks.where("words * 2 >= size").collect())
    assert sorted((r.doc_id, r.shard, r.place) for r in mixing.draw(docs).collect()) == want and len({s for _, s, _ in want}) == mixing.N_SHARDS


def test_mixing_odd(odd, none):
    got = mixing.taken(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r.taken <= 2 * r.size for r in got) and mixing.taken(none).count() == 0


# -- 6 -----------------------------------------------------------------------


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs, language.train_on(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    n, ok = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100 and ok / n > 0.97


def test_language_of_a_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train_on(docs)
    text = {r.lang: r.text for r in docs.where("n_chars BETWEEN 2000 AND 4000").orderBy("doc_id").collect()}
    langs, shares = model.predict([text["de"][:1500] + " " + text["es"][:1500]])[2:4]
    assert set(langs[0][:2]) == {"de", "es"} and abs(shares[0][0] - 0.5) < 0.15


def test_language_odd(odd, none):
    model = language.train_on(odd)
    got = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[8].lang_pred == "und" and got[1].lang_pred in ("en", "fr")
    assert language.identify(none, model).count() == 0 and {r.lang_pred for r in language.identify(odd, language.train_on(none)).collect()} == {"und"}


# -- 7 -----------------------------------------------------------------------


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    r = random.Random(2)
    texts = ["", " ", "a  b\n\n c\n", "don't we'll ''t 's !'s", "x<|endoftext|>y <|endoftext|>", "日本語 １２ ½", "ab" * 5000, None, "  \r\n\t"] + ["".join(r.choice(" \n'strevmld01!?é中<|>") for _ in range(r.randrange(1, 40))) for _ in range(400)]
    texts += [x.text for x in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts += [w + end for n in (1024, 2048) for w in thue_morse(n, "a", "d") for end in ("", " z")] + [texts[3]] * 3 + ["\x00a \x00<|endoftext|>\x00"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash"))
    got = {x.doc_id: (x.n_bytes, x.n_tokens, x.over_limit) for x in tokens.token_counts(df).collect()}
    want = [(len((x or "").encode()), n, n > 1024) for x, n in zip(texts, [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)])]
    assert got == dict(enumerate(want)) and tokens.token_counts(df.limit(0)).count() == 0


# -- 8 -----------------------------------------------------------------------


def test_containment(spark):
    r = random.Random(4)
    make = lambda n: [f"w{r.randrange(500)}" for _ in range(n)]
    items = [(i, " ".join(make(n))) for i, n in enumerate([2, 4, 6, 9, 15, 40, 80])] + [(90, None), (91, " ")]
    docs = [(None, "x"), (1000, None), (1001, "")]
    for i in range(120):
        w = make(r.choice([10, 300, 3000]))
        item = (r.choice(items)[1] or "").split()
        for k in range(len(item)):
            item[k] = "zz" if r.random() < 0.02 else item[k]
        at = r.randrange(len(w))
        docs.append((i, " ".join(w[:at] + item + w[at:])))
    want = sorted((i, j, len(shingles(b)), len(shingles(a) & shingles(b))) for i, a in docs for j, b in items if shingles(b) and 100 * len(shingles(a) & shingles(b)) >= 75 * len(shingles(b)))
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1)), spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    assert sorted(map(tuple, contamination.contained(d, b).collect())) == want and len(want) > 40
    assert contamination.contained(d.limit(0), b).count() == contamination.contained(d, b.limit(0)).count() == 0


def test_containment_of_odd_rows(spark):
    seven, long = "a b c d e f g", "x " * 30_000 + "a b c d e f g"
    docs = spark.createDataFrame([(1, seven), (None, seven), (None, "x"), (2, None), (3, " "), (1, seven), (4, long)], "doc_id bigint, text string").withColumn("h", F.lit(1))
    items = spark.createDataFrame([(None, seven), (5, "A b c"), (6, None), (7, "a b c d e f q"), (7, "b c d e f"), (7, "b c d e f"), (8, "x")], "item_id bigint, text string").withColumn("row", F.lit(1))
    got = sorted(map(tuple, contamination.contained(docs, items).collect()), key=repr)
    assert got == sorted([(d, 7, 1, 1) for d in (1, 4, None)] + [(d, None, 3, 3) for d in (1, 4, None)] + [(None, 8, 1, 1)], key=repr)


# -- 9 -----------------------------------------------------------------------


def repeats_brute(rows):
    big = (1 << 63) - 1
    enc = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    seen = {}
    for i, b in enc:
        for s in range(len(b) - 49):
            seen[b[s : s + 50]] = min(seen.get(b[s : s + 50], i), i)
    out = []
    for (i, b), (own, _) in zip(enc, rows):
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if seen[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((own, len(b), len(b) - len(kept), sum(1 for j, g in enumerate(gone) if g and (not j or not gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("piece", [256, 1 << 17])
def test_repeats(spark, monkeypatch, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    r = random.Random(5)
    p = ["".join(r.choice("abé ") for _ in range(r.randrange(40, 140))) for _ in range(12)]
    rows = [(r.randrange(100) if i % 7 else None, "".join(r.choice([r.choice(p), "".join(r.choice("abcdefgh ") for _ in range(r.randrange(1, 60)))]) for _ in range(r.randrange(8))) if i % 11 else None) for i in range(120)]
    rows += rows[:10] + [(1, "a" * 500), (2, "a" * 49), (3, "a" * 50), (0, "a" * 60), (6, "ab" * 300), (7, "ab" * 100)]
    got = repeats.digests(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == repeats_brute(rows)


def test_the_greatest_id_is_kept(spark):
    top = (1 << 63) - 1
    rows = [(top, "line\n" * 30), (None, "line\n" * 30), (1, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in repeats.digests(df).collect()} == {r.doc_id for r in lines.digests(df).collect()} == {top, None, 1}


def test_repeats_of_many_rows_of_one_id(spark):
    passage = "".join(random.Random(3).choice("abcdefgh ") for _ in range(60))
    many = spark.range(66_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lpad(F.col("id").cast("string"), 5, "0").alias("text"))
    few = spark.createDataFrame([(-5, passage), (None, "z" + passage), (None, "zz" + passage)], "doc_id bigint, text string")
    got = repeats.without_repeats(many.union(few))
    cut = sorted((r.doc_id is None, bytes(r.kept)) for r in got.where("n_removed > 0 OR doc_id IS NOT NULL").collect())
    assert cut == [(False, passage.encode()), (True, b"z"), (True, b"zz")] and got.count() == 66_003


def test_repeats_odd(odd, none):
    assert repeats.digests(odd).count() == len(ODD) and repeats.digests(none).count() == 0


# -- 10 ----------------------------------------------------------------------


def test_lookup_table_is_even_and_steady():
    names = sharding.names_of(20)
    owner = sharding.lookup_table(names, 2003)
    share = [owner.count(k) for k in range(20)]
    fewer = sharding.lookup_table(names[:-1], 2003)
    moved = sum(a != b for a, b in zip(owner, fewer) if a != 19)
    assert max(share) - min(share) <= 1 and moved < 0.15 * 2003
    with pytest.raises(ValueError):
        sharding.lookup_table([])


def test_sharding_odd(odd, none):
    got = sharding.place(odd).collect()
    assert len(got) == len(ODD) and len({r.shard for r in got if r.doc_id == 4}) == 1 and sharding.place(none).count() == 0


# -- pipeline ----------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in cp.identify_language(spark, docs, SMALL).collect()}
    english = {r.doc_id for r in docs.where("lang = 'en'").collect()}
    assert all(any(c.isalpha() for c in text[i]) for i in kept) and len(kept) > 0.9 * len(text) and len(english - kept) <= 0.02 * len(english)
    near = jaccard_brute([(i, text[i]) for i in kept])
    reps = {i for i, _, c in near if i == c}
    items = [shingles(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = {i for i in reps if not any(b and 100 * len(shingles(text[i]) & b) >= 75 * len(b) for b in items)}
    import duckdb

    left = docs.where(F.col("doc_id").isin(sorted(clean))).toArrow()
    k = duckdb.connect()
    k.register("documents", left)
    owner = sharding.lookup_table(sharding.names_of(sharding.N_SHARDS))
    want = []
    for doc, size, taken in k.execute(f"SELECT doc_id, size, taken FROM ({mixing.SQL})").fetchall():
        copies = taken // size + (2 * (taken % size) >= size) if size else 0
        slot = int(hashlib.md5(str(doc).encode()).hexdigest()[:13], 16) % sharding.TABLE_SIZE
        want += [(doc, text[doc], slot, owner[slot])] * copies
    out = cp.run(spark, SMALL)
    assert set(cp.COLUMNS) < set(out.columns) and len(want) > len(clean)
    assert sorted((r.doc_id, r.text, r.slot, r.shard) for r in out.collect()) == sorted(want)


def test_stages_take_odd_rows(spark, odd, none):
    import corpus_pipeline as cp

    for _, stage in cp.STAGES:
        assert stage(spark, odd.select(cp.COLUMNS), SMALL).count() <= 2 * len(ODD)
        assert stage(spark, none.select(cp.COLUMNS), SMALL).count() == 0


def test_stages_by_row(spark):
    import corpus_pipeline as cp

    def run(stage, rows):
        docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], DOCS)
        got = stage(spark, docs, SMALL).collect()
        return sorted(((r.doc_id, r.text) for r in got), key=repr), docs

    other, item = "one two three four five six seven eight", spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    rows = [(1, LONG), (1, LONG), (4, LONG), (4, "123 !!"), (None, LONG), (None, "!!"), (None, LONG)]
    assert run(cp.identify_language, rows)[0] == sorted([(1, LONG), (1, LONG), (4, LONG), (None, LONG), (None, LONG)], key=repr)
    rows = [(1, LONG), (1, LONG), (1, other), (7, other), (None, LONG), (None, "x y z w v"), (None, "x y z w v"), (3, " "), (3, " ")]
    assert run(cp.drop_near_duplicates, rows)[0] == sorted([(1, LONG), (1, other), (None, "x y z w v"), (3, " ")], key=repr)
    rows = [(None, item), (None, LONG), (5, item), (5, LONG), (5, LONG)]
    assert run(cp.drop_contaminated, rows)[0] == sorted([(None, LONG), (5, LONG), (5, LONG)], key=repr)
    rows = [(1, LONG)] * 4 + [(None, LONG)] * 4
    got, docs = run(cp.mix_sources, rows)
    assert len(got) == int(mixing.FACTOR * len(rows)) and max(got.count(r) for r in got) <= 8


def test_texts_meet_labels_alike_at_any_size(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.marked(docs, labels)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(map(tuple, rows.collect()), key=str) == [(1, "a b", 1), (2, "c", None), (None, "d", None)]
