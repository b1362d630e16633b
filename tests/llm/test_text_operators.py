"""Text operators against brute force, an exact round trip or held-out accuracy, and on odd rows."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from platelens.llm import decontaminate, extraction, langid, mixing, neighbours, quality, sharding, simhash, substrings, tokens

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["size", "shard", "row", "node", "text_crc32", "_s", "_b", "lang_pred", "score", "mix_shard", "component_id", "group", "words"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, copies, and extra columns of clashing names."""
    rng = random.Random(7)
    prose = " ".join(rng.choice(["the", "of", "house", "river", "green", "walks"]) for _ in range(120))
    rows = [
        (1, prose, "en", "a", 5), (2, prose, "en", "a", 5), (2, prose, "en", "a", 5), (3, None, None, None, None), (4, "", "en", "b", 0),
        (5, " \t\n", None, "b", 3), (None, prose, "en", None, 5), (None, None, None, None, None), (6, prose + " end", "en", "b", 9),
        (7, "word", "en", "c", 4), (8, "x" * 50_000, "de", "c", 50_000), (9, "дом река", "ru", "c", 8), (10, " ".join(f"w{i}" for i in range(60_000)), "de", "a", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(df):
    return df.select("doc_id", "text").collect()


# --- near copies


def fingerprint(text, size=4, seed=42):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = np.array([xxhash.xxh64_intdigest(p, seed) for p in parts], dtype=np.uint64)
    return sum(1 << b for b in range(64) if parts and 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(parts))


def brute_components(codes, radius):
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in codes:
        for b in codes:
            if a < b and (a ^ b).bit_count() <= radius:
                root[find(b)] = find(a)
    return {c: find(c) for c in codes}


def check_components(df):
    rows = texts_of(df)
    code = {(r.doc_id, r.text): fingerprint(r.text) for r in rows}
    root = brute_components(set(code.values()), 4)
    least = {}
    for (d, _), c in code.items():
        if d is not None:
            least[root[c]] = min(d, least.get(root[c], d))
    want = Counter((r.doc_id, format(code[r.doc_id, r.text], "016x"), least.get(root[code[r.doc_id, r.text]])) for r in rows)
    assert Counter(map(tuple, simhash.simhash_components(df).collect())) == want


def test_simhash_odd_rows(odd, empty):
    check_components(odd)
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


@tables
def test_simhash_equals_brute_force(spark):
    check_components(spark.read.parquet(f"{SF}/documents.parquet"))


def test_links_are_complete_when_shards_are_cut_again(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 6)
    codes = {int(c) for c in centres}
    for c in centres.tolist():
        for _ in range(40):
            codes.add(c ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 5), replace=False)))
    df = spark.createDataFrame([(c, c) for c in sorted(codes)], "node long, c0 long")
    links = simhash.near_links(df, 4, shard=16).collect()
    root = brute_components(codes, 4)
    own = {c: c for c in codes}
    for _ in range(len(codes)):
        changed = False
        for r in links:
            low = min(own[r.a], own[r.b])
            changed |= own[r.a] != low or own[r.b] != low
            own[r.a] = own[r.b] = low
        if not changed:
            break
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups(own) == groups(root)


@tables
def test_keep_one_keeps_the_smallest_of_each_component(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    code = {r.doc_id: fingerprint(r.text) for r in texts_of(docs)}
    root, least = brute_components(set(code.values()), 4), {}
    for d, c in code.items():
        least[root[c]] = min(d, least.get(root[c], d))
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(least.values())


def test_keep_one_odd_rows(spark, odd):
    """Repeats of the kept document stay, another text under the same id is judged by its own text, no id: stays."""
    rows = [(1, "a b c d e", "en", "s", 1), (2, "A b  c d e", "en", "s", 1), (2, "x y z u v w", "en", "s", 1), (1, "a b c d e", "en", "s", 1),
            (None, "a b c d e", "en", "s", 1), (3, "", "en", "s", 1), (4, None, None, None, None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, "a b c d e")] * 2 + [(2, "x y z u v w"), (None, "a b c d e"), (3, "")])
    assert simhash.keep_one(odd).columns == odd.columns


# --- sharding


def test_shards(odd, empty, spark):
    docs = odd.union(odd)
    rows = sharding.digest(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in texts_of(docs)
    )
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and 0 <= s < 8
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.size, r.text_crc32].add(r.shard)
    assert all(len(v) == 1 for v in by_text.values())
    assert sharding.digest(empty).count() == 0


@tables
def test_shards_equal_plain_scheduling(spark):
    """Every group of equal texts is an item here: largest first, ties by hash, each to the shard of least bytes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    groups = Counter()
    for r in docs.collect():
        groups[r.text or ""] += len((r.text or "").encode()) + 1
    number = {t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64) for t in groups}
    loads, shard = [0] * 8, {}
    for t in sorted(groups, key=lambda t: (-groups[t], number[t])):
        shard[t] = min(range(8), key=lambda s: (loads[s], s))
        loads[shard[t]] += groups[t]
    assert min(groups.values()) * sharding.ITEMS >= sum(groups.values())
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.shard == shard[text[r.doc_id]] for r in sharding.digest(docs).collect())


def test_shards_are_near_equal_with_bins(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 97 as int)) || id").alias("text"))
    loads = Counter()
    for r in sharding.shard_documents(docs, items=256).collect():
        loads[r["shard"]] += r["size"]
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) <= sum(loads.values()) / 256 * 2


# --- token counts


def library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_tokens_equal_the_library(spark, odd, empty):
    path, tokenizer = library()
    rng = random.Random(5)
    alphabet = [*"abeABst ll'12é漢😀\n\t.,!|<>\x1c\x85 ", "the", " hello", "aaaa", "<|endoftext|>", "    "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(300)] + [None, "", "ab" * 3000 + "a" * 4001]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    count = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    for frame in (df, odd):
        got = Counter(map(tuple, tokens.count_tokens(frame, path).collect()))
        assert got == Counter((r.doc_id, len((r.text or "").encode()), n := count(r.text), n > 1024) for r in texts_of(frame))
    assert tokens.count_tokens(empty, path).count() == 0


def test_long_texts_are_cut_without_changing_counts():
    path, tokenizer = library()
    vocabulary = tokens.read_vocabulary(path)
    rng = random.Random(6)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "x1", "'s", "é"]) for _ in range(3000))
    find = tokens.regex.compile(tokens.PATTERN).findall
    found = [w for part in tokens.parts(text, tokens.regex.compile(tokens.CUT), 50) for w in find(part)]
    assert "".join(found) == text
    assert int(tokens.count_symbols([w.encode() for w in found], vocabulary).sum()) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_long_words_are_merged_through_a_heap():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, vocabulary = Tokenizer.from_file(path), tokens.read_vocabulary(path)
    ranks = dict(zip(vocabulary.pairs.tolist(), zip(vocabulary.ranks.tolist(), vocabulary.merged.tolist(), strict=True), strict=True))
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (1, 2, 300, 5000)] + ["aaaa" * 999, "thethe" * 700, "дом" * 900]
    for w in words:
        assert tokens.count_long(w.encode(), vocabulary, ranks) == len(tokenizer.encode(w, add_special_tokens=False).ids) == int(tokens.count_symbols([w.encode()], vocabulary)[0])
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    assert tokens.count_long(long.encode(), vocabulary, ranks) == len(tokenizer.encode(long, add_special_tokens=False).ids)


# --- extraction

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
<div class="menu"><a href=x>Home</a> <a>About</a></div><div id="content"><h1>Real title</h1><p>This is a long paragraph, with text &amp; more. It
goes on,   and on.</p><p>Second <b>one</b>,&nbsp;with <a href="y">a link</a> inside; it has words.<p>Third, unclosed. Fine.<ul><li>point one, good<li>point two</ul></div>
<div class="sidebar"><p>Side text, long enough. To matter.</p></div><div id="cookie-notice">We use cookies, sorry.</div><form><p>Name, please.</p></form>
<div class="comments"><p>Nice post, thanks.</p></div><div hidden>Secret, hidden text.</div><!-- <p>no</p> --><footer>foot</footer></body></html>"""


def test_extraction(spark):
    want = "Real title\nThis is a long paragraph, with text & more. It goes on, and on.\nSecond one, with a link inside; it has words.\nThird, unclosed. Fine.\npoint one, good\npoint two"
    assert extraction.main_text(PAGE) == want
    article = PAGE.replace('<div id="content">', "<article>").replace("</ul></div>", "</ul></article><div><p>Outside of it, a long text. With marks.</p></div>")
    assert extraction.main_text(article) == want
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "u", ""), (3, "u", "<"), (4, "u", "<p>a<p>" * 3), (5, "u", "<div" * 50), (6, "u", "plain &lt;b&gt; text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = extraction.extract(df).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[2] == "" and by_id[None] == "" and by_id[6] == "plain <b> text" and by_id[1] == want
    assert extraction.extract(df.limit(0)).count() == 0


@tables
def test_extraction_keeps_articles_whole(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for r in rows:
        inside = extraction.TAG.sub("\n", r.html[r.html.index("<article>") : r.html.index("</article>")])
        lines = [" ".join(extraction.html.unescape(x).split()) for x in inside.split("\n")]
        assert extraction.main_text(r.html).split("\n") == [x for x in lines if x]


LONG = "A sentence of the article, with some words in it. " * 8


@pytest.mark.parametrize("wrap", ["<body><article>{}</article></body>", "<body><div><p>Menu</p></div><div>{}</div></body>", "<body>{}</body>"])
def test_extraction_keeps_lists_tables_and_text_beside_a_long_block(wrap):
    paragraphs = [f"<p>{k} {LONG}</p>" for k in range(10)]
    extras = [
        "<ul>" + "".join(f"<li>plain entry number {k}</li>" for k in range(8)) + "</ul>",
        "<table>" + "".join("<tr>" + "".join(f"<td>cell {k} {j}</td>" for j in range(4)) + "</tr>" for k in range(5)) + "</table>",
        "<dl>" + "".join(f"<dt>term {k}</dt><dd>what it is</dd>" for k in range(5)) + "</dl>",
        "<pre>" + "x = f(y); " * 6000 + "</pre>", "<blockquote><p>" + LONG * 50 + "</p></blockquote>", "<h2>Heading</h2>",
    ]
    for extra in extras:
        inner = "".join(["<h1>The title</h1>", *paragraphs[:5], extra, *paragraphs[5:]])
        want = [" ".join(x.split()) for x in extraction.TAG.sub("\n", inner).split("\n")]
        got = extraction.main_text(wrap.format(inner)).split("\n")
        assert [x for x in got if x not in ("The title", "Menu")] == [x for x in want if x and x != "The title"]
        assert wrap.startswith("<body>{}") or "The title" in got


@pytest.mark.parametrize("mark", ["class='layout with-sidebar'", "class='no-sidebar'", "class='post comments-open'", "class='content widget-area'", "id='search-results'", "class='sidebar'"])
def test_extraction_takes_names_as_a_suspicion_only(mark):
    body = "".join(f"<p>{k} {LONG}</p>" for k in range(5))
    want = [f"{k} {LONG}".strip() for k in range(5)]
    page = f"<body><div {mark}><div>{body}</div><div class='sidebar'><p>Side text, to be left out.</p></div></div><div class='ad'>Buy now, cheap.</div></body>"
    assert extraction.main_text(page).split("\n") == want
    posts = "".join(f"<div class='post comments-open'><p>{k} {LONG}</p></div>" for k in range(5))
    assert extraction.main_text(f"<body>{posts}</body>").split("\n") == want


def test_extraction_takes_articles_only_when_they_hold_most():
    body = "".join(f"<p>{k} {LONG}</p>" for k in range(5))
    teasers = "".join(f"<article><a href=x>Teaser {k}, to read.</a></article>" for k in range(4))
    want = [f"{k} {LONG}".strip() for k in range(5)]
    assert extraction.main_text(f"<body><div>{body}</div><div>{teasers}</div></body>").split("\n") == want


def test_extraction_falls_back_when_marks_leave_nothing():
    body = "".join(f"<p>{k} {LONG}</p>" for k in range(5))
    want = [f"{k} {LONG}".strip() for k in range(5)]
    assert extraction.main_text(f"<body><form id=aspnet><script>var x = 1;</script>{body}</form></body>").split("\n") == want
    assert extraction.main_text(f"<body><div hidden>{body}</div></body>") == ""


def test_extraction_keeps_forms_that_hold_the_page_and_links_of_articles():
    body = "".join(f"<p>{k} {LONG}</p>" for k in range(5))
    want = [f"{k} {LONG}".strip() for k in range(5)]
    page = f"<body><div>Skip to content, please.</div><form id=aspnet>{body}</form><form><p>Your name, please.</p><input></form></body>"
    assert [x for x in extraction.main_text(page).split("\n") if not x.startswith("Skip")] == want
    links = "<ul>" + "".join(f"<li><a href=x>Reference work {k}</a></li>" for k in range(5)) + "</ul><p><a href=y>A paragraph that is one link.</a></p>"
    article = f"<body><nav><a href=z>Home</a></nav><article>{body}{links}</article></body>"
    assert extraction.main_text(article).split("\n") == want + [f"Reference work {k}" for k in range(5)] + ["A paragraph that is one link."]


@pytest.mark.parametrize("mark", ["class='user-comments'", "class=commentlist", "class='ad-slot-2'", "class='article-ad'", "class='related-stories'", "class='comment-list'", "id=newsletter-signup"])
def test_extraction_leaves_out_parts_with_compound_names(mark):
    body = "".join(f"<p>{k} {LONG}</p>" for k in range(5))
    want = [f"{k} {LONG}".strip() for k in range(5)]
    page = f"<body><div class='site-header'><p>The name of the site, in short.</p></div><article>{body}<div {mark}><p>Something else, not of the article. Really.</p></div></article></body>"
    assert extraction.main_text(page).split("\n") == want


def test_extraction_without_marks_goes_by_ratios(monkeypatch):
    """On pages without articles the threshold decides: none keeps all paths, a high one drops short paths."""
    body = "".join(f"<p>{k} {LONG}</p>" for k in range(5))
    short = "".join(f"<div><span>Tiny {k}</span></div>" for k in range(12))
    page = f"<body><div>{short}</div><section>{body}</section></body>"
    assert extraction.main_text(page).split("\n") == [f"{k} {LONG}".strip() for k in range(5)]
    monkeypatch.setattr(extraction, "SHARE", 0.0)
    assert extraction.main_text(page).split("\n")[0] == "Tiny 0"


# --- quality


def test_labeller_accuracies_are_found():
    rng = np.random.default_rng(2)
    bad = rng.random(20_000) < 0.2
    right = [0.95, 0.9, 0.8]
    votes = np.column_stack([np.where(rng.random(len(bad)) < r, 1 + bad, 2 - bad) * (rng.random(len(bad)) < 0.9) for r in right])
    patterns, of = np.unique(votes, axis=0, return_inverse=True)
    share, table = quality.estimate(patterns, np.bincount(of).astype(float), 0.1)
    found = quality.posterior(patterns, share, table)[of] > 0.5
    assert (found == bad).mean() > 0.93


@tables
def test_quality_on_labels(spark, odd, empty):
    sf = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality.rate(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect()}
    rows = labels.collect()
    assert np.mean([(got[r.doc_id].quality >= 0.5) == (r.quality == 1) for r in rows]) > 0.95
    clean = [r for r in rows if r.quality == 1 and r.toxic == 0]
    assert np.mean([got[r.doc_id].keep for r in clean]) > 0.98
    toxic = [r for r in rows if r.toxic == 1]
    assert np.mean([got[r.doc_id].toxic for r in toxic]) > 0.5
    rated = quality.rate(odd, labels.limit(0)).collect()
    assert len(rated) == odd.count() and all(r.quality == 0 and not r.keep for r in rated if r.doc_id in (3, 4, 5))
    assert quality.rate(empty, labels).count() == 0


# --- mixing


def run_sql(sql, **frames):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name, df.toPandas())
    return Counter(con.execute(sql).fetchall())


def test_mix_equals_sql(odd, empty):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").dropDuplicates()
    got = Counter(map(tuple, mixing.digest(odd.dropDuplicates()).collect()))
    assert got == run_sql(mixing.SQL, documents=docs)
    assert mixing.digest(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_mix_of_many_sources_equals_sql(spark):
    """More sources than blocks of one: fewer blocks for each, the same mix as in SQL."""
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(40))), "en", f"site{rng.randrange(2600)}", 1) for i in range(5000)]
    df = spark.createDataFrame(rows, DOCS)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    want = Counter((a, b, c, round(d, 6), e) for a, b, c, d, e in con.execute(f"SELECT {', '.join(cols)} FROM ({mixing.SQL})").fetchall())
    assert Counter((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in mixing.digest(df).select(*cols).collect()) == want
    assert mixing.mixed(df).count() > 0


def test_targets_share_the_excess_until_none_is_above():
    sizes, weights = [100, 10, 1, 1000], [3, 1, 2, 3]
    due = mixing.targets(sizes, weights)
    assert due[2] == 2 and sum(due) == pytest.approx(1.5 * sum(sizes)) and all(d <= 2 * s for d, s in zip(due, sizes, strict=True))
    assert mixing.targets([0, 0], [3, 1]) == [0, 0]


@tables
def test_mix_meets_targets_and_shards_are_disjoint(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.plan(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    taken, due = Counter(), {}
    for r in plan:
        words = sum(d.words for d in r.draws)
        assert words <= 2 * r["size"]
        taken[r.source] += words
        due[r.source] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in due.items())
    mixed = mixing.mixed(docs).collect()
    assert sum(len((r.text or "").encode().split()) for r in mixed) == sum(taken.values())
    assert Counter(map(tuple, mixing.mixed(docs).collect())) == Counter(map(tuple, mixed))
    quotas = np.array([50, 7, 0, 90])
    split = mixing.split_quotas(quotas, 8, np.random.default_rng(0))
    assert (split.sum(axis=0) == quotas).all() and split.sum(axis=1).max() - split.sum(axis=1).min() <= 3


# --- decontamination


def edits(words, n, rng):
    words = list(words)
    for _ in range(n):
        j = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[j] = "zz"
        elif kind == 1 and len(words) > 1:
            del words[j]
        else:
            words.insert(j, "yy")
    return words


def word_distance(item, text):
    """Least edits from ``item`` to any stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(6, 45))] for _ in range(25)]
    docs = []
    for i in range(120):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 90))]
        if i % 2:
            item = items[i % 25]
            at = rng.randrange(len(own) + 1)
            own[at:at] = edits(item, rng.choice([0, 1, len(item) // 10, len(item) // 5, len(item) // 3]), rng)
        docs.append(own)
    df = spark.createDataFrame([(i, " ".join(w).upper() if i % 3 else ", ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    want = {(d, i): n for d, w in enumerate(docs) for i, item in enumerate(items) if (n := word_distance(item, w)) <= int(0.2 * len(item) + 1e-9)}
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(df, bench).collect()}
    assert got.keys() <= want.keys() and all(got[k] >= want[k] for k in got)
    assert len(got) >= 0.98 * len(want)
    hit = {d for d, _ in got}
    assert {r.doc_id for r in decontaminate.keep_clean(df, bench).collect()} == set(range(120)) - hit


def test_short_and_unspaced_items_are_found(spark):
    items = ["paris", "born in ulm", "a b c d", "春眠不觉晓处处闻啼鸟夜来风雨声花落知多少", "ภาษาไทยไม่เว้นวรรค", "mixed 東京 words"]
    poem = items[3]
    docs = ["He was BORN in Ulm, then.", "born at ulm", "in paris: rain", "parisian", "a b c x d", "序" + poem + "完", poem[:7] + "X" + poem[8:], poem[:4] + "一二三四五六" + poem[10:], "x ภาษาไทยไม่เว้นวรรค y", "mixed東京words", "東 京"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(items)], "item_id string, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(0, "i1"): 0, (2, "i0"): 0, (5, "i3"): 0, (6, "i3"): 1, (8, "i4"): 0, (9, "i5"): 0}


@pytest.mark.parametrize("size", [400, 1000])
def test_long_items_at_the_edge_of_the_similarity(size):
    """Of items with as many edits as the similarity allows, all but few are found whatever the length."""
    rng = random.Random(size)
    item = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    texts = []
    for _ in range(40):
        own = list(item)
        for j in rng.sample(range(size), size // 5):
            own[j] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(["before"] * 30 + own + ["after"] * 30).encode())
    index = decontaminate.index_items([" ".join(item)], 0.8)
    words, first = decontaminate.word_ids(np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)]))
    found = decontaminate.find_items(index, words, first)
    assert len(set(found[0].tolist())) >= 39 and max(found[2]) <= size // 5


def test_decontamination_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(500, 540))), (2, None), (None, ""), (3, "of the"), (1, None)], "item_id long, text string")
    found = decontaminate.contaminated(odd, bench).collect()
    prose = [r.doc_id for r in odd.collect() if " of the " in f" {r.text} "]  # the short item stands in the prose as a whole
    assert Counter((r.doc_id, r.item_id, r.distance) for r in found) == Counter([(10, 1, 0), *((d, 3, 0) for d in prose)])
    kept = decontaminate.keep_clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1 - len(prose)
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(odd, bench.limit(0)).count() == 0


# --- language


@tables
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.digest(docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.col("lang")))).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.98


def test_language_odd_rows_and_spans(spark, odd, empty):
    got = langid.digest(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5)} == {"und"}
    assert langid.digest(empty).count() == 0
    assert {r.lang_pred for r in langid.digest(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and {3, 4, 5}.isdisjoint(r.doc_id for r in kept.collect())
    train = spark.createDataFrame([(i, t, g, "s", 1) for i in range(40) for t, g in ((f"the house of the river walks {i} and then", "en"), (f"дом у реки стоит {i} и потом еще", "ru"), (f"la maison de la rivière est {i} et puis", "fr"))], DOCS)
    mixed = spark.createDataFrame([(1, "the house and the river then " * 8 + "la maison et la rivière est puis " * 8 + "дом реки стоит " * 8)], "doc_id long, text string")
    spans = langid.identify(mixed, langid.fit(train), spans=True).first().spans
    assert [s.lang for s in spans] == ["en", "fr", "ru"] and spans[0].first == 0 and spans[-1].end == 8 * (6 + 7 + 3)


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(4)
    first = np.array([0, 5, 5, 6, 12])
    score = rng.normal(size=(12, 3)).astype(np.float32)
    got = langid.viterbi(score, first, 1.5)
    for a, b in zip(first[:-1], first[1:], strict=True):
        total = lambda p: sum(score[a + t, x] for t, x in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:], strict=False))  # noqa: E731, B023
        paths = [tuple(x // 3**k % 3 for k in range(b - a)) for x in range(3 ** (b - a))]
        assert total(tuple(got[a:b])) == pytest.approx(max(map(total, paths)), abs=1e-4)


# --- neighbours


def brute_neighbours(rows, every, k=10):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    for i, v in good:
        if i % every == 0:
            yield i, sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in good if j != i)[:k]


def test_neighbours_recall(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16)) * 2
    rows = [(i, (centres[i % 30] + rng.normal(size=16)).astype(np.float32).tolist()) for i in range(4000)]
    got = defaultdict(list)
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=50).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = []
    for i, best in brute_neighbours(rows, 50):
        assert [r for r, _, _ in sorted(got[i])] == list(range(1, 11))
        hits.append(len({v for _, v, _ in got[i]} & {j for _, j in best}))
        exact = {j: d for d, j in best}
        assert all(s == pytest.approx(exact[v], rel=1e-12) for _, v, s in got[i] if v in exact)
    assert np.mean(hits) / 10 > 0.93


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [5.0, 5.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("leaf", F.lit("clash"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(df).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 8, 5.0), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 8, 5.0)]
    assert neighbours.search(df.limit(0)).count() == 0
    copies = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    assert [(r["rank"], r.vec_id) for r in neighbours.search(copies).filter("query_id = 200").orderBy("rank").collect()] == [(n + 1, n) for n in range(10)]


# --- repeated passages


def brute_passages(rows, span=50):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in sorted((x for x in split if x[0] is not None), key=lambda x: x[0]):
        for i in range(len(w) - span + 1):
            first.setdefault(hash(tuple(w[i : i + span])), d)
    out = Counter()
    for d, w in split:
        gone = set()
        for i in range(len(w) - span + 1):
            if d is not None and first[hash(tuple(w[i : i + span]))] < d:
                gone.update(range(i, i + span))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def passage_rows():
    rng = random.Random(9)
    say = lambda n: [f"t{rng.randrange(400)}" for _ in range(n)]
    line, long = say(30), say(90)
    rows = []
    for i in range(60):
        own = say(rng.randrange(0, 80)) + line + say(rng.randrange(0, 60))
        if i % 3 == 0:
            own += long[rng.randrange(0, 30) : 90 - rng.randrange(0, 30)] + say(5)
        if i % 7 == 0:
            own = ["same"] * 130
        rows.append((i, " ".join(own)))
    return rows + [(60, rows[4][1]), (61, rows[4][1]), (61, rows[4][1]), (4, rows[4][1])]


@pytest.mark.parametrize("shard", [2000, 1])
def test_passages_equal_brute_force(spark, odd, empty, monkeypatch, shard):
    monkeypatch.setattr(substrings, "SHARD", shard)
    rows = passage_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, substrings.digest(df).collect())) == brute_passages(rows)
    if shard > 1:
        assert Counter(map(tuple, substrings.digest(odd).collect())) == brute_passages([tuple(r) for r in texts_of(odd)])
        assert substrings.digest(empty).count() == 0


@tables
def test_passages_equal_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert Counter(map(tuple, substrings.digest(docs).collect())) == run_sql(substrings.SQL, documents=docs)


# --- pipeline


@tables
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    language = corpus_pipeline.language(spark, docs, SF)
    assert {r.doc_id for r in language.collect()} == {d for d, t in text.items() if any(map(str.isalpha, t))}
    single = corpus_pipeline.near_duplicates(spark, docs, SF)
    kept = {r.doc_id for r in single.collect()}
    least = {}
    for d in sorted(text):
        least.setdefault(text[d], d)
    assert all(d not in kept for d in text if least[text[d]] != d)  # exact copies
    clean = {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, SF).collect()}
    assert clean == {d for d, t in text.items() if not any(b.text in t for b in bench.collect())}
    mix = corpus_pipeline.mix(spark, docs, SF)
    assert mix.columns == single.columns == language.columns == docs.columns
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} <= kept & clean
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_pipeline_stages_on_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        assert corpus_pipeline.language(spark, docs, SF).columns == docs.columns
        kept = corpus_pipeline.near_duplicates(spark, docs, SF)
        assert sorted(kept.columns) == sorted(docs.columns)
        mixed = corpus_pipeline.mix(spark, docs, SF)
        assert mixed.columns == [c for c in docs.columns if c != "mix_shard"]
        assert corpus_pipeline.shards(spark, mixed, SF).count() == mixed.count()
