"""Token output, packing, media, HTML and nearest neighbours: round trips and brute force."""

import gzip
import hashlib
import io
import math
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom.llm import ann, html, media, packing, queries, token_output
from seriesloom.llm.tokens import encoder

SF = "/root/testdata/sf0.001"
BYTES, WORDS = (queries.tokenizer_path(f"{x}.json") for x in ("byte_bpe_50k", "word_bpe_49k"))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab'sré ÀßİÉ \n\t\r1٣.,!<|>日́ ") | st.characters(codec="utf-8"), max_size=60))
def test_ids_are_the_librarys(text):
    for path in (BYTES, WORDS):
        e = encoder(path)
        assert np.frombuffer(e.encode(text), np.uint32).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=900), st.integers(0, 99))
def test_shards_round_trip(ids, percentile):
    cuts = sorted({0, len(ids) // 3, len(ids)}) if ids else [0, 0]
    back, starts, before = token_output.decode_shard(token_output.encode_shard(np.array(ids, np.uint32), np.array(cuts), 11, percentile))
    assert back.tolist() == ids and starts.tolist() == cuts and before == 11


def by_hand(rows, path, end):
    t = encoder(path).tokenizer
    return [(d, t.encode(x or "", add_special_tokens=False).ids + [end]) for d, x in rows]


def test_token_output(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [tuple(r) for r in token_output.read_tokens(token_output.write_tokens(docs.repartition(5), BYTES, shard_ids=5000)).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id").collect()]
    start, expected = 0, []
    for d, ids in by_hand(sorted((r["doc_id"], r["text"]) for r in docs.collect()), BYTES, 0):
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected


def test_token_output_edges(edge, empty):
    rows = token_output.read_tokens(token_output.write_tokens(edge, BYTES)).orderBy("start").collect()
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]
    assert len(rows) == 13 and rows[0]["doc_id"] is None and [r["n_tokens"] for r in rows if r["doc_id"] == 2] == [1]
    assert token_output.read_tokens(token_output.write_tokens(empty, BYTES)).count() == 0


def literal_sum_of_squares(lengths, capacity):
    gaps, bins, out = [], [], []
    for s in lengths:
        def total(after):
            return sum(after.count(g) ** 2 for g in set(after) if g)
        choices = [(total([g - s if i == b else g for i, g in enumerate(gaps)]), gaps[b], b) for b in range(len(gaps)) if gaps[b] >= s]
        choices.append((total([*gaps, capacity - s]), capacity, len(gaps)))
        best = min(c[0] for c in choices)
        out.append((best, {c[1] for c in choices if c[0] == best}))
        gap = min(c[1] for c in choices if c[0] == best)
        b = next(c[2] for c in choices if c[:2] == (best, gap))
        if b == len(gaps):
            gaps.append(capacity)
        gaps[b] -= s
        bins.append(gap)
    return bins


def test_sum_of_squares_rule():
    rng = random.Random(5)
    for capacity in (7, 16):
        lengths = [rng.randint(1, capacity) for _ in range(60)]
        bins, offsets = packing.sum_of_squares(np.array(lengths), capacity)
        assert [capacity - o for o in offsets.tolist()] == literal_sum_of_squares(lengths, capacity)


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("group", [8192, 60])
def test_packing(spark, group):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(packing.token_pieces(docs, WORDS), group=group).collect()
    expected = []
    for d, ids in by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], WORDS, 1):
        for i in range(0, len(ids), 4096):
            x = ids[i : i + 4096]
            expected.append((d, i // 4096, i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    assert sorted(expected) == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    least = math.ceil(sum(e[3] for e in expected) / 4096)
    assert check_packing(rows, 4096) <= least + 2


def test_packing_edges(edge, empty):
    rows = packing.pack(packing.token_pieces(edge, WORDS, 64), 64).collect()
    assert len({r["doc_id"] for r in rows}) == 12 and check_packing(rows, 64)
    assert packing.pack(packing.token_pieces(empty, WORDS)).count() == 0


def png(w=2, h=2):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0\0" * h)) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\0\x01\0\x80\0\0" + bytes(6) + b"\x2c\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0\x3b"


def bitmap():
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 62, 0, 54, 40, 1, 2, 1, 24, 0, 8, 0, 0, 0, 0) + bytes(8)


def crc(data, bits, poly):
    c, top = 0, 1 << bits - 1
    for x in data:
        c ^= x << bits - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & (top << 1) - 1
    return c


def ogg(pages=3):
    out = b""
    for i in range(pages):
        body = bytes(range(i, i + 20))
        head = struct.pack("<4sBBqIII", b"OggS", 0, 2 * (i == 0) + 4 * (i == pages - 1), i, 7, i, 0) + bytes([1, len(body)])
        out += head[:22] + struct.pack("<I", crc(head + body, 32, 0x04C11DB7)) + head[26:] + body
    return out


def flac(frames=3):
    out = b"fLaC\x80\0\0\x22" + struct.pack(">HH", 16, 16) + bytes(6) + (44100 << 44 | 15 << 36 | 16 * frames).to_bytes(8, "big") + bytes(16)
    for i in range(frames):
        head = bytes([0xFF, 0xF8, 0x69, 0x08, i, 15])
        body = head + bytes([crc(head, 8, 0x07)]) + bytes([0, 0, i])
        out += body + struct.pack(">H", crc(body, 16, 0x8005))
    return out


def zipped():
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.txt", "text " * 50)
        z.writestr("PK.bin", b"PK\x05\x06" + bytes(18))  # looks like an end record
    return held.getvalue()


@pytest.mark.parametrize("kind, b", [("ogg", ogg()), ("flac", flac()), ("zip", zipped()), ("gzip", gzip.compress(b"words " * 99)), ("bmp", bitmap())])
def test_structure_decides_the_length(kind, b):
    """Media between junk and other media: found with its own length, and not found if any part is damaged."""
    for after in (b"", b" and more words", GIF, b):
        found = media.sniff(b"text " + b + after)
        assert found[0] == (kind, 5, len(b)) and [k for k, _, _ in found[1:]] == ({GIF: ["gif"], b: [kind]}.get(after, []))
    assert media.sniff(b[:-1]) == []
    for at in {"ogg": (10, 60), "flac": (44, 77), "bmp": (3, 15, 26), "gzip": (14, len(b) - 2), "zip": (len(b) - 4,)}[kind]:
        assert media.sniff(b[:at] + bytes([b[at] ^ 0x55]) + b[at + 1 :]) == []


def test_a_false_start_swallows_nothing():
    for start in (b"\x1f\x8b\x08\0 junk ", b"OggS\0\2 junk ", b"fLaC\0\0\0\x22 junk ", b"PK\x03\x04 junk ", b"BM junk ", b"BM" + struct.pack("<IIII", 60, 0, 54, 40) + bytes(42)):
        assert media.sniff(start + GIF + b" end") == [("gif", len(start), len(GIF))]


def test_sniffing():
    gif = b"GIF89a\x01\0\x01\0\x80\0\0" + bytes(6) + b"\x2c\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0\x3b"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x04ab\xff\xda\0\x02data\xff\0x\xff\xd9"
    bmp = bitmap()
    pdf = b"%PDF-1.4 x startxref 1 %%EOF"
    for kind, b in (("png", png()), ("gif", gif), ("jpeg", jpeg), ("bmp", bmp), ("pdf", pdf), ("wav", media.store_wav(b"abc"))):
        assert media.sniff(b"text " + b + b" more") == [(kind, 5, len(b))]
        assert media.sniff(b[:-3]) == [] or kind == "pdf"
    assert media.sniff(b"BM and GIF89a and RIFF in words, \xff\xd8\xff too") == []
    for n in (0, 1, 575, 576):
        assert media.read_wav(media.store_wav(bytes(n))) == bytes(n)


def test_media(edge, empty):
    texts = {r["doc_id"]: r["text"] for r in edge.collect()}
    rows = media.text_media(edge, keep=True).collect()
    assert len(rows) == 13
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        stored = bytes(r["media"])
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(stored))
        assert media.read_wav(stored) == payload and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
        assert r["feature"].startswith("type=audio/wav;")
    assert media.text_media(empty).count() == 0


def test_extract():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li>News</ul></nav><div class="cookie-notice">We use cookies</div>
    <div class=ad>Buy <b>now</b></div><main><article><header><h1>The &amp; title</h1></header><p>First&nbsp;one <i>in</i>
    two&#33;</p><p>Ok.<p><b>Open <br>bold<ul><li>item one<li>item two</ul><form>Mail <input></form><!-- no -->
    <p>Last &lt;tag&gt;.</p></article><section id="comments"><p>I disagree with everything that was said here.</p></section></main>
    <aside>More to read</aside><footer>&copy; 2024</footer></body></html>"""
    assert html.extract(page) == "The & title\nFirst one in two!\nOk.\nOpen bold\nitem one\nitem two\nLast <tag>."
    plain = "<div class=menu><a>x</a><a>y</a></div><div><p>" + "A long paragraph of text that is main. " * 5 + "</p><p>Short.</p></div>"
    assert html.extract(plain).endswith("\nShort.")
    for x in (None, "", "<", "<p", "<!--", "<article></article>", "</p></div>", "<script>"):
        assert html.extract(x) in ("", "<", "<p")
    assert html.extract("no tags at all") == "no tags at all"


LONG_TEXT = "<p>Some long text here that goes on for a while.</p><p>More of it, also long enough to count.</p>"
SHAPES = {
    "wrapper": f'<body><div class="layout with-sidebar"><div class=sidebar><a href=x>Home</a></div><div><h1>Title</h1>{LONG_TEXT}</div></div>',
    "named wrapper": f'<body><div class="sidebar-layout"><div class=sidebar><a href=x>Home</a></div><div><h1>Title</h1>{LONG_TEXT}</div></div>',
    "form": f'<body><form id=aspnetForm><div class=header><h2>Site</h2></div><div id=x><h1>Title</h1>{LONG_TEXT}</div><div class=footer>c 2020</div></form>',
    "nav never closed": f"<body><nav><ul><li><a href=x>Home</a><li><a>News</a></ul><div><h1>Title</h1>{LONG_TEXT}</div></body>",
    "entry header": f'<body><div class=post><div class="entry-header"><h1>Title</h1></div>{LONG_TEXT}</div><div class=footer>c 2020</div>',
    "teaser articles": f"<body><div id=x><h1>Title</h1>{LONG_TEXT}</div><article><a href=1>Teaser one</a></article><article><a href=2>Teaser two</a></article>",
    "articles of unequal length": f"<main><article><h1>Title</h1></article><article>{LONG_TEXT}</article></main>",
    "long comments": f"<body><h1>Title</h1>{LONG_TEXT}<section id=comments>{LONG_TEXT * 5}</section>",
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes_keep_their_text(shape):
    assert html.extract(SHAPES[shape]) == "Title\nSome long text here that goes on for a while.\nMore of it, also long enough to count."


def random_page(rng):
    """A tree of (tag, children) and texts: sections of long and short paragraphs, lists of links, short remarks."""
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "of", "to"])

    def text(n):
        return " ".join(word() for _ in range(n))

    def section(depth):
        kind = rng.random()
        if depth and kind < 0.3:
            return (rng.choice(["div", "section"]), [section(depth - 1) for _ in range(rng.randint(1, 4))])
        if kind < 0.65:
            return ("div", [("p", [text(rng.choice([2, 12, 30, 60]))]) for _ in range(rng.randint(1, 5))])
        if kind < 0.8:
            return ("ul", [("li", [("a", [text(rng.randint(1, 3))])]) for _ in range(rng.randint(1, 6))])
        return ("div", [("div", [text(rng.randint(1, 4))]) for _ in range(rng.randint(1, 3))])

    return ("body", [section(2) for _ in range(rng.randint(1, 6))])


def markup(node):
    return node if isinstance(node, str) else f"<{node[0]}>" + "".join(map(markup, node[1])) + f"</{node[0]}>"


def slow_extract(page):
    """The rules of extraction from the tree, line by line with plain loops, for pages of nothing named."""
    lines, state = [], {"tags": 0}

    def walk(node, path, linked):
        tag, children = node
        state["tags"] += 1
        for i, c in enumerate(children):
            if isinstance(c, str):
                lines.append([c, 0, len(c) if linked else 0, path])
            else:
                walk(c, path if c[0] == "a" else (*path, (i, c[0])), linked or c[0] == "a")
        state["tags"] += 1
        if lines and not lines[-1][1] and tag != "a":
            lines[-1][1], state["tags"] = state["tags"], 0

    walk(page, (), False)
    ratio = [(len(t) - linked) / tags for t, tags, linked, _ in lines]
    weight = lambda d: math.exp(-0.5 * d * d) if abs(d) <= 3 else 0.0
    n = range(len(ratio))
    smoothed = [sum(ratio[j] * weight(i - j) for j in n) / sum(weight(i - j) for j in n) for i in n]
    mean = sum(smoothed) / len(smoothed)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in smoothed) / len(smoothed))
    middle = sorted(smoothed)
    limit = min(deviation, (middle[len(middle) // 2] + middle[(len(middle) - 1) // 2]) / 2)
    content = [x >= limit - 1e-12 for x in smoothed]
    under = lambda p: [i for i in n if lines[i][3][: len(p)] == p]
    held = lambda p: sum(len(lines[i][0]) for i in under(p) if content[i])
    region = ()
    while True:
        inner = {lines[i][3][: len(region) + 1] for i in under(region)}
        inner = [p for p in inner if len(p) > len(region) and p[-1][1] in ("div", "section") and held(p) and held(p) >= 0.8 * held(region)]
        if not inner:
            break
        region = max(inner, key=held)
    if region:
        return "\n".join(lines[i][0] for i in under(region))
    out = []
    for i in n:
        text, _, linked, path = lines[i]
        part = path[:1] if path and path[0][1] in ("div", "section") else None
        if part is None:
            keep = 2 * linked < len(text)
        else:
            keep = any(content[j] for j in under(part)) and 2 * sum(lines[j][2] for j in under(part)) < sum(len(lines[j][0]) for j in under(part))
        if keep:
            out.append(text)
    return "\n".join(out) or "\n".join(t for t, _, _, _ in lines)


def test_regions_follow_the_smoothed_ratio(monkeypatch):
    """Pages without article, main or names: a slow version agrees, and without the smoothing pages differ."""
    rng = random.Random(4)
    pages = [random_page(rng) for _ in range(300)]
    got = [html.extract(markup(p)) for p in pages]
    assert got == [slow_extract(p) for p in pages]
    for other in (lambda ratio: ratio, lambda ratio: np.ones(len(ratio))):
        monkeypatch.setattr(html, "smooth", other)
        assert sum(html.extract(markup(p)) != x for p, x in zip(pages, got, strict=True)) > 20


def test_pages_empty_and_long(spark):
    many = "".join(f"<p>paragraph {i} of a very long page</p>" for i in range(20_000))
    df = spark.createDataFrame([(1, "u", f"<article>{many}</article>"), (2, "u", ""), (3, "u", "<div>" * 20_000 + "deep")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.extract_pages(df).collect()}
    assert got[1]["text"].count("\n") == 19_999 and got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] == "" and got[3]["text"] == "deep"
    assert html.extract_pages(df.limit(0)).count() == 0


def test_pages(spark):
    out = html.extract_pages(spark.createDataFrame([(1, "u", "<p>a  b</p>", 5), (None, None, None, None), (1, "u", "<p>a  b</p>", 5)], "page_id long, url string, html string, text int"))
    assert sorted(map(str, out.collect())) == sorted(["Row(page_id=None, url=None, text='', n_chars=0)"] + ["Row(page_id=1, url='u', text='a b', n_chars=3)"] * 2)


def neighbours_by_hand(vectors, queries_, k):
    out = []
    for q in queries_:
        d = sorted((math.sqrt(float(((np.array(v, float) - np.array(vectors[q], float)) ** 2).sum())), i) for i, v in vectors.items() if i != q)
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(d[:k])]
    return out


def test_neighbours_exact_when_all_leaves_are_visited(spark):
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=8).round(2).tolist() for i in range(300)}
    for i in range(40):
        vectors[300 + i] = vectors[5]  # one vector many times
    bad = [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [float("inf")] + [1.0] * 7), (904, [None] + [1.0] * 7), (905, [1.0]), (None, [1.0] * 8), (7, vectors[7])]
    df = spark.createDataFrame([*vectors.items(), *bad], "vec_id long, embedding array<double>").repartition(3)
    got = ann.search(df, df.where("vec_id % 10 = 5 or vec_id >= 900"), 10, ann.Options(leaf=16, slack=100.0, cap=50)).orderBy("query_id", "rank").collect()
    expected = neighbours_by_hand(vectors, [i for i in sorted(vectors) if i % 10 == 5], 10)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [e[:3] for e in expected]
    assert [r["score"] for r in got] == pytest.approx([e[3] for e in expected])


def test_neighbours_few_and_none(spark):
    df = spark.createDataFrame([(100, [1.0, 2.0]), (101, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.search(df, df.where("vec_id = 100")).collect()] == [(100, 101)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def clustered(rng, clusters, each, dim=16):
    centres = rng.normal(size=(clusters, dim)) * 10
    return (np.repeat(centres, each, axis=0) + rng.normal(size=(clusters * each, dim))).round(3)


def test_recall_with_less_than_half_of_the_leaves(spark):
    rng = np.random.default_rng(6)
    x = clustered(rng, 60, 60)
    o = ann.Options(sample=2500, leaf=64, probes=100)
    probes, fitted = x[::40], np.delete(x, np.s_[::40], axis=0)
    tree = ann.Tree(fitted[rng.permutation(len(fitted))[: o.sample]], o)
    assert ann.calibrate(tree, fitted, probes, 10, o) < tree.leaves / 2
    vectors = dict(enumerate(x.tolist()))
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(3)
    visited = []
    kept = ann.calibrate
    ann.calibrate = lambda t, *a: visited.append((kept(t, *a), t.leaves)) or visited[-1][0]
    try:
        rows = ann.search(df, df.where("vec_id % 30 = 0"), 10, o).collect()
    finally:
        ann.calibrate = kept
    assert visited[0][0] < visited[0][1] / 2
    exact = {(q, i) for q, _, i, _ in neighbours_by_hand(vectors, [i for i in vectors if i % 30 == 0], 10)}
    assert len(exact & {(r["query_id"], r["vec_id"]) for r in rows}) >= 0.9 * len(exact)


def test_sparse_leaves_give_all_neighbours(spark):
    """Outliers in a leaf of their own: visits go on until k + 1 vectors are held."""
    rng = np.random.default_rng(7)
    x = np.concatenate((clustered(rng, 40, 50), np.full((3, 16), 900.0) + rng.normal(size=(3, 16))))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    for o in (ann.Options(), ann.Options(leaf=32, recall=0.5)):
        rows = ann.search(df, df.where("vec_id >= 2000"), 10, o).collect()
        assert sorted((r["query_id"], r["rank"]) for r in rows) == [(q, n) for q in (2000, 2001, 2002) for n in range(1, 11)]


def test_passed_over_parts_hold_none_of_the_nearest():
    rng = np.random.default_rng(8)
    c, q, o = clustered(rng, 30, 40), clustered(rng, 30, 40)[::50], ann.Options(leaf=50)
    for rows in (c, rng.normal(size=(500, 16)), np.repeat(c[:2], 200, axis=0)):
        rough = ann.rough_squares(rows, q, 10, ann._parts(rows, o))
        exact = ((rows[None] - q[:, None]) ** 2).sum(axis=2)
        assert np.allclose(np.sort(rough, axis=1)[:, :11], np.sort(exact, axis=1)[:, :11])
    near = clustered(np.random.default_rng(8), 30, 40)[::50]
    assert np.isinf(ann.rough_squares(c, near, 10, ann._parts(c, o))).mean() > 0.5


def test_neighbours_of_other_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], i, "x", 0, None) for i in range(30)], "vec_id long, embedding array<double>, leaf int, v string, rank int, q string")
    got = ann.search(df, df.where("vec_id = 5"), 2).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 4), (2, 6)]


def test_recall(spark):
    rows = queries.op7_ann(spark, "/root/testdata/sf0.1").collect()
    e = {r["vec_id"]: r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()}
    exact = {(q, i) for q, _, i, _ in neighbours_by_hand(e, [i for i in e if i % 100 == 0], 10)}
    assert len(exact & {(r["query_id"], r["vec_id"]) for r in rows}) >= 0.9 * len(exact)
