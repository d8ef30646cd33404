"""Brute-force, round-trip, accuracy and edge-case tests of the training-data operators."""

import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import catalog, chat, common, embedding_dedup, html_layout, language, packing, quality, sentencepiece_bpe, simhash, topk, warc
from rasterloom.operators.components import connected_components

SF = "/root/testdata/sf0.001"
TEXT = "doc_id long, text string, lang string, source string, n_chars long"


def components(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def docs_of(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, TEXT).withColumn("fp", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("node", F.lit(2))


ODD = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "one"), (4, "one"), (None, "null id words here"), (5, "x" * 70000), (6, "a b c d e f " * 3000), (7, "a b c d e f " * 3000)]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    other = con.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(other.columns)
    assert sorted(map(tuple, got.select(*other.columns).collect())) == sorted(other.fetchall())


def test_components_of_paths_and_hubs(spark):
    rng = np.random.default_rng(0)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, int(k)) for k in rng.integers(200, 400, 150)] + [(5, 5), (9, 8), (8, 9)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    want = components(nodes, [p for p in pairs if p[0] != p[1]])
    assert set(got) == nodes
    assert len({(want[n], got[n]) for n in nodes}) == len(set(want.values())) == len(set(got.values()))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi <|im_end|> <\\|x <\\\\| |> <"), (1, 1, "assistant", None), (1, 1, "assistant", "é" * 20000), (2, None, "as\nsis\\ntant", ""), (2, 0, None, "<|im_start|>"), (None, 3, "assistant", "null"), (3, 5, "assistant", "b"), (3, 5, "assistant", "b")]
    df = spark.createDataFrame([(*r, 9, b"z") for r in rows], "conv_id long, turn long, role string, text string, n_turns int, formatted binary")
    out = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        raw = bytes(out[conv].formatted)
        assert chat.parse(raw) == own and out[conv].n_turns == len(own)
        spans = [chat.unescape(raw[s.start : s.start + s.length].decode()) for s in out[conv].loss]
        assert spans == [t for r, t in own if r == "assistant"]
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_quality_held_out(spark):
    scored = catalog.QUERIES["op2_quality"](spark, "/root/testdata/sf0.01").toPandas()
    both = scored.merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert all(bool(h) == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(scored.doc_id, scored.held_out))


def test_quality_edges(spark):
    rules = (0.3, [(((0, "<=", 0.5),), -1.0), (((1, ">", 2.0), (2, "<=", 0.9)), 0.7)])
    got = {(r.doc_id, r.text): r.score for r in quality.score(docs_of(spark, ODD).drop("score"), rules).collect()}
    for (_, text), s in got.items():
        x = np.array([quality.statistics(text)])
        z = rules[0] + sum(w * quality.holds(r, x)[0] for r, w in rules[1])
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-12
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(docs_of(spark, ODD), labels) == (0.0, [])
    kept = quality.quality_filter(docs_of(spark, ODD), labels)
    assert kept.columns == docs_of(spark, ODD).columns and [r.score for r in kept.collect()] == [1] * len(ODD)


def test_tree_travels_without_its_points():
    rng = np.random.default_rng(12)
    x = rng.integers(-500, 500, (700, 8))
    tree = topk.MTree(np.arange(700), x).finish()
    blob = __import__("pickle").dumps(tree, 5)
    again = __import__("pickle").loads(blob)
    assert (again.points == tree.points).all() and len(blob) < tree.points.nbytes + tree.x.nbytes
    for q in x[:30]:
        assert again.search(q, 10, None) == tree.search(q, 10, None)


def test_topk_edges(spark):
    rng = np.random.default_rng(1)
    vecs = [(i, [float(v) for v in rng.standard_normal(6)]) for i in range(400)] + [(400 + i, [0.25] * 6) for i in range(300)]
    vecs += [(700, None), (800, [float("nan")] * 6), (900, [None] + [1.0] * 5), (None, [1.0] * 6), (100, [0.1] * 6), (1000, [1.0, 2.0])]
    df = spark.createDataFrame([(*v, 1, 2) for v in vecs], "vec_id long, embedding array<float>, rank int, dim int")
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 100 = 0"), shard=90, block=3).collect()))
    fine = [(i, np.floor(1024 * np.array(np.array(v, np.float32), float)).astype(int)) for i, v in vecs if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, x in fine:
        if q % 100 == 0:
            best = sorted(((-int(x @ y), i) for i, y in fine if i != q and len(y) == len(x)))[:10]
            want.append((q, best))
    assert len({r[0] for r in got}) == len({q for q, b in want if b})
    for q, best in want:
        own = [(r[3], r[2]) for r in got if r[0] == q]
        if sum(w[0] == q for w in want) == 1:
            assert own == [(-s, i) for s, i in best]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def brute_simhash(rows, bits=2):
    fp = [(i, simhash.fingerprint(t)) for i, t in rows]
    nodes = sorted({f for _, f in fp})
    root = components(nodes, [(a, b) for k, a in enumerate(nodes) for b in nodes[k + 1 :] if (a ^ b).bit_count() <= bits])
    first = {}
    for i, f in fp:
        if i is not None:
            first[root[f]] = min(i, first.get(root[f], i))
    return sorted(((i, f, first.get(root[f])) for i, f in fp), key=repr)


def test_simhash_edges_and_groups(spark):
    rng = np.random.default_rng(2)
    base = " ".join(f"w{k}" for k in rng.integers(0, 50, 200))
    near = [(100 + i, base.replace(f"w{i % 50}", "zz", 1)) for i in range(120)]
    rows = ODD + near + [(300 + i, base) for i in range(30)]
    got = simhash.near_duplicates(docs_of(spark, rows))
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got.collect()), key=repr) == brute_simhash(rows)
    kept = [r.doc_id for r in simhash.deduplicate(docs_of(spark, rows)).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == {c for _, _, c in brute_simhash(rows)}
    assert simhash.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


def test_dedup_keeps_one_row_of_each_component_whatever_the_ids(spark):
    words = lambda seed: " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, 10**6, 60))
    rows = [(None, words(0)), (None, words(1)), (None, words(1)), (5, words(2)), (5, words(3)), (3, words(3)), (7, words(4)), (7, words(5)), (9, words(5)), (None, words(5))]
    for given in (rows, rows[::-1]):
        kept = simhash.deduplicate(docs_of(spark, given))
        assert kept.columns == docs_of(spark, given).columns
        want = [(None, words(0)), (None, words(1)), (5, words(2)), (3, words(3)), (7, words(4)), (7, words(5))]
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    near = spark.createDataFrame([(1, words(6), {"k": "b"}), (1, words(6), {"k": "a"}), (1, words(7), {"k": "a"})], "doc_id long, text string, tags map<string,string>")
    assert len({tuple(r.tags.items()) for _ in range(2) for r in simhash.deduplicate(near.repartition(3)).collect() if r.text == words(6)}) == 1
    assert simhash.deduplicate(near).count() == 2


def test_simhash_links_with_small_blocks(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 3)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 4), False)) for c in centre for _ in range(150)})
    df = common.cut(spark.createDataFrame([(f,) for f in fps], "fp long"), "t")
    for bits in (0, 1, 2, 3):
        roots = {r.node: r.root for r in connected_components(simhash.links(df, bits, block=16)).collect()}
        want = components(fps, [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= bits])
        got = {f: roots.get(f, f) for f in fps}
        assert len({(want[f], got[f]) for f in fps}) == len(set(want.values())) == len(set(got.values()))


def test_simhash_hot_buckets_meet_at_common_neighbours(spark, monkeypatch):
    """Buckets of far more blocks than a fingerprint has neighbours, beside small ones; signs and the free top bit included."""
    rng = np.random.default_rng(5)
    low, top = (1 << 62) + 12345, -(1 << 63) + 99
    near = {int(low) ^ sum(1 << int(b) for b in rng.choice(40, rng.integers(0, 7), False)) for _ in range(900)}
    wide = {top ^ sum(1 << int(b) for b in rng.choice(62, 3, False)) for _ in range(60)} | {0, -1, -(1 << 63)}
    fps = sorted(near | wide)
    df = common.cut(spark.createDataFrame([(f,) for f in fps], "fp long"), "t")
    called = []
    monkeypatch.setattr(simhash, "plan_masks", lambda *a: called.append(a) or [-1 << 42, (1 << 21) - 1, ((1 << 21) - 1) << 21])
    edges = [tuple(r) for r in simhash.links(df, 2, block=4).collect()]
    word = (1 << 64) - 1
    far = lambda a, b: ((a ^ b) & word).bit_count()
    assert called and all(far(a, b) <= 2 for a, b in edges)
    got = components(fps, edges)
    want = components(fps, [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if far(a, b) <= 2])
    assert {f: got[f] for f in fps} == want and len(set(want.values())) > 3


def test_candidate_estimates():
    rng = np.random.default_rng(9)
    v = np.append(rng.integers(0, 1 << 12, 600), [5, 5, 7]).astype(np.uint64)
    want = np.zeros(3)
    for i in range(len(v)):
        for d in np.bitwise_count(v[i + 1 :] ^ v[i]):
            want[d : d + 1] += 1
    assert simhash.distances(v, 2).tolist() == want.tolist() and simhash.distances(v[:0], 2).tolist() == [0, 0, 0]
    assert np.allclose(simhash.independent(np.full(10, 0.5), 2), np.array([1, 10, 45]) / 1024)


def test_masks_follow_the_number_of_fingerprints(spark, monkeypatch):
    """Few fingerprints: few wide probes; so many that chance pairs dominate: narrow ones. Every plan finds all pairs."""
    rng = np.random.default_rng(10)
    df = common.cut(spark.createDataFrame([(int(f),) for f in rng.integers(0, 1 << 63, 3000)], "fp long"), "m")
    n, ones = simhash.bit_statistics(df)
    free = []
    for times in (1, 1 << 22):
        monkeypatch.setattr(simhash, "bit_statistics", lambda _, k=times: (n * k, ones * k))
        masks = simhash.plan_masks(df)
        free.append(np.mean([64 - (m & (1 << 64) - 1).bit_count() for m in masks]))
        for _ in range(300):
            flip = sum(1 << int(b) for b in rng.choice(64, 2, False))
            assert any(not m & (flip - (1 << 64) if flip >= 1 << 63 else flip) for m in masks)
    assert free[0] > free[1]


def test_threshold_allocation():
    rng = np.random.default_rng(4)
    costs = rng.random((3, 4))
    best = min(sum(costs[i, t + 1] for i, t in enumerate(ts)) for ts in __import__("itertools").product(range(-1, 3), repeat=3) if sum(ts) == 0)
    assert abs(simhash.allocate(costs, 0)[0] - best) < 1e-12


def test_embedding_links(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((4, 16))
    x = [centre[i % 4] + 0.08 * rng.standard_normal(16) for i in range(240)] + list(rng.standard_normal((60, 16))) + [centre[0]] * 50
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [None] * 16), (505, [1.0, 2.0]), (505, [2.0, 4.0])]
    df = spark.createDataFrame([(*r, 1, 7) for r in rows], "vec_id long, embedding array<float>, n int, kept int")
    got = embedding_dedup.near_duplicates(df, block=32).toPandas()
    v = np.array([np.float32(r) for _, r in rows[: len(x)]], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    link = v @ v.T >= 0.95
    np.fill_diagonal(link, False)
    own = got[got.vec_id < 500].sort_values("vec_id")
    assert (own.n_links.to_numpy() <= link.sum(1)).all() and own.n_links.sum() >= 0.95 * link.sum()
    root = components(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(link))])
    assert (own.component_id.to_numpy() == [root[i] for i in range(len(x))]).mean() > 0.99
    rest = got[got.vec_id >= 500]
    assert (rest.component_id == rest.vec_id).all() and rest.n_links.tolist().count(0) == 5 and rest.n_links.tolist().count(1) == 2
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_sentencepiece_equals_library(spark):
    model = sentencepiece_bpe.PieceModel(common.tokenizer_path(sentencepiece_bpe.MODEL))
    enc, dec = sentencepiece_bpe.Encoder(model, remembered=50), sentencepiece_bpe.Decoder(model)
    rng = np.random.default_rng(6)
    parts = ["a", "th", "e", " ", "  ", "\n", "\0", "é", "<s>", "'", "1", "▁", "   ", "x ", "𝒳", "ción", "--", "\r\n", "aaaa", "梦", "�"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 20))) for _ in range(1500)] + ["", " " * 200, "word" * 3000] + [" " * n + "the" for n in range(40)]
    for t in texts:
        ids = enc.encode(t)
        assert ids.tolist() == model.lib.encode(t)
        assert dec.decode(ids) == model.lib.decode(ids.tolist())
    for _ in range(500):
        ids = rng.integers(0, 400, rng.integers(0, 8))
        assert dec.decode(ids) == model.lib.decode(ids.tolist())
    frame = docs_of(spark, ODD)
    for r in sentencepiece_bpe.round_trip_digests(frame).collect():
        assert r.n_tokens is not None and len(r.ids_sha256) == 64
    coded = sentencepiece_bpe.encode_documents(frame)
    back = sorted((r.doc_id or -1, r.text) for r in sentencepiece_bpe.decode_documents(coded).collect())
    assert back == sorted((i or -1, t or "") for i, t in ODD)


def test_packing_plan_against_exact():
    def fewest(items, cap):
        items = sorted(items, reverse=True)
        best = [len(items)]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for room in set(bins):
                if items[i] <= room:
                    rest = list(bins)
                    rest.remove(room)
                    place(i + 1, rest + [room - items[i]])
            place(i + 1, bins + [cap - items[i]])

        place(0, [])
        return best[0]

    rng, lost = np.random.default_rng(7), 0
    for _ in range(150):
        cap = int(rng.integers(8, 30))
        items = rng.integers(1, cap + 1, rng.integers(0, 9)).tolist()
        counts = defaultdict(int)
        for i in items:
            counts[i] += 1
        used, bins = defaultdict(int), 0
        for held, n in packing.plan(counts, cap):
            assert sum(held) <= cap
            bins += n
            for h in held:
                used[h] += n
        assert dict(used) == dict(counts)
        lost += bins - fewest(items, cap)
    assert lost <= 2


def test_packing_plan_of_very_many():
    rng = np.random.default_rng(11)
    counts = {int(k): int(n) for k, n in zip(range(1, 2049), rng.integers(0, 10**8, 2048))}
    used = defaultdict(int)
    for held, n in packing.plan(counts):
        assert sum(held) <= 2048
        for h in held:
            used[h] += n
    assert {k: v for k, v in used.items() if v} == {k: v for k, v in counts.items() if v}


def test_packing_of_a_hot_length_and_repeated_rows(spark):
    rows = [(None, "same")] * 900 + [(1, "same")] * 900 + [(k, "other words") for k in range(200)]
    cut = common.cut(packing.pieces(docs_of(spark, rows)), "p")
    out = packing.pack(cut, ranked_rows=16).toPandas()
    places = set(zip(out.sequence_id, out.offset))
    assert len(out) == len(rows) == len(places)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048


def test_packing_rows(spark):
    coder = packing.ByteTokenizer(common.tokenizer_path(packing.MODEL))
    rows = ODD + [(20 + i, "some words " * (40 * i)) for i in range(60)] + [(90, "<|endoftext|> x")]
    out = packing.pack_documents(docs_of(spark, rows), with_ids=True).toPandas()
    whole = defaultdict(list)
    for r in out.sort_values(["doc_id", "piece"]).itertuples():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 2048
        whole[r.doc_id].append((r.start, list(r.ids)))
    for i, t in rows:
        if i is None or i == 4:
            continue
        ids = coder.lib.encode(t or "", add_special_tokens=False).ids + [0]
        got = sorted(whole[i])
        assert sum((p for _, p in got), []) == ids
        assert all(len(p) == 2048 for _, p in got[1:])
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert len(out) == sum(-(-(len(coder.encode(t or "")) // 4 + 1) // 2048) for _, t in rows)
    assert packing.pack_documents(docs_of(spark, rows).limit(0)).count() == 0


def test_ranks_give_the_same_ids():
    fast = packing.ByteTokenizer(common.tokenizer_path(packing.MODEL), common.tokenizer_path(packing.RANKS))
    slow = packing.ByteTokenizer(common.tokenizer_path(packing.MODEL))
    rng = np.random.default_rng(8)
    parts = ["a", "the", " ", "  ", "\n", "\t", "\0", "é", "<|endoftext|>", "'s", "12", "!", " \n", "　", "𝒳", "Ⅷ", "\x85"]
    for _ in range(2000):
        t = "".join(rng.choice(parts, rng.integers(0, 15)))
        assert fast.encode(t) == slow.encode(t)


def test_very_long_white_space():
    fast = packing.ByteTokenizer(common.tokenizer_path(packing.MODEL), common.tokenizer_path(packing.RANKS))
    for t in (" " * 1_200_000, "a" + "\n" * 1_200_000 + "b", "x" * 200_000, "\u3000" * 150_000):
        assert fast.encode(t) == np.array(fast.lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_quality_sample_bounds_repeated_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"some words {k}") for k in range(50)] + [(2, "others")], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(y)))
    quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int"), sample=20)
    assert 0 < seen[0] <= 20


@pytest.mark.parametrize("part", ["<a ", "<", "<html ", "</script ", "<a \"", "<title ", "<!-- ", "<p href "])
def test_unclosed_markup_is_linear(part):
    for page in (part * 100_000, part * 100_000 + ">", "<script>" + part * 100_000):
        html_layout.render(page), warc.plain_text(page), warc.title_of(page), warc.links_of(page), language.HIDDEN.sub(" ", page), language.DECLARED.search(page)


def test_links_and_wide_cells():
    page = "<a class=\"src=x\" data-src='no' href = 'p>q'>t</a><IMG SRC=i.png><a name=href>u</a><script src=\"s.js\"></script><a HREF"
    assert warc.links_of(page) == [("p>q", "a", "href"), ("i.png", "img", "src"), ("s.js", "script", "src")]
    wide = "w " * 5000 + "end"
    text = html_layout.render("<table><tr><td>" + wide + "<td>x" + "<tr><td>a<td>b" * 1000 + "</table>")
    assert text.splitlines()[0] == wide + "  x" and text.splitlines()[1:] == ["a  b"] * 1000


def test_text_behind_empty_svg_and_hyphenated_elements():
    for page in ("<svg class='i'/>seen", "<svg/>seen", "<SVG title=\"a>b\" />seen", "<svg><title>no</title></svg>seen", "<svg a='/'>no</svg>seen", "<svg/><svg>no</svg>seen<svg />"):
        assert warc.plain_text(page) == html_layout.render(page).replace("no", "") == "seen"
    for name in ("title-bar", "template-x", "style-guide", "script-note", "noscript-x", "svg-icon"):
        page = f"<{name} lang=x>own</{name}><p>seen"
        assert warc.plain_text(page).split() == ["own", "seen"] and language.HIDDEN.sub(" ", page).split() == ["own", "seen"]
    assert warc.title_of("<title-bar>no</title-bar><title>yes</title>") == "yes"
    assert warc.links_of("<a-b href=no><link-card href=no><a href=yes>") == [("yes", "a", "href")]
    for part in ("<svg ", "<svg \"", "<svg \"</svg>\"", "<svg '/>"):
        warc.plain_text(part * 100_000)


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x", "<title>T &amp; u</title><p>Hi<script>no</script> <a href='/y'>there</a>", 5), (2, None, None, 6), (2, None, None, 6), (3, "http://b.example", "", 7)], "page_id long, url string, html string, type int")
    records = warc.responses(pages)
    out = warc.derivatives(records).collect()
    assert len(out) == 8
    sources = {(h := warc.parse(bytes(r.record))[0])[0]["WARC-Record-ID"]: h for r in records.collect()}
    assert len(sources) == 4 and len({r.record_id for r in out}) == 8
    for r in out:
        head, block = sources[r.refers_to]
        assert r.target_uri == head.get("WARC-Target-URI")
        assert r.block_digest == warc.sha1(r.block.encode()) and r.source_payload_digest == head["WARC-Payload-Digest"]
        assert {o.record_id for o in out if o.refers_to == r.refers_to and o.type != r.type} == {r.concurrent_to}
    first = {r.type: r.block for r in out if r.page_id == 1}
    assert first["conversion"] == "Hi there"
    assert "title: T & u\r\n" in first["metadata"] and "outlink: /y a/@href" in first["metadata"] and "source-content-type: text/html" in first["metadata"]
    written = b"".join(bytes(r.record) for r in warc.serialised(warc.derivatives(records)).where("page_id = 1").collect())
    assert sorted(h["WARC-Type"] for h, _ in warc.parse(written)) == ["conversion", "metadata"]
    assert warc.derivatives(records.limit(0)).count() == 0
    assert warc.plain_text("a" + "<!-- " * 20000) == warc.plain_text("a" + "<svg> " * 20000) == "a" and warc.title_of("<title>t" * 20000).startswith("t<title>t")


def test_language(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    model = language.fit_text_model(docs)
    got = language.identify(docs, model, "doc_id", "text", "lang", "source").toPandas()
    assert (got.lang == got.declared).mean() > 0.98 and got.rejected.mean() < 0.01
    odd = language.identify(docs_of(spark, [*ODD, (50, "12345 67890"), (51, "el perro y la casa de los niños")]), model, "doc_id", "text").toPandas().set_index("id")
    assert odd.loc[[0, 1, 2, 50], "rejected"].all() and not odd.loc[51, "rejected"]
    assert language.language_filter(docs.limit(0)).count() == 0
    late = spark.createDataFrame([(1, "<!doctype html>" + " " * 9000 + "<HTML class=x LANG=es>"), (2, "<!-- <b> " * 20000), (3, "<script> " * 20000)], "page_id long, html string")
    assert {r.id: r.declared for r in language.identify(late, model, "page_id", "html", markup=True).collect()} == {1: "es", 2: None, 3: None}
    pages = spark.createDataFrame([(1, "http://h.example.es/", "<html lang='es'><p>zz", 1)] * 2 + [(2, None, None, 1)], "page_id long, url string, html string, host int")
    rows = language.identify(pages, model, "page_id", "html", None, "url", True).collect()
    assert len(rows) == 3 and {r.host for r in rows} == {"h.example.es", None}


def test_every_label_is_modelled(spark):
    rng = np.random.default_rng(14)
    words = {f"l{k:02d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for k in range(90)}
    rows = [(k, " ".join(rng.choice(words[lang], 30)), lang, "s") for k, lang in enumerate([lang for n, lang in enumerate(words) for _ in range(4 if n < 80 else 2)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.fit_text_model(docs)
    assert model.langs == sorted(words)
    got = {r.id: r for r in language.identify(docs, model, "doc_id", "text", "lang", "source").collect()}
    assert all(got[i].lang == lang and not got[i].rejected for i, _, lang, _ in rows)
    assert language.language_filter(docs).count() == len(rows)


@pytest.mark.parametrize("ids", [1, 7, 3000])
def test_labelled_sample_is_the_first_by_hash(spark, ids):
    docs = spark.createDataFrame([(k % ids, f"t{k % ids}", "ab"[k % 3 == 0]) for k in range(3000)] + [(k, "few", "C") for k in range(5)], "doc_id long, text string, lang string")
    got = language.labelled_sample(docs, "text", "lang", "doc_id", 40).toPandas()
    want = docs.select("lang", "text", F.xxhash64("doc_id").alias("h")).toPandas().sort_values("h", kind="stable").groupby("lang").head(40)
    assert sorted(zip(got.lang, got.text)) == sorted(zip(want.lang.str.lower(), want.text))


def test_fusion_against_plain_loops(spark):
    pages = common.table(spark, SF, "pages")
    model = language.fit_text_model(common.table(spark, SF, "documents"))
    got = {r.id: r for r in language.identify(pages, model, "page_id", "html", None, "url", True).collect()}
    rows = []
    for p in pages.collect():
        found = language.DECLARED.search(p.html)
        ll, n = model.evidence(language.HIDDEN.sub(" ", p.html))
        w = np.exp(ll - ll.max())
        rows.append((p.page_id, found and found[1].lower(), language.host_parts(p.url), n, ll, w / w.sum()))
    sums = defaultdict(lambda: np.zeros(len(model.langs)))
    for _, said, hosts, n, _, post in rows:
        if n >= language.LEAST_LETTERS:
            for k in [("d", said), ("all",), *zip("hms", hosts)]:
                sums[k] += post
    kinds = lambda c: max(1, sum(k[0] == c and k[1] is not None for k in sums if len(k) == 2))
    said_all = sum((v for k, v in sums.items() if k[0] == "d" and k[1]), np.zeros(len(model.langs)))
    kinds_d, kinds_s = kinds("d"), kinds("s")
    for i, said, (h, m, s), n, ll, post in rows:
        own = post * (n >= language.LEAST_LETTERS)  # a row's own text is no evidence about it
        others = lambda *k: np.maximum(sums[k] - own, 0)
        prior = (others("all") + 1) / (others("all") + 1).sum()
        for k in (("s", s), ("m", m), ("h", h)):
            prior = (others(*k) + language.KAPPA * prior) / (others(*k).sum() + language.KAPPA)
        logp = ll + np.log(prior) + np.log((others("s", s) + 0.5) / (others("all") + 0.5 * (kinds_s + 1)))
        if said:
            logp = logp + np.log((others("d", said) + 0.5) / (np.maximum(said_all - own, 0) + 0.5 * (kinds_d + 1)))
        w = np.exp(logp - logp.max())
        assert abs(w.max() / w.sum() - got[i].posterior) < 1e-5
        assert got[i].rejected or got[i].lang == model.langs[int(w.argmax())]


def test_evidence_grows_evenly_with_length():
    model = language.TextModel(["a", "b"], np.arange(language.GRAMS), np.zeros(language.GRAMS, int), np.ones(language.GRAMS))
    gaps = [float(np.ptp(model.evidence("ab " * n)[0])) for n in (130, 132, 133, 134, 135, 140, 10**5)]
    assert all(x < y for x, y in zip(gaps, gaps[1:])) and np.ptp(np.diff(gaps[1:5])) < 0.05 * np.diff(gaps[1:5]).mean()


HTML = [
    ("<p>a<p>b", "a\n\nb"), ("<ul><li>x<li>y</ul>", "- x\n- y"), ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"), ("a<br>b<!-- no -->c", "a\nbc"),
    ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"), ("<div hidden>x</div><span style='display: none'>y</span>z", "z"),
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>", "b"), ("<pre>\n a\n  b</pre>", " a\n  b"), ("a &lt; b &amp;amp; c", "a < b &amp; c"),
    ("<head><title>t</title></head><body>x", "x"), ("<script>if (a<b) '</p>'</script>q", "q"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("", ""), (None, ""),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"), ("<b>bold</b> <i>it</i>", "bold it"), ("<div>" * 5000 + "deep", "deep"), ("<table><tr><td colspan=x>k</table>", "k"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<h1>H</h1>text<hr>more", "H\n\ntext\n\nmore"), ("<p>un<closed <b>x", "un"),
]


def test_rowspan_keeps_columns():
    render = html_layout.render
    assert render("<table><tr><th>k<th>a<th>b<tr><td rowspan=2>one<td>1<td>2<tr><td>3<td>4<tr><td>two<td>5<td>6</table>") == "k    a  b\none  1  2\n     3  4\ntwo  5  6"
    assert render("<table><tr><td>a<td rowspan=2 colspan=2>bb<td>c<tr><td>d<td>e</table>") == "a  bb  c\nd      e"
    assert render("<table><tbody><tr><td rowspan=0>aa<td>b<tr><td>c<tbody><tr><td>d<td>e</table>") == "aa  b\n    c\nd   e"
    many = render("<table><tr>" + "<td rowspan=60000>a" * 5000 + "<tr><td>b" * 5000 + "</table>")
    assert len(many) < 100_000 and many.count("a") == many.count("b") == 5000


FOREIGN = [
    ("<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>tex</annotation></semantics></math> holds", "so x=1 holds"),
    ("<math><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd><mn>3</mn></mtd></mtr></mtable></math>", "1 2\n3"),
    ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><metadata>no</metadata><symbol><text>no</text></symbol><g><text>A <tspan>b</tspan></text><text>C</text></g></svg>", "A b\nC"),
    ("<svg><defs/><rect/><text>A</text></svg>b", "A\nb"), ("<svg><text display='none'>no</text><g visibility='hidden'><text>no</text><text visibility='visible'>yes</text></g></svg>", "yes"),
    ("<svg><foreignObject><p>in<div/>side</foreignObject></svg>", "in\n\nside"), ("<svg><defs><p>out", "out"), ("<map name=m><p>way <area href=x>in</p></map>", "way in"),
    ("<desc>seen</desc> <symbol>too</symbol>", "seen too"), ("<svg style='display:none'><text>no</text></svg>x", "x"), ("<svg class=i />a<svg/>b", "ab"), ("<math><mphantom><mi>n</mi></mphantom><mtext>a <b>b</b></mtext></math>", "a b"),
]


@pytest.mark.parametrize("source,text", FOREIGN)
def test_html_math_svg_and_map(source, text):
    assert html_layout.render(source) == text


@pytest.mark.parametrize("source,text", HTML)
def test_html(source, text):
    assert html_layout.render(source).startswith(text) if source and "closed" in source else html_layout.render(source) == text


def test_html_table(spark):
    df = spark.createDataFrame([(i, s, "c") for i, (s, _) in enumerate(HTML)], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in html_layout.extract(df).collect()}
    assert got == {i: html_layout.render(s) for i, (s, _) in enumerate(HTML)}
    words = lambda s: re.findall(r"\w+", s)
    for r in common.table(spark, SF, "pages").limit(50).collect():
        assert words(html_layout.render(r.html)) == words(re.sub(r"<[^>]*>", " ", re.sub(r"(?s)<head.*?</head>|<!--.*?-->", " ", r.html)).replace("&amp;", "&").replace("&copy;", "©").replace("&middot;", "·"))


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    labels = common.table(spark, SF, "labels")
    for name, stage in p.STAGES[:-1]:
        out = common.cut(stage(spark, docs, SF), name)
        assert out.columns == columns
        before, after = docs.toPandas(), out.toPandas()
        if name == "language":
            model = language.fit_text_model(docs)
            bad = {r.id for r in language.identify(docs, model, "doc_id", "text", "lang", "source").where("rejected").collect()}
            assert set(after.doc_id) == set(before.doc_id) - bad
        if name == "quality":
            intercept, rules = quality.train(docs, labels)
            x = np.array([quality.statistics(t) for t in before.text])
            z = np.full(len(x), intercept) + sum(w * quality.holds(r, x) for r, w in rules)
            assert set(after.doc_id) == set(before.doc_id[z >= 0])
        if name == "simhash":
            assert set(after.doc_id) == {c for _, _, c in brute_simhash(list(zip(before.doc_id, before.text)))}
        docs = out
    packed = p.run(spark, SF).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all()




def test_embedding_recall_near_the_threshold(spark):
    """64 dimensions, planted pairs of cosine 0.95 to 0.96 among unrelated vectors, and one tight group; against all pairs."""
    rng = np.random.default_rng(15)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    a = unit(rng.standard_normal((1500, 64)))
    away = unit((w := rng.standard_normal((1500, 64))) - (w * a).sum(1)[:, None] * a)
    cos = rng.uniform(0.9501, 0.96, 1500)[:, None]
    x = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * away, unit(a[:1] + 0.01 * rng.standard_normal((700, 64)))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embedding_dedup.near_duplicates(df, block=256, mates=16).toPandas().sort_values("vec_id")
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    assert (got.n_links.to_numpy() <= link.sum(1)).all() and got.n_links.sum() >= 0.999 * link.sum()
    assert got.n_links.to_numpy()[1500:3000].astype(bool).mean() >= 0.98
    root = components(range(len(x)), [(int(i), int(j)) for i, j in zip(*np.nonzero(link))])
    assert (got.component_id.to_numpy() == [root[i] for i in range(len(x))]).mean() > 0.97
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_embedding_sql_on_planted_links(spark, tmp_path):
    """The SQL compares all pairs; links here lie clear of the threshold, so hashing must find every one."""
    rng = np.random.default_rng(21)
    centres = rng.standard_normal((6, 64))
    x = [c + rng.standard_normal(64) * 0.12 for c in centres for _ in range(12)] + list(rng.standard_normal((80, 64))) + [centres[0]] * 5
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 64), (502, [float("nan")] * 64), (503, [1.0, None]), (504, []), (505, [1.0, 2.0]), (506, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(embedding_dedup.OP5_SQL).fetchall())
    got = sorted(map(tuple, embedding_dedup.op5_embedding_dedup(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == want and sum(r[1] for r in want) > 700


def test_embedding_plan_holds_recall():
    for n in (1, 600, 10**5, 10**9):
        tables, k = embedding_dedup.plan_tables(n)
        assert 1 - (1 - embedding_dedup.same_cell(0.1**0.5, embedding_dedup.WIDTH) ** k) ** tables >= embedding_dedup.RECALL
    x = np.random.default_rng(0).standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    whole = embedding_dedup.keys_of(x, 9, 7, 2.0, 1)
    assert all((embedding_dedup.keys_of(x[i : i + 1], 9, 7, 2.0, 1) == whole[i]).all() for i in range(300))


def test_topk_prunes_cells_and_keeps_queries_of_one_id_apart(spark):
    rng = np.random.default_rng(16)
    centres = rng.normal(0, 1, (40, 16))
    x = centres[rng.integers(0, 40, 3000)] + 0.01 * rng.standard_normal((3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(int(i), x[j].tolist()) for i, j in [(0, 0), (0, 7), (0, 7), (100, 100), (9999, 5)]], df.schema)
    got = topk.top_k(df, asked, shard=60, block=2, pivots=50).toPandas()
    v = np.floor(1024 * x).astype(int)
    assert len(got) == 4 * 10 and set(got["rank"]) == set(range(1, 11))
    for i, j in [(0, 0), (0, 7), (100, 100), (9999, 5)]:
        best = sorted((-int(v[j] @ v[c]), c) for c in range(3000) if c != i)[:10]
        rows = set(zip(got[got.query_id == i]["rank"], got[got.query_id == i].vec_id, got[got.query_id == i].score))
        assert {(r + 1, c, -s) for r, (s, c) in enumerate(best)} <= rows
    tree = topk.MTree(np.arange(3000), v, page=64).finish()
    for q in range(0, 3000, 50):
        tree.search(v[q], 10, q)
    assert tree.scored < 0.2 * 60 * 3000


def test_topk_of_large_and_empty_vectors(spark):
    df = spark.createDataFrame([(1, [1e300, 1.0]), (2, [40.0, 50.0]), (3, [-1.0, 2.0]), (4, []), (5, []), (6, [3e4, -3e4])], "vec_id long, embedding array<double>")
    got = topk.top_k(df.where("vec_id <> 1"), df.where("vec_id in (2, 4)")).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == [(2, 3, 1024**2 * 60), (2, 6, 1024**2 * -300000), (4, 5, 0)]


def http_record(payload, *http, kind="response", name="<urn:a>", length=None):
    block = b"HTTP/1.1 200 OK\r\n" + b"".join(h + b"\r\n" for h in http) + b"\r\n" + payload
    head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-RECORD-ID: {name}\r\nWARC-Target-URI: http://x/\r\n folded\r\nContent-length: {len(block) if length is None else length}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_warc_codings_and_repeated_headers():
    import gzip

    page = "<title>t</title><p>Grüße".encode()
    chunked = b"".join(b"%x;a=b\r\n" % len(c) + c + b"\r\n" for c in (page[:5], page[5:])) + b"0\r\n\r\n"
    cases = [(page, []), (gzip.compress(page), [b"Content-Encoding: gzip"]), (page, [b"content-encoding: gzip"]), (zlib.compress(page), [b"Content-Encoding: deflate"]), (zlib.compress(page)[2:-4], [b"Content-Encoding: deflate"]), (chunked, [b"Transfer-Encoding: chunked"]), (page, [b"Transfer-Encoding: chunked"])]
    packed = gzip.compress(page)
    cases.append((b"%X\r\n" % len(packed) + packed + b"\r\n0\r\n\r\n", [b"Content-Encoding: gzip", b"Transfer-Encoding: chunked"]))
    for payload, coding in cases:
        rows = {r[1]: r for r in warc.rows_of(1, http_record(payload, b"Content-Type: text/html; charset=utf-8", b"Set-Cookie: a=1", b"Set-Cookie: b=2", *coding))}
        assert rows["conversion"][11] == "Grüße" and rows["conversion"][4] == "http://x/ folded"
        lines = rows["metadata"][11].split("\r\n")
        assert "source-set-cookie: a=1" in lines and "source-set-cookie: b=2" in lines and "title: t" in lines
        assert rows["metadata"][10] == warc.sha1(payload) and not any("not-decoded" in x for x in lines)
    for payload, coding in ((packed[:-12], b"gzip"), (b"..", b"br")):
        rows = {r[1]: r for r in warc.rows_of(1, http_record(payload, b"Content-Encoding: " + coding))}
        assert "source-not-decoded" in rows["metadata"][11] and rows["metadata"][3] == "<urn:a>"


def test_warc_malformed_records_become_error_rows(spark):
    good = http_record(b"<p>seen")
    cases = [(good, 0), (b"rubbish", 1), (good[:-20], 1), (b"WARC/1.0\r\nWARC-Type: response\r\n\r\n" + b"x\r\n\r\n" + good, 1), (b"..\r\n\r\n" + good, 1), (http_record(b"", length="x") + good, 1), (http_record(b"", kind=""), 1), (http_record(b"", kind="warcinfo"), 0), (warc.gzip.compress(good) + warc.gzip.compress(good)[:-15], 2), (warc.gzip.compress(good)[:10] + b"????", 1), (b"", 0), (None, 0)]
    df = spark.createDataFrame([(i, c and bytearray(c), "t") for i, (c, _) in enumerate(cases)], "page_id long, record binary, type string")
    out = warc.derivatives(df).collect()
    for i, (_, errors) in enumerate(cases):
        assert sum(r.type == "error" for r in out if r.page_id == i) == errors
    assert {i: sum(r.type == "conversion" and r.block == "seen" for r in out if r.page_id == i) for i in (0, 3, 4, 5, 8)} == {0: 1, 3: 1, 4: 1, 5: 1, 8: 1}
    assert warc.serialised(warc.derivatives(df)).count() == sum(r.type != "error" for r in out)


@pytest.mark.parametrize("packed", [False, True])
def test_warc_files_are_read_by_record(spark, tmp_path, packed):
    pages = [f"<p>page {k}" + ("\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n<p>no record" if k % 7 == 3 else "") + "\r\n" * (k % 5) for k in range(60)]
    records = [warc.serialise(*warc.response(f"http://x/{k}", p, k), packed) for k, p in enumerate(pages)]
    for half in (0, 1):
        (tmp_path / f"f{half}.warc{'.gz' if packed else ''}").write_bytes(b"".join(records[half::2]))
    got = warc.read_warc(spark, str(tmp_path))
    assert got.count() == 60
    text = {r.target_uri: r.block for r in warc.derivatives(got).where("type = 'conversion'").collect()}
    assert text == {f"http://x/{k}": warc.plain_text(p) for k, p in enumerate(pages)}


def test_warc_derivatives_against_the_standard_library(spark):
    """Titles, links and words of the corpus by html.parser, digests by hashlib: a second way to every field."""
    import base64
    import hashlib
    from html.parser import HTMLParser

    class Second(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.title, self.words, self.links, self.skip, self.inside = "", [], [], 0, False

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "template", "noscript", "svg")
            self.inside = tag == "title"
            found = next((v for k, v in attrs if k in ("href", "src") and v is not None), None)
            if tag in ("a", "area", "img", "link", "script", "iframe") and found is not None:
                self.links.append(found)

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "template", "noscript", "svg")
            self.inside = False

        def handle_data(self, data):
            if self.inside:
                self.title += data
            elif not self.skip:
                self.words += data.split()

    pages = {r.page_id: r for r in common.table(spark, SF, "pages").collect()}
    out = warc.derivatives(warc.responses(common.table(spark, SF, "pages"))).collect()
    assert len(out) == 2 * len(pages) and len({r.record_id for r in out}) == len(out)
    for r in out:
        second = Second()
        second.feed(pages[r.page_id].html)
        second.close()
        assert r.target_uri == pages[r.page_id].url and r.content_length == len(r.block.encode())
        assert r.source_payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(pages[r.page_id].html.encode()).digest()).decode()
        if r.type == "conversion":
            assert "".join(r.block.split()) == "".join(second.words)
        else:
            fields = [line.partition(": ") for line in r.block.split("\r\n") if line]
            assert [v for k, _, v in fields if k == "title"] == [" ".join(second.title.split())]
            assert [v.rsplit(" ", 1)[0] for k, _, v in fields if k == "outlink"] == second.links


def test_columns_align_whatever_their_width():
    render = html_layout.render
    for n in (119, 120, 121, 130, 700):
        assert render(f"<table><tr><td>{'w' * n}<td>B<tr><td>a<td>b</table>") == f"{'w' * n}  B\n{'a':{n}}  b"
    many = render("<table>" + "<tr><td colspan=1000>a" * 8000 + "</table>")
    assert many.splitlines() == ["a"] * 8000
    page = "<table><tr>" + "<td>x" * 1000 + "<tr><td colspan=999>a<td>b" * 8000 + "</table>"
    assert len(render(page)) < 20 * len(page) and render(page).count("b") == 8000
    lines = render("<table><tr><td>one<td>two<td>three<tr><td colspan=2>wide cell here<td>z</table>").splitlines()
    assert lines[0].index("three") == lines[1].index("z")


def test_details_ruby_and_no_break_spaces():
    render = html_layout.render
    assert render("<details><summary>s</summary>no<p>no</details>a") == "s\na" and render("<details open><summary>s</summary>yes</details>") == "s\nyes"
    assert render("<details>no</details>a<details open=''>b</details>") == "a\nb" and render("<details><p>no<summary>s</summary><summary>no</summary></details>") == "s"
    assert render("<ruby>x<rp>(</rp><rt>y</rt><rp>)</rp></ruby>") == "xy"
    assert render("a&nbsp;&nbsp;b \t c\u2003d") == "a\xa0\xa0b c\u2003d" and render("<p>a&nbsp;<p>b") == "a\xa0\n\nb"
    assert render("<div aria-hidden=true>a</div>") == "a"


def test_html_text_against_the_standard_library(spark):
    """Visible characters of the corpus' pages in order, by html.parser: a second way to the same text."""
    from html.parser import HTMLParser

    class Second(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.text, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("head", "script", "style")

        def handle_endtag(self, tag):
            self.skip -= tag in ("head", "script", "style")

        def handle_data(self, data):
            if not self.skip:
                self.text.append(data)

    pages = common.table(spark, SF, "pages")
    got = {r.page_id: r.text for r in html_layout.extract(pages).collect()}
    bare = lambda s: "".join(re.sub(r"(?m)^ *(- |[0-9]+\\. )", "", s).split())
    for r in pages.collect():
        second = Second()
        second.feed(r.html)
        second.close()
        assert "".join(bare(got[r.page_id]).split()).replace("-", "") == "".join("".join(second.text).split()).replace("-", "")


CLASH = ["id__", "row__", "q__digit", "q___digit", "ROOT", "fp", "salt__", "rank__", "sequence_id", "offset", "a.b", "gone", "n", "length", "key"]


def test_columns_that_clash(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in ODD] + [(20, "some words " * 40, "en", "s", 1), (21, "some words " * 40, "en", "s", 1)]
    df = spark.createDataFrame(rows, TEXT)
    for c in CLASH:
        df = df.withColumn(c, F.lit(7))
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    assert quality.quality_filter(df, labels, 0.0).columns == df.columns and quality.quality_filter(df, labels, 0.0).count() == len(rows)
    assert quality.score(df, (0.0, [])).where("score <> 0.5").count() == 0
    kept = language.language_filter(df)
    assert kept.columns == df.columns and 0 < kept.count() <= len(rows)
    once = simhash.deduplicate(df)
    assert once.columns == df.columns and once.count() == len({c for _, _, c in brute_simhash([r[:2] for r in rows])})
    given = common.cut(packing.pieces(df).withColumn("salt__", F.lit("s")).withColumn("rank__", F.lit(1)).withColumn("offset", F.lit("x")), "p")
    out = packing.pack(given)
    assert sorted(out.columns) == sorted([*packing.pieces(df).columns, "salt__", "rank__", "sequence_id", "offset"]) and out.count() == packing.pieces(df).count()


def test_lasso_is_optimal():
    """Conditions of an optimum: a weight's gradient is the penalty against its sign, that of a zero weight at most the penalty, the intercept's zero."""
    rng = np.random.default_rng(17)
    z = (rng.random((400, 30)) < 0.4) * rng.normal(1, 0.3, 30)
    y = (rng.random(400) < quality.sigmoid(z[:, 0] * 2 - z[:, 1] * 1.5 - 0.2)).astype(float)
    for penalty in (0.1, 0.03, 0.005):
        w = quality.lasso(z, y, penalty, np.zeros(31), 20000)
        g = z.T @ (quality.sigmoid(w[0] + z @ w[1:]) - y) / len(y)
        assert abs((quality.sigmoid(w[0] + z @ w[1:]) - y).mean()) < 1e-3
        assert np.abs(g + penalty * np.sign(w[1:]))[w[1:] != 0].max(initial=0) < 1e-3 and np.abs(g).max() < penalty + 1e-3
    assert (quality.lasso(z, y, 1.0, np.zeros(31), 5000)[1:] == 0).all()


def test_rules_are_the_paths_of_trees():
    rng = np.random.default_rng(18)
    x = rng.random((500, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] <= 0.3)).astype(float)
    rules: list = []
    edges = [np.linspace(0.1, 0.9, 9)] * 4
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    step = np.zeros(500)
    quality.grow(x, edges, binned, y - 0.5, np.full(500, 0.25), np.arange(500), 2, (), rules, step)
    leaves = [r for r in rules if not any(len(o) > len(r) and o[: len(r)] == r for o in rules)]
    cover = np.stack([quality.holds(r, x) for r in leaves])
    assert (cover.sum(0) == 1).all() and all(len(np.unique(step[c])) == 1 for c in cover)
    intercept, kept = quality.fit(x, y)
    z = intercept + sum(w * quality.holds(r, x) for r, w in kept)
    assert ((z > 0) == (y > 0.5)).mean() > 0.97 and 0 < len(kept) < 60


def test_conversations_over_batches(spark):
    """Arrow batches of two rows: conversations begin, end and go on at every place of a batch."""
    rng = np.random.default_rng(19)
    rows = [(int(c), t, ["user", "assistant"][t % 2], f"t{c}-{t}") for c in range(40) for t in range(int(rng.integers(1, 7)))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        out = {r.conv_id: chat.parse(bytes(r.formatted)) for r in chat.format_conversations(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert out == {c: [(r[2], r[3]) for r in rows if r[0] == c] for c in range(40)}
