"""Plain-loop and property tests of the raster operators."""

import itertools
import struct
import zlib
from math import exp

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions.color import gray, rgb_to_yuv, to_long, to_wide
from rasterloom.operators import edge_eval, filters, histogram, metrics
from rasterloom.operators.canny import canny
from rasterloom.operators.clahe import clahe
from rasterloom.operators.stencil import apply_stencil, pull_taps
from rasterloom.plans import catalog, settings
from rasterloom.sources import images as files
from rasterloom.sources import rawraster, tables

SHAPES = [(1, 1), (1, 7), (6, 1), (3, 2), (9, 11)]


def frame(spark, *images):
    rows = [(k, i, j, int(im[i, j])) for k, im in enumerate(images) for i in range(im.shape[0]) for j in range(im.shape[1])]
    return spark.createDataFrame(rows, "image_id long, row int, col int, v int")


def arrays(df, images, col="v"):
    out = [np.full(im.shape, -1) for im in images]
    for r in df.collect():
        out[r.image_id][r.row, r.col] = r[col]
    return out


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(3)
    return [rng.integers(0, 256, s) for s in SHAPES] + [np.full((4, 5), 77)]


def at(im, i, j):
    return int(im[min(max(i, 0), im.shape[0] - 1), min(max(j, 0), im.shape[1] - 1)])


def loop(im, fn):
    return np.array([[fn(im, i, j) for j in range(im.shape[1])] for i in range(im.shape[0])])


def nearest(x):
    return max(0, min(255, int(x + 0.5)))


def square(k):
    return list(itertools.product(range(-(k // 2), k // 2 + 1), repeat=2))


@pytest.mark.parametrize("tile", [2, 3, 64])
def test_median_in_any_tiling(spark, images, tile):
    def kernel(t):
        return {"v": np.median(np.stack([t.tap("v", a, b) for a, b in square(3)]), axis=0)}

    got = arrays(apply_stencil(frame(spark, *images), kernel, 1, tile_rows=tile, tile_cols=tile), images)
    for im, g in zip(images, got):
        assert (g == loop(im, lambda m, i, j: sorted(at(m, i + a, j + b) for a, b in square(3))[4])).all()


def test_halo_equals_pull_join(spark, images):
    px = frame(spark, *images)
    pulled = pull_taps(px, [(i, j, w) for i, j, w in filters.gaussian_weights(3, 1.0)], ("w",))
    twin = pulled.groupBy("image_id", "row", "col").agg(F.round(F.sum(F.col("w") * F.col("n"))).cast("int").alias("v"))
    for a, b in zip(arrays(filters.gaussian_filter(px, 3, 1.0), images), arrays(twin, images)):
        assert (a == b).all()


def test_bilateral_and_uniform_loops(spark, images):
    def bilateral(m, i, j):
        top = bottom = 0.0
        for a, b in square(3):
            w = exp(-(a * a + b * b) / 8) * exp(-((at(m, i + a, j + b) - at(m, i, j)) ** 2) / 1800)
            top, bottom = top + w * at(m, i + a, j + b), bottom + w
        return nearest(top / bottom)

    px = frame(spark, *images)
    for im, g, u in zip(images, arrays(filters.bilateral_filter(px, 3, 2.0, 30.0), images), arrays(filters.uniform_filter(px, 3), images)):
        assert (g == loop(im, bilateral)).all()
        assert (u == loop(im, lambda m, i, j: nearest(sum(1 / 9 * at(m, i + a, j + b) for a, b in square(3))))).all()
    for im, g in zip(images, arrays(filters.uniform_filter(px, 1), images)):
        assert (g == im).all()


@pytest.mark.parametrize("a", [None, 1.0])
def test_nlm_loop(spark, images, a):
    def one(m, i, j):
        top = bottom = 0.0
        h, w = m.shape
        for si, sj in square(3):
            r, c = min(max(i + si, 0), h - 1), min(max(j + sj, 0), w - 1)
            if a and (r, c) == (i, j):
                continue
            g = {(p, q): exp(-(p * p + q * q) / 2) if a else 1.0 for p, q in square(3)}
            d = sum(g[p, q] * (at(m, i + p, j + q) - at(m, r + p, c + q)) ** 2 for p, q in square(3)) / (sum(g.values()) if a else 1)
            k = exp(-d / 400.0)
            top, bottom = top + k * at(m, r, c), bottom + k
        return nearest(top / bottom) if bottom > 0 else at(m, i, j)

    for im, g in zip(images, arrays(filters.nlm(frame(spark, *images), 20.0, 3, 3, a=a), images)):
        assert (g == loop(im, one)).all()


def test_bucket_fill_levels_are_even(spark):
    im = np.random.default_rng(1).integers(0, 40, (64, 70))
    px = frame(spark, im)
    out = arrays(histogram.equalize_bucket(px), [im])[0]
    counts = np.bincount(out.ravel(), minlength=256)
    assert counts.max() - counts.min() <= 1
    order = np.argsort(im.ravel(), kind="stable")
    assert (out.ravel()[order] == np.arange(im.size) * 256 // im.size).all()


def test_constant_and_rounding(spark):
    im = np.full((3, 4), 9)
    px = frame(spark, im)
    assert {r.mapped for r in histogram.transfer_function(px).collect()} == {0}
    assert metrics.psnr_gray(px, px).collect()[0].psnr == 1e9
    assert filters.sobel_magnitude(px).agg(F.max("mag")).collect()[0][0] == 0
    assert (arrays(clahe(px, 2.0, 8, 8), [im])[0] >= 0).all()


def test_gray_world_and_wide_long(spark):
    rng = np.random.default_rng(2)
    rows = [(0, i, j, int(rng.integers(20, 90)), int(rng.integers(40, 120)), 0) for i in range(5) for j in range(6)]
    rgb = spark.createDataFrame(rows, "image_id long, row int, col int, r int, g int, b int")
    assert metrics.gray_world_gains(rgb).collect()[0].gain_b == 1.0
    assert sorted(to_wide(to_long(rgb)).collect()) == sorted(rgb.collect())
    assert rgb_to_yuv(rgb).count() == 30
    pair = spark.createDataFrame([(0, 0, 0, 20, 54, 16)], rgb.schema)
    assert gray(pair, "float").collect()[0].v == 40 and gray(pair, "double").collect()[0].v == 39


def test_canny_reaches_weak_pixels_across_tiles(spark):
    im = np.zeros((150, 20), int)
    im[:, 10:] = 200 - np.arange(150)[:, None]
    out = arrays(canny(frame(spark, im), 150.0, 700.0), [im])[0]
    assert (out[1:-1, 8:12] == 0).any(axis=1).all()
    with pytest.raises(ValueError):
        canny(frame(spark, im), 5, 5)


def test_canny_of_whole_tables(spark):
    """The registered query against one flood over each whole image; some of its paths must run from tile to tile."""
    px = catalog.grays(spark, "/root/testdata/sf0.001")
    got = catalog.QUERIES["canny_tables"](spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) == px.count() and set(got.image_id) == {1, 2, 3}
    low, high = settings.CANNY
    crossed = 0
    for k, g in filters.sobel_gradients(px).toPandas().groupby("image_id"):
        gx, gy = (g.pivot(index="row", columns="col", values=c).to_numpy().astype(float) for c in ("gx", "gy"))
        mag = np.pad(np.sqrt(gx * gx + gy * gy), 1)
        state = np.zeros(gx.shape, int)
        for i, j in np.ndindex(gx.shape):
            x, y, own = gx[i, j], gy[i, j], mag[i + 1, j + 1]
            di, dj = (0, -1) if abs(y) <= (2**0.5 - 1) * abs(x) else (-1, 0) if abs(y) >= (2**0.5 + 1) * abs(x) else (-1, 1 if x * y > 0 else -1)
            diagonal = di * dj != 0
            if own > mag[i + 1 + di, j + 1 + dj] and (own > mag[i + 1 - di, j + 1 - dj] or not diagonal and own == mag[i + 1 - di, j + 1 - dj]):
                state[i, j] = 2 if own > high else int(own > low)

        def reached(step):
            seen, work = state == 2, [tuple(at) for at in np.argwhere(state == 2)]
            while work:
                i, j = work.pop()
                for a, b in itertools.product(range(max(0, i - 1), min(len(state), i + 2)), range(max(0, j - 1), min(state.shape[1], j + 2))):
                    if state[a, b] == 1 and not seen[a, b] and a // step == i // step:
                        seen[a, b] = True
                        work.append((a, b))
            return seen

        want = reached(len(state))
        crossed += (want != reached(64)).sum()
        assert (got[got.image_id == k].pivot(index="row", columns="col", values="v").to_numpy() == np.where(want, 0, 255)).all()
    assert crossed > 0


def test_matching_is_maximum():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 6))
        pairs = [(a, b, int(rng.integers(0, 9))) for a in range(n) for b in range(n) if rng.random() < 0.4]
        best = max((sum((a, b) in {(x, y) for x, y, _ in pairs} for a, b in enumerate(p)) for p in itertools.permutations(range(n))), default=0)
        assert edge_eval.matching_size(pairs) == best


def test_sweep_and_best(spark):
    maps = spark.createDataFrame([(0, "d", i, j, 255 if i == j else 100 * (i == 0)) for i in range(4) for j in range(4)], "image_id long, detector string, row int, col int, v int")
    truth = spark.createDataFrame([(0, 1, i, i) for i in range(4)], "image_id long, gt_id int, row int, col int")
    sweep = edge_eval.edge_sweep(maps, truth, [(0, 0)])
    rows = {r.t: r for r in sweep.collect()}
    assert len(rows) == 101 and abs(rows[0].p - 4 / 16) < 1e-9 and abs(rows[100].f - 1) < 1e-9
    best = edge_eval.best_threshold(sweep).collect()[0]
    assert best.t == 40
    assert tables.curve_table(sweep, edge_eval.best_threshold(sweep)).count() == 104
    pr = edge_eval.edge_pr(maps.where("v >= 51").select("image_id", "detector", F.lit(20).alias("t"), "row", "col"), truth, [(0, 0)])
    assert [r.GT for r in tables.pr_table(pr, edge_eval.edge_pr_mean(pr)).orderBy("k").collect()] == ["1", "Mean", "F-measure"]


def test_raw_files(spark, tmp_path):
    im = np.random.default_rng(4).integers(0, 256, (9, 4, 3))
    path = str(tmp_path / "a.raw")
    rows = [(0, i, j, c, int(im[i, j, c])) for i in range(9) for j in range(4) for c in range(3)]
    px = spark.createDataFrame(rows, "image_id long, row int, col int, ch int, v int")
    rawraster.write_raw(px.repartition(3), path)
    assert open(path, "rb").read() == im.astype(np.uint8).tobytes()
    assert sorted(rawraster.read_raw(spark, path, 4, 9, 3).collect()) == sorted(px.collect())
    assert rawraster.read_raw(spark, path, 4, 9, 3).where("row >= 7").count() == 24
    with pytest.raises(Exception):
        rawraster.read_raw(spark, path, 4, 10, 3).count()
    assert rawraster.output_name("x/y\\Bird.v2.raw", "_edge_T", 24.6) == "Bird.v2_edge_T25.raw"


def test_csv_sinks(spark, tmp_path):
    px = frame(spark, np.arange(12).reshape(3, 4))
    tables.write_histogram(histogram.histogram(px), str(tmp_path / "h"))
    back = spark.read.csv(str(tmp_path / "h"), header=True, inferSchema=True)
    assert back.columns == ["intensity", "count"] and back.count() == 256
    tables.write_cdf(histogram.cdf_normalized(px), str(tmp_path / "c"))
    tables.write_transfer(histogram.transfer_function(px), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).count() == 256


def test_stream(spark, tmp_path):
    from rasterloom.streaming.rasters import stream_images

    px = frame(spark, np.arange(12).reshape(3, 4))
    px.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(px.schema).parquet(str(tmp_path / "in"))
    stream_images(s, histogram.equalize_lut, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12


@pytest.mark.parametrize("call", [lambda p: filters.uniform_filter(p, 4), lambda p: filters.gaussian_filter(p, 3, 0), lambda p: filters.median_filter(p, 0), lambda p: filters.nlm(p, 0, 3, 3), lambda p: filters.bilateral_filter(p, 2, 1, 1), lambda p: filters.sobel_edges(p, 101)])
def test_bad_arguments(spark, call):
    with pytest.raises(ValueError):
        call(frame(spark, np.zeros((2, 2), int)))


def clahe_loop(im, clip, tx, ty):
    """Contrast-limited equalisation by plain loops: mirrored border, equal tiles, single precision."""
    h, w = im.shape
    even = h % ty == 0 and w % tx == 0
    mirror = lambda p, n: 0 if n == 1 else min(p % (2 * n - 2), 2 * n - 2 - p % (2 * n - 2))
    big = im if even else np.array([[im[mirror(i, h), mirror(j, w)] for j in range(w + tx - w % tx)] for i in range(h + ty - h % ty)])
    th, tw = big.shape[0] // ty, big.shape[1] // tx
    luts = {}
    for a, b in itertools.product(range(ty), range(tx)):
        hist = np.bincount(big[a * th : (a + 1) * th, b * tw : (b + 1) * tw].ravel(), minlength=256).tolist()
        limit = max(1, int(clip * th * tw / 256))
        cut = sum(max(0, n - limit) for n in hist)
        hist = [min(n, limit) + cut // 256 for n in hist]
        rest = cut % 256
        if rest:
            for k in list(range(0, 256, max(256 // rest, 1)))[:rest]:
                hist[k] += 1
        total, scale, lut = 0, np.float32(255) / np.float32(th * tw), []
        for n in hist:
            total += n
            lut.append(min(255, int(np.rint(np.float32(total) * scale))))
        luts[a, b] = lut
    out, f = np.zeros((h, w), int), np.float32
    for i, j in np.ndindex(h, w):
        y, x = f(i) * (f(1) / f(th)) - f(0.5), f(j) * (f(1) / f(tw)) - f(0.5)
        y0, x0 = int(np.floor(y)), int(np.floor(x))
        ya, xa = y - f(y0), x - f(x0)
        at = lambda a, b: f(luts[min(max(a, 0), ty - 1), min(max(b, 0), tx - 1)][im[i, j]])
        top, bottom = (at(k, x0) * (f(1) - xa) + at(k, x0 + 1) * xa for k in (y0, y0 + 1))
        out[i, j] = min(255, max(0, int(np.rint(top * (f(1) - ya) + bottom * ya))))
    return out


@pytest.mark.parametrize("clip,tx,ty", [(2.0, 8, 8), (40.0, 2, 3), (0.5, 1, 1)])
def test_clahe_loop(spark, images, clip, tx, ty):
    more = [*images, np.random.default_rng(9).integers(0, 30, (24, 17)), np.random.default_rng(8).integers(90, 160, (16, 32))]
    for im, got in zip(more, arrays(clahe(frame(spark, *more), clip, tx, ty), more)):
        assert (got == clahe_loop(im, clip, tx, ty)).all()


def test_psnr_of_rasters_that_differ_in_pixels_raises(spark):
    px = frame(spark, np.arange(6).reshape(2, 3))
    for a, b in ((px, px.where("col < 2")), (px.where("row = 0"), px)):
        with pytest.raises(Exception, match="one raster only"):
            metrics.psnr_gray(a, b).collect()


def test_raw_writer_rejects_what_is_not_one_whole_image(spark, tmp_path):
    px = frame(spark, np.arange(12).reshape(3, 4))
    one = px.where("row = 1 AND col = 2")
    for bad in (px.where("NOT (row = 0 AND col = 1)"), px.unionAll(one), px.unionAll(one.withColumn("image_id", F.lit(7).cast("long"))), px.where("NOT (row = 0 AND col = 1)").unionAll(one), px.where("row < 0")):
        with pytest.raises(Exception):
            rawraster.write_raw(bad, str(tmp_path / "bad.raw"))
    assert not list(tmp_path.glob("bad*"))


def test_row_conditions_prune_strips(spark, tmp_path):
    rawraster.write_raw(frame(spark, np.arange(200).reshape(50, 4)), str(tmp_path / "p.raw"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = rawraster.read_raw(spark, str(tmp_path / "p.raw"), 4, 50).where("row >= 47 AND row < 49")
        assert sorted(r.v for r in got.collect()) == list(range(188, 196))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("kind", ["raw", "png"])
def test_image_files(spark, tmp_path, kind):
    rng = np.random.default_rng(11)
    ims = rng.integers(0, 256, (3, 5, 4, 3))
    px = spark.createDataFrame([(k, *map(int, at), int(im[at])) for k, im in enumerate(ims) for at in np.ndindex(im.shape)], "image_id long, row int, col int, ch int, v int")
    files.write_images(px.repartition(4), str(tmp_path), kind, "im{image_id}_{width}x{height}")
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"im{k}_4x5.{kind}" for k in range(3)]
    back = files.read_raw_files(spark, f"{tmp_path}/*.raw", 4, 5, 3) if kind == "raw" else tables.read_encoded(spark, str(tmp_path))
    names = spark.createDataFrame([(k, f"im{k}_4x5") for k in range(3)], "k long, name string").select("k", F.xxhash64("name").alias("image_id"))
    assert sorted(map(tuple, back.join(names, "image_id").select("k", "row", "col", "ch", "v").collect())) == sorted(map(tuple, px.collect()))
    with pytest.raises(Exception, match="pixels"):
        files.image_bytes(px.where("v <> 7 OR row <> 0").unionAll(px.limit(1)), kind).collect()


def test_channels_of_encoded_images(spark, tmp_path):
    rgba = np.array([[[10, 20, 30, 40], [50, 60, 70, 80]]])
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.png").write_bytes(files.png(rgba))
    got = sorted((r.row, r.col, r.ch, r.v) for r in tables.read_encoded(spark, str(tmp_path / "a")).collect())
    assert got == [(*at, int(rgba[at])) for at in np.ndindex(1, 2, 4)]
    assert [r.v for r in tables.read_edge_map(spark, str(tmp_path / "a")).orderBy("col").collect()] == [10, 50]
    (tmp_path / "g.png").write_bytes(files.png(np.array([[[9], [8]]])))
    assert [r.v for r in tables.read_edge_map(spark, str(tmp_path / "g.png")).orderBy("col").collect()] == [9, 8]
    with pytest.raises(Exception):
        tables.read_edge_map(spark, str(tmp_path / "none.png")).count()
    (tmp_path / "bad.png").write_bytes(b"no image")
    with pytest.raises(Exception):
        tables.read_edge_map(spark, str(tmp_path / "bad.png")).count()


def mat_file(planes, name=b"groundTruth", packed=True):
    """A MAT file of a cell array of structs with Segmentation and Boundaries, written from the format's description."""
    def element(kind, data):
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    def array(cls, shape, label, body):
        return element(14, element(6, struct.pack("<II", cls, 0)) + element(5, struct.pack("<ii", *shape)) + element(1, label) + body)

    def one(plane):
        fields = [array(11, plane.shape, b"", element(4, (plane + 1).astype("<u2").tobytes(order="F"))), array(9, plane.shape, b"", element(2, plane.astype(np.uint8).tobytes(order="F")))]
        labels = b"Segmentation".ljust(32, b"\0") + b"Boundaries".ljust(32, b"\0")
        return array(2, (1, 1), b"", struct.pack("<HHi", 5, 4, 32) + element(1, labels) + b"".join(fields))

    whole = array(1, (1, len(planes)), name, b"".join(one(p) for p in planes))
    if packed:
        whole = (lambda z: struct.pack("<II", 15, len(z)) + z)(zlib.compress(whole))
    return b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + whole


@pytest.mark.parametrize("packed", [True, False])
def test_mat_ground_truth(spark, tmp_path, packed):
    rng = np.random.default_rng(6)
    planes = [rng.random((7, 5)) < 0.3 for _ in range(3)]
    for stem, name in (("Bird", b"groundTruth"), ("Deer", b"other")):
        (tmp_path / f"{stem}.mat").write_bytes(mat_file(planes, name, packed))
    got = tables.read_truth_mat(spark, f"{tmp_path}/*.mat").collect()
    ids = [r[0] for r in spark.sql("SELECT xxhash64('Bird') UNION ALL SELECT xxhash64('Deer')").collect()]
    assert sorted((r.image_id, r.gt_id, r.row, r.col) for r in got) == sorted((i, k + 1, *map(int, at)) for i in ids for k, p in enumerate(planes) for at in np.argwhere(p))
    (tmp_path / "x.mat").write_bytes(b"no")
    with pytest.raises(Exception, match="MAT"):
        tables.read_truth_mat(spark, f"{tmp_path}/x.mat").count()


def test_csv_lines_and_files(spark, tmp_path):
    pr = spark.createDataFrame([(i, "d", 20, k, 1, 2, 3, 0.5, 0.25 * k) for i in (0, 1) for k in (1, 2)], "image_id long, detector string, t int, gt_id int, tp long, n_edge long, n_gt long, p double, r double")
    mean = edge_eval.edge_pr_mean(pr)
    tables.write_pr(pr, mean, str(tmp_path / "pr"))
    for i in (0, 1):
        (part,) = (tmp_path / "pr" / f"image_id={i}" / "detector=d").glob("part-*")
        assert part.read_text() == "GT,Precision,Recall\n1,0.500000,0.250000\n2,0.500000,0.500000\nMean,0.500000,0.375000\nF-measure,0.428571,\n"
    sweep = spark.createDataFrame([(0, "d", t, 0.5, 0.25, t / 100) for t in (0, 7, 100)], "image_id long, detector string, t int, p double, r double, f double")
    tables.write_curve(sweep, edge_eval.best_threshold(sweep), str(tmp_path / "curve"))
    (part,) = (tmp_path / "curve").glob("part-*")
    assert part.read_text() == "T,MeanPrecision,MeanRecall,MeanF\n0.00,0.500000,0.250000,0.000000\n0.07,0.500000,0.250000,0.070000\n1.00,0.500000,0.250000,1.000000\nBest,,,\nBestT,1.00,,\nBestF,,,1.000000\n"
    px = frame(spark, np.array([[0, 0, 1, 5]] * 2), np.array([[3, 4, 5], [3, 3, 3]]))
    tables.write_cdf(histogram.cdf_normalized(px), str(tmp_path / "cdf"))
    (part,) = (tmp_path / "cdf" / "image_id=1").glob("part-*")
    assert part.read_text().splitlines()[:6] == ["intensity,cdf", "0,0", "1,0", "2,0", "3,0.666667", "4,0.833333"] and part.read_text().endswith("255,1\n")
    hist = histogram.histogram(px.select("image_id", "row", "col", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("ch"), "v"), ("image_id", "ch"))
    tables.write_rgb_histogram(hist.where("image_id = 0"), hist.where("image_id = 0"), str(tmp_path / "rgb"))
    (part,) = (tmp_path / "rgb").glob("part-*")
    assert part.read_text().splitlines()[:3] == ["value,R_before,G_before,B_before,R_after,G_after,B_after", "0,4,4,4,4,4,4", "1,2,2,2,2,2,2"]


def test_matching_on_the_grid_equals_plain_matching():
    rng = np.random.default_rng(12)
    for n in range(150):
        h, w, share = int(rng.integers(1, 9)), int(rng.integers(1, 30)), rng.random(2) * 0.7
        a, b = (np.argwhere(rng.random((h, w)) < s) for s in share)
        offsets = edge_eval.disc(1, 1, float(rng.choice([0.1, 0.8, 1.5, 2.2])))
        pairs = [(i, j, int(((x - y) ** 2).sum())) for i, x in enumerate(a) for j, y in enumerate(b) if tuple(y - x) in set(offsets)]
        assert edge_eval.matched_pixels(a, b, offsets) == edge_eval.matching_size(pairs)
    assert edge_eval.matched_pixels(np.zeros((0, 2), int), np.ones((1, 2), int), [(0, 0)]) == 0


def test_matching_takes_long_augmenting_paths():
    line = np.array([(0, 2 * k) for k in range(400)])
    assert edge_eval.matched_pixels(line, line + [0, 1], [(0, 1), (0, -1)]) == 400
    assert edge_eval.matched_pixels(np.vstack([line, [[0, -2]]]), line + [0, -1], [(0, 1), (0, -1)]) == 400
    # nearest pairs first leave both ends alone; one path over all pixels mends it
    edges, truth = np.array([(0, 3 * k) for k in range(200)]), np.array([(0, 3 * k + 1) for k in range(199)] + [(0, -2)])
    assert edge_eval.matched_pixels(edges, truth, [(0, 1), (0, -2)]) == 200


def test_matching_of_a_tall_image_takes_bands():
    """Over a hundred thousand offsets; nearest first would try each of them for the 100 pixels far above."""
    offsets = edge_eval.disc_bands(120_000, 64)
    assert int((offsets[:, 2] - offsets[:, 1] + 1).sum()) > 100_000
    rng = np.random.default_rng(8)
    low = np.unique(np.stack([rng.integers(60_000, 70_000, 3000), rng.integers(0, 64, 3000)], 1), axis=0)
    far = np.stack([np.arange(100), np.zeros(100, int)], 1)
    moved = low + [2, 0]
    assert edge_eval.matched_pixels(np.vstack([low, far]), moved, offsets) == len(low)
    assert edge_eval.matched_pixels(np.vstack([low, far]), np.vstack([moved[5:], far + [5000, 0]]), offsets) == len(low) - 5
    flat = [(0, 0), (1, 0), (3, 0), (0, 2)]
    assert edge_eval.bands(flat).tolist() == [[0, 0, 1], [0, 3, 3], [2, 0, 0]]
    wanted = {(i, j) for i, j in edge_eval.disc(30, 900) if abs(i) < 30 and abs(j) < 900}
    assert {(i, j) for j, lo, hi in edge_eval.disc_bands(30, 900).tolist() for i in range(lo, hi + 1)} == wanted


def test_sweep_deals_a_map_once_for_each_of_its_levels(spark, monkeypatch):
    rng = np.random.default_rng(9)
    shades = {"binary": rng.choice([0, 255], (12, 10), p=[0.7, 0.3]), "graded": rng.choice([10, 60, 130, 131, 200], (12, 10))}
    maps = spark.createDataFrame([(0, d, i, j, int(m[i, j])) for d, m in shades.items() for i in range(12) for j in range(10)], "image_id long, detector string, row int, col int, v int")
    spots = {k: np.argwhere(rng.random((12, 10)) < 0.2) for k in (1, 2)}
    truth = spark.createDataFrame([(0, k, int(i), int(j)) for k, s in spots.items() for i, j in s], "image_id long, gt_id int, row int, col int")
    seen, offsets, plain = [], edge_eval.disc_bands(200, 90), edge_eval.matches
    monkeypatch.setattr(edge_eval, "matches", lambda edges, *rest: seen.append(edges) or plain(edges, *rest))
    rows = {(r.detector, r.t): r for r in edge_eval.edge_sweep(maps, truth, offsets, 20, 2).collect()}
    assert len(rows) == 42
    assert {r.detector: r["count"] for r in seen[0].groupBy("detector").count().collect()} == {"binary": 120 + int((shades["binary"] == 255).sum()), "graded": 120 + int((shades["graded"] >= 60).sum())}
    for (d, t), r in rows.items():
        own = np.argwhere(shades[d] * 20 >= t * 255)
        tp = [edge_eval.matched_pixels(own, s, offsets) for s in spots.values()]
        assert abs(r.p - np.mean([x / (len(own) + edge_eval.EPS) for x in tp])) < 1e-12 and abs(r.r - np.mean([x / len(s) for x, s in zip(tp, spots.values())])) < 1e-12


def test_candidates_of_a_tall_image(spark):
    """The work goes by pairs: no literal for each of over a hundred thousand offsets."""
    rng = np.random.default_rng(10)
    spots = [np.unique(np.stack([rng.integers(0, 4000, 150), rng.integers(0, 64, 150)], 1), axis=0) for _ in range(3)]
    edges = spark.createDataFrame([(0, "d", int(i), int(j)) for i, j in spots[0]], "image_id long, detector string, row int, col int")
    truth = spark.createDataFrame([(0, k, int(i), int(j)) for k in (1, 2) for i, j in spots[k]], "image_id long, gt_id int, row int, col int")
    for offsets in (edge_eval.disc_bands(120_000, 64), [(0, 0), (900, 1), (-3, 1), (5, -2), (6, -2)]):
        found = edge_eval.edge_candidates(edges, truth, offsets).select("gt_id", "row", "col", "grow", "gcol", "d2").collect()
        near = {(i, int(j)) for j, lo, hi in edge_eval.bands(offsets).tolist() for i in range(lo, hi + 1)}
        wanted = [(k, *a, *b, int(((b - a) ** 2).sum())) for k in (1, 2) for a in spots[0] for b in spots[k] if tuple(b - a) in near]
        assert sorted(map(tuple, found)) == sorted(wanted)


def test_candidates_of_one_image_take_many_even_tasks(spark):
    """Few rows make many pairs, so tasks sized by what they read would be too few."""
    rng = np.random.default_rng(14)
    spots = [np.argwhere(rng.random((3000, 16)) < 0.1) for _ in range(2)]
    edges = spark.createDataFrame([(0, "d", int(i), int(j)) for i, j in spots[0]], "image_id long, detector string, row int, col int")
    truth = spark.createDataFrame([(0, 1, int(i), int(j)) for i, j in np.vstack([spots[1], spots[1][:7]])], "image_id long, gt_id int, row int, col int")
    found = edge_eval.edge_candidates(edges, truth, edge_eval.disc_bands(3000, 16))
    shares = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    near = {(i, int(j)) for j, lo, hi in edge_eval.disc_bands(3000, 16).tolist() for i in range(lo, hi + 1)}
    own = {tuple(x) for x in spots[0].tolist()}
    assert sum(shares) == sum((i - di, j - dj) in own for i, j in np.vstack([spots[1], spots[1][:7]]).tolist() for di, dj in near)  # repeated pixels pair anew
    assert max(shares) <= sum(shares) / 8


def test_precision_and_means_of_a_tall_image(spark):
    rng = np.random.default_rng(11)
    own = np.unique(np.stack([rng.integers(0, 5000, 400), rng.integers(0, 60, 400)], 1), axis=0)
    edges = spark.createDataFrame([(0, "d", 20, int(i), int(j)) for i, j in own], "image_id long, detector string, t int, row int, col int").repartition(3)
    truth = spark.createDataFrame([(0, k, int(i), int(j) + k) for k in (1, 2) for i, j in own[:: k]], "image_id long, gt_id int, row int, col int").repartition(3)
    pr = edge_eval.edge_pr(edges, truth, edge_eval.disc_bands(120_000, 64))
    assert {(r.gt_id, r.tp, r.n_edge, r.n_gt) for r in pr.collect()} == {(k, len(own[::k]), len(own), len(own[::k])) for k in (1, 2)}
    (mean,) = edge_eval.edge_pr_mean(pr).collect()
    assert abs(mean.p - (1 + len(own[::2]) / len(own)) / 2) < 1e-9 and abs(mean.r - 1) < 1e-9


def in_tasks(spark, df, most=1):
    """Whether df's rows lie in more than so many partitions where Spark neither broadcasts nor coalesces."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        return df.groupBy(F.spark_partition_id()).count().count() > most
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_scaling_one_image_takes_many_tasks(spark):
    rng = np.random.default_rng(12)
    tall, wide = rng.integers(0, 256, (700, 5)), rng.integers(0, 256, (3, 2100))
    px = spark.createDataFrame([(k, i, j, int(m[i, j])) for k, m in ((1, tall), (2, wide)) for i in range(m.shape[0]) for j in range(m.shape[1])], "image_id long, row int, col int, v int")
    got = {(r.image_id, r.row, r.col): r.v for r in filters.normalise(px.withColumn("v", F.col("v") * 3), "v").collect()}
    assert len(got) == tall.size + wide.size
    for k, m in ((1, tall), (2, wide)):
        lo, hi = m.min(), m.max()
        assert all(abs(got[k, i, j] - (m[i, j] - lo) / (hi - lo) * 255) <= 0.5 + 1e-4 for i in range(m.shape[0]) for j in range(m.shape[1]))
    assert in_tasks(spark, filters.normalise(px.where("image_id = 1"), "v"))


def test_sweep_deals_one_image_to_many_tasks(spark, monkeypatch):
    tall = np.random.default_rng(13).integers(0, 256, (700, 5))
    maps = spark.createDataFrame([(0, "d", i, j, int(tall[i, j])) for i in range(700) for j in range(5)], "image_id long, detector string, row int, col int, v int")
    truth = maps.where("v >= 200").select("image_id", F.lit(1).alias("gt_id"), "row", "col")
    seen, matches = [], edge_eval.matches
    monkeypatch.setattr(edge_eval, "matches", lambda edges, *rest: seen.append(edges) or matches(edges, *rest))
    curve = edge_eval.edge_sweep(maps, truth, [(0, 0)], 20)
    assert in_tasks(spark, seen[0])
    for r in curve.collect():
        own = tall * 20 >= r.t * 255
        tp = int((own & (tall >= 200)).sum())
        assert abs(r.p - tp / (own.sum() + edge_eval.EPS)) < 1e-9 and abs(r.r - tp / (tall >= 200).sum()) < 1e-9
