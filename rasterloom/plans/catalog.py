"""The library's queries by name; each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rasterloom.functions.color import gray, rgb_to_yuv, to_long, yuv_to_rgb
from rasterloom.operators import edge_eval, filters, histogram, metrics
from rasterloom.operators.canny import canny
from rasterloom.operators.clahe import clahe
from rasterloom.plans import fixtures as fx
from rasterloom.plans.settings import BILATERAL, CANNY, CANNY_EVALUATED, CLAHE, GAUSS, MEDIAN, NLM, NLM_A, SHARES, SWEEP, UNIFORM
from rasterloom.plans.sql import ORACLES  # noqa: F401
from rasterloom.sources import images, tables
from rasterloom.sources.rawraster import read_raw, write_raw
from rasterloom.sources.shared import cut, shared_dir


def grays(s, d):
    """f1, f1b and f7 as images 1, 2 and 3."""
    one = lambda df, i: df.withColumn("image_id", F.lit(i).cast("long"))
    return one(fx.f1(s, d), 1).unionByName(one(fx.f1b(s, d), 2)).unionByName(one(fx.f7(s, d), 3))


def rgb_batch(s, d):
    """8 x 8 colour images of three vectors each."""
    px = fx.f2(s, d).withColumn("ch", F.col("image_id") % 3).withColumn("image_id", F.floor(F.col("image_id") / 3))
    wide = px.groupBy("image_id", "row", "col").agg(F.count("*").alias("n"), *[F.max(F.when(F.col("ch") == i, F.col("v"))).alias(c) for i, c in enumerate("rgb")])
    return wide.where("n = 3").drop("n")


def rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def awb_stats(s, d):
    return rounded(metrics.gray_world_gains(fx.f3(s, d)), *[f"{k}_{c}" for k in ("mean", "gain") for c in "rgb"])


def edge_inputs(s, d):
    """(strength maps, ground truth, offsets): three Sobel thresholds against three shifted annotators."""
    mag = cut(filters.sobel_magnitude(fx.f1(s, d)), "sobel")
    size = mag.agg(F.max("row"), F.max("col")).collect()[0]
    offsets = edge_eval.disc_bands(size[0] + 1, size[1] + 1)
    maps = None
    for share in SHARES:
        one = edge_eval.strength(filters.edge_map(mag, share)).select("image_id", F.lit(f"sobel{share}").alias("detector"), "row", "col", "v")
        maps = one if maps is None else maps.unionByName(one)
    truth = None
    own = mag.where(F.col("mag") >= filters.threshold_of(40))
    for k in range(3):
        down = own.select("image_id", F.lit(k + 1).alias("gt_id"), (F.col("row") + k).alias("row"), "col").where(F.col("row") <= size[0])
        top = own.where("row = 0").select("image_id", F.lit(k + 1).alias("gt_id"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("row"), "col") if k else None
        one = down.unionByName(top) if top is not None else down
        truth = one if truth is None else truth.unionByName(one)
    return maps, truth, offsets


def fixed(maps):
    """Edge pixels at the fixed threshold of 0.20."""
    return edge_eval.at_threshold(maps, 20)


def candidates(s, d):
    maps, truth, offsets = edge_inputs(s, d)
    return edge_eval.edge_candidates(maps.where("v = 255").drop("v"), truth, offsets).select("image_id", "detector", "gt_id", "row", "col", "grow", "gcol", "d2")


def pr(s, d):
    maps, truth, offsets = edge_inputs(s, d)
    return edge_eval.edge_pr(fixed(maps), truth, offsets)


def sweep(s, d):
    maps, truth, offsets = edge_inputs(s, d)
    return edge_eval.edge_sweep(maps, truth, offsets, SWEEP)


def raw_roundtrip(s, d):
    path = f"{shared_dir(s)}/roundtrip-{uuid.uuid4().hex}.raw"
    px = fx.f1(s, d)
    height = px.agg(F.max("row")).collect()[0][0] + 1
    write_raw(px, path)
    return read_raw(s, path, 64, height)


def exact_inputs(s, d):
    """edge_inputs with two more maps, graded Sobel strength and Canny edges, and a tolerance of no pixel."""
    maps, truth, _ = edge_inputs(s, d)
    more = filters.sobel_magnitude(fx.f1(s, d)).select("image_id", F.lit("graded").alias("detector"), "row", "col", F.col("mag").alias("v"))
    thin = edge_eval.strength(canny(fx.f1(s, d), *CANNY_EVALUATED)).select("image_id", F.lit("canny").alias("detector"), "row", "col", "v")
    return maps.unionByName(more).unionByName(thin), truth, [(0, 0)]


def pr_exact(s, d):
    maps, truth, offsets = exact_inputs(s, d)
    return edge_eval.edge_pr(fixed(maps), truth, offsets)


def sweep_exact(s, d):
    maps, truth, offsets = exact_inputs(s, d)
    return edge_eval.edge_sweep(maps, truth, offsets, SWEEP)


def pr_csv(s, d):
    pr = cut(pr_exact(s, d), "pr")
    return tables.pr_lines(pr, edge_eval.edge_pr_mean(pr))


def curve_csv(s, d):
    curve = cut(sweep_exact(s, d), "curve")
    return tables.curve_lines(curve, edge_eval.best_threshold(curve))


def rgb_histogram_csv(s, d):
    both = [histogram.histogram(to_long(df), ("image_id", "ch")) for df in (fx.f3(s, d), metrics.gray_world(fx.f3(s, d)))]
    return tables.rgb_histogram_lines(tables.rgb_histogram_table(*both))


def quality(found, planes):
    """(filter, image_id, mse_*, psnr_*) of (name, clean, filtered) rasters."""
    out = None
    for name, clean, filtered in found:
        m = metrics.aligned(clean, filtered, planes).groupBy("image_id").agg(*[F.avg(c).alias(c) for c in planes])
        cols = [F.round(x, 6).alias(f"{n}_{c}") for c in planes for n, x in (("mse", F.col(c)), ("psnr", metrics.psnr_of(F.col(c))))]
        one = m.select(F.lit(name).alias("filter"), "image_id", *cols)
        out = one if out is None else out.unionByName(one)
    return out


def denoise_psnr(s, d):
    clean, noisy = fx.f1(s, d), fx.f5(s, d)
    found = [("none", noisy), ("uniform", filters.uniform_filter(noisy, UNIFORM)), ("gaussian", filters.gaussian_filter(noisy, *GAUSS)), ("bilateral", filters.bilateral_filter(noisy, *BILATERAL))]
    return quality([(name, clean, df) for name, df in found], "v")


def denoise_psnr_nlm(s, d):
    clean = fx.f2(s, d)
    noisy = clean.withColumn("v", fx.noisy(F.col("v"), F.col("row"), F.col("col")))
    return quality([("nlm", clean, filters.nlm(noisy, *NLM, a=NLM_A))], "v")


def denoise_psnr_rgb(s, d):
    clean, noisy = fx.f3(s, d), fx.f5rgb(s, d)
    found = [("none", noisy), ("median", filters.median_filter(noisy, MEDIAN, RGB)), ("median_gaussian", filters.median_then_gaussian(noisy, MEDIAN, *GAUSS))]
    return quality([(name, clean, df) for name, df in found], "rgb")


def raw_roundtrip_rgb(s, d):
    path = f"{shared_dir(s)}/roundtrip-{uuid.uuid4().hex}.raw"
    px = to_long(fx.f3(s, d))
    write_raw(px, path)
    return read_raw(s, path, 64, px.agg(F.max("row")).collect()[0][0] + 1, 3)


def png_roundtrip(s, d):
    folder = f"{shared_dir(s)}/png-{uuid.uuid4().hex}"
    images.write_images(to_long(fx.f3(s, d)), folder, "png")
    return tables.read_encoded(s, folder).withColumn("image_id", F.lit(0).cast("long"))


def raw_images(s, d):
    """Three images of one size, written as a file each and read back together."""
    folder = f"{shared_dir(s)}/images-{uuid.uuid4().hex}"
    px = fx.f1(s, d).select(F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("image_id"), "row", "col", "v")
    images.write_images(px.withColumn("v", ((F.col("v") + F.col("image_id")) % 256).cast("int")), folder)
    back = images.read_raw_files(s, folder, 64, px.agg(F.max("row")).collect()[0][0] + 1)
    names = s.range(3).select(F.col("id").alias("k"), F.xxhash64(F.col("id").cast("string")).alias("image_id"))
    return back.join(F.broadcast(names), "image_id").select(F.col("k").alias("image_id"), "row", "col", "v")


def bayer_sites(s, d):
    site = filters.bayer_site(F.col("row"), F.col("col")).alias("site")
    return fx.f1(s, d).groupBy("image_id", site).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def two_images(s, d):
    return fx.f7(s, d).unionByName(fx.f8(s, d).withColumn("image_id", F.lit(1).cast("long")))


RGB = filters.RGB
QUERIES = {
    "histogram_gray": lambda s, d: histogram.histogram(grays(s, d)),
    "histogram_rgb": lambda s, d: histogram.histogram(to_long(fx.f3(s, d)), ("image_id", "ch")),
    "cdf_normalized": lambda s, d: histogram.cdf_normalized(grays(s, d)),
    "intensity_range": lambda s, d: histogram.intensity_range(grays(s, d)),
    "transfer_function": lambda s, d: histogram.transfer_function(grays(s, d)),
    "equalize_lut": lambda s, d: histogram.equalize_lut(fx.f1(s, d)),
    "equalize_bucket": lambda s, d: histogram.equalize_bucket(grays(s, d)),
    "rgb_to_yuv": lambda s, d: rgb_to_yuv(fx.f3(s, d)),
    "yuv_roundtrip": lambda s, d: yuv_to_rgb(rgb_to_yuv(fx.f3(s, d))),
    "equalize_luma_lut": lambda s, d: histogram.equalize_luma(fx.f3(s, d), "lut"),
    "equalize_luma_bucket": lambda s, d: histogram.equalize_luma(fx.f3(s, d), "bucket"),
    "equalize_luma_clahe": lambda s, d: histogram.equalize_luma(fx.f3(s, d), lambda p, y: clahe(p, *CLAHE, value=y)),
    "gray_float32": lambda s, d: gray(fx.f3(s, d), "float"),
    "gray_float64": lambda s, d: gray(fx.f3(s, d)),
    "gray_world_stats": awb_stats,
    "gray_world": lambda s, d: metrics.gray_world(fx.f3(s, d)),
    "demosaic": lambda s, d: filters.demosaic(fx.f1(s, d)),
    "uniform_filter": lambda s, d: filters.uniform_filter(fx.f5(s, d), UNIFORM),
    "gaussian_filter": lambda s, d: filters.gaussian_filter(fx.f5(s, d), *GAUSS),
    "bilateral_filter": lambda s, d: filters.bilateral_filter(fx.f5(s, d), *BILATERAL),
    "median_rgb": lambda s, d: filters.median_filter(fx.f5rgb(s, d), MEDIAN, RGB),
    "gaussian_rgb": lambda s, d: filters.gaussian_filter(fx.f5rgb(s, d), *GAUSS, planes=RGB),
    "nlm_gray": lambda s, d: filters.nlm(fx.f2(s, d), *NLM, a=NLM_A),
    "nlm_rgb": lambda s, d: filters.nlm(rgb_batch(s, d), *NLM, RGB),
    "median_then_gaussian": lambda s, d: filters.median_then_gaussian(fx.f5rgb(s, d), MEDIAN, *GAUSS),
    "median_then_nlm": lambda s, d: filters.median_then_nlm(rgb_batch(s, d), MEDIAN, *NLM),
    "psnr_gray": lambda s, d: rounded(metrics.psnr_gray(fx.f1(s, d), fx.f5(s, d)), "mse", "psnr"),
    "psnr_rgb": lambda s, d: rounded(metrics.psnr_rgb(fx.f3(s, d), fx.f5rgb(s, d)), "psnr_r", "psnr_g", "psnr_b", "psnr_avg"),
    "sobel_gradients": lambda s, d: filters.sobel_gradients(fx.f1(s, d)),
    "sobel_magnitude": lambda s, d: filters.sobel_magnitude(fx.f1(s, d)),
    "sobel_edges": lambda s, d: filters.sobel_edges(fx.f1(s, d), 25.0),
    "edge_candidates": candidates,
    "edge_pr": pr,
    "edge_pr_mean": lambda s, d: edge_eval.edge_pr_mean(pr(s, d)),
    "edge_sweep": sweep,
    "edge_best_threshold": lambda s, d: edge_eval.best_threshold(sweep(s, d)),
    "clahe": lambda s, d: clahe(two_images(s, d), *CLAHE),
    "canny": lambda s, d: canny(fx.f8(s, d), *CANNY),
    "canny_tables": lambda s, d: canny(grays(s, d), *CANNY),
    "raw_roundtrip": raw_roundtrip,
    "raw_roundtrip_rgb": raw_roundtrip_rgb,
    "raw_images": raw_images,
    "png_roundtrip": png_roundtrip,
    "edge_pr_exact": lambda s, d: rounded(pr_exact(s, d), "p", "r"),
    "edge_pr_mean_exact": lambda s, d: rounded(edge_eval.edge_pr_mean(pr_exact(s, d)), "p", "r", "f"),
    "edge_sweep_exact": lambda s, d: rounded(sweep_exact(s, d), "p", "r", "f"),
    "edge_best_exact": lambda s, d: rounded(edge_eval.best_threshold(sweep_exact(s, d)), "p", "r", "f"),
    "histogram_csv": lambda s, d: tables.histogram_lines(histogram.histogram(grays(s, d))),
    "transfer_csv": lambda s, d: tables.transfer_lines(histogram.transfer_function(grays(s, d)).select("image_id", "level", "mapped")),
    "cdf_csv": lambda s, d: tables.cdf_lines(histogram.cdf_normalized(grays(s, d))),
    "rgb_histogram_csv": rgb_histogram_csv,
    "pr_csv": pr_csv,
    "curve_csv": curve_csv,
    "denoise_psnr": denoise_psnr,
    "denoise_psnr_nlm": denoise_psnr_nlm,
    "denoise_psnr_rgb": denoise_psnr_rgb,
    "sobel_pipeline": lambda s, d: filters.sobel_pipeline(fx.f3(s, d)),
    "bayer_sites": bayer_sites,
    "edges_inverted": lambda s, d: filters.invert_binary(filters.sobel_edges(fx.f1(s, d), 25.0)),
}
