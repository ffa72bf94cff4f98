"""The whole run: calibrate, characterise, stack, solve, write; and the same from the command line.

    python -m photonloom.plans.pipeline FRAMES_FOLDER OUTPUT_FOLDER [--solve] [--images]
"""

from __future__ import annotations

import argparse
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import airy_psf, fit_moffat, gaussian_psf, instrument_psf
from ..operators import bayes, calibration, geometry, images, neighbourhood, solver, stacking, stars
from ..sources import fits, store
from . import framewise, posterior
from .staging import cut


@dataclass
class Config:
    reference: int | None = None
    box: int = 128
    snr: float = 5.0
    min_sep: float = 6.0
    max_stars: int = 50
    aperture: float = 4.0
    min_transparency: float | None = None
    max_fwhm: float | None = None
    psf_size: int = 25
    sky_box: int = 128
    cosmic_sigma: float | None = 10.0  # pixels so far above the median are replaced, the cores of bright stars too; None: none
    saturation: float | None = None
    #: How frames are put on the reference's grid: affine (by WCS where there is one, else by stars) or shift (by the stars' shift alone).
    registration: str = "affine"
    #: The stack's grid: the reference frame's, or the union of all frames.
    canvas: str = "reference"
    #: The order of the spline that resamples: 1 or 3.
    order: int = 1
    #: Whether the instrument's maps are read off posteriors that carry over from session to session.
    bayes: bool = False
    temperature: float | None = None  # of this session's sensor, in degrees; dark rates that are carried over follow it
    solve: bool = False
    #: The telescope's: pixel (micrometres), aperture and focal length (mm), wavelength (nm), obstruction (a share).
    optics: tuple[float, float, float, float, float] | None = None
    solver: solver.SolverConfig = field(default_factory=solver.SolverConfig)


def characterise(cal: DataFrame, height: int, width: int, cfg: Config) -> DataFrame:
    """By frame: sky, noise, n_stars, transparency, fwhm, dx, dy against the reference, the first frame unless it is given."""
    px = cal.select("frame_id", "channel", "y", "x", F.col("calibrated").alias("adu"))
    sky = cut(neighbourhood.sigma_clipped(px, ["frame_id"]).select("frame_id", F.col("median").alias("sky")), "sky")
    net = px.join(sky, "frame_id").withColumn("adu", F.col("adu") - F.col("sky")).drop("sky")
    noise = stars.background_noise(net)
    peaks = stars.candidate_peaks(net, noise, height, width, cfg.snr, max(3, int(cfg.min_sep // 2)), border=4)
    kept = stars.isolated(peaks, cfg.min_sep, cfg.max_stars)
    centres = stars.centroids(kept, net).join(kept.select("frame_id", F.col("y").alias("py"), F.col("x").alias("px"), "star_rank"), ["frame_id", "py", "px"]).select("frame_id", "star_rank", "y", "x")
    centres = cut(centres, "centres")
    flux = cut(stars.aperture_flux(centres, net, cfg.aperture), "flux")
    ref = cfg.reference if cfg.reference is not None else cal.agg(F.min("frame_id")).first()[0]
    clear = stars.transparency(flux, flux.where(F.col("frame_id") == ref))
    shift = align(centres, ref)
    sharp = star_widths(net, centres, height, width)
    n = centres.groupBy("frame_id").agg(F.count("*").alias("n_stars"))
    out = sky
    for part in (n, clear.drop("pairs"), sharp, shift):
        out = out.join(part, "frame_id", "left")
    return out.withColumns({"transparency": F.coalesce("transparency", F.lit(1.0)), "dx": F.coalesce("dx", F.lit(0.0)), "dy": F.coalesce("dy", F.lit(0.0)), "rotation": F.coalesce("rotation", F.lit(0.0))})


def align(centres: DataFrame, reference: int) -> DataFrame:
    """dx, dy, rotation, scale_ratio from matched triangles of stars and a robust similarity, frame by frame; frames without enough pairs are absent."""
    from ..functions.kernels import similarity_fit

    tri = stars.triangles(centres, 20)
    votes = stars.star_votes(stars.match_triangles(tri, tri.where(F.col("frame_id") == reference)))
    own = centres.select("frame_id", F.col("star_rank").alias("star"), "y", "x")
    ref = centres.where(F.col("frame_id") == reference).select(F.col("star_rank").alias("ref"), F.col("y").alias("ry"), F.col("x").alias("rx"))
    pairs = votes.join(own, ["frame_id", "star"]).join(F.broadcast(ref), "ref")  # at most the stars of one frame

    def fit(key, pdf):
        import pandas as pd

        best = pdf.sort_values("votes", ascending=False).drop_duplicates("star").drop_duplicates("ref")
        m = similarity_fit(best[["y", "x"]].to_numpy(), best[["ry", "rx"]].to_numpy(), 2.0)
        if m is None:
            return pd.DataFrame(columns=["frame_id", "dx", "dy", "rotation", "scale_ratio"])
        return pd.DataFrame([(key[0], m["tx"], m["ty"], m["rotation"], m["scale"])], columns=["frame_id", "dx", "dy", "rotation", "scale_ratio"])

    kind = dict(centres.dtypes)["frame_id"]
    return pairs.groupBy("frame_id").applyInPandas(fit, f"frame_id {kind}, dx double, dy double, rotation double, scale_ratio double")


def star_widths(net: DataFrame, centres: DataFrame, height: int, width: int, half: int = 7) -> DataFrame:
    """The median fitted FWHM of each frame's ten brightest stars away from the edge."""
    frames = images.images_of(net, height, width)
    places = centres.where("star_rank < 10").groupBy("frame_id").agg(F.collect_list(F.struct("y", "x")).alias("stars"))

    def work(image, row):
        found = []
        for s in row["stars"]:
            y, x = round(s["y"]), round(s["x"])
            if half <= y < height - half and half <= x < width - half:
                found.append(fit_moffat(image[y - half : y + half + 1, x - half : x + half + 1], 60)["fwhm"])
        return [(row["frame_id"], float(np.median(found)))] if found else []

    kind = dict(net.dtypes)["frame_id"]
    return images.measure_images(frames.join(places, "frame_id"), f"frame_id {kind}, fwhm double", work, ["stars"])


def run(frames: DataFrame, cfg: Config | None = None, model: DataFrame | None = None, state: DataFrame | None = None) -> dict[str, DataFrame]:
    """Products of frames(frame_id, seq, frame_type, exposure_s, h, w, data, bayer_pattern for a colour sensor, crpix1..cd22 where known): model, frames, stack, canvas and, if asked for, solution.

    With cfg.bayes the model comes from posteriors: those of an earlier session
    (state, as store.load_state has it) carried over to this one, or weak priors,
    updated by the frames; they are returned as state.

    Lights are calibrated, their hot and cosmic-ray pixels replaced, and
    characterised in one pass; a second one moves and adds them up.
    """
    cfg = cfg or Config()
    frames = calibration.check_shape(frames)
    spark = frames.sparkSession
    h, w = frames.select("h", "w").first()
    lights = frames.where("frame_type = 'light'")
    pattern = framewise.is_colour(lights)
    after = None
    if cfg.bayes:
        before = posterior.start(h, w) if state is None else posterior.state_of(bayes.carry_over(state, cfg.temperature), h, w)
        after = posterior.updated(frames, before)
        maps = posterior.maps_of(after)
        model = cut(framewise.model_table(spark, maps, h), "model")
    elif model is None:
        maps = framewise.fit_model(frames)
        model = cut(framewise.model_table(spark, maps, h), "model")
    else:
        maps = framewise.maps_of(model, h, w)
    seen = cut(framewise.characterised(lights, maps, cfg, pattern), "calibrated")
    reference = cfg.reference if cfg.reference is not None else seen.agg(F.min("frame_id")).first()[0]
    meta = cut(examined(seen, lights, reference, cfg, pattern), "frames")
    good = meta.where("stacked")
    size = (h // 2, w // 2) if pattern else (h, w)
    canvas = framewise.union_canvas(good, *size) if cfg.canvas == "union" else framewise.Canvas(*size)
    sums = framewise.stacked(seen, good, pattern, canvas, cfg.order)
    out = {"model": model, "frames": meta, "stack": stacking.derive(sums, good.count()), "canvas": spark.createDataFrame([asdict(canvas)], CANVAS)}
    if after is not None:
        known = cfg.temperature if cfg.temperature is not None else bayes.Priors().dark_temperature if state is None else state.agg(F.first("ref_temp_c")).first()[0]
        out["state"] = posterior.table(spark, after, float(known))
    if cfg.solve:
        rows = solved(out["stack"], seen, good, canvas, cfg, pattern)
        out |= {"solution": solver.flux_of(rows).select("channel", "y", "x", "flux"), "history": solver.history_of(rows, cfg.solver.tolerance)}
    return out


CANVAS = "rows int, cols int, row0 int, col0 int"


def examined(seen: DataFrame, lights: DataFrame, reference, cfg: Config, pattern: str | None) -> DataFrame:
    """The frames against the reference, where they lie on its grid, and whether they are fit to be stacked."""
    meta = framewise.with_psf_frame(framewise.registered(framewise.compared(seen, reference), lights, reference, cfg.registration, bool(pattern)), lights)
    good = stacking.quality_filter(meta, cfg.min_transparency, cfg.max_fwhm).select("frame_id", F.lit(True).alias("stacked"))
    return meta.join(good, "frame_id", "left").withColumn("stacked", F.coalesce("stacked", F.lit(False)))


def psf_of(fwhm: float | None, cfg: Config) -> np.ndarray:
    """A Gaussian of the measured width on the fine grid; unmeasured, of the usual width, behind the telescope's diffraction where its optics are known."""
    blur = gaussian_psf(cfg.psf_size, (fwhm or 3.0) * cfg.solver.scale)
    if fwhm or not cfg.optics:
        return blur
    pixel_um, *optics = cfg.optics
    return instrument_psf(airy_psf(cfg.psf_size, pixel_um / cfg.solver.scale, *optics), blur)


def solved(stack: DataFrame, seen: DataFrame, good: DataFrame, canvas: framewise.Canvas, cfg: Config, pattern: str | None) -> DataFrame:
    """The solution by the configured mode: fast from the stack, exact from the frames where they lie, each with its PSF, or that of the frame before it, or a Gaussian of its width."""
    if cfg.solver.mode == "fast":
        rows = good.select("transparency", "fwhm").collect()  # two numbers a frame
        each = [{"t": r.transparency, "psf": psf_of(r.fwhm, cfg)} for r in rows]
        return solver.solve_all(cfg.solver, stack, each, canvas.rows, canvas.cols)
    if canvas.row0 or canvas.col0 or pattern:
        raise ValueError("the exact mode solves the reference's grid of a sensor without colour")
    t = lambda c: F.col(f"to_reference.{c}")
    frames = seen.select("frame_id", "data").join(good.select("frame_id", "sky", "transparency", "fwhm", "to_reference", "psf_frame"), "frame_id")
    frames = frames.join(seen.where("psf IS NOT NULL").select(F.col("frame_id").alias("psf_frame"), "psf"), "psf_frame", "left")
    rows = frames.select(
        "frame_id", F.lit("L").alias("channel"), F.transform("data", lambda v: F.greatest(v - F.col("sky"), F.lit(0.0))).alias("data"), "transparency", F.coalesce("fwhm", F.lit(3.0)).alias("fwhm"), "psf",
        # the scene as the frame sees it: the inverse of where the frame lies, about the middle
        *solver.seen_from({c: t(c) for c in framewise.AFFINE}, canvas.rows, canvas.cols),
    )
    return solver.solve_all(cfg.solver, stack, [], canvas.rows, canvas.cols, rows, cfg.psf_size)


def resume(frames: DataFrame, folder: str, cfg: Config | None = None) -> dict[str, DataFrame]:
    """The products of folder with the frames that it hasn't seen, by id; the stored model and reference stay."""
    spark = frames.sparkSession
    stack, meta = store.load_stack(spark, folder)
    model, about = store.load_model(spark, folder)
    cfg = cfg or Config()
    cfg.reference = int(about["reference"])
    lights = frames.where("frame_type = 'light'")
    todo = stacking.remaining(lights, meta.select("frame_id"))
    if todo.isEmpty():
        return {"model": model, "frames": meta, "stack": stack}
    h, w = frames.select("h", "w").first()
    pattern = framewise.is_colour(lights)
    again = lights.where(F.col("frame_id") == cfg.reference).unionByName(todo).distinct()
    seen = cut(framewise.characterised(again, framewise.maps_of(model, h, w), cfg, pattern), "calibrated")
    fresh = cut(examined(seen, again, cfg.reference, cfg, pattern).where(F.col("frame_id") != cfg.reference), "frames")
    canvas = framewise.Canvas(*[int(about[c]) for c in ("rows", "cols", "row0", "col0")]) if about.get("rows") else None
    sums = framewise.stacked(seen.where(F.col("frame_id") != cfg.reference), fresh.where("stacked"), pattern, canvas, cfg.order)
    both = stacking.merge(stack.select(*calibration.PIXEL, *stacking.SUMS), sums)
    every = meta.unionByName(fresh.select(*meta.columns))
    return {"model": model, "frames": every, "stack": stacking.derive(both, every.where("stacked").count())}


def save(products: dict[str, DataFrame], folder: str, reference: int, session: str = "s0", images: bool = False) -> dict[str, str]:
    """Stores the products, posteriors in a version of their own for each session, and returns where each is.

    images: also as FITS files, for a folder that all tasks can write to as local.
    """
    canvas = products["canvas"].first().asDict() if "canvas" in products else {}
    store.save_model(products["model"], {"reference": reference, **canvas}, folder)
    store.save_stack(products["stack"], products["frames"], folder)
    where = {"model": f"{folder}/instrument", "stack": f"{folder}/stack/pixels", "frames": f"{folder}/stack/frames"}
    if "state" in products:
        store.save_state(products["state"], folder, session)
        where["state"] = f"{folder}/bayes"
    for name in ("solution", "history"):
        if name in products:
            where[name] = f"{folder}/{name}"
            products[name].write.mode("overwrite").parquet(where[name])
    if images:
        where["images"] = f"{folder}/images"
        stack, meta = store.load_stack(products["stack"].sparkSession, folder)
        size = canvas.get("rows"), canvas.get("cols")
        store.write_products(store.stack_products(stack, meta.where("stacked"), *size), where["images"])
        if "solution" in products:
            solution = stack.sparkSession.read.parquet(where["solution"])
            store.write_products(store.solution_products(solution, stack, *size), where["images"])
    return where


def frames_from(spark: SparkSession, folder: str) -> DataFrame:
    """The frames of a folder of FITS files, in order of their paths."""
    d = fits.with_wcs(fits.header_values(fits.discover(fits.read_shared(spark, folder).where("_error IS NULL")), 300.0))
    first = F.lit(0).cast("long")
    order = d.select("path").distinct().withColumn("frame_id", F.row_number().over(Window.orderBy("path")).cast("long") - 1)  # names of files alone
    return d.join(order, "path").select("frame_id", F.col("frame_id").alias("seq"), "frame_type", "exposure_s", "bayer_pattern", "h", "w", "data", *geometry.WCS).withColumn("session", first)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Calibrates, stacks and solves the frames of a folder.")
    p.add_argument("frames")
    p.add_argument("output")
    p.add_argument("--solve", action="store_true")
    p.add_argument("--images", action="store_true", help="also write FITS files")
    p.add_argument("--scale", type=int, default=2)
    p.add_argument("--min-transparency", type=float)
    p.add_argument("--max-fwhm", type=float)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("photonloom").getOrCreate()
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        spark.conf.set("spark.checkpoint.dir", f"{a.output}/_staging")  # the output is where all can write
    frames = frames_from(spark, a.frames)
    fits.require_lights(frames.where("frame_type = 'light'"))
    cfg = Config(min_transparency=a.min_transparency, max_fwhm=a.max_fwhm, solve=a.solve, solver=solver.SolverConfig(scale=a.scale))
    out = run(frames, cfg)
    save(out, a.output, frames.where("frame_type = 'light'").agg(F.min("frame_id")).first()[0], images=a.images)
    print(store.summary_text(out["frames"], "sky", "transparency", "fwhm", "dx", "dy"))


if __name__ == "__main__":
    main()
