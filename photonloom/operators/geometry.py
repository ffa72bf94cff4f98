"""Optics and sky geometry as column expressions: plate scale, TAN projection both ways, shifts between frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARCSEC = 3600.0
AIRY_ZERO = 1.219669891266504  # first zero of the Airy pattern in units of lambda / D


def scope(df: DataFrame) -> DataFrame:
    """df(focal_mm, aperture_mm, pixel_um, wavelength_nm) with plate_scale (arcsec a pixel), f_number, airy_arcsec and airy_px (radii)."""
    scale = F.lit(math.degrees(1) * ARCSEC) * F.col("pixel_um") * 1e-3 / F.col("focal_mm")
    airy = F.lit(AIRY_ZERO * math.degrees(1) * ARCSEC) * F.col("wavelength_nm") * 1e-6 / F.col("aperture_mm")
    return df.withColumns({"plate_scale": scale, "f_number": F.col("focal_mm") / F.col("aperture_mm"), "airy_arcsec": airy, "airy_px": airy / scale})


def wcs_geometry(df: DataFrame) -> DataFrame:
    """df(cd11..cd22 or cdelt1, cdelt2, crota2) with the matrix filled in, scale (arcsec a pixel), position angle and flip_x; null without either."""
    r = F.radians(F.coalesce("crota2", F.lit(0.0)))
    cd = {
        "cd11": F.coalesce("cd11", F.col("cdelt1") * F.cos(r)), "cd12": F.coalesce("cd12", -F.col("cdelt2") * F.sin(r)),
        "cd21": F.coalesce("cd21", F.col("cdelt1") * F.sin(r)), "cd22": F.coalesce("cd22", F.col("cdelt2") * F.cos(r)),
    }
    out = df.withColumns(cd)
    det = F.col("cd11") * F.col("cd22") - F.col("cd12") * F.col("cd21")
    angle = F.pmod(F.degrees(F.atan2("cd12", "cd22")), F.lit(360.0))
    return out.withColumns({"scale": F.hypot("cd11", "cd21") * ARCSEC, "position_angle": angle, "flip_x": det > 0, "flip_y": F.lit(False)})


def pixel_to_sky(x: Column, y: Column, w: str = "") -> dict[str, Column]:
    """ra and dec (degrees) of a pixel counted from 0, by the TAN projection of the columns w+crpix1..cd22."""
    c = lambda n: F.col(f"{w}{n}")
    u, v = x + 1 - c("crpix1"), y + 1 - c("crpix2")
    xi, eta = F.radians(c("cd11") * u + c("cd12") * v), F.radians(c("cd21") * u + c("cd22") * v)
    ra0, dec0 = F.radians(c("crval1")), F.radians(c("crval2"))
    den = F.cos(dec0) - eta * F.sin(dec0)
    ra = F.pmod(F.degrees(ra0 + F.atan2(xi, den)), F.lit(360.0))
    dec = F.degrees(F.atan2(F.sin(dec0) + eta * F.cos(dec0), F.hypot(xi, den)))
    return {"ra": ra, "dec": dec}


def sky_to_pixel(ra: Column, dec: Column, w: str = "") -> dict[str, Column]:
    """x and y (from 0) of a place on the sky; null behind the tangent plane."""
    c = lambda n: F.col(f"{w}{n}")
    d, ra0, dec0 = F.radians(dec), F.radians(c("crval1")), F.radians(c("crval2"))
    h = F.radians(ra) - ra0
    den = F.sin(d) * F.sin(dec0) + F.cos(d) * F.cos(dec0) * F.cos(h)
    den = F.when(den > 0, den)
    xi, eta = F.degrees(F.cos(d) * F.sin(h) / den), F.degrees((F.sin(d) * F.cos(dec0) - F.cos(d) * F.sin(dec0) * F.cos(h)) / den)
    det = c("cd11") * c("cd22") - c("cd12") * c("cd21")
    u, v = (c("cd22") * xi - c("cd12") * eta) / det, (c("cd11") * eta - c("cd21") * xi) / det
    return {"x": u + c("crpix1") - 1, "y": v + c("crpix2") - 1}


def frame_shift(frames: DataFrame, reference: DataFrame, height: int, width: int) -> DataFrame:
    """frames with dx_to_ref, dy_to_ref, dx_arcsec, dy_arcsec, rotation and scale_ratio against the one reference row.

    The frame's centre and a point a quarter of its smaller side to the right
    go through the sky to the reference's pixels.
    """
    names = ["crpix1", "crpix2", "crval1", "crval2", "cd11", "cd12", "cd21", "cd22"]
    ref = F.broadcast(reference.select(*[F.col(n).alias(f"r_{n}") for n in names]))
    d = frames.join(ref)
    cx, cy, arm = (width - 1) / 2, (height - 1) / 2, min(height, width) / 4
    for k, x in enumerate((cx, cx + arm)):
        d = d.withColumns({f"__{n}{k}": c for n, c in pixel_to_sky(F.lit(float(x)), F.lit(float(cy))).items()})
        d = d.withColumns({f"__{n}{k}": c for n, c in sky_to_pixel(F.col(f"__ra{k}"), F.col(f"__dec{k}"), "r_").items()})
    angle = lambda w: F.degrees(F.atan2(F.col(f"{w}cd12"), F.col(f"{w}cd22")))
    turn = F.pmod(angle("r_") - angle("") + 180, F.lit(360.0)) - 180
    scale = F.hypot("r_cd11", "r_cd21") * ARCSEC
    d = d.withColumns({"dx_to_ref": F.col("__x0") - cx, "dy_to_ref": F.col("__y0") - cy, "rotation": turn, "scale_ratio": F.hypot(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0")) / arm})
    d = d.withColumns({"dx_arcsec": F.col("dx_to_ref") * scale, "dy_arcsec": F.col("dy_to_ref") * scale, "shift_px": F.hypot("dx_to_ref", "dy_to_ref")})
    return d.drop(*[f"__{n}{k}" for n in ("ra", "dec", "x", "y") for k in (0, 1)], *[f"r_{n}" for n in names])


WCS = ("crpix1", "crpix2", "crval1", "crval2", "cd11", "cd12", "cd21", "cd22")


def through_sky(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """x and y on the grid of the columns target+crpix1..cd22 of a place on that of source+crpix1..cd22."""
    sky = pixel_to_sky(x, y, source)
    at = sky_to_pixel(sky["ra"], sky["dec"], target)
    return at["x"], at["y"]


def canvas_affine(rows: int, cols: int, row0: int = 0, col0: int = 0, planes: int = 1, own: str = "", ref: str = "r_") -> dict[str, Column]:
    """a..f, which take canvas (x, y) to frame (ax+by+c, dx+ey+f), from the frame's and the reference's WCS; null where one is unknown.

    The canvas's middle and two points a quarter of its smaller side away go
    through the sky; their differences are the Jacobian. The reference begins
    at row0, col0; planes is 2 for a colour sensor's half-size planes.
    """
    cx, cy, arm = (cols - 1) / 2, (rows - 1) / 2, min(rows, cols) / 4
    spots = [through_sky(F.lit(float((x - col0) * planes)), F.lit(float((y - row0) * planes)), ref, own) for x, y in ((cx, cy), (cx + arm, cy), (cx, cy + arm))]
    (x0, y0), (x1, y1), (x2, y2) = [(x / planes, y / planes) for x, y in spots]
    a, b, d, e = (x1 - x0) / arm, (x2 - x0) / arm, (y1 - y0) / arm, (y2 - y0) / arm
    return {"a": a, "b": b, "c": x0 - a * cx - b * cy, "d": d, "e": e, "f": y0 - d * cx - e * cy}


def projected_corners(height: int, width: int, planes: int = 1, own: str = "", ref: str = "r_") -> Column:
    """The four corners of a frame on the reference's grid: an array of (y, x)."""
    spots = [through_sky(F.lit(float(x * planes)), F.lit(float(y * planes)), own, ref) for y in (0, height - 1) for x in (0, width - 1)]
    return F.array(*[F.struct((y / planes).alias("y"), (x / planes).alias("x")) for x, y in spots])


def half_resolution(shift: DataFrame) -> DataFrame:
    """A shift on the grid of colour planes: half the pixels, the same angles."""
    return shift.withColumns({"dx_to_ref": F.col("dx_to_ref") / 2, "dy_to_ref": F.col("dy_to_ref") / 2})


def parse_angle(text: Column, hours: bool = False) -> Column:
    """Degrees from a number or from 'DD MM SS' with blanks or colons; hours count 15 degrees each, a plain number is degrees."""
    t = F.trim(text)
    parts = F.split(t, r"[:\s]+")
    n = lambda i: F.coalesce(F.expr("double(0)") + F.get(parts, F.lit(i)).try_cast("double"), F.lit(0.0))
    size = F.abs(n(0)) + n(1) / 60 + n(2) / 3600
    value = F.when(t.startswith("-"), -size).otherwise(size) * (15 if hours else 1)
    return F.when(F.size(parts) > 1, value).otherwise(t.try_cast("double"))


def resolve_shift(is_reference: Column, by_wcs: Column, by_stars: Column) -> Column:
    """Null for the reference, else the shift from the sky or, failing that, from star triangles."""
    return F.when(~is_reference, F.coalesce(by_wcs, by_stars))


def gaussian_kernel(spark, size: int, fwhm: float) -> DataFrame:
    """ky, kx, w of a Gaussian kernel of sum 1."""
    s = fwhm / (2 * math.sqrt(2 * math.log(2)))
    return _kernel(spark, size, lambda r2: F.exp(-r2 / (2 * s * s)))


def moffat_kernel(spark, size: int, fwhm: float, beta: float) -> DataFrame:
    """ky, kx, w of a Moffat kernel of sum 1."""
    alpha = fwhm / (2 * math.sqrt(2 ** (1 / beta) - 1))
    return _kernel(spark, size, lambda r2: F.pow(1 + r2 / (alpha * alpha), F.lit(-beta)))


def _kernel(spark, size: int, value) -> DataFrame:
    y, x = (F.col("id") / size).cast("int"), (F.col("id") % size).cast("int")
    r2 = F.pow(y - size // 2, F.lit(2.0)) + F.pow(x - size // 2, F.lit(2.0))
    k = spark.range(0, size * size, 1, 1).select(y.alias("ky"), x.alias("kx"), value(r2).alias("v"))
    return k.join(F.broadcast(k.agg(F.sum("v").alias("s")))).select("ky", "kx", (F.col("v") / F.col("s")).alias("w"))


def shift_record(frames: DataFrame, sentinel: float = -9999.0) -> DataFrame:
    """frames with shift, a struct of the columns that a shift was stored in; null where they hold the mark of no shift."""
    names = ["dx_px", "dy_px", "dx_arcsec", "dy_arcsec", "rotation_deg", "scale_ratio"]
    known = F.abs(F.col("dx_px") - sentinel) >= 1
    return frames.withColumn("shift", F.when(known, F.struct(*names))).drop(*names)
