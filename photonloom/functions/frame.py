"""What is done to one image of a sensor at a time, on arrays: calibration, defects, sky, stars, registration, resampling."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .kernels import fit_moffat, fourier_shift, similarity_fit

#: Robust deviation from the median of absolute differences (fixed value).
MAD = 1.4826


def calibrated(adu: np.ndarray, t: float, maps: dict[str, np.ndarray]) -> np.ndarray:
    """(adu - bias - dark * t) / gain; gains up to 0.01 count as 1."""
    gain = maps["flat_gain"]
    return (adu - maps["bias_mean"] - maps["dark_rate"] * t) / np.where(gain > 0.01, gain, 1.0)


def replaced(image: np.ndarray, mask: np.ndarray, radius: int = 2) -> np.ndarray:
    """image with the pixels of mask replaced by the median of their (2 radius + 1)^2 neighbourhood, mirrored at the edges."""
    y, x = np.nonzero(mask)
    if not len(y):
        return image
    padded = np.pad(image, radius, mode="symmetric")
    span = range(2 * radius + 1)
    out = image.copy()
    out[y, x] = np.median(np.stack([padded[y + j, x + i] for j in span for i in span]), axis=0)
    return out


def outliers(image: np.ndarray, sigma: float = 10.0) -> np.ndarray:
    """Pixels far above the image's median: cosmic rays and what the map of hot pixels doesn't have."""
    m = np.median(image)
    return image > m + sigma * MAD * np.median(np.abs(image - m))


def clipped_median(v: np.ndarray, sigma: float = 3.0, rounds: int = 3) -> float:
    lo, hi = -np.inf, np.inf
    for _ in range(rounds):
        inside = v[(v > lo) & (v < hi)]
        m = np.median(inside)
        s = MAD * np.median(np.abs(inside - m))
        if s < 1e-9:
            break
        lo, hi = max(lo, m - sigma * s), min(hi, m + sigma * s)
    return float(np.median(v[(v > lo) & (v < hi)]))


def tile_bounds(n: int, size: int, box: int) -> list[tuple[int, int]]:
    """n overlapping spans of about box along an axis, their middles spread evenly from edge to edge."""
    middles = [k * (size - 1) / (n - 1) for k in range(n)]
    return [(max(0, round(m - box / 2)), min(size, round(m + box / 2))) for m in middles]


def tile_median(v: np.ndarray, sigma: float = 3.0, rounds: int = 3) -> float:
    """The median of what rounds of clipping leave; what lies just at the bound stays, and fewer than four values, or ones without spread, are clipped no more."""
    kept = v
    for _ in range(rounds):
        if kept.size < 4:
            break
        m = np.median(kept)
        s = MAD * np.median(np.abs(kept - m))
        if s < 1e-6:
            break
        kept = kept[(kept >= m - sigma * s) & (kept <= m + sigma * s)]
    return float(np.median(kept))


def sky_mesh(image: np.ndarray, box: int = 128) -> np.ndarray:
    """The sky in overlapping tiles: two along each axis, or as many as boxes fit in."""
    rows, cols = (tile_bounds(max(2, n // box), n, box) for n in image.shape)
    whole: dict[tuple, float] = {}  # on a small frame all tiles are the frame
    for a, b in rows:
        for c, d in cols:
            if (a, b, c, d) not in whole:
                whole[a, b, c, d] = tile_median(image[a:b, c:d].ravel())
    return np.array([[whole[a, b, c, d] for c, d in cols] for a, b in rows])


def aligned_psf(net: np.ndarray, stars: np.ndarray, size: int, min_stars: int = 5, farthest: float = 4.0) -> np.ndarray | None:
    """The median of the stars' stamps, each of sum 1 and moved by a fraction of pixels so that its centre of gravity is the stamp's middle; not below 0, of sum 1.

    None from fewer than min_stars stamps; stars whose stamp leaves the frame,
    has no light, or has its centre farther off, aren't used.
    """
    half = size // 2
    size = 2 * half + 1
    y, x = np.mgrid[:size, :size]
    stamps = []
    for b, a in np.rint(stars[:, :2]).astype(int):
        if half <= b < net.shape[0] - half and half <= a < net.shape[1] - half:
            stamp = net[b - half : b + half + 1, a - half : a + half + 1]
            light = np.maximum(stamp, 0.0)
            if stamp.sum() <= 0 or light.sum() <= 0:
                continue
            dy, dx = half - (light * y).sum() / light.sum(), half - (light * x).sum() / light.sum()
            if max(abs(dy), abs(dx)) <= farthest:
                stamps.append(fourier_shift(stamp / stamp.sum(), dy, dx))
    if len(stamps) < min_stars:
        return None
    psf = np.maximum(np.median(stamps, axis=0), 0.0)
    return psf / psf.sum() if psf.sum() > 0 else None


def finer_psf(psf: np.ndarray, scale: int) -> np.ndarray:
    """A kernel on a grid `scale` times as fine, by its cubic spline; not below 0, of sum 1."""
    if scale == 1:
        return psf
    n = psf.shape[0]
    size = (n - 1) * scale + 1
    step = 1 / scale
    fine = np.maximum(np.nan_to_num(resampled_cubic(psf, (step, 0.0, 0.0, 0.0, step, 0.0), size, size)), 0.0)
    return fine / fine.sum()


def noise(net: np.ndarray) -> float:
    """The deviation of the pixels below the 60th percentile; at least 1, and 1 with 100 pixels or fewer."""
    low = net[net < np.quantile(net, 0.6)]
    return max(float(low.std()), 1.0) if low.size > 100 else 1.0


def maximum_filter(image: np.ndarray, size: int) -> np.ndarray:
    """The largest value in size x size around each pixel, first along rows, then along columns."""
    lo, hi = size // 2, size - 1 - size // 2
    for axis in (1, 0):
        n = image.shape[axis]
        padded = np.pad(image, [(0, 0), (lo, hi)] if axis else [(lo, hi), (0, 0)], constant_values=-np.inf)
        image = np.max([np.take(padded, range(k, k + n), axis=axis) for k in range(size)], axis=0)
    return image


def find_stars(net: np.ndarray, snr: float, min_sep: float, max_stars: int, aperture: float, border: int = 4, saturated: np.ndarray | None = None) -> np.ndarray:
    """(y, x, flux) of the brightest isolated peaks, in order of their height; peaks whose 5 x 5 stamp touches a saturated pixel are no stars."""
    peak = (net == maximum_filter(net, max(3, int(min_sep // 2)))) & (net > snr * noise(net))
    peak[:border], peak[-border:], peak[:, :border], peak[:, -border:] = False, False, False, False
    if saturated is not None:
        peak &= maximum_filter(saturated.astype(float), 5) < 1
    y, x = np.nonzero(peak)
    order = np.lexsort((x, y, -net[y, x]))
    kept: list[tuple[int, int]] = []
    for b, a in zip(y[order].tolist(), x[order].tolist()):
        if all((b - p) ** 2 + (a - q) ** 2 >= min_sep**2 for p, q in kept):
            kept.append((b, a))
            if len(kept) == max_stars:
                break
    return np.array([(*(c := centre(net, b, a)), flux(net, *c, aperture)) for b, a in kept]).reshape(-1, 3)


def box(image: np.ndarray, y: int, x: int, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y0, x0 = max(y - r, 0), max(x - r, 0)
    part = image[y0 : y + r + 1, x0 : x + r + 1]
    ys, xs = np.mgrid[y0 : y0 + part.shape[0], x0 : x0 + part.shape[1]]
    return part, ys, xs


def centre(net: np.ndarray, y: int, x: int, radius: int = 2) -> tuple[float, float]:
    """The centre of gravity of what is above 0 around a peak."""
    part, ys, xs = box(net, y, x, radius)
    v = np.maximum(part, 0.0)
    return (float((v * ys).sum() / v.sum()), float((v * xs).sum() / v.sum())) if v.sum() > 0 else (float(y), float(x))


def flux(net: np.ndarray, y: float, x: float, radius: float) -> float:
    """The sum within radius, less the median of the ring from 1.5 to 2.5 radii."""
    part, ys, xs = box(net, round(y), round(x), int(2.5 * radius) + 1)
    d = np.hypot(ys - y, xs - x)
    inside, ring = part[d <= radius], part[(d > 1.5 * radius) & (d <= 2.5 * radius)]
    return float(inside.sum() - inside.size * (np.median(ring) if ring.size else 0.0))


def width(net: np.ndarray, stars: np.ndarray, half: int = 7) -> float | None:
    """The median fitted width of the ten brightest stars away from the edge."""
    found = []
    for y, x in np.rint(stars[:10, :2]).astype(int):
        if half <= y < net.shape[0] - half and half <= x < net.shape[1] - half:
            found.append(fit_moffat(net[y - half : y + half + 1, x - half : x + half + 1], 60)["fwhm"])
    return float(np.median(found)) if found else None


def clear_sky(flux_: np.ndarray, ref: np.ndarray) -> float:
    """The median ratio of fluxes to the reference's of the same rank, between 0.01 and 1.5; 1 with fewer than two pairs."""
    n = min(len(flux_), len(ref))
    ok = (flux_[:n] > 0) & (ref[:n] > 0)
    return float(np.clip(np.median(flux_[:n][ok] / ref[:n][ok]), 0.01, 1.5)) if ok.sum() >= 2 else 1.0


@lru_cache(maxsize=8)
def corners_of(n: int) -> np.ndarray:
    """The triangles of n stars: rows of three numbers, in order."""
    r = np.arange(n)
    out = np.argwhere((r[:, None, None] < r[:, None]) & (r[:, None] < r)).reshape(-1, 3)
    out.flags.writeable = False  # held for all callers
    return out


def triangle_shapes(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (three numbers of stars) and shapes (a / c, b / c of the sides a <= b <= c) of all triangles."""
    corners, (y, x) = corners_of(len(places)), places.T
    far = np.sqrt((y[:, None] - y) ** 2 + (x[:, None] - x) ** 2).ravel()
    d, e, f = (far[corners[:, p] * len(places) + corners[:, q]] for p, q in ((0, 1), (0, 2), (1, 2)))
    low, high = np.minimum(d, e), np.maximum(d, e)
    side = np.stack([np.minimum(low, f), np.maximum(low, np.minimum(high, f)), np.maximum(high, f)])
    ok = side[2] >= 1e-6
    if not ok.all():
        corners, side = corners[ok], side[:, ok]
    return corners, (side[:2] / side[2]).T


class ShapeIndex:
    """Reference shapes (two numbers from 0 to 1), ready to be asked for the nearest one within tol.

    The square of shapes is halved both ways again and again. A cell keeps those
    of its parent's references that can be the nearest of some place in it: none
    that is farther from its middle than the nearest there by the cell's
    diameter. In the last cells, several times narrower than references lie
    apart on average, few are left; a shape is compared with its cell's alone.
    """

    def __init__(self, ref: np.ndarray, tol: float, most: int = 1_000_000):
        self.tol = tol
        first = np.sort(np.unique(ref, axis=0, return_index=True)[1])  # of equal shapes the first is the answer
        first = first[np.isfinite(ref[first]).all(axis=1)]
        u, v = ref[first].T.copy()
        cell, own, held = np.zeros((min(len(first), 1), 2), dtype=np.int64), np.zeros(len(first), dtype=np.int64), np.arange(len(first))
        self.side = 1
        while self.side < 6 * np.sqrt(len(first)) and len(held) <= most:  # many alike are left together
            self.side *= 2
            radius, parts, made = np.sqrt(0.5) / self.side, [], 0
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            for quarter in ((0, 0), (0, 1), (1, 0), (1, 1)):
                child = 2 * cell + quarter
                y, x = ((child + 0.5) / self.side)[own].T
                d = np.sqrt((u[held] - y) ** 2 + (v[held] - x) ** 2)
                near = np.minimum.reduceat(d, starts)[own]
                keep = d <= np.minimum(near + 2 * radius, tol + radius) + 1e-8  # what ties to 1e-9 stays too
                live, at = np.unique(own[keep], return_inverse=True)
                parts.append((child[live], at + made, held[keep]))
                made += len(live)
            cell, own, held = (np.concatenate(p) for p in zip(*parts))
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        self.start, self.size = np.zeros(self.side**2, dtype=np.int64), np.zeros(self.side**2, dtype=np.int64)
        self.start[cell @ (self.side, 1)], self.size[cell @ (self.side, 1)] = starts, np.diff(np.append(starts, len(own)))
        self.held, self.u, self.v = first[held], u[held], v[held]
        self.scale = 2.0 ** np.ceil(np.log2(max(len(ref), 1)))

    def nearest(self, shapes: np.ndarray, block: int = 1_000_000) -> np.ndarray:
        """For each of shapes the place of the nearest reference within tol, or -1; of those equally near to 1e-9 the first."""
        out = np.full(len(shapes), -1)
        with np.errstate(invalid="ignore"):
            y, x = np.clip((shapes.T * self.side).astype(np.int64), 0, self.side - 1)
        cell = y * self.side + x
        rows = np.flatnonzero(self.size[cell])
        cell, ends = cell[rows], np.cumsum(self.size[cell[rows]])
        cuts = np.flatnonzero(np.diff(ends // block, prepend=0, append=-1))  # a block's comparisons are held at once
        for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
            if lo < hi:
                self.compared(shapes[rows[lo:hi]], cell[lo:hi], rows[lo:hi], out)
        return out

    def compared(self, shapes: np.ndarray, cell: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        """Sets out at rows to the best reference of each shape's cell."""
        size = self.size[cell]
        starts = np.cumsum(size) - size
        at = np.arange(starts[-1] + size[-1]) + np.repeat(self.start[cell] - starts, size)
        du, dv = (np.repeat(own, size) - ref[at] for own, ref in zip(shapes.T, (self.u, self.v)))
        d = np.sqrt(du * du + dv * dv)
        rank = np.rint(d * 1e9) * self.scale + self.held[at]  # whole numbers below 2^53: steps of 1e-9, then the place
        rank[~(d <= self.tol)] = np.inf
        best = np.minimum.reduceat(rank, starts)
        ok = best < np.inf
        out[rows[ok]] = np.mod(best[ok], self.scale).astype(np.int64)


@lru_cache(maxsize=2)
def _index(ref: bytes, tol: float) -> ShapeIndex:
    return ShapeIndex(np.frombuffer(ref).reshape(-1, 2), tol)


def shape_index(ref: np.ndarray, tol: float) -> ShapeIndex:
    """The index of reference shapes; a process makes it once, however many tasks ask for it."""
    return _index(np.ascontiguousarray(ref, dtype=float).tobytes(), tol)


def nearest_shapes(shapes: np.ndarray, ref: np.ndarray, tol: float) -> np.ndarray:
    """For each of shapes the place of the nearest of ref within tol, or -1; of those equally near to 1e-9 the first."""
    return shape_index(ref, tol).nearest(shapes) if len(shapes) and len(ref) else np.full(len(shapes), -1)


class Reference:
    """A reference frame's stars (y, x, in order of brightness), with the index of their triangles."""

    def __init__(self, stars: np.ndarray, limit: int = 20, tol: float = 0.02):
        self.stars, self.limit = stars[:limit, :2], limit
        self.corners, shapes = triangle_shapes(self.stars)
        self.index = shape_index(shapes, tol)

    def votes(self, stars: np.ndarray) -> np.ndarray:
        """How many triangles say that a star (row) is one of the reference's (column)."""
        corners, shapes = triangle_shapes(stars[: self.limit, :2])
        match = self.index.nearest(shapes)
        shape, ok = (min(len(stars), self.limit), len(self.stars)), match >= 0
        return np.bincount((corners[ok] * shape[1] + self.corners[match[ok]]).ravel(), minlength=shape[0] * shape[1]).reshape(shape)


def registered(stars: np.ndarray, ref: Reference) -> dict[str, float] | None:
    """Shift, rotation and scale that take stars to those of the reference, from pairs that two triangles or more vote for; none without three pairs.

    The shift (tx, ty) is that of the matched stars' middle, so a frame that is
    but moved by it lies as well as it can.
    """
    a, b, votes = stars[: ref.limit, :2], ref.stars, ref.votes(stars)
    i, j = np.nonzero(votes >= 2)
    if len(i) < 3:
        return None
    pairs, seen_a, seen_b = [], set(), set()
    for p, q in sorted(zip(i.tolist(), j.tolist()), key=lambda k: -votes[k]):
        if p not in seen_a and q not in seen_b:
            seen_a.add(p), seen_b.add(q), pairs.append((p, q))
    own = a[[p for p, _ in pairs]]
    m = similarity_fit(own, b[[q for _, q in pairs]], 2.0)
    if m is None:
        return None
    middle = complex(own[:, 1].mean(), own[:, 0].mean())
    turn = m["scale"] * np.exp(1j * np.radians(m["rotation"]))
    moved = turn * middle + complex(m["tx"], m["ty"]) - middle
    # to the reference: z' = turn z + shift
    return {**m, "tx": float(moved.real), "ty": float(moved.imag), "turn": turn, "shift": complex(m["tx"], m["ty"])}


def spline_coefficients(image: np.ndarray) -> np.ndarray:
    """The weights of cubic B-splines, one on each pixel, that pass through the image; mirrored about the edge pixels' centres.

    Along each axis in turn, one recursion forwards and one back.
    """
    pole = 3**0.5 - 2
    c = np.asarray(image, dtype=np.float64)
    for _ in range(2):
        n = len(c)
        if n > 1:
            c = 6 * c
            k = np.arange(n)
            # what all mirror images before the first pixel add up to
            weights = np.where((k == 0) | (k == n - 1), pole**k, pole**k + pole ** (2 * n - 2 - k))
            c[0] = np.tensordot(weights, c, 1) / (1 - pole ** (2 * n - 2))
            for i in range(1, n):
                c[i] += pole * c[i - 1]
            c[-1] = pole / (pole * pole - 1) * (c[-1] + pole * c[-2])
            for i in range(n - 2, -1, -1):
                c[i] = pole * (c[i + 1] - c[i])
        c = c.T.copy()
    return c


def cubic_taps(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The four splines that reach each place, and their weights there: arrays of four rows."""
    low = np.floor(at).astype(int)
    t = at - low
    w = np.stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, 3 * (1 - t) ** 3 - 6 * (1 - t) ** 2 + 4, t**3]) / 6
    k = np.stack([low + j for j in (-1, 0, 1, 2)])
    if n == 1:
        return np.zeros_like(k), w
    k = np.abs(k) % (2 * n - 2)
    return np.where(k >= n, 2 * n - 2 - k, k), w


def resampled_cubic(image: np.ndarray, affine: tuple[float, ...], rows: int, cols: int, band: int = 128) -> np.ndarray:
    """image on a canvas by its cubic spline: affine as in resampled; NaN outside the centres of the image's edge pixels. Worked on in bands of rows, as a canvas may be large."""
    a, b, c, d, e, f = affine
    h, w = image.shape
    coefficients = spline_coefficients(image)
    out = np.full((rows, cols), np.nan)
    for y0 in range(0, rows, band):
        y, x = np.mgrid[y0 : min(y0 + band, rows), :cols]
        sx, sy = a * x + b * y + c, d * x + e * y + f
        near = 1e-9  # rounding takes no edge pixel away
        inside = (sx >= -near) & (sx <= w - 1 + near) & (sy >= -near) & (sy <= h - 1 + near)
        sx, sy = np.clip(sx[inside], 0, w - 1), np.clip(sy[inside], 0, h - 1)
        (ky, wy), (kx, wx) = cubic_taps(sy, h), cubic_taps(sx, w)
        out[y0 : y0 + band][inside] = sum(wy[j] * sum(wx[i] * coefficients[ky[j], kx[i]] for i in range(4)) for j in range(4))
    return out


def warped(image: np.ndarray, affine: tuple[float, ...], rows: int, cols: int, order: int = 1, min_cover: float = 0.5) -> np.ndarray:
    """resampled, by the order of its spline: 1 or 3."""
    if order not in (1, 3):
        raise ValueError(f"images are resampled by splines of order 1 or 3, not {order}")
    return resampled(image, affine, rows, cols, min_cover) if order == 1 else resampled_cubic(image, affine, rows, cols)


def resampled(image: np.ndarray, affine: tuple[float, ...], rows: int, cols: int, min_cover: float = 0.5) -> np.ndarray:
    """image on a canvas, bilinearly: affine (a, b, c, d, e, f) takes canvas (x, y) to image (ax+by+c, dx+ey+f); NaN where the image covers no more than min_cover of a pixel."""
    a, b, c, d, e, f = affine
    y, x = np.mgrid[:rows, :cols]
    sx, sy = a * x + b * y + c, d * x + e * y + f
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    total, cover = np.zeros((rows, cols)), np.zeros((rows, cols))
    for j in (0, 1):
        for i in (0, 1):
            w = (1 - np.abs(sy - y0 - j)) * (1 - np.abs(sx - x0 - i))
            inside = (y0 + j >= 0) & (y0 + j < image.shape[0]) & (x0 + i >= 0) & (x0 + i < image.shape[1]) & (w > 0)
            w = np.where(inside, w, 0.0)
            total += w * image[np.clip(y0 + j, 0, image.shape[0] - 1), np.clip(x0 + i, 0, image.shape[1] - 1)]
            cover += w
    return np.where(cover > min_cover, total / np.where(cover > 0, cover, 1.0), np.nan)
