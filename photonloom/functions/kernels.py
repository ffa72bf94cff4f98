"""Kernels on whole images, in NumPy: Fourier shifts and convolutions, optics, deconvolution, fits. Used one image at a time in Arrow batches."""

from __future__ import annotations

import math

import numpy as np


def fourier_shift(image: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """image moved by a fraction of pixels, periodically; moves below 1e-6 change nothing."""
    if abs(dy) < 1e-6 and abs(dx) < 1e-6:
        return image
    ramp = np.exp(-2j * np.pi * (np.fft.fftfreq(image.shape[0])[:, None] * dy + np.fft.rfftfreq(image.shape[1])[None, :] * dx))
    return np.fft.irfft2(np.fft.rfft2(image) * ramp, s=image.shape)


def next_pow2(n: int) -> int:
    return 1 << max(n - 1, 0).bit_length()


def psf_spectrum(psf: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The transform of a kernel whose centre lies at the origin of a larger grid."""
    k = np.zeros(shape)
    h, w = psf.shape
    k[:h, :w] = psf
    return np.fft.rfft2(np.roll(k, (-(h // 2), -(w // 2)), axis=(0, 1)))


def convolve(image: np.ndarray, psf: np.ndarray) -> np.ndarray:
    """image with a kernel, its edges mirrored."""
    p = max(psf.shape) // 2 + 1
    p = min(p, min(image.shape))
    wide = np.pad(image, p, mode="symmetric")
    shape = (next_pow2(wide.shape[0]), next_pow2(wide.shape[1]))
    out = np.fft.irfft2(np.fft.rfft2(wide, s=shape) * psf_spectrum(psf, shape), s=shape)
    return out[p : p + image.shape[0], p : p + image.shape[1]]


def pool(image: np.ndarray, s: int) -> np.ndarray:
    h, w = image.shape[0] // s, image.shape[1] // s
    return image[: h * s, : w * s].reshape(h, s, w, s).mean(axis=(1, 3))


def unpool(image: np.ndarray, s: int) -> np.ndarray:
    """The transpose of pool."""
    return np.repeat(np.repeat(image, s, axis=0), s, axis=1) / (s * s)


def resample(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, corner on corner."""
    y, x = np.linspace(0, image.shape[0] - 1, height), np.linspace(0, image.shape[1] - 1, width)
    y0, x0 = np.minimum(y.astype(int), max(image.shape[0] - 2, 0)), np.minimum(x.astype(int), max(image.shape[1] - 2, 0))
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = image[np.ix_(y0, x0)] * (1 - fx) + image[np.ix_(y0, x1)] * fx
    low = image[np.ix_(y1, x0)] * (1 - fx) + image[np.ix_(y1, x1)] * fx
    return top * (1 - fy) + low * fy


def spline_basis(n: int, at: np.ndarray) -> np.ndarray:
    """Weights of n equally spaced values in their interpolating cubic spline (not-a-knot) at places counted in steps."""
    a, d = np.zeros((n, n)), np.zeros((n, n))
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = (1, 4, 1)
        d[i, i - 1 : i + 2] = (6, -12, 6)
    a[0, :3], a[-1, -3:] = (1, -2, 1), (1, -2, 1)
    second = np.linalg.solve(a, d)
    i = np.clip(np.floor(at).astype(int), 0, n - 2)
    t = at - i
    eye = np.eye(n)
    w = (1 - t)[:, None] * eye[i] + t[:, None] * eye[i + 1]
    return w + ((1 - t) ** 3 - (1 - t))[:, None] / 6 * second[i] + (t**3 - t)[:, None] / 6 * second[i + 1]


def sky_surface(mesh: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mesh of tiles at full size: a bicubic spline, bilinear where an axis has fewer than four knots."""
    if min(mesh.shape) < 4:
        return resample(mesh, height, width)
    rows = spline_basis(mesh.shape[0], np.linspace(0, mesh.shape[0] - 1, height))
    cols = spline_basis(mesh.shape[1], np.linspace(0, mesh.shape[1] - 1, width))
    return rows @ mesh @ cols.T


def bessel_j1(x: np.ndarray) -> np.ndarray:
    """J1 by the trapezoid rule on its integral, which converges at once for periodic integrands."""
    x = np.asarray(x, dtype=np.float64)
    n = int(64 + 2 * (np.abs(x).max() if x.size else 0))
    t = np.arange(n) * (2 * np.pi / n)
    return np.cos(t - x[..., None] * np.sin(t)).mean(axis=-1)


def airy_psf(size: int, pixel_um: float, aperture_mm: float, focal_mm: float, wavelength_nm: float, obstruction: float = 0.0) -> np.ndarray:
    """The diffraction pattern of a round aperture with a round obstruction (a share of the diameter), of sum 1."""
    y, x = np.mgrid[:size, :size] - size // 2
    u = np.pi * aperture_mm * np.hypot(y, x) * pixel_um / (wavelength_nm * 1e-3 * focal_mm)

    def amplitude(v):
        safe = np.where(v < 1e-9, 1.0, v)
        return np.where(v < 1e-9, 1.0, 2 * bessel_j1(safe) / safe)

    e2 = obstruction**2
    p = ((amplitude(u) - e2 * amplitude(obstruction * u)) / (1 - e2)) ** 2
    return p / p.sum()


def broadband_psf(size: int, pixel_um: float, aperture_mm: float, focal_mm: float, wavelengths_nm, weights, obstruction: float = 0.0) -> np.ndarray:
    p = sum(w * airy_psf(size, pixel_um, aperture_mm, focal_mm, lam, obstruction) for lam, w in zip(wavelengths_nm, weights))
    return p / p.sum()


def instrument_psf(diffraction: np.ndarray, optics: np.ndarray | None) -> np.ndarray:
    """Diffraction blurred by the optics' own kernel, of sum 1."""
    if optics is None:
        return diffraction / diffraction.sum()
    p = np.maximum(convolve(diffraction, optics), 0)
    return p / p.sum()


def gaussian_psf(size: int, fwhm: float) -> np.ndarray:
    y, x = np.mgrid[:size, :size] - size // 2
    p = np.exp(-4 * math.log(2) * (y * y + x * x) / fwhm**2)
    return p / p.sum()


def moffat(p, y, x):
    """p: amplitude, y0, x0, alpha, beta, offset."""
    return p[0] * (1 + ((y - p[1]) ** 2 + (x - p[2]) ** 2) / p[3] ** 2) ** (-p[4]) + p[5]


def fit_moffat(stamp: np.ndarray, rounds: int = 200) -> dict[str, float]:
    """FWHM, beta, centre and amplitude by damped least squares in bounds; by second moments where that fails."""
    h, w = stamp.shape
    y, x = np.mgrid[:h, :w].astype(float)
    base = float(np.median(stamp))
    net = np.maximum(stamp - base, 0)
    total = net.sum()
    cy, cx = ((net * y).sum() / total, (net * x).sum() / total) if total > 0 else ((h - 1) / 2, (w - 1) / 2)
    spread = (net * ((y - cy) ** 2 + (x - cx) ** 2)).sum() / total if total > 0 else 0.1
    fallback = {"fwhm": 2.3548 * math.sqrt(max(spread, 0.1)), "beta": float("nan"), "y": float(cy), "x": float(cx), "amplitude": float(net.max()), "fitted": 0.0}
    if total <= 0:
        return fallback
    lo = np.array([0.0, 0.0, 0.0, 0.3, 1.01, -np.inf])
    hi = np.array([np.inf, h - 1.0, w - 1.0, float(max(h, w)), 10.0, np.inf])
    p = np.clip(np.array([net.max(), cy, cx, max(math.sqrt(spread), 0.5), 2.5, base]), lo, hi)
    damp, error = 1e-3, ((moffat(p, y, x) - stamp) ** 2).sum()
    for _ in range(rounds):
        r = (stamp - moffat(p, y, x)).ravel()
        step = np.maximum(np.abs(p), 1.0) * 1e-6
        jac = np.stack([((moffat(p + d, y, x) - moffat(p - d, y, x)) / (2 * d.sum())).ravel() for d in np.diag(step)], axis=1)
        hess = jac.T @ jac
        try:
            move = np.linalg.solve(hess + damp * np.diag(np.diag(hess) + 1e-12), jac.T @ r)
        except np.linalg.LinAlgError:
            return fallback
        q = np.clip(p + move, lo, hi)
        new = ((moffat(q, y, x) - stamp) ** 2).sum()
        if new < error:
            done = error - new < 1e-12 * error
            p, error, damp = q, new, max(damp / 3, 1e-12)
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    fwhm = 2 * p[3] * math.sqrt(2 ** (1 / p[4]) - 1)
    if not np.isfinite(fwhm) or p[0] <= 0:
        return fallback
    return {"fwhm": float(fwhm), "beta": float(p[4]), "y": float(p[1]), "x": float(p[2]), "amplitude": float(p[0]), "fitted": 1.0}


def wiener_deconvolve(total: np.ndarray, known: np.ndarray, snr: float) -> np.ndarray:
    """What blurs a known kernel into the total one: not below 0, of sum 1, on the total's grid."""
    n = next_pow2(2 * max(total.shape[0], known.shape[0]))
    t, k = psf_spectrum(total, (n, n)), psf_spectrum(known, (n, n))
    power = np.abs(k) ** 2
    out = np.fft.irfft2(t * np.conj(k) / (power + 1 / snr**2), s=(n, n))
    h, w = total.shape
    out = np.maximum(np.roll(out, (h // 2, w // 2), axis=(0, 1))[:h, :w], 0)
    return out / out.sum() if out.sum() > 0 else total / total.sum()


def fwhm_of_psf(psf: np.ndarray) -> float:
    """The width at half of the peak along its row, between interpolated crossings."""
    j, i = np.unravel_index(int(np.argmax(psf)), psf.shape)
    row = psf[j]
    half = row[i] / 2

    def crossing(step):
        k = i
        while 0 <= k + step < len(row) and row[k + step] > half:
            k += step
        n = k + step
        if not 0 <= n < len(row):
            return float(k)
        return k + step * (row[k] - half) / (row[k] - row[n])

    return float(crossing(1) - crossing(-1))


def power_ratio_above(image: np.ndarray, reference: np.ndarray, scale: int) -> float:
    """The mean power of image over reference's beyond the coarser grid's limit of 1/(2 scale) cycles a pixel."""
    f = np.hypot(np.fft.fftfreq(image.shape[0])[:, None], np.fft.rfftfreq(image.shape[1])[None, :])
    high = f > 0.5 / scale
    a, b = (float((np.abs(np.fft.rfft2(v)) ** 2)[high].mean()) for v in (image, reference))
    return a / b if b > 0 else float("nan")


def similarity_fit(src: np.ndarray, dst: np.ndarray, threshold: float = 5.0, rounds: int = 500, seed: int = 0) -> dict[str, float] | None:
    """Scale, rotation (degrees) and shift that take src(y, x) to dst, by seeded consensus of pairs and least squares on the inliers; none with fewer than three."""
    if len(src) < 3:
        return None
    a, b = src[:, 1] + 1j * src[:, 0], dst[:, 1] + 1j * dst[:, 0]
    rng = np.random.default_rng(seed)
    best = np.zeros(len(a), bool)
    for _ in range(rounds):
        i, j = rng.choice(len(a), 2, replace=False)
        if abs(a[i] - a[j]) < 1e-9:
            continue
        m = (b[i] - b[j]) / (a[i] - a[j])
        near = np.abs(m * a + (b[i] - m * a[i]) - b) <= threshold
        if near.sum() > best.sum():
            best = near
            if best.all():
                break
    if best.sum() < 3:
        return None
    p, q = a[best], b[best]
    m = (np.conj(p - p.mean()) * (q - q.mean())).sum() / (np.abs(p - p.mean()) ** 2).sum()
    t = q.mean() - m * p.mean()
    return {"scale": float(abs(m)), "rotation": float(np.degrees(np.angle(m))), "tx": float(t.real), "ty": float(t.imag), "inliers": int(best.sum())}


def affine_warp(image: np.ndarray, rotation: float, dy: float, dx: float, scale: float = 1.0) -> np.ndarray:
    """image turned by rotation (degrees) about its centre, scaled and moved, bilinearly; a turn below 1e-4 degrees and a scale within 1e-5 of 1 count as none."""
    from .frame import resampled

    if abs(rotation) < 1e-4 and abs(scale - 1) < 1e-5:
        rotation, scale = 0.0, 1.0
        if dy == dx == 0:
            return image
    c, s = np.cos(np.radians(rotation)) / scale, np.sin(np.radians(rotation)) / scale
    cy, cx = (image.shape[0] - 1) / 2, (image.shape[1] - 1) / 2
    # where on image a pixel of the result comes from: x' = c (x - dx - cx) + s (y - dy - cy) + cx
    affine = (c, s, cx - c * (cx + dx) - s * (cy + dy), -s, c, cy + s * (cx + dx) - c * (cy + dy))
    out = resampled(image, affine, *image.shape, min_cover=0.0)
    return np.where(np.isfinite(out), out, 0.0)


def radial_power(image: np.ndarray, bins: int) -> np.ndarray:
    """The mean power of image in rings of spatial frequency from 0 to half a cycle a pixel."""
    power = np.abs(np.fft.fft2(image)) ** 2
    f = np.hypot(np.fft.fftfreq(image.shape[0])[:, None], np.fft.fftfreq(image.shape[1])[None, :])
    ring = np.minimum((f * 2 * bins).astype(int), bins)
    total, n = (np.bincount(ring.ravel(), w, bins + 1)[:bins] for w in (power.ravel(), np.ones(power.size)))
    return total / np.maximum(n, 1)
