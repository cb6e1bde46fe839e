"""Image features in NumPy, for images as height x width x 3 arrays of blue, green, red bytes.

Formulas are floating point; where the usual 8-bit library rounds in between, values may differ by a rounding step.
Dimensions are those of the registry.
"""

from __future__ import annotations

import numpy as np

TINY = 1e-7


def gray(img: np.ndarray) -> np.ndarray:
    return img[:, :, 0] * 0.114 + img[:, :, 1] * 0.587 + img[:, :, 2] * 0.299


def hsv(img: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue 0..180, saturation and value 0..255."""
    b, g, r = (img[:, :, i].astype(float) for i in range(3))
    top, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    d = np.where(top > low, top - low, 1.0)
    h = np.where(top == r, (g - b) / d, np.where(top == g, 2 + (b - r) / d, 4 + (r - g) / d)) * 60
    h = np.where(top > low, np.where(h < 0, h + 360, h), 0) / 2
    return h, np.where(top > 0, 255 * (top - low) / np.maximum(top, 1), 0), top


def resized(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""

    def axis(n: int, m: int):
        p = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.floor(p).astype(int)
        return lo, np.minimum(lo + 1, n - 1), p - lo

    a = img.astype(float)
    y0, y1, fy = axis(a.shape[0], height)
    x0, x1, fx = axis(a.shape[1], width)
    fy = fy.reshape(-1, *[1] * (a.ndim - 1))
    fx = fx.reshape(1, -1, *[1] * (a.ndim - 2))
    rows = a[y0] * (1 - fy) + a[y1] * fy
    out = rows[:, x0] * (1 - fx) + rows[:, x1] * fx
    return np.clip(np.round(out), 0, 255).astype(np.uint8) if img.dtype == np.uint8 else out


def lanczos(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Lanczos of eight taps, whatever the scale; pixel centres aligned, borders repeated."""

    def along(a: np.ndarray, m: int) -> np.ndarray:
        n = len(a)
        p = (np.arange(m) + 0.5) * n / m - 0.5
        taps = np.floor(p).astype(int)[:, None] + np.arange(-3, 5)
        weight = np.sinc(p[:, None] - taps) * np.sinc((p[:, None] - taps) / 4)
        weight /= weight.sum(axis=1, keepdims=True)
        taps = np.clip(taps, 0, n - 1)
        return sum(a[taps[:, k]] * weight[:, k].reshape(-1, *[1] * (a.ndim - 1)) for k in range(8))

    if img.shape[:2] == (height, width):
        return img
    out = along(along(img.astype(np.float32), height).swapaxes(0, 1), width).swapaxes(0, 1)
    return np.clip(np.round(out), 0, 255).astype(np.uint8) if img.dtype == np.uint8 else out


def standardized(img: np.ndarray, height: int = 2160, width: int = 3840) -> np.ndarray:
    h, w = img.shape[:2]
    ratio = width / height
    if abs(w / h - ratio) > 0.01:
        if w / h > ratio:
            keep = int(h * ratio)
            img = img[:, (w - keep) // 2 : (w - keep) // 2 + keep]
        else:
            keep = int(w / ratio)
            img = img[(h - keep) // 2 : (h - keep) // 2 + keep]
    return lanczos(img, height, width)


def filtered(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation with a kernel anchored in its middle, mirrored at the border without repeating it."""
    kh, kw = kernel.shape
    p = np.pad(a.astype(float), ((kh // 2, kh - 1 - kh // 2), (kw // 2, kw - 1 - kw // 2)), mode="reflect")
    if kh * kw > 100:  # large kernels by the Fourier transform
        shape = [p.shape[0] + kh - 1, p.shape[1] + kw - 1]
        full = np.fft.irfft2(np.fft.rfft2(p, shape) * np.fft.rfft2(kernel[::-1, ::-1], shape), shape)
        return full[kh - 1 : kh - 1 + a.shape[0], kw - 1 : kw - 1 + a.shape[1]]
    windows = np.lib.stride_tricks.sliding_window_view(p, kernel.shape)
    return np.einsum("yxij,ij->yx", windows, kernel)


SOBEL_X = np.outer([1, 2, 1], [-1, 0, 1]).astype(float)


def gradients(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return filtered(g, SOBEL_X), filtered(g, SOBEL_X.T)


def quarters(a: np.ndarray, n: int = 4) -> list[np.ndarray]:
    h, w = a.shape[0] // n, a.shape[1] // n
    return [a[i * h : (i + 1) * h, j * w : (j + 1) * w] for i in range(n) for j in range(n)]


def unit(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v) + TINY)


def regions(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, int]:
    """Labels 1.. of connected regions, by growing minima of labels until they settle."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    a, b = [], []
    for dy, dx in steps:
        p = label[: h - dy, max(0, -dx) : w - max(0, dx)]
        q = label[dy:, max(0, dx) : w + min(0, dx)]
        both = (p > 0) & (q > 0)
        a.append(p[both])
        b.append(q[both])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(h * w + 1)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    found, out = np.unique(root[label][mask], return_inverse=True)
    result = np.zeros((h, w), dtype=int)
    result[mask] = out + 1
    return result, len(found)


def outline(mask: np.ndarray) -> np.ndarray:
    """The outer border of the region of greatest area as points (x, y) in order; empty without one."""
    labels, n = regions(mask, diagonal=True)
    if not n:
        return np.empty((0, 2), dtype=int)
    best, most = np.empty((0, 2), dtype=int), -1.0
    for k in np.argsort(-np.bincount(labels.ravel())[1:])[:5] + 1:
        c = _walk(labels == k)
        if (a := polygon_area(c)) > most:
            best, most = c, a
    return best


def _walk(on: np.ndarray) -> np.ndarray:
    """Moore neighbour tracing from the first pixel in reading order."""
    ring = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    h, w = on.shape
    start = tuple(np.argwhere(on)[0])
    points, at, back = [start], start, 4
    for _ in range(4 * h * w):
        for k in range(1, 9):
            d = (back + k) % 8
            y, x = at[0] + ring[d][0], at[1] + ring[d][1]
            if 0 <= y < h and 0 <= x < w and on[y, x]:
                at, back = (y, x), (d + 4) % 8
                break
        else:
            break
        if at == start:
            break
        points.append(at)
    return np.array(points)[:, ::-1]


def polygon_area(c: np.ndarray) -> float:
    if len(c) < 3:
        return 0.0
    x, y = c[:, 0].astype(float), c[:, 1].astype(float)
    return abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2


def perimeter(c: np.ndarray) -> float:
    return float(np.linalg.norm(c - np.roll(c, -1, axis=0), axis=1).sum()) if len(c) > 1 else 0.0


def hull(c: np.ndarray) -> np.ndarray:
    """Convex hull by the monotone chain."""
    pts = sorted(set(map(tuple, c.tolist())))
    if len(pts) < 3:
        return np.array(pts)

    def half(points):
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def brightness(img):
    return hsv(img)[2].mean() / 255


def contrast(img):
    return min(1.0, gray(img).std() / 127.5)


def saturation(img):
    return hsv(img)[1].mean() / 255


def sharpness(img):
    return filtered(gray(img), np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], dtype=float)).var()


def edge_density(img, low: float = 100, high: float = 200):
    """Share of edge pixels: thinned gradient maxima over `high`, and those over `low` that touch one."""
    gx, gy = gradients(np.round(gray(img)))
    mag = np.abs(gx) + np.abs(gy)
    angle = np.rad2deg(np.arctan2(gy, gx)) % 180
    p = np.pad(mag, 1)
    shift = lambda dy, dx: p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx]
    pairs = [((0, -1), (0, 1)), ((-1, -1), (1, 1)), ((-1, 0), (1, 0)), ((-1, 1), (1, -1))]
    sector = np.round(angle / 45).astype(int) % 4
    peak = np.zeros(mag.shape, dtype=bool)
    for k, (one, two) in enumerate(pairs):
        peak |= (sector == k) & (mag > shift(*one)) & (mag >= shift(*two))
    weak, strong = peak & (mag > low), peak & (mag > high)
    labels, n = regions(weak, diagonal=True)
    keep = np.zeros(n + 1, dtype=bool)
    keep[np.unique(labels[strong])] = True
    keep[0] = False
    return keep[labels].mean()


def hog(img):
    """8 unsigned directions, cells of 16 x 16, blocks of 2 x 2 cells with L2 norms clipped at 0.2: 1568 numbers."""
    g = resized(np.round(gray(img)), 128, 128)
    gy, gx = np.zeros_like(g), np.zeros_like(g)
    gy[1:-1], gx[:, 1:-1] = g[2:] - g[:-2], g[:, 2:] - g[:, :-2]
    mag, angle = np.hypot(gx, gy), np.rad2deg(np.arctan2(gy, gx)) % 180
    bins = np.minimum((angle / 22.5).astype(int), 7)
    cells = np.zeros((8, 8, 8))
    np.add.at(cells, (np.arange(128)[:, None] // 16, np.arange(128)[None, :] // 16, bins), mag / 256)
    out = []
    for i in range(7):
        for j in range(7):
            v = cells[i : i + 2, j : j + 2].ravel()
            v = np.minimum(v / np.sqrt((v**2).sum() + 1e-10), 0.2)
            out.append(v / np.sqrt((v**2).sum() + 1e-10))
    return np.concatenate(out)


def hu_moments(img):
    on = np.where(np.round(gray(img)) > 128, 255.0, 0.0)
    y, x = np.indices(on.shape)
    m = on.sum()
    if not m:
        return np.full(7, 0.0)
    dx, dy = x - (x * on).sum() / m, y - (y * on).sum() / m
    n = lambda p, q: (dx**p * dy**q * on).sum() / m ** (1 + (p + q) / 2)
    n20, n02, n11, n30, n03, n21, n12 = n(2, 0), n(0, 2), n(1, 1), n(3, 0), n(0, 3), n(2, 1), n(1, 2)
    a, b, p, q = n30 + n12, n21 + n03, n30 - 3 * n12, 3 * n21 - n03
    h = np.array([n20 + n02, (n20 - n02) ** 2 + 4 * n11**2, p * p + q * q, a * a + b * b, p * a * (a * a - 3 * b * b) + q * b * (3 * a * a - b * b), (n20 - n02) * (a * a - b * b) + 4 * n11 * a * b, q * a * (a * a - 3 * b * b) - p * b * (3 * a * a - b * b)])
    return -np.sign(h) * np.log10(np.abs(h) + 1e-12)


def lbp(img):
    """Uniform patterns of 8 neighbours at distance 1, ten bins in each of 16 cells."""
    g = resized(np.round(gray(img)), 256, 256)
    p = np.pad(g, 1)
    around = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]
    bits = np.stack([p[1 + dy : 257 + dy, 1 + dx : 257 + dx] >= g for dy, dx in around])
    changes = (bits != np.roll(bits, 1, axis=0)).sum(0)
    code = np.where(changes <= 2, bits.sum(0), 9)
    return np.concatenate([np.bincount(c.ravel(), minlength=10) / (c.size + TINY) for c in quarters(code)])


def gabor(img):
    """Mean and variance in 16 cells of the clipped responses to 16 kernels of 31 x 31."""
    g = np.round(resized(np.round(gray(img)), 256, 256))
    y, x = np.mgrid[-15:16, -15:16]
    out = []
    for theta in np.arange(4) * np.pi / 4:
        for sigma in (1, 3):
            for wave in (np.pi / 4, np.pi / 2):
                xr, yr = x * np.cos(theta) + y * np.sin(theta), -x * np.sin(theta) + y * np.cos(theta)
                kernel = np.exp(-(xr**2 + 0.25 * yr**2) / (2 * sigma**2)) * np.cos(2 * np.pi * xr / wave)
                f = np.clip(np.round(filtered(g, kernel)), 0, 255)
                out += [s for c in quarters(f) for s in (c.mean(), c.var())]
    return np.array(out)


def ccv(img):
    """For 12 x 4 hue and saturation bins the shares of pixels in regions of at least a hundredth of the image, and in smaller ones."""
    small = resized(img, 256, 256)
    k = np.array([[0.25, 0.5, 0.25]])
    blur = np.stack([filtered(filtered(small[:, :, c], k), k.T) for c in range(3)], axis=2)
    h, s, _ = hsv(np.round(blur))
    b = np.minimum((h / 15).astype(int), 11) * 4 + np.minimum((s / 64).astype(int), 3)
    out = np.zeros((48, 2))
    for k_ in np.unique(b):
        labels, _ = regions(b == k_, diagonal=True)
        areas = np.bincount(labels.ravel())[1:]
        out[k_] = areas[areas >= 655.36].sum(), areas[areas < 655.36].sum()
    return (out / (out.sum(1, keepdims=True) + TINY)).ravel()


def fourier(img):
    c = outline(np.round(gray(img)) > 127)
    out = np.zeros(25)
    if len(c) < 2:
        return out
    f = np.abs(np.fft.fft(c[:, 0] + 1j * c[:, 1]))[:25]
    out[: len(f)] = f / f[0] if f[0] else f
    return out


def geo(img):
    """Circularity, solidity, extent, aspect ratio, eccentricity, convexity of the largest shape."""
    c = outline(np.round(gray(img)) > 127)
    length = perimeter(c)
    if not length:
        return np.zeros(6)
    area, around = polygon_area(c), hull(c)
    w, h = c.max(0) - c.min(0) + 1
    full = polygon_area(around)
    ecc = 0.0
    if len(c) >= 5:
        values = np.sort(np.linalg.eigvalsh(np.cov(c.T.astype(float))))
        ecc = np.sqrt(max(0.0, 1 - values[0] / values[1])) if values[1] > 0 else 0.0
    return np.nan_to_num(np.array([4 * np.pi * area / length**2, area / full if full else 0.0, area / (w * h), w / h, ecc, perimeter(around) / length]))


def tamura(img):
    g = gray(img)
    std = g.std()
    kurt = ((g - g.mean()) ** 4).mean() / (std**4 + TINY)
    gx, gy = gradients(g)
    mag, angle = np.hypot(gx, gy), np.arctan2(gy, gx) % (2 * np.pi)
    strong = angle[mag > mag.max() * 0.1]
    h = np.histogram(strong, bins=16, range=(0, 2 * np.pi))[0]
    direction = 1 - (h > h.max() * 0.1).sum() / 16 if len(strong) else 0.0
    coarse = np.mean([np.abs(g - filtered(g, np.full((s, s), 1 / s**2))).mean() for s in (2, 4, 8)])
    return np.array([coarse, std / (kurt**0.25 + TINY), direction])


def edge_orientation(img):
    gx, gy = gradients(gray(img))
    mag = np.hypot(gx, gy)
    edge = mag > mag.max() * 0.1
    a = np.round(np.rad2deg(np.arctan2(gy, gx)) % 180, 9)[edge]
    n = mag.size
    kinds = [((a < 22.5) | (a >= 157.5)).sum(), ((a >= 67.5) & (a < 112.5)).sum(), ((a >= 22.5) & (a < 67.5)).sum(), ((a >= 112.5) & (a < 157.5)).sum()]
    return np.array([*(k / n for k in kinds), 1 - edge.mean()])


def glcm(img):
    g = np.floor(np.round(resized(np.round(gray(img)), 256, 256)) / 8).astype(int)
    i, j = np.indices((32, 32))
    out = []
    for c in quarters(g):
        p = np.zeros((32, 32))
        np.add.at(p, (c[:, :-1].ravel(), c[:, 1:].ravel()), 1)
        p = (p + p.T) / (2 * c[:, 1:].size)
        mu = (p * i).sum()
        var = (p * (i - mu) ** 2).sum()
        corr = (p * (i - mu) * (j - mu)).sum() / var if var > 1e-15 else 1.0
        out += [(p * (i - j) ** 2).sum(), corr, np.sqrt((p**2).sum()), (p / (1 + (i - j) ** 2)).sum()]
    return np.array(out)


def wavelet(img):
    now, out = resized(gray(img), 256, 256), []
    for _ in range(3):
        a, b, c, d = now[0::2, 0::2], now[0::2, 1::2], now[1::2, 0::2], now[1::2, 1::2]
        mean = (a + b + c + d) / 4
        out += [mean.mean(), np.abs(b - d).mean(), np.abs(c - d).mean(), np.abs(a - d).mean()]
        now = mean
    return np.array(out)


def correlogram(img):
    q = np.minimum((hsv(resized(img, 64, 64))[0] / 22.5).astype(int), 7)
    h, w = q.shape
    y, x = (a.ravel() for a in np.mgrid[0:h:2, 0:w:2])
    mine = q[y, x]
    total = np.bincount(mine, minlength=8)
    out = []
    for d in (1, 3, 5, 7):
        same = np.zeros(8)
        for dy, dx in ((0, d), (d, 0), (d, d), (-d, d)):
            ny, nx = y + dy, x + dx
            ok = (ny >= 0) & (ny < h) & (nx >= 0) & (nx < w)
            hit = q[ny[ok], nx[ok]] == mine[ok]
            same += np.bincount(mine[ok][hit], minlength=8)
        out += list(same / (4 * total + TINY))
    return np.array(out)


def ehd(img):
    """Mean positive responses to five 2 x 2 edge kernels in 16 cells, of unit length."""
    g = np.round(resized(np.round(gray(img)), 256, 256))
    r = np.sqrt(2)
    kernels = [[[1, 1], [-1, -1]], [[1, -1], [1, -1]], [[r, 0], [0, -r]], [[0, r], [-r, 0]], [[2, -2], [-2, 2]]]
    return unit(np.array([np.clip(np.round(filtered(c, np.array(k, dtype=float))), 0, 255).mean() for c in quarters(g) for k in kernels]))


def cld(img):
    y = np.round(resized(np.round(gray(img)), 8, 8))
    k, n = np.mgrid[0:8, 0:8]
    basis = np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos(np.pi * (2 * n + 1) * k / 16)
    return (basis @ y @ basis.T).ravel()


def spm(img):
    h = hsv(img)[0]
    a, b = h.shape
    parts = [h] + [h[i * a // 2 : (i + 1) * a // 2, j * b // 2 : (j + 1) * b // 2] for i in (0, 1) for j in (0, 1)]
    counts = [np.histogram(np.minimum(p, 179.999), bins=32, range=(0, 180))[0].astype(float) for p in parts]
    return np.concatenate([c / max(np.linalg.norm(c), 1e-12) for c in counts])


def saliency(img):
    """Spectral residual at 128 x 128, smoothed and reduced to 4 x 8, of unit length."""
    f = np.fft.fftshift(np.fft.fft2(np.round(resized(np.round(gray(img)), 128, 128))))
    log = np.log(np.abs(f) + TINY)
    residual = log - filtered(log, np.full((3, 3), 1 / 9))
    s = np.abs(np.fft.ifft2(np.fft.ifftshift(np.exp(residual + 1j * np.angle(f)))))
    k = np.exp(-(np.arange(-2, 3) ** 2) / 18.0)
    k = (k / k.sum())[None, :]
    return unit(resized(filtered(filtered(s, k), k.T), 4, 8).ravel())


def _spaces(img: np.ndarray) -> list[np.ndarray]:
    """Channels in seven color spaces, scaled to 0..255 (hue to 0..180); the last is gray."""
    b, g, r = (img[:, :, i].astype(float) for i in range(3))
    h, s, v = hsv(img)
    y = gray(img)
    lin = [np.where(c <= 10.31475, c / 3294.6, ((c / 255 + 0.055) / 1.055) ** 2.4) for c in (r, g, b)]
    matrix = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
    xyz = [sum(m * c for m, c in zip(row, (r, g, b), strict=True)) for row in matrix]
    fx, fy, fz = (np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116) for t in (sum(m * c for m, c in zip(row, lin, strict=True)) / n for row, n in zip(matrix, (0.950456, 1.0, 1.088754), strict=True)))
    lab = [(116 * fy - 16) * 2.55, 500 * (fx - fy) + 128, 200 * (fy - fz) + 128]
    top, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    light = (top + low) / 2
    sat = np.where(top > low, (top - low) / np.maximum(np.where(light < 127.5, top + low, 510 - top - low), TINY), 0) * 255
    spaces = [[r, g, b], [h, s, v], lab, [y, (r - y) * 0.713 + 128, (b - y) * 0.564 + 128], [h, light, sat], xyz, [y]]
    return [np.stack([np.clip(c, 0, 255) for c in sp], axis=2) for sp in spaces]


def soft_histogram(values: np.ndarray, bins: int = 8) -> np.ndarray:
    p = values.ravel() / (256 / bins) - 0.5
    lo = np.floor(p)
    out = np.bincount(np.clip(lo, 0, bins - 1).astype(int), 1 - (p - lo), bins) + np.bincount(np.clip(lo + 1, 0, bins - 1).astype(int), p - lo, bins)
    return out / (out.sum() + TINY)


def joint_histogram(space: np.ndarray, bins: int = 4) -> np.ndarray:
    p = space.reshape(-1, 3) / (256 / bins) - 0.5
    lo = np.floor(p)
    f = p - lo
    out = np.zeros(bins**3)
    for corner in np.ndindex(2, 2, 2):
        at = np.clip(lo + corner, 0, bins - 1).astype(int)
        w = np.prod(np.where(np.array(corner) == 1, f, 1 - f), axis=1)
        out += np.bincount(at @ [bins * bins, bins, 1], w, bins**3)
    return out / max(out.sum(), TINY)


def meta_hist_interp(img):
    return np.concatenate([soft_histogram(s[:, :, i]) for s in _spaces(img) for i in range(s.shape[2])])


def meta_cdf_interp(img):
    return np.concatenate([np.cumsum(soft_histogram(s[:, :, i])) for s in _spaces(img) for i in range(s.shape[2])])


def meta_joint_interp(img):
    return np.concatenate([joint_histogram(s) for s in _spaces(img)[:-1]])


def meta_cell(img):
    return np.concatenate([c.mean((0, 1)) for s in _spaces(img) for c in quarters(resized(s, 256, 256))])


def _per_channel(img, f):
    return np.array([f(s[:, :, i]) for s in _spaces(img) for i in range(s.shape[2])])


def meta_moments_mean(img):
    return _per_channel(img, np.mean)


def meta_moments_std(img):
    return _per_channel(img, np.std)


def meta_moments_skew(img):
    return _per_channel(img, lambda c: ((c - c.mean()) ** 3).mean() / (c.std() ** 3 + TINY))


EXTRACTORS = {f.__name__: f for f in (
    brightness, contrast, saturation, edge_density, sharpness, meta_hist_interp, meta_cdf_interp, meta_joint_interp, meta_cell, meta_moments_mean, meta_moments_std, meta_moments_skew,
    hog, hu_moments, lbp, gabor, ccv, fourier, geo, tamura, edge_orientation, glcm, wavelet, correlogram, ehd, cld, spm, saliency,
)}
