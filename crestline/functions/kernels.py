"""Pixel kernels in NumPy. Images are uint8 arrays, height x width (x 3, blue-green-red)."""

from __future__ import annotations

import numpy as np

from crestline.functions.rasters import RING, SHARPEN_9, SHARPEN_15, SHARPEN_FRAME, WHITE, XYZ



def saturate(a: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(a), 0, 255).astype(np.uint8)


def gray(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else saturate(image.astype(float) @ np.array([0.114, 0.587, 0.299]))


def _pad(a: np.ndarray, n: int, mode: str = "reflect") -> np.ndarray:
    short = min(a.shape[:2]) <= n
    return np.pad(a, [(n, n), (n, n)] + [(0, 0)] * (a.ndim - 2), mode="edge" if short else mode)


def convolve(image: np.ndarray, kernel) -> np.ndarray:
    """Correlation with an odd square kernel in floating point; the border mirrors without its edge."""
    k = np.asarray(kernel, float)
    n = len(k) // 2
    p, (h, w) = _pad(image.astype(float), n), image.shape[:2]
    out = np.zeros(image.shape)
    for dy, dx in zip(*np.nonzero(k), strict=True):
        out += k[dy, dx] * p[dy : dy + h, dx : dx + w]
    return out


def filter2d(image: np.ndarray, kernel) -> np.ndarray:
    return saturate(convolve(image, kernel))


def laplacian(image: np.ndarray) -> np.ndarray:
    return convolve(image, [[0, 1, 0], [1, -4, 1], [0, 1, 0]])


def sobel(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    return convolve(image, k), convolve(image, k.T)


def quality(image: np.ndarray) -> tuple[float, float, float, float]:
    """Sharpness, brightness, contrast and focus of a frame's gray image."""
    g = gray(image)
    gx, gy = sobel(g)
    return float(laplacian(g).var()), float(g.mean()), float(g.std()), float((gx**2 + gy**2).mean())


def upright(image: np.ndarray) -> np.ndarray:
    """A landscape image turned a quarter counter-clockwise."""
    return np.rot90(image) if image.shape[1] > image.shape[0] else image


def oriented(image: np.ndarray, exif: int | None) -> np.ndarray:
    """Turned as the EXIF orientation says; mirrored orientations stay as they are."""
    return np.rot90(image, {3: 2, 6: 3, 8: 1}.get(exif or 1, 0))


def gaussian(image: np.ndarray) -> np.ndarray:
    k = np.array([1, 4, 6, 4, 1]) / 16
    return filter2d(image, np.outer(k, k))


def median(image: np.ndarray, size: int) -> np.ndarray:
    windows = np.lib.stride_tricks.sliding_window_view(_pad(image, size // 2, "edge"), (size, size), axis=(0, 1))
    return np.median(windows, axis=(-2, -1)).astype(np.uint8)


_XYZ, _WHITE = np.array(XYZ), np.array(WHITE)  # rows X, Y, Z of B, G, R


def to_lab(image: np.ndarray) -> np.ndarray:
    """8-bit L*a*b*: L scaled to 255, a and b shifted by 128."""
    c = image.astype(float) / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    t = c @ _XYZ.T / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    light = np.where(t[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * t[..., 1])
    return saturate(np.stack([light * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], -1))


def from_lab(lab: np.ndarray) -> np.ndarray:
    light, a, b = lab[..., 0] * (100 / 255), lab[..., 1] - 128.0, lab[..., 2] - 128.0
    fy = (light + 16) / 116
    f = np.stack([fy + a / 500, fy, fy - b / 200], -1)
    t = np.where(f > 6 / 29, f**3, (f - 16 / 116) / 7.787) * _WHITE
    c = np.clip(t @ np.linalg.inv(_XYZ).T, 0, 1)
    return saturate(255 * np.where(c > 0.0031308, 1.055 * c ** (1 / 2.4) - 0.055, 12.92 * c))


def clahe(channel: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation: clipped tile histograms, blended between tile centres."""
    h, w = channel.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(channel, ((0, th * tiles - h), (0, tw * tiles - w)), mode="edge" if min(h, w) <= max(th * tiles - h, tw * tiles - w) else "reflect")
    blocks = p.reshape(tiles, th, tiles, tw).swapaxes(1, 2).reshape(tiles * tiles, -1)
    counts = np.stack([np.bincount(b, minlength=256) for b in blocks]).astype(float)
    limit = max(1, int(clip * th * tw / 256))
    over = np.maximum(counts - limit, 0).sum(1, keepdims=True)
    maps = saturate(np.cumsum(np.minimum(counts, limit) + over / 256, 1) * (255 / (th * tw))).reshape(tiles, tiles, 256).astype(float)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda yy, xx: maps[np.clip(yy, 0, tiles - 1)[:, None], np.clip(xx, 0, tiles - 1)[None, :], channel]
    return saturate((at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy)


def denoise(image: np.ndarray, strength: float = 10.0, patch: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means over Lab: each pixel the mean of those in the search window, weighted by how alike their patches are."""
    lab = to_lab(image).astype(float)
    r, s = patch // 2, search // 2
    h, w = lab.shape[:2]
    out = np.empty_like(lab)
    for part in (slice(0, 1), slice(1, 3)):
        v = lab[..., part]
        p = _pad(v, r + s)
        core = p[s : s + h + 2 * r, s : s + w + 2 * r]
        total, weight = np.zeros_like(v), np.zeros((h, w, 1))
        for dy in range(-s, s + 1):
            for dx in range(-s, s + 1):
                moved = p[s + dy : s + dy + h + 2 * r, s + dx : s + dx + w + 2 * r]
                sums = np.pad(((core - moved) ** 2).mean(-1), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
                far = (sums[patch:, patch:] - sums[:-patch, patch:] - sums[patch:, :-patch] + sums[:-patch, :-patch]) / patch**2
                k = np.exp(-far / strength**2)[..., None]
                total += k * moved[r : r + h, r : r + w]
                weight += k
        out[..., part] = total / weight
    return from_lab(saturate(out).astype(float))


def preprocess(image: np.ndarray) -> np.ndarray:
    """Turn upright, equalise the lightness, denoise, sharpen."""
    lab = to_lab(upright(image))
    lab[..., 0] = clahe(lab[..., 0])
    return filter2d(denoise(from_lab(lab.astype(float))), SHARPEN_FRAME)


def otsu(patch: np.ndarray) -> np.ndarray:
    """True where a pixel is over the threshold that separates the two classes best."""
    counts = np.bincount(patch.ravel(), minlength=256).astype(float)
    below, total = counts.cumsum(), counts.sum()
    mass = (counts * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((mass[-1] * below / total - mass) ** 2 / (below * (total - below)))
    return patch > int(between.argmax())


def dilate(mask: np.ndarray) -> np.ndarray:
    p = np.pad(mask, 1)
    h, w = mask.shape
    return np.logical_or.reduce([p[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)])


def canny(g: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edges: thinned gradient maxima over `high`, and those over `low` that touch them."""
    gx, gy = sobel(g)
    size = np.abs(gx) + np.abs(gy)
    p, (h, w) = np.pad(size, 1), size.shape
    turn = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    keep = np.zeros((h, w), bool)
    for t, (dx, dy) in enumerate(((1, 0), (1, 1), (0, 1), (-1, 1))):
        ahead, behind = p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], p[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w]
        keep |= (turn == t) & (size > behind) & (size >= ahead)
    weak, edges = keep & (size > low), keep & (size > high)
    while True:
        grown = dilate(edges) & weak
        if (grown == edges).all():
            return edges
        edges = grown


def fast(g: np.ndarray, threshold: int) -> np.ndarray:
    """(x, y) of corners: nine of the sixteen pixels around in a row all brighter or all darker; only local maxima."""
    h, w = g.shape
    if h < 7 or w < 7:
        return np.zeros((0, 2), int)
    v = g.astype(int)
    ring = np.stack([v[3 + dy : h - 3 + dy, 3 + dx : w - 3 + dx] for dx, dy in RING]) - v[3:-3, 3:-3]
    twice = np.concatenate([ring, ring[:8]])
    score = np.zeros(ring.shape[1:], int)
    for sign in (1, -1):
        runs = np.stack([(sign * twice[i : i + 9]).min(0) for i in range(16)])
        score = np.maximum(score, runs.max(0))
    score = np.where(score > threshold, score, 0)
    p = np.pad(score, 1)
    around = np.max([p[dy : dy + score.shape[0], dx : dx + score.shape[1]] for dy in range(3) for dx in range(3) if (dy, dx) != (1, 1)], 0)
    y, x = np.nonzero((score > 0) & (score > around))
    return np.stack([x + 3, y + 3], 1)


def contours(mask: np.ndarray) -> list[np.ndarray]:
    """Outer borders of the 8-connected regions, as (x, y) points in order, straight runs cut to their ends."""
    p = np.pad(mask.astype(bool), 1)
    ways = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
    left, found = p.copy(), []
    for y, x in zip(*np.nonzero(p & ~np.roll(p, 1, 1)), strict=True):
        if not left[y, x]:
            continue
        region, todo = [], [(x, y)]  # take the region, so that its inner borders are not followed
        left[y, x] = False
        while todo:
            cx, cy = todo.pop()
            region.append((cx, cy))
            for dx, dy in ways:
                if left[cy + dy, cx + dx]:
                    left[cy + dy, cx + dx] = False
                    todo.append((cx + dx, cy + dy))
        sx, sy = min(region, key=lambda q: (q[1], q[0]))
        border, (cx, cy), way = [(sx, sy)], (sx, sy), 0
        while len(border) <= 4 * len(region) + 4:
            for k in range(8):
                nway = (way + 6 + k) % 8
                nx, ny = cx + ways[nway][0], cy + ways[nway][1]
                if p[ny, nx]:
                    break
            else:
                break
            if (cx, cy) == (sx, sy) and len(border) > 1 and (nx, ny) == border[1]:
                border.pop()
                break
            (cx, cy), way = (nx, ny), nway
            border.append((cx, cy))
        b = np.array(border) - 1
        if len(b) > 2:
            ahead, behind = np.roll(b, -1, 0) - b, b - np.roll(b, 1, 0)
            b = b[(ahead != behind).any(1)] if (ahead != behind).any() else b[:1]
        found.append(b)
    return found


def area(contour: np.ndarray) -> float:
    x, y = contour[:, 0].astype(float), contour[:, 1].astype(float)
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


def perimeter(contour: np.ndarray) -> float:
    return float(np.hypot(*(contour - np.roll(contour, -1, 0)).T).sum())


def circularity(g: np.ndarray, x: int, y: int, size: int) -> float | None:
    """Of the largest region of the thresholded patch around a point; None if it has no area."""
    half = size // 2
    patch = g[max(0, y - half) : min(g.shape[0], y + half), max(0, x - half) : min(g.shape[1], x + half)]
    if not patch.size:
        return None
    largest = max(contours(otsu(patch)), key=area, default=None)
    if largest is None or area(largest) <= 0 or perimeter(largest) <= 0:
        return None
    return 4 * np.pi * area(largest) / perimeter(largest) ** 2


def fit_ellipse(points: np.ndarray) -> tuple[float, float, float, float, float] | None:
    """cx, cy, width, height, angle (degrees, of the width axis) of the least-squares ellipse of five points or more; None if there is none."""
    if len(points) < 5:
        return None
    q = points.astype(float)
    middle, scale = q.mean(0), max(1e-9, q.std())
    x, y = ((q - middle) / scale).T
    quadratic, linear = np.stack([x * x, x * y, y * y], 1), np.stack([x, y, np.ones_like(x)], 1)
    try:
        back = -np.linalg.solve(linear.T @ linear, (quadratic.T @ linear).T)
        m = quadratic.T @ quadratic + quadratic.T @ linear @ back
        values, vectors = np.linalg.eig(np.array([m[2] / 2, -m[1], m[0] / 2]))
    except np.linalg.LinAlgError:
        return None
    vectors = np.real(vectors)
    good = 4 * vectors[0] * vectors[2] - vectors[1] ** 2 > 0
    if not good.any():
        return None
    a, b, c = vectors[:, np.flatnonzero(good)[np.argmin(np.abs(values[good]))]]
    d, e, f = back @ np.array([a, b, c])
    shape = np.array([[a, b / 2], [b / 2, c]])
    centre = np.linalg.solve(-2 * shape, [d, e])
    level = -(f + (d * centre[0] + e * centre[1]) / 2)
    eigen, axes = np.linalg.eigh(shape / level if level else shape)
    if not np.isfinite(eigen).all() or (eigen <= 0).any():
        return None
    w, h = 2 * scale / np.sqrt(eigen[::-1])
    angle = np.degrees(np.arctan2(axes[1, 1], axes[0, 1])) % 180
    return float(centre[0] * scale + middle[0]), float(centre[1] * scale + middle[1]), float(w), float(h), float(angle)


def hough_segments(edges: np.ndarray, threshold: int = 100, least: float = 20.0, gap: float = 10.0) -> list[tuple[int, int, int, int]]:
    """Segments along the most voted lines (1 pixel, 1 degree), in order of votes; each edge pixel serves one segment.

    The same search for every run: the votes decide, where other implementations draw pixels at random.
    """
    y, x = np.nonzero(edges)
    turns = np.radians(np.arange(180))
    cos, sin = np.cos(turns), np.sin(turns)
    reach = int(np.hypot(*edges.shape)) + 1
    out, free = [], np.ones(len(x), bool)
    rho = np.rint(x[:, None] * cos + y[:, None] * sin).astype(int) + reach
    votes = np.zeros((180, 2 * reach + 2), int)
    np.add.at(votes, (np.broadcast_to(np.arange(180), rho.shape), rho), 1)
    while len(x):
        t, r = np.unravel_index(votes.argmax(), votes.shape)
        if votes[t, r] < threshold:
            break
        on = np.flatnonzero(free & (rho[:, t] == r))
        along = -x[on] * sin[t] + y[on] * cos[t]
        on, along = on[np.argsort(along, kind="stable")], np.sort(along)
        for run in np.split(np.arange(len(on)), np.flatnonzero(np.diff(along) > gap) + 1):
            if len(run) and along[run[-1]] - along[run[0]] >= least:
                a, b = on[run[0]], on[run[-1]]
                out.append((int(x[a]), int(y[a]), int(x[b]), int(y[b])))
        free[on] = False
        np.subtract.at(votes, (np.broadcast_to(np.arange(180), rho[on].shape), rho[on]), 1)
        votes[t, r] = 0
    return out
