"""Dense image kernels on numpy arrays: gray is uint8 (h, w), ink is bool (h, w)."""

from __future__ import annotations

import numpy as np

BAND_ROWS = 128
EDGE_BAND_MM, FRINGE = 10.0, 2
#: Page kinds' constants (as in the relational twins).
PAPER_BAND, PAPER_FRACTION, SMOOTH_LIMIT, MIN_CONTRAST = 20, 0.6, 0.08, 20.0
PAPERS_MM = [("A6", 105, 148), ("A5", 148, 210), ("A4", 210, 297), ("Letter", 216, 279)]


def histogram(gray: np.ndarray) -> np.ndarray:
    return np.bincount(gray.ravel(), minlength=256)


def cropped(gray: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    """Rows y0 to y1 and columns x0 to x1 (ends exclusive), as a page of its own."""
    return gray[y0:y1, x0:x1].copy()


def _best_split(gray: np.ndarray) -> tuple[int, float, float] | None:
    """Threshold of the largest between-class variance (the smallest of equals) and both means; None for a flat or empty page."""
    n = histogram(gray).astype(np.float64)
    levels = np.arange(256)
    below, total = np.concatenate([[0], np.cumsum(n)])[:256], n.sum()
    s, whole = np.concatenate([[0], np.cumsum(n * levels)])[:256], (n * levels).sum()
    ok = np.flatnonzero((below > 0) & (below < total))
    ok = ok[ok >= 1]
    if not len(ok):
        return None
    m0, m1 = s[ok] / below[ok], (whole - s[ok]) / (total - below[ok])
    v = below[ok] * (total - below[ok]) * (m0 - m1) * (m0 - m1)
    k = int(np.argmax(v))
    return (int(ok[k]), float(m0[k]), float(m1[k])) if v[k] > 0 else None


def otsu(gray: np.ndarray) -> int:
    best = _best_split(gray)
    return best[0] if best else 128


def class_means(gray: np.ndarray) -> tuple[float, float] | None:
    best = _best_split(gray)
    return best[1:] if best else None


def classify(gray: np.ndarray) -> str:
    """text or photo, by the paper peak and by smooth areas of middle levels."""
    if not gray.size:
        return "text"
    sums = np.concatenate([[0], np.cumsum(histogram(gray))])
    c = np.arange(256)
    mass = sums[np.minimum(256, c + PAPER_BAND + 1)] - sums[np.maximum(0, c - PAPER_BAND)]
    peak = int(np.argmax(mass))
    if peak < 128 or mass[peak] / gray.size < PAPER_FRACTION:
        return "photo"
    high = peak - PAPER_BAND - 5
    h, w = gray.shape
    if high <= 40 or h < 3 or w < 3:
        return "text"
    step = max(1, min(w, h) // 512)
    ys, xs = np.arange(1, h - 1, step), np.arange(1, w - 1, step)
    at = lambda dy, dx: gray[np.ix_(ys + dy, xs + dx)].astype(np.int16)
    near = np.stack([at(0, -1), at(0, 1), at(-1, 0), at(1, 0)])
    middle = (at(0, 0) >= 40) & (at(0, 0) <= high)
    smooth = middle & (near.max(axis=0) - near.min(axis=0) < 12)
    return "text" if smooth.mean() <= SMOOTH_LIMIT else "photo"


def sauvola(gray: np.ndarray, dpi: int, k: float = 0.15, r: int | None = None) -> np.ndarray:
    """Ink by the local mean and deviation, in bands of rows: memory is a band's, not the page's."""
    h, w = gray.shape
    r = (max(25, dpi // 6) | 1) // 2 if r is None else r
    ink = np.zeros((h, w), bool)
    x0, x1 = np.maximum(0, np.arange(w) - r), np.minimum(w, np.arange(w) + r + 1)
    for start in range(0, h, BAND_ROWS):
        end = min(h, start + BAND_ROWS)
        low, high = max(0, start - r), min(h, end + r)
        strip = gray[low:high].astype(np.int64)
        sums, squares = np.zeros((high - low + 1, w + 1), np.int64), np.zeros((high - low + 1, w + 1), np.int64)
        sums[1:, 1:], squares[1:, 1:] = strip.cumsum(0).cumsum(1), (strip * strip).cumsum(0).cumsum(1)
        ys = np.arange(start, end)
        a, b = np.maximum(0, ys - r) - low, np.minimum(h, ys + r + 1) - low
        box = lambda t: (t[np.ix_(b, x1)] + t[np.ix_(a, x0)] - t[np.ix_(a, x1)] - t[np.ix_(b, x0)]).astype(np.float64)  # noqa: B023, E731
        n = ((b - a)[:, None] * (x1 - x0)[None, :]).astype(np.float64)
        mean = box(sums) / n
        variance = np.maximum(0.0, box(squares) / n - mean * mean)
        ink[start:end] = gray[start:end] < mean * (1 + k * (np.sqrt(variance) / 128.0 - 1))
    return ink


def damage(gray: np.ndarray, ink: np.ndarray, block: int = 4, tile_blocks: int = 64, min_content: int = 24) -> float:
    """The worst tile's disagreement between gray blocks and the binary image in the tile's own levels."""
    sh, sw = gray.shape[0] // block, gray.shape[1] // block
    means = class_means(gray)
    if not sh or not sw or means is None or means[1] - means[0] <= MIN_CONTRAST:
        return 0.0
    ink_level, paper = means
    contrast = paper - ink_level
    area, mask = gray[: sh * block, : sw * block].astype(np.float64), ink[: sh * block, : sw * block]
    ys, xs = np.arange(0, sh * block, block * tile_blocks), np.arange(0, sw * block, block * tile_blocks)
    tiles = lambda a: np.add.reduceat(np.add.reduceat(a, ys, axis=0), xs, axis=1)
    ink_n, pap_n = tiles(mask.astype(np.float64)), tiles((~mask).astype(np.float64))
    with np.errstate(invalid="ignore", divide="ignore"):
        t_ink = np.where(ink_n > 50, tiles(np.where(mask, area, 0)) / ink_n, ink_level)
        t_pap = np.where(pap_n > 50, tiles(np.where(mask, 0, area)) / pap_n, paper)
    t_contrast = np.maximum(t_pap - t_ink, 0.3 * contrast)
    cells = area.reshape(sh, block, sw, block)
    mean, share = cells.mean(axis=(1, 3)), mask.reshape(sh, block, sw, block).mean(axis=(1, 3))
    content = (mean < paper - 0.15 * contrast) & (cells.max(axis=(1, 3)) - cells.min(axis=(1, 3)) > 0.3 * contrast)
    ty, tx = np.arange(sh)[:, None] // tile_blocks, np.arange(sw)[None, :] // tile_blocks
    off = np.abs(share * t_ink[ty, tx] + (1 - share) * t_pap[ty, tx] - mean) / t_contrast[ty, tx]
    flat = (ty * t_ink.shape[1] + tx)[content]
    n = np.bincount(flat, minlength=t_ink.size)
    total = np.bincount(flat, off[content], minlength=t_ink.size)
    good = n >= min_content
    return float((total[good] / n[good]).max()) if good.any() else 0.0


def components(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, int]:
    """Labels (1.., 0 outside) of the connected parts of a mask and their number, by union-find over runs of each row."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    change = np.diff(padded, axis=1)
    rows, starts = np.nonzero(change == 1)
    ends = np.nonzero(change == -1)[1]
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(rows, np.arange(h + 1))
    reach = 1 if diagonal else 0
    s, e = starts.tolist(), ends.tolist()
    for y in range(1, h):
        i, i_end, j, j_end = int(first[y - 1]), int(first[y]), int(first[y]), int(first[y + 1])
        while i < i_end and j < j_end:
            if s[i] < e[j] + reach and s[j] < e[i] + reach:
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if e[i] < e[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(i) for i in range(len(rows))], np.int64)
    _, numbers = np.unique(roots, return_inverse=True) if len(roots) else (None, np.zeros(0, np.int64))
    labels = np.zeros((h, w), np.int32)
    lengths = ends - starts
    if len(rows):
        at = np.repeat(rows * w + starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        labels.ravel()[at] = np.repeat(numbers + 1, lengths)
    return labels, int(numbers.max()) + 1 if len(numbers) else 0


def despeckle(ink: np.ndarray, min_size: int = 4, remove_border: bool = False) -> np.ndarray:
    """Ink without 8-connected parts of fewer than min_size pixels (and without those at the border)."""
    labels, n = components(ink, True)
    drop = np.bincount(labels.ravel(), minlength=n + 1) < min_size
    if remove_border:
        for edge in (labels[0], labels[-1], labels[:, 0], labels[:, -1]):
            drop[edge] = True
    drop[0] = False
    return ink & ~drop[labels]


def clean_edges(gray: np.ndarray, dpi: int) -> np.ndarray:
    """A copy in which dark border parts that stay within a thin band are whitened, with a fringe of two pixels.

    Parts are taken in the order of their first border pixel (top and bottom by
    column, then left and right by row): a fringe can change what later ones are.
    """
    h, w = gray.shape
    means = class_means(gray)
    if w <= 8 or h <= 8 or means is None or means[1] - means[0] <= MIN_CONTRAST:
        return gray
    dark = min(255, int((means[0] + means[1]) / 2))
    band, paper = max(4, int(EDGE_BAND_MM / 25.4 * dpi)), min(255, int(means[1] + 0.5))
    out = gray.copy()
    top = np.stack([np.arange(w), (h - 1) * w + np.arange(w)], axis=1).ravel()
    side = np.stack([np.arange(1, h - 1) * w, np.arange(1, h - 1) * w + w - 1], axis=1).ravel()
    seeds = np.concatenate([top, side])
    seeds = seeds[out.ravel()[seeds] < dark]
    if not len(seeds):
        return gray
    labels, _ = components(out < dark, False)
    flat, visited = out.ravel(), np.zeros(h * w, bool)
    ys, xs = np.divmod(np.arange(h * w), w)
    depth = np.minimum(np.minimum(xs, w - 1 - xs), np.minimum(ys, h - 1 - ys))
    order = np.argsort(labels.ravel(), kind="stable")
    bounds = np.searchsorted(labels.ravel()[order], np.arange(labels.max() + 2))
    diamond = [(dy, dx) for dy in range(-FRINGE, FRINGE + 1) for dx in range(-(FRINGE - abs(dy)), FRINGE - abs(dy) + 1)]
    whitened = False
    for seed in seeds.tolist():
        if visited[seed] or flat[seed] >= dark:
            continue
        label = int(labels.ravel()[seed])
        part = order[bounds[label] : bounds[label + 1]]
        if whitened:  # an earlier fringe may have cut the part: flood what is left from this seed
            part = _flood(flat, part, seed, w, h, dark, visited)
        visited[part] = True
        if depth[part].max() > band:
            continue
        for dy, dx in diamond:
            y, x = ys[part] + dy, xs[part] + dx
            inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
            flat[y[inside] * w + x[inside]] = paper
        whitened = True
    return out


def _flood(flat: np.ndarray, part: np.ndarray, seed: int, w: int, h: int, dark: int, visited: np.ndarray) -> np.ndarray:
    """Pixels of a part that are still dark, unvisited and connected with the seed."""
    y0, x0 = part.min() // w, (part % w).min()
    mask = np.zeros(((part.max() // w) - y0 + 1, (part % w).max() - x0 + 1), bool)
    alive = part[(flat[part] < dark) & ~visited[part]]
    mask[alive // w - y0, alive % w - x0] = True
    labels, _ = components(mask, False)
    ys, xs = np.nonzero(labels == labels[seed // w - y0, seed % w - x0])
    return (ys + y0) * w + xs + x0


def resample(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area averages downwards, linear interpolation upwards."""

    def axis(a: np.ndarray, n: int) -> np.ndarray:
        m = a.shape[0]
        if n == m:
            return a
        if n < m:
            sums = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)])
            at = np.arange(n + 1) * m / n
            k = np.minimum(np.floor(at).astype(int), m - 1)
            edge = sums[k] + a[k] * (at - k)[:, None]
            return np.diff(edge, axis=0) / (m / n)
        at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        k = np.minimum(at.astype(int), m - 2) if m > 1 else np.zeros(n, int)
        f = (at - k)[:, None]
        return a[k] * (1 - f) + a[np.minimum(k + 1, m - 1)] * f

    out = axis(axis(gray.astype(np.float64), height).T, width).T
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def scaled(gray: np.ndarray, scale: float) -> np.ndarray:
    h, w = gray.shape
    return resample(gray, max(1, int(h * scale + 0.5)), max(1, int(w * scale + 0.5)))


def snap_to_paper(crop: tuple[int, int, int, int], w: int, h: int, dpi: int, slack: float) -> tuple[int, int, int, int] | None:
    """The crop grown to the first standard size that holds it within the slack."""
    x0, y0, x1, y1 = crop
    per_mm = dpi / 25.4
    wide, high = (x1 - x0) / per_mm, (y1 - y0) / per_mm
    for pw, ph in [s for _, a, b in PAPERS_MM for s in ((a, b), (b, a))]:
        if wide <= pw <= wide + slack and high <= ph <= high + slack:
            tw, th = int(pw * per_mm), int(ph * per_mm)
            nx, ny = min(x0, max(0, w - tw)), min(y0, max(0, h - th))
            return nx, ny, min(w, nx + tw), min(h, ny + th)
    return None


def _trim(mass: np.ndarray) -> tuple[int, int]:
    """First and last place after cutting tails of up to 0.3 % of the mass each."""
    at = np.flatnonzero(mass)
    budget = int(mass.sum()) * 3 // 1000
    low = int(np.searchsorted(np.cumsum(mass), budget, "right"))
    high = len(mass) - 1 - int(np.searchsorted(np.cumsum(mass[::-1]), budget, "right"))
    return min(max(low, int(at[0])), int(at[-1])), max(min(high, int(at[-1])), min(max(low, int(at[0])), int(at[-1])))


def content_crop(ink: np.ndarray, dpi: int, margin_mm: float = 8, cluster_mm: float = 12, slack_mm: float = 25, fixed_mm: tuple[float, float] | None = None) -> tuple[int, int, int, int] | None:
    """x0, y0, x1, y1 of the main ink with a margin, at a standard size where one fits; None for a blank page."""
    h, w = ink.shape
    if not ink.any():
        return None
    sh, sw = -(-h // 8), -(-w // 8)
    padded = np.zeros((sh * 8, sw * 8), bool)
    padded[:h, :w] = ink
    small = padded.reshape(sh, 8, sw, 8).any(axis=(1, 3))
    blob = small.copy()
    for _ in range(max(1, int(cluster_mm / 25.4 * dpi / 8))):
        grown = blob.copy()
        grown[1:] |= blob[:-1]
        grown[:-1] |= blob[1:]
        grown[:, 1:] |= blob[:, :-1]
        grown[:, :-1] |= blob[:, 1:]
        blob = grown
    labels, n = components(blob, False)
    counts = np.bincount(labels[small], minlength=n + 1)
    keep = counts >= max(8, int(counts.max()) // 200)
    keep[0] = False
    kept = ink & np.repeat(np.repeat(keep[labels], 8, axis=0), 8, axis=1)[:h, :w]
    if not kept.any():
        return None
    columns, rows = kept.sum(axis=0), kept.sum(axis=1)
    xs, ys = np.flatnonzero(columns), np.flatnonzero(rows)
    m = int(margin_mm / 25.4 * dpi)
    raw = max(0, int(xs[0]) - m), max(0, int(ys[0]) - m), min(w, int(xs[-1]) + m), min(h, int(ys[-1]) + m)
    (tx0, tx1), (ty0, ty1) = _trim(columns), _trim(rows)
    if fixed_mm:
        tw, th = fixed_mm
        if (tx1 - tx0 >= ty1 - ty0) != (tw >= th):
            tw, th = th, tw
        pw, ph = int(tw * dpi / 25.4), int(th * dpi / 25.4)
        nx, ny = min(max(0, tx0 - m), max(0, w - pw)), min(max(0, ty0 - m), max(0, h - ph))
        return nx, ny, min(w, nx + pw), min(h, ny + ph)
    trimmed = max(0, tx0 - m), max(0, ty0 - m), min(w, tx1 + m), min(h, ty1 + m)
    return snap_to_paper(trimmed, w, h, dpi, slack_mm) or raw


def pack_bits(ink: np.ndarray) -> bytes:
    """Rows of bits, first pixel highest, 1 is white; a row's spare bits are 0."""
    return np.packbits(~ink, axis=1).tobytes()


def process_document(gray: np.ndarray, dpi: int, crop: bool = True, slack_mm: float = 25, fixed_mm: tuple[float, float] | None = None) -> tuple[int, int, int, int, bytes]:
    """Width, height, origin and packed bits of the thresholded, cleaned and cropped page."""
    ink = despeckle(gray < otsu(gray), remove_border=True)
    x0, y0, x1, y1 = (content_crop(ink, dpi, slack_mm=slack_mm, fixed_mm=fixed_mm) if crop else None) or (0, 0, ink.shape[1], ink.shape[0])
    return x1 - x0, y1 - y0, x0, y0, pack_bits(ink[y0:y1, x0:x1])
