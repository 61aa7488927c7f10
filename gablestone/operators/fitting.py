"""Iterative geometry on single polygons and small neighbourhoods, in numpy within grouped functions.

Own methods under stated invariants: rings are closed arrays of (x, y) rows. What is
claimed of each function is what its tests check.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Slack for areas and lengths that should be equal.
EPS = 1e-7


@dataclass(frozen=True)
class FitOptions:
    """Fixed defaults: tolerance in metres, merge angle in degrees, least area, filled holes, area change."""

    tolerance: float = 2.0
    merge_angle: float = 35.0
    min_area: float = 20.0
    fill_holes: float = 100.0
    max_area_change: float = 0.20


def area2(ring: np.ndarray) -> float:
    """Twice the signed area of a closed ring, taken about its first point."""
    p = ring - ring[0]
    return float(np.sum(p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]))


def area(rings: list[np.ndarray]) -> float:
    return abs(area2(rings[0])) / 2 - sum(abs(area2(r)) / 2 for r in rings[1:])


def vertices(rings: list[np.ndarray]) -> int:
    return sum(max(0, len(r) - 1) for r in rings)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise from the leftmost lowest point, not closed."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[np.ndarray] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def segments_cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix: whether segment i of a and segment j of b cross in their interiors. Rows are x0, y0, x1, y1."""
    side = lambda s, x, y: (s[:, None, 2] - s[:, None, 0]) * (y - s[:, None, 1]) - (s[:, None, 3] - s[:, None, 1]) * (x - s[:, None, 0])
    d1, d2 = side(a, b[None, :, 0], b[None, :, 1]), side(a, b[None, :, 2], b[None, :, 3])
    d3, d4 = side(b, a[None, :, 0], a[None, :, 1]).T, side(b, a[None, :, 2], a[None, :, 3]).T
    return (d1 * d2 < -1e-18) & (d3 * d4 < -1e-18)


def segments(ring: np.ndarray) -> np.ndarray:
    return np.hstack([ring[:-1], ring[1:]])


def simple(ring: np.ndarray) -> bool:
    """At least a triangle, of positive area, whose edges don't cross and whose vertices are distinct."""
    if len(ring) < 4 or abs(area2(ring)) < EPS or len(np.unique(ring[:-1], axis=0)) < len(ring) - 1:
        return False
    s = segments(ring)
    return not segments_cross(s, s).any()


def inside(points: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Even-odd rule over all rings."""
    out = np.zeros(len(points), bool)
    x, y = points[:, :1], points[:, 1:]
    for r in rings:
        (x0, y0), (x1, y1) = r[:-1].T, r[1:].T
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
        out ^= hit.sum(1) % 2 == 1
    return out


def distance_to_ring(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    a, d = ring[:-1], np.diff(ring, axis=0)
    dd = np.maximum((d * d).sum(1), 1e-300)
    t = np.clip(((points[:, None] - a) * d).sum(2) / dd, 0, 1)
    return np.sqrt((((a + t[..., None] * d) - points[:, None]) ** 2).sum(2)).min(1)


def dense(ring: np.ndarray, step: float) -> np.ndarray:
    """Points on the ring, at most a step apart."""
    out = []
    for p, q in zip(ring, ring[1:]):
        n = max(1, int(math.ceil(np.hypot(*(q - p)) / step)))
        out.append(p + (q - p) * np.arange(n)[:, None] / n)
    return np.vstack(out)


def hausdorff(a: np.ndarray, b: np.ndarray, step: float = 0.1) -> float:
    return float(max(distance_to_ring(dense(a, step), b).max(), distance_to_ring(dense(b, step), a).max()))


def overlap_area(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """Area that two polygons share: exact, by slabs between all heights at which edges begin, end or cross."""
    lo = np.maximum(a[0].min(0), b[0].min(0))
    hi = np.minimum(a[0].max(0), b[0].max(0))
    if (hi <= lo).any():
        return 0.0
    edges = [np.vstack([segments(r) for r in p]) for p in (a, b)]
    ys = [np.concatenate([e[:, 1], e[:, 3]]) for e in edges]
    s, t = edges[0][:, None], edges[1][None]
    d1, d2 = s[..., 2:] - s[..., :2], t[..., 2:] - t[..., :2]
    det = d1[..., 0] * d2[..., 1] - d1[..., 1] * d2[..., 0]
    w = t[..., :2] - s[..., :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        u = (w[..., 0] * d2[..., 1] - w[..., 1] * d2[..., 0]) / det
        v = (w[..., 0] * d1[..., 1] - w[..., 1] * d1[..., 0]) / det
    u, v = (np.nan_to_num(k, nan=-1.0, posinf=-1.0, neginf=-1.0) for k in (u, v))
    hit = (np.abs(det) > 1e-12) & (u >= 0) & (u <= 1) & (v >= 0) & (v <= 1)
    cuts = np.unique(np.concatenate([*ys, (s[..., 1] + u * d1[..., 1])[hit]]))
    cuts = cuts[(cuts >= lo[1]) & (cuts <= hi[1])]
    total = 0.0
    for y0, y1 in zip(cuts, cuts[1:]):
        if y1 - y0 < 1e-12:
            continue
        # Within a slab no edges cross, so shared intervals at both ends make trapezoids.
        total += (y1 - y0) * _shared(edges[0], edges[1], (y0 + y1) / 2)
    return float(total)


def _shared(a: np.ndarray, b: np.ndarray, y: float) -> float:
    spans = []
    for e in (a, b):
        live = e[(e[:, 1] > y) != (e[:, 3] > y)]
        xs = np.sort(live[:, 0] + (y - live[:, 1]) * (live[:, 2] - live[:, 0]) / (live[:, 3] - live[:, 1]))
        spans.append(list(zip(xs[::2], xs[1::2])))
    return sum(max(0.0, min(q, s) - max(p, r)) for p, q in spans[0] for r, s in spans[1])


def line_fit(chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Length-weighted total least squares: centre, direction, largest residual and span."""
    step = np.hypot(*np.diff(chain, axis=0).T)
    w = np.zeros(len(chain))
    w[:-1] += step / 2
    w[1:] += step / 2
    w = w if w.sum() > 0 else np.ones(len(chain))
    c = (chain * w[:, None]).sum(0) / w.sum()
    q = chain - c
    xx, xy, yy = (w * q[:, 0] ** 2).sum(), (w * q[:, 0] * q[:, 1]).sum(), (w * q[:, 1] ** 2).sum()
    angle = 0.5 * math.atan2(2 * xy, xx - yy)
    d = np.array([math.cos(angle), math.sin(angle)])
    along, off = q @ d, q @ np.array([-d[1], d[0]])
    return c, d, float(np.abs(off).max()), float(along.max() - along.min())


def peucker(points: np.ndarray, tolerance: float) -> list[int]:
    """Indices that Douglas and Peucker keep of an open line."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        i, j = todo.pop()
        if j <= i + 1:
            continue
        d = points[j] - points[i]
        q = points[i + 1 : j] - points[i]
        n = math.hypot(*d)
        off = np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / n if n > 0 else np.hypot(*q.T)
        k = int(off.argmax())
        if off[k] > tolerance:
            k += i + 1
            keep.add(k)
            todo += [(i, k), (k, j)]
    return sorted(keep)


def simplify(rings: list[np.ndarray], tolerance: float) -> list[np.ndarray]:
    """Each ring simplified, kept as it was where that would break it."""
    out = []
    for r in rings:
        far = int(np.hypot(*(r - r[0]).T).argmax())
        idx = peucker(r[: far + 1], tolerance)[:-1] + [far + i for i in peucker(r[far:], tolerance)]
        s = r[idx]
        out.append(s if simple(s) else r)
    return out


def fit_ring(ring: np.ndarray, tolerance: float, merge_angle: float = 35.0) -> np.ndarray:
    """The ring as few straight walls: breaks proposed by simplification, chains fitted as
    lines and split while they deviate, neighbours of like direction merged, corners where
    lines meet. Stays within the tolerance of the ring, or is the ring itself."""
    pts = ring[:-1]
    if len(pts) < 4 or len(np.unique(pts, axis=0)) < len(pts):
        return ring
    origin = pts.mean(0)
    p = pts - origin
    first = int(np.hypot(*p.T).argmax())
    p = np.roll(p, -first, axis=0)
    closed = np.vstack([p, p[:1]])
    far = int(np.hypot(*(closed - closed[0]).T).argmax())
    breaks = sorted({*peucker(closed[: far + 1], tolerance), *(far + i for i in peucker(closed[far:], tolerance))} - {len(p)})
    chain = lambda i, j: closed[i : j + 1] if i < j else np.vstack([closed[i:], closed[1 : j + 1]])
    for _ in range(len(p)):  # split where a wall bends
        for i, j in zip(breaks, [*breaks[1:], len(p)]):
            c = chain(i, j)
            centre, d, off, _ = line_fit(c)
            if off > tolerance and len(c) > 2:
                k = int(np.abs((c[1:-1] - centre) @ np.array([-d[1], d[0]])).argmax()) + i + 1
                breaks = sorted({*breaks, k})
                break
        else:
            break
    while len(breaks) > 3:  # merge what is one wall
        n = len(breaks)
        for a in range(n):
            i, m, j = breaks[a - 1], breaks[a], breaks[(a + 1) % n]
            one, two = line_fit(chain(i, m if m else len(p))), line_fit(chain(m, j if j else len(p)))
            turn = math.degrees(math.acos(min(1.0, abs(float(one[1] @ two[1])))))
            joint = np.vstack([chain(i, m if m else len(p)), chain(m, j if j else len(p))[1:]])
            if (turn <= merge_angle or min(one[3], two[3]) <= 2 * tolerance) and line_fit(joint)[2] <= tolerance:
                breaks.remove(m)
                break
        else:
            break
    n = len(breaks)
    lines = [line_fit(chain(breaks[a], breaks[(a + 1) % n] if breaks[(a + 1) % n] else len(p))) for a in range(n)]
    corners = []
    for a in range(n):
        (c0, d0, _, _), (c1, d1, _, _), anchor = lines[a - 1], lines[a], p[breaks[a] % len(p)]
        det = d0[0] * d1[1] - d0[1] * d1[0]
        if abs(det) < math.sin(math.radians(10)):
            at = (c0 + d0 * ((anchor - c0) @ d0) + c1 + d1 * ((anchor - c1) @ d1)) / 2
        else:
            w = c1 - c0
            at = c0 + d0 * (w[0] * d1[1] - w[1] * d1[0]) / det
        corners.append(at if np.hypot(*(at - anchor)) <= 2 * tolerance else anchor)
    out = np.array([*corners, corners[0]]) + origin
    if not simple(out) or (area2(out) > 0) != (area2(ring) > 0) or hausdorff(out, ring, max(tolerance / 4, 0.05)) > tolerance:
        return ring
    return out


def candidate(rings: list[np.ndarray], tolerance: float, options: FitOptions) -> tuple[list[np.ndarray] | None, str]:
    """The fitted polygon, or None and why it isn't taken."""
    if not all(map(simple, rings)):
        return None, "invalid_input"
    out = []
    for r in rings:
        fits = (fit_ring(r, tolerance * s, options.merge_angle) for s in (1.0, 0.5, 0.25))
        out.append(next((f for f in fits if len(f) < len(r)), r))
    if not all(map(simple, out)) or any(segments_cross(segments(a), segments(b)).any() for i, a in enumerate(out) for b in out[i + 1 :]):
        return None, "invalid_geometry"
    if any(not inside(h[:-1], [out[0]]).all() for h in out[1:]):
        return None, "hole_count"
    if vertices(out) >= vertices(rings):
        return None, "no_reduction"
    if area(out) < options.min_area:
        return None, "below_min_building_area_after_fit"
    before = area(rings)
    if abs(area(out) - before) > options.max_area_change * before:
        return None, "area_change"
    for a, b in zip(rings[1:], out[1:]):
        if abs(abs(area2(a)) - abs(area2(b))) > options.max_area_change * abs(area2(a)):
            return None, "hole_area_change"
    if before + area(out) - 2 * overlap_area(rings, out) > options.max_area_change * before:
        return None, "coverage_change"
    if max(hausdorff(a, b, max(tolerance / 4, 0.05)) for a, b in zip(rings, out)) > tolerance:
        return None, "boundary_offset"
    return out, "fitted"


def boxes_meet(a: np.ndarray, b: np.ndarray, slack: float) -> bool:
    return bool((a.min(0) - slack <= b.max(0)).all() and (b.min(0) - slack <= a.max(0)).all())


def fit_polygons(polygons: list[list[np.ndarray]], options: FitOptions = FitOptions()) -> list[dict]:  # noqa: B008
    """Fitted polygons in input order, each against its neighbours' current shapes.

    Polygons below the least area go first; then small holes that no other polygon lies in
    are filled; then each is fitted at the tolerance, its half and its quarter, and a fit is
    taken only if it overlaps no neighbour more than the original did.
    """
    kept = [(i, p) for i, p in enumerate(polygons) if simple(p[0]) and area(p) >= options.min_area or not simple(p[0])]
    shapes = [p for _, p in kept]
    out = []
    for k, (i, p) in enumerate(kept):
        holes = []
        for h in p[1:]:
            small = abs(area2(h)) / 2 <= options.fill_holes
            used = any(j != k and boxes_meet(h, q[0], 0) and overlap_area([h], q) > EPS for j, q in enumerate(shapes))
            if used or not small:
                holes.append(h)
        shapes[k] = [p[0], *holes]
        out.append({"source_index": i, "holes_filled": len(p) - 1 - len(holes), "v_old": vertices(p)})
    for k, report in enumerate(out):
        now, reasons = shapes[k], []
        near = [j for j in range(len(shapes)) if j != k and boxes_meet(now[0], shapes[j][0], 2 * options.tolerance)]
        before = {j: overlap_area(now, shapes[j]) if simple(shapes[j][0]) and simple(now[0]) else 0.0 for j in near}
        reason = "unchanged"
        for scale in (1.0, 0.5, 0.25):
            fit, why = candidate(now, options.tolerance * scale, options)
            if fit is not None and any(simple(shapes[j][0]) and overlap_area(fit, shapes[j]) > before[j] + EPS for j in near):
                fit, why = None, "neighbor_overlap"
            reasons.append(why)
            if fit is not None:
                shapes[k], reason = fit, "fitted"
                break
        report |= {"rings": shapes[k], "reason": reason, "attempt_reasons": reasons, "v_new": vertices(shapes[k]), "area_m2": area(shapes[k])}
    return out


def ear_clip(ring: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of a simple closed ring by vertex number; n - 2 of them, counter-clockwise."""
    v = ring[:-1]
    left = list(range(len(v))) if area2(ring) > 0 else list(range(len(v)))[::-1]
    out = []
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    while len(left) > 3:
        for k in range(len(left)):
            a, b, c = left[k - 1], left[k], left[(k + 1) % len(left)]
            if turn(v[a], v[b], v[c]) <= 1e-10:
                continue
            if any(turn(v[a], v[b], v[p]) >= -1e-10 and turn(v[b], v[c], v[p]) >= -1e-10 and turn(v[c], v[a], v[p]) >= -1e-10 for p in left if p not in (a, b, c)):
                continue
            out.append((a, b, c))
            left.pop(k)
            break
        else:
            left.pop(min(range(len(left)), key=lambda k: abs(turn(v[left[k - 1]], v[left[k]], v[left[(k + 1) % len(left)]]))))
    return [*out, tuple(left)]  # type: ignore[list-item]


def polygonize(cells: np.ndarray, x0: float = 0.0, ytop: float = 0.0, r: float = 0.5) -> list[list[np.ndarray]]:
    """Polygons with holes around the 4-connected components of cells (row, col)."""
    have = {(int(a), int(b)) for a, b in cells}
    todo, parts = set(have), []
    while todo:
        start = min(todo)
        todo.discard(start)
        part, stack = {start}, [start]
        while stack:
            i, j = stack.pop()
            for n in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if n in todo:
                    todo.discard(n)
                    part.add(n)
                    stack.append(n)
        parts.append(part)
    return [_trace(p, x0, ytop, r) for p in sorted(parts, key=min)]


def _trace(part: set[tuple[int, int]], x0: float, ytop: float, r: float) -> list[np.ndarray]:
    """Boundary rings of one component, with its cells on the left; the shell first."""
    nxt: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, j in part:
        for outside, a, b in (((i + 1, j), (i + 1, j), (i + 1, j + 1)), ((i, j + 1), (i + 1, j + 1), (i, j + 1)), ((i - 1, j), (i, j + 1), (i, j)), ((i, j - 1), (i, j), (i + 1, j))):
            if outside not in part:
                nxt.setdefault(a, []).append(b)
    rings = []
    while nxt:
        start = min(nxt)
        ring, at, way = [start], start, (0, 0)
        while True:
            options = nxt[at]
            # Where two cells touch at a corner only, turn so that the ring stays simple.
            right = lambda b: -((way[0] * (b[1] - at[1])) - (way[1] * (b[0] - at[0])))  # noqa: B023, E731
            b = max(options, key=right) if len(options) > 1 else options[0]
            options.remove(b)
            if not options:
                del nxt[at]
            step = (b[0] - at[0], b[1] - at[1])
            if step == way:
                ring[-1] = b
            else:
                ring.append(b)
            at, way = b, step
            if at == start:
                break
        if len(ring) > 3 and (ring[1][0] - ring[0][0]) * (ring[-2][1] - ring[0][1]) == (ring[1][1] - ring[0][1]) * (ring[-2][0] - ring[0][0]):
            ring = [*ring[1:-1], ring[1]]
        rings.append(np.array([(x0 + j * r, ytop - i * r) for i, j in ring]))
    rings.sort(key=lambda q: -abs(area2(q)))
    return rings


def split(ring: np.ndarray, a: np.ndarray, b: np.ndarray, beyond: float = 0.1) -> list[np.ndarray]:
    """The parts of a convex or simple ring on both sides of the line a-b, lengthened at its ends."""
    d = (b - a) / max(np.hypot(*(b - a)), 1e-12)
    a, b = a - d * beyond, b + d * beyond
    n = np.array([-d[1], d[0]])
    side = (ring - a) @ n
    cut = segments_cross(segments(ring), np.array([[*a, *b]]))
    if cut.sum() != 2:
        return [ring]
    parts: list[list[np.ndarray]] = [[], []]
    which = 0
    for k in range(len(ring) - 1):
        parts[which].append(ring[k])
        if cut[k, 0]:
            t = side[k] / (side[k] - side[k + 1])
            at = ring[k] + t * (ring[k + 1] - ring[k])
            parts[which].append(at)
            which = 1 - which
            parts[which].append(at)
    return [np.array([*p, p[0]]) for p in parts]


def snap_vertices(ring: np.ndarray, others: list[np.ndarray], threshold: float) -> np.ndarray:
    """Each vertex moved to the nearest vertex of the others within the threshold, else to the
    nearest point of their edges; others are tried in order and a closer one wins."""
    out = ring.copy()
    for k, p in enumerate(ring[:-1]):
        best, found = threshold, False
        for o in others:
            d = np.hypot(*(o[:-1] - p).T)
            if d.min() < best:
                best, found = float(d.min()), True
                out[k] = o[int(d.argmin())]
        if found:
            continue
        for o in others:
            s, e = o[:-1], np.diff(o, axis=0)
            t = np.clip(((p - s) * e).sum(1) / np.maximum((e * e).sum(1), 1e-300), 0, 1)
            q = s + t[:, None] * e
            d = np.hypot(*(q - p).T)
            if d.min() < best:
                best = float(d.min())
                out[k] = q[int(d.argmin())]
    out[-1] = out[0]
    return out


def snap_edges(ring: np.ndarray, other: np.ndarray, threshold: float) -> np.ndarray:
    """Ends of edges that are nearly parallel and close to an edge of the other are moved to it:
    to its nearer end within the threshold, else by projection, as far as three lengths before
    and four behind it."""
    out, best = ring.copy(), np.full(len(ring), np.inf)
    for k in range(len(ring) - 1):
        a0, a1 = ring[k], ring[k + 1]
        for b0, b1 in zip(other, other[1:]):
            turn = (math.atan2(*(a1 - a0)[::-1]) - math.atan2(*(b1 - b0)[::-1])) % math.pi
            if 0.35 < turn < math.pi - 0.35:
                continue
            d = float(min(distance_to_ring(np.array([a0, a1]), np.array([b0, b1])).min(), distance_to_ring(np.array([b0, b1]), np.array([a0, a1])).min()))
            if d >= threshold:
                continue
            for i, p in ((k, a0), (k + 1, a1)):
                if d > best[i]:
                    continue
                to0, to1 = np.hypot(*(p - b0)), np.hypot(*(p - b1))
                if min(to0, to1) < threshold:
                    target = b0 if to0 < to1 else b1
                else:
                    e = b1 - b0
                    t = float((p - b0) @ e / max(e @ e, 1e-300))
                    target = b0 if t < -3 else b1 if t > 4 else b0 + t * e
                if np.hypot(*(p - target)) < threshold:
                    out[i], best[i] = target, d
    last = len(ring) - 1
    if best[0] < best[last]:
        out[last] = out[0]
    else:
        out[0] = out[last]
    return out


def covered(shape: np.ndarray, above: list[np.ndarray], share: float = 0.5) -> bool:
    """Whether more than the share of a hull lies below the union of the hulls above it."""
    whole = abs(area2(np.vstack([shape, shape[:1]]))) / 2
    if whole < EPS or not above:
        return False
    return union_overlap(np.vstack([shape, shape[:1]]), [np.vstack([h, h[:1]]) for h in above]) > share * whole


def union_overlap(ring: np.ndarray, others: list[np.ndarray]) -> float:
    """Area of a ring that lies in the union of convex rings, by inclusion of slabs between all crossings."""
    every = [segments(ring), *map(segments, others)]
    ys = np.unique(np.concatenate([e[:, [1, 3]].ravel() for e in every]))
    all_ = np.vstack(every)
    s, t = all_[:, None], all_[None]
    d1, d2 = s[..., 2:] - s[..., :2], t[..., 2:] - t[..., :2]
    det = d1[..., 0] * d2[..., 1] - d1[..., 1] * d2[..., 0]
    w = t[..., :2] - s[..., :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        u = (w[..., 0] * d2[..., 1] - w[..., 1] * d2[..., 0]) / det
        v = (w[..., 0] * d1[..., 1] - w[..., 1] * d1[..., 0]) / det
    u, v = (np.nan_to_num(k, nan=-1.0, posinf=-1.0, neginf=-1.0) for k in (u, v))
    hit = (np.abs(det) > 1e-12) & (u > 0) & (u < 1) & (v > 0) & (v < 1)
    ys = np.unique(np.concatenate([ys, (s[..., 1] + u * d1[..., 1])[hit]]))
    total = 0.0
    for y0, y1 in zip(ys, ys[1:]):
        y = (y0 + y1) / 2
        spans = []
        for e in every:
            live = e[(e[:, 1] > y) != (e[:, 3] > y)]
            xs = np.sort(live[:, 0] + (y - live[:, 1]) * (live[:, 2] - live[:, 0]) / (live[:, 3] - live[:, 1]))
            spans.append(list(zip(xs[::2], xs[1::2])))
        joined: list[list[float]] = []
        for a, b in sorted(x for sp in spans[1:] for x in sp):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        total += (y1 - y0) * sum(max(0.0, min(q, d) - max(p, c)) for p, q in spans[0] for c, d in joined)
    return float(total)
