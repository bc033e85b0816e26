"""Geometry that has no closed form: convex hull, buffer area, overlap of polygons, rings from open lines.

Plain NumPy on one geometry at a time, called from Arrow-batched UDFs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import PARTS

Ring = list[tuple[float, float]]


def rings(parts: Iterable) -> list[list[Ring]]:
    return [[[(p["x"], p["y"]) for p in ring] for ring in part] for part in parts]


def ring_area(ring: Ring) -> float:
    """Signed: counter-clockwise rings are positive."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def hull(points: Iterable[tuple[float, float]]) -> Ring:
    """Convex hull, counter-clockwise (monotone chains)."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def chain(seq: Iterable[tuple[float, float]]) -> Ring:
        out: Ring = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(reversed(pts))


def clip_convex(subject: Ring, clip: Ring) -> Ring:
    """The part of a convex ring inside another one (both counter-clockwise)."""
    out = subject
    for a, b in zip(clip, clip[1:] + clip[:1], strict=True):
        if not out:
            return []
        side = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in out]
        kept: Ring = []
        for i, p in enumerate(out):
            q, s, t = out[i - 1], side[i - 1], side[i]
            if (s < 0) != (t < 0):
                k = s / (s - t)
                kept.append((q[0] + k * (p[0] - q[0]), q[1] + k * (p[1] - q[1])))
            if t >= 0:
                kept.append(p)
        out = kept
    return out


def triangles(parts: list[list[Ring]]) -> list[tuple[float, Ring]]:
    """Signed fan triangles whose indicator functions add up to the polygon's; outer rings count, holes are taken off."""
    out = []
    for part in parts:
        for i, ring in enumerate(part):
            ring = ring[:-1] if ring and ring[0] == ring[-1] else ring
            turn = 1.0 if (ring_area(ring) > 0) == (i == 0) else -1.0
            for a, b in zip(ring[1:], ring[2:], strict=False):
                tri = [ring[0], a, b]
                size = ring_area(tri)
                if size:
                    out.append((turn * math.copysign(1.0, size), tri if size > 0 else tri[::-1]))
    return out


def overlap_area(a: list[list[Ring]], b: list[list[Ring]]) -> float:
    """Area that two polygons share: signed sum over pairs of fan triangles."""
    total = 0.0
    right = triangles(b)
    for s, p in triangles(a):
        for t, q in right:
            total += s * t * ring_area(clip_convex(p, q))
    return max(0.0, total)


def triple_area(a: list[list[Ring]], b: list[list[Ring]], c: list[list[Ring]]) -> float:
    """Area that three polygons share."""
    total, second, third = 0.0, triangles(b), triangles(c)
    for s, p in triangles(a):
        for t, q in second:
            piece = clip_convex(p, q)
            if len(piece) > 2:
                for u, r in third:
                    both = clip_convex(piece, r)
                    if len(both) > 2:
                        total += s * t * u * ring_area(both)
    return max(0.0, total)


def _apart(px, py, ax, ay, ux, uy, size):
    """Distance of points from segments that begin at a and go `size` along the unit vector u."""
    dx, dy = px - ax, py - ay
    t = np.clip(dx * ux + dy * uy, 0, size)
    return np.hypot(dx - t * ux, dy - t * uy)


def _buffers(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Areas grown and shrunk by d > 0 of many polygons of as many edges each, from a to b: (polygon, edge, x or y).

    The points at distance d from the edges lie on circles around the corners and on the edges moved to both sides. Of
    each such curve the stretches nearer to some edge are taken out; the area follows from the rest as an integral along
    them (Green), outside the polygon for the grown area and inside for the shrunk one.
    """
    n, m = a.shape[:2]
    a, b = a - a[:, :1], b - a[:, :1]
    size = np.hypot(*np.moveaxis(b - a, 2, 0))
    u = (b - a) / size[..., None]
    first = ~np.triu((a[:, :, None] == a[:, None]).all(-1).swapaxes(1, 2), 1).any(1)
    # Curves: both sides of each edge (normal to its left or right), then the circles.
    owner = np.concatenate([np.repeat(np.arange(n), m)] * 3)
    edge = np.concatenate([np.tile(np.arange(m), n)] * 3)
    kind = np.repeat([1, -1, 0], n * m)
    keep = (kind != 0) | first[owner, edge]
    owner, edge, kind = owner[keep], edge[keep], kind[keep]
    grown, shrunk = np.zeros(n), np.zeros(n)
    step = max(1, (1 << 19) // (10 * m))
    for flat in (True, False):
        which = np.flatnonzero((kind != 0) == flat)
        for at in range(0, len(which), step):
            k = which[at : at + step]
            o, e, side = owner[k], edge[k], kind[k]
            r, c, own = d[o], a[o, e], u[o, e]
            nx, ny = -side * own[:, 1], side * own[:, 0]
            c = c + (r[:, None] * np.stack([nx, ny], 1) if flat else 0)
            end = size[o, e] if flat else np.full(len(k), 2 * math.pi)
            ea, eb, eu, es = a[o], b[o], u[o], size[o]
            # Where the curve may come within d of an edge or leave it.
            cuts = []
            with np.errstate(divide="ignore", invalid="ignore"):
                for q in (ea, eb):
                    dx, dy = c[:, None, 0] - q[..., 0], c[:, None, 1] - q[..., 1]
                    if flat:
                        mid = -(dx * own[:, None, 0] + dy * own[:, None, 1])
                        wide = np.sqrt(mid * mid - dx * dx - dy * dy + (r * r)[:, None])
                    else:
                        mid, wide = np.arctan2(-dy, -dx), np.arccos(np.minimum(np.hypot(dx, dy) / (2 * r[:, None]), 1))
                    cuts += [mid - wide, mid + wide]
                off = (c[:, None, 1] - ea[..., 1]) * eu[..., 0] - (c[:, None, 0] - ea[..., 0]) * eu[..., 1]
                for s in (1.0, -1.0):
                    far = s * r[:, None] - off
                    if flat:
                        cuts.append(far / (eu[..., 0] * own[:, None, 1] - eu[..., 1] * own[:, None, 0]))
                    else:
                        mid, wide = np.arctan2(eu[..., 0], -eu[..., 1]), np.arccos(np.clip(far / r[:, None], -1, 1))
                        cuts += [mid - wide, mid + wide]
            cuts = np.stack(cuts, -1)
            cuts = np.where(np.isfinite(cuts), cuts, 0.0)
            cuts = np.clip(cuts, 0, end[:, None, None]) if flat else np.mod(cuts, 2 * math.pi)
            cuts = np.sort(np.concatenate([cuts, np.zeros((*cuts.shape[:2], 1)), np.broadcast_to(end[:, None, None], (*cuts.shape[:2], 1))], -1), -1)

            def points(t: np.ndarray, i: np.ndarray, c: np.ndarray = c, own: np.ndarray = own, r: np.ndarray = r, flat: bool = flat) -> tuple[np.ndarray, np.ndarray]:
                if flat:
                    return c[i, 0] + t * own[i, 0], c[i, 1] + t * own[i, 1]
                return c[i, 0] + r[i] * np.cos(t), c[i, 1] + r[i] * np.sin(t)

            px, py = points((cuts[..., 1:] + cuts[..., :-1]) / 2, np.arange(len(k))[:, None, None])
            near = _apart(px, py, ea[..., None, 0], ea[..., None, 1], eu[..., None, 0], eu[..., None, 1], es[..., None]) < (r * (1 - 1e-9))[:, None, None]
            # Each stretch that is near begins one and ends one; where none is open the curve is part of the edge of the buffer.
            t = np.concatenate([cuts[..., :-1], cuts[..., 1:]], -1).reshape(len(k), -1)
            opened = np.concatenate([near, -near.astype(int)], -1).reshape(len(k), -1)
            order = np.argsort(t, axis=1, kind="stable")
            t, opened = np.take_along_axis(t, order, 1), np.cumsum(np.take_along_axis(opened, order, 1), 1)
            i, j = np.nonzero((opened[:, :-1] == 0) & (t[:, 1:] > t[:, :-1]))
            for s in range(0, len(i), step * 10):
                ii, jj = i[s : s + step * 10], j[s : s + step * 10]
                t0, t1 = t[ii, jj], t[ii, jj + 1]
                x, y = (v[:, None] for v in points((t0 + t1) / 2, ii))
                ax, ay, bx, by = ea[ii, :, 0], ea[ii, :, 1], eb[ii, :, 0], eb[ii, :, 1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    inside = (((ay > y) != (by > y)) & (x < ax + (y - ay) / (by - ay) * (bx - ax))).sum(1) % 2 == 1
                if flat:
                    # Of edges that lie on each other only the first counts.
                    foot = _apart(x - (r * nx)[ii, None], y - (r * ny)[ii, None], ax, ay, eu[ii, :, 0], eu[ii, :, 1], es[ii]) < 1e-9 * r[ii, None]
                    once = ~(foot & (np.arange(m) < e[ii, None])).any(1)
                    part = once * -side[ii] * (t1 - t0) * (c[ii, 0] * own[ii, 1] - c[ii, 1] * own[ii, 0]) / 2
                else:
                    part = r[ii] * (r[ii] * (t1 - t0) + c[ii, 0] * (np.sin(t1) - np.sin(t0)) - c[ii, 1] * (np.cos(t1) - np.cos(t0))) / 2
                np.add.at(grown, o[ii], np.where(inside, 0.0, part))
                np.add.at(shrunk, o[ii], np.where(inside, -part, 0.0))
    return grown, np.maximum(shrunk, 0.0)


def buffered_areas(polygons: list[list[list[Ring]] | None], distances: Iterable[float]) -> tuple[np.ndarray, np.ndarray]:
    """Areas of the points within each distance of a polygon, and of those deeper than that inside; exact.

    Polygons of as many edges are worked on together.
    """
    d = np.asarray(list(distances), float)
    grown, shrunk = np.full(len(d), np.nan), np.full(len(d), np.nan)
    by: dict[int, list[tuple[int, list]]] = {}
    for i, parts in enumerate(polygons):
        if parts is None or not d[i] >= 0:
            continue
        points = [p for part in parts for ring in part for p in ring]
        edges = [(a, b) for part in parts for ring in part for a, b in zip(ring, ring[1:], strict=False) if a != b]
        if d[i] == 0 or not edges:
            grown[i] = shrunk[i] = sum(abs(ring_area(ring)) * (1 if k == 0 else -1) for part in parts for k, ring in enumerate(part) if ring)
            grown[i] += math.pi * d[i] ** 2 if points else 0.0
        else:
            by.setdefault(len(edges), []).append((i, edges))
    for m, some in by.items():
        for at in range(0, len(some), step := max(1, 20_000 // m)):
            rows = np.array([i for i, _ in some[at : at + step]])
            both = np.array([e for _, e in some[at : at + step]], float)
            grown[rows], shrunk[rows] = _buffers(both[:, :, 0], both[:, :, 1], d[rows])
    return grown, shrunk


def join_lines(lines: list[Ring]) -> list[Ring]:
    """Closed rings made of lines that meet at their ends; lines that close no ring are left out."""
    open_lines = [list(x) for x in lines if len(x) > 1]
    out = []
    while open_lines:
        ring = open_lines.pop(0)
        grown = True
        while ring[0] != ring[-1] and grown:
            grown = False
            for i, other in enumerate(open_lines):
                if ring[-1] in (other[0], other[-1]):
                    ring += (other if other[0] == ring[-1] else other[::-1])[1:]
                    del open_lines[i]
                    grown = True
                    break
        if ring[0] == ring[-1] and len(ring) > 3:
            out.append(ring)
    return out


def inside_ring(p: tuple[float, float], ring: Ring) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def inner_point(ring: Ring) -> tuple[float, float]:
    """A point inside a simple ring: the middle of the widest inner stretch of a horizontal line through it."""
    ys = sorted({p[1] for p in ring})
    y = (ys[len(ys) // 2 - 1] + ys[len(ys) // 2]) / 2 if len(ys) > 1 else ys[0]
    cuts = sorted((bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True) if (ay > y) != (by > y))
    spans = [(b - a, (a + b) / 2) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
    return (max(spans)[1], y) if spans else ring[0]


def assemble(outers: list[Ring], inners: list[Ring]) -> list[list[Ring]]:
    """Polygons from outer rings (made counter-clockwise), each with the inner rings (clockwise) that lie in it."""
    polygons = [[r if ring_area(r) > 0 else r[::-1]] for r in outers if len(r) > 3 and ring_area(r)]
    for hole in (r if ring_area(r) < 0 else r[::-1] for r in inners if len(r) > 3 and ring_area(r)):
        homes = [p for p in polygons if inside_ring(inner_point(hole), p[0])]
        if homes:
            min(homes, key=lambda p: abs(ring_area(p[0]))).append(hole)
    return polygons


def repair(parts: list[list[Ring]]) -> list[list[Ring]]:
    """Rings closed, repeated points and spikes taken out, degenerate rings dropped, outer rings counter-clockwise."""
    out = []
    for part in parts:
        rings_ = []
        for ring in part:
            pts = [p for i, p in enumerate(ring) if i == 0 or p != ring[i - 1]]
            pts = pts[:-1] if len(pts) > 1 and pts[0] == pts[-1] else pts
            changed = True
            while changed and len(pts) > 2:
                changed = False
                for i in range(len(pts)):
                    a, b, c = pts[i - 1], pts[i], pts[(i + 1) % len(pts)]
                    cross = (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])
                    back = (b[0] - a[0]) * (c[0] - b[0]) + (b[1] - a[1]) * (c[1] - b[1])
                    if cross == 0 and back <= 0:
                        del pts[i]
                        changed = True
                        break
            if len(pts) > 2 and ring_area(pts):
                wanted = not rings_
                pts = pts if (ring_area(pts) > 0) == wanted else pts[::-1]
                rings_.append([*pts, pts[0]])
        if rings_:
            out.append(rings_)
    return out


def union_tiles(polygons: list[list[list[Ring]]]) -> list[list[Ring]]:
    """Union of polygons that overlap at most along shared edges: edges used in both directions cancel."""
    count: dict[tuple, int] = {}
    for parts in polygons:
        for part in repair(parts):
            for ring in part:
                for a, b in zip(ring, ring[1:], strict=False):
                    if count.get((b, a)):
                        count[(b, a)] -= 1
                    else:
                        count[(a, b)] = count.get((a, b), 0) + 1
    follow: dict[tuple, list] = {}
    for (a, b), n in count.items():
        follow.setdefault(a, []).extend([b] * n)
    made: list[Ring] = []
    while any(follow.values()):
        at = min(k for k, v in follow.items() if v)
        ring, where = [at], {at: 0}
        while follow.get(at):
            at = follow[at].pop(0)
            if at in where:
                made.append([*ring[where[at] :], at])
                for p in ring[where[at] + 1 :]:
                    where.pop(p, None)
                ring = ring[: where[at] + 1]
            else:
                where[at] = len(ring)
                ring.append(at)
    return assemble([r for r in made if ring_area(r[:-1]) > 0], [r for r in made if ring_area(r[:-1]) < 0])


def as_points(parts: list[list[Ring]]) -> list[list[list[dict]]]:
    return [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in part] for part in parts]


def _overlaps(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([overlap_area(rings(p), rings(q)) for p, q in zip(a, b, strict=True)], dtype=float)


def _triples(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([triple_area(rings(p), rings(q), rings(r)) for p, q, r in zip(a, b, c, strict=True)], dtype=float)


def _hulls(parts: pd.Series) -> pd.DataFrame:
    out = []
    for p in parts:
        h = hull(q for part in rings(p) for ring in part for q in ring)
        out.append((abs(ring_area(h)), sum(math.dist(a, b) for a, b in zip(h, h[1:] + h[:1], strict=True))) if h else (0.0, 0.0))
    return pd.DataFrame(out, columns=["area", "perimeter"])


def _buffered(parts: pd.Series, distance: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("grown", "shrunk"), buffered_areas([None if p is None else rings(p) for p in parts], distance), strict=True)))


def _repaired(parts: pd.Series) -> pd.Series:
    return pd.Series([as_points(repair(rings(p))) if p is not None else None for p in parts], dtype=object)


# UDFs are made when they are used: workers import this module without a session.


def overlap_area_udf(a: Column, b: Column) -> Column:
    return F.pandas_udf(_overlaps, "double")(a, b)


def triple_area_udf(a: Column, b: Column, c: Column) -> Column:
    return F.pandas_udf(_triples, "double")(a, b, c)


def hull_udf(parts: Column) -> Column:
    return F.pandas_udf(_hulls, "struct<area:double,perimeter:double>")(parts)


def buffered_areas_udf(parts: Column, distance: Column) -> Column:
    return F.pandas_udf(_buffered, "struct<grown:double,shrunk:double>")(parts, distance)


def repair_udf(parts: Column) -> Column:
    return F.pandas_udf(_repaired, PARTS)(parts)
