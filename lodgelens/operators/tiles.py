"""Points around probes, tile by tile, in numpy.

The kernels take Arrow batches sorted by ``_t`` (twice the tile's number, plus
one for points): of each tile first its probes, then its points, both as
(_lat, _lon).  A chunk is some whole tiles; the points of a tile larger than a
chunk come in several, each with the tile's probes, so memory is bounded by a
chunk and one tile's probes.  Counts and nearest candidates of a tile's parts
are merged by the caller.

A tile's points lie in stripes of latitude, by longitude within a stripe.  A
circle covers one run of a stripe: the bounds of its half width over the
stripe's height give the run that is surely inside, which is counted by two
binary searches, and the ends that have to be looked at.  The number of stripes
grows with the root of the points, so a circle's cost does too, not with the
points in it.

Whether a point is inside is decided here only where rounding can't matter;
pairs within 1e-9 of the limit, and all but equal nearest points, are given
back for Spark's own haversine to decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

EARTH_RADIUS_KM = 6371.0
ROW_BITS = 30  # of a tile's number: its place in the ring
CHUNK = 1 << 18  # rows of a chunk
BLOCK = 1 << 15  # (probe, stripe) pairs looked at together
PER_STRIPE = 6.5  # points a square of a stripe's height holds: a binary search costs as much as some 13 pairs
SLACK = 1e-6  # degrees; the sorted keys are exact to 1e-7
BAND = 1024.0  # a stripe's share of the sorted keys, more than all longitudes


def chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK) -> Iterator[tuple[pa.Table, pa.Table]]:
    """(probes, points) of whole tiles, of a large tile's points in parts."""
    held, n, kept = [], 0, 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < rows + 2 * kept:
            continue
        t = pa.Table.from_batches(held)
        key = t["_t"].to_numpy()
        start, points = np.searchsorted(key, [key[-1] >> 1 << 1, key[-1] | 1])
        if start:
            yield _parted(t.slice(0, start))
        if n - points >= rows:
            yield _parted(t.slice(start))
            t = t.slice(0, points)
        t = t.slice(start)
        held, n = t.to_batches(), t.num_rows
        kept = n
    if n:
        yield _parted(pa.Table.from_batches(held))


def _parted(t: pa.Table) -> tuple[pa.Table, pa.Table]:
    point = (t["_t"].to_numpy() & 1).astype(bool)
    return t.filter(pa.array(~point)), t.filter(pa.array(point))


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t[name].to_numpy()


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The numbers start .. start + len - 1 of all runs, one after the other."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


class Stripes:
    """The points of some tiles, in stripes."""

    def __init__(self, points: pa.Table, d: float):
        tile, lat, lon = _column(points, "_t") >> 1, _column(points, "_lat"), _column(points, "_lon")
        self.tiles, at, n = np.unique(tile, return_inverse=True, return_counts=True)
        y, x = self.tiles >> ROW_BITS, self.tiles & ((1 << ROW_BITS) - 1)
        edge = np.minimum(90, np.maximum(np.abs(y * d), np.abs((y + 1) * d)))
        self.ring = np.maximum(1, np.floor(360 * np.cos(np.radians(edge)) / d))
        self.middle = (x + 0.5) / self.ring * 360
        self.d, self.south, self.n = d, y * d, n
        self.count = np.maximum(1, np.ceil(np.sqrt(n / PER_STRIPE))).astype(np.int64)
        self.height = d / self.count
        self.first = np.cumsum(self.count) - self.count
        stripe = np.clip(np.floor((lat - self.south[at]) / self.height[at]).astype(np.int64), 0, self.count[at] - 1)
        key = (self.first[at] + stripe) * BAND + 256 + np.mod(lon + 180, 360)
        self.order = np.argsort(key)
        self.key, self.lat, self.lon = key[self.order], lat[self.order], lon[self.order]
        self.cos = np.cos(np.radians(self.lat))

    def among(self, probes: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the probes whose tile has points, and the tile's place."""
        tile = _column(probes, "_t") >> 1
        at = np.minimum(np.searchsorted(self.tiles, tile), len(self.tiles) - 1)
        rows = np.nonzero(self.tiles[at] == tile)[0]
        return rows, at[rows]

    def runs(self, at: np.ndarray, lat: np.ndarray, lon: np.ndarray, rho: np.ndarray, whole: np.ndarray):
        """Block by block of probes: their slice, and per probe and stripe that
        its circle of ``rho`` degrees meets the probe's place in the slice and
        the runs [out0, out1) that holds all points inside and [in0, in1) that
        holds only such.  ``whole``: probes for which all of the tile is run
        over, as those near a pole or in a tile of a wide ring."""
        whole = whole | (self.ring[at] < 8) | (np.abs(lat) + rho >= 89.9)
        south, height, last = self.south[at], self.height[at], self.count[at] - 1
        lo = np.clip(np.floor((lat - rho - 1e-9 - south) / height), 0, last + 1).astype(np.int64)
        hi = np.clip(np.floor((lat + rho + 1e-9 - south) / height), -1, last).astype(np.int64)
        lo, hi = np.where(whole, 0, lo), np.where(whole, last, hi)
        n = np.maximum(0, hi - lo + 1)
        u = np.mod(lon + 180, 360)
        u = u + 360 * np.round((self.middle[at] - u) / 360)
        limit = np.sin(np.radians(np.minimum(rho, 180)) / 2) ** 2
        done = np.cumsum(n)
        start = 0
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + BLOCK, "right")))
            here = slice(start, stop)
            own = np.repeat(np.arange(stop - start), n[here])
            i = start + own
            stripe = ranges(lo[here], n[here])
            low = south[i] + stripe * height[i]
            high, p = low + height[i], lat[i]
            near = np.maximum(0, np.maximum(low - p, p - high) - 1e-11)
            far = np.maximum(p - low, high - p) + 1e-11
            c0, c1 = np.cos(np.radians(low)), np.cos(np.radians(high))
            most = np.where((low < 0) & (high > 0), 1.0, np.maximum(c0, c1))
            cp = np.cos(np.radians(p))
            with np.errstate(all="ignore"):
                wide = (limit[i] * (1 + 1e-9) + 1e-24 - np.sin(np.radians(near) / 2) ** 2) / (cp * np.minimum(c0, c1))
                sure = (limit[i] * (1 - 1e-9) - np.sin(np.radians(far) / 2) ** 2) / (cp * most)
                wide = np.degrees(2 * np.arcsin(np.sqrt(np.clip(wide, 0, 1)))) + SLACK
                sure = np.where(sure > 0, np.degrees(2 * np.arcsin(np.sqrt(np.clip(sure, 0, 1)))) - SLACK, -1.0)
            sure[whole[i]] = -1.0
            base = (self.first[at[i]] + stripe) * BAND
            mid = base + 256 + u[i]
            left = np.where(whole[i], base, np.maximum(base, mid - wide))
            right = np.where(whole[i], base + BAND - 1, np.minimum(base + BAND - 1, mid + wide))
            out0, out1 = np.searchsorted(self.key, left, "left"), np.searchsorted(self.key, right, "right")
            in0, in1 = out1.copy(), out1.copy()
            has = np.nonzero((sure > 0) & (out1 > out0))[0]
            in0[has], in1[has] = np.searchsorted(self.key, mid[has] - sure[has], "left"), np.searchsorted(self.key, mid[has] + sure[has], "right")
            yield here, own, out0, out1, in0, in1
            start = stop

    def apart(self, lat: np.ndarray, lon: np.ndarray, cos: np.ndarray, own: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The haversine's inner term of pairs (place of a probe, place of a point)."""
        half = np.pi / 360
        north, east = np.sin((self.lat[point] - lat[own]) * half), np.sin((self.lon[point] - lon[own]) * half)
        return north * north + cos[own] * self.cos[point] * east * east


def counts(d: float, radii: list[float], names: dict[str, int], weighed: dict[str, str], schema: pa.Schema):
    """Kernel of the radius counts.  ``names``: the counts and which radius
    each has; ``weighed``: the 0/1 columns of counts with a condition.

    Rows (_plat, _plon, _k, _rlat, _rlon, names): what a probe has for sure,
    with _k null, and the pairs (probe, point) that Spark has to decide, with
    the radius in _k."""
    def run(batches):
        for probes, points in chunks(batches):
            if probes.num_rows and points.num_rows:
                yield from _counted(probes, points, d, radii, names, weighed, schema)
    return run


def _counted(probes, points, d, radii, names, weighed, schema):
    s = Stripes(points, d)
    rows, at = s.among(probes)
    lat, lon = _column(probes, "_lat")[rows], _column(probes, "_lon")[rows]
    cos, none = np.cos(np.radians(lat)), np.zeros(len(rows), dtype=bool)
    total = {n: np.zeros(len(rows), dtype=np.int64) for n in names}
    weight = {n: _column(points, c)[s.order].astype(np.int64) for n, c in weighed.items()}
    sums = {n: np.concatenate([[0], np.cumsum(w)]) for n, w in weight.items()}
    for k, r in enumerate(radii):
        own_names = [n for n, i in names.items() if i == k]
        rho = np.full(len(rows), np.degrees(r / EARTH_RADIUS_KM))
        limit = np.sin(min(r / (2 * EARTH_RADIUS_KM), np.pi / 2)) ** 2
        for here, own, out0, out1, in0, in1 in s.runs(at, lat, lon, rho, none):
            n = here.stop - here.start
            pair = ranges(np.concatenate([out0, in1]), np.concatenate([in0 - out0, out1 - in1]))
            of = np.repeat(np.concatenate([own, own]), np.concatenate([in0 - out0, out1 - in1]))
            a = s.apart(lat[here], lon[here], cos[here], of, pair)
            inside = a < limit * (1 - 1e-9) - 1e-24
            open_ = np.nonzero(~inside & (a <= limit * (1 + 1e-9) + 1e-24))[0]
            of_in, in_ = of[inside], pair[inside]
            for name in own_names:
                if name in weight:
                    total[name][here] += np.bincount(own, sums[name][in1] - sums[name][in0], n).astype(np.int64)
                    total[name][here] += np.bincount(of_in, weight[name][in_], n).astype(np.int64)
                else:
                    total[name][here] += np.bincount(own, in1 - in0, n).astype(np.int64) + np.bincount(of_in, minlength=n)
            if len(open_):
                p, q = of[open_] + here.start, pair[open_]
                put = [lat[p], lon[p], np.full(len(p), k, dtype=np.int32), s.lat[q], s.lon[q]]
                put += [(weight[m][q] if m in weight else np.ones(len(p), dtype=np.int64)) if m in own_names else np.zeros(len(p), dtype=np.int64) for m in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(put, schema)], schema=schema)
    some = np.nonzero(sum(total.values()))[0]
    put = [lat[some], lon[some], pa.nulls(len(some), pa.int32()), *[pa.nulls(len(some), pa.float64())] * 2, *[total[n][some] for n in names]]
    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(put, schema)], schema=schema)


def nearest(d: float, bound: str | None = None):
    """Kernel of the nearest join: rows (_plat, _plon, _rlat, _rlon, _p), per
    probe the points of its tile that are nearest, within the kilometres in
    ``bound`` if given."""
    def run(batches):
        for probes, points in chunks(batches):
            if probes.num_rows and points.num_rows:
                yield from _nearest(probes, points, d, bound)
    return run


def _nearest(probes, points, d, bound):
    s = Stripes(points, d)
    rows, at = s.among(probes)
    lat, lon = _column(probes, "_lat")[rows], _column(probes, "_lon")[rows]
    cos = np.cos(np.radians(lat))
    most = np.full(len(rows), np.inf) if bound is None else np.degrees(_column(probes, bound)[rows] / EARTH_RADIUS_KM) + 1e-9
    rho = np.minimum(d * np.sqrt(2 / s.n[at]), most)
    todo = np.arange(len(rows))
    while len(todo):
        whole = (rho[todo] >= 2 * d) & np.isinf(most[todo])
        la, lo, co, r = lat[todo], lon[todo], cos[todo], rho[todo]
        limit = np.sin(np.radians(np.minimum(r, 180)) / 2) ** 2
        missed = np.ones(len(todo), dtype=bool)
        for here, own, out0, out1, _, _ in s.runs(at[todo], la, lo, r, whole):
            pair, of = ranges(out0, out1 - out0), np.repeat(own, out1 - out0)
            if not len(of):
                continue
            a = s.apart(la[here], lo[here], co[here], of, pair)
            first = np.nonzero(np.diff(of, prepend=-1))[0]
            best = np.full(here.stop - here.start, np.inf)
            best[of[first]] = np.minimum.reduceat(a, first)
            found = (best <= limit[here] * (1 + 1e-9) + 1e-24) | (whole[here] & np.isfinite(best))
            missed[here] = ~found
            keep = np.nonzero(found[of] & (a <= best[of] * (1 + 1e-9) + 1e-24))[0]
            p, q = todo[of[keep] + here.start], pair[keep]
            yield pa.RecordBatch.from_arrays([pa.array(lat[p]), pa.array(lon[p]), pa.array(s.lat[q]), pa.array(s.lon[q]),
                                              points["_p"].combine_chunks().take(pa.array(s.order[q]))], ["_plat", "_plon", "_rlat", "_rlon", "_p"])
        missed &= ~whole & (r < most[todo])
        todo = todo[missed]
        rho[todo] = np.minimum(rho[todo] * 2.5, most[todo])
