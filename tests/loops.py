"""Plain sequential versions of the operators, for comparison; a series is a list of (t, v)."""

from __future__ import annotations

import math


def is_finite(x):
    return x is not None and math.isfinite(x)


def envelope(points, stride):
    out = []
    for at in range(0, len(points), stride):
        part = points[at : at + stride]
        t, first = part[0]
        if math.isnan(first):
            out.append((t, first))
            continue
        real = [v for _, v in part if not math.isnan(v)]
        out.append((t, min(real)))
        if max(real) > min(real):
            out.append((t, max(real)))
    return out


def derivative(points):
    return [((t0 + t1) / 2, (v1 - v0) / (t1 - t0)) for (t0, v0), (t1, v1) in zip(points, points[1:]) if abs(t1 - t0) > 2.220446049250313e-16]


def integral(points):
    out, total = [], 0.0
    for i, (t, v) in enumerate(points):
        if i:
            total += (v + points[i - 1][1]) / 2 * (t - points[i - 1][0])
        out.append((t, total))
    return out


def meet(p, q, level):
    if abs(q[1] - p[1]) < 2.220446049250313e-16:
        return p[0]
    return p[0] + (level - p[1]) / (q[1] - p[1]) * (q[0] - p[0])


def pulse(points, reference=False):
    """(period, frequency, duty, pos_width, neg_width, rise, fall) or None."""
    values = [v for _, v in points if not math.isnan(v)]
    if len(points) < 4 or not values or max(values) - min(values) < 2.220446049250313e-16:
        return None
    low, high = min(values), max(values)
    mid = (low + high) / 2
    pairs = list(zip(points, points[1:]))
    ups = [q[0] for p, q in pairs if p[1] <= mid < q[1]]
    period = (ups[-1] - ups[0]) / (len(ups) - 1) if len(ups) >= 2 and ups[-1] > ups[0] else None
    duty = None
    if period and points[-1][0] > points[0][0]:
        duty = sum(q[0] - p[0] for p, q in pairs if q[1] > mid) / (points[-1][0] - points[0][0]) * 100

    def edge(a, b, passes):
        for i, (p, q) in enumerate(pairs):
            if passes(p[1], q[1], a):
                for p2, q2 in pairs[i + 1 if reference else i :]:
                    if passes(p2[1], q2[1], b):
                        dt = meet(p2, q2, b) - meet(p, q, a)
                        return dt if dt > 0 else None
                return None
        return None

    ten, ninety = low + 0.1 * (high - low), low + 0.9 * (high - low)
    rise, fall = edge(ten, ninety, lambda x, y, m: x < m <= y), edge(ninety, ten, lambda x, y, m: x > m >= y)
    return (period, 1 / period if period else None, duty, duty and duty / 100 * period, None if duty is None else (100 - duty) / 100 * period, rise, fall)


def binarised(points, level):
    if len(points) < 2:
        return []
    out = [(points[0][0], float(points[0][1] > level))]
    for p, q in zip(points, points[1:]):
        a, b = p[1] > level, q[1] > level
        if a != b and abs(q[1] - p[1]) > 2.220446049250313e-16:
            t = p[0] + (level - p[1]) / (q[1] - p[1]) * (q[0] - p[0])
            out += [(t, float(a)), (t, float(b))]
        out.append((q[0], float(b)))
    return out


def quartiles(points):
    v = sorted(v for _, v in points if is_finite(v))
    return v[len(v) // 4], v[3 * len(v) // 4]


def thresholds(points):
    a, b = quartiles(points)
    return (a + b) / 2 - (b - a) * 0.10, (a + b) / 2 + (b - a) * 0.10


def schmitt(points, polarity, lo, hi):
    """Indices at which a trigger with hysteresis fires."""
    out, on = [], False
    for i in range(1, len(points)):
        before, now = points[i - 1][1], points[i][1]
        if polarity == "both":
            fire = now < lo if on else now > hi
            on ^= fire
        elif polarity == "rising":
            fire = not on and before <= hi < now
            on = fire or (on and not now < lo)
        else:
            fire = not on and before >= lo > now
            on = fire or (on and not now > hi)
        if fire:
            out.append(i)
    return out


def symbol_period(times):
    gaps = sorted(b - a for a, b in zip(times, times[1:]) if b - a > 0)
    if len(times) < 3 or not gaps:
        return None
    n = next((i for i in range(1, len(gaps)) if gaps[i] / max(gaps[i - 1], 1e-30) > 1.5), len(gaps))
    a, b = n // 10, n * 9 // 10
    return sum(gaps[a : b + 1]) / (b - a + 1) if b > a else gaps[n // 2]


def clock(points, polarity):
    a, b = quartiles(points)
    m = (a + b) / 2
    up, down = (lambda x, y: x <= m < y), (lambda x, y: x >= m > y)
    hit = {"rising": up, "falling": down, "both": lambda x, y: up(x, y) or down(x, y)}[polarity]
    return [p[0] + (m - p[1]) / (q[1] - p[1]) * (q[0] - p[0]) for p, q in zip(points, points[1:]) if hit(p[1], q[1])]


def nearest(times, points):
    out = []
    for e in times:
        i = next((i for i, (t, _) in enumerate(points) if t >= e), len(points) - 1)
        out.append(i - 1 if i and abs(points[i][0] - e) > abs(points[i - 1][0] - e) else i)
    return out


def fixed(points, ui):
    out, k = [], 0
    while True:
        i = next((i for i, (t, _) in enumerate(points) if t >= points[0][0] + k * ui), None)
        if i is None:
            return out
        out.append(i)
        k += 1


def eye_grid(points, starts, width, y_lo, y_hi, gx, gy):
    cells = {}
    for s in starts:
        line = [((t - points[s][0]) / width * gx, (v - y_lo) / (y_hi - y_lo) * gy) for t, v in points[s:] if t < points[s][0] + width]
        for (x0, y0), (x1, y1) in zip(line, line[1:]):
            n = max(math.ceil(max(abs(x1 - x0), abs(y1 - y0))), 1)
            for i in range(n + 1):
                x, y = x0 + i / n * (x1 - x0), y0 + i / n * (y1 - y0)
                a, b = math.floor(x), math.floor(y)
                for dx in (0, 1):
                    for dy in (0, 1):
                        w = (x - a if dx else 1 - (x - a)) * (y - b if dy else 1 - (y - b))
                        if 0 <= a + dx < gx and 0 <= b + dy < gy and w > 0:
                            cells[a + dx, b + dy] = cells.get((a + dx, b + dy), 0) + w
    return cells


def density(points, x, y, width, height):
    def pixel(v):
        p = (v - y[0]) / (y[1] - y[0]) * height
        return 0 if math.isnan(p) else int(max(min(p, 2**31 - 1), -(2**31)))

    cells = {}
    for px in range(width):
        a, b = x[0] + px / width * (x[1] - x[0]), x[0] + (px + 1) / width * (x[1] - x[0])
        for i in range(len(points) - 1):
            if a <= points[i][0] <= b:
                p, q = sorted((pixel(points[i][1]), pixel(points[i + 1][1])))
                for py in range(min(max(p, 0), height - 1), min(max(q, 0), height - 1) + 1):
                    cells[px, py] = cells.get((px, py), 0) + 1
    return cells
