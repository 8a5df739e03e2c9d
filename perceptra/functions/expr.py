"""Column expressions: quantisation, rotation, angles, bins, kernels. Ids in brackets name the blueprint's operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quantise(v: Column | str, res: float) -> Column:
    """Cell of a coordinate, ties away from zero."""
    return F.round(col(v) / res).cast("int")


def to_pose(x, y, px, py, theta) -> tuple[Column, Column]:
    """A point moved by minus the pose and turned by plus theta."""
    dx, dy, c, s = col(x) - col(px), col(y) - col(py), F.cos(col(theta)), F.sin(col(theta))
    return c * dx - s * dy, s * dx + c * dy


def probability(log_odds: Column | str) -> Column:
    """(X3)"""
    return 1 / (1 + F.exp(-col(log_odds)))


def safe_log(p: Column) -> Column:
    """Natural logarithm with minus infinity at zero, where Spark's gives null."""
    return F.when(p == 0, F.lit(float("-inf"))).otherwise(F.ln(p))


def polar(x, y, z=None) -> dict[str, Column]:
    """Range, range in the plane, bearing and elevation of a point."""
    x, y = col(x), col(y)
    flat = F.sqrt(x * x + y * y)
    out = {"range": flat if z is None else F.sqrt(x * x + y * y + col(z) * col(z)), "range_xy": flat, "theta": F.atan2(y, x)}
    return out if z is None else out | {"phi": F.atan2(col(z), flat)}


def wrap_angle(a: Column | str) -> Column:
    """The angle in [-pi, pi]; both ends stay (X11)."""
    a = col(a)
    return F.when((a >= -PI) & (a <= PI), a).otherwise(a - 2 * PI * F.ceil((a - PI) / (2 * PI)))


def positive_angle(a: Column | str) -> Column:
    """The angle in [0, 2 pi)."""
    a = col(a)
    return a - 2 * PI * F.floor(a / (2 * PI))


def unit_normal(theta, phi) -> tuple[Column, Column, Column]:
    """(X9)"""
    t, p = col(theta), col(phi)
    return F.cos(p) * F.cos(t), F.cos(p) * F.sin(t), F.sin(p)


def angular_bin(theta, phi, res: float = 0.2) -> Column:
    """Bin of a direction, opposite directions alike; steep ones share the last bin."""
    n_phi, n_theta = math.floor(2 * PI / res) - 1, math.ceil(2 * PI / res)
    t0, p0 = col(theta), col(phi)
    t = positive_angle(F.when(p0 < 0, t0 + PI).otherwise(t0))
    n_t, n_p = F.floor(t / res), F.floor(F.abs(p0) / res)
    return F.when(n_p >= n_phi, F.lit(n_phi * n_theta)).otherwise(n_t * n_phi + n_p).cast("int")


def angular_bin_direction(b: Column | str, res: float = 0.2) -> tuple[Column, Column]:
    """(theta, phi) at the middle of a bin; the shared one is vertical."""
    n_phi, n_theta = math.floor(2 * PI / res) - 1, math.ceil(2 * PI / res)
    b = col(b)
    steep = b == n_phi * n_theta
    return F.when(steep, 0.0).otherwise((F.floor(b / n_phi) + 0.5) * res), F.when(steep, PI / 2).otherwise((b % n_phi + 0.5) * res)


def bin_index(v, lo: float, hi: float, res: float) -> Column:
    """Histogram bin: 0 below, the last above, else one more than the step."""
    v = col(v)
    return F.when(v <= lo, 0).when(v >= hi, math.ceil((hi - lo) / res) + 2).otherwise(F.floor((v - lo) / res) + 1).cast("int")


def bin_value(b, lo: float, res: float) -> Column:
    """Lower edge of a bin."""
    return (col(b) - 1) * res + lo


def lattice_index(v, lo: float, hi: float, res: float) -> Column:
    """Lattice cell of a coordinate, null outside."""
    v = col(v)
    return F.when((v >= lo) & (v < hi), F.floor((v - lo) / res)).cast("int")


def lattice_centre(i, lo: float, res: float) -> Column:
    """(X15)"""
    return col(i) * res + res / 2 + lo


def object_frame(theta, range_, x, y, heading, sin=None, cos=None) -> dict[str, Column]:
    """A ray seen from an object: its direction, distances of its line and of its end."""
    theta, r, x, y = col(theta), col(range_), col(x), col(y)
    s, c = sin if sin is not None else F.sin(theta), cos if cos is not None else F.cos(theta)
    dist_obs = r - c * x - s * y
    return {"m_phi": positive_angle(theta - col(heading)), "dist_ray": s * x - c * y, "dist_obs": dist_obs, "in_front": dist_obs < r}


def project(point: list, matrix: list[list[float]]) -> tuple[Column, Column, Column]:
    """(u, v, depth) of a point under a 3 x 4 camera matrix."""
    h = [*map(col, point), F.lit(1.0)]
    u, v, w = (sum((c * k for c, k in zip(h[1:], row[1:], strict=True)), h[0] * row[0]) for row in matrix)
    return u / F.nullif(w, F.lit(0.0)), v / F.nullif(w, F.lit(0.0)), w


def into_object(x, y, z, ox, oy, oz, heading) -> tuple[Column, Column, Column]:
    """A point in the frame of an object turned about the vertical camera axis: the inverse of a rigid motion."""
    dx, dy, dz, c, s = col(x) - col(ox), col(y) - col(oy), col(z) - col(oz), F.cos(col(heading)), F.sin(col(heading))
    return c * dx - s * dz, dy, s * dx + c * dz


def box_extent(x, y, z, heading, matrix: list[list[float]], size: tuple[float, float, float] = (4.0, 1.6, 1.5)) -> dict[str, Column]:
    """Image extent of a box's eight corners; starts at 2000 and 0 as limits."""
    x, y, z, c, s = col(x), col(y), col(z), F.cos(col(heading)), F.sin(col(heading))
    us, vs = [], []
    for a in (-0.5, 0.5):
        for b in (-0.5, 0.5):
            for d in (-0.5, 0.5):
                dx, dy = a * size[0], b * size[1]
                u, v, _ = project([x + c * dx - s * dy, y + s * dx + c * dy, z + d * size[2]], matrix)
                us.append(u)
                vs.append(v)
    low, high = F.lit(2000.0), F.lit(0.0)
    return {"left": F.least(low, *us), "top": F.least(low, *vs), "right": F.greatest(high, *us), "bottom": F.greatest(high, *vs)}


def sparse_kernel(r: Column | str, support: float = 1.0) -> Column:
    """Compact kernel of a distance: one at zero, zero from the support on."""
    q = col(r) / support
    return F.when(q <= 1, (2 + F.cos(2 * PI * q)) / 3 * (1 - q) + F.sin(2 * PI * q) / (2 * PI)).otherwise(0.0)


def box_kernel(dx, dy, half: float) -> Column:
    """(X18)"""
    return F.when((F.abs(col(dx)) <= half) & (F.abs(col(dy)) <= half), 1.0).otherwise(0.0)


def rbf_kernel(d2: Column | str, width: float = 0.25) -> Column:
    """(X18)"""
    return F.exp(-col(d2) / width)


def table_slot(d: Column | str, support: float, n: int = 1024) -> Column:
    """Slot of an offset in a kernel table over plus and minus its support, ties to even."""
    return F.rint((col(d) + support) / (2 * support) * (n - 1)).cast("int")


def distance_field(d: Column | str, largest: Column) -> Column:
    """Logarithm of a distance, infinities replaced by the largest finite one."""
    d = col(d)
    return F.log1p(F.abs(F.when(d == float("inf"), largest).otherwise(d)))


def ramp(v, lo: float, hi: float) -> Column:
    """Clamped linear share, the analytic part of colour maps."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (col(v) - lo) / (hi - lo)))


def heat(v, lo: float, hi: float) -> dict[str, Column]:
    """Blue at lo to red at hi: the colours of heights and of log-odds."""
    r = ramp(v, lo, hi)
    return {"r": r, "g": F.lit(0.0), "b": 1 - r}


def hsv_to_rgb(h, s, v) -> dict[str, Column]:
    """Red, green and blue in 0 to 1 of a hue in degrees, saturation and value (X22): each channel falls from v by how far the hue is from its own."""
    h, s, v = col(h), col(s), col(v)

    def channel(turn: int) -> Column:
        k = F.pmod(h / 60 + turn, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return {"r": channel(5), "g": channel(3), "b": channel(1)}


def rgb_to_hsv(r, g, b) -> dict[str, Column]:
    """Hue in degrees (0 for greys), saturation and value of a colour."""
    r, g, b = col(r), col(g), col(b)
    high = F.greatest(r, g, b)
    span = high - F.least(r, g, b)
    grey = span < 1e-5
    part = F.when(r == high, (g - b) / F.nullif(span, F.lit(0.0))).when(g == high, 2 + (b - r) / F.nullif(span, F.lit(0.0))).otherwise(4 + (r - g) / F.nullif(span, F.lit(0.0)))
    return {"h": F.when(grey, 0.0).otherwise(F.pmod(part * 60, F.lit(360.0))), "s": F.when(grey, 0.0).otherwise(span / F.nullif(high, F.lit(0.0))), "v": high}


def direction_colour(theta, phi) -> dict[str, Column]:
    """Colour of a direction (X22): opposite bearings have one hue, level ones are full and those of 45 degrees or more are grey."""
    t, p = wrap_angle(theta), wrap_angle(phi)
    hue = F.degrees(2 * F.when(t < 0, t + PI).otherwise(t))
    return hsv_to_rgb(hue, 1 - F.least(F.lit(1.0), F.abs(p) / (PI / 4)), F.lit(0.9))


def grams_2d(phi, dist, angle_res: float = 0.1, dist_res: float = 0.1, max_size: float = 5.0) -> tuple[Column, Column]:
    """Keys of a ray in the plane, rounded."""
    clamped = F.greatest(F.lit(-max_size), F.least(F.lit(max_size), col(dist)))
    return F.round(col(phi) / angle_res).cast("int"), F.round(clamped / dist_res).cast("int")


def grams_3d(theta, phi, dist_ray, dist_z, angle_res: float = 0.2, dist_res: float = 0.2) -> list[Column]:
    """Keys of a ray in space, floored."""
    return [F.floor(col(c) / r).cast("int") for c, r in ((theta, angle_res), (phi, angle_res), (dist_ray, dist_res), (dist_z, dist_res))]


def uniform(*keys: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone: 48 bits of the MD5 of their text, so that a task that runs again, or another partitioning, draws the same. Null keys count as ''."""
    text = F.concat_ws("/", *[F.coalesce(col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def least_eigenvalue(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> Column:
    """Smallest eigenvalue of a symmetric 3 x 3 matrix in closed form."""
    q = (xx + yy + zz) / 3
    a, b, c = xx - q, yy - q, zz - q
    p = F.sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(p > 0, det / F.nullif(2 * p * p * p, F.lit(0.0))).otherwise(0.0)))
    return q + 2 * p * F.cos(F.acos(r) / 3 + 2 * PI / 3)


def least_direction(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> Column:
    """Eigenvector of the smallest eigenvalue of a symmetric 3 x 3 matrix, as a struct u, v, w of no certain length, in closed form.

    Of the three cross products of rows of the matrix less the eigenvalue the longest is taken. Where two eigenvalues are equal all three vanish; then any vector across
    the longest row has the eigenvalue, and of a multiple of the unit matrix the first axis is taken. The largest component, the first of equals, is positive.
    """
    def of(low: Column) -> Column:
        rows = [(xx - low, xy, xz), (xy, yy - low, yz), (xz, yz, zz - low)]
        struct = lambda u, v, w: F.struct((u * u + v * v + w * w).alias("size"), u.alias("u"), v.alias("v"), w.alias("w"))
        crossed = [struct(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]) for a, b in ((rows[0], rows[1]), (rows[0], rows[2]), (rows[1], rows[2]))]
        scale = xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz)
        best, row = F.array_max(F.array(*crossed)), F.array_max(F.array(*[struct(*r) for r in rows]))
        across = F.when(F.abs(row["u"]) > F.abs(row["w"]), struct(-row["v"], row["u"], F.lit(0.0))).otherwise(struct(F.lit(0.0), -row["w"], row["v"]))
        along = F.when(row["size"] <= 1e-20 * scale, struct(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(across)
        return F.when(best["size"] > 1e-20 * scale * scale, best).otherwise(along)

    found = F.transform(F.array(least_eigenvalue(xx, xy, xz, yy, yz, zz)), of)

    def signed(d: Column) -> Column:
        lead = F.when((F.abs(d["u"]) >= F.abs(d["v"])) & (F.abs(d["u"]) >= F.abs(d["w"])), d["u"]).when(F.abs(d["v"]) >= F.abs(d["w"]), d["v"]).otherwise(d["w"])
        sign = F.when(lead < 0, -1.0).otherwise(1.0)
        return F.struct((d["u"] * sign).alias("u"), (d["v"] * sign).alias("v"), (d["w"] * sign).alias("w"))

    return F.transform(found, signed)[0]
