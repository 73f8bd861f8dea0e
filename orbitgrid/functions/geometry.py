"""Column functions of poses, boxes, angles, histograms and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quat_camera_center(q: Column, t: Column) -> Column:
    """Camera centre -R^T t of a world-to-camera quaternion (w, x, y, z); a norm below 1e-12 counts as identity."""
    norm = F.sqrt(sum((q[i] * q[i] for i in range(1, 4)), q[0] * q[0]))
    w, x, y, z = (F.when(norm < 1e-12, 1.0 if i == 0 else 0.0).otherwise(q[i] / norm) for i in range(4))
    rows = (
        (1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)),
        (2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)),
        (2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)),
    )
    center = [-(rows[0][i] * t[0] + rows[1][i] * t[1] + rows[2][i] * t[2]) for i in range(3)]
    return F.struct(*(c.alias(n) for c, n in zip(center, "xyz", strict=True)))


def spherical_angles(x: Column, y: Column, z: Column) -> Column:
    """Radius, azimuth atan2(y, x) and elevation in degrees; a radius below 1e-12 gives zeros."""
    r = F.sqrt(x * x + y * y + z * z)
    up = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / r))
    none = r < 1e-12
    return F.struct(
        F.when(none, 0.0).otherwise(r).alias("r"), F.when(none, 0.0).otherwise(F.degrees(F.atan2(y, x))).alias("az"), F.when(none, 0.0).otherwise(F.degrees(F.asin(up))).alias("el")
    )


def yaw_pitch(x: Column, y: Column, z: Column) -> Column:
    """Yaw in [0, 360) and pitch by atan2; null at the origin."""
    flat = F.sqrt(x * x + y * y)
    here = (flat < 1e-9) & (F.abs(z) < 1e-9)
    return F.when(~here, F.struct(F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)).alias("yaw"), F.degrees(F.atan2(z, flat)).alias("pitch")))


def angle_bins(az: Column, el: Column, sectors: int = 8, low: float = -15.0, high: float = 30.0) -> Column:
    """Sector of the azimuth and elevation band 0, 1 or 2 (half-open limits, extremes in the outer bands)."""
    sector = F.pmod(F.floor(F.pmod(az, F.lit(360.0)) / (360.0 / sectors)), F.lit(sectors)).cast("long")
    band = F.when(el < low, 0).when(el < high, 1).otherwise(2).cast("long")
    return F.struct(band.alias("band"), sector.alias("sector"))


def circular_distance(a: Column, b: Column, quality: Column | None = None) -> Column:
    """|a - b| in degrees folded at 180, divided by quality where one is given (0.01 at least)."""
    d = F.abs(a - b)
    d = F.when(d > 180, 360 - d).otherwise(d)
    return d if quality is None else d / F.greatest(quality, F.lit(0.01))


def bbox_iou(a: Column, b: Column) -> Column:
    """Intersection over union of structs (x, y, w, h); an absent or empty union gives 0."""
    def span(p: str, q: str) -> Column:
        return F.greatest(F.lit(0), F.least(a[p] + a[q], b[p] + b[q]) - F.greatest(a[p], b[p]))

    inter = span("x", "w") * span("y", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.coalesce(F.when(union > 0, inter / union), F.lit(0.0))


def hist_correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two histograms of equal length; 1 if neither varies, 0 if only one does not."""
    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    n = F.size(a)
    ma, mb = total(a) / n, total(b) / n
    cov = total(F.zip_with(a, b, lambda x, y: x * y)) - n * ma * mb
    va = total(F.transform(a, lambda x: x * x)) - n * ma * ma
    vb = total(F.transform(b, lambda x: x * x)) - n * mb * mb
    flat = F.when((va < 1e-12) & (vb < 1e-12), 1.0).otherwise(0.0)
    return F.when((va < 1e-12) | (vb < 1e-12), flat).otherwise(cov / F.sqrt(va * vb))


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """8-bit hue (0-179), saturation and value, rounded half up, and Rec. 709 luminance."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    hue = F.when(d == 0, 0.0).when(top == r, 60.0 * (g - b) / d).when(top == g, 120 + 60.0 * (b - r) / d).otherwise(240 + 60.0 * (r - g) / d)
    half = F.floor(F.when(hue < 0, hue + 360).otherwise(hue) / 2 + 0.5)
    return F.struct(
        F.when(half >= 180, half - 180).otherwise(half).cast("long").alias("h"),
        F.when(top == 0, 0).otherwise(F.floor(255.0 * d / top + 0.5)).cast("long").alias("s"),
        top.cast("long").alias("v"),
        (0.2126 * r + 0.7152 * g + 0.0722 * b).alias("lum"),
    )


def color_class(value: Column, saturation: Column) -> Column:
    return (
        F.when((value < 60) & (saturation < 60), "black").when((value < 120) & (saturation < 90), "dark")
        .when((value > 205) & (saturation < 55), "white_cream").when(saturation > 105, "vibrant").otherwise("mid")
    )


def camera_model_class(focal_mm: Column, sensor_mm: float = 36.0) -> Column:
    """Camera model by horizontal field of view: below 75, below 95 degrees, beyond; no positive focal length is RADIAL."""
    hfov = F.degrees(2 * F.atan(F.lit(sensor_mm) / (2 * focal_mm)))
    known = F.coalesce(focal_mm > 0, F.lit(False))
    return F.when(~known | (hfov < 75), "RADIAL").when(hfov < 95, "OPENCV").otherwise("OPENCV_FISHEYE")
