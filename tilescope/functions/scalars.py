"""Column expressions; every one stays on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed domain values, overridable by argument.
SPHERE_RADIUS_M = 2_574_700.0
HOLDOUT_LAT, HOLDOUT_LON, HOLDOUT_RADIUS_DEG = 6.0, 161.0, 5.0
METRES_PER_DEGREE = 111_320.0
BLOCK_M = 250_000.0


def as_bigint(c) -> Column:
    return _c(c).cast("bigint")


def round6(c) -> Column:
    """Six decimals, without negative zero, for comparison at query edges."""
    return F.round(_c(c).cast("double"), 6) + F.lit(0.0)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den) -> Column:
    """``num/den`` as double, NULL when the denominator is zero or NULL."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def is_finite(c) -> Column:
    c = _c(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


# ---- intensity -----------------------------------------------------------------

def to_db(c, floor: float = 1e-4) -> Column:
    return 10.0 * F.log10(F.greatest(_c(c).cast("double"), F.lit(floor)))


def from_db(c) -> Column:
    return F.pow(F.lit(10.0), _c(c).cast("double") / 10.0)


def fill_nonfinite(c, fill: float = 0.0) -> Column:
    c = _c(c)
    return F.when(is_finite(c), c).when(c.isNull(), None).otherwise(F.lit(fill))


def scale_clip(c, lo, hi, eps: float = 1e-8) -> Column:
    c, lo, hi = _c(c), _lit(lo), _lit(hi)
    return F.least(F.greatest((c - lo) / (hi - lo + F.lit(eps)), F.lit(0.0)), F.lit(1.0))


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def quantize(c, levels: int) -> Column:
    """Nearest of ``levels`` grey levels over [0, 1]; halves go to the even level."""
    return F.bround(_c(c) * F.lit(float(levels - 1)), 0) / F.lit(float(levels - 1))


# ---- geography -----------------------------------------------------------------

def wrap_lon(c) -> Column:
    return F.pmod(_c(c).cast("double"), F.lit(360.0))


def _unit_haversine(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat = p1 - p2
    dlon = F.radians(_c(lon1) - _c(lon2))
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    return 2.0 * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def haversine(lat1, lon1, lat2, lon2, radius: float = SPHERE_RADIUS_M) -> Column:
    return _unit_haversine(lat1, lon1, lat2, lon2) * F.lit(radius)


def angular_distance_deg(lat1, lon1, lat2, lon2) -> Column:
    return F.degrees(_unit_haversine(lat1, lon1, lat2, lon2))


def deg_resolution(lat, pixel_m: float) -> tuple[Column, Column]:
    """(longitude, latitude) degrees per pixel; polar rows use the latitude step for both."""
    lon_m = F.lit(METRES_PER_DEGREE) * F.cos(F.radians(_c(lat)))
    lon_m = F.when(lon_m < 1000.0, F.lit(METRES_PER_DEGREE)).otherwise(lon_m)
    return F.lit(pixel_m) / lon_m, F.lit(pixel_m / METRES_PER_DEGREE)


def in_holdout(lat, lon, centre_lat=HOLDOUT_LAT, centre_lon=HOLDOUT_LON,
               radius_deg=HOLDOUT_RADIUS_DEG) -> Column:
    return angular_distance_deg(lat, lon, F.lit(centre_lat), F.lit(centre_lon)) <= radius_deg


def sector(lon, n: int) -> Column:
    return F.floor(wrap_lon(lon) / F.lit(360.0 / n)).cast("int")


def sector_role(lat, lon, n: int, fold) -> Column:
    """Holdout first; sector ``fold`` tests, the next one validates, the others train."""
    fold = _c(fold) if isinstance(fold, (str, Column)) else F.lit(fold)
    s = sector(lon, n)
    return (F.when(in_holdout(lat, lon), "holdout")
            .when(s == fold, "test")
            .when(s == F.pmod(fold + 1, F.lit(n)), "val")
            .otherwise("train"))


def assign_split(lat, lon) -> Column:
    """Hemispheric roles: holdout disc, west trains, low east validates, the rest tests."""
    east = wrap_lon(lon)
    return (F.when(in_holdout(lat, lon), "holdout")
            .when(east >= 180.0, "train")
            .when(F.abs(_c(lat)) <= 30.0, "val")
            .otherwise("test"))


def spatial_block(lat, lon, radius: float = SPHERE_RADIUS_M, block_m: float = BLOCK_M) -> Column:
    """``band:blocks:index`` of a near equal-area block; block counts round half to even."""
    half_pi = F.lit(1.5707963267948966)
    band = F.floor((F.radians(_c(lat)) + half_pi) * radius / block_m)
    centre = -half_pi + (band + 0.5) * block_m / radius
    blocks = F.greatest(F.lit(1.0), F.bround(
        F.lit(6.283185307179586 * radius) * F.greatest(F.cos(centre), F.lit(1e-6)) / block_m, 0))
    index = F.floor(wrap_lon(lon) / 360.0 * blocks)
    return F.concat_ws(":", band.cast("bigint"), blocks.cast("bigint"), index.cast("bigint"))


def rayleigh_mm(wavelength_cm, angle_deg) -> Column:
    return _lit(wavelength_cm) / (8.0 * F.cos(F.radians(_lit(angle_deg)))) * 10.0


# ---- vectors -------------------------------------------------------------------

def as_doubles(c) -> Column:
    return F.transform(_c(c), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def norm(c) -> Column:
    return F.sqrt(F.aggregate(_c(c), F.lit(0.0),
                              lambda s, x: s + x.cast("double") * x.cast("double")))


def bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and use it many times inside ``fn``; lambdas do not hoist what they repeat."""
    return F.transform(F.array(value), fn)[0]


def l2norm(c, eps: float = 1e-8) -> Column:
    return bind(_c(c), lambda v: bind(norm(v), lambda n: F.transform(
        v, lambda x: x.cast("double") / (n + F.lit(eps)))))


def argmax(c) -> Column:
    """0-based position of the first maximum."""
    return bind(_c(c), lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def entropy(c) -> Column:
    def term(p):
        q = F.least(F.greatest(p.cast("double"), F.lit(1e-10)), F.lit(1.0))
        return q * F.log(q)
    return -F.aggregate(F.transform(_c(c), term), F.lit(0.0), lambda s, x: s + x)


def softmax(c) -> Column:
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    shifted = lambda v: bind(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return bind(_c(c), lambda v: bind(shifted(v), lambda e: bind(
        total(e), lambda t: F.transform(e, lambda x: x / t))))


def linear_logits(f, coef, intercept) -> Column:
    """One logit per row of ``coef``; coefficients arrive as array columns (one-row sized)."""
    return F.zip_with(_c(coef), _c(intercept), lambda w, b: dot(f, w) + b)


def float32_exact(c) -> Column:
    return F.forall(_c(c), lambda x: x.cast("float").cast("double") == x.cast("double"))


# ---- hashing -------------------------------------------------------------------

def seeded_hash(seed, *ids) -> Column:
    """md5 of ``seed:id[:id...]``; its text order is a seeded random order."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", seed, *[_c(i).cast("string") for i in ids]))


def hash_unit(h) -> Column:
    """Uniform value in [0, 1) from the first eight hex digits."""
    return F.conv(F.substring(_c(h), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
