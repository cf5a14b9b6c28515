"""Quality, identity and golden-compare checks.

Every check returns a DataFrame of offenders and stays lazy; ``assert_empty`` is the only action.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilescope.functions.scalars import float32_exact, is_finite
from tilescope.operators.ordering import running_totals, with_previous


class CheckFailed(ValueError):
    """A check found offending rows."""


def assert_empty(offenders: DataFrame, message: str) -> None:
    found = offenders.limit(3).collect()
    if found:
        raise CheckFailed(f"{message}: {[r.asDict() for r in found]}")


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_labels(df: DataFrame, k: int, allow_unlabeled: bool = False, label: str = "label") -> DataFrame:
    """Rows whose label is not a whole number in [0, k) (or -1 when unlabeled rows are allowed).

    Text labels are matched before any cast, so ``true``, ``1.5`` and quoted numbers stay errors.
    """
    text = F.col(label).cast("string")
    value = F.when(text.rlike(r"^-?[0-9]{1,9}$"), F.expr(f"try_cast({label} as int)"))
    ok = value.between(0, k - 1)
    if allow_unlabeled:
        ok = ok | (value == -1)
    return df.where(~F.coalesce(ok, F.lit(False)))


def check_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys present on one side only: ``side`` says where the key exists."""
    l, r = left.select(key).distinct(), right.select(key).distinct()  # repeats collapse before the join
    both = l.withColumn("_l", F.lit(True)).join(r.withColumn("_r", F.lit(True)), key, "full_outer")
    side = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right")
    return both.select(key, side.alias("side")).where("side is not null")


def check_grid(df: DataFrame, dims: dict[str, list]) -> DataFrame:
    """Design cells that do not have exactly one row: missing (0), repeated, or outside the design."""
    names = list(dims)
    grid = df.sparkSession.range(1).select(F.lit(1).alias("_expected"))
    for name in names:
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in dims[name]])))
    have = df.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    return (have.join(grid, names, "full_outer")
            .select(*names, F.coalesce("n", F.lit(0)).alias("n"),
                    F.col("_expected").isNotNull().alias("expected"))
            .where((F.col("n") != 1) | ~F.col("expected")))


def check_constant(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Keys where a column takes more than one value, counting NULL as a value.

    Minimum against maximum: both combine map-side, unlike a distinct count.
    """
    varies = [F.coalesce(F.min(c) != F.max(c), F.lit(False)) |
              ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))) for c in cols]
    out = df.groupBy(*keys).agg(*[v.alias(f"{c}_varies") for c, v in zip(cols, varies)])
    return out.where(reduce(lambda a, b: a | b, [F.col(f"{c}_varies") for c in cols]))


def check_disjoint(splits: DataFrame, role: str = "test", item: str = "tile_id", fold: str = "fold") -> DataFrame:
    """Items holding ``role`` in more than one fold."""
    pairs = splits.where(F.col("role") == role).select(item, fold).distinct()
    return pairs.groupBy(item).agg(F.count(F.lit(1)).alias("folds")).where("folds > 1")


def check_support(df: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``expected`` (keys, n) whose actual count differs or is zero, and undeclared groups."""
    have = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual"))
    both = expected.withColumnRenamed("n", "declared").join(have, keys, "full_outer")
    both = both.fillna(0, ["declared", "actual"])
    return both.where((F.col("actual") != F.col("declared")) | (F.col("actual") == 0))


def gate_catalog(headers: DataFrame, key: str, required: dict[str, Column]) -> DataFrame:
    """(key, reason) per failed rule; a NULL rule outcome fails too."""
    reasons = F.filter(F.array(*[
        F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(name)) for name, ok in required.items()]),
        lambda r: r.isNotNull())
    return headers.select(key, F.explode(reasons).alias("reason"))


def require_gate(headers: DataFrame, key: str, required: dict[str, Column]) -> DataFrame:
    """Pass headers through, raising inside the job at the first failed rule."""
    ok = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in required.values()])
    return headers.where(F.when(ok, True).otherwise(
        F.raise_error(F.concat(F.lit("catalog refused: "), F.col(key).cast("string"))).cast("boolean")))


def check_hashes(actual: DataFrame, expected: DataFrame, name: str = "path") -> DataFrame:
    """Files missing, unexpected, or with another size or digest."""
    a = actual.select(name, F.struct(F.col("bytes").cast("bigint").alias("bytes"), "sha256").alias("a"))
    e = expected.select(name, F.struct(F.col("bytes").cast("bigint").alias("bytes"), "sha256").alias("e"))
    return (a.join(e, name, "full_outer")
            .withColumn("status", F.when(F.col("a").isNull(), "missing")
                        .when(F.col("e").isNull(), "unexpected")
                        .when(F.col("a.bytes") != F.col("e.bytes"), "size")
                        .when(F.col("a.sha256") != F.col("e.sha256"), "digest"))
            .where("status is not null").select(name, "status"))


def digest_ids(df: DataFrame, keys: list[str], item: str, chunk: int = 10_000, rounds: int = 3) -> DataFrame:
    """SHA-256 tree over the IDs per key, in ascending numeric order: (keys, n, digest).

    First each run of ``chunk`` consecutive IDs gives the digest of its compact JSON list; then, in every
    further round, each run of ``chunk`` digests gives the digest of their list. All ``rounds`` are taken
    for every key, whatever its size, so the digest has one definition; lists hold ``chunk`` entries at
    most as long as a key has at most chunk ** rounds IDs.
    """
    ranked = running_totals(df.select(*keys, item).withColumn("_one", F.lit(1)), keys, item, ["_one"])
    part = ranked.select(*keys, (F.col("cum__one") - 1).cast("bigint").alias("_at"), F.col(item).alias("_d"), F.lit(1).cast("bigint").alias("n"))
    for last in [False] * (rounds - 1) + [True]:
        run = F.lit(0).cast("bigint") if last else F.floor(F.col("_at") / chunk).cast("bigint")
        part = (part.groupBy(*keys, run.alias("_run")).agg(
            F.sum("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_at", "_d"))), lambda s: s["_d"]).alias("_ds"))
            .select(*keys, F.col("_run").alias("_at"), F.sha2(F.to_json("_ds"), 256).alias("_d"), "n"))
    return part.select(*keys, "n", F.col("_d").alias("digest"))


def check_probs(df: DataFrame, keys: list[str], prob: str = "prob", pred: str = "pred",
                atol: float = 1e-6) -> DataFrame:
    """Per key: invalid rows, rows whose maximum is tied, and predictions that are not a maximum."""
    p = F.col(prob)
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    valid = F.forall(p, lambda x: is_finite(x) & (x >= 0.0) & (x <= 1.0)) & (F.abs(total - 1.0) <= atol)
    top = F.array_max(p)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("invalid"),
        F.count_if(F.size(F.filter(p, lambda x: x == top)) > 1).alias("tied"),
        F.count_if(F.coalesce(F.try_element_at(p, F.col(pred).cast("int") + 1) != top, F.lit(True)))
        .alias("not_maximum"))


def check_float32(df: DataFrame, col: str) -> DataFrame:
    """Rows whose array holds a value that does not survive a float32 round trip."""
    return df.where(~float32_exact(col))


def compare_tables(actual: DataFrame, expected: DataFrame, keys: list[str],
                   atol: dict[str, float] | None = None) -> DataFrame:
    """Differences as rows (keys, field, status): exact for most types, tolerant where ``atol`` says.

    One full outer join; only differing cells are emitted.
    """
    atol = atol or {}
    fields = [c for c in expected.columns if c not in keys]
    a = actual.select(*keys, F.struct(*fields).alias("_a"))
    e = expected.select(*keys, F.struct(*fields).alias("_e"))
    j = a.join(e, keys, "full_outer")

    def state(c):
        x, y = F.col(f"_a.{c}"), F.col(f"_e.{c}")
        same = x.eqNullSafe(y)
        if c in atol:
            same = same | F.coalesce(F.abs(x - y) <= atol[c], F.lit(False))
        return F.when(~same, F.struct(F.lit(c).alias("field"), F.lit("value").alias("status")))

    whole = lambda s: F.array(F.struct(F.lit("*").alias("field"), F.lit(s).alias("status")))
    cells = (F.when(F.col("_a").isNull(), whole("missing")).when(F.col("_e").isNull(), whole("extra"))
             .otherwise(F.filter(F.array(*[state(c) for c in fields]), lambda s: s.isNotNull())))
    return j.select(*keys, F.inline(cells))


def check_monotone(df: DataFrame, key: list[str], base: str, masked: str, known: str) -> DataFrame:
    """Tiles whose masked class counts exceed the baseline or whose known total is not the class sum."""
    above = F.exists(F.zip_with(masked, base, lambda m, b: m > b), lambda x: x)
    total = F.aggregate(base, F.lit(0).cast("bigint"), lambda s, x: s + x.cast("bigint"))
    return df.select(*key, above.alias("masked_above"), (total != F.col(known)).alias("total_differs")).where(
        F.col("masked_above") | F.col("total_differs"))


#: Characters that end a token in operational text: white space, quotes, brackets and list separators.
TOKEN_ENDS = "[ \\t\\n\\r\\f\"'`()\\[\\]{}<>,;=|]+"

#: Marks that continue a name like a letter or digit does, so that a slash behind one belongs to it.
NAME_MARKS = "_./~%+-"
_NAME_CHAR = f"[\\p{{L}}\\p{{N}}{NAME_MARKS}]"


def _any_joint(pieces: Column, found) -> Column:
    """True if ``found(before, after, i, last)`` holds for pieces i - 1 and i of a text taken apart at a mark."""
    last = F.size(pieces) - 1
    return (last > 0) & F.exists(F.sequence(F.lit(0), last), lambda i: (i > 0) & found(F.get(pieces, i - 1), F.get(pieces, i), i, last))


def _end(s: Column, back: int = 1) -> Column:
    """The last character, or the one ``back`` places from the end; empty if there is none."""
    return F.when(F.length(s) >= back, F.substring(s, -back, 1)).otherwise("")


def _without_addresses(pieces: Column) -> Column:
    """The text taken apart at ``://``, with a space for each address: its scheme and what follows up to white space, a quote or an angle bracket."""
    def bare(piece, i):
        rest = F.when(i == 0, piece).otherwise(F.coalesce(F.get(F.split(piece, "[\\s\"'`<>]", 2), F.lit(1)), F.lit("")))
        return F.when(i == F.size(pieces) - 1, rest).otherwise(F.regexp_replace(rest, "[A-Za-z0-9+.-]+$", ""))
    return F.array_join(F.transform(pieces, bare), " ")


def _starts_path(before: Column, after: Column, i: Column, last: Column) -> Column:
    """A slash is a path's first if no name ends before it and no white space follows, unless it divides two numbers.

    It divides them if the last word before is a number, and not itself what another slash divides by, and so is the first word after.
    """
    free = F.when(before == "", i == 1).otherwise(~_end(before).rlike(_NAME_CHAR))
    goes_on = F.when(after == "", i < last).otherwise(~F.substring(after, 1, 1).rlike("\\s"))
    words = F.split(F.rtrim(before), "\\s+")
    divided = F.try_element_at(words, F.lit(-1)).try_cast("double").isNotNull() & ((i == 1) | (F.size(words) > 1))
    divisor = F.get(F.split(after, "[\\s,;)\\]}]", 2), F.lit(0)).try_cast("double").isNotNull()
    return free & goes_on & ~(divided & divisor)


def find_private(df: DataFrame, key: list[str], cols: list[str] | None = None) -> DataFrame:
    """(key, column, kind) for text columns that show an absolute path (``unix``), a drive path or user@host: (``drive_or_host``).

    The text is taken apart at each mark, a slash, ``:`` with a backslash, or ``@``, and what stands before and after
    decides. Addresses with a scheme are cut out first. Any character that cannot end a name may stand before a path's slash.
    A drive is a letter that ends no word; user and host are not empty and hold no white space, quotes, brackets or list separators.
    """
    cols = cols or [f.name for f in df.schema.fields
                    if isinstance(f.dataType, T.StringType) and f.name not in key]
    token = TOKEN_ENDS.rstrip("+")

    def drive(before, after, i, last):
        return _end(before).rlike("[A-Za-z]") & ~_end(before, 2).rlike("[\\p{L}\\p{N}_]")

    def host(before, after, i, last):
        name = F.get(F.split(after, token[:-1] + ":]", 2), F.lit(0))
        return (before != "") & ~_end(before).rlike(token) & (name != "") & (F.substring(after, F.length(name) + 1, F.lit(1)) == ":")

    # a step for each taking apart: a lambda that takes a text apart itself would do so for every piece
    texts = [F.when(F.col(c).rlike("[/\\\\@]"), F.col(c)).otherwise("") for c in cols]
    n = range(len(cols))
    rows = df.select(*key, *[F.split(t, "://").alias(f"_u{k}") for k, t in zip(n, texts)])
    rows = rows.select(*key, *[_without_addresses(F.col(f"_u{k}")).alias(f"_t{k}") for k in n])
    rows = rows.select(*key, *[F.split(f"_t{k}", mark).alias(f"_{name}{k}") for k in n for name, mark in (("slash", "/"), ("drive", ":\\\\"), ("at", "@"))])

    def shown(k, c):
        kinds = F.array(F.when(_any_joint(F.col(f"_slash{k}"), _starts_path), F.lit("unix")),
                        F.when(_any_joint(F.col(f"_drive{k}"), drive) | _any_joint(F.col(f"_at{k}"), host), F.lit("drive_or_host")))
        return F.transform(F.array_compact(kinds), lambda kind: F.struct(F.lit(c).alias("column"), kind.alias("kind")))
    return rows.select(*key, F.inline(F.flatten(F.array(*[shown(k, c) for k, c in enumerate(cols)]))))


def check_geometry(df: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """(key, reason) for rings that are short, open, or out of coordinate range."""
    r = F.col(ring)
    inside = F.forall(r, lambda p: is_finite(p["lon"]) & is_finite(p["lat"]) &
                      p["lon"].between(-180.0, 180.0) & p["lat"].between(-90.0, 90.0))
    rules = {"short": F.size(r) >= 4,
             "open": F.try_element_at(r, F.lit(1)).eqNullSafe(F.try_element_at(r, F.lit(-1))),
             "range": inside}
    return gate_catalog(df, key, rules)


def check_sector_points(df: DataFrame, key: str, lon: str, sector: str, n: int) -> DataFrame:
    """Points whose east longitude is outside [0, 360) or outside their declared sector."""
    width = 360.0 / n
    ok = ((F.col(lon) >= 0) & (F.col(lon) < 360.0) & (F.col(lon) >= F.col(sector) * width) &
          (F.col(lon) < (F.col(sector) + 1) * width))
    return df.where(~F.coalesce(ok, F.lit(False))).select(key)


def check_curve(curve: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, threshold, reason) for curve points that break the counting rules.

    Reads threshold, retrieved, tp, fp, precision, recall, positives, n.
    """
    rows = with_previous(curve, keys, "threshold", ["threshold", "retrieved", "tp", "fp"], descending=True)
    c, p = F.col, lambda f: F.col(f"prev.{f}")
    first = c("prev").isNull()
    rules = {
        "threshold": first | (c("threshold") < p("threshold")),
        "retrieved": (c("retrieved") == c("tp") + c("fp")) & (first | (c("retrieved") > p("retrieved"))),
        "monotone": first | ((c("tp") >= p("tp")) & (c("fp") >= p("fp"))),
        "precision": F.abs(c("precision") * c("retrieved") - c("tp")) < 1e-9 * F.greatest(c("tp"), F.lit(1)),
        "recall": F.abs(c("recall") * c("positives") - c("tp")) < 1e-9 * F.greatest(c("tp"), F.lit(1)),
        "bounds": (c("tp") <= c("positives")) & (c("retrieved") <= c("n"))}
    reasons = F.filter(F.array(*[F.when(F.coalesce(v, F.lit(False)), None).otherwise(F.lit(k))
                                 for k, v in rules.items()]), lambda r: r.isNotNull())
    points = rows.select(*keys, "threshold", F.explode(reasons).alias("reason"))
    ends = rows.groupBy(*keys).agg(F.min("threshold").alias("threshold"), F.max("retrieved").alias("_r"),
                                   F.max("tp").alias("_t"), F.max("n").alias("_n"), F.max("positives").alias("_p"))
    ends = ends.where((F.col("_r") != F.col("_n")) | (F.col("_t") != F.col("_p"))).select(
        *keys, "threshold", F.lit("end").alias("reason"))
    return points.unionByName(ends)


def check_feature_meta(meta: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Metadata fields that differ from the expectation, compared null-safe."""
    return compare_tables(meta, expected, [key])


def pick(df: DataFrame, fields: list[str]) -> DataFrame:
    """Project to exactly ``fields`` (struct paths allowed); a missing one fails at analysis."""
    return df.select(*[F.col(f).alias(f.replace(".", "_")) for f in fields])


def check_tiles(tiles: DataFrame, catalog: DataFrame, h: int, w: int) -> DataFrame:
    """Catalog tiles that are absent, have another shape or dtype, or another content hash.

    ``tiles`` holds (tile_id, h, w, dtype, sha256) as decoded; the catalog holds tile_sha256.
    """
    j = catalog.select("tile_id", "tile_sha256").join(
        tiles.select("tile_id", "h", "w", "dtype", "sha256", F.lit(True).alias("_present")), "tile_id", "left")
    status = (F.when(F.col("_present").isNull(), "missing")
              .when((F.col("h") != h) | (F.col("w") != w), "shape")
              .when(F.col("dtype") != "float32", "dtype")
              .when(F.col("sha256") != F.col("tile_sha256"), "hash"))
    return j.select("tile_id", status.alias("status")).where("status is not null")


def check_optional(df: DataFrame, flag: str, value: str, n: int) -> DataFrame:
    """Rows where the flag and a finite ``n``-vector do not go together."""
    v = F.col(value)
    present = v.isNotNull() & (F.size(v) == n) & F.forall(v, is_finite)
    good = (F.col(flag) & F.coalesce(present, F.lit(False))) | (~F.col(flag) & v.isNull())
    return df.where(~F.coalesce(good, F.lit(False)))
