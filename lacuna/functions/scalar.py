"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.model import known_pass, known_status


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def combination_key(depth, spt, txt, txe) -> Column:
    """d30_spt1_txt0_txe0"""
    return F.format_string("d%d_spt%d_txt%d_txe%d", col(depth).cast("int"), *[col(c).cast("int") for c in (spt, txt, txe)])


def readable_combination(key) -> Column:
    """Depth>=30m, SPT:Yes, TriaxialTotal:No, TriaxialEffective:No"""
    part = lambda p: F.when(F.regexp_extract(col(key), p + "([01])", 1) == "1", "Yes").otherwise("No")
    return F.concat(F.lit("Depth>="), F.regexp_extract(col(key), r"^d(-?\d+)_", 1), F.lit("m, SPT:"), part("spt"), F.lit(", TriaxialTotal:"), part("txt"), F.lit(", TriaxialEffective:"), part("txe"))


def csv_filename(key, kind: str = "proposed") -> Column:
    return F.concat(F.lit(f"{kind}_"), col(key), F.lit(".csv"))


def zone_id(layer, name) -> Column:
    return F.concat_ws(":", col(layer), col(name))


def pair_key(a, b) -> Column:
    return F.concat_ws("||", col(a), col(b))


def sorted_pair_key(a, b) -> Column:
    return F.concat_ws("_", F.least(col(a), col(b)), F.greatest(col(a), col(b)))


def split_pair(key) -> list[Column]:
    """zone_a and zone_b of a pair key."""
    parts = F.split(col(key), r"\|\|")
    return [F.element_at(parts, 1).alias("zone_a"), F.element_at(parts, 2).alias("zone_b")]


def known_pair(key, zones) -> Column:
    """Both zones of a pair key (G3): split at ||, else two of the known zones (an array) around an underscore, else split at every underscore.

    Of several readings that with the shortest first zone counts.
    """
    k = col(key)
    first = F.array_sort(F.filter(col(zones), lambda z: k.startswith(F.concat(z, F.lit("_"))) & F.array_contains(col(zones), F.substr(k, F.length(z) + 2))))
    shortest = F.element_at(first, 1)
    legacy = F.when(F.size(first) > 0, F.array(shortest, F.substr(k, F.length(shortest) + 2))).otherwise(F.split(k, "_"))
    return F.when(k.contains("||"), F.split(k, r"\|\|")).otherwise(legacy)


def safe_name(name, longest: int = 40) -> Column:
    """Letters, digits, dot, dash and underscore; others become underscores, runs of them one."""
    return F.substring(F.regexp_replace(F.regexp_replace(col(name), r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), 1, longest)


def safe_depth(raw) -> Column:
    """A missing, NaN or unreadable depth is 0."""
    return F.coalesce(F.nanvl(col(raw).try_cast("double"), F.lit(0.0)), F.lit(0.0))


def hectares(m2) -> Column:
    return col(m2) / 10_000


def percent(part, whole) -> Column:
    return F.when(col(whole) > 0, 100.0 * col(part) / col(whole)).otherwise(F.lit(0.0))


def depth_steps(deepest, step: int) -> Column:
    """0, step, ... up to the first multiple above the deepest."""
    s = int(step)
    return F.sequence(F.lit(0), ((F.floor(col(deepest) / s) + 1) * s).cast("int"), F.lit(s))


def cell_threshold(base, k: float, spacing) -> Column:
    return F.greatest(col(base) if not isinstance(base, float) else F.lit(base), F.lit(k) * col(spacing) * col(spacing))


def cell_count(area, target, least: int, most: int) -> Column:
    t = F.lit(float(target)) if isinstance(target, (int, float)) else col(target)
    return F.least(F.greatest(F.ceil(col(area) / t), F.lit(least)), F.lit(most)).cast("int")


def centre(lo, hi) -> Column:
    return (col(lo) + col(hi)) / 2


def display_name(name) -> Column:
    """Without a trailing _<number>."""
    return F.regexp_replace(col(name), r"_\d+$", "")


def half_even(c, places: int) -> Column:
    """Rounds halves to even, on the decimal value."""
    return F.bround(col(c), places)


def hex_to_rgb(c) -> list[Column]:
    return [F.conv(F.substring(F.ltrim(F.lit("#"), col(c)), 1 + 2 * i, 2), 16, 10).cast("int").alias(n) for i, n in enumerate("rgb")]


def fingerprint(df: DataFrame, columns: list[str], length: int = 16) -> DataFrame:
    """One row: a digest of the rows as a multiset, whatever their order.

    Digests are summed rather than collected, so that no task holds them all: four sums of 8 hex digits each.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    part = lambda i: F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("long")
    sums = df.select(*[part(i).alias(f"s{i}") for i in range(4)]).agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0)).alias(f"s{i}") for i in range(4)], F.count("*").alias("n"))
    return sums.select(F.substring(F.sha2(F.concat_ws("|", "n", "s0", "s1", "s2", "s3"), 256), 1, length).alias("fingerprint"))


def normalise_sites(df: DataFrame, radius: float = 100.0) -> DataFrame:
    """One schema for sites: missing radius, pass, status and flag are filled in."""
    have = set(df.columns)
    get = lambda c, t: F.col(c).cast(t) if c in have else F.lit(None).cast(t)
    return df.select(
        get("x", "double").alias("x"), get("y", "double").alias("y"), F.coalesce(get("coverage_radius", "double"), F.lit(float(radius))).alias("coverage_radius"),
        known_pass(get("source_pass", "string")).alias("source_pass"), known_status(get("status", "string")).alias("status"),
        get("zone_id", "string").alias("zone_id"), get("cluster_id", "string").alias("cluster_id"), get("tier", "int").alias("tier"), F.coalesce(get("is_centreline", "boolean"), F.lit(False)).alias("is_centreline"),
    )


def with_status(df: DataFrame, status: str) -> DataFrame:
    """The same sites with another status; the pass they came from stays."""
    return df.withColumn("status", known_status(F.lit(status)))


def palette_index(df: DataFrame, column: str, colours: int) -> DataFrame:
    """A colour number for each distinct value, cycled (G19); none for null. Ranked on the distinct values only."""
    from lacuna.operators import ranking

    ranks = ranking.numbered(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], "_rank")
    return df.join(ranks.select(column, ((F.col("_rank") - 1) % colours).cast("int").alias("colour")), column, "left")
