"""Consolidation across zone and cell borders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.config import CLUSTER_CELLS, CellConfig, Settings
from lacuna.functions import scalar
from lacuna.operators import dedupe, djoin, lattice, region, solve
from lacuna.operators.graph import connected_components, cut

SPACING = {"min": F.min, "max": F.max, "average": F.avg}


def clouds(tests: DataFrame, h: float, max_radius: float, zone: str = "zone") -> DataFrame:
    """Coverage cloud of each zone: cells whose centre is within required_radius of one of its tests."""
    own = tests.select(zone, F.floor(F.col("x") / h).alias("ix"), F.floor(F.col("y") / h).alias("iy"), "required_radius").distinct()
    return region.dilate(own, "required_radius", h, [zone], max_radius).select(zone, "ix", "iy").distinct()


def tiers(pair_cells: DataFrame, reach: float | str, h: float, keys: list[str], max_radius: float | None = None) -> DataFrame:
    """The region grown by reach (I4)."""
    return region.dilate(pair_cells, reach, h, keys, max_radius).select(*keys, "ix", "iy").distinct()


def group_pairs(tier1: DataFrame, pair: str = "pair") -> DataFrame:
    """pair and cluster: pairs whose tier-1 regions meet, transitively (C13, J2). pair is an integer."""
    least = tier1.groupBy("ix", "iy").agg(F.min(pair).alias("a"))
    edges = tier1.join(least, ["ix", "iy"]).select("a", F.col(pair).alias("b")).distinct()
    return connected_components(edges).select(F.col("id").alias(pair), F.col("component").alias("cluster"))


def spacing_of(zones: DataFrame, keys: list[str], method: str = "average", fallback: float = 100.0) -> DataFrame:
    """The spacing of a group of zones."""
    if method not in SPACING:
        raise ValueError(f"unknown spacing method {method!r}")
    return zones.groupBy(*keys).agg(F.coalesce(SPACING[method]("max_spacing_m"), F.lit(fallback)).alias("spacing"))


def classify(sites: DataFrame, tier1: DataFrame, tier2: DataFrame, h: float, keys: list[str]) -> DataFrame:
    """Sites with role for each region: candidate in tier 1 (locked if on a centreline), locked in tier 2 (L1)."""
    t1 = region.contains(sites, tier1, h, keys).withColumn("role", F.when(F.col("is_centreline"), "locked").otherwise("candidate"))
    t2 = region.contains(sites, region.difference(tier2, tier1, keys), h, keys).withColumn("role", F.lit("locked"))
    return t1.unionByName(t2)


def external(sites: DataFrame, tier2: DataFrame, r_max: float, h: float, keys: list[str]) -> DataFrame:
    """Sites within r_max beyond tier 2 (L1)."""
    ring = region.difference(region.dilate(tier2, r_max, h, keys), tier2, keys)
    return region.contains(sites, ring, h, keys).withColumn("role", F.lit("external"))


def ring_tests(tier1: DataFrame, tier2: DataFrame, zones: DataFrame, r_max: float, h: float, settings: Settings, keys: list[str]) -> DataFrame:
    """Test points in (tier 2 - tier 1) and inside zones (H4)."""
    ring = region.intersection(region.difference(tier2, tier1, keys), zones.select("ix", "iy").distinct())
    spacing = settings.lattice.test_factor * settings.tiers.ring_test_factor * r_max
    return lattice.cell_lattice(ring, h, F.lit(spacing), keys).withColumns({"required_radius": F.lit(float(r_max)), "zone": F.lit("tier2_ring")})


def consolidate(sites: DataFrame, tests: DataFrame, tier1: DataFrame, tier2: DataFrame, r_max: float, h: float, settings: Settings = Settings(), source_pass: str = "Second Pass", split: bool = True) -> dict[str, DataFrame]:
    """One pass over all clusters at once.

    sites: seq, x, y, is_centreline; tests: test, x, y, required_radius; tier1 and tier2: problem, ix, iy.
    problem is an integer; each cluster covers its tier-1 tests afresh, from lattice candidates and its own sites; sites in
    tier 2 stay and count. Returns selected, removed, added and summary. A cluster whose solve fails
    keeps its sites. What one cluster removes, no other adds (F2).
    """
    roles = cut(classify(sites, tier1, tier2, h, ["problem"]))
    locked = roles.where("role = 'locked'").select("problem", "x", "y")
    mine = region.contains(tests, tier1, h, ["problem"]).select("problem", "test", "x", "y", "required_radius")
    served = djoin.distance_join(mine, locked.withColumnRenamed("problem", "owner"), "required_radius", r_max).where("problem = r_owner").select("problem", "test").distinct()
    open_ = cut(mine.join(served, ["problem", "test"], "left_anti"))
    step = settings.lattice.candidate_factor * r_max
    grid = lattice.cell_lattice(tier1, h, F.lit(step), ["problem"]).select("problem", "x", "y", F.lit(None).cast("long").alias("seq"))
    own = roles.where("role = 'candidate'").select("problem", "x", "y", F.col("seq").cast("long").alias("seq"))
    both = own.unionByName(grid).withColumn("cand", F.xxhash64("problem", "x", "y")).dropDuplicates(["problem", "cand"])
    near = djoin.distance_join(both.where("seq IS NULL").select("problem", "cand", "x", "y"), own.select(F.col("problem").alias("owner"), "x", "y"), 1.0).where("problem = r_owner").select("problem", "cand").distinct()
    both = cut(both.join(near, ["problem", "cand"], "left_anti"))
    factor = settings.solver.exclusion_factor or 0.0
    solved = cut(solve.place_sites(open_, both.withColumn("exclusion", F.lit(factor * r_max)), r_max, settings.solver, split=split))
    good = solved.groupBy("problem").agg(F.bool_and(F.col("status").isin("optimal", "feasible", "conflicts_capped", "nothing_to_cover")).alias("ok")).where("ok").select("problem")
    selected = solved.where("cand IS NOT NULL").join(good, "problem", "left_semi").select("problem", "cand", "x", "y")
    removed = own.join(good, "problem", "left_semi").join(both.select("problem", "cand", "seq").where("seq IS NOT NULL"), ["problem", "seq"]).join(selected.select("problem", "cand"), ["problem", "cand"], "left_anti")
    # clusters without an open test have nothing to solve: all their candidates are spare
    idle = own.join(solved.select("problem").distinct(), "problem", "left_anti").withColumn("cand", F.lit(None).cast("long"))
    removed = cut(removed.select("problem", "seq", "x", "y").unionByName(idle.select("problem", "seq", "x", "y")).dropDuplicates(["seq"]))
    # what another cluster keeps stays
    kept = selected.join(both.where("seq IS NOT NULL").select("problem", "cand", "seq"), ["problem", "cand"]).select("seq").distinct()
    removed = removed.join(kept, "seq", "left_anti")
    added = selected.join(both.where("seq IS NULL").select("problem", "cand"), ["problem", "cand"], "left_semi").withColumn("source_pass", F.lit(source_pass))
    added = cut(dedupe.not_readded(added, removed))
    removed = cut(removed.join(_missed(sites, tests, removed, added, r_max), "seq", "left_anti"))
    return {"selected": selected, "removed": removed, "added": added, "candidates": both.select("problem", "cand", "x", "y"), "summary": solve.totals(solved)}


def _missed(sites: DataFrame, tests: DataFrame, removed: DataFrame, added: DataFrame, r_max: float) -> DataFrame:
    """seq of removed sites that a test needs which nothing else covers: one cluster has counted on what another has removed."""
    near = cut(djoin.distance_join(tests.select("test", "x", "y", "required_radius"), removed.select("seq", "x", "y"), "required_radius", r_max).select("test", "x", "y", "required_radius", F.col("r_seq").alias("seq")))
    final = sites.select("seq", "x", "y").join(removed.select("seq"), "seq", "left_anti").select("x", "y").unionByName(added.select("x", "y"))
    return djoin.distance_join(near, final, "required_radius", r_max, "anti").select("seq").distinct()


def passed(sites: DataFrame, out: dict[str, DataFrame]) -> DataFrame:
    """seq, x, y and is_centreline of all sites after a pass; added ones have a hash of their place as seq."""
    new = out["added"].select(F.xxhash64("x", "y").alias("seq"), "x", "y", F.lit(False).alias("is_centreline")).dropDuplicates(["seq"])
    return sites.select(F.col("seq").cast("long").alias("seq"), "x", "y", "is_centreline").join(out["removed"].select("seq"), "seq", "left_anti").unionByName(new)


def still_open(tests: DataFrame, tier1: DataFrame, final: DataFrame, candidates: DataFrame, r_max: float, h: float) -> DataFrame:
    """problem and test of tier-1 tests that no site covers after a pass although a candidate of their problem could; none, if all is well."""
    mine = region.contains(tests, tier1, h, ["problem"]).select("problem", "test", "x", "y", "required_radius")
    left = djoin.distance_join(mine, final.select("x", "y"), "required_radius", r_max, "anti")
    return djoin.distance_join(left, candidates.select(F.col("problem").alias("owner"), "x", "y"), "required_radius", r_max).where("problem = r_owner").select("problem", "test").distinct()


def valid_removals(removed: DataFrame, tier1: DataFrame, h: float) -> DataFrame:
    """Removed sites inside the union of tier 1; others don't count."""
    own = removed.withColumns({"ix": F.floor(F.col("x") / h), "iy": F.floor(F.col("y") / h)})
    return own.join(tier1.select("ix", "iy").distinct(), ["ix", "iy"], "left_semi").drop("ix", "iy")


def tallies(original: DataFrame, final: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """original, final, removed, added and net_change."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = count(original, "original").crossJoin(count(final, "final")).crossJoin(count(removed, "removed")).crossJoin(count(added, "added"))  # one row each
    return out.withColumn("net_change", F.col("final") - F.col("original"))


def pair_colours(pairs: DataFrame) -> DataFrame:
    """pair and colour: pairs of one colour share no problem and can be solved together.

    pairs: pair (integer), a, b. In each round an uncoloured pair whose hash is the least at both of its ends
    takes the least colour that neither end has yet: at most 2 D - 1 colours, where D pairs meet at an end, and a
    number of rounds that grows with the logarithm of the pairs.
    """
    left, out = cut(pairs.select("pair", "a", "b", F.struct(F.xxhash64("pair"), F.col("pair")).alias("rank"))), None
    while not left.isEmpty():
        ends = left.select("pair", "rank", F.explode(F.array("a", "b")).alias("end"))
        least = ends.groupBy("end").agg(F.min("rank").alias("least"))
        wins = ends.join(least, "end").groupBy("pair").agg(F.bool_and(F.col("rank") == F.col("least")).alias("ok"), F.collect_list("end").alias("ends")).where("ok")
        if out is not None:
            taken = out.select(F.explode("ends").alias("end"), "colour").groupBy("end").agg(F.collect_set("colour").alias("taken"))
            wins = wins.select("pair", "ends", F.explode("ends").alias("end")).join(taken, "end", "left").groupBy("pair").agg(F.first("ends").alias("ends"), F.array_distinct(F.flatten(F.collect_list("taken"))).alias("taken"))
        else:
            wins = wins.withColumn("taken", F.array().cast("array<int>"))
        wins = wins.select("pair", "ends", F.array_min(F.array_except(F.sequence(F.lit(0), F.size("taken")), "taken")).alias("colour"))
        out = cut(wins if out is None else out.unionByName(wins))
        left = cut(left.join(out, "pair", "left_anti"))
    return out.select("pair", "colour") if out is not None else pairs.select("pair", F.lit(0).alias("colour")).limit(0)


def split_large(tier1: DataFrame, h: float, cells: CellConfig = CLUSTER_CELLS, rounds: int = 8) -> DataFrame:
    """problem, cluster, ix, iy: clusters above the threshold in Voronoi cells of about the target area, each a problem of its own."""
    one = cut(tier1.select(F.col("problem").alias("cluster"), "ix", "iy").distinct())
    area = one.groupBy("cluster").agg((F.count("*") * h * h).alias("area")).where(F.col("area") > cells.threshold)
    counts = cut(area.select("cluster", scalar.cell_count("area", cells.target, cells.least, cells.most).alias("k")))
    small = one.join(counts, "cluster", "left_anti").withColumn("cell", F.lit(0).cast("long"))
    large = one.join(counts, "cluster", "left_semi")
    apart = region.split_by_centres(large, region.centres_of(large, "cluster", counts, rounds), ["cluster"])
    both = small.select("cluster", "ix", "iy", "cell").unionByName(apart.select("cluster", "ix", "iy", F.col("cell").cast("long").alias("cell")))
    return both.select(F.xxhash64("cluster", "cell").alias("problem"), "cluster", "ix", "iy")


def seams(cells: DataFrame, reach: float, h: float) -> DataFrame:
    """pair, a, b, ix, iy: where two problems of one cluster, each grown by reach, meet inside the cluster."""
    grown = region.dilate(cells.select("cluster", "problem", "ix", "iy"), reach, h, ["cluster", "problem"])
    inside = cut(grown.join(cells.select("cluster", "ix", "iy"), ["cluster", "ix", "iy"], "left_semi"))
    a, b = (inside.select("cluster", "ix", "iy", F.col("problem").alias(n)) for n in "ab")
    return a.join(b, ["cluster", "ix", "iy"]).where("a < b").select(F.xxhash64("a", "b").alias("pair"), "a", "b", "ix", "iy")


def third_pass(sites: DataFrame, tests: DataFrame, cells: DataFrame, r_max: float, h: float, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Consolidation over the seams of split clusters (L6, L7). sites: seq, x, y, is_centreline; cells: problem, cluster, ix, iy.

    Pairs of one colour have no problem in common and are solved together; each colour sees what the ones
    before it removed and added. Returns sites, removed and added; what is added and later removed is in neither.
    """
    strips = cut(seams(cells, r_max, h))
    colours = cut(pair_colours(strips.select("pair", "a", "b").distinct()))
    last = colours.agg(F.max("colour")).first()[0]
    first = cut(sites.select(F.col("seq").cast("long").alias("seq"), "x", "y", "is_centreline"))
    now = first
    for colour in range(0 if last is None else last + 1):
        own = cut(strips.join(colours.where(F.col("colour") == colour), "pair").select(F.col("pair").alias("problem"), "ix", "iy"))
        out = consolidate(now, tests, own, tiers(own, (settings.tiers.tier2 - settings.tiers.tier1) * r_max, h, ["problem"]), r_max, h, settings, "Third Pass", split=False)
        now = cut(passed(now, out))
    return {"sites": now, "removed": first.join(now.select("seq"), "seq", "left_anti"), "added": now.join(first.select("seq"), "seq", "left_anti")}


def run_passes(sites: DataFrame, tests: DataFrame, clusters: DataFrame, r_max: float, h: float, settings: Settings = Settings(), cells: CellConfig = CLUSTER_CELLS) -> dict[str, DataFrame]:
    """Second pass over clusters (problem, ix, iy), large ones in cells, third pass over the cells' seams, and the sites after both.

    Returns sites (seq, x, y, is_centreline, source_pass: what a site was added by, or null), removed (of the
    given sites) and tier1 (the cells of the second pass).
    """
    split = cut(split_large(clusters, h, cells))
    tier1 = split.select("problem", "ix", "iy")
    first = cut(sites.select(F.col("seq").cast("long").alias("seq"), "x", "y", "is_centreline"))
    second = consolidate(first, tests, tier1, tiers(tier1, (settings.tiers.tier2 - settings.tiers.tier1) * r_max, h, ["problem"]), r_max, h, settings)
    between = cut(passed(first, second))
    third = third_pass(between, tests, split, r_max, h, settings)
    by = third["added"].select("seq", F.lit("Third Pass").alias("source_pass")).unionByName(second["added"].select(F.xxhash64("x", "y").alias("seq"), F.lit("Second Pass").alias("source_pass")).distinct())
    by = by.groupBy("seq").agg(F.max("source_pass").alias("source_pass"))
    return {"sites": cut(third["sites"].join(by, "seq", "left")), "removed": first.join(third["sites"].select("seq"), "seq", "left_anti"), "tier1": tier1, "candidates": second["candidates"]}
