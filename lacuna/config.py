"""Settings as frozen dataclasses, their presets, and the layered defaults of zones."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LatticeConfig:
    candidate_factor: float = 0.5
    test_factor: float = 0.2
    grid: str = "hexagonal"

    def __post_init__(self):
        if self.grid not in ("hexagonal", "rectangular"):
            raise ValueError(f"unknown grid {self.grid!r}")
        if self.candidate_factor <= 0 or self.test_factor <= 0:
            raise ValueError("lattice factors must be positive")


@dataclass(frozen=True)
class SolverConfig:
    mode: str = "cover"  # or greedy
    target_pct: float = 100.0
    exclusion_factor: float | None = 0.9
    conflict_mode: str = "pairwise"  # or clique, none
    max_conflict_pairs: int | None = None  # given, a result that met it says so in its status
    local_search_rounds: int = 200
    exact_steps: int = 20_000
    dual_steps: int = 400
    min_gap_m2: float = 100.0
    min_gain_m2: float = 10_000.0
    min_gain_pct: float = 8.0

    def __post_init__(self):
        if self.mode not in ("cover", "greedy"):
            raise ValueError(f"unknown solver mode {self.mode!r}")
        if self.conflict_mode not in ("pairwise", "clique", "none"):
            raise ValueError(f"unknown conflict mode {self.conflict_mode!r}")
        if not 0 < self.target_pct <= 100:
            raise ValueError("target_pct must be in (0, 100]")

    @classmethod
    def fast(cls) -> SolverConfig:
        return cls(mode="greedy", local_search_rounds=0, exact_steps=0, dual_steps=0)

    @classmethod
    def precise(cls) -> SolverConfig:
        return cls(local_search_rounds=2000, exact_steps=2_000_000, dual_steps=2000)

    @classmethod
    def from_dict(cls, given: Mapping[str, Any]) -> SolverConfig:
        names = {f.name for f in fields(cls)}
        if unknown := set(given) - names:
            raise ValueError(f"unknown solver settings: {sorted(unknown)}")
        return cls(**given)


@dataclass(frozen=True)
class TierConfig:
    tier1: float = 1.0
    tier2: float = 2.5
    ring_test_factor: float = 2.0
    spacing_method: str = "average"  # min, max, average


@dataclass(frozen=True)
class CellConfig:
    """Sizes above which zones and clusters are split, in square metres; k and m scale with the spacing squared."""

    target: float = 1e6
    threshold: float = 2e6
    k_target: float = 200.0
    k_threshold: float = 400.0
    least: int = 2
    most: int = 30

    def thresholds(self, spacing: float) -> tuple[float, float]:
        return max(self.target, self.k_target * spacing**2), max(self.threshold, self.k_threshold * spacing**2)


CLUSTER_CELLS = CellConfig(target=2e6, threshold=4e6, most=50)


@dataclass(frozen=True)
class Settings:
    global_spacing_m: float = 100.0
    min_overlap_m2: float = 100.0
    dedupe_m: float = 0.5
    depth_step: int = 50
    lattice: LatticeConfig = LatticeConfig()
    solver: SolverConfig = SolverConfig()
    tiers: TierConfig = TierConfig()
    zone_cells: CellConfig = CellConfig()
    cluster_cells: CellConfig = CLUSTER_CELLS

    def with_env(self, prefix: str = "LACUNA_", env: Mapping[str, str] = os.environ) -> Settings:
        """Top-level numbers may be overridden by the environment."""
        changes: dict[str, Any] = {}
        for f in fields(self):
            raw = env.get(prefix + f.name.upper())
            if raw is not None and isinstance(getattr(self, f.name), (int, float)):
                changes[f.name] = type(getattr(self, f.name))(raw)
        return replace(self, **changes)


def env_bool(raw: str | None, default: bool) -> bool:
    if raw is None:
        return default
    if raw.strip().lower() in ("1", "true", "yes", "on"):
        return True
    if raw.strip().lower() in ("0", "false", "no", "off"):
        return False
    raise ValueError(f"not a boolean: {raw!r}")


def enabled_layers(layers: DataFrame, coverage_only: bool = False, centrelines: bool = False) -> DataFrame:
    """Enabled layers in their order (B4); missing flags count as enabled."""
    out = layers.where(F.coalesce(F.col("enabled"), F.lit(True)))
    if coverage_only:
        out = out.where(F.coalesce(F.col("use_for_coverage"), F.lit(False)))
    if centrelines:
        out = out.where(F.coalesce(F.col("centreline"), F.lit(False)))
    return out.orderBy("layer_order", "layer_key")


def with_zone_settings(zones: DataFrame, layers: DataFrame, features: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Each zone's spacing and order by the first of feature, layer and global defaults that is set; disabled features drop out.

    zones: source_layer, zone_name, ...; layers: layer_key, max_spacing_m, ord; features: layer_key, zone_name,
    enabled, max_spacing_m, ord. Both settings tables are per layer and feature; Spark broadcasts them by size.
    """
    f = features.select(F.col("layer_key").alias("source_layer"), "zone_name", F.col("enabled").alias("f_on"), F.col("max_spacing_m").alias("f_s"), F.col("ord").alias("f_o"))
    la = layers.select(F.col("layer_key").alias("source_layer"), F.col("max_spacing_m").alias("l_s"), F.col("ord").alias("l_o"))
    own = [c for c in zones.columns if c not in ("max_spacing_m", "ord")]
    joined = zones.select(*own).join(f, ["source_layer", "zone_name"], "left").join(la, "source_layer", "left")
    spacing: Column = F.coalesce("f_s", "l_s", F.lit(settings.global_spacing_m))
    return joined.where(F.coalesce("f_on", F.lit(True))).select(*own, spacing.alias("max_spacing_m"), F.coalesce("f_o", "l_o", F.lit(999)).alias("ord"))
