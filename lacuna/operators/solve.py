"""Set cover with spacing conflicts for many independent problems.

Problems (zones, clusters, cells) fall into parts too far apart to have anything in common. A part of more
than MAX_EDGES pairs of a test and a candidate is cut into square tiles, whose tests meet the candidates of
a halo; so no group of a grouped map is larger, unless a tile of the least width is.

Tiles have four colours, and tiles of one colour are too far apart to have anything in common. They are solved
together, and the next colour sees what is chosen: tests that are covered are done, candidates in conflict
are out. Tests that come out empty that way are solved again along the ladder of exclusion distances, and
at the end sites that the seams have made redundant go, in rounds of joins.

Bounds are Lagrangian: multipliers of the tests, and of the cliques of the conflict graph, by subgradient
steps. In a tile a candidate costs the share of its multipliers that stand there, so that the tiles' bounds
add up to one of the part; joins by candidate renew the shares. What can't be in a better cover by its reduced cost
is left out of the search that follows. A result carries its status and its bound; `optimal` is claimed only
where all that is coverable is covered by as many sites as the bound, or the search has ended.
"""

from __future__ import annotations

from collections import deque
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.config import SolverConfig
from lacuna.operators.djoin import NEIGHBOURS, distance_join
from lacuna.operators.graph import connected_components, cut

RESULT = "problem long, part long, cand long, x double, y double, status string, conflict_factor double, tests long, coverable long, covered long, lower_bound long"
#: Factors on the exclusion distance that are tried in turn; None: without conflicts.
LADDER = [1.0, 0.8, 0.6, None]
#: Candidates in a row that a search may choose; beyond, it gives up the proof.
DEEPEST = 500
#: Pairs of a test and a candidate in a group.
MAX_EDGES = 150_000
#: How often the shares of candidates that several tiles see are renewed for the bound.
SHARES = 3


def conflicts(x: np.ndarray, y: np.ndarray, distance: float, most: int | None = None) -> tuple[list[np.ndarray], bool]:
    """For each candidate those at most distance away, and whether that is all: given `most`, the first pairs by (a, b) count."""
    n = len(x)
    near: list[list[int]] = [[] for _ in range(n)]
    cell: dict[tuple[int, int], list[int]] = {}
    for i in range(n):
        cell.setdefault((int(x[i] // distance), int(y[i] // distance)), []).append(i)
    pairs = 0
    for i in range(n):
        u, v = int(x[i] // distance), int(y[i] // distance)
        for j in sorted(j for du in (-1, 0, 1) for dv in (-1, 0, 1) for j in cell.get((u + du, v + dv), ()) if j > i):
            if (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 <= distance * distance:
                pairs += 1
                if most is not None and pairs > most:
                    continue
                near[i].append(j)
                near[j].append(i)
    return [np.array(k, np.int64) for k in near], most is None or pairs <= most


def clique_cover(near: list[np.ndarray], pairs_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Cliques that hold every conflict, as a clique and a candidate of each membership: grown from each pair that no clique holds yet."""
    sets = [set(k.tolist()) for k in near]
    held: set[tuple[int, int]] = set()
    clique, member, n = [], [], 0
    for a, own in enumerate(near):
        for b in own[own > a].tolist():
            if (a, b) in held:
                continue
            own_, common = [a, b], sorted(sets[a] & sets[b])
            while common and not pairs_only:
                own_.append(common[0])
                common = [c for c in common[1:] if c in sets[own_[-1]]]
            held.update((x, y) for x in own_ for y in own_ if x < y)
            clique += [n] * len(own_)
            member += own_
            n += 1
    return np.array(clique, np.int64), np.array(member, np.int64)


def maximal_cliques(near: list[np.ndarray], most: int | None = None) -> tuple[list[list[int]], bool]:
    """Maximal cliques of two or more (Bron-Kerbosch with a pivot), in a fixed order, and whether these are all: given `most`, so many at most."""
    sets = [set(k.tolist()) for k in near]
    out: list[list[int]] = []
    stack = deque([(set(), set(range(len(near))), set())])
    while stack and (most is None or len(out) < most):
        r, p, x = stack.pop()
        if not p and not x:
            if len(r) > 1:
                out.append(sorted(r))
            continue
        pivot = max(sorted(p | x), key=lambda u: len(p & sets[u]))
        for v in sorted(p - sets[pivot], reverse=True):
            stack.append((r | {v}, p & sets[v], x & sets[v]))
            p = p - {v}
            x = x | {v}
    return sorted(out), not stack


def clique_stats(cliques: list[list[int]]) -> dict[str, float]:
    sizes = [len(c) for c in cliques]
    return {"cliques": len(sizes), "largest": max(sizes, default=0), "average": sum(sizes) / len(sizes) if sizes else 0.0, "pairwise_equivalent": sum(s * (s - 1) // 2 for s in sizes)}


class Problem:
    """Tests 0 ... t - 1, candidates 0 ... c - 1, which candidate covers which test, and conflicts."""

    def __init__(self, covers: list[np.ndarray], tests: int, near: list[np.ndarray] | None):
        self.covers, self.tests, self.near = covers, tests, near
        self.of_cand = np.repeat(np.arange(len(covers)), [len(c) for c in covers])
        self.of_test = np.concatenate([np.zeros(0, np.int64), *covers]).astype(np.int64)
        self.by_test: list[list[int]] = [[] for _ in range(tests)]
        for c, own in enumerate(covers):
            for t in own.tolist():
                self.by_test[t].append(c)
        self.coverable = sum(1 for c in self.by_test if c)

    def greedy(self, need: int, weight: np.ndarray | float = 1.0) -> list[int] | None:
        """The candidate of most open tests (times its weight) first, ties by number, never one in conflict with a chosen one."""
        open_, free, chosen = np.ones(self.tests, bool), np.ones(len(self.covers), bool), []
        gain = np.array([len(c) for c in self.covers])
        done = 0
        while done < need:
            if not len(gain):
                return None
            best = int(np.argmax(np.where(free, gain * weight, 0)))
            if not free[best] or gain[best] == 0:
                return None
            chosen.append(best)
            free[best] = False
            if self.near is not None:
                free[self.near[best]] = False
            for t in self.covers[best][open_[self.covers[best]]].tolist():
                open_[t] = False
                done += 1
                gain[self.by_test[t]] -= 1
        return chosen

    def prune(self, chosen: list[int], need: int) -> list[int]:
        """Drops what the rest makes redundant, the least useful first."""
        count = np.zeros(self.tests, np.int64)
        for c in chosen:
            count[self.covers[c]] += 1
        covered = int((count > 0).sum())
        out = list(chosen)
        for c in sorted(chosen, key=lambda c: (len(self.covers[c]), c)):
            lost = int((count[self.covers[c]] == 1).sum())
            if covered - lost >= need and (need < self.coverable or lost == 0):
                out.remove(c)
                count[self.covers[c]] -= 1
                covered -= lost
        return out

    def improve(self, chosen: list[int], need: int, rounds: int) -> list[int]:
        """Two chosen candidates give way to one where that keeps all covered; a fixed number of trials."""
        if need < self.coverable:
            return chosen
        out = sorted(chosen)
        for _ in range(rounds):
            count = np.zeros(self.tests, np.int64)
            for c in out:
                count[self.covers[c]] += 1
            swap = self._swap(out, count)
            if swap is None:
                break
            a, b, new = swap
            out = self.prune(sorted(set(out) - {a, b} | {new}), need)
        return out

    def _swap(self, out: list[int], count: np.ndarray) -> tuple[int, int, int] | None:
        own = {c: self.covers[c][count[self.covers[c]] == 1] for c in out}
        chosen = set(out)
        serving: dict[int, list[int]] = {}
        for c in out:
            for t in self.covers[c].tolist():
                serving.setdefault(t, []).append(c)
        for a in out:
            if not len(own[a]):
                continue
            # candidates that cover all that only a covers
            rivals = set(self.by_test[own[a][0]])
            for t in own[a][1:].tolist():
                rivals &= set(self.by_test[t])
            mine = set(self.covers[a].tolist())
            for new in sorted(rivals - chosen):
                held = set(self.covers[new].tolist())
                clash = set() if self.near is None else set(self.near[new].tolist()) & chosen
                # what gives way beside a shares tests with the new one, as something hangs on it alone
                for b in sorted(clash - {a}) or sorted({c for t in held for c in serving.get(t, ())} - {a}):
                    if clash - {a, b}:
                        continue
                    if all(t in held for t in self.covers[b].tolist() if count[t] - 1 - (t in mine) <= 0):
                        return a, b, new
        return None

    def dual(self, steps: int, upper: int, cost: np.ndarray | float = 1.0, cliques: tuple[np.ndarray, np.ndarray] | None = None, spare: int = 0) -> tuple[float, np.ndarray, np.ndarray, list[np.ndarray]]:
        """A bound on the cost of any cover of all coverable tests but `spare`: its value, reduced costs, multipliers of the tests, and reduced costs met on the way.

        Subgradient steps towards upper; cliques: of candidates no two of which can be chosen.
        """
        n, t = len(self.covers), self.tests
        clique, member = cliques or (np.zeros(0, np.int64), np.zeros(0, np.int64))
        cost = np.broadcast_to(np.asarray(cost, float), n)
        u = np.full(t, np.inf)
        np.minimum.at(u, self.of_test, (cost / np.maximum(np.bincount(self.of_cand, minlength=n), 1))[self.of_cand])
        can = np.isfinite(u)
        u[~can] = 0
        v = np.zeros(int(clique.max()) + 1 if len(clique) else 0)
        best, kept, met, scale, stale = -np.inf, (cost, u), [], 1.0, 0
        for k in range(max(steps, 1)):
            reduced = cost - np.bincount(self.of_cand, u[self.of_test], n) + np.bincount(member, v[clique], n)
            take = reduced < 0
            value = u.sum() - v.sum() + reduced[take].sum()
            top = np.argpartition(-u, spare - 1)[:spare] if spare else np.zeros(0, np.int64)
            value -= u[top].sum()
            if value > best + 1e-9:
                best, kept, stale = value, (reduced, u), 0
            else:
                stale += 1
                if stale == 12:
                    scale, stale = scale / 2, 0
            if k % 40 == 39:
                met.append(kept[0])
            if ceil(best - 1e-6) >= upper or scale < 1e-4:
                break
            g = np.where(can, 1 - np.bincount(self.of_test, take[self.of_cand], t), 0.0)
            g[top] -= 1
            h = np.bincount(clique, take[member], len(v)) - 1.0
            length = g @ g + h @ h
            if not length:
                break
            step = scale * max(upper - value, 0.01 * upper) / length
            u, v = np.maximum(u + step * g, 0), np.maximum(v + step * h, 0)
        return best, *kept, [*met, kept[0]]

    def exact(self, best: list[int] | None, steps: int, out: frozenset[int] = frozenset()) -> tuple[list[int] | None, bool]:
        """Branch and bound on the open test of fewest candidates: the best cover, and whether the search ended.

        steps: how many times a test may be looked at, whatever the size of the problem. best: a cover to beat.
        out: candidates that no better cover holds.
        """
        result, left = best, steps

        def go(chosen: list[int], open_: frozenset[int], banned: frozenset[int]) -> None:
            nonlocal result, left
            left -= len(open_) if len(chosen) < DEEPEST else left + 1
            if left < 0 or result is not None and len(chosen) + bool(open_) >= len(result):
                return
            if not open_:
                result = list(chosen)
                return
            t = min(open_, key=lambda t: (sum(c not in banned for c in self.by_test[t]), t))
            for c in self.by_test[t]:
                if c not in banned:
                    more = banned if self.near is None else banned | frozenset(self.near[c].tolist())
                    go([*chosen, c], open_ - frozenset(self.covers[c].tolist()), more)

        go([], frozenset(t for t in range(self.tests) if self.by_test[t]), out)
        return (sorted(result) if result is not None else None), left >= 0

    def lower_bound(self) -> int:
        """Tests, the one of fewest candidates first, no two of which share a candidate."""
        used, n = np.zeros(len(self.covers), bool), 0
        for t in sorted((t for t in range(self.tests) if self.by_test[t]), key=lambda t: (len(self.by_test[t]), t)):
            if not used[self.by_test[t]].any():
                used[self.by_test[t]] = True
                n += 1
        return n


def solve(covers: list[np.ndarray], tests: int, x: np.ndarray, y: np.ndarray, exclusion: float, config: SolverConfig) -> tuple[list[int], str, float | None, int]:
    """Chosen candidates, status, conflict factor and lower bound.

    Full cover asks for every coverable test, a partial one for int(tests * target) of them, as far as
    they are coverable. Where conflicts leave no cover, the exclusion distance shrinks along the ladder.
    conflict_mode: cliques of conflicts sharpen the bound more than pairs do; both forbid the same.
    """
    steps = [None] if config.conflict_mode == "none" or not config.exclusion_factor or exclusion <= 0 else LADDER
    for factor in steps:
        near, whole = (None, True) if factor is None else conflicts(x, y, factor * exclusion, config.max_conflict_pairs)
        p = Problem(covers, tests, near)
        need = p.coverable if config.target_pct >= 99.9 else min(p.coverable, int(tests * config.target_pct / 100))
        if need == 0:
            return [], "nothing_to_cover", factor, 0
        chosen = p.greedy(need) or _repair(p, need)
        bound = p.lower_bound() if need == p.coverable else 1
        if config.mode == "cover":
            if chosen is not None:
                chosen = p.improve(p.prune(chosen, need), need, config.local_search_rounds)
            cliques = clique_cover(near, config.conflict_mode == "pairwise") if near is not None else None
            value, reduced, _, met = p.dual(config.dual_steps, len(chosen) if chosen else p.coverable, cliques=cliques, spare=p.coverable - need)
            bound = max(bound, ceil(value - 1e-6))
            for r in met if chosen is None or len(chosen) > bound else []:
                other = p.greedy(need, np.exp(-2 * np.clip(r, -5, 5)))
                if other is not None and (chosen is None or len(other := p.prune(other, need)) < len(chosen) + 2):
                    other = p.improve(p.prune(other, need), need, config.local_search_rounds)
                    chosen = other if chosen is None or len(other) < len(chosen) else chosen
            if need == p.coverable and (chosen is None or len(chosen) > bound):
                out = frozenset(np.flatnonzero(value + reduced > len(chosen) - 1 + 1e-6).tolist()) if chosen is not None else frozenset()
                found, ended = p.exact(chosen, config.exact_steps, out)
                chosen = found if found is not None else chosen
                bound = len(chosen) if ended and chosen is not None else bound
        if chosen is not None:
            return sorted(chosen), ("optimal" if len(chosen) == bound else "feasible") if whole else "conflicts_capped", factor, bound if whole else 0
    return [], "infeasible", None, 0


def _repair(p: Problem, need: int) -> list[int] | None:
    """Greedy again with the tests that came out empty served first, as long as others come out empty."""
    first: list[int] = []
    while True:
        open_, free, chosen = np.ones(p.tests, bool), np.ones(len(p.covers), bool), []

        def take(c: int) -> None:
            chosen.append(c)  # noqa: B023
            free[c] = False  # noqa: B023
            if p.near is not None:
                free[p.near[c]] = False  # noqa: B023
            open_[p.covers[c]] = False  # noqa: B023

        for t in first:
            if open_[t]:
                some = [c for c in p.by_test[t] if free[c]]
                if some:
                    take(max(some, key=lambda c: (int(open_[p.covers[c]].sum()), -c)))
        while True:
            gain = [int(open_[own].sum()) if free[c] else 0 for c, own in enumerate(p.covers)]
            best = int(np.argmax(gain)) if gain else 0
            if not gain or gain[best] == 0:
                break
            take(best)
        missed = [t for t in range(p.tests) if open_[t] and p.by_test[t]]
        if p.coverable - len(missed) >= need:
            return chosen
        new = [t for t in missed if t not in first]
        if not new:
            return None
        first = new + first


def parts(tests: DataFrame, candidates: DataFrame) -> DataFrame:
    """tests with part: tests of one problem in different parts share no candidate, and no candidate of one is in conflict with one of the other.

    Cells as wide as two radii and the exclusion distance of the problem; tests of cells that don't touch
    are farther apart than that. Only occupied cells, once each, go into the search for components.
    """
    wide = tests.groupBy("problem").agg((2 * F.max("required_radius")).alias("_w"))
    apart = candidates.groupBy("problem").agg(F.max("exclusion").alias("_x"))
    width = wide.join(apart, "problem", "left").select("problem", F.greatest(F.col("_w") + F.coalesce("_x", F.lit(0.0)), F.lit(1e-9)).alias("_w"))
    own = tests.join(width, "problem").withColumns({"_u": F.floor(F.col("x") / F.col("_w")), "_v": F.floor(F.col("y") / F.col("_w"))}).drop("_w")
    cells = cut(own.select("problem", "_u", "_v").distinct().withColumn("_id", F.xxhash64("problem", "_u", "_v")))
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in NEIGHBOURS]))
    near = cells.withColumn("o", around).select("problem", (F.col("_u") + F.col("o.dx")).alias("_u"), (F.col("_v") + F.col("o.dy")).alias("_v"), F.col("_id").alias("a"))
    edges = near.join(cells, ["problem", "_u", "_v"]).where("a <= _id").select("a", F.col("_id").alias("b"))
    named = cells.join(connected_components(edges).select(F.col("id").alias("_id"), F.col("component").alias("part")), "_id").drop("_id")
    return own.join(named, ["problem", "_u", "_v"]).drop("_u", "_v")


def _problem(e: pa.Table, c: pa.Table) -> tuple[list[np.ndarray], int, dict[str, np.ndarray]]:
    """What each candidate covers, the number of tests, and the candidates by number. Ids never leave 64-bit integers."""
    own = {n: c.column(n).to_numpy() for n in c.column_names if n not in ("problem", "part")}
    order = np.argsort(own["cand"], kind="stable")
    own = {n: v[order] for n, v in own.items()}
    tests, code = np.unique(e.column("test").to_numpy(), return_inverse=True)
    reached = e.column("cand").is_valid().to_numpy()
    cand = e.column("cand").drop_null().to_numpy()
    place = np.searchsorted(own["cand"], cand)
    if len(cand) and (place.max() >= len(order) or (own["cand"][place] != cand).any()):
        raise ValueError("a test names a candidate that its part lacks")
    code = code[reached]
    by = np.lexsort((code, place))
    edges = np.searchsorted(place[by], np.arange(len(order) + 1))
    return [np.unique(code[by][a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], len(tests), own


def solve_problems(edges: DataFrame, candidates: DataFrame, config: SolverConfig = SolverConfig()) -> DataFrame:
    """The chosen candidates of every part of every problem.

    edges: problem, part, test, cand (null where no candidate is in reach); candidates: problem, part, cand,
    x, y, exclusion (the distance of conflicts). A failed part comes back as one row with its error (M3).
    """

    def run(key: tuple[pa.Scalar, ...], e: pa.Table, c: pa.Table) -> pa.Table:
        chosen, factor, bound, covered, coverable, tests, own = [], None, 0, 0, 0, len(e.column("test").unique()), {}
        try:
            covers, tests, own = _problem(e, c)
            coverable = len(np.unique(np.concatenate([np.zeros(0, np.int64), *covers])))
            chosen, status, factor, bound = solve(covers, tests, own["x"], own["y"], float(own["exclusion"][0]) if len(covers) else 0.0, config)
            covered = len(np.unique(np.concatenate([np.zeros(0, np.int64), *(covers[i] for i in chosen)])))
            if status == "optimal" and config.target_pct >= 99.9 and covered < coverable:
                status = "feasible"
        except Exception as error:  # one part's failure is that part's result
            chosen, status = [], f"error: {error}"[:200]
        n = max(1, len(chosen))
        site = [own[k][chosen].tolist() if chosen else [None] for k in ("cand", "x", "y")]
        same = [status, factor, tests, coverable, covered, bound]
        return pa.table([pa.array([k.as_py()] * n, pa.int64()) for k in key] + [pa.array(v, t) for v, t in zip(site, (pa.int64(), pa.float64(), pa.float64()), strict=True)] + [pa.array([v] * n, t) for v, t in zip(same, (pa.string(), pa.float64(), *[pa.int64()] * 4), strict=True)], names=[f.split()[0] for f in RESULT.split(", ")])

    # names anew, as both sides may come from one frame
    e = edges.select(*[F.col(c).alias(c) for c in ("problem", "part", "test", "cand")])
    c = candidates.select(*[F.col(c).alias(c) for c in ("problem", "part", "cand", "x", "y", "exclusion")])
    return e.groupBy("problem", "part").cogroup(c.groupBy("problem", "part")).applyInArrow(run, RESULT)


def place_sites(tests: DataFrame, candidates: DataFrame, max_radius: float, config: SolverConfig = SolverConfig(), max_edges: int = MAX_EDGES, split: bool = True) -> DataFrame:
    """Chosen sites of every problem: tests (problem, test, x, y, required_radius), candidates (problem, cand, x, y, exclusion).

    Tests meet the candidates of their own problem only; a problem is solved in its parts, each of which
    has to reach the target, and a part of more than max_edges edges in tiles (full cover only; other
    targets and modes are solved whole). Equal problems (the same relative layout under several
    combinations, say) are solved once by `place_once` (M5, M6). Without split a problem is one part.
    """
    own = candidates.select("problem", "cand", "x", "y", "exclusion")
    apart = parts(tests, own) if split else tests.withColumn("part", F.col("problem"))
    placed = cut(apart.select("problem", "part", "test", "x", "y", "required_radius"))
    edges = cut(distance_join(placed, own.withColumnRenamed("problem", "cand_problem"), "required_radius", max_radius, explode="left").where("problem = r_cand_problem").select("problem", "part", "test", F.col("x").alias("tx"), F.col("y").alias("ty"), "required_radius", F.col("r_cand").alias("cand"), F.col("r_x").alias("x"), F.col("r_y").alias("y"), F.col("r_exclusion").alias("exclusion")))
    every = placed.select("problem", "part", "test").join(edges.select("problem", "part", "test", "cand"), ["problem", "part", "test"], "left")
    reach = edges.select("problem", "part", "cand", "x", "y", "exclusion").distinct()
    large = edges.groupBy("problem", "part").agg(F.count("*").alias("n")).where(F.col("n") > max_edges).select("problem", "part")
    if config.mode != "cover" or config.target_pct < 99.9 or large.isEmpty():
        return solve_problems(every, reach, config)
    large, key = F.broadcast(cut(large)), ["problem", "part"]  # at most one row for max_edges edges
    small = solve_problems(every.join(large, key, "left_anti"), reach.join(large, key, "left_anti"), config)
    return small.unionByName(_in_tiles(every.join(large, key, "left_semi"), cut(edges.join(large, key, "left_semi")), config, max_edges))


def tiled(edges: DataFrame, max_edges: int) -> DataFrame:
    """edges with tile (two numbers) and colour: per part the widest square tiles of at most max_edges edges each.

    Widths are the least one, two radii and the exclusion distance, times powers of two, so tiles of one
    colour have no candidate and no conflict in common. Where the least width holds more, that is used.
    """
    key = ["problem", "part"]
    wide = edges.groupBy(*key).agg((2 * F.max("required_radius") + F.max("exclusion")).alias("w"))
    own = edges.join(wide, key).withColumns({"u": F.floor(F.col("tx") / F.col("w")), "v": F.floor(F.col("ty") / F.col("w"))})
    fine = own.groupBy(*key, "u", "v").agg(F.count("*").alias("n"))
    span = lambda c: F.expr(f"shiftright({c}, level)")
    sizes = fine.withColumn("level", F.explode(F.expr("sequence(0, 40)"))).groupBy(*key, "level", span("u").alias("u"), span("v").alias("v")).agg(F.sum("n").alias("n"))
    level = sizes.groupBy(*key, "level").agg(F.max("n").alias("n")).groupBy(*key).agg(F.coalesce(F.max(F.when(F.col("n") <= max_edges, F.col("level"))), F.lit(0)).alias("level"))
    own = own.join(level, key).withColumns({"u": span("u"), "v": span("v")})
    return own.withColumn("colour", (F.pmod("u", F.lit(2)) * 2 + F.pmod("v", F.lit(2))).cast("int")).drop("w", "level")


def _in_tiles(every: DataFrame, edges: DataFrame, config: SolverConfig, max_edges: int) -> DataFrame:
    key = ["problem", "part"]
    edges = cut(tiled(edges, max_edges).withColumn("tile", F.xxhash64(*key, "u", "v")))
    reach = cut(edges.select(*key, "cand", "x", "y", "exclusion").distinct())
    chosen = reach.select(*key, "cand", "x", "y", "exclusion", F.lit(1.0).alias("factor")).limit(0)
    free = config.conflict_mode == "none" or not config.exclusion_factor

    def left(some: DataFrame) -> DataFrame:
        """The edges of tests that no chosen site covers."""
        done = edges.join(chosen.select("problem", "cand"), ["problem", "cand"], "left_semi").select(*key, "test").distinct()
        return some.join(done, [*key, "test"], "left_anti")

    def add(some: DataFrame, factor: float | None) -> None:
        """Chooses sites for some edges' tests, grouped by tile, none within factor x exclusion of a chosen one."""
        nonlocal chosen
        c = some.select(*key, "tile", "cand", "x", "y", "exclusion").distinct()
        if factor is not None and not free:
            most = reach.agg(F.max("exclusion")).first()[0] * factor
            near = distance_join(c, chosen.select(F.col("problem").alias("owner"), "x", "y"), F.col("exclusion") * factor, most).where("problem = r_owner").select(*key, "cand").distinct() if most else c.limit(0).select(*key, "cand")
            c = c.join(near, [*key, "cand"], "left_anti")
            some = some.join(c.select("tile", "cand"), ["tile", "cand"], "left_semi")
        mine = config if factor is not None else SolverConfig(**{**config.__dict__, "conflict_mode": "none"})
        c = c.withColumn("exclusion", F.col("exclusion") * (factor or 1.0))
        got = solve_problems(some.select("problem", F.col("tile").alias("part"), "test", "cand"), c.select("problem", F.col("tile").alias("part"), "cand", "x", "y", "exclusion"), mine)
        bad = got.where("status LIKE 'error%'").select("status").first()
        if bad:
            raise RuntimeError(bad[0])
        used = F.coalesce(F.col("conflict_factor"), F.lit(0.0)) * F.lit(factor or 0.0)
        new = got.where("cand IS NOT NULL").select("problem", "cand", used.alias("factor")).groupBy("problem", "cand").agg(F.min("factor").alias("factor"))
        chosen = cut(chosen.unionByName(reach.join(new, ["problem", "cand"]).select(*chosen.columns)))

    for colour in range(4):
        add(left(edges.where(F.col("colour") == colour)), 1.0)
    for factor in LADDER[1:]:
        rest = cut(left(edges))
        if rest.isEmpty():
            break
        # what is left stands in few places: parts of it have nothing in common
        apart = parts(rest.select("problem", "test", F.col("tx").alias("x"), F.col("ty").alias("y"), "required_radius").distinct(), rest.select("problem", "exclusion"))
        add(rest.drop("tile").join(apart.select("problem", "test", F.xxhash64("problem", "part").alias("tile")), ["problem", "test"]), factor)
    chosen = _spare(edges, chosen)
    cover = edges.join(chosen.select("problem", "cand"), ["problem", "cand"], "left_semi").groupBy(*key).agg(F.countDistinct("test").alias("covered"))
    counts = every.groupBy(*key).agg(F.countDistinct("test").alias("tests"), F.countDistinct(F.when(F.col("cand").isNotNull(), F.col("test"))).alias("coverable"))
    used = chosen.groupBy(*key).agg(F.count("*").alias("m"), F.min("factor").alias("factor"))
    bound = dual_bounds(edges, used.select(*key, "m"), config)
    facts = counts.join(cover, key, "left").join(used, key, "left").join(bound, key, "left").fillna(0, ["covered", "m", "lower_bound"])
    status = F.when((F.col("m") == F.col("lower_bound")) & (F.col("covered") == F.col("coverable")), "optimal").otherwise("feasible")
    facts = facts.select(*key, status.alias("status"), F.when(F.lit(not free) & (F.col("factor") > 0), F.col("factor")).alias("conflict_factor"), "tests", "coverable", "covered", F.col("lower_bound").cast("long").alias("lower_bound"))
    return chosen.select(*key, "cand", "x", "y").join(facts, key).select(*[f.split()[0] for f in RESULT.split(", ")])


def _spare(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen without sites whose tests others cover as well: in rounds, of spare ones that share a test only that of fewest tests goes."""
    while True:
        own = edges.select("problem", "test", "cand").join(chosen.select("problem", "cand"), ["problem", "cand"], "left_semi")
        per = own.groupBy("problem", "test").agg(F.count("*").alias("n"))
        each = own.join(per, ["problem", "test"]).groupBy("problem", "cand").agg(F.min("n").alias("least"), F.count("*").alias("tests"))
        spare = cut(each.where("least > 1").select("problem", "cand", F.struct("tests", "cand").alias("rank")))
        if spare.isEmpty():
            return chosen
        met = own.join(spare, ["problem", "cand"])
        first = met.groupBy("problem", "test").agg(F.min("rank").alias("first"))
        gone = met.join(first, ["problem", "test"]).groupBy("problem", "cand").agg(F.bool_and(F.col("rank") == F.col("first")).alias("all")).where("all").select("problem", "cand")
        chosen = cut(chosen.join(gone, ["problem", "cand"], "left_anti"))


def dual_bounds(edges: DataFrame, upper: DataFrame, config: SolverConfig = SolverConfig(), rounds: int = SHARES) -> DataFrame:
    """problem, part and lower_bound, added up over tiles: of the sites that any cover of all coverable tests needs.

    edges: problem, part, tile, test, cand; upper: problem, part, m (a known cover). A candidate costs 1 over all
    its tiles; at first by the tests it has in each, then by its multipliers there. The best round counts.
    """
    key = ["problem", "part"]
    own = edges.select(*key, "tile", "test", "cand")
    weight = own.groupBy(*key, "tile", "cand").agg(F.count("*").cast("double").alias("weight"))
    best = None
    for _ in range(rounds):
        total = weight.groupBy(*key, "cand").agg(F.sum("weight").alias("all"), F.count("*").alias("tiles"))
        share = F.when(F.col("all") > 0, F.col("weight") / F.col("all")).otherwise(1 / F.col("tiles"))
        shares = weight.join(total, [*key, "cand"]).select(*key, "tile", "cand", share.alias("cost"))
        sizes = own.groupBy(*key, "tile").agg(F.countDistinct("test").alias("t"))
        goal = sizes.join(sizes.groupBy(*key).agg(F.sum("t").alias("all")), key).join(upper, key).select(*key, "tile", (F.col("m") * F.col("t") / F.col("all")).alias("upper"))
        rows = own.join(shares, [*key, "tile", "cand"]).join(goal, [*key, "tile"])

        def run(table: pa.Table) -> pa.Table:
            cands, c = np.unique(table.column("cand").to_numpy(), return_inverse=True)
            tests, t = np.unique(table.column("test").to_numpy(), return_inverse=True)
            by = np.lexsort((t, c))
            p = Problem(np.split(t[by], np.searchsorted(c[by], np.arange(1, len(cands)))), len(tests), None)
            cost = np.zeros(len(cands))
            cost[c] = table.column("cost").to_numpy()
            value, _, u, _ = p.dual(config.dual_steps, max(1, ceil(table.column("upper")[0].as_py()) + 1), cost)
            n = len(cands)
            head = [pa.array([table.column(k)[0].as_py()] * n, pa.int64()) for k in (*key, "tile")]
            return pa.table([*head, pa.array(cands), pa.array(np.bincount(p.of_cand, u[p.of_test], n)), pa.array([value] * n)], names=[*key, "tile", "cand", "weight", "value"])

        got = cut(rows.groupBy(*key, "tile").applyInArrow(run, "problem long, part long, tile long, cand long, weight double, value double"))
        value = got.select(*key, "tile", "value").distinct().groupBy(*key).agg(F.ceil(F.sum("value") - 1e-6).alias("lower_bound"))
        best = value if best is None else best.unionByName(value)
        weight = got.drop("value")
    return best.groupBy(*key).agg(F.max("lower_bound").alias("lower_bound"))


def place_once(tests: DataFrame, candidates: DataFrame, max_radius: float, config: SolverConfig = SolverConfig(), max_edges: int = MAX_EDGES) -> DataFrame:
    """place_sites, with problems of equal tests and candidates solved once and handed to all of them (M5, M6, K7).

    Equality is that of the multisets of tests and of candidates, ids included.
    """
    rows = tests.select("problem", F.lit(0).alias("kind"), F.col("test").alias("id"), "x", "y", F.col("required_radius").alias("r")).unionByName(candidates.select("problem", F.lit(1).alias("kind"), F.col("cand").alias("id"), "x", "y", F.col("exclusion").alias("r")))
    same = cut(once(rows, ["kind", "id", "x", "y", "r"]))
    one = same.where("problem = representative").select("problem")
    solved = place_sites(tests.join(one, "problem", "left_semi"), candidates.join(one, "problem", "left_semi"), max_radius, config, max_edges)
    return same.join(solved.withColumnRenamed("problem", "representative"), "representative").drop("representative").select(*[f.split()[0] for f in RESULT.split(", ")])


def totals(solved: DataFrame) -> DataFrame:
    """One row per problem of what its parts came to: selected, tests, coverable, covered, lower_bound, the least conflict factor (null if a part went without conflicts), the distinct statuses."""
    per = solved.groupBy("problem", "part").agg(F.count("cand").alias("selected"), *[F.first(c).alias(c) for c in ("status", "conflict_factor", "tests", "coverable", "covered", "lower_bound")])
    sums = [F.sum(c).alias(c) for c in ("selected", "tests", "coverable", "covered", "lower_bound")]
    return per.groupBy("problem").agg(F.count("*").alias("parts"), *sums, F.when(F.bool_and(F.col("conflict_factor").isNotNull()), F.min("conflict_factor")).alias("conflict_factor"), F.array_join(F.array_sort(F.collect_set("status")), ",").alias("status"))


def once(problems: DataFrame, digest: list[str], problem: str = "problem") -> DataFrame:
    """problem and the least problem of equal content; content is a multiset of rows, compared by 128 bits of hash sums (M5, M6)."""
    row = F.xxhash64(*digest)
    other = F.xxhash64(*digest, F.lit(1))
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    parts = [low(row), low(F.shiftrightunsigned(row, 32)), low(other), low(F.shiftrightunsigned(other, 32))]
    sums = problems.groupBy(problem).agg(*[F.sum(p).alias(f"h{i}") for i, p in enumerate(parts)], F.count("*").alias("n"))
    return sums.join(sums.groupBy("n", "h0", "h1", "h2", "h3").agg(F.min(problem).alias("representative")), ["n", "h0", "h1", "h2", "h3"]).select(problem, "representative")


def greedy_area(cover: pd.DataFrame, cell_m2: float, radius: float, config: SolverConfig) -> pd.DataFrame:
    """Candidates by remaining covered area until the gain is too small (K8). cover: cand, cell."""
    by_cand = {int(c): set(g.tolist()) for c, g in cover.groupby("cand")["cell"]}
    least = max(config.min_gain_m2, config.min_gain_pct / 100 * np.pi * radius * radius)
    out, step = [], 0
    while True:
        best = max(sorted(by_cand), key=lambda c: len(by_cand[c]), default=None)
        if best is None or len(by_cand[best]) * cell_m2 < least:
            break
        gone = by_cand.pop(best)
        out.append((best, step, len(gone) * cell_m2))
        step += 1
        for c in by_cand:
            by_cand[c] -= gone
    return pd.DataFrame(out, columns=["cand", "step", "gain_m2"])


def greedy_cover(cover: DataFrame, cell_m2: float | str, radius: float, config: SolverConfig = SolverConfig()) -> DataFrame:
    """problem, cand, step and gain_m2 of the greedy cover of each problem's cells. cover: problem, cand, cell; cell_m2: a number, or a column that is the same within a problem."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        area = float(pdf[cell_m2].iloc[0]) if isinstance(cell_m2, str) else cell_m2
        return greedy_area(pdf, area, radius, config).assign(problem=key[0])[["problem", "cand", "step", "gain_m2"]]

    return cover.groupBy("problem").applyInPandas(run, "problem long, cand long, step int, gain_m2 double")
