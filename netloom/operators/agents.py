"""Agents that walk a lattice by what they see. An agent's walk depends on the lattice and its own random numbers only, so each is simulated whole, in
whatever task it lands, and gate counts are a groupBy afterwards.

Random numbers come from (seed, agent number): results don't depend on partitions, and a lost task repeats its agents' steps exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import lattice as L
from netloom.operators import traverse as V

RULES = ("standard", "weighted", "occlusion_all", "occlusion_45", "occlusion_60", "occlusion_standard", "occlusion_weight_distance", "occlusion_weight_angle", "occlusion_weight_both", "occlusion_memory", "los", "los_occlusion", "directed_los", "gibsonian_length", "gibsonian_flow", "gibsonian_comparative_length", "gibsonian_comparative_flow", "flow2", "evolved")


@dataclass(frozen=True)
class Settings:
    """steps: time steps of the system; rate: agents released a step; life: steps an agent lives; fov: angular bins it sees (of 32); decide: steps between
    decisions; rule: one of RULES; seed; release: refs to start from (all filled cells if empty); program: the genes that the rule evolved follows."""

    steps: int = 100
    rate: float = 0.1
    life: int = 5000
    fov: int = 15
    decide: int = 3
    rule: str = "standard"
    seed: int = 1
    release: tuple[int, ...] = ()
    program: Program | None = None

    def __post_init__(self):
        if self.rule == "evolved" and (self.program is None or len(self.program.genes) != GENES):
            raise ValueError(f"the rule evolved needs a program of {GENES} genes")
        if self.rule not in RULES:
            raise ValueError(f"{self.rule} isn't a rule; there are {', '.join(RULES)}")


def releases(settings: Settings) -> np.ndarray:
    """The step at which each agent starts: Poisson numbers a step."""
    return np.repeat(np.arange(settings.steps), np.random.default_rng(settings.seed).poisson(settings.rate, settings.steps))


class World:
    """What agents know of a lattice: coordinates, what each cell sees by bin, grid neighbours, and occlusion distances by bin.

    Without sight, a cell's is found when an agent looks, at any distance over the walls; without grid, neighbours lie side by side or corner to corner.
    """

    def __init__(self, cells: pd.DataFrame, sight: pd.DataFrame | None, grid: pd.DataFrame | None, occlusions: pd.DataFrame | None, walls: np.ndarray | None = None):
        cells = cells.sort_values("ref")
        self.refs, self.x, self.y = cells["ref"].to_numpy(), cells["x"].to_numpy(float), cells["y"].to_numpy(float)
        self.at = {(int(x), int(y)): i for i, (x, y) in enumerate(zip(self.x, self.y))}
        self.walls = walls
        self.sight = None if sight is None else V.Adjacency(self.refs, sight["src"].to_numpy(), sight["dst"].to_numpy(), bin=sight["bin"].to_numpy(), dist=sight["dist"].to_numpy(float))
        self.steps = None if grid is None else set(zip(np.searchsorted(self.refs, grid["src"]).tolist(), np.searchsorted(self.refs, grid["dst"]).tolist()))
        self.occluded = np.zeros((len(self.refs), 32))
        if occlusions is not None and len(occlusions):
            self.occluded[np.searchsorted(self.refs, occlusions["ref"]), occlusions["bin"]] = occlusions["occ_distance"]

    def seen(self, cell: int, heading: int, fov: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells in the field of view, how many bins each is off the heading, and distances."""
        target, bins, dist = self.sees(cell)
        off = (bins - heading + 16) % 32 - 16
        inside = np.abs(off) <= fov // 2
        return target[inside], off[inside], dist[inside]

    def sees(self, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells seen, their bins and distances."""
        if self.sight is not None:
            lo, hi = self.sight.start[cell], self.sight.start[cell + 1]
            return self.sight.target[lo:hi], self.sight.edge["bin"][lo:hi], self.sight.edge["dist"][lo:hi]
        seen = ~L.hidden(self.x[cell], self.y[cell], self.x, self.y, self.walls)
        seen[cell] = False
        target = np.flatnonzero(seen)
        dx, dy = self.x[target] - self.x[cell], self.y[target] - self.y[cell]
        return target, L.bins_of(dx, dy), np.sqrt(dx * dx + dy * dy)

    def beside(self, a: int, b: int) -> bool:
        if self.steps is not None:
            return (a, b) in self.steps
        return max(abs(self.x[a] - self.x[b]), abs(self.y[a] - self.y[b])) == 1


def _bin(dx: float, dy: float) -> int:
    return int(round(math.atan2(dy, dx) / (2 * math.pi) * 32)) % 32


def evolved_sight(program: Program, fov: int, off: np.ndarray, dist: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Which of the cells in view an evolved agent may head for. Each of four rules watches a band of the view to both sides, the first next to what lies ahead.
    They take turns in the order of the first four genes. A rule fires on a side whose longest sight exceeds a share of itself and the sight ahead (genes five to
    eight), with a chance (the last four); of two such sides one is drawn. If none fires, the agent goes on ahead."""
    order, share, chance = np.reshape(program.genes, (3, 4))
    bands = np.linspace(2, fov // 2 + 1, 5)
    longest = lambda mask: float(dist[mask].max()) if mask.any() else 0.0
    ahead = np.abs(off) < 2
    front = longest(ahead)
    for k in np.argsort(order, kind="stable"):
        sides = [m for m in ((sign * off >= bands[k]) & (sign * off < bands[k + 1]) for sign in (1, -1)) if longest(m) > share[k] * (longest(m) + front)]
        if sides and rng.random() < chance[k]:
            return sides[int(rng.integers(len(sides)))]
    return ahead


def decide(world: World, cell: int, heading: int, s: Settings, rng: np.random.Generator, memory: dict) -> int | None:
    """The cell an agent heads for; None if it sees none."""
    cells, off, dist = world.seen(cell, heading, s.fov)
    if not len(cells):
        cells, off, dist = world.seen(cell, heading, 64)
        if not len(cells):
            return None
    rule = s.rule
    if rule == "standard":
        return int(rng.choice(cells))
    if rule == "weighted":  # what lies ahead counts five times
        w = np.where(np.abs(off) <= 1, 5.0, 1.0)
    elif rule in ("los", "directed_los"):
        w = (dist == _longest(off, dist, rule)).astype(float)
    elif rule.startswith("gibsonian") or rule == "flow2":
        left, right, ahead = dist[off > 1], dist[off < -1], dist[np.abs(off) <= 1]
        size = (lambda d: float(d.max()) if len(d) else 0.0) if "length" in rule else (lambda d: float((1 / d).sum()) if len(d) else 0.0)
        score = {-1: size(right), 0: size(ahead), 1: size(left)}
        if "comparative" in rule:  # only a clear difference turns an agent
            side = max(score, key=lambda k: (score[k], k == 0)) if max(score.values()) > 1.5 * min(score.values()) else 0
        elif rule == "flow2":
            side = min((k for k in score if score[k] > 0), key=lambda k: score[k], default=0)
        else:
            side = max(score, key=lambda k: (score[k], k == 0))
        mine = off > 1 if side == 1 else off < -1 if side == -1 else np.abs(off) <= 1
        w = mine.astype(float) if mine.any() else np.ones(len(cells))
    elif rule == "evolved":
        w = evolved_sight(s.program, s.fov, off, dist, rng).astype(float)
    else:
        occ = world.occluded[cell][(heading + off) % 32]
        w = (occ > 1.5).astype(float)
        if rule == "occlusion_45":
            w *= np.abs(off) <= 4
        elif rule == "occlusion_60":
            w *= np.abs(off) <= 5
        elif rule == "occlusion_standard":
            w *= np.abs(off) <= s.fov // 2
        elif rule == "occlusion_weight_distance":
            w *= occ
        elif rule == "occlusion_weight_angle":
            w *= 1 / (1 + np.abs(off))
        elif rule == "occlusion_weight_both":
            w *= occ / (1 + np.abs(off))
        elif rule == "occlusion_memory":
            w *= np.array([0.2 if int(c) in memory else 1.0 for c in cells])
        elif rule == "los_occlusion" and w.any():
            w *= dist == dist[w > 0].max()
        if not w.any():
            w = np.ones(len(cells))
    if not w.any():
        w = np.ones(len(cells))
    picked = int(rng.choice(cells, p=w / w.sum()))
    memory[picked] = True
    return picked


def _longest(off: np.ndarray, dist: np.ndarray, rule: str) -> float:
    ahead = dist[np.abs(off) <= 2] if rule == "directed_los" else dist
    return float((ahead if len(ahead) else dist).max())


def walk(world: World, agent: int, born: int, s: Settings, starts: np.ndarray) -> list[tuple[int, int]]:
    """(step, cell) of each cell that an agent enters."""
    rng = np.random.default_rng((s.seed, agent))
    cell = int(rng.choice(starts))
    x, y = world.x[cell], world.y[cell]
    heading = int(rng.integers(32))
    vx = vy = 0.0
    out, memory = [], {}
    looked = False
    for step in range(born, min(s.steps, born + s.life)):
        if not looked or rng.random() < 1 / s.decide:
            to = decide(world, cell, heading, s, rng, memory)
            if to is None:
                break
            dx, dy = world.x[to] - x, world.y[to] - y
            length = math.hypot(dx, dy) or 1.0
            vx, vy, looked = dx / length, dy / length, True
            heading = _bin(vx, vy)
        for turn in (0.0, math.pi / 4, -math.pi / 4):  # straight on, else 45 degrees to a side
            c, n = math.cos(turn), math.sin(turn)
            nx, ny = x + vx * c - vy * n, y + vx * n + vy * c
            nxt = world.at.get((math.floor(nx + 0.5), math.floor(ny + 0.5)))
            if nxt is not None and (nxt == cell or world.beside(cell, nxt)):
                break
        else:
            looked = False
            continue
        x, y = nx, ny
        if nxt != cell:
            cell = nxt
            out.append((step, cell))
    return out


def run(cells: DataFrame, sight: DataFrame | None, grid: DataFrame | None, settings: Settings, occlusions: DataFrame | None = None, walls: DataFrame | None = None) -> DataFrame:
    """agent, step, ref: the cells each agent enters. cells: filled ones (ref, x, y); sight: src, dst, bin, dist; grid: src, dst of side-by-side cells;
    occlusions: ref, bin, occ_distance, which occlusion rules need. Without sight agents see at any distance over walls (x1, y1, x2, y2), by need; without grid
    they step between cells side by side or corner to corner."""
    if (sight is None) == (walls is None):
        raise ValueError("agents need either sight or walls")
    if "occlusion" in settings.rule and (occlusions is None or occlusions.filter("occ_distance > 0").isEmpty()):
        raise ValueError("occlusion rules need isovists' occlusion distances")
    if not all(V.is_small(t) for t in (cells, sight, grid, occlusions, walls) if t is not None):
        raise ValueError("the lattice and its visibility graph are too large to send to tasks")
    spark = cells.sparkSession
    table = lambda df, *names: None if df is None else df.select(*names).toPandas()
    ends = None if walls is None else table(walls.dropna(subset=["x1", "y1", "x2", "y2"]), "x1", "y1", "x2", "y2").to_numpy(float)
    world = World(table(cells, "ref", "x", "y"), table(sight, "src", "dst", "bin", "dist"), table(grid, "src", "dst"), table(occlusions, "ref", "bin", "occ_distance"), ends)
    shared = spark.sparkContext.broadcast(world)
    starts = np.searchsorted(world.refs, settings.release) if settings.release else np.arange(len(world.refs))
    born = releases(settings)

    def simulate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for f in frames:
            for agent in f["id"].tolist():
                got = walk(w, agent, int(born[agent]), settings, starts)
                if got:
                    yield pd.DataFrame({"agent": agent, "step": [s for s, _ in got], "ref": w.refs[[c for _, c in got]]})

    return spark.range(len(born)).repartition(max(1, min(len(born), spark.sparkContext.defaultParallelism))).mapInPandas(simulate, "agent long, step long, ref long")


def gate_counts(cells: DataFrame, moves: DataFrame) -> DataFrame:
    """ref, gate_count of each filled cell."""
    n = moves.groupBy("ref").agg(F.count("*").alias("n"))
    return cells.select("ref").join(n, "ref", "left").select("ref", F.coalesce("n", F.lit(0)).alias("gate_count"))


def trails(moves: DataFrame, cells: DataFrame, limit: int | None = None) -> DataFrame:
    """ref (the agent), points (x, y) of its walk; the first `limit` agents only if a limit is given."""
    m = moves if limit is None else moves.filter(F.col("agent") < limit)
    at = m.join(cells.select("ref", "x", "y"), "ref")
    walks = at.groupBy(F.col("agent").alias("ref")).agg(F.sort_array(F.collect_list(F.struct("step", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("w"))  # at most an agent's life
    return walks.select("ref", F.transform("w", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points")).filter(F.size("points") > 1)


#: Genes of a program that drives agents.
GENES = 12


@dataclass
class Program:
    """What the rule evolved follows (see evolved_sight): the order of four rules, their shares and their chances, all between 0 and 1."""

    genes: list[float]
    fitness: float = 0.0


def evolve(population: list[Program], rng: np.random.Generator, mutation: float = 0.05) -> list[Program]:
    """The next generation: parents by rank, crossover gene by gene, mutation of one gene in twenty."""
    ranked = sorted(population, key=lambda p: -p.fitness)
    n = len(ranked)
    chance = np.arange(n, 0, -1, dtype=float)
    chance /= chance.sum()
    out = []
    for _ in range(n):
        a, b = (ranked[i].genes for i in rng.choice(n, 2, p=chance))
        genes = [x if rng.random() < 0.5 else y for x, y in zip(a, b)]
        out.append(Program([float(rng.random()) if rng.random() < mutation else g for g in genes]))
    return out


def save_program(p: Program) -> str:
    return "\n".join(["agent program", *(f"gene {k}: {g!r}" for k, g in enumerate(p.genes)), f"fitness: {p.fitness!r}"])


def load_program(text: str) -> Program:
    lines = dict(x.split(": ") for x in text.splitlines()[1:])
    return Program([float(v) for k, v in lines.items() if k.startswith("gene")], float(lines["fitness"]))
