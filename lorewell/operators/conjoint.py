"""Best-first search of a module's grid: the N heaviest consistent cases, each as a collection or as an individual.

A column of the grid is a queue of assertions by weight; a column with a parent is its fallback and begins below it. A case grows
row by row from a seed cell and keeps what isn't disjoint with what it holds to be true; assertions of constrained relations bring
their constraints in as truths. Nothing is sampled or cut: `most` is the number of cases asked for, None gives all.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.stores import written
from .consistency import each_module, neighbours, own_pairs, shared

COLLECTION, INDIVIDUAL = "COLLECTION", "INDIVIDUAL"
#: Collections are never preferred at equal standing.
BIAS = 0.0001
EITHER, ISA, GENLS = "isaGenls", "isa", "genls"
TOP, ANY_COLLECTION, FIRST_ORDER = "Thing", "Collection", "FirstOrderCollection"


class Cell(NamedTuple):
    relation: str
    arg: str
    weight: float
    position: int = 1


@dataclass
class Queue:
    """A column: its cells from row `start` on, and the column that it is a fallback of (-1: none)."""

    start: int
    cells: list[Cell]
    parent: int = -1

    def at(self, y: int) -> Cell | None:
        return self.cells[y - self.start] if self.start <= y < self.start + len(self.cells) else None


class Grid:
    def __init__(self, queues: list[Queue], disjoint: Iterable[tuple[str, str]] | Mapping[str, set[str]], constraints: dict[tuple[str, int], tuple[tuple[str, str], ...]] | None = None, base: float = 1.0):
        self.queues = queues
        self.apart = disjoint if isinstance(disjoint, Mapping) else neighbours(disjoint)
        self.constraints = constraints or {}
        self.total = base + sum(q.cells[0].weight for q in queues if q.parent < 0 and q.cells)
        self.above = [self._chain(x) for x in range(len(queues))]
        self.below = [[z for z in range(len(queues)) if x in self.above[z]] for x in range(len(queues))]

    def _chain(self, x: int) -> list[int]:
        out = []
        while (x := self.queues[x].parent) >= 0 and x not in out:
            out.append(x)
        return out

    def clashes(self, term: str, truths: set[str]) -> bool:
        return not self.apart.get(term, frozenset()).isdisjoint(truths)


@dataclass
class Case:
    kind: str
    factor: float
    isa: set[str]
    genls: set[str]
    row: int = 0
    weight: float = 0.0
    closed: set[int] = field(default_factory=set)
    found: list[tuple[str, str]] = field(default_factory=list)
    seed: tuple[str, str] | None = None

    def potential(self, g: Grid) -> float:
        """Share of the weight that the case has or may still get in its row, by its standing."""
        rest = sum(c.weight for x, q in enumerate(g.queues) if x not in self.closed and (c := q.at(self.row)))
        return (self.weight + rest) / g.total * self.factor

    def complete(self, g: Grid) -> bool:
        return self.row > 0 and all(x in self.closed or q.at(self.row - 1) is None for x, q in enumerate(g.queues))

    def add(self, relation: str, arg: str) -> None:
        if (relation, arg) not in self.found:
            self.found.append((relation, arg))

    def reading(self, g: Grid, c: Cell) -> str | None:
        """What a cell says in this case: genls, isa, its own relation, or None where it contradicts the case."""
        if c.relation not in (EITHER, ISA, GENLS):
            given = g.constraints.get((c.relation, c.position), ())
            return None if any(g.clashes(t, self.genls if k == GENLS else self.isa) for k, t in given) else c.relation
        if self.kind == COLLECTION and c.relation != ISA and not g.clashes(c.arg, self.genls):
            return GENLS
        if (c.relation == ISA or (c.relation == EITHER and self.kind == INDIVIDUAL)) and not g.clashes(c.arg, self.isa):
            return ISA
        return None

    def take(self, g: Grid, x: int, y: int, used: set[tuple[int, int]]) -> bool:
        """Takes cell (x, y) if it is consistent, and cells of the same weight right below it; True if the first was taken."""
        first = y
        while (c := g.queues[x].at(y)) and (y == first or c.weight == g.queues[x].at(y - 1).weight):
            how = self.reading(g, c)
            if how is None:
                break
            for kind, term in g.constraints.get((c.relation, c.position), ()) if how == c.relation and how not in (ISA, GENLS) else ():
                (self.genls if kind == GENLS else self.isa).add(term)
                if term != TOP:
                    self.add(kind, term)
            if how == GENLS:
                self.genls.add(c.arg)
                self.isa.add(FIRST_ORDER)
            elif how == ISA:
                self.isa.add(c.arg)
            used.add((x, y))
            if x not in self.closed:
                self.weight += c.weight
                self.closed.update((x, *g.below[x], *g.above[x]))
                used.update((z, r) for z in g.below[x] for r in range(g.queues[z].start, g.queues[z].start + len(g.queues[z].cells)))
            self.add(how, c.arg)
            y += 1
        return y > first


def heaviest(g: Grid, ind: float = 1.0, coll: float = 1.0, isa: Iterable[str] = (), genls: Iterable[str] = (), most: int | None = 1) -> list[tuple[str, float, tuple[str, str], list[tuple[str, str]]]]:
    """[(kind, weight, seed, assertions)] of the first `most` cases that complete, the most promising case growing first."""
    isa, genls = set(isa), set(genls)
    best = max(ind, coll)
    factors = ((INDIVIDUAL, min(ind / best, 1.0) if best else 0.0), (COLLECTION, (min(coll / best, 1.0) if best else 0.0) - BIAS))
    seeds = sorted(((-c.weight, y, x) for x, q in enumerate(g.queues) for y, c in enumerate(q.cells, q.start)), reverse=True)
    used: set[tuple[int, int]] = set()
    serial = itertools.count()
    heap: list[tuple[float, int, int, int, Case]] = []
    out: list = []

    def push(case: Case) -> None:
        heapq.heappush(heap, (-case.potential(g), -len(case.closed), case.row, next(serial), case))

    while most is None or len(out) < most:
        while seeds and (seeds[-1][2], seeds[-1][1]) in used:
            seeds.pop()
        if seeds and (not heap or -seeds[-1][0] > -heap[0][0]):
            _, y, x = seeds.pop()
            used.add((x, y))
            for kind, factor in factors:
                if factor <= 0 or (kind == COLLECTION and g.clashes(ANY_COLLECTION, isa)):
                    continue
                case = Case(kind, factor, set(isa), set(genls))
                if case.take(g, x, y, used):
                    case.seed = case.found[-1]
                    push(case)
        if not heap:
            if not seeds:
                break
            continue
        case = heapq.heappop(heap)[-1]
        for x in range(len(g.queues)):
            if x not in case.closed and g.queues[x].at(case.row):
                case.take(g, x, case.row, used)
        case.row += 1
        if case.complete(g):
            out.append((case.kind, min(case.potential(g), 1.0), case.seed, case.found))
        else:
            push(case)
    return out


def cases(cells: DataFrame, disjoint: DataFrame, constraints: DataFrame | None = None, truths: DataFrame | None = None, standing: DataFrame | None = None, most: int | None = 1, base: float = 1.0) -> DataFrame:
    """(module, place, kind, weight, seed, assertions): the heaviest consistent cases of each module.

    cells (module, x, y, parent, relation, arg, weight, position); parent is the column that x is a fallback of, or null. disjoint
    (a, b) in one order or both; constraints (relation, position, kind, term) with kind isa or genls; truths (module, kind, term);
    standing (module, ind, coll). Up to consistency.SHARED disjoint pairs are held by every task; beyond that the pairs that a
    module's own terms need travel with it, and constraints always do, so that nothing in a task grows with the ontology.
    """
    cells = cells.select("module", "x", "y", "parent", "relation", "arg", "weight", "position")
    apart = shared(disjoint)
    if apart is None or constraints is not None:
        # The grid is met up to four times below; its plan is run once.
        cells = written(cells, "cells")
    one = cells.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("x", "y", "parent", "relation", "arg", "weight", "position"))).alias("cells"))
    bound = told = None
    if constraints is not None:
        bound = cells.select("module", "relation", "position").distinct().join(constraints.select("relation", "position", "kind", "term").distinct(), ["relation", "position"])
        one = one.join(bound.groupBy("module").agg(F.collect_set(F.struct("relation", "position", "kind", "term")).alias("rules")), "module", "left")
    if truths is not None:
        told = truths.select("module", "kind", "term").distinct()
        one = one.join(told.groupBy("module").agg(F.collect_set(F.struct("kind", "term")).alias("told")), "module", "left")
    if standing is not None:
        one = one.join(standing.select("module", "ind", "coll"), "module", "left")
    if apart is None:
        terms = cells.filter(F.col("relation").isin(EITHER, ISA, GENLS)).select("module", F.col("arg").alias("t"))
        for more in (bound, told):
            terms = terms if more is None else terms.union(more.select("module", "term"))
        terms = terms.union(cells.select("module", F.explode(F.array(F.lit(ANY_COLLECTION), F.lit(FIRST_ORDER)))))
        one = one.join(own_pairs(terms.distinct(), disjoint), "module", "left")

    def search(m: dict) -> list:
        places = {x: i for i, x in enumerate(dict.fromkeys(c["x"] for c in m["cells"]))}
        queues: list[Queue] = []
        for c in m["cells"]:
            if places[c["x"]] == len(queues):
                queues.append(Queue(c["y"], [], places.get(c["parent"], -1)))
            queues[-1].cells.append(Cell(c["relation"], c["arg"], c["weight"], c["position"]))
        rules: dict = {}
        for r in sorted((r["relation"], r["position"], r["kind"], r["term"]) for r in m.get("rules") or ()):
            rules[r[:2]] = (*rules.get(r[:2], ()), r[2:])
        near = neighbours((q["a"], q["b"]) for q in m.get("pairs") or ()) if apart is None else apart
        known = [(t["kind"], t["term"]) for t in m.get("told") or ()]
        ind, coll = (1.0 if v is None or v != v else v for v in (m.get("ind"), m.get("coll")))
        return heaviest(Grid(queues, near, rules, base), ind, coll, [t for k, t in known if k != GENLS], [t for k, t in known if k == GENLS], most)

    def run(batches):
        for some in each_module(batches):
            rows = [{"module": m["module"], "place": i, "kind": k, "weight": w, "seed": " ".join(s), "assertions": [{"relation": r, "arg": a} for r, a in found]} for m in some for i, (k, w, s, found) in enumerate(search(m))]
            yield pa.RecordBatch.from_pylist(rows, schema)

    kind = cells.schema["module"].dataType
    pair = pa.list_(pa.struct([("relation", pa.string()), ("arg", pa.string())]))
    schema = pa.schema([("module", to_arrow_type(kind)), ("place", pa.int32()), ("kind", pa.string()), ("weight", pa.float64()), ("seed", pa.string()), ("assertions", pair)])
    return one.mapInArrow(run, f"module {kind.simpleString()}, place int, kind string, weight double, seed string, assertions array<struct<relation:string,arg:string>>")
