"""Random walks with restart and heat diffusion over adjacency cells adj(i, j, w)."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.blas import one_thread
from strata.functions.scores import unit_weights
from strata.operators.graph import adjacency, walk_matrix
from strata.tables import release, settle, workers_see_package

#: Nodes up to which a dense matrix is built; 8 n^2 bytes.
MOST_DENSE = 6000
#: Nodes of a block whose vectors are worked on side by side, and numbers that such a block may have; blocks of a task.
BLOCK, GATHERED, BLOCKS_A_TASK = 64, 2_000_000, 4
#: Numbers of a block's rows that are worked on at once, and neighbours beyond which a row is summed by itself.
CACHED, WIDE = 65_536, 64


def restart_similarity_iterative(spark: SparkSession, adj: DataFrame, beta: float, steps: int = 1) -> DataFrame:
    """(i, j, p) after so many steps of P <- (1 - beta) W P + beta I from P = I; joins only, for sparse networks of any size."""
    walk = settle(spark, walk_matrix(adj), "walk")
    unit = settle(spark, adj.select(F.explode(F.array("i", "j")).alias("i")).distinct().select("i", F.col("i").alias("j"), F.lit(1.0).alias("p")), "unit")
    p = unit
    w = walk.select(F.col("i"), F.col("j").alias("k"), "w")
    for _ in range(steps):
        moved = w.join(p.select(F.col("i").alias("k"), "j", "p"), "k").groupBy("i", "j").agg(((1 - beta) * F.sum(F.col("w") * F.col("p"))).alias("p"))
        p = settle(spark, moved.unionByName(unit.select("i", "j", (beta * F.col("p")).alias("p"))).groupBy("i", "j").agg(F.sum("p").alias("p")), "step")
    return p


def dense(adj: DataFrame) -> tuple[list, np.ndarray]:
    """Names of rows in order, and the matrix; refused beyond MOST_DENSE nodes, before anything is collected."""
    n = adj.select(F.explode(F.array("i", "j")).alias("i")).distinct().count()
    if n > MOST_DENSE:
        raise MemoryError(f"{n} nodes make a dense matrix of {8 * n * n / 1e9:.1f} GB; use the iterative form")
    cells = adj.toPandas()
    names = sorted({*cells["i"], *cells["j"]})
    place = {x: k for k, x in enumerate(names)}
    out = np.zeros((n, n))
    out[cells["i"].map(place).to_numpy(int), cells["j"].map(place).to_numpy(int)] = cells["w"]
    return names, out


def walk_of(a: np.ndarray) -> np.ndarray:
    d = a.sum(0)
    return a / np.where(d > 0, d, 1.0)


def restart_matrix(a: np.ndarray, beta: float) -> np.ndarray:
    """beta (I - (1 - beta) W)^-1."""
    eye = np.eye(len(a))
    with one_thread():
        return beta * np.linalg.solve(eye - (1 - beta) * walk_of(a), eye)


def heat_matrix(a: np.ndarray, t: float) -> np.ndarray:
    """exp(-t L) of a symmetric network."""
    with one_thread():
        values, vectors = np.linalg.eigh(np.diag(a.sum(0)) - a)
        return (vectors * np.exp(-t * values)) @ vectors.T


def long_form(spark: SparkSession, names: list, matrix: np.ndarray) -> DataFrame:
    """(i, j, p) of a dense matrix; rows travel packed and are unpacked by the executors, columns get their names by a join."""
    kind = "bigint" if not names or isinstance(names[0], (int, np.integer)) else "string"
    packed = spark.createDataFrame([(names[k], row.tolist()) for k, row in enumerate(matrix)], f"i {kind}, p array<double>")
    of = spark.createDataFrame([*enumerate(names)], f"k int, j {kind}")  # a name a row of the matrix
    return packed.select("i", F.posexplode("p").alias("k", "p")).join(F.broadcast(of), "k").select("i", "j", "p")


def balance(a: np.ndarray, beta: float, limit: float = 1.0) -> float:
    """Mass of the similarity on cells of the network less the mass off it, the diagonal left out."""
    p = restart_matrix(a, beta)
    np.fill_diagonal(p, 0.0)
    return float(p[a >= limit].sum() - p[a < limit].sum())


def balance_of(similarity: DataFrame, adj: DataFrame, limit: float = 1.0) -> DataFrame:
    """The same from tables (i, j, p) and (i, j, w): one row, `balance`."""
    both = similarity.where("i <> j").join(adj, ["i", "j"], "left")
    return both.agg(F.sum(F.when(F.coalesce("w", F.lit(0.0)) >= limit, F.col("p")).otherwise(-F.col("p"))).alias("balance"))


def ridder(f: Callable[[float], float], low: float, high: float, tolerance: float, most_rounds: int = 100) -> float:
    """A root of f between low and high by Ridders' method (C. Ridders, 1979).

    With f at both ends and in the middle, an exponential factor that makes the three values lie on a line gives the next
    point: middle + (middle - low) * sign(f_low - f_high) * f_middle / sqrt(f_middle^2 - f_low f_high). Steps stay half the
    tolerance inside the interval, so that it shrinks from both sides; it ends when it is narrower than the tolerance.
    """
    f_low, f_high = f(low), f(high)
    if not f_low or not f_high:
        return low if not f_low else high
    if f_low * f_high > 0:
        raise ValueError("no change of sign")
    slack = tolerance
    for _ in range(most_rounds):
        reach = (high - low) / 2
        middle = low + reach
        f_middle = f(middle)
        move = reach * f_middle / math.sqrt(f_middle * f_middle - f_low * f_high)  # reach is negative where the interval is held the other way round
        move = math.copysign(min(abs(move), abs(reach) - slack / 2), move if f_high >= f_low else -move)
        point = middle - move
        f_point = f(point)
        ends = [(low, f_low), (middle, f_middle), (high, f_high)]
        if f_middle * f_point < 0:
            (low, f_low), (high, f_high) = (point, f_point), ends[1]
        elif f_low * f_point < 0:
            high, f_high = point, f_point
        else:
            low, f_low = point, f_point
        slack = tolerance + 4 * np.finfo(float).eps * point
        if not f_point or abs(high - low) < slack:
            return point
    raise ValueError("no root found")


def balanced_beta(a: np.ndarray, limit: float = 1.0, digits: int = 2) -> float:
    """The restart probability at which the balance is zero; 0.5, with a warning, where there is none."""
    return _root(lambda b: balance(a, b, limit), digits)


def _root(f: Callable[[float], float], digits: int) -> float:
    least = 0.1**digits
    try:
        return ridder(f, least, 1 - least, 0.1 ** (digits + 1))
    except (ValueError, np.linalg.LinAlgError, ZeroDivisionError) as e:
        warnings.warn(f"beta is set to 0.5: {e}", UserWarning, stacklevel=3)
        return 0.5


def balanced_beta_of(spark: SparkSession, adj: DataFrame, digits: int = 2) -> float:
    """balanced_beta() of an undirected network of weight 1, from its cells (i, j, w); no matrix, so networks of any size that a worker can list.

    Of a symmetric 0/1 matrix A with degrees d, P = (1 - beta) P W + beta I and A P = W D P give the mass on the network by
    the diagonal of P alone: trace(A P) = sum of d (P_jj - beta) / (1 - beta). All columns of P sum to one, which gives the rest.
    P_jj = beta e (I - (1 - beta) S)^-1 e, with S = D^-1/2 A D^-1/2 and e of node j. Only sums over j are needed: sums of
    e T_k(S / bound) e, see `moments`, give them for every beta as the series of 1 / (1 - c x) in Chebyshev polynomials T_k.
    The eigenvalue 1 of each component, whose vector is known, is taken out of the sums and added as it is.
    """
    cells = settle(spark, adj.select("i", "j", "w"), "cells")
    start, near, names = _listed(cells)
    release(cells)
    degree, root = np.diff(start).astype(float), _components(len(names), np.repeat(np.arange(len(names)), np.diff(start)), near)
    bound = bounds(start, near, root)
    loop = np.zeros(len(names))
    loop[near[near == np.repeat(np.arange(len(names)), np.diff(start))]] = 1
    share = degree / np.bincount(root, degree, len(names))[root]  # of the eigenvalue 1
    atoms = {at: np.array([share[own].sum(), share[own] @ degree[own], share[own] @ loop[own]]) for at in np.unique(bound) for own in [bound == at]}
    found = moments(spark, start, near, root, bound, 0.1**digits).toPandas()
    bulk = {}
    for at, rows in found.groupby("bound"):
        rows = rows.sort_values("k")
        bulk[at] = rows[["one", "degree", "loop"]].to_numpy() - np.cosh(rows["k"].to_numpy() * math.acosh(1 / at))[:, None] * atoms[at]

    def f(beta: float) -> float:
        own = on = 0.0
        for at, sums in bulk.items():
            q, root = _series((1 - beta) * at)
            series = 2 * q ** np.arange(len(sums)) / root
            series[0] /= 2
            p, p_degree, p_loop = beta * (series @ sums) + atoms[at]
            own, on = own + p, on + p_degree / (1 - beta) - p_loop
        return 2 * (on - beta * degree.sum() / (1 - beta)) - (len(names) - own)

    return _root(f, digits)


def _listed(cells: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours of node k: near[start[k]:start[k + 1]], in order; nodes of one component are numbered in a row. Refused if not 0/1 and symmetric."""
    table = cells.toPandas()
    codes, names = pd.factorize(np.concatenate([table["i"].to_numpy(), table["j"].to_numpy()]), sort=True)
    n = len(names)
    i, j = codes[: len(table)].astype(np.int64), codes[len(table) :].astype(np.int64)
    key = np.sort(i * n + j)
    if (table["w"].to_numpy(float) != 1).any() or (key[1:] == key[:-1]).any() or (key != np.sort(j * n + i)).any():
        raise ValueError("an undirected network of weight 1 is needed")
    order = np.argsort(_components(n, *np.divmod(key, max(n, 1))), kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    key = np.sort(place[i] * n + place[j])
    start = np.searchsorted(key, np.arange(n + 1) * n)
    return start, (key % max(n, 1)).astype(np.int32), names[order]


def _components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least node of each node's component; cells both ways, in order of i, at least one a node."""
    root = np.arange(n)
    while n:
        low = np.minimum(root, np.minimum.reduceat(root[j], np.searchsorted(i, np.arange(n))))
        np.minimum.at(low, root, low.copy())  # what a node has found, its root has found
        low = low[low]
        if (low == root).all():
            break
        root = low
    return root


def bounds(start: np.ndarray, near: np.ndarray, root: np.ndarray, rounds: int = 300) -> np.ndarray:
    """For each node, a bound of what is left of its component's eigenvalues without 1: powers on one vector a component, and 2 % more, in hundredths.

    An eigenvalue beyond the bound does no harm but that its own series ends later.
    """
    if not len(root):
        return np.zeros(0)
    first, component = np.unique(root, return_inverse=True)
    degree = np.diff(start).astype(float)
    top, scale = np.sqrt(degree), 1 / np.sqrt(degree)
    whole = np.add.reduceat(degree, first)
    y = np.random.default_rng(0).standard_normal(len(root))
    for _ in range(rounds):
        y -= top * (np.add.reduceat(top * y, first) / whole)[component]
        norm = np.sqrt(np.add.reduceat(y * y, first))[component]
        y /= np.where(norm > 1e-12, norm, 1.0)
        y = scale * np.add.reduceat((scale * y)[near], start[:-1])
    left = np.sqrt(np.add.reduceat(y * y, first))
    return np.clip(np.ceil(102 * left) / 100, 0.5, 1.0)[component]


def _series(a: float) -> tuple[float, float]:
    """1 / (1 - a x) is the sum of 2 q^k T_k(x) / root, the first term halved."""
    root = math.sqrt(1 - a * a)
    return (1 - root) / a, root


def steps(bound: float, least: float, tolerance: float = 1e-6) -> int:
    """Steps k after which the terms beyond T_2k add up to less than the tolerance at the least beta, where they fall slowest."""
    q, root = _series((1 - least) * bound)
    return max(1, math.ceil(math.log(tolerance * (1 - q) * root / 2, q) / 2))


class Neighbours:
    """Sums over neighbours for the rows of a matrix, which stand in order of falling degree: a neighbour at a time for rows that have few, a row at a time for others."""

    def __init__(self, start: np.ndarray, near: np.ndarray):
        degree = np.diff(start)
        order = np.argsort(-degree, kind="stable")
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.degree, first = degree[order].astype(float), start[:-1][order]
        self.wide = int((degree > WIDE).sum())
        self.rows = [self.place[near[first[k] : first[k] + degree[order[k]]]] for k in range(self.wide)]
        ends = [int((degree > s).sum()) for s in range(min(WIDE, degree.max()))]
        self.slots = [self.place[near[first[self.wide : end] + s]] for s, end in enumerate(ends)]

    def sums(self, x: np.ndarray, a: int, b: int, out: np.ndarray, room: np.ndarray) -> None:
        """Rows a to b, all wide or none."""
        if b <= self.wide:
            for k in range(a, b):
                x[self.rows[k]].sum(0, out=out[k - a])
            return
        a, b = a - self.wide, b - self.wide
        np.take(x, self.slots[0][a:b], axis=0, out=out, mode="clip")
        for slot in self.slots[1:]:
            part = slot[a:b]
            if not len(part):
                break
            out[: len(part)] += np.take(x, part, axis=0, out=room[: len(part)], mode="clip")

    def moments(self, columns: np.ndarray, bound: float, most: int) -> np.ndarray:
        """e T_k(S / bound) e for k = 0 ... 2 most, a row each, and the unit vectors e of these columns.

        From V_k = T_k e come T_2k = 2 T_k T_k - 1 and T_2k+1 = 2 T_k T_k+1 - T_1. The rows of V are held divided by the root
        of their degree, and the columns times it, so that a step is V_k+1 = (2 / bound) D^-1 A V_k - V_k-1.
        """
        n, width = len(self.degree), len(columns)
        at = self.place[columns]
        now, then = np.zeros((n, width)), np.zeros((n, width))
        now[at, np.arange(width)] = 1
        size = max(1, CACHED // width)
        cuts = [*range(0, self.wide, size), *range(self.wide, n, size), n]
        out, room = np.empty((size, width)), np.empty((size, width))
        found = np.empty((2 * most + 1, width))
        found[0] = 1
        for k in range(most):
            scale = ((2 if k else 1) / (bound * self.degree))[:, None]
            same, cross = np.zeros(width), np.zeros(width)
            for a, b in zip(cuts, cuts[1:]):
                t, y, d = out[: b - a], then[a:b], self.degree[a:b]
                self.sums(now, a, b, t, room)
                t *= scale[a:b]
                np.subtract(t, y, out=y)
                same += d @ np.multiply(y, y, out=t)
                cross += d @ np.multiply(y, now[a:b], out=t)
            cross, same = cross / self.degree[at], same / self.degree[at]
            found[2 * k + 1] = 2 * cross - found[1] if k else cross
            found[2 * k + 2] = 2 * same - 1
            now, then = then, now
        return found


def moments(spark: SparkSession, start: np.ndarray, near: np.ndarray, root: np.ndarray, bound: np.ndarray, least: float) -> DataFrame:
    """(bound, k, one, degree, loop): sums of e T_k(S / bound) e over all nodes of a bound, and of it times degree and times loops.

    The network's list is broadcast; a block of nodes needs its components' rows only.
    """
    workers_see_package(spark)
    n = len(start) - 1
    shared = spark.sparkContext.broadcast((start, near, root.astype(np.int32), bound))
    blocks = -(-n // BLOCK)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, near, root, bound = shared.value
        kept = None, None
        for batch in batches:
            for block in batch["id"]:
                a, b = block * BLOCK, min(n, (block + 1) * BLOCK)
                first, end = root[a], np.searchsorted(root, root[b - 1], "right")
                if kept[0] != (first, end):
                    kept = (first, end), Neighbours(start[first : end + 1] - start[first], near[start[first] : start[end]] - first)
                width = max(1, GATHERED // int(end - first))
                for at in np.unique(bound[a:b]):
                    nodes = a + np.flatnonzero(bound[a:b] == at)
                    for part in np.split(nodes, range(width, len(nodes), width)):
                        found = kept[1].moments(part - first, at, steps(at, least))
                        loop = np.array([j in near[start[j] : start[j + 1]] for j in part], float)
                        yield pd.DataFrame({"bound": at, "k": np.arange(len(found)), "one": found.sum(1), "degree": found @ (start[part + 1] - start[part]), "loop": found @ loop})

    made = spark.range(0, blocks, 1, max(1, -(-blocks // BLOCKS_A_TASK))).mapInPandas(work, "bound double, k int, one double, degree double, loop double")
    return made.groupBy("bound", "k").agg(*(F.sum(c).alias(c) for c in ("one", "degree", "loop")))


def similarity(spark: SparkSession, edges: DataFrame, directed: bool = False, beta: float | None = None, limit: float = 1.0, digits: int = 2, use_edge_weights: bool = False) -> tuple[list, np.ndarray, float]:
    """Names of rows, similarity matrix and restart probability of a network that fits a dense matrix."""
    if beta is not None and not 0 < beta < 1:
        raise ValueError("beta must lie between 0 and 1")
    names, a = dense(adjacency(edges if use_edge_weights else unit_weights(edges), directed))
    beta = balanced_beta(a, limit, digits) if beta is None else beta
    return names, restart_matrix(a, beta), beta
