"""The rounds of boosting on rows whose columns are cut into bins once, for fits of many rounds.

A round of MLlib's own trees samples the rows for its bins, plans a dozen jobs and scores the rows with a model; hundreds of rounds
are mostly that. Here the columns are cut at fixed thresholds and kept as a byte or two a value. A level of a tree is the sums of gradient
and curvature by node, column and bin: the split with the largest gain G^2/H is taken, and the sums are the leaves' Newton steps too.

Rows of one task's size are fitted in that task, all rounds in one job. More rows lie in pieces of that size in the executors' cache, and each level is
one job that adds up the pieces' sums; the driver sees sums and trees only. Both ways find the same trees, up to the order of floating sums.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.session import ensure_checkpoint_dir, write_through

#: Values (rows times columns) of a piece, a byte each, or two with more than 256 bins.
PIECE = 8_000_000
#: Rounds between two passes that bring the margins of the pieces up to date, and passes between two that write them.
ADVANCED_EVERY, WRITTEN_EVERY = 8, 8


@dataclass(frozen=True)
class Options:
    """What the rounds need to know beside the rows; see boosting.grow."""

    depth: int
    step: float
    least_rows: int
    share: float
    least: float
    seed: int
    intercept: float


@dataclass
class Tree:
    """Nodes as lists, children next to each other; `left` is -1 where a node is a leaf. Rows whose code is at most `code` go left."""

    column: list = field(default_factory=lambda: [-1])
    code: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [0.0])

    def routed(self, codes: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The leaf of each row, from the node that it had reached."""
        left, column, code = np.array(self.left), np.array(self.column), np.array(self.code)
        while True:
            down = np.flatnonzero(left[node] >= 0)
            if not len(down):
                return node
            at = node[down]
            node = node.copy()
            node[down] = left[at] + (codes[column[at], down] > code[at])

    def split(self, sums: np.ndarray, first: int, least_rows: int) -> bool:
        """Split the nodes from `first` on by the sums of (gradient, curvature, rows) x column x node x bin; false if none was.
        Rows are counted where a leaf needs more than one, see Piece.sums."""
        before = np.cumsum(sums, axis=3)[..., :-1]
        after = np.cumsum(sums[..., ::-1], axis=3)[..., ::-1][..., 1:]  # summed from that end: an empty side is zero
        total = sums[:, 0].sum(axis=2)
        (gl, hl), (gr, hr) = before[:2], after[:2]
        allowed = (hl > 0) & (hr > 0)
        if least_rows > 1:
            allowed &= (before[2] >= least_rows) & (after[2] >= least_rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            whole = np.where(total[1] > 0, total[0] ** 2 / total[1], 0.0)
            gain = np.where(allowed, gl**2 / hl + gr**2 / hr - whole[None, :, None], -np.inf)
        bins = gain.shape[2]
        flat = gain.transpose(1, 0, 2).reshape(gain.shape[1], -1)
        best = flat.argmax(axis=1)
        found = False
        for k in range(len(best)):
            node = first + k
            if not flat[k, best[k]] > 1e-12 * max(whole[k], 1e-12):
                continue
            found, column, code = True, best[k] // bins, best[k] % bins
            self.column[node], self.code[node], self.left[node] = int(column), int(code), len(self.left)
            for g, h in ((gl, hl), (gr, hr)):
                self.column.append(-1), self.code.append(0), self.left.append(-1)
                self.value.append(float(g[column, k, code] / h[column, k, code]))
        return found


class Piece:
    """Some of the rows: codes by column, counts, weights, margins, and the hashes by which a round draws its share."""

    def __init__(self, codes, y, w, draws, margin=None):
        self.codes, self.y, self.w, self.draws = codes, y, w, draws
        self.margin = np.zeros(len(y)) if margin is None else margin
        self.begun = None  # round, with its gradients, curvatures and the nodes reached

    def after(self, trees: list[Tree], step: float) -> Piece:
        margin = self.margin
        for tree in trees:
            margin = margin + step * np.array(tree.value)[tree.routed(self.codes, np.zeros(len(margin), np.int64))]
        return Piece(self.codes, self.y, self.w, self.draws, margin)

    def sums(self, k: int, tree: Tree, first: int, widths: list[int], options: Options) -> np.ndarray:
        """Sums of gradient and curvature, and of rows if a leaf needs more than one, of round k by column, node from `first` on, and bin."""
        if self.begun is None or self.begun[0] != k:
            mu = np.exp(self.margin + options.intercept)
            held = np.maximum(mu, options.least)
            self.begun = (k, self.w * (self.y - mu), self.w * held, np.zeros(len(mu), np.int64), self._drawn(options, k))
        _, g, h, node, drawn = self.begun
        node = tree.routed(self.codes, node)
        self.begun = (k, g, h, node, drawn)
        rows = np.flatnonzero(drawn & (node >= first)) if options.share < 1 or (node < first).any() else None
        at, codes = node - first, self.codes
        if rows is not None:
            at, codes, g, h = at[rows], codes[:, rows], g[rows], h[rows]
        nodes, bins = len(tree.left) - first, max(widths)
        out = np.zeros((2 + (options.least_rows > 1), len(widths), nodes, bins))
        at = at * bins
        for j, width in enumerate(widths):
            if width == 1 and j:  # no split there; the first column gives the totals
                continue
            keys = at + codes[j]
            out[0, j] = np.bincount(keys, g, nodes * bins).reshape(nodes, bins)
            out[1, j] = np.bincount(keys, h, nodes * bins).reshape(nodes, bins)
            if options.least_rows > 1:
                out[2, j] = np.bincount(keys, minlength=nodes * bins).reshape(nodes, bins)
        return out

    def _drawn(self, options: Options, k: int) -> np.ndarray:
        if options.share >= 1:
            return np.ones(len(self.y), bool)
        with np.errstate(over="ignore"):  # splitmix64 of the row's hash and the round
            z = self.draws.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (options.seed + k + 1)) % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
        return z % np.uint64(1000) < np.uint64(int(1000 * options.share))


def _tree(k: int, depth: int, least_rows: int, sums) -> Tree:
    """The tree of round k; `sums(k, tree, first)` are the sums of all rows."""
    tree, first = Tree(), 0
    for level in range(max(depth, 1)):
        size, found = len(tree.left), sums(k, tree, first)
        if level == 0:
            g, h = found[:2, 0].sum(axis=(1, 2))
            tree.value[0] = float(g / h) if h > 0 else 0.0
        if depth == 0 or not tree.split(found, first, least_rows):
            break
        first = size
    return tree


def _pieces(cuts: list):
    """Turns rows into one Piece a partition."""

    def run(batches):
        kept = []
        for batch in batches:
            if batch.num_rows:
                values = batch.column("a").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                kind = np.uint8 if max(map(len, cuts)) < 256 else np.uint16
                codes = np.stack([np.searchsorted(c, values[:, j], "left").astype(kind) for j, c in enumerate(cuts)])
                kept.append((codes, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "draw"))))
        if kept:
            parts = [np.concatenate(p, axis=p[0].ndim - 1) for p in zip(*kept)]
            yield pa.RecordBatch.from_pydict({"piece": pa.array([pickle.dumps(Piece(*parts))], pa.binary())})

    return run


def _alone(rounds: int, widths: list[int], options: Options):
    """All rounds on the only piece."""

    def run(batches):
        for batch in batches:
            for held in batch.column("piece"):
                piece, trees = pickle.loads(held.as_py()), []
                for k in range(rounds):
                    tree = _tree(k, options.depth, options.least_rows, lambda *at: piece.sums(*at, widths, options))
                    trees.append(tree)
                    node = tree.routed(piece.codes, piece.begun[3])
                    piece.margin = piece.margin + options.step * np.array(tree.value)[node]
                yield pa.RecordBatch.from_pydict({"trees": pa.array([pickle.dumps(trees)], pa.binary())})

    return run


def thresholds(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Where each column is cut: between all of its values if they are at most `bins`, else at as many quantiles less one."""
    values = [F.get("a", F.lit(j)) for j in range(width)]
    counted = rows.agg(*[F.approx_count_distinct(v).alias(f"c{j}") for j, v in enumerate(values)]).first()
    few = [counted[j] <= 2 * bins for j in range(width)]
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    found = rows.agg(
        *[F.percentile_approx(v, shares, 10000).alias(f"q{j}") for j, v in enumerate(values)],
        *[F.collect_set(v).alias(f"v{j}") for j, v in enumerate(values) if few[j]],
    ).first()
    cuts = []
    for j in range(width):
        own = np.unique(np.array(found[f"v{j}"], float)) if few[j] else None
        if own is not None and len(own[~np.isnan(own)]) <= bins:
            middle = (own[:-1] + own[1:]) / 2
            made = np.where(middle < own[1:], middle, own[:-1])
        else:
            made = np.unique(np.array(found[f"q{j}"], float))
        cuts.append(made[~np.isnan(made)])
    return cuts


def grow(table: DataFrame, width: int, rounds: int, bins: int, options: Options) -> tuple[list[Tree], list[np.ndarray]]:
    """Trees of all rounds and the thresholds that their codes stand for; `table` has features, y and w."""
    draw = F.lit(0).cast("long") if options.share >= 1 else F.xxhash64(F.col("features").cast("string"), "y")
    rows = table.select(vector_to_array("features").alias("a"), "y", "w", draw.alias("draw"))
    cuts = thresholds(rows, width, bins)
    widths = [len(c) + 1 for c in cuts]
    count = -(-table.count() * width // PIECE)
    pieces = (rows.coalesce(1) if count <= 1 else rows.repartition(count)).mapInArrow(_pieces(cuts), "piece binary")
    if count <= 1:
        made = pieces.mapInArrow(_alone(rounds, widths, options), "trees binary").collect()[0]
        return pickle.loads(made["trees"]), cuts
    return _together(write_through(pieces), rounds, widths, options), cuts


def _together(written: DataFrame, rounds: int, widths: list[int], options: Options) -> list[Tree]:
    """All rounds on pieces in the executors' cache, a job for each level."""
    ensure_checkpoint_dir(written.sparkSession)
    cached = StorageLevel.MEMORY_AND_DISK
    pieces = written.rdd.map(lambda row: pickle.loads(row["piece"])).persist(cached)
    trees, new = [], []

    def sums(k, tree, first):
        step, recent = options.step, list(new)
        return pieces.map(lambda p: p.after(recent, step).sums(k, tree, first, widths, options)).treeReduce(np.add)

    for k in range(rounds):
        tree = _tree(k, options.depth, options.least_rows, sums)
        trees.append(tree)
        new.append(tree)
        if len(new) == ADVANCED_EVERY:
            done, step = list(new), options.step
            later = pieces.map(lambda p, done=done: p.after(done, step)).persist(cached)
            if (k + 1) % (ADVANCED_EVERY * WRITTEN_EVERY) == 0:  # the lineage ends there
                later.checkpoint()
            later.count()
            pieces.unpersist()
            pieces, new = later, []
    pieces.unpersist()
    return trees
