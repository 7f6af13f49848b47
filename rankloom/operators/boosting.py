"""Boosted trees of many settings, grown side by side.

Settings that differ only in their number of rounds share one model: it holds that of every
smaller number. All models of a group take their next tree in the same pass over the rows,
so the passes do not grow with the number of settings.

Up to ``LOCAL_ROWS`` rows, or ``HELD_ROWS`` where the models keep the tasks busy, each model is grown
in a task of its own, all rounds in one job. Above, a tree grows from the top by one short job per
level: each task adds up the gradients of its rows per node, input and bin, the driver adds up those
sums (whose size goes by nodes and tasks, not by rows) and takes each node's split. Gradients are
whole numbers, so sums and trees do not depend on the order or the partitioning of the rows, nor on
which way a tree was grown.

Rows carry their bins and, for each model, the margin of some rounds ago; later trees, which
are small, go to the tasks. Only sums, trees and bin edges come to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.sources.writers import stage

BINS = 32
#: Rows up to which a model is grown in one task, some 120 bytes a row: where models are few, and where
#: there are models for half the tasks that run at once or more.
LOCAL_ROWS, HELD_ROWS = 500_000, 4_000_000
#: Rows of a task's share below which it is not cut further, and that are added up at once.
PARTITION_ROWS = 50_000
#: Nodes of all models whose sums a job is about: 13 KB a node with 17 inputs, before compression.
NODES_AT_ONCE = 256
#: Bits of an input's bins, and of the joint numbers of several inputs' bins.
INPUT_BITS, JOINT_BITS = (BINS - 1).bit_length(), 2 * (BINS - 1).bit_length()
#: Rows of a task that are worked on at once, so that they stay in the processor's cache.
CHUNK_ROWS = 1 << 16
#: Rounds after which margins are written to the rows.
STATE_ROUNDS = 10
#: Models that are grown side by side.
AT_ONCE = 16

#: Whole units of a gradient.
UNIT = float(1 << 20)
LAMBDA = 1.0
MIN_GAIN = 1e-6

_NODES = "series long, node long, feature long, cut long, gain double, value double, left_value double, right_value double, left_n long, right_n long"
_NODE_NAMES = [f.split()[0] for f in _NODES.split(", ")]


@dataclass
class Tree:
    """Nodes by number: 1 is the root, 2i and 2i + 1 are the children of i."""

    feature: np.ndarray  # -1 where there is no split
    cut: np.ndarray  # rows with a bin above it go to the right
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def unsplit(cls, size: int = 2) -> Tree:
        return cls(np.full(size, -1, np.int16), np.zeros(size, np.uint8), np.zeros(size), np.zeros(size))

    def place(self, row) -> None:
        """Take over a node as the jobs return it."""
        node = row["node"]
        while len(self.feature) <= 2 * node + 1:
            self.feature = np.concatenate([self.feature, np.full(len(self.feature), -1, np.int16)])
            self.cut, self.value, self.gain = (np.concatenate([x, np.zeros_like(x)]) for x in (self.cut, self.value, self.gain))
        self.value[node] = row["value"]
        if row["feature"] >= 0:
            self.feature[node], self.cut[node], self.gain[node] = row["feature"], row["cut"], row["gain"]
            self.value[2 * node], self.value[2 * node + 1] = row["left_value"], row["right_value"]

    def put(self, level: dict[str, np.ndarray]) -> None:
        """``place`` for many nodes, as arrays; parents come before their children."""
        size, most = len(self.feature), 2 * int(level["node"].max(initial=0)) + 2
        if most > size:
            self.feature = np.append(self.feature, np.full(most - size, -1, np.int16))
            self.cut, self.value, self.gain = (np.append(x, np.zeros(most - size, x.dtype)) for x in (self.cut, self.value, self.gain))
        self.value[level["node"]] = level["value"]
        inner = level["feature"] >= 0
        node, *found = (level[k][inner] for k in ("node", "feature", "cut", "gain", "left_value", "right_value"))
        self.feature[node], self.cut[node], self.gain[node], self.value[2 * node], self.value[2 * node + 1] = found

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node in which each row ends."""
        inner, own = self.feature >= 0, np.arange(len(self.feature))
        # Input, cut and left child of a node as one number; where there is no split, a row stays.
        steps = np.maximum(self.feature, 0) | np.where(inner, self.cut, 255).astype(np.int64) << 16 | np.where(inner, 2 * own, own) << 24
        flat, start = np.ascontiguousarray(bins).reshape(-1), np.arange(len(bins)) * bins.shape[1]
        node = np.ones(len(bins), np.int64)
        for _ in range(int(own[inner].max(initial=0)).bit_length()):
            step = steps[node]
            node = (step >> 24) + (flat[start + (step & 0xFFFF)] > (step >> 16 & 255))
        return node

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]


@dataclass
class BoostedTrees:
    """A fitted model: its settings, the edges of the inputs' bins, and its trees."""

    settings: dict
    inputs: list[str]
    edges: list[list[float]]
    trees: list[Tree] = field(default_factory=list)

    def first(self, rounds: int) -> BoostedTrees:
        """The model of fewer rounds."""
        return BoostedTrees({**self.settings, "n_estimators": rounds}, self.inputs, self.edges, self.trees[:rounds])

    def importance(self) -> dict[str, float]:
        """Mean gain of each input's splits, scaled to add up to 1."""
        total, count = np.zeros(len(self.inputs)), np.zeros(len(self.inputs))
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(total, tree.feature[inner], tree.gain[inner])
            np.add.at(count, tree.feature[inner], 1)
        mean = total / np.maximum(count, 1)
        return dict(zip(self.inputs, (mean / (mean.sum() or 1.0)).tolist()))

    def to_rows(self) -> list[tuple]:
        """(tree, node, input, threshold, gain, value) of all nodes in use."""
        rows = []
        for t, tree in enumerate(self.trees):
            inner = np.flatnonzero(tree.feature >= 0)
            for node in sorted({1, *(2 * inner).tolist(), *(2 * inner + 1).tolist()}):
                f = int(tree.feature[node])
                threshold = float(self.edges[f][int(tree.cut[node])]) if f >= 0 else None
                rows.append((t, node, self.inputs[f] if f >= 0 else None, threshold, float(tree.gain[node]), float(tree.value[node])))
        return rows


def bin_edges(rows: DataFrame, inputs: list[str], bins: int = BINS) -> list[list[float]]:
    """The inner edges of at most ``bins`` evenly filled bins per input, from one pass.

    Up to 10,000 rows they are exact; beyond, ranks are off by a ten-thousandth at most."""
    at = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(c), at, 10_000).alias(c) for c in inputs]).first()
    return [sorted({float(x) for x in found[c] or [] if x is not None and x == x}) for c in inputs]


def to_bins(batch: pa.RecordBatch, inputs: list[str], edges: list[list[float]]) -> np.ndarray:
    """Bins of a batch, a column per input; missing numbers are above all others."""
    bins = np.zeros((batch.num_rows, len(inputs)), np.uint8)
    for i, name in enumerate(inputs):
        values = batch.column(name).to_numpy(zero_copy_only=False).astype(np.float64)
        bins[:, i] = np.searchsorted(np.array(edges[i]), values, "left")
    return bins


def _binned(inputs: list[str], edges: list[list[float]], series: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, n = to_bins(batch, inputs, edges), batch.num_rows
            nothing = pa.array([bytes(8 * series)] * n, pa.binary())
            packed = pa.array([r.tobytes() for r in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("label"), packed, nothing], ["draw", "label", "bins", "margins"])

    return run


_STATE = "draw long, label int, bins binary, margins binary"


def _matrix(column: pa.Array, kind, n: int) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset :]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[n]].view(kind).reshape(n, -1)


def _margins(batch: pa.RecordBatch, recent: list[list[Tree]]) -> tuple[np.ndarray, np.ndarray]:
    """Bins, and margins with the trees that the rows do not know of yet."""
    bins = _matrix(batch.column("bins"), np.uint8, batch.num_rows)
    margins = _matrix(batch.column("margins"), np.float64, batch.num_rows).copy()
    for s, trees in enumerate(recent):
        for tree in trees:
            margins[:, s] += tree.scores(bins)
    return bins, margins


def _with_margins(recent: list[list[Tree]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = pa.array([r.tobytes() for r in _margins(batch, recent)[1]], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("draw", "label", "bins")), margins], ["draw", "label", "bins", "margins"])

    return run


def uniform(draw: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number from 0 to 1 for each row and round, from the row's own 64 bits."""
    with np.errstate(over="ignore"):
        x = draw.astype(np.int64).view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


def chosen_inputs(setting: dict, turn: int, n: int) -> np.ndarray:
    """Which inputs the tree of a round may use."""
    order = np.random.default_rng([setting["random_state"], turn]).permutation(n)
    mask = np.zeros(n, bool)
    mask[order[: max(1, int(setting["colsample_bytree"] * n))]] = True
    return mask


def gradients(label: np.ndarray, margin: np.ndarray, positive_weight: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted logistic loss, in whole units."""
    p, weight = 1 / (1 + np.exp(-margin)), np.where(label == 1, positive_weight, 1.0)
    first, second = (p - label) * weight, np.maximum(p * (1 - p), 1e-16) * weight
    return np.rint(first * UNIT).astype(np.int64), np.rint(second * UNIT).astype(np.int64)


def best_splits(sums: np.ndarray, mask: np.ndarray, setting: dict) -> dict[str, np.ndarray]:
    """The best split of each slot of a histogram (feature -1 for none), ties to the first input and cut."""
    left = sums.cumsum(2)[:, :, :-1]
    whole = sums[:, :1].sum(2)[:, :, None]  # every input sees all rows
    right = whole - left
    score = lambda x: (x[..., 1] / UNIT) ** 2 / (x[..., 2] / UNIT + LAMBDA)
    gain = score(left) + score(right) - score(whole)
    least = setting["min_child_weight"] * UNIT
    fine = (left[..., 2] >= least) & (right[..., 2] >= least) & (left[..., 0] > 0) & (right[..., 0] > 0) & mask[None, :, None]
    gain = np.where(fine, gain, -np.inf).reshape(len(sums), -1)
    best, rows = gain.argmax(1), np.arange(len(sums))
    gain = gain[rows, best]
    split = gain > MIN_GAIN
    feature, cut = np.divmod(best, BINS - 1)
    leaf = lambda x: -setting["learning_rate"] * (x[:, 1] / UNIT) / (x[:, 2] / UNIT + LAMBDA)
    whole, left, right = whole[:, 0, 0], left[rows, feature, cut], right[rows, feature, cut]
    return {
        "feature": np.where(split, feature, -1), "cut": np.where(split, cut, 0), "gain": np.where(split, gain, 0.0),
        "value": leaf(whole), "left_value": leaf(left), "right_value": leaf(right), "left_n": left[:, 0], "right_n": right[:, 0],
    }


def _node_rows(series: int, found: dict[str, np.ndarray]) -> pa.Table:
    columns = {"series": np.full(len(found["node"]), series), **found}
    return pa.table({n: pa.array(columns[n], pa.float64() if n in ("gain", "value", "left_value", "right_value") else pa.int64()) for n in _NODE_NAMES})


@dataclass
class _Turn:
    """What the tasks of a job have to know of a round."""

    settings: list[dict]
    masks: list[np.ndarray]
    number: int
    recent: list[list[Tree]]
    partial: list[Tree]
    nodes: list[list[int]]  # by series: the nodes that the job is about

    def rows(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """(series, node, bins, gradients) of the rows in the job's nodes."""
        bins, margins = _margins(batch, self.recent)
        label = batch.column("label").to_numpy(zero_copy_only=False)
        draw = batch.column("draw").to_numpy(zero_copy_only=False)
        taken: dict[tuple, np.ndarray] = {}
        for s, setting in enumerate(self.settings):
            if not self.nodes[s]:
                continue
            part = (setting["random_state"], setting["subsample"])
            if part not in taken:
                taken[part] = uniform(draw, part[0], self.number) < part[1]
            node = self.partial[s].nodes(bins)
            own = np.flatnonzero(taken[part] & np.isin(node, self.nodes[s]))
            first, second = gradients(label[own], margins[own, s], setting["scale_pos_weight"])
            yield s, node[own], bins[own], first, second


def _sums(bins: np.ndarray, slot: np.ndarray, slots: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """``histogram`` of bins that stand input by input, with gradients as doubles."""
    sums = np.zeros((slots, len(bins), BINS, 3), np.int64)
    for i, own in enumerate(bins):
        at = slot * BINS + own
        for k, weights in enumerate((None, first, second)):
            sums[:, i, :, k] = np.bincount(at, weights, slots * BINS).reshape(slots, BINS)
    return sums


def split_table(sums: np.ndarray, nodes, used: np.ndarray, setting: dict) -> dict[str, np.ndarray]:
    """``best_splits`` of the nodes that have rows, from sums of the ``used`` inputs alone."""
    splits = best_splits(sums, np.ones(len(used), bool), setting)
    splits["feature"] = np.where(splits["feature"] < 0, -1, used[splits["feature"]])
    held = sums[:, 0, :, 0].sum(1) > 0
    return {k: v[held] for k, v in {"node": np.asarray(nodes), **splits}.items()}


def _each(table: dict[str, np.ndarray]) -> Iterator[dict]:
    return (dict(zip(table, values)) for values in zip(*(v.tolist() for v in table.values())))


def _filled(widths: list[int], limit: int) -> list[list[int]]:
    """Lists of places whose widths add up to ``limit`` at most, the widest first."""
    lists, free = [], []
    for i in sorted(range(len(widths)), key=lambda i: -widths[i]):
        at = next((k for k, left in enumerate(free) if left >= widths[i]), len(lists))
        if at == len(lists):
            lists, free = [*lists, []], [*free, limit]
        lists[at].append(i)
        free[at] -= widths[i]
    return lists


@dataclass
class _Field:
    """Bits of a joint number that are counted together, and the inputs in them."""

    group: int
    shift: int
    bits: int
    inputs: list[tuple[int, int, int]]  # place, shift within the field, bits


def _fields(widths: list[int]) -> tuple[list[list[tuple[int, int]]], list[_Field], list[_Field]]:
    """How bins of the given bits make joint numbers: (place, shift) by number, fields that are whole
    numbers, and fields no wider than one input."""
    numbers, wide, narrow = [], [], []
    own = _filled(widths, INPUT_BITS)
    for g, some in enumerate(_filled([sum(widths[i] for i in f) for f in own], JOINT_BITS)):
        number, inputs, shift = [], [], 0
        for f in some:
            begin, held = shift, []
            for i in own[f]:
                held.append((i, shift - begin, widths[i]))
                inputs.append((i, shift, widths[i]))
                number.append((i, shift))
                shift += widths[i]
            narrow.append(_Field(g, begin, shift - begin, held))
        numbers.append(number)
        wide.append(_Field(g, 0, shift, inputs))
    return numbers, wide, narrow


def _slices_of(n: int) -> Iterator[slice]:
    return (slice(a, min(a + CHUNK_ROWS, n)) for a in range(0, n, CHUNK_ROWS))


def _node_sums(codes: list[np.ndarray], fields: list[_Field], inputs: int, weights: tuple, ends: np.ndarray) -> np.ndarray:
    """Sums (node, input, bin, 3) of rows that stand node by node, between two ends each."""
    n, start = len(ends) - 1, int(ends[0])
    tables = [np.zeros((3, n << f.bits)) for f in fields]
    for part in _slices_of(int(ends[-1]) - start):
        a, b = part.start + start, part.stop + start
        low, high = np.searchsorted(ends, [a, b - 1], "right") - 1
        slot = np.repeat(np.arange(high - low + 1), np.diff(np.clip(ends[low : high + 2], a, b)))
        own = [None, *(w[a:b] for w in weights)]
        for f, table in zip(fields, tables):
            at = (slot << f.bits) + ((codes[f.group][a:b] >> f.shift) & ((1 << f.bits) - 1))
            size = int(high - low + 1) << f.bits
            for k, w in enumerate(own):
                table[k, low << f.bits : (low << f.bits) + size] += np.bincount(at, w, size)
    sums = np.zeros((n, inputs, BINS, 3), np.int64)
    for f, table in zip(fields, tables):
        for place, shift, bits in f.inputs:
            sums[:, place, : 1 << bits] = table.reshape(3, n, -1, 1 << bits, 1 << shift).sum((2, 4)).transpose(1, 2, 0)
    return sums


def _levels(setting: dict, used: np.ndarray, bins: np.ndarray, widths: list[int], label: np.ndarray, margin: np.ndarray, rows: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """Nodes of a tree out of the given rows, level by level; adds the tree to these rows' margins.

    Rows stand node by node. Of two children that go on, the smaller one is counted and the other
    one is what the parent has left: whole numbers, so the sums are the same. Inputs are counted by
    two or more at a time, as one joint number, where nodes have enough rows."""
    numbers, wide, narrow = _fields([widths[i] for i in used])
    place_of = {used[i]: (g, shift, (1 << widths[used[i]]) - 1) for g, number in enumerate(numbers) for i, shift in number}
    codes = []
    for number in numbers:
        code = np.zeros(len(label), np.uint16)
        for i, shift in number:
            code |= bins[used[i]].astype(np.uint16) << shift
        codes.append(code[rows])
    first, second = np.zeros(len(rows)), np.zeros(len(rows))
    for c in _slices_of(len(rows)):
        first[c], second[c] = gradients(label[rows[c]], margin[rows[c]], setting["scale_pos_weight"])

    def sums_of(at: int, to: int) -> np.ndarray:
        fields = wide if ends[to] - ends[at] >= (to - at) << JOINT_BITS else narrow
        return _node_sums(codes, fields, len(used), (first, second), ends[at : to + 1])

    nodes, ends, counted, parents, left = np.array([1]), np.array([0, len(rows)]), 1, None, []
    while len(nodes) and len(rows):
        if len(nodes) <= NODES_AT_ONCE:
            sums = sums_of(0, counted)
            if left:
                parent, sibling = np.array(left).T
                sums = np.concatenate([sums, parents[parent] - sums[sibling]])
            level, parents = split_table(sums, nodes, used, setting), sums
        else:
            blocks = [(at, min(at + NODES_AT_ONCE, len(nodes))) for at in range(0, len(nodes), NODES_AT_ONCE)]
            found = [split_table(sums_of(at, to), nodes[at:to], used, setting) for at, to in blocks]
            level, parents = {k: np.concatenate([f[k] for f in found]) for k in found[0]}, None
        yield level
        small, large, left = [], [], []
        for i, r in enumerate(_each(level)):
            at, to = int(ends[i]), int(ends[i + 1])
            if r["feature"] < 0:
                margin[rows[at:to]] += r["value"]
                continue
            g, shift, mask = place_of[r["feature"]]
            right = ((codes[g][at:to] >> shift) & mask) > r["cut"]
            on = []
            for child, own, value in ((2 * r["node"], ~right, r["left_value"]), (2 * r["node"] + 1, right, r["right_value"])):
                own = np.flatnonzero(own) + at
                if child < 1 << setting["max_depth"] and len(own) > 1:
                    on.append((child, own))
                else:
                    margin[rows[own]] += value
            if len(on) == 2 and parents is not None:
                on.sort(key=lambda x: len(x[1]))
                left.append((i, len(small)))
                large.append(on.pop())
            small += on
        counted, on = len(small), small + large
        nodes, ends = np.array([child for child, _ in on], np.int64), np.cumsum([0, *(len(own) for _, own in on)])
        if on:
            order = np.concatenate([own for _, own in on])
            rows, first, second, codes = rows[order], first[order], second[order], [c[order] for c in codes]


def grow_rounds(setting: dict, bins: np.ndarray, label: np.ndarray, draw: np.ndarray) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(round, nodes) of a whole model out of all rows, bins standing input by input."""
    margin, n = np.zeros(len(label)), len(label)
    widths = [int(b.max(initial=0)).bit_length() for b in bins]
    for turn in range(int(setting["n_estimators"])):
        used = np.flatnonzero(chosen_inputs(setting, turn, len(bins)))
        drawn, tree = np.zeros(n, bool), Tree.unsplit()
        for c in _slices_of(n):
            drawn[c] = uniform(draw[c], setting["random_state"], turn) < setting["subsample"]
        for level in _levels(setting, used, bins, widths, label, margin, np.flatnonzero(drawn)):
            tree.put(level)
            yield turn, level
        rest = np.flatnonzero(~drawn)
        for c in _slices_of(len(rest)):
            margin[rest[c]] += tree.scores(bins[:, rest[c]].T)


_ROUNDS = f"turn long, {_NODES}"


_BLOCK = "bins binary, label binary, draw binary"


def _as_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a batch as one row: bins input by input, labels and draws."""
    for batch in batches:
        if batch.num_rows:
            bins = _matrix(batch.column("bins"), np.uint8, batch.num_rows).T
            columns = [np.ascontiguousarray(bins), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "draw"))]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["bins", "label", "draw"])


def _held(blocks: list[dict], inputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins input by input, labels and draws of all rows of a task."""
    bins = np.concatenate([np.frombuffer(b["bins"], np.uint8).reshape(inputs, -1) for b in blocks], axis=1)
    return bins, *(np.concatenate([np.frombuffer(b[c], kind) for b in blocks]) for c, kind in (("label", np.int32), ("draw", np.int64)))


def _rounds(series: int, grown: Iterator[tuple[int, dict[str, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    for turn, level in grown:
        nodes = _node_rows(series, level)
        yield from nodes.add_column(0, "turn", pa.array(np.full(nodes.num_rows, turn), pa.int64())).to_batches()


def _grow_one(settings: list[dict], inputs: int):
    """For a task that gets the blocks of one series after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[dict]] = {}
        for batch in batches:
            for block in batch.to_pylist():
                own.setdefault(block["series"], []).append(block)
        for s in sorted(own):
            yield from _rounds(s, grow_rounds(settings[s], *_held(own.pop(s), inputs)))

    return run


def _grow_all(rows: DataFrame, models: list[BoostedTrees]) -> None:
    """All rounds of all models in one job, a task for each model."""
    settings, inputs, n = [m.settings for m in models], len(models[0].inputs), len(models)
    # A row per Arrow batch, so that the copies for each model are few rows.
    blocks = rows.select("bins", "label", "draw").mapInArrow(_as_blocks, _BLOCK)
    each = blocks.select(F.explode(F.array(*[F.lit(s) for s in range(n)])).alias("series"), "*")
    found = each.repartitionById(n, F.col("series")).mapInArrow(_grow_one(settings, inputs), _ROUNDS).toArrow()
    nodes = {c: found.column(c).to_numpy() for c in found.column_names}
    order = np.lexsort([nodes[c] for c in ("node", "turn", "series")])
    nodes = {c: x[order] for c, x in nodes.items()}
    for model in models:
        model.trees.extend(Tree.unsplit() for _ in range(int(model.settings["n_estimators"])))
    begins = np.flatnonzero((np.diff(nodes["series"], prepend=-1) != 0) | (np.diff(nodes["turn"], prepend=-1) != 0))
    for at, to in zip(begins, [*begins[1:], len(order)]):
        models[nodes["series"][at]].trees[nodes["turn"][at]].put({c: x[at:to] for c, x in nodes.items()})


def _together(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``least`` rows or more, the last one aside."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= least:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _add_up(turn: _Turn):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in _together(batches, PARTITION_ROWS):
            for s, node, bins, first, second in turn.rows(batch):
                numbers, used = np.array(turn.nodes[s]), np.flatnonzero(turn.masks[s])
                slot = np.searchsorted(numbers, node)
                own = _sums(np.ascontiguousarray(bins.T[used]), slot, len(numbers), first.astype(float), second.astype(float))
                sums[s] = sums[s] + own if s in sums else own
        packed = pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), packed], ["series", "sums"])

    return run


def _grow(state: DataFrame, turn: _Turn) -> None:
    """One round: a level of all trees per job, or several jobs where a level has many nodes."""
    level = [(s, 1) for s in range(len(turn.settings))]
    while level:
        below = []
        for at in range(0, len(level), NODES_AT_ONCE):
            turn.nodes = [[] for _ in turn.settings]
            for s, node in level[at : at + NODES_AT_ONCE]:
                turn.nodes[s].append(node)
            totals: dict[int, np.ndarray] = {}
            for r in state.mapInArrow(_add_up(turn), "series long, sums binary").collect():
                own = np.frombuffer(zlib.decompress(r["sums"]), np.int64)
                totals[r["series"]] = totals[r["series"]] + own if r["series"] in totals else own
            for s, total in totals.items():
                used = np.flatnonzero(turn.masks[s])
                for r in _each(split_table(total.reshape(-1, len(used), BINS, 3), turn.nodes[s], used, turn.settings[s])):
                    turn.partial[s].place(r)
                    for child, n in ((2 * r["node"], r["left_n"]), (2 * r["node"] + 1, r["right_n"])):
                        if r["feature"] >= 0 and n > 1 and child < 1 << turn.settings[s]["max_depth"]:
                            below.append((s, child))
        level = sorted(below)


def fit_side_by_side(
    rows: DataFrame, inputs: list[str], settings: list[dict], draw: str = "draw", local_rows: int | None = None, at_once: int = AT_ONCE
) -> list[BoostedTrees]:
    """A model per setting, out of rows with ``label`` (0 or 1), a 64-bit number per row that
    decides in which rounds it is drawn, and the inputs as numbers.

    Settings that differ in ``n_estimators`` alone give prefixes of one model. A null label
    counts as 0, a missing input as larger than any number; without rows all trees are
    one leaf of value 0."""
    edges = bin_edges(rows, inputs)
    kinds: dict[tuple, int] = {}
    for setting in settings:
        kind = tuple(sorted((k, v) for k, v in setting.items() if k != "n_estimators"))
        kinds[kind] = max(kinds.get(kind, 0), int(setting["n_estimators"]))
    models = {}
    # Models of equally many rounds side by side, the longest tasks first.
    order = sorted(kinds, key=lambda kind: (-kinds[kind], -dict(kind)["max_depth"]))
    for i in range(0, len(order), at_once):
        some = order[i : i + at_once]
        own = [{**dict(kind), "n_estimators": kinds[kind]} for kind in some]
        models.update(zip(some, _fit_group(rows, inputs, edges, own, draw, local_rows)))
    kind_of: Callable = lambda s: tuple(sorted((k, v) for k, v in s.items() if k != "n_estimators"))
    return [models[kind_of(s)].first(int(s["n_estimators"])) for s in settings]


def _packed(state: DataFrame, total: int) -> DataFrame:
    """No more partitions than hold ``PARTITION_ROWS`` rows each, or than tasks that run at once."""
    partitions = max(1, min(-(-total // PARTITION_ROWS), state.sparkSession.sparkContext.defaultParallelism))
    return state.coalesce(partitions) if partitions < state.rdd.getNumPartitions() else state


def _fit_group(rows, inputs, edges, settings: list[dict], draw: str, local_rows: int | None) -> list[BoostedTrees]:
    models = [BoostedTrees(s, inputs, edges) for s in settings]
    if local_rows is None:
        local_rows = HELD_ROWS if 2 * len(models) >= rows.sparkSession.sparkContext.defaultParallelism else LOCAL_ROWS
    own = rows.select(F.coalesce(F.col(draw).cast("long"), F.lit(0)).alias("draw"), F.coalesce(F.col("label").cast("int"), F.lit(0)).alias("label"), *inputs)
    state = stage(own.mapInArrow(_binned(inputs, edges, len(settings)), _STATE), "boosting-rows")
    total, known = state.count(), 0
    if 0 < total <= local_rows:
        _grow_all(state, models)
        return models
    state = _packed(state, total)
    for turn in range(max(s["n_estimators"] for s in settings)):
        recent = [m.trees[known:] for m in models]
        if turn - known == STATE_ROUNDS:
            state = _packed(stage(state.mapInArrow(_with_margins(recent), _STATE), "boosting-rows"), total)
            known, recent = turn, [[] for _ in models]
        live = [turn < s["n_estimators"] for s in settings]
        masks = [chosen_inputs(s, turn, len(inputs)) for s in settings]
        now = _Turn(settings, masks, turn, recent, [Tree.unsplit() for _ in settings], [])
        if not all(live):  # sorted by rounds: those that are done stand last
            n = sum(live)
            now = _Turn(settings[:n], masks[:n], turn, recent, now.partial[:n], [])
        if total:
            _grow(state, now)
        for model, tree in zip(models, now.partial):
            model.trees.append(tree)
    return models


def probabilities(models: list[BoostedTrees], rounds: list[list[int]], bins: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(model, rounds, probability of label 1) at each of the asked numbers of rounds, from one
    walk through the trees."""
    for m, (model, marks) in enumerate(zip(models, rounds)):
        margin = np.zeros(len(bins))
        for r in range(max(marks, default=-1) + 1):
            if r in marks:
                yield m, r, 1 / (1 + np.exp(-margin))
            if r < len(model.trees):
                margin = margin + model.trees[r].scores(bins)


def score_rounds(rows: DataFrame, keep: list[str], models: list[BoostedTrees], rounds: list[list[int]]) -> DataFrame:
    """(kept columns, model int, rounds int, y_prob) of every row at every asked number of rounds.

    All models share their inputs and bins; the rows are read once."""
    inputs, edges = models[0].inputs, models[0].edges
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, kept = batch.num_rows, [batch.column(c) for c in keep]
            for m, r, p in probabilities(shared.value, rounds, to_bins(batch, inputs, edges)):
                marks = [pa.array(np.full(n, x, np.int32)) for x in (m, r)]
                yield pa.RecordBatch.from_arrays([*kept, *marks, pa.array(p)], [*keep, "model", "rounds", "y_prob"])

    return rows.select(*keep, *[c for c in inputs if c not in keep]).mapInArrow(run, f"{fields}, model int, rounds int, y_prob double")
