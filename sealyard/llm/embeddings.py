"""Near-duplicate vectors by dual traversal of cover trees: exact pairs at a cosine threshold.

On the unit sphere a cosine of at least t is a distance of at most sqrt(2 - 2t). The top of the tree is shared:
each label has centres, every vector belongs to the nearest, and a centre knows how far its vectors reach. Two
centres, or a vector and a centre, that are further apart than the reaches and the threshold allow never meet.
What may meet is compared in blocks of bounded size: a task builds the tree below for each side, nested levels
with halving radii, and walks both trees at once; a pair of nodes is dropped when even their closest vectors are
too far apart, taken whole when even the furthest are near enough, and else replaced by pairs of children. Only
counts of links and one link per vector and local group leave a task.

Vectors that are NULL, of norm zero, of another length than their label's centres, or that hold NULL or
non-finite components link with nothing, as do vectors without a label. Rows with equal vec_id and vector are
one vector each: they link with one another like other rows, and share their id's component. Every row gets a
result; no rows give none. Columns other than the three are not carried along.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealyard.llm.common import in_batches, table
from sealyard.llm.components import components
from sealyard.session import materialise

THRESHOLD = 0.93
#: Vectors of a block, about; a centre with more is split over several blocks.
BLOCK = 2048
#: Stands for a NULL id in blocks; no smaller id loses to it.
_NO_ID = 2**63 - 1
#: Vectors below which a node is compared directly.
LEAF = 24
_SLACK = 1e-9


class CoverTree:
    """Nested nodes over the rows of ``x``: ``centre``, ``reach``, ``members``, ``children``."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.centre: list[int] = []
        self.reach: list[float] = []
        self.members: list[np.ndarray] = []
        self.children: list[np.ndarray | None] = []
        if len(x):
            self._node(0, np.arange(len(x)), 2.0)

    def _distance(self, centre: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2.0 - 2.0 * (self.x[members] @ self.x[centre]), 0.0))

    def _node(self, centre: int, members: np.ndarray, radius: float) -> int:
        """Nodes are made with a stack, so depth is no matter."""
        root = self._add(centre, members)
        stack = [(root, radius)]
        while stack:
            node, radius = stack.pop()
            members = self.members[node]
            if len(members) <= LEAF or self.reach[node] <= 1e-7:
                continue
            radius = min(radius, self.reach[node]) / 2  # halving, and no empty levels
            left, children, centre = members, [], self.centre[node]
            while len(left):
                near = self._distance(centre, left) <= radius
                near |= left == centre
                children.append(self._add(centre, left[near]))
                left = left[~near]
                centre = int(left[0]) if len(left) else -1
            self.children[node] = np.array(children)
            stack.extend((child, radius) for child in children)
        return root

    def _add(self, centre: int, members: np.ndarray) -> int:
        self.centre.append(centre)
        self.reach.append(float(self._distance(centre, members).max()))
        self.members.append(members)
        self.children.append(None)
        return len(self.centre) - 1


class _Groups:
    """Union by smallest row."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, rows: np.ndarray) -> None:
        roots = {self.root(int(i)) for i in rows}
        least = min(roots)
        for r in roots:
            self.parent[r] = least


def dual_traversal(one: CoverTree, two: CoverTree, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between the rows of two trees: counts per row of each, and the local group of every row.

    Rows of the second tree are numbered after the first's; with ``same`` both trees are one and each pair counts
    once, a row not with itself.
    """
    shift = 0 if same else len(one.x)
    counts = np.zeros(shift + len(two.x), np.int64)
    groups = _Groups(len(counts))
    limit = float(np.sqrt(2.0 - 2.0 * threshold))
    reach_1, reach_2 = np.array(one.reach), np.array(two.reach)
    centre_1, centre_2 = np.array(one.centre), np.array(two.centre)

    def compare(u: int, v: int) -> None:
        a, b = one.members[u], two.members[v]
        for at in range(0, len(a), 1024):
            linked = (one.x[a[at : at + 1024]] @ two.x[b].T) >= threshold
            if same and u == v:
                linked &= a[at : at + 1024, None] != b[None, :]
                counts[a[at : at + 1024]] += linked.sum(1)
            else:
                counts[a[at : at + 1024]] += linked.sum(1)
                counts[shift + b] += linked.sum(0)
            for i in np.flatnonzero(linked.any(1)):
                groups.join(np.append(shift + b[linked[i]], a[at + i]))

    def take(u: int, v: int) -> None:
        a, b = one.members[u], two.members[v]
        if same and u == v:
            counts[a] += len(a) - 1
        else:
            counts[a] += len(b)
            counts[shift + b] += len(a)
        if not (same and u == v and len(a) == 1):
            groups.join(np.concatenate([a, shift + b]))

    stack = [(0, 0)] if len(one.x) and len(two.x) else []
    while stack:
        u, v = stack.pop()
        a = one.children[u] if one.children[u] is not None else np.array([u])
        b = two.children[v] if two.children[v] is not None else np.array([v])
        if one.children[u] is None and two.children[v] is None:
            compare(u, v)
            continue
        for at in range(0, len(a), 512):
            part = a[at : at + 512]
            gap = np.sqrt(np.maximum(2.0 - 2.0 * (one.x[centre_1[part]] @ two.x[centre_2[b]].T), 0.0))
            reach = reach_1[part][:, None] + reach_2[b][None, :]
            # The root of a difference of like numbers is only good to about 1e-8.
            open_ = gap - reach <= limit + 1e-6
            if same and u == v:
                open_ &= part[:, None] <= b[None, :]
            sure = open_ & (gap + reach <= limit - 1e-6)
            for i, j in zip(*np.nonzero(open_), strict=True):
                (take(int(part[i]), int(b[j])) if sure[i, j] else stack.append((int(part[i]), int(b[j]))))
    return counts, groups.parent, np.array([groups.root(i) for i in range(len(counts))])


def _links_of_block(threshold: float):
    def run(key, pdf):
        import pandas as pd

        first = pdf[pdf.side == 0]
        second = pdf[pdf.side == 1]
        same = key[1:3] == key[3:5]
        if not len(first) or not (same or len(second)):
            none = pd.DataFrame({"row_id": [], "vec_id": [], "n": [], "linked": []}, dtype=np.int64)
            return none.assign(no_id=np.zeros(0, bool))
        tree = CoverTree(np.vstack(first.unit.to_numpy()))
        other = tree if same else CoverTree(np.vstack(second.unit.to_numpy()))
        counts, _, root = dual_traversal(tree, other, same, threshold)
        # Both parts are integers: an empty list beside them would make doubles of all, good to 2 ** 53 only.
        both = [first] if same else [first, second]
        ids, rows, no_id = (np.concatenate([part[name].to_numpy() for part in both]) for name in ("vec_id", "row_id", "no_id"))
        least = pd.Series(ids).groupby(root).transform("min").to_numpy()
        some = counts > 0
        return pd.DataFrame({"row_id": rows[some], "vec_id": ids[some], "n": counts[some], "linked": least[some], "no_id": no_id[some]})

    return run


def _units(df: DataFrame) -> DataFrame:
    """Rows that can link, with a row number of their own and the vector scaled to length one, in doubles."""

    def scale(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, labels, vectors = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for v in vectors:
                unit = None
                if v and None not in v:
                    x = np.array(v, np.float64)
                    # Scaled first by a power of two, so that squares neither overflow nor vanish.
                    top = np.abs(x).max()
                    if np.isfinite(x).all() and top > 0:
                        x = np.ldexp(x, -int(np.frexp(top)[1]))
                        unit = x / np.sqrt((x * x).sum())
                out.append(unit)
            rows = [at + i for i in range(len(ids))]
            at += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(out, pa.list_(pa.float64()))],
                names=["row_id", "vec_id", "label", "unit"],
            )

    typed = df.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col("embedding").cast("array<double>"))
    return in_batches(typed, scale, "row_id bigint, vec_id bigint, label bigint, unit array<double>")


def _nearest(cells: DataFrame, centres: DataFrame) -> DataFrame:
    """``cells`` with the ``cell`` of the nearest centre of its label and the ``gap`` to it."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            label = batch.column(2).to_pylist()
            units = batch.column(3).to_pylist()
            given = batch.column(4)
            cell, gap = [0] * len(label), [0.0] * len(label)
            known: dict = {}
            for i, (name, unit) in enumerate(zip(label, units, strict=True)):
                if name not in known:
                    rows = given[i].as_py()
                    known[name] = np.array(rows, np.float64) if rows else None
                centre = known[name]
                if centre is not None and centre.shape[1] == len(unit):
                    near = centre @ np.array(unit)
                    cell[i] = int(near.argmax())
                    gap[i] = float(np.sqrt(max(0.0, 2.0 - 2.0 * near[cell[i]])))
                else:
                    cell[i], gap[i] = -1 - len(unit), 2.0  # vectors of another length only meet their like
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(cell, pa.int32()), pa.array(gap, pa.float64())],
                names=["row_id", "vec_id", "label", "unit", "cell", "gap"],
            )

    joined = cells.join(centres, "label", "left").select("row_id", "vec_id", "label", "unit", "centres")
    return in_batches(joined, run, "row_id bigint, vec_id bigint, label bigint, unit array<double>, cell int, gap double")


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of all rows of ``df`` (``vec_id``, ``embedding``, ``label``)."""
    limit = float(np.sqrt(2.0 - 2.0 * threshold)) + 1e-6
    rows = materialise(_units(df))
    usable = rows.where("unit is not null and label is not null")
    # One vector in ``block`` is a centre, chosen by hash, so a label has as many as it has blocks.
    centres = (
        usable.where(F.pmod(F.xxhash64("row_id"), F.lit(block)) == 0)
        .withColumn("d", F.size("unit"))
        .groupBy("label", "d").agg(F.collect_list("unit").alias("centres"))
        .groupBy("label").agg(F.max_by("centres", F.size("centres") * 10000 + F.col("d")).alias("centres"))
    )
    placed = materialise(_nearest(usable, centres))
    cells = placed.groupBy("label", "cell").agg(F.count("*").alias("n"), F.max("gap").alias("reach"))
    # A cell of many vectors becomes several blocks of about the bounded size.
    blocks = cells.select(
        "label", "cell", "reach", (F.floor((F.col("n") - 1) / F.lit(block)) + 1).cast("int").alias("parts")
    )
    numbered = placed.join(blocks.drop("reach"), ["label", "cell"]).withColumn(
        "part", F.pmod(F.xxhash64("row_id", F.lit(7)), F.col("parts")).cast("int")
    )
    centre_of = centres.select("label", F.posexplode("centres").alias("cell", "at"))
    nodes = blocks.join(centre_of, ["label", "cell"], "left")
    left = nodes.select("label", *[F.col(c).alias(f"{c}_1") for c in ("cell", "reach", "parts", "at")])
    right = nodes.select("label", *[F.col(c).alias(f"{c}_2") for c in ("cell", "reach", "parts", "at")])
    dot = F.aggregate(F.zip_with("at_1", "at_2", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))
    meet = (F.col("cell_1") == F.col("cell_2")) | (
        (F.col("cell_1") >= 0) & (F.col("cell_2") >= 0) & (apart <= F.col("reach_1") + F.col("reach_2") + limit)
    )
    met = left.join(right, "label").where((F.col("cell_1") <= F.col("cell_2")) & meet)
    part_1 = F.explode(F.sequence(F.lit(0), F.col("parts_1") - 1))
    part_2 = F.explode(F.sequence(F.lit(0), F.col("parts_2") - 1))
    pairs = (
        met.select("label", "cell_1", "cell_2", "parts_2", "at_1", "at_2", "reach_1", "reach_2", part_1.alias("part_1"))
        .select("*", part_2.alias("part_2"))
        .where("cell_1 < cell_2 or part_1 <= part_2")
        .drop("parts_2")
    )
    name = ["label", "cell_1", "part_1", "cell_2", "part_2"]
    one = pairs.select(*name, F.lit(0).alias("side"), F.col("cell_1").alias("cell"), F.col("part_1").alias("part"), F.col("at_2").alias("at"), F.col("reach_2").alias("reach"))
    two = pairs.where("cell_1 < cell_2 or part_1 < part_2").select(
        *name, F.lit(1).alias("side"), F.col("cell_2").alias("cell"), F.col("part_2").alias("part"), F.col("at_1").alias("at"), F.col("reach_1").alias("reach")
    )
    sent = numbered.join(one.unionByName(two), ["label", "cell", "part"])
    # A vector out of the other centre's reach meets none of its vectors.
    to_other = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.aggregate(F.zip_with("unit", "at", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)))
    sent = sent.where((F.col("cell_1") == F.col("cell_2")) | (to_other <= F.col("reach") + limit))
    found = materialise(
        sent.select(
            *name, "side", "row_id", F.col("vec_id").isNull().alias("no_id"),
            # A column with a NULL would reach pandas as doubles.
            F.coalesce("vec_id", F.lit(_NO_ID)).alias("vec_id"), "unit",
        )
        .groupBy(*name)
        .applyInPandas(_links_of_block(threshold), "row_id bigint, vec_id bigint, n bigint, linked bigint, no_id boolean")
    )
    counts = found.groupBy("row_id").agg(F.sum("n").alias("n_links"))
    joined = components(found.where("not no_id").select(F.col("vec_id").alias("a"), F.col("linked").alias("b")))
    return (
        rows.select("row_id", "vec_id")
        .join(counts, "row_id", "left")
        .join(joined, F.col("vec_id") == F.col("node"), "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_embedding_dedup": op4_embedding_dedup}
