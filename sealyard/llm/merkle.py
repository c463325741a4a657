"""A Merkle manifest of a dataset: a hash tree per group of rows, a tree over the groups, and versions by path copying.

A row's leaf is a hash of its columns. The leaves of a group, in order, are hashed eight at a time, level by level, to
the group's root; the roots of the groups, in order, likewise to the root of all. The tree is kept in aligned blocks of
``FAN_OUT ** HEIGHT`` nodes, each a task's unit of work whatever its group's size: a round turns every block into one
node of the next round's blocks, and so on until each group has one node.

On the way down every block learns the path above it, the siblings to the left and right at each level, from the
block over it. In a block the tree is persistent: a changed leaf makes a version that copies its ancestors and shares
all other nodes, and the version goes on along the path of its block, where only the ancestors are made anew as well.
No version sees another, and the nodes of the manifest are never changed.

Ranks come from a range partitioning and counts of its parts, so a group that holds all rows is spread like others.
Each round is written to the shared folder; the driver sees the largest group's size only. NULL is written as ``-`` in a
leaf and is a group of its own, the first. NULL ids sort first; rows with the same id are ordered by leaf, and rows
that are the same throughout have equal leaves beside each other, each with a proof of its own. Texts are hashed where
they are read and are not shuffled. Other columns are not read. No rows give no rows.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealyard.llm.common import crc_of, table
from sealyard.operators.keys import join_on_keys
from sealyard.session import materialise

FAN_OUT = 8
#: Levels in a block, which so has up to 512 nodes.
HEIGHT = 3
BLOCK = FAN_OUT**HEIGHT
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Hex sha256 over the columns: ``-`` for NULL, else the length in bytes, ``:`` and the value as text."""

    def told(column: Column) -> Column:
        text = column.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[told(c) for c in columns]), 256)


def hashed(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@dataclasses.dataclass(frozen=True, slots=True)
class Node:
    """A node that never changes; versions share it."""

    digest: str
    below: tuple[Node, ...] = ()


@dataclasses.dataclass(frozen=True, slots=True)
class Block:
    """An aligned block as a persistent tree. ``height`` levels lie above its leaves."""

    top: Node
    height: int

    @staticmethod
    def of(digests: Sequence[str], height: int) -> Block:
        row = [Node(d) for d in digests]
        for _ in range(height):
            runs = [tuple(row[at : at + FAN_OUT]) for at in range(0, len(row), FAN_OUT)]
            row = [Node(hashed([n.digest for n in run]), run) for run in runs]
        (top,) = row
        return Block(top, height)

    def _way(self, at: int) -> list[tuple[Node, int]]:
        """From the leaf up: each of its ancestors, and which of its children leads to the leaf."""
        node, way = self.top, []
        for level in range(self.height - 1, -1, -1):
            child = at // FAN_OUT**level % FAN_OUT
            way.append((node, child))
            node = node.below[child]
        return way[::-1]

    def siblings(self, at: int) -> list[tuple[str, str]]:
        """From the leaf up: the digests left and right of each node on the way."""
        found = []
        for node, child in self._way(at):
            row = [n.digest for n in node.below]
            found.append(("".join(row[:child]), "".join(row[child + 1 :])))
        return found

    def changed(self, at: int, digest: str) -> Block:
        """The version with another leaf: its ancestors are copied, all other nodes shared."""
        node = Node(digest)
        for old, child in self._way(at):
            below = (*old.below[:child], node, *old.below[child + 1 :])
            node = Node(hashed([n.digest for n in below]), below)
        return Block(node, self.height)


def carried_on(digest: str, path: Sequence[tuple[str, str]]) -> str:
    """The root of the version in which a node has this digest: its ancestors anew, with the siblings as they are."""
    for left, right in path:
        digest = hashed([left, digest, right])
    return digest


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``idx``, its row's place in the group by ``order``, and ``n``, the group's rows.

    Parts of a range partitioning are counted, and the counts added up; no group is in one task.
    """
    keys = [*group, "_part"]
    ordered = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = materialise(
        ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    )
    parts = placed.groupBy(*keys).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    line = Window.partitionBy(*group).orderBy("_part")
    parts = parts.withColumns({
        "_before": F.sum("_rows").over(line) - F.col("_rows"),
        "n": F.sum("_rows").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    }).drop("_rows")
    place = (F.col("_before") + F.col("_at") - F.col("_first")).alias("idx")
    return join_on_keys(placed, parts, keys, "inner").select(*df.columns, place, "n")


def _height(n: int) -> int:
    """Levels of a block of a group with ``n`` nodes."""
    height = 0
    while n > 1 and height < HEIGHT:
        n, height = -(-n // FAN_OUT), height + 1
    return height


def _block_of(nodes) -> tuple[Block, list[int]]:
    """The block that an Arrow table of nodes makes, and the order its rows have in it."""
    import pyarrow.compute as pc

    order = pc.sort_indices(nodes, sort_keys=[("idx", "ascending")])
    digests = nodes.column("digest").take(order).to_pylist()
    return Block.of(digests, _height(nodes.column("n")[0].as_py())), order.to_pylist()


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[name] for name in names]


_DIGEST = T.StructField("digest", T.StringType())
_IDX, _N = T.StructField("idx", T.LongType()), T.StructField("n", T.LongType())
_PATH = [T.StructField(name, T.ArrayType(T.StringType())) for name in ("left", "right")]


def _table(columns: Sequence, schema: T.StructType):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.Table.from_arrays(list(columns), names=schema.names).cast(to_arrow_schema(schema))


def _in_blocks(nodes: DataFrame, group: Sequence[str]):
    return nodes.withColumn("_block", F.expr(f"idx div {BLOCK}")).groupBy(*group, "_block")


def climb(leaves: DataFrame, group: Sequence[str]) -> list[DataFrame]:
    """The nodes of every round, ``group, idx, digest, n``, from the leaves to one node per group.

    ``leaves`` has these columns and is written already.
    """
    group = list(group)
    schema = T.StructType([*_fields(leaves, group), _IDX, _DIGEST, _N])

    def top(nodes):
        block, _ = _block_of(nodes)
        n = nodes.column("n")[0].as_py()
        first = [nodes.column(name).slice(0, 1) for name in group]
        return _table([*first, [nodes.column("_block")[0].as_py()], [block.top.digest], [-(-n // BLOCK)]], schema)

    rounds = [leaves.select(*schema.names)]
    while True:
        tops = materialise(_in_blocks(rounds[-1], group).applyInArrow(lambda nodes: top(nodes), schema))
        rounds.append(tops)
        if (tops.agg(F.max("n")).first()[0] or 1) == 1:
            return rounds


def _with_paths(nodes: DataFrame, above: DataFrame, group: Sequence[str], use, schema: T.StructType) -> DataFrame:
    """The rows that ``use(rows, block, path, above)`` gives as columns for every block of ``nodes``.

    ``rows`` are the block's nodes in order and ``path`` leads on from its top, as its row in ``above`` has it.
    """

    def work(rows, over):
        if not rows.num_rows:
            return _table([[] for _ in schema.names], schema)
        block, order = _block_of(rows)
        path = list(zip(over.column("left")[0].as_py(), over.column("right")[0].as_py(), strict=True))
        return _table(use(rows.take(order), block, path, over), schema)

    tops = above.withColumnRenamed("idx", "_block").groupBy(*group, "_block")
    return _in_blocks(nodes, group).cogroup(tops).applyInArrow(lambda rows, over: work(rows, over), schema)


def _repeated(table, name: str, times: int):
    return [table.column(name)[0].as_py()] * times


def descend(
    rounds: list[DataFrame], roots: DataFrame, group: Sequence[str], carry: Sequence[str], to: int
) -> DataFrame:
    """``group, idx, left, right, carry`` of the nodes of round ``to``: the siblings on the way up, nearest first.

    ``roots`` has ``group, left, right, carry``: the path on from the group's root, and what all its nodes are given.
    """
    group, carry = list(group), list(carry)
    above = roots.select(*group, F.lit(0).cast("bigint").alias("idx"), "left", "right", *carry)
    schema = T.StructType([*_fields(rounds[0], group), _IDX, *_PATH, *_fields(roots, carry)])

    def paths(rows, block, upper, over):
        found = [block.siblings(at) + upper for at in range(rows.num_rows)]
        sides = [[[step[side] for step in path] for path in found] for side in (0, 1)]
        same = [_repeated(over, name, rows.num_rows) for name in carry]
        return [*[rows.column(name) for name in [*group, "idx"]], *sides, *same]

    for nodes in reversed(rounds[to:-1]):
        above = materialise(_with_paths(nodes, above, group, paths, schema))
    return above


def proofs(leaves: DataFrame, above: DataFrame, group: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """``group, carry, digest, subroot, root, proof_sha256, folded_root`` of every leaf.

    ``above`` has the paths over the blocks of the leaves. ``folded_root`` is the root of the version in which the leaf
    is ``altered``, or if that is NULL the root that leaf and siblings make.
    """
    group, carry = list(group), list(carry)
    added = ["subroot", "root", "proof_sha256", "folded_root"]
    schema = T.StructType(
        [*_fields(leaves, [*group, *carry]), _DIGEST, *[T.StructField(name, T.StringType()) for name in added]]
    )

    def judged(rows, block, upper, over):
        proven, folded = [], []
        beyond = "".join(left + right for left, right in upper)
        digests, altered = (rows.column(name).to_pylist() for name in ("digest", "altered"))
        for at, (digest, other) in enumerate(zip(digests, altered, strict=True)):
            within = block.siblings(at)
            proven.append(hashed([*(left + right for left, right in within), beyond]))
            if other is None:
                folded.append(carried_on(digest, within + upper))
            else:
                folded.append(carried_on(block.changed(at, other).top.digest, upper))
        same = [_repeated(over, name, rows.num_rows) for name in ("subroot", "root")]
        return [*[rows.column(name) for name in [*group, *carry, "digest"]], *same, proven, folded]

    return _with_paths(leaves, above, group, judged, schema)


def merkle_manifest(
    df: DataFrame, group: str, order: Sequence[str], columns: Sequence[str], altered: Column | None = None
) -> DataFrame:
    """``group, order, leaf, subroot, root, proof_sha256, folded_root, verified``: one row per row of ``df``.

    Leaves are hashes of ``columns``; ``altered`` is the leaf of the row's tampered version, NULL where there is none.
    """
    carry, all_groups = list(order), ["_all"]
    altered = F.lit(None).cast("string") if altered is None else altered
    rows = df.select(group, *carry, leaf_digest([F.col(c) for c in columns]).alias("digest"), altered.alias("altered"))
    leaves = materialise(ranked(materialise(rows), [group], [*carry, "digest"]))
    rounds = climb(leaves, [group])
    # The groups' roots are the leaves of the tree over them, which is one group.
    tops = rounds[-1].select(F.lit(0).alias("_all"), group, "digest")
    subroots = materialise(ranked(tops, all_groups, [group]))
    upper = climb(subroots, all_groups)
    nowhere = F.array().cast("array<string>")
    top = upper[-1].select("_all", nowhere.alias("left"), nowhere.alias("right"), F.col("digest").alias("root"))
    paths = descend(upper, top, all_groups, ["root"], 0)
    of_groups = subroots.select(group, "idx", F.col("digest").alias("subroot")).join(paths, "idx")
    above = descend(rounds, of_groups, [group], ["subroot", "root"], 1)
    found = proofs(leaves, above, [group], carry)
    return found.withColumnRenamed("digest", "leaf").withColumn("verified", F.col("folded_root") == F.col("root"))


_LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered_leaf() -> Column:
    """The leaf of a document whose text is written in lower case, where 3 divides the CRC of its id."""
    lower = F.translate("text", _UPPER, _LOWER)
    changed = leaf_digest([lower if c == "text" else F.col(c) for c in _LEAF])
    return F.when(crc_of(F.col("doc_id")) % 3 == 0, changed)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(*_LEAF)
    return merkle_manifest(documents, "lang", ["doc_id"], _LEAF, tampered_leaf()).drop("lang")


def _told(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_told(text if c == 'text' else c) for c in _LEAF)})"


# CRC-32 by its rule: a table of 256 entries, then a step for each character of the decimal id.
_CRC = """list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda crc, c: xor(crc >> 8, t[(xor(crc, c) & 255) + 1]))"""
_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), leaves AS (
  SELECT doc_id, coalesce(lang, '') AS lang, lang IS NOT NULL AS named, {_leaf_sql("text")} AS leaf,
    CASE WHEN xor({_CRC}, 4294967295) % 3 = 0
         THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS altered
  FROM documents, crc_table
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY named, lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves
), nodes AS (
  SELECT named, lang, 0 AS level, idx, leaf AS h, count(*) OVER (PARTITION BY named, lang) AS n FROM placed
  UNION ALL
  SELECT named, lang, level + 1, idx // {FAN_OUT}, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + {FAN_OUT - 1}) // {FAN_OUT}
  FROM nodes WHERE n > 1 GROUP BY named, lang, level, idx // {FAN_OUT}
), subroots AS (
  SELECT named, lang, h, level, row_number() OVER (ORDER BY named, lang) - 1 AS pos FROM nodes WHERE n = 1
), over AS (
  SELECT 0 AS level, pos AS idx, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, idx // {FAN_OUT}, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + {FAN_OUT - 1}) // {FAN_OUT}
  FROM over WHERE n > 1 GROUP BY level, idx // {FAN_OUT}
), widths AS (
  SELECT 0 AS level, 1::BIGINT AS wide UNION ALL SELECT level + 1, wide * {FAN_OUT} FROM widths WHERE level < 19
), steps AS (
  SELECT p.named, p.lang, p.idx, k.level,
    coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx < p.idx // k.wide), '') AS l,
    coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx > p.idx // k.wide), '') AS r
  FROM placed p JOIN subroots g ON g.named = p.named AND g.lang = p.lang, widths k, nodes s
  WHERE k.level < g.level AND s.named = p.named AND s.lang = p.lang AND s.level = k.level
    AND s.idx // {FAN_OUT} = p.idx // k.wide // {FAN_OUT}
  GROUP BY p.named, p.lang, p.idx, k.level
  UNION ALL
  SELECT p.named, p.lang, p.idx, 100 + k.level,
    coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx < g.pos // k.wide), ''),
    coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx > g.pos // k.wide), '')
  FROM placed p JOIN subroots g ON g.named = p.named AND g.lang = p.lang, over s, widths k
  WHERE k.level < (SELECT max(level) FROM over) AND s.level = k.level
    AND s.idx // {FAN_OUT} = g.pos // k.wide // {FAN_OUT}
  GROUP BY p.named, p.lang, p.idx, k.level, g.pos
), proofs AS (
  SELECT named, lang, idx, sha256(string_agg(l || r, '' ORDER BY level)) AS proof_sha256,
    list({{'l': l, 'r': r}} ORDER BY level) AS steps
  FROM steps GROUP BY named, lang, idx
), folded AS (
  SELECT p.named, p.lang, p.idx, coalesce(altered, leaf) AS h, coalesce(q.steps, []) AS steps, 1 AS k,
    coalesce(q.proof_sha256, sha256('')) AS proof_sha256
  FROM placed p LEFT JOIN proofs q ON q.named = p.named AND q.lang = p.lang AND q.idx = p.idx
  UNION ALL
  SELECT named, lang, idx, sha256(steps[k].l || h || steps[k].r), steps, k + 1, proof_sha256
  FROM folded WHERE k <= len(steps)
)
SELECT p.doc_id, p.leaf, g.h AS subroot, o.h AS root, f.proof_sha256, f.h AS folded_root, f.h = o.h AS verified
FROM placed p JOIN subroots g ON g.named = p.named AND g.lang = p.lang
  JOIN folded f ON f.named = p.named AND f.lang = p.lang AND f.idx = p.idx AND f.k = len(f.steps) + 1
  JOIN over o ON o.n = 1
"""

QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
SQL = {"op13_merkle_manifest": _SQL}
