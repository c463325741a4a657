"""Similarity join of documents: word n-gram sets with Jaccard similarity at or above a threshold.

MinHash in bands: a text's signature is ``TREES`` sequences of minima, and two texts are candidates when they share one
of them. How many minima a band has follows from the threshold and the target recall by a formula, 6 at present; no
tries are built and no prefixes are shortened from what is found, so this is not yet the forest it is meant to be.
Candidates that hang together are verified exactly: the sets themselves are compared, in blocks of bounded size.

Texts with equal sets are one class and take part once. A candidate group of any size is split into blocks, and
each pair of blocks is one unit of work that sends back a count per class and one link per class and local
group, never the pairs. Counts of links include copies: each link stands for all documents of the other class.

NULL and empty texts and texts without words link with nothing. Texts of fewer words than a shingle are one
shingle. A repeated doc_id counts as one document per row in ``n_links``; its rows get one result each, with the
smallest class among them. Rows with a NULL doc_id take part as one document that sorts last. Columns other than
doc_id and text are not carried along. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealyard.llm.common import add_columns, table
from sealyard.llm.components import components
from sealyard.llm.shingles import Shingler
from sealyard.session import materialise

THRESHOLD = 0.8
SHINGLE = 5
TREES = 32
DEPTH = 10
RECALL = 0.9999
#: Classes of a block in exact verification.
BLOCK = 256
_LAST = 9223372036854775807


def prefix_length(trees: int = TREES, depth: int = DEPTH, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The most minima of a band that still find pairs at the threshold with the recall, by formula."""
    for length in range(depth, 1, -1):
        if 1 - (1 - threshold**length) ** trees >= recall:
            return length
    return 1


class Forest:
    """Keys of sets: for each of the ``trees`` bands a hash of its ``length`` minima."""

    def __init__(self, trees: int, length: int):
        rng = np.random.default_rng(977)
        self.trees, self.length = trees, length
        self.times = rng.integers(0, 1 << 63, trees * length, np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 1 << 63, trees * length, np.uint64)

    def keys(self, members: np.ndarray) -> np.ndarray:
        least = np.full(len(self.times), np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(members), 1024):
                part = members[at : at + 1024]
                # The high half of a product depends on all bits, so minima are taken over it.
                hashed = self.times[:, None] * (part ^ (part >> np.uint64(32)))[None, :] + self.plus[:, None]
                np.minimum(least, hashed.min(1), out=least)
            paths = least.reshape(self.trees, self.length)
            key = np.arange(1, self.trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for i in range(self.length):
                key = (key ^ paths[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(29)
        return key.view(np.int64)


def signatures(df: DataFrame, trees: int, length: int, shingle: int = SHINGLE) -> DataFrame:
    """``doc, k1, k2, keys`` of every text with words: two hashes of its set, and its prefix in every trie."""

    def make():
        import hashlib

        shingler, forest = Shingler(shingle), Forest(trees, length)

        def compute(texts):
            k1, k2, keys = [], [], []
            for members in shingler.sets([t or "" for t in texts]):
                if not len(members):
                    k1.append(None), k2.append(None), keys.append(None)
                    continue
                digest = np.frombuffer(hashlib.md5(members.tobytes()).digest(), np.int64)
                k1.append(int(digest[0])), k2.append(int(digest[1])), keys.append(forest.keys(members))
            return k1, k2, keys

        return compute

    docs = df.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "text")
    return add_columns(docs, ["text"], "k1 bigint, k2 bigint, keys array<bigint>", make).drop("text")


def _verify(threshold: float):
    """Counts of links and local groups of one block, or of one pair of blocks."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["side", "rep"], ignore_index=True)
        sets = [np.frombuffer(s, np.uint64) for s in pdf["set"]]
        sizes = np.array([len(s) for s in sets])
        first = int((pdf.side == 0).sum())
        one_block = first == len(pdf)
        rows = np.arange(first)
        columns = rows if one_block else np.arange(first, len(pdf))
        owner = np.repeat(np.arange(len(sets)), sizes)
        code, seen = pd.factorize(np.concatenate(sets))
        # Only shingles of several texts can be shared.
        often = np.bincount(code, minlength=len(seen)) > 1
        number = np.cumsum(often) - 1
        kept = often[code]
        code, owner = number[code[kept]], owner[kept]
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        shared = np.zeros((len(rows), len(columns)), np.float32)
        n, width = int(often.sum()), 4096
        for at in range(0, n, width):
            low, high = np.searchsorted(code, [at, at + width])
            dense = np.zeros((len(sets), min(width, n - at)), np.float32)
            dense[owner[low:high], code[low:high] - at] = 1
            shared += dense[rows] @ dense[columns].T
        union = sizes[rows][:, None] + sizes[columns][None, :] - shared
        linked = shared.astype(np.float64) >= threshold * union - 1e-9
        if one_block:
            np.fill_diagonal(linked, False)
        weight = pdf.members.to_numpy()
        links = np.zeros(len(pdf), np.int64)
        links[rows] += linked @ weight[columns]
        if not one_block:
            links[columns] += linked.T @ weight[rows]
        parent = list(range(len(pdf)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i in np.flatnonzero(linked.any(1)):
            for j in columns[linked[i]]:
                a, b = root(int(rows[i])), root(int(j))
                parent[max(a, b)] = min(a, b)
        rep = pdf.rep.to_numpy()
        group = pd.Series(rep).groupby([root(i) for i in range(len(pdf))]).transform("min").to_numpy()
        some = links > 0
        return pd.DataFrame({"rep": rep[some], "n": links[some], "linked": group[some]})

    return run


def similar_documents(
    df: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, trees: int = TREES,
    depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK,
) -> DataFrame:
    """``doc_id, n_links, class_id, kept`` for every row of ``df``: how many other documents it is directly similar
    to, the smallest doc_id it is connected with, and whether that is its own."""
    length = prefix_length(trees, depth, threshold, recall)
    signed = materialise(signatures(df, trees, length, shingle))
    classes = materialise(
        signed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("doc").alias("rep"), F.count("*").alias("members"))
    )
    # One row per class and trie; equal prefixes meet. A bucket becomes links to its smallest class.
    paths = (
        signed.where("k1 is not null")
        .join(classes.select("k1", "k2", "rep"), ["k1", "k2"])
        .where("doc = rep")
        .dropDuplicates(["k1", "k2"])
        .select("rep", F.explode("keys").alias("key"))
    )
    hubs = paths.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub < top").drop("top")
    candidate = paths.join(hubs, "key").where("rep > hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    groups = materialise(components(candidate))
    sized = groups.join(
        groups.groupBy("component").agg(F.count("*").alias("n")), "component"
    ).select(
        "component", F.col("node").alias("rep"), (F.floor((F.col("n") - 1) / F.lit(block)) + 1).cast("int").alias("parts")
    ).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))

    def sets():
        shingler = Shingler(shingle)

        def compute(texts):
            return [[s.tobytes() for s in shingler.sets([t or "" for t in texts])]]

        return compute

    wanted = sized.join(classes.select("rep", "members", "k1", "k2"), "rep")
    texts = df.select(F.coalesce("doc_id", F.lit(_LAST)).alias("rep"), "text").join(wanted, "rep")
    with_sets = add_columns(texts, ["text"], "set binary", sets).drop("text")
    # A doc_id that stands for two texts has two classes; each class takes its own text, and that once.
    keyed = _own_text(with_sets)
    # Block i of a group meets blocks i, i+1, ...: side 0 of the pairs (i, j), side 1 of the pairs (j, i).
    sent = keyed.select(
        "component", "rep", "members", "set", "part",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"),
    ).select(
        "component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"), "rep", "members", "set",
    )
    found = materialise(sent.groupBy("component", "i", "j").applyInPandas(_verify(threshold), "rep bigint, n bigint, linked bigint"))
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    connected = components(found.select(F.col("rep").alias("a"), F.col("linked").alias("b")))
    of_class = (
        classes.join(links, "rep", "left")
        .join(connected.withColumnRenamed("node", "rep"), "rep", "left")
        .select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "rep").alias("class"))
    )
    result = signed.select("doc", "k1", "k2").join(of_class, ["k1", "k2"], "left")
    doc = F.when(F.col("doc") != _LAST, F.col("doc"))
    return result.select(
        doc.alias("doc_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.coalesce("class", "doc") != _LAST, F.coalesce("class", "doc")).alias("class_id"),
        F.coalesce(F.col("class") == F.col("doc"), F.lit(True)).alias("kept"),
    )


def _own_text(df: DataFrame) -> DataFrame:
    """Rows whose set is the one that their class's hashes were made from, one per class."""

    def check():
        import hashlib

        def compute(sets, k1, k2):
            digests = [np.frombuffer(hashlib.md5(s).digest(), np.int64) for s in sets]
            return [[int(d[0]) == a and int(d[1]) == b for d, a, b in zip(digests, k1, k2, strict=True)]]

        return compute

    return add_columns(df, ["set", "k1", "k2"], "own boolean", check).where("own").dropDuplicates(["k1", "k2", "component"])


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_jaccard_join": op6_jaccard_join}
