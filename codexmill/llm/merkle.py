"""Merkle manifest of a dataset: a root, node records, and a path from every row to the root.

Rows are dealt by range, so each task holds a run of consecutive leaves of some groups.
A stack, one run of children for each level, takes the leaves in order: a run that is
full, or that ends its level, carries over into its parent. What a task can't carry,
because a run began before its rows or goes on after them, are its peaks, at most
2 * fanout for each level. Peaks of all tasks are merged by blocks of ten binary levels or
so (a block has BLOCK nodes at most, whatever the tasks' borders), then paths are
handed down the same blocks to the peaks, and by the tasks to their rows. The roots of
the groups are the leaves of one more tree, made in the same way. A short last run is
hashed as it is, without padding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_width

FANOUT = 2
#: Nodes of the lowest level of a block when tasks' peaks are merged.
BLOCK = 1024
#: Leaves of a task, about.
RANGE_ROWS = 65_536
#: What tampering with a row is tested on: one in so many rows, by a checksum of doc_id.
TAMPERED = 7
#: The fields of a leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value: Column) -> Column:
    """The value behind its length in bytes, so that joined fields stay apart; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*[framed(f) for f in fields]), 256)


class Stack:
    """The runs of children that one stretch of consecutive nodes leaves open, level by level.

    ``leaves`` is the width of level 0. ``records`` has every node that was given or that
    became complete, by level and index.
    """

    def __init__(self, leaves: int, fanout: int, top: int = 10**9):
        self.widths, self.fanout, self.top = widths(leaves, fanout), fanout, top
        self.open: dict[int, list[tuple[int, str]]] = {}
        self.records: dict[int, dict[int, str]] = {}
        self.peaks: list[tuple[int, int, str]] = []

    def push(self, level: int, index: int, value: str) -> None:
        while True:
            self.records.setdefault(level, {})[index] = value
            run = self.open.setdefault(level, [])
            run.append((index, value))
            last = index == self.widths[level] - 1
            if level == self.top or self.widths[level] == 1 or not (last or index % self.fanout == self.fanout - 1):
                return
            if run[0][0] % self.fanout:  # its first children lie in another stretch
                return self.settle(level)
            self.open[level] = []
            level, index, value = level + 1, index // self.fanout, digest(v for _, v in run)

    def settle(self, level: int) -> None:
        self.peaks += [(level, i, v) for i, v in self.open.pop(level, [])]

    def rest(self) -> list[tuple[int, int, str]]:
        """(level, index, digest) of the nodes that have no parent here."""
        for level in sorted(self.open):
            self.settle(level)
        return self.peaks

    def paths(self, tails: dict[tuple[int, int], str]) -> dict[int, dict[int, str]]:
        """By level and index, each node's path to the root; tails: the paths of nodes without parent here."""
        out: dict[int, dict[int, str]] = {}
        for level in sorted(self.records, reverse=True):
            own, above, found = self.records[level], out.get(level + 1, {}), {}
            for index in own:
                up = index // self.fanout
                if up not in above:
                    found[index] = tails[level, index]
                    continue
                left = range(up * self.fanout, index)
                right = range(index + 1, min((up + 1) * self.fanout, self.widths[level]))
                step = "".join(own[i] for i in left) + ":" + "".join(own[i] for i in right)
                found[index] = f"{step},{above[up]}" if above[up] else step
            out[level] = found
        return out


def widths(leaves: int, fanout: int) -> list[int]:
    """Number of nodes of each level."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


def band_height(fanout: int, block: int = BLOCK) -> int:
    """Levels of a block."""
    height = 1
    while fanout ** (height + 1) <= block:
        height += 1
    return height


NODE = "grp string, leaves long, level int, idx long, digest string, pid long"


def stack_of(rows: pd.DataFrame, fanout: int, top: int = 10**9) -> Stack:
    """A stack of one group's nodes, given in any order: those of a lower level end before a higher one's begin or begin after it ends."""
    made = Stack(int(rows["leaves"].iloc[0]), fanout, top)
    spans = [(int(i) * fanout ** int(level), int(level), int(i), d) for level, i, d in zip(rows["level"], rows["idx"], rows["digest"], strict=True)]
    for _, level, index, value in sorted(spans):
        made.push(level, index, value)
    return made


def runs_of(rows: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame]]:
    yield from rows.groupby("grp", sort=False)


def range_peaks(fanout: int) -> Callable:
    def peaks(key: tuple, rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        out = []
        at = {g: (s, n) for g, s, n in zip(starts["grp"], starts["start"], starts["leaves"], strict=True)}
        for grp, own in runs_of(rows.sort_values("seq")):
            start, leaves = at[grp]
            made = Stack(int(leaves), fanout)
            for k, leaf in enumerate(own["leaf"]):
                made.push(0, int(start) + k, leaf)
            out += [(grp, int(leaves), level, i, d, int(key[0])) for level, i, d in made.rest()]
        return pd.DataFrame(out, columns=["grp", "leaves", "level", "idx", "digest", "pid"])

    return peaks


def range_paths(fanout: int) -> Callable:
    def paths(key: tuple, rows: pd.DataFrame, tails: pd.DataFrame) -> pd.DataFrame:
        out = []
        by_group = dict(iter(tails.groupby("grp", sort=False)))
        for grp, own in runs_of(rows.sort_values("seq")):
            mine = by_group[grp]
            start, leaves = int(mine["start"].iloc[0]), int(mine["leaves"].iloc[0])
            made = Stack(leaves, fanout)
            for k, leaf in enumerate(own["leaf"]):
                made.push(0, start + k, leaf)
            known = {(int(level), int(i)): t for level, i, t in zip(mine["level"], mine["idx"], mine["tail"], strict=True)}
            out.append(own.drop(columns=["seq", "pid"]).assign(idx=range(start, start + len(own)), path=list(made.paths(known)[0].values()), subroot=mine["subroot"].iloc[0]))
        return pd.concat(out)

    return paths


def range_records(fanout: int) -> Callable:
    def records(key: tuple, rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        out = []
        at = {g: (s, n) for g, s, n in zip(starts["grp"], starts["start"], starts["leaves"], strict=True)}
        for grp, own in runs_of(rows.sort_values("seq")):
            made = Stack(int(at[grp][1]), fanout)
            for k, leaf in enumerate(own["leaf"]):
                made.push(0, int(at[grp][0]) + k, leaf)
            out += [(grp, level, i, d) for level, own in made.records.items() for i, d in own.items()]
        return pd.DataFrame(out, columns=["grp", "level", "idx", "digest"])

    return records


def block_tops(fanout: int, top: int) -> Callable:
    """The node that a block's nodes add up to."""

    def tops(rows: pd.DataFrame) -> pd.DataFrame:
        made = stack_of(rows, fanout, top)
        return pd.DataFrame([(rows["grp"].iloc[0], int(rows["leaves"].iloc[0]), level, i, d, None) for level, i, d in made.rest()], columns=["grp", "leaves", "level", "idx", "digest", "pid"])

    return tops


def block_records(fanout: int, top: int) -> Callable:
    """The nodes between a block's own and its top, the top included; the block's own are recorded where they come from."""

    def records(rows: pd.DataFrame) -> pd.DataFrame:
        made, given = stack_of(rows, fanout, top), set(zip(rows["level"], rows["idx"], strict=True))
        out = [(rows["grp"].iloc[0], level, i, d) for level, own in made.records.items() for i, d in own.items() if (level, i) not in given]
        return pd.DataFrame(out, columns=["grp", "level", "idx", "digest"])

    return records


def block_tails(fanout: int, top: int) -> Callable:
    """The paths of a block's nodes, out of the path of its top."""

    def tails(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        made = stack_of(rows, fanout, top)
        paths = made.paths({(int(above["level"].iloc[0]), int(above["idx"].iloc[0])): above["tail"].iloc[0]})
        tail = [paths[level][i] for level, i in zip(rows["level"], rows["idx"], strict=True)]
        return rows.drop(columns=["digest", "block"]).assign(tail=tail, subroot=above["subroot"].iloc[0])

    return tails


class Forest:
    """One tree for each group of ``leaves`` (grp, leaf and any columns to go along), in the order of ``order``.

    Columns of the input must not be named seq, pid, start, leaves, level, idx, digest,
    path or subroot. Rows that are alike in grp, order and leaf are interchangeable.
    """

    def __init__(self, leaves: DataFrame, order: list[str], fanout: int = FANOUT, block: int = BLOCK, range_rows: int = RANGE_ROWS):
        if fanout < 2:
            raise ValueError("a node has two children at least")
        self.fanout, self.height = fanout, band_height(fanout, block)
        self.nothing = leaves.sparkSession.createDataFrame([], NODE)
        kept = cut(leaves)
        width = max(shuffle_width(kept.sparkSession), -(-kept.count() // range_rows))
        ranged = kept.withColumn("_tie", F.monotonically_increasing_id())
        keys = ["grp", *order, "leaf", "_tie"]
        # Of a row's number, the upper bits name its task.
        self.rows = cut(ranged.repartitionByRange(width, *keys).sortWithinPartitions(*keys).drop("_tie").withColumn("seq", F.monotonically_increasing_id()).withColumn("pid", F.shiftright("seq", 33)))
        per_range = self.rows.groupBy("pid", "grp").agg(F.count(F.lit(1)).alias("n"))
        group = Window.partitionBy("grp")  # a row for each task that holds the group
        before = F.sum("n").over(group.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
        # Columns under names of their own, so that rows and starts can meet in a cogroup.
        self.starts = cut(per_range.select(F.col("pid").alias("pid"), F.col("grp").alias("grp"), F.coalesce(before, F.lit(0)).alias("start"), F.sum("n").over(group).alias("leaves")))
        self.bands = self.merged()

    def merged(self) -> list[DataFrame]:
        """By band of levels, the nodes that meet there: peaks of tasks, and tops of the band below."""
        most = self.starts.agg(F.max("leaves")).first()[0]
        levels = len(widths(most, self.fanout)) if most else 0
        peaks = cut(self.thin().groupBy("pid").cogroup(self.starts.groupBy("pid")).applyInPandas(range_peaks(self.fanout), NODE))
        bands, carried, roots = [], self.nothing, self.nothing
        for low in range(0, levels, self.height):
            top = low + self.height
            here = peaks.filter(F.col("level").between(low, top - 1)).unionByName(carried)
            bands.append(cut(here.withColumn("block", self.block(top))))
            tops = cut(bands[-1].groupBy("grp", "block").applyInPandas(block_tops(self.fanout, top), NODE))
            roots, carried = roots.unionByName(tops.filter(F.col("level") < top)), tops.filter(F.col("level") == top)
        self.roots = roots.select("grp", F.col("level").alias("top"), F.col("digest").alias("subroot"))
        return bands

    def thin(self) -> DataFrame:
        return self.rows.select("grp", "leaf", "seq", "pid")

    def block(self, top: int) -> Column:
        """The node of level ``top`` that a node lies under, that level taken to exist."""
        return F.expr(f"idx div cast(power({self.fanout}, {top} - level) as long)")

    def paths(self, roots: DataFrame | None = None) -> DataFrame:
        """The rows with idx, subroot and path; roots: grp, subroot and the path (tail) that every path of the group goes on with."""
        above = (self.roots.withColumn("tail", F.lit("")) if roots is None else roots).select("grp", "subroot", "tail")
        found = None
        for k in reversed(range(len(self.bands))):
            top = (k + 1) * self.height
            here = self.bands[k]
            # A group's last node of all is its root; the tops of other blocks have their paths from the band above.
            own = self.roots.join(above, ["grp", "subroot"]).filter(F.col("top").between(k * self.height, top - 1))
            tops = own.select("grp", F.lit(0).cast("long").alias("block"), F.col("top").alias("level"), F.lit(0).cast("long").alias("idx"), "tail", "subroot")
            if found is not None:
                tops = tops.unionByName(found.filter((F.col("level") == top) & F.col("pid").isNull()).select("grp", F.col("idx").alias("block"), "level", "idx", "tail", "subroot"))
            made = cut(here.groupBy("grp", "block").cogroup(tops.groupBy("grp", "block")).applyInPandas(block_tails(self.fanout, top), "grp string, leaves long, level int, idx long, pid long, tail string, subroot string"))
            found = made if found is None else made.unionByName(found)
        kept = self.rows.drop("seq", "pid").schema
        plain = [F.col(f.name).cast("string") for f in kept]  # pandas would turn numbers with nulls into floats
        schema = ", ".join(f"`{f.name}` string" for f in kept) + ", idx long, path string, subroot string"
        back = [F.col(f.name).cast(f.dataType) for f in kept] + [F.col(c) for c in ("idx", "path", "subroot")]
        if found is None:
            return self.rows.sparkSession.createDataFrame([], schema).select(*back)
        tails = cut(found.filter(F.col("pid").isNotNull()).join(self.starts.select("pid", "grp", "start"), ["pid", "grp"]))
        return self.rows.select(*plain, "seq", "pid").groupBy("pid").cogroup(tails.groupBy("pid")).applyInPandas(range_paths(self.fanout), schema).select(*back)

    def records(self) -> DataFrame:
        """grp, level, idx, digest of every node, leaves included: the manifest."""
        kind = "grp string, level int, idx long, digest string"
        out = self.thin().groupBy("pid").cogroup(self.starts.groupBy("pid")).applyInPandas(range_records(self.fanout), kind)
        for k, here in enumerate(self.bands):
            out = out.unionByName(here.groupBy("grp", "block").applyInPandas(block_records(self.fanout, (k + 1) * self.height), kind))
        return out


def siblings(path: Column) -> Column:
    """A path's steps: (before, after), the digests to the left and right, joined, from the leaf's level up."""
    step = lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(1)).alias("before"), F.split_part(s, F.lit(":"), F.lit(2)).alias("after"))
    return F.when(path == "", F.array().cast("array<struct<before:string,after:string>>")).otherwise(F.transform(F.split(path, ","), step))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """grp, doc_id, leaf and the leaf after tampering; group 0 is null, group 1x is lang x."""
    own = {c: F.col(c) for c in FIELDS}
    id_text = F.col("doc_id").cast("string")
    hit = F.coalesce(F.crc32(id_text.cast("binary")) % TAMPERED == 0, F.lit(False))
    changed = own | {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return docs.select(F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0")).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(own.values()).alias("leaf"), leaf_of(changed.values()).alias("tampered"))


def manifest(docs: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """The manifest's node records: those of each lang's tree (grp, level, idx, digest), and those of the tree over the langs' roots."""
    forest = Forest(leaves(docs).drop("tampered"), ["doc_id"], fanout)
    return forest.records(), over_roots(forest).records()


def over_roots(forest: Forest) -> Forest:
    return Forest(forest.roots.select(F.lit("").alias("grp"), F.col("grp").alias("lang_grp"), F.col("subroot").alias("leaf")), ["lang_grp"], forest.fanout)


def proofs(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row per input row: doc_id, lang group, leaf, tampered, subroot, root, siblings.

    * A leaf is the digest of the fields, each behind its length in bytes, null as a
      dash; so null and empty texts differ.
    * Leaves of a lang go by doc_id, null first, rows that repeat a doc_id by digest;
      rows alike in all fields have neighbouring places.
    * ``siblings`` leads from the leaf to the root over the lang's subroot.
    * An empty table gives no rows; further columns of the input play no part.
    """
    forest = Forest(leaves(docs), ["doc_id"], fanout)
    top = over_roots(forest)
    root = top.roots.first()
    above = top.paths().select(F.col("lang_grp").alias("grp"), F.col("leaf").alias("subroot"), F.col("path").alias("tail"))
    rows = forest.paths(cut(above))
    return rows.select("doc_id", "grp", "leaf", "tampered", "subroot", F.lit(root["subroot"] if root else None).cast("string").alias("root"), siblings(F.col("path")).alias("siblings"))


def merkle(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each row against the root, where a seventh was tampered with."""
    proof = F.sha2(F.array_join(F.transform("siblings", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    found = proofs(docs, fanout).select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.col("tampered"), F.col("siblings")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
