"""Merkle manifest of a dataset with a witness for every row, kept up while rows are appended.

A row is a leaf; the leaves of a group, in order of a key, are nodes of level 0, every 8 nodes in a row become one node
of the next level (the last run may have fewer), and the groups' roots are the leaves of one tree above them. Leaves
are dealt into aligned blocks of 512, and a task streams through its blocks: an appended node takes along the nodes to
its left in its run as a partial witness, and is added to theirs; once a run is complete, its witnesses go to all
leaves below, and the run's hash is appended one level up. The blocks' roots are appended in the same way, in blocks
of 512 again, and what their witnesses gain extends those of the rows below by one join a round, from the top down. A
round divides the number of nodes by 512, and no task holds more than a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabveil.operators.codes import ranged
from tabveil.session import materialise, ship

FANOUT, LEVELS = 8, 3
BLOCK = FANOUT**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(fields: list[Column]) -> Column:
    """SHA-256 (32 bytes) of the fields in a row: `-` for null, else the number of UTF-8 bytes, `:` and the value as text."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def join_hash(digests: list[bytes]) -> bytes:
    """SHA-256 of the digests' hex text."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


class Frontier:
    """The open runs above an append-only row of leaves, and the witnesses of these leaves so far.

    open[level] has (digest, siblings so far, witnesses of the leaves below) for each node of the open run. A witness
    is a list of steps (place in the run, siblings from left to right), lowest level first.
    """

    def __init__(self, levels: int):
        self.levels, self.open, self.witnesses = levels, [[] for _ in range(levels + 1)], []

    def append(self, digest: bytes) -> None:
        witness: list = []
        self.witnesses.append(witness)
        self._add(0, digest, [witness])

    def _add(self, level: int, digest: bytes, below: list) -> None:
        run = self.open[level]
        left = [d for d, _, _ in run]
        for _, siblings, _ in run:
            siblings.append(digest)
        run.append((digest, left, below))
        if level < self.levels and len(run) == FANOUT:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        for place, (_, siblings, below) in enumerate(run):
            step = (place, b"".join(siblings))
            for witness in below:
                witness.append(step)
        self._add(level + 1, join_hash([d for d, _, _ in run]), [w for _, _, below in run for w in below])

    def finish(self) -> bytes:
        """Close the runs that are still open; the digest of the top."""
        for level in range(self.levels):
            if self.open[level]:
                self._close(level)
        return self.open[self.levels][0][0]


def places(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with pos, the row's number from 0 within its group in that order, and size, the group's rows; equal rows are put in some order.

    Rows are range-partitioned by group and order, so no task holds a group; the ranges before give the shift.
    """
    x = ranged(df, [F.col(group), *map(F.col, order), F.monotonically_increasing_id()])
    n = x.groupBy("_part", group).agg(F.count("*").alias("_n"))
    all_, before = Window.partitionBy(group), Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    shift = n.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"), F.sum("_n").over(all_).alias("size"))
    x = x.withColumn("_row", F.row_number().over(Window.partitionBy("_part", group).orderBy(*order)))
    x = x.join(shift, (F.col("_part") == F.col("_p")) & (F.col(group) == F.col("_g")))
    return x.select(*df.columns, (F.col("_row") - 1 + F.col("_shift")).alias("pos"), "size")


def append_blocks(nodes: DataFrame) -> DataFrame:
    """nodes (tree, pos, size, digest and others) with block, and from their block alone path, shape and, in its first row, top.

    path has the siblings' digests, lowest level first, from left to right; shape two bytes for each level, the node's
    place in its run and its number of siblings.
    """
    ship(nodes.sparkSession)
    x = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema)

    def solve(t: pa.Table) -> pa.RecordBatch:
        """The blocks of a table that begins and ends with one."""
        path, shape, top = [], [], []
        trees, blocks, sizes, digests = (t.column(c).to_pylist() for c in ("tree", "block", "size", "digest"))
        lo = 0
        for hi in range(1, len(trees) + 1):
            if hi == len(trees) or blocks[hi] != blocks[lo] or trees[hi] != trees[lo]:
                front = Frontier(next((n for n in range(LEVELS) if FANOUT**n >= sizes[lo]), LEVELS))
                for d in digests[lo:hi]:
                    front.append(d)
                top += [front.finish(), *[None] * (hi - lo - 1)]
                path += [b"".join(s for _, s in w) for w in front.witnesses]
                shape += [bytes(n for place, s in w for n in (place, len(s) // 32)) for w in front.witnesses]
                lo = hi
        whole = t.append_column("path", pa.array(path, pa.binary())).append_column("shape", pa.array(shape, pa.binary())).append_column("top", pa.array(top, pa.binary()))
        return whole.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None  # the rows of the block that may go on
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            cut, last = t.num_rows - 1, (t.column("tree")[-1].as_py(), t.column("block")[-1].as_py())
            while cut and (t.column("tree")[cut - 1].as_py(), t.column("block")[cut - 1].as_py()) == last:
                cut -= 1
            if cut:
                yield solve(t.slice(0, cut))
            left = t.slice(cut)
        if left is not None:
            yield solve(left)

    return x.mapInArrow(run, f"{fields}, path binary, shape binary, top binary")


def ascend(nodes: DataFrame, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """nodes (tree, pos, size, digest and others) with path and shape up to the end of what `above` gives, and its other columns.

    above takes (tree, digest), each tree's root, and returns tree, path, shape and others for it.
    """
    x = materialise(append_blocks(nodes), "merkle-blocks")
    tops = x.where("top IS NOT NULL").select("tree", F.col("block").alias("pos"), F.ceil(F.col("size") / BLOCK).alias("size"), F.col("top").alias("digest"))
    if (x.agg(F.max("size")).first()[0] or 1) > BLOCK:
        up = ascend(tops, above).drop("size", "digest")
    else:
        up = above(tops.select("tree", "digest")).withColumn("pos", F.lit(0).cast("long"))
    names = [c for c in up.columns if c not in ("tree", "pos", "path", "shape")]
    up = up.select(F.col("tree").alias("_tree"), F.col("pos").alias("_block"), F.col("path").alias("_path"), F.col("shape").alias("_shape"), *names)
    x = x.join(up, (F.col("tree") == F.col("_tree")) & (F.col("block") == F.col("_block")))
    return x.select(*nodes.columns, F.concat("path", "_path").alias("path"), F.concat("shape", "_shape").alias("shape"), *names)


def manifest(rows: DataFrame, key: str, group: str, digest: str = "leaf") -> DataFrame:
    """rows with subroot, root, path and shape: the tree of each group and the tree above, and each row's witness in them.

    rows has the key, the group (text), the digest (32 bytes) and any other columns but these four; write it down
    first if it is dear to compute. Groups come in order of their UTF-8 bytes, null first; a null key is a group's
    first row; rows of equal keys come in the order of their digests, so that repeated rows are leaves of their own.
    An empty table has no rows.
    """
    names = [c for c in rows.columns if c not in (digest, group)]
    carried = [F.col(c).alias(f"_x{n}") for n, c in enumerate(names)]
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group)), F.lit(""))
    leaves = places(rows.select(tree.alias("tree"), F.col(digest).alias("digest"), *carried), "tree", [f"_x{names.index(key)}", "digest"])

    def groups(tops: DataFrame) -> DataFrame:
        one = places(tops.select(F.lit("").alias("all"), "tree", F.col("digest")), "all", ["tree"])
        one = one.select(F.col("all").alias("tree"), "pos", "size", "digest", F.col("tree").alias("group"))
        top = lambda t: t.select("tree", F.lit("").cast("binary").alias("path"), F.lit("").cast("binary").alias("shape"), F.col("digest").alias("root"))
        return ascend(one, top).select(F.col("group").alias("tree"), "path", "shape", F.col("digest").alias("subroot"), "root")

    out = ascend(leaves, groups)
    value = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30))
    back = {group: value, digest: F.col("digest"), **{c: F.col(f"_x{n}") for n, c in enumerate(names)}}
    return out.select(*[back[c].alias(c) for c in rows.columns], "subroot", "root", "path", "shape")


def fold(digest: bytes, path: bytes, shape: bytes) -> bytes:
    """The root that a leaf and its witness give."""
    at = 0
    for place, others in zip(shape[::2], shape[1::2], strict=True):
        run = path[at : at + 32 * others]
        digest, at = join_hash([run[: 32 * place], digest, run[32 * place :]]), at + 32 * others
    return digest


def folded(manifest: DataFrame, digest: str = "leaf") -> DataFrame:
    """manifest with folded_root, what its witnesses make of that digest (null of null), and proof, the hash of their siblings."""
    ship(manifest.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in manifest.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, p, s = (b.column(b.schema.get_field_index(c)).to_pylist() for c in (digest, "path", "shape"))
            got = [None if x is None else fold(x, y, z) for x, y, z in zip(d, p, s, strict=True)]
            proof = [join_hash([y]) for y in p]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary()), pa.array(proof, pa.binary())], [*b.schema.names, "folded_root", "proof"])

    return manifest.mapInArrow(run, f"{fields}, folded_root binary, proof binary")


def text_digest(column: str) -> Column:
    return F.lower(F.hex(column))


def tamper_report(docs: DataFrame, tampered: Column, altered: str = "text", key: str = "doc_id", group: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified: the manifest, and whether rows still prove once A-Z of `altered` are lower-cased where `tampered`.

    Rows as in manifest; where tampered is null a row is left as it is. Columns other than those named are not read.
    """
    change = F.when(tampered, F.translate(altered, UPPER, LOWER)).otherwise(F.col(altered))
    now = F.when(tampered, leaf([change if c == altered else F.col(c) for c in columns]))
    rows = docs.select(F.col(key).alias("key"), F.col(group).cast("string").alias("group"), leaf([F.col(c) for c in columns]).alias("leaf"), now.alias("now"))
    proved = manifest(materialise(rows, "leaves"), "key", "group").withColumn("now", F.coalesce("now", "leaf"))
    x = folded(proved.drop("group"), "now")
    return x.select(F.col("key").alias(key), *[text_digest(c).alias(c) for c in ("leaf", "subroot", "root")], text_digest("proof").alias("proof_sha256"), text_digest("folded_root").alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))
