"""Document lengths from flat token files without an index, by a separator scan.

A file is a stream of 16-bit token ids with an end-of-document id behind each document, cut into blocks of fixed size
without regard to documents. Each block is searched by itself in one array operation; it gives the lengths between its
separators, and a summary (number of separators, tokens behind the last one). A prefix scan over the summaries, first
within segments of blocks and then over the segments, gives what reaches into each block and the number of its first
document.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabveil.llm.bpe import PIECES, text_groups
from tabveil.session import materialise, ship

#: A file of public tokenizers, by name.
RANKS = "byte_bpe_50k.tiktoken"
END = 50256
BLOCK_TOKENS = 1 << 15
SEGMENT = 1024


def token_files(docs: DataFrame, ranks_path: str | None = None, end: int = END, block_tokens: int = BLOCK_TOKENS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """file, block, data: each partition's texts as one flat file in blocks; and first, ids: the ids in order, the first with its number in the file.

    Only the counting of these ids goes with a file, not where documents begin. Null and empty texts are a lone
    separator. Strings that look like special tokens are ordinary text.
    """
    ship(docs.sparkSession)
    if ranks_path is None:
        import public_tokenizers

        ranks_path = public_tokenizers.path(RANKS)
    with open(ranks_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        part, number, documents = TaskContext.get().partitionId(), 0, 0
        left, ids, texts = np.zeros(0, np.uint16), [], []

        def block(data: np.ndarray) -> pa.RecordBatch:
            nonlocal number, ids, documents
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([data.tobytes()], pa.binary()), pa.array([documents], pa.int64()), pa.array([ids], pa.list_(id_type))], ["file", "block", "data", "first", "ids"])
            number, documents, ids = number + 1, documents + len(ids), []
            return out

        id_type = None
        for b in batches:
            column = b.column(b.schema.get_field_index(id_column))
            id_type = column.type
            for lo, hi, texts in text_groups(b, text_column):
                parts = [left]
                for t in texts:
                    parts.append(np.array([*encode(t), end], dtype=np.uint16))
                left = np.concatenate(parts)
                ids += column.slice(lo, hi - lo).to_pylist()
                while len(left) >= block_tokens:
                    yield block(left[:block_tokens])
                    left = left[block_tokens:]
        if len(left):
            yield block(left)

    return docs.select(id_column, text_column).mapInArrow(run, f"file int, block long, data binary, first long, ids array<{kind}>")


def read_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, token_bytes: int = 2) -> DataFrame:
    """file, block, data of flat files under path (a glob); each file is read in one piece and cut into blocks."""
    size = block_tokens * token_bytes
    raw = spark.read.format("binaryFile").load(path)
    blocks = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / size) - 1, F.lit(0)).cast("long"))
    x = raw.where("length > 0").select(F.col("path").alias("file"), "content", F.explode(blocks).alias("block"))
    return x.select("file", "block", F.substring("content", (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("data"))


def document_lengths(blocks: DataFrame, end: int = END, token_bytes: int = 2, segment: int = SEGMENT) -> DataFrame:
    """file, number, n_tokens, ended: the tokens of each document, separators not counted; number counts from 0 in each file.

    blocks has file, block (numbers in order; some may lack) and data. A document without a separator at a file's end
    is given with ended false if it has tokens. Blocks that are null or empty hold nothing; other columns are not read.
    A file is a null key's as well. Repeated blocks are blocks of their own in no fixed order.
    """
    ship(blocks.sparkSession)
    kind = blocks.schema["file"].dataType.simpleString()
    unsigned = {1: np.uint8, 2: "<u2", 4: "<u4"}[token_bytes]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for data in b.column(2):
                x = np.frombuffer(data.as_buffer(), unsigned) if data.is_valid else np.zeros(0, unsigned)
                at = np.flatnonzero(x == end)
                for c, v in zip(out, (len(at), int(at[0]) if len(at) else len(x), int(len(x) - 1 - at[-1]) if len(at) else len(x), (np.diff(at) - 1)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.list_(pa.int64()))], ["file", "block", "n", "head", "tail", "inner"])

    x = blocks.select("file", F.col("block").cast("long").alias("block"), "data").mapInArrow(scan, f"file {kind}, block long, n long, head long, tail long, inner array<long>")
    x = materialise(x.withColumn("segment", F.floor(F.col("block") / segment)), "blocks-scanned")

    def carried(df: DataFrame, keys: list[str], order: str) -> DataFrame:
        """count, open: separators, and tokens since the last one, before each row of its key."""
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("run", F.coalesce(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(before), F.lit(0)))
        # of the blocks before, those from the last with a separator on
        since = Window.partitionBy(*keys, "after").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({"after": F.col("run") + (F.col("n") > 0).cast("int"), "count": F.coalesce(F.sum("n").over(before), F.lit(0))})
        df = df.withColumn("upto", F.sum("tail").over(since))
        return df.withColumn("open", F.coalesce(F.lag("upto").over(Window.partitionBy(*keys).orderBy(order)), F.lit(0))).drop("upto", "after")

    inside = carried(x, ["file", "segment"], "block")
    last = F.max_by(F.struct((F.col("count") + F.col("n")).alias("n"), F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("open") + F.col("tail")).alias("tail")), "block")
    segments = carried(inside.groupBy("file", "segment").agg(last.alias("x")).select("file", "segment", "x.n", "x.tail"), ["file"], "segment")
    both = inside.join(segments.select(F.col("file").alias("_f"), F.col("segment").alias("_s"), F.col("count").alias("more"), F.col("open").alias("more_open")), F.col("file").eqNullSafe(F.col("_f")) & (F.col("segment") == F.col("_s")))
    reach = F.col("open") + F.when(F.col("run") == 0, F.col("more_open")).otherwise(0)
    number = F.col("count") + F.col("more")
    ended = both.where("n > 0").select("file", number.alias("from"), F.posexplode(F.concat(F.array(reach + F.col("head")), "inner")).alias("i", "n_tokens")).select("file", (F.col("from") + F.col("i")).alias("number"), "n_tokens", F.lit(True).alias("ended"))
    rest = both.groupBy("file").agg(F.max_by(F.struct((number + F.col("n")).alias("number"), (F.col("tail") + F.when(F.col("n") == 0, reach).otherwise(0)).alias("n_tokens")), "block").alias("x"))
    return ended.unionByName(rest.select("file", "x.number", "x.n_tokens", F.lit(False).alias("ended")).where("n_tokens > 0"))


def count_tokens(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """id_column, n_tokens: texts written as flat token files in the shared folder, then counted from these alone.

    One row for each row of docs: repeated rows and ids are counted each, a null id stays null, null and empty texts have
    0 tokens. There are no ties to break. An empty table gives no rows; other columns are not read.
    """
    files = materialise(token_files(docs, id_column=id_column, text_column=text_column, **options), "token-files")
    ids = files.select("file", "first", F.posexplode("ids").alias("i", id_column)).select("file", (F.col("first") + F.col("i")).alias("number"), id_column)
    return document_lengths(files).join(ids, ["file", "number"]).select(id_column, "n_tokens")
