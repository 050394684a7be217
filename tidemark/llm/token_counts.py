"""Token counts by separator scan over flat token files.

A token file is a bare sequence of 16-bit identifiers with an end-of-document identifier after each
document and no index. It is read in blocks of fixed size by as many tasks as there are blocks; in a block
all separators are found at once. A prefix scan over the blocks' summaries (how many separators, how many
tokens behind the last) tells each block which document it starts in and how much of it lies before.
"""

from __future__ import annotations

import base64
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.plans.staging import shared_folder, stage

KIND = np.dtype("<u2")
#: Tokens in a block, and tokens after which a writer begins another file.
BLOCK = 1 << 19
FILE_TOKENS = 1 << 26
END = 50256


@lru_cache(maxsize=1)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_files(documents: DataFrame, folder: str, vocabulary: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes flat token files into the shared ``folder``; returns (id, file, ordinal).

    Each attempt of a task writes files of its own names, and only those of the attempt that counts are
    returned, so a lost executor leaves files that nobody reads. A null text is written as an empty document.
    """
    kind = documents.schema[id].dataType.simpleString()

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        encode = _encoding(vocabulary, pattern).encode_ordinary
        out, name, written, ordinal = None, None, 0, 0
        for batch in batches:
            files, ordinals = [], []
            for said in batch.column(1).to_pylist():
                if out is None or written >= FILE_TOKENS:
                    if out is not None:
                        out.close()
                    name, written, ordinal = f"{uuid.uuid4().hex}.tokens", 0, 0
                    out = store.open_output_stream(f"{root}/{name}")
                tokens = np.array(encode(said or "") + [END], KIND)
                out.write(tokens.tobytes())
                files.append(name)
                ordinals.append(ordinal)
                written += len(tokens)
                ordinal += 1
            if files:
                yield pa.record_batch([batch.column(0), pa.array(files), pa.array(ordinals, pa.int64())], [id, "file", "ordinal"])
        if out is not None:
            out.close()

    return documents.select(id, text).mapInArrow(run, f"{id} {kind}, file string, ordinal long")


def count_tokens(spark: SparkSession, folder: str, end: int = END) -> DataFrame:
    """(file, ordinal, n_tokens) for every document of the flat token files in ``folder``.

    Tokens after a file's last separator are a document of their own; a file without a token has none. A
    trailing odd byte is not a token.
    """
    files = spark.read.format("binaryFile").load(folder).select(
        F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.floor(F.col("length") / KIND.itemsize).alias("tokens")).where("tokens > 0")
    blocks = files.select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / BLOCK))).alias("block"))

    def scan(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, total, block in zip(*(batch.column(c).to_pylist() for c in ("file", "tokens", "block"))):
                size = min(BLOCK, total - block * BLOCK)
                with store.open_input_file(f"{root}/{name}") as source:
                    tokens = np.frombuffer(source.read_at(size * KIND.itemsize, block * BLOCK * KIND.itemsize), KIND)
                ends = np.flatnonzero(tokens == end)
                gaps = np.diff(ends, prepend=-1) - 1
                tail = size - (int(ends[-1]) + 1 if len(ends) else 0)
                yield pa.record_batch(
                    [pa.array([name]), pa.array([block], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([tail], pa.int64()),
                     pa.array([block * BLOCK + size == total]), pa.array([gaps.tolist()], pa.list_(pa.int64()))],
                    ["file", "block", "ends", "tail", "last", "gaps"],
                )

    # rows that name a block of bytes are small; dealing them out evenly lets every task read its own
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = stage(blocks.repartition(parts, "file", "block").mapInArrow(
        scan, "file string, block long, ends long, tail long, last boolean, gaps array<long>"))
    summary = found.select("file", "block", "ends", "tail", "last")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # tokens open at a block's start: what lies between it and the last separator before
    scanned = summary.withColumns({
        "first": F.coalesce(F.sum("ends").over(before), F.lit(0)),
        "upto": F.coalesce(F.sum("tail").over(before), F.lit(0)),
    }).withColumn("closed", F.when(F.col("ends") > 0, F.col("upto"))).withColumn(
        "open", F.col("upto") - F.coalesce(F.last(F.when(F.col("ends") > 0, F.col("upto")), ignorenulls=True).over(before), F.lit(0)))
    where = scanned.select(F.col("file").alias("f"), F.col("block").alias("b"), "first", "open")
    stitched = found.join(where, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    inside = stitched.select("file", "first", "open", F.posexplode("gaps").alias("i", "gap")).select(
        "file", (F.col("first") + F.col("i")).alias("ordinal"), (F.col("gap") + F.when(F.col("i") == 0, F.col("open")).otherwise(0)).alias("n_tokens"))
    rest = stitched.where("last").select(
        "file", (F.col("first") + F.col("ends")).alias("ordinal"), (F.col("tail") + F.when(F.col("ends") == 0, F.col("open")).otherwise(0)).alias("n_tokens"))
    return inside.unionByName(rest.where("n_tokens > 0"))


def document_tokens(documents: DataFrame, vocabulary: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens): flat token files are written, scanned, and the counts brought back to the documents.

    Null and empty texts have no tokens; repeated rows are counted each; a null id stays null; other
    columns are ignored; no rows give no rows.
    """
    spark = documents.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root)
    wrote = stage(write_files(documents, folder, vocabulary, pattern, id, text))
    counts = count_tokens(spark, folder)
    return wrote.join(counts, ["file", "ordinal"], "left").select(id, "n_tokens")
