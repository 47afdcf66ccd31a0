"""Document spans in flat token files that have no index.

A token file is read in blocks of any size. Each block is searched on its own for the end-of-document id; what it needs from the blocks before it
(tokens, separators, where the last document began) comes from a prefix scan over one summary row per block, itself in two
levels so that a file with a third of all blocks does not meet in one task.
"""
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reuse

END = 50256
BLOCK_BYTES = 1 << 20
SCAN_BLOCKS = 1024
FILE_DOCS = 4096


def read_token_files(spark, path, block_bytes=BLOCK_BYTES) -> DataFrame:
    """Blocks (file, block, data) of the binary files under ``path``; a file must fit in an executor's memory, as shards do."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    return files.select(F.col("path").alias("file"), F.posexplode(F.expr(
        f"transform(sequence(0L, (length - 1) div {block_bytes}), i -> substring(content, cast(i * {block_bytes} + 1 as int), {block_bytes}))")).alias("block", "data"))


def _marks(end, dtype):
    def run(batches):
        for b in batches:
            n, at = [], []
            for data in b.column(2):
                raw = data.as_buffer() if data.is_valid else b""
                if len(raw) % dtype.itemsize:
                    raise ValueError("a block ends inside a token: choose blocks of whole tokens")
                ids = np.frombuffer(raw, dtype)
                n.append(len(ids))
                at.append(np.flatnonzero(ids == end))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int64()))],
                                             names=["file", "block", "n", "ends"])
    return run


def spans(blocks: DataFrame, end=END, dtype="<u2", scan_blocks=SCAN_BLOCKS) -> DataFrame:
    """One row per document of (file, block, data): file, ordinal (from 0), start, n_tokens, terminated.

    A document is the tokens up to the next ``end`` id, without it; tokens behind a file's last ``end`` are a document that is not terminated.
    ``block`` numbers a file's blocks in order, gaps allowed. Empty or null blocks hold no tokens; a block that cuts a token is an error.
    """
    kinds = {c: t for c, t in blocks.dtypes}
    m = blocks.select("file", F.col("block").cast("long").alias("block"), "data")
    m = reuse(m.mapInArrow(_marks(end, np.dtype(dtype)), f"file {kinds['file']}, block long, n long, ends array<long>"))
    s = m.select("file", "block", "n", F.size("ends").cast("long").alias("k"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    s = s.withColumn("part", F.expr(f"block div {scan_blocks}"))
    inner = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("n0", F.coalesce(F.sum("n").over(inner), F.lit(0))).withColumn("k0", F.coalesce(F.sum("k").over(inner), F.lit(0)))
    s = reuse(s.withColumn("stop", F.col("n0") + F.col("last")).withColumn("stop0", F.max("stop").over(inner)))
    parts = s.groupBy("file", "part").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.max("stop").alias("stop"), F.max("block").alias("top"))
    outer = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"pn": F.coalesce(F.sum("n").over(outer), F.lit(0)), "pk": F.coalesce(F.sum("k").over(outer), F.lit(0))})
    parts = reuse(parts.withColumn("whole", F.col("pn") + F.col("stop")).withColumn("pstop", F.max("whole").over(outer)))
    carried = s.join(parts.select("file", "part", "pn", "pk", "pstop"), ["file", "part"]).select(
        "file", "block", (F.col("pn") + F.col("n0")).alias("base"), (F.col("pk") + F.col("k0")).alias("seen"),
        (F.coalesce(F.col("pn") + F.col("stop0"), "pstop", F.lit(-1)) + 1).alias("begin"))
    d = m.where(F.size("ends") > 0).join(carried, ["file", "block"])
    d = d.select("file", "base", "seen", "begin", "ends", F.posexplode("ends").alias("i", "at"))
    begin = F.when(F.col("i") == 0, F.col("begin")).otherwise(F.col("base") + F.expr("ends[greatest(i - 1, 0)]") + 1)
    done = d.select("file", (F.col("seen") + F.col("i")).alias("ordinal"), begin.alias("start"), (F.col("base") + F.col("at") - begin).alias("n_tokens"), F.lit(True).alias("terminated"))
    tail = parts.groupBy("file").agg(F.sum("n").alias("n"), F.sum("k").alias("ordinal"), (F.coalesce(F.max("whole"), F.lit(-1)) + 1).alias("start"))
    tail = tail.where("n > start").select("file", "ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return done.unionByName(tail)


def _word_ids(text, below):
    """Stand-in ids of white-space separated words, two bytes each."""
    return np.array([xxhash.xxh32_intdigest(w) % below for w in text.split(b" ") if w], "<u2")


def write_token_files(docs: DataFrame, id_col="doc_id", text_col="text", end=END, block_bytes=BLOCK_BYTES, file_docs=FILE_DOCS):
    """(blocks, manifest): documents as flat token files and which document is which ordinal of its file.

    ``file_docs`` consecutive ids make a file, in id order (rows without an id are spread by content); a word is one 16-bit id below ``end``.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches):
        for b in batches:
            ids = [np.append(_word_ids(t.as_py() or b"", end), np.uint16(end)).astype("<u2").tobytes() for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ids, pa.binary())], names=["file", "doc_id", "digest", "ids"])

    spaced = F.translate(F.coalesce(F.col(text_col), F.lit("")), "\t\n\x0b\x0c\r", "     ").cast("binary")
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    file = F.when(F.col(id_col).isNotNull(), F.concat(F.lit("shard-"), F.floor(F.col(id_col) / file_docs).cast("string"))).otherwise(
        F.concat(F.lit("shard-x"), F.substring(digest, 1, 3)))
    coded = docs.select(file.alias("file"), F.col(id_col).alias("doc_id"), digest.alias("digest"), spaced.alias("text")).mapInArrow(
        encode, f"file string, doc_id {kind}, digest string, ids binary")

    def pack(batches):
        at, held, no = None, bytearray(), 0

        def out(rows):
            f, n, d = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.binary())], names=["file", "block", "data"])

        for b in batches:
            for f, ids in zip(b.column(0).to_pylist(), b.column(1)):
                if f != at:
                    if held:
                        yield out([(at, no, bytes(held))])
                    at, held, no = f, bytearray(), 0
                held += ids.as_buffer()
                while len(held) >= block_bytes:
                    yield out([(at, no, bytes(held[:block_bytes]))])
                    del held[:block_bytes]
                    no += 1
        if held:
            yield out([(at, no, bytes(held))])

    rows = coded.repartition("file").sortWithinPartitions("file", "doc_id", "digest")
    blocks = reuse(rows.select("file", "ids").mapInArrow(pack, "file string, block long, data binary"))
    named = docs.select(file.alias("file"), F.col(id_col).alias("doc_id"), digest.alias("digest"))
    order = Window.partitionBy("file").orderBy("doc_id", "digest")
    manifest = named.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long")).select("file", "ordinal", "doc_id")
    return blocks, manifest


def document_spans(docs: DataFrame, id_col="doc_id", text_col="text", **how) -> DataFrame:
    """One row per input row: doc_id, file, ordinal, start, n_tokens, from a scan of the flat files written of ``docs``.

    A null or empty text is a document of no tokens. Other columns are ignored; an empty table gives no rows.
    """
    blocks, manifest = write_token_files(docs, id_col, text_col, **how)
    return manifest.join(spans(blocks), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
