"""Exact deduplication by composable polynomial fingerprints.

A text is a polynomial in its bytes modulo two primes. Parts of it are hashed on their own, many at a time as a
matrix product, and combine by H(ab) = H(a) * B^|b| + H(b): a part's share is its hash times B to the number of bytes
behind it, so a document's fingerprint is a plain sum over its parts, wherever they were hashed. Documents whose
fingerprint and length occur more than once are compared part by part: equal parts collapse before the shuffle, and a
fingerprint is trusted when each of its part numbers has one content. Where one has more, documents are told apart by
their contents.
"""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reuse
from .common import same, stayers, text_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PRIMES = (2147483647, 2147483629)
BASES = (1103515249, 1664525013)
PART_BYTES = 1 << 20
LINE = 1024  # bytes hashed by one row of the matrix product; 255 * prime * LINE stays below 2^53, so floats are exact
BLOCK_LINES = 4096
FP = ["fp_a", "fp_b", "n_bytes"]
_LUT = np.arange(256, dtype=np.uint8)
_LUT[65:91] += 32


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _powers(base, prime, n):
    out = np.ones(n, dtype=np.uint64)
    for i in range(1, n):
        out[i] = out[i - 1] * base % prime
    return out


def shift(base, prime, exponents):
    """base ** exponents mod prime for an array of exponents, by squaring."""
    out, sq, e = np.ones(len(exponents), dtype=np.uint64), np.uint64(base), np.asarray(exponents, dtype=np.uint64).copy()
    p = np.uint64(prime)
    while e.any():
        odd = (e & np.uint64(1)).astype(bool)
        out[odd] = out[odd] * sq % p
        sq = sq * sq % p
        e >>= np.uint64(1)
    return out


class Hasher:
    """Polynomial hashes of many byte ranges of one buffer at a time."""

    def __init__(self, bases=BASES, primes=PRIMES):
        self.bases, self.primes = bases, primes
        self.lines = [_powers(b, p, LINE)[::-1].astype(np.float64) for b, p in zip(bases, primes)]
        self.weights = np.stack(self.lines, axis=1)

    def __call__(self, buf, starts, ends):
        """One row of hashes (a column per prime) for each range; an empty range hashes to 0."""
        starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
        n_lines = -(-(ends - starts) // LINE)
        first = np.concatenate([[0], np.cumsum(n_lines)])
        lines = np.zeros((int(first[-1]), len(self.primes)), dtype=np.uint64)
        mods = np.array(self.primes, dtype=np.float64)
        i = 0
        while i < len(starts):  # ranges are padded in front with zeros, which do not change the polynomial
            j = max(i + 1, int(np.searchsorted(first, first[i] + BLOCK_LINES, side="right")) - 1)
            flat = np.zeros(int(first[j] - first[i]) * LINE, dtype=np.uint8)
            for k in range(i, j):
                if n_lines[k]:
                    end = int(first[k + 1] - first[i]) * LINE
                    flat[end - int(ends[k] - starts[k]):end] = buf[starts[k]:ends[k]]
            for a in range(0, len(flat) // LINE, BLOCK_LINES):
                block = flat.reshape(-1, LINE)[a:a + BLOCK_LINES].astype(np.float64)
                lines[first[i] + a:first[i] + a + len(block)] = (block @ self.weights % mods).astype(np.uint64)
            i = j
        out = np.zeros((len(starts), len(self.primes)), dtype=np.uint64)
        full = np.flatnonzero(n_lines)
        if len(full):
            behind = np.repeat(first[1:], n_lines) - 1 - np.arange(first[-1])
            for c, (b, p) in enumerate(zip(self.bases, self.primes)):
                step = int(shift(b, p, [LINE])[0])
                out[full, c] = np.add.reduceat(lines[:, c] * shift(step, p, behind) % np.uint64(p), first[:-1][full]) % np.uint64(p)
        return out


def combine(left, right, right_bytes, bases=BASES, primes=PRIMES):
    """The fingerprint of two texts joined, from theirs and the length of the second."""
    return tuple((int(a) * pow(b, int(right_bytes), p) + int(c)) % p for a, c, b, p in zip(left, right, bases, primes))


def _part_rows(part_bytes, bases, primes):
    def run(batches):
        hasher = Hasher(bases, primes)
        for batch in batches:
            if not batch.num_rows:
                continue
            text = batch.column(2).cast(pa.large_binary())
            off = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
            raw = text.buffers()[2]
            buf = _LUT[np.frombuffer(raw, np.uint8)] if raw is not None and raw.size else np.zeros(0, np.uint8)
            view = memoryview(buf)
            n = np.diff(off)
            sha = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(off[:-1], off[1:])]
            parts = np.maximum(1, -(-n // part_bytes))
            row = np.repeat(np.arange(len(n)), parts)
            no = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = no * part_bytes
            end = np.minimum(start + part_bytes, n[row])
            h = hasher(buf, off[row] + start, off[row] + end)
            for c, (b, p) in enumerate(zip(bases, primes)):
                h[:, c] = h[:, c] * shift(b, p, n[row] - end) % np.uint64(p)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(n[row]), pa.array(sha, pa.string()).take(take),
                 pa.array(no), pa.array(h[:, 0].astype(np.int64)), pa.array(h[:, 1].astype(np.int64))],
                names=["doc_id", "text_key", "n_bytes", "text_sha256", "part", "h_a", "h_b"])
    return run


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", part_bytes=PART_BYTES, bases=BASES, primes=PRIMES) -> DataFrame:
    """One row per (document, lower-cased text): doc_id, text_key, n_bytes, text_sha256, fp_a, fp_b and n_rows, its repeated rows."""
    src = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"),
                      F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("bytes"))
    kind = src.schema["doc_id"].dataType.simpleString()
    parts = src.mapInArrow(_part_rows(part_bytes, bases, primes),
                           f"doc_id {kind}, text_key long, n_bytes long, text_sha256 string, part long, h_a long, h_b long")
    n = F.count_if(F.col("part") == 0)

    # Repeated rows are divided out before the modulus: their sums are equal, so the division is exact.
    return (parts.groupBy("doc_id", "n_bytes", "text_sha256")
            .agg(F.min("text_key").alias("text_key"), F.sum(F.col("h_a").cast("decimal(38,0)")).alias("sa"), F.sum(F.col("h_b").cast("decimal(38,0)")).alias("sb"), n.alias("n_rows"))
            .select("doc_id", "text_key", "n_bytes", "text_sha256", "n_rows",
                    F.expr(f"cast((sa div n_rows) % {primes[0]} as long)").alias("fp_a"),
                    F.expr(f"cast((sb div n_rows) % {primes[1]} as long)").alias("fp_b")))


def _parts(df, text, part_bytes):
    raw = F.encode(lowered(F.col(text)), "UTF-8")
    df = df.withColumn("_raw", raw)
    return df.select(
        *[c for c in df.columns if c not in (text, "_raw")],
        F.posexplode(F.expr(f"transform(sequence(0, greatest(0, cast((octet_length(_raw) - 1) div {part_bytes} as int))), "
                            f"i -> substring(_raw, i * {part_bytes} + 1, {part_bytes}))")).alias("part", "content"))


def classes(docs: DataFrame, id_col="doc_id", text_col="text", part_bytes=PART_BYTES, bases=BASES, primes=PRIMES) -> DataFrame:
    """One row per (document, text) with its group of equal texts.

    Columns: doc_id, text_key, n_rows, text_sha256, keep_id, group_size. Texts are equal when identical after lower-casing A-Z only;
    a null text counts as empty. ``keep_id`` is the largest doc_id of the group (null only if all of its ids are null).
    """
    rows = reuse(fingerprints(docs, id_col, text_col, part_bytes, bases, primes))
    groups = reuse(rows.groupBy(*FP).agg(F.sum("n_rows").alias("group_size"), F.max("doc_id").alias("keep_id"), F.count("*").alias("texts"))
                   .where("group_size > 1"))
    # Members travel by document, not by fingerprint, so a group of copies does not meet in one task; equal parts then collapse
    # before they are shuffled by content.
    members = rows.select("doc_id", "text_key", *FP).join(groups.where("texts > 1").select(*FP), FP)
    texts = docs.select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_key"), F.col(text_col).alias("_text"))
    compared = (texts.join(members, same(F.col("_id"), F.col("doc_id")) & (F.col("_key") == F.col("text_key")))
                .select("doc_id", "text_key", *FP, "_text"))
    contents = reuse(_parts(compared, "_text", part_bytes).groupBy(*FP, "part", "content").agg(F.min(F.struct("doc_id", "text_key")).alias("variant"))
                     .groupBy(*FP, "part").agg(F.count("*").alias("variants")).where("variants > 1").select(*FP).distinct())
    if contents.isEmpty():
        found = rows.join(groups.select(*FP, "group_size", "keep_id"), FP, "left")
        size, keep = F.coalesce(F.col("group_size"), F.col("n_rows")), F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
        return found.select("doc_id", "text_key", "n_rows", "text_sha256", keep.alias("keep_id"), size.alias("group_size"))
    return _told_apart(rows, compared, contents, part_bytes)


def _told_apart(rows, compared, collided, part_bytes):
    """Groups where some fingerprints stand for several texts: there a text is named by the first document with each of its parts."""
    parts = _parts(compared.join(collided, FP), "_text", part_bytes)
    first = parts.groupBy(*FP, "part", "content").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    named = (parts.join(first, [*FP, "part", "content"]).groupBy("doc_id", "text_key", *FP)
             .agg(F.array_sort(F.collect_set(F.struct("part", "first"))).alias("contents")))
    named = named.select("doc_id", "text_key", F.to_json("contents").alias("contents"))
    keyed = reuse(rows.alias("r").join(named.alias("n"), same(F.col("r.doc_id"), F.col("n.doc_id")) & (F.col("r.text_key") == F.col("n.text_key")), "left")
                  .select("r.*", F.coalesce("contents", F.lit("")).alias("contents")))
    size = reuse(keyed.groupBy(*FP, "contents").agg(F.sum("n_rows").alias("group_size"), F.max("doc_id").alias("keep_id")))
    return keyed.join(size, [*FP, "contents"]).select("doc_id", "text_key", "n_rows", "text_sha256", "keep_id", "group_size")


def exact_groups(docs: DataFrame, id_col="doc_id", text_col="text", **how) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays; of rows that repeat one doc_id and text, one stays. Null ids rank
    below all others. Other columns of ``docs`` are ignored; an empty table gives no rows.
    """
    c = classes(docs, id_col, text_col, **how)
    return (c.withColumn("copy", F.explode(F.expr("sequence(1L, n_rows)")))
            .select("doc_id", "keep_id", "group_size", (same(F.col("doc_id"), F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256"))


def drop_exact(docs: DataFrame, id_col="doc_id", text_col="text", **how) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return stayers(docs, id_col, text_col, text_key, lambda d, i, t: classes(d, i, t, **how).where(same(F.col("doc_id"), F.col("keep_id"))).select(
        "doc_id", F.col("text_key").alias("key"), "n_rows"))
