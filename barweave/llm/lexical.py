"""Ranked lexical search by pipelined term partitioning.

The terms of the items are owned by successive stages, the rarest first. Documents are dealt into slices of bounded size, items into blocks.
A bundle holds one item in one slice: its terms still to come and sparse accumulators (document, score so far). Stage by stage the
bundles of a (slice, block) meet the postings that this stage owns of the same documents in a cogroup, which adds integer contributions and hands the
bundles on; the last one selects. Between stages an accumulator goes only if the terms to come cannot lift it over the tenth best that the
bundle holds already, so results are exact.

All documents are read once: a pass over whole texts counts terms and keeps the postings whose term may be one of an item (a bitmap of
fixed size tells; the join that follows is exact). No group grows with the data: a frequent term has its postings spread over all
slices, and slices are as many as rows or postings ask for. Final ranks are found by a window of which every task first keeps its own best.
"""
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reuse

TOP = 10
MARKS = 1 << 20  # bits of the bitmap of the items' terms
TIERS = (64, 16, 4)  # a stage owns the terms in at most one of so many documents; the last stage owns the rest
SLICE_ROWS, SLICE_POSTINGS, BLOCK_ITEMS = 4096, 250_000, 256
KNOWN_TERMS = 500_000
SCALE = 1_000_000  # no contribution of a term, per unit of weight, reaches this
NO_ID = 2 ** 63 - 1
#: Lower-cases A-Z; every other ASCII character but digits and a-z becomes a blank, so that a term is what stands between blanks.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text):
    """Terms of a text as UTF-8 bytes, in order: runs of ASCII letters, digits and all characters beyond ASCII; A-Z lower-cased."""
    return text.encode("utf-8").translate(_PLAIN).split(b" ") if text else []


def _counts(text):
    n = Counter(terms_of(text))
    n.pop(b"", None)
    return n


def _lists(lists, kind):
    flat = [v for x in lists for v in x]
    values = pa.array(flat, pa.binary()).cast(pa.string()) if kind == "string" else pa.array(flat, pa.int32())
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), values)


def counted(rows: DataFrame, id_col, text_col, marks=None) -> DataFrame:
    """Per row: row (a number of its own), id, n (terms with repeats), terms and their counts tfs; with ``marks`` only terms that hit the bitmap."""
    def run(batches):
        known = {}

        def wanted(t):
            if t not in known:
                if len(known) >= KNOWN_TERMS:
                    known.clear()
                h = zlib.crc32(t) % MARKS
                known[t] = bool(marks[h >> 3] & 1 << (h & 7))
            return known[t]

        for b in batches:
            n, terms, tfs = [], [], []
            for text in b.column(2).to_pylist():
                c = _counts(text)
                n.append(sum(c.values()))
                keep = list(c) if marks is None else [t for t in c if wanted(t)]
                terms.append(keep)
                tfs.append([c[t] for t in keep])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), _lists(terms, "string"), _lists(tfs, "int")],
                                             names=["row", "id", "n", "terms", "tfs"])

    id_ = F.col(id_col).cast("long")
    numbered = rows.select((F.monotonically_increasing_id() * 2 + id_.isNull().cast("int")).alias("row"), F.coalesce(id_, F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    return numbered.mapInArrow(run, "row long, id long, n long, terms array<string>, tfs array<int>")


def _bitmap(items: DataFrame) -> bytes:
    """A bit per hash value that a term of an item has: at most ``MARKS`` numbers reach the driver."""
    bits = np.zeros(MARKS, np.uint8)
    hit = items.select(F.explode("terms").alias("t")).select((F.crc32(F.col("t").cast("binary")) % MARKS).alias("h")).distinct()
    bits[hit.toArrow().column(0).to_numpy()] = 1
    return np.packbits(bits, bitorder="little").tobytes()


BUNDLE = "slice int, block int, item long, item_id long, stages array<int>, nos array<long>, tfs array<int>, weights array<long>, rows array<long>, ids array<long>, scores array<long>"
RANKED = "item long, item_id long, row long, id long, score long"


def _flat(lists):
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0, np.int64)


def _cuts(lists):
    """Where each list begins in ``_flat``, and the end."""
    return np.cumsum([0, *(len(x) for x in lists)]).tolist()


def _stage(stage, last, top):
    """The cogroup of one stage: bundles of a (slice, block) and the postings (no, row, id, part) that the stage owns there."""
    def run(bundles, postings):
        no = postings.column("no").to_numpy()
        order = np.argsort(no, kind="stable")
        no, row = no[order], postings.column("row").to_numpy()[order]
        part, ids = postings.column("part").to_numpy()[order], postings.column("id").to_numpy()[order]
        numbers, first, place = np.unique(row, return_index=True, return_inverse=True)
        ids, bests = ids[first], []
        held = [[], [], []]
        plan = bundles.select(["item", "item_id", "stages", "nos", "tfs", "weights"]).to_pylist()
        had_rows, had_ids, had_scores, cuts = *(_flat(bundles.column(c)) for c in ("rows", "ids", "scores")), _cuts(bundles.column("rows"))
        for b, lo, hi in zip(plan, cuts, cuts[1:]):
            gained = np.zeros(len(numbers), np.int64)
            for i in (i for i, s in enumerate(b["stages"]) if s == stage):
                x, y = np.searchsorted(no, b["nos"][i], "left"), np.searchsorted(no, b["nos"][i], "right")
                gained[place[x:y]] += part[x:y] * b["tfs"][i]  # a term has one posting per document
            had, score = had_rows[lo:hi], had_scores[lo:hi].copy()
            if len(had) and len(numbers):
                at = np.minimum(np.searchsorted(numbers, had), len(numbers) - 1)
                met = numbers[at] == had
                score[met] += gained[at[met]]
                gained[at[met]] = 0
            new = np.flatnonzero(gained)
            rows, doc, score = np.concatenate([had, numbers[new]]), np.concatenate([had_ids[lo:hi], ids[new]]), np.concatenate([score, gained[new]])
            if last:
                best = np.lexsort((rows, doc, -score))[:top]
                bests += [(b["item"], b["item_id"], *t) for t in zip(rows[best].tolist(), doc[best].tolist(), score[best].tolist())]
                continue
            left = [i for i, s in enumerate(b["stages"]) if s > stage]
            if len(score) > top:
                bar = np.partition(score, len(score) - top)[len(score) - top] - sum(b["weights"][i] * b["tfs"][i] for i in left) * SCALE
                rows, doc, score = rows[score >= bar], doc[score >= bar], score[score >= bar]
            b |= {k: [b[k][i] for i in left] for k in ("stages", "nos", "tfs", "weights")}
            for kept, v in zip(held, (rows, doc, score)):
                kept.append(v)
        if last:
            return pa.table({n: pa.array([r[i] for r in bests], pa.int64()) for i, n in enumerate(("item", "item_id", "row", "id", "score"))})
        out = bundles.select(["slice", "block", "item", "item_id"])
        for k in ("stages", "nos", "tfs", "weights"):
            out = out.append_column(k, pa.array([b[k] for b in plan], bundles.schema.field(k).type))
        ends = pa.array(np.cumsum([0, *map(len, held[0])]), pa.int32())
        for k, v in zip(("rows", "ids", "scores"), held):
            out = out.append_column(k, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(v) if v else np.zeros(0, np.int64))).cast(bundles.schema.field(k).type))
        return out
    return run


def search(docs: DataFrame, items: DataFrame, top=TOP, item_col="item_id", item_text="text", id_col="doc_id", text_col="text", tiers=TIERS, slice_rows=SLICE_ROWS, slice_postings=SLICE_POSTINGS, block_items=BLOCK_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents with the highest positive score for each row of ``items``, equal scores by doc_id.

    Each row of ``items`` is an item and each row of ``docs`` a document of its own, also where ids or texts repeat; ids are whole numbers. A null
    or empty text has no terms: such an item gets no row, such a document is in no result and not counted. Null ids stay null and come last
    among equal scores. Empty tables give no rows; other columns are ignored.
    """
    asked = reuse(counted(items, item_col, item_text).where("n > 0"))
    found = reuse(counted(docs, id_col, text_col, _bitmap(asked)))
    total = found.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("words"), F.sum(F.size("terms")).alias("postings"), F.count(F.lit(1)).alias("rows")).first()
    n_docs, words = total["docs"], total["words"] or 0
    blocks = -(-asked.count() // block_items) or 1
    slices = max(1, -(-total["rows"] // slice_rows), -(-(total["postings"] or 0) // slice_postings))

    postings = found.select("row", "id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("row", "id", "n", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    queried = asked.select("row", "id", (F.pmod(F.xxhash64("row"), F.lit(blocks))).cast("int").alias("block"), F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(
        "row", "id", "block", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stage = F.lit(len(tiers))
    for k, share in reversed(list(enumerate(tiers))):
        stage = F.when(F.col("df") * share <= n_docs, k).otherwise(stage)
    owned = reuse(queried.groupBy("term").agg(F.collect_set("block").alias("blocks")).join(df, "term").select(
        "term", "blocks", "df", F.monotonically_increasing_id().alias("no"), stage.cast("int").alias("stage"),
        F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long").alias("weight")))

    none = F.expr("CAST(array() AS array<long>)")
    bundles = (queried.join(owned.select("term", "no", "stage", "weight"), "term")
               .groupBy("block", F.col("row").alias("item"), F.col("id").alias("item_id")).agg(F.collect_list(F.struct("stage", "no", "tf", "weight")).alias("t"))
               .select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "block", "item", "item_id", F.col("t.stage").alias("stages"), F.col("t.no").alias("nos"),
                       F.col("t.tf").alias("tfs"), F.col("t.weight").alias("weights"), none.alias("rows"), none.alias("ids"), none.alias("scores")))
    m = F.expr(f"100 - 75 + ((75 * n * {n_docs}L) div {max(words, 1)}L)")
    for k in range(len(tiers) + 1):
        last = k == len(tiers)
        mine = (postings.join(owned.where(F.col("stage") == k), "term").withColumn("m", m)
                .select(F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int").alias("slice"), F.explode("blocks").alias("block"), "no", "row", "id",
                        F.expr("weight * ((1000000000L * tf) div (1000L * tf + 8 * m))").alias("part")))
        bundles = bundles.groupBy("slice", "block").cogroup(mine.groupBy("slice", "block")).applyInArrow(_stage(k, last, top), RANKED if last else BUNDLE)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "id", "row")
    ranked = bundles.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.when(F.col("item") % 2 == 0, F.col("item_id")).alias("item_id"), "rank", F.when(F.col("row") % 2 == 0, F.col("id")).alias("doc_id"), "score")
