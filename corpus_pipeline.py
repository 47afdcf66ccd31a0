"""A training corpus from raw documents: filter, deduplicate, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and gives it to the next stage. All but
the last return the columns of ``documents``. A stage first deletes the intermediate tables that the stage before it wrote, whose result
is written by then; tables of others stay. An empty table passes every stage and stays empty, with the columns it has.
"""
from functools import wraps

from pyspark.sql import functions as F

from barweave.llm.bpe import round_trip
from barweave.llm.common import prepared, table
from barweave.llm.exact_dedup import drop_exact
from barweave.llm.mixing import mixed_documents
from barweave.llm.near_dedup import drop_near
from barweave.llm.quality import keep_good
from barweave.session import collecting, drop, release, store

#: The quality model, the signatures and the token ids are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


_BEFORE = []  # intermediate tables of the stage that ran last


def stage(fn):
    """Runs ``fn`` after the last stage's intermediate tables are gone, and notes its own."""
    @wraps(fn)
    def run_stage(spark, docs, sf_dir):
        release(_BEFORE)
        _BEFORE.clear()
        with collecting() as mine:
            out = fn(prepared(spark), docs, sf_dir)
        _BEFORE.extend(mine)
        return out
    return run_stage


@stage
def quality(spark, docs, sf_dir):
    """Documents the quality model does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


@stage
def exact(spark, docs, sf_dir):
    """Of documents equal but for the case of A-Z, the one with the largest doc_id."""
    return drop_exact(docs)


@stage
def near(spark, docs, sf_dir):
    """One document of each class of near-duplicates, the one with the smallest doc_id."""
    return drop_near(docs)


@stage
def mixing(spark, docs, sf_dir):
    """The mix of sources: documents as often as taken, cut ones with the length they then have in ``n_chars``, where the table has such a column."""
    mixed = mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else mixed


@stage
def encoding(spark, docs, sf_dir):
    """Token counts and digests of the ids and of the text they decode to, per row of the mix."""
    return round_trip(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing", mixing), ("byte-level BPE", encoding)]


def run(spark, sf_dir):
    """The stages applied to ``documents``. The last stage's input stays in the shared folder, as its result still reads it."""
    docs, path = table(prepared(spark), sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, new = store(stage(spark, docs, sf_dir))
        if path:
            drop(spark, path)
        path = new
    return STAGES[-1][1](spark, docs, sf_dir)
