"""Near-duplicates by SimHash, with pigeonring filtering of the candidates.

A fingerprint of 64 bits is a ring of max_bits + 1 segments. If two fingerprints differ in at
most max_bits bits, then from some segment on every chain of k consecutive segments differs in
at most k - 1 bits: the first not at all, the first two in one bit, and so on round the ring.
Candidates are met by the first two segments of such a chain at once, one of the two sides also
trying each single change of the second segment. Pairs that meet must pass the whole chain, and
then the full Hamming check. Where many fingerprints meet in one key, the third segment joins the
key, both sides trying the single changes that the chain allows them; groups are then bounded
and no pair is lost.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from querytide.llm.common import fresh, one_row_each, prepare, text_bytes
from querytide.llm.components import components
from querytide.session import write_and_read

#: A key that more fingerprints share is split by the next segment.
CROWDED = 64


def fingerprint(text: bytes, width: int) -> int:
    """The SimHash of a text's shingles of `width` words, as a signed 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: 1 - width or None], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(64, "i8")
    for at in range(0, len(starts), 16384):
        pairs = zip(starts[at : at + 16384].tolist(), ends[at : at + 16384].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in pairs], "<u8")
        ones += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def fingerprint_of(text: Column, width: int) -> Column:
    @arrow_udf("long")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, width) for t in text_bytes(values)], pa.int64())

    return run(text.cast("string"))


def _signed(bits: int) -> int:
    return bits - 2**64 if bits >= 2**63 else bits


def _ring(max_bits: int) -> list[tuple[int, list[int]]]:
    """Mask and single bits of each segment."""
    segments = max_bits + 1
    cuts = [64 * k // segments for k in range(segments + 1)]
    return [
        (_signed(sum(1 << b for b in range(low, high))), [_signed(1 << b) for b in range(low, high)])
        for low, high in zip(cuts, cuts[1:])
    ]


def _moves(ring: list[tuple[int, list[int]]], flips: bool) -> Column:
    """Literal rows (start, mask, flip) for the chains' first two segments."""
    rows = []
    for start, (mask, _) in enumerate(ring):
        second, bits = ring[(start + 1) % len(ring)]
        rows += [(start, mask | second, flip) for flip in [0, *(bits if flips else [])]]
    return F.array(*[
        F.struct(F.lit(s).alias("start"), F.lit(m).cast("long").alias("mask"), F.lit(f).cast("long").alias("flip"))
        for s, m, f in rows
    ])


def _keys(prints: DataFrame, ring: list, flips: bool) -> DataFrame:
    moved = prints.select("fp", F.explode(_moves(ring, flips)).alias("move")).select("fp", "move.*")
    # Only a zero bit is changed: of two fingerprints that differ there, one has the zero.
    return moved.filter(F.col("fp").bitwiseAND(F.col("flip")) == 0).select(
        "fp", "start", F.col("fp").bitwiseAND(F.col("mask")).bitwiseOR(F.col("flip")).alias("key"), "flip"
    )


def _split_crowded(keys: DataFrame, crowded: DataFrame, ring: list) -> DataFrame:
    """Add the third segment of the chain to the key where the key is crowded."""
    keys = keys.join(crowded, ["start", "key"], "left")
    split = F.array(F.lit(0).cast("long"))
    for start in range(len(ring)):
        mask, bits = ring[(start + 2) % len(ring)]
        exact = F.col("fp").bitwiseAND(F.lit(mask).cast("long"))
        near = F.array(exact, *[exact.bitwiseXOR(F.lit(b).cast("long")) for b in bits])
        tried = F.when(F.col("flip") == 0, near).otherwise(F.array(exact))
        split = F.when(F.col("crowded") & (F.col("start") == start), tried).otherwise(split)
    return keys.select("fp", "start", "key", F.explode(split).alias("rest"))


def links(prints: DataFrame, max_bits: int) -> DataFrame:
    """All pairs (a, b) of the distinct values of `fp` at most `max_bits` bits apart.

    A pair may come more than once, in either direction.
    """
    if max_bits < 1:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    ring = _ring(max_bits)
    indexed, probing = _keys(prints, ring, False), _keys(prints, ring, True)
    if max_bits >= 2:
        many = indexed.groupBy("start", "key").count().filter(F.col("count") > CROWDED)
        crowded = write_and_read(many.select("start", "key", F.lit(True).alias("crowded")), "crowded")
        indexed, probing = (_split_crowded(k, crowded, ring) for k in (indexed, probing))
        on = ["start", "key", "rest"]
    else:
        on = ["start", "key"]
    # Each fingerprint has dozens of keys, but Spark sizes them like the fingerprints and would broadcast
    # them, be it only once it has seen that no key is crowded.
    met = indexed.withColumnRenamed("fp", "a").join(probing.withColumnRenamed("fp", "b").hint("merge"), on)
    apart = F.col("a").bitwiseXOR(F.col("b"))
    parts = [F.bit_count(apart.bitwiseAND(F.lit(mask).cast("long"))) for mask, _ in ring]
    chains = [
        reduce(
            lambda x, y: x & y,
            [sum((parts[(s + i) % len(ring)] for i in range(1, k)), parts[s]) <= k - 1 for k in range(1, len(ring))],
            F.col("start") == s,
        )
        for s in range(len(ring))
    ]
    chained = met.filter(F.col("a") != F.col("b")).filter(reduce(lambda x, y: x | y, chains))
    return chained.filter(F.bit_count(apart) <= max_bits).select("a", "b")


def _classes(rows: DataFrame, max_bits: int) -> DataFrame:
    """`fp` and `root`, the smallest fingerprint reachable, for all distinct fingerprints."""
    prints = write_and_read(rows.select("fp").distinct(), "prints")
    roots = components(links(prints, max_bits)).withColumnRenamed("node", "fp")
    return prints.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 2) -> DataFrame:
    """`doc_id`, `fingerprint` and `component_id`, the smallest doc_id reachable, for every row.

    A null or empty text, or one of white space, has the fingerprint zero and is linked like any
    other; a text of fewer words than `width` has one shingle, its whole sequence. Rows with a
    null doc_id belong to a component but do not name it, unless it has no other rows: then its
    component_id is null. Repeated rows stay repeated. Other columns are not read; an empty table
    gives an empty table.
    """
    prepare(docs.sparkSession)
    rows = write_and_read(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_of(F.col("text"), width).alias("fp")),
        "fingerprints",
    )
    classes = write_and_read(_classes(rows, max_bits), "classes")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first")).join(classes, "fp")
    named = write_and_read(first.groupBy("root").agg(F.min("first").alias("component_id")), "named")
    member = write_and_read(classes.join(named, "root").select("fp", "component_id"), "members")
    return rows.join(member, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, width: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of `docs` for each component, with all its columns: that of the smallest doc_id.

    A null doc_id comes last; between rows of one doc_id the hash of the text decides, and of
    rows that repeat each other whole one stays.
    """
    prepare(docs.sparkSession)
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = write_and_read(
        docs.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("hash"), fingerprint_of(F.col("text"), width).alias("fp")),
        "fingerprints",
    )
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash")).alias("best")
    per_print = rows.groupBy("fp").agg(best).join(_classes(rows, max_bits), "fp")
    stays = per_print.groupBy("root").agg(F.min("best").alias("best")).select("best.doc_id", "best.hash")
    stays = write_and_read(stays.withColumnsRenamed({"doc_id": "_stays_id", "hash": "_stays_hash"}), "stays")
    hashed = fresh(docs, "hash")
    first = one_row_each(docs.withColumn(hashed, F.xxhash64(text)), [doc_id, F.col(hashed)], [F.lit(0)])
    same = doc_id.eqNullSafe(stays["_stays_id"]) & (F.col(hashed) == stays["_stays_hash"])
    return first.join(stays, same, "left_semi").select(*[docs[c] for c in docs.columns])
