"""URL filters: rules first, then a likelihood ratio of two character language models.

One model is learned from the URLs that the rules allow, one from those they block. Both are
variable-order Markov models: the probability of a character blends the counts of all contexts
from the longest down, each context leaning on the next shorter one. Counts are exact and live in
tables that grow with the URLs they are learned from; contexts to be scored are joined to them,
each distinct one once. A URL that no rule fits is
allowed if the length-normalised difference of its log-likelihoods reaches a threshold that is
calibrated on ruled URLs kept apart from learning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.llm.common import prepare, text_bytes
from querytide.session import write_and_read


#: Pages scored in one group at most.
CHUNK_ROWS = 1024


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains where the path starts with `path`."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class ModelParams:
    #: Bytes of context at most; up to 5, so that a context with its next byte fits a long.
    order: int = 5
    #: Without effect, as counts are exact; callers may still set it.
    slots: int = 2**17
    #: Weight of a shorter context in the next longer one.
    lean: float = 4.0
    #: Bins of the calibration histogram, over score differences of -span to span a character.
    bins: int = 400
    span: float = 8.0

    def __post_init__(self):
        if not 0 <= self.order <= 5:
            raise ValueError("order is 0 to 5")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty without `://` or URL.

    The host ends at `/`, `?` or `#`, the path at `?` or `#`.
    """
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does; of equals the first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.name))):
        inside = (host == rule.host) | host.endswith("." + rule.host)
        fits = inside & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit("allow" if rule.allow else "block")).otherwise(verdict)
    return name, verdict


#: Bits of a byte in a key (0 stands for what is before the beginning), and where the context's length is.
_BITS, _LENGTH = 9, 54


def _slots(data: np.ndarray, starts: np.ndarray, order: int, slots: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each context length up to `order`, the keys of contexts and of contexts with a byte.

    `data` is the bytes of all URLs, `starts` the position each byte's URL begins at. A context
    that would reach over the beginning of its URL is filled up with zeros. Keys are the bytes
    themselves and the length, so no two contexts share one; `slots` has no effect.
    """
    at = np.arange(len(data))
    value = data.astype("i8") + 1
    context = np.zeros(len(data), "i8")
    for length in range(order + 1):
        if length:
            back = at - length
            before = np.where(back >= starts, value[np.maximum(back, 0)], 0)
            context = context | (before << (_BITS * (length - 1)))
        joint = (context << _BITS) | value | (length << _LENGTH)
        yield joint >> _BITS, joint


def _laid_out(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(u) for u in urls], "i8")
    begins = np.cumsum(lengths) - lengths
    return np.frombuffer(b"".join(urls), "u1"), np.repeat(begins, lengths), lengths


@dataclass(frozen=True)
class Models:
    """Tables of contexts (`context`) and contexts with a byte (`joint`), and the threshold.

    Both have the counts of each class, `blocked` and `allowed`.
    """

    contexts: DataFrame
    joints: DataFrame
    params: ModelParams
    threshold: float = 0.0

    def score(self, urls: list[bytes]) -> np.ndarray:
        """The scores of a few URLs; see `scored`."""
        rows = self.joints.sparkSession.createDataFrame([(k, 0, u) for k, u in enumerate(urls)], "at long, chunk long, url binary")
        return np.array([r["score"] for r in self.scored(rows).orderBy("at").collect()])

    def scored(self, rows: DataFrame) -> DataFrame:
        """`rows` with `score` in place of `chunk` and `url`.

        The score is the difference of the log-likelihoods, allowed less blocked, a byte; 0 if
        empty. Rows that share a `chunk` are scored in one group. A chunk asks once for each of its
        distinct longest contexts with a byte, so a frequent one counts no more than there are chunks.
        """
        order = self.params.order

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                chunks = batch.column("chunk").to_numpy(zero_copy_only=False)
                urls = text_bytes(batch.column("url"))
                for chunk in np.unique(chunks):
                    data, starts, _ = _laid_out([urls[k] for k in np.flatnonzero(chunks == chunk)])
                    grams = np.unique(_longest(data, starts, order))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), chunk)), pa.array(grams)], ["chunk", "joint"])

        met = rows.select("chunk", "url").mapInArrow(distinct, "chunk long, joint long").distinct()
        met = write_and_read(met, "url-contexts")
        found = met.join(self._differences(met.select("joint").distinct()), "joint")
        kept = [c for c in rows.columns if c not in ("chunk", "url")]

        def score(own: pa.Table, known: pa.Table) -> pa.Table:
            data, starts, lengths = _laid_out(text_bytes(own.column("url").combine_chunks()))
            grams, values = known.column("joint").to_numpy(), known.column("difference").to_numpy()
            ordered = np.argsort(grams)
            at = np.searchsorted(grams[ordered], _longest(data, starts, order))
            sums = np.concatenate(([0.0], np.cumsum(values[ordered][at])))
            ends = np.cumsum(lengths)
            scores = (sums[ends] - sums[ends - lengths]) / np.maximum(lengths, 1)
            return own.select(kept).append_column("score", pa.array(scores, pa.float64()))

        schema = rows.select(*kept, F.lit(0.0).alias("score")).schema
        return rows.groupBy("chunk").cogroup(found.select("chunk", "joint", "difference").groupBy("chunk")).applyInArrow(score, schema)

    def _differences(self, grams: DataFrame) -> DataFrame:
        """`joint` and the `difference` of the classes' log-probabilities, of distinct longest `joint`s.

        Every length asks for distinct keys, so no context is met more often than there are bytes
        to follow it, and no shorter one more often than there are bytes to go before it.
        """
        lean, order = F.lit(float(self.params.lean)), self.params.order
        levels = [F.col("joint").bitwiseAND((1 << _BITS * (k + 1)) - 1).bitwiseOR(k << _LENGTH) for k in range(order + 1)]
        keys = grams.select(F.explode(F.array(*levels)).alias("joint")).distinct()
        counts = self.joints.select("joint", *(F.col(c).alias(f"n_{c}") for c in _CLASSES))
        around = self.contexts.select("context", *(F.col(c).alias(f"c_{c}") for c in _CLASSES))
        looked = keys.join(counts, "joint", "left").withColumn("context", F.shiftright("joint", _BITS)).join(around, "context", "left")
        looked = looked.select("joint", F.shiftright("joint", _LENGTH).alias("length"), *(f"{x}_{c}" for x in "nc" for c in _CLASSES)).fillna(0)
        looked = write_and_read(looked, "url-counts")
        shares = None
        for k in range(order + 1):
            level = looked.filter(F.col("length") == k)
            if shares is None:
                level = level.select("*", *(F.lit(1 / 256).alias(f"p_{c}") for c in _CLASSES))
            else:
                shorter = F.col("joint").bitwiseAND((1 << _BITS * k) - 1).bitwiseOR((k - 1) << _LENGTH)
                level = level.withColumn("shorter", shorter).join(shares.withColumnRenamed("joint", "shorter"), "shorter")
            p = [((F.col(f"n_{c}") + lean * F.col(f"p_{c}")) / (F.col(f"c_{c}") + lean)).alias(f"p_{c}") for c in _CLASSES]
            shares = level.select("joint", *p)
        return shares.select("joint", (F.log("p_allowed") - F.log("p_blocked")).alias("difference"))


#: The classes in the order of `allowed`.
_CLASSES = ("blocked", "allowed")


def _longest(data: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """The key of every byte with its longest context."""
    *_, (_, joint) = _slots(data, starts, order)
    return joint


def _counted(urls: DataFrame, params: ModelParams) -> tuple[DataFrame, DataFrame]:
    """The tables of `Models` from all rows (`url`, `allowed`); each batch adds up its own before they meet."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind in (0, 1):
                chosen = batch.filter(pa.compute.equal(batch.column("allowed"), bool(kind)))
                data, starts, _ = _laid_out(text_bytes(chosen.column("url")))
                keys, n = np.unique(np.concatenate([joint for _, joint in _slots(data, starts, params.order)]), return_counts=True)
                sides = [n, np.zeros_like(n)] if kind == 0 else [np.zeros_like(n), n]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype("i8")) for x in (keys, *sides)], ["joint", *_CLASSES])

    sums = [F.sum(c).alias(c) for c in _CLASSES]
    counted = urls.select("url", "allowed").mapInArrow(count, "joint long, blocked long, allowed long")
    joints = write_and_read(counted.groupBy("joint").agg(*sums), "url-joints")
    contexts = joints.groupBy(F.shiftright("joint", _BITS).alias("context")).agg(*sums)
    return write_and_read(contexts, "url-contexts"), joints


def _apart(url: Column) -> Column:
    """True for the fifth of ruled URLs that the threshold is calibrated on."""
    return F.pmod(F.xxhash64(url), F.lit(5)) == 0


def learn(urls: DataFrame, params: ModelParams = ModelParams()) -> Models:
    """Models from all rows (`url`, `allowed`) but the fifth that a hash sets apart for `calibrated`."""
    prepare(urls.sparkSession)
    return Models(*_counted(urls.filter(~_apart(F.col("url"))), params), params)


def calibrated(scored: DataFrame, params: ModelParams = ModelParams()) -> float:
    """The threshold from rows (`score`, `allowed`).

    Only a histogram reaches the driver. The threshold makes the shares of wrong verdicts in the
    two classes add up to the least, in the middle of a tie; it is 0 where a class is missing.
    """
    width = 2 * params.span / params.bins
    cell = F.least(F.greatest(F.floor((F.col("score") + params.span) / width), F.lit(0)), F.lit(params.bins - 1))
    histogram = scored.groupBy("allowed", cell.alias("cell")).count().toPandas()
    counts = np.zeros((2, params.bins))
    counts[histogram["allowed"].to_numpy("i8"), histogram["cell"].to_numpy("i8")] = histogram["count"].to_numpy("f8")
    if not counts.sum(axis=1).all():
        return 0.0
    below = np.concatenate((np.zeros((2, 1)), counts.cumsum(axis=1)), axis=1) / counts.sum(axis=1, keepdims=True)
    wrong = below[1] + 1 - below[0]
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(best[len(best) // 2] * width - params.span)


def judge(pages: DataFrame, rules: list[Rule], params: ModelParams = ModelParams()) -> DataFrame:
    """`page_id`, `host`, `path`, `rule`, `verdict` and the models' `score` of every page.

    Rules look at host and path, models at the whole URL. The score is null where a rule decides. A
    null URL, or one without `://`, has an empty host and path and fits no rule with a host; a null
    or empty URL scores 0. A rule that no URL fits teaches nothing;
    with one class only, or none, the threshold is 0 and scores of 0 and more are allowed.
    Repeated rows stay repeated, null page_ids stay null, columns beside page_id and url are not
    read. An empty table gives an empty table.
    """
    prepare(pages.sparkSession)
    host, path = host_and_path(F.col("url").cast("string"))
    whole = F.coalesce(F.col("url").cast("string"), F.lit(""))
    cut = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"), whole.alias("url"))
    name, verdict = ruled(rules, F.col("host"), F.col("path"))
    # Chunks of rows that follow each other; written, so that they stay as they are.
    chunk = F.floor(F.monotonically_increasing_id() / CHUNK_ROWS).alias("chunk")
    known = write_and_read(cut.select("*", name.alias("rule"), verdict.alias("ruled"), chunk), "ruled-urls")
    models = learn(known.filter("ruled IS NOT NULL").select("url", (F.col("ruled") == "allow").alias("allowed")), params)
    asked = F.col("ruled").isNull() | _apart(F.col("url"))
    columns = ["page_id", "host", "path", "rule", "ruled"]
    scored = write_and_read(models.scored(known.filter(asked).select(*columns, "chunk", "url")), "scored-urls")
    judged = scored.filter("ruled IS NOT NULL").select("score", (F.col("ruled") == "allow").alias("allowed"))
    threshold = calibrated(judged, params)
    others = known.filter(~asked).select(*columns, F.lit(None).cast("double").alias("score"))
    every = scored.unionByName(others)
    decided = F.when(F.col("score") >= F.lit(threshold), "allow").otherwise("block")
    score = F.when(F.col("ruled").isNull(), F.col("score")).alias("score")
    return every.select("page_id", "host", "path", "rule", F.coalesce("ruled", decided).alias("verdict"), score)
