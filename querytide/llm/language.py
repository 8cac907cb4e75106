"""Language identification by multinomial naive Bayes over hashed character n-grams.

Counts are learned from a bounded sample of the labelled documents of every language, summed by
Spark; no language that occurs is left out. The matrix of log-probabilities has one row for each slot and one column for each language; it is broadcast, and
a batch of texts is scored by looking up the rows of all its n-grams at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from querytide.llm.common import prepare, slices, texts
from querytide.session import write_and_read

_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LanguageParams:
    #: Documents of each language learned from, at most (all rows that tie with the last one's hash
    #: are taken).
    sample: int = 20_000
    #: Characters of an n-gram at most, and slots they are hashed to.
    longest: int = 3
    slots: int = 2**16
    smoothing: float = 0.5


@dataclass(frozen=True)
class Model:
    """Languages, log-probabilities by slot and language, and the log-prior."""

    languages: list[str]
    matrix: np.ndarray
    prior: np.ndarray
    params: LanguageParams

    def predict(self, batch: list[str]) -> tuple[list[str | None], np.ndarray]:
        """The likeliest language of each text and its posterior probability."""
        named: list[str | None] = ["und"] * len(batch)
        scores = np.zeros(len(batch))
        asked = [i for i, t in enumerate(batch) if _LETTER.search(t)] if self.languages else []
        for run in slices(asked, [len(batch[i]) for i in asked], 500_000):
            total = self._sums([batch[i] for i in asked[run]]) + self.prior
            share = np.exp(total - total.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            for i, best, p in zip(asked[run], share.argmax(axis=1), share.max(axis=1)):
                named[i], scores[i] = self.languages[best], p
        return named, scores

    def _sums(self, batch: list[str]) -> np.ndarray:
        total = np.zeros((len(batch), len(self.languages)))
        data, lengths = _laid_out(batch)
        begins = np.cumsum(lengths) - lengths
        for at, slots in _grams(data, lengths, self.params):
            found = self.matrix[slots]
            edges = np.searchsorted(at, np.concatenate((begins, [len(data)])))
            some = np.flatnonzero(np.diff(edges))
            if len(some):
                total[some] += np.add.reduceat(found, edges[some], axis=0)
        return total


def _laid_out(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, each between spaces; anything but letters a space."""
    framed = [f" {t.lower()} " for t in batch]
    data = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    plain = data < 128
    letter = (data >= 97) & (data <= 122)
    data[plain & ~letter] = 32
    return data, np.array([len(f) for f in framed], "i8")


def _grams(data: np.ndarray, lengths: np.ndarray, params: LanguageParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the positions where n-grams begin and their slots.

    N-grams lie within one text; none begins at a space that a space or the end follows.
    """
    ends = np.repeat(np.cumsum(lengths), lengths)
    useful = data != 32
    useful[:-1] |= data[1:] != 32
    useful &= (data != 32) | (np.arange(len(data)) + 1 < ends)
    value = np.zeros(len(data), "u8")
    for length in range(1, params.longest + 1):
        n = len(data) - length + 1
        if n <= 0:
            return
        value = (value[:n] + data[length - 1 :]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(length)
        at = np.flatnonzero(useful[:n] & (np.arange(n) + length <= ends[:n]))
        mixed = value[at]
        mixed = mixed ^ (mixed >> np.uint64(32))
        yield at, (mixed % np.uint64(params.slots)).astype("i8")


def _last_hashes(rows: DataFrame, most: int) -> DataFrame:
    """`lang`, its `documents`, and the `last` hash of its `most` smallest ones, of rows (`lang`, `hash`).

    Languages are counted in 4096 ranges of hashes, and only the hashes of the range in which the
    last one lies are ranked, so no task meets all documents of a language.
    """
    cell = F.shiftright("hash", 52).alias("cell")
    so_far = Window.partitionBy("lang").orderBy("cell")
    cells = write_and_read(rows.groupBy("lang", cell).agg(F.count("*").alias("n")), "language-cells")
    summed = cells.withColumn("before", F.sum("n").over(so_far) - F.col("n"))
    edges = summed.filter((F.col("before") < most) & (F.col("before") + F.col("n") >= most)).select("lang", "cell", "before")
    edges = write_and_read(edges, "language-edges")
    within = rows.withColumn("cell", cell).join(edges, ["lang", "cell"]).groupBy("lang", "hash", "before").agg(F.count("*").alias("n"))
    rank = F.col("before") + F.sum("n").over(Window.partitionBy("lang").orderBy("hash"))
    last = within.withColumn("rank", rank).filter(F.col("rank") >= most).groupBy("lang").agg(F.min("hash").alias("last"))
    total = cells.groupBy("lang").agg(F.sum("n").alias("documents"))
    return total.join(last, "lang", "left").select("lang", "documents", F.coalesce("last", F.lit(2**63 - 1)).alias("last"))


def learn(docs: DataFrame, params: LanguageParams = LanguageParams()) -> Model:
    """A model from `text` and `lang`; rows with either null are not learned from.

    The sample is, of each language, the rows with the smallest hashes of their doc_id, so it is
    the same at every run. The prior is by all rows. Every language that occurs is learned, and
    only counts reach the driver, `slots` for each language at most.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(
        F.xxhash64(F.col("doc_id").cast("long")).alias("hash"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    ).filter("lang IS NOT NULL AND text IS NOT NULL")
    last = write_and_read(_last_hashes(rows.select("lang", "hash"), params.sample), "languages")
    documents = {r["lang"]: r["documents"] for r in last.select("lang", "documents").collect()}
    languages = sorted(documents)
    place = {name: k for k, name in enumerate(languages)}
    slots = params.slots

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}

        def summed_up() -> Iterator[pa.RecordBatch]:
            for name, table in tables.items():
                at = np.flatnonzero(table)
                yield pa.RecordBatch.from_arrays([pa.array(at + place[name] * slots), pa.array(table[at])], ["slot", "n"])
            tables.clear()

        for batch in batches:
            by_name: dict[str, list[str]] = {}
            for name, text in zip(texts(batch.column("lang")), texts(batch.column("text"))):
                by_name.setdefault(name, []).append(text)
            for name, chosen in by_name.items():
                table = tables.setdefault(name, np.zeros(slots, "i8"))
                for run in slices(chosen, [len(t) for t in chosen], 500_000):
                    for _, at in _grams(*_laid_out(chosen[run]), params):
                        table += np.bincount(at, minlength=slots)
                if len(tables) >= 64:
                    yield from summed_up()
        yield from summed_up()

    chosen = rows.join(last, "lang").filter(F.col("hash") <= F.col("last")).select("lang", "text")
    summed = chosen.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    summed = summed.sort_values("slot")
    slot, n = summed["slot"].to_numpy("i8"), summed["n"].to_numpy("f8")
    edges = np.searchsorted(slot, np.arange(len(languages) + 1) * slots)
    matrix = np.empty((slots, len(languages)), "f4")
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        table = np.full(slots, params.smoothing)
        table[slot[a:b] - k * slots] += n[a:b]
        matrix[:, k] = np.log(table / table.sum())
    weight = np.array([documents[name] for name in languages], "f8")
    return Model(languages, matrix, np.log(weight / weight.sum()), params)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id`, `lang_pred` and `score` of every row.

    A text that is null or has no letter is `und` with score 0, and so is every text if no
    language was learned. Ties go to the language that comes first by name. Repeated rows and
    null doc_ids stay as they are; other columns are not read. An empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("lang_pred string, score double")
    def run(values: pa.Array) -> pa.Array:
        named, scores = shared.value.predict(texts(values))
        return pa.StructArray.from_arrays([pa.array(named, pa.string()), pa.array(scores)], names=["lang_pred", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), run(F.col("text").cast("string")).alias("found"))
    return found.select("doc_id", "found.*")
