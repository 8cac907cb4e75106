"""Statistics of whole texts, shared by the quality operators."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from querytide.llm.common import prepare, text_bytes

#: Counts of a text, in order.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
    "n_digits", "n_marks", "n_top", "n_run",
)

#: Features, ratios of the counts: name, numerator, denominator. Lengths of words and texts and
#: the share of distinct words are none of them: they tell languages and lengths apart, not quality.
RATIOS = (
    ("symbol_share", "n_symbols", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("upper_share", "n_upper", "word_chars"),
    ("digit_share", "n_digits", "word_chars"),
    ("mark_share", "n_marks", "n_words"),
    ("top_share", "n_top", "n_words"),
    ("run_share", "n_run", "n_words"),
)
FEATURES = tuple(name for name, _, _ in RATIOS)


def _bytes_of(characters: str) -> list[int]:
    return [ord(c) for c in characters]


_WHITE, _SYMBOLS, _MARKS = _bytes_of(" \t\n\v\f\r"), _bytes_of("#*$%&|<>"), _bytes_of("!?")


def counts(text: bytes) -> tuple[int, ...]:
    """The COUNTS of a text in UTF-8; words are runs of anything but ASCII white space."""
    words = text.split()
    if not words:
        return (0, 0, *(0 for _ in COUNTS[2:]))
    used = np.bincount(np.frombuffer(text, "u1"), minlength=256)
    points = len(text) - int(used[0x80:0xC0].sum())
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    n = len(words)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen: set = set()
        twice = {w for w in windows if w in seen or seen.add(w)}
        covered = 0
        for at, window in enumerate(windows):
            if window in twice:
                repeated += at + 3 - max(at, covered)
                covered = at + 3
    tally: dict[bytes, int] = {}
    for word in words:
        tally[word] = tally.get(word, 0) + 1
    run = max(len(list(same)) for _, same in groupby(words)) if len(tally) < n else 1
    return (
        n,
        points - int(used[_WHITE].sum()),
        int(used[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        int(used[65:91].sum()),
        int(used[48:58].sum()),
        int(used[_MARKS].sum()),
        max(tally.values()),
        run,
    )


def counts_of(text: Column) -> Column:
    """The COUNTS of a text column as a struct of longs; all zero for a null text."""

    @arrow_udf(", ".join(f"{name} long" for name in COUNTS))
    def run(values: pa.Array) -> pa.Array:
        table = np.array([counts(t) for t in text_bytes(values)], "i8").reshape(-1, len(COUNTS))
        return pa.StructArray.from_arrays([pa.array(c) for c in table.T.copy()], names=list(COUNTS))

    return run(text.cast("string"))


def feature(name: str, count: str = "counts") -> Column:
    """A feature from the struct of counts; a share of nothing is zero."""
    top, bottom = next((t, b) for ratio, t, b in RATIOS if ratio == name)
    share = F.col(f"{count}.{top}") / F.col(f"{count}.{bottom}")
    return F.when(F.col(f"{count}.{bottom}") > 0, share).otherwise(F.lit(0.0))


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (0 or 1) of at most `most` documents, for training on the driver.

    Documents are taken by the hash of their doc_id, so the sample is the same at every run. A
    doc_id with both labels, or with a null one only, is left out; of rows that share a doc_id
    one is taken.
    """
    prepare(docs.sparkSession)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    marked = (
        marked.filter("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .filter("label = other")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
        .select("doc_id", "label")
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    taken = rows.join(F.broadcast(marked), "doc_id").select("doc_id", "label", counts_of(F.col("text")).alias("counts"))
    one = taken.groupBy("doc_id", "label").agg(F.min("counts").alias("counts"))
    table = one.select("label", *[feature(f).alias(f) for f in FEATURES]).toPandas()
    table = table.sort_values(list(table.columns))
    return table[list(FEATURES)].to_numpy("f8"), table["label"].to_numpy("i8")
