"""License scans in DataFrame operations alone.

A text is compared with notices and texts of known licenses by the cosine of sparse TF-IDF vectors:
each of its lines, each block of lines between empty ones, and each passage of lines whose words are
mostly those of licenses, which joins the paragraphs of a header or of a license file and leaves the
code beside them out. Copyright notices are set aside before, since they differ from holder to holder.
Inverse document frequencies of all terms come from all lines of all documents. Only a unit with one
of a few rare terms of a template can reach the threshold, so other texts are left aside without
loss. An SPDX tag names its license itself. A text with more license lines than others, or named like
one, is the license file of its directory; files without a license of their own inherit from the
nearest directory above them that has one.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.llm.license_texts import TEMPLATES
from querytide.session import write_and_read

#: Shares of the terms of candidate units.
SALTS = 16
#: Share of a line's terms that the templates must have for the line to belong to a passage.
OF_LICENSES = 0.7

_TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
_FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
_COPYRIGHT = r"(?i)(?:copyright[\x20\t]*(?:\(c\)|\u00a9)?|\(c\)|\u00a9)[\x20\t]*[0-9]{4}[^\n]*?(?=all rights reserved|\n|\z)"
_TAG = r"SPDX-License-Identifier:[\x20\t]*\(?([A-Za-z0-9.+-]+(?:[\x20\t]+(?:AND|OR|WITH)[\x20\t]+[A-Za-z0-9.+-]+)*)"


def terms(sentence: Column) -> Column:
    return F.regexp_extract_all(F.lower(sentence), F.lit(f"({_TERM})"), 1)


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _template_terms() -> list[tuple[str, Counter]]:
    return [(name, Counter(re.findall(_TERM, text.lower()))) for name, text in TEMPLATES]


def document_frequencies(docs: DataFrame) -> DataFrame:
    """`term` and `n`, the lines of all documents that have it, of every term; the empty term has all lines."""
    line = docs.select(F.explode(_lines(F.col("text").cast("string"))).alias("line"))
    marked = F.array_append(F.array_distinct(terms(F.col("line"))), F.lit(""))
    counted = line.select(F.explode(marked).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return write_and_read(counted, "line-frequencies")


def template_weights(frequencies: DataFrame) -> tuple[dict[str, float], int]:
    """The weight of every term of the templates, and the number of lines."""
    known = sorted({t for _, counted in _template_terms() for t in counted})
    counted = {r["term"]: r["n"] for r in frequencies.filter(F.col("term").isin([*known, ""])).collect()}
    lines = counted.get("", 0)
    return {t: math.log((1 + lines) / (1 + counted.get(t, 0))) + 1 for t in known}, lines


def _anchors(weight: dict[str, float], threshold: float) -> set[str]:
    """Terms of which a unit must have one to reach the threshold with any template.

    A unit without the rarest terms of a template has a cosine of at most the share that the other
    terms have in the template's length.
    """
    found = set()
    for _, counted in _template_terms():
        squares = {t: (n * weight[t]) ** 2 for t, n in counted.items()}
        norm = rest = sum(squares.values())
        for term in sorted(squares, key=lambda t: (-weight[t], t)):
            if rest < threshold * threshold * norm * (1 - 1e-9):
                break
            found.add(term)
            rest -= squares[term]
    return found


def _runs(lines: Column, belongs) -> Column:
    """Lines joined by newlines as long as they belong; only runs of two lines and more."""
    joined = F.array_join(F.transform(lines, lambda line: F.when(belongs(line), line).otherwise("")), "\n")
    runs = F.transform(F.split(joined, "\n\n+"), lambda run: F.btrim(run, F.lit("\n")))
    return F.filter(runs, lambda run: run.contains("\n"))


def _units(text: Column, anchors: list[str], vocabulary: list[str]) -> Column:
    """The lines, blocks and passages of a text that have an anchor."""
    lines = F.split(F.regexp_replace(text, _COPYRIGHT, ""), "\n")

    def worded(line: Column) -> Column:
        return F.lower(line).rlike("[a-z0-9]")

    def of_licenses(line: Column) -> Column:
        known = F.filter(terms(line), lambda term: term.isin(vocabulary))
        return F.size(known) >= OF_LICENSES * F.size(terms(line))

    with_words = F.filter(lines, worded)
    runs = F.array_distinct(F.concat(_runs(lines, worded), _runs(with_words, of_licenses)))
    return F.filter(F.concat(with_words, runs), lambda unit: _anchored(unit, anchors))


def _anchored(text: Column, anchors: list[str]) -> Column:
    return F.exists(terms(text), lambda term: term.isin(anchors))


def _scores(units: DataFrame, frequencies: DataFrame, weight: dict[str, float], lines: int) -> DataFrame:
    """`key`, `unit`, `size` and `best` (score, license) of each unit.

    Terms meet their frequencies in SALTS shares, so that a frequent one is not met in one task, and
    the vectors of the templates, whose number is fixed, as a broadcast table.
    """
    unit = ["key", "unit", "size"]
    counted = units.select(*unit, F.explode(terms(F.col("text"))).alias("term")).groupBy(*unit, "term").agg(F.count("*").alias("times"))
    counted = counted.withColumn("salt", F.pmod(F.xxhash64("key", "unit"), F.lit(SALTS)))
    met = frequencies.join(counted.select("term").distinct(), "term", "left_semi")
    copies = met.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    own = F.col("times") * (F.log((1 + F.lit(lines)) / (1 + F.col("n"))) + 1)
    weighed = counted.join(copies, ["term", "salt"]).select(*unit, "term", own.alias("own"))

    templates = _template_terms()
    lengths = [math.sqrt(sum((n * weight[t]) ** 2 for t, n in c.items())) for _, c in templates]
    vectors = {t: [c[t] * weight[t] / length for (_, c), length in zip(templates, lengths)] for t in weight}
    table = weighed.sparkSession.range(1).select(
        F.explode(F.from_json(F.lit(json.dumps(vectors)), "map<string,array<double>>")).alias("term", "vector")
    )
    dots = [F.sum(F.col("own") * F.col("vector")[k]).alias(f"dot{k}") for k in range(len(templates))]
    sums = weighed.join(F.broadcast(table), "term", "left").groupBy(*unit).agg(F.sum(F.col("own") * F.col("own")).alias("norm"), *dots)
    scores = [
        F.struct(F.round(F.coalesce(F.col(f"dot{k}"), F.lit(0.0)) / F.sqrt("norm"), 9).alias("score"), F.lit(name).alias("license"))
        for k, (name, _) in enumerate(templates)
    ]
    return sums.select(*unit, F.array_max(F.array(*scores)).alias("best"))


def scan(docs: DataFrame, path: Column, threshold: float = 0.8) -> DataFrame:
    """`doc_id`, `path`, `license`, `origin`, `score`, `license_lines` and `lines` of every row.

    `license` is that of the first SPDX tag, or else the one whose template a unit of the text comes
    nearest to, at a cosine of at least `threshold` (`origin` is `own`); `proprietary` counts where
    nothing else does, and of equals the longest unit, then the last name by alphabet. Rows without
    have that of the nearest directory above (`inherited`), or null. A directory has the license of
    the license files in it, the nearest match of them if there are several. `license_lines` are the
    lines that match on their own, or those of the longest unit that does, whichever is more. A null
    text has no lines; a null path inherits nothing. Repeated rows stay repeated, columns beside
    doc_id, text and those of `path` are not read, and an empty table gives an empty table.
    """
    frequencies = document_frequencies(docs)
    weight, lines = template_weights(frequencies)
    anchors, vocabulary = sorted(_anchors(weight, threshold)), sorted(weight)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    rows = docs.select(
        F.col("doc_id"),
        path.alias("path"),
        F.size(_lines(text)).alias("lines"),
        F.when(_anchored(text, anchors), _units(text, anchors, vocabulary)).otherwise(none).alias("units"),
        F.when(text.contains("SPDX-License-Identifier"), F.regexp_extract_all(text, F.lit(_TAG), 1)).otherwise(none).alias("tags"),
        F.monotonically_increasing_id().alias("key"),
    )
    rows = write_and_read(rows, "license-candidates")
    units = rows.select("key", F.posexplode("units").alias("unit", "text"))
    units = units.withColumn("size", F.size(F.split("text", "\n")))
    nearest = _scores(units, frequencies, weight, lines).filter(F.col("best.score") >= threshold)
    specific = (F.col("best.license") != "proprietary").alias("specific")
    matched = nearest.groupBy("key").agg(
        F.greatest(F.sum(F.when(F.col("size") == 1, 1).otherwise(0)), F.max("size")).cast("int").alias("matched"),
        F.max(F.struct(specific, F.col("best.score").alias("score"), "size", F.col("best.license").alias("license"))).alias("nearest"),
    )
    tag = F.try_element_at("tags", F.lit(1))
    tagged = F.struct(F.lit(True).alias("specific"), F.lit(1.0).alias("score"), F.lit(1).alias("size"), tag.alias("license"))
    found = write_and_read(
        rows.drop("units").join(matched, "key", "left").select(
            "doc_id",
            "path",
            F.regexp_replace("path", r"/?[^/]*$", "").alias("directory"),
            "lines",
            F.greatest(F.coalesce("matched", F.lit(0)), F.size("tags")).alias("license_lines"),
            F.when(tag.isNotNull(), tagged).otherwise(F.col("nearest")).alias("best"),
        ),
        "license-lines",
    )
    above = _inherited(found)
    own = F.col("best.license")
    return found.join(above, "directory", "left").select(
        "doc_id",
        "path",
        F.coalesce(own, F.col("above")).alias("license"),
        F.when(own.isNotNull(), "own").when(F.col("above").isNotNull(), "inherited").alias("origin"),
        F.col("best.score").alias("score"),
        "license_lines",
        "lines",
    )


def _inherited(found: DataFrame) -> DataFrame:
    """`directory` and `above`, the license of the nearest directory that has one.

    Directories are joined with their ancestors' licenses, not files; the result is written, so
    that Spark can split a directory with very many files over several tasks.
    """
    is_file = F.col("path").rlike(_FILE_NAME) | (2 * F.col("license_lines") > F.col("lines"))
    licensed = (
        found.filter(F.col("best").isNotNull() & F.col("directory").isNotNull() & is_file)
        .groupBy("directory")
        .agg(F.max("best").alias("best"))
        .select(F.col("directory").alias("ancestor"), F.col("best.license").alias("above"))
    )
    parts = F.split("directory", "/")
    ancestors = F.concat(
        F.array(F.lit("")),
        F.when(F.col("directory") == "", F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        ),
    )
    directories = found.select("directory").filter("directory IS NOT NULL").distinct()
    met = directories.withColumn("ancestor", F.explode(ancestors)).join(licensed, "ancestor")
    nearest = met.groupBy("directory").agg(F.max_by("above", F.length("ancestor")).alias("above"))
    return write_and_read(nearest, "inherited")

