"""Secret scans with multipart credential linking.

Strong patterns are reported wherever they stand. Weak candidates (an identifier, a random-looking
string, an endpoint) are reported only where the parts that complete a credential lie within
reach of them or in the same block or section of a config text. Candidates that overlap are linked
like others, an endpoint with the secret in it; which of them are reported is settled afterwards.
The parts meet in an interval join: texts are laid out in stretches of one reach, and for every
stretch and role only the outermost positions are kept, so that a text with very many parts makes
no pairs of them. Blocks and sections are joined as further stretches.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from querytide.llm.common import fresh, prepare, texts
from querytide.session import write_and_read

#: Kinds in the order of the output; those after `hex` come from linking.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")

_ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Weak candidates. A random-looking string has a digit and letters of both cases.
_IDENTIFIER = re.compile(
    r"""(?ai:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{4,})"""
)
_RANDOM = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?=[a-zA-Z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])"
    r"[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"
)
_ENDPOINT = re.compile(r"[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._~:/@%-]+|(?:[a-z0-9-]+\.){2,}[a-z]{2,}:[0-9]{2,5}")
#: A connection string's user and password; with the host it is an endpoint itself.
_LOGIN = re.compile(r"://([^\s:/@?#]+):([^\s/@?#]+)@[A-Za-z0-9.-]+(?::[0-9]{2,5})?")
_SCHEME = re.compile(r"[a-z][a-z0-9+]{0,15}$")

#: Lines of a block: one word, a comment, an item, or a key with `:` or `=`. Names of sections.
_BLOCK_LINE = re.compile(
    r"""[\x20\t]*(?:[^\s]+\s*$|[#;]|//|[-?]\x20|(?:export\x20+)?["']?[\w.-]+["']?[\x20\t]*[:=])"""
)
_BRACKETS = re.compile(r"[\x20\t]*\[[^\[\]\n]+\]\s*$")
_HEADING = re.compile(r"#{1,6}\x20+\S")

#: Found spans that a broadcast may hold, some 50 MB with their keys.
BROADCAST_SPANS = 250_000

SPAN = "struct<kind: string, start: int, end: int>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

Span = tuple[str, int, int]


def strong_spans(text: str) -> list[Span]:
    """Matches of the strong patterns by start, then kind."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def weak_spans(text: str, strong: list[Span]) -> list[Span]:
    """Weak candidates by start, then kind, those that overlap others included.

    One part is not taken for two: a candidate within a strong span is that span, and a
    random-looking string that shares characters with an access key or an identifier is its value;
    an identifier is drawn out to the end of its value. A connection string with a password is an
    identifier, a secret and an endpoint that holds both.
    """
    names = [list(m.span()) for m in _IDENTIFIER.finditer(text)]
    named = [start for start, _ in names]
    access = [s[1:] for s in strong if s[0] == "access"]
    keyed = [start for start, _ in access]
    found: list[Span] = []
    for m in _RANDOM.finditer(text):
        start, end = m.span()
        at, key = bisect_right(named, end - 1) - 1, bisect_right(keyed, end - 1) - 1
        if at >= 0 and names[at][1] > start:
            names[at] = [min(names[at][0], start), max(names[at][1], end)]
        elif key < 0 or access[key][1] <= start:
            found.append(("secret", start, end))
    found += [("identifier", *span) for span in names]
    for m in _LOGIN.finditer(text):
        scheme = _SCHEME.search(text[max(0, m.start() - 16) : m.start()])
        begin = m.start() - (scheme.end() - scheme.start() if scheme else 0)
        parts = [("identifier", *m.span(1)), ("secret", *m.span(2)), ("endpoint", begin, m.end())]
        found += parts
    if found or strong:  # endpoints count only beside other parts
        found += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    begins, furthest = [s[1] for s in strong], list(accumulate((s[2] for s in strong), max))
    kept = []
    for span in sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]))):
        before = bisect_right(begins, span[1])
        if not before or furthest[before - 1] < span[2]:
            kept.append(span)
    return kept


def scopes(text: str, spans: list[Span]) -> list[list[int]]:
    """The blocks and sections of a text that each span lies in, as `4 * number + scope`.

    Scope 1 is a block, two lines or more like those of a config text without another between
    them; 2 is a section from a line with a name in brackets to the next, 3 one from a Markdown
    heading to the next. Spans lie within a line.
    """
    begins, places = [], []
    block = brackets = heading = 0
    within, at = False, 0
    for line in text.split("\n"):
        if _BRACKETS.match(line):
            brackets += 1
        if _HEADING.match(line):
            heading += 1
        fits = _BLOCK_LINE.match(line) is not None
        block += fits and not within
        within = fits
        begins.append(at)
        places.append((block if fits else 0, brackets, heading))
        at += len(line) + 1
    lonely = {
        p[0] for k, p in enumerate(places) if p[0] and (not k or places[k - 1][0] != p[0]) and (k + 1 == len(places) or places[k + 1][0] != p[0])
    }
    found = []
    for _, start, _ in spans:
        own = places[bisect_right(begins, start) - 1]
        found.append([4 * n + scope for scope, n in enumerate(own, 1) if n and not (scope == 1 and n in lonely)])
    return found


def settled(strong: list[Span], linked: list[Span]) -> list[Span]:
    """The linked spans that no other reported span holds; of equal ones the first kind."""
    furthest, kept = -1, []
    every = [(s[1], -s[2], k, s) for k, spans in enumerate((strong, linked)) for s in spans]
    for _, end, weak, span in sorted(every, key=lambda e: (e[0], e[1], e[2], KINDS.index(e[3][0]))):
        if weak and -end > furthest:
            kept.append(span)
        furthest = max(furthest, -end)
    return kept


def _scan(text: Column) -> Column:
    """The spans of a text, and the places of all, strong ones first, if there are weak ones."""

    @arrow_udf(f"strong array<{SPAN}>, weak array<{SPAN}>, places array<array<long>>")
    def run(values: pa.Array) -> pa.Array:
        strong = [strong_spans(t) for t in texts(values)]
        weak = [weak_spans(t, s) for t, s in zip(texts(values), strong)]
        places = [scopes(t, s + w) if w else [] for t, s, w in zip(texts(values), strong, weak)]
        spans = [pa.array(x, pa.list_(_SPAN)) for x in (strong, weak)]
        return pa.StructArray.from_arrays([*spans, pa.array(places, pa.list_(pa.list_(pa.int64())))], names=["strong", "weak", "places"])

    return run(text.cast("string"))


def _settled(strong: Column, linked: Column) -> Column:
    @arrow_udf(f"array<{SPAN}>")
    def run(strong: pa.Array, linked: pa.Array) -> pa.Array:
        rows = zip(strong.to_pylist(), linked.to_pylist())
        as_spans = lambda spans: [(s["kind"], s["start"], s["end"]) for s in spans]
        return pa.array([settled(as_spans(s), as_spans(found)) if found else [] for s, found in rows], pa.list_(_SPAN))

    return run(F.when(linked.isNotNull(), strong), linked)


def _linked(scanned: DataFrame, reach: int) -> DataFrame:
    """`key` and the weak spans of the rows (`key`, `strong`, `weak`, `places`) whose complement is near.

    Near is within `reach` code points or in a block or section of the same text (`scopes`). An
    identifier needs a secret near, a random-looking string needs an
    identifier, and an endpoint needs both. Every strong access span counts as an identifier, all
    other strong spans as secrets.
    """
    some = scanned.filter(F.size("weak") > 0)
    zipped = F.arrays_zip(F.concat("strong", "weak").alias("span"), F.col("places").alias("scopes"))
    part = some.select("key", F.explode(zipped).alias("part")).select("key", "part.span.*", "part.scopes")
    role = F.when(F.col("kind").isin("access", "identifier"), "identifier").when(F.col("kind") != "endpoint", "secret")
    # A place is four times a stretch's number, or that of a block or section as in `scopes`.
    stretch = F.transform(F.sequence(F.floor(F.col("start") / reach), F.floor((F.col("end") - 1) / reach)), lambda n: n * 4)
    low = F.floor(F.col("place") / 4) * reach
    outermost = (
        part.withColumn("role", role)
        .filter(F.col("role").isNotNull())
        .withColumn("place", F.explode(F.concat(stretch, "scopes")))
        .groupBy("key", "place", "role")
        .agg(F.min(F.greatest("start", low)).alias("first"), F.max(F.least("end", low + reach)).alias("last"))
    )
    n_strong, n_weak = F.size("strong"), F.size("weak")
    own = F.arrays_zip(F.col("weak").alias("span"), F.slice("places", n_strong + 1, n_weak).alias("scopes"))
    weak = some.select("key", F.explode(own).alias("part")).select("key", "part.*")
    around = F.transform(
        F.sequence(F.floor((F.col("span.start") - reach) / reach), F.floor((F.col("span.end") + reach) / reach)), lambda n: n * 4
    )
    # What a candidate reaches is longer than a stretch, so within one it covers the beginning or
    # the end; the outermost positions decide. Spark sizes the exploded parts like the packed arrays
    # they come from and would broadcast them, so the join is told to merge.
    within = (F.col("first") <= F.col("span.end") + reach) & (F.col("last") >= F.col("span.start") - reach)
    near = (
        weak.withColumn("place", F.explode(F.concat(around, "scopes")))
        .join(outermost.hint("merge"), ["key", "place"])
        .filter((F.pmod("place", F.lit(4)) != 0) | within)
    )
    beside = near.groupBy("key", "span").agg(
        F.bool_or(F.col("role") == "identifier").alias("identifier"), F.bool_or(F.col("role") == "secret").alias("secret")
    )
    kind = F.col("span.kind")
    complete = (
        F.when(kind == "identifier", F.col("secret"))
        .when(kind == "secret", F.col("identifier"))
        .otherwise(F.col("identifier") & F.col("secret"))
    )
    return beside.filter(complete).groupBy("key").agg(F.collect_list("span").alias("linked"))


def _in_order(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"),
            s["end"].alias("end"),
            s["kind"].alias("kind"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, reach: int = 200) -> DataFrame:
    """`doc_id`, the `strong` spans and all `spans` of every row, each by start, then kind.

    A linked span that lies within another reported one is not told again; spans that overlap only
    in part are all told. A null text is empty and has no spans. Offsets are code points, ends exclusive. Repeated rows
    stay repeated, a null doc_id stays null, other columns are not read, and an empty table gives
    an empty table.
    """
    prepare(docs.sparkSession)
    scanned = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("key"), _scan(F.col("text")).alias("found")
    )
    rows = write_and_read(scanned.select("doc_id", "key", "found.*"), "scanned")
    linked = _linked(rows, reach)
    return rows.join(linked, "key", "left").select(
        "doc_id", "strong", _in_order(F.concat("strong", _settled(F.col("strong"), F.col("linked")))).alias("spans")
    )


def scan_digests(docs: DataFrame, reach: int = 200) -> DataFrame:
    """`scan` with counts of the strong kinds, their digest, and all spans in one string."""
    kinds = F.transform("strong", lambda s: s["kind"])
    counts = [(F.size("strong") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return scan(docs, reach).select(
        "doc_id", *counts, F.sha2(_joined(F.col("strong")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame, reach: int = 200, mask: str = "[secret]") -> DataFrame:
    """All rows and columns of `docs`, each stretch of overlapping spans in `text` made `mask`.

    `n_chars`, where there is one, is set to the new length of a changed text. Rules as in `scan`.
    Texts of equal bytes have equal spans: each is scanned once, and what was found is joined back
    by the digests of the texts.
    """
    prepare(docs.sparkSession)
    key, spans = (fresh(docs, n) for n in ("scan_key", "spans"))
    text = F.col("text").cast("string")
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    scanned = docs.select(digest.alias("key"), _scan(text).alias("found")).select("key", "found.*")
    suspects = write_and_read(scanned.filter(F.size("strong") + F.size("weak") > 0).dropDuplicates(["key"]), "suspects")
    linked = F.coalesce(F.col("linked"), F.array().cast(f"array<{SPAN}>"))
    every = suspects.join(_linked(suspects, reach), "key", "left").select(
        F.col("key").alias(key), _in_order(F.concat("strong", linked)).alias(spans)
    )
    found = write_and_read(every.filter(F.size(spans) > 0), "found-spans")
    # Their file may be a hundredth of what they take in memory, so they are counted.
    if (found.agg(F.sum(F.size(spans))).first()[0] or 0) > BROADCAST_SPANS:
        found = found.hint("merge")
    marked = docs.withColumn(key, digest).join(found, key, "left")
    hit = F.col(spans).isNotNull()

    @arrow_udf("string")
    def masked(values: pa.Array, at: pa.Array) -> pa.Array:
        return pa.array([_masked(t, s, mask) for t, s in zip(values.to_pylist(), at.to_pylist())], pa.string())

    changed = masked(F.when(hit, text), F.col(spans))
    columns = [
        F.coalesce(changed, F.col(c)).alias(c) if c == "text" else F.col(c) for c in docs.columns
    ]
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        at = docs.columns.index("n_chars")
        columns[at] = F.when(hit, F.length(changed).cast(kind)).otherwise(F.col("n_chars")).alias("n_chars")
    return marked.select(*columns)


def _masked(text: str | None, spans: list[dict] | None, mask: str) -> str | None:
    if text is None:
        return None
    return "".join(_pieces(text, [(s["start"], s["end"]) for s in spans], mask))


def _pieces(text: str, spans: list[tuple[int, int]], mask: str) -> Iterator[str]:
    at = 0
    for start, end in spans:
        if start >= at:
            yield text[at:start]
            yield mask
        at = max(at, end)
    yield text[at:]
