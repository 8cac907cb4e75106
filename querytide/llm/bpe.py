"""Byte-level BPE by recursive DuckDB queries inside each partition.

A task cuts its texts into the pattern's matches, and DuckDB encodes the distinct ones: rows of
(word, position, token) join the merge table, every word contracts its leftmost pair of minimum
rank, and the query recurs until no word has a pair left. An ordered aggregation over the
vocabulary decodes. No row leaves its task but the result, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querytide.llm.common import slices, prepare, texts
from querytide.llm.pretokens import LONGEST_KEPT, chunks

#: One contraction in each word: the leftmost pair of minimum rank. A token reaches up to where
#: the next one starts.
_LEFTMOST = """
    WITH RECURSIVE tokens(round, word, pos, id, upto) AS (
        SELECT 0::INTEGER, word::INTEGER, pos::INTEGER, id::INTEGER, pos::INTEGER + 1 FROM start
        UNION ALL
        SELECT t.round + 1, t.word, t.pos,
               CASE WHEN t.pos = best.pos THEN best.id ELSE t.id END,
               CASE WHEN t.pos = best.pos THEN best.upto ELSE t.upto END
        FROM tokens AS t
        JOIN (
            SELECT p.word, min(m.id * 65536 + p.pos) AS pair,
                   (pair // 65536)::INTEGER AS id, (pair % 65536)::INTEGER AS pos,
                   arg_min(p.upto, m.id * 65536 + p.pos) AS joint,
                   arg_min(q.upto, m.id * 65536 + p.pos) AS upto
            FROM tokens AS p
            JOIN tokens AS q ON p.word = q.word AND p.upto = q.pos
            JOIN merges AS m ON p.id = m.first AND q.id = m.second
            GROUP BY p.word
        ) AS best ON t.word = best.word
        WHERE t.pos <> best.joint
    )
    SELECT word, pos, id FROM tokens
    SEMI JOIN (SELECT word, max(round) AS round FROM tokens GROUP BY word) AS last USING (word, round)
"""

#: The same for long words, several contractions at a time: every occurrence of the word's
#: minimum rank, from the left, that no earlier one overlaps. Each token of the vocabulary is
#: made by merges of lower rank, so no new pair can come before the occurrences that remain.
_ALL_LEFTMOST = """
    WITH RECURSIVE tokens(round, word, pos, id) AS (
        SELECT 0, word, pos, id FROM start
        UNION ALL
        SELECT round + 1, word, pos, coalesce(merged, id)
        FROM (
            SELECT *, lag(merged) OVER (PARTITION BY word ORDER BY pos) AS merged_before
            FROM (
                SELECT round, word, pos, id, least_rank,
                       CASE WHEN hit AND row_number() OVER (PARTITION BY word, hit, island ORDER BY pos) % 2 = 1
                            THEN least_rank END AS merged
                FROM (
                    SELECT *, number - row_number() OVER (PARTITION BY word, hit ORDER BY pos) AS island
                    FROM (
                        SELECT *, rank IS NOT DISTINCT FROM least_rank AS hit
                        FROM (
                            SELECT p.*, m.id AS rank, min(m.id) OVER (PARTITION BY p.word) AS least_rank
                            FROM (
                                SELECT *, lead(id) OVER (PARTITION BY word ORDER BY pos) AS after,
                                       row_number() OVER (PARTITION BY word ORDER BY pos) AS number
                                FROM tokens
                                WHERE round < $rounds
                            ) AS p
                            LEFT JOIN merges AS m ON p.id = m.first AND p.after = m.second
                        ) AS ranked
                        WHERE least_rank IS NOT NULL
                    ) AS marked
                ) AS grouped
            ) AS chosen
        ) AS contracted
        WHERE merged_before IS NULL
    )
    SELECT word, pos, id, round FROM tokens
    SEMI JOIN (SELECT word, max(round) AS round FROM tokens GROUP BY word) AS last USING (word, round)
"""

#: The sorted rows reach the aggregates in order, because a connection has one thread; that the
#: bytes come out as the word they were is checked.
_DECODE = """
    SELECT word, string_agg(name, ' ') AS ids, string_agg(hex, '') AS bytes
    FROM (
        SELECT e.word, v.name, v.hex
        FROM encoded AS e JOIN vocabulary AS v ON e.id = v.id
        ORDER BY e.word, e.pos
    ) AS ordered
    GROUP BY word
"""

#: Words of more bytes than this are contracted at many places at a time.
LONG_WORD = 48
#: Characters of the texts that are cut and looked up together.
RUN_CHARS = 4_000_000
#: Token rows of long words that the rounds of one recursive query may keep.
ROUND_ROWS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: token bytes to id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """Rows (first, second, merged id) for every way to join two tokens to a third."""
    found = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            first, second = ranks.get(token[:cut]), ranks.get(token[cut:])
            if first is not None and second is not None:
                found.append((first, second, rank))
    return np.array(found, "i8").reshape(-1, 3)


class WordEncoder:
    """Encodes and decodes words with DuckDB."""

    def __init__(self, ranks: dict[bytes, int], memory_mb: int = 256):
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": f"{memory_mb}MB", "temp_directory": tempfile.gettempdir()})
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], "i8")
        if (self.single < 0).any():
            raise ValueError("the vocabulary lacks a single byte")
        first, second, merged = merge_pairs(ranks).T
        self._table("merges", {"first": first, "second": second, "id": merged})
        ids = list(ranks.values())
        self._table(
            "vocabulary",
            {"id": np.array(ids, "i8"), "name": [str(i) for i in ids], "hex": [t.hex() for t in ranks]},
        )

    def _table(self, name: str, columns: dict) -> None:
        arrow = pa.table(columns)
        self.con.register("given", arrow)
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _start(self, words: list[bytes], numbers: np.ndarray) -> None:
        lengths = np.array([len(w) for w in words], "i8")
        ends = np.cumsum(lengths)
        self._table(
            "start",
            {
                "word": np.repeat(numbers, lengths),
                "pos": np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths),
                "id": self.single[np.frombuffer(b"".join(words), "u1")],
            },
        )

    def encode(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """For each word its ids, each with a space before it, and the bytes they decode to."""
        numbers = np.arange(len(words))
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        self._start([words[i] for i in short], numbers[short])
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE encoded AS {_LEFTMOST}")
        long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        for run in slices(long, [len(words[i]) for i in long], ROUND_ROWS // 16):
            self._start([words[i] for i in long[run]], numbers[long[run]])
            self._contract_long()
        result: list = [None] * len(words)
        for word, ids, decoded in self.con.execute(_DECODE).fetchall():
            result[word] = (b" " + ids.encode(), bytes.fromhex(decoded))
            if result[word][1] != words[word]:
                raise ValueError(f"decoded to another word: {words[word]!r}")
        return result

    def _contract_long(self) -> None:
        while True:
            ((rows,),) = self.con.execute("SELECT count(*) FROM start").fetchall()
            if not rows:
                return
            rounds = max(1, ROUND_ROWS // rows)
            self.con.execute(f"CREATE OR REPLACE TEMP TABLE reached AS {_ALL_LEFTMOST}", {"rounds": rounds})
            ended = "SELECT word, pos, id FROM reached WHERE round < $rounds"
            self.con.execute(f"INSERT INTO encoded {ended}", {"rounds": rounds})
            self.con.execute(
                "CREATE OR REPLACE TEMP TABLE start AS SELECT word, pos, id FROM reached WHERE round = $rounds",
                {"rounds": rounds},
            )


class Memory(dict):
    """Remembers about `kept` entries, and of those the ones asked for last.

    Entries lie in two generations; one that is found in the old one moves to the new one, and when
    that is full it becomes the old one.
    """

    def __init__(self, kept: int):
        super().__init__()
        self.half, self.old = kept // 2, {}

    def __missing__(self, key: str) -> tuple[bytes, bytes]:
        value = self[key] = self.old[key]
        return value

    def unknown(self, keys: Iterable[str]) -> list[str]:
        return [key for key in keys if key not in self and key not in self.old]

    def age(self) -> None:
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()

    def forget(self, keys: Iterable[str]) -> None:
        for key in keys:
            if len(key) > LONGEST_KEPT:
                self.pop(key, None)


def _joined(values: tuple[bytes, ...], indices: pa.Array, ends: np.ndarray) -> Iterator[bytes]:
    """The values at `indices` joined, a result for each two neighbours of `ends`."""
    laid_out = pa.array(values, pa.large_binary()).take(indices)
    _, starts, data = laid_out.buffers()
    at = np.frombuffer(starts, "i8")[ends].tolist()
    view = memoryview(data or b"")
    return (bytes(view[a:b]) for a, b in pairwise(at))


@lru_cache(maxsize=1)
def text_encoder(path: str, pattern: str, kept: int = 600_000) -> Callable[[list[str]], Iterator[tuple[bytes, bytes]]]:
    """Texts to their ids, each with a space before it, and the bytes these decode to.

    A run of texts is cut into chunks, and each distinct one is looked up once. What words and
    chunks became is remembered, about `kept` of either; older ones are forgotten. A worker keeps
    the encoder for its next tasks.
    """
    encoder, match = WordEncoder(read_ranks(path)), regex.compile(pattern)
    words, known = Memory(kept), Memory(kept)

    def learn(new: list[str]) -> None:
        found = [match.findall(chunk) for chunk in new]
        fresh = words.unknown({w for ws in found for w in ws})
        words.update(zip(fresh, encoder.encode([w.encode() for w in fresh])))
        for chunk, ws in zip(new, found):
            if len(ws) == 1:
                known[chunk] = words[ws[0]]
            else:
                parts = [words[w] for w in ws]
                known[chunk] = b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])
        words.forget(fresh)

    def encode(batch: list[str]) -> Iterator[tuple[bytes, bytes]]:
        for run in slices(batch, [len(t) + 1 for t in batch], RUN_CHARS):
            cut = [chunks(text) for text in batch[run]]
            words.age()
            known.age()
            flat = pa.array(chain.from_iterable(cut), pa.large_string()).dictionary_encode()
            distinct = flat.dictionary.to_pylist()
            new = known.unknown(distinct)
            learn(new)
            ends = np.cumsum([0, *map(len, cut)])
            found = zip(*map(known.__getitem__, distinct))
            yield from zip(*(_joined(values, flat.indices, ends) for values in found))
            known.forget(new)

    return encode


def _encoded(docs: DataFrame, path: str | None, pattern: str | None, schema: str, row: Callable, kinds: list[pa.DataType]) -> DataFrame:
    prepare(docs.sparkSession)
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or text_encoder(path, pattern)
            found = [row(ids, decoded) for ids, decoded in encode(texts(batch.column("text")))]
            columns = list(zip(*found)) or [[] for _ in kinds]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])

    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {schema}")


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`doc_id`, the token ids of the whole text and the bytes they decode to.

    A null text is empty and has no ids; repeated rows stay repeated, a null doc_id stays null,
    and no other column is read. An empty table gives an empty table.
    """
    return _encoded(
        docs, path, pattern, "ids array<int>, decoded binary",
        lambda ids, decoded: (np.array(ids.split(), "i4"), decoded), [pa.list_(pa.int32()), pa.binary()],
    )


def token_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """As `encode_documents`, with the number of ids and digests in place of ids and bytes."""
    return _encoded(
        docs, path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda ids, decoded: (ids.count(b" "), hashlib.sha256(ids[1:]).hexdigest(), hashlib.sha256(decoded).hexdigest()),
        [pa.int64(), pa.string(), pa.string()],
    )
