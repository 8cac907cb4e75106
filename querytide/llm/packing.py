"""Best-fit packing of documents into sequences with a grouping genetic algorithm.

Documents become pieces of at most one sequence. Pieces shorter than a sequence are dealt at
random into blocks of bounded size, and every block is packed by several islands. An island
holds a few packings. Crossover injects the well-filled bins of one packing into another, takes
out the bins that now hold a document twice, and best-fits the documents that lost their place;
mutation dissolves the emptiest bins. Between epochs the best packing of each island migrates to
the next. Bins that the blocks leave poorly filled are dissolved, dealt out anew and packed
again. Only lengths travel; no block, island or sequence grows with the data.
"""

from __future__ import annotations

import json
import random
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from querytide.llm.bpe import read_ranks
from querytide.llm.common import prepare, texts
from querytide.session import write_and_read

PIECE_SCHEMA = "key long, doc_id long, piece int, start long, length long, ids_crc32 long"
STATE_SCHEMA = "block long, island int, keys binary, lengths binary, packings array<binary>, migrant binary"


@dataclass(frozen=True)
class PackingParams:
    """Parameters of the search; none of them drops or cuts a document."""

    capacity: int = 1024
    end_id: int = 2
    block_items: int = 4096
    islands: int = 2
    population: int = 3
    generations: int = 4
    epochs: int = 2
    #: Bins filled below this share are dissolved and packed again.
    well_filled: float = 0.985
    rounds: int = 2


# --- pieces -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Vocabulary:
    """One vocabulary in two forms: a tokenizers file, and a rank file with its pattern.

    Both give the same ids; the second is several times as fast.
    """

    tokenizer: str = field(default_factory=lambda: public_tokenizers.path("byte_bpe_50k.json"))
    ranks: str = field(default_factory=lambda: public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pattern: str = public_tokenizers.PATTERN


@lru_cache(maxsize=1)
def _whole(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def text_encoder(vocabulary: Vocabulary) -> Callable[[str], bytes]:
    """A text to its ids as little-endian unsigned 32-bit integers.

    The tokenizers file's added tokens are found in a text as that library finds them. Runs of
    white space that are too long for the pattern's matcher go through the tokenizers file. A
    worker keeps the encoder for its next tasks.
    """
    with open(vocabulary.tokenizer, encoding="utf-8") as file:
        added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
    fast = tiktoken.Encoding(
        "packing", pat_str=vocabulary.pattern, mergeable_ranks=read_ranks(vocabulary.ranks), special_tokens=added
    )

    def encode(text: str) -> bytes:
        try:
            ids = fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            ids = np.array(_whole(vocabulary.tokenizer).encode(text, add_special_tokens=False).ids, "u4")
        return ids.astype("<u4").tobytes()

    return encode


def pieces(
    docs: DataFrame,
    params: PackingParams = PackingParams(),
    vocabulary: Vocabulary | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of every document, with a key that no other piece has.

    A document is its token ids and then `end_id`, so an empty or null text is one token. A
    document longer than the capacity is cut from its end into full pieces; what remains, if
    anything, is its first piece. Rows are taken as they are: a repeated row gives pieces of its
    own, a null doc_id stays null, an empty table gives no piece; other columns are not read.
    With `with_ids` a column `ids` holds the token ids. Keys depend on how the scan is split, so
    write the result before it is used twice.
    """
    prepare(docs.sparkSession)
    vocabulary = vocabulary or Vocabulary()
    capacity, end = params.capacity, np.array([params.end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(vocabulary)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
                data = encode(text) + end
                total = len(data) // 4
                start, piece = 0, 0
                while start < total:
                    length = min(total - start, capacity) if start else (total % capacity or capacity)
                    part = data[4 * start : 4 * (start + length)]
                    row = (key, doc_id, piece, start, length, zlib.crc32(part))
                    for column, value in zip(columns, (*row, part) if with_ids else row):
                        column.append(value)
                    key, piece, start = key + 1, piece + 1, start + length
            arrays = [
                pa.array(columns[0], pa.int64()),
                pa.array(columns[1], pa.int64()),
                pa.array(columns[2], pa.int32()),
                *(pa.array(c, pa.int64()) for c in columns[3:6]),
            ]
            names = ["key", "doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(p, "<i4") for p in columns[6]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


# --- one island ---------------------------------------------------------------------------


class _Space:
    """Bins by the room they have left, for best fit."""

    def __init__(self, lengths: list[int], capacity: int, bins: list[list[int]]):
        self.lengths, self.capacity, self.bins = lengths, capacity, bins
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0
        self.left = [capacity - sum(lengths[i] for i in b) for b in bins]
        for number, room in enumerate(self.left):
            self._offer(number, room)

    def _offer(self, number: int, room: int) -> None:
        self.by_room.setdefault(room, []).append(number)
        self.rooms |= 1 << room

    def best_fit(self, items: list[int]) -> None:
        """Put every item into the fullest bin that still takes it, or else into a new one."""
        for item in items:
            size = self.lengths[item]
            fitting = self.rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                waiting = self.by_room[room]
                number = waiting.pop()
                if not waiting:
                    self.rooms ^= 1 << room
                self.bins[number].append(item)
            else:
                number, room = len(self.bins), self.capacity
                self.bins.append([item])
                self.left.append(room)
            self.left[number] = room - size
            self._offer(number, room - size)


class Island:
    """A population of packings of the same items, each a list of bins."""

    def __init__(self, lengths: list[int], params: PackingParams, seed: int):
        self.lengths, self.params, self.random = lengths, params, random.Random(seed)
        self.order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))

    def fresh(self, spread: float) -> list[list[int]]:
        """Best fit by decreasing length, blurred by `spread` (0: exactly decreasing)."""
        order = self.order
        if spread:
            key = {i: self.lengths[i] * (1 + spread * self.random.random()) for i in order}
            order = sorted(order, key=key.__getitem__, reverse=True)
        space = _Space(self.lengths, self.params.capacity, [])
        space.best_fit(order)
        return space.bins

    def fitness(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins first, then the more uneven fill, which leaves room in few bins."""
        fills = [sum(map(self.lengths.__getitem__, b)) for b in bins]
        return -len(bins), sum(f * f for f in fills) / self.params.capacity**2

    def place(self, bins: list[list[int]], items: list[int]) -> list[list[int]]:
        space = _Space(self.lengths, self.params.capacity, bins)
        space.best_fit(sorted(items, key=self.lengths.__getitem__, reverse=True))
        return space.bins

    def crossover(self, one: list[list[int]], other: list[list[int]]) -> list[list[int]]:
        """Inject well-filled bins of `other` into `one` and best-fit what loses its place."""
        least = self.params.well_filled * self.params.capacity
        full = [b for b in other if sum(map(self.lengths.__getitem__, b)) >= least]
        injected = self.random.sample(full, (len(full) + 1) // 2)
        inside = {i for b in injected for i in b}
        stay = [list(b) for b in injected]
        displaced: list[int] = []
        for b in one:
            if inside.isdisjoint(b):
                stay.append(list(b))
            else:
                displaced.extend(i for i in b if i not in inside)
        return self.place(stay, displaced)

    def mutate(self, bins: list[list[int]]) -> list[list[int]]:
        """Dissolve the emptiest bins and a few others, and best-fit their items."""
        fills = sorted(range(len(bins)), key=lambda n: sum(map(self.lengths.__getitem__, bins[n])))
        out = set(fills[: max(1, len(bins) // 50)])
        out.update(self.random.sample(range(len(bins)), max(1, len(bins) // 50)))
        stay = [list(b) for n, b in enumerate(bins) if n not in out]
        return self.place(stay, [i for n in out for i in bins[n]])

    def evolve(self, population: list[list[list[int]]]) -> list[list[list[int]]]:
        """The fittest of parents and children after the generations of one epoch, best first."""
        scored = sorted(((self.fitness(b), b) for b in population), key=lambda x: x[0], reverse=True)
        for _ in range(self.params.generations):
            one, other = self.random.sample(scored, 2) if len(scored) > 1 else (scored[0], scored[0])
            child = self.mutate(self.crossover(max(one, other, key=lambda x: x[0])[1], min(one, other, key=lambda x: x[0])[1]))
            scored.append((self.fitness(child), child))
            scored = sorted(scored, key=lambda x: x[0], reverse=True)[: self.params.population]
        return [b for _, b in scored]


def _to_bytes(bins: list[list[int]], n: int) -> bytes:
    number = np.empty(n, "<i4")
    for k, b in enumerate(bins):
        number[b] = k
    return number.tobytes()


def _to_bins(data: bytes) -> list[list[int]]:
    number = np.frombuffer(data, "<i4")
    bins: list[list[int]] = [[] for _ in range(int(number.max(initial=-1)) + 1)]
    for i, k in enumerate(number.tolist()):
        bins[k].append(i)
    return bins


def _settle(params: PackingParams) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Found the islands of one block: its items and their first packings."""

    def settle(block: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("key")
        keys, lengths = items["key"].to_numpy("<i8"), items["length"].to_numpy("<i4")
        rows = []
        for number in range(params.islands):
            island = Island(lengths.tolist(), params, int(block[0]) * 31 + number)
            spreads = [0.0 if number == 0 else 0.02, *(0.05 * (k + 1) for k in range(params.population - 1))]
            rows.append((block[0], number, keys.tobytes(), lengths.tobytes(), [_to_bytes(island.fresh(s), len(keys)) for s in spreads], None))
        return pd.DataFrame(rows, columns=["block", "island", "keys", "lengths", "packings", "migrant"])

    return settle


def _epoch(params: PackingParams, number: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """One epoch of an island: take in the migrant, evolve, and send the best packing on."""

    def epoch(at: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["keys"].notna()].iloc[0]
        lengths = np.frombuffer(own["lengths"], "<i4").tolist()
        arrived = [m for m in rows["migrant"] if m is not None]
        island = Island(lengths, params, int(at[0]) * 1009 + int(at[1]) * 31 + number)
        evolved = island.evolve([_to_bins(p) for p in [*own["packings"], *arrived]])
        packings = [_to_bytes(b, len(lengths)) for b in evolved]
        on = (int(at[1]) + 1) % params.islands
        sent = [] if on == at[1] else [(at[0], on, None, None, None, packings[0])]
        return pd.DataFrame(
            [(at[0], at[1], own["keys"], own["lengths"], packings, None), *sent],
            columns=["block", "island", "keys", "lengths", "packings", "migrant"],
        )

    return epoch


def _elect(params: PackingParams) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """The best packing of all islands of a block, a row for each item."""

    def elect(block: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["keys"].notna()]
        keys = np.frombuffer(own["keys"].iloc[0], "<i8")
        lengths = np.frombuffer(own["lengths"].iloc[0], "<i4")
        island = Island(lengths.tolist(), params, 0)
        best = max((_to_bins(p[0]) for p in own["packings"]), key=island.fitness)
        number = np.empty(len(keys), "i8")
        offset, fill = np.empty(len(keys), "i8"), np.empty(len(keys), "i8")
        for k, b in enumerate(best):
            sizes = lengths[b]
            ends = np.cumsum(sizes)
            number[b], offset[b], fill[b] = k, ends - sizes, ends[-1]
        return pd.DataFrame({"key": keys, "length": lengths.astype("i8"), "block": block[0], "bin": number, "offset": offset, "fill": fill})

    return elect


# --- all blocks ---------------------------------------------------------------------------


def pack(pieces: DataFrame, params: PackingParams = PackingParams()) -> DataFrame:
    """`key`, `sequence_id` and `offset` for every row of `pieces` (`key` unique, `length`).

    Full pieces are sequences of their own. No length may exceed the capacity; an empty table
    gives an empty table.
    """
    prepare(pieces.sparkSession)
    kinds = params.rounds + 1  # full pieces and the bins of each round number their sequences apart
    full = pieces.filter(F.col("length") >= params.capacity).select(
        "key", (F.col("key") * kinds + params.rounds).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.filter(F.col("length") < params.capacity).select("key", "length")
    done = [full]
    for number in range(params.rounds):
        blocks = max(1, -(-rest.count() // params.block_items))
        dealt = rest.withColumn("block", F.pmod(F.xxhash64("key", F.lit(number)), F.lit(blocks)))
        # Blocks are small but slow to pack: a fixed number of tasks, else Spark would join them by size.
        tasks = min(blocks * params.islands, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        state = dealt.repartition(tasks, "block").groupBy("block").applyInPandas(_settle(params), STATE_SCHEMA)
        for epoch in range(params.epochs):
            islands = state.repartition(tasks, "block", "island").groupBy("block", "island")
            state = islands.applyInPandas(_epoch(params, epoch), STATE_SCHEMA)
        packed = write_and_read(
            state.groupBy("block").applyInPandas(
                _elect(params), "key long, length long, block long, bin long, offset long, fill long"
            ),
            "packed",
        )
        settled = packed
        if number + 1 < params.rounds:
            enough = F.col("fill") >= F.lit(params.well_filled * params.capacity)
            settled, rest = packed.filter(enough), packed.filter(~enough).select("key", "length")
        done.append(
            settled.select(
                "key",
                ((F.col("block") * 2**20 + F.col("bin")) * kinds + number).cast("long").alias("sequence_id"),
                "offset",
            )
        )
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def pack_documents(
    docs: DataFrame,
    params: PackingParams = PackingParams(),
    vocabulary: Vocabulary | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    cut = write_and_read(pieces(docs, params, vocabulary, with_ids), "pieces")
    return cut.join(pack(cut.select("key", "length"), params), "key").drop("key")


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from `pack_documents(..., with_ids=True)`."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
