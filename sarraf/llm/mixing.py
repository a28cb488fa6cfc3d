"""Mixing sources to target shares of the tokens (problem 9).

Each source is one stream of tokens, its documents in a pseudorandom order, cut into blocks of
a fixed number of tokens. The output is a row of slots, one block each. Every shard of slots
draws how many it takes of each source; slot r of a source stands for block pi(r mod B) of its
B blocks, pi being a pseudorandom permutation of its own for each pass over the source. Slots
and blocks are then joined by source and block number, so a large source is spread evenly.
Draws and permutations follow from the seed and the number of the shard, so each task works
out its own and the driver holds one row a source.

The draws are multinomial under the condition that all shards together take the planned number
of slots of each source: shares come out as planned, and no source passes its most repeats.
"""

from __future__ import annotations

import base64
import importlib.util
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sarraf.session import cut

#: Where the public tokenizer files lie on every executor, unless the session names another folder.
TOKENIZERS = "/opt/tokenizers"
_LONG = 100_000


def tokenizer_folder(spark: SparkSession) -> str:
    return spark.conf.get("spark.sarraf.tokenizers", TOKENIZERS)


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """A tokenizer from a public file of byte-pair ranks (.tiktoken); it is never trained here.

    The file's folder is a small package that states the pattern by which texts are split.
    """
    import tiktoken

    folder = path.rpartition("/")[0]
    spec = importlib.util.spec_from_file_location("tokenizer_files", f"{folder}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, tokenizer) -> int:
    """The tokens of a text; a very long one is counted in pieces that end with a blank where there is one."""
    total = 0
    while len(text) > _LONG:
        end = text.rfind(" ", _LONG // 2, _LONG)
        end = _LONG if end < 0 else end
        total, text = total + len(tokenizer.encode_ordinary(text[:end])), text[end:]
    return total + len(tokenizer.encode_ordinary(text))


def token_counts(documents: DataFrame, doc: str, text: str, source: Column, path: str) -> DataFrame:
    """`doc`, `source`, `tokens` of every document with a source and at least one token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(path)
        for batch in batches:
            sizes = [count_tokens(t, tokenizer) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc", "source", "tokens"])

    rows = documents.select(F.col(doc).cast("long").alias("doc"), source.alias("source"), F.col(text).alias("text")).where("doc is not null and source is not null and text is not null")
    return rows.mapInArrow(count, "doc long, source string, tokens long").where("tokens > 0")


@dataclass
class Plan:
    """What one source gives: its blocks, its slots in the output, and the share it was to have."""

    source: str
    target: float
    most: int
    tokens: int
    blocks: int
    slots: int


def plan_slots(targets: list[tuple[str, float, int]], sizes: dict[str, int], length: int, total: int | None = None) -> list[Plan]:
    """How many slots of `length` tokens each source gets.

    Without `total` the output is as long as it can be while every source that has tokens
    keeps to its share (over the shares of those sources). With a greater `total`, sources
    give what their repeats allow and the others keep their proportions.
    """
    with_tokens = [(s, w, m) for s, w, m in targets if sizes.get(s, 0) > 0 and w > 0 and m > 0]
    whole = sum(w for _, w, _ in with_tokens)
    caps = {s: m * sizes[s] for s, w, m in with_tokens}
    if total is None:
        total = math.floor(min((caps[s] * whole / w for s, w, _ in with_tokens), default=0))
    wanted: dict[str, float] = {}
    left, open_sources = float(total), dict((s, w) for s, w, _ in with_tokens)
    while open_sources:  # sources at their cap leave; what they cannot give goes to the others
        scale = left / sum(open_sources.values())
        full = [s for s, w in open_sources.items() if w * scale > caps[s] * (1 + 1e-12)]
        if not full:
            wanted |= {s: w * scale for s, w in open_sources.items()}
            break
        for s in full:
            wanted[s] = float(caps[s])
            left -= caps[s]
            del open_sources[s]
    plans = []
    for s, w, m in targets:
        blocks = -(-sizes.get(s, 0) // length)
        slots = 0
        if s in wanted:  # the last block of a source is short, so a slot is a little less than `length`
            slots = min(round(wanted[s] * blocks / sizes[s]), m * blocks)
        plans.append(Plan(s, w, m, sizes.get(s, 0), blocks, slots))
    return plans


def draw_shards(plans: list[Plan], shard: int, seed: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number, slots taken of each source before it, slots of each source) of the shards `first` to `last` - 1.

    Multinomial draws under the condition that all shards of `shard` slots together take the
    plan's slots: the shards are halved again and again, and each half draws its part of what
    is left without putting back. Every draw has a generator of its own, keyed by the half, so
    a task that wants some shards draws only on the way down to them, alike in every task.
    """
    slots = np.array([p.slots for p in plans], np.int64)
    whole = int(slots.sum())

    def within(lo: int, hi: int, before: np.ndarray, mine: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if hi <= first or lo >= last:
            return
        if hi - lo == 1:
            yield lo, before, mine
            return
        middle = (lo + hi) // 2
        left = _without_putting_back(mine, min(middle * shard, whole) - lo * shard, np.random.default_rng([seed, lo, hi]))
        yield from within(lo, middle, before, left)
        yield from within(middle, hi, before + left, mine - left)

    if whole:
        yield from within(0, -(-whole // shard), np.zeros_like(slots), slots)


def _without_putting_back(colours: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each colour come when `take` are drawn; numpy draws up to 1e9, beyond that the normal limit is rounded."""
    out = np.zeros_like(colours)
    left = int(colours.sum())
    for i, n in enumerate(colours.tolist()):
        rest = left - n
        if take and n:
            if n < 10**9 and rest < 10**9:
                out[i] = rng.hypergeometric(n, rest, take)
            else:
                mean, spread = take * (n / left), math.sqrt(take * (n / left) * (rest / left) * ((left - take) / max(left - 1, 1)))
                out[i] = min(max(round(rng.normal(mean, spread)), take - rest, 0), n, take)
        take, left = take - int(out[i]), rest
    return out


_ROUNDS = 4


def permuted(places: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The images of `places` under pseudorandom permutations of 0..size-1, one for each `key`.

    A Feistel network over the least even number of bits that holds `size`; images beyond
    `size` are sent through it again until they fall inside.
    """
    size = size.astype(np.uint64)
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2).astype(np.float64) + 1)).astype(np.uint64) + np.uint64(1)) // np.uint64(2), np.uint64(1))
    low = (np.uint64(1) << half) - np.uint64(1)
    x, todo = places.astype(np.uint64), np.arange(len(places))
    while len(todo):
        h, m, k = half[todo], low[todo], key[todo].astype(np.uint64)
        left, right = x[todo] >> h, x[todo] & m
        for turn in range(_ROUNDS):
            left, right = right, left ^ (_scrambled(right + (k ^ np.uint64(turn * 0x9E3779B97F4A7C15 & (2**64 - 1)))) & m)
        x[todo] = left << h | right
        todo = todo[x[todo] >= size[todo]]
    return x.astype(np.int64)


def _scrambled(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit number over all others."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def slot_table(spark: SparkSession, plans: list[Plan], shard: int, seed: int) -> DataFrame:
    """`shard`, `slot`, `source`, `pass`, `block` of every slot; draws and permutations are worked out in the tasks."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([p.source for p in plans])
        blocks = np.array([p.blocks for p in plans], np.int64)
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for k, before, mine in draw_shards(plans, shard, seed, int(numbers[0]), int(numbers[-1]) + 1):
                of = np.repeat(np.arange(len(plans)), mine)
                rank = before[of] + np.arange(len(of)) - np.repeat(np.cumsum(mine) - mine, mine)
                turn = rank // blocks[of]
                block = permuted(rank % blocks[of], blocks[of], _scrambled((of.astype(np.uint64) << np.uint64(32)) + turn.astype(np.uint64) + np.uint64(seed)))
                at = permuted(np.arange(len(of)), np.full(len(of), len(of)), np.full(len(of), k + (seed << 32), np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), k)), pa.array(at), names.take(pa.array(of)), pa.array(turn.astype(np.int32)), pa.array(block)], names=["shard", "slot", "source", "pass", "block"])

    shards = -(-sum(p.slots for p in plans) // shard)
    tasks = max(1, min(shards, max(spark.sparkContext.defaultParallelism, shards // 64)))
    return spark.range(0, shards, 1, tasks).mapInArrow(fill, "shard long, slot long, source string, pass int, block long")


def pack(counts: DataFrame, length: int, seed: int, bucket: int = 20_000) -> DataFrame:
    """`source`, `block`, `doc`, `from_token`, `n`: the piece of each document in each block.

    Documents are ordered by hash within buckets of about `bucket` documents, the buckets of a
    source by number, so no task orders a whole source.
    """
    docs = cut(counts.withColumn("_h", F.xxhash64("doc", F.lit(seed))))
    sizes = docs.groupBy("source").agg(F.count("*").alias("_n")).withColumn("_buckets", F.ceil(F.col("_n") / bucket)).select("source", "_buckets")
    docs = docs.join(F.broadcast(sizes), "source").withColumn("_bucket", F.pmod("_h", "_buckets"))  # sizes: one row a source of the targets
    totals = docs.groupBy("source", "_bucket").agg(F.sum("tokens").alias("_t"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source", "_bucket", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_h", "doc").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("_at", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(starts, ["source", "_bucket"])
    placed = placed.select("source", "doc", "tokens", (F.col("_start") + F.col("_at")).alias("at"))
    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("tokens") - 1) / length)
    pieces = placed.select("*", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("block") * length, F.col("at"))
    end = F.least((F.col("block") + 1) * length, F.col("at") + F.col("tokens"))
    return pieces.select("source", "block", "doc", (begin - F.col("at")).alias("from_token"), (end - begin).alias("n"))


@dataclass
class Mixture:
    pieces: DataFrame
    plans: list[Plan]


def mix(counts: DataFrame, targets: list[tuple[str, float, int]], length: int = 512, shard: int = 4096, seed: int = 11, total: int | None = None) -> Mixture:
    """The mixture: `shard`, `slot`, `source`, `pass`, `block`, `doc`, `from_token`, `n`.

    `counts` is as of `token_counts`; `targets` are (source, share, most repeats), small by
    nature. Documents of other sources are not drawn. A source without documents gives
    nothing and its share goes to the others in proportion. Repeated documents of one id are
    taken as they stand. Nothing is drawn from an empty table.
    """
    wanted = [s for s, _, _ in targets]
    counts = cut(counts.where(F.col("source").isin(wanted)))
    sizes = {r[0]: r[1] for r in counts.groupBy("source").agg(F.sum("tokens")).collect()}
    plans = plan_slots(targets, sizes, length, total)
    slots = slot_table(counts.sparkSession, plans, shard, seed)
    return Mixture(slots.join(pack(counts, length, seed), ["source", "block"]), plans)


def shares(mixture: Mixture) -> DataFrame:
    """`source`, `target_share`, `actual_share`, `available_tokens`, `drawn_tokens`, `most_passes` of each target."""
    spark = mixture.pieces.sparkSession
    drawn = mixture.pieces.groupBy("source").agg(F.sum("n").alias("drawn_tokens"), (F.max("pass") + 1).alias("most_passes"))
    plans = spark.createDataFrame([(p.source, p.target, p.tokens, p.most) for p in mixture.plans], "source string, target_share double, available_tokens long, max_repeats int")
    both = plans.join(drawn, "source", "left").withColumns({"drawn_tokens": F.coalesce("drawn_tokens", F.lit(0).cast("long")), "most_passes": F.coalesce("most_passes", F.lit(0))})
    whole = both.agg(F.sum("drawn_tokens").alias("_all"))
    share = F.when(F.col("_all") > 0, F.col("drawn_tokens") / F.col("_all")).otherwise(0.0)
    return both.crossJoin(F.broadcast(whole)).select("source", "target_share", share.alias("actual_share"), "available_tokens", "drawn_tokens", "most_passes", "max_repeats")
