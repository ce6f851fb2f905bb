"""Bound-certified best-fit packing of token sequences.

Documents become pieces: their token ids and the end mark; one longer than a sequence is cut into whole sequences
after a first, shorter piece. Pieces are dealt to partitions of about ``per_partition`` pieces by a hash, so every
partition sees the same mix of lengths, and each partition is packed best-fit decreasing.

Each partition then certifies its own bin count: lower bounds from dual feasible functions (the staircase functions
u(k) after the threshold functions U(e), and the volume) hold for any packing of its pieces, so a partition whose bins
equal its bound is optimal and final. A partition with a gap keeps its full bins and hands the pieces of all others
to an exchange: they are dealt anew, together with those of every other such partition, and packed again. A rerun
replaces the former packing only if it needs fewer bins. It ends when nothing is open or when a rerun saves less than
``gain`` of its bins. Column ``certified`` says which bins are full or of a certified partition; the others' number may not be the least.

Scale: tokenizing is a map over Arrow batches; after it, only piece rows (about 60 bytes) move. The number of partitions
follows the number of pieces, a partition's memory is its pieces, and the driver sees counts. Pieces are dealt by the
hash of a row number, so equal rows don't meet in one partition. They are written to the checkpoint folder once, so
nothing is tokenized twice when an executor is lost and row numbers stay.

Null text is empty: one piece, the end mark alone. Repeated rows are packed as often as they occur. An empty table
gives an empty result. Columns other than id and text are not looked at; ``pack`` replaces columns that it sets itself.
"""

from __future__ import annotations

import base64
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, slices, table, without

#: All that byte_bpe_50k.json keeps as one token although it is no merge.
SPECIAL = "<|endoftext|>"


@cache
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _ranks(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, tokenizer: str = "byte_bpe_50k.json", same_as: str | None = "byte_bpe_50k.tiktoken") -> np.ndarray:
    """The ids that ``tokenizers`` gives with this file, as unsigned 32-bit numbers.

    same_as: the same vocabulary as ranks, which encodes several times as fast. It serves texts in Latin letters; texts
    with code points from U+0250 on, where the two libraries' Unicode tables might differ, those that hold the special
    token, and those with a run of blanks that is too long for its pattern's stack take the library itself. None: always the library.
    """
    import public_tokenizers

    if same_as and SPECIAL not in text:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if not len(raw) or raw.max() < 0xC9:
            try:
                return np.asarray(_ranks(public_tokenizers.path(same_as), public_tokenizers.PATTERN).encode_to_numpy(text, disallowed_special=()), np.uint32)
            except ValueError:
                pass
    return np.array(_library(public_tokenizers.path(tokenizer)).encode(text, add_special_tokens=False).ids, np.uint32)


def pieces_of(ids: np.ndarray, size: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids."""
    raw = np.ascontiguousarray(ids, "<u4")
    first = (len(raw) - 1) % size + 1
    cuts = [0, *range(first, len(raw) + 1, size)]
    return [(i, a, b - a, zlib.crc32(raw[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 2, **tokenizer) -> DataFrame:
    """id, piece, start, length, ids_crc32."""

    def run(batches):
        for batch in slices(batches, text_col, 1 << 20):
            rows, of = [], []
            for i, text in enumerate(batch.column(text_col).to_pylist()):
                found = pieces_of(np.append(token_ids(text or "", **tokenizer), np.uint32(end_id)), size)
                rows += found
                of += [i] * len(found)
            piece, start, length, crc = zip(*rows)
            ids = batch.column(id_col).take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], [id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length, and the number of bins."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(size + 1)]  # open bins by the room they have
    some, n = 0, 0  # bit r of some: there are bins with room r
    for i, need in zip(order.tolist(), lengths[order].tolist()):
        fits = some >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                some ^= 1 << left
        else:
            left, b, n = size, n, n + 1
        bins[i], offsets[i] = b, size - left
        left -= need
        if left:
            room[left].append(b)
            some |= 1 << left
    return bins, offsets, n


def lower_bound(counts: np.ndarray, size: int, most_k: int = 12) -> int:
    """Bins that any packing needs. counts: of each length from 0 to size.

    U(e) sets lengths above size-e to size and those below e to 0; u(k) takes x to floor((k+1)x)/k unless (k+1)x is
    whole. Both are dual feasible, and so is one after the other; all in whole numbers.
    """
    x = np.arange(size + 1, dtype=np.int64)
    e = np.arange(size // 2 + 1, dtype=np.int64)[:, None]
    cut = np.where(x > size - e, size, np.where(x < e, 0, x))
    best = int(-(-(cut @ counts).max() // size))
    for k in range(1, most_k + 1):
        stairs = np.where((k + 1) * cut % size == 0, k * cut, (k + 1) * cut // size * size)
        best = max(best, int(-(-(stairs @ counts).max() // (k * size))))
    return best


def pack(pieces: DataFrame, size: int = 1024, per_partition: int = 32768, gain: float = 0.002, seed: int = 7) -> DataFrame:
    """pieces (with length) and sequence_id, offset (gapless from 0 within each sequence), certified.

    Best-fit decreasing never needs more than 11/9 of the fewest bins (and one), so reruns that each save ``gain`` end by themselves.
    """
    pieces = durable(without(pieces, "sequence_id", "offset", "certified"))
    names = pieces.columns
    whole = pieces.where(F.col("length") >= size)
    state = pieces.where(F.col("length") < size)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, certified boolean"

    def deal(df: DataFrame, n: int, turn: int) -> DataFrame:
        parts = max(1, -(-n // per_partition))
        return df.withColumn("_ff_part", F.pmod(F.xxhash64(F.lit(seed + turn), F.monotonically_increasing_id()), F.lit(parts)))

    def packer(turn: int):
        def run(part: pa.Table) -> pa.Table:
            lengths = part["length"].to_numpy()
            bins, offsets, n = best_fit_decreasing(lengths, size)
            least = n == lower_bound(np.bincount(lengths, minlength=size + 1), size)
            full = np.bincount(bins, weights=lengths, minlength=n)[bins] == size
            first = (turn << 56) + (part["_ff_part"][0].as_py() << 32)
            out = part.select(names).append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets))
            return out.append_column("certified", pa.array(least | full))

        return run

    done: list[DataFrame] = []
    n, last, turn = state.count(), None, 0
    while n:
        turn += 1
        now = durable(deal(state, n, turn).groupBy("_ff_part").applyInArrow(packer(turn), kind))
        if last is not None:
            bins = now.agg(F.count_distinct("sequence_id")).first()[0]
            if bins > last[1] * (1 - gain):
                done.append(now if bins < last[1] else last[0])
                break
        done.append(now.where("certified"))
        rest = now.where("not certified")
        n, bins = rest.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        last, state = (rest, bins), rest.select(*names)
    # Whole sequences need no partner: they number themselves.
    out = whole.select(*names, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    for df in done:
        out = out.unionByName(df)
    return out


def pack_documents(docs: DataFrame, size: int = 1024, **options) -> DataFrame:
    return pack(tokenize(docs, size=size), size, **options)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
