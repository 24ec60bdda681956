"""Packing of token pieces into windows by minimum bin slack over the histogram of piece lengths."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm.common import WORD_BATCH_BYTES, by_value, listed, map_rows, staged, texts_of
from tabscope.llm.tokens import REMEMBERED_CHUNKS, ChunkEncoder

# Pieces ranked by one task, about; decides only how the ranking is spread.
PIECES_PER_BUCKET = 50_000
LEAST_BUCKETS, MOST_BUCKETS = 32, 4096
# Pieces sent on in one Arrow batch.
BATCH_PIECES = 2_000


def token_pieces(
    df: DataFrame,
    tokenizer: str,
    capacity: int,
    end_id: int = 1,
    key: str = "doc_id",
    text: str = "text",
    remembered: int = REMEMBERED_CHUNKS,
) -> DataFrame:
    """Cut every document's ids (with ``end_id`` after them) into pieces of ``capacity`` and one remainder.

    Rows: doc_id, start, length, doc_tokens and ids (little-endian unsigned 32 bits). A missing or empty text has the
    end id alone; bytes that are no UTF-8 become the replacement character. Repeated rows are cut once each. No other
    column of ``df`` is read. A task remembers about ``remembered`` distinct chunks, which changes no result.
    """
    end = struct.pack("<I", end_id)
    width = 4 * capacity

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        encoder = ChunkEncoder(tokenizer, remembered)
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "start": [], "length": [], "doc_tokens": [], "ids": []}
            for doc, chunks in zip(batch["key"], encoder.encode(batch["text"])):
                ids = b"".join(chunks) + end
                for at in range(0, len(ids), width):
                    piece = ids[at : at + width]
                    for name, value in zip(out, (doc, at // 4, len(piece) // 4, len(ids) // 4, piece)):
                        out[name].append(value)
                if len(out["ids"]) >= BATCH_PIECES:
                    yield out
                    out = {name: [] for name in out}
            yield out

    schema = f"doc_id {df.schema[key].dataType.simpleString()}, start long, length long, doc_tokens long, ids binary"
    return map_rows(texts_of(df, key, text, valid=True), schema, task, WORD_BATCH_BYTES)


def fill_window(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths with their counts, out of ``counts``, whose sum comes closest to ``room`` from below.

    Subset sums over bitsets: bit s of a state says that the lengths seen so far can sum to s. A length with c pieces
    enters as 1, 2, 4, ... pieces and the rest. Walking back, each length gives the fewest pieces that leave a sum
    which the states before it can reach.
    """
    mask = (1 << (room + 1)) - 1
    states, lengths = [1], []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        bits, left, step = states[-1], min(counts[length], room // length), 1
        while left:
            take = min(step, left)
            bits |= (bits << (take * length)) & mask
            left, step = left - take, step * 2
        states.append(bits)
        lengths.append(length)
        if bits >> room:
            break
    target, used = states[-1].bit_length() - 1, {}
    for i in range(len(lengths) - 1, -1, -1):
        taken = 0
        while not states[i] >> target & 1:
            target -= lengths[i]
            taken += 1
        if taken:
            used[lengths[i]] = taken
    return used


def plan_windows(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Minimum bin slack: (number of windows, pieces of each length in one) until every piece has a place.

    Each pattern holds the longest piece left and the fullest fill beside it, and is used as often as the pieces
    allow. That uses up a length each time, so the plan and its cost are bounded by ``capacity``, not by the corpus.
    """
    left, plan = {length: n for length, n in histogram.items() if n > 0}, []
    while left:
        longest = max(left)
        rest = {**left, longest: left[longest] - 1}
        if not rest[longest]:
            del rest[longest]
        pattern = fill_window(rest, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        windows = min(left[length] // n for length, n in pattern.items())
        plan.append((windows, pattern))
        for length, n in pattern.items():
            left[length] -= windows * n
            if not left[length]:
                del left[length]
    return plan


def _segments(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Per pattern and length: the ranks it takes, its first sequence, its pieces a window, its place in the window."""
    taken: dict[int, int] = {}
    rows, first = [], 0
    for windows, pattern in plan:
        place = 0
        for length in sorted(pattern, reverse=True):
            low = taken.get(length, 0)
            taken[length] = low + windows * pattern[length]
            rows.append((length, low, taken[length], first, pattern[length], place))
            place += length * pattern[length]
        first += windows
    return rows


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to pieces that have a ``length`` of 1 to ``capacity``; other columns are kept.

    Only the histogram of lengths (at most ``capacity`` rows) reaches the driver, and the plan made from it goes back
    as at most capacity^2 / 2 short rows, by far fewer in practice. Pieces of one length are ranked in buckets by a
    hash of their row, and buckets by their counts, so a length that holds most rows is spread over all buckets.
    Pieces of an unfit length fail the job. An empty table gives an empty result. Names that begin with two underscores
    are the operator's own.
    """
    spark = pieces.sparkSession
    own = staged(pieces.withColumn("__piece", F.monotonically_increasing_id()), "pieces")
    buckets = min(max(own.count() // PIECES_PER_BUCKET, LEAST_BUCKETS), MOST_BUCKETS)
    bucket = F.pmod(F.xxhash64("__piece"), F.lit(buckets)).cast("int")
    checked = F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(
        F.raise_error(F.lit(f"a piece must have 1 to {capacity} tokens")).cast("long")
    )
    own = own.withColumns({"length": checked, "__bucket": bucket})
    counts = staged(own.groupBy("length", "__bucket").agg(F.count("*").alias("__n")), "piece-counts")
    histogram = {row["length"]: row["n"] for row in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    segments = listed(
        spark,
        _segments(plan_windows(histogram, capacity)),
        "__length long, __low long, __high long, __first long, __per_window long, __place long",
    )
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__bucket").orderBy("__piece")
    ranked = (
        own.withColumn("__in", F.row_number().over(inside) - 1)
        .join(starts, ["length", "__bucket"])
        .withColumn("__rank", F.col("__before") + F.col("__in"))
    )
    placed = ranked.join(
        F.broadcast(segments),
        (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__low")) & (F.col("__rank") < F.col("__high")),
    )
    nth = F.col("__rank") - F.col("__low")
    return placed.select(
        *[F.col(f"`{name}`") for name in pieces.columns],
        (F.col("__first") + F.floor(nth / F.col("__per_window"))).cast("long").alias("sequence_id"),
        (F.col("__place") + nth % F.col("__per_window") * F.col("length")).cast("long").alias("offset"),
    )


by_value(__name__)
