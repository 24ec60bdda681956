"""Ranked lexical search: bundles of items carry sparse document accumulators through the stages of term owners."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm.common import by_value, map_rows, staged

# Documents and bytes of text in one block, the unit in which posting lists and accumulators are cut.
BLOCK_DOCS, BLOCK_BYTES = 4096, 16 << 20
# Items in one bundle, and stages of term owners that a bundle passes.
BUNDLE_ITEMS, OWNERS = 256, 4
# Bytes of item texts searched at a time; their terms and weights go to every task. More items take more rounds.
WAVE_BYTES = 16 << 20
# The scale of an impact and of a weight, and the share of the length that adjusts it, in percent.
IMPACT, WEIGHT, LENGTH_SHARE = 1_000_000_000, 1000, 75
_SEPARATORS = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all bytes beyond ASCII, with A-Z lower-cased."""
    return (text or b"").translate(_SEPARATORS).split()


@dataclass
class Wave:
    """A bounded set of items: their keys, and per bundle the items that ask for each term, with how often."""

    keys: list
    vocabulary: dict[bytes, int]
    asked: list[dict[int, list[tuple[int, int]]]] = field(default_factory=list)

    @staticmethod
    def of(rows: list[tuple]) -> Wave:
        wave = Wave([key for key, _ in rows], {})
        for at, (_, text) in enumerate(rows):
            if at % BUNDLE_ITEMS == 0:
                wave.asked.append({})
            for term, times in Counter(terms_of(text)).items():
                number = wave.vocabulary.setdefault(term, len(wave.vocabulary))
                wave.asked[-1].setdefault(number, []).append((at % BUNDLE_ITEMS, times))
        return wave


def _blocks(batches: Iterator[dict]) -> Iterator[list[tuple]]:
    """The rows of a task in blocks of bounded documents and bytes."""
    block, size = [], 0
    for batch in batches:
        for row in zip(batch["key"], batch["text"]):
            block.append(row)
            size += len(row[1] or b"")
            if len(block) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                yield block
                block, size = [], 0
    if block:
        yield block


def inverted(docs: DataFrame, wave: Wave) -> DataFrame:
    """The posting lists of the wave's terms, block by block; a written table.

    A row per block and term: the slots of the documents in ascending order and how often each holds the term. A row of
    term -1 per block holds the keys of its documents and their numbers of terms. Slots follow the keys (NULL
    last), so that among equal scores the smaller slot is the smaller key.
    """
    kind = docs.schema["key"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(wave.vocabulary)

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        known, base = shared.value, TaskContext.get().partitionId() << 32
        for at, block in enumerate(_blocks(batches)):
            block.sort(key=lambda row: (row[0] is None, row[0]))
            lists: dict[int, tuple[list, list]] = {}
            sizes = np.zeros(len(block), np.int64)
            for slot, (_, text) in enumerate(block):
                terms = terms_of(text)
                sizes[slot] = len(terms)
                for term, times in Counter(terms).items():
                    number = known.get(term)
                    if number is not None:
                        slots, tfs = lists.setdefault(number, ([], []))
                        slots.append(slot)
                        tfs.append(times)
            order = sorted(lists)
            yield {
                "block": [base + at] * (1 + len(order)),
                "term": [-1, *order],
                "slots": [None, *[np.array(lists[n][0], "<u2").tobytes() for n in order]],
                "counts": [sizes.astype("<i8").tobytes(), *[np.array(lists[n][1], "<u4").tobytes() for n in order]],
                "keys": [[key for key, _ in block], *[None] * len(order)],
                "docs": [int((sizes > 0).sum()), *[len(lists[n][0]) for n in order]],
                "terms": [int(sizes.sum()), *[None] * len(order)],
            }

    schema = f"block long, term int, slots binary, counts binary, keys array<{kind}>, docs long, terms long"
    return staged(map_rows(docs, schema, task), "search-index")


def owners_of(weights: np.ndarray, lengths: np.ndarray, owners: int) -> np.ndarray:
    """The owner of each term: descending weights, cut where the posting lists of the owners are about equally long.

    Rare terms, which tell documents apart, come first, so that later stages have high scores to compare with.
    """
    order = np.lexsort((np.arange(len(weights)), -weights))
    before = np.cumsum(lengths[order]) - lengths[order]
    found = np.zeros(len(weights), np.int32)
    found[order] = np.minimum(before * owners // max(int(lengths.sum()), 1), owners - 1)
    return found


@dataclass
class Scorer:
    """What every stage needs of a wave: weights, items by term, and what later owners can still add to an item."""

    asked: list[dict[int, list[tuple[int, int]]]]
    weights: np.ndarray
    later: list[np.ndarray]
    n_docs: int
    n_terms: int
    top: int

    def scores(self, bundle: int, left: dict, right: pa.Table) -> np.ndarray:
        """Items by documents of one block: the carried scores and the contributions of this owner's terms."""
        sizes = np.frombuffer(left["sizes"], "<i8")
        adjusted = 100 - LENGTH_SHARE + (LENGTH_SHARE * sizes * self.n_docs) // max(self.n_terms, 1)
        total = np.zeros((len(self.later[bundle]), len(sizes)), np.int64)
        if left["items"]:
            places = np.frombuffer(left["items"], "<u2"), np.frombuffer(left["slots"], "<u2")
            total[places] = np.frombuffer(left["scores"], "<i8")
        for term, slots, counts in zip(*(right[name].to_pylist() for name in ("term", "slots", "counts"))):
            slots, tf = np.frombuffer(slots, "<u2"), np.frombuffer(counts, "<u4").astype(np.int64)
            impact = self.weights[term] * ((IMPACT * tf) // (WEIGHT * tf + 8 * adjusted[slots]))
            for item, times in self.asked[bundle][term]:
                total[item, slots] += times * impact
        return total

    def least(self, total: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Per item a score that its top documents reach for certain: the best known, or the top-th of this block."""
        if total.shape[1] < self.top:
            return given
        nth = np.partition(total, total.shape[1] - self.top, axis=1)[:, total.shape[1] - self.top]
        return np.maximum(given, nth)


CARRIED = "bundle int, block long, keys array<{kind}>, sizes binary, items binary, slots binary, scores binary, least array<long>"


def _stage(state: DataFrame, postings: DataFrame, scorer: Scorer, floors: dict[int, list[int]], last: bool, kind: str) -> DataFrame:
    """One owner's stage: each bundle meets, block by block, the owner's posting lists.

    A document is carried on if its score can still reach the item's floor with all that later owners can add; those that
    fall out cannot be among the top, with ties counted as reaching it. The last stage gives each block's own top.
    """
    schema = f"bundle int, item int, score long, key {kind}, slot int" if last else CARRIED.format(kind=kind)
    arrow = _arrow(schema)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        bundle, given = key[0].as_py(), left.to_pylist()[0]
        total = scorer.scores(bundle, given, right)
        floor = np.array(floors.get(bundle) or [0] * len(total), np.int64)
        floor = scorer.least(total, floor)
        alive = (total > 0) & (total + scorer.later[bundle][:, None] >= floor[:, None])
        items, slots = np.nonzero(alive)
        scores = total[items, slots]
        if last:
            order = np.lexsort((slots, -scores, items))
            items, slots, scores = items[order], slots[order], scores[order]
            starts = np.searchsorted(items, np.arange(len(total)))
            kept = np.arange(len(items)) - starts[items] < scorer.top
            items, slots, scores = items[kept], slots[kept], scores[kept]
            own = [given["keys"][slot] for slot in slots.tolist()]
            return pa.table([pa.array([bundle] * len(items)), items, scores, own, slots], names=arrow.names).cast(arrow)
        carried = [items.astype("<u2").tobytes(), slots.astype("<u2").tobytes(), scores.astype("<i8").tobytes()]
        row = [bundle, given["block"], given["keys"], given["sizes"], *carried, floor.tolist()]
        return pa.table([pa.array([value], f.type) for value, f in zip(row, arrow)], schema=arrow)

    return state.groupBy("bundle", "block").cogroup(postings.groupBy("to_bundle", "of_block")).applyInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _search_wave(docs: DataFrame, wave: Wave, top: int, owners: int) -> DataFrame:
    """(number of the item in the wave, score, key, block's slot) of each block's best documents."""
    spark, kind = docs.sparkSession, docs.schema["key"].dataType.simpleString()
    index = inverted(docs, wave)
    heads = index.where("term = -1")
    size = heads.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    n_docs, n_terms = size["docs"] or 0, size["terms"] or 0
    lengths = np.zeros(max(len(wave.vocabulary), 1), np.int64)
    for row in index.where("term >= 0").groupBy("term").agg(F.sum("docs").alias("docs")).collect():
        lengths[row["term"]] = row["docs"]
    ratios = [(2 * n_docs + 2) / (2 * int(n) + 1) for n in lengths]
    weights = np.array([math.floor(WEIGHT * math.log(ratio)) for ratio in ratios], np.int64)
    owner = owners_of(weights, lengths, owners)

    bundles = [(term, int(owner[term]), b) for b, own in enumerate(wave.asked) for term in own]
    routes = spark.createDataFrame(bundles, "term int, owner int, to_bundle int")
    lists = index.where("term >= 0").select(F.col("block").alias("of_block"), "term", "slots", "counts")
    postings = lists.join(F.broadcast(routes), "term")
    sizes = [min(BUNDLE_ITEMS, len(wave.keys) - b * BUNDLE_ITEMS) for b in range(len(wave.asked))]
    state = heads.select(
        F.explode(F.sequence(F.lit(0), F.lit(len(sizes) - 1))).alias("bundle"),
        "block",
        "keys",
        F.col("counts").alias("sizes"),
        *[F.lit(None).cast("binary").alias(name) for name in ("items", "slots", "scores")],
        F.lit(None).cast("array<bigint>").alias("least"),
    )
    floors: dict[int, list[int]] = {}
    for at in range(owners):
        # An impact is below WEIGHT * WEIGHT, as IMPACT * tf / (WEIGHT * tf + more) is.
        later = [np.zeros(n, np.int64) for n in sizes]
        for b, own in enumerate(wave.asked):
            for term, items in own.items():
                if owner[term] > at:
                    for item, times in items:
                        later[b][item] += times * int(weights[term]) * (IMPACT // WEIGHT)
        scorer = Scorer(wave.asked, weights, later, n_docs, n_terms, top)
        state = staged(_stage(state, postings.where(F.col("owner") == at), scorer, floors, at == owners - 1, kind), "search")
        if at < owners - 1:
            reached = state.select("bundle", F.posexplode("least").alias("item", "least"))
            floors = {b: [0] * n for b, n in enumerate(sizes)}
            for row in reached.groupBy("bundle", "item").agg(F.max("least").alias("least")).collect():
                floors[row["bundle"]][row["item"]] = row["least"]
    return state.select((F.col("bundle") * BUNDLE_ITEMS + F.col("item")).alias("number"), "score", "key", "slot")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    top: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    owners: int = OWNERS,
    wave_bytes: int = WAVE_BYTES,
) -> DataFrame:
    """(item key, rank, key, score): the ``top`` documents of every item, by scores of integers above 0.

    Terms, weights and lengths are those of the whole of ``docs``. Equal scores are ordered by key, NULL last, each row
    a document of its own, whatever its key; each row of ``items`` is an item of its own. Missing texts have no terms and
    get no rank; invalid UTF-8 is compared byte by byte. Empty tables give no rows; other columns play no part.

    Documents are indexed in blocks, so no posting list is longer than a block and a frequent term is spread like its
    documents. Terms are dealt to ``owners``. A bundle of items passes the owners one after the other: per block, its
    accumulators are cogrouped with the owner's lists, and the sums written as a table. Then the top of each block, and of
    all. Items are searched in waves of about ``wave_bytes`` of text, whose terms go to every task; each wave reads the
    documents again, however many terms it has.
    """
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    asked = items.select(F.col(f"`{item_key}`").alias("key"), F.col(f"`{item_text}`").cast("binary").alias("text"))
    asked = staged(asked.withColumn("row", F.monotonically_increasing_id()), "search-items")
    size = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    waves = -(-size // wave_bytes)
    item_kind, kind = asked.schema["key"].dataType.simpleString(), texts.schema["key"].dataType.simpleString()
    found = docs.sparkSession.createDataFrame([], f"row long, score long, key {kind}, slot int, item {item_kind}")
    for number in range(waves):
        rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(waves)) == number).orderBy("row").collect()
        if not rows:
            continue
        wave = Wave.of([(row["row"], bytes(row["text"] or b"")) for row in rows])
        keys = [(at, row["row"], row["key"]) for at, row in enumerate(rows)]
        names = docs.sparkSession.createDataFrame(keys, f"number int, row long, item {item_kind}")
        best = _search_wave(texts, wave, top, owners).join(F.broadcast(names), "number")
        found = found.unionByName(best.drop("number"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("key"), "slot")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score")


by_value(__name__)
