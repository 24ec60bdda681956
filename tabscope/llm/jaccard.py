"""Exact Jaccard join on word shingles with adaptive multi-match prefixes, as components of linked documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from tabscope.llm.common import BROADCAST_KEYS, by_value, except_rows, map_rows, semi, staged, texts_of
from tabscope.operators.joins import lookup_join, measured_bytes
from tabscope.session import unstage

SHINGLE_WORDS = 5
PERCENT = 75
# A token with a longer posting list is expensive and is not used to find pairs, as long as the prefixes are long enough
# to do without it. It decides how pairs are found, never which.
LONG_LIST = 50
# Every set asks for so many shared tokens at least, and for one more per so many tokens of its size.
LEAST_MATCHES, TOKENS_PER_MATCH = 2, 12
# Prefix extensions that the cost estimate chooses from (shared tokens required).
MATCHES = (1, 2, 4, 8, 16)
REMEMBERED_WORDS = 250_000
# A token that holds more than this share of all postings is known to be expensive before they are dealt by token.
HOT_SHARE, TRACKED_TOKENS = 1000, 8192
# Distinct posting lists that a task counts before it passes them on, and pairs at one centre that one task compares.
COUNTED_LISTS, CENTRE_PAIRS = 50_000, 1 << 20
# Odd multipliers, one per word of a shingle (as many as the longest shingle), and the last mix.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class WordHashes(dict):
    """Signed 64-bit hash of each distinct word."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value = value - (1 << 64) if value >> 63 else value
        return value


def shingle_set(text: bytes | None, known: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; a shorter text is one shingle, an empty one has none."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    hashes = np.fromiter(map(known.__getitem__, words), np.int64, len(words)).view(np.uint64)
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total = (total ^ hashes[k : k + len(total)]) * _STEP
            total ^= total >> np.uint64(29)
        total *= _MIX
        total ^= total >> np.uint64(32)
    return np.unique(total.view(np.int64))


def prefix_length(n: int, percent: int) -> int:
    """Tokens in hash order of which two linked sets share as many as the smaller asks for (``_matches``)."""
    need = -(-percent * n // 100)
    return n - need + min(LEAST_MATCHES + n // TOKENS_PER_MATCH, need)


def _sets(df: DataFrame, key: str, text: str, size: int, percent: int, whole: bool) -> DataFrame:
    """key, digest (128 bits that stand for the set), n (its size), tokens (all, or a prefix in hash order)."""

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        known = WordHashes()
        for batch in batches:
            out: dict[str, list] = {"key": batch["key"], "digest": [], "n": [], "tokens": []}
            for value in batch["text"]:
                if len(known) > REMEMBERED_WORDS:
                    known.clear()
                tokens = shingle_set(value, known, size)
                n = len(tokens)
                out["digest"].append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if n else None)
                out["n"].append(n)
                out["tokens"].append(tokens if whole else tokens[: prefix_length(n, percent)])
            yield out

    schema = f"key {df.schema[key].dataType.simpleString()}, digest binary, n long, tokens array<long>"
    return map_rows(texts_of(df, key, text), schema, task)


def _spread_join(rows: DataFrame, table: DataFrame, on: str, spread_by: str) -> DataFrame:
    """``rows`` with the columns of ``table`` (unique in ``on``), joined by shuffle at every size, hot keys in pieces."""
    return lookup_join(rows, table, [on], 1, spread_by=[spread_by], broadcast_bytes=0)


def _need(n: Column, percent: int) -> Column:
    """Least overlap of a set of ``n`` with any partner."""
    return F.ceil(n * percent / 100)


def _matches(n: Column, percent: int) -> Column:
    """Shared tokens that a set asks for in the first index."""
    return F.least(F.lit(LEAST_MATCHES) + F.floor(n / TOKENS_PER_MATCH), _need(n, percent))


def _overlap(a: Column, b: Column, percent: int) -> Column:
    """Least overlap of two linked sets of these sizes."""
    return F.ceil((a + b) * percent / (100 + percent))


def _fits(small: Column, large: Column, percent: int) -> Column:
    """Sizes and reaches allow a link; ``small`` has not more tokens."""
    sizes = small["n"] >= _need(large["n"], percent)
    return sizes & (large["n"] <= small["reach"]) & (small["n"] <= large["reach"])


def _list_pairs(index: DataFrame, percent: int) -> DataFrame:
    """Pairs that share enough tokens of short posting lists: (a, b, c), each once with its shared tokens.

    ``index`` has a row per token and node with n, l (shared tokens asked for), h (its expensive tokens, which are not
    in the index) and reach (largest partner). Tokens with the same list become one row first, so that copies
    sharing hundreds of tokens are paired once.
    """
    member = F.struct("n", "node", "l", "h", "reach", "later")
    lists = index.groupBy("token").agg(F.sort_array(F.collect_list(member)).alias("m"))
    lists = lists.where(F.size("m") > 1).groupBy("m").agg(F.count("*").alias("k"))
    first = lists.select("k", "m", F.posexplode("m").alias("i", "x"))
    pairs = first.select("k", "x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y"))
    x, y = F.col("x"), F.col("y")
    pairs = pairs.where(_fits(x, y, percent) & ~(x["later"] & y["later"]))
    counted = pairs.groupBy("x", "y").agg(F.sum("k").alias("c"))
    unseen = F.greatest(_need(x["n"], percent) - x["l"], _need(y["n"], percent) - y["l"])
    enough = F.col("c") + F.least(x["h"], y["h"]) >= _overlap(x["n"], y["n"], percent) - unseen
    a, b = x["node"], y["node"]
    return counted.where(enough).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "c")


def _runs(postings: DataFrame, long_list: int) -> DataFrame:
    """Postings (token, node, n) dealt by token once. Tokens that one set holds vanish; a short list becomes m, its members
    by size, with k, how often a task saw it; the rows of longer lists are passed on as they are.

    Rows of hot tokens, which a bounded sketch finds, have long lists for certain and are not dealt at all.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 3  # the rows of the last token so far
        counts: dict[bytes, int] = {}
        long_token = None

        def lists() -> pa.RecordBatch:
            members = [np.frombuffer(raw, "<i8").reshape(2, -1) for raw in counts]
            ends = np.r_[0, np.cumsum([m.shape[1] for m in members])]
            flat = np.concatenate(members, 1) if members else np.zeros((2, 0), np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(flat[0]), pa.array(flat[1])], names=["n", "node"])
            m = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs).cast(arrow.field("m").type)
            empty = pa.nulls(len(members), pa.int64())
            found = [empty, empty, empty, m, pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(found, schema=arrow)

        def rows(token: np.ndarray, node: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            nothing = pa.nulls(len(token), arrow.field("m").type), pa.nulls(len(token), pa.int64())
            return pa.RecordBatch.from_arrays([*map(pa.array, (token, node, n)), *nothing], schema=arrow)

        def closed(token: np.ndarray, node: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            """What becomes of complete runs."""
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[starts, len(token)])
            long = np.repeat((sizes > long_list) | (token[starts] == long_token if long_token is not None else False), sizes)
            if long.any():
                yield rows(token[long], node[long], n[long])
            both = np.stack([n, node])
            for at, size in zip(starts.tolist(), sizes.tolist()):
                if 1 < size <= long_list and not long[at]:
                    raw = both[:, at : at + size].tobytes()
                    counts[raw] = counts.get(raw, 0) + 1
            if len(counts) > COUNTED_LISTS:
                yield lists()

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("token", "node", "n")]
            kept = [np.concatenate(both) for both in zip(kept, new)]
            cut = int(np.searchsorted(kept[0], kept[0][-1]))
            yield from closed(*[column[:cut] for column in kept])
            kept = [column[cut:] for column in kept]
            if len(kept[0]) > long_list or kept[0][0] == long_token:
                long_token = kept[0][0]
                yield rows(*kept)
                kept = [column[:0] for column in kept]
        yield from closed(*kept)
        yield lists()

    schema = StructType.fromDDL("token long, node long, n long, m array<struct<n: long, node: long>>, k long")
    arrow = to_arrow_schema(schema)
    hot = _hot_tokens(postings, 20 * long_list)
    dealt = (postings.where(~F.col("token").isin(hot)) if hot else postings).repartition("token")
    found = dealt.sortWithinPartitions("token", "n", "node").mapInArrow(task, schema)
    if hot:
        apart = postings.where(F.col("token").isin(hot))
        nothing = [F.lit(None).cast(schema[name].dataType).alias(name) for name in ("m", "k")]
        found = found.unionByName(apart.select("token", "node", "n", *nothing))
    return staged(found, "runs")


def _hot_tokens(rows: DataFrame, least: int) -> list[int]:
    """Tokens that a bounded sketch finds in more than ``least`` rows and a large share of all."""
    sketch = rows.agg(F.count("*").alias("rows"), F.expr(f"approx_top_k(token, {HOT_SHARE}, {TRACKED_TOKENS})").alias("top")).first()
    least = max(sketch["rows"] / HOT_SHARE, least)
    return [item["item"] for item in sketch["top"] or [] if item["count"] > least]


def _counted(rows: DataFrame, name: str, least: int = 20 * LONG_LIST) -> DataFrame:
    """Rows whose token other rows hold too, with the number of rows of their token; no list is made and nothing joined.

    Rows are dealt by token once and counted where they lie. Rows of hot tokens are not dealt: their counts, at most
    ``HOT_SHARE`` numbers, are summed map-side and go to the tasks. ``rows`` come from a written table and are read twice.
    """
    schema = StructType([*rows.schema.fields, StructField(name, LongType())])
    arrow = to_arrow_schema(schema)

    def with_counts(batch: pa.RecordBatch | pa.Table, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        shared = pa.array(counts > 1)
        for part in pa.table([*batch.columns, pa.array(counts)], schema=arrow).filter(shared).to_batches():
            yield part

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, size = [], None, 0  # the rows of the last token so far
        for batch in batches:
            if not batch.num_rows:
                continue
            token = batch.column("token").to_numpy(zero_copy_only=False)
            if token[0] == token[-1] == last:
                held, size = [*held, batch], size + batch.num_rows
                continue
            cut = int(np.searchsorted(token, token[-1]))
            table = pa.Table.from_batches([*held, batch.slice(0, cut)], batch.schema)
            token = table.column("token").to_numpy()
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[starts, len(token)])
            yield from with_counts(table, np.repeat(sizes, sizes))
            held, last, size = [batch.slice(cut)], batch.column("token")[-1].as_py(), batch.num_rows - cut
        if held:
            yield from with_counts(pa.Table.from_batches(held), np.full(size, size))

    hot = _hot_tokens(rows, least)
    dealt = (rows.where(~F.col("token").isin(hot)) if hot else rows).repartition("token")
    found = dealt.sortWithinPartitions("token").mapInArrow(runs, schema)
    if not hot:
        return found
    apart = rows.where(F.col("token").isin(hot))
    sums = sorted((row["token"], row["n"]) for row in apart.groupBy("token").agg(F.count("*").alias("n")).collect())
    tokens, numbers = np.array(sums, np.int64).reshape(-1, 2).T

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token = batch.column("token").to_numpy(zero_copy_only=False)
            yield from with_counts(batch, numbers[np.searchsorted(tokens, token)])

    return found.unionByName(apart.mapInArrow(known, schema))


def _early_pairs(lists: DataFrame, costly: DataFrame, percent: int) -> DataFrame:
    """Pairs that share enough tokens of short posting lists: (a, b, c), each once with its shared tokens.

    Equal lists become one row first, so that copies sharing hundreds of tokens are paired once. ``costly`` has the
    number of expensive tokens (h) of the sets that hold any; two sets with many of them are left to the later index.
    """
    first = lists.groupBy("m").agg(F.sum("k").alias("k")).select("k", "m", F.posexplode("m").alias("i", "x"))
    pairs = first.select("k", "x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y"))
    x, y = F.col("x"), F.col("y")
    pairs = pairs.where(x["n"] >= _need(y["n"], percent))
    counted = pairs.groupBy("x", "y").agg(F.sum("k").alias("c"))
    counted = counted.select(*[F.col(f"{v}.{name}").alias(f"{name}_{v}") for v in "xy" for name in ("n", "node")], "c")
    size = measured_bytes(costly)
    for v in "xy":
        own = costly.select(F.col("node").alias(f"node_{v}"), F.col("h").alias(f"h_{v}"), F.col("later").alias(f"later_{v}"))
        counted = lookup_join(counted, own, [f"node_{v}"], size)
    n_x, n_y = F.col("n_x"), F.col("n_y")
    unseen = F.greatest(*[_need(n, percent) - _matches(n, percent) for n in (n_x, n_y)])
    hidden = F.least(*[F.coalesce(f"h_{v}", F.lit(0)) for v in "xy"])
    enough = F.col("c") + hidden >= _overlap(n_x, n_y, percent) - unseen
    both_later = F.coalesce("later_x", F.lit(False)) & F.coalesce("later_y", F.lit(False))
    ordered = F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")
    return counted.where(enough & ~both_later).select(*ordered, "c")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a written table) with the sizes and the exact overlap of their sets; only these sets are moved.

    A set of many pairs, as the centre of a star is, has them spread over tasks.
    """
    nodes = staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "paired")
    sets = semi(sets, nodes, ["node"], nodes.count())
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    joined = _spread_join(_spread_join(pairs.select("a", "b"), left, "a", "b"), right, "b", "a")
    overlaps = joined.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("t_a", "t_b")).alias("overlap"))
    return staged(overlaps, "verified")


def _promising(pairs: DataFrame) -> DataFrame:
    """Of each node's pairs the one that shares most tokens, so that groups become components with few pairs tried."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "c"))
    best = both.groupBy("a").agg(F.max(F.struct("c", "b"))["b"].alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components."""
    size = measured_bytes(labels)
    for side in ("a", "b"):
        known = labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
        pairs = lookup_join(pairs, known, [side], size)
    own = [F.coalesce(f"label_{side}", side) for side in ("a", "b")]
    return pairs.where(own[0] != own[1]).select("a", "b")


def _linked(percent: int) -> Column:
    return 100 * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))


def connected(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node; the label is the smallest node of its component.

    Alternating large and small stars: each round every node sends its neighbours the smallest node it knows of. Minima
    are combined before the shuffle; rounds grow with the logarithm of the longest chain. Each round is a written table.
    """
    edges = staged(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    state, before = None, []
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lower.select("u", F.col("m").alias("v")))
        before.append(edges)
        edges = staged(small.distinct(), "edges")
        unstage(*before)
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state = mark


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return lookup_join(nodes, labels, ["node"], measured_bytes(labels)).withColumn("label", F.coalesce("label", "node"))


def _adaptive_index(sets: DataFrame, percent: int) -> DataFrame:
    """Prefixes by document frequency, lengthened where that saves candidates: token, node, n, l, u, reach, place, base.

    Tokens that no other set holds (u of them) come first and can match nothing, so a set overlaps a partner in at most
    n - u tokens: that bounds the partner's size (reach), and sets without possible partner leave here. Asking for l
    shared tokens needs a prefix l - 1 tokens longer. Its cost is the posting rows, plus the verification of at most
    rows / l candidates; the cheapest l is taken.
    """
    postings = sets.select("node", "n", F.explode("tokens").alias("token"))
    ranked = _counted(postings, "df").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("s"))
    ranked = ranked.withColumns(
        {
            "u": F.col("n") - F.size("s"),
            "reach": F.floor(F.size("s") * (100 + percent) / percent) - F.col("n"),
            "base": (F.size("s") - _need(F.col("n"), percent)).cast("int"),
        }
    ).where(F.col("reach") >= _need(F.col("n"), percent))

    def rows(start: Column, length: int | Column) -> Column:
        return F.aggregate(F.slice("s", start, length), F.lit(0).cast("long"), lambda t, x: t + x["df"] - 1)

    options, total, done = [], None, 0
    for l in MATCHES:
        added = rows(F.lit(1), F.col("base") + 1) if total is None else rows(F.col("base") + done + 1, F.lit(l - done))
        total, done = added if total is None else total + added, l
        cost = total.cast("double") * (1 + F.col("n") / (8.0 * l))
        options.append(F.struct(F.when(F.col("base") + l <= F.size("s"), cost).otherwise(F.lit(1e300)), F.lit(l).alias("l")))
    chosen = ranked.withColumn("l", F.least(*options)["l"])
    prefix = F.slice("s", F.lit(1), F.col("base") + F.col("l"))
    return chosen.select("node", "n", "l", "u", "reach", "base", F.posexplode(prefix).alias("place", "x")).select(
        F.col("x.token").alias("token"), "node", "n", "l", "u", "reach", "base", "place"
    )


def jaccard_components(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    long_list: int = LONG_LIST,
) -> DataFrame:
    """One row per row of ``df``: key, n_shingles and component_id, the smallest key reachable by links.

    Two texts link when 100 * overlap >= ``percent`` * union of their distinct shingles of ``size`` words. Texts
    without words link with nothing; equal sets are one node throughout, however many copies there are. Only key and
    text are read, whole; repeated rows share their component; an empty table gives an empty result.

    1. Every set posts a prefix in hash order, long enough that linked sets share l tokens of it. Postings are dealt by
       token once; there tokens held once vanish and short lists are counted, see ``_runs``. A set with fewer than l expensive tokens shares a cheap one with
       every partner, so only short posting lists are paired, and pairs kept that can share as many tokens as a link needs.
    2. The other sets, whose prefixes would cost too many candidates, are lengthened: their whole sets are ordered by
       frequency among themselves, and each asks for as many shared tokens as is cheapest, see ``_adaptive_index``.
    3. The most promising pair of each set is verified on the whole sets. Sets that still meet on an expensive token are
       compared with one centre of the token instead. By then most are in one component and need no further pair.
    4. Every pair across components is verified, except those that a bound rules out: their sizes, or what both share
       with the centre.
    Nothing is capped: each link joins its two components. Equal sets are told by 128 bits of a digest; tables are deleted
    after their last reader.
    """
    df = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    sets = _sets(df, "key", "text", size, percent, whole=False).withColumn("row", F.monotonically_increasing_id())
    sets = staged(sets, "prefixes")
    facts = staged(sets.drop("tokens"), "facts")
    least = F.min("row").alias("node"), F.min("key").alias("key"), F.count("*").alias("rows")
    first = staged(facts.where("n > 0").groupBy("digest").agg(*least), "nodes")
    repeated = first.where("rows > 1").select("digest", F.col("node").alias("kept"))
    copies = lookup_join(facts.where("n > 0"), repeated, ["digest"], measured_bytes(repeated))
    copies = staged(copies.where("row <> kept").select("row"), "copies")
    nodes = except_rows(sets.where("n > 0").select("row", "n", "tokens"), copies, ["row"], copies.count())
    runs = _runs(nodes.select(F.explode("tokens").alias("token"), F.col("row").alias("node"), "n"), long_list)
    unstage(sets, copies)
    costly = runs.where("m is null").groupBy("node").agg(F.count("*").alias("h"), F.first("n").alias("n"))
    # A pair without a cheap shared token shares l expensive ones; l is that of the smaller set, at least 3/4 of the other.
    later = F.col("h") >= _matches(_need(F.col("n"), percent), percent)
    costly = staged(costly.select("node", "h", later.alias("later")), "costly-nodes")
    early = staged(_early_pairs(runs.where("m is not null").select("m", "k"), costly, percent), "early-pairs")
    unstage(runs)

    later = costly.where("later").select("node")
    wanted = early.select(F.explode(F.array("a", "b")).alias("node")).unionByName(later).distinct()
    keys = staged(first.join(wanted, "node", "left_semi").select("node", "key", "digest"), "wanted-keys")
    n_keys = keys.count()
    whole = _sets(semi(df, keys.select("key").distinct(), ["key"], n_keys), "key", "text", size, percent, whole=True)
    names = keys.select("node", "digest")
    whole = whole.drop("key").join(F.broadcast(names) if n_keys <= BROADCAST_KEYS else names, "digest").drop("digest")
    whole = staged(whole, "whole-sets")
    if whole.count() > n_keys:  # copies were read under a key of their own or the same
        whole, doubled = staged(whole.dropDuplicates(["node"]), "whole-sets"), whole
        unstage(doubled)

    prefixes = staged(_adaptive_index(whole.join(later, "node", "left_semi"), percent), "adaptive-index")
    index = staged(_counted(prefixes, "list"), "adaptive-lists")
    unstage(prefixes)
    costly = index.where(F.col("list") > long_list)
    costly_tokens = costly.groupBy("node").agg(F.count("*").alias("h"))
    short = index.where(F.col("list") <= long_list).join(costly_tokens, "node", "left")
    short = short.withColumns({"h": F.coalesce("h", F.lit(0)), "later": F.lit(False)})
    pairs = staged(_list_pairs(short, percent).unionByName(early), "pairs")

    # What meets on an expensive token: the first l = 1 prefix must share one, so longer prefixes need not be compared.
    met = staged(costly.where(F.col("place") <= F.col("base")).drop("l", "list", "place", "base"), "met")
    centre = met.groupBy("token").agg(F.min(F.struct("u", "node"))["node"].alias("c"))
    stars = _spread_join(met, centre, "token", "node").where("node <> c").select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"))
    tried = staged(_promising(pairs).unionByName(stars).distinct(), "tried")
    verified = _verify(tried, whole)
    links = verified.where(_linked(percent)).select("a", "b")
    labels = connected(links)
    rest = _apart(pairs.select("a", "b"), labels).unionByName(_across(met, centre, verified, labels, percent)).distinct()
    rest = staged(rest.join(verified, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = _verify(rest, whole).where(_linked(percent)).select("a", "b")
        labels = connected(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))

    unstage(whole, index, met, pairs, tried, rest, early)
    own = staged(_labelled(first.select("node", "digest", "key"), labels), "labelled")
    smallest = own.groupBy("label").agg(F.min("key").alias("component_id"))
    component = lookup_join(own.select("digest", "label"), smallest, ["label"], measured_bytes(smallest))
    component = staged(component.select("digest", "component_id"), "components")
    return lookup_join(facts, component, ["digest"], measured_bytes(component)).select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "key").alias("component_id"),
    )


def _across(met: DataFrame, centre: DataFrame, verified: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs on one expensive token that are in different components and that no bound rules out.

    With o tokens shared with the centre and r others that any set holds, two sets overlap in at most the smaller o plus the
    smaller r. Copies of the centre with edits of their own have no r, and differ from each other by the edits of both.
    Sets meet at the centre, once each with all expensive tokens that brought them there, so a pair is made once.
    """
    rows = _spread_join(met, centre, "token", "node").where("node <> c").groupBy("node", "n", "u", "reach", "c")
    rows = _labelled(rows.agg(F.collect_list("token").alias("ts")), labels)
    parts = rows.groupBy("c", "label").agg(F.count("*").alias("size"))
    main = parts.groupBy("c").agg(F.max(F.struct("size", "label"))["label"].alias("main"))
    rows = rows.withColumns({"a": F.least("node", "c"), "b": F.greatest("node", "c")})
    rows = rows.join(verified.select("a", "b", F.col("overlap").alias("o")), ["a", "b"])
    rows = _spread_join(rows, main, "c", "node")
    rows = rows.withColumn("r", F.col("n") - F.col("o") - F.col("u"))
    rows = staged(rows, "around-centres")
    side = F.struct("n", "node", "reach", "label", "o", "r", "ts")
    # The pairs at one centre are compared in as many pieces as they need: rows outside its main component are dealt.
    outside = F.sum((F.col("label") != F.col("main")).cast("long"))
    pieces = rows.groupBy("c").agg(F.ceil(outside * F.count("*") / CENTRE_PAIRS).alias("pieces"))
    rows = lookup_join(rows, pieces, ["c"], measured_bytes(pieces), spread_by=["node"])
    piece = F.pmod(F.xxhash64("node"), F.greatest("pieces", F.lit(1)))
    left = rows.where("label <> main").select("c", piece.alias("piece"), side.alias("x"))
    right = rows.where("pieces > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    right = right.select("c", "piece", side.alias("y"), (F.col("label") == F.col("main")).alias("in_main"))
    x, y = F.col("x"), F.col("y")
    enough = F.least(x["o"], y["o"]) + F.least(x["r"], y["r"]) >= _overlap(x["n"], y["n"], percent)
    sizes = F.when(x["n"] <= y["n"], _fits(x, y, percent)).otherwise(_fits(y, x, percent))
    once = F.col("in_main") | (x["node"] < y["node"])
    allowed = (x["label"] != y["label"]) & once & enough & sizes & F.arrays_overlap(x["ts"], y["ts"])
    pairs = left.join(right, ["c", "piece"]).where(allowed)
    return pairs.select(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b")).distinct()


by_value(__name__)
