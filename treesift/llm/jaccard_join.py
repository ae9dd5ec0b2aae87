"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when the sets of their distinct five-word shingles have a
Jaccard similarity of 0.8 or more.  The steps:

1. Shingles are hashed, and blocks of documents deal them out by hash range in
   packed, sorted rows, so every shingle's document frequency is counted over all
   documents.  A shingle that several documents of a block have is counted in the
   block first and dealt out once, so the hottest one is one entry of each block.
2. Each document learns which of its shingles occur elsewhere.  With the order
   "rarest first", a document of n shingles must share one of its first
   ``n - ceil(0.8 n) + 1`` shingles with any partner; if so many of its
   shingles occur nowhere else, it has no partner and is done.
3. For the others, the prefix is lengthened by ``ell - 1`` shingles where the
   frequencies say that this is cheaper: a pair of short lists is then verified
   only if it shares at least the smaller ``ell`` of the two in its prefixes.
   Pivots, and pairs of long lists in the last turn, are verified on one.
4. Documents with equal sets become one class, known by the number of one of its
   rows; sets are equal if two independent 64-bit sums and the sizes are.  Within the list of a prefix
   shingle, classes are compared with a pivot first; what the pivot links needs
   no further comparison, as only components are asked for.  Pairs that are
   left are formed only across components, long lists in several shares, and
   every one of them is verified.
5. Verified links are joined into components.

Defined results: null or blank text: no shingles, linked with nothing.  Rows
that repeat a doc_id are documents of their own that share its number.  A null
doc_id gives a null doc_id; its component is the least id of the rest of its
group, null if there is none.  No rows: no rows.  Other columns of the input
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import bound_batches, ids_and_texts, kept
from treesift.llm.components import components
from treesift.llm.hashed_words import mix, shingle_sets

#: Bits of a shingle's hash.  Two different shingles of a pair meet by chance
#: with a probability of their numbers' product over 2 ** BITS; sizes of sets are of 64.
BITS = 60
#: Shingles that one block range holds and that one map-side block gathers.
RANGE_SHINGLES = 2_000_000
BLOCK_SHINGLES = 1_500_000
#: Documents that one block holds at most, so that a row's number in it takes 20 bits.
BLOCK_ROWS = 500_000
#: Lists up to this length give all pairs across components at once.
SHORT_LIST = 24
#: Lists over this length are dealt out in shares of it before pairs are formed.
SHARE_LIST = 2_000
#: Rounds in which long lists are compared with one pivot before all pairs
#: across components are formed.
PIVOT_ROUNDS = 4
MOST_MATCHES = 8
#: Parts of the token space in which each set's tokens are counted, to bound overlaps.
PARTS = 32
#: Values that are packed without compression.
FEW = 32
_PLAIN = {size: bytes([128 + size]) for size in (4, 8)}
NO_ID = np.iinfo(np.int64).max

_ROW = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("tokens", pa.binary()), ("owners", pa.binary()), ("often", pa.binary()), ("runs", pa.binary()), ("home", pa.binary())])
_ROW_DDL = "range int, block long, tokens binary, owners binary, often binary, runs binary, home binary"


def pack(values: np.ndarray) -> bytes:
    """Values as byte planes, compressed, as small or sorted ones shrink most; few as they are."""
    size = values.dtype.itemsize
    if len(values) <= FEW:
        return _PLAIN[size] + values.tobytes()
    return bytes([size]) + zstandard.compress(values.view(np.uint8).reshape(-1, size).T.tobytes(), 1)


def unpack(data: bytes, dtype) -> np.ndarray:
    if data[0] > 128:
        return np.frombuffer(data, dtype, offset=1)
    planes = np.frombuffer(zstandard.decompress(data[1:], max_output_size=1 << 31), np.uint8)
    return np.ascontiguousarray(planes.reshape(data[0], -1).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    if len(values) <= FEW:
        return pack(values)
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    values = unpack(data, np.uint64)
    return values if data[0] > 128 else np.cumsum(values, dtype=np.uint64)


def _packed_home(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers in one value."""
    parts = [pack(np.asarray(a).astype(np.uint64)) for a in arrays]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _unpacked_home(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(unpack(data[at + 8 : at + 8 + n], np.uint64))
        at += 8 + n
    return out


def block_rows(sets: np.ndarray, n: np.ndarray, ids: np.ndarray, sizes: np.ndarray, block: int, n_ranges: int, bits: int) -> pa.RecordBatch:
    """One block of documents as rows for the ranges that it has shingles in: those of
    one document with their owners, and those of several with their numbers only.
    The block's home row keeps what is needed to put the answers together: ids, sizes
    and the owners of shingles of several documents.  ``n``: shingles of each document."""
    owners = np.repeat(np.arange(len(n), dtype=np.uint32), n)
    order = np.argsort(sets, kind="stable")
    tokens, owners = sets[order], owners[order]
    first = np.ones(len(tokens), bool)
    first[1:] = tokens[1:] != tokens[:-1]
    starts = np.flatnonzero(first)
    runs = np.diff(np.append(starts, len(tokens)))
    several = runs > 1
    once, often, often_runs = starts[~several], tokens[starts[several]], runs[several].astype(np.uint32)
    in_often = np.repeat(several, runs)
    tokens_once, owners_once = tokens[once], owners[once]
    range_of = lambda t: np.minimum((t.astype(np.float64) * (n_ranges / 2.0**bits)).astype(np.int64), n_ranges - 1)
    of_once, of_often = range_of(tokens_once), range_of(often)
    home = block % n_ranges
    used = np.union1d(np.union1d(of_once, of_often), [home])
    a, b = np.searchsorted(of_once, used, "left"), np.searchsorted(of_once, used, "right")
    c, d = np.searchsorted(of_often, used, "left"), np.searchsorted(of_often, used, "right")
    rows: dict[str, list] = {k: [] for k in _ROW.names}
    for r, i, j, k, m in zip(used.tolist(), a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True):
        own = _packed_home(ids.view(np.uint64), n, sizes, owners[in_often], often_runs) if r == home else None
        values = (r, block, pack_sorted(tokens_once[i:j]), pack(owners_once[i:j]), pack_sorted(often[k:m]), pack(often_runs[k:m]), own)
        for name, v in zip(_ROW.names, values, strict=True):
            rows[name].append(v)
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _ROW], schema=_ROW)


def _blocks(n_ranges: int, width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_held = n_rows = number = 0

        def flush() -> pa.RecordBatch:
            block = (TaskContext.get().partitionId() << 24) + number
            return block_rows(*(np.concatenate(x) for x in zip(*held, strict=True)), block, n_ranges, bits)

        for batch in batches:
            sets, at = shingle_sets(batch.column("text"), width)
            sizes = np.diff(at)
            cut = sets >> np.uint64(64 - bits)
            same = np.zeros(len(cut), bool)  # shingles of one document that only the bits cut off tell apart
            same[1:] = cut[1:] == cut[:-1]
            same[at[:-1][at[:-1] < len(cut)]] = False
            n = sizes - np.bincount(np.repeat(np.arange(len(sizes)), sizes)[same], minlength=len(sizes))
            held.append((cut[~same], n, batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False), sizes))
            n_held, n_rows = n_held + len(cut), n_rows + len(sizes)
            if n_held >= BLOCK_SHINGLES or n_rows >= BLOCK_ROWS:
                yield flush()
                held, n_held, n_rows, number = [], 0, 0, number + 1
        if held:
            yield flush()

    return run


def _count_range(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one hash range: for each block, what occurs in more than one document, and how often."""
    tokens = [unpack_sorted(x) for x in rows["tokens"]]
    often = [unpack_sorted(x) for x in rows["often"]]
    weights = [unpack(x, np.uint32) for x in rows["runs"]]
    lengths = [len(x) for x in tokens + often]
    every = np.concatenate(tokens + often)
    weight = np.concatenate([np.ones(sum(map(len, tokens)), np.uint32), *weights])
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(weight[order], starts) if len(starts) else weight
    counts = np.empty(len(ranked), np.uint32)
    counts[order] = np.repeat(sums, np.diff(np.append(starts, len(ranked))))
    parts = np.split(counts, np.cumsum(lengths)[:-1])
    out = []
    for own, more_own, c, d, row in zip(tokens, often, parts[: len(rows)], parts[len(rows) :], rows.itertuples(index=False), strict=True):
        more = c > 1
        if more.any() or len(more_own) or row.home is not None:
            out.append((row.range, row.block, pack_sorted(own[more]), pack(unpack(row.owners, np.uint32)[more]), pack(c[more]), row.often if len(more_own) else None, pack(d), row.home))
    return pd.DataFrame(out, columns=["range", "block", "tokens", "owners", "counts", "often", "sums", "home"])


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _choose_matches(costs: np.ndarray, base: int, unseen: int, n: int) -> int:
    """How many shared prefix tokens to ask for: the number at which scanning the
    lists of the prefix and verifying what they are likely to yield cost least."""
    best, best_cost = 1, np.inf
    total = np.cumsum(costs, dtype=np.float64)
    for ell in range(1, MOST_MATCHES + 1):
        length = base + ell - 1
        if length > n:
            break
        listed = total[min(len(total), length - unseen) - 1] if length > unseen else 0.0
        cost = listed + 8.0 * listed / ell
        if cost < best_cost:
            best, best_cost = ell, cost
    return best


def _gather_block(percent: int):
    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("range")
        ids, held, sizes, owners_often, runs = _unpacked_home(rows["home"].dropna().iloc[0])
        ids, sizes = ids.view(np.int64), sizes.astype(np.int64)
        with_often = rows[rows["often"].notna()]
        often = np.concatenate([np.zeros(0, np.uint64), *(unpack_sorted(x) for x in with_often["often"])])
        sums = np.concatenate([np.zeros(0, np.uint32), *(unpack(x, np.uint32) for x in with_often["sums"])])
        runs = runs.astype(np.int64)
        tokens = np.concatenate([*(unpack_sorted(x) for x in rows["tokens"]), np.repeat(often, runs)])
        owners = np.concatenate([*(unpack(x, np.uint32) for x in rows["owners"]), owners_often.astype(np.uint32)])
        counts = np.concatenate([*(unpack(x, np.uint32) for x in rows["counts"]), np.repeat(sums, runs)])
        seen = np.bincount(owners, minlength=len(ids))
        order = np.lexsort((tokens, counts, owners))
        tokens, counts = tokens[order].astype(np.int64), counts[order]
        ends = np.cumsum(seen)
        number = int(rows["block"].iloc[0]) << 20
        out = []
        for i, (doc, n, n_held) in enumerate(zip(ids.tolist(), sizes.tolist(), held.astype(np.int64).tolist(), strict=True)):
            base, unseen = n - least_overlap(n, percent) + 1, n_held - int(seen[i])
            if not n or unseen >= base:
                out.append((number + i, doc, n, None, None, None, None, None))
                continue
            own, c = tokens[ends[i] - seen[i] : ends[i]], counts[ends[i] - seen[i] : ends[i]]
            ell = _choose_matches(c, base, unseen, n)
            sums_ = [int(mix(own.view(np.uint64) + np.uint64(salt)).sum(dtype=np.uint64)) for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
            # one with shingles that no other document has equals none
            mark = b"".join(x.to_bytes(8, "little") for x in (*sums_, n, number + i + 1 if unseen else 0))
            out.append((number + i, doc, n, mark, ell, own[: base + ell - 1 - unseen], own, np.bincount(own % PARTS, minlength=PARTS)))
        return pd.DataFrame(out, columns=["row", "doc_id", "n", "mark", "ell", "prefix", "tokens", "parts"])

    return gather


def linked_sets(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(row, doc_id, n, mark, ell, prefix, tokens, parts) for every row: ``row`` is a
    number of its own, and the last five are null where frequencies alone show that the
    document has no partner; documents of equal sets have equal marks.  To be written
    once and read again, as a row's number is that of its place in the input."""
    spark = docs.sparkSession
    texts = ids_and_texts(docs)
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = int(max(96, n_bytes / 6 / RANGE_SHINGLES))
    bound_batches(spark)
    blocks = texts.mapInArrow(_blocks(n_ranges, width, BITS), _ROW_DDL)
    counted = blocks.groupBy("range").applyInPandas(_count_range, "range int, block long, tokens binary, owners binary, counts binary, often binary, sums binary, home binary")
    return counted.groupBy("block").applyInPandas(_gather_block(percent), "row long, doc_id long, n long, mark binary, ell int, prefix array<long>, tokens array<long>, parts array<int>")


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link.  Ends with many pairs are dealt out over as
    many copies as their pairs fill tasks."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / 500).cast("int").alias("shares"))
    left = (
        nodes.join(shares, nodes["node"] == shares["a"])
        .select("a", F.col("n").alias("n_a"), F.col("tokens").alias("t_a"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "shares")
    )
    dealt = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    both = F.size(F.array_intersect("t_a", "t_b"))
    return (
        dealt.join(right, "b")
        .join(left.drop("shares"), ["a", "share"])
        .where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both))
        .select("a", "b")
    )


def _may_link(percent: int, one: str, two: str):
    """Whether two sets that share a token can be similar enough: before it in
    rarity order they share at most the lesser number of tokens that stand
    there and occur elsewhere, and so behind it."""
    a, b = (lambda c: F.col(f"{c}{one}")), (lambda c: F.col(f"{c}{two}"))
    most = F.least(a("at"), b("at")) + F.least(a("seen") - a("at"), b("seen") - b("at"))
    return 100 * most >= percent * (a("n") + b("n") - most)


def _may_link_by_parts(percent: int, one: str, two: str):
    """A closer bound: in each part of the token space they share at most the
    lesser of their numbers of tokens there that occur elsewhere."""
    a, b = (lambda c: F.col(f"{c}{one}")), (lambda c: F.col(f"{c}{two}"))
    most = F.aggregate(F.zip_with(a("parts"), b("parts"), lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    return 100 * most >= percent * (a("n") + b("n") - most)


def _cross_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs across components within each token's list: whoever is not in the
    list's largest component meets all of the list."""
    sizes = rows.groupBy("token", "root").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("size", "root")).alias("top")).select("token", F.col("top.root").alias("top"))
    share = F.ceil(F.col("size") / SHARE_LIST).cast("int")
    few = rows.join(largest, "token").where("root <> top").drop("top").withColumn("share", F.explode(F.sequence(F.lit(0), share - 1)))
    other = rows.select("token", F.pmod(F.xxhash64("node"), share).cast("int").alias("share"), *[F.col(c).alias(f"{c}_2") for c in ("node", "n", "seen", "at", "parts", "ell", "root", "long")])
    met = few.join(other, ["token", "share"]).where((F.col("root") != F.col("root_2")) & _may_link(percent, "", "_2") & _may_link_by_parts(percent, "", "_2"))
    return (
        met.select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b"), "token", F.least("ell", "ell_2").alias("ell"), F.least("long", "long_2").alias("long"))
        .distinct()
        .groupBy("a", "b", "ell", "long")
        .agg(F.count("*").alias("shared"))
    )


def node_components(nodes: DataFrame, percent: int = 80) -> DataFrame:
    """(node, root) for the nodes of ``nodes`` (node, n, ell, prefix, tokens, parts) that link with another."""
    spark = nodes.sparkSession
    listed = nodes.select("node", "n", F.size("tokens").alias("seen"), "parts", "ell", F.posexplode("prefix").alias("at", "token"))
    lists = listed.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    rows = listed.join(lists, "token")
    marks = rows.where(F.col("size") > SHORT_LIST).groupBy("node").agg(F.count("*").alias("long"))
    rows = kept(rows.join(marks, "node", "left").fillna(0, ["long"]), "prefixes")  # long: how many of its prefix's lists are
    roots, links = None, None
    for turn in range(PIVOT_ROUNDS + 1):
        live = rows.withColumn("root", F.col("node")) if roots is None else rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # first the set with the smallest share of shingles of its own, then others
        order = (F.lit(1) - F.col("seen") / F.col("n")) if turn == 0 else F.lit(0.0)
        pivot = F.min(F.struct(order, F.xxhash64("node", F.lit(turn)), "node", "root", "n", "seen", "at"))
        mixed = live.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), pivot.alias("pivot")).where("low <> high")
        live = kept(live.join(mixed.select("token", "pivot"), "token"), "live")
        if not live.take(1):
            break
        pivots = live.withColumns({f"{c}_2": F.col(f"pivot.{c}") for c in ("n", "seen", "at")}).where(_may_link(percent, "", "_2") & (F.col("root") != F.col("pivot.root"))).select(F.col("pivot.node").alias("a"), F.col("node").alias("b"), "size")
        if turn == 0:  # every list, to let components grow before any pairs are formed
            candidates = pivots.select("a", "b").distinct()
        elif turn < PIVOT_ROUNDS:
            short = _cross_pairs(live.where(F.col("size") <= SHORT_LIST), percent)
            enough = short.where(F.col("shared") + F.col("long") >= F.col("ell"))  # with what long lists may add
            candidates = enough.select("a", "b").union(pivots.where(F.col("size") > SHORT_LIST).select("a", "b")).distinct()
            rows = rows.where(F.col("size") > SHORT_LIST)
        else:
            candidates = _cross_pairs(live, percent).select("a", "b")
        found = kept(_verified(kept(candidates, "candidates"), nodes, percent), "links")
        links = found if links is None else links.union(found)
        roots = components(links).withColumnRenamed("id", "node")
    return roots if roots is not None else spark.createDataFrame([], "node long, root long")


def _classes_and_roots(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(mark, node, least) of all classes of equal sets, and (node, root) of those that
    link; a class is known by the least row number in it."""
    some = sets.where("mark is not null")
    classes = kept(some.groupBy("mark").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "classes")
    nodes = kept(some.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "n", "ell", "prefix", "tokens", "parts"), "nodes")
    return classes, kept(node_components(nodes, percent), "roots")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    sets = kept(linked_sets(docs, width, percent), "sets")
    classes, roots = _classes_and_roots(sets, percent)
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    of_mark = named.join(least, "root").select("mark", "component")
    out = sets.select("doc_id", "n", "mark").join(of_mark, "mark", "left")
    no_id = F.lit(int(NO_ID))
    return out.select(
        F.nullif("doc_id", no_id).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.nullif(F.coalesce("component", "doc_id"), no_id).alias("component_id"),
    )


def _keyed(held: DataFrame, own: Column, text: Column, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """``held`` with a ``key`` of 64 bits for each (own, text), and (key, own, n) of the keys.

    Different rows may meet in one hash (of n rows about n^2 / 2^65 pairs do).  A second hash
    shows them, and as long as there are any, the rows of these few keys get other keys."""
    salt = 0
    held = held.withColumns({"key": F.shiftrightunsigned(F.xxhash64(own, text), 64 - bits) if bits < 64 else F.xxhash64(own, text), "twin": F.xxhash64(F.lit(1), own, text)})
    while True:
        keys = kept(held.groupBy("key").agg(F.min(own).alias("own"), F.count("*").alias("n"), F.min("twin").alias("low"), F.max("twin").alias("high")), "keys")
        met = keys.where("low <> high").select("key", F.lit(True).alias("met"))
        if met.isEmpty():
            return held.drop("twin"), keys.select("key", "own", "n")
        salt += 2
        held = held.join(met, "key", "left").withColumn("key", F.when(F.col("met"), F.xxhash64(F.lit(salt), "twin", "key")).otherwise(F.col("key"))).drop("met")


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, that come first in their
    component: exactly one of each, by doc_id, nulls last, and of rows that repeat
    it the one with the least key.  Rows that differ in neither doc_id nor text are
    copies, of which any one stays; a row that links with none stays, whatever its
    doc_id.  Column names of the input may repeat."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own, text = F.col(names[docs.columns.index("doc_id")]).cast("long"), F.col(names[docs.columns.index("text")])
    held, keys = _keyed(docs.toDF(*names), own, text)
    sets = kept(linked_sets(held.select(F.col("key").alias("doc_id"), text.alias("text")), width, percent), "sets")
    classes, roots = _classes_and_roots(sets, percent)
    named = classes.join(roots, "node", "left").select("mark", F.coalesce("root", "node").alias("root"))
    members = sets.where("mark is not null").select(F.col("doc_id").alias("key"), "mark").distinct().join(named, "mark").join(keys, "key")
    winners = members.groupBy("root").agg(F.min(F.struct(F.col("own").isNull(), "own", "key", "n")).alias("first")).select("first.key", "first.n")
    alone = sets.where("mark is null").select(F.col("doc_id").alias("key")).distinct()
    once = kept(winners.where("n = 1").select("key").union(alone), "once")
    again = kept(winners.where("n > 1").select("key"), "again")
    out = held.join(once, "key", "left_semi").select(names)
    if not again.isEmpty():  # copies are brought down to one each before they meet
        out = out.unionByName(held.join(again, "key", "left_semi").groupBy("key").agg(F.first(F.struct(*names)).alias("row")).select("row.*"))
    return out.toDF(*docs.columns)
