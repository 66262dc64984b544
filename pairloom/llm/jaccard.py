"""Set-similarity join of word shingles with set-relation skipping, and its connected components.

A document's set holds the hashes of its distinct n-word shingles (the whole sequence as one if it has
fewer words; empty without words or for null). Two documents link when
``100 * |A & B| >= percent * |A | B|``; empty sets link with nothing. Steps:

1. Equal sets become one node: a copy takes over its node's answers and is never compared.
2. Shingles get one global order, rare before frequent, estimated from the counts of its words and the
   excess of its own cell over the mean cell (counts of all shingles and words in tables of 2^18 cells; only the
   speed depends on this order). Linked sets share a shingle among the first
   ``n - ceil(n * percent / 100) + 1`` of each (prefix filter). Those prefixes are the index.
3. Index lists part where no sizes are near enough to link, and are skipped by position: a list's pivot is the
   set in which the shingle stands first, that is the one with the fewest rarer shingles. Every other member is
   compared with the pivot only, exactly (two sets alone in their lists only if their sizes and places allow
   a link). Before any text moves, members whose parity sketch (a bit an element, 1,024 at least) rules out a link with the pivot and with every
   other member are dropped, exactly. The comparison yields the member's difference from the pivot.
4. Answers of similar sets are derived from these differences: for members x, y of one pivot,
   |x ^ y| = |dx| + |dy| - 2 |dx & dy|. Members that link with the pivot are connected by it already; only
   pairs with an unlinked member are worked out, in blocks of at most ``BLOCK`` members against blocks, and
   only the edges that join something are returned. Two linked sets share some list, hence its pivot, so
   no link between components is lost.
5. Components by alternating large-star and small-star steps over the edges, checkpointed in the shared folder.

Each list, pivot and block is spread over tasks: lists are joined, not collected, and members of a pivot are
salted. Rows with equal ids are rows of their own; the component id is the smallest non-null id in the
component (null if all are null). An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.store import apart, likely_among, released, save, small_batches
from pairloom.llm.words import Words, mix, sequence_hash, text_runs

CELL_BITS = 18
BLOCK = 256
SALT_ROWS = 128
SKETCH_BITS = 10  # a set's parity sketch has 2^10 bits at least
SKETCH_BLOCK = 2048

SIGNED = np.int64


def row_sets(column: pa.Array, n: int, counts: np.ndarray | None = None) -> Iterator:
    """The sorted distinct shingle hashes of each row; with ``counts`` also their place in the global order."""
    for _, raw, offsets in text_runs(column):
        words = Words(raw, offsets)
        shingles = words.shingles(n)
        if counts is not None:
            weight = np.log2(np.maximum((1.0 + counts[1][cells(words.hash)]) / (1.0 + counts[1].mean()), 1.0))
            rarity = np.zeros(len(shingles))
            for j in range(min(n, len(shingles))):
                rarity[: len(rarity) - j] += weight[j:]
            usual = counts[0].mean()
            excess = np.maximum(counts[0][cells(shingles)] - usual, 0) / math.sqrt(usual + 1)
            place = np.round((rarity + 2 * excess) * 8).astype(np.int64)
        for a, b in zip(words.bounds[:-1], words.bounds[1:]):
            if b - a >= n:
                if counts is None:
                    yield np.unique(shingles[a : b - n + 1])
                else:
                    found, at = np.unique(shingles[a : b - n + 1], return_index=True)
                    yield found, place[a + at]
            else:
                found = sequence_hash(words.hash[a:b]) if b > a else np.zeros(0, np.uint64)
                yield found if counts is None else (found, np.zeros(len(found), np.int64))


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def parity_sketch(hashes: np.ndarray) -> list[int]:
    """One bit per cell: whether an odd number of the set's hashes fall into it, as 64-bit words.

    Two sets' sketches differ in at most as many bits as the sets do in elements: each of those changes one bit. There are
    at least as many cells as elements, else the sketches of large sets would look alike. The count is a power of two and
    the cell the hash's low bits, so a sketch becomes a shorter one where its halves are joined by exclusive or.
    """
    cells_ = 1 << max(SKETCH_BITS, int(len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(cells_ - 1)).astype(np.int64), minlength=cells_) & 1
    return np.packbits(odd.astype(np.uint8)).view(SIGNED).tolist()


def differing_bits(a: Column, b: Column) -> Column:
    """In how many bits two sketches differ; the longer one is folded to the other's length."""
    least = F.least(F.size(a), F.size(b))

    def folded(x):
        word = lambda i: F.aggregate(
            F.sequence(F.lit(0), (F.size(x) / least).cast("int") - 1), F.lit(0).cast("bigint"), lambda s, j: s.bitwiseXOR(F.get(x, i + j * least))
        )
        return F.when(F.size(x) == least, x).otherwise(F.transform(F.sequence(F.lit(0), least - 1), word))

    return F.aggregate(F.zip_with(folded(a), folded(b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)


def sketches_meet(bits_a: np.ndarray, n_a: np.ndarray, names_a: np.ndarray, bits_b: np.ndarray, n_b: np.ndarray, names_b: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets a their sketches (one length each) do not rule out as linked with another one of the sets b."""
    words = min(bits_a.shape[1], bits_b.shape[1])
    bits_a, bits_b = (np.bitwise_xor.reduce(x.reshape(len(x), -1, words), axis=1) for x in (bits_a, bits_b))
    found, some = np.zeros(len(n_a), bool), max(1, 512 // words)
    for at in range(0, len(n_a), some):
        n, part = n_a[at : at + some, None], bits_a[at : at + some, None, :]
        differ = np.bitwise_count(part ^ bits_b[None]).sum(axis=2, dtype=np.int64)
        fits = (differ * (100 + percent) <= (n + n_b) * (100 - percent)) & (np.minimum(n, n_b) * 100 >= np.maximum(n, n_b) * percent)
        found[at : at + some] = (fits & (names_a[at : at + some, None] != names_b)).any(axis=1)
    return found


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(2 << CELL_BITS, np.int64)
    for batch in batches:
        for part in batch.column(0):
            total += np.frombuffer(part.as_buffer(), np.int64)
    yield pa.record_batch({"cells": pa.array([total.tobytes()], pa.binary())})


def cell_counts(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """How many shingles and how many words of all documents fall into each of 2^18 hash cells (4 MB, whatever the input)."""

    def count(batches):
        total = np.zeros((2, 1 << CELL_BITS), np.int64)
        for batch in batches:
            for _, raw, offsets in text_runs(batch.column(0)):
                words = Words(raw, offsets)
                last = np.repeat(words.bounds[1:], np.diff(words.bounds)) - n
                hashes = words.shingles(n)[np.arange(len(words.hash)) <= last]
                total[0] += np.bincount(cells(hashes), minlength=1 << CELL_BITS)
                total[1] += np.bincount(cells(words.hash), minlength=1 << CELL_BITS)
        yield pa.record_batch({"cells": pa.array([total.tobytes()], pa.binary())})

    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = docs.select(text).mapInArrow(released(count), "cells binary").repartition(width).mapInArrow(released(_add_counts), "cells binary")
    rows = parts.repartition(1).mapInArrow(released(_add_counts), "cells binary").collect()
    return (np.frombuffer(bytes(rows[0][0]), np.int64) if rows else np.zeros(2 << CELL_BITS, np.int64)).reshape(2, -1)


def signatures(docs: DataFrame, id_col: str, text: str, n: int, percent: int) -> DataFrame:
    """Per document: id, text hash, set size, a 128-bit set key and the prefix in global order."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(cell_counts(docs, text, n))

    def sign(batches):
        for batch in batches:
            sizes, keys_a, keys_b, prefixes, sketches = [], [], [], [], []
            for s, place in row_sets(batch.column(2), n, counts.value):
                sizes.append(len(s))
                keys_a.append(int(mix(s).sum(dtype=np.uint64).astype(SIGNED)))
                sketches.append(parity_sketch(s))
                keys_b.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(SIGNED)))
                keep = len(s) - -(-len(s) * percent // 100) + 1 if len(s) else 0
                rank = np.lexsort((s, place))
                prefixes.append(s[rank[:keep]].view(SIGNED))
            ends = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, SIGNED)
            yield pa.record_batch(
                {
                    "id": batch.column(0),
                    "th": batch.column(1),
                    "n": pa.array(sizes, pa.int64()),
                    "ka": pa.array(keys_a, pa.int64()),
                    "kb": pa.array(keys_b, pa.int64()),
                    "prefix": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    "sketch": pa.array(sketches, pa.list_(pa.int64())),
                }
            )

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    return source.mapInArrow(released(sign), "id bigint, th bigint, n bigint, ka bigint, kb bigint, prefix array<bigint>, sketch array<bigint>")


def may_link(met: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The rows of ``met`` (pivot, node, alone) that their sketches do not rule out.

    Linked sets differ in at most (a + b) (100 - percent) / (100 + percent) elements, hence in as many bits at most. A
    member stays if it may link with its pivot or with another member of the pivot's lists; only sketches meet here, in
    blocks of ``SKETCH_BLOCK`` members, and where a pivot has more of them, only neighbouring set sizes. Exact: no
    link is lost.
    """
    facts = nodes.select("node", "n", "sketch")
    lead = facts.select(F.col("node").alias("pivot"), F.col("n").alias("n0"), F.col("sketch").alias("sketch0"))
    rows = met.join(facts, "node").join(lead, "pivot")
    sizes_fit = F.least("n", "n0") * 100 >= F.greatest("n", "n0") * percent
    near = sizes_fit & (differing_bits(F.col("sketch"), F.col("sketch0")) * (100 + percent) <= (F.col("n") + F.col("n0")) * (100 - percent))
    rows = save(rows.select("pivot", "node", "alone", "n", "sketch", near.alias("near")).filter("near OR NOT alone"), "near")
    several = rows.filter("NOT alone")
    sizes = several.groupBy("pivot").agg(F.count("*").alias("all"), F.count_if(~F.col("near")).alias("far")).filter("far > 0 AND all > 1")
    several = several.join(sizes.select("pivot", F.ceil(F.col("all") / SKETCH_BLOCK).cast("int").alias("blocks")), "pivot")
    step = F.floor(F.ln("n") / (math.log(100 / percent) * (1 + 1e-9) + 1e-12)).cast("int")
    several = several.withColumn("step", F.when(F.col("blocks") > 1, step).otherwise(0)).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    around = F.when(F.col("blocks") > 1, F.sequence(F.col("step") - 1, F.col("step") + 1)).otherwise(F.array(F.lit(0)))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    place = lambda s, b: F.struct(s.alias("step"), b.alias("block"))
    others = F.flatten(F.transform(around, lambda s: F.transform(every, lambda b: place(s, b))))
    own = place(F.col("step"), F.col("block"))
    left = several.filter("NOT near").select("pivot", own.alias("a"), F.explode(others).alias("b"), F.lit(True).alias("asks"), "node", "n", "sketch")
    right = several.select("pivot", F.explode(others).alias("a"), own.alias("b"), F.lit(False).alias("asks"), "node", "n", "sketch")

    def partners(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        nodes, n = group.column("node").to_numpy(), group.column("n").to_numpy()
        sketch = group.column("sketch").combine_chunks()
        flat, start = sketch.flatten().to_numpy().view(np.uint64), np.cumsum([0, *pc.list_value_length(sketch).to_pylist()])
        width = np.diff(start)
        theirs, ours = np.flatnonzero(~asks), np.flatnonzero(asks)
        found = np.zeros(len(n), bool)
        sets = lambda rows, w: (flat[start[rows][:, None] + np.arange(w)], n[rows], nodes[rows])
        for a in np.unique(width[ours]):
            one = ours[width[ours] == a]
            for b in np.unique(width[theirs]):
                found[one] |= sketches_meet(*sets(one, a), *sets(theirs[width[theirs] == b], b), percent)
        ours = ours[found[ours]]
        pivot = group.column("pivot").take(pa.array(ours))
        return pa.table({"pivot": pivot, "node": pa.array(nodes[ours])})

    kept = left.unionByName(right).groupBy("pivot", "a", "b").applyInArrow(partners, "pivot bigint, node bigint").distinct()
    far = kept.select("pivot", "node", F.lit(False).alias("alone"))
    return rows.filter("near").select("pivot", "node", "alone").union(far)


def compare_with_pivot(members: DataFrame, n: int, percent: int) -> DataFrame:
    """Differences of members from their pivot: what the member has beyond it, and a bit for each pivot shingle it lacks.

    ``members``: pivot, salt, lead (true for the pivot's own row, which is sorted first), node, alone (no third
    set in their lists, so no difference is kept), text. The rows are a sorted stream: a task holds one pivot set and one member.
    """

    def compare(batches):
        current, pivot_set = None, None
        for batch in batches:
            out = {k: [] for k in ("pivot", "node", "alone", "size", "linked", "extra", "lacks")}
            pivots, salts, leads, nodes, alone = (batch.column(i).to_pylist() for i in range(5))
            for i, s in enumerate(row_sets(batch.column(5), n)):
                if leads[i]:
                    current, pivot_set = (pivots[i], salts[i]), s
                    continue
                assert current == (pivots[i], salts[i])
                has = np.isin(pivot_set, s, assume_unique=True)
                both = int(has.sum())
                out["pivot"].append(pivots[i])
                out["node"].append(nodes[i])
                out["size"].append(len(s))
                out["alone"].append(alone[i])
                out["linked"].append(100 * both >= percent * (len(s) + len(pivot_set) - both))
                out["extra"].append(b"" if alone[i] else s[np.isin(s, pivot_set, assume_unique=True, invert=True)].tobytes())
                out["lacks"].append(b"" if alone[i] else np.packbits(~has).tobytes())
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.record_batch({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    schema = "pivot bigint, node bigint, alone boolean, size bigint, linked boolean, extra binary, lacks binary"
    ordered = members.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.desc("lead"))
    return ordered.select("pivot", "salt", "lead", "node", "alone", "t").mapInArrow(released(compare), schema)


def joining_edges(left: list, right: list | None, percent: int) -> list[tuple[int, int]]:
    """Edges between members (node, size, linked, extra, lacks) of one block, or of two, that connect anything new."""
    rows = left + (right or [])
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    anchor = next((i for i, r in enumerate(rows) if r[2]), None)
    for i, r in enumerate(rows):
        if r[2]:
            parent[i] = anchor
    extras = [np.frombuffer(r[3], np.uint64) for r in rows]
    lacks = np.stack([np.frombuffer(r[4], np.uint8) for r in rows])  # one pivot, so one width
    tokens = np.concatenate(extras)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in extras])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    sizes = np.array([r[1] for r in rows])
    deltas = np.array([len(x) for x in extras]) + np.bitwise_count(lacks).sum(axis=1, dtype=np.int64)
    edges = []
    for i in range(len(left)):
        if right is None and i == 0:
            continue
        lo, hi = np.searchsorted(tokens, extras[i]), np.searchsorted(tokens, extras[i], "right")
        width = hi - lo
        at = np.repeat(lo - np.cumsum(width) + width, width) + np.arange(width.sum())
        shared = np.bincount(owner[at], minlength=len(rows)) + np.bitwise_count(lacks & lacks[i]).sum(axis=1, dtype=np.int64)
        differ = deltas[i] + deltas - 2 * shared
        union = (sizes[i] + sizes + differ) // 2
        ok = 100 * (union - differ) >= percent * union
        others = range(len(left), len(rows)) if right is not None else range(i)
        for j in others:
            if ok[j] and root(i) != root(j):
                parent[root(i)] = root(j)
                edges.append((rows[i][0], rows[j][0]))
    return edges


def derived_edges(compared: DataFrame, percent: int) -> DataFrame:
    """Edges among members of one pivot, from their differences."""
    compared = compared.filter(~F.col("alone"))
    stats = compared.groupBy("pivot").agg(F.count("*").alias("all"), F.count_if(~F.col("linked")).alias("loose"))
    open_groups = stats.filter("loose > 0 AND all > 1")
    rows = compared.join(open_groups, "pivot").withColumn("kind", F.when(F.col("linked"), "L").otherwise("U"))
    blocks_of = F.when(F.col("linked"), F.ceil((F.col("all") - F.col("loose")) / BLOCK)).otherwise(F.ceil(F.col("loose") / BLOCK))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks_of).cast("int"))
    rows = rows.withColumn("loose_blocks", F.ceil(F.col("loose") / BLOCK).cast("int"))
    # A block of loose members i meets loose blocks j >= i and every linked block: the pair's key is (i, kind, j).
    others = F.sequence(F.lit(0), F.col("loose_blocks") - 1)
    pairs = F.when(
        F.col("linked"), F.transform(others, lambda i: F.struct(i.alias("i"), F.lit("L").alias("k"), F.col("block").alias("j")))
    ).otherwise(
        F.concat(
            F.transform(
                others,
                lambda i: F.struct(F.least(i, F.col("block")).alias("i"), F.lit("U").alias("k"), F.greatest(i, F.col("block")).alias("j")),
            ),
            F.transform(
                F.when(F.col("all") > F.col("loose"), F.sequence(F.lit(0), F.ceil((F.col("all") - F.col("loose")) / BLOCK).cast("int") - 1)).otherwise(
                    F.array().cast("array<int>")
                ),
                lambda j: F.struct(F.col("block").alias("i"), F.lit("L").alias("k"), j.alias("j")),
            ),
        )
    )
    spread = rows.select("pivot", F.explode(pairs).alias("pair"), "kind", "block", "node", "size", "linked", "extra", "lacks").select(
        "pivot", "pair.i", "pair.k", "pair.j", "kind", "block", "node", "size", "linked", "extra", "lacks"
    )

    def work(key, group):
        _, i, k, j = (x.as_py() for x in key)
        members = group.to_pylist()
        pick = lambda kind, block: [(m["node"], m["size"], m["linked"], m["extra"], m["lacks"]) for m in members if m["kind"] == kind and m["block"] == block]
        left = pick("U", i)
        right = None if (k, i) == ("U", j) else pick(k, j)
        edges = joining_edges(left, right, percent) if left and (right is None or right) else []
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return spread.groupBy("pivot", "i", "k", "j").applyInArrow(work, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component, for every node of an edge.

    Large-star and small-star steps in turn, each written to the shared folder, until an iteration
    changes nothing; the number of iterations grows with the logarithm of the component's size.
    """

    def links(e, up: bool):
        if up:  # large star: from every node's view, larger neighbours go to the smallest of the neighbourhood
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        other = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        return other.union(low.select("a", F.col("m").alias("b")))

    current = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    size = lambda e: e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint"))).first()
    state = size(current)
    while True:
        current = save(links(links(current, True).distinct(), False).distinct(), "edges")
        now = size(current)
        if now == state:
            break
        state = now
    roots = current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def labelled(docs: DataFrame, id_col: str, text: str, n: int, percent: int) -> DataFrame:
    """(id, th, n, component_id, root) per document; ``root`` numbers the components and is null for empty sets."""
    small_batches(docs.sparkSession)
    signed = save(signatures(docs, id_col, text, n, percent), "signatures")
    key = ["n", "ka", "kb"]
    found = signed.filter("n > 0").groupBy(*key).agg(F.min("id").alias("low"), F.min(F.struct("th", "id")).alias("some"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
    nodes = save(found.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")

    index = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = index.groupBy("token").count().filter("count > 1").select("token")
    # Linked sizes differ by less than one step of this scale, so lists part where a step is empty.
    step_of = lambda n: F.floor(F.ln(n) / (math.log(100 / percent) * (1 + 1e-9) + 1e-12))
    near = save(index.join(shared, "token").withColumn("step", step_of(F.col("n"))), "index")
    # The first common shingle of two linked sets stands this early in the smaller one; two late ones prove nothing.
    early = lambda pos, n: pos <= n - F.ceil(n * (2 * percent) / (100 + percent))
    steps = near.groupBy("token", "step").agg(
        F.count("*").alias("rows"), F.count_if(early(F.col("pos"), F.col("n"))).alias("soon"), F.min(F.struct("pos", "n", "node")).alias("first")
    )
    order = Window.partitionBy("token").orderBy("step")  # one row a step: a few hundred at most
    beside = lambda c, f: F.when(F.abs(f("step").over(order) - F.col("step")) == 1, f(c).over(order)).otherwise(0)
    around = lambda c: F.col(c) + beside(c, F.lag) + beside(c, F.lead)
    steps = steps.withColumns({
        "new": (F.col("step") - F.lag("step").over(order) > 1).cast("int"), "near_rows": around("rows"), "near_soon": around("soon"),
    })
    steps = steps.withColumn("part", F.sum(F.coalesce("new", F.lit(0))).over(order))
    lists = steps.groupBy("token", "part").agg(F.sum("rows").alias("size"), F.min("first").alias("first")).filter("size > 1")
    lists = steps.select("token", "step", "near_rows", "near_soon", "part").join(lists, ["token", "part"])
    pivot_soon = early(F.col("first.pos"), F.col("first.n"))
    pivot_near = F.abs(step_of(F.col("first.n")) - F.col("step")) <= 1
    # Sets of a list that may link with an early or a late member of this step, besides itself and the pivot.
    lists = lists.select(
        "token", "step", F.col("first.n").alias("n0"), F.col("first.node").alias("pivot"), pivot_soon.alias("pivot_soon"),
        (F.col("near_rows") - 1 - pivot_near.cast("int")).alias("of_early"), (F.col("near_soon") - (pivot_near & pivot_soon).cast("int")).alias("of_late"),
    )
    soon = early(F.col("pos"), F.col("n"))
    met = near.join(lists, ["token", "step"]).filter("node <> pivot").groupBy("pivot", "node")
    met = met.agg(
        F.max(F.when(soon, F.col("of_early")).otherwise(F.col("of_late"))).alias("others"),
        F.max(soon | F.col("pivot_soon")).alias("direct"), F.first("n").alias("n"), F.first("n0").alias("n0"),
    )
    # Without others, a member can link with the pivot only, and where that is ruled out as well, with nothing here.
    # The lists of one pivot do not bound the overlap: the two share further shingles in lists with other pivots.
    alone = F.col("others") == 0
    fits = F.col("direct") & (F.least("n", "n0") * 100 >= F.greatest("n", "n0") * percent)
    met = save(met.filter(~alone | fits).select("pivot", "node", alone.alias("alone")), "met")
    met = save(may_link(met, nodes, percent), "may-link")

    per_pivot = met.groupBy("pivot").agg(F.count("*").alias("all"))
    member_rows = met.join(per_pivot, "pivot")
    salts = F.ceil(F.col("all") / SALT_ROWS)
    member_rows = member_rows.select(
        "pivot", F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"), F.lit(False).alias("lead"), "node", "alone"
    )
    leads = member_rows.select("pivot", "salt").distinct()
    leads = leads.select("pivot", "salt", F.lit(True).alias("lead"), F.col("pivot").alias("node"), F.lit(False).alias("alone"))
    wanted = member_rows.union(leads).join(nodes.select("node", F.col("some.th").alias("th"), F.col("some.id").alias("id")), "node")
    wanted = save(wanted, "wanted")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    texts = texts.filter(likely_among(wanted, "th")("th"))
    placed = texts.alias("x").join(wanted.alias("y"), (F.col("x.th") == F.col("y.th")) & F.col("x.id").eqNullSafe(F.col("y.id")))
    members = placed.select("pivot", "salt", "lead", "node", "alone", "t")
    compared = save(compare_with_pivot(members, percent=percent, n=n), "compared")

    direct = compared.filter("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    edges = save(direct.union(derived_edges(compared, percent)).distinct(), "links")
    roots = components(edges)
    named = nodes.join(roots, "node", "left").select(*key, "low", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    answers = named.join(lowest, "root").select(*key, "component_id", "root")
    return signed.select("id", "th", *key).join(answers, key, "left").select("id", "th", "n", "component_id", "root")


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: ``id_col``, ``n_shingles``, ``component_id`` (see the module's text)."""
    out = labelled(docs, id_col, text, n, percent)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest id (nulls last, then by text hash).

    Documents without words link with nothing and stay. Of repeated rows (equal id and text) one stays. All columns stay.
    """
    names, docs = docs.columns, apart(docs, "__id", "__th", "__rows")
    rows = labelled(docs, id_col, text, n, percent).withColumn("k", F.struct(F.col("id").isNull().alias("none"), "id", "th"))
    first = rows.filter("root is not null").groupBy("root").agg(F.min("k").alias("k"), F.count("*").alias("rows"))
    first = first.select("k.*").union(rows.filter("root is null").select("k.*").distinct())
    same = rows.groupBy("k").count().select("k.*", "count")
    keep = first.join(same, (first["th"] == same["th"]) & first["id"].eqNullSafe(same["id"])).select(
        first["id"].alias("__id"), F.coalesce(first["th"], F.lit(0)).alias("__th"), same["count"].alias("__rows")
    )
    keep = save(keep, "keep")
    th = F.coalesce(F.xxhash64(docs[text]), F.lit(0))
    kept = lambda rows, wanted: rows.join(wanted, (th == F.col("__th")) & docs[id_col].cast("bigint").eqNullSafe(F.col("__id")))
    single, several = keep.filter("__rows = 1"), keep.filter("__rows > 1")
    # Repeated rows meet their key in a join of their own, which the others' texts need not reach.
    once = kept(docs.filter(likely_among(several, "__th")(th)), several).dropDuplicates(["__id", "__th"])
    return kept(docs, single).union(once).select(*[F.col(f"`{c}`") for c in docs.columns]).toDF(*names)
