"""Repair of the turn structure of conversations by a generalised LR parser with weighted edits.

The role grammar is ``C -> empty | T | s T``, ``T -> u a | T u a`` over role initials. Its LR automaton is built from the
rules. A conversation is read turn by turn with a set of parse stacks that share what lies below their tops; equal
stacks are one stack and keep the smallest (cost, audit). At each turn every stack may take the turn as it is (K, 0),
take it in another role (R, 2), drop it (D, 3) or first take an empty turn that is put in (I, 2); a truncated turn that
stays costs 1 more, a blank or repeated one must go. Two audits of equal cost that reach one stack are never prefixes
of each other (a longer one has more insertions and so a higher cost), so the smaller one stays smaller.

A long conversation is several chunks of at most ``CHUNK`` rows. Each chunk is parsed from every stack it may be
entered with; its result (stack in, stack out, cost, audit) is combined with the next one's, up to ``FAN`` neighbours
at a time, until one result is left. Texts never meet: only one character per row goes to the parser, and texts are
joined to the rows that stay. The audit of a conversation is one cell.

Rows come by turn (nulls first), then role, then MD5 of the text. Null roles and texts are one space, rows without a
conversation id are one conversation; rows without a turn have no part in gaps. Repeated rows are duplicates and are
counted before anything moves. An empty table gives empty results; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.store import save

RULES = (("C", ""), ("C", "T"), ("C", "sT"), ("T", "ua"), ("T", "Tua"))
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
CHUNK = 4096
FAN = 64
# One character per row: its role's initial, upper case if truncated; a row that must go is a digit in its place.
INITIALS = "suax"
LEGAL = {"su", "ua", "au"}

Items = frozenset  # of (rule, position)
Stack = tuple  # (state, stack below) or None
Front = dict  # stack -> (cost, audit)


def closed(items) -> Items:
    more = list(items)
    out = set(more)
    while more:
        rule, dot = more.pop()
        for k, (left, _) in enumerate(RULES):
            if RULES[rule][1][dot : dot + 1] == left and (k, 0) not in out:
                out.add((k, 0))
                more.append((k, 0))
    return Items(out)


@lru_cache(None)
def goto(state: Items, symbol: str) -> Items:
    return closed((k, dot + 1) for k, dot in state if RULES[k][1][dot : dot + 1] == symbol)


BOTTOM: Stack = (closed((k, 0) for k, (left, _) in enumerate(RULES) if left == "C"), None)


def reduced(stack: Stack) -> Iterator[tuple[Stack, bool]]:
    """Stacks after one reduction each, and whether the whole conversation was reduced."""
    for k, dot in stack[0]:
        left, right = RULES[k]
        if dot == len(right):
            below = stack
            for _ in right:
                below = below[1]
            if left == "C":
                yield below, True
            else:
                yield (goto(below[0], left), below), False


@lru_cache(None)
def shifts(stack: Stack, symbol: str) -> tuple[Stack, ...]:
    """Stacks after taking a role, through any reductions; a state that only reduces is reduced at once."""
    out = [(state, stack)] if (state := goto(stack[0], symbol)) else []
    out += [s for below, whole in reduced(stack) if not whole for s in shifts(below, symbol)]
    ready = [s for s in out if all(dot == len(RULES[k][1]) for k, dot in s[0])]
    return tuple(s for s in out if s not in ready) + tuple(b for s in ready for b, _ in reduced(s))


@lru_cache(None)
def accepted(stack: Stack) -> bool:
    return any(whole or accepted(below) for below, whole in reduced(stack))


def all_stacks() -> list[Stack]:
    found = [BOTTOM]
    for stack in found:
        found += [s for x in "sua" for s in shifts(stack, x) if s not in found]
    return found


STACKS = all_stacks()


def take(front: Front, stack: Stack, cost: int, audit: str) -> bool:
    if stack in front and front[stack] <= (cost, audit):
        return False
    front[stack] = (cost, audit)
    return True


def inserted(front: Front) -> Front:
    """With any empty turns put in."""
    out, open_ = dict(front), list(front)
    while open_:
        stack = open_.pop()
        cost, audit = out[stack]
        for x in ROLES:
            open_ += [s for s in shifts(stack, x) if take(out, s, cost + INSERT, audit + "I")]
    return out


def parse(rows: str, copies: list[int] | None, start: Stack) -> Front:
    """Best (cost, audit) per stack after the rows, from one stack."""
    front: Front = {start: (0, "")}
    for i, row in enumerate(rows):
        n = copies[i] if copies else 1
        if not row.isdigit():
            after: Front = {}
            symbol, extra = row.lower(), TRUNCATED * row.isupper()
            for stack, (cost, audit) in inserted(front).items():
                for x in {symbol, *ROLES}:
                    edit, price = ("K", 0) if x == symbol else ("R", REROLE)
                    for s in shifts(stack, x):
                        take(after, s, cost + price + extra, audit + edit)
            for stack, (cost, audit) in front.items():
                take(after, stack, cost + DELETE, audit + "D")
            front, n = after, n - 1
        if n:
            front = {stack: (cost + n * DELETE, audit + "D" * n) for stack, (cost, audit) in front.items()}
    return front


def ended(front: Front) -> tuple[int, str]:
    return min(v for stack, v in inserted(front).items() if accepted(stack))


@lru_cache(1 << 16)
def short(rows: str) -> tuple[int, str]:
    return ended(parse(rows, None, BOTTOM))


def illegal_pairs(rows: str, copies: list[int] | None) -> int:
    """Neighbouring rows whose initials cannot follow each other; copies of a row stand side by side."""
    flat = "".join(INITIALS[int(r)] if r.isdigit() else r.lower() for r in rows)
    return sum(a + b not in LEGAL for a, b in zip(flat, flat[1:])) + (sum(copies) - len(copies) if copies else 0)


def initial(row: str) -> str:
    return INITIALS[int(row)] if row.isdigit() else row.lower()


# -- rows ----------------------------------------------------------------------------------
def classified(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Distinct rows without text, numbered from 0 in order over the table, with their fault; and texts by key."""
    one_space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), one_space(role).alias("role"), one_space(text).alias("text"))
    rows = rows.withColumn("digest", F.md5("text"))
    blank = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    cut = ~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    key = ["conv", "turn", "role", "digest"]
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.first(blank).alias("blank"), F.first(cut).alias("cut"))
    order = [F.col(c).asc_nulls_first() for c in key]
    ranged = counted.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = save(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    placed = placed.withColumn("row", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "at", "before")
    first = placed.filter(~F.col("blank")).groupBy("conv", "role", "digest").agg(F.min("row").alias("row"))
    first = first.select("row", F.lit(True).alias("first"))
    numbered = placed.join(first, "row", "left")
    initial_ = F.substring("role", 1, 1)
    letter = F.when(initial_.isin("s", "u", "a"), initial_).otherwise("x")
    class_ = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    must_go = F.col("blank") | F.col("first").isNull()
    code = F.when(must_go, class_.cast("string")).when(F.col("cut"), F.upper(letter)).otherwise(letter)
    return save(numbered.withColumn("code", code), "coded-turns"), rows


def counts(coded: DataFrame) -> DataFrame:
    """gaps and the number of blank, duplicate and truncated rows of each conversation."""
    kept = F.col("first").isNotNull()
    # a later copy of a row repeats its role and text
    faults = {
        "blank": F.when(F.col("blank"), F.col("copies")).otherwise(0),
        "duplicate": F.when(~F.col("blank"), F.col("copies") - kept.cast("bigint")).otherwise(0),
        "truncated": F.when(~F.col("blank") & kept & F.col("cut"), 1).otherwise(0),
    }
    by_turn = coded.groupBy("conv", "turn").agg(*[F.sum(v).alias(k) for k, v in faults.items()])
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return by_turn.groupBy("conv").agg(F.coalesce(span, F.lit(0)).alias("gaps"), *[F.sum(k).alias(k) for k in faults])


PIECE = "array<struct<chunk: bigint, letters: bigint>>"
RESULT = "array<struct<source: int, target: int, cost: bigint, audit: string>>"


def results(coded: DataFrame, chunk: int, fan: int) -> DataFrame:
    """Per conversation: illegal, cost, audit and its pieces (chunk, letters of the audit that are not insertions)."""
    kind = coded.schema["conv"].dataType.simpleString()
    block = F.floor(F.col("row") / chunk).alias("chunk")
    listed = F.array_sort(F.collect_list(F.struct("row", "code", "copies")))
    chunks = coded.groupBy("conv", block).agg(listed.alias("rows"))  # at most ``chunk`` rows
    extent = coded.groupBy("conv").agg((F.floor(F.min("row") / chunk) == F.floor(F.max("row") / chunk)).alias("alone"))
    copies = F.when(F.exists("rows", lambda r: r["copies"] > 1), F.col("rows.copies"))
    chunks = chunks.select("conv", "chunk", F.array_join("rows.code", "").alias("codes"), copies.alias("copies"))
    chunks = chunks.join(extent.withColumnRenamed("conv", "__conv"), F.col("conv").eqNullSafe(F.col("__conv"))).drop("__conv")
    schema = f"conv {kind}, chunk bigint, alone boolean, first string, last string, illegal bigint, result {RESULT}, pieces {PIECE}"
    types = pa.struct([("source", pa.int32()), ("target", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])

    def rows_out(ids: pa.Array, rows: list[dict]) -> pa.RecordBatch:
        cols = {"conv": ids}
        plain = {"chunk": pa.int64(), "alone": pa.bool_(), "first": pa.string(), "last": pa.string(), "illegal": pa.int64()}
        cols |= {c: pa.array([r[c] for r in rows], t) for c, t in plain.items()}
        cols["result"] = pa.array([r["result"] for r in rows], pa.list_(types))
        cols["pieces"] = pa.array([r["pieces"] for r in rows], pa.list_(pa.struct([("chunk", pa.int64()), ("letters", pa.int64())])))
        return pa.RecordBatch.from_pydict(cols)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number, codes, n, alone in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                if alone:
                    best = short(codes) if n is None and len(codes) <= 64 else ended(parse(codes, n, BOTTOM))
                    found = [(0, 0, *best)]
                else:
                    found = [(i, STACKS.index(t), *v) for i, s in enumerate(STACKS) for t, v in parse(codes, n, s).items()]
                found = [dict(zip(("source", "target", "cost", "audit"), f)) for f in found]
                pieces = [{"chunk": number, "letters": sum(n) if n else len(codes)}]
                out.append({"chunk": number, "alone": alone, "first": initial(codes[0]), "last": initial(codes[-1]), "illegal": illegal_pairs(codes, n), "result": found, "pieces": pieces})
            yield rows_out(batch.column(0), out)

    def product(group: pa.Table) -> pa.Table:
        """The results of neighbouring chunks as one."""
        parts = sorted(group.to_pylist(), key=lambda r: r["chunk"])
        whole = parts[0]
        for part in parts[1:]:
            found: dict[tuple[int, int], tuple[int, str]] = {}
            for a in whole["result"]:
                for b in part["result"]:
                    if a["target"] == b["source"]:
                        take(found, (a["source"], b["target"]), a["cost"] + b["cost"], a["audit"] + b["audit"])
            result = [{"source": s, "target": t, "cost": c, "audit": x} for (s, t), (c, x) in found.items()]
            crossing = int(whole["last"] + part["first"] not in LEGAL)
            whole = whole | {"last": part["last"], "illegal": whole["illegal"] + part["illegal"] + crossing, "result": result, "pieces": whole["pieces"] + part["pieces"]}
        whole["chunk"] //= fan
        return pa.Table.from_batches([rows_out(group.column("conv").slice(0, 1).combine_chunks(), [whole])])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, audits = [], []
            for alone, found in zip(batch.column(2).to_pylist(), batch.column(6).to_pylist()):
                front = {STACKS[f["target"]]: (f["cost"], f["audit"]) for f in found if f["source"] == 0}
                cost, audit = front[BOTTOM] if alone else ended(front)
                costs.append(cost)
                audits.append(audit)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), batch.column(7)], ["conv", "illegal", "cost", "audit", "pieces"])

    parsed = save(chunks.mapInArrow(work, schema), "parsed-turns")
    single, many = parsed.filter("alone"), parsed.filter("not alone")
    while many.groupBy("conv").count().filter("count > 1").limit(1).count():
        group = many.groupBy("conv", F.floor(F.col("chunk") / fan).alias("group"))
        many = save(group.applyInArrow(product, schema), "combined-turns")
    return single.unionByName(many).mapInArrow(close, f"conv {kind}, illegal bigint, cost bigint, audit string, pieces {PIECE}")


def edits(found: DataFrame, coded: DataFrame, chunk: int) -> DataFrame:
    """Rows that stay or are put in: conv, seq (from 0), row (null if put in), edit, role (null: its own)."""
    kind = found.schema["conv"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The audit of each piece, and where its output starts."""
        for batch in batches:
            for i in range(len(batch)):
                audit, pieces = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                size = len(audit) - audit.count("D")
                at, before, out = 0, 0, []
                for k, piece in enumerate(pieces):
                    end, left = at, piece["letters"]
                    while left:
                        left -= audit[end] != "I"
                        end += 1
                    part = audit[at:] if k == len(pieces) - 1 else audit[at:end]
                    out.append((piece["chunk"], part, before, size % 2 == 1))
                    before += len(part) - part.count("D")
                    at = end
                number, part, start, system = zip(*out)
                ids = pa.concat_arrays([batch.column(0).slice(i, 1)] * len(out))
                yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int64()), pa.array(part), pa.array(start, pa.int64()), pa.array(system)], ["conv", "chunk", "part", "start", "system"])

    parts = found.select("conv", "audit", "pieces").mapInArrow(cut, f"conv {kind}, chunk bigint, part string, start bigint, system boolean")
    own = coded.groupBy("conv", F.floor(F.col("row") / chunk).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("row", "copies"))).alias("rows"))
    own = own.withColumnsRenamed({"conv": "__conv", "chunk": "__chunk"})
    joined = parts.join(own, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("chunk") == F.col("__chunk")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = [], []
            for i in range(len(batch)):
                part, start, system, first = (batch.column(c)[i].as_py() for c in (1, 2, 3, 4))
                ends, seen, seq = batch.column(5)[i].as_py(), 0, start  # letters up to and with each row
                at = 0
                for edit in part:
                    if edit == "I":
                        row = None
                    else:
                        while seen >= ends[at]:
                            at += 1
                        row, seen = first + at, seen + 1
                    if edit != "D":
                        role = None if edit == "K" else ("assistant" if (seq - system) % 2 else "user")
                        of.append(i)
                        out.append((seq, row, edit, role))
                        seq += 1
            cols = list(zip(*out)) if out else [()] * 4
            arrays = [batch.column(0).take(pa.array(of, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()))]]
            yield pa.RecordBatch.from_arrays(arrays, ["conv", "seq", "row", "edit", "new_role"])

    ends = F.transform("rows", lambda r: r["copies"])
    ends = F.transform(F.sequence(F.lit(1), F.size("rows")), lambda i: F.aggregate(F.slice(ends, F.lit(1), i), F.lit(0).cast("bigint"), lambda x, y: x + y))
    whole = F.when(F.exists("rows", lambda r: r["copies"] > 1), ends).otherwise(F.transform(F.sequence(F.lit(1), F.size("rows")), lambda i: i.cast("bigint")))
    narrow = joined.select("conv", "part", "start", "system", F.col("rows")[0]["row"].alias("first"), whole.alias("ends"))
    return narrow.mapInArrow(rows, f"conv {kind}, seq bigint, row bigint, edit string, new_role string")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Two tables: per conversation (``conv``, gaps, blank, duplicate, truncated, illegal, cost, audit), and the repaired
    turns (``conv``, seq, edit, ``role``, ``text``)."""
    coded, rows = classified(turns, conv, turn, role, text)
    found = save(results(coded, chunk, fan), "repairs")
    total = counts(coded).withColumnRenamed("conv", "__conv")
    summary = found.join(total, F.col("conv").eqNullSafe(F.col("__conv")))
    summary = summary.select(F.col("conv").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    kept = edits(found, coded, chunk).alias("e").join(coded.select("row", "turn", F.col("role").alias("own"), "digest"), "row", "left")
    texts = rows.groupBy("conv", "turn", "role", "digest").agg(F.first("text").alias("text"))
    texts = texts.select(*[F.col(c).alias(f"t_{c}") for c in texts.columns])
    same = F.col("conv").eqNullSafe(F.col("t_conv")) & F.col("turn").eqNullSafe(F.col("t_turn")) & (F.col("own") == F.col("t_role")) & (F.col("digest") == F.col("t_digest"))
    joined = kept.join(texts, same, "left")
    final = F.coalesce("new_role", "own").alias(role)
    return summary, joined.select(F.col("conv").alias(conv), "seq", "edit", final, F.coalesce("t_text", F.lit("")).alias(text))


def text_hashes(repaired: DataFrame, conv: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines; its rows pass by in order, one at a time."""
    import hashlib

    kind = repaired.schema[conv].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = (), None
        for batch in batches:
            ids, hashes = [], []
            for name, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (name,) != key:
                    if state is not None:
                        ids.append(key[0])
                        hashes.append(state.hexdigest())
                    key, state = (name,), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(hashes, pa.string())], ["conv", "hash"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], batch.schema.field(0).type), pa.array([state.hexdigest()])], ["conv", "hash"])

    lines = repaired.select(F.col(conv).alias("conv"), "seq", F.concat_ws(":", role, text).alias("line"))
    ordered = lines.repartition(F.col("conv")).sortWithinPartitions("conv", "seq").select("conv", "line")
    return ordered.mapInArrow(work, f"conv {kind}, hash string")


# -- the registered query ------------------------------------------------------------------
def damaged(turns: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given to the user by crc32 of ``conv_id:turn``."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(show("conv_id"), F.lit(":"), show("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", show("role").alias("role"), show("text").alias("text"), h.alias("h")).filter("h != 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def report(turns: DataFrame) -> DataFrame:
    """Every conversation of ``turns``, damaged and repaired."""
    summary, repaired = repair(damaged(turns))
    hashes = text_hashes(repaired)
    every = turns.select(F.col("conv_id").alias("id")).distinct()
    joined = every.join(summary, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("id").eqNullSafe(F.col("conv")), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("hash", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
