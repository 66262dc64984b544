"""WARC records and a Merkle audit of two replicas. Built-in expressions only.

Pages are written as WARC records; records stand in archives (the partitions they were read in) in order, each with
its byte offset. A replica's leaf is the SHA-256 of a record; an inner node hashes the ordered hashes of up to
``FANOUT`` children together with the byte ranges they cover, counted from the node's own start; an archive's root covers it whole. The audit compares the roots of two
replicas, then only the children of nodes that differ, level by level, down to single records: changed, or missing in
one replica. The number of levels is the logarithm of the largest archive; a node never has more than ``FANOUT`` children.

Null url and html are empty strings, a null id is written as an empty name. Repeated rows are records of their own. An empty
table has no archives and no damage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.store import save

FANOUT = 32
LINE = "\r\n"


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """One WARC response record as binary."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(
        F.lit(f"WARC/1.1{LINE}WARC-Type: resource{LINE}WARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">{LINE}WARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit(f"{LINE}WARC-Block-Digest: sha256:"),
        F.sha2(body, 256),
        F.lit(f"{LINE}Content-Type: text/html{LINE}Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(LINE * 2),
    )
    return F.concat(head.cast("binary"), body, F.lit(LINE * 2).cast("binary"))


def archive(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(archive, record_no, id, record): the pages as ordered WARC records, written once, which fixes their order."""
    place = F.monotonically_increasing_id()
    rows = pages.select(place.alias("p"), F.col(id_col).alias("id"), record_bytes(F.col(id_col), F.col(url), F.col(html)).alias("record"))
    return save(rows.select(F.shiftright("p", 33).alias("archive"), F.col("p").bitwiseAND((1 << 33) - 1).alias("record_no"), "id", "record"), "archive")


def leaves(records: DataFrame) -> DataFrame:
    """(archive, record_no, id, offset, length, hash) of a replica's records.

    Offsets are running sums in two steps, within blocks of ``FANOUT`` squared records and over the blocks of an archive.
    """
    rows = records.select("archive", "record_no", "id", F.octet_length("record").cast("bigint").alias("length"), F.sha2("record", 256).alias("hash"))
    rows = rows.withColumn("block", F.floor(F.col("record_no") / (FANOUT * FANOUT)))
    inside = Window.partitionBy("archive", "block").orderBy("record_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    totals = rows.groupBy("archive", "block").agg(F.sum("length").alias("size"))
    before = Window.partitionBy("archive").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("archive", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    out = rows.join(totals, ["archive", "block"])
    return out.select("archive", "record_no", "id", (F.col("inner") + F.col("base")).alias("offset"), "length", "hash")


def tree(leaf: DataFrame, name: str) -> list[DataFrame]:
    """Levels from the records (0) to the roots: (archive, node, from, to, hash)."""
    level = leaf.select("archive", F.col("record_no").alias("node"), F.col("offset").alias("from"), (F.col("offset") + F.col("length")).alias("to"), "hash")
    levels = [save(level, name)]
    high = levels[0].agg(F.max("node").alias("m")).first()["m"]
    while high is not None and high > 0:
        children = F.array_sort(F.collect_list(F.struct("node", "from", "to", "hash")))
        up = levels[-1].groupBy("archive", F.floor(F.col("node") / FANOUT).alias("node")).agg(children.alias("c"))
        text = F.concat_ws("\n", F.transform("c", lambda c: F.concat_ws(" ", c["node"].cast("string"), (c["from"] - F.array_min("c.from")).cast("string"), (c["to"] - c["from"]).cast("string"), c["hash"])))
        up = up.select("archive", "node", F.array_min("c.from").alias("from"), F.array_max("c.to").alias("to"), F.sha2(text, 256).alias("hash"))
        levels.append(save(up, name))
        high //= FANOUT
    return levels


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Damage between two replicas' leaves: archive, record_no, id, offsets, lengths and hashes of both, kind."""
    a, b = tree(left, "left"), tree(right, "right")
    while len(a) != len(b):  # a shorter tree gets levels of single children, so that roots meet roots
        short = a if len(a) < len(b) else b
        top = short[-1]
        short.append(top.select("archive", F.floor(F.col("node") / FANOUT).alias("node"), "from", "to", F.sha2(F.concat_ws(" ", "node", "hash"), 256).alias("hash")))
    suspects = None
    for x, y in zip(reversed(a), reversed(b)):
        if suspects is not None:
            under = F.floor(F.col("node") / FANOUT)
            x, y = (z.withColumn("up", under).join(suspects, ["archive", "up"], "left_semi").drop("up") for z in (x, y))
        both = x.select("archive", "node", F.col("hash").alias("h1")).join(y.select("archive", "node", F.col("hash").alias("h2")), ["archive", "node"], "full")
        suspects = save(both.filter(~F.col("h1").eqNullSafe(F.col("h2"))).select("archive", F.col("node").alias("up")), "suspects")
    bad = suspects.withColumnRenamed("up", "record_no")
    one = left.join(bad, ["archive", "record_no"], "left_semi")
    two = right.join(bad, ["archive", "record_no"], "left_semi")
    names = ["id", "offset", "length", "hash"]
    one = one.select("archive", "record_no", *[F.col(n).alias(f"left_{n}") for n in names])
    two = two.select("archive", "record_no", *[F.col(n).alias(f"right_{n}") for n in names])
    kind = F.when(F.col("left_hash").isNull(), "missing left").when(F.col("right_hash").isNull(), "missing right").otherwise("changed")
    return one.join(two, ["archive", "record_no"], "full").withColumn("kind", kind)


def damaged(records: DataFrame, every: int = 101, lost: int = 1009) -> DataFrame:
    """A replica with planted damage, in every archive from its first records on.

    Of each ``every`` records the first has a changed byte; of each ``lost`` the second is cut short and the third is gone.
    """
    n, place = F.octet_length("record"), F.col("record_no")
    at = F.pmod(F.xxhash64("record"), n).cast("int")
    flipped = F.concat(F.substring("record", F.lit(1), at), F.unhex(F.lpad(F.hex(255 - F.conv(F.hex(F.substring("record", at + 1, F.lit(1))), 16, 10).cast("int")), 2, "0")), F.substring("record", at + 2, n))
    changed = F.when(place % lost == 1, F.substring("record", F.lit(1), n - 1)).when(place % every == 0, flipped).otherwise(F.col("record"))
    return records.filter(place % lost != 2).withColumn("record", changed)


def incomplete(records: DataFrame, lost: int = 1009) -> DataFrame:
    """A replica without the fourth of each ``lost`` records of an archive."""
    return records.filter(F.col("record_no") % lost != 3)
