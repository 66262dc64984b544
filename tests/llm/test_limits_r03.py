"""Steps that took more time or disk than their limits."""

import glob
import os
import time

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from pairloom.llm import jaccard, sentencepieces, store
from pairloom.llm.store import FILE_CLEANUP, save

SPM = public_tokenizers.path("piece_bpe_32k.model")


def test_words_of_long_documents_are_segmented_together(monkeypatch):
    pieces = sentencepieces.Pieces(SPM)
    plain, calls = pieces.segment, []
    monkeypatch.setattr(pieces, "segment", lambda *args: calls.append(args) or plain(*args))
    blank = sentencepieces.BLANK
    for text, stand_in in ((f"{blank}the quick{blank}{blank} brown fox\n jumps é一 ".replace(" ", blank) * 40, None),
                           (f"{blank}one \ufdd0 two three four ".replace(" ", blank) * 3, "\ufdd0")):
        size = len(text)
        calls.clear()
        matrix, ways = pieces.transfer(text, size, stand_in), pieces.exits(text, size, [0] + [sentencepieces.NONE] * (pieces.reach - 1), stand_in)
        if stand_in is None:
            assert len(calls) < 10  # a word comes 40 times
        value, back = pieces.best_path(text, [0], size, stand_in)
        assert matrix[0, 0] == value[size] and ways[0] == (0, pieces.trace(text, back, size, stand_in)[0])


def sets_of(spark, sizes):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 9000, dtype=np.uint64)
    sets = [np.concatenate((base[:shared], rng.integers(0, 1 << 64, own, dtype=np.uint64))) for shared, own in sizes]
    rows = [(i, len(s), jaccard.parity_sketch(s)) for i, s in enumerate(sets)]
    return sets, save(spark.createDataFrame(rows, "node long, n long, sketch array<bigint>"), "nodes")


def test_sketches_tell_large_sets_apart(spark):
    # sets 0 to 2 are alike across two sketch lengths, the others share little with them; 5 and 6 are alike, but not their pivot
    sets, nodes = sets_of(spark, [(4000, 50), (4000, 180), (4000, 0), (300, 3900), (0, 4100), (2000, 2000), (2000, 2010), (10, 5), (0, 20000)])
    sets[6][2000:4000] = sets[5][2000:4000]
    nodes = nodes.filter("node <> 6").union(spark.createDataFrame([(6, len(sets[6]), jaccard.parity_sketch(sets[6]))], nodes.schema))
    met = spark.createDataFrame([(0, i, i == 4) for i in range(1, 9)], "pivot long, node long, alone boolean")
    kept = {r.node for r in jaccard.may_link(met, nodes, 90).collect()}
    assert kept == {1, 2, 5, 6}
    pairs = nodes.alias("a").join(nodes.alias("b")).select("a.node", F.col("b.node").alias("other"), jaccard.differing_bits(F.col("a.sketch"), F.col("b.sketch")).alias("d"))
    for r in pairs.collect():
        assert r.d <= len(np.setxor1d(sets[r.node], sets[r.other]))


def test_saved_tables_leave_no_shuffle_files(spark):
    folder = os.path.dirname(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: set(glob.glob(f"{folder}/**/shuffle_*.data", recursive=True))
    before, setting = files(), spark.conf.get(FILE_CLEANUP)
    out = save(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count().repartition(7, "count"), "counted")
    until = time.time() + 10
    while not files() <= before and time.time() < until:  # they go without anybody waiting for it
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(FILE_CLEANUP) == setting
    assert out.count() == 1000


def test_filters_are_as_large_as_their_keys_need(spark, monkeypatch):
    sent, plain = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(value) or plain(value))
    rows = spark.range(40_000).select("id", F.xxhash64("id").alias("key"))
    for keys in (rows.filter("id < 1000"), rows.filter("id < 0"), rows):
        held = rows.filter(store.likely_among(keys, "key")("key"))
        n = keys.count()
        assert held.join(keys, "key").count() == n and n <= held.count() <= n + 1000
    assert [len(x) for x in sent] == [2 << 10, 1 << 10, 128 << 10]
    monkeypatch.setattr(store, "FILTER_BITS", 1 << 14)
    assert rows.filter(store.likely_among(rows, "key")("key")).count() == 40_000 and len(sent[-1]) == 2 << 10
