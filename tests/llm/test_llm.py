"""Operators of the subpackage against brute force, round trips and edge cases."""

import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from oracle import compare, database
from pyspark.sql import functions as F

import corpus_pipeline
from pairloom.llm import extraction, fixity, jaccard, language, licenses, packing, quality, sentencepieces, suffixes, topk
from pairloom.llm.queries import QUERIES, SQL
from pairloom.llm.store import save

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, __x string"
BPE, SPM = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def words(text):
    return WORD.findall((text or "").encode().lower().decode())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rnd = random.Random(3)
    prose = [" ".join(rnd.choice("the of and house tree river stone light water road".split()) + str(rnd.randrange(60)) for _ in range(n)) for n in (5, 90, 200, 3000)]
    edited = prose[2].replace(prose[2].split()[50], "changed", 1)
    texts = [None, "", "   \n", "a", "A b", "a B", *prose, prose[1], prose[1], edited, "x " * 500 + prose[1], "é" * 70, "日本 語 " * 40, prose[2] + "\nmore <|endoftext|> text", "mit \x1c License\n" * 3]
    rows = [(i if i % 7 else None, t, "en" if i % 2 else None, None if i % 3 else "s", None, i, "x") for i, t in enumerate(texts, 1)]
    rows += [rows[8], rows[8], (9, "another text of this id", "en", "s", 3, 1, None)]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), database(FOLDER), SQL[name]) is None


def test_quality_sql_where_documents_share_long_lines(spark, tmp_path):
    """Two lines that are longer than the documents' own ones count every document."""
    shared = ["we use cookies and similar tools to keep this site working for every reader " * 2, "all rights reserved by the owners of this site and its partners"]
    name = lambda i, j: "".join(chr(97 + (i * 7 + j * 3 + k * k * (i + 1)) % 26) for k in range(6)) + chr(97 + j % 26) + chr(97 + j // 26)
    body = lambda i: "\n".join(" ".join(name(i, 9 * j + k) for k in range(8)) for j in range(9))
    rows = [(i, "\n".join([body(i), *shared]), "en", "h", 1) for i in range(60)] + [(100 + i, "\n".join([body(7), *shared]), "en", "h", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = quality.verdicts(spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert got.filter("n_removed_chars > 0").count() == 90
    assert compare(got, con, SQL["op1_quality_rules"]) is None


def test_quality_edges(spark, odd):
    got = quality.verdicts(odd)
    assert got.count() == odd.count()
    for r in got.join(odd.groupBy("doc_id").agg(F.count("*").alias("c"), F.first("text").alias("t")).filter("c = 1"), "doc_id").collect():
        w = WORD.findall(r["t"] or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)} if len(w) < 1000 else None
        assert r["n_words"] == len(w)
        assert covered is None or r["n_repeat_words"] == len(covered)
    assert quality.clean(odd).columns == odd.columns


def test_boilerplate_is_removed_and_depleted_documents_go(spark):
    line = "follow this site for more news every single day of the whole year"
    body = lambda i: " ".join(chr(97 + i % 26) + chr(97 + i // 26) + chr(97 + j % 26) + chr(97 + j // 26) for j in range(60))
    rows = [(i, f"{body(i)}\n{line}", "h") for i in range(40)] + [(40, f"{line}\n{line}!\n" + "\n".join([line] * 10) + "\nown words here", "h")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in quality.verdicts(docs).collect()}
    assert all(got[i]["kept"] and got[i]["n_removed_chars"] == len(line) for i in range(40))
    assert not got[40]["kept"]
    assert all(line not in r["text"] for r in quality.clean(docs).collect())


def test_two_shared_lines_are_boilerplate_and_copies_are_not(spark):
    """The lines that documents share count every document, however long they are; copies of one text count once."""
    shared = ["we use cookies and similar tools to keep this site working for every reader " * 2, "all rights reserved by the owners of this site and of its many partner sites"]
    name = lambda i: chr(97 + i % 26) + chr(97 + i // 26)
    body = lambda i: "\n".join(" ".join(name(i) + name(j) + name(k) for k in range(8)) for j in range(8))
    rows = [(i, "\n".join([body(i), *shared]), "two") for i in range(40)] + [(40, "\n".join([*shared, "own words"] + ["of this one"] * 5), "two")]
    rows += [(100 + i, body(100), "copies") for i in range(40)] + [(200 + i, body(200 + i), "copies") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in quality.verdicts(docs).collect()}
    assert all(got[i]["n_removed_chars"] == sum(len(x.strip()) for x in shared) for i in range(41))
    assert got[40]["depleted"] and not any(got[i]["depleted"] for i in range(40))
    assert all(got[i]["n_removed_chars"] == 0 and got[i]["kept"] for i in got if i >= 100)


def spelled(text):
    pieces = sentencepieces.loaded(SPM)
    if not text:
        return []
    body, stand_in = pieces.prepare(text)
    body = sentencepieces.BLANK + body
    _, back = pieces.best_path(body, [0], len(body), stand_in)
    return pieces.trace(body, back, len(body), stand_in)[0]


@pytest.mark.parametrize("chunk", [20, 33, 4000])
def test_sentencepiece(spark, chunk):
    rnd = random.Random(1)
    texts = [None, "", "▁ x▁", "a" * 90, "日本語の文章です。" * 9, "  lead\n\ntrail  "] + ["".join(rnd.choice("ab the 日é▁\n ") for _ in range(rnd.randrange(1, 150))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    encoded = save(sentencepieces.encode(df, SPM, chunk=chunk), "encoded")
    rows, back = {}, {}
    for r in encoded.orderBy("doc_id", "chunk").collect():
        rows.setdefault(r["doc_id"], []).extend(r["ids"])
    for r in sentencepieces.decode(encoded, SPM).orderBy("doc_id", "chunk").collect():
        back[r["doc_id"]] = back.get(r["doc_id"], "") + r["text"]
    assert all(rows[i] == spelled(t) and back[i] == (t or "") for i, t in enumerate(texts))


def test_transfer_matrices_are_associative():
    rng = np.random.default_rng(0)
    a, b, c = (rng.integers(-50, 0, (5, 5)) for _ in range(3))
    left = sentencepieces.combine(sentencepieces.combine(a, b), c)
    assert (left == sentencepieces.combine(a, sentencepieces.combine(b, c))).all()


def repeated(texts, size=50):
    seen, covered, later = {}, {}, {}
    for key, text in sorted(texts.items()):
        w = words(text)
        for s in range(len(w) - size + 1):
            seen.setdefault(tuple(w[s : s + size]), []).append((key, s))
    for places in seen.values():
        for i, (key, s) in enumerate(places if len(places) > 1 else []):
            covered.setdefault(key, set()).update(range(s, s + size))
            if i:
                later.setdefault(key, set()).update(range(s, s + size))
    return covered, later


def test_suffixes_match_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    covered, later = repeated({r["doc_id"]: r["text"] for r in docs.collect()})
    got, got_later = {}, {}
    for key, a, b, late in rows_of(suffixes.find(docs), "doc_id", "first_word", "end_word", "later"):
        got.setdefault(key, set()).update(range(a, b))
        if late:
            got_later.setdefault(key, set()).update(range(a, b))
    assert (got, got_later) == (covered, later)


def test_suffixes_edges(spark, odd):
    left = suffixes.remove(odd)
    assert left.columns == odd.columns
    kept = [words(r["text"]) for r in left.distinct().collect()]
    grams = [tuple(w[i : i + 50]) for w in kept for i in range(len(w) - 49)]
    assert len(grams) - len(set(grams)) <= 50 * 2  # what remains stands at the seams of cuts only


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    got = language.identify(odd)
    assert got.count() == odd.count()
    assert {r["lang_pred"] for r in language.predict(odd, {"en": np.array([1])}).filter("text is null or trim(text) = ''").collect()} == {"und"}


def test_licenses(spark, odd):
    rows = licenses.scan(odd).collect()
    assert len(rows) == odd.count() and sorted(r["n_base"] for r in rows)[-1] == 0
    docs = spark.createDataFrame(
        [(1, "So Under-the MIT (License)! under the mit license"), (2, "Apache License, Version 2.0; CC BY-NC-SA"), (3, "GNU General Public License, version 3 licence"), (4, None)],
        "doc_id bigint, text string",
    )
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 1, 5, "mit")
    assert got[2]["base_labels"] == "apache-2,cc-by-nc" and "cc-by-nc-sa" in got[2]["labels"]
    assert got[3]["labels"] == "gpl-3" and got[4]["labels"] == "" and got[4]["first_word"] is None
    assert len(licenses.Rules().rules) > 200


def test_suppression():
    hits = [(1, 0, 10, 0, "a"), (2, 2, 8, 1, "b"), (1, 3, 5, 2, "c"), (2, 2, 8, 3, "d"), (1, 20, 22, 4, "e")]
    assert {h[4] for h in licenses.surviving(hits)} == {"a", "b", "e"}


def test_fixity(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    records = fixity.archive(pages)
    whole = records
    records = fixity.incomplete(whole, lost=13)
    hurt = fixity.damaged(whole, every=7, lost=11)
    left, right = save(fixity.leaves(records), "l"), save(fixity.leaves(hurt), "r")
    a = {(r["archive"], r["record_no"]): bytes(r["record"]) for r in records.collect()}
    b = {(r["archive"], r["record_no"]): bytes(r["record"]) for r in hurt.collect()}
    got = set(rows_of(fixity.audit(left, right), "archive", "record_no", "kind"))
    assert {k for *_, k in got} == {"changed", "missing left", "missing right"}
    kind = lambda k: "missing right" if k not in b else "missing left" if k not in a else "changed"
    assert got == {(*k, kind(k)) for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    assert fixity.audit(left, left).count() == 0


def test_fixity_edges(spark):
    rows = [(None, None, None), (1, "u", ""), (1, "u", ""), (2, None, "x" * 300_000), (3, "v", "y")]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id bigint, url string, html string, archive int, record string")
    whole = fixity.archive(pages)
    assert whole.count() == 5
    left = save(fixity.leaves(whole), "l")
    assert fixity.audit(left, save(fixity.leaves(fixity.damaged(whole)), "r")).count() >= 2
    empty = save(fixity.leaves(fixity.archive(pages.limit(0))), "e")
    assert fixity.audit(empty, empty).count() == 0 and fixity.audit(empty, left).count() == 5


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    packed = packing.packed_documents(odd, BPE).collect()
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for line in bins.values():
        line.sort()
        assert all(o == sum(n for _, n in line[:i]) for i, (o, _) in enumerate(line)) and sum(n for _, n in line) <= 2048
    want, got = [], sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
    for r in odd.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        for k, a in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[a : first if k == 0 else a + 2048]
            want.append((r["doc_id"] or -1, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert got == sorted(want)
    assert len(bins) == -(-sum(w[3] for w in want) // 2048)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_best_fit(rule):
    lengths = np.random.default_rng(5).integers(1, 100, 400)
    bins = packing.best_fit(lengths, (100, 3, 12000), (1.0, 1.0, 1.0), rule)
    for b in range(bins.max() + 1):
        own = lengths[bins == b]
        assert own.sum() <= 100 and 0 < len(own) <= 3 and ((own**2).sum() <= 12000)


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
<div id=cookie-notice>We use cookies, many, really.</div><div class=content><h1>Head &amp; line</h1>
<p>First paragraph, with commas, and a good length of text to be counted well.<p>Second   paragraph<br>goes on, &eacute; inside, the block of text.
<ul><li>one item<li>two items</ul><div class="ad-banner">Buy now, cheap, good</div></div><div class=sidebar><p>Other, stuff, long enough, to score, if it were kept here.</p></div>
<form><label>Mail</label></form><section id=comments><p>I think, well, this is nice, and long enough to count.</p></section><script>var a="</p>"</script><footer>foot</footer></body></html>"""


def test_extraction(spark):
    want = "Head & line\nFirst paragraph, with commas, and a good length of text to be counted well.\nSecond paragraph goes on, é inside, the block of text.\none item\ntwo items"
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>a<b>"), (4, "u", "<p>a<b>")], "page_id bigint, url string, html string")
    assert sorted(rows_of(extraction.extract(pages), "page_id", "text")) == [(1, want), (2, ""), (3, ""), (4, "a"), (4, "a")]


BODY = "".join(f"<p>Paragraph {i}, with commas, and a good length of text to be counted well by anyone, really.</p>" for i in range(5))
LINE = "Paragraph 0, with commas, and a good length of text to be counted well by anyone, really."


@pytest.mark.parametrize("name", ["has-sidebar", "content with-sidebar", "layout-no-sidebar", "post share-enabled", "single comments-open", "page-header-fixed", "sidebar", "widget"])
@pytest.mark.parametrize("page", ["<div class='{}'>{}</div>", "<div class='{}'><article>{}</article></div>"])
def test_wrappers_keep_their_article(name, page):
    text = extraction.main_text("<nav>Home</nav>" + page.format(name, BODY) + "<footer>end</footer>")
    assert text.count("\n") == 4 and text.startswith(LINE)


@pytest.mark.parametrize("name", ["comments", "comment-list", "sidebar", "site-footer", "cookie-notice", "related", "main-nav", "ad-banner", "social share"])
@pytest.mark.parametrize("inner", ["{}", "<article class='comment-body'>{}</article>", "<article>{}</article>"])
def test_doubtful_elements_beside_the_article_go(name, inner):
    other = BODY.replace("Paragraph", "Other words")
    page = f"<main><article>{BODY}</article></main><div class='{name}'>{inner.format(other)}</div>"
    text = extraction.main_text(page)
    assert text.count("\n") == 4 and "Other" not in text


def test_pages_edges(spark):
    rows = [(i, "u", h, "t", 1) for i, h in enumerate([None, "", "<p>" + "word, " * 40_000, BODY, BODY, "<div class=comments>" + BODY + "</div>"])]
    got = extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, score int")).collect()
    assert [len(r["text"]) for r in sorted(got, key=lambda r: r["page_id"])] == [0, 0, 239_999, 449, 449, 0]
    assert extraction.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_clashing_names_in_pipeline_stages(spark):
    rows = [(i, "some words of a text that stands alone here " * 12 + str(i), "h", 1, 2, 3, 4, 5) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, __id int, __th int, __drop int, __rows int, __cuts int")
    for stage in (quality.clean, jaccard.keep_one, suffixes.remove):
        out = stage(docs)
        assert out.columns == docs.columns and {r["__drop"] for r in out.collect()} <= {3}


def test_language_sample_at_any_size(spark):
    """A rare language is learned beside one of many rows, and a tiny share still learns."""
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice("the and house with water".split()) for _ in range(9)), "en") for i in range(3000)]
    rows += [(5000 + i, " ".join(rnd.choice("und der haus mit wasser".split()) for _ in range(9)), "de") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    profiles = language.fit(docs, fit_rows=40)
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, profiles).collect()}
    assert all(got[r[0]] == r[2] for r in rows)


def test_topk_with_large_components_and_clashing_names(spark):
    rnd = random.Random(3)
    big = lambda: [rnd.choice([-1, 1]) * rnd.random() * 10 ** rnd.choice([0, 4, 6]) for _ in range(3)]
    rows = [(i, big(), "x", 1, 2.0) for i in range(120)] + [(500, [1e9, 1e9, 1e9], "x", 1, 2.0), (501, [1e15, 0.0, 0.0], "x", 1, 2.0), (502, [1.0], "x", 1, 2.0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, v string, id int, norm double")
    whole = {r[0]: [math.floor(256 * x) for x in r[1]] for r in rows if len(r[1]) == 3}
    limit = (1 << 63) - 1
    got = {}
    for q, _, c, s in sorted(rows_of(topk.top_inner_products(df), "query_id", "rank", "vec_id", "score")):
        got.setdefault(q, []).append((c, s))
    for q in (0, 50, 100, 500):
        scores = [(-min(max(sum(a * b for a, b in zip(whole[q], v)), -limit), limit), c) for c, v in whole.items() if c != q]
        assert got[q] == [(c, -s) for s, c in sorted(scores)[:5]]


def test_topk_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [None, 1.0]), (4, [-1.0, 0.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted(rows_of(topk.top_inner_products(df), "query_id", "rank", "vec_id", "score"))
    s = 256 * 256 * 5
    assert got == [(0, 1, 5, s), (0, 2, 50, s), (0, 3, 4, -65536), (50, 1, 0, s), (50, 2, 5, s), (50, 3, 4, -65536)]
    assert topk.top_inner_products(df.filter("false")).count() == 0


def brute_components(texts, n, percent):
    sets = {}
    for k, t in texts.items():
        w = words(t)
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {k: k for k in sets}
    find = lambda k: k if root[k] == k else find(root[k])
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_jaccard(spark, n, percent):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    texts = {0: None, 1: "", 2: "a b", 3: "A  b", 4: " ".join(base)}
    for i in range(5, 60):  # copies around a hub, most of them too far from each other
        w = list(base)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(8)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {k: (s, c) for k, s, c in rows_of(jaccard.similarity_components(df, n=n, percent=percent), "doc_id", "n_shingles", "component_id")}
    assert got == brute_components(texts, n, percent)


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_jaccard_lone_pairs_and_triples(spark, n, percent):
    """Isolated pairs and version triples near the threshold, whose common shingles have now one member, now the other as pivot."""
    rnd = random.Random(11)
    edit = lambda w, k: [f"n{rnd.randrange(10**6)}" if i in at else x for at in [set(rnd.sample(range(len(w)), k))] for i, x in enumerate(w)]
    texts = {}
    for group in range(240):
        base = [f"w{rnd.randrange(20000)}" for _ in range(rnd.randrange(60, 140))]
        for _ in range(2 + group % 2):
            texts[len(texts)] = " ".join(edit(base, rnd.randrange(4)))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {k: (s, c) for k, s, c in rows_of(jaccard.similarity_components(df, n=n, percent=percent), "doc_id", "n_shingles", "component_id")}
    assert got == brute_components(texts, n, percent)


def test_jaccard_edges(spark, odd):
    assert jaccard.similarity_components(odd).count() == odd.count()
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    texts = [r["text"] for r in kept.collect() if (r["text"] or "").strip()]
    assert len(texts) == len(set(texts))


def test_empty_tables(spark, odd):
    none = odd.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, FOLDER).count() == 0
    assert licenses.scan(none).count() == sentencepieces.encode(none, SPM).count() == suffixes.find(none).count() == 0
    assert jaccard.similarity_components(none).count() == quality.verdicts(none).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, save(stage(spark, docs, FOLDER), "stage")
        assert docs.columns == before.columns and 0.5 * before.count() < docs.count() <= before.count(), name
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    components = brute_components(texts, 5, 80)
    assert all(c == k or not n for k, (n, c) in components.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r["doc_id"] for r in packed.collect()} == set(texts)
