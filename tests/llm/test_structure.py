"""Turn repair, periodic runs and token counts against plain Python on whole tables and odd ones."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest

from pairloom.llm import periodic, tokencounts, turnrepair
from pairloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = public_tokenizers.path("byte_bpe_50k.json")


# -- turn repair ---------------------------------------------------------------------------
STEPS = {"0": {"s": "1", "u": "2"}, "1": {"u": "2"}, "2": {"a": "3"}, "3": {"u": "2"}}


def cheapest(rows):
    """(cost, audit) of rows (initial, truncated, must go), over a hand-made automaton."""
    def fill(front):
        for _ in range(4):
            for q, (c, a) in list(front.items()):
                for x in "ua":
                    if x in STEPS[q]:
                        t, v = STEPS[q][x], (c + 2, a + "I")
                        front[t] = min(front.get(t, v), v)
        return front

    front = {"0": (0, "")}
    for first, truncated, gone in rows:
        after = {q: (c + 3, a + "D") for q, (c, a) in front.items()}
        for q, (c, a) in fill(dict(front)).items() if not gone else ():
            for x, edit, price in ((first, "K", 0), ("u", "R", 2), ("a", "R", 2)):
                if x in STEPS[q]:
                    t, v = STEPS[q][x], (c + price + truncated, a + edit)
                    after[t] = min(after.get(t, v), v)
        front = after
    return min(v for q, v in fill(front).items() if q in "03")


def by_hand(turns):
    """What the query returns, from a list of (conv_id, turn, role, text)."""
    show = lambda v: " " if v is None else str(v)
    groups = {r[0]: [] for r in turns}
    for conv, turn, role, text in turns:
        h = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", show(text)) if h == 2 else show(text)
        groups[conv] += [(turn, "user" if h == 4 else show(role), text)] * ((h != 0) + (h == 3))
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        count, seen, coded = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in rows:
            visible = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None
            seen.add((role, text))
            count[fault] = count.get(fault, 0) + 1
            coded.append((role[:1], fault == "truncated", fault in ("blank", "duplicate")))
        cost, audit = cheapest(coded)
        size, at, kept = len(audit) - audit.count("D"), iter(rows), []
        for edit in audit:
            row = None if edit == "I" else next(at)
            if edit != "D":
                role = row[1] if edit == "K" else ("assistant" if (len(kept) - size % 2) % 2 else "user")
                kept.append(f"{role}:{row[2] if row else ''}")
        given = {r[0] for r in rows if r[0] is not None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:]))
        gaps = max(given) - min(given) + 1 - len(given) if given else 0
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def result(df):
    rows = [r.asDict() for r in df.collect()]
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[n] for n in NAMES) for r in rows}


def test_repair_of_the_table(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op11_conversation_repair"](spark, FOLDER)) == by_hand(turns)


@pytest.fixture(scope="module")
def odd_turns():
    rnd = random.Random(4)
    rows = [(None, None, None, None), (None, 1, "user", "Yes."), (1, None, "user", "No"), (2, 5, "", "x."), (3, 1, "tool", "y!"), (3, 9, "system", "   \n"), (4, 1, "user", "a." * 70_000)]
    for conv in range(10, 60):
        n = rnd.randrange(1, 60 if conv < 20 else 9)
        rows += [(conv, t + 3 * (rnd.random() < 0.1), rnd.choice(["user", "assistant", "system", "bot"]), rnd.choice(["Hi.", "Go on", "", "Why?\n", f"t{t}."])) for t in range(n)]
    return rows + rows[8:30] + [rows[3]] * 9


@pytest.mark.parametrize("chunk,fan", [(4096, 64), (3, 2)])
def test_repair_edges(spark, odd_turns, chunk, fan, monkeypatch):
    monkeypatch.setattr(turnrepair.repair, "__defaults__", (*turnrepair.repair.__defaults__[:4], chunk, fan))
    schema = "conv_id bigint, turn bigint, role string, text string, conv string, row int, seq int, h string, digest int"
    turns = spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in odd_turns], schema)
    assert result(turnrepair.report(turns)) == by_hand(odd_turns)


def test_repair_of_an_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert turnrepair.report(turns).count() == 0


def test_stacks_are_few_and_parsing_is_associative():
    assert len(turnrepair.STACKS) == 8
    rnd = random.Random(2)
    for _ in range(300):
        rows = "".join(rnd.choice("suasuaUAS0312xX") for _ in range(12))
        whole = turnrepair.parse(rows, None, turnrepair.BOTTOM)
        cut, joined = rnd.randrange(13), {}
        for s, (c, a) in turnrepair.parse(rows[:cut], None, turnrepair.BOTTOM).items():
            for t, (d, b) in turnrepair.parse(rows[cut:], None, s).items():
                turnrepair.take(joined, t, c + d, a + b)
        assert whole == joined


# -- periodic runs -------------------------------------------------------------------------
def runs_by_hand(words):
    out, seen = [], set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out)


def digest_by_hand(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = runs_by_hand(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    milli = best[1] and 1000 * best[1] // best[2]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


RUN_NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def rows_of(df, names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_runs_of_the_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(QUERIES["op12_periodic_runs"](spark, FOLDER), RUN_NAMES) == sorted((digest_by_hand(*r) for r in docs), key=repr)


def test_runs_edges(spark):
    rnd = random.Random(7)
    texts = [None, "", " \n\t", "a " * 5, "a " * 6, "a b " * 4, "x\x0by z " * 9, "a a a a a a b " * 5, "  é 日本 " * 20, "q " * 30_000]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(200))) + " end " + "a b c d " * rnd.randrange(9) for _ in range(60)]
    rows = [(None if i == 7 else i, t, "x", 1, 2) for i, t in enumerate(texts)] + [(15, texts[15], "x", 1, 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, words string, n int, id int")
    got = rows_of(periodic.digests(periodic.planted(docs)), RUN_NAMES)
    assert got == sorted((digest_by_hand(r[0], r[1]) for r in rows), key=repr)
    assert periodic.digests(periodic.planted(docs.limit(0))).count() == 0


def test_runs_by_hand_on_random_words():
    rnd = random.Random(5)
    for _ in range(300):
        docs = []
        for _ in range(rnd.randrange(1, 4)):
            base = [rnd.randrange(4) for _ in range(rnd.randrange(1, 7))]
            docs.append([rnd.randrange(3) for _ in range(rnd.randrange(9))] + (base * 12)[: rnd.randrange(60)] * rnd.randrange(1, 5))
        ids, owner = np.array(sum(docs, []), np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        want, at = [], 0
        for d in docs:
            want += [(s + at, n, q) for s, n, q in runs_by_hand(d)]
            at += len(d)
        assert periodic.find_runs(ids, owner) == want


def test_runs_with_equal_hashes_are_compared(monkeypatch):
    """Where all hashes are equal the words decide: nothing that is no run is returned."""
    monkeypatch.setattr(periodic, "mix", lambda x: x * np.uint64(0))
    ids = np.array([i % 3 * (i % 7) for i in range(200)], np.int64)
    got = periodic.find_runs(ids, np.zeros(200, np.int64))
    assert set(got) <= set(runs_by_hand(ids.tolist()))


# -- token counts --------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def by_library(tokenizer, texts):
    return [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_of_the_table(spark, tokenizer):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op13_token_counts"](spark, FOLDER).collect()}
    counts = by_library(tokenizer, [r["text"] for r in docs])
    assert got == {r["doc_id"]: (len((r["text"] or "").encode()), n, n > 512) for r, n in zip(docs, counts)}


def test_counts_edges(spark, tokenizer):
    rnd = random.Random(1)
    letters = [*"aaabcdeé日本 \n\t'strevlmd0123   ²½  \x1c\x85", "<|endoftext|>", "'ll", "'re"]
    texts = [None, "", " ", "a" * 5000, "日本語" * 5000, " " * 999, "<|endoftext|>" * 3, "x'" * 9, ("word " * 9 + "\n") * 30_000]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(300))) for _ in range(500)]
    rows = [(None if i == 3 else i, t, "x", 1) for i, t in enumerate(texts)] + [(5, texts[5], "x", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, id string, n_tokens int")
    got = rows_of(tokencounts.count_tokens(docs, BPE), ("doc_id", "n_bytes", "n_tokens"))
    counts = by_library(tokenizer, [r[1] for r in rows])
    assert got == sorted(((r[0], len((r[1] or "").encode()), n) for r, n in zip(rows, counts)), key=repr)
    assert tokencounts.count_tokens(docs.limit(0), BPE).count() == 0


def test_counts_with_small_runs_and_memory(tokenizer, monkeypatch):
    monkeypatch.setattr(tokencounts, "RUN", 50)
    monkeypatch.setattr(tokencounts, "KNOWN", 20)
    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choice("etaoin'1 \n") for _ in range(rnd.randrange(9))) for _ in range(60)) for _ in range(50)]
    assert tokencounts.Counts(tokencounts.loaded(BPE)).of(texts) == by_library(tokenizer, texts)


def test_every_code_point_has_the_librarys_kind(tokenizer):
    marks = [chr(i) for i in range(0x3400) if not 0xD800 <= i < 0xE000] + [chr(i) for i in range(0x3400, 0x110000, 61) if not 0xD800 <= i < 0xE000]
    texts = [f"a{x}b {x} 1{x}\n{x}{x} " for x in marks]
    assert tokencounts.Counts(tokencounts.loaded(BPE)).of(texts) == by_library(tokenizer, texts)
