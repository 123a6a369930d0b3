"""Importance resampling, BPE and fill-in-middle against their definitions, the library and exact round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import bpe, infilling, resampling
from lodestone.llm.encoding import vocabulary

DOC = "doc_id long, text string, lang string, source string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))
PATH = vocabulary("byte_bpe_50k.json")
SCRAPS = ["a", "b", "the ", " ", "  ", "\n", "\t", "\x0b", "'s", "'ll", "I'm", "é", "É", "你好", "🙂", "1", "23", "٣", "\x85", "\xa0", "\x1c", "͸", "Ᲊ", "\U0001e5f8", "<|endoftext|>", "<|endof", "ab" * 20, "!", "...", "_", "́", "<P>", "<S", "<M>", ">", "<"]


def scraps(seed, n, most=40):
    r = random.Random(seed)
    return ["".join(r.choice(SCRAPS) for _ in range(r.randint(0, most))) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k % 2}") for k, (i, t) in enumerate(rows)], DOC)


ODD = [(1, LONG), (1, LONG), (None, "no id " * 9), (None, None), (2, ""), (3, " \n "), (4, "one"), (5, "a <P> b c d e"), (6, "É é A a"), (6, "other text of this id")]


# --- 11 ------------------------------------------------------------------------------------------
def runs(text, n):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(ws), [" ".join(ws[i : i + k]) for i in range(len(ws)) for k in range(1, n + 1) if i + k <= len(ws)]


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_the_ring_gives_the_crc_of_every_run(n):
    for text in [None, *scraps(n, 300)]:
        words, want = runs(text, n)
        got = resampling.feature_crcs(text, n)
        assert got[0] == words and sorted(got[1]) == sorted(zlib.crc32(x.encode()) for x in want)


def by_definition(docs, wanted, n, size, seed, percent, least):
    bucket = lambda x: zlib.crc32(x.encode()) % size
    s = Counter(bucket(x) for _, t in docs for x in runs(t, n)[1])
    t = Counter(bucket(x) for text in wanted for x in runs(text, n)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + size) / ((s[b] + 1) * (all_t + size)))) for b in range(size)]
    out = []
    for i, text in docs:
        words, found = runs(text, n)
        w = math.floor(sum(gain[bucket(x)] for x in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, len(found), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = Counter((r, k + 1) for k, r in enumerate(able[: percent * len(able) // 100]))
    return out, drawn


@pytest.mark.parametrize(("n", "size", "percent"), [(1, 10_000, 10), (2, 97, 50), (3, 70_000, 100)])
def test_resampling_equals_its_definition(spark, n, size, percent):
    r = random.Random(size)
    docs = [(i, " ".join(r.choice(["Quiz", "answer", "filler", "noise", "été", "42"]) for _ in range(r.randint(0, 30)))) for i in range(120)]
    wanted = ["quiz answer " * 9, None, "answer 42"]
    got = resampling.importance_resample(table(spark, docs), spark.createDataFrame(list(enumerate(wanted)), "item_id long, text string"), n, size, "7", percent, 5).collect()
    rows, drawn = by_definition(docs, wanted, n, size, "7", percent, 5)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == Counter(rows)
    assert Counter(((r.doc_id, r.n_words, r.n_features, r.weight, r.score), r.rank) for r in got if r.rank) == drawn


def test_resampling_of_odd_tables(spark):
    items = spark.createDataFrame([(1, "one text"), (1, "one text"), (None, None)], "item_id long, text string")
    d = table(spark, ODD).withColumnRenamed("lang", "codes").withColumnRenamed("source", "rank")
    got = resampling.importance_resample(d, items, percent=100, min_words=1)
    rows, drawn = by_definition(ODD, ["one text", "one text"], 1, 10_000, "2024", 100, 1)
    held = got.collect()
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in held) == Counter(rows)
    assert sorted(r.rank for r in held if r.rank) == list(range(1, sum(drawn.values()) + 1))
    ranked = sorted((r for r in held if r.rank), key=lambda r: r.rank)
    assert [r.score for r in ranked] == sorted((r.score for r in ranked), reverse=True)
    assert resampling.drawn_documents(d, got).count() == len(ranked) + sum(1 for i, t in ODD if i in (None,) and not t)
    assert resampling.importance_resample(d.limit(0), items).count() == 0
    assert {r.weight for r in resampling.importance_resample(d, items.limit(0)).collect() if not r.n_features} == {0}


# --- 12 ------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_and_texts_equal_the_library(library):
    own = bpe.Bpe(PATH, most=50)
    for text in [*scraps(1, 3000), LONG, "ab" * 20_000, "x" * 5000 + " " * 5000]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    r = random.Random(2)
    for _ in range(1000):
        ids = [r.randrange(50_400) for _ in range(r.randint(0, 6))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_merges_of_any_bytes_equal_the_rule_that_scans_for_the_least_rank():
    own = bpe.Bpe(PATH)
    r = random.Random(3)
    for _ in range(500):
        symbols = [own._byte_ids[r.choice(b"aabehinrt sou")] for _ in range(r.randint(0, 30))]
        want = list(symbols)
        while found := [(m, i) for i, (a, b) in enumerate(zip(want, want[1:])) if (m := own._ranks.get(a << own._shift | b)) is not None]:
            rank, i = min(found)
            want[i : i + 2] = [own._made[rank]]
        assert own.merged(symbols) == want


def test_every_vocabulary_that_is_not_byte_level_is_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Bpe(vocabulary("word_bpe_49k.json"))


def test_encoding_of_odd_tables(spark, library):
    rows = [*ODD, (7, "x <|endoftext|> y"), (8, "Ᲊ ͸")]
    d = table(spark, rows).withColumnRenamed("lang", "ids").withColumnRenamed("source", "n")
    got = bpe.encoded(d, PATH, most_bytes=4000)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    back = bpe.decoded(got.withColumnRenamed("doc_id", "text 2").selectExpr("ids", "`text 2`", "'x' AS n"), PATH)
    assert back.columns == ["text 2", "n", "text"] and Counter((r[0], r[2]) for r in back.collect()) == Counter((i, t or "") for i, t in rows)
    assert bpe.encoded(d.limit(0), PATH).count() == 0
    lists = spark.createDataFrame([(1, None), (2, [64, None, -1, 99_999, 65]), (3, [])], "k long, ids array<int>")
    assert {r.k: r.text for r in bpe.decoded(lists, PATH).collect()} == {1: "", 2: library.decode([64, 65]), 3: ""}


# --- 13 ------------------------------------------------------------------------------------------
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def infilled(doc_id, text, percent=50, spm=80):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    us = UNITS.findall(text)
    a, b = sorted((h1 % (len(us) + 1), h2 % (len(us) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return doc_id, len(us), "plain", None, None, text
    pre, mid, suf = "".join(us[:a]), "".join(us[a:b]), "".join(us[b:])
    if h4 % 100 < spm:
        return doc_id, len(us), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(us), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_ends_of_units_and_ranked_bits():
    for text in [*scraps(5, 3000), LONG, " ", "a", "\n" * 1000, "é" * 1000]:
        us = UNITS.findall(text)
        bits = infilling.unit_ends(text)
        assert bits.bit_count() == len(us)
        at = 0
        for r, u in list(enumerate(us, 1))[:200]:
            at += len(u)
            assert infilling.ranked_bit(bits, len(text), r) == at


@pytest.mark.parametrize(("percent", "spm"), [(50, 80), (100, 50), (0, 0)])
def test_infilling_equals_its_definition_and_is_undone(spark, percent, spm):
    from pyspark.sql import functions as F

    rows = [*ODD, *((100 + i, t) for i, t in enumerate(scraps(6, 400)))]
    d = table(spark, rows).withColumnRenamed("lang", "form").withColumnRenamed("source", "output")
    got = infilling.fill_in_middle(d, percent=percent, spm_percent=spm)
    assert Counter(tuple(r) for r in got.collect()) == Counter(infilled(i, t, percent, spm) for i, t in rows)
    back = got.select("doc_id", infilling.restored(F.col("output"), F.col("form")).alias("t"))
    assert Counter(tuple(r) for r in back.collect()) == Counter((i, t or "") for i, t in rows)
    assert infilling.fill_in_middle(d.limit(0)).count() == 0


def test_marks_that_could_be_misread_are_refused():
    for marks in (("<P>", "<P>>", "<M>"), ("aa", "<S>", "<M>"), ("<P>", "<S>", "><P"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError, match="overlap"):
            infilling._checked(marks)
