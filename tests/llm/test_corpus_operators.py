"""Operators of lodestone.llm against brute force, on small tables with nulls, ties and odd texts."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import chat_format, decontamination, encoding, graph, line_dedup, line_rules, packing, set_join, substring_dedup, token_rollup, token_store, toxicity
from lodestone.llm.common import WORD, words
from lodestone.llm.fm_index import FMIndex, least_in

DOC = "doc_id long, text string, lang string, source string"


def corpus(seed=0, n=60):
    """Texts with copies, near copies, shared lines, periodic and odd cases."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(80)] + ["Été", "你好", "🙂x", "a b", "A", "a"]
    line = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    common = line(25)
    out = [(0, None), (1, ""), (2, "one two"), (3, " \n\t "), (4, "a b " * 40), (5, "\n".join([common] * 3))]
    for i in range(6, n):
        kind = r.random()
        if kind < 0.25 and len(out) > 8:
            t = r.choice(out[6:] or out)[1] or ""
        elif kind < 0.5 and len(out) > 8:
            ws = (r.choice(out[6:])[1] or "").split(" ")
            ws[r.randrange(len(ws))] = r.choice(vocab)
            t = " ".join(ws)
        else:
            t = "\n".join(line(r.randint(1, 40)) for _ in range(r.randint(1, 4)))
            if r.random() < 0.3:
                t += "\n" + common + "\n" + line(5)
        out.append((i, t))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 2}" if i % 7 else None) for i, t in corpus()]
    return spark.createDataFrame(rows, DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


# --- 1 -------------------------------------------------------------------------------------------
def test_base_counts_follow_their_definition():
    for _, text in corpus(1):
        t = text or ""
        ws = WORD.findall(t)
        n, chars, symbols, dup, rep = line_rules.base_counts(text)
        win = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
        c = Counter(win)
        marked = {i + k for i, w in enumerate(win) if c[w] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (n, chars, symbols, dup, rep) == (len(ws), sum(map(len, ws)), sum(x in line_rules.SYMBOLS for x in t), len(lines) - len(set(lines)), len(marked))


def test_line_rules_count_documents_per_host(spark, docs):
    got = {r.doc_id: r for r in line_rules.line_frequency_rules(docs, max_docs=3).collect()}
    rows = [(r.doc_id, r.text or "", r.source) for r in docs.collect()]
    freq = Counter((s, h) for _, t, s in rows for h in {line_rules.line_hash(x) for x in t.split("\n") if words(x)})
    for i, t, s in rows:
        gone = sum(len(words(x)) for x in t.split("\n") if words(x) and freq[(s, line_rules.line_hash(x))] > 3)
        assert got[i].removed_words == gone
    assert line_rules.line_frequency_rules(empty(spark)).count() == 0
    clean = {r.doc_id: r.text for r in line_rules.cleaned(docs, line_rules.line_frequency_rules(docs, max_docs=3)).collect()}
    assert all(len(words(clean[i])) == len(words(t)) - got[i].removed_words for i, t, _ in rows if i in clean)


def test_line_rules_keep_null_ids_and_repeated_rows(spark):
    d = spark.createDataFrame([(None, "a b c", "en", None), (1, "x y " * 8, "en", "s"), (1, "x y " * 8, "en", "s")], DOC)
    assert line_rules.line_frequency_rules(d).count() == 3


# --- 2 -------------------------------------------------------------------------------------------
def windows_removed(rows, k):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        ws, gone = words(t), set()
        for j in range(len(ws) - k + 1):
            w = tuple(ws[j : j + k])
            if w in seen:
                gone |= set(range(j, j + k))
            else:
                seen[w] = True
        out[i] = [w for j, w in enumerate(ws) if j not in gone]
    return out


@pytest.mark.parametrize("most", [2000, 1])
def test_substring_dedup_equals_brute_force(spark, docs, most):
    got = {r.doc_id: words(r.text) for r in substring_dedup.dedup_substrings(docs, k=20, most_segments=most, shard_segments=7).collect()}
    want = windows_removed([(r.doc_id, r.text) for r in docs.collect()], 20)
    assert got == want


def test_substring_dedup_on_empty_table(spark):
    assert substring_dedup.dedup_substrings(empty(spark)).count() == 0


def test_substring_dedup_tells_rows_apart(spark):
    ws = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    rows = [(1, ws("a", 30), "en", "s"), (5, ws("b", 40), "en", "s"), (5, ws("a", 30) + " " + ws("c", 10), "en", "s"), (None, ws("d", 25), "en", "s"), (None, ws("e", 5) + " " + ws("d", 25), "en", "s"), (7, ws("b", 40), "en", "s"), (5, ws("b", 40), "en", "s")]
    d = spark.createDataFrame(rows, DOC).withColumnRenamed("lang", "at").withColumnRenamed("source", "row")
    out = substring_dedup.dedup_substrings(d)
    assert out.columns == d.columns
    got = sorted((str(r.doc_id), r.text) for r in out.collect())
    nulls = [t for i, t in got if i == "None"]
    assert sorted(nulls) in (sorted([ws("d", 25), ws("e", 5)]), sorted(["", ws("e", 5) + " " + ws("d", 25)]))
    assert [x for x in got if x[0] != "None"] == sorted([("1", ws("a", 30)), ("5", ws("b", 40)), ("5", ws("b", 40)), ("5", ws("c", 10)), ("7", "")])


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics_find_all_repeats_alone(seed):
    r = random.Random(seed)
    k, texts = 4, []
    for _ in range(25):
        t = [r.choice("abcde") for _ in range(r.randint(1, 14))]
        texts.append(r.choice(texts) if texts and r.random() < 0.2 else t)
    doc, at = np.array([r.randrange(12) for _ in texts]), np.array([r.randrange(1000) for _ in texts])
    found = substring_dedup.repeated(doc, at, texts, k)
    where = {}
    for i, t in enumerate(texts):
        for n in range(k, len(t) + 1):
            for j in range(len(t) - n + 1):
                where.setdefault(tuple(t[j : j + n]), []).append((doc[i], at[i] + j))
    longest = {}
    for i, t in enumerate(texts):
        for e in range(len(t)):
            for n in range(k, e + 2):
                j = e - n + 1
                if min(where[tuple(t[j : e + 1])]) < (doc[i], at[i] + j):
                    longest[i, e] = n
    want = {(i, e - n + 1, n) for (i, e), n in longest.items() if longest.get((i, e + 1)) != n + 1}
    assert set(found) == want and len(found) == len(want)


def test_fm_index_intervals_count_occurrences():
    r = np.random.default_rng(0)
    text = np.concatenate([[0], r.integers(1, 4, 300)])
    index = FMIndex(text, 6, np.arange(len(text)))
    pats = np.stack([text[i : i + 6] for i in range(1, 290)])
    lo, hi = index.search(pats)
    for p, a, b in zip(pats, lo, hi, strict=True):
        at = [i for i in range(len(text) - 5) if (text[i : i + 6] == p).all()]
        assert sorted(index.place[a:b]) == at
    assert (least_in(index.place, lo, hi) == [index.place[a:b].min() for a, b in zip(lo, hi, strict=True)]).all()


# --- 3, 7 ----------------------------------------------------------------------------------------
@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_the_library(name, spaces):
    e = encoding.Encoder(encoding.vocabulary(name), spaces, most=200)
    r = random.Random(5)
    chars = list(" \n\t\r\x0b  aAé́ßΣσ1٣'s#*你🙂</>|.,") + ["<|endoftext|>", "'ll", "\u0085", "\x1c", "İ", "\n\n", " \n", "Word", "word"]
    texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 12))) for _ in range(4000)] + [t or "" for _, t in corpus()]
    for i in range(0, len(texts), 50):
        assert e.many(texts[i : i + 50]) == [e.whole(t) for t in texts[i : i + 50]]


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 5000)).astype(np.int64)
    h = token_store.PerfectHash.build(keys.view(np.uint64))
    assert sorted(h.slots(keys.view(np.uint64))) == list(range(len(keys)))


@pytest.mark.parametrize("pushed", [5000, 0])
def test_token_store_round_trip_and_lookup(spark, docs, tmp_path, pushed):
    from pyspark.sql import functions as F

    extra = spark.createDataFrame([(9, "again", "en", "s"), (9, "again", "en", "s"), (None, "no id", "en", "s")] + [(None, "x " * 90 + str(i), "en", "s") for i in range(12)], DOC)
    d = docs.unionByName(extra)
    path = f"file://{tmp_path}/store"
    vocab = encoding.vocabulary("byte_bpe_50k.json")
    token_store.write_store(d.withColumnRenamed("lang", "part").withColumnRenamed("source", "shard"), path, vocab, 2, shard_tokens=300)
    e = encoding.Encoder(vocab, True)
    rows = d.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h, r.text or ""))
    at, want, stored = 0, [], Counter()
    for r in rows:
        ids = [*np.frombuffer(e.whole(r.text or ""), e.dtype).tolist(), 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        stored[r.doc_id, tuple(ids)] += 1
        at += len(ids)
    got = [tuple(r) for r in token_store.read_documents(spark, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert spark.read.parquet(path).where(f"first_key = {token_store.NULL_KEY}").count() > 1  # one key, several shards
    ask = spark.createDataFrame([(9,), (4,), (123456,), (None,), (9,)], "doc_id long")
    found = Counter((r.doc_id, tuple(r.ids)) for r in token_store.lookup(spark, path, ask, pushed).collect())
    assert found == Counter({k: n for k, n in stored.items() if k[0] in (9, 4, None)})
    assert token_store.lookup(spark, path, ask.where("doc_id = 123456"), pushed).count() == 0


def test_token_store_of_an_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(empty(spark), path, encoding.vocabulary("byte_bpe_50k.json"), 2)
    assert token_store.read_documents(spark, path).count() == 0
    assert token_store.lookup(spark, path, spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_packing_covers_every_id_once_without_padding(spark, docs):
    vocab = encoding.vocabulary("word_bpe_49k.json")
    rows = packing.pack(docs, vocab, most=64).collect()
    e = encoding.Encoder(vocab, False)
    by, seq = {}, Counter()
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, e.dtype).tolist()))
        seq[r.sequence_id] += r.length
    for x in docs.collect():
        ids = [*np.frombuffer(e.whole(x.text or ""), e.dtype).tolist(), 1]
        assert sum((p for _, p in sorted(by[x.doc_id])), []) == ids
    assert all(n <= 64 and n & (n - 1) == 0 for n in seq.values())
    assert packing.pack(empty(spark), vocab).count() == 0


def test_hilbert_neighbours_touch():
    import itertools

    p = np.array(list(itertools.product(range(8), repeat=3)))
    h = packing.hilbert(p, 3)
    assert sorted(h) == list(range(512))
    assert (np.abs(np.diff(p[np.argsort(h)], axis=0)).sum(1) == 1).all()


# --- 4 -------------------------------------------------------------------------------------------
def test_rollup_is_idempotent_and_compacts(spark, docs, tmp_path):
    r = token_rollup.Rollup(spark, f"file://{tmp_path}/roll")
    assert r.totals().count() == 0
    one = token_rollup.counted(docs, "words@1")
    assert r.apply(1, token_rollup.inserts(one)) and not r.apply(1, token_rollup.inserts(one))
    r.apply(2, token_rollup.deletes(one.where("source = 's1'")))
    r.apply(3, token_rollup.revisions(one.where("source = 's0'"), token_rollup.counted(docs.where("source = 's0'"), "pieces@2")))
    get = lambda: {(x.source, x.tokenizer): (x.n_docs, x.n_tokens) for x in r.totals().collect()}
    before = get()
    texts = [(x.source, x.text) for x in docs.collect()]
    assert before[(None, "words@1")] == (sum(s is None for s, _ in texts), sum(len(words(t)) for s, t in texts if s is None))
    assert before[("s1", "words@1")] == (0, 0) and before[("s0", "words@1")] == (0, 0)
    r.apply(4, token_rollup.inserts(one.limit(0)))
    r.compact()
    assert get() == before and r.committed() == {1, 2, 3, 4}
    # batches delivered again after a compaction, and one that is new
    assert not r.apply(1, token_rollup.inserts(one)) and not r.apply(3, token_rollup.inserts(one)) and get() == before
    assert r.apply(5, token_rollup.inserts(one.where("source = 's1'")))
    n = get()[("s1", "words@1")]
    assert n == (sum(s == "s1" for s, _ in texts), sum(len(words(t)) for s, t in texts if s == "s1"))
    r.compact()
    assert get()[("s1", "words@1")] == n and not r.apply(5, token_rollup.inserts(one)) and r.committed() == {1, 2, 3, 4, 5}


def test_rollup_survives_a_compaction_that_dies(spark, docs, tmp_path):
    r = token_rollup.Rollup(spark, f"file://{tmp_path}/roll")
    one = token_rollup.inserts(token_rollup.counted(docs, "words@1"))
    assert r.apply(1, one) and r.apply(2, one.limit(0))
    total = lambda: sorted((str(x.source), x.n_docs, x.n_tokens) for x in r.totals().collect())
    before = total()

    class Died(Exception):
        pass

    def die(*_):
        raise Died

    class Files:
        def __init__(self, fs, **instead):
            self.fs, self.instead = fs, instead

        def __getattr__(self, name):
            return self.instead.get(name) or getattr(self.fs, name)

    whole = r._fs
    for method in ("rename", "delete"):  # before the new marker, and before the old ones go
        r._fs = Files(whole, **{method: die})
        with pytest.raises(Died):
            r.compact()
        r._fs = whole
        assert total() == before and r.committed() == {1, 2} and not r.apply(1, one)
    r.compact()
    assert total() == before and r.committed() == {1, 2}


def test_rollup_texts_by_group_counts_rows_before_the_join(spark):
    rows = [(None, "a b", None, "s"), (3, "a b", "en", "s"), (3, "a b", "en", "s"), (1, "x #", "en", "t"), (2, None, "en", "t")]
    got = sorted((x.lang or "", x.source, x.copies, x.old, x.new, x.lead) for x in token_rollup.texts_by_group(spark.createDataFrame([(i, t, g, s) for i, t, g, s in rows], DOC)).collect())
    assert got == [("", "s", 1, 2, None, True), ("en", "s", 2, 2, None, False), ("en", "t", 1, 2, 2, True)]


# --- 5 -------------------------------------------------------------------------------------------
TOXIC = ["idiot", "moron", "scum", "clown", "idiotic"]
FILLER = ["fine", "day", "sun", "sunny", "river", "stone", "walks", "walking", "tree", "house", "garden", "bread"]


def labelled(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        y = int(r.random() < 0.3)
        ws = [r.choice(FILLER) + r.choice(["", "", r.choice("abcdefgh")]) for _ in range(r.randint(0, 12))]
        ws += [r.choice(TOXIC) for _ in range(r.randint(1, 3))] * y
        r.shuffle(ws)
        out.append((i, " ".join(ws), y))
    return out


def names(text):
    import re

    return Counter(x for w in re.findall(r"[^\W\d_]+", text.lower()) for x in ["=" + w, *(w[:k] for k in (4, 6) if len(w) > k)])


def brute_model(rows):
    """Scores by definition: TF-IDF vectors as dictionaries, all cosines, vote, monotone fit by max-min."""
    n, bags, ys = len(rows), [names(t) for _, t, _ in rows], [y for *_, y in rows]
    df = Counter(x for b in bags for x in b)
    tox = Counter(x for b, y in zip(bags, ys) for x in b if y)
    weight = {x: np.log((1 + n) / (1 + d)) * np.log2(2 + tox[x] / max(1, d - tox[x])) for x, d in df.items() if d >= 2}

    def vec(bag):
        v = {x: (1 + np.log(c)) * weight[x] for x, c in bag.items() if x in weight}
        norm = np.sqrt(sum(w * w for w in v.values()))
        return {x: w / norm for x, w in v.items()} if norm else {}

    vs, prior = [vec(b) for b in bags], sum(ys) / n

    def near(v, without=-1):
        cos = [(sum(w * u.get(x, 0) for x, w in v.items()), i) for i, u in enumerate(vs) if i != without]
        return sorted((c for c in cos if c[0] > 1e-9), reverse=True)[:5]

    vote = lambda nn: (sum(c * ys[i] for c, i in nn) + prior * 0.1) / (sum(c for c, _ in nn) + 0.1)
    loo = [near(v, i) for i, v in enumerate(vs)]
    pairs = sorted((vote(nn), y) for nn, y in zip(loo, ys) if nn)
    bare = [y for nn, y in zip(loo, ys) if not nn]
    fit = [max(min(np.mean([y for _, y in pairs[a : c + 1]]) for c in range(i, len(pairs))) for a in range(i + 1)) for i in range(len(pairs))]
    return vec, near, vote, pairs, fit, (sum(bare) + prior) / (len(bare) + 1)


def as_examples(rows):
    return [(i, *toxicity.terms(t), y) for i, t, y in rows]


def test_votes_and_neighbours_equal_brute_force():
    rows = labelled(2, 140)
    m = toxicity.Neighbours(as_examples(rows), k=5)
    vec, near, vote, *_ = brute_model(rows)
    assert m.n_blocks > 2
    for _, t, _ in labelled(3, 50):
        got, want = m.top(m.vector_of(t)), near(vec(names(t)))
        assert np.allclose([c for c, _ in got], [c for c, _ in want], atol=1e-5)
        sure = {rows[i][0] for c, i in want if c > want[-1][0] + 1e-5}
        assert sure <= {int(m.doc_ids[i]) for _, i in got}
        if len({round(c, 4) for c, _ in want}) == len(want):  # without ties the votes are the same
            cos, at = m.top_many([m.vector_of(t)])[0]
            assert abs(m.vote(cos, at) - vote(want)) < 1e-4
        place, w = m.vector_of(t)
        exact = vec(names(t))
        assert {m.vocabulary[p] for p in place} == set(exact) and np.allclose(w, [exact[m.vocabulary[p]] for p in place])


def test_calibration_is_the_monotone_fit():
    r = random.Random(1)
    for _ in range(30):
        pairs = [(round(r.random(), 1), int(r.random() < 0.4)) for _ in range(r.randint(1, 25))]
        got = [y / n for _, y, n in toxicity.isotonic(pairs) for _ in range(n)]
        p = sorted(pairs)
        want = [max(min(np.mean([y for _, y in p[a : c + 1]]) for c in range(i, len(p))) for a in range(i + 1)) for i in range(len(p))]
        assert np.allclose(got, want)
    rows = labelled(4, 120)
    m = toxicity.Neighbours(as_examples(rows), k=5)
    *_, bare = brute_model(rows)
    assert abs(m.bare - bare) < 1e-9 and m.cut == sorted(m.cut) and m.rate[0] < 0.2 < 0.8 < m.rate[-1]


def test_blocks_that_cannot_matter_are_skipped():
    rows = labelled(5, 60 * toxicity.BLOCK)
    m = toxicity.Neighbours(as_examples(rows), k=5)
    asked = [t for _, t, _ in labelled(6, 50)]
    for t in asked:
        m.top(m.vector_of(t))
    assert m.scored < 0.5 * m.n_blocks * len(asked) and len(m.doc_ids) == len(rows)


def test_toxicity_separates_held_out_rows(spark):
    data = [(i, t, y) for i, t, y in labelled(7, 500)]
    rows = [(i, t, "en", "s") for i, t, _ in data] + [(1000, None, "en", "s"), (1001, "", "en", "s"), (None, "idiot", "en", "s"), (1, "other text", "en", "s")]
    d = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(1000, None), (None, 1), (2, data[2][2])], "doc_id long, toxic int")
    m = toxicity.fit(d, labels)
    assert len(m.doc_ids) == len({i for i, *_ in data if not toxicity.is_held_out(i)})
    got = {x.doc_id: x for x in toxicity.score_documents(d, m).collect() if x.doc_id != 1}
    held = [(i, y) for i, _, y in data if toxicity.is_held_out(i)]
    assert all((got[i].score >= 0.5) == bool(y) for i, y in held if i != 1)
    assert not {x.doc_id for r in got.values() for x in r.neighbours} & {i for i, _ in held}
    assert all(x.label == data[x.doc_id][2] for r in got.values() for x in r.neighbours)
    assert got[1000].score == got[1001].score < 0.5 and got[1000].neighbours == []
    kept = {x.doc_id for x in toxicity.without_toxic(d.withColumnRenamed("lang", "score"), m).collect()}
    assert not kept & {i for i, y in held if y and i != 1} and {1000, 1001} <= kept
    none = toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.score("idiot") == 0.0
    assert toxicity.score_documents(empty(spark), m).count() == 0 and len(toxicity.fit(empty(spark), labels).doc_ids) == 0


def test_very_long_labelled_texts_are_bounded_on_the_driver(spark):
    long = " ".join("".join(chr(97 + (i * p) % 26) for p in (1, 3, 5, 7)) + chr(97 + i % 26) for i in range(20_000))
    d = spark.createDataFrame([(1, long, "en", "s"), (2, "idiot " * 5000, "en", "s"), (3, None, "en", "s")], DOC)
    got = toxicity.examples(d, spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, toxic int"), "toxic", 10, 50)
    assert all(len(t) <= 50 and len(t) == len(c) for _, t, c, _ in got) and {i for i, *_ in got} <= {1, 2, 3}


# --- 6 -------------------------------------------------------------------------------------------
def test_templates_round_trip_and_spans():
    r = random.Random(4)
    parts = ["###", "\\", "</turn>", "#", ":", "\n", "a", "### assistant:\n", "</turn>\n", "🙂"]
    for _ in range(300):
        turns = [("".join(r.choice(parts) for _ in range(r.randint(0, 3))) if r.random() < 0.2 else r.choice(["user", "assistant", ""]), "".join(r.choice(parts) for _ in range(r.randint(0, 6)))) for _ in range(r.randint(0, 5))]
        f = chat_format.formatted(turns)
        assert chat_format.parse(f["formatted"]) == turns
        assert not f["rewrites"]
        assert [chat_format.unescape(f["formatted"][a:b]) for a, b in f["loss"]] == [t for x, t in turns if x == "assistant"]


def test_rewriting_templates_are_found():
    last_marked = lambda m: "".join(f"[{x}{'*' if i == len(m) - 1 else ''}]{t}" for i, (x, t) in enumerate(m))
    f = chat_format.formatted([("user", "a"), ("assistant", "b"), ("user", "c")], last_marked)
    assert f["rewrites"] == [1, 2]


def test_conversations_with_nulls_and_ties(spark):
    t = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x"), (None, 0, "assistant", "y")], "conv_id long, turn long, role string, text string")
    got = {x.conv_id: chat_format.parse(x.formatted) for x in chat_format.format_chats(t).collect()}
    assert got == {1: [("user", ""), ("user", ""), ("", "x")], None: [("assistant", "y")]}


# --- 8 -------------------------------------------------------------------------------------------
def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def mutated(r, n, length):
    out = {"".join(r.choice("abcé🙂 ") for _ in range(length)) for _ in range(n)}
    for b in list(out):
        for _ in range(5):
            q = list(b)
            for _ in range(r.randint(1, 3)):
                j = r.randrange(len(q))
                r.choice([lambda: q.__setitem__(j, r.choice("abz")), lambda: q.__delitem__(j), lambda: q.insert(j, r.choice("aby"))])()
            out.add("".join(q))
    return sorted(out)


@pytest.mark.parametrize("k,block", [(1, 64), (2, 64), (3, 64), (2, 3)])
def test_edit_join_equals_brute_force(spark, k, block):
    from pyspark.sql import functions as F

    lines = mutated(random.Random(6), 20, 26)
    df = spark.createDataFrame(list(enumerate(lines)), "place long, line string").withColumn("place", F.col("place").cast("decimal(38,0)"))
    got = {int(x.place) for x in line_dedup.late_lines(df, k, block).collect()}
    want = {j for j in range(len(lines)) if any(abs(len(lines[i]) - len(lines[j])) <= k and edits(lines[i], lines[j]) <= k for i in range(j))}
    assert got == want


def test_bands_equal_edit_distance(spark):
    from pyspark.sql import functions as F

    lines = mutated(random.Random(8), 6, 22)
    pairs = [(a, b, edits(a, b) <= 2) for a in lines for b in lines]
    got = spark.createDataFrame(pairs, "a string, b string, near boolean").select("near", line_dedup.within(F.col("a"), F.col("b"), 2).alias("w")).collect()
    assert all(x.near == x.w for x in got)


def test_line_dedup_judges_lines_on_the_input(spark):
    r = random.Random(7)
    pool = [x.strip() for x in mutated(r, 8, 24)] + ["short", ""]
    rows = [(i, None if i == 3 else "\n".join(r.choice(pool) for _ in range(r.randint(1, 6))), "en", "s") for i in range(40)]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, DOC)).collect()}
    first = {}
    for i, t, *_ in rows:
        for n, x in enumerate((t or "").split("\n")):
            x = x.strip(" ")
            if x:
                first.setdefault(x, (i, n))
    long = [x for x in first if len(x) >= 20]
    late = {x for x in long for y in long if x != y and first[y] < first[x] and edits(x, y) <= 2}
    for i, t, *_ in rows:
        want = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not x.strip(" ") or (first[x.strip(" ")] == (i, n) and x.strip(" ") not in late))
        assert got[i] == want
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


# --- 9 -------------------------------------------------------------------------------------------
def test_banded_search_equals_brute_force():
    r = random.Random(3)
    for _ in range(150):
        p = decontamination.normal("".join(r.choice("abcd ") for _ in range(60)).strip().replace("  ", "x ")) or "abcabcabcabc"
        q = list(p)
        for _ in range(r.randint(0, 7)):
            j = r.randrange(len(q))
            r.choice([lambda: q.__setitem__(j, "e"), lambda: q.__delitem__(j), lambda: q.insert(j, "f")])()
        side = lambda: "".join(r.choice("abcd ") for _ in range(90))
        t = decontamination.normal(side() + "".join(q) + side())
        w = decontamination.Windows([(1, p)])
        if not w.patterns:
            continue
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p):
            new = [i + 1]
            for j, b in enumerate(t):
                new.append(min(row[j] + (a != b), row[j + 1] + 1, new[-1] + 1))
            row = new
        found = w.find(decontamination.codes(t))
        assert bool(found) == (min(row) <= w.k[0])
        if found:
            assert min(f[3] for f in found) == min(row)


def test_contaminated_documents_go_and_clean_ones_stay(spark):
    r = random.Random(8)
    words_ = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))
    item = words_(40)
    rows = [(i, words_(120), "en", "s") for i in range(20)]
    rows[5] = (5, words_(30) + "\n" + item.upper().replace(" ", ", ") + " " + words_(30), "en", "s")
    rows[6] = (6, words_(30) + " " + item[20:170] + " " + words_(30), "en", "s")
    rows += [(30, None, "en", "s"), (31, "", "en", "s")]
    d = spark.createDataFrame(rows, DOC)
    b = spark.createDataFrame([(1, item), (2, None), (3, "tiny"), (4, words_(30))], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.contaminated(d, b).collect()}
    assert got == {(5, 1), (6, 1)}
    kept = {x.doc_id for x in decontamination.clean_only(d, b, block_chars=50).collect()}
    assert kept == {x[0] for x in rows} - {5, 6}
    span = decontamination.contaminated(d, b).where("doc_id = 5").first()
    assert decontamination.normal(rows[5][1][span.start : span.end]) == decontamination.normal(item)
    assert decontamination.contaminated(d, b.limit(0)).count() == 0 and decontamination.contaminated(empty(spark), b).count() == 0


# --- 10 ------------------------------------------------------------------------------------------
@pytest.mark.parametrize("small,block", [(24, 1 << 20), (2, 500)])
def test_set_join_equals_brute_force(spark, small, block):
    rows = corpus(9, 90)
    base = rows[20][1] or "a b c d e f g h"
    ws = (base + " " + " ".join(f"q{i}" for i in range(60))).split()
    r = random.Random(1)
    for i in range(90, 130):
        v = list(ws)
        v[r.randrange(len(v))] = f"z{i}"
        rows.append((i, " ".join(v)))
    d = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], DOC)
    sets = {i: frozenset(set_join.shingles(t).tolist()) for i, t in rows}
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    degree = {i: len({b for j, b in sets.items() if b != a and near(a, b)}) for i, a in sets.items()}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and near(a, b):
                x, y = find(i), find(j)
                comp[max(x, y)] = min(x, y)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.n_links) for x in set_join.set_components(d, small=small, block_tokens=block, least_frequent=3).collect()}
    assert got == {i: (len(sets[i]), find(i), degree[i]) for i in sets}
    kept = {x.doc_id for x in set_join.one_of_each(d).collect()}
    assert kept == {i for i in sets if find(i) == i}


def similar_sets(seed, groups=12, copies=14, size=60):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base = r.integers(0, 1 << 62, size + int(r.integers(0, 20))).astype(np.uint64)
        for _ in range(copies):
            s = base.copy()
            for at in r.integers(0, len(s), int(r.integers(0, 8))):
                s[at] = r.integers(0, 1 << 62)
            out.append(np.unique(s[: len(s) - int(r.integers(0, 6))]))
    return sorted(out, key=len)


@pytest.mark.parametrize("copies", [1, 14, 90])
def test_links_equal_all_pairs_and_skip(copies):
    sets = similar_sets(copies, groups=6, copies=copies)
    side = np.arange(len(sets)) % 2
    full = [frozenset(s.tolist()) for s in sets]
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(full[i] & full[j]) >= 85 * len(full[i] | full[j])}
    index = set_join.Skipping(sets, 85)
    assert {(i, int(j)) for i, js in set_join.links(sets, 85, index=index) for j in js} == want
    assert {(i, int(j)) for i, js in set_join.links(sets, 85, side) for j in js} == {(i, j) for i, j in want if side[i] != side[j]}
    if copies > 1:
        assert index.skipped > 0
    if copies > 48:
        assert index.derived > len(sets) / 4


def test_candidates_read_no_block_that_positions_rule_out():
    sets = similar_sets(5, groups=1, copies=40, size=200)
    index = set_join.Skipping(sets, 85)
    for i in range(len(sets)):
        index.candidates(i)
    assert index.skipped > 0
    all_entries = sum(int(index.lists[t + 1] - index.lists[t]) for i in range(len(sets)) for t in index.mine[i][: index.prefix[i]] if index.lists[t + 1] - index.lists[t] > 1)
    assert index.read + index.skipped == all_entries


def test_set_join_keeps_links_of_every_row_of_a_document(spark):
    words_ = " ".join(f"a{i}" for i in range(40))
    rows = [(1, words_, "en", "s"), (2, "b c d e f g", "en", "s"), (2, words_ + " z", "en", "s"), (3, "b c d e f g", "en", "s"), (2, "b c d e f g", "en", "s"), (4, "lone words of four or five", "en", "s")]
    d = spark.createDataFrame(rows, DOC).withColumnRenamed("lang", "size").withColumnRenamed("source", "component")
    got = {(x.doc_id, x.n_shingles): x.component_id for x in set_join.set_components(d).collect()}
    assert got == {(1, 37): 1, (2, 3): 1, (2, 38): 1, (3, 3): 1, (4, 3): 4}
    assert {x.doc_id for x in set_join.one_of_each(d).collect()} == {1, 4}


def test_set_join_on_empty_and_null_rows(spark):
    assert set_join.set_components(empty(spark)).count() == 0
    d = spark.createDataFrame([(None, "a b c d e", "en", "s"), (1, None, "en", "s"), (2, "a b c d e", "en", "s"), (3, "a b c d e", "en", "s")], DOC)
    got = sorted((str(x.doc_id), x.component_id) for x in set_join.set_components(d).collect())
    assert ("2", 2) in got and ("3", 2) in got and ("1", 1) in got and len(got) == 4


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(200, 260)] + [(7, 7)]
    got = {x.id: x.component for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 5 for i in range(200, 260)) and 7 not in got


def test_hash_digests_use_whole_texts():
    long = "x" * 200_000 + " end"
    assert hashlib.sha256(" ".join(words(long)).encode()).hexdigest() == hashlib.sha256(long.encode()).hexdigest()
