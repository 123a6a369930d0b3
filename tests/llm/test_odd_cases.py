"""Empty tables, nulls, repeated rows, very long texts and clashing columns, operator by operator."""

import zlib

import numpy as np

from lodestone.llm import chat_format, decontamination, encoding, line_rules, packing, set_join, token_rollup

DOC = "doc_id long, text string, lang string, source string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in rows], DOC)


def test_line_rules_on_odd_tables(spark):
    d = rows_of(spark, [(1, LONG), (1, LONG), (None, LONG + "\n" + LONG), (2, None), (3, "")]).withColumnRenamed("lang", "lines")
    got = sorted(((r.doc_id, r.n_words, r.n_dup_lines, r.base_failed) for r in line_rules.line_frequency_rules(d).collect()), key=str)
    assert got == sorted([(1, 20_000, 0, got[0][3])] * 2 + [(None, 40_000, 1, True), (2, 0, 0, True), (3, 0, 0, True)], key=str)
    assert line_rules.line_frequency_rules(d.limit(0)).count() == 0
    v = line_rules.line_frequency_rules(d)
    assert line_rules.cleaned(d, v).columns == d.columns and line_rules.cleaned(d.limit(0), v).count() == 0


def test_packing_of_odd_tables(spark):
    vocab = encoding.vocabulary("word_bpe_49k.json")
    rows = [(1, LONG), (2, "same words"), (2, "same words"), (None, "no id"), (None, None), (3, "")]
    d = rows_of(spark, rows).withColumnRenamed("lang", "ids").withColumnRenamed("source", "curve")
    e = encoding.Encoder(vocab, False)
    ids = [np.append(np.frombuffer(e.whole(t or ""), e.dtype), 1).astype("<u4") for _, t in rows]
    assert len(ids[0]) > 3 * 2048
    got = packing.pieces(d, vocab).collect()
    for i in (1, 2, None, 3):
        assert sum(p.length for p in got if p.doc_id == i) == sum(len(x) for (k, _), x in zip(rows, ids, strict=True) if k == i)
    long = sorted((p.start, p.length, p.ids_crc32) for p in got if p.doc_id == 1)
    assert [s for s, _, _ in long] == [sum(n for _, n, _ in long[:k]) for k in range(len(long))]
    assert all(c == zlib.crc32(ids[0][s : s + n].tobytes()) for s, n, c in long)
    fill = {}
    for p in got:
        fill[p.sequence_id] = fill.get(p.sequence_id, 0) + p.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in fill.values())
    assert packing.pieces(d.limit(0), vocab).count() == 0


def test_chats_of_odd_tables(spark):
    turns = "conv_id long, turn long, role string, text string"
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(200)] + [(2, 0, None, None), (3, 0, "assistant", LONG), (3, 0, "assistant", LONG), (None, 0, "user", "x")]
    got = {r.conv_id: r for r in chat_format.format_chats(spark.createDataFrame(rows, turns)).collect()}
    assert set(got) == {1, 2, 3, None}
    assert chat_format.parse(got[1].formatted) == [(r, t) for c, _, r, t in rows if c == 1]
    assert chat_format.parse(got[2].formatted) == [("", "")] and chat_format.parse(got[3].formatted) == [("assistant", LONG)] * 2
    assert chat_format.format_chats(spark.createDataFrame([], turns)).count() == 0


def test_decontamination_of_odd_tables(spark):
    item = " ".join(f"quiz{i} word{i * 7}" for i in range(12))
    d = rows_of(spark, [(1, LONG + " " + item), (1, "clean text of the same id"), (None, item), (None, "clean"), (2, None), (3, ""), (4, LONG), (4, LONG)]).withColumnRenamed("lang", "item_id")
    b = spark.createDataFrame([(1, item), (1, item), (None, "an item without an id that is long enough"), (2, "")], "item_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in decontamination.clean_only(d, b).collect()), key=str)
    assert got == sorted([(1, "clean text of the same id"), (None, "clean"), (2, None), (3, ""), (4, LONG), (4, LONG)], key=str)
    assert decontamination.clean_only(d.limit(0), b).count() == 0


def test_set_join_of_very_long_texts(spark):
    rows = [(1, LONG), (2, LONG.replace("w5x5", "other", 3)), (3, LONG.upper()), (4, "short one")]
    got = {r.doc_id: r.component_id for r in set_join.set_components(rows_of(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_rollup_of_an_empty_table(spark, tmp_path):
    r = token_rollup.Rollup(spark, f"file://{tmp_path}/roll")
    none = rows_of(spark, []).withColumnRenamed("doc_id", "tokenizer")
    assert r.apply(0, token_rollup.inserts(token_rollup.counted(none, "words@1"))) and r.totals().count() == 0
    r.compact()
    assert r.totals().count() == 0 and r.committed() == {0}
