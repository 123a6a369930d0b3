"""The pipeline and the registered queries on the smallest tables."""

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert docs.count() <= n
        n = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_every_operator_is_registered():
    names = set(__spark_entry__.queries())
    assert all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)) and "pipeline" in names


def test_clashing_columns_do_not_matter(spark):
    from lodestone.llm import line_dedup, set_join

    d = spark.createDataFrame([(1, "a b c d e f " * 5, 3, "x"), (2, "a b c d e f " * 5, 4, "y")], "doc_id long, text string, id long, size string")
    assert set_join.one_of_each(d).columns == d.columns
    assert line_dedup.dedup_lines(d.withColumnRenamed("size", "gone")).count() == 2


def planted(seed=3):
    """Documents with toxic words, repeated and nearly repeated lines, near copies and benchmark passages."""
    import random

    r = random.Random(seed)
    vocab = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) + r.choice(["", "n", "r", "s"]) for _ in range(300)]
    words = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    item = words(45)
    rows, toxic, leaked = [], set(), set()
    line = words(14)
    for i in range(90):
        text = "\n".join(words(r.randint(8, 30)) for _ in range(r.randint(2, 5)))
        if i % 9 == 0:
            text += "\n" + line if i % 18 else "\n" + line[:-1] + "q"
        if i % 3 == 1:
            toxic.add(i)
            text = " ".join(w + (" " + r.choice(["zidiot", "zmoron", "zscum"]) if k % 4 == 0 else "") for k, w in enumerate(text.split(" ")))
        if i % 15 == 5:
            leaked.add(i)
            text += "\n" + words(5) + " " + item.upper() + " " + words(5)
        rows.append((i, text))
    for k in range(4):  # one-line documents and near copies of them: a word in the middle changed
        ws = words(80).split(" ")
        rows.append((100 + k, " ".join(ws)))
        ws[40] = "changed" + ws[40]
        rows.append((110 + k, " ".join(ws)))
    rows += [(200, None), (201, ""), (None, words(40)), (202, words(2600))]
    return rows, toxic, leaked, item


def test_every_stage_equals_brute_force(spark, tmp_path):
    import zlib

    import numpy as np

    from lodestone.llm import encoding, set_join
    from lines_by_definition import kept_lines

    rows, toxic, leaked, item = planted()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = lambda xs: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in xs], schema)
    full(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i, _ in rows if i is not None and i < 100], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, now = dict(corpus_pipeline.STAGES), rows
    read = lambda name: sorted(((x.doc_id, x.text) for x in stages[name](spark, full(now), str(tmp_path)).collect()), key=str)

    now = read("toxicity")
    assert now == sorted(((i, t) for i, t in rows if i not in toxic), key=str)
    got = read("line_dedup")
    assert got == sorted(kept_lines(now), key=str) and got != now
    now = got

    got = read("set_join")
    sets = {i: frozenset(set_join.shingles(t, 5).tolist()) for i, t in now if i is not None}
    gone = {b for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert gone and got == sorted(((i, t) for i, t in now if i not in gone), key=str)
    now = got

    got = read("decontamination")
    assert got == sorted(((i, t) for i, t in now if i not in leaked), key=str) and len(got) < len(now)
    now = got

    e = encoding.Encoder(encoding.vocabulary("word_bpe_49k.json"), False)
    ids = {i: np.append(np.frombuffer(e.whole(t or ""), e.dtype), 1).astype("<u4") for i, t in now}
    pieces = stages["packing"](spark, full(now), str(tmp_path)).collect()
    assert {i: sum(p.length for p in pieces if p.doc_id == i) for i in ids} == {i: len(x) for i, x in ids.items()}
    assert all(p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) for p in pieces)
    fill = {}
    for p in pieces:
        fill.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in fill.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        size = sum(n for _, n in parts)
        assert size <= 2048 and (size & (size - 1)) == 0
