"""Line frequencies count documents, however often their rows repeat."""

from lodestone.llm import line_rules

DOC = "doc_id long, text string, lang string, source string"


def test_repeated_rows_of_a_document_count_once(spark):
    shared = "one line that a clean document of this host has too"
    own = lambda x: "\n".join(" ".join(f"{x}{a}{b}" for b in "abcdefgh") for a in "abcdefgh")
    rows = [(1, f"{shared}\n{own('x')}", "en", "s")] * 5 + [(2, f"{shared}\n{own('y')}", "en", "s")]
    rows += [(None, f"{shared}\n{own('z')}", "en", None)] * 5
    got = line_rules.line_frequency_rules(spark.createDataFrame(rows, DOC), max_docs=3).collect()
    assert len(got) == 11 and all(r.kept and r.removed_words == 0 for r in got)


def test_lines_of_more_documents_still_go(spark):
    shared = "one line that many documents of this host have"
    rows = [(i, shared + "\n" + " ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(20)), "en", None) for i in (1, 1, 2, 3, 4)]
    got = line_rules.line_frequency_rules(spark.createDataFrame(rows, DOC), max_docs=3).collect()
    assert [r.removed_words for r in got] == [9] * 5


def test_line_dedup_tells_rows_of_one_document_apart(spark):
    from lodestone.llm import line_dedup

    a, b, c, d = ("".join(chr(97 + (i * k + k) % 26) for i in range(30)) for k in (3, 5, 7, 11))
    rows = [(1, a, "en", "s"), (5, f"{b}\n{c}", "en", "s"), (5, f"{a}\n{d}", "en", "s"), (None, f"{d}\n\n{d}", "en", "s"), (None, b, "en", "s"), (5, f"{b}\n{c}", "en", "s")]
    got = sorted((str(r.doc_id), r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOC)).collect())
    # nulls come first, so their b and d stay; equal rows come back alike
    assert got == sorted([("1", a), ("5", c), ("5", c), ("5", ""), ("None", f"{d}\n"), ("None", b)])


def test_line_dedup_of_many_and_long_lines(spark):
    from lodestone.llm import line_dedup

    lines = [f"line number {i * 7919 % 100_003} of a long text {i * 104_729 % 99_991}" for i in range(1500)]
    text = "\n".join(lines + lines[:700] + ["x" * 40_000, "x" * 40_001])
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, text, "en", "s"), (2, None, "en", "s")], DOC), max_edits=0).collect()
    assert {r.doc_id: r.text for r in got} == {1: "\n".join(lines + ["x" * 40_000, "x" * 40_001]), 2: None}
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, "x" * 40_000 + "\n" + "x" * 40_001, "en", "s")], DOC)).collect()
    assert got[0].text == "x" * 40_000
