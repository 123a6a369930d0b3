"""Queries and operators that hand on whole texts, against values derived by hand."""

import pytest

from lodestone.plans import transcript_queries as TQ
from lodestone.sources import transcripts as X

LONG = "word " * 240 + "end"


@pytest.fixture(scope="module")
def talks(spark, tmp_path_factory):
    """conversations with messages of more than 500 characters."""
    d = str(tmp_path_factory.mktemp("talks"))
    rows = [(1, 0, "user", "fix the index"), (1, 1, "assistant", LONG), (1, 2, "user", "thanks"), (2, 0, "user", LONG + " two"), (2, 1, "assistant", "done")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def test_turns_are_whole_but_for_s11(spark, talks):
    whole = {(r.session, r.line_no): r.text for r in TQ.QUERIES["s12_turns"](spark, talks).collect()}
    assert whole["1", 1] == LONG and whole["2", 0] == LONG + " two"
    assert max(len(r.text) for r in TQ.QUERIES["s11_s12_turns"](spark, talks).collect()) == 500


def test_chunks_and_windows_count_whole_messages(spark, talks):
    chunks = TQ.QUERIES["x06_chunks"](spark, talks).orderBy("session", "chunk").collect()
    assert "".join(c.text for c in chunks).count("end") == 2
    window = TQ.QUERIES["j17_turn_window"](spark, talks).collect()
    # a third of 900 for the matched turn, what is left for the following ones, as in the reference
    assert {(r.session, r.turn): len(r.text) for r in window} == {("1", 0): 13, ("1", 1): 887, ("2", 0): 300, ("2", 1): 4}


def test_best_turn_sees_words_after_the_500th_character(spark, tmp_path):
    rows = [(1, 0, "user", "a " * 300 + "late words"), (1, 1, "user", "late words")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert TQ.QUERIES["j16_best_turn"](spark, str(tmp_path)).first().turn == 0


def stepped(msgs, most, share):
    """The reference's walk: back until the overlap is reached."""
    if len("\n".join(msgs)) <= most:
        return ["\n".join(msgs)]
    out, i = [], 0
    while i < len(msgs):
        j, used = i, 0
        while j < len(msgs) and (j == i or used + len(msgs[j]) + 1 <= most):
            used += len(msgs[j]) + 1
            j += 1
        out.append("\n".join(msgs[i:j]))
        if j >= len(msgs):
            break
        k, back = j, 0
        while k > i and back < int(most * share):
            k -= 1
            back += len(msgs[k]) + 1
        i = k if k > i else j
    return out


@pytest.mark.parametrize("sizes", [[60] * 12, [200, 40, 40, 150, 10, 10, 290], [90, 10, 20, 30, 30, 100, 80], [100, 97, 100]])
def test_chunks_step_back_by_the_overlap_at_least(spark, sizes):
    texts = [chr(97 + i) * n for i, n in enumerate(sizes)]
    t = spark.createDataFrame([("s", i, "user", x) for i, x in enumerate(texts)], "session string, line_no long, role string, text string")
    got = [r.text for r in X.chunks(t, most=317, overlap=0.15).orderBy("chunk").collect()]
    assert got == stepped([f"user: {x}" for x in texts], 317, 0.15)
