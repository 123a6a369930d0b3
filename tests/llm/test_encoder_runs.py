"""Words that are new to the encoder, and what the driver keeps between steps."""

import random

import numpy as np
import pytest

from lodestone.llm import common, encoding, packing


@pytest.mark.parametrize(("name", "spaces", "most"), [("byte_bpe_50k.json", True, 20), ("word_bpe_49k.json", False, 2000)])
def test_new_words_go_to_the_model_in_runs_and_marks_are_split_off(name, spaces, most):
    e = encoding.Encoder(encoding.vocabulary(name), spaces)
    r = random.Random(2)
    letters = "abcdeXYZäßéñžŐŸ"
    words = ["".join(r.choices(letters, k=r.randint(1, 12))) for _ in range(1500)]
    text = " ".join(w + r.choice(["", "", ".", ",***", "!!", "$$$", "<|>", "'s", "****", "|", ";\n", "1"]) for w in words) + " end"

    calls = []

    class Counted:
        def __init__(self, of):
            self.of = of

        def tokenize(self, x):
            calls.append(x)
            return self.of.tokenize(x)

    e._model = Counted(e._model)
    texts = [text, text[:4000].strip(), "a ** b", "x<|endoftext|>y z<pad>", ""]
    assert e.many(texts) == [e.whole(t) for t in texts]
    assert 0 < len(calls) <= most  # one call for 200 words where the vocabulary allows it
    batch = [x for x in e._memo if x.isalpha() and max(x) < "İ"]
    lead = " " if spaces else ""
    for w in batch[:300]:
        assert e._memo[w] == np.array(e._t.encode(lead + w, add_special_tokens=False).ids, e.dtype).tobytes()


def test_release_hands_free_memory_back(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "_trim", calls.append)
    common.release(spark)
    assert calls == [0]


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_in_lines_and_with_marks_need_no_tokenizer_of_their_own(name, spaces):
    e = encoding.Encoder(encoding.vocabulary(name), spaces)
    r = random.Random(3)
    words = ["".join(r.choices("abcdeXYZÀÁäßéñ", k=r.randint(1, 12))) for _ in range(900)]
    texts = ["".join(w + r.choice(["", ",", ".***", "$$$$$"]) + r.choice([" ", " ", "\n"]) for w in words[i : i + 90]) + "end" for i in range(0, 900, 90)]
    passed = []

    class Counted:
        def __init__(self, of):
            self.of = of

        def encode_batch_fast(self, x, **kw):
            passed.extend(x)
            return self.of.encode_batch_fast(x, **kw)

        def encode(self, x, **kw):
            passed.append(x)
            return self.of.encode(x, **kw)

    whole = [e.whole(t) for t in texts]
    e._t = Counted(e._t)
    assert e.many(texts) == whole
    assert not passed


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_a_full_memo_keeps_what_several_blocks_have(name, spaces):
    e = encoding.Encoder(encoding.vocabulary(name), spaces, most=60)
    r = random.Random(4)
    for n in range(30):
        texts = ["À Á often\nfound, here " + " ".join("".join(r.choices("abcde'1\t Ж", k=5)).strip() + "x" for _ in range(20)) for _ in range(3)]
        if n:
            assert " often"[not spaces :].strip() in e._memo
        assert e.many([*texts, "", "a  b", "\n"]) == [e.whole(t) for t in [*texts, "", "a  b", "\n"]]
        assert len(e._memo) < 200


def test_a_step_drops_what_other_steps_left_in_its_worker(monkeypatch):
    trims = []
    monkeypatch.setattr(common, "_trim", trims.append)
    monkeypatch.setattr(common, "_kept", {})
    common.word_hashes(["a"])
    e = encoding.encoder(encoding.vocabulary("word_bpe_49k.json"), False)
    del trims[:]

    def run(batches):
        for b in batches:
            assert "words" not in common._kept
            yield b, encoding.encoder(encoding.vocabulary("word_bpe_49k.json"), False) is e

    assert list(common.tidy(run, "encoders")([1, 2])) == [(1, True), (2, True)]
    assert trims == [0, 0]  # before and after


def test_packing_opens_no_second_worker_for_checksums(spark, capsys):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    packing.pieces(docs, encoding.vocabulary("word_bpe_49k.json")).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
