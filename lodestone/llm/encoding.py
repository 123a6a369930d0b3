"""Encoding of whole texts by the tokenizers library, with a memo of words.

Both public vocabularies split a text before merging, and always in front of a space or line feed
that follows a character which is not white space. So a text is cut there, each distinct piece is
encoded once by the library, and the ids are joined. Where white space counts, texts with two
spaces or line feeds in a row, or white space at the end, are encoded whole. The memo is bounded
and only saves time: pieces that only one block of texts had go first.
"""

from __future__ import annotations

import itertools
import operator
import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back, kept

if sys.byteorder != "little":
    raise ImportError("ids are kept in little-endian order")


_MARKS = ".,;!?#*$%&|<>"  # not the apostrophe, which some letters follow in one piece

# bytes as the characters that byte-level vocabularies write them in: visible Latin-1 characters
# stand for themselves, the others for those from U+0100 on, in order
_VISIBLE = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
# the same for whole characters below U+0130; every one has an entry, as missing ones are slow to look up
_SHOWN = ["".join(chr(_BYTE_CHARS.get(b, b)) for b in chr(c).encode()) for c in range(0x130)]
_NEVER = "\xc0\xc1"  # bytes that UTF-8 never has
_LINE = _SHOWN[10] + _NEVER[1]
_id_of = operator.attrgetter("id")


def _listed(words: pa.StringArray) -> list[str]:
    """The same as to_pylist() for words without spaces, of which there is one at least or none: far quicker."""
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(one, " ")[0].as_py().split(" ") if len(words) else []


class Encoder:
    """text -> ids as little-endian bytes (uint16 where the vocabulary fits, else uint32).

    The memo gives each piece a number; its ids lie in one array, from which those of whole texts are gathered.
    """

    def __init__(self, path: str, spaces_count: bool, most: int = 150_000):
        from tokenizers import Tokenizer

        self._t = Tokenizer.from_file(path)
        self._t.encode_special_tokens = True
        # words of plain letters go to the model at once, as nothing normalises or splits them
        self._model = self._t.model
        self._plain = all(t.special for t in self._t.get_added_tokens_decoder().values())
        self.dtype = np.dtype("<u2" if self._t.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self._spaces, self._most = spaces_count, most
        self._lead = _SHOWN[ord(" ")] if spaces_count else ""
        self._apart = None  # ids of two characters that no text holds and no longer token has
        if spaces_count and not self._model.end_of_word_suffix and not self._model.continuing_subword_prefix:
            tokens = self._t.get_vocab(with_added_tokens=True)
            if all(c in tokens and not any(c in t for t in tokens if t != c) for c in _NEVER):
                self._apart = [tokens[c] for c in _NEVER]
        self._forget(np.zeros(0, np.int64))

    def whole(self, text: str) -> bytes:
        return np.asarray(self._t.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    @property
    def _memo(self) -> dict[str, bytes]:
        """Ids of every piece in the memo."""
        return {w: self._ids[a : a + n].tobytes() for w, a, n in zip(self._slots, self._start.tolist(), self._size.tolist(), strict=True)}

    def _forget(self, keep: np.ndarray) -> None:
        """Leaves the pieces with these numbers (ascending) in the memo, under new numbers."""
        kept = []
        if len(keep):
            held = np.zeros(len(self._slots), bool)
            held[keep] = True
            kept = list(itertools.compress(self._slots, held.tolist()))
            self._ids, self._size, self._used = self._gather(keep), self._size[keep], self._used[keep] >> 1
            self._start = (np.cumsum(self._size) - self._size).astype(np.int32)
        else:
            self._ids = np.zeros(0, self.dtype)
            self._start, self._size, self._used = (np.zeros(0, np.int32) for _ in range(3))
        # a new piece gets the next number as it is looked up
        self._slots = defaultdict(itertools.count(len(kept)).__next__, zip(kept, range(len(kept))))

    def _gather(self, slots: np.ndarray) -> np.ndarray:
        """The ids of these pieces one after another."""
        size = self._size[slots]
        skip = self._start[slots] - (np.cumsum(size) - size)
        at = np.repeat(skip, size)
        at += np.arange(len(at), dtype=at.dtype)
        return self._ids[at]

    def _simple(self, shown: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has; what stands between two _NEVER[1] is merged apart.

        Where the vocabulary allows it, many words are merged as one run with characters between them that no token goes beyond.
        """
        tokenize, ids = self._model.tokenize, []
        if self._apart is None:
            sizes, ends = [], {}
            for w in shown:
                core, _, end = w.partition(_NEVER[1])
                before = len(ids)
                ids += map(_id_of, tokenize(core))
                if end:
                    if end not in ends:
                        ends[end] = list(map(_id_of, tokenize(end)))
                    ids += ends[end]
                sizes.append(len(ids) - before)
            return np.array(ids, self.dtype), np.array(sizes, np.int32)
        for i in range(0, len(shown), 200):
            ids += map(_id_of, tokenize(_NEVER[0].join(shown[i : i + 200])))
            ids.append(self._apart[0])
        run = np.array(ids, self.dtype)
        last = run == self._apart[0]
        keep = ~(last | (run == self._apart[1]))
        return run[keep], np.bincount((np.cumsum(last) - last)[keep], minlength=len(shown)).astype(np.int32)

    def _fill(self, new: list[str]) -> None:
        """Appends the ids of new pieces.

        Words of letters below U+0130 are simple, with marks after them or not: beyond, lower case may
        hold marks. Such marks are always split off together, and so is a line feed in front.
        """
        spaces, lead, simple, shown, others = self._spaces, self._lead, [], [], []
        for i, w in enumerate(new if self._plain else ()):
            first, end = lead, ""
            if not w.isalpha():
                if spaces and w[:1] == "\n":
                    if w[:2] == "\n\n":
                        first, w = "", w[2:]
                    else:
                        first, w = _LINE, w[1:]
                core = w.rstrip(_MARKS)
                if not core.isalpha():
                    others.append(i)
                    continue
                if core != w:
                    w, end = core, _NEVER[1] + w[len(core) :]
            if not w.isascii():
                if max(w) >= "\u0130":
                    others.append(i)
                    continue
                w = (w if spaces else w.lower()).translate(_SHOWN)
            elif not spaces:
                w = w.lower()
            simple.append(i)
            shown.append(first + w + end)
        if not self._plain:
            others = list(range(len(new)))
        ids, size = [self._ids], np.zeros(len(new), np.int32)
        if simple:
            got, size[simple] = self._simple(shown)
            ids.append(got)
        del shown
        for i in range(0, len(others), 20_000):
            part = [new[j] for j in others[i : i + 20_000]]
            if spaces:
                part = [w[2:] if w[:2] == "\n\n" else w if w[:1] == "\n" else " " + w for w in part]
            got = [e.ids for e in self._t.encode_batch_fast(part, add_special_tokens=False)]
            size[others[i : i + 20_000]] = list(map(len, got))
            ids.append(np.fromiter(itertools.chain.from_iterable(got), self.dtype))
        order = np.array(simple + others, np.int64)
        start = np.zeros(len(new), np.int32)
        start[order] = len(self._ids) + np.cumsum(size[order]) - size[order]
        self._ids = np.concatenate(ids)
        self._start, self._size = np.concatenate([self._start, start]), np.concatenate([self._size, size])
        self._used = np.concatenate([self._used, np.zeros(len(new), np.int32)])

    def many(self, texts: list[str]) -> list[bytes]:
        out, lo, held = [], 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= 4_000_000:
                out += self._block(texts[lo : i + 1])
                lo, held = i + 1, 0
        return out + self._block(texts[lo:]) if lo < len(texts) else out

    def _block(self, texts: list[str]) -> list[bytes]:
        if self._spaces:
            # two line feeds, which no text that is cut holds, mark its first piece: no space stands before it
            ok = ["  " not in t and "\n\n" not in t and " \n" not in t and "\n " not in t and t[:1] not in (" ", "\n") and not t[-1:].isspace() for t in texts]
            cut = ["\n\n" + t.replace("\n", " \n") if plain else None for t, plain in zip(texts, ok, strict=True)]
        else:
            cut = [t.replace("\n", " ") for t in texts]
        cut = pc.split_pattern(pa.array(cut, pa.string()), " ")
        counts = pc.list_value_length(cut).fill_null(0).to_numpy()
        pieces = cut.flatten().dictionary_encode()
        if len(self._slots) > self._most:
            keep = np.flatnonzero(self._used > 1)  # pieces of a second block stay
            if len(keep) > self._most * 4 // 5:
                keep = np.sort(keep[np.argsort(-self._used[keep], kind="stable")[: self._most // 2]])
            self._forget(keep)
        before, words = len(self._slots), _listed(pieces.dictionary)
        try:
            slots = np.fromiter(map(self._slots.__getitem__, words), np.int64, len(words))
            if len(self._slots) > before:
                new = list(itertools.islice(reversed(self._slots), len(self._slots) - before))
                new.reverse()
                self._fill(new)
        except BaseException:
            self._forget(np.zeros(0, np.int64))  # numbers without ids
            raise
        self._used[slots] += 1
        slots = slots[pieces.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(self._size[slots], dtype=np.int64)])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        ends = (ends * self.dtype.itemsize).tolist()
        held = self._gather(slots).tobytes()
        out = [held[a:b] for a, b in itertools.pairwise(ends)]
        if self._spaces:
            out = [x if plain else self.whole(t) for x, plain, t in zip(out, ok, texts, strict=True)]
        return out


def encoder(path: str, spaces_count: bool) -> Encoder:
    """One encoder per worker and vocabulary."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key, held = (path, spaces_count), kept("encoders")
    if key not in held:
        held[key] = Encoder(path, spaces_count)
        give_back()  # what reading the vocabulary took
    return held[key]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
