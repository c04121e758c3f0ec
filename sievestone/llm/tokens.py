"""Whole texts to token ids with the tokenizers library, each distinct piece of text encoded once.

A text is cut where no token can span: at a single blank between two characters
that aren't white space (or at any blank, if the tokenizer drops white space).
Each piece's ids don't depend on its neighbours, so the ids of the pieces, put
together, are those of the whole text; every piece is encoded by the library
itself and kept in a bounded table. Cutting and looking up are Arrow and numpy
operations over many texts at once.

Null text is empty. Strings of special tokens in a text become these tokens, as
is the library's default, or with ``plain_specials`` stay ordinary text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from .common import runs

#: Pieces that one worker keeps; beyond that, the half that was used most goes on.
KEPT_PIECES = 1_000_000
#: Bytes of text that are cut and looked up at a time.
SEGMENT = 8_000_000
#: New pieces that the library gets as one string.
JOINED = 2048
#: Bits of the hash by which a worker remembers pieces that it has seen once.
ONCE_BITS = 23

#: Begins a piece that has no blank before it.
_BARE = "\0"
#: Stands between joined pieces where blanks are dropped: a word of its own, with an id of its own.
_MARK = "\x01"
#: White space that isn't a single blank or line end between words, or a mark: such texts are cut one by one.
_ODD = "\\A[ \\n]|[ \\n]\\z|[ \\n][ \\n]|[\\t\\r\\x00\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: A full stop or comma at a word's end is a token of its own, after a letter that no normalisation joins it to.
_STOP = "[A-Za-z0-9\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{ff}][.,]\\z"
#: Pieces that the library gets alone: empty, with white space or a mark at an end; with the mark between joined pieces.
_SPACE = "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_EDGED, _MARKED = f"\\A\\z|\\A[\\x00{_SPACE}]|[{_SPACE}]\\z", "\\A\\z|\\x01"
#: ASCII without the sign that special tokens begin with.
_PLAIN = "\\A[\\x00-;=-\\x7f]*\\z"
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def default_path(name: str) -> str:
    """Where the installed public tokenizer ``name`` lies, on whichever machine asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def _merged(odd: np.ndarray, ids: np.ndarray, count: np.ndarray, other_ids: np.ndarray, other_count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of rows in order, of which the first two belong to the odd ones and the others to the rest."""
    counts = np.empty(len(odd), dtype=np.int64)
    counts[odd], counts[~odd] = count, other_count
    out, is_odd = np.empty(int(counts.sum()), dtype=np.int32), np.repeat(odd, counts)
    out[is_odd], out[~is_odd] = ids, other_ids
    return out, counts


class Encoder:
    """``drops_blanks``: the tokenizer ignores white space and lowers case; else a piece keeps the blank before it."""

    def __init__(self, path: str, drops_blanks: bool, plain_specials: bool = False, kept: int | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = plain_specials
        self.drops_blanks, self.kept = drops_blanks, kept or KEPT_PIECES
        self.segment = SEGMENT // 8 if kept else SEGMENT  # a short table goes with short arrays
        if drops_blanks:
            (self.mark,) = self._library([_MARK])[0].ids
            self.lowers = self._library(["A"])[0].ids == self._library(["a"])[0].ids
        else:
            names = self.tokenizer.get_vocab()
            self.bytes = np.zeros(max(names.values()) + 1, dtype=np.int64)
            for name, i in names.items():
                self.bytes[i] = len(name)  # a character of a byte-level token is a byte
        (self.dot,), (self.comma,) = (e.ids for e in self._library([".", ","]))
        self._clear()

    def _clear(self) -> None:
        #: Numbered pieces. One stands for itself after a blank, or after _BARE for the rest of it as it is; where blanks are dropped, for itself.
        self.known = pa.array([], type=pa.string())
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.first = np.zeros(1 << 14, dtype=np.int64)
        self.count = np.zeros(1 << 14, dtype=np.int64)
        self.uses = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0
        self.once = np.zeros(1 << ONCE_BITS, dtype=bool)

    def _keep_half(self) -> None:
        known = self.known
        kept = np.sort(np.argsort(-self.uses[: len(known)], kind="stable")[: self.kept // 2])
        ids, lengths, uses = self.ids[_ranges(self.first[kept], self.count[kept])], self.count[kept], self.uses[kept]
        self._clear()
        self._hold(ids, lengths)
        self.known = known.take(pa.array(kept))
        self.uses[: len(kept)] = uses // 2  # what was used long ago counts less

    def _hold(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Put the ids of further pieces behind those of the numbered ones."""
        at, more = len(self.known), len(ids)
        self.used = int(self.first[at - 1] + self.count[at - 1]) if at else 0
        while self.used + more > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while at + len(lengths) > len(self.first):
            self.first, self.count, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count, self.uses))
        self.ids[self.used : self.used + more] = ids
        self.count[at : at + len(lengths)] = lengths
        self.first[at : at + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.uses[at : at + len(lengths)] = 0

    def _library(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _encoded(self, fresh: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces end to end, and how many each has. The library gets many to a string, cut again where each one's ids end."""
        odd = pc.match_substring_regex(fresh, _MARKED if self.drops_blanks else _EDGED).to_numpy(zero_copy_only=False)
        if odd.any():
            own = fresh.filter(pa.array(odd)).to_pylist()
            found = [e.ids for e in self._library([k if self.drops_blanks else k[1:] if k[:1] == _BARE else " " + k for k in own])]
            return _merged(odd, np.array([i for x in found for i in x], dtype=np.int32), np.array(list(map(len, found)), dtype=np.int64), *self._encoded(fresh.filter(pa.array(~odd))))
        if not len(fresh):
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        keys, glue = fresh.to_pylist(), f" {_MARK} "
        groups = [keys[i : i + JOINED] for i in range(0, len(keys), JOINED)]
        strings = [glue.join(g) + glue if self.drops_blanks else " " + " ".join(g) for g in groups]
        ids = np.concatenate([np.array(e.ids, dtype=np.int32) for e in self._library(strings)])
        if self.drops_blanks:
            marks = np.flatnonzero(ids == self.mark)
            ends = marks - np.arange(len(marks))
            ids = ids[ids != self.mark]
        else:
            sizes = pc.binary_length(fresh).to_numpy()
            ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(sizes.astype(np.int64) + 1)) + 1
        return ids, np.diff(ends, prepend=0)

    def _numbers(self, words: pa.Array, times: np.ndarray) -> np.ndarray:
        """The distinct words' places in the table; ``times``: how often each occurs.

        New ones are learnt. Those that occur once, and haven't before, aren't
        numbered: most pieces of a large corpus are that rare.
        """
        found = lambda: pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype(np.int64)
        n = found()
        if len(self.known) + np.count_nonzero((n < 0) & (times > 1)) > self.kept:
            self._keep_half()
            n = found()
        at = np.flatnonzero(n < 0)
        if len(at):
            mark = pd.util.hash_array(words.take(pa.array(at)).to_numpy(zero_copy_only=False), categorize=False) >> np.uint64(64 - ONCE_BITS)
            mark = mark.astype(np.int64)
            again = (times[at] > 1) | self.once[mark]
            self.once[mark] = True
            at = np.concatenate([at[again], at[~again]])
            fresh = words.take(pa.array(at))
            self._hold(*self._encoded(fresh))
            n[at] = len(self.known) + np.arange(len(at))
            self.known = pa.concat_arrays([self.known, fresh.slice(0, int(again.sum()))])
        self.uses[n] += times
        return n

    def _look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces end to end, and how many each has."""
        coded = pieces.dictionary_encode()
        code, raw = coded.indices.to_numpy(), coded.dictionary
        stop = pc.match_substring_regex(raw, _STOP)
        word = pc.if_else(stop, pc.utf8_slice_codeunits(raw, 0, -1), raw)
        if self.drops_blanks and self.lowers:  # what's ASCII, and no special token, is lowered as the library lowers it
            word = pc.if_else(pc.match_substring_regex(word, _PLAIN), pc.ascii_lower(word), word)
        words = word.dictionary_encode()
        n = words.indices.to_numpy()
        n = self._numbers(words.dictionary, np.bincount(n, weights=np.bincount(code, minlength=len(raw)), minlength=len(words.dictionary)).astype(np.int64))[n]
        stop = stop.to_numpy(zero_copy_only=False)
        own = self.count[n]
        count = own + stop
        first = np.cumsum(count) - count
        table = np.empty(int(count.sum()), dtype=np.int32)
        table[_ranges(first, own)] = self.ids[_ranges(self.first[n], own)]
        table[(first + own)[stop]] = np.where(pc.ends_with(raw, ".").to_numpy(zero_copy_only=False)[stop], self.dot, self.comma)
        each = count[code]
        return table[_ranges(first[code], each)], each

    def _cut(self, text: str, begins: bool = True) -> list[str]:
        """The pieces of a text with any white space."""
        if self.drops_blanks:
            return text.split(" ")
        if _BARE in text:  # the mark itself occurs: the text goes to the library whole
            return [_BARE + (text if begins else " " + text)]
        pieces = _BETWEEN.split(text)
        if begins:
            pieces[0] = _BARE + pieces[0]
        return pieces

    def _long(self, text: str) -> Iterator[list[str]]:
        """The pieces of a very long text, in lists of about a segment's characters."""
        start = 0
        while start < len(text):
            cut = _BETWEEN.search(text, start + self.segment)
            end = cut.start() if cut else len(text)
            yield self._cut(text[start:end], not start)
            start = end + 1

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.drops_blanks:
            odd, marked = np.zeros(len(texts), dtype=bool), pc.replace_substring(texts, "\n", " ")
        else:  # between words, a line end is a token of its own
            odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
            marked = pc.binary_join_element_wise(_BARE, pc.replace_substring(texts, "\n", f" {_BARE}\n {_BARE}"), "")
        if not odd.any():
            return self._of_lists(pc.split_pattern(marked, " "))
        even = self._of_lists(pc.split_pattern(pc.filter(marked, pa.array(~odd)), " "))
        rest = self._of_lists(pa.array([self._cut(t) for t in pc.filter(texts, pa.array(odd)).to_pylist()], type=pa.list_(pa.string())))
        return _merged(odd, *rest, *even)

    def _of_lists(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the lists of pieces, and how many each list has."""
        ids, each = self._look_up(pieces.flatten())
        ends = np.concatenate([[0], np.cumsum(each)])[np.cumsum(pc.list_value_length(pieces).to_numpy())]
        return ids, np.diff(ends, prepend=0)

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yield (rows, ids, lengths): the ids of the next ``rows`` texts end to end, and how many each has."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, type=pa.string()), "")
        for a, b in runs(texts, self.segment):
            part = texts.slice(a, b - a)
            if b - a == 1 and pc.binary_length(part)[0].as_py() > 2 * self.segment:
                ids = np.concatenate([self._look_up(pa.array(pieces, type=pa.string()))[0] for pieces in self._long(part[0].as_py())])
                yield 1, ids, np.array([len(ids)], dtype=np.int64)
            else:
                yield b - a, *self._encode(part)

    def forget(self) -> None:
        """Empty the table of pieces, which frees its memory."""
        self._clear()


@cache
def encoder(path: str, drops_blanks: bool, plain_specials: bool = False, kept: int | None = None) -> Encoder:
    return Encoder(path, drops_blanks, plain_specials, kept)
