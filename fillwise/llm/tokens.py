"""Token ids of whole texts by a public tokenizer (tokenizers library), with each distinct piece encoded once.

A text is cut where the tokenizer's own pre-tokenization always cuts, so that the ids of a text are the ids of its
pieces, one after the other; a batch then encodes its distinct pieces only.  Two cuts are known:

* ``spaces``: the tokenizer drops white space (a word-end BPE): pieces are the words.
* ``bytes``: a byte-level BPE that glues one space to the word behind it: a piece starts at a space or
  line feed that follows a character other than white space.  Texts with other white space, such as two spaces in a
  row, are encoded as a whole.

A special token's string in a text becomes that token, as in the library's ``encode`` as it comes; such texts are
encoded as a whole.
"""

from __future__ import annotations

import sys
import types
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces remembered by a Python worker (about 150 bytes each); those that come later are encoded each time.
CACHE = 400_000
#: Pieces that are encoded as one text.
RUN = 500


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, pieces: str, cache: int = CACHE) -> Encoder:
    """The encoder of this Python worker, which keeps it from task to task."""
    held = sys.modules.setdefault("fillwise_worker", types.ModuleType("fillwise_worker"))
    key = (path, pieces, cache)
    if getattr(held, "key", None) != key:
        held.encoder = None  # the old one goes first
        held.encoder, held.key = Encoder(path, pieces, cache), key
    return held.encoder


class Encoder:
    """Encodes Arrow arrays of texts and remembers the ids of their pieces."""

    def __init__(self, path: str, pieces: str, cache: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if pieces not in ("spaces", "bytes", "none"):
            raise ValueError(f"unknown kind of pieces: {pieces}")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces, self.most = pieces, cache
        # a piece starts at a token that starts with a space or line feed, as the byte-level alphabet writes them
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.starts[[i for t, i in vocabulary.items() if t[:1] in ("\u0120", "\u010a")]] = True
        self.joins = pieces == "bytes" and not any(" " in t or "\n" in t for t in self.special)
        # a piece's number by its string; the first piece of a text, without its space, is a table of its own
        self.tables = {" ": _Table(), "": _Table()}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has), each word encoded by itself."""
        e = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        bounds = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(words) + 1))
        return np.array(e.ids, np.uint32), np.diff(bounds)

    def _run(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _apart, for words that may follow one another in a text: it is cut before each of them."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        first = np.flatnonzero(self.starts[ids])
        if len(first) != len(words) or first[0]:
            return self._apart(words)
        return ids, np.diff(first, append=len(ids))

    def _numbers(self, words: list[str], prefix: str, firm: np.ndarray | None = None) -> tuple[np.ndarray, _Table]:
        """Each word's number in a table that holds them all (words are distinct); the lasting table, unless that is full.

        ``firm`` says which words another one can follow."""
        table = self.tables[prefix]
        numbers = np.fromiter(map(table.numbers.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(numbers < 0)
        if not len(missing):
            return numbers, table
        if firm is not None and self.joins:
            # firm words first, to be encoded in runs
            runs = int(firm[missing].sum())
            missing = np.concatenate((missing[firm[missing]], missing[~firm[missing]]))
        else:
            runs = 0
        new = [words[i] for i in missing.tolist()]
        if len(table.numbers) > self.most:
            table = table.copy()
        first = len(table.lengths)
        full = [w if w.startswith("\n") else prefix + w for w in new] if prefix else new
        for at in range(0, runs, RUN):
            table.parts.append(self._run(full[at : min(at + RUN, runs)]))
        for at in range(runs, len(full), 50_000):
            table.parts.append(self._apart(full[at : at + 50_000]))
        if table.lasting:
            table.numbers.update(zip(new, range(first, first + len(new))))
        numbers[missing] = np.arange(first, first + len(new))
        return numbers, table.settled()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's ids); a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.pieces == "none":
            return _joined(self._whole(texts.to_pylist()))
        named = np.zeros(len(texts), bool)
        for token in self.special:
            named |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False).astype(bool)
        if not named.any():
            ids, ends, odd = self._by_pieces(texts)
        else:
            ids, ends, odd = self._by_pieces(pc.if_else(pa.array(named), "", texts))
        rows = np.flatnonzero(named | odd)
        if not len(rows):
            return ids, ends
        out = np.split(ids, ends[1:-1]) if len(ends) > 2 else [ids]
        for row, exact in zip(rows.tolist(), self._whole(texts.take(pa.array(rows)).to_pylist())):
            out[row] = exact
        return _joined(out)

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, bounds, which texts have to be encoded as a whole)."""
        if self.pieces == "spaces":
            lists = pc.ascii_split_whitespace(texts)
        else:  # a line feed starts a piece as a space does; such a piece keeps it and gets no space
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        starts -= starts[0]
        distinct = lists.flatten().dictionary_encode()
        codes = distinct.indices.to_numpy(zero_copy_only=False)
        pieces = distinct.dictionary
        vocabulary = pieces.to_numpy(zero_copy_only=False).tolist()
        del lists, distinct
        if self.pieces == "spaces":
            numbers, table = self._numbers(vocabulary, "")
            return *_gather(table.ids, table.bounds, numbers[codes] if len(codes) else numbers, starts), np.zeros(len(texts), bool)
        first = starts[:-1]
        head_codes, which = np.unique(codes[first], return_inverse=True)
        heads, head_table = self._numbers([vocabulary[c] for c in head_codes.tolist()], "")
        # a piece can be followed by a cut if its last character isn't white space
        firm = ~pc.match_substring_regex(pieces, _ENDS_IN_SPACE).to_numpy(zero_copy_only=False).astype(bool)
        numbers, table = self._numbers(vocabulary, " ", firm)
        if firm.all():
            odd = np.zeros(len(first), bool)
        else:
            loose = ~firm[codes]
            loose[starts[1:] - 1] = False
            before = np.concatenate(([0], np.cumsum(loose)))
            odd = before[starts[1:]] > before[starts[:-1]]
        # first pieces come without a space: their ids stand behind those of the others
        numbers = numbers[codes]
        numbers[first] = heads[which] + len(table.lengths)
        table = _Table.joined(table, head_table)
        return *_gather(table.ids, table.bounds, numbers, starts), odd


#: Empty, or a last character that is white space to any tokenizer (RE2 syntax).
_ENDS_IN_SPACE = r"(^|[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}])\z"


class _Table:
    """Pieces' numbers and ids."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.lasting = True
        self.ids, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.bounds = np.zeros(1, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def copy(self) -> _Table:
        """A table for one batch that starts from the pieces known so far."""
        out = _Table()
        out.__dict__ |= self.__dict__ | {"lasting": False, "parts": []}
        return out

    def settled(self) -> _Table:
        if self.parts:
            ids, lengths = zip(*self.parts)
            self.ids, self.lengths = np.concatenate((self.ids, *ids)), np.concatenate((self.lengths, *lengths))
            self.bounds = np.concatenate(([0], np.cumsum(self.lengths)))
            self.parts = []
        return self

    @staticmethod
    def joined(a: _Table, b: _Table) -> _Table:
        out = _Table()
        out.ids, out.lengths = np.concatenate((a.ids, b.ids)), np.concatenate((a.lengths, b.lengths))
        out.bounds = np.concatenate((a.bounds, b.bounds[1:] + a.bounds[-1]))
        return out


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32)), np.concatenate(([0], np.cumsum(lengths)))


def _gather(ids: np.ndarray, bounds: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pieces ``codes`` in order, and where each text's ids start; ``starts`` bounds its pieces."""
    lengths = np.diff(bounds)[codes] if len(codes) else np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    # a piece's first id in the table, less its place in the result
    kind = np.int32 if max(len(ids), int(ends[-1])) < 1 << 31 else np.int64
    shift = (bounds[:-1][codes] - ends[:-1]).astype(kind) if len(codes) else np.zeros(0, kind)
    at = np.repeat(shift, lengths)
    at += np.arange(len(at), dtype=kind)
    return ids[at], ends[starts]


def append(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by ``end_id``."""
    n = len(bounds) - 1
    out_bounds = bounds + np.arange(n + 1)
    out = np.empty(len(ids) + n, np.uint32)
    ends = out_bounds[1:] - 1
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask] = ids
    out[ends] = end_id
    return out, out_bounds
