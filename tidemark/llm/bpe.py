"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can end its encoding. The table of these
tokens is filled from left to right: a token ending here fits if it may follow the last token of the
prefix before it. The encoding is read off backwards. As a prefix's entry never depends on what follows,
appending continues the table, and an edit leaves all entries before it valid.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left, bisect_right
from functools import lru_cache

import ahocorasick
import regex

# White space as the tokenizers' regular expressions know it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the pattern that splits text before the merges, with white space spelled out.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Coarser than PIECES: every boundary of a chunk is one of pieces, whatever stands around it.
_CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_PIECE = regex.compile(PIECES)
#: Behind a single line feed between visible characters a piece ends, and the feed is a piece of its own.
_LINE = re.compile(rf"(?<=[^{SPACE}]\n)(?=[^{SPACE}])")
_SPACES = frozenset(chr(i) for i in range(0x3001) if re.match(f"[{SPACE}]", chr(i)))
#: The same as PIECES for ASCII text, where the plain module is faster.
_ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_CACHED, _LONG = 250_000, 64


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as 256, 257, ..."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """An encoder made from the JSON of a byte-level BPE tokenizer (vocabulary and ordered merges)."""

    def __init__(self, source: bytes):
        whole = json.loads(source)
        model, split = whole["model"], whole.get("pre_tokenizer") or {}
        if whole.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space"):
            raise ValueError("not a byte-level tokenizer that splits by the pattern of this module")
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("not a plain byte-level BPE")
        byte_of = _byte_of()
        raw = lambda t: bytes(byte_of[c] for c in t)
        ids = model["vocab"]
        self.bytes_of: dict[int, bytes] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}  # of the merge that makes a token; absent for single bytes
        self.merge: dict[int, int] = {}  # rank of a pair, left << 20 | right
        for t, i in ids.items():
            if len(t) == 1 and t in byte_of:
                self.bytes_of[i] = raw(t)
        for n, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, l, r = ids[a + b], ids[a], ids[b]
            self.merge.setdefault(l << 20 | r, n)
            if i not in self.parts:
                self.parts[i], self.rank[i], self.bytes_of[i] = (l, r), n, raw(a + b)
        self.ends: dict[int, list[tuple[int, int]]] = {}
        self.starts: dict[int, list[tuple[int, int]]] = {}
        self._whole: dict[int, bool] = {}
        self._follows: dict[int, bool] = {}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.tokens = ahocorasick.Automaton()
        for i, b in self.bytes_of.items():
            if self.is_whole(i):  # no other token is ever part of an encoding
                self.tokens.add_word(b.decode("latin-1"), (i, len(b)))
        self.tokens.make_automaton()
        self.pieces = _Pieces(self)
        self.chunks = _Chunks(self)

    # -- which token may follow which -----------------------------------------------------------------
    def _spine(self, token: int, right: bool) -> list[tuple[int, int]]:
        """Parts of a token at its right (left) edge, each with the rank at which it is merged away."""
        known = self.ends if right else self.starts
        found = known.get(token)
        if found is None:
            found, until, t = [], 1 << 60, token
            while True:
                found.append((t, until))
                if t not in self.parts:
                    break
                until = self.rank[t]
                t = self.parts[t][1 if right else 0]
            known[token] = found
        return found

    def _crossed(self, a: int, b: int, before: int) -> bool:
        """Whether a merge across the border of a and b happens earlier than rank ``before``.

        A pair at the border merges if both parts still stand at its rank. On equal ranks the pair further
        left goes first: the one inside a before the border, the border before the one inside b.
        """
        rank_of, firsts = self.merge.get, self.starts.get(b) or self._spine(b, False)
        for x, gone_x in self.ends.get(a) or self._spine(a, True):
            left, until = x << 20, gone_x if gone_x < before else before
            for y, gone_y in firsts:
                rank = rank_of(left | y, until)
                if rank < until and rank <= gone_y:
                    return True
        return False

    def is_whole(self, token: int) -> bool:
        """Whether the bytes of a token are encoded as that token."""
        known = self._whole.get(token)
        if known is None:
            if token not in self.parts:
                known = True
            else:
                l, r = self.parts[token]
                known = self.is_whole(l) and self.is_whole(r) and not self._crossed(l, r, self.rank[token])
            self._whole[token] = known
        return known

    def may_follow(self, a: int, b: int) -> bool:
        at = a << 20 | b
        known = self._follows.get(at)
        if known is None:
            if len(self._follows) > 1_000_000:
                self._follows.clear()
            known = self._follows[at] = not self._crossed(a, b, 1 << 60)
        return known

    # -- encoding -------------------------------------------------------------------------------------
    def extend(self, table: list[int], data: bytes, start: int) -> None:
        """Fill the table of last tokens for the prefixes longer than ``start``."""
        known, may_follow = self._follows.get, self.may_follow
        table.extend([-1] * (len(data) - len(table) + 1))
        # tokens that end after start can begin before it: the scan goes back by the longest token
        back = max(0, start - self.longest)
        for end, (token, size) in self.tokens.iter(data[back:].decode("latin-1")):
            i = back + end + 1
            if table[i] >= 0:
                continue
            if i != size:
                last = table[i - size]
                fits = known(last << 20 | token)
                if fits is None:
                    fits = may_follow(last, token)
                if not fits:
                    continue
            table[i] = token

    @property
    def longest(self) -> int:
        if not hasattr(self, "_longest"):
            self._longest = max(map(len, self.bytes_of.values()))
        return self._longest

    def read_off(self, table: list[int]) -> list[int]:
        out, i = [], len(table) - 1
        while i > 0:
            out.append(table[i])
            i -= len(self.bytes_of[table[i]])
        out.reverse()
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        token = self.id_of.get(data)
        if token is not None and self.is_whole(token):
            return [token]
        table = [-1]
        self.extend(table, data, 0)
        return self.read_off(table)

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers in the machine's byte order."""
        if text.isascii():
            return b"".join(map(self.pieces.__getitem__, _ASCII_PIECE.findall(text)))
        parts: list[bytes] = []
        for line in _LINE.split(text):
            if line.isascii():
                parts += map(self.pieces.__getitem__, _ASCII_PIECE.findall(line))
            else:
                parts += map(self.chunks.__getitem__, _CHUNK.findall(line))
        return b"".join(parts)

    def encode(self, text: str) -> list[int]:
        ids = array("i")
        ids.frombytes(self.encode_packed(text))
        return ids.tolist()


class _Recent(dict):
    """Ids by text in two generations: when the young one is full it becomes the old one, which is dropped then."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.old = bpe, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            ids = self.make(text)
        if len(text) <= _LONG:
            if len(self) >= _CACHED:
                self.old = dict(self)
                self.clear()
            self[text] = ids
        return ids


class _Pieces(_Recent):
    def make(self, piece: str) -> bytes:
        return array("i", self.bpe.encode_piece(piece.encode())).tobytes()


class _Chunks(_Recent):
    def make(self, chunk: str) -> bytes:
        pattern = _ASCII_PIECE if chunk.isascii() else _PIECE
        return b"".join(map(self.bpe.pieces.__getitem__, pattern.findall(chunk)))


class Prefixes:
    """The prefix table of one piece: append continues it, cut goes back to a prefix."""

    def __init__(self, bpe: Bpe, data: bytes = b""):
        self.bpe, self.data, self.table = bpe, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        self.bpe.extend(self.table, self.data, start)

    def cut(self, length: int) -> None:
        self.data = self.data[:length]
        del self.table[length + 1:]

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of data[start:stop]; gives how many bytes behind it were filled in again.

        An entry depends on no more bytes and entries before it than the longest token has. So once as many
        entries behind the edit agree with those of the old table, all later ones do, and are taken over.
        """
        old, tail, far = self.table, self.data[stop:], self.bpe.longest
        self.table = old[:start + 1]
        self.data = self.data[:start]
        self.append(new)
        shift, done = len(new) - (stop - start), 0
        while done < len(tail):
            self.append(tail[done:done + far])
            done = min(done + far, len(tail))
            here = len(self.data)
            if done >= far and self.table[here - far + 1:] == old[here - far + 1 - shift:here + 1 - shift]:
                self.table += old[here + 1 - shift:]
                self.data += tail[done:]
                break
        return done

    def ids(self) -> list[int]:
        return self.bpe.read_off(self.table)


class EncodedText:
    """A text with its ids by chunk; appends and edits encode again only the chunks they touch."""

    def __init__(self, bpe: Bpe, text: str = ""):
        self.bpe = bpe
        self.parts = _CHUNK.findall(text)
        self.packed = [bpe.chunks[c] for c in self.parts]

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def ids(self) -> list[int]:
        ids = array("i")
        ids.frombytes(b"".join(self.packed))
        return ids.tolist()

    def append(self, more: str) -> None:
        n = sum(map(len, self.parts))
        self.edit(n, n, more)

    def edit(self, start: int, stop: int, new: str) -> None:
        """Put ``new`` in place of text[start:stop].

        Behind a chunk that ends in a visible character cutting starts afresh. The chunks between the last
        such end before the edit and the first one after it are cut again, all others kept.
        """
        ends, at = [], 0
        for c in self.parts:
            at += len(c)
            ends.append(at)
        solid = [c[-1] not in _SPACES for c in self.parts]
        first = max((k + 1 for k in range(bisect_left(ends, start)) if solid[k]), default=0)
        before = ends[first - 1] if first else 0
        last = next((k + 1 for k in range(bisect_right(ends, stop), len(ends)) if solid[k]), len(ends))
        region = "".join(self.parts[first:last])
        region = region[: start - before] + new + region[stop - before:]
        parts = _CHUNK.findall(region)
        self.parts[first:last] = parts
        self.packed[first:last] = [self.bpe.chunks[c] for c in parts]


@lru_cache(maxsize=2)
def from_bytes(source: bytes) -> Bpe:
    """One encoder per process and vocabulary."""
    return Bpe(source)
