"""Byte-pair encoding as a lazily determinised finite-state transducer, and an incremental decoder.

The merges of a byte-level vocabulary are compiled into a transducer over bytes. Two facts make it finite and its lookahead
bounded. First, a sequence of tokens is the encoding of its text exactly if each token, and each pair of neighbours, is the
encoding of its own bytes; so whether a token may follow depends on the token before it alone. Second, of all tokens that end
at a position exactly one can follow what precedes it; so every prefix has one last token, and the prefixes form a tree.
A state holds what can still matter: the last token that is settled and the bytes read since, at most as many as the longest
token has. When all positions at which a longer token could still begin agree on a token, it is emitted. States and
transitions are made when first needed and kept in tables, so the usual step is one look-up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import regex


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The vocabulary of a rank file: lines of a token in base64 and its id; blank lines are ignored."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class MergeTransducer:
    """Encodes byte strings that no merge leaves, one at a time (the pre-tokens of a text)."""

    #: Tables are emptied beyond these sizes and fill again; results do not depend on them.
    MAX_STATES = 400_000
    MAX_PAIRS = 4_000_000

    def __init__(self, ranks: dict[bytes, int]):
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.begun = {t[:k] for t in ranks for k in range(1, len(t))}  # what can still grow into a token
        self._pairs: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self._ids: dict[tuple, int] = {}
        self._states: list[tuple] = []  # (settled token or -1, pending bytes, last token of each pending prefix)
        self._next: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self._flush: list[tuple[int, ...] | None] = []
        self._state(-1, b"", ())

    def _state(self, settled: int, pending: bytes, last: tuple) -> int:
        key = (settled, pending)
        i = self._ids.get(key)
        if i is None:
            i = self._ids[key] = len(self._states)
            self._states.append((settled, pending, last))
            self._next.append({})
            self._flush.append(None)
        return i

    def merged(self, piece: bytes) -> list[int]:
        """The plain definition: the adjacent pair of the lowest rank merges first, the leftmost of equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _follows(self, before: int, token: int) -> bool:
        """Whether `token` after `before` (-1: at the start) is how their bytes are encoded."""
        key = (before, token)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= self.MAX_PAIRS:
                self._pairs.clear()
            t = self.bytes_of[token]
            known = self.merged(t) == [token] if before < 0 else self.merged(self.bytes_of[before] + t) == [before, token]
            self._pairs[key] = known
        return known

    def _chain(self, last: tuple, end: int) -> list[int]:
        """Positions from `end` back to 0 along the tokens that end there."""
        chain = [end]
        while end:
            end -= len(self.bytes_of[last[end - 1]])
            chain.append(end)
        return chain

    def _tokens(self, last: tuple, chain: Iterable[int]) -> tuple[int, ...]:
        return tuple(last[p - 1] for p in reversed(list(chain)) if p)

    def _extend(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        settled, pending, last = self._states[state]
        pending += bytes((byte,))
        n = len(pending)
        token = None
        for j in range(n):
            if j and last[j - 1] is None:
                continue
            t = self.ranks.get(pending[j:])
            if t is not None and self._follows(last[j - 1] if j else settled, t):
                token = t
                break
        assert token is not None, "every byte is a token, so some token ends everywhere"
        last = (*last, token)
        # positions before which no token can begin any more are forgotten; all others must agree on what is emitted
        live = [j for j in range(n) if (j == 0 or last[j - 1] is not None) and pending[j:] in self.begun]
        chain = self._chain(last, n)
        common = set(chain)
        for j in live:
            common &= set(self._chain(last, j))
        cut = max(common)
        emitted = self._tokens(last, [p for p in chain if p <= cut])
        keep = set()
        for j in (*live, n):
            keep.update(self._chain(last, j))
        rest = tuple(last[p - 1] if p in keep else None for p in range(cut + 1, n + 1))
        return self._state(last[cut - 1] if cut else settled, pending[cut:], rest), emitted

    def encode_piece(self, piece: bytes) -> list[int]:
        if len(self._states) > self.MAX_STATES:
            self._clear()
        out: list[int] = []
        state, tables = 0, self._next
        for b in piece:
            step = tables[state].get(b)
            if step is None:
                step = tables[state][b] = self._extend(state, b)
            state, emitted = step
            if emitted:
                out += emitted
        end = self._flush[state]
        if end is None:
            _, pending, last = self._states[state]
            end = self._flush[state] = self._tokens(last, self._chain(last, len(pending)))
        out += end
        return out


class ByteBPE:
    """Text to ids and back. Strings that look like special tokens are ordinary text; no special token is added."""

    MAX_WORDS = 300_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = MergeTransducer(ranks)
        self._split = regex.compile(pattern).findall
        self._words: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of the text; none for an empty or null text."""
        if not text:
            return []
        words, out = self._words, []
        for w in self._split(text):
            ids = words.get(w)
            if ids is None:
                if len(words) >= self.MAX_WORDS:
                    words.clear()
                ids = self.transducer.encode_piece(w.encode("utf-8"))
                if len(w) <= 64:
                    words[w] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids))

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as it is complete; bytes that are no UTF-8 become U+FFFD."""
        machine = Utf8Machine()
        for i in ids:
            if (part := machine.feed(self.transducer.bytes_of[i])) != "":
                yield part
        if (part := machine.finish()) != "":
            yield part


class Utf8Machine:
    """Incremental UTF-8: a state is the number of bytes still due and the range the next one has to lie in.

    Each maximal part of an ill-formed sequence gives one U+FFFD, as the Unicode standard recommends.
    """

    def __init__(self) -> None:
        self.due, self.low, self.high, self.value = 0, 0x80, 0xBF, 0

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        for b in data:
            if self.due:
                if self.low <= b <= self.high:
                    self.value = self.value << 6 | b & 0x3F
                    self.due -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.due:
                        out.append(chr(self.value))
                    continue
                out.append("�")
                self.due, self.low, self.high = 0, 0x80, 0xBF
            self._lead(b, out)
        return "".join(out)

    def _lead(self, b: int, out: list[str]) -> None:
        if b < 0x80:
            out.append(chr(b))
        elif 0xC2 <= b <= 0xDF:
            self.due, self.value = 1, b & 0x1F
        elif 0xE0 <= b <= 0xEF:
            self.due, self.value = 2, b & 0x0F
            self.low, self.high = 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
        elif 0xF0 <= b <= 0xF4:
            self.due, self.value = 3, b & 0x07
            self.low, self.high = 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
        else:
            out.append("�")

    def finish(self) -> str:
        rest = "�" if self.due else ""
        self.__init__()
        return rest
