"""Pre-tokens of many texts at once, and their token ids by the library.

The two public vocabularies of the ``tokenizers`` library used here split a text into pre-tokens and encode each of them
by itself. The split is done for a whole batch of texts in numpy: characters get a class, classes give the boundaries,
and each pre-token becomes a 64-bit hash. Only pre-tokens that are not known yet go to the library's model.

A character's class is asked from the library's own pre-tokenizer when the character first appears, so both agree on it.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
UNKNOWN = 255
#: The contractions that both split patterns name.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@lru_cache(maxsize=1)
def _mix() -> tuple[np.ndarray, np.ndarray]:
    """Random 64-bit values for code points and odd multipliers for places in a pre-token."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    table = rng.integers(0, 2**64, 0x110000, dtype=np.uint64)
    odd = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return table, odd


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself if printable, else 256 and up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


BYTE_LETTERS = {b: c for b, c in enumerate(_byte_letters())}


class Splitter:
    """Pre-tokens of texts under one vocabulary file of the tokenizers library (byte-level, or words without white space)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        probe = self.tokenizer.pre_tokenizer.pre_tokenize_str("a b 12")
        #: Whether a pre-token takes the space before it and numbers stay together.
        self.joins_space = len(probe) == 3
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)))
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)

    def _classify(self, points: np.ndarray) -> None:
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for p in points.tolist():
            c = chr(p)
            # Beside a character of its own class a character stays in one pre-token; number runs may be cut, so see both.
            if len(split("a" + c)) == 1 and len(split(c + "a")) == 1 and split("a" + c)[0][1] == (0, 2):
                kind = LETTER
            elif len(split("!" + c)) == 1 and split("!" + c)[0][1] == (0, 2):
                kind = OTHER
            elif len(split("a" + c + "a")) == 3:
                kind = NUMBER if self._is_number(c) else SPACE
            else:
                kind = SPACE
            self.classes[p] = kind

    def _is_number(self, c: str) -> bool:
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        return len(split("1" + c)) == 1 if self.joins_space else True

    def normalized(self, text: str) -> str:
        n = self.tokenizer.normalizer
        if n is None:
            return text
        # Below U+0250 lower-casing is letter by letter and NFC changes nothing; the dotted capital I is the exception.
        if text.isascii() or (max(text) < "ɐ" and "İ" not in text):
            return text.lower()
        return n.normalize_str(text)

    def split(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The joined text, and per pre-token its text's number, start, end and hash. Texts must hold no special string."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        n = len(joined)
        if not n:
            z = np.zeros(0, np.int64)
            return joined, z, z, z, np.zeros(0, np.uint64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.classes[points]
        if (kind == UNKNOWN).any():
            self._classify(np.unique(points[kind == UNKNOWN]))
            kind = self.classes[points]
        first = np.zeros(n + 1, bool)
        first[np.cumsum(lens)[lens > 0] - lens[lens > 0]] = True
        first[n] = True
        text_start = first.copy()

        start = np.empty(n, bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= text_start[:n]
        self._contractions(joined, points, kind, start, text_start)
        if self.joins_space:
            self._spaces(points, kind, start, text_start)
            starts = np.flatnonzero(start)
        else:
            start |= kind == NUMBER
            starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)
        if not self.joins_space:
            keep = kind[starts] != SPACE
            starts, ends = starts[keep], ends[keep]
        number = np.searchsorted(np.cumsum(lens), starts, side="right")
        return joined, number, starts, ends, self._hashes(points, starts, ends)

    def _contractions(self, joined, points, kind, start, text_start) -> None:
        at = np.flatnonzero((points == 39) & start[: len(points)])
        n = len(points)
        for i in at.tolist():
            if self.joins_space and i and points[i - 1] == 32 and not text_start[i]:
                continue
            if not start[i]:
                continue
            for c in CONTRACTIONS:
                j = i + len(c)
                if j <= n and joined.startswith(c, i) and not text_start[i + 1 : j].any():
                    start[i + 1 : j] = False
                    if j < n:
                        start[j] = True
                    break

    @staticmethod
    def _spaces(points, kind, start, text_start) -> None:
        """A white-space run before another character gives up its last one: a plain space joins what follows."""
        n = len(points)
        space = kind == SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~text_start[1:n]) if n > 1 else np.zeros(0, np.int64)
        start[last] = True
        plain = last[points[last] == 32]
        start[plain + 1] = False

    def _hashes(self, points, starts, ends) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        table, odd = _mix()
        lens = ends - starts
        if int(starts[0]) == 0 and int(ends[-1]) == len(points) and int(lens.sum()) == len(points):
            used = points
        else:
            used = points[np.arange(int(lens.sum())) + np.repeat(starts - np.cumsum(lens) + lens, lens)]
        offs = np.cumsum(lens) - lens
        place = (np.arange(len(used)) - np.repeat(offs, lens)).astype(np.int64)
        value = table[used] * odd[place & 255]
        long = place >= 256
        if long.any():
            value[long] *= (place[long].astype(np.uint64) >> np.uint64(8)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        out = np.add.reduceat(value, offs)
        out += lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
        return out

    def ids_of(self, piece: str) -> list[int]:
        """Token ids of one pre-token by the library's model."""
        word = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def special_in(self, text: str) -> bool:
        return any(s in text for s in self.specials)

    def between_specials(self, text: str) -> list[str]:
        """The stretches of a text around its special strings."""
        return self._special.split(text) if self.special_in(text) else [text]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


#: Longer texts are split in parts.
PART = 1 << 20
_WORD_END = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def parts(text: str) -> list[str]:
    """A long text in parts, cut before a space between two letters, where every pre-token ends; others stay whole."""
    out, at = [], 0
    while len(text) - at > PART and (cut := _WORD_END.search(text, at + PART)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


class Encoder:
    """Token ids of batches of texts; what a worker has seen is kept in a table of bounded size."""

    SLOTS = 22
    STORE = 1_500_000

    def __init__(self, path: str):
        self.splitter = Splitter(path)
        self._reset()

    def _reset(self) -> None:
        self.key = np.zeros(1 << self.SLOTS, np.uint64)
        self.val = np.full(1 << self.SLOTS, -1, np.int32)
        self.offs, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids as uint32, and the number of ids of each text."""
        odd = [i for i, t in enumerate(texts) if len(t) > PART or self.splitter.special_in(t)]
        if not odd:
            return self._plain(texts)
        plain = list(texts)
        for i in odd:
            plain[i] = ""
        ids, counts = self._plain(plain)
        ends = np.cumsum(counts)
        out, at = [], 0
        for i in odd:
            out += [ids[at : ends[i]], self._alone(texts[i])]
            at, counts[i] = ends[i], len(out[-1])
        return np.concatenate([*out, ids[at:]]), counts

    def _alone(self, text: str) -> np.ndarray:
        """Ids of a text with special strings or of great length."""
        if self.splitter.special_in(text):
            return np.array(self.splitter.whole(text), np.uint32)
        return np.concatenate([self._plain([p])[0] for p in parts(text)])

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        s = self.splitter
        joined, number, starts, ends, hashes = s.split([s.normalized(t) for t in texts])
        if len(self.offs) > self.STORE:
            self._reset()
        slot = (hashes >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        piece = np.where(self.key[slot] == hashes, self.val[slot], -1)
        miss = np.flatnonzero(piece < 0)
        if len(miss):
            new, at, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            found = [s.ids_of(joined[a:b]) for a, b in zip(starts[miss[at]].tolist(), ends[miss[at]].tolist())]
            lens = np.fromiter(map(len, found), np.int64, len(found))
            base = len(self.offs) - 1
            self.flat = np.concatenate([self.flat, np.fromiter((i for f in found for i in f), np.uint32, int(lens.sum()))])
            self.offs = np.concatenate([self.offs, self.offs[-1] + np.cumsum(lens)])
            where = (new >> np.uint64(64 - self.SLOTS)).astype(np.int64)
            self.key[where], self.val[where] = new, base + np.arange(len(new), dtype=np.int32)
            piece[miss] = base + back
        begin = self.offs[piece]
        lens = self.offs[piece + 1] - begin
        total = np.cumsum(lens)
        ids = self.flat[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(begin - total + lens, lens)]
        return ids, np.bincount(number, lens, len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    return Splitter(path)
