"""Exact byte-level BPE for whole documents, and token counts at every prefix.

``ByteBpe`` gives the ids that the tokenizers library gives for a byte-level BPE file. A text
is cut at every space that stands between two other characters, as a token never crosses one,
and the ids of each such chunk are remembered: running prose repeats its words.

``PrefixCounter`` fills, for each chunk, a dynamic programme over its bytes: the last token of
the encoding of a prefix is the one vocabulary entry t that ends there and that may follow the
last token of the prefix before t; the count is one more than there. The counts at all prefixes
of a document are the chunks' counts one after another, kept as differences.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cached_property, lru_cache
from operator import sub

import numpy as np

#: Entries (about 150 bytes each) that a worker remembers in one table before it starts anew.
REMEMBERED = 200_000
#: Chunks that a prefix counter remembers before its table becomes the older one: what is met again goes
#: on to the new table, so that frequent words stay while rare ones go.
CHUNKS = 300_000

#: The usual byte-level cutting rule, in the syntax of ``re``; [^\W\d_] with the numbers that
#: are not decimal digits taken out is \p{L}. Used only below FIRST_OTHER.
_CUT = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_²³¹¼½¾]+| ?[\d²³¹¼½¾]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: White space by the Unicode property, as the library sees it.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_WHITE}]{{2,}}(?=[^{_WHITE}])")
#: Code points from this on (U+0250), and control characters that are white space for Python but not
#: for the library, go to the library itself, whose character tables decide.
#: Bytes of a pretoken's beginning whose states are kept.
_HEAD = 6
#: Token lengths to try where no longer one ends in the same three bytes.
_SHORT = (2, 1)
#: Marks that are a pretoken of their own after a word.
_MARKS = ".,;:!?"
_ODD = re.compile("[\x1c-\x1fɐ-\U0010ffff]")


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in plain)
    return out | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Encodes with the vocabulary at ``path``, a tokenizers file of kind byte-level BPE."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = (spec.get("pre_tokenizer") or {}).get("type")
        if spec["model"]["type"] != "BPE" or kind != "ByteLevel" or spec.get("normalizer"):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        byte_of = _byte_of()
        self.ranks = {
            bytes(byte_of[c] for c in word): i
            for word, i in spec["model"]["vocab"].items()
            if word not in self.special
        }
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self._piece = self._fast._core_bpe.encode_single_piece
        self.width = np.dtype("<u2") if max(self.ranks.values()) < 65536 and len(spec["model"]["vocab"]) <= 65536 else np.dtype("<u4")
        self._code = "H" if self.width.itemsize == 2 else "I"
        self._chunks: dict[str, bytes | None] = {}

    @cached_property
    def library(self):
        """The tokenizers library's own, for what needs it."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        library.no_truncation()
        library.no_padding()
        return library

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one pretoken."""
        return self._piece(piece)

    def slow(self, text: str) -> list[int]:
        """Ids without remembering; special strings are their own tokens, as by default."""
        if _ODD.search(text) or any(s in text for s in self.special):
            return self.library.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)

    def _chunk(self, chunk: str) -> bytes | None:
        if len(self._chunks) >= REMEMBERED:
            self._chunks.clear()
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            got = None  # white space in a row: where it is cut depends on what follows
        elif _ODD.search(chunk):
            got = array(self._code, self.slow(" " + chunk)).tobytes()
        elif chunk.isalpha():
            got = array(self._code, self._piece((" " + chunk).encode())).tobytes()
        elif chunk[-1] in _MARKS and chunk[:-1].isalpha():
            word = self._chunks.get(chunk[:-1]) or self._chunk(chunk[:-1])
            got = word + array(self._code, self._piece(chunk[-1].encode())).tobytes()
        else:
            got = array(self._code, self._fast.encode_ordinary(" " + chunk)).tobytes()
        self._chunks[chunk] = got
        return got

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; null is empty."""
        if not text:
            return np.zeros(0, self.width)
        first, *chunks = text.split(" ")
        if not chunks or not first or first[-1].isspace() or any(s in text for s in self.special):
            return np.array(self.slow(text), self.width)
        known = self._chunks
        found = list(map(known.get, chunks))
        if None in found:
            for k, got in enumerate(found):
                if got is None:
                    found[k] = known[chunks[k]] if chunks[k] in known else self._chunk(chunks[k])
                    if found[k] is None:
                        return np.array(self.slow(text), self.width)
        head = array(self._code, self.slow(first)).tobytes()
        return np.frombuffer(head + b"".join(found), self.width)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """One for each worker and file."""
    return ByteBpe(path)


class PrefixCounter:
    """Exact token counts at every prefix of a text."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self._follows: dict[int, bool] = {}
        self._heads: dict[bytes, tuple] = {}
        self._chunks: dict[str, bytes | None] = {}
        self._older: dict[str, bytes | None] = {}
        self._tokens = {i: t for t, i in bpe.ranks.items()}
        ends: dict[bytes, set] = {}
        for t in bpe.ranks:
            if len(t) > 2:
                ends.setdefault(t[-3:], set(_SHORT)).add(len(t))
        self._ends = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}

    def _may_follow(self, a: int, b: int) -> bool:
        key = (a << 32) | b
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) >= REMEMBERED:
                self._follows.clear()
            known = self._follows[key] = self.bpe.piece(self._tokens[a] + self._tokens[b]) == [a, b]
        return known

    def by_byte(self, piece: bytes) -> list[int]:
        """Token count of every byte prefix of one pretoken, the empty one first."""
        n, ranks, may_follow = len(piece), self.bpe.ranks, self._may_follow
        head = piece[:_HEAD]
        known = self._heads.get(head) if n > _HEAD else None
        if known:  # words share their beginnings
            last, count = known[0][:], known[1][:]
        else:
            last, count = [0], [0]
        get, ends = ranks.get, self._ends
        for i in range(len(last), n + 1):
            for size in ends.get(piece[i - 3 : i], _SHORT) if i > 2 else _SHORT:
                if size > i:
                    continue
                j = i - size
                t = get(piece[j:i])
                if t is not None and (j == 0 or may_follow(last[j], t)):
                    last.append(t)
                    count.append(count[j] + 1)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        if n > _HEAD and not known:
            if len(self._heads) >= REMEMBERED // 4:
                self._heads.clear()
            self._heads[head] = last[: _HEAD + 1], count[: _HEAD + 1]
        return count

    def _piece_deltas(self, piece: str) -> array:
        """Differences of the counts at the ends of the piece's characters."""
        if piece in ("'re", "'ve", "'ll"):  # cut before its end, it is two pretokens
            one, two, all_ = (len(self.bpe.piece(x.encode())) for x in (piece[0], piece[1], piece))
            return array("h", [one, two, all_ - one - two])
        count = self.by_byte(piece.encode())
        if len(count) > len(piece) + 1:
            end, at = 0, [0]
            for c in piece:
                end += 1 if c < "\x80" else len(c.encode())
                at.append(count[end])
            count = at
        return array("h", map(sub, count[1:], count))

    def _ordinary(self, text: str) -> np.ndarray:
        """Differences for a text without special strings, cut by the rule as a whole."""
        if _ODD.search(text):
            pieces = [text[a:b] for _, (a, b) in self.bpe.library.pre_tokenizer.pre_tokenize_str(text)]
        else:
            pieces = _CUT.findall(text)
        out = np.frombuffer(bytearray().join([self._piece_deltas(p) for p in pieces]), np.int16)
        for run in _RUN.finditer(text):
            # A prefix that ends with the run has it as one pretoken; the whole text has its
            # last character apart.
            a, e = run.span()
            whole = sum(self._piece_deltas(text[a:e]))
            apart = sum(self._piece_deltas(text[a : e - 1])) + out[e - 1]
            out[e - 1] += whole - apart
            out[e] -= whole - apart
        return out

    def _chunk(self, chunk: str) -> bytes | None:
        if len(self._chunks) >= CHUNKS:
            self._chunks, self._older = {}, self._chunks
        got = self._older.get(chunk)
        if got is not None:
            self._chunks[chunk] = got
            return got
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            got = None
        elif chunk.isalpha() and not _ODD.search(chunk):
            got = self._piece_deltas(" " + chunk).tobytes()
        elif _ODD.search(chunk) or _RUN.search(chunk):
            got = self._ordinary(" " + chunk).tobytes()
        else:
            got = b"".join([self._known(p) for p in _CUT.findall(" " + chunk)])
        self._chunks[chunk] = got
        return got

    def _known(self, piece: str) -> bytes:
        """Of a pretoken that may already be known as a chunk or as itself."""
        key = piece[1:] if piece[0] == " " and piece[1:].isalpha() else "\0" + piece
        got = self._chunks.get(key)
        if got is None:
            got = self._older.get(key) or self._piece_deltas(piece).tobytes()
            self._chunks[key] = got
        return got

    def deltas(self, text: str | None) -> np.ndarray:
        """int16 for each code point: the prefix's count with it less the count without it.

        The sum of the first k is the exact token count of ``text[:k]``."""
        if not text:
            return np.zeros(0, np.int16)
        if any(s in text for s in self.bpe.special):
            return self._with_special(text)
        first, *chunks = text.split(" ")
        if not chunks or not first or first[-1].isspace():
            return self._ordinary(text)
        found = list(map(self._chunks.get, chunks))
        if None in found:
            for k, got in enumerate(found):
                if got is None:
                    found[k] = self._chunks[chunks[k]] if chunks[k] in self._chunks else self._chunk(chunks[k])
                    if found[k] is None:
                        return self._ordinary(text)
        return np.frombuffer(self._ordinary(first).tobytes() + b"".join(found), np.int16)

    def _with_special(self, text: str) -> np.ndarray:
        """A special string counts as one token from its last character on; a prefix that ends
        inside it is ordinary text."""
        parts = re.split("(" + "|".join(map(re.escape, sorted(self.bpe.special, key=len, reverse=True))) + ")", text)
        out = []
        for plain, special in zip(parts[::2], [*parts[1::2], ""]):
            inside = self._ordinary(plain + special[:-1]) if special else self._ordinary(plain)
            alone = int(self._ordinary(plain).sum()) if special else 0
            out.append(inside)
            if special:
                out.append(np.array([alone + 1 - int(inside.sum())], np.int16))
        return np.concatenate(out)


@lru_cache(maxsize=4)
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(byte_bpe(path))


def longest_prefix(deltas: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens. Counts can fall where a
    longer token replaces several, so it is the last place that fits, not the first that
    doesn't."""
    fits = np.flatnonzero(np.cumsum(deltas, dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0
