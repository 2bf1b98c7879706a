"""Byte-level BPE: backtracking encoder and offset-table decoder.

Merging pairs by rank gives one token sequence per word.  A sequence of tokens
is that one exactly when every two neighbours are compatible: encoding the
bytes of both together gives these two tokens back.  So the encoder takes the
longest token that begins at the current place (found by Aho-Corasick passes over the
word), checks it against its left neighbour, and falls back to the
next shorter token, or one token back, if the pair does not go together.  A
bit per place records dead ends, which keeps the work linear.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bytewords import small_batches
from .rows import TEXT_BATCH, asked, bound_batches, lean, schema, store

#: Bytes, about, of the words a worker remembers with their tokens or counts; beyond it the memory starts anew.
CACHE = 32 << 20
#: Token pairs whose compatibility is remembered.
PAIRS = 200_000
# The split of byte-level BPE before merging (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space as Unicode has it; the regex module counts four control characters besides.
_SPACE = r"\t-\r \x85\xa0  -     　"


def _byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_LATIN = 0x250
_beyond_latin = re.compile(f"[^\\0-{chr(_LATIN - 1)}]").search


def _latin(category: str) -> str:
    """Members of a class of pattern for the letters (L) or numbers (N) below _LATIN."""
    return "".join(chr(c) for c in range(_LATIN) if unicodedata.category(chr(c))[0] == category)


class _Memory(dict):
    """What words met before gave: ids as bytes, or a count; starts anew when it holds about CACHE bytes."""

    def __init__(self, made: Callable[[str], bytes | int]):
        self.made, self.size = made, 0

    def __missing__(self, word: str) -> bytes | int:
        value = self.made(word)
        if len(word) <= 64:
            self.size += 110 + len(word) + (0 if isinstance(value, int) else 33 + len(value))
            if self.size > CACHE:
                self.forget()
            self[word] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.size = 0


class Codec:
    """Encoder and decoder of one vocabulary file in tokenizers' JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        letter = _byte_letters()
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        as_bytes = lambda word: bytes(letter[c] for c in word)
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.token: list[bytes] = [b""] * self.size
        for word, i in vocab.items():
            self.token[i] = as_bytes(word) if word not in self.special else word.encode()
        for word, i in self.special.items():
            self.token[i] = word.encode()
        plain = {self.token[i]: i for word, i in vocab.items() if word not in self.special}

        # Merge (a, b) -> c with its rank; a token's parts are those of its own merge.
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for rank, merge in enumerate(merges):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = vocab[left], vocab[right]
            c = vocab[left + right]
            self.rank.setdefault((a, b), rank)
            if c not in self.parts:
                self.parts[c], self.born[c] = (a, b), rank
        # Tokens that their own bytes encode to; only such can stand in a result.
        live = {i for word, i in plain.items() if len(word) == 1}
        self._compatible: dict[int, bool] = {}
        for c in sorted(self.parts, key=self.born.get):
            a, b = self.parts[c]
            if a in live and b in live and self._pair(a, b, self.born[c]):
                live.add(c)
        # A live word is its own encoding.
        self.plain = {word: i for word, i in plain.items() if i in live}

        # Longest tokens: the automaton goes from token to token, always taking the longest.
        self.matcher = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for word, i in self.plain.items():
            self.matcher.add_word(word.decode("latin-1"), i)
        self.matcher.make_automaton()
        # The next shorter token that begins like a token.
        self.shorter = np.full(self.size, -1, np.int64)
        for word, i in plain.items():
            for n in range(len(word) - 1, 0, -1):
                j = self.plain.get(word[:n])
                if j is not None:
                    self.shorter[i] = j
                    break
        self.shorter = self.shorter.tolist()
        self.length = [len(t) for t in self.token]

        # Decoding: all token bytes in one blob, and where each begins.
        self.blob = np.frombuffer(b"".join(self.token), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)

        pattern = SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]")
        pattern = pattern.replace(r"(?!\S)", rf"(?![^{_SPACE}])").replace(r"\s+", rf"[{_SPACE}]+")
        self.pattern = regex.compile(pattern)
        # The same for texts of Latin letters, with the letters and digits written out: half the time.
        for name in ("L", "N"):
            pattern = pattern.replace(rf" ?\p{{{name}}}+", f" ?[{_latin(name)}]+").replace(rf"\p{{{name}}}", _latin(name))
        self.latin = re.compile(pattern)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.cache = _Memory(lambda word: array("I", self.encode_word(word.encode())).tobytes())
        self.counts = _Memory(self._count)
        self._counter: Callable[[str], int] | None = None
        self.decimal = [str(i) for i in range(self.size)]

    def _pair(self, a: int, b: int, limit: int = 1 << 62) -> bool:
        """Whether tokens a, b stay apart when merges below ``limit`` run over both together.

        Walks both tokens' last merges backwards.  At every step the two parts
        that touch must not have a merge that ran before the later of the two
        merges that hid them.
        """
        while True:
            rank = self.rank.get((a, b))
            if rank is not None and rank < limit:
                return False
            born_a, born_b = self.born.get(a, -1), self.born.get(b, -1)
            if born_a < 0 and born_b < 0:
                return True
            # Undo the later merge.  Of equal ones the left ran first, so the right is undone.
            if born_a > born_b:
                limit = born_a
                a = self.parts[a][1]
            else:
                limit = born_b + 1
                b = self.parts[b][0]

    def compatible(self, a: int, b: int) -> bool:
        """Pair table, filled as pairs are asked for."""
        key = a * self.size + b
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) >= PAIRS:
                self._compatible.clear()
            known = self._compatible[key] = self._pair(a, b)
        return known

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Token ids of one word, as merging by rank gives them."""
        n = len(word)
        if not n:
            return ()
        whole = self.plain.get(word)
        if whole is not None:
            return (whole,)
        # The longest tokens one after the other; where all neighbours go together, that is it.
        latin = word.decode("latin-1")
        longest = [token for _, token in self.matcher.iter_long(latin)]
        known = self._compatible
        size = self.size
        left = longest[0]
        for i, token in enumerate(longest):
            if i:
                fits = known.get(left * size + token)
                if fits is None:
                    fits = self.compatible(left, token)
                if not fits:
                    return self._backtracked(latin, longest, i)
                left = token
        return tuple(longest)

    def _backtracked(self, latin: str, first: list[int], fitting: int) -> tuple[int, ...]:
        """Tokens of a word, going on from the ``fitting`` longest tokens at its start that go together.

        The longest token at a place is asked for when the place is reached.
        """
        n, length = len(latin), self.length
        longest = [-1] * n
        begin = 0
        for token in first:
            longest[begin] = token
            begin += length[token]
        open_ = bytearray(b"\x01" * (n + 1))
        out = first[:fitting]
        place = sum([length[t] for t in out])
        token = longest[place]
        while place < n:
            left = out[-1] if out else -1
            while token >= 0:
                end = place + length[token]
                if open_[end] and (left < 0 or self.compatible(left, token)):
                    out.append(token)
                    place = end
                    if place < n:
                        token = longest[place]
                        if token < 0:
                            for stop, found in self.matcher.iter_long(latin, place):
                                begin = stop + 1 - length[found]
                                if longest[begin] >= 0:
                                    break
                                longest[begin] = found
                            token = longest[place]
                    break
                token = self.shorter[token]
            else:
                # Nothing fits here after this left neighbour: the place is a dead end.
                open_[place] = 0
                token = out.pop()
                place -= length[token]
                token = self.shorter[token]
        return tuple(out)

    def _count(self, word: str) -> int:
        if self._counter is None:
            self._counter = self.counter()
        return self._counter(word)

    def _pattern(self, text: str):
        return self.pattern if _beyond_latin(text) else self.latin

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        return self._pattern(text).findall(text)

    def find(self, text: str, begin: int = 0) -> Iterator:
        """Matches of the pre-tokens from a place on where one begins."""
        return self._pattern(text).finditer(text, begin)

    def counter(self) -> Callable[[str], int]:
        """Counts the tokens of a word, by tiktoken's merging where it agrees with this vocabulary.

        tiktoken joins any two parts that make a token, this vocabulary only
        those of its merges.  The results are the same unless two other parts
        of a token can stand side by side when its turn comes.
        """
        whole = all(bytes([b]) in self.plain for b in range(256))
        ranks = {word: 256 + self.born[i] if i in self.born else word[0] for word, i in self.plain.items()}
        if whole and len(self.plain) == len({*self.token}) - len(self.special) and not any(map(self._joins_otherwise, self.parts)):
            import tiktoken

            encode = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            return lambda word: len(encode(word))
        return lambda word: len(self.encode_word(word.encode()))

    def _joins_otherwise(self, token: int) -> bool:
        word = self.token[token]
        for n in range(1, len(word)):
            a, b = self.plain.get(word[:n]), self.plain.get(word[n:])
            if a is not None and b is not None and (a, b) != self.parts[token] and self._pair(a, b, self.born[token]):
                return True
        return False

    def ids(self, text: str) -> np.ndarray:
        """Token ids of a text."""
        words = self.cache.__getitem__
        if not self.has_special(text):
            return np.frombuffer(b"".join(map(words, self.split(text))), np.uint32)
        out: list[bytes] = []
        for part in self.cut(text):
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            else:
                out.extend(map(words, self.split(part)))
        return np.frombuffer(b"".join(out), np.uint32)

    def encode(self, text: str) -> list[int]:
        return self.ids(text).tolist()

    def forget(self) -> None:
        """Drop what was remembered; a task's words are mostly its own."""
        self.cache.forget()
        self.counts.forget()
        self._compatible.clear()

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def spans(self, text: str, begin: int = 0) -> Iterator[tuple[int, int]]:
        """Places of the pre-tokens from a place on where one begins; special tokens count as one."""
        if not self.has_special(text):
            for match in self.find(text, begin):
                yield match.span()
            return
        for part in self.cut(text[begin:]):
            if part in self.special:
                yield begin, begin + len(part)
            else:
                for match in self.find(part):
                    yield begin + match.start(), begin + match.end()
            begin += len(part)

    def n_tokens(self, word: str) -> int:
        """Tokens of one pre-token or special token."""
        return 1 if word in self.special else self.counts[word]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of tokens, gathered through the offset table piece by piece."""
        parts = []
        for at in range(0, len(ids), 1 << 18):
            piece = ids[at:at + (1 << 18)]
            begin, size = self.offset[piece], self.offset[piece + 1] - self.offset[piece]
            before = np.cumsum(size) - size
            parts.append(self.blob[np.arange(int(size.sum())) + np.repeat(begin - before, size)].tobytes())
        return b"".join(parts)

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = store()


def codec(path: str) -> Codec:
    """Codec of a vocabulary file, made once per worker."""
    made = asked(_CODECS)
    if path not in made:
        made[path] = Codec(path)
    return made[path]


def encode_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """``keep`` columns with <n_tokens, ids_sha256, decoded_sha256> and, if asked for, <ids>.

    * Null text counts as empty: no tokens, digests of the empty text.
    * The text is taken whole; each row by itself, repeated rows too.
    * ``decoded_sha256`` is of the text that decoding the ids gives.
    * ``path`` must be readable on every executor; other columns are not read.
    """
    bound_batches(docs.sparkSession, TEXT_BATCH)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        decimal = own.decimal.__getitem__
        for batch in small_batches(batches):
            texts = batch.column("text")
            count, digest, back, lists = [], [], [], []
            for i in range(len(batch)):
                tokens = own.ids(texts[i].as_py() or "")
                count.append(len(tokens))
                digest.append(sha256(",".join(map(decimal, tokens.tolist())).encode()).hexdigest())
                # Text in, text out: UTF-8 again, replacement characters included.
                back.append(sha256(own.decode(tokens).encode()).hexdigest())
                if ids:
                    lists.append(tokens.astype(np.int32))
            arrays = [*[batch.column(c) for c in keep], pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                arrays.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        own.forget()

    more = ", ids array<int>" if ids else ""
    return docs.select(*keep, "text").mapInArrow(run, schema(docs, keep, f"n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}"))


def decode_documents(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with <text> from <ids>; null ids give null text."""
    bound_batches(encoded.sparkSession, TEXT_BATCH)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [None if x.as_py() is None else own.decode(x.as_py()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, "text"])

    return encoded.select(*keep, "ids").mapInArrow(run, schema(encoded, keep, "text string"))
