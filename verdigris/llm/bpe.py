"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

``Merges.lookahead`` is how many symbols to the right of a token can still change it, from the merge list alone: a merge of rank r can be undone only by a
merge of lower rank that takes its right part, or a part on that part's right edge, and what follows; that merge in turn only by one of lower rank.  A pass over the
merges in order of rank sums the longest such chain.  ``Stream`` keeps a window of symbols; once it holds more than the lookahead behind
a token, the token is stable and goes out, so memory stays constant however long a word is.  A word's end flushes the window.

Decoding is the mirror image: ``Decoder`` takes ids as they come and gives their strings, one blank between two, as the tokenizer file asks (it names no decoder);
``text_of`` is the byte-level state machine that turns token strings into bytes, and bytes into characters as soon as a character is whole.

The normalisation and splitting rules are those of the tokenizer file: NFC, white space to one blank, lower case character by character, contractions, letters,
single digits, other signs; special tokens are cut out first.  White space always ends a piece, so a text is encoded as its words, and words are remembered in a
dictionary of bounded size, which ends with the task.  The new words of a batch are merged side by side: a row each, whose whole window is in reach, so it is stable at its end.

Edge cases: null and empty texts have no ids, and decode to the empty string; white space alone likewise; lone special tokens in a text are encoded as such;
characters that the vocabulary lacks cannot occur, as all 256 bytes are in it; equal rows give equal values; extra columns pass through ``encoded``.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Remembered, batches, bounded, given_back, strings, uncollected

#: Words in each of the two generations that a task remembers.
REMEMBERED = 200_000
#: Bytes of a piece up to which pieces are merged side by side.
NARROW = 24
_LOW, _NONE = (1 << 32) - 1, 1 << 80
_FAR = (1 << 63) - 1


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable in Latin-1, else the next one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in own else chr(256 + extra))
        extra += b not in own
    return out


class Merges:
    """The merge list as left id and right id -> rank and merged id, each pair as one number."""

    def __init__(self, model: dict) -> None:
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.length: dict[int, int] = {}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        for rank, (a, b) in enumerate(pairs):
            left, right = self.vocabulary[a], self.vocabulary[b]
            made = self.vocabulary[a + b]
            self.rank.setdefault(left << 32 | right, rank << 32 | made)
            self.parts.setdefault(made, (left, right))
        self.letter = [self.vocabulary.get(c) for c in byte_letters()]
        self.last = [self.vocabulary.get(c + self.suffix) for c in byte_letters()]
        self.lookahead = self._lookahead()

    def width(self, token: int) -> int:
        """Symbols that the token spans."""
        if token not in self.length:
            parts = self.parts.get(token)
            self.length[token] = 1 if parts is None else self.width(parts[0]) + self.width(parts[1])
        return self.length[token]

    def right_edge(self, token: int) -> list[int]:
        """The token, its right part, that one's right part, and so on."""
        edge = [token]
        while token in self.parts:
            token = self.parts[token][1]
            edge.append(token)
        return edge

    def _lookahead(self) -> int:
        """The longest chain of merges of falling rank, each taking the right edge of the one before, plus the longest token."""
        reach: dict[int, int] = {}  # token -> symbols read to its right by the merges so far that have it on the left
        most, widest = 0, 1
        for pair, found in self.rank.items():
            left, right, made = pair >> 32, pair & _LOW, found & _LOW
            need = max(reach.get(x, 0) for x in self.right_edge(right))
            reach[left] = max(reach.get(left, 0), self.width(right) + need)
            most, widest = max(most, need), max(widest, self.width(made))
        return most + widest

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs in ascending order, and what the merge list says of each."""
        keys = np.array(list(self.rank), np.int64)
        order = np.argsort(keys)
        return keys[order], np.array(list(self.rank.values()), np.int64)[order]

    def merged(self, ids: list[int]) -> list[int]:
        """All merges applied, lowest rank first and leftmost first."""
        get = self.rank.get
        while len(ids) > 1:
            found = [get(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])]  # noqa: B905, RUF007  in the innermost loop
            best = min(found)
            if best == _NONE:
                break
            at = found.index(best)
            ids[at : at + 2] = [best & _LOW]
        return ids


class Rows:
    """All merges of many short pieces at once, a row of symbols each."""

    SLOTS = 18

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.letter, self.last = (np.array([-1 if x is None else x for x in t], np.int64) for t in (merges.letter, merges.last))
        # two tables of slots: the first key of a slot, and the others of it by another hash
        keys, values = merges.pairs()
        self.tables = []
        factor = 0x9E3779B97F4A7C15
        while len(keys):
            slot = self._slot(keys, factor)
            first = np.unique(slot, return_index=True)[1]
            key, value = np.full(1 << self.SLOTS, -1, np.int64), np.full(1 << self.SLOTS, _FAR, np.int64)
            key[slot[first]], value[slot[first]] = keys[first], values[first]
            self.tables.append((factor, key, value))
            rest = np.setdiff1d(np.arange(len(keys)), first)
            keys, values, factor = keys[rest], values[rest], (factor * 0xD1342543DE82EF95 + 1) % (1 << 64) | 1

    def _slot(self, keys: np.ndarray, factor: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(factor)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def _found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 32 | merged id of each pair, _FAR for none."""
        keys = (left << 32 | right) & ((1 << 62) - 1)
        out = np.full(len(keys), _FAR, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        for factor, key, value in self.tables:
            slot = self._slot(keys[todo], factor)
            hit = key[slot] == keys[todo]
            out[todo[hit]] = value[slot[hit]]
            todo = todo[~hit & (key[slot] >= 0)]
            if not len(todo):
                break
        return out

    def merged(self, pieces: list[bytes]) -> list[list[int]]:
        """Lowest rank first and leftmost first in every row."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(sizes.max(initial=1))
        body = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.full((len(pieces), width + 1), -1, np.int64)
        inside = np.arange(width + 1)[None, :] < sizes[:, None]
        ids[inside] = self.letter[body]
        ends = np.cumsum(sizes) - 1
        ids[np.arange(len(pieces)), sizes - 1] = self.last[body[ends]]
        ranks = self._found(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width)
        place, columns = np.arange(len(pieces)), np.arange(width + 1)
        while True:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(ranks)), at]
            on = np.flatnonzero(best < _FAR)
            if not len(on):
                break
            if len(on) < len(place) // 2:  # rows that are done go out of the way
                done = np.flatnonzero(best >= _FAR)
                if place is not None and len(place) == len(pieces):
                    whole = ids.copy()
                whole[place[done]] = ids[done]
                place, ids, ranks, at, best = place[on], ids[on], ranks[on], at[on], best[on]
                on = np.arange(len(place))
            row, col = on, at[on]
            shift = columns[None, :] + (columns[None, :] > col[:, None])
            moved = np.take_along_axis(ids[row], np.minimum(shift, width), 1)
            moved[:, -1] = -1
            moved[np.arange(len(row)), col] = best[on] & _LOW
            fresh = np.take_along_axis(ranks[row], np.minimum(shift[:, :-1], width - 1), 1)
            fresh[:, -1] = _FAR
            k = np.arange(len(row))
            fresh[k, col] = self._found(moved[k, col], moved[k, col + 1])
            back = np.flatnonzero(col > 0)
            fresh[back, col[back] - 1] = self._found(moved[back, col[back] - 1], moved[back, col[back]])
            ids[row], ranks[row] = moved, fresh
        if len(place) < len(pieces):
            whole[place] = ids
            ids = whole
        rows, sizes = ids.tolist(), (ids >= 0).sum(1).tolist()
        return [r[:n] for r, n in zip(rows, sizes, strict=True)]


class Stream:
    """Ids of one piece, its bytes fed in portions of any size."""

    def __init__(self, merges: Merges, window: int | None = None) -> None:
        self.merges = merges
        self.window = window or 2 * merges.lookahead + 64
        self.held: list[int] = []

    def feed(self, data: bytes) -> Iterator[int]:
        """Stable ids of what has come so far."""
        for at in range(0, len(data), self.window):
            self.held += [self.merges.letter[b] for b in data[at : at + self.window]]
            while len(self.held) > self.window:
                # the last symbol of a piece has a form of its own; it is never in reach of what goes out here
                tokens, end, out = self.merges.merged(self.held[: self.window]), 0, []
                for t in tokens:
                    if end + self.merges.width(t) > self.window - self.merges.lookahead:
                        break
                    end += self.merges.width(t)
                    out.append(t)
                if not out:
                    break
                yield from out
                del self.held[:end]

    def end(self) -> list[int]:
        """The ids that were waiting; the last symbol takes its word-end form."""
        if self.held:
            self.held[-1] = self.merges.last[self.merges.letter.index(self.held[-1])]
        out, self.held = self.merges.merged(self.held), []
        return out


class Tokenizer:
    """Encoder and decoder of a tokenizer file of BPE with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.merges = Merges(data["model"])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: s for s, i in self.merges.vocabulary.items()} | {i: s for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(next(p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.blank = regex.compile(r"[\t\n\v\f\r\x85\p{Z}]+")
        self.rows = Rows(self.merges)
        self.known = Remembered(REMEMBERED)  # word -> ids, four bytes each
        self.decimal = [str(i) for i in range(max(self.names, default=-1) + 1)]
        self.bytes = {c: b for b, c in enumerate(byte_letters())}

    def piece(self, text: str) -> list[int]:
        data = text.encode()
        if len(data) <= 2 * self.merges.lookahead:  # the window holds it: all of it is stable at its end
            ids = [self.merges.letter[b] for b in data[:-1]]
            ids.append(self.merges.last[data[-1]])
            return self.merges.merged(ids)
        stream = Stream(self.merges)
        return [*stream.feed(data), *stream.end()]

    def split(self, text: str) -> list[str]:
        """Pieces of a text without special tokens, normalised."""
        if not text.isascii():
            text = "".join(c.lower() for c in unicodedata.normalize("NFC", text))
            if max(text) > "\u07ff":
                # what Unicode has assigned only lately is no letter to the tokenizer's pattern
                shown = "".join("\ue000" if unicodedata.category(c) == "Cn" else c for c in text)
                return [text[m.start() : m.end()] for m in self.pieces.finditer(shown)]
        else:
            text = text.lower()
        return self.pieces.findall(text)

    def parts(self, text: str) -> list[int | str]:
        """Ids of special tokens, and pieces between them."""
        if self.cut and "<|" in text:
            return [p for part in self.cut.split(text) if part for p in ([self.special[part]] if part in self.special else self.split(part))]
        return self.split(text)

    def ids(self, text: str) -> list[int]:
        """Ids of any text, without the dictionary."""
        return [i for p in self.parts(text) for i in ([p] if isinstance(p, int) else self.piece(p))]

    def words(self, text: str) -> list[str]:
        """What white space separates; str.split, but for the control characters that only it takes for white space."""
        if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return text.split()
        return [w for w in self.blank.split(text) if w]

    def learn(self, words: Iterable[str]) -> None:
        """Put the ids of new words into the dictionary; their short pieces are merged together."""
        parts = {w: [p if isinstance(p, int) else p.encode() for p in self.parts(w)] for w in words}
        narrow = list(dict.fromkeys(p for ps in parts.values() for p in ps if not isinstance(p, int) and len(p) <= NARROW))
        ids: dict[bytes, list[int]] = {}
        for at in range(0, len(narrow), 16_384):
            some = sorted(narrow[at : at + 16_384], key=len)
            for low in range(0, len(some), 2048):
                ids.update(zip(some[low : low + 2048], self.rows.merged(some[low : low + 2048]), strict=True))
        for w, ps in parts.items():
            found = [i for p in ps for i in ([p] if isinstance(p, int) else ids[p] if len(p) <= NARROW else self.piece(p.decode()))]
            self.known[w] = array("I", found).tobytes()

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text (number of ids, ids joined by blanks, what the decoder makes of those ids)."""
        split = [self.words(t) for t in texts]
        self.learn(self.known.missing(set().union(*split)))
        known, decimal, out = self.known, self.decimal, []
        for words in split:
            ids = array("I", b"".join([known[w] for w in words])).tolist()
            out.append((len(ids), " ".join([decimal[i] for i in ids]), self.decode(ids)))
        return out

    def decode(self, ids: list[int]) -> str:
        machine = Decoder(self)
        return "".join([machine.feed(ids[at : at + 4096]) for at in range(0, len(ids), 4096)])

    def text_of(self, tokens: Iterator[str]) -> Iterator[str]:
        """Characters of the text that token strings stand for, each as soon as its bytes are whole; a word end becomes a blank."""
        held = bytearray()
        for token in tokens:
            body = token.removesuffix(self.merges.suffix) if self.merges.suffix else token
            held += bytes(self.bytes[c] for c in body)
            if body != token:
                held += b" "
            whole = len(held)
            for back in range(1, min(4, len(held)) + 1):  # an unfinished character is at most three bytes
                if held[-back] >= 0xC0:
                    need = 2 + (held[-back] >= 0xE0) + (held[-back] >= 0xF0)
                    whole = len(held) - back if back < need else whole
                    break
            yield held[:whole].decode("utf-8", "replace")
            del held[:whole]
        if held:
            yield held.decode("utf-8", "replace")


class Decoder:
    """Gives the text of ids, portion by portion: its only state is whether a blank is due."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.names, self.begun = tokenizer.names, False

    def feed(self, ids: list[int]) -> str:
        """The text that these ids add; unknown ids add none."""
        names = self.names
        try:
            found = [names[i] for i in ids]
        except KeyError:
            found = [names[i] for i in ids if i in names]
        if not found:
            return ""
        out = " ".join(found)
        if self.begun:
            out = " " + out
        self.begun = True
        return out


_LOADED: dict[str, Tokenizer] = {}


def loaded(path: str) -> Tokenizer:
    """The tokenizer of a file, read once by a worker."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, name: str = "word_bpe_49k.json", path: str | None = None) -> DataFrame:
    """docs without their text, with n_tokens, ids_sha256 and decoded_sha256.  path: a file on every machine, instead of the public one by name."""
    added = ("n_tokens", "ids_sha256", "decoded_sha256")
    keep = [f for f in docs.schema.fields if f.name != "text" and f.name not in added]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField(added[0], T.LongType()), *[T.StructField(c, T.StringType()) for c in added[1:]]])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(path or tokenizer_file(name))
        for batch in batches(it, 512):
            with uncollected():
                n, ids, text = zip(*tokenizer.encode(strings(batch.column(len(names)))), strict=True)
                sha = [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in c], pa.string()) for c in (ids, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(n, pa.int64()), *sha], [*names, *added])
        tokenizer.known.forget()
        given_back()  # workers live on, and other stages need their memory

    bounded(docs.sparkSession)
    return docs.select(*names, F.col("text")).mapInArrow(run, schema)
