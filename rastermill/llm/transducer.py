"""Byte-pair encoding and decoding with a minimal acyclic transducer as the lexicon of frequent words."""

from __future__ import annotations

import heapq
import json
import mmap
import re
import tempfile
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.words import frequent_words

FREQUENT = 1 << 16
HELD = 100_000  # distinct words whose ids a task holds
SHORT = 32  # bytes of a word whose pairs are looked through one by one
_PLAIN = 0x250  # below this, the splitting rules need no Unicode tables beyond those of Python


def _plain_pattern() -> re.Pattern:
    """The file's pattern over letters, single digits and other marks, for texts of code points below ``_PLAIN``."""
    kind = [unicodedata.category(chr(c))[0] for c in range(_PLAIN)]
    members = lambda wanted: "".join(re.escape(chr(c)) for c in range(_PLAIN) if kind[c] in wanted)
    letters, digits, blanks = members("L"), members("N"), "\t-\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{blanks}{letters}{digits}]+")


_EXOTIC = re.compile(f"[^\x00-{chr(_PLAIN - 1)}]")


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Words, merges and special tokens of a word-level BPE file, and the exact merge of a single word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.ranks = {tuple(m): k for k, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = _byte_letters()
        self._path = path
        self._pattern = _plain_pattern()
        self._cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")

    @cached_property
    def _library(self) -> tokenizers.Tokenizer:
        """Read only where a text needs it."""
        return tokenizers.Tokenizer.from_file(self._path)

    def names(self) -> list[str]:
        """Token text by id."""
        size = max([*self.ids.values(), *self.special.values()]) + 1
        names = [""] * size
        for name, k in [*self.ids.items(), *self.special.items()]:
            names[k] = name
        return names

    def split(self, text: str) -> list[str]:
        """Words of ``text`` in order; special tokens inside it are words of their own."""
        if "<|" not in text:
            return self._words(text)
        out = []
        for k, part in enumerate(self._cut.split(text)):
            out.extend([part] if k % 2 else self._words(part))
        return out

    def _words(self, text: str) -> list[str]:
        if not _EXOTIC.search(text):
            return self._pattern.findall(text.lower())
        # the library's own tables decide about code points that Unicode versions differ in
        stand_ins = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(self._byte[c] for c in word).decode() for word, _ in stand_ins]

    @property
    def _byte(self) -> dict[str, int]:
        return {c: b for b, c in enumerate(self.letters)}

    def encode(self, word: str) -> list[int]:
        """Ids of one word: the lowest-ranked pair merges first, the leftmost of equal rank."""
        if word in self.special:
            return [self.special[word]]
        parts = [self.letters[b] for b in word.encode()]
        parts[-1] += self.end
        if len(parts) <= SHORT:
            return self._merged(parts)
        ranks, size = self.ranks, len(parts)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r, k) for k in range(size - 1) if (r := ranks.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            nxt = after[k]
            if parts[k] is None or nxt >= size or ranks.get((parts[k], parts[nxt])) != rank:
                continue
            parts[k] += parts[nxt]
            parts[nxt] = None
            after[k] = after[nxt]
            if after[k] < size:
                before[after[k]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < size and (r := ranks.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left))
        return [self.ids[p] for p in parts if p is not None]

    def _merged(self, parts: list[str]) -> list[int]:
        """Ids of the parts of a short word, merged in the same order without a heap."""
        rank, none = self.ranks.get, len(self.ranks)
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (lowest := min(ranks)) < none:
            k = ranks.index(lowest)
            parts[k] += parts.pop(k + 1)
            del ranks[k]
            if k:
                ranks[k - 1] = rank((parts[k - 1], parts[k]), none)
            if k < len(ranks):
                ranks[k] = rank((parts[k], parts[k + 1]), none)
        return [self.ids[p] for p in parts]


def compile_lexicon(words: list[str], encode: Callable[[str], list[int]]) -> bytes:
    """A minimal acyclic transducer of ``words`` with their ids, as one block of bytes.

    Words are added in byte order; a suffix that exists already is shared. The
    outputs along a word's path add up to the number of words before it, which
    is the row of its ids, so equal suffixes can be shared whatever the ids are.
    """
    entries = sorted({w.encode() for w in words if w})
    states: list[dict[int, int]] = [{}]
    final = [False]
    registered: dict[tuple, int] = {}

    def settle(path: list[tuple[int, int]], keep: int) -> None:
        while len(path) > keep:
            parent, letter = path.pop()
            child = states[parent][letter]
            shape = (final[child], tuple(states[child].items()))
            states[parent][letter] = registered.setdefault(shape, child)

    path: list[tuple[int, int]] = []
    last = b""
    for word in entries:
        same = 0
        while same < min(len(last), len(word)) and last[same] == word[same]:
            same += 1
        settle(path, same)
        at = states[path[-1][0]][path[-1][1]] if path else 0
        for letter in word[same:]:
            states.append({})
            final.append(False)
            states[at][letter] = len(states) - 1
            path.append((at, letter))
            at = len(states) - 1
        final[at] = True
        last = word
    settle(path, 0)

    # number what can be reached; children of a state come after all its words were counted
    order, seen, stack = [], {0}, [(0, iter(states[0].values()))]
    while stack:
        state, children = stack[-1]
        for child in children:
            if child not in seen:
                seen.add(child)
                stack.append((child, iter(states[child].values())))
                break
        else:
            stack.pop()
            order.append(state)
    number = {s: k for k, s in enumerate(reversed(order))}
    below: dict[int, int] = {}
    arcs = []
    for state in order:
        passed = int(final[state])
        for letter, child in sorted(states[state].items()):
            arcs.append((number[state] << 8 | letter, number[child], passed))
            passed += below[child]
        below[state] = passed
    arcs.sort()
    ids = [encode(w.decode()) for w in entries]
    parts = [
        np.array([a[0] for a in arcs], np.int64), np.array([a[1] for a in arcs], np.int32), np.array([a[2] for a in arcs], np.int32),
        np.array([final[s] for s in reversed(order)], np.uint8), np.cumsum([0, *map(len, ids)]).astype(np.int32),
        np.array([x for row in ids for x in row], np.int32),
    ]
    head = np.array([len(p) for p in parts], np.int64)
    return b"".join(_padded(p.tobytes()) for p in [head, *parts])


def _padded(block: bytes) -> bytes:
    return block + bytes(-len(block) % 8)


class Lexicon:
    """The compiled block, mapped into memory."""

    def __init__(self, block: bytes):
        # the file has no name and goes with the process; pages that are never asked for are never read
        with tempfile.TemporaryFile() as file:
            file.write(block)
            file.flush()
            mapped = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        sizes, at, parts = np.frombuffer(mapped, np.int64, 6), 48, []
        for size, kind in zip(sizes.tolist(), (np.int64, np.int32, np.int32, np.uint8, np.int32, np.int32)):
            parts.append(np.frombuffer(mapped, kind, size, at))
            at += -(-size * np.dtype(kind).itemsize // 8) * 8
        self.keys, self.targets, self.outputs, self.final, self.starts, self.ids = parts

    def find(self, words: list[bytes]) -> np.ndarray:
        """Row of each word's ids, -1 for words that are not in the lexicon; all words walk side by side."""
        state, row = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if not len(self.keys):
            return np.full(len(words), -1)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        letters = np.frombuffer(b"".join(words), np.uint8)
        live = np.arange(len(words))
        for k in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > k) & (state[live] >= 0)]
            if not len(live):
                break
            key = state[live] << 8 | letters[starts[live] + k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            state[live] = np.where(found, self.targets[at], -1)
            row[live] += np.where(found, self.outputs[at], 0)
        done = (state >= 0) & (lengths > 0)
        done[done] = self.final[state[done]] > 0
        return np.where(done, row, -1)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all runs, one after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Encoder:
    """Ids of texts, one task long."""

    def __init__(self, path: str, block: bytes):
        self.vocabulary, self.lexicon = Vocabulary(path), Lexicon(block)
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        found = self.lexicon.find([w.encode() for w in words])
        known, sizes = found >= 0, np.zeros(len(words), np.int64)
        rare = [self.vocabulary.encode(words[k]) for k in np.flatnonzero(~known).tolist()]
        starts, rows = self.lexicon.starts, found[known]
        sizes[known], sizes[~known] = starts[rows + 1] - starts[rows], np.fromiter(map(len, rare), np.int64, len(rare))
        ids, of_known = np.empty(int(sizes.sum()), np.int32), np.repeat(known, sizes)
        ids[of_known] = self.lexicon.ids[_runs(starts[rows], sizes[known])]
        ids[~of_known] = np.fromiter(chain.from_iterable(rare), np.int32)
        self.rows.update(zip(words, range(len(self.rows), len(self.rows) + len(words))))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])

    def __call__(self, texts: list[str]) -> pa.ListArray:
        if len(self.rows) > HELD:
            self._clear()
        split = [self.vocabulary.split(t) for t in texts]
        new = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in self.rows]
        if new:
            self._learn(new)
        row = np.array(list(map(self.rows.__getitem__, chain.from_iterable(split))), np.int64)
        sizes = self.starts[row + 1] - self.starts[row]
        where = _runs(self.starts[row], sizes)
        words = np.cumsum([0, *map(len, split)])
        offsets = np.concatenate([[0], np.cumsum(sizes)])[words]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(self.ids[where], pa.int32()))


def frequent_lexicon(items: DataFrame, path: str, text: str = "json", frequent: int = FREQUENT) -> bytes:
    """The compiled lexicon of the ``frequent`` most frequent words of all texts."""
    vocabulary = Vocabulary(path)
    source = items.select(F.col(text).cast("string").alias("_text"))
    return compile_lexicon(frequent_words(source, "_text", lambda: Vocabulary(path).split, frequent), vocabulary.encode)


def encode(
    items: DataFrame, path: str, id: str = "id", text: str = "json", block: bytes | None = None, rows: int = 200,
    decoded: str | None = None,
) -> DataFrame:
    """``(id, ids)``, and the text ``decoded`` from the ids if it has a name: the whole texts of STAC documents under the word-level BPE file at ``path``.

    Ids are those of the tokenizers library without added special tokens; the
    strings of special tokens inside a text are special tokens. Frequent words,
    counted over all texts, are found in a transducer that is mapped into memory;
    other words are merged. The lexicon is a shortcut only: ids do not depend on it.

    A null or empty text, or one of blanks only, has no ids. Words may have any
    length. Null ids and repeated rows keep a row each. Other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    source = items.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text"))
    block = frequent_lexicon(source, path, "_text") if block is None else block
    shared = items.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(path, shared.value)
        names = pa.array(encoder.vocabulary.names(), pa.string())
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                ids = encoder([t or "" for t in part.column("_text").to_pylist()])
                columns = {"_id": part.column("_id"), "ids": ids} | ({decoded: _joined(ids, names)} if decoded else {})
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = source.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, ids array<int>" + (f", `{decoded}` string" if decoded else "")
    return source.mapInArrow(run, schema).withColumnRenamed("_id", id)


def _joined(ids: pa.ListArray, names: pa.Array) -> pa.Array:
    offsets = pc.subtract(ids.offsets, ids.offsets[0])
    return pc.binary_join(pa.ListArray.from_arrays(offsets, names.take(ids.flatten())), " ")


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded", rows: int = 200) -> DataFrame:
    """Add the text of each row's ``ids``: the texts of the tokens, special ones too, joined by a blank as the file has no decoder."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(Vocabulary(path).names(), pa.string())
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                yield pa.RecordBatch.from_arrays([*part.columns, _joined(part.column(ids), names)], names=[*batch.schema.names, out])

    return encoded.mapInArrow(run, f"{kinds}, `{out}` string")
