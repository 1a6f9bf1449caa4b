"""BPE encoding by dynamic programming over a word's prefixes, and decoding.

The encoding of a prefix is unique, so it is enough to keep each prefix's last token. Token
t may be the last one of a prefix if, with p the last token of what is left when t is cut
off, merging p and t as one string gives back the two: the pair test below. The tokens that end
at a place come from a suffix automaton of the vocabulary: the automaton is in the state
of the longest vocabulary substring that ends there, and its suffix links lead through the
shorter ones. One of the candidates passes; back-pointers then give the ids.

A symbol is a byte, or a word's last byte with the end-of-word mark, so the vocabulary's
first entries are the 512 symbols. A worker keeps the ids of the runs between blanks that it has
met, in two tables of which the older is dropped when the younger is full. The words of new runs are
encoded together, a place of all of them at a time, as arrays; only long words go one by one.
The tokenizer file is read on the driver and sent to the workers; tasks need no local file.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an
empty text; repeated rows and null ids give a row each; other columns pass through.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlstone.session import read_table

MEMORY = 1 << 17  # runs whose ids a worker keeps in each of two tables, and half the pairs of tokens in long words
TESTED = 19  # bits of the number of pairs of tokens in short words whose test is kept
WINDOW = 1 << 16  # runs, of one text or several, that are looked up together
GROUP = 1 << 14  # short words that are encoded together
PART = 1 << 18  # characters of texts whose ids and decoded texts a worker holds together, a longer text alone
SHORT = 48  # bytes; longer words are encoded one by one, and runs of more characters each time
# Fixed value: the pattern of the file's pre-tokenizer, for texts below PLAIN.
# There the letters, numbers and others of that pattern are these classes.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")
# Above these code points, Unicode versions and normal forms may matter: the file's own rules cut such texts into words.
EXOTIC = regex.compile(r"[\x1c-\x1fɐ-\U0010ffff]")


class SuffixAutomaton:
    """All substrings of a set of symbol sequences.

    ``step[s << 9 | c]``: the state after state s and symbol c; ``link`` and ``length`` of a state's longest string.
    A whole sequence is the longest string with its end positions, so a state has one at most. ``first[s]``: the longest
    wanted sequence on the suffix links of state s, itself included; ``next[t]``: the next shorter one after sequence t; -1 for none.
    """

    def __init__(self, sequences: list[list[int]], wanted: list[bool]) -> None:
        self.link, self.length = array("i", [-1]), array("i", [0])
        steps: list[dict[int, int]] = [{}]
        token = {}
        for number, symbols in enumerate(sequences):
            last = 0
            for c in symbols:
                last = self._extended(steps, last, c)
            if wanted[number]:
                token[last] = number
        self.first, self.next = array("i", [-1]) * len(steps), array("i", [-1]) * len(sequences)
        for s in sorted(range(1, len(steps)), key=self.length.__getitem__):
            self.first[s] = behind = self.first[self.link[s]]
            if s in token:
                self.first[s] = token[s]
                self.next[token[s]] = behind
        self.step = {s << 9 | c: to for s, own in enumerate(steps) for c, to in own.items()}

    def _state(self, steps: list[dict[int, int]], length: int, link: int, step: dict[int, int]) -> int:
        steps.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(steps) - 1

    def _split(self, steps: list[dict[int, int]], p: int, c: int, q: int) -> int:
        """The state of p's longest string and c; cut off from q if q also holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(steps, self.length[p] + 1, self.link[q], dict(steps[q]))
        self.link[q] = own
        while p >= 0 and steps[p].get(c) == q:
            steps[p][c] = own
            p = self.link[p]
        return own

    def _extended(self, steps: list[dict[int, int]], last: int, c: int) -> int:
        if c in steps[last]:
            return self._split(steps, last, c, steps[last][c])
        new, p = self._state(steps, self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(steps, p, c, steps[p][c])
        return new


class Vocabulary(NamedTuple):
    """``symbols[t]``: token t's symbols; ``parts[t]``: the two tokens merged into it (itself twice if none); ``made``: the reverse."""

    symbols: list[list[int]]
    parts: list[tuple[int, int]]
    made: dict[tuple[int, int], int]
    ids: list[int]
    names: dict[int, str]
    special: dict[str, int]


def byte_names() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def vocabulary(spec: str) -> Vocabulary:
    """Tokens are numbered by the order in which merges make them; the 512 symbols come first."""
    found = json.loads(spec)
    model, end = found["model"], found["model"]["end_of_word_suffix"]
    names = [*(own := byte_names()), *[c + end for c in own]]
    number = {name: i for i, name in enumerate(names)}
    symbols, parts, made = [[i] for i in range(512)], [(i, i) for i in range(512)], {}
    for a, b in model["merges"]:
        pair = number[a], number[b]
        number[a + b] = made[pair] = len(symbols)
        symbols.append(symbols[pair[0]] + symbols[pair[1]])
        parts.append(pair)
    ids = [model["vocab"][name] for name in number]
    special = {x["content"]: x["id"] for x in found["added_tokens"]}
    return Vocabulary(symbols, parts, made, ids, {i: name for name, i in [*model["vocab"].items(), *special.items()]}, special)


def apart(words: Vocabulary, a: int, b: int, due: int) -> bool:
    """Whether tokens a and b, side by side, are still two when all merges before ``due`` are done.

    Undo the merges at the seam, the latest first. The two stay apart if no pair that met at
    the seam had a merge which was due before one of its sides was merged further. Of equal
    merges the left one comes first, so the right one is undone first.
    """
    made, parts = words.made, words.parts
    while True:
        joined = made.get((a, b))
        if joined is not None and joined < due:
            return False
        whole_a, whole_b = parts[a][0] == a, parts[b][0] == b
        if whole_a and whole_b:
            return True
        if whole_b or (a > b and not whole_a):
            due, a = a, parts[a][1]
        else:
            due, b = b + 1, parts[b][0]


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    """A place in a table of 2^bits for each key."""
    return ((keys * np.int64(-0x61C8864680B583EB)).view(np.uint64) >> np.uint64(64 - bits)).view(np.int64)


class Lookup:
    """Whole numbers below 2^24 by keys below 2^39, for arrays of keys; a quarter full at most, and the next free place is taken."""

    def __init__(self, found: dict[int, int]) -> None:
        keys, values = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        self.bits = max(4, (4 * len(found) - 1).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int64)
        entries, at = keys << 24 | values, places(keys, self.bits)
        while entries.size:
            free = self.table[at] < 0
            self.table[at[free]] = entries[free]
            others = self.table[at] != entries
            entries, at = entries[others], (at[others] + 1) & (self.table.size - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for none."""
        at = places(keys, self.bits)
        entries = self.table[at]
        out = entries & 0xFFFFFF
        left = np.flatnonzero(entries >> 24 != keys)
        at, entries = at[left], entries[left]
        out[left] = -1
        while (on := np.flatnonzero(entries >= 0)).size:
            left, at = left[on], at[on] + 1 & (self.table.size - 1)
            entries = self.table[at]
            hit = entries >> 24 == keys[left]
            out[left[hit]] = entries[hit] & 0xFFFFFF
            left, at, entries = left[~hit], at[~hit], entries[~hit]
        return out


class Together:
    """Encodes many words at once: the same automaton, candidates and pair test as ``Encoder.word``, on arrays."""

    def __init__(self, words: Vocabulary, automaton: SuffixAutomaton) -> None:
        self.step = Lookup(automaton.step)
        self.link, self.length, self.first, self.next = (np.array(x, np.int64) for x in (automaton.link, automaton.length, automaton.first, automaton.next))
        self.size, self.ids = np.array(list(map(len, words.symbols))), np.array(words.ids, "<u4")
        self.n, (self.left, self.right) = len(words.parts), np.array(words.parts).T
        self.whole = self.left == np.arange(self.n)
        self.made = Lookup({a * self.n + b: t for (a, b), t in words.made.items()})
        self.tested = np.full(1 << TESTED, -1, np.int64)  # a pair and its test; of pairs with one place the last stays

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``apart`` for pairs of tokens, when all merges are done."""
        out, at, due = np.ones(a.size, bool), np.arange(a.size), np.full(a.size, self.n)
        while at.size:
            joined = self.made(a * self.n + b)
            early = (joined >= 0) & (joined < due)
            out[at[early]] = False
            whole_a, whole_b = self.whole[a], self.whole[b]
            on = ~early & ~(whole_a & whole_b)
            at, a, b, whole_a, whole_b = at[on], a[on], b[on], whole_a[on], whole_b[on]
            undo_a = whole_b | ((a > b) & ~whole_a)
            due = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = places(key, TESTED)
        kept = self.tested[at]
        out = kept & 1 == 1
        new = np.flatnonzero(kept >> 1 != key)
        if new.size:
            out[new] = self.apart(a[new], b[new])
            self.tested[at[new]] = key[new] << 1 | out[new]
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, none of them empty, as little-endian 32-bit numbers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")  # so the words that reach a place are the first ones
        starts, n = (np.cumsum(sizes) - sizes)[order], sizes[order]
        data = np.frombuffer(b"".join(words), np.uint8)
        reach = len(words) - np.searchsorted(n[::-1], np.arange(n[0] + 1), side="right")
        last = np.empty((n[0], len(words)), np.int32)
        states, matches = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for i in range(n[0]):
            symbol = data[starts[: reach[i]] + i].astype(np.int64)
            symbol[reach[i + 1] :] += 256
            state, matched = states[: reach[i]], matches[: reach[i]]
            to = self.step(state << 9 | symbol)
            lost = np.flatnonzero(to < 0)
            behind = state[lost]
            while lost.size:  # every symbol is a token, so the root has them all
                behind = self.link[behind]
                to[lost] = found = self.step(behind << 9 | symbol[lost])
                matched[lost] = self.length[behind]
                lost, behind = lost[found < 0], behind[found < 0]
            state[:] = to
            matched += 1
            token = self.first[np.where(matched == self.length[to], to, self.link[to])]  # a state's longest string may not be here whole
            last[i, : reach[i]] = token
            at = np.flatnonzero((self.size[token] <= i) & (self.next[token] >= 0))
            token = token[at]
            while at.size:
                bad = ~self.fits(last[i - self.size[token], at].astype(np.int64), token)
                at, token = at[bad], self.next[token[bad]]
                last[i, at] = token
                on = (self.size[token] <= i) & (self.next[token] >= 0)
                at, token = at[on], token[on]
        return self._ids(last, n, order)

    def _ids(self, last: np.ndarray, n: np.ndarray, order: np.ndarray) -> list[bytes]:
        """The tokens from each word's end to its beginning, turned round."""
        rounds, at, ends, counts = [], np.arange(n.size), n, np.zeros(n.size, np.int64)
        while at.size:
            token = last[ends - 1, at]
            rounds.append((at, token))
            counts[at] += 1
            ends = ends - self.size[token]
            at, ends = at[ends > 0], ends[ends > 0]
        stops = np.cumsum(counts)
        out = np.empty(stops[-1], "<u4")
        for k, (at, token) in enumerate(rounds, 1):
            out[stops[at] - k] = self.ids[token]
        whole, found = out.tobytes(), [b""] * n.size
        for place, begin, end in zip(order.tolist(), (4 * (stops - counts)).tolist(), (4 * stops).tolist()):
            found[place] = whole[begin:end]
        return found


class Encoder:
    """Encodes and decodes as the tokenizer file says."""

    def __init__(self, spec: str) -> None:
        self.words = vocabulary(spec)
        self.automaton = SuffixAutomaton(self.words.symbols, self._reachable())
        found = json.loads(spec)
        found["model"] |= {"vocab": {}, "merges": []}  # only its normalizer and pre-tokenizer are used
        self.rules = Tokenizer.from_str(json.dumps(found | {"added_tokens": []}))
        self.known: dict[str, bytes] = {}  # ids as little-endian 32-bit numbers: an eighth of a list's size
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.together = Together(self.words, self.automaton)
        self.names = np.full(max(self.words.names) + 1, None, object)
        for i, name in self.words.names.items():
            self.names[i] = name
        self.lengths = list(map(len, self.words.symbols))
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.words.special)) + ")") if self.words.special else None

    def _reachable(self) -> list[bool]:
        """Tokens whose own string is encoded as that token; the others are never used."""
        own: list[bool] = []
        for t, (a, b) in enumerate(self.words.parts):
            own.append(a == t or (own[a] and own[b] and apart(self.words, a, b, t)))
        return own

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the string of tokens a and b gives back a and b; kept in ``pairs``."""
        if len(self.pairs) > 2 * MEMORY:
            self.pairs.clear()
        found = self.pairs[a * len(self.words.parts) + b] = apart(self.words, a, b, len(self.words.parts))
        return found

    def word(self, data: bytes) -> bytes:
        """Ids of one word, as little-endian 32-bit numbers."""
        step, link, length = self.automaton.step, self.automaton.link, self.automaton.length
        first, shorter, lengths = self.automaton.first, self.automaton.next, self.lengths
        known, fits, n = self.pairs, self.fits, len(self.words.parts)
        state = matched = 0
        last: list[int] = []
        for i, c in enumerate([*data[:-1], data[-1] + 256]):
            to = step.get(state << 9 | c)
            if to is None:
                while to is None:  # every symbol is a token, so the root has them all
                    state = link[state]
                    to = step.get(state << 9 | c)
                matched = length[state]
            state = to
            matched += 1
            t = first[state if matched == length[state] else link[state]]  # a state's longest string may not be here whole
            while (size := lengths[t]) <= i and shorter[t] >= 0:
                a = last[i - size]
                fit = known.get(a * n + t)
                if fits(a, t) if fit is None else fit:
                    break
                t = shorter[t]
            last.append(t)
        out, i, ids = [], len(last), self.words.ids
        while i:
            t = last[i - 1]
            out.append(ids[t])
            i -= lengths[t]
        out.reverse()
        return array("I", out).tobytes() if sys.byteorder == "little" else np.array(out, "<u4").tobytes()

    def _runs(self, text: str | None) -> list[str]:
        """A text between its blanks. A special token has a line feed ahead, a word that the file's own rules cut a space: no run has them."""
        out: list[str] = []
        for i, part in enumerate(self.marks.split(text or "") if self.marks else [text or ""]):
            if i % 2:
                out.append("\n" + part)
            elif not EXOTIC.search(part):
                out += part.lower().split()
            else:
                name = {c: b for b, c in enumerate(byte_names())}
                cut = self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(part))
                out += [" " + bytes(name[c] for c in piece).decode("utf-8") for piece, _ in cut]
        return out

    def _coded(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word: short ones together, long ones one by one."""
        out: dict[str, bytes] = {}
        short: list[str] = []
        packed: list[bytes] = []
        for w in words:
            if len(data := w.encode("utf-8")) > SHORT:
                out[w] = self.word(data)
            else:
                short.append(w)
                packed.append(data)
        for i in range(0, len(short), GROUP):
            out.update(zip(short[i : i + GROUP], self.together.encode(packed[i : i + GROUP])))
        return out

    def _learn(self, runs: list[str]) -> dict[str, bytes]:
        """Sees to it that ``known`` has all of some runs; gives those of them that are too long to be kept."""
        if len(self.known) >= MEMORY:
            self.older, self.known = self.known, {}
        older, known, long = self.older, self.known, {}
        new: list[str] = []
        words: list[str] = []  # of all new runs; no list of a run is kept, for Python's collector looks through all that are
        counts: list[int] = []
        for run in set(runs).difference(known):
            found = older.get(run)
            if found is not None:
                known[run] = found
            elif run[0] == "\n":
                known[run] = self.words.special[run[1:]].to_bytes(4, "little")
            else:
                cut = [run[1:]] if run[0] == " " else WORDS.findall(run)
                new.append(run)
                words += cut
                counts.append(len(cut))
        coded = self._coded(list(dict.fromkeys(words)))
        codes = map(coded.__getitem__, words)
        for run, count in zip(new, counts):
            found = next(codes) if count == 1 else b"".join(islice(codes, count))
            if len(run) <= SHORT:
                known[run] = found
            else:
                long[run] = found
        return long

    def _joined(self, texts: list[list[str]]) -> Iterator[bytes]:
        flat, codes = list(chain.from_iterable(texts)), []
        for i in range(0, len(flat), WINDOW):
            some = flat[i : i + WINDOW]
            long = self._learn(some)
            codes += map(self.known.__getitem__, some) if not long else [long[x] if x in long else self.known[x] for x in some]
        begin = 0
        for runs in texts:
            yield b"".join(codes[begin : begin + len(runs)])
            begin += len(runs)

    def packed(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text, as little-endian 32-bit numbers. Texts of WINDOW runs are held together."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(self._runs(text))
            size += len(held[-1]) + 1
            if size >= WINDOW:
                yield from self._joined(held)
                held, size = [], 0
        yield from self._joined(held)

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        return (np.frombuffer(x, "<u4") for x in self.packed(texts))

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' names with spaces between them: the file names no decoder."""
        return " ".join(self.names[np.asarray(ids, np.uint32)].tolist())


_ENCODERS: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """The encoder of a tokenizer file's contents; a worker keeps the last."""
    if spec not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[spec] = Encoder(spec)
    return _ENCODERS[spec]


def encoded(text: str | Column, path: str, spark) -> Column:
    """Array of token ids of a text column."""
    spec = spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    @F.pandas_udf("array<int>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(spec.value)
        for s in texts:
            yield pd.Series([ids.astype(np.int32) for ids in own.encode_all(s)], dtype=object)

    return of(text)


def decoded(ids: str | Column, path: str, spark) -> Column:
    """Text of a column of token ids; null for null."""
    spec = spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    @F.pandas_udf("string")
    def of(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(spec.value)
        for s in lists:
            yield pd.Series([None if x is None else own.decode(x) for x in s], dtype=object)

    return of(ids)


def digests(text: str | Column, path: str, spark) -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256): a text encoded and decoded, the ids never leaving the worker."""
    spec = spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(spec.value)
        for s in texts:
            rows = []
            for ids in own.encode_all(s):
                rows.append((ids.size, hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return of(text)


def coded_parts(own: Encoder, texts: pd.Series) -> Iterator[pd.DataFrame]:
    """Ids and decoded texts in order, a frame for each PART characters: the output of a whole batch is never held."""
    ids, decoded, size = [], [], 0
    for t, found in zip(texts, own.encode_all(texts)):
        ids.append(found.astype(np.int32))
        decoded.append(own.decode(found))
        size += len(t or "")
        if size >= PART:
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(decoded, dtype=object)})
            ids, decoded, size = [], [], 0
    if ids:
        yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(decoded, dtype=object)})


def coded(text: str | Column, path: str, spark) -> Column:
    """Struct (ids, decoded) of a text column, in one pass."""
    spec = spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    @F.pandas_udf("ids array<int>, decoded string")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(spec.value)
        for s in texts:
            yield from coded_parts(own, s)

    return of.asNondeterministic()(text)  # one pass, however many columns use it


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", digests("text", path or default_path(), spark).alias("d")).select("doc_id", "d.*")


QUERIES = {"op6_bpe": op6_bpe}
