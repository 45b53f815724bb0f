"""BPE encoding and decoding by a tokenization automaton.

The automaton reads token ids and accepts exactly the canonical BPE tokenizations. It starts as one state with an
arc for every byte; each merge ``(a, b) -> c`` then applies one gadget: the state after ``a`` is split into a copy
without the arc ``b``, arcs ``a`` lead to the copy, and every state with an arc ``a`` gets an arc ``c`` to where ``b``
led. Since all arcs of one token lead to the same state at any time, a state is stored as a triple (copied from, made
by merge, arc removed), and ``Automaton.arc`` answers "does this state have this arc" from those tables; answers are
kept in a transition table.

Encoding follows the arcs whose labels match the word's bytes, longest label first, and steps back where none leads on.
Every prefix of a word has exactly one accepted tokenization, so each position is reached by one path at most and the
work is linear in the length, also for very long words. Decoding emits the arcs' labels (their bytes).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import release, small_batches

#: Fixed value: the split pattern of byte-level BPE vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded words kept per worker; when full the table is emptied, which changes speed only.
WORD_TABLE = 400_000
#: Longer words are encoded one by one and not kept.
LONG_WORD = 40


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    names.update({chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))})
    return names


def read_vocabulary(path: str) -> dict:
    """Merges, ids and special tokens of a byte-level BPE file of the tokenizers library (a few MB, on the driver)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {"vocab": model["vocab"], "merges": merges, "special": {x["content"]: x["id"] for x in spec.get("added_tokens", [])}}


class Automaton:
    def __init__(self, vocabulary: dict):
        names, vocab = byte_names(), vocabulary["vocab"]
        self.label = {i: bytes(names[c] for c in text) for text, i in vocab.items()}
        self.special = dict(vocabulary["special"])
        self.label.update({i: text.encode() for text, i in self.special.items()})
        self.born = dict.fromkeys((i for i, b in self.label.items() if len(b) == 1), 0)
        self.first_part: dict[int, int] = {}
        self.state_after = dict.fromkeys(self.born, 0)
        self.copied_from, self.made_by, self.removed = [0], [0], [-1]
        self.table: dict[tuple[int, int], bool] = {}
        for step, (left, right) in enumerate(vocabulary["merges"], 1):
            self._gadget(step, vocab[left], vocab[right], vocab[left + right])
        self.table.clear()
        self.prefixes: dict[bytes, int] = {}
        for i in self.born:
            b = self.label[i]
            for n in range(1, len(b)):
                self.prefixes.setdefault(b[:n], -1)
        for i in self.born:
            self.prefixes[self.label[i]] = i
        self.base: np.ndarray | None = None
        self.words: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(SPLIT)
        self.split_special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def _gadget(self, step: int, a: int, b: int, c: int) -> None:
        before = self.state_after[a]
        if not self.arc(before, b) or c in self.born:
            return
        self.born[c], self.first_part[c], self.state_after[c] = step, a, self.state_after[b]
        self.state_after[a] = len(self.copied_from)
        self.copied_from.append(before)
        self.made_by.append(step)
        self.removed.append(b)

    def arc(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc ``token``."""
        born, made = self.born, self.made_by
        while state:
            if born[token] >= made[state]:
                token = self.first_part[token]
            elif self.removed[state] == token:
                return False
            else:
                state = self.copied_from[state]
        return True

    def encode_bytes(self, word: bytes) -> tuple[int, ...]:
        n, get, table, after = len(word), self.prefixes.get, self.table, self.state_after
        out: list[int] = []
        ahead: list[list[int]] = []
        at, state = 0, 0
        while True:
            found, j = [], at + 1
            while j <= n:
                token = get(word[at:j])
                if token is None:
                    break
                if token >= 0:
                    found.append(token)
                j += 1
            ahead.append(found)
            while True:
                if found:
                    token = found.pop()
                    key = (state, token)
                    has = table.get(key)
                    if has is None:
                        has = table[key] = self.arc(state, token)
                    if has:
                        break
                else:
                    ahead.pop()
                    found = ahead[-1]
                    at -= len(self.label[out.pop()])
                    state = after[out[-1]] if out else 0
            out.append(token)
            at += len(self.label[token])
            if at == n:
                return tuple(out)
            state = after[token]

    def _tables(self) -> None:
        """The byte trie of the labels and the arrays that the joint encoding of many words indexes."""
        inner = {b: n for n, b in enumerate(sorted({b[:n] for b in self.prefixes for n in range(len(b))}, key=len))}
        ids, self.inner = dict(inner), len(inner)
        for b in self.prefixes:
            ids.setdefault(b, len(ids))
        self.node_token = np.full(len(ids), -1, dtype=np.int64)
        arcs = np.zeros((len(self.prefixes), 3), dtype=np.int64)
        for i, (b, token) in enumerate(self.prefixes.items()):
            arcs[i] = inner[b[:-1]], b[-1], ids[b]
            self.node_token[ids[b]] = token
        self._place(*arcs.T)
        top = max(self.label) + 1
        self.after = np.zeros(top, dtype=np.int64)
        self.width = np.ones(top, dtype=np.int64)
        for i, b in self.label.items():
            self.after[i], self.width[i] = self.state_after.get(i, 0), len(b)
        self.slots = np.full(1 << 16, -1, dtype=np.int64)
        self.filled = 0

    def _place(self, parent: np.ndarray, byte: np.ndarray, child: np.ndarray) -> None:
        """Puts all nodes' rows of 256 arcs into one array, shifted so that their arcs fall between each other's: the arc
        of a node by a byte stands at ``base[node] + byte`` if that place is the node's.

        Nodes of many arcs come first. All nodes of about equally many try a shift at random at once; those whose places
        are free and claimed by no other node stay, the rest try again.
        """
        order = np.lexsort((byte, parent))
        parent, byte, child = parent[order], byte[order], child[order]
        arcs = np.bincount(parent, minlength=self.inner)
        self.base = np.zeros(self.inner, dtype=np.int64)
        size = 4 * len(parent) + 4096
        taken = np.full(size + 256, -1, dtype=np.int32)
        rng = np.random.default_rng(1)
        level = np.frexp(arcs.astype(float))[1]
        for now in sorted(set(level[arcs > 0].tolist()), reverse=True):
            todo = np.flatnonzero(level[parent] == now)
            while len(todo):
                nodes, at = np.unique(parent[todo], return_inverse=True)
                places = rng.integers(0, size, len(nodes))[at] + byte[todo]
                open_ = taken[places] < 0
                taken[places[open_]] = parent[todo[open_]]
                lost = np.bincount(at[taken[places] != parent[todo]], minlength=len(nodes)) > 0
                back = lost[at] & (taken[places] == parent[todo])
                taken[places[back]] = -1
                self.base[nodes[~lost]] = (places - byte[todo])[np.searchsorted(at, np.flatnonzero(~lost))]
                todo = todo[lost[at]]
        places = self.base[parent] + byte
        self.owner = np.full(int(self.base.max()) + 256, -1, dtype=np.int32)
        self.target = np.zeros(len(self.owner), dtype=np.int32)
        self.owner[places], self.target[places] = parent, child

    def _has(self, keys: np.ndarray) -> np.ndarray:
        """``arc`` for many keys ``state * 2**32 + token * 2``; answers are kept, in bit 0, in an open-addressed table."""
        todo, out = np.arange(len(keys)), np.zeros(len(keys), dtype=bool)
        shift = np.uint64(64 - (len(self.slots).bit_length() - 1))
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
        missing = []
        while len(todo):
            seen = self.slots[at]
            hit = (seen & ~1) == keys[todo]
            hit &= seen >= 0
            out[todo[hit]] = (seen[hit] & 1).astype(bool)
            missing.append(todo[seen < 0])
            on = ~hit & (seen >= 0)
            todo, at = todo[on], (at[on] + 1) & (len(self.slots) - 1)
        lost = np.concatenate(missing) if missing else todo
        if len(lost):
            new, where = np.unique(keys[lost], return_inverse=True)
            answers = np.array([self.arc(k >> 32, (k >> 1) & 0x7FFFFFFF) for k in new.tolist()], dtype=bool)
            out[lost] = answers[where]
            self._keep(new | answers)
        return out

    def _keep(self, entries: np.ndarray) -> None:
        if 2 * (self.filled + len(entries)) > len(self.slots):
            entries = np.concatenate([self.slots[self.slots >= 0], entries])
            size = len(self.slots)
            while 4 * len(entries) > size:
                size *= 2
            if size > 1 << 23:
                size, entries = 1 << 16, entries[:0]
            self.slots, self.filled = np.full(size, -1, dtype=np.int64), 0
        shift, mask, slots = 64 - (len(self.slots).bit_length() - 1), len(self.slots) - 1, self.slots
        for e in entries.tolist():
            at = (((e & ~1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> shift
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = e
        self.filled += len(entries)

    def encode_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """``encode_bytes`` of many words at once: byte by byte, the one token that ends there in each word."""
        if not words:
            return []
        if self.base is None:
            self._tables()
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        end = np.cumsum(size)
        start = end - size
        order = np.argsort(-size, kind="stable")
        by_start, by_end = start[order], end[order]
        falling = -size[order]
        ending = np.full(len(data), -1, dtype=np.int64)
        for offset in range(int(size.max())):
            n = int(np.searchsorted(falling, -offset, side="left"))
            at, stop = by_start[:n] + offset, by_end[:n]
            state = self.after[ending[at - 1]] if offset else np.zeros(n, dtype=np.int64)
            node = np.zeros(n, dtype=np.int64)
            while len(at):
                place = self.base[node] + data[at]
                node = np.where(self.owner[place] == node, self.target[place], 0)
                token = self.node_token[node]
                new = np.flatnonzero((token >= 0) & (ending[at] < 0) & (node > 0))
                if len(new):
                    has = new[self._has((state[new] << 32) | (token[new] << 1))]
                    ending[at[has]] = token[has]
                on = np.flatnonzero((node > 0) & (node < self.inner) & (at + 1 < stop))
                at, stop, state, node = at[on] + 1, stop[on], state[on], node[on]
        last = np.zeros(len(data), dtype=bool)
        at, first = end - 1, start
        while len(at):
            last[at] = True
            at = at - self.width[ending[at]]
            on = at >= first
            at, first = at[on], first[on]
        bounds = np.concatenate([[0], np.cumsum(last)])[np.concatenate([[0], end])].tolist()
        flat = ending[last].tolist()
        return [tuple(flat[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)]

    def learn(self, texts: list[str]) -> None:
        """Encodes the new words of some texts together into the word table."""
        if len(self.words) >= WORD_TABLE:
            self.words.clear()
        new = {w for t in texts for w in self.split.findall(t) if w not in self.words and len(w) <= LONG_WORD}
        if new:
            self.words.update(zip(new, self.encode_many([w.encode() for w in new]), strict=True))

    def encode(self, text: str, special: bool = True) -> list[int]:
        """Ids of a text; with ``special``, the special tokens' strings in it give their ids."""
        if special and self.split_special is not None and any(x in text for x in self.special):
            ids: list[int] = []
            for part in self.split_special.split(text):
                if part in self.special:
                    ids.append(self.special[part])
                elif part:
                    ids += self.encode(part, special=False)
            return ids
        ids = []
        words, add = self.words, ids.extend
        for word in self.split.findall(text):
            found = words.get(word)
            add(self.encode_bytes(word.encode()) if found is None else found)
        return ids

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """``encode`` of every text. Words are split once and new ones are encoded together."""
        if len(self.words) >= WORD_TABLE:
            self.words.clear()
        words, special = self.words, [x for x in self.special if any(x in t for t in texts)]
        if special:
            self.learn(texts)
            return [self.encode(t) for t in texts]
        split = [self.split.findall(t) for t in texts]
        new = list({w for found in split for w in found if w not in words})
        short = [w for w in new if len(w) <= LONG_WORD]
        words.update(zip(short, self.encode_many([w.encode() for w in short]), strict=True))
        rare = {w: self.encode_bytes(w.encode()) for w in new if len(w) > LONG_WORD}
        get = (lambda w: rare[w] if w in rare else words[w]) if rare else words.__getitem__
        return [list(chain.from_iterable(map(get, found))) for found in split]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", errors="replace")


_built: dict[str, Automaton] = {}


def automaton(key: str, vocabulary: dict) -> Automaton:
    """The automaton of a vocabulary, compiled once per Python worker."""
    if key not in _built:
        _built[key] = Automaton(vocabulary)
    return _built[key]


def shared_vocabulary(spark, path: str):
    """A broadcast of the vocabulary (its size is that of a vocabulary file, whatever the input) and its key."""
    vocabulary = read_vocabulary(path)
    return hashlib.sha256(path.encode()).hexdigest()[:16], spark.sparkContext.broadcast(vocabulary)


def _each_text(docs: DataFrame, path: str, make, schema: str) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark, 128)
    key, vocabulary = shared_vocabulary(spark, path)

    def run(batches):
        a = automaton(key, vocabulary.value)
        try:
            for batch in batches:
                yield make(a, batch)
        finally:
            a.words.clear()  # the worker lives on, in other operators' stages too
            release()

    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids array<int>)`` for every row of ``docs(doc_id, text)``.

    The ids are those of the vocabulary at ``path`` without added special tokens; strings of special tokens inside a
    text give their ids. A null or empty text has no ids. Rows of null or repeated doc_id are encoded like any other.
    """

    def make(a, batch):
        ids = a.encode_batch(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _each_text(docs, path, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` from ``encoded(doc_id, ids)``; null ids give an empty text."""
    spark = encoded.sparkSession
    small_batches(spark, 128)
    key, vocabulary = shared_vocabulary(spark, path)

    def run(batches):
        a = automaton(key, vocabulary.value)
        for batch in batches:
            texts = [a.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def encode_and_decode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids])`` per row: one pass that encodes each text, then decodes its ids.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the decoded text in UTF-8. A null or empty
    text has 0 tokens and the digests of the empty string.
    """

    def make(a, batch):
        n, of_ids, of_text, kept = [], [], [], []
        decimal = a.__dict__.setdefault("decimal", {i: str(i) for i in a.label}).__getitem__
        for ids in a.encode_batch(batch.column(1).to_pylist()):
            n.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
            of_text.append(hashlib.sha256(a.decode(ids).encode()).hexdigest())
            if keep_ids:
                kept.append(ids)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            columns.append(pa.array(kept, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _each_text(docs, path, make, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
