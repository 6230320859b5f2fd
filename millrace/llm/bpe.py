"""Operator 7: byte-pair encoding and decoding by batched merge rounds in numpy.

The symbols of many words stand in one flat array. A round looks up the pairs that changed by binary search over the sorted pair keys, finds each
word's lowest rank and merges its occurrences from left to right; words without a mergeable pair leave the array.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.llm import common as C

#: Words whose tokens a Python worker remembers between chunks, and bytes of text whose words are encoded together: bounds on memory only.
REMEMBERED, CHUNK = 400_000, 6 << 20
_NONE = np.int64(1 << 40)


@dataclass
class Tokenizer:
    """keys: sorted pair keys left << 32 | right, with each pair's rank and merged id. single, last: ids of the bytes inside a word and at its end."""

    keys: np.ndarray
    rank: np.ndarray
    merged: np.ndarray
    single: np.ndarray
    last: np.ndarray
    names: list[str]
    special: dict[str, int]
    pattern: str


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next code point from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def load(path: str) -> Tokenizer:
    """Reads a tokenizer file with byte-level merges, word-end marks, lower-casing and dropped white space. Other kinds are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, vocab = spec["model"], spec["model"]["vocab"]
    end = model["end_of_word_suffix"]
    kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
    split = spec["pre_tokenizer"]["pretokenizers"][0]
    if model["type"] != "BPE" or not end or kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or spec["decoder"]:
        raise ValueError(f"{path} is not a lower-casing BPE vocabulary with word ends")
    symbols = byte_symbols()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
    to = np.array([vocab[a + b] for a, b in pairs], np.int64)
    made = {int(t): r for r, t in enumerate(to)}
    if len(made) != len(to) or any(made.get(int(x), -1) >= r for part in (left, right) for r, x in enumerate(part)):
        raise ValueError("a merge uses a symbol that a later merge makes")
    key = left << 32 | right
    order = np.argsort(key)
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    names = [""] * (1 + max([*vocab.values(), *special.values()]))
    for k, v in [*vocab.items(), *special.items()]:
        names[v] = k
    return Tokenizer(key[order], order.astype(np.int64), to[order], np.array([vocab[s] for s in symbols], np.int64), np.array([vocab[s + end] for s in symbols], np.int64), names, special, split["pattern"]["Regex"])


def _ranks(t: Tokenizer, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = left << 32 | right
    i = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
    hit = t.keys[i] == key
    return np.where(hit, t.rank[i], _NONE), t.merged[i]


def merge_words(t: Tokenizer, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the words back to back, and each word's offset in them. No word may be empty."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(size)
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    sym = t.single[raw]
    sym[ends - 1] = t.last[raw[ends - 1]]
    word = np.repeat(np.arange(len(pieces)), size)
    rank, made = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
    inner = np.flatnonzero(word[1:] == word[:-1])
    rank[inner], made[inner] = _ranks(t, sym[inner], sym[inner + 1])
    done_sym, done_word = [], []
    while len(sym):
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        lowest = np.minimum.reduceat(rank, heads)
        spread = np.diff(np.append(heads, len(sym)))
        if (out := lowest == _NONE).any():
            gone = np.repeat(out, spread)
            done_sym.append(sym[gone])
            done_word.append(word[gone])
            sym, word, rank, made, lowest, spread = sym[~gone], word[~gone], rank[~gone], made[~gone], lowest[~out], spread[~out]
            if not len(sym):
                break
        low = rank == np.repeat(lowest, spread)
        # Of pairs that overlap, as in a run of one symbol, every second is merged.
        at = np.flatnonzero(low)
        run = np.flatnonzero(np.append(True, np.diff(at) != 1))
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        sym[at] = made[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
        new = place[at]
        touched = np.union1d(new, new[new > 0] - 1)
        inside = (touched + 1 < len(sym)) & (word[np.minimum(touched + 1, len(sym) - 1)] == word[touched])
        rank[touched] = _NONE
        touched = touched[inside]
        rank[touched], made[touched] = _ranks(t, sym[touched], sym[touched + 1])
    sym, word = np.concatenate([*done_sym, sym]), np.concatenate([*done_word, word])
    order = np.argsort(word, kind="stable")
    return sym[order], np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(pieces)))))


def _lower(s: str) -> str:
    """Lower case letter by letter: no form depends on its place in a word."""
    return s.replace("Σ", "σ").lower()


class Encoder:
    """Encodes words without ASCII white space; each distinct one once, remembered up to a bound."""

    def __init__(self, t: Tokenizer, remembered: int | None = None):
        self.t, self.remembered = t, remembered or REMEMBERED
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(t.special, key=len, reverse=True))) + ")") if t.special else None
        self.find = regex.compile(t.pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.known: dict[bytes, tuple[str, int, str]] = {}

    def _pieces(self, word: bytes) -> list:
        """The word's pieces as bytes, and special tokens as ids."""
        text, out = word.decode("utf-8", "replace"), []
        for i, part in enumerate(self.special.split(text) if self.special and "<" in text else [text]):
            if i % 2:
                out.append(self.t.special[part])
            else:
                out.extend(x.encode() for x in self.find(_lower(unicodedata.normalize("NFC", part))))
        return out

    def __call__(self, some: list[bytes]) -> list[tuple[str, int, str]]:
        """For each word its ids as decimals, each with a space after it, their number, and their tokens, likewise."""
        if len(self.known) + len(some) > self.remembered:
            self.known.clear()
        new = [w for w in some if w not in self.known]
        split = [self._pieces(w) for w in new]
        distinct = list(dict.fromkeys(x for p in split for x in p if isinstance(x, bytes)))
        ids, off = merge_words(self.t, distinct) if distinct else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        ids, off, names = ids.tolist(), off.tolist(), self.t.names
        at = {w: i for i, w in enumerate(distinct)}
        for w, p in zip(new, split):
            own = [y for x in p for y in ((x,) if isinstance(x, int) else ids[off[at[x]] : off[at[x] + 1]])]
            self.known[w] = "".join(f"{x} " for x in own), len(own), "".join(f"{names[x]} " for x in own)
        return [self.known[w] for w in some]


def bpe(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False, remembered: int = REMEMBERED, chunk: int = CHUNK) -> DataFrame:
    """Encodes whole texts and decodes the ids again.

    tokenizer: path of the vocabulary file, read on the driver and shipped with the tasks. The vocabulary drops white space and so words are encoded apart;
    strings of special tokens in a text become their ids. Without a decoder in the file, decoded text is the tokens joined by spaces. Returns the
    id, n_tokens and the SHA-256 of the ids (decimals joined by a space) and of the decoded text; with_ids adds `ids`, with_text adds `decoded`.
    remembered and chunk bound a Python worker's memory and change no result.
    A null or empty text has no tokens; repeated rows and null ids are carried along; further columns are not read. No shuffle.
    """
    t = load(tokenizer)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches):
        encode = Encoder(t, remembered)
        for b in C.chunks(batches, chunk):
            raw, off = C.flat(b.column("text"))
            start, end, row = C.words(raw, off)
            _, one, back = np.unique(C.span_hash(C.prefix_sums(raw), start, end), return_index=True, return_inverse=True)
            data = raw.tobytes()
            got = encode([data[s:e] for s, e in zip(start[one].tolist(), end[one].tolist())])
            ids, size, text = [x[0] for x in got], np.array([x[1] for x in got], np.int64), [x[2] for x in got]
            per_word, bounds = back.tolist(), np.searchsorted(row, np.arange(b.num_rows + 1)).tolist()
            n = C.per_row(row, b.num_rows, size[back]).astype(np.int64) if len(row) else np.zeros(b.num_rows, np.int64)
            out: list[list] = [[], [], [], []]
            for i in range(b.num_rows):
                own = per_word[bounds[i] : bounds[i + 1]]
                encoded = "".join([ids[k] for k in own])[:-1]
                decoded = "".join([text[k] for k in own])[:-1]
                out[0].append(hashlib.sha256(encoded.encode()).hexdigest())
                out[1].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    out[2].append(np.array(encoded.split(), np.int32))
                if with_text:
                    out[3].append(decoded)
            arrays = [b.column("doc_id"), pa.array(n), pa.array(out[0], pa.string()), pa.array(out[1], pa.string())]
            arrays += [pa.array(out[2], pa.list_(pa.int32()))] * with_ids + [pa.array(out[3], pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(arrays, [x.strip().split(" ")[0] for x in schema.split(",")])

    return C.id_text(docs, id_col, text_col).mapInArrow(C.lean(run), schema)
