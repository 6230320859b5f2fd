"""Operator 9: greedy longest-match word-piece counts by a linear automaton, without building pieces.

The vocabulary is a trie of bytes with two roots: one for the start of a word, one for what follows. Each node holds a failure link, the node where
matching goes on once the longest pieces of its string are taken off, and how many pieces that takes. Reading a word follows edges and, where
none fits, failure links; the links taken are at most as many as the bytes read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import common as C


@dataclass
class Automaton:
    """edges: sorted keys node * 256 + byte, with the node each leads to; link: failure link or -1; popped: pieces taken off with it."""

    edges: np.ndarray
    target: np.ndarray
    link: np.ndarray
    popped: np.ndarray


#: Nodes of the two roots.
START, REST = 0, 1


def read_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces that start a word and pieces that go on in one, from a sentencepiece model: its word mark starts a word; byte and control pieces are left out."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_byte(i) or p.is_unknown(i) or p.is_unused(i))]
    first = [x[1:].encode() for x in pieces if x.startswith("▁") and len(x) > 1]
    return first, [x.encode() for x in pieces if "▁" not in x and x]


def read_fallback(path: str) -> tuple[list[bytes], list[bytes]]:
    """What a sentencepiece model spells other words with: its lone word mark, as an empty first piece, and its byte pieces, which go on in a word."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(p.get_piece_size())
    return [b"" for i in ids if p.id_to_piece(i) == "▁" and not p.is_unused(i)], [bytes([int(p.id_to_piece(i)[3:-1], 16)]) for i in ids if p.is_byte(i)]


def build(first: list[bytes], rest: list[bytes]) -> Automaton:
    """The automaton of a vocabulary, breadth first, so that the link of a node rests on shallower ones only. An empty first piece is the lone word mark."""
    to: list[dict[int, int]] = [{}, {}]
    is_piece = [False, False]
    for root, pieces in ((START, first), (REST, rest)):
        for piece in pieces:
            node = root
            for c in piece:
                if c not in to[node]:
                    to[node][c] = len(to)
                    to.append({})
                    is_piece.append(False)
                node = to[node][c]
            is_piece[node] = True
    link, popped, level = [-1] * len(to), [0] * len(to), [START, REST]
    if is_piece[START]:
        link[START], popped[START] = REST, 1
    while level:
        below = []
        for u in level:
            for c, v in to[u].items():
                below.append(v)
                if is_piece[v]:
                    link[v], popped[v] = REST, 1
                    continue
                z, n = link[u], popped[u]
                while z >= 0 and c not in to[z]:
                    n, z = n + popped[z], link[z]
                if z >= 0:
                    link[v], popped[v] = to[z][c], n
        level = below
    flat = sorted((u * 256 + c, v) for u, m in enumerate(to) for c, v in m.items())
    keys = np.array([k for k, _ in flat], np.int64)
    return Automaton(keys, np.array([v for _, v in flat], np.int64), np.array(link, np.int64), np.array(popped, np.int64))


def count_pieces(a: Automaton, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Pieces of each word raw[start:end], -1 where the vocabulary cannot spell it. All words advance together, a byte a step."""
    node, count = np.full(len(start), START, np.int64), np.zeros(len(start), np.int64)
    order = np.argsort(start - end, kind="stable")  # longest first, so the words still being read are a prefix
    longer = np.sort(end - start)[::-1]
    node, count, at = node[order], count[order], start[order]
    edges = np.append(a.edges, np.iinfo(np.int64).max)
    dead = np.zeros(len(order), bool)
    for step in range(int(longer[0]) if len(longer) else 0):
        live = np.flatnonzero(~dead[: np.searchsorted(-longer, -step)])
        if not len(live):
            break
        byte = raw[at[live] + step]
        while len(live):
            key = node[live] * 256 + byte
            i = np.searchsorted(edges, key)
            found = edges[i] == key
            node[live[found]] = a.target[i[found]]
            live, byte = live[~found], byte[~found]
            count[live] += a.popped[node[live]]
            node[live] = a.link[node[live]]
            lost = node[live] < 0
            dead[live[lost]] = True
            live, byte = live[~lost], byte[~lost]
    rest = np.flatnonzero(~dead & (node != REST))
    while len(rest):
        count[rest] += a.popped[node[rest]]
        node[rest] = a.link[node[rest]]
        dead[rest[node[rest] < 0]] = True
        rest = rest[node[rest] >= 0]
        rest = rest[node[rest] != REST]
    count[dead] = -1
    out = np.empty(len(order), np.int64)
    out[order] = count
    return out


def token_counts(docs: DataFrame, vocabulary: str | tuple[list[bytes], list[bytes]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, greedy pieces, words that the vocabulary cannot spell (one piece each) and the most pieces of a word, for every document; and pieces in full.

    n_pieces counts such a word by what the model falls back to: its lone word mark before a character that no first piece begins with, and byte pieces for
    characters outside the vocabulary; only words that even these cannot spell count one. longest_pieces is the most of a word in that count. With two
    lists of pieces, which have no fallback but an empty first piece as the mark, both counts are the same.

    Words are runs without ASCII white space, read whole whatever their length. A null or empty text has zero of each; repeated rows and null ids are
    carried along; further columns are not read. One pass without a shuffle; each distinct word of a chunk is matched once. vocabulary: a
    sentencepiece model's path, read on the driver only, or the two lists of pieces.
    """
    first, rest = read_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary
    automaton, whole = build(first, rest), None
    if isinstance(vocabulary, str):
        mark, octets = read_fallback(vocabulary)
        whole = build(first + mark, rest + octets)

    def run(batches):
        for b in C.chunks(batches):
            raw, off = C.flat(b.column("text"))
            start, end, row = C.words(raw, off)
            _, one, back = np.unique(C.span_hash(C.prefix_sums(raw), start, end), return_index=True, return_inverse=True)
            got = count_pieces(automaton, raw, start[one], end[one]) if len(start) else np.zeros(0, np.int64)
            full, hard = got.copy(), np.flatnonzero(got < 0)
            if whole and len(hard):
                full[hard] = count_pieces(whole, raw, start[one][hard], end[one][hard])
            got, full = (got[back], full[back]) if len(start) else (got, full)
            unknown, most, most_full = got < 0, np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            got, full = np.where(unknown, 1, got), np.where(full < 0, 1, full)
            np.maximum.at(most, row, got)
            np.maximum.at(most_full, row, full)
            columns = [C.per_row(row, b.num_rows), C.per_row(row, b.num_rows, got).astype(np.int64), C.per_row(row[unknown], b.num_rows), most, C.per_row(row, b.num_rows, full).astype(np.int64), most_full]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in columns)], ["doc_id", "n_words", "n_tokens", "n_unknown", "longest", "n_pieces", "longest_pieces"])

    return C.id_text(docs, id_col, text_col).mapInArrow(C.lean(run), "doc_id long, n_words long, n_tokens long, n_unknown long, longest long, n_pieces long, longest_pieces long")
