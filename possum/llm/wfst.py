"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The normaliser, the pieces and the byte fallback of a vocabulary file are
compiled into one transducer: a state for every prefix of a piece, an arc for
every further character, and a closing arc that emits the piece's id with a
weight and returns to the start; a character without a piece goes through
byte arcs. An input is composed with it position by position, and the
shortest path in the tropical semiring (least sum of weights) is its encoding.

The normaliser is the first transducer: its arcs are the file's character map
(leftmost longest match, one character copied where none matches), its output
is fed to the second one. White space is folded and marked as the file says.

Weights. In a unigram file a piece weighs what the file says, minus its
score, and a character without a piece ten more than the heaviest piece, so
paths are the library's. In a file of merge ranks the weight is a constant
plus the rank, in whole numbers: few pieces first, common ones second. There
ids differ from those that repeated merges give; decoding gives the same
normalised text for both. Other kinds of files, files with user-defined
pieces, and white space as a suffix or unmarked are refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from possum.llm.common import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
PIECE_COST = 1_000_000  # above any rank, so the number of pieces decides first
BYTE_COST = 10 * PIECE_COST
CACHE_CHUNKS, CACHE_CHARS = 400_000, 48


UNIGRAM, BPE, USER_DEFINED = 1, 2, 4  # of the file format
UNKNOWN_PENALTY = 10.0


def fields(message: bytes) -> list[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message; nested messages stay bytes."""

    def varint(i: int) -> tuple[int, int]:
        x, shift = 0, 0
        while True:
            b = message[i]
            x, i, shift = x | (b & 127) << shift, i + 1, shift + 7
            if b < 128:
                return x, i

    i, out = 0, []
    while i < len(message):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = message[i : i + size], i + size
        out.append((key >> 3, value))
    return out


def character_map(compiled: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a length, a double-array trie of the sources, and the targets, each ended by a zero byte."""
    if not compiled:
        return {}
    size = int.from_bytes(compiled[:4], "little")
    units, targets = np.frombuffer(compiled[4 : 4 + size], "<u4").astype(np.int64), compiled[4 + size :]
    offset = (units >> 10) << ((units & 512) >> 6)
    label, every = units & 0x800000FF, np.arange(1, 256)
    rules, todo = {}, [(int(offset[0]), b"")]
    while todo:
        base, prefix = todo.pop()
        at = base ^ every
        inside = at < len(units)
        for c in every[inside][label[at[inside]] == every[inside]].tolist():
            node, source = base ^ c, prefix + bytes([c])
            below = node ^ int(offset[node])
            if units[node] >> 8 & 1:  # a source ends here; its leaf holds the place of the target
                start = int(units[below] & 0x7FFFFFFF)
                rules[source.decode()] = targets[start : targets.index(0, start)].decode()
            todo.append((below, source))
    return rules


class Transducer:
    """The compiled vocabulary. Small and of fixed size, so every task holds one."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.sp = sp
        parts = fields(model)
        trainer, rules = (dict(fields(dict(parts).get(n, b""))) for n in (2, 3))
        kind = trainer.get(3, UNIGRAM)
        if kind not in (UNIGRAM, BPE):
            raise ValueError("the vocabulary is neither a unigram nor a merge-rank file")
        if trainer.get(24, 0) or not rules.get(5, 1):
            raise ValueError("white space as a suffix, or without a mark, isn't supported")
        if any(dict(fields(v)).get(3) == USER_DEFINED for n, v in parts if n == 1):
            raise ValueError("user-defined pieces aren't supported")
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unk = sp.unk_id()
        self.text: list[bytes] = []
        self.arcs: list[dict[str, int]] = [{}]
        self.emits: list[tuple[int, float] | None] = [None]  # (id, weight) where a piece ends
        ends_word, least = False, 0.0
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.text.append(bytes([int(piece[3:5], 16)]))
                continue
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
                continue
            self.text.append(piece.replace(SPACE, " ").encode())
            state = 0
            for c in piece:
                if c not in self.arcs[state]:
                    self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.emits.append(None)
                state = self.arcs[state][c]
            score = sp.get_score(i)
            least = min(least, score)
            # in a file of ranks, a piece for a run of spaces has no rank of its own: it takes the constant alone
            self.emits[state] = (i, -score if kind == UNIGRAM else PIECE_COST + (int(-score) if score > -PIECE_COST else 0))
            ends_word |= SPACE in piece.lstrip(SPACE)
        if any(x < 0 or not sp.is_byte(x) for x in self.bytes):
            raise ValueError("the vocabulary has no byte fallback")
        self.unknown = UNKNOWN_PENALTY - least if kind == UNIGRAM else None  # of a character without a piece
        # every path has a cut before a run of spaces unless a piece spans one
        self.chunk = None if ends_word else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.prefix = SPACE if rules.get(3, 1) else ""
        self.folds = bool(rules.get(4, 1))  # runs of spaces become one, none at the ends
        self.rules: list[dict] = [{}]  # a state for every prefix of a source; None: its target
        for source, target in character_map(rules.get(2, b"")).items():
            state = 0
            for c in source:
                if c not in self.rules[state]:
                    self.rules[state][c] = len(self.rules)
                    self.rules.append({})
                state = self.rules[state][c]
            self.rules[state][None] = target
        self.plain = not self.rules[0] and not self.folds
        self.cache: dict[str, bytes] = {}

    def _rewritten(self, text: str) -> Iterator[str]:
        """The character map's output, match by match."""
        rules, i = self.rules, 0
        while i < len(text):
            state, j, end, out = rules[0].get(text[i]), i + 1, i + 1, text[i]
            while state is not None:
                if None in rules[state]:
                    end, out = j, rules[state][None]
                state, j = rules[state].get(text[j]) if j < len(text) else None, j + 1
            yield out
            i = end

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        if not self.plain:
            out, blank = [], self.folds
            for piece in self._rewritten(text) if self.rules[0] else text:
                if blank:
                    piece = piece.lstrip(" ")
                if piece:
                    out.append(piece)
                    blank = self.folds and piece.endswith(" ")
            text = "".join(out).rstrip(" ") if self.folds else "".join(out)
            if not text and self.folds:
                return ""
        return self.prefix + text.replace(" ", SPACE)

    def shortest_path(self, chunk: str) -> list[int]:
        """Ids of least weight; of equal paths the one whose last piece is longest, and so on back."""
        n = len(chunk)
        cost: list[float | None] = [0] + [None] * n
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        arcs, emits = self.arcs, self.emits
        for i in range(n):
            base = cost[i]
            state = arcs[0].get(chunk[i])
            j, single = i + 1, False
            while state is not None:
                out = emits[state]
                if out is not None:
                    single |= j == i + 1
                    w = base + out[1]
                    if cost[j] is None or w < cost[j]:
                        cost[j], back[j] = w, (i, out[0])
                if j == n:
                    break
                state = arcs[state].get(chunk[j])
                j += 1
            if not single:
                w = base + (BYTE_COST * len(chunk[i].encode()) if self.unknown is None else self.unknown)
                if cost[i + 1] is None or w < cost[i + 1]:
                    cost[i + 1], back[i + 1] = w, (i, -1)
        ids, j = [], n
        while j:
            i, piece = back[j]
            ids += [piece] if piece >= 0 else [self.bytes[b] for b in reversed(chunk[i:j].encode())]
            j = i
        return ids[::-1]

    def encode(self, text: str) -> np.ndarray:
        normal = self.normalise(text)
        chunks = self.chunk.findall(normal) if self.chunk else [normal] * bool(normal)
        cache, out = self.cache, []
        for c in chunks:
            got = cache.get(c)
            if got is None:
                got = np.array(self.shortest_path(c), np.int32).tobytes()
                if len(c) <= CACHE_CHARS:
                    if len(cache) >= CACHE_CHUNKS:
                        cache.clear()
                    cache[c] = got
            out.append(got)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: list[int]) -> str:
        """The normalised text, spaces for space marks, without the mark put before the first word."""
        text = self.text
        whole = b"".join([text[i] for i in ids]).decode("utf-8", "replace")
        return whole[1:] if self.prefix and whole.startswith(" ") else whole


_LOADED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The transducer of a vocabulary file, compiled once in each Python worker."""
    if path not in _LOADED:
        with open(path, "rb") as f:
            _LOADED[path] = Transducer(f.read())
    return _LOADED[path]


def _shipped(df: DataFrame, model: str) -> str:
    ship(df.sparkSession)
    df.sparkSession.sparkContext.addFile(model)
    return model.rpartition("/")[2]


def encode_documents(df: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, n_chars, text_sha256, round_trip) for every row.

    ``ids`` encodes the whole text; ``round_trip`` says that decoding them
    gives the text back, as this file normalises it, and ``text_sha256`` is the digest of the
    decoded UTF-8 text. A null text gives null ids, 0 tokens and a null
    digest; an empty text gives no ids. Repeated rows are encoded each; other
    columns are ignored. No shuffle; the vocabulary file is shipped with the
    job, and a task holds a batch and a bounded cache of encoded chunks.
    """
    name = _shipped(df, model)
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.string(), pa.bool_()]
    schema = pa.schema(list(zip(["doc_id", "n_tokens", "ids", "n_chars", "text_sha256", "round_trip"], kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(SparkFiles.get(name))
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = b.column(1).to_pylist()
                ids = [t.encode(x) if x is not None else None for x in texts]
                back = [t.decode(i.tolist()) if i is not None else None for i in ids]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([0 if i is None else len(i) for i in ids], out=offsets[1:])
                flat = np.concatenate([i for i in ids if i is not None]) if any(i is not None for i in ids) else np.empty(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), mask=pa.array([i is None for i in ids]))
                yield pa.record_batch(
                    [b.column(0), pa.array(np.diff(offsets).astype(np.int64)), lists, pa.array([len(x) if x is not None else 0 for x in back], pa.int64()),
                     pa.array([x if x is None else hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
                     pa.array([x is None or _same(t, x, y) for x, y in zip(texts, back, strict=True)])],
                    schema=schema,
                )

    cols = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, n_chars long, text_sha256 string, round_trip boolean")


def _same(t: Transducer, text: str, back: str) -> bool:
    if t.plain:
        return back == text.replace(SPACE, " ")
    return back == t.normalise(text).removeprefix(t.prefix).replace(SPACE, " ")


def decode_documents(df: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from encoded rows; null ids give a null text."""
    name = _shipped(df, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(SparkFiles.get(name))
        for b in batches:
            texts = [None if i is None else t.decode(i) for i in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
