"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces and one Viterbi pass.

At each position the automaton follows its output links to every piece that ends there, and each relaxes
the best score of the position; a strictly better score wins, so ties go to the longer piece. A character
that no piece covers costs the lowest score less 10 and becomes the byte pieces of its UTF-8 form. The model
file's scores are taken as they are: for a model of merges this is the segmentation of highest total score, not
the order of merges. A text is cut where no piece can reach across (before a blank after another
character, around line feeds), which changes nothing in the result, and what lies between is looked up when seen before.

Decoding joins the pieces, and the bytes of byte pieces; a literal U+2581 is kept apart from blanks by
byte pieces, so decode(encode(text)) == text for every text.

Cases: a null text has null ids and decodes to null; an empty text has no ids. Each row gives one row, with
repeats and null ids kept; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm import session, text

MODEL = os.environ.get("SITELENS_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
_REMEMBERED = 1 << 17
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6


def _fields(raw: bytes):
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value, at = raw[at : at + n], at + n
        yield key >> 3, value


@dataclass
class Pieces:
    """A model: its pieces with blanks in place of U+2581, the automaton, and what has been encoded before."""

    raw: bytes
    names: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.bytes_at, self.unknown, self.is_byte = {}, 0, {}
        self.automaton = ahocorasick.Automaton()
        least, covered = 0.0, set()
        inner = set()
        for number, value in _fields(self.raw):
            if number != 1:
                continue
            piece = {1: b"", 2: b"\0\0\0\0", 3: _NORMAL} | dict(_fields(value))
            k, name, score = len(self.names), piece[1].decode(), struct.unpack("<f", piece[2])[0]
            self.names.append("" if piece[3] not in (_NORMAL, _USER) else name.replace(SPACE, " "))
            self.scores.append(score)
            if piece[3] == _UNKNOWN:
                self.unknown = k
            elif piece[3] == _BYTE:
                self.bytes_at[int(name[3:5], 16)], self.is_byte[k] = k, int(name[3:5], 16)
            elif piece[3] in (_NORMAL, _USER):
                own = self.names[k]
                self.automaton.add_word(own, (len(own), score, k))
                least = min(least, score)
                inner.update(zip(own, own[1:]))
                if len(own) == 1:
                    covered.add(own)
        self.automaton.make_automaton()
        self.least, self.covered = least - 10, covered
        self.cuts = not any(b == " " and a != " " or "\n" in (a, b) for a, b in inner)
        self.seen: dict[str, bytes] = {}

    def best(self, s: str) -> list[int]:
        """Ids of the best segmentation of s, in which blanks stand for U+2581."""
        n = len(s)
        score, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
        score[0] = 0.0
        at = 0
        for last, (size, own, k) in self.automaton.iter(s):
            to = last + 1
            while at < to:
                if s[at] not in self.covered and score[at] + self.least > score[at + 1]:
                    score[at + 1], back[at + 1] = score[at] + self.least, (at, -1)
                at += 1
            if score[to - size] + own > score[to]:
                score[to], back[to] = score[to - size] + own, (to - size, k)
        while at < n:
            if s[at] not in self.covered and score[at] + self.least > score[at + 1]:
                score[at + 1], back[at + 1] = score[at] + self.least, (at, -1)
            at += 1
        out: list[int] = []
        while n:
            start, k = back[n]
            if k >= 0:
                out.append(k)
            else:
                out.extend(self.bytes_at.get(b, self.unknown) for b in reversed(s[start:n].encode()))
            n = start
        return out[::-1]

    def _unit(self, s: str) -> bytes:
        ids = np.array(self.best(s), "<i4").tobytes()
        if len(s) <= 64:
            if len(self.seen) >= _REMEMBERED:
                self.seen.clear()
            self.seen[s] = ids
        return ids

    def encode(self, s: str) -> np.ndarray:
        """The ids of a text, with a blank put before it as the model does."""
        if not s:
            return np.zeros(0, "<i4")
        units = _UNITS.findall(" " + s) if self.cuts else [" " + s]
        get = self.seen.get
        return np.frombuffer(b"".join([get(u) or self._unit(u) for u in units]), "<i4")

    def decode(self, ids) -> str:
        """The text of ids."""
        out: list[bytes] = []
        names, is_byte = self.encoded_names(), self.is_byte
        for k in ids.tolist() if isinstance(ids, np.ndarray) else ids:
            out.append(bytes((is_byte[k],)) if k in is_byte else names[k])
        return b"".join(out).decode("utf-8", "replace")[1:]

    def encoded_names(self) -> list[bytes]:
        if not hasattr(self, "_names"):
            self._names = [x.encode() for x in self.names]
            for k, b in self.is_byte.items():
                self._names[k] = bytes((b,))
        return self._names


_UNITS = re.compile(r" +[^ \n]*|\n|[^ \n]+")
_LOADED: dict[bytes, Pieces] = {}


def load(raw: bytes) -> Pieces:
    """The model of a file's bytes, made once in each process."""
    if raw not in _LOADED:
        _LOADED.clear()
        _LOADED[raw] = Pieces(raw)
    return _LOADED[raw]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): decoded is the text made again from the ids alone.

    The model file is read on the driver and broadcast; executors need no such file.
    """
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        own = load(shared.value)
        names = np.array(own.encoded_names(), object)
        for batch in batches:
            for at, to, _, _ in text.pieces(batch.column(1)):
                texts = batch.column(1).slice(at, to - at).to_pylist()
                ids = [None if t is None else own.encode(t) for t in texts]
                made = [None if x is None else b"".join(names[x].tolist()).decode("utf-8", "replace")[1:] for x in ids]
                counts = np.array([0 if x is None else len(x) for x in ids], np.int64)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, "<i4")])
                nulls = pa.array([x is None for x in ids], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)), mask=nulls)
                n_tokens = pa.array(counts, mask=np.array([x is None for x in ids], bool))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), n_tokens, lists, pa.array(made, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def op2_pieces(spark, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`: its ids, and the hash of the text decoded from them."""
    session.workers_find_package(spark)
    done = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
