"""Exact SentencePiece encoding (merge type) by backtracking, and decoding.

The text is escaped as the model wants it: a leading mark, and marks for blanks. No piece has a mark after
another character, so what follows a run of marks is encoded by itself and remembered. Inside such a chunk an
Aho-Corasick pass gives the longest piece at each position. Pieces are taken longest first; a piece may
follow another only if merging the two's characters anew, best score first, gives just these two pieces.
Where nothing fits, the last piece is taken back and its end marked in a bit field, so no position fails
twice. A sequence whose neighbours all fit is the one that merging yields. Characters that are no piece
become their UTF-8 bytes.

Supported are merge-type models with byte fallback, a leading mark and no other normalisation; others are
refused. Defined results: a null or empty text has only the begin and end ids and decodes to the empty text.
The mark U+2581 itself decodes to a blank, as in the library.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
KEPT_CHUNKS = 200_000
KEPT_PAIRS = 300_000
LONGEST_KEPT = 64


def read_model(path: str) -> dict:
    """Pieces, scores and special ids of a model file, as plain values."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    special = [i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)]
    byte_ids = [i for i in ids if model.is_byte(i)]
    found = {
        "pieces": [model.id_to_piece(i) for i in ids],
        "scores": [model.get_score(i) for i in ids],
        "special": special,
        "bytes": byte_ids,
        "begin": model.bos_id(),
        "end": model.eos_id(),
    }
    probe = model.encode(" a  b\tＡ", out_type=str)
    if len(byte_ids) != 256 or probe[0] != MARK or probe[-1] == "A":
        raise ValueError(f"{path}: only models with byte fallback and without normalisation are supported")
    return found


class Encoder:
    """Encodes and decodes with one model; remembers chunks and pairs up to fixed numbers."""

    def __init__(self, model: dict):
        self.scores, self.begin, self.end = model["scores"], model["begin"], model["end"]
        pieces, skipped = model["pieces"], {*model["special"], *model["bytes"]}
        self.ids = {p: i for i, p in enumerate(pieces) if i not in skipped}
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in model["bytes"]}
        if any(MARK in p.lstrip(MARK) for p in self.ids) or any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a piece joins words or holds a character that is no piece")
        self.texts = pieces
        reachable = [p for p in self.ids if self.merged(p) == [self.ids[p]]]
        self.automaton = ahocorasick.Automaton()
        for p in reachable:
            self.automaton.add_word(p, (len(p), self.ids[p]))
        self.automaton.make_automaton()
        known = set(reachable)
        self.lengths = {self.ids[p]: len(p) for p in reachable}
        self.shorter = {
            self.ids[p]: next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in known), None)
            for p in reachable
        }
        self.characters = frozenset(p for p in self.ids if len(p) == 1)
        self.parts = re.compile(f"([{''.join(map(re.escape, self.characters))}]+)")
        self.chunks = re.compile(f"{MARK}+[^{MARK}]*")
        self.kept: dict[str, bytes] = {}
        self.kept_before: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.as_bytes = [p.replace(MARK, " ").encode() for p in pieces]
        for value, i in self.byte_ids.items():
            self.as_bytes[i] = bytes([value])
        for i in model["special"]:
            self.as_bytes[i] = b""

    def merged(self, text: str) -> list[int]:
        """The pieces that merging yields: always the best-scored neighbours, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def fits(self, first: int, second: int) -> bool:
        """Whether the two pieces stay as they are when their characters are merged anew."""
        key = first << 32 | second
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.texts[first] + self.texts[second]) == [first, second]
        return known

    def known_part(self, part: str) -> list[int]:
        """The ids of a text whose characters all are pieces."""
        n = len(part)
        longest = [0] * n
        for last, (length, piece) in self.automaton.iter(part):
            longest[last - length + 1] = piece
        if self.lengths[longest[0]] == n:
            return [longest[0]]
        lengths, shorter, pairs, fits = self.lengths, self.shorter, self.pairs, self.fits
        open_ = bytearray(b"\x01") * (n + 1)
        taken: list[int] = []
        at, piece = 0, longest[0]
        while at < n:
            end = at + lengths[piece]
            if open_[end] and (not taken or pairs.get(taken[-1] << 32 | piece) or fits(taken[-1], piece)):
                taken.append(piece)
                at = end
                piece = longest[at] if at < n else 0
                continue
            less = shorter[piece]
            while less is None:
                if not taken:
                    raise ValueError("no sequence of pieces fits")
                open_[at] = 0
                piece = taken.pop()
                at -= lengths[piece]
                less = shorter[piece]
            piece = less
        return taken

    def chunk(self, chunk: str) -> bytes:
        """The ids of a chunk. Those met lately are kept, in two generations: what is met again while the older
        one is dropped moves on to the newer."""
        found = self.kept_before.get(chunk) or self.encoded(chunk)
        if len(chunk) <= LONGEST_KEPT:
            if len(self.kept) >= KEPT_CHUNKS:
                self.kept_before, self.kept = self.kept, {}
            self.kept[chunk] = found
        return found

    def encoded(self, chunk: str) -> bytes:
        if self.characters.issuperset(chunk):
            ids = self.known_part(chunk)
            return struct.pack(f"<{len(ids)}I", *ids)
        ids = []
        for i, part in enumerate(self.parts.split(chunk)):
            if not part:
                continue
            if i % 2:
                ids.extend(self.known_part(part))
            else:
                ids.extend(self.byte_ids[b] for b in part.encode("utf-8", "surrogatepass"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids with begin and end, as little-endian unsigned 32-bit integers."""
        parts = [struct.pack("<I", self.begin)]
        if text:
            for chunk in self.chunks.findall(MARK + text.replace(" ", MARK)):
                parts.append(self.kept.get(chunk) or self.chunk(chunk))
        parts.append(struct.pack("<I", self.end))
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """The text of ids, without the blank that stands for the leading mark."""
        values = np.frombuffer(ids, dtype="<u4").tolist()
        whole = b"".join(map(self.as_bytes.__getitem__, values)).decode("utf-8", "replace")
        return whole[1:] if whole.startswith(" ") else whole


@lru_cache(maxsize=2)
def model_at(path: str) -> tuple:
    return (read_model(path),)


def encoded(documents: DataFrame, path: str, ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """``documents`` with the ids of the whole text (binary, little-endian unsigned 32-bit) and, if named,
    the text they decode to."""
    spark: SparkSession = documents.sparkSession
    # A worker keeps the value of a broadcast, and with it the encoder and what it remembers, for all its tasks.
    held = spark.sparkContext.broadcast({"model": model_at(path)[0]})
    decode = decoded is not None

    @F.pandas_udf("ids binary, decoded string")
    def encode(texts: pd.Series) -> pd.DataFrame:
        value = held.value
        encoder = value.get("encoder")
        if encoder is None:
            encoder = value["encoder"] = Encoder(value["model"])
        found = [encoder.encode(t or "") for t in texts]
        back = [encoder.decode(f) for f in found] if decode else [None] * len(found)
        return pd.DataFrame({"ids": found, "decoded": pd.Series(back, dtype=object)})

    name = "_pieces"
    while name in documents.columns:
        name = "_" + name
    rows = documents.withColumn(name, encode(F.coalesce(documents["text"], F.lit(""))))
    rows = rows.withColumn(ids, F.col(f"{name}.ids"))
    return (rows.withColumn(decoded, F.col(f"{name}.decoded")) if decode else rows).drop(name)
