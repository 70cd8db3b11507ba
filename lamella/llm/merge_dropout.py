"""Encoding with a public merge-type piece vocabulary, with seeded merge dropout, and exact decoding.

A text is cut where no piece of the vocabulary can cross (before spaces that follow other characters, around line ends), and each part's
agenda of candidate merges is worked by rank. Each candidate is skipped with chance ``drop`` by a keyed hash of seed, document, the part's
position in it, the part and the candidate's three borders, so every occurrence of a word draws on its own, and equal seeds give equal
segmentations on any cluster. Without dropout the ids are those of the public library.

Characters outside the vocabulary become byte pieces, as does U+2581, which stands for a space inside pieces; decoding gives back
every text byte for byte.

Defined results: a null text is an empty text, whose ids are none. Null ids count as 0 in the draws. Repeated rows get
equal results. No rows: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import Merges, merge_all
from ._vocab import vocabulary_path
from ._words import U64, mix, slabs

MARK = "\udfff"  # the space that the vocabulary puts before a text; no text holds this code point
PARTS = regex.compile(r"\n| +[^ \n]*|[^ \n]+")


class PieceCodec:
    """Ids and texts of a merge-type sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.bytes: list[bytes] = [b""] * sp.vocab_size()
        self.fallback = np.zeros(256, np.int32)
        rank = {}
        for k in range(sp.vocab_size()):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                value = int(piece[3:5], 16)
                self.bytes[k] = bytes([value])
                self.fallback[value] = k
            elif not (sp.is_control(k) or sp.is_unknown(k)):
                self.ids[piece] = k
                self.bytes[k] = piece.replace("▁", " ").encode()
                rank[piece] = -sp.get_score(k)
        order = {s: i for i, s in enumerate(sorted(set(rank.values())))}
        left, right, ranks, merged = [], [], [], []
        for piece, k in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    ranks.append(order[rank[piece]])
                    merged.append(k)
        self.merges = Merges(*(np.array(c, np.int64) for c in (left, right, ranks, merged)))

        #: One symbol for every code point: an id, or -1 for characters that become bytes.
        self.plain = np.full(0x110000, -1, np.int32)
        for piece, k in self.ids.items():
            if len(piece) == 1 and piece != "▁":
                self.plain[ord(piece)] = k
        self.plain[[ord(" "), ord(MARK)]] = self.ids["▁"]

    def parts(self, text: str) -> list[str]:
        found = PARTS.findall(text)
        if found:
            if found[0] == "\n":
                found.insert(0, MARK)
            else:
                found[0] = MARK + found[0]
        return found

    def lines(self, text: str) -> list[list[str]]:
        """The parts of every line; line ends aren't among them."""
        simple = "  " not in text and "\0" not in text
        out = []
        for line in text.split("\n"):
            parts = line.replace(" ", "\0 ").split("\0") if simple else PARTS.findall(line)
            out.append(parts[1:] if simple and not parts[0] else parts)
        if text:
            out[0] = [MARK + out[0][0], *out[0][1:]] if out[0] else [MARK]
        return out

    def encode_parts(self, parts: list[str], places: np.ndarray, seed: int, drop: float) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every part; equal parts at different ``places`` draw on their own."""
        sizes = np.array([len(p) for p in parts], np.int64)
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = self.plain[points]
        odd = np.flatnonzero(symbols < 0)
        if len(odd):
            spelled = [self.fallback[np.frombuffer(chr(points[k]).encode(), np.uint8)] for k in odd]
            room = np.ones(len(points), np.int64)
            room[odd] = [len(b) for b in spelled]
            at = np.cumsum(room) - room
            wide = np.repeat(symbols, room)
            for k, b in zip(at[odd], spelled):
                wide[k : k + len(b)] = b
            symbols = wide
            sizes = np.add.reduceat(room, np.cumsum(sizes) - sizes)
        keys = None
        if drop > 0:
            keys = np.array([xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass"), seed) for p in parts], U64)
            keys = mix(keys ^ mix(places.astype(U64) + U64(1)))
        ids, cut = merge_all(symbols, np.concatenate([[0], np.cumsum(sizes)]), self.merges, keys, drop)
        coded, cut = ids.astype("<u4").tobytes(), (4 * cut).tolist()
        return [coded[a:b] for a, b in zip(cut, cut[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()])[1:]


def places(doc: int, n: int, seed: int) -> np.ndarray:
    """A number for each of the positions of a document's ``n`` parts."""
    start = U64((doc * 0x9E3779B97F4A7C15 + seed * 0xC2B2AE3D27D4EB4F) % 2**64)
    return mix(np.arange(n, dtype=U64) + start)


def _run(path: str, seed: int, drop: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(path)
        line_end = codec.fallback[10].astype("<u4").tobytes()
        for rows, data, offs in slabs(batches, "t", 1 << 20):
            texts, parts, at = [], [], [np.zeros(0, U64)]
            for k, doc in enumerate(rows.column(0).to_pylist()):
                lines = codec.lines(data[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace"))
                texts.append([len(line) for line in lines])
                for line in lines:
                    parts += line
                at.append(places(doc or 0, sum(texts[-1]), seed))
            if drop > 0:
                coded = iter(codec.encode_parts(parts, np.concatenate(at), seed, drop) if parts else [])
            else:
                different = list(set(parts))
                known = dict(zip(different, codec.encode_parts(different, np.zeros(len(different)), seed, 0) if different else []))
                coded = map(known.__getitem__, parts)
            ids = [line_end.join([b"".join(itertools.islice(coded, n)) for n in sizes]) for sizes in texts]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, seed: int = 17, drop: float = 0.1) -> DataFrame:
    """(doc_id, ids) for every row, ids as little-endian unsigned 32-bit numbers."""
    path = model or vocabulary_path("piece_bpe_32k.model")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(_run(path, seed, drop), "doc_id long, ids binary")


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_pieces, text) for every row, then the columns ``carry``; null ids are an empty text."""
    path = model or vocabulary_path("piece_bpe_32k.model")
    more = coded.select(*(carry or []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(path)
        for batch in batches:
            ids = [np.frombuffer(b or b"", "<u4") for b in batch.column(1).to_pylist()]
            texts = [codec.decode(i).decode("utf-8", "replace") for i in ids]
            arrays = [batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(texts, pa.string()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_pieces", "text", *batch.schema.names[2:]])

    schema = "doc_id long, n_pieces long, text string" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in more.schema)
    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"), *(carry or [])).mapInArrow(run, schema)
