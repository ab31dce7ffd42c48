"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a one-pass Viterbi.

All pieces of a model form one automaton.  Running it over a text visits every position
once; the output links of the state give every piece that ends there, longest first, and
each relaxes the best score of its end from the best score of its start.  The best
segmentation is the one with the largest sum of piece scores (a tie: the longer last piece).

No piece holds a space mark behind another character, so a segmentation falls apart before
every space mark: a text is cut there and each distinct unit is segmented once per task (a
bounded cache).  Characters without a piece become the byte pieces of their UTF-8 form.
Decoding joins the pieces, turns space marks into spaces and drops the leading one."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: How far below the worst piece a character without a piece scores.
UNKNOWN = 10.0
CACHE_UNITS = 250_000
#: Longer units (text without spaces) are segmented without being kept.
CACHE_LENGTH = 64


class Pieces:
    """The pieces of a model, as read from its file on the driver; small and picklable."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], special: list[int], unknown: int):
        self.pieces, self.scores, self.byte_ids, self.special, self.unknown = pieces, scores, byte_ids, special, unknown

    @classmethod
    def load(cls, path: str = MODEL) -> "Pieces":
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(m.get_piece_size())
        pieces = [m.id_to_piece(i) for i in n]
        byte_ids = [0] * 256 if not any(map(m.is_byte, n)) else [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = [i for i in n if m.is_control(i) or m.is_byte(i) or m.is_unused(i) or m.is_unknown(i)]
        return cls(pieces, [m.get_score(i) for i in n], byte_ids, special, m.unk_id())


class Codec:
    """Encoder and decoder built from :class:`Pieces` (once per task)."""

    def __init__(self, known: Pieces):
        special = set(known.special)
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        joins = lines = False
        for i, p in enumerate(known.pieces):
            if i in special or not p:
                continue
            self.automaton.add_word(p, (len(p), i, known.scores[i]))
            joins = joins or SPACE in p.lstrip(SPACE)
            lines = lines or "\n" in p
            if len(p) == 1:
                self.single.add(p)
        self.automaton.make_automaton()
        scores = [s for i, s in enumerate(known.scores) if i not in special]
        self.lost = min(scores, default=0.0) - UNKNOWN
        self.bytes_of = [np.int32(i).tobytes() for i in known.byte_ids] if any(known.byte_ids) else None
        self.unknown = np.int32(known.unknown).tobytes()
        # a space mark starts a unit, unless some piece joins text across it; so does a line end
        # that is in no piece
        stop = "" if lines else "\n"
        self.unit = re.compile(f"{SPACE}+[^{SPACE}{stop}]*|[^{SPACE}{stop}]+|\n" if not joins else r".+", re.S)
        self.packed = [np.int32(i).tobytes() for i in range(len(known.pieces))]
        self.cache: dict[str, bytes] = {}
        self.raw = [p.replace(SPACE, " ").encode() for p in known.pieces]
        for i in known.special:
            self.raw[i] = b""
        if any(known.byte_ids):
            for b, i in enumerate(known.byte_ids):
                self.raw[i] = bytes([b])
        self.raw[known.unknown] = " ⁇ ".encode()
        self.fallback = set(known.byte_ids) if any(known.byte_ids) else set()

    def segment(self, unit: str) -> bytes:
        """The best piece ids of a unit, packed as int32."""
        n = len(unit)
        if n == 1 and unit in self.single:
            return self.packed[self.automaton.get(unit)[1]]
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        gaps = [i for i, c in enumerate(unit) if c not in self.single]
        g = 0
        for end, (size, piece, score) in self.automaton.iter(unit):
            while g < len(gaps) and gaps[g] < end:  # characters before this end that only bytes cover
                p = gaps[g]
                if best[p] + self.lost > best[p + 1]:
                    best[p + 1], back[p + 1] = best[p] + self.lost, (1, -1)
                g += 1
            s = best[end + 1 - size] + score
            if s > best[end + 1]:
                best[end + 1], back[end + 1] = s, (size, piece)
        for p in gaps[g:]:
            if best[p] + self.lost > best[p + 1]:
                best[p + 1], back[p + 1] = best[p] + self.lost, (1, -1)
        out = []
        while n:
            size, piece = back[n]
            n -= size
            if piece >= 0:
                out.append(self.packed[piece])
            elif self.bytes_of:
                out.append(b"".join(self.bytes_of[b] for b in unit[n].encode("utf-8", "surrogatepass")))
            else:
                out.append(self.unknown)
        return b"".join(reversed(out))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        units = self.unit.findall(SPACE + text.replace(" ", SPACE))
        cache = self.cache
        if len(cache) > CACHE_UNITS:
            cache.clear()
        out = []
        for u in units:
            ids = cache.get(u)
            if ids is None:
                ids = self.segment(u)
                if len(u) <= CACHE_LENGTH:
                    cache[u] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_CODECS: dict[str, Codec] = {}


def _codec(model: str, known: Pieces) -> Codec:
    """The worker's codec of a model: reused, with its cache, by the worker's later tasks."""
    if model not in _CODECS:
        _CODECS.clear()
        _CODECS[model] = Codec(known)
    return _CODECS[model]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(id_col, n_tokens, ids, n_byte_tokens, round_trip): one row per input row.

    ids are the piece ids of the whole text, n_byte_tokens how many of them are UTF-8 bytes of
    characters without a piece, round_trip whether decoding gives the text back (space marks
    in a text count as spaces).  Null and empty texts have no tokens; extra columns are ignored."""
    known = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, known.value)
        is_byte = np.zeros(len(codec.raw), bool)
        is_byte[list(codec.fallback)] = True
        for b in batches:
            for s in range(0, b.num_rows, 256):
                cut = b.slice(s, 256)
                texts = cut.column(1).to_pylist()
                ids = [codec.encode(t) for t in texts]
                same = [codec.decode(i.tolist()) == (t or "").replace(SPACE, " ") for i, t in zip(ids, texts, strict=True)]
                n = np.array([len(i) for i in ids], np.int64)
                flat = np.concatenate(ids)
                ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
                high = np.concatenate([np.zeros(1, np.int64), np.cumsum(is_byte[flat])])
                yield pa.record_batch([
                    cut.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)),
                    pa.array(high[ends[1:]] - high[ends[:-1]]), pa.array(same)],
                    ["id", "n_tokens", "ids", "n_byte_tokens", "round_trip"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "id long, n_tokens long, ids array<int>, n_byte_tokens long, round_trip boolean")
    return out.withColumnRenamed("id", id_col)
