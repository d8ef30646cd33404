"""SentencePiece BPE encoding by a prefix table, and decoding.

Every prefix of a text has exactly one last token in its encoding. An automaton gives the pieces that end at each
position, longest first; a piece is the prefix's last token if it is compatible with the last token of the prefix
before it, that is, if merging the two pieces' characters by the model's own merges gives back these two. The
tokens are then read backwards from the last prefix. Time is linear in the text, whatever its length. Merges never
cross boundaries that no piece spans (before a meta space that follows another character, between letters and
punctuation), so texts are tabled in such segments and a worker remembers the segments that it has seen.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import small_batches, table, tokenizer_path

MODEL = "piece_bpe_32k.model"
META = "▁"
#: Letters of the scripts whose words are worth telling from what stands beside them.
LETTERS = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0370-\u03ff\u0400-\u052f"
#: Ways to cut a text into segments, finest first; a model uses the first that cuts none of its pieces.
SEGMENTS = [re.compile(f"{META}*[{LETTERS}]+|{META}*[^{META}{LETTERS}]+|{META}+"), re.compile(f"{META}*[^{META}]+|{META}+")]
#: Segments that a worker remembers; beyond it the memory starts anew (results stay the same).
REMEMBERED = 800_000
#: Longer segments are not remembered.
LONGEST = 64


class PieceModel:
    """The vocabulary of a SentencePiece BPE model with identity normalisation, dummy prefix and byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.lib = SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        proto.ParseFromString(self.lib.serialized_model_proto())
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or trainer.treat_whitespace_as_suffix or not trainer.byte_fallback or any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("this encoder takes BPE models with identity normalisation, a dummy prefix, byte fallback and no user-defined or unused pieces")
        self.pieces = [p.piece for p in proto.pieces]
        self.normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.score = [p.score for p in proto.pieces]
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.bytes_of = {i: b for b, i in self.byte_id.items()}
        self.control = {i for i, p in enumerate(proto.pieces) if p.type in (2, 3)}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.unk_surface = trainer.unk_surface
        if any(re.search(f"[^{META}]{META}", p) for p in self.normal):
            raise ValueError("pieces with an inner meta space are not supported")
        self.segment = next(r for r in SEGMENTS if all(r.findall(p) == [p] for p in self.normal)).findall
        #: Pieces that the merges reach, by text; others never come out of the encoder.
        self.reached = {p: i for p, i in self.normal.items() if self.merge(p) == [i]}

    def merge(self, text: str) -> list[int]:
        """Plain merging of adjacent symbols, best score first, then leftmost. For short texts only."""
        sym, n = list(text), len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                both = sym[i] + sym[after[i]]
                if (k := self.normal.get(both)) is not None:
                    heapq.heappush(heap, (-self.score[k], i, both))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not sym[i] or j >= n or sym[i] + sym[j] != both:
                continue
            sym[i], sym[j] = both, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [self.normal.get(s, -1) for s in sym if s]


class Encoder(dict):
    """Remembered segments: text -> ids as bytes (unsigned 16- or 32-bit). Missing ones are tabled."""

    def __init__(self, model: PieceModel, remembered: int = REMEMBERED):
        import ahocorasick

        super().__init__()
        self.model, self.remembered, self.pairs = model, remembered, {}
        self.code = "H" if len(model.pieces) <= 1 << 16 else "I"
        self.found = ahocorasick.Automaton()
        for piece, i in model.reached.items():
            self.found.add_word(piece, (len(piece), i))
        self.found.make_automaton()
        self.wide = len(model.pieces)

    def compatible(self, left: int, right: int) -> bool:
        m = self.model
        ok = m.merge(m.pieces[left] + m.pieces[right]) == [left, right]
        self.pairs[left * self.wide + right] = ok
        return ok

    def table(self, text: str) -> list[int]:
        """ids of one segment: the last token of every prefix, then the ids backwards."""
        last, pairs, wide, done = [None] * len(text), self.pairs, self.wide, -1
        for end, token in self.found.iter(text):
            if end == done:
                continue
            n, i = token
            if end >= n and (before := last[end - n]):
                left = before[1]
                ok = pairs.get(left * wide + i)
                if not (self.compatible(left, i) if ok is None else ok):
                    continue
            last[end], done = token, end
        out, at = [], len(text) - 1
        while at >= 0:
            if token := last[at]:
                out.append(token[1])
                at -= token[0]
            else:
                out += [self.model.byte_id[b] for b in reversed(text[at].encode("utf-8"))]
                at -= 1
        out.reverse()
        return out

    def __missing__(self, segment: str) -> bytes:
        ids = array(self.code, self.table(segment)).tobytes()
        if len(segment) <= LONGEST:
            if len(self) >= self.remembered:
                self.clear()
            self[segment] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, self.code)
        return np.frombuffer(b"".join(map(self.__getitem__, self.model.segment(META + text.replace(" ", META)))), self.code)


class Decoder:
    """ids -> text as the library's decode(ids)."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.text = [p.replace(META, " ") for p in model.pieces]
        for i in model.control:
            self.text[i] = model.unk_surface if i == model.unknown else ""
        self.special = np.zeros(len(model.pieces), bool)
        self.special[list(model.bytes_of)] = True

    def decode(self, ids: np.ndarray) -> str:
        text = self.text
        if not self.special[ids].any():
            out = "".join(map(text.__getitem__, ids.tolist()))
        else:
            parts, run = [], bytearray()
            for i in ids.tolist():
                if (b := self.model.bytes_of.get(i)) is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(broken_utf8(bytes(run)))
                    run.clear()
                parts.append(text[i])
            parts.append(broken_utf8(bytes(run)))
            out = "".join(parts)
        return out[1:] if len(ids) and self.model.pieces[ids[0]].startswith(META) else out


def broken_utf8(raw: bytes) -> str:
    """Text of the bytes; each byte that starts no valid character becomes a replacement character."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode("utf-8"))
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(maxsize=1)
def coders(path: str) -> tuple[Encoder, Decoder]:
    """A worker process builds these once and keeps its segments from task to task."""
    model = PieceModel(path)
    return Encoder(model), Decoder(model)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; a null text counts as empty and has no ids."""
    small_batches(docs.sparkSession)
    path = path or tokenizer_path(MODEL)

    def run(batches):
        encoder, _ = coders(path)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                ids = [encoder.encode(t or "").astype(np.int32) for t in part.column(1).to_pylist()]
                offsets = np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    path = path or tokenizer_path(MODEL)

    def run(batches):
        _, decoder = coders(path)
        for b in batches:
            texts = [decoder.decode(np.array(i or [], np.int64)) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) in one pass: encode, digest the ids, decode them, digest the text.

    Every row of docs gives one row, repeated ones too; texts are whole however long; null texts count as empty. An
    empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    path = path or tokenizer_path(MODEL)

    def run(batches):
        encoder, decoder = coders(path)
        digits = [str(i) for i in range(encoder.wide)]
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                n, a, d = [], [], []
                for t in part.column(1).to_pylist():
                    ids = encoder.encode(t or "")
                    n.append(len(ids))
                    a.append(sha(",".join(map(digits.__getitem__, ids.tolist()))))
                    d.append(sha(decoder.decode(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"))
