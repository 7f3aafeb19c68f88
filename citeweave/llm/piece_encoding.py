"""SentencePiece encoding and decoding: a forward pass shared by the common prefixes of all words.

Distinct marked words are sorted, which is a trie walked depth first: each word takes over the forward values of the
prefix that it shares with the one before. The public model is a byte-pair model, whose encoding isn't the sum of scores
that is largest; for it the forward value of a prefix is the piece that its encoding ends with. That piece is the one t
for which the encoding of the rest ends with a piece s such that s and t, side by side, stay apart under the merges. For
models of summed scores (unigram) the value is the largest sum, as usual.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import free_names, memo, table, text_chunks, trimmed

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: A worker forgets the words it has encoded when they hold this many characters.
MEMO_CHARS = 96 << 20


class Pieces:
    """Vocabulary of a model: piece -> id and score; ids of bytes; forward passes over sorted words."""

    def __init__(self, pieces: dict[str, int], scores: list[float], byte_ids: list[int] | None, unknown: int = 0, merges: bool = True):
        """merges: byte-pair model, whose scores order merges (the larger first); else scores of pieces are summed."""
        self.ids, self.scores, self.byte_ids, self.unknown, self.merges = pieces, scores, byte_ids, unknown, merges
        lengths: dict[str, set[int]] = {}
        for p in pieces:
            if len(p) > 1:
                lengths.setdefault(p[-2:], set()).add(len(p))
        #: Of pieces that end with these two characters, the lengths, longest first.
        self.lengths = {end: tuple(sorted(n, reverse=True)) for end, n in lengths.items()}
        self.apart: dict[tuple[str, str], bool] = {}
        self.least = min(scores, default=0.0) - 10.0

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging, step by step, the neighbours that give the piece of the largest score."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stay(self, s: str, t: str) -> bool:
        """Whether s (maybe empty) and t, side by side, come out of the merges as they are."""
        key = (s, t)
        known = self.apart.get(key)
        if known is None:
            known = self.apart[key] = self.merged(s + t) == ([s, t] if s else [t])
        return known

    def forward(self, words: list[str]) -> Iterator[list[str]]:
        """Pieces of each of `words`, which are sorted. Characters that no piece holds stand alone."""
        ids, lengths, apart, stay, scores = self.ids, self.lengths, self.apart, self.stay, self.scores
        before, last, value = "", [""], [0.0]
        for word in words:
            shared, most = 0, min(len(before), len(word))
            if before[:most] == word[:most]:
                shared = most
            else:
                while before[shared] == word[shared]:
                    shared += 1
            del last[shared + 1 :]
            if self.merges:
                for end in range(shared + 1, len(word) + 1):
                    for n in lengths.get(word[end - 2 : end], ()) if end > 1 else ():
                        if n > end:
                            continue
                        t = word[end - n : end]
                        if t in ids:
                            pair = (last[end - n], t)
                            if apart[pair] if pair in apart else stay(*pair):
                                last.append(t)
                                break
                    else:
                        last.append(word[end - 1])  # one character: the last that can be, and it need not be a piece
            else:
                del value[shared + 1 :]
                for end in range(shared + 1, len(word) + 1):
                    best, piece = value[end - 1] + self.least, word[end - 1]
                    for n in (*(lengths.get(word[end - 2 : end], ()) if end > 1 else ()), 1):
                        k = ids.get(word[end - n : end]) if n <= end else None
                        if k is not None and value[end - n] + scores[k] > best:
                            best, piece = value[end - n] + scores[k], word[end - n : end]
                    last.append(piece)
                    value.append(best)
            out, end = [], len(word)
            while end:
                out.append(last[end])
                end -= len(last[end])
            yield out[::-1]
            before = word

    def numbers(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            k = self.ids.get(p)
            if k is not None:
                out.append(k)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out


def load(path: str) -> tuple[Pieces, list[bytes], object]:
    """The vocabulary of a model file, the bytes that each id stands for, and the library's processor."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = {model.id_to_piece(i): i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(model.is_byte(i) for i in range(n)) else None
    parts = [b"" if model.is_control(i) else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
    for b, i in enumerate(byte_ids or []):
        parts[i] = bytes([b])
    parts[model.unk_id()] = " ⁇ ".encode()
    return Pieces(plain, [model.get_score(i) for i in range(n)], byte_ids, model.unk_id()), parts, model


def _worker(path: str) -> dict:
    kept = memo("pieces")
    if kept.get("path") != path:
        vocabulary, parts, _ = load(path)
        kept.update(path=path, vocabulary=vocabulary, parts=parts, words={}, size=0)
    return kept


_UNITS = re.compile(f"{MARK}+[^{MARK}]*")


def units(text: str) -> list[str]:
    """Marked words of a text: a run of marks and what follows. No piece of the model goes beyond one. One mark alone in
    front is left out, so that most words are the text's own."""
    if not text:
        return []
    if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
        return [u if u[1:2] == MARK else u[1:] for u in _UNITS.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


def encode(texts: list[str], kept: dict) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers."""
    words, vocabulary = kept["words"], kept["vocabulary"]
    if kept["size"] > MEMO_CHARS:
        words.clear()
        vocabulary.apart.clear()
        kept["size"] = 0
    split = [units(t) for t in texts]
    new = sorted(w if w[:1] == MARK else MARK + w for w in set().union(*split).difference(words))
    for w, pieces in zip(new, vocabulary.forward(new)):
        words[w if w[1:2] == MARK else w[1:]] = struct.pack(f"<{len(n := vocabulary.numbers(pieces))}I", *n)
        kept["size"] += len(w) + 64
    return [b"".join(map(words.__getitem__, s)) for s in split]


def decode(ids: list[int], parts: list[bytes]) -> str:
    """The text of ids: pieces with their marks as spaces, but for the first; bytes that aren't UTF-8 become U+FFFD."""
    text = b"".join([parts[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def encode_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of `docs` (with a column text) and struct _pieces of ids, ids_crc32 (of their unsigned 32-bit
    little-endian form), n_bytes (ids of single bytes) and round_trip (whether decoding gives the text again).

    Defined cases: a null or empty text has no ids; characters outside the vocabulary become bytes; white space stays as
    it is, each space one mark; repeated rows are encoded each; texts, very long ones too, are encoded whole; an empty table gives no rows;
    other columns, null or not, pass through, whatever their names.
    """
    path = path or public_tokenizers.path(MODEL)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    at = docs.columns.index("text")
    row_type = own.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _worker(path)
        low = np.zeros(len(kept["parts"]), bool)
        low[kept["vocabulary"].byte_ids or []] = True

        def finish(rows: list, data: list[bytes], texts: list[str]) -> pa.RecordBatch:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in data]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            same = [decode(x.tolist(), kept["parts"]) == t for x, t in zip(ids, texts)]
            n_bytes = [int(low[x].sum()) for x in ids]
            columns = [pa.concat_arrays(rows), pa.ListArray.from_arrays(offsets, flat), pa.array([zlib.crc32(x) for x in data], pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(same, pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=["_row", "ids", "ids_crc32", "n_bytes", "round_trip"])

        for b in batches:
            done = 0
            column = b.column(0).field(at)
            for keys, texts in text_chunks([pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), column], names=["k", "t"])]):
                yield finish([b.column(0).slice(done, len(keys))], encode(texts, kept), texts)
                done += len(keys)

    done = own.mapInArrow(trimmed(run, "pieces"), f"_row {row_type}, ids array<int>, ids_crc32 bigint, n_bytes bigint, round_trip boolean")
    return done.select(*[F.col(f"_row.`{c}`") for c in docs.columns], F.struct("ids", "ids_crc32", "n_bytes", "round_trip").alias(*free_names(docs, "_pieces")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "_pieces.ids", F.expr("bigint(size(_pieces.ids))").alias("n_ids"), "_pieces.ids_crc32", "_pieces.n_bytes", "_pieces.round_trip"
    )
