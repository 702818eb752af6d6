"""SentencePiece encoding and decoding with an Aho-Corasick automaton and one Viterbi pass.

The automaton holds every piece of a public vocabulary. Reading a text once, the matches
that end at a position are found by following output links, and each one relaxes the best
score of that position; the best path is the encoding. Scores are scaled to integers, so
sums are exact and equal scores have one answer: the longest piece wins.

White space: a space becomes U+2581 and one more is put in front, as the vocabulary's
publisher does. A vocabulary of merges has ranks in place of log-probabilities; they are turned
into those of a Zipf law (probability proportional to 1 / rank). No piece holds U+2581 behind another character, so no piece crosses the
start of a word and each word can be encoded on its own; the encodings of short words are
kept in a bounded cache. A character without a piece becomes its UTF-8 bytes, and so does a
U+2581 that stands in the text itself: decode(encode(text)) is the text in every case.

NULL text gives NULL ids and NULL ids give NULL text. Empty text gives no ids. Rows are
independent: repeated rows, extra columns and empty tables pass through. A column of the
name of the result is replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SCALE = 1_000_000
# Fixed: score of a character without a piece, below the worst piece by this much.
UNKNOWN_PENALTY = 10
CACHE_ENTRIES = 1 << 19
CACHE_LONGEST = 32


class Pieces:
    """Pieces with integer scores, the ids of the 256 bytes, and the bytes each id stands for."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        self.name = hashlib.sha1(model).hexdigest()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        scores = {p.piece: p.score for p in proto.pieces if p.type == kind.NORMAL}
        if proto.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE:
            ranks = {piece: n for n, piece in enumerate(sorted(scores, key=lambda piece: -scores[piece]), start=1)}
            whole = math.log(sum(1 / n for n in ranks.values()))
            scores = {piece: -math.log(n) - whole for piece, n in ranks.items()}
        best, worst = max(scores.values()), min(scores.values())
        self.scored: list[tuple[str, int, int]] = []
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i, p in enumerate(proto.pieces):
            out = b""
            if p.type == kind.BYTE:
                value = int(p.piece[3:-1], 16)
                self.byte_ids[value] = i
                out = bytes([value])
            elif p.type in (kind.NORMAL, kind.USER_DEFINED):
                # a user-defined piece counts as good as its length of best pieces
                score = scores[p.piece] if p.type == kind.NORMAL else len(p.piece) * best - 0.1
                self.scored.append((p.piece, round(score * SCALE), i))
                out = p.piece.replace(MARK, " ").encode()
            self.bytes_of.append(out)
        self.unknown = round((worst - UNKNOWN_PENALTY) * SCALE)
        if any(MARK in piece.lstrip(MARK) for piece, _, _ in self.scored):
            raise ValueError("a piece crosses the start of a word")


class Encoder:
    def __init__(self, pieces: Pieces):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score, i in pieces.scored:
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.matches = self.automaton.iter
        self.singles = {piece for piece, _, _ in pieces.scored if len(piece) == 1}
        # finds a character that has no piece of its own
        self.foreign = re.compile("[^" + re.escape("".join(sorted(self.singles))) + "]", re.DOTALL).search
        self.byte_ids, self.unknown = pieces.byte_ids, pieces.unknown
        self.lengths = [0] * len(pieces.bytes_of)
        for piece, _, i in pieces.scored:
            self.lengths[i] = len(piece)
        # tasks that follow one another in a Python worker share the words they know
        shared = vars(sys).setdefault("_tidelog_known_words", {})
        if pieces.name not in shared:
            shared.clear()
        self.cache: dict[str, array] = shared.setdefault(pieces.name, {})
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def _path(self, chunk: str) -> array:
        """Viterbi over one chunk."""
        size = len(chunk)
        low = (size + 1) * 2 * self.unknown
        # best[end] and piece[end] belong to the prefix that ends with character `end`;
        # index -1, the last cell, is the empty prefix
        best, piece = [low] * (size + 1), [-1] * size
        best[size] = 0
        if self.foreign(chunk) is None:
            for end, (length, score, i) in self.matches(chunk):
                total = best[end - length] + score
                if total > best[end]:
                    best[end] = total
                    piece[end] = i
        else:
            done = 0  # a character without a piece is relaxed after the matches of its end
            for end, (length, score, i) in self.matches(chunk):
                while done < end:
                    self._unknown(chunk, done, best, piece)
                    done += 1
                total = best[end - length] + score
                if total > best[end]:
                    best[end] = total
                    piece[end] = i
            while done < size:
                self._unknown(chunk, done, best, piece)
                done += 1
        ids, end, lengths = [], size - 1, self.lengths
        while end >= 0:
            i = piece[end]
            if i >= 0:
                ids.append(i)
                end -= lengths[i]
            else:
                ids.extend([self.byte_ids[b] for b in reversed(chunk[end].encode("utf-8", "surrogatepass"))])
                end -= 1
        ids.reverse()
        return array("i", ids)

    def _unknown(self, chunk: str, at: int, best: list[int], piece: list[int]) -> None:
        if chunk[at] not in self.singles and best[at - 1] + self.unknown > best[at]:
            best[at], piece[at] = best[at - 1] + self.unknown, -1

    def _word(self, word: str) -> array:
        """A word with its mark; short ones are kept while there is room, the frequent ones come first."""
        ids = self._path(word)
        if len(word) <= CACHE_LONGEST and len(self.cache) < CACHE_ENTRIES:
            self.cache[word[1:]] = ids
        return ids

    def _plain(self, text: str, out: array) -> None:
        """A text without U+2581."""
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            for chunk in self.words.findall(MARK + text.replace(" ", MARK)):
                out.extend(self._path(chunk))
            return
        known = self.cache.get
        for word in text.split(" "):
            ids = known(word)
            out.extend(self._word(MARK + word) if ids is None else ids)

    def encode(self, text: str, out: array) -> None:
        """Append the ids of one text."""
        if not text:
            return
        if MARK not in text:
            self._plain(text, out)
            return
        # marks of the text itself become bytes; what stands between them is encoded in place
        mark = [self.byte_ids[b] for b in MARK.encode()]
        for n, part in enumerate(text.split(MARK)):
            if n:
                out.extend(mark)
            for chunk in self.words.findall((MARK if n == 0 else "") + part.replace(" ", MARK)):
                out.extend(self._path(chunk))


def _replaced(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Add ARRAY<INT> ``ids``. The vocabulary file (about 0.5 MB) is read once and sent to the tasks."""
    with open(vocabulary, "rb") as file:
        pieces = Pieces(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces)
        for batch in batches:
            flat, ends, known = array("i"), [0], []
            for value in batch.column(text).to_pylist():
                known.append(value is not None)
                if value:
                    encoder.encode(value, flat)
                ends.append(len(flat))
            column = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()),
                mask=pa.array([not k for k in known], pa.bool_()),
            )
            kept = [n for n in batch.schema.names if n != ids]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], column], names=[*kept, ids])

    return df.mapInArrow(run, _replaced(df.schema, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """Add STRING ``text`` from ids. Ids outside the vocabulary and control ids give nothing."""
    with open(vocabulary, "rb") as file:
        table = Pieces(file.read()).bytes_of
    nothing = len(table)
    table = [*table, b""]

    def one(values: list[int]) -> str:
        out = b"".join(map(table.__getitem__, values))
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(ids)
            values = column.values
            lowest, highest = pc.min_max(values).as_py().values()
            if values.null_count or lowest is not None and (lowest < 0 or highest >= nothing):
                flat = [i if i is not None and 0 <= i < nothing else nothing for i in values.to_pylist()]
            else:
                flat = values.to_numpy().tolist()
            ends = column.offsets.to_pylist()
            known = column.is_valid().to_pylist()
            texts = [one(flat[a:b]) if k else None for a, b, k in zip(ends, ends[1:], known, strict=False)]
            kept = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(texts, pa.string())], names=[*kept, text])

    return df.mapInArrow(run, _replaced(df.schema, text, T.StringType()))
