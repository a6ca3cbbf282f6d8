"""SentencePiece BPE, encoded through a table of last tokens and decoded again.

For every prefix of a segment exactly one token ends the prefix's encoding. A token that matches at the prefix's end is
that token if, and only if, the encoding of the text before it ends in a token that is *compatible* with it: encoding the two
side by side gives the two back. An automaton over the vocabulary finds the matches, so the table is filled from left
to right in time linear in the segment, and the ids are read from it backwards. No merge loop runs over the text.

Segments: no piece of such a vocabulary holds a space mark after another character, so encodings never cross the start of a
run of space marks; nor do they cross two neighbours that no chain of pieces connects, such as a letter and a full stop. A
worker keeps the ids of the segments it has seen in a bounded cache.

Defined results: a null text is the empty text, whose ids are the end id alone and which decodes to the empty text. Rows are
handled one by one: repeated rows give repeated results, null identifiers pass through, other columns of the input
are not looked at, and an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import text_slices

MARK = "▁"
#: What a worker remembers, in bytes of Python objects as estimated below; beyond that it starts anew. Segments of some words' length
#: recur, longer ones hardly do.
CACHE_BYTES, SEGMENT_BYTES, ENTRY_BYTES = 64 << 20, 64, 200
PAIRS = 600_000


def read_vocabulary(model_path: str) -> dict:
    """Pieces, scores and kinds of a BPE model file, as plain lists that tasks can carry (some hundred KB)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(model.vocab_size())
    kind = ["byte" if model.is_byte(i) else "control" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "piece" for i in ids]
    pieces = [model.id_to_piece(i) for i in ids]
    if model.normalize("ﬁ 　x") != f"{MARK}ﬁ{MARK}　x" or any(MARK in p.lstrip(MARK) for p, k in zip(pieces, kind, strict=True) if k == "piece"):
        raise ValueError("the model normalises text or has pieces that cross words")
    read = {"pieces": pieces, "scores": [model.get_score(i) for i in ids], "kind": kind, "end": model.eos_id()}
    codec = PrefixTableCodec(read)
    digest = hashlib.sha256(repr(list(read.items())).encode()).hexdigest()
    return read | {"digest": digest, "standing": codec.standing, "pattern": codec.pattern}  # worked out once, here


def utf8(run: bytes) -> str:
    """Bytes as text; each byte that is no part of a character becomes a replacement character."""
    return run.decode("utf-8", "each-byte")


codecs.register_error("each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class PrefixTableCodec:
    """Encodes and decodes with one vocabulary. A token is a piece's text, or a character that has only bytes."""

    def __init__(self, vocabulary: dict):
        kind, pieces = vocabulary["kind"], vocabulary["pieces"]
        self.end = vocabulary["end"]
        self.id = {p: i for i, (p, k) in enumerate(zip(pieces, kind, strict=True)) if k == "piece"}
        self.score = {p: vocabulary["scores"][i] for p, i in self.id.items()}
        byte_ids = [i for i, k in enumerate(kind) if k == "byte"]
        self.byte_id = {int(pieces[i][3:-1], 16): i for i in byte_ids}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.high_bytes = np.array(sorted(i for b, i in self.byte_id.items() if b > 127), dtype=np.int32)
        self.text = ["" if k == "control" else chr(self.byte_of[i]) if k == "byte" else p.replace(MARK, " ") for i, (p, k) in enumerate(zip(pieces, kind, strict=True))]
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.cached = 0
        self.alphabet = frozenset(p for p in self.id if len(p) == 1)
        self.names = dict(enumerate(pieces))
        standing = vocabulary.get("standing") or [i for p, i in self.id.items() if self.merged(p) == [p]]  # other pieces never come out of an encoding
        self.standing = standing
        self.automaton = ahocorasick.Automaton()
        for i in standing:
            self.automaton.add_word(pieces[i], (i, len(pieces[i])))
        self.automaton.make_automaton()
        self.pattern = vocabulary.get("pattern") or self.segmenter([pieces[i] for i in standing])
        self.segments = re.compile(self.pattern).findall

    @staticmethod
    def segmenter(pieces: list[str]) -> str:
        """Cuts a text where no encoding crosses: before space marks, and between characters that no chain of pieces connects."""
        group: dict[str, set[str]] = {}
        for piece in pieces:
            for a, b in itertools.pairwise(piece.lstrip(MARK)):
                both = group.get(a, {a}) | group.get(b, {b})
                group.update(dict.fromkeys(both, both))
        classes = {id(x): "[" + "".join(map(re.escape, sorted(x))) + "]+" for x in group.values()}
        return f"{MARK}*(?:{'|'.join([*sorted(classes.values(), key=len, reverse=True), f'[^{MARK}]'])})|{MARK}+"

    def merged(self, text: str) -> list[str]:
        """The merges themselves, highest score and then leftmost first; only for two tokens at a time."""
        parts = list(text)
        while True:
            found = [(-self.score[both], k) for k in range(len(parts) - 1) if (both := parts[k] + parts[k + 1]) in self.score]
            if not found:
                return parts
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def compatible(self, left: int, right: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        names = [self.names[left], self.names[right]]
        known = self.pairs[left << 20 | right] = self.merged("".join(names)) == names
        return known

    def forget(self) -> None:
        """Lets go of what has been remembered of texts: a worker lives on after its task, and other stages need the memory."""
        self.cache.clear()
        self.pairs.clear()
        self.cached = 0

    def known_ids(self, run: str) -> list[int]:
        """The ids of a run of characters that are all pieces. last[e] is the token that ends the encoding of run[:e]."""
        last, pairs = [-1] * (len(run) + 1), self.pairs
        for at, (token, size) in self.automaton.iter(run):
            if last[at + 1] < 0:
                if start := at + 1 - size:
                    if (left := last[start]) < 0:
                        continue
                    fits = pairs.get(left << 20 | token)
                    if not (self.compatible(left, token) if fits is None else fits):
                        continue
                last[at + 1] = token
        out, end = [], len(run)
        while end:
            if last[end] < 0:
                raise ValueError(f"no token ends at {end} of {run[:80]!r}")
            out.append(last[end])
            end -= len(self.names[last[end]])
        return out[::-1]

    def ids(self, segment: str) -> list[int]:
        if self.alphabet.issuperset(segment):
            return self.known_ids(segment)
        out: list[int] = []
        for known, run in itertools.groupby(segment, self.alphabet.__contains__):  # a character without a piece joins with nothing
            out += self.known_ids("".join(run)) if known else [self.byte_id[b] for b in "".join(run).encode()]
        return out

    def segment_ids(self, segment: str) -> bytes:
        out = array("i", self.ids(segment)).tobytes()
        if len(segment) <= SEGMENT_BYTES:
            if self.cached >= CACHE_BYTES:
                self.cache.clear()
                self.cached = 0
            self.cache[segment] = out
            self.cached += ENTRY_BYTES + 4 * len(segment) + len(out)
        return out

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text, the end id last."""
        parts = []
        if text:
            cache = self.cache
            for segment in self.segments(MARK + text.replace(" ", MARK)):
                parts.append(cache.get(segment) or self.segment_ids(segment))
        parts.append(np.int32(self.end).tobytes())
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of any list of ids; each byte that is no UTF-8 becomes a replacement character."""
        text = self.text
        if np.isin(ids, self.high_bytes).any():
            out, run = [], bytearray()
            for i in ids.tolist():
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                else:
                    if run:
                        out.append(utf8(run))
                        run.clear()
                    out.append(text[i])
            whole = "".join(out) + utf8(run)
        else:
            whole = "".join([text[i] for i in ids.tolist()])
        return whole[1:] if len(ids) and self.names[int(ids[0])].startswith(MARK) else whole  # the mark that encoding put in front


_codecs: dict[str, PrefixTableCodec] = {}


def _codec(vocabulary: dict) -> PrefixTableCodec:
    """This worker's codec of the vocabulary; it keeps one, since a job uses one."""
    if vocabulary["digest"] not in _codecs:
        _codecs.clear()
        _codecs[vocabulary["digest"]] = PrefixTableCodec(vocabulary)
    return _codecs[vocabulary["digest"]]


def _encoded(codec: PrefixTableCodec, texts: list) -> tuple[list[np.ndarray], pa.ListArray]:
    ids = [codec.encode(x or "") for x in texts]
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int> and the text decoded from them, for each row."""
    vocabulary = read_vocabulary(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        try:
            for piece in text_slices(batches):
                ids, column = _encoded(codec, piece.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column(0), column, pa.array([codec.decode(x) for x in ids], pa.string())], ["id", "ids", "decoded"])
        finally:
            codec.forget()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids array<int> for each row."""
    return encode_decode(docs, model_path, id_col, text_col).drop("decoded")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and decoded string for each row; null ids count as none."""
    vocabulary = read_vocabulary(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], dtype=np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "decoded"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
