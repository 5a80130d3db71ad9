"""Byte-level BPE by a sentencepiece model written straight from a rank file.

Each token's bytes become a piece of printable characters, one per byte; its score is the negative rank,
so that the merge with the lowest rank is always the best.  Normalisation is the identity.  Texts are
first cut into pre-tokens by the pattern, each is encoded alone, and ids decode through the inverse of
the byte mapping.

Cases: null or empty text - no tokens; very long texts - whole, piece by piece; repeated rows - encoded
alike; empty table - empty result; other columns of the input - passed on by both operators unless they
are named ``ids`` or ``decoded``, which the operators' own columns replace.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pageloom.llm.common import free_name, slices, text_bytes

# pieces of text that a task remembers with their ids
REMEMBERED = 150_000
# characters from which a part is not remembered, and of texts whose new parts are encoded in one call
LONG = 64
STEP_CHARS = 500_000
# what parts pre-tokens that are merged in one text, and how many are
BREAK, TOGETHER = "\ud800", 32
# rows that are turned into Python values at a time
SLICE = 256
_MADE: dict = {}


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is one, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in order of rank; ranks must run from 0 without a gap."""
    found = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                found[int(rank)] = base64.b64decode(token)
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must run from 0 without a gap")
    return [found[i] for i in range(len(found))]


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece model: an unknown piece, then one piece per rank."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    letters = byte_letters()
    model = pb.ModelProto()
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(tokens) + 1
    model.trainer_spec.unk_id, model.trainer_spec.bos_id = 0, -1
    model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    norm = model.normalizer_spec
    norm.name, norm.precompiled_charsmap = "identity", b""
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for rank, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token)
        model.pieces.add(piece=piece, score=float(-rank), type=pb.ModelProto.SentencePiece.NORMAL)
    return model.SerializeToString()


def whole_words(tokens: list[bytes]) -> dict[str, int]:
    """Ranks of the tokens that are texts: no other token can be a whole pre-token."""
    found = {}
    for i, token in enumerate(tokens):
        try:
            found[token.decode()] = i
        except UnicodeDecodeError:
            pass
    return found


class Codec:
    """Texts to packed ids (little-endian unsigned 32 bits) and back, in one task."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str) -> None:
        import regex
        from sentencepiece import SentencePieceProcessor

        self.pieces = SentencePieceProcessor(model_proto=model)
        self.whole = whole_words(tokens)
        self.find = regex.compile(pattern).findall
        self.points = np.array([ord(c) for c in byte_letters()], "<u4")
        # a space before a non-space always begins a pre-token
        self.cut = regex.compile(r" (?=\S)").split
        self.loose = regex.compile(r" (?:\s|$)").search
        self.bare, self.spaced = _Remembered(self, ""), _Remembered(self, " ")

    def ids_of(self, text: str) -> bytes:
        return self._ids(self.find(text))[0].tobytes()

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of pre-tokens, and the end of each; those that are no tokens are encoded together."""
        kinds, whole = set(pieces), self.whole
        own, rest = [p for p in kinds if p in whole], [p for p in kinds if p not in whole]
        ids, sizes = self._merged(rest)
        ids = np.concatenate([np.fromiter(map(whole.__getitem__, own), "<u4", len(own)), ids])
        sizes = np.concatenate([np.ones(len(own), np.int64), sizes])
        number = dict(zip(chain(own, rest), range(len(kinds))))
        at = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        starts, sizes = (np.cumsum(sizes) - sizes)[at], sizes[at]
        ends = np.cumsum(sizes)
        return ids[np.repeat(starts - ends + sizes, sizes) + np.arange(sizes.sum())], ends

    def _merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens by merging, and how many each has.

        Between two of them stands a character without a piece, which no merge crosses and whose id is 0.
        """
        if not pieces:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        # a lone surrogate is in no text, its first two bytes in no other character
        data = np.frombuffer(BREAK.join([*pieces, ""]).encode("utf-8", "surrogatepass"), np.uint8)
        breaks = np.flatnonzero((data[:-1] == 0xED) & (data[1:] == 0xA0))
        letters, inside = self.points[data], np.ones(len(data), bool)
        letters[breaks] = ord(" ")
        inside[breaks + 1] = inside[breaks + 2] = False
        text = letters[inside].tobytes().decode("utf-32-le")
        ends = breaks - 2 * np.arange(len(breaks)) + 1
        cuts = [0, *ends[TOGETHER - 1 : -1 : TOGETHER].tolist(), len(text)]
        ids = list(chain.from_iterable(self.pieces.encode([text[a:b] for a, b in zip(cuts, cuts[1:])], num_threads=1)))
        ids = np.array(ids, "<u4")
        ends = np.flatnonzero(ids == 0)
        if len(ends) != len(pieces):
            raise ValueError("a byte has no token")
        return ids[ids != 0] - np.uint32(1), np.diff(ends, prepend=-1) - 1

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        out, at = [], 0
        while at < len(texts):
            cut, chars = [], 0
            while at < len(texts) and (not cut or chars < STEP_CHARS):
                cut.append(self._parts(texts[at]))
                chars, at = chars + len(texts[at]), at + 1
            self._learn(cut)
            for parts in cut:
                head = self.bare[parts[0]] if parts[0] else b""
                out.append(head + b"".join(map(self.spaced.__getitem__, parts[1:])))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def _parts(self, text: str) -> list[str]:
        return text.split(" ") if self.loose(text) is None else self.cut(text)

    def _learn(self, cut: list[list[str]]) -> None:
        """Remember the ids of the parts behind a space that are new."""
        if len(self.spaced) > REMEMBERED:
            self.spaced.clear()
            self.bare.clear()
        new = set().union(*(parts[1:] for parts in cut)) - self.spaced.keys()
        new = [part for part in new if len(part) < LONG]
        if not new:
            return
        # cut before spaces, as the texts are, they are one text for the pattern
        pieces = self.find(" " + " ".join(new))
        ends, bounds = np.cumsum([*map(len, pieces)]), np.cumsum([*map(len, new)]) + np.arange(1, len(new) + 1)
        last = np.minimum(np.searchsorted(ends, bounds), len(ends) - 1)
        if (ends[last] != bounds).any():
            return  # a pattern that leaves characters out: each part alone
        ids, to = self._ids(pieces)
        to, packed = (4 * to[last]).tolist(), ids.tobytes()
        self.spaced.update(zip(new, [packed[a:b] for a, b in zip([0, *to], to)]))


class _Remembered(dict):
    """Ids of a part of text behind a fixed prefix; long parts are not kept."""

    def __init__(self, codec: Codec, prefix: str) -> None:
        self.codec, self.prefix = codec, prefix

    def __missing__(self, part: str) -> bytes:
        found = self.codec.ids_of(self.prefix + part)
        if len(part) < LONG:
            self[part] = found
        return found


def _codec(shared) -> Codec:
    """One codec per Python worker and model."""
    name, model, tokens, pattern = shared.value
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = Codec(model, tokens, pattern)
    return _MADE[name]


class ByteBPE:
    """The two operators over one vocabulary, whose size bounds what is sent to the executors."""

    def __init__(self, spark, path: str, pattern: str) -> None:
        tokens = read_ranks(path)
        model = serialise(tokens)
        name = hashlib.sha256(model + pattern.encode()).hexdigest()
        self.shared = spark.sparkContext.broadcast((name, model, tokens, pattern))

    def encode(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``ids`` (array of int) in place of its text."""
        shared = self.shared
        keep = [c for c in docs.columns if c not in (text, "ids")]
        body = free_name(keep, "_text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(shared)
            for batch in slices(batches, SLICE):
                packed = codec.encode_all([x.decode() for x in batch.column(body).to_pylist()])
                ends = np.cumsum([0, *map(len, packed)]) // 4
                ids = pa.ListArray.from_arrays(
                    pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), np.int32))
                )
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [ids], names=[*keep, "ids"])

        schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])
        return docs.select(*keep, text_bytes(text).alias(body)).mapInArrow(run, schema)

    def decode(self, encoded: DataFrame) -> DataFrame:
        """``encoded`` with ``decoded``, the bytes its ids stand for."""
        shared = self.shared
        keep = [c for c in encoded.columns if c != "decoded"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens = shared.value[2]
            for batch in slices(batches, SLICE):
                decoded = [joined(tokens, own) for own in id_arrays(batch.column("ids"))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in keep] + [pa.array(decoded, pa.binary())], names=[*keep, "decoded"]
                )

        schema = T.StructType([encoded.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType())])
        return encoded.select(*keep).mapInArrow(run, schema)

    def digests(self, encoded: DataFrame, keep_ids: bool = False) -> DataFrame:
        """``encoded`` with n_tokens and the SHA-256 of its packed ids and of what they decode to.

        The ids themselves stay only with ``keep_ids``.
        """
        shared = self.shared
        names = ["n_tokens", "ids_sha256", "decoded_sha256"]
        keep = [c for c in encoded.columns if c not in ("ids", *names)] + ["ids"] * keep_ids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens = shared.value[2]
            for batch in slices(batches, SLICE):
                own = id_arrays(batch.column("ids"))
                packed = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own]
                plain = [hashlib.sha256(joined(tokens, x)).hexdigest() for x in own]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in keep] + [pa.array([len(x) for x in own], pa.int64()), pa.array(packed), pa.array(plain)],
                    names=[*keep, *names],
                )

        kinds = (T.LongType(), T.StringType(), T.StringType())
        schema = T.StructType([encoded.schema[c] for c in keep] + [T.StructField(n, k) for n, k in zip(names, kinds)])
        return encoded.select(*keep, *[] if keep_ids else ["ids"]).mapInArrow(run, schema)


def id_arrays(ids: pa.ListArray) -> list[np.ndarray]:
    flat, ends = np.asarray(ids.flatten()), np.asarray(ids.offsets) - ids.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def joined(tokens: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist()))
