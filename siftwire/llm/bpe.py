"""Byte-level BPE encoding and decoding through a SentencePiece model serialised from a rank vocabulary.

The ``.tiktoken`` vocabulary (base64 token, rank) is turned straight into a SentencePiece BPE model: every
token becomes the text of its mapped bytes, its score is the negative rank, normalisation is the identity.
A text is split by the pre-token pattern and each pre-token is encoded by itself; a pre-token that is a
token as a whole keeps its own rank, as byte-level BPE libraries have it. Decoding maps ids back to bytes.

Defined results: a null text counts as empty, an empty text has no ids and decodes to empty bytes; a lone
surrogate is read as U+FFFD; texts are never cut. The vocabulary must hold all 256 single bytes. The
vocabulary is read once on the driver and travels with the task (its size is that of the file, some MB).

Memory: texts are taken about a MiB at a time and long ones in runs of words; what a task remembers of words
it has met is bounded in bytes. Encoding and decoding share one Python worker in ``round_trip``.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwire.llm.memory import portions, released

#: Bytes, about, of words and pre-tokens whose ids a task remembers, if not told otherwise; emptied when full, results don't depend on it.
REMEMBERED = 64 << 20
#: Words or ids that are looked up at once.
RUN = 1 << 15
#: A space that ends the text or that other white space follows.
_OPEN_SPACE = re.compile(r" (?:\s|$)")


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a ``.tiktoken`` file: token bytes to rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def byte_characters() -> str:
    """One printable character for each of the 256 bytes: its own where that is printable, else 256 and up."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return "".join(chr(b if b in own else next(spare)) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    """A protobuf field: length-delimited for bytes, a varint for integers."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised SentencePiece BPE model whose piece ids follow the ranks; an unknown piece comes last."""
    letters = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        text = token.decode("latin-1").translate(letters).encode()
        pieces.append(_field(1, _field(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _field(3, normal)))
    pieces.append(_field(1, _field(1, "⁇".encode()) + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, unknown)))
    none = (1 << 64) - 1  # -1 as a varint
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(pieces) - 1) + b"".join(_field(n, none) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Ids of whole texts; made once in each task.

    ``spaced`` says that no pre-token of the pattern reaches over the place before a single space that
    white space does not follow; such a text is taken word by word, which is much faster than to match the
    pattern along the whole text. Any other text, and any other pattern, is matched as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes, spaced: bool, remembered: int | None = None):
        import sentencepiece

        self.remembered = REMEMBERED if remembered is None else remembered

        self.ranks, self.split, self.letters, self.spaced = ranks, regex.compile(pattern), byte_characters(), spaced
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.order = sorted(ranks.values())
        self.same = self.order == list(range(len(self.order)))
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0

    def _pretokens(self, text: str) -> list[str]:
        return [m.group() for m in self.split.finditer(text)] if self.split.groups else self.split.findall(text)

    def _learn(self, new: set[str]) -> None:
        self.held += 250 * len(new) + 5 * sum(map(len, new))
        rest, mapped = [], []
        for piece in new:
            raw = piece.encode("utf-8", "replace")
            rank = self.ranks.get(raw)
            if rank is not None:
                self.pieces[piece] = struct.pack("<I", rank)
            else:
                rest.append(piece)
                mapped.append(raw.decode("latin-1").translate(self.letters))
        for piece, ids in zip(rest, self.processor.encode(mapped, num_threads=1) if mapped else [], strict=True):
            self.pieces[piece] = struct.pack(f"<{len(ids)}I", *(ids if self.same else map(self.order.__getitem__, ids)))

    def _make_room(self) -> None:
        if self.held > self.remembered:
            self.pieces.clear()
            self.words.clear()
            self.held = 0

    def _of_pieces(self, run: list[str]) -> bytes:
        self._make_room()
        self._learn(set(run).difference(self.pieces))
        return b"".join(map(self.pieces.__getitem__, run))

    def _of_words(self, run: list[str]) -> bytes:
        """Of words with a space before each."""
        self._make_room()
        new = set(run).difference(self.words)
        if new:
            self.held += 250 * len(new) + 5 * sum(map(len, new))
            cut = {word: self._pretokens(" " + word) for word in new}
            self._learn(set().union(*cut.values()).difference(self.pieces))
            piece = self.pieces.__getitem__
            for word, found in cut.items():
                self.words[word] = piece(found[0]) if len(found) == 1 else b"".join(map(piece, found))
        return b"".join(map(self.words.__getitem__, run))

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        words = [text] if not self.spaced or _OPEN_SPACE.search(text) else text.split(" ")
        first = self._pretokens(words[0])
        runs = [self._of_pieces(first[at : at + RUN]) for at in range(0, len(first), RUN)]
        return b"".join(runs + [self._of_words(words[at : at + RUN]) for at in range(1, len(words), RUN)])


class Decoder:
    """Bytes of ids, by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = {rank: token for token, rank in ranks.items()}

    def joined(self, ids: np.ndarray) -> bytes:
        token = self.token.__getitem__
        return b"".join(b"".join(map(token, ids[at : at + RUN].tolist())) for at in range(0, len(ids), RUN))


def _vocabulary(docs: DataFrame, ranks: dict[bytes, int], pattern: str, spaced: bool):
    return docs.sparkSession.sparkContext.broadcast((ranks, pattern, sentencepiece_model(ranks), spaced))


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", output: str = "ids", packed: bool = False, spaced: bool = True, remembered: int | None = None
) -> DataFrame:
    """Add ``output``: the ids of the whole text as array<int>, or packed as little-endian 32-bit integers.

    Give ``spaced=False`` with a pattern for which the word-by-word way of ``Encoder`` does not hold.
    """
    shared = _vocabulary(docs, ranks, pattern, spaced)

    @F.arrow_udf("binary" if packed else "array<int>")
    @released
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(*shared.value, remembered)
        for batch in batches:
            for part in portions(batch, batch):
                own = [encoder.packed(x) for x in part.to_pylist()]
                yield pa.array(own, pa.binary()) if packed else pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in own], pa.list_(pa.int32()))

    return docs.withColumn(output, ids(F.coalesce(F.col(text), F.lit(""))))


def decode(rows: DataFrame, ranks: dict[bytes, int], ids: str = "ids", output: str = "decoded", packed: bool = False) -> DataFrame:
    """Add ``output``: the bytes that the ids stand for. A null list decodes to empty bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("binary")
    @released
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for part in portions(batch, batch):
                own = (np.frombuffer(x, "<u4") for x in part.to_pylist()) if packed else (np.asarray(x, np.int64) for x in part.to_pylist())
                yield pa.array(map(decoder.joined, own), pa.binary())

    empty = F.lit(b"") if packed else F.array().cast("array<int>")
    return rows.withColumn(output, decoded(F.coalesce(F.col(ids), empty)))


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", spaced: bool = True) -> DataFrame:
    """Add ``ids``, packed, and ``decoded``, their bytes: ``encode``, then ``decode``, in one pass and one Python worker."""
    shared = _vocabulary(docs, ranks, pattern, spaced)

    @F.arrow_udf("struct<ids:binary,decoded:binary>")
    @released
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = Encoder(*shared.value), Decoder(shared.value[0])
        for batch in batches:
            for part in portions(batch, batch):
                ids = [encoder.packed(x) for x in part.to_pylist()]
                back = [decoder.joined(np.frombuffer(x, "<u4")) for x in ids]
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["ids", "decoded"])

    coded = docs.withColumn("__both", both(F.coalesce(F.col(text), F.lit(""))))
    return coded.withColumns({"ids": F.col("__both.ids"), "decoded": F.col("__both.decoded")}).drop("__both")
