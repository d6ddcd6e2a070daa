"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

Every byte is mapped to one printable character, so a token of the vocabulary is a piece of such characters. A piece's score is its
negative rank: sentencepiece merges the pair of the highest score first, which is the lowest rank, leftmost first. The
model has identity normalisation and no escapes. Pre-tokens are found with the tokenizer's pattern, encoded one by one,
and decoded by the inverse of the byte mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame

from quarry.llm.common import sliced

#: Pre-tokens kept with their ids in each Python worker; the cache is emptied when full.
CACHE = 200_000
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_chars() -> list[str]:
    """The character of each byte: itself if printable in Latin-1, else the next one from code point 256 on."""
    out, fresh = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(fresh))
            fresh += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; one unknown piece follows the last rank."""
    chars = byte_chars()
    by_rank = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    score = lambda s: b"\x15" + struct.pack("<f", s)  # noqa: E731  field 2, 32 bit
    out = bytearray()
    for rank, token in enumerate(by_rank):
        out += _field(1, _field(1, "".join(chars[b] for b in token).encode()) + score(-float(rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + score(0.0) + _field(3, 2))
    # trainer: BPE, size, id of the unknown piece, no begin, end and pad pieces
    out += _field(2, _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank)) + b"".join(_field(n, -1) for n in (41, 42, 43)))
    out += _field(3, _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5)))
    return bytes(out)


class Codec:
    """Encodes and decodes texts; the model is built once for each process and path."""

    _kept: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        chars = byte_chars()
        self.table = {b: c for b, c in enumerate(chars)}
        back = {c: b for b, c in enumerate(chars)}
        n = len(ranks)
        self.bytes_of = {str(i): bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(n)}
        self.whole = {t.decode(): str(r) for t, r in ranks.items() if _text(t)}
        self.cache: dict[str, str] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._kept:
            cls._kept[path, pattern] = cls(path, pattern)
        return cls._kept[path, pattern]

    def _fill(self, tokens: list[str]) -> None:
        """Give every token an entry; a full cache is emptied first."""
        fresh = {t for t in tokens if t not in self.cache}
        if len(self.cache) + len(fresh) > CACHE:
            self.cache.clear()
            fresh = set(tokens)
        rest = []
        for t in fresh:
            if (whole := self.whole.get(t)) is not None:  # a pre-token that is in the vocabulary is one token
                self.cache[t] = whole
            else:
                rest.append(t)
        if rest:
            mapped = [t.encode().decode("latin-1").translate(self.table) for t in rest]
            for t, ids in zip(rest, self.model.encode(mapped, num_threads=1), strict=True):
                self.cache[t] = " ".join(map(str, ids))

    def encode(self, text: str) -> str:
        """The decimal ids, joined by spaces."""
        tokens = self.pattern.findall(text)
        try:
            return " ".join([self.cache[t] for t in tokens])
        except KeyError:
            self._fill(tokens)
        return " ".join([self.cache[t] for t in tokens])

    def decode(self, ids: str) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids.split(" ")]) if ids else b""


def _text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = True) -> DataFrame:
    """Encode and decode every text.

    With ``digest``: doc_id, n_tokens, ids_sha256, decoded_sha256. Without: doc_id, ids array<int>, decoded binary.
    A null text is an empty one: no ids, no bytes. Every row gives one row, repeated rows too. ``path`` must be
    readable on every executor. Only the named columns are read, so other columns can have any names.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in sliced(batches):
            ids = [codec.encode(t) if t else "" for t in batch.column(1).to_pylist()]
            if digest:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([i.count(" ") + 1 if i else 0 for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(i.encode()).hexdigest() for i in ids], pa.string()),
                        pa.array([hashlib.sha256(codec.decode(i)).hexdigest() for i in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            else:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([[int(x) for x in i.split(" ")] if i else [] for i in ids], pa.list_(pa.int32())),
                        pa.array([codec.decode(i) for i in ids], pa.binary()),
                    ],
                    names=["doc_id", "ids", "decoded"],
                )

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"cast(`{text_col}` AS string) AS text")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, " + (RESULT if digest else "ids array<int>, decoded binary"))
