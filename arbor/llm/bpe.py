"""Byte-level BPE through a sentencepiece model made from the rank file.

The rank file's tokens, written with the usual printable character for each byte,
become the pieces of a sentencepiece BPE model; a piece's score is its negative rank,
and normalisation is the identity.  The protobuf is serialised here field by field.  A
text is cut by the pre-token pattern, each pre-token is encoded by sentencepiece, and
ids are decoded by the inverse mapping of pieces to bytes.

Null and empty texts have no ids.  Long texts are handled whole.  Every input row gives
one output row; extra columns of the input are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from itertools import chain

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pieces, schema_with, text_of

#: Pre-tokens kept in a worker's memo before it is emptied.
MEMO = 300_000
#: Texts of code points below this are cut by the narrower form of the pattern.
NARROW = 0x250
#: Characters encoded together.
BATCH = 1 << 18


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


def read_ranks(data: bytes) -> list[bytes]:
    """Tokens in the order of their ranks, which must be 0, 1, 2, ..."""
    rows = [line.split() for line in data.splitlines() if line]
    ranks = {int(r): base64.b64decode(t) for t, r in rows}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not dense")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, kind: int, value: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(value)) if kind == 2 else b"") + value


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: id i is tokens[i]; one unknown piece follows them."""
    chars = byte_chars()
    model = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        model += _field(1, 2, _field(1, 2, piece) + _field(2, 5, struct.pack("<f", -float(rank))))
    # ModelProto.pieces.type 2: unknown
    model += _field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2)))
    minus_one = _varint((1 << 64) - 1)
    trainer = (_field(3, 0, _varint(2))  # model_type BPE
               + _field(4, 0, _varint(len(tokens) + 1))  # vocab_size
               + _field(40, 0, _varint(len(tokens)))  # unk_id
               + _field(41, 0, minus_one) + _field(42, 0, minus_one) + _field(43, 0, minus_one))
    identity = (_field(1, 2, b"identity") + _field(3, 0, _varint(0))  # add_dummy_prefix
                + _field(4, 0, _varint(0)) + _field(5, 0, _varint(0)))  # extra and escaped white space
    return bytes(model + _field(2, 2, trainer) + _field(3, 2, identity))


def _ranges(chars: list[str]) -> str:
    out, i = [], 0
    while i < len(chars):
        j = i
        while j + 1 < len(chars) and ord(chars[j + 1]) == ord(chars[j]) + 1:
            j += 1
        out.append(f"\\u{ord(chars[i]):04x}-\\u{ord(chars[j]):04x}")
        i = j + 1
    return "".join(out)


def narrow_pattern(pattern: str, below: int = NARROW) -> re.Pattern | None:
    """The same pattern for texts whose code points all lie below the bound: classes
    written out, which the standard module matches several times faster.  None if the
    pattern uses classes other than \\p{L}, \\p{N}, \\s and \\S."""
    classes = {k: _ranges([c for c in map(chr, range(below)) if regex.match(k, c)]) for k in (r"\p{L}", r"\p{N}", r"\s")}
    classes[r"\S"] = _ranges([c for c in map(chr, range(below)) if not regex.match(r"\s", c)])
    out, inside, i = [], False, 0
    while i < len(pattern):
        name = next((k for k in classes if pattern.startswith(k, i)), None)
        if name:
            out.append(classes[name] if inside else f"[{classes[name]}]")
            i += len(name)
            continue
        if pattern[i] == "\\":
            return None
        inside = pattern[i] == "[" or inside and pattern[i] != "]"
        out.append(pattern[i])
        i += 1
    return re.compile("".join(out))


class Codec:
    """Encoder and decoder of one worker; pattern cuts texts into pre-tokens."""

    def __init__(self, model: bytes, pattern: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut_any = regex.compile(pattern).findall
        narrow = narrow_pattern(pattern)
        self.cut_narrow = narrow.findall if narrow else self.cut_any
        chars = byte_chars()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.table = dict(enumerate(chars))
        self.n = self.sp.get_piece_size() - 1
        self.bytes_of = [bytes(byte_of[c] for c in self.sp.id_to_piece(i)) for i in range(self.n)]
        self.whole = {t: i for i, t in enumerate(self.bytes_of)}
        self.memo: dict[str, list[int]] = {}

    def cut(self, text: str) -> list[str]:
        if text.isascii() or max(text) < chr(NARROW):
            return self.cut_narrow(text)
        return self.cut_any(text)

    def pieces(self, pre: list[str]) -> list[list[int]]:
        """Ids of pre-tokens; one that is itself a token stays whole."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pre]
        ids = self.sp.encode([r.decode("latin-1").translate(self.table) for r in raw], num_threads=1)
        return [x if len(x) == 1 or r not in self.whole else [self.whole[r]] for x, r in zip(ids, raw)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        cuts = [self.cut(t) for t in texts]
        new = [p for p in set(chain.from_iterable(cuts)) if p not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(set(chain.from_iterable(cuts)))
        self.memo.update(zip(new, self.pieces(new)))
        get = self.memo.__getitem__
        return [list(chain.from_iterable(map(get, c))) for c in cuts]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict = {}


def _codec(model, pattern: str) -> Codec:
    key = (zlib.crc32(model.value), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model.value, pattern)
    return _codecs[key]


def _model(docs: DataFrame, rank_file: str):
    """The serialised model as a broadcast; its size is that of the rank file."""
    with open(rank_file, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(serialise(read_ranks(f.read())))


def encode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>: the token ids of every text."""
    model = _model(docs, rank_file)

    def run(batches):
        codec = _codec(model, pattern)
        for b in batches:
            for at, texts in pieces(b, most_bytes=BATCH):
                ids = pa.array(codec.encode(texts), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema_with(docs, ["doc_id"], "ids array<int>"))


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, data binary: the bytes of every id list."""
    model = _model(encoded, rank_file)

    def run(batches):
        codec = _codec(model, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                data = [codec.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema_with(encoded, ["doc_id"], "data binary"))


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, so
    that no id list leaves its task."""
    model = _model(docs, rank_file)

    def run(batches):
        codec = _codec(model, pattern)
        names: list[str] = [str(i) for i in range(codec.n)]
        for b in batches:
            for at, texts in pieces(b, most_bytes=BATCH):
                ids = codec.encode(texts)
                first = [hashlib.sha256(" ".join(map(names.__getitem__, x)).encode()).hexdigest() for x in ids]
                second = [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), pa.array(map(len, ids), pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)
