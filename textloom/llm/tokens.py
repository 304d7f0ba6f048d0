"""Token counts of whole texts, huge documents by overlap resynchronisation.

Short texts are encoded whole. A longer one is cut into overlapping chunks; each is encoded with
offsets, and neighbours are spliced at a token boundary that both encodings have and that is
proven stable. If an overlap holds no such boundary it is widened, in the end to the whole rest
of the text, so the count is always that of the library on the whole text.

Proof of stability: if no piece of the vocabulary has a space marker after another character, no
merge can join the character before a space to that space. Merges on the two sides never meet,
so the boundary is in the encoding of the whole text and the tokens on either side do not depend
on the other side. The model's normalizer, read from the model itself, must map no characters and
remove no spaces, and a space must be escaped. A model that lacks any of this is never cut.

Defined results: null text counts as empty (0 bytes, 0 tokens); rows keep their ids, repeated or
null; an empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 32_768
OVERLAP_BYTES = 256
TOKEN_LIMIT = 4096
MAX_MODEL_BYTES = 64 << 20
MARKER = "▁"
SPACES = (b" ", MARKER.encode())
BATCH_CHARS = 1 << 20


#: Fixed values of the model's format: field numbers of the model and of its normalizer, wire types.
NORMALIZER, CHARSMAP, REMOVE_SPACES, ESCAPE_SPACES = 3, 2, 4, 5
VARINT, BYTES, SKIPPED = 0, 2, {1: 8, 5: 4}


def _fields(data: bytes) -> dict[int, int | bytes]:
    """The last value of each field of a message in the wire format."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    found: dict[int, int | bytes] = {}
    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == VARINT:
            found[tag >> 3], at = varint(at)
        elif kind == BYTES:
            n, at = varint(at)
            found[tag >> 3], at = data[at : at + n], at + n
        elif kind in SKIPPED:
            at += SKIPPED[kind]
        else:
            raise ValueError(f"wire type {kind}")
    return found


def plain_normalizer(model: bytes) -> bool:
    """Whether the model's normalizer changes no characters and drops no spaces. Its flags default to true."""
    spec = _fields(_fields(model).get(NORMALIZER, b""))
    return not spec.get(CHARSMAP, b"") and not spec.get(REMOVE_SPACES, 1) and bool(spec.get(ESCAPE_SPACES, 1))


@lru_cache(maxsize=4)
def _processor(model: bytes):
    """The processor, and whether texts may be cut: no crossing piece, and a normalizer that changes nothing."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    crossing = any(re.search(f"[^{MARKER}]{MARKER}", sp.id_to_piece(i)) for i in range(sp.get_piece_size()))
    return sp, not crossing and plain_normalizer(model)


class _Chunk:
    """The encoding of data[start:end]; boundaries are byte offsets in the whole text."""

    def __init__(self, sp, data: bytes, start: int, end: int):
        self.start, self.end = start, end
        self.pieces = sp.encode(data[start:end].decode(), return_type="proto").pieces
        self.n = len(self.pieces)

    def begin(self, i: int) -> int:
        return self.start + self.pieces[i].begin

    def boundaries(self, low: int, high: int) -> dict[int, int]:
        """Offset -> number of tokens before it, for token starts in [low, high)."""
        a, b = 0, self.n
        while a < b:  # token starts ascend
            mid = (a + b) // 2
            a, b = (mid + 1, b) if self.begin(mid) < low else (a, mid)
        found = {}
        while a < self.n and (at := self.begin(a)) < high:
            found.setdefault(at, a)
            a += 1
        return found


def proven(data: bytes, at: int) -> bool:
    """Whether no piece can cross the place before byte `at`: a space marker follows another character."""
    return 0 < at < len(data) and data.startswith(SPACES, at) and not data.endswith(SPACES, 0, at)


def _char_start(data: bytes, at: int) -> int:
    """The start of the character that holds byte `at`."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return min(at, len(data))


def count_tokens(sp, text: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> int:
    """Tokens of text, encoded in overlapping chunks."""
    data = text.encode()
    n = len(data)
    left = _Chunk(sp, data, 0, _char_start(data, chunk))
    done, skip, splice = 0, 0, 0  # tokens before the chunk's own; of the chunk before its splice; where that is
    while left.end < n:
        width, joined = overlap, None
        while joined is None:
            start = _char_start(data, left.end - width)
            if start <= splice:  # the whole chunk holds no common boundary: take a longer one
                left = _Chunk(sp, data, left.start, _char_start(data, left.end + (left.end - left.start) + 4))
                skip = left.boundaries(splice, splice + 1)[splice] if splice else 0
                if left.end == n:
                    break
                width = overlap
                continue
            right = _Chunk(sp, data, start, _char_start(data, start + chunk + width))
            ours, theirs = left.boundaries(start + 1, left.end), right.boundaries(start + 1, left.end)
            joined = next((at for at in sorted(ours.keys() & theirs.keys()) if proven(data, at)), None)
            width *= 2
        if joined is None:
            break
        done += ours[joined] - skip
        left, skip, splice = right, theirs[joined], joined
    return done + left.n - skip


def _counter(model, chunk: int, overlap: int, limit: int):
    def run(batches):
        sp, splits = _processor(model.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            counts = [0] * len(texts)
            small, chars = [], 0

            def flush():
                for i, ids in zip(small, sp.encode([texts[i] for i in small], num_threads=1), strict=True):
                    counts[i] = len(ids)
                small.clear()

            for i, t in enumerate(texts):
                if splits and len(t) > chunk:
                    counts[i] = count_tokens(sp, t, chunk, overlap)
                else:
                    small.append(i)
                    chars += len(t)
                    if chars > BATCH_CHARS:
                        flush()
                        chars = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. model_path: a sentencepiece model on the driver."""
    with open(model_path, "rb") as f:
        model = f.read(MAX_MODEL_BYTES + 1)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"{model_path} has more than {MAX_MODEL_BYTES} bytes")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_counter(shared, chunk, overlap, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
