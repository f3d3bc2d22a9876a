"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Encoding. Whether the encoding of a text may have token b right after token a
depends on these two alone: the pair must encode to itself. So of the tokens that
end at a byte, exactly one continues the encoding of the bytes before it, and the
encoding can be read byte by byte, remembering the last token of each prefix. A
state of the transducer is that memory, cut to the length of the longest token;
its transitions are computed from the vocabulary when a byte is first met in it
and kept after that. Every piece, however long, is read so. A token is emitted when
every prefix that a later token may still start from runs through it, which is
after a bounded lookahead; the end of a piece emits the rest. What the transducer
gave for a piece is kept, so equal pieces are read once. Both memories are dropped
and begun again at a fixed size.

Rank semantics are those of ``tiktoken``: a piece that is a token is that token
(what a state emits at the end, while it holds the whole piece); otherwise the
adjacent pair whose bytes have the lowest rank merges first. A pair of tokens is
compared with that rule once and kept.

Decoding. Ids become bytes as they come, and an incremental UTF-8 machine gives
out characters as soon as they are complete; what can be no character becomes
U+FFFD, a maximal ill-formed part at a time.

Defined cases: a null text counts as empty and has no ids; rows that repeat stay;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import blocks, id_text

#: States and pieces that a worker remembers at most, of about 450 and 250 bytes each.
MOST_STATES = 250_000
MOST_PIECES = 800_000
#: Pieces longer than this are read but not remembered.
LONGEST_KEPT = 64
#: Ids of a document that are decoded at once.
AT_ONCE = 1024


_BYTES = [bytes((b,)) for b in range(256)]


class _Transitions(dict):
    """state * 256 + byte -> state, computed when first asked for."""

    def __init__(self, machine: Transducer):
        self.machine = machine

    def __missing__(self, key: int) -> int:
        to = self[key] = self.machine._step(key >> 8, key & 255)
        return to


class Transducer:
    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        if any(bytes((b,)) not in ranks for b in range(256)):
            raise ValueError("a byte has no token")
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._starts = {t[:k] for t in ranks for k in range(1, len(t))}
        self.most_states = most_states
        self._pairs: dict[tuple[int, int], bool] = {}
        self._alone: dict[int, bool] = {}  # whether a token's bytes, alone, become it
        self._reset()

    def _reset(self) -> None:
        # a state: the last tokens of the latest prefixes, newest last, and the latest bytes that a
        # longer token may start with; one token more than bytes unless that is the whole piece
        self._ids: dict[tuple, int] = {}
        self._states: list[tuple[tuple[int, ...], bytes, int]] = []
        self._next = _Transitions(self)
        self._last: list[int] = []
        self._final: list[int] = []  # what the end emits if the whole piece is a token that merges do not reach, else -1
        self._intern((), b"", -1)

    def _intern(self, lasts: tuple[int, ...], tail: bytes, final: int) -> int:
        key = (lasts, tail, final)
        found = self._ids.get(key)
        if found is None:
            found = self._ids[key] = len(self._states)
            self._states.append(key)
            self._last.append(lasts[-1] if lasts else -1)
            self._final.append(final)
        return found

    def merge(self, piece: bytes) -> list[int]:
        """The rank rule itself, for short strings."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = ranks.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _follows(self, a: int, b: int) -> bool:
        found = self._pairs.get((a, b))
        if found is None:
            if len(self._pairs) > 400_000:
                self._pairs.clear()
            found = self._pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def _begins(self, token: int) -> bool:
        found = self._alone.get(token)
        if found is None:
            found = self._alone[token] = self.merge(self.bytes_of[token]) == [token]
        return found

    def _step(self, state: int, byte: int) -> int:
        lasts, tail, _ = self._states[state]
        whole = len(lasts) == len(tail)  # nothing of the piece has left the window
        tail += _BYTES[byte]
        rank, pairs, n = self.ranks.get, self._pairs, len(tail)
        for at in range(n):
            token = rank(tail[at:])
            if token is None:
                continue
            if n - at > len(lasts):
                if self._begins(token):
                    break
            else:
                before = lasts[at - n]
                follows = pairs.get((before, token))
                if follows if follows is not None else self._follows(before, token):
                    break
        lasts += (token,)
        final = rank(tail, -1) if whole else -1
        starts, cut = self._starts, 0
        while cut < n and tail[cut:] not in starts:
            cut += 1
        if cut or not whole:
            tail = tail[cut:]
            lasts = lasts[cut - n - 1 :]
        return self._intern(lasts, tail, -1 if final == token else final)

    def read(self, piece: bytes, emit: Callable[[list[int]], None]) -> None:
        """Emits the tokens of one piece, each as soon as no later byte can change it."""
        if len(self._states) > self.most_states:
            self._reset()
        state, lasts, sure = 0, [], 0
        length, last, following, sizes = self.longest, self._last, self._next, self.bytes_of
        for start in range(0, len(piece), length):
            if start:
                # what all prefixes that a later token may follow have in common
                cuts = [self._cuts(lasts, end, sure, sizes) for end in range(start - length + 1, start + 1)]
                common = set(cuts[0]).intersection(*cuts[1:])
                if common and (stop := max(common)) > sure:
                    emit(self._tokens(lasts, stop, sure, sizes))
                    sure = stop
            for byte in piece[start : start + length]:
                state = following[state << 8 | byte]
                lasts.append(last[state])
        if self._final[state] >= 0:
            emit([self._final[state]])
        else:
            emit(self._tokens(lasts, len(lasts), sure, sizes))

    @staticmethod
    def _cuts(lasts: list[int], end: int, since: int, sizes: dict) -> list[int]:
        out = []
        while end > since:
            out.append(end)
            end -= len(sizes[lasts[end - 1]])
        return out

    @staticmethod
    def _tokens(lasts: list[int], end: int, since: int, sizes: dict) -> list[int]:
        out = []
        while end > since:
            out.append(lasts[end - 1])
            end -= len(sizes[lasts[end - 1]])
        return out[::-1]


#: Whole characters in a row.
_WELL_FORMED = re.compile(
    rb"(?:[\x00-\x7F]+|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    rb"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2})+"
)


class Utf8Stream:
    """Characters from bytes that come in parts."""

    def __init__(self) -> None:
        self.need = 0  # bytes that the open character still lacks
        self.value = 0
        self.low, self.high = 0x80, 0xBF  # bounds of its next byte

    def push(self, data: bytes) -> str:
        out: list[str] = []
        at, n = 0, len(data)
        while at < n:
            if not self.need and (run := _WELL_FORMED.match(data, at)):
                # from a closed state through whole characters into a closed state
                out.append(run.group().decode())
                at = run.end()
                if at == n:
                    break
            at = self._byte(data[at], out, at)
        return "".join(out)

    def _byte(self, byte: int, out: list[str], at: int) -> int:
        """One transition; where the next byte is."""
        if self.need:
            if self.low <= byte <= self.high:
                self.value = self.value << 6 | byte & 0x3F
                self.low, self.high = 0x80, 0xBF
                self.need -= 1
                if not self.need:
                    out.append(chr(self.value))
                return at + 1
            self.need = 0
            self.low, self.high = 0x80, 0xBF
            out.append("\ufffd")
            return at
        if byte < 0x80:
            out.append(chr(byte))
        elif 0xC2 <= byte <= 0xDF:
            self.need, self.value = 1, byte & 0x1F
        elif 0xE0 <= byte <= 0xEF:
            self.need, self.value = 2, byte & 0x0F
            self.low, self.high = 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
        elif 0xF0 <= byte <= 0xF4:
            self.need, self.value = 3, byte & 0x07
            self.low, self.high = 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
        else:
            out.append("\ufffd")
        return at + 1

    def close(self) -> str:
        left, self.need = self.need, 0
        return "\ufffd" if left else ""


class _Outputs(dict):
    """piece -> tokens, filled by the transducer; the newest half of ``most`` pieces at least is kept."""

    def __init__(self, machine: Transducer, most: int):
        self.machine, self.most, self.older = machine, most, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.older.get(piece)
        if found is None:
            read: list[int] = []
            self.machine.read(piece.encode("utf-8", "surrogatepass"), read.extend)
            found = tuple(read)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= self.most // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class Codec:
    """Texts to ids and back, by a rank file's content and a splitting pattern."""

    def __init__(self, content: bytes, pattern: str, most_pieces: int = MOST_PIECES, most_states: int = MOST_STATES):
        import regex

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
        self.machine = Transducer(ranks, most_states)
        self.split = regex.compile(pattern).findall
        self._outputs = _Outputs(self.machine, most_pieces)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._outputs.__getitem__, self.split(text))))

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.machine.bytes_of.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int], at_once: int = 1) -> Iterator[str]:
        """The text of ids as they come, ``at_once`` at a time."""
        stream, ids = Utf8Stream(), iter(ids)
        while some := list(islice(ids, at_once)):
            if out := stream.push(self.decode_bytes(some)):
                yield out
        if out := stream.close():
            yield out


_CODECS: dict[tuple[int, str], Codec] = {}


def codec(content: bytes, pattern: str) -> Codec:
    key = (zlib.crc32(content), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(content, pattern)
    return _CODECS[key]


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids), a row for each document.

    ranks: a tiktoken rank file on the driver; its bytes (a vocabulary, so of
    bounded size) are broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(_file(ranks))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(held.value, pattern).encode
        for ids, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([encode(t) for t in texts], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_text(docs, doc_id, text).mapInArrow(rows, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    held = encoded.sparkSession.sparkContext.broadcast(_file(ranks))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value, pattern)
        for batch in batches:
            texts = ["".join(c.decode_stream(x or (), AT_ONCE)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _decoded_digest(c: Codec, ids: list[int]) -> str:
    return hashlib.sha256("".join(c.decode_stream(ids, AT_ONCE)).encode("utf-8")).hexdigest()


def round_trip_digests(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """DIGESTS: a row for each document, encoded and decoded in one pass."""
    held = docs.sparkSession.sparkContext.broadcast(_file(ranks))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value, pattern)
        names = {i: str(i) for i in c.machine.bytes_of}
        for ids, texts in blocks(batches):
            sizes, of_ids, of_bytes = [], [], []
            for t in texts:
                found = c.encode(t)
                sizes.append(len(found))
                of_ids.append(hashlib.sha256(",".join(map(names.__getitem__, found)).encode()).hexdigest())
                of_bytes.append(_decoded_digest(c, found))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs, doc_id, text).mapInArrow(rows, DIGESTS)
