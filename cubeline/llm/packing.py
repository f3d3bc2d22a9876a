"""Cost-balanced packing of documents into fixed-length training sequences.

A document is its token ids and an end mark. Full pieces of ``length`` tokens are
cut off and are sequences of their own; what remains of the documents is packed.
A piece of n tokens costs ``linear * n + quadratic * n * n``, as attention within
a document does. In descending cost each remainder goes to the sequence of lowest
cost that still has room for it; one that fits nowhere whole is cut and fills the
sequences with most room. The sequences opened have exactly the tokens that are
to be packed: full ones, and for the last tokens one sequence for each power of
two in their number, which needs no padding.

Documents are dealt to packing groups by a hash of their place and remainder, so
rows of one id, or without one, spread over all groups. The groups grow in number
with the text, not in size; only remainders and checksums are shuffled. Texts that
come out of a shuffle are written first, as their places may change if a lost task
runs again.

Defined cases: a null text counts as empty and packs as its end mark; a null id
stays null; rows that repeat an id are packed each; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, id_text
from .scratch import Scratch, settled

LENGTH = 2048
#: Characters of text for each packing group, about.
GROUP_CHARS = 6_000_000
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH
END_ID = 1
_FIELDS = [pa.field(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ENCODERS: dict[tuple[int, bool], object] = {}


def encoder(content: bytes, ranked: bool):
    """ids of texts, as the ``tokenizers`` library gives them without added special tokens; ranked: what is_ranked says of the content."""
    key = (zlib.crc32(content), ranked)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        if ranked:
            import public_tokenizers
            import tiktoken

            ranks, special = _ranks(json.loads(content))
            fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            _ENCODERS[key] = lambda texts: [fast.encode(t, allowed_special="all") for t in texts]
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_str(content.decode())
            _ENCODERS[key] = lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    return _ENCODERS[key]


def _ranks(said: dict) -> tuple[dict[bytes, int], dict[str, int]]:
    """(token bytes -> id, special tokens); a character that stands for no byte raises KeyError."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(kept))}
    special = {t["content"]: t["id"] for t in said.get("added_tokens") or []}
    return {bytes(letters[c] for c in t): i for t, i in said["model"]["vocab"].items() if t not in special}, special


def is_ranked(content: bytes) -> bool:
    """Whether merging the adjacent pair of least token id gives what the file's list of merges gives, for every text.

    It does if the settings are those of plain byte-level BPE and, for each token
    of more than a byte, merges of lesser ids alone bring its bytes to exactly the
    pair that its own merge, the only one, is of, and ids rise with the merges: as
    long as both ends of a token's bytes stand, what happens between them does not
    depend on what is outside, so no other pair can ever come to make that token.
    """
    said = json.loads(content)
    model, split = said.get("model") or {}, said.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain &= split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True) and not said.get("normalizer")
    added = said.get("added_tokens") or []
    plain &= len(added) <= 1 and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not plain:
        return False
    try:
        ranks, _ = _ranks(said)
    except KeyError:
        return False
    if any(bytes((b,)) not in ranks for b in range(256)):
        return False
    of = {i: t for t, i in ranks.items()}
    text_id, last = said["model"]["vocab"], -1
    for merge in said["model"]["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        if a not in text_id or b not in text_id or a + b not in text_id or text_id[a + b] <= last:
            return False
        last = text_id[a + b]
        if last not in of or _merged(of[last], ranks, last) != [text_id[a], text_id[b]]:
            return False
    return len(said["model"]["merges"]) == sum(len(t) > 1 for t in ranks)


def _merged(token: bytes, ranks: dict[bytes, int], below: int) -> list[int]:
    """The ids that merges of lesser ids bring the token's bytes to."""
    parts = [token[k : k + 1] for k in range(len(token))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[k] + parts[k + 1], below), k) for k in range(len(parts) - 1))
        if best >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _tails(content: bytes, ranked: bool, length: int, end_id: int):
    """(id, row, tokens, crcs, tail, wide): the row's number in its partition, checksums of the full pieces, the ids of the rest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = encoder(content, ranked), 0
        for ids, texts in blocks(batches):
            tokens, crcs, tails = [], [], []
            for found in encode(texts):
                x = np.array([*found, end_id], "<u4")
                full = len(x) // length * length
                tokens.append(len(x))
                crcs.append([zlib.crc32(x[a : a + length].tobytes()) for a in range(0, full, length)])
                tails.append((x[full:].astype("<u2") if x.max(initial=0) < 65536 and len(x) > full else x[full:]).tobytes())
            wide = [len(t) == 4 * (n % length) for t, n in zip(tails, tokens, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(range(row, row + len(ids)), pa.int64()), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary()), pa.array(wide, pa.bool_())],
                names=["id", "row", "tokens", "crcs", "tail", "wide"],
            )
            row += len(ids)

    return rows


def capacities(total: int, length: int) -> list[int]:
    """Sequences for exactly ``total`` tokens: full ones, then falling powers of two."""
    out, rest = [length] * (total // length), total % length
    return out + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def assign(sizes: list[int], length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, n, sequence, offset) of the pieces of documents shorter than a sequence."""
    room = np.array(capacities(sum(sizes), length), np.int64)
    cost = np.zeros(len(room))
    filled = np.zeros(len(room), np.int64)
    out = []

    def put(d: int, start: int, n: int, s: int) -> None:
        out.append((d, start, n, int(s), int(filled[s])))
        filled[s] += n
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n

    for d in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        n, start = sizes[d], 0
        fits = np.flatnonzero(room >= n)
        if len(fits):
            put(d, 0, n, fits[np.argmin(cost[fits])])
            continue
        while start < n:
            s = int(np.argmax(room))
            k = min(int(room[s]), n - start)
            put(d, start, k, s)
            start += k
    return out


def _packed(length: int, linear: float, quadratic: float):
    def rows(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in _FIELDS})
        # plain ints and None: a column with nulls must not become floating
        held = sorted(zip(*(table.column(c).to_pylist() for c in ("id", "tokens", "row", "crcs", "tail", "wide")), strict=True), key=lambda r: (r[0] is None, r[0] or 0, *r[1:3], r[4]))
        group, columns, number = table.column("pack")[0].as_py() << 40, [], 0
        tails = [np.frombuffer(r[4], "<u4" if r[5] else "<u2").astype("<u4") for r in held]
        for i, n, _, crcs, _, _ in held:
            for k, crc in enumerate(crcs):
                columns.append((i, k * length, length, crc, n, group + number, 0))
                number += 1
        some = [k for k, t in enumerate(tails) if len(t)]
        for d, start, n, s, offset in assign([len(tails[k]) for k in some], length, linear, quadratic):
            k = some[d]
            i, tokens = held[k][:2]
            columns.append((i, tokens - len(tails[k]) + start, n, zlib.crc32(tails[k][start : start + n].tobytes()), tokens, group + number + s, offset))
        return pa.table({f.name: pa.array(c, f.type) for f, c in zip(_FIELDS, zip(*columns, strict=True), strict=True)})

    return rows


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, linear: float = LINEAR, quadratic: float = QUADRATIC, group_chars: int = GROUP_CHARS) -> DataFrame:
    """A row for each piece: PIECES.

    tokenizer: a ``tokenizers`` file on the driver; its bytes (a vocabulary, so of
    bounded size) go to the executors.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    with open(tokenizer, "rb") as f:
        content = f.read()
    docs = settled(Scratch(docs.sparkSession, "pack"), docs, doc_id, text)
    size = docs.agg(F.sum(F.length(F.col(f"`{text}`"))), F.count(F.lit(1))).first()
    groups = ((size[0] or 0) + size[1]) // group_chars + 1  # an end mark is a token too
    held = docs.sparkSession.sparkContext.broadcast((content, is_ranked(content)))

    def tails(batches):
        return _tails(*held.value, length, end_id)(batches)

    rows = id_text(docs, doc_id, text).mapInArrow(tails, "id long, row long, tokens long, crcs array<long>, tail binary, wide boolean")
    # by row and content, not by id: rows of one id spread over all groups
    rows = rows.withColumn("pack", F.pmod(F.xxhash64("id", "row", "tail"), F.lit(groups)))
    # as many partitions as groups, whatever the session's number is, so that a task's share does not grow
    return rows.repartition(groups, "pack").groupBy("pack").applyInArrow(_packed(length, linear, quadratic), PIECES)
