"""Near-duplicate classes: a size-aware heavy-light Jaccard join on word shingles.

Two texts link when the Jaccard similarity of their sets of five-word shingles
is at least ``threshold`` (a fraction of whole numbers, compared exactly). The
join follows the size-aware scheme of Deng, Tao and Li (SIGMOD 2018):

* *small sets* enumerate the fixed-size subsets (pairs) of their extended prefix;
  two small sets that link must share such a pair;
* *large sets* scan the inverted lists of single shingles of their prefix; lists
  also hold the small sets that are large enough to link with a large one;
* the *boundary* is the size with the least cost, estimated from the subsets that
  small sets would enumerate and the list entries that they would scan.

Classes, not all pairs, are wanted, so a list of k sets costs k comparisons: all
are compared with one leader L, and what links with L is one class. If X fails,
it can link with a set Y of the list only if |X n Y| is at least what X needs with
the smallest set of the list, and |X n Y| <= |X n L| + what both hold outside L.
So X and Y share shingles outside L, as many as X lacks. The sets of one leader
are listed again by their shingles outside it; a set that failed needs a prefix
of them only, in which the shingles of its own come first, so most leave here.
Lists without a failed set are dropped; short ones are compared pair by pair;
long ones get a leader of their own. Leaders are the sets with fewest shingles of
their own, the likely originals; a set that failed against one, but may by this
bound link with sets smaller than it, is listed with those again under their
smallest set, with which a failed set always lacks something. Nothing is capped,
and no link between classes is lost.

The order of prefixes is by the number of sets that hold a shingle. Shingles that
one set only holds (nearly all) fill most prefixes and are never listed. To find
them, shingles travel packed, sorted by hash range, to tasks that return the
shared ones to their sets, packed likewise. A shingle that is frequent within one
portion of texts is not sent there; it is marked, comes last in the order, and is
listed only for sets that consist of such shingles. One pass decides which are,
and sends its entries of both kinds through one exchange; texts that come out of
a shuffle are written first, as their order may change if a lost task runs again.
Portions of a hash range meet ``fan`` at a time, in as many rounds as there are
portions for, and each round marks what is frequent in it. So of no shingle do more
than ``frequent * fan`` entries come to a task.
Lists are grouped by pre-aggregated minima and joins that can be split, so none
meets in one task.

Defined cases: null and empty texts, and texts of white space, have the empty set
and link with nothing; identical sets are one class from the start; rows with a
null id stay in the result with a null id, and their class is the smallest id
found; rows that repeat an id are reported as often; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import blocks, id_text
from .components import components
from .exact_dedup import staying_rows
from .scratch import Scratch, settled
from .textvec import mix, shingles, word_hashes

NUMERATOR, DENOMINATOR = 80, 100
#: Sizes up to this are tried as the boundary between small and large sets.
LARGEST_BOUNDARY = 64
#: A shingle in more sets than this within one portion counts as frequent; a portion has about so many shingles.
FREQUENT = 64
PORTION = 1_000_000
#: Portions that meet in a round.
FAN = 1024
#: Shingles of a bucket, and sets of a part, about.
BUCKET = 1_000_000
PART_SETS = 10_000
#: Up to this many pairs (24 bytes each) are broadcast to the table of sets; more are shuffled with it.
BROADCAST_PAIRS = 200_000
#: A set of more rows than this, and than one in MOST_HOT of all rows, is hot. So at most MOST_HOT sets are, and are broadcast (16 bytes each).
HOT_ROWS, MOST_HOT = 1000, 10_000
_MANY = np.uint32(0xFFFFFFFF)
#: Lists up to this length are compared pair by pair once a set has failed against a leader.
SHORT_LIST = 32
_SUBSET = np.uint64(0xA0761D6478BD642F)
_IDS, _CHECKS = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)


def least_overlap(x, y, num: int = NUMERATOR, den: int = DENOMINATOR):
    """The intersection that sets of x and y elements need: ceil(num * (x + y) / (num + den))."""
    return -(-num * (x + y) // (num + den))


def _band(num: int, den: int) -> str:
    """Sets that may link lie in one band or in two next to each other."""
    return f"cast(floor(ln(n) / ln({max(1.25, den / num)!r}D) + 1e-9D) as int)"


def _prefix(n: int, num: int, den: int) -> int:
    return n + (-num * n // den) + 1  # n - ceil(num * n / den) + 1


# --- sets -----------------------------------------------------------------------------------------


def _identity(s: np.ndarray, salt: np.uint64) -> int:
    return int(mix(s ^ salt).sum().view(np.int64))


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in blocks(batches):
        for first, block in word_hashes(texts):
            found = [shingles(words) for words in block]
            columns = [[_identity(s, salt) if len(s) else None for s in found] for salt in (_IDS, _CHECKS)]
            arrays = [pa.array(ids[first : first + len(block)], pa.int64()), *(pa.array(c, pa.int64()) for c in columns), pa.array([len(s) for s in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "set_id", "check", "n"])


def document_sets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, set_id, check, n): the size of each text's set, and its identity twice."""
    return id_text(docs, doc_id, text).mapInArrow(_set_rows, "id long, set_id long, check long, n long")


# --- shingles that several sets hold --------------------------------------------------------------


def _portions(batches: Iterator[pa.RecordBatch], portion: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts with about ``portion`` shingles at a time, each set once: shingles in order, the number of the set of each, the sets."""
    held, sets, size = [], {}, 0
    for _, texts in blocks(batches):
        for _, block in word_hashes(texts):
            for words in block:
                s = shingles(words)
                if len(s) and (own := _identity(s, _IDS)) not in sets:
                    sets[own] = len(sets)
                    held.append(s)
                    size += len(s)
                if size > portion:
                    yield _portion(held, sets)
                    held, sets, size = [], {}, 0
    if held:
        yield _portion(held, sets)


def _portion(held: list[np.ndarray], sets: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, of = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.uint32), [len(s) for s in held])
    order = np.argsort(keys, kind="stable")
    return keys[order], of[order], np.array(list(sets), np.int64)


def _counts(keys: np.ndarray) -> np.ndarray:
    """How often each of the sorted keys comes."""
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    counts = np.diff(np.append(starts, len(keys)))
    return np.repeat(counts, counts)


def _planes(keys: np.ndarray) -> bytes:
    """Sorted keys byte by byte, highest first, which the shuffle's compression thrives on."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


_PACKED = "slot long, bucket long, salt long, keys binary, of binary, sets binary, marks boolean"
#: Partitions that buckets are dealt to, at most.
MOST_SLOTS = 16_384


def _slots(spark: SparkSession, n: int) -> np.ndarray:
    """n numbers that hash partitioning deals to n partitions, one to each."""
    found: dict[int, int] = {}
    at, size = 0, 16 * n + 64
    while len(found) < n:
        rows = spark.range(at, at + size).groupBy(F.expr(f"pmod(hash(id), {n})").alias("p")).agg(F.min("id").alias("id")).collect()  # n rows
        for r in rows:
            found.setdefault(r.p, r.id)
        at += size
    return np.array([found[p] for p in range(n)], np.int64)


def _blob(bucket: int, salt: int, keys: np.ndarray, of: np.ndarray, sets: np.ndarray) -> tuple:
    """A row of _PACKED: sorted keys, the place in ``sets`` of the set of each, len(sets) for a mark."""
    used, own = np.unique(of, return_inverse=True)
    own = own.astype(np.uint16 if len(used) < 65536 else np.uint32)
    return bucket, salt, _planes(keys), own.tobytes(), np.append(sets, 0)[used].tobytes(), bool(len(used) and used[-1] == len(sets))


def _unpacked(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, sets, and whether each is a mark, of rows (keys, of, sets, marks)."""
    keys, sets, none = [], [], []
    for k, of, named, marks in rows:
        k, named = _unplaned(k), np.frombuffer(named, np.int64)
        of = np.frombuffer(of, np.uint16 if 2 * len(k) == len(of) else np.uint32)
        keys.append(k)
        sets.append(named[of])
        none.append(of == len(named) - 1 if marks else np.zeros(len(k), bool))
    return np.concatenate(keys), np.concatenate(sets), np.concatenate(none)


def _dealt(out: list[tuple], slots: np.ndarray) -> list[tuple]:
    """Rows with the slot of their bucket before it: buckets, and the parts of frequent entries, in turn."""
    return [(int(slots[row[0] % len(slots)]), *row) for row in out]


def _packed(bits: int, parts: int, frequent: int, portion: int, slots: np.ndarray) -> Callable:
    """_PACKED: the entries of shingles that are not frequent here, with a list of their sets; of each that is, a mark without a set.

    Under -1 - part, the entries of the frequent ones, by set. salt: a number of the portion.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, of, sets in _portions(batches, portion):
            salt = int(mix(sets[:1].view(np.uint64)).view(np.int64)[0])
            often = _counts(keys) > frequent
            out = [(-1 - part, salt, k, b"", s, False) for part, k, s, _ in _by_set(keys[often], sets[of[often]], np.zeros(int(often.sum()), np.uint32), parts)]
            marks = np.unique(keys[often])
            keys, of = np.concatenate((keys[~often], marks)), np.concatenate((of[~often], np.full(len(marks), len(sets), np.uint32)))
            order = np.argsort(keys, kind="stable")
            keys, of = keys[order], of[order]
            bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(at, np.append(at[1:], len(keys))[: len(at)], strict=True):
                out.append(_blob(int(bucket[a]), salt, keys[a:b], of[a:b], sets))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*_dealt(out, slots), strict=True), kinds, strict=True)], names=["slot", "bucket", "salt", "keys", "of", "sets", "marks"])

    return rows


def _met(parts: int, frequent: int, slots: np.ndarray) -> Callable:
    def met(key, pdf):
        """_PACKED of some portions of one hash range, as of one portion. Entries of frequent shingles go on as they are."""
        import pandas as pd

        bucket, salt = map(int, key)
        if bucket < 0:
            return pdf
        keys, sets, none = _unpacked(zip(pdf["keys"], pdf["of"], pdf["sets"], pdf["marks"], strict=True))
        marked = np.unique(keys[none])
        keys, sets = keys[~none], sets[~none]
        order = np.lexsort((sets, keys))
        keys, sets = keys[order], sets[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])
        keys, sets = keys[new], sets[new]
        often = (_counts(keys) > frequent) | np.isin(keys, marked)
        out = [(-1 - part, salt, k, b"", s, False) for part, k, s, _ in _by_set(keys[often], sets[often], np.zeros(int(often.sum()), np.uint32), parts)]
        marked = np.union1d(marked, keys[often])
        named, of = np.unique(sets[~often], return_inverse=True)
        keys, of = np.concatenate((keys[~often], marked)), np.concatenate((of, np.full(len(marked), len(named))))
        order = np.argsort(keys, kind="stable")
        if len(keys):
            out.append(_blob(bucket, salt, keys[order], of[order], named))
        return pd.DataFrame(_dealt(out, slots), columns=["slot", "bucket", "salt", "keys", "of", "sets", "marks"])

    return met


def _by_set(keys: np.ndarray, sets: np.ndarray, often: np.ndarray, parts: int):
    """(part, keys, sets, often) as bytes, sorted by set within each part."""
    part = (sets.view(np.uint64) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((sets, part))
    keys, sets, often, part = keys[order], sets[order], often[order], part[order]
    at = np.flatnonzero(np.diff(part, prepend=-1))
    return [(int(part[a]), keys[a:b].tobytes(), sets[a:b].tobytes(), often[a:b].astype(np.uint32).tobytes()) for a, b in zip(at, np.append(at[1:], len(keys))[: len(at)], strict=True)]


def _shared(parts: int) -> Callable:
    def shared(key, pdf):
        """Of one hash range, the entries of shingles that several sets hold or that are marked, with the number of sets. Frequent ones go on as they are."""
        import pandas as pd

        if key[1] < 0:
            often = [np.full(len(s) // 8, _MANY, np.uint32).tobytes() for s in pdf["sets"]]
            return pd.DataFrame({"part": np.full(len(pdf), -1 - key[1], np.int64), "keys": pdf["keys"], "sets": pdf["sets"], "often": often})
        keys, sets, none = _unpacked(zip(pdf["keys"], pdf["of"], pdf["sets"], pdf["marks"], strict=True))
        marked = np.unique(keys[none])
        order = np.argsort(keys, kind="stable")
        keys, sets, none = keys[order], sets[order], none[order]
        same = keys[1:] == keys[:-1]
        several = np.zeros(len(keys), bool)
        several[1:] |= same
        several[:-1] |= same
        several |= np.isin(keys, marked)
        several &= ~none
        keys, sets = keys[several], sets[several]
        order = np.lexsort((sets, keys))
        keys, sets = keys[order], sets[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])
        keys, sets = keys[new], sets[new]
        often = np.minimum(_counts(keys), int(_MANY) - 1).astype(np.uint32)
        often[np.isin(keys, marked)] = _MANY
        keep = often > 1
        return pd.DataFrame(_by_set(keys[keep], sets[keep], often[keep], parts), columns=["part", "keys", "sets", "often"])

    return shared


def _prefixes(num: int, den: int) -> Callable:
    def prefixes(table: pa.Table) -> pa.Table:
        """(set_id, n, keep, shared): the shingles of a set that another one holds, rarest first; ``keep`` of them are in its extended prefix.

        Rows are blobs (keys, sets, often) or sets (set_id, n).
        """
        blobs = table.filter(pc.is_valid(table["keys"]))
        named = table.filter(pc.is_valid(table["set_id"]))
        size = dict(zip(named["set_id"].to_pylist(), named["n"].to_pylist(), strict=True))
        out = []
        if blobs.num_rows:
            keys, own, often = (np.concatenate([np.frombuffer(x, t) for x in blobs[c].to_pylist()]) for c, t in (("keys", np.uint64), ("sets", np.int64), ("often", np.uint32)))
            order = np.lexsort((keys, often, own))
            keys, own, often = keys[order], own[order], often[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
            keys, own = keys[new], own[new]
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            for a, b in zip(starts, np.append(starts[1:], len(own)), strict=True):
                n = size[int(own[a])]
                keep = _prefix(n, num, den) + 1 - (n - (b - a))
                if keep > 0:
                    out.append((int(own[a]), n, min(keep, int(b - a)), keys[a:b].view(np.int64)))
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["set_id", "n", "keep", "shared"])

    return prefixes


def shared_shingles(docs: DataFrame, sets: DataFrame, doc_id: str, text: str, num: int = NUMERATOR, den: int = DENOMINATOR, frequent: int = FREQUENT, portion: int = PORTION, fan: int = FAN) -> DataFrame:
    """(set_id, n, keep, shared), of sets that may meet another one. Buckets grow in number with the shingles, not in size.

    The order is by the number of sets that hold a shingle, frequent ones last. A
    shingle that one set only holds is left out, but counts for the prefix.
    """
    total, count = sets.agg(F.sum("n"), F.count("n")).first()
    bits = max(3, int(np.ceil(np.log2((total or 0) / BUCKET + 1))))
    parts = max(8, (count or 0) // PART_SETS)
    texts = id_text(docs, doc_id, text)
    slots = _slots(docs.sparkSession, min((1 << bits) + parts, MOST_SLOTS))
    packed = texts.mapInArrow(_packed(bits, parts, frequent, portion, slots), _PACKED)
    groups = -(-(total or 0) // portion)
    while groups > fan:
        groups = -(-groups // fan)
        packed = packed.withColumn("salt", F.pmod("salt", F.lit(groups))).groupBy("bucket", "salt").applyInPandas(_met(parts, frequent, slots), _PACKED)
    schema = "part long, keys binary, sets binary, often binary"
    # as many partitions as buckets, whatever the session's number is, so that a task's share does not grow
    listed = packed.drop("salt").repartition(len(slots), "slot").groupBy("slot", "bucket").applyInPandas(_shared(parts), schema)
    sizes = sets.filter("n > 0").select("set_id", "n").distinct()
    sizes = sizes.withColumn("part", F.expr(f"pmod(pmod(shiftrightunsigned(set_id, 1), {parts}) * 2 + (set_id & 1), {parts})"))
    own = [(k, int(v)) for k, v in enumerate(_slots(docs.sparkSession, min(parts, MOST_SLOTS)))]
    named = F.broadcast(docs.sparkSession.createDataFrame(own, "turn long, slot long"))  # MOST_SLOTS rows at most
    rows = listed.unionByName(sizes, allowMissingColumns=True).withColumn("turn", F.pmod("part", F.lit(len(own)))).join(named, "turn").drop("turn")
    return rows.repartition(len(own), "slot").groupBy("slot", "part").applyInArrow(_prefixes(num, den), "set_id long, n long, keep long, shared array<long>")


# --- the boundary, and list entries ---------------------------------------------------------------


def boundary(prefixes: DataFrame, num: int = NUMERATOR, den: int = DENOMINATOR, largest: int = LARGEST_BOUNDARY) -> int:
    """Sets below this size enumerate pairs. At most ``largest`` rows of counts come to the driver."""
    small = prefixes.filter(f"n <= {largest}").select("n", F.col("keep").cast("int").alias("r"), F.col("shared").alias("prefix"))
    pairs = {r.n: r.c for r in small.groupBy("n").agg(F.sum(F.expr("r * (r - 1) / 2")).alias("c")).collect()}
    by = small.select("n", F.explode(F.expr("slice(prefix, 1, r)")).alias("token")).groupBy("token", "n").agg(F.count(F.lit(1)).alias("c"))
    lists = by.groupBy("token").agg(F.sum("c").alias("whole"))
    scans = {r.n: r.c for r in by.join(lists, "token").groupBy("n").agg(F.sum(F.expr("c * whole")).alias("c")).collect()}

    def cost(x: int) -> float:
        return sum(c for n, c in pairs.items() if n < x) + sum(c for n, c in scans.items() if n * den >= num * x)

    return min(range(2, largest + 1), key=lambda x: (cost(x), x))


def _entry_rows(limit: int, num: int, den: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets, sizes, alone = [], [], [], []
            for s, n, keep, shared in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                tokens = shared.values.to_numpy()[:keep].view(np.uint64)
                # the prefix proper has one shingle less, unless the set has no more to extend it
                # from 1/2 down, sets of at most den / num may link by one shingle, which no pair finds
                single = n * den >= num * limit or (2 * num <= den and n * num <= den)
                found = [tokens[: _prefix(n, num, den) - n + len(shared)]] if single else []
                if n < limit:
                    i, j = np.triu_indices(len(tokens), 1)
                    low, high = np.minimum(tokens[i], tokens[j]), np.maximum(tokens[i], tokens[j])
                    found.append(mix(mix(low ^ _SUBSET) + high))
                for f in found:
                    keys.append(f)
                    sets.append(np.full(len(f), s, np.int64))
                    sizes.append(np.full(len(f), n, np.int64))
                    alone.append(np.full(len(f), n - len(shared), np.int64))
            if keys:
                columns = [np.concatenate(keys).view(np.int64), *map(np.concatenate, (sets, sizes, alone))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "x", "n", "alone"])

    return rows


def list_entries(prefixes: DataFrame, limit: int, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """(key, x, n, alone): small sets under pairs of shingles; large ones, and those that may link with them, under shingles."""
    return prefixes.select("set_id", "n", "keep", "shared").mapInArrow(_entry_rows(limit, num, den), "key long, x long, n long, alone long")


# --- comparisons ----------------------------------------------------------------------------------


def _compared(num: int, den: int, again: bool) -> Callable:
    """(x, y, n, alone, linked, upto, rest): y is the leader; rest, what x must be listed by again.

    upto: if x failed, but not against all sets of its lists, the largest size that it may still link with by what it shares with y; else 0.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, upto, rest, sole = [], [], [], []
            for low, n, m, a, b in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), batch.column(5), batch.column(6), strict=True):
                a, b = a.values.to_numpy(), b.values.to_numpy()
                inside = np.isin(a, b, assume_unique=True)
                shared = int(inside.sum())
                link = shared >= least_overlap(n, m, num, den)
                most = shared * (num + den) // num - n
                linked.append(link)
                upto.append(most if not link and most >= low else 0)
                sole.append(n - len(a))
                if again:
                    # shingles that no other set holds come first, and need no list
                    outside = a[~inside]
                    missing = 1 if link else max(1, int(least_overlap(n, low, num, den)) - shared)
                    rest.append(outside[: max(0, len(outside) - missing + 1)])
            arrays = [batch.column(0), batch.column(1), batch.column(3), pa.array(sole, pa.int64()), pa.array(linked, pa.bool_()), pa.array(upto, pa.int64())]
            if again:
                arrays.append(pa.array(rest, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names=["x", "y", "n", "alone", "linked", "upto", "rest"][: len(arrays)])

    return rows


def _compare(scratch: Scratch, pairs: DataFrame, sets: DataFrame, num: int, den: int, again: bool) -> DataFrame:
    """pairs: (x, y, low), low being the least size of a set that x may link with through their lists."""
    pairs = scratch.keep(pairs.select("x", "y", "low"), "pairs")
    few = (lambda t: F.broadcast(t)) if pairs.count() <= BROADCAST_PAIRS else (lambda t: t)
    with_x = sets.select(F.col("set_id").alias("x"), "n", F.col("shared").alias("tx")).join(few(pairs), "x")
    leaders = sets.select(F.col("set_id").alias("y"), F.col("n").alias("m"), F.col("shared").alias("ty")).join(few(pairs.select("y").distinct()), "y")
    both = with_x.join(leaders, "y")
    schema = "x long, y long, n long, alone long, linked boolean, upto long" + ", rest array<long>" * again
    return scratch.keep(both.select("x", "y", "low", "n", "m", "tx", "ty").mapInArrow(_compared(num, den, again), schema), "compared")


def _led(entries: DataFrame, central: bool) -> DataFrame:
    """(key, band, x, y, low): each set of a list with its leader, the smallest set or the one with fewest shingles of its own."""
    first = entries.groupBy("key", "band").agg(F.min(F.struct("n", "x")).alias("s"), F.min(F.struct("alone", (-F.col("n")).alias("m"), "x")).alias("c"), F.max("x").alias("hi"), F.min("x").alias("lo"))
    first = first.filter("lo <> hi").select("key", "band", F.col("c.x" if central else "s.x").alias("y"), F.col("s.n").alias("low"))
    return entries.join(first, ["key", "band"]).filter("x <> y").select("key", "band", "x", "y", "low")


def _against_leaders(scratch: Scratch, entries: DataFrame, sets: DataFrame, num: int, den: int) -> list[DataFrame]:
    """Comparisons that settle the lists but for shingles outside the leaders.

    A set that failed against a central leader may still link with smaller sets by
    what it shares with it. These sets, and the smaller ones, are a list with the
    smallest as leader.
    """
    led = scratch.keep(_led(entries, True), "led")
    found = _compare(scratch, _pairs(led), sets, num, den, True)
    unsure = led.join(found.filter("upto > 0").select("x", "y", "upto"), ["x", "y"]).select("key", "band", "x", "upto")
    unsure = scratch.keep(unsure, "unsure")
    least = unsure.groupBy("key", "band").agg(F.max("upto").alias("upto"))
    small = entries.join(least, ["key", "band"]).filter("n <= upto").select(*entries.columns)
    small = small.union(entries.join(unsure.select("key", "band", "x"), ["key", "band", "x"]).select(*entries.columns)).distinct()
    return [found, _compare(scratch, _pairs(_led(small, False)), sets, num, den, True)]


def _pairs(led: DataFrame) -> DataFrame:
    return led.groupBy("x", "y").agg(F.min("low").alias("low"))


def _listed(found: DataFrame) -> DataFrame:
    """(key, x, n, alone, failed): the sets of a leader under their shingles outside it."""
    rows = found.select("y", "x", "n", "alone", F.expr("not linked").alias("failed"), F.explode("rest").alias("token"))
    return rows.select(F.xxhash64("y", "token").alias("key"), "x", "n", "alone", "failed")


def similarity_classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    num: int = NUMERATOR,
    den: int = DENOMINATOR,
    short_list: int = SHORT_LIST,
    levels: int = 6,
    limit: int | None = None,
    frequent: int = FREQUENT,
    portion: int = PORTION,
    fan: int = FAN,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each document.

    num / den: the least similarity. short_list: lists up to this length are
    compared pair by pair. levels: rounds of leaders, after which the lists that
    are left are compared block by block. limit: the boundary between small and large sets; by cost if None.
    frequent: a shingle in more sets than this of a portion, or of portions that
    meet, is frequent. portion: shingles of a portion. fan: portions that meet.
    hot_rows: rows of one set up to which they may meet in a task.
    """
    scratch = Scratch(docs.sparkSession, "ngram")
    table, links = _links(scratch, settled(scratch, docs, doc_id, text), doc_id, text, num, den, short_list, levels, limit, frequent, portion, fan)
    reps = _sets(table).select("set_id", F.col("id").alias("rep"), "copies")
    named = reps.filter("rep is not null")
    edges = links.join(named.select(F.col("set_id").alias("x"), F.col("rep").alias("a")), "x").join(named.select(F.col("set_id").alias("y"), F.col("rep").alias("b")), "y")
    classes = scratch.keep(components(scratch, edges.select("a", "b")), "classes")
    _verify(table)
    rep = reps.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", "copies", F.coalesce("component", "rep").alias("component"))
    out = _classed(table, scratch.keep(rep, "reps"), hot_rows)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _classed(table: DataFrame, reps: DataFrame, hot_rows: int) -> DataFrame:
    """(id, n, component) of all rows; reps: (set_id, copies, component).

    Rows of hot sets stay where they are, as their classes are broadcast, and rows
    without a set need none; so no key brings more rows to a task than a hot set has at least.
    """
    limit = max(hot_rows, table.count() // MOST_HOT)
    hot = F.broadcast(reps.filter(F.col("copies") > limit).select("set_id", "component"))
    others = reps.filter(F.col("copies") <= limit).select("set_id", "component")
    full = table.filter("n > 0")
    # both sides grow with docs: shuffled at any size, never broadcast while they are few
    rest = full.join(hot.select("set_id"), "set_id", "left_anti").join(others.hint("merge"), "set_id")
    none = table.filter("n = 0").withColumn("component", F.col("id"))
    return full.join(hot, "set_id").select("id", "n", "component").union(rest.select("id", "n", "component")).union(none.select("id", "n", "component"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """docs with one row, that of the smallest id (one without an id only if no other is), of each class of similar texts.

    Classes are of sets, not of ids: an id that repeats with other texts does not
    join their classes. Texts without words all stay.
    """
    scratch = Scratch(docs.sparkSession, "near")
    table, links = _links(scratch, settled(scratch, docs, doc_id, text), doc_id, text, num, den)
    classes = scratch.keep(components(scratch, links.select(F.col("x").alias("a"), F.col("y").alias("b"))), "classes")
    _verify(table)
    first = _sets(table).join(classes.withColumnRenamed("node", "set_id"), "set_id", "left")
    first = first.groupBy(F.coalesce("component", "set_id").alias("class")).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "set_id")).alias("f"))
    first = first.select(F.col("f.id").alias("__id"), F.col("f.set_id").alias("__set"))
    rows = table.groupBy("id", "set_id").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(first, F.col("id").eqNullSafe(F.col("__id")) & (F.col("set_id") == F.col("__set")), "left")
    rows = rows.withColumn("stays", F.col("set_id").isNull() | F.col("__set").isNotNull())

    def keyed(some: DataFrame) -> DataFrame:
        at = some.columns.index(text)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [shingles(w) for _, block in word_hashes([t or "" for t in batch.column(at).to_pylist()]) for w in block]
                key = pa.array([_identity(s, _IDS) if len(s) else None for s in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns, key], names=[*batch.schema.names, "__set_id"])

        return some.mapInArrow(add, T.StructType([*some.schema.fields, T.StructField("__set_id", T.LongType())]))

    return staying_rows(scratch, docs, rows, ["set_id"], keyed, doc_id, text)


def _sets(table: DataFrame) -> DataFrame:
    """(set_id, id, copies): each set with its smallest id and number of rows."""
    return table.filter("n > 0").groupBy("set_id").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


def _verify(table: DataFrame) -> None:
    if not table.filter("n > 0").groupBy("set_id").agg((F.min("check") != F.max("check")).alias("bad")).filter("bad").isEmpty():
        raise RuntimeError("two different shingle sets have the same 64-bit identity")


def _linked_pairs(scratch: Scratch, rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y) of those rows (x, n, y, m) that link."""
    rows = rows.filter(f"x <> y and least(n, m) * {den} >= greatest(n, m) * {num}")
    rows = rows.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.lit(0).cast("long").alias("low")).distinct()
    return _compare(scratch, rows, sets, num, den, False).filter("linked").select("x", "y")


def _blockwise(scratch: Scratch, listed: DataFrame, sets: DataFrame, num: int, den: int, block: int) -> list[DataFrame]:
    """(x, y) that link within the lists that are left: about ``block`` sets of each list a round, against those of its later blocks.

    So a round makes about ``block`` pairs for each entry, and no list is paired with itself at once.
    """
    dealt = listed.withColumn("block", F.pmod(F.xxhash64("x"), F.ceil(F.col("k") / block)))
    dealt = scratch.keep(dealt.select("key", "x", "n", "failed", "block"), "blocks")
    out = []
    for r in range((dealt.agg(F.max("block")).first()[0] or 0) + 1):
        some = dealt.filter(f"block = {r}").select("key", F.col("x").alias("y"), F.col("n").alias("m"), F.col("failed").alias("other"))
        pairs = dealt.filter(f"block >= {r}").join(some, "key").filter(f"(failed or other) and (block > {r} or x > y)")
        out.append(_linked_pairs(scratch, pairs, sets, num, den))
    return out


def _links(
    scratch: Scratch, docs: DataFrame, doc_id: str, text: str, num: int, den: int, short_list: int = SHORT_LIST, levels: int = 6, limit: int | None = None, frequent: int = FREQUENT, portion: int = PORTION, fan: int = FAN
) -> tuple[DataFrame, DataFrame]:
    """The table of document_sets, and (x, y): pairs of sets that link, as many as their classes need."""
    table = scratch.keep(document_sets(docs, doc_id, text), "sets")
    prefixes = scratch.keep(shared_shingles(docs, table, doc_id, text, num, den, frequent, portion, fan), "prefixes")
    limit = boundary(prefixes, num, den) if limit is None else limit
    entries = list_entries(prefixes, limit, num, den).withColumn("band", F.expr(_band(num, den)))
    entries = scratch.keep(entries.withColumn("band", F.explode(F.array("band", F.col("band") + 1))), "entries")
    links = []
    for level in range(levels):
        found = _against_leaders(scratch, entries, prefixes, num, den)
        links += [f.filter("linked").select("x", "y") for f in found]
        listed = _listed(found[0]).union(_listed(found[1]))
        listed = scratch.keep(listed.groupBy("key", "x", "n", "alone").agg(F.max("failed").alias("failed")), "listed")
        counts = listed.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max("failed").alias("failed"))
        counts = scratch.keep(counts.filter("k > 1 and failed").select("key", "k"), "counts")
        near = listed.join(counts.filter(f"k <= {short_list}"), "key")
        left = near.filter("failed").select("key", "x", "n").join(near.select("key", F.col("x").alias("y"), F.col("n").alias("m")), "key")
        links.append(_linked_pairs(scratch, left, prefixes, num, den))
        long = counts.filter(f"k > {short_list}")
        if long.isEmpty():
            break
        if level == levels - 1:
            links += _blockwise(scratch, listed.join(long, "key"), prefixes, num, den, max(short_list, SHORT_LIST))
            break
        entries = scratch.keep(listed.join(long.select("key"), "key").select("key", "x", "n", "alone", F.lit(0).alias("band")), "entries")

    edges = links[0]
    for more in links[1:]:
        edges = edges.union(more)
    return table, edges
