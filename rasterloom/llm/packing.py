"""Best-fit packing of tokenised documents with Martello-Toth dominance reduction.

The instance is the histogram of piece lengths (at most `capacity` numbers, whatever the corpus size), so the
plan is made on the driver over counts: item sets that provably dominate every alternative for their largest
item are fixed for as many copies as exist, the rest is packed best-fit decreasing, also by counts. Pieces find
their place by rank within their length; ranks come from salted counts, never from one sorted task.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import cut, fresh, small_batches, table, tokenizer_path

CAPACITY = 2048
END_ID = 0
MODEL = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Pieces are ranked within salted lengths: a length gets a salt for every RANKED pieces, or for every 1/RANK_GROUPS of
#: all pieces where that is more. So the driver sees at most capacity + RANK_GROUPS counts, and a hot length, however
#: hot, is spread over as many tasks as its share of all groups.
RANKED, RANK_GROUPS = 1024, 1 << 16
#: The ranks' encoder gives up on white space of a million characters; texts with a run of this length go through the tokenizers file.
LONG_SPACE = 100_000


class ByteTokenizer:
    """Ids of a byte-level BPE `tokenizers` file as bytes (little-endian unsigned 32-bit), without special tokens added.

    `ranks`: a file with the same vocabulary as ranks. Whole texts are then encoded by ranks, several times faster.
    The ids are the same either way: both cut a text by one and the same pattern and then join the pair of lowest
    rank in each part until none is left, which has one outcome, so choosing between them is a choice of library
    only. Two kinds of text go through the tokenizers file always: those that spell a special token, which the
    ranks do not know, and those with a run of white space at which the other library's pattern engine gives up.
    """

    def __init__(self, path: str, ranks: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.spaces = re.compile(r"\s{%d}" % LONG_SPACE)
        self.ordinary = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ordinary = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        if self.ordinary and not any(s in text for s in self.special) and not (len(text) >= LONG_SPACE and self.spaces.search(text)):
            return array("I", self.ordinary(text)).tobytes()
        return array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids and the end id, cut at the capacity.

    Only longer documents are cut; the first piece takes the remainder. A null text counts as empty: its one
    piece is the end id. Whole texts; other columns are not read.
    """
    small_batches(docs.sparkSession)
    ranks = None if path else tokenizer_path(RANKS)
    path = path or tokenizer_path(MODEL)
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = ByteTokenizer(path, ranks).encode
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                at, rows, raws = [], [], []
                part = b.slice(lo, 64)
                for i, text in enumerate(part.column(1).to_pylist()):
                    raw = encode(text or "") + tail
                    n = len(raw) // 4
                    first = n if n <= capacity else n % capacity or capacity
                    start = 0
                    for p, end in enumerate([first, *range(first + capacity, n + 1, capacity)]):
                        chunk = raw[start * 4 : end * 4]
                        at.append(i)
                        rows.append((p, start, end - start, zlib.crc32(chunk)))
                        start = end
                    raws.append(raw)
                cols = np.array(rows, np.int64).reshape(-1, 4).T
                out = [part.column(0).take(pa.array(at, pa.int32())), pa.array(cols[0].astype(np.int32)), *map(pa.array, cols[1:])]
                if with_ids:  # a document's pieces follow one another, so all ids are one buffer
                    out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(cols[2])].astype(np.int32)), pa.array(np.frombuffer(b"".join(raws), "<u4").astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class Lengths:
    """Counts of the lengths still to place, with the distinct ones sorted."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v}
        self.keys = sorted(self.n)

    def take(self, length: int, many: int) -> None:
        self.n[length] -= many
        if not self.n[length]:
            del self.n[length]
            self.keys.pop(bisect_left(self.keys, length))

    def largest(self, room: int) -> int | None:
        i = bisect_right(self.keys, room)
        return self.keys[i - 1] if i else None

    def smallest_two(self, above: int = 0) -> list[int]:
        out: list[int] = []
        for k in self.keys[bisect_right(self.keys, above):][:2]:
            out += [k] * min(2, self.n[k])
        return out[:2]

    def best_pair(self, room: int) -> tuple[int, int, int]:
        """(sum, larger, smaller) of the two items with the greatest sum within room; zeros if none."""
        best, i, j = (0, 0, 0), 0, len(self.keys) - 1
        while i <= j:
            a, b = self.keys[i], self.keys[j]
            if a + b > room or i == j and self.n[a] < 2:
                j -= 1
            else:
                best = max(best, (a + b, b, a))
                i += 1
        return best


def dominating_set(left: Lengths, item: int, capacity: int) -> tuple[int, ...] | None:
    """A set with `item` that dominates every feasible set with it, if one is provable. `item` itself is not in left.

    Nothing fits: alone. A partner fills the bin: the pair. No two more fit: the largest partner. At most two more
    fit and the largest partner is no smaller than the best two together: that pair. At most two more fit, the
    best two include the largest partner, and no two items above the smaller one fit: that triple, since in any
    other set the larger of two partners is at most the one and the smaller at most the other.
    """
    room = capacity - item
    partner = left.largest(room)
    if partner is None:
        return (item,)
    if partner == room:
        return (item, partner)
    least = left.smallest_two()
    if len(least) < 2 or sum(least) > room:
        return (item, partner)
    i = left.keys[0]
    third = i * min(3, left.n[i])
    count = min(3, left.n[i])
    for k in left.keys[1:3]:
        more = min(3 - count, left.n[k])
        third, count = third + more * k, count + more
    if count == 3 and third <= room:
        return None
    total, a, b = left.best_pair(room)
    if partner >= total:
        return (item, partner)
    above = left.smallest_two(b)
    if a == partner and (len(above) < 2 or sum(above) > room):
        return (item, a, b)
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, how many such sequences)] that place every item of counts.

    Placing items only makes fewer sets feasible, so a dominating set stays one while copies of its items last and
    is fixed for all of them at once: the work depends on the distinct lengths, not on how many documents there are.
    """
    left, out = Lengths(counts), []
    for item in sorted(left.n, reverse=True):
        while left.n.get(item):
            left.take(item, 1)
            found = dominating_set(left, item, capacity)
            if found is None:
                left.n[item] = left.n.get(item, 0) + 1
                if left.n[item] == 1:
                    left.keys.insert(bisect_left(left.keys, item), item)
                break
            need: dict[int, int] = defaultdict(int)
            for k in found:
                need[k] += 1
            have = {k: left.n.get(k, 0) + (k == item) for k in need}
            many = min(have[k] // need[k] for k in need)
            for k in need:
                if taken := many * need[k] - (k == item):
                    left.take(k, taken)
            out.append((found, many))
    rooms: dict[int, list[list]] = defaultdict(list)
    for item in sorted(left.n, reverse=True):
        many = left.n[item]
        order = sorted(r for r in rooms if r >= item and rooms[r])
        while many and order:
            room = order.pop(0)
            if not rooms[room]:
                continue
            held, copies = rooms[room].pop()
            fit = room // item
            use = min(copies, many // fit)
            if use:
                rooms[room - fit * item].append([held + (item,) * fit, use])
                many -= use * fit
            if use < copies:
                rest = copies - use
                if 0 < many < fit:
                    rooms[room - many * item].append([held + (item,) * many, 1])
                    many, rest = 0, rest - 1
                if rest:
                    rooms[room].append([held, rest])
            if rooms[room]:
                order.insert(0, room)
            if many and not order:
                break
        if many:
            fit = capacity // item
            if many // fit:
                rooms[capacity - fit * item].append([(item,) * fit, many // fit])
            if many % fit:
                rooms[capacity - (many % fit) * item].append([(item,) * (many % fit), 1])
    out += [(held, copies) for groups in rooms.values() for held, copies in groups]
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for held, copies in out:
        merged[held] += copies
    return list(merged.items())


def runs_of(placed: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted by (length, rank): each run of ranks goes one item
    a sequence to consecutive sequences at the same offset."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for held, copies in placed:
        offset = 0
        for length in held:
            rows.append((length, used[length], sequence, offset))
            used[length] += copies
            offset += length
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, ranked_rows: int = RANKED) -> DataFrame:
    """cut_pieces (a written Parquet table) with sequence_id and offset; every row is placed, sequences hold <= capacity.

    Salts also hash a row's place in its file, so that repeated rows of one id are spread as well. Ids may be null or repeat: each row is a piece of its own. An empty table gives an empty result.
    Further columns stay, but for sequence_id and offset, which are replaced.
    """
    spark = cut_pieces.sparkSession
    sizes = {r["length"]: r["count"] for r in cut_pieces.groupBy("length").count().collect()}
    each = max(ranked_rows, -(-sum(sizes.values()) // RANK_GROUPS))
    salts = F.element_at(F.array(*[F.lit(-(-sizes.get(k, 1) // each)) for k in range(1, capacity + 1)]), F.col("length").cast("int"))
    names = [c for c in cut_pieces.columns if c not in ("sequence_id", "offset")]
    salt_col, rank_col = fresh("salt__", cut_pieces), fresh("rank__", cut_pieces)
    salted = cut_pieces.withColumn(salt_col, F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", "_metadata.row_index"), salts).cast("int"))
    tallies = sorted((r["length"], r[salt_col], r["count"]) for r in salted.groupBy("length", salt_col).count().collect())
    counts: dict[int, int] = defaultdict(int)
    firsts = []
    for length, salt, n in tallies:
        firsts.append((length, salt, counts[length]))
        counts[length] += n
    runs = spark.sparkContext.broadcast(runs_of(plan(counts, capacity)))
    starts = spark.sparkContext.broadcast(np.array(firsts, np.int64).reshape(-1, 3))
    rank = F.row_number().over(Window.partitionBy("length", salt_col).orderBy("doc_id", "piece", "start", "ids_crc32")).cast("long") - 1
    ranked = salted.withColumn(rank_col, rank)

    def run(batches):
        r, s = runs.value, starts.value
        first_key = s[:, 0] * (1 << 20) + s[:, 1]
        span = int(r[:, 1].max(initial=0)) + 1 + int(s[:, 2].max(initial=0))
        run_key = r[:, 0].astype(object) * span + r[:, 1] if span > 1 << 50 else r[:, 0] * span + r[:, 1]
        for b in batches:
            length, salt, at = (np.asarray(b.column(b.schema.get_field_index(c))).astype(np.int64) for c in ("length", salt_col, rank_col))
            at = at + s[np.searchsorted(first_key, length * (1 << 20) + salt), 2]
            i = np.searchsorted(run_key, length * span + at, side="right") - 1
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in names] + [pa.array(r[i, 2] + at - r[i, 1]), pa.array(r[i, 3])], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema if f.name in names) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack docs; with_ids also returns each piece's token ids."""
    return pack(cut(pieces(docs, id_col, text_col, path, capacity, end_id, with_ids), "pieces"), capacity)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
