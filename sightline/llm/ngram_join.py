"""Self-join of documents on the Jaccard similarity of their word n-grams, exact, without meeting all pairs.

* A document's set: 64-bit hashes of its n-grams.  Equal sets are one representative from here on.
* Two sets that are similar enough share one of their rarest members (how many: by the size and the threshold).  Rarity
  comes from a table of counts of fixed size; any order that is the same for all documents gives whole results, this
  one keeps passages that many documents share out of the lists.
* Representatives that share such a member and are near in size form a tile.  A tile is first joined through one of its
  members at a time, so copies of one text cost one comparison each.  What is still apart afterwards is compared in
  blocks: bitmaps of the sets bound the overlap from above, and sorted arrays are intersected where the bound allows.
  A block keeps track of what it has linked, so it compares no two texts of one component and puts out only the links
  that join components: fewer than it has texts.
* Components are contracted after every round: later rounds see only tiles that are still apart, and only what joins
  the components so far.  Once a round links few of the texts it compares, only large tiles get further rounds, as long as
  they hold many more pairs than there are texts: a round reads all texts again, blocks do not.
* Bitmaps are stored, sorted arrays are made again from the texts that a step has left to intersect.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, field, stored, stored_at
from .components import components

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
COUNTERS = 1 << 16
LEAST_BITS = 512
BLOCK, BLOCK_MEMBERS = 512, 1 << 18
SMALL_TILE = 64
STAR_ROUNDS = 8
LEAST_LINKED = 1 / 16
PAIRS_A_TEXT = 128
FILTER_BITS = 1 << 22
BYTES_AT_ONCE = 1 << 19


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of the base and of its inverse, as far as they were needed."""

    def __init__(self):
        self.of = self.inverse = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.of) < n:
            with np.errstate(over="ignore"):
                self.of = np.cumprod(np.r_[U(1), np.full(n, U(BASE))])
                self.inverse = np.cumprod(np.r_[U(1), np.full(n, U(pow(BASE, -1, 1 << 64)))])
        return self.of, self.inverse


POWERS = _Powers()


def hash_ngrams(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every n-gram of some documents whose UTF-8 bytes lie one after the other.

    Words are runs without ASCII white space, A to Z count as a to z.  Fewer than n words are one n-gram.
    """
    size = len(data)
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < size)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = POWERS.upto(size + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(size + 1, U)
        np.cumsum((low.astype(U) + U(1)) * power[:size], out=sums[1:])
        words = _mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(U) * U(0xD6E8FEB86659FD93))
        doc = np.searchsorted(bounds, start, "right") - 1
        count = np.bincount(doc, minlength=len(bounds) - 1)
        docs, hashes = [], []
        for length in range(1, n + 1):  # documents of just so many words, and those of n or more
            if length < n and not (count == length).any():
                continue
            at = np.arange(len(words) - length + 1)
            at = at[doc[at] == doc[at + length - 1]] if len(at) else at
            if length < n:
                at = at[count[doc[at]] == length]
            h = np.full(len(at), length, U)
            for k in range(length):
                h = _mix(h * U(0xFF51AFD7ED558CCD) + words[at + k])
            docs.append(doc[at])
            hashes.append(h)
    return np.concatenate(docs), np.concatenate(hashes)


def _parts(batches: Iterator[pa.RecordBatch], texts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about BYTES_AT_ONCE of text: (slice, bytes, bounds); null is empty."""
    for batch in batches:
        column = batch.column(texts).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES_AT_ONCE, "right")) - 1)
            end = min(end, len(column))
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def _sets(data, bounds, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, hash), sorted, and the size of each document's set."""
    doc, h = hash_ngrams(data, bounds, n)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    return doc, h, np.bincount(doc, minlength=len(bounds) - 1)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def member_counts(docs: DataFrame, text_col: str, n: int) -> np.ndarray:
    """How many n-grams of all documents fall on each of COUNTERS counters."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for _, data, bounds in _parts(batches, 0):
            h = hash_ngrams(data, bounds, n)[1]
            total += np.bincount((h & U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(COUNTERS)), pa.array(total)], names=["counter", "n"])

    found = docs.select(text_col).mapInArrow(run, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n"))
    total = np.zeros(COUNTERS, np.int64)
    for r in found.collect():  # at most COUNTERS rows
        total[r["counter"]] = r["n"]
    return total


def _rare_members(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(id, n, s1, s2, rare): size and digest of each document's set and the members it is looked up by."""
    schema = T.StructType(
        [
            field(docs, id_col, "id"), T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()),
            T.StructField("s2", T.LongType()), T.StructField("rare", T.ArrayType(T.LongType())),
        ]
    )
    rank = np.argsort(np.argsort(counts, kind="stable"), kind="stable").astype(U)

    def run(batches):
        for part, data, bounds in _parts(batches, 1):
            doc, h, size = _sets(data, bounds, n)
            first = np.zeros(len(size), np.int64)
            np.cumsum(size[:-1], out=first[1:])
            digests = []
            with np.errstate(over="ignore"):
                for seed in (U(1), U(2)):
                    sums = np.zeros(len(h) + 1, U)
                    np.cumsum(_mix(h ^ _mix(seed)), out=sums[1:])
                    digests.append((sums[first + size] - sums[first]).view(np.int64))
            order = np.lexsort((h, rank[(h & U(COUNTERS - 1)).astype(np.int64)], doc))
            wanted = np.where(size > 0, size + (-percent * size // 100) + 1, 0)
            place = np.arange(len(h)) - np.repeat(first, size)
            rare = h[order][place < np.repeat(wanted, size)]
            ids = part.column(0)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(size.astype(np.int64)), *map(pa.array, digests), _lists(rare.view(np.int64), wanted, pa.int64())],
                names=["id", "n", "s1", "s2", "rare"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _filter_words(ids: DataFrame) -> DataFrame:
    """(words): one row, a bit filter over the ids in FILTER_BITS / 64 numbers; what it lets through is joined exactly."""
    spots = ids.select(F.explode(F.array(*_spots("id"))).alias("p"))
    of = spots.select((F.col("p") / 64).cast("bigint").alias("w"), F.expr("shiftleft(1L, int(p % 64))").alias("b"))
    every = ids.sparkSession.range(FILTER_BITS // 64).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b"))
    words = of.union(every).groupBy("w").agg(F.bit_or("b").alias("b"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda s: s["b"]).alias("words"))


def _spots(col: str) -> list:
    return [F.pmod(F.xxhash64(F.lit(seed), F.col(col)), F.lit(FILTER_BITS)) for seed in (11, 12)]


def sifted(df: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the given ids and a few others, and all the rest, before anything of them is shuffled or sent to Python."""
    words = stored(_filter_words(ids), "filter").withColumnRenamed("words", "__words")  # 0.5 MB, however many ids
    spots = {f"__p{i}": spot for i, spot in enumerate(_spots(id_col))}
    inside = " AND ".join(f"shiftright(get(__words, int({p} / 64)), int({p} % 64)) & 1 = 1" for p in spots)
    inside = f"{id_col} IS NOT NULL AND {inside}"
    placed = df.withColumns(spots)
    return tuple(placed.join(F.broadcast(words), F.expr(on)).select(*df.columns) for on in (inside, f"NOT ({inside})"))


def _only(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of the given ids and a few others."""
    return sifted(df, id_col, ids)[0]


def _arrays(docs: DataFrame, id_col: str, text_col: str, n: int, ids: DataFrame, *columns: str) -> DataFrame:
    """(id, n, columns) of each of the given documents (and of a few others): ``members``, the sorted set, ``bits``, its bitmap."""
    kinds = {"members": T.ArrayType(T.LongType()), "bits": T.ArrayType(T.LongType())}
    schema = T.StructType([field(docs, id_col, "id"), T.StructField("n", T.LongType()), *(T.StructField(c, kinds[c]) for c in columns)])

    def bitmaps(doc, h, size):
        widths, maps = _widths(size), [None] * len(size)
        for width in np.unique(widths):
            of = np.flatnonzero(widths == width)
            cells = np.zeros((len(of), width), np.uint8)
            mine = widths[doc] == width
            cells[np.searchsorted(of, doc[mine]), (h[mine] >> U(40)).astype(np.int64) % width] = 1
            for i, m in zip(of, np.packbits(cells, axis=1), strict=True):
                maps[i] = m.view(np.int64)
        return _lists(np.concatenate(maps), widths // 64, pa.int64())

    def run(batches):
        for part, data, bounds in _parts(batches, 1):
            doc, h, size = _sets(data, bounds, n)
            made = [bitmaps(doc, h, size) if c == "bits" else _lists(h.view(np.int64), size, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int64)), *made], names=["id", "n", *columns])

    return _only(docs.select(id_col, text_col), id_col, ids).mapInArrow(run, schema)


POPULATION = np.array([bin(i).count("1") for i in range(256)], np.uint16)


def _widths(size: np.ndarray) -> np.ndarray:
    """Bits of the bitmap of a set: a power of two, twice to four times its size."""
    return np.maximum(LEAST_BITS, 1 << (np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64) + 1))


def _bytes(maps: pa.ChunkedArray) -> list[bytes]:
    return [np.asarray(m.values).tobytes() for m in maps]


def _stack(maps) -> np.ndarray:
    """Bitmaps as rows of one width, wider ones folded: as if they had been made with fewer bits."""
    width = min(map(len, maps))
    out = np.empty((len(maps), width), np.uint8)
    for i, m in enumerate(maps):
        row = np.frombuffer(m, np.uint8)
        while len(row) > width:
            row = row[: len(row) // 2] | row[len(row) // 2 :]
        out[i] = row
    return out


def _overlap_bound(x: np.ndarray, nx, y: np.ndarray, ny) -> np.ndarray:
    """The most members two sets can share: each bit that differs is a member only one of them has."""
    return (nx + ny - POPULATION[x ^ y].sum(-1, dtype=np.int64)) // 2


def _with_both(pairs: DataFrame, arrays: DataFrame, *columns: str) -> DataFrame:
    """The pairs with some columns of either side, named x_ and y_."""
    left = arrays.select(F.col("id").alias("a"), *(F.col(c).alias(f"x_{c}") for c in columns))
    right = arrays.select(F.col("id").alias("b"), *(F.col(c).alias(f"y_{c}") for c in columns))
    return pairs.join(right, "b").join(left, "a")


def possible(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps do not rule out the threshold."""

    width = F.least(F.size("x_bits"), F.size("y_bits"))

    def folded(bits: str) -> Column:
        def cell(i):
            parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(bits) / width).cast("int") - 1), lambda j: F.get(bits, i + j * width))
            return F.aggregate(parts, F.lit(0).cast("bigint"), lambda x, y: x.bitwiseOR(y))

        return F.when(F.size(bits) == width, F.col(bits)).otherwise(F.transform(F.sequence(F.lit(0), width - 1), cell))

    apart = F.zip_with(folded("x_bits"), folded("y_bits"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    both = F.col("x_n") + F.col("y_n")
    bound = F.floor((both - F.aggregate(apart, F.lit(0), lambda x, y: x + y)) / 2)
    return _with_both(pairs, arrays, "n", "bits").where(bound * (100 + percent) >= both * percent).select(*pairs.columns)


def similar(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, by intersection of the arrays."""

    both = F.size(F.array_intersect("x_members", "y_members"))
    united = F.size("x_members") + F.size("y_members") - both
    return _with_both(pairs, arrays, "members").where(100 * both >= percent * united).select(*pairs.columns)


def _near_in_size(x: str, y: str, percent: int):
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def _different(tiles: DataFrame) -> DataFrame:
    """(member, tile, size) of the tiles with more than one text; of tiles that hold the same texts, one.

    Near copies share most of their rare members, so they would meet as often as they are alike.  Tiles are compared by
    their size and 128 bits of hashes.
    """
    of = [F.bit_xor(F.xxhash64(F.lit(seed), "rep")).alias(f"h{seed}") for seed in (1, 2)]
    held = tiles.groupBy("member", "tile").agg(F.count("*").alias("k"), *of).where("k > 1")
    one = held.groupBy("k", "h1", "h2").agg(F.min(F.struct("member", "tile")).alias("of"))
    return one.select("of.member", "of.tile", F.col("k").alias("size"))


def _relabelled(rows: DataFrame, joined: DataFrame, column: str = "comp") -> DataFrame:
    """The rows with the component each of their components has become part of."""
    new = joined.select(F.col("node").alias(column), F.col("comp").alias("__into"))
    return rows.join(new, column, "left").withColumn(column, F.coalesce("__into", column)).select(*rows.columns)


def _in_one(joins: list[DataFrame]) -> DataFrame:
    """(node, comp): what some tables of components, each of the components of the one before, come to as a whole."""
    nodes = reduce(DataFrame.union, [joined.select("node") for joined in joins]).distinct()
    named = nodes.withColumn("comp", F.col("node"))
    for joined in joins:
        named = _relabelled(named, joined)
    return stored(named, "labels")


def _apart(named: DataFrame, *more: Column) -> DataFrame:
    """(member, tile, more aggregates) of the tiles that hold more than one component."""
    of = named.groupBy("member", "tile").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *more)
    return of.where("lo < hi").drop("lo", "hi")


def _pairs_left(tiles: DataFrame) -> int:
    """How many pairs blocks would meet, either way round."""
    return tiles.agg(F.sum("size")).first()[0] or 0


def _star_pairs(tiles: DataFrame, seed: int, percent: int) -> DataFrame:
    """At most one pair (a, b, ca, cb) for each member that is not yet in the component of the centre of one of its tiles.

    Of the centres a member meets it takes the one of least hash, so that a text with copies is compared once a round.
    """
    centres = _apart(tiles, F.min(F.struct(F.xxhash64(F.lit(seed), "rep").alias("h"), "rep", "n", "comp")).alias("c"))
    met = tiles.join(centres, ["member", "tile"]).where(F.col("comp") != F.col("c.comp"))
    met = met.withColumn("m", F.col("c.n")).where(_near_in_size("n", "m", percent))
    best = met.groupBy("rep", "comp").agg(F.min(F.struct("c.h", "c.rep", "c.comp")).alias("c"))
    return best.select(*_ordered("rep", "comp", "c.rep", "c.comp"))  # a centre has the lesser hash, so no pair comes twice


def _ordered(x: str, cx: str, y: str, cy: str) -> list[Column]:
    """(a, b, ca, cb): two texts, the smaller id first, and their components."""
    first = F.col(x) < F.col(y)
    return [
        F.when(first == up, F.col(one)).otherwise(F.col(two)).alias(name)
        for name, up, one, two in (("a", True, x, y), ("b", False, x, y), ("ca", True, cx, cy), ("cb", False, cx, cy))
    ]


def _small_pairs(few: DataFrame, percent: int) -> DataFrame:
    """All other pairs of the small tiles, each once."""
    few = few.select("member", "tile", "rep", "n", "comp")
    other = few.select("member", "tile", *(F.col(c).alias(f"{c}2") for c in ("rep", "n", "comp")))
    met = few.join(other, ["member", "tile"]).where("rep < rep2 AND comp <> comp2").where(_near_in_size("n", "n2", percent))
    return met.select(*_ordered("rep", "comp", "rep2", "comp2")).distinct()


class _Joined:
    """Components of a block, by place, as links join them."""

    def __init__(self, comps: np.ndarray):
        self.of = np.unique(comps, return_inverse=True)[1]

    def join(self, i: int, j: int) -> None:
        self.of[self.of == self.of[j]] = self.of[i]


def block_links(own: np.ndarray, n: np.ndarray, comp: np.ndarray, bits, members: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (component, component) that join what the texts of two blocks, or of one, have apart; fewer than texts.

    ``own`` tells the blocks apart; texts of different blocks are compared, or all where there is one block only.
    """
    maps, joined, found = _stack(bits), _Joined(comp), []
    cut = own != own.min()
    flat, starts = np.concatenate(members), np.cumsum([0, *map(len, members)])
    for i in range(len(n)):
        may = (joined.of != joined.of[i]) & (100 * n >= percent * n[i]) & (100 * n[i] >= percent * n)
        may &= (cut & ~cut[i]) if cut.any() else (np.arange(len(n)) > i)
        at = np.flatnonzero(may)
        if not len(at):
            continue
        bound = _overlap_bound(maps[i], n[i], maps[at], n[at])
        at = at[bound * (100 + percent) >= percent * (n[i] + n[at])]
        for j in at:
            if joined.of[i] == joined.of[j]:
                continue
            x, y = members[i], flat[starts[j] : starts[j + 1]]
            place = np.searchsorted(x, y)
            place[place == len(x)] = 0
            both = int((x[place] == y).sum())
            if 100 * both >= percent * (n[i] + n[j] - both):
                found.append((int(comp[i]), int(comp[j])))
                joined.join(i, int(j))
    return found


def _in_blocks(tiles: DataFrame) -> DataFrame:
    """Rows of tiles dealt to pairs of blocks (x, y): a block meets itself and every other block once."""
    size = tiles.groupBy("member", "tile").agg(F.count("*").alias("size"), F.sum("n").alias("members"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("members") / BLOCK_MEMBERS)).cast("int")
    dealt = tiles.join(size, ["member", "tile"]).withColumn("blocks", blocks)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.select("member", "tile", "rep", "n", "comp", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("with"))
    return dealt.withColumn("x", F.least("own", "with")).withColumn("y", F.greatest("own", "with"))


def block_hopes(own: np.ndarray, n: np.ndarray, comp: np.ndarray, bits, percent: int) -> np.ndarray:
    """Places of the texts whose bitmap allows a link to a text of another component in the block they meet."""
    maps, hope = _stack(bits), np.zeros(len(n), bool)
    cut = own != own.min()
    for i in range(len(n)):
        may = (comp != comp[i]) & (100 * n >= percent * n[i]) & (100 * n[i] >= percent * n)
        may &= (cut & ~cut[i]) if cut.any() else (np.arange(len(n)) > i)
        at = np.flatnonzero(may)
        if len(at):
            at = at[_overlap_bound(maps[i], n[i], maps[at], n[at]) * (100 + percent) >= percent * (n[i] + n[at])]
            hope[at] = True
            hope[i] |= len(at) > 0
    return np.flatnonzero(hope)


def _large_links(many: DataFrame, maps: DataFrame, arrays_of: Callable[[DataFrame], DataFrame], percent: int) -> tuple[DataFrame, str]:
    """(ca, cb): what joins the components of the large tiles, block by block; and the path of a table that it reads.

    First with bitmaps alone, which tells the texts that may have a link at all; only these get their sorted arrays, from
    ``arrays_of`` their ids.
    """
    columns = ["member", "tile", "rep", "n", "comp"]
    kinds = {c: many.schema[c].dataType.simpleString() for c in columns}
    maps = maps.select(F.col("id").alias("rep"), "bits")

    def numbers(rows: pa.Table) -> list[np.ndarray]:
        return [rows[c].to_numpy() for c in ("own", "n", "comp")]

    def hopeful(rows: pa.Table) -> pa.Table:
        return rows.take(pa.array(block_hopes(*numbers(rows), _bytes(rows["bits"]), percent))).select(columns)

    found = _in_blocks(many.select(*columns)).join(maps, "rep").groupBy("member", "tile", "x", "y")
    hopes, path = stored_at(found.applyInArrow(hopeful, ", ".join(f"{c} {k}" for c, k in kinds.items())).distinct(), "tiles")
    sets = arrays_of(hopes.select(F.col("rep").alias("id"))).select("id", "bits", "members")
    dealt = _in_blocks(hopes).join(sets.withColumnRenamed("id", "rep"), "rep")

    def compare(rows: pa.Table) -> pa.Table:
        members = [np.asarray(m.values).view(U) for m in rows["members"]]
        links = block_links(*numbers(rows), _bytes(rows["bits"]), members, percent)
        kind = rows.schema.field("comp").type
        return pa.table({"ca": pa.array([a for a, _ in links], kind), "cb": pa.array([b for _, b in links], kind)})

    return dealt.groupBy("member", "tile", "x", "y").applyInArrow(compare, f"ca {kinds['comp']}, cb {kinds['comp']}"), path


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """(id, n_shingles, component_id) for each row: the size of its set and the smallest id it is linked with.

    Two documents link when 100 * shared >= ``percent`` * united members of their sets of ``words``-grams.  Null and
    empty texts and those without a word have the size 0 and link with nothing.  Rows with a null id have a null
    component.  Repeated rows give repeated results; rows that share an id share links.  An empty table gives an empty
    one; further columns are ignored.  Ids are integers.
    """
    spark = docs.sparkSession
    counts = member_counts(docs, text_col, words)
    wide, wide_path = stored_at(_rare_members(docs, id_col, text_col, words, percent, counts), "sets")
    worded = F.col("id").isNotNull() & (F.col("n") > 0)
    of = F.min("id").alias("rep"), F.min_by("rare", "id").alias("rare")
    reps, reps_path = stored_at(wide.where(worded).groupBy("s1", "s2", "n").agg(*of), "reps")
    sets = stored(wide.select("id", "n", "s1", "s2"), "sets")
    known = sets.where(worded)
    discard(spark, wide_path)
    # both sides of the join read all columns of one exchange, so that the list is shuffled once
    listed = reps.select("rep", "n", F.explode("rare").alias("member")).repartition("member")
    shared = listed.groupBy("member").agg(F.count("rep").alias("k"), F.min("n").alias("least"), F.max("n").alias("most"))
    shared = shared.where((F.col("k") > 2) | (F.col("k") == 2) & _near_in_size("least", "most", percent)).select("member")
    band = F.floor(F.log(F.col("n")) / (1.0001 * math.log(100 / percent))).cast("int") if percent < 100 else F.col("n").cast("int")
    tiles = listed.join(shared, "member").withColumn("tile", F.explode(F.array(band, band + 1)))
    tiles, all_path = stored_at(tiles.select("member", "tile", "rep", "n"), "tiles")
    discard(spark, reps_path)
    live, live_path = stored_at(tiles.join(_different(tiles), ["member", "tile"]).withColumn("comp", F.col("rep")), "tiles")
    discard(spark, all_path)

    def arrays_of(ids: DataFrame, *columns: str) -> DataFrame:
        return _arrays(docs, id_col, text_col, words, ids, *columns)

    maps, maps_path = stored_at(arrays_of(live.select(F.col("rep").alias("id")), "bits"), "maps")
    joins = []

    def verified(pairs: DataFrame, maps: DataFrame) -> tuple[DataFrame, str]:
        near, near_path = stored_at(possible(pairs, maps, percent), "pairs")
        arrays = arrays_of(near.select(F.explode(F.array("a", "b")).alias("id")), "members")
        links, links_path = stored_at(similar(near, arrays, percent).select("ca", "cb").distinct(), "links")
        discard(spark, near_path)
        return links, links_path

    def by_stars(tiles: DataFrame, path: str, maps: DataFrame, seeds: Iterator[int], least: float, enough: int) -> tuple[DataFrame, str]:
        """The tiles still apart after rounds of stars, and their path.

        The last round is one that links fewer than ``least`` of its pairs, or none, or leaves no more than ``enough`` pairs.
        """
        for seed in seeds:
            if _pairs_left(tiles) <= enough:
                break
            pairs, pairs_path = stored_at(_star_pairs(tiles, seed, percent), "stars")
            compared = pairs.count()
            if not compared:
                discard(spark, pairs_path)
                break
            links, links_path = verified(pairs, maps)
            linked = links.count()
            if linked:
                joins.append(components(links, "ca", "cb"))
                named, old = _relabelled(tiles.drop("size"), joins[-1]), path
                tiles, path = stored_at(named.join(_apart(named, F.count("*").alias("size")), ["member", "tile"]), "tiles")
                discard(spark, old)
            discard(spark, pairs_path)
            discard(spark, links_path)
            if linked == 0 or linked < least * compared:
                break
        return tiles, path

    seeds = iter(range(STAR_ROUNDS))
    sized, sized_path = by_stars(live, live_path, maps, seeds, LEAST_LINKED, 0)
    done = len(joins)
    many, many_path = stored_at(sized.where(F.col("size") > SMALL_TILE), "tiles")
    of_many, of_many_path = stored_at(maps.join(many.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "maps")
    many, many_path = by_stars(many, many_path, of_many, seeds, 0, PAIRS_A_TEXT * maps.count())
    few = sized.where(F.col("size") <= SMALL_TILE)
    if joins[done:]:
        few = _relabelled(few, _in_one(joins[done:]))
    few, small_path = stored_at(few.drop("size"), "tiles")
    few, few_path = verified(_small_pairs(few, percent), maps)
    large, large_path = _large_links(many, of_many, lambda ids: arrays_of(ids, "members", "bits"), percent)
    last, last_path = stored_at(few.union(large).distinct(), "links")
    if not last.isEmpty():
        joins.append(components(last, "ca", "cb"))
    for path in (sized_path, many_path, maps_path, of_many_path, small_path, few_path, large_path, last_path):
        discard(spark, path)
    named = known.groupBy("s1", "s2", "n").agg(F.min("id").alias("comp"))
    if joins:
        named = _relabelled(named, _in_one(joins))
    joined = known.select("id", "s1", "s2", "n").join(named, ["s1", "s2", "n"]).select("id", "n", "comp")
    rest = sets.where(F.col("id").isNull() | (F.col("n") == 0)).select("id", "n", F.col("id").alias("comp"))
    return joined.union(rest).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))
