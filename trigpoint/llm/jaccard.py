"""N-gram Jaccard join: which documents share at least three quarters of their word shingles.

Method: a document by shingle incidence matrix, multiplied with its transpose in blocks. Sizes bound what
must be multiplied: if |x & y| >= t |x | y|, then x and y share one of the first |x| - ceil(t |x|) + 1
shingles in an order that is the same for all documents, and places in that order bound the overlap further.

1. Every document gets its set of shingle hashes and a class: equal sets, equal class. A first exchange counts
   the shingles that may come into prefixes. The order puts frequent ones last, so a passage that documents
   share seldom lies within a prefix. A table of fixed size holds the levels; if more shingles recur than it
   has room for, only the more frequent ones are in it. The table decides how much is compared, not the result.
2. Prefixes of classes are dealt by hash into blocks of columns. A block yields a spanning forest of the
   classes that may be linked, never their pairs.
3. Connected classes are the groups to be multiplied. A small group is a block of the product. In a large one a shingle
   count over the group comes first: what shares too few shingles with all the others together is linked with
   nothing. Then all are compared with a few pivots, those that share most, which for near copies of one text unites nearly
   all of them at a cost that grows with their number. Blocks are left only between what is not united: tiles of
   the largest united part against tiles of the rest, and tiles of the rest against each other.
4. The blocked product gives exact overlaps; pairs below the bound of their sizes are dropped, the others are united.

Each round of links runs over joins and partial aggregates. Class ids are 64-bit hashes of whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, batch, bits_of, blocks_for, components, find, forest, free_name, lower_words, map_arrow, maybe_in, prepare, shingle_hashes, staged, union

#: Slots of the table of levels (1 byte each), and how many of them may be in use. Both bound the broadcast.
SLOTS, HOT_SLOTS = 1 << 25, 1 << 22
#: Documents that a shingle must be in to be moved back, and the share of a document's shingles that is counted.
RECURS, COUNTED = 3, 0.4
#: Bytes of a hash that blocks are sent; a wrong match costs a comparison and changes nothing.
SENT = 5
#: Shingles of a tile, and entries that a task gathers before it sends them.
TILE, FLUSH = 100_000, 1_500_000
#: Pivots of a large group, and kinds of (size, place) among the classes of a shingle that are told apart; with more, all may be linked.
PIVOTS, KINDS = 8, 2048
#: Documents of a dense tile, and columns of it.
ROWS, COLUMNS = 256, 16_384


def prefix_length(n: int, num: int, den: int) -> int:
    """How many shingles of n can be missed at most, and one more."""
    return n - -(-n * num // den) + 1


def needed(both: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least overlap of two sets with so many elements together."""
    return -(-both * num // (num + den))


def grams(text: str | None, words: WordHash) -> np.ndarray:
    return np.unique(shingle_hashes(words.of(lower_words(text))))


def class_of(g: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(g.tobytes())).view(np.int64))


def packed(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :SENT]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // SENT, 8), np.uint8)
    out[:, :SENT] = np.frombuffer(raw, np.uint8).reshape(-1, SENT)
    return out.view(np.uint64).ravel()


def slots(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SLOTS - 1)).astype(np.int64)


def dealt(key: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of keys that are below 2 ** 24."""
    to = key * buckets >> 24
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        yield int(to[at[0]]), at


_SETS = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("h", pa.binary())])


def _sets(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes = WordHash(), set()
        held: list[np.ndarray] = []
        entries = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                h = np.concatenate(held)
                rows = [(b, None, None, None, None, packed(h[at])) for b, at in dealt(slots(h) * (1 << 24) // SLOTS, buckets)]
                for lo in range(0, len(rows), 64):
                    yield batch(_SETS, *zip(*rows[lo : lo + 64], strict=True))

        for b in batches:
            n, cls = [], []
            for text in b.column(2).to_pylist():
                g = grams(text, words)
                n.append(len(g))
                cls.append(class_of(g) if len(g) else None)
                if len(g) and cls[-1] not in classes:
                    classes.add(cls[-1])
                    held.append(g[: int(COUNTED * len(g)) + 1])
                    entries += len(held[-1])
            yield batch(_SETS, [-1 - k % buckets for k in b.column(1).to_pylist()], b.column(0), b.column(1), n, cls, [None] * len(n))
            if entries >= FLUSH:
                yield from flush()
                held, entries = [], 0
        yield from flush()

    return run


_LEVELS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("level", pa.int32()), ("count", pa.int64()), ("slots", pa.binary())])


def _levels(table: pa.Table) -> pa.Table:
    """Rows of documents as they are; of a block of shingles, the slots of those that recur, by powers of two."""
    if table.num_rows == 0 or table.column("bucket")[0].as_py() < 0:
        none = [None] * table.num_rows
        return pa.Table.from_batches([batch(_LEVELS, *(table.column(c).combine_chunks() for c in ("doc_id", "key", "n", "cls")), none, none, none)])
    h = np.sort(np.concatenate([unpacked(x.as_py()) for x in table.column("h")]))
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    seen = np.diff(np.append(starts, len(h)))
    on = seen >= RECURS
    slot, level = slots(h[starts[on]]).astype(np.int32), np.floor(np.log2(seen[on])).astype(np.int32)
    own = [(int(k), slot[level == k]) for k in np.unique(level)]
    none = [None] * len(own)
    return pa.Table.from_batches([batch(_LEVELS, none, none, none, none, [k for k, _ in own], [len(x) for _, x in own], [x.tobytes() for _, x in own])])


_PARTS = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("at", pa.binary()), ("pos", pa.binary()), ("cls", pa.binary()), ("n", pa.binary())])


def _prefixes(level, buckets: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lev, classes = WordHash(), level.value, set()
        held: list[np.ndarray] = []
        own: list[int] = []
        sizes: list[int] = []
        entries = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            h, at = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.uint32), [len(x) for x in held])
            pos = np.concatenate([np.arange(len(x), dtype=np.int32) for x in held])
            cls, n = np.array(own, np.int64), np.array(sizes, np.int32)
            rows: list[tuple] = []
            for bucket, here in dealt((h >> np.uint64(16)).astype(np.int64) & ((1 << 24) - 1), buckets):
                used, local = np.unique(at[here], return_inverse=True)
                rows.append((bucket, packed(h[here]), local.astype(np.uint32).tobytes(), pos[here].tobytes(), cls[used].tobytes(), n[used].tobytes()))
            for lo in range(0, len(rows), 64):
                yield batch(_PARTS, *zip(*rows[lo : lo + 64], strict=True))

        for b in batches:
            for text in b.column(0).to_pylist():
                g = grams(text, words)
                if not len(g) or (cls := class_of(g)) in classes:
                    continue
                classes.add(cls)
                order = np.argsort(lev[slots(g)], kind="stable")
                held.append(g[order[: prefix_length(len(g), num, den)]])
                own.append(cls)
                sizes.append(len(g))
                entries += len(held[-1])
                if entries >= FLUSH:
                    yield from flush()
                    held, own, sizes, entries = [], [], [], 0
        yield from flush()

    return run


def _stars(h: np.ndarray, cls: np.ndarray, n: np.ndarray, pos: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between classes that share a shingle of both prefixes and whose places allow enough overlap."""
    order = np.lexsort((cls, h))
    h, cls, n, pos = h[order], cls[order], n[order].astype(np.int64), pos[order].astype(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])
    h, cls, n, pos = h[new], cls[new], n[new], pos[new]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(h)))

    def fits(n1, p1, n2, p2):
        return np.minimum(n1 - p1, n2 - p2) >= needed(n1 + n2, num, den)

    two = starts[lengths == 2]
    two = two[fits(n[two], pos[two], n[two + 1], pos[two + 1])]
    a, b = [cls[two]], [cls[two + 1]]
    for lo, m in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
        run = slice(lo, lo + m)
        kinds, kind = np.unique(n[run] << 32 | pos[run], return_inverse=True)
        if len(kinds) <= KINDS:
            kn, kp = kinds >> 32, kinds & 0xFFFFFFFF
            ok = fits(kn[:, None], kp[:, None], kn[None], kp[None])
            parent = list(range(len(kinds)))
            for x in range(len(kinds)):
                for y in np.flatnonzero(ok[x, x + 1 :]).tolist():
                    union(parent, x, x + 1 + y)
            group = np.array([find(parent, x) for x in range(len(kinds))])[kind]
            alone = ~(ok.any(1))[kind]
        else:  # too many kinds for a table: all of them may be linked, which the product then decides
            group, alone = np.zeros(m, np.int64), np.zeros(m, bool)
        members, group = cls[run][~alone], group[~alone]
        order = np.lexsort((members, group))
        members, group = members[order], group[order]
        if len(members):
            first = np.concatenate([[True], group[1:] != group[:-1]])
            centre = members[np.maximum.accumulate(np.where(first, np.arange(len(members)), 0))]
            a.append(centre[~first])
            b.append(members[~first])
    a, b = np.concatenate(a), np.concatenate(b)
    if len(a):
        pairs = np.unique(np.stack([a, b], 1), axis=0)
        a, b = forest(pairs[:, 0], pairs[:, 1])
    return a, b


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _columns(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        h, cls, n, pos = [], [], [], []
        for row in table.to_pylist():
            at = np.frombuffer(row["at"], np.uint32)
            h.append(unpacked(row["h"]))
            cls.append(np.frombuffer(row["cls"], np.int64)[at])
            n.append(np.frombuffer(row["n"], np.int32)[at])
            pos.append(np.frombuffer(row["pos"], np.int32))
        a, b = _stars(*map(np.concatenate, (h, cls, n, pos)), num, den)
        return pa.Table.from_batches([batch(_LINKS, a, b)])

    return run


def linked(sets: list[np.ndarray], num: int, den: int, part: list[int] | None = None, side: list[int] | None = None) -> list[int]:
    """For each set the least place of a set that it is linked with, over any number of links.

    Sets of the same part are united from the start. With sides, only pairs across the two sides are compared.
    """
    parent = list(range(len(sets)))
    first: dict[int, int] = {}
    for i, p in enumerate(part or ()):
        union(parent, first.setdefault(p, i), i)
    own_side = np.zeros(len(sets), np.int64) if side is None else np.array(side, np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    by = np.lexsort((sizes, own_side))
    flat, owner = np.concatenate([sets[i] for i in by]), np.repeat(np.arange(len(by)), sizes[by])
    _, col, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df[col] > 1
    owner, col = owner[shared], col[shared]
    used, col = np.unique(col, return_inverse=True)  # columns of one document can't add to an overlap
    sizes, own_side = sizes[by], own_side[by]
    cut = int(np.searchsorted(own_side, 1))
    tiles = [slice(i, min(i + ROWS, hi)) for lo, hi in ((0, cut), (cut, len(by))) for i in range(lo, hi, ROWS)]

    def dense(t: slice, lo: int) -> np.ndarray:
        at = slice(*np.searchsorted(owner, (t.start, t.stop)))
        o, c = owner[at] - t.start, col[at]
        here = (c >= lo) & (c < lo + COLUMNS)
        out = np.zeros((t.stop - t.start, min(COLUMNS, len(used) - lo)), np.float32)
        out[o[here], c[here] - lo] = 1
        return out

    for i, ti in enumerate(tiles):
        for tj in tiles[i:]:
            if side is not None and own_side[ti.start] == own_side[tj.start]:
                continue
            if sizes[tj.start] * num > sizes[ti.stop - 1] * den or sizes[ti.start] * num > sizes[tj.stop - 1] * den:
                continue  # the sizes alone rule out all pairs
            roots = {find(parent, int(by[x])) for t in (ti, tj) for x in range(t.start, t.stop)}
            if len(roots) == 1:
                continue
            overlap = np.zeros((ti.stop - ti.start, tj.stop - tj.start), np.float32)
            for lo in range(0, len(used), COLUMNS):
                left = dense(ti, lo)
                overlap += left @ (left if ti is tj else dense(tj, lo)).T
            ok = overlap >= needed(sizes[ti, None] + sizes[None, tj], num, den)
            ok &= overlap > 0
            for x, y in zip(*np.nonzero(ok), strict=True):
                if ti is not tj or x < y:
                    union(parent, int(by[ti.start + x]), int(by[tj.start + y]))
    return [find(parent, x) for x in range(len(sets))]


_GRAMS = pa.schema([("cls", pa.int64()), ("comp", pa.int64()), ("n", pa.int64()), ("grams", pa.binary())])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHash()
    for b in batches:
        rows = []
        for cls, comp, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            g = grams(text, words)
            if len(g) and class_of(g) == cls:  # else another row of the same key
                rows.append((cls, comp, len(g), g.tobytes()))
        if rows:
            yield batch(_GRAMS, *zip(*rows, strict=True))


def _groups(table: pa.Table) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """(classes, sets, places in the table) of each group of classes in a block."""
    comp, cls, raw = table.column("comp").to_numpy(), table.column("cls").to_numpy(), table.column("grams")
    order = np.lexsort((cls, comp))
    for rows in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
        yield cls[rows], [np.frombuffer(raw[int(r)].as_py(), np.uint64) for r in rows], rows


def _links(found: list[tuple[np.ndarray, list[int]]]) -> pa.Table:
    """Links of each class to its root, from (classes, places of roots)."""
    a = [np.array([cls[r] for k, r in enumerate(roots) if k != r], np.int64) for cls, roots in found]
    b = [np.array([cls[k] for k, r in enumerate(roots) if k != r], np.int64) for cls, roots in found]
    none = [np.zeros(0, np.int64)]
    return pa.Table.from_batches([batch(_LINKS, np.concatenate(none + a), np.concatenate(none + b))])


def _product(num: int, den: int):
    """Small groups, several in a block."""
    return lambda table: _links([(cls, linked(sets, num, den)) for cls, sets, _ in _groups(table)])


def _tiles_product(num: int, den: int):
    """A tile with itself, or two tiles of a large group."""

    def run(table: pa.Table) -> pa.Table:
        part, tile = table.column("part").to_pylist(), table.column("tile").to_pylist()
        cross = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        least = table.column("i")[0].as_py()
        return _links([(cls, linked(sets, num, den, [part[r] for r in rows], [int(tile[r] != least) for r in rows] if cross else None)) for cls, sets, rows in _groups(table)])

    return run


_PIECES = pa.schema([("comp", pa.int64()), ("bucket", pa.int32()), ("cls", pa.int64()), ("h", pa.binary())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set of a large group, cut by hash into as many buckets as the group has tiles."""
    for b in batches:
        for cls, comp, tiles, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
            g = np.frombuffer(raw, np.uint64)
            rows = [(k, g[at].tobytes()) for k, at in dealt((g >> np.uint64(16)).astype(np.int64) & ((1 << 24) - 1), tiles)]
            yield batch(_PIECES, [comp] * len(rows), [r[0] for r in rows], [cls] * len(rows), [r[1] for r in rows])


_SHARED = pa.schema([("cls", pa.int64()), ("shared", pa.int64()), ("weight", pa.float64())])


def _shared(table: pa.Table) -> pa.Table:
    """Of each class, its shingles that others have too, and how many others have them."""
    own = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("h")]
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    _, inverse, df = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    others = df[inverse] - 1.0
    n = [np.bincount(row, weights=x, minlength=len(own)) for x in (others > 0, others)]
    return pa.Table.from_batches([batch(_SHARED, table.column("cls").combine_chunks(), n[0].astype(np.int64), n[1])])


def _stars_of(num: int, den: int):
    """Links between the pivots of a large group and a part of its classes."""

    def run(table: pa.Table) -> pa.Table:
        found = []
        pivot = table.column("pivot").to_pylist()
        for cls, sets, rows in _groups(table):
            for k in [k for k, r in enumerate(rows) if pivot[r]]:
                own = sets[k]
                roots = list(range(len(sets)))
                for i, g in enumerate(sets):
                    if cls[i] != cls[k] and min(len(g), len(own)) * den >= max(len(g), len(own)) * num:
                        at = np.searchsorted(own, g)
                        both = int((own[np.minimum(at, len(own) - 1)] == g).sum())
                        if both >= needed(np.int64(len(g) + len(own)), num, den):
                            roots[i] = k
                found.append((cls, roots))
        return _links(found)

    return run


def _large_links(sets: DataFrame, tiles: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that connect what is linked within large groups. tiles: (comp, tiles) of these."""
    sets = staged(sets.join(tiles, "comp"), "large")
    pieces = map_arrow(sets.select("cls", "comp", "tiles", "grams"), _pieces, "comp long, bucket int, cls long, h binary")
    shared = pieces.groupBy("comp", "bucket").applyInArrow(_shared, "cls long, shared long, weight double")
    shared = shared.groupBy("cls").agg(F.sum("shared").alias("shared"), F.sum("weight").alias("weight"))
    # two linked sets share at least ceil(n * num / den) of the n of either
    live = staged(sets.select("cls", "comp", "n").join(shared, "cls").where(F.col("shared") * den >= F.col("n") * num).drop("shared"), "live")
    rank = F.struct("weight", "n", "cls")
    pivots = live.groupBy("comp", F.pmod(F.xxhash64("cls"), F.lit(PIVOTS)).alias("k")).agg(F.max_by("cls", rank).alias("cls"))  # PIVOTS a group at most
    sets = staged(sets.join(live.select("cls"), "cls"), "live-sets")
    spread = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile")
    stars = sets.join(pivots.select("cls"), "cls").select("comp", "cls", "grams", F.lit(True).alias("pivot"), spread)
    stars = stars.unionByName(sets.select("comp", "cls", "grams", F.lit(False).alias("pivot"), F.pmod(F.xxhash64("cls", F.lit(1)), F.col("tiles")).cast("int").alias("tile")))
    links = staged(stars.groupBy("comp", "tile").applyInArrow(_stars_of(num, den), "a long, b long"), "stars")

    part = components(links).withColumnRenamed("node", "cls").withColumnRenamed("root", "part")
    part = staged(live.join(part, "cls", "left").select("cls", "comp", "n", F.coalesce("part", "cls").alias("part")), "parts")
    weights = part.groupBy("comp", "part").agg(F.sum("n").alias("n"))
    main = weights.groupBy("comp").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("main_n"), F.sum("n").alias("all_n"))
    count = lambda c: F.ceil(c / F.lit(TILE)).cast("int")
    main = staged(main.select("comp", "main", count(F.col("main_n")).alias("main_tiles"), count(F.col("all_n") - F.col("main_n")).alias("rest_tiles")), "mains")
    own = part.join(main, "comp").where("rest_tiles > 0")
    inside = F.col("part") == F.col("main")
    spread = F.pmod(F.xxhash64("cls", F.lit(2)), F.when(inside, F.col("main_tiles")).otherwise(F.col("rest_tiles"))).cast("int")
    own = own.select("cls", "part", "main_tiles", "rest_tiles", inside.alias("inside"), F.when(inside, F.col("rest_tiles") + spread).otherwise(spread).alias("tile"))
    # the rest comes first: a tile of it meets all tiles, a tile of the main part those of the rest
    meets = F.when(F.col("inside"), F.sequence(F.lit(0), F.col("rest_tiles") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest_tiles") + F.col("main_tiles") - 1))
    cells = sets.select("cls", "comp", "grams").join(own, "cls").select("cls", "comp", "grams", "part", "tile", F.explode(meets).alias("other"))
    cells = cells.select("cls", "comp", "grams", "part", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    return links.unionByName(cells.groupBy("comp", "i", "j").applyInArrow(_tiles_product(num, den), "a long, b long"))


def _text_key(id_col, text_col):
    """Tells rows apart by id and text, nulls included."""
    return F.xxhash64(id_col.cast("long"), F.coalesce(text_col.cast("string"), F.lit("")), id_col.isNull(), text_col.isNull())


def _found(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(key, doc_id, n, root) for every row: a hash of id and text, and the class that stands for the row's component."""
    num, den = percent, 100
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.select("doc_id", _text_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    buckets = blocks_for(docs)
    counted = map_arrow(docs, _sets(buckets), "bucket long, doc_id long, key long, n long, cls long, h binary")
    first = staged(counted.groupBy("bucket").applyInArrow(_levels, "doc_id long, key long, n long, cls long, level int, count long, slots binary"), "sets")
    own = first.where("level is null").select("doc_id", "key", "n", "cls")

    level, room = np.zeros(SLOTS, np.uint8), HOT_SLOTS
    sizes = {r[0]: r[1] for r in first.where("level is not null").groupBy("level").agg(F.sum("count")).collect()}  # a row for each power of two
    kept = []
    for k in sorted(sizes, reverse=True):
        room -= sizes[k]
        if room < 0:
            break
        kept.append(k)
    for k, raw in first.where(F.col("level").isin(kept)).select("level", "slots").toLocalIterator():  # HOT_SLOTS slots at most
        at = np.frombuffer(raw, np.int32)
        level[at] = np.maximum(level[at], k)
    sent = docs.sparkSession.sparkContext.broadcast(level)
    parts = map_arrow(docs.select("text"), _prefixes(sent, buckets, num, den), "bucket int, h binary, at binary, pos binary, cls binary, n binary")
    maybe = components(parts.groupBy("bucket").applyInArrow(_columns(num, den), "a long, b long"))

    # one row for each class that may be linked; only rows whose key has its bit set are shuffled
    kept = own.where("cls IS NOT NULL").groupBy("cls").agg(F.min("key").alias("key"), F.max("n").alias("n"))
    kept = staged(maybe.withColumnRenamed("node", "cls").withColumnRenamed("root", "comp").join(kept, "cls"), "maybe")
    rows = maybe_in(docs, F.col("key"), bits_of(kept, "key"), "maybe").where("maybe").select("key", "text").join(kept, "key")
    sets = staged(map_arrow(rows.select("cls", "comp", "text"), _grams, "cls long, comp long, n long, grams binary"), "grams")
    tiles = staged(kept.groupBy("comp").agg(F.ceil(F.sum("n") / F.lit(TILE)).cast("int").alias("tiles")), "tiles")
    large = tiles.where("tiles > 1")
    blocks = max(buckets, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    small = sets.join(large, "comp", "left_anti").withColumn("block", F.pmod(F.xxhash64("comp"), F.lit(blocks)))
    links = small.groupBy("block").applyInArrow(_product(num, den), "a long, b long")
    if not large.isEmpty():
        links = links.unionByName(_large_links(sets, large, num, den))
    root = components(links).withColumnRenamed("node", "cls")
    return own.join(root, "cls", "left").select("key", "doc_id", "n", F.coalesce("root", "cls").alias("root"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Two rows are linked if 100 * |intersection| >= percent * |union| of their sets of five-word shingles;
    component_id is the least id that links reach, itself included. Null, empty and blank texts have no
    shingles and no links. Fewer than five words are one shingle. Equal texts are linked. Other columns of
    docs are ignored. An empty table gives an empty result. Rows are told apart by id and text: rows with the same id
    are kept, each with its own component; rows without an id link others, and have a null component_id if no row
    with an id is in theirs.
    """
    prepare(docs.sparkSession)
    found = staged(_found(docs, id_col, text_col, percent), "found")
    # classes first, so that many rows of one root are summed before they meet
    least = staged(found.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    out = found.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row of each group of linked rows, with all its columns: that of the least id, of equal ids the one whose text has
    the least hash; rows without an id come after all others.

    Rows without shingles (null, empty and blank texts) are linked with nothing. Of rows with the same id and text, nulls
    included, one stays, whatever their other columns. An empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    found = _found(docs, id_col, text_col, percent).withColumn("root", F.coalesce("root", "key"))
    found = staged(found.groupBy("root", "key", "doc_id").agg(F.count(F.lit(1)).alias("k")), "found")
    # written first, so that a large group's rows can be split when they meet its first one
    first = staged(found.groupBy("root").agg(F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")), "first")
    key, head, name, flag = (free_name(docs.schema, n) for n in ("near_key", "near_first", "row_key", "row_maybe"))
    touched = staged(found.join(first, "root").where("key <> first OR k > 1").select(F.col("key").alias(key), (F.col("key") == F.col("first")).alias(head)), "touched")
    rows = docs.withColumn(name, _text_key(F.col(id_col), F.col(text_col)))
    rows = maybe_in(rows, F.col(name), bits_of(touched, key), flag)
    # rows whose bit isn't set stay where they are; the others are looked up exactly
    looked = rows.where(F.col(flag)).join(touched, F.col(name) == F.col(key), "left")
    once = looked.where(F.col(head)).dropDuplicates([name])
    return rows.where(~F.col(flag)).select(*docs.columns).unionByName(looked.where(F.col(head).isNull()).select(*docs.columns)).unionByName(once.select(*docs.columns))
