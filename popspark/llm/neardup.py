"""Near-duplicate documents: MinHash, banding, verification, connected components.

1. ``_sketch``: each text becomes its set of shingle hashes, of which many universal hashes give
   their minima.  Rows of equal sets are one *class*, known by its smallest document id.
2. Bands of minima give bucket keys.  The chance that two sets of similarity s share no bucket is
   (1 - s**ROWS)**BANDS, 6e-8 at s = 0.8.
3. In each bucket the class with most company over all its buckets is the pivot (a central copy of
   its group), and every other class is a candidate with it: a row for each member, not for each
   pair.
4. Candidates are verified by their signatures first (a margin of five standard deviations below
   the threshold), then on the full sets.
5. Large-star and small-star give components.  Buckets that still hold classes of several
   components hold pairs that no pivot has settled.  Components with alike signatures in a bucket
   are drawn together, and within each such cluster all classes of different components meet:
   block by block, by signature, then on the full sets.  A component never meets itself.  Only
   links leave a block, one for each two components it joins, and the components are made anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, saved, slices, utf8
from .components import components
from .windows import _powers, mix

SHINGLE = 5
THRESHOLD = 80  # per cent
BANDS, ROWS = 42, 5
BLOCK = 512  # classes of a bucket or cluster that are compared with as many at once, about
HEAVY = 2000  # shingles that weigh as much as a class by itself, so that blocks of long texts have fewer classes
SALTS = 16  # parts in which the rows of one group meet what is known of it
LOADED = 1 << 18  # shingles of a block that are held at once
TEXTS = 4 << 20  # bytes of texts that are compared at once, or one pair
HOT, FEWEST = 1000, 1000  # a key with more than one in HOT of all rows, and FEWEST at least, is dealt out
PART = 20_000  # rows of blocks in a partition, about

_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEGMENT = 1 << 20


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each lower-cased word of each text, one text after the other, and the words of each text."""
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    gap = _GAP[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.r_[0, edge]
    begin, end = edge[::2], edge[1::2]
    out = np.empty(len(begin), np.uint64)
    w = 0
    while w < len(begin):  # segments keep the tables of powers small
        start = begin[w]
        stop = max(w + 1, int(np.searchsorted(end, start + _SEGMENT, "right")))
        n = int(end[stop - 1] - start)
        up, down = _powers(1 << (n - 1).bit_length())
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[start : start + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        b, e = begin[w:stop] - start, end[w:stop] - start
        out[w:stop] = (sums[e] - sums[b]) * down[b]
        w = stop
    ends = np.cumsum([len(x) + 1 for x in texts])
    upto = np.searchsorted(begin, ends, "left")
    return mix(out), np.diff(np.r_[0, upto])


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; of fewer words the whole sequence's."""
    hashes, many = _word_hashes(texts)
    rng = np.random.default_rng(7)
    factors = rng.integers(0, 1 << 63, shingle, np.uint64) * np.uint64(2) + np.uint64(1)
    m = len(hashes) - shingle + 1
    rolled = np.zeros(max(m, 0), np.uint64)
    for k in range(shingle):
        rolled += hashes[k : k + len(rolled)] * factors[k]
    mix(rolled)
    out, at = [], 0
    for n in many.tolist():
        if n >= shingle:
            out.append(np.unique(rolled[at : at + n - shingle + 1]))
        elif n:
            short = (hashes[at : at + n] * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mix(np.array([short])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


class _Minima:
    """Minima of BANDS * ROWS universal hashes a * x + b modulo 2**32."""

    def __init__(self) -> None:
        rng = np.random.default_rng(11)
        n = BANDS * ROWS
        self.a = (rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, n, np.uint32)[:, None]
        self.mix = rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        x = (values >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), np.uint32(0xFFFFFFFF))
        for s in range(0, len(x), 2048):
            part = self.a * x[s : s + 2048]
            part += self.b
            np.minimum(out, part.min(axis=1), out=out)
        return out

    def bands(self, minima: np.ndarray) -> np.ndarray:
        h = (minima.reshape(BANDS, ROWS) * self.mix).sum(axis=1, dtype=np.uint64)
        return mix(h + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


_SKETCH = "doc_id long, n_shingles long, set_key binary, bands array<long>, signature binary"


def _sketch(shingle: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = _Minima()
        for batch in slices(batches, "text", 1 << 20):
            keys, sizes, bands, signatures = [], [], [], []
            for values in shingle_sets(utf8(batch.column(1)), shingle):
                sizes.append(len(values))
                if len(values):
                    m = minima(values)
                    keys.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                    bands.append(minima.bands(m))
                    signatures.append((m & np.uint32(0xFF)).astype(np.uint8).tobytes())
                else:
                    for x in (keys, bands, signatures):
                        x.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "bands", "signature"],
            )

    return sketch


def _least(threshold: int) -> float:
    """Minima that the signatures of linked sets share: five standard deviations below what they share on average."""
    n, s = BANDS * ROWS, threshold / 100
    return n * (s - 5 * (s * (1 - s) / n) ** 0.5)


def _alike(threshold: int):
    """Pairs whose signatures agree as those of similar sets do."""
    n, least = BANDS * ROWS, _least(threshold)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, n) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((a == b).sum(axis=1) >= least))

    return alike


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool = zstandard.ZstdCompressor(level=1)
    for batch in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tool.compress(x) for x in utf8(batch.column(1))], pa.binary())], names=["id", "z"])


def _confirm(shingle: int, threshold: int):
    """Of (u, v, zu, zv) the (u, v) that are linked."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            size = zstandard.frame_content_size
            upto = np.cumsum([size(a.as_py()) + size(b.as_py()) for a, b in zip(batch.column(2), batch.column(3), strict=True)])
            start = stop = 0
            while stop < batch.num_rows:
                start, done = stop, upto[stop - 1] if stop else 0
                stop = min(start + 256, max(start + 1, int(np.searchsorted(upto, done + TEXTS, "right"))))
                part = batch.slice(start, stop - start)
                zu, zv = (part.column(k).to_pylist() for k in (2, 3))
                texts = {z: None for z in zu + zv}
                sets = dict(zip(texts, shingle_sets([tool.decompress(z) for z in texts], shingle), strict=True))
                linked = []
                for a, b in zip(zu, zv, strict=True):
                    x, y = sets[a], sets[b]
                    both = np.sort(np.concatenate([x, y]))
                    common = int((both[1:] == both[:-1]).sum())
                    linked.append(100 * common >= threshold * (len(both) - common))
                yield part.select([0, 1]).filter(pa.array(linked, pa.bool_()))
            texts = sets = zu = zv = None
            released(None)

    return confirm


class _Joined:
    """Components that have been joined: union-find over their roots."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = self.parent[up]
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        """True if the two were apart."""
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Roots, signatures and the rows of the two blocks (the same rows twice, where a block meets itself)."""
    block = table.column("block").to_numpy()
    signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
    return table.column("root").to_numpy(), signature, np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())


def _roots_alike(threshold: int):
    """The components of a bucket's two blocks that have alike members: (u, v), a forest of them."""
    least = _least(threshold)

    def alike(key: tuple, table: pa.Table) -> pa.Table:
        root, signature, left, right = _sides(table)
        joined, out = _Joined(), []
        for i in left:
            other = right[(root[right] != root[i]) & ((signature[right] == signature[i]).sum(axis=1) >= least)]
            out += [(int(root[i]), int(r)) for r in np.unique(root[other]) if joined.join(int(root[i]), int(r))]
        return pa.table({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})

    return alike


def _within(rows: np.ndarray, size: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The rows in parts of ``most`` shingles, one row at least."""
    part = np.cumsum(size[rows]) // most
    for k in np.unique(part):
        yield rows[part == k]


def _links(shingle: int, threshold: int):
    """Links between members of different components in two blocks of a cluster: one for each two
    components that are joined, (u, v) as their roots.

    Signatures come first: only rows with an alike partner in a component not yet joined with theirs
    have their texts unpacked, and their sets are held in parts of a fixed size.
    """
    least = _least(threshold)

    def links(key: tuple, table: pa.Table) -> pa.Table:
        root, signature, left, right = _sides(table)
        size, packed = table.column("n_shingles").to_numpy(), table.column("z")
        tool = zstandard.ZstdDecompressor()
        close = np.stack([(root[right] != root[i]) & ((signature[right] == signature[i]).sum(axis=1) >= least) for i in left])
        joined, out = _Joined(), []

        def sets(rows: np.ndarray) -> list[np.ndarray]:
            return shingle_sets([tool.decompress(packed[int(i)].as_py()) for i in rows], shingle)

        def apart(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Which of the close pairs of rows i of ``left`` and j of ``right`` are in components not joined so far."""
            a, b = (np.array([joined.find(int(r)) for r in root[x]], np.int64) for x in (left[i], right[j]))
            return close[np.ix_(i, j)] & (a[:, None] != b[None, :])

        for rows in _within(np.flatnonzero(close.any(axis=1)), size[left], LOADED):
            own = None
            for others in _within(np.flatnonzero(close[rows].any(axis=0)), size[right], LOADED):
                open_pairs = apart(rows, others)
                if not open_pairs.any():
                    continue
                own = own or sets(left[rows])
                others, open_pairs = others[open_pairs.any(axis=0)], open_pairs[:, open_pairs.any(axis=0)]
                theirs = sets(right[others])
                values, members = np.unique(np.concatenate(theirs), return_inverse=True)
                many = np.array([len(x) for x in theirs])
                starts, mark = np.cumsum(many) - many, np.zeros(len(values), np.int32)
                for k in np.flatnonzero(open_pairs.any(axis=1)):
                    pairs = apart(rows[k : k + 1], others)[0]
                    if not pairs.any():
                        continue
                    at = np.minimum(np.searchsorted(values, own[k]), len(values) - 1)
                    at = at[values[at] == own[k]]
                    mark[at] = 1
                    common = np.add.reduceat(mark[members], starts)
                    mark[at] = 0
                    linked = pairs & (100 * common >= threshold * (len(own[k]) + many - common))
                    u = int(root[left[rows[k]]])
                    out += [(u, int(v)) for v in np.unique(root[right[others[linked]]]) if joined.join(u, int(v))]
        return pa.table({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})

    return links


def _hot(counted: DataFrame, key: str, many: str) -> DataFrame:
    """(key, parts) of the keys with more than one in HOT of all rows, which are fewer than HOT keys."""
    total = counted.agg(F.sum(many)).first()[0] or 0
    return saved(counted.filter(F.col(many) > max(total / HOT, FEWEST)).select(key, F.ceil(F.col(many) * HOT / total).cast("int").alias("parts")))


def _met(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, by: str) -> DataFrame:
    """``rows`` joined to ``table``, which has one row for each key; the rows of hot keys are dealt out by column ``by``."""
    hot = F.broadcast(hot)
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.join(hot, key, "left").withColumn("part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("parts")
    table = table.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return rows.join(table, [key, "part"]).drop("part")


def _salted(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined to a small ``table`` with one row for each key; the rows of a key are dealt out."""
    parts = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(parts, [*keys, "salt"]).drop("salt")


def _in_blocks(rows: DataFrame, group: str) -> DataFrame:
    """Rows (group, root, rep, weight, ..) for each pair of blocks (lo, hi) in which they meet others.

    A component that fills blocks has some of its own, and its rows meet all blocks but these; the
    others share blocks, which meet all.  So a large component next to a few other classes goes once
    to each block of these, and is never compared with itself.
    """
    sums = saved(rows.groupBy(group, "root").agg(F.sum("weight").alias("weight")))
    large = sums.filter(F.col("weight") > BLOCK).withColumn("own", F.ceil(F.col("weight") / BLOCK))
    small = sums.filter(F.col("weight") <= BLOCK).groupBy(group).agg(F.ceil(F.sum("weight") / BLOCK).alias("shared"))
    # The windows only see components of BLOCK classes and more.
    before = Window.partitionBy(group).orderBy("root").rowsBetween(Window.unboundedPreceding, -1)
    large = large.withColumn("first", F.coalesce(F.sum("own").over(before), F.lit(0))).select(group, "root", "own", "first")
    in_large = large.groupBy(group).agg(F.sum("own").alias("owned"))
    totals = small.join(in_large, group, "full").select(group, F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("owned", F.lit(0)).alias("owned"))
    plan = _salted(sums.withColumn("rep", F.col("root")), totals, [group]).join(large, [group, "root"], "left").select(group, "root", "shared", "owned", "own", "first")
    placed = _salted(rows, plan, [group, "root"])
    h, mine = F.xxhash64("rep"), F.col("shared") + F.col("first")
    placed = placed.withColumn("block", F.when(F.col("own").isNull(), F.pmod(h, "shared")).otherwise(mine + F.pmod(h, "own")))
    met = F.sequence(F.lit(0).cast("long"), F.col("shared") + F.col("owned") - 1)
    met = F.filter(met, lambda b: F.col("own").isNull() | (b < mine) | (b >= mine + F.col("own")))
    placed = placed.withColumn("other", F.explode(met))
    return placed.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "shared", "owned", "own", "first", "weight")


def _dealt(blocks: DataFrame, group: str, *tables: DataFrame) -> DataFrame:
    """The rows of ``_in_blocks`` with what ``tables`` have of them, each pair of blocks in one
    partition, and about PART rows in each."""
    blocks = saved(blocks)
    many = blocks.count() // PART + 8
    for table in tables:
        blocks = blocks.join(table, "rep")
    return blocks.repartition(many, group, "lo", "hi").groupBy(group, "lo", "hi")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Groups of documents that are linked by 100 * |A n B| >= threshold * |A u B|.

    A document's set has its distinct ``shingle``-word shingles, lower-cased (A-Z); with fewer words
    the whole sequence as one; without words it is empty, and linked with nothing.  Returns for
    each row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable over links)
    and kept (the row with that id).  Rows of one id count as one document's; a null id gets a null
    component_id and is kept, as nothing can refer to it.  An empty table gives an empty one.  Other
    columns play no part.  Shingles are told apart by 64-bit hashes.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = saved(texts.mapInArrow(_sketch(shingle), _SKETCH))
    named = sketches.filter("n_shingles > 0 and doc_id is not null")
    classes = saved(named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    hot_sets = _hot(classes, "set_key", "copies")
    own = named.select("set_key", F.col("doc_id").alias("rep"), "n_shingles", "bands", "signature", (1 + F.col("n_shingles") / HEAVY).alias("weight")).join(classes, ["set_key", "rep"], "left_semi").dropDuplicates(["rep", "set_key"])
    own = saved(own.select("rep", "n_shingles", "bands", "signature", "weight"))
    signatures = own.select("rep", "signature")

    # Members of buckets with company.
    rows = own.select("rep", F.explode("bands").alias("bucket"))
    company = saved(rows.groupBy("bucket").agg(F.count("*").alias("many")).filter("many > 1"))
    hot = _hot(company, "bucket", "many")
    members = saved(_met(rows, company, "bucket", hot, "rep"))
    central = members.groupBy("rep").agg(F.sum("many").alias("company"))
    pivots = members.join(central, "rep").groupBy("bucket").agg(F.max(F.struct("company", (-F.col("rep")).alias("rep"))).alias("best"))
    pivots = pivots.select("bucket", (-F.col("best.rep")).alias("pivot"))
    pairs = _met(members, pivots, "bucket", hot, "rep").filter("rep != pivot").select(F.greatest("rep", "pivot").alias("u"), F.least("rep", "pivot").alias("v")).distinct()

    # The texts of all that may be compared, once.
    compressed = texts.filter("doc_id is not null").mapInArrow(_compress, "rep long, z binary")
    held = saved(compressed.join(members.select("rep").distinct(), "rep", "left_semi"))

    def sides(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
        for side in ("u", "v"):
            pairs = pairs.join(table.select(F.col("rep").alias(side), F.col(value).alias(value + side)), side)
        return pairs.select("u", "v", f"{value}u", f"{value}v")

    near = sides(pairs, signatures, "signature").mapInArrow(_alike(threshold), "u long, v long")
    links = saved(sides(saved(near), held, "z").mapInArrow(_confirm(shingle, threshold), "u long, v long"))
    roots = components(links)

    # What no pivot has settled.
    placed = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "many", F.coalesce("root", "rep").alias("root"))
    placed = saved(placed)
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("bucket")
    open_rows = _met(placed, mixed, "bucket", hot, "rep").select("bucket", "rep", "root", F.lit(1.0).alias("weight"))
    open_rows = _dealt(_in_blocks(open_rows, "bucket"), "bucket", signatures)
    alike = saved(open_rows.applyInArrow(_roots_alike(threshold), "u long, v long").distinct())
    if not alike.isEmpty():
        clusters = components(alike).withColumnRenamed("root", "cluster").withColumnRenamed("node", "root")
        clusters = clusters.unionByName(clusters.select(F.col("cluster").alias("root"), "cluster").distinct())
        within = _salted(placed.select("rep", "root").distinct(), clusters, ["root"]).join(own.select("rep", "weight"), "rep")
        within = _dealt(_in_blocks(within, "cluster"), "cluster", own.select("rep", "signature", "n_shingles"), held)
        more = within.applyInArrow(_links(shingle, threshold), "u long, v long")
        roots = components(links.unionByName(more))

    of = classes.join(roots, classes.rep == roots.node, "left").select("set_key", F.coalesce("root", "rep").alias("class_root"))
    ids = _met(named.select("doc_id", "set_key"), of, "set_key", hot_sets, "doc_id").groupBy("doc_id").agg(F.min("class_root").alias("class_root"))
    sizes = sketches.select("doc_id", "n_shingles")
    linked = sizes.filter("doc_id is not null").join(ids, "doc_id", "left")
    linked = linked.unionByName(sizes.filter("doc_id is null").withColumn("class_root", F.lit(None).cast("long")))
    component = F.coalesce("class_root", "doc_id")
    return linked.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
