"""MinHash near-duplicates by a multi-index Hamming join.

Every distinct shingle set has a signature of VALUES values of 16 bits, one minimum
per hash function. Its distance to another is the number of values that differ.
The signature is split into CHUNKS chunks of WIDTH values. Of two signatures at
most CHUNKS * (ERRORS + 1) - 1 apart, some chunk differs in at most ERRORS
values (pigeonhole); so a chunk is entered under every choice of ERRORS values
left out, and those two meet under a common key, always. Keys are exact (chunk,
left-out value, the values that stay), not hashed.

Under a key, signatures (4 bits of each value travel along; they are never
further apart than the whole values) within the threshold are joined to trees
rather than all pairs; a key of many sets is dealt out as block pairs. The
components of these links, *clusters*, hold every link the threshold allows.

Inside the clusters links are confirmed on full shingle sets. A cluster is cut
into blocks that a task compares; from each component found, one set goes to
the next round, until a cluster has one component or its representatives fit in
one block. Where several components are left and the cluster had several
blocks, all sets outside the largest component are compared with all others.

Two sets of similarity 0.8 differ in each value with probability 0.2, so in more
than the 23 values of the threshold with probability 2e-6 (1e-7 at 0.82).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, runs_of, text_sha, wide_batches, written
from .components import components

SHINGLE = 4               # words
PERCENT = 80              # similarity of linked sets
CHUNKS, WIDTH, ERRORS = 12, 4, 1
VALUES = CHUNKS * WIDTH
THRESHOLD = CHUNKS * (ERRORS + 1) - 1
_KEPT = [keep for keep in combinations(range(WIDTH), WIDTH - ERRORS)]
_SPAN = 4 << 20           # bytes of text hashed at a time
_PAIRWISE = 12            # groups up to this size are compared pair by pair, all at once
_BLOCK = 1 << 13          # signatures of a key that one task compares at a time
_SETS, _SHINGLES = 1024, 4 << 20   # sets of a cluster, and their shingles, that one task compares at a time
_ROWS_AT_ONCE = 4096
_LOW = np.uint64(0x1111111111111111)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_FACTORS = _mixed(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)
_TERMS = _mixed(np.arange(VALUES + 1, 2 * VALUES + 1, dtype=np.uint64))


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct 64-bit shingle hashes of every text, one
    after the other, text i from bounds[i] to bounds[i + 1].

    Words are runs without ASCII white space, A-Z lowered; a text of fewer words
    than ``shingle`` has its whole sequence as one shingle, one without words none.
    """
    cache: dict[bytes, int] = {}
    digest = xxhash.xxh64_intdigest
    parts, counts = [], []
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").lower().split()
        for w in set(words):
            if w not in cache:
                cache[w] = digest(w)
        parts.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
        counts.append(len(words))
    n = np.array(counts, np.int64)
    words = np.concatenate([*parts, np.zeros(shingle, np.uint64)])
    at = np.r_[0, np.cumsum(n)]
    lengths = np.where(n == 0, 0, np.maximum(1, n - shingle + 1))
    doc = np.repeat(np.arange(len(texts)), lengths)
    start = np.repeat(at[:-1] - np.r_[0, np.cumsum(lengths)][:-1], lengths) + np.arange(lengths.sum())
    size = np.minimum(n, shingle)[doc]
    h = size.astype(np.uint64)
    for j in range(shingle):                    # words past a short text's end do not count
        h = np.where(j < size, _mixed(h * _M2 + words[np.minimum(start + j, len(words) - 1)]), h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[first], np.r_[0, np.cumsum(np.bincount(doc[first], minlength=len(texts)))]


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """VALUES minima of 16 bits for every set that is not empty, rows by set; zeros
    for empty ones."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, VALUES), np.uint16)
    if len(full):
        for k in range(VALUES):
            low = np.minimum.reduceat(hashes * _FACTORS[k] + _TERMS[k], bounds[full])
            out[full, k] = (_mixed(low) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


_ROWS = "_row long, _id {id}, _sha string, n long, d1 long, d2 long, sig binary"


def signed(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's number in this table, id, text digest, set size, the set's 128-bit
    digest (d1, d2) and its signature."""
    bounded_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            texts = b.column(1).to_pylist()
            n, d, sig = [], [], []
            for s, e in runs_of(np.array([len(t or "") for t in texts]), _SPAN):
                hashes, bounds = shingle_sets(texts[s:e], shingle)
                raw = hashes.tobytes()
                n += np.diff(bounds).tolist()
                d += [xxhash.xxh128_digest(raw[8 * x:8 * y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                sig += [x.tobytes() for x in signatures(hashes, bounds)]
            halves = np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(texts))), b.column(0), b.column(2), pa.array(n, pa.int64()),
                 pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(sig, pa.binary())],
                names=["_row", "_id", "_sha", "n", "d1", "d2", "sig"])
            row += len(texts)

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"),
                       text_sha(text_col).alias("_sha")).mapInArrow(of, _ROWS.format(id=kind))


def entries(nodes: DataFrame) -> DataFrame:
    """(key, node, s0, s1, s2): each signature under the keys of its chunks, with the
    lowest 4 bits of its values."""
    many = CHUNKS * len(_KEPT)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS_AT_ONCE):
                b = whole.slice(at, _ROWS_AT_ONCE)
                sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, CHUNKS, WIDTH)
                keys = np.empty((len(sig), CHUNKS, len(_KEPT)), np.uint64)
                for c in range(CHUNKS):
                    for m, keep in enumerate(_KEPT):
                        key = np.full(len(sig), c * len(_KEPT) + m, np.uint64)
                        for v in keep:
                            key = (key << np.uint64(16)) | sig[:, c, v].astype(np.uint64)
                        keys[:, c, m] = key
                low = (sig.reshape(-1, 3, 16) & 15).astype(np.uint64) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
                low = np.bitwise_or.reduce(low, axis=2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), many)),
                     *[pa.array(np.repeat(low[:, j], many)) for j in range(3)]], names=["key", "node", "s0", "s1", "s2"])

    return nodes.select("node", "sig").mapInArrow(of, "key long, node long, s0 long, s1 long, s2 long")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of two n x 3 arrays whose 48 values differ in at most THRESHOLD places."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & _LOW).sum(axis=1) <= THRESHOLD


def _tree(node: np.ndarray, sig: np.ndarray) -> tuple[list, list]:
    """Tree links of a large group: what is reached is not compared again."""
    src, dst = [], []
    while len(node):
        todo, node, sig = [(node[0], sig[0])], node[1:], sig[1:]
        while todo and len(node):
            x, s = todo.pop()
            hit = _near(sig, s[None, :])
            if hit.any():
                src.append(np.full(int(hit.sum()), x))
                dst.append(node[hit])
                todo.extend(zip(node[hit], sig[hit]))
                node, sig = node[~hit], sig[~hit]
    return src, dst


def _group_links(key: np.ndarray, node: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[starts, len(key)])
    group, size_at = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes, sizes)
    src, dst = [], []
    i = np.flatnonzero((size_at > 1) & (size_at <= _PAIRWISE))
    for k in range(1, int(size_at[i].max(initial=1))):
        i = i[i + k < len(key)]
        i = i[group[i] == group[i + k]]
        if not len(i):
            break
        hit = i[_near(sig[i], sig[i + k])]
        src.append(node[hit])
        dst.append(node[hit + k])
    for g in np.flatnonzero(sizes > _PAIRWISE):
        s, e = starts[g], starts[g] + sizes[g]
        a, b = _tree(node[s:e], sig[s:e])
        src += a
        dst += b
    if not src:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(src), np.concatenate(dst)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by ``by``, regrouped so that no group is cut; holds one group and a batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cut = 0
        if held:                                # does the held group end in this batch?
            last = [held[-1].column(c)[-1].as_py() for c in by]
            differs = np.zeros(b.num_rows, bool)
            for c, v in zip(by, last):
                differs |= b.column(c).to_numpy(zero_copy_only=False) != v
            if not differs.any():
                held.append(b)
                continue
            cut = int(np.argmax(differs))
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
            held, b = [], b.slice(cut)
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in by]
        change = np.zeros(max(b.num_rows - 1, 0), bool)
        for x in cols:
            change |= x[1:] != x[:-1]
        at = np.flatnonzero(change)
        if len(at):
            n = int(at[-1]) + 1
            yield pa.Table.from_batches([b.slice(0, n)]).combine_chunks()
            b = b.slice(n)
        held = [b]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b): links that join the same components as all pairs of signatures within
    THRESHOLD do. A key of more than _BLOCK sets is dealt out as block pairs."""
    wide_batches(nodes.sparkSession)
    rows, by = entries(nodes), ["key"]
    full = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > _BLOCK)
                   .select("key", F.ceil(F.col("n") / _BLOCK).cast("int").alias("nb")), "minhash-full")
    if not full.isEmpty():
        by = ["key", "block"]
        rows = (rows.join(full, "key", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
                .withColumn("h", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
                .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
                .withColumn("block", (F.least("h", "j") * F.lit(1 << 20) + F.greatest("h", "j")).cast("long")))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, by):
            cols = {c: t[c].to_numpy() for c in t.column_names}
            a, b = _group_links(np.stack([cols[c] for c in by], axis=1), cols["node"],
                                np.stack([cols[c].view(np.uint64) for c in ("s0", "s1", "s2")], axis=1))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return (rows.select(*by, "node", "s0", "s1", "s2").repartition(*by)
            .sortWithinPartitions(*by, "node").mapInArrow(of, "a long, b long").distinct())


def _confirmed(node: np.ndarray, comp: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, percent: int
               ) -> tuple[list[int], list[int], np.ndarray]:
    """Links of similarity ``percent`` or more that, with the components known before
    (``comp``), join all linked sets of one block; and of each its component's
    first node. ``node`` is ascending."""
    _, ids = np.unique(hashes, return_inverse=True)
    mark = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    size = np.diff(bounds)
    src, dst = [], []
    rest = np.ones(len(node), bool)
    root = node.copy()
    for first in range(len(node)):
        if not rest[first]:
            continue
        rest[first] = False
        todo = [first]
        while todo:
            x = todo.pop()
            root[x] = node[first]
            # sizes too different cannot be linked, sets of x's own component need not be
            own = comp == comp[x]
            at = np.flatnonzero(rest & ~own & (100 * size >= percent * size[x]) & (100 * size[x] >= percent * size))
            hit = known = np.flatnonzero(rest & own)
            if len(at):
                mark[ids[bounds[x]:bounds[x + 1]]] = True
                lengths = size[at]
                place = np.repeat(bounds[at] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
                common = np.add.reduceat(mark[ids[place]].astype(np.int64), np.r_[0, np.cumsum(lengths)[:-1]])
                mark[ids[bounds[x]:bounds[x + 1]]] = False
                good = at[100 * common >= percent * (lengths + size[x] - common)]
                src += [int(node[x])] * len(good)
                dst += node[good].tolist()
                hit = np.r_[known, good]
            rest[hit] = False
            todo.extend(hit.tolist())
    return src, dst, root


def _block_results(members: DataFrame, by: list[str], shingle: int, percent: int, linked: bool) -> DataFrame:
    """What each group ``by`` of ``members`` (node, comp, _text) confirms: (a, b),
    linked components known before if ``linked``, else every node that is not the
    first of its component in the group, and that first node."""
    bounded_batches(members.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, by):
            key = np.stack([t[c].to_numpy() for c in by], axis=1)
            cut = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key)]
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                node, at = np.unique(t["node"].to_numpy()[s:e], return_index=True)  # repeated rows once
                if len(node) < 2:
                    continue
                part = t.slice(s, e - s)
                texts = part["_text"].to_pylist()
                hashes, bounds = shingle_sets([texts[i] for i in at.tolist()], shingle)
                a, b, root = _confirmed(node, part["comp"].to_numpy()[at], hashes, bounds, percent)
                if linked:
                    comp = dict(zip(node.tolist(), part["comp"].to_numpy()[at].tolist()))
                    a, b = zip(*{(comp[x], comp[y]) for x, y in zip(a, b)}) if a else ((), ())
                else:
                    a, b = node[root != node], root[root != node]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return (members.select(*by, "node", "comp", "_text").repartition(*by).sortWithinPartitions(*by, "node")
            .mapInArrow(of, "a long, b long"))


def _blocks(members: DataFrame, turn: int) -> DataFrame:
    """``members`` (cluster, ...) with nb, the blocks of their cluster, and block."""
    need = F.greatest(F.ceil(F.count(F.lit(1)) / _SETS), F.ceil(F.sum("n") / _SHINGLES))
    many = written(members.groupBy("cluster").agg(need.cast("int").alias("nb")), "minhash-sizes")
    return members.join(many, "cluster").withColumn("block", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("nb")).cast("int"))


def _recomposed(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` whose comp is in ``found`` (a, b) as a take b for it."""
    found = written(found, "minhash-found")
    return written(members.join(found, F.col("comp") == F.col("a"), "left").withColumn("comp", F.coalesce("b", "comp"))
                   .drop("a", "b"), "minhash-members")


def links(nodes: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(node, comp): the component of every node that has a link confirmed on full sets.

    nodes: (node, sig, n, _sha, _id) of distinct, not empty sets; texts: (_sha, _id,
    _text), where a node's text is found by both.
    """
    found = written(components(candidates(nodes)), "minhash-clusters")         # without the roots themselves
    clusters = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    wanted = written(nodes.join(clusters, "node").select("node", "n", F.col("root").alias("cluster"),
                                                         F.col("_sha").alias("w_sha"), F.col("_id").alias("w_id")),
                     "minhash-wanted")
    blocks = _blocks(wanted, 0).withColumnRenamed("nb", "blocks")
    members = written(texts.join(blocks, (F.col("_sha") == F.col("w_sha")) & F.col("_id").eqNullSafe(F.col("w_id")))
                      .select("cluster", "node", F.col("node").alias("comp"), "n", "blocks", "block", "_text"),
                      "minhash-members")
    if members.count() > wanted.count():            # rows that agree in id and text
        members = written(members.dropDuplicates(["node"]), "minhash-members")
    # a set lies in one block, so a block's components need no more than a name each
    members = _recomposed(members, _block_results(members, ["cluster", "block"], shingle, percent, False))
    small = members.where("blocks = 1").select("node", "comp")
    large = members.where("blocks > 1").drop("block")
    # rounds over one representative of each component, while they shrink
    before, turn = None, 0
    while not large.isEmpty():
        turn += 1
        heads = written(_blocks(large.where("node = comp"), turn), "minhash-heads")
        now, most = heads.agg(F.count(F.lit(1)), F.max("nb")).first()
        large = _recomposed(large, _block_results(heads, ["cluster", "block"], shingle, percent, False))
        if most == 1 or (before is not None and 2 * now > before):
            break
        before = now
    if large.isEmpty():
        return small
    # what the representatives did not settle: all outside the largest component against all
    sizes = written(large.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n")), "minhash-components")
    top = written(sizes.groupBy("cluster").agg(F.max(F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"))
                  .select("cluster", F.col("top.comp").alias("top"), "comps"), "minhash-top").where("comps > 1")
    open_ = written(_blocks(large.join(top, "cluster"), turn + 1), "minhash-open")
    outside = written(open_.where("comp <> top").select("cluster", F.col("block").alias("i")).distinct(), "minhash-outside")
    pairs = (open_.join(outside.groupBy("cluster").agg(F.collect_set("i").alias("outside")), "cluster")
             # a block meets every block that has sets outside the largest component
             .withColumn("i", F.explode(F.expr("CASE WHEN array_contains(outside, block) "
                                               "THEN sequence(0, nb - 1) ELSE outside END")))
             .withColumn("lo", F.least("i", "block")).withColumn("hi", F.greatest("i", "block")))
    more = written(_block_results(pairs, ["cluster", "lo", "hi"], shingle, percent, True), "minhash-more")
    if not more.isEmpty():
        joined = components(more).select(F.col("node").alias("a"), F.col("root").alias("b"))
        large = _recomposed(large, joined)
    return small.unionByName(large.select("node", "comp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Rows are linked if 100 * |both sets| >= ``percent`` * |either set|; component_id
    is the smallest id reachable, kept tells whether that is the row's own. Null
    and empty texts, and texts of white space only, have no shingles and no links.
    A component without any id has a null component_id and all its rows are
    kept; repeated rows come out each; other columns are not read; no rows give
    no rows.
    """
    rows = written(signed(docs, shingle, id_col, text_col), "minhash-rows")
    full = rows.where("n > 0")
    first = full.groupBy("d1", "d2").agg(F.min("_row").alias("node"), F.min("_id").alias("low"))
    sets = written(first, "minhash-sets")
    nodes = written(full.join(sets.select("node"), F.col("_row") == F.col("node"))
                    .select("node", "sig", "n", "_sha", "_id"), "minhash-nodes")
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"),
                        text_sha(text_col).alias("_sha"))
    found = links(nodes, texts, shingle, percent)
    rooted = written(sets.join(found, "node", "left").select("d1", "d2", "low", F.coalesce("comp", "node").alias("comp")),
                     "minhash-rooted")
    low = written(rooted.groupBy("comp").agg(F.min("low").alias("component_id")), "minhash-low")
    named = written(rooted.join(low, "comp").select("d1", "d2", "component_id"), "minhash-named")
    linked = full.join(named, ["d1", "d2"]).select("_id", "n", "component_id")
    alone = rows.where("n = 0").select("_id", "n", F.col("_id").alias("component_id"))
    return (linked.unionByName(alone)
            .select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                    F.col("_id").eqNullSafe(F.col("component_id")).alias("kept")))
