"""N-gram Jaccard join: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from a MinHash LSH forest.  Each of TREES tries holds the texts by DEPTH minhash values; the texts below a node
share a prefix of them.  Two texts at the threshold share a prefix of k values in some of n tries with probability
1 - (1 - 0.8**k)**n, so short prefixes find more and long ones keep nodes small.  All texts begin at the shortest prefix, LEAST.
A node that has more than NODE_TEXTS texts there is split by longer ones, as far as each text's other tries
leave it the target recall: where enough of its nodes are small it may go down to the longest.  So the depth follows the
data, and common templates don't fill a node with half-alike texts.

In a node, a text is compared (by its signature) with the node's leaders only: it becomes a leader itself unless it is near
one, and is linked to every leader that is near enough for the triangle inequality of the Jaccard distance to bring any
two similar texts to a common leader.  So the work in a node of many near copies grows with their number, not with its square, and
no pairs are emitted.  A node that is large still is dealt into chunks that choose their leaders alone; then each
chunk meets all the node's leaders, in blocks of bounded size.

The links' connected components are the candidate clusters.  All pairs in a cluster are verified exactly, but for those whose
sizes exclude it: a set goes to the group of its size and to the next smaller one, and large groups are cut into blocks.  Exact
copies are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut, ship
from plumbline.llm.bytewords import Batch, in_slices, mix, shingles
from plumbline.llm.components import components
from plumbline.llm.texts import free_name

SHINGLE_WORDS = 5
THRESHOLD = 0.8
TREES, LEAST, DEPTH = 24, 4, 8
TARGET_RECALL = 0.999
#: Texts of a node, or of a chunk of one, that are compared in one task.
NODE_TEXTS = 2000
#: Estimated similarity from which a text needs no leader of its own, and from which it is linked to a
#: leader: lower by the join's distance and by three standard errors of the estimate.
COVERED, LINKED = 0.75, 0.44
#: Texts, and shingles, of a block in the verification.
BLOCK_TEXTS, BLOCK_SHINGLES = 2000, 1_000_000
#: Sizes of sets are grouped by powers of this; more than 1 / THRESHOLD, so that a pair's groups are equal or next to each other.
SIZE_STEP = 1.26
#: Columns of the incidence matrix that are multiplied at once.
STRIP = 1024

_MULTIPLIERS = np.random.default_rng(8161).integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def depth_for(heavy: int, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """The longest prefix for a text's nodes in `heavy` tries that leaves it the target recall, with LEAST in the others."""
    others = (1 - threshold**LEAST) ** (TREES - heavy)
    depth = DEPTH
    while depth > LEAST and others * (1 - threshold**depth) ** heavy > 1 - target:
        depth -= 1
    return depth


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, and where each text's begin (one more entry)."""
    batch = Batch(texts)
    begin, end, first = batch.words()
    runs, offset = shingles(batch.word_hashes(begin, end), first, SHINGLE_WORDS)
    owner = np.repeat(np.arange(batch.n), np.diff(offset))
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    runs, owner = runs[new], owner[new]
    return runs, np.searchsorted(owner, np.arange(batch.n + 1))


def signatures(runs: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every text that has shingles (others: zeros): its node in each trie at LEAST, and 8 bits of each of TREES * DEPTH minhash values."""
    n = len(offset) - 1
    nodes, out = np.zeros((n, TREES), dtype=np.uint64), np.zeros((n, TREES * DEPTH), dtype=np.uint8)
    full = np.flatnonzero(np.diff(offset))
    if len(full):
        starts = offset[full]
        for i, m in enumerate(_MULTIPLIERS):
            least = mix(np.minimum.reduceat(runs * m, starts))
            out[full, i] = (least >> np.uint64(32)).astype(np.uint8)
            tree, k = divmod(i, DEPTH)
            if k < LEAST:
                nodes[full, tree] = mix((nodes[full, tree] + np.uint64(tree + 1)) * _ODD + least)
    return nodes, out


def class_ids(runs: np.ndarray, offset: np.ndarray) -> list[bytes | None]:
    """A 128-bit id of each set of shingles (texts without shingles: none)."""
    n = np.diff(offset)
    halves = []
    for salt in (0, 0x5851F42D4C957F2D):
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(runs ^ np.uint64(salt)), dtype=np.uint64)))
        halves.append(mix((total[offset[1:]] - total[offset[:-1]]) ^ mix(n.astype(np.uint64) + np.uint64(salt))))
    ids = np.stack(halves, axis=1)
    return [x.tobytes() if k else None for x, k in zip(ids, n, strict=True)]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, texts in in_slices(batch["text"]):
            runs, offset = shingle_sets(texts)
            ids = class_ids(runs, offset)
            nodes, values = signatures(runs, offset)
            both = np.concatenate((nodes.view(np.uint8).reshape(len(nodes), -1), values), axis=1)
            signs = [s.tobytes() if v else None for s, v in zip(both, ids, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["row"].slice(a, len(texts)), batch["doc_id"].slice(a, len(texts)), pa.array(ids, pa.binary()), pa.array(np.diff(offset).astype(np.int64)), pa.array(signs, pa.binary())],
                ["row", "doc_id", "v", "n", "signature"],
            )


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text and trie: its node at LEAST."""
    for batch in batches:
        for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
            raw = np.frombuffer(b"".join(part["signature"].to_pylist()), dtype=np.uint8).reshape(part.num_rows, TREES * (DEPTH + 8))
            nodes = np.ascontiguousarray(raw[:, : 8 * TREES]).view(np.int64)
            owner = pa.array(np.repeat(np.arange(part.num_rows), TREES))
            yield pa.RecordBatch.from_arrays(
                [part["v"].take(owner), pa.array(np.tile(np.arange(TREES, dtype=np.int32), part.num_rows)), pa.array(nodes.ravel())], ["v", "tree", "node"]
            )


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (v, tree, node, depth, signature) with the node at that depth in place of the one at LEAST."""
    for batch in batches:
        values = np.frombuffer(b"".join(batch["signature"].to_pylist()), dtype=np.uint8).reshape(batch.num_rows, TREES, DEPTH)
        tree, depth = batch["tree"].to_numpy(), batch["depth"].to_numpy()
        node = batch["node"].to_numpy().view(np.uint64)
        for k in range(LEAST, DEPTH):
            value = values[np.arange(len(tree)), tree, k].astype(np.uint64)
            node = np.where(depth > k, mix(node * _ODD + value + np.uint64(1)), node)
        yield pa.RecordBatch.from_arrays([batch["v"], pa.array(node.view(np.int64))], ["v", "node"])


def places(classes: DataFrame) -> DataFrame:
    """(v, node, size): the nodes of more than one text that each text is sought in, and how many texts they have."""
    rows = cut(classes.select("v", "signature").mapInArrow(_nodes, "v binary, tree int, node long"))
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = rows.join(sizes, "node")
    light = met.where(F.col("size") <= NODE_TEXTS).select("v", "node", "size")
    heavy = cut(met.where(F.col("size") > NODE_TEXTS).select("v", "tree", "node"))
    if heavy.isEmpty():
        return light
    depths = F.array(*[F.lit(depth_for(h)) for h in range(TREES + 1)])
    own = heavy.groupBy("v").agg(F.count(F.lit(1)).cast("int").alias("heavy")).select("v", F.get(depths, F.col("heavy")).alias("own"))
    depth = heavy.join(own, "v").groupBy("node").agg(F.min("own").alias("depth"))
    values = classes.select("v", F.substring("signature", 8 * TREES + 1, TREES * DEPTH).alias("signature"))
    deeper = heavy.join(depth, "node").join(values, "v").select("v", "tree", "node", "depth", "signature").mapInArrow(_deeper, "v binary, node long")
    deeper = cut(deeper)
    sizes = deeper.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return light.union(deeper.join(sizes, "node").select("v", "node", "size"))


class _Parts:
    """Leaders that some text has linked are one part from then on, and the next text is linked to each part once: so
    there are no more links than texts, whatever the number of leaders near them."""

    def __init__(self) -> None:
        self.part: list[int] = []

    def root(self, i: int) -> int:
        while self.part[i] != i:
            self.part[i] = self.part[self.part[i]]
            i = self.part[i]
        return i

    def join(self, near: list[int]) -> list[int]:
        """The parts of these leaders, which become one."""
        roots = sorted({self.root(i) for i in near})
        for r in roots[1:]:
            self.part[r] = roots[0]
        return roots


class _Leaders:
    """The leaders of one node, or of one chunk of it, and the links of the texts that come by."""

    def __init__(self) -> None:
        self.ids: list[bytes] = []
        self.parts = _Parts()
        self.signs = np.zeros((8, TREES * DEPTH), dtype=np.uint8)

    def add(self, v: bytes, sign: np.ndarray) -> tuple[list[bytes], bool]:
        """Whom the text is linked to, and whether it has become a leader."""
        n = len(self.ids)
        near = (self.signs[:n] == sign).mean(axis=1) if n else np.zeros(0)
        roots = self.parts.join(np.flatnonzero(near >= LINKED).tolist())
        linked = [self.ids[r] for r in roots]
        leads = not n or bool(near.max() < COVERED)
        if leads:
            if n == len(self.signs):
                self.signs = np.concatenate((self.signs, np.zeros_like(self.signs)))
            self.signs[n] = sign
            self.ids.append(v)
            self.parts.part.append(roots[0] if roots else n)
        return linked, leads


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows (node, chunk, chunks, v, signature) that come sorted by node and chunk; of nodes with several chunks, the leaders as well."""
    at, leaders = None, None
    for batch in batches:
        node, chunk, chunks = batch["node"].to_pylist(), batch["chunk"].to_pylist(), batch["chunks"].to_pylist()
        ids, signs = batch["v"].to_pylist(), batch["signature"].to_pylist()
        out: list[tuple] = []
        for i, v in enumerate(ids):
            if at != (node[i], chunk[i]):
                at, leaders = (node[i], chunk[i]), _Leaders()
            linked, leads = leaders.add(v, np.frombuffer(signs[i], dtype=np.uint8))
            out += [(v, other, None, None, None) for other in linked if other != v]
            if leads and chunks[i] > 1:
                out.append((v, None, node[i], chunks[i], signs[i]))
        a, b, n, c, s = (list(x) for x in zip(*out, strict=True)) if out else ([],) * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64()), pa.array(c, pa.int32()), pa.array(s, pa.binary())], ["a", "b", "node", "chunks", "signature"]
        )


def _link_chunk(key: tuple, texts: pa.Table, leaders: pa.Table) -> pa.Table:
    """Links of the texts of a chunk to a block of its node's leaders."""
    ids, lead = texts["v"].to_pylist(), leaders["v"].to_pylist()
    mine, theirs = (np.frombuffer(b"".join(t["signature"].to_pylist()), dtype=np.uint8).reshape(t.num_rows, TREES * DEPTH) for t in (texts, leaders))
    parts = _Parts()
    parts.part = list(range(len(lead)))
    a, b = [], []
    for i, v in enumerate(ids):
        roots = parts.join(np.flatnonzero((theirs == mine[i]).mean(axis=1) >= LINKED).tolist())
        for r in roots:
            if lead[r] != v:
                a.append(v)
                b.append(lead[r])
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def candidate_links(classes: DataFrame) -> DataFrame:
    """(a, b): links between classes that bring any two similar ones together, directly or over others."""
    chunks = F.ceil(F.col("size") / NODE_TEXTS).cast("int")
    met = places(classes).withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int"))
    values = classes.select("v", F.substring("signature", 8 * TREES + 1, TREES * DEPTH).alias("signature"))
    met = met.join(values, "v").select("node", "chunk", "chunks", "v", "signature")
    found = met.repartition("node", "chunk").sortWithinPartitions("node", "chunk", "v").mapInArrow(_link, "a binary, b binary, node long, chunks int, signature binary")
    found = cut(found)
    edges = found.where("b is not null").select("a", "b")
    leaders = found.where("b is null").select("node", "chunks", F.col("a").alias("v"), "signature")
    if leaders.isEmpty():
        return edges
    blocks = leaders.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / NODE_TEXTS).cast("int").alias("blocks"))
    texts = met.where("chunks > 1").join(blocks, "node").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    leaders = leaders.join(blocks, "node").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    leaders = leaders.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keys = ["node", "chunk", "block"]
    more = texts.select(*keys, "v", "signature").groupBy(*keys).cogroup(leaders.select(*keys, "v", "signature").groupBy(*keys)).applyInArrow(_link_chunk, "a binary, b binary")
    return edges.union(more)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, texts in in_slices(batch["text"]):
            runs, offset = shingle_sets(texts)
            held = [runs[x:y].tobytes() for x, y in zip(offset[:-1], offset[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["v"].slice(a, len(texts)), batch["groups"].slice(a, len(texts)), pa.array(held, pa.binary())], ["v", "groups", "shingles"])


def common_counts(some: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of some sets has in common with each of the others: products of strips of the incidence matrices."""
    owner = np.repeat(np.arange(len(some) + len(others)), [len(s) for s in some + others])
    values = np.concatenate(some + others) if len(owner) else np.zeros(0, dtype=np.uint64)
    column = np.unique(values, return_inverse=True)[1]
    top = int(column.max()) + 1 if len(column) else 0
    left = owner < len(some)
    shared = (np.bincount(column[left], minlength=top) > 0) & (np.bincount(column[~left], minlength=top) > 0)
    keep = shared[column]
    owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(some), len(others)), dtype=np.float32)
    for a in range(0, int(shared.sum()), STRIP):
        x, y = np.searchsorted(column, [a, a + STRIP])
        strip = np.zeros((len(some) + len(others), STRIP), dtype=np.float32)
        strip[owner[x:y], column[x:y] - a] = 1
        out += strip[: len(some)] @ strip[len(some) :].T
    return out


def _verify(key: tuple, group: pa.Table) -> pa.Table:
    """Exact links between the texts of two blocks, or inside one: their number for each text, and a tree of them.

    Two rows of one set can come from repeated documents: the first stands for both.
    """
    low, high = key[2].as_py(), key[3].as_py()
    group = group.sort_by("v")
    ids = group["v"].to_pylist()
    group = group.take(pa.array([i for i, v in enumerate(ids) if not i or ids[i - 1] != v]))
    ids = group["v"].to_pylist()
    block, own = group["block"].to_numpy(), group["own"].to_numpy(zero_copy_only=False)
    sets = [np.frombuffer(s, dtype=np.uint64) for s in group["shingles"].to_pylist()]
    size = np.array([len(s) for s in sets], dtype=np.float64)
    rows, columns = np.flatnonzero(block == low), np.flatnonzero(block == high)
    common = common_counts([sets[i] for i in rows], [sets[i] for i in columns])
    # The threshold as whole numbers: 10 * common >= 8 * union, without rounding.
    linked = (10 + round(10 * THRESHOLD)) * common >= round(10 * THRESHOLD) * (size[rows][:, None] + size[columns][None, :])
    linked &= own[rows][:, None] | own[columns][None, :]
    if low == high:
        np.fill_diagonal(linked, False)
    links = np.bincount(rows, linked.sum(axis=1), len(ids)).astype(np.int64)
    if low != high:
        links += np.bincount(columns, linked.sum(axis=0), len(ids)).astype(np.int64)
    root = np.arange(len(ids))
    while len(rows) and len(columns):
        least = root.copy()
        least[rows] = np.minimum(least[rows], np.where(linked, root[columns][None, :], len(ids)).min(axis=1))
        least[columns] = np.minimum(least[columns], np.where(linked, root[rows][:, None], len(ids)).min(axis=0))
        least = least[least]
        if (least == root).all():
            break
        root = least
    some = np.flatnonzero(links).tolist()
    return pa.table({"v": pa.array([ids[i] for i in some], pa.binary()), "root": pa.array([ids[root[i]] for i in some], pa.binary()), "links": pa.array(links[some])})


def verified_links(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """(v, root, links): exact links in each cluster.  rows: (row, text); clusters: (v, cluster, first_row, n)."""
    clusters = clusters.withColumn("band", F.floor(F.log(SIZE_STEP, F.col("n"))).cast("int"))
    sizes = cut(clusters.groupBy("cluster", "band").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("shingles")))
    larger = sizes.select("cluster", (F.col("band") - 1).alias("band"), F.col("texts").alias("more_texts"), F.col("shingles").alias("more_shingles"))
    texts, total = (F.col(c) + F.coalesce(F.col("more_" + c), F.lit(0)) for c in ("texts", "shingles"))
    blocks = F.greatest(F.ceil(texts / BLOCK_TEXTS), F.ceil(total / BLOCK_SHINGLES)).cast("int")
    groups = sizes.join(larger, ["cluster", "band"], "left").where(texts > 1).select("cluster", F.col("band").alias("group"), blocks.alias("blocks"))
    two = F.array(F.struct(F.col("band").alias("group"), F.lit(True).alias("own")), F.struct((F.col("band") - 1).alias("group"), F.lit(False).alias("own")))
    members = clusters.select("v", "cluster", "first_row", F.explode(two).alias("g")).select("v", "cluster", "first_row", "g.group", "g.own")
    members = members.join(groups, ["cluster", "group"])
    wanted = members.groupBy("v", F.col("first_row").alias("row")).agg(F.collect_list(F.struct("cluster", "group", "own", "blocks")).alias("groups"))
    sets = rows.select("row", "text").join(wanted.hint("shuffle_hash"), "row").select("v", "groups", "text")
    sets = sets.mapInArrow(_sets, "v binary, groups array<struct<cluster:binary,group:int,own:boolean,blocks:int>>, shingles binary")
    sets = sets.select("v", "shingles", F.explode("groups").alias("g")).select("v", "shingles", "g.*")
    sets = sets.withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    keys = ["cluster", "group", "low", "high"]
    return cut(sets.select(*keys, "block", "own", "v", "shingles").groupBy(*keys).applyInArrow(_verify, "v binary, root binary, links long"))


def row_key(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Column:
    """A row's 128-bit key from its id and text: what joins results back; equal for repeated rows."""
    return F.struct(F.xxhash64(docs[doc_id], docs[text]).alias("k1"), F.xxhash64(F.lit(1), docs[doc_id], docs[text]).alias("k2"))


def _classified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, v, class_id, text_class_id, n_copies, n_links, keeper): v is null for texts without words; keeper: the row that stands for its class."""
    ship(docs.sparkSession)
    rows = docs.select(row_key(docs, doc_id, text).alias("row"), docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    key = "row struct<k1:long,k2:long>"
    signed = cut(rows.mapInArrow(_sign, f"{key}, doc_id long, v binary, n long, signature binary"))
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    classes = signed.where(F.col("v").isNotNull()).groupBy("v")
    classes = cut(classes.agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n"), F.first("signature").alias("signature")))
    found = components(candidate_links(classes))
    clusters = found.withColumnRenamed("id", "v").withColumnRenamed("root", "cluster").join(classes.select("v", F.col("place.row").alias("first_row"), "n"), "v")
    verified = verified_links(rows, clusters)
    links = verified.groupBy("v").agg(F.sum("links").alias("n_links"))
    roots = components(verified.select(F.col("v").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "v")
    linked = classes.select("v", "place", "n_copies").join(links, "v", "left").join(roots, "v", "left")
    linked = linked.withColumn("root", F.coalesce("root", "v"))
    least = linked.groupBy("root").agg(F.min("place").alias("class_place"))
    results = linked.join(least, "root").select(
        "v", F.col("class_place.doc_id").alias("class_id"), F.col("place.doc_id").alias("text_class_id"), "n_copies",
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("class_place.row").alias("keeper"),
    )
    return signed.select("row", "doc_id", "v").join(results, "v", "left")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: row (see row_key), doc_id, class_id, text_class_id, n_copies, n_links.

    text_class_id: the least id among documents with the same set of shingles, n_copies of them.
    n_links: how many other sets have a similarity of THRESHOLD or more.  class_id: the least id among all
    documents that such links connect, directly or over others.  A text of one to four words has one shingle, all
    its words.  A text without words, or null, links to nothing: its class is itself.  Documents with a null id
    count as members but never name a class while another member has an id.  Repeated rows are copies;
    an empty table gives no rows; other columns are ignored, whatever their names.
    """
    found = _classified(docs, doc_id, text)
    alone = F.col("v").isNull()
    return found.select(
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("text_class_id")).alias("text_class_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class: the one of least id; where no document of the class has an id, one of them.

    A class is all that links connect, so a document can go that is less than THRESHOLD like the one that stays.
    Documents without words stay.  Of rows that repeat an id and a text one stays, whatever their other columns (any one of them).
    """
    found = _classified(docs, doc_id, text)
    keep = found.select(F.when(F.col("v").isNull(), F.col("row")).otherwise(F.col("keeper")).alias("row")).distinct()
    row = free_name(docs, "row")
    marked = docs.withColumn(row, row_key(docs, doc_id, text))
    joined = marked.join(keep.select(F.col("row").alias(row)).hint("shuffle_hash"), row, "left_semi")
    return joined.dropDuplicates([row]).select(*docs.columns)
