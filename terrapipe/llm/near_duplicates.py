"""N-gram Jaccard self-join of documents: MinHash LSH forest, then exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written
from .components import connected_components

_P = np.uint64(0x9E3779B97F4A7C15)
_BINS = 40  # of the similarities from the threshold to 1


@dataclass(frozen=True)
class Forest:
    """Parameters of the join."""

    words: int = 5  # of a shingle
    threshold: float = 0.8  # Jaccard similarity of a link
    trees: int = 32
    depth: int = 10  # MinHash values in a tree's label: its longest prefix
    target_recall: float = 0.9999
    block: int = 256  # texts of a verification block, on average
    block_bytes: int = 8_000_000  # and the bytes of their shingle hashes
    broadcast_rows: int = 500_000  # narrow candidate rows sent to every task instead of shuffling all texts
    seed: int = 5

    def found(self, depth: int, similarity: float) -> float:
        """Chance that two texts share a prefix of that length in at least one tree."""
        return 1 - (1 - similarity**depth) ** self.trees

    def floor(self) -> int:
        """Where even pairs just at the threshold are found as often as asked: never shorter than this."""
        k = self.depth
        while k > 1 and self.found(k, self.threshold) < self.target_recall:
            k -= 1
        return k

    def recall(self, depth: int, links: dict[int, int]) -> float:
        """Estimated recall at a prefix length, from the links found: counts by similarity bin.

        A link stands for 1 / (its chance of being found) links (Horvitz and Thompson); a bin counts
        with its lower edge. Without any link there is nothing to estimate from: 0.
        """
        width = (1 - self.threshold) / _BINS
        there = sum(n / self.found(depth, self.threshold + k * width) for k, n in links.items())
        return sum(links.values()) / there if there else 0.0


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` words; of all words where there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for j in range(1, n):
            out = (out ^ (out >> np.uint64(31))) * _P + h[j : len(h) - n + 1 + j]
        out = (out ^ (out >> np.uint64(29))) * _P
    return out ^ (out >> np.uint64(32))


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def text_key(words: list[bytes]) -> bytes | None:
    """128-bit digest of the words: texts that differ in white space only have the same key."""
    return hashlib.md5(b" ".join(words), usedforsecurity=False).digest() if words else None


def _signed(batches: Iterator[pa.RecordBatch], how: Forest) -> Iterator[pa.RecordBatch]:
    """(doc_id, tie, key, labels): the labels of all trees, one after another.

    A label is the number of its tree and the low bytes of ``depth`` MinHash values. Unequal values
    have the same byte once in 256 times, which adds candidates and loses none.
    """
    n_hashes = how.trees * how.depth
    rng = np.random.default_rng(how.seed)
    xors = rng.integers(0, 2**32, n_hashes, dtype=np.uint32)
    odds = rng.integers(0, 2**32, n_hashes, dtype=np.uint32) | np.uint32(1)

    def sign(group: list[np.ndarray]) -> np.ndarray:
        x = (np.concatenate(group) >> np.uint64(16)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, group[:-1])])
        least = np.empty((len(group), n_hashes), np.uint32)
        y = np.empty_like(x)
        for j in range(n_hashes):
            np.bitwise_xor(x, xors[j], out=y)
            np.multiply(y, odds[j], out=y)
            least[:, j] = np.minimum.reduceat(y, starts)
        labels = np.empty((len(group), how.trees, how.depth + 1), np.uint8)
        labels[:, :, 0] = np.arange(how.trees)
        labels[:, :, 1:] = (least >> np.uint32(8)).astype(np.uint8).reshape(len(group), how.trees, how.depth)
        return labels

    for batch in batches:
        keys, labels = [], []
        waiting: list[np.ndarray] = []
        filled: list[int] = []

        def flush() -> None:
            if waiting:
                for at, own in zip(filled, sign(waiting), strict=True):
                    labels[at] = own.tobytes()
                waiting.clear()
                filled.clear()

        for text in batch.column("text"):
            words = _words(text.as_py())
            keys.append(text_key(words))
            labels.append(None)
            if words:
                waiting.append(shingle_hashes(words, how.words))
                filled.append(len(keys) - 1)
                if sum(map(len, waiting)) > 60_000:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tie"), pa.array(keys, pa.binary()), pa.array(labels, pa.binary())],
            names=["doc_id", "tie", "key", "labels"],
        )


def _branches(batches: Iterator[pa.RecordBatch], how: Forest) -> Iterator[pa.RecordBatch]:
    """Rows (label, node) in sorted order: those that share a prefix of the least length with a neighbour.

    Adds the longest prefix shared with the row before or after (``deep``), and the first node of
    the run that shares the least prefix (``lead``). Neighbours of the first and last row of a task
    are unknown: these rows count as shared in full, and grouping by prefix settles them later.
    """
    least = how.floor()
    held = None

    def table(labels: np.ndarray, nodes: np.ndarray, lead: np.ndarray, deep: np.ndarray) -> pa.RecordBatch:
        keep = np.flatnonzero(deep >= least)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x.tobytes() for x in labels[keep]], pa.binary()),
                pa.array(nodes[keep]),
                pa.array(lead[keep]),
                pa.array(deep[keep].astype(np.int32)),
            ],
            names=["label", "node", "lead", "deep"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        labels = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.uint8).reshape(-1, how.depth + 1)
        nodes = batch.column("node").to_numpy()
        if held:
            labels, nodes = np.vstack([held[0], labels]), np.r_[held[1], nodes]
        shared = (labels[1:] == labels[:-1]).cumprod(1).sum(1) - 1
        before = np.r_[held[3] if held else how.depth, shared]
        run = np.where(before < least, np.arange(len(nodes)), -1)
        run[0] = -1
        run = np.maximum.accumulate(run)
        lead = np.where(run >= 0, nodes[run], held[2] if held else nodes[0])
        yield table(labels[:-1], nodes[:-1], lead[:-1], np.maximum(before[:-1], shared))
        held = labels[-1:], nodes[-1:], lead[-1], before[-1]
    if held:
        yield table(held[0], held[1], np.array([held[2]]), np.array([how.depth]))


def _sets(batches: Iterator[pa.RecordBatch], how: Forest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(shingle_hashes(_words(x.as_py()), how.words)).tobytes() for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), batch.column("copies"), pa.array(sets, pa.binary())], names=["node", "copies", "shingles"]
        )


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [text_key(_words(x.as_py())) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "key"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersections and unions of ``left`` x ``right`` (or of ``left`` with itself).

    The arrays hold distinct hashes. Intersections are counted by products of 0/1 matrices over
    the hashes that at least two texts hold; the others cannot lie in any intersection.
    """
    all_ = left if right is None else [*left, *right]
    n, m = len(left), len(all_)
    sizes = np.array([len(x) for x in all_])
    rows = np.repeat(np.arange(m), sizes)
    flat = np.concatenate(all_)
    order = np.argsort(flat, kind="stable")
    flat, rows = flat[order], rows[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    rows, column = rows[keep], (np.cumsum(shared) - 1)[column[keep]]
    common = np.zeros((n, m if right is None else m - n), np.float32)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (at, at + width))
        dense = np.zeros((m, width), np.float32)
        dense[rows[a:b], column[a:b] - at] = 1
        common += dense[:n] @ (dense if right is None else dense[n:]).T
    return common, sizes[:n, None] + (sizes if right is None else sizes[n:])[None, :] - common


def links(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``left`` x ``right`` (or of ``left`` with itself) have that similarity, and all similarities."""
    common, total = overlaps(left, right)
    linked = common >= threshold * total - 1e-6
    if right is None:
        np.fill_diagonal(linked, False)
    return linked, common / total


def _roots(linked: np.ndarray, square: bool) -> np.ndarray:
    """Least member of the component of each text of one verification step."""
    n, m = linked.shape
    labels = np.arange(n if square else n + m)
    left, right = (labels, labels) if square else (labels[:n], labels[n:])
    while True:
        before = labels.copy()
        low = np.where(linked, right[None, :], n + m).min(1, initial=n + m)
        np.minimum(left, low, out=left)
        if not square:
            low = np.where(linked, left[:, None], n + m).min(0, initial=n + m)
            np.minimum(right, low, out=right)
        labels[:] = labels[labels]
        if (labels == before).all():
            return labels


def _verified(batches: Iterator[pa.RecordBatch], how: Forest) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (i, j, block): one step for each pair of blocks (i, j).

    Rows out: node, root (least text of its component in the step), links, texts; and for each bin
    of similarity the number of linked pairs, as rows with a ``bin`` and no node.
    """
    names = ("node", "root", "links", "texts", "bin", "pairs")
    out: dict[str, list[int | None]] = {c: [] for c in names}
    step: list[tuple] = []
    now = None

    def finish() -> None:
        i = now[0]
        left = [r for r in step if r[0] == i]
        right = None if now[0] == now[1] else [r for r in step if r[0] != i]
        if not left or right == [] or (right is None and len(left) < 2):
            return
        sets = [[np.frombuffer(r[3], np.uint64) for r in side] for side in (left, right or [])]
        linked, alike = links(sets[0], sets[1] if right else None, how.threshold)
        if not linked.any():
            return
        copies = np.array([r[2] for r in left]), np.array([r[2] for r in right or left])
        roots = _roots(linked, right is None)
        everyone = [*left, *(right or [])]
        texts, weights = linked.sum(1).tolist(), (linked @ copies[1]).tolist()
        if right:
            texts += linked.sum(0).tolist()
            weights += (copies[0] @ linked).tolist()
        for r, root, t, w in zip(everyone, roots, texts, weights, strict=True):
            if t:
                add(r[1], everyone[root][1], w, t, None, None)
        once = linked if right else np.triu(linked)
        bins = ((alike[once] - how.threshold) / (1 - how.threshold) * _BINS + 1e-6).astype(int)
        for k, n in enumerate(np.bincount(np.clip(bins, 0, _BINS - 1)).tolist()):
            if n:
                add(None, None, None, None, k, n)

    def add(*row: int | None) -> None:
        for c, x in zip(names, row, strict=True):
            out[c].append(x)

    def table() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.int64()) for c in names]))
        for x in out.values():
            x.clear()
        return made

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("i", "j", "block", "node", "copies", "shingles")]
        for i, j, *row in zip(*cols, strict=True):
            if now != (i, j):
                if step:
                    finish()
                now, step = (i, j), []
            step.append(tuple(row))
        if len(out["bin"]) > 10_000:
            yield table()
    if step:
        finish()
    yield table()


def near_duplicates(docs: DataFrame, how: Forest | None = None) -> DataFrame:
    """One row per document (doc_id, text): its class of near duplicates and its number of links.

    Two documents are linked when the sets of their five-word shingles have a Jaccard similarity
    of at least ``threshold``; a class is a connected component of links.

    1. Copies (equal words) are folded into one text with a count.
    2. Every text has a label of ``depth`` MinHash values in each tree of the forest. All labels are
       sorted once, by range partitions, so that a hot label is split; comparing neighbours leaves
       the branches of the tries that hold more than one text.
    3. Texts that share branches are laid into blocks of bounded size. From the full labels on, the
       matched prefix is shortened by one value at a time. At each length, the pairs of blocks that
       meet in a branch for the first time are verified exactly on whole shingle sets, one step for
       each pair of blocks. It ends when the recall estimated from the similarities of the links found
       reaches ``target_recall``, at the latest at the length where a pair just at the threshold is
       found as often as that.
    4. Components of the verified links are the classes.

    No row per pair is made, and blocks that share no branch never meet. Within a large group of
    near copies every block meets every other: that work grows with its square, inside the tasks.

    Returns doc_id, class_id (least doc_id of the class), n_links (other documents linked, copies
    included), n_text_links (other texts linked) and copies (documents with these words).
    Defined cases: null texts and texts without words are linked to nothing, each in a class of its
    own; a text of fewer than five words is one shingle; repeated rows are copies; a null doc_id is
    passed over for class_id; an empty table gives no rows; other columns are ignored.
    """
    how = how or Forest()
    rows, texts = _texts(docs, how)
    counted = _counted(docs, texts, how)
    nodes = counted.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("text_links"))
    found = (
        texts.select("key", "node", "first_id", "copies")
        .join(nodes, "node", "left")
        .join(_classes(counted), "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    class_ids = found.groupBy("component").agg(F.min("first_id").alias("class_id"))
    by_key = found.join(class_ids, "component").select(
        F.col("key").alias("key_"),
        "class_id",
        "copies",
        F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("text_links", F.lit(0)).alias("text_links"),
    )
    return rows.join(by_key, F.col("key") == F.col("key_"), "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("text_links", F.lit(0)).alias("n_text_links"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
    )


def _classes(counted: DataFrame) -> DataFrame:
    return connected_components(counted.select(F.col("node").alias("a"), F.col("root").alias("b")), "near-classes")


def _texts(docs: DataFrame, how: Forest) -> tuple[DataFrame, DataFrame]:
    """All rows with their keys, and one row for each distinct text with its labels."""
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = written(
        docs.select("doc_id", "text", F.monotonically_increasing_id().alias("tie")).mapInArrow(
            lambda it: _signed(it, how), f"doc_id {id_type}, tie long, key binary, labels binary"
        ),
        "near-rows",
    )
    texts = written(
        signed.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(
            F.min("tie").alias("node"),
            F.min("doc_id").alias("first_id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("labels").alias("labels"),
        ),
        "near-texts",
    )
    return signed.select("doc_id", "tie", "key"), texts


def _counted(docs: DataFrame, texts: DataFrame, how: Forest) -> DataFrame:
    """(node, root, links, texts) of each verification step: see ``near_duplicates``."""
    width = how.depth + 1
    tree = F.sequence(F.lit(0), F.lit(how.trees - 1))
    branches = written(
        texts.select(
            F.explode(F.transform(tree, lambda t: F.substring("labels", t * width + 1, F.lit(width)))).alias("label"), "node"
        )
        .repartitionByRange("label", "node")
        .sortWithinPartitions("label", "node")
        .mapInArrow(lambda it: _branches(it, how), "label binary, node long, lead long, deep int"),
        "near-branches",
    )
    sets = _laid(docs, texts, branches, how)
    depths = F.sequence(F.lit(how.floor()), F.col("deep"))
    meets = (
        branches.join(sets.select("node", "block"), "node")
        .select("block", "label", F.explode(depths).alias("depth"))
        .groupBy("depth", F.expr("substring(label, 1, depth + 1)").alias("branch"), "block")
        .count()
    )
    # Each pair of blocks with the longest prefix that texts of both share.
    steps = written(
        meets.withColumnsRenamed({"block": "i", "count": "n"})
        .join(meets.withColumnRenamed("block", "j"), ["depth", "branch"])
        .where("i < j or (i = j and n > 1)")
        .groupBy("i", "j")
        .agg(F.max("depth").alias("depth")),
        "near-steps",
    )
    waiting = {r.depth for r in steps.select("depth").distinct().collect()}  # at most ``depth`` numbers
    schema = "node long, root long, links long, texts long, bin long, pairs long"
    verified, links_ = docs.sparkSession.createDataFrame([], schema), {}
    for depth in range(how.depth, how.floor() - 1, -1):
        if depth in waiting:
            texts_of = (
                steps.where(F.col("depth") == depth)
                .select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
                .join(sets, "block")
                .repartition("i", "j")
                .sortWithinPartitions("i", "j", "block", "node")
                .select("i", "j", "block", "node", "copies", "shingles")
            )
            now = written(texts_of.mapInArrow(lambda it: _verified(it, how), schema), "near-links")
            verified = verified.unionByName(now)
            for r in now.where("bin is not null").groupBy("bin").agg(F.sum("pairs").alias("n")).collect():  # 40 bins
                links_[r.bin] = links_.get(r.bin, 0) + r.n
        if how.recall(depth, links_) >= how.target_recall:
            break
    return verified.where("node is not null").select("node", "root", "links", "texts")


def _laid(docs: DataFrame, texts: DataFrame, branches: DataFrame, how: Forest) -> DataFrame:
    """(node, copies, shingles, block) of every text on a shared branch.

    Texts that branches connect go into a block as a whole where they fit, with others that are
    connected to nothing else. Larger groups have blocks of their own, into which those with the
    same least lead go together, or parts of these. Where a text lies decides how many steps it
    takes, never which pairs meet.
    """
    leads = branches.groupBy("node").agg(F.min("lead").alias("lead"))
    joined = connected_components(
        branches.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")), "near-branch-groups"
    )
    members = written(
        texts.select("key", "node", "first_id", "copies")
        .join(leads, "node")
        .join(joined, "node", "left")
        .withColumn("component", F.coalesce("component", "node")),
        "near-members",
    )
    # Each member's text, from the first document that has it.
    known = members.select(F.col("key").alias("member_key"), F.col("first_id").alias("member_id"), "node", "copies")
    if members.count() <= how.broadcast_rows:
        known = F.broadcast(known)
    keyed = docs.select("doc_id", "text").mapInArrow(
        _keyed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, key binary"
    )
    sets = written(
        keyed.join(known, (F.col("key") == F.col("member_key")) & F.col("doc_id").eqNullSafe(F.col("member_id")))
        .select("node", "copies", "text")
        .dropDuplicates(["node"])  # repeated rows
        .mapInArrow(lambda it: _sets(it, how), "node long, copies long, shingles binary"),
        "near-sets",
    )
    load = F.lit(1 / how.block) + F.octet_length("shingles") / how.block_bytes  # in blocks
    sized = sets.select("node", load.alias("load")).join(members.select("node", "component", "lead"), "node")
    n_blocks = int(sized.agg(F.ceil(F.sum("load"))).first()[0] or 1)
    of_component = sized.groupBy("component").agg(F.sum("load").alias("all_load"))
    of_lead = sized.groupBy("component", "lead").agg(F.sum("load").alias("lead_load"))
    part = F.xxhash64("lead", F.when(F.col("lead_load") > 1, F.pmod(F.xxhash64("node"), F.ceil("lead_load"))))
    block = F.when(F.col("all_load") <= 1, F.pmod(F.xxhash64("component"), F.lit(n_blocks))).otherwise(
        F.xxhash64("component", F.pmod(part, F.ceil("all_load")))
    )
    laid = sized.join(of_component, "component").join(of_lead, ["component", "lead"]).select("node", block.alias("block"))
    return written(sets.join(laid, "node"), "near-laid")


def keep_one_of_each(docs: DataFrame, how: Forest | None = None) -> DataFrame:
    """``docs`` with one document of each class: the one whose doc_id is the class_id.

    Of repeated rows, and of documents without a doc_id in a class of their own, one stays.
    Documents without words (null and empty texts) are all kept. All columns are kept as they are,
    whatever their names; an empty table gives no rows.
    """
    how = how or Forest()
    _, texts = _texts(docs, how)
    found = (
        texts.select("key", "node", "first_id")
        .join(_classes(_counted(docs, texts, how)), "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    first = found.groupBy("component").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "node", "key")).alias("best"))
    keep = first.select(F.col("best.first_id").alias("keep_id"), F.col("best.key").alias("keep_key"))
    whole = docs.select(F.struct("*").alias("doc"), "text")
    keyed = whole.mapInArrow(_keyed, T.StructType([*whole.schema.fields, T.StructField("key", T.BinaryType())]))
    kept = (
        keyed.where(F.col("key").isNotNull())
        .join(keep, F.col("key").eqNullSafe(F.col("keep_key")) & F.col("doc.doc_id").eqNullSafe(F.col("keep_id")))
        .dropDuplicates(["key"])
        .select("doc.*")
    )
    return kept.unionByName(keyed.where(F.col("key").isNull()).select("doc.*"))
