"""Near-duplicate groups by chosen-path set similarity join.

Documents are sets of word shingles. Sets that are equal form a class first. A signature of minwise tokens stands for
each set. Independent trees branch classes by tokens chosen per node: two sets with similarity s choose the same branch
with probability s, and every node has BRANCHES branches, so a pair at the threshold of 0.8 gets down one tree with
probability 0.998 and down one of the TREES with all but 4 in 10^9. Small nodes are compared exhaustively on a byte of
each minwise token, then on parity sketches, which lose no pair at the threshold; what is left is confirmed on the full
sets, made from the whole texts of just those pairs.

Members of a node that is too large to be compared are parted by the sizes of their sets first: similar sets are in one class of sizes or in
neighbours, so this loses no pair and makes two rows of a member at most, where branching makes BRANCHES of it at every level. Only what is still large branches.

A large group of near copies would fill every node of a tree, so large root nodes are worn down before any branching: in
each round every node draws a member as leader, each member of another component is compared with the likeliest of its
nodes' leaders, and links that are confirmed join components. A node takes part as long as its leaders find any. Only pairs of different components are news. A node has as many of them as its
members outside the main component have partners, and becomes a leaf when these are few, however many members it has.
Leaves are compared in blocks, outsiders against all. The recall above holds for pairs that only the trees join; a pair
that leaders or others have joined is in one component already. Nodes that branching doesn't part are compared
exhaustively all the same, which is quadratic in the members outside their main component.

Of a leaf's pairs, the likeliest of each member are confirmed first; then leaves are compared again for all pairs of members that are
still of different components, which loses none and writes out few.

Defined results. Null texts and texts without words have an empty set, are linked with nothing and kept. A text with
fewer words than a shingle has is one shingle. Rows with the same doc_id are linked by their sets like any others, and
with no row for having its doc_id; a row without a doc_id is linked with nothing: its component_id is null and it is
kept. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.rows import row_of
from emberframe.llm.skew import join_groups
from emberframe.llm.tokens import forget, trim
from emberframe.llm.words import shingle_set
from emberframe.session import cut, stored

WORDS = 5  #: of a shingle
SIMILARITY = (80, 100)
SIGNATURE = 64  #: minwise tokens of a set
MATCHES = 30  #: equal tokens of a pair that is confirmed; at the threshold fewer come about once in 10^9
TREES, BRANCHES = 3, 4
SKETCH = 1024  #: bits that tell pairs below the similarity apart from others without losing any
FEW = 1 << 21  #: pairs of members of different components in a node that is compared exhaustively; that costs less than moving it once more
LEADER_PAIRS = 64  #: pairs of a leader that one task confirms, about
DEPTH = 8
BLOCK = 2048  #: members that are compared at once
LEADER_ROUNDS = 8  #: at most
LEADER_SHARE = 0.05  #: of a node's members outside its main component that a leader must be like for a further round there
EDGES_IN_TASK = 1_000_000
FILTER_CELLS = 1 << 20  #: rows of the broadcast filter of ids, whatever the corpus

_MULTIPLIERS = np.random.default_rng(2024).integers(1 << 62, size=SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(found: np.ndarray) -> bytes:
    least = np.full(SIGNATURE, 0xFFFFFFFF, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 2048):
            least = np.minimum(least, ((found[at : at + 2048, None] * _MULTIPLIERS) >> np.uint64(32)).min(axis=0))
    return least.astype("<u4").tobytes()


def sketch(found: np.ndarray) -> bytes:
    """SKETCH bits, each the parity of the members that fall on it. Where two sketches differ a member is in one set alone."""
    parity = np.bincount((found & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def _describe(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            some = batch.slice(at, 1024)
            counts, prints, signatures, marks, sketches = [], [], [], [], []
            for text in some.column(1).to_pylist():
                found = shingle_set(text, n)
                counts.append(len(found))
                prints.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signatures.append(signature(found) if len(found) else None)
                marks.append(signatures[-1][::4] if len(found) else None)
                sketches.append(sketch(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), some.column(3), pa.array(counts, pa.int64()), *(pa.array(x, pa.binary()) for x in (prints, signatures, marks, sketches))], names=["doc_id", "row", "text_key", "n_shingles", "print", "signature", "marks", "sketch"])


def token(coordinate: int | Column) -> Column:
    """The signature's token at this place."""
    return F.substring(F.col("signature"), F.lit(coordinate) * 4 + 1, F.lit(4))


def roots(classes: DataFrame) -> DataFrame:
    """The root nodes of all trees: id, node. Each root branches on BRANCHES places of the signature of its own."""
    nodes = F.array(*[F.xxhash64(F.lit(i), token(i)) for i in range(TREES * BRANCHES)])
    return classes.select("id", F.explode(nodes).alias("node"))


def by_class(members: DataFrame) -> DataFrame:
    """id, nodes: the nodes of each class, at most TREES * BRANCHES of them."""
    return members.groupBy("id").agg(F.collect_list("node").alias("nodes"))


def branches(members: DataFrame, depth: int) -> DataFrame:
    """The children of nodes: members (id, node, component, size, signature) branch on places that the node's own hash chooses."""
    choices = [F.pmod(F.xxhash64("node", F.lit(depth), F.lit(i)), F.lit(SIGNATURE)).cast("int") for i in range(BRANCHES)]
    children = F.array(*[F.xxhash64("node", F.lit(i), c, token(c)) for i, c in enumerate(choices)])
    return members.select("id", F.explode(children).alias("node"), "component", F.col("size").alias("above"))


def by_size(members: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The children of nodes by set size: members (id, node, component, size, n) go to the class of their size and to the one below, where
    the node has members of that one. Sizes of similar sets are at most a class apart, so two of them meet."""
    step = math.log(similarity[1] / similarity[0]) * (1 + 1e-9)  # a little wider, so that no rounding puts them two classes apart
    classed = members.select("id", "node", "component", F.floor(F.log("n") / step).alias("own"))
    classes = classed.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.collect_set("own").alias("classes"))
    total = classes.agg(F.sum("size")).first()[0] or 0
    children = F.transform(F.array_intersect("classes", F.array("own", F.col("own") - 1)), lambda k: F.xxhash64("node", F.lit("size"), k))
    # a child may keep all of its node, where sizes are much the same: that doesn't tell whether branching parts it
    return join_groups(classed, classes, "node", "size", total).select("id", F.explode(children).alias("node"), "component", F.lit(None).cast("long").alias("above"))


def _columns(table: pa.Table | pa.RecordBatch, of: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, marks (the lowest byte of each minwise token) and sketches as arrays."""
    n = table.column("n" + of).to_numpy()
    binary = lambda name, kind: np.frombuffer(b"".join(table.column(name + of).to_pylist()), dtype=kind).reshape(len(n), -1)
    return n, binary("marks", np.uint8), binary("sketch", np.uint64)


def may_link(n: np.ndarray, m: np.ndarray, differ: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Whether sets of n and m members whose sketches differ in so many bits can be similar: those bits are members of one set alone."""
    part, whole = similarity
    return differ * (whole + part) <= (n + m) * (whole - part)


def _best(key: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """The places of the likeliest pair of each key."""
    order = np.lexsort((-alike.astype(np.int64), key))
    return order[np.concatenate([[True], key[order][1:] != key[order][:-1]])] if len(order) else order


def _compare(table: pa.Table, similarity: tuple[int, int], best: bool = False) -> pa.Table:
    """Pairs of one node's members, or of two of its blocks, that may be similar: a is outside the main component, b of another component. best: of each member the likeliest one alone."""
    ids, component, side, outside = (table[c].to_numpy() for c in ("id", "component", "side", "outside"))
    n, marks, sketches = _columns(table)
    left, right = np.flatnonzero((side == 0) | (side == 2) & outside), np.flatnonzero(side != 0)  # 2: on both sides
    of_right = np.ascontiguousarray(marks[right].T)
    a, b, equal = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    for at in range(0, len(left), 64):
        rows = left[at : at + 64]
        alike = np.zeros((len(rows), len(right)), dtype=np.uint8)
        for place in range(SIGNATURE):
            alike += marks[rows, place][:, None] == of_right[place]
        x, y = np.nonzero((alike >= MATCHES) & (component[rows][:, None] != component[right]))
        same, x, y = alike[x, y], rows[x], right[y]
        once = ~outside[y] | (ids[x] < ids[y])  # two outsiders meet twice
        same, x, y = same[once], x[once], y[once]
        for part in range(0, len(x), 65536):
            p, q = x[part : part + 65536], y[part : part + 65536]
            fine = may_link(n[p], n[q], np.bitwise_count(sketches[p] ^ sketches[q]).sum(axis=1, dtype=np.int64), similarity)
            a.append(ids[p[fine]])
            b.append(ids[q[fine]])
            equal.append(same[part : part + 65536][fine])
    a, b, equal = np.concatenate(a), np.concatenate(b), np.concatenate(equal)
    if best:
        some = np.union1d(_best(a, equal), _best(b, equal))
        a, b, equal = a[some], b[some], equal[some]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "alike": pa.array(equal, pa.int32())})


def node_stats(members: DataFrame, turn: int = 0) -> DataFrame:
    """Per node of members (id, node, component, above): size, above, pairs of members of different components, main component and its size, a member as leader."""
    drawn = F.min(F.struct(F.xxhash64("id", "node", F.lit(turn)).alias("chance"), F.col("id"), F.col("component"))).alias("leader")
    per = members.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"), F.max("above").alias("above"), drawn)
    whole = per.groupBy("node").agg(
        F.sum("n").alias("size"), F.max("above").alias("above"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main"), F.min("leader").alias("leader"),
    )
    return whole.select("node", "size", "above", "most", "main", (F.col("size") * F.col("size") - F.col("squares")).alias("pairs"), "leader")


def node_pairs(members: DataFrame, similarity: tuple[int, int], best: bool = False) -> DataFrame:
    """Candidate pairs of nodes: members (id, node, component, main, size, most, n, marks, sketch). A node of more than BLOCK members is compared block by block. best: the likeliest of each member."""
    outside, blocks = F.col("component") != F.col("main"), F.ceil(F.col("size") / BLOCK).cast("int")
    outer = F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int")
    x, y = F.pmod(F.xxhash64("id", F.lit(1)), outer).cast("int"), F.pmod(F.xxhash64("id"), blocks).cast("int")
    meet = lambda i, j, side: F.struct(i.alias("x"), j.alias("y"), F.lit(side).alias("side"))
    right = F.transform(F.sequence(F.lit(0), outer - 1), lambda i: meet(i, y, 1))
    left = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: meet(x, j, 0))
    meets = F.when((blocks == 1) & (outer == 1), F.array(meet(F.lit(0), F.lit(0), 2))).when(outside, F.concat(right, left)).otherwise(right)
    dealt = members.withColumn("meet", F.explode(meets)).select("node", "meet.x", "meet.y", "meet.side", "id", "component", outside.alias("outside"), "n", "marks", "sketch")
    return dealt.groupBy("node", "x", "y").applyInArrow(lambda table: _compare(table, similarity, best), "a long, b long, alike int").distinct()


def _confirm(batches: Iterator[pa.RecordBatch], words: int, part: int, whole: int) -> Iterator[pa.RecordBatch]:
    forget()
    known: tuple[int | None, str, np.ndarray] = (None, "", np.zeros(0, np.uint64))  # a leader's pairs come one after another
    for batch in batches:
        a, b = [], []
        for i in range(batch.num_rows):
            x, y, one, two = (batch.column(c)[i].as_py() for c in range(4))
            if known[0] != x or known[1] != one:
                known = (x, one, shingle_set(one, words))
            p, q = known[2], shingle_set(two, words)
            if len(p) > len(q):
                p, q = q, p
            if whole * len(p) < part * len(q):
                continue
            both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
            if whole * both >= part * (len(p) + len(q) - both):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def texts_of(given: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, text of these classes (id, doc_id, text_key): a broadcast filter of bounded size first, then one of repeated rows, the exact join after it."""
    cells = wanted.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_CELLS)).alias("cell")).distinct()
    likely = given.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_CELLS))).join(F.broadcast(cells), "cell", "left_semi")
    return likely.groupBy("doc_id", "text_key").agg(F.first("text").alias("text")).join(wanted, ["doc_id", "text_key"]).select("id", "text")


def confirmed(pairs: DataFrame, given: DataFrame, keys: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """Those of pairs (a, b) whose full sets reach the similarity. A leader's pairs are dealt to as many tasks as they need."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = cut(keys.select("id", "doc_id", "text_key").join(ids, "id", "left_semi"))
    leaders = cut(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("led"))).withColumn("salts", F.ceil(F.col("led") / LEADER_PAIRS).cast("int"))
    texts = texts_of(given, wanted)
    leading = leaders.join(texts, F.col("a") == F.col("id")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("text").alias("of_a"))
    dealt = join_groups(pairs, leaders, "a", "led", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    both = dealt.join(texts, F.col("b") == F.col("id")).select("a", "salt", "b", "text").join(leading, ["a", "salt"])
    return both.select("a", "b", "of_a", "text").mapInArrow(partial(_confirm, words=words, part=similarity[0], whole=similarity[1]), "a long, b long").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of one task's edges (a, b): each id but the smallest, with the smallest."""
    trim()
    over: dict[int, int] = {}

    def top(x: int) -> int:
        path = []
        while (y := over.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            over[p] = x
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                over[max(a, b)] = min(a, b)
    ids = list(over)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([top(i) for i in ids], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, in_task: int = EDGES_IN_TASK) -> DataFrame:
    """id, component (the smallest id that can be reached) of all ids on edges (a, b).

    Each task first joins what its own edges connect, at most about in_task of them. If there is more than one task,
    rounds follow that hand every id the least label around it, then the label of its label, until nothing changes.
    """
    edges = edges.where("a <> b").select("a", "b")
    tasks = max(1, -(-edges.count() // in_task))
    # one task is asked for as such: a number of partitions by a key may be raised by the session
    stars = cut((edges.coalesce(1) if tasks == 1 else edges.repartition(tasks, "a")).mapInArrow(_joined, "a long, b long"))
    if tasks == 1:
        return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    both = cut(stars.union(stars.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"))
    while True:
        around = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        hop = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        moved = labels.join(around, "id").join(hop, "component").withColumn("least", F.least("component", "near", "further"))
        moved = cut(moved.select("id", F.col("least").alias("component"), (F.col("least") < F.col("component")).alias("changed")))
        labels = moved.drop("changed")
        if moved.where("changed").isEmpty():
            return labels


def classes_of(linked: DataFrame) -> DataFrame:
    """A row per distinct set: id, print, copies, smallest doc_id and the text it has there, n, signature, marks, sketch."""
    best = F.min(F.struct("doc_id", "text_key")).alias("best")
    grouped = cut(linked.groupBy("print").agg(best, F.count(F.lit(1)).alias("copies"), F.min("n_shingles").alias("n"), *(F.min(c).alias(c) for c in ("signature", "marks", "sketch"))))
    salt = 0
    while True:  # a second turn is due when two of the prints' hashes agree, which 10^9 classes have with probability 0.03
        classes = grouped.select(F.xxhash64("print", F.lit(salt)).alias("id"), "print", "copies", "best.doc_id", "best.text_key", "n", "signature", "marks", "sketch")
        if classes.groupBy("id").count().where("count > 1").isEmpty():
            return classes
        salt += 1


def near_groups(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id, kept, row (its number in docs)."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_of(row).alias("row"), F.xxhash64(text_col).alias("text_key"))
    described = stored(given.mapInArrow(partial(_describe, n=words), "doc_id long, row long, text_key long, n_shingles long, print binary, signature binary, marks binary, sketch binary"), "signatures")
    linked = described.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = classes_of(linked)
    labels = _labels(given.drop("row"), classes, words, similarity)
    # the smallest doc_id of each component, then per class, then per row
    total = described.count()
    named = cut(classes.select("id", "print", "copies", "doc_id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    of_class = join_groups(named.select("component", "print", "copies"), least, "component", "classes", total).select("print", "copies", "component_id")
    with_class = join_groups(linked.select("doc_id", "row", "n_shingles", "print"), of_class, "print", "copies", total)
    alone = described.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"))
    result = with_class.select("doc_id", "row", "n_shingles", "component_id").unionByName(alone)
    return result.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "row")


def _labels(given: DataFrame, classes: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """(id, component) of the classes that are linked with another."""
    spark = given.sparkSession
    root = roots(classes)
    shared = root.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    every = classes.count() * TREES * BRANCHES
    in_nodes = cut(by_class(join_groups(root, shared, "node", "size", every)))
    signatures = cut(classes.drop("print", "copies").join(in_nodes.select("id"), "id"))
    edges, labels = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "id long, component long")
    found, leaves = spark.createDataFrame([], "a long, b long, alike int"), spark.createDataFrame([], "id long, node long")
    if in_nodes.isEmpty():
        return labels

    def members_of(in_nodes: DataFrame) -> DataFrame:
        """Members (id, node, component, above) of in_nodes (id, nodes). A class is labelled once, not in each of its nodes."""
        labelled = cut(in_nodes.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"), "nodes"))
        return labelled.select("id", F.explode("nodes").alias("node"), "component", F.lit(None).cast("long").alias("above"))

    def with_stats(members: DataFrame, stats: DataFrame) -> DataFrame:
        """Members of the nodes that stats has, with what it tells of them."""
        total = stats.agg(F.sum("size")).first()[0] or 0
        return join_groups(members.drop("above"), stats, "node", "size", total)

    def agreeing(asked: DataFrame) -> DataFrame:
        """Of asked (node, size, outside, a, b) those whose signatures agree enough, with alike: how many tokens are equal."""
        one, two = (signatures.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "marks", "sketch"))) for x in "ab")
        leaders = asked.groupBy("a").agg(F.count(F.lit(1)).alias("led")).join(one, "a")
        both = join_groups(asked, leaders, "a", "led", asked.count()).drop("led").join(two, "b")
        return cut(both.mapInArrow(partial(_agreeing, similarity=similarity), "node long, size long, outside long, a long, b long, alike int"))

    def likeliest(pairs: DataFrame) -> DataFrame:
        """One pair of each b."""
        return cut(pairs.groupBy("b").agg(F.max_by("a", F.struct("alike", "a")).alias("a")).select("a", "b"))

    def link(pairs: DataFrame) -> None:
        """Confirms pairs and joins components."""
        nonlocal edges, labels
        if not pairs.isEmpty():
            edges = edges.union(cut(confirmed(pairs, given, signatures, words, similarity)))
            labels = components(edges)

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs of components that aren't joined yet, with these."""
        of = lambda x: labels.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}"))
        both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("of_a", "a").alias("p"), F.coalesce("of_b", "b").alias("q"))
        return both.where("p <> q")

    large, level, stats = in_nodes, members_of(in_nodes), None
    for turn in range(LEADER_ROUNDS):
        members = level if turn == 0 else members_of(large)
        told = cut(node_stats(members, turn))
        wide = told.where(F.col("pairs") > FEW)
        if wide.isEmpty():
            stats = told if turn == 0 else None  # nothing is joined yet, so they hold for the first level too
            break
        members = cut(with_stats(members, wide))
        asked = members.where("leader.component <> component").select("node", "size", (F.col("size") - F.col("most")).alias("outside"), F.col("leader.id").alias("a"), F.col("id").alias("b"))
        pairs = agreeing(asked)
        link(likeliest(pairs))
        # where a leader is like hardly any of the others, members are unlike, which branching parts
        alike = asked.groupBy("node").agg(F.first("size").alias("size"), F.first("outside").alias("outside")).join(pairs.groupBy("node").agg(F.count(F.lit(1)).alias("alike")), "node", "left")
        large = by_class(join_groups(members.select("id", "node"), alike, "node", "size", members.count()).where(F.col("alike") >= LEADER_SHARE * F.col("outside")))
    if stats is None:
        level = members_of(in_nodes)
    for depth in range(DEPTH + 2):
        stats = cut(node_stats(level)) if stats is None else stats
        # a node that kept more than half of the one above holds members too alike for branching to part them
        leaf = (F.col("pairs") <= FEW) | F.coalesce(2 * F.col("size") > F.col("above"), F.lit(False)) | F.lit(depth > DEPTH)
        members = cut(with_stats(level, stats.where("pairs > 0")).withColumn("leaf", leaf).drop("leader", "pairs"))
        leaves = leaves.union(members.where("leaf").select("id", "node"))
        found = found.union(cut(node_pairs(members.where("leaf").join(signatures.select("id", "n", "marks", "sketch"), "id"), similarity, best=True)))
        rest = members.where("NOT leaf")
        if rest.isEmpty():
            break
        described = rest.join(signatures.select("id", "n", "signature"), "id")
        level, stats = cut(branches(described, depth) if depth else by_size(described, similarity)), None
    # each member's likeliest pairs come first: what they join needs no further pairs, so a group of m alike costs m rows, not m squared
    found = cut(found.distinct())
    link(likeliest(found))
    link(cut(apart(found).select("a", "b")))
    again = leaves.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"), "node", F.lit(None).cast("long").alias("above"))
    again = cut(again)
    stats = cut(node_stats(again).where("pairs > 0"))
    if not stats.isEmpty():  # then all pairs of members that are still apart
        members = with_stats(again, stats).drop("leader", "pairs").join(signatures.select("id", "n", "marks", "sketch"), "id")
        found = cut(node_pairs(members, similarity))
        link(likeliest(found))
        link(cut(apart(found).select("a", "b")))
    return labels


def _agreeing(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    trim()
    for batch in batches:
        (n, p, u), (m, q, v) = _columns(batch, "_a"), _columns(batch, "_b")
        alike = (p == q).sum(axis=1)
        fine = may_link(n, m, np.bitwise_count(u ^ v).sum(axis=1, dtype=np.int64), similarity) & (alike >= MATCHES)
        yield batch.select(["node", "size", "outside", "a", "b"]).append_column("alike", pa.array(alike, pa.int32())).filter(pa.array(fine))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' '))) END AS shingles FROM w
), t AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t AS a JOIN t AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))
), r AS (
  SELECT a AS doc_id, a AS reached FROM p UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.reached = p.a
), c AS (
  SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, coalesce(c.component_id, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN c USING (doc_id)
"""
