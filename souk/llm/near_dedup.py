"""MinHash near-dedup of word-shingle multisets: BagMinHash, bands, verification.

1. One pass hashes every text into a BagMinHash signature and its band keys;
   equal texts (by md5) become one node, so copies never meet as pairs.
2. Nodes that share a band key are candidates. First every bucket's hub, the
   member that meets most others, is compared with the other members: one
   comparison a member, whatever the size of a group of near copies.
3. Buckets whose members are then in one component are finished. For the rest it
   is counted how many of a text's shingles occur in any other text that is left;
   two texts can't share more than the poorer of them has, which rules out texts
   that only share a passage without a comparison and without a loss.
4. What still is in small buckets (``SMALL`` members) meets as pairs. In a larger one the
   members outside its largest component are compared with all others in cells of
   at most about ``BLOCK`` x ``BLOCK`` texts: shared counts by matrix products over the
   shingles that occur twice in the cell. A cell returns a spanning forest of its
   links, so its output grows with its members, not with its pairs. Nothing is
   capped: more members give more cells.
5. Pairs of steps 2 and 4 must have sizes that allow the similarity and agree in at
   least ``ESTIMATE`` of the slots (at 0.8 that fails 3 times in 10^5); the rest, and all
   pairs of the cells, are verified on the exact multisets. Links become classes by
   connected components.

Shuffled are band keys with 8-byte node numbers, pairs of node numbers, signatures and
multisets of nodes in surviving pairs; joins on a frequent hub are left to skew
splitting. Tables between the steps are written to the shared folder.

Defined cases: null is an empty text; texts without words are near only to
texts equal to them; texts of fewer than five words are one shingle; rows
repeated with the same id and text are one document of a class (one stays); null
ids come last when a class chooses its document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from souk.llm import bagminhash as bag
from souk.llm.common import fresh, stored, text_batches
from souk.llm.url_filter import components
from souk.session import ship_package

SIMILARITY = 0.8
ESTIMATE = 0.66
# Buckets of at most so many members meet as pairs.
SMALL = 32
# Texts and shingles on one side of a cell (about: members are dealt by hash), columns of one product.
BLOCK, ELEMENTS, COLUMNS = 256, 400_000, 2048


def _buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column (nulls as empty)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    return data, offsets


def _lists(values: np.ndarray, per: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32()), pa.array(values, kind))


def _sign(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = _buffers(batch.column("text"))
        values, weights = [], []
        for a, b in bag.chunks(offsets):
            v, w = bag.signatures(*bag.shingles(data, offsets[a:b + 1]), b - a)
            values.append(v)
            weights.append(w)
        values, weight = np.concatenate(values), np.concatenate(weights)
        per = np.full(len(values), 1)
        slots = (values >> np.uint64(1)).astype(np.uint16).view(np.int16)
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("rowkey"), pa.array(weight, pa.int64()),
             _lists(slots.ravel(), per * bag.SLOTS, pa.int16()),
             _lists(bag.band_keys(values).ravel(), per * bag.BANDS, pa.int64())],
            names=["key", "rowkey", "weight", "slots", "bands"])


def _expand(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = _buffers(batch.column("text"))
        found, per = [], []
        for a, b in bag.chunks(offsets):
            owner, s, occurrence = bag.shingles(data, offsets[a:b + 1])
            found.append(bag.elements(owner, s, occurrence))
            per.append(np.bincount(owner, minlength=b - a))
        yield pa.RecordBatch.from_arrays([batch.column("node"), _lists(np.concatenate(found), np.concatenate(per), pa.int64())],
                                         names=["node", "elements"])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, key (of the text), rowkey (of id and text)."""
    text = F.coalesce("text", F.lit(""))
    ident = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(text))
    return docs.select("doc_id", text.alias("text"), F.md5(text).alias("key"), F.md5(ident).alias("rowkey"))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, rowkey, key, root (the class, named by a key)."""
    spark = docs.sparkSession
    ship_package(spark)
    text_batches(spark, 250, 4 << 20)
    keyed = _keyed(docs)
    rows = stored(keyed.select("doc_id", "rowkey", "key"), "near-rows")
    signed = keyed.select("key", "rowkey", "text").mapInArrow(
        _sign, "key string, rowkey string, weight bigint, slots array<smallint>, bands array<bigint>").filter("weight > 0")
    # one row per distinct text, numbered; the number is fixed by writing it
    nodes = signed.groupBy("key").agg(F.min("rowkey").alias("rowkey"), *[F.first(c).alias(c) for c in ("weight", "slots", "bands")])
    known = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    nodes = known.select("key", "rowkey", "node")
    flat = known.select("node", "weight", F.explode("bands").alias("bucket"))
    shared = flat.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = _small(flat.join(shared, "bucket"), "near-members")
    links = _links(keyed, nodes, known, members, similarity)
    roots = components(links)
    named = nodes.select("key", F.col("node").alias("n"))
    classes = _small(roots.join(named, roots["node"] == named["n"]).select("key", F.col("root").alias("r")), "near-roots")
    tops = nodes.select(F.col("node").alias("t"), F.col("key").alias("root"))
    classes = classes.join(tops, F.col("r") == F.col("t")).select("key", "root")
    out = rows.join(classes, "key", "left")
    return out.withColumn("root", F.coalesce("root", "key"))


def _links(keyed, nodes, known, members, similarity) -> DataFrame:
    """Verified links (a, b) between nodes that keep every component whole."""
    # how many others a node meets: what many texts were copied from meets most
    met = _small(members.groupBy("node").agg(F.sum("size").alias("met")), "near-met")
    sets = _sets(keyed, nodes, met.select("node"))
    hubs = members.join(met, "node").groupBy("bucket").agg(F.max(F.struct("met", "node", "weight")).alias("hub"))
    fits = F.least("weight", "hub.weight") >= similarity * F.greatest("weight", "hub.weight")
    pairs = members.join(hubs, "bucket").filter((F.col("node") != F.col("hub.node")) & fits).select(
        F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    first = _compared(pairs, known, sets, similarity)
    roots = _small(components(first), "near-round")
    live = members.select("bucket", "node", "weight").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_buckets = live.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    live = _small(live.join(open_buckets.select("bucket"), "bucket"), "near-live")
    able = _small(_shareable(sets.join(live.select("node").distinct(), "node")), "near-common")
    live = live.join(able, "node").filter(F.col("able") >= similarity * F.col("weight"))
    live = _small(_sized(live), "near-open")
    return first.unionByName(_met_in_pairs(live, known, sets, similarity)).unionByName(_met_in_cells(live, sets, similarity))


def _sized(live: DataFrame) -> DataFrame:
    """Members of buckets with several components, with the bucket's largest one and how many parts each side takes."""
    def parts(n, elements):
        return F.ceil(F.greatest(n / BLOCK, elements / ELEMENTS)).cast("int")

    per = live.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    per = per.groupBy("bucket").agg(F.sum("n").alias("size"), F.sum("w").alias("w"), F.max(F.struct("n", "root", "w")).alias("top"))
    per = per.filter(F.col("size") > F.col("top.n")).select(
        "bucket", "size", F.col("top.root").alias("top"), parts(F.col("top.n"), F.col("top.w")).alias("top_parts"),
        parts(F.col("size") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("rest_parts"))
    return live.join(per, "bucket")


def _met_in_pairs(live, known, sets, similarity) -> DataFrame:
    few = live.filter(F.col("size") <= SMALL).select("bucket", "node", "weight", "root", "able")
    other = few.select("bucket", *[F.col(c).alias(f"o{c}") for c in ("node", "weight", "root", "able")])
    # what two texts share is at most what the poorer one has in common with any
    share = F.least("able", "oable")
    near = (F.col("root") != F.col("oroot")) & (share >= similarity * (F.col("weight") + F.col("oweight") - share))
    pairs = few.join(other, "bucket").filter((F.col("node") < F.col("onode")) & near)
    return _compared(pairs.select(F.col("node").alias("a"), F.col("onode").alias("b")).distinct(), known, sets, similarity)


def _met_in_cells(live, sets, similarity) -> DataFrame:
    """Links of the large buckets: the texts outside a bucket's largest component against each other and against that."""
    rest = F.col("root") != F.col("top")
    rows = live.filter(F.col("size") > SMALL).withColumn(
        "own", F.pmod(F.xxhash64("node"), F.when(rest, F.col("rest_parts")).otherwise(F.col("top_parts"))).cast("int"))

    def cells(parts, cell):
        return F.transform(F.sequence(F.lit(0), F.col(parts) - 1), cell)

    def cell(kind, p, q, left):
        return F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"), left.alias("first"))

    own, yes, no = F.col("own"), F.lit(True), F.lit(False)
    among = cells("rest_parts", lambda x: cell(0, F.least(x, own), F.greatest(x, own), own <= x))
    against = cells("top_parts", lambda x: cell(1, own, x, yes))
    behind = cells("rest_parts", lambda x: cell(1, x, own, no))
    dealt = rows.select("bucket", "node", "root", F.explode(F.when(rest, F.concat(among, against)).otherwise(behind)).alias("c"))
    dealt = dealt.join(sets, "node").select("bucket", "c.*", "node", "root", "elements")
    found = dealt.groupBy("bucket", "kind", "p", "q").applyInArrow(lambda t: cell_links(t, similarity), "a bigint, b bigint")
    return _small(found.distinct(), "near-cells")


def cell_links(table: pa.Table, similarity: float) -> pa.Table:
    """A spanning forest of the links between a cell's first and its other texts (all with all if it has no others)."""
    node, root, first = (table.column(c).to_numpy() for c in ("node", "root", "first"))
    lists = table.column("elements").combine_chunks()
    size = lists.value_lengths().to_numpy().astype(np.int64)
    a = np.flatnonzero(first)
    b = np.flatnonzero(~first) if not first.all() else a
    shared = _shared_counts(lists.flatten().to_numpy(), np.repeat(np.arange(len(node)), size), a, b, len(node))
    alike = shared / (size[a][:, None] + size[b][None, :] - shared) >= similarity
    alike &= root[a][:, None] != root[b][None, :]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(alike))):
        x, y = find(int(root[a[i]])), find(int(root[b[j]]))
        if x != y:
            parent[x] = y
            out.append(sorted((int(node[a[i]]), int(node[b[j]]))))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _shared_counts(values, owner, a, b, n) -> np.ndarray:
    """How many elements each text of ``a`` shares with each of ``b``, over the elements that occur twice."""
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    twice = times > 1
    number = np.cumsum(twice) - 1
    use = twice[column]
    column, owner = number[column[use]], owner[use]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((len(a), len(b)))
    edges = np.searchsorted(column, np.arange(0, int(twice.sum()) + COLUMNS, COLUMNS))
    for k in range(len(edges) - 1):
        part = slice(edges[k], edges[k + 1])
        held = np.zeros((n, COLUMNS), np.float32)
        held[owner[part], column[part] - k * COLUMNS] = 1
        shared += held[a] @ held[b].T
    return shared


def _compared(pairs, known, sets, similarity) -> DataFrame:
    """The links among pairs of node numbers: signatures are fetched for the pairs, multisets for those that agree."""
    slots = [known.select(F.col("node").alias(x), F.col("slots").alias(f"{x}_slots")) for x in "ab"]
    same = F.size(F.filter(F.zip_with("a_slots", "b_slots", lambda p, q: p == q), lambda z: z)) >= ESTIMATE * bag.SLOTS
    likely = _small(pairs, "near-pairs").join(slots[0], "a").join(slots[1], "b").filter(same).select("a", "b")
    return _small(_verified(sets, _small(likely, "near-likely"), similarity), "near-links")


def _shareable(sets: DataFrame) -> DataFrame:
    """(node, able): how many of a node's elements occur in another of these nodes."""
    flat = sets.select("node", F.explode("elements").alias("element"))
    alone = flat.groupBy("element").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1")
    alone = alone.groupBy("node").agg(F.count("*").alias("alone"))
    size = sets.select("node", F.size("elements").cast("long").alias("size"))
    return size.join(alone, "node", "left").select("node", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("able"))


def _sets(keyed, nodes, wanted) -> DataFrame:
    """(node, elements): the multisets of the wanted nodes."""
    wanted = _small(nodes.join(wanted, "node").select("node", "rowkey"), "near-wanted")
    # the same join at every size: a row's key is hashed once and the texts aren't sorted for it
    texts = keyed.select("rowkey", "text").join(wanted.hint("shuffle_hash"), "rowkey")
    texts = texts.dropDuplicates(["rowkey"]).select("node", "text")
    return stored(texts.mapInArrow(_expand, "node bigint, elements array<bigint>"), "near-sets")


def _small(df: DataFrame, name: str) -> DataFrame:
    """``stored`` in at most four files a core: for tables far smaller than the texts."""
    return stored(df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism), name)


def _verified(sets, likely, similarity) -> DataFrame:
    a = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    b = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    both = likely.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("ea", "eb"))
    return both.filter(common / (F.size("ea") + F.size("eb") - common) >= similarity).select("a", "b")


def kept_rows(classes: DataFrame) -> DataFrame:
    """(rowkey, class_id, class_size) of the document that stays of each class: the smallest id."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rowkey"))
    per = classes.groupBy("root").agg(first.alias("f"), F.count("*").alias("class_size"))
    return per.select("root", F.col("f.rowkey").alias("rowkey"), F.col("f.doc_id").alias("class_id"), "class_size")


def assign_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class), class_size, kept."""
    classes = stored(near_classes(docs, similarity), "near-classes")
    kept = kept_rows(classes).withColumnRenamed("rowkey", "first")
    out = classes.join(kept, "root")
    return out.select("doc_id", "class_id", "class_size", (F.col("rowkey") == F.col("first")).alias("kept"))


def dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class, same columns.

    The kept rows are joined back on a key of (id, text); of rows repeated
    with the same id and text one is returned.
    """
    kept = stored(kept_rows(near_classes(docs, similarity)).select("rowkey"), "near-kept")
    rowkey, nth = fresh(docs, "_rowkey", "_nth")
    text = F.coalesce("text", F.lit(""))
    ident = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(text))
    out = docs.withColumn(rowkey, F.md5(ident)).join(kept.withColumnRenamed("rowkey", rowkey), rowkey)
    w = Window.partitionBy(rowkey).orderBy(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text",)])
    return out.withColumn(nth, F.row_number().over(w)).filter(F.col(nth) == 1).select(*docs.columns)
