"""Near-duplicate classes by DartMinHash.

A document is a weighted set of word shingles: a shingle weighs how often it stands there. Each element owns a strip of
the plane (weight by rank), and darts fall into it as a Poisson process that its hash seeds: darts of one element are
the same in every document that has it, and a document owns those under its weight. Each dart also falls on one of
``k`` coordinates, and the earliest dart of each coordinate is the signature; two documents agree in a coordinate with
the probability of their weighted Jaccard similarity. About ``k ln k + 2k`` darts are thrown a document, however long.

Signatures are cut into bands. In each of a few rounds a row of a band bucket is held, by exact similarity, against one
row of its buckets, so links are at most one a row and round; what they connect gets one label.
Rows of different labels that still share a bucket are then compared: as pairs in small buckets, and in blocks of
bounded size in large ones, where distances to two pivots rule most pairs out (the triangle inequality of the Jaccard
distance) and a block hands on a spanning forest of labels. No link that shares a bucket is dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .textcore import WORDS, U, blocks, mix, powers, shingles, words

SKETCH = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("bands", pa.list_(pa.int64())), ("shingles", pa.binary())])
SIMILAR = "a long, b long, common long, total long"
PAIR = "a long, b long"
#: Rounds in which each row is held against one pivot.
ROUNDS = 3
#: Buckets of at most so many rows are compared as pairs; of larger ones, blocks of so many rows with so many.
PAIRED, ASKED, HELD = 8, 256, 1024
#: Cells of the distance to a pivot, in buckets of more than HELD rows.
CELLS = 50
#: Rows that one copy of a pivot's set, or of a class's head, serves; SALT copies of a head that many rows look for.
SPREAD, SALT = 1024, 8


def dart_signatures(n_docs: int, doc: np.ndarray, element: np.ndarray, weight: np.ndarray | None = None, k: int = 192, seed: int = 1) -> np.ndarray:
    """(n_docs, k) ids of the earliest darts; a document without elements has zeros. ``weight``: of each element,
    once a document, positive; none: 1 each."""
    sig = np.zeros((n_docs, k), U)
    weight = np.ones(len(doc)) if weight is None else weight
    total = np.bincount(doc, weight, minlength=n_docs)
    # a strip of width 1 for each begun unit of weight; in the last one only darts under the weight count
    strips = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(doc)), strips)
    strip = np.arange(len(at)) - np.repeat(np.cumsum(strips) - strips, strips)
    own, seeds = doc[at], mix(element[at] + strip.astype(U) * U(0x9E3779B97F4A7C15) + U(seed))
    width = np.minimum(1.0, weight[at] - strip)
    partial = bool((width < 1).any())
    todo, factor = np.flatnonzero(total > 0), 1.0
    while len(todo):
        rho = np.zeros(n_docs)
        rho[todo] = factor * (k * np.log(k) + 2 * k) / total[todo]
        live = np.flatnonzero(rho[own] > 0)
        rank, cells, ranks, darts, step = np.zeros(len(live)), [], [], [], 0
        while len(live):
            some = max(1, 65536 // len(live))  # arrivals of each strip at once: many where few strips are left
            steps = (np.arange(step, step + some, dtype=U) * U(0xD1342543DE82EF95) + U(1))[None, :]
            u = mix(seeds[live][:, None] + steps)
            wait = -np.log(((u >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)
            wait[:, 0] += rank
            wait = np.cumsum(wait, axis=1)
            on = wait <= rho[own[live]][:, None]
            strip_of, u = np.broadcast_to(live[:, None], on.shape)[on], u[on]
            v = mix(u ^ U(0xA5A5A5A5A5A5A5A5))
            inside = (v >> U(40)).astype(np.float64) * 2.0**-24 < width[strip_of] if partial else slice(None)
            cells.append((own[strip_of] * k + (v & U(0xFFFFFFFF)).astype(np.int64) % k)[inside])
            ranks.append(wait[on][inside])
            darts.append(mix(u + U(7))[inside])
            live, rank, step = live[on[:, -1]], wait[on[:, -1], -1], step + some
        cell, dart = np.concatenate(cells), np.concatenate(darts)
        late_first = np.argsort(-np.concatenate(ranks), kind="stable")
        flat = sig.reshape(-1)
        flat[cell[late_first]] = dart[late_first]  # the earliest is written last
        hit = np.zeros(n_docs * k, bool)
        hit[cell] = True
        todo, factor = todo[~hit.reshape(n_docs, k)[todo].all(1)], factor * 2
    return sig


def _sets(doc: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, element), sorted, and how often each stands there."""
    order = np.lexsort((element, doc))
    doc, element = doc[order], element[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (element[1:] != element[:-1])
    first = np.flatnonzero(new)
    return doc[first], element[first], np.diff(np.append(first, len(doc)))


def _sketch(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int, counted: bool) -> Iterator[pa.RecordBatch]:
    next_id = TaskContext.get().partitionId() << 40
    for batch in batches:
        for first, last, data, offsets in blocks(batch.column("text")):
            n = last - first
            doc, word = words(data, offsets, WORDS)
            keys = np.zeros((2, n), U)
            if len(doc):
                begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                has, place = doc[begin], np.arange(len(doc)) - np.repeat(begin, np.diff(np.append(begin, len(doc))))
                for i, base in enumerate((0xC6BC279692B5C323, 0xE7037ED1A0B428DB)):
                    keys[i, has] = mix(np.add.reduceat(mix(word + U(i)) * powers(base, int(place.max()) + 1)[place], begin))
            for d in np.setdiff1d(np.arange(n), doc):  # without words: by the text itself
                digest = hashlib.md5(b"wordless" + data[offsets[d] : offsets[d + 1]].tobytes()).digest()
                keys[:, d] = np.frombuffer(digest, U)
            doc, element, count = _sets(*shingles(doc, word, size))
            sig = dart_signatures(n, doc, element, count.astype(float) if counted else None, bands * rows)
            weight = powers(0x8CB92BA72F3D8DD7, max(rows, 2))[:rows]
            band = mix((sig.reshape(n, bands, rows) * weight).sum(2, dtype=U) + np.arange(bands, dtype=U) * U(0xDB4F0B9175AE2165)).view(np.int64)
            some = np.bincount(doc, minlength=n) > 0
            ends = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
            if counted:  # the i-th time that an element stands there is an element of its own: weighted sets as sets
                at = np.repeat(np.arange(len(doc)), count)
                time = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                doc, element = doc[at], mix(element[at] + time.astype(U) * U(0xC2B2AE3D27D4EB4F))
            packed = (element >> U(32)).astype(np.uint32)
            edges = (np.searchsorted(doc, np.arange(n + 1)) * 4).astype(np.int32)
            yield pa.record_batch(
                [
                    pa.array(np.arange(next_id, next_id + n)),
                    batch.column("doc_id").slice(first, n),
                    batch.column("text_hash").slice(first, n),
                    pa.array(keys[0].view(np.int64)),
                    pa.array(keys[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(band[some].reshape(-1))),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(packed.tobytes())]),
                ],
                schema=SKETCH,
            )
            next_id += n


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of the intersection and of the union of two sets."""
    for batch in batches:
        common, total = np.zeros((2, batch.num_rows), np.int64)
        left, right = batch.column("sa"), batch.column("sb")
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(x[i].as_buffer(), np.uint32) for x in (left, right))
            both = np.sort(np.concatenate([a, b]))
            common[i] = (both[1:] == both[:-1]).sum()
            total[i] = len(both) - common[i]
        yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(common), pa.array(total)], names=["a", "b", "common", "total"])


def _blocks_alike(asked: pa.Table, held: pa.Table, least: float) -> pa.Table:
    """A spanning forest of the labels that rows of a block connect. A row is only compared with those of other labels
    that distances to the pivots leave possible; its set is laid out over their elements."""
    out: list[tuple[int, int]] = []
    if asked.num_rows and held.num_rows:
        labels, at = np.unique(np.concatenate([t.column("label").to_numpy() for t in (asked, held)]), return_inverse=True)
        root, mine, theirs = np.arange(len(labels)), at[: asked.num_rows], at[asked.num_rows :]
        near_p, near_q, far_p, far_q = (t.column(c).to_numpy() for t in (asked, held) for c in ("dp", "dq"))
        reach = 1 - least + 1e-9
        data = held.column("shingles").to_pylist()
        size = np.array([len(x) // 4 for x in data])
        known, code = np.unique(np.frombuffer(b"".join(data), np.uint32), return_inverse=True)
        begin, on = np.cumsum(size) - size, np.zeros(len(known), np.int32)
        for i, packed in enumerate(asked.column("shingles").to_pylist()):
            own = np.frombuffer(packed, np.uint32)
            fits = (root[theirs] != root[mine[i]]) & (np.abs(far_p - near_p[i]) <= reach) & (np.abs(far_q - near_q[i]) <= reach)
            some = np.flatnonzero(fits & (np.minimum(size, len(own)) >= least * np.maximum(size, len(own)) - 1e-9))
            if not len(some):
                continue
            hit = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = hit[known[hit] == own]
            on[hit] = 1
            first = np.cumsum(size[some]) - size[some]
            place = np.arange(size[some].sum()) + np.repeat(begin[some] - first, size[some])
            common = np.add.reduceat(on[code[place]], first)
            on[hit] = 0
            for label in np.unique(theirs[some[common >= least * (len(own) + size[some] - common) - 1e-9]]):
                x, y = root[mine[i]], root[label]
                if x != y:
                    root[root == y] = x
                    out.append((int(labels[mine[i]]), int(labels[label])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, label (the smallest node that it is connected with) of all nodes of ``edges`` (a, b): smallest labels
    travel along edges and labels are replaced by their own labels until nothing changes."""
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), name)
    while True:
        near = both.join(labels, F.col("a") == F.col("node")).groupBy("b").agg(F.min("label").alias("near"))
        moved = labels.join(near, F.col("node") == F.col("b"), "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.filter("node <> label").select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = cut(moved.join(up, "label", "left").select("node", "was", F.least("label", "up").alias("label")), name)
        changed = new.filter("was <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def _find_heads(rows: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` left-joined with ``heads``; a key that very many rows have is spread over SALT tasks."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("rid"), F.lit(SALT)))
    copies = heads.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the sizes of the intersection and of the union of their sets. A ``b`` that many rows ask for
    gets a copy of its set for each SPREAD of them."""
    often = pairs.groupBy("b").agg(F.ceil(F.count("*") / SPREAD).cast("long").alias("parts")).filter("parts > 1")
    asked = pairs.join(often, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).alias("part"))
    left = sets.select(F.col("rid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rid").alias("b"), F.col("shingles").alias("sb")).join(often, "b", "left")
    right = right.select("b", "sb", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    return asked.join(left, "a").join(right, ["b", "part"]).select("a", "b", "sa", "sb").mapInArrow(_similar, SIMILAR)


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """rid, label with labels replaced by what ``links`` (a, b: labels) connect."""
    tops = components(links).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return cut(labels.join(tops, "label", "left").select("rid", F.coalesce("top", "label").alias("label")), "labels")


def _label_links(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of the rows of ``pairs`` (a, b)."""
    ends = [labels.select(F.col("rid").alias(c), F.col("label").alias(f"l{c}")) for c in "ab"]
    return pairs.join(ends[0], "a").join(ends[1], "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))


def _in_buckets(met: DataFrame, *others: str) -> DataFrame:
    """A row for each bucket of each row; a row has as many buckets as there are bands at most."""
    return met.select("row", *others, F.explode("buckets").alias("b")).select("row", *others, "b.bucket", "b.n")


def _open_buckets(met: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, n, row, label of rows in large buckets with several labels, with the bucket's two pivots: p is its most central
    row, q the most central one of another label than p's."""
    named = _in_buckets(met.join(labels, "rid"), "label").filter(F.col("n") > PAIRED)
    first = named.groupBy("bucket").agg(F.min(F.struct("row", "label")).alias("p"), F.min("label").alias("low"), F.max("label").alias("high"))
    here = named.join(first.filter("low <> high").select("bucket", "p"), "bucket")
    second = here.filter("label <> p.label").groupBy("bucket").agg(F.min(F.struct("row", "label")).alias("q"))
    return cut(here.join(second, "bucket"), "open")


def _compare_blocks(open_: DataFrame, known: DataFrame, sets: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b: labels) between rows of large buckets that have different labels still."""
    many = open_.select("bucket", "n", F.col("row.rid").alias("rid"), "label", F.col("p.row.rid").alias("p"), F.col("q.row.rid").alias("q"), (F.col("label") == F.col("p.label")).alias("main"))
    # Distances of all rows to both pivots of their buckets.
    asked = many.select(F.col("rid").alias("a"), F.col("p").alias("b")).unionByName(many.select(F.col("rid").alias("a"), F.col("q").alias("b"))).filter("a <> b").distinct()
    further = cut(_compare(cut(asked.join(known.select("a", "b"), ["a", "b"], "left_anti"), "distances"), sets), "further")
    near = further.filter(F.col("common") >= F.col("total") * similarity - 1e-9).select("a", "b")
    known = known.unionByName(further)
    for c in "pq":
        way = known.select(F.col("a").alias("rid"), F.col("b").alias(c), (F.col("total") - F.col("common")).alias("off"), "total")
        told = many.join(way, ["rid", c], "left")
        cell = F.when(F.col("n") > HELD, F.coalesce(F.expr(f"{CELLS} * off div total"), F.lit(0))).otherwise(0)  # whole numbers: no rounding
        many = told.withColumn(f"d{c}", F.coalesce(F.col("off") / F.col("total"), F.lit(0.0))).withColumn(f"c{c}", cell).drop("off", "total")
    many = cut(many.select("bucket", F.struct("main", "cp", "cq").alias("cell"), "rid", "label", "dp", "dq"), "cells")
    cells = many.groupBy("bucket", "cell").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
    x, y = (cells.select("bucket", *[F.col(c).alias(f"{c}_{z}") for c in ("cell", "size", "low", "high")]) for z in "xy")
    reach = int(np.ceil(CELLS * (1 - similarity) - 1e-9))
    fits = ~F.col("cell_x.main") & (F.col("cell_y.main") | (F.col("cell_x") <= F.col("cell_y")))
    fits &= (F.abs(F.col("cell_x.cp") - F.col("cell_y.cp")) <= reach) & (F.abs(F.col("cell_x.cq") - F.col("cell_y.cq")) <= reach)
    fits &= F.least("low_x", "low_y") < F.greatest("high_x", "high_y")
    meets = cut(x.join(y, "bucket").filter(fits).select("bucket", "cell_x", "cell_y", F.ceil(F.col("size_x") / ASKED).alias("nx"), F.ceil(F.col("size_y") / HELD).alias("ny")), "cell-pairs")
    full = many.join(sets, "rid")
    by = ["bucket", "cell_x", "cell_y", "i", "j"]
    own = lambda n: F.pmod(F.xxhash64("rid"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows_x = full.withColumnRenamed("cell", "cell_x").join(meets, ["bucket", "cell_x"]).withColumn("i", own("nx")).withColumn("j", each("ny"))
    rows_y = full.withColumnRenamed("cell", "cell_y").join(meets, ["bucket", "cell_y"]).withColumn("j", own("ny")).withColumn("i", each("nx"))
    sides = [r.select(*[F.col(c).alias(c) for c in [*by, "label", "dp", "dq", "shingles"]]).groupBy(by) for r in (rows_x, rows_y)]
    blocks_ = sides[0].cogroup(sides[1]).applyInArrow(lambda s, t: _blocks_alike(s, t, similarity), PAIR)
    return _label_links(near, labels).unionByName(blocks_)


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    similarity: float = 0.8,
    bands: int = 32,
    rows: int = 6,
    counted: bool = True,
) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, class_id (the smallest doc_id of its class), kept (true for one row
    of each class, one with that doc_id).

    Rows are linked if their words are the same, or the weighted Jaccard similarity of their shingles is at least
    ``similarity`` (shingles by 32-bit hashes, weighing how often they stand there; each 1 without ``counted``); classes
    are what links connect. With 32 bands of 6 coordinates a pair of similarity 0.8 shares a bucket with probability
    0.9999. Texts of fewer words than a shingle are one shingle; null and wordless texts are linked to equal texts
    only, null counting as empty. Rows without id have classes like others; repeated rows are copies. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    return _classes(docs, id_col, text_col, shingle_words, similarity, bands, rows, counted).select("doc_id", "text_hash", "class_id", "kept")


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, similarity: float, bands: int, rows: int, counted: bool) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), text.alias("text"))
    schema = "rid long, doc_id long, text_hash long, key1 long, key2 long, bands array<long>, shingles binary"
    sketches = cut(given.mapInArrow(lambda b: _sketch(b, shingle_words, bands, rows, counted), schema), "sketches")
    keys = ["key1", "key2"]
    firsts = cut(sketches.groupBy(keys).agg(F.min("rid").alias("node"), F.count("*").alias("n")), "firsts")

    # Buckets of several rows, the row of the smallest hash in each, and of these the smallest that a row meets. A row's
    # place in later rounds is by how many rows it meets, then by its hash.
    nodes = sketches.select("rid", "bands").join(firsts.select(F.col("node").alias("rid")), "rid")
    banded = cut(nodes.select("rid", F.explode("bands").alias("bucket")), "banded")
    pivots = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("rid").alias("hash"), F.col("rid").alias("pivot"))).alias("p")).filter("n > 1")
    first = F.min(F.when(F.col("p.pivot") != F.col("rid"), F.col("p")))
    met = banded.join(pivots, "bucket").groupBy("rid").agg((-F.sum("n")).alias("meets"), F.collect_list(F.struct("bucket", "n")).alias("buckets"), first.alias("first"))
    met = cut(met.select("rid", F.struct("meets", F.xxhash64("rid").alias("hash"), "rid").alias("row"), "buckets", F.col("first.pivot").alias("pivot")), "met")
    labels = met.select("rid", F.col("rid").alias("label"))
    # Sets of all that share a bucket, taken once; these grow with the corpus, so nothing here is broadcast by hand.
    sets = cut(sketches.select("rid", "shingles").join(labels.select("rid").hint("merge"), "rid", "left_semi"), "sets")
    alike = F.col("common") >= F.col("total") * similarity - 1e-9

    # The first round holds each row against that row, later ones against a central row of a large bucket with several
    # labels that it was not yet held against.
    chosen = met.filter("pivot IS NOT NULL").select(F.col("rid").alias("a"), F.col("pivot").alias("b"))
    known, open_ = None, None
    for turn in range(ROUNDS):
        if turn:
            sides = [open_.filter(f"label <> {c}.label").select("row.rid", F.col(f"{c}.row").alias("pivot")) for c in "pq"]
            tried = known.select(F.col("a").alias("rid"), F.col("b").alias("other"))
            tries = sides[0].unionByName(sides[1]).withColumn("other", F.col("pivot.rid")).join(tried, ["rid", "other"], "left_anti")
            chosen = tries.groupBy("rid").agg(F.min("pivot").alias("pivot")).select(F.col("rid").alias("a"), F.col("pivot.rid").alias("b"))
        found = cut(_compare(cut(chosen, "pairs"), sets), "links")
        known = found if known is None else known.unionByName(found)
        joined = found.filter(alike).select("a", "b")
        if not joined.isEmpty():
            labels = _relabel(labels, _label_links(joined, labels))
        if open_ is None or not joined.isEmpty():
            open_ = _open_buckets(met, labels)
        if open_.isEmpty():
            break

    # Buckets of few rows: pairs, a bounded number a row.
    named = _in_buckets(met.join(labels, "rid"), "label").filter(F.col("n") <= PAIRED).withColumn("rid", F.col("row.rid"))
    one, other = named.select("bucket", F.col("rid").alias("a"), F.col("label").alias("la")), named.select("bucket", F.col("rid").alias("b"), F.col("label").alias("lb"))
    pairs = one.join(other, "bucket").filter("la <> lb AND a < b").select("a", "b").distinct()
    done = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = cut(_compare(cut(pairs.join(done, ["a", "b"], "left_anti"), "rest"), sets).filter(alike).select("a", "b"), "more")
    more = _label_links(more, labels)
    if not open_.isEmpty():
        more = more.unionByName(_compare_blocks(open_, known, sets, labels, similarity))
    more = cut(more.distinct(), "more-links")
    if not more.isEmpty():
        labels = _relabel(labels, more)

    named = _find_heads(sketches.select("rid", "doc_id", "text_hash", *keys), firsts.filter("n > 1").drop("n"), keys)
    named = named.select("rid", "doc_id", "text_hash", F.coalesce("node", "rid").alias("node"))
    classes = cut(_find_heads(named, labels.select(F.col("rid").alias("node"), "label"), ["node"]).select("rid", "doc_id", "text_hash", F.coalesce("label", "node").alias("label")), "classes")
    first = F.coalesce(F.min_by("rid", "doc_id"), F.min("rid"))
    best = classes.groupBy("label").agg(F.min("doc_id").alias("class_id"), first.alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    told = _find_heads(classes, best, ["label"])
    alone = F.col("first").isNull()
    return told.select("rid", "doc_id", "text_hash", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), (alone | (F.col("rid") == F.col("first"))).alias("kept"))
