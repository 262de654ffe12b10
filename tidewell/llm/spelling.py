"""Spelling variants: words of a corpus with the words one edit away, by K-d trees over letter counts.

One inserted, deleted or replaced letter changes one or two counts by one, so words one edit apart lie within an L1
distance of two (replaced; equal lengths) or one (inserted; lengths one apart). The words of each length make one K-d
tree: its top is split at medians of a bounded sample and deals the words into cells of bounded size; a word goes to
its own cell and, as a query, to those cells of its own and of the next length whose boxes are within reach. A task
builds the rest of a cell's tree with tight boxes, drops all queries that a box rules out, and compares letters in their
order at the leaves. Words whose counts are all alike can't be split by counts; a large leaf of them goes by halves of
the word, one of which an edit leaves alone. Counts and best neighbours are added up over cells; pairs aren't kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, cut

#: Words of a cell (by the sample), words of a leaf, words of the sample (about) that the top of the trees is made of.
CELL, LEAF, SAMPLE = 16_384, 24, 50_000
#: Letters a-z have an axis each, all others share the rest.
AXES = 32
#: Bytes of letters that are compared at once.
BLOCK = 1 << 23
HOME, SAME, LONGER = 0, 1, 2
#: Maximal runs of letters in text with A-Z lower-cased; shorter ones can't become words of the least length.
RUNS = r"[a-zÀ-ÿ]{%d,}"


def counted_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, least_chars: int = 6, least_count: int = 5, typo_every: int = 199) -> DataFrame:
    """word, n: distinct runs of letters (A-Z lower-cased) with at least ``least_chars`` and ``least_count`` occurrences in
    all texts. Where ``typo_every`` divides h, the crc32 of "id:run", the letter at h % length is left out first (0: never).
    A null text has no words, a null id counts as an empty text."""
    run = F.col("run")
    runs = docs.select(F.col(doc_id).cast("string").alias("id"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(RUNS % least_chars), F.lit(0))).alias("run"))
    h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), run).cast("binary"))
    at = (F.col("h") % F.length(run)).cast("int")
    cut_out = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % typo_every == 0, cut_out).otherwise(run).alias("word")) if typo_every else runs.select(run.alias("word"))
    return words.filter(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def letters(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def counts(codes: np.ndarray) -> np.ndarray:
    axis = np.where((codes >= 97) & (codes <= 122), codes - 97, 26 + codes % (AXES - 26))
    at = (np.arange(len(codes))[:, None] * AXES + axis).ravel()
    return np.bincount(at, minlength=len(codes) * AXES).reshape(-1, AXES).astype(np.int16)


def split(points: np.ndarray) -> tuple[int, int] | None:
    """Axis and greatest value of the lower side: of the widest axes the one that halves the points best."""
    lo, hi = points.min(0), points.max(0)
    if (hi == lo).all():
        return None
    best = None
    for axis in np.argsort(-points.var(0), kind="stable")[:6]:
        middle = int(np.median(points[:, axis]))
        for value in (middle - 1, middle):
            low = int((points[:, axis] <= value).sum())
            if 0 < low < len(points) and (best is None or abs(2 * low - len(points)) < best[0]):
                best = abs(2 * low - len(points)), int(axis), value
    return best and best[1:]


def top_tree(points: np.ndarray, weight: float, cell: int, first: int) -> tuple:
    """Nested (axis, value, lower, upper) down to cells, numbered from ``first``; ``weight``: words for each point."""
    if len(points) * weight > cell and len(points) > 1 and (cut_at := split(points)):
        low = points[:, cut_at[0]] <= cut_at[1]
        lower = top_tree(points[low], weight, cell, first)
        return (*cut_at, lower, top_tree(points[~low], weight, cell, last_cell(lower) + 1))
    return (first,)


def last_cell(tree: tuple) -> int:
    return tree[0] if len(tree) == 1 else last_cell(tree[3])


def reach(tree: tuple, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(cell, rows of ``points`` within ``radius`` of its box, their distances to it)."""

    def walk(node: tuple, rows: np.ndarray, dist: np.ndarray, box: dict) -> Iterator:
        if len(node) == 1:
            yield node[0], rows, dist
            return
        axis, value, lower, upper = node
        lo, hi = box.get(axis, (0, 1 << 14))
        x = points[rows, axis].astype(np.int64)
        was = np.maximum(lo - x, 0) + np.maximum(x - hi, 0)
        for child, side in ((lower, (lo, value)), (upper, (value + 1, hi))):
            d = dist - was + np.maximum(side[0] - x, 0) + np.maximum(x - side[1], 0)
            if (near := d <= radius).any():
                yield from walk(child, rows[near], d[near], {**box, axis: side})

    yield from walk(tree, np.arange(len(points)), np.zeros(len(points), np.int64), {})


def one_edit(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which rows of letters ``q`` (a) and ``p`` (b) are one replaced (equal lengths) or inserted (p longer) letter apart."""
    if q.shape[1] == p.shape[1]:
        return (q[:, None] != p[None]).sum(2) == 1
    n = q.shape[1]
    from_start, from_end = q[:, None] != p[None, :, :n], (q[:, None] != p[None, :, 1:])[:, :, ::-1]
    same_start = np.where(from_start.any(2), from_start.argmax(2), n)
    same_end = np.where(from_end.any(2), from_end.argmax(2), n)
    return same_start + same_end >= n


def search(p: np.ndarray, q: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``q``, rows of ``p``) of all pairs one edit apart; letters of equally long words each."""
    if not len(p) or not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pc, qc = counts(p), counts(q)
    radius, found = 2 if p.shape[1] == q.shape[1] else 1, []

    def compare(ps: np.ndarray, qs: np.ndarray) -> None:
        step = max(1, BLOCK // (len(ps) * p.shape[1]))
        for i in range(0, len(qs), step):
            a, b = np.nonzero(one_edit(q[qs[i : i + step]], p[ps]))
            found.append((qs[i : i + step][a], ps[b]))

    def halves(ps: np.ndarray, qs: np.ndarray) -> None:
        half = q.shape[1] // 2
        for mine, theirs in ((q[:, :half], p[:, :half]), (q[:, half:], p[:, p.shape[1] - (q.shape[1] - half) :])):
            by: dict[bytes, tuple[list, list]] = {}
            for i in ps:
                by.setdefault(theirs[i].tobytes(), ([], []))[0].append(i)
            for i in qs:
                if group := by.get(mine[i].tobytes()):
                    group[1].append(i)
            for a, b in by.values():
                if b:
                    compare(np.array(a), np.array(b))

    def visit(ps: np.ndarray, qs: np.ndarray) -> None:
        lo, hi = pc[ps].min(0), pc[ps].max(0)
        x = qc[qs]
        qs = qs[(np.maximum(lo - x, 0) + np.maximum(x - hi, 0)).sum(1) <= radius]
        if not len(qs):
            return
        if len(ps) <= leaf:
            compare(ps, qs)
        elif cut_at := split(pc[ps]):
            low = pc[ps, cut_at[0]] <= cut_at[1]
            visit(ps[low], qs)
            visit(ps[~low], qs)
        else:
            halves(ps, qs)

    visit(np.arange(len(p)), np.arange(len(q)))
    a, b = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
    pairs = np.unique(a.astype(np.int64) * len(p) + b)  # an insertion within a run of one letter fits both halves
    return pairs // len(p), pairs % len(p)


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, near_n, near: distinct ``words`` (word, n) with the number of words one edit away and, of these, the
    one of the largest n (ties: the first in code-point order; null if none). Null and empty words are left out."""
    words = words.filter("word <> ''").select("word", F.col("n").cast("long").alias("n"))
    total = words.count()
    some = words.filter(F.pmod(F.xxhash64("word"), F.lit(max(1, total))) < SAMPLE)  # about as many, by hash: no task sends more than its share
    sample = [r["word"] for r in some.select("word").collect()]
    trees, first, weight = {}, 0, total / max(1, len(sample))
    by_length: dict[int, list[str]] = {}
    for w in sample:
        by_length.setdefault(len(w), []).append(w)
    for length in sorted(by_length):
        trees[length] = top_tree(counts(letters(by_length[length], length)), weight, CELL, first)
        first = last_cell(trees[length]) + 1
    # lengths that the sample has no word of are one cell each, after all others
    held = words.sparkSession.sparkContext.broadcast((trees, first))

    def tree_of(length: int) -> tuple:
        trees, first = held.value
        return trees.get(length) or (first + length,)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            lengths = np.array([len(w) for w in text], np.int64)
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                points = counts(letters([text[i] for i in at], length))
                for to, radius in ((length, 2), (length + 1, 1)):
                    for cell, rows, dist in reach(tree_of(to), points, radius):
                        role = np.where(dist == 0, HOME, SAME) if to == length else np.full(len(rows), LONGER)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), cell), pa.int64()), pa.array(role, pa.int32()), pa.array([text[i] for i in at[rows]], pa.string()), pa.array(n[at[rows]], pa.int64())], ["cell", "role", "word", "n"])

    def meet(cell: pa.Table) -> pa.Table:
        role, text, n = cell.column("role").to_numpy(), cell.column("word").to_pylist(), cell.column("n").to_numpy()
        place = np.empty(len(text), np.int64)
        place[sorted(range(len(text)), key=text.__getitem__)] = np.arange(len(text))
        home = np.flatnonzero(role == HOME)
        mine, other = [], []
        if len(home):
            length = len(text[home[0]])
            p = letters([text[i] for i in home], length)
            for asks in (np.flatnonzero(role != LONGER), np.flatnonzero(role == LONGER)):
                q = letters([text[i] for i in asks], len(text[asks[0]])) if len(asks) else p[:0]
                a, b = search(p, q)
                mine.append(asks[a])
                other.append(home[b])
                if len(asks) and q.shape[1] < length:  # seen from both sides; equal lengths meet from both by themselves
                    mine.append(home[b])
                    other.append(asks[a])
        mine, other = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (mine, other))
        near = np.bincount(mine, minlength=len(text))
        order = np.lexsort((place[other], -n[other], mine))
        first = order[np.unique(mine[order], return_index=True)[1]]
        best = np.full(len(text), -1)
        best[mine[first]] = other[first]
        told = np.flatnonzero((near > 0) | (role == HOME))
        names = [text[best[i]] if best[i] >= 0 else None for i in told]
        best_n = pa.array(np.where(best[told] >= 0, n[best[told]], 0), pa.int64(), mask=best[told] < 0)
        return pa.table({"word": pa.array([text[i] for i in told], pa.string()), "n": pa.array(n[told], pa.int64()), "n_near": pa.array(near[told], pa.int64()), "near_n": best_n, "near": pa.array(names, pa.string())})

    cells = words.mapInArrow(route, "cell long, role int, word string, n long").groupBy("cell")
    parts = cells.applyInArrow(meet, "word string, n long, n_near long, near_n long, near string")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("minus"), "near")))
    out = parts.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("_best"))
    return out.select("word", "n", "n_near", (-F.col("_best.minus")).alias("near_n"), F.col("_best.near").alias("near"))


def with_roots(words: DataFrame) -> DataFrame:
    """``words`` (word, form, ...) with root: forms followed to the last, the word itself if it has none. Each round joins
    links with links, so it halves the way; forms must not lead in a circle."""
    links = cut(words.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        up = links.select(F.col("word").alias("root"), F.col("root").alias("up"))
        links = cut(links.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "forms")
        if links.filter("moved").isEmpty():
            break
        links = links.drop("moved")
    return words.join(links.drop("moved"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(words: DataFrame, *, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct ``words`` (word, n): a word's form is its near word of the largest n,
    if that is at least ``times`` (more than 1) as large as its own; else null, as is form_n."""
    is_form = F.col("near_n") >= F.col("n") * times

    def of(c: str) -> Column:
        return F.when(is_form, F.col(c))

    near = cut(near_words(words).select("word", of("near").alias("form"), "n", "n_near", of("near_n").alias("form_n")), "near-words")
    return with_roots(near).select("word", "form", "root", "n", "n_near", "form_n")
