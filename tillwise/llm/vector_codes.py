"""Vector code compression: product codes learned through metric trees of the anchors hierarchy.

Vectors are cut into equal parts and each part is replaced by the index of the nearest entry of its codebook. The rows
are taken in blocks; over each part of a block a metric tree is grown middle-out: some anchors, each new one the point
farthest from its own, take the points nearer to them than to their old anchors (points too near to their own are
never asked, by the triangle inequality); the anchors' balls are joined pair by pair into the upper tree and split
further below by the same steps. Each ball caches the number and the sum of its points. A round of assignment passes the
codebook down the tree: a ball hands on only the entries that can still be nearest to one of its points, and once one
entry is left, the whole ball is its: the cached sum counts, no point is touched. Everything that decides is whole
numbers; bounds in floating point are only used with a margin.

Trees are written once and read in each round. A round sends (part, entry, count, sum) from each task, at most one row per
entry, so that nothing that grows with the data is shuffled until the label totals.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tillwise.session import settle

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors in a block of trees, and points in a ball that is not split further.
BLOCK, LEAF = 4096, 12
#: Relative margin of the bounds computed in floating point.
MARGIN = 1e-9


def whole(x: np.ndarray, dim: int) -> np.ndarray:
    """floor(SCALE * x) as 64-bit numbers. They are held below a bound at which the squared distance of two vectors of
    ``dim`` components still fits in 64 bits: larger components count as the bound."""
    most = most_component(dim)
    with np.errstate(over="ignore"):
        return np.floor(np.clip(x * float(SCALE), -most, most)).astype(np.int64)


def most_component(dim: int) -> int:
    """2^k with dim * (2 * 2^k)^2 < 2^62, and small enough for exact products of sums in double precision."""
    return 1 << max(8, min(28, (60 - max(1, dim).bit_length()) // 2))


class Tree:
    """A metric tree over points: ``order`` lists the points so that each ball is a range of them."""

    FIELDS = ("order", "first", "last", "left", "right", "radius", "sums", "center")

    def __init__(self, points: np.ndarray):
        self.points = points.astype(float)
        self.nodes: list[list] = []  # [points, left, right]
        self.balls: dict[int, tuple[np.ndarray, float]] = {}  # (center, radius) of a node
        root = self.grow(np.arange(len(points)))
        self.lay_out(points, root)

    def grow(self, at: np.ndarray) -> int:
        """The ball of the points ``at``: anchors, joined into one tree, each split further."""
        if len(at) <= LEAF:
            return self.add(at)
        groups = self.anchors(at)
        if len(groups) == 1:  # all points are alike
            return self.add(at)
        return self.join([(g, self.grow(g)) for g in groups])

    def add(self, at: np.ndarray, left: int = -1, right: int = -1) -> int:
        self.nodes.append([at, left, right])
        return len(self.nodes) - 1

    def ball(self, at: np.ndarray, node: int) -> tuple[np.ndarray, float]:
        """The middle of the points of a node, and how far the farthest is from it."""
        if node not in self.balls:
            x = self.points[at]
            center = x.sum(axis=0) / len(at)
            x -= center
            self.balls[node] = center, float(np.einsum("ij,ij->i", x, x).max()) ** 0.5
        return self.balls[node]

    def anchors(self, at: np.ndarray) -> list[np.ndarray]:
        """About sqrt(n) groups of points, each nearest to its own anchor."""
        x = self.points[at]
        owner = np.zeros(len(at), np.int64)
        places = [0]
        own = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
        for k in range(1, max(2, int(len(at) ** 0.5))):
            far = int(own.argmax())
            if own[far] == 0:
                break
            between = np.sqrt(((x[places] - x[far]) ** 2).sum(axis=1))
            # Only a point farther from its anchor than half the way to the new one can be nearer to the new one.
            asked = np.flatnonzero(own * 2 >= between[owner])
            new = np.sqrt(((x[asked] - x[far]) ** 2).sum(axis=1))
            taken = new < own[asked]
            owner[asked[taken]], own[asked[taken]] = k, new[taken]
            places.append(far)
        return [g for g in (at[owner == k] for k in range(len(places))) if len(g)]

    def join(self, groups: list[tuple[np.ndarray, int]]) -> int:
        """Joins the two balls whose common ball is smallest until one is left."""
        live: dict[int, tuple[np.ndarray, int, np.ndarray, float]] = {}

        def ball(at: np.ndarray, node: int) -> tuple:
            return at, node, *self.ball(at, node)

        queue: list[tuple[float, int, int]] = []

        def offer(k: int) -> None:
            others = [j for j in live if j != k]
            if others:
                gap = np.sqrt(((np.array([live[j][2] for j in others]) - live[k][2]) ** 2).sum(axis=1))
                radius = np.array([live[j][3] for j in others])
                size = np.maximum(np.maximum(radius, live[k][3]), (gap + radius + live[k][3]) / 2)
                best = int(size.argmin())
                heapq.heappush(queue, (float(size[best]), k, others[best]))

        for k, (at, node) in enumerate(groups):
            live[k] = ball(at, node)
            offer(k)
        fresh = len(groups)
        while len(live) > 1:
            _, a, b = heapq.heappop(queue)
            if a in live and b in live:
                (at_a, node_a, *_), (at_b, node_b, *_) = live.pop(a), live.pop(b)
                at = np.concatenate([at_a, at_b])
                live[fresh] = ball(at, self.add(at, node_a, node_b))
                offer(fresh)
                fresh += 1
            elif a in live:
                offer(a)
        return next(iter(live.values()))[1]

    def lay_out(self, points: np.ndarray, root: int) -> None:
        """Numbers the balls from the root down and puts the points of each ball side by side."""
        ids, stack, leaves = {}, [root], []
        while stack:
            node = stack.pop()
            ids[node] = len(ids)
            at, left, right = self.nodes[node]
            if left < 0:
                leaves.append(at)
            else:
                stack += [right, left]
        self.order = np.concatenate(leaves).astype(np.int32)
        place = np.empty(len(points), np.int64)
        place[self.order] = np.arange(len(points))
        n, size = len(ids), points.shape[1]
        self.first, self.last, self.left, self.right = (np.full(n, -1, np.int32) for _ in range(4))
        self.radius, self.sums, self.center = np.zeros(n), np.zeros((n, size), np.int64), np.zeros((n, size))
        upto = np.zeros((len(points) + 1, size), np.int64)
        np.cumsum(points[self.order], axis=0, out=upto[1:])
        for node, k in ids.items():
            at, left, right = self.nodes[node]
            self.first[k] = place[at].min()
            self.last[k] = self.first[k] + len(at)
            if left >= 0:
                self.left[k], self.right[k] = ids[left], ids[right]
            self.center[k], self.radius[k] = self.ball(at, node)
        self.sums[:] = upto[self.last] - upto[self.first]


def owners(tree: dict[str, np.ndarray], points: np.ndarray, book: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(balls with their only entry left, points that no such ball holds, entries of those points).

    Goes down level by level; a ball inherits the candidate entries of the ball above.
    """
    entry = book.astype(float)
    gaps = np.sqrt(((entry[:, None, :] - entry[None, :, :]) ** 2).sum(axis=2))
    balls, candidates = np.zeros(1, np.int64), np.zeros((1, len(book)), bool)
    candidates[0, np.unique(book, axis=0, return_index=True)[1]] = True  # of equal entries only the first can win
    owned, loose, chosen = [], [], []
    while len(balls):
        center, radius = tree["center"][balls], tree["radius"][balls]
        d = ((center[:, None, :] - entry[None, :, :]) ** 2).sum(axis=2)
        best = np.where(candidates, d, np.inf).argmin(axis=1)
        nearest = d[np.arange(len(balls)), best]
        # An entry is out if the whole ball lies on the best one's side of the plane between the two.
        out = d - nearest[:, None] > 2 * radius[:, None] * gaps[best] + MARGIN * (d + 1)
        candidates = candidates & ~out
        one = candidates.sum(axis=1) == 1
        owned += zip(balls[one].tolist(), best[one].tolist())
        leaf = ~one & (tree["left"][balls] < 0)
        for b, mask in zip(balls[leaf].tolist(), candidates[leaf]):
            at = tree["order"][tree["first"][b]:tree["last"][b]]
            left = np.flatnonzero(mask)
            loose.append(at)
            chosen.append(left[((points[at][:, None, :] - book[left][None, :, :]) ** 2).sum(axis=2).argmin(axis=1)])
        more = ~one & ~leaf
        balls = np.concatenate([tree["left"][balls[more]], tree["right"][balls[more]]]).astype(np.int64)
        candidates = np.concatenate([candidates[more]] * 2)
    none = np.zeros(0, np.int64)
    return owned, np.concatenate(loose) if loose else none, np.concatenate(chosen) if chosen else none


def totals(tree: dict[str, np.ndarray], points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, sum) per entry: cached figures of owned balls, and the loose points one by one."""
    count, sums = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
    owned, loose, chosen = owners(tree, points, book)
    for ball, e in owned:
        count[e] += tree["last"][ball] - tree["first"][ball]
        sums[e] += tree["sums"][ball]
    np.add.at(count, chosen, 1)
    np.add.at(sums, chosen, points[loose])
    return count, sums


def codes(tree: dict[str, np.ndarray], points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each point."""
    out = np.empty(len(points), np.int64)
    owned, loose, chosen = owners(tree, points, book)
    for ball, e in owned:
        out[tree["order"][tree["first"][ball]:tree["last"][ball]]] = e
    out[loose] = chosen
    return out, ((points - book[out]) ** 2).sum(axis=1)


def usable(vector: Column, parts: int = PARTS) -> Column:
    """Vectors without null and non-finite components that can be cut into ``parts`` equal parts."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & (F.size(vector) > 0) & (F.size(vector) % parts == 0), F.lit(False))


def _pack(tree: Tree, points: np.ndarray) -> dict[str, bytes]:
    return {name: getattr(tree, name).tobytes() for name in Tree.FIELDS} | {"points": points.astype("<i4").tobytes()}


def _unpack(row: dict, size: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    kinds = {"radius": float, "center": float, "sums": np.int64}
    tree = {name: np.frombuffer(row[name], kinds.get(name, np.int32)) for name in Tree.FIELDS}
    tree |= {name: tree[name].reshape(-1, size) for name in ("sums", "center")}
    return tree, np.frombuffer(row["points"], "<i4").astype(np.int64).reshape(-1, size)


def trees(rows: DataFrame, dim: int, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """One row per ``block`` vectors of ``rows`` (vec_id, label, vector): ids, labels and a tree per part, settled."""
    size = dim // parts
    names = [*Tree.FIELDS, "points"]

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, block):
                part = batch.slice(first, block)
                x = whole(part.column(2).flatten().to_numpy(zero_copy_only=False).astype(float), dim).reshape(-1, parts, size)
                grove = [_pack(Tree(x[:, p]), x[:, p]) for p in range(parts)]
                ids, labels = (pa.array([part.column(c).to_pylist()], pa.list_(batch.schema.field(c).type)) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([grove], kind)], names=["ids", "labels", "trees"])

    kind = pa.list_(pa.struct([(name, pa.binary()) for name in names]))
    tree = T.StructType([T.StructField(name, T.BinaryType()) for name in names])
    id_type, label_type = (rows.schema[c].dataType for c in ("vec_id", "label"))
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("labels", T.ArrayType(label_type)), T.StructField("trees", T.ArrayType(tree))])
    return settle(rows.select("vec_id", "label", "vector").mapInArrow(grown, schema))


def _first_books(rows: DataFrame, dim: int, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors of the smallest ids, ascending: (part, entry, component). At most ``entries`` rows come here."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector").asc()]
    first = [r.vector for r in rows.orderBy(*order).limit(entries).collect()]
    return whole(np.array(first, float), dim).reshape(len(first), parts, -1).transpose(1, 0, 2)


def _next_books(grove: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: each entry becomes the componentwise floor of the mean of its parts; unused entries stay."""
    parts, entries, size = books.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for row in batch.column(0).to_pylist():
                for p, one in enumerate(row):
                    n, s = totals(*_unpack(one, size), books[p])
                    count[p] += n
                    sums[p] += s
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )

    rows = grove.select("trees").mapInArrow(summed, "part int, entry int, n long, sums array<long>")
    exact = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(size)]
    rows = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*exact).alias("sums"))
    new = books.copy()
    for r in rows.collect():  # at most one row per entry
        new[r.part, r.entry] = [int(s) // r.n for s in r.sums]
    return new


def _coded(grove: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of each vector."""
    size = books.shape[2]
    digits = np.array([f"{e:02x}" for e in range(books.shape[1])])
    id_type, label_type = (grove.schema[c].dataType.elementType for c in ("ids", "labels"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, row in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                error, text = np.zeros(len(ids), np.int64), []
                for p, one in enumerate(row):
                    e, d = codes(*_unpack(one, size), books[p])
                    text.append(digits[e])
                    error += d
                yield pa.RecordBatch.from_arrays(
                    [ids.values, labels.values, pa.array(["".join(t) for t in zip(*text)], pa.string()), pa.array(error)],
                    names=["vec_id", "label", "code", "error"],
                )

    schema = T.StructType([
        T.StructField("vec_id", id_type), T.StructField("label", label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()),
    ])
    return grove.select("ids", "labels", "trees").mapInArrow(work, schema)


def vector_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK,
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error, label_error) per vector, codebooks as (part, entry, component)).

    Left out are vectors that are null or hold null or non-finite components, those whose length is no multiple of
    ``parts``, and those of another length than the vector of the smallest vec_id. Repeated rows count each; of equal ids
    the smaller vector comes first, null ids come last; with fewer vectors than ``entries`` the codebooks are
    shorter. Components beyond ``most_component`` count as that bound. label_error sums the errors of equal labels,
    nulls together, up to the largest 64-bit number. Without vectors the result is empty. Other columns are ignored.
    """
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", "label", vector.alias("vector")).where(usable(vector, parts))
    lead = rows.orderBy(F.col("vec_id").asc_nulls_last(), F.col("vector").asc()).select(F.size("vector")).first()
    dim = lead[0] if lead else parts
    rows = rows.where(F.size("vector") == dim)
    books = _first_books(rows, dim, parts, entries) if lead else np.zeros((parts, 1, 1), np.int64)
    grove = trees(rows, dim, parts, block)
    for _ in range(rounds):
        books = _next_books(grove, books)
    coded = settle(_coded(grove, books))
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    out = coded.join(sums, coded["label"].eqNullSafe(sums["of"])).select("vec_id", "label", "code", "error", "label_error")
    return out, books if lead else books[:, :0]
