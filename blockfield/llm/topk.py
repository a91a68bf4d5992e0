"""Exact nearest coefficient blocks by integer inner product, with block-at-a-time pruning.

Blocks are vectors of coefficients.  They are packed into document-range blocks (pages, to keep the names apart): a page
holds up to PAGE blocks that follow each other by the signs of their first coefficients and then by key, as one forward
matrix, and per coefficient its maximum and minimum.  A query's bound for a page is the sum over its coefficients of the
larger product with the two.  Only the maxima and minima meet all queries.  Every query scores the page of its best bound
first; that gives it a k-th score, and pages go to a group of queries only where a bound is not below it.  There each query
takes them in the order of its own bounds until one is below its k-th score; an equal bound is scored, as ties go to the
smaller id.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockfield.llm.shared import partitions, scaled, staged

PAGE = 1024
#: Pages of one shelf and queries of one group: a shelf and a group are what one task holds at a time.
SHELF = 32
GROUP = 512
#: Pages whose maxima and minima meet a group in one place.
BOUNDS = 4096
#: Coefficients whose signs order the blocks.
SIGNS = 16
PACKED = "page bigint, n int, width int, ids binary, forward binary, high binary, low binary"


def _pack(size: int):
    """Consecutive rows (key, vector) as pages of up to ``size``; shorter vectors are padded with zeros."""
    def page(number: int, keys: list, vectors: list) -> pa.RecordBatch:
        width = max(map(len, vectors))
        forward = np.zeros((len(keys), width), np.int64)
        for row, v in zip(forward, vectors):
            row[: len(v)] = v
        values = [number, len(keys), width, np.array(keys, np.int64).tobytes(), _narrow(forward).tobytes(), forward.max(0, initial=-(1 << 62)).tobytes(), forward.min(0, initial=1 << 62).tobytes()]
        types = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["page", "n", "width", "ids", "forward", "high", "low"])

    def step(batches):
        from pyspark import TaskContext

        number, keys, vectors = TaskContext.get().partitionId() << 32, [], []
        for batch in batches:
            for key, vector in zip(*(c.to_pylist() for c in batch.columns)):
                keys.append(key)
                vectors.append(vector)
                if len(keys) == size:
                    yield page(number, keys, vectors)
                    number, keys, vectors = number + 1, [], []
        if keys:
            yield page(number, keys, vectors)

    return step


def _narrow(m: np.ndarray) -> np.ndarray:
    """The matrix in the smallest of three integer types that hold it; its bytes tell which."""
    for kind in (np.int16, np.int32):
        if (m == m.astype(kind)).all():
            return m.astype(kind)
    return m


def sign_code(v: str) -> Column:
    """Signs of the first coefficients as a number: vectors of like direction stand together in its order."""
    bits = [F.when(F.coalesce(F.get(v, F.lit(i)), F.lit(0)) > 0, F.lit(1 << (SIGNS - 1 - i))).otherwise(F.lit(0)) for i in range(SIGNS)]
    return sum(bits[1:], bits[0])


def packed(rows: DataFrame, size: int, parts: int, *order: Column) -> DataFrame:
    """Rows (key, v) as pages, dealt out by ranges of the order, the key and the row, so no key has to fit one task."""
    numbered = rows.select("key", "v", *[c.alias(f"_o{i}") for i, c in enumerate(order)], F.monotonically_increasing_id().alias("_row"))
    by = [*[f"_o{i}" for i in range(len(order))], "key", "_row"]
    return numbered.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("key", "v").mapInArrow(_pack(size), PACKED)


def _matrix(data: bytes, n: int, width: int, to: int) -> np.ndarray:
    m = np.frombuffer(data, {2: np.int16, 4: np.int32}.get(len(data) // max(1, n * width), np.int64)).reshape(n, width).astype(np.int64)
    return np.pad(m, ((0, 0), (0, to - width))) if width < to else m


def _kind(*matrices: np.ndarray):
    """The fastest exact arithmetic: float64 while sums stay below 2^53, then int64, then Python integers."""
    top = [max((abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))) for m in matrices]
    bound = top[0] * max(top[1:]) * max(1, matrices[0].shape[1])
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


def page_bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """No block of page p has a greater product with query q than the bound [q, p]."""
    kind = _kind(queries, high, low)
    q = queries.astype(kind)
    return np.maximum(q, 0) @ high.astype(kind).T + np.minimum(q, 0) @ low.astype(kind).T


def best_of_pages(ids: np.ndarray, queries: np.ndarray, pages: list[tuple], k: int, floors: list | None = None, skip: np.ndarray | None = None):
    """(query row, id, score) lists of each query's k best over the pages (ids, forward, high, low); the query's own id is left out.

    ``floors`` are k-th scores known before, or None; ``skip[q, p]`` marks pages that a query has had already.  What stays
    below a floor may be left out.
    """
    high, low = np.array([p[2] for p in pages]), np.array([p[3] for p in pages])
    kind = _kind(queries, high, low)
    q = queries.astype(kind)
    bounds = page_bounds(queries, high, low)
    best = [[] for _ in ids]  # (-score, id), ascending
    floor = list(floors) if floors is not None else [None] * len(ids)

    def score(p: int, rows: np.ndarray) -> None:
        own, forward = pages[p][0], pages[p][1].astype(kind)
        found = q[rows] @ forward.T
        for r, values in zip(rows.tolist(), found):
            others = own != ids[r]
            names, values = own[others], values[others]
            least = floor[r]
            if least is None and len(values) > k:
                least = np.partition(values, len(values) - k)[len(values) - k]
            hit = np.flatnonzero(values >= least) if least is not None else np.arange(len(values))
            if len(hit):
                best[r] = sorted(best[r] + [(-int(values[h]), int(names[h])) for h in hit])[:k]
            if len(best[r]) == k and (floor[r] is None or -best[r][-1][0] > floor[r]):
                floor[r] = -best[r][-1][0]

    order = np.argsort(-bounds, axis=1, kind="stable")
    open_ = np.arange(len(ids))
    for turn in range(len(pages)):  # every query takes its own next page
        page = order[open_, turn]
        go = np.array([floor[r] is None or bounds[r, p] >= floor[r] for r, p in zip(open_.tolist(), page.tolist())], bool)
        open_, page = open_[go], page[go]
        if not len(open_):
            break
        due = np.ones(len(open_), bool) if skip is None else ~skip[open_, page]
        for p in np.unique(page[due]).tolist():
            score(p, open_[due & (page == p)])
    flat = [(r, i, -s) for r, found in enumerate(best) for s, i in found]
    return [list(c) for c in zip(*flat)] if flat else [[], [], []]


def _pages_of(rows: list[dict], width: int) -> list[tuple]:
    return [(np.frombuffer(o["ids"], np.int64), *(_matrix(o[c], n, o["width"], width) if c == "forward" else _matrix(o[c], n, o["width"], width)[0] for c, n in (("forward", o["n"]), ("high", 1), ("low", 1)))) for o in rows]


def nearest_blocks(queries: DataFrame, blocks: DataFrame, k: int = 5, key: str = "block", vector: str = "coefficients",
                   page: int = PAGE, shelf: int = SHELF, group: int = GROUP) -> DataFrame:
    """(query_id, rank, key, score): for every query row the k blocks of highest inner product, ties to the smaller id.

    ``queries`` and ``blocks`` hold (block, coefficients ARRAY<BIGINT>).  Rows whose key, vector or any coefficient is null
    take no part; a missing coefficient of a shorter vector counts as zero; blocks with the query's own key are left out;
    repeated query rows are answered each, repeated blocks compete each; fewer than k blocks give fewer rows; other
    columns are not read; empty tables give an empty one.  Scores must fit 64 bits.

    Maxima and minima of all pages meet all groups of queries, 1 / PAGE of what the pages hold; pages themselves travel to
    the queries whose best bound they have, and to the groups with a bound that reaches a k-th score.  What a task holds
    is bounded by the sizes of a group, a shelf and a shelf of bounds.
    """
    def valid(df: DataFrame) -> DataFrame:
        v = F.col(vector)
        rows = df.select(F.col(key).cast("bigint").alias("key"), v.cast("array<bigint>").alias("v"))
        return rows.where(F.col("key").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))

    asked = valid(queries)
    pages = staged(packed(valid(blocks), page, partitions(blocks.sparkSession), sign_code("v")))
    groups = packed(asked, group, scaled(asked.count(), group), sign_code("v")).withColumnRenamed("page", "_part")
    groups = staged(groups)
    numbers = groups.select("_part", (F.row_number().over(Window.orderBy("_part")) - 1).cast("int").alias("grp"))
    groups = staged(groups.join(numbers, "_part").drop("_part"))
    n_pages, n_groups = pages.count(), numbers.count()
    n_shelves, n_bounds = scaled(n_pages, shelf), scaled(n_pages, BOUNDS)
    on = lambda n, c: F.pmod(F.xxhash64("page"), F.lit(n)).cast("int").alias(c)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
    bounds = pages.select("page", "width", "high", "low", on(n_bounds, "b_shelf")).select("*", every(n_groups).alias("b_grp"))

    def vectors(r: dict, width: int):
        return np.frombuffer(r["ids"], np.int64), _matrix(r["forward"], r["n"], r["width"], width)

    def bound_table(mine: list[dict], others: list[dict]):
        width = max(r["width"] for r in mine + others)
        high, low = (np.concatenate([_matrix(o[c], 1, o["width"], width) for o in others]) for c in ("high", "low"))
        return [(r, page_bounds(vectors(r, width)[1], high, low)) for r in mine]

    def first(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        """Of the pages of one shelf of bounds, the one with the best bound of each query."""
        rows, others = mine.to_pylist(), theirs.to_pylist()
        out = [[], [], []]
        for r, b in bound_table(rows, others) if rows and others else ():
            at = b.argmax(1)
            out[0] += [r["grp"] * group + i for i in range(r["n"])]
            out[1] += [max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in b.max(1)]
            out[2] += [others[x]["page"] for x in at.tolist()]
        return pa.table([pa.array(c, pa.int64()) for c in out], ["row", "bound", "page"])

    spread = groups.select("*", every(n_bounds).alias("shelf"))
    firsts = spread.groupBy("shelf", "grp").cogroup(bounds.groupBy("b_shelf", "b_grp")).applyInArrow(first, "row bigint, bound bigint, page bigint")
    seeds = firsts.groupBy("row").agg(F.max_by("page", F.struct("bound", "page")).alias("page"))
    seeds = staged(seeds.select("row", "page", F.floor(F.col("row") / group).cast("int").alias("grp")))

    def by_group(pairs: DataFrame, fn, schema: str) -> DataFrame:
        """Groups of queries meet shelves of the pages that ``pairs`` (grp, page) names for them."""
        shelved = pairs.withColumn("shelf", on(n_shelves, "shelf"))
        wanted = shelved.join(pages, "page")
        meeting = shelved.select(F.col("grp").alias("g"), F.col("shelf").alias("s")).distinct()
        mine = meeting.join(known, F.col("g") == F.col("grp")).drop("g")
        return mine.groupBy("grp", "s").cogroup(wanted.groupBy("grp", "shelf")).applyInArrow(fn, schema)

    def scored(start: bool):
        def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            rows, others = mine.to_pylist(), theirs.to_pylist()
            out = [[], [], [], []]
            for r in rows if others else ():
                width = max(o["width"] for o in [r, *others])
                ids, q = vectors(r, width)
                own = np.array(r["seeds"], np.int64)[:, None] == np.array([o["page"] for o in others])
                found = best_of_pages(ids, q, _pages_of(others, width), k, None if start else r["floors"], ~own if start else own)
                out[0] += [r["grp"] * group + x for x in found[0]]
                out[1] += ids[found[0]].tolist() if found[0] else []
                out[2] += found[1]
                out[3] += found[2]
            return pa.table([pa.array(c, pa.int64()) for c in out], ["row", "query_id", "found", "score"])

        return meet

    listed = lambda df, c, name: df.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", c))), lambda x: x[c]).alias(name))
    results = "row bigint, query_id bigint, found bigint, score bigint"
    known = groups.join(listed(seeds, "page", "seeds"), "grp")
    began = staged(by_group(seeds.select("grp", "page").distinct(), scored(True), results))
    kth = began.groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    floors = seeds.join(kth, "row", "left").select("row", "grp", F.struct("floor").alias("f"))
    known = staged(known.join(listed(floors, "f", "floors"), "grp").withColumn("floors", F.transform("floors", lambda f: f["floor"])))

    def reached(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        """Pages with a bound that reaches some query's k-th score, but for the query's first page."""
        rows, others = mine.to_pylist(), theirs.to_pylist()
        out = [[], []]
        names = np.array([o["page"] for o in others], np.int64)
        for r, b in bound_table(rows, others) if rows and others else ():
            least = np.array([-np.inf if f is None else f for f in r["floors"]], object)[:, None]
            on_ = ((b >= least) & (np.array(r["seeds"], np.int64)[:, None] != names)).any(0)
            out[0] += [r["grp"]] * int(on_.sum())
            out[1] += names[on_].tolist()
        return pa.table([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64())], ["grp", "page"])

    again = known.select("*", every(n_bounds).alias("shelf"))
    pairs = staged(again.groupBy("shelf", "grp").cogroup(bounds.groupBy("b_shelf", "b_grp")).applyInArrow(reached, "grp int, page bigint"))
    met = began.union(by_group(pairs, scored(False), results))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "found"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("found").alias(key), "score")
