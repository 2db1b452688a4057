"""NTILE over a whole relation without sorting or moving it.

``F.ntile(n).over(Window.orderBy(...))`` plans ``Exchange SinglePartition``:
every row goes to one task. NTILE needs only the first row of each tile, so
:func:`with_ntiles` finds those rows exactly and compares every row with them:

1. One aggregate counts the rows and builds a quantile sketch (KLL, mergeable, of bounded
   size) of each leading sort key, as a number that follows its order
   (:func:`salescope.operators.ranges.digits`). The sketch proposes a narrow range of that
   number for each tile's first row.
2. One aggregate counts the rows below and within the proposed ranges exactly, and sorts
   the keys of those that the sketch says are short; the row at the position is the tile's
   first.
3. A range that is still long, because of ties or of a very large relation, is sketched
   again within its limits: by the same number, or, where the range is one value, by the
   next one (the next characters of a text, the next sort key). All tile columns and
   tiles go through the same rounds. Where no number is left to tell rows apart (texts
   with the same first 48 bytes), a sorted hash sample of the range proposes.
4. The tile of a row is one more than the number of first rows it reaches: a
   projection with ``n - 1`` literals.

Two passes over the rows do where ties are shorter than ``range_rows``.
Sort order follows Spark defaults: ascending puts NULLs first, descending
puts them last.
"""

from __future__ import annotations

import bisect
import datetime as dt
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescope.operators.ranges import digits
from salescope.plans.session import materialize

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: So many cuts share a pass over the rows, to keep its plan small.
CUTS_A_PASS = 16
#: Steps of the quantiles that a sketch is asked for.
GRID = 512
#: From here on :func:`digits` may give different values the same number.
SHARED = 8 * 10**18


@dataclass(frozen=True)
class TileSpec:
    n: int
    order: tuple  # ((column, ascending), ...)
    out: str


def _components(df: DataFrame, order) -> list[Column]:
    """The sort key as columns that all sort ascending with NULLs first."""
    comps = []
    for c, asc in order:
        if asc:
            comps.append(F.col(c))
        else:
            if not isinstance(df.schema[c].dataType, NUMERIC):
                raise TypeError(f"descending tile key {c!r} must be numeric")
            comps.append(F.col(c).isNull())  # NULLs last
            comps.append(-F.col(c))
    return comps


def _literal(value, dtype: T.DataType) -> str:
    kind = dtype.simpleString()
    if value is None:
        return f"CAST(NULL AS {kind})"
    if isinstance(value, dt.datetime):
        return f"CAST('{value.isoformat(sep=' ')}' AS {kind})"
    if isinstance(value, dt.date):
        return f"CAST('{value.isoformat()}' AS {kind})"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"CAST('{text}' AS {kind})"


def _reaches(key: str, row, schema: T.StructType) -> str:
    """SQL for ``key >= row``. Structs compare field by field with NULLs first,
    which is how the components are built."""
    fields = ", ".join(f"'{f.name}', {_literal(v, f.dataType)}" for f, v in zip(schema.fields, row, strict=True))
    return f"({key} >= named_struct({fields}))"


@dataclass
class _Cut:
    """The first row of a tile: its position, and the range that holds it. The range
    has the first ``len(fixed)`` numbers of the key as given, and the next one from
    ``least`` to ``most``; ``lo`` and ``hi`` are keys that limit it further."""

    key: str
    schema: T.StructType
    numbers: list[str]
    position: int  # rows before it
    rows: int  # rows of the range
    below: int = 0  # rows before the range
    fixed: list[int] = field(default_factory=list)
    least: int | None = None
    most: int | None = None
    lo: tuple | None = None
    hi: tuple | None = None
    found: tuple | None = None

    @property
    def number(self) -> str | None:
        return self.numbers[len(self.fixed)] if len(self.fixed) < len(self.numbers) else None

    def inside(self) -> str:
        parts = [f"{n} = {_long(v)}" for n, v in zip(self.numbers, self.fixed, strict=False)]
        if self.least is not None:
            parts.append(f"{self.number} >= {_long(self.least)}")
        if self.most is not None:
            parts.append(f"{self.number} <= {_long(self.most)}")
        if self.lo is not None:
            parts.append(_reaches(self.key, self.lo, self.schema))
        if self.hi is not None:
            parts.append(f"NOT {_reaches(self.key, self.hi, self.schema)}")
        return "(" + (" AND ".join(parts) or "TRUE") + ")"

    def narrow(self, least: int, most: int, before: int, within: int) -> None:
        """Take the part of the range that holds the position, given the exact counts of
        rows before and within ``least`` to ``most``."""
        end = self.below + self.rows
        if self.position < self.below + before:
            self.most, self.rows = least - 1, before
        elif self.position >= self.below + before + within:
            self.least, self.below = most + 1, self.below + before + within
            self.rows = end - self.below
        elif least == most:
            self.fixed, self.least, self.most = [*self.fixed, least], None, None
            if SHARED <= abs(least) < 1 << 63:  # numbers beyond share one: the next field does not tell them apart
                self.numbers = self.numbers[: len(self.fixed)]
            self.below, self.rows = self.below + before, within
        else:
            self.least, self.most, self.below, self.rows = least, most, self.below + before, within


def _long(n: int) -> str:
    return "(-9223372036854775807L - 1L)" if n == -(1 << 63) else f"{n}L"


def _key_numbers(df: DataFrame, spec: TileSpec, key: str) -> list[str]:
    """Numbers that follow the order of the key struct, from its leading field on, up to
    a field whose values may share their numbers."""
    out, at = [], 0
    for c, asc in spec.order:
        dtype = df.schema[c].dataType
        if asc:
            out += digits(f"{key}.k{at}", dtype)
            at += 1
        else:  # a NULL flag, then the negated value: NULLs last, in one number
            last = digits(f"{key}.k{at + 1}", dtype)[0]
            out.append(f"CASE WHEN {key}.k{at} THEN {(1 << 63) - 1}L ELSE {last} END")
            at += 2
        if isinstance(dtype, (T.DoubleType, T.FloatType, T.StringType)):
            break
    return out


def _starts(total: int, n: int) -> list[int]:
    """Rows before the first row of tiles 2..n, where those tiles have rows."""
    q, r = divmod(total, n)
    starts = [t * q + min(t, r) for t in range(1, n)]
    return [s for s in starts if s < total]


def _sorted_keys(keyed: DataFrame, cuts: list[_Cut], where: list[str]) -> DataFrame:
    """One row: for each cut the sorted keys (k0, k1, ...) that satisfy its condition."""
    return keyed.agg(
        *[
            F.expr(f"sort_array(collect_list(CASE WHEN {x} THEN {c.key} END))").alias(f"k{i}")
            for i, (c, x) in enumerate(zip(cuts, where, strict=True))
        ]
    )


def _narrow(keyed: DataFrame, cuts: list[_Cut], sample_rows: int, seed: int) -> None:
    """One round by a sorted hash sample, for ranges whose rows share all numbers."""
    scale = 1_000_000_000
    chosen = [
        f"{c.inside()} AND pmod(xxhash64({c.key}, {seed}), {scale}) < {-(-sample_rows * scale // c.rows)}" for c in cuts
    ]
    proposals = []
    for i, c in enumerate(cuts):
        share = (c.position - c.below) / c.rows
        # the position among m sampled keys is binomial: four deviations to both sides
        spread = f"4 * sqrt(size(k{i}) * {share * (1 - share)!r}D) + 1"
        at = [f"CAST(floor(size(k{i}) * {share!r}D + {side} * ({spread})) AS INT)" for side in (-1, 0, 1)]
        proposals.append(f"array({', '.join(f'get(k{i}, {x})' for x in at)}) AS p{i}")
    row = _sorted_keys(keyed, cuts, chosen).selectExpr(*proposals).first()
    tried = [[tuple(key) for key in row[f"p{i}"] if key is not None] for i in range(len(cuts))]
    counts = keyed.agg(
        F.lit(0).alias("none"),
        *[
            F.expr(f"count_if({c.inside()} AND NOT {_reaches(c.key, key, c.schema)})").alias(f"c{i}_{j}")
            for i, c in enumerate(cuts)
            for j, key in enumerate(tried[i])
        ],
    ).first()
    for i, c in enumerate(cuts):
        start, end = c.below, c.below + c.rows
        for j, key in enumerate(tried[i]):
            before = start + counts[f"c{i}_{j}"]
            if c.below < before <= c.position:
                c.below, c.lo = before, key
            elif c.position < before < end:
                end, c.hi = before, key
        c.rows = end - c.below


def _first_rows(keyed: DataFrame, cuts: list[_Cut]) -> list[tuple]:
    """The row at the position of each cut; ranges are small by now."""
    keys = _sorted_keys(keyed, cuts, [c.inside() for c in cuts])
    row = keys.selectExpr(*[f"k{i}[{c.position - c.below}] AS p{i}" for i, c in enumerate(cuts)]).first()
    return [tuple(key) for key in row]


def _grid(sketch: str) -> str:
    """SQL of the sketch's quantiles at GRID + 1 equal steps; NULL without rows."""
    at = ", ".join(f"{i / GRID!r}D" for i in range(GRID + 1))
    return f"CASE WHEN kll_sketch_get_n_bigint({sketch}) > 0 THEN kll_sketch_get_quantile_bigint({sketch}, array({at})) END"


def _proposal(grid: list[int], share: float, sketch_k: int) -> tuple[int, int, float]:
    """(least, most) numbers between which the row at ``share`` of the rows should lie,
    and at most how large a share of the rows is there, going by the sketch."""
    spread = 4.0 / sketch_k**0.9  # above the sketch's rank error, for either side
    least = grid[max(0, math.floor((share - spread) * GRID))]
    most = grid[min(GRID, math.ceil((share + spread) * GRID))]
    if least <= grid[0] < grid[-1] <= most:  # no narrower than the range: one of its values halves it
        least = most = grid[min(GRID, round(share * GRID))]
    steps = bisect.bisect_right(grid, most) - bisect.bisect_left(grid, least) + 1
    return least, most, steps / GRID + 2 * spread


def _sketched(keyed: DataFrame, cuts: list[_Cut], sketch_k: int) -> list[tuple[int, int, float]]:
    """Proposals for cuts from sketches of their ranges."""
    ranges = list(dict.fromkeys((c.inside(), c.number) for c in cuts))
    sketches = [
        F.expr(f"kll_sketch_agg_bigint(CASE WHEN {where} THEN {number} END, {sketch_k})").alias(f"k{i}")
        for i, (where, number) in enumerate(ranges)
    ]
    row = keyed.agg(*sketches).selectExpr(*[_grid(f"k{i}") for i in range(len(ranges))]).first()
    return [
        _proposal(row[ranges.index((c.inside(), c.number))], (c.position - c.below + 0.5) / c.rows, sketch_k) for c in cuts
    ]


def _counted(keyed: DataFrame, cuts: list[_Cut], proposed: list[tuple[int, int, float]], range_rows: int) -> None:
    """Narrow each cut by exact counts; where the proposed range is short, read its row."""
    aggs, out = [F.lit(0).alias("none")], []
    for i, (c, (least, most, share)) in enumerate(zip(cuts, proposed, strict=True)):
        here = f"{c.inside()} AND {c.number} BETWEEN {_long(least)} AND {_long(most)}"
        aggs.append(F.expr(f"count_if({c.inside()} AND {c.number} < {_long(least)})").alias(f"before{i}"))
        aggs.append(F.expr(f"count_if({here})").alias(f"within{i}"))
        out += [f"before{i}", f"within{i}"]
        if share * c.rows <= range_rows:
            aggs.append(F.expr(f"sort_array(collect_list(CASE WHEN {here} THEN {c.key} END))").alias(f"keys{i}"))
            at = c.position - c.below
            out.append(
                f"CASE WHEN {at} >= before{i} AND {at} < before{i} + within{i} THEN get(keys{i}, CAST({at} - before{i} AS INT)) END AS key{i}"
            )
    row = keyed.agg(*aggs).selectExpr(*out).first()
    for i, (c, (least, most, _)) in enumerate(zip(cuts, proposed, strict=True)):
        c.found = tuple(row[f"key{i}"]) if f"key{i}" in row and row[f"key{i}"] is not None else None
        c.narrow(least, most, row[f"before{i}"], row[f"within{i}"])


def _first_pass(keyed: DataFrame, numbers: list[list[str]], sketch_k: int) -> tuple[int, list[list[int] | None]]:
    """The number of rows, and the quantiles of each spec's leading number."""
    sketches = [F.expr(f"kll_sketch_agg_bigint({own[0]}, {sketch_k})").alias(f"k{i}") for i, own in enumerate(numbers)]
    grids = [_grid(f"k{i}") for i in range(len(numbers))]
    total, *found = keyed.agg(F.count(F.lit(1)).alias("total"), *sketches).selectExpr("total", *grids).first()
    return total, found


def _in_parts(items: list) -> list[list]:
    return [items[i : i + CUTS_A_PASS] for i in range(0, len(items), CUTS_A_PASS)]


def with_ntiles(
    df: DataFrame, specs: list[TileSpec], range_rows: int = 32_768, sketch_k: int = 4096, materialized: bool = False
) -> DataFrame:
    """Add one BIGINT tile column per spec, equal to ``NTILE(n) OVER (ORDER BY ...)``.

    The order must be total: callers pass the value columns followed by a unique
    row key. The input is read several times, so it is materialised first unless
    ``materialized`` says it is already cheap to re-read. ``sketch_k`` is the size of a
    quantile sketch (8 to 65535). A task sorts about ``range_rows`` keys at most for
    each cut; the driver gets a few numbers and one key a cut.
    """
    src = df if materialized else materialize(df)
    keyed = src.select(
        *[
            F.struct(*[c.alias(f"k{i}") for i, c in enumerate(_components(src, s.order))]).alias(f"s{n}")
            for n, s in enumerate(specs)
        ]
    )
    numbers = [_key_numbers(src, s, f"s{n}") for n, s in enumerate(specs)]
    total, grids = _first_pass(keyed, numbers, sketch_k)
    cuts = [
        [_Cut(f"s{n}", keyed.schema[f"s{n}"].dataType, numbers[n], start, total) for start in _starts(total, s.n)]
        for n, s in enumerate(specs)
    ]
    first = [(c, _proposal(grid, (c.position + 0.5) / total, sketch_k)) for own, grid in zip(cuts, grids, strict=True) for c in own]
    for part in _in_parts(first):
        _counted(keyed, [c for c, _ in part], [p for _, p in part], range_rows)
    flat = [c for own in cuts for c in own]
    seed = 0
    while large := [c for c in flat if c.found is None and c.rows > range_rows]:
        for part in _in_parts([c for c in large if c.number is not None]):
            _counted(keyed, part, _sketched(keyed, part, sketch_k), range_rows)
        seed += 1
        for part in _in_parts([c for c in large if c.number is None]):
            _narrow(keyed, part, sketch_k, seed)
    for part in _in_parts([c for c in flat if c.found is None]):
        for c, row in zip(part, _first_rows(keyed, part), strict=True):
            c.found = row
    out = src
    for spec, own in zip(specs, cuts, strict=True):
        steps = [f"CAST({_reaches('_tile_key', c.found, c.schema)} AS BIGINT)" for c in own]
        key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(_components(src, spec.order))])
        out = out.withColumn("_tile_key", key).withColumn(spec.out, F.expr(" + ".join(["1L", *steps]))).drop("_tile_key")
    return out
