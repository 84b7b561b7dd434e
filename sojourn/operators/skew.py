"""Building blocks that keep ordered work distributed when one group is huge.

A plain ``Window.partitionBy(key).orderBy(x)`` puts a whole key in one task. The
helpers here cut a group into ordered *slices*, work inside each slice, and carry
small per-slice totals from slice to slice, so the largest task is one slice.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.session import stored

MICROS_PER_DAY = 86_400_000_000

# A key is cut into slices above this many rows. It also bounds what is broadcast:
# at most (all rows / HOT_ROWS) keys can be hot.
HOT_ROWS = 1_000_000

# Rows of a slice, and the most slices that one order is cut into.
SLICE_ROWS = 1_000_000
GRID = 4096

# Accuracy of the sketches that bracket a quantile, and how far from its share the bracket reaches.
SKETCH = 10_000
NEAR = 4 / SKETCH


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a local timestamp (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def with_slices(
    rows: DataFrame, order: str, slice_rows: int | None = None, name: str = "_slice", *, narrow: bool = False
) -> DataFrame:
    """Adds ``name``: which of several consecutive ranges of ``order`` a row lies in, about ``slice_rows`` rows each.

    The borders are quantiles of the rows themselves, from quantile sketches that are merged over all tasks, so the number of
    slices grows with the rows and follows them into any narrow range. One aggregate finds them as a
    scalar subquery of the same plan; a row finds its slice by binary search. Rows of equal ``order`` share a slice; nulls are
    in slice 0. Sketches only choose borders: what is computed over the slices stays exact.
    Of ``narrow`` rows the aggregate reads all columns, so that it shares the shuffle that makes the rows.
    """
    wanted = F.lit(SLICE_ROWS if slice_rows is None else slice_rows)
    value = f"cast(`{order}` as double)"
    shares = ",".join(repr(i / GRID) for i in range(1, GRID))
    read = F.count_if(F.xxhash64(*rows.columns) != 0) if narrow else F.count(F.col(order))
    sketch = rows.agg(
        read.alias("n"),
        F.expr(f"percentile_approx({value}, cast(split('{shares}', ',') as array<double>), {4 * GRID})").alias("grid"),
    )
    parts = F.least(F.lit(GRID), F.ceil(F.col("n") / wanted)).cast("int")
    none = F.array().cast("array<double>")
    border = F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda i: F.get("grid", F.floor(i * GRID / F.col("parts")).cast("int") - 1))
    powers = F.transform(F.sequence(F.lit(12), F.lit(0)), lambda k: F.pow(F.lit(2), k).cast("int"))
    found = sketch.select("grid", parts.alias("parts")).select(
        F.struct(
            F.when(F.col("parts") > 1, border).otherwise(none).alias("borders"),
            F.filter(powers, lambda step: step < F.col("parts")).alias("steps"),
        ).alias("found")
    )
    marked = rows.withColumn("_found", found.scalar())
    at = F.expr(
        f"aggregate(_found.steps, 0, (at, step) -> if(coalesce(get(_found.borders, at + step - 1) <= {value}, false), at + step, at))"
    )
    return marked.withColumn(name, at.cast("bigint")).drop("_found")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key; keeps the left keys."""
    renamed = right.select(
        *[F.col(key).alias(f"_r_{key}") for key in keys], *[c for c in right.columns if c not in keys]
    )
    condition = reduce(
        lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_r_{key}")) for key in keys]
    )
    joined = left.join(renamed, condition, how)
    return joined if how == "leftsemi" else joined.drop(*[f"_r_{key}" for key in keys])


def hot_keys(frames: Sequence[DataFrame], keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys holding more than ``hot_rows`` rows over all frames (map-side combined counts)."""
    counted = [frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")) for frame in frames]
    everything = reduce(DataFrame.unionAll, counted)
    return (
        everything.groupBy(*keys)
        .agg(F.sum("_rows").alias("_rows"))
        .filter(F.col("_rows") > hot_rows)
        .select(*keys)
    )


def running_totals(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    totals: Mapping[str, str],
    *,
    slice_rows: int | None = None,
    descending: bool = False,
    with_ties: bool = False,
) -> DataFrame:
    """Add ``<name>_before`` and ``<name>_all`` for every summed column.

    ``rows`` has one row per (keys, order), or, for an ascending integer order, any number of
    rows ``with_ties``. ``totals`` maps an output name to the column to add up.
    ``<name>_before`` sums all rows of the group that come strictly before this one;
    ``<name>_all`` sums the group. Only per-slice totals are ever brought together, one
    row per slice. Slices are ranges of ``order`` that all groups share (``with_slices``): a group has at most
    the rows of a slice in one task, whatever its size and however close its values lie.
    """
    # a struct equals itself even where it holds null: windows and joins share one partitioning, with plain equality
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    narrow = set(rows.columns) == {*keys, order, *totals.values()}
    sliced = with_slices(rows, order, slice_rows, narrow=narrow).withColumn("_group", group)
    by_order = F.col(order).desc() if descending else F.col(order).asc()
    by_slice = F.col("_slice").desc() if descending else F.col("_slice").asc()
    inside = Window.partitionBy("_group", "_slice").orderBy(by_order)
    inside = (inside.rangeBetween if with_ties else inside.rowsBetween)(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_group").orderBy(by_slice).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_group")

    per_slice = sliced.groupBy("_group", "_slice").agg(
        *[F.sum(source).alias(f"_t_{name}") for name, source in totals.items()]
    )
    carried = per_slice.select(
        "_group",
        "_slice",
        *[F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_c_{name}") for name in totals],
        *[F.sum(f"_t_{name}").over(whole).alias(f"{name}_all") for name in totals],
    )
    local = sliced.select(
        *sliced.columns,
        *[
            F.coalesce(F.sum(source).over(inside), F.lit(0)).alias(f"_l_{name}")
            for name, source in totals.items()
        ],
    )
    joined = local.join(carried, ["_group", "_slice"])
    return joined.select(
        *rows.columns,
        *[(F.col(f"_l_{name}") + F.col(f"_c_{name}")).alias(f"{name}_before") for name in totals],
        *[f"{name}_all" for name in totals],
    )


def exact_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    *,
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles per group, exact, for groups of any size.

    Counts equal values first, then finds the two ranks of every quantile from
    running counts; no group's values are gathered in one buffer.
    """
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = (
        rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(amount.cast("bigint").alias("_n"))
    )
    ranked = running_totals(counted, keys, "_v", {"_rank": "_n"})
    first, last, total = F.col("_rank_before"), F.col("_rank_before") + F.col("_n") - 1, F.col("_rank_all")

    picks = []
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (total - 1)
        low, high = F.floor(position), F.ceil(position)
        picks += [
            F.max(F.when((first <= low) & (low <= last), F.col("_v"))).alias(f"_lo_{name}"),
            F.max(F.when((first <= high) & (high <= last), F.col("_v"))).alias(f"_hi_{name}"),
            F.max(position - low).alias(f"_fr_{name}"),
        ]
    found = ranked.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            F.when((F.col(f"_lo_{name}") == F.col(f"_hi_{name}")) | (F.col(f"_fr_{name}") == 0), F.col(f"_lo_{name}"))
            .otherwise(F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_fr_{name}"))
            .alias(name)
            for name in quantiles
        ],
    )


def column_quantiles(rows: DataFrame, columns: Sequence[str], quantiles: Mapping[str, float]) -> dict[str, dict[str, float | None]]:
    """The quantiles of ``exact_quantiles`` for whole columns, as numbers; None where a column has no value.

    Sketches bracket each quantile; then what lies below a bracket is counted and only the values inside are shuffled and
    ranked. A bracket that does not hold its ranks is replaced by the whole column, so the result is exact.
    """
    if not columns:
        return {}
    numbers = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"_{i}") for i, c in enumerate(columns)]
    held = rows.select(*numbers)
    names, found = list(quantiles), {c: dict.fromkeys(quantiles) for c in columns}
    shares = F.array(*[F.lit(float(s)) for q in quantiles.values() for s in (max(q - NEAR, 0.0), min(q + NEAR, 1.0))])
    sketch = held.agg(
        *[F.count(f"_{i}").alias(f"n{i}") for i in range(len(columns))],
        *[F.percentile_approx(f"_{i}", shares, F.lit(SKETCH)).alias(f"s{i}") for i in range(len(columns))],
    ).first()
    places = []  # column, quantile, low and high border
    for i in range(len(columns)):
        for j, q in enumerate(quantiles.values()):
            wide = sketch[f"n{i}"] <= SKETCH
            low = None if wide or q <= NEAR else sketch[f"s{i}"][2 * j]
            high = None if wide or q >= 1 - NEAR else sketch[f"s{i}"][2 * j + 1]
            if sketch[f"n{i}"]:
                places.append((i, j, low, high))
    while places:
        missed = []
        for (i, j, low, high), value in zip(places, _bracketed(held, places, [(sketch[f"n{i}"], quantiles[names[j]]) for i, j, _, _ in places])):
            if value is None:
                missed.append((i, j, None, None))
            else:
                found[columns[i]][names[j]] = value
        places = missed
    return found


def group_quantile(rows: DataFrame, keys: Sequence[str], value: str, share: float, name: str, near: float = NEAR, accuracy: int = SKETCH) -> DataFrame:
    """One quantile of ``exact_quantiles`` per group, for rows of few equal values, as ``keys, name``.

    A sketch per group brackets it; what lies below is counted, and only values inside the bracket are shuffled and
    ranked. Groups whose bracket does not hold the ranks are ranked whole.
    """
    number = F.col(value).cast("double")
    held = rows.select(*keys, number.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    sides = F.array(F.lit(max(share - near, 0.0)), F.lit(min(share + near, 1.0)))
    sketch = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"), F.percentile_approx("_v", sides, F.lit(accuracy)).alias("_s"))
    whole = F.col("_total") <= accuracy
    low = F.when(~whole & F.lit(share > near), F.col("_s")[0])
    high = F.when(~whole & F.lit(share < 1 - near), F.col("_s")[1])
    # a row for each group
    brackets = stored(sketch.select(*keys, "_total", low.alias("_low"), high.alias("_high")), "brackets")
    marked = null_safe_join(held, brackets, keys)
    under = F.coalesce(F.col("_v") < F.col("_low"), F.lit(False))
    inside = ~under & F.coalesce(F.col("_v") <= F.col("_high"), F.lit(True))
    place = F.when(inside, F.col("_v"))
    counted = marked.filter(under | inside).groupBy(*keys, place.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counted = stored(counted, "near-quantiles")
    below = counted.filter("_v is null").select(*keys, F.col("_n").alias("_below"))
    ranked = running_totals(counted.filter("_v is not null"), keys, "_v", {"_rank": "_n"})
    known = null_safe_join(ranked, null_safe_join(brackets.select(*keys, "_total"), below, keys, "left"), keys)
    position = F.lit(float(share)) * (F.col("_total") - 1)
    first = F.col("_rank_before") + F.coalesce("_below", F.lit(0))
    at = lambda rank: F.max(F.when((first <= rank) & (rank < first + F.col("_n")), F.col("_v")))
    ends = known.groupBy(*keys).agg(at(F.floor(position)).alias("_lo"), at(F.ceil(position)).alias("_hi"), F.max(position - F.floor(position)).alias("_part"))
    between = F.when((F.col("_lo") == F.col("_hi")) | (F.col("_part") == 0), F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part"))
    found = stored(null_safe_join(brackets.select(*keys), ends.select(*keys, between.alias(name)), keys, "left"), "quantiles")
    missed = found.filter(F.col(name).isNull()).select(*keys)
    if missed.isEmpty():
        return found
    rest = exact_quantiles(null_safe_join(held, missed, keys, "leftsemi"), keys, "_v", {name: share})
    return found.filter(F.col(name).isNotNull()).unionByName(rest)


def _bracketed(held: DataFrame, places: Sequence[tuple], wanted: Sequence[tuple[int, float]]) -> list[float | None]:
    """The quantile inside each bracket, or None if its ranks are not there."""

    def inside(i: int, low: float | None, high: float | None) -> Column:
        tests = ([F.col(f"_{i}") >= low] if low is not None else []) + ([F.col(f"_{i}") <= high] if high is not None else [])
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    below = held.agg(*[(F.lit(0) if low is None else F.count_if(F.col(f"_{i}") < low)).cast("bigint").alias(f"b{at}") for at, (i, _, low, _) in enumerate(places)]).first()
    pairs = [F.struct(F.lit(at).alias("place"), F.when(inside(i, low, high), F.col(f"_{i}")).alias("v")) for at, (i, _, low, high) in enumerate(places)]
    counted = held.select(F.explode(F.array(*pairs)).alias("_p")).select("_p.place", "_p.v").filter("v is not null")
    counted = stored(counted.groupBy("place", "v").agg(F.count(F.lit(1)).alias("n")), "near-quantiles")
    ranked = running_totals(counted, ["place"], "v", {"rank": "n"})
    picks, shares = [], []
    for at, (total, q) in enumerate(wanted):
        position = float(q) * (total - 1)
        shares.append(position - math.floor(position))
        for side, rank in (("lo", math.floor(position)), ("hi", math.ceil(position))):
            own = F.lit(rank - below[f"b{at}"])
            here = (F.col("place") == at) & (F.col("rank_before") <= own) & (own < F.col("rank_before") + F.col("n"))
            picks.append(F.max(F.when(here, F.col("v"))).alias(f"{side}{at}"))
    row = ranked.agg(*picks).first()
    ends = [(row[f"lo{at}"], row[f"hi{at}"], share) for at, share in enumerate(shares)]
    return [None if lo is None or hi is None else lo if lo == hi or share == 0 else lo + (hi - lo) * share for lo, hi, share in ends]


def hash_positions(rows: DataFrame, keys: Sequence[str], number: Column, name: str) -> DataFrame:
    """Adds ``name``: the place of a row in its group, from 0, by a 64-bit hash."""
    numbered = rows.withColumns({"_hash": number, "_one": F.lit(1).cast("bigint")})
    placed = running_totals(numbered, keys, "_hash", {"_at": "_one"})
    return placed.withColumnRenamed("_at_before", name).drop("_hash", "_one", "_at_all")


# A prime and two multipliers of linear congruential generators: cheap mixing that SQL can state.
_PRIME, _MIX = 2147483647, (48271, 69621)
_WALK = 64  # steps back into range; a step leaves it with probability below 0.6, and below 2 / sqrt(n) for n rows


def shuffled_place(place: Column, total: Column, shuffle: Column) -> Column:
    """Where the row at ``place`` of ``total`` rows goes in shuffle number ``shuffle``: a seeded bijection, computed per row.

    Places are pairs of digits to the base a = ceil(sqrt(total)). Four Feistel rounds add to one digit a mix of the
    other, which can be undone; a result beyond the last place goes through the rounds again.
    """

    def round_(number: int) -> Callable[[Column], Column]:
        def step(pair: Column) -> Column:
            mixed = pair["right"] + (shuffle * 4 + number + 1) * 7919
            for factor in _MIX:
                mixed = mixed % _PRIME * factor
            return F.struct(pair["right"].alias("left"), ((pair["left"] + mixed % _PRIME) % pair["base"]).alias("right"), pair["base"].alias("base"))

        return step

    def once(at: Column, base: Column) -> Column:
        pair = F.array(F.struct(F.call_function("div", at, base).alias("left"), (at % base).alias("right"), base.alias("base")))
        for number in range(4):
            pair = F.transform(pair, round_(number))
        return F.transform(pair, lambda p: p["left"] * p["base"] + p["right"])[0]

    base = F.ceil(F.sqrt(total.cast("double"))).cast("bigint")
    first = once(place.cast("bigint"), base)
    # only a place out of range walks on
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), first, lambda at, _: F.when(at < total, at).otherwise(once(at, base)))
    return F.when(first < total, first).otherwise(walked)


def with_shuffled_place(rows: DataFrame, place: str, total: int, shuffle: str, name: str) -> DataFrame:
    """Adds ``name``, the ``shuffled_place`` of a column: its first four rounds as plain columns, so that only a place that walks on is slow."""
    base = math.ceil(math.sqrt(total))
    kept, at = rows.columns, F.col(place).cast("bigint")
    out = rows.select("*", F.call_function("div", at, F.lit(base).cast("bigint")).alias("_left0"), (at % base).alias("_right0"))
    for number in range(4):
        mixed = F.col(f"_right{number}") + (F.col(shuffle) * 4 + number + 1) * 7919
        for factor in _MIX:
            mixed = mixed % _PRIME * factor
        right = (F.col(f"_left{number}") + mixed % _PRIME) % base
        out = out.select(*kept, F.col(f"_right{number}").alias(f"_left{number + 1}"), right.alias(f"_right{number + 1}"))
    out = out.select(*kept, (F.col("_left4") * base + F.col("_right4")).alias("_first"))
    walked = shuffled_place(F.col(place), F.lit(total).cast("bigint"), F.col(shuffle))
    return out.select(*kept, F.when(F.col("_first") < total, F.col("_first")).otherwise(walked).alias(name))


def stack_dimensions(rows: DataFrame, dims: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per (row, dimension) as ``variable``/``value`` plus the kept columns."""
    pairs = F.array(
        *[F.struct(F.lit(d).alias("variable"), F.col(d).cast("string").alias("value")) for d in dims]
    )
    return rows.select(F.explode(pairs).alias("_pair"), *keep).select(
        "_pair.variable", "_pair.value", *keep
    )


def stacked_sums(rows: DataFrame, dims: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """Sum measures per (variable, value).

    Rows are first combined per joint cell of all dimensions, so the per-dimension
    expansion runs over cells instead of rows.
    """
    cells = rows.groupBy(*dims).agg(*[F.sum(m).alias(name) for name, m in measures.items()])
    return (
        stack_dimensions(cells, dims, list(measures))
        .groupBy("variable", "value")
        .agg(*[F.sum(name).alias(name) for name in measures])
    )
