"""Column strategies: how a column is aggregated in a period, merged across periods, and read.

Every strategy has the same four methods. ``delta`` is an aggregate over one period's rows; ``merge`` combines two states,
whichever is newer; ``running`` is the cumulative state of every period in one window pass; ``read`` turns a state into the
value that readers see. A delta is a state too. States are plain Spark types (numbers, structs, arrays).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Total order of events: newest is the greatest.
ORDER = ("event_timestamp", "event_id")


def _when(value: Column, condition: str | None) -> Column:
    return value if condition is None else F.when(F.expr(condition), value)


def _plus(a: Column, b: Column) -> Column:
    """Null only if both are."""
    return F.coalesce(a + b, a, b)


def _folded(strategy, state: Column) -> Column:
    """States merged one after the other. For a number of states that something else bounds: all of them are gathered."""
    states = F.collect_list(F.struct(state.alias("s")))  # in a struct, so that nulls are not left out of sight of merge
    return F.when(F.size(states) > 0, F.reduce(F.slice(states, 2, F.greatest(F.size(states) - 1, F.lit(0))), F.element_at(states, 1)["s"], lambda a, b: strategy.merge(a, b["s"])))


@dataclass(frozen=True)
class Lifetime:
    """An aggregate over the whole life of an entity. fn: sum, count, count_if, min, max, avg, first, last, count_distinct,
    approx_count_distinct, theta, percentile, stddev or variance; expr is its argument, when an optional filter. The function's name alone
    decides how states merge. Aggregates without a mergeable state are refused.

    The state of count_distinct is the set itself, which ``entity.cumulate`` never gathers over periods; for entities with very many values
    take approx_count_distinct or theta, whose states have a fixed size. ``size``: of theta the logarithm of the hashes kept (up to so
    many values the count is exact, beyond it has a standard error of about one over the root of that number); of percentile the
    parameter k (exact up to about as many values, beyond it the rank is off by some 1.33 % at k = 200). ``rank``: which percentile,
    from 0 to 1."""

    fn: str
    expr: str | None = None
    when: str | None = None
    rank: float = 0.5
    size: int | None = None

    FIELDS = {"avg": ("s", "n")}
    MOMENTS = ("stddev", "variance")
    KNOWN = ("sum", "count", "count_if", "min", "max", "avg", "first", "last", "count_distinct", "approx_count_distinct", "theta", "percentile", "stddev", "variance")
    #: Aggregates whose states are sketches: how states merge over rows, and how two do.
    SKETCHES = {"approx_count_distinct": (F.hll_union_agg, F.hll_union), "theta": (F.theta_union_agg, F.theta_union), "percentile": (F.kll_merge_agg_double, F.kll_sketch_merge_double)}

    def __post_init__(self):
        if self.fn not in self.KNOWN:
            raise ValueError(f"{self.fn} has no state that merges across periods")

    def delta(self) -> Column:
        x = F.lit(1) if self.expr is None else F.expr(self.expr)
        v = _when(x, self.when)
        if self.fn == "count":
            return F.count(v)
        if self.fn == "count_if":
            return F.count(F.when(x, 1))
        if self.fn in ("sum", "min", "max"):
            return getattr(F, self.fn)(v)
        if self.fn == "avg":
            return F.struct(F.sum(v).cast("double").alias("s"), F.count(v).alias("n"))
        if self.fn in self.MOMENTS:  # number, mean, and squared distances from the mean: sums of squares would cancel
            d = v.cast("double")
            return F.struct(F.count(d).alias("n"), F.avg(d).alias("m"), (F.var_pop(d) * F.count(d)).alias("q"))
        if self.fn in ("first", "last"):
            pick = F.min if self.fn == "first" else F.max
            return pick(F.when(v.isNotNull(), F.struct(*ORDER, v.alias("v"))))
        if self.fn == "count_distinct":
            return F.collect_set(v)
        if self.fn == "theta":
            return F.theta_sketch_agg(v, self.size or 12)
        if self.fn == "percentile":
            return F.kll_sketch_agg_double(v.cast("double"), self.size or 200)
        return F.hll_sketch_agg(v)

    def _fold(self, total, low, high, sets) -> Column:
        fn = self.fn
        if fn in ("sum", "count", "count_if"):
            return total(None)
        if fn in self.FIELDS:
            return F.struct(*(total(f).alias(f) for f in self.FIELDS[fn]))
        if fn in ("min", "first"):
            return low()
        if fn in ("max", "last"):
            return high()
        return sets()

    def merge(self, old: Column, new: Column) -> Column:
        if self.fn in self.MOMENTS:
            n, step = old["n"] + new["n"], new["m"] - old["m"]
            both = F.struct(n.alias("n"), (old["m"] + step * new["n"] / n).alias("m"), (old["q"] + new["q"] + step * step * old["n"] * new["n"] / n).alias("q"))
            return F.when((new["n"] > 0) & (old["n"] > 0), both).when(old["n"] > 0, old).otherwise(F.coalesce(new, old))

        def part(c: Column, f: str | None) -> Column:
            return c if f is None else c[f]

        if self.fn == "count_distinct":
            union = F.array_union(F.coalesce(old, F.array()), F.coalesce(new, F.array()))
        elif self.fn in self.SKETCHES:
            union = F.coalesce(self.SKETCHES[self.fn][1](old, new), old, new)
        else:
            union = None
        return self._fold(lambda f: _plus(part(old, f), part(new, f)), lambda: F.least(old, new), lambda: F.greatest(old, new), lambda: union)

    def combine(self, state: Column) -> Column:
        """An aggregate over several states of a key, in any order."""
        if self.fn in self.MOMENTS or self.fn == "count_distinct":
            return _folded(self, state)
        return self._fold(lambda f: F.sum(state if f is None else state[f]), lambda: F.min(state), lambda: F.max(state), lambda: self.SKETCHES[self.fn][0](state))

    def anchor(self, delta: Column, life: Life) -> Column | None:
        """What ``running`` needs beforehand: for moments a value near the mean, to which distances are taken."""
        return F.first(delta["m"], ignorenulls=True).over(life.all) if self.fn in self.MOMENTS else None

    def running(self, delta: Column, life: Life, anchor: Column | None = None) -> Column:
        over = life.all
        if self.fn in self.MOMENTS:
            n, off = F.sum(delta["n"]).over(over), delta["m"] - anchor
            mean = F.try_divide(F.sum(delta["n"] * off).over(over), n)
            far = F.sum(delta["q"] + delta["n"] * off * off).over(over)
            return F.struct(n.alias("n"), (anchor + mean).alias("m"), F.greatest(far - n * mean * mean, F.lit(0.0)).alias("q"))
        # an exact count of distinct values over time is no window over sets: see entity.cumulate
        return self._fold(lambda f: F.sum(delta if f is None else delta[f]).over(over), lambda: F.min(delta).over(over), lambda: F.max(delta).over(over), lambda: self.SKETCHES[self.fn][0](delta).over(over))

    def read(self, state: Column) -> Column:
        if self.fn == "avg":
            return F.try_divide(state["s"], state["n"])
        if self.fn in self.MOMENTS:
            var = F.when(state["n"] > 1, state["q"] / (state["n"] - 1))
            return var if self.fn == "variance" else F.sqrt(var)
        if self.fn in ("first", "last"):
            return state["v"]
        if self.fn == "count_distinct":
            return F.size(state).cast("long")
        if self.fn == "theta":
            return F.theta_sketch_estimate(state)
        if self.fn == "percentile":
            return F.when(F.kll_sketch_get_n_double(state) > 0, F.kll_sketch_get_quantile_double(state, F.lit(self.rank)))
        return F.hll_sketch_estimate(state) if self.fn == "approx_count_distinct" else state


@dataclass(frozen=True)
class PrependList:
    """The newest ``length`` values of an expression, newest first. A state keeps each value's time, so rows that come late find their
    place. Rows must be limited to the newest ones beforehand (``entity.family_delta`` does), so that no list grows past its length
    while it is gathered."""

    expr: str
    length: int

    def delta(self) -> Column:
        return self._newest(F.collect_list(F.struct(*ORDER, F.expr(self.expr).alias("v"))))

    def _newest(self, pairs: Column) -> Column:
        return F.slice(F.sort_array(pairs, asc=False), 1, self.length)

    def merge(self, old: Column, new: Column) -> Column:
        return F.coalesce(self._newest(F.concat(old, new)), old, new)

    def combine(self, state: Column) -> Column:
        return _folded(self, state)

    def anchor(self, delta: Column, life: Life) -> None:
        return None

    def running(self, delta: Column, life: Life, anchor: Column | None = None) -> Column:
        # a period with a row has a value, so the frame need not reach back further than ``length`` periods
        return self._newest(F.flatten(F.collect_list(delta).over(life.rows(self.length))))

    def read(self, state: Column) -> Column:
        return F.transform(state, lambda p: p["v"])


@dataclass(frozen=True)
class BitmapActivity:
    """A bit string of ``window`` slots, the newest last: 1 where the entity was active. Slots are days or hours. A state is the slots
    themselves (numbers since the epoch), of which only those within the window of the newest are kept; the bits are drawn when it
    is known at which slot they end."""

    granularity: str = "day"
    window: int = 30

    def slot(self, time: Column) -> Column:
        """Number of a time's slot since the epoch."""
        return F.floor(F.unix_seconds(time.cast("timestamp")) / (86400 if self.granularity == "day" else 3600)).cast("long")

    def last(self, day: Column) -> Column:
        """The last slot of a day (days since the epoch)."""
        return day if self.granularity == "day" else day * 24 + 23

    def bits(self, slots: Column, last: Column) -> Column:
        return F.array_join(F.transform(F.sequence(last - (self.window - 1), last), lambda s: F.when(F.array_contains(slots, s), "1").otherwise("0")), "")

    def _recent(self, slots: Column) -> Column:
        return F.filter(slots, lambda s: s > F.array_max(slots) - self.window)

    def delta(self) -> Column:
        """The period's slots."""
        return F.sort_array(F.collect_set(self.slot(F.col(ORDER[0]))))

    def merge(self, old: Column, new: Column, gap: Column | None = None) -> Column:
        """States; with a gap, bit strings as readers have them: the old one moves on by ``gap`` slots, then either's ones count."""
        if gap is None:
            return F.coalesce(self._recent(F.array_sort(F.array_union(old, new))), old, new)
        moved = F.right(F.concat(F.coalesce(old, F.repeat(F.lit("0"), F.lit(self.window))), F.repeat(F.lit("0"), gap.cast("int"))), F.lit(self.window))
        both = F.zip_with(F.split(moved, ""), F.split(F.coalesce(new, moved), ""), lambda a, b: F.greatest(a, b))
        return F.array_join(both, "")

    def combine(self, state: Column) -> Column:
        return _folded(self, state)

    def anchor(self, delta: Column, life: Life) -> None:
        return None

    def running(self, delta: Column, life: Life, anchor: Column | None = None) -> Column:
        # older days are outside the window at every later period, so the frame does not reach back further
        days = self.window if self.granularity == "day" else -(-self.window // 24) + 1
        return self._recent(F.array_sort(F.array_distinct(F.flatten(F.collect_list(delta).over(life.days(days))))))

    def read(self, state: Column) -> Column:
        return state


@dataclass(frozen=True)
class PackedActivity:
    """Activity in the last ``window`` slots (days or hours) as bits. A state is a list of words of 64 slots each, with their numbers since the
    epoch; in a word the newest slot is bit 0. A slot always has the same bit of the same word, so states merge by OR, in any order and
    without shifts; words outside the window of the newest slot are left out. Readers get the ``word`` that ends at a slot, on which
    counts and streaks are bit operations."""

    granularity: str = "day"
    window: int = 30

    def slot(self, time: Column) -> Column:
        return BitmapActivity(self.granularity, self.window).slot(time)

    def last(self, day: Column) -> Column:
        return BitmapActivity(self.granularity, self.window).last(day)

    def delta(self) -> Column:
        slots = F.collect_set(self.slot(F.col(ORDER[0])))  # of one period
        single = F.transform(slots, lambda s: F.struct(F.floor(s / 64).cast("long").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (63 - F.pmod(s, F.lit(64))).cast("int")).alias("b")))
        return self._packed(single)

    def _packed(self, parts: Column) -> Column:
        """Parts of words put together, in order; only the words that the window may reach from the newest one."""
        newest = F.array_max(F.transform(parts, lambda p: p["w"]))
        numbers = F.array_sort(F.array_distinct(F.transform(parts, lambda p: p["w"])))
        near = F.filter(numbers, lambda w: w >= newest - (self.window + 62) // 64)
        return F.transform(near, lambda w: F.struct(w.alias("w"), F.aggregate(F.filter(parts, lambda p: p["w"] == w), F.lit(0).cast("long"), lambda a, p: a.bitwiseOR(p["b"])).alias("b")))

    def merge(self, old: Column, new: Column) -> Column:
        return F.coalesce(self._packed(F.concat(old, new)), old, new)

    def combine(self, state: Column) -> Column:
        return self._packed(F.flatten(F.collect_list(state)))

    def anchor(self, delta: Column, life: Life) -> None:
        return None

    def running(self, delta: Column, life: Life, anchor: Column | None = None) -> Column:
        days = self.window if self.granularity == "day" else -(-self.window // 24) + 1
        return self._packed(F.flatten(F.collect_list(delta).over(life.days(days))))

    def read(self, state: Column) -> Column:
        return state

    def word(self, state: Column, last: Column, back: int = 0) -> Column:
        """The 64 slots that end ``back`` slots before ``last``, the newest as bit 0."""
        end = (last - back).cast("long")
        of = lambda w: F.aggregate(F.filter(F.coalesce(state, F.array()), lambda p: p["w"] == w), F.lit(0).cast("long"), lambda a, p: a.bitwiseOR(p["b"]))
        at, place = F.floor(end / 64).cast("long"), F.pmod(end, F.lit(64)).cast("int")
        low = F.call_function("shiftrightunsigned", of(at), 63 - place)
        high = F.when(place < 63, F.call_function("shiftleft", of(at - 1), place + 1)).otherwise(F.lit(0).cast("long"))
        return low.bitwiseOR(high)

    def active(self, state: Column, last: Column, width: int | None = None, back: int = 0) -> Column:
        """Number of active slots among the ``width`` (the window) that end ``back`` before ``last``."""
        width = self.window if width is None else width
        out = F.lit(0)
        for at in range(0, width, 64):
            out = out + F.bit_count(masked(self.word(state, last, back + at), min(64, width - at)))
        return out

    def bits(self, state: Column, last: Column) -> Column:
        """The window as text, the newest slot last."""
        words = [self.word(state, last, at) for at in range(0, self.window, 64)]
        return F.right(F.concat(*(F.lpad(F.bin(w), 64, "0") for w in words[::-1])), F.lit(self.window))


def masked(word: Column, width: int) -> Column:
    """The newest ``width`` slots of a word."""
    return word if width >= 64 else word.bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def current_streak(word: Column) -> Column:
    """Active slots in a row up to the newest: the ones below the lowest zero."""
    below = F.bit_count(word.bitwiseAND(F.bitwise_not(word + 1)))
    return F.when(word == F.lit((1 << 63) - 1), 63).when(word == F.lit(-1), 64).otherwise(below)  # adding 1 must not overflow


def longest_streak(word: Column) -> Column:
    """Most active slots in a row: how often a word can be ANDed with itself moved by one before nothing is left."""
    step = lambda a, _: F.when(a["x"] == 0, a).otherwise(F.struct(a["x"].bitwiseAND(F.shiftleft(a["x"], 1)).alias("x"), (a["n"] + 1).alias("n")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(word.alias("x"), F.lit(0).alias("n")), step, lambda a: a["n"])


@dataclass(frozen=True)
class Life:
    """The windows over a key's periods: ``all`` up to each, the last so many ``rows``, or those of the last so many ``days``."""

    keys: tuple[str, ...]
    period: str
    day: Column

    @property
    def all(self) -> WindowSpec:
        return self.rows(None)

    def rows(self, most: int | None) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.period).rowsBetween(Window.unboundedPreceding if most is None else 1 - most, 0)

    def days(self, most: int) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.day).rangeBetween(1 - most, 0)
