"""Small helpers for array-of-struct expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Inside a lambda Spark re-evaluates a repeated sub-expression at every use;
    binding it through a one-element ``transform`` evaluates it once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def sort_structs(arr: Column, keys: Sequence[tuple[str, bool]]) -> Column:
    """``arr`` stably sorted by struct fields; ``(field, descending)``, a descending one being a number.

    The keys stand first in a struct, then the place, and ``sort_array`` compares them in
    their natural order.  A comparator lambda would be interpreted node by node at each of n log n steps.
    """
    keyed = F.transform(arr, lambda x, i: F.struct(
        *[_descending(x[f]).alias(f"k{n}") if desc else x[f].alias(f"k{n}") for n, (f, desc) in enumerate(keys)], i.alias("i"), x.alias("x")))
    return F.transform(F.sort_array(keyed), lambda y: y["x"])


def _descending(number: Column) -> Column:
    """A key that sorts ascending as ``number`` does descending; NaN is the greatest number."""
    return F.when(F.isnan(number), F.lit(float("-inf"))).otherwise(-number.cast("double"))


def first_of_groups(sorted_arr: Column, key_fields: Sequence[str]) -> Column:
    """Keep the first element of each run of equal ``key_fields`` in a sorted array."""

    def body(arr: Column) -> Column:
        def keep(x: Column, i: Column) -> Column:
            prev = F.element_at(arr, F.greatest(i, F.lit(1)))  # 1-based: element before x
            differs = None
            for f in key_fields:
                d = ~(prev[f].eqNullSafe(x[f]))
                differs = d if differs is None else (differs | d)
            return (i == 0) | differs

        return F.filter(arr, keep)

    return let(sorted_arr, body)


#: Items of a block of a collecting fold.
BLOCK = 128


def fold_collect(arr: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column, Column]],
                 item_type: str) -> Column:
    """Fold over ``arr`` that collects items: ``step(state, x)`` gives the next
    state, whether to collect, and the item (of type ``item_type``).

    Spark copies a fold's accumulator at every step, so one that grows makes
    the fold quadratic.  Here a first fold gives the state before each block of
    the array, and the blocks then collect by themselves from there: over n
    items about ``n * BLOCK / 2 + (n / BLOCK) ** 2 / 2`` copies of an item or state.
    An array of one block needs no first fold.
    """
    def blocks_of(a: Column) -> Column:
        n = F.ceil(F.size(a) / BLOCK).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda b: F.slice(a, b * BLOCK + 1, BLOCK))).otherwise(
            F.slice(F.array(a), 1, 0))

    def before(blocks: Column) -> Column:
        start = F.struct(state.alias("now"), F.array(state).alias("before"))

        def after(acc: Column, block: Column) -> Column:
            return let(F.aggregate(block, acc["now"], lambda s, x: step(s, x)[0]), lambda now: F.struct(
                now.alias("now"), F.concat(acc["before"], F.array(now)).alias("before")))

        return F.aggregate(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))), start, after, lambda acc: F.slice(acc["before"], 1, F.size(blocks)))

    def collected(block: Column, before: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            following, collect, item = step(acc["now"], x)
            return F.struct(following.alias("now"), F.when(collect, F.concat(acc["got"], F.array(item))).otherwise(acc["got"]).alias("got"))

        return F.aggregate(block, F.struct(before.alias("now"), F.array().cast(f"array<{item_type}>").alias("got")), one, lambda acc: acc["got"])

    return let(blocks_of(arr), lambda blocks: F.flatten(F.zip_with(blocks, before(blocks), collected)))


def group_starts(sorted_arr: Column, key_fields: Sequence[str]) -> Column:
    """1-based positions where a run of equal ``key_fields`` starts in a sorted array."""
    def starts(p: Column) -> Column:
        differs = F.lit(False)
        for f in key_fields:
            differs = differs | ~F.element_at(sorted_arr, p)[f].eqNullSafe(F.element_at(sorted_arr, F.greatest(p - 1, F.lit(1)))[f])
        return (p == 1) | differs

    places = F.when(F.size(sorted_arr) > 0, F.sequence(F.lit(1), F.size(sorted_arr))).otherwise(F.array().cast("array<int>"))
    return F.filter(places, starts)


def memoized(fn):
    """Cache an expression builder per Spark context.

    Building the detection expression issues thousands of Py4J calls (seconds
    of driver time) and depends only on its arguments, never on data.  Column
    expressions are immutable and unresolved, so one built expression can be
    used by any number of DataFrames of the same context.  Only plain column
    names are keys; with any other Column argument (whose printed text may be
    ambiguous) the expression is built anew.
    """
    import functools

    from pyspark import SparkContext

    cache: dict = {}

    def key_of(v):
        if isinstance(v, Column):
            node = v._jc.node()
            if node.getClass().getSimpleName() != "UnresolvedAttribute":
                raise TypeError("not a plain column name")
            return ("col", v._jc.toString())
        if isinstance(v, (list, tuple)):
            return tuple(key_of(x) for x in v)
        return v

    @functools.wraps(fn)
    def wrapper(*args, **kw):
        sc = SparkContext._active_spark_context
        token = None
        if sc is not None:
            # a token kept on the context itself: a new context (even at a
            # reused address) never sees expressions built for an old one
            token = getattr(sc, "_redactflow_token", None)
            if token is None:
                import uuid
                token = uuid.uuid4().hex
                sc._redactflow_token = token
        try:
            key = (token, key_of(args), tuple(sorted((k, key_of(v)) for k, v in kw.items())))
            hash(key)
        except (TypeError, AttributeError):  # unhashable, not a plain name, or no JVM column
            return fn(*args, **kw)
        if key not in cache:
            if len(cache) > 256:
                cache.clear()
            cache[key] = fn(*args, **kw)
        return cache[key]

    return wrapper
