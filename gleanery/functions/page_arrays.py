"""Groups and repeats within the arrays of a page, in JVM expressions that sort instead of comparing everything with everything."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.generate import bound


def ids_by_name(names: Column, headings: Column, ids: Column) -> Column:
    """For each of `names` the ids whose heading equals it, in order.

    Headings are sorted, and a map has the first index and the number of each distinct one.
    """
    placed = F.transform(headings, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = F.array_sort(F.zip_with(placed, ids, lambda h, c: F.struct(h.alias("at"), c.alias("id"))))

    def runs(ordered: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), F.transform(ordered, lambda x: x["at"]["h"]))
        begins = F.zip_with(ordered, F.slice(before, F.lit(1), F.size(ordered)), lambda x, b: ~x["at"]["h"].eqNullSafe(b))
        numbered = F.zip_with(ordered, begins, lambda x, new: F.struct(x["at"]["h"].alias("h"), new.alias("new")))
        starts = F.filter(
            F.transform(numbered, lambda x, i: F.struct(x["h"].alias("h"), x["new"].alias("new"), i.alias("i"))), lambda x: x["new"]
        )
        return F.struct(F.transform(ordered, lambda x: x["id"]).alias("ids"), starts.alias("starts"))

    def spans(held: Column) -> Column:
        starts, end = held["starts"], F.array(F.size(held["ids"]))
        after = F.slice(F.concat(F.transform(starts, lambda x: x["i"]), end), F.lit(2), F.size(starts))
        values = F.zip_with(starts, after, lambda x, n: F.struct(x["i"].alias("first"), (n - x["i"]).alias("n")))
        return F.struct(held["ids"].alias("ids"), F.map_from_arrays(F.transform(starts, lambda x: x["h"]), values).alias("spans"))

    def of(held: Column, name: Column) -> Column:
        # Not a slice, which goes through the whole array.
        numbers = lambda s: F.when(s.isNotNull(), F.sequence(s["first"], s["first"] + s["n"] - 1))
        found = F.transform(numbers(F.try_element_at(held["spans"], name)), lambda k: F.get(held["ids"], k))
        return F.coalesce(found, F.array().cast("array<string>"))

    whole = bound(bound(ordered, runs), spans)
    return bound(F.struct(whole.alias("held"), names.alias("names")), lambda p: F.transform(p["names"], lambda name: of(p["held"], name)))


def repeats(values: Column) -> Column:
    """array<boolean> for an array of texts without nulls: whether an equal one stands earlier. Sorts, so n log n."""
    placed = F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))

    def flagged(ordered: Column) -> Column:
        none = F.array(F.lit(None).cast("string"))
        before = F.slice(F.concat(none, F.transform(ordered, lambda x: x["v"])), F.lit(1), F.size(ordered))
        again = F.zip_with(ordered, before, lambda x, b: F.struct(x["i"].alias("i"), x["v"].eqNullSafe(b).alias("again")))
        return F.transform(F.array_sort(again), lambda x: x["again"])

    return bound(placed, flagged)
