"""Boxes ``[x_min, y_min, x_max, y_max]``: overlap and greedy one-to-one matching, in-row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOXES = "array<array<bigint>>"


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union; zero where the boxes are apart or the union is empty."""
    at = lambda box, i: F.get(box, F.lit(i)).cast("double")
    left, top = F.greatest(at(a, 0), at(b, 0)), F.greatest(at(a, 1), at(b, 1))
    right, bottom = F.least(at(a, 2), at(b, 2)), F.least(at(a, 3), at(b, 3))
    shared = (right - left) * (bottom - top)
    area = lambda box: (at(box, 2) - at(box, 0)) * (at(box, 3) - at(box, 1))
    union = area(a) + area(b) - shared
    return F.when((right < left) | (bottom < top) | (union <= 0), 0.0).otherwise(F.try_divide(shared, union))


def matched(predicted: Column, reference: Column, threshold: Column, *, inclusive: bool = False) -> Column:
    """Number of predicted boxes that find a reference box, each reference once.

    Predictions take their turn in list order; each takes the free reference of greatest
    overlap, the first of equals, if that passes the threshold. The order decides, so this
    is a fold over the list and not a join of pairs. Boxes without four numbers never match.
    """
    none = F.array().cast("array<int>")
    places = F.when(F.size(reference) > 0, F.sequence(F.lit(0), F.size(reference) - 1)).otherwise(none)
    sound = lambda box: F.size(box) == 4

    def step(used: Column, box: Column) -> Column:
        free = F.filter(places, lambda k: ~F.array_contains(used, k) & sound(F.get(reference, k)))
        best = F.array_max(
            F.transform(free, lambda k: F.struct(overlap(box, F.get(reference, k)).alias("iou"), (-k).alias("k")))
        )

        def take(w: Column) -> Column:
            good = (w["iou"] >= threshold) if inclusive else (w["iou"] > threshold)
            return F.when(sound(box) & (w["iou"] > 0) & good, F.concat(used, F.array(-w["k"]))).otherwise(used)

        return F.get(F.transform(F.array(best), take), F.lit(0))

    return F.aggregate(predicted, none, step, F.size)
