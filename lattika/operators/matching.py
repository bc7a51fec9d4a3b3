"""One-to-one matching of boxes and nodes, in rounds of joins.

Both rules below read as a loop over the rows of a frame, one after the other, each taking something that later ones no longer get. Here
all rows of all frames advance at once: a round settles every row whose outcome no earlier row can still change. A frame of
any size is dealt out by rows, and candidates come from a join over grid cells, never from all pairs of a frame that has more than a few.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattika.functions.geometry import NEAR, OVERLAP, center_distance, iou
from lattika.functions.text import stable_differs
from lattika.operators.rounds import drop
from lattika.operators.selection import top_one

Keep = Callable[[DataFrame, str], DataFrame]
BOX = ("x", "y", "width", "height")
#: Sides of boxes that overlap by OVERLAP differ by a factor of 1 / OVERLAP = 5 at most, that is by three levels of a grid whose cells double.
LEVELS = 3
#: Boxes of one side of a frame up to which all its pairs are looked at: so few cost less than the cells they lie in.
FEW = 16


def _finite(df: DataFrame) -> DataFrame:
    """Rows whose box has four finite numbers."""
    return df.where(reduce(Column.__and__, [F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in BOX]))


def _cells(start: Column, length: Column, size: Column) -> Column:
    return F.sequence(F.floor(start / size), F.floor((start + length) / size))


def near_boxes(left: DataFrame, right: DataFrame, frame: str) -> DataFrame:
    """frame, a, b, score of the pairs of boxes of one frame that match: 1 + overlap from OVERLAP on, else 0.5 - distance of centres up to NEAR.

    Both: frame, id, x, y, width, height. Overlapping boxes meet in the grid whose cells are about as large as the larger one, where each covers
    a few cells; of the cells that two share, one counts. Close centres meet in a grid of cells of width NEAR. In frames of at most FEW boxes on either side each meets all. Boxes with a number that is null or not finite match nothing.
    """
    every = [_finite(df).select(frame, F.col("id").alias(i), F.struct(*BOX).alias(f"{i}_box")) for df, i in ((left, "a"), (right, "b"))]
    crowded = every[0].select(frame).withColumn("n", F.lit(1)).unionByName(every[1].select(frame).withColumn("n", F.lit(1 << 32))).groupBy(frame).agg(F.sum(F.col("n").cast("long")).alias("n"))
    crowded = crowded.where(F.greatest(F.col("n") % (1 << 32), F.shiftright("n", 32)) > FEW).select(frame)  # counts of both sides in one number
    few, (a, b) = [df.join(crowded, frame, "left_anti") for df in every], [df.join(crowded, frame, "left_semi") for df in every]
    box = lambda i: tuple(F.col(f"{i}_box.{c}") for c in BOX)
    shared, apart = iou(box("a"), box("b")), center_distance(box("a"), box("b"))
    sized = reduce(Column.__and__, [F.col(f"{i}_box.{c}") > 0 for i in "ab" for c in ("width", "height")])
    score = F.when(sized & (shared >= OVERLAP), shared + 1).when((shared < OVERLAP) & (apart <= NEAR), F.lit(0.5) - apart)
    pairs = few[0].join(few[1], frame).select(frame, "a", "b", score.alias("score")).where("score IS NOT NULL")

    def spread(df: DataFrame, i: str) -> DataFrame:
        x, y, w, h = box(i)
        df = df.where((w > 0) & (h > 0)).withColumn(f"{i}_level", F.ceil(F.log2(F.greatest(w, h))).cast("int"))
        df = df.withColumn("level", F.explode(F.sequence(F.col(f"{i}_level"), F.col(f"{i}_level") + LEVELS))).withColumn("size", F.pow(F.lit(2.0), F.col("level")))
        return df.withColumn("cell_x", F.explode(_cells(x, w, F.col("size")))).withColumn("cell_y", F.explode(_cells(y, h, F.col("size")))).drop("size")

    size = F.pow(F.lit(2.0), F.col("level"))
    met = spread(a, "a").join(spread(b, "b"), [frame, "level", "cell_x", "cell_y"]).where(F.col("level") == F.greatest("a_level", "b_level"))
    met = met.where((F.col("cell_x") == F.floor(F.greatest("a_box.x", "b_box.x") / size)) & (F.col("cell_y") == F.floor(F.greatest("a_box.y", "b_box.y") / size)))
    over = met.where(shared >= OVERLAP).select(frame, "a", "b", (shared + 1).alias("score"))

    def centre(df: DataFrame, i: str, reach: int) -> DataFrame:
        cell = lambda at: F.floor(at / (NEAR * 1.001))  # noqa: E731  a little wider, so that rounding takes no pair two cells apart
        x, y, w, h = box(i)
        for name, at in (("cell_x", x + w / 2), ("cell_y", y + h / 2)):
            df = df.withColumn(name, F.explode(F.sequence(cell(at) - reach, cell(at) + reach)))
        return df

    close = centre(a, "a", 0).join(centre(b, "b", 1), [frame, "cell_x", "cell_y"]).where((shared < OVERLAP) & (apart <= NEAR))
    return pairs.unionByName(over).unionByName(close.select(frame, "a", "b", (F.lit(0.5) - apart).alias("score")))


def choose_in_turn(offers: DataFrame, frame: str, keep: Keep) -> DataFrame:
    """frame, a, b: what the rows a of a frame get when they choose one after the other, in their order, each the free b of its offers with the least (wish, b).

    offers: frame, a, b, wish. In a round every a names its best offer; a b that is named goes to the earliest that named it or to an earlier
    one yet, so offers of that b to later rows go. When none goes, all name different ones, and these are the result of the choice in turn.
    """
    left, size = keep(offers.select(frame, "a", "b", "wish"), "offers"), -1
    while (count := left.count()) != size:
        size = count
        named = left.groupBy(frame, "a").agg(F.min(F.struct("wish", "b")).alias("best")).groupBy(frame, F.col("best.b").alias("b")).agg(F.min("a").alias("first"))
        before, left = left, keep(left.join(named, [frame, "b"], "left").where("first IS NULL OR a <= first").select(frame, "a", "b", "wish"), "offers")
        drop(before)
    return left.groupBy(frame, "a").agg(F.min(F.struct("wish", "b")).alias("best")).select(frame, "a", "best.b")


def compare_boxes(left: DataFrame, right: DataFrame, frame: str, keep: Keep) -> DataFrame:
    """frame, left_key, right_key, how (`key`, `place`, `left`, `right`): two answers about the same frames, row by row.

    Both: frame, key, pos, x, y, width, height. Of rows of one side that share a key the last counts, at the place of the first. Equal keys match first. Then each left row in order takes the best right row that is
    unused and whose key no left row has: by overlap, else by distance of centres, the first of equals. The rest stands alone.
    """

    def given(df: DataFrame, side: str) -> DataFrame:
        return df.select(frame, F.col("key").cast("string").alias("key"), F.lit(side).alias("side"), F.col("pos").cast("long").alias("pos"), F.struct(*[F.col(c).cast("double").alias(c) for c in BOX]).alias("box"))

    def of(side: str) -> list[Column]:
        own = F.col("side") == side
        last = F.max_by("box", F.when(own, F.col("pos")))
        return [F.struct(F.min(F.when(own, F.col("pos"))).alias("pos"), last.alias("box"), F.bool_or(own).alias("has")).alias(side)]

    # both sides meet in one grouping, which is written: all below read it
    met = keep(given(left, "left").unionByName(given(right, "right")).groupBy(frame, "key").agg(*of("left"), *of("right")), "sides")
    equal = F.col("left.has") & F.col("right.has") & F.col(frame).isNotNull() & F.col("key").isNotNull()
    rest = lambda side: met.where(F.col(f"{side}.has") & ~equal).select(frame, "key", F.struct(F.col(f"{side}.pos").alias("pos"), "key").alias("id"), *[F.col(f"{side}.box.{c}").alias(c) for c in BOX])
    a_rest, b_rest = rest("left"), rest("right")
    placed = choose_in_turn(near_boxes(a_rest, b_rest, frame).withColumn("wish", -F.col("score")), frame, keep).select(frame, F.col("a.key").alias("left_key"), F.col("b.key").alias("right_key"))
    none = F.lit(None).cast("string")
    by_key = met.where(equal).select(frame, F.col("key").alias("left_key"), F.col("key").alias("right_key"), F.lit("key").alias("how"))
    left_alone = a_rest.select(frame, F.col("key").alias("left_key")).join(placed, [frame, "left_key"], "left_anti").select(frame, "left_key", none.alias("right_key"), F.lit("left").alias("how"))
    right_alone = b_rest.select(frame, F.col("key").alias("right_key")).join(placed, [frame, "right_key"], "left_anti").select(frame, none.alias("left_key"), "right_key", F.lit("right").alias("how"))
    return by_key.unionByName(placed.withColumn("how", F.lit("place"))).unionByName(left_alone).unionByName(right_alone)


def comparison(left: DataFrame, right: DataFrame, frame: str, fields: list[str], keep: Keep) -> DataFrame:
    """The pairs of `compare_boxes` with status (`same`, `changed`, `left-only`, `right-only`) and changed: the fields in which a pair differs, null and empty being one."""
    pairs = compare_boxes(left, right, frame, keep)
    for side, df in (("left", left), ("right", right)):
        last = top_one(df, [frame, "key"], F.col("pos").desc()).select(F.col(frame).alias("__frame"), F.col("key").cast("string").alias("__key"), F.struct(*fields).alias(f"__{side}"))
        pairs = pairs.join(last, F.col(frame).eqNullSafe(F.col("__frame")) & (F.col(f"{side}_key") == F.col("__key")), "left").drop("__frame", "__key")
    both = F.col("how").isin("key", "place")
    changed = F.filter(F.array(*[F.when(both & stable_differs(F.col(f"__left.{f}"), F.col(f"__right.{f}")), F.lit(f)) for f in fields]), lambda f: f.isNotNull())
    pairs = pairs.withColumn("changed", changed)
    status = F.when(F.col("how") == "left", "left-only").when(F.col("how") == "right", "right-only").when(F.size("changed") > 0, "changed").otherwise("same")
    return pairs.withColumn("status", status).drop("__left", "__right")


def settle_in_turn(offers: DataFrame, frame: str, keep: Keep, only: bool) -> DataFrame:
    """frame, a, b: what the rows a of a frame take one after the other, each at its turn and for good.

    offers: frame, a, b, wish, and rows without wish, which tie a to a place b that it shares with others but never takes. `only`: a row takes its offer if exactly one is free, else nothing;
    otherwise the free one with the least (wish, b). A round settles the rows that are the earliest for everything they are tied to.
    """
    left, taken = keep(offers.select(frame, "a", "b", "wish"), "offers"), None
    while not left.isEmpty():
        ties = left.join(left.groupBy(frame, "b").agg(F.min("a").alias("first")), [frame, "b"])
        wishes = F.struct("wish", "b")
        ready = ties.groupBy(frame, "a").agg(F.bool_and(F.col("a") == F.col("first")).alias("ready"), F.count("wish").alias("n"), F.min(F.when(F.col("wish").isNotNull(), wishes)).alias("best")).where("ready")
        took = F.col("n") == 1 if only else F.col("n") > 0
        done = keep(ready.select(frame, "a", F.when(took, F.col("best.b")).alias("got")), "settled")
        new = done.where("got IS NOT NULL").select(frame, "a", F.col("got").alias("b"))
        rest = left.join(done.select(frame, "a"), [frame, "a"], "left_anti").join(new.select(frame, "b"), [frame, "b"], "left_anti")
        before, left = left, keep(rest.select(frame, "a", "b", "wish"), "offers")
        taken = new if taken is None else taken.unionByName(new)
        drop(before)
    return taken if taken is not None else left.select(frame, "a", "b")


def ground(controls: DataFrame, nodes: DataFrame, frame: str, keep: Keep) -> DataFrame:
    """frame, key, node, how (`resource`, `text`, `nearest`): the platform node behind each recognised control; each node serves once.

    controls: frame, key, pos, resources and texts (arrays), container, widget (a pattern of classes, or null), group, y; nodes: frame, node, resource, text, description, class, y.
    Controls go in order of pos, three times: to the one free node with one of their resource ids; those that are no containers to the one free node that shows one of their texts; then to the
    free node of their class nearest to the y of the node that a control of their group got last by the first two rules, else to their own y, the first of equals.
    """
    a = controls.withColumn("a", F.struct("pos", "key"))
    plain = F.lit(0.0).alias("wish")
    got = None

    def rest(df: DataFrame, column: str) -> DataFrame:
        return df if got is None else df.join(got.select(frame, F.col(column)), [frame, column], "left_anti")

    seen = F.explode(F.array_distinct(F.array(F.coalesce("text", F.lit("")), F.coalesce("description", F.lit("")))))
    for how, asked, wanted, shown in (
        ("resource", a, "resources", nodes.select(frame, "node", F.col("resource").alias("shown"))),
        ("text", a.where("NOT coalesce(container, false)"), "texts", nodes.select(frame, "node", seen.alias("shown"))),
    ):
        asked, shown = rest(asked, "a").select(frame, "a", F.explode(F.array_distinct(wanted)).alias("shown")).where("shown <> ''"), rest(shown, "node")
        offers = asked.join(shown, [frame, "shown"]).select(frame, "a", F.col("node").alias("b")).distinct().select(frame, "a", "b", plain)
        new = settle_in_turn(offers, frame, keep, True).select(frame, "a", F.col("b").alias("node"), F.lit(how).alias("how"))
        got = keep(new if got is None else got.unionByName(new), "grounded")
    anchors = got.join(a.select(frame, "a", "group"), [frame, "a"]).join(nodes.select(frame, "node", "y"), [frame, "node"]).where("group IS NOT NULL")
    anchors = anchors.groupBy(frame, "group").agg(F.max_by("y", F.struct((F.col("how") == "text").alias("late"), "a")).alias("anchor"))
    asked = rest(a, "a").where("widget IS NOT NULL").join(anchors, [frame, "group"], "left").select(frame, "a", "widget", F.coalesce("anchor", "y").alias("expected"))
    free = rest(nodes, "node").select(frame, "node", "class", F.col("y").alias("at"))
    kinds = asked.select("widget").distinct().join(free.select("class").distinct(), F.regexp_like("class", F.col("widget")))  # few patterns, few classes
    offers = asked.join(kinds, "widget").join(free, [frame, "class"]).select(frame, "a", F.col("node").alias("b"), F.abs(F.col("at") - F.col("expected")).alias("wish"))
    nearest = choose_in_turn(offers, frame, keep).select(frame, "a", F.col("b").alias("node"), F.lit("nearest").alias("how"))
    return got.unionByName(nearest).select(frame, F.col("a.key").alias("key"), "node", "how")
