"""Projections of a page graph: composition checks, page statistics, layered views, migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattika.operators.constraints import violations
from lattika.operators.graph import Keep, terminal_owner


def page_statistics(pages: DataFrame, elements: DataFrame, edges: DataFrame, keep: Keep) -> DataFrame:
    """page, owned, inbound, outbound, shared for every page, with zeros. pages: page; elements: element, parent, page; edges: source, target, shared.

    A page owns its elements and all that lie in them: an element counts for the page of its topmost ancestor.
    """
    tops = terminal_owner(elements.select(F.col("element").alias("node"), "parent"), keep).where("terminal IS NOT NULL").select(F.col("terminal").alias("element"))
    owned = tops.join(elements.select("element", "page").hint("merge"), "element").groupBy("page").agg(F.count("*").alias("owned"))
    into = edges.groupBy(F.col("target").alias("page")).agg(F.count("*").alias("inbound"))
    out = edges.groupBy(F.col("source").alias("page")).agg(F.count("*").alias("outbound"), F.count_if("shared").alias("shared"))
    joined = pages.select("page")
    for part in (owned, into, out):
        joined = joined.join(part, "page", "left")
    return joined.fillna(0)


def layered_view(navigation: DataFrame, pages: DataFrame, edges: DataFrame, common: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a view in layers: what the bar at the bottom leads to, features, pages, and what all share.

    navigation: node, label, page_key, pos. pages: page, key, label, path (array), pos. edges: edge, source, target, kind, capability, preview, trigger, pos. `common`: the first part of the path of shared pages.
    nodes: node, kind (`nav`, `feature`, `page`, `shared`), label, page, edge (the one that leads there). A feature is the first two parts of a path; its default page has the key of
    fewest parts, the first of equals; it is entered by an edge from the page of its bar entry, one that opens before others. Pages are entered by an edge with a preview, one that
    opens before others; the default page by its feature's. links: link, source, target, kind (`navigation`, `relationship`), edge: a bar entry to its features, a feature to its
    default page, and one link for each pair of nodes that an opening edge joins, the first by pos, bar entries left out.
    """
    opens = F.col("capability").startswith("open_")
    moves = edges.where("kind = 'transition'").withColumn("__later", ~F.coalesce(opens, F.lit(False)))
    nav = navigation.join(pages.select(F.col("key").alias("page_key"), F.col("page").alias("nav_page")), "page_key", "left")
    placed = pages.withColumns({"domain": F.get("path", F.lit(0)), "feature": F.get("path", F.lit(1))})
    inside = placed.where((F.col("domain") != "") & (F.col("feature") != "") & (F.col("domain") != common))
    default = F.min_by("page", F.struct(F.size(F.split("key", "[.]")), F.col("pos"))).alias("default_page")
    features = inside.groupBy("domain", "feature").agg(default).withColumn("node", F.concat_ws(".", F.lit("feature"), "domain", "feature"))
    features = features.join(nav.select(F.col("label").alias("domain"), F.col("node").alias("nav_node"), "nav_page"), "domain", "left")
    entry = moves.join(features.select("node", F.col("nav_page").alias("source"), F.col("default_page").alias("target")), ["source", "target"]).groupBy("node").agg(F.min_by("edge", F.struct("__later", "pos")).alias("entry"))
    features = features.join(entry, "node", "left")
    arrives = moves.where("source <> target AND preview IS NOT NULL").groupBy(F.col("target").alias("page")).agg(F.min_by("edge", F.struct("__later", "pos")).alias("arrival"))
    inside = inside.join(features.select("domain", "feature", "default_page", "entry"), ["domain", "feature"]).join(arrives, "page", "left")
    own_label = F.when(F.size(F.split("key", "[.]")) == 2, F.concat("feature", F.lit(HOME))).otherwise(_page_label(F.col("key"), F.col("label")))
    none = F.lit(None).cast("string")
    nodes = (
        nav.select("node", F.lit("nav").alias("kind"), "label", F.col("nav_page").alias("page"), none.alias("edge"))
        .unionByName(features.select("node", F.lit("feature").alias("kind"), F.col("feature").alias("label"), F.col("default_page").alias("page"), F.col("entry").alias("edge")))
        .unionByName(inside.select(F.concat(F.lit("page."), "key").alias("node"), F.lit("page").alias("kind"), own_label.alias("label"), "page", F.when(F.col("page") == F.col("default_page"), F.col("entry")).otherwise(F.col("arrival")).alias("edge")))
        .unionByName(placed.where(F.col("domain") == common).join(arrives, "page", "left").select(F.concat(F.lit("shared."), "key").alias("node"), F.lit("shared").alias("kind"), F.regexp_replace("label", f"^{common}-", "").alias("label"), "page", F.col("arrival").alias("edge")))
    )
    shown = nodes.where("page IS NOT NULL AND kind <> 'feature'").withColumn("__rank", F.when(F.col("kind") == "nav", 0).otherwise(1))
    at = shown.groupBy("page").agg(F.max_by("node", "__rank").alias("node"))  # a page inside a feature stands for itself, a bar entry only where there is none
    ends = moves.where("source <> target AND NOT __later")
    for end in ("source", "target"):
        ends = ends.join(at.select(F.col("page").alias(end), F.col("node").alias(f"{end}_node")), end)
    bars = nav.select(F.col("node").alias("__bar"))
    for end in ("source_node", "target_node"):
        ends = ends.join(bars, F.col(end) == F.col("__bar"), "left_anti")
    related = ends.groupBy("source_node", "target_node").agg(F.min_by("edge", "pos").alias("edge"))
    links = (
        features.where("nav_node IS NOT NULL").select(F.concat(F.lit("view.entry."), "node").alias("link"), F.col("nav_node").alias("source"), F.col("node").alias("target"), F.lit("navigation").alias("kind"), F.col("entry").alias("edge"))
        .unionByName(features.join(at.select(F.col("page").alias("default_page"), F.col("node").alias("to")), "default_page").select(F.concat(F.lit("view.default."), "node").alias("link"), F.col("node").alias("source"), F.col("to").alias("target"), F.lit("relationship").alias("kind"), F.col("entry").alias("edge")))
        .unionByName(related.select(F.concat(F.lit("view.relation."), F.col("edge").cast("string")).alias("link"), F.col("source_node").alias("source"), F.col("target_node").alias("target"), F.lit("relationship").alias("kind"), "edge"))
    )
    return nodes, links


# What pages are called by the end of their keys, what is added to the name of a feature's first page and of a page of settings.
PAGE_LABELS = {
    ".people": "全部成员",
    ".remove_confirmation": "移除确认",
    ".popup_interval_selector": "弹窗提醒间隔选择",
    ".reminder_method_selector": "提醒方式选择",
    ".sms_phone_interval_selector": "短信/电话提醒间隔",
    ".sound_selector": "提示音选择",
}
HOME, SETTINGS_END, SETTINGS = "首页", ".settings", "设置"


def _page_label(key: Column, label: Column) -> Column:
    """The last part of a label, unless the key's end says what the page is."""
    last = F.coalesce(F.nullif(F.element_at(F.split(label, "-"), -1), F.lit("")), label)
    out = F.when(key.endswith(SETTINGS_END), F.concat(last, F.lit(SETTINGS)))
    for end, name in PAGE_LABELS.items():
        out = out.when(key.endswith(end), name)
    return out.otherwise(last)


def migrate(records: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, errors) after a ledger of key changes (old_key, new_key; null: deleted). records: id, key. Ids stay.

    A record goes only by the ledger. A ledger row must name exactly one record, and no two records may end with one key.
    """
    named = ledger.join(records.groupBy(F.col("key").alias("old_key")).agg(F.count("*").alias("n")), "old_key", "left")
    bad = violations(named.where("n IS NULL OR n <> 1"), "ledger_target", F.col("old_key"), F.coalesce("n", F.lit(0)))
    moves = ledger.select(F.col("old_key").alias("key"), "new_key", F.lit(True).alias("__moved"))
    out = records.join(moves, "key", "left").where("__moved IS NULL OR new_key IS NOT NULL").withColumn("key", F.coalesce("new_key", "key")).drop("new_key", "__moved")
    twice = violations(out.groupBy("key").count().where("count > 1"), "key_repeated", F.col("key"), F.col("count"))
    return out, bad.unionByName(twice)


def group_selection(elements: DataFrame, chosen: DataFrame, new_id: str) -> DataFrame:
    """elements (id, parent, x, y, width, height) with a container around the chosen ones, under their parent if they share one."""
    inside = elements.join(chosen.select("id"), "id", "left_semi")
    left, top = F.min("x"), F.min("y")
    parent = F.when((F.count_distinct("parent") == 1) & (F.count("parent") == F.count("*")), F.min("parent"))
    box = inside.agg(F.lit(new_id).alias("id"), parent.alias("parent"), left.alias("x"), top.alias("y"), (F.max(F.col("x") + F.col("width")) - left).alias("width"), (F.max(F.col("y") + F.col("height")) - top).alias("height")).where("x IS NOT NULL")
    moved = inside.withColumn("parent", F.lit(new_id))
    return elements.join(chosen.select("id"), "id", "left_anti").unionByName(moved).unionByName(box)


def hit_test(elements: DataFrame, points: DataFrame) -> DataFrame:
    """point, element, place: the elements under each point, smallest area first (place from 1); frames keep the join small. elements: frame, element, x, y, width, height; points: frame, point, px, py."""
    on = elements.join(points, "frame").where("px BETWEEN x AND x + width AND py BETWEEN y AND y + height")
    return on.withColumn("place", F.row_number().over(Window.partitionBy("point").orderBy(F.col("width") * F.col("height"), "element"))).select("point", "element", "place")


def clicked(elements: DataFrame, points: DataFrame) -> DataFrame:
    """point, element: what a click takes: the smallest element under the point, or the next larger one where that point's `selected` is under it; after the largest comes the smallest. points: those of `hit_test`, with selected."""
    hits = hit_test(elements, points).join(points.select("point", "selected"), "point")
    at = F.max(F.when(F.col("element") == F.col("selected"), F.col("place"))).over(Window.partitionBy("point"))
    n = F.count("*").over(Window.partitionBy("point"))
    return hits.withColumn("__next", F.coalesce(at, F.lit(0)) % n + 1).where("place = __next").select("point", "element")
