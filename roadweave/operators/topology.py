"""From raw lines to a graph: junction splits, nodes, crossings and what is known about them.

Lines meet by the grid cells that their segments touch, so every spatial test is an equi-join with an
exact check; a point lies in one cell only, so it meets a line at most once for each of its segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .connectivity import label_edges

SPLIT, REVIEW, NODE, CELL = 0.05, 5.0, 0.01, 50.0
PLACE, WITNESS, CONTEXT, STRUCTURE, ALIGN = 25.0, 1.0, 300.0, 25.0, 20.0
TANGENTIAL, CORRIDOR, RUN = 30.0, 8.0, 60.0
AT_GRADE, SEPARATED, UNRESOLVED = "AT_GRADE", "GRADE_SEPARATED", "UNRESOLVED"
POLICIES = ("none", "evidence", "confirmed", "possible")


def _cells(minx: Column, miny: Column, maxx: Column, maxy: Column, size: float) -> Column:
    low, high = (lambda v: F.floor(v / size)), (lambda v: F.floor(v / size))
    return F.explode(F.flatten(F.transform(F.sequence(low(minx), high(maxx)), lambda cx: F.transform(F.sequence(low(miny), high(maxy)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy"))))))


def by_cell(lines: DataFrame, keep: list[str], grow: float, size: float = CELL) -> DataFrame:
    """The columns kept, once for each cell that a segment, grown by a distance, touches."""
    s = lines.select(*keep, F.explode(G.segments(F.col("line"))).alias("s"))
    c = _cells(F.least("s.a.x", "s.b.x") - grow, F.least("s.a.y", "s.b.y") - grow, F.greatest("s.a.x", "s.b.x") + grow, F.greatest("s.a.y", "s.b.y") + grow, size)
    return s.select(*keep, c.alias("c")).select(*keep, "c.cx", "c.cy").distinct()


def near_points(points: DataFrame, lines: DataFrame, within: float, size: float = CELL) -> DataFrame:
    """``points(point, x, y)`` by ``lines(feature, line)`` -> point, feature, line, n (its length) and
    l, the nearest place, of all pairs within a distance."""
    dealt = by_cell(lines, ["feature"], within, size)
    p = points.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    # lines are computed from few bytes a row: by those they would be broadcast, and fill the driver
    met = p.join(dealt.hint("merge"), ["cx", "cy"]).join(lines.select("feature", "line").hint("merge"), "feature")
    met = met.withColumn("l", G.located(F.col("line"), F.col("x"), F.col("y"))).where(F.col("l.distance") <= within)
    return met.withColumn("n", G.length(F.col("line"))).drop("cx", "cy")


def endpoints(lines: DataFrame) -> DataFrame:
    """(owner, x, y) of both ends of each line."""
    two = F.array(F.element_at("line", 1), F.element_at("line", -1))
    return lines.select(F.col("feature").alias("owner"), F.explode(two).alias("p")).select("owner", "p.x", "p.y")


def junctions(lines: DataFrame) -> DataFrame:
    """Ends of lines within the review tolerance of another line: (feature, owner, x, y, distance,
    along, kind). A ``cut`` is an end on the line's inside; a ``near_miss`` is not joined; ends that
    coincide with the line's own ends are neither."""
    ends = endpoints(lines).withColumn("point", F.struct("owner", "x", "y"))
    met = near_points(ends, lines, REVIEW).where("owner <> feature")
    first, last = F.element_at("line", 1), F.element_at("line", -1)
    own = F.least(F.hypot(F.col("x") - first.x, F.col("y") - first.y), F.hypot(F.col("x") - last.x, F.col("y") - last.y)) <= SPLIT
    inside = (F.col("l.along") > SPLIT) & (F.col("l.along") < F.col("n") - SPLIT)
    kind = F.when(F.col("l.distance") > SPLIT, "near_miss").when(inside, "cut")
    return met.where(~own).select("feature", "owner", "x", "y", F.col("l.distance").alias("distance"), F.col("l.along").alias("along"), kind.alias("kind")).where("kind is not null")


def dedupe_cuts(cuts: DataFrame) -> DataFrame:
    """``cuts(feature, along, x, y)`` -> those more than the tolerance beyond the last one kept."""
    kind = "array<struct<along:double,x:double,y:double>>"
    ordered = F.array_sort(F.collect_set(F.struct(F.col("along").cast("double").alias("along"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))))
    kept = F.aggregate("c", F.array().cast(kind), lambda a, p: F.when((F.size(a) > 0) & (p.along - F.element_at(a, -1).along <= SPLIT), a).otherwise(F.concat(a, F.array(p))))
    return cuts.groupBy("feature").agg(ordered.alias("c")).select("feature", F.explode(kept).alias("k")).select("feature", "k.along", "k.x", "k.y")


def cut_lines(lines: DataFrame, cuts: DataFrame) -> DataFrame:
    """(feature, part, parts, line) of the pieces. Each cut puts in the given point, so that both
    roads of a junction end on the very same coordinates."""
    by = dedupe_cuts(cuts).groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("along", "x", "y"))).alias("cuts"))
    j = lines.select("feature", "line").join(by, "feature", "left")
    upto = F.transform("line", lambda p, i: F.aggregate(F.slice(F.transform(G.segments(F.col("line")), lambda s: s.length), F.lit(1), i), F.lit(0.0), lambda a, v: a + v))
    vertices = F.transform("line", lambda p, i: F.struct(F.get("upto", i).alias("along"), F.lit(0).alias("cut"), p.x.cast("double").alias("x"), p.y.cast("double").alias("y")))
    marks = F.transform(F.coalesce("cuts", F.array().cast("array<struct<along:double,x:double,y:double>>")), lambda c: F.struct(c.along.alias("along"), F.lit(1).alias("cut"), c.x.alias("x"), c.y.alias("y")))
    p = j.withColumn("upto", upto).withColumn("p", F.array_sort(F.concat(vertices, marks)))
    # vertices that a cut stands on give way to it
    p = p.withColumn("p", F.filter("p", lambda v: (v.cut == 1) | ~F.exists(F.coalesce("cuts", F.array().cast("array<struct<along:double,x:double,y:double>>")), lambda c: F.hypot(c.x - v.x, c.y - v.y) <= 1e-9)))
    at = F.filter(F.transform("p", lambda v, i: F.when((v.cut == 1) | (i == 0) | (i == F.size("p") - 1), i)), lambda i: i.isNotNull())
    q = p.withColumn("at", at).select("feature", "p", "at", F.explode(F.sequence(F.lit(0), F.size("at") - 2)).alias("part"))
    piece = F.transform(F.slice("p", F.get("at", F.col("part")) + 1, F.get("at", F.col("part") + 1) - F.get("at", F.col("part")) + 1), lambda v: F.struct(v.x.alias("x"), v.y.alias("y")))
    return q.select("feature", "part", (F.size("at") - 1).alias("parts"), piece.alias("line"))


def assign_nodes(points: DataFrame, within: float = NODE) -> DataFrame:
    """``points(x, y)`` -> (x, y, node): ends within the tolerance, chained, are one node, numbered
    by the order of their smallest coordinates."""
    p = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    key = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    cell = lambda c: F.floor(F.col(c) / within)
    a = p.select(key("x", "y").alias("u"), cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i, j))))"))
    b = p.select(key("x", "y").alias("v"), around.alias("o"), cell("x").alias("cx"), cell("y").alias("cy")).select("v", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    near = a.join(b, ["cx", "cy"]).where((F.col("u") < F.col("v")) & (F.hypot(F.col("u.x") - F.col("v.x"), F.col("u.y") - F.col("v.y")) <= within)).select("u", "v")
    label = label_edges(near, one_task=0)
    named = p.join(label.select(F.col("node.x").alias("x"), F.col("node.y").alias("y"), "component"), ["x", "y"], "left").withColumn("least", F.coalesce("component", key("x", "y")))
    return named.join(ranked(named.select("least").distinct(), "least", "node"), "least").select("x", "y", "node")


def ranked(df: DataFrame, by: str, name: str) -> DataFrame:
    """Dense numbers from 0 in the order of a column, without a single-task sort."""
    from ..plans.scratch import materialise

    n = df.sparkSession.sparkContext.defaultParallelism
    r = materialise(df.repartitionByRange(n, by).withColumn("_p", F.spark_partition_id()), "ranked")
    sizes = r.groupBy("_p").agg(F.count("*").alias("c"))
    before = sizes.select("_p", (F.sum("c").over(Window.orderBy("_p")) - F.col("c")).alias("b"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(by))
    return r.withColumn("_r", within).join(F.broadcast(before), "_p").withColumn(name, F.col("b") + F.col("_r") - 1).drop("_p", "_r", "b")


def crossings(lines: DataFrame, guard: float = SPLIT) -> DataFrame:
    """(a, b, x, y, along_a, along_b, angle): where two lines cross and neither ends within the guard
    (below zero: wherever they meet in a point). Lines that run on each other are no crossing."""
    dealt = by_cell(lines, ["feature"], 0.0)
    pairs = dealt.select(F.col("feature").alias("a"), "cx", "cy").join(dealt.select(F.col("feature").alias("b"), "cx", "cy"), ["cx", "cy"]).where("a < b").select("a", "b").distinct()
    side = lambda n: lines.select(F.col("feature").alias(n), F.col("line").alias(f"line_{n}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    s = j.select("a", "b", "line_a", "line_b", F.explode(G.segments(F.col("line_a"))).alias("s")).select("a", "b", "line_a", "line_b", "s", F.explode(G.segments(F.col("line_b"))).alias("t"))
    dx1, dy1, dx2, dy2 = (F.col("s.b.x") - F.col("s.a.x"), F.col("s.b.y") - F.col("s.a.y"), F.col("t.b.x") - F.col("t.a.x"), F.col("t.b.y") - F.col("t.a.y"))
    det = dx1 * dy2 - dy1 * dx2
    ex, ey = F.col("t.a.x") - F.col("s.a.x"), F.col("t.a.y") - F.col("s.a.y")
    s = s.withColumn("u", F.when(F.abs(det) > 1e-12, (ex * dy2 - ey * dx2) / det)).withColumn("v", F.when(F.abs(det) > 1e-12, (ex * dy1 - ey * dx1) / det))
    s = s.where("u between 0 and 1 and v between 0 and 1").withColumn("x", F.col("s.a.x") + F.col("u") * dx1).withColumn("y", F.col("s.a.y") + F.col("u") * dy1)
    # a crossing at a vertex is met by both segments there
    s = s.groupBy("a", "b", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")).agg(F.first("line_a").alias("line_a"), F.first("line_b").alias("line_b"))
    for n in ("a", "b"):
        s = s.withColumn(f"along_{n}", G.located(F.col(f"line_{n}"), F.col("x"), F.col("y")).along).withColumn(f"n_{n}", G.length(F.col(f"line_{n}")))
        s = s.where((F.col(f"along_{n}") > guard) & (F.col(f"along_{n}") < F.col(f"n_{n}") - guard))
    angle = G.fold90(G.local_bearing(F.col("line_a"), F.col("along_a")) - G.local_bearing(F.col("line_b"), F.col("along_b")))
    return s.select("a", "b", "x", "y", "along_a", "along_b", F.round(angle, 6).alias("angle"), "line_a", "line_b")


def _count_near(points: DataFrame, lines: DataFrame, within: float, name: str) -> DataFrame:
    return near_points(points, lines, within, within).groupBy("point").agg(F.count("*").alias(name))


def same_corridor(found: DataFrame) -> DataFrame:
    """``found(point, line_a, along_a, line_b, along_b)`` -> the points where the two lines stay side
    by side for a whole run from where they cross, on either line and in either direction. A line
    that is too short to judge in a direction gives no answer there."""
    side = lambda n, o: F.struct(F.lit(n).alias("side"), F.col(f"line_{n}").alias("line"), F.col(f"along_{n}").alias("along"), F.col(f"line_{o}").alias("other"))
    s = found.select("point", F.explode(F.array(side("a", "b"), side("b", "a"))).alias("s")).select("point", "s.*")
    s = s.withColumn("n", G.length(F.col("line"))).withColumn("sign", F.explode(F.array(F.lit(-1.0), F.lit(1.0))))
    s = s.where((F.col("along") + F.col("sign") * RUN >= 0) & (F.col("along") + F.col("sign") * RUN <= F.col("n")))
    s = s.withColumn("share", F.explode(F.array(*map(F.lit, (0.25, 0.5, 0.75, 1.0)))))
    at = G.interpolate(F.col("line"), (F.col("along") + F.col("sign") * RUN * F.col("share")) / F.col("n"))
    near = G._bind(at, lambda p: G.distance_to_point(F.col("other"), p.x, p.y)) <= CORRIDOR
    return s.groupBy("point", "side", "sign").agg(F.bool_and(near).alias("stays")).where("stays").select("point").distinct()


def context(found: DataFrame, lines: DataFrame, structures: DataFrame) -> DataFrame:
    """What is measured around each crossing: a third line's end within a metre, ramps and one-way
    highways within three hundred, the nearest mapped structure within twenty-five and how far it
    runs along either road, whether the two are one road recorded twice, and both sides' attributes."""
    c = found.withColumn("point", F.struct("a", "b", "x", "y"))
    p = c.select("point", "x", "y")
    cell = lambda v, s: F.floor(F.col(v) / s)
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i, j))))"))
    ends = endpoints(lines).select("owner", F.col("x").alias("ex"), F.col("y").alias("ey"), cell("x", WITNESS).alias("cx"), cell("y", WITNESS).alias("cy"))
    q = p.select("point", "x", "y", cell("x", WITNESS).alias("cx"), cell("y", WITNESS).alias("cy"), around.alias("o")).select("point", "x", "y", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    witness = q.join(ends, ["cx", "cy"]).where((F.hypot(F.col("x") - F.col("ex"), F.col("y") - F.col("ey")) <= WITNESS) & (F.col("owner") != F.col("point.a")) & (F.col("owner") != F.col("point.b")))
    witness = witness.select("point").distinct().withColumn("witness", F.lit(True))
    ramps = _count_near(p, lines.where("is_ramp"), CONTEXT, "ramps_near")
    highways = _count_near(p, lines.where("rca_code = 1 AND oneway"), CONTEXT, "highways_near")
    s = near_points(c.select("point", "x", "y", "line_a", "along_a", "line_b", "along_b"), structures.select(F.col("structure").alias("feature"), "line"), STRUCTURE)
    bearing = G.local_bearing(F.col("line"), F.col("l.along"))
    align = F.least(*(G.fold90(bearing - G.local_bearing(F.col(f"line_{n}"), F.col(f"along_{n}"))) for n in ("a", "b")))
    nearest = s.select("point", F.struct(F.round("l.distance", 6).alias("distance"), "feature", F.round(align, 6).alias("align")).alias("m")).groupBy("point").agg(F.min("m").alias("m"))
    nearest = nearest.select("point", F.col("m.distance").alias("structure_distance"), F.col("m.align").alias("structure_align"))
    duplicate = same_corridor(c).withColumn("duplicate", F.lit(True))
    c = c.join(duplicate, "point", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False))).join(witness, "point", "left").join(ramps, "point", "left").join(highways, "point", "left").join(nearest, "point", "left")
    side = lambda n: lines.select(F.col("feature").alias(n), *(F.col(k).alias(f"{k}_{n}") for k in ("rca_code", "oneway", "is_ramp", "asset_type", "name", "height_limit")))
    c = c.join(side("a"), "a").join(side("b"), "b")
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long")
    return c.withColumns({"witness": F.coalesce("witness", F.lit(False)), "ramps_near": zero("ramps_near"), "highways_near": zero("highways_near")}).drop("point")


#: Words that name a structure at a place, or a class of road (fixed values).
STRUCTURE_WORDS, ROAD_CLASS_WORDS = ("bridge", "overpass", "underpass", "flyover", "viaduct", "tunnel"), ("ramp", "interchange")


def named_structure(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike("|".join(STRUCTURE_WORDS)), F.lit(False))


def named_road_class(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike("|".join(ROAD_CLASS_WORDS)), F.lit(False))


def classify(c: DataFrame) -> DataFrame:
    """disposition, reason, confidence: the first rule that applies. Evidence of a structure comes
    before evidence of a junction, and classes of roads are evidence of neither."""
    either = lambda f: f("a") | f("b")
    both = lambda f: f("a") & f("b")
    ordinary = both(lambda n: (F.col(f"asset_type_{n}") == 1) & ~F.col(f"oneway_{n}"))
    rules = [
        (F.col("a") == F.col("b"), UNRESOLVED, "SAME_SOURCE_FEATURE"),
        (F.col("duplicate"), UNRESOLVED, "DUPLICATE_GEOMETRY"),
        (F.col("angle") < TANGENTIAL, UNRESOLVED, "TANGENTIAL"),
        (F.coalesce((F.col("structure_distance") <= STRUCTURE) & (F.col("structure_align") <= ALIGN), F.lit(False)), SEPARATED, "STRUCTURE_MAPPED"),
        (either(lambda n: named_structure(F.col(f"name_{n}"))), SEPARATED, "NAMED_STRUCTURE"),
        (either(lambda n: F.col(f"is_ramp_{n}")), UNRESOLVED, "RAMP"),
        (either(lambda n: F.col(f"asset_type_{n}") == 2), UNRESOLVED, "CONNECTOR"),
        (either(lambda n: named_road_class(F.col(f"name_{n}"))), UNRESOLVED, "NAMED_ROAD_CLASS"),
        (either(lambda n: (F.col(f"rca_code_{n}") == 1) & F.col(f"oneway_{n}")), UNRESOLVED, "MOTORWAY_CARRIAGEWAY"),
        (either(lambda n: F.col(f"height_limit_{n}")), UNRESOLVED, "HEIGHT_LIMIT"),
        (F.col("ramps_near") > 0, UNRESOLVED, "RAMP_CONTEXT"),
        (F.col("highways_near") > 0, UNRESOLVED, "MOTORWAY_CONTEXT"),
        (F.col("witness") & ordinary, AT_GRADE, "JUNCTION_WITNESS"),
        (ordinary, AT_GRADE, "ORDINARY_CROSSROADS"),
    ]
    answer = lambda d, r: F.struct(F.lit(d).alias("d"), F.lit(r).alias("r"))
    chain = F.when(rules[0][0], answer(*rules[0][1:]))
    for on, d, r in rules[1:]:
        chain = chain.when(on, answer(d, r))
    c = c.withColumn("_r", chain.otherwise(answer(UNRESOLVED, "NO_EVIDENCE_EITHER_WAY")))
    confidence = F.when(F.col("_r.r") == "JUNCTION_WITNESS", "high").when(F.col("_r.r") == "ORDINARY_CROSSROADS", "medium").when(F.col("_r.d") == SEPARATED, "high").otherwise("low")
    return c.withColumns({"disposition": F.col("_r.d"), "reason": F.col("_r.r"), "confidence": confidence}).drop("_r")


def places(found: DataFrame, within: float = PLACE) -> DataFrame:
    """The crossings with ``place``: points chained by a distance, by the least (a, b) among them."""
    cell = lambda v: F.floor(F.col(v) / within)
    key = F.struct("a", "b", "x", "y")
    p = found.select(key.alias("u"), "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i, j))))"))
    q = p.select(F.col("u").alias("v"), around.alias("o"), "cx", "cy").select("v", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    near = p.join(q, ["cx", "cy"]).where((F.col("u") < F.col("v")) & (F.hypot(F.col("x") - F.col("v.x"), F.col("y") - F.col("v.y")) <= within)).select("u", "v")
    label = label_edges(near, one_task=0).select("node.*", "component")
    return found.join(label, ["a", "b", "x", "y"], "left").withColumn("place", F.coalesce("component", key)).drop("component")


def demote_mixed(found: DataFrame) -> DataFrame:
    """A place whose crossings disagree settles none of them: one node would grant every road there
    every turn."""
    kinds = found.groupBy("place").agg((F.countDistinct("disposition") > 1).alias("mixed"))
    f = found.join(kinds, "place")
    return f.withColumns({"disposition": F.when(F.col("mixed"), UNRESOLVED).otherwise(F.col("disposition")), "reason": F.when(F.col("mixed"), "MIXED_PLACE").otherwise(F.col("reason"))})


def decide(found: DataFrame, overrides: DataFrame, today: str) -> DataFrame:
    """``overrides(source_a, source_b, x, y, decision, retired_on)``: live ones for either order of
    the pair, within five metres. decision is CONFLICT where they disagree, null where there are none."""
    live = overrides.where(F.col("retired_on").isNull() | (F.lit(today).cast("date") < F.col("retired_on")))
    o = live.select(F.least("source_a", "source_b").alias("a"), F.greatest("source_a", "source_b").alias("b"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("decision").alias("said"))
    met = found.select("a", "b", "x", "y").join(o, ["a", "b"]).where(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) <= REVIEW)
    d = met.groupBy("a", "b", "x", "y").agg(F.when(F.countDistinct("said") > 1, "CONFLICT").otherwise(F.min("said")).alias("decision"))
    return found.join(d, ["a", "b", "x", "y"], "left")


def gate(found: DataFrame, policy: str, research: bool = False) -> DataFrame:
    """noded: whether the crossing becomes a node. Only ``evidence``, the policy of published answers,
    is open to all: there a live decision connects, and nothing the classifier thinks does."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {', '.join(POLICIES)}")
    if policy in ("confirmed", "possible") and not research:
        raise ValueError(f"{policy} lets the classifier make nodes: for research only")
    safe = ~F.col("reason").isin("SAME_SOURCE_FEATURE", "DUPLICATE_GEOMETRY", "TANGENTIAL", "MIXED_PLACE")
    asked = {"none": F.lit(False), "evidence": F.coalesce(F.col("decision") == AT_GRADE, F.lit(False)), "confirmed": F.col("disposition") == AT_GRADE, "possible": F.col("disposition").isin(AT_GRADE, UNRESOLVED)}[policy]
    return found.withColumns({"safe_to_node": safe, "noded": asked & safe})


def crossing_cuts(found: DataFrame) -> DataFrame:
    """Both lines of a noded crossing are cut at the same point."""
    two = F.array(*(F.struct(F.col(n).alias("feature"), F.col(f"along_{n}").alias("along")) for n in ("a", "b")))
    return found.where("noded").select(F.explode(two).alias("t"), "x", "y").select("t.feature", "t.along", "x", "y")


def build(lines: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces with their end nodes (feature, part, parts, line, source, target), and the nodes."""
    from ..plans.scratch import materialise

    pieces = materialise(cut_lines(lines, cuts), "pieces")
    first, last = F.element_at("line", 1), F.element_at("line", -1)
    ends = pieces.select(F.explode(F.array(first, last)).alias("p")).select("p.x", "p.y")
    nodes = materialise(assign_nodes(ends), "nodes")
    s, t = (nodes.select(F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"), F.col("node").alias(name)) for n, name in (("s", "source"), ("t", "target")))
    p = pieces.withColumns({"sx": first.x, "sy": first.y, "tx": last.x, "ty": last.y})
    return p.join(s, ["sx", "sy"]).join(t, ["tx", "ty"]).drop("sx", "sy", "tx", "ty"), nodes


def audit(found: DataFrame, pieces: DataFrame, nodes: DataFrame) -> DataFrame:
    """Crossings left apart whose roads share a node within a metre all the same; none is sound."""
    touch = pieces.select("feature", F.explode(F.array("source", "target")).alias("node")).distinct()
    at = nodes.groupBy("node").agg(F.min("x").alias("nx"), F.min("y").alias("ny"))
    c = found.where("NOT noded").select("a", "b", "x", "y")
    both = c.join(touch.select(F.col("feature").alias("a"), "node"), "a").join(touch.select(F.col("feature").alias("b"), "node"), ["b", "node"])
    return both.join(at, "node").where(F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny")) <= 1.0).select("a", "b", "x", "y", "node")


def resolve_restrictions(sequences: DataFrame, pieces: DataFrame) -> DataFrame:
    """``sequences(id, features)`` -> (id, parts): the first chain of child pieces, one of each
    feature in turn, in which neighbours share a node. One join for each further feature."""
    ends = pieces.select("feature", "part", F.array("source", "target").alias("ends"))
    longest = sequences.agg(F.max(F.size("features"))).first()[0] or 0
    first = ends.select(F.col("feature").alias("f"), F.col("part").alias("p"), F.col("ends").alias("e"))
    chains = sequences.join(first, F.get("features", F.lit(0)) == F.col("f")).select("id", "features", F.array("p").alias("parts"), F.col("e").alias("at"))
    done = chains.where(F.size("features") == 1)
    for k in range(1, longest):
        nxt = ends.select(F.col("feature").alias("f"), F.col("part").alias("p"), F.col("ends").alias("e"))
        chains = chains.where(F.size("features") > k).join(nxt, (F.get("features", F.lit(k)) == F.col("f")) & F.arrays_overlap("at", "e")).select("id", "features", F.concat("parts", F.array("p")).alias("parts"), F.col("e").alias("at"))
        done = done.unionByName(chains.where(F.size("features") == k + 1))
    return done.groupBy("id").agg(F.min("parts").alias("parts"))
