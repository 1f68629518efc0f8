"""Graphs of records: closures by doubling, levels, and digests replayed along
references.

Levels and digests take a round for each level, and each edge is looked up once
its end is known. A node's ancestors come from its parents', so the work is that
of the rows of the closure; only what lies deeper than DEEP rounds is closed by
doubling, log d rounds of more work. Rounds are stored as columns and discarded
when the next stands; the driver sees counts alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import checkpointed, discard, stored
from .statistics import running_total

#: Rounds of one level each, before the rest is closed by doubling.
DEEP = 48


def _reached(edges: DataFrame) -> DataFrame:
    """(node, above) of all paths of edges (node, above), circles or not."""
    paths, n = checkpointed(edges.distinct()), -1
    while paths.count() != n:
        n = paths.count()
        longer = paths.alias("x").join(paths.alias("y"), F.col("x.above") == F.col("y.node")).select("x.node", "y.above")
        paths = checkpointed(paths.unionByName(longer).distinct())
    return paths


def closure(edges: DataFrame, child: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """(node, above, steps): what each node stands below, with the longest path's
    length; and (node, on_cycle): nodes on a circle, or below one, which are left
    out of the first. Edges with a null end are none."""
    e = checkpointed(edges.select(F.col(child).alias("node"), F.col(parent).alias("above")).filter("node is not null and above is not null").distinct())
    paths = e.withColumn("steps", F.lit(1).cast("long"))
    faulty = checkpointed(e.filter("node = above").select("node"))
    while True:
        # what reaches a circle goes: its paths would grow for ever
        below = paths.join(faulty.select(F.col("node").alias("above")), "above", "left_semi").select("node")
        known, faulty = faulty, checkpointed(faulty.unionByName(below).distinct())
        kept = checkpointed(paths.join(faulty, "node", "left_anti"))
        longer = kept.alias("x").join(kept.alias("y"), F.col("x.above") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("y.above").alias("above"), (F.col("x.steps") + F.col("y.steps")).alias("steps"))
        old = kept.withColumn("old", F.col("steps")).unionByName(longer.withColumn("old", F.lit(None).cast("long")))
        after = checkpointed(old.groupBy("node", "above").agg(F.max("steps").alias("steps"), F.max("old").alias("old")))
        paths = after.select("node", "above", "steps")
        grown = faulty.count() > known.count()
        circles = paths.filter("node = above").select("node")
        if not circles.isEmpty():
            faulty = checkpointed(faulty.unionByName(circles).distinct())
        elif not grown and after.filter("old is null or old < steps").isEmpty():
            break
    among = e.join(faulty, "node", "left_semi").join(faulty.select(F.col("node").alias("above")), "above", "left_semi").select("node", "above")
    circle = _reached(among).filter("node = above").select("node", F.lit(True).alias("on_cycle"))
    return paths, checkpointed(faulty.join(circle, "node", "left").select("node", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle")))


def on_circles(edges: DataFrame) -> DataFrame:
    """(node) of edges (node, above) that a path leads back to. Ends that nothing
    leaves or nothing enters go first, a layer a round; what paths remain is closed."""
    core = stored(edges.select("node", "above").filter("node is not null and above is not null").distinct())
    left = core.count()
    for _ in range(DEEP):
        inner = core.join(core.select(F.col("node").alias("above")).distinct(), "above", "left_semi").join(core.select(F.col("above").alias("node")).distinct(), "node", "left_semi")
        kept = stored(inner.select("node", "above"))
        discard(core)
        core, was = kept, left
        left = core.count()
        if left == was:
            break
    return stored(_reached(core).filter("node = above").select("node").distinct())


def _numbered(keys: DataFrame) -> DataFrame:
    """(key, n) of distinct keys: integers as they are, others any numbers."""
    if isinstance(keys.schema["key"].dataType, T.IntegralType):
        return keys.select("key", F.col("key").cast("long").alias("n"))
    return stored(keys.select("key", F.monotonically_increasing_id().alias("n")))


def _placed(e: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Of edges (node, above) between nodes that have something below them: (node,
    level), parts of (node, above) for all ancestors, and the edges of nodes that
    stand on or below a circle."""
    starts = e.select(F.col("above").alias("node")).distinct().join(e.select("node").distinct(), "node", "left_anti")
    front, paths, level = stored(starts.select("node", F.lit(0).cast("long").alias("level"))), [], 0
    known, open_ = [front], e.withColumn("done", F.lit(False))
    while True:
        seen = open_.join(front.select(F.col("node").alias("above"), F.lit(True).alias("_now")), "above", "left")
        marked = seen.select("node", "above", (F.col("done") | F.col("_now").isNotNull()).alias("done"))
        state = stored(marked.withColumn("ready", F.min("done").over(Window.partitionBy("node"))))
        ready = state.filter("ready").select("node", "above")
        if level:
            discard(last)  # noqa: F821
        last, open_, level = state, state.filter("not ready").drop("ready"), level + 1
        front = stored(ready.select("node").distinct().withColumn("level", F.lit(level).cast("long")))
        if front.isEmpty():
            return _union(known), paths, open_
        known.append(front)
        longer = ready
        if paths:
            older = _union(paths).select(F.col("node").alias("above"), F.col("above").alias("far"))
            longer = ready.unionByName(ready.join(older, "above").select("node", F.col("far").alias("above")))
        paths.append(stored(longer.distinct()))
        if level >= DEEP:
            newest = front.select(F.col("node").alias("above"), F.lit(True).alias("_now"))
            open_ = stored(open_.join(newest, "above", "left").select("node", "above", (F.col("done") | F.col("_now").isNotNull()).alias("done")))
            rest = open_.filter("not done").select("node", "above")
            deep, _ = closure(rest, "node", "above")
            # a deep node's ancestors: deep ones, and those of the edges that leave them
            legs = deep.select("node", F.col("above").alias("via"), "steps").unionByName(deep.select("node").distinct().select("node", F.col("node").alias("via"), F.lit(0).cast("long").alias("steps")))
            sound = open_.select("node").distinct().join(rest.select("node").distinct(), "node", "left_anti")
            legs = stored(legs.unionByName(sound.select("node", F.col("node").alias("via"), F.lit(0).cast("long").alias("steps"))).distinct())
            leave = legs.join(open_.filter("done").select(F.col("node").alias("via"), "above"), "via")
            depth = leave.join(_union(known).select(F.col("node").alias("above"), "level"), "above").groupBy("node").agg(F.max(F.col("steps") + 1 + F.col("level")).alias("level"))
            older = _union(paths).select(F.col("node").alias("above"), F.col("above").alias("far"))
            out = stored(leave.select("node", "above"))
            far = out.join(older, "above").select("node", F.col("far").alias("above"))
            known.append(stored(depth))
            paths.append(stored(deep.select("node", "above").unionByName(out).unionByName(far).distinct()))
            return _union(known), paths, open_.join(known[-1].select("node"), "node", "left_anti")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def levels(nodes: DataFrame, id_: str, edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, level, above, fault): how far up the longest path goes and how many
    nodes stand above; null for nodes on a circle ("cycle") or below one ("below
    a cycle")."""
    given = stored(edges.select(F.col(child).alias("node"), F.col(parent).alias("above")).filter("node is not null and above is not null").distinct())
    own = nodes.select(F.col(id_).alias("key")).distinct()
    keys = _numbered(own.unionByName(given.select(F.col("node").alias("key"))).unionByName(given.select(F.col("above").alias("key"))).distinct())
    e = stored(given.join(keys.select(F.col("key").alias("node"), F.col("n").alias("_c")), "node").join(keys.select(F.col("key").alias("above"), F.col("n").alias("_p")), "above").select(F.col("_c").alias("node"), F.col("_p").alias("above")))
    # nodes with nothing below them are nobody's ancestors: they come last, all at once
    has = e.select(F.col("above").alias("node")).distinct()
    inner, last = stored(e.join(has, "node", "left_semi").select("node", "above")), stored(e.join(has, "node", "left_anti").select("node", "above"))
    placed, paths, stuck = _placed(inner)
    circle = on_circles(stuck.select("node", "above"))
    faulty = stored(stuck.select("node").distinct())
    top = last.join(placed.select(F.col("node").alias("above"), "level"), "above", "left").groupBy("node").agg(F.when(F.count("level") == F.count(F.lit(1)), F.max("level") + 1).alias("level"))
    top = stored(top)
    up = top.filter("level is not null").select("node", "level").unionByName(placed)
    whole = last.join(top.filter("level is not null").select("node"), "node", "left_semi")
    far = whole
    counts = []
    if paths:
        far = whole.unionByName(whole.join(_union(paths).select(F.col("node").alias("above"), F.col("above").alias("far")), "above").select("node", F.col("far").alias("above")))
        counts = [p.groupBy("node").agg(F.count(F.lit(1)).alias("above")) for p in paths]
    above = _union([far.distinct().groupBy("node").agg(F.count(F.lit(1)).alias("above")), *counts])
    bad = faulty.unionByName(top.filter("level is null").select("node")).join(circle.withColumn("_on", F.lit(True)), "node", "left").select("node", F.coalesce("_on", F.lit(False)).alias("on_cycle"))
    found = own.join(keys, "key").withColumnRenamed("n", "node").join(up, "node", "left").join(above, "node", "left").join(bad, "node", "left")
    fault = F.when(F.col("on_cycle"), "cycle").when(~F.col("on_cycle"), "below a cycle")
    zero = F.lit(0).cast("long")
    return found.select(F.col("key").alias("node"), *[F.when(F.col("on_cycle").isNull(), F.coalesce(c, zero)).alias(c) for c in ("level", "above")], fault.alias("fault"))


def _digest(payload, parts) -> F.Column:
    """SHA-256 of a payload and, a line below, its references' digests in order."""
    return F.sha2(F.concat(payload, F.lit("\n"), F.array_join(parts, ",")).cast("binary"), 256)


def _packed(text) -> F.Column:
    """Text as bytes; hex digits, which digests are, in half as many."""
    return F.when(text.rlike(r"\A([0-9a-f]{2})+\z"), F.concat(F.lit(b"\x01"), F.unhex(text))).otherwise(F.concat(F.lit(b"\x00"), text.cast("binary")))


def _unpacked(bytes_) -> F.Column:
    rest = F.substring(bytes_, 2, (1 << 31) - 1)
    return F.when(F.hex(F.substring(bytes_, 1, 1)) == "01", F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def _in_order(parts, name: str) -> F.Column:
    """The digests of references by name, null if one of them has none."""
    named = F.transform(parts, lambda x: F.struct(x["ref"].alias("ref"), _unpacked(x[name]).alias("d")))
    return F.when(~F.exists(parts, lambda x: x[name].isNull()), F.transform(F.array_sort(named), lambda x: x["d"]))


def _bytes(payload, parts) -> F.Column:
    """A digest, packed."""
    return F.concat(F.lit(b"\x01"), F.unhex(_digest(payload, parts)))


def _settled(own, parts) -> F.Column:
    """Artifacts of one id with their digests along the references, and whether they
    state that or what their references state (``fine``)."""
    named = F.transform(own, lambda x: F.struct(x["payload"].alias("payload"), x["stated"].alias("stated"), x["fine"].alias("fine"), _bytes(x["payload"], parts).alias("digest")))
    return F.transform(named, lambda x: F.struct(x["payload"].alias("payload"), x["stated"].alias("stated"), (x["fine"] | F.coalesce(x["stated"] == x["digest"], F.lit(False))).alias("fine"), x["digest"].alias("digest")))


def _along(artifacts: DataFrame, refs: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Artifacts (id, payload, stated) along refs (id, ref): for each level a stored
    frame (id, level, missing, own), own with the artifacts and digests of an id, and
    one of those that no digest reaches, with the references (parts) that lack one.

    A first pass looks up each reference once: what it states, whether it is there,
    and its digest if it refers to nothing. Then a round a level moves only ids that
    still wait, with the references that aren't known yet."""
    kind = refs.schema["ref"].dataType
    both = artifacts.filter("id is not null").select("id", F.struct(F.coalesce("payload", F.lit("")).alias("payload"), _packed(F.col("stated")).alias("stated")).alias("a"), F.lit(None).cast(T.StructType().add("ref", kind)).alias("r"))
    both = both.unionByName(refs.filter("id is not null").select("id", F.lit(None).cast(both.schema["a"].dataType).alias("a"), F.struct("ref").alias("r")))
    nodes = stored(both.groupBy("id").agg(F.collect_list("a").alias("own"), F.collect_set("r").alias("refs")))
    bare = F.transform("own", lambda x: F.struct(x["payload"].alias("payload"), x["stated"].alias("stated"), F.lit(False).alias("fine")))
    leaves = nodes.filter("size(refs) = 0").select("id", F.lit(0).cast("long").alias("level"), F.lit(False).alias("missing"), _settled(bare, F.array().cast("array<string>")).alias("own"))
    known = leaves.select(F.col("id").alias("ref"), F.explode("own").alias("x")).select("ref", F.col("x.stated").alias("stated"), F.col("x.digest").alias("digest"))
    later = nodes.filter("size(refs) > 0")
    there = known.unionByName(later.select(F.col("id").alias("ref"), F.explode("own").alias("x")).select("ref", F.col("x.stated").alias("stated"), F.lit(None).cast("binary").alias("digest"))).withColumn("there", F.lit(True))
    met = later.select("id", F.explode("refs.ref").alias("ref")).join(there, "ref", "left").select("id", F.struct("ref", "stated", "digest", F.col("there").isNull().alias("missing")).alias("part"))
    rows = met.withColumn("own", F.lit(None).cast(later.schema["own"].dataType)).unionByName(later.select("id", F.lit(None).cast(met.schema["part"].dataType).alias("part"), "own"))
    one = rows.groupBy("id").agg(F.flatten(F.collect_list("own")).alias("own"), F.collect_list("part").alias("parts"))
    local = lambda x: F.coalesce(x["stated"] == _bytes(x["payload"], _in_order(F.col("parts"), "stated")), F.lit(False))
    one = one.select("id", F.exists("parts", lambda x: x["missing"]).alias("missing"), F.transform("own", lambda x: F.struct(x["payload"].alias("payload"), x["stated"].alias("stated"), local(x).alias("fine"))).alias("own"), F.transform("parts", lambda x: F.struct(x["ref"].alias("ref"), x["digest"].alias("digest"))).alias("parts"))
    levels_, frames, held = [leaves], [nodes], None
    while True:
        done = ~F.exists("parts", lambda x: x["digest"].isNull())
        state = stored(one.select("id", "missing", F.when(done, _settled(F.col("own"), _in_order(F.col("parts"), "digest"))).alias("own"), F.when(~done, F.col("own")).alias("waits"), F.when(~done, F.col("parts")).alias("parts")))
        if held is not None:
            discard(held)
        waiting = state.filter("own is null").select("id", "missing", F.col("waits").alias("own"), "parts")
        ready = state.filter("own is not null").select("id", "missing", "own")
        if ready.isEmpty():
            for df in levels_[:1]:
                df._frames = [*frames, state]
            return levels_, waiting
        front = stored(ready.select("id", F.lit(len(levels_)).cast("long").alias("level"), "missing", "own"))
        levels_.append(front)
        frames.append(front)
        new = front.select(F.col("id").alias("ref"), F.explode("own.digest").alias("digest"))
        lacks = waiting.select("id", F.explode(F.filter("parts", lambda x: x["digest"].isNull())).alias("x")).select("id", "x.ref").join(new, "ref", "left").select("id", F.struct("ref", "digest").alias("part"))
        have = waiting.select("id", "missing", "own", F.filter("parts", lambda x: x["digest"].isNotNull()).alias("parts"))
        rows = lacks.select("id", F.lit(None).cast("boolean").alias("missing"), F.lit(None).cast(have.schema["own"].dataType).alias("own"), F.array("part").alias("parts")).unionByName(have)
        one = rows.groupBy("id").agg(F.max("missing").alias("missing"), F.flatten(F.collect_list("own")).alias("own"), F.flatten(F.collect_list("parts")).alias("parts"))
        held = state


def sealed(artifacts: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, payload, level, digest) of artifacts (id, payload) along refs (id, ref):
    those without references first, then whatever refers to known ones only.
    Artifacts that refer to missing ones or in circles never get a digest."""
    found, _ = _along(artifacts.select("id", "payload", F.lit(None).cast("string").alias("stated")), refs)
    out = _union([df.select("id", "level", F.explode("own").alias("x")) for df in found])
    out = stored(out.select("id", "x.payload", "level", _unpacked(F.col("x.digest")).alias("digest")))
    discard(*found[0]._frames)
    return out


def replayed(artifacts: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, level, digest, fault) of artifacts (id, payload, stated): the digest
    as replayed along the references, and what is wrong with the artifact itself:
    "missing reference", "cycle", "stated digest", or "below a fault" where an
    artifact can't be replayed for another's fault.

    A stated digest is right if it follows from the references' replayed digests
    or from those they state. So a fault is named once, where it is, not at all
    artifacts that build on it; but where a reference both states a wrong digest and
    stands above a changed payload, the artifact can't be told from a wrong one."""
    found, stuck = _along(artifacts.select("id", "payload", "stated"), refs)
    sound = _union([df.select("id", "level", F.explode("own").alias("x")) for df in found])
    sound = sound.select("id", "level", _unpacked(F.col("x.digest")).alias("digest"), F.when(~F.col("x.fine"), "stated digest").alias("fault"))
    # what no digest reached refers to a missing one or to a circle
    circles = on_circles(stuck.select(F.col("id").alias("node"), F.explode(F.filter("parts", lambda x: x["digest"].isNull())).alias("x")).select("node", F.col("x.ref").alias("above")))
    fault = F.when(F.col("missing"), "missing reference").when(F.col("_on"), "cycle").otherwise("below a fault")
    none = [F.lit(None).cast("long").alias("level"), F.lit(None).cast("string").alias("digest")]
    bad = stuck.select("id", "missing", F.explode("own")).join(circles.select(F.col("node").alias("id"), F.lit(True).alias("_on")), "id", "left").select("id", *none, fault.alias("fault"))
    return _union([sound, bad, artifacts.filter("id is null").select("id", *none, F.lit("below a fault").alias("fault"))])


def attribute(tag: str) -> F.Column:
    """The values of a tag of a record's ``attributes``, none if it isn't there."""
    found = F.transform(F.filter("attributes", lambda a: a["tag"] == tag), lambda a: a["values"])
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.array().cast("array<string>"))


def compiled_graph(records: DataFrame, relations: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Records (type, attributes) as a graph. Units: (id, kind, unit, level, above,
    fault), one for each ID, whatever lines it has; numbers are dense and a unit's
    are larger than those of all it stands below. Edges: (child, parent, relation)
    by unit, a row for each of ``relations`` (names by attribute) that is given.

    Faults: "cycle", "below a cycle", "missing parent" and "several kinds" (lines of
    one ID that differ in type). Units with a fault have no number, and their edges
    are left out. Records without an ID are no units but may not refer to any."""
    r = records.select(F.try_element_at(attribute("ID"), F.lit(1)).alias("id"), F.col("type").alias("kind"), *[attribute(a).alias(f"_{a}") for a in relations])
    given = F.array(*[F.struct(F.lit(name).alias("relation"), F.col(f"_{a}").alias("ids")) for a, name in relations.items()])
    links = checkpointed(r.filter("id is not null").select("id", F.explode(given).alias("g")).select("id", "g.relation", F.explode("g.ids").alias("other")).distinct())
    nodes = checkpointed(r.filter("id is not null").groupBy("id").agg(F.min("kind").alias("kind"), F.count_distinct("kind").alias("kinds")))
    missing = links.join(nodes.select(F.col("id").alias("other")), "other", "left_anti").select("id").distinct().withColumn("_missing", F.lit(True))
    known = links.join(nodes.select(F.col("id").alias("other")), "other", "left_semi")
    placed = levels(nodes, "id", known, "id", "other").withColumnRenamed("node", "id")
    fault = F.coalesce("fault", F.when(F.col("_missing"), "missing parent"), F.when(F.col("kinds") > 1, "several kinds"))
    all_ = checkpointed(nodes.join(placed, "id").join(missing, "id", "left").select("id", "kind", "level", "above", fault.alias("fault")))
    sound = running_total(all_.filter("fault is null").select("id", "level", F.lit(1).cast("long").alias("n")), ["level", "id"], "n", "to")
    number = checkpointed(sound.select("id", (F.col("to") - 1).alias("unit")))
    units = all_.join(number, "id", "left").select("id", "kind", "unit", "level", "above", "fault")
    edges = known.join(number.withColumnRenamed("unit", "child"), "id").join(number.select(F.col("id").alias("other"), F.col("unit").alias("parent")), "other")
    return units, edges.select("child", "parent", "relation")
