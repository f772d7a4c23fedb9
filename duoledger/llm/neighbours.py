"""Embedding near-duplicates by NN-descent: a neighbour graph is refined until an audit of its links finds none missing; links are then counted within the groups that it connects."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, looked_up, read, small, stored

#: Neighbours of a node at first; tables of random hyperplanes that seed the graph at first; rows of a seeding bucket, about.
NEIGHBOURS, TABLES, BUCKET = 10, 6, 8
#: Gain in the sum of similarities below which a round of descent is the last.
GAIN = 0.002
#: Rows of a label, about, whose links an audit looks for among all rows of the label (all of a label of no more).
AUDIT = 2048
#: Turns of seeding, descent and audit after which a label that stays below the target is an error.
TURNS = 8
#: Rows of a block of an audit or a group; rows that are compared with a block at once; shells of angles to a quarter of the threshold's angle.
BLOCK, AT_ONCE, SHELLS = 4096, 256, 8


def units(blobs: pd.Series) -> np.ndarray:
    """Vectors of equal length, scaled to length 1, in double precision."""
    v = np.frombuffer(b"".join(blobs), np.float32).reshape(len(blobs), -1).astype(np.float64)
    return v / np.sqrt((v * v).sum(1))[:, None]


def _classes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Valid vectors as bytes."""
    for part in parts:
        rows = []
        for id_, v, label in zip(part["id"], part["vector"], part["label"], strict=True):
            if v is None or label is None or pd.isna(label) or not len(v):
                continue
            v = np.array([np.nan if x is None else x for x in v], np.float32)
            d = v.astype(np.float64)
            if np.isfinite(d).all() and d.any():
                rows.append((id_, str(label), v.tobytes()))
        yield pd.DataFrame(rows, columns=["id", "label", "vec"])


def _bucketed(seed: int, tables: int):
    """Rows (bucket, place, id, vec): for each table, the side of each hyperplane, and a place along one more line."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for (label, size, bits), rows in part.assign(size=part["vec"].str.len()).groupby(["label", "size", "bits"], sort=False):
                v, out = units(rows["vec"]), []
                for table in range(tables):
                    planes = np.random.default_rng([seed, table, int(size)]).normal(size=(v.shape[1], int(bits) + 1))
                    side = v @ planes
                    key = np.array([f"{label}|{size}|{table}|{''.join('01'[x] for x in row)}" for row in (side[:, :-1] > 0).tolist()], object) if bits else np.full(len(rows), f"{label}|{size}|{table}|", object)
                    out.append(pd.DataFrame({"bucket": key, "place": side[:, -1], "id": rows["id"].to_numpy(), "vec": rows["vec"].to_numpy()}))
                yield pd.concat(out)

    return run


def _adjacent(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Similar pairs among rows that stand near each other in a sorted bucket."""
    reach, tail = BUCKET, None
    for part in parts:
        rows = part if tail is None else pd.concat([tail, part], ignore_index=True)
        tail = rows.iloc[-reach:]
        a, b, s = [], [], []
        bucket, ids = rows["bucket"].to_numpy(), rows["id"].to_numpy()
        for _, own in rows.assign(at=np.arange(len(rows)), size=rows["vec"].str.len()).groupby("size", sort=False):
            at, v = own["at"].to_numpy(), units(own["vec"])
            for k in range(1, reach + 1):
                i = np.arange(len(at) - k)
                i = i[bucket[at[i]] == bucket[at[i + k]]]
                a.append(ids[at[i]])
                b.append(ids[at[i + k]])
                s.append(np.einsum("ij,ij->i", v[i], v[i + k]))
        yield pd.DataFrame({"u": np.concatenate(a), "v": np.concatenate(b), "sim": np.concatenate(s)}) if a else pd.DataFrame({"u": [], "v": [], "sim": []})


def _local_join(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the neighbours of each node w, all pairs that improve the list of one of them."""

    def done(rows: pd.DataFrame) -> pd.DataFrame:
        w, ids, least = rows["w"].to_numpy(), rows["x"].to_numpy(), rows["least"].to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, int)
        a, b, s = [ids[:0]], [ids[:0]], [np.zeros(0)]
        if len(w):
            v = units(rows["vec"])
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(w)], strict=True):
                sim = v[i:j] @ v[i:j].T
                x, y = np.nonzero(sim > least[i:j, None])
                keep = ids[i + x] != ids[i + y]
                a.append(ids[i + x[keep]])
                b.append(ids[i + y[keep]])
                s.append(sim[x[keep], y[keep]])
        found = pd.DataFrame({"u": np.concatenate(a), "v": np.concatenate(b), "sim": np.concatenate(s)})
        return found.drop_duplicates(["u", "v"])

    held = None
    for part in parts:
        rows = part if held is None else pd.concat([held, part], ignore_index=True)
        last = (rows["w"] == rows["w"].iloc[-1]).to_numpy() if len(rows) else np.zeros(0, bool)
        held = rows[last]
        if not last.all():
            yield done(rows[~last])
    if held is not None and len(held):
        yield done(held)


def _top(edges: DataFrame, key: str, other: str, most) -> DataFrame:
    """The nearest of each key; Spark limits each group before the shuffle too."""
    order = Window.partitionBy(key).orderBy(F.desc("sim"), other)
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _lists(edges: DataFrame, threshold: float, most: int) -> DataFrame:
    """Neighbour lists from edges (u, v, sim) of both directions: `most` each, and eight times that for a list that is full of links."""
    ranked = _top(edges.groupBy("u", "v").agg(F.max("sim").alias("sim")), "u", "v", 8 * most)
    full = F.max(F.when(F.col("rank") == most, F.col("sim"))).over(Window.partitionBy("u")) >= threshold
    return ranked.withColumn("full", F.coalesce(full, F.lit(False))).where((F.col("rank") <= most) | F.col("full")).select("u", "v", "sim")


def descend(nodes: DataFrame, graph: DataFrame, threshold: float, most: int) -> DataFrame:
    """Neighbours of neighbours are joined until lists hardly change."""
    total = graph.agg(F.sum("sim")).first()[0] or 0.0
    while True:
        least = graph.groupBy("u").agg(F.when(F.count("*") >= most, F.min("sim")).otherwise(F.lit(-2.0)).alias("least"))
        near = graph.select(F.col("u").alias("w"), F.col("v").alias("x"), "sim").unionByName(graph.select(F.col("v").alias("w"), F.col("u").alias("x"), "sim")).distinct()
        near = _top(near, "w", "x", 2 * most).select("w", "x")
        rows = near.join(nodes.select(F.col("id").alias("x"), "vec"), "x").join(least.withColumnRenamed("u", "x"), "x")
        found = rows.repartition("w").sortWithinPartitions("w").mapInPandas(_local_join, "u long, v long, sim double")
        graph = stored(_lists(graph.unionByName(found), threshold, most), "graph")
        now = graph.agg(F.sum("sim")).first()[0] or 0.0
        if now - total <= GAIN * abs(total):
            return graph
        total = now


def seeds(nodes: DataFrame, sizes: DataFrame, turn: int, tables: int) -> DataFrame:
    """Edges (u, v, sim) of both directions between rows that stand near each other in a bucket of random hyperplanes."""
    rows = nodes.join(sizes, "label").select("id", "label", "vec", "bits").mapInPandas(_bucketed(turn, tables), "bucket string, place double, id long, vec binary")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "place", "id").mapInPandas(_adjacent, "u long, v long, sim double").where("u <> v")
    return rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"))


def _runs(parts: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key, of rows sorted by it."""
    held: list[pd.DataFrame] = []
    for part in parts:
        if not len(part):
            continue
        cuts = np.flatnonzero((part[key] != part[key].shift()).any(axis=1).to_numpy())
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
            piece = part.iloc[i:j]
            if held and (held[-1][key].iloc[-1] != piece[key].iloc[0]).any():
                yield pd.concat(held)
                held = []
            held.append(piece)
    if held:
        yield pd.concat(held)


def _audited(threshold: float):
    """(label, linked, missed): the links of the asked rows of a block, and how many of them the groups don't know."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _runs(parts, ["label", "block"]):
            linked = missed = 0
            for _, own in rows.assign(size=rows["vec"].str.len()).groupby("size", sort=False):
                asked, others = own[own["asked"]], own[~own["asked"]]
                if not len(asked) or not len(others):
                    continue
                v, ids, group = units(others["vec"]), others["id"].to_numpy(), others["grp"].to_numpy()
                for i in range(0, len(asked), AT_ONCE):
                    some = asked.iloc[i : i + AT_ONCE]
                    near = (units(some["vec"]) @ v.T >= threshold) & (some["id"].to_numpy()[:, None] != ids)
                    linked += int(near.sum())
                    missed += int((near & (some["grp"].to_numpy()[:, None] != group)).sum())
            yield pd.DataFrame({"label": [rows["label"].iloc[0]], "linked": [linked], "missed": [missed]})

    return run


def audit(nodes: DataFrame, sizes: DataFrame, groups: DataFrame, threshold: float, turn: int) -> DataFrame:
    """(label, recall): of the links of about AUDIT rows of each label, drawn anew each turn, with all rows of the label, the share whose ends the groups (id, grp) connect.

    The rows asked are a stated query set: each is copied to the blocks of its label, and
    nothing found here enters the graph.
    """
    rows = nodes.join(small(groups, 1_000_000), "id", "left").withColumn("grp", F.coalesce("grp", "id")).join(sizes, "label").select("label", "id", "vec", "grp", "rows", "blocks")
    asked = rows.where(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << 30)) < F.lit(AUDIT << 30) / F.col("rows")).withColumn("asked", F.lit(True)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("asked", F.lit(False)).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    both = rows.unionByName(asked).select("label", "block", "id", "vec", "grp", "asked").repartition("label", "block").sortWithinPartitions("label", "block")
    return both.mapInPandas(_audited(threshold), "label string, linked long, missed long").groupBy("label").agg((1 - F.sum("missed") / F.greatest(F.sum("linked"), F.lit(1))).alias("recall"))


def _angles(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The angle of each row with its group's pivot."""
    for part in parts:
        angle = np.zeros(len(part))
        for _, at in part.assign(at=np.arange(len(part)), size=part["vec"].str.len()).groupby("size")["at"]:
            own = part.iloc[at.to_numpy()]
            angle[at.to_numpy()] = np.arccos(np.clip(np.einsum("ij,ij->i", units(own["vec"]), units(own["pivot"])), -1, 1))
        yield pd.DataFrame({"grp": part["grp"], "id": part["id"], "m": part["m"], "vec": part["vec"], "angle": angle})


def _counted(threshold: float):
    """(id, n): the rows of the other block (or of the same) that each row is linked with."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _runs(parts, ["grp", "s0", "b0", "s1", "b1"]):
            first = rows.iloc[0]
            inside = first["s0"] == first["s1"] and first["b0"] == first["b1"]
            low = ((rows["shell"] == first["s0"]) & (rows["block"] == first["b0"])).to_numpy()
            a, b = (rows, rows) if inside else (rows[low], rows[~low])
            if not len(a) or not len(b):
                continue
            u, v, n = units(a["vec"]), units(b["vec"]), np.zeros(len(b), np.int64)
            for i in range(0, len(a), AT_ONCE):
                linked = u[i : i + AT_ONCE] @ v.T >= threshold
                if inside:
                    linked[np.arange(len(linked)), np.arange(i, i + len(linked))] = False
                yield pd.DataFrame({"id": a["id"].to_numpy()[i : i + AT_ONCE], "n": linked @ b["m"].to_numpy()})
                n += a["m"].to_numpy()[i : i + AT_ONCE] @ linked
            if not inside:
                yield pd.DataFrame({"id": b["id"].to_numpy(), "n": n})

    return run


def link_counts(nodes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(id, n): how many vectors (m of each node) each node of a group is linked with, exactly; links never leave a group.

    Groups of up to BLOCK nodes are compared outright. In a larger one, nodes have an angle
    to the group's pivot and stand in shells of it: by the triangle inequality, shells
    whose angles add up to less than the threshold's are linked throughout, which is
    counted without a comparison, and shells farther apart than it are not linked at all. Only
    the pairs of shells between are compared, in blocks.
    """
    own = nodes.join(small(groups, 1_000_000), "id").select("grp", "id", "m", "vec")
    size = stored(own.groupBy("grp").agg(F.count("*").alias("copies"), F.min_by("vec", "id").alias("pivot")), "group_sizes")
    little = size.where(F.col("copies") <= BLOCK).select("grp")
    zero = {c: F.lit(0) for c in ("s0", "b0", "s1", "b1", "shell", "block")}
    rows = own.join(small(little, 1_000_000), "grp", "left_semi").withColumns(zero)
    large = size.where(F.col("copies") > BLOCK)  # fewer than nodes / BLOCK
    sure = None
    if large.limit(1).count():
        width = math.acos(threshold) / SHELLS
        placed = stored(own.join(small(large.select("grp", "pivot"), 100_000), "grp").mapInPandas(_angles, "grp long, id long, m long, vec binary, angle double").withColumn("shell", F.floor(F.col("angle") / width).cast("int")), "shells")
        shells = stored(placed.groupBy("grp", "shell").agg(F.count("*").alias("rows"), F.sum("m").alias("weight")).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int")), "shell_sizes")
        one, other = (shells.select("grp", *[F.col(c).alias(f"{c}{k}") for c in ("shell", "weight", "blocks")]) for k in (0, 1))
        met = one.join(other, "grp").where(F.abs(F.col("shell0") - F.col("shell1")) <= SHELLS + 1)  # shells of one group: as many as angles, not rows
        linked = F.col("shell0") + F.col("shell1") + 2 < SHELLS  # a shell's width to spare for rounding
        sure = placed.join(small(stored(met.where(linked).groupBy("grp", F.col("shell0").alias("shell")).agg(F.sum("weight1").alias("n")), "sure"), 1_000_000), ["grp", "shell"]).select("id", (F.col("n") - F.when(2 * F.col("shell") + 2 < SHELLS, F.col("m")).otherwise(0)).alias("n"))
        open_ = small(stored(met.where(~linked).select("grp", F.col("shell0").alias("shell"), F.col("shell1").alias("other"), F.col("blocks0").alias("own_blocks"), F.col("blocks1").alias("other_blocks")), "open"), 1_000_000)
        apart = placed.join(open_, ["grp", "shell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("own_blocks")).cast("int")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
        mine, theirs = F.struct("shell", "block"), F.struct(F.col("other").alias("shell"), F.col("at").alias("block"))
        apart = apart.withColumns({"low": F.least(mine, theirs), "high": F.greatest(mine, theirs)})
        rows = rows.unionByName(apart.select("grp", "id", "m", "vec", F.col("low.shell").alias("s0"), F.col("low.block").alias("b0"), F.col("high.shell").alias("s1"), F.col("high.block").alias("b1"), "shell", "block"))
    key = ["grp", "s0", "b0", "s1", "b1"]
    counts = rows.repartition(*key).sortWithinPartitions(*key).mapInPandas(_counted(threshold), "id long, n long")
    return (counts if sure is None else counts.unionByName(sure)).groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(table: DataFrame, id_col: str, vector_col: str, label_col: str, threshold: float = 0.93, target: float = 1.0) -> DataFrame:
    """(id, n_links, component_id, kept, recall) of every row.

    Equal vectors of a label are one node. Random hyperplanes seed a neighbour graph within
    each label; rounds of descent join neighbours of neighbours; lists that are full of
    links grow eightfold. Edges at or above the threshold make groups. An audit then takes
    about AUDIT rows of each label (of a label of no more, all) and looks for their links
    among all rows of the label: recall is the share that groups connect. Labels below the target go on with
    twice the seeding tables and longer lists, and are audited with other rows, until
    none is left. Work grows with a label's rows, not their square. Links of each vector are
    then counted within its group; recall is that of the last audit of the row's label, null
    where the row has no valid vector.

    Rows whose vector is null, empty, zero, or holds null or non-finite numbers, and rows
    of a null label, link with nothing. Vectors of different lengths don't link. Rows of a null id are
    returned without links and component. Repeated rows are vectors of one id. Ids are whole numbers.
    An empty table gives no rows. Other columns are ignored.
    """
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    valid = rows.where("id is not null").mapInPandas(_classes, "id long, label string, vec binary").dropDuplicates(["id", "label"])
    valid = stored(valid.withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(7), "vec")}), "vectors")
    twice = small(stored(valid.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("twice")), "twice"), 1_000_000)
    valid = valid.join(twice, "id", "left")
    classes = valid.groupBy("label", "k1", "k2").agg(F.min(F.struct("id", "twice")).alias("first"), F.count("*").alias("m"))
    node = F.when(F.col("first.twice"), F.xxhash64("label", "first.id")).otherwise(F.col("first.id"))  # an id of two labels is two nodes
    classes = stored(classes.select("label", "k1", "k2", F.col("first.id").alias("rep"), node.alias("node"), "m"), "classes")
    nodes = stored(valid.join(small(classes, 1_000_000), ["label", "k1", "k2"]).where("id = rep").select(F.col("node").alias("id"), "label", "vec", "m", "rep"), "nodes")
    sizes = nodes.groupBy("label").agg(F.count("*").alias("rows"))
    sizes = stored(sizes.select("label", "rows", F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / BUCKET))).cast("int").alias("bits"), F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")), "sizes")

    links, graph, recalls = None, None, None
    turn, tables, most, left = 0, TABLES, NEIGHBOURS, sizes.where("rows > 1")
    while left.limit(1).count():
        own = small(left, 1_000_000)
        active = stored(nodes.join(own.select("label"), "label", "left_semi"), "active") if turn else nodes
        first = seeds(active, own, turn, tables)
        if graph is not None:
            first = first.unionByName(graph.join(active.select(F.col("id").alias("u")), "u", "left_semi"))
        graph = descend(active, stored(_lists(first, threshold, most), "graph"), threshold, most)
        new = graph.where(F.col("sim") >= threshold).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        links = stored((new if links is None else links.unionByName(new)).distinct(), "links")
        groups = stored(components(links), "groups").select(F.col("node").alias("id"), F.col("component").alias("grp"))
        found = stored(audit(active, own, groups, threshold, turn).withColumn("turn", F.lit(turn)), "recall")
        recalls = found if recalls is None else recalls.unionByName(found)
        left = stored(left.join(found.where(F.col("recall") < target).select("label"), "label", "left_semi"), "left")
        turn, tables, most = turn + 1, 2 * tables, 2 * most
        if turn == TURNS and left.limit(1).count():
            raise RuntimeError(f"after {TURNS} turns, links of {left.count()} labels are still missing")
    if links is None:
        links = nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")
        groups = nodes.select("id", F.col("id").alias("grp")).where("false")
        recalls = sizes.select("label", F.lit(1.0).alias("recall"), F.lit(0).alias("turn")).where("false")

    counts = stored(link_counts(nodes, groups, threshold), "counts").withColumnRenamed("id", "node")
    named = nodes.select("id", "rep").join(small(groups, 1_000_000), "id")
    named = named.join(small(stored(named.groupBy("grp").agg(F.min("rep").alias("component")), "components"), 1_000_000), "grp").select(F.col("id").alias("node"), "component")
    reps = valid.join(small(classes, 1_000_000), ["label", "k1", "k2"]).select("id", "label", "node", "rep", "m")
    last = sizes.join(recalls.groupBy("label").agg(F.max_by("recall", "turn").alias("recall")), "label", "left").select("label", F.coalesce("recall", F.lit(1.0)).alias("recall"), F.col("rows").alias("copies"))
    found = looked_up(reps, last, "label").join(small(counts, 1_000_000), "node", "left").join(small(stored(named, "named"), 1_000_000), "node", "left")
    found = found.groupBy("id").agg(F.sum(F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component_id"), F.min("recall").alias("recall"))
    out = rows.select("id").join(stored(found, "found"), "id", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), "recall")
    return out.select("id", "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), "recall")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").drop("recall").withColumnRenamed("id", "vec_id")
