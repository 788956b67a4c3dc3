"""Links inside buckets of candidates, and connected components.

Components come from alternating large-star and small-star steps (Kiveris et
al., 2014). Every step is a minimum per vertex, which is summed before the
shuffle and written, and a join of two stored tables, whose hot keys adaptive
skew joins can split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.llm._store import discard, materialise, passing_shuffles

#: Rounds in which one member of each bucket is compared with the others, at
#: most; they go on while buckets hold more than ``LARGE`` members on average
#: (weighted by their size).
STARS = 8
LARGE = 12


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The step's edges, and the table of minima that they are read from."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m")), "minima")
    return both.join(low, both["u"] == low["x"]).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), low


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = materialise(down.groupBy("u").agg(F.min("v").alias("m")), "minima")
    to_low = down.join(low.withColumnRenamed("u", "x"), F.col("u") == F.col("x")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_low.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), low


def components(edges: DataFrame) -> DataFrame:
    """``vertex, component`` for every vertex of ``edges(u, v)``, written; the
    component is named after its smallest vertex. Both columns have an ordered
    type."""
    with passing_shuffles(edges.sparkSession):
        return _components(edges)


def _components(edges: DataFrame) -> DataFrame:
    edges = materialise(edges.where("u <> v").distinct(), "edges")
    before = None
    while True:
        for step in (_large_star, _small_star):
            stepped, low = step(edges)
            stepped = materialise(stepped, "stars")
            discard(edges, low)
            edges = stepped
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    labels = materialise(edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots), "labels")
    discard(edges)
    return labels


def relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` after more links: components are joined, not found anew."""
    if labels is None:
        return components(links)
    for end in ("u", "v"):
        links = links.join(labels.select(F.col("vertex").alias(end), F.col("component").alias(f"l{end}")), end, "left")
    moved = components(links.select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v")))
    names = moved.select(F.col("vertex").alias("component"), F.col("component").alias("name"))
    known = labels.join(names, "component", "left").select("vertex", F.coalesce("name", "component").alias("component"))
    fresh = moved.join(labels.select("vertex"), "vertex", "left_anti")
    out = materialise(known.unionByName(fresh), "labels")
    discard(labels, moved)
    return out


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("cls"))
    held = rows.drop("label").join(labels.withColumnRenamed("vertex", "cls"), "cls", "left")
    return held.withColumn("label", F.coalesce("component", "cls")).drop("component")


def _ordered() -> list[Column]:
    """``u, v, nu, nv`` of members ``cls`` and ``o_cls``, the smaller first."""
    low = F.col("cls") < F.col("o_cls")
    return [F.least("cls", "o_cls").alias("u"), F.greatest("cls", "o_cls").alias("v"), F.when(low, F.col("n")).otherwise(F.col("o_n")).alias("nu"), F.when(low, F.col("o_n")).otherwise(F.col("n")).alias("nv")]


def linked(
    shared: DataFrame,
    similar: tuple[int, int],
    verify: Callable[[DataFrame], DataFrame],
    near: Callable[[str, str], Column] | None = None,
    sketch: Callable[[DataFrame], DataFrame] | None = None,
    close: Callable[[str, str], Column] | None = None,
    stars: int = STARS,
    large: int = LARGE,
) -> DataFrame | None:
    """``vertex, component`` of the members that verified links join, or None
    without any link. ``shared`` lists ``sig, cls, n, lead``: bucket, member,
    size, and who is compared with the others first (the smallest). ``near``
    is a test of two members by further columns of ``shared``, given their
    prefixes; ``sketch`` adds columns that ``close`` tests in the last round.
    Both may only refuse pairs without a link. ``stars`` and ``large`` bound
    the rounds of one member against the others. ``verify`` keeps the linked
    ones of ``u, v, nu, nv`` as ``u, v``.

    A bucket of m members that are all alike costs m pairs: in each of the
    first rounds one member is compared with the others and then leaves the
    bucket, and pairs inside a component are never looked at again. In the
    last round the members outside a bucket's largest component are compared
    with all of the bucket, so no link that joins components is left out. The
    tests run inside the joins: a pair that fails them is never written.
    """
    with passing_shuffles(shared.sparkSession):
        return _linked(shared, similar, verify, near, sketch, close, stars, large)


def _linked(
    shared: DataFrame,
    similar: tuple[int, int],
    verify: Callable[[DataFrame], DataFrame],
    near: Callable[[str, str], Column] | None,
    sketch: Callable[[DataFrame], DataFrame] | None,
    close: Callable[[str, str], Column] | None,
    stars: int,
    large: int,
) -> DataFrame | None:
    num, den = similar
    carried = [c for c in shared.columns if c not in ("sig", "cls", "n", "lead")]
    kept = ["sig", "cls", "n", "lead", *carried]
    fits = (den * F.least("n", "o_n") >= num * F.greatest("n", "o_n")) & (F.col("label") != F.col("o_label"))
    if near is not None:
        fits = fits & near("", "o_")
    tried: list[DataFrame] = []
    rows, held, labels = shared, None, None

    def settle(pairs: DataFrame) -> None:
        nonlocal labels
        if tried:
            before = tried[0]
            for more in tried[1:]:
                before = before.unionByName(more)
            pairs = pairs.join(before, ["u", "v"], "left_anti")
        pairs = materialise(pairs, "pairs")
        good = materialise(verify(pairs), "links")
        if not good.isEmpty():
            labels = relabelled(labels, good)
        discard(good)
        tried.append(pairs)

    for step in range(stars + 1):
        rows = _labelled(rows, labels)
        if step:
            rows = materialise(rows, "labelled")
            discard(held)
        order = F.struct(F.lit(0) if step else F.col("lead"), F.xxhash64("cls", F.lit(step)))
        centre = rows.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m"), F.min_by(F.struct("cls", "n", "label", *carried), order).alias("c")).where("low <> high")
        centre = materialise(centre.select("sig", "m", *[F.col(f"c.{c}").alias(f"o_{c}") for c in ("cls", "n", "label", *carried)]), "centres")
        size = centre.agg(F.sum("m").alias("rows"), F.sum(F.col("m").cast("double") * F.col("m")).alias("squares")).first()
        if not size.rows or step == stars or (step and size.squares <= large * size.rows):
            discard(centre)
            break
        held = materialise(rows.join(centre, "sig").where("cls <> o_cls").withColumn("fits", fits).select(*kept, "fits", *[F.when(F.col("fits"), F.col(c)).alias(c) for c in ("o_cls", "o_n")]), "open")
        discard(centre, rows if step else None)
        settle(held.where("fits").select(*_ordered()).distinct())
        rows = held.select(*kept)
    if size.rows:
        often = rows.groupBy("sig", "label").agg(F.count("*").alias("m"))
        major = materialise(often.groupBy("sig").agg(F.count("*").alias("labels"), F.max_by("label", "m").alias("major")).where("labels > 1").select("sig", "major"), "majors")
        rest = rows.join(major, "sig").withColumn("minor", F.col("label") != F.col("major")).drop("major", "lead")
        rest = materialise(sketch(rest) if sketch else rest, "rest")
        discard(major, rows if step else None)
        other = rest.select(*[F.col(c).alias(f"o_{c}") for c in rest.columns])
        test = fits & (close("", "o_") if close else F.lit(True)) & (~F.col("o_minor") | (F.col("cls") < F.col("o_cls")))
        settle(rest.where("minor").join(other, (F.col("sig") == F.col("o_sig")) & test).select(*_ordered()).distinct())
        discard(rest)
    elif step:
        discard(rows)
    discard(*tried)
    return labels
