"""Knowledge graph: edges, neighbours, resolving phrases, concept profiles.

Lookups are joins over many terms at once.  Both directions of an edge are a union of
two equi-joins (an OR condition would be a nested loop), and the top edges of a term are
cut before anything else joins to it, which bounds hub nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.functions.text import clean_words, lemma, let
from verdigris.functions.vectors import squash
from verdigris.functions.vocabulary import DEFAULT, Vocabulary
from verdigris.storage import cut


@dataclass(frozen=True)
class Relations:
    """Weights of positive relations, negative and definitional ones, and hub concepts."""

    weights: dict[str, float]
    negative: tuple[str, ...] = ()
    definitional: tuple[str, ...] = ()
    hubs: tuple[str, ...] = ()


def build_edges(raw: DataFrame) -> DataFrame:
    """One row per (rel, start, end) with the greatest weight and surface text."""
    return raw.groupBy("rel", "start", "end").agg(F.max("weight").alias("weight"), F.max("surface").alias("surface"))


@dataclass(frozen=True)
class StoredGraph:
    """The edges twice: bucketed by start and by end."""

    by_start: DataFrame
    by_end: DataFrame


def save_graph(edges: DataFrame, name: str, buckets: int = 256, folder: str | None = None) -> None:
    """Two bucketed tables, by start and by end, so lookups of either side need no shuffle
    of the graph, and a table of counts by relation; in `folder`, or else the warehouse."""

    def save(writer: DataFrameWriter, table: str) -> None:
        (writer.option("path", f"{folder}/{table}") if folder else writer).mode("overwrite").saveAsTable(table)

    save(edges.write.bucketBy(buckets, "start").sortBy("start"), f"{name}_by_start")
    made = edges.sparkSession.table(f"{name}_by_start")  # the edges are made once
    save(made.write.bucketBy(buckets, "end").sortBy("end"), f"{name}_by_end")
    save(made.groupBy("rel").agg(F.count("*").alias("edges")).write, f"{name}_meta")


def is_stored(spark: SparkSession, name: str) -> bool:
    return all(spark.catalog.tableExists(f"{name}_by_{side}") for side in ("start", "end"))


def load_graph(spark: SparkSession, name: str) -> StoredGraph:
    """The tables of `save_graph`; FileNotFoundError if they are not there."""
    if not is_stored(spark, name):
        raise FileNotFoundError(f"no graph {name}: build it from a dump and write it with save_graph(build_edges(read_dump(...)), {name!r})")
    return StoredGraph(spark.table(f"{name}_by_start"), spark.table(f"{name}_by_end"))


def touching(edges: DataFrame | StoredGraph, terms: DataFrame | None = None) -> DataFrame:
    """Edges from the view of each end: term, other, and the edge itself.

    `terms` (term) keeps those of some terms.  A self-loop appears once per direction.
    Of a stored graph each direction is looked up in the table that is bucketed by it.
    """
    columns = ["rel", "start", "end", "weight", "surface"]
    if isinstance(edges, StoredGraph):
        out = edges.by_start.select(F.col("start").alias("term"), F.col("end").alias("other"), *columns)
        back = edges.by_end.select(F.col("end").alias("term"), F.col("start").alias("other"), *columns)
        if terms is not None:
            out, back = out.join(terms, "term"), back.join(terms, "term")
        return out.unionAll(back)
    # Edges that are still to be made are made once for both directions.
    ends = F.array(F.struct(F.col("start").alias("term"), F.col("end").alias("other")), F.struct(F.col("end").alias("term"), F.col("start").alias("other")))
    both = edges.select(F.explode(ends).alias("__e"), *columns).select("__e.*", *columns)
    return both if terms is None else both.join(terms, "term")


def neighbours(edges: DataFrame | StoredGraph, terms: DataFrame | None = None, limit: int = 400) -> DataFrame:
    """The `limit` heaviest edges of each term, then without self-loops, with their rank.

    Ties go by relation, start and end.
    """
    order = Window.partitionBy("term").orderBy(F.col("weight").desc(), "rel", "start", "end")
    stored = isinstance(edges, StoredGraph)
    ranked = touching(edges, terms if stored else None).withColumn("edge_rank", F.row_number().over(order))
    near = ranked.where((F.col("edge_rank") <= limit) & (F.col("start") != F.col("end")))
    # Ranked first, each task sends `limit` edges of a hub at most, and terms meet rows that
    # are dealt by term already.
    return near if stored or terms is None else near.join(terms.hint("merge"), "term")


def candidates(phrases: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """(phrase, candidate, place): the graph names that a phrase may have, best first.

    The phrase itself, its base forms, base forms but for the last word, the last two
    base forms, the last one.
    """
    words = clean_words(F.col("phrase"), vocabulary)

    def names(w):
        base = F.transform(w, lambda x: lemma(x, vocabulary))
        n = F.size(w)
        head = F.concat(F.slice(base, 1, F.greatest(n - 1, F.lit(1))), F.slice(w, -1, 1))
        several = F.array(F.array_join(head, "_"), F.array_join(F.slice(base, -2, 2), "_"), F.element_at(base, -1))
        whole = F.array(F.array_join(w, "_"), F.array_join(base, "_"))
        return F.array_distinct(F.when(n > 1, F.concat(whole, several)).when(n == 1, whole).otherwise(F.array().cast("array<string>")))

    listed = phrases.select("phrase").distinct().withColumn("names", let(words, names))
    return listed.select("phrase", F.posexplode_outer("names").alias("place", "candidate"))


def resolve(phrases: DataFrame, edges: DataFrame | StoredGraph, limit: int = 400, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """(phrase, concept, found, backed_off): the first candidate with an edge to another
    node among its `limit` heaviest ones.

    Without one, the first candidate and found = false; a phrase that cleans to nothing
    has a null concept.  backed_off: the concept has fewer words than the phrase.
    """
    named = cut(candidates(phrases, vocabulary))
    wanted = named.select(F.col("candidate").alias("term")).where("term is not null").distinct()
    # Whether its heaviest edge to another node is among the first is a matter of the
    # self-loops before it: fewer than `limit` cannot hide it, and no edges are sorted.
    loop = F.col("start") == F.col("end")
    every = touching(edges, wanted if isinstance(edges, StoredGraph) else None)
    met = every.groupBy("term").agg(F.max(~loop).alias("linked"), F.count_if(loop).alias("loops"))
    met = cut(met.join(wanted.hint("merge"), "term").where("linked"))
    known = met.where(F.col("loops") < limit).select(F.col("term").alias("candidate"))
    crowded = met.where(F.col("loops") >= limit).select("term")
    if not crowded.isEmpty():
        place = F.struct((-F.col("weight")).alias("minus"), "rel", "start", "end")
        sorted_out = touching(edges, crowded).groupBy("term").agg(F.min(F.when(~loop, place)).alias("best"), F.collect_list(F.when(loop, place)).alias("looped"))
        before = F.size(F.filter("looped", lambda x: x < F.col("best")))
        known = known.unionByName(sorted_out.where(before < limit).select(F.col("term").alias("candidate")))
    known = known.withColumn("known", F.lit(True))
    tried = named.join(known.hint("merge"), "candidate", "left")
    best = tried.groupBy("phrase").agg(
        F.min_by("candidate", F.when(F.col("known"), F.col("place"))).alias("hit"), F.min_by("candidate", "place").alias("first")
    )
    n_words = F.size(clean_words(F.col("phrase"), vocabulary))
    found = F.col("hit").isNotNull()
    return best.select(
        "phrase",
        F.coalesce("hit", "first").alias("concept"),
        found.alias("found"),
        (found & (F.size(F.split("hit", "_")) < n_words)).alias("backed_off"),
    )


def _weight_of(relations: Relations) -> Column:
    """The weight of an edge's relation; null for others.  The relations are configuration: a
    few dozen of them."""
    table = F.create_map(*[F.lit(x) for pair in sorted(relations.weights.items()) for x in pair])
    return F.try_element_at(table, F.col("rel")) if relations.weights else F.lit(None).cast("double")


def links(near: DataFrame, relations: Relations, min_weight: float = 1.0) -> DataFrame:
    """(term, other, strength, edge, negative): `profile`'s rows and those of `negatives`, which
    have no strength, in one table; rows that are dealt by term stay where they are."""
    weighed = near.withColumn("rel_weight", _weight_of(relations)).withColumn("first", F.min("edge_rank").over(Window.partitionBy("term")))
    kept = F.col("rel_weight").isNotNull() & (F.col("weight") >= min_weight) & (F.col("term") != F.col("other"))
    if relations.hubs:
        kept &= ~F.col("other").isin(*relations.hubs)
    negative = F.col("rel").isin(*relations.negative) if relations.negative else F.lit(False)
    edge = F.struct("rel", "start", "end", "weight", "surface")
    none = F.lit(None).cast("struct<rel:string,start:string,end:string,weight:double,surface:string>")
    row = lambda other, strength, edge, negative: F.struct(other.alias("other"), strength.cast("double").alias("strength"), edge.alias("edge"), F.col("edge_rank"), negative.alias("negative"))
    own = F.when(F.col("edge_rank") == F.col("first"), row(F.col("term"), F.lit(1.0), none, F.lit(False)))
    strong = F.when(kept & ~negative, row(F.col("other"), F.col("rel_weight") * squash(F.col("weight")), edge, F.lit(False)))
    against = F.when(negative, row(F.col("other"), F.lit(None), none, F.lit(True)))
    each = weighed.select("term", F.explode(F.filter(F.array(own, strong, against), lambda x: x.isNotNull())).alias("l")).select("term", "l.*")
    best = F.max_by(F.struct("strength", "edge"), F.when(F.col("strength").isNotNull(), F.struct("strength", -F.col("edge_rank"))))
    return each.groupBy("term", "other").agg(best.alias("b"), F.max("negative").alias("negative")).select("term", "other", "b.strength", "b.edge", "negative")


def profile(near: DataFrame, relations: Relations, min_weight: float = 1.0) -> DataFrame:
    """(term, other, strength, and the strongest edge) of `neighbours`' rows.

    Strength is the relation's weight times squash(edge weight); the best edge of each
    neighbour stays, the heavier one of equals.  Every term is its own neighbour at 1.0
    without an edge.  Negative and unlisted relations, light edges and hubs are left out.
    """
    return links(near, relations, min_weight).where("strength IS NOT NULL").drop("negative")


def strengths(edges: DataFrame | StoredGraph, relations: Relations, min_weight: float = 1.0) -> DataFrame:
    """(term, other, strength): `profile` over every edge of a term, however many it has.

    Nothing is ranked, so hubs are neither sorted nor in one task: their edges are merged
    where they are made, and dealt by both ends.
    """
    between = touching(edges).where(F.col("start") != F.col("end"))
    kept = F.col("weight") >= min_weight
    if relations.negative:
        kept &= ~F.col("rel").isin(*relations.negative)
    if relations.hubs:
        kept &= ~F.col("other").isin(*relations.hubs)
    row = lambda other, strength: F.struct(other.alias("other"), strength.alias("strength"))
    strong = row(F.col("other"), F.when(kept, _weight_of(relations) * squash(F.col("weight"))))
    both = between.select("term", F.explode(F.array(row(F.col("term"), F.lit(1.0)), strong)).alias("l")).select("term", "l.*")
    return both.where("strength IS NOT NULL").groupBy("term", "other").agg(F.max("strength").alias("strength"))


def negatives(near: DataFrame, relations: Relations) -> DataFrame:
    """(term, other) of negative relations."""
    return near.where(F.col("rel").isin(*relations.negative)).select("term", "other").distinct()


def label_profiles(anchors: DataFrame, profiles: DataFrame) -> DataFrame:
    """(task, label_id, other, strength, norm): anchors' profiles merged by the maximum.

    `anchors` has task, label_id, concept.
    """
    merged = anchors.join(profiles.select(F.col("term").alias("concept"), "other", "strength"), "concept").groupBy("task", "label_id", "other").agg(F.max("strength").alias("strength"))
    norm = merged.groupBy("task", "label_id").agg(F.sqrt(F.sum(F.col("strength") * F.col("strength"))).alias("norm"))
    # Labels are configuration; what they hold is not, and stays where it is.
    return merged.join(F.broadcast(norm), ["task", "label_id"])


def two_hop(profiles: DataFrame, labels: DataFrame) -> DataFrame:
    """(term, task, label_id, cosine, shared): sparse cosine of term and label profiles.

    Terms and labels without a common neighbour have no row.  `shared` are the three
    neighbours of the greatest products.
    """
    norms = profiles.groupBy("term").agg(F.sqrt(F.sum(F.col("strength") * F.col("strength"))).alias("term_norm"))
    product = F.col("p.strength") * F.col("l.strength")
    pairs = profiles.alias("p").join(labels.alias("l"), F.col("p.other") == F.col("l.other")).select("p.term", "l.task", "l.label_id", F.col("p.other").alias("other"), product.alias("product"), "l.norm")
    # A list has a label's profile at most, which holds the neighbours of a few anchors.
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("product")).alias("minus"), "other"))), 1, 3)
    summed = pairs.groupBy("term", "task", "label_id", "norm").agg(F.sum("product").alias("dot"), top.alias("top"))
    return summed.join(norms.hint("merge"), "term").select("term", "task", "label_id", (F.col("dot") / (F.col("term_norm") * F.col("norm"))).alias("cosine"), F.col("top.other").alias("shared"))
