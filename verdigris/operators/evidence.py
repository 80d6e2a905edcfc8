"""Evidence: key terms, facts, and the support that terms give to labels.

Terms are scored once per distinct concept, signal by signal, with equi-joins (the
cross product of terms and labels is never formed), and joined back to the items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.functions.text import clean_phrase, let, token_set
from verdigris.functions.vectors import squash
from verdigris.functions.vocabulary import DEFAULT, Vocabulary
from verdigris.operators.graph import Relations

#: Salience of a term by where it comes from (fixed values).
SALIENCE = {
    "action": 1.0, "gesture": 0.9, "role": 0.9, "draft_activity": 0.8, "draft_relationship": 0.8, "object": 0.7,
    "draft_intention": 0.7, "setting": 0.6, "question": 0.6, "caption": 0.5, "person": 0.25,
}
#: Multipliers of the signals (fixed values).
DIRECT, PHRASE, TWO_HOP, COSINE_GAIN, KEYWORD, NEGATIVE = 0.9, 0.7, 0.6, 2.5, 0.6, 0.5
BACK_OFF, FLOOR = 0.5, 0.3
#: Multipliers of a fact's relevance: it leads to an anchor, to another of the item's concepts, elsewhere.
TO_ANCHOR, TO_OTHER, ELSEWHERE = 2.0, 1.5, 0.5
#: Terms of less salience look at all their facts.
SALIENT = 0.05


def key_terms(mentions: DataFrame, most: int = 20, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """(item_id, phrase, salience, kinds, ord, rank) from mentions
    (item_id, phrase, kind, factor, ord).

    Cleaned phrases of three letters or more and three words at most; of a phrase that
    is mentioned more than once the greatest salience and all kinds; the `most` most
    salient ones, earlier mentions first among equals.
    """
    table = F.create_map(*[F.lit(x) for pair in SALIENCE.items() for x in pair])
    cleaned = mentions.withColumn("phrase", clean_phrase(F.col("phrase"), vocabulary)).where((F.length("phrase") >= 3) & (F.size(F.split("phrase", " ")) <= 3))
    # Dealt by item once, phrases merge and are ranked where they are.  Kinds are bits of a
    # number until then, since sets are merged by sorting.
    known = sorted(SALIENCE)
    bit = F.element_at(F.create_map(*[F.lit(x) for i, kind in enumerate(known) for x in (kind, 1 << i)]), F.col("kind"))
    kinds = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(1 << i) != 0, kind) for i, kind in enumerate(known)]))
    merged = (
        cleaned.repartition("item_id").withColumn("salience", F.element_at(table, F.col("kind")) * F.col("factor"))
        .groupBy("item_id", "phrase")
        .agg(F.max("salience").alias("salience"), F.bit_or(bit).alias("bits"), F.min("ord").alias("ord"))
    )
    order = Window.partitionBy("item_id").orderBy(F.col("salience").desc(), "ord", "phrase")
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("item_id", "phrase", "salience", kinds.alias("kinds"), "ord", "rank")


def grounded(terms: DataFrame, resolved: DataFrame) -> DataFrame:
    """Terms with their concept; one that backed off to a shorter concept counts half."""
    joined = terms.join(resolved.hint("merge"), "phrase", "left")
    backed = F.coalesce("backed_off", F.lit(False))
    return joined.withColumn("backed_off", backed).withColumn("salience", F.when(backed, F.col("salience") * BACK_OFF).otherwise(F.col("salience")))


def signals(profiles: DataFrame, anchors: DataFrame, cosines: DataFrame, keywords: DataFrame, negative: DataFrame, relations: Relations) -> DataFrame:
    """(term, task, label_id, score, reason): how strongly a concept speaks for a label.

    The best of: the concept is an anchor (1, nothing else counts); an edge to one; a
    definitional edge to a phrase that holds one; a common neighbourhood; a keyword.  A
    negative edge to an anchor takes 0.5 off.  Ties go to the signal named first.
    `keywords` has (term, task, label_id, df): the smallest df of the shared words.
    """
    row = lambda score, place, name: (score.alias("score"), F.lit(place).alias("place"), F.lit(name).alias("reason"))
    a = anchors.select("task", "label_id", "concept")
    edges = profiles.where("edge is not null")
    exact = profiles.join(a, profiles.term == a.concept).select("term", "task", "label_id").distinct().select("*", *row(F.lit(1.0), 0, "anchor"))
    direct = edges.join(a, edges.other == a.concept).select("term", "task", "label_id", *row(DIRECT * F.col("strength"), 1, "edge"))
    n_words = F.size(F.split("other", "_"))
    phrases = edges.where(F.col("edge.rel").isin(*relations.definitional) & n_words.between(2, 6)) if relations.definitional else edges.limit(0)
    words = phrases.select("term", "strength", F.explode(F.array_distinct(F.split("other", "_"))).alias("concept"))
    phrase = words.join(a, "concept").select("term", "task", "label_id", *row(PHRASE * F.col("strength"), 2, "phrase"))
    near = cosines.select("term", "task", "label_id", *row(TWO_HOP * F.least(F.lit(1.0), COSINE_GAIN * F.col("cosine")), 3, "neighbourhood"))
    word = keywords.select("term", "task", "label_id", *row(KEYWORD / F.col("df"), 4, "keyword"))
    best = (
        exact.unionByName(direct).unionByName(phrase).unionByName(near).unionByName(word)
        .groupBy("term", "task", "label_id")
        .agg(F.max_by(F.struct("score", "reason"), F.struct(F.col("score"), -F.col("place"))).alias("best"), F.max(F.col("place") == 0).alias("exact"))
    )
    against = negative.join(a, negative.other == a.concept).select("term", "task", "label_id").distinct().withColumn("against", F.lit(True))
    both = best.join(against, ["term", "task", "label_id"], "full_outer")
    counts = F.coalesce("against", F.lit(False)) & ~F.coalesce("exact", F.lit(False))
    score = F.coalesce("best.score", F.lit(0.0)) - F.when(counts, NEGATIVE).otherwise(0.0)
    return both.select("term", "task", "label_id", score.alias("score"), F.when(counts, "contrast").otherwise(F.col("best.reason")).alias("reason"))


def keyword_hits(concepts: DataFrame, lexicon: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """(term, task, label_id, df) of phrases (term, phrase) that share a word with a label."""
    words = concepts.select("term", F.explode(token_set(F.col("phrase"), vocabulary)).alias("word")).distinct()
    return words.join(F.broadcast(lexicon), "word").groupBy("term", "task", "label_id").agg(F.min("df").alias("df"))


def label_support(terms: DataFrame, scores: DataFrame, labels: DataFrame, kind_weights: DataFrame) -> DataFrame:
    """(item_id, task, label_id, support): weighted mean score of the item's terms.

    A term weighs its salience times the greatest weight of its kinds (task, kind,
    weight); all its terms count in the mean.  Support is at least 0, and is divided by
    the item's best support in the task, or by FLOOR if that is more.  Every label of an
    item with terms has a row.
    """
    # Tasks and labels are configuration: a short list of tasks, each with its weights and its
    # labels, which have numbers (`slot`).  An item's terms are dealt by concept to meet their
    # scores, then by item, and add up by number; a task's total has a number below zero.
    of_task = kind_weights.groupBy("task", "kind").agg(F.max("weight").alias("weight")).groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("kind", "weight"))).alias("weights"))
    spaces = labels.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("label_id", "ord"))).alias("space"))
    tasks = F.sort_array(F.collect_list(F.struct("task", "space", F.map_entries("weights").alias("weights"))))
    config = F.broadcast(of_task.join(spaces, "task").agg(tasks.alias("config")))
    slot = lambda t, i: (t * F.lit(1 << 20) + i).cast("int").alias("slot")
    numbered = config.select(F.posexplode("config").alias("t", "c")).select("t", "c.task", F.posexplode("c.space").alias("i", "l")).select("task", "l.label_id", "t", slot(F.col("t"), F.col("i")))
    best = lambda weights: let(F.map_from_entries(weights), lambda w: F.array_max(F.transform("kinds", lambda k: F.try_element_at(w, k))))
    weighed = terms.crossJoin(config).select("item_id", "concept", F.transform("config", lambda c: best(c["weights"])).alias("of"), "salience")
    weighed = weighed.where(F.exists("of", lambda w: w.isNotNull())).select("item_id", "concept", F.transform("of", lambda w: F.col("salience") * w).alias("w"), F.transform("of", lambda w: w.isNotNull()).alias("told"))
    entries = F.collect_list(F.struct("t", "slot", "score"))
    scored = scores.join(F.broadcast(numbered), ["task", "label_id"]).groupBy(F.col("term").alias("concept")).agg(entries.alias("s"))
    met = weighed.join(scored.hint("merge"), "concept", "left").select("item_id", "w", "told", "s").repartition("item_id")
    totals = F.filter(F.transform("w", lambda w, t: F.struct((-1 - t).cast("int").alias("slot"), w.alias("x"))), lambda x: F.get("told", -1 - x["slot"]))
    hits = F.transform(F.filter("s", lambda x: F.get("w", x["t"]) > 0), lambda x: F.struct(x["slot"].alias("slot"), (F.get("w", x["t"]) * x["score"]).alias("x")))
    summed = met.select("item_id", F.explode(F.concat(totals, F.coalesce(hits, F.slice(totals, 1, 0)))).alias("e")).groupBy("item_id", "e.slot").agg(F.sum("e.x").alias("sum"))
    sums = summed.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "sum"))).alias("sums"))
    known = sums.crossJoin(config).select("item_id", "sums", F.posexplode("config").alias("t", "c")).where(F.map_contains_key("sums", -1 - F.col("t")))
    known = known.withColumn("total", F.try_element_at("sums", -1 - F.col("t")))
    total = F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))
    mean = lambda i: F.greatest(F.lit(0.0), F.coalesce(F.try_element_at("sums", slot(F.col("t"), i)), F.lit(0.0)) / total)
    raw = known.select("item_id", "c.task", F.transform("c.space", lambda x, i: F.struct(x["label_id"].alias("label_id"), x["ord"].alias("ord"), mean(i).alias("raw"))).alias("raw"))
    scaled = raw.withColumn("scale", F.greatest(F.array_max(F.col("raw.raw")), F.lit(FLOOR)))
    each = scaled.select("item_id", "task", "scale", F.explode("raw").alias("r"))
    return each.select("item_id", "task", "r.label_id", "r.ord", (F.col("r.raw") / F.col("scale")).alias("support"))


def draft_match(lexical: DataFrame, draft_scores: DataFrame) -> DataFrame:
    """(item_id, task, label_id, draft): the better of lexical match and 0.8 x the best
    score of the draft's terms, to four places."""
    both = lexical.select("item_id", "task", "label_id", F.col("score").alias("lex")).join(draft_scores.groupBy("item_id", "task", "label_id").agg(F.max("score").alias("best")), ["item_id", "task", "label_id"], "full_outer")
    return both.select("item_id", "task", "label_id", F.round(F.greatest(F.coalesce("lex", F.lit(0.0)), 0.8 * F.coalesce("best", F.lit(0.0))), 4).alias("draft"))


def disambiguate(support: DataFrame, draft: DataFrame) -> DataFrame:
    """(item_id, task, label_id): the label of the greatest support + draft, the first in
    label order among equals; null if nothing speaks for any."""
    both = support.join(draft.hint("merge"), ["item_id", "task", "label_id"], "left")
    total = F.col("support") + F.coalesce("draft", F.lit(0.0))
    best = both.groupBy("item_id", "task").agg(F.max_by("label_id", F.struct(total, -F.col("ord"))).alias("label_id"), F.max(total).alias("total"))
    return best.select("item_id", "task", F.when(F.col("total") > 0, F.col("label_id")).alias("label_id"))


def facts(terms: DataFrame, profiles: DataFrame, anchor_words: DataFrame, relations: Relations, per_term: int = 6, most: int = 40) -> DataFrame:
    """(item_id, place, rel, start, end, relevance): an item's facts, the most relevant
    first; equal ones once, from the term that is ranked first."""
    weights = terms.sparkSession.createDataFrame(sorted(relations.weights.items()), "rel string, rel_weight double")
    # Each term takes its item's concepts along to where the term's facts are, takes its best
    # facts there, and goes back with these alone.
    concepts = F.collect_set("concept").over(Window.partitionBy("item_id"))
    own = terms.select("item_id", "rank", F.col("concept").alias("term"), "salience", "backed_off", concepts.alias("concepts")).where(~F.col("backed_off")).drop("backed_off")
    named = profiles.where("edge is not null").where(F.col("other").rlike(r"^[\p{L}_]*\p{L}[\p{L}_]*$") & (F.length("other") - F.length(F.translate("other", "_", "")) <= 2))
    named = named.select("term", "other", "edge.*").join(F.broadcast(weights), "rel")
    named = named.join(anchor_words.select(F.col("concept").alias("other"), F.lit(True).alias("anchor")), "other", "left")
    value = F.col("rel_weight") * squash(F.col("weight"))
    base = value * F.when(F.col("anchor"), TO_ANCHOR).otherwise(ELSEWHERE)
    fact = F.struct((-base).alias("minus"), value.alias("value"), F.col("anchor").isNotNull().alias("anchor"), "other", (-F.col("weight")).alias("light"), "rel", "start", "end")
    listed = named.groupBy("term").agg(F.array_sort(F.collect_list(fact)).alias("facts"))
    # Facts that `per_term` others beat by more than rounding can hide are not among a term's
    # best, unless they lead to another of the item's own concepts.  They are in order, and
    # few are near the last that counts.
    bar = F.get("facts.minus", F.lit(per_term - 1))
    listed = listed.select("term", "facts", F.when(bar.isNull(), F.col("facts")).otherwise(F.filter("facts", lambda x: x["minus"] <= bar + 2e-4 / SALIENT)).alias("head"), F.col("facts.other").alias("others"))
    met, s = own.join(listed.hint("merge"), "term"), F.col("salience")

    def best(mutual: Column) -> Column:
        graded = lambda x, factor: F.struct((-F.round(x["value"] * factor * s, 4)).alias("minus"), x["light"].alias("light"), x["rel"].alias("rel"), x["start"].alias("start"), x["end"].alias("end"))
        common = lambda facts: F.transform(facts, lambda x: graded(x, F.when(x["anchor"], TO_ANCHOR).otherwise(ELSEWHERE)))
        apart = lambda facts: F.filter(facts, lambda x: ~F.array_contains(mutual, x["other"]))
        to_own = F.transform(F.filter("facts", lambda x: F.array_contains(mutual, x["other"])), lambda x: graded(x, F.when(x["anchor"], TO_ANCHOR).otherwise(TO_OTHER)))
        pool = F.when(s >= SALIENT, F.col("head")).otherwise(F.col("facts"))
        return F.slice(F.array_sort(F.when(F.size(mutual) > 0, F.concat(common(apart(pool)), to_own)).otherwise(common(pool))), 1, per_term)

    best = let(F.array_intersect("others", "concepts"), best)
    dealt = met.select("item_id", "rank", F.transform(best, lambda x: F.struct((-x["minus"]).alias("relevance"), x["rel"].alias("rel"), x["start"].alias("start"), x["end"].alias("end"))).alias("best")).repartition("item_id")
    rows = dealt.select("item_id", "rank", F.posexplode("best").alias("n", "f")).select("item_id", "rank", "n", "f.*")
    once = rows.groupBy("item_id", "rel", "start", "end").agg(F.min_by(F.struct("relevance", "rank", "n"), F.struct("rank", "n")).alias("b")).select("item_id", "rel", "start", "end", "b.*")
    order = Window.partitionBy("item_id").orderBy(F.col("relevance").desc(), "rank", "n")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("item_id", "place", "rel", "start", "end", "relevance")
