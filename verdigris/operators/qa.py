"""Question answering data: pairs, examples, permutations, splits, labels for training."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.functions.text import choice_prompt
from verdigris.storage import cut


def seeded(seed: str, *columns: str) -> Column:
    """A reproducible shuffling key: md5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


def _number(key: Column, below: int) -> Column:
    """A number under `below` from the first hexadecimal digits of an md5."""
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(below))


def turn_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, gold): each user turn and the assistant's next one."""
    line = Window.partitionBy("conv_id").orderBy("turn")
    paired = turns.withColumn("__role", F.lead("role").over(line)).withColumn("gold", F.lead("text").over(line))
    return paired.where("role = 'user' AND __role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "gold")


def valid_questions(rows: DataFrame) -> DataFrame:
    """Rows with labels, a question, and two answers and two rationales at least."""
    return rows.where("answer_label is not null and rationale_label is not null and length(question) > 0 and size(answers) >= 2 and size(rationales) >= 2")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with i, their place from 0 in the given order over all rows: a sort by ranges,
    and the number of rows in the ranges before (one row per range)."""
    line = Window.partitionBy("__part")
    parted = cut(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parted.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__start"))
    return parted.withColumn("__i", F.row_number().over(line.orderBy(*order))).join(starts, "__part").withColumn("i", F.col("__start") + F.col("__i") - 1).drop("__part", "__i", "__start")


def with_distractors(pairs: DataFrame, n: int = 3, seed: str = "distract") -> DataFrame:
    """`pairs` with options: the gold answer and `n` others, in seeded order.

    The distinct answers stand in a ring by their md5; a pair takes `n` different places
    of it, from a seeded one on, and never its own.  With fewer than n + 1 distinct
    answers it gets all others.  A pair without an answer has no options.  Repeated rows
    stay, each with the same options.
    """
    # conv_id, turn and the answer name a pair; joins go by the answer's hash.
    keyed = cut(pairs.withColumns({"key": seeded(seed, "conv_id", "turn"), "h": F.md5("gold")}))
    answers = keyed.where("gold is not null").select("h", "gold").distinct()
    ring = cut(numbered(answers, "h", "gold").select("h", "gold", "i"))
    m = ring.count()
    start = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    drawn = keyed.select("conv_id", "turn", "key", "h").distinct().join(ring.select("h", "i"), "h")
    places = [(F.col("i") + 1 + F.pmod(start + j, F.lit(m - 1))) % m for j in range(min(n, m - 1))]
    wanted = drawn.select("conv_id", "turn", "h", F.explode(F.array(*places).cast("array<long>")).alias("i"))
    others = wanted.join(ring.select("i", "gold"), "i").groupBy("conv_id", "turn", "h").agg(F.collect_list("gold").alias("others"))
    joined = keyed.join(others, ["conv_id", "turn", "h"], "left")
    options = F.concat(F.array("gold"), F.coalesce("others", F.array().cast("array<string>")))
    order = F.array_sort(F.transform(options, lambda o: F.struct(F.md5(F.concat("key", F.lit("|"), o)).alias("h"), o.alias("option"))))
    ordered = joined.withColumn("options", F.when(F.col("gold").isNotNull(), F.transform(order, lambda x: x["option"])).otherwise(F.array().cast("array<string>")))
    return ordered.withColumn("answer_label", F.array_position("options", F.col("gold")).cast("int") - 1).drop("others", "h")


def why(question: Column, answer: Column) -> Column:
    """The question for the reason of an answer."""
    return F.concat(question, F.lit(" The answer is: "), answer, F.lit(" Why is this answer correct?"))


def examples(questions: DataFrame, tasks: tuple[str, ...] = ("qa", "explain")) -> DataFrame:
    """(conv_id, turn, task, prompt, target): one example of every question and task.

    qa: the options of the answer; qar: those of its reason (`rationales`, with
    `rationale_label`); explain: the answer, ended by punctuation, and its reason if there
    are any.
    """
    letter = lambda label: F.char(F.lit(65) + F.col(label))
    ended = F.when(F.col("gold").rlike(r"[.!?]\s*$"), F.trim("gold")).otherwise(F.concat(F.trim("gold"), F.lit(".")))
    row = lambda task, prompt, target: F.struct(F.lit(task).alias("task"), prompt.alias("prompt"), target.alias("target"))
    reasoned = "rationales" in questions.columns
    made = {
        "qa": lambda: row("qa", choice_prompt(F.col("question"), F.col("options")), letter("answer_label")),
        "qar": lambda: row("qar", choice_prompt(why(F.col("question"), F.col("gold")), F.col("rationales")), letter("rationale_label")),
        "explain": lambda: row("explain", F.col("question"), F.concat_ws(" ", ended, F.get("rationales", F.col("rationale_label"))) if reasoned else ended),
    }
    return questions.select("conv_id", "turn", F.explode(F.array(*[made[t]() for t in tasks])).alias("e")).select("conv_id", "turn", "e.*")


def split(rows: DataFrame, keys: list[str], test: float = 0.1, select: float = 0.05, seed: str = "split") -> DataFrame:
    """`rows` with part: test, select or train by a seeded hash of the keys (disjoint)."""
    u = _number(seeded(seed, *keys), 1_000_000) / 1e6
    both = float(Decimal(str(test)) + Decimal(str(select)))  # 0.1 + 0.05 is more than 0.15 in binary
    return rows.withColumn("part", F.when(u < test, "test").when(u < both, "select").otherwise("train"))


def first_of_shuffle(rows: DataFrame, keys: list[str], n: int, seed: str = "shuffle") -> DataFrame:
    """The first n rows of a seeded shuffle."""
    return rows.orderBy(seeded(seed, *keys), *keys).limit(n)


def permutations(options: Column, n: int = 2) -> Column:
    """Orders of the options (indices): as they are, reversed, then cyclic shifts."""
    places = F.sequence(F.lit(0), F.size(options) - 1)
    shift = lambda by: F.concat(F.slice(places, by + 1, F.size(options)), F.slice(places, 1, by))
    step = F.greatest(F.lit(1), F.floor(F.size(options) / F.lit(n)).cast("int"))
    listed = [places, F.reverse(places), *[shift(step * i) for i in range(1, max(0, n - 2) + 1)]]
    return F.array(*listed[:n])


def debiased(options: DataFrame, n: int = 2) -> DataFrame:
    """(item_id, order_id, slot, option): the options in each order a scorer sees."""
    orders = options.select("item_id", "options", F.posexplode(permutations(F.col("options"), n)).alias("order_id", "places"))
    return orders.select("item_id", "order_id", "options", F.posexplode("places").alias("slot", "place")).select("item_id", "order_id", "slot", "place", F.get("options", F.col("place")).alias("option"))


def find_last(sequence: Column, part: Column) -> Column:
    """Last start index of `part` in `sequence`, -1 if it is not there."""
    n = F.size(sequence) - F.size(part)
    starts = F.when((n >= 0) & (F.size(part) > 0), F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_max(F.filter(starts, lambda i: F.slice(sequence, i + 1, F.size(part)) == part)), F.lit(-1))


def masked_labels(ids: Column, answer_mark: Column, pad: int, mask: int = -100) -> Column:
    """Training labels: everything up to the last answer mark, and padding, is masked."""
    start = find_last(ids, answer_mark)
    return F.transform(ids, lambda x, i: F.when((start < 0) | (i < start + F.size(answer_mark)) | (x == pad), F.lit(mask)).otherwise(x))


def scaled_boxes(boxes: Column, x_ratio: Column, y_ratio: Column) -> Column:
    """Boxes [x1, y1, x2, y2, ...] scaled to another image size; boxes without numbers go."""
    return F.transform(F.filter(boxes, lambda b: b.isNotNull() & (F.size(b) >= 4)), lambda b: F.transform(b, lambda v, i: F.when(i >= 4, v).when(i % 2 == 0, v * x_ratio).otherwise(v * y_ratio)))
