"""How five document filters act together: every order of them replayed, as relations.

Each document's failures (one flag a filter) meet the orders of the filters, of which there are always
factorial(5) = 120, as a broadcast table. The place of the first filter that a document fails is
worked out once for a document and order; its five steps are then exploded, and conditional sums of
them are grouped by part, order and step. Partial sums are formed before the shuffle: a task sends no more
rows than its parts times 600, however many documents it reads.

Equal texts are found without a group of copies in any one task: the least doc_id of each text is a
grouped minimum, and a document is an original if (text, doc_id) is one of these. That join is on both
columns, so that copies of one text, which differ in doc_id, lie apart.

Defined cases: null text is empty; null source counts to the part of the empty string; a null doc_id is
neither smaller than another nor a copy, and has no labels; rows that share a doc_id count each, and are no
copies of each other; a document is good (toxic) if any label row of its doc_id says so; no rows
give no rows. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, table, text_of, written

FILTERS = "ABCDE"
#: Least words; least share of different words, most share of capitals (both in 100).
LEAST_WORDS, DIFFERENT, CAPITALS = 50, 65, 5
SYMBOLS = r"[#$%&*|]"


def conditions(text: Column, words: Column) -> dict[str, Column]:
    """Whether a text fails each filter that looks at it alone."""
    n = F.size(words)
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DIFFERENT * n,
        "C": 100 * capitals > CAPITALS * F.char_length(text),
        "D": text.rlike(SYMBOLS),
    }


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic) of each row of docs; failed has bit k set if it fails FILTERS[k]."""
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_of().alias("text"))
    d = text.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), 0))
    fails = conditions(F.col("text"), F.col("words"))
    own = sum((F.when(fails[f], F.lit(1 << k)).otherwise(0) for k, f in enumerate(FILTERS) if f in fails), F.lit(0))
    d = d.select("id", "part", own.alias("own"), F.unhex(F.sha2("text", 256)).alias("mark"))
    # Rows without an id meet nothing in the joins; keys of their own keep them from one task.
    d = d.withColumn("known", F.col("id").isNotNull()).withColumn("id", F.coalesce("id", F.xxhash64(F.monotonically_increasing_id())))
    least = text.where("id is not null").groupBy(F.unhex(F.sha2("text", 256)).alias("mark")).agg(F.min("id").alias("id"))
    d = d.join(least.withColumn("original", F.lit(True)), ["mark", "id"], "left")
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
    d = d.join(marked.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")), "id", "left")
    copy = F.col("known") & F.col("original").isNull()
    failed = F.col("own") + F.when(copy, F.lit(1 << FILTERS.index("E"))).otherwise(0)
    marks = [F.coalesce(F.col("known") & F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    return d.select("part", failed.alias("failed"), *marks)


def orders(spark) -> DataFrame:
    """(filter_order, bits): the orders of the filters, and each one's bit at each step. Always 120 rows."""
    rows = [("".join(p), [1 << FILTERS.index(f) for f in p]) for p in permutations(FILTERS)]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>").coalesce(1)


def replay(found: DataFrame) -> DataFrame:
    """flags() -> one row for each part, order and step, with what the step keeps, removes and repeats."""
    d = found.crossJoin(F.broadcast(orders(found.sparkSession)))
    first = F.lit(len(FILTERS) + 1)
    for k in reversed(range(len(FILTERS))):
        first = F.when(F.col("failed").bitwiseAND(F.col("bits")[k]) != 0, F.lit(k + 1)).otherwise(first)
    d = d.select("part", "filter_order", "failed", "good", "toxic", first.alias("first"), F.posexplode("bits").alias("at", "bit"))
    step = F.col("at") + 1
    fails, removed = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("first") == step
    sums = {
        "kept": F.col("first") > step,
        "removed": removed,
        "redundant": fails & (F.col("first") < step),
        "unique_fails": F.col("failed") == F.col("bit"),
        "good_lost": removed & F.col("good"),
        "toxic_lost": removed & F.col("toxic"),
    }
    return d.groupBy("part", "filter_order", step.cast("int").alias("step")).agg(*[F.count_if(c).alias(n) for n, c in sums.items()])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The replay with shapley: what a step's filter removes in its part, summed over all orders."""
    # Written, as it is read twice: 600 rows for each part.
    d = written(replay(flags(docs, labels)), docs).withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    each = [F.sum(F.when(F.col("filter") == f, F.col("removed")).otherwise(0)).alias(f) for f in FILTERS]
    total = d.groupBy("part").agg(*each).withColumnRenamed("part", "_part")
    d = d.join(total, F.col("part") == F.col("_part"))
    shapley = F.coalesce(*[F.when(F.col("filter") == f, F.col(f)) for f in FILTERS])
    return d.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))


def op12_interaction(spark, sf_dir):
    """op12's report over the whole documents and labels tables."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
