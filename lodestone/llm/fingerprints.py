"""Merkle trees over paragraphs and sections, by DataFrame functions only.

A section is a stretch of text between blank lines, a paragraph one of its lines, and a
paragraph's leaves are its sentences (cut at ``. ``). A node's hash covers its children's
hashes in order: equal roots mean equal texts, and where roots differ the differing sections,
then paragraphs, then sentences locate the edit.

Likeness of two trees: twice the code points of distinct leaves that both hold, over the code
points of the distinct leaves of both; 1.0 for two texts without code points.

Null text counts as empty. The next document is the one with the next smaller id, after the
smallest the largest; rows of equal id follow each other by text, and null ids count as smallest. Rows of one id meet in one task.
Extra columns are ignored. An empty table gives an empty result; a document alone is its own
next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, shuffle_width

#: Documents in a bucket of neighbouring ids, about.
NEIGHBOURS = 256
#: Parts of about equally many documents that the ids' range is cut into before it is cut evenly: the square of this number.
PARTS = 16
#: Buckets whose order is settled in one task.
FAN = 4096


def _sections(text: Column) -> Column:
    """Sections of paragraphs of sentences."""
    return F.transform(F.split(text, "\n\n", -1), lambda section: F.transform(F.split(section, "\n", -1), lambda paragraph: F.split(paragraph, r"\. ", -1)))


def _hash(nodes: Column) -> Column:
    return F.sha2(F.array_join(F.transform(nodes, lambda n: n["hash"]), ",").cast("binary"), 256)


def tree(text: Column) -> Column:
    """The sections: (hash, paragraphs: (hash, sentences: (hash, code points)))."""
    node = lambda nodes, name: F.struct(_hash(nodes).alias("hash"), nodes.alias(name))
    leaf = lambda s: F.struct(F.sha2(s.cast("binary"), 256).alias("hash"), F.char_length(s).alias("n"))
    return F.transform(_sections(text), lambda section: node(F.transform(section, lambda paragraph: node(F.transform(paragraph, leaf), "sentences")), "paragraphs"))


def root(sections: Column) -> Column:
    """The root of a tree: the fingerprint."""
    return _hash(sections)


def differing(one: Column, two: Column) -> Column:
    """(section, paragraph), counted from 0, of paragraphs in ``one`` that differ from ``two``'s in their place."""
    ahead = lambda nodes, k: F.get(nodes, k)["hash"]
    of = lambda s, i: F.filter(
        F.transform(s["paragraphs"], lambda p, k: F.when(p["hash"].eqNullSafe(ahead(F.get(two, i)["paragraphs"], k)), None).otherwise(F.struct(i.alias("section"), k.alias("paragraph")))),
        lambda x: x.isNotNull(),
    )
    return F.flatten(F.transform(one, lambda s, i: F.when(s["hash"].eqNullSafe(ahead(two, i)), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(of(s, i))))


def leaf_set(sections: Column) -> Column:
    """The distinct leaves of a tree: 16 hexadecimal digits of the sentence's hash, then its code points."""
    leaves = F.flatten(F.flatten(F.transform(sections, lambda s: F.transform(s["paragraphs"], lambda p: p["sentences"]))))
    return F.array_distinct(F.transform(leaves, lambda leaf: F.concat(F.substring(leaf["hash"], 1, 16), leaf["n"].cast("string"))))


def likeness(one: Column, two: Column) -> Column:
    """0.0 to 1.0, from two leaf sets."""
    size = lambda leaves: F.aggregate(leaves, F.lit(0).cast("long"), lambda total, leaf: total + F.substring(leaf, 17, 12).cast("long"))
    both = size(one) + size(two)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * size(F.array_intersect(one, two)) / both)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, next_text) for each row, in one shuffle of the texts.

    Rows are dealt by buckets of neighbouring ids: ids' quantiles cut the table into parts, and each part's range is cut
    evenly, so outlying or clustered ids fill no bucket with more than a part. Only the last row of each bucket must look into
    another one, which small tables of buckets and of first rows settle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cuts = [k / PARTS**2 for k in range(1, PARTS**2)]
    low, high, n, inner = rows.agg(F.min("id"), F.max("id"), F.count("*"), F.percentile_approx("id", cuts)).first()
    rows = rows.withColumn("bucket", _bucket(low, high, n, inner or []))

    buckets = rows.select("bucket").distinct().withColumn("fan", F.floor(F.col("bucket") / FAN))
    buckets = materialize(buckets, "buckets")
    fans = buckets.groupBy("fan").agg(F.max("bucket").alias("top"))
    fans = fans.withColumn("below", F.lead("top").over(Window.orderBy(F.desc("fan")))).crossJoin(F.broadcast(fans.agg(F.max("top").alias("first"))))  # one row
    inside = F.lead("bucket").over(Window.partitionBy("fan").orderBy(F.desc("bucket")))
    order = buckets.withColumn("inside", inside).join(fans, "fan").select("bucket", F.coalesce("inside", "below", "first").alias("other"))

    dealt = rows.repartition(shuffle_width(docs.sparkSession), "bucket")
    in_order = Window.partitionBy("bucket").orderBy(F.desc("id"), "text")
    seen = dealt.withColumn("place", F.row_number().over(in_order)).withColumn("next_text", F.lead("text").over(in_order))
    within = seen.where("next_text IS NOT NULL").select("id", "text", "next_text")
    heads = seen.where("place = 1").select(F.col("bucket").alias("other"), F.col("text").alias("next_text"))
    across = seen.where("next_text IS NULL").drop("next_text").join(order, "bucket").join(heads, "other").select("id", "text", "next_text")
    return within.union(across).withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)


def _bucket(low: int | None, high: int | None, n: int, inner: list[int]) -> Column:
    """The number of an id's bucket, ascending with the ids; -1 for null."""
    if low is None:
        return F.lit(-1).cast("long")
    first = sorted({low, *inner})  # of each part
    last = [*(x - 1 for x in first[1:]), high]
    each = -(-n // (len(first) * NEIGHBOURS))  # buckets in a part
    groups = [first[k : k + PARTS] for k in range(0, len(first), PARTS)]
    many = lambda values: F.array(*(F.lit(x).cast("long") for x in values))
    up_to = lambda values: F.size(F.filter(values, lambda x: x <= F.col("id")))
    group = up_to(many(g[0] for g in groups)) - 1
    part = group * PARTS + up_to(F.get(F.array(*map(many, groups)), group)) - 1
    inside = (F.col("id").cast("double") - F.get(many(first), part).cast("double")) * each / (F.get(many(last), part).cast("double") - F.get(many(first), part).cast("double") + 1)
    return F.coalesce(part.cast("long") * each + F.least(F.floor(inside), F.lit(each - 1)).cast("long"), F.lit(-1).cast("long"))


def edited(text: Column, other: Column) -> Column:
    """``text`` whose last half gives way to as many first code points of ``other``, or all it has."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(other, F.lit(1), half))
