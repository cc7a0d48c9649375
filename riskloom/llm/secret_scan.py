"""Secret scan: candidates by their characters, false positives removed by a random forest; only DataFrame functions.

Candidates are runs of at least ``min_chars`` key characters with a letter in them. Features of a candidate: length, shares of character classes,
changes between classes, distinct characters, how much of it is covered by four-letter pieces of words that are frequent in
the corpus, words before and after it, signs around it, and words in the path. A random forest (Spark ML) learns from
labelled findings and gives every finding its probability to be a secret.

Word pieces are counted over all documents, each document once, and combined before the shuffle; there are at most 26^4.
Of either label at most ``rows_per_class`` findings train the forest, those with the smallest hash.

Defined results: null and empty texts have no finding; a null path is an empty one; every row of a repeated document gives
its own findings; findings with a null label are not learned from; with no finding of one label every probability is the
share of the other label (0 without any). Texts are scanned whole, in linear time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.llm.shared import require, stored

NEAR = 60
SALTS = 16
_KEY = r"A-Za-z0-9_+/=-"
#: Words that speak for and against a secret near a candidate or in its path.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "access_key", "auth", "bearer", "credential", "private")
OTHER_WORDS = ("sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "hash", "uuid", "etag", "integrity", "example", "sample", "placeholder")
PATH_WORDS = ("test", "example", "fixture", "mock", "sample", "doc", "lock")


@dataclass(frozen=True)
class SecretModel:
    forest: RandomForestClassificationModel | None
    pieces: DataFrame
    prior: float = 0.0


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", *, min_chars: int = 16) -> DataFrame:
    """``id, path, start, candidate, before, after``, one row for each candidate."""
    require(docs, (key, text, path))
    pattern = rf"(?<![\p{{L}}\p{{N}}_+/=-])[{_KEY}]{{{min_chars},}}+(?![\p{{L}}\p{{N}}])"
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs[key].alias("id"),
        F.coalesce(docs[path].cast("string"), F.lit("")).alias("path"),
        docs[text].alias("text"),
        F.regexp_extract_all(docs[text], F.lit(pattern), F.lit(0)).alias("found"),
    ).filter(F.size("found") > 0)
    between = F.split("text", pattern, -1)
    parts = F.transform(
        F.sequence(F.lit(1), F.size("found")),
        lambda i: F.struct(
            F.element_at("found", i).alias("candidate"),
            F.right(F.element_at("between", i), F.lit(NEAR)).alias("before"),
            F.left(F.element_at("between", i + 1), F.lit(NEAR)).alias("after"),
            F.length(F.element_at("between", i)).alias("gap"),
        ),
    )
    each = rows.withColumn("between", between).select("row", "id", "path", F.posexplode(parts).alias("at", "p"))
    each = each.select("row", "id", "path", "at", "p.*")
    earlier = W.partitionBy("row").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    start = F.sum(F.col("gap") + F.length("candidate")).over(earlier) - F.length("candidate")
    return each.withColumn("start", start).filter(F.col("candidate").rlike("[A-Za-z]")).drop("row", "at", "gap")


def word_pieces(docs: DataFrame, text: str = "text", *, min_docs: int = 20) -> DataFrame:
    """``piece``: the four-letter pieces of words found in at least ``min_docs`` documents."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(docs[text]), F.lit(r"(?<![a-z0-9])[a-z]{4,12}(?![a-z0-9])"), F.lit(0)))
    frequent = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    return frequent.select(F.explode(_fours(F.col("word"))).alias("piece")).distinct()


def _fours(text: Column) -> Column:
    last = F.length(text) - 3
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: text.substr(i, F.lit(4)))).otherwise(F.array().cast("array<string>"))


def _share(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]", "")) / F.greatest(F.length(text), F.lit(1))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.lower(text).rlike(rf"(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])").cast("double")


FEATURES = {
    "length": lambda: F.least(F.length("candidate"), F.lit(512)).cast("double"),
    "digits": lambda: _share(F.col("candidate"), "0-9"),
    "uppers": lambda: _share(F.col("candidate"), "A-Z"),
    "lowers": lambda: _share(F.col("candidate"), "a-z"),
    "signs": lambda: _share(F.col("candidate"), "_+/=-"),
    "hex": lambda: _share(F.col("candidate"), "0-9a-fA-F"),
    # characters that a change of class follows: letter to digit, digit to letter, lower to upper
    "changes": lambda: F.size(F.split("candidate", "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|[_+/=-]"))
    / F.length("candidate"),
    "distinct": lambda: F.size(F.array_distinct(F.split(F.substring("candidate", 1, 512), ""))) / F.least(F.length("candidate"), F.lit(512)),
    "vowels": lambda: _share(F.col("candidate"), "aeiouAEIOU"),
    "covered": lambda: F.col("covered"),
    "assigned": lambda: F.col("before").rlike("[=:]\\s*[\"'`]?$").cast("double"),
    "quoted": lambda: (F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).cast("double"),
    "secret_word": lambda: _any(F.right("before", F.lit(30)), SECRET_WORDS),
    "other_word": lambda: _any(F.right("before", F.lit(30)), OTHER_WORDS),
    "secret_after": lambda: _any(F.left("after", F.lit(30)), SECRET_WORDS),
    "in_address": lambda: F.col("before").rlike("(?:://|www\\.)\\S*$").cast("double"),
    "path_word": lambda: F.lower("path").rlike("|".join(PATH_WORDS)).cast("double"),
    "path_depth": lambda: F.size(F.split("path", "/")).cast("double"),
}


def with_features(found: DataFrame, pieces: DataFrame) -> DataFrame:
    """``found`` with a column of its own for each feature, named ``f_...``."""
    distinct = found.select("candidate").distinct()
    cut = distinct.select("candidate", F.explode_outer(_fours(F.lower("candidate"))).alias("piece"))
    met = cut.join(pieces.select(F.col("piece").alias("known")), cut["piece"] == F.col("known"), "left")
    covered = met.groupBy(F.col("candidate").alias("same")).agg((F.count("known") / F.count("*")).alias("covered"))
    # a value that very many findings share is dealt out over the salts
    salted = found.withColumn("f__salt", F.pmod(F.xxhash64("id", "start", "before"), F.lit(SALTS)))
    covered = covered.withColumn("f__same_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = (salted["candidate"] == covered["same"]) & (salted["f__salt"] == covered["f__same_salt"])
    joined = salted.join(covered, met)
    return joined.select(*found.columns, *(F.coalesce(f().cast("double"), F.lit(0.0)).alias(f"f_{name}") for name, f in FEATURES.items()))


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{name}" for name in FEATURES], outputCol="f__all").transform(df)


def fit(labelled: DataFrame, pieces: DataFrame, *, rows_per_class: int = 10_000, trees: int = 30, depth: int = 8, seed: int = 7) -> SecretModel:
    """Learns from findings with features and ``label`` (1: a secret)."""
    known = labelled.filter("label in (0, 1)").withColumn("f__order", F.xxhash64("candidate", "before", "after"))
    parts = [known.filter(F.col("label") == y).orderBy("f__order", "start").limit(rows_per_class) for y in (0, 1)]
    chosen = stored(_assembled(parts[0].unionAll(parts[1])).select("f__all", F.col("label").cast("double").alias("f__label")), "secret-training")
    counts = {int(r["f__label"]): r["count"] for r in chosen.groupBy("f__label").count().collect()}
    if len(counts) < 2:
        return SecretModel(None, pieces, float(1 in counts))
    forest = RandomForestClassifier(
        featuresCol="f__all", labelCol="f__label", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="f__p", rawPredictionCol="f__r", predictionCol="f__y"
    )
    return SecretModel(forest.fit(chosen), pieces)


def judge(featured: DataFrame, model: SecretModel) -> DataFrame:
    """``id, path, start, candidate, before, after, probability`` of findings with features."""
    kept = [c for c in featured.columns if not c.startswith("f_")]
    if model.forest is None:
        return featured.select(*kept, F.lit(model.prior).alias("probability"))
    scored = model.forest.transform(_assembled(featured))
    return scored.select(*kept, F.element_at(vector_to_array("f__p"), 2).alias("probability"))
