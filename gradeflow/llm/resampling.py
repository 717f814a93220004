"""Importance resampling towards a target distribution, on hashed runs of words.

Every run of words is a feature that falls into one of 10,000 buckets. A bucket's gain says how much likelier the
target is to draw from it than the corpus. A document's weight is the mean gain of its features; a Gumbel number
from its id is added, and the highest sums are the resample: drawing without replacement by weight.

Scoring explodes nothing: higher-order functions make an array of a document's buckets, which is written once, and
sum up what stands at those places in an array of all gains, a literal of the plan. Only counts are shuffled: one
row a bucket and task for the gains, one row a score and task for the cut. Scores are whole numbers, so that the
ranks of drawn documents are the number of higher scores, from those counts, and a place among equal ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, without

BUCKETS, LONGEST_RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased; none of a null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NON_WORD), lambda w: w != "")


def runs(of: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` consecutive words of an array, joined by one space."""

    def of_length(n: int) -> Column:
        places = F.when(F.size(of) >= n, F.sequence(F.lit(1), F.size(of) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.slice(of, i, n), " "))

    return F.concat(of, *(of_length(n) for n in range(2, longest + 1)))


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def with_buckets(docs: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """``docs(text, ...)`` without the text but with ``n_words`` and ``buckets``, one entry for each feature."""
    split = docs.withColumn("_words", words(F.col("text")))
    return split.select(*(f"`{c}`" for c in docs.columns if c != "text"), F.size("_words").alias("n_words"), F.transform(runs(F.col("_words"), longest), lambda x: bucket(x, buckets)).alias("buckets"))


def bucket_counts(hashed: DataFrame) -> DataFrame:
    """(bucket, n) over all rows of ``hashed(buckets)``; each task sends one row a bucket at most."""
    return hashed.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket in thousandths of a nat, from (bucket, n) of both sides; as many as there are buckets.

    ``floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))``, in doubles.
    """
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    found = {r["bucket"]: (r["s"], r["t"]) for r in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()}
    s_all, t_all = sum(s for s, _ in found.values()), sum(t for _, t in found.values())
    spark = corpus.sparkSession
    rows = [(b, *map(float, found.get(b, (0, 0)))) for b in range(buckets)]
    ratio = (F.col("t") + 1) * F.lit(float(s_all + buckets)) / ((F.col("s") + 1) * F.lit(float(t_all + buckets)))
    table_ = spark.createDataFrame(rows, "b int, s double, t double").select("b", F.floor(1000 * F.log(ratio)).alias("gain"))
    return [r["gain"] for r in sorted(table_.collect())]


def gumbel(key: str, seed: str = SEED) -> Column:
    """Thousandths of a Gumbel number by the first 32 bits of sha256(``seed:key``); a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weighed(hashed: DataFrame, gain: list[int]) -> DataFrame:
    """``hashed(buckets, ...)`` with ``weight``, the floored mean of the gains of a row's buckets, 0 without any."""
    values = F.lit(gain).cast("array<long>")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(values, b + 1))
    n = F.size("buckets")
    return hashed.withColumn("_total", total).withColumn("weight", F.when(n > 0, F.expr("(_total - pmod(_total, size(buckets))) div size(buckets)")).otherwise(0).cast("long")).drop("_total")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST_RUN, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """All columns of ``docs(doc_id, text, ...)`` but the text, and ``n_features``, ``weight``, ``score``, ``rank``.

    ``target(text)`` is what the resample shall look like. Of the N documents with at least ``least_words`` words
    the ``floor(percent * N / 100)`` with the highest scores are drawn and get their rank from 1 on, ties go to the
    smaller doc_id, null ids last; all others have a null rank. A null or empty text has no features and weight 0.
    Repeated rows are each a document; rows that share doc_id and score are ordered by features and weight. Very
    long texts are read whole. Empty tables give empty results; an empty target gives weights that only tell
    rare from frequent. Columns of the result's names are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resampling")
    rest = without(docs, ("text", "n_features", "weight", "score", "rank", "n_words", "buckets"))
    hashed = scratch.write(with_buckets(docs.select(*(f"`{c}`" for c in rest), "text"), longest, buckets), "buckets")
    gain = gains(bucket_counts(hashed), bucket_counts(with_buckets(target.select("text"), longest, buckets)), buckets)
    scored = weighed(hashed, gain).select(*(f"`{c}`" for c in rest), "n_words", F.size("buckets").cast("long").alias("n_features"), "weight", (F.col("weight") + gumbel("doc_id", seed)).alias("score"))
    scored = scratch.write(scored, "scores")
    scratch.drop("buckets")
    open_ = F.col("n_words") >= least_words
    # scores are whole thousandths between the least and the largest gain and Gumbel number: some 60,000 at most
    per_score = sorted(((r["score"], r["n"]) for r in scored.filter(open_).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draws = percent * sum(n for _, n in per_score) // 100
    above, so_far = [], 0
    for score, n in per_score:
        if so_far >= draws:
            break
        above.append((score, so_far))
        so_far += n
    cut = above[-1][0] if above else None
    reached = open_ & (F.col("score") >= F.lit(cut)) if above else F.lit(False)
    before = spark.createDataFrame(above, "score long, _above long")
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    rank = F.col("_above") + place
    drawn = scored.filter(reached).join(F.broadcast(before), "score").withColumn("rank", F.when(rank <= draws, rank))
    out = [*(f"`{c}`" for c in rest), "n_features", "weight", "score", "rank"]
    others = scored.filter(~reached).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*out).unionByName(others.select(*out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 of a string's bytes, by the usual table of 256 remainders; words are hashed once each.
ORACLE = r"""
WITH crc AS (
    SELECT list(list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
    FROM range(256) AS r(i)
), words AS (
    SELECT 'd' AS kind, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
    UNION ALL
    SELECT 't', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), hashed AS (
    SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(length(hex(encode(w))) // 2), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
                  lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT w FROM words), crc
), counted AS (
    SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 't') AS t FROM words JOIN hashed USING (w) GROUP BY bucket
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * ((SELECT sum(s) FROM counted) + 10000)::DOUBLE / ((s + 1.0::DOUBLE) * ((SELECT sum(t) FROM counted) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counted
), weights AS (
    SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS g FROM words JOIN hashed USING (w) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY doc_id
), scored AS (
    SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight,
           CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS gumbel
    FROM documents LEFT JOIN weights USING (doc_id)
), placed AS (
    SELECT *, weight + gumbel AS score, n_features >= 20 AS long_enough, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + gumbel DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN long_enough AND place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank
FROM placed
"""
