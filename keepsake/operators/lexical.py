"""BM25 as tables: postings, document lengths, term weights and one row of totals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import text as tx
from keepsake.operators.ordering import top_per_group
from keepsake.session import broadcast_if_small, cut

# --- fixed values: public Okapi defaults and the boost's stop words ---
K1 = 1.5
B = 0.75
EPSILON = 0.25
STOP_WORDS = [
    "the", "and", "for", "are", "you", "can", "how", "what", "when", "where", "who", "why", "this", "that",
    "was", "did", "的", "了", "是", "在", "有", "我", "你", "他", "她", "它", "这", "那", "吗", "呢", "啊", "哦", "嗯",
]
# --- end of fixed values ---


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # doc_id, term, tf, doc_len
    idf: DataFrame  # term, df, idf
    stats: DataFrame  # n_docs, avg_len, mean_idf


def document_tokens(docs: DataFrame, id_col: str, extra: str | None = None) -> DataFrame:
    """Tokens per document. A superseded document counts as an empty one."""
    body = F.concat_ws(" ", "content", extra) if extra else F.col("content")
    tokens = tx.search_tokens(body)
    if "superseded_by" in docs.columns:
        tokens = F.when(F.col("superseded_by").isNull(), tokens).otherwise(F.array().cast("array<string>"))
    return docs.select(F.col(id_col).alias("doc_id"), tokens.alias("tokens"))


def _counted(tokens: str) -> Column:
    """Each term of a row's tokens with its count and the number of all tokens: runs of the sorted tokens."""

    def runs(ts: Column) -> Column:
        begins = lambda w, i: F.when((i == 0) | (F.get(ts, i - 1) != w), i)
        starts = F.filter(F.transform(ts, begins), lambda i: i.isNotNull())
        size = F.size(ts)

        def one(st: Column) -> Column:
            count = lambda s, i: (F.coalesce(F.get(st, i + 1), size) - s).cast("bigint")
            return F.transform(st, lambda s, i: F.struct(F.get(ts, s).alias("term"), count(s, i).alias("tf"), size.cast("bigint").alias("doc_len")))

        return tx.let(starts, one)

    return tx.let(F.sort_array(tokens), runs)


def build_index(docs: DataFrame, id_col: str = "fact_id", extra: str | None = None) -> Index:
    """Index tables. Postings are counted inside each document's row, so nothing is shuffled,
    and written once, as terms, lengths and searches all read them.
    """
    tokens = document_tokens(docs, id_col, extra)
    postings = tokens.select("doc_id", F.explode(_counted("tokens")).alias("_t")).select("doc_id", "_t.doc_len", "_t.term", "_t.tf")
    postings = cut(postings)
    size = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    words = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_words"))
    totals = size.select("n_docs", (words.scalar() / F.col("n_docs")).alias("avg_len"))
    return _weigh(postings, totals)


def _weigh(postings: DataFrame, totals: DataFrame) -> Index:
    """Term weights from stored postings and the one row of totals."""
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = totals.select(F.col("n_docs").cast("double")).scalar()
    raw = cut(df.select("term", "df", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    weight = F.when(F.col("raw") < 0, EPSILON * mean.scalar()).otherwise(F.col("raw"))
    stats = cut(totals.select("n_docs", "avg_len", mean.scalar().alias("mean_idf")))
    return Index(postings, raw.select("term", "df", weight.alias("idf")), stats)


def _impact(avg_len) -> Column:
    """What one posting adds to a score, before the term's weight."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / avg_len))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (bucket, range, term, impact, doc) to one row per bucket, range and term, wherever batches end."""
    keys = ["bucket", "range", "term"]

    def rows(part: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        first = part.select(keys).take(pa.array(starts)).combine_chunks()
        top = np.maximum.reduceat(part.column("impact").to_numpy(), starts)
        docs = pa.ListArray.from_arrays(pa.array(np.append(starts, part.num_rows), pa.int32()), pa.concat_arrays(part.column("doc").chunks))
        return pa.RecordBatch.from_arrays([*[pa.concat_arrays(first.column(k).chunks) for k in keys], pa.array(top), docs], names=[*keys, "top", "docs"])

    rest = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        part = pa.Table.from_batches([batch])
        part = part if rest is None else pa.concat_tables([rest, part]).combine_chunks()
        changes = [pc.not_equal(part.column(k).slice(1), part.column(k).slice(0, part.num_rows - 1)).to_numpy() for k in keys]
        starts = np.append(0, np.flatnonzero(np.logical_or.reduce(changes)) + 1)
        # The last one may go on in the next batch.
        if len(starts) > 1:
            yield rows(part.slice(0, int(starts[-1])), starts[:-1])
        rest = part.slice(int(starts[-1]))
    if rest is not None:
        yield rows(rest, np.array([0]))


def write_index(index: Index, path: str, buckets: int = 64, range_docs: int = 128) -> None:
    """Store the index for searches that read a part of it.

    Terms are dealt to ``buckets`` by hash, each a folder, and documents to ranges of
    about ``range_docs``. ``postings`` has a row per bucket, range and term, with its
    documents as a list and their greatest impact, which ``blocks`` has without the
    list; ``idf`` has the weights by bucket.
    """
    totals = index.stats.first()
    ranges = max(1, -(-totals.n_docs // range_docs))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    places = {"bucket": bucket, "range": F.pmod(F.xxhash64("doc_id"), F.lit(ranges)).cast("int")}
    # A bucket with frequent terms goes to several tasks, by range; a term's documents of a range are in one of them.
    placed = index.postings.withColumns(places).repartition("bucket", F.pmod("range", F.lit(16)))
    placed = placed.select("bucket", "range", "term", _impact(F.lit(totals.avg_len)).alias("impact"), F.struct("doc_id", "tf", "doc_len").alias("doc"))
    lists = placed.sortWithinPartitions("bucket", "range", "term").mapInArrow(
        _listed, f"bucket int, range int, term string, top double, docs array<{placed.schema['doc'].dataType.simpleString()}>"
    )
    lists.write.partitionBy("bucket").parquet(f"{path}/postings")
    stored = index.postings.sparkSession.read.parquet(f"{path}/postings")
    stored.drop("docs").write.partitionBy("bucket").parquet(f"{path}/blocks")
    index.idf.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/idf")
    index.stats.withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/stats")


def search_stored(spark: SparkSession, path: str, queries: DataFrame, k: int, text_col: str = "text") -> DataFrame:
    """``search`` over an index that ``write_index`` stored: the same hits from a part of the files.

    Only the buckets of the queries' terms are read. Of these first the blocks: in a
    range no document exceeds the sum of its terms' greatest impacts, and one document
    has at least the greatest of them. So the k-th best of these least scores is a score
    that k documents reach, and ranges whose greatest possible score is below it are
    left out for that query. Lists of the terms asked for go to their range's task, which
    sums the scores of its documents.
    """
    stats = spark.read.parquet(f"{path}/stats").first()
    terms = _query_terms(queries, text_col).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(stats.buckets)).cast("int"))
    # At most one number per bucket of the index.
    wanted = [r.bucket for r in terms.select("bucket").distinct().collect()]
    part = lambda name: spark.read.parquet(f"{path}/{name}").where(F.col("bucket").isin(wanted))
    gains = cut(terms.join(part("idf"), ["bucket", "term"]).select("query_id", "bucket", "term", (F.col("repeat") * F.col("idf")).alias("gain")))
    kept = possible_ranges(part("blocks"), gains, k)
    asking = kept.groupBy("range").agg(F.collect_set("query_id").alias("asking"))
    terms = gains.select("bucket", "term").distinct()
    lists = part("postings").select("bucket", "term", "range", "docs").join(broadcast_if_small(terms), ["bucket", "term"], "left_semi")
    met = lists.repartition("range").join(asking, "range").join(broadcast_if_small(gains), ["bucket", "term"]).where(F.array_contains("asking", F.col("query_id")))
    weight = F.col("gain") * _impact(F.lit(stats.avg_len))
    found = met.select("range", "query_id", "gain", F.explode("docs").alias("_d")).select("range", "query_id", "gain", "_d.*")
    scored = found.groupBy("range", "query_id", "doc_id").agg(F.sum(weight).alias("score")).filter("score > 0").drop("range")
    return cut(top_per_group(scored, ["query_id"], [F.desc(F.round("score", 9)), F.asc("doc_id")], k))


def possible_ranges(blocks: DataFrame, gains: DataFrame, k: int) -> DataFrame:
    """query_id, range: where one of the ``k`` best documents may lie."""
    bound = F.col("gain") * F.col("top")
    met = blocks.join(broadcast_if_small(gains), ["bucket", "term"])
    # A term of negative weight can only lower a score, and then no least score is known.
    limits = cut(
        met.groupBy("query_id", "range").agg(F.sum(F.greatest(bound, F.lit(0.0))).alias("most"), F.max(bound).alias("least"))
    )
    kth = top_per_group(limits, ["query_id"], [F.desc("least"), F.asc("range")], k).where(F.col("rank") == k).select("query_id", F.col("least").alias("floor"))
    sure = gains.groupBy("query_id").agg(F.min("gain").alias("low")).where("low >= 0").select("query_id")
    floors = kth.join(sure, "query_id")
    # Scores are compared to nine places.
    enough = F.col("floor").isNull() | (F.col("most") >= F.col("floor") - 1e-6)
    return limits.join(floors, "query_id", "left").where(enough).select("query_id", "range")


def add_documents(index: Index, docs: DataFrame, id_col: str = "fact_id") -> Index:
    """Index with ``docs`` appended: postings are added, weights are counted again from postings."""
    return _reweigh(index, build_index(docs, id_col).postings, document_tokens(docs, id_col), None)


def remove_documents(index: Index, ids: DataFrame) -> Index:
    """Index without the documents of ``ids`` (doc_id)."""
    return _reweigh(index, None, None, ids)


def _reweigh(index, new_postings, new_docs, gone):
    postings, stats = index.postings, index.stats
    base = stats.select("n_docs", (F.col("n_docs") * F.col("avg_len")).alias("total_len"))
    if gone is not None:
        lens = postings.join(gone, "doc_id", "left_semi").select("doc_id", "doc_len").distinct()
        words, docs = lens.agg(F.coalesce(F.sum("doc_len"), F.lit(0))), gone.agg(F.count(F.lit(1)))
        base = base.select(
            (F.col("n_docs") - docs.scalar()).alias("n_docs"), (F.col("total_len") - words.scalar()).alias("total_len")
        )
        postings = postings.join(gone, "doc_id", "left_anti")
    if new_postings is not None:
        words, docs = new_docs.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))), new_docs.agg(F.count(F.lit(1)))
        base = base.select(
            (F.col("n_docs") + docs.scalar()).alias("n_docs"), (F.col("total_len") + words.scalar()).alias("total_len")
        )
        postings = postings.unionByName(new_postings)
    totals = base.select("n_docs", (F.col("total_len") / F.col("n_docs")).alias("avg_len"))
    return _weigh(postings, totals)


def _query_terms(queries: DataFrame, text_col: str) -> DataFrame:
    words = queries.select("query_id", F.explode(tx.search_tokens(F.col(text_col))).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("repeat"))


def search(index: Index, queries: DataFrame, k: int, text_col: str = "text") -> DataFrame:
    """Top ``k`` documents per query: (query_id, doc_id, score, rank).

    The query side holds one row per distinct query term. It is counted and sent
    to the postings when small, so postings stay where they are; beyond the bound
    a shuffle join on the term takes over, whose hot terms AQE splits.
    """
    terms = _query_terms(queries, text_col).join(index.idf.select("term", "idf"), "term")
    weight = F.col("repeat") * F.col("idf") * _impact(index.stats.select("avg_len").scalar())
    scored = (
        index.postings.join(broadcast_if_small(terms), "term")
        .groupBy("query_id", "doc_id")
        .agg(F.sum(weight).alias("score"))
        .filter("score > 0")
    )
    return cut(top_per_group(scored, ["query_id"], [F.desc(F.round("score", 9)), F.asc("doc_id")], k))


def boost_tokens(text: Column) -> Column:
    """Distinct query tokens without stop words."""
    found = F.concat(
        tx.all_matches(F.lower(text), tx.LEFT + r"[a-z]{3,}" + tx.RIGHT),
        tx.all_matches(text, r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]{2,}"),
    )
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP_WORDS]))


def keyword_boost(tokens: Column, content: Column, keywords: Column | None = None, boost: float = 0.06) -> Column:
    """Amount added to the score: keyword hits, plus 0.3 for each token found inside the content."""
    low = F.lower(content)
    inside = F.size(F.filter(tokens, lambda t: low.contains(t)))
    hits = inside * 0.3
    if keywords is not None:
        hits = hits + F.size(F.array_intersect(tokens, F.transform(keywords, F.lower)))
    return boost * hits
