"""Ranked retrieval: queries are a DataFrame, too, so that one job answers many."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import space_tokens
from quarry.operators.index import SearchIndex
from quarry.sources import free_name
from quarry.storage import broadcast_if_small, is_small

K1, B, K, DIGITS = 1.2, 0.4, 10, 4
#: Weights below that of a term in a hundredth of all documents, or below this part of the query's mean, admit no document.
RARE, MEAN, PHRASE = 7.643856189774724, 0.4, 0.75
SEEDS = 1000
#: Distinct query terms up to which the index is asked for them by name.
LOOKUP = 2000
#: Bytes of query terms up to which they are broadcast; what is made of them is at most a few times wider.
SENT = 16 << 20

#: Pairs of a query and a document that a task scores at most, were each document found by each query.
PAIRS = 250_000

Send = Callable[[DataFrame], DataFrame]


def queries_of(spark: SparkSession, query: str | Mapping[str, str] | None, fields: Sequence[str], boosts: Sequence[float] | Mapping[str, float] | None = None) -> DataFrame:
    """(query_id, field, boost, text, place) of one query: a text for all fields, or one for each; fields without any are empty, unknown ones left out."""
    if query is not None and not isinstance(query, str | Mapping):
        raise ValueError("a query is a text, or a text for each field")
    weights = weights_of(fields, boosts)
    own = {f.lower(): t for f, t in query.items()} if isinstance(query, Mapping) else {f.lower(): query for f in fields}
    rows = [(0, f, weights[f], own.get(f.lower()) or "", i) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "query_id long, field string, boost double, text string, place int")


def weights_of(fields: Sequence[str], boosts: Sequence[float] | Mapping[str, float] | None) -> dict[str, float]:
    """The boost of each field: 1 if none is given; a list must have one for each field."""
    if not boosts:
        return dict.fromkeys(fields, 1.0)
    if isinstance(boosts, Mapping):
        lower = {k.lower(): float(v) for k, v in boosts.items()}
        return {f: lower.get(f.lower(), 1.0) for f in fields}
    if len(boosts) != len(fields):
        raise ValueError(f"there are {len(fields)} fields, but {len(boosts)} boosts")
    return dict(zip(fields, map(float, boosts)))


def query_table(df: DataFrame, fields: Sequence[str], id_col: str = "query_id", text_col: str = "text", boosts: Sequence[float] | Mapping[str, float] | None = None) -> DataFrame:
    """The query table of one text for each row, asked in all fields."""
    weights = weights_of(fields, boosts)
    per_field = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(weights[f]).alias("boost"), F.lit(i).alias("place")) for i, f in enumerate(fields)))
    return df.select(F.col(id_col).cast("long").alias("query_id"), F.col(text_col).alias("text"), F.explode(per_field).alias("f")).select("query_id", "f.field", "f.boost", "text", "f.place")


def terms_of(queries: DataFrame, index: SearchIndex) -> DataFrame:
    """(query_id, field, boost, term, q_idx, bucket): query tokens between blanks without stop words; q_idx follows the fields' order, then the text's."""
    exploded = queries.select("query_id", "field", "boost", "place", F.posexplode(space_tokens(F.col("text"))).alias("pos", "term"))
    if index.stop_words:
        exploded = exploded.where(~F.col("term").isin(*index.stop_words))
    order = Window.partitionBy("query_id").orderBy("place", "pos")
    return exploded.select("query_id", "field", "boost", "term", (F.row_number().over(order) - 1).alias("q_idx"), F.pmod(F.xxhash64("term"), F.lit(index.buckets)).cast("int").alias("bucket"))


def _narrowed(asked: DataFrame, index: SearchIndex) -> tuple[SearchIndex, Send]:
    """The index without what the query terms can't need, and how a table of query terms is sent to it.

    Up to LOOKUP terms are literals: their buckets are the only folders read, row groups without them are skipped, and where the
    index isn't saved they are filtered before anything is counted.
    """
    send = F.broadcast if is_small(asked, SENT) else _as_it_is  # what is sent later has no more rows than this table
    rows = asked.select("bucket", "term").distinct().limit(LOOKUP + 1).collect()
    if len(rows) > LOOKUP:
        return index, send
    wanted = F.col("bucket").isin(sorted({r["bucket"] for r in rows})) & F.col("term").isin(sorted({r["term"] for r in rows}))
    return replace(index, postings=index.postings.where(wanted), dictionary=index.dictionary.where(wanted)), send


def _as_it_is(df: DataFrame) -> DataFrame:
    return df


def _known(queries: DataFrame, index: SearchIndex) -> tuple[DataFrame, SearchIndex, Send]:
    """Query terms that are in the dictionary, with their document frequency and the field's statistics; others drop out. With what _narrowed() gives."""
    asked = terms_of(queries, index)
    index, send = _narrowed(asked, index)
    found = index.dictionary.join(send(asked), ["bucket", "field", "term"])
    return found.join(F.broadcast(index.stats.select("field", "num_docs", "avgdl")), "field"), index, send


def _folded(known: DataFrame) -> DataFrame:
    """One row for each distinct term of a query and field, with how often it is asked."""
    return known.groupBy("query_id", "bucket", "field", "term").agg(F.count("*").alias("qtf"), F.max("boost").alias("boost"), F.max("df").alias("df"), F.max("num_docs").alias("num_docs"), F.max("avgdl").alias("avgdl"), F.min("q_idx").alias("q_idx"))


def idf(num_docs: Column, df: Column) -> Column:
    """Negative for terms in more than half of all documents."""
    return F.log((num_docs - df + 0.5) / (df + 0.5))


def tf_part(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tf / (tf + k1 * (1 - b + b * dl / F.nullif(avgdl, F.lit(0.0))))


def top(scores: DataFrame, k: int | None) -> DataFrame:
    """(query_id, rank, doc_id, score), by score, then id; the k best, or all."""
    if k is not None and k < 1:
        raise ValueError("k is at least 1")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = scores.withColumn("rank", F.row_number().over(order))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)).select("query_id", "rank", "doc_id", "score")


def _hits(terms: DataFrame, index: SearchIndex, send: Send) -> tuple[DataFrame, Send]:
    """The postings of the terms by document, and how terms are joined to them.

    If the terms can be broadcast, each posting is shuffled once, however many queries ask for it: all that a query finds in a document meets in one task, which sums it
    up and keeps the best. The number of tasks follows from the numbers of documents and queries. Else, or if the index isn't saved, so that nothing is known of it, postings stay where they are.
    """
    if send is _as_it_is or not index.path:
        return index.postings, send
    docs, queries = index.stats.agg(F.max("num_docs")).first()[0] or 0, terms.select("query_id").distinct().count()
    names = terms.select("bucket", "field", "term").distinct()
    found = index.postings.join(send(names), ["bucket", "field", "term"], "left_semi")
    return found.repartition(tasks_for_pairs(index.spark, docs, queries), "doc_id"), send


def tasks_for_pairs(spark: SparkSession, docs: int, queries: int) -> int:
    return max(1, -(-docs * queries // PAIRS), min(spark.sparkContext.defaultParallelism, docs // 5000))


def _scored(terms: DataFrame, index: SearchIndex, send: Send, k1: float, b: float, more: Sequence[str] = ()) -> DataFrame:
    """(query_id, doc_id, part) for every posting of the terms, and more columns of the term."""
    weight = F.col("boost") * F.col("qtf") * idf(F.col("num_docs"), F.col("df"))
    asked = terms.select("query_id", "bucket", "field", "term", weight.alias("weight"), "avgdl", *more)
    hits, send = _hits(terms, index, send)
    found = hits.join(send(asked), ["bucket", "field", "term"])
    return found.select("query_id", "doc_id", (F.col("weight") * tf_part(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)).alias("part"), *more)


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), DIGITS).alias("score"))


def bm25(index: SearchIndex, queries: DataFrame, k: int | None = K, k1: float = K1, b: float = B, max_df: int | None = None, relax: bool = False) -> DataFrame:
    """(query_id, rank, doc_id, score) of the k best documents of each query.

    A term counts as often as it is asked. max_df leaves out terms in more documents; with relax, a query of which none is left
    keeps its rarest ones.
    """
    known, index, send = _known(queries, index)
    terms = _folded(known)
    if max_df is not None:
        if relax:
            least = F.min("df").over(Window.partitionBy("query_id"))
            terms = terms.withColumn("least", least).where((F.col("df") <= max_df) | (F.col("least") > max_df) & (F.col("df") == F.col("least"))).drop("least")
        else:
            terms = terms.where(F.col("df") <= max_df)
    return top(_summed(_scored(terms, index, send, k1, b)), k)


def seeded_postings(postings: DataFrame, limit: int = SEEDS) -> DataFrame:
    """The postings of each term with the greatest frequency, then id: (field, term, doc_id, tf, rank)."""
    order = Window.partitionBy("field", "term").orderBy(F.desc("tf"), F.desc("doc_id"))
    return postings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("field", "term", "doc_id", "tf", "rank")


def candidates(index: SearchIndex, queries: DataFrame, threshold: float, k: int | None = K, k1: float = K1, b: float = B, max_df: int | None = None, seeds: int = SEEDS) -> DataFrame:
    """(query_id, rank, doc_id, score), where terms in more documents than the threshold add to the score of what rarer ones find, but find nothing.

    A threshold up to 1 is a part of all documents. If a query has no rarer term with a posting, its rarest term's seeds are what is found.
    max_df holds for the rarer terms only.
    """
    limit = F.floor(F.lit(float(threshold)) * F.col("num_docs")) if threshold <= 1 else F.lit(int(threshold))
    known, index, send = _known(queries, index)
    terms = _folded(known).withColumn("high", F.col("df") > limit)
    finds = ~F.col("high") if max_df is None else ~F.col("high") & (F.col("df") <= max_df)
    terms = terms.withColumn("finds", finds).withColumn("rare", F.max("finds").over(Window.partitionBy("query_id"))).where(F.col("high") | F.col("finds"))
    # queries with a rarer term: what is found by none goes where it was summed up
    by_rare = _scored(terms.where("rare"), index, send, k1, b, ["finds"]).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), DIGITS).alias("score"), F.max("finds").alias("found"))
    without = terms.where(~F.col("rare"))
    rarest = without.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("df", "q_idx"))).where("place = 1")
    seed_postings = index.postings.join(send(rarest.select("query_id", "bucket", "field", "term")), ["bucket", "field", "term"])
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("tf"), F.desc("doc_id")))
    by_seed = seed_postings.withColumn("place", best).where(F.col("place") <= seeds).select("query_id", "doc_id")
    seeded = _scored(without, index, send, k1, b).join(by_seed, ["query_id", "doc_id"], "left_semi")
    return top(by_rare.where("found").drop("found").union(_summed(seeded)), k)


def idf_phrase(index: SearchIndex, queries: DataFrame, k: int | None = K) -> DataFrame:
    """(query_id, rank, doc_id, score) by the sum of idf weights, with a bonus for words that follow one another as they do in the query.

    A term's weight is its boost times 1 + log2 of documents by document frequency. A document is found by the first query token that is rare enough; what
    earlier ones matched is lost, every later match adds its weight, and PHRASE of it more if the word stands just after
    the word matched before and the token before in the query was of the same field.
    """
    known, index, send = _known(queries, index)
    known = known.withColumn("weight", F.col("boost") * (1 + F.log2(F.col("num_docs") / F.col("df"))))
    query = Window.partitionBy("query_id")
    ordered = query.orderBy("q_idx")
    gated = known.withColumn("total", F.sum("weight").over(query)).withColumn("n", F.count("*").over(query)).withColumn("before", F.lag("field").over(ordered))
    gated = gated.select("query_id", "bucket", "field", "term", "q_idx", "weight", ((F.col("weight") < RARE) | (F.col("weight") < MEAN * F.col("total") / F.col("n"))).alias("high"), F.coalesce(F.col("before") == F.col("field"), F.lit(False)).alias("same"))
    # what each query may enter a document by, as a map of the document, so that postings of others are left before they meet their queries
    hits, send = _hits(gated, index, send)
    key = F.coalesce("query_id", F.lit(-(1 << 63)))
    rare = gated.where(~F.col("high")).select("bucket", "field", "term", key.alias("key"), "q_idx")
    firsts = hits.join(send(rare), ["bucket", "field", "term"]).groupBy("doc_id", "key").agg(F.min("q_idx").alias("enter"))
    enters = firsts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "enter"))).alias("enters"))
    entered = hits.join(enters if hits is index.postings else enters.hint("shuffle_hash"), "doc_id").join(send(gated), ["bucket", "field", "term"]).where(F.col("q_idx") >= F.try_element_at("enters", key))
    entered = entered.select("query_id", "doc_id", "q_idx", "weight", "same", "first_pos")
    document = Window.partitionBy("query_id", "doc_id")
    follows = F.col("same") & (F.col("first_pos") == F.lag("first_pos").over(document.orderBy("q_idx")) + 1)
    scored = entered.withColumn("part", F.col("weight") * F.when(F.coalesce(follows, F.lit(False)), 1 + PHRASE).otherwise(1.0))
    return top(_summed(scored), k)


def with_records(results: DataFrame, records: DataFrame, id_col: str = "doc_id", rank_col: str = "rank", score_col: str = "score") -> DataFrame:
    """The records of the results, with rank and score as the last columns; results are few, so they are sent to where the records are.

    A record's column that is named like one of these two is left out; without a name, they get one that no column has.
    """
    rank_col, score_col = rank_col or free_name(records.columns, "rank"), score_col or free_name(records.columns, "score")
    own = [c for c in records.columns if c.lower() not in (rank_col.lower(), score_col.lower())]
    found = results.select(F.col("doc_id").alias(id_col), F.col("rank").alias(rank_col), F.col("score").alias(score_col))
    return records.select(*(F.col(f"`{c}`") for c in own)).join(broadcast_if_small(found), id_col).select(*(F.col(f"`{c}`") for c in own), rank_col, score_col)


def record_json(df: DataFrame, columns: Sequence[str], score_col: str = "score") -> Column:
    """A record as JSON text with its score in four digits; a column of its own named like it is dropped."""
    own = [c for c in columns if c.upper() != "SCORE"]
    return F.to_json(F.struct(F.format_string("%.4f", F.col(score_col)).alias("SCORE"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in own)))


def ordered_columns(columns: Sequence[str], search: Sequence[str]) -> list[str]:
    """Search columns, score, then the others; lower case, without blank names."""
    lower = [c.lower() for c in columns if c.strip()]
    first = [c for c in lower if c in {s.lower() for s in search}]
    return [*first, "score", *(c for c in lower if c not in first and c != "score")]
