"""One query for each operator, over whole tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import sources
from quarry.functions import text
from quarry.operators import codec, complete, rank, sketch
from quarry.operators.index import SearchIndex, field_tokens, statistics
from quarry.plans import sql
from quarry.storage import new_folder, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A question with frequent and rare words, one twice, one unknown.
QUESTION = "the worthless moron of thanedble and the in zzzunknown"
PART = {"p_name": "blue steel", "p_type": "PROMO copper", "p_brand": "Brand#13"}
PART_FIELDS = list(PART)
BOOSTS = {"p_name": 2.0, "p_type": 1.0, "p_brand": 0.5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sources.read_parquet(spark, f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are much work each."""
    return spread(table(spark, sf_dir, name))


def query(oracle: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


_indexes: dict[tuple, SearchIndex] = {}


def index_of(spark: SparkSession, sf_dir: str, name: str, key: str, fields: list[str], tokenizer: str = "space", stop_words: str | None = None) -> SearchIndex:
    """The saved index of a table; it is built once in a session for each folder."""
    at = (spark.sparkContext.applicationId, sf_dir, name, tuple(fields), tokenizer, stop_words)
    if at not in _indexes:
        _indexes[at] = SearchIndex.build(table(spark, sf_dir, name), fields, key, tokenizer, stop_words).stored()
    return _indexes[at]


def documents_index(spark: SparkSession, sf_dir: str, tokenizer: str = "space", stop_words: str | None = None) -> SearchIndex:
    return index_of(spark, sf_dir, "documents", "doc_id", ["text"], tokenizer, stop_words)


def built(spark: SparkSession, sf_dir: str, tokenizer: str = "space") -> SearchIndex:
    """The plan of the documents' index, not saved."""
    return SearchIndex.build(table(spark, sf_dir, "documents"), ["text"], tokenizer=tokenizer)


_DOCS = sql.index("documents", "doc_id", ["text"])
_ALNUM = sql.index("documents", "doc_id", ["text"], "alnum")
_PART = sql.index("part", "p_partkey", PART_FIELDS)
_ASKED = sql.asked_rows({"text": QUESTION}, {})
_BATCH = sql.asked_table("benchmark", "item_id", ["text"])


# ---- tokens


def _tokenized(spark: SparkSession, sf_dir: str, tokenizer: str) -> DataFrame:
    parts = field_tokens(wide(spark, sf_dir, "documents"), ["text"], tokenizer=tokenizer)
    return parts.select("doc_id", F.size("toks").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("toks"), " ")).alias("digest"))


def _tokenized_sql(tokenizer: str) -> str:
    return f"SELECT doc_id, len(t) AS n, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, {sql.toks('text', tokenizer)} AS t FROM documents)"


@query(_tokenized_sql("space"))
def tokenize_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokenized(spark, sf_dir, "space")


@query(_tokenized_sql("alnum"))
def tokenize_alnum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokenized(spark, sf_dir, "alnum")


@query(_tokenized_sql("sketch"))
def tokenize_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokenized(spark, sf_dir, "sketch")


@query(f"WITH {_DOCS} SELECT DISTINCT term, ceil(length(term) / 20.0)::BIGINT AS pieces, substr(term, 1, 20) AS first FROM postings")
def long_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = text.split_long(F.col("term"), 20)
    return documents_index(spark, sf_dir).dictionary.select("term", F.size(pieces).cast("long").alias("pieces"), pieces[0].alias("first"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[^a-zA-Z0-9\s]', '', 'g'), '\s+', ' ', 'g') AS cleaned FROM documents""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query(f"SELECT conv_id, turn, len(t) AS n, len(list_filter(t, lambda x: x NOT IN {sql.stop_list()})) AS kept FROM (SELECT conv_id, turn, {sql.toks('text')} AS t FROM conversations)")
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.space_tokens(F.col("text")).alias("t"))
    kept = F.filter("t", lambda x: ~x.isin(*text.STOP_WORDS))
    return rows.select("conv_id", "turn", F.size("t").cast("long").alias("n"), F.size(kept).cast("long").alias("kept"))


@query(f"SELECT doc_id, len(list_filter(t, lambda term: {sql.VALID})) AS valid, len(t) AS n FROM (SELECT doc_id, {sql.toks('text')} AS t FROM documents)")
def valid_token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.space_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size(F.filter("t", text.is_valid)).cast("long").alias("valid"), F.size("t").cast("long").alias("n"))


# ---- index


@query(f"WITH {_DOCS} SELECT doc_id, term, tf FROM postings")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).postings.select("doc_id", "term", "tf")


@query(f"WITH {_DOCS} SELECT term, df FROM dict")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).dictionary.select("term", "df")


@query(f"WITH {_DOCS} SELECT doc_id, dl FROM lengths")
def doc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).lengths.select("doc_id", F.col("dl").cast("long").alias("dl"))


_STATS = "SELECT s.field, s.num_docs, round(s.avgdl, 6) AS avgdl, d.num_terms, d.num_postings, l.num_tokens FROM stats s JOIN (SELECT field, count(*) AS num_terms, sum(df)::BIGINT AS num_postings FROM dict GROUP BY field) d USING (field) JOIN (SELECT field, sum(dl)::BIGINT AS num_tokens FROM lengths GROUP BY field) l USING (field)"


@query(f"WITH {_PART} {_STATS}")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index_of(spark, sf_dir, "part", "p_partkey", PART_FIELDS).stats
    return found.select("field", "num_docs", F.round("avgdl", 6).alias("avgdl"), "num_terms", "num_postings", "num_tokens")


@query(f"WITH {_DOCS} SELECT field, count(*) AS num_terms FROM dict GROUP BY field")
def vocab_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).dictionary.groupBy("field").agg(F.count("*").alias("num_terms"))


@query(f"WITH {_ALNUM} SELECT doc_id, term, first_pos FROM postings")
def first_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "alnum").postings.select("doc_id", "term", "first_pos")


@query(f"WITH {_DOCS} SELECT term, tf, count(*) AS docs FROM postings GROUP BY ALL")
def tf_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).postings.groupBy("term", "tf").agg(F.count("*").alias("docs"))


@query(f"WITH {_DOCS} SELECT term, doc_id, tf, rank FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY tf DESC, doc_id DESC)::INT AS rank FROM postings) WHERE rank <= 1000")
def seeded_postings_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.seeded_postings(documents_index(spark, sf_dir).postings).select("term", "doc_id", "tf", "rank")


# ---- ranking


def _ask(spark: SparkSession, index: SearchIndex, question: str = QUESTION) -> DataFrame:
    return rank.queries_of(spark, question, index.fields)


@query(sql.bm25(_DOCS, _ASKED))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    return rank.bm25(index, _ask(spark, index))


@query(sql.bm25(_DOCS, _ASKED, k=None))
def bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    return rank.bm25(index, _ask(spark, index), k=None)


@query(sql.bm25(_DOCS, _ASKED, where="df <= 100"))
def bm25_max_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    return rank.bm25(index, _ask(spark, index), max_df=100)


@query(sql.bm25(_DOCS, _ASKED, where="df <= 1 OR least > 1 AND df = least"))
def bm25_max_df_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    return rank.bm25(index, _ask(spark, index), max_df=1, relax=True)


@query(sql.bm25(sql.index("documents", "doc_id", ["text"], stop=True), _ASKED, stop=True))
def bm25_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir, stop_words="english")
    return rank.bm25(index, _ask(spark, index))


@query(sql.bm25(_DOCS, sql.asked_rows({"text": "moron worthless moron moron"}, {})))
def bm25_repeated_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    return rank.bm25(index, _ask(spark, index, "moron worthless moron moron"))


@query(sql.bm25(_DOCS, _BATCH))
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    return rank.bm25(index, rank.query_table(table(spark, sf_dir, "benchmark"), index.fields, "item_id"))


@query(sql.bm25(_DOCS, _BATCH, k1=0.9, b=0.75))
def bm25_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    return rank.bm25(index, rank.query_table(table(spark, sf_dir, "benchmark"), index.fields, "item_id"), k1=0.9, b=0.75)


def _part_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    return index_of(spark, sf_dir, "part", "p_partkey", PART_FIELDS)


@query(sql.bm25(_PART, sql.asked_rows(PART, {})))
def bm25_multifield(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _part_index(spark, sf_dir)
    return rank.bm25(index, rank.queries_of(spark, PART, index.fields))


@query(sql.bm25(_PART, sql.asked_rows(PART, BOOSTS), k=100))
def bm25_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _part_index(spark, sf_dir)
    return rank.bm25(index, rank.queries_of(spark, PART, index.fields, BOOSTS), k=100)


_PART_DOCS = sql.bm25(_PART, sql.asked_rows(dict.fromkeys(PART_FIELDS, "blue PROMO Brand#13"), {}))


@query(f"SELECT p.p_partkey, p.p_name, p.p_brand, p.p_type, r.rank, r.score FROM ({_PART_DOCS}) r JOIN part p ON p.p_partkey = r.doc_id")
def bm25_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _part_index(spark, sf_dir)
    found = rank.bm25(index, rank.queries_of(spark, "blue PROMO Brand#13", index.fields))
    return rank.with_records(found, table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", "p_name", "p_brand", "p_type", "rank", "score")


@query(f"SELECT p.p_partkey, to_json({{SCORE: printf('%.4f', r.score), p_name: p.p_name, p_type: p.p_type, p_brand: p.p_brand}})::VARCHAR AS record FROM ({_PART_DOCS}) r JOIN part p ON p.p_partkey = r.doc_id")
def record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _part_index(spark, sf_dir)
    found = rank.with_records(rank.bm25(index, rank.queries_of(spark, "blue PROMO Brand#13", index.fields)), table(spark, sf_dir, "part"), "p_partkey")
    return found.select("p_partkey", rank.record_json(found, PART_FIELDS).alias("record"))


@query(sql.candidates(_DOCS, _BATCH, 0.05))
def bm25_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    return rank.candidates(index, rank.query_table(table(spark, sf_dir, "benchmark"), index.fields, "item_id"), 0.05)


@query(sql.candidates(_DOCS, sql.asked_rows({"text": "the of in"}, {}), 0.05))
def bm25_candidates_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    return rank.candidates(index, _ask(spark, index, "the of in"), 0.05)


@query(sql.idf_phrase(_ALNUM, _BATCH))
def idf_phrase_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir, "alnum")
    return rank.idf_phrase(index, rank.query_table(table(spark, sf_dir, "benchmark"), index.fields, "item_id"))


@query(sql.idf_phrase(sql.index("pages", "page_id", ["url", "html"], "alnum"), sql.asked_table("benchmark", "item_id", ["url", "html"])))
def idf_phrase_multifield(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir, "pages", "page_id", ["url", "html"], "alnum")
    return rank.idf_phrase(index, rank.query_table(table(spark, sf_dir, "benchmark"), index.fields, "item_id"))


# ---- records


_PAIRS = "string_split(translate(translate(coalesce(q, ''), '+', ' '), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '&')"


@query("SELECT c_custkey, translate(c_name, 'abcdefghijklmnopqrstuvwxyz+', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ ') AS name, translate(c_mktsegment, 'abcdefghijklmnopqrstuvwxyz+', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ ') AS segment FROM customer")
def parse_query_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    fields = text.query_fields(F.concat(F.lit("name="), F.col("c_name"), F.lit("&nothing&segment="), F.col("c_mktsegment")))
    return rows.select("c_custkey", fields.alias("f")).select("c_custkey", F.col("f")["NAME"].alias("name"), F.col("f")["SEGMENT"].alias("segment"))


_ESCAPED = """replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;')"""


@query(f"""SELECT conv_id, turn, regexp_replace({_ESCAPED}, '(the|stupid|you)', '<span class="highlight">\\1</span>', 'gi') AS marked FROM conversations""")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.highlight(F.col("text"), "the stupid -- you").alias("marked"))


@query("SELECT n_name, n_nationkey, 0.0::DOUBLE AS score, n_regionkey FROM nation")
def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    return rows.withColumn("score", F.lit(0.0)).select(*rank.ordered_columns(rows.columns, ["N_NAME"]))


# ---- completion


def _name_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.col("p_partkey").alias("value"), F.col("p_size").cast("double").alias("score"), F.col("p_partkey").alias("seq"))
    return complete.upsert(entries)


_NAMES = "terms AS (SELECT p_name AS key, max(p_partkey) AS value, arg_max(p_size, p_partkey)::DOUBLE AS score FROM part WHERE p_name <> '' GROUP BY p_name)"


@query(f"WITH {_NAMES} SELECT * FROM terms")
def trie_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_terms(spark, sf_dir)


@query(f"WITH {_NAMES} SELECT q.key, t.value FROM (SELECT p_name AS key FROM part UNION SELECT p_type FROM part) q LEFT JOIN terms t USING (key)")
def trie_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    keys = rows.select(F.col("p_name").alias("key")).union(rows.select("p_type")).distinct()
    return complete.find(_name_terms(spark, sf_dir), keys).select("key", "value")


@query(f"WITH {_NAMES} SELECT key, value FROM terms WHERE starts_with(key, 'b')")
def trie_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete.prefix(_name_terms(spark, sf_dir), "b").select("key", "value")


def _corpus_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir, "alnum").dictionary.select(F.col("term").alias("key"), F.col("df").alias("value"), F.col("df").cast("double").alias("score"))


_CORPUS = f"{_ALNUM}, terms AS (SELECT term AS key, df AS value, df::DOUBLE AS score FROM dict)"


@query(f"WITH {_CORPUS} SELECT key, score FROM terms WHERE starts_with(key, 'TH') ORDER BY score DESC, key LIMIT 10")
def complete_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete.complete(_corpus_terms(spark, sf_dir), "TH").select("key", "score")


@query(f"WITH {_CORPUS}, prefixes AS (SELECT DISTINCT substr(key, 1, n) AS prefix FROM terms, (VALUES (1), (2)) v(n) WHERE length(key) >= n) SELECT prefix, rank, key, score FROM (SELECT p.prefix, t.key, t.score, row_number() OVER (PARTITION BY p.prefix ORDER BY t.score DESC, t.key)::INT AS rank FROM prefixes p JOIN terms t ON p.prefix IN (substr(t.key, 1, 1), substr(t.key, 1, 2)) AND starts_with(t.key, p.prefix)) WHERE rank <= 10")
def complete_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _corpus_terms(spark, sf_dir)
    prefixes = terms.select(F.explode(F.array(*(F.when(F.length("key") >= n, F.substring("key", 1, n)) for n in (1, 2)))).alias("prefix")).where("prefix is not null").distinct()
    return complete.complete_all(terms, prefixes)


@query(f"WITH {_CORPUS}, chars AS (SELECT length(key) AS n, unnest(string_split(key, '')) AS ch, generate_subscripts(string_split(key, ''), 1) - 1 AS i FROM terms), weights AS (SELECT ch, sum(n - i)::BIGINT AS weight FROM chars WHERE ch <> '' GROUP BY ch) SELECT ch, weight, CASE WHEN place <= 54 THEN place ELSE 0 END::INT AS rank FROM (SELECT *, row_number() OVER (ORDER BY weight DESC, ch) AS place FROM weights)")
def char_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete.character_ranks(_corpus_terms(spark, sf_dir))


@query("SELECT a.n_name AS a, b.n_name AS b, len(list_filter(range(1, least(length(a.n_name), length(b.n_name)) + 1), lambda i: substr(a.n_name, 1, i) = substr(b.n_name, 1, i))) AS shared FROM nation a, nation b")
def common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("a"))
    pairs = rows.crossJoin(rows.select(F.col("a").alias("b")))
    return pairs.select("a", "b", complete.common_prefix(F.col("a"), F.col("b")).cast("long").alias("shared"))


# ---- sketches


_BIT = "(('0x' || substr(md5(token), 1, 8))::BIGINT % 128)"


def _sketch_sql(source: str, key: str) -> str:
    return f"SELECT {key}, ({_BIT} // 32)::INT AS word, bit_or(1::BIGINT << ({_BIT} % 32)::INT) AS bits FROM (SELECT {key}, unnest(list_distinct(t)) AS token FROM (SELECT {key}, {sql.toks('text', 'sketch')} AS t FROM {source})) GROUP BY ALL"


@query(_sketch_sql("documents", "doc_id"))
def sketch_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.documents(wide(spark, sf_dir, "documents"), ["text"]).select("doc_id", "word", "bits")


@query(f"WITH d AS ({_sketch_sql('documents', 'doc_id')}), q AS ({_sketch_sql('benchmark', 'item_id')}) SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM (SELECT q.item_id AS query_id, d.doc_id, sum(8 * bit_count(d.bits & q.bits)::BIGINT)::DOUBLE AS score FROM d JOIN q USING (word) GROUP BY ALL) WHERE score > 0) WHERE rank <= 10")
def sketch_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sketch.documents(wide(spark, sf_dir, "documents"), ["text"])
    return sketch.overlap(docs, sketch.queries(table(spark, sf_dir, "benchmark"), "item_id"))


@query("""WITH s AS (SELECT vec_id, list_transform([0, 1], lambda w: list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[w * 32 + i + 1] > 0 THEN 1::BIGINT << i::INT ELSE 0 END))::BIGINT) AS words FROM embeddings)
SELECT query_id, rank, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, bit_count(xor(q.words[1], v.words[1]))::BIGINT + bit_count(xor(q.words[2], v.words[2]))::BIGINT AS distance FROM s q, s v)) WHERE rank <= 10""")
def hamming_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return sketch.nearest(spread(vectors), vectors, 64)


# ---- codecs


_RATE = 1e-8


@query(f"WITH {_DOCS} SELECT term, tf, n, 27 AS hashes, ceil(n * (ln({_RATE}) / ln(1 / pow(2, ln(2)))))::BIGINT AS bits, ceil(ceil(n * (ln({_RATE}) / ln(1 / pow(2, ln(2))))) / 8)::BIGINT AS bytes FROM (SELECT term, tf, count(*) AS n FROM postings GROUP BY ALL)")
def bloom_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = documents_index(spark, sf_dir).postings.groupBy("term", "tf").agg(F.count("*").alias("n"))
    bits = codec.bloom_bits(F.col("n"), _RATE)
    return sizes.select("term", "tf", "n", F.lit(codec.bloom_hashes(_RATE)).alias("hashes"), bits.alias("bits"), codec.bloom_bytes(bits).alias("bytes"))


@query(f"WITH {_DOCS} SELECT term, doc_id, tf FROM postings SEMI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)")
def bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return documents_index(spark, sf_dir).postings.join(chosen, "doc_id", "left_semi").select("term", "doc_id", "tf")


_GAPS = "gaps AS (SELECT term, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM postings)"


@query(f"WITH {_DOCS}, {_GAPS} SELECT term, doc_id, gap FROM gaps")
def delta_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.delta_gaps(documents_index(spark, sf_dir).postings).select("term", "doc_id", "gap")


@query(f"WITH {_DOCS}, {_GAPS} SELECT term, sum(greatest(1, ceil(length(bin(gap)) / 7.0)))::BIGINT AS bytes FROM gaps GROUP BY term")
def vbyte_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = codec.delta_gaps(documents_index(spark, sf_dir).postings)
    return gaps.groupBy("term").agg(F.sum(codec.vbyte_length(F.col("gap"))).alias("bytes"))


@query("""SELECT c_custkey, CASE WHEN c_custkey < 128 THEN printf('%02X', c_custkey) WHEN c_custkey < 16384 THEN printf('%02X', c_custkey % 128 + 128) || printf('%02X', c_custkey // 128)
ELSE printf('%02X', c_custkey % 128 + 128) || printf('%02X', (c_custkey // 128) % 128 + 128) || printf('%02X', c_custkey // 16384) END AS code FROM customer""")
def vbyte_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", codec.vbyte(F.col("c_custkey")).alias("code"))


@query(f"""WITH {_DOCS}, placed AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS place, row_number() OVER (PARTITION BY term ORDER BY doc_id) - row_number() OVER (PARTITION BY term, tf ORDER BY doc_id) AS island FROM postings),
cut AS (SELECT *, (row_number() OVER (PARTITION BY term, tf, island ORDER BY doc_id) - 1) // 255 AS part FROM placed),
runs AS (SELECT term, tf, island, part, min(place) AS first, count(*) AS length FROM cut GROUP BY ALL)
SELECT term, row_number() OVER (PARTITION BY term ORDER BY first)::INT AS run, tf, length FROM runs""")
def rle_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.run_lengths(documents_index(spark, sf_dir).postings).select("term", "run", "tf", "length")


@query("SELECT o_custkey, array_to_string(keys, ',') AS keys, array_to_string(keys[1:3], ',') AS first FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS keys FROM orders GROUP BY ALL)")
def vbyte_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    coded = lists.select("o_custkey", F.array_join(F.transform("keys", codec.vbyte), "").alias("code"))
    text = lambda c, name: F.array_join(c, ",").alias(name)
    return coded.select("o_custkey", text(codec.vbyte_decode(F.col("code")), "keys"), text(codec.vbyte_decode(F.col("code"), 3), "first"))


_PLACED = "placed AS (SELECT term, doc_id, tf, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS place FROM postings)"


@query(f"WITH {_DOCS}, {_PLACED} SELECT term, place::BIGINT AS place, doc_id FROM placed")
def gaps_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = codec.numbered_gaps(documents_index(spark, sf_dir).postings)
    return codec.from_gaps(gaps.select("field", "term", "gap", "place")).select("term", "place", "doc_id")


@query(f"WITH {_DOCS}, {_PLACED} SELECT term, place::BIGINT AS place, tf FROM placed")
def rle_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.from_run_lengths(codec.run_lengths(documents_index(spark, sf_dir).postings)).select("term", "place", "tf")


@query("""SELECT c_custkey, CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END::BIGINT AS hash FROM (
SELECT c_custkey, list_reduce([14695981039346656037::HUGEINT] || list_transform(range(8), lambda i: ((c_custkey >> (8 * i)::INT) & 255)::HUGEINT), lambda a, b: (xor(a, b) * 435 + (xor(a, b) % 16777216) * 1099511627776) % 18446744073709551616) AS h FROM customer)""")
def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", codec.fnv1a(F.col("c_custkey")).alias("hash"))


# ---- sources and sinks


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "csv")
    sources.write_csv(table(spark, sf_dir, "documents"), path)
    read = sources.read_csv(spark, path, nulls=True)
    return read.select(F.col("doc_id").cast("long"), "text", "lang", "source", F.col("n_chars").cast("long"))


@query("SELECT event_id, event_type, props FROM events")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "json")
    sources.write_json(table(spark, sf_dir, "events").select("event_id", "event_type", "props"), path)
    read = sources.read_json(spark, path, ["event_id", "event_type", "props"])
    return read.select(F.col("event_id").cast("long"), "event_type", "props")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS doc_id, n_name FROM nation")
def ordinal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.with_ids(table(spark, sf_dir, "nation").select("n_name"))


@query(sql.bm25(sql.index("conversations", "(conv_id * 100000 + turn)", ["text", "role"]), sql.asked_rows({"text": "the stupid user of", "role": "the stupid user of"}, {}), k=100))
def save_load_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 100000 + F.col("turn"))
    path = new_folder(spark, "saved")
    SearchIndex.build(rows, ["role", "text"], "id").save(path)
    index = SearchIndex.load(spark, path)
    return rank.bm25(index, rank.queries_of(spark, "the stupid user of", index.fields), k=100)


_NATIONS = "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS doc_id, n_name, n_nationkey::VARCHAR AS n_nationkey FROM nation"


def _nations(spark: SparkSession, sf_dir: str) -> list:
    return table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()


@query(f"SELECT doc_id, n_name AS text FROM ({_NATIONS})")
def memory_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.documents(spark, [r["n_name"] for r in _nations(spark, sf_dir)])


@query(f"SELECT doc_id, n_name AS field0, n_nationkey AS field1 FROM ({_NATIONS})")
def memory_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.documents(spark, [(r["n_name"], r["n_nationkey"]) for r in _nations(spark, sf_dir)])


@query(_NATIONS)
def memory_dicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.documents(spark, [{"n_name": r["n_name"], "n_nationkey": r["n_nationkey"]} for r in _nations(spark, sf_dir)])


@query(_NATIONS)
def memory_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.documents(spark, table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name", "n_nationkey").toPandas())


@query("SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice', 'score']) AS header, unnest(range(7)) AS place")
def file_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = sources.headers(spark, f"{sf_dir}/part.parquet")
    return spark.createDataFrame([(c, i) for i, c in enumerate(names)], "header string, place long")


@query(sql.bm25(_PART, sql.asked_rows(PART, {})))
def bm25_unknown_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that the index doesn't have are left out of a query."""
    index = _part_index(spark, sf_dir)
    return rank.bm25(index, rank.queries_of(spark, {**PART, "p_colour": "blue"}, index.fields, {"p_colour": 5.0}))


_LINES = sql.index("part", "p_partkey", ["p_name"])


@query(f"SELECT p.p_partkey::VARCHAR AS p_partkey, p.p_name, p.p_type, r.rank, r.score FROM ({sql.bm25(_LINES, sql.asked_rows({'p_name': 'blue steel'}, {}), k=None)}) r JOIN part p ON p.p_partkey = r.doc_id")
def json_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of a JSON file that a query finds."""
    path = new_folder(spark, "lines")
    sources.write_json(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), path)
    records = sources.read_json(spark, path, ["p_partkey", "p_name", "p_type"])
    index = SearchIndex.build(records, ["p_name"], "p_partkey").stored()
    found = rank.bm25(index, rank.queries_of(spark, "blue steel", index.fields), k=None)
    return rank.with_records(found.withColumn("doc_id", F.col("doc_id").cast("string")), records, "p_partkey")
