"""SQL of the operators in DuckDB's dialect, put together from common table expressions."""

from __future__ import annotations

from quarry.functions.text import STOP_WORDS

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"
NOT_SKETCH = r"[ .\-/+=&]+"


def upper(x: str) -> str:
    return f"translate(coalesce({x}, ''), '{LOWER}', '{UPPER}')"


def toks(x: str, tokenizer: str = "space") -> str:
    parts = {"space": f"string_split({upper(x)}, ' ')", "alnum": f"string_split_regex({upper(x)}, '{NOT_ALNUM}')", "sketch": f"string_split_regex({upper(x)}, '{NOT_SKETCH}')"}[tokenizer]
    return f"list_filter({parts}, lambda t: t <> '')"


def literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def stop_list() -> str:
    return "(" + ", ".join(literal(w) for w in STOP_WORDS) + ")"


VALID = "(strlen(term) > 1 OR regexp_full_match(term, '[A-Z0-9]'))"


def index(table: str, key: str, fields: list[str], tokenizer: str = "space", stop: bool = False) -> str:
    """parts, occ, postings, dict, stats."""
    parts = " UNION ALL ".join(f"SELECT {key} AS doc_id, '{f}' AS field, {toks(f, tokenizer)} AS toks FROM {table}" for f in fields)
    without = f" AND term NOT IN {stop_list()}" if stop else ""
    return f"""parts AS ({parts}),
lengths AS (SELECT doc_id, field, len(toks) AS dl FROM parts),
occ AS (SELECT doc_id, field, len(toks) AS dl, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM parts),
postings AS (SELECT field, term, doc_id, count(*)::INT AS tf, min(pos)::INT AS first_pos, max(dl) AS dl FROM occ WHERE {VALID}{without} GROUP BY ALL),
dict AS (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL),
stats AS (SELECT field, count(*) AS num_docs, avg(dl) AS avgdl FROM lengths GROUP BY field)"""


def asked_rows(texts: dict[str, str], boosts: dict[str, float]) -> str:
    rows = ", ".join(f"(0::BIGINT, '{f}', {boosts.get(f, 1.0)}::DOUBLE, {literal(t)}, {i})" for i, (f, t) in enumerate(texts.items()))
    return f"queries(query_id, field, boost, text, place) AS (VALUES {rows})"


def asked_table(table: str, key: str, fields: list[str]) -> str:
    rows = " UNION ALL ".join(f"SELECT {key} AS query_id, '{f}' AS field, 1.0::DOUBLE AS boost, text, {i} AS place FROM {table}" for i, f in enumerate(fields))
    return f"queries AS ({rows})"


def terms(stop: bool = False) -> str:
    """known: query tokens in the dictionary; folded: one row for each term."""
    without = f" AND term NOT IN {stop_list()}" if stop else ""
    return f"""exploded AS (SELECT query_id, field, boost, place, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT *, {toks("text")} AS t FROM queries)),
numbered AS (SELECT query_id, field, boost, term, row_number() OVER (PARTITION BY query_id ORDER BY place, pos) - 1 AS q_idx FROM exploded WHERE true{without}),
known AS (SELECT n.*, d.df, s.num_docs, s.avgdl FROM numbered n JOIN dict d USING (field, term) JOIN stats s USING (field)),
folded AS (SELECT query_id, field, term, count(*) AS qtf, max(boost) AS boost, max(df) AS df, max(num_docs) AS num_docs, max(avgdl) AS avgdl, min(q_idx) AS q_idx FROM known GROUP BY ALL)"""


def score(k1: float = 1.2, b: float = 0.4) -> str:
    return f"t.boost * t.qtf * ln((t.num_docs - t.df + 0.5) / (t.df + 0.5)) * (p.tf / (p.tf + {k1} * (1 - {b} + {b} * p.dl / t.avgdl)))"


def ranked(scores: str, k: int | None = 10) -> str:
    limit = "" if k is None else f" WHERE rank <= {k}"
    return f"SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM ({scores})){limit}"


def bm25(index_sql: str, asked: str, k: int | None = 10, where: str = "true", stop: bool = False, k1: float = 1.2, b: float = 0.4) -> str:
    chosen = f"chosen AS (SELECT * FROM (SELECT *, min(df) OVER (PARTITION BY query_id) AS least FROM folded) WHERE {where})"
    sums = f"SELECT t.query_id, p.doc_id, round(sum({score(k1, b)}), 4) AS score FROM chosen t JOIN postings p USING (field, term) GROUP BY ALL"
    return f"WITH {index_sql}, {asked}, {terms(stop)}, {chosen} {ranked(sums, k)}"


def candidates(index_sql: str, asked: str, threshold: float, k: int | None = 10, seeds: int = 1000) -> str:
    return f"""WITH {index_sql}, {asked}, {terms()},
split AS (SELECT *, df > floor({threshold} * num_docs) AS high FROM folded),
parts_ AS (SELECT t.query_id, t.high, p.doc_id, {score()} AS part FROM split t JOIN postings p USING (field, term)),
low AS (SELECT query_id, doc_id FROM parts_ WHERE NOT high GROUP BY ALL),
rarest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY df, q_idx) AS place FROM split WHERE query_id NOT IN (SELECT query_id FROM split WHERE NOT high)) WHERE place = 1),
seeds AS (SELECT query_id, doc_id FROM (SELECT r.query_id, p.doc_id, row_number() OVER (PARTITION BY r.query_id ORDER BY p.tf DESC, p.doc_id DESC) AS place FROM rarest r JOIN postings p USING (field, term)) WHERE place <= {seeds}),
found AS (SELECT * FROM low UNION SELECT * FROM seeds)
{ranked("SELECT query_id, doc_id, round(sum(part), 4) AS score FROM parts_ SEMI JOIN found USING (query_id, doc_id) GROUP BY ALL", k)}"""


def idf_phrase(index_sql: str, asked: str, k: int | None = 10) -> str:
    sums = """SELECT query_id, doc_id, round(sum(weight * CASE WHEN same AND first_pos = last_pos + 1 THEN 1.75 ELSE 1.0 END), 4) AS score FROM (
  SELECT *, lag(first_pos) OVER (PARTITION BY query_id, doc_id ORDER BY q_idx) AS last_pos FROM entered WHERE q_idx >= enter) GROUP BY ALL"""
    return f"""WITH {index_sql}, {asked}, {terms()},
weighted AS (SELECT *, boost * (1 + log2(num_docs / df)) AS weight FROM known),
gated AS (SELECT query_id, field, term, q_idx, weight, coalesce(lag(field) OVER (PARTITION BY query_id ORDER BY q_idx) = field, false) AS same,
  weight < 7.643856189774724 OR weight < 0.4 * sum(weight) OVER (PARTITION BY query_id) / count(*) OVER (PARTITION BY query_id) AS high FROM weighted),
matched AS (SELECT g.*, p.doc_id, p.first_pos FROM gated g JOIN postings p USING (field, term)),
entered AS (SELECT *, min(CASE WHEN NOT high THEN q_idx END) OVER (PARTITION BY query_id, doc_id) AS enter FROM matched)
{ranked(sums, k)}"""
