"""DuckDB SQL for the registered queries, and the query texts that both sides use."""

from lodestone.operators.filters import Filters

K = 50
FUSED_QUERY = "licensed under"
_FILTERS = {"candidate": K}
QUERIES = {
    "bm25_and": ("with from", Filters(**_FILTERS)),
    "bm25_or": ("apache OR mit", Filters(**_FILTERS)),
    "bm25_not": ("licensed NOT apache", Filters(**_FILTERS)),
    "bm25_prefix": ("licens*", Filters(**_FILTERS)),
    "bm25_phrase": ('"apache license"', Filters(**_FILTERS)),
    "bm25_repeated": ("license license", Filters(**_FILTERS)),
    "bm25_title_filter": ("title : 7", Filters(**_FILTERS)),
    "bm25_column_set": ("- text : en AND {text title} : license", Filters(**_FILTERS)),
    "fts_near": ("NEAR(licensed license, 4)", Filters(**_FILTERS)),
    "fts_initial_token": ("^the", Filters(**_FILTERS)),
    "bm25_filtered_space": ("licensed", Filters(space_key="fr", **_FILTERS)),
    "bm25_filtered_page": ("the", Filters(page_id="7", **_FILTERS)),
    "bm25_filtered_date": ("licensed", Filters(from_date="2025-03-01", to_date="2025-08-28", **_FILTERS)),
}

_WS = r"\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WS_LINE = _WS.replace(r"\n", "")


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _clean(x: str) -> str:
    end = f"strpos(substr({x}, 5), chr(10) || '---' || chr(10))"
    body = f"CASE WHEN starts_with({x}, '---' || chr(10)) AND {end} > 0 THEN substr({x}, {end} + 9) ELSE {x} END"
    return _trim(f"replace({body}, chr(13) || chr(10), chr(10))")


def _sections(source: str, key: str) -> str:
    """CTEs that end in sections(key, s, text), of source(key, clean)."""
    return f"""lines AS (SELECT {key}, unnest(string_split(clean, chr(10))) AS line, generate_subscripts(string_split(clean, chr(10)), 1) AS i FROM {source}),
numbered AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[{_WS_LINE}]*#') THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY i) AS s FROM lines),
joined AS (SELECT {key}, s, {_trim("string_agg(line, chr(10) ORDER BY i)")} AS text FROM numbered GROUP BY {key}, s),
sections AS (SELECT * FROM joined WHERE text <> '')"""


_CHUNKS = f"""pages AS (
  SELECT CAST(doc_id AS VARCHAR) AS page_id, 'doc ' || doc_id AS title, lang AS space_key,
    '2025-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T' || lpad(CAST(doc_id % 24 AS VARCHAR), 2, '0') || ':00:00Z' AS last_modified_at,
    {_clean("text")} AS clean
  FROM documents),
{_sections("pages", "page_id")},
cut AS (SELECT page_id, s, text, unnest(range(0, CAST(greatest(ceil((length(text) - 1200) / 1000.0), 0) AS BIGINT) + 1)) AS k FROM sections),
trimmed AS (SELECT page_id, s, k, {_trim("substr(text, k * 1000 + 1, 1200)")} AS text FROM cut),
ordered AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY s, k) - 1 AS chunk_index, text FROM trimmed WHERE text <> ''),
chunks AS (SELECT page_id || ':' || lpad(CAST(chunk_index AS VARCHAR), 6, '0') AS id, page_id, chunk_index, text FROM ordered)"""

_WORDS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}\p{{Co}}]+')"
_TOKENS = f"""{_CHUNKS},
columns_ AS (
  SELECT c.id, unnest(['text', 'title', 'page_id', 'space_key']) AS col, unnest([c.text, p.title, p.page_id, p.space_key]) AS x FROM chunks c JOIN pages p USING (page_id)),
words AS (SELECT id, col, {_WORDS.format("x")} AS w FROM columns_),
tok AS (SELECT id, col, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM words),
dl AS (SELECT id, sum(len(w))::BIGINT AS n FROM words GROUP BY id),
total AS (SELECT count(*) AS n_rows, avg(n) AS avg_tokens FROM dl)"""


def _term(condition: str) -> str:
    return f"SELECT id, count(*) AS f FROM tok WHERE {condition} GROUP BY id"


_PHRASE = "SELECT a.id, count(*) AS f FROM tok a JOIN tok b ON a.id = b.id AND a.col = b.col AND b.pos = a.pos + 1 WHERE a.term = '{}' AND b.term = '{}' GROUP BY a.id"


def _near(a: str, b: str, n: int) -> str:
    return f"SELECT id, count(*) AS f FROM tok x WHERE term = '{a}' AND EXISTS (SELECT 1 FROM tok y WHERE y.id = x.id AND y.col = x.col AND y.term = '{b}' AND abs(y.pos - x.pos) - 1 <= {n}) GROUP BY id"


def _bm25(leaves: list[tuple[str, str]], match: str, where: str = "TRUE", name: str = "best") -> str:
    """CTEs that end in best(id, page_id, chunk_index, score). leaves: (rows with f, rows that count for the document frequency)."""
    parts, score, joins, fs = [_TOKENS], [], [], []
    for i, (f, df) in enumerate(leaves):
        parts += [f"l{i} AS ({f})", f"d{i} AS ({df})"]
        idf = f"ln(((SELECT n_rows FROM total) - (SELECT count(*) FROM d{i}) + 0.5) / ((SELECT count(*) FROM d{i}) + 0.5))"
        score.append(f"CASE WHEN f{i} > 0 THEN (CASE WHEN {idf} <= 0 THEN 1e-6 ELSE {idf} END) * (f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / (SELECT avg_tokens FROM total)))) ELSE 0 END")
        joins.append(f"LEFT JOIN l{i} ON l{i}.id = c.id")
        fs.append(f"coalesce(l{i}.f, 0)::DOUBLE AS f{i}")
    parts.append(f"hit AS (SELECT c.id, c.page_id, c.chunk_index, dl.n, p.space_key, p.last_modified_at, {', '.join(fs)} FROM chunks c JOIN pages p USING (page_id) JOIN dl ON dl.id = c.id {' '.join(joins)})")
    parts.append(f"{name} AS (SELECT id, page_id, chunk_index, {' + '.join(score)} AS score FROM hit WHERE ({match}) AND ({where}) ORDER BY score DESC, page_id, chunk_index LIMIT {K})")
    return ",\n".join(parts)


def _same(*leaves: str) -> list[tuple[str, str]]:
    return [(x, x) for x in leaves]


def _bm25_query(*args, **kwargs) -> str:
    return f"WITH {_bm25(*args, **kwargs)}\nSELECT id AS chunk_id, page_id, chunk_index::BIGINT AS chunk_index, round(score, 6) AS score FROM best"


_LICENSED = _term("term = 'licensed'")
_BOTH = "f0 > 0 AND f1 > 0"
_BM25 = {
    "bm25_and": _bm25_query(_same(_term("term = 'with'"), _term("term = 'from'")), _BOTH),
    "bm25_or": _bm25_query(_same(_term("term = 'apache'"), _term("term = 'mit'")), "f0 > 0 OR f1 > 0"),
    "bm25_not": _bm25_query(_same(_LICENSED, _term("term = 'apache'")), "f0 > 0 AND f1 = 0"),
    "bm25_prefix": _bm25_query(_same(_term("starts_with(term, 'licens')")), "f0 > 0"),
    "bm25_phrase": _bm25_query(_same(_PHRASE.format("apache", "license")), "f0 > 0"),
    "bm25_repeated": _bm25_query(_same(_term("term = 'license'"), _term("term = 'license'")), _BOTH),
    "bm25_title_filter": _bm25_query(_same(_term("term = '7' AND col = 'title'")), "f0 > 0"),
    "bm25_column_set": _bm25_query(_same(_term("term = 'en' AND col <> 'text'"), _term("term = 'license' AND col IN ('text', 'title')")), _BOTH),
    "fts_near": _bm25_query([(_near("licensed", "license", 4), _LICENSED), (_near("license", "licensed", 4), _term("term = 'license'"))], _BOTH),
    "fts_initial_token": _bm25_query(_same(_term("term = 'the' AND pos = 0")), "f0 > 0"),
    "bm25_filtered_space": _bm25_query(_same(_LICENSED), "f0 > 0", "space_key = 'fr'"),
    "bm25_filtered_page": _bm25_query(_same(_term("term = 'the'")), "f0 > 0", "page_id = '7'"),
    "bm25_filtered_date": _bm25_query(_same(_LICENSED), "f0 > 0", "last_modified_at >= '2025-03-01' AND last_modified_at <= '2025-08-28T23:59:59Z'"),
}

_VECTOR = "list_transform(range(32), lambda i: (CAST('0x' || substr({}, 2 * i + 1, 2) AS INTEGER)::FLOAT / 255::FLOAT * 2::FLOAT - 1::FLOAT)::FLOAT)"
_LEXICAL = _bm25(_same(_LICENSED, _term("term = 'under'")), _BOTH)
_SIMILAR = f"""hashed AS (SELECT id, page_id, sha256(text) AS h FROM chunks),
near AS (
  SELECT id, page_id, list_cosine_similarity({_VECTOR.format("h")}::DOUBLE[], {_VECTOR.format(f"sha256('{FUSED_QUERY}')")}::DOUBLE[]) AS score
  FROM hashed ORDER BY score DESC, id LIMIT {K})"""


def _norm(table: str) -> str:
    return f"CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END"  # noqa: F541


def _fusion(fused: str, name: str, lexical: bool = True, vector: bool = True) -> str:
    """CTEs that end in ranked(id, page_id, rank, lexical, vector, fused, fusion)."""
    return f"""WITH {_LEXICAL},
{_SIMILAR},
lex AS (SELECT id, page_id, {_norm("best")} AS lexical, row_number() OVER (ORDER BY score DESC, page_id, chunk_index) AS rl FROM best WHERE {lexical}),
vec AS (SELECT id, page_id, {_norm("near")} AS vector, row_number() OVER (ORDER BY score DESC, id) AS rv FROM near WHERE {vector}),
merged AS (SELECT id, coalesce(lex.page_id, vec.page_id) AS page_id, coalesce(lexical, 0)::DOUBLE AS lexical, coalesce(vector, 0)::DOUBLE AS vector, rl, rv FROM lex FULL JOIN vec USING (id)),
fused AS (SELECT *, {fused} AS fused FROM merged),
ranked AS (SELECT *, row_number() OVER (ORDER BY fused DESC, id) AS rank, '{name}' AS fusion FROM fused WHERE fused > 0 QUALIFY rank <= 20)"""


_SHOWN = "\nSELECT id AS chunk_id, page_id, rank, round(lexical, 4) AS lexical, round(vector, 4) AS vector, round(fused, 4) AS fused, fusion FROM ranked"
_WEIGHTED = _fusion("0.7::DOUBLE * lexical + (1 - 0.7::DOUBLE) * vector", "weighted")

_OLD_NEW = """new AS (SELECT CAST(doc_id AS VARCHAR) AS id, sha256(text) AS h FROM documents WHERE lang <> 'de'),
old AS (SELECT CAST(doc_id AS VARCHAR) AS id, sha256(CASE WHEN lang = 'fr' THEN text || '!' ELSE text END) AS h FROM documents WHERE lang <> 'es')"""


def _cosine(where: str) -> str:
    return f"""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 9) AS score
FROM embeddings WHERE {where} ORDER BY score DESC, vec_id LIMIT {K}"""


ORACLES = {
    "clean_content_hash": f"SELECT doc_id, sha256({_clean('text')}) AS content_hash, length({_clean('text')})::BIGINT AS n_clean FROM documents",
    "sections_from_headings": f"""WITH bodies AS (
  SELECT conv_id, string_agg('## turn ' || turn || ' ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn, role, text) AS body FROM conversations GROUP BY conv_id),
cleaned AS (SELECT conv_id, {_clean("body")} AS clean FROM bodies),
{_sections("cleaned", "conv_id")}
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY s) - 1 AS section, sha256(text) AS section_hash FROM sections""",
    "chunk_windows": f"WITH {_CHUNKS}\nSELECT id, page_id AS document_id, chunk_index::BIGINT AS chunk_index, sha256(text) AS chunk_hash, length(text)::BIGINT AS n_chars FROM chunks",
    "term_frequencies": f"WITH {_TOKENS}\nSELECT term, count(*) AS n FROM tok WHERE col = 'text' GROUP BY term",
    "document_frequencies": f"WITH {_TOKENS}\nSELECT term, count(DISTINCT id) AS n_chunks, count(*) AS n_occurrences FROM tok GROUP BY term",
    "corpus_stats": f"WITH {_TOKENS}\nSELECT n_rows, round(avg_tokens, 9) AS avg_tokens FROM total",
    **_BM25,
    "cosine_topk": _cosine("TRUE"),
    "cosine_topk_filtered": _cosine("label = 3"),
    "hash_embedding": f"""WITH h AS (SELECT doc_id, {_VECTOR.format("sha256(text)")} AS v FROM documents),
n AS (SELECT doc_id, v, (1 / sqrt(8 * list_sum(list_transform(v, lambda x: (x * x)::DOUBLE))))::FLOAT AS k FROM h)
SELECT doc_id, round((v[1] * k)::DOUBLE, 5) AS v0, round((v[32] * k)::DOUBLE, 5) AS v31, round((v[5] * k)::DOUBLE, 5) AS v100, round((v[32] * k)::DOUBLE, 5) AS v255, 256::BIGINT AS dimension FROM n""",
    "minmax_lexical": f"WITH {_LEXICAL}\nSELECT id AS chunk_id, round({_norm('best')}, 6)::DOUBLE AS norm FROM best",
    "vector_channel": f"WITH {_CHUNKS},\n{_SIMILAR}\nSELECT id AS chunk_id, round(score, 5) AS score FROM near",
    "fuse_weighted": _WEIGHTED + _SHOWN,
    "fuse_rrf": _fusion("coalesce(1.0::DOUBLE / (60 + rl), 0) + coalesce(1.0::DOUBLE / (60 + rv), 0)", "rrf") + _SHOWN,
    "mode_lexical": _fusion("lexical", "lexical", vector=False) + _SHOWN,
    "mode_vector": _fusion("vector", "vector", lexical=False) + _SHOWN,
    "paged_results": _WEIGHTED + _SHOWN + " WHERE rank > 5 AND rank <= 15",
    "expanded_context": _WEIGHTED
    + f"""
SELECT r.id AS chunk_id, r.rank, sha256(string_agg({_trim("w.text")}, chr(10) || chr(10) ORDER BY w.chunk_index)) AS text_hash,
  min(w.chunk_index)::BIGINT AS context_start, max(w.chunk_index)::BIGINT AS context_end, count(*) AS context_count
FROM ranked r JOIN chunks c ON c.id = r.id JOIN chunks w ON w.page_id = c.page_id AND abs(w.chunk_index - c.chunk_index) <= 1 WHERE r.rank <= 10 GROUP BY r.id, r.rank""",
    "incremental_diff": f"""WITH {_OLD_NEW}
SELECT id, CASE WHEN o.h IS NULL THEN 'inserted' WHEN n.h IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'skipped' ELSE 'updated' END AS status FROM new n FULL JOIN old o USING (id)""",
    "stale_delete": f"WITH {_OLD_NEW}\nSELECT id, id NOT IN (SELECT id FROM new) AS deleted FROM old",
    "merged_documents": f"WITH {_OLD_NEW}\nSELECT id, h AS content_hash FROM new",
    "embedding_upsert": """SELECT CAST(vec_id AS VARCHAR) AS chunk_id, len(embedding)::BIGINT AS dimension, round(CASE WHEN label = 3 THEN -embedding[1] ELSE embedding[1] END::DOUBLE, 6) AS first
FROM embeddings WHERE label <> 4""",
    "index_stats": f"WITH {_CHUNKS}\nSELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM chunks) AS embeddings",
}
