"""Parts of the registered queries' SQL that several of them share."""

from __future__ import annotations

from loomwright.functions.tokenize import STOP_WORDS

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def token_ctes(name: str, source: str, key: str, text: str) -> str:
    """CTEs that end in `<name>`(key, token, tf)."""
    return f"""
{name}_raw AS (SELECT {key}, unnest(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')) AS raw FROM {source}),
{name}_cut AS (SELECT {key}, lower(raw) AS whole, list_filter(string_split(lower(regexp_replace(regexp_replace(raw,
  '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')), '_'), lambda x: x <> '') AS parts FROM {name}_raw),
{name}_all AS (SELECT {key}, whole AS token FROM {name}_cut
  UNION ALL SELECT {key}, part FROM (SELECT {key}, unnest(parts) AS part FROM {name}_cut WHERE len(parts) > 1) WHERE length(part) > 1),
{name} AS (SELECT {key}, token, count(*) AS tf FROM {name}_all WHERE token NOT IN ({STOP}) GROUP BY {key}, token)"""


def bm25_ctes(name: str, documents: str, key: str, doc_tokens: str, query_tokens: str, query: str = "qid", k: int = 1000) -> str:
    """CTEs that end in `<name>`(query, key, score, rank); documents is the table of all documents."""
    return f"""
{name}_len AS (SELECT {key}, sum(tf) AS len FROM {doc_tokens} GROUP BY {key}),
{name}_df AS (SELECT token, count(*) AS df FROM {doc_tokens} GROUP BY token),
{name}_st AS (SELECT (SELECT count(*) FROM {documents}) AS n, (SELECT sum(len) FROM {name}_len) / (SELECT count(*) FROM {documents}) AS mean),
{name}_w AS (SELECT token, {key}, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / mean)) AS w
  FROM {doc_tokens} JOIN {name}_df USING (token) JOIN {name}_len USING ({key}), {name}_st),
{name}_s AS (SELECT {query}, {key}, round(sum(tf * w), 6) AS score FROM {query_tokens} JOIN {name}_w USING (token) GROUP BY {query}, {key}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {query} ORDER BY score DESC, {key}) AS rank FROM {name}_s WHERE score > 0) WHERE rank <= {k})"""


def hash_ctes(name: str, tokens: str, key: str) -> str:
    """CTEs that end in `<name>`(key, slot, v): sparse unit vectors of hashed tokens."""
    return f"""
{name}_n AS (SELECT {key}, ('0x' || right(md5(token), 2))::INT AS slot, sum(tf) AS n FROM {tokens} GROUP BY ALL),
{name} AS (SELECT {key}, slot, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS v FROM {name}_n)"""


def dense_ctes(name: str, documents: str, key: str, queries: str, doc_vectors: str, query_vectors: str, k: int, query: str = "qid") -> str:
    """CTEs that end in `<name>`(query, key, score, rank) over all documents, those of score 0 included."""
    return f"""
{name}_d AS (SELECT {query}, {key}, sum(a.v * b.v) AS s FROM {query_vectors} a JOIN {doc_vectors} b USING (slot) GROUP BY {query}, {key}),
{name}_s AS (SELECT q.{query}, d.{key}, round(coalesce(s, 0), 6) AS score FROM {queries} q CROSS JOIN {documents} d LEFT JOIN {name}_d x ON x.{query} = q.{query} AND x.{key} = d.{key}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {query} ORDER BY score DESC, {key}) AS rank FROM {name}_s) WHERE rank <= {k})"""


def view_ctes(name: str, source: str, key: str, text: str, drop_numeric: bool) -> str:
    """CTEs that end in `<name>`(key, view): core_view or core2_view of each text."""
    from loomwright.functions.views import DROPPED, KEPT

    dropped, known = (", ".join(f"'{s}'" for s in x) for x in (DROPPED, [*DROPPED, *KEPT]))
    blank = "[\\s\\x0b\\x1c-\\x1f\\x85\\xa0]"
    fence = "'(?s)```[a-zA-Z]*\\n(.*?)```'"
    numeric = "OR (section IS NULL AND regexp_matches(line, '^[\\s\\x0b\\d.,\\-+\\[\\]()]*$'))" if drop_numeric else ""
    return f"""
{name}_l AS (SELECT {key}, unnest(string_split(regexp_replace({text}, {fence}, chr(10), 'g'), chr(10))) AS line,
  generate_subscripts(string_split(regexp_replace({text}, {fence}, chr(10), 'g'), chr(10)), 1) AS pos FROM {source} WHERE {text} IS NOT NULL),
{name}_h AS (SELECT *, lower(trim(regexp_extract(line, '^[\\s\\x0b]*[-#*=_~`]*[\\s\\x0b]*([A-Za-z][A-Za-z /]{{0,28}}?)[\\s\\x0b]*\\d*[\\s\\x0b]*[:#*=_~`-]*[\\s\\x0b]*$', 1))) AS head FROM {name}_l),
{name}_s AS (SELECT *, CASE WHEN head IN ({known}) THEN head END AS section FROM {name}_h),
{name}_g AS (SELECT *, coalesce(last_value(section IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY pos) IN ({dropped}), false) AS dropping FROM {name}_s),
{name}_c AS (SELECT {key}, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT (dropping {numeric})), '') AS body FROM {name}_g GROUP BY {key}),
{name}_f AS (SELECT {key}, array_to_string(list_filter(list_transform(regexp_extract_all({text}, {fence}, 1), lambda b: regexp_replace(b, '^{blank}+|{blank}+$', '', 'g')), lambda b: b <> ''), chr(10)) AS starter FROM {source}),
{name}_b AS (SELECT {key}, regexp_replace(regexp_replace(body, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{blank}+|{blank}+$', '', 'g') AS core, starter FROM {name}_c JOIN {name}_f USING ({key})),
{name} AS (SELECT {key}, CASE WHEN starter <> '' THEN regexp_replace(core || chr(10) || chr(10) || starter, '^{blank}+|{blank}+$', '', 'g') ELSE core END AS view FROM {name}_b)"""
