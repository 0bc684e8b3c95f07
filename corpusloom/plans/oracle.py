"""The same questions in plain SQL, for checking the Spark answers."""

from __future__ import annotations

from corpusloom.functions.text import ENGLISH_STOP_WORDS, NON_WORD, WHITESPACE
from corpusloom.plans.source_samples import KEY, SAMPLES, UNSUPPORTED
from corpusloom.sources.files import IGNORED_DIRS, LANGUAGE_OF_EXTENSION

DIM = 64
K = 10


def _ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def tokens(text: str) -> str:
    return (
        f"list_filter(string_split_regex(lower({text}), '{WHITESPACE}+'), lambda x: x <> '')"
    )


def _stop_list() -> str:
    return "[" + ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS) + "]"


def words(text: str) -> str:
    return (
        f"list_filter(string_split_regex(lower({text}), '{NON_WORD}+'), "
        f"lambda x: length(x) > 1 AND NOT list_contains({_stop_list()}, x))"
    )


def grams_cte(name: str, source: str, key: str, text: str) -> list[str]:
    """Token lists first, so each list is built once."""
    return [
        f"{name}_w AS (SELECT {key}, {words(text)} AS w FROM {source})",
        f"{name} AS (SELECT {key}, unnest(list_concat(w, list_transform("
        f"range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term "
        f"FROM {name}_w)",
    ]


def bag_cte(name: str, source: str, key: str, text: str, dim: int = DIM) -> list[str]:
    """Hashed bag of words as one double list per row, from grouped counts."""
    return [
        f"{name}_t AS (SELECT {key}, unnest({tokens(text)}) AS t FROM {source})",
        f"{name}_c AS (SELECT {key}, ('0x' || substr(md5(t), 1, 6))::INT % {dim} AS b, "
        f"count(*)::DOUBLE AS n FROM {name}_t GROUP BY ALL)",
        f"{name} AS (SELECT s.{key}, list(coalesce(c.n, 0.0) ORDER BY r.b) AS v "
        f"FROM (SELECT {key} FROM {source}) s CROSS JOIN (SELECT unnest(range(0, {dim})) AS b) r "
        f"LEFT JOIN {name}_c c ON c.{key} = s.{key} AND c.b = r.b GROUP BY s.{key})",
    ]


N_DOCS = "n AS (SELECT count(*)::DOUBLE AS n FROM documents)"

BM25_STATS = [
    f"tok AS (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents)",
    "tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)",
    N_DOCS,
    "st AS MATERIALIZED (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term)",
    "raw AS MATERIALIZED (SELECT term, df, cf, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM st, n)",
    "whole AS MATERIALIZED (SELECT avg(raw) AS mean_idf, sum(cf) AS total FROM raw)",
    "idf AS (SELECT term, df, cf, CASE WHEN raw < 0 THEN 0.25 * mean_idf ELSE raw END AS idf, "
    "total / n AS avgdl FROM raw, whole, n)",
]

BM25_SCORES = BM25_STATS + [
    "dl AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY doc_id)",
    f"qtok AS (SELECT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark)",
    "qtf AS (SELECT query_id, term, count(*) AS qtf FROM qtok GROUP BY ALL)",
    "bm AS (SELECT q.query_id, tf.doc_id, sum(q.qtf * i.idf * tf.tf * 2.5 / "
    "(tf.tf + 1.5 * (1 - 0.75 + 0.75 * dl.dl / i.avgdl))) AS s "
    "FROM qtf q JOIN tf USING (term) JOIN idf i USING (term) "
    "JOIN dl ON dl.doc_id = tf.doc_id GROUP BY ALL)",
]

TFIDF_VOCAB = [
    *grams_cte("gram", "documents", "doc_id", "text"),
    "gtf AS (SELECT doc_id, term, count(*) AS tf FROM gram GROUP BY ALL)",
    "gst AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM gtf GROUP BY term)",
    "vocab AS (SELECT term, df, cf, ln((1 + n) / (1 + df)) + 1 AS idf "
    "FROM gst, (SELECT count(*)::DOUBLE AS n FROM documents) "
    "WHERE df >= 2 AND df <= 0.8 * n ORDER BY cf DESC, term LIMIT 10000)",
]

TFIDF_WEIGHTS = TFIDF_VOCAB + [
    "dw AS (SELECT doc_id, term, tf * idf AS w FROM gtf JOIN vocab USING (term))",
    "dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY doc_id)",
]

TFIDF_SCORES = TFIDF_WEIGHTS + [
    *grams_cte("qgram", "benchmark", "item_id", "text"),
    "qw AS (SELECT item_id AS query_id, term, count(*) * idf AS w "
    "FROM qgram JOIN vocab USING (term) GROUP BY item_id, term, idf)",
    "qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY query_id)",
    "ti AS (SELECT qw.query_id, dw.doc_id, sum(qw.w * dw.w) / (qn.norm * dn.norm) AS s "
    "FROM qw JOIN dw USING (term) JOIN qn ON qn.query_id = qw.query_id "
    "JOIN dn ON dn.doc_id = dw.doc_id GROUP BY qw.query_id, dw.doc_id, qn.norm, dn.norm)",
]

DOC_BAGS = bag_cte("db", "documents", "doc_id", "text")
QUERY_BAGS = bag_cte("qb", "benchmark", "item_id", "text")

# Cosine of two lists with the zero-length rule.
COSINE = (
    "CASE WHEN list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN 0.0 "
    "ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * "
    "sqrt(list_dot_product({b}, {b}))) END"
)

ALL_PAIRS = "pairs AS (SELECT item_id AS query_id, doc_id FROM benchmark, documents)"


def ranked(scores: str, key: str = "doc_id", order: str = "DESC", extra: str = "", k: int = K) -> str:
    """Top k per query of ``(query_id, key, score)`` rows."""
    return (
        f"SELECT query_id, rank, {key}, score{extra} FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY query_id ORDER BY score {order}, {key})::INT AS rank FROM ({scores})) "
        f"WHERE rank <= {k}"
    )


def lexical_topk(ctes: list[str], scores: str) -> str:
    return (
        _ctes(*ctes, ALL_PAIRS)
        + "\n"
        + ranked(
            "SELECT p.query_id, p.doc_id, round(coalesce(s.s, 0), 6) AS score FROM pairs p "
            f"LEFT JOIN {scores} s ON s.query_id = p.query_id AND s.doc_id = p.doc_id"
        )
    )


LABEL_MEANS = [
    "lv AS (SELECT label, unnest(range(0, 64)) AS p, embedding FROM embeddings)",
    "lm AS (SELECT label, p, avg(embedding[p + 1]::DOUBLE) AS m FROM lv GROUP BY ALL)",
    "q AS (SELECT label::BIGINT AS query_id, list(m ORDER BY p) AS v FROM lm GROUP BY label)",
    "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)",
]


def vector_topk(expr: str, order: str) -> str:
    return (
        _ctes(*LABEL_MEANS)
        + "\n"
        + ranked(
            f"SELECT query_id, vec_id, round({expr}, 6) + 0.0 AS score FROM q, e", "vec_id", order
        )
    )


SENTENCES = (
    "string_split(regexp_replace(text, '([.?!])" + WHITESPACE + "+', '\\1' || chr(1), 'g'), chr(1))"
)

SEMANTIC_CHUNKS = _ctes(
    f"s AS (SELECT doc_id, source, generate_subscripts(l, 1) AS pos, unnest(l) AS sent "
    f"FROM (SELECT doc_id, source, {SENTENCES} AS l FROM documents))",
    "near AS (SELECT s.doc_id, s.pos, n.sent FROM s JOIN s n ON n.doc_id = s.doc_id "
    "AND n.pos BETWEEN s.pos - 1 AND s.pos + 1)",
    f"tk AS (SELECT doc_id, pos, unnest({tokens('sent')}) AS t FROM near)",
    f"bc AS (SELECT doc_id, pos, ('0x' || substr(md5(t), 1, 6))::INT % {DIM} AS b, "
    "count(*)::DOUBLE AS n FROM tk GROUP BY ALL)",
    "nn AS (SELECT doc_id, pos, sqrt(sum(n * n)) AS norm FROM bc GROUP BY ALL)",
    "dt AS (SELECT a.doc_id, a.pos, sum(a.n * b.n) AS dot FROM bc a JOIN bc b "
    "ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 AND b.b = a.b GROUP BY ALL)",
    "gap AS (SELECT s.doc_id, s.pos, round(1 - coalesce(dt.dot / (n1.norm * n2.norm), 0.0), 9) AS d "
    "FROM s JOIN s nx ON nx.doc_id = s.doc_id AND nx.pos = s.pos + 1 "
    "LEFT JOIN dt ON dt.doc_id = s.doc_id AND dt.pos = s.pos "
    "LEFT JOIN nn n1 ON n1.doc_id = s.doc_id AND n1.pos = s.pos "
    "LEFT JOIN nn n2 ON n2.doc_id = s.doc_id AND n2.pos = s.pos + 1)",
    "lim AS (SELECT doc_id, quantile_cont(d, 0.95) AS lim FROM gap GROUP BY doc_id)",
    "brk AS (SELECT gap.doc_id, gap.pos + 1 AS pos FROM gap JOIN lim USING (doc_id) "
    "WHERE d > lim + 1e-9)",
    "num AS (SELECT s.*, sum(CASE WHEN brk.pos IS NULL THEN 0 ELSE 1 END) OVER "
    "(PARTITION BY s.doc_id ORDER BY s.pos) AS chunk_no FROM s LEFT JOIN brk "
    "ON brk.doc_id = s.doc_id AND brk.pos = s.pos)",
) + (
    "\nSELECT doc_id, source, chunk_no::INT AS chunk_no, string_agg(sent, ' ' ORDER BY pos) AS content "
    "FROM num GROUP BY ALL"
)

HYBRID = (
    _ctes(
        *BM25_SCORES,
        *TFIDF_SCORES,
        *DOC_BAGS,
        *QUERY_BAGS,
        "vs AS (SELECT qb.item_id AS query_id, db.doc_id, "
        + COSINE.format(a="qb.v", b="db.v")
        + " AS s FROM qb, db)",
        "allm AS (SELECT vs.query_id, vs.doc_id, vs.s AS v, coalesce(ti.s, 0) AS t, "
        "coalesce(bm.s, 0) AS b FROM vs "
        "LEFT JOIN ti ON ti.query_id = vs.query_id AND ti.doc_id = vs.doc_id "
        "LEFT JOIN bm ON bm.query_id = vs.query_id AND bm.doc_id = vs.doc_id)",
        "mx AS (SELECT query_id, max(v) AS v, max(t) AS t, max(b) AS b FROM allm GROUP BY query_id)",
        "fused AS (SELECT a.query_id, a.doc_id, round("
        "0.5 * a.v / CASE WHEN mx.v > 0 THEN mx.v ELSE 1 END + "
        "0.2 * a.t / CASE WHEN mx.t > 0 THEN mx.t ELSE 1 END + "
        "0.3 * a.b / CASE WHEN mx.b > 0 THEN mx.b ELSE 1 END, 6) AS score, "
        "round(a.v, 6) AS vector_score, round(a.t, 6) AS tfidf_score, "
        "round(a.b, 6) AS bm25_score FROM allm a JOIN mx USING (query_id))",
    )
    + "\n"
    + ranked("SELECT * FROM fused", extra=", vector_score, tfidf_score, bm25_score")
)

# --- search and answers ---------------------------------------------------

NEAREST = [
    *DOC_BAGS,
    *QUERY_BAGS,
    "near AS (SELECT query_id, doc_id, dist, row_number() OVER "
    "(PARTITION BY query_id ORDER BY dist, doc_id) AS rank FROM "
    "(SELECT qb.item_id AS query_id, db.doc_id, list_dot_product(qb.v, qb.v) - "
    "2 * list_dot_product(qb.v, db.v) + list_dot_product(db.v, db.v) AS dist FROM qb, db))",
]


def coverage(query: str, content: str) -> str:
    q, c = f"list_distinct({tokens(query)})", tokens(content)
    return (
        f"CASE WHEN len({q}) = 0 THEN 0.0 ELSE "
        f"len(list_filter({q}, lambda w: list_contains({c}, w)))::DOUBLE / len({q}) END"
    )


def reranked(candidates: str, fetch: int = 20, k: int = 5) -> str:
    """CTE body: the second stage over ``(query_id, doc_id, rank)`` rows."""
    return (
        "SELECT * FROM (SELECT query_id, doc_id, score, content, source, row_number() OVER "
        "(PARTITION BY query_id ORDER BY score DESC, first_rank)::INT AS rank FROM "
        "(SELECT c.query_id, c.doc_id, c.rank AS first_rank, d.text AS content, d.source, "
        f"round({coverage('b.text', 'd.text')}, 6) AS score FROM {candidates} c "
        "JOIN documents d ON d.doc_id = c.doc_id JOIN benchmark b ON b.item_id = c.query_id "
        f"WHERE c.rank <= {fetch})) WHERE rank <= {k}"
    )




def _two_stage_of(candidates: str) -> str:
    """The best of four times as many candidates by coverage, then by their rank."""
    return (
        f"WITH cand AS ({candidates.replace(f'rank <= {K}', 'rank <= 20')}),\n"
        f"c AS (SELECT query_id, doc_id, cand.rank AS first, round({coverage('b.text', 'd.text')}, 6) AS score "
        "FROM cand JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id)\n"
        "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first)::INT AS rank, "
        "doc_id, score FROM c QUALIFY rank <= 5"
    )


TWO_STAGE = [*NEAREST, "hit AS (" + reranked("near") + ")"]

_PROMPT_HEAD = (
    "1. Use the following pieces of context to answer the question at the end.\n"
    "2. If you don''t know the answer, say \"I don''t know\".\n"
    "3. Keep the answer crisp (3-4 sentences).\n\nContext: "
)

CONVERSATIONS = "turns AS (SELECT *, conv_id || '-' || turn AS query_id FROM conversations)"

# --- events ---------------------------------------------------------------

FILE_EVENTS = (
    "fe AS (SELECT * FROM (SELECT event_id, ts, user_id, event_type AS kind, "
    "CASE WHEN op % 2 = 1 THEN 'CREATE' WHEN (op // 2) % 2 = 1 THEN 'WRITE' "
    "WHEN (op // 4) % 2 = 1 THEN 'REMOVE' WHEN (op // 8) % 2 = 1 THEN 'RENAME' END AS event_type "
    "FROM (SELECT *, [1, 2, 4, 8, 3, 12, 16][event_id % 7 + 1] AS op FROM events)) "
    "WHERE event_type IS NOT NULL)"
)

def _listing(name: str, until: str) -> str:
    return (
        f"{name} AS (SELECT root, path, mtime FROM (SELECT user_id AS root, kind AS path, "
        "max(ts) AS mtime, arg_max(event_type, (ts, event_id)) AS last FROM fe "
        f"{until} GROUP BY ALL) WHERE last NOT IN ('REMOVE', 'RENAME'))"
    )


SNAPSHOTS = [
    FILE_EVENTS,
    _listing("before", "WHERE ts < TIMESTAMP '2024-01-16'"),
    _listing("now", ""),
]

# --- paths ----------------------------------------------------------------


def _sql_list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


_EXTENSIONS = [*LANGUAGE_OF_EXTENSION, ".PY", ".txt", "", ".Pdf", ".pdf"]
_DIRS = ["src", "lib/core", "node_modules/x", ".hidden", "build", "_private"]
PATHS = (
    f"paths AS (SELECT doc_id, source || '/' || {_sql_list(_DIRS)}[doc_id % {len(_DIRS)} + 1] || '/' || "
    "CASE doc_id % 5 WHEN 0 THEN '.' WHEN 1 THEN '_' ELSE '' END || 'f' || doc_id || "
    f"{_sql_list(_EXTENSIONS)}[doc_id % {len(_EXTENSIONS)} + 1] AS path FROM documents)"
)
EXTENSION = (
    "lower(regexp_extract(regexp_replace(regexp_extract(path, '[^/]*$'), '^\\.+', ''), "
    "'(\\.[^.]*)$', 1))"
)
LANGUAGE = (
    f"CASE {EXTENSION} "
    + " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in LANGUAGE_OF_EXTENSION.items())
    + " END"
)

# --- generated source files -----------------------------------------------

_STEPS = "(SELECT p_partkey AS k, p_size AS n, p_name, unnest(range(1, p_size + 1)) AS i FROM part)"


def _definitions(kind: int, ext: str, lang: str, rows: str) -> str:
    """Rows of one language: ``rows`` yields name, type, class, lines, text."""
    return (
        f"SELECT 'part/' || k || '{ext}' AS source, '{lang}' AS language, * EXCLUDE (k) "
        f"FROM ({rows}) WHERE k % 5 = {kind}"
    )


_COLS = "{name} AS symbol_name, {type} AS symbol_type, {cls} AS class_name, {s}::INT AS start_line, {e}::INT AS end_line, {text} AS content"


def _row(table: str, **c: str) -> str:
    return "SELECT k, " + _COLS.format(**c) + f" FROM {table}"


_PARTS = "(SELECT p_partkey AS k, p_size AS n, p_name FROM part)"
CODE_DEFINITIONS = " UNION ALL ".join(
    [
        _definitions(0, ".py", "python", " UNION ALL ".join([
            _row(_PARTS, name="'Part' || k", type="'class'", cls="NULL", s="1", e="3 * n + 2",
                 text="'class Part' || k || ':'"),
            _row(_STEPS, name="'step_' || i", type="'method'", cls="'Part' || k", s="3 * i + 1",
                 e="3 * i + 2", text="'def step_' || i || E'(self):\n        return ' || i"),
            _row(_PARTS, name="'make_' || k", type="'function'", cls="NULL", s="3 * n + 5",
                 e="3 * n + 6", text="'def make_' || k || E'(x):\n    return Part' || k || '()'"),
        ])),
        _definitions(1, ".go", "go", " UNION ALL ".join([
            _row(_PARTS, name="'Part' || k", type="'type'", cls="NULL", s="3", e="5",
                 text="'type Part' || k || E' struct {\n\tName string\n}'"),
            _row(_STEPS, name="'Step' || i", type="'method'", cls="'Part' || k", s="7 * i",
                 e="7 * i + 5", text="'func (p *Part' || k || ') Step' || i || "
                 "E'() int {\n\tif p == nil {\n\t\treturn 0\n\t}\n\treturn ' || i || E'\n}'"),
        ])),
        _definitions(2, ".java", "java", " UNION ALL ".join([
            _row(_PARTS, name="'Part' || k", type="'class'", cls="NULL", s="1", e="3 * n + 2",
                 text="'class Part' || k"),
            _row(_STEPS, name="'step' || i", type="'method'", cls="'Part' || k", s="3 * i - 1",
                 e="3 * i + 1", text="'int step' || i || E'() {\n        return ' || i || E';\n    }'"),
        ])),
        _definitions(3, ".rb", "ruby", " UNION ALL ".join([
            _row(_PARTS, name="'Part' || k", type="'class'", cls="NULL", s="1", e="3 * n + 2",
                 text="'class Part' || k"),
            _row(_STEPS, name="'step_' || i", type="'method'", cls="'Part' || k", s="3 * i - 1",
                 e="3 * i + 1", text="'def step_' || i || E'\n    ' || i || E'\n  end'"),
        ])),
        _definitions(4, ".py", "python",
            _row(_PARTS, name="NULL", type="'module'", cls="NULL", s="1", e="2",
                 text="'x = ' || k || E'\n'")),
    ]
)



def _text(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _samples() -> str:
    """The definitions written beside the samples, for every part."""
    rows = [
        (i, s.language, s.extension, s.language, *d[:5], s.content(d), None)
        for i, s in enumerate(SAMPLES)
        for d in s.definitions
    ]
    rows.append(
        (len(SAMPLES), "other", ".cob", "cobol", *[None] * 5, UNSUPPORTED, "unsupported language: cobol")
    )
    values = ", ".join(f"({', '.join(map(_text, r))})" for r in rows)
    filled = lambda c: f"replace({c}, '{KEY}', p_partkey::VARCHAR) AS {c}"
    return (
        "SELECT dir || '/' || p_partkey || ext AS source, language, "
        + ", ".join(filled(c) for c in ("symbol_name", "symbol_type", "class_name", "content"))
        + ", start_line::INT AS start_line, end_line::INT AS end_line, error FROM part JOIN (VALUES "
        + values
        + ") v(kind, dir, ext, language, symbol_name, symbol_type, class_name, start_line, end_line, content, error) "
        + f"ON p_partkey % {len(SAMPLES) + 1} = kind"
    )


TOPIC_TOKENS = (
    f"list_filter(string_split_regex(lower(text), '{WHITESPACE}+'), "
    "lambda w: length(w) > 3 AND regexp_full_match(w, '\\p{L}+'))"
)

# --- recursive split ------------------------------------------------------


def _cut(name: str, source: str, keys: str, sep: str, size: int) -> list[str]:
    """Pieces of the texts ``t`` of ``source``, cut at ``sep``; a piece is fresh
    when it is the first or follows one that is too long."""
    pos = f"{name}_i"
    split = "string_split(t, '')" if sep == "" else f"string_split(t, {sep})"
    glue = "p" if sep == "" else f"CASE WHEN {pos} = 1 THEN p ELSE {sep} || p END"
    return [
        f"{name}_a AS (SELECT {keys}, generate_subscripts(l, 1) AS {pos}, unnest(l) AS p "
        f"FROM (SELECT {keys}, {split} AS l FROM {source}))",
        f"{name}_b AS (SELECT * FROM (SELECT {keys}, {pos}, {glue} AS t FROM {name}_a) "
        "WHERE length(t) > 0)",
        f"{name} AS (SELECT *, coalesce(lag(length(t)) OVER (PARTITION BY {keys} ORDER BY {pos}) "
        f">= {size}, true) AS fresh FROM {name}_b)",
    ]


def recursive_split(size: int, overlap: int) -> str:
    keys = ["doc_id", "a_i", "b_i", "c_i", "d_i"]
    seps = ["E'\\n\\n'", "E'\\n'", "' '", ""]
    ctes = [f"src AS (SELECT doc_id, text AS t FROM documents WHERE length(text) > {size} "
            f"AND regexp_matches(text, '{WHITESPACE.replace('[', '[^', 1)}'))"]  # fmt: skip
    source, done = "src", []
    for level, sep in enumerate(seps):
        name = "abcd"[level]
        ctes += _cut(name, source, ", ".join(keys[: level + 1]), sep, size)
        filled = ", ".join(
            k if j <= level + 1 else f"0 AS {k}" for j, k in enumerate(keys)
        )
        done.append(f"SELECT {filled}, length(t) AS len, fresh FROM {name} WHERE length(t) < {size}")
        ctes.append(f"{name}_long AS (SELECT * FROM {name} WHERE length(t) >= {size})")
        source = f"{name}_long"
    state = (
        "{'done': []::STRUCT(s INT, e INT)[], 'open': []::INT[], 'end': 0::INT, "
        "'len': {len}::INT, 'fresh': {fresh}}"
    )
    ctes.append("pieces AS (" + " UNION ALL ".join(done) + ")")
    ctes.append(
        "lists AS (SELECT doc_id, list("
        + state.replace("{len}", "len").replace("{fresh}", "fresh")
        + " ORDER BY a_i, b_i, c_i, d_i) AS l FROM pieces GROUP BY doc_id)"
    )
    full = (
        f"(len(a.open) > 0 AND (x.fresh OR a.end + x.len - a.open[1] > {size}))"
    )
    carried = (
        "CASE WHEN x.fresh THEN []::INT[] ELSE list_filter(a.open, lambda s: "
        f"a.end - s <= {overlap} AND a.end + x.len - s <= {size}) END"
    )
    closed = "list_append(a.done, {'s': a.open[1], 'e': a.end})"
    ctes.append(
        "folded AS (SELECT doc_id, list_reduce(l, lambda a, x: {"
        f"'done': CASE WHEN {full} THEN {closed} ELSE a.done END, "
        f"'open': list_append(CASE WHEN {full} THEN {carried} ELSE a.open END, a.end), "
        "'end': a.end + x.len, 'len': 0::INT, 'fresh': false}, "
        + state.replace("{len}", "0").replace("{fresh}", "false")
        + ") AS r FROM lists)"
    )
    ctes.append(
        "spans AS (SELECT doc_id, list_append(r.done, {'s': r.open[1], 'e': r.end}) AS l FROM folded)"
    )
    ctes.append(
        "texts AS (SELECT f.doc_id, list_filter(list_transform(f.l, lambda z: regexp_replace("
        f"substring(d.text, z.s + 1, z.e - z.s), '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g')), "
        "lambda c: length(c) > 0) AS l FROM spans f JOIN documents d USING (doc_id))"
    )
    return (
        _ctes(*ctes)
        + "\nSELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS chunk_no, 'block' AS symbol_type, "
        "NULL::INT AS start_line, NULL::INT AS end_line, unnest(l) AS chunk FROM texts UNION ALL "
        "SELECT doc_id, 0, 'module', 1, (length(text) - length(replace(text, E'\\n', '')) + 1)::INT, text "
        f"FROM documents WHERE length(text) <= {size} "
        f"AND regexp_matches(text, '{WHITESPACE.replace('[', '[^', 1)}')"
    )


ORACLE: dict[str, str] = {
    "bm25_stats": _ctes(*BM25_STATS) + "\nSELECT term, df, cf, round(idf, 6) AS idf FROM idf",
    "bm25_topk": lexical_topk(BM25_SCORES, "bm"),
    "bm25_index_topk": lexical_topk(BM25_SCORES, "bm"),
    "bm25_stats_after_events": (
        _ctes(*BM25_STATS) + "\nSELECT term, df, cf, round(idf, 6) AS idf FROM idf"
    ).replace("FROM documents", "FROM documents WHERE doc_id % 5 <> 0"),
    "tfidf_vocabulary": _ctes(*TFIDF_VOCAB)
    + "\nSELECT term, df, cf, round(idf, 6) AS idf FROM vocab",
    "tfidf_fit": _ctes(*TFIDF_WEIGHTS)
    + "\nSELECT doc_id, term, round(w / norm, 6) AS weight FROM dw JOIN dn USING (doc_id)",
    "tfidf_topk": lexical_topk(TFIDF_SCORES, "ti"),
    "sentence_split": f"SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS sentence "
    f"FROM (SELECT doc_id, {SENTENCES} AS l FROM documents)",
    "semantic_chunks": SEMANTIC_CHUNKS,
    "hashed_embeddings": _ctes(*DOC_BAGS)
    + "\nSELECT doc_id, array_to_string(list_transform(v, lambda x: x::INT), ',') AS counts FROM db",
    "l2_normalised": "SELECT vec_id, (generate_subscripts(v, 1) - 1)::INT AS pos, "
    "round(unnest(v) / sqrt(list_dot_product(v, v)), 6) + 0.0 AS x "
    "FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)",
    **dict.fromkeys(
        ("vector_l2_topk", "vector_index_topk"),
        vector_topk(
            "list_sum(list_transform(list_zip(q.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))",
            "ASC",
        ),
    ),
    **dict.fromkeys(
        ("vector_cosine_topk", "vector_index_cosine"), vector_topk(COSINE.format(a="q.v", b="e.v"), "DESC")
    ),
    "hybrid_topk": HYBRID,
    "hybrid_stored_topk": HYBRID,
    "hybrid_two_stage": _two_stage_of(HYBRID),
    "hybrid_without_bm25": HYBRID.replace("0.5 * a.v", "0.5 / 0.7 * a.v")
    .replace("0.2 * a.t", "0.2 / 0.7 * a.t")
    .replace("0.3 * a.b", "0.0 * a.b")
    .replace(", tfidf_score, bm25_score FROM (SELECT *, row", ", tfidf_score FROM (SELECT *, row"),
    "raw_search": _ctes(*NEAREST)
    + "\nSELECT n.query_id, n.rank::INT AS rank, n.doc_id AS chunk_id, d.text AS content, d.source, "
    "round(n.dist, 6) AS score, 'distance' AS score_kind, d.lang, d.n_chars FROM near n "
    "JOIN documents d USING (doc_id) "
    "WHERE n.rank <= CASE WHEN n.query_id % 4 > 0 THEN n.query_id % 4 ELSE 5 END",
    "two_stage_search": _ctes(*TWO_STAGE)
    + "\nSELECT query_id, rank, doc_id AS chunk_id, source, score, 'relevance' AS score_kind FROM hit",
    "rerank_topk": _ctes(
        *BM25_SCORES,
        ALL_PAIRS,
        "cand AS ("
        + ranked(
            "SELECT p.query_id, p.doc_id, round(coalesce(bm.s, 0), 6) AS score FROM pairs p "
            "LEFT JOIN bm ON bm.query_id = p.query_id AND bm.doc_id = p.doc_id",
            k=20,
        )
        + ")",
    )
    + "\nSELECT query_id, rank, doc_id, score FROM ("
    + reranked("cand")
    + ")",
    "prompt_context": _ctes(*TWO_STAGE)
    + f"\nSELECT b.item_id AS query_id, '{_PROMPT_HEAD}' || coalesce(string_agg("
    "E'Context:\\ncontent:' || h.content || E'\\nsource:' || h.source, E'\\n\\n' ORDER BY h.rank), '') "
    "|| E'\\n\\nQuestion: ' || b.text || E'\\n\\nHelpful Answer:' AS prompt "
    "FROM benchmark b LEFT JOIN hit h ON h.query_id = b.item_id GROUP BY b.item_id, b.text",
    "grounding_check": _ctes(
        CONVERSATIONS,
        "asked AS (SELECT a.query_id, t.text FROM turns a JOIN turns t ON t.conv_id = a.conv_id "
        "AND t.turn = a.turn - 1 WHERE a.role = 'assistant')",
        "said AS (SELECT query_id, text FROM turns WHERE role = 'assistant' AND text <> '')",
        *DOC_BAGS,
        *bag_cte("qb", "asked", "query_id", "text"),
        *bag_cte("ab", "said", "query_id", "text"),
        "near AS (SELECT qb.query_id, db.doc_id, db.v FROM qb, db QUALIFY row_number() OVER (PARTITION BY "
        "qb.query_id ORDER BY list_dot_product(qb.v, qb.v) - 2 * list_dot_product(qb.v, db.v) + "
        "list_dot_product(db.v, db.v), db.doc_id) <= 5)",
        "sc AS (SELECT ab.query_id, max("
        + COSINE.format(a="ab.v", b="near.v")
        + ") AS s FROM ab JOIN near USING (query_id) GROUP BY ALL)",
    )
    + "\nSELECT a.query_id, s < 0.5 AS is_hallucination, round(s, 6) AS score, "
    "'embedding_similarity' AS method FROM turns a LEFT JOIN sc USING (query_id) "
    "WHERE a.role = 'assistant'",
    "answer_fallback": _ctes(CONVERSATIONS)
    + "\nSELECT u.query_id, coalesce(a.text, 'I don''t know') AS result, "
    "CASE WHEN a.text IS NULL THEN 'no answer' END AS error FROM turns u "
    "LEFT JOIN turns a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' "
    "WHERE u.role = 'user'",
    "event_kinds": _ctes(FILE_EVENTS) + "\nSELECT event_id, event_type FROM fe",
    "apply_events": _ctes(
        FILE_EVENTS,
        "last AS (SELECT path, arg_max(event_type, (ts, event_id)) AS event_type FROM "
        "(SELECT 'src' || (user_id % 15) AS path, * FROM fe) GROUP BY path)",
    )
    + "\nSELECT source, doc_id AS chunk_id, md5(text) AS digest FROM documents d "
    "WHERE NOT EXISTS (SELECT 1 FROM last WHERE last.path = d.source) UNION ALL "
    "SELECT source, -doc_id - 1, md5('v2 ' || text) FROM documents d "
    "WHERE EXISTS (SELECT 1 FROM last WHERE last.path = d.source AND event_type IN ('CREATE', 'WRITE'))",
    "delete_by_source": "SELECT source, doc_id AS chunk_id FROM documents "
    "WHERE source IS DISTINCT FROM 'src7'",
    "debounce_last_event": _ctes(
        FILE_EVENTS,
        "o AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new "
        "FROM fe WINDOW w AS (PARTITION BY user_id ORDER BY ts))",
        "s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM o)",
        "st AS (SELECT *, min(ts) OVER (PARTITION BY user_id, no) AS session_start FROM s)",
    )
    + "\nSELECT 'u' || user_id AS root, session_start, kind AS path, "
    "arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts "
    "FROM st GROUP BY user_id, session_start, kind",
    "snapshot_diff": _ctes(*SNAPSHOTS)
    + "\nSELECT now.root, now.path, now.mtime, CASE WHEN before.mtime IS NULL THEN 'new' ELSE 'updated' END "
    "AS change FROM now LEFT JOIN before USING (root, path) "
    "WHERE (before.mtime IS NULL OR before.mtime < now.mtime) "
    "AND now.root IN (SELECT root FROM before)",
    "dispatch_changed": _ctes(*SNAPSHOTS)
    + "\nSELECT coalesce(now.root, before.root) AS root, "
    "coalesce(now.root, before.root) || '/' || coalesce(now.path, before.path) AS path, "
    "CASE WHEN now.mtime IS NULL THEN 'deleted' WHEN before.mtime IS NULL THEN 'new' "
    "ELSE 'updated' END AS change, "
    "CASE WHEN now.mtime IS NULL THEN 'REMOVE' ELSE 'WRITE' END AS event_type "
    "FROM now FULL JOIN before ON now.root = before.root AND now.path = before.path "
    "WHERE (now.mtime IS NULL OR before.mtime IS NULL OR before.mtime < now.mtime) "
    "AND coalesce(now.root, before.root) IN (SELECT root FROM before)",
    "language_scan": _ctes(PATHS)
    + f"\nSELECT doc_id, path, {LANGUAGE} AS language FROM paths WHERE {LANGUAGE} IS NOT NULL "
    "AND len(list_filter(string_split(path, '/')[:-2], lambda d: "
    f"list_contains({_sql_list(IGNORED_DIRS)}, d) OR starts_with(d, '.'))) = 0",
    "language_filter": _ctes(PATHS)
    + f"\nSELECT doc_id, path, {LANGUAGE} AS language FROM paths "
    f"WHERE {LANGUAGE} IN ('python', 'go', 'tsx')",
    "route_by_extension": _ctes(PATHS)
    + f"\nSELECT path, CASE WHEN {EXTENSION} = '.pdf' THEN 'pdf' ELSE 'text' END AS route FROM "
    "(SELECT path FROM paths UNION ALL SELECT url FROM pages)",
    "pdf_listing": _ctes(PATHS) + "\nSELECT doc_id, path FROM paths WHERE path LIKE '%.pdf'",
    "source_default": "SELECT doc_id, coalesce(nullif(source, 'src3'), "
    "CASE WHEN doc_id % 2 = 0 THEN '/d/' || doc_id END, 'unknown') AS source FROM documents",
    "module_fallback": "SELECT doc_id, lang, 1 AS start_line, "
    "(length(text) - length(replace(text, E'\\n', '')) + 1)::INT AS end_line, text AS content "
    f"FROM documents WHERE length(text) <= 1500 AND regexp_matches(text, '{WHITESPACE.replace('[', '[^', 1)}')",
    "code_definitions": CODE_DEFINITIONS,
    "code_outline": _samples(),
    "corpus_fingerprint": "SELECT count(*) AS rows, coalesce(sum(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') "
    "|| ':' || coalesce('t' || text, 'n')), 1, 15))::BIGINT), 0)::VARCHAR AS digest FROM documents",
    "lda_vocab": _ctes(
        f"t AS (SELECT DISTINCT doc_id, unnest({TOPIC_TOKENS}) AS term FROM documents)"
    )
    + "\nSELECT term, count(*) AS df FROM t GROUP BY term HAVING count(*) >= 2 "
    "AND count(*) <= 0.8 * (SELECT count(*) FROM documents)",
    "recursive_split": recursive_split(500, 50),
    "polling_state": _ctes(*SNAPSHOTS)
    + "\nSELECT root, path, mtime, 0::BIGINT AS again FROM now",
    "index_live_rows": _ctes(
        FILE_EVENTS,
        "t AS (SELECT 'src' || (user_id % 15) AS source, max(event_id % 6) AS place FROM fe "
        "WHERE event_type IN ('REMOVE', 'RENAME') AND event_id % 6 < 3 GROUP BY 1)",
    )
    + "\nSELECT d.source, doc_id AS chunk_id FROM documents d LEFT JOIN t ON t.source = d.source "
    "WHERE doc_id % 6 <> 3 AND (t.place IS NULL OR doc_id % 6 >= t.place)",
    "topic_cosine_topk": _ctes(
        "s AS (SELECT vec_id, label, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS a FROM embeddings)",
        "e AS (SELECT vec_id AS doc_id, label, list_transform(a, lambda x: x / list_sum(a)) AS v FROM s)",
        "m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, "
        "generate_subscripts(v, 1) AS i FROM e) GROUP BY ALL)",
        "q AS (SELECT label::BIGINT AS query_id, list(x ORDER BY i) AS v FROM m GROUP BY label)",
    )
    + "\n"
    + ranked(
        f"SELECT query_id, doc_id, round({COSINE.format(a='q.v', b='e.v')}, 6) + 0.0 AS score FROM q, e"
    ),
}
