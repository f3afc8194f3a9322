"""SQL for the queries of ``queries.py``, run by DuckDB on the same tables."""

from __future__ import annotations

from .functions import lexicon as L
from .operators.vectors import LshConfig
from .options import DAY_MS, DEFAULTS

AS_OF = DEFAULTS.as_of_ms
EXTENSIONS = ("txt", "md", "pdf", "json", "html", "png", "csv", "docx")
RANK_LIMIT = 20
MATCH_QUERIES = [
    (1, "the and"), (2, "erha th"), (3, "of-the in"), (4, "le la que"), (5, "| the"), (6, "der die und"), (7, ""),
    (8, "l'elle"), (9, "zzzz"), (10, "the the"), (11, "in-the-a"),
]
TEXT_QUERIES = [
    (1, "I'm searching https://example.com for notes at me@test.com"), (2, "kotlin tutorials pdf from yesterday"),
    (3, "what is kubernetes"), (4, "kotlin coroutine example"), (5, "find my kotlin notes from yesterday"),
    (6, "search ml documents from last week"), (7, "How to implement a REST API in Python?"), (8, "2024-02-31 report"),
    (9, "don't can't won't"), (10, "the of and"), (11, ""), (12, "Résumé naïve café 42"), (13, "recent C++ code"),
    (14, "state-of-the-art nlp algorithm performance"), (15, "show json files this month"), (16, "99999999999 items in 2023-13-45"),
    (17, "explain deep learning tutorial guide"), (18, "r sql html"), (19, "--- ''' !!!"), (20, "open the newest markdown document last year"),
    (21, "create update delete ml ml"), (22, "where's the latest gpu benchmark"), (23, "my source code"), (24, "API design example with docker and aws"),
]


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join(f"({i}, {_s(t)})" for i, t in rows)


def _list(items) -> str:
    return "[" + ", ".join(items) + "]"


_EXT = _list(map(_s, EXTENSIONS))
_WS = r"'\s+'"
DOCS = f"""docs AS (SELECT doc_id AS id, '/' || source || '/doc_' || doc_id || '.' || ext AS file_path, 'doc_' || doc_id || ' ' || lang AS title,
    text, ext AS file_type, {AS_OF} - doc_id * {DAY_MS} AS modified_at, n_chars AS size_bytes
    FROM (SELECT *, ({_EXT})[doc_id % {len(EXTENSIONS)} + 1] AS ext FROM documents))"""
CHUNKS = f"""{DOCS},
    tk AS (SELECT id, list_filter(regexp_split_to_array(coalesce(text, ''), {_WS}), lambda x: x <> '') AS tk FROM docs),
    ch AS (SELECT id * 100000 + st // 110 AS chunk_id, id AS parent_file_id, (st // 110)::INT AS chunk_index,
        array_to_string(tk[st + 1:st + 150], ' ') AS text, st::INT AS start_offset, least(st + 150, len(tk))::INT AS end_offset
        FROM (SELECT id, tk, unnest(range(0, len(tk), 110)) AS st FROM tk))"""
_WORDS = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}]+')"
POSITIONS = f"""{CHUNKS},
    wl AS (SELECT chunk_id, {_WORDS.format('text')} AS ws FROM ch),
    pos AS (SELECT chunk_id, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM wl),
    len_ AS (SELECT chunk_id, len(ws) AS dl FROM wl),
    tot AS (SELECT count(*) AS n, sum(dl) AS total_len FROM len_)"""


def _match(rows=MATCH_QUERIES) -> str:
    return f"""q(query_id, text) AS (VALUES {_values(rows)}),
    ph AS (SELECT query_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS phrase
        FROM (SELECT query_id, list_filter(regexp_split_to_array(text, {_WS}), lambda x: x <> '') AS t FROM q)),
    pw AS (SELECT query_id, phrase, {_WORDS.format('token')} AS ws FROM ph),
    need AS (SELECT query_id, count(*) AS n_phrases FROM ph GROUP BY query_id),
    wd AS (SELECT query_id, phrase, len(ws) AS m, unnest(ws) AS token, generate_subscripts(ws, 1) - 1 AS off FROM pw),
    voc AS (SELECT DISTINCT term FROM pos),
    tm AS (SELECT query_id, phrase, m, off, term FROM wd JOIN voc ON CASE WHEN off = m - 1 THEN starts_with(term, token) ELSE term = token END),
    hit AS (SELECT query_id, phrase, m, chunk_id, pos - off AS st FROM tm JOIN pos USING (term)),
    whole AS (SELECT query_id, phrase, chunk_id, st FROM hit GROUP BY query_id, phrase, m, chunk_id, st HAVING count(*) = m),
    cnt AS (SELECT query_id, phrase, chunk_id, count(*) AS f FROM whole GROUP BY ALL)"""


_IDF = """df AS (SELECT query_id, phrase, count(*) AS df FROM cnt GROUP BY ALL),
    idf AS (SELECT query_id, phrase, CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0 THEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END AS idf,
        total_len::DOUBLE / n AS avgdl FROM df, tot)"""
_PART = "-list_reduce(list(idf * (f * 2.2::DOUBLE) / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) ORDER BY phrase), lambda a, x: a + x)"
BM25 = f"""{POSITIONS}, {_match()}, {_IDF},
    bm AS (SELECT query_id, chunk_id, {_PART} AS score, count(*) AS k FROM cnt JOIN idf USING (query_id, phrase) JOIN len_ USING (chunk_id) GROUP BY ALL),
    scored AS (SELECT bm.query_id, chunk_id, score FROM bm JOIN need USING (query_id) WHERE k = n_phrases)"""
SPARSE_FILES = f"""{BM25},
    topc AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) <= {3 * RANK_LIMIT}),
    hits AS (SELECT query_id, chunk_id, parent_file_id, ch.text, score FROM topc JOIN ch USING (chunk_id) JOIN docs ON docs.id = parent_file_id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_file_id ORDER BY score, chunk_id) AS rn FROM hits),
    sf AS (SELECT query_id, parent_file_id, min(score) AS best_score, string_agg(substr(text, 1, 200), ' ... ' ORDER BY rn) AS snippet FROM rk WHERE rn <= 3 GROUP BY ALL)"""
SPARSE = f"""{SPARSE_FILES},
    sn AS (SELECT *, CASE WHEN max(best_score) OVER w > min(best_score) OVER w THEN (max(best_score) OVER w - best_score) / (max(best_score) OVER w - min(best_score) OVER w) ELSE 1.0::DOUBLE END AS score,
        (row_number() OVER (PARTITION BY query_id ORDER BY best_score, parent_file_id))::INT AS rank FROM sf WINDOW w AS (PARTITION BY query_id)),
    sparse AS (SELECT query_id, id, file_path, title, file_type, modified_at, size_bytes, snippet, score, rank FROM sn JOIN docs ON docs.id = parent_file_id WHERE rank <= {RANK_LIMIT})"""
FILES = f"""{SPARSE},
    files AS (SELECT query_id, id, file_path, score AS best_score, {{mark}} || '...' AS snippets,
        (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM sparse)"""


def _marked() -> str:
    """Highlighting of each query's own terms, one replacement after another."""
    out = "CASE query_id"
    for i, text in MATCH_QUERIES:
        expr = "substr(snippet, 1, 200)"
        for term in text.split():
            pattern = "".join(c if c.isalnum() else "\\" + c for c in term)
            expr = f"regexp_replace({expr}, {_s(pattern)}, {_s('**' + term + '**')}, 'gi')"
        out += f" WHEN {i} THEN {expr}"
    return out + " END"


FILES = FILES.replace("{mark}", _marked())
VECTORS = "v AS (SELECT vec_id AS chunk_id, vec_id // 3 AS parent_file_id, embedding::DOUBLE[] AS e, label FROM embeddings)"
_HUNDRED = f"{VECTORS}, vq AS (SELECT chunk_id AS query_id, e AS qe, label FROM v WHERE chunk_id % 100 = 0)"
_COS = "list_cosine_similarity(qe, e)"


def _knn(queries: str, k: int, threshold: str = "") -> str:
    return f"""{queries}, sc AS (SELECT query_id, chunk_id AS id, {_COS} AS score FROM vq, v),
    knn AS (SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM sc {threshold}
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {k})"""


def _planes(tables: int, bits: int, dim: int) -> str:
    """The hyperplanes, drawn by DuckDB itself from md5."""
    return f"""pl AS (SELECT t, b, list(('0x' || substr(md5(t || ':' || b || ':' || d), 1, 6))::BIGINT / 16777216.0::DOUBLE * 2 - 1 ORDER BY d) AS p
        FROM range({tables}) a(t), range({bits}) b(b), range({dim}) c(d) GROUP BY t, b)"""


def _hashes(tables: int, bits: int) -> str:
    return f"""{_planes(tables, bits, 64)},
    hs AS (SELECT chunk_id AS id, t::INT AS "table", sum(CASE WHEN list_dot_product(e, p) > 0 THEN 1 << b ELSE 0 END)::INT AS hash FROM v, pl GROUP BY ALL)"""


def _recall_steps(low: int = 1, high: int = 1 << 20) -> list[tuple[int, int, int]]:
    """(least number of vectors, tables, bits): where the parameters chosen for recall change, for 64 dimensions."""

    def at(n):
        c = LshConfig.for_recall(n, 64)
        return c.tables, c.bits

    def steps(a, b):
        if at(a) == at(b):
            return []
        if b == a + 1:
            return [(b, *at(b))]
        mid = (a + b) // 2
        return steps(a, mid) + steps(mid, b)

    return [(low, *at(low)), *steps(low, high)]


_LSH = f"""cfg AS (SELECT tables, bits FROM (VALUES {", ".join(map(str, _recall_steps()))}) s(low, tables, bits) WHERE low <= (SELECT count(*) FROM v) ORDER BY low DESC LIMIT 1),
    pl AS (SELECT t, b, list(('0x' || substr(md5(t || ':' || b || ':' || d), 1, 6))::BIGINT / 16777216.0::DOUBLE * 2 - 1 ORDER BY d) AS p
        FROM cfg, range(64) a(t), range(32) b(b), range(64) c(d) WHERE t < tables AND b < bits GROUP BY t, b),
    hs AS (SELECT chunk_id AS id, t, sum(CASE WHEN list_dot_product(e, p) > 0 THEN 1 << b ELSE 0 END) AS hash FROM v, pl GROUP BY ALL),
    cd AS (SELECT DISTINCT a.id AS query_id, b.id FROM hs a JOIN hs b ON a.t = b.t AND a.hash = b.hash WHERE a.id % 100 = 0),
    cs AS (SELECT query_id, id, list_cosine_similarity(qe, e) AS score FROM cd JOIN vq USING (query_id) JOIN v ON v.chunk_id = id)"""

_NUMBERED = f"{VECTORS}, vq AS (SELECT chunk_id // 100 AS query_id, e AS qe FROM v WHERE chunk_id % 100 = 0)"
_DENSE = f"""{_knn(_NUMBERED, 60)},
    dh AS (SELECT query_id, v.chunk_id, parent_file_id, docs.text, score FROM knn JOIN v ON v.chunk_id = knn.id JOIN docs ON docs.id = parent_file_id),
    dr AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_file_id ORDER BY score DESC, chunk_id) AS rn FROM dh),
    da AS (SELECT query_id, parent_file_id AS id, max(score) AS score, string_agg(substr(text, 1, 200), ' ... ' ORDER BY rn) AS snippet FROM dr WHERE rn <= 3 GROUP BY ALL),
    dense AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM da QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {RANK_LIMIT})"""
#: Vectors stand for the match queries of their numbers; the other queries have none.
_MATCHED = f"{_NUMBERED[:-1]} AND chunk_id // 100 IN ({', '.join(str(i) for i, _ in MATCH_QUERIES)}))"
_BOTH = f"{SPARSE}, {_DENSE.replace(_NUMBERED, _MATCHED)}"


def _mm(x: str) -> str:
    return f"CASE WHEN max({x}) OVER w - min({x}) OVER w > 0 THEN ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) ELSE 0.5::DOUBLE END"


_BT, _MT = (", ".join(map(_s, x)) for x in (L.BOOSTED_TYPES, L.MUTED_TYPES))
FUSED = f"""{_BOTH},
    cand AS (SELECT coalesce(s.query_id, d.query_id) AS query_id, coalesce(s.id, d.id) AS id, coalesce(s.score, 0) AS b, coalesce(d.score, 0) AS d
        FROM sparse s FULL JOIN dense d ON s.query_id = d.query_id AND s.id = d.id),
    ca AS (SELECT cand.*, docs.title, docs.file_type, q.text AS qt, exp(-greatest(0, {AS_OF} - modified_at) / {float(DAY_MS)}::DOUBLE / 30.0::DOUBLE) AS r FROM cand JOIN docs USING (id) JOIN q USING (query_id)),
    cn AS (SELECT query_id, id, title, file_type, qt, {_mm('b')} AS nb, {_mm('d')} AS nd, {_mm('r')} AS nr FROM ca WINDOW w AS (PARTITION BY query_id)),
    fu AS (SELECT query_id, id, title, (0.45::DOUBLE * nb + 0.35::DOUBLE * nd + 0.10::DOUBLE * nr + CASE WHEN trim(qt) <> '' AND contains(lower(title), lower(qt)) THEN 0.10::DOUBLE ELSE 0::DOUBLE END)
        * CASE WHEN lower(file_type) IN ({_BT}) THEN 1.1::DOUBLE WHEN lower(file_type) IN ({_MT}) THEN 0.9::DOUBLE ELSE 1::DOUBLE END AS final_score FROM cn)"""


def _mmr(clamped: bool) -> str:
    low = "greatest(0.0::DOUBLE, list_max(list_transform(picked, lambda p: sims[p])))" if clamped else "list_max(list_transform(picked, lambda p: sims[p]))"
    return f"""WITH RECURSIVE {_knn(_HUNDRED, 30)},
    sm AS (SELECT a.query_id, a.id, a.score, a.rank, map_from_entries(list({{'k': b.id, 'v': list_cosine_similarity(x.e, y.e)}})) AS sims
        FROM knn a JOIN knn b USING (query_id) JOIN v x ON x.chunk_id = a.id JOIN v y ON y.chunk_id = b.id GROUP BY a.query_id, a.id, a.score, a.rank),
    pk AS (SELECT query_id, 1 AS place, [id] AS picked FROM knn WHERE rank = 1
        UNION ALL
        SELECT query_id, place + 1, list_append(picked, best) FROM (
            SELECT pk.query_id, place, picked, list(sm.id ORDER BY 0.7::DOUBLE * score - (1 - 0.7::DOUBLE) * {low} DESC, rank)[1] AS best
            FROM pk JOIN sm ON sm.query_id = pk.query_id AND NOT list_contains(picked, sm.id) WHERE place < 10 GROUP BY pk.query_id, place, picked))
    SELECT query_id, picked[place] AS id, place::INT AS place FROM pk"""


# --- query understanding ------------------------------------------------------


def _norm() -> str:
    t = f"regexp_replace(regexp_replace(text, {_s(L.URL)}, ' ', 'g'), {_s(L.EMAIL)}, ' ', 'g')"
    t = f"lower(strip_accents({t}))"
    for short, long_ in L.CONTRACTIONS.items():
        pattern = rf"\b{short}\b"
        t = f"regexp_replace({t}, {_s(pattern)}, {_s(long_)}, 'g')"
    not_plain = L.NOT_PLAIN
    return f"trim(regexp_replace(regexp_replace({t}, {_s(not_plain)}, ' ', 'g'), {_WS}, ' ', 'g'))"


def _ent(text, kind, vs="NULL", vn="NULL", conf=1.0) -> str:
    return f"{{'text': {text}, 'type': {_s(kind)}, 'value_str': ({vs})::VARCHAR, 'value_num': ({vn})::BIGINT, 'confidence': {conf}::DOUBLE}}"


def _entities() -> str:
    def when(pattern, e):
        return f"CASE WHEN regexp_matches(norm, {_s(pattern)}) THEN {e} END"

    def quoted(x):
        return "".join(c if c.isalnum() else "\\" + c for c in x)

    first = [when(p, _ent(_s(t), "FILE_TYPE", _s(t))) for p, t in L.FILE_TYPES]
    first += [when(rf"\b{p}\b", _ent(_s(p), "DATE_RELATIVE", "NULL", AS_OF - d * DAY_MS, 0.95)) for p, d in L.RELATIVE_DATES]
    named = [when(rf"\b{quoted(x)}\b", _ent(_s(x), "PROGRAMMING_LANGUAGE", _s(x), conf=0.9)) for x in L.LANGUAGES]
    named += [when(rf"\b{k}\b", _ent(_s(k), "TECHNICAL_DOMAIN", _s(v), conf=0.85)) for k, v in L.DOMAINS.items()]
    named += [when(r"\bmy\b", _ent("'my'", "PERSON_POSSESSIVE", "'user_owned'", conf=0.7))]
    day = "make_date(substr(d, 1, 4)::INT, 1, 1) + to_months(substr(d, 6, 2)::INT - 1) + to_days(substr(d, 9, 2)::INT - 1)"
    dates = f"list_transform(regexp_extract_all(norm, {_s(L.ISO_DATE)}), lambda d: {_ent('d', 'DATE_ABSOLUTE', 'NULL', f'epoch_ms({day}) + {AS_OF % DAY_MS}')})"
    nums = f"list_transform(regexp_extract_all(norm, {_s(L.NUMBER)}, 1), lambda d: {_ent('d', 'NUMERIC', 'NULL', 'coalesce(try_cast(d AS INT), 0)')})"
    keep = "lambda x: x IS NOT NULL"
    return f"list_concat(list_concat(list_filter({_list(first)}, {keep}), {dates}), list_concat(list_filter({_list(named)}, {keep}), {nums}))"


def _map(d: dict) -> str:
    return "MAP {" + ", ".join(f"{_s(k)}: {_list(map(_s, v)) if isinstance(v, list) else _s(v)}" for k, v in d.items()) + "}"


def _once(expr: str) -> str:
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


_STOP = _list(map(_s, L.STOP_WORDS))
_TOKEN = f"""{{'text': x, 'is_stopword': list_contains({_STOP}, x), 'importance': CASE WHEN list_contains({_STOP}, x) THEN 0.1::DOUBLE WHEN i = 1 THEN 0.9::DOUBLE
    WHEN length(x) > 8 THEN 0.8::DOUBLE WHEN contains(x, '-') THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END}}"""
UNDERSTOOD = f"""tq AS (SELECT query_id, text FROM (VALUES {_values(TEXT_QUERIES)}) a(query_id, text) UNION ALL SELECT item_id + 1000, text FROM benchmark),
    nq AS (SELECT query_id, coalesce(text, '') AS text, {_norm()} AS norm FROM tq),
    kq AS (SELECT *, list_filter(list_transform(list_filter(string_split(norm, ' '), lambda x: x <> ''), lambda x, i: {_TOKEN}), lambda t: regexp_matches(t.text, '[a-z0-9]')) AS tokens, {_entities()} AS ents FROM nq),
    wq AS (SELECT *, list_transform(tokens, lambda t: t.text) AS ws,
        list_transform(list_filter(tokens, lambda t: NOT t.is_stopword), lambda t: t.text) AS terms,
        list_transform(list_filter(tokens, lambda t: t.importance >= 0.6 AND NOT t.is_stopword), lambda t: t.text) AS heavy,
        {_map(L.EXPANSIONS)} AS em, {_map(L.SYNONYMS)} AS sm FROM kq),
    eq AS (SELECT *, list_transform(list_filter({_once('ws')}, lambda x: map_contains(em, x)), lambda x: {{'term': x, 'expansion': em[x]}}) AS exps,
        list_transform(list_filter({_once('heavy')}, lambda x: map_contains(sm, x)), lambda x: {{'term': x, 'words': sm[x]}}) AS syns,
        list_filter(ents, lambda e: list_contains(['PROGRAMMING_LANGUAGE', 'TECHNICAL_DOMAIN'], e.type)) AS named FROM wq),
    uq AS (SELECT *, list_distinct(list_concat(list_concat(list_transform(exps, lambda e: e.term), list_transform(exps, lambda e: e.expansion)),
        list_concat(list_transform(named, lambda e: e.text), list_transform(named, lambda e: e.value_str)))) AS boosted FROM eq)"""


def _first_of(field: str, *types: str) -> str:
    return f"list_transform(list_filter(ents, lambda e: list_contains({_list(map(_s, types))}, e.type)), lambda e: e.{field})[1]"


def _intent() -> str:
    def starts(*words):
        return "(" + " OR ".join(f"starts_with(norm, {_s(w)})" for w in words) + ")"

    def has(*words):
        return "(" + " OR ".join(f"contains(norm, {_s(w)})" for w in words) + ")"

    def ent(*types):
        return f"len(list_filter(ents, lambda e: list_contains({_list(map(_s, types))}, e.type))) > 0"

    question = starts(*L.QUESTION_STARTS)
    rules = {
        "LOOKUP": [(starts("find", "open", "show"), 0.8, "starts with action verb"), ("contains(lower(text), 'my ')", 0.6, "contains possessive 'my'"), (ent("FILE_TYPE"), 0.5, "specifies file type")],
        "EXPLORATION": [(f"(len(tokens) >= 2 AND NOT starts_with(norm, 'find') AND NOT {question})", 0.4, "general topic query"), (has("tutorial", "guide", "learn"), 0.6, "learning keywords")],
        "FACT_FINDING": [(question, 0.9, "question format"), (has("explain", "definition"), 0.7, "explanation request")],
        "CODE_SEARCH": [(has("example", "sample", "snippet", "code"), 0.7, "code-related keywords"), (ent("PROGRAMMING_LANGUAGE"), 0.6, "programming language mentioned"), (has("implement", "build"), 0.5, "implementation keywords")],
        "RECENT_FILES": [(ent("DATE_RELATIVE", "DATE_ABSOLUTE"), 0.8, "date entity present"), (has("recent", "latest", "new"), 0.6, "recency keywords")],
    }
    sums, whys = [], []
    for i, name in enumerate(L.INTENTS):
        total = "0::FLOAT"
        for cond, w, _ in rules[name]:
            total = f"({total} + CASE WHEN {cond} THEN {w}::FLOAT ELSE 0::FLOAT END)"
        sums.append(f"{total} AS s{i}")
        parts = ", ".join(f"CASE WHEN {c} THEN {_s(why)} END" for c, _, why in rules[name])
        whys.append(f"concat_ws('; ', {parts}) AS w{i}")
    best = "greatest(s0, s1, s2, s3, s4)"

    def case(values):
        return "CASE " + " ".join(f"WHEN s{i} = {best} THEN {v}" for i, v in enumerate(values)) + " END"

    return f"""WITH {UNDERSTOOD}, iq AS (SELECT query_id, {', '.join(sums + whys)} FROM uq)
    SELECT query_id, {case([_s(n) for n in L.INTENTS])} AS intent, round({best}::DOUBLE, 4) AS confidence, {case([f'w{i}' for i in range(5)])} AS reasoning FROM iq"""


_TERMS = "list_filter(list_transform(regexp_split_to_array(lower({0}), '\\s+'), lambda t: regexp_replace(t, '[^a-z0-9_]', '', 'g')), lambda t: length(t) >= 2)"
_SCANNED = f"""{DOCS}, scanned AS (SELECT * REPLACE (modified_at + CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END ELSE 0 END AS modified_at), CASE WHEN id % 11 <> 0 THEN text END AS body FROM docs),
    stored AS (SELECT * FROM docs WHERE id % 5 <> 0),
    cl AS (SELECT s.*, CASE WHEN t.file_path IS NULL THEN 'new' WHEN t.modified_at = s.modified_at THEN 'skipped' ELSE 'updated' END AS status FROM scanned s LEFT JOIN stored t ON s.file_path = t.file_path)"""
_METRICS = """mt AS (SELECT event_id AS seq, event_type AS query, floor(value)::BIGINT AS total_ms, floor(floor(value) / 4)::BIGINT AS bm25_ms, floor(floor(value) / 5)::BIGINT AS dense_ms,
    floor(floor(value) / 10)::BIGINT AS fusion_ms, (props::JSON ->> '$.k')::BIGINT AS final_count, user_id % 300 AS memory_mb, epoch_us(ts) // 1000 AS ts FROM events),
    rc AS (SELECT * FROM mt ORDER BY ts DESC, seq DESC LIMIT 200)"""
_AP = f"""{_knn(_HUNDRED, 50)}, rel AS (SELECT query_id, chunk_id AS id FROM vq JOIN v USING (label)),
    hits AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM knn JOIN rel USING (query_id, id)),
    ap AS (SELECT query_id, coalesce(s, 0) / n AS ap FROM (SELECT query_id, count(*) AS n FROM rel GROUP BY 1) LEFT JOIN (SELECT query_id, sum(seen / rank) AS s FROM hits GROUP BY 1) USING (query_id))"""
_PACK = """list_reduce(list_prepend({{'n': 0, 'kept': []::VARCHAR[], 's': ''}}, list_transform({0}, lambda s: {{'n': 0, 'kept': []::VARCHAR[], 's': s}})),
    lambda a, x: CASE WHEN len(a.kept) < {1} AND a.n + length(x.s) <= {2} THEN {{'n': (a.n + length(x.s))::INT, 'kept': list_append(a.kept, x.s), 's': ''}} ELSE a END).kept"""

def _html() -> str:
    t = r"regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?s)<[^>]*>', ' ', 'g')"
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = f"replace({t}, {_s(name)}, {_s(char)})"
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def _answers(source: str) -> str:
    """Scores of chunks against a question, for rows (key, q, chunks) of ``source``."""
    return f"""src AS ({source}), sq AS (SELECT key, q, chunks, list_distinct({_TERMS.format('q')}) AS qt FROM src),
    sc AS (SELECT key, qt, unnest(chunks) AS t, generate_subscripts(chunks, 1) AS i FROM sq),
    sh AS (SELECT key, t, i, len(list_intersect(list_distinct({_TERMS.format('t')}), qt)) AS hits FROM sc),
    sr AS (SELECT key, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS c, row_number() OVER (PARTITION BY key ORDER BY hits DESC, i) AS n FROM sh WHERE hits > 0),
    sa AS (SELECT key, string_agg(n || '. ' || CASE WHEN length(c) <= 220 THEN c ELSE rtrim(substr(c, 1, 220)) || '...' END, chr(10) ORDER BY n) AS answer, count(*)::INT AS n_sources FROM sr WHERE n <= 3 GROUP BY key),
    an AS (SELECT sq.key, CASE WHEN sa.key IS NULL THEN '' ELSE answer END AS answer, coalesce(n_sources, 0)::INT AS n_sources,
        CASE WHEN NOT regexp_matches(coalesce(q, ''), '\\S') THEN 'Query is blank' WHEN coalesce(len(chunks), 0) = 0 THEN 'No context chunks provided'
        WHEN len(qt) = 0 THEN 'Query has no searchable terms' WHEN sa.key IS NULL THEN 'No relevant context found' END AS error FROM sq LEFT JOIN sa ON sq.key = sa.key)"""


_GATHER = f"{FILES}, ga AS (SELECT query_id, list(snippets ORDER BY rank) AS snippets, list(file_path ORDER BY rank) AS paths FROM files GROUP BY query_id)"
_FENCE = "'```' || chr(10) || c || chr(10) || '```'"
_HEAD = (
    "'<|system|>' || chr(10) || 'You are a helpful assistant. Use only the provided excerpts.' || chr(10) || "
    "'If the answer is not present, say you do not have enough information.' || chr(10) || '<|end|>' || chr(10) || '<|user|>' || chr(10) || 'Document Excerpts:' || chr(10)"
)


def oracle_sql() -> dict[str, str]:
    n_tables, n_bits = 5, 10
    return {
        "chunk_documents": f"WITH {CHUNKS} SELECT chunk_id, parent_file_id, chunk_index, start_offset, end_offset, md5(text) AS text_md5 FROM ch",
        "chunk_backfill": f"WITH {DOCS} SELECT id AS parent_file_id, 0::INT AS chunk_index, 0::INT AS start_offset, length(text)::INT AS end_offset FROM docs WHERE text IS NOT NULL AND length(trim(text)) > 0",
        "word_tokens_vocab": f"WITH {POSITIONS} SELECT term, count(*) AS cf, count(DISTINCT chunk_id) AS df FROM pos GROUP BY term",
        "corpus_stats": f"WITH {POSITIONS} SELECT n, total_len::BIGINT AS total_len, (SELECT count(DISTINCT term) FROM pos) AS n_terms FROM tot",
        "fts_query_build": f"""SELECT item_id, coalesce(array_to_string(list_transform(list_filter(regexp_split_to_array(trim(text), {_WS}), lambda t: t <> ''), lambda t: '"' || replace(t, '"', '""') || '"*'), ' AND '), '') AS fts FROM benchmark""",
        "fts_prefix_match": f"WITH {POSITIONS}, {_match()}, mk AS (SELECT query_id, chunk_id, count(*) AS k FROM cnt GROUP BY ALL) SELECT mk.query_id, chunk_id FROM mk JOIN need USING (query_id) WHERE k = n_phrases",
        "fts_phrase_match": f"WITH {POSITIONS}, {_match([r for r in MATCH_QUERIES if '-' in r[1] or chr(39) in r[1]])} SELECT query_id, phrase::INT AS phrase, chunk_id, f FROM cnt",
        "bm25_chunks": f"WITH {BM25} SELECT query_id, chunk_id, round(score, 10) AS score FROM scored",
        "bm25_columns": f"""WITH {DOCS}, fl AS (SELECT id, 1.2::DOUBLE AS w, title AS t FROM docs UNION ALL SELECT id, 0.75::DOUBLE, coalesce(text, '') FROM docs),
            wl AS (SELECT id, w, {_WORDS.format('t')} AS ws FROM fl),
            pos AS (SELECT id * 2 + CASE WHEN w > 1 THEN 1 ELSE 0 END AS chunk_id, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM wl),
            len_ AS (SELECT id, sum(len(ws)) AS dl FROM wl GROUP BY id), tot AS (SELECT count(*) AS n, sum(dl) AS total_len FROM len_), {_match().replace('cnt AS', 'cnt0 AS')},
            cnt AS (SELECT query_id, phrase, chunk_id // 2 AS id, sum(f * CASE WHEN chunk_id % 2 = 1 THEN 1.2::DOUBLE ELSE 0.75::DOUBLE END) AS f FROM cnt0 GROUP BY ALL), {_IDF},
            bm AS (SELECT query_id, id, {_PART} AS score, count(*) AS k FROM cnt JOIN idf USING (query_id, phrase) JOIN len_ USING (id) GROUP BY ALL)
            SELECT bm.query_id, id, round(score, 9) AS score FROM bm JOIN need USING (query_id) WHERE k = n_phrases""",
        "chunk_aggregate_sparse": f"WITH {SPARSE_FILES} SELECT query_id, parent_file_id, file_path, round(best_score, 10) AS best_score, snippet FROM sf JOIN docs ON docs.id = parent_file_id",
        "bm25_search": f"WITH {SPARSE} SELECT query_id, id, file_path, title, snippet, round(score, 6) AS score, rank FROM sparse",
        "cosine_topk": f"WITH {_knn(_HUNDRED, 20)} SELECT query_id, id, round(score, 6) AS score, rank FROM knn",
        "cosine_threshold": f"WITH {_knn(_HUNDRED, 50, 'WHERE score >= 0.3')} SELECT query_id, id, round(score, 6) AS score, rank FROM knn",
        "l2_normalize_vectors": f"""WITH {VECTORS}, u AS (SELECT chunk_id, list_transform(e, lambda x: x * 3) AS e FROM v), s AS (SELECT chunk_id, e, sqrt(list_dot_product(e, e)) AS n FROM u)
            SELECT chunk_id, round(CASE WHEN n > 0 THEN e[1] / n ELSE e[1] END, 6) AS first, round(CASE WHEN n > 0 THEN e[-1] / n ELSE e[-1] END, 6) AS last FROM s""",
        "lsh_hash": f"WITH {VECTORS}, {_hashes(n_tables, n_bits)} SELECT id, \"table\", hash FROM hs",
        "lsh_bucket_stats": f"""WITH {VECTORS}, {_hashes(n_tables, n_bits)}, b AS (SELECT DISTINCT "table", hash FROM hs)
            SELECT (SELECT count(DISTINCT id) FROM hs) AS total_vectors, (SELECT count(DISTINCT "table") FROM hs) AS num_tables, count(*) AS buckets, round((SELECT count(DISTINCT id) FROM hs) / count(*), 6) AS avg_bucket_size FROM b""",
        "lsh_search": f"""WITH {_HUNDRED}, {_LSH},
            r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM cs) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
        "dense_with_fallback": f"""WITH {_HUNDRED}, {_LSH},
            near AS (SELECT *, 'ann' AS source, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM cs WHERE score >= 0.3),
            ex AS (SELECT query_id, chunk_id AS id, {_COS} AS score FROM vq, v WHERE query_id NOT IN (SELECT query_id FROM near)),
            exr AS (SELECT query_id, id, score, 'exact' AS source, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM ex WHERE score >= 0.3)
            SELECT query_id, id, round(score, 6) AS score, rank, source FROM (SELECT query_id, id, score, source, rank FROM near UNION ALL SELECT query_id, id, score, source, rank FROM exr) WHERE rank <= 10""",
        "dense_hydrate": f"WITH {DOCS}, {_DENSE} SELECT query_id, id, file_path, round(score, 6) AS score, md5(snippet) AS snippet_md5, rank FROM dense JOIN docs USING (id)",
        "minmax_norm": f"SELECT event_id, round({_mm('value')}, 6) AS norm FROM events WINDOW w AS (PARTITION BY event_type)",
        "zscore_norm": "SELECT event_id, round(CASE WHEN stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END, 6) AS z FROM events WINDOW w AS (PARTITION BY event_type)",
        "fusion_rank": f"WITH {FUSED} SELECT query_id, id, title, round(final_score, 6) AS final_score, (row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, id))::INT AS rank FROM fu",
        "rrf_fusion": f"""WITH {_BOTH}, al AS (SELECT query_id, id, rank FROM sparse UNION ALL SELECT query_id, id, rank FROM dense),
            su AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM al GROUP BY ALL), rr AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM su)
            SELECT query_id, id, round(score, 9) AS score, rank FROM rr WHERE rank <= 25""",
        "mmr_diversify": _mmr(False),
        "mmr_clamped": _mmr(True),
        "rerank_blend": f"""WITH {SPARSE}, jq AS (SELECT sparse.*, list_distinct({_TERMS.format('q.text')}) AS qt FROM sparse JOIN q USING (query_id)),
            bl AS (SELECT query_id, id, rank AS r0, 0.7::DOUBLE * CASE WHEN len(qt) > 0 THEN len(list_intersect(list_distinct({_TERMS.format('snippet')}), qt)) / len(qt) ELSE 0 END + (1 - 0.7::DOUBLE) * score AS score FROM jq),
            rr AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0))::INT AS rank FROM bl) SELECT query_id, id, round(score, 6) AS score, rank FROM rr WHERE rank <= 10""",
        "file_aggregate_highlight": f"WITH {FILES} SELECT query_id, file_path, round(best_score, 6) AS best_score, snippets, rank FROM files",
        "post_filters": f"WITH {DOCS} SELECT id, file_type, modified_at FROM docs WHERE lower(file_type) = 'pdf' AND modified_at BETWEEN {AS_OF - 500 * DAY_MS} AND {AS_OF - 10 * DAY_MS}",
        "query_filters": f"""WITH {DOCS}, {UNDERSTOOD}, fq AS (SELECT query_id, {_first_of('value_str', 'FILE_TYPE')} AS t, {_first_of('value_num', 'DATE_RELATIVE', 'DATE_ABSOLUTE')} AS a FROM uq WHERE query_id < 1000)
            SELECT query_id, id FROM fq, docs WHERE (t IS NULL OR lower(file_type) = lower(t)) AND (a IS NULL OR modified_at >= a)""",
        "dense_skip": f"WITH {SPARSE}, sk AS (SELECT query_id, count(*) AS files, max(score) AS top FROM sparse GROUP BY 1) SELECT query_id, files, round(top, 6) AS top_score, files >= {RANK_LIMIT} AND top >= 0.85 AS skipped FROM sk",
        "query_normalize": f"""WITH {UNDERSTOOD} SELECT query_id, norm AS normalized, coalesce(array_to_string(regexp_extract_all(text, {_s(L.URL)}), '|'), '') AS urls, coalesce(array_to_string(regexp_extract_all(text, {_s(L.EMAIL)}), '|'), '') AS emails FROM uq""",
        "query_tokenize": f"WITH {UNDERSTOOD}, x AS (SELECT query_id, unnest(tokens) AS t, generate_subscripts(tokens, 1) - 1 AS pos FROM uq) SELECT query_id, pos::INT AS pos, t.text AS text, 100::INT AS token_id, t.is_stopword AS is_stopword, t.importance AS importance FROM x",
        "query_key_terms": f"""WITH {UNDERSTOOD} SELECT query_id, coalesce(array_to_string(list_transform(list_filter(tokens, lambda t: t.importance >= 0.5), lambda t: t.text), ' '), '') AS key_terms,
            coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda t: regexp_replace(t, '[^a-z0-9_]', '', 'g')), lambda t: t <> ''), ' '), '') AS fallback FROM uq""",
        "query_entities": f"WITH {UNDERSTOOD}, x AS (SELECT query_id, unnest(ents) AS e, generate_subscripts(ents, 1) - 1 AS pos FROM uq) SELECT query_id, pos::INT AS pos, e.text AS text, e.type AS type, e.value_str AS value_str, e.value_num AS value_num, e.confidence AS confidence FROM x",
        "query_expand": f"""WITH {UNDERSTOOD} SELECT query_id, coalesce(array_to_string(terms, ' '), '') AS terms,
            coalesce(array_to_string(list_transform(exps, lambda e: e.term || '=' || e.expansion), ';'), '') AS expansions,
            coalesce(array_to_string(list_transform(syns, lambda s: s.term || '=' || array_to_string(s.words, ',')), ';'), '') AS synonyms,
            coalesce(array_to_string(list_sort(boosted), ';'), '') AS boosted, {_first_of('value_str', 'FILE_TYPE')} AS file_type, {_first_of('value_num', 'DATE_RELATIVE', 'DATE_ABSOLUTE')} AS date_after,
            {_first_of('value_str', 'PROGRAMMING_LANGUAGE')} AS programming_language, len(list_filter(ents, lambda e: e.type = 'PERSON_POSSESSIVE')) > 0 AS user_owned FROM uq""",
        "query_bm25_text": f"""WITH {UNDERSTOOD} SELECT query_id,
            trim(coalesce(array_to_string(list_concat(list_concat(flatten(list_transform(terms, lambda t: CASE WHEN list_contains(boosted, t) THEN [t, t] ELSE [t] END)),
                flatten(list_transform(exps, lambda e: string_split(e.expansion, ' ')))), flatten(list_transform(syns, lambda s: s.words))), ' '), '')) AS bm25_query,
            trim(coalesce(array_to_string(list_concat(terms, list_transform(exps, lambda e: e.expansion)), ' '), '')) AS dense_query FROM uq""",
        "query_intent": _intent(),
        "rag_context": f"""WITH {_GATHER}, px AS (SELECT query_id, {_PACK.format('snippets', 5, 900)} AS ctx, paths FROM ga)
            SELECT query_id, len(ctx)::INT AS n_chunks, md5(coalesce(array_to_string(ctx, chr(10)), '')) AS context_md5, array_to_string(paths[1:3], '|') AS citations FROM px""",
        "extractive_answer": "WITH "
        + _answers(
            "SELECT conv_id AS key, any_value(q) AS q, list(text ORDER BY n) AS chunks FROM (SELECT conv_id, text, first_value(text) OVER w AS q, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE n >= 2 GROUP BY conv_id"
        )
        + " SELECT key AS conv_id, CASE WHEN error IS NULL THEN answer ELSE '' END AS answer, CASE WHEN error IS NULL THEN n_sources ELSE 0 END::INT AS n_sources, error FROM an",
        "rag_envelope": f"WITH {_GATHER}, px AS (SELECT q.query_id AS key, q.text AS q, CASE WHEN ga.query_id IS NULL THEN []::VARCHAR[] ELSE {_PACK.format('snippets', 5, 2000)} END AS chunks, paths FROM q LEFT JOIN ga USING (query_id)), "
        + _answers("SELECT key, q, chunks FROM px")
        + """ SELECT an.key AS query_id, CASE WHEN len(px.chunks) > 0 AND an.error IS NULL THEN an.answer END AS answer,
            CASE WHEN len(px.chunks) = 0 THEN 'No relevant context found in search results' ELSE an.error END AS error,
            CASE WHEN len(px.chunks) = 0 THEN '' ELSE array_to_string(px.paths[1:3], '|') END AS citations FROM an JOIN px USING (key)""",
        "rag_prompt": f"""WITH {_GATHER} SELECT query_id, md5({_HEAD} || array_to_string(list_transform(snippets[1:5], lambda c: {_FENCE}), chr(10) || chr(10)) || chr(10) || chr(10) || 'Question: ' || q.text || chr(10) || '<|end|>' || chr(10) || '<|assistant|>') AS prompt_md5 FROM ga JOIN q USING (query_id)""",
        "map_eval": f"WITH {_AP} SELECT round(coalesce(avg(ap), 0), 6) AS map, count(*) AS n_queries FROM ap",
        "average_precision": f"WITH {_AP} SELECT query_id, round(ap, 6) AS ap FROM ap",
        "telemetry_recent": f"WITH {_METRICS} SELECT seq, query, total_ms, ts FROM rc",
        "telemetry_summary": f"""WITH {_METRICS}, a AS (SELECT count(*) AS n, avg(total_ms) AS av, list(total_ms::DOUBLE ORDER BY total_ms) AS s, avg(bm25_ms) AS b, avg(dense_ms) AS d, avg(fusion_ms) AS f,
            trunc(avg(final_count))::INT AS ar, trunc(count(*) FILTER (final_count > 10) * 100 / count(*))::INT AS hr, trunc(count(*) FILTER (final_count = 0) * 100 / count(*))::INT AS er, trunc(avg(memory_mb))::INT AS m FROM rc)
            SELECT n AS total_queries, round(av, 6) AS avg_latency, s[floor((n - 1) * 0.95)::INT + 1] AS p95_latency, round(greatest(av - b - d - f, 0), 6) AS query_processing, round(b, 6) AS bm25, round(d, 6) AS dense,
            round(f, 6) AS fusion, round(greatest(f * 0.4::DOUBLE, 0), 6) AS reranking, round(greatest(av, 1), 6) AS total, ar AS avg_results, hr AS high_recall, er AS empty_rate, m AS memory_mb,
            0.74::DOUBLE AS avg_top_score, 42::INT AS avg_bucket_size, (n * ar)::BIGINT AS dataset_size FROM a WHERE n > 0""",
        "perf_lines": f"""WITH {_METRICS} SELECT seq, '[PERF] Query: "' || query || '" | BM25: ' || bm25_ms || 'ms (' || seq % 7 || ' results) | Dense: ' || dense_ms || 'ms (' || seq % 5 || ' results) | Fusion: ' || fusion_ms
            || 'ms | Total: ' || total_ms || 'ms (' || coalesce(final_count::VARCHAR, 'null') || ' results) | Mem: ' || (memory_mb - 1) || 'MB -> ' || memory_mb || 'MB' AS line FROM mt""",
        "index_health": f"WITH {CHUNKS}, d AS (SELECT count(*) AS files, coalesce(sum(size_bytes), 0)::BIGINT AS bytes, coalesce(max(modified_at), 0) AS last_updated FROM docs), c AS (SELECT count(*) AS chunks FROM ch) SELECT files, chunks, bytes, last_updated, files > 0 AND chunks >= files AS healthy FROM d, c",
        "index_counters": f"WITH {_SCANNED} SELECT count(*) FILTER (status = 'new' AND body IS NOT NULL) AS new, count(*) FILTER (status = 'updated' AND body IS NOT NULL) AS updated, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status <> 'skipped' AND body IS NULL) AS errors FROM cl",
        "incremental_upsert": f"WITH {_SCANNED}, n AS (SELECT id, file_path, modified_at, size_bytes FROM cl WHERE status <> 'skipped' AND body IS NOT NULL) SELECT id, file_path, modified_at, size_bytes FROM stored WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n",
        "delete_by_path": f"WITH {DOCS} SELECT id, file_path FROM docs WHERE id % 4 <> 0",
        "postings_delta": f"WITH {POSITIONS}, k AS (SELECT pos.* FROM pos JOIN ch USING (chunk_id) WHERE parent_file_id % 2 <> 0 OR parent_file_id % 6 <> 0) SELECT term, count(*) AS cf, count(DISTINCT chunk_id) AS df FROM k GROUP BY term",
        "html_parse": f"SELECT page_id, md5({_html()}) AS text_md5 FROM pages",
        "embedding_page": "SELECT vec_id AS chunk_id, label FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 100 OFFSET 150",
        "format_columns": f"""WITH {DOCS}, x AS (SELECT *, size_bytes * 331 - 5000 AS c, size_bytes * 977 AS n, (id % 101) / 100 AS s, CASE WHEN id % 9 = 0 THEN 0 ELSE modified_at END AS m0 FROM docs)
            SELECT id, CASE WHEN c <= 0 THEN '--' WHEN c / 1024.0 < 1024 THEN trunc(c / 1024.0)::INT || ' KB' ELSE printf('%.1f', c::DOUBLE / 1024 / 1024) || ' MB' END AS card_size,
            CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN n // 1024 || ' KB' WHEN n < 1073741824 THEN n // 1048576 || ' MB' ELSE n // 1073741824 || ' GB' END AS file_size,
            strftime(make_timestamp(modified_at * 1000), '%Y-%m-%d') AS card_date, CASE WHEN m0 <= 0 THEN 'Never' ELSE strftime(make_timestamp(m0 * 1000), '%Y-%m-%d %H:%M') END AS full_date,
            strftime(make_timestamp((modified_at + id * 1000) * 1000), '%H:%M:%S') AS clock, trunc(s::DOUBLE * 100)::INT || '%' AS percent, 'Score: ' || printf('%.2f', s::DOUBLE) AS decimal,
            CASE WHEN id % 600 < 200 THEN 'good' WHEN id % 600 < 400 THEN 'fair' ELSE 'slow' END AS band, s > 0.75 AS relevant, 'a <b>' || title || '</b> b' AS bold, lower(title) AS key FROM x""",
    }
