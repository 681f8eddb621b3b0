"""DuckDB statements with the results the catalog's queries must give.

Written independently of the Spark code: plain SQL over the driver's tables. Common tables
are named once and pulled into a statement when its text mentions them.
"""

import re

from wosearch.config import (
    CONTEXT_QUERY_PREFIX, EMBEDDING_DIM, EQUIPMENT_TERMS, NA_TOKENS, QUERY_PREFIX, STRATEGIES,
    TYPE_TERMS,
)
from wosearch.schema import CLEAN_COLUMNS, RAW_COLUMNS
from wosearch.sources.testdata import ROUTER_QUERIES, WORK_ORDERS

_W = r"\p{L}\p{N}_"
_S = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
_KS = (1, 5, 10)


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _cut(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def _strip(x: str) -> str:
    return _cut(x, f"^[{_S}]+|[{_S}]+$")


def _search_text(x: str) -> str:
    flat = f"""replace(replace(regexp_replace({x}, '[\\n\\r,;|/]', ' ', 'g'), '"', ''), '''', '')"""
    return _cut(_cut(_strip(f"lower({flat})"), f"[{_S}]+", " "), f"[^{_W}{_S}\\-.]")


def _strict_text(x: str) -> str:
    return _strip(_cut(_cut(f"lower({x})", f"[^a-z0-9{_S}\\-]", " "), f"[{_S}]+", " "))


def _na(x: str) -> str:
    return f"CASE WHEN {x} IN ({_list(NA_TOKENS)}) THEN '' ELSE {x} END"


def _building(x: str) -> str:
    return f"CASE WHEN {_strip(x)} IN ('nan', 'None') THEN '' ELSE {_strip(x)} END"


def _lacks(x: str) -> str:
    return f"({x} IS NULL OR {_strip(x)} = '' OR lower({x}) IN ('nan', 'none'))"


def _plain(desc: str, name: str) -> str:
    q = (f"CASE WHEN {name} IN ('', 'unknown_building') THEN lower({desc}) "
         f"ELSE replace(lower({desc}), lower({name}), '') END")
    q = _cut(q, rf"(^|[^{_W}])[a-z]\d{{3,4}}\b", r"\1 ")
    q = _cut(q, rf"(^|[^{_W}])zone[{_S}]*\d+\b", r"\1 ")
    q = _cut(q, rf"(^|[^{_W}])(?:pm|cppainter|waycas|nspi|wo\d+|elelct|csb)\b", r"\1 ")
    q = _cut(q, rf"(^|[^{_W}])[{_W}]{{2,}}-[{_W}]{{2,}}-[{_W}]{{2,}}", r"\1 ")
    return f"trim({_cut(q, f'[{_S}]{{2,}}', ' ')}, ' -|.,')"


def _constrained(base: str, equipment: str, kind: str) -> str:
    def token(t):
        return f"CASE WHEN {t} NOT IN ('', 'unknown_type', 'UNKNOWN_TYPE') THEN {t} END"

    prefix = f"concat_ws(' ', {token(equipment)}, {token(kind)})"
    return f"CASE WHEN {prefix} = '' THEN {base} ELSE concat({prefix}, ': ', {base}) END"


def _mice(separator: str) -> str:
    def v(c):
        value = f"lower({_strip(c)})"
        return (f"CASE WHEN {value} IN ('', 'nan', 'none', 'unknown_building', 'unknown_type') "
                f"THEN 'unknown' ELSE {value} END")

    s = separator
    return (
        f"concat('building id: ', {v('BuildingID')}, '.', {s}, "
        f"'building name: ', {v('BuildingName')}, '.', {s}, "
        f"'facility type: ', {v('Type')}, '.', {s}, "
        f"'equipment system: ', {v('equipment')}, '.', {s}, "
        f"'work period: ', {v('WOStartDate')}, ' to ', {v('WOEndDate')}, '.', {s}, "
        f"'work order description: ', {v('WODescription')}, '.')"
    )


_TEXT = ("concat_ws(' | ', " + ", ".join(
    f"nullif({_strip(c)}, '')" for c in ("BuildingName", "Type", "WODescription")) + ")")


def _term(text: str, terms) -> str:
    ordered = sorted(terms, key=lambda t: (-len(t), t))
    cases = " ".join(rf"WHEN regexp_matches({text}, '\b{t}\b') THEN '{t}'" for t in ordered)
    return f"CASE {cases} END"


def _vectors(source: str, ids: str, texts: str) -> str:
    """Sparse hash vectors (ids, bucket, v) of a text column."""
    d = EMBEDDING_DIM
    return f"""
      SELECT {ids}, b, v FROM (
        SELECT {ids}, b, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY {ids})) AS FLOAT)
               AS DOUBLE) AS v
        FROM (
          SELECT {ids}, h % {d} AS b,
                 CAST(sum(CASE WHEN (h // {d}) % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS c
          FROM (SELECT {ids}, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) AS h
                FROM (SELECT {ids}, unnest(regexp_extract_all(lower({texts}), '[\\p{{L}}\\p{{N}}]+')) AS t
                      FROM {source}))
          GROUP BY ALL)) WHERE v <> 0"""


def _scores(queries: str, rows: str, row_ids: str, tie: str, k: int, grid: str) -> str:
    """Exact top-k: every row of ``grid`` counts, also those without a common bucket."""
    return f"""
      SELECT * FROM (
        SELECT g.*, CAST(coalesce(s.dot, 0) AS FLOAT) AS score,
               row_number() OVER (PARTITION BY query_id
                 ORDER BY CAST(coalesce(s.dot, 0) AS FLOAT) DESC, {tie}) AS pool_rank
        FROM ({grid}) g LEFT JOIN (
          SELECT q.query_id, d.{row_ids}, sum(q.v * d.v) AS dot
          FROM {queries} q JOIN {rows} d USING (b) GROUP BY ALL) s
        USING (query_id, {row_ids}))
      WHERE pool_rank <= {k}"""


def _hits(pool: str, k: int, strategy: str) -> str:
    return (f"SELECT query_id, '{strategy}' AS strategy, pool_rank AS rank, WOID AS woid, score "
            f"FROM {pool} WHERE pool_rank <= {k}")


def _filtered(strategy: str) -> str:
    return f"""
      SELECT query_id, '{strategy}' AS strategy, r AS rank, WOID AS woid, score FROM (
        SELECT p.*, row_number() OVER (PARTITION BY p.query_id ORDER BY pool_rank) AS r
        FROM text_pool p JOIN cleaned w USING (ingest_seq) JOIN cases c ON c.query_id = p.query_id
        WHERE (coalesce(c.building_type, '') = '' OR c.building_type = w.Type)
          AND (coalesce(c.equipment, '') = '' OR c.equipment = w.equipment))
      WHERE r <= 10"""


_FOUND = ", ".join(
    f"count(CASE WHEN relevant AND rank <= {k} THEN 1 END) AS found_{k}, "
    f"sum(CASE WHEN relevant AND rank <= {k} THEN 1 / log2(rank + 1) END) AS dcg_{k}"
    for k in _KS)
_IDEAL = {
    k: " + ".join(f"CASE WHEN n_relevant >= {r} THEN 1 / log2({r} + 1) ELSE 0 END"
                  for r in range(1, k + 1))
    for k in _KS
}
_MEASURES = ", ".join(
    f"coalesce(found_{k}, 0) / n_relevant AS recall_{k}, "
    f"coalesce(dcg_{k}, 0) / ({_IDEAL[k]}) AS ndcg_{k}" for k in _KS)
_AVERAGES = ", ".join(
    f"round(avg({m}_{k}), 6) AS {m}_{k}" for k in _KS for m in ("recall", "ndcg"))
_WIDE = ", ".join(
    f"max(CASE WHEN strategy = '{s}' THEN {source} END) AS {s}_{name}"
    for s in STRATEGIES
    for name, source in (("recall", "recall_10"), ("mrr", "mrr"), ("ndcg", "ndcg_10"),
                         ("first_hit", "first_hit_rank")))
_BEST, _WORST = (
    "CASE " + " ".join(
        f"WHEN {s}_recall = {f}({', '.join(x + '_recall' for x in STRATEGIES)}) THEN '{s}'"
        for s in STRATEGIES) + " END"
    for f in ("greatest", "least"))
_PLACE = "CASE strategy " + " ".join(
    f"WHEN '{s}' THEN {i}" for i, s in enumerate(STRATEGIES)) + " END"

_COMMON = {
    "raw": WORK_ORDERS.format(documents="documents", embeddings="embeddings"),
    "preprocessed": f"""
      SELECT ingest_seq, BuildingID, {_search_text('BuildingName')} AS BuildingName,
             {_search_text('Type')} AS Type, WOID,
             {_search_text('WODescription')} AS WODescription, WOStartDate, WOEndDate,
             {_search_text('SystemDescription')} AS equipment FROM raw""",
    "filled": "SELECT ingest_seq, " + ", ".join(f"{_na(c)} AS {c}" for c in CLEAN_COLUMNS)
              + " FROM preprocessed",
    "firsts": """
      SELECT * FROM filled WHERE WOID <> ''
      QUALIFY row_number() OVER (PARTITION BY WOID ORDER BY ingest_seq) = 1""",
    "cleaned": f"""
      SELECT ingest_seq,
        CASE WHEN lacks THEN 'UNK_' || CAST((row_number() OVER (PARTITION BY lacks
          ORDER BY ingest_seq) - 1) % 20 AS VARCHAR) ELSE id END AS BuildingID,
        CASE WHEN BuildingName = '' THEN 'UNKNOWN_BUILDING' ELSE BuildingName END AS BuildingName,
        CASE WHEN Type = '' THEN 'UNKNOWN_TYPE' ELSE Type END AS Type,
        WOID, WODescription, WOStartDate,
        CASE WHEN WOEndDate = '' THEN 'ONGOING' ELSE WOEndDate END AS WOEndDate, equipment
      FROM (SELECT *, {_lacks('id')} AS lacks
            FROM (SELECT *, {_building('BuildingID')} AS id FROM firsts)
            WHERE length(WODescription) >= 20)""",
    "represented": f"""SELECT *, {_TEXT} AS text_repr, {_mice("' '")} AS mice_repr FROM cleaned""",
    "text_docs": _vectors("represented", "ingest_seq", "text_repr"),
    "mice_docs": _vectors("represented", "ingest_seq", "mice_repr"),
    "groups": """
      SELECT equipment, Type, count(*) AS n_rows,
             min(CAST('0x' || substr(md5('42|' || WOID), 1, 15) AS BIGINT)) AS seed_hash
      FROM cleaned WHERE equipment NOT IN ('', 'UNKNOWN_TYPE') AND Type NOT IN ('', 'UNKNOWN_TYPE')
      GROUP BY ALL HAVING count(*) >= 5 AND count(*) - 1 >= 2""",
    "seeds": """
      SELECT md5(concat_ws('|', '42', g.equipment, g.Type)) AS query_id,
             g.equipment AS group_equipment, g.Type AS group_type, min(w.WOID) AS seed_woid,
             arg_min(w.BuildingName, w.WOID) AS seed_building,
             arg_min(w.WODescription, w.WOID) AS seed_text, n_rows - 1 AS n_relevant
      FROM groups g JOIN cleaned w ON w.equipment = g.equipment AND w.Type = g.Type
       AND CAST('0x' || substr(md5('42|' || w.WOID), 1, 15) AS BIGINT) = g.seed_hash
      GROUP BY g.equipment, g.Type, n_rows""",
    "candidates": f"""
      SELECT *, {_plain('seed_text', 'seed_building')} AS plain,
             {_constrained(_plain('seed_text', 'seed_building'), 'group_equipment', 'group_type')}
             AS constrained FROM seeds""",
    "first_cases": """
      SELECT * FROM candidates WHERE length(constrained) >= 10
      QUALIFY row_number() OVER (ORDER BY query_id)
              <= floor((SELECT count(*) FROM candidates) * 0.6::DOUBLE)""",
    "later_cases": """
      SELECT * FROM candidates WHERE length(plain) >= 10
        AND query_id > (SELECT max(query_id) FROM first_cases)
        AND (SELECT count(*) FROM first_cases)
            = floor((SELECT count(*) FROM candidates) * 0.6::DOUBLE)
      QUALIFY row_number() OVER (ORDER BY query_id) <= (SELECT count(*) FROM candidates)
              - floor((SELECT count(*) FROM candidates) * 0.6::DOUBLE)""",
    "cases": " UNION ALL ".join(
        f"""SELECT query_id, {text} AS query_text, CAST(NULL AS VARCHAR) AS building_id,
            {kind} AS building_type, {equipment} AS equipment, '{label}' AS query_type,
            group_equipment, group_type,
            concat('[{label}] ', group_equipment, '/', group_type, ' src:', seed_woid) AS description,
            seed_woid, n_relevant FROM {source}"""
        for source, label, text, kind, equipment in (
            ("first_cases", "constrained", "constrained", "group_type", "group_equipment"),
            ("later_cases", "semantic", "plain", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)"),
        )),
    "text_probes": _vectors(
        f"(SELECT query_id, '{QUERY_PREFIX}' || query_text AS q FROM cases)", "query_id", "q"),
    "mice_probes": _vectors(
        f"(SELECT query_id, '{QUERY_PREFIX}{CONTEXT_QUERY_PREFIX}' || query_text AS q FROM cases)",
        "query_id", "q"),
    "grid": "SELECT query_id, ingest_seq, WOID FROM cases, cleaned",
    "text_pool": _scores(
        "text_probes", "text_docs", "ingest_seq", "WOID, ingest_seq", 200, "FROM grid"),
    "mice_pool": _scores(
        "mice_probes", "mice_docs", "ingest_seq", "WOID, ingest_seq", 10, "FROM grid"),
    "hits": " UNION ALL ".join([
        _hits("text_pool", 10, "A"), _filtered("B"), _filtered("B_prime"),
        _hits("mice_pool", 10, "C")]),
    "relevant": """
      SELECT c.query_id, w.WOID AS woid FROM cases c JOIN cleaned w
        ON w.equipment = c.group_equipment AND w.Type = c.group_type WHERE w.WOID <> c.seed_woid""",
    "judged": """
      SELECT h.*, r.woid IS NOT NULL AS relevant
      FROM hits h LEFT JOIN relevant r ON r.query_id = h.query_id AND r.woid = h.woid""",
    "measured": f"""
      SELECT query_id, strategy, count(*) AS n_hits,
             min(CASE WHEN relevant THEN rank END) AS first_hit_rank, {_FOUND}
      FROM judged GROUP BY ALL""",
    "per_query": f"""
      SELECT c.*, s.strategy, coalesce(n_hits, 0) AS n_hits, first_hit_rank,
             coalesce(1 / first_hit_rank, 0) AS mrr, {_MEASURES}
      FROM cases c CROSS JOIN (SELECT unnest([{_list(STRATEGIES)}]) AS strategy) s
      LEFT JOIN measured m ON m.query_id = c.query_id AND m.strategy = s.strategy""",
    "latencies": """
      SELECT ingest_seq AS query_id, strategy,
             CAST(ingest_seq * 37 % 101 AS DOUBLE) / 10 + 1.5 * place AS latency_ms
      FROM raw CROSS JOIN (VALUES ('A', 0), ('B', 1), ('B_prime', 2), ('C', 3)) s(strategy, place)""",
    "latency": """
      SELECT strategy, avg(latency_ms) AS mean_ms, stddev_pop(latency_ms) AS std_ms,
             quantile_cont(latency_ms, 0.95) AS p95_ms FROM latencies GROUP BY ALL""",
    "compared": f"""
      SELECT *, greatest(B_recall, B_prime_recall, C_recall) - A_recall AS metadata_gain,
             {_BEST} AS best_strategy, {_WORST} AS worst_strategy
      FROM (SELECT query_id, query_text, query_type, group_equipment, group_type, description,
                   n_relevant, {_WIDE} FROM per_query GROUP BY ALL)""",
    "export": """
      SELECT p.description, p.query_type, p.group_equipment AS equipment,
             p.group_type AS facility_type, p.n_relevant, left(p.query_text, 200) AS query_text,
             strategy, round(recall_10, 6) AS recall, round(mrr, 6) AS mrr,
             round(ndcg_10, 6) AS ndcg, first_hit_rank, round(metadata_gain, 6) AS metadata_gain
      FROM per_query p JOIN (SELECT query_id, metadata_gain FROM compared) USING (query_id)""",
    "means": """
      SELECT strategy, avg(recall_1) AS recall_1, avg(recall_5) AS recall_5,
             avg(recall_10) AS recall_10, avg(mrr) AS mrr, avg(ndcg_10) AS ndcg_10,
             any_value(mean_ms) AS avg_latency_ms
      FROM per_query JOIN latency USING (strategy) GROUP BY strategy""",
    "asked": ROUTER_QUERIES.format(raw="raw"),
    "extracted": rf"""
      SELECT query_id, query_text,
             nullif(regexp_extract(query_text, '\b([A-Z]\d{{3,4}})\b', 1), '') AS building_id,
             {_term('lower(query_text)', TYPE_TERMS)} AS building_type,
             {_term('lower(query_text)', EQUIPMENT_TERMS)} AS equipment FROM asked""",
    "routed": """
      SELECT *, CASE WHEN equipment IS NOT NULL AND building_type IS NOT NULL THEN 'mixed'
                     WHEN equipment IS NOT NULL THEN 'equipment'
                     WHEN building_type IS NOT NULL THEN 'type'
                     WHEN building_id IS NOT NULL THEN 'building_id' ELSE 'none' END AS signal,
             CASE WHEN equipment IS NOT NULL OR building_type IS NOT NULL THEN 'B_prime'
                  WHEN building_id IS NOT NULL THEN 'B' ELSE 'A' END AS strategy
      FROM extracted""",
    "labels_first": "SELECT min(vec_id) AS vec_id FROM embeddings GROUP BY label",
    "items": "SELECT item_id AS query_id, text AS query_text FROM benchmark",
    "item_text": _vectors(
        f"(SELECT query_id, '{QUERY_PREFIX}' || query_text AS q FROM items)", "query_id", "q"),
    "item_mice": _vectors(
        f"(SELECT query_id, '{QUERY_PREFIX}{CONTEXT_QUERY_PREFIX}' || query_text AS q FROM items)",
        "query_id", "q"),
    "item_grid": "SELECT query_id, ingest_seq, WOID FROM items, cleaned",
    "item_docs": _vectors("benchmark", "item_id", "text"),
    "one_query": "SELECT 1::BIGINT AS query_id, 'pump in the research hall leaks again' AS query_text",
    "one_probe": _vectors(
        f"(SELECT query_id, '{QUERY_PREFIX}' || query_text AS q FROM one_query)", "query_id", "q"),
    "members": """
      SELECT query_id, woid, """ + ", ".join(
        f"bool_or(strategy = '{s}') AS {s}" for s in STRATEGIES) + " FROM hits GROUP BY ALL",
    "overlap": """
      SELECT query_id, n_union, n_common,
             CAST(round_even(n_common / n_union * 100, 0) AS INTEGER) AS overlap_pct
      FROM (SELECT query_id, count(*) AS n_union, count(CASE WHEN n = active THEN 1 END) AS n_common
            FROM (SELECT query_id, woid, count(DISTINCT strategy) AS n FROM hits GROUP BY ALL)
            JOIN (SELECT query_id, count(DISTINCT strategy) AS active FROM hits GROUP BY ALL)
            USING (query_id) GROUP BY ALL)""",
}

_SCORE = "round(CAST(score AS DOUBLE), 6) AS score"
_HIT = f"SELECT query_id, strategy, rank, woid, {_SCORE} FROM"
_STORED = " UNION ALL ".join(
    f"SELECT ingest_seq, WOID, '{track}' AS track, b AS dimension, round(v, 6) AS value "
    f"FROM {track}_docs JOIN cleaned USING (ingest_seq)" for track in ("text", "mice"))
_DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def _checks() -> str:
    """All rows of the quality report over the table ``filled``."""
    counters = {("missing", c): f"{c} = ''" for c in CLEAN_COLUMNS}
    counters["placeholder_building", "BuildingID"] = "starts_with(BuildingID, 'UNK')"
    counters["empty_text", "WODescription"] = "WODescription = ''"
    counters["short_text", "WODescription"] = "length(WODescription) < 20"
    counters["ready_rows", ""] = "length(WODescription) > 30 AND BuildingID <> '' AND Type <> ''"
    rows = ["SELECT 'rows' AS \"check\", '' AS \"column\", count(*)::DOUBLE AS value FROM filled"]
    for (check, column), test in counters.items():
        n = f"count(CASE WHEN {test} THEN 1 END)"
        rows.append(f"SELECT '{check}', '{column}', {n}::DOUBLE FROM filled")
        if not check.endswith("_text"):
            rows.append(f"SELECT '{check}_share', '{column}', round({n} / count(*), 6) FROM filled")
    rows += [f"SELECT 'present', '{c}', 1.0::DOUBLE" for c in CLEAN_COLUMNS]
    rows += [f"SELECT \"check\", '', value::DOUBLE FROM ({_DUPLICATES})"]
    rows += [f"SELECT 'n_distinct', '{c}', count(DISTINCT {c})::DOUBLE FROM filled"
             for c in ("BuildingID", "Type")]
    return " UNION ALL ".join(rows)


_DUPLICATES = f"""
  SELECT 'duplicate_woid' AS "check", count(*) - count(DISTINCT WOID) AS value FROM filled
  UNION ALL SELECT 'duplicate_row', (SELECT count(*) FROM filled) - (SELECT count(*) FROM
    (SELECT DISTINCT {', '.join(CLEAN_COLUMNS)} FROM filled))"""


def _k_rows(metric: str) -> str:
    return " UNION ALL ".join(
        f"SELECT query_id, strategy, {k} AS k, round({metric}_{k}, 6) AS {metric} FROM per_query"
        for k in _KS)


def _histogram(source: str, value: str, bins: int, by: str = "") -> str:
    key = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    return f"""
      SELECT {key}bin, round(lo + bin * (hi - lo) / {bins}, 6) AS lower, count(*) AS n_values
      FROM (SELECT *, CASE WHEN hi = lo THEN 0 ELSE
              least(CAST(floor((v - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1}) END AS bin
            FROM (SELECT {key}{value} AS v, min({value}) OVER ({over}) AS lo,
                         max({value}) OVER ({over}) AS hi FROM {source}))
      GROUP BY ALL"""


_GAIN = "round(metadata_gain, 6) AS metadata_gain"
_CARD = f"""
  SELECT c.query_id, left(query_text, 120) AS query_text, query_type, n_relevant, {_GAIN},
         best_strategy, rank, j.woid, {_SCORE}, relevant, left(w.WODescription, 60) AS preview
  FROM {{source}} c LEFT JOIN (SELECT * FROM judged WHERE rank <= 3) j
    ON j.query_id = c.query_id AND j.strategy = c.best_strategy
  LEFT JOIN cleaned w ON w.WOID = j.woid"""


def _types(prefix: str, condition: str) -> str:
    return ", ".join(
        f"round(coalesce(avg(CASE WHEN {condition} THEN {m}_{k} END), 0), 6) AS {m}_{prefix}_{k}"
        for m in ("recall", "ndcg") for k in _KS)


def _millis(x: str) -> str:
    """Three digits; a mean of exactly x.xxx5 must not fall to the order of summation."""
    return f"round(round({x}, 12), 3)"


_SEMANTIC, _CONSTRAINED = "query_type = 'semantic'", "query_type <> 'semantic'"

def _principal(statement: str, squarings: int = 18) -> str:
    """Two leading eigenvectors of the covariance: squaring it again and again leaves one direction,
    which is then taken out of it. The largest entry of an axis is positive.
    """
    parts = ["""entries AS MATERIALIZED (
        SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)""",
        """centred AS MATERIALIZED (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS v FROM entries)""",
        """cov_1 AS MATERIALIZED (
        SELECT a.i, b.i AS j, sum(a.v * b.v) / (SELECT count(*) - 1 FROM embeddings) AS c
        FROM centred a JOIN centred b USING (vec_id) GROUP BY ALL)"""]
    for n in (1, 2):
        before = f"cov_{n}"
        for step in range(squarings):
            name = f"power_{n}_{step}"
            parts.append(f"""{name} AS MATERIALIZED (
              SELECT a.i, b.j, sum(a.c * b.c) / (SELECT sum(c * c) FROM {before}) AS c
              FROM {before} a JOIN {before} b ON a.j = b.i GROUP BY ALL)""")
            before = name
        parts += [
            f"""axis_{n} AS MATERIALIZED (
              SELECT i, c / sqrt(sum(c * c) OVER ()) * sign(arg_max(c, abs(c)) OVER ()) AS w FROM {before}
              WHERE j = (SELECT arg_max(i, c) FROM {before} WHERE i = j))""",
            f"""value_{n} AS MATERIALIZED (
              SELECT sum(p.w * c * q.w) AS variance FROM cov_{n} JOIN axis_{n} p USING (i)
              JOIN axis_{n} q ON q.i = j)""",
        ]
        if n == 1:
            parts.append("""cov_2 AS MATERIALIZED (
              SELECT a.i, a.j, c - variance * p.w * q.w AS c FROM cov_1 a JOIN axis_1 p USING (i)
              JOIN axis_1 q ON q.i = a.j CROSS JOIN value_1)""")
    return "WITH " + ", ".join(parts) + " " + statement


_STATEMENTS = {
    # Sources and sinks
    "csv_raw_scan": "SELECT row_number() OVER (ORDER BY ingest_seq) - 1 AS position, "
        + ", ".join(f"nullif({_na(c)}, '') AS {c}" for c in RAW_COLUMNS) + " FROM raw",
    "csv_preprocessed_scan": "SELECT row_number() OVER (ORDER BY ingest_seq) - 1 AS position, "
        "* EXCLUDE (ingest_seq) FROM filled",
    "csv_clean_scan": "SELECT row_number() OVER (ORDER BY ingest_seq) - 1 AS position, "
        + ", ".join(f"{_na(c)} AS {c}" for c in CLEAN_COLUMNS) + " FROM cleaned",
    "chunked_scan": """
      SELECT CAST(floor(i / 100) AS BIGINT) AS chunk, count(*) AS n_rows
      FROM (SELECT row_number() OVER (ORDER BY ingest_seq) - 1 AS i FROM cleaned) GROUP BY ALL""",
    "first_rows_scan": "FROM cleaned ORDER BY ingest_seq LIMIT 50",
    "vector_table_append": _STORED,
    "vector_table_open": "SELECT 'absent' AS state, 0::BIGINT AS n_rows "
        "UNION ALL SELECT 'stored', count(*) FROM cleaned",
    "stream_ingest": _STORED,
    "stream_ingest_progress": "SELECT 4::BIGINT AS completed_chunks, "
        "count(*) AS total_rows_processed, true AS completed FROM cleaned",
    "stage_skip": "FROM cleaned",
    "vector_table_replay": _STORED,
    "vector_table_history": """
      SELECT row_number() OVER (ORDER BY place) - 1 AS version, batch, n_rows FROM (
        SELECT CASE Type WHEN 'research' THEN 0 WHEN 'teaching' THEN 1 ELSE 2 END AS place,
               CASE WHEN Type IN ('research', 'teaching') THEN Type ELSE 'rest' END AS batch,
               count(*) AS n_rows FROM cleaned GROUP BY ALL)""",
    "vector_table_snapshot": """
      SELECT ingest_seq, WOID, Type, Type AS batch_id FROM cleaned
      WHERE Type IN ('research', 'teaching')""",
    "table_stats": f"SELECT count(*) AS text_total, count(*) AS mice_total, "
        f"{EMBEDDING_DIM} AS dim FROM cleaned",
    "metrics_json_sink": f"""
      SELECT strategy, count(*) AS n_queries, round(avg(mrr), 6) AS mrr, {_AVERAGES},
             {_types('semantic', _SEMANTIC)}, {_types('constrained', _CONSTRAINED)},
             {_millis('any_value(mean_ms)')} AS mean_ms, {_millis('any_value(std_ms)')} AS std_ms,
             {_millis('any_value(p95_ms)')} AS p95_ms
      FROM per_query JOIN latency USING (strategy) GROUP BY strategy""",
    "metrics_json_scan": f"""
      SELECT strategy, round(recall_1, 6) AS recall_1, round(recall_5, 6) AS recall_5,
             round(recall_10, 6) AS recall_10, round(mrr, 6) AS mrr,
             round(ndcg_10, 6) AS ndcg_10, {_millis('avg_latency_ms')} AS avg_latency_ms FROM means""",
    "comparison_csv_sink": "FROM export",
    "comparison_csv_scan": "FROM export",
    "vector_text_pairs": "SELECT vec_id, text, len(embedding) AS dim "
        "FROM embeddings JOIN documents ON vec_id = doc_id",
    "npy_vector_scan": """
      SELECT position, unnest(range(len(embedding))) AS dimension,
             round(CAST(unnest(embedding) AS DOUBLE), 6) AS value
      FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS position, embedding FROM embeddings)""",
    "npy_text_pairs": """
      SELECT row_number() OVER (ORDER BY vec_id) - 1 AS position, text, len(embedding) AS dim,
             round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total
      FROM embeddings JOIN documents ON vec_id = doc_id""",
    # Projections and cleaning
    "search_text_form": f"SELECT doc_id, {_search_text('text')} AS search_text FROM documents",
    "strict_text_form": f"SELECT doc_id, {_strict_text('text')} AS strict_text FROM documents",
    "preprocess_rows": "FROM preprocessed",
    "standard_building_ids": f"SELECT ingest_seq, {_building('BuildingID')} AS BuildingID FROM raw",
    "rows_with_woid": "SELECT ingest_seq, WOID FROM filled WHERE WOID <> ''",
    "first_row_per_woid": "SELECT ingest_seq, WOID, WODescription FROM firsts",
    "long_descriptions": "SELECT ingest_seq, WOID FROM firsts WHERE length(WODescription) >= 20",
    "missing_building_mask": f"SELECT ingest_seq, {_lacks('BuildingID')} AS missing FROM raw",
    "placeholder_buckets": f"""
      SELECT ingest_seq, CASE WHEN lacks THEN 'UNK_' || CAST((row_number() OVER (
        PARTITION BY lacks ORDER BY ingest_seq) - 1) % 20 AS VARCHAR) ELSE BuildingID END AS BuildingID
      FROM (SELECT *, {_lacks('BuildingID')} AS lacks FROM raw)""",
    "default_values": """
      SELECT ingest_seq,
        CASE WHEN BuildingName = '' THEN 'UNKNOWN_BUILDING' ELSE BuildingName END AS BuildingName,
        CASE WHEN Type = '' THEN 'UNKNOWN_TYPE' ELSE Type END AS Type,
        CASE WHEN WOEndDate = '' THEN 'ONGOING' ELSE WOEndDate END AS WOEndDate FROM filled""",
    "enforced_schema": """
      SELECT ingest_seq, BuildingID, BuildingName, Type, WOID, WODescription, WOStartDate,
             '' AS WOEndDate, '' AS equipment FROM raw""",
    "clean_work_orders": "FROM cleaned",
    "cleaning_counts": """
      SELECT r AS rows_read, r - w AS missing_woid, w - d AS duplicate_woid,
             d - k AS short_description, k AS rows_kept
      FROM (SELECT count(*) AS r, count(CASE WHEN WOID <> '' THEN 1 END) AS w FROM filled),
           (SELECT count(*) AS d FROM firsts), (SELECT count(*) AS k FROM cleaned)""",
    "text_representation": "SELECT WOID, text_repr FROM represented",
    "mice_representation": "SELECT WOID, mice_repr FROM represented",
    "mice_display_form": f"SELECT WOID, {_mice('chr(10)')} AS mice_repr FROM cleaned",
    "representations": f"""SELECT *, {_TEXT} AS text_repr, {_mice("' '")} AS mice_repr FROM filled""",
    "metadata_filter": "SELECT WOID, Type, equipment FROM cleaned WHERE Type = 'research'",
    "filter_is_empty": "SELECT query_id, building_id IS NULL AND building_type IS NULL "
        "AND equipment IS NULL AS is_empty FROM extracted",
    "hit_projection": f"""
      SELECT query_id, h.woid, BuildingID AS building_id, BuildingName AS building_name,
             Type AS type, equipment, WODescription AS wo_description, {_SCORE}, strategy
      FROM hits h JOIN cleaned w ON w.WOID = h.woid""",
    "browse_filter": """
      SELECT WOID, BuildingID, BuildingName, Type, equipment, WODescription FROM cleaned
      WHERE Type = 'research' AND regexp_matches(WODescription, '(?i)ing|ed')
      ORDER BY ingest_seq LIMIT 200""",
    "indexed_browse": """
      SELECT WOID, BuildingID, BuildingName, Type, equipment, WODescription FROM cleaned
      WHERE Type = 'research'
        AND regexp_matches(WODescription, '(?i)worthless|thouin(or|ed)|[st]ionan.*thth(an|ing)')
      ORDER BY ingest_seq LIMIT 200""",
    "point_lookup": f"SELECT ingest_seq, {', '.join(RAW_COLUMNS)} FROM raw WHERE WOID = 'W8' "
        "ORDER BY ingest_seq LIMIT 1",
    "indexed_point_lookup": f"SELECT ingest_seq, {', '.join(RAW_COLUMNS)} FROM raw WHERE WOID = 'W8' "
        "ORDER BY ingest_seq LIMIT 1",
    "indexed_lookups": f"SELECT ingest_seq, {', '.join(RAW_COLUMNS)} FROM raw "
        "WHERE WOID IN ('W8', 'W100', 'W101', 'W102') "
        "QUALIFY row_number() OVER (PARTITION BY WOID ORDER BY ingest_seq) = 1",
    "vector_lookup": f"""
      SELECT w.WOID, d.i AS dimension, round(coalesce(v, 0), 6) AS value
      FROM (SELECT * FROM cleaned WHERE WOID = 'W8') w CROSS JOIN range({EMBEDDING_DIM}) d(i)
      LEFT JOIN text_docs t ON t.ingest_seq = w.ingest_seq AND t.b = d.i""",
    "preview_texts": """
      SELECT WOID, concat(WOID, chr(10), 'Equipment: ', equipment, chr(10), 'Type: ', Type,
                          chr(10), left(WODescription, 80), '…') AS preview FROM cleaned""",
    # Quality
    "schema_check": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", true AS present,
            count(nullif({c}, '')) AS n_values FROM raw"""
        for c in CLEAN_COLUMNS if c in RAW_COLUMNS)
        + " UNION ALL SELECT 'equipment', false, 0::BIGINT",
    "missing_values": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(CASE WHEN {c} = '' THEN 1 END) AS missing,
            round(count(CASE WHEN {c} = '' THEN 1 END) / count(*), 6) AS share FROM filled"""
        for c in CLEAN_COLUMNS),
    "placeholder_buildings": """
      SELECT count(CASE WHEN starts_with(BuildingID, 'UNK') THEN 1 END) AS invalid,
             round(count(CASE WHEN starts_with(BuildingID, 'UNK') THEN 1 END) / count(*), 6) AS share
      FROM cleaned""",
    "text_quality": """
      SELECT count(CASE WHEN WODescription = '' THEN 1 END) AS empty_text,
             count(CASE WHEN length(WODescription) < 20 THEN 1 END) AS short_text FROM filled""",
    "duplicate_rows": _DUPLICATES,
    "cardinality": """
      SELECT 'BuildingID' AS "column", count(DISTINCT BuildingID) AS n_distinct FROM filled
      UNION ALL SELECT 'Type', count(DISTINCT Type) FROM filled""",
    "distinct_sketches": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n_values, count(DISTINCT {c}) AS n_exact, "
        "true AS within_bound FROM cleaned" for c in ("BuildingID", "Type", "equipment", "WOID")),
    "embedding_readiness": """
      SELECT good_rows, total, round(good_rows / total, 6) AS score,
             CASE WHEN good_rows / total > 0.85::DOUBLE THEN 'READY'
                  WHEN good_rows / total > 0.6::DOUBLE THEN 'USABLE' ELSE 'NOT_READY' END AS verdict
      FROM (SELECT count(CASE WHEN length(WODescription) > 30 AND BuildingID <> ''
                              AND Type <> '' THEN 1 END) AS good_rows, count(*) AS total FROM filled)""",
    "quality_report": _checks(),
    "corpus_headline": """
      SELECT count(*) AS n_rows, count(DISTINCT BuildingID) AS n_buildings,
             count(DISTINCT Type) AS n_types, count(DISTINCT equipment) AS n_equipment FROM cleaned""",
    "top_types": "SELECT Type AS value, count(*) AS n_rows FROM cleaned GROUP BY ALL "
        "ORDER BY n_rows DESC, value LIMIT 10",
    "top_equipment": "SELECT equipment AS value, count(*) AS n_rows FROM cleaned GROUP BY ALL "
        "ORDER BY n_rows DESC, value LIMIT 10",
    "facet_values": "SELECT DISTINCT Type AS value FROM cleaned",
    # Vectors
    "facet_equipment": "SELECT DISTINCT equipment AS value FROM cleaned",
    # Vectors
    "document_vectors": "SELECT WOID, b AS dimension, round(v, 6) AS value "
        "FROM mice_docs JOIN cleaned USING (ingest_seq)",
    "query_vectors": "SELECT query_id, b AS dimension, round(v, 6) AS value FROM item_text",
    "dimension_check": "SELECT vec_id, len(embedding) AS dim FROM embeddings",
    "search_stored_vectors": f"""
      SELECT query_id, vec_id, label, rank, {_SCORE} FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
        FROM (SELECT q.vec_id AS query_id, e.vec_id, e.label,
                     CAST({_DOT.format(a='q.embedding', b='e.embedding')} AS FLOAT) AS score
              FROM embeddings q SEMI JOIN labels_first f ON f.vec_id = q.vec_id
              CROSS JOIN embeddings e)) WHERE rank <= 10""",
    "search_text_track": f"SELECT query_id, pool_rank AS rank, WOID, {_SCORE} FROM ("
        + _scores("item_text", "text_docs", "ingest_seq", "WOID, ingest_seq", 10, "FROM item_grid")
        + ")",
    "clustered_search_vectors": f"""
      SELECT query_id, vec_id, label, rank, {_SCORE} FROM (
        SELECT q.vec_id AS query_id, e.vec_id, e.label,
               CAST({_DOT.format(a='q.embedding', b='e.embedding')} AS FLOAT) AS score,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY
                 CAST({_DOT.format(a='q.embedding', b='e.embedding')} AS FLOAT) DESC, e.vec_id) AS rank
        FROM embeddings q SEMI JOIN labels_first f ON f.vec_id = q.vec_id
        CROSS JOIN embeddings e) WHERE rank <= 10""",
    "clustered_search_text_track": f"SELECT query_id, pool_rank AS rank, WOID, {_SCORE} FROM ("
        + _scores("item_text", "text_docs", "ingest_seq", "WOID, ingest_seq", 10, "FROM item_grid")
        + ")",
    "search_mice_track": f"SELECT query_id, pool_rank AS rank, WOID, {_SCORE} FROM ("
        + _scores("item_mice", "mice_docs", "ingest_seq", "WOID, ingest_seq", 10, "FROM item_grid")
        + ")",
    "search_short_table": f"SELECT query_id, pool_rank AS rank, item_id, {_SCORE} FROM ("
        + _scores("text_probes", "item_docs", "item_id", "item_id", 200,
                  "SELECT query_id, item_id FROM cases, benchmark") + ")",
    "vector_sanity": f"""
      SELECT count(embedding) AS n_rows, max(len(embedding)) AS dim, 'float' AS element_type,
             round(avg(n), 6) AS mean_norm, round(stddev_pop(n), 6) AS std_norm,
             bool_or(list_bool_or(list_transform(embedding, lambda x: isnan(x)))) AS has_nan,
             bool_or(list_bool_or(list_transform(embedding, lambda x: isinf(x)))) AS has_inf
      FROM (SELECT *, sqrt({_DOT.format(a='embedding', b='embedding')}) AS n FROM embeddings)""",
    "nearest_to_row": f"""
      SELECT query_id, rank, vec_id, {_SCORE} FROM (
        SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (
          SELECT q.vec_id AS query_id, e.vec_id, CAST(
            {_DOT.format(a='q.embedding', b='e.embedding')}
            / sqrt({_DOT.format(a='q.embedding', b='q.embedding')})
            / sqrt({_DOT.format(a='e.embedding', b='e.embedding')}) AS FLOAT) AS score
          FROM embeddings q, embeddings e WHERE q.vec_id = 100)) WHERE rank <= 6""",
    "average_similarity": f"""
      SELECT (SELECT count(*) FROM embeddings) AS n_rows,
             round(sum(s * s) / (SELECT count(*) FROM embeddings) ** 2, 6) AS average_similarity
      FROM (SELECT p, sum(x) AS s FROM (
              SELECT unnest(range(len(embedding))) AS p, CAST(unnest(embedding) AS DOUBLE)
                     / sqrt({_DOT.format(a='embedding', b='embedding')}) AS x FROM embeddings)
            GROUP BY p)""",
    "vector_sample": "SELECT WOID, Type, equipment FROM cleaned "
        "ORDER BY md5('42|' || WOID), WOID LIMIT 100",
    "principal_components": _principal(
        """SELECT vec_id, label, round(sum(v * a), 6) AS x, round(sum(v * b), 6) AS y FROM (
             SELECT c.vec_id, coalesce(CAST(e.label AS VARCHAR), 'unknown') AS label, v, p.w AS a, q.w AS b
             FROM centred c JOIN embeddings e USING (vec_id) JOIN axis_1 p USING (i) JOIN axis_2 q USING (i))
           GROUP BY ALL"""),
    "principal_component_variance": _principal(
        """SELECT 1 AS component, round((SELECT variance FROM value_1) / sum(c), 6) AS variance_share
           FROM cov_1 WHERE i = j
           UNION ALL SELECT 2, round((SELECT variance FROM value_2) / sum(c), 6) FROM cov_1 WHERE i = j"""),
    "vector_heat_map": """
      SELECT vec_id, unnest(range(20)) AS dimension,
             round(CAST(unnest(embedding[1:20]) AS DOUBLE), 6) AS value FROM embeddings""",
    "vector_grid": """
      SELECT vec_id, i // 32 AS grid_row, i % 32 AS grid_column, i AS dimension, value FROM (
        SELECT vec_id, unnest(range(len(embedding) // 32 * 32)) AS i,
               round(CAST(unnest(embedding[1:len(embedding) // 32 * 32]) AS DOUBLE), 6) AS value
        FROM embeddings)""",
    "ad_hoc_search": f"{_HIT} (SELECT query_id, 'A' AS strategy, pool_rank AS rank, WOID AS woid, "
        "score FROM (" + _scores(
            "one_probe", "text_docs", "ingest_seq", "WOID, ingest_seq", 3,
            "SELECT query_id, ingest_seq, WOID FROM one_query, cleaned") + "))",
    # Strategies and routing
    "hits_one_per_woid": f"""
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, woid) AS rank,
             woid, ingest_seq, {_SCORE}
      FROM (
        SELECT * FROM (
          SELECT q.vec_id AS query_id, ingest_seq, WOID AS woid,
                 CAST({_DOT.format(a='q.embedding', b='w.stored_vec')} AS FLOAT) AS score
          FROM embeddings q SEMI JOIN labels_first f ON f.vec_id = q.vec_id
          CROSS JOIN (SELECT * FROM raw WHERE stored_vec IS NOT NULL) w
          QUALIFY row_number() OVER (PARTITION BY q.vec_id
                                     ORDER BY score DESC, WOID, ingest_seq) <= 200)
        QUALIFY row_number() OVER (PARTITION BY query_id, woid ORDER BY score DESC, ingest_seq) = 1)""",
    "strategy_a": f"{_HIT} hits WHERE strategy = 'A'",
    "strategy_b": f"{_HIT} hits WHERE strategy = 'B'",
    "strategy_b_prime": f"{_HIT} hits WHERE strategy = 'B_prime'",
    "strategy_c": f"{_HIT} hits WHERE strategy = 'C'",
    "retrieve_named": f"{_HIT} hits JOIN (SELECT query_id, query_text FROM cases) USING (query_id) "
        f"WHERE strategy = [{_list(STRATEGIES)}][length(query_text) % 4 + 1]",
    "retrieve_all": f"{_HIT} hits",
    "route_and_retrieve": f"""
      WITH routed_cases AS (
        SELECT query_id, CASE WHEN e IS NOT NULL OR t IS NOT NULL THEN 'B_prime'
                              WHEN b IS NOT NULL THEN 'B' ELSE 'A' END AS strategy, b, t, e
        FROM (SELECT query_id,
                     nullif(regexp_extract(query_text, '\\b([A-Z]\\d{{3,4}})\\b', 1), '') AS b,
                     {_term('lower(query_text)', TYPE_TERMS)} AS t,
                     {_term('lower(query_text)', EQUIPMENT_TERMS)} AS e FROM cases))
      SELECT query_id, strategy, r AS rank, WOID AS woid, {_SCORE} FROM (
        SELECT p.query_id, c.strategy, p.WOID, p.score,
               row_number() OVER (PARTITION BY p.query_id ORDER BY pool_rank) AS r
        FROM text_pool p JOIN cleaned w USING (ingest_seq)
        JOIN routed_cases c ON c.query_id = p.query_id
        WHERE (c.strategy = 'A' AND pool_rank <= 10) OR (c.strategy <> 'A'
          AND (b IS NULL OR b = BuildingID) AND (t IS NULL OR t = Type)
          AND (e IS NULL OR e = equipment))) WHERE r <= 10""",
    "stream_retrieval": f"""
      WITH wanted AS (
        SELECT query_id,
               nullif(regexp_extract(query_text, '\\b([A-Z]\\d{{3,4}})\\b', 1), '') AS b,
               {_term('lower(query_text)', TYPE_TERMS)} AS t,
               {_term('lower(query_text)', EQUIPMENT_TERMS)} AS e FROM cases),
      fitting AS (
        SELECT p.*, row_number() OVER (PARTITION BY p.query_id ORDER BY pool_rank) AS r
        FROM text_pool p JOIN cleaned w USING (ingest_seq) JOIN wanted c ON c.query_id = p.query_id
        WHERE (b IS NULL OR b = BuildingID) AND (t IS NULL OR t = Type) AND (e IS NULL OR e = equipment))
      SELECT query_id, 'A' AS strategy, pool_rank AS rank, WOID AS woid, {_SCORE}
      FROM text_pool WHERE pool_rank <= 10
      UNION ALL SELECT query_id, 'C', pool_rank, WOID, {_SCORE} FROM mice_pool WHERE pool_rank <= 10
      UNION ALL SELECT query_id, s, r, WOID, {_SCORE}
      FROM fitting CROSS JOIN (VALUES ('B'), ('B_prime')) x(s) WHERE r <= 10""",
    "building_codes": "SELECT query_id, building_id FROM extracted",
    "vocabulary_terms": "SELECT query_id, equipment, building_type FROM extracted",
    "vocabulary_join": "SELECT query_id, equipment, building_type FROM extracted",
    "vocabulary_of_sources": rf"""
      WITH names AS (
        SELECT lower(BuildingName) AS term FROM raw WHERE BuildingName <> ''
        UNION SELECT lower(SystemDescription) FROM raw),
      reports AS (
        SELECT ingest_seq, 'leak in ' || lower(BuildingName) || ' near ' || lower(SystemDescription) AS report
        FROM raw)
      SELECT ingest_seq, arg_min(term, (-length(term), term)) AS term
      FROM (SELECT *, {_cut('report', f'([{_W}]+)', '⟦\\1⟧')} AS words FROM reports)
      JOIN (SELECT *, {_cut('term', f'([{_W}]+)', '⟦\\1⟧')} AS marked FROM names)
      ON contains(words, marked) GROUP BY ingest_seq""",
    "classify_queries": "FROM routed",
    "explain_routing": """
      SELECT query_id, query_text, signal, coalesce(building_id, '—') AS building_id,
             coalesce(building_type, '—') AS building_type, coalesce(equipment, '—') AS equipment,
             strategy FROM routed""",
    "override_filters": """
      SELECT query_id, coalesce(nullif(BuildingID, ''), building_id) AS building_id,
             coalesce(nullif(Type, ''), building_type) AS building_type, equipment
      FROM routed JOIN (SELECT ingest_seq AS query_id, BuildingID, Type FROM raw) USING (query_id)""",
    "query_classes": f"""
      SELECT query_id, CASE WHEN signal = 'none' THEN 'semantic' ELSE 'constrained' END AS query_class,
             len(regexp_extract_all(query_text, '[^{_S}]+')) AS n_tokens FROM routed""",
    "stream_routing": f"""
      SELECT * REPLACE (CAST(query_id AS VARCHAR) AS query_id),
             CASE WHEN signal = 'none' THEN 'semantic' ELSE 'constrained' END AS query_class,
             len(regexp_extract_all(query_text, '[^{_S}]+')) AS n_tokens FROM routed""",
    # Evaluation
    "relevance_groups": "FROM groups",
    "seed_documents": "FROM seeds",
    "relevant_rows": "FROM relevant",
    "stripped_identifiers": f"SELECT WOID, {_plain('WODescription', 'BuildingName')} AS stripped "
        "FROM cleaned",
    "semantic_queries": f"SELECT WOID, {_plain('WODescription', 'BuildingName')} AS query_text "
        "FROM cleaned",
    "constrained_queries": "SELECT WOID, "
        + _constrained("base", "equipment", "Type") + " AS query_text FROM (SELECT *, "
        + _plain("WODescription", "BuildingName") + " AS base FROM cleaned)",
    "case_types": "SELECT query_type, count(*) AS n_cases FROM cases GROUP BY ALL",
    "evaluation_cases": "FROM cases",
    "evaluation_cases_default": """
      SELECT query_id, constrained AS query_text, CAST(NULL AS VARCHAR) AS building_id,
             group_type AS building_type, group_equipment AS equipment,
             'constrained' AS query_type, group_equipment, group_type,
             concat('[constrained] ', group_equipment, '/', group_type, ' src:', seed_woid)
             AS description, seed_woid, n_relevant
      FROM candidates WHERE length(constrained) >= 10
      QUALIFY row_number() OVER (ORDER BY query_id) <= 300""",
    "recall_at_k": _k_rows("recall"),
    "reciprocal_rank": "SELECT query_id, strategy, round(mrr, 6) AS mrr FROM per_query",
    "ndcg_at_k": _k_rows("ndcg"),
    "first_hit_rank": "SELECT query_id, strategy, first_hit_rank FROM per_query",
    "strategy_metrics": f"SELECT strategy, count(*) AS n_queries, round(avg(mrr), 6) AS mrr, "
        f"{_AVERAGES} FROM per_query GROUP BY strategy",
    "work_order_pipeline": f"SELECT strategy, count(*) AS n_queries, round(avg(mrr), 6) AS mrr, "
        f"{_AVERAGES} FROM per_query GROUP BY strategy",
    "metrics_by_type": f"""
      SELECT strategy, 'all' AS query_type, count(*) AS n_queries, {_AVERAGES}
      FROM per_query GROUP BY strategy
      UNION ALL BY NAME
      SELECT strategy, query_type, count(*) AS n_queries, {_AVERAGES}
      FROM per_query GROUP BY strategy, query_type""",
    "latency_stats": "SELECT strategy, round(mean_ms, 6) AS mean_ms, round(std_ms, 6) AS std_ms, "
        "round(p95_ms, 6) AS p95_ms FROM latency",
    "latency_sketches": "SELECT strategy, n AS n_values, round(mean_ms, 6) AS mean_ms, "
        "round(std_ms, 6) AS std_ms, true AS within_bound FROM latency JOIN "
        "(SELECT strategy, count(*) AS n FROM latencies GROUP BY ALL) USING (strategy)",
    "evaluate_strategies": "SELECT query_id, query_type, description, n_relevant, strategy, n_hits, "
        "first_hit_rank, round(mrr, 6) AS mrr, " + ", ".join(
            f"round({m}_{k}, 6) AS {m}_{k}" for k in _KS for m in ("recall", "ndcg"))
        + " FROM per_query",
    "summary_table": f"""
      SELECT strategy, count(*) AS n_queries, count(CASE WHEN {_SEMANTIC} THEN 1 END) AS n_semantic,
             count(CASE WHEN {_CONSTRAINED} THEN 1 END) AS n_constrained,
             round(avg(mrr), 6) AS mrr, {_AVERAGES},
             round(coalesce(avg(CASE WHEN {_SEMANTIC} THEN recall_10 END), 0), 6) AS recall_semantic,
             round(coalesce(avg(CASE WHEN {_CONSTRAINED} THEN recall_10 END), 0), 6)
             AS recall_constrained,
             round(any_value(mean_ms), 6) AS mean_ms, round(any_value(p95_ms), 6) AS p95_ms
      FROM per_query JOIN latency USING (strategy) GROUP BY strategy""",
    # Analysis
    "compare_strategies": "SELECT query_id, query_type, group_equipment, group_type, description, "
        "n_relevant, " + ", ".join(
            f"round({s}_{m}, 6) AS {s}_{m}" for s in STRATEGIES for m in ("recall", "mrr", "ndcg"))
        + ", " + ", ".join(f"{s}_first_hit" for s in STRATEGIES) + " FROM compared",
    "metadata_gain": f"SELECT query_id, {_GAIN} FROM compared",
    "best_and_worst": "SELECT query_id, best_strategy, worst_strategy FROM compared",
    "helped_queries": f"SELECT query_id, description, {_GAIN} FROM compared "
        "WHERE metadata_gain >= 0.2::DOUBLE",
    "hurt_queries": f"SELECT query_id, description, {_GAIN} FROM compared "
        "WHERE -metadata_gain >= 0",
    "win_matrix": " UNION ALL ".join(
        f"""SELECT '{a}' AS s1, '{b}' AS s2, count(CASE WHEN {a}_recall > {b}_recall THEN 1 END) AS wins,
            count(CASE WHEN {a}_recall < {b}_recall THEN 1 END) AS losses,
            count(CASE WHEN {a}_recall = {b}_recall THEN 1 END) AS ties FROM compared"""
        for i, a in enumerate(STRATEGIES) for b in STRATEGIES[i + 1:]),
    "impact_summary": """
      SELECT *, n_queries - n_helped - n_hurt AS n_neutral,
             round(n_helped / greatest(n_queries, 1), 6) AS helped_share,
             round(n_hurt / greatest(n_queries, 1), 6) AS hurt_share,
             round((n_queries - n_helped - n_hurt) / greatest(n_queries, 1), 6) AS neutral_share
      FROM (SELECT count(*) AS n_queries,
              count(CASE WHEN metadata_gain >= 0.1::DOUBLE THEN 1 END) AS n_helped,
              count(CASE WHEN -metadata_gain >= 0.1::DOUBLE THEN 1 END) AS n_hurt,
              round(max(metadata_gain) FILTER (metadata_gain >= 0.1::DOUBLE), 6) AS largest_gain,
              (SELECT description FROM compared WHERE metadata_gain >= 0.1::DOUBLE
               ORDER BY metadata_gain DESC, query_id LIMIT 1) AS largest_gain_query,
              round(min(metadata_gain) FILTER (-metadata_gain >= 0.1::DOUBLE), 6) AS largest_loss,
              (SELECT description FROM compared WHERE -metadata_gain >= 0.1::DOUBLE
               ORDER BY metadata_gain, query_id LIMIT 1) AS largest_loss_query
            FROM compared)""",
    "query_cards": _CARD.format(source="compared"),
    "analysis_examples": _CARD.format(source="""(
      SELECT * FROM compared
      WHERE metadata_gain >= 0.2::DOUBLE
         OR NOT EXISTS (SELECT 1 FROM compared WHERE metadata_gain >= 0.2::DOUBLE)
      ORDER BY CASE WHEN metadata_gain >= 0.2::DOUBLE THEN -metadata_gain ELSE 0 END, query_id
      LIMIT 5)"""),
    "gain_classes": """
      SELECT count(*) AS total, count(CASE WHEN g > 0.05::DOUBLE THEN 1 END) AS positive,
             count(CASE WHEN g < -0.05::DOUBLE THEN 1 END) AS negative,
             count(CASE WHEN g BETWEEN -0.05::DOUBLE AND 0.05::DOUBLE THEN 1 END) AS neutral
      FROM (SELECT description, arg_min(metadata_gain, strategy) AS g FROM export GROUP BY ALL)""",
    "gain_histogram": _histogram(
        "(SELECT metadata_gain FROM export WHERE strategy = 'A')", "metadata_gain", 40),
    "score_histogram": _histogram(
        f"(SELECT strategy, {_SCORE} FROM hits)", "score", 30, "strategy"),
    "gain_extremes": " UNION ALL ".join(
        f"""(SELECT '{kind}' AS kind, description, query_text, metadata_gain FROM export
            WHERE strategy = 'A' ORDER BY metadata_gain {order}, description LIMIT 1)"""
        for kind, order in (("improved", "DESC"), ("degraded", "ASC"))),
    "best_overall": f"SELECT strategy, round(recall_10, 6) AS recall FROM means "
        f"ORDER BY recall_10 DESC, {_PLACE} LIMIT 1",
    "metrics_reference": "SELECT strategy, " + ", ".join(
        f"round({c}, 4) AS {c}" for c in ("recall_1", "recall_5", "recall_10", "mrr", "ndcg_10"))
        + ", round(round(avg_latency_ms, 12), 1) AS avg_latency_ms FROM means",
    "overlap_summary": "FROM overlap",
    "unique_hits": "SELECT query_id, min(strategy) AS strategy, woid FROM hits "
        "GROUP BY query_id, woid HAVING count(DISTINCT strategy) = 1",
    "membership_table": "FROM members",
    "set_differences": """
      SELECT query_id, count(CASE WHEN A AND NOT C THEN 1 END) AS only_left,
             count(CASE WHEN C AND NOT A THEN 1 END) AS only_right
      FROM members GROUP BY query_id""",
    "observations": """
      SELECT query_id, n_A, n_B, n_B_prime, n_B - n_A AS delta_b, n_B_prime - n_A AS delta_b_prime,
             overlap_pct, CASE WHEN overlap_pct >= 80 THEN 'similar'
                               WHEN overlap_pct >= 40 THEN 'moderate' ELSE 'high' END AS divergence,
             CASE WHEN coalesce(building_id, '') = '' AND coalesce(building_type, '') = ''
                       AND coalesce(equipment, '') = '' THEN 'no_metadata'
                  WHEN n_B_prime < n_A THEN 'fewer' WHEN n_B_prime > n_A THEN 'more'
                  ELSE 'unchanged' END AS metadata_effect
      FROM (SELECT query_id, building_id, building_type, equipment,
                   coalesce(overlap_pct, 0) AS overlap_pct, coalesce(n_A, 0) AS n_A,
                   coalesce(n_B, 0) AS n_B, coalesce(n_B_prime, 0) AS n_B_prime
      FROM cases LEFT JOIN overlap USING (query_id) LEFT JOIN (
        SELECT query_id, count(CASE WHEN strategy = 'A' THEN 1 END) AS n_A,
               count(CASE WHEN strategy = 'B' THEN 1 END) AS n_B,
               count(CASE WHEN strategy = 'B_prime' THEN 1 END) AS n_B_prime
        FROM hits GROUP BY query_id) USING (query_id))""",
    "latency_race": """
      SELECT query_id, strategy, round(latency_ms, 6) AS latency_ms, CASE
        WHEN latency_ms = min(latency_ms) OVER (PARTITION BY query_id) THEN 'fastest'
        WHEN latency_ms = max(latency_ms) OVER (PARTITION BY query_id) THEN 'slowest' END AS badge
      FROM latencies""",
    "recall_series": " UNION ALL ".join(
        f"SELECT strategy, {k} AS k, round(recall_{k}, 6) AS recall FROM means" for k in _KS),
    "metric_bars": " UNION ALL ".join(
        f"SELECT strategy, '{m}' AS metric, round({m}, 6) AS value FROM means "
        "WHERE strategy IN ('A', 'C')" for m in ("recall_10", "mrr", "ndcg_10")),
}


def _with_common(statement: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _COMMON:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(_COMMON[name])
                if name not in needed:
                    needed.append(name)

    visit(statement)
    parts = [f"{name} AS ({_COMMON[name]})" for name in needed]
    body = statement.strip()
    if body.startswith("WITH "):
        return "WITH " + ", ".join([*parts, body[len("WITH "):]])
    return ("WITH " + ", ".join(parts) + "\n" if parts else "") + body


def expected_sql() -> dict[str, str]:
    return {name: _with_common(statement) for name, statement in _STATEMENTS.items()}
