"""The adapters' tables as SQL, for the queries' twins."""

from __future__ import annotations

from motionmill.sources.adapters import EVENTS

HOURS = "(epoch_us(ts) - 1704067200000000) / 3.6e9"

CTES = {
    "h0": f"SELECT user_id, event_id, event_type, value, props, {HOURS} AS h FROM events",
    "samples": """SELECT user_id AS subject, CASE CAST(floor(h / 192) AS INT) WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 6 END AS stimulus,
      event_id AS sample_idx, (h - 192 * floor(h / 192)) / 4.0 AS t, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS detected,
      value AS c1, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS c2 FROM h0""",
    "subjects": """SELECT DISTINCT user_id AS subject, CASE WHEN user_id % 10 = 0 THEN 'suspected' WHEN user_id % 10 = 9 THEN 'unknown'
      WHEN user_id % 2 = 0 THEN 'yes' ELSE 'no' END AS raw_label FROM events""",
    "labels_t": "SELECT subject, CASE raw_label WHEN 'yes' THEN 1 WHEN 'no' THEN -1 WHEN 'suspected' THEN 0 END AS label FROM subjects",
    "stimuli": "SELECT * FROM (VALUES (1, 50), (2, 50), (4, 50), (6, 38)) AS s(stimulus, n_frames)",
    "windows": "SELECT * FROM (VALUES " + ", ".join(f"({s}, '{e}', {a}, {b})" for s, e, a, b in EVENTS) + ") AS w(stimulus, event, w_begin, w_end)",
    "placed": "SELECT *, CAST(floor(t * 1.0 + 0.5) AS INT) AS frame FROM samples WHERE detected = 1 AND floor(t * 1.0 + 0.5) <> t * 1.0 + 0.5",
    "firsts": "SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY subject, stimulus, frame ORDER BY t, sample_idx) = 1",
    "grid": """SELECT subject, stimulus, CAST(unnest(range(n_frames)) AS INT) AS frame
      FROM (SELECT DISTINCT subject, stimulus FROM samples WHERE detected = 1) JOIN stimuli USING (stimulus)""",
    "regular": "SELECT g.subject, g.stimulus, g.frame, f.c1, f.c2 FROM grid g LEFT JOIN firsts f USING (subject, stimulus, frame)",
    "sided": """SELECT *, last_value(CASE WHEN ok THEN frame END IGNORE NULLS) OVER b AS p, last_value(CASE WHEN ok THEN c1 END IGNORE NULLS) OVER b AS p1,
      last_value(CASE WHEN ok THEN c2 END IGNORE NULLS) OVER b AS p2, first_value(CASE WHEN ok THEN frame END IGNORE NULLS) OVER a AS q,
      first_value(CASE WHEN ok THEN c1 END IGNORE NULLS) OVER a AS q1, first_value(CASE WHEN ok THEN c2 END IGNORE NULLS) OVER a AS q2
      FROM (SELECT *, c1 IS NOT NULL AND c2 IS NOT NULL AS ok FROM regular)
      WINDOW b AS (PARTITION BY subject, stimulus ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        a AS (PARTITION BY subject, stimulus ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "filled": """SELECT subject, stimulus, frame,
      CASE WHEN p IS NULL AND q IS NULL THEN 0 WHEN p IS NULL THEN q1 WHEN q IS NULL OR p = frame THEN p1 ELSE p1 + (q1 - p1) * ((frame - p) / CAST(q - p - 1 AS DOUBLE)) END AS c1,
      CASE WHEN p IS NULL AND q IS NULL THEN 0 WHEN p IS NULL THEN q2 WHEN q IS NULL OR p = frame THEN p2 ELSE p2 + (q2 - p2) * ((frame - p) / CAST(q - p - 1 AS DOUBLE)) END AS c2
      FROM sided""",
    "long": "SELECT subject, stimulus, 'c1' AS channel, frame, c1 AS value FROM filled UNION ALL SELECT subject, stimulus, 'c2', frame, c2 FROM filled",
    "gaps": "SELECT subject, stimulus, 'c1' AS channel, frame, c1 AS value FROM regular UNION ALL SELECT subject, stimulus, 'c2', frame, c2 FROM regular",
    "control": "SELECT channel, avg(value) AS m, stddev_pop(value) AS s FROM long JOIN labels_t USING (subject) WHERE label = -1 GROUP BY channel",
    "z": "SELECT subject, stimulus, channel, frame, CASE WHEN s > 0 THEN (value - m) / s ELSE 0 END AS value FROM long JOIN control USING (channel)",
    "cut": "SELECT l.*, w.event FROM long l JOIN windows w ON l.stimulus = w.stimulus AND frame >= w_begin AND frame < w_end",
    "cutz": "SELECT l.*, w.event FROM z l JOIN windows w ON l.stimulus = w.stimulus AND frame >= w_begin AND frame < w_end",
    "estats": "SELECT event, channel, coalesce(avg(value), 0) AS m, coalesce(stddev_pop(value), 1) AS s FROM cut GROUP BY event, channel",
    "ez": "SELECT subject, stimulus, event, channel, frame, CASE WHEN s > 0 THEN (value - m) / s ELSE 0 END AS value FROM cut JOIN estats USING (event, channel)",
    "design": """SELECT vec_id AS subject, i - 1 AS feature_id, CAST(embedding[i] AS DOUBLE) AS value, CASE WHEN label < 5 THEN 1 ELSE -1 END AS label
      FROM embeddings, unnest(range(1, 65)) u(i)""",
    "ids": "SELECT vec_id AS subject, CASE WHEN label < 5 THEN 1 ELSE -1 END AS label FROM embeddings",
    "purity": """SELECT feature_id, greatest(avg(CASE WHEN rn <= k THEN CAST(label = 1 AS DOUBLE) END), avg(CASE WHEN rn > n - k THEN CAST(label = 1 AS DOUBLE) END)) AS score
      FROM (SELECT *, greatest(n // 10, 1) AS k FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY value, subject) AS rn, count(*) OVER (PARTITION BY feature_id) AS n FROM design)) GROUP BY feature_id""",
    "scores": "SELECT l.doc_id AS subject, CAST(d.n_chars AS DOUBLE) AS score, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS label FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    "curve": """SELECT *, sum(CAST(label = 1 AS INT)) OVER o AS tp, sum(CAST(label <> 1 AS INT)) OVER o AS fp,
      sum(CAST(label = 1 AS INT)) OVER () AS n_pos, sum(CAST(label <> 1 AS INT)) OVER () AS n_neg FROM scores
      WINDOW o AS (ORDER BY score DESC, subject DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "marks": """SELECT vec_id AS sample_idx, label AS subject, list_transform(range(0, 98), lambda k: ((k % 49) * 37 % 49) * (CASE WHEN k < 49 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END)
      + 10 * CAST(embedding[k % 64 + 1] AS DOUBLE)) AS l FROM embeddings""",
}


def sql(body: str, *extra: tuple[str, str]) -> str:
    """``body`` behind the tables it needs, in the order in which they are defined, and ``extra`` ones."""
    import re

    texts = dict(CTES) | dict(extra)
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in texts:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(texts[name])
    listed = ", ".join(f"{n} AS MATERIALIZED ({t})" for n, t in texts.items() if n in needed)
    return (f"WITH {listed} " if listed else "") + body
