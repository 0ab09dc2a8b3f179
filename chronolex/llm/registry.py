"""The training-data queries and the SQL of those that SQL can express."""

from __future__ import annotations

from .alignment import op12_token_alignment
from .chat_tree import op10_chat_prefix_tree
from .decontaminate import op2_decontaminate
from .ngram_join import op5_ngram_jaccard_join
from .packing import op6_packing
from .paragraph_dedup import op4_paragraph_dedup
from .periodic_runs import op11_periodic_runs
from .pii import op9_pii
from .quality import op13_quality
from .suffix_dedup import op1_suffix_dedup
from .token_files import op8_token_files
from .toxicity import op7_toxicity
from .vector_search import op3_nearest_neighbours

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_decontaminate, op3_nearest_neighbours, op4_paragraph_dedup, op5_ngram_jaccard_join, op6_packing, op7_toxicity, op8_token_files, op9_pii, op10_chat_prefix_tree, op11_periodic_runs, op12_token_alignment, op13_quality)}

#: Characters that the chat template escapes cost one more.
_ESCAPED = "length({0}) + length(regexp_replace({0}, '[^\\\\<>]', '', 'g'))"

ORACLE: dict[str, str] = {
    # Exact search: what the index must find with the reranking it has.
    "op3_nearest_neighbours": """
WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, x.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (x.v[i] - q.v[i]) * (x.v[i] - q.v[i])), lambda a, b: a + b)) AS score
      FROM x q JOIN x ON x.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op5_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 75 * (nx.n + ny.n - shared)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.node = d.doc_id GROUP BY d.doc_id""",
    "op10_chat_prefix_tree": rf"""
WITH x AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(15 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id""",
}
