"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op9_byte_bpe
from .chat_format import ChatTemplate, op8_chat_format
from .embedding_join import op5_embedding_join
from .imatch import op4_imatch
from .licenses import op6_license_scan
from .ngram_join import op2_ngram_join
from .packing import op10_packing
from .quality import op7_quality
from .toxicity import op1_toxicity
from .url_filter import op3_url_filter

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_join": op2_ngram_join,
    "op3_url_filter": op3_url_filter,
    "op4_imatch": op4_imatch,
    "op5_embedding_join": op5_embedding_join,
    "op6_license_scan": op6_license_scan,
    "op7_quality": op7_quality,
    "op8_chat_format": op8_chat_format,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_packing": op10_packing,
}

_COMPONENTS = """, reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, e.y FROM reach r JOIN edges e ON e.x = r.b), comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY 1)"""

_NGRAM = (
    r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
edges AS (SELECT p.x, p.y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2) p JOIN n i ON i.doc_id = p.x JOIN n j ON j.doc_id = p.y WHERE 100 * p.o >= 75 * (i.n + j.n - p.o)),
nodes AS (SELECT doc_id AS id FROM documents)"""
    + _COMPONENTS
    + " SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN comp c ON c.id = d.doc_id"
)

_EMBEDDING = (
    """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
edges AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
nodes AS (SELECT vec_id AS id FROM embeddings)"""
    + _COMPONENTS
    + " SELECT v.vec_id, (SELECT count(*) FROM edges WHERE x = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN comp c ON c.id = v.vec_id"
)


def _chat_sql(t: ChatTemplate) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    longer = lambda col: f"(length({col}) + " + " + ".join(f"(length({col}) - length(replace({col}, {quoted(c)}, ''))) // {len(c)}" for c in (t.escape, *t.controls())) + ")"
    opens = " ".join(f"WHEN {quoted(r)} THEN {len(m)}" for r, m in t.opens.items())
    odd = "'</s>[INST] ok [/INST]'"
    return f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', {odd}), (-1, 1, 'assistant', {odd})),
    s AS (SELECT *, CASE role {opens} ELSE {len(t.other) + len(t.other_end)} + {longer("role")} END + {longer("text")} + {len(t.close)} AS size FROM r),
    a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss,
      CAST(sum(size) AS BIGINT) AS formatted_chars, string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text) AS shape FROM s GROUP BY 1)
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, regexp_full_match(shape, 's?(ua)*u?') AS valid FROM a"""


#: Models, tokenizers and sequential packing can't be said in SQL; the tests hold those against brute force.
ORACLES: dict[str, str] = {"op2_ngram_join": _NGRAM, "op5_embedding_join": _EMBEDDING, "op8_chat_format": _chat_sql(ChatTemplate())}
