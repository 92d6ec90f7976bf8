"""Check SQL: the results of the registered queries, stated in plain SQL.

The statements are written against the given tables, independently of the operators
(windows, recursive queries, list functions); only the input expressions and the
patterns are shared with them.
"""

from __future__ import annotations

from briefspark.functions import constants as K
from briefspark.plans import seeds as S

ORACLE: dict[str, str] = {}


def q(pattern: str) -> str:
    """A pattern or text as an SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


BL = f"[{K.BLANK}]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{BL}+|{BL}+' + chr(92) + 'z')}, '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, {q(BL + '+')}, '', 'g')"


def has_text(x: str) -> str:
    return f"regexp_matches({x}, {q('[^' + K.BLANK + ']')})"


def basename(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '/+\\z', ''), '(?s)^.*[/\\\\]', '')"


def stem(x: str) -> str:
    return f"lower(regexp_replace({basename(x)}, '(?s)^(.+)\\.[^.]*\\z', '\\1'))"


def ext(x: str) -> str:
    return f"lower(regexp_extract({basename(x)}, '(?s)^.+\\.([^.]*)\\z', 1))"


def sandbox(x: str) -> str:
    return (
        f"(regexp_matches({x}, '(?i)^sandbox:') OR regexp_matches('/' || regexp_replace({x}, '(?i)^sandbox:', ''), {q(K.SANDBOX_DIR)}))"
    )


BINARY = "(" + ", ".join(q(x) for x in K.BINARY_EXTENSIONS) + ")"
CHATS = f"""chats AS (SELECT conv_id, turn, role, text, CAST(conv_id AS STRING) AS page,
    {S.PADDED_TEXT} AS padded FROM conversations)"""
SEEDED = f"seeded AS (SELECT conv_id AS conv_key, turn AS ordinal, {S.ROLE} AS role, {S.SEEDED_TEXT} AS text FROM conversations)"
URLS = f"chat_urls AS (SELECT conv_id, turn, {S.CHAT_URL} AS url FROM conversations)"
HOST = "regexp_extract(url, '^https?://([^/?#:]+)', 1)"


def platform_case(host: str = HOST) -> str:
    rules = []
    for name, hosts, suffix, _ in K.PLATFORMS:
        tests = [f"{host} = {q(h)}" for h in hosts] + ([f"{host} LIKE {q('%' + suffix)}"] if suffix else [])
        rules.append(f"WHEN {' OR '.join(tests)} THEN {q(name)}")
    return "CASE " + " ".join(rules) + f" ELSE {q(K.GENERIC_PLATFORM)} END"


ID_CASE = "CASE platform " + " ".join(
    f"WHEN {q(n)} THEN nullif(regexp_extract(url, {q(p)}, 1), '')" for n, _, _, p in K.PLATFORMS
) + " END"

# -- sources ----------------------------------------------------------------------

ORACLE["route_platform"] = f"""WITH {URLS}, u AS (SELECT 'chat' AS origin, url FROM chat_urls UNION ALL SELECT 'page', url FROM pages)
SELECT origin, {platform_case()} AS platform, count(*) AS n FROM u GROUP BY 1, 2"""
ORACLE["conversation_id_from_url"] = f"""WITH {URLS}, r AS (SELECT *, {platform_case()} AS platform FROM chat_urls)
SELECT conv_id, turn, url, platform, {ID_CASE} AS chat_id FROM r"""
ORACLE["payload_errors"] = f"""WITH {CHATS}
SELECT CAST(page_id AS STRING) AS conv_key, 'payload is not valid JSON' AS error FROM pages
UNION ALL SELECT DISTINCT page, 'no messages parsed' FROM chats"""
ORACLE["normalize_simple_messages"] = f"""WITH {CHATS}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM chats WHERE {has_text('padded')})
SELECT conv_id AS conv_key, n AS ordinal, 'dom-' || CAST(n AS STRING) AS msg_uuid, {S.ROLE} AS role, {trim('padded')} AS text FROM k"""
ORACLE["messages_from_pages"] = f"""WITH {CHATS}, n AS (SELECT *, count(*) OVER (PARTITION BY page) AS c, row_number() OVER (PARTITION BY page ORDER BY turn) - 1 AS i FROM chats)
SELECT 'page-' || CAST(page_id AS STRING) AS page_id, CAST(NULL AS BIGINT) AS ordinal, CAST(NULL AS STRING) AS role, CAST(NULL AS STRING) AS text, 'no conversation found on this page' AS error FROM pages
UNION ALL SELECT 'chat-' || page, i, {S.ROLE}, trim(regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g')), NULL FROM n WHERE c >= 2
UNION ALL SELECT DISTINCT 'chat-' || page, CAST(NULL AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS STRING), 'no conversation found on this page' FROM n WHERE c < 2"""
ORACLE["prefer_data_layer"] = """WITH f AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system')
SELECT conv_id AS conv_key, turn AS ordinal, CASE WHEN f.conv_id IS NULL THEN '' ELSE 'screen ' END || role AS role, text,
  CASE WHEN f.conv_id IS NULL THEN 'data layer' ELSE 'screen' END AS source FROM conversations LEFT JOIN f USING (conv_id)"""
ORACLE["upsert_briefs"] = """SELECT conv_id AS store_key, lpad(CAST(turn AS STRING), 6, '0') AS saved_at, text AS brief
FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1"""
ORACLE["upsert_brief_table"] = f"""WITH {URLS} SELECT nullif(regexp_extract(url, '^https?://([^?#]*)', 1), '') AS store_key,
  lpad(CAST(conv_id AS STRING), 12, '0') || lpad(CAST(turn AS STRING), 6, '0') AS saved_at, text AS brief
FROM chat_urls JOIN conversations USING (conv_id, turn) QUALIFY row_number() OVER (PARTITION BY store_key ORDER BY saved_at DESC) = 1"""
ORACLE["stale_briefs"] = "SELECT DISTINCT conv_id AS conv_key FROM conversations WHERE role = 'system'"
ORACLE["brief_slug"] = """SELECT doc_id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), ''), 'handoff-brief') AS slug FROM documents"""
NAMED = """asked AS (SELECT conv_id AS conv_key, 'Chat of ' || count(*) || ' turns!' AS title FROM conversations GROUP BY 1),
slugs AS (SELECT conv_key, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), ''), 'handoff-brief') AS slug FROM asked),
ranks AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY conv_key) AS k FROM slugs),
named AS (SELECT conv_key, CASE WHEN k = 1 THEN slug ELSE slug || '_' || k END AS name FROM ranks)"""
ORACLE["brief_file_names"] = f"WITH {NAMED} SELECT conv_key, name FROM named"
ORACLE["write_brief_files"] = f"""WITH {NAMED} SELECT name || '.md' AS file_name, string_agg(coalesce(text, '') || chr(10), '' ORDER BY turn) AS content
FROM conversations JOIN named ON conv_id = conv_key GROUP BY name"""

# -- normalizers ----------------------------------------------------------------------


def flat(where: str = "true", text: str = trim("padded"), role: str = S.ROLE, dense: bool = True) -> str:
    n = "row_number() OVER (PARTITION BY page ORDER BY turn) - 1" if dense else "turn - min(turn) OVER (PARTITION BY page)"
    inner = f"SELECT *, {n} AS n FROM chats WHERE {where if dense else 'true'} AND {has_text('padded') if dense else 'true'}"
    return f"WITH {CHATS}, k AS ({inner}) SELECT page AS conv_key, n AS ordinal, {role} AS role, {text} AS text FROM k" + (
        "" if dense else f" WHERE {has_text('padded')}"
    )


ORACLE["normalize_hf"] = flat("role <> 'system'")
ORACLE["read_payload_arrays"] = f"SELECT ordinal, role, text FROM ({ORACLE['normalize_hf']})"
ORACLE["normalize_deepseek"] = flat()
ORACLE["normalize_grok"] = flat()
ORACLE["normalize_gemini"] = flat()
ORACLE["normalize_chatgpt"] = flat("role <> 'system'")
ORACLE["normalize_claude"] = flat(dense=False)
CARDS = "chr(10) || chr(10) || 'Sources:' || chr(10) || '- One: https://one.example' || chr(10) || '- https://two.example: https://two.example'"
ORACLE["normalize_perplexity"] = f"""WITH {CHATS}, k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY turn) - 1 AS n FROM chats WHERE role <> 'user' OR {has_text('padded')})
SELECT page AS conv_key, n AS ordinal, {S.ROLE} AS role, {trim('padded')} || CASE WHEN role = 'user' THEN '' ELSE {CARDS} END AS text FROM k"""
ORACLE["normalize_claude_report"] = f"""WITH {CHATS}
SELECT page AS conv_key, count(*) + count(*) FILTER (role = 'system') AS total_blocks, count(*) AS classified_blocks,
  count(*) FILTER (role = 'system') = 0 AS complete, count(DISTINCT turn % 2) AS uploads, 'Sheet_' || CAST(min(turn % 2) AS STRING) || '.csv' AS first_upload,
  count(*) FILTER (role = 'system') AS unknown, CASE WHEN count(*) FILTER (role = 'system') > 0 THEN '{{"type":"mystery","text":"odd"}}' END AS preview
FROM chats GROUP BY page"""
ORACLE["parity_report"] = f"WITH {CHATS} SELECT page AS conv_key, CAST(7 AS BIGINT) AS platforms, true AS equal FROM chats WHERE {has_text('padded')} GROUP BY page"

ORACLE["parity_differences"] = f"""WITH {CHATS}, made AS (SELECT platform, page, turn,
    CASE WHEN role = 'user' OR (platform = 'huggingface' AND conv_id % 5 = 2 AND turn = 1) THEN 'human' ELSE 'assistant' END AS role,
    CASE WHEN platform = 'grok' AND turn = conv_id % 3 THEN padded || ' changed' ELSE padded END AS text
  FROM chats, unnest(['grok', 'huggingface', 'deepseek', 'chatgpt']) AS p(platform) WHERE platform <> 'deepseek' OR conv_id % 4 <> 1 OR turn < 2),
has AS (SELECT platform, page, row_number() OVER (PARTITION BY platform, page ORDER BY turn) - 1 AS ordinal, role, {trim('text')} AS text FROM made WHERE {has_text('text')}),
votes AS (SELECT page, ordinal, role, text, count(*) AS n FROM has GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY page, ordinal ORDER BY n DESC, role, text) AS k, sum(n) OVER (PARTITION BY page, ordinal) AS present FROM votes),
found AS (SELECT p.platform, b.page, b.ordinal, CASE WHEN h.page IS NULL AND n >= 4 - present THEN 'missing' WHEN h.page IS NOT NULL AND n < 4 - present THEN 'extra'
    WHEN h.page IS NULL THEN NULL WHEN h.role <> b.role THEN 'role' WHEN h.text <> b.text THEN 'text' END AS what
  FROM best b CROSS JOIN unnest(['grok', 'huggingface', 'deepseek', 'chatgpt']) AS p(platform) LEFT JOIN has h ON h.platform = p.platform AND h.page = b.page AND h.ordinal = b.ordinal WHERE k = 1)
SELECT page AS conv_key, platform, 'message' AS kind, min(ordinal) AS ordinal, 0 AS pos, arg_min(what, ordinal) AS what FROM found WHERE what IS NOT NULL GROUP BY page, platform"""

# -- branches --------------------------------------------------------------------------------

NODES = """nodes AS (SELECT conv_id AS conv_key, turn * 2 + v AS pos, CASE v WHEN 0 THEN 'n' ELSE 'x' END || CAST(turn AS STRING) AS node,
    CASE WHEN turn = 0 THEN NULL ELSE 'n' || CAST(turn - 1 AS STRING) END AS parent, 100 - turn AS t, v FROM conversations, (VALUES (0), (1)) w(v)),
  leaf AS (SELECT conv_id AS conv_key, CASE WHEN bool_or(role = 'system') THEN 'gone' ELSE 'n' || CAST(max(turn) AS STRING) END AS leaf FROM conversations GROUP BY 1),
  up AS (SELECT n.conv_key, n.node, n.parent, 0 AS d FROM nodes n JOIN leaf l ON n.conv_key = l.conv_key AND n.node = l.leaf
    UNION ALL SELECT n.conv_key, n.node, n.parent, d + 1 FROM up JOIN nodes n ON n.conv_key = up.conv_key AND n.node = up.parent)"""
WALK = "SELECT conv_key, node, max(d) OVER (PARTITION BY conv_key) - d AS branch_ord FROM up"
ORACLE["active_branch"] = f"""WITH RECURSIVE {NODES} {WALK}
UNION ALL SELECT conv_key, node, row_number() OVER (PARTITION BY conv_key ORDER BY pos) - 1 FROM nodes JOIN leaf USING (conv_key) WHERE leaf = 'gone'"""
ORACLE["linear_branch"] = f"""WITH RECURSIVE {NODES} {WALK}
UNION ALL SELECT conv_key, node, row_number() OVER (PARTITION BY conv_key ORDER BY t, pos) - 1 FROM nodes JOIN leaf USING (conv_key) WHERE leaf = 'gone' AND v = 0"""

# -- blocks -------------------------------------------------------------------------------------

SHAPES = "shapes AS (SELECT conv_id AS conv_key, turn // 2 AS msg_ord, turn % 2 AS block_ord, turn, text, turn % 8 AS shape, 'https://src.example/' || CAST(conv_id AS STRING) AS url FROM conversations)"
RAW = "CASE shape WHEN 6 THEN '{\"type\":\"mystery\",\"payload\":' || CAST(to_json(text) AS STRING) || '}' ELSE '{\"payload\":' || CAST(to_json(text) AS STRING) || '}' END"
LINE = f"trim(regexp_replace({RAW}, {q(BL + '+')}, ' ', 'g'))"
KIND = "CASE shape WHEN 0 THEN 'text' WHEN 2 THEN 'artifact' WHEN 3 THEN 'tool' WHEN 6 THEN 'unknown' WHEN 7 THEN 'unknown' ELSE 'tool-noise' END"
ORACLE["classify_blocks"] = f"""WITH {SHAPES} SELECT conv_key, msg_ord, block_ord, {KIND} AS kind, CASE shape WHEN 6 THEN 'type:mystery' WHEN 7 THEN 'no-type' END AS hint,
  CASE WHEN shape >= 6 THEN CASE WHEN length({LINE}) > 200 THEN substr({LINE}, 1, 200) || '…' ELSE {LINE} END END AS preview FROM shapes"""
ORACLE["display_content_artifacts"] = f"""WITH {SHAPES} SELECT conv_key, msg_ord, block_ord, 'T' AS title, 'f_' || CAST(conv_key AS STRING) || '.md' AS filename, 'markdown' AS language, text AS content FROM shapes WHERE shape = 2"""
ORACLE["ant_artifacts"] = """SELECT conv_id AS conv_key, turn AS ordinal, CAST(p AS BIGINT) AS pos, CASE p WHEN 0 THEN 'Doc' END AS title, CASE WHEN p = 0 AND turn % 2 = 0 THEN 'a.md' END AS filename,
  CASE p WHEN 0 THEN 'text' END AS language, CASE p WHEN 0 THEN text ELSE 'x' END AS content FROM conversations, (VALUES (0), (1)) v(p)"""
ORACLE["strip_artifact_tags"] = "SELECT conv_id AS conv_key, turn AS ordinal, 'before  and  after' AS text FROM conversations"
ORACLE["search_context"] = f"""WITH {SHAPES} SELECT conv_key, msg_ord, block_ord, CAST(o AS BIGINT) AS ord, CASE o WHEN 0 THEN 'source' ELSE 'image' END AS kind,
  CASE o WHEN 0 THEN 'Page' WHEN 1 THEN 'Pic ' || CAST(conv_key AS STRING) ELSE 'Thumb' END AS title, url || CASE o WHEN 0 THEN '' WHEN 1 THEN '/a.PNG?s=1' ELSE '/t' END AS url
  FROM shapes, (VALUES (0), (1), (2)) v(o) WHERE shape = 4 AND conv_key % 3 <> 0"""
ORACLE["citations"] = f"WITH {SHAPES} SELECT DISTINCT conv_key, msg_ord, url, 'First' AS title FROM shapes WHERE shape = 0"
ORACLE["image_subject"] = """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Chart of ' || role ELSE 'Chart of' END || CASE WHEN turn % 3 = 0 THEN ' (image search)' ELSE '' END AS subject FROM conversations"""
ORACLE["assemble_messages"] = f"""WITH {SHAPES} SELECT conv_key, msg_ord AS ordinal, {trim("text || chr(10) || chr(10) || 'Sources:' || chr(10) || '- First: ' || url")} AS text FROM shapes WHERE shape = 0"""
ORACLE["integrity_report"] = f"""WITH {SHAPES} SELECT conv_key, count(*) AS total_blocks, count(*) FILTER (shape < 6) AS classified_blocks, count(*) FILTER (shape >= 6) = 0 AS complete FROM shapes GROUP BY 1"""
ORACLE["uploads"] = """SELECT conv_id AS conv_key, turn AS ordinal, role || CASE WHEN turn % 2 = 0 THEN '.CSV' ELSE '.csv' END AS name, CASE WHEN role = 'user' THEN 'csv' END AS type
FROM conversations WHERE turn % 4 <> 3 QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1"""

# -- files ------------------------------------------------------------------------------------------

EDITED = "regexp_replace(text, 'the', 'THE')"
DRAFTS = f"""SELECT conv_id AS conv_key, '/home/claude/draft_' || CAST(turn % 3 AS STRING) || '.md' AS path, {EDITED} AS content FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn DESC) = 1"""
ORACLE["replay_files_by_path"] = DRAFTS
ORACLE["replay_files"] = f"""SELECT * FROM ({DRAFTS}) UNION ALL SELECT * FROM (
SELECT conv_id, '/mnt/user-data/outputs/final ' || CAST(turn % 2 AS STRING) || '.md', {EDITED} FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn DESC) = 1)"""
ORACLE["replay_across_folders"] = """SELECT conv_id AS conv_key, '/home/t' || CAST(turn % 3 AS STRING) || '/note.md' AS path, text AS content FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn DESC) = 1
UNION ALL SELECT * FROM (SELECT conv_id, '/home/latest.md', text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)"""
ORACLE["choose_deliverables"] = """WITH files AS (SELECT conv_id AS conv_key, turn, CASE WHEN conv_id % 2 = 1 AND turn % 2 = 0 THEN '/mnt/user-data/outputs/' ELSE '/home/claude/' END || 'f' || CAST(turn AS STRING) || CASE WHEN turn % 4 = 2 THEN '.pdf' ELSE '.md' END AS path,
  CASE WHEN turn = 0 THEN '' ELSE text END AS content FROM conversations),
listed AS (SELECT DISTINCT conv_id AS conv_key, '/mnt/user-data/outputs/f' || CAST(turn AS STRING) || '.md' AS path FROM conversations WHERE role = 'user' AND conv_id % 2 = 1),
formal AS (SELECT * FROM listed UNION SELECT conv_key, path FROM files WHERE path LIKE '/mnt/user-data/outputs/%'),
chosen AS (SELECT * FROM formal UNION ALL SELECT conv_key, path FROM files WHERE conv_key NOT IN (SELECT conv_key FROM formal)),
last AS (SELECT conv_key, content AS last_content FROM files QUALIFY row_number() OVER (PARTITION BY conv_key ORDER BY turn DESC) = 1)
SELECT c.conv_key, c.path, regexp_replace(c.path, '^.*/', '') AS filename,
  CASE WHEN c.path LIKE '%.pdf' THEN '' WHEN coalesce(f.content, '') = '' THEN coalesce(last_content, '') ELSE f.content END AS content,
  c.path LIKE '%.pdf' AS binary, l.path IS NOT NULL AS presented, c.path NOT LIKE '%.pdf' AND coalesce(f.content, '') = '' AND last_content IS NOT NULL AS content_inferred
FROM chosen c LEFT JOIN files f USING (conv_key, path) LEFT JOIN listed l USING (conv_key, path) LEFT JOIN last USING (conv_key)"""
ORACLE["replay_canvas"] = r"""SELECT conv_id AS conv_key, CASE WHEN turn % 2 = 0 THEN 'even' ELSE 'default' END AS doc_id, 'essay.md' AS filename,
  regexp_replace(regexp_replace(text, 't(h)e', 'Th[the]'), '[aeiou]n\b', '_', 'g') AS content FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn DESC) = 1"""
ORACLE["gemini_canvas_docs"] = f"""SELECT CAST(conv_id AS STRING) || '/' || CAST(turn AS STRING) AS conv_key, 'artifact-1' AS artifact_id, 'gemini-canvas-1.md' AS filename, {trim('text')} AS content FROM conversations WHERE length(text) > 60"""
ORACLE["canvas_filename"] = """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN source || '.Txt' ELSE source || '_' || lang || '.' || CASE doc_id % 6 WHEN 1 THEN 'py' WHEN 2 THEN 'txt' WHEN 5 THEN 'jsx' ELSE 'md' END END AS filename FROM documents"""
ORACLE["path_scalars"] = f"""WITH p AS (SELECT 'chat' AS origin, {S.FILE_PATH} AS path FROM conversations UNION ALL SELECT 'page', url FROM pages)
SELECT origin, path, {basename('path')} AS base, {ext('path')} AS ext, {stem('path')} AS stem, {sandbox('path')} AS sandbox, {ext('path')} IN {BINARY} AS "binary" FROM p"""

# -- drafts ---------------------------------------------------------------------------------------------


def tokens(x: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+')))"


ARTIFACTS = f"""arts AS (SELECT conv_id AS conv_key, turn * 2 + v AS ordinal, turn, v, {S.DRAFT_TEXT} AS content FROM conversations, (VALUES (0), (1)) w(v) WHERE role = 'assistant')"""
SIM = "len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"
ORACLE["token_set"] = f"SELECT doc_id, array_to_string({tokens('text')}, ' ') AS tokens FROM documents"
ORACLE["draft_similarity"] = f"""WITH {ARTIFACTS}, t AS (SELECT conv_key, ordinal, {tokens('content')} AS toks FROM arts),
p AS (SELECT conv_key, ordinal, toks, lag(ordinal) OVER w AS prev_ordinal, lag(toks) OVER w AS prev FROM t WINDOW w AS (PARTITION BY conv_key ORDER BY ordinal))
SELECT conv_key, prev_ordinal, ordinal, round({SIM.format(a='prev', b='toks')}, 6) AS sim FROM p WHERE prev_ordinal IS NOT NULL"""
KEPT = f"""{ARTIFACTS}, t AS (SELECT conv_key, ordinal, content, {tokens('content')} AS toks, row_number() OVER (PARTITION BY conv_key ORDER BY ordinal) AS n FROM arts),
fold AS (SELECT conv_key, n, [{{'slot': ordinal, 'ord': ordinal, 'toks': toks}}] AS kept FROM t WHERE n = 1
 UNION ALL SELECT conv_key, n, CASE WHEN home IS NULL THEN list_append(kept, {{'slot': ordinal, 'ord': ordinal, 'toks': toks}})
   ELSE list_transform(kept, lambda s, i: CASE WHEN i = home THEN {{'slot': s.slot, 'ord': ordinal, 'toks': toks}} ELSE s END) END
 FROM (SELECT t.conv_key, t.n, t.ordinal, t.toks, f.kept, CASE WHEN len(t.toks) < 3 THEN NULL ELSE
     list_position(list_transform(f.kept, lambda s: len(s.toks) >= 3 AND {SIM.format(a='s.toks', b='t.toks')} >= 0.5), true) END AS home
   FROM fold f JOIN t ON t.conv_key = f.conv_key AND t.n = f.n + 1)),
last_fold AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY conv_key ORDER BY n DESC) = 1),
kept_rows AS (SELECT conv_key, unnest(kept) AS k FROM last_fold),
lineage AS (SELECT r.conv_key, r.k.slot AS slot, r.k.ord AS ordinal, a.content, a.turn FROM kept_rows r JOIN arts a ON a.conv_key = r.conv_key AND a.ordinal = r.k.ord)"""
ORACLE["similar_drafts"] = f"""WITH {ARTIFACTS}, t AS (SELECT conv_key, ordinal, {tokens('content')} AS toks FROM arts), s AS (SELECT *, list_sort(toks) AS st, len(toks) AS n FROM t WHERE len(toks) >= 3),
f AS (SELECT *, min(ordinal) OVER (PARTITION BY conv_key, st) AS head FROM s)
SELECT a.conv_key, a.ordinal AS ordinal_a, b.ordinal AS ordinal_b, round({SIM.format(a='a.toks', b='b.toks')}, 6) AS sim FROM f a JOIN f b ON a.conv_key = b.conv_key AND a.ordinal < b.ordinal
WHERE a.ordinal = a.head AND (b.ordinal = b.head OR b.head = a.head) AND {SIM.format(a='a.toks', b='b.toks')} >= 0.5"""
ORACLE["collapse_lineage"] = f"WITH RECURSIVE {KEPT} SELECT conv_key, slot, ordinal, content FROM lineage"
ORACLE["collapse_lineage_by_groups"] = ORACLE["collapse_lineage"]

# -- extraction ----------------------------------------------------------------------------------------------


def find(pattern: str, group: int, source: str = "seeded", text: str = "text", where: str = "true") -> str:
    return (
        f"SELECT conv_key, ordinal, unnest(regexp_extract_all({text}, {q(pattern)}, {group})) AS hit, "
        f"generate_subscripts(regexp_extract_all({text}, {q(pattern)}, {group}), 1) - 1 AS pos FROM {source} WHERE {where}"
    )


LB = K.BLANK_IN_LINE
TABLE = rf"(?m)^[^\n]*\|[^\n]*\n[{LB}|:]*(?:-[{LB}:-]*\||\|[{LB}:]*-)[{LB}|:-]*(?:\n[^\n]*\|[^\n]*)+"


def lines_trimmed(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: {trim('l')}), chr(10))"


TABLES = f"{SEEDED}, tables AS (SELECT conv_key, ordinal, pos, {lines_trimmed('hit')} AS value FROM ({find(TABLE, 0)}))"
ORACLE["extract_tables"] = f"WITH {TABLES} SELECT conv_key, ordinal, pos, value AS table_text FROM tables"


def first(source: str, keys: str, order: str = "ordinal, pos") -> str:
    return f"(SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1)"


ORACLE["tables_verbatim"] = f"""WITH {TABLES}, every AS (SELECT 0 AS src, * FROM tables UNION ALL SELECT 1, t.* FROM tables t JOIN seeded s USING (conv_key, ordinal) WHERE s.role = 'assistant')
SELECT conv_key, CAST(src AS BIGINT) AS src, ordinal, value FROM {first('every', 'conv_key, ' + squeeze('value'), 'src, ordinal, pos')} WHERE length({squeeze('value')}) >= 12"""
ORACLE["table_cells"] = f"""WITH {TABLES}, rows_ AS (SELECT conv_key, ordinal, pos, string_split(value, chr(10)) AS ls FROM tables),
body AS (SELECT conv_key, ordinal, pos, ls[1] AS head, unnest(ls[3:]) AS line, generate_subscripts(ls[3:], 1) - 1 AS row_no FROM rows_),
cells AS (SELECT *, list_transform(string_split(trim(line, '|'), '|'), lambda c: trim(c)) AS cs, list_transform(string_split(trim(head, '|'), '|'), lambda c: trim(c)) AS hs FROM body)
SELECT conv_key, ordinal, pos, row_no, generate_subscripts(cs, 1) - 1 AS col_no, hs[generate_subscripts(cs, 1)] AS header, unnest(cs) AS value FROM cells"""
LAST_IMAGES = f"last_turn AS (SELECT conv_id AS conv_key, turn AS ordinal, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1), images AS (SELECT conv_key, ordinal, p AS pos, CASE p WHEN 0 THEN 'Chart of ' || role ELSE 'image' END AS value FROM last_turn, (VALUES (0), (2)) v(p))"
ORACLE["latest_images"] = f"WITH {LAST_IMAGES} SELECT conv_key, ordinal, 'image' AS kind, 'image shown' AS label, value FROM images"
FACTS = f"""{TABLES},
all_text AS (SELECT conv_key, string_agg(text, chr(10) ORDER BY ordinal) AS text FROM seeded GROUP BY 1),
f_tables AS (SELECT conv_key, 0 AS src, ordinal, pos, 'table' AS kind, 'table' AS label, value, CAST(NULL AS STRING) AS language FROM {first('tables', 'conv_key, ' + squeeze('value'))} WHERE length({squeeze('value')}) >= 12),
r_formulas AS (SELECT conv_key, ordinal, pos, {squeeze('hit')} AS value FROM ({find(K.FORMULA, 0)})),
f_formulas AS (SELECT conv_key, 3 AS src, ordinal, pos, 'constraint' AS kind, 'formula' AS label, value, CAST(NULL AS STRING) AS language FROM {first('r_formulas', 'conv_key, value')}),
r_fences AS (SELECT conv_key, ordinal, pos, regexp_extract(hit, {q(K.FENCE)}, 1) AS lang, {trim(f"regexp_extract(hit, {q(K.FENCE)}, 2)")} AS value FROM ({find(K.FENCE, 0)})),
f_fences AS (SELECT conv_key, 5 AS src, ordinal, pos, 'code' AS kind, CASE WHEN lang = '' THEN 'code' ELSE lang END || ' snippet' AS label, value, nullif(lang, '') AS language FROM {first('r_fences', 'conv_key, value')} WHERE length(value) BETWEEN 12 AND 1500),
r_urls AS ({find(K.URL, 0)}),
f_urls AS (SELECT conv_key, 6 AS src, ordinal, pos, 'api' AS kind, 'url' AS label, hit AS value, CAST(NULL AS STRING) AS language FROM {first('r_urls', 'conv_key, hit')}),
r_ends AS (SELECT conv_key, ordinal, pos, regexp_replace(hit, {q(BL + '+')}, ' ') AS value FROM ({find(K.ENDPOINT, 0)})),
f_ends AS (SELECT conv_key, 7 AS src, ordinal, pos, 'api' AS kind, 'endpoint' AS label, value, CAST(NULL AS STRING) AS language FROM {first('r_ends', 'conv_key, value')}),
r_made AS (SELECT conv_key, ordinal, pos, {basename('hit')} AS name FROM ({find(K.SANDBOX_FILE, 1)})),
f_made AS (SELECT conv_key, 1 AS src, ordinal, pos, name, {q(K.WHY_GENERATED)} AS why, 'chat' AS source FROM {first('r_made', 'conv_key, lower(name)')}),
r_named AS (SELECT * FROM ({find(K.FILENAME, 1)}) WHERE NOT {sandbox('hit')} AND NOT (contains(hit, '/') AND regexp_matches(regexp_replace(split_part(hit, '/', 1), '(?i)^https?://', ''), {q(K.URL_HOST)}))),
f_named AS (SELECT conv_key, 3 AS src, ordinal, pos, hit AS name, {q(K.WHY_REFERENCED)} AS why, 'referenced' AS source, {stem('hit')} AS stem FROM {first('r_named', 'conv_key, ' + stem('hit'))})"""
ORACLE["formulas"] = f"WITH {FACTS} SELECT conv_key, ordinal, kind, label, value FROM f_formulas"
ORACLE["fenced_code"] = f"WITH {FACTS} SELECT conv_key, ordinal, label, value, language FROM f_fences"
ORACLE["urls"] = f"WITH {FACTS} SELECT conv_key, ordinal, kind, label, value FROM f_urls"
ORACLE["endpoints"] = f"WITH {FACTS} SELECT conv_key, ordinal, kind, label, value FROM f_ends"
ORACLE["generated_files"] = f"WITH {FACTS} SELECT conv_key, ordinal, name, why, source FROM f_made"
ORACLE["referenced_files"] = f"WITH {FACTS} SELECT conv_key, ordinal, name, source FROM f_named"
ORACLE["dedupe_verbatim"] = f"""WITH {FACTS}, every AS (SELECT * FROM f_urls UNION ALL SELECT * FROM f_ends UNION ALL SELECT * FROM f_formulas UNION ALL SELECT * FROM f_fences)
SELECT conv_key, kind, label, value, language FROM {first('every', 'conv_key, kind, value', 'src, ordinal, pos')}"""
DEDUPED = """chat AS (SELECT * FROM files WHERE source = 'chat' QUALIFY row_number() OVER (PARTITION BY conv_key, lower(name) ORDER BY src, ordinal, pos) = 1),
mentioned AS (SELECT *, {stem} AS st FROM files WHERE source <> 'chat' QUALIFY row_number() OVER (PARTITION BY conv_key, {stem} ORDER BY src, ordinal, pos) = 1),
listed AS (SELECT conv_key, src, ordinal, pos, name, why, source FROM chat UNION ALL
  SELECT m.conv_key, m.src, m.ordinal, m.pos, m.name, m.why, m.source FROM mentioned m WHERE NOT EXISTS (SELECT 1 FROM chat c WHERE c.conv_key = m.conv_key AND {cstem} = m.st))""".format(
    stem=stem("name"), cstem=stem("c.name")
)
ORACLE["dedupe_files_by_stem"] = f"""WITH {FACTS}, mentions AS (SELECT conv_id AS conv_key, 2 AS src, turn AS ordinal, 0 AS pos,
  CASE turn % 3 WHEN 0 THEN 'docs/Report_' || CAST(conv_id % 8 AS STRING) || '.md' WHEN 1 THEN 'Plan.md' ELSE 'plan.txt' END AS name, 'mentioned' AS why, 'referenced' AS source FROM conversations),
files AS (SELECT * FROM f_made UNION ALL SELECT * FROM mentions), {DEDUPED} SELECT conv_key, name, source FROM listed"""
NOW = """'Captured this conversation (' || CAST(n AS STRING) || ' messages).' || coalesce(' Files produced: ' || names || '.', '')"""
NOWS = f"""counts AS (SELECT conv_key, count(*) AS n FROM seeded GROUP BY 1), made AS (SELECT conv_key, string_agg(name, ', ' ORDER BY src, ordinal, pos) AS names FROM f_made GROUP BY 1),
nows AS (SELECT conv_key, {NOW} AS now FROM counts LEFT JOIN made USING (conv_key))"""
ORACLE["tier0_now"] = f"WITH {FACTS}, {NOWS} SELECT conv_key, CAST(0 AS BIGINT) AS part, now FROM nows"

ART_FIELDS = """CASE turn % 3 WHEN 0 THEN 'out_' || CAST(turn AS STRING) || '.md' WHEN 1 THEN 'plan.pdf' END AS filename, 'Draft ' || CAST(turn AS STRING) AS title,
  CASE WHEN turn % 2 = 0 THEN 'markdown' END AS language, turn % 3 = 1 AS is_binary, turn % 4 = 2 AS presented, turn % 4 = 1 AS rebuilt"""
AS_FILE = "(is_binary OR presented OR length(content) > 1500 OR rebuilt)"
WHY = f"CASE WHEN is_binary AND presented THEN {q(K.WHY_BINARY_PRESENTED)} WHEN is_binary THEN {q(K.WHY_BINARY)} WHEN presented THEN {q(K.WHY_PRESENTED)} ELSE {q(K.WHY_PRODUCED)} END"
ORACLE["split_artifacts"] = f"""WITH {ARTIFACTS}, a AS (SELECT *, {ART_FIELDS} FROM arts)
SELECT conv_key, ordinal, CASE WHEN {AS_FILE} THEN 'file' ELSE 'inline' END AS way, coalesce(filename, title) AS name, CASE WHEN {AS_FILE} THEN {WHY} ELSE content END AS detail FROM a"""
FULL = f"""{FACTS}, {KEPT}, {LAST_IMAGES}, kept_arts AS (SELECT *, {ART_FIELDS} FROM lineage)"""
VERBATIM = f"""every AS (SELECT * FROM f_tables UNION ALL SELECT conv_key, 2, ordinal, pos, 'image', 'image shown', value, NULL FROM images UNION ALL SELECT * FROM f_formulas
  UNION ALL SELECT conv_key, 4, slot, 0, 'code', coalesce(filename, title), content, language FROM kept_arts WHERE NOT {AS_FILE} UNION ALL SELECT * FROM f_fences UNION ALL SELECT * FROM f_urls UNION ALL SELECT * FROM f_ends),
items AS {first('every', 'conv_key, kind, value', 'src, ordinal, pos')}"""
ALL_FILES = f"""stems AS (SELECT DISTINCT conv_id AS conv_key, CASE turn % 3 WHEN 0 THEN 'out_' || CAST(turn AS STRING) ELSE 'plan' END AS stem FROM conversations WHERE role = 'assistant' AND turn % 3 < 2),
named AS (SELECT conv_key, src, ordinal, pos, name, why, source FROM f_named f WHERE NOT EXISTS (SELECT 1 FROM stems s WHERE s.conv_key = f.conv_key AND s.stem = f.stem)),
files AS (SELECT conv_key, 0 AS src, slot AS ordinal, 0 AS pos, coalesce(filename, title) AS name, {WHY} AS why, 'chat' AS source FROM kept_arts WHERE {AS_FILE} UNION ALL SELECT * FROM f_made
  UNION ALL SELECT conv_id, 2, turn, 0, 'Sheet_' || CAST(turn AS STRING) || '.csv', {q(K.WHY_UPLOADED)}, 'referenced' FROM conversations WHERE role = 'user' UNION ALL SELECT * FROM named),
{DEDUPED}"""
ORACLE["distill_deterministic_verbatim"] = f"WITH RECURSIVE {FULL}, {VERBATIM} SELECT conv_key, kind, label, value, language FROM items"
ORACLE["distill_deterministic_files"] = f"WITH RECURSIVE {FULL}, {ALL_FILES} SELECT conv_key, name, why, source FROM listed"

# -- transcript text --------------------------------------------------------------------------------------

UNIT = "'### ' || CASE WHEN role = 'assistant' THEN 'Assistant' ELSE 'User' END || chr(10) || text"
UNITS = f"""units AS (SELECT conv_key, 0 AS src, ordinal, {UNIT} AS unit FROM seeded UNION ALL
  SELECT conv_key, 1, slot, '### Artifact: ' || coalesce(filename, title) || coalesce(' (' || language || ')', '') || chr(10) || '```' || chr(10) || content || chr(10) || '```' FROM kept_arts)"""
ORACLE["render_transcript"] = f"""WITH RECURSIVE {SEEDED}, {KEPT}, kept_arts AS (SELECT *, {ART_FIELDS} FROM lineage), {UNITS}
SELECT conv_key, CAST(0 AS BIGINT) AS part, string_agg(unit, chr(10) || chr(10) ORDER BY src, ordinal) AS full_text FROM units GROUP BY 1"""
ORACLE["chunk_transcript"] = f"""WITH RECURSIVE {SEEDED}, u AS (SELECT conv_key, {UNIT} AS unit, length({UNIT}) + 2 AS cost, row_number() OVER (PARTITION BY conv_key ORDER BY ordinal) AS n FROM seeded),
fold AS (SELECT conv_key, n, unit, cost AS load, CAST(0 AS BIGINT) AS chunk FROM u WHERE n = 1
  UNION ALL SELECT u.conv_key, u.n, u.unit, CASE WHEN load + cost > 1500 THEN cost ELSE load + cost END, CASE WHEN load + cost > 1500 THEN chunk + 1 ELSE chunk END FROM fold f JOIN u ON u.conv_key = f.conv_key AND u.n = f.n + 1)
SELECT conv_key, chunk AS chunk_ord, string_agg(unit, chr(10) || chr(10) ORDER BY n) AS text FROM fold GROUP BY 1, 2"""

# -- model stage ---------------------------------------------------------------------------------------------

ORACLE["complete_batch"] = "SELECT conv_id AS conv_key, turn AS chunk_ord, CASE WHEN length(text) % 7 <> 0 THEN 'echo ' || text END AS output, CASE WHEN length(text) % 7 = 0 THEN 'RuntimeError: refused' END AS error FROM conversations"
ORACLE["complete_with_ledger"] = """SELECT conv_id AS conv_key, turn AS chunk_ord,
  CASE length(text) % 7 WHEN 0 THEN NULL WHEN 1 THEN 'second ' || text ELSE 'first ' || text END AS output, CASE WHEN text IS NULL THEN 'no prompt' WHEN length(text) % 7 = 0 THEN 'RuntimeError: refused' END AS error FROM conversations"""
ORACLE["parse_sections"] = f"""SELECT conv_id AS conv_key, turn AS chunk_ord, CASE WHEN turn % 5 = 3 THEN {q(K.NOTE_NO_OBJECT)} END AS error,
  CASE WHEN turn % 5 <> 3 THEN 'State of turn ' || CAST(turn AS STRING) END AS now, CASE WHEN turn % 5 <> 3 THEN CAST(1 AS BIGINT) END AS n_decided, CASE WHEN turn % 5 <> 3 THEN CAST(2 AS BIGINT) END AS n_open,
  CASE turn % 5 WHEN 3 THEN NULL WHEN 2 THEN CAST(0 AS BIGINT) ELSE CAST(2 AS BIGINT) END AS n_verbatim, CASE WHEN turn % 5 <> 3 THEN 'use Plan ' || CAST((turn + 1) % 2 AS STRING) END AS idea,
  CASE WHEN turn % 5 NOT IN (2, 3) THEN 'constraint' END AS kind, CASE WHEN turn % 5 NOT IN (2, 3) THEN text END AS value, CASE WHEN turn % 5 NOT IN (2, 3) THEN 'chat' END AS source FROM conversations"""
MODES = "modes AS (SELECT conv_id AS conv_key, count(*) AS chunks, count(*) FILTER (turn % 5 <> 3) AS parsed_chunks FROM conversations GROUP BY 1)"
ORACLE["select_minibriefs"] = f"WITH {MODES} SELECT *, CASE parsed_chunks WHEN 0 THEN 'deterministic' WHEN 1 THEN 'single' ELSE 'merge' END AS mode FROM modes"
ORACLE["fallback_notes"] = f"""WITH {MODES} SELECT conv_id AS conv_key, turn AS ord, 'Chunk ' || CAST(turn + 1 AS STRING) || '/' || CAST(chunks AS STRING) || ' did not parse ({K.NOTE_NO_OBJECT}); its raw model output was kept out of the merge.' AS note
FROM conversations JOIN modes ON modes.conv_key = conv_id WHERE turn % 5 = 3 UNION ALL SELECT conv_key, chunks, {q(K.NOTE_NO_CHUNK)} FROM modes WHERE parsed_chunks = 0"""
ORACLE["merge_fallback"] = """WITH l AS (SELECT conv_id, max(turn) FILTER (turn % 5 <> 3) AS t FROM conversations GROUP BY 1)
SELECT conv_id AS conv_key, 'State of turn ' || CAST(CASE WHEN conv_id % 2 = 0 THEN 0 ELSE t END AS STRING) AS now,
  CASE WHEN conv_id % 2 = 1 THEN 'Merge step did not parse (bad); used the final chunk''s brief as the resolved state.' END AS note FROM l"""
ORACLE["merge_latest_state"] = """WITH p AS (SELECT conv_id AS conv_key, turn, text FROM conversations WHERE turn % 5 <> 3),
items AS (SELECT conv_key, turn, 'now' AS section, 0 AS pos, 'now' AS thread, 'State of turn ' || CAST(turn AS STRING) AS a, CAST(NULL AS STRING) AS b, CAST(NULL AS STRING) AS c FROM p
 UNION ALL SELECT conv_key, turn, 'decided', 0, 't:use plan ' || CAST(turn % 2 AS STRING), 'Use plan ' || CAST(turn % 2 AS STRING), NULL, NULL FROM p
 UNION ALL SELECT conv_key, turn, 'open', 0, 't:ask about plan ' || CAST(turn % 3 AS STRING), 'Ask  about plan ' || CAST(turn % 3 AS STRING), NULL, NULL FROM p
 UNION ALL SELECT conv_key, turn, 'open', 1, 't:check', 'Check the distiller output', NULL, NULL FROM p
 UNION ALL SELECT conv_key, turn, 'rejected', 0, 't:use plan ' || CAST((turn + 1) % 2 AS STRING), 'use Plan ' || CAST((turn + 1) % 2 AS STRING), 'too slow', NULL FROM p
 UNION ALL SELECT conv_key, turn, 'verbatim', 0, 'v:timeout', 'constraint', 'timeout', CAST(turn AS STRING) || 's' FROM p WHERE turn % 5 <> 2
 UNION ALL SELECT conv_key, turn, 'verbatim', 1, 'v:body', 'code', 'body', text FROM p WHERE turn % 5 <> 2
 UNION ALL SELECT conv_key, turn, 'files', 0, 'f:' || CAST(turn % 2 AS STRING), 'note_' || CAST(turn % 2 AS STRING) || '.md', 'ask', 'chat' FROM p WHERE turn % 5 <> 2)
SELECT conv_key, section, turn AS chunk_ord, a, b, c FROM items QUALIFY row_number() OVER (PARTITION BY conv_key, thread ORDER BY turn DESC, pos) = 1"""
ORACLE["reconcile_files"] = f"""WITH {FACTS}, files AS (SELECT * FROM f_made UNION ALL SELECT conv_id, 1000, turn, 0,
  CASE turn % 4 WHEN 0 THEN 'report_' || CAST(conv_id % 8 AS STRING) || '.DOCX' WHEN 1 THEN 'new.csv' WHEN 2 THEN 'x/new.txt' ELSE 'ref.txt' END, 'model', CASE WHEN turn % 4 >= 2 THEN 'referenced' ELSE 'chat' END FROM conversations),
{DEDUPED} SELECT conv_key, name, why, source FROM listed"""
ORACLE["drop_meta"] = f"""WITH r AS (SELECT conv_id AS conv_key, turn, text || CASE turn % 4 WHEN 0 THEN ' the Handoff' WHEN 1 THEN ' verbatim  section' WHEN 2 THEN ' undercounting' ELSE ' handoffs' END AS idea,
  CASE WHEN turn % 4 = 3 AND conv_id % 3 = 0 THEN 'an extractor' ELSE 'extractors' END AS why FROM conversations)
SELECT * FROM r WHERE NOT regexp_matches(idea, {q(K.SELF_REFERENCE)}) AND NOT regexp_matches(why, {q(K.SELF_REFERENCE)})"""
MODEL = "model AS (SELECT conv_key, 0 AS turn_, ordinal, pos, kind, replace(value, ' turn ', ' TURN ') AS value FROM f_tables WHERE ordinal = 1 UNION ALL SELECT conv_key, 0, ordinal, pos, 'image', upper(value) FROM images WHERE pos = 0)"


def lap(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({x}), '[^a-z0-9.%$]+'), lambda t: length(t) > 0))"


OVER = "len(list_intersect({a}, {b})) / least(len({a}), len({b}))"
ORACLE["guarantee_tables"] = f"""WITH RECURSIVE {FACTS}, {LAST_IMAGES}, {MODEL},
seq AS (SELECT conv_key, 0 AS is_new, ordinal, pos, value FROM model WHERE kind = 'table' UNION ALL SELECT conv_key, 1, ordinal, pos, value FROM f_tables),
t AS (SELECT *, {lap('value')} AS toks, row_number() OVER (PARTITION BY conv_key ORDER BY is_new, ordinal, pos) AS n FROM seq),
fold AS (SELECT conv_key, n, [toks] AS known, is_new = 1 AS added FROM t WHERE n = 1 UNION ALL
  SELECT conv_key, n, CASE WHEN is_new = 1 AND hit THEN known ELSE list_append(known, toks) END, is_new = 1 AND NOT hit FROM (
    SELECT t.conv_key, t.n, t.is_new, t.toks, f.known, len(list_filter(f.known, lambda k: {OVER.format(a='k', b='t.toks')} >= 0.8)) > 0 AS hit FROM fold f JOIN t ON t.conv_key = f.conv_key AND t.n = f.n + 1))
SELECT conv_key, kind, value FROM model UNION ALL SELECT t.conv_key, 'table', t.value FROM t JOIN fold f USING (conv_key, n) WHERE f.added"""
ORACLE["guarantee_tables_in_rounds"] = ORACLE["guarantee_tables"]
ORACLE["guarantee_images"] = f"""WITH {FACTS}, {LAST_IMAGES}, {MODEL} SELECT conv_key, kind, value FROM model UNION ALL SELECT conv_key, 'image', value FROM images WHERE pos <> 0"""
ORACLE["table_overlap"] = f"""WITH d AS (SELECT doc_id, {lap('text')} AS a, {lap("'the of and ' || lang || ' ' || source || ' ' || coalesce(CAST(quality AS STRING), '')")} AS b FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN least(len(a), len(b)) = 0 THEN 0.0 ELSE round({OVER.format(a='a', b='b')}, 6) END AS overlap FROM d"""
ORACLE["guarantee_count"] = f"""WITH {FACTS}, files AS (SELECT conv_key, src, ordinal, pos, name FROM f_made UNION ALL SELECT conv_id, 2, turn, 0, 'part_' || CAST(turn AS STRING) || '.md' FROM conversations WHERE role = 'assistant'),
nows AS (SELECT DISTINCT conv_id AS conv_key, CASE WHEN conv_id % 3 = 0 THEN '' ELSE ' Made PART_1.md and part_2.md ' END AS now FROM conversations),
v AS (SELECT conv_key, now, count(name) AS n, bool_and(contains(lower(now), lower(name))) AS named, string_agg(name, ', ' ORDER BY src, ordinal, pos) AS names FROM nows LEFT JOIN files USING (conv_key) GROUP BY 1, 2)
SELECT conv_key, CAST(0 AS BIGINT) AS part, CASE WHEN n >= 2 AND NOT named THEN CASE WHEN now = '' THEN '' ELSE trim(now) || ' ' END || 'Files produced in this chat (' || CAST(n AS STRING) || '): ' || names || '.' ELSE now END AS now FROM v WHERE n >= 2 AND NOT named OR now <> ''"""

# -- rendering ---------------------------------------------------------------------------------------------------

NL = "chr(10)"


def item(kind: str, label: str, value: str, lang: str) -> str:
    return f"""CASE WHEN {kind} = 'table' THEN '**' || {label} || '**' || {NL} || {NL} || {value} WHEN {kind} = 'code' THEN '**' || {label} || '**' || {NL} || {NL} || '```' || coalesce({lang}, '') || {NL} || {value} || {NL} || '```'
  WHEN {kind} = 'image' AND regexp_matches({value}, '(?i)^(https?:|data:image/)') THEN '![' || {label} || '](' || {value} || ')' WHEN {kind} = 'image' THEN '- **' || {label} || '** (image): ' || {value}
  ELSE '- **' || {label} || '** (' || {kind} || '): `' || {value} || '`' END"""


ORACLE["render_item"] = f"""WITH r AS (SELECT conv_id, turn, role, CASE turn % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'code' WHEN 2 THEN 'image' WHEN 3 THEN 'api' ELSE 'image' END AS kind,
  CASE WHEN turn % 5 = 4 THEN 'HTTPS://x.example/' || CAST(turn AS STRING) ELSE text END AS value, CASE WHEN conv_id % 2 = 0 THEN 'sql' END AS lang FROM conversations)
SELECT conv_id, turn, {item('kind', 'role', 'value', 'lang')} AS item FROM r"""


def banner(odd: str) -> str:
    return f"'> ⚠️ **Capture not 100% clean.** ' || CAST({odd} AS STRING) || ' block(s) could not be parsed and are listed raw below, review them; nothing was dropped silently.'"


ORACLE["honesty_banner"] = f"""WITH r AS (SELECT conv_id, count(*) FILTER (role = 'system') AS odd, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, concat_ws({NL}, CASE WHEN odd > 0 THEN {banner('odd')} END, CASE WHEN n % 2 = 0 THEN '> ⚠️ **Distiller fell back** in places: Chunk ' || CAST(n AS STRING) || ' failed. Merged.' END) AS banner FROM r"""


def section(title: str, body: str) -> str:
    return f"'## {title}' || {NL} || {NL} || {body} || {NL}"


BRIEF = f"""{FULL}, {VERBATIM}, {ALL_FILES},
counts AS (SELECT conv_key, count(*) AS n FROM seeded GROUP BY 1), made AS (SELECT conv_key, string_agg(name, ', ' ORDER BY src, ordinal, pos) AS names FROM listed WHERE source = 'chat' GROUP BY 1),
nows AS (SELECT conv_key, {NOW} AS now FROM counts LEFT JOIN made USING (conv_key)),
verb AS (SELECT conv_key, count(*) AS n_verb, string_agg({item('kind', 'label', 'value', 'language')}, {NL} || {NL} ORDER BY src, ordinal, pos) AS verb FROM items GROUP BY 1),
attach AS (SELECT conv_key, count(*) AS n_files, string_agg('- `' || name || '`, ' || why || ' _(' || source || ')_', {NL} ORDER BY src, ordinal, pos) AS attach FROM listed GROUP BY 1),
odd AS (SELECT conv_id AS conv_key, count(*) AS n_odd, string_agg('- `type:mystery` (message message-): {{"type":"mystery"}}', {NL}) AS odd FROM conversations WHERE role = 'system' GROUP BY 1),
bodies AS (SELECT conv_key, coalesce(n_verb, 0) AS n_verb, coalesce(n_files, 0) AS n_files, coalesce(n_odd, 0) AS n_odd, concat_ws({NL}, {section('Now', 'now')}, CASE WHEN verb IS NOT NULL THEN {section('Verbatim, keep exact', 'verb')} END,
   CASE WHEN attach IS NOT NULL THEN {section('Bring these for full context', 'attach')} END, CASE WHEN odd IS NOT NULL THEN {section('Raw, could not parse (review these)', 'odd')} END) AS body
  FROM nows LEFT JOIN verb USING (conv_key) LEFT JOIN attach USING (conv_key) LEFT JOIN odd USING (conv_key)),
framed AS (SELECT *, CASE WHEN n_odd > 0 THEN {banner('n_odd')} || {NL} ELSE '' END || body AS inner_,
  '# Handoff brief, Chat ' || CAST(conv_key AS STRING) || {NL} || {NL} || '_briefspark · schema v1 · produced by deterministic · generated 2026-06-26._' || {NL} AS head FROM bodies)"""
ORACLE["render_body"] = f"WITH RECURSIVE {BRIEF} SELECT conv_key, CAST(0 AS BIGINT) AS part, body FROM bodies"
ORACLE["render_brief"] = f"""WITH RECURSIVE {BRIEF} SELECT conv_key, CAST(0 AS BIGINT) AS part, head || {NL} || inner_ AS human_md, {q(K.RESUME_HEADER)} || {NL} || inner_ || {NL} || {q(K.RESUME_FOOTER)} AS resume_prompt FROM framed"""

# -- evaluation -----------------------------------------------------------------------------------------------------

CARD = f"""{BRIEF}, {UNITS}, sizes AS (SELECT conv_key, sum(length(unit)) + 2 * (count(*) - 1) AS full_chars FROM units GROUP BY 1),
card AS (SELECT conv_key AS id, CAST(full_chars AS BIGINT) AS full_chars, length(head || {NL} || inner_) AS brief_chars, 1 - length(head || {NL} || inner_) / full_chars AS reduction, n_odd = 0 AS integrity_complete,
  CAST(0 AS BIGINT) AS decided, CAST(0 AS BIGINT) AS open, CAST(0 AS BIGINT) AS rejected, n_verb AS verbatim, n_files AS files FROM framed JOIN sizes USING (conv_key))"""
ORACLE["brief_metrics"] = f"WITH RECURSIVE {CARD} SELECT id, full_chars, brief_chars, round(reduction, 6) AS reduction, integrity_complete, decided, open, rejected, verbatim, files FROM card"
ORACLE["scorecard_markdown"] = f"""WITH RECURSIVE {CARD} SELECT id, '| ' || CAST(id AS STRING) || ' | ' || CAST(full_chars AS STRING) || '→' || CAST(brief_chars AS STRING) || ' (−' || CAST(CAST(floor(reduction * 100 + 0.5) AS BIGINT) AS STRING) || '%) | ' ||
  CASE WHEN integrity_complete THEN '✓' ELSE '⚠ partial' END || ' | 0/0/0/' || CAST(verbatim AS STRING) || '/' || CAST(files AS STRING) || ' | ,  |' AS line FROM card"""
ORACLE["scorecard_document"] = f"""WITH RECURSIVE {CARD}, verdicts AS (SELECT conv_id AS id, turn % 4 IN (0, 3) AS same_move, CASE turn % 4 WHEN 0 THEN 'same' WHEN 1 THEN '' WHEN 2 THEN 'judge output did not parse: ' || substr(text, 1, 120) ELSE role END AS reasoning FROM conversations WHERE turn = conv_id % 5),
j AS (SELECT * FROM card LEFT JOIN verdicts USING (id))
SELECT CAST(part AS BIGINT) AS part, CAST(place AS BIGINT) AS place, '' AS id, line FROM (VALUES (0, 0, '# briefspark eval scorecard'), (0, 1, ''), (0, 2, 'Mode: **full judgement** (model: `stand-in`).'), (0, 3, ''),
  (0, 4, '| Fixture | Full→Brief size | Integrity | Decided/Open/Rejected/Verbatim/Files | Same next move? |'), (0, 5, '|---|---|---|---|---|'), (2, 0, ''), (3, 0, ''), (3, 1, '## Judge reasoning'), (3, 2, '')) v(part, place, line)
UNION ALL SELECT 1, 0, CAST(id AS STRING), '| ' || CAST(id AS STRING) || ' | ' || CAST(full_chars AS STRING) || '→' || CAST(brief_chars AS STRING) || ' (−' || CAST(CAST(floor(reduction * 100 + 0.5) AS BIGINT) AS STRING) || '%) | ' ||
  CASE WHEN integrity_complete THEN '✓' ELSE '⚠ partial' END || ' | 0/0/0/' || CAST(verbatim AS STRING) || '/' || CAST(files AS STRING) || ' | ' || CASE WHEN same_move IS NULL THEN ', ' WHEN same_move THEN '✅ yes' ELSE '❌ no' END || ' |' FROM j
UNION ALL SELECT 2, 1, '', '**Same-next-move pass rate: ' || CAST(count(*) FILTER (same_move) AS STRING) || '/' || CAST(count(*) AS STRING) || '**' FROM j
UNION ALL SELECT 4, 0, CAST(id AS STRING), '- **' || CAST(id AS STRING) || '**: ' || reasoning FROM j WHERE same_move IS NOT NULL"""
ORACLE["corpus_summary"] = f"""WITH RECURSIVE {CARD}, {URLS}, plat AS (SELECT conv_id AS id, min({platform_case()}) AS platform FROM chat_urls GROUP BY 1)
SELECT platform, count(*) AS conversations, CAST(sum(full_chars) AS BIGINT) AS full_chars, CAST(sum(brief_chars) AS BIGINT) AS brief_chars FROM card JOIN plat USING (id) GROUP BY ROLLUP (platform)"""
ORACLE["corpus_quantiles"] = f"""WITH RECURSIVE {CARD}, {URLS}, plat AS (SELECT conv_id AS id, min({platform_case()}) AS platform FROM chat_urls GROUP BY 1)
SELECT platform, count(*) AS conversations, round(quantile_disc(reduction, 0.1), 6) AS p10, round(quantile_disc(reduction, 0.5), 6) AS median,
  round(quantile_disc(reduction, 0.9), 6) AS p90, round(2.296 / pow(4096, 0.9723), 6) AS rank_error FROM card JOIN plat USING (id) GROUP BY ROLLUP (platform)"""
ORACLE["parse_verdict"] = """SELECT conv_id, turn, turn % 4 IN (0, 3) AS same_move, CASE turn % 4 WHEN 0 THEN 'same' WHEN 1 THEN '' WHEN 2 THEN 'judge output did not parse: ' || substr(text, 1, 120) ELSE role END AS reasoning FROM conversations"""
ORACLE["pass_rate"] = "SELECT count(*) AS n, count(*) FILTER (turn % 4 IN (0, 3)) AS passed, round(count(*) FILTER (turn % 4 IN (0, 3)) / count(*), 6) AS rate FROM conversations"

# -- the model way with the stand-in model ------------------------------------------------------------------------

MODELLED = f"""{BRIEF}, {UNITS},
unit_no AS (SELECT conv_key, unit, length(unit) + 2 AS cost, row_number() OVER (PARTITION BY conv_key ORDER BY src, ordinal) AS n FROM units),
cut AS (SELECT conv_key, n, unit, cost AS load, CAST(0 AS BIGINT) AS chunk FROM unit_no WHERE n = 1
  UNION ALL SELECT u.conv_key, u.n, u.unit, CASE WHEN load + cost > 1500 THEN cost ELSE load + cost END, CASE WHEN load + cost > 1500 THEN chunk + 1 ELSE chunk END FROM cut f JOIN unit_no u ON u.conv_key = f.conv_key AND u.n = f.n + 1),
asked AS (SELECT conv_key, chunk, 'CHUNK ' || string_agg(unit, chr(10) || chr(10) ORDER BY n) AS prompt FROM cut GROUP BY 1, 2),
answered AS (SELECT conv_key, chunk, contains(prompt, '| key | value |') AND length(prompt) % 5 = 0 AS bad, count(*) OVER (PARTITION BY conv_key) AS chunks FROM asked),
modes AS (SELECT conv_key, CASE count(*) FILTER (NOT bad) WHEN 0 THEN 'deterministic' WHEN 1 THEN 'single' ELSE 'merge' END AS mode,
  concat_ws(' ', string_agg('Chunk ' || CAST(chunk + 1 AS STRING) || '/' || CAST(chunks AS STRING) || ' did not parse ({K.NOTE_NO_OBJECT}); its raw model output was kept out of the merge.', ' ' ORDER BY chunk) FILTER (bad),
    CASE WHEN count(*) FILTER (NOT bad) = 0 THEN {q(K.NOTE_NO_CHUNK)} END) AS notes FROM answered GROUP BY 1),
said AS (SELECT conv_key, mode, notes, CASE mode WHEN 'single' THEN 'One chunk.' WHEN 'merge' THEN 'Merged.' END AS now FROM modes),
listing AS (SELECT conv_key, count(*) AS n, bool_and(contains(lower(now), lower(name))) AS all_named, string_agg(name, ', ' ORDER BY src, ordinal, pos) AS names FROM said JOIN listed USING (conv_key) WHERE source = 'chat' GROUP BY 1),
tab AS (SELECT conv_key, src, ordinal, pos, {lap('value')} AS toks, row_number() OVER (PARTITION BY conv_key ORDER BY src, ordinal, pos) AS n FROM items WHERE kind = 'table'),
tabs AS (SELECT conv_key, n, [toks] AS known, true AS added FROM tab WHERE n = 1 UNION ALL
  SELECT conv_key, n, CASE WHEN hit THEN known ELSE list_append(known, toks) END, NOT hit FROM (
    SELECT t.conv_key, t.n, t.toks, f.known, len(list_filter(f.known, lambda k: {OVER.format(a='k', b='t.toks')} >= 0.8)) > 0 AS hit FROM tabs f JOIN tab t ON t.conv_key = f.conv_key AND t.n = f.n + 1)),
lacking AS (SELECT i.* FROM items i LEFT JOIN tab t ON t.conv_key = i.conv_key AND t.src = i.src AND t.ordinal = i.ordinal AND t.pos = i.pos AND i.kind = 'table'
  LEFT JOIN tabs f ON f.conv_key = t.conv_key AND f.n = t.n WHERE i.kind = 'image' OR i.kind = 'table' AND f.added),
model_verb AS (SELECT conv_key, string_agg({item('kind', 'label', 'value', 'language')}, {NL} || {NL} ORDER BY src, ordinal, pos) AS verb FROM lacking GROUP BY 1),
model_bodies AS (SELECT s.conv_key, mode, notes, coalesce(n_odd, 0) AS n_odd, concat_ws({NL},
   {section('Now', "CASE WHEN mode = 'deterministic' THEN d.now WHEN l.n >= 2 AND NOT l.all_named THEN s.now || ' Files produced in this chat (' || CAST(l.n AS STRING) || '): ' || l.names || '.' ELSE s.now END")},
   CASE WHEN mode = 'merge' THEN {section('Decided', "'- Keep the plan'")} END, CASE WHEN mode = 'single' THEN {section('Open', "'- Next step'")} END,
   CASE WHEN mode = 'deterministic' AND v.verb IS NOT NULL THEN {section('Verbatim, keep exact', 'v.verb')} WHEN mode <> 'deterministic' AND m.verb IS NOT NULL THEN {section('Verbatim, keep exact', 'm.verb')} END,
   CASE WHEN attach IS NOT NULL THEN {section('Bring these for full context', 'attach')} END, CASE WHEN odd IS NOT NULL THEN {section('Raw, could not parse (review these)', 'odd')} END) AS body
  FROM said s JOIN nows d USING (conv_key) LEFT JOIN listing l USING (conv_key) LEFT JOIN verb v USING (conv_key) LEFT JOIN model_verb m USING (conv_key) LEFT JOIN attach USING (conv_key) LEFT JOIN odd USING (conv_key)),
model_framed AS (SELECT *, 'stand-in' || CASE WHEN mode = 'deterministic' THEN ' (fallback: deterministic)' ELSE '' END AS produced_by FROM model_bodies)"""
ORACLE["distill_with_model"] = f"""WITH RECURSIVE {MODELLED} SELECT conv_key, CAST(0 AS BIGINT) AS part,
  '# Handoff brief, Chat ' || CAST(conv_key AS STRING) || {NL} || {NL} || '_briefspark · schema v1 · produced by ' || produced_by || ' · generated 2026-06-26._' || {NL} || {NL}
  || CASE WHEN n_odd > 0 THEN {banner('n_odd')} || {NL} ELSE '' END || CASE WHEN notes <> '' THEN '> ⚠️ **Distiller fell back** in places: ' || notes || {NL} ELSE '' END || body AS human_md FROM model_framed"""
ORACLE["model_modes"] = f"WITH RECURSIVE {MODELLED} SELECT conv_key, produced_by, notes FROM model_framed"

# -- all platforms in one table -------------------------------------------------------------------------------------

MIXED = {  # conversation id and title that each platform's chats get
    "hf": ("'huggingface-chat'", "'Chat'"), "deepseek": ("'deepseek'", "'DeepSeek chat'"), "grok": ("'grok'", "'Talk'"), "perplexity": ("conv_key", "'Thread'"),
    "chatgpt": ("conv_key", "'Chat'"), "gemini": ("'gemini'", "'Gemini conversation'"), "claude": ("conv_key", "'Talk'"),
}
ORACLE["normalize_mixed_messages"] = " UNION ALL ".join(
    f"SELECT conv_key, ordinal, role, text FROM ({ORACLE[f'normalize_{name}']}) WHERE CAST(conv_key AS BIGINT) % {len(MIXED)} = {n}" for n, name in enumerate(MIXED)
)
ORACLE["normalize_mixed_meta"] = "WITH c AS (SELECT DISTINCT conv_id, CAST(conv_id AS STRING) AS conv_key FROM conversations) " + " UNION ALL ".join(
    f"SELECT conv_key, {ident} AS conversation_id, {title} AS title, '2026-06-26T00:00:00Z' AS captured_at FROM c WHERE conv_id % {len(MIXED)} = {n}" for n, (ident, title) in enumerate(MIXED.values())
)
