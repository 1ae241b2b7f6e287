"""The same results in SQL for another engine, written against the given tables."""

from __future__ import annotations

# Fixed values, written down anew so that a change of the code under test shows: the usual English stop-word list, without the
# words with an apostrophe, which expansion knows.
STOP_WORDS = """
a about above after again against ain all am an and any are aren as at be because been before being below between both but by
can couldn d did didn do does doesn doing don down during each few for from further had hadn has hasn have haven having he her
here hers herself him himself his how i if in into is isn it its itself just ll m ma me mightn more most mustn my myself
needn no nor not now o of off on once only or other our ours ourselves out over own re s same shan she should shouldn so some
such t than that the their theirs them themselves then there these they this those through to too under until up ve very was wasn
we were weren what when where which while who whom why will with won wouldn y you your yours yourself yourselves
""".split()

# The white space a browser trims from an input field, as the body of a character class.
BROWSER_WHITESPACE = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"

PROMPT_HEAD = (
    "You sort customer complaints. For each numbered complaint below name the team in charge (Admin, Developers, Payments, "
    "Quality Control, Logistics, Miscellaneous) and how severe it is, from 1 to 5. Reply with one line each, such as: 1. Team, 3. "
    "Complaints:\n"
)

# The white-space characters, as the body of a character class.
WHITESPACE = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# None of the informal forms of expansion is a stop word.
_DROPPED = ", ".join(f"'{word}'" for word in STOP_WORDS)
# Written down by hand: what becomes of the informal forms.
_INFORMAL = {
    "gonna": "going to", "wanna": "want to", "gotta": "got to", "kinda": "kind of", "sorta": "sort of", "outta": "out of",
}
_KEPT = f"[^a-zA-Z0-9{WHITESPACE}]"

# (pattern, replacement) in the order in which they apply.
_CONTRACTIONS = [
    (r"\bain't\b", "are not"),
    (r"\bcan't\b", "cannot"),
    (r"\bwon't\b", "will not"),
    (r"\bshan't\b", "shall not"),
    (r"\blet's\b", "let us"),
    (r"\by'all\b", "you all"),
    (r"\bo'clock\b", "of the clock"),
    (r"\bma'am\b", "madam"),
    (r"([a-z])n't\b", r"\1 not"),
    (r"([a-z])'re\b", r"\1 are"),
    (r"([a-z])'ve\b", r"\1 have"),
    (r"([a-z])'ll\b", r"\1 will"),
    (r"\b(how|where|why|what|who|when)'d\b", r"\1 did"),
    (r"([a-z])'d\b", r"\1 would"),
    (r"\b(i)'m\b", r"\1 am"),
    (r"\b(he|she|it|that|there|here|what|who|where|when|why|how)'s\b", r"\1 is"),
]


def _without_stop_words(text: str) -> str:
    return f"array_to_string(list_filter(string_split({text}, ' '), lambda w: lower(w) NOT IN ({_DROPPED})), ' ')"


def _collapsed(text: str) -> str:
    return f"trim(regexp_replace({text}, '[{WHITESPACE}]+', ' ', 'g'), ' ')"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _expand(text: str) -> str:
    word = "replace(w, '’', '''')"
    for pattern, long in _CONTRACTIONS:
        word = f"regexp_replace({word}, {_quoted(pattern)}, {_quoted(long)}, 'gi')"
    ruled = (
        f"array_to_string(list_transform(string_split({_collapsed(text)}, ' '),"
        f" lambda w: CASE WHEN w LIKE '%''%' OR w LIKE '%’%' THEN {word} ELSE w END), ' ')"
    )
    informal = " ".join(f"WHEN '{short}' THEN '{long}'" for short, long in _INFORMAL.items())
    return f"array_to_string(list_transform(string_split({ruled}, ' '), lambda w: CASE lower(w) {informal} ELSE w END), ' ')"


def _preprocessed(text: str) -> str:
    return f"regexp_replace({_expand(_without_stop_words(text))}, '{_KEPT}', '', 'g')"


def _escaped(text: str) -> str:
    for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")]:
        text = f"replace({text}, '{char}', '{entity}')"
    return text


def _time(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {column}"


_TICKET_ID = "'t' || lpad(CAST({} AS VARCHAR), 12, '0')"
_DONE = "TIMESTAMP '2024-03-01 00:00:00'"
_TICKET = f"ticket_id, {_time('raised_ts')}, team_name, severity_level, status, {_time('resolved_ts')}"

# Named building blocks; each may use the ones before it.
_VIEWS = {
    "complaints": f"""
        SELECT doc_id, lang, {_TICKET_ID.format('doc_id')} AS ticket_id,
               'user' || (doc_id % 97) || '@example.com' AS user_id,
               CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id AS VARCHAR) END AS order_id,
               text AS complaint_text, 'new' AS status,
               TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 37) AS raised_ts,
               strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 37), '%Y-%m-%d %H:%M:%S') AS timestamp
        FROM documents""",
    "received": "SELECT * FROM complaints",
    "store": """
        SELECT * REPLACE (CASE WHEN doc_id % 29 = 0 THEN NULL
            ELSE ['new', 'delegated', 'pending', 'resolved'][doc_id % 4 + 1] END AS status)
        FROM complaints""",
    "lexicon": f"""
        SELECT word, ['Admin', 'Developers', 'Payments', 'Quality Control', 'Logistics', 'Miscellaneous']
                     [length(word) % 6 + 1] AS team, length(word) % 6 AS place
        FROM (SELECT DISTINCT unnest(string_split(
                lower(regexp_replace({_collapsed('text')}, '{_KEPT}', '', 'g')), ' ')) AS word FROM benchmark)
        WHERE word <> ''""",
    "cleaned": f"SELECT *, {_preprocessed('complaint_text')} AS cleaned FROM complaints",
    "hits": """
        SELECT ticket_id, team, place, count(*) AS n
        FROM (SELECT ticket_id, unnest(string_split(lower(cleaned), ' ')) AS word FROM cleaned) JOIN lexicon USING (word)
        GROUP BY ticket_id, team, place""",
    "best": "SELECT ticket_id, team, n FROM hits QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY n DESC, place) = 1",
    "classified": """
        SELECT c.ticket_id, c.raised_ts, c.user_id, c.complaint_text, c.doc_id, c.lang,
               CASE WHEN b.n IS NULL THEN 'Miscellaneous' ELSE b.team END AS team,
               CAST(CASE WHEN b.n IS NULL THEN 3 ELSE least(5, 1 + b.n // 25) END AS INTEGER) AS severity
        FROM complaints c LEFT JOIN best b USING (ticket_id)""",
    "born": """
        SELECT ticket_id, raised_ts, team AS team_name, severity AS severity_level, 'delegated' AS status,
               CAST(NULL AS TIMESTAMP) AS resolved_ts, lang
        FROM classified""",
    "tickets": """
        SELECT c.ticket_id, c.raised_ts, c.team AS team_name, c.severity AS severity_level, s.status,
               CASE WHEN s.status = 'resolved' THEN c.raised_ts + to_hours(c.doc_id % 240) END AS resolved_ts
        FROM classified c JOIN store s USING (ticket_id)""",
    "requests": f"SELECT event_id, ts, event_type, upper({_TICKET_ID.format('event_id')}) AS ticket_id FROM events",
    "picked": """
        SELECT ticket_id, status FROM store WHERE status <> 'resolved'
        ORDER BY md5('7' || ticket_id), ticket_id LIMIT 2""",
    "opened": "SELECT ticket_id, status FROM store WHERE status <> 'resolved'",
    "lines": """
        SELECT ticket_id, cleaned, length(cleaned) AS chars, (k - 1) // 1000 AS run, (k - 1) % 1000 + 1 AS place
        FROM (SELECT ticket_id, cleaned, row_number() OVER (ORDER BY raised_ts, ticket_id) AS k FROM cleaned)""",
    "packed": f"""
        SELECT ticket_id, run, place, 1 AS batch, 1 AS item, (chars + 4) // 4 AS tokens,
               {len(PROMPT_HEAD) // 4} + (chars + 4) // 4 AS used
        FROM lines WHERE place = 1
        UNION ALL
        SELECT ticket_id, run, place, CASE WHEN fits THEN batch ELSE batch + 1 END, CASE WHEN fits THEN item + 1 ELSE 1 END,
               CASE WHEN fits THEN line ELSE (chars + 4) // 4 END,
               CASE WHEN fits THEN used + line ELSE {len(PROMPT_HEAD) // 4} + (chars + 4) // 4 END
        FROM (SELECT l.ticket_id, l.run, l.place, l.chars, p.batch, p.item, p.used,
                     (l.chars + length(CAST(p.item + 1 AS VARCHAR)) + 3) // 4 AS line,
                     p.used + (l.chars + length(CAST(p.item + 1 AS VARCHAR)) + 3) // 4 <= 15000 AS fits
              FROM packed p JOIN lines l ON l.run = p.run AND l.place = p.place + 1)""",
    "answered": """
        SELECT ticket_id, run, batch, item, n,
               n % 31 <> 0 AND n % 41 <> 0 AS usable,
               ['Admin', 'Developers', 'Payments', 'Quality Control', 'Logistics', 'Miscellaneous'][n % 6 + 1] AS team,
               CAST(1 + n % 5 AS INTEGER) AS severity
        FROM (SELECT p.*, length(list_filter(string_split(l.cleaned, ' '), lambda w: w <> '')) AS n
              FROM packed p JOIN lines l USING (ticket_id))""",
    "dialogs": f"""
        SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN upper({_TICKET_ID.format('event_id')}) END AS ticket_id,
               CASE event_type WHEN 'view' THEN 'CheckComplaintStatus' WHEN 'purchase' THEN 'ResolveComplaint'
                    WHEN 'signup' THEN 'SubmitComplaint' WHEN 'click' THEN 'WelcomeIntent' ELSE 'OtherIntent' END AS intent,
               CASE user_id % 4 WHEN 0 THEN 'check_status' WHEN 1 THEN 'resolve_status'
                    WHEN 2 THEN 'new_complaint' ELSE 'no idea' END AS answer,
               CASE user_id % 4 WHEN 0 THEN 'check' WHEN 1 THEN 'resolve' WHEN 2 THEN 'new' END AS intent_word
        FROM events""",
    "f1": "SELECT user_id AS key, min(struct_pack(t := ts, e := event_id)) AS s FROM events WHERE event_type = 'signup' GROUP BY user_id",
    **{
        f"f{n}": f"""
        SELECT key, s, s.t AS t, b FROM (
            SELECT p.key, min(struct_pack(t := v.ts, e := v.event_id)) AS s, any_value(p.s.t) AS b
            FROM f{n - 1} p JOIN events v ON v.user_id = p.key AND v.event_type = '{kind}' AND struct_pack(t := v.ts, e := v.event_id) > p.s
            GROUP BY p.key)"""
        for n, kind in ((2, "click"), (3, "view"), (4, "purchase"))
    },
    "history": """
        SELECT user_id AS key, list(event_type ORDER BY ts, event_id) AS steps FROM events GROUP BY user_id""",
}
_RECURSIVE = {"packed"}


def _uses(sql: str) -> list[str]:
    """The building blocks a statement needs, in their order."""
    import re

    needed: set[str] = set()
    for name in reversed(_VIEWS):
        texts = [sql] + [_VIEWS[other] for other in needed]
        if any(re.search(rf"\b(FROM|JOIN)\s+{name}\b", text) for text in texts):
            needed.add(name)
    return [name for name in _VIEWS if name in needed]


def _query(sql: str) -> str:
    names = _uses(sql)
    if not names:
        return sql
    recursive = "RECURSIVE " if _RECURSIVE & set(names) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({_VIEWS[n]})" for n in names) + "\n" + sql


def _paged(key: str, size: int) -> str:
    return f"""
        SELECT *, (k - 1) // {size} + 1 AS page
        FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY raised_ts, ticket_id) AS k FROM classified)"""


def _digest_body(key: str, intro: str, outro: str, heads: str, cells: list[str], closing: str) -> str:
    row = "'<tr>' || " + " || ".join(f"'<td>' || {cell} || '</td>'" for cell in cells) + " || '</tr>'"
    return (
        f"'<html><body><p>{intro}' || {_escaped(key)} || '{outro}</p><table><tr>{heads}</tr>'"
        f" || string_agg({row}, '' ORDER BY k) || '</table><p>{closing}</p></body></html>'"
    )


_CELLS = [_escaped("ticket_id"), _escaped("complaint_text")]
_TEAM_BODY = _digest_body(
    "team", "New complaints for team ", ":", "<th>Ticket</th><th>Complaint</th><th>Severity</th>",
    [*_CELLS, "CAST(severity AS VARCHAR)"], "Sent by a program; answers are not read.",
)
_USER_BODY = _digest_body(
    "user_id", "Hello ", ", these complaints of yours have reached us:", "<th>Ticket</th><th>Complaint</th>", _CELLS,
    "We are sorry for the trouble and will look into it. Sent by a program; answers are not read.",
)

_SPOKEN = "text"
for _ending, _short in [("tion ", "n''t "), ("ou ", "''ve "), ("que ", "''d "), (" it ", " it''s "), (" la ", " can’t ")]:
    _SPOKEN = f"replace({_SPOKEN}, '{_ending}', '{_short}')"

_INTENT_RULE = """
    CASE WHEN list_has_any(words, ['the', 'le']) THEN 'check_status'
         WHEN list_has_any(words, ['of', 'und']) THEN 'resolve_status'
         WHEN list_has_any(words, ['to', 'de']) THEN 'new_complaint' END"""

_SQL = {
    "src_complaint_stream": """
        SELECT ticket_id, user_id, order_id, md5(complaint_text) AS text_md5, status, timestamp FROM received
        UNION ALL
        SELECT ticket_id, user_id, order_id, md5(complaint_text), status, timestamp FROM received WHERE lang = 'en'""",
    "parse_complaint_json": f"""
        SELECT doc_id, ticket_id, user_id, order_id, complaint_text, status, timestamp, {_time('raised_ts')} FROM received
        UNION ALL
        SELECT doc_id, ticket_id, user_id, order_id, complaint_text, status, timestamp, {_time('raised_ts')}
        FROM received WHERE lang = 'en'""",
    "requeue_failed": "SELECT doc_id, lang FROM documents WHERE lang = 'de'",
    "publish_json": "SELECT doc_id, ticket_id, user_id, order_id, complaint_text, status, timestamp FROM complaints",
    "parse_chat_envelope": """
        SELECT conv_id, turn, text,
               CASE WHEN role = 'system' THEN 'unknown' ELSE 'user' || conv_id || '@example.com' END AS sender,
               CASE WHEN role = 'system' THEN 'unknown' ELSE 'user' || conv_id || '-at-example.com' END AS session
        FROM conversations""",
    "cap_batch": "SELECT event_id, ticket_id, row_number() OVER (ORDER BY ts, event_id) <= 1000 AS taken FROM requests",
    "append_tickets": f"SELECT {_TICKET} FROM born",
    "scan_open_tickets": "SELECT ticket_id, status FROM store WHERE status <> 'resolved'",
    "batch_get_new": """
        SELECT ticket_id, user_id, order_id, status, timestamp FROM store
        WHERE status = 'new' AND ticket_id IN (SELECT lower(ticket_id) FROM requests)""",
    "status_lookup": """
        SELECT event_id, ticket_id, status_text, 'Ticket ' || ticket_id || ' has this status: ' || status_text || '.' AS reply
        FROM (SELECT r.event_id, r.ticket_id, CASE WHEN s.ticket_id IS NULL THEN 'Ticket not found'
                     WHEN s.status IS NULL THEN 'No status available' ELSE s.status END AS status_text
              FROM requests r LEFT JOIN store s ON s.ticket_id = lower(r.ticket_id))""",
    "resolve_found": """
        SELECT event_id, ticket_id, lower(ticket_id) AS key, 'Ticket ' || ticket_id || ' is now resolved.' AS reply
        FROM requests r WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM store s WHERE s.ticket_id = lower(r.ticket_id))""",
    "resolve_missing": """
        SELECT event_id, ticket_id, lower(ticket_id) AS key,
               'There is no ticket ' || ticket_id || '. Please enter the id again.' AS reply
        FROM requests r
        WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM store s WHERE s.ticket_id = lower(r.ticket_id))""",
    "upsert_delegated": """
        SELECT ticket_id, user_id, order_id, md5(complaint_text) AS text_md5, status, timestamp, version
        FROM (SELECT *, CAST(0 AS INTEGER) AS version FROM store
              UNION ALL
              SELECT * REPLACE ('delegated' AS status), CAST(1 AS INTEGER) AS version FROM store WHERE status = 'new')
        QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY version DESC) = 1""",
    "apply_status_updates": f"""
        SELECT {_TICKET}
        FROM (SELECT t.* REPLACE (CASE WHEN r.key IS NULL THEN t.status ELSE 'resolved' END AS status,
                     CASE WHEN r.key IS NULL THEN t.resolved_ts ELSE {_DONE} END AS resolved_ts)
              FROM tickets t LEFT JOIN
                   (SELECT DISTINCT lower(ticket_id) AS key FROM requests WHERE event_type = 'purchase') r
                   ON r.key = t.ticket_id)""",
    "dedupe_tickets": "SELECT ticket_id, user_id, order_id, md5(complaint_text) AS text_md5, timestamp FROM received",
    "sample_open": "SELECT ticket_id, status FROM picked",
    "advance_status": """
        SELECT ticket_id, CASE WHEN status = 'delegated' THEN 'pending' ELSE 'resolved' END AS status,
               CASE WHEN status = 'delegated' THEN NULL ELSE '2024-03-01 00:00:00' END AS resolved_ts
        FROM store WHERE status <> 'resolved'""",
    "lifecycle_state": """
        SELECT key, nullif(list_reduce(list_prepend('none', steps), lambda s, e:
            CASE WHEN e = 'signup' THEN 'new'
                 WHEN s = 'none' THEN 'none'
                 WHEN e = 'click' AND s = 'new' THEN 'delegated'
                 WHEN e = 'view' AND s = 'delegated' THEN 'pending'
                 WHEN e IN ('view', 'purchase') AND s <> 'resolved' AND NOT (e = 'view' AND s = 'delegated') THEN 'resolved'
                 ELSE s END), 'none') AS state
        FROM history""",
    "remove_stopwords": f"SELECT doc_id, {_without_stop_words('text')} AS text FROM documents",
    "expand_contractions": f"""
        SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w:
            CASE lower(w) WHEN 'it' THEN 'that thing' WHEN 'les' THEN 'toutes les' WHEN 'und' THEN 'und auch' ELSE w END),
            ' ') AS text
        FROM (SELECT doc_id, {_expand(_SPOKEN)} AS text FROM documents)""",
    "remove_special": f"SELECT doc_id, regexp_replace(text, '{_KEPT}', '', 'g') AS text FROM documents",
    "preprocess_text": f"SELECT doc_id, {_preprocessed('text')} AS text FROM documents",
    "estimate_tokens": "SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS n FROM documents",
    "effective_stopwords": f"""
        SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents)
        WHERE word IN ({_DROPPED}) GROUP BY word""",
    "filter_nonblank": f"""
        SELECT conv_id, turn, text FROM conversations
        WHERE role <> 'system' AND regexp_matches(text, '[^{BROWSER_WHITESPACE}]')""",
    "classify_lexicon": "SELECT ticket_id, team, severity FROM classified",
    "ticket_rows": f"SELECT {_TICKET} FROM born",
    "pack_batches": """
        SELECT ticket_id, CAST(run AS BIGINT) AS run, CAST(batch AS INTEGER) AS batch, CAST(item AS INTEGER) AS item,
               CAST(tokens AS INTEGER) AS tokens FROM packed""",
    "build_prompts": f"""
        SELECT CAST(p.run AS BIGINT) AS run, CAST(batch AS INTEGER) AS batch,
               {_quoted(PROMPT_HEAD)} || string_agg(item || '. ' || cleaned || chr(10), '' ORDER BY item) AS prompt
        FROM packed p JOIN lines USING (ticket_id) GROUP BY p.run, batch""",
    "sum_tokens": f"""
        SELECT CAST(sum(tokens) AS BIGINT) AS line_tokens,
               CAST(count(*) FILTER (item = 1) * {len(PROMPT_HEAD) // 4} AS BIGINT) AS head_tokens,
               (SELECT CAST(sum(n) AS BIGINT) FROM (
                  SELECT ({len(PROMPT_HEAD)} + sum(chars + length(CAST(item AS VARCHAR)) + 3)) // 4 AS n
                  FROM packed JOIN lines USING (ticket_id) GROUP BY packed.run, batch)) AS tokens_used
        FROM packed""",
    "run_counts": """
        SELECT CASE WHEN usable THEN 'tickets classified' ELSE 'tickets defaulted' END AS outcome, count(*) AS n FROM answered GROUP BY ALL
        UNION ALL SELECT 'prompts answered', count(DISTINCT (run, batch)) FROM answered HAVING count(*) > 0""",
    "delegate_outputs": """
        SELECT 'quarantine' AS output, ticket_id AS id,
               md5('{"ticket_id":"' || ticket_id || '","user_id":"' || user_id || '","order_id":' || coalesce('"' || order_id || '"', 'null') || ',') AS content
        FROM received WHERE lang = 'de'
        UNION ALL SELECT 'complaints', ticket_id, md5(to_json([user_id, order_id, complaint_text, status, timestamp])::VARCHAR) FROM received
        UNION ALL SELECT 'store', ticket_id, md5(to_json([user_id, order_id, complaint_text, 'delegated', timestamp])::VARCHAR) FROM received
        UNION ALL SELECT 'classified', ticket_id, md5(to_json([user_id, team, severity::VARCHAR])::VARCHAR) FROM classified""",
    "parse_predictions": """
        SELECT CAST(run AS BIGINT) AS run, CAST(batch AS INTEGER) AS batch, CAST(item AS INTEGER) AS item, team, severity
        FROM answered WHERE usable""",
    "zip_predictions": """
        SELECT ticket_id, CASE WHEN usable THEN team END AS team, CASE WHEN usable THEN severity END AS severity FROM answered""",
    "default_predictions": """
        SELECT ticket_id, CASE WHEN usable THEN team ELSE 'Miscellaneous' END AS team,
               CASE WHEN usable THEN severity ELSE CAST(3 AS INTEGER) END AS severity FROM answered""",
    "classify_with_scorer": """
        SELECT ticket_id, user_id, CASE WHEN usable THEN team ELSE 'Miscellaneous' END AS team,
               CASE WHEN usable THEN severity ELSE CAST(3 AS INTEGER) END AS severity
        FROM answered JOIN complaints USING (ticket_id)""",
    "map_intent": "SELECT event_id, answer, intent_word FROM dialogs",
    "classify_intent": f"""
        SELECT conv_id, turn, word,
               CASE word WHEN 'check_status' THEN 'check' WHEN 'resolve_status' THEN 'resolve' WHEN 'new_complaint' THEN 'new' END
               AS intent_word
        FROM (SELECT conv_id, turn, {_INTENT_RULE} AS word
              FROM (SELECT conv_id, turn, regexp_split_to_array(lower(text), '[^a-z]+') AS words FROM conversations))""",
    "group_by_team": f"""
        SELECT team, page, CAST(count(*) AS BIGINT) AS n, string_agg(ticket_id, ',' ORDER BY k) AS ticket_ids
        FROM ({_paged('team', 50)}) GROUP BY team, page""",
    "group_by_user": f"""
        SELECT user_id, page, CAST(count(*) AS BIGINT) AS n, string_agg(ticket_id, ',' ORDER BY k) AS ticket_ids
        FROM ({_paged('user_id', 5)}) GROUP BY user_id, page""",
    "first_seen_keys": """
        SELECT team, row_number() OVER (ORDER BY first) AS position
        FROM (SELECT team, min(struct_pack(ts := raised_ts, id := ticket_id)) AS first FROM classified GROUP BY team)""",
    "first_seen_users": """
        SELECT user_id, row_number() OVER (ORDER BY first) AS position
        FROM (SELECT user_id, min(struct_pack(ts := raised_ts, id := ticket_id)) AS first FROM classified GROUP BY user_id)""",
    "team_digest": f"""
        SELECT team, page, CAST(count(*) AS INTEGER) AS n, {_TEAM_BODY} AS body
        FROM ({_paged('team', 50)}) GROUP BY team, page""",
    "user_digest": f"""
        SELECT user_id, page, CAST(count(*) AS INTEGER) AS n, {_USER_BODY} AS body
        FROM ({_paged('user_id', 5)}) GROUP BY user_id, page""",
    "outbox_digests": f"""
        SELECT replace(lower(team), ' ', '-') || '@teams.invalid' AS recipient,
               'Complaints assigned to your team' AS subject, page, md5({_TEAM_BODY}) AS body
        FROM ({_paged('team', 50)}) GROUP BY team, page
        UNION ALL
        SELECT user_id, 'We have received your complaints', page, md5({_USER_BODY})
        FROM ({_paged('user_id', 50)}) GROUP BY user_id, page""",
    "submit_complaints": """
        SELECT substr(sha256(concat_ws('|', user_id, coalesce(order_id, ''), text, stamp)), 1, 32) AS ticket_id,
               user_id, order_id, text AS complaint_text, 'new' AS status, stamp AS timestamp
        FROM (SELECT 'user' || conv_id || '@example.com' AS user_id, text,
                     CASE WHEN turn <> 0 THEN CAST(conv_id AS VARCHAR) END AS order_id,
                     strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 600 + turn), '%Y-%m-%d %H:%M:%S') AS stamp
              FROM conversations WHERE role = 'user')""",
    "route_intents": """
        SELECT event_id, CASE event_type WHEN 'view' THEN 'check_status' WHEN 'purchase' THEN 'resolve_ticket'
               WHEN 'signup' THEN 'submit_complaint' WHEN 'click' THEN 'choose_branch' ELSE 'fallback' END AS handler
        FROM events""",
    "extract_slot": """
        SELECT event_id, 'user' || user_id || '@example.com' AS user_id, ticket_id, CAST(NULL AS VARCHAR) AS order_id
        FROM dialogs""",
    "set_slot": "SELECT event_id, intent_word, ticket_id, CAST(2 AS INTEGER) AS n_slots FROM dialogs",
    "dialog_actions": """
        SELECT event_id,
               CASE WHEN broken THEN 'Close' WHEN missing THEN 'ElicitSlot' WHEN NOT branch THEN 'Close'
                    WHEN intent_word IS NULL THEN 'ElicitIntent' ELSE 'Delegate' END AS type,
               CASE WHEN missing AND NOT broken THEN 'ticket_id' END AS slot_to_elicit,
               intent,
               CASE WHEN broken THEN 'Failed' WHEN missing THEN NULL WHEN NOT branch THEN 'Fulfilled'
                    WHEN intent_word IS NOT NULL THEN 'InProgress' END AS state,
               CASE WHEN (missing AND NOT broken) OR branch THEN ticket_id END AS ticket_id,
               CASE WHEN branch AND intent_word IS NOT NULL THEN ticket_id END AS offered_ticket_id,
               CASE WHEN branch AND intent_word IS NOT NULL THEN 'en' END AS lang,
               CASE WHEN broken THEN 'Your request could not be carried out. Please try again later.'
                    WHEN missing THEN 'There is no such ticket. Please enter the id again.'
                    WHEN intent = 'CheckComplaintStatus' THEN 'Ticket ' || ticket_id || ' has this status: ' || status_text || '.'
                    WHEN intent = 'ResolveComplaint' THEN 'Ticket ' || ticket_id || ' is now resolved.'
                    WHEN intent = 'SubmitComplaint' THEN 'Your complaint has been recorded as ticket c' || event_id || '.'
                    WHEN intent = 'OtherIntent' THEN 'I did not get that. Could you say it another way?'
                    WHEN intent_word IS NULL THEN 'Going on with WelcomeIntent.'
                    ELSE 'Going on with the choice ' || intent_word || '.' END AS content
        FROM (SELECT d.*, intent = 'WelcomeIntent' AS branch, intent = 'ResolveComplaint' AND s.ticket_id IS NULL AS missing,
                     intent IN ('CheckComplaintStatus', 'ResolveComplaint', 'SubmitComplaint') AND d.user_id % 10 = 7 AS broken,
                     CASE WHEN s.ticket_id IS NULL THEN 'Ticket not found' ELSE coalesce(s.status, 'No status available') END AS status_text
              FROM dialogs d LEFT JOIN store s ON s.ticket_id = lower(d.ticket_id))""",
    "derive_reply": """
        SELECT conv_id, turn,
               CASE WHEN turn % 2 = 0 AND role = 'user' THEN text
                    WHEN turn % 2 = 0 AND role = 'assistant' THEN 'Please enter a value for ticket_id.'
                    WHEN role = 'user' THEN 'card' WHEN role = 'assistant' THEN text ELSE '' END AS reply
        FROM conversations""",
    "flatten_messages": f"""
        SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, kind,
               CASE kind WHEN 'text' THEN text WHEN 'product' THEN 'For you' WHEN 'other' THEN 'unsupported message'
                    ELSE 'The answer did not arrive. Please send your message once more.' END AS text,
               CASE WHEN kind = 'product' THEN '<figure><img src="/p.png"/><figcaption>' || {_escaped('text')}
                    || ' ($' || turn || ')</figcaption><button data-action="buy">Buy</button></figure>' END AS card
        FROM (SELECT *, 0 AS pos, CASE WHEN role = 'system' THEN 'error' ELSE 'text' END AS kind FROM conversations
              UNION ALL SELECT *, 1, 'product' FROM conversations WHERE role = 'assistant'
              UNION ALL SELECT *, 2, 'other' FROM conversations WHERE role = 'assistant')""",
    "minute_markers": """
        SELECT key, event_id, label
        FROM (SELECT user_id AS key, event_id, hour(ts) || ':' || minute(ts) AS label, minute(ts) AS m,
                     lag(minute(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS shown FROM events)
        WHERE shown IS NULL OR shown <> m""",
    "session_key": """
        SELECT doc_id, lang || '-at-' || source || '-at-example.com' AS key, lang || '@' || source || '@example.com' AS address
        FROM documents""",
    "session_key_first": "SELECT doc_id, lang || '-at-' || source || '@example.com' AS key FROM documents",
    "mint_session_id": """
        SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || '-' || substr(sha256(user_id || '|' || event_id), 1, 10)
               AS session_id FROM events""",
    "format_raised_ts": """
        SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS raised, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds
        FROM events""",
    "delegate_batch": f"SELECT {_TICKET} FROM born",
    "delegate_stream": f"SELECT {_TICKET}, 'delegated' AS store_status, CAST(1 AS BIGINT) AS store_rows FROM born",
    "progress_open": f"""
        SELECT {_TICKET}
        FROM (SELECT t.* REPLACE (CASE WHEN p.status IS NULL THEN t.status WHEN p.status = 'delegated' THEN 'pending'
                                       ELSE 'resolved' END AS status,
                                  CASE WHEN p.status IN ('new', 'pending') THEN {_DONE} ELSE t.resolved_ts END AS resolved_ts)
              FROM tickets t LEFT JOIN opened p USING (ticket_id))""",
    "progress_store": """
        SELECT s.ticket_id, user_id, order_id, timestamp,
               CASE WHEN p.status IS NULL THEN s.status WHEN p.status = 'delegated' THEN 'pending' ELSE 'resolved' END AS status
        FROM store s LEFT JOIN opened p ON p.ticket_id = s.ticket_id""",
}

_SQL["lifecycle_stream"] = _SQL["lifecycle_stream_table"] = _SQL["lifecycle_state"]
_SQL["submit_stream"] = _SQL["submit_complaints"]
_SQL["delegate_outbox"] = _SQL["outbox_digests"]
_SQL["dedupe_stream"] = _SQL["dedupe_tickets"]
_SQL["dedupe_late"] = """
    SELECT ticket_id, CASE WHEN lang = 'fr' AND raised_ts <= (SELECT max(raised_ts) FROM received WHERE lang IS DISTINCT FROM 'fr') - INTERVAL 1 HOUR
        THEN 'late' ELSE 'complaints' END AS outcome FROM received"""
_SQL["submit_blank"] = """
    SELECT CASE WHEN turn = 0 THEN 'blank' ELSE 'complaints' END AS output, 'user' || conv_id || '@example.com' AS user_id,
           CASE WHEN turn <> 0 THEN CAST(conv_id AS VARCHAR) END AS order_id,
           strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 600 + turn), '%Y-%m-%d %H:%M:%S') AS timestamp
    FROM conversations WHERE role = 'user'"""

_SQL["daily_volume"] = "SELECT CAST(ts AS DATE) AS day, event_type AS kind, count(*) AS n FROM events GROUP BY ALL"

_SQL["bucket_upsert"] = """
    SELECT ticket_id, user_id, CASE WHEN user_id LIKE 'user%0@%' THEN 'moved' ELSE order_id END AS order_id, md5(complaint_text) AS text_md5,
           CASE WHEN status = 'new' THEN 'delegated' ELSE status END AS status, timestamp FROM store"""
_SQL["bucket_status_updates"] = """
    SELECT ticket_id, user_id, order_id, md5(complaint_text) AS text_md5,
           CASE WHEN ticket_id IN (SELECT lower(ticket_id) FROM requests WHERE event_type = 'purchase') THEN 'resolved' ELSE status END AS status,
           timestamp FROM store"""
_SQL["answer_ledger"] = f"""
    SELECT CAST(1 AS INTEGER) AS round, count(DISTINCT (run, batch)) AS asked, CAST(any_value(used) AS BIGINT) AS tokens_used,
           count(*) FILTER (usable) AS classified
    FROM answered, (SELECT sum(n) AS used FROM (
        SELECT ({len(PROMPT_HEAD)} + sum(chars + length(CAST(item AS VARCHAR)) + 3)) // 4 AS n
        FROM packed JOIN lines USING (ticket_id) GROUP BY packed.run, batch))
    UNION ALL SELECT CAST(2 AS INTEGER), 0, 0, count(*) FILTER (usable) FROM answered"""
_SQL["delegate_nothing"] = """
    SELECT unnest(['quarantine', 'complaints', 'classified', 'tickets', 'outbox', 'store']) AS output, unnest([count(*), 0, 0, 0, 0, 0]) AS n FROM documents"""
_TABLE_WORDS = "CASE lower(w) WHEN 'it' THEN 'that thing' WHEN 'les' THEN 'toutes les' WHEN 'und' THEN 'und auch' ELSE w END"
_BUT_IT = ", ".join(f"'{word}'" for word in STOP_WORDS if word != "it")
_SQL["preprocess_table"] = f"""
    SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split({_expand('kept')}, ' '), lambda w: {_TABLE_WORDS}), ' '), '{_KEPT}', '', 'g') AS text
    FROM (SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda w: lower(w) NOT IN ({_BUT_IT})), ' ') AS kept FROM documents)"""
_SECONDS = "epoch(resolved_ts)::BIGINT - epoch(raised_ts)::BIGINT"
_SQL["open_backlog"] = """
    SELECT team_name, strftime(d, '%Y-%m-%d') AS day, opened, closed,
           CAST(sum(opened - closed) OVER (PARTITION BY team_name ORDER BY d) AS BIGINT) AS open
    FROM (
        SELECT s.team_name, s.d, CAST(count(*) FILTER (m.step = 'opened') AS BIGINT) AS opened, CAST(count(*) FILTER (m.step = 'closed') AS BIGINT) AS closed
        FROM (SELECT team_name, CAST(unnest(generate_series(min(CAST(raised_ts AS DATE))::TIMESTAMP,
                  (SELECT greatest(max(CAST(raised_ts AS DATE)), max(CAST(resolved_ts AS DATE)))::TIMESTAMP FROM tickets), INTERVAL 1 DAY)) AS DATE) AS d
              FROM tickets GROUP BY team_name) s
        LEFT JOIN (SELECT team_name, CAST(raised_ts AS DATE) AS d, 'opened' AS step FROM tickets
                   UNION ALL SELECT team_name, CAST(resolved_ts AS DATE), 'closed' FROM tickets WHERE resolved_ts IS NOT NULL) m
        ON m.team_name = s.team_name AND m.d = s.d
        GROUP BY s.team_name, s.d)"""
_SQL["resolve_times"] = f"""
    SELECT team_name, count(*) AS n, sum({_SECONDS}) / count(*) AS mean_s,
           round(quantile_cont({_SECONDS}, 0.5), 3) AS p50_s, round(quantile_cont({_SECONDS}, 0.95), 3) AS p95_s
    FROM tickets WHERE resolved_ts IS NOT NULL GROUP BY team_name"""
_SQL["resolve_time_sketch"] = f"""
    SELECT team_name, count(*) AS n, sum({_SECONDS}) / count(*) AS mean_s, true AS p50_s_within, true AS p95_s_within
    FROM tickets WHERE resolved_ts IS NOT NULL GROUP BY team_name"""
_SQL["store_drift"] = """
    SELECT ticket_id, CASE WHEN r.raised_ts IS NULL THEN 'left only' WHEN l.raised_ts IS NULL THEN 'right only' ELSE 'both' END AS found,
           CASE WHEN r.raised_ts IS NULL OR l.raised_ts IS NULL THEN ''
                ELSE concat_ws(',', CASE WHEN l.status IS DISTINCT FROM r.status THEN 'status' END,
                                    CASE WHEN l.raised_ts IS DISTINCT FROM r.raised_ts THEN 'raised_ts' END) END AS differing
    FROM (SELECT s.ticket_id, CASE WHEN q.key IS NULL THEN s.status ELSE 'resolved' END AS status,
                 CASE WHEN s.lang = 'es' THEN s.raised_ts + INTERVAL 1 SECOND ELSE s.raised_ts END AS raised_ts
          FROM store s LEFT JOIN (SELECT DISTINCT lower(ticket_id) AS key FROM requests WHERE event_type = 'purchase') q ON q.key = s.ticket_id
          WHERE s.status IS NOT NULL) l
    FULL JOIN (SELECT ticket_id, status, raised_ts FROM tickets WHERE status IS NULL OR status <> 'new') r USING (ticket_id)
    WHERE l.status IS DISTINCT FROM r.status OR l.raised_ts IS DISTINCT FROM r.raised_ts"""
_SQL["status_funnel"] = """
    SELECT step_no, step, reached, mean_s FROM (
        SELECT 1 AS step_no, 'submit' AS step, count(*) AS reached, CAST(NULL AS DOUBLE) AS mean_s FROM f1
        UNION ALL SELECT 2, 'delegate', count(*), round(sum(epoch_us(t) - epoch_us(b)) / count(*) / 1e6, 3) FROM f2
        UNION ALL SELECT 3, 'advance', count(*), round(sum(epoch_us(t) - epoch_us(b)) / count(*) / 1e6, 3) FROM f3
        UNION ALL SELECT 4, 'resolve', count(*), round(sum(epoch_us(t) - epoch_us(b)) / count(*) / 1e6, 3) FROM f4)"""
_SQL["team_severity"] = """
    SELECT team AS team_name, severity_level, CAST(grouping_id(team, severity_level) AS INTEGER) AS level, count(*) AS tickets,
           count(*) FILTER (status <> 'resolved') AS open, count(*) FILTER (status = 'resolved') AS resolved
    FROM (SELECT *, CASE WHEN status IS NOT NULL THEN team_name END AS team FROM tickets) GROUP BY ROLLUP (team, severity_level)"""
_SQL["oldest_open"] = """
    SELECT team_name, ticket_id, strftime(raised_ts, '%Y-%m-%d %H:%M:%S') AS raised_ts, place
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY team_name ORDER BY raised_ts, ticket_id) AS INTEGER) AS place
          FROM tickets WHERE status <> 'resolved') WHERE place <= 3"""

ORACLES = {name: _query(sql) for name, sql in _SQL.items()}
