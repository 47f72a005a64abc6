"""DuckDB twins of the queries on conversations."""

from __future__ import annotations

from .chat_format import Template
from .turn_repair import _BETWEEN, _AT_END, ASSISTANT, DELETE, INSERT, REROLE, START, SYSTEM, TRUNCATED, USER

_SAID = "</s>[INST] ok [/INST]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chat_format() -> str:
    template = Template()
    pattern = "|".join(["\\\\", *("".join("\\" + c if not c.isalnum() else c for c in m) for m in template.controls)])
    escapes = lambda c: f"length({c}) + len(regexp_extract_all({c}, {_quoted(pattern)}))"
    marks = " ".join(f"WHEN {_quoted(r)} THEN {len(a) + len(b)}" for r, (a, b) in template.marks.items())
    learned = ", ".join(map(_quoted, template.learned))
    return f"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', {_quoted(_SAID)} UNION ALL SELECT -7, 1, 'assistant', {_quoted(_SAID)}
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
            CAST(sum(CASE WHEN role IN ({learned}) THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (WHERE role IN ({learned})), '')) AS loss_sha256,
            CAST(sum({escapes("text")} + CASE role {marks} ELSE {sum(map(len, template.other))} + {escapes("role")} END) AS BIGINT) AS formatted_chars
        FROM rows GROUP BY conv_id
    """


_CRC = """crc_steps(i, k, v) AS (
            SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
            UNION ALL SELECT i, k + 1, xor(v >> 1, 3988292384 * (v & 1)) FROM crc_steps WHERE k < 8
        ), crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_steps WHERE k = 8)"""
_CRC_OF = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({key}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _state(last: int) -> str:
    """The best repair whose last retained role is ``last``, one row further."""
    at = lambda q: f"st[{q + 1}]"
    options = [f"{{'c': {at(last)}.c + {DELETE}, 'a': {at(last)}.a || 'D', 'x': {at(last)}.x}}"]
    initial = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}
    for (before, after), inserted in _BETWEEN.items():
        if after != last:
            continue
        # an insert stands opposite the role that follows it
        extra = f" || chr(10) || '{'user' if after == ASSISTANT else 'assistant'}:'" * inserted
        for letter, price, allowed, role in (("K", 0, f"initial = '{initial[after]}'", "role"), ("R", REROLE, "true", f"'{'user' if after == USER else 'assistant'}'")):
            if letter == "R" and after == SYSTEM:
                continue
            cost = f"CASE WHEN gone OR NOT ({allowed}) THEN 1000000000 ELSE {at(before)}.c + {price + INSERT * inserted} + {TRUNCATED} * CAST(cut AS INT) END"
            options.append(f"{{'c': {cost}, 'a': {at(before)}.a || '{'I' * inserted}{letter}', 'x': {at(before)}.x{extra} || chr(10) || {role} || ':' || text}}")
    return f"list_sort([{', '.join(options)}])[1]"


def turn_repair() -> str:
    none = "{'c': 1000000000, 'a': '', 'x': ''}"
    ends = {START: "", SYSTEM: " || chr(10) || 'user:' || chr(10) || 'assistant:'", USER: " || chr(10) || 'assistant:'", ASSISTANT: ""}
    last = ", ".join(f"{{'c': st[{q + 1}].c + {INSERT * n}, 'a': st[{q + 1}].a || '{'I' * n}', 'x': st[{q + 1}].x{ends[q]}}}" for q, n in _AT_END.items())
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return f"""
        WITH RECURSIVE {_CRC},
        coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC_OF.format(key=key)} % 20 AS fault FROM conversations, crc_table),
        rows AS (
            SELECT conv_id, turn, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM coded
        ), placed AS (
            SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy) AS k,
                lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy) AS previous,
                NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
                NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS open
            FROM rows
        ), facts AS (SELECT *, blank OR seen AS gone, NOT blank AND seen AS duplicate, NOT blank AND NOT seen AND open AS cut FROM placed),
        sums AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
                count(*) FILTER (cut) AS truncated, count(*) FILTER (k > 1 AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM facts GROUP BY conv_id
        ), walk(conv_id, k, st) AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT), [{{'c': 0, 'a': '', 'x': ''}}, {none}, {none}, {none}] FROM sums
            UNION ALL SELECT f.conv_id, f.k, [{", ".join(map(_state, (START, SYSTEM, USER, ASSISTANT)))}]
            FROM walk w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k = w.k + 1
        ), best AS (
            SELECT w.conv_id, gaps, blank, duplicate, truncated, illegal, list_sort([{last}])[1] AS b FROM walk w JOIN sums s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.k = s.n
        )
        SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
            coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.x, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
    """
