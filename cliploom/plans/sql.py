"""Pieces of the oracle SQL: the canonical tables over the driver's views, and text measures."""

from __future__ import annotations

from cliploom.operators import features as f

SEGMENTS = r"""
toks as (
    select conv_id as episode_id, turn as seg_idx, role as speaker, coalesce(text, '') as text,
        list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r]+'), lambda w: w <> '') as ws
    from conversations
), numbered as (
    select *, len(ws)::bigint as n_words, coalesce(sum(len(ws)) over (partition by episode_id order by seg_idx rows between unbounded preceding and 1 preceding), 0)::bigint as first_word
    from toks where len(ws) > 0
), segments as (
    select *, first_word * 300 + (first_word // 7) * 550 as start_ms, (first_word + n_words - 1) * 300 + ((first_word + n_words - 1) // 7) * 550 + 250 as end_ms from numbered
)"""

WORDS = SEGMENTS + r""", listed as (
    select episode_id, seg_idx, first_word, unnest(ws) as w, unnest(range(len(ws))) as pos from segments
), words as (
    select episode_id, seg_idx, (first_word + pos)::bigint as word_idx, w,
        ((first_word + pos) * 300 + ((first_word + pos) // 7) * 550)::bigint as start_ms, ((first_word + pos) * 300 + ((first_word + pos) // 7) * 550 + 250)::bigint as end_ms
    from listed
)"""


def count(text: str, char: str) -> str:
    return f"(length({text}) - length(replace({text}, '{char}', '')))"


def matches(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{quoted(pattern)}'))"


def quoted(text: str) -> str:
    return text.replace("'", "''")


def any_of(text: str, phrases) -> str:
    return "(" + " or ".join(f"contains({text}, '{quoted(p)}')" for p in phrases) + ")"


def hits(text: str, phrases) -> str:
    return "(" + " + ".join(f"contains({text}, '{quoted(p)}')::int" for p in phrases) + ")"


def tokens(text: str) -> str:
    return rf"list_filter(string_split_regex({text}, '\s+'), lambda w: w <> '')"


def prerank(text: str, seconds: str, n: str) -> str:
    start = "|".join(f"(?:{p})" for p in f.HOOK_STARTS)
    per = f"(case when {seconds} > 0 then {n} / ({seconds})::double else 0.0 end)"
    info = f"(case when {per} > 0 then greatest(0.0, 1 - abs({per} - 3.5) / 3.5) else 0.0 end)"
    fit = f"(case when {seconds} < 8 then {seconds} / 8.0 when {seconds} > 90 then greatest(0.0, 1 - ({seconds} - 90) / 90.0) else 1.0 end)"
    arousal = f"least(1.0, least(1.0, {count(text, '!')} * 0.2) + least(1.0, {count(text, '?')} * 0.15) + least(1.0, {matches(text, 'wow')} * 0.3) + least(1.0, {matches(text, 'crazy')} * 0.3) + least(1.0, {matches(text, 'amazing')} * 0.3) + (contains({text}, '?') and length({text}) < 160)::int * 0.2)"
    return f"(0.35 * regexp_matches(trim(lower({text})), '{quoted(start)}')::int + 0.25 * {arousal} + 0.20 * {info} + 0.15 * {fit} + 0.05 * regexp_matches({text}, '[0-9]')::int)"


CLIPS = SEGMENTS + rf""", spans as (
    select episode_id, seg_idx, start_ms, n_words, lead(n_words, 1) over s as n1, lead(n_words, 2) over s as n2, end_ms as e0, lead(end_ms, 1) over s as e1, lead(end_ms, 2) over s as e2,
        text as t0, lead(text, 1) over s as t1, lead(text, 2) over s as t2
    from segments window s as (partition by episode_id order by seg_idx)
), cut as (
    select episode_id, start_ms, e0 as end_ms, t0 as text from spans
    union all select episode_id, start_ms, e1, t0 || ' ' || t1 from spans where e1 is not null
    union all select episode_id, start_ms, e2, t0 || ' ' || t1 || ' ' || t2 from spans where e2 is not null
), clips as (
    select episode_id, substr(sha1(episode_id || ':' || start_ms || ':' || end_ms), 1, 16) as clip_id, start_ms::bigint as start_ms, end_ms::bigint as end_ms, text,
        len({tokens('text')})::bigint as n_words, round({prerank('text', '((end_ms - start_ms) / 1000.0)', f"len({tokens('text')})")}::double, 6) as final_score,
        regexp_matches(text, '[.!?]\s*$') as finished
    from cut
)"""


def greedy(order: str, conflict: str, fields: str, limit: int | None = None) -> str:
    """Rows kept by an ordered greedy rule: `conflict` compares k.<field> of a kept row with o.<field>."""
    room = f"len(r.kept) >= {limit} or " if limit else ""
    packed = ", ".join(f"'{n}': o.{n}" for n in fields.split(", "))
    kind = ", ".join(f"{n} {'varchar' if n == 'clip_id' else 'varchar[]' if n in ('ws', 'opening') else 'double' if n in ('final_score', 'hot') else 'bigint'}" for n in fields.split(", "))
    return f"""ordered as (select *, row_number() over (partition by episode_id order by {order}) as rn from pool),
folded as (
    select distinct episode_id, 0::bigint as rn, []::struct({kind})[] as kept from ordered
    union all
    select r.episode_id, o.rn, case when {room}len(list_filter(r.kept, lambda k: {conflict})) > 0 then r.kept else list_append(r.kept, {{{packed}}}) end
    from folded r join ordered o on o.episode_id = r.episode_id and o.rn = r.rn + 1
), best as (select episode_id, arg_max(kept, rn) as kept from folded group by episode_id),
picked as (select episode_id, unnest(kept) as k, unnest(range(1, len(kept) + 1)) as pick from best)"""


def iou(k: str = "k", o: str = "o") -> str:
    common = f"greatest(0, least({k}.end_ms, {o}.end_ms) - greatest({k}.start_ms, {o}.start_ms))"
    return f"({common}::double / nullif(({k}.end_ms - {k}.start_ms) + ({o}.end_ms - {o}.start_ms) - {common}, 0))"
