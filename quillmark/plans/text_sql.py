"""Checking SQL of the text segmentation: folds over lines and units as recursive queries.

Each builder takes the name of a relation and gives the text of one or more common table expressions.
"""

from __future__ import annotations

from quillmark.config import MAX_CHARS, OVERLAP_CHARS, TARGET_CHARS

WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def is_blank(x: str) -> str:
    return f"regexp_matches({x}, '^{WS}*$')"


def _lines(x: str) -> str:
    """The lines of a text: one carriage return before a line feed belongs to the line's end; no empty last line."""
    parts = f"string_split({x}, chr(10))"
    ended = f"list_transform({parts}[:-2], lambda l: regexp_replace(l, '\\r\\z', ''))"
    return f"list_concat({ended}, list_filter({parts}[-1:], lambda l: l <> ''))"


def slices(x: str) -> str:
    return f"list_transform(range(0, (length({x}) + {MAX_CHARS - 1}) // {MAX_CHARS}), lambda s: substr({x}, s::int * {MAX_CHARS} + 1, {MAX_CHARS}))"


def note_lines(notes: str) -> str:
    """notes (source_id, version, raw_text): note_lines_ (.., i, line), note_start_ (.., start: first line of the body)."""
    return f"""note_lines_ as (select source_id, version, unnest(l) line, generate_subscripts(l, 1) i from (select source_id, version, {_lines('raw_text')} l from {notes})),
  note_marks_ as (select source_id, version, i from note_lines_ where regexp_replace(line, '{WS}+$', '') = '---'),
  note_start_ as (select n.source_id, n.version, coalesce(min(m.i) filter (m.i > 1 and o.i is not null) + 1, 1) start
    from {notes} n left join note_marks_ m using (source_id, version) left join note_marks_ o on o.source_id = n.source_id and o.version = n.version and o.i = 1 group by 1, 2)"""


def sections(notes: str) -> str:
    """sections_ (source_id, version, ix, heading_path, body); needs note_lines."""
    return f"""body_lines_ as (select l.*, regexp_matches(line, '^{WS}*(```|~~~)')::int fence from note_lines_ l join note_start_ using (source_id, version) where i >= start),
  fenced_ as (select *, sum(fence) over (partition by source_id, version order by i) - fence before from body_lines_),
  headed_ as (select *, (fence = 0 and before % 2 = 0 and regexp_matches(line, '^{WS}*#{{1,6}} '))::int heading from fenced_),
  numbered_ as (select *, sum(heading) over (partition by source_id, version order by i) sec from headed_),
  heads_ as (select source_id, version, sec, length(regexp_extract(line, '^{WS}*(#{{1,6}}) ', 1)) level, {trim(f"regexp_extract(line, '(?s)^{WS}*#{{1,6}} (.*)$', 1)")} title from numbered_ where heading = 1),
  paths_ as (select source_id, version, 0::hugeint sec, []::varchar[] path from {notes}
    union all select p.source_id, p.version, h.sec, list_append(p.path[1:h.level - 1], h.title) from paths_ p join heads_ h on h.source_id = p.source_id and h.version = p.version and h.sec = p.sec + 1),
  bodies_ as (select source_id, version, sec, {trim("string_agg(line, chr(10) order by i)")} body from numbered_ where heading = 0 group by 1, 2, 3),
  sections_ as (select source_id, version, (row_number() over (partition by source_id, version order by sec) - 1)::int ix, array_to_string(path, ' > ') heading_path, body
    from bodies_ join paths_ using (source_id, version, sec) where body <> '')"""


def pieces(bodies: str) -> str:
    """bodies (k, body): units_ (k, j, unit), from 1, and pieces_ (k, no, piece), from 0: folds over lines of long
    paragraphs and over units."""
    return f"""paragraphs_ as (select k, unnest(p) t, generate_subscripts(p, 1) q from (select k, string_split(body, chr(10) || chr(10)) p from {bodies})),
  long_ as (select k, q, unnest(l) line, generate_subscripts(l, 1) i, len(l) n from (select k, q, {_lines('t')} l from paragraphs_ where length(t) > {MAX_CHARS})),
  packing_ as (select distinct k, q, 0::bigint i, '' packed, []::varchar[] done from long_
    union all select p.k, p.q, l.i,
      case when length(line) > {MAX_CHARS} then '' when packed <> '' and length(packed) + length(line) + 1 <= {TARGET_CHARS} then packed || chr(10) || line else line end,
      case when length(line) > {MAX_CHARS} then list_concat(case when {is_blank('packed')} then [] else [packed] end, {slices('line')})
        when length(packed) + length(line) + 1 > {TARGET_CHARS} then [packed] else [] end
    from packing_ p join long_ l on l.k = p.k and l.q = p.q and l.i = p.i + 1),
  packed_ as (select k, q, i, unnest(done) unit, generate_subscripts(done, 1) s from packing_
    union all select p.k, p.q, p.i + 1, packed, 1 from packing_ p join (select k, q, max(n) n from long_ group by 1, 2) m on m.k = p.k and m.q = p.q and m.n = p.i where not {is_blank('packed')}),
  units_ as (select k, row_number() over (partition by k order by q, i, s) j, unit from (
    select k, q, 0 i, 0 s, t unit from paragraphs_ where length(t) <= {MAX_CHARS} union all select k, q, i, s, unit from packed_)),
  joining_ as (select distinct k, 0::bigint j, '' held, null::varchar done from units_
    union all select g.k, u.j, case when held = '' then unit when length(held) + length(unit) > {TARGET_CHARS} then right(held, {OVERLAP_CHARS}) || chr(10) || chr(10) || unit else held || chr(10) || chr(10) || unit end,
      case when held <> '' and length(held) + length(unit) > {TARGET_CHARS} then held end
    from joining_ g join units_ u on u.k = g.k and u.j = g.j + 1),
  joined_ as (select k, j, done piece from joining_ where done is not null
    union all select g.k, g.j + 1, held from joining_ g join (select k, max(j) j from units_ group by 1) m on m.k = g.k and m.j = g.j where not {is_blank('held')}),
  pieces_ as (select k, (row_number() over (partition by k order by j, s) - 1)::int no, piece from (
    select k, j, unnest(c) piece, generate_subscripts(c, 1) s from (select k, j, case when length(piece) > {MAX_CHARS} then {slices('piece')} else [piece] end c from joined_)))"""


_NOTES = "notes_ as (select distinct source_id, md5(raw_text) version, raw_text from notes where raw_text is not null)"


def with_sections(notes: str = _NOTES) -> str:
    return f"with recursive {notes}, {note_lines('notes_')}, {sections('notes_')}"


def chunks_of(notes: str) -> str:
    """chunked_ (source_id, version, chunk_ix, heading_path, text) of notes_ (source_id, version, title, raw_text)."""
    return f"""{with_sections(notes)},
  cut_ as (select (source_id, version, ix) k, body from sections_), {pieces('cut_')},
  chunked_ as (select s.source_id, s.version, (row_number() over (partition by s.source_id, s.version order by ix, no) - 1)::int chunk_ix, heading_path,
      title || case when heading_path <> '' then ' > ' || heading_path else '' end || chr(10) || chr(10) || piece as "text"
    from pieces_ p join sections_ s on p.k = (s.source_id, s.version, s.ix) join notes_ n on n.source_id = s.source_id and n.version = s.version where not {is_blank('piece')})"""


FRONTMATTER = f"""with {_NOTES}, {note_lines('notes_')},
  front_ as (select l.source_id, l.version, i, {trim('line')} t from note_lines_ l join note_start_ using (source_id, version) where i > 1 and i < start - 1),
  split_ as (select *, starts_with(t, '- ') item, strpos(t, ':') c from front_),
  keyed_ as (select *, case when not item and c > 0 then {trim("left(t, c::int - 1)")} end name, case when not item and c > 0 then trim(trim({trim("substr(t, c::int + 1)")}, '"'), '''') end v from split_),
  current_ as (select *, last_value(name ignore nulls) over (partition by source_id, version order by i) key from keyed_),
  lists_ as (select source_id, version, max(i) at_, arg_max(v, i) v from keyed_ where name = 'tags' and regexp_matches(v, '(?s)^\\[.*\\]$') group by 1, 2),
  items_ as (select c.source_id, c.version, list(trim({trim("substr(t, 3)")}, '"') order by i) items from current_ c left join lists_ l using (source_id, version)
    where item and key = 'tags' and i > coalesce(at_, 0) group by 1, 2),
  fields_ as (select source_id, version, arg_max(v, i) filter (name = 'type') note_type, arg_max(v, i) filter (name = 'captured') captured from keyed_ group by 1, 2)
  select n.source_id, coalesce(note_type, '') note_type, coalesce(captured, '') captured, coalesce(array_to_string(list_concat(
    coalesce(list_filter(list_transform(string_split(substr(l.v, 2, length(l.v) - 2), ','), lambda x: trim({trim('x')}, '"')), lambda x: x <> ''), []), coalesce(items, [])), ','), '') tags
  from notes_ n left join fields_ using (source_id, version) left join lists_ l using (source_id, version) left join items_ using (source_id, version)"""
