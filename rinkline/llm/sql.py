"""SQL with the same results, where SQL can express them."""

from rinkline.llm.textstats import COMMON

_PARTS = r"array_to_string(list_sort(list_filter(string_split_regex(lower(upper({c})), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')), ' ')"
_CODE = r"lower(translate({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8201) || '.,;:-_/*''\"()', ''))"
_NUMBERS = r"coalesce(nullif(array_to_string(regexp_extract_all({c}, '\d+'), '-'), ''), " + _PARTS + ")"
_YMD, _DMY = r"'^\D*((?:19|20)\d{{2}})\D*?(\d{{1,2}})\D*?(\d{{1,2}})\D*$'", r"'^\D*?(\d{{1,2}})\D*?(\d{{1,2}})\D*?((?:19|20)\d{{2}})\D*$'"


def _date(rx: str, y: int, d: int) -> str:
    return f"try_cast(regexp_extract({{c}}, {rx}, {y}) || '-' || lpad(regexp_extract({{c}}, {rx}, 2), 2, '0') || '-' || lpad(regexp_extract({{c}}, {rx}, {d}), 2, '0') as date)"


_DAY = f"coalesce(cast({_date(_YMD, 1, 3)} as varchar), cast({_date(_DMY, 3, 1)} as varchar), {_PARTS})"


def _keys(spec: dict[str, str]) -> str:
    return ", ".join(t.format(c=c) for c, t in spec.items())


_PLAYER = _keys({**{c: "{c}" for c in ("season_group_id", "scraped_at", "jersey_number", "games_played", "goals", "assists", "points", "plus_minus", "pim")}, "team_id": _CODE, "team_code": _CODE, "position": _CODE, "player_name": _PARTS})
_GAME = _keys({"season_group_id": "{c}", "spectators": "{c}", "team_id": _CODE, "match_date": _DAY, "home_team": _PARTS, "away_team": _PARTS, "result": _NUMBERS, "status": _NUMBERS, "period_results": _NUMBERS})


def _copies(source: str, keys: str) -> str:
    return f"select '{source}' table_name, first_row_id, row_id copy_row_id from (select row_id, min(row_id) over (partition by {keys}) first_row_id from {source}) where row_id <> first_row_id"


def _collapsed(source: str, keys: str) -> str:
    return f"select '{source}' table_name, min(row_id) row_id, count(*) n_copies from {source} group by {keys}"


_NEAR = r"""
with items as (select item_id, list_distinct(regexp_extract_all(lower(concat_ws(' ', title, body)), '[\p{L}\p{N}]+')) w from tmp_latest_silly where body is not null),
words as (select item_id, len(w) n, unnest(w) x from items),
met as (select a.item_id item_a, b.item_id item_b, any_value(a.n) n, any_value(b.n) m, count(*) k from words a join words b on a.x = b.x and a.item_id < b.item_id and least(a.n, b.n) >= 0.6 * greatest(a.n, b.n) group by 1, 2)
select item_a, item_b from met where k >= 0.6 * (n + m - k) - 1e-9"""

_CLASSES = """
with recursive sets as (select item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', title, body)), '[\\p{L}\\p{N}]+'))), ' ') s from tmp_latest_silly where body is not null),
pairs as (""" + _NEAR + """),
keyed as (select item_id, s, min(item_id) over (partition by s) k from sets where s <> ''),
links as (select distinct a.k a, b.k b from pairs join keyed a on a.item_id = item_a join keyed b on b.item_id = item_b where a.k <> b.k),
sides as (select a, b from links union select b, a from links),
reach as (select distinct k a, k b from keyed union select reach.a, sides.b from reach join sides on sides.a = reach.b),
tops as (select a, min(b) class_id from reach group by 1),
degree as (select a, count(*) n from sides group by 1)
select item_id, class_id, coalesce(n, 0) n_links from keyed join tops on tops.a = k left join degree on degree.a = k"""

_SPACE = r"\t\n\x0b\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STATISTICS = rf"""
with lines as (select doc_id, unnest(string_split_regex(coalesce(text, ''), '[\r\n\x{{2028}}\x{{2029}}\x0b\x0c\x{{85}}]+')) line from documents),
kept as (select doc_id, regexp_replace(line, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') line from lines),
read as (select doc_id, line, length(line) n, regexp_extract_all(lower(line), '[\p{{L}}\p{{Nl}}\p{{No}}]+') w from kept where line <> ''),
per as (select doc_id, sum(len(w)) words, sum(length(array_to_string(w, ''))) letters, sum(n) total, count(*) lines,
  sum(len(list_filter(w, lambda x: list_contains(COMMON, x)))) common, sum(length(regexp_replace(line, '[\p{{L}}\p{{N}}_{_SPACE}]', '', 'g'))) symbols, sum(length(regexp_replace(line, '[^\p{{Nd}}]', '', 'g'))) digits,
  sum(case when strpos('.!?…:;"”’'')', right(line, 1)) > 0 then 1 else 0 end) ends from read group by 1)
select doc_id, coalesce(nullif(regexp_extract(lower(lang), '^[^a-z0-9_]*([a-z]{{2,3}})(?:[-_].*)?[^a-z0-9_]*$', 1), ''), 'und') lang, cast(coalesce(words, 0) as bigint) n_words,
  round(coalesce(letters / nullif(words, 0), 0), 6) mean_word_length, round(coalesce(symbols / total, 0), 6) symbol_ratio, round(coalesce(digits / total, 0), 6) digit_ratio, round(coalesce(ends / lines, 0), 6) punctuated_lines, round(coalesce(common / nullif(words, 0), 0), 6) common_share
from documents left join per using (doc_id)""".replace("COMMON", "[" + ", ".join(f"'{w}'" for w in sorted(COMMON)) + "]")

SQL = {
    "p10_statistics": _STATISTICS,
    "p5_found": _NEAR,
    "p5_classes": _CLASSES,
    "p1_found": _copies("swehockey_player_stats", _PLAYER) + " union all " + _copies("swehockey_schedule", _GAME),
    "p1_collapsed": _collapsed("swehockey_player_stats", _PLAYER) + " union all " + _collapsed("swehockey_schedule", _GAME),
}
