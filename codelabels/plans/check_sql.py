"""SQL fragments from which the checking queries are put together.

They state the same results in another way where that is possible: windows are
normalised after cutting, patch lines are numbered by running sums, tokens are
counted by grouping.
"""

from __future__ import annotations

from ..schemas import LABELS
from ..sources.derived import check_sql

# Line breaks and blanks, and in the functions below the patterns that decide results.
BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
BLANK = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PATH_BASE = "/data/" + "x" * 211


def replaced(e: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({e}, '{pattern}', '{by}', 'g')"


def strip(e: str) -> str:
    return replaced(e, f"^{BLANK}+|{BLANK}+$")


def split_lines(e: str) -> str:
    return f"regexp_split_to_array({e}, '{BREAK}')"


def line_count(e: str) -> str:
    # One more than the separators, less the one that ends the text.
    return (
        f"(case when {e} = '' then 0 else len({split_lines(e)}) - "
        f"(case when regexp_matches({e}, '({BREAK})$') then 1 else 0 end) end)"
    )


def remove_imports(e: str) -> str:
    return replaced(e, r"import [^\n]*?;")


def remove_packages(e: str) -> str:
    return replaced(e, r"package [^\n]*?;")


def remove_comments(e: str) -> str:
    return replaced(e, r"""(?sm)(".*?"|''.*?'')|(/\*.*?\*/|//[^\r\n]*$)""", r"\1")


def clean(e: str) -> str:
    return remove_packages(remove_imports(remove_comments(e)))


def clean_packages_first(e: str) -> str:
    return remove_imports(remove_packages(remove_comments(e)))


def remove_blank_lines(e: str) -> str:
    trimmed = replaced("x", f"{BLANK}+$")
    return f"array_to_string(list_filter(list_transform({split_lines(e)}, lambda x: {trimmed}), lambda x: x <> ''), chr(10))"


def replace_strings(e: str) -> str:
    return replaced(
        e, r"""["'']{2}"[^\n]*?"{3}|["'']{2}''[^\n]*?''{3}|"[^\n]*?"|''[^\n]*?''""", "<$STRING>"
    )


def replace_numbers(e: str) -> str:
    return replaced(e, r"(?:\B[+-]|\b)\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\b", "<$NUMBER>")


def replace_booleans(e: str) -> str:
    return replaced(e, r"(?i)\b(true|false)\b", "<$BOOLEAN>")


def normalise(e: str) -> str:
    return replace_booleans(replace_numbers(replace_strings(remove_blank_lines(e))))


def tokens(e: str) -> str:
    return f"regexp_extract_all({e}, '[A-Za-z0-9_$]+')"


def significant(e: str) -> str:
    blank_free = strip("y")
    return f"list_filter(string_split({e}, chr(10)), lambda y: {blank_free} not in ('', chr(123), chr(125)))"


def iso(e: str) -> str:
    return (
        f"concat(strftime({e}, '%Y-%m-%dT%H:%M:%S'), "
        f"case when microsecond({e}) % 1000000 = 0 then '' else strftime({e}, '.%f') end)"
    )


def iso_or_null(e: str) -> str:
    return f"case when {e} is null then null else {iso(e)} end"


def stem(e: str) -> str:
    return f"string_split(string_split({e}, '/')[-1], '.')[1]"


def file_key(path: str, sha: str) -> str:
    flat = rf"regexp_replace(replace({path}, '/', '_'), '\.[^.]*$', '')"
    return f"concat(replace({flat}, '.', '-'), '_', substr({sha}, 1, 7), '.', string_split({path}, '.')[-1])"


def with_tables(*names: str) -> str:
    return "with " + check_sql(*names)


def windows_cte(source: str, key: str, low: int, high: int, grow: int, move: int) -> str:
    """Entries ``sized`` and ``windows`` (key, size, start, code) from (key, lines)."""
    return f"""sized as (
  select {key}, lines, unnest(range(least({low}, len(lines)), least({high}, len(lines)) + 1, {grow})) as size from {source}),
placed as (
  select {key}, lines, size, unnest(range(0, len(lines) - size + 1, {move})) as start from sized),
windows as (
  select {key}, size, start, array_to_string(lines[start + 1:start + size], chr(10)) as code from placed)"""


def fired_cte(key: str, min_hits: int = 8, normal: bool = True) -> str:
    """Entry ``fired`` (key, k): labels of the rule shown by some window."""
    code = normalise("code") if normal else "code"
    return f"""words as (
  select {key}, size, start, unnest({tokens(code)}) as word from windows),
counted as (
  select {key}, size, start,
    case when lower(word[1]) between 'a' and 'z' then ascii(lower(word[1])) - 96 else {len(LABELS)} end as k, count(*) as n
  from words group by all),
fired as (select distinct {key}, k from counted where n >= {min_hits})"""


def detected_cte(files: str, key: str) -> str:
    """Entry ``verdicts`` (key, detected): the label map as JSON text per file."""
    return f"""verdicts as (
  select f.{key}, concat(chr(123), string_agg(concat('"K', cast(n.k as varchar), '":', case when d.k is null then '0' else '1' end), ',' order by n.k), chr(125)) as detected
  from {files} f cross join (select unnest(range(1, {len(LABELS) + 1})) as k) n
  left join fired d on d.{key} = f.{key} and d.k = n.k group by f.{key})"""


def pending_cte() -> str:
    """Entries up to ``pending``: files of a run with their places and text."""
    return f"""fresh as (
  select *, {stem('temp_filepath')} as filename from contributions_t
  where sha not in (select sha from analysis_results_t)),
ranked as (
  select *, row_number() over (partition by repo_name, filename order by seq desc) as back,
    min(seq) over (partition by repo_name, filename) as run_order from fresh),
pending as (
  select * exclude (back), row_number() over (partition by repo_name order by run_order) as done,
    count(*) over (partition by repo_name) as total
  from ranked where back = 1),
lined as (select seq, {significant(clean('file_content'))} as lines from pending)"""


def analysis_sql(low: int, high: int, grow: int, move: int, final: str) -> str:
    return f"""{with_tables('contributions', 'analysis_results')},
{pending_cte()},
{windows_cte('lined', 'seq', low, high, grow, move)},
{fired_cte('seq')},
{detected_cte('pending', 'seq')},
saved as (
  select p.*, v.detected, cast(trunc(p.done / p.total * 100) as int) as progress
  from pending p join verdicts v on p.seq = v.seq)
{final}"""


def commits_cte(limit: int | None = None, skip: int = 0, stored: bool = False) -> str:
    """Entry ``chosen``: commits an extraction looks at, with ``is_root``."""
    ranked = "row_number() over (partition by repo_name order by ordinal)"
    bounds = f"place > {skip}" + (f" and place <= {skip + limit}" if limit is not None else "")
    known = "and not exists (select 1 from stored_commits_t s where s.repo_name = c.repo_name and s.sha = c.sha)"
    return f"""placed_commits as (select *, {ranked} as place from commits_log_t),
chosen as (
  select *, len(parent_shas) = 0 as is_root from placed_commits c
  where {bounds} and len(parent_shas) <= 1 {known if stored else ''})"""


def changed_cte(base: str = "temp") -> str:
    """Entries up to ``changed``: files with changed lines as joined text."""
    added = "substr(line, 2)"
    hunk_file = "repo_name, sha, path"
    return rf"""touched as (
  select repo_name, sha, case when b_path <> '' then b_path else a_path end as path, patch from commit_patches_t),
content as (
  select c.repo_name, c.sha, c.author, c.committed_at, c.ordinal, c.is_root, t.path, t.patch, f.content as file_content,
    concat('{base}/', {file_key('t.path', 'c.sha')}) as temp_filepath,
    {clean_packages_first('f.content')} as cleaned
  from chosen c join touched t on t.repo_name = c.repo_name and t.sha = c.sha
  join commit_files_t f on f.repo_name = c.repo_name and f.sha = c.sha and f.path = t.path
  where t.path like '%.java' and f.content is not null and f.content <> '<undecodable>'
    and length(concat('{base}/', {file_key('t.path', 'c.sha')})) <= 250),
patch_lines as (
  select {hunk_file}, cleaned, unnest({split_lines('patch')}) as line,
    generate_subscripts({split_lines('patch')}, 1) as pos
  from content where not is_root),
hunks as (
  select *, sum(case when line like '@@%' then 1 else 0 end) over (partition by {hunk_file} order by pos) as hunk from patch_lines),
numbered as (
  select *, max(case when line like '@@%' then cast(regexp_extract(line, '^[^ ]* [^ ]* .(\d+)', 1) as int) end) over (partition by {hunk_file}, hunk)
    + coalesce(sum(case when line not like '@@%' and line not like '-%' then 1 else 0 end)
      over (partition by {hunk_file}, hunk order by pos rows between unbounded preceding and 1 preceding), 0) as num
  from hunks where hunk > 0),
judged as (
  select *, {strip(added)} not in ('', '*', '//') and contains(cleaned, {added}) as accepted
  from numbered where line like '+%' and line not like '+++%'),
line_lists as (
  select {hunk_file}, string_agg(cast(num as varchar), ',' order by pos) as changed_lines from judged where accepted group by {hunk_file}
  union all
  select {hunk_file}, array_to_string(range(1, {line_count('file_content')} + 1), ',') from content where is_root and {line_count('file_content')} > 0),
changed as (select c.*, l.changed_lines from content c join line_lists l using ({hunk_file}))"""
