"""The engine's tables derived from general-purpose test tables.

Each derivation is one SQL text for both Spark and a checking database; the few
spots where their dialects differ are the ``<...>`` markers in DIALECTS. All are
row-wise or small aggregates, so they grow with the tables they read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import LABELS, URL_PREFIX
from ..session import fresh_path

DIALECTS = {
    "spark": {
        "<ntz>": "timestamp_ntz",
        "<split>": r"split(replace(text, '. ', concat('.', chr(10))), '\n')",
        "<each>": "transform(",
        "<as l, i>": "(l, i) -> ",
        "<i>": "i",
        "<join>": "array_join(",
        "<upto>": "sequence(1, cast(1 + doc_id % 5 as int))",
        "<list>": "array(",
        "</list>": ")",
        "<none>": "cast(array() as array<string>)",
        "<bytes>": "cast(",
        "</bytes>": " as binary)",
        "<bad bytes>": "unhex('63C328')",
        "<labels>": f"map_from_arrays(array({', '.join(repr(x) for x in LABELS)}), array(%s))",
    },
    "duckdb": {
        "<ntz>": "timestamp",
        "<split>": "string_split(replace(text, '. ', concat('.', chr(10))), chr(10))",
        "<each>": "list_transform(",
        "<as l, i>": "lambda l, i: ",
        "<i>": "(i - 1)",
        "<join>": "array_to_string(",
        "<upto>": "range(1, 2 + doc_id % 5)",
        "<list>": "[",
        "</list>": "]",
        "<none>": "cast([] as varchar[])",
        "<bytes>": "",
        "</bytes>": "",
        # Undecodable content: the check's tables hold text, so mark it instead.
        "<bad bytes>": "'<undecodable>'",
        "<labels>": "concat(chr(123), %s, chr(125))",
    },
}

_VALUES = ["cast(b.quality as int)", "cast(b.toxic as int)"] + [
    f"cast(case when (d.doc_id + {k}) % 5 = 0 then 1 else 0 end as int)" for k in range(3, len(LABELS) + 1)
]

_DECORATED = """
<join><each><split>, <as l, i>
  case when <i> % 17 = 16 then concat(l, ' true -1.5e3 = 0x1F, 7.5f - 42')
       when <i> % 13 = 12 then concat(chr(123), chr(10), l, chr(10), '  ', chr(125), ' ')
       when <i> % 11 = 10 then concat('s = "// no import x;"; c = ''/*'' + ', cast(<i> as string), '; ', l)
       when <i> % 9 = 8 then concat(l, ' z = 2; // tail', chr(13))
       when <i> % 8 = 7 then concat('/* ', l, chr(10), ' * more */ y = 10e2;', chr(9))
       when <i> % 7 = 6 then concat('import a.b', cast(<i> as string), '; package c.d; import package e; ', l)
       when <i> % 5 = 4 then concat('// ', l)
       else l end), chr(10))
"""

_CODE = """concat('package p', cast(l_partkey as string), ';', chr(10),
  'import q.r', cast(l_suppkey as string), ';', chr(10),
  'class F', cast(l_linenumber as string), ' ', chr(123), chr(10),
  '  int a = ', cast(qty as string), ';', chr(10),
  '  // note ', cast(l_partkey as string), chr(10),
  '  x = 1; // why', chr(10),
  '  String s = "// ', cast(l_suppkey as string), '";', chr(10),
  '  /* long', chr(10), '   * note */', chr(10),
  '  ++i;', chr(10), chr(125), chr(10))"""

_PATCH = """concat('@@ -1,2 +', cast(l_linenumber as string), ',9 @@ class F', chr(10),
  ' class F', chr(10),
  '+  int a = ', cast(qty as string), ';', chr(10),
  '-  int b;', chr(10),
  '+  // note ', cast(l_partkey as string), chr(10),
  '+++i;', chr(10),
  '+  ++i;', chr(10),
  '+  x = 1; // why', chr(10),
  '+   * note */', chr(10),
  '+  ', chr(10),
  '@@ -10 +', cast(20 + l_linenumber as string), ',2 @@', chr(10),
  '+import q.r', cast(l_suppkey as string), ';', chr(10),
  '+', chr(125), chr(10),
  chr(92), ' No newline at end of file', chr(10),
  case when l_suppkey % 3 = 0 then concat('+  String s = "// ', cast(l_suppkey as string), '";') else '-gone' end)"""

# One line of an order stands for one changed file; equal lines are one file.
_CHANGES = """(select l_orderkey, l_partkey, l_linenumber, min(l_suppkey) as l_suppkey,
    min(ascii(l_returnflag)) as flag, cast(min(l_quantity) as int) as qty
  from {lineitem} group by l_orderkey, l_partkey, l_linenumber)"""

_PATH = """concat('src/main/p', cast(l_partkey as string), '.v1/F', cast(l_linenumber as string),
  case when flag = ascii('R') then '.py' else '.java' end)"""

TABLES = {
    "repositories": (
        ["documents", "customer"],
        f"""
select name,
  case when k % 2 = 0 then concat('{URL_PREFIX}', name) else concat('https://github.com/other/', name, '.git') end as url,
  concat('about ', name) as description,
  case when k % 3 = 0 then null else concat('note ', cast(k as string)) end as comments,
  cast(concat('2023-01-', lpad(cast(1 + k % 28 as string), 2, '0'), ' 10:00:00') as <ntz>) as created_at,
  cast(concat('2023-02-', lpad(cast(1 + k % 28 as string), 2, '0'), ' 11:30:00.25') as <ntz>) as updated_at,
  cast(case when k % 4 = 0 then 'in-progress' end as string) as analysis_status,
  cast(case when k % 4 = 0 then '2023-03-01 08:00:00' end as <ntz>) as analysis_start_time,
  cast(null as <ntz>) as analysis_end_time,
  cast(case when k % 4 = 0 then k % 100 end as int) as analysis_progress,
  cast(null as string) as analysis_error_message
from (select source as name, min(doc_id) as k from {{documents}} group by source
      union all select concat('repo', cast(c_custkey as string)), c_custkey from {{customer}}) r
""",
    ),
    "contributions": (
        ["documents"],
        f"""
select doc_id as seq,
  concat('dev', cast(doc_id % 37 as string)) as author,
  {_DECORATED} as file_content,
  <upto> as changed_lines,
  concat('/t/src_main_', source, '_F', cast(doc_id % 2 as string), '_', substr(md5(concat(source, '/', cast(cast(floor(doc_id / 60) as bigint) as string))), 1, 7), '.java') as temp_filepath,
  cast(concat('2024-01-', lpad(cast(1 + doc_id % 28 as string), 2, '0'), ' ', lpad(cast(doc_id % 24 as string), 2, '0'), ':05:09', case when doc_id % 3 = 0 then '.000125' else '' end) as <ntz>) as timestamp,
  md5(concat(source, '/', cast(cast(floor(doc_id / 60) as bigint) as string))) as sha,
  source as repo_name
from {{documents}}
""",
    ),
    "analysis_results": (
        ["documents", "labels"],
        f"""
select d.doc_id as seq,
  concat('src_main_', d.source, '_F', cast(d.doc_id % 2 as string)) as filename,
  concat('dev', cast(d.doc_id % 37 as string)) as author,
  cast(case when d.doc_id % 10 = 9 then null else concat('2024-01-', lpad(cast(1 + d.doc_id % 28 as string), 2, '0'), ' 03:05:09', case when d.doc_id % 3 = 0 then '.000125' else '' end) end as <ntz>) as timestamp,
  md5(concat(d.source, '/', cast(cast(floor(d.doc_id / 60) as bigint) as string))) as sha,
  <labels> as detected,
  cast(0 as double) as elapsed_time,
  case when d.doc_id % 11 = 5 then 'unlisted' else d.source end as repo_name
from {{documents}} d join {{labels}} b on d.doc_id = b.doc_id
where b.toxic = 1 or b.quality = 0
""",
    ),
    "commits_log": (
        ["orders"],
        """
select concat('src', cast(k % 20 as string)) as repo_name,
  md5(cast(k as string)) as sha,
  concat('dev', cast(o_custkey as string)) as author,
  o_orderdate as committed_at,
  case when k < 20 or k % 97 = 0 then <none>
       when k % 7 = 0 and k >= 40 then <list>md5(cast(k - 20 as string)), md5(cast(k - 40 as string))</list>
       else <list>md5(cast(k - 20 as string))</list> end as parent_shas,
  cast(floor((top - k) / 20) + 1 as bigint) as ordinal
from (select o_orderkey as k, o_custkey, o_orderdate, (select max(o_orderkey) from {orders}) as top from {orders}) o
""",
    ),
    "stored_commits": (
        ["orders"],
        """
select concat('src', cast(o_orderkey % 20 as string)) as repo_name, md5(cast(o_orderkey as string)) as sha
from {orders} where o_orderstatus = 'O'
""",
    ),
    "commit_files": (
        ["lineitem"],
        f"""
select concat('src', cast(l_orderkey % 20 as string)) as repo_name,
  md5(cast(l_orderkey as string)) as sha,
  {_PATH} as path,
  case when l_suppkey % 50 = 7 then null when l_suppkey % 50 = 9 then <bad bytes> else <bytes>{_CODE}</bytes> end as content
from {_CHANGES} c
""",
    ),
    "commit_patches": (
        ["lineitem"],
        f"""
select concat('src', cast(l_orderkey % 20 as string)) as repo_name,
  md5(cast(l_orderkey as string)) as sha,
  {_PATH} as a_path,
  case when l_suppkey % 50 = 7 then '' else {_PATH} end as b_path,
  {_PATCH} as patch
from {_CHANGES} c
""",
    ),
    "status_log": (
        ["events"],
        """
select event_id as seq,
  case when event_id % 2 = 0 then concat('src', cast(user_id % 20 as string)) else concat('repo', cast(user_id as string)) end as repo_name,
  case when event_type = 'error' then 'error' when event_type in ('signup', 'purchase') then 'completed' else 'in-progress' end as status,
  ts as start_time,
  case when event_type in ('error', 'signup', 'purchase') then ts end as end_time,
  cast(case when event_type = 'error' then null when event_type in ('signup', 'purchase') then 100 else user_id % 100 end as int) as progress,
  case when event_type = 'error' then props end as error_message
from {events}
""",
    ),
    "repository_updates": (
        ["orders"],
        """
select o_orderkey as seq,
  concat('repo', cast(o_custkey * 2 as string)) as name,
  case when o_orderkey % 5 = 0 then null else concat('https://example.org/', cast(o_orderkey as string)) end as url,
  o_orderpriority as description,
  case when o_orderkey % 2 = 0 then null else o_orderstatus end as comments
from {orders}
""",
    ),
    "deleted_names": (
        ["nation", "supplier"],
        """
select concat('src', cast(n_nationkey * 2 as string)) as name from {nation}
union all select concat('repo', cast(s_suppkey as string)) from {supplier}
""",
    ),
    "texts": (
        ["documents", "pages"],
        f"""
select concat('doc', cast(doc_id as string)) as id, {_DECORATED} as text from {{documents}}
union all select concat('page', cast(page_id as string)), html from {{pages}}
""",
    ),
}


def _labels(dialect: str) -> str:
    form = DIALECTS[dialect]["<labels>"]
    if dialect == "spark":
        return form % ", ".join(_VALUES)
    pairs = ", ',', ".join(f"""'"{name}":', {value}""" for name, value in zip(LABELS, _VALUES, strict=True))
    return form % pairs


def sql_text(name: str, dialect: str) -> str:
    text = TABLES[name][1].replace("<labels>", _labels(dialect))
    for marker, words in DIALECTS[dialect].items():
        text = text.replace(marker, words)
    return text


_KEPT: dict[tuple[str, str, str], str] = {}


def keep(spark: SparkSession, folder: str) -> None:
    """Writes all engine tables of a folder once; :func:`derive` reads them from then on.

    For measurements, which should show the queries and not the derivation. Other
    applications derive their own.
    """
    for name in TABLES:
        place = fresh_path(spark, f"derived-{name}")
        derive(spark, folder, name).write.parquet(place)
        _KEPT[spark.sparkContext.applicationId, folder, name] = place


def derive(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An engine table as a lazy frame over the Parquet tables in ``folder``."""
    if place := _KEPT.get((spark.sparkContext.applicationId, folder, name)):
        return spark.read.parquet(place)
    inputs = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in TABLES[name][0]}
    return spark.sql(sql_text(name, "spark"), **inputs)


def check_sql(*names: str) -> str:
    """The same tables as leading WITH entries for the checking database."""
    parts = []
    for name in names:
        tables = {t: t for t in TABLES[name][0]}
        parts.append(f"{name}_t as ({sql_text(name, 'duckdb').format(**tables)})")
    return ",\n".join(parts)
