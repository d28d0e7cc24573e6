"""Every operator as a query over the given tables, with its checking SQL.

A query takes (spark, folder) and reads whole tables. Arrays and maps leave as
text so that both engines print the same values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text, values
from ..operators import catalog, history, patches, ranking, results, runs, scoring, stacked, windows
from ..schemas import ANALYSIS_RESULTS, CLASSIFIER_LABELS, COMMIT_LIMIT, LABELS, NO_COMMITS, STATUS_LOG, create_tables
from ..session import CODEC, fresh_path, settle
from ..sources import files, lineage, manifest, tables
from ..sources.derived import derive
from ..streaming import jobs as streams
from ..streaming import runs as followed
from . import check_sql as sql
from . import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

NOW = "2024-06-01 12:00:00"
REPO = "src1"


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return run

    return register


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def joined(c: Column, by: str = ",") -> Column:
    return F.array_join(c, by)


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


# --- scalar text functions ---------------------------------------------------


def _text_query(name: str, make: Callable[[Column], Column], check: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return derive(spark, folder, "texts").select("id", make(F.col("text")).alias("result"))

    query(name, f"{sql.with_tables('texts')} select id, {check} as result from texts_t")(run)


for _name, _make, _check in [
    ("t1_remove_imports", text.remove_imports, sql.remove_imports("text")),
    ("t2_remove_packages", text.remove_packages, sql.remove_packages("text")),
    ("t3_remove_comments", text.remove_comments, sql.remove_comments("text")),
    ("t4_clean_file", text.clean, sql.clean("text")),
    ("t4_clean_packages_first", partial(text.clean, packages_first=True), sql.clean_packages_first("text")),
    ("t5_remove_blank_lines", text.remove_blank_lines, sql.remove_blank_lines("text")),
    ("t6_replace_strings", text.replace_strings, sql.replace_strings("text")),
    ("t7_replace_numbers", text.replace_numbers, sql.replace_numbers("text")),
    ("t8_replace_booleans", text.replace_booleans, sql.replace_booleans("text")),
    ("t9_tokenize", lambda c: joined(text.tokenize(c), "|"), f"array_to_string({sql.tokens('text')}, '|')"),
    ("t10_join_words", lambda c: text.join_words(text.tokenize(c)), f"array_to_string({sql.tokens('text')}, ' ')"),
    ("t11_normalise_window", text.normalise, sql.normalise("text")),
    ("t11_token_text", text.token_text, f"array_to_string({sql.tokens(sql.normalise('text'))}, ' ')"),
    (
        "t12_all_line_numbers",
        lambda c: joined(text.all_line_numbers(c)),
        f"array_to_string(range(1, {sql.line_count('text')} + 1), ',')",
    ),
    (
        "f10_significant_lines",
        lambda c: joined(text.significant_lines(c), "\n"),
        f"array_to_string({sql.significant('text')}, chr(10))",
    ),
]:
    _text_query(_name, _make, _check)


# --- times, maps, figures ------------------------------------------------------


@query("t13_iso_time", f"select event_id, {sql.iso('ts')} as iso from events")
def t13(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select("event_id", values.iso(F.col("ts")).alias("iso"))


@query("t14_parse_iso_time", "select event_id, ts as parsed from events")
def t14(spark: SparkSession, folder: str) -> DataFrame:
    events = read(spark, folder, "events").select("event_id", values.iso(F.col("ts")).alias("iso"))
    return events.select("event_id", values.from_iso(F.col("iso")).alias("parsed"))


@query("t15_plain_time", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as plain from orders")
def t15(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").select("o_orderkey", values.plain_time(F.col("o_orderdate")).alias("plain"))


@query("t16_epoch_to_time", "select o_orderkey, make_timestamp(o_orderkey * 86399 * 1000000) as at from orders")
def t16(spark: SparkSession, folder: str) -> DataFrame:
    seconds = F.col("o_orderkey") * 86399
    return read(spark, folder, "orders").select("o_orderkey", values.from_epoch(seconds).alias("at"))


@query(
    "t17_json_map",
    "select event_id, cast(json_extract(props, '$.k') as int) as k, replace(props, ' ', '') as encoded from events",
)
def t17(spark: SparkSession, folder: str) -> DataFrame:
    decoded = read(spark, folder, "events").select("event_id", values.decode_map(F.col("props")).alias("m"))
    return decoded.select("event_id", F.col("m")["k"].alias("k"), values.encode_map(F.col("m")).alias("encoded"))


@query(
    "t18_sigmoid_threshold",
    "select vec_id, array_to_string(list_transform(embedding, lambda x: cast(1 / (1 + exp(-cast(x as double))) > 0.5 as int)), ',') as decided from embeddings",
)
def t18(spark: SparkSession, folder: str) -> DataFrame:
    logits = F.col("embedding").cast("array<double>")
    return read(spark, folder, "embeddings").select("vec_id", joined(values.decide(logits)).alias("decided"))


@query(
    "t19_progress",
    "select o_orderkey, cast(trunc((o_orderkey + 1) / count(*) over () * 100) as int) as progress from orders",
)
def t19(spark: SparkSession, folder: str) -> DataFrame:
    orders = read(spark, folder, "orders").select("o_orderkey")
    total = orders.agg(F.count(F.lit(1)).alias("total"))
    # The one-row total is attached as a scalar subquery, not by a join.
    return orders.select(
        "o_orderkey", values.progress(F.col("o_orderkey") + 1, total.scalar()).alias("progress")
    )


# --- filters and derived columns --------------------------------------------


def _commits(spark: SparkSession, folder: str) -> DataFrame:
    return derive(spark, folder, "commits_log")


def _extracted(spark: SparkSession, folder: str, limit: int | None = None, stored: bool = False) -> DataFrame:
    known = derive(spark, folder, "stored_commits") if stored else None
    return jobs.extract_contributions(
        _commits(spark, folder),
        derive(spark, folder, "commit_files"),
        derive(spark, folder, "commit_patches"),
        stored=known,
        limit=limit,
    )


def _changed_files(spark: SparkSession, folder: str, base: str = "temp") -> DataFrame:
    chosen = history.without_merges(_commits(spark, folder)).select("repo_name", "sha", "ordinal", "is_root")
    diffs = derive(spark, folder, "commit_patches")
    return patches.changed_files(patches.wanted_files(chosen, diffs, base), diffs, derive(spark, folder, "commit_files"), base)


EXTRACT_TABLES = ("commits_log", "commit_files", "commit_patches", "stored_commits")


def _extract_sql(final: str, limit: int | None = None, stored: bool = False, base: str = "temp") -> str:
    return (
        f"{sql.with_tables(*EXTRACT_TABLES)},\n{sql.commits_cte(limit, 0, stored)},\n{sql.changed_cte(base)}\n{final}"
    )


PATH_SQL = "case when b_path <> '' then b_path else a_path end"


@query(
    "f1_file_type",
    f"{sql.with_tables('commit_patches')} select repo_name, sha, {PATH_SQL} as path from commit_patches_t where {PATH_SQL} like '%.java'",
)
def f1(spark: SparkSession, folder: str) -> DataFrame:
    path = paths.relevant_path(F.col("a_path"), F.col("b_path"))
    changed = derive(spark, folder, "commit_patches").select("repo_name", "sha", path.alias("path"))
    return changed.where(paths.has_type(F.col("path")))


@query(
    "f2_parent_count",
    f"{sql.with_tables('commits_log')} select repo_name, sha, len(parent_shas) = 0 as is_root from commits_log_t where len(parent_shas) <= 1",
)
def f2(spark: SparkSession, folder: str) -> DataFrame:
    return history.without_merges(_commits(spark, folder)).select("repo_name", "sha", "is_root")


_KEY = sql.file_key("path", "sha")


@query(
    "f3_path_limit",
    f"{sql.with_tables('commit_files')} select sha, path, concat('{sql.PATH_BASE}/', {_KEY}) as temp_filepath from commit_files_t "
    f"where path like '%.java' and length(concat('{sql.PATH_BASE}/', {_KEY})) <= 250",
)
def f3(spark: SparkSession, folder: str) -> DataFrame:
    java = derive(spark, folder, "commit_files").where(paths.has_type(F.col("path")))
    named = java.select("sha", "path", paths.temp_path(F.col("path"), F.col("sha"), sql.PATH_BASE).alias("temp_filepath"))
    return named.where(paths.path_fits(F.col("temp_filepath")))


@query(
    "f4_utf8_only",
    f"{sql.with_tables('commit_files')} select sha, path, content as file_content from commit_files_t where content <> '<undecodable>'",
)
def f4(spark: SparkSession, folder: str) -> DataFrame:
    content = patches.valid_text(F.col("content")).alias("file_content")
    return derive(spark, folder, "commit_files").select("sha", "path", content).where("file_content is not null")


@query("f5_has_changed_lines", _extract_sql("select repo_name, sha, path from changed"))
def f5(spark: SparkSession, folder: str) -> DataFrame:
    return patches.with_changed_lines(_changed_files(spark, folder)).select("repo_name", "sha", "path")


@query(
    "f6_repository_name",
    f"{sql.with_tables('repositories')} select url, replace(string_split(url, '/')[-1], '.git', '') as repo from repositories_t "
    "union all select url, replace(string_split(url, '/')[-1], '.git', '') from pages",
)
def f6(spark: SparkSession, folder: str) -> DataFrame:
    urls = derive(spark, folder, "repositories").select("url").unionByName(read(spark, folder, "pages").select("url"))
    return urls.select("url", paths.repository_name(F.col("url")).alias("repo"))


@query(
    "f7_file_key",
    f"{sql.with_tables('commit_files')} select sha, path, {_KEY} as file_key from commit_files_t",
)
def f7(spark: SparkSession, folder: str) -> DataFrame:
    key = paths.file_key(F.col("path"), F.col("sha"))
    return derive(spark, folder, "commit_files").select("sha", "path", key.alias("file_key"))


@query(
    "f8_stem",
    f"{sql.with_tables('contributions')} select seq, {sql.stem('temp_filepath')} as filename from contributions_t",
)
def f8(spark: SparkSession, folder: str) -> DataFrame:
    return derive(spark, folder, "contributions").select("seq", paths.stem(F.col("temp_filepath")).alias("filename"))


@query(
    "f9_line_acceptance",
    _extract_sql(
        "select repo_name, sha, path, count(*) as added, cast(sum(case when accepted then 1 else 0 end) as bigint) as accepted from judged group by all"
    ),
)
def f9(spark: SparkSession, folder: str) -> DataFrame:
    # The null test is a second use that keeps the clean-up out of the per-line lambda. A filter would
    # be pushed below and judge twice, so an explode over zero or one array drops files without lines.
    cleaned = _changed_files(spark, folder).where(~F.col("is_root")).select(
        "repo_name", "sha", "path", "patch", text.clean(F.col("file_content"), True).alias("cleaned")
    )
    added = F.filter(patches.hunk_lines(F.col("patch")), lambda line: line.startswith("+") & ~line.startswith("+++"))
    verdicts = F.when(F.col("cleaned").isNotNull(), F.transform(added, lambda line: patches.line_accepted(line, F.col("cleaned"))))
    some = F.filter(F.array(verdicts), lambda found: F.size(found) > 0)
    judged = cleaned.select("repo_name", "sha", "path", F.explode(some).alias("verdicts"))
    return judged.select(
        "repo_name", "sha", "path",
        F.size("verdicts").cast("bigint").alias("added"),
        F.size(F.filter("verdicts", lambda ok: ok)).cast("bigint").alias("accepted"),
    )


# --- windows, folding, scoring -------------------------------------------------


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    # Spread by file first: scoring is heavy, scans may be uneven, and the folding
    # of a file's windows then needs no exchange of its own.
    contributions = derive(spark, folder, "contributions").select("seq", "file_content").repartition("seq")
    return windows.file_lines(contributions)


LINED_SQL = (
    f"{sql.with_tables('contributions')}, lined as (select seq, {sql.significant(sql.clean('file_content'))} as lines from contributions_t)"
)
GRIDS = {"35_25": (35, 35, 1, 25), "6_3": (6, 6, 1, 3), "grid_4_6": (4, 6, 1, 4)}


def _window_queries(grid: str, low: int, high: int, grow: int, move: int) -> None:
    cut = f"{LINED_SQL},\n{sql.windows_cte('lined', 'seq', low, high, grow, move)}"
    fired = f"{cut},\n{sql.fired_cte('seq')}"

    @query(
        f"w1_line_windows_{grid}",
        f"{cut} select seq, cast(size as bigint) as size, cast(start as bigint) as start, {sql.normalise('code')} as code from windows",
    )
    def w1(spark: SparkSession, folder: str) -> DataFrame:
        wins = windows.line_windows(_lines(spark, folder), low, high, grow, move)
        return wins.select("seq", F.col("size").cast("bigint"), F.col("start").cast("bigint"), "code")

    @query(
        f"a1_any_window_{grid}",
        f"{fired}, {sql.detected_cte('lined', 'seq')} select seq, detected from verdicts",
    )
    def a1(spark: SparkSession, folder: str) -> DataFrame:
        scorer = scoring.RuleScorer()
        scored = scorer(windows.line_windows(_lines(spark, folder), low, high, grow, move))
        folded = results.any_window(scored, ["seq"], scorer.labels)
        return folded.select("seq", values.encode_map(results.label_map(F.col("verdict"), LABELS)).alias("detected"))

    @query(
        f"a2_any_window_per_model_{grid}",
        f"{fired} select l.seq, concat('K', cast(n.k as varchar)) as model, d.k is not null as detected from lined l "
        "cross join (select unnest(range(1, 28)) as k) n left join fired d on d.seq = l.seq and d.k = n.k",
    )
    def a2(spark: SparkSession, folder: str) -> DataFrame:
        wins = windows.line_windows(_lines(spark, folder), low, high, grow, move).select("seq", "code")
        fanned = scoring.fan_out(wins, scoring.initial_models(LABELS), scoring.token_initials)
        return results.any_window_per_model(fanned, ["seq"]).select("seq", "model", "detected")


for _grid, _numbers in GRIDS.items():
    _window_queries(_grid, *_numbers)


@query(
    "w2_changed_lines",
    _extract_sql("select repo_name, sha, path, is_root, changed_lines from changed"),
)
def w2(spark: SparkSession, folder: str) -> DataFrame:
    files_ = _changed_files(spark, folder).withColumn("root", F.col("is_root"))
    return patches.with_changed_lines(files_).select(
        "repo_name", "sha", "path", F.col("root").alias("is_root"), joined(F.col("changed_lines")).alias("changed_lines")
    )


RULE_SQL = f"{LINED_SQL},\n{sql.windows_cte('lined', 'seq', *GRIDS['6_3'])},\n{sql.fired_cte('seq')}"


@query(
    "a3_label_map",
    f"{RULE_SQL}, {sql.detected_cte('lined', 'seq')} select seq, detected, "
    "cast(json_extract(detected, '$.K5') as int) as k5 from verdicts",
)
def a3(spark: SparkSession, folder: str) -> DataFrame:
    scorer = scoring.RuleScorer()
    scored = scorer(windows.line_windows(_lines(spark, folder), *GRIDS["6_3"]))
    folded = results.any_window(scored, ["seq"], scorer.labels)
    mapped = folded.select("seq", results.label_map(F.col("verdict"), LABELS).alias("m"))
    return mapped.select("seq", values.encode_map(F.col("m")).alias("detected"), F.col("m")["K5"].alias("k5"))


@query(
    "j6_models_by_windows",
    f"{RULE_SQL} select w.seq, cast(w.start as bigint) as start, concat('K', cast(n.k as varchar)) as model, "
    "cast(case when c.n >= 8 then 1 else 0 end as int) as prediction from windows w "
    "cross join (select unnest(range(1, 28)) as k) n left join counted c on c.seq = w.seq and c.start = w.start and c.k = n.k",
)
def j6(spark: SparkSession, folder: str) -> DataFrame:
    wins = windows.line_windows(_lines(spark, folder), *GRIDS["6_3"]).select("seq", F.col("start").cast("bigint"), "code")
    return scoring.fan_out(wins, scoring.initial_models(LABELS), scoring.token_initials)


@query(
    "f11_model_allow_list",
    f"{RULE_SQL} select l.seq, concat('K', cast(n.k as varchar)) as model, d.k is not null as detected from lined l "
    "cross join (select unnest([2, 3, 27]) as k) n left join fired d on d.seq = l.seq and d.k = n.k",
)
def f11(spark: SparkSession, folder: str) -> DataFrame:
    wins = windows.line_windows(_lines(spark, folder), *GRIDS["6_3"]).select("seq", "code")
    # The list is applied to the registry's names: other models are never scored.
    registry = spark.createDataFrame([(name,) for name in LABELS], "name string")
    names = [row["name"] for row in scoring.allowed(registry, ["K2", "K3", "K27"]).collect()]
    fanned = scoring.fan_out(wins, scoring.initial_models(names), scoring.token_initials)
    return results.any_window_per_model(fanned, ["seq"]).select("seq", "model", "detected")


WINDOW_COUNTS_SQL = (
    f"{RULE_SQL} select w.seq, cast(w.start as bigint) as start, "
    "coalesce(string_agg(cast(c.k as varchar), ',' order by c.k) filter (where c.n >= 8), '') as fired from windows w "
    "left join counted c on c.seq = w.seq and c.start = w.start group by w.seq, w.start"
)


def _fired(scored: DataFrame) -> DataFrame:
    numbered = F.transform(F.col("prediction"), lambda p, i: F.struct(p.alias("p"), (i + 1).alias("k")))
    shown = F.transform(F.filter(numbered, lambda x: x["p"] == 1), lambda x: x["k"].cast("string"))
    return scored.select("seq", F.col("start").cast("bigint"), joined(shown).alias("fired"))


@query("u2_rule_scorer", WINDOW_COUNTS_SQL)
def u2_rule(spark: SparkSession, folder: str) -> DataFrame:
    return _fired(scoring.RuleScorer()(windows.line_windows(_lines(spark, folder), *GRIDS["6_3"])))


@query("u2_arrow_scorer", WINDOW_COUNTS_SQL)
def u2_arrow(spark: SparkSession, folder: str) -> DataFrame:
    scorer = scoring.ArrowScorer(scoring.rule_model())
    return _fired(scorer(windows.line_windows(_lines(spark, folder), *GRIDS["6_3"])))


@query("u2_score_once", WINDOW_COUNTS_SQL)
def u2_once(spark: SparkSession, folder: str) -> DataFrame:
    """Every window's labels from verdicts kept by content: half the files are scored first, then all are asked."""
    scorer = scoring.ScoreOnce(scoring.ArrowScorer(scoring.rule_model()), fresh_path(spark, "verdicts"))
    wins = windows.line_windows(_lines(spark, folder), *GRIDS["6_3"])
    scorer(wins.where("seq % 2 = 0"))
    return _fired(scorer(wins))


def _trained(spark: SparkSession, folder: str) -> dict:
    """Two classifiers fitted on the labelled documents (fitting is not an operator)."""
    texts = derive(spark, folder, "contributions").select(F.col("seq").alias("doc_id"), "file_content")
    labelled = texts.join(read(spark, folder, "labels"), "doc_id").repartition("doc_id")
    prepared = labelled.select(text.token_text(text.clean(F.col("file_content"))).alias("tokens"), "quality", "toxic")
    # Settled before the filter, which would be pushed below and clean every text twice.
    prepared = settle(prepared, "training").where("tokens <> ''")
    return scoring.fit_each(prepared, {"K1": "quality", "K2": "toxic"})


def _by_hand(scored: DataFrame, name: str, model) -> Column:
    """The decision of a trained classifier from its coefficients, as a plain expression."""
    linear = model.stages[-1]
    weights = F.array(*[F.lit(float(w)) for w in linear.coefficients])
    products = F.zip_with(vector_to_array(F.col(f"{name}_best")), weights, lambda x, w: x * w)
    margin = F.aggregate(products, F.lit(float(linear.intercept)), lambda total, x: total + x)
    return (1 / (1 + F.exp(-margin)) > linear.getThreshold()).cast("int")


_EACH_MODEL = "cross join (select unnest(['K1', 'K2']) as model) m"


@query(
    "u1_per_label_classifier",
    f"{sql.with_tables('contributions')} select seq, model, true as agrees from contributions_t {_EACH_MODEL}",
)
def u1(spark: SparkSession, folder: str) -> DataFrame:
    """Every classifier's decision on every file, beside that recomputed from its coefficients."""
    models = _trained(spark, folder)
    wins = windows.line_windows(_lines(spark, folder)).select("seq", "code")
    # Windows are cut and counted once for both.
    counts = settle(scoring.featured(wins, models), "window-counts")
    decided = results.any_window_per_model(scoring.classify(counts, models), ["seq"])
    vectors = counts
    for model in models.values():
        for stage in scoring.left_over(model.stages[:-1], vectors.columns):
            vectors = stage.transform(vectors)
    own = F.array(*[F.struct(F.lit(n).alias("model"), _by_hand(vectors, n, m).alias("prediction")) for n, m in models.items()])
    again = results.any_window_per_model(vectors.select("seq", F.inline(own)), ["seq"]).withColumnRenamed("detected", "again")
    return decided.join(again, ["seq", "model"]).select("seq", "model", F.col("detected").eqNullSafe(F.col("again")).alias("agrees"))


def _stacked(spark: SparkSession, folder: str) -> stacked.Stacked:
    """Classifiers of both labels, fitted together on the labelled documents and kept in a registry."""
    texts = derive(spark, folder, "contributions").select(F.col("seq").alias("doc_id"), "file_content")
    labelled = texts.join(read(spark, folder, "labels"), "doc_id").repartition("doc_id")
    prepared = labelled.select(text.token_text(text.clean(F.col("file_content"))).alias("tokens"), F.col("quality").alias("K1"), F.col("toxic").alias("K2"))
    place = fresh_path(spark, "stacked")
    stacked.save(spark, stacked.fit(prepared, ["K1", "K2"]), place)
    return stacked.load(spark, place, ["K1", "K2", "absent"])


def _marked(wins: DataFrame, key: str) -> DataFrame:
    """The windows' token texts, numbered and settled: windows are cut once, whatever is done with them."""
    return settle(scoring.with_tokens(wins.select(key, F.monotonically_increasing_id().alias("window"), "code")), "marked")


def _recomputed(marked: DataFrame, model: stacked.Stacked, key: str) -> DataFrame:
    """(key, model, again): decisions by joining each window's features with a table of weights."""
    spark = marked.sparkSession
    table = [(label, i, row[k]) for k, label in enumerate(model.labels) for i, row in zip(model.ids, model.weights, strict=True)]
    weights = spark.createDataFrame(table, "model string, id int, weight double")
    offsets = spark.createDataFrame(list(zip(model.labels, model.offsets, strict=True)), "model string, offset double")
    ids = marked.select(key, "window", F.explode(stacked.gram_ids(F.col("tokens"), model.features, model.grams)).alias("id"))
    sums = ids.join(weights, "id").groupBy("window", "model").agg(F.sum("weight").alias("sum"))
    every = marked.select(key, "window", F.explode(F.array(*map(F.lit, model.labels))).alias("model"))
    shown = every.join(sums, ["window", "model"], "left").join(offsets, "model")
    decided = 1 / (1 + F.exp(-(F.col("offset") + F.coalesce("sum", F.lit(0.0))))) > model.threshold
    return shown.groupBy(key, "model").agg(F.bool_or(decided).alias("again"))


@query("u1_stacked_classifier", CHECKS["u1_per_label_classifier"])
def u1_stacked(spark: SparkSession, folder: str) -> DataFrame:
    """All labels' decisions on every file at one look, beside those recomputed by joins."""
    model = _stacked(spark, folder)
    marked = _marked(windows.line_windows(_lines(spark, folder)), "seq")
    decided = results.any_window_per_model(stacked.classify(marked, model), ["seq"])
    again = _recomputed(marked, model, "seq")
    return decided.join(again, ["seq", "model"]).select("seq", "model", F.col("detected").eqNullSafe(F.col("again")).alias("agrees"))


@query(
    "u3_model_registry",
    f"{sql.with_tables('contributions')} select seq, model, true as same, model = 'K2' as listed from contributions_t {_EACH_MODEL}",
)
def u3(spark: SparkSession, folder: str) -> DataFrame:
    """Saved classifiers decide as before saving; the allow-list loads only what it names."""
    place, models = fresh_path(spark, "models"), _trained(spark, folder)
    scoring.save_models(models, place)
    loaded, listed = scoring.load_models(spark, place), scoring.load_models(spark, place, ["K2", "absent"])
    tokens = settle(scoring.with_tokens(windows.line_windows(_lines(spark, folder)).select("seq", "code")), "window-tokens")
    counts = settle(scoring.featured(tokens, models), "window-counts")

    def decisions(chosen: dict, name: str) -> DataFrame:
        # Counts of other stages or parameters would be other counts: those are made anew.
        counted = counts if scoring.same_features(models, chosen) else tokens
        return results.any_window_per_model(scoring.classify(counted, chosen), ["seq"]).withColumnRenamed("detected", name)

    joined_ = decisions(models, "before").join(decisions(loaded, "after"), ["seq", "model"])
    joined_ = joined_.join(decisions(listed, "chosen"), ["seq", "model"], "left")
    same = F.col("before").eqNullSafe(F.col("after")) & F.coalesce(F.col("chosen") == F.col("before"), F.lit(True))
    return joined_.select("seq", "model", same.alias("same"), F.col("chosen").isNotNull().alias("listed"))


# --- commit history ---------------------------------------------------------


_LOG = sql.with_tables("commits_log", "commit_patches", "stored_commits")
_JAVA = f"exists (select 1 from commit_patches_t p where p.repo_name = c.repo_name and p.sha = c.sha and {PATH_SQL} like '%.java')"


@query(
    "s12_history_newest_first",
    f"{_LOG} select repo_name, sha, author, committed_at, row_number() over (partition by repo_name order by ordinal) as position from commits_log_t",
)
def s12(spark: SparkSession, folder: str) -> DataFrame:
    log = _commits(spark, folder)
    places = ranking.number_within(log.select("repo_name", "sha", "ordinal"), "repo_name", "ordinal")
    return log.select("repo_name", "sha", "author", "committed_at").join(
        places.select("repo_name", "sha", "position"), ["repo_name", "sha"]
    )


@query(
    "l1_newest_commits",
    f"{_LOG} select repo_name, sha, ordinal from (select *, row_number() over (partition by repo_name order by ordinal) as n from commits_log_t) c where n > 10 and n <= 60",
)
def l1(spark: SparkSession, folder: str) -> DataFrame:
    return history.newest_commits(_commits(spark, folder), limit=50, skip=10).select("repo_name", "sha", "ordinal")


@query(
    "l1_newest_commits_no_limit",
    f"{_LOG} select repo_name, sha, ordinal from (select *, row_number() over (partition by repo_name order by ordinal) as n from commits_log_t) c where n > 10",
)
def l1_open(spark: SparkSession, folder: str) -> DataFrame:
    return history.newest_commits(_commits(spark, folder), skip=10).select("repo_name", "sha", "ordinal")


HISTORY_SQL = (
    f"{_LOG} select repo_name, ordinal, strftime(committed_at, '%Y-%m-%d %H:%M:%S') as commit_date from "
    f"(select *, row_number() over (partition by repo_name order by ordinal) as n from commits_log_t) c where n <= 100 and {_JAVA}"
)


@query("l2_recent_history", HISTORY_SQL)
def l2(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.history_dates(_commits(spark, folder), derive(spark, folder, "commit_patches"))


@query(
    "l3_older_history",
    f"{_LOG}, marks as (select repo_name, ordinal as mark from commits_log_t where ordinal = 100) "
    f"select c.repo_name, c.sha, c.ordinal from commits_log_t c join marks m on m.repo_name = c.repo_name where c.ordinal > m.mark and {_JAVA}",
)
def l3(spark: SparkSession, folder: str) -> DataFrame:
    log = _commits(spark, folder)
    older = history.older_than(log, log.where("ordinal = 100"))
    return history.touching(older, derive(spark, folder, "commit_patches")).select("repo_name", "sha", "ordinal")


@query(
    "l3_older_history_branching",
    f"""with recursive {_LOG.removeprefix('with ')},
edges as (select repo_name, sha, unnest(parent_shas) as parent, generate_subscripts(parent_shas, 1) as rank from commits_log_t),
reach(repo_name, sha) as (
  select e.repo_name, e.parent from edges e join commits_log_t c on c.repo_name = e.repo_name and c.sha = e.sha where c.ordinal = 100 and e.rank = 1
  union select e.repo_name, e.parent from reach r join edges e on e.repo_name = r.repo_name and e.sha = r.sha)
select c.repo_name, c.sha, c.ordinal from commits_log_t c join reach r on r.repo_name = c.repo_name and r.sha = c.sha where {_JAVA}""",
)
def l3_graph(spark: SparkSession, folder: str) -> DataFrame:
    log = _commits(spark, folder)
    found = settle(history.ancestors(log, log.where("ordinal = 100")), "page")
    return history.touching_few(found, derive(spark, folder, "commit_patches")).select("repo_name", "sha", "ordinal")


@query("l3_older_history_index", CHECKS["l3_older_history_branching"])
def l3_index(spark: SparkSession, folder: str) -> DataFrame:
    """The page after the hundredth commit, by an index that older and newer commits reach one after the other."""
    log, table = _commits(spark, folder), fresh_path(spark, "lineage")
    lineage.extend(spark, table, log.where("ordinal >= 100"))
    lineage.extend(spark, table, log)
    found = settle(lineage.older(spark, table, log, log.where("ordinal = 100")), "page")
    return history.touching_few(found, derive(spark, folder, "commit_patches")).select("repo_name", "sha", "ordinal")


@query(
    "l6_first_active_days",
    f"{_LOG}, ranked as (select *, dense_rank() over (partition by repo_name, date_trunc('month', committed_at) order by cast(committed_at as date)) as d from commits_log_t) "
    "select repo_name, sha, committed_at from ranked c where d <= 7 and len(parent_shas) <= 1 "
    "and not exists (select 1 from stored_commits_t s where s.repo_name = c.repo_name and s.sha = c.sha)",
)
def l6(spark: SparkSession, folder: str) -> DataFrame:
    sampled = history.first_active_days(_commits(spark, folder))
    fresh = history.without_stored(sampled, derive(spark, folder, "stored_commits"))
    return history.without_merges(fresh).select("repo_name", "sha", "committed_at")


@query(
    "j3_without_stored_commits",
    f"{_LOG} select repo_name, sha from commits_log_t c where not exists (select 1 from stored_commits_t s where s.repo_name = c.repo_name and s.sha = c.sha)",
)
def j3(spark: SparkSession, folder: str) -> DataFrame:
    return history.without_stored(_commits(spark, folder), derive(spark, folder, "stored_commits")).select("repo_name", "sha")


@query("j4_commits_touching_type", f"{_LOG} select repo_name, sha from commits_log_t c where {_JAVA}")
def j4(spark: SparkSession, folder: str) -> DataFrame:
    return history.touching(_commits(spark, folder), derive(spark, folder, "commit_patches")).select("repo_name", "sha")


@query(
    "j5_content_lookup",
    _extract_sql("select repo_name, sha, path, temp_filepath, file_content from content", base=sql.PATH_BASE),
)
def j5(spark: SparkSession, folder: str) -> DataFrame:
    return _changed_files(spark, folder, sql.PATH_BASE).select("repo_name", "sha", "path", "temp_filepath", "file_content")


CONTRIBUTION_SQL = "select repo_name, sha, author, committed_at as timestamp, path, temp_filepath, file_content, changed_lines from changed"


def _contribution_rows(extracted: DataFrame) -> DataFrame:
    return extracted.select(
        "repo_name", "sha", "author", "timestamp", "path", "temp_filepath", "file_content",
        joined(F.col("changed_lines")).alias("changed_lines"),
    )


@query("p4_extract_contributions", _extract_sql(CONTRIBUTION_SQL, stored=True))
def p4(spark: SparkSession, folder: str) -> DataFrame:
    return _contribution_rows(_extracted(spark, folder, stored=True))


@query("q1_contributions", _extract_sql(CONTRIBUTION_SQL, limit=COMMIT_LIMIT, stored=True))
def q1(spark: SparkSession, folder: str) -> DataFrame:
    return _contribution_rows(_extracted(spark, folder, limit=COMMIT_LIMIT, stored=True))


STORED_SQL = _extract_sql(
    "select repo_name, sha, author, committed_at as timestamp, temp_filepath, file_content, changed_lines, "
    "row_number() over (partition by repo_name order by ordinal, path) as position from changed"
)


def _stored_rows(stored: DataFrame) -> DataFrame:
    places = ranking.number_within(stored.select("repo_name", "seq"), "repo_name", "seq")
    return ranking.with_position(stored, places, "repo_name", "seq").select(
        "repo_name", "sha", "author", "timestamp", "temp_filepath", "file_content",
        joined(F.col("changed_lines")).alias("changed_lines"), "position",
    )


@query("s7_append_contributions", STORED_SQL)
def s7(spark: SparkSession, folder: str) -> DataFrame:
    place = fresh_path(spark, "contributions")
    inputs = (derive(spark, folder, name) for name in ("commit_files", "commit_patches"))
    jobs.store_contributions(_commits(spark, folder), *inputs, place)
    return _stored_rows(tables.load_table(spark, place))


@query("p4_extract_streaming", _extract_sql(CONTRIBUTION_SQL.replace("path, temp", "temp"), stored=False))
def p4_stream(spark: SparkSession, folder: str) -> DataFrame:
    log_place, place = fresh_path(spark, "log"), fresh_path(spark, "contributions")
    log = _commits(spark, folder)
    # As many files as parts: batches grow with the log, and not their number.
    short = log.withColumn("sha", values.packed(F.col("sha"))).withColumn("parent_shas", F.transform("parent_shas", values.packed))
    dealt = short.repartition(streams.PARTS, values.unpacked(F.col("sha")))
    dealt = dealt.withColumn("sha", values.unpacked(F.col("sha"))).withColumn("parent_shas", F.transform("parent_shas", values.unpacked))
    dealt.select(*log.columns).write.option("compression", CODEC).parquet(log_place)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 3).parquet(log_place)
    lasting = []
    for name in ("commit_files", "commit_patches"):
        # Partitioned by the commits' parts, so that a batch reads those of its commits only.
        # A task writes a file per part: they are few, and no text is moved for that.
        kept = fresh_path(spark, name)
        tables.save_table(streams.by_commit(derive(spark, folder, name)), kept, partition=streams.PART, rebalance=False)
        lasting.append(tables.load_table(spark, kept))
    streams.stream_contributions(stream, *lasting, place, fresh_path(spark, "stream-state"))
    stored = tables.load_table(spark, place)
    return stored.select(
        "repo_name", "sha", "author", "timestamp", "temp_filepath", "file_content",
        joined(F.col("changed_lines")).alias("changed_lines"),
    )


# --- catalogue ------------------------------------------------------------------


TIMES = ("created_at", "updated_at", "analysis_start_time", "analysis_end_time")
REPO_COLUMNS = (
    "name", "url", "description", "comments", "created_at", "updated_at", "analysis_status",
    "analysis_start_time", "analysis_end_time", "analysis_progress", "analysis_error_message",
)
UPSERT_SQL = f"""{sql.with_tables('repositories', 'repository_updates')},
last as (select * from repository_updates_t qualify row_number() over (partition by name order by seq desc) = 1)
select coalesce(r.name, u.name) as name,
  case when u.name is not null then coalesce(u.url, '') else r.url end as url,
  case when u.name is not null then coalesce(u.description, '') else r.description end as description,
  case when u.name is not null then coalesce(u.comments, '') else r.comments end as comments,
  case when r.name is null then timestamp '{NOW}' else r.created_at end as created_at,
  case when u.name is not null then timestamp '{NOW}' else r.updated_at end as updated_at,
  {', '.join('r.' + c for c in REPO_COLUMNS[6:])}
from repositories_t r full outer join last u on r.name = u.name"""


def _upsert(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.upsert_repositories(derive(spark, folder, "repositories"), derive(spark, folder, "repository_updates"), now())


def _versioned(spark: SparkSession, folder: str, name: str) -> str:
    """A table's first version, as an earlier job would have left it."""
    place = fresh_path(spark, f"versions-{name}")
    catalogue = name == "repositories"
    manifest.create(spark, place, derive(spark, folder, name), "name" if catalogue else "repo_name", latest=catalogue)
    return place


@query("m1_upsert_job", UPSERT_SQL)
def m1_job(spark: SparkSession, folder: str) -> DataFrame:
    place = _versioned(spark, folder, "repositories")
    jobs.edit_repositories(spark, place, derive(spark, folder, "repository_updates"), now())
    return manifest.read(spark, place)


query("m1_upsert_repositories", UPSERT_SQL)(_upsert)
query("q2_create_or_edit_repository", UPSERT_SQL)(_upsert)

DELETE_SQL = f"""{sql.with_tables('repositories', 'contributions', 'analysis_results', 'deleted_names')}
select 'repositories' as kept_in, name as repo_name, count(*) as kept from repositories_t where name not in (select name from deleted_names_t) group by all
union all select 'contributions', repo_name, count(*) from contributions_t where repo_name not in (select name from deleted_names_t) group by all
union all select 'analysis_results', repo_name, count(*) from analysis_results_t where repo_name not in (select name from deleted_names_t) group by all"""


def _delete(spark: SparkSession, folder: str) -> DataFrame:
    names = ("repositories", "contributions", "analysis_results")
    return _kept(names, catalog.delete_repositories(derive(spark, folder, "deleted_names"), *[derive(spark, folder, n) for n in names]))


def _kept(names: tuple[str, ...], left: Sequence[DataFrame]) -> DataFrame:
    out = None
    for name, frame in zip(names, left, strict=True):
        repo = "name" if name == "repositories" else "repo_name"
        kept = frame.groupBy(F.col(repo).alias("repo_name")).agg(F.count(F.lit(1)).alias("kept"))
        kept = kept.select(F.lit(name).alias("kept_in"), "repo_name", "kept")
        out = kept if out is None else out.unionByName(kept)
    return out


query("m2_delete_repositories", DELETE_SQL)(_delete)


@query("q6_delete_repository", DELETE_SQL.replace("(select name from deleted_names_t)", f"('{REPO}')"))
def q6(spark: SparkSession, folder: str) -> DataFrame:
    """One repository removed from all three tables, version to version."""
    names = ("repositories", "contributions", "analysis_results")
    places = [_versioned(spark, folder, name) for name in names]
    jobs.remove_repositories(spark, *places, spark.range(1).select(F.lit(REPO).alias("name")))
    return _kept(names, [manifest.read(spark, place) for place in places])



STATUS_CTE = f"""{sql.with_tables('repositories', 'status_log')},
last as (select * from status_log_t qualify row_number() over (partition by repo_name order by seq desc) = 1),
merged as (select r.name, r.url,
  case when l.repo_name is not null then l.status else r.analysis_status end as status,
  case when l.repo_name is not null then l.start_time else r.analysis_start_time end as start_time,
  case when l.repo_name is not null then l.end_time else r.analysis_end_time end as end_time,
  case when l.repo_name is not null then l.progress else r.analysis_progress end as progress,
  case when l.repo_name is not null then l.error_message else r.analysis_error_message end as error_message
from repositories_t r left join last l on r.name = l.repo_name)"""


@query(
    "m3_apply_status",
    f"{STATUS_CTE} select name, url, status as analysis_status, start_time as analysis_start_time, end_time as analysis_end_time, "
    "progress as analysis_progress, error_message as analysis_error_message from merged",
)
def m3(spark: SparkSession, folder: str) -> DataFrame:
    merged = catalog.apply_status(derive(spark, folder, "repositories"), derive(spark, folder, "status_log"))
    return merged.drop("description", "comments", "created_at", "updated_at")


@query("m2_delete_job", DELETE_SQL)
def m2_job(spark: SparkSession, folder: str) -> DataFrame:
    names = ("repositories", "contributions", "analysis_results")
    places = [_versioned(spark, folder, name) for name in names]
    jobs.remove_repositories(spark, *places, derive(spark, folder, "deleted_names"))
    return _kept(names, [manifest.read(spark, place) for place in places])


@query("m3_status_job", CHECKS["m3_apply_status"])
def m3_job(spark: SparkSession, folder: str) -> DataFrame:
    place = _versioned(spark, folder, "repositories")
    jobs.record_status(spark, place, derive(spark, folder, "status_log"))
    return manifest.read(spark, place).drop("description", "comments", "created_at", "updated_at")


_STATUS_ROWS = f"name, status, {sql.iso_or_null('start_time')} as start_time, {sql.iso_or_null('end_time')} as end_time, progress, error_message"


@query("m4_analysis_status", f"{STATUS_CTE} select {_STATUS_ROWS} from merged")
def m4(spark: SparkSession, folder: str) -> DataFrame:
    merged = catalog.apply_status(derive(spark, folder, "repositories"), derive(spark, folder, "status_log"))
    return catalog.analysis_status(merged)


@query("q9_analysis_status", f"{STATUS_CTE} select {_STATUS_ROWS} from merged where name = '{REPO}'")
def q9(spark: SparkSession, folder: str) -> DataFrame:
    merged = catalog.apply_status(derive(spark, folder, "repositories"), derive(spark, folder, "status_log"))
    return catalog.analysis_status(merged, REPO)


LIST_SQL = (
    f"{sql.with_tables('repositories')} select "
    + ", ".join(f"{sql.iso_or_null(c)} as {c}" if c in TIMES else c for c in REPO_COLUMNS)
    + " from repositories_t where url like 'https://github.com/apache/%'"
)


def _list(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.list_repositories(derive(spark, folder, "repositories"))


query("s5_repository_catalogue", LIST_SQL)(_list)
query("q7_list_repositories", LIST_SQL)(_list)


@query(
    "s11_create_tables",
    f"{sql.with_tables('repositories', 'contributions', 'analysis_results')} "
    "select 'repositories' as table_name, count(*) as stored from repositories_t "
    "union all select 'contributions', count(*) from contributions_t union all select 'analysis_results', count(*) from analysis_results_t",
)
def s11(spark: SparkSession, folder: str) -> DataFrame:
    place = fresh_path(spark, "catalogue")
    database = "codelabels_" + place.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{place}'")
    out = None
    for name in create_tables(spark, database):
        target = spark.table(f"{database}.{name}")
        derive(spark, folder, name).select(*target.columns).hint("rebalance", *target.columns[-1:]).write.insertInto(f"{database}.{name}")
        stored = spark.table(f"{database}.{name}").agg(F.count(F.lit(1)).alias("stored"))
        stored = stored.select(F.lit(name).alias("table_name"), "stored")
        out = stored if out is None else out.unionByName(stored)
    return out


# --- scans and sinks over results -----------------------------------------------


@query(
    "s2_contributions_of_repository",
    f"{sql.with_tables('contributions')} select sha, author, file_content, array_to_string(changed_lines, ',') as changed_lines, temp_filepath, timestamp from contributions_t where repo_name = '{REPO}'",
)
def s2(spark: SparkSession, folder: str) -> DataFrame:
    rows = derive(spark, folder, "contributions").where(F.col("repo_name") == REPO)
    return rows.select("sha", "author", "file_content", joined(F.col("changed_lines")).alias("changed_lines"), "temp_filepath", "timestamp")


_RESULTS = sql.with_tables("analysis_results", "repositories", "contributions")
_RESULT_ROW = f"filename, author, {sql.iso_or_null('timestamp')} as timestamp, sha, detected as detected_kus, elapsed_time"
RESULTS_OF_SQL = f"{_RESULTS} select {_RESULT_ROW} from analysis_results_t where repo_name = '{REPO}'"


def _encoded(rows: DataFrame, column: str = "detected_kus") -> DataFrame:
    return rows.withColumn(column, values.encode_map(F.col(column)))


def _results_of(spark: SparkSession, folder: str) -> DataFrame:
    return _encoded(results.results_of(derive(spark, folder, "analysis_results"), REPO))


query("s3_results_of_repository", RESULTS_OF_SQL)(_results_of)
query("q10_results", RESULTS_OF_SQL)(_results_of)


@query("s4_results_of_sha", f"{_RESULTS} select {_RESULT_ROW} from analysis_results_t where sha = md5('{REPO}/1')")
def s4(spark: SparkSession, folder: str) -> DataFrame:
    from hashlib import md5

    sha = md5(f"{REPO}/1".encode()).hexdigest()
    return _encoded(results.results_of_sha(derive(spark, folder, "analysis_results"), sha))


FEED_SQL = f"{_RESULTS} select detected as kus, author from analysis_results_t"


def _feed(spark: SparkSession, folder: str) -> DataFrame:
    return _encoded(results.label_feed(derive(spark, folder, "analysis_results")), "kus")


query("s6_label_feed", FEED_SQL)(_feed)
query("q3_label_feed", FEED_SQL)(_feed)


@query(
    "s8_append_results",
    f"{_RESULTS} select repo_name, filename, author, timestamp, sha, detected, elapsed_time from analysis_results_t",
)
def s8(spark: SparkSession, folder: str) -> DataFrame:
    place = fresh_path(spark, "results")
    tables.append_results(derive(spark, folder, "analysis_results"), place)
    return _encoded(tables.load_table(spark, place).drop("seq"), "detected")


WIDE_SQL = ", ".join(f"cast(json_extract(detected, '$.{k}') as int) as {k}" for k in LABELS)


@query(
    "s9_wide_export",
    f"{_RESULTS} select filename, author, timestamp, sha, {WIDE_SQL} from analysis_results_t",
)
def s9(spark: SparkSession, folder: str) -> DataFrame:
    place = fresh_path(spark, "export")
    stored = derive(spark, folder, "analysis_results")
    files.export_csv(stored, place, LABELS)
    schema = results.wide_labels(stored, LABELS).schema
    times = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
    return spark.read.schema(schema).option("header", True).option("timestampNTZFormat", times).csv(place)


ALL_SQL = (
    f"{_RESULTS} select a.filename, a.author, coalesce({sql.iso_or_null('a.timestamp')}, 'None') as timestamp, a.sha, a.detected as detected_kus, a.elapsed_time "
    "from analysis_results_t a join repositories_t r on a.repo_name = r.name where r.url like 'https://github.com/apache/%'"
)


def _all_results(spark: SparkSession, folder: str) -> DataFrame:
    return _encoded(results.all_results(derive(spark, folder, "analysis_results"), derive(spark, folder, "repositories")))


query("j1_results_of_catalogue", ALL_SQL)(_all_results)
query("q11_all_results", ALL_SQL)(_all_results)


@query(
    "j2_without_analysed",
    f"{_RESULTS} select seq, repo_name, sha from contributions_t where sha not in (select sha from analysis_results_t)",
)
def j2(spark: SparkSession, folder: str) -> DataFrame:
    rows = derive(spark, folder, "contributions").select("seq", "repo_name", "sha")
    known = results.analysed_keys(derive(spark, folder, "analysis_results"))
    return results.without_analysed(rows, known).select("seq", "repo_name", "sha")


@query(
    "l4_result_times",
    f"{_RESULTS} select distinct repo_name, {sql.iso_or_null('timestamp')} as timestamp from analysis_results_t where timestamp is not null",
)
def l4(spark: SparkSession, folder: str) -> DataFrame:
    return results.result_times(derive(spark, folder, "analysis_results"))


@query(
    "q4_result_times",
    f"{_RESULTS} select distinct {sql.iso_or_null('timestamp')} as timestamp from analysis_results_t where timestamp is not null and repo_name = '{REPO}'",
)
def q4(spark: SparkSession, folder: str) -> DataFrame:
    return results.result_times(derive(spark, folder, "analysis_results"), REPO)


@query(
    "l5_last_per_stem",
    f"{_RESULTS} select repo_name, {sql.stem('temp_filepath')} as filename, max(seq) as seq, min(seq) as run_order from contributions_t group by all",
)
def l5(spark: SparkSession, folder: str) -> DataFrame:
    rows = derive(spark, folder, "contributions").select("seq", "repo_name", paths.stem(F.col("temp_filepath")).alias("filename"))
    return results.last_per_stem(rows)


@query("q5_history_dates", f"select * from ({HISTORY_SQL}) h where repo_name = '{REPO}'")
def q5(spark: SparkSession, folder: str) -> DataFrame:
    """The history page of the repository that an address names."""
    wanted = F.col("repo_name") == jobs.repository_of(f"https://github.com/apache/{REPO}.git")
    return jobs.history_dates(_commits(spark, folder).where(wanted), derive(spark, folder, "commit_patches"))


# --- analysis runs ---------------------------------------------------------------


def _analysis(spark: SparkSession, folder: str, grid: str = "35_25", scorer: Callable | None = None) -> DataFrame:
    return jobs.analyze(
        derive(spark, folder, "contributions"), derive(spark, folder, "analysis_results"), scorer, GRIDS[grid]
    )


def _pending(spark: SparkSession, folder: str) -> DataFrame:
    return runs.pending_files(derive(spark, folder, "contributions"), derive(spark, folder, "analysis_results"))


_PENDING_SQL = f"{sql.with_tables('contributions', 'analysis_results')},\n{sql.pending_cte()}"


@query("a4_files_in_run", f"{_PENDING_SQL} select repo_name, count(*) as files from pending group by repo_name")
def a4(spark: SparkSession, folder: str) -> DataFrame:
    return _pending(spark, folder).groupBy("repo_name").agg(F.count(F.lit(1)).alias("files"))


@query(
    "a5_running_progress",
    f"{_PENDING_SQL} select repo_name, filename, done, total, cast(trunc(done / total * 100) as int) as progress from pending",
)
def a5(spark: SparkSession, folder: str) -> DataFrame:
    return runs.with_progress(_pending(spark, folder)).select("repo_name", "filename", "done", "total", "progress")


# A model that cannot read one word: the window that holds it fails, and with it the file and its run.
UNREADABLE = "worthless"
FAILING_SQL = f"""{_PENDING_SQL},
{sql.windows_cte('lined', 'seq', *GRIDS['35_25'])},
broken as (select distinct seq from windows where contains({sql.normalise('code')}, '{UNREADABLE}')),
marked as (select p.*, case when b.seq is not null then 'cannot read {UNREADABLE}' end as error from pending p left join broken b on b.seq = p.seq),
cut as (select *, min(case when error is not null then run_order end) over (partition by repo_name) as failed_at from marked),
kept as (select * from cut where failed_at is null or run_order < failed_at),
asked as (select name as repo_name, exists (select 1 from contributions_t c where c.repo_name = r.name) as has_commits from repositories_t r),
finished as (
  select a.repo_name, a.has_commits, coalesce(max(c.total), 0) as total, min(case when c.error is not null then c.done end) as failed_done,
    min_by(c.error, c.run_order) filter (where c.error is not null) as error
  from asked a left join cut c on c.repo_name = a.repo_name group by a.repo_name, a.has_commits)"""
FAILING_SQL = FAILING_SQL.replace(sql.with_tables("contributions", "analysis_results"), sql.with_tables("contributions", "analysis_results", "repositories"))


def failing_model() -> Callable[[], Callable]:
    def load():
        score = scoring.rule_model()()

        def predict(texts):
            if any(UNREADABLE in text_ for text_ in texts):
                raise ValueError(f"cannot read {UNREADABLE}")
            return score(texts)

        return predict

    return load


def _run(spark: SparkSession, folder: str, scorer: Callable | None = None, **options) -> jobs.Run:
    """The whole analysis of all catalogued repositories."""
    return jobs.run_analysis(
        derive(spark, folder, "contributions"), derive(spark, folder, "analysis_results"),
        derive(spark, folder, "repositories").select(F.col("name").alias("repo_name")), repo_url(), scorer, GRIDS["35_25"], clock=now, **options,
    )


def _failing(spark: SparkSession, folder: str) -> jobs.Run:
    return _run(spark, folder, scoring.ArrowScorer(failing_model()), first_seq=1)


@query("a6_first_error_cutoff", f"{FAILING_SQL} select repo_name, filename, seq from kept")
def a6(spark: SparkSession, folder: str) -> DataFrame:
    return _failing(spark, folder).results.select("repo_name", "filename", "seq")


STATUS_SQL = f"""select repo_name, cast(1 as bigint) as seq, 'in-progress' as status, timestamp '{NOW}' as start_time, cast(null as timestamp) as end_time, cast(0 as int) as progress, cast(null as varchar) as error_message from finished where has_commits
union all select repo_name, 1 + done, 'in-progress', timestamp '{NOW}', null, cast(trunc(done / total * 100) as int), null from kept
union all select repo_name, 2 + total, case when error is null then 'completed' else 'error' end, timestamp '{NOW}', timestamp '{NOW}', case when error is null then 100 end, error from finished where has_commits"""


@query("a6_run_status", f"{FAILING_SQL} {STATUS_SQL}")
def a6_status(spark: SparkSession, folder: str) -> DataFrame:
    return _failing(spark, folder).statuses


@query("p1_run_over_batches", f"{FAILING_SQL}, statuses as ({STATUS_SQL}) select repo_name, seq - 1 as seq, status, progress, error_message from statuses")
def p1_over_batches(spark: SparkSession, folder: str) -> DataFrame:
    """One run per repository over many micro-batches: it rises, and ends once, at its last or first failing file."""
    contributions = derive(spark, folder, "contributions")
    requested = derive(spark, folder, "repositories").select(F.col("name").alias("repo_name"))
    requests, planned = followed.plan_run(contributions, derive(spark, folder, "analysis_results"), requested)
    source, scores, asked, entries = (fresh_path(spark, x) for x in ("arriving", "scores", "asked", "entries"))
    # Files of so many rows, four at least, in four batches: no task writes a quarter of all texts.
    parts = max(4, -(-contributions.count() // 10_000))
    contributions.repartitionByRange(parts, "seq").write.parquet(source)
    requests.write.parquet(asked)
    arriving = spark.readStream.schema(contributions.schema).option("maxFilesPerTrigger", streams.per_batch(parts, least=1, batches=4)).parquet(source)
    followed.stream_scores(arriving, planned, scores, fresh_path(spark, "scores-state"), scoring.ArrowScorer(failing_model()), GRIDS["35_25"])
    known = spark.read.parquet(scores)
    scored = spark.readStream.schema(known.schema).option("maxFilesPerTrigger", streams.per_batch(len(known.inputFiles()), least=4)).parquet(scores)
    steps = followed.steps_of(spark.readStream.schema(requests.schema).parquet(asked), scored)
    followed.stream_runs(steps, entries, fresh_path(spark, "runs-state"))
    return spark.read.schema(followed.ENTRY).parquet(entries).drop("file")


RUN_ROW = f"repo_name, filename, author, {sql.iso_or_null('timestamp')} as timestamp, sha, detected, progress"


def _run_rows(scored: DataFrame) -> DataFrame:
    saved = jobs.saved_results(scored)
    return saved.select(
        "repo_name", "filename", "author", values.iso(F.col("timestamp")).alias("timestamp"), "sha",
        values.encode_map(F.col("detected")).alias("detected"), "progress",
    )


def _run_queries(grid: str) -> None:
    @query(f"p1_analysis_run_{grid}", sql.analysis_sql(*GRIDS[grid], f"select {RUN_ROW} from saved"))
    def p1(spark: SparkSession, folder: str) -> DataFrame:
        return _run_rows(_analysis(spark, folder, grid))


for _grid in GRIDS:
    _run_queries(_grid)


STREAM_SQL = sql.analysis_sql(*GRIDS["35_25"], f"select {RUN_ROW.replace(', progress', '')} from saved")


def _streamed(spark: SparkSession, folder: str) -> str:
    """Where a stream over the contributions has put its results."""
    source, place = fresh_path(spark, "contributions"), fresh_path(spark, "results")
    contributions = derive(spark, folder, "contributions")
    # Files of about equal size: commits and colliding names spread over many batches.
    contributions.repartition("seq").write.option("maxRecordsPerFile", 10_000).parquet(source)
    analysed = fresh_path(spark, "analysed")
    tables.append_results(derive(spark, folder, "analysis_results"), analysed)
    some = streams.per_batch(len(spark.read.schema(contributions.schema).parquet(source).inputFiles()), least=3)
    stream = spark.readStream.schema(contributions.schema).option("maxFilesPerTrigger", some).parquet(source)
    streams.stream_analysis(stream, place, fresh_path(spark, "stream-state"), earlier=analysed)
    return place


def _stream_rows(stored: DataFrame) -> DataFrame:
    return stored.select(
        "repo_name", "filename", "author", values.iso(F.col("timestamp")).alias("timestamp"), "sha",
        values.encode_map(F.col("detected")).alias("detected"),
    )


@query("p1_analysis_streaming", STREAM_SQL)
def p1_stream(spark: SparkSession, folder: str) -> DataFrame:
    return _stream_rows(streams.stream_results(spark, _streamed(spark, folder)))


@query("p1_analysis_streaming_merged", STREAM_SQL)
def p1_stream_merged(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows after the stream's closed batches have been merged."""
    place = _streamed(spark, folder)
    streams.merge_results(spark, place)
    return _stream_rows(streams.stream_results(spark, place))


_URL = "concat('https://github.com/apache/', repo_name)"
EVENT_SQL = sql.analysis_sql(
    *GRIDS["35_25"],
    f"""select repo_name, done as event_order, concat(chr(123), '"progress":', progress, ',"file_data":', chr(123),
  '"filename":"', filename, '","author":"', author, '","timestamp":"', {sql.iso('timestamp')}, '","sha":"', sha, '","detected_kus":', detected,
  ',"elapsed_time":0.0,"repoUrl":"', {_URL}, '"', chr(125), ',"repoUrl":"', {_URL}, '"', chr(125)) as event from saved
union all select repo_name, max(total) + 1, concat(chr(123), '"progress":100,"message":"Analysis completed","repoUrl":"', {_URL}, '"', chr(125)) from saved group by repo_name""",
)


def repo_url() -> Column:
    return F.concat(F.lit("https://github.com/apache/"), F.col("repo_name"))


@query("p2_progress_events", EVENT_SQL)
def p2(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.run_events(settle(_analysis(spark, folder), "scored"), repo_url())


@query(
    "p2_error_events",
    f"""{FAILING_SQL} select repo_name, coalesce(failed_done, total + 1) as event_order, concat(chr(123), '"error":"', coalesce(error, '{NO_COMMITS}'), '","repoUrl":"', {_URL}, '"', chr(125)) as event
from finished where error is not null or not has_commits""",
)
def p2_errors(spark: SparkSession, folder: str) -> DataFrame:
    events = _failing(spark, folder).events
    return events.where(F.get_json_object("event", "$.error").isNotNull())


@query(
    "p3_elapsed_seconds",
    f"{_PENDING_SQL} select repo_name, filename, true as measured from pending",
)
def p3(spark: SparkSession, folder: str) -> DataFrame:
    scored = _analysis(spark, folder, scorer=scoring.ArrowScorer(scoring.rule_model()))
    return scored.select("repo_name", "filename", (F.col("elapsed_time") > 0).alias("measured"))


_FILE_EVENT = f"""concat(chr(123), '"progress":', progress, ',"file_data":', chr(123),
  '"filename":"', filename, '","author":"', author, '","timestamp":"', {sql.iso('timestamp')}, '","sha":"', sha, '","detected_kus":', detected,
  ',"elapsed_time":0.0,"repoUrl":"', {_URL}, '"', chr(125), ',"repoUrl":"', {_URL}, '"', chr(125))"""
Q8_SQL = sql.analysis_sql(
    *GRIDS["35_25"],
    f"""select 'result' as kind, repo_name, cast(done as bigint) as place, concat_ws('|', filename, author, {sql.iso_or_null('timestamp')}, sha, detected, cast(progress as varchar)) as body from saved
union all select 'status', repo_name, seq, concat_ws('|', status, {sql.iso_or_null('start_time')}, {sql.iso_or_null('end_time')}, cast(progress as varchar), error_message) from statuses
union all select 'event', repo_name, done, {_FILE_EVENT} from saved
union all select 'event', repo_name, total + 1, case when has_commits then concat(chr(123), '"progress":100,"message":"Analysis completed","repoUrl":"', {_URL}, '"', chr(125))
  else concat(chr(123), '"error":"{NO_COMMITS}","repoUrl":"', {_URL}, '"', chr(125)) end from finished""",
).replace(sql.with_tables("contributions", "analysis_results"), sql.with_tables("contributions", "analysis_results", "repositories"))
Q8_SQL = Q8_SQL.replace(
    "\nselect 'result' as kind",
    f""",
asked as (select name as repo_name, exists (select 1 from contributions_t c where c.repo_name = r.name) as has_commits from repositories_t r),
finished as (
  select a.repo_name, a.has_commits, coalesce(max(s.total), 0) as total, cast(null as varchar) as error
  from asked a left join saved s on s.repo_name = a.repo_name group by a.repo_name, a.has_commits),
kept as (select * from saved where repo_name in (select repo_name from asked)),
statuses as ({STATUS_SQL})
select 'result' as kind""",
)


@query("q8_analyze", Q8_SQL)
def q8(spark: SparkSession, folder: str) -> DataFrame:
    """All that an analysis leaves: stored results, status-log entries and events."""
    place, log = fresh_path(spark, "results"), fresh_path(spark, "status-log")
    run = _run(spark, folder, first_seq=1, opened=lambda rows: rows.write.parquet(log))
    tables.append_results(run.results, place)
    run.later_statuses.write.mode("append").parquet(log)
    stored = tables.load_table(spark, place, ANALYSIS_RESULTS)
    done = run.results.select("seq", "repo_name", "done", "progress")
    saved = stored.join(done, ["seq", "repo_name"]).select(
        F.lit("result").alias("kind"), "repo_name", F.col("done").cast("bigint").alias("place"),
        F.concat_ws("|", "filename", "author", values.iso(F.col("timestamp")), "sha", values.encode_map(F.col("detected")), F.col("progress").cast("string")).alias("body"),
    )
    statuses = tables.load_table(spark, log, STATUS_LOG).select(
        F.lit("status").alias("kind"), "repo_name", F.col("seq").alias("place"),
        F.concat_ws("|", "status", values.iso(F.col("start_time")), values.iso(F.col("end_time")), F.col("progress").cast("string"), "error_message").alias("body"),
    )
    events = run.events.select(F.lit("event").alias("kind"), "repo_name", F.col("event_order").alias("place"), F.col("event").alias("body"))
    return saved.unionByName(statuses).unionByName(events)


# --- folders of files ---------------------------------------------------------------


def _document_folder(spark: SparkSession, folder: str) -> str:
    """Each document as a text file of its own, in a folder named after its number."""
    place = fresh_path(spark, "sources")
    files.write_directory(derive(spark, folder, "contributions"), place, "seq", "file_content", spread=256)
    return f"{place}/*/seq=*"


def _numbered(found: DataFrame) -> DataFrame:
    return found.withColumn("seq", F.regexp_extract("filename", "seq=([0-9]+)/", 1).cast("bigint"))


FILE_SQL = "replace(replace(concat(file_content, chr(10)), concat(chr(13), chr(10)), chr(10)), chr(13), chr(10))"


@query(
    "s1_directory_scan",
    f"{sql.with_tables('contributions')} select seq, {FILE_SQL} as file_content, true as named, "
    "cast(null as varchar) as author, cast(null as timestamp) as timestamp, cast(null as varchar) as sha from contributions_t",
)
def s1(spark: SparkSession, folder: str) -> DataFrame:
    found = _numbered(files.read_directory(spark, _document_folder(spark, folder), "txt", folders=1))
    named = F.col("filename").rlike(r"^seq=[0-9]+/[^/]+\.txt$")
    return found.select("seq", "file_content", named.alias("named"), "author", "timestamp", "sha")


Q12_SQL = f"""{sql.with_tables('contributions')},
lined as (select seq, {sql.significant(sql.clean(FILE_SQL))} as lines from contributions_t),
{sql.windows_cte('lined', 'seq', 35, 35, 1, 25)},
{sql.fired_cte('seq')}
select l.seq, {', '.join(f"cast(max(case when d.k = {(int(k[1:]) - 1) % 27 + 1} then 1 else 0 end) as int) as {k}" for k in CLASSIFIER_LABELS)}
from lined l left join fired d on d.seq = l.seq group by l.seq"""


@query(
    "q12_score_directory_trained",
    f"{sql.with_tables('contributions')} select seq, model, true as agrees from contributions_t {_EACH_MODEL}",
)
def q12_trained(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of sources scored by trained models of a registry and exported; the export beside decisions recomputed by joins."""
    found = settle(files.read_directory(spark, _document_folder(spark, folder), "txt", folders=1), "directory")
    model, place = _stacked(spark, folder), fresh_path(spark, "export")
    marked = _marked(windows.line_windows(windows.file_lines(found.select("filename", "file_content"))), "filename")
    per_model = results.any_window_per_model(stacked.classify(marked, model), ["filename"])
    files.export_csv(jobs.label_table(per_model, found, list(model.labels)), place, model.labels)
    wide = spark.read.option("header", True).schema(f"filename string, author string, timestamp string, sha string, {', '.join(f'{k} int' for k in model.labels)}").csv(place)
    shown = wide.select("filename", F.inline(F.array(*[F.struct(F.lit(k).alias("model"), (F.col(k) == 1).alias("detected")) for k in model.labels])))
    joined_ = _numbered(shown).join(_recomputed(marked, model, "filename"), ["filename", "model"])
    return joined_.select("seq", "model", F.col("detected").eqNullSafe(F.col("again")).alias("agrees"))


@query("q12_score_directory", Q12_SQL)
def q12(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of sources scored by every label's model, exported as wide CSV and read back."""
    found = settle(files.read_directory(spark, _document_folder(spark, folder), "txt", folders=1), "directory")
    registry = spark.createDataFrame([(name,) for name in CLASSIFIER_LABELS], "name string")
    names = [row["name"] for row in scoring.allowed(registry).collect()]
    per_model = jobs.score_per_label(found, scoring.initial_models(names), prepare=scoring.token_initials)
    place = fresh_path(spark, "export")
    files.export_csv(jobs.label_table(per_model, found, CLASSIFIER_LABELS), place)
    wide = spark.read.option("header", True).schema(f"filename string, author string, timestamp string, sha string, {', '.join(f'{k} int' for k in CLASSIFIER_LABELS)}").csv(place)
    return _numbered(wide).select("seq", *CLASSIFIER_LABELS)
