"""Research runs: search candidates, source catalogs, budgets, leases, failures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.dates import iso, parse_date
from loomline.functions.text import bounded_text
from loomline.functions.urls import normal_forms
from loomline.functions.vocabulary import DEFAULT_GOAL, EXCERPT_MAX, GOAL_MAX, LEASE_MARGIN_MS, PROMPT_SOURCES, PUBLISHER_MAX, RETRY_MARGIN_MS, SEARCH_DEFAULT, SEARCH_MAX, TITLE_MAX, TOOL_ERRORS


def search_candidates(articles: DataFrame, excluded: DataFrame, limit: int = SEARCH_DEFAULT, *, query_col: str = "query_id", pos_col: str = "pos", truncated_col: str | None = None) -> DataFrame:
    """One row per query: candidates (array, in order), rejected_count, truncated.

    articles: query, position, url, title, publisher, published, summary.
    excluded: query, canonical_url. In order of position, a row without a URL, with
    one that isn't accepted, excluded or had before is a reject; rows after the
    candidate that fills the limit aren't looked at.
    """
    if not 1 <= limit <= SEARCH_MAX:
        raise ValueError(f"a search limit is from 1 to {SEARCH_MAX}")
    given = F.coalesce(F.col(truncated_col), F.lit(False)) if truncated_col else F.lit(False)
    rows = articles.select(F.col(query_col).alias("q"), F.col(pos_col).alias("pos"), "title", "publisher", "published", "summary", normal_forms(F.col("url")).alias("u"), given.alias("given"))
    out = excluded.select(F.col(query_col).alias("q"), F.col("canonical_url").alias("x"), F.lit(True).alias("out")).distinct()
    rows = rows.join(out, (rows["q"] == out["q"]) & (F.col("u.canonical_url") == out["x"]), "left").select(rows["*"], "out")
    usable = F.col("u.canonical_url").isNotNull() & F.col("out").isNull()
    first = F.row_number().over(Window.partitionBy("q", "u.canonical_url", "usable").orderBy("pos")) == 1
    rows = rows.withColumn("usable", usable).withColumn("fresh", F.col("usable") & first)
    before = Window.partitionBy("q").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("had", F.coalesce(F.count_if("fresh").over(before), F.lit(0)))
    looked = F.col("had") < limit
    cell = F.struct("pos", F.col("u.url").alias("url"), F.col("u.canonical_url").alias("canonical_url"), bounded_text(F.col("title"), TITLE_MAX).alias("title"), bounded_text(F.col("publisher"), PUBLISHER_MAX).alias("publisher_name"), iso(parse_date(F.col("published"))).alias("published_at"), bounded_text(F.col("summary"), EXCERPT_MAX).alias("excerpt"))
    return rows.groupBy("q").agg(F.array_sort(F.collect_list(F.when(F.col("fresh") & looked, cell))).alias("candidates"), F.count_if(looked & ~F.col("fresh")).alias("rejected_count"), (F.bool_or("given") | (F.count("*") > limit)).alias("truncated")).withColumnRenamed("q", query_col)


def register_sources(observed: DataFrame, catalog: DataFrame, *, run_col: str = "run_id") -> DataFrame:
    """(run, pos, canonical_url, source_id, reused): a source the catalog has by its canonical URL is reused, another gets tool_<call>_<index>."""
    known = catalog.groupBy(run_col, "canonical_url").agg(F.min("source_id").alias("known"))
    new = F.concat(F.lit("tool_"), F.col("call_id").cast("string"), F.lit("_"), F.col("pos").cast("string"))
    return observed.join(known, [run_col, "canonical_url"], "left").select(run_col, "pos", "canonical_url", F.coalesce("known", new).alias("source_id"), F.col("known").isNotNull().alias("reused"))


def registration_matches(candidates: DataFrame, registered: DataFrame, *, run_col: str = "run_id") -> DataFrame:
    """(run, matches): equal lengths, equal url and canonical_url at each position, distinct source ids."""
    a = candidates.select(run_col, "pos", F.struct("url", "canonical_url").alias("a"))
    b = registered.select(run_col, "pos", F.struct("url", "canonical_url").alias("b"), "source_id")
    both = a.join(b, [run_col, "pos"], "full")
    return both.groupBy(run_col).agg((F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))) & (F.count_distinct("source_id") == F.count("source_id"))).alias("matches"))


def unseen(rows: DataFrame, known: DataFrame, key: str = "canonical_url") -> DataFrame:
    """Rows whose key isn't known."""
    return rows.join(known.select(key), key, "left_anti")


def discovery_failure(origin: Column, kind: Column, status: Column) -> Column:
    """struct<retryable,reason> of a discovery error. origin: gnews, rss, payload, unsupported or anything else."""
    provider = origin.isin("gnews", "rss")
    invalid = ((origin == "gnews") & kind.isin("invalid-json", "invalid-response")) | ((origin == "rss") & kind.isin("invalid-xml", "invalid-feed"))
    again = status.isNull() | status.isin(408, 429) | (status >= 500)
    result = lambda retry, reason: F.struct(F.lit(retry).alias("retryable"), F.lit(reason).alias("reason"))
    return (
        F.when(provider & (kind == "timeout"), result(True, "source-timeout"))
        .when(provider & (kind == "network"), result(True, "source-network"))
        .when(provider & (kind == "http") & again, result(True, "source-http-retryable"))
        .when(provider & (kind == "http"), result(False, "source-http-terminal"))
        .when(provider & invalid, result(False, "source-invalid-payload"))
        .when(origin == "payload", result(False, "invalid-job-payload"))
        .when(origin == "unsupported", result(False, "unsupported-source"))
        .otherwise(result(True, "unknown"))
    )


def _tool_error(code: Column) -> Column:
    retry = F.lit(False)
    for name, may in TOOL_ERRORS.items():
        retry = F.when(code == name, may).otherwise(retry)
    return F.struct(code.alias("code"), retry.alias("retryable"))


def search_error(known: Column, kind: Column, status: Column) -> Column:
    """struct<code,retryable> of a failed search; known: whether the provider raised it."""
    http = F.when(status == 429, "rate-limited").when(status.isin(502, 503, 504), "unavailable").otherwise("tool-failed")
    code = F.when(~known, "tool-failed").when(kind == "timeout", "timeout").when(kind == "network", "unavailable").when(kind == "http", http).when(kind.isin("invalid-json", "invalid-response"), "invalid-result").otherwise("tool-failed")
    return _tool_error(code)


def fetch_error(known: Column, kind: Column, status: Column) -> Column:
    """struct<code,retryable> of a failed page fetch."""
    http = F.when(status.isin(408, 504), "timeout").when(status == 429, "rate-limited").when(status.isin(502, 503, 521, 522, 523, 524), "unavailable").otherwise("tool-failed")
    code = (
        F.when(~known, "tool-failed")
        .when(kind.isin("blocked-url", "invalid-redirect"), "blocked-url")
        .when(kind == "timeout", "timeout")
        .when(kind.isin("unsupported-content", "response-too-large"), "unsupported-content")
        .when(kind == "network", "unavailable")
        .when(kind == "http", http)
        .otherwise("tool-failed")
    )
    return _tool_error(code)


def budget_accounting(calls: DataFrame, max_model: int, max_tool: int, timeout_ms: int, *, run_col: str = "run_id", order_col: str = "pos") -> DataFrame:
    """One row per run: model_calls, tool_calls, stopped_at, stop_reason.

    calls: run, order, kind (model or tool), elapsed_ms. A call is made if the
    deadline isn't reached (it counts as passed at the very millisecond) and its
    kind's budget isn't spent, checked in that order; the first that isn't made
    stops the run.
    """
    w = Window.partitionBy(run_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    before = {k: F.coalesce(F.count_if(F.col("kind") == k).over(w), F.lit(0)) for k in ("model", "tool")}
    stop = F.when(F.greatest(F.col("elapsed_ms"), F.lit(0)) >= timeout_ms, "deadline-exceeded").when((F.col("kind") == "model") & (before["model"] >= max_model), "model-budget-exhausted").when((F.col("kind") == "tool") & (before["tool"] >= max_tool), "tool-budget-exhausted")
    rows = calls.withColumns({"stop": stop, "m": before["model"], "t": before["tool"]})
    first = F.min_by(F.struct(order_col, "stop", "m", "t"), F.when(F.col("stop").isNotNull(), F.col(order_col)))
    out = rows.groupBy(run_col).agg(F.count_if(F.col("kind") == "model").alias("all_m"), F.count_if(F.col("kind") == "tool").alias("all_t"), F.max(F.col("stop").isNotNull()).alias("stopped"), first.alias("f"))
    return out.select(run_col, F.when(F.col("stopped"), F.col("f.m")).otherwise(F.col("all_m")).alias("model_calls"), F.when(F.col("stopped"), F.col("f.t")).otherwise(F.col("all_t")).alias("tool_calls"), F.when(F.col("stopped"), F.col(f"f.{order_col}")).alias("stopped_at"), F.when(F.col("stopped"), F.col("f.stop")).alias("stop_reason"))


def research_outcome(stop_reason: Column, selected: Column, suggestion: Column) -> Column:
    """struct<outcome,stop_reason> of a run; stop_reason is null where it came to its end."""
    result = lambda outcome, reason: F.struct(F.lit(outcome).alias("outcome"), reason.alias("stop_reason"))
    return F.when(stop_reason.isNotNull(), result("partial", stop_reason)).when((suggestion == "coverage-sufficient") & (selected > 0), result("complete", F.lit("criteria-satisfied"))).when(selected > 0, result("partial", F.lit("no-useful-results"))).otherwise(result("insufficient-sources", F.lit("no-useful-results")))


def retry_at(now_ms: Column, lease_ms: Column) -> Column:
    """When to try a run again that another worker holds."""
    return F.greatest(now_ms + RETRY_MARGIN_MS, lease_ms + RETRY_MARGIN_MS)


def lease_until(claimed_ms: Column, timeout_ms: Column) -> Column:
    return claimed_ms + timeout_ms + LEASE_MARGIN_MS


def step(state: dict | None, event: dict) -> tuple[dict | None, str]:
    """A research run after an event, and what came of the event.

    Events: create, claim, complete, fail, with at_ms, token, lease_ms and result.
    """
    kind = event["kind"]
    if kind == "create":
        if state is None:
            return {"status": "PENDING", "token": None, "lease_ms": None, "started_ms": None, "ended_ms": None, "result": None, "request": event["result"]}, "created"
        return state, "replayed" if state["request"] == event["result"] else "conflict"
    if state is None:
        return state, "missing"
    if kind == "claim":
        free = state["status"] == "PENDING" or (state["status"] == "RUNNING" and state["lease_ms"] <= event["at_ms"])
        if not free:
            return state, "terminal" if state["status"] in ("COMPLETED", "FAILED") else "held"
        started = event["at_ms"] if state["started_ms"] is None else state["started_ms"]
        return state | {"status": "RUNNING", "token": event["token"], "lease_ms": event["lease_ms"], "started_ms": started}, "claimed"
    ended = "COMPLETED" if kind == "complete" else "FAILED"
    if state["status"] == "RUNNING" and state["token"] == event["token"]:
        return state | {"status": ended, "ended_ms": event["at_ms"], "result": event["result"], "lease_ms": None}, ended.lower()
    if state["status"] == ended and state["token"] == event["token"] and state["result"] == event["result"]:
        return state, "replayed"
    return state, "conflict"


STATE = "status string, token string, lease_ms long, started_ms long, ended_ms long, result string"


def lease_states(events: DataFrame, *, run_col: str = "run_id", order_col: str = "pos") -> DataFrame:
    """The state of each run after its events in order, with counts of claims, conflicts and replays.

    events: run, order, kind, at_ms, token, lease_ms, result. A run's events are
    folded in one task.
    """
    kind = events.schema[run_col].dataType.simpleString()

    def run(key, pdf):
        state, said = None, []
        for e in pdf.sort_values(order_col).to_dict("records"):
            e = {k: (None if v is None or v != v else v) for k, v in e.items()}
            state, what = step(state, e)
            said.append(what)
        row = {c.split()[0]: (state or {}).get(c.split()[0]) for c in STATE.split(", ")}
        row |= {run_col: key[0], "claims": said.count("claimed"), "conflicts": said.count("conflict"), "replays": said.count("replayed"), "held": said.count("held")}
        return pd.DataFrame([row]).astype({c: "Int64" for c in ("lease_ms", "started_ms", "ended_ms")})

    return events.groupBy(run_col).applyInPandas(run, f"{run_col} {kind}, {STATE}, claims long, conflicts long, replays long, held long")


def story_catalog(stories: DataFrame, memberships: DataFrame, articles: DataFrame) -> DataFrame:
    """The first catalog of a research run: (story_id, source_id, article_id, url, canonical_url, title, publisher_name, provenance), a row for each member of a story."""
    rows = stories.select("story_id").join(memberships.select("story_id", "article_id", "seq"), "story_id").join(articles, "article_id")
    return rows.select("story_id", F.concat(F.lit("story_"), F.col("article_id").cast("string")).alias("source_id"), "article_id", "url", "canonical_url", "title", "publisher_name", F.lit("story-member").alias("provenance"), "seq")


def prompt_payload(stories: DataFrame, catalog: DataFrame, goal: Column, max_sources: int) -> DataFrame:
    """(story_id, payload): JSON with the story, the goal and the first sources by arrival, each with its distinct kinds of provenance.

    stories: story_id, canonical_title. The prompt holds at most PROMPT_SOURCES
    sources, fewer if fewer may be selected.
    """
    one = catalog.groupBy("story_id", "source_id").agg(F.min("seq").alias("seq"), F.first("title").alias("title"), F.first("publisher_name").alias("publisher_name"), F.array_sort(F.collect_set("provenance")).alias("kinds"))
    ranked = one.withColumn("r", F.row_number().over(Window.partitionBy("story_id").orderBy("seq", "source_id"))).where(F.col("r") <= min(PROMPT_SOURCES, max_sources))
    lists = ranked.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("r", "source_id", "title", "publisher_name", "kinds"))).alias("s"))
    shown = F.transform(
        F.coalesce("s", F.array().cast(lists.schema["s"].dataType)),
        lambda s: F.struct(s["source_id"].alias("sourceId"), bounded_text(s["title"], TITLE_MAX).alias("title"), bounded_text(s["publisher_name"], PUBLISHER_MAX).alias("publisherName"), s["kinds"].alias("originKinds")),
    )
    story = F.struct(F.col("story_id").alias("id"), F.col("canonical_title").alias("canonicalTitle"))
    payload = F.to_json(F.struct(story.alias("story"), F.coalesce(bounded_text(goal, GOAL_MAX), F.lit(DEFAULT_GOAL)).alias("researchGoal"), shown.alias("registeredSources")), {"ignoreNullFields": "false"})
    return stories.join(lists, "story_id", "left").select("story_id", payload.alias("payload"))


def selection_violations(selections: DataFrame, catalog: DataFrame, max_sources: int, max_questions: int, max_question_length: int) -> DataFrame:
    """(run_id, rule) of selections that break a rule; selections: run_id, source_ids, primary_ids, questions, suggestion.

    Sources are of the catalog and named once, primaries are selected and named
    once, and sources and questions stay within the budget and aren't blank.
    """
    picked = selections.select("run_id", F.explode(F.array_distinct("source_ids")).alias("source_id"))
    strange = picked.join(catalog.select("run_id", "source_id"), ["run_id", "source_id"], "left_anti").select("run_id", F.lit("source-of-the-catalog").alias("rule"))
    rules = {
        "sources-distinct": F.size(F.array_distinct("source_ids")) == F.size("source_ids"),
        "primaries-distinct": F.size(F.array_distinct("primary_ids")) == F.size("primary_ids"),
        "primaries-selected": F.size(F.array_except("primary_ids", "source_ids")) == 0,
        "coverage-has-a-source": (F.col("suggestion") != "coverage-sufficient") | (F.size("source_ids") > 0),
        "sources-in-budget": F.size("source_ids") <= max_sources,
        "questions-in-budget": F.size("questions") <= max_questions,
        "questions-bounded": F.forall("questions", lambda q: (F.trim(q) != "") & (F.char_length(q) <= max_question_length)),
    }
    broken = selections.select("run_id", F.explode(F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))).alias("rule"))
    return strange.unionByName(broken).distinct()


def catalog_violations(catalog: DataFrame, members: DataFrame) -> DataFrame:
    """(run_id, rule) of source catalogs that break a rule.

    catalog: run_id, source_id, canonical_url, provenance, article_id, call_id,
    tool. members: run_id, article_id of the story's snapshot.
    """
    twice = lambda key, rule: catalog.groupBy("run_id", key).count().where("count > 1").select("run_id", F.lit(rule).alias("rule"))
    strange = catalog.where("provenance = 'story-member'").join(members, ["run_id", "article_id"], "left_anti").select("run_id", F.lit("member-of-the-snapshot").alias("rule"))
    tools = catalog.where("provenance <> 'story-member'").groupBy("run_id", "call_id").agg(F.count_distinct("tool").alias("n")).where("n > 1").select("run_id", F.lit("one-tool-per-call").alias("rule"))
    return twice("source_id", "source-ids-distinct").unionByName(twice("canonical_url", "canonical-urls-distinct")).unionByName(strange).unionByName(tools).distinct()
