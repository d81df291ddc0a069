"""What a research run may call: search and fetch, each one chain; and what stored rows, batches and jobs are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.dates import iso
from loomline.functions.text import bounded_page_text
from loomline.functions.vocabulary import SEARCH_DEFAULT
from loomline.operators import integrity, readmodels, research
from loomline.operators.research import _tool_error

JOB_ATTEMPTS, JOB_BACKOFF_MS = 3, 1000


def search_sources(articles: DataFrame, excluded: DataFrame, catalog: DataFrame, limit: int = SEARCH_DEFAULT) -> DataFrame:
    """(query_id, pos, source_id, reused, title, publisher_name, published_at, excerpt, url): the view of each source that a search gives, in order of pos.

    A provider's articles are cleared of excluded and repeated ones, cut to the
    limit, registered in the catalog (query_id, canonical_url, source_id) and
    shown. A new source is named by its query and its place in the result.
    """
    found = research.search_candidates(articles, excluded, limit)
    each = found.select("query_id", F.posexplode("candidates").alias("index", "c")).select("query_id", "index", "c.*")
    observed = each.select("query_id", F.col("query_id").alias("call_id"), F.col("index").alias("pos"), "canonical_url")
    named = research.register_sources(observed, catalog, run_col="query_id").select("query_id", F.col("pos").alias("index"), "source_id", "reused")
    return each.join(named, ["query_id", "index"]).select("query_id", F.col("index").alias("pos"), "source_id", "reused", "title", "publisher_name", "published_at", "excerpt", "url")


def fetch_articles(requests: DataFrame, catalog: DataFrame, fetched: DataFrame) -> DataFrame:
    """One row per request: run_id, call_id, source_id, status ok|error, code, retryable, text, fetched_at, truncated.

    requests: run_id, call_id, source_id. The URL comes from the run's catalog
    (run_id, source_id, url) alone; a source it doesn't have is unknown-source.
    fetched has one row for each URL: url, html, fetched_at (timestamp), and, of
    one that failed, known, kind and status. A page without text is
    unsupported-content, a URL that was never fetched unavailable.
    """
    source = requests.join(catalog.select("run_id", "source_id", "url"), ["run_id", "source_id"], "left")
    page = fetched.select("url", bounded_page_text(F.col("html")).alias("t"), "fetched_at", "known", "kind", F.col("status").alias("http"), F.lit(True).alias("met"))
    rows = source.join(page, "url", "left")
    fine = F.col("kind").isNull() & (F.col("t.status") == "ok") & F.col("met")
    error = (
        F.when(F.col("url").isNull(), _tool_error(F.lit("unknown-source")))
        .when(F.col("met").isNull(), _tool_error(F.lit("unavailable")))
        .when(F.col("kind").isNotNull(), research.fetch_error(F.col("known"), F.col("kind"), F.col("http")))
        .when(F.col("t.status") != "ok", _tool_error(F.lit("unsupported-content")))
    )
    ok = F.coalesce(fine, F.lit(False))
    only = lambda c: F.when(ok, c)
    return rows.withColumn("e", error).select(
        "run_id", "call_id", "source_id", F.when(ok, "ok").otherwise("error").alias("status"), F.when(~ok, F.col("e.code")).alias("code"), F.when(~ok, F.col("e.retryable")).alias("retryable"),
        only(F.col("t.text")).alias("text"), only(iso(F.col("fetched_at"))).alias("fetched_at"), only(F.col("t.truncated")).alias("truncated"),
    )


def _same(names: dict[str, Column]) -> Column:
    """The names of what differs, in order."""
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in names.items()]))


def seed_replays(inputs: DataFrame, stories: DataFrame, memberships: DataFrame) -> DataFrame:
    """(story_id, outcome new|replayed|conflict, differs): whether a seed story that is to be written is already there, with the same state.

    inputs: story_id, seed_article_id, canonical_title, clustering_version.
    stories has also representative_article_id; memberships: story_id,
    article_id, kind, clustering_version.
    """
    s = stories.select("story_id", F.struct("seed_article_id", "representative_article_id", "canonical_title", "clustering_version").alias("s"))
    m = memberships.select(F.col("article_id").alias("seed_article_id"), F.struct("story_id", "kind", "clustering_version").alias("m"))
    both = inputs.join(s, "story_id", "left").join(m, "seed_article_id", "left")
    given = lambda c: F.col(c)
    differs = _same({
        "seed": F.col("s.seed_article_id").eqNullSafe(given("seed_article_id")), "representative": F.col("s.representative_article_id").eqNullSafe(given("seed_article_id")),
        "title": F.col("s.canonical_title").eqNullSafe(given("canonical_title")), "version": F.col("s.clustering_version").eqNullSafe(given("clustering_version")),
        "membership": F.col("m").isNotNull(), "membership-story": F.col("m.story_id").eqNullSafe(given("story_id")), "membership-kind": F.col("m.kind").eqNullSafe(F.lit("SEED")),
        "membership-version": F.col("m.clustering_version").eqNullSafe(given("clustering_version")),
    })
    return _outcome(both.select("story_id", F.col("s").isNull().alias("new"), differs.alias("differs")), "story_id")


def matched_replays(inputs: DataFrame, memberships: DataFrame) -> DataFrame:
    """(article_id, outcome new|replayed|conflict, differs) of matched memberships that are to be written.

    Both sides: article_id, story_id, score, reason, matched_against_article_id,
    clustering_version, signals (JSON, compared by its values); memberships also kind.
    """
    from loomline.operators.readmodels import canonical_json

    names = ("story_id", "score", "reason", "matched_against_article_id", "clustering_version")
    m = memberships.select("article_id", F.struct("kind", *names, canonical_json(F.col("signals")).alias("signals")).alias("m"))
    both = inputs.join(m, "article_id", "left")
    same = {"kind": F.col("m.kind").eqNullSafe(F.lit("MATCHED"))} | {n: F.col(f"m.{n}").eqNullSafe(F.col(n)) for n in names} | {"signals": F.col("m.signals").eqNullSafe(canonical_json(F.col("signals")))}
    return _outcome(both.select("article_id", F.col("m").isNull().alias("new"), _same(same).alias("differs")), "article_id")


def _outcome(rows: DataFrame, key: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return rows.select(key, F.when(F.col("new"), "new").when(F.size("differs") == 0, "replayed").otherwise("conflict").alias("outcome"), F.when(F.col("new"), none).otherwise(F.col("differs")).alias("differs"))


def embedding_violations(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(batch_id, rule, key) of embedding batches that break a rule.

    requests: batch_id, pos, id, text. responses: batch_id, pos, embedding. Ids
    and texts aren't blank, ids are given once in a batch, every request has one
    embedding at its position and nothing else is given, embeddings have components
    and only finite ones.
    """
    row = lambda df, rule, key: df.select("batch_id", F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    twice = requests.where(~blank("id")).groupBy("batch_id", "id").count().where("count > 1")
    given = responses.groupBy("batch_id", "pos").agg(F.count("*").alias("n"))
    met = requests.select("batch_id", "pos", F.lit(1).alias("asked")).join(given, ["batch_id", "pos"], "full")
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = [
        row(requests.where(blank("id")), "id-blank", "pos"), row(requests.where(blank("text")), "text-blank", "pos"), row(twice, "id-once", "id"),
        row(met.where("n IS NULL"), "request-answered", "pos"), row(met.where("asked IS NULL"), "answer-asked-for", "pos"), row(met.where("n > 1"), "answered-once", "pos"),
        row(responses.where(v.isNull() | (F.size(v) == 0)), "embedding-empty", "pos"), row(responses.where(v.isNotNull() & ~finite), "embedding-finite", "pos"),
    ]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def job_states(attempts: DataFrame, most: int = JOB_ATTEMPTS, backoff_ms: int = JOB_BACKOFF_MS) -> DataFrame:
    """(job_id, attempts, state, reason, retry_at_ms) of each job after its attempts in order.

    attempts: job_id, pos, ok, retryable, reason, at_ms. An attempt that succeeds
    completes the job; a failure that isn't retryable, or the ``most``-th, fails it;
    another waits backoff * 2 ** (failures - 1). What comes after the end doesn't count.
    """
    order = Window.partitionBy("job_id").orderBy("pos")
    rows = attempts.withColumn("nth", F.row_number().over(order))
    state = F.when(F.col("ok"), "completed").when(~F.col("retryable") | (F.col("nth") >= most), "failed").otherwise("waiting")
    rows = rows.withColumn("state", state)
    last = F.max_by(F.struct("nth", "state", "reason", "at_ms"), "nth")
    ended = F.min_by(F.struct("nth", "state", "reason", "at_ms"), F.when(F.col("state") != "waiting", F.col("nth")))
    out = rows.groupBy("job_id").agg(F.coalesce(ended, last).alias("r"))
    again = F.when(F.col("r.state") == "waiting", F.col("r.at_ms") + (backoff_ms * F.pow(F.lit(2.0), F.col("r.nth") - 1)).cast("long"))
    return out.select("job_id", F.col("r.nth").cast("long").alias("attempts"), F.col("r.state").alias("state"), F.when(F.col("r.state") != "completed", F.col("r.reason")).alias("reason"), again.alias("retry_at_ms"))


def article_view(articles: DataFrame) -> DataFrame:
    """(id, view): an article as its public JSON, with source and publisher as objects and times in ISO 8601; the publisher is null where its name is.

    articles: id, title, url, canonical_url, source_id, source_name, source_type,
    publisher_id, publisher_name, published_at, first_discovered_at, last_seen_at,
    author, summary, category.
    """
    c = F.col
    view = F.struct(
        c("id"), c("title"), c("url"), c("canonical_url").alias("canonicalUrl"),
        _source().alias("source"), _publisher().alias("publisher"),
        *[iso(c(a)).alias(b) for a, b in (("published_at", "publishedAt"), ("first_discovered_at", "firstDiscoveredAt"), ("last_seen_at", "lastSeenAt"))],
        c("author"), c("summary"), c("category"),
    )
    return articles.select("id", F.to_json(view, {"ignoreNullFields": "false"}).alias("view"))


def _source() -> Column:
    return F.struct(*[F.col(f"source_{c}").alias(c) for c in ("id", "name", "type")])


def _publisher() -> Column:
    return F.when(F.col("publisher_name").isNotNull(), F.struct(F.col("publisher_id").alias("id"), F.col("publisher_name").alias("name")))


def _named(column: str, name: str) -> Column:
    """A JSON value in its place; text that isn't JSON raises."""
    return F.parse_json(F.col(column)).alias(name)


def story_list_view(stories: DataFrame, memberships: DataFrame) -> DataFrame:
    """(id, view): a story as the list shows it, with its number of members. Columns as in ``story_view``."""
    counted = readmodels.with_member_count(stories, memberships, "id", "story_id", "n")
    view = F.struct(*_story_head(), F.col("n").alias("membershipCount"), iso(F.col("created_at")).alias("createdAt"), iso(F.col("updated_at")).alias("updatedAt"))
    return counted.select("id", F.to_json(view, {"ignoreNullFields": "false"}).alias("view"))


def _story_head() -> list[Column]:
    plain = [F.col(a).alias(b) for a, b in (("id", "id"), ("canonical_title", "canonicalTitle"), ("seed_article_id", "seedArticleId"), ("representative_article_id", "representativeArticleId"), ("clustering_version", "clusteringVersion"))]
    return [*plain, iso(F.col("first_published_at")).alias("firstPublishedAt"), iso(F.col("last_published_at")).alias("lastPublishedAt")]


def story_view(stories: DataFrame, memberships: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, view): a story as its public JSON, with its members by time of joining, then article, each with its article. A story without members has an empty list.

    stories: id, canonical_title, seed_article_id, representative_article_id,
    clustering_version, first_published_at, last_published_at, created_at,
    updated_at. memberships: id, story_id, article_id, kind (ENUM_NAME, shown as it
    is), score, signals (JSON or null), reason, matched_against_article_id,
    clustering_version, created_at. articles: as in ``article_view``. The view is
    one cell, as asked for, with all the story's members.
    """
    c = F.col
    times = (("published_at", "publishedAt"), ("first_discovered_at", "firstDiscoveredAt"), ("last_seen_at", "lastSeenAt"))
    article = F.struct(c("id"), c("title"), c("url"), c("canonical_url").alias("canonicalUrl"), _source().alias("source"), _publisher().alias("publisher"), *[iso(c(a)).alias(b) for a, b in times])
    shown = articles.select(c("id").alias("article_id"), article.alias("article"))
    names = (("id", "id"), ("kind", "kind"), ("score", "score"))
    member = F.struct(*[c(a).alias(b) for a, b in names], _named("signals", "signals"), c("reason"), c("matched_against_article_id").alias("matchedAgainstArticleId"), c("clustering_version").alias("clusteringVersion"), iso(c("created_at")).alias("createdAt"), c("article"))
    joined = memberships.join(shown, "article_id").select("story_id", c("created_at").alias("at"), c("article_id").alias("key"), F.to_json(member, {"ignoreNullFields": "false"}).alias("m"))
    lists = joined.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("at", "key", "m"))).alias("l")).select(c("story_id").alias("id"), F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["m"]), ","), F.lit("]")).alias("l"))
    head = F.to_json(F.struct(*_story_head(), iso(c("created_at")).alias("createdAt"), iso(c("updated_at")).alias("updatedAt")), {"ignoreNullFields": "false"})
    whole = F.concat(F.substring(head, F.lit(1), F.char_length(head) - 1), F.lit(',"memberships":'), F.coalesce("l", F.lit("[]")), F.lit("}"))
    return stories.join(lists, "id", "left").select("id", whole.alias("view"))


def research_run_view(runs: DataFrame) -> DataFrame:
    """(id, view): a research run as its public JSON; its token, lease and idempotency key are not shown.

    runs: id, story_id, status, outcome and stop_reason (ENUM_NAME, shown as
    enum-name, the status as it is), research_goal, budget and selection (JSON or null),
    model_calls, tool_calls, started_at, completed_at, created_at, updated_at.
    """
    c = F.col
    view = F.struct(
        c("id"), c("story_id").alias("storyId"), c("status"), c("research_goal").alias("researchGoal"), _named("budget", "budget"),
        readmodels.kebab(c("outcome")).alias("outcome"), readmodels.kebab(c("stop_reason")).alias("stopReason"), _named("selection", "selection"),
        c("model_calls").alias("modelCalls"), c("tool_calls").alias("toolCalls"),
        *[iso(c(a)).alias(b) for a, b in (("started_at", "startedAt"), ("completed_at", "completedAt"), ("created_at", "createdAt"), ("updated_at", "updatedAt"))],
    )
    return runs.select("id", F.to_json(view, {"ignoreNullFields": "false"}).alias("view"))


def story_corpus_violations(scenarios: DataFrame, articles: DataFrame, clusters: DataFrame) -> DataFrame:
    """(rule, key) of a labelled story corpus that breaks a rule; it has to be empty.

    scenarios: scenario_id. articles: scenario_id, article_id, canonical_url.
    clusters: scenario_id, cluster_id, article_id, a row for each article of an
    expected cluster.
    """
    of = lambda df, name: df.withColumn("key", F.concat_ws("|", F.col("scenario_id").cast("string"), F.col(name).cast("string"))).select("key")
    a, url, member = of(articles, "article_id"), of(articles, "canonical_url"), of(clusters, "article_id")
    return (
        integrity.repeated_keys(scenarios, ["scenario_id"], "scenario-once")
        .unionByName(integrity.missing_references(scenarios, "scenario_id", articles, "scenario_id", "scenario-has-articles"))
        .unionByName(integrity.missing_references(scenarios, "scenario_id", clusters, "scenario_id", "scenario-has-clusters"))
        .unionByName(integrity.repeated_keys(a, ["key"], "article-once"))
        .unionByName(integrity.repeated_keys(url, ["key"], "url-once"))
        .unionByName(integrity.missing_references(member, "key", a, "key", "cluster-of-known-articles"))
        .unionByName(integrity.repeated_keys(member, ["key"], "article-in-one-cluster"))
        .unionByName(integrity.missing_references(a, "key", member, "key", "article-in-a-cluster"))
    )
