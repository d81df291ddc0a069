"""Stories: match decisions, assignment, and incremental seed-based clustering.

An article joins the one story in its time window whose seed it matches; with
none or several it seeds a story of its own. Arrival order decides, and a
story's window grows with its members, so the fold is sequential. It is only
needed within components of articles that match at all: tiled products of what
windows hold, followed as far as matches lead, tell what hangs together, a row
for each article and tile and never one for each pair. Equal vectors in a time
bucket take part as one. The fold runs in each component on its own and compares
an article with the seeds in its window only, and what counts all stories in a
window is joined to the result afterwards.

Articles may come in batches. Of what is stored a batch needs each story's seed
and interval, and only of stories that its times can reach; those start the fold
of the components that they match into, and only stories with new members change.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.vocabulary import CLUSTERING_VERSION, MATCH_REASON, MATCH_THRESHOLD, NO_MATCH_REASON
from loomline.operators.graph import components, met, settle

GROWTH = 3  # more makes fewer rounds, and more products that a growing story doesn't need
SLACK = 1e-9  # what hangs together is told from a little below the threshold; the fold decides


def match_decision(similarity: Column, threshold: float = MATCH_THRESHOLD) -> Column:
    """struct<decision,score,reason>; what isn't in [-1, 1] raises."""
    good = similarity.isNotNull() & ~F.isnan(similarity) & similarity.between(-1.0, 1.0)
    match = similarity >= threshold
    return F.when(good, F.struct(F.when(match, "match").otherwise("no-match").alias("decision"), F.greatest(F.lit(0.0), similarity).alias("score"), F.when(match, MATCH_REASON).otherwise(NO_MATCH_REASON).alias("reason"))).otherwise(
        F.raise_error(F.lit("a similarity lies in [-1, 1]")).cast("struct<decision:string,score:double,reason:string>")
    )


def assign(articles: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per article: kind, reason, story_id, considered, matching, matching_ids.

    articles: article_id. decisions: article_id, story_id, decision. The best
    score is not chosen: more than one match seeds a new story.
    """
    found = decisions.groupBy("article_id").agg(F.count("*").alias("considered"), F.count_if(F.col("decision") == "match").alias("matching"), F.array_sort(F.collect_list(F.when(F.col("decision") == "match", F.col("story_id")))).alias("ids"))
    rows = articles.join(found, "article_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("considered", "matching")})
    joins = F.col("matching") == 1
    reason = F.when(F.col("considered") == 0, "no-candidates").when(F.col("matching") == 0, "no-matching-candidates").when(F.col("matching") > 1, "ambiguous-matching-candidates")
    return rows.select("article_id", F.when(joins, "assign-existing-story").otherwise("seed-new-story").alias("kind"), reason.alias("reason"), F.when(joins, F.col("ids")[0]).alias("story_id"), "considered", "matching", F.when(F.col("matching") > 1, F.col("ids")).otherwise(F.array().cast("array<string>")).alias("matching_ids"))


def _multiply(threshold: float):
    """What hangs together in a tile's products: (node, root, first, last), a row for each node that matches; first and last are the times that a left node's matches reach."""

    def multiply(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "root": [], "first": [], "last": []})
        x, y = (_directions(side["vector"]) for side in (left, right))
        a, b = left["node"].to_numpy(), right["node"].to_numpy()
        near = (x @ y.T >= threshold - SLACK) & (a[:, None] < right["until"].to_numpy()[None, :]) & (a[:, None] != b[None, :])
        root, there = np.full(len(a), -1), np.full(len(b), -1)
        for k in np.flatnonzero(near.any(axis=1)):
            front = np.array([k]) if root[k] < 0 else np.array([], int)
            while len(front):  # a row and a column each come to the front once
                root[front] = a[k]
                met = np.flatnonzero(near[front].any(axis=0) & (there < 0))
                there[met] = a[k]
                front = np.flatnonzero(near[:, met].any(axis=1) & (root < 0))
        rows, cols = root >= 0, there >= 0
        far = np.iinfo(np.int64).max
        first = np.where(near[rows], right["first"].to_numpy()[None, :], far).min(axis=1, initial=far)
        last = np.where(near[rows], right["last"].to_numpy()[None, :], -far).max(axis=1, initial=-far)
        of_left = pd.DataFrame({"node": a[rows], "root": root[rows], "first": pd.array(first, "Int64"), "last": pd.array(last, "Int64")})
        of_right = pd.DataFrame({"node": b[cols], "root": there[cols], "first": pd.array([None] * cols.sum(), "Int64"), "last": pd.array([None] * cols.sum(), "Int64")})
        return pd.concat([of_left, of_right])

    return multiply


def _directions(vectors: pd.Series) -> np.ndarray:
    """Vectors of length one, as rows; zero vectors become not-a-number, which matches nothing."""
    x = np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)
    with np.errstate(invalid="ignore"):
        return x / np.linalg.norm(x, axis=1)[:, None]


def _meet(left: DataFrame, right: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(node, root, first, last) of left (bucket, node, vector) and right (bucket, node, until, first, last, vector) nodes of the same bucket, in tiles of both."""
    tiles = lambda df, name: df.groupBy("bucket").agg(F.ceil(F.count("*") / tile).cast("int").alias(name))
    sizes = met(tiles(left, "parts"), tiles(right, "tiles"), "bucket")
    dealt = lambda df, mine, own, theirs, other: met(df, sizes, "bucket").withColumns({own: F.pmod(F.xxhash64("node"), F.col(mine)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))}).drop("parts", "tiles")
    rows, cols = dealt(left, "parts", "i", "tiles", "j"), dealt(right, "tiles", "j", "parts", "i")
    rows = rows.select(*[F.col(c).alias(c) for c in ("bucket", "i", "j", "node", "vector")])  # columns of its own, as both come from one table
    keys = ["bucket", "i", "j"]
    return settle(rows.groupBy(*keys).cogroup(cols.groupBy(*keys)).applyInPandas(_multiply(threshold), "node long, root long, first long, last long"))


def _matches(nodes: DataFrame, old: DataFrame | None, threshold: float, window_ms: int, include_unknown: bool, tile: int) -> DataFrame:
    """(a, b): nodes that hang together, of all that can meet in a window and some more. A root stands for what a tile joins, so a tile gives a row for each of its nodes and not one for each pair.

    nodes: bucket, node, until (least and largest seq), first, last, vector: articles
    of one vector in a bucket. old: stored stories (seq, first_ms, last_ms, vector).

    All members of a story match its seed, so a seed's story reaches as far as
    the articles that match the seed lead, a window each. A seed first meets the
    buckets that its own window touches; while a match leads beyond what it has
    met, it meets the next buckets on that side, GROWTH times those it has met. So what
    is multiplied goes with the windows' contents, and only stories that grow are
    looked at again. Where unknown times take part, all meet all.
    """
    seeds = nodes.select("node", "first", "last", "vector")
    if old is not None:
        seeds = old.select(F.col("seq").alias("node"), F.col("first_ms").alias("first"), F.col("last_ms").alias("last"), "vector").unionByName(seeds)
    edges = lambda df: df.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    if include_unknown:
        return edges(_meet(seeds.select(F.lit(0).cast("long").alias("bucket"), "node", "vector"), nodes.withColumns({"first": F.lit(0).cast("long"), "last": F.lit(0).cast("long")}), threshold, tile))
    bucket = lambda ms: F.floor(ms / max(1, window_ms))
    used = nodes.select("bucket").distinct()
    # low and high are the buckets met so far, first and last the times reached
    state = settle(seeds.where("first IS NOT NULL").select("node", "first", "last", bucket(F.col("first") - window_ms).alias("low"), bucket(F.col("last") + window_ms).alias("high")))
    wanted = state.select("node", F.explode(F.sequence("low", "high")).alias("bucket"))
    found = None
    while True:
        new = _meet(met(met(wanted, used, "bucket"), seeds.select("node", "vector"), "node"), nodes, threshold, tile)
        found = new if found is None else found.unionByName(new)
        ends = new.where("first IS NOT NULL").groupBy("node").agg(F.min("first").alias("f"), F.max("last").alias("l"))
        grown = met(state, ends, "node").select("node", "low", "high", F.least("first", "f").alias("first"), F.greatest("last", "l").alias("last"))
        more, span = {"down": bucket(F.col("first") - window_ms), "up": bucket(F.col("last") + window_ms)}, GROWTH * (F.col("high") - F.col("low") + 1)
        grown = settle(grown.withColumns(more).where("down < low OR up > high").withColumns({"down": F.when(F.col("down") < F.col("low"), F.least("down", F.col("low") - span)).otherwise(F.col("low")), "up": F.when(F.col("up") > F.col("high"), F.greatest("up", F.col("high") + span)).otherwise(F.col("high"))}))
        if grown.isEmpty():
            return edges(found)
        below, above = (F.when(F.col(x) < F.col(y), F.sequence(F.col(x) + int(x == "high"), F.col(y) - int(y == "low"))) for x, y in (("down", "low"), ("high", "up")))
        wanted = grown.select("node", F.explode(F.concat(F.coalesce(below, F.array().cast("array<bigint>")), F.coalesce(above, F.array().cast("array<bigint>")))).alias("bucket"))
        state = grown.select("node", "first", "last", F.col("down").alias("low"), F.col("up").alias("high"))


class Stories:
    """The stories of a component: seeds with their vectors and intervals, in arrays that grow."""

    def __init__(self, width: int):
        self.n, self.seeds, self.vectors = 0, np.zeros(64, np.int64), np.zeros((64, width))
        self.first, self.last, self.known = np.zeros(64, np.int64), np.zeros(64, np.int64), np.zeros(64, bool)

    def add(self, seed: int, vector: np.ndarray, first: int | None, last: int | None) -> None:
        if self.n == len(self.seeds):
            for name in ("seeds", "vectors", "first", "last", "known"):
                had = getattr(self, name)
                setattr(self, name, np.concatenate([had, np.zeros_like(had)]))
        self.seeds[self.n], self.vectors[self.n] = seed, vector
        self.n += 1
        self.reach(self.n - 1, first, last)

    def reach(self, k: int, first: int | None, last: int | None) -> None:
        """Widen a story's interval; unknown times widen nothing."""
        if first is None or last is None:
            return
        self.first[k] = min(self.first[k], first) if self.known[k] else first
        self.last[k] = max(self.last[k], last) if self.known[k] else last
        self.known[k] = True

    def matches(self, at: int | None, vector: np.ndarray, threshold: float, window_ms: int, include_unknown: bool) -> tuple[np.ndarray, np.ndarray]:
        """The stories in whose window a time lies and whose seed the vector matches, with the similarities."""
        known = self.known[: self.n]
        if at is None:
            inside = np.full(self.n, include_unknown)
        else:
            inside = (known & (self.first[: self.n] - window_ms <= at) & (at <= self.last[: self.n] + window_ms)) | (~known & include_unknown)
        near = np.flatnonzero(inside)
        similar = self.vectors[near] @ vector
        fine = similar >= threshold
        return near[fine], similar[fine]


def fold(rows: list[tuple[int, int | None]], vectors: np.ndarray, stories: Stories, threshold: float, window_ms: int, include_unknown: bool) -> list[tuple[int, int, float | None, int, list[int]]]:
    """(seq, story seed's seq, score, matching, matching seeds) for rows (seq, at_ms) in arrival order; stories: those that are there."""
    out = []
    for (seq, at), vector in zip(rows, vectors, strict=True):
        near, similar = stories.matches(at, vector, threshold, window_ms, include_unknown)
        if len(near) == 1:
            stories.reach(near[0], at, at)
            out.append((seq, int(stories.seeds[near[0]]), max(0.0, float(similar[0])), 1, []))
        else:
            out.append((seq, seq, None, len(near), sorted(stories.seeds[near].tolist())))
            stories.add(seq, vector, at, at)
    return out


def cluster(articles: DataFrame, window_ms: int, *, threshold: float = MATCH_THRESHOLD, include_unknown: bool = False, tile: int = 1024, stories: DataFrame | None = None) -> DataFrame:
    """One row per article: seq, article_id, kind SEED|MATCHED, story_seq, reason, score, considered, matching, matching_seqs, at_ms.

    articles: seq (arrival, distinct long), article_id, at_ms (null: unknown),
    vector. A story is named by its seed's seq; story_id of it is a hash of the
    seed's article id, so that a rerun gives the same. A component is folded in
    one task. stories: those of earlier batches, as ``story_state`` has them; all
    articles come after all of their members.
    """
    key = F.sha2(F.array_join(F.col("vector").cast("array<string>"), ",", "-"), 256)
    bucket = F.lit(0).cast("long") if include_unknown else F.floor(F.col("at_ms") / max(1, window_ms))
    articles = settle(articles.select("seq", "article_id", F.col("at_ms").cast("long").alias("at_ms"), "vector").withColumns({"bucket": bucket, "key": key}))
    same = settle(articles.where("bucket IS NOT NULL").groupBy("bucket", "key").agg(F.min("seq").alias("node"), F.max("seq").alias("until"), F.min("at_ms").alias("first"), F.max("at_ms").alias("last"), F.count("*").alias("n"), F.any_value("vector").alias("vector")))
    old = None
    if stories is not None:
        old = settle(_in_reach(stories, articles, window_ms, include_unknown).select(F.col("story_seq").alias("seq"), "first_ms", "last_ms", "vector"))
    edges = settle(_matches(same.drop("key", "n"), old, threshold, window_ms, include_unknown, tile).distinct())
    alone = same.where("n > 1").select("node")  # equal articles hang together
    touched = components(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).unionByName(alone).distinct(), edges)
    rows = met(articles, same.select("bucket", "key", "node"), ["bucket", "key"]).select("node", "seq", "at_ms", F.col("at_ms").alias("last_ms"), F.lit(False).alias("stored"), "vector")
    if old is not None:
        rows = rows.unionByName(old.select(F.col("seq").alias("node"), "seq", F.col("first_ms").alias("at_ms"), "last_ms", F.lit(True).alias("stored"), "vector"))
    members = met(rows, touched, "node").drop("node")

    def run(key, rows):
        rows = rows.sort_values("seq")
        vectors, stored = _directions(rows["vector"]), rows["stored"].to_numpy(bool)
        ms = lambda times: [None if pd.isna(t) else int(t) for t in times]
        there = Stories(vectors.shape[1])
        for seed, vector, first, last in zip(rows["seq"][stored].tolist(), vectors[stored], ms(rows["at_ms"][stored]), ms(rows["last_ms"][stored]), strict=True):
            there.add(seed, vector, first, last)
        new = list(zip(rows["seq"][~stored].tolist(), ms(rows["at_ms"][~stored]), strict=True))
        return pd.DataFrame(fold(new, vectors[~stored], there, threshold, window_ms, include_unknown), columns=["seq", "story_seq", "score", "matching", "matching_seqs"])

    folded = settle(members.groupBy("component").applyInPandas(run, "seq long, story_seq long, score double, matching long, matching_seqs array<long>"))
    placed = met(articles.select("seq", "article_id", "at_ms"), folded, "seq", "left")
    placed = settle(placed.withColumns({"story_seq": F.coalesce("story_seq", "seq"), "matching": F.coalesce("matching", F.lit(0)), "matching_seqs": F.coalesce("matching_seqs", F.array().cast("array<long>"))}))
    considered = _considered(placed, old, window_ms, include_unknown)
    out = met(placed, considered, "seq", "left").withColumn("considered", F.coalesce("considered", F.lit(0)))
    seeded = F.col("story_seq") == F.col("seq")
    reason = F.when(~seeded, MATCH_REASON).when(F.col("considered") == 0, "no-candidates").when(F.col("matching") == 0, "no-matching-candidates").otherwise("ambiguous-matching-candidates")
    return out.select("seq", "article_id", F.when(seeded, "SEED").otherwise("MATCHED").alias("kind"), "story_seq", reason.alias("reason"), "score", "considered", "matching", "matching_seqs", "at_ms")


def _in_reach(stories: DataFrame, articles: DataFrame, window_ms: int, include_unknown: bool) -> DataFrame:
    """The stored stories whose intervals a batch's times can reach; a story beyond it gets no member, so it can't come into reach later."""
    if include_unknown:
        return stories
    low, high = articles.agg(F.min("at_ms"), F.max("at_ms")).first()
    if low is None:
        return stories.limit(0)
    return stories.where((F.col("last_ms") >= low - window_ms) & (F.col("first_ms") <= high + window_ms))


def story_state(clustered: DataFrame, articles: DataFrame, stories: DataFrame | None = None) -> DataFrame:
    """(story_seq, article_id, first_ms, last_ms, members, vector) of the stories that a batch seeded or gave members; stories: the ones before."""
    spans = clustered.groupBy("story_seq").agg(F.min("at_ms").alias("f"), F.max("at_ms").alias("l"), F.count("*").alias("n"))
    new = met(spans, articles.select(F.col("seq").alias("story_seq"), "article_id", "vector"), "story_seq").select("story_seq", "article_id", F.col("f").alias("first_ms"), F.col("l").alias("last_ms"), F.col("n").alias("members"), "vector")
    if stories is None:
        return new
    grown = met(stories, spans, "story_seq").select("story_seq", "article_id", F.least("first_ms", "f").alias("first_ms"), F.greatest("last_ms", "l").alias("last_ms"), (F.col("members") + F.col("n")).alias("members"), "vector")
    return new.unionByName(grown)


def _considered(placed: DataFrame, old: DataFrame | None, window_ms: int, include_unknown: bool) -> DataFrame:
    """(seq, considered): how many stories were in an article's window when it came.

    A story's interval has a version for each member, valid for the articles
    from the one after it to the next member; that of a stored story is its first
    version. Of neighbouring versions that are equal one is kept, so that a member
    that doesn't move the interval costs nothing. Versions and articles meet on
    time buckets.
    """
    by_story = Window.partitionBy("story_seq").orderBy("seq")
    so_far = by_story.rowsBetween(Window.unboundedPreceding, 0)
    told = placed.select("story_seq", "seq", F.col("at_ms").alias("f"), F.col("at_ms").alias("l"))
    if old is not None:
        told = told.unionByName(old.select(F.col("seq").alias("story_seq"), "seq", F.col("first_ms").alias("f"), F.col("last_ms").alias("l")))
    every = told.select("story_seq", "seq", F.min("f").over(so_far).alias("first_ms"), F.max("l").over(so_far).alias("last_ms"))
    before = lambda c: F.lag(c).over(by_story)
    moved = every.withColumn("moved", before("seq").isNull() | ~before("first_ms").eqNullSafe(F.col("first_ms")) | ~before("last_ms").eqNullSafe(F.col("last_ms"))).where("moved")
    versions = moved.select("story_seq", F.col("seq").alias("since"), F.lead("seq").over(by_story).alias("until"), "first_ms", "last_ms")
    a = placed.select("seq", "at_ms")
    valid = (F.col("since") < F.col("seq")) & (F.col("until").isNull() | (F.col("seq") <= F.col("until")))
    width = max(1, window_ms)
    known = versions.where("first_ms IS NOT NULL").withColumn("bucket", F.explode(F.sequence(F.floor((F.col("first_ms") - window_ms) / width), F.floor((F.col("last_ms") + window_ms) / width))))
    near = met(a.where("at_ms IS NOT NULL").withColumn("bucket", F.floor(F.col("at_ms") / width)), known, "bucket").where((F.col("at_ms") >= F.col("first_ms") - window_ms) & (F.col("at_ms") <= F.col("last_ms") + window_ms)).where(valid).select("seq")
    if include_unknown:
        near = near.unionByName(a.where("at_ms IS NULL").join(versions, valid).select("seq")).unionByName(a.where("at_ms IS NOT NULL").join(versions.where("first_ms IS NULL"), valid).select("seq"))
    return near.groupBy("seq").agg(F.count("*").alias("considered"))


def story_id(article_id: Column) -> Column:
    return F.substring(F.sha2(article_id.cast("string"), 256), 1, 32)


def story_tables(clustered: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stories, memberships). titles: article_id, title as at assignment; a story's title and representative are its seed's."""
    seeds = clustered.where("kind = 'SEED'").select(F.col("seq").alias("story_seq"), F.col("article_id").alias("seed"))
    rows = clustered.join(seeds, "story_seq")
    memberships = rows.select(story_id(F.col("seed")).alias("story_id"), "article_id", "kind", "score", F.when(F.col("kind") == "MATCHED", F.col("reason")).alias("reason"), F.when(F.col("kind") == "MATCHED", F.col("seed")).alias("matched_against_article_id"), F.lit(CLUSTERING_VERSION).alias("clustering_version"), F.col("at_ms").alias("published_at_ms"), "seq")
    spans = memberships.groupBy("story_id").agg(F.min("published_at_ms").alias("first_ms"), F.max("published_at_ms").alias("last_ms"), F.count("*").alias("members"))
    stories = seeds.join(titles, seeds["seed"] == titles["article_id"]).select(story_id(F.col("seed")).alias("story_id"), F.col("title").alias("canonical_title"), F.col("seed").alias("seed_article_id"), F.col("seed").alias("representative_article_id"), F.lit(CLUSTERING_VERSION).alias("clustering_version"))
    return stories.join(spans, "story_id"), memberships
