"""Secrets in texts: fixed patterns, and corpus-wide ownership of what they and a wider pattern find.

Spans of the fixed patterns are always reported. A wider pattern finds further
credential-like strings. The hashes of all candidates are aggregated over the
corpus by distinct owners and distinct repositories (an owner's). A value looks
live where at most ``max_owners`` owners hold it in at most ``max_repositories``
repositories; beyond either it is a copied example. The wider pattern's spans are
added where they look live, and fixed spans are counted as live or copied; each
span carries its numbers of owners and repositories.

All steps are DataFrame operations. Positions come from the pieces between the
matches, so they count code points; texts are read whole, and the work on one
grows with its length and matches, not with their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.arrays import chunks, let, running
from loomline.llm.common import materialise, no_text_as_empty, unused, with_row_key

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # where AKIA[A-Z0-9]+ matches with 20 characters or more
HEX = r"[0-9a-f]{24,}"
WIDE = r"[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
SPAN = "struct<start:int,kind:int,end:int,value:string>"
SALTS = 16


def _spans(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """array<struct<start,kind,end,value>> of the leftmost non-overlapping matches; value is the group's text."""
    regex = F.lit(pattern)
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    hits = F.regexp_extract_all(text, regex, F.lit(0))
    lengths = F.transform(hits, lambda x: F.char_length(x))
    values = hits if value_group == 0 else F.regexp_extract_all(text, regex, F.lit(value_group))

    def placed(n: Column) -> Column:
        ends = running(F.zip_with(F.slice(pieces, 1, F.size(n)), n, lambda piece, hit: piece + hit), lambda a, b: a + b)
        return F.transform(F.arrays_zip(ends.alias("end"), n.alias("n"), values.alias("value")), lambda x: F.struct((x["end"] - x["n"]).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))

    return F.when(text.rlike(pattern), let(lengths, placed)).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """The fixed patterns' spans by start, then kind."""
    assign = F.filter(_spans(text, ASSIGN, 0, 2), lambda s: F.char_length(s["value"]) >= 6)
    return F.array_sort(F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def wide_spans(text: Column, base: Column) -> Column:
    """Strings of 20 or more letters, digits, ``_`` and ``-``, with a letter and four digits at least, clear of the fixed spans."""
    mixed = lambda s: s["value"].rlike("[A-Za-z]") & (F.regexp_count(s["value"], F.lit("[0-9]")) >= 4)
    far = F.lit(2**31 - 1)

    def clear(every: Column) -> Column:
        """The wide ones of spans by start that no fixed one before reaches into and none after begins in."""
        fixed = lambda s, there, other: F.when(s["kind"] < 3, there).otherwise(other)
        reached = running(F.transform(every, lambda s: fixed(s, s["end"], F.lit(0))), lambda a, b: F.greatest(a, b))
        begins = F.reverse(running(F.reverse(F.transform(every, lambda s: fixed(s, s["start"], far))), lambda a, b: F.least(a, b)))
        cells = F.arrays_zip(every.alias("s"), reached.alias("reached"), begins.alias("begins"))
        return F.transform(F.filter(cells, lambda x: (x["s"]["kind"] == 3) & (x["reached"] <= x["s"]["start"]) & (x["begins"] >= x["s"]["end"])), lambda x: x["s"])

    wide = F.filter(_spans(text, WIDE, 3), mixed)
    return let(wide, lambda w: F.when((F.size(w) == 0) | (F.size(base) == 0), w).otherwise(let(F.array_sort(F.concat(base, w)), clear)))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(found: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """(hash, owners, repositories, live) of each candidate hash; found has hash, owner, repo. A repository is a name of an owner's.

    Repeats are collapsed before the shuffle, so a value that a third of the
    rows hold costs a row for each owner, repository and task.
    """
    held = found.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("n"))
    counts = held.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    return counts.withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))


PLACED = "struct<start:int,kind:int,end:int,owners:long,repositories:long>"


def _scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str, max_owners: int, max_repositories: int) -> DataFrame:
    """(id, text_key, base, owned, n_live) of each row; spans are struct<start,kind,end,owners,repositories> in order."""
    rows = docs.select(F.col(id_col).alias("id"), no_text_as_empty(text_col).alias("text"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((owner_col, "owner"), (repo_col, "repo"))])
    hashed = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"], F.unhex(F.sha2(s["value"], 256)).alias("hash")))
    both = let(base_spans(F.col("text")), lambda base: F.concat(base, wide_spans(F.col("text"), base)))
    found = materialise(with_row_key(rows.select("id", F.xxhash64("text").alias("text_key"), "owner", "repo", hashed(both).alias("spans"))), "secrets")
    each = found.select("row_key", "owner", "repo", F.explode("spans").alias("s")).select("row_key", "owner", "repo", F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.col("s.hash").alias("hash"))
    held = ownership(each.select("hash", "owner", "repo"), max_owners, max_repositories)
    # a value that many rows hold meets its counts in ``SALTS`` places
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = each.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).cast("int")).join(held, ["hash", "salt"])
    cell = F.struct("start", "kind", "end", "owners", "repositories")
    by_row = judged.groupBy("row_key").agg(F.array_sort(F.collect_list(F.when(F.col("kind") < 3, cell))).alias("base"), F.array_sort(F.collect_list(F.when((F.col("kind") == 3) & F.col("live"), cell))).alias("owned"), F.count_if((F.col("kind") < 3) & F.col("live")).alias("n_live"))
    none = F.array().cast(f"array<{PLACED}>")
    return found.select("row_key", "id", "text_key").join(by_row, "row_key", "left").select("id", "text_key", F.coalesce("base", none).alias("base"), F.coalesce("owned", none).alias("owned"), F.coalesce("n_live", F.lit(0)).alias("n_live"))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang", max_owners: int = 2, max_repositories: int = 3) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_copied, owners, repositories, span_list.

    ``span_list`` holds struct<start,kind,end,owners,repositories> of all spans in
    order, ``owners`` and ``repositories`` their numbers, comma-joined in that
    order. Null texts count as empty, null owners and repositories as the empty
    name. Rows that repeat are scanned each on its own and count once for their
    owner. An empty table gives no rows. Other columns aren't read.
    """
    out = _scan(docs, id_col, text_col, owner_col, repo_col, max_owners, max_repositories)
    every = F.array_sort(F.concat("base", "owned"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    numbers = lambda name: F.array_join(F.transform(every, lambda s: s[name].cast("string")), ",").alias(name)
    return out.select(
        F.col("id").alias(id_col),
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(every).alias("spans"),
        F.size("owned").cast("long").alias("n_owned"),
        F.col("n_live").cast("long").alias("n_live"),
        (F.size("base") - F.col("n_live")).cast("long").alias("n_copied"),
        numbers("owners"),
        numbers("repositories"),
        every.alias("span_list"),
    )


def _redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans (in order) replaced by the first one's kind in brackets; spans aren't empty."""
    kind = F.array(*map(F.lit, KINDS))
    reached = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))

    def rebuilt(reached: Column) -> Column:
        cells = F.transform(spans, lambda s, k: F.struct(F.when(k > 0, F.get(reached, k - 1)).otherwise(0).alias("after"), s["start"].alias("start"), s["kind"].alias("kind")))
        heads = F.filter(cells, lambda c: c["start"] >= c["after"])

        def some(part: Column) -> Column:
            """A chunk of heads, cut from the text once and then piece by piece."""
            first, last = F.element_at(part, 1)["after"], F.element_at(part, -1)["start"]
            piece = lambda here: F.transform(part, lambda h: F.concat(F.substring(here, h["after"] - first + 1, h["start"] - h["after"]), F.lit("["), F.element_at(kind, h["kind"] + 1), F.lit("]")))
            return F.array_join(let(F.substring(text, first + 1, last - first), piece), "")

        return F.concat(F.array_join(F.transform(chunks(heads, 256), some), ""), F.substring(text, F.element_at(reached, -1) + 1, F.char_length(text)))

    return let(reached, rebuilt)


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang", max_owners: int = 2, max_repositories: int = 3) -> DataFrame:
    """The rows of docs with every span that scan_secrets finds replaced by its kind in brackets.

    Overlapping spans become one, named by the first. Texts without spans, and
    empty and null ones, stay as they are; those without a candidate are not
    shuffled. Null ids are matched like others, rows that repeat all stay, other
    columns, whatever their names, are kept, and an empty table stays empty.
    """
    one, key, text_key, spans = unused(docs, "_id", "_key", "_text_key", "_spans")
    scanned = _scan(docs, id_col, text_col, owner_col, repo_col, max_owners, max_repositories).withColumn("all", F.array_sort(F.concat("base", "owned"))).where(F.size("all") > 0)
    # rows equal in id and text have equal base spans; owned ones may differ by owner, all of them are taken
    once = lambda every: F.filter(every, lambda s, k: (k == 0) | (s != F.get(every, k - 1)))
    found = scanned.groupBy(F.col("id").alias(one), F.col("text_key").alias(key)).agg(F.collect_set("all").alias("sets")).select(one, key, let(F.array_sort(F.flatten("sets")), once).alias(spans))
    candidate = F.coalesce(F.col(text_col).rlike("|".join(f"(?:{p})" for p in (ASSIGN, ACCESS, HEX, WIDE))), F.lit(False))
    keyed = docs.where(candidate).withColumn(text_key, F.xxhash64(no_text_as_empty(text_col)))
    joined = keyed.join(found, F.col(text_key).eqNullSafe(F.col(key)) & F.col(id_col).eqNullSafe(F.col(one)), "left")
    changed = joined.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(_redacted(F.col(text_col), F.col(spans))))
    return changed.select(docs.columns).unionByName(docs.where(~candidate))
