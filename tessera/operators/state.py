"""State without MERGE: each change is a query from the old snapshot to the new.

Documents are keyed by (source_id, item_id).  A snapshot is written beside the
old one and a pointer flipped (see generations), so readers see either.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.matching import contained
from tessera.plans.filters import under

KEY = ("source_id", "item_id")


def latest(changes: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The last change of each key."""
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return changes.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")


def upsert_documents(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Old rows overlaid by new ones: a null hash keeps the old, errors count attempts, indexed_at moves when indexed."""
    rename = {c: f"old_{c}" for c in old.columns if c not in KEY}
    both = old.withColumnsRenamed(rename).withColumn("__old", F.lit(True)).join(new.withColumn("__new", F.lit(True)), list(KEY), "full")
    is_new, had = F.col("__new").isNotNull(), F.col("__old").isNotNull()
    out = []
    for c in old.columns:
        if c in KEY:
            out.append(F.col(c))
        elif c == "content_hash":
            out.append(F.coalesce(c, f"old_{c}").alias(c))
        elif c == "attempts":
            tries = F.coalesce(F.col("old_attempts"), F.lit(0)) + 1
            out.append(F.when(is_new, F.when(F.col("status") == "error", F.when(had, tries).otherwise(1)).otherwise(0)).otherwise(F.col("old_attempts")).alias(c))
        elif c == "indexed_at":
            out.append(F.when(is_new & (F.col("status") == "indexed"), now).otherwise(F.col("old_indexed_at")).alias(c))
        else:
            out.append(F.when(is_new, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) if c in new.columns else F.col(f"old_{c}").alias(c))
    return both.select(*out)


def split_by_hash(new: DataFrame, old: DataFrame) -> DataFrame:
    """New items with `outcome`: unchanged where the hash is the one already indexed, else indexed, skipped or error as they are."""
    known = old.filter("status = 'indexed'").select(*KEY, F.col("content_hash").alias("__hash"))
    outcome = F.when(F.col("error").isNotNull(), "error").when(F.col("unsupported"), "skipped").when(F.col("content_hash") == F.col("__hash"), "unchanged").otherwise("indexed")
    return new.join(known, list(KEY), "left").withColumn("outcome", outcome).drop("__hash")


def replace_content(old: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """A child table in which the documents of `new` have their new rows only."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def retag(children: DataFrame, documents: DataFrame, columns: list[str], key: str = "document_id") -> DataFrame:
    """Copies of document columns on child rows brought up to date; embeddings and all else stay."""
    current = documents.select(F.col("id").alias(key), *[F.col(c).alias(f"__{c}") for c in columns])
    return children.drop(*columns).join(current, key).withColumnsRenamed({f"__{c}": c for c in columns}).select(*children.columns)


def delete_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that are neither an item nor inside a deleted folder (items: item_id, path, is_folder)."""
    left = documents.join(items.select("item_id"), "item_id", "left_anti")
    folders = items.filter("is_folder").select(F.col("path").alias("folder"))
    # A document meets the folders above it by their names.
    inside = left.select("path", F.explode(folders_above("path")).alias("folder")).join(folders, "folder", "left_semi").select("path").distinct()
    return left.join(inside, "path", "left_anti").select(*documents.columns)


def folders_above(path: str) -> Column:
    """The paths of all folders that a path lies in."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(F.size(parts) > n, F.array_join(F.slice(parts, 1, n), "/")))


def cascade(children: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """Child rows whose document is still there."""
    return children.join(documents.select(F.col("id").alias(key)), key, "left_semi")


def rename_folder(documents: DataFrame, old: str, new: str) -> DataFrame:
    """Paths below a folder under its new name, and whether a row was touched."""
    inside = under("path", old)
    path = F.when(inside, F.concat(F.lit(new), F.expr(f"substring(path, {len(old) + 1})"))).otherwise(F.col("path"))
    return documents.withColumns({"retagged": inside, "path": path})


def missing_from(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the other table lacks: what a rebuild has still to do, or a sweep to delete."""
    return rows.join(other.select(*keys), keys, "left_anti")


def sweep_left_out(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """What a full resync did not see any more."""
    return missing_from(rows, seen, [key])


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


# Corrections

PERSONAL_DAYS, REVIEW_DAYS = 90, 180
LIVE = ("approved", "needs_review")


def visible(corrections: DataFrame, user: str) -> DataFrame:
    """Approved corrections of all, and the user's own that are not over."""
    shared = (F.col("scope") == "global") & F.col("status").isin(*LIVE)
    own = (F.col("author") == user) & ~F.col("status").isin("rejected", "expired", "superseded")
    return corrections.filter(shared | own)


def reviewable(corrections: DataFrame, user: str, admin: bool = False, status: str | None = None) -> DataFrame:
    """A user's own, and those of all that are not pending or whose reader is an admin."""
    shown = (F.col("author") == user) | ((F.col("scope") == "global") & (F.lit(admin) | (F.col("status") != "pending")))
    return corrections.filter(shown & (F.col("status") == status if status else F.lit(True)))


def with_terms(corrections: DataFrame) -> DataFrame:
    """When a new correction ends (personal) or is looked at again (global)."""
    end = F.when(F.col("scope") == "personal", F.col("created_at") + F.expr(f"interval {PERSONAL_DAYS} days"))
    review = F.when(F.col("scope") == "global", F.col("created_at") + F.expr(f"interval {REVIEW_DAYS} days"))
    return corrections.withColumns({"expires_at": end, "review_due_at": review})


def decide(corrections: DataFrame, key: str, approve: bool) -> DataFrame:
    """A pending correction approved or rejected; any other is left as it is."""
    to = F.when((F.col("id") == key) & (F.col("status") == "pending"), "approved" if approve else "rejected").otherwise(F.col("status"))
    return corrections.withColumn("status", to)


def expire(corrections: DataFrame, now: Column) -> DataFrame:
    """Personal ones past their end expire; approved ones past their review date need review."""
    over = F.col("status").isin("active", *LIVE) & (F.col("expires_at") <= now)
    due = (F.col("status") == "approved") & (F.col("review_due_at") <= now)
    return corrections.withColumn("status", F.when(over, "expired").when(due, "needs_review").otherwise(F.col("status")))


def supersede(corrections: DataFrame, changed: DataFrame) -> DataFrame:
    """Approved corrections that a newer file on the same subject may overtake need review (changed: item_id, dataset, hotel, entities, period_start, period_end).

    They meet on the dataset's name and on each entity.
    """
    c, d = corrections.select("id", "dataset", "hotel", "entities", "period_start", "period_end"), changed.select("item_id", *[F.col(x).alias(f"__{x}") for x in ("dataset", "hotel", "entities", "period_start", "period_end")])
    place = F.col("hotel").isNull() | (F.lower("hotel") == F.lower("__hotel"))
    when = F.col("period_start").isNull() | ((F.col("period_start") <= F.col("__period_end")) & (F.coalesce("period_end", "period_start") >= F.col("__period_start")))
    subjects = lambda name, entities: F.explode(F.array_distinct(F.concat(F.array(F.struct(F.lit(True).alias("named"), F.lower(name).alias("of"))), F.transform(F.coalesce(entities, F.array()), lambda e: F.struct(F.lit(False).alias("named"), e.alias("of"))))))
    met = c.withColumn("subject", subjects("dataset", F.col("entities"))).join(d.withColumn("subject", subjects("__dataset", F.col("__entities"))), "subject")
    hit = met.filter(F.col("subject.of").isNotNull() & place & when).groupBy("id").agg(F.min("item_id").alias("__by"))
    out = corrections.join(hit, "id", "left")
    flagged = F.col("__by").isNotNull() & (F.col("status") == "approved")
    return out.withColumns({"status": F.when(flagged, "needs_review").otherwise(F.col("status")), "superseded_by_item": F.when(flagged, F.col("__by")).otherwise(F.col("superseded_by_item"))}).select(*corrections.columns)


def contradicted(corrections: DataFrame, cited: DataFrame) -> DataFrame:
    """Corrections with `contradicts`: the first cited file of their dataset, or whose name holds it (cited: position, file, dataset).

    Datasets meet file names by the rarest of their character runs; an empty
    one is in every name.
    """
    files = cited.select("position", "file", F.lower("dataset").alias("of"))
    wanted = corrections.select(F.lower("dataset").alias("of")).filter("of is not null").distinct()
    names = files.filter("file is not null").groupBy("file").agg(F.min("position").alias("position"))
    held = contained(wanted.select(F.col("of").alias("needle")), names.select(F.col("file").alias("text_id"), F.lower("file").alias("text")))
    by_name = held.select(F.col("needle").alias("of"), F.col("text_id").alias("file")).join(names, "file").select("of", "position", "file")
    any_name = wanted.filter("of = ''").join(F.broadcast(names.orderBy("position", "file").limit(1)))  # one row with one row
    hits = files.filter("of is not null").select("of", "position", "file").unionByName(by_name).unionByName(any_name.select("of", "position", "file"))
    first = hits.groupBy("of").agg(F.min_by("file", F.struct("position", "file")).alias("contradicts"))
    return corrections.join(first, F.lower("dataset") == F.col("of"), "left").drop("of")


# Memory

DIRECT, BY_NAME, PROCEDURAL = 1.0, 0.8, 1.1


def newest_facts(facts: DataFrame, per: int = 4) -> DataFrame:
    window = Window.partitionBy("node_id").orderBy(F.col("created").desc(), F.col("id").desc())
    return facts.withColumn("__n", F.row_number().over(window)).filter(F.col("__n") <= per).drop("__n")


def recall(hits: DataFrame, facts: DataFrame, nodes: DataFrame, now: Column, k: int = 12) -> DataFrame:
    """id, label, text, score of the best facts: matched ones, and the newest of matched nodes a little below (hits: kind, ref, score)."""
    from tessera.functions.dates import recency

    direct = hits.filter("kind = 'fact'").select(F.col("ref").alias("id"), F.col("score").alias("base"))
    named = hits.filter("kind = 'node'").select(F.col("ref").alias("node_id"), (F.col("score") * BY_NAME).alias("base"))
    expanded = newest_facts(facts).join(named, "node_id").select("id", "base")
    best = direct.unionByName(expanded).groupBy("id").agg(F.max("base").alias("base"))
    rows = facts.join(best, "id").join(nodes.select(F.col("id").alias("node_id"), "label"), "node_id")
    score = F.col("base") * recency("created", now) * F.when(F.col("kind") == "procedural", PROCEDURAL).otherwise(1.0)
    return rows.select("id", "label", "kind", "text", score.alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def add_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Facts with new ones; one that a node already has only counts as seen again."""
    from tessera.functions.text import normal_fact

    keyed = lambda df: df.withColumn("__same", normal_fact("text"))
    fresh = keyed(new).groupBy("node_id", "__same").agg(F.max("created").alias("__seen"))
    seen = keyed(old).join(fresh, ["node_id", "__same"], "left").withColumn("created", F.greatest("created", F.coalesce("__seen", "created"))).select(*old.columns)
    first = latest(keyed(new), ("node_id", "__same"), ("created",)).join(keyed(old).select("node_id", "__same"), ["node_id", "__same"], "left_anti")
    return seen.unionByName(first.select(*old.columns))


def add_edges(old: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Undirected edges to labels that exist, each pair once (links: a, label)."""
    named = links.join(nodes.select(F.col("id").alias("b"), F.lower("label").alias("__label")), F.lower("label") == F.col("__label")).filter("a != b")
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ordered(old).unionByName(ordered(named)).distinct()


def facts_by_node(facts: DataFrame) -> DataFrame:
    """A node has as many facts as were told about it."""
    return facts.groupBy("node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]).alias("facts"))


def save_rules(old: DataFrame, new: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """Rules with new ones; a new rule replaces the one that it mostly repeats."""
    from tessera.functions.text import keywords
    from tessera.operators.profile import best_match

    words = lambda df: df.withColumn("__words", keywords("text", names))
    match = best_match(words(new), words(old), "id", "__words").select(F.col("match").alias("id"))
    return reduce(DataFrame.unionByName, [old.join(match, "id", "left_anti"), new])
