"""Changes to tables as functions from the old table to the new one.

Writing the result (overwrite, dynamic partition overwrite or ``foreachBatch``) is the
caller's choice. Updates that touch few rows are anti joins plus a union, so unchanged rows
are not re-sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from keepsake.functions import scalars as S
from keepsake.operators.blocks import top_n
from keepsake.session import reliable


def affected(df: DataFrame, where: Column) -> DataFrame:
    """One row with the number of rows that a change under this condition touches (null conditions don't match)."""
    return df.filter(where).agg(F.count(F.lit(1)).alias("n_affected"))


def write_counted(marked: DataFrame, hit: Column, delete: bool = False) -> tuple[DataFrame, int]:
    """Write a changed table and measure in that write how many rows ``hit`` holds for; no second scan.

    With ``delete`` those rows are left out of what is written. The rows are observed in the job's last stage, so a stage
    that runs again after an executor is lost isn't counted twice.
    """
    seen = Observation()
    hits = F.coalesce(hit, F.lit(False))
    rows = marked.withColumn("_hit", hits).observe(seen, F.count_if(F.col("_hit")).alias("n"))
    table = reliable((rows.filter(~F.col("_hit")) if delete else rows).drop("_hit"))
    return table, seen.get["n"]


def migrate_attrs(items: DataFrame) -> DataFrame:
    """Move attributes of everything but products into the derived column."""
    product = F.col("type") == "product"
    attrs = F.col("attrs_json")
    return items.withColumns({
        "attrs_json": F.when(product, attrs),
        "attrs_ai": F.when(product, F.col("attrs_ai")).otherwise(F.coalesce("attrs_ai", attrs))})


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Insert or update by key; of several new rows per key the first in ``order`` wins."""
    newest = top_n(new, keys, order, 1)
    return old.join(newest.select(*keys), keys, "left_anti").unionByName(newest, allowMissingColumns=True)


def upsert_merge(old: DataFrame, new: DataFrame, keys: list[str], always: dict[str, Column] | None = None,
                 order: list[Column] | None = None) -> DataFrame:
    """Insert or update by key, keeping the old row's other columns.

    Of several new rows of a key the first in ``order`` wins (by default the one with the largest values); its non-key
    columns overwrite, ``always`` is set on every inserted or updated row.
    """
    order = order or [F.desc(c) for c in new.columns if c not in keys]
    n = (top_n(new, keys, order, 1) if order else new.dropDuplicates(keys)).withColumnsRenamed({c: f"_n_{c}" for c in new.columns if c not in keys}).withColumn("_hit", F.lit(True))
    both = old.join(n, keys, "full_outer")
    cols = []
    for c in old.columns:
        if c in keys:
            cols.append(F.col(c))
        elif always and c in always:
            cols.append(F.when(F.col("_hit"), always[c]).otherwise(F.col(c)).alias(c))
        elif c in new.columns:
            cols.append(F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return both.select(*cols)


def _hashed(keys: DataFrame) -> DataFrame:
    """Keys to join with by a hash table of one partition's keys: the larger side is neither sorted nor kept in memory."""
    return keys.hint("shuffle_hash")


def delete_keys(old: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return old.join(_hashed(keys.select(*on)), on, "left_anti")


def delete_keys_counted(old: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, int]:
    """``delete_keys``, written, and the number of rows that went."""
    gone = _hashed(keys.select(*on).distinct().withColumn("_gone", F.lit(True)))
    table, n = write_counted(old.join(gone, on, "left"), F.col("_gone").isNotNull(), delete=True)
    return table.drop("_gone"), n


def set_where(df: DataFrame, column: str, value: Column | str, where: Column) -> DataFrame:
    """Set a column on matching rows; null conditions do not match."""
    value = F.lit(value) if isinstance(value, str) else value
    return df.withColumn(column, F.when(where, value).otherwise(F.col(column)))


def bulk_set_status(items: DataFrame, status_from: str, status_to: str, domain: str | None = None) -> DataFrame:
    where = F.col("status") == status_from
    return set_where(items, "status", status_to, where if domain is None else where & (F.col("domain") == domain))


def bulk_set_status_counted(items: DataFrame, status_from: str, status_to: str,
                            domain: str | None = None) -> tuple[DataFrame, int]:
    """``bulk_set_status``, written, and the number of rows that changed."""
    where = F.col("status") == status_from
    marked = items.withColumn("_was", where if domain is None else where & (F.col("domain") == domain))
    table, n = write_counted(bulk_set_status(marked, status_from, status_to, domain), F.col("_was"))
    return table.drop("_was"), n


def inbox_batch(items: DataFrame, action: str, ids: DataFrame | None = None, domain: str | None = None,
                category_id: int | None = None, note: str | None = None) -> DataFrame:
    """Apply one action to listed inbox rows, or to the whole inbox of a domain.

    ``auto`` leaves rows unchanged; the rows it selects are ``inbox_targets``.
    """
    if action not in ("filed", "archived", "assign", "auto"):
        raise ValueError(f"unknown action {action}")
    targets = inbox_targets(items, ids, domain).select("id").withColumn("_t", F.lit(True))
    out = items.join(targets, "id", "left")
    hit = F.coalesce("_t", F.lit(False))
    if action in ("filed", "archived"):
        out = set_where(out, "status", action, hit)
    elif action == "assign":
        if category_id is None:
            raise ValueError("assign needs a category")
        out = set_where(out, "status", "filed", hit).withColumns({
            "category_id": F.when(hit, F.lit(category_id).cast("long")).otherwise(F.col("category_id")),
            "auto_note": F.when(hit, F.lit(note)).otherwise(F.col("auto_note"))})
    return out.drop("_t")


def inbox_targets(items: DataFrame, ids: DataFrame | None = None, domain: str | None = None) -> DataFrame:
    if ids is not None:
        return items.join(ids.select("id"), "id", "left_semi")
    out = items.filter(F.col("status") == "inbox")
    return out if domain is None else out.filter(F.col("domain") == domain)


def assign_category(items: DataFrame, assignments: DataFrame) -> DataFrame:
    """Set category, confidence, note and status from an assignment table.

    Of several assignments of an id the surest wins, then the larger category.
    """
    first = top_n(assignments, ["id"], [F.desc("confidence"), F.desc("category_id"), F.desc("note")], 1)
    a = first.select("id", F.col("category_id").alias("_c"), F.col("confidence").alias("_f"),
                           F.col("note").alias("_n"), F.lit(True).alias("_t"))
    hit = F.coalesce("_t", F.lit(False))
    return items.join(a, "id", "left").withColumns({
        "category_id": F.when(hit, F.col("_c")).otherwise(F.col("category_id")),
        "category_conf": F.when(hit, F.col("_f")).otherwise(F.col("category_conf")),
        "auto_note": F.when(hit, F.col("_n")).otherwise(F.col("auto_note")),
        "status": F.when(hit, "filed").otherwise(F.col("status"))}).drop("_c", "_f", "_n", "_t")


def delete_category(gone: DataFrame, items: DataFrame, categories: DataFrame, prompts: DataFrame,
                    feedback: DataFrame, owner_rules: DataFrame) -> dict[str, DataFrame]:
    """Remove categories (``gone(id)``) and settle what depends on them.

    Items lose the category and filed ones return to the inbox; prompts with their feedback
    and owner rules go; child categories lose the parent. ``counts`` has one row per removed
    category that existed.
    """
    g = gone.select("id").distinct().join(categories.select("id"), "id", "left_semi")
    by_cat = g.withColumnRenamed("id", "category_id")
    mark = by_cat.withColumn("_g", F.lit(True))
    hit = F.coalesce("_g", F.lit(False))
    new_items = items.join(mark, "category_id", "left").withColumns({
        "status": F.when(hit & (F.col("status") == "filed"), "inbox").otherwise(F.col("status")),
        "category_id": F.when(~hit, F.col("category_id"))}).drop("_g")
    removed = prompts.join(by_cat, "category_id", "left_semi").select(F.col("id").alias("prompt_id"))
    parents = g.select(F.col("id").alias("parent_id")).withColumn("_g", F.lit(True))
    new_cats = categories.join(g, "id", "left_anti").join(parents, "parent_id", "left").withColumn(
        "parent_id", F.when(F.coalesce("_g", F.lit(False)), F.lit(None)).otherwise(F.col("parent_id"))).drop("_g")

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("category_id").agg(F.count(F.lit(1)).alias(name))

    counts = categories.join(g, "id", "left_semi").select("id", "name", "domain")
    for name, df in (("items", items), ("prompts", prompts), ("owner_rules", owner_rules)):
        n = count(df, name).withColumnRenamed("category_id", "id")
        counts = counts.join(n, "id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return {"items": new_items, "categories": new_cats, "counts": counts,
            "prompts": prompts.join(by_cat, "category_id", "left_anti"),
            "feedback": feedback.join(removed, "prompt_id", "left_anti"),
            "owner_rules": owner_rules.join(by_cat, "category_id", "left_anti")}


# Task types that need their item, and the note of a recovered task.
ITEM_TASKS = ("auto_process", "build_links")
RECOVERED = "上次进程中断,已自动恢复重试"
#: shares into which tasks without an item are dealt
TASK_LOTS = 4096


def cancel_tasks(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop open tasks of item-bound types whose payload names a removed item (``ids(id)``)."""
    return (_with_item(jobs).join(_hashed(_gone_items(ids).distinct()), ["_item", "_lot"], "left_anti")
            .drop("_item", "_lot"))


def _with_item(jobs: DataFrame) -> DataFrame:
    """``_item`` and ``_lot``: most tasks name no item and would all meet in one partition, so they are dealt by their row."""
    lot = F.pmod(F.xxhash64(*jobs.columns), F.lit(TASK_LOTS).cast("long"))
    return jobs.withColumn("_item", _open_item()).withColumn("_lot", F.when(F.col("_item").isNull(), lot)
                                                             .otherwise(_lot_of(F.col("_item"))))


def _lot_of(item: Column) -> Column:
    """One lot for all named items; not a literal, which Spark would take out of the keys that rows are dealt by."""
    return F.when(item.isNotNull(), F.lit(0).cast("long"))


def _gone_items(ids: DataFrame) -> DataFrame:
    return ids.select(F.col("id").alias("_item"), _lot_of(F.col("id")).alias("_lot"))


def _open_item() -> Column:
    open_ = F.col("status").isin("pending", "running") & F.col("type").isin(*ITEM_TASKS)
    return F.when(open_, S.json_field("payload", "item_id").try_cast("long"))


def cancel_tasks_counted(jobs: DataFrame, ids: DataFrame) -> tuple[DataFrame, int]:
    """``cancel_tasks``, written, and the number of tasks that went."""
    table, n = delete_keys_counted(_with_item(jobs), _gone_items(ids), ["_item", "_lot"])
    return table.drop("_item", "_lot"), n


def delete_by_source(source_refs: DataFrame, items: DataFrame, chunks: DataFrame, vectors: DataFrame,
                     links: DataFrame, jobs: DataFrame) -> dict[str, DataFrame]:
    """Remove the items of the given sources with chunks, vectors, links and open tasks."""
    gone = reliable(items.join(_hashed(source_refs.select("source_ref")), "source_ref", "left_semi").select("id"))
    named = lambda name: _hashed(gone.select(F.col("id").alias(name)))      # noqa: E731
    by_item = named("item_id")
    return {
        "items": items.join(named("id"), "id", "left_anti"),
        "chunks": chunks.join(by_item, "item_id", "left_anti"),
        "vectors": vectors.join(by_item, "item_id", "left_anti"),
        "links": links.join(named("item_a"), "item_a", "left_anti").join(named("item_b"), "item_b", "left_anti"),
        "jobs": cancel_tasks(jobs, gone)}


def purge_stale(index: DataFrame, parents: DataFrame, key: str, row_id: str) -> DataFrame:
    """Index rows whose parent exists, one per parent: the smallest row id.

    Rows are placed before they meet the parents: the order by key and row id serves the join too.
    """
    return top_n(index, [key], [F.col(row_id)], 1).join(parents.select(key).distinct(), key, "left_semi")


def purge_stale_counted(index: DataFrame, parents: DataFrame, key: str, row_id: str) -> tuple[DataFrame, int]:
    """``purge_stale``, written, and the number of index rows that went."""
    live = parents.select(key).distinct().withColumn("_live", F.lit(True))
    place = F.row_number().over(Window.partitionBy(key).orderBy(row_id))
    marked = index.withColumn("_place", place).join(live, key, "left")
    table, n = write_counted(marked, F.col("_live").isNull() | (F.col("_place") > 1), delete=True)
    return table.drop("_live", "_place"), n


def bucket_schedule(ticks: DataFrame, source: str, ts: str, interval: int) -> DataFrame:
    """At most one check per source and time bucket."""
    return ticks.select(source, S.time_bucket(ts, interval).alias("bucket")).distinct()


def recover_running(jobs: DataFrame) -> DataFrame:
    """Interrupted tasks go back to the queue with a note."""
    running = F.col("status") == "running"
    return jobs.withColumns({
        "error": F.when(running, RECOVERED).otherwise(F.col("error")),
        "status": F.when(running, "pending").otherwise(F.col("status"))})


def recover_running_counted(jobs: DataFrame) -> tuple[DataFrame, int]:
    """``recover_running``, written, and the number of tasks that went back."""
    marked = jobs.withColumn("_was", F.col("status") == "running")
    table, n = write_counted(recover_running(marked), F.col("_was"))
    return table.drop("_was"), n


def append_rows(old: DataFrame, new: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Append rows; missing or null columns take the table's defaults."""
    for c, value in defaults.items():
        new = new.withColumn(c, F.coalesce(F.col(c), value) if c in new.columns else value)
    return old.unionByName(new, allowMissingColumns=True)


def persist_extraction(replies: DataFrame, skill: str) -> tuple[DataFrame, DataFrame]:
    """Replies ``(reply_id, skill, json)`` to profile rows and log rows, blanks dropped."""
    shape = ("profile array<struct<key: string, value: string>>, "
             "log struct<content: string, domain: string>")
    r = replies.withColumn("_r", F.from_json("json", shape))
    profile = r.select("reply_id", F.col(skill).alias("domain"), F.explode("_r.profile").alias("_p")).filter(
        (F.coalesce("_p.key", F.lit("")) != "") & F.col("_p.value").isNotNull()).select(
        "reply_id", "domain", "_p.key", "_p.value")
    log = r.filter(F.coalesce("_r.log.content", F.lit("")) != "").select(
        "reply_id", F.coalesce(F.nullif("_r.log.domain", F.lit("")), F.nullif(F.col(skill), F.lit("general")))
        .alias("domain"), F.col("_r.log.content").alias("content"))
    return profile, log
